"""The registered queries, with SQL side by side on the smallest tables."""

from __future__ import annotations

import glob
import os
import random
import subprocess
import sys

import duckdb
import pytest

import __spark_entry__ as entry
from cloakwork.plans import catalog

D = "/root/testdata/sf0.001"


def rows(found):
    return sorted(repr(tuple(float(x) if isinstance(x, float) else x for x in r)) for r in found)


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in glob.glob(f"{D}/*.parquet"):
        c.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_sql(spark, duck, name):
    df = entry.queries()[name](spark, D)
    columns = sorted(df.columns)
    want = duck.sql(catalog.ORACLE_SQL[name])
    assert sorted(want.columns) == columns
    got = rows(df.select(*columns).collect())
    assert got == rows(want.select(", ".join(f'"{c}"' for c in columns)).fetchall()) and got


@pytest.mark.parametrize("name", ["t01_documents_audit", "t01_documents_public", "g04_entity_stage", "r05_ip_documents", "r06_email_documents", "r08_phone_documents"])
def test_sql_beyond_ascii(spark, tmp_path, name):
    """Words end where the SQL's end, next to letters that are not ASCII too."""
    some = random.Random(7)
    bits = ["é", "ſ", "\u212a", "ı", "İ", "ß", "\u0663", "\v", "\u2028", "\u3000", "\x1f", "\x85", " ", " ", "a", "St", "st", "Rd", "main", "road", "bloc\u212a", "12", "98201", "44312", "4111-1111-1111-1111", "1234 5678 9012", "abcde1234f", "123-45-6789"]
    bits += ["1.2.3.4", "a.b@x.co", "ravi@ok", "\u212a@o\u212a", "DOB: 1/2/1990", "Flat", "Apt.", "door no", "-", ",", ".", "Dr. Mia Ek", "Prof.", "Mr\u017f. Xa Xb", "Thousand"]
    texts = ["12 personas está aquí", "été flat été", "7 du système"] + ["".join(some.choices(bits, k=some.randint(2, 9))) for _ in range(3000)]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    c = duckdb.connect()
    c.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    got = rows(entry.queries()[name](spark, str(tmp_path)).select("doc_id", "redacted", "total").collect())
    assert got == rows(c.sql(f"SELECT doc_id, redacted, total FROM ({catalog.ORACLE_SQL[name]})").fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() == 200


def test_without_llm(tmp_path):
    """The entry imports where the subpackage and the pipeline are gone."""
    root = os.path.dirname(os.path.abspath(entry.__file__))
    os.makedirs(tmp_path / "r")
    subprocess.run(["cp", "-r", f"{root}/cloakwork", f"{root}/__spark_entry__.py", str(tmp_path / "r")], check=True)
    subprocess.run(["rm", "-rf", str(tmp_path / "r/cloakwork/llm")], check=True)
    code = "import __spark_entry__ as e; q = e.queries(); assert q and not any(n.startswith('op') or n == 'pipeline' for n in q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "r", check=True, env=os.environ | {"PYTHONPATH": ""})
