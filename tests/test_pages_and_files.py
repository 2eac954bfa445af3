"""Pages, streams, files, the job and the stream of documents."""

from __future__ import annotations

import csv
import glob
import zipfile

from pyspark.sql import functions as F

from cloakwork.operators import audit, geometry, streams
from cloakwork.plans import job
from cloakwork.sources import files, office, sinks
from cloakwork.streaming import redaction

BOXES = "doc_id long, page int, word_idx int, text string, x0 double, x1 double, top double, bottom double, page_height double"


def test_boxes(spark):
    rows = [(0, "Aadhaar", 10.0, 50.0, 100.0, 110.0), (1, "4821", 55.0, 75.0, 100.5, 110.0), (2, "7391", 80.0, 100.0, 101.0, 110.0), (3, "6625.", 10.0, 32.0, 120.0, 130.0), (4, "priya@x.co,", 40.0, 90.0, 120.0, 130.0)]
    words = spark.createDataFrame([(1, 0, *r, 800.0) for r in rows], BOXES)
    assert [r["line"] for r in geometry.lines(words).orderBy("word_idx").collect()] == [0, 0, 0, 1, 1]
    corners = {(r[1], r[2]): i for i, *r in [(r[0], *r) for r in rows] for r in [r] for i in [r[0]]}
    for mode, want in (("public", {1, 2, 3, 4}), ("research", {1, 2, 3, 4}), ("audit", {1, 2, 3})):
        got = geometry.boxes(words, mode).collect()
        assert {next(i for i, _, x0, _, top, _ in rows if (x0, top) == (r["x0"], r["top"])) for r in got} == want
    one = geometry.rectangles(geometry.boxes(words, "public")).filter("x0 = 55").first()
    assert one["operator"] == "q 0 0 0 rg 53.50 688.50 23.00 12.50 re f Q" and one["replacement"] == "█" * 12
    assert geometry.box_stats(geometry.boxes(words, "audit")).collect()[0]["n"] == 3
    assert corners


def test_known_name_boxes(spark):
    words = spark.createDataFrame([(1, 0, i, t, float(i * 30), float(i * 30 + 20), 10.0, 20.0, 100.0) for i, t in enumerate(["Met", "Priya", "Nair,", "and", "rao", "Kumar"])], BOXES)
    got = geometry.boxes(words, "audit", spark.createDataFrame([("PRIYA nair",), ("Rao Kumar",)], "name string")).collect()
    assert [(r["x0"], r["replacement"]) for r in got] == [(30.0, "[NAME]")]


def blank(spark, s, names=()):
    return streams.blank_streams(spark.createDataFrame([(1, 0, 0, s.encode("latin-1"))], "doc_id long, page int, stream_idx int, content binary"), names).first()["content"].decode("latin-1")


def test_streams(spark):
    assert blank(spark, "BT (pan ABCDE1234F é) Tj 123-45-6789 ET") == "BT (pan            é) Tj 123-45-6789 ET"
    assert blank(spark, "(Aadhaar 4821 7391) Tj (6625.) Tj") == "(Aadhaar          ) Tj (" + " " * 10 + ") Tj"
    assert blank(spark, "(met priya NAIR) Tj", ["Priya Nair"]) == "(met           ) Tj"
    assert blank(spark, "no literal") == "no literal"


def test_readers(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes(b"one\r\ntwo\xff a@x.co")
    (tmp_path / "b.CSV").write_bytes("x,ABCDE​1234F\n".encode())
    (tmp_path / "c.sql").write_bytes(b"'PQRSX' /*hidden*/ '9876Z'")
    (tmp_path / "d.docx").write_bytes(office.docx_bytes("first <&>\nsecond"))
    (tmp_path / "e.xlsx").write_bytes(office.xlsx_bytes([("S1", [["a", "1"], ["", "b@x.co"]]), ("S2", [["z"]])]))
    (tmp_path / "f.xlsx").write_bytes(b"broken")
    (tmp_path / "g.png").write_bytes(b"not read")
    assert {r["name"] for r in files.uploads(spark, str(tmp_path), 50).filter("not accepted").collect()} == {"d.docx", "e.xlsx", "g.png"}
    got = {r["name"]: r for r in files.read(spark, str(tmp_path)).collect()}
    assert {n: r["file_ord"] for n, r in got.items()} == {"a.txt": 0, "b.CSV": 1, "c.sql": 2, "d.docx": 3, "e.xlsx": 4, "f.xlsx": 5}
    assert got["a.txt"]["text"] == "one\ntwo a@x.co" and got["b.CSV"]["text"] == "x,ABCDE 1234F\n" and got["c.sql"]["text"] == "'PQRSX9876Z'"
    assert got["d.docx"]["text"] == "first <&>\nsecond" and got["e.xlsx"]["text"] == "a\t1\n\tb@x.co\nz" and got["f.xlsx"]["text"] == ""
    grid = files.cells(files.read(spark, str(tmp_path)).filter("name = 'e.xlsx'"))
    assert grid.count() == 5
    put = files.rejoined_cells(grid, spark.createDataFrame([(4, "p\tq\textra\nr")], "doc_id long, text string"))
    assert {(r["sheet"], r["row"], r["col"]): r["value"] for r in put.collect()} == {("S1", 0, 0): "p", ("S1", 0, 1): "q", ("S1", 1, 0): "r", ("S1", 1, 1): "", ("S2", 0, 0): ""}
    done = job.run_folder(spark, str(tmp_path), str(tmp_path / "out"), "audit", words=["priya"])
    assert done.status == "done"
    assert (tmp_path / "out/a_audit.txt").read_text() == "one\ntwo [EMAIL]" and (tmp_path / "out/c_audit.sql").read_text() == "'[PAN]'"
    assert office.xlsx_text((tmp_path / "out/e_audit.xlsx").read_bytes()) == "a\t1\n\t[EMAIL]\nz" and (tmp_path / "out/f_audit.txt").exists()
    assert office.docx_text((tmp_path / "out/d_audit.docx").read_bytes()) == "first <&>\nsecond"
    log = list(csv.DictReader(open(glob.glob(f"{tmp_path}/out/redaction_log/*.csv")[0])))
    assert [r["pii_types_redacted"] for r in log] == ["email", "pan", "pan", "none", "email", "none"] and log[0]["output_file"] == "a_audit.txt"
    row = done.row.first()
    assert row["file_count"] == 6 and row["total_redactions"] == 4 and row["summary"] == {"email": 2, "pan": 2} and row["files"][0]["name"] == "a.txt"
    zips = sinks.bundles(sinks.outputs(done.redacted, "audit").withColumn("job_id", F.lit("j"))).first()
    (tmp_path / "z.zip").write_bytes(bytes(zips["content"]))
    assert len(zipfile.ZipFile(tmp_path / "z.zip").namelist()) == 6


def test_schema_files(spark, tmp_path):
    schema = {"IFSC": {"is_pii": True, "modes": ["audit"]}}
    sinks.save_schema(schema, f"{tmp_path}/pii_schema.json")
    assert files.load_schema(spark, f"{tmp_path}/pii_schema.json") == schema
    assert files.load_schema(spark, f"{tmp_path}/none.json") == {}


def test_failed_job(spark):
    docs = spark.createDataFrame([(1, "x")], "doc_id long, text string")
    bad = job.submit(spark, docs, "audit")  # no file_ord and name
    row = bad.row.first()
    assert bad.status == "error" and row["status"] == "error" and row["file_count"] == 0 and row["error"]


def test_tables(spark):
    jobs = audit.empty(spark, audit.JOBS)
    assert audit.dashboard(jobs).first()["jobs"] == 0
    users = audit.empty(spark, audit.USERS)
    assert audit.delete_user(users, "nobody").count() == 0
    one = spark.createDataFrame([("a", "x", None, None)], audit.USERS)
    users = audit.insert_user(users, one)
    assert users.first()["role"] == "analyst"
    try:
        audit.insert_user(users, one)
        raise AssertionError
    except ValueError as e:
        assert "exists" in str(e)


def test_stream(spark, tmp_path):
    spark.createDataFrame([(1, "a@x.co and 1.2.3.4"), (2, "b@x.co")], "doc_id long, text string").write.parquet(f"{tmp_path}/in")
    docs = redaction.read_stream(spark, f"{tmp_path}/in", "doc_id long, text string")
    q = redaction.counts_stream(redaction.redact_stream(docs, "audit")).writeStream.outputMode("complete").format("memory").queryName("counts").start()
    q.processAllAvailable()
    q.stop()
    assert {(r[0], r[1]) for r in spark.table("counts").collect()} == {("email", 2), ("ip", 1)}
