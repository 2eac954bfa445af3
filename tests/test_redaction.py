"""Golden rows of the rewrite chain, the vault, names, fields and spans."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from cloakwork.operators import context, gazetteer, ner, redact, rules, spans, vault
from cloakwork.plans import job

WORDS = ["priya", "nair", "rao", "kumar"]


def docs(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def out(spark, text, mode="audit", **more):
    r = redact.redact(docs(spark, text), mode, **more).first()
    return r["redacted"], dict(r["stats"])


GOLDEN = [
    ("Card 4111-1111-1111-1111 ok", "Card [CARD] ok", {"card": 1}),
    ("4111 1111 1111 1111", "[CARD]", {"card": 1}),
    ("Aadhaar 4821 7391 6625.", "Aadhaar [AADHAAR].", {"aadhaar": 1}),
    ("pan abcde1234f", "pan [PAN]", {"pan": 1}),
    ("ABCDE​1234F", "[PAN]", {"pan": 1}),
    ("ABCDE​​1234F", "ABCDE  1234F", {}),
    ("SSN 123-45-6789", "SSN [SSN]", {"ssn": 1}),
    ("999.999.999.999", "[IP]", {"ip": 1}),
    ("a.b@x.co ravi@okhdfc", "[EMAIL] [UPI]", {"email": 1, "upi": 1}),
    ("+91 98201 44312", "[PHONE]", {"phone": 1}),
    ("9820144312", "[PHONE]", {"phone": 1}),
    ("919820144312", "[PHONE]2", {"phone": 1}),
    ("4785380592391139", "[PHONE]91139", {"phone": 1}),
    ("+1 (743) 555-3824", "+1 ([PHONE]", {"phone": 1}),
    ("98201\n44312", "[PHONE]", {"phone": 1}),
    ("DOB: 01/02/1990", "[DOB]", {"dob": 1}),
    ("flatten the curve, and go home now.", "[ADDRESS] the curve, and go home now.", {"address": 1}),
    ("12 patients saw Dr. Rao Kumar today", "[ADDRESS]. [NAME] today", {"address": 1, "NER-Name": 1}),
    ("Mr. Rao called on Monday about a loan", "[NAME] a loan", {"name": 1}),
    ("Contact Priya Nair now", "[NAME] Nair now", {"NER-Name": 1}),
    ("", "", {}),
    (None, "", {}),
]


@pytest.mark.parametrize("text,want,stats", GOLDEN)
def test_golden(spark, text, want, stats):
    assert out(spark, text, words=WORDS) == (want, stats)


def test_modes(spark):
    assert out(spark, "DOB: 01/02/1990", "research") == ("DOB: 01/02/1990", {})
    assert out(spark, "ravi@okhdfc", "public")[0] == "█" * 12
    with pytest.raises(ValueError):
        rules.active("secret")


def test_scanned_names(spark):
    for text, want in (("customer Priya Nair contacted support", "customer [NAME] contacted support"), ("the user logged in from Delhi", "the user [NAME] from Delhi"), ("Contact Priya Nair now", "[NAME] Nair now")):
        names = context.scan(docs(spark, text), WORDS)
        assert out(spark, text, names=names, words=WORDS) == (want, {"name": 1})
    assert context.scan(docs(spark, "customer Priya Nair contacted support"), WORDS, limit=10) == []


def test_names_pattern(spark):
    """The tree of names finds what an alternation, longest first, finds."""
    names = ["Anna", "Anna Smith", "anna smithers", "Bob", "C++", "Ünal Ek", "x.y", "a b"]
    flat = "(?iu)" + "|".join(f"\\Q{n}\\E" for n in redact.ordered_names(names))
    texts = docs(spark, "ANNA SMITHERS annabel Anna Smit bobby c++ c+ ünal EK xxy X.Y", "a b anna smith", "", "Anna Smithe")
    got = texts.select(F.regexp_extract_all("text", F.lit(redact.names_pattern(names)), F.lit(0)).alias("a"), F.regexp_extract_all("text", F.lit(flat), F.lit(0)).alias("b")).collect()
    assert all(r["a"] == r["b"] for r in got) and got[0]["a"][0] == "ANNA SMITHERS"
    assert redact.names_pattern(["n" * 5000 + str(i) for i in range(3)]).count("n") == 5000
    assert redact.redact(docs(spark, "abc"), "audit", [""]).first()["redacted"] == "abc"


@pytest.mark.parametrize("mode", ["audit", "research"])
def test_filters_on_results(spark, mode):
    """Filters and generators on every result column leave a plan that ends."""
    r = redact.redact(docs(spark, "Card 4111-1111-1111-1111 a.b@x.co", "nothing here"), mode, ["Anna Smith"], {"IFSC": {"is_pii": True, "modes": ["audit"]}}, WORDS)
    assert r.filter("total > 0").count() == 1 and r.filter("size(stats) > 0 and redacted like '%x%'").count() == 0
    assert {(x[0], x[1]) for x in r.select(F.explode("stats")).collect()} == {("card", 1), ("email", 1)}
    assert r.select(F.explode(F.split("redacted", " ")).alias("w")).filter("w = 'here'").count() == 1
    assert r.join(r.select(F.col("redacted").alias("other")), F.col("redacted") == F.col("other")).count() == 2
    assert r.groupBy("total").count().filter("total = 2").first()["count"] == 1


def test_large_job_knows_names(spark):
    """A job of more than a megabyte is scanned for names as any other."""
    texts = docs(spark, "customer Priya Nair contacted support", "x " * 600_000, "then PRIYA NAIR wrote").withColumn("file_ord", F.col("doc_id").cast("int")).withColumn("name", F.lit("a.txt"))
    done = job.submit(spark, texts, "audit")
    assert done.names == ["Priya Nair"]
    assert done.redacted.filter("doc_id = 2").first()["redacted"] == "then [NAME] wrote"
    assert job.submit(spark, texts, "audit", scan_limit=context.SCAN_LIMIT).names == []


def test_learned_fields(spark):
    schema = {"IFSC": {"is_pii": True, "modes": ["audit"]}, "MRN": {"is_pii": False, "modes": []}}
    assert out(spark, "IFSC: HDFC0001234 MRN 12", schema=schema) == ("IFSC: [REDACTED] MRN 12", {"IFSC": 1})
    assert {r[0] for r in context.fields(docs(spark, "IFSC: A1, swift#B2 IFSC:ABC1")).collect()} == {"IFSC", "SWIFT#B2", "IFSC:ABC1"}


def test_no_stack_overflow(spark):
    text = "Mr. " + "ab cd " * 40_000
    r = redact.redact(docs(spark, text), "audit").first()
    assert r["redacted"] == "[NAME] " and r["stats"] == {"name": 1}


def test_size_guard(spark):
    text = "x" * 500_001 + " Priya Nair"
    assert redact.redact(docs(spark, text), "audit", words=WORDS).first()["redacted"] == text


def test_digests_are_columns(spark):
    """No join of research mode takes a digest in its condition, where each comparison of its sort would take it again."""
    plan = redact.redact(docs(spark, "a@x.co"), "research")._jdf.queryExecution().optimizedPlan().toString()
    joins = [line for line in plan.splitlines() if "Join " in line]
    assert len(joins) > 1 and not any("sha2" in line for line in joins)


def test_scan_reads_once(spark, tmp_path):
    """Introduced and listed names come from one pass over the documents."""
    docs(spark, "customer Omar Stone contacted us", "Contact Priya Nair now, customer Data Portal contacted", "", None).write.parquet(f"{tmp_path}/d")
    found = context.known_names(spark.read.parquet(f"{tmp_path}/d"), WORDS)
    assert {r[0] for r in found.collect()} == {"Omar Stone", "Contact Priya"}
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Relation [") == 1


def test_vault(spark):
    got = {r["doc_id"]: r["redacted"] for r in redact.redact(docs(spark, "b@x.co a@x.co", "A@x.co and Priya Nair", "aarav mehta, PRIYA NAIR"), "research", names=["Priya Nair", "Aarav Mehta"]).collect()}
    assert got == {0: "[EMAIL-R001] [EMAIL-R002]", 1: "[EMAIL-R002] and [NAME-R002]", 2: "[NAME-R001], [NAME-R002]"}
    many = redact.redact(docs(spark, " ".join(f"u{i}@x.co" for i in range(1000))), "research").first()["redacted"]
    assert many.endswith("[EMAIL-R999] [EMAIL-R1000]")


def test_research_equals_a_sequential_vault(spark):
    """Every kind of hit in many documents, numbered as one pass over the files would."""
    texts = [f"u{i % 7}@x.co 4111-1111-1111-{1000 + i % 5} IFSC: A{i % 4} Mr. Ab Cd, Rao Kumar and ravi{i % 3}@okbank Priya Nair" for i in range(40)]
    schema = {"IFSC": {"is_pii": True, "modes": ["research"]}}
    seen, counters = {}, {}

    def token(t, value):
        k = (t, value.lower().strip())
        if k not in seen:
            counters[t] = counters.get(t, 0) + 1
            seen[k] = f"[{t.upper()}-R{counters[t]:03d}]"
        return seen[k]

    token("name", "Priya Nair")
    want = {}
    for i in range(40):
        card, mail, upi = token("card", f"4111-1111-1111-{1000 + i % 5}"), token("email", f"u{i % 7}@x.co"), token("upi", f"ravi{i % 3}@okbank")
        titled, known = token("name", "Mr. Ab Cd"), token("name", "Priya Nair")
        field, listed = token("generic", f"A{i % 4}"), token("name", "Rao Kumar")
        want[i] = f"{mail} {card} IFSC: {field} {titled}, {listed} and {upi} {known}"
    for parts in ("1", "4", "7"):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        got = {r["doc_id"]: r["redacted"] for r in redact.redact(docs(spark, *texts).repartition(3), "research", names=["Priya Nair"], schema=schema, words=WORDS).collect()}
        assert got == want
    spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_marks_in_the_input(spark):
    assert redact.redact(docs(spark, "﷕ a@x.co"), "research").first()["redacted"] == "� [EMAIL-R001]"


def test_overlaps(spark):
    def kept(*pairs):
        one = [F.struct(F.lit(a).alias("start"), F.lit(b).alias("end"), F.lit(0).alias("prio")) for a, b in pairs]
        return [(r["start"], r["end"]) for r in spark.range(1).select(spans.without_overlaps(F.array(*one)).alias("s")).first()["s"]]

    assert kept((0, 5), (0, 9), (4, 12), (9, 11), (12, 13)) == [(0, 9), (9, 11), (12, 13)]
    assert kept((0, 5), (3, 20)) == [(0, 5)]


def test_gazetteer_spans(spark):
    got = gazetteer.spans(docs(spark, "é Contact Priya Nair Rao  Kumar and Support Nair"), spark.createDataFrame([(w,) for w in WORDS], "word string")).collect()
    assert sorted((r["start"], r["end"], r["value"]) for r in got) == [(2, 15, "Contact Priya"), (16, 24, "Nair Rao")]


def test_entity_stage(spark):
    def finder():  # in here, so that workers get it whole
        return lambda text: [(m, m + 5, text[m : m + 5], "GPE") for m in range(len(text) - 4) if text[m : m + 5] == "Delhi"] + [(0, 3, text[:3], "ORG")]

    stage = ner.stage(WORDS, finder)
    r = redact.redact(docs(spark, "Rao Kumar of Delhi"), "audit", ner=stage).first()
    assert r["redacted"] == "[NAME] of [LOCATION]" and r["stats"] == {"NER-Name": 1, "NER-GPE": 1}
    assert ner.chunked(lambda t: [(0, 1, t[:1], "LOC")], "abcdef", 4) == [(0, 1, "a", "LOC"), (4, 5, "e", "LOC")]
    hindi = ner.stage(WORDS, None, lambda: lambda text: [(0, 2, text[:2], "LOC")])
    assert redact.redact(docs(spark, "हि है"), "public", ner=hindi).first()["redacted"] == "████████ है"


def test_tokens_of_types(spark):
    rows = spark.createDataFrame([("a", "x", 2), ("a", " X ", 1), ("b", "x", 3), ("a", "y", 0)], "pii_type string, value string, ord int")
    assert {(r["pii_type"], r["n"]) for r in vault.assign(rows).collect()} == {("a", 1), ("a", 2), ("b", 1)}
    assert {(r[0], r[1]) for r in vault.summary(vault.assign(rows)).collect()} == {("a", 2), ("b", 1)}
