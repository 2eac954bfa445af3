"""Personal data on laid-out pages: word boxes in, boxes to blacken out.

words: doc_id, page, word_idx, text, x0, x1, top, bottom, page_height. Windows run over a page.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cloakwork.functions.text import stripped_end, strip
from cloakwork.functions.words import PAGE_NON_NAMES
from cloakwork.operators.rules import BLOCK

#: Whole-span patterns in their order (case matters here), blocks, gap between lines, padding.
PATTERNS = (
    ("pan", r"[A-Z]{5}(?U:\d){4}[A-Z]"),
    ("ssn", r"(?U)\d{3}-\d{2}-\d{4}"),
    ("card", r"(?U)(?:\d{4}[- ]){3}\d{4}"),
    ("ip", r"(?U)(?:\d{1,3}\.){3}\d{1,3}"),
    ("email", r"[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}"),
    ("phone", r"(?U)(?:\+91[-.\s]?)?\d{5}\s?\d{6}|\+91[-.\s]?\d{10}"),
)
WIDTHS = {"aadhaar": 12, "pan": 10, "ssn": 11, "email": 16, "phone": 12, "ip": 11, "card": 16, "name": 12}
GAP, PAD = 3.0, 1.5

_PAGE = ("doc_id", "page")


def token(pii_type: Column, value: Column) -> Column:
    """A research token that type and value decide, without a vault."""
    digest = F.sha2(F.concat(pii_type, F.lit(":"), strip(F.lower(value))), 256)
    return F.concat(F.lit("["), F.upper(pii_type), F.lit("-R"), F.upper(F.substring(digest, 1, 6)), F.lit("]"))


def replacement(pii_type: Column, value: Column, mode: str) -> Column:
    if mode == "research":
        return token(pii_type, value)
    if mode == "audit":
        return F.concat(F.lit("["), F.upper(pii_type), F.lit("]"))
    return reduce(lambda out, kv: F.when(pii_type == kv[0], BLOCK * kv[1]).otherwise(out), WIDTHS.items(), F.lit(BLOCK * 12))


def lines(words: DataFrame) -> DataFrame:
    """words with line, from 0: a new one where the top is more than GAP off the word before."""
    page = Window.partitionBy(*_PAGE).orderBy("word_idx")
    new = F.abs(F.col("top") - F.lag("top").over(page)) > GAP
    return words.withColumn("line", F.sum(F.coalesce(new.cast("int"), F.lit(0))).over(page))


def span_type(span: Column) -> Column:
    """The first pattern that a span is as a whole."""
    return F.coalesce(*(F.when(span.rlike(rf"\A(?:{p})\n?\z"), name) for name, p in PATTERNS))


def grams(lined: DataFrame) -> DataFrame:
    """Runs of one, two and three words of a line, with their boxes."""
    line = Window.partitionBy(*_PAGE, "line").orderBy("word_idx")
    at = lambda c, k: F.lead(c, k).over(line) if k else F.col(c)
    cleaned = lined.withColumn("clean", stripped_end(F.col("text")))
    wide = cleaned.select(*_PAGE, "line", "word_idx", "x0", "page_height", *(at(c, k).alias(f"{c}{k}") for c in ("clean", "x1", "top", "bottom") for k in range(3)))
    run = lambda n: F.struct(
        F.lit(n).alias("size"),
        strip(F.concat_ws(" ", *(f"clean{k}" for k in range(n)))).alias("span"),
        F.col(f"x1{n - 1}").alias("x1"),
        (F.least(*(f"top{k}" for k in range(n))) if n > 1 else F.col("top0")).alias("top"),
        (F.greatest(*(f"bottom{k}" for k in range(n))) if n > 1 else F.col("bottom0")).alias("bottom"),
        F.col(f"x1{n - 1}").isNotNull().alias("there"),
    )
    return wide.select(*_PAGE, "line", "word_idx", "x0", "page_height", F.explode(F.array(run(1), run(2), run(3))).alias("g")).select(*_PAGE, "line", "word_idx", "x0", "page_height", "g.*").filter("there").drop("there")


def pattern_boxes(lined: DataFrame, mode: str) -> DataFrame:
    """Boxes of spans that are personal data; none in audit mode."""
    found = grams(lined).withColumn("pii_type", span_type(F.col("span"))).filter("pii_type is not null")
    found = found.filter(F.lit(mode != "audit"))
    return found.select(*_PAGE, F.struct("line", F.lit(0).alias("phase"), "size", "word_idx").alias("ord"), "x0", "top", "x1", "bottom", "page_height", "pii_type", "span")


def name_boxes(lined: DataFrame, names: DataFrame) -> DataFrame:
    """Boxes of two capitalised words that are a known name (names: name)."""
    line = Window.partitionBy(*_PAGE, "line").orderBy("word_idx")
    cleaned = lined.withColumn("clean", stripped_end(F.col("text")))
    two = cleaned.select(*_PAGE, "line", "word_idx", "x0", "page_height", F.col("clean").alias("a"), F.lead("clean").over(line).alias("b"), F.lead("x1").over(line).alias("x1"), F.least("top", F.lead("top").over(line)).alias("top"), F.greatest("bottom", F.lead("bottom").over(line)).alias("bottom"))
    upper = lambda c: F.col(c).rlike(r"\A\p{Lu}")
    two = two.filter(F.col("b").isNotNull() & upper("a") & upper("b") & ~F.lower("a").isin(*PAGE_NON_NAMES) & ~F.lower("b").isin(*PAGE_NON_NAMES))
    two = two.withColumn("span", F.concat_ws(" ", "a", "b"))
    wanted = names.select(F.lower("name").alias("wanted")).distinct()
    two = two.join(wanted, F.lower(two["span"]) == wanted["wanted"], "left_semi")
    return two.select(*_PAGE, F.struct("line", F.lit(1).alias("phase"), F.lit(2).alias("size"), "word_idx").alias("ord"), "x0", "top", "x1", "bottom", "page_height", F.lit("name").alias("pii_type"), "span")


def aadhaar_boxes(words: DataFrame) -> DataFrame:
    """The three boxes of each run of three four-digit groups on a page, across lines too, in every mode."""
    page = Window.partitionBy(*_PAGE).orderBy("word_idx")
    parts = ("clean", "x0", "x1", "top", "bottom")
    cleaned = words.withColumn("clean", stripped_end(F.col("text")))
    three = cleaned.select(*_PAGE, "word_idx", "page_height", *((F.lead(c, k).over(page) if k else F.col(c)).alias(f"{c}{k}") for c in parts for k in range(3)))
    three = three.withColumn("span", F.concat_ws(" ", "clean0", "clean1", "clean2")).filter(F.col("clean2").isNotNull() & F.col("span").rlike(r"(?U)\A\d{4} \d{4} \d{4}\z"))
    boxes = F.array(*(F.struct(F.lit(k).alias("k"), *(F.col(f"{c}{k}").alias(c) for c in parts[1:])) for k in range(3)))
    last = F.lit(1 << 30).cast("long")
    return three.select(*_PAGE, "word_idx", "page_height", "span", F.explode(boxes).alias("b")).select(*_PAGE, F.struct(last.alias("line"), F.lit(2).alias("phase"), F.col("b.k").alias("size"), "word_idx").alias("ord"), F.struct("word_idx", "b.k").alias("in_page"), "b.x0", "b.top", "b.x1", "b.bottom", "page_height", F.lit("aadhaar").alias("pii_type"), "span")


def boxes(words: DataFrame, mode: str, names: DataFrame | None = None) -> DataFrame:
    """doc_id, page, x0, top, x1, bottom, page_height, pii_type, replacement: one for each rounded corner, the first found."""
    lined = lines(words)
    order = lambda df, by: df.withColumn("ord", by).select(*_PAGE, "ord", "x0", "top", "x1", "bottom", "page_height", "pii_type", "span")
    four = lambda a, b, c, d: F.array(*(x.cast("long") for x in (a, b, c, d)))
    found = order(pattern_boxes(lined, mode), four(F.col("ord.line"), F.lit(0), F.col("ord.size"), F.col("ord.word_idx")))
    if names is not None:
        found = found.union(order(name_boxes(lined, names), four(F.col("ord.line"), F.lit(1), F.lit(0), F.col("ord.word_idx"))))
    found = found.union(order(aadhaar_boxes(words), four(F.lit(1 << 40), F.lit(2), F.col("ord.word_idx"), F.col("ord.size"))))
    first = Window.partitionBy(*_PAGE, F.bround("x0"), F.bround("top")).orderBy("ord")
    found = found.withColumn("_n", F.row_number().over(first)).filter("_n = 1")
    return found.select(*_PAGE, "x0", "top", "x1", "bottom", "page_height", "pii_type", replacement(F.col("pii_type"), F.col("span"), mode).alias("replacement"))


def rectangle(x0: Column, top: Column, x1: Column, bottom: Column, height: Column) -> Column:
    """The page operator that blackens a box."""
    y0, y1 = height - bottom, height - top
    return F.format_string("q 0 0 0 rg %.2f %.2f %.2f %.2f re f Q", x0 - PAD, y0 - PAD, x1 - x0 + 2 * PAD, y1 - y0 + 2 * PAD)


def rectangles(found: DataFrame) -> DataFrame:
    return found.withColumn("operator", rectangle(*(F.col(c) for c in ("x0", "top", "x1", "bottom", "page_height"))))


def box_stats(found: DataFrame) -> DataFrame:
    """doc_id, pii_type, n: all boxes count as names, since replacements never match a pattern."""
    return found.groupBy("doc_id").agg(F.count("*").alias("n")).select("doc_id", F.lit("name").alias("pii_type"), "n")
