"""The registered queries of the redaction engine, one for each operator, and their SQL.

Names begin with the operator's number in the survey. Those without SQL are checked by tests.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cloakwork.functions import text as tx
from cloakwork.functions.words import FIELD_HINTS, NON_NAMES
from cloakwork.operators import audit, context, gazetteer, geometry, ner, redact, rules, spans, streams, vault
from cloakwork.plans import notes

QUERIES: dict = {}
ORACLE_SQL: dict = {}


def _table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _derived(spark: SparkSession, d: str, sql: str) -> DataFrame:
    """A derived table; its one source is read as a view of its own."""
    name = sql.rsplit("FROM ", 1)[1].split()[0]
    return spark.sql(sql.replace(f"FROM {name}", "FROM {source}"), source=_table(spark, d, name))


def _notes(spark: SparkSession, d: str) -> DataFrame:
    return _derived(spark, d, notes.NOTES)


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLE_SQL[name] = sql
        return f

    return add


def _lit(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _found(text: str, pattern: str, group: int = 0) -> str:
    return f"regexp_extract_all({text}, {_lit(pattern)}, {group})"


def flagship(spark: SparkSession, d: str) -> DataFrame:
    """doc_id, redacted, total of all documents in audit mode, words as its SQL has them."""
    return redact.redact(_table(spark, d, "documents").select("doc_id", "text"), "audit", ascii=True).select("doc_id", "redacted", "total")


# Sources, sinks and normalisation

_DUMP = "SELECT o_orderkey AS doc_id, 'INSERT ''PQ' || CAST(o_custkey AS STRING) || ''' /* hid' || chr(10) || 'den */  ''9876Z'' x' AS text FROM orders"


@query("s06_sql_literals", f"SELECT doc_id, regexp_replace(text, {_lit(r"(?s)'\s*/\*.*?\*/\s*'")}, '', 'g') AS text FROM ({_DUMP})")
def _(spark, d):
    return _derived(spark, d, _DUMP).select("doc_id", tx.rejoined_literals(F.col("text")).alias("text"))


@query("s11_jobs", f"SELECT * FROM ({notes.JOBS}) ORDER BY timestamp DESC")
def _(spark, d):
    return audit.list_jobs(_derived(spark, d, notes.JOBS))


@query("s12_users", f"SELECT username, role, created_at FROM ({notes.USERS}) ORDER BY created_at")
def _(spark, d):
    return audit.list_users(_derived(spark, d, notes.USERS))


@query("k08_output_names", "SELECT p_partkey, regexp_replace(p_name || '.Docx', '(.)\\.[^.]*$', '\\1') || '_audit' || '.Docx' AS output_file FROM part")
def _(spark, d):
    return _table(spark, d, "part").select("p_partkey", audit.output_name(F.concat("p_name", F.lit(".Docx")), "audit").alias("output_file"))


@query("n01_visible", f"SELECT doc_id, regexp_replace(text, {_lit(tx.INVISIBLE)}, ' ', 'g') AS text FROM ({notes.NOTES})")
def _(spark, d):
    return _notes(spark, d).select("doc_id", tx.visible(F.col("text")).alias("text"))


@query("n03_not_blank", "SELECT doc_id, length(text) AS n FROM documents WHERE regexp_matches(text, '\\S')")
def _(spark, d):
    return _table(spark, d, "documents").filter(tx.not_blank(F.col("text"))).select("doc_id", F.length("text").alias("n"))


@query("n05_devanagari", "SELECT doc_id, regexp_matches(text, '[ऀ-ॿ]') AS found FROM (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN text || 'हिन्दी' ELSE text END AS text FROM documents)")
def _(spark, d):
    text = F.when(F.col("doc_id") % 3 == 0, F.concat("text", F.lit("हिन्दी"))).otherwise(F.col("text"))
    return _table(spark, d, "documents").select("doc_id", tx.has_devanagari(text).alias("found"))


@query("n06_size_guard", "SELECT doc_id, length(text) <= 500000 AS within FROM documents")
def _(spark, d):
    return _table(spark, d, "documents").select("doc_id", tx.within_guard(F.col("text")).alias("within"))


@query("a11_bytes", "SELECT CAST(sum(strlen(text)) AS BIGINT) AS bytes FROM documents")
def _(spark, d):
    return _table(spark, d, "documents").agg(F.sum(F.octet_length("text")).alias("bytes"))


@query("n10_stripped_end", "SELECT o_orderkey, regexp_replace(o_orderpriority || '.,;)(' , '[.,;)(]+$', '') AS text FROM orders")
def _(spark, d):
    return _table(spark, d, "orders").select("o_orderkey", tx.stripped_end(F.concat("o_orderpriority", F.lit(".,;)("))).alias("text"))


# Rules


#: The rules as the SQL side has them, written out by hand: not taken from the library.
_PLAIN = {
    "card": r"\b\d{4}[- ]\d{4}[- ]\d{4}[- ]\d{4}\b",
    "aadhaar": r"\b\d{4}\s\d{4}\s\d{4}\b",
    "pan": "\\b[A-Z]{5}[\\s\u2800-\u28ff\u200b-\u200f]?\\d{4}[A-Z]\\b",
    "ssn": r"\b\d{3}-\d\d-\d{4}\b",
    "ip": r"\b\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}\b",
    "email": r"\b[A-Z0-9._%+\-]+@[A-Z0-9.\-]+\.[A-Z]{2,}\b",
    "upi": r"\b[A-Z0-9.\-_]{2,}@[A-Z]{2,}\b",
    "phone": r"(?:\+91[-.\s]?)?\d{5}[-.\s]\d{5}|(?:\+91[-.\s]?)?\d{5}\s?\d{6}|\+91[-.\s]?\d{10}|\b(?:\+91[-.\s]?)?\(?\d{3}\)?[-.\s]\d{3}[-.\s]\d{4}\b|\b[6-9]\d{9}\b",
    "dob": r"\b(?:DOB|Date\s+of\s+Birth|Born)[:\s]+\d{1,2}[/-]\d{1,2}[/-]\d{2,4}\b",
    "address": r"\b(?:Flat|F\.?No\.?|Apartment|Apt\.?|Plot|Door\s+No\.?)\s*[\w\-/]+(?:\s*,\s*[A-Z0-9\s\-]+)?|\b\d{1,5}[A-Z]?\s+[A-Z0-9\s]{3,40}(?:Street|St|Avenue|Ave|Road|Rd|Boulevard|Blvd|Drive|Dr|Lane|Ln|Court|Ct|Way|Place|Pl|Nagar|Marg|Vihar|Colony|Layout|Sector|Block|Extension|Ext|Cross|Main|Circle|Chowk|Bazaar|Bazar|Gali|Mohalla)\.?\b",
    "name": r"\b(?:Mr|Mrs|Ms|Dr|Prof)\.\s+[A-Z][A-Z]+(?:\s+[A-Z][A-Z]+)+",
}


def _chain_sql(source: str, mode: str, which=None) -> str:
    """The rule chain, one common table for each rule."""
    steps = [f"t0 AS (SELECT doc_id, regexp_replace(text, {_lit(tx.INVISIBLE)}, ' ', 'g') AS t FROM ({source}))"]
    chosen = [r for r in rules.active(mode) if which is None or r.name in which]
    for i, r in enumerate(chosen):
        pattern = _lit(f"(?i){_PLAIN[r.name]}")
        steps.append(f"t{i + 1} AS (SELECT * EXCLUDE (t), len(regexp_extract_all(t, {pattern})) AS n_{r.name}, regexp_replace(t, {pattern}, {_lit(rules.replacement(r.name, mode))}, 'g') AS t FROM t{i})")
    return f"WITH {', '.join(steps)} SELECT doc_id, t AS redacted, CAST({' + '.join(f'n_{r.name}' for r in chosen)} AS BIGINT) AS total FROM t{len(chosen)}"


def _single(rule: rules.Rule, table: str):
    def run(spark, d):
        docs = _notes(spark, d) if table == "notes" else _table(spark, d, table)
        df = docs.select("doc_id", tx.visible(F.col("text")).alias("text"))
        found = rules.hits(F.col("text"), rule, True)
        return df.select("doc_id", F.regexp_replace("text", rule.ascii, rules.replacement(rule.name, "audit")).alias("redacted"), F.size(found).cast("long").alias("total"))

    return run


for _i, _rule in enumerate(rules.RULES, 1):
    query(f"r{_i:02d}_{_rule.name}", _chain_sql(notes.NOTES, "audit", [_rule.name]))(_single(_rule, "notes"))
for _i, _name in ((5, "ip"), (6, "email"), (8, "phone")):
    query(f"r{_i:02d}_{_name}_documents", _chain_sql("SELECT doc_id, text FROM documents", "audit", [_name]))(_single(rules.BY_NAME[_name], "documents"))
for _mode in ("public", "audit"):
    query(f"r13_chain_{_mode}", _chain_sql(notes.NOTES, _mode))(lambda spark, d, m=_mode: redact.redact(_notes(spark, d), m).select("doc_id", "redacted", "total"))
query("t01_documents_audit", _chain_sql("SELECT doc_id, text FROM documents", "audit"))(flagship)
query("t01_documents_public", _chain_sql("SELECT doc_id, text FROM documents", "public"))(lambda spark, d: redact.redact(_table(spark, d, "documents"), "public", ascii=True).select("doc_id", "redacted", "total"))


@query(
    "r12_counts_by_type",
    _chain_sql(notes.NOTES, "audit").rsplit(" SELECT ", 1)[0]
    + f" SELECT doc_id, pii_type, CAST(n AS BIGINT) AS n FROM (UNPIVOT (SELECT * EXCLUDE (t) FROM t{len(rules.active('audit'))}) ON COLUMNS('^n_') INTO NAME k VALUE n) JOIN (SELECT unnest({[r.name for r in rules.active('audit')]}) AS pii_type) ON k = 'n_' || pii_type WHERE n > 0",
)
def _(spark, d):
    return redact.counts_by_type(_notes(spark, d), "audit")


# Replacement and vault

query("v02_replacements", " UNION ALL ".join(f"SELECT '{t}' AS pii_type, repeat('█', {rules.PUBLIC_WIDTHS.get(t, 12)}) AS public, '{'[' + t.upper() + ']' if t in rules.AUDIT_TYPES else '[REDACTED]'}' AS audit" for t in (*rules.BY_NAME, "generic", "other")))(
    lambda spark, d: spark.createDataFrame([(t, rules.replacement(t, "public"), rules.replacement(t, "audit")) for t in (*rules.BY_NAME, "generic", "other")], "pii_type string, public string, audit string")
)

_EMAIL = rules.BY_NAME["email"]
_HITS_SQL = f"hits AS (SELECT doc_id, i AS pos, {_found('text', '(?i)' + _PLAIN['email'])}[i] AS value FROM ({notes.NOTES}) n, unnest(range(1, len({_found('text', '(?i)' + _PLAIN['email'])}) + 1)) AS r(i))"
_VAULT_SQL = f"""{_HITS_SQL}, firsts AS (SELECT sha256(lower(trim(value))) AS key, min((doc_id, pos)) AS first FROM hits GROUP BY 1),
    tokens AS (SELECT 'email' AS pii_type, key, row_number() OVER (ORDER BY first) AS n, printf('[EMAIL-R%03d]', row_number() OVER (ORDER BY first)) AS token FROM firsts)"""


def _email_hits(spark, d):
    hits = _notes(spark, d).select("doc_id", F.posexplode(rules.hits(F.col("text"), _EMAIL)).alias("pos", "value"))
    return hits.select(F.lit("email").alias("pii_type"), "value", F.struct("doc_id", "pos").alias("ord"))


@query("v03_vault_email", f"WITH {_VAULT_SQL} SELECT * FROM tokens")
def _(spark, d):
    return vault.assign(_email_hits(spark, d))


@query("v04_summary", f"WITH {_VAULT_SQL} SELECT pii_type, count(*) AS n FROM tokens GROUP BY 1")
def _(spark, d):
    return vault.summary(vault.assign(_email_hits(spark, d)))


_PLAIN_EMAIL = _lit("(?i)" + _PLAIN["email"])
query("v03_research_notes")(lambda spark, d: redact.redact(_notes(spark, d), "research", notes.NAMES[:4], {"IFSC": {"is_pii": True, "modes": ["research"]}}, notes.WORDS).select("doc_id", "redacted", "total"))


@query(
    "v03_email_tokens",
    f"""WITH {_VAULT_SQL}, put AS (SELECT doc_id, list(token ORDER BY pos) AS tokens FROM hits JOIN tokens ON key = sha256(lower(trim(value))) GROUP BY doc_id),
        cut AS (SELECT doc_id, string_split_regex(text, {_PLAIN_EMAIL}) AS f FROM ({notes.NOTES}))
        SELECT doc_id, array_to_string(list_transform(range(1, len(f) + 1), lambda i: f[i] || coalesce(tokens[i], '')), '') AS redacted FROM cut LEFT JOIN put USING (doc_id)""",
)
def _(spark, d):
    docs = _notes(spark, d)
    hits = _email_hits(spark, d)
    told = hits.select("value", "ord.*").withColumn("key", vault.key(F.col("value"))).join(vault.assign(hits).select("key", "token"), "key")
    put = told.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("pos", "token"))).alias("put"))
    cut = F.split("text", _EMAIL.java, -1)
    return docs.join(put, "doc_id", "left").select("doc_id", redact.interleaved(cut, F.coalesce(F.col("put.token"), F.array().cast("array<string>"))).alias("redacted"))


@query("v05_preseed", "WITH k AS (SELECT lower(trim(n)) AS k, min(n) AS first FROM (SELECT unnest(['Priya Nair', 'priya nair', 'Aarav Mehta', 'Zoe Ek']) AS n) GROUP BY 1) SELECT sha256(k) AS key, printf('[NAME-R%03d]', row_number() OVER (ORDER BY first)) AS token FROM k")
def _(spark, d):
    names = spark.createDataFrame([("name", n, n) for n in ("Priya Nair", "priya nair", "Aarav Mehta", "Zoe Ek")], "pii_type string, value string, ord string")
    return vault.assign(names).select("key", "token")


@query("v07_entity_replacements", "SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN '[NAME]' WHEN 1 THEN '[LOCATION]' WHEN 2 THEN '[ORGANISATION]' ELSE '[REDACTED]' END AS audit, '[' || CASE c_custkey % 4 WHEN 0 THEN 'NAME' WHEN 1 THEN 'LOC' WHEN 2 THEN 'ORG' ELSE 'EVENT' END || '-R' || upper(substr(sha256(CASE c_custkey % 4 WHEN 0 THEN 'PERSON' WHEN 1 THEN 'GPE' WHEN 2 THEN 'ORG' ELSE 'EVENT' END || ':' || trim(lower(c_name))), 1, 6)) || ']' AS research FROM customer")
def _(spark, d):
    label = F.expr("CASE c_custkey % 4 WHEN 0 THEN 'PERSON' WHEN 1 THEN 'GPE' WHEN 2 THEN 'ORG' ELSE 'EVENT' END")
    return _table(spark, d, "customer").select("c_custkey", *(ner.replacement(label, F.col("c_name"), m).alias(m) for m in ("audit", "research")))


@query("v08_page_tokens", "SELECT c_custkey, '[NAME-R' || upper(substr(sha256('name:' || trim(lower(c_name))), 1, 6)) || ']' AS token FROM customer")
def _(spark, d):
    return _table(spark, d, "customer").select("c_custkey", geometry.token(F.lit("name"), F.col("c_name")).alias("token"))


# Corpus scan, known names, learned fields

_NON = "('" + "', '".join(NON_NAMES) + "')"
_PAIR_RE2 = r"\b[A-Z][a-z]{1,20}\s+[A-Z][a-z]{1,20}\b"
_IS_NAME = f"(lower(string_split_regex(name, '\\s+')[1]) IN {{w}} OR lower(string_split_regex(name, '\\s+')[2]) IN {{w}}) AND lower(string_split_regex(name, '\\s+')[1]) NOT IN {_NON} AND lower(string_split_regex(name, '\\s+')[2]) NOT IN {_NON}".format(w="('" + "', '".join(notes.WORDS) + "')")
_INTRODUCED = f"SELECT DISTINCT name FROM (SELECT unnest({_found('text', r'(?i)customer[,:\s]+([A-Z][a-z]{1,20}\s+[A-Z][a-z]{1,20})\s+contacted', 1)}) AS name FROM ({notes.NOTES})) WHERE lower(string_split_regex(name, '\\s+')[1]) NOT IN {_NON} AND lower(string_split_regex(name, '\\s+')[2]) NOT IN {_NON}"
_LISTED = f"SELECT DISTINCT name FROM (SELECT unnest({_found('text', _PAIR_RE2)}) AS name FROM ({notes.NOTES})) WHERE {_IS_NAME}"


@query("c01_introduced_names", _INTRODUCED)
def _(spark, d):
    return context.introduced(_notes(spark, d))


@query("c02_listed_names", _LISTED)
def _(spark, d):
    return context.listed(_notes(spark, d), notes.WORDS)


@query("c03_known_names", f"{_INTRODUCED} UNION {_LISTED}")
def _(spark, d):
    return context.known_names(_notes(spark, d), notes.WORDS)


_FIELDS = f"SELECT DISTINCT regexp_replace(upper(string_split_regex(hit, '\\s+')[1]), '[:#]+$', '') AS field FROM (SELECT unnest({_found('text', '(?i)(?:' + '|'.join(FIELD_HINTS) + r')[:\s#]+([A-Z0-9\-]+)')}) AS hit FROM ({notes.NOTES}))"


@query("c04_unknown_fields", f"SELECT field FROM ({_FIELDS}) WHERE field <> 'IFSC'")
def _(spark, d):
    return context.unknown_fields(_notes(spark, d), spark.createDataFrame([("IFSC",)], "field string"))


@query("c05_classified_fields", f"SELECT field, field = 'MRN' AS is_pii, CASE WHEN field = 'MRN' THEN 'audit' ELSE '' END AS modes FROM ({_FIELDS})")
def _(spark, d):
    answers = spark.createDataFrame([("MRN", True, ["audit"]), ("DL", False, ["audit"])], "field string, is_pii boolean, modes array<string>")
    return context.classified(context.fields(_notes(spark, d)), answers).withColumn("modes", F.array_join("modes", ","))


_SIGNED = f"SELECT doc_id, text || ' customer ' || {notes.choice('doc_id', notes.NAMES)} || ' contacted us, Contact ' || {notes.choice('doc_id + 3', notes.NAMES)} AS text FROM documents"
query("c06_documents_names", f"{_INTRODUCED} UNION {_LISTED}".replace(notes.NOTES, _SIGNED))(lambda spark, d: context.known_names(_derived(spark, d, _SIGNED), notes.WORDS))


@query("n07_scan_limit", f"SELECT '10 bytes' AS scan_limit, 0 AS names UNION ALL SELECT 'none', count(*) FROM ({_INTRODUCED} UNION {_LISTED})")
def _(spark, d):
    limits = {"10 bytes": 10, "none": None}
    return spark.createDataFrame([(k, len(context.scan(_notes(spark, d), notes.WORDS, n))) for k, n in limits.items()], "scan_limit string, names long")



_KNOWN = "(?i)" + "|".join(redact.ordered_names(notes.NAMES[:4]))


@query("t02_known_names", f"SELECT doc_id, regexp_replace(text, '{_KNOWN}', '[NAME]', 'g') AS text, len(regexp_extract_all(text, '{_KNOWN}')) AS n FROM ({notes.NOTES})")
def _(spark, d):
    return redact.apply_known_names(_notes(spark, d), notes.NAMES[:4], "[NAME]").select("doc_id", "text", F.size("hits_known").alias("n"))


@query("t03_learned_fields", f"SELECT doc_id, regexp_replace(regexp_replace(text, {_lit(r'(?i)(IFSC[:\s#]+)([A-Z0-9\-]+)')}, '\\1[REDACTED]', 'g'), {_lit(r'(?i)(MRN[:\s#]+)([A-Z0-9\-]+)')}, '\\1[REDACTED]', 'g') AS text FROM ({notes.NOTES})")
def _(spark, d):
    schema = {f: {"is_pii": f != "DL", "modes": ["audit"]} for f in ("IFSC", "MRN", "DL")}
    return redact.apply_fields(_notes(spark, d), schema, "audit").select("doc_id", "text")


_IFSC = _lit(r"(?i)(IFSC[:\s#]+)([A-Z0-9\-]+)")
query(
    "t04_full_audit_notes",
    f"""WITH names AS (SELECT '(?i)' || string_agg(name, '|' ORDER BY length(name) DESC, name) AS pattern FROM ({_INTRODUCED} UNION {_LISTED})),
        a AS (SELECT doc_id, redacted AS t, total FROM ({_chain_sql(notes.NOTES, "audit")})),
        b AS (SELECT doc_id, regexp_replace(t, pattern, '[NAME]', 'g') AS t, total + len(regexp_extract_all(t, pattern)) AS total FROM a, names),
        c AS (SELECT doc_id, regexp_replace(t, {_IFSC}, '\\1[REDACTED]', 'g') AS t, total + len(regexp_extract_all(t, {_IFSC})) AS total FROM b),
        p AS (SELECT doc_id, t, total, string_split_regex(t, {_lit(_PAIR_RE2)}) AS f, list_transform({_found('t', _PAIR_RE2)}, lambda name: CASE WHEN {_IS_NAME} THEN '[NAME]' ELSE name END) AS q, len(list_filter({_found('t', _PAIR_RE2)}, lambda name: {_IS_NAME})) AS n FROM c)
        SELECT doc_id, array_to_string(list_transform(range(1, len(f) + 1), lambda i: f[i] || coalesce(q[i], '')), '') AS redacted, CAST(total + n AS BIGINT) AS total FROM p""",
)(lambda spark, d: redact.redact(_notes(spark, d), "audit", context.scan(_notes(spark, d), notes.WORDS), {"IFSC": {"is_pii": True, "modes": ["audit"]}}, notes.WORDS).select("doc_id", "redacted", "total"))

# Gazetteer and spans

_GAZETTEER = f"SELECT doc_id, CAST(list_sum(list_transform(f[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(p[1:i - 1], lambda x: length(x))), 0) AS INT) AS start, p[i] AS name FROM (SELECT doc_id, string_split_regex(text, {_lit(_PAIR_RE2)}) AS f, {_found('text', _PAIR_RE2)} AS p FROM ({notes.NOTES})), unnest(range(1, len(p) + 1)) AS r(i)"


@query("g01_gazetteer_spans", f"SELECT doc_id, start, start + length(name) AS end, name AS value FROM ({_GAZETTEER}) WHERE {_IS_NAME}")
def _(spark, d):
    return gazetteer.spans(_notes(spark, d), spark.createDataFrame([(w,) for w in notes.WORDS], "word string"))


@query("g02_vocabulary", "SELECT lower(n_name) AS word FROM nation UNION SELECT lower(r_name) FROM region")
def _(spark, d):
    return gazetteer.vocabulary(_table(spark, d, "nation").select(F.col("n_name").alias("word")), _table(spark, d, "region").select(F.col("r_name").alias("word")))




def _places():
    """A detector that needs no model: words that begin so are places."""
    import re

    return lambda text: [(m.start(), m.end(), m[0], "GPE") for m in re.finditer("Th[a-z]{4,}", text)]


query("g04_entity_stage", f"SELECT doc_id, regexp_replace(redacted, 'Th[a-z]{{4,}}', '[LOCATION]', 'g') AS redacted, CAST(total + len(regexp_extract_all(redacted, 'Th[a-z]{{4,}}')) AS BIGINT) AS total FROM ({_chain_sql('SELECT doc_id, text FROM documents', 'audit')})")(
    lambda spark, d: redact.redact(_table(spark, d, "documents"), "audit", ner=ner.stage(notes.WORDS, _places), ascii=True).select("doc_id", "redacted", "total")
)

_KEPT = f"""WITH RECURSIVE s AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY start, stop DESC, prio) AS i FROM ({notes.SPANS})),
    walk AS (SELECT doc_id, i, start, stop, prio, true AS kept, stop AS last FROM s WHERE i = 1
             UNION ALL SELECT s.doc_id, s.i, s.start, s.stop, s.prio, s.start >= last, CASE WHEN s.start >= last THEN s.stop ELSE last END FROM walk JOIN s ON s.doc_id = walk.doc_id AND s.i = walk.i + 1)"""


def _kept(spark, d):
    rows = _derived(spark, d, notes.SPANS)
    one = F.struct(F.col("start"), F.col("stop").alias("end"), F.lit("v").alias("value"), F.lit("PERSON").alias("label"), F.when(F.col("prio") % 2 == 0, "Gazetteer").otherwise("Hindi-LOC").alias("source"), F.col("prio"), F.lit("[N]").alias("replacement"))
    return rows.groupBy("doc_id").agg(spans.without_overlaps(F.collect_list(one)).alias("spans"))


@query("g07_without_overlaps", f"{_KEPT} SELECT doc_id, start, stop FROM walk WHERE kept")
def _(spark, d):
    return _kept(spark, d).select("doc_id", F.explode("spans").alias("s")).select("doc_id", "s.start", F.col("s.end").alias("stop"))


@query("g08_apply_spans", f"{_KEPT}, k AS (SELECT *, lag(stop, 1, 0) OVER (PARTITION BY doc_id ORDER BY start) AS before FROM walk WHERE kept) SELECT doc_id, string_agg(substr(repeat('abcdefghij', 6), before + 1, start - before) || '[N]', '' ORDER BY start) || substr(repeat('abcdefghij', 6), max(stop) + 1) AS text FROM k GROUP BY doc_id")
def _(spark, d):
    return _kept(spark, d).select("doc_id", spans.apply(F.repeat(F.lit("abcdefghij"), F.lit(6)), F.col("spans")).alias("text"))


query("g08_category_counts", f"{_KEPT} SELECT doc_id, CASE WHEN prio % 2 = 0 THEN 'Name' ELSE 'Hindi' END AS category, count(*) AS n FROM walk WHERE kept GROUP BY 1, 2")(lambda spark, d: spans.category_counts(_kept(spark, d)))

# Pages

_LINES = f"SELECT *, CAST(sum(CASE WHEN abs(top - before) > 3 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, page ORDER BY word_idx) AS BIGINT) AS line FROM (SELECT *, lag(top) OVER (PARTITION BY doc_id, page ORDER BY word_idx) AS before FROM ({notes.BOXES}))"


@query("p02_lines", f"SELECT doc_id, page, word_idx, line FROM ({_LINES})")
def _(spark, d):
    return geometry.lines(_derived(spark, d, notes.BOXES)).select("doc_id", "page", "word_idx", "line")


_GRAMS = f"WITH c AS (SELECT *, regexp_replace(text, '[.,;)(]+$', '') AS clean FROM ({_LINES}))" + "".join(f"{', ' if n > 1 else ', '}g{n} AS (SELECT doc_id, page, line, word_idx, {n} AS size, concat_ws(' ', {', '.join(f'lead(clean, {k}) OVER w' for k in range(n))}) AS span, x0, lead(x1, {n - 1}) OVER w AS x1, least({', '.join(f'lead(top, {k}) OVER w' for k in range(n))}) AS top FROM c WINDOW w AS (PARTITION BY doc_id, page, line ORDER BY word_idx))" for n in (1, 2, 3))
_SIZES = " UNION ALL ".join(f"SELECT * FROM g{n} WHERE x1 IS NOT NULL" for n in (1, 2, 3))


@query("p03_grams", f"{_GRAMS} {_SIZES}")
def _(spark, d):
    return geometry.grams(geometry.lines(_derived(spark, d, notes.BOXES))).select("doc_id", "page", "line", "word_idx", "size", "span", "x0", "x1", "top")


_TYPED = "CASE " + " ".join(f"WHEN regexp_full_match(span, {_lit(p.replace('(?U:', '(?:').replace('(?U)', ''))}) THEN '{n}'" for n, p in geometry.PATTERNS) + " END"


@query("p01_typed_spans", f"{_GRAMS} SELECT doc_id, page, line, word_idx, size, pii_type FROM (SELECT *, {_TYPED} AS pii_type FROM ({_SIZES})) WHERE pii_type IS NOT NULL")
def _(spark, d):
    found = geometry.pattern_boxes(geometry.lines(_derived(spark, d, notes.BOXES)), "public")
    return found.select("doc_id", "page", "ord.line", "ord.word_idx", "ord.size", "pii_type")


@query("p04_name_boxes", f"{_GRAMS} SELECT doc_id, page, line, word_idx, span FROM g2 WHERE x1 IS NOT NULL AND regexp_matches(span, '^[A-Z][^ ]* [A-Z]') AND lower(span) IN ('priya nair', 'rao kumar')")
def _(spark, d):
    names = spark.createDataFrame([("Priya Nair",), ("RAO KUMAR",)], "name string")
    return geometry.name_boxes(geometry.lines(_derived(spark, d, notes.BOXES)), names).select("doc_id", "page", "ord.line", "ord.word_idx", "span")


_THREE = f"SELECT doc_id, page, word_idx, concat_ws(' ', a, lead(a, 1) OVER w, lead(a, 2) OVER w) AS span FROM (SELECT *, regexp_replace(text, '[.,;)(]+$', '') AS a FROM ({notes.BOXES})) WINDOW w AS (PARTITION BY doc_id, page ORDER BY word_idx)"


@query("p05_aadhaar_boxes", f"SELECT doc_id, page, word_idx, k, span FROM ({_THREE}), unnest(range(3)) AS r(k) WHERE regexp_full_match(span, '\\d{{4}} \\d{{4}} \\d{{4}}')")
def _(spark, d):
    return geometry.aadhaar_boxes(_derived(spark, d, notes.BOXES)).select("doc_id", "page", "in_page.word_idx", F.col("ord.size").alias("k"), "span")


query("p06_boxes")(lambda spark, d: geometry.boxes(_derived(spark, d, notes.BOXES), "public", spark.createDataFrame([(n,) for n in notes.NAMES], "name string")))


@query("p09_rectangles", f"SELECT doc_id, page, word_idx, printf('q 0 0 0 rg %.2f %.2f %.2f %.2f re f Q', x0 - 1.5, page_height - bottom - 1.5, x1 - x0 + 3, bottom - top + 3) AS operator FROM ({notes.BOXES})")
def _(spark, d):
    return geometry.rectangles(_derived(spark, d, notes.BOXES)).select("doc_id", "page", "word_idx", "operator")


_LEADS = ", ".join(f"lead({c}, {k}) OVER w AS {c}{k}" for c in ("a", "x0", "top") for k in range(3))
query(
    "p10_box_stats",
    f"""WITH t AS (SELECT doc_id, page, {_LEADS} FROM (SELECT *, regexp_replace(text, '[.,;)(]+$', '') AS a FROM ({notes.BOXES})) WINDOW w AS (PARTITION BY doc_id, page ORDER BY word_idx)),
        b AS (SELECT DISTINCT doc_id, page, round_even([x00, x01, x02][k], 0) AS x, round_even([top0, top1, top2][k], 0) AS y FROM t, unnest(range(1, 4)) AS r(k) WHERE regexp_full_match(concat_ws(' ', a0, a1, a2), '\\d{{4}} \\d{{4}} \\d{{4}}'))
        SELECT doc_id, 'name' AS pii_type, count(*) AS n FROM b GROUP BY doc_id""",
)(lambda spark, d: geometry.box_stats(geometry.boxes(_derived(spark, d, notes.BOXES), "audit")))

_STREAM = f"SELECT doc_id, 'BT (' || text || ') Tj T* (' || CAST(doc_id % 10000 + 1000 AS STRING) || ') Tj ( 1999. ) ET' AS s FROM ({notes.NOTES})"
query("p07_blank_streams")(lambda spark, d: _notes(spark, d).select("doc_id", streams.blank_literals(F.concat(F.lit("BT ("), "text", F.lit(") Tj")), notes.NAMES[:3]).alias("s")))


@query("p08_blank_orphans", f"SELECT doc_id, CASE WHEN doc_id % 10000 + 1000 < 10000 THEN replace(s, '(' || CAST(doc_id % 10000 + 1000 AS STRING) || ') Tj ', '(' || repeat(' ', 8) || ') Tj ') ELSE s END AS s FROM (SELECT doc_id, replace(s, '( 1999. )', '(' || repeat(' ', 14) || ')') AS s FROM ({_STREAM}))")
def _(spark, d):
    whole = F.concat(F.lit("BT ("), "text", F.lit(") Tj T* ("), (F.col("doc_id") % 10000 + 1000).cast("string"), F.lit(") Tj ( 1999. ) ET"))
    return _notes(spark, d).select("doc_id", streams.blank_orphans(whole).alias("s"))


# Statistics, log, jobs, users


@query("a02_file_totals", f"SELECT job_id, file_ord, name, CAST(sum(n) AS BIGINT) AS total FROM ({notes.STATS}) GROUP BY ALL")
def _(spark, d):
    return audit.file_totals(_derived(spark, d, notes.STATS))


@query("a03_job_summary", f"SELECT job_id, pii_type, CAST(sum(n) AS BIGINT) AS n FROM ({notes.STATS}) GROUP BY ALL")
def _(spark, d):
    return audit.job_summary(_derived(spark, d, notes.STATS))


@query("a04_job_totals", f"SELECT job_id, count(DISTINCT file_ord) AS file_count, CAST(sum(n) AS BIGINT) AS total_redactions, count(DISTINCT pii_type) AS types FROM ({notes.STATS}) GROUP BY job_id")
def _(spark, d):
    return audit.job_totals(_derived(spark, d, notes.STATS))


@query("a05_dashboard", f"SELECT count(*) AS jobs, CAST(sum(file_count) AS BIGINT) AS files, CAST(sum(total_redactions) AS BIGINT) AS redactions, count(DISTINCT run_by) AS users FROM ({notes.JOBS})")
def _(spark, d):
    return audit.dashboard(_derived(spark, d, notes.JOBS))


def _maps(spark, d):
    """job_id, file_ord, name, stats: a map of statistics for each file."""
    return _derived(spark, d, notes.STATS).groupBy("job_id", "file_ord", "name").agg(F.map_from_entries(F.collect_list(F.struct("pii_type", "n"))).alias("stats"))


@query("a06_result_cards", f"SELECT job_id, count(DISTINCT file_ord) AS file_count, CAST(sum(n) AS BIGINT) AS total, count(DISTINCT pii_type) AS types FROM ({notes.STATS}) GROUP BY job_id")
def _(spark, d):
    files = _maps(spark, d).groupBy("job_id").agg(F.collect_list(F.struct("name", "stats")).alias("files"))
    summary = audit.job_summary(_derived(spark, d, notes.STATS)).groupBy("job_id").agg(F.map_from_entries(F.collect_list(F.struct("pii_type", "n"))).alias("summary"))
    return audit.result_cards(files.join(summary, "job_id"))


@query("a07_file_sums", f"SELECT job_id, file_ord, CAST(sum(n) AS BIGINT) AS total, format('{{:,}}', CAST(sum(n) * 1000 AS BIGINT)) AS shown FROM ({notes.STATS}) GROUP BY ALL")
def _(spark, d):
    total = audit.file_sum(F.col("stats"))
    return _maps(spark, d).select("job_id", "file_ord", total.alias("total"), audit.shown(total * 1000).alias("shown"))


@query("a08_type_lists", f"SELECT job_id, file_ord, string_agg(pii_type, ', ' ORDER BY pii_type) AS types, CAST(sum(n) AS BIGINT) AS total FROM ({notes.STATS}) GROUP BY ALL")
def _(spark, d):
    stats = _derived(spark, d, notes.STATS).groupBy("job_id", "file_ord").agg(F.map_from_entries(F.collect_list(F.struct("pii_type", "n"))).alias("stats"))
    return stats.select("job_id", "file_ord", audit.type_list(F.col("stats")).alias("types"), F.aggregate(F.map_values("stats"), F.lit(0).cast("long"), lambda a, n: a + n).alias("total"))


@query("a10_count_users", "SELECT count(*) AS n FROM customer")
def _(spark, d):
    return _derived(spark, d, notes.USERS).agg(F.count("*").alias("n"))


_FILES = f"SELECT job_id, file_ord, name, list_sort(list(pii_type)) AS types, CAST(sum(n) AS BIGINT) AS total FROM ({notes.STATS}) WHERE job_id = 'job3' GROUP BY ALL"


@query("k09_log", f"SELECT '2024-01-02 03:04:05' AS timestamp, name AS original_file, replace(name, '.txt', '_audit.txt') AS output_file, 'audit' AS mode, array_to_string(types, ', ') AS pii_types_redacted, total AS total_redactions FROM ({_FILES})")
def _(spark, d):
    rows = _derived(spark, d, notes.STATS).filter("job_id = 'job3'").groupBy("file_ord", "name").agg(F.map_from_entries(F.collect_list(F.struct("pii_type", "n"))).alias("stats"), F.sum("n").alias("total"))
    return audit.log_rows(rows, "audit", F.lit("2024-01-02 03:04:05").cast("timestamp"))


@query("w05_progress", f"SELECT job_id, file_ord, CAST(floor((row_number() OVER (PARTITION BY job_id ORDER BY file_ord) - 1) / count(*) OVER (PARTITION BY job_id) * 100) AS INT) AS progress FROM (SELECT DISTINCT job_id, file_ord FROM ({notes.STATS}))")
def _(spark, d):
    return audit.progress(_derived(spark, d, notes.STATS).select("job_id", "file_ord").distinct())


@query("x02_seeded_users", f"SELECT username, role FROM ({notes.USERS}) UNION ALL SELECT 'owner', 'admin'")
def _(spark, d):
    users = _derived(spark, d, notes.USERS)
    first = spark.createDataFrame([("owner", "x", "admin")], "username string, password_hash string, role string").withColumn("created_at", F.current_date())
    return audit.seeded(users, first).union(audit.seeded(users.filter("false"), first)).select("username", "role")


@query("x03_insert_user", f"SELECT username, role FROM ({notes.USERS}) UNION ALL SELECT 'new one', 'analyst'")
def _(spark, d):
    users = _derived(spark, d, notes.USERS)
    new = spark.createDataFrame([("new one", "x", None)], "username string, password_hash string, role string").withColumn("created_at", F.current_date())
    return audit.insert_user(users, new).select("username", "role")


@query("x04_upsert_jobs", f"SELECT job_id, CASE WHEN total_redactions < 10 THEN 'error' ELSE status END AS status, CASE WHEN total_redactions < 10 THEN 0 ELSE total_redactions END AS total_redactions FROM ({notes.JOBS}) UNION ALL SELECT 'j-new', 'done', 5")
def _(spark, d):
    jobs = _derived(spark, d, notes.JOBS).select("job_id", "status", "total_redactions")
    new = jobs.filter("total_redactions < 10").select("job_id", F.lit("error").alias("status"), F.lit(0).cast("long").alias("total_redactions"))
    return audit.upsert(jobs, new.union(spark.createDataFrame([("j-new", "done", 5)], new.schema)))


@query("x05_delete_user", f"SELECT username FROM ({notes.USERS}) WHERE username <> (SELECT min(c_name) FROM customer)")
def _(spark, d):
    users = _derived(spark, d, notes.USERS)
    return audit.delete_user(users, users.agg(F.min("username")).first()[0]).select("username")


@query("x06_point_lookup", f"SELECT username, role FROM ({notes.USERS}) WHERE username = (SELECT max(c_name) FROM customer)")
def _(spark, d):
    users = _derived(spark, d, notes.USERS)
    return audit.user(users, users.agg(F.max("username")).first()[0]).select("username", "role")
