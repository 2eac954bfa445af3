"""Text, spans, word boxes and job tables derived from the test tables, by SQL that Spark and DuckDB both run."""

from __future__ import annotations


def digits(x: str, n: int) -> str:
    return f"lpad(CAST(({x}) % {10**n} AS STRING), {n}, '0')"


def choice(x: str, values: list[str]) -> str:
    cases = " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(values[:-1]))
    return f"(CASE ({x}) % {len(values)} {cases} ELSE '{values[-1]}' END)"


NAMES = ["Priya Nair", "Rao Kumar", "Aarav Mehta", "Jane Porter", "Support Nair", "Asha Rao", "Omar Stone"]
WORDS = ["priya", "nair", "rao", "kumar", "aarav", "mehta", "asha"]
_NAME = choice("o_orderkey", NAMES)
_K, _C = "o_orderkey", "o_custkey"
_TEXTS = [
    f"'Paid with card ' || {digits(_K, 4)} || '-' || {digits(_K + ' * 7', 4)} || '-' || {digits(_K + ' * 13', 4)} || '-' || {digits(_C, 4)} || ' today'",
    f"'Aadhaar ' || {digits(_K, 4)} || ' ' || {digits(_K + ' * 3', 4)} || ' ' || {digits(_C, 4)} || ' on file'",
    f"'tax code abcde' || {digits(_K, 4)} || 'f noted, and PQRST​' || {digits(_C, 4)} || 'Z too'",
    f"'SSN ' || {digits(_K, 3)} || '-' || {digits(_C, 2)} || '-' || {digits(_K, 4)} || ' checked'",
    f"'Host 10.' || CAST({_K} % 256 AS STRING) || '.' || CAST({_C} % 256 AS STRING) || '.7 and 999.1.2.3 replied'",
    f"'Write to user' || CAST({_K} % 50 AS STRING) || '@mail' || CAST({_C} % 7 AS STRING) || '.example.com or User' || CAST({_C} % 50 AS STRING) || '@mail1.example.com please'",
    f"'Pay ravi' || CAST({_K} % 40 AS STRING) || '@okbank now, or ravi@okbank'",
    f"'Call +91 ' || {digits(_K, 5)} || ' ' || {digits(_C, 5)} || ' or 98' || {digits(_K, 8)} || ' or (743) 555-' || {digits(_C, 4)} || ' soon'",
    f"'DOB: ' || {digits(_K + ' % 28 + 1', 2)} || '/0' || CAST({_C} % 9 + 1 AS STRING) || '/1980 recorded'",
    f"'Office at ' || CAST({_K} % 900 + 1 AS STRING) || ' Long Hill Road, Flat ' || CAST({_C} AS STRING) || ', fine'",
    f"'Spoke with Dr. ' || {_NAME} || ', fine'",
    f"'customer ' || {_NAME} || ' contacted support, and Contact ' || {_NAME} || ' now'",
    f"'IFSC: HDFC' || {digits(_K, 4)} || ' and MRN# ' || {digits(_C, 5)} || ' ok'",
]
TEXT = "CASE o_orderkey % 13 " + " ".join(f"WHEN {i} THEN {t}" for i, t in enumerate(_TEXTS)) + " END"
#: doc_id, text.
NOTES = f"SELECT o_orderkey AS doc_id, {TEXT} AS text FROM orders"
#: doc_id, page, word_idx, text, x0, x1, top, bottom, page_height: halves and quarters, so nothing is rounded.
BOXES = f"""
    SELECT o_custkey % 40 AS doc_id, CAST(o_custkey % 3 AS INT) AS page, o_orderkey AS word_idx,
           CASE o_orderkey % 6 WHEN 0 THEN {digits(_K, 4)} WHEN 1 THEN {digits(_C, 4)} || '.' WHEN 2 THEN {digits(_K + ' * 3', 4)}
                WHEN 3 THEN 'ABCDE' || {digits(_K, 4)} || 'F,' WHEN 4 THEN {choice('o_custkey', ['Priya', 'Rao', 'Aarav'])}
                ELSE {choice('o_custkey', ['Nair', 'Kumar', 'user@x.co;'])} END AS text,
           CAST(o_orderkey % 500 AS DOUBLE) + 0.5 AS x0, CAST(o_orderkey % 500 AS DOUBLE) + 20.25 AS x1,
           CAST(o_orderkey % 97 AS DOUBLE) / 4 + 100 AS top, CAST(o_orderkey % 97 AS DOUBLE) / 4 + 110 AS bottom, CAST(800 AS DOUBLE) AS page_height
    FROM orders"""
#: doc_id, start, stop, prio: spans of which many overlap.
SPANS = "SELECT l_orderkey AS doc_id, CAST(l_partkey % 40 AS INT) AS start, CAST(l_partkey % 40 + 1 + l_suppkey % 12 AS INT) AS stop, CAST(l_linenumber AS INT) AS prio FROM lineitem"
#: job_id, file_ord, name, pii_type, n: distinct keys.
STATS = """
    SELECT 'job' || CAST(l_suppkey % 20 AS STRING) AS job_id, CAST(l_orderkey % 50 AS INT) AS file_ord, 'file' || CAST(l_orderkey % 50 AS STRING) || '.txt' AS name,
           CASE l_linenumber WHEN 1 THEN 'email' WHEN 2 THEN 'phone' WHEN 3 THEN 'name' ELSE 'ip' END AS pii_type, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS n
    FROM lineitem GROUP BY 1, 2, 3, 4"""
#: The scalar columns of the job table.
JOBS = """
    SELECT 'j' || CAST(o_orderkey AS STRING) AS job_id, o_orderdate AS timestamp, CASE o_orderkey % 3 WHEN 0 THEN 'public' WHEN 1 THEN 'audit' ELSE 'research' END AS mode,
           CAST(o_custkey % 9 AS INT) AS file_count, CAST(o_orderkey % 100 AS BIGINT) AS total_redactions, CASE WHEN o_orderkey % 11 = 0 THEN 'error' ELSE 'done' END AS status,
           'user' || CAST(o_custkey % 30 AS STRING) AS run_by
    FROM orders"""
USERS = "SELECT c_name AS username, 'x' AS password_hash, CASE c_nationkey % 2 WHEN 0 THEN 'admin' ELSE 'analyst' END AS role, DATE '2020-01-01' + CAST(c_custkey AS INT) AS created_at FROM customer"
