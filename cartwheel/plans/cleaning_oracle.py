"""DuckDB SQL for the profile and cleaning queries (see ``cartwheel.plans.cleaning``)."""

from __future__ import annotations

from cartwheel.sources.csv import PANDAS_NA_TOKENS

REGISTER = """
register AS (
  SELECT o.o_orderkey, o.o_custkey, o.o_orderstatus, o.o_totalprice,
         CASE WHEN o.o_orderkey % 11 = 0 THEN NULL ELSE o.o_orderdate END AS o_orderdate,
         NULLIF(o.o_orderpriority, '4-NOT SPECIFIED') AS o_orderpriority,
         c.c_mktsegment,
         CASE WHEN c.c_acctbal < 0 THEN NULL ELSE c.c_acctbal END AS c_acctbal,
         l.quality AS label_quality,
         CASE WHEN o.o_orderkey % 17 = 0 THEN 'n/a' WHEN o.o_orderkey % 11 = 0 THEN NULL
              ELSE strftime(o.o_orderdate, '%Y-%m-%d') END AS reg_date
  FROM orders o LEFT JOIN customer c ON o.o_custkey = c.c_custkey
       LEFT JOIN labels l ON o.o_orderkey = l.doc_id)
"""

INDEXED = "indexed AS (SELECT *, row_number() OVER (ORDER BY o_orderkey) - 1 AS row_no FROM register)"

# The register's columns and their Spark type names.
REGISTER_COLUMNS = [
    ("o_orderkey", "bigint"), ("o_custkey", "bigint"), ("o_orderstatus", "string"),
    ("o_totalprice", "double"), ("o_orderdate", "timestamp_ntz"), ("o_orderpriority", "string"),
    ("c_mktsegment", "string"), ("c_acctbal", "double"), ("label_quality", "int"),
    ("reg_date", "string"),
]
NUMERIC = ["o_orderkey", "o_custkey", "o_totalprice", "c_acctbal", "label_quality"]
TEXT = ["o_orderstatus", "o_orderpriority", "c_mktsegment", "reg_date"]
COLS = [c for c, _ in REGISTER_COLUMNS]


def _w(body: str, *ctes: str) -> str:
    return "WITH " + ",\n".join(c.strip() for c in (REGISTER, *ctes)) + "\n" + body.strip()


def _digests(text: str) -> str:
    return f"""
SELECT doc_id, source, lang, n_chars, length(t) AS text_chars, sha256(t) AS text_sha256
FROM (SELECT *, {text} AS t FROM documents)"""


def _union(parts) -> str:
    return "\nUNION ALL\n".join(parts)


def _half_even_pct(part: str, whole: str, decimals: int = 1) -> str:
    """round_half_even(part / whole * 100, decimals) on the exact rational value."""
    num = f"(CAST({part} AS HUGEINT) * {100 * 10**decimals})"
    den = f"CAST(NULLIF({whole}, 0) AS HUGEINT)"
    q = f"(({num} - ({num} % {den})) // {den})"
    r = f"({num} % {den})"
    return (f"CAST(CASE WHEN {r} * 2 > {den} THEN {q} + 1 "
            f"WHEN {r} * 2 = {den} AND {q} % 2 = 1 THEN {q} + 1 ELSE {q} END AS DOUBLE) / {10**decimals}.0")


_Q = "quantile_cont"


def _describe() -> str:
    parts = [f"""SELECT '{c}' AS "column", COUNT({c}) AS count, AVG(CAST({c} AS DOUBLE)) AS mean,
       STDDEV_SAMP(CAST({c} AS DOUBLE)) AS std, CAST(MIN({c}) AS DOUBLE) AS min,
       CAST({_Q}({c}, 0.25) AS DOUBLE) AS p25, CAST({_Q}({c}, 0.5) AS DOUBLE) AS p50,
       CAST({_Q}({c}, 0.75) AS DOUBLE) AS p75, CAST(MAX({c}) AS DOUBLE) AS max FROM register"""
             for c in NUMERIC]
    return _w(_union(parts))


def _per_column(expr: str, name: str) -> str:
    return _w(_union([f"""SELECT '{c}' AS "column", {expr.format(c=c)} AS {name} FROM register"""
                      for c in COLS]))


_IQR = """
iq AS (SELECT quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM events),
bounds AS (SELECT q1, q3, q3 - q1 AS iqr, q1 - 1.5 * (q3 - q1) AS lower_bound,
                  q3 + 1.5 * (q3 - q1) AS upper_bound FROM iq)
"""

_FLOOR_DIV = "(({s}) - ((({s}) % ({n})) + ({n})) % ({n})) // ({n})"


def _group_mean(col: str, key: str, src: str, name: str) -> str:
    s = f"SUM(CAST(epoch_us({col}) AS HUGEINT))"
    n = f"NULLIF(COUNT({col}), 0)"
    return f"""{name} AS (
  SELECT {key}, make_timestamp(CAST({_FLOOR_DIV.format(s=s, n=n)} AS BIGINT)) AS mean
  FROM {src} WHERE {key} IS NOT NULL GROUP BY {key})"""


_PARSED = """
parsed AS (
  SELECT * REPLACE (try_strptime(reg_date, '%Y-%m-%d') AS reg_date) FROM register)
"""

def _clean(mktsegment: str) -> str:
    return _w(f"""
SELECT p.o_orderkey, p.o_custkey, p.o_orderstatus, p.o_totalprice,
       COALESCE(p.o_orderdate, g1.mean) AS o_orderdate,
       COALESCE(p.o_orderpriority, 'nodata') AS o_orderpriority,
       {mktsegment} AS c_mktsegment,
       COALESCE(p.c_acctbal, (SELECT quantile_cont(c_acctbal, 0.5) FROM parsed)) AS c_acctbal,
       COALESCE(p.reg_date, g2.mean) AS reg_date
FROM parsed p
LEFT JOIN g1 ON p.o_orderstatus = g1.o_orderstatus
LEFT JOIN g2 ON p.o_orderstatus = g2.o_orderstatus""",
        _PARSED, _group_mean("o_orderdate", "o_orderstatus", "parsed", "g1"),
        _group_mean("reg_date", "o_orderstatus", "parsed", "g2"))


CLEANING_SQL: dict[str, str] = {
    "csv_roundtrip": _w("SELECT * FROM register"),
    "csv_inferred": _w("""
SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice,
       strftime(o_orderdate, '%Y-%m-%d %H:%M:%S.%f') AS o_orderdate, o_orderpriority, c_mktsegment,
       c_acctbal, CAST(label_quality AS BIGINT) AS label_quality, NULLIF(reg_date, 'n/a') AS reg_date,
       (o_custkey % 9) || 'D' AS "store.code"
FROM register"""),
    "table_info": _w(_union([
        f"""SELECT {i} AS position, '{c}' AS "column", '{t}' AS dtype, COUNT({c}) AS non_null FROM register"""
        for i, (c, t) in enumerate(REGISTER_COLUMNS)])),
    "table_shape": _w("SELECT COUNT(*) AS n_rows, CAST(10 AS BIGINT) AS n_columns FROM register"),
    "head_rows": _w("SELECT * FROM register ORDER BY o_orderkey LIMIT 5"),
    "tail_rows": _w("SELECT * FROM (SELECT * FROM register ORDER BY o_orderkey DESC LIMIT 5) ORDER BY o_orderkey"),
    "describe": _describe(),
    "describe_datetime": _w("""
SELECT 'o_orderdate' AS "column", COUNT(us) AS count,
       make_timestamp(CAST((SUM(CAST(us AS HUGEINT)) - SUM(CAST(us AS HUGEINT)) % COUNT(us)) // COUNT(us) AS BIGINT)) AS mean,
       make_timestamp(MIN(us)) AS min,
       make_timestamp(CAST(floor(quantile_cont(us, 0.25)) AS BIGINT)) AS p25,
       make_timestamp(CAST(floor(quantile_cont(us, 0.5)) AS BIGINT)) AS p50,
       make_timestamp(CAST(floor(quantile_cont(us, 0.75)) AS BIGINT)) AS p75,
       make_timestamp(MAX(us)) AS max
FROM (SELECT epoch_us(o_orderdate) AS us FROM register)"""),
    "nunique": _per_column("COUNT(DISTINCT {c})", "nunique"),
    "value_counts": _w("""
SELECT o_orderpriority, COUNT(*) AS count FROM register WHERE o_orderpriority IS NOT NULL
GROUP BY 1 ORDER BY count DESC, o_orderpriority LIMIT 10"""),
    "modes": _w("""
SELECT c_mktsegment FROM (SELECT c_mktsegment, COUNT(*) AS n FROM register
                          WHERE c_mktsegment IS NOT NULL GROUP BY 1) v
WHERE n = (SELECT MAX(n) FROM (SELECT COUNT(*) AS n FROM register
                               WHERE c_mktsegment IS NOT NULL GROUP BY c_mktsegment))
ORDER BY c_mktsegment"""),
    "null_mask": _w("SELECT " + ", ".join(f"({c} IS NULL) AS {c}" for c in COLS) + " FROM register"),
    "rows_with_null": _w("SELECT * FROM register WHERE c_acctbal IS NULL"),
    "null_counts": _per_column("COUNT(*) - COUNT({c})", "n_missing"),
    "null_pct": _per_column(_half_even_pct("COUNT(*) - COUNT({c})", "COUNT(*)"), "missing_pct"),
    "null_pct_whole": _per_column(_half_even_pct("COUNT(*) - COUNT({c})", "COUNT(*)", 0), "missing_pct"),
    "duplicate_rows": """
SELECT doc_id, text, lang, source, n_chars FROM (
  SELECT *, row_number() OVER (PARTITION BY text, lang ORDER BY doc_id) AS rn FROM documents)
WHERE rn > 1""",
    "drop_duplicate_texts": "SELECT DISTINCT text, lang FROM documents",
    "indexed_rows": _w("""
SELECT 'head' AS part, row_no, o_orderstatus FROM indexed WHERE row_no < 5
UNION ALL SELECT 'tail', row_no, o_orderstatus FROM indexed, (SELECT MAX(row_no) AS last FROM indexed) WHERE row_no > last - 5
UNION ALL SELECT 'repeated', row_no, o_orderstatus FROM (
  SELECT *, row_number() OVER (PARTITION BY o_orderstatus, o_orderpriority, c_mktsegment ORDER BY row_no) AS rn FROM indexed)
WHERE rn > 1""", INDEXED),
    "indexed_null_map": _w("""
SELECT row_no * 20 // n AS bucket, COUNT(*) AS n_rows, """ + ", ".join(
        f"AVG(CASE WHEN {c} IS NULL{' OR reg_date = ' + chr(39) + 'n/a' + chr(39) if c == 'reg_date' else ''} THEN 1 ELSE 0 END) AS {c}"
        for c in COLS if c != "o_orderkey") + """
FROM indexed, (SELECT COUNT(*) AS n FROM indexed) GROUP BY 1""", INDEXED),
    "csv_quoted_lines": _digests("CASE WHEN text IN ({}) THEN NULL ELSE text END".format(
        ", ".join(f"'{t}'" for t in PANDAS_NA_TOKENS))),
    "csv_mysql_lines": _digests("text"),
    "csv_mysql": r"""
SELECT c_custkey,
       CASE c_custkey % 8 WHEN 0 THEN '' WHEN 1 THEN NULL WHEN 2 THEN 'NULL' WHEN 3 THEN NULL
            WHEN 4 THEN 'a "quoted" word' WHEN 5 THEN 'doubled " quote, comma' WHEN 6 THEN 'back\slash'
            ELSE c_name END AS note,
       CASE WHEN c_custkey % 5 > 1 THEN c_acctbal END AS c_acctbal, c_name
FROM customer""",
    "drop_duplicates": """
SELECT doc_id, text, lang, source, n_chars FROM (
  SELECT *, row_number() OVER (PARTITION BY text, lang ORDER BY doc_id) AS rn FROM documents)
WHERE rn = 1""",
    "categorical_value_counts": _w(_union([
        f"""SELECT '{c}' AS "column", CAST({c} AS VARCHAR) AS value, COUNT(*) AS count
FROM register WHERE {c} IS NOT NULL GROUP BY {c}""" for c in TEXT])),
    "boxplot_stats": "WITH " + _IQR.strip() + """
SELECT b.q1, (SELECT quantile_cont(value, 0.5) FROM events) AS median, b.q3,
       MIN(CASE WHEN e.value BETWEEN b.lower_bound AND b.upper_bound THEN e.value END) AS lower_whisker,
       MAX(CASE WHEN e.value BETWEEN b.lower_bound AND b.upper_bound THEN e.value END) AS upper_whisker,
       COUNT(CASE WHEN e.value IS NOT NULL AND NOT (e.value BETWEEN b.lower_bound AND b.upper_bound)
                  THEN 1 END) AS n_outliers
FROM events e, bounds b GROUP BY b.q1, b.q3""",
    "iqr_bounds": "WITH " + _IQR.strip() + """
SELECT (SELECT COUNT(value) FROM events) AS n_values, q1, q3, iqr, lower_bound, upper_bound FROM bounds""",
    "remove_outliers_iqr": "WITH " + _IQR.strip() + """
SELECT e.* FROM events e, bounds b WHERE e.value >= b.lower_bound AND e.value <= b.upper_bound""",
    "null_map": _w("""
SELECT CAST((((o_orderkey - k.lo) * 20) - (((o_orderkey - k.lo) * 20) % (k.hi - k.lo + 1))) // (k.hi - k.lo + 1) AS BIGINT) AS bucket,
       COUNT(*) AS n_rows, """ + ", ".join(
        f"AVG(CASE WHEN {c} IS NULL THEN 1 ELSE 0 END) AS {c}" for c in COLS if c != "o_orderkey") + """
FROM register, (SELECT MIN(o_orderkey) AS lo, MAX(o_orderkey) AS hi FROM register) k
GROUP BY 1"""),
    "drop_sparse_columns": "SELECT d.doc_id, d.text, d.lang, d.source, d.n_chars "
                           "FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id",
    "imputable_columns": "SELECT * FROM (" + _per_column(
        _half_even_pct("COUNT(*) - COUNT({c})", "COUNT(*)"), "missing_pct") +
        ") WHERE missing_pct > 0 AND missing_pct < 30",
    "impute_median": _w("SELECT * REPLACE (COALESCE(c_acctbal, (SELECT quantile_cont(c_acctbal, 0.5) "
                        "FROM register)) AS c_acctbal) FROM register"),
    "impute_mean": _w("SELECT * REPLACE (COALESCE(c_acctbal, (SELECT AVG(c_acctbal) FROM register)) AS c_acctbal, "
                      "COALESCE(o_totalprice, (SELECT AVG(o_totalprice) FROM register)) AS o_totalprice) "
                      "FROM register"),
    "impute_constant": _w("SELECT * REPLACE (COALESCE(o_orderpriority, 'nodata') AS o_orderpriority) FROM register"),
    "impute_mode": _w("""
SELECT * REPLACE (COALESCE(o_orderpriority, (
          SELECT o_orderpriority FROM register WHERE o_orderpriority IS NOT NULL
          GROUP BY 1 ORDER BY COUNT(*) DESC, o_orderpriority LIMIT 1)) AS o_orderpriority,
        COALESCE(c_mktsegment, (
          SELECT c_mktsegment FROM register WHERE c_mktsegment IS NOT NULL
          GROUP BY 1 ORDER BY COUNT(*) DESC, c_mktsegment LIMIT 1)) AS c_mktsegment)
FROM register"""),
    "parse_datetime": _w("SELECT * REPLACE (try_strptime(reg_date, '%Y-%m-%d') AS reg_date) FROM register"),
    "parse_datetime_found": _w("SELECT * REPLACE (try_strptime(reg_date, '%Y-%m-%d') AS reg_date) FROM register"),
    "null_map_text": _w("""
SELECT bucket, COUNT(*) AS n_rows, """ + ", ".join(
        f"AVG(CASE WHEN {c} IS NULL THEN 1 ELSE 0 END) AS {c}" for c in COLS if c != "reg_date") + """
FROM (SELECT *, CASE WHEN reg_date IS NOT NULL THEN
        (rank() OVER (ORDER BY reg_date NULLS LAST) - 1) * 20 // COUNT(reg_date) OVER () END AS bucket FROM register)
GROUP BY 1"""),
    "impute_group_mean_datetime": _w("""
SELECT r.* REPLACE (COALESCE(r.o_orderdate, g.mean) AS o_orderdate)
FROM register r LEFT JOIN g ON r.o_orderstatus = g.o_orderstatus""",
        _group_mean("o_orderdate", "o_orderstatus", "register", "g")),
    "clean_table": _clean("p.c_mktsegment"),
    "clean_csv": _clean("COALESCE(p.c_mktsegment, 'nodata')"),
}
