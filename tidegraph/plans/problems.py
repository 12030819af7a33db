"""Queries pN_ of the general problems and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegraph.operators.grid import coverage_check, missing_sessions
from tidegraph.operators.packed import split_packed
from tidegraph.operators.snapshot_diff import issuer_changes
from tidegraph.operators.spikes import suspect_readings
from tidegraph.operators.versions import all_versions
from tidegraph.sources.tables import table

PACKED_FIELDS = (
    ("ipc_composition_history", "history_id", "tickers"),
    ("ipc_turnover_by_ticker", "turnover_id", "tickers_added"),
    ("ipc_turnover_by_ticker", "turnover_id", "tickers_dropped"),
    ("data_provenance", "provenance_id", "source_tickers"),
)


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return all_versions(table(spark, sf_dir, "ipc_composition_history"), table(spark, sf_dir, "ipc_corporate_actions"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suspect_readings(table(spark, sf_dir, "cell_016"), table(spark, sf_dir, "data_provenance")).select("reading_id").distinct()


def p2_impossible(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The suspect readings that break the physical limit."""
    rows = suspect_readings(table(spark, sf_dir, "cell_016"), table(spark, sf_dir, "data_provenance"))
    return rows.where("reason = 'impossible'").select("reading_id").distinct()


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return missing_sessions(table(spark, sf_dir, "cell_016"), table(spark, sf_dir, "market_sessions"))


def p3_coverage_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coverage_check(table(spark, sf_dir, "cell_016"), table(spark, sf_dir, "market_sessions"), table(spark, sf_dir, "ticker_coverage"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    changes = issuer_changes(table(spark, sf_dir, "ipc_composition_history"), table(spark, sf_dir, "ipc_issuer_aliases"))
    return changes.withColumn("period_end", F.col("period_end").cast("string"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = None
    for name, row_id, packed in PACKED_FIELDS:
        rows = split_packed(table(spark, sf_dir, name), row_id, packed).select(F.lit(f"{name}.{packed}").alias("field"), "row_id", "pos", "value")
        parts = rows if parts is None else parts.unionByName(rows)
    return parts


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (p1_found, p2_found, p2_impossible, p3_found, p3_coverage_check, p4_found, p5_found)}

_BLANK = r"[\s\x{00A0}\x{2000}-\x{200A}\x{202F}\x{205F}\x{3000}\x{FEFF}]"


def _values(source: str, row_id: str, packed: str, extra: str = "") -> str:
    """SQL for ``row_id, pos, value`` of a packed field."""
    trimmed = f"regexp_replace({packed}, '^{_BLANK}+|{_BLANK}+$', '', 'g')"
    bare = f"CASE WHEN regexp_matches({trimmed}, '^(\\[.*\\]|\\(.*\\)|\\{{.*\\}})$', 's') THEN {trimmed}[2:-2] ELSE {trimmed} END"
    parted = f"regexp_replace({bare}, '^/+|/+$|[{_BLANK[1:-1]};,|]/+|/+[{_BLANK[1:-1]};,|]', ';', 'g')"
    token = "\"(?:[^\"]|\"\")*\"|''(?:[^'']|'''')*''|[^;,|\\t\\n\\r\"''\\s\\x{00A0}][^;,|\\t\\n\\r]*"
    bound = f"regexp_replace(v, '^{_BLANK}+|{_BLANK}+$', '', 'g')"
    double = "WHEN v[1] = chr(34) THEN replace(v[2:-2], chr(34) || chr(34), chr(34))"
    single = "WHEN v[1] = chr(39) THEN replace(v[2:-2], chr(39) || chr(39), chr(39))"
    unquoted = f"CASE {double} {single} ELSE {bound} END"
    return f"""SELECT {extra}row_id, pos, {unquoted} AS value FROM (
      SELECT {extra}row_id, unnest(parts) AS v, generate_subscripts(parts, 1) AS pos FROM (
        SELECT {extra}{row_id} AS row_id, regexp_extract_all({parted}, '{token}') AS parts FROM {source} WHERE {packed} IS NOT NULL))"""


_SNAPSHOTS = f"""told AS (SELECT * FROM ipc_composition_history WHERE regexp_matches(tickers, '[^\\s\\x{{00A0}}]') AND effective_date IS NOT NULL),
snap AS (SELECT index_code, effective_date, history_id, tickers, row_number() OVER (PARTITION BY index_code ORDER BY effective_date) AS n,
   lead(effective_date) OVER (PARTITION BY index_code ORDER BY effective_date) AS next_date
   FROM (SELECT *, row_number() OVER (PARTITION BY index_code, effective_date ORDER BY received_at DESC NULLS LAST, history_id DESC) AS r FROM told) WHERE r = 1),
vals AS ({_values("snap", "history_id", "tickers")}),
members AS (SELECT DISTINCT s.index_code, s.n, s.effective_date, s.next_date, v.value AS ticker FROM snap s JOIN vals v ON s.history_id = v.row_id)"""

_EVENT = r"trim(regexp_replace(lower(event), '[\s\x{00A0}_\-]+', ' ', 'g'))"

_GRID = """cal AS (SELECT session_date, row_number() OVER (ORDER BY session_date) AS ord FROM market_sessions WHERE is_open),
days AS (SELECT DISTINCT run_id, ticker, ord FROM cell_016 JOIN cal ON CAST(fecha AS DATE) = session_date WHERE adjclose > 0 AND NOT isnan(adjclose)),
span AS (SELECT run_id, ticker, min(ord) AS a, max(ord) AS b, count(*) AS n FROM days GROUP BY ALL)"""

SQL: dict[str, str] = {
    "p1_found": f"""WITH {_SNAPSHOTS},
isl AS (SELECT *, n - row_number() OVER (PARTITION BY index_code, ticker ORDER BY n) AS g FROM members),
notices AS (SELECT index_code, issuer_id, {_EVENT} AS attribute, effective_date, lower(trim(new_value)) AS v FROM (
  SELECT *, row_number() OVER (PARTITION BY index_code, issuer_id, {_EVENT}, effective_date ORDER BY recorded_at DESC NULLS LAST, action_id DESC) AS r
  FROM ipc_corporate_actions WHERE effective_date IS NOT NULL AND trim(new_value) <> '') WHERE r = 1),
starts AS (SELECT * FROM (SELECT *, v IS DISTINCT FROM lag(v) OVER w OR lag(effective_date) OVER w IS NULL AS isnew FROM notices WINDOW w AS (PARTITION BY index_code, issuer_id, attribute ORDER BY effective_date)) WHERE isnew)
SELECT index_code, ticker AS entity, 'membership' AS attribute, CAST(min(effective_date) AS VARCHAR) AS valid_from,
  coalesce(CAST(arg_max(next_date, n) FILTER (WHERE true) AS VARCHAR), CASE WHEN bool_or(next_date IS NULL) THEN '9999-12-31' END) AS valid_to
FROM (SELECT * FROM isl) GROUP BY index_code, ticker, g HAVING NOT bool_or(next_date IS NULL)
UNION ALL SELECT index_code, ticker, 'membership', CAST(min(effective_date) AS VARCHAR), '9999-12-31' FROM isl GROUP BY index_code, ticker, g HAVING bool_or(next_date IS NULL)
UNION ALL SELECT index_code, issuer_id, attribute, CAST(effective_date AS VARCHAR),
  coalesce(CAST(lead(effective_date) OVER (PARTITION BY index_code, issuer_id, attribute ORDER BY effective_date) AS VARCHAR), '9999-12-31') FROM starts""",
    "p2_impossible": "SELECT DISTINCT reading_id FROM cell_016 WHERE adjclose <= 0 AND NOT isnan(adjclose) AND reading_id IS NOT NULL",
    "p3_found": f"""WITH {_GRID} SELECT s.run_id, s.ticker, CAST(c.session_date AS VARCHAR) AS session_day FROM span s JOIN cal c ON c.ord BETWEEN s.a AND s.b
ANTI JOIN days d ON d.run_id = s.run_id AND d.ticker = s.ticker AND d.ord = c.ord""",
    "p3_coverage_check": f"""WITH {_GRID}, told AS (SELECT run_id, ticker, max(n_valid_days) AS n_declared FROM ticker_coverage GROUP BY ALL)
SELECT coalesce(t.run_id, s.run_id) AS run_id, coalesce(t.ticker, s.ticker) AS ticker, n_declared, coalesce(n, 0) AS n_counted, coalesce(b - a + 1 - n, 0) AS n_missing,
  coalesce(n_declared = coalesce(n, 0), false) AS agrees FROM told t FULL JOIN span s ON t.run_id = s.run_id AND t.ticker = s.ticker""",
    "p4_found": f"""WITH {_SNAPSHOTS},
al AS (SELECT ticker, min(issuer_id) AS issuer_id FROM ipc_issuer_aliases GROUP BY 1),
iss AS (SELECT index_code, n, effective_date, next_date, coalesce(al.issuer_id, m.ticker) AS issuer_id, list_sort(list(m.ticker)) AS t FROM members m LEFT JOIN al ON m.ticker = al.ticker GROUP BY ALL),
cur AS (SELECT index_code, n, effective_date AS period_end, issuer_id, t FROM iss WHERE n > 1),
prev AS (SELECT index_code, n + 1 AS n, next_date AS period_end, issuer_id, t FROM iss WHERE next_date IS NOT NULL)
SELECT index_code, CAST(period_end AS VARCHAR) AS period_end, issuer_id, CASE WHEN p.t IS NULL THEN 'added' WHEN c.t IS NULL THEN 'removed' ELSE 'changed' END AS change_kind
FROM cur c FULL JOIN prev p USING (index_code, n, period_end, issuer_id) WHERE p.t IS DISTINCT FROM c.t""",
    "p5_found": " UNION ALL ".join(f"SELECT '{name}.{packed}' AS field, * FROM ({_values(name, row_id, packed)})" for name, row_id, packed in PACKED_FIELDS),
}
