"""The registered queries of the payment model, and the same in DuckDB SQL.

The star-schema test tables stand in for payments (see sources.testdata); the merchant and the window are fixed.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quernlake.operators import benchmarks, catalog, drilldown, facts, overview, quality, registry, star_schema
from quernlake.plans.scope import Range, Scope
from quernlake.sources.testdata import SESSIONS_SQL, TRIES_SQL, sessions, table, tries

MERCHANT = 0
PERIOD = Range(datetime(2000, 7, 1), datetime(2001, 7, 1))
START, END, BEFORE = "TIMESTAMP '2000-07-01'", "TIMESTAMP '2001-07-01'", "TIMESTAMP '1999-07-02'"
Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a query under its function's name, with its SQL if there is one."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def scope(spark: SparkSession, sf_dir: str) -> Scope:
    return Scope(sessions(spark, sf_dir), tries(spark, sf_dir), MERCHANT)


def _rounded(df: DataFrame, places: int = 6) -> DataFrame:
    return df.select(*[F.round(c, places).alias(c) if t == "double" else F.col(f"`{c}`").alias(c) for c, t in df.dtypes])


STATS_SQL = """
stats AS (
  SELECT session_id, CAST(max(try_seq) AS INTEGER) AS max_try_seq, count(*) FILTER (WHERE try_seq >= 1) AS attempt_count,
         CAST(max(CASE WHEN try_seq = 0 THEN 1 ELSE 0 END) AS INTEGER) AS no_attempt
  FROM tries GROUP BY session_id
)"""
FACTS_SQL = f"WITH {SESSIONS_SQL}, {TRIES_SQL}, {STATS_SQL}"
MEASURES_SQL = """
         count(*) AS sessions, CAST(coalesce(sum(amount), 0) AS BIGINT) AS amount, CAST(coalesce(sum(adjusted_fee), 0) AS BIGINT) AS fee,
         count(*) FILTER (WHERE session_status = 'Failed') AS failed, count(*) FILTER (WHERE session_status IN ('Verified', 'Paid')) AS success,
         count(*) FILTER (WHERE no_attempt = 1) AS no_attempt, count(*) FILTER (WHERE max_try_seq >= 1) AS attempted, count(*) FILTER (WHERE max_try_seq > 1) AS retry,
         count(*) FILTER (WHERE session_status = 'Failed' AND no_attempt = 1) AS failed_no_attempt,
         CAST(coalesce(sum(amount) FILTER (WHERE session_status = 'Failed' AND no_attempt = 1), 0) AS BIGINT) AS failed_no_attempt_amount"""
OWN_SQL = f"""{FACTS_SQL}, own AS (
  SELECT *, CASE WHEN created_at >= {START} THEN 'current' ELSE 'previous' END AS period
  FROM sessions LEFT JOIN stats USING (session_id) WHERE merchant_id = {MERCHANT} AND created_at >= {BEFORE} AND created_at < {END}
)"""
SUMS_SQL = f"""{OWN_SQL}, found AS (
  SELECT period, {MEASURES_SQL} FROM own GROUP BY period
), sums AS (
  SELECT p.period, {', '.join(f'coalesce(f.{m}, 0) AS {m}' for m in facts.MEASURES)} FROM (VALUES ('current'), ('previous')) p(period) LEFT JOIN found f USING (period)
)"""
WIDE_SQL = f"""{SUMS_SQL}, wide AS (
  SELECT {', '.join(f"c.{m} AS c_{m}, p.{m} AS p_{m}" for m in facts.MEASURES)} FROM sums c, sums p WHERE c.period = 'current' AND p.period = 'previous'
)"""


@query(f"{FACTS_SQL} SELECT * FROM stats")
def attempt_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facts.attempt_stats(tries(spark, sf_dir))


@query(f"{SUMS_SQL} SELECT * FROM sums")
def overview_aggregates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overview.aggregates(scope(spark, sf_dir), PERIOD)


def _metric_sql(name: str, value: str, previous: str, sample: str, part: str = "NULL", whole: str = "NULL") -> str:
    return f"SELECT '{name}' AS metric_id, 'session' AS grain, round({value}, 6) AS value, round({previous}, 6) AS previous, round({value} - {previous}, 6) AS change, CAST({part} AS DOUBLE) AS numerator, CAST({whole} AS DOUBLE) AS denominator, {sample} AS sample_size FROM wide"


def _rate_sql(name: str, part: str, whole: str) -> str:
    rate = lambda p: f"(CAST({p}_{part} AS DOUBLE) / nullif({p}_{whole}, 0))"
    return _metric_sql(name, rate("c"), rate("p"), f"c_{whole}", f"c_{part}", f"c_{whole}")


def _count_sql(name: str, column: str) -> str:
    return _metric_sql(name, f"CAST(c_{column} AS DOUBLE)", f"CAST(p_{column} AS DOUBLE)", "c_sessions")


METRICS_SQL = " UNION ALL ".join([
    _count_sql("sessions.created", "sessions"), _count_sql("amount.requested", "amount"), _rate_sql("sessions.failed_rate", "failed", "sessions"), _rate_sql("sessions.verified_rate", "success", "sessions"),
    _rate_sql("sessions.no_attempt_rate", "no_attempt", "sessions"), _rate_sql("sessions.retry_rate", "retry", "attempted"), _count_sql("fees.adjusted", "fee"),
])


@query(f"{WIDE_SQL} {METRICS_SQL}")
def overview_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = overview.overview_metrics(overview.aggregates(scope(spark, sf_dir), PERIOD))
    return _rounded(rows.withColumns({c: F.col(c).cast("double") for c in ("numerator", "denominator")}))


DAILY_SQL = f"""{OWN_SQL}, daily AS (
  SELECT CAST(CAST(created_at AS DATE) AS VARCHAR) AS day, {', '.join(f"count(*) FILTER (WHERE session_status = '{s}') AS {s.lower()}" for s in ('Failed', 'Paid', 'Reversed', 'Verified'))}
  FROM own WHERE period = 'current' GROUP BY 1
)"""


@query(f"{DAILY_SQL} SELECT * FROM daily")
def daily_status_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overview.daily_status(scope(spark, sf_dir), PERIOD).withColumn("day", F.col("day").cast("string"))


@query(f"{DAILY_SQL} SELECT day, total, {', '.join(f'round({s} / greatest(CAST(total AS DOUBLE), 1), 6) AS {s}_share' for s in ('failed', 'paid', 'reversed', 'verified'))} FROM (SELECT *, failed + paid + reversed + verified AS total FROM daily)")
def daily_status_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(overview.status_shares(daily_status_pivot(spark, sf_dir)))


PERFORMANCE_SQL = f"""{OWN_SQL}, performance AS (
  SELECT period, psp_code, count(*) AS sample_size, count(*) FILTER (WHERE try_status = 'Failed') AS failed, count(*) FILTER (WHERE try_status = 'Verified') AS verified,
         count(*) FILTER (WHERE try_status = 'Paid') AS paid, count(*) FILTER (WHERE try_status = 'Reversed') AS reversed, count(*) FILTER (WHERE try_status = 'InBank') AS in_bank,
         count(init_time_ms) AS with_latency, percentile_cont(0.5) WITHIN GROUP (ORDER BY init_time_ms) AS p50, percentile_cont(0.95) WITHIN GROUP (ORDER BY init_time_ms) AS p95
  FROM tries JOIN own USING (session_id) WHERE try_seq >= 1 GROUP BY period, psp_code
)"""


@query(f"{PERFORMANCE_SQL} SELECT psp_code, sample_size, failed, verified, paid, reversed, in_bank FROM performance WHERE period = 'current'")
def psp_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overview.psp_outcomes(overview.performance(scope(spark, sf_dir), PERIOD))


@query(f"""{PERFORMANCE_SQL} SELECT c.psp_code, c.sample_size, c.sample_size - c.with_latency AS missing, round(c.p50, 6) AS p50, round(c.p95, 6) AS p95, round(p.p50, 6) AS previous_p50, round(p.p95, 6) AS previous_p95
FROM (SELECT * FROM performance WHERE period = 'current') c LEFT JOIN (SELECT * FROM performance WHERE period = 'previous') p ON c.psp_code IS NOT DISTINCT FROM p.psp_code""")
def latency_current_previous(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(overview.latency(overview.performance(scope(spark, sf_dir), PERIOD)))


@query(f"{WIDE_SQL} SELECT c_failed_no_attempt AS no_attempt, greatest(0, c_failed - c_failed_no_attempt) AS attempted, c_failed AS total_failed FROM wide")
def failure_contribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overview.failure_contribution(overview.aggregates(scope(spark, sf_dir), PERIOD))


SIGNAL_SQL = f"""{WIDE_SQL}, rates AS (
  SELECT *, CAST(c_no_attempt AS DOUBLE) / nullif(c_sessions, 0) AS rate, CAST(p_no_attempt AS DOUBLE) / nullif(p_sessions, 0) AS before FROM wide
), signal AS (
  SELECT *, (rate - before) * 100 AS points, greatest(0, CAST(round_even(c_no_attempt - coalesce(c_sessions * before, c_no_attempt), 0) AS BIGINT)) AS excess FROM rates
), told AS (
  SELECT *, coalesce(points >= 5 AND excess >= 20, false) AS alert FROM signal
)"""


@query(f"""{SIGNAL_SQL} SELECT CASE WHEN alert THEN 'no_attempt_increase' ELSE 'no_attempt_summary' END AS kind, CASE WHEN alert THEN 'warning' ELSE 'neutral' END AS severity,
round(rate, 6) AS current_rate, round(before, 6) AS previous_rate, round(points, 6) AS change_pp, excess AS excess_sessions, c_failed_no_attempt_amount AS affected_amount, 'no_attempt=true&status=Failed' AS drilldown_query FROM told""")
def no_attempt_signal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(overview.insight(overview.aggregates(scope(spark, sf_dir), PERIOD)))


@query(f"""{OWN_SQL} SELECT count(*) AS sessions, count(settled) AS settled, round(CAST(count(settled) AS DOUBLE) / nullif(count(*), 0), 6) AS settled_rate
FROM own LEFT JOIN (SELECT DISTINCT session_id, 1 AS settled FROM tries WHERE try_seq >= 1 AND settled_at IS NOT NULL) USING (session_id) WHERE period = 'current'""")
def settled_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(overview.extra_metrics(scope(spark, sf_dir), PERIOD))


@query(f"{OWN_SQL} SELECT psp_code AS code, count(*) AS attempts, count(DISTINCT session_id) AS sessions FROM tries JOIN own USING (session_id) WHERE period = 'current' AND try_seq >= 1 AND try_status = 'Failed' GROUP BY 1")
def failures_by_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overview.failures_by_code(scope(spark, sf_dir), PERIOD, "psp_code")


COHORT_SQL = f"""{FACTS_SQL}, chosen AS (
  SELECT * FROM sessions LEFT JOIN stats USING (session_id) WHERE category_id = 'goods' AND created_at >= {START} AND created_at < {END}
), sums AS (
  SELECT merchant_id, {MEASURES_SQL} FROM chosen GROUP BY merchant_id HAVING count(*) >= 30
), slow AS (
  SELECT merchant_id, percentile_cont(0.95) WITHIN GROUP (ORDER BY init_time_ms) AS p95 FROM tries JOIN chosen USING (session_id) WHERE try_seq >= 1 AND init_time_ms IS NOT NULL GROUP BY merchant_id
), cohort AS (
  SELECT merchant_id, sessions, CAST(failed AS DOUBLE) / sessions AS failed_rate, CAST(no_attempt AS DOUBLE) / sessions AS no_attempt_rate,
         coalesce(CAST(retry AS DOUBLE) / nullif(attempted, 0), 0) AS retry_rate, CAST(success AS DOUBLE) / sessions AS verified_rate, p95
  FROM sums LEFT JOIN slow USING (merchant_id)
)"""


@query(f'{COHORT_SQL} SELECT merchant_id, sessions, round(failed_rate, 6) AS "sessions.failed_rate", round(no_attempt_rate, 6) AS "sessions.no_attempt_rate", round(retry_rate, 6) AS "sessions.retry_rate", round(verified_rate, 6) AS "sessions.verified_rate", round(p95, 6) AS "latency.init_p95" FROM cohort')
def benchmark_cohort(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = benchmarks.cohort(sessions(spark, sf_dir), tries(spark, sf_dir), "goods", PERIOD)
    return rows.select(*[F.round(f"`{c}`", 6).alias(c) if t == "double" else F.col(c) for c, t in rows.dtypes])


@query(f"""{COHORT_SQL}, long AS (
  SELECT merchant_id, 'sessions.failed_rate' AS metric_id, failed_rate AS value, 'lower' AS direction FROM cohort UNION ALL
  SELECT merchant_id, 'sessions.no_attempt_rate', no_attempt_rate, 'lower' FROM cohort UNION ALL SELECT merchant_id, 'sessions.retry_rate', retry_rate, 'lower' FROM cohort UNION ALL
  SELECT merchant_id, 'sessions.verified_rate', verified_rate, 'higher' FROM cohort UNION ALL SELECT merchant_id, 'latency.init_p95', p95, 'lower' FROM cohort WHERE p95 IS NOT NULL
), mine AS (SELECT metric_id, value AS selected_value FROM long WHERE merchant_id = {MERCHANT}), sums2 AS (
  SELECT l.metric_id, direction, selected_value, percentile_cont(0.25) WITHIN GROUP (ORDER BY value) AS q1, percentile_cont(0.5) WITHIN GROUP (ORDER BY value) AS median,
         percentile_cont(0.75) WITHIN GROUP (ORDER BY value) AS q3, avg(CASE WHEN (direction = 'lower' AND value >= selected_value) OR (direction = 'higher' AND value <= selected_value) THEN 1.0 ELSE 0.0 END) AS percentile, count(*) AS cohort_size
  FROM long l JOIN mine USING (metric_id) WHERE merchant_id <> {MERCHANT} GROUP BY 1, 2, 3 HAVING count(*) >= 10
)
SELECT metric_id, direction, round(selected_value, 6) AS selected_value, round(q1, 6) AS q1, round(median, 6) AS median, round(q3, 6) AS q3, round(CAST(percentile AS DOUBLE), 6) AS percentile, cohort_size,
       CASE WHEN direction = 'lower' THEN selected_value > q3 ELSE selected_value < q1 END AS outside_iqr, round(abs(selected_value - median), 6) AS gap FROM sums2""")
def benchmark_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(benchmarks.summary(benchmarks.cohort(sessions(spark, sf_dir), tries(spark, sf_dir), "goods", PERIOD), MERCHANT))


DRILL_SQL = f"""{OWN_SQL}, lasts AS (
  SELECT session_id, arg_max(ifnull(psp_code, '~'), try_seq) AS last_psp FROM tries WHERE try_seq >= 1 GROUP BY session_id
), drill AS (
  SELECT session_id, session_key, created_at, terminal_id, amount, session_status, coalesce(attempt_count, 0) AS attempt_count, nullif(last_psp, '~') AS last_psp, coalesce(no_attempt, 0) = 1 AS no_attempt, max_try_seq
  FROM own LEFT JOIN lasts USING (session_id) WHERE period = 'current'
)"""
DRILL_COLUMNS = "session_key, created_at, terminal_id, amount, session_status, attempt_count, last_psp, no_attempt"


@query(f"{DRILL_SQL} SELECT {DRILL_COLUMNS} FROM drill WHERE max_try_seq >= 1 ORDER BY amount DESC, session_key LIMIT 25 OFFSET 25")
def drilldown_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    filters = drilldown.Filters(no_attempt=False, sort=drilldown.Sort.AMOUNT, page=2)
    return drilldown.page(drilldown.matching(scope(spark, sf_dir), PERIOD, filters), filters)


@query(f"""{OWN_SQL} SELECT session_key, created_at, terminal_id, amount, session_status, CAST(0 AS BIGINT) AS attempt_count, CAST(NULL AS VARCHAR) AS last_psp, true AS no_attempt
FROM own JOIN tries USING (session_id) WHERE period = 'current' AND session_status = 'Failed' AND try_seq = 0 AND try_status = 'NoAttempt'""")
def drilldown_no_attempt_fast(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drilldown.matching(scope(spark, sf_dir), PERIOD, drilldown.Filters(no_attempt=True, status="Failed"))


@query(f"""{DRILL_SQL} SELECT {DRILL_COLUMNS} FROM drill WHERE EXISTS (SELECT 1 FROM tries t WHERE t.session_id = drill.session_id AND t.psp_code = 'PSP-03')
AND EXISTS (SELECT 1 FROM tries t WHERE t.session_id = drill.session_id AND t.try_status = 'Failed')""")
def drilldown_exists_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drilldown.matching(scope(spark, sf_dir), PERIOD, drilldown.Filters(psp="PSP-03", attempt_status="Failed"))


@query(f"""{OWN_SQL} SELECT session_key, amount, session_status, CAST(count(*) FILTER (WHERE try_seq >= 1) AS INTEGER) AS attempt_count, count(*) FILTER (WHERE try_seq >= 1) = 0 AS no_attempt,
CAST(count(t.session_id) AS INTEGER) AS rows, string_agg(try_seq || ':' || try_status, ',' ORDER BY try_seq) AS attempts
FROM own LEFT JOIN tries t USING (session_id) WHERE period = 'current' GROUP BY session_id, session_key, amount, session_status""")
def transaction_detail(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = drilldown.details(scope(spark, sf_dir).in_range(PERIOD), tries(spark, sf_dir))
    told = F.array_join(F.transform("attempts", lambda a: F.concat_ws(":", a["try_seq"], a["try_status"])), ",")
    return found.select("session_key", "amount", "session_status", "attempt_count", "no_attempt", F.size("attempts").alias("rows"), F.nullif(told, F.lit("")).alias("attempts"))


def _merchants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("merchant_id"), F.col("n_name").alias("merchant_key"))


CATALOG_SQL = f"""WITH {SESSIONS_SQL}, {TRIES_SQL}, catalog AS (
  SELECT CAST(n_nationkey AS BIGINT) AS merchant_id, n_name AS merchant_key, coalesce(session_count, 0) AS session_count, first_activity, last_activity, coalesce(terminal_count, 0) AS terminal_count,
         CAST(coalesce(attempt_count, 0) AS BIGINT) AS attempt_count
  FROM nation
  LEFT JOIN (SELECT merchant_id, count(*) AS session_count, min(created_at) AS first_activity, max(created_at) AS last_activity, count(DISTINCT terminal_id) AS terminal_count FROM sessions GROUP BY 1) s ON merchant_id = n_nationkey
  LEFT JOIN (SELECT merchant_id AS m, count(*) AS attempt_count FROM tries JOIN sessions USING (session_id) WHERE try_seq >= 1 GROUP BY 1) a ON m = n_nationkey
)"""


@query(f"{CATALOG_SQL} SELECT * FROM catalog")
def merchant_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.merchant_catalog(_merchants(spark, sf_dir), sessions(spark, sf_dir), tries(spark, sf_dir))


@query(f"{CATALOG_SQL} SELECT * FROM catalog ORDER BY last_activity DESC NULLS LAST, merchant_key LIMIT 10 OFFSET 10")
def merchant_catalog_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.catalog_page(merchant_catalog(spark, sf_dir), catalog.CatalogSort.LAST_ACTIVITY, True, 2, 10)


@query(f"{CATALOG_SQL} SELECT * FROM catalog WHERE contains(lower(merchant_key), 'a')")
def merchant_search_escape(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.merchant_catalog(_merchants(spark, sf_dir), sessions(spark, sf_dir), tries(spark, sf_dir), " A ")


@query(f"WITH {SESSIONS_SQL} SELECT merchant_id, string_agg(DISTINCT category_id, ',' ORDER BY category_id) AS categories FROM sessions GROUP BY 1")
def merchant_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    titles = spark.createDataFrame([("goods", "Goods"), ("services", "Services")], "category_id string, category_title string")
    rows = catalog.merchant_categories(sessions(spark, sf_dir), titles)
    return rows.select("merchant_id", F.array_join(F.transform("categories", lambda c: c["category_id"]), ",").alias("categories"))


@query("SELECT o_custkey, o_orderkey, o_orderpriority FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS rn FROM orders) WHERE rn = 1")
def distinct_on_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = star_schema.first_per_key(table(spark, sf_dir, "orders"), ["o_custkey"], ["o_orderdate", "o_orderkey"])
    return first.select("o_custkey", "o_orderkey", "o_orderpriority")


def staging(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Staging rows of the line items (all text), numbered by key order; attempts repeat where line numbers do."""
    lines, orders = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    text = lambda c: F.col(c).cast("string")
    return lines.join(orders, lines.l_orderkey == orders.o_orderkey).select(
        text("l_orderkey").alias("session_key"), text("l_linenumber").alias("try_seq"), text("l_suppkey").alias("terminal_key"), text("o_custkey").alias("merchant_key"), F.col("o_orderpriority").alias("category_id"),
        F.col("o_orderstatus").alias("session_status"), F.concat(F.col("l_returnflag"), F.col("l_linestatus")).alias("category_title"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias(quality.ROW),
    )


STAGING_SQL = """WITH staging AS (
  SELECT CAST(l_orderkey AS VARCHAR) AS session_key, CAST(l_linenumber AS SMALLINT) AS try_seq, CAST(l_suppkey AS VARCHAR) AS terminal_key, o_orderpriority AS category_id, o_orderstatus AS session_status,
         l_returnflag || l_linestatus AS category_title, l_orderkey * 8 + l_linenumber AS rn FROM lineitem JOIN orders ON l_orderkey = o_orderkey
)"""


@query(f"{STAGING_SQL} SELECT session_key, try_seq, min(rn) AS first_row, count(*) AS n FROM staging GROUP BY 1, 2 HAVING count(*) > 1")
def dup_key_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.duplicate_attempts(staging(spark, sf_dir))


@query(f"{STAGING_SQL} SELECT session_key, min(rn) AS first_row FROM staging GROUP BY 1 HAVING count(DISTINCT (terminal_key, session_status)) > 1")
def session_invariant_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.varying_sessions(staging(spark, sf_dir), ["terminal_key", "session_status"])


@query(f"{STAGING_SQL} SELECT category_id, min(rn) AS first_row FROM staging GROUP BY 1 HAVING count(DISTINCT category_title) > 1")
def category_title_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.varying_titles(staging(spark, sf_dir))


@query("""WITH e AS (SELECT event_id AS rn, event_type, CAST(value AS VARCHAR) AS v, props FROM events)
SELECT 'blank_props' AS rule, coalesce(min(rn) FILTER (WHERE nullif(trim(props), '') IS NULL), -1) AS first_row, count(*) FILTER (WHERE nullif(trim(props), '') IS NULL) AS broken_rows FROM e
UNION ALL SELECT 'type', coalesce(min(rn) FILTER (WHERE event_type NOT IN ('click', 'view')), -1), count(*) FILTER (WHERE event_type NOT IN ('click', 'view')) FROM e
UNION ALL SELECT 'small', coalesce(min(rn) FILTER (WHERE TRY_CAST(rn AS SMALLINT) IS NULL), -1), count(*) FILTER (WHERE TRY_CAST(rn AS SMALLINT) IS NULL) FROM e""")
def row_validations(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").withColumn(quality.ROW, F.col("event_id")).withColumn("id_text", F.col("event_id").cast("string"))
    rules = [
        quality.RowRule("blank_props", "blank", quality.blank("props")), quality.RowRule("type", "unknown type", ~F.col("event_type").isin("click", "view")),
        quality.RowRule("small", "no small number", quality.bad_integer("id_text", "smallint", True)),
    ]
    return quality.first_violations(rows, rules).fillna(-1, ["first_row"])


NO_ZONE = "'Timestamps have no zone; the declared zone is Asia/Tehran.'"
REGISTRY_ROWS = (
    ("sessions.created", "session", "count distinct session_key", False, ""), ("amount.requested", "session", "sum amount once per session", False, ""),
    ("sessions.failed_rate", "session", "Failed sessions / created sessions", False, ""),
    ("sessions.verified_rate", "session", "Verified or Paid sessions / created sessions", True, "'Verified and Paid are combined until their business distinction is confirmed.', "),
    ("sessions.no_attempt_rate", "session", "sessions with no PSP attempt / created sessions", False, ""), ("sessions.retry_rate", "session", "sessions with max try_seq > 1 / sessions with a PSP attempt", True, ""),
    ("fees.adjusted", "session", "sum adjusted_fee once per session", True, "'Charging semantics are unconfirmed.', "),
    ("benchmarks.category_equal_weighted", "merchant", "median and IQR across eligible same-category merchants, one vote each", True, "'At least 30 sessions per peer and 10 peers are required.', "),
    ("attempts.processed", "attempt", "attempts with try_seq >= 1", True, ""), ("sessions.settled_rate", "session", "sessions with a settled attempt / created sessions", True, ""),
    ("latency.verify", "attempt", "p50 and p95 of verify_time_ms where present", True, ""), ("failures.by_code", "attempt", "failed attempts by switch_response_code", True, ""),
)
REGISTRY_SQL = " UNION ALL ".join(f"SELECT '1.0.0' AS version, '{m}' AS metric_id, '{g}' AS grain, '{f}' AS formula, 'created_at' AS time_field, {p} AS proposed, [{limits}{NO_ZONE}] AS limitations" for m, g, f, p, limits in REGISTRY_ROWS)


@query(f"""WITH {SESSIONS_SQL}, {TRIES_SQL}, contracts AS ({REGISTRY_SQL}), held AS (
  SELECT 'session' AS grain, count(*) AS rows, max(created_at) AS latest FROM sessions UNION ALL SELECT 'merchant', count(DISTINCT merchant_id), max(created_at) FROM sessions
  UNION ALL SELECT 'attempt', count(*), max(s.created_at) FROM tries t JOIN sessions s USING (session_id) WHERE t.try_seq >= 1
) SELECT * FROM contracts LEFT JOIN held USING (grain)""")
def metric_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return registry.registry_in_use(spark, sessions(spark, sf_dir), tries(spark, sf_dir))
