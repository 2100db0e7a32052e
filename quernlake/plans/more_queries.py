"""Registered queries of single operators and functions, and the same in DuckDB SQL.

Where test tables have no pages, recordings or answers, they are made of the columns of ``documents``, the same way on both sides.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType

from quernlake.functions import calendar, rates, redact, text
from quernlake.operators import answering, answers, benchmarks, catalog, corpus_store, drilldown, markdown, overview, quality, recordings, retrieval, star_schema
from quernlake.plans.queries import BEFORE, CATALOG_SQL, COHORT_SQL, DRILL_SQL, END, FACTS_SQL, MEASURES_SQL, MERCHANT, OWN_SQL, PERIOD, START, _merchants, _rounded, query, scope
from quernlake.plans.scope import default_range as latest_range
from quernlake.plans.scope import scope_metadata
from quernlake.plans.text_queries import _replaced_sql
from quernlake.sources.scratch import written
from quernlake.sources.testdata import SESSIONS_SQL, sessions, table, tries


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


# ---- loads and checks


@query("""WITH e AS (SELECT event_type, CASE WHEN event_type = 'click' THEN props ELSE CAST(ts AS VARCHAR) END AS t FROM events)
SELECT event_type, count(*) AS n, count(*) FILTER (WHERE TRY_CAST(t AS TIMESTAMP) IS NULL) AS bad, count(*) FILTER (WHERE t IS NOT NULL AND TRY_CAST(t AS TIMESTAMP) IS NULL) AS bad_optional FROM e GROUP BY 1""")
def time_validity(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("event_type", F.when(F.col("event_type") == "click", F.col("props")).otherwise(F.col("ts").cast("string")).alias("t"))
    return rows.groupBy("event_type").agg(F.count("*").alias("n"), F.count_if(quality.bad_time("t", True)).alias("bad"), F.count_if(quality.bad_time("t", False)).alias("bad_optional"))


def full_staging(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Staging rows with the columns that the star schema takes, from line items and orders."""
    lines, orders = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    as_text = lambda c: F.col(c).cast("string")
    none = {c: F.lit(None).cast("string") for c in ("switch_response_code", "issuer_bank_code", "payer_card_key", "verify_time_ms", "try_created_at", "verified_at")}
    return lines.join(orders, lines.l_orderkey == orders.o_orderkey).select(
        as_text("l_orderkey").alias("session_key"), as_text("l_linenumber").alias("try_seq"), (F.col("o_custkey") % 3).cast("string").alias("terminal_key"), as_text("o_custkey").alias("merchant_key"),
        F.col("o_orderpriority").alias("category_id"), F.col("o_orderpriority").alias("category_title"), F.floor("o_totalprice").cast("string").alias("amount"), F.lit("0").alias("adjusted_fee"),
        F.lit("Paid").alias("session_status"), F.lit("Manual").alias("verify_type"), F.col("l_returnflag").alias("try_status"), F.col("l_linestatus").alias("psp_code"), F.lit("5").alias("init_time_ms"),
        as_text("o_orderdate").alias("created_at"), as_text("o_orderdate").alias("expire_in"), as_text("l_shipdate").alias("settled_at"),
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias(quality.ROW), *[c.alias(n) for n, c in none.items()],
    )


@query("""WITH s AS (SELECT l_orderkey, o_custkey, o_custkey % 3 AS terminal, o_orderpriority, floor(o_totalprice) AS amount, CAST(l_shipdate AS TIMESTAMP) AS settled FROM lineitem JOIN orders ON l_orderkey = o_orderkey)
SELECT 'merchants' AS name, count(DISTINCT o_custkey) AS n, count(DISTINCT o_custkey) AS keys, CAST(0 AS BIGINT) AS amount FROM s
UNION ALL SELECT 'merchant_categories', count(DISTINCT o_orderpriority), count(DISTINCT o_orderpriority), 0 FROM s
UNION ALL SELECT 'terminals', count(DISTINCT (o_custkey, terminal)), count(DISTINCT (o_custkey, terminal)), 0 FROM s
UNION ALL SELECT 'payment_sessions', count(DISTINCT l_orderkey), count(DISTINCT l_orderkey), (SELECT CAST(sum(a) AS BIGINT) FROM (SELECT max(amount) AS a FROM s GROUP BY l_orderkey)) FROM s
UNION ALL SELECT 'payment_tries', count(*), count(DISTINCT l_orderkey), count(settled) FROM s""")
def star_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = star_schema.star_schema(full_staging(spark, sf_dir))
    zero = F.lit(0).cast("long")
    keys = {"merchants": ("merchant_id", zero), "merchant_categories": ("category_id", zero), "terminals": ("terminal_id", zero), "payment_sessions": ("session_id", F.sum("amount")), "payment_tries": ("session_id", F.count("settled_at"))}
    parts = [made[n].agg(F.count("*").alias("n"), F.count_distinct(k).alias("keys"), a.alias("amount")).select(F.lit(n).alias("name"), "n", "keys", "amount") for n, (k, a) in keys.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3]).unionByName(parts[4])


@query("""SELECT 'repeated' AS kind, CAST(coalesce(sum(n), 0) AS BIGINT) AS rows FROM (SELECT count(*) AS n FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1)
UNION ALL SELECT 'orphans', count(*) FROM labels l WHERE NOT EXISTS (SELECT 1 FROM documents d WHERE d.doc_id = l.doc_id)""")
def key_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    repeated = quality.repeated_keys(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"]).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("rows"))
    lone = quality.orphans(table(spark, sf_dir, "labels"), _docs(spark, sf_dir), ["doc_id"]).agg(F.count("*").alias("rows"))
    return repeated.select(F.lit("repeated").alias("kind"), "rows").unionByName(lone.select(F.lit("orphans").alias("kind"), "rows"))


# ---- metrics


@query(f"""{FACTS_SQL}, own AS (
  SELECT *, CASE WHEN created_at >= {START} THEN 'current' ELSE 'previous' END AS period FROM sessions LEFT JOIN stats USING (session_id)
  WHERE merchant_id = {MERCHANT} AND terminal_id = 1 AND created_at >= {BEFORE} AND created_at < {END}
) SELECT period, {MEASURES_SQL} FROM own GROUP BY period""")
def overview_terminal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overview.aggregates(scope(spark, sf_dir), PERIOD, 1).filter("sessions > 0")


@query(f"{CATALOG_SQL} SELECT * FROM catalog WHERE merchant_id IN (SELECT merchant_id FROM sessions WHERE category_id = 'services')")
def merchant_catalog_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.merchant_catalog(_merchants(spark, sf_dir), sessions(spark, sf_dir), tries(spark, sf_dir), category_id="services")


@query(f"{DRILL_SQL} SELECT count(*) AS total FROM drill WHERE session_status = 'Failed' AND max_try_seq >= 1")
def drilldown_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = drilldown.matching(scope(spark, sf_dir), PERIOD, drilldown.Filters(no_attempt=False, status="Failed"))
    return rows.agg(F.count("*").alias("total"))


@query(f"""{OWN_SQL}, one AS (SELECT * FROM own WHERE period = 'current' AND session_key = (SELECT min(session_key) FROM own WHERE period = 'current'))
SELECT session_key, amount, session_status, CAST((SELECT count(*) FROM tries t WHERE t.session_id = one.session_id AND try_seq >= 1) AS INTEGER) AS attempt_count FROM one""")
def transaction_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    mine = scope(spark, sf_dir)
    key = mine.in_range(PERIOD).agg(F.min("session_key")).first()[0]
    return drilldown.transaction(mine, key).select("session_key", "amount", "session_status", "attempt_count")


@query(f"WITH {SESSIONS_SQL} SELECT CAST(max(created_at) AS DATE) + 1 AS until, CAST(CAST(max(created_at) AS DATE) + 1 - INTERVAL 30 DAY AS DATE) AS since FROM sessions")
def default_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return latest_range(sessions(spark, sf_dir))


@query(f"""WITH {SESSIONS_SQL} SELECT DATE '2000-07-01' AS start, DATE '2001-07-01' AS "end", DATE '1999-07-02' AS previous_start, DATE '2000-07-01' AS previous_end, '[start, end)' AS interval, max(created_at) AS latest_data_at FROM sessions""")
def scope_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scope_metadata(sessions(spark, sf_dir), PERIOD).select("start", "end", "previous_start", "previous_end", "interval", "latest_data_at")


@query(f"""{COHORT_SQL}, seen AS (SELECT count(*) FILTER (WHERE merchant_id <> {MERCHANT}) AS peers, count(*) FILTER (WHERE merchant_id = {MERCHANT}) AS own FROM cohort)
SELECT own = 0 OR peers < 10 AS suppressed, CASE WHEN own = 0 OR peers < 10 THEN 'insufficient_cohort' ELSE '' END AS reason FROM seen""")
def benchmark_suppression(spark: SparkSession, sf_dir: str) -> DataFrame:
    return benchmarks.suppression(benchmarks.own_summary(scope(spark, sf_dir), PERIOD)).select("suppressed", F.coalesce("reason", F.lit("")).alias("reason"))


@query("""WITH y AS (
  SELECT y, 226895 + ((y - 1) // 33) * 12053 + ((y - 1) % 33) * 365 + len(list_filter([1, 5, 9, 13, 17, 22, 26, 30], lambda l: l <= (y - 1) % 33)) AS begins FROM range(1300, 1450) t(y)
), d AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS day, CAST(o_orderdate AS DATE) - DATE '0001-01-01' + 1 AS n FROM orders), r AS (
  SELECT day, y, n - begins AS rest FROM d ASOF JOIN y ON n >= begins
), m AS (SELECT *, CASE WHEN rest < 186 THEN rest // 31 ELSE 6 + (rest - 186) // 30 END AS m FROM r)
SELECT day, printf('%04d-%02d-%02d', y, m + 1, rest - (CASE WHEN m < 6 THEN m * 31 ELSE 186 + (m - 6) * 30 END) + 1) AS jalali, CAST(date_trunc('month', day) AS DATE) AS since, CAST(date_trunc('month', day) + INTERVAL 1 MONTH AS DATE) AS until FROM m""")
def calendar_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = table(spark, sf_dir, "orders").select(F.to_date("o_orderdate").alias("day")).distinct()
    first, after = calendar.gregorian_month(F.col("day"))
    return days.select("day", calendar.jalali_text("day").alias("jalali"), first.alias("since"), after.alias("until"))


@query(f"WITH {SESSIONS_SQL} SELECT DISTINCT category_id, CASE category_id WHEN 'goods' THEN 'Goods for sale' ELSE category_id END AS label FROM sessions")
def category_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.with_labels(sessions(spark, sf_dir).select("category_id").distinct(), {"goods": "Goods for sale"})


@query("""SELECT doc_id, round((n_chars - least(doc_id, n_chars)) * CAST(0.5 AS DOUBLE) + least(doc_id, n_chars) * CAST(0.125 AS DOUBLE) + 7 * CAST(2 AS DOUBLE), 6) AS price,
round(CAST(CASE WHEN lang = 'en' THEN 3 END AS DOUBLE), 6) AS billed FROM documents""")
def token_price(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = rates.price(F.col("n_chars"), F.col("doc_id"), F.lit(7), 0.5, 0.125, 2.0)
    billed = rates.price(F.lit(None).cast("long"), F.lit(0), F.lit(0), 1.0, 1.0, 1.0, F.when(F.col("lang") == "en", F.lit(3.0)))
    return _rounded(_docs(spark, sf_dir).select("doc_id", own.alias("price"), billed.alias("billed")))


@query("""SELECT CAST(sum(n_chars) AS BIGINT) AS prompt_tokens, CAST(sum(n_chars + 1) AS BIGINT) AS total_tokens, count(*) AS request_count, round(sum(n_chars / CAST(4 AS DOUBLE)), 3) AS latency_seconds, count(*) AS batches,
round(sum(n_chars + 1) * CAST(0.01 AS DOUBLE) / 1000000, 9) AS cost, round(sum(n_chars + 1) * CAST(0.01 AS DOUBLE) / 1000000 * 1000 / count(*), 9) AS per_thousand FROM documents""")
def embedding_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _docs(spark, sf_dir).select(F.col("n_chars").alias("prompt_tokens"), (F.col("n_chars") + 1).alias("total_tokens"), (F.col("n_chars") / 4.0).alias("latency_seconds"), F.lit(1).alias("request_count"))
    total = corpus_store.usage_totals(rows)
    cost, each = corpus_store.embedding_cost(F.col("total_tokens"), F.col("batches"), 0.01)
    return total.withColumn("latency_seconds", F.round("latency_seconds", 3)).withColumn("cost", F.round(cost, 9)).withColumn("per_thousand", F.round(each, 9))


# ---- questions and answers


@query(r"SELECT doc_id, regexp_matches(lower(text), '(^|[^\p{L}\p{N}\p{M}_])(and|des|\.net)($|[^\p{L}\p{N}\p{M}_])') OR contains(lower(text), 'é') AS named FROM documents")
def alias_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", answers.names(F.lower("text"), ("and", "des", ".net", "é")).alias("named"))


SURFACES = ("paas/django/a", "paas/laravel/b", "iaas/c", "ai/d", "dbaas/e", "references/f")
TOPIC_WORDS = ("deploy django", "vps", "openai", "redis", "nothing", "laravel s3")
#: Which pages may answer which question, worked out by hand: question by page.
MAY = ((1, 0, 0, 0, 0, 1), (1, 1, 1, 0, 1, 1), (1, 1, 1, 1, 1, 1), (1, 1, 1, 0, 1, 1), (1, 1, 1, 0, 1, 1), (0, 1, 0, 0, 0, 1))


@query(f"""SELECT doc_id, list_element([{', '.join(str(list(row)) for row in MAY)}], CAST(doc_id % 6 AS INTEGER) + 1)[CAST(doc_id // 6 % 6 AS INTEGER) + 1] = 1 AS kept FROM documents""")
def question_page_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    one_of = lambda values, at: F.element_at(F.array(*map(F.lit, values)), at.cast("int") + 1)
    asked, path = one_of(TOPIC_WORDS, F.col("doc_id") % 6), one_of(SURFACES, F.floor(F.col("doc_id") / 6) % 6)
    return _docs(spark, sf_dir).select("doc_id", answers.keep_for_question(asked, path).alias("kept"))


@query("""SELECT conv_id, turn, CASE turn % 3 WHEN 0 THEN 2 WHEN 1 THEN 2 ELSE 1 END AS n,
CASE turn % 3 WHEN 1 THEN 'Django WORKER TIMEOUT GUNICORN_TIMEOUT environment variable' ELSE 'turn ' || turn || CASE turn % 3 WHEN 0 THEN ' upload limit' ELSE '' END END AS first FROM conversations""")
def planned_by_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = F.concat(F.lit("turn "), F.col("turn").cast("string"), F.when(F.col("turn") % 3 == 0, " upload limit").when(F.col("turn") % 3 == 1, " Worker Timeout").otherwise(""))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.size(answers.planned_queries(asked)).alias("n"), answers.planned_queries(asked)[0].alias("first"))


@query("SELECT lang AS query_id, source AS cite_url, min(doc_id) AS position FROM documents GROUP BY 1, 2")
def first_per_url(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _docs(spark, sf_dir).select(F.col("lang").alias("query_id"), F.col("source").alias("cite_url"), F.col("doc_id").alias("position"))
    return retrieval.first_by(rows, "cite_url")


@query("""WITH c AS (SELECT conv_id, turn AS ord, CASE WHEN turn % 2 = 0 THEN upper(role) ELSE role END || (turn // 3) AS value FROM conversations), f AS (
  SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY conv_id, lower(value) ORDER BY ord) = 1
) SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY ord) <= 8""")
def profile_chips(spark: SparkSession, sf_dir: str) -> DataFrame:
    value = F.concat(F.when(F.col("turn") % 2 == 0, F.upper("role")).otherwise(F.col("role")), F.floor(F.col("turn") / 3).cast("string"))
    return answers.merged_chips(table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").alias("ord"), value.alias("value")))


@query("SELECT conv_id, turn, role, md5(substring(text, 1, 1500)) AS digest FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 6")
def recent_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return answers.recent_history(table(spark, sf_dir, "conversations")).select("conv_id", "turn", "role", F.md5("text").alias("digest"))


LINK_SQL = r"\bhttps?://[^\s<>()\]]+"
SAFE_SQL = f"regexp_replace({_replaced_sql('text')}, '(?i){LINK_SQL}', '{redact.LINK_PLACEHOLDER}', 'g')"


@query(f"SELECT doc_id, md5({SAFE_SQL}) AS digest, regexp_matches(text, '(?i){LINK_SQL}') AS linked FROM documents")
def sanitized_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", F.md5(redact.sanitize(F.col("text"))).alias("digest"), redact.has_raw_link(F.col("text")).alias("linked"))


@query(f"""WITH s AS (SELECT lang AS query_id, doc_id AS position, length({SAFE_SQL}) AS n FROM documents), r AS (
  SELECT *, sum(n) OVER (PARTITION BY query_id ORDER BY position) AS total, row_number() OVER (PARTITION BY query_id ORDER BY position) AS k FROM s
) SELECT query_id, position, 'S' || k AS source_id FROM r WHERE total <= 30000 OR k = 1""")
def bound_source_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _docs(spark, sf_dir).select(F.col("lang").alias("query_id"), F.col("doc_id").alias("position"), F.lit("p").alias("path"), "text")
    return answers.bound_sources(rows).select("query_id", "position", "source_id")


def _answers(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    docs = _docs(spark, sf_dir)
    told = F.concat(F.lit("# Head [[S1]]\nClaim of "), "source", F.lit(" [[S1]]\nNo marker\nWrong [[S2]]\nLink https://x.example/ [[S1]]\n```\ncode\n```"), F.when(F.col("doc_id") % 5 == 0, "\n[[NO_GROUNDING]]").otherwise(""))
    sources = docs.select(F.col("doc_id").alias("answer_id"), F.lit("S1").alias("source_id"), F.lit(4).alias("number"), F.concat(F.lit("https://d.example/"), F.col("doc_id").cast("string")).alias("cite_url"), (F.col("doc_id") % 3 == 0).alias("defective"))
    return docs.select(F.col("doc_id").alias("answer_id"), told.alias("text")), sources


@query("""SELECT doc_id AS answer_id, n, CASE n WHEN 0 THEN '# Head' WHEN 1 THEN 'Claim of ' || source || ' [4](https://d.example/' || doc_id || ')' WHEN 6 THEN 'code' ELSE '```' END AS line
FROM documents, (VALUES (0), (1), (5), (6), (7)) t(n) WHERE doc_id % 3 <> 0 AND doc_id % 5 <> 0""")
def gated_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return answers.citation_gate(*_answers(spark, sf_dir))


@query("SELECT doc_id AS answer_id, CASE WHEN doc_id % 5 = 0 THEN 'no_grounding' WHEN doc_id % 3 = 0 THEN 'no_citation' ELSE 'shown' END AS outcome FROM documents")
def gate_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return answers.gate_outcomes(*_answers(spark, sf_dir))


def _sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _docs(spark, sf_dir)
    return docs.select(
        F.col("lang").alias("query_id"), F.col("doc_id").alias("position"), F.concat("source", F.lit("#a:"), F.col("doc_id").cast("string")).alias("id"), F.col("source").alias("path"), F.col("source").alias("cite_url"),
        F.when(F.col("doc_id") % 2 == 0, F.array("lang", "source")).otherwise(F.array().cast("array<string>")).alias("heading_path"), (F.col("doc_id") % 4 == 0).alias("defective"),
    )


FIRST_SQL = "WITH f AS (SELECT lang AS query_id, source, min(doc_id) AS position FROM documents GROUP BY 1, 2)"


@query(f"{FIRST_SQL} SELECT query_id, position, CASE WHEN position % 4 = 0 THEN '⚠ ' ELSE '' END || source AS title, source AS cite_url, source || '#a' AS path FROM f")
def source_part_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return answering.source_parts(_sources(spark, sf_dir))


@query(f"{FIRST_SQL} SELECT query_id, position, CASE query_id WHEN 'en' THEN 'en ' ELSE 'fa ' END || source AS notice FROM f WHERE source <= 'm'")
def defect_notice_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _docs(spark, sf_dir)
    defects = docs.filter("source <= 'm'").select(F.col("source").alias("path"), F.concat(F.lit("fa "), "source").alias("fa"), F.concat(F.lit("en "), "source").alias("en")).distinct()
    questions = docs.select(F.col("lang").alias("query_id")).distinct().withColumn("query", F.when(F.col("query_id") == "en", "words").otherwise("سلام"))
    return answering.defect_notices(_sources(spark, sf_dir), defects, questions)


@query(rf"""WITH q AS (SELECT conv_id, max(turn) AS turn, arg_max(text, turn) AS query FROM conversations WHERE role = 'user' AND trim(text) <> '' GROUP BY 1), h AS (
  SELECT conv_id, role, {_replaced_sql('text')} AS content, row_number() OVER (PARTITION BY conv_id ORDER BY c.turn DESC) AS k
  FROM (SELECT conv_id, turn, role, trim(text) AS text FROM conversations WHERE role IN ('user', 'assistant') AND trim(text) <> '') c JOIN q USING (conv_id) WHERE c.turn < q.turn
)
SELECT q.conv_id AS query_id, CAST(1 + (SELECT count(*) FROM h WHERE h.conv_id = q.conv_id AND k <= 6) AS INTEGER) AS n,
md5('REQUIRED ANSWER LANGUAGE: ' || CASE WHEN regexp_matches(query, '[\x{{0600}}-\x{{06ff}}]') THEN 'Persian' ELSE 'English' END || '.' || chr(10) || 'Use that language for all prose even when retrieved sources use another language.' || chr(10) || chr(10)
|| 'ESTABLISHED CONTEXT (prefer examples matching it; it is not a source and supports no claim):' || chr(10) || '- turn: ' || turn || chr(10) || chr(10) || 'LATEST QUESTION:' || chr(10) || {_replaced_sql('query')} || chr(10) || chr(10) || 'RETRIEVED SOURCE BLOCKS:' || chr(10)) AS digest,
coalesce((SELECT md5(substring(content, 1, 1500)) FROM h WHERE h.conv_id = q.conv_id AND k = 1), '') AS before FROM q""")
def provider_message_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").withColumnRenamed("conv_id", "query_id")
    users = turns.filter("role = 'user' AND trim(text) <> ''").groupBy("query_id").agg(F.max_by(F.struct("turn", "text"), "turn").alias("q"))
    questions = users.select("query_id", "q.turn", F.col("q.text").alias("query"), F.array(F.struct(F.lit("turn").alias("kind"), F.col("q.turn").cast("string").alias("value"))).alias("profile"))
    none = _sources(spark, sf_dir).filter("false").withColumns({"source_id": F.lit(""), "safe_text": F.lit("")}).withColumn("query_id", F.lit(None).cast("long"))
    made = answering.provider_messages(turns, none, questions)
    last, before = F.element_at("messages", -1), F.try_element_at("messages", F.lit(-2))
    return made.select("query_id", F.size("messages").alias("n"), F.md5(last["content"]).alias("digest"), F.coalesce(F.md5(before["content"]), F.lit("")).alias("before"))


# ---- texts and pages


@query("SELECT doc_id, [source || ' ' || lang || '1', source || ' ' || lang || chr(8204) || '1'] AS variants FROM documents")
def query_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = F.concat(F.lit("  "), "source", F.lit("\t "), "lang", F.lit(text.ZWNJ), F.lit("۱ "))
    return _docs(spark, sf_dir).select("doc_id", text.query_variants(asked).alias("variants"))


@query(r"SELECT doc_id, len(regexp_extract_all(text, '([A-Za-z][A-Za-z0-9_./:@+-]*)', 1)) AS n, md5(array_to_string(regexp_extract_all(text, '([A-Za-z][A-Za-z0-9_./:@+-]*)', 1), ' ')) AS digest FROM documents")
def latin_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = text.latin_tokens(F.col("text"))
    return _docs(spark, sf_dir).select("doc_id", F.size(found).cast("long").alias("n"), F.md5(F.array_join(found, " ")).alias("digest"))


@query("SELECT doc_id, source || ' & <' || lang || '> \"é' AS plain, source || '/x#s' AS shown, '[a](https://h.example/b/' || source || ') [c](https://o.example/y) <img src=\"https://h.example/b/c/i.png\">' AS linked FROM documents")
def text_rewrites(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = F.concat("source", F.lit(" &amp; &lt;"), "lang", F.lit("&gt; &quot;&#233;"))
    page = F.concat(F.lit("[a](../"), "source", F.lit(') [c](https://o.example/y) <img src="i.png">'))
    chunk = F.concat("source", F.lit("/x#s:"), F.col("doc_id").cast("string"))
    return _docs(spark, sf_dir).select("doc_id", text.html_unescape(coded).alias("plain"), text.display_path(chunk).alias("shown"), text.rewrite_links(page, F.lit("https://h.example/b/c/")).alias("linked"))


@F.pandas_udf(DoubleType())
def _entropy(values: pd.Series) -> pd.Series:
    return values.map(redact.entropy)


@query("""WITH s AS (SELECT DISTINCT source FROM documents), c AS (SELECT source, length(source) AS n, substring(source, CAST(i AS BIGINT), 1) AS c FROM s, range(1, 200) t(i) WHERE i <= length(source)), k AS (
  SELECT source, n, c, count(*) / CAST(n AS DOUBLE) AS p FROM c GROUP BY 1, 2, 3
) SELECT source, round(-sum(p * log2(p)), 9) + 0 AS bits FROM k GROUP BY 1""")
def source_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("source").distinct().select("source", (F.round(_entropy("source"), 9) + 0.0).alias("bits"))


@F.pandas_udf(StringType())
def _language(labels: pd.Series, bodies: pd.Series) -> pd.Series:
    shell = markdown.shell_pattern()
    return pd.Series([markdown.sniff_language(a, b, shell) for a, b in zip(labels, bodies, strict=True)])


@query("""SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'json' WHEN 1 THEN 'bash' WHEN 2 THEN CASE WHEN event_type = 'json' THEN 'text' ELSE event_type END ELSE 'bash' END AS language FROM events""")
def fence_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("event_id") % 4
    body = F.when(kind == 0, F.col("props")).when(kind == 1, F.concat(F.lit("\n#!/opt/any "), "event_type")).when(kind == 2, F.concat(F.lit("plain "), "event_type")).otherwise(F.concat(F.lit("$ curl "), "event_type"))
    return table(spark, sf_dir, "events").select("event_id", _language(F.concat(F.lit("{"), "event_type", F.lit("}")), body).alias("language"))


def _mdx(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("doc_id").cast("string")
    page = F.concat(
        F.lit("<p>About "), "source", F.lit('</p>{/* <Section id="no" title="T"> */}<Section id="a'), key, F.lit('" title="T"><p>Run <b>it</b></p><Asciinema id="one" /></Section>'),
        F.lit("<Section id='b"), key, F.lit("' title='T'><Asciinema id=\"two\" /></Section>"),
    )
    return _docs(spark, sf_dir).select(key.alias("path"), page.alias("text"))


def _mirror(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("doc_id").cast("string")
    page = F.concat(F.lit("Original link: https://d.example/"), key, F.lit("\n# Top\nfirst words\n## `T`\nrun alpha "), "source", F.lit("\n```\n# no heading\n```\n### Sub\nx\n## T\nshow beta\n## All links\ny"))
    return _docs(spark, sf_dir).select(key.alias("path"), page.alias("text"))


@query("""SELECT CAST(doc_id AS VARCHAR) AS path, n, level, title, crumbs, CASE n WHEN 10 THEN 'b' || doc_id WHEN 3 THEN 'a' || doc_id WHEN 8 THEN 'a' || doc_id END AS anchor, n = 12 AS dropped
FROM documents, (VALUES (1, 1, 'Top', 'Top'), (3, 2, '`T`', 'Top > `T`'), (8, 3, 'Sub', 'Top > `T` > Sub'), (10, 2, 'T', 'Top > T'), (12, 2, 'All links', 'Top > All links')) t(n, level, title, crumbs)""")
def heading_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = markdown.headings(markdown.lines_of(_mirror(spark, sf_dir)), markdown.section_anchors(_mdx(spark, sf_dir)))
    return found.select("path", "n", "level", "title", F.array_join("heading_path", " > ").alias("crumbs"), "anchor", "dropped")


@query("""SELECT CAST(doc_id AS VARCHAR) AS path, id AS cast_id, 'Run it' AS context, scope || doc_id AS anchor_scope FROM documents, (VALUES ('one', 'a'), ('two', 'b')) t(id, scope)""")
def recording_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recordings.references(_mdx(spark, sf_dir)).drop("ord")


@query("""SELECT CAST(doc_id AS VARCHAR) AS path, section, told AS text FROM documents, (VALUES (3, 'run alpha'), (10, 'show beta')) t(section, told)""")
def recording_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    commands = spark.createDataFrame([("one", 0, "run alpha"), ("two", 0, "show beta")], "cast_id string, ord int, command string")
    mdx = _mdx(spark, sf_dir)
    return recordings.attach(markdown.sections(_mirror(spark, sf_dir), mdx), recordings.references(mdx), commands).drop("ord")


@query("""SELECT t.fence AS text, count(*) AS n FROM documents, (VALUES ('# no heading')) t(fence) GROUP BY 1""")
def page_fence_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return markdown.page_fences(_mirror(spark, sf_dir)).groupBy("text").agg(F.count("*").alias("n"))


@query()
def retrieve_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions of all conversations against the documents as chunks; vectors are digests, which SQL does not have."""
    docs = _docs(spark, sf_dir).select(F.col("doc_id").cast("string").alias("id"), F.concat("lang", F.lit("/"), F.col("source")).alias("path"), F.col("text").alias("text_norm"))
    vectors = corpus_store.embed(docs.select("id", "text_norm"), corpus_store.hash_embedder(32), 32, "id", "text_norm")
    asked = table(spark, sf_dir, "conversations").filter("role = 'user'").groupBy("conv_id").agg(F.max_by("text", "turn").alias("query"))
    chunks = written(docs.join(vectors, "id"), "retrieve-chunks")  # both legs read them
    found = answering.retrieve(chunks, asked.select(F.col("conv_id").alias("query_id"), "query"), corpus_store.hash_embedder(32), 32, retrieval.TOP_K)
    return found.withColumn("score", F.round("score", 9)).fillna(0, ["dense_rank", "lexical_rank"])
