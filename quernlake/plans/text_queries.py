"""The registered queries of the corpus and retrieval model, and the same in DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quernlake.functions import redact, text
from quernlake.operators import answers, corpus_store, lexical_index, markdown, retrieval, vector_index
from quernlake.plans.queries import query
from quernlake.sources.scratch import shared_path
from quernlake.sources.testdata import table
from quernlake.streaming import incremental


def _sql_list(words: tuple[str, ...]) -> str:
    return "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + "]"


@query(r"SELECT doc_id, CAST(greatest(1, ceil(CAST(3.45 AS DOUBLE) * len(regexp_extract_all(text, '\S+')))) AS INTEGER) AS tokens FROM documents")
def token_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", text.estimate_tokens(F.col("text")).alias("tokens"))


@query(r"""WITH t AS (SELECT source, CAST(greatest(1, ceil(CAST(3.45 AS DOUBLE) * len(regexp_extract_all(text, '\S+')))) AS INTEGER) AS tokens FROM documents)
SELECT source, min(tokens) AS least, percentile_disc(0.5) WITHIN GROUP (ORDER BY tokens) AS p50, percentile_disc(0.9) WITHIN GROUP (ORDER BY tokens) AS p90, max(tokens) AS most FROM t GROUP BY source""")
def token_percentiles_nearest_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("source", text.estimate_tokens(F.col("text")).alias("tokens"))
    at = lambda p: F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY tokens)").cast("int")
    return rows.groupBy("source").agg(F.min("tokens").alias("least"), at(0.5).alias("p50"), at(0.9).alias("p90"), F.max("tokens").alias("most"))


@query(r"SELECT doc_id, regexp_matches(text, '[\x{0600}-\x{06ff}]') AS arabic, CASE WHEN regexp_matches(regexp_extract(text, '([\x{0600}-\x{06ff}A-Za-z])', 1), '[\x{0600}-\x{06ff}]') THEN 'rtl' ELSE 'ltr' END AS direction FROM documents")
def script_detection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", text.has_arabic_script(F.col("text")).alias("arabic"), text.direction(F.col("text")).alias("direction"))


EDGE_SQL = "'" + retrieval.EDGE_PUNCTUATION.replace("'", "''") + "'"


@query(rf"""SELECT conv_id, turn, array_to_string(list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> '' AND lower(trim(w, {EDGE_SQL})) <> '' AND NOT list_contains({_sql_list(retrieval.STOP_WORDS)}, lower(trim(w, {EDGE_SQL})))), ' OR ') AS query
FROM conversations WHERE role = 'user'""")
def stopword_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").filter("role = 'user'").select("conv_id", "turn", retrieval.or_query(F.col("text")).alias("query"))


LEXEMES_SQL = r"list_filter(regexp_split_to_array(lower({}), '[^\p{{L}}\p{{N}}]+'), lambda w: w <> '')"
RANKED_SQL = rf"""WITH asked AS (
  SELECT conv_id * 1000 + turn AS query_id, list_filter(regexp_split_to_array(text, '\s+'), lambda w: w <> '' AND lower(trim(w, {EDGE_SQL})) <> '' AND NOT list_contains({_sql_list(retrieval.STOP_WORDS)}, lower(trim(w, {EDGE_SQL})))) AS words
  FROM conversations WHERE role = 'user'
), terms AS (SELECT DISTINCT query_id, {LEXEMES_SQL.format("w")} AS term FROM (SELECT query_id, unnest(words) AS w FROM asked)
), places AS (SELECT query_id, term, len(term) AS size, unnest(term) AS lexeme, generate_subscripts(term, 1) AS place FROM terms WHERE len(term) > 0
), wanted AS (SELECT DISTINCT lexeme FROM places
), texts AS (SELECT doc_id, {LEXEMES_SQL.format("text")} AS words FROM documents
), positions AS (SELECT doc_id, unnest(words) AS lexeme, generate_subscripts(words, 1) AS pos FROM texts
), held AS (SELECT * FROM positions SEMI JOIN wanted USING (lexeme)
), single AS (SELECT query_id, doc_id, sum(n) AS n FROM (SELECT doc_id, lexeme, count(*) AS n FROM held GROUP BY 1, 2) JOIN places USING (lexeme) WHERE size = 1 GROUP BY 1, 2
), several AS (SELECT query_id, doc_id, count(*) AS n FROM (SELECT query_id, term, doc_id, pos - place FROM held JOIN places USING (lexeme) WHERE size > 1 GROUP BY query_id, term, size, doc_id, pos - place HAVING count(*) = size) GROUP BY 1, 2
), scored AS (SELECT query_id, doc_id AS id, sum(n) AS n FROM (SELECT * FROM single UNION ALL SELECT * FROM several) GROUP BY 1, 2)
SELECT query_id, id, round(n * CAST(0.1 AS DOUBLE), 6) AS score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY n DESC, id) AS INTEGER) AS rank FROM scored QUALIFY rank <= 50"""


def _user_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").filter("role = 'user'").select((F.col("conv_id") * 1000 + F.col("turn")).alias("query_id"), F.col("text").alias("query"))


@query(RANKED_SQL)
def lexical_or_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = retrieval.lexical_search(table(spark, sf_dir, "documents"), _user_questions(spark, sf_dir), key="doc_id")
    return found.withColumn("score", F.round("score", 6))


@query(RANKED_SQL)
def lexical_index_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_path(spark, "lexical-index")
    lexical_index.build(table(spark, sf_dir, "documents"), path, "doc_id")
    return lexical_index.search(spark, path, _user_questions(spark, sf_dir)).withColumn("score", F.round("score", 6))


@query("""WITH d AS (SELECT q.vec_id AS query_id, c.vec_id AS id, 1 - list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(c.embedding AS DOUBLE[])) AS distance FROM embeddings q, embeddings c WHERE q.vec_id % 100 = 0)
SELECT query_id, id, round(distance, 5) AS distance, CAST(row_number() OVER (PARTITION BY query_id ORDER BY distance, id) AS INTEGER) AS rank FROM d QUALIFY rank <= 10""")
def dense_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    asked = vectors.filter("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    found = retrieval.dense_search(vectors, asked, 10, "vec_id")
    # distances of a vector to itself differ from 0 by rounding alone
    return found.withColumn("distance", F.round(F.col("distance"), 5) + F.lit(0.0))


@query("""WITH d AS (SELECT q.vec_id // 200 AS query_id, c.vec_id AS id, min(1 - list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(c.embedding AS DOUBLE[]))) AS distance FROM embeddings q, embeddings c WHERE q.vec_id % 100 = 0 GROUP BY 1, 2)
SELECT query_id, id, round(distance, 5) AS distance, CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(distance, 9), id) AS INTEGER) AS rank FROM d QUALIFY rank <= 20""")
def dense_multi_variant(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    asked = vectors.filter("vec_id % 100 = 0").select(F.expr("vec_id div 200").alias("query_id"), "embedding")
    found = retrieval.dense_search(vectors, asked, 40, "vec_id").withColumn("distance", F.round("distance", 9))
    again = retrieval.ranked(found.drop("rank"), 20, F.col("distance"), F.col("id"))
    return again.withColumn("distance", F.round("distance", 5) + F.lit(0.0))


@query()
def vector_index_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors, path = table(spark, sf_dir, "embeddings"), shared_path(spark, "vector-index")
    vector_index.build(vectors, path, "vec_id")
    return vector_index.search(spark, path, vectors.filter("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "embedding"), 10)


def _leg(rows: DataFrame, *order) -> DataFrame:  # noqa: ANN002
    return retrieval.ranked(rows, 50, *order).select("query_id", "id", "rank")


LEGS_SQL = """WITH dense AS (
  SELECT lang AS query_id, doc_id AS id, row_number() OVER (PARTITION BY lang ORDER BY n_chars DESC, doc_id) AS r FROM documents QUALIFY r <= 50
), lexical AS (
  SELECT lang AS query_id, doc_id AS id, row_number() OVER (PARTITION BY lang ORDER BY n_chars % 1000 DESC, doc_id) AS r FROM documents QUALIFY r <= 50
)"""


def _legs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows = table(spark, sf_dir, "documents").select(F.col("lang").alias("query_id"), F.col("doc_id").alias("id"), "n_chars")
    return _leg(rows, F.desc("n_chars"), F.col("id")), _leg(rows, F.desc(F.col("n_chars") % 1000), F.col("id"))


@query(f"""{LEGS_SQL}, fused AS (
  SELECT query_id, id, d.r AS dr, l.r AS lr, coalesce(CAST(0.7 AS DOUBLE) / (60 + d.r), 0) + coalesce(CAST(0.3 AS DOUBLE) / (60 + l.r), 0) AS score FROM dense d FULL JOIN lexical l USING (query_id, id)
)
SELECT query_id, id, round(score, 9) AS score, CAST(coalesce(dr, 0) AS INTEGER) AS dense_rank, CAST(coalesce(lr, 0) AS INTEGER) AS lexical_rank,
       CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, least(coalesce(dr, lr), coalesce(lr, dr)), id) AS INTEGER) AS rank FROM fused QUALIFY rank <= 12""")
def rrf_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.fuse(*_legs(spark, sf_dir)).withColumn("score", F.round("score", 9)).fillna(0, ["dense_rank", "lexical_rank"])


@query(f"""{LEGS_SQL}, runs AS (SELECT query_id, id, r, 0 AS run FROM dense UNION ALL SELECT query_id, id, r, 1 FROM lexical), firsts AS (
  SELECT *, row_number() OVER (PARTITION BY query_id, id ORDER BY r, run) AS n FROM runs QUALIFY n = 1
)
SELECT query_id, id, run, CAST(row_number() OVER (PARTITION BY query_id ORDER BY r, run) AS INTEGER) AS position FROM firsts QUALIFY position <= 12""")
def interleave_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    dense, lexical = _legs(spark, sf_dir)
    return retrieval.interleave(dense.withColumn("run", F.lit(0)).unionByName(lexical.withColumn("run", F.lit(1))))


@query("""SELECT query_id, id, size FROM (
  SELECT lang AS query_id, doc_id AS id, n_chars AS size, sum(n_chars) OVER (PARTITION BY lang ORDER BY doc_id ROWS UNBOUNDED PRECEDING) AS s, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS n FROM documents
) WHERE s <= 30000 OR n = 1""")
def context_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select(F.col("lang").alias("query_id"), F.col("doc_id").alias("id"), F.col("n_chars").alias("size"))
    return retrieval.within_budget(rows, F.col("size"), order="id")


@query("""WITH f AS (SELECT lang, doc_id, source, min(doc_id) OVER (PARTITION BY lang, source) AS first FROM documents)
SELECT lang AS query_id, doc_id AS position, source AS cite_url, CAST(dense_rank() OVER (PARTITION BY lang ORDER BY first) AS INTEGER) AS number FROM f""")
def citation_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select(F.col("lang").alias("query_id"), F.col("doc_id").alias("position"), F.col("source").alias("cite_url"))
    return retrieval.citation_numbers(rows)


@query("SELECT lang AS query_id, count(*) AS sources, count(DISTINCT source) AS pages, count(*) FILTER (WHERE n_chars < 500) AS defects FROM documents GROUP BY 1")
def evidence_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select(F.col("lang").alias("query_id"), F.col("source").alias("path"), (F.col("n_chars") < 500).alias("defective"))
    return retrieval.evidence_summary(rows)


@query("""WITH c AS (SELECT lang, source, count(*) AS n, min(doc_id) AS first FROM documents GROUP BY 1, 2)
SELECT lang, source, n FROM c QUALIFY row_number() OVER (PARTITION BY lang ORDER BY n DESC, first) = 1""")
def top_platform_by_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.top_value(table(spark, sf_dir, "documents"), "lang", "source", "doc_id")


def _replaced_sql(column: str) -> str:
    out = column
    for pattern, replacement in redact.SERVING:
        plain = pattern.replace("(?!<REDACTED_CREDENTIAL>)", "").replace("'", "''")
        out = f"regexp_replace({out}, '{plain}', '{replacement.replace('$1', chr(92) + '1')}', 'g')"
    return out


@query(f"SELECT doc_id, md5({_replaced_sql('text')}) AS digest, {_replaced_sql('text')} <> text AS changed FROM documents")
def serving_redaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    safe = redact.redact_serving(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(safe).alias("digest"), (safe != F.col("text")).alias("changed"))


@query()
def ingest_redaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", redact.redact_ingest(F.col("text")).alias("r"))
    return rows.select("doc_id", F.md5("r.text").alias("digest"), F.aggregate(F.map_values("r.counts"), F.lit(0), lambda a, b: a + b).alias("redactions"))


@query()
def normalize_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(text.normalize(F.col("text"))).alias("digest"))


def _as_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    head = F.concat(F.lit("Original link: https://docs.example.org/"), F.col("doc_id").cast("string"), F.lit("\n# "), F.col("source"), F.lit("\n\n## "), F.col("lang"), F.lit("\n"))
    return table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("path"), F.concat(head, F.col("text")).alias("text"))


@query()
def chunk_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = markdown.chunks(_as_pages(spark, sf_dir), commit="test")
    return made.select("id", "path", "cite_url", F.array_join("heading_path", " > ").alias("headings"), "token_estimate", F.md5("text").alias("digest"))


@query()
def corpus_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return markdown.build_summary(markdown.chunks(_as_pages(spark, sf_dir), commit="test"))


@query("SELECT key AS leaf, count(*) AS frequency FROM (SELECT unnest(json_keys(props)) AS key FROM events WHERE json_valid(props)) GROUP BY 1")
def json_leaf_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select(F.col("event_type").alias("path"), F.col("props").alias("text"))
    return markdown.manifest(rows, None).select("leaf", "frequency")


@query()
def link_rewrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "pages")
    return rows.select("page_id", F.md5(text.rewrite_links(F.col("html"), F.col("url"))).alias("digest"))


@query("SELECT conv_id, max(turn) AS turn, arg_max(text, turn) AS text FROM conversations WHERE role = 'user' GROUP BY 1")
def latest_user_turn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return answers.latest_user_turn(table(spark, sf_dir, "conversations"))


@query(f"""WITH u AS (SELECT conv_id, turn, trim(text) AS text, lag(trim(text)) OVER (PARTITION BY conv_id ORDER BY turn) AS previous FROM conversations WHERE role = 'user' AND trim(text) <> '')
SELECT conv_id, turn, coalesce(previous, '') AS previous, length(lower(text)) <= 140 AND ({' OR '.join(f"starts_with(lower(text), '{s}')" for s in answers.FOLLOW_UP_STARTS)} OR {' OR '.join(f"contains(lower(text), '{s}')" for s in answers.FOLLOW_UP_TOKENS)}) AS follow_up FROM u""")
def followup_previous_turn(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = answers.user_turns(table(spark, sf_dir, "conversations"))
    return rows.select("conv_id", "turn", F.coalesce("previous", F.lit("")).alias("previous"), answers.is_follow_up(F.col("text")).alias("follow_up"))


@query("""WITH old AS (SELECT doc_id AS id, text, doc_id * 10 AS embedding FROM documents WHERE doc_id % 3 <> 0), new AS (
  SELECT doc_id AS id, CASE WHEN doc_id % 5 = 0 THEN text || '!' ELSE text END AS text FROM documents WHERE doc_id % 2 = 0 OR doc_id % 3 = 0
)
SELECT coalesce(n.id, o.id) AS id, md5(CASE WHEN n.id IS NULL THEN o.text ELSE n.text END) AS digest, coalesce(CASE WHEN n.id IS NULL OR o.text = n.text THEN o.embedding END, -1) AS embedding FROM old o FULL JOIN new n ON o.id = n.id""")
def upsert_invalidate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    old = docs.filter("id % 3 <> 0").withColumn("embedding", F.col("id") * 10)
    new = docs.filter("id % 2 = 0 OR id % 3 = 0").withColumn("text", F.when(F.col("id") % 5 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text")))
    merged = corpus_store.upsert(old, new, watched=["text"])
    return merged.select("id", F.md5("text").alias("digest"), F.coalesce("embedding", F.lit(-1)).alias("embedding"))


@query("SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS day, event_type AS kind, count(*) AS n FROM events GROUP BY 1, 2")
def events_daily_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return incremental.daily_counts(table(spark, sf_dir, "events"), "ts", "event_type").withColumn("day", F.col("day").cast("string"))


@query("""WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS opens FROM events),
s AS (SELECT user_id, ts, sum(opens) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM g)
SELECT user_id AS user, count(DISTINCT k) AS sessions, count(*) AS events FROM s GROUP BY 1""")
def events_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = incremental.sessions_of(table(spark, sf_dir, "events"), "ts", "user_id")
    return rows.groupBy("user").agg(F.count("*").alias("sessions"), F.sum("n").alias("events"))


@query("SELECT CAST(doc_id AS VARCHAR) AS id, 16 AS dimension, CAST(1 AS DOUBLE) AS norm FROM documents")
def embed_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("id"), F.array("source").alias("heading_path"), "text", F.lit(None).cast("array<float>").alias("embedding"))
    done = corpus_store.embed_missing(rows, corpus_store.hash_embedder(16), 16)
    return done.select("id", F.size("embedding").alias("dimension"), F.round(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x * x), 4).alias("norm"))
