"""Operator 4: mixing sources to target weights by a low-discrepancy schedule, with DataFrame functions only.

The mix is cut into slots of equally many tokens.  Slot i takes the golden-ratio point frac(i * 0.618...), and the source
whose cumulative target weight holds that point fills it; slots are ranked per source.  Each source's documents are
shuffled (by a digest), laid end to end, twice over, and cut into blocks of a slot's size; the k-th slot of a source
joins its k-th block.  What a document gives to the mix is the part of it that lies in taken blocks.  A source ends at its
target: the slot that passes it is cut there, and what slots leave, less than a slot or two, is one last part after them; so
a source smaller than a slot has its words, too, at any size of the mix.

Nothing is ordered in one task: positions within a source come from sums over PREFIXES digest buckets and windows inside
single buckets, slot ranks from counts over runs of slots, so a source with a third of all rows spreads like any other.
Only tables of one row per source, or per source and bucket, are ever brought together.

Targets: sources in code-point order, null last, weigh 3, 1, 2, 3, 1, 2...; they share 150 % of all tokens by weight; a
target stops at twice its source's size, and the excess is shared again by weight until none is above.

Defined cases: a null text has no tokens and gives none; null sources are one source; an empty table gives an empty
result; repeated rows each take their own place (rows alike in every column may swap places, which no result shows);
extra columns are dropped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quernlake.llm.common import fresh_name, written

WEIGHTS = (3, 1, 2)
SHARE, MOST = 1.5, 2
#: The mix has this many slots at most (as many as tokens where it has fewer); a slot of one token is the smallest.
SLOTS = 1 << 17
#: Copies of a document that are made in one place.
COPIES = 1000
#: Digest buckets of a source (three hexadecimal digits), and slots of a run whose counts are summed.
PREFIX_DIGITS, RUN = 3, 1 << 10
#: Cells of the unit interval in which points look for their source.
CELLS = 1 << 12
GOLDEN = 0.6180339887498949


def token_count(text: Column) -> Column:
    """Number of runs of bytes other than ASCII white space; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: DataFrame) -> DataFrame:
    """(source, source_size, target) from (source, source_size), one row per source.

    The water level: with sources in order of size over weight, the first k stand at their caps, and the rest share what is left.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), F.pmod(F.row_number().over(order) - 1, F.lit(len(WEIGHTS))).cast("int") + 1).cast("long")
    weighed = sizes.withColumn("weight", weight).withColumn("cap", F.lit(MOST) * F.col("source_size"))
    rising = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    below = rising.rowsBetween(Window.unboundedPreceding, -1)
    onward = rising.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    every = Window.partitionBy(F.lit(0))
    level = (SHARE * F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(below), F.lit(0))) / F.sum("weight").over(onward)
    found = weighed.withColumn("level", level).withColumn("fits", F.col("level") * F.col("weight") <= F.col("cap"))
    # the level of the first source that stays below its cap is the level of all such
    return found.withColumn("final", F.max_by(F.when(F.col("fits"), F.col("level")), F.when(F.col("fits"), -F.col("cap") / F.col("weight"))).over(every)).select(
        "source", "source_size", F.coalesce(F.least(F.col("cap").cast("double"), F.col("final") * F.col("weight")), F.col("cap").cast("double")).alias("target")
    )


def schedule(goals: DataFrame, slots: int, whole: int) -> DataFrame:
    """(slot, source, rank): for each slot the source that fills it, and the slot's rank among that source's slots, from 0.

    Points meet sources by an equi-join on cells of the unit interval; a source stands in each cell that it overlaps.
    """
    upto = F.sum("goal").over(Window.orderBy(F.col("source").asc_nulls_last()))
    spans = goals.select("source", F.round("target").cast("long").alias("goal")).withColumn("upper", upto).filter(F.col("goal") > 0)
    spans = spans.withColumn("lower", F.col("upper") - F.col("goal"))
    cell = lambda at: F.floor(at * CELLS / F.lit(whole)).cast("long")
    spans = spans.withColumn("cell", F.explode(F.sequence(cell(F.col("lower")), cell(F.col("upper")))))
    point = F.col("id") * F.lit(GOLDEN)
    points = goals.sparkSession.range(slots).select(F.col("id").alias("slot"), ((point - F.floor(point)) * F.lit(whole)).alias("at")).withColumn("cell", cell(F.col("at")))
    placed = points.join(spans, "cell").filter((F.col("at") >= F.col("lower")) & (F.col("at") < F.col("upper"))).select("slot", F.floor(F.col("slot") / RUN).alias("run"), "source")
    within = Window.partitionBy("source", "run").orderBy("slot")
    runs = placed.groupBy("source", "run").agg(F.count("*").alias("n"))
    runs = runs.withColumn("before", F.sum("n").over(Window.partitionBy("source").orderBy("run")) - F.col("n")).select(F.col("source").alias("s"), F.col("run").alias("r"), "before")
    ranked = placed.withColumn("k", F.row_number().over(within)).join(runs, F.col("source").eqNullSafe(F.col("s")) & (F.col("run") == F.col("r")))
    return ranked.select("slot", "source", (F.col("before") + F.col("k") - 1).alias("rank"))


def sized(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """(doc_id, source, size, digest, bucket): all that the mix needs of a document."""
    whole = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(key).alias("doc_id"), F.col(source).alias("source"), token_count(F.col(text)).alias("size"), _digest(F.col(key), whole).alias("digest"))
    return rows.withColumn("bucket", F.substring("digest", 1, PREFIX_DIGITS))


def placed(rows: DataFrame) -> DataFrame:
    """Adds ``start``: the tokens of the same source that stand before a document in the shuffled order."""
    sums = rows.groupBy("source", "bucket").agg(F.sum("size").alias("n"))
    before = F.sum("n").over(Window.partitionBy("source").orderBy("bucket")) - F.col("n")
    sums = sums.select(F.col("source").alias("s"), F.col("bucket").alias("b"), before.alias("before"))
    inside = F.sum("size").over(Window.partitionBy("source", "bucket").orderBy("digest", "doc_id").rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")
    joined = rows.withColumn("inside", inside).join(sums, F.col("source").eqNullSafe(F.col("s")) & (F.col("bucket") == F.col("b")))
    return joined.select("doc_id", "digest", "source", "size", (F.col("before") + F.col("inside")).alias("start"))


def mix(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """(doc_id, source, size, source_size, target, taken, scheduled) for each document; scheduled: the words that lie in slots, not in a last part."""
    return placed_mix(docs, key, text, source).drop("digest")


def repeat(docs: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """The mix as documents, with all their columns: each as often as the schedule takes from it, whole.

    A document that the mix only begins, or takes a second time only in part, counts as taken whole; one it takes nothing
    from is left out.  Rows alike in id and text
    stand as one with their counts added.  Texts are shuffled once, by the digest of id and text, rows alike once per task.
    """
    row, times = fresh_name(docs, "row"), fresh_name(docs, "times")
    taken = placed_mix(docs, key, text, source).filter(F.col("taken") > 0)
    counts = taken.groupBy(F.col("digest").alias(row)).agg(F.sum(F.ceil(F.col("taken") / F.col("size"))).cast("int").alias(times))
    # copies by the thousand, before texts meet them: rows alike in large numbers do not come from one task
    counts = counts.withColumn("part", F.explode(F.sequence(F.lit(0), F.floor((F.col(times) - 1) / COPIES)))).select(row, F.least(F.lit(COPIES), F.col(times) - F.col("part") * COPIES).cast("int").alias(times))
    once = docs.withColumn(row, _digest(F.col(key), F.coalesce(F.col(text), F.lit("")))).dropDuplicates([row]).join(counts, row)
    return once.withColumn(times, F.explode(F.array_repeat(F.lit(0), F.col(times)))).select(*docs.columns)


def _digest(key: Column, whole: Column) -> Column:
    return F.md5(F.concat_ws(":", F.coalesce(key.cast("string"), F.lit("")), F.md5(whole)))


def placed_mix(docs: DataFrame, key: str, text: str, source: str) -> DataFrame:
    """The mix with each document's digest.

    Writes two small tables to the shared folder first (sizes; targets), and takes one row of sums to the driver.
    """
    rows = written(sized(docs, key, text, source), "mix-sizes")
    goals = written(targets(rows.groupBy("source").agg(F.sum("size").alias("source_size"))), "mix-targets")
    whole = goals.agg(F.coalesce(F.sum(F.round("target").cast("long")), F.lit(0))).first()[0]
    if not whole:
        facts = goals.withColumnRenamed("source", "s")
        none = rows.join(facts, F.col("source").eqNullSafe(F.col("s")))
        return none.select("doc_id", "digest", "source", "size", "source_size", "target", F.lit(0).cast("long").alias("taken"), F.lit(0).cast("long").alias("scheduled"))
    slot_size = -(-whole // SLOTS)
    slots = schedule(goals, -(-whole // slot_size), whole).select(F.col("source").alias("slot_source"), F.col("rank").alias("slot_block"))
    ends = slots.groupBy("slot_source").agg((F.max("slot_block") + 1).alias("slots"))
    facts = goals.withColumnRenamed("source", "s").join(ends, F.col("s").eqNullSafe(F.col("slot_source")), "left").drop("slot_source").fillna(0, ["slots"])
    known = placed(rows).join(facts, F.col("source").eqNullSafe(F.col("s"))).drop("s")
    laps = known.filter(F.col("size") > 0).withColumn("lap", F.explode(F.sequence(F.lit(0), F.lit(MOST - 1))))
    laps = laps.withColumn("low", F.col("start") + F.col("lap") * F.col("source_size")).withColumn("high", F.col("low") + F.col("size"))
    block = lambda at: F.floor(at / F.lit(slot_size)).cast("long")
    parts = laps.withColumn("block", F.explode(F.sequence(block(F.col("low")), block(F.col("high") - 1))))
    met = parts.join(slots, F.col("source").eqNullSafe(F.col("slot_source")) & (F.col("block") == F.col("slot_block")), "left")
    # no slot gives more than is left of the target; blocks after the last slot are the source's last part, and one that the schedule leaves out before it gives nothing
    cut = F.greatest(F.lit(0), F.least("high", (F.col("block") + 1) * slot_size, F.round("target").cast("long")) - F.greatest("low", F.col("block") * slot_size))
    filled = F.col("slot_block").isNotNull()
    sums = [F.sum(F.when(filled | (F.col("block") >= F.col("slots")), cut).otherwise(0)).alias("taken"), F.sum(F.when(filled, cut).otherwise(0)).alias("scheduled")]
    given = met.groupBy("doc_id", "digest", "source", "size", "source_size", "target", "start").agg(*sums)
    zero = F.lit(0).cast("long")
    empty = known.filter(F.col("size") == 0).select("doc_id", "digest", "source", "size", "source_size", "target", zero.alias("taken"), zero.alias("scheduled"))
    return given.drop("start").unionByName(empty)


#: DuckDB SQL for mix(documents).
ORACLE = """
WITH sized AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || md5(coalesce(text, ''))) AS digest
  FROM documents
), sources AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source
), weighed AS (
  SELECT *, 2 * source_size AS cap, [3, 1, 2][((row_number() OVER (ORDER BY source NULLS LAST)) - 1) % 3 + 1] AS weight FROM sources
), levels AS (
  SELECT *, (CAST(1.5 AS DOUBLE) * CAST(sum(source_size) OVER () AS DOUBLE)
             - CAST(coalesce(sum(cap) OVER (ORDER BY cap / CAST(weight AS DOUBLE), source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE))
            / CAST(sum(weight) OVER (ORDER BY cap / CAST(weight AS DOUBLE), source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS DOUBLE) AS level
  FROM weighed
), goals AS (
  SELECT source, source_size, least(CAST(cap AS DOUBLE), (SELECT arg_min(level, cap / CAST(weight AS DOUBLE)) FROM levels WHERE level * weight <= cap) * weight) AS target
  FROM levels
), bounds AS (
  SELECT *, CAST(sum(CAST(round(target) AS BIGINT)) OVER (ORDER BY source NULLS LAST) AS BIGINT) AS upper,
         CAST(sum(CAST(round(target) AS BIGINT)) OVER () AS BIGINT) AS whole, CAST(round(target) AS BIGINT) AS goal FROM goals
), sizes AS (
  SELECT max(whole) AS whole, (max(whole) + 131071) // 131072 AS slot_size FROM bounds
), points AS (
  SELECT (i * CAST(0.6180339887498949 AS DOUBLE) - floor(i * CAST(0.6180339887498949 AS DOUBLE))) * whole AS pos
  FROM sizes, range((whole + slot_size - 1) // slot_size) t(i)
), filled AS (
  SELECT upper, count(*) AS n FROM points ASOF JOIN (SELECT upper, CAST(upper - goal AS DOUBLE) AS lower FROM bounds WHERE goal > 0) b ON pos >= lower GROUP BY upper
), ends AS (
  SELECT b.source, b.source_size, b.target, goal AS reach, least(goal, coalesce(n, 0) * slot_size) AS told
  FROM bounds b CROSS JOIN sizes LEFT JOIN filled f ON f.upper = b.upper AND b.goal > 0
), placed AS (
  SELECT *, CAST(sum(size) OVER (PARTITION BY source ORDER BY digest, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) - size AS start FROM sized
)
SELECT doc_id, p.source, size, source_size, target,
       CAST(greatest(0, least(size, reach - start)) + greatest(0, least(size, reach - start - source_size)) AS BIGINT) AS taken,
       CAST(greatest(0, least(size, told - start)) + greatest(0, least(size, told - start - source_size)) AS BIGINT) AS scheduled
FROM placed p JOIN ends e ON p.source IS NOT DISTINCT FROM e.source
"""
