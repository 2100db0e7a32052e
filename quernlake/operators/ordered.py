"""Order statistics and running sums of groups of any size: counts over ranges first, then only the ranges that matter.

No group is sorted or held as a whole in one task: ranges of equal width (RANGES for a group) are counted with partial
sums, and windows run inside single ranges.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quernlake.sources.scratch import written

#: Ranges of a group.
RANGES = 4096


def _range(value: Column, low: Column, high: Column) -> Column:
    """Number of a value's range between the least and the greatest one of its group; halves keep the difference finite."""
    share = F.try_divide(value.cast("double") / 2 - low.cast("double") / 2, high.cast("double") / 2 - low.cast("double") / 2)
    return F.least(F.floor(F.coalesce(share, F.lit(0.0)) * RANGES), F.lit(RANGES - 1)).cast("int")


def same(left: DataFrame, right: DataFrame, by: Sequence[str]) -> DataFrame:
    """Left join on columns where null equals null."""
    named = right.select(*[F.col(c).alias(f"__{c}") if c in by else F.col(c) for c in right.columns])
    fits = [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in by]
    return left.join(named, reduce(lambda a, b: a & b, fits, F.lit(True)), "left").drop(*[f"__{c}" for c in by])


def percentiles(rows: DataFrame, by: Sequence[str], value: str, fractions: Mapping[str, float]) -> DataFrame:
    """(by..., one column for each fraction): exact percentiles with linear interpolation; null values take no part.

    Values are counted once each, and written; their counts over ranges tell in which range the ranks of a fraction lie, and only the
    values of those are put in order.
    """
    values = rows.filter(F.col(value).isNotNull()).groupBy(*by, F.col(value).cast("double").alias("__v")).agg(F.count("*").alias("__n"))
    values = written(values, "percentile-values")
    bounds = values.groupBy(*by).agg(F.min("__v").alias("__low"), F.max("__v").alias("__high"), F.sum("__n").alias("__total"))
    ranged = same(values, bounds, by).withColumn("__range", _range(F.col("__v"), F.col("__low"), F.col("__high")))
    counts = ranged.groupBy(*by, "__range").agg(F.sum("__n").alias("__n"), F.first("__total").alias("__total"))
    before = lambda *keys: F.coalesce(F.sum("__n").over(Window.partitionBy(*keys[:-1]).orderBy(keys[-1]).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = counts.withColumn("__before", before(*by, "__range"))
    # the ranks (from 0) between which a fraction lies
    place = lambda f: (F.col("__total") - 1) * F.lit(float(f))
    within = lambda rank: (F.col("__before") <= rank) & (rank < F.col("__before") + F.col("__n"))
    ranks = {name: (F.floor(place(f)), F.ceil(place(f))) for name, f in fractions.items()}
    holds = reduce(lambda a, b: a | b, [within(r) for pair in ranks.values() for r in pair])
    chosen = counts.filter(holds).select(*by, F.col("__range").alias("__r"), F.col("__before").alias("__offset"))
    fits = [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in by]
    chosen = chosen.select(*[F.col(c).alias(f"__{c}") for c in by], "__r", "__offset")
    inside = ranged.join(chosen, reduce(lambda a, b: a & b, fits, F.col("__range") == F.col("__r"))).drop(*[f"__{c}" for c in by])
    inside = inside.withColumn("__before", F.col("__offset") + before(*by, "__range", "__v"))
    at = lambda rank: F.max(F.when(within(rank), F.col("__v")))
    ends = [c for name, (low, high) in ranks.items() for c in (at(low).alias(f"__low_{name}"), at(high).alias(f"__high_{name}"))]
    found = inside.groupBy(*by, "__total").agg(*ends)

    def between(name: str, f: float) -> Column:
        low, high, (below, above) = F.col(f"__low_{name}"), F.col(f"__high_{name}"), ranks[name]
        mixed = (above - place(f)) * low + (place(f) - below) * high
        return F.when((below == above) | (low == high), low).otherwise(mixed).alias(name)

    return found.select(*by, *[between(name, f) for name, f in fractions.items()])


def running(rows: DataFrame, by: str, order: str, size: Column, total: str, number: str, most: int | None = None) -> DataFrame:
    """Adds the sum of ``size`` up to a row in its group, and the row's number from 1, by the numeric column ``order``.

    With ``most`` only ranges that begin at sums up to it are looked into, and other rows are left out; sizes are not negative.
    The rows are written first, as they are read for their bounds, their sums and themselves.
    """
    rows = written(rows, "running")
    low, high = F.min(order).alias("__low"), F.max(order).alias("__high")
    ranged = same(rows.withColumn("__size", F.coalesce(size.cast("long"), F.lit(0).cast("long"))), rows.groupBy(by).agg(low, high), [by])
    ranged = ranged.withColumn("__range", _range(F.col(order), F.col("__low"), F.col("__high")))
    sums = ranged.groupBy(by, "__range").agg(F.sum("__size").alias("__s"), F.count("*").alias("__k"))
    earlier = Window.partitionBy(by).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(by, "__range", *[F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(name) for c, name in (("__s", "__sum_before"), ("__k", "__rows_before"))])
    if most is not None:
        sums = sums.filter(F.col("__sum_before") <= most)
    sums = sums.withColumnRenamed(by, "__by").withColumnRenamed("__range", "__r")
    met = ranged.join(sums, F.col(by).eqNullSafe(F.col("__by")) & (F.col("__range") == F.col("__r")))
    inside = Window.partitionBy(by, "__range").orderBy(order)
    out = met.withColumn(total, F.col("__sum_before") + F.sum("__size").over(inside.rowsBetween(Window.unboundedPreceding, 0))).withColumn(number, (F.col("__rows_before") + F.row_number().over(inside)).cast("int"))
    return out.drop("__size", "__low", "__high", "__range", "__sum_before", "__rows_before", "__by", "__r")
