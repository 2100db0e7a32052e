"""Payment CSV: contract check, staging read, import manifest, staged replacement of the star schema."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable, Mapping
from dataclasses import dataclass
from datetime import datetime

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from quernlake.operators import quality
from quernlake.schemas import DATASET_IMPORTS, PAYMENT_CSV, PAYMENT_CSV_COLUMNS, SESSION_STATUSES, TRY_STATUSES

TRANSFORMATION_VERSION = "1.0.0"
TABLES = ("merchants", "merchant_categories", "terminals", "payment_sessions", "payment_tries")


class SourceError(ValueError):
    """The source breaks its contract; messages name columns and rows, never values."""


@dataclass(frozen=True)
class SourceFile:
    path: str
    sha256: str
    size: int


def _files(spark: SparkSession, path: str):  # noqa: ANN202
    """The path's file system, and its files in order of names."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = hadoop.getFileSystem(spark._jsc.hadoopConfiguration())
    return fs, sorted((f for f in fs.listStatus(hadoop) if f.isFile()), key=lambda f: f.getPath().getName())


def inspect_source(spark: SparkSession, path: str) -> SourceFile:
    """Checks the header (a byte-order mark is tolerated) and takes the file's size and SHA-256.

    A SHA-256 follows the bytes in order, so that one stream reads them, a buffer at a time, from whatever store Hadoop
    opens.  A folder has the digest of its files' digests in order of their names.
    """
    first = spark.read.text(path).limit(1).collect()
    header = first[0][0].lstrip("\ufeff").rstrip("\r").split(",") if first else []
    if tuple(h.strip('"') for h in header) != PAYMENT_CSV_COLUMNS:
        raise SourceError("the header differs from the payment CSV contract")
    fs, files = _files(spark, path)
    digests = []
    for file in files:
        stream = fs.open(file.getPath())
        try:
            digests.append(spark._jvm.org.apache.commons.codec.digest.DigestUtils.sha256Hex(stream))
        finally:
            stream.close()
    return SourceFile(path, digests[0] if len(digests) == 1 else hashlib.sha256("".join(digests).encode()).hexdigest(), sum(f.getLen() for f in files))


def read_staging(spark: SparkSession, path: str) -> DataFrame:
    """All columns as text with their 1-based data row; blanks are NULL, quoted blanks stay empty; malformed files fail.

    Rows are numbered by file offset: counts of the read partitions, then a place within each, so no task sees all rows.
    """
    rows = spark.read.schema(PAYMENT_CSV).option("header", True).option("nullValue", "").option("emptyValue", "").option("mode", "FAILFAST").csv(path)
    return numbered(rows, "source_row_number")


def numbered(rows: DataFrame, name: str) -> DataFrame:
    """Adds row numbers from 1 in the order of the read partitions; only a count for each partition is ordered in one task."""
    tagged = rows.withColumn("__id", F.monotonically_increasing_id()).withColumn("__part", F.shiftright("__id", 33))
    ahead = F.sum("count").over(Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1))
    counts = tagged.groupBy(F.col("__part").alias("__p")).count().select("__p", F.coalesce(ahead, F.lit(0)).alias("__ahead"))
    place = F.col("__id").bitwiseAND((1 << 33) - 1)
    return tagged.join(counts, F.col("__part") == F.col("__p")).withColumn(name, F.col("__ahead") + place + 1).drop("__id", "__part", "__p", "__ahead")


def dataset_state(spark: SparkSession, root: str, source: SourceFile) -> str:
    """``empty``, ``same`` or ``different``, by the import manifest under ``root``."""
    imports = read_imports(spark, root)
    if imports.isEmpty():
        return "empty"
    return "same" if not imports.filter(F.col("sha256") == source.sha256).isEmpty() else "different"


def _exists(spark: SparkSession, path: str) -> bool:
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jpath.getFileSystem(spark._jsc.hadoopConfiguration()).exists(jpath)


def _commits(spark: SparkSession, root: str) -> list[tuple[int, str]]:
    """(number, version) of the commits in order; a number whose file is still empty is being written and does not count."""
    folder = f"{root}/commits"
    if not _exists(spark, folder):
        return []
    fs, files = _files(spark, folder)
    found = [(int(f.getPath().getName()), f.getPath()) for f in files if f.getLen() and f.getPath().getName().isdigit()]
    return [(n, spark.read.text(p.toString()).first()[0]) for n, p in sorted(found, key=lambda f: f[0])[-1:]]


def _commit(spark: SparkSession, root: str, number: int, version: str) -> None:
    """Makes ``version`` current under the next number, unless another load took that number."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/commits/{number:010d}")
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    taken = SourceError("another load was committed meanwhile; nothing of this one remains")
    if fs.exists(path):
        raise taken
    try:
        out = fs.create(path, False)
        out.write(bytearray(version.encode()))
        out.close()
    except Py4JJavaError as error:
        if fs.exists(path):
            raise taken from error
        raise
    # a store that lets two writers create one file keeps one of them
    if spark.read.text(path.toString()).first()[0] != version:
        raise taken


def current_version(spark: SparkSession, root: str) -> str | None:
    """The folder of the tables that hold, or None before the first load."""
    commits = _commits(spark, root)
    return f"{root}/{commits[-1][1]}" if commits else None


def read_table(spark: SparkSession, root: str, name: str) -> DataFrame:
    version = current_version(spark, root)
    if version is None:
        raise SourceError("nothing is loaded")
    return spark.read.parquet(f"{version}/{name}")


def read_imports(spark: SparkSession, root: str) -> DataFrame:
    version = current_version(spark, root)
    return spark.createDataFrame([], DATASET_IMPORTS) if version is None else spark.read.schema(DATASET_IMPORTS).parquet(f"{version}/dataset_imports")


def constraints() -> dict[str, dict[str, Column]]:
    """What the rows of a typed table must hold, whatever wrote them."""
    positive = lambda *names: {f"{c} is not negative": F.col(c) >= 0 for c in names}
    member = lambda c, values: {f"{c} is known": F.col(c).isin(*values)}
    return {
        "dataset_imports": positive("source_size_bytes", "source_row_count", "session_count", "try_count"),
        "payment_sessions": positive("amount", "adjusted_fee") | member("session_status", SESSION_STATUSES) | member("verify_type", quality.VERIFY_TYPES),
        "payment_tries": positive("try_seq", "init_time_ms", "verify_time_ms") | member("try_status", TRY_STATUSES),
    }


def replace_tables(spark: SparkSession, root: str, tables: Mapping[str, DataFrame], partition_by: Mapping[str, str] | None = None, check: Callable[[Mapping[str, DataFrame]], None] | None = None, after: int | None = None) -> None:
    """Writes all tables under a new version folder, checks them as read back, and makes that version the current one.

    Counts of rows that break a constraint ride on the write, so typed tables are not scanned again for them; a null
    breaks none.  Readers go by numbered commits.  A load takes the number after ``after``, the one it began from, which a
    second load at the same time finds taken: it fails and removes its own folder alone.  Folders of replaced versions go after
    the commit, so a crash at any time leaves the tables of one load.
    """
    before = _commits(spark, root)
    version = f"version-{uuid.uuid4().hex}"
    delete = lambda name: (p := spark._jvm.org.apache.hadoop.fs.Path(f"{root}/{name}")).getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
    try:
        for name, df in tables.items():
            rules = constraints().get(name, {})
            broken = Observation(f"{name}-{version}")
            counted = df.observe(broken, *[F.count_if(~holds).alias(rule) for rule, holds in rules.items()]) if rules else df
            writer = counted.write
            if partition_by and name in partition_by:
                writer = writer.partitionBy(partition_by[name])
            writer.parquet(f"{root}/{version}/{name}")
            if rules and (found := [rule for rule, n in broken.get.items() if n]):
                raise SourceError(f"{name}: not all rows keep the constraint that {found[0]}")
        if check is not None:
            check({name: spark.read.parquet(f"{root}/{version}/{name}") for name in tables})
        _commit(spark, root, (after if after is not None else before[-1][0] if before else 0) + 1, version)
    except BaseException:
        delete(version)
        raise
    for _, replaced in before:
        delete(replaced)


#: Unique keys of the tables, and the keys by which rows refer to other tables.
UNIQUE = {"merchants": ("merchant_id",), "merchant_categories": ("category_id",), "terminals": ("terminal_id",), "payment_sessions": ("session_id",), "payment_tries": ("session_id", "try_seq")}
REFERENCES = (
    ("terminals", "merchants", ("merchant_id",)), ("payment_sessions", "merchants", ("merchant_id",)), ("payment_sessions", "terminals", ("terminal_id", "merchant_id")),
    ("payment_sessions", "merchant_categories", ("category_id",)), ("payment_tries", "payment_sessions", ("session_id", "merchant_id")),
)


def check_keys(tables: Mapping[str, DataFrame]) -> None:
    """Fails where a key stands twice (also by a collision of surrogate ids) or a row refers to nothing."""
    for name, keys in UNIQUE.items():
        if name in tables and not quality.repeated_keys(tables[name], keys).isEmpty():
            raise SourceError(f"a key of {name} stands more than once")
    for child, parent, keys in REFERENCES:
        if child in tables and parent in tables and not quality.orphans(tables[child], tables[parent], keys).isEmpty():
            raise SourceError(f"a row of {child} refers to no row of {parent}")


def load_payments(spark: SparkSession, path: str, root: str, normalize: Callable[[DataFrame], Mapping[str, DataFrame]], replace: bool = False, now: datetime | None = None) -> str:
    """Loads a CSV once: ``loaded``, or ``unchanged`` where this very file is there already.

    A different dataset is refused without ``replace``.  ``normalize`` validates the staging rows and returns the tables;
    the audit row, at the time ``now``, becomes current together with them.
    """
    before = _commits(spark, root)
    source = inspect_source(spark, path)
    state = dataset_state(spark, root, source)
    if state == "same" and not replace:
        return "unchanged"
    if state == "different" and not replace:
        raise SourceError("another dataset is loaded; pass replace=True to replace it")
    staging = read_staging(spark, path)
    counts = staging.agg(F.count("*").alias("source_row_count"), F.count_distinct("session_key").alias("session_count"))
    stamp = F.current_timestamp() if now is None else F.lit(now)
    audit = counts.select(
        F.lit(path.rsplit("/", 1)[-1]).alias("source_filename"), F.lit(source.sha256).alias("sha256"), F.lit(source.size).cast("long").alias("source_size_bytes"), "source_row_count", "session_count",
        F.col("source_row_count").alias("try_count"), F.lit(TRANSFORMATION_VERSION).alias("transformation_version"), stamp.alias("imported_at"),
    )
    replace_tables(spark, root, {**normalize(staging), "dataset_imports": audit}, check=check_keys, after=before[-1][0] if before else 0)
    return "loaded"
