"""Corpus sources and sinks: page mirrors, JSON lines, terminal recordings, manifests."""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quernlake.schemas import CHUNKS
from quernlake.sources.payments import SourceError


def read_pages(spark: SparkSession, root: str, glob: str = "*.md") -> DataFrame:
    """(path, text) of whole files under ``root``; the path is relative and without its suffix."""
    rows = spark.read.text(root, wholetext=True, recursiveFileLookup=True, pathGlobFilter=glob)
    base = re.escape(root.removeprefix("file://").rstrip("/"))
    path = F.regexp_replace(F.regexp_replace(F.url_decode(F.input_file_name()), f"^.*{base}/", ""), r"\.[^./]*$", "")
    return rows.select(path.alias("path"), F.col("value").alias("text"))


def paired(mirror: DataFrame, components: DataFrame, skipped: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """Both sides without skipped pages; a page that lacks its partner fails."""
    mirror, components = (d.filter(~F.col("path").isin(*skipped)) if skipped else d for d in (mirror, components))
    for one, other, what in ((mirror, components, "component"), (components, mirror, "mirror")):
        lone = one.join(other, "path", "left_anti").select("path").limit(1).collect()
        if lone:
            raise SourceError(f"page without its {what} page: {lone[0]['path']}")
    return mirror, components


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """Corpus records from JSON lines; blank lines are skipped, unknown or missing fields fail with their file and line.

    Lines are numbered in their file by counts of the read partitions and a place within each, so no task reads a whole file.
    """
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("begin"))
    placed = lines.withColumn("id", F.monotonically_increasing_id())
    # where each block of a file began in the numbering, and how many lines it has; blocks of a file stand in order
    blocks = placed.groupBy("file", "begin").agg(F.min("id").alias("first"), F.count("*").alias("n"))
    ahead = F.sum("n").over(Window.partitionBy("file").orderBy("begin").rowsBetween(Window.unboundedPreceding, -1))
    blocks = blocks.select("file", "begin", "first", F.coalesce(ahead, F.lit(0)).alias("ahead"))
    lines = placed.join(blocks, ["file", "begin"]).withColumn("line", F.col("ahead") + F.col("id") - F.col("first") + 1).filter(F.trim("value") != "")
    names = F.array(*[F.lit(f.name) for f in CHUNKS])
    keys = F.json_object_keys("value")
    strict = F.coalesce((F.size(F.array_except(keys, names)) == 0) & (F.size(F.array_except(names, keys)) == 0), F.lit(False))
    checked = F.when(strict, F.col("value")).otherwise(F.raise_error(F.concat(F.lit("not a corpus record in "), F.col("file"), F.lit(":"), F.col("line").cast("string"))))
    nullable = T.StructType([T.StructField(f.name, f.dataType, True) for f in CHUNKS])
    return lines.select(F.from_json(checked, nullable, {"mode": "FAILFAST"}).alias("r")).select("r.*")


def swapped_in(spark: SparkSession, path: str, write: Callable[[str], None]) -> None:
    """Writes beside ``path`` and then renames, so that readers find what was there or all of what is new."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    fs = hadoop(path).getFileSystem(spark._jsc.hadoopConfiguration())
    aside, old = (f"{path.rstrip('/')}-{word}-{uuid.uuid4().hex}" for word in ("new", "old"))
    write(aside)
    there = fs.exists(hadoop(path))
    if there:
        fs.rename(hadoop(path), hadoop(old))
    if not fs.rename(hadoop(aside), hadoop(path)):
        raise SourceError(f"nothing could be renamed to {path}")
    if there:
        fs.delete(hadoop(old), True)


def write_records(records: DataFrame, path: str, order: tuple[str, ...] = ("path", "id")) -> None:
    """JSON lines in order, one set of files that replaces what was there once all are written."""
    rows = records.repartitionByRange(*order).sortWithinPartitions(*order)
    swapped_in(records.sparkSession, path, lambda aside: rows.write.option("ignoreNullFields", False).json(aside))


def write_manifest(manifest: DataFrame, path: str) -> None:
    """An indented JSON file of the manifest's rows; manifests have some dozens of rows."""
    rows = {r["leaf"]: {"frequency": r["frequency"], "pages": list(r["pages"])} for r in manifest.orderBy("leaf").toLocalIterator()}
    text = json.dumps(rows, ensure_ascii=False, indent=2) + "\n"
    manifest.sparkSession.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(path)


CAST = T.StructType([T.StructField("width", T.IntegerType()), T.StructField("height", T.IntegerType()), T.StructField("output", T.StringType())])


@F.pandas_udf(CAST)
def read_cast(texts: pd.Series) -> pd.DataFrame:
    """Header and joined output of a terminal recording; bad events are skipped, a bad header fails."""
    out = []
    for text in texts:
        lines = text.splitlines()
        header = json.loads(lines[0]) if lines else {}
        if not (isinstance(header, dict) and int(header.get("width", 0)) > 0 and int(header.get("height", 0)) > 0):
            raise ValueError("a recording has no valid header")
        parts = []
        for line in lines[1:]:
            try:
                _, kind, data = json.loads(line)
            except (TypeError, ValueError):
                continue
            if kind == "o" and isinstance(data, str):
                parts.append(data)
        out.append((header["width"], header["height"], "".join(parts)))
    return pd.DataFrame(out, columns=["width", "height", "output"])
