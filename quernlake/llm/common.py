"""Small helpers that the operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quernlake.sources.scratch import discard, written  # noqa: F401  (for the operators)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Bytes of a text's digest: enough of its SHA-256 to tell apart even texts made to collide.
TID = 20


def text_digest(whole: Column) -> Column:
    return F.unhex(F.substring(F.sha2(whole, 256), 1, 2 * TID))


def slices(texts: list, limit: int = 4_000_000) -> Iterator[tuple[int, int]]:
    """Ranges [a, b) of rows of about ``limit`` characters; a longer row stands alone."""
    start = size = 0
    for i, text in enumerate(texts):
        n = len(text)
        if i > start and size + n > limit:
            yield start, i
            start, size = i, 0
        size += n
    if start < len(texts):
        yield start, len(texts)


def spans(texts: pa.Array, limit: int = 4_000_000) -> list[tuple[int, int]]:
    """Ranges [a, b) of the rows of an Arrow column of texts, of about ``limit`` bytes; a longer row stands alone."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    out, a, before = [], 0, 0
    while a < len(texts):
        b = max(a + 1, int(np.searchsorted(ends, before + limit, "right")))
        out.append((a, b))
        a, before = b, int(ends[b - 1])
    return out


def fresh_name(docs: DataFrame, name: str) -> str:
    """``name``, with as many underscores before it as set it apart from the columns of ``docs``."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def row_digest(key: Column, digest: Column) -> Column:
    """One binary column for a row's id (null is a value of its own) and the digest of its text."""
    return F.unhex(F.sha2(F.concat(digest, F.encode(F.coalesce(F.concat(F.lit(":"), key.cast("string")), F.lit("")), "UTF-8")), 256))
