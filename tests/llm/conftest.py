"""Fixtures for the tests of the training-data operators."""

from __future__ import annotations

import os
from collections.abc import Callable

import pandas as pd
import pytest
from pyspark.sql import DataFrame
from rows import ODD_ROWS

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def vocabulary() -> Callable[[str], str]:
    from quernlake.llm.queries import vocabulary as path

    return path


@pytest.fixture
def documents(spark) -> Callable[..., DataFrame]:
    """Makes a table of documents from (doc_id, text, source) rows."""

    def make(rows: list[tuple], parts: int = 3) -> DataFrame:
        frame = spark.createDataFrame(rows, "doc_id long, text string, source string")
        return frame.selectExpr("doc_id", "text", "'en' AS lang", "source", "CAST(length(text) AS long) AS n_chars").repartition(parts)

    return make


@pytest.fixture(scope="session")
def small_dir() -> str:
    return SF


@pytest.fixture(scope="session")
def small() -> pd.DataFrame:
    return pd.read_parquet(os.path.join(SF, "documents.parquet"))


@pytest.fixture
def odd(documents) -> DataFrame:
    from pyspark.sql import functions as F

    # extra columns whose names clash with those that operators make
    return documents(ODD_ROWS).withColumns({c: F.lit(0) for c in ("tid", "size", "score", "target", "key", "block", "taken", "rank", "start", "class_id", "bucket", "digest")})
