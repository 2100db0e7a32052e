"""The root of the corpus: two page trees and their recordings to records, manifest and a summary."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quernlake.operators import markdown, recordings
from quernlake.sources.corpus import paired, read_pages, write_manifest, write_records
from quernlake.sources.payments import SourceError

#: The folders of a corpus.
MIRROR, COMPONENTS, CASTS = "public/llms", "src/pages", "public/casts"


@dataclass(frozen=True)
class Corpus:
    """Records, manifest rows, and the counts of a build."""

    records: DataFrame
    manifest: DataFrame
    redactions: DataFrame
    summary: DataFrame


def check_layout(spark: SparkSession, root: str, commit: str = "", expected: str = "", folders: Sequence[str] = (MIRROR, COMPONENTS, CASTS)) -> None:
    """Fails where folders are missing, or where the commit is not the expected one; any store that Spark reads will do."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    fs = hadoop(root).getFileSystem(spark._jsc.hadoopConfiguration())
    missing = [f for f in folders if not fs.exists(hadoop(f"{root}/{f}"))]
    if missing:
        raise SourceError(f"folders missing under {root}: {', '.join(missing)}")
    if expected and not commit.startswith(expected):
        raise SourceError(f"the corpus is at {commit or 'no commit'}, not at {expected}")


def build(pages: DataFrame, mdx: DataFrame, commands: DataFrame | None = None, commit: str = "", lang: str = "fa", shell_commands: Sequence[str] = (), roots: frozenset[str] = markdown.MANIFEST_ROOTS) -> Corpus:
    """Mirror pages and component pages (path, text), and recorded commands (cast_id, ord, command), to the corpus."""
    casts = None
    if commands is not None:
        casts = recordings.attach(markdown.sections(pages, mdx), recordings.references(mdx), commands)
    made = markdown.chunks(pages, mdx, commit, lang, shell_commands, casts)
    counts = markdown.redaction_counts(made)
    return Corpus(made.drop("redactions"), markdown.manifest(markdown.page_fences(pages), roots), counts, markdown.build_summary(made))


def build_corpus(
    spark: SparkSession, root: str, output: str, commands: DataFrame | None = None, commit: str = "", expected: str = "", skipped: tuple[str, ...] = (), lang: str = "fa", shell_commands: Sequence[str] = ()
) -> Corpus:
    """Reads both page trees under ``root``, pairs them, and writes ``output``/corpus and ``output``/manifest.

    Records are written once and read back for what follows.  ``commands`` are those of the recordings; how a terminal
    would show a recording is not computed here.
    """
    check_layout(spark, root, commit, expected)
    pages, mdx = paired(read_pages(spark, f"{root}/{MIRROR}", "*.md"), read_pages(spark, f"{root}/{COMPONENTS}", "*.mdx"), skipped)
    corpus = build(pages, mdx, commands, commit, lang, shell_commands)
    write_records(corpus.records, f"{output}/corpus")
    write_manifest(corpus.manifest, f"{output}/manifest")
    records = spark.read.schema(corpus.records.schema).json(f"{output}/corpus")
    return Corpus(records, corpus.manifest, corpus.redactions, markdown.build_summary(records))
