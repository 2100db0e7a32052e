"""Terminal recordings in component pages: where they are referred to, and the section that each belongs to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quernlake.functions.text import html_unescape, normalize

#: The component that shows a recording, how far back its context reaches without a paragraph, and what a match is worth.
RECORDING = r"""<Asciinema\s+id=["']([^"']+)["']\s*/>"""
CONTEXT_CHARACTERS = 1200
WHOLE_CONTEXT, CONTEXT_WORD, WHOLE_COMMAND, COMMAND_START, COMMAND_NAME = 200, 1, 300, 120, 30


def _attribute(name: str) -> Column:
    tag = F.regexp_extract("segment", r"(?s)\A<Section\b([^>]*)", 1)
    return F.coalesce(*[F.nullif(F.regexp_extract(tag, rf"(?s)\b{name}\s*=\s*{q}(.*?){q}", 1), F.lit("")) for q in ('"', "'")])


def search_text(text: Column) -> Column:
    return normalize(F.regexp_replace(text, r"(?U)[^\w\x{600}-\x{6ff}]+", " "))


def references(mdx: DataFrame) -> DataFrame:
    """(path, ord, cast_id, context, anchor_scope) of the recordings in component pages (path, text), in order.

    A page is cut before its sections and recordings; the scope is the id of the nearest section before a recording, and
    the context the visible text of the last paragraph before it.
    """
    active = F.regexp_replace("text", r"(?s)\{/\*.*?\*/\}", "")
    cut = mdx.select("path", F.posexplode(F.split(active, r"(?=<Section\b|<Asciinema\s)")).alias("n", "segment"))
    before = Window.partitionBy("path").orderBy("n").rowsBetween(Window.unboundedPreceding, -1)
    is_section = F.col("segment").rlike(r"\A<Section\b")
    paragraph = F.try_element_at(F.regexp_extract_all("segment", F.lit(r"(?s)<p\b[^>]*>(.*?)</p>"), F.lit(1)), F.lit(-1))
    # an as-of join of each recording with the section before it, and with the paragraph before it
    rows = cut.withColumn("section", F.last(F.when(is_section, F.struct(_attribute("id").alias("id"))), ignorenulls=True).over(before))
    rows = rows.withColumn("paragraph", F.last(paragraph, ignorenulls=True).over(before))
    rows = rows.withColumn("tail", F.when(F.col("paragraph").isNull(), F.right(F.array_join(F.collect_list("segment").over(before), ""), F.lit(CONTEXT_CHARACTERS))))
    found = rows.withColumn("cast_id", F.nullif(F.regexp_extract("segment", rf"\A{RECORDING}", 1), F.lit(""))).filter(F.col("cast_id").isNotNull())
    visible = F.regexp_replace(F.coalesce("paragraph", "tail", F.lit("")), r"<[^>]+>", " ")
    visible = F.regexp_replace(F.regexp_replace(visible, r"(?s)\{`(.*?)`\}", "$1"), r"\{[^{}]*\}", " ")
    context = F.trim(F.regexp_replace(html_unescape(visible), r"(?U)\s+", " "))
    return found.select("path", F.col("n").alias("ord"), "cast_id", context.alias("context"), F.col("section.id").alias("anchor_scope"))


def match_score(searchable: Column, context: Column, commands: Column) -> Column:
    """How well a section's text fits a recording's context and commands, all folded by search_text()."""
    words = F.array_distinct(F.filter(F.split(context, " "), lambda w: F.length(w) > 2))
    told = F.when((context != "") & searchable.contains(context), WHOLE_CONTEXT).otherwise(0) + CONTEXT_WORD * F.size(F.filter(words, lambda w: searchable.contains(w)))

    def one(command: Column) -> Column:
        parts = F.filter(F.split(command, " "), lambda w: w != "")
        start, name = F.array_join(F.slice(parts, 1, 2), " "), F.try_element_at(parts, F.lit(1))
        return F.when((command != "") & searchable.contains(command), WHOLE_COMMAND).when((start != "") & searchable.contains(start), COMMAND_START).when(searchable.contains(name), COMMAND_NAME).otherwise(0)

    return told + F.aggregate(F.transform(commands, one), F.lit(0), lambda a, b: a + b)


def attach(sections: DataFrame, found: DataFrame, commands: DataFrame) -> DataFrame:
    """(path, section, ord, text): the commands of each recording, given to the section of its page that fits best.

    ``sections`` is (path, section, heading_path, anchor, body), ``commands`` (cast_id, ord, command).  Sections of the
    recording's scope come first, if the page has any; the first of equally good sections wins.  A reference to a
    recording that is not there fails; one without commands gives none.
    """
    told = commands.groupBy("cast_id").agg(F.array_sort(F.collect_list(F.struct("ord", "command"))).alias("told"))
    told = told.withColumn("told", F.filter("told", lambda c: c["command"].isNotNull()))
    named = found.join(told, "cast_id", "left").withColumn("told", F.when(F.col("told").isNull(), F.raise_error(F.concat(F.lit("no recording "), F.col("cast_id"))).cast("array<struct<ord:int,command:string>>")).otherwise(F.col("told")))
    texts = sections.select("path", "section", "anchor", search_text(F.concat_ws(" ", F.array_join("heading_path", " "), "body")).alias("searchable"))
    folded = named.filter(F.size("told") > 0).withColumn("folded", search_text(F.col("context")))
    # commands are folded one to a row, as folding is no higher-order function
    parts = folded.select("path", "ord", F.posexplode("told").alias("k", "c")).select("path", "ord", "k", search_text(F.col("c.command")).alias("f"))
    parts = parts.groupBy("path", "ord").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "f"))), lambda x: x["f"]).alias("commands"))
    met = folded.join(parts, ["path", "ord"]).join(texts, "path")
    in_scope = F.col("anchor").eqNullSafe(F.col("anchor_scope"))
    score = match_score(F.col("searchable"), F.col("folded"), F.col("commands"))
    best = Window.partitionBy("path", "ord").orderBy(F.desc(in_scope), F.desc("score"), "section")
    chosen = met.withColumn("score", score).withColumn("n", F.row_number().over(best)).filter("n = 1")
    return chosen.select("path", "section", F.col("ord").alias("reference"), F.posexplode("told").alias("k", "c")).select("path", "section", F.struct("reference", "k").alias("ord"), F.col("c.command").alias("text"))
