"""Lines of source text.

A text is cut into blocks once; each knows the line that it begins in. The line of a place is an equality join with the
one block that it lies in, so texts are neither copied to their symbols nor scanned for each of them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import symbols

MAX_LINES = 120
#: Characters of a block.
BLOCK = 4096


def blocks(sources: DataFrame) -> DataFrame:
    """(path, block, first, chunk) of sources (path, text): the number of a block, the line that it begins in, and its characters.

    A text whose length is a multiple of BLOCK has an empty block at its end, as its end is a place too; a text that is null has none.
    """
    cut = sources.select("path", F.length("text").alias("size"), F.regexp_extract_all("text", F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0)).alias("full"))
    chunks = cut.select("path", F.when(F.col("size") % BLOCK == 0, F.concat("full", F.array(F.lit("")))).otherwise(F.col("full")).alias("chunks"))
    breaks = F.transform("chunks", lambda c: F.length(c) - F.length(F.replace(c, F.lit("\n"))))
    first = F.aggregate(breaks, F.array(F.lit(1)), lambda lines, n: F.array_append(lines, F.element_at(lines, -1) + n))
    zipped = F.zip_with("chunks", F.slice(first, 1, F.size("chunks")), lambda c, f: F.struct(f.alias("first"), c.alias("chunk")))
    return chunks.select("path", F.posexplode(zipped).alias("block", "of")).select("path", "block", "of.*")


def with_lines(rows: DataFrame, sources: DataFrame) -> DataFrame:
    """rows (file, span_start) with line, null where the text isn't there or the span lies outside."""
    held = blocks(sources).select(F.col("path").alias("file"), F.col("block").alias("_block"), F.col("first").alias("_first"), F.col("chunk").alias("_chunk"))
    keyed = rows.withColumn("_block", F.floor(F.col("span_start") / BLOCK).cast("int"))
    line = F.col("_first") + symbols.line_of(F.col("_chunk"), F.col("span_start") - F.col("_block") * BLOCK) - 1
    return keyed.join(held, ["file", "_block"], "left").withColumn("line", line).drop("_block", "_first", "_chunk")


def symbol_source(symbols_of: DataFrame, sources: DataFrame, context: int = 5, limit: int = MAX_LINES) -> DataFrame:
    """(id, line_no, text) of nodes (id, file, span_start, span_end), with lines of context before and after, at most limit lines each."""
    context = max(0, min(context, 20))
    texts = sources.select(F.col("path").alias("file"), "text")
    joined = symbols_of.select("id", "file", "span_start", "span_end").join(texts, "file")
    size = F.length("text")
    first, last = (symbols.line_of(F.col("text"), F.least(F.greatest(F.col(c), F.lit(0)), size)) for c in ("span_start", "span_end"))
    ranged = joined.withColumn("first", F.greatest(first - context, F.lit(1))).withColumn("last", last + context)
    rows = ranged.select("id", "first", "last", F.posexplode(F.split("text", "\n", -1)).alias("at", "line"))
    line_no = F.col("at") + 1
    inside = rows.filter((line_no >= F.col("first")) & (line_no <= F.col("last")) & (line_no < F.col("first") + limit))
    return inside.select("id", line_no.alias("line_no"), F.rtrim(F.col("line"), F.lit("\r")).alias("text"))
