"""Repeated runs of lines (operator 7), with DataFrame operations only.

A document is the sequence of its lines (split at newlines). Deleted is each line of a later copy of a run of
lines, of any number, with MIN_CHARS characters or more: of a run that occurs before (smaller doc_id, or same
document and earlier line; the two may overlap).

1. Suffix array by prefix doubling. Suffixes of the line sequences are ranked by their first line, then by their
   first 2, 4, 8, ... lines: the key of a suffix is its own rank and that of the suffix 2^h lines on. Distinct
   keys are counted (with a partial result before the shuffle), sorted by ranges over all tasks and numbered in
   that order, and suffixes get the number of their key by a join. A suffix alone with its key has no common
   prefix of so many lines with any other and leaves; doubling ends when none is left.
2. Common-prefix lengths. A later suffix (one that isn't the first with its key) at 2^h lines but not at 2^(h+1)
   has a common prefix of 2^h lines or more with an earlier one. The suffixes with that prefix, each standing
   for those that share 2^(h+1) lines with it, are an interval of the suffix array, known by its first suffix
   and its length. For k = h - 1, ..., 0 an interval is divided by the rank of what follows its prefix, 2^k
   lines long: those with an equal rank are an interval inside it, 2^k lines deeper, which the first of them
   stands for in the outer one. In the end each later suffix is in the deepest interval that holds an earlier
   one: the depth is its longest common prefix with any earlier suffix, its maximal repeated run.
3. A maximal run of MIN_CHARS characters or more goes. Any other run that occurs before lies in one of these.

Lines are named by 128-bit digests, which are taken for the lines; runs are compared by ranks alone. Keys may be
hot: they are aggregated in part first, and joined as stored tables, which Spark splits where a key is frequent.
Windows are over the lines of one document.

Nulls: a null text has no lines and stays null; a row without doc_id loses nothing. Rows with equal doc_id count
as one document with the least of their texts, and a row with another text loses nothing. Empty lines are lines
of no characters. An empty table gives no rows. Other columns are kept by delete_repeats() and ignored by the
query.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

MIN_CHARS = 40


def lines_of(text: str | Column) -> Column:
    """The lines of a text; without a limit on their number."""
    return F.split(text, "\n", -1)


def sequences(docs: DataFrame) -> DataFrame:
    """doc_id, line number i, name of the line and its length, of documents with one row each."""
    exploded = docs.filter("text is not null").select("doc_id", F.posexplode(lines_of("text")).alias("i", "line"))
    return exploded.select("doc_id", F.col("i").cast("long").alias("i"), F.unhex(F.md5("line")).alias("name"), F.length("line").cast("long").alias("chars"))


def ranked(suffixes: DataFrame, *key: str) -> DataFrame | None:
    """Of suffixes (doc_id, i, *key, ...) those whose key others share: r, the rank of the key, and its first suffix (fd, fi); None if there are none."""
    classes = suffixes.groupBy(*key).agg(F.min(F.struct("doc_id", "i")).alias("first"), F.count("*").alias("n")).filter("n > 1")
    ranks = common.stored(classes.orderBy(*key).select(*key, "first", F.monotonically_increasing_id().alias("rank")), "ranks")
    if not common.rows_of(ranks):
        return None
    rest = [c for c in suffixes.columns if c not in key]
    return suffixes.join(ranks, list(key)).select(*rest, F.col("rank").alias("r"), F.col("first.doc_id").alias("fd"), F.col("first.i").alias("fi"))


def suffix_array(lines: DataFrame) -> list[DataFrame]:
    """For h = 0, 1, ...: the suffixes that share their first 2^h lines with others (doc_id, i, r, fd, fi), r in the order of those lines.

    That for h = 0 has also where the line starts and ends (start, end) among the characters of such lines of its document.
    """
    now = ranked(lines, "name")
    if now is None:
        return []
    so_far = F.sum("chars").over(Window.partitionBy("doc_id").orderBy("i").rowsBetween(Window.unboundedPreceding, 0))
    levels = [common.stored(now.withColumn("end", so_far).withColumn("start", F.col("end") - F.col("chars")).drop("chars"), "level")]
    while True:
        step = 1 << (len(levels) - 1)
        after = F.first("r").over(Window.partitionBy("doc_id").orderBy("i").rangeBetween(step, step))
        longer = levels[-1].select("doc_id", "i", "r", after.alias("r2")).filter("r2 is not null")
        now = ranked(common.stored(longer, "longer"), "r", "r2")
        if now is None:
            return levels
        levels.append(common.stored(now, "level"))


def prefixes(levels: list[DataFrame]) -> DataFrame:
    """For each suffix that shares its first line with an earlier one: doc_id, i, n (lines of the longest prefix that it shares so), fd, fi (where that occurs first), start."""
    later = None
    for h, level in enumerate(levels):
        own = level.filter("fd < doc_id or (fd = doc_id and fi < i)").select("doc_id", "i", F.struct(F.lit(1 << h).cast("long").alias("n"), "fd", "fi").alias("s"), F.col("start") if h == 0 else F.lit(None).cast("long").alias("start"))
        later = own if later is None else later.unionByName(own)
    asking = common.stored(later.groupBy("doc_id", "i").agg(F.max("s").alias("s"), F.max("start").alias("start")).select("s.*", "doc_id", "i", "start"), "asking")
    firsts = asking.select("n", "fd", "fi").distinct().select("n", "fd", "fi", F.col("fd").alias("doc_id"), F.col("fi").alias("i"), F.lit(None).cast("long").alias("start"))
    now = common.stored(asking.unionByName(firsts), "intervals")
    interval = ["n", "fd", "fi"]
    for k in range(len(levels) - 2, -1, -1):
        deep = now.filter(F.col("n") >= 2 << k).withColumn("at", F.col("i") + F.col("n"))
        names = levels[k].select("doc_id", F.col("i").alias("at"), F.col("r").alias("x"))
        deep = common.stored(deep.join(names, ["doc_id", "at"], "left").drop("at"), "followed")
        inner = deep.filter("x is not null").groupBy(*interval, "x").agg(F.min(F.struct("doc_id", "i")).alias("g"), F.count("*").alias("m")).filter("m > 1").drop("m")
        met = deep.filter("x is not null").join(common.stored(inner, "inner"), [*interval, "x"], "left")
        stays = F.struct(*interval, "doc_id", "i", "start")
        goes = F.struct((F.col("n") + (1 << k)).alias("n"), F.col("g.doc_id").alias("fd"), F.col("g.i").alias("fi"), "doc_id", "i", F.when(F.col("g") != F.struct("doc_id", "i"), F.col("start")).alias("start"))
        places = F.when(F.col("g").isNull(), F.array(stays)).when(F.col("g") == F.struct("doc_id", "i"), F.array(stays, goes)).otherwise(F.array(goes))
        moved = met.select(F.explode(places).alias("p")).select("p.*")
        now = common.stored(moved.unionByName(deep.filter("x is null").select(moved.columns)).unionByName(now.filter(F.col("n") < 2 << k).select(moved.columns)), "intervals")
    return now.filter("fd < doc_id or (fd = doc_id and fi < i)")


def repeated_runs(lines: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame | None:
    """Maximal later copies of runs of lines: doc_id, first line i, n lines, their characters, and where the run occurs first (fd, fi); None if no line repeats.

    lines: sequences(), stored.
    """
    levels = suffix_array(lines)
    if not levels:
        return None
    ends = levels[0].select("doc_id", F.col("i").alias("at"), "end")
    runs = prefixes(levels).withColumn("at", F.col("i") + F.col("n") - 1).join(ends, ["doc_id", "at"])
    return runs.withColumn("chars", F.col("end") - F.col("start")).filter(F.col("chars") >= min_chars).select("doc_id", "i", "n", "chars", "fd", "fi")


def flags(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame | None:
    """For each document (one row each) that loses lines an array that tells for each line whether it goes; None if none does."""
    lines = common.stored(sequences(docs), "lines")
    runs = repeated_runs(lines, min_chars)
    if runs is None:
        return None
    gone = common.stored(runs.select("doc_id", "i", (F.col("i") + F.col("n")).alias("stop")), "gone")
    some = lines.join(gone.select("doc_id").distinct(), "doc_id", "left_semi").select("doc_id", "i")
    so_far = F.max("stop").over(Window.partitionBy("doc_id").orderBy("i").rowsBetween(Window.unboundedPreceding, 0))
    marked = some.join(gone, ["doc_id", "i"], "left").select("doc_id", "i", F.coalesce(so_far > F.col("i"), F.lit(False)).alias("gone"))
    listed = marked.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("i", "gone"))).alias("marks"))
    return common.stored(listed.select("doc_id", F.col("marks.gone").alias("gone")), "flags", keep=True)


def with_flags(docs: DataFrame, min_chars: int) -> DataFrame:
    """Each row of docs as a struct, row, so that its columns can't clash with others, and gone: its flags or null."""
    with common.temporaries(docs.sparkSession):
        single, differ = common.one_text_each(docs)
        found = flags(single, min_chars)
    whole = docs.select(F.struct(*docs.columns).alias("row"))
    if found is None:
        return whole.withColumn("gone", F.lit(None).cast("array<boolean>"))
    # The flags grow with the documents, so they are never broadcast, whatever their size here.
    joined = whole.join(found.hint("merge"), F.col("row.doc_id") == F.col("doc_id"), "left").select("row", "gone")
    return common.where_counted(joined, differ, ["gone"])


def kept_text() -> Column:
    text = F.col("row.text")
    kept = F.filter(lines_of(text), lambda line, at: ~F.element_at("gone", at + 1))
    return F.when(F.col("gone").isNull(), text).otherwise(F.array_join(kept, "\n"))


def delete_repeats(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """docs with the text that is left."""
    return with_flags(docs, min_chars).select(*[kept_text().alias(c) if c == "text" else F.col(f"row.{c}").alias(c) for c in docs.columns])


def op7_line_dedup(spark, sf_dir) -> DataFrame:
    """For each document its lines, how many are deleted in how many runs, and a digest of what is left."""
    docs = with_flags(common.id_and_text(common.documents(spark, sf_dir)), MIN_CHARS)
    gone, text = F.coalesce("gone", F.array().cast("array<boolean>")), F.col("row.text")
    starts = F.filter(gone, lambda x, at: x & ((at == 0) | ~F.element_at(gone, F.greatest(at, F.lit(1)))))
    return docs.select(
        "row.doc_id",
        F.when(text.isNull(), 0).otherwise(F.size(lines_of(text))).cast("long").alias("n_lines"),
        F.size(F.filter(gone, lambda x: x)).cast("long").alias("n_removed"),
        F.size(starts).cast("long").alias("n_runs"),
        F.sha2(F.coalesce(kept_text(), F.lit("")), 256).alias("kept_sha256"),
    )


ORACLE_SQL = f"""
WITH docs AS (SELECT doc_id, text, CASE WHEN text IS NULL THEN [] ELSE string_split(text, chr(10)) END AS lines FROM documents),
starts AS (SELECT doc_id, lines, unnest(range(1, len(lines) + 1)) AS i FROM docs),
runs AS (SELECT doc_id, i, lines, unnest(range(1, len(lines) - i + 2)) AS n FROM starts),
named AS (SELECT doc_id, i, n, md5(to_json(list_slice(lines, i, i + n - 1))::VARCHAR) AS name, len(array_to_string(list_slice(lines, i, i + n - 1), '')) AS chars FROM runs),
ranked AS (SELECT *, row_number() OVER (PARTITION BY name, n ORDER BY doc_id, i) AS k FROM named),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + n)) AS i FROM ranked WHERE k > 1 AND chars >= {MIN_CHARS}),
listed AS (SELECT doc_id, list(i) AS cut, count(*) AS n_removed FROM gone GROUP BY doc_id),
begun AS (SELECT doc_id, count(*) AS n_runs FROM gone AS g WHERE NOT EXISTS (SELECT 1 FROM gone AS p WHERE p.doc_id = g.doc_id AND p.i = g.i - 1) GROUP BY doc_id)
SELECT doc_id, CAST(len(lines) AS BIGINT) AS n_lines, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_runs, 0) AS BIGINT) AS n_runs,
  sha256(coalesce(array_to_string(list_filter(lines, lambda x, j: NOT list_contains(coalesce(cut, []), j)), chr(10)), '')) AS kept_sha256
FROM docs LEFT JOIN listed USING (doc_id) LEFT JOIN begun USING (doc_id)
"""
