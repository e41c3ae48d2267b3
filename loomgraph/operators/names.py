"""Search of names through runs of three characters.

Names are numbered once, in the order that answers are given in. Each run of three characters of a name or full name, in
lower case, posts the number. The rarest runs of a query give candidates, those with the least numbers first, and only candidates
are read and tested. A query without a run of three characters between wildcards scans the numbered names.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.store import GraphStore
from . import scan

RUN = 3
#: Runs of a query whose postings are intersected; the test of candidates sees to the others.
RAREST = 3
#: Candidates that are read by number at first; the others follow, in one join, only if these don't give the answer.
FIRST = 500


@dataclass(frozen=True)
class Index:
    """names (slot, id, kind, name, fqn, file) in the order of slots, postings (gram, slot) and how many of them a gram has (gram, n)."""

    names: DataFrame
    postings: DataFrame
    counts: DataFrame


def numbered(nodes: DataFrame) -> DataFrame:
    """Nodes with slot, which grows in the order of answers; it must be stored before it is used, as each run numbers anew."""
    return nodes.orderBy(F.length("fqn"), "fqn", "id").select(F.monotonically_increasing_id().alias("slot"), "id", "kind", "name", "fqn", "file")


def runs(text: Column) -> Column:
    return F.when(F.length(text) >= RUN, F.transform(F.sequence(F.lit(1), F.length(text) - (RUN - 1)), lambda i: F.substring(text, i, F.lit(RUN)))).otherwise(F.array().cast("array<string>"))


def posted(names: DataFrame) -> DataFrame:
    """(gram, slot) of numbered names, each once; ranges of both, so that a run that all names have is in many files."""
    grams = F.array_distinct(F.concat(runs(F.lower("name")), runs(F.lower("fqn"))))
    order = ("gram", "slot")
    return names.select(F.explode(grams).alias("gram"), "slot").repartitionByRange(*order).sortWithinPartitions(*order)


def counted(postings: DataFrame) -> DataFrame:
    return postings.groupBy("gram").agg(F.count("*").alias("n")).repartitionByRange("gram").sortWithinPartitions("gram")


def keep_index(store: GraphStore) -> Index:
    """The index of the stored graph, which is kept beside it; made if there is none yet."""
    names = store.derived("names", lambda graph: numbered(graph.nodes))
    postings = store.derived("postings", lambda graph: posted(names))
    return Index(names, postings, store.derived("grams", lambda graph: counted(postings)))


def kept_index(store: GraphStore) -> Index | None:
    """The index of the stored graph, if it is there in full."""
    return keep_index(store) if all(store.has(table) for table in ("names", "postings", "grams")) else None


def needed_runs(names: DataFrame, query: str, kind: str | None) -> set[str]:
    """The runs that the name or the full name of each answer has."""
    if kind is None:  # in lower case as the test has it, which is the session's
        lower = names.sparkSession.sql("SELECT lower(:query) AS x", args={"query": f"%{query}%"}).first().x
        pieces = re.split("[%_]", lower)
    else:
        pieces = [query.lower()]
    return {piece[k : k + RUN] for piece in pieces for k in range(len(piece) - RUN + 1)}


def find_symbols(index: Index, query: str, limit: int, kind: str | None = None) -> DataFrame:
    """The rows (id, kind, name, fqn, file) that scan.find_symbols() gives, in its order."""
    names = index.names
    hit = scan.name_test(query, kind)

    def answer(rows: DataFrame) -> DataFrame:
        return rows.filter(hit).orderBy("slot").limit(limit)

    def shown(rows: DataFrame) -> DataFrame:
        return rows.select("id", "kind", "name", "fqn", "file")

    needed = needed_runs(names, query, kind)
    if not needed:
        return shown(answer(names))
    counts = {r.gram: r.n for r in index.counts.filter(F.col("gram").isin(*needed)).collect()}
    if len(counts) < len(needed):
        return shown(names.limit(0))
    rare = sorted(needed, key=lambda gram: (counts[gram], gram))[: 1 if min(counts.values()) <= FIRST else RAREST]
    met = index.postings.filter(F.col("gram").isin(*rare))
    candidates = met.select("slot") if len(rare) == 1 else met.groupBy("slot").agg(F.count("*").alias("n")).filter(F.col("n") == len(rare)).select("slot")
    first = [r.slot for r in candidates.orderBy("slot").limit(FIRST + 1).collect()]
    found = answer(names.filter(F.col("slot").isin(*first[:FIRST])))
    if len(first) > FIRST and found.count() < limit:
        found = answer(names.join(candidates, "slot", "left_semi"))
    return shown(found)
