"""Linking call sites of a frontend to the endpoints that serve them.

The match of routes is an equality join on the verb, the pattern of holes of both sides and the segments
that are literal in both, so it is shuffled by key or broadcast like any equality join, and routes meet only those
that they match. Where routes have many patterns of holes, the trie of the endpoints' routes is walked instead, a segment a join.
Where only the pairs are asked for, and routes have many patterns, chunks of calls meet chunks of endpoints, as bits.

All work is done on different routes: calls that ask for the same route have the same endpoints, so what is stored and shuffled grows with
routes, not with the pairs of calls and endpoints. Pairs are made last, in blocks, by those who ask for them.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import routes
from ..schema import Graph
from ..sources.scratch import blocks, dealt, one_by_one, rows_of, sized, stored
from ..sources.store import packed

OUTCOMES = ("Unique", "PrecedenceResolved", "SetEdge", "VerbMismatch", "NoSkeletonMatch", "UnknownVerb")
#: Put before a call site's template: frontends call under this path.
API_PREFIX = "/api"
#: Patterns of holes, of all lengths, up to which a route is joined once for each; both ways give the same rows.
PATTERNS = 64
#: Calls, or endpoints, of a chunk, about, and how many chunks there are at least, if each then has so many.
CHUNK, CHUNKS, SMALL = 1 << 17, 8, 4096
#: Bits that are kept, and pairs that are made, at once, and partitions that pairs of chunks are dealt out to at most.
BITS, PAIRS, DEALT = 1 << 28, 1 << 22, 20_000


@dataclass(frozen=True)
class Links:
    """Calls (call_id, route), outcomes (route, outcome) of all their routes, and of each route endpoints and conflicts (route, endpoint_id)."""

    calls: DataFrame
    outcomes: DataFrame
    endpoints: DataFrame
    conflicts: DataFrame


def call_routes(nodes: DataFrame, prefix: str = API_PREFIX) -> DataFrame:
    """(call_id, verb, skeleton, segs) of call sites."""
    own = nodes.filter(F.col("kind") == "FrontendCallSite")
    skeleton = routes.skeleton(F.concat(F.lit(prefix), F.col("name")))
    return own.select(F.col("id").alias("call_id"), routes.verb(F.col("fqn")).alias("verb"), skeleton.alias("skeleton")).withColumn("segs", routes.segments(F.col("skeleton")))


def endpoint_routes(nodes: DataFrame) -> DataFrame:
    """(endpoint_id, endpoint_verb, endpoint_segs) of endpoints."""
    own = nodes.filter(F.col("kind") == "Endpoint")
    return own.select(F.col("id").alias("endpoint_id"), routes.verb(F.col("fqn")).alias("endpoint_verb"), routes.segments(routes.skeleton(F.col("name"))).alias("endpoint_segs"))


def masked(rows: DataFrame, segs: str, own: str) -> DataFrame:
    """Rows with n, the number of segments, and own, which of them are holes, as digits."""
    digits = F.array_join(F.transform(segs, lambda s: F.when(s == routes.HOLE, "1").otherwise("0")), "")
    return rows.withColumn("n", F.size(segs)).withColumn(own, digits)


def with_keys(rows: DataFrame, segs: str, patterns: DataFrame, other: str) -> DataFrame:
    """Each row with each pattern of the other side of its length, and key: its segments with the holes of both."""
    key = F.transform(segs, lambda s, i: F.when(F.substring(other, i + 1, F.lit(1)) == "1", F.lit(routes.HOLE)).otherwise(s))
    return rows.join(sized(patterns), "n").withColumn("key", F.array_join(key, "/"))


def trie(ends: DataFrame, keys: list[str]) -> DataFrame:
    """The nodes below each node of the trie of routes (keys, endpoint_segs): depth, parent and node, which are routes up to there, and key.

    A node is listed under its own segment, and under "any" for calls with a hole there.
    """
    upto = lambda depth: F.array_join(F.slice("endpoint_segs", F.lit(1), depth), "/")
    each = ends.select(*keys, "endpoint_segs", F.explode(F.sequence(F.lit(1), F.size("endpoint_segs"))).alias("depth"))
    nodes = each.select(*keys, "depth", upto(F.col("depth") - 1).alias("parent"), upto(F.col("depth")).alias("node"), F.element_at("endpoint_segs", F.col("depth")).alias("seg")).distinct()
    return nodes.select(*keys, "depth", "parent", "node", F.explode(F.array(F.concat(F.lit("="), "seg"), F.lit("any"))).alias("key"))


def walked(calls: DataFrame, endpoints: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, segs, end) of the different routes that match: end is the endpoint's.

    All calls walk down the trie together. At a node a call goes on to the nodes of its segment and of a hole, or, if it has
    a hole there itself, to all. Rows are the beginnings of routes that match so far, each once, whatever patterns there are.
    """
    below = stored(trie(endpoints.select(*keys, "endpoint_segs").distinct(), keys), "trie")
    there = sized(below)
    longest = below.agg(F.max("depth")).first()[0] or 0
    state = calls.select(*keys, "segs", F.lit("").alias("parent")).distinct()
    ended = []
    for depth in range(1, longest + 1):
        seg = F.element_at("segs", depth)
        wanted = F.when(seg == routes.HOLE, F.array(F.lit("any"))).otherwise(F.array(F.concat(F.lit("="), seg), F.lit(f"={routes.HOLE}")))
        steps = state.filter(F.col("n") >= depth).withColumn("key", F.explode(wanted))
        state = stored(steps.join(there.filter(F.col("depth") == depth).drop("depth"), [*keys, "parent", "key"]).select(*keys, "segs", F.col("node").alias("parent")), "walk")
        if not rows_of(state):
            break
        ended.append(state.filter(F.col("n") == depth))
    if not ended:
        return state.limit(0).withColumnRenamed("parent", "end")
    return reduce(DataFrame.unionByName, ended).withColumnRenamed("parent", "end")


def different(rows: DataFrame, verb: str | None, segs: str, name: str) -> DataFrame:
    """The different routes of rows: name, the verb, if one is given, and segments."""
    return named(rows, verb, segs, name).select(name, *([F.col(verb).alias("verb")] if verb else []), segs).distinct()


def named(rows: DataFrame, verb: str | None, segs: str, name: str) -> DataFrame:
    """Rows with the name of their route: the verb, if one is given, and the path."""
    return rows.withColumn(name, F.concat_ws(" ", *([verb] if verb else []), F.array_join(segs, "/")))


def route_pairs(own: DataFrame, other: DataFrame, same_verb: bool) -> DataFrame:
    """(route, segs, end, endpoint_segs): routes of calls and of endpoints, as different() names them, that match.

    Where routes have few patterns of holes, as they do, a row stands for each of the other side's patterns, and
    routes match if all segments that are literal in both are equal: one equality join, whose keys are as many as routes.
    Where they have many, the pairs come from walked().
    """
    own, other, ours, theirs = patterned(own, other)
    verb = ["verb"] if same_verb else []
    if many(ours, theirs):
        pairs = walked(own, other, ["n", *verb]).withColumn("endpoint_segs", routes.segments(F.col("end")))
        return named(named(pairs, *(verb or [None]), "segs", "route"), *(verb or [None]), "endpoint_segs", "end").select("route", "segs", "end", "endpoint_segs")
    left, right = with_keys(own, "segs", theirs, "endpoint_mask"), with_keys(other, "endpoint_segs", ours, "mask")
    return left.join(right, ["n", *verb, "mask", "endpoint_mask", "key"]).select("route", "segs", "end", "endpoint_segs")


def patterned(own: DataFrame, other: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Both sides with their patterns of holes, and the different patterns of each, stored."""
    own, other = masked(own, "segs", "mask"), masked(other, "endpoint_segs", "endpoint_mask")
    theirs, ours = (stored(rows.select("n", mask).distinct(), "masks") for rows, mask in ((other, "endpoint_mask"), (own, "mask")))
    return own, other, ours, theirs


def many(ours: DataFrame, theirs: DataFrame) -> bool:
    """Whether patterns are too many for a join for each."""
    return max(rows_of(theirs), rows_of(ours)) > PATTERNS


def chunked(rows: DataFrame, keys: list[str], segs: str, key: str, name: str) -> tuple[DataFrame, int]:
    """rows (keys, segs, key), stored, as rows (keys, at, name), and how many chunks, numbered by at, they are dealt out to by route.

    name is an array of different routes, each with its keys, or some of them if they are many.
    """
    n = rows_of(rows)
    parts = max(1, -(-n // CHUNK), min(CHUNKS, n // SMALL))
    lists = blocks(rows.select(F.struct(*keys, F.col(segs).alias("segs")).alias("route"), key), "route", key).select("route.*", F.col(key).alias("ids"))
    at = F.pmod(F.xxhash64("segs", F.array_min("ids")), F.lit(parts)).alias("at")
    return stored(lists.groupBy(*keys, at).agg(F.sort_array(F.collect_list(F.struct("segs", "ids"))).alias(name)), "chunks"), parts


def codes(routes_: pa.Array, values: dict, n: int) -> np.ndarray:
    """The numbers of the segments of routes, one row a route: 0 a hole, -1 null, others from 1 as values gives and gets them."""
    words = routes_.flatten().dictionary_encode()
    number = np.array([values.setdefault(w, len(values)) for w in words.dictionary.to_pylist()] + [-1], dtype=np.int64)
    return number[words.indices.fill_null(len(number) - 1).to_numpy(zero_copy_only=False)].reshape(-1, n)


def led_to(calls: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """For each call a row of bits, one an endpoint, of the routes that match, all given as codes()."""
    found, width = None, -(-len(ends) // 8)
    for half in np.array_split(np.arange(calls.shape[1]), 2):
        if not half.size:
            continue
        # Few halves of routes differ; bits are united once for each that does.
        parts, place = np.unique(calls[:, half], axis=0, return_inverse=True)
        bits = np.full((len(parts), width), 255, dtype=np.uint8)
        for k, at in enumerate(half):
            own, which = np.unique(parts[:, k], return_inverse=True)
            fits = np.repeat(np.packbits(ends[:, at] == 0)[None, :], len(own), axis=0)
            row = np.minimum(np.searchsorted(own, ends[:, at]), len(own) - 1)
            same = np.flatnonzero((own[row] == ends[:, at]) & (ends[:, at] > 0))
            np.bitwise_or.at(fits, (row[same], same >> 3), (128 >> (same & 7)).astype(np.uint8))
            fits[own == 0] = 255
            bits &= fits[which.reshape(-1)]
        found = bits[place.reshape(-1)] if found is None else found & bits[place.reshape(-1)]
    return found


def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(call_id, endpoint_id), arrays of both, of rows (calls, endpoints) of chunked(): the calls of a route and what they lead to, if anything."""
    for batch in batches:
        for calls, ends in zip(batch.column("calls"), batch.column("endpoints")):
            calls, ends, values = calls.values, ends.values, {routes.HOLE: 0}
            n = len(calls.field("segs")[0])
            own, other = codes(calls.field("segs"), values, n), codes(ends.field("segs"), values, n)
            call_ids, ids = calls.field("ids"), ends.field("ids")
            sizes, flat = np.asarray(ids.value_lengths(), dtype=np.int64), ids.flatten()
            starts = np.cumsum(sizes) - sizes
            rows, step = max(1, BITS // len(other)), max(1, PAIRS // len(flat))
            for top in range(0, len(own), rows):
                bits = led_to(own[top : top + rows], other)
                for first in range(0, len(bits), step):
                    found = np.flatnonzero(np.unpackbits(bits[first : first + step], axis=1, count=len(other)))
                    if not found.size:
                        continue
                    row, end = np.divmod(found, len(other))
                    each = sizes[end]
                    upto = np.concatenate([[0], np.cumsum(each)])
                    taken = flat.take(pa.array(np.repeat(starts[end] - upto[:-1], each) + np.arange(upto[-1])))
                    at = np.flatnonzero(np.diff(row, prepend=-1))
                    lists = pa.ListArray.from_arrays(pa.array(upto[np.append(at, len(row))].astype(np.int32)), taken)
                    yield pa.RecordBatch.from_arrays([call_ids.take(pa.array(row[at] + top + first)), lists], ["call_id", "endpoint_id"])


def meets(calls: DataFrame, endpoints: DataFrame, same_verb: bool) -> DataFrame:
    """(call_id, endpoint_id): call sites and the endpoints whose routes they match.

    Where routes have many patterns of holes, the pairs are most of the work, as they may grow with calls times endpoints. Then each
    chunk of calls meets each of endpoints of its length and verb, and pairs are made in the task they meet in; none is stored or shuffled.
    """
    verbs = ("verb", "endpoint_verb") if same_verb else (None, None)
    calls, endpoints = stored(named(calls, verbs[0], "segs", "route"), "calls"), stored(named(endpoints, verbs[1], "endpoint_segs", "end"), "endpoints")
    own, other = different(calls, verbs[0], "segs", "route"), different(endpoints, verbs[1], "endpoint_segs", "end")
    if many(*patterned(own, other)[2:]):
        return unfolded(calls, endpoints.withColumnRenamed("endpoint_verb", "verb"), ["n", "verb"] if same_verb else ["n"])
    pairs = stored(route_pairs(own, other, same_verb).select("route", "end"), "pairs")
    return expanded(calls.select("call_id", "route"), pairs.join(endpoints.select("end", "endpoint_id"), "end").select("route", "endpoint_id"))


def unfolded(calls: DataFrame, endpoints: DataFrame, keys: list[str]) -> DataFrame:
    """meets() where there are many patterns: of calls (keys but n, segs, call_id) and endpoints (keys but n, endpoint_segs, endpoint_id)."""
    sides = []
    for rows, segs, key, name in ((calls, "segs", "call_id", "calls"), (endpoints, "endpoint_segs", "endpoint_id", "endpoints")):
        own = stored(rows.withColumn("n", F.size(segs)).filter("n > 0").select(*keys, segs, key), "routes")
        sides.append(chunked(own, keys, segs, key, name))
    (left, i), (right, j) = sides
    # Each chunk goes to all of the other side; partitions are more than pairs, so that few share one.
    every = lambda n: one_by_one(F.sequence(F.lit(0), F.lit(n - 1)))
    spread = min(4 * i * j, DEALT)
    left = left.select(*keys, F.col("at").alias("i"), every(j).alias("j"), "calls").repartition(spread, *keys, "i", "j")
    right = right.select(*keys, every(i).alias("i"), F.col("at").alias("j"), "endpoints").repartition(spread, *keys, "i", "j")
    kinds = dict(calls.dtypes)["call_id"], dict(endpoints.dtypes)["endpoint_id"]
    both = left.hint("merge").join(right, [*keys, "i", "j"]).select("calls", "endpoints")
    out = both.mapInArrow(met, f"call_id array<{kinds[0]}>, endpoint_id array<{kinds[1]}>")
    return out.select(one_by_one("call_id").alias("call_id"), "endpoint_id").select("call_id", one_by_one("endpoint_id").alias("endpoint_id"))


def expanded(calls: DataFrame, endpoints: DataFrame) -> DataFrame:
    """(call_id, endpoint_id) of calls (call_id, route) and what their routes lead to (route, endpoint_id).

    Blocks of both meet and are dealt out before they are unfolded, so the pairs themselves are neither shuffled nor all in the task of a route.
    """
    both = blocks(calls, "route", "call_id").join(blocks(endpoints, "route", "endpoint_id"), "route").select("call_id", "endpoint_id")
    return dealt(both).select(one_by_one("call_id").alias("call_id"), "endpoint_id").select("call_id", one_by_one("endpoint_id").alias("endpoint_id"))


def resolved(pairs: DataFrame, counts: DataFrame) -> DataFrame:
    """(route, n, winner) of routes with pairs (route, segs, end, endpoint_segs): how many endpoints they have, and the end that literal precedence chooses, or null.

    Ends are compared where their segments differ; if the call is literal there, the one whose literals come first wins, if
    it is of one endpoint. counts: (end, n) endpoints of each end.
    """
    rows = pairs.join(counts, "end")
    spots = rows.select("route", F.posexplode("endpoint_segs").alias("spot", "seg")).groupBy("route", "spot").agg(F.min("seg").alias("least"), F.max("seg").alias("most"))
    differing = spots.filter("least <> most").groupBy("route").agg(F.array_sort(F.collect_list("spot")).alias("differing"))
    at = lambda segs: F.transform("differing", lambda i: F.when(F.get(segs, i) == routes.HOLE, "1").otherwise("0"))
    compared = rows.join(differing, "route").filter(~F.array_contains(at("segs"), "1"))
    scores = compared.groupBy("route", F.array_join(at("endpoint_segs"), "").alias("score")).agg(F.sum("n").alias("n"), F.min("end").alias("end"))
    best = scores.groupBy("route").agg(F.min(F.struct("score", "n", "end")).alias("best")).filter("best.n = 1").select("route", F.col("best.end").alias("winner"))
    return rows.groupBy("route").agg(F.sum("n").alias("n")).join(best, "route", "left")


def links(nodes: DataFrame, prefix: str = API_PREFIX) -> Links:
    """Outcomes, endpoints and conflicts of the routes of call sites."""
    calls = stored(named(call_routes(nodes, prefix), "verb", "segs", "route"), "calls")
    endpoints = stored(named(endpoint_routes(nodes), "endpoint_verb", "endpoint_segs", "end").withColumn("path", F.array_join("endpoint_segs", "/")), "endpoints")
    asked = stored(different(calls, "verb", "segs", "route").filter(F.col("verb") != "UNKNOWN"), "asked")
    pairs = stored(route_pairs(asked, different(endpoints, "endpoint_verb", "endpoint_segs", "end"), same_verb=True), "pairs")
    found = stored(resolved(pairs, endpoints.groupBy("end").agg(F.count("*").alias("n"))), "resolved")
    outcome = F.when(F.col("n") == 1, "Unique").when(F.col("winner").isNotNull(), "PrecedenceResolved").otherwise("SetEdge")
    matched = found.select("route", outcome.alias("outcome"))
    chosen = pairs.join(found.select("route", "winner"), "route").filter(F.col("winner").isNull() | (F.col("winner") == F.col("end")))
    targets = chosen.select("route", "end").join(endpoints.select("end", "endpoint_id"), "end").select("route", "endpoint_id")
    unmatched = stored(asked.join(found.select("route"), "route", "left_anti"), "unmatched")
    paths = unmatched.select(F.array_join("segs", "/").alias("path"), "segs")
    other = stored(route_pairs(paths.select(F.col("path").alias("route"), "segs").distinct(), different(endpoints, None, "endpoint_segs", "end"), same_verb=False).select(F.col("route").alias("path"), "end"), "conflicts")
    named_paths = unmatched.select("route", F.array_join("segs", "/").alias("path"))
    conflicts = named_paths.join(other, "path").select("route", F.col("end").alias("path")).join(endpoints.select("path", "endpoint_id"), "path").select("route", "endpoint_id")
    missed = named_paths.join(other.select("path").distinct().withColumn("met", F.lit(True)), "path", "left").select("route", F.when(F.col("met"), "VerbMismatch").otherwise("NoSkeletonMatch").alias("outcome"))
    unknown = calls.filter(F.col("verb") == "UNKNOWN").select("route", F.lit("UnknownVerb").alias("outcome")).distinct()
    return Links(calls.select("call_id", "route"), matched.unionByName(missed).unionByName(unknown), targets, conflicts)


def call_outcomes(found: Links) -> DataFrame:
    """(call_id, route, outcome) of all call sites."""
    return found.calls.join(found.outcomes, "route").select("call_id", "route", "outcome")


def listed(rows: DataFrame, targets: DataFrame, nodes: DataFrame) -> DataFrame:
    """(route, names): of the routes of rows the sorted full names of their targets (route, endpoint_id), where there are any."""
    wanted = targets.join(rows.select("route").distinct(), "route", "left_semi")
    each = wanted.join(nodes.select(F.col("id").alias("endpoint_id"), "fqn"), "endpoint_id")
    return each.groupBy("route").agg(F.array_sort(F.collect_list("fqn")).alias("names"))


def link(nodes: DataFrame, prefix: str = API_PREFIX) -> DataFrame:
    """For each call site (call_id) outcome, endpoints and conflicts: sorted arrays of endpoint ids. Calls of one route repeat its arrays; links() has them once."""
    found = links(nodes, prefix)
    rows = call_outcomes(found)
    for name, targets in (("endpoints", found.endpoints), ("conflicts", found.conflicts)):
        rows = rows.join(targets.groupBy("route").agg(F.array_sort(F.collect_list("endpoint_id")).alias(name)), "route", "left")
    none = F.array().cast("array<string>")
    return rows.select("call_id", "outcome", F.coalesce("endpoints", none).alias("endpoints"), F.coalesce("conflicts", none).alias("conflicts"))


def link_edges(found: Links, towards: DataFrame | None = None, as_bytes: bool = False) -> DataFrame:
    """CallsEndpoint edges of the results of links(); only those that lead to some endpoints (column id), if they are given. as_bytes: with ids as packed() makes them."""
    calls, targets = found.calls, found.endpoints if towards is None else found.endpoints.join(towards.select(F.col("id").alias("endpoint_id")), "endpoint_id", "left_semi")
    if as_bytes:
        calls, targets = calls.select(packed("call_id"), "route"), targets.select("route", packed("endpoint_id"))
    return expanded(calls, targets).select(F.col("call_id").alias("source_id"), F.col("endpoint_id").alias("target_id"), F.lit("CallsEndpoint").alias("kind"))


def relinked(graph: Graph, prefix: str = API_PREFIX, towards: DataFrame | None = None, as_bytes: bool = False) -> tuple[Graph, DataFrame]:
    """The graph with fresh CallsEndpoint edges, as link_edges() gives them, and (call_id, route, outcome) of call sites. as_bytes: edges have ids as packed() makes them, which a save takes as they are."""
    found = links(graph.nodes, prefix)
    ends = [packed(c) if as_bytes else c for c in ("source_id", "target_id")]
    edges = graph.edges.filter(F.col("kind") != "CallsEndpoint").select(*ends, "kind")
    return Graph(graph.nodes, edges.unionByName(link_edges(found, towards, as_bytes))), call_outcomes(found)


def outcome_counts(linked: DataFrame) -> DataFrame:
    """(outcome, n) for all six outcomes."""
    names = linked.sparkSession.createDataFrame([(x,) for x in OUTCOMES], "outcome string")
    return F.broadcast(names).join(linked.groupBy("outcome").agg(F.count("*").alias("n")), "outcome", "left").select("outcome", F.coalesce("n", F.lit(0)).cast("long").alias("n"))
