"""Each stage of the pipeline against a brute-force version of it, on the stage's own input."""

import random

import corpus_pipeline
from pyspark.sql import functions as F
from test_corpus import plain_bytes, plain_components, plain_lines

from loomgraph.llm import common, substrings


def test_stages(spark, small):
    docs = common.documents(spark, small)
    columns, seen = docs.columns, []
    for name, stage in corpus_pipeline.STAGES:
        before = {r.doc_id: r for r in docs.collect()}
        docs = common.stored(stage(spark, docs, small), name)
        rows = docs.collect()
        seen.append(name)
        if name == "packing":
            assert {r.doc_id for r in rows} == set(before)
            break
        assert docs.columns == columns
        after = {r.doc_id: r for r in rows}
        assert all(r.n_chars == len(r.text) for r in rows)
        texts = {i: r.text or "" for i, r in before.items()}
        if name == "language":
            assert set(after) == {i for i, t in texts.items() if any(c.isalpha() for c in t)}
        if name == "lines":
            want = {i: t for i, t in plain_lines(texts, 40).items() if t.encode().split()}
            assert {i: r.text for i, r in after.items()} == want
        if name == "near_duplicates":
            assert set(after) == {i for i, (_, top) in plain_components(texts).items() if i == top}
        if name == "passages":
            want = plain_bytes(texts)
            for i, r in after.items():
                assert len(r.text.encode()) <= want[i][0] - want[i][1]
                assert want[i][0] - want[i][1] - len(r.text.encode()) < 8
            assert all(want[i][1] for i in set(before) - set(after))
    assert seen == [n for n, _ in corpus_pipeline.STAGES]


def test_characters_that_are_cut_apart_go(spark):
    r = random.Random(1)
    passage = "".join(r.choice("éèêàüñçö") for _ in range(120))
    rows = [(1, passage + "é first"), (2, "x" + passage + "è second"), (3, passage)]
    kept = {r.doc_id: r.text for r in substrings.delete_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert kept == {1: passage + "é first", 2: "x second"}
    assert substrings.delete_repeats(spark.createDataFrame(rows, "doc_id long, text string").withColumn("extra", F.lit(1))).columns == ["doc_id", "text", "extra"]


def test_stages_with_odd_rows(spark, small):
    docs = common.documents(spark, small)
    schema = docs.schema.add("key", "string").add("row", "string").add("id", "long")
    long = " ".join(f"word{k}" for k in range(80)) + "."
    copy = "Another text that is here twice, in rows of one document, and is long enough to be found."
    rows = [(1, long), (1, long), (2, long + " and a tail"), (None, long), (None, "A text of its own without any number, quite short."), (3, None), (4, ""), (5, "12 34"), (6, copy), (7, copy), (7, copy), (8, "First of two texts."), (8, "Second of two texts.")]
    frame = spark.createDataFrame([(i, t, "en", "s", len(t or ""), "k", "r", 1) for i, t in rows], schema)
    kept = frame
    for name, stage in corpus_pipeline.STAGES[:4]:
        kept = common.stored(stage(spark, kept, small), name)
        assert kept.columns == frame.columns
        if name == "lines":
            assert sorted((r.doc_id or 0, r.text) for r in kept.collect())[:2] == [(0, "A text of its own without any number, quite short."), (0, long)]
    got = sorted((r.doc_id or 0, r.text) for r in kept.collect())
    assert got == [(0, "A text of its own without any number, quite short."), (1, long), (6, copy), (8, "First of two texts.")]
    pieces = corpus_pipeline.packed(spark, kept, small).collect()
    assert {p.doc_id for p in pieces} == {None, 1, 6, 8}
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, frame.limit(0), small).collect() == []


def test_a_text_of_many_languages_goes(spark, small):
    """The scores of the network decide: a text of which no language has much goes, its parts stay."""
    docs = common.documents(spark, small)
    parts = [r.part for r in docs.filter("length(text) > 1000").groupBy("lang").agg(F.substring(F.min_by("text", "doc_id"), 1, 900).alias("part")).collect()]
    assert len(parts) >= 4
    rows = [(10_000_002, " ".join(parts))] + [(20_000_000 + k, p) for k, p in enumerate(parts)]
    own = spark.createDataFrame(rows, "doc_id long, text string")
    missing = [F.lit(None).cast(f.dataType).alias(f.name) for f in docs.schema if f.name not in own.columns]
    kept = corpus_pipeline.known_language(spark, docs.unionByName(own.select("*", *missing).select(docs.columns)), small)
    assert sorted(r.doc_id for r in kept.filter("doc_id >= 10000000").select("doc_id").collect()) == [i for i, _ in rows[1:]]
