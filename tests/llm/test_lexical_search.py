"""Ranked search against scoring every document."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from strataloom.llm import lexical_search as ls
from strataloom.llm import queries as q

from .helpers import documents, lower_az

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def plain(docs, items, k=20):
    """(item, rank, doc, score), sorted; docs and items are (id, text) in any order."""
    counts = [(i, Counter(TERM.findall(lower_az(t)))) for i, t in docs]
    n, total = sum(bool(c) for _, c in counts), sum(c.total() for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    weight = {t: math.floor(1000 * math.log((2 * n + 2) / (2 * x + 1))) for t, x in df.items()}
    out = []
    for item, text in items:
        scored = []
        for i, c in counts:
            m = 75 + (25 * c.total() * n) // max(total, 1)
            score = sum(weight[t] * ((1_000_000_000 * c[t]) // (1000 * c[t] + 12 * m)) for t in TERM.findall(lower_az(text)) if t in c)
            if score > 0:
                scored.append((-score, i is not None, i or 0, i))
        out += [(item, r, i, -s) for r, (s, _, _, i) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=repr)


def result(df):
    return sorted(((r.item_id, r["rank"], r.doc_id, r.score) for r in df.collect()), key=repr)


def test_whole_tables_equal_scoring_everything(spark, sf_dir):
    docs = [(r.doc_id, r.text) for r in q.table(spark, sf_dir, "documents").collect()]
    items = [(r.item_id, r.text) for r in q.table(spark, sf_dir, "benchmark").collect()]
    got = q.op12_lexical_search(spark, sf_dir)
    assert dict(got.dtypes)["rank"] == "int"
    assert result(got) == plain(docs, items)


@pytest.mark.parametrize("seed", range(2))
def test_many_small_shards_and_query_blocks(spark, seed):
    """Words of steep frequency, ties, copies, small shards, more query blocks than one."""
    rnd = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(60)] + ["Straße", "été", "数据", "x_y", "a-b"]
    weights = [1 / (i + 1) for i in range(len(vocabulary))]
    text = lambda n: " ".join(rnd.choices(vocabulary, weights, k=n))
    docs = [(i, text(rnd.randrange(1, 60))) for i in range(250)]
    docs += [(1000 + i, docs[7][1]) for i in range(40)] + [(None, docs[8][1]), (None, None), (5, ""), (5, "... !"), (6, docs[7][1].upper())]
    items = [(i, text(rnd.randrange(1, 12))) for i in range(20)] + [(50, None), (51, ""), (52, "unknown words"), (None, "w1 w2"), (3, "w1 w1 w3")]
    frame = documents(spark, docs).repartition(3)
    asked = spark.createDataFrame(items, "item_id long, text string").withColumn("query", F.lit(1)).withColumn("terms", F.lit("x"))
    n, total = ls.corpus_size(frame)
    index = ls.build_index(frame, n, total, shard_bytes=2_000)
    assert index.select("shard").distinct().count() > 5
    assert result(ls.search(index, n, asked, k=5, block_terms=30)) == plain(docs, items, 5)


def test_nothing_to_find(spark):
    asked = spark.createDataFrame([(1, "word")], "item_id long, text string")
    for rows in ([], [(1, None)], [(1, "other")]):
        assert ls.rank(documents(spark, rows) if rows else documents(spark, [(1, "")]).limit(0), asked).collect() == []
    assert ls.rank(documents(spark, [(1, "word")]), asked.limit(0)).collect() == []


def test_long_text_and_wide_counts(spark):
    """Counts beyond a byte and gaps beyond a byte within a block."""
    docs = [(i, "filler") for i in range(700)] + [(700, "rare " * 70_000), (701, "rare word"), (702, "word " * 300)]
    items = [(1, "rare word"), (2, "filler rare")]
    frame = documents(spark, docs)
    assert result(ls.rank(frame.coalesce(1), spark.createDataFrame(items, "item_id long, text string"))) == plain(docs, items)


def test_blocks_are_rejected_undecoded():
    """A rare term fills the result; of the frequent one's blocks only those of survivors are decoded."""
    rnd = random.Random(1)
    shard = ls._Shard()
    for i in range(20_000):
        shard.add(i, ("common " + ("rare " if i % 400 == 7 else "") + "x " * rnd.randrange(5, 50)).encode())
    n, total = 20_000, len(shard.terms)
    rows = [r for batch in shard.rows(0, n, total) for r in batch.to_pylist()]
    norms = next(r for r in rows if r["term"] is None)
    searcher = ls.Searcher(np.frombuffer(norms["places"], "<i8"), np.frombuffer(norms["first"], bool), np.frombuffer(norms["counts"], "<i8"), 20)
    postings = [ls.Postings(w, *(r[c] for c in ("n", "top", "first", "best", "places", "counts"))) for r in rows for w in [{"rare": 5000, "common": 3}.get(r["term"])] if w]
    places, scores = searcher.best(postings)
    assert len(places) == 20 and all(p % 400 == 7 for p in places)
    assert searcher.decoded < searcher.all / 2
    assert not searcher.scores.any()
