import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from strataloom.llm import language_id as l

from .helpers import documents


def corpus(seed, n):
    rnd = random.Random(seed)
    parts = {"en": ["the", "th", "ing", "and"], "de": ["sch", "ung", "ein", "ß"], "fr": ["eau", "é", "oui", "ç"]}
    return [(i, " ".join("".join(rnd.choice(parts[x]) for _ in range(3)) for _ in range(20)), x) for i in range(n) for x in [rnd.choice(list(parts))]]


def test_held_out_accuracy(spark):
    docs = documents(spark, corpus(1, 300))
    held = l.held_out()
    model = l.train(docs.filter(~held))
    out = l.predict(spark, docs, model).join(docs.select("doc_id", "lang"), "doc_id").withColumn("held", held).collect()
    assert all(r.held == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in out)
    assert sum(r.lang == r.lang_pred for r in out if r.held) == sum(r.held for r in out)
    assert all(0 <= r.score <= 1 for r in out)


def test_nothing_to_read_or_learn(spark):
    docs = documents(spark, [(1, None), (2, ""), (3, "123 !!"), (4, "the thing", None), (4, "the thing", None), (None, "thand")])
    none = l.train(docs.filter("lang IS NULL"))
    assert none.langs == [] and {r.lang_pred for r in l.predict(spark, docs, none).collect()} == {"und"}
    model = l.train(documents(spark, corpus(2, 50)))
    out = {r.doc_id: r for r in l.predict(spark, docs.withColumn("score", F.lit(1)), model).collect()}
    assert [out[i].lang_pred for i in (1, 2, 3)] == ["und"] * 3 and out[1].score == 0.0
    assert out[4].lang_pred == "en" and out[None].lang_pred == "en"
    assert l.predict(spark, documents(spark, []), model).collect() == []


def test_long_text_and_counts(spark):
    text = "The Thing " * 50_000
    assert len(l.ngrams(text, 1 << 10, (1, 2, 3))) == 3 * (len(text) + 1) - 3
    assert l.predict(spark, documents(spark, [(1, text)]), l.train(documents(spark, corpus(3, 40)))).first().lang_pred == "en"


def plain_bayes(train, texts, buckets, orders, smoothing):
    """Multinomial naive Bayes by the textbook, with the operator's own buckets, one n-gram at a time."""
    sums, seen = {}, {}
    for text, lang in train:
        seen[lang] = seen.get(lang, 0) + 1
        table = sums.setdefault(lang, [0] * buckets)
        for b in l.ngrams(text, buckets, orders).tolist():
            table[b] += 1
    langs, out = sorted(sums), []
    for text in texts:
        total = {}
        for x in langs:
            whole = sum(sums[x]) + smoothing * buckets
            total[x] = math.log(seen[x] / sum(seen.values())) + sum(math.log((sums[x][b] + smoothing) / whole) for b in l.ngrams(text, buckets, orders).tolist())
        best = max(langs, key=lambda x: (total[x], [-ord(c) for c in x]))
        out.append((best, 1 / sum(math.exp(total[x] - total[best]) for x in langs)))
    return out


def test_scores_match_plain_naive_bayes(spark, monkeypatch):
    train = [(t, x) for _, t, x in corpus(5, 40)]
    rnd = random.Random(6)
    texts = [t[: rnd.randrange(3, 12)] for _, t, _ in corpus(7, 60)] + ["x", "Zzz 12 zz", "the eau ung " * 400]
    model = l.train(documents(spark, [(i, t, x) for i, (t, x) in enumerate(train)]), buckets=256, smoothing=0.5)
    want = plain_bayes(train, texts, 256, (1, 2, 3), 0.5)
    got = {r.doc_id: r for r in l.predict(spark, documents(spark, list(enumerate(texts))), model).collect()}
    assert [got[i].lang_pred for i in range(len(texts))] == [x for x, _ in want]
    assert np.allclose([got[i].score for i in range(len(texts))], [p for _, p in want], atol=1e-4)
    # Slices change nothing, wherever they cut.
    import pyarrow as pa

    monkeypatch.setattr(l, "SLICE", 50)
    langs, scores = l.predict_batch(model, pa.array([None, *texts, ""]))
    assert langs == ["und", *[x for x, _ in want], "und"] and np.allclose(scores[1:-1], [p for _, p in want], atol=1e-4)


def test_too_many_languages(spark, monkeypatch):
    monkeypatch.setattr(l, "MAX_LANGUAGES", 2)
    with pytest.raises(ValueError):
        l.train(documents(spark, corpus(1, 60)))
