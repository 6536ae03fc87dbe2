import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from strataloom.llm import mixing

from .helpers import documents


def test_shortage_goes_to_siblings_before_ancestors(spark):
    leaves = spark.createDataFrame([("a", "en", "s1", 10), ("a", "en", "s2", 1000), ("a", "de", "s3", 1000), ("b", "en", "s4", 1000)], "domain string, lang string, source string, tokens long")
    out = {r.source: r.budget for r in mixing.leaf_budgets(leaves, 400).collect()}
    # a and b have 200 each; en and de of a 100 each; s1 can give 10 only, and s2 takes what it lacks.
    assert out == {"s1": 10, "s2": 90, "s3": 100, "s4": 200}
    out = {r.source: r.budget for r in mixing.leaf_budgets(leaves.filter("source <> 's2'"), 400).collect()}
    assert out == {"s1": 10, "s3": 190, "s4": 200}
    out = {r.source: r.budget for r in mixing.leaf_budgets(leaves.filter("source NOT IN ('s2', 's3')"), 400).collect()}
    assert out == {"s1": 10, "s4": 390}


def test_epochs_and_weights(spark):
    leaves = spark.createDataFrame([("a", "en", "s1", 100), ("a", "en", "s2", 100)], "domain string, lang string, source string, tokens long")
    out = {r.source: (r.budget, r.full_epochs, r.rest) for r in mixing.leaf_budgets(leaves, 400, weights={"source": {"s1": 3}}, max_epochs=3).collect()}
    assert out == {"s1": (300, 3, 0), "s2": (100, 1, 0)}
    out = {r.source: r.budget for r in mixing.leaf_budgets(leaves, 400, weights={"source": {"s1": 0}}, max_epochs=2).collect()}
    assert out == {"s2": 200}
    with pytest.raises(ValueError):
        mixing.leaf_budgets(leaves, 1, weights={"source": {"s1": -1}})


@pytest.mark.parametrize("broadcast", [True, False])
def test_prefix_matches_brute_force(spark, monkeypatch, broadcast):
    if not broadcast:
        monkeypatch.setattr(mixing, "BROADCAST_LEAVES", 0)
    rnd = random.Random(2)
    docs = [(i, " ".join(["w"] * rnd.randint(0, 9)) if i % 17 else None, rnd.choice(["en", "de", None]), rnd.choice(["src0", "src1", None])) for i in range(300)]
    docs += docs[:5]
    out = mixing.mix(documents(spark, docs), budget=500, max_epochs=2, seed=3)
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars", "mix"]
    got = out.collect()
    leaf = defaultdict(list)
    for r in got:
        assert r.mix.tokens == len((r.text or "").split())
        leaf[r.mix.lang, r.mix.source].append(r)
    spent = {k: sum(r.mix.tokens for r in v) for k, v in leaf.items()}
    total = defaultdict(list)
    for d, t, lang, source in docs:
        total[lang or "", source or ""].append((d, len((t or "").split())))
    import hashlib

    for k, own in leaf.items():
        budget = own[0].mix.leaf_budget
        assert spent[k] <= budget
        order = sorted((hashlib.md5(f"3|{e}|{d}".encode()).hexdigest(), d, n, e) for d, n in total[k] for e in (1, 2, 3))
        want, left = [], budget
        for e in (1, 2, 3):
            for _, d, n, at in order:
                if at == e:
                    if n > left or budget == 0:
                        left = -1
                        break
                    left -= n
                    want.append((d, e))
            if left < 0:
                break
        assert sorted((r.doc_id, r.mix.epoch) for r in own) == sorted(want)[: len(want)] or sum(n for d, n in total[k]) * 2 == budget


def test_empty_and_clashing(spark):
    assert mixing.mix(documents(spark, []), fraction=0.5).collect() == []
    odd = documents(spark, [(1, "a b c"), (2, "d")]).withColumns({"mix": F.lit(1), "leaf": F.lit("x"), "range": F.lit(2), "p": F.lit(3), "id": F.lit(9)})
    out = mixing.mix(odd, fraction=1.0)
    assert out.columns == [*odd.columns, "_mix"]
    assert sorted(r.doc_id for r in out.collect()) == [1, 2]


def test_long_text_and_null_ids(spark):
    docs = [(1, "w " * 200_000), (None, "a b"), (None, "a b"), (3, None), (4, "c")]
    out = mixing.mix(documents(spark, docs), budget=10, seed=1).collect()
    # The long text is more than the budget: the prefix ends where it comes; what is drawn before it depends on the seed.
    assert sum(r.mix.tokens for r in out) <= 10 and all(r.doc_id != 1 for r in out)
    every = mixing.mix(documents(spark, docs), fraction=1.0, seed=1).collect()
    assert sorted(str(r.doc_id) for r in every) == ["1", "3", "4", "None", "None"]
