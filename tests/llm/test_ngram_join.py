import random

from pyspark.sql import functions as F

from strataloom.llm import ngram_join
from strataloom.llm.components import connected

from .helpers import documents, lower_az, rows, words


def brute(docs, n, percent):
    sets = []
    for _, t in docs:
        w = words(lower_az(t))
        sets.append(frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else []))
    label = list(range(len(docs)))

    def find(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(len(docs)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                label[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(docs):
        least[find(i)] = min(least.get(find(i), d), d)
    return {d: (len(sets[i]), least[find(i)] if sets[i] else d) for i, (d, _) in enumerate(docs)}


def edited(rnd, base, changes):
    w = base.split()
    for _ in range(changes):
        w[rnd.randrange(len(w))] = f"z{rnd.randrange(10**6)}"
    return " ".join(w)


def near_copies(seed):
    rnd = random.Random(seed)
    bases = [" ".join(f"w{rnd.randrange(400)}" for _ in range(80)) for _ in range(5)]
    shared = " ".join(f"p{i}" for i in range(25))
    docs = [(i, edited(rnd, rnd.choice(bases), rnd.randrange(0, 5))) for i in range(120)]
    docs += [(200 + i, shared + " " + " ".join(f"q{rnd.randrange(10**6)}" for _ in range(rnd.randrange(1, 9)))) for i in range(60)]
    docs += [(300, ""), (301, None), (302, "one two"), (303, "ONE two"), (304, " \n\t"), (305, bases[0].upper()), (306, "x " * 3000), (307, "one")]
    rnd.shuffle(docs)
    return docs


def test_components_match_brute_force(spark):
    docs = near_copies(3)
    for n, percent, counters in ((4, 85, 1 << 17), (5, 80, 50)):
        out = ngram_join.similar_groups(documents(spark, docs), n=n, percent=percent, counters=counters)
        assert {r.doc_id: (r.n_shingles, r.component_id) for r in out.collect()} == brute(docs, n, percent)


def degrees(docs, n, percent):
    sets = {}
    for d, t in docs:
        w = words(lower_az(t))
        sets[d] = frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else [])
    return {d: sum(e != d and bool(s) and bool(o) and 100 * len(s & o) >= percent * len(s | o) for e, o in sets.items()) for d, s in sets.items()}


def test_links_match_brute_force(spark, monkeypatch):
    docs = near_copies(3) + [(1000 + i, "one text in many equal copies") for i in range(30)]
    base = " ".join(f"v{i}" for i in range(150))
    docs += [(2000 + i, edited(random.Random(i), base, 1)) for i in range(40)]  # all similar, all different
    for block in (ngram_join.BLOCK_SETS, 7):  # 7: components of many blocks
        monkeypatch.setattr(ngram_join, "BLOCK_SETS", block)
        out = ngram_join.similar_groups(documents(spark, docs), n=4, percent=85)
        got = {r.doc_id: r.n_links for r in out.collect()}
        assert got == degrees(docs, 4, 85) and got[1000] == 29 and got[2000] == 39


def test_prefixes_of_similar_sets_always_meet():
    import numpy as np

    rnd = random.Random(5)
    none = np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.uint8)
    for _ in range(300):
        common = rnd.randrange(1, 60)
        a = [rnd.getrandbits(64) for _ in range(common)]
        b = a + [rnd.getrandbits(64) for _ in range(rnd.randrange(0, 1 + common * 15 // 85))]
        x, y = (np.unique(np.array(s, dtype=np.uint64)) for s in (a, b))
        if 100 * len(np.intersect1d(x, y)) < 85 * len(np.union1d(x, y)):
            continue
        for seed in range(3):
            p, q = (ngram_join.ordered(s, *none, seed, ngram_join.prefix_length(len(s), 85)) for s in (x, y))
            assert len(np.intersect1d(p, q))


def test_keep_one_keeps_columns_and_one_of_each_group(spark):
    docs = near_copies(7)
    df = documents(spark, docs).withColumns({"sid": F.lit(1), "dropped_id": F.lit(2)})
    out = ngram_join.keep_one(df)
    want = {d for d, (_, c) in brute(docs, 5, 80).items() if d == c}
    assert out.columns == df.columns and {r.doc_id for r in out.collect()} == want


def test_empty_repeated_and_null_ids(spark):
    assert ngram_join.similar_groups(documents(spark, [])).collect() == []
    out = rows(ngram_join.similar_groups(documents(spark, [(None, "a b c d e f"), (4, "a b c d e f"), (4, "a b c d e f"), (None, "other words")])).select("doc_id", "n_shingles", "component_id"))
    assert sorted(out, key=str) == sorted([(None, 2, 4), (4, 2, 4), (4, 2, 4), (None, 1, None)], key=str)


def test_connected_components(spark):
    rnd = random.Random(9)
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, x) for x in range(101, 140)] + [(500 + rnd.randrange(30), 500 + rnd.randrange(30)) for _ in range(20)]
    out = dict(rows(connected(spark.createDataFrame(edges, "a long, b long"))))
    assert all(out[i] == 0 for i in range(61)) and all(out[x] == 100 for x in range(100, 140))
    for a, b in edges:
        assert a == b or out[a] == out[b]


def test_very_long_texts_and_tokens_that_are_not_hot(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "HOT_SHARE", 0)
    rnd = random.Random(5)
    long = [f"w{rnd.randrange(10**5)}" for _ in range(60_000)]  # beyond what is hashed in one block of bytes
    near = long[:]
    for _ in range(500):
        near[rnd.randrange(len(near))] = "x" * 70
    far = long[:30_000] + [f"v{rnd.randrange(10**5)}" for _ in range(30_000)]
    docs = [(1, " ".join(long)), (2, "\n".join(near)), (3, " ".join(far)), (4, " ".join(long).upper())] + near_copies(6)
    out = ngram_join.similar_groups(documents(spark, docs), n=4, percent=85)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in out.collect()} == brute(docs, 4, 85)


def long_copies():
    """Texts of some kilobytes, a quarter of them near copies, with passages that many share at other lengths."""
    rnd = random.Random(21)
    passages = [" ".join(f"s{rnd.randrange(10**6)}" for _ in range(12)) for _ in range(60)]
    texts = [" ".join(f"w{rnd.randrange(10**6)}" for _ in range(rnd.choice((60, 150, 400, 1000)))) + " " + rnd.choice(passages) for _ in range(400)]
    texts += [edited(rnd, t, 2) for t in texts[:100]]
    return list(enumerate(texts))


def traced(spark, monkeypatch, docs):
    """The result; after each intermediate table its name, its files and the bytes of all tables there are."""
    from pathlib import Path

    from strataloom.functions.durable import shared_dir
    from strataloom.llm import components

    here, steps = Path(shared_dir(spark).removeprefix("file:")) / "strataloom", []
    size = lambda: sum(p.stat().st_size for p in here.rglob("part-*"))
    before = size() if here.exists() else 0

    def spy(make):
        def run(df, name, **more):
            out = make(df, name, **more)
            steps.append((name, len(list(Path(out._folder.removeprefix("file:")).glob("part-*"))), size() - before))
            return out

        return run

    monkeypatch.setattr(ngram_join, "written", spy(ngram_join.written))
    monkeypatch.setattr(components, "written", spy(components.written))
    return ngram_join.similar_groups(documents(spark, docs).repartition(8), n=4, percent=85).collect(), steps


def test_narrow_tables_have_few_files(spark):
    from pathlib import Path

    from strataloom.llm.common import discard, written

    for few, files in ((False, 8), (True, 1)):
        out = written(spark.range(1000).repartition(8), "pairs", few=few)
        assert len(list(Path(out._folder.removeprefix("file:")).glob("part-*"))) == files and out.count() == 1000
        discard(out)


def test_tables_on_disk_stay_below_the_texts(spark, monkeypatch):
    docs = long_copies()
    out, steps = traced(spark, monkeypatch, docs)
    texts = sum(len(t) for _, t in docs)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in out} == brute(docs, 4, 85)
    assert max(size for *_, size in steps) < 0.75 * texts


def test_entries_of_a_bucket_without_any_of_their_size_go(spark):
    import numpy as np

    sizes = [(1, 100), (2, 100), (3, 84), (4, 118), (5, 40), (6, 47), (7, 48)]
    entries = spark.createDataFrame([(9, (i << 32) | n, i) for i, n in sizes] + [(8, (1 << 32) | 50, 1), (8, (2 << 32) | 70, 2)], "token long, place long, sid long")
    out = ngram_join._followers(entries, np.zeros(0, dtype=np.uint64), 85)
    # 100 and 118 are 0.847, 84 and 100 are 0.84, 40 and 47 are 0.851, 47 and 48 are near; nothing is left of token 8
    assert sorted(r.sid for r in out.collect()) == [2, 5, 6, 7]
