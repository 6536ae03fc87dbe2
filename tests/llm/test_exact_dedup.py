import hashlib
import random

from strataloom.llm import exact_dedup

from .helpers import documents, lower_az, rows


def brute(docs):
    groups = {}
    for d, t in docs:
        groups.setdefault(lower_az(t), []).append(d)
    return groups


def test_groups_match_brute_force_with_hot_and_cold_texts(spark):
    rnd = random.Random(1)
    docs = [(i, rnd.choice(["Hot TEXT", "hot text", None, "", "É", "é", f"cold {i % 40}", f"own {i}"])) for i in range(400)]
    out = exact_dedup.duplicate_groups(documents(spark, docs), heavy=4, tracked=8)
    groups = brute(docs)
    got = {r.doc_id: r for r in out.collect()}
    assert len(got) == len(docs)
    for d, t in docs:
        own = groups[lower_az(t)]
        r = got[d]
        assert (r.keep_id, r.group_size, r.kept) == (max(own), len(own), d == max(own))
        assert r.text_sha256 == hashlib.sha256(lower_az(t).encode()).hexdigest()


def test_repeated_rows_and_null_ids_keep_one_row(spark):
    docs = [(1, "a"), (1, "a"), (1, "a"), (None, "a"), (None, "b"), (None, "b"), (2, None), (2, "")]
    out = exact_dedup.duplicate_groups(documents(spark, docs)).collect()
    assert len(out) == 8
    for key in {r.text_sha256 for r in out}:
        assert sum(r.kept for r in out if r.text_sha256 == key) == 1
    kept = exact_dedup.exact_dedup(documents(spark, docs)).collect()
    assert len(kept) == 3 and {r.doc_id for r in kept} == {1, 2, None}


def test_empty_table_and_clashing_columns(spark):
    empty = documents(spark, []).select("*")
    assert exact_dedup.duplicate_groups(empty).collect() == []
    assert exact_dedup.exact_dedup(empty).collect() == []
    odd = spark.createDataFrame([(1, "x", 7, "q", 1, 2), (2, "X", 8, "r", 1, 2)], "doc_id long, text string, text_sha256 int, best string, rank int, known int")
    out = exact_dedup.exact_dedup(odd)
    assert out.columns == odd.columns and rows(out) == [(2, "X", 8, "r", 1, 2)]


def test_very_long_text(spark):
    long = "Ab c\n" * 200_000
    out = exact_dedup.duplicate_groups(documents(spark, [(1, long), (2, long.upper()), (3, long + "!")])).collect()
    assert sorted((r.doc_id, r.keep_id) for r in out) == [(1, 2), (2, 2), (3, 3)]


def test_filter_with_and_without_broadcast(spark, monkeypatch):
    rnd = random.Random(4)
    docs = [(i, rnd.choice(["Hot TEXT", "hot text", None, "É", f"cold {i % 40}", f"own {i}"])) for i in range(300)] + [(5, "cold 7"), (5, "cold 7")]
    want = sorted(max(own) for own in brute(docs).values())
    for bound in (exact_dedup.BROADCAST_GROUPS, 0):
        monkeypatch.setattr(exact_dedup, "BROADCAST_GROUPS", bound)
        out = exact_dedup.exact_dedup(documents(spark, docs), heavy=4, tracked=8)
        assert sorted(r.doc_id for r in out.collect()) == want
