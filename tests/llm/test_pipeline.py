import hashlib
import random
import struct
from collections import defaultdict

import zstandard
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from strataloom.llm import mixing, quality_rules, queries
from strataloom.llm.common import written

from .helpers import documents, lower_az, words
from .test_ngram_join import brute
from .test_quality_rules import vocabulary_text


def test_stages_keep_the_columns_of_documents(spark, sf_dir):
    docs = queries.table(spark, sf_dir, "documents")
    columns, sizes = docs.columns, [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
        assert docs.columns == columns
        sizes.append(docs.count())
    assert sizes == sorted(sizes, reverse=True) and 0 < sizes[-1] < sizes[0]
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir).collect()
    assert {r.doc_id for r in pieces} == {r.doc_id for r in docs.select("doc_id").collect()}


def test_run_equals_the_stages(spark, sf_dir):
    out = corpus_pipeline.run(spark, sf_dir)
    assert out.filter("doc_tokens < 1 OR length < 1").count() == 0 and out.count() > 0


def test_every_operator_is_registered_once():
    names = [n for n in queries.QUERIES if n.startswith("op")]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 11))
    assert set(queries.ORACLES) <= set(queries.QUERIES)


def passes_rules(text):
    """Base counts and bands by their definitions."""
    data = (text or "").encode()
    w = words(text)
    seen = {}
    for i in range(len(w) - 4):
        seen.setdefault(tuple(w[i : i + 5]), []).append(i)
    repeated = {i + k for at in seen.values() if len(at) > 1 for i in at for k in range(5)}
    if len(w) < 10 or 100 * len(repeated) > 20 * len(w):
        return False
    packer = zstandard.ZstdCompressor(level=1, write_checksum=False, write_content_size=False)

    def fits(part, bands):
        band = [b for b in bands if b.from_bytes <= len(part)][-1]
        return band.low <= len(packer.compress(part)) / len(part) <= band.high

    cuts = list(range(0, len(data), 4096)) + [len(data)]
    if len(cuts) > 2 and cuts[-1] - cuts[-2] < 1000:
        del cuts[-2]
    bad = sum(not fits(data[a:b], quality_rules.CHUNK_BANDS) for a, b in zip(cuts, cuts[1:]))
    return fits(data, quality_rules.WHOLE_BANDS) and bad <= 0.25 * (len(cuts) - 1)


def corpus(rnd):
    texts = [vocabulary_text(rnd, rnd.randrange(30, 900)) for _ in range(40)]
    rows = [(i, t, rnd.choice(["en", "de", None]), rnd.choice(["src0", "src1", "src5", None])) for i, t in enumerate(texts)]
    rows += [(100 + i, t.upper() if i % 2 else t, "en", "src0") for i, t in enumerate(texts[:12])]  # exact copies
    for i, t in enumerate(texts[12:24]):  # near copies, some too far
        w = t.split()
        for _ in range(1 + len(w) // (250 if i % 2 else 20)):
            w[rnd.randrange(len(w))] = f"zz{rnd.randrange(10**6)}"
        rows.append((200 + i, " ".join(w), "de", "src1"))
    rows += [(300, None, None, None), (301, "", "en", "src0"), (302, "too short", "en", "src0"), (303, "again and again " * 300, "en", "src0"), (304, "".join(rnd.choice("abcdefghijklmnopqrstuvwxyzABCDEFG0123456789") + (" " if k % 7 == 0 else "") for k in range(6000)), "en", "src0")]
    rows += [(None, vocabulary_text(rnd, 120), "en", "src1"), (39, texts[39], "en", "src0"), (39, texts[39], "en", "src0")]
    return rows


def test_stages_match_brute_force(spark, sf_dir):
    rows = corpus(random.Random(11))
    odd = {c: F.lit(c) for c in ("text_sha256", "group", "kept", "mix", "row", "leaf", "key", "range", "best", "sha", "id", "dropped_id", "token")}
    docs = documents(spark, rows).withColumns(odd)
    stages = dict(corpus_pipeline.STAGES)
    run = lambda name, df: written(stages[name](spark, df, sf_dir), name)
    of = lambda df: sorted(((r.doc_id, r.text) for r in df.collect()), key=repr)

    kept = run("quality_rules", docs)
    assert kept.columns == docs.columns
    want = sorted(((d, t) for d, t, *_ in rows if passes_rules(t)), key=repr)
    assert of(kept) == want and 40 < len(want) < len(rows)

    single = run("exact_dedup", kept)
    best = {}
    for d, t in want:
        best[lower_az(t)] = max(best.get(lower_az(t), (False, 0, t)), (d is not None, d or 0, t))
    want = sorted(((d if known else None, t) for known, d, t in best.values()), key=repr)
    assert single.columns == docs.columns and of(single) == want

    apart = run("ngram_join", single)
    labels = brute([(d, t) for d, t in want if d is not None], 5, 80)
    want = [(d, t) for d, t in want if d is None or labels[d][1] == d]
    assert apart.columns == docs.columns and of(apart) == want and len(want) < len(labels)

    mixed = run("mixing", apart)
    drawn = mixing.mix(apart, domain=queries.domain(), fraction=corpus_pipeline.BUDGET, weights=corpus_pipeline.WEIGHTS, max_epochs=1, seed=17).select("doc_id", "text", "_mix.*").collect()
    budgets = {(r.domain, r.lang, r.source): r.leaf_budget for r in drawn}
    leaves = defaultdict(list)
    for r in apart.collect():
        number = int((r.source or "0")[-1]) if r.source else 0
        leaves[f"domain{number % 3}", r.lang or "", r.source or ""].append((hashlib.md5(f"17|1|{'' if r.doc_id is None else r.doc_id}".encode()).hexdigest(), r.doc_id, r.text, len(words(r.text))))
    total = sum(x[3] for own in leaves.values() for x in own)
    assert sum(budgets.values()) <= corpus_pipeline.BUDGET * total
    want = []
    for leaf, own in leaves.items():
        left = budgets.get(leaf, 0)
        for _, d, t, n in sorted(own):
            if n > left:
                break
            left -= n
            want.append((d, t))
    want.sort(key=repr)
    assert mixed.columns == docs.columns and of(mixed) == want and want

    library, pieces = Tokenizer.from_file(queries.vocabulary("word_bpe_49k.json")), defaultdict(list)
    for r in stages["packing"](spark, mixed, sf_dir).collect():
        pieces[r.doc_id].append((r.start, r.length, bytes(r.ids), r.doc_tokens, r.offset))
    for d, t in want:
        ids = [*library.encode(t, add_special_tokens=False).ids, 1]
        own = sorted(pieces.pop(d))
        assert b"".join(x[2] for x in own) == struct.pack(f"<{len(ids)}I", *ids)
        assert [x[0] for x in own] == [sum(y[1] for y in own[:k]) for k in range(len(own))]
        assert all(n & (n - 1) == 0 and n <= 2048 and at == 0 and count == len(ids) for _, n, _, count, at in own)
    assert not pieces


def test_empty_corpus(spark, sf_dir):
    docs = documents(spark, [])
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
        assert docs.count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir).count() == 0
