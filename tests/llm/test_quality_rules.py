import random

import zstandard
from pyspark.sql import functions as F

from strataloom.llm import quality_rules as q

from .helpers import documents, words


def brute(text):
    text = text or ""
    w = words(text)
    grams = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    seen = {}
    for g in grams:
        seen[g] = seen.get(g, 0) + 1
    covered = {i + k for i, g in enumerate(grams) if seen[g] > 1 for k in range(5)}
    lines, dup, known = text.split("\n"), 0, set()
    for x in lines:
        if words(x):
            dup += x in known
            known.add(x)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), dup, len(covered)


def texts():
    rnd = random.Random(1)
    out = [None, "", " \n ", "a", "a b c d e a b c d e", "x\x1cy z\x85w", "Line one\nline two\nLine one\n\n\nLine one", "# * $ <é> 日本 😀", "w " * 3000]
    out += [" ".join(rnd.choice(["ab", "cd", "e", "|", "\n", "fü"]) for _ in range(rnd.randrange(80))) for _ in range(60)]
    return out + ["".join(rnd.choice("etaoin shrdlu") for _ in range(30_000))]


def test_counts_match_brute_force(spark):
    docs = [(i, t) for i, t in enumerate(texts())] + [(0, None), (None, "no id here")]
    out = q.score_rules(documents(spark, docs)).collect()
    assert len(out) == len(docs)
    by = {r.doc_id: r for r in out}
    for d, t in docs:
        r, want = by[d], brute(t)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 10 or 100 * want[4] > 20 * want[0])
        assert not (r.base_failed and r.kept)


def test_compression_bands():
    packer = zstandard.ZstdCompressor(level=1)
    rnd = random.Random(2)
    prose = vocabulary_text(rnd, 2400).encode()
    ratio, chunks, bad = q.compression(prose, packer, 4096)
    assert q.within(ratio, len(prose), q.WHOLE_BANDS) and chunks == len(prose) // 4096 and not bad
    ratio, *_ = q.compression(b"again and again, " * 2000, packer, 4096)
    assert not q.within(ratio, 34_000, q.WHOLE_BANDS)
    noise = bytes(rnd.randrange(33, 127) for _ in range(20_000))
    assert not q.within(q.compression(noise, packer, 4096)[0], 20_000, q.WHOLE_BANDS)
    assert q.compression(b"", packer, 4096) == (0.0, 0, 0)


def test_last_part_is_judged():
    import pyarrow as pa

    rnd = random.Random(4)
    prose = vocabulary_text(rnd, 3000)
    noise = "".join(chr(rnd.randrange(33, 127)) for _ in range(4_000))

    def judged(text):
        *_, ratio, chunks, bad, kept = (c[0].as_py() for c in q.rules(pa.array([text]), 1, 4096, 0.2))
        return q.within(ratio, len(text), q.WHOLE_BANDS), chunks, bad, kept

    assert judged(prose[:8_000]) == (True, 2, 0, True)
    assert judged(prose[:12_288] + noise[:1_500])[1:] == (4, 1, False)
    assert judged(noise[:2_000] + prose[:11_788])[1:] == (4, 1, False)
    assert judged(prose[:4_096] + noise)[1:] == (2, 1, False)
    assert judged(noise + prose[:4_191])[1:] == (2, 1, False)
    assert judged(prose[:4_096] + noise[:200])[1:3] == (1, 0)  # too short by itself


def test_filter_keeps_columns(spark):
    df = documents(spark, [(i, t) for i, t in enumerate(texts())]).withColumns({"kept": F.lit(False), "verdict": F.lit("x")})
    out = q.keep_by_rules(df)
    want = {r.doc_id for r in q.score_rules(df).collect() if r.kept}
    assert out.columns == df.columns and {r.doc_id for r in out.collect()} == want
    assert q.score_rules(documents(spark, [])).collect() == [] and q.keep_by_rules(documents(spark, [])).collect() == []


def vocabulary_text(rnd, n):
    """Words of natural lengths with natural frequencies, from 30,000 made ones."""
    words = ["".join(rnd.choice("eeeetttaaooiinnsshhrrdlcumwfgypbvk") for _ in range(rnd.randrange(2, 10))) for _ in range(30_000)]
    return " ".join(words[int(30_000 ** rnd.random()) - 1] for _ in range(n))


def test_only_the_bands_reject(spark):
    """Texts that pass all base counts and don't read like text."""
    import base64

    rnd = random.Random(8)
    template = " ".join(f"unit number {rnd.randrange(10**4)} of this list {rnd.randrange(10**4)} is not sold {rnd.randrange(10**4)}" for _ in range(400))
    noise = " ".join("".join(rnd.choice("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789") for _ in range(rnd.randrange(3, 12))) for _ in range(800))
    coded = base64.b64encode(rnd.randbytes(6000)).decode()
    coded = " ".join(coded[i : i + 76] for i in range(0, len(coded), 76))
    docs = documents(spark, [(1, template), (2, noise), (3, coded), (4, vocabulary_text(rnd, 1000))])
    out = {r.doc_id: r for r in q.score_rules(docs).collect()}
    assert not any(r.base_failed for r in out.values())
    assert [out[i].kept for i in (1, 2, 3)] == [False] * 3
    assert [r.doc_id for r in q.keep_by_rules(docs).collect()] == [i for i in out if out[i].kept]


def test_bands_from_good_documents(spark):
    rnd = random.Random(9)
    docs = documents(spark, [(i, vocabulary_text(rnd, rnd.randrange(50, 900))) for i in range(60)] + [(100, None), (101, "")])
    bands = q.measure_bands(docs, steps=(200, 1000, 3000, 100_000), tail=0.0)
    assert [b.from_bytes for b in bands] == [0, 200, 1000, 3000]
    packer = zstandard.ZstdCompressor(level=1, write_checksum=False, write_content_size=False)
    for r in docs.filter("text <> ''").collect():
        data = r.text.encode()
        assert q.within(len(packer.compress(data)) / len(data), len(data), bands)
    assert not q.within(0.01, 5000, bands) and not q.within(0.95, 5000, bands)
