import random

import pytest
from tokenizers import Tokenizer

from strataloom.llm import packing
from strataloom.llm.queries import vocabulary

from .helpers import documents

PATH = vocabulary("word_bpe_49k.json")
PARTS = ["a", "The", " ", "  ", "\n", "'s", "'re", "'S", "don", "!!", "<|endoftext|>", "<|endof", "text|>", "é", "É,", "日本", "😀", "12", "\t", "\x85", "\xa0", "...", "\x1c", "́", "Σ", "İ", "İ!!", "ß.", "\x00", "\x7f", "한", "ᄀ", "ᅡ"]


def test_ids_by_word_equal_the_library():
    ids, rnd = packing.WordIds(PATH), random.Random(1)
    assert ids.by_word
    for _ in range(3000):
        text = "".join(rnd.choice(PARTS) for _ in range(rnd.randrange(10)))
        assert ids(text) == ids.encode(text), text


def test_piece_lengths():
    for n in (1, 2, 3, 2047, 2048, 2049, 5000, 4096):
        parts = packing.piece_lengths(n, 2048)
        assert sum(parts) == n and parts == sorted(parts, reverse=True)
        assert len(set(p for p in parts if p < 2048)) == len([p for p in parts if p < 2048]) and all(p & (p - 1) == 0 for p in parts)


def test_pieces_cover_each_document_once(spark):
    rnd = random.Random(2)
    docs = [(i, " ".join(rnd.choice(["the", "boat", "Über", "x1"]) for _ in range(rnd.randrange(60)))) for i in range(50)] + [(90, None), (91, ""), (92, "word " * 9000), (None, "no id"), (93, "twice"), (93, "twice")]
    out = packing.pack(documents(spark, docs), PATH, max_length=64).collect()
    t = Tokenizer.from_file(PATH)
    assert len({r.sequence_id for r in out}) == len(out) and all(r.offset == 0 for r in out)
    for d, text in docs:
        want = b"".join(i.to_bytes(4, "little") for i in [*t.encode(text or "", add_special_tokens=False).ids, 1])
        own = sorted((r for r in out if r.doc_id == d), key=lambda r: r.start)
        if d == 93:
            own = own[::2]
        assert b"".join(bytes(r.ids) for r in own) == want
        assert [r.start for r in own] == [sum(x.length for x in own[:k]) for k in range(len(own))]
        assert all(r.doc_tokens * 4 == len(want) and 1 << r.bucket == r.length and len(r.ids) == 4 * r.length for r in own)


def test_empty_table_limits_and_buckets(spark, tmp_path):
    assert packing.pack(documents(spark, []), PATH).collect() == []
    with pytest.raises(ValueError):
        packing.pack(documents(spark, []), PATH, max_length=100)
    packing.write_buckets(packing.pack(documents(spark, [(1, "a b c")]), PATH), str(tmp_path / "b"))
    assert {p.name for p in (tmp_path / "b").glob("bucket=*")} == {"bucket=2"}


def test_words_of_many_texts_at_once(spark):
    """Distinct words, gathered back, give what the library gives for each text: letters, marks and space of any kind."""
    import random
    from array import array

    from strataloom.llm.packing import WordIds, distinct_words

    rnd = random.Random(3)
    parts = list("aAzZéÉñßÿØ÷×Å") + ["é", "ﬁ", "İ", "Σ", "σς", "🙂", "'s", "’", "10", "<|endoftext|>", ",", ".", "!", "-", " ", "\n", "\x0b", " ", "​", "中文", "\x1c", "\x85", "ſ", "sixteenletterss,", "seventeenletters!"]
    texts = ["".join(rnd.choices(parts, k=rnd.randrange(40))) for _ in range(3000)] + ["", " ", "x" * 100]
    encode = WordIds(vocabulary("word_bpe_49k.json"), 500)
    for i in range(0, len(texts), 700):
        got = encode.of_texts([t.encode() for t in texts[i : i + 700]])
        assert got == [array("I", encode.tokenizer.encode(t, add_special_tokens=False).ids).tobytes() for t in texts[i : i + 700]]
    assert encode.of_texts([b"", b""]) == [b"", b""]
    data = " ".join(texts).encode()
    starts, ends, group, first = distinct_words(data)
    words = [data[a:b] for a, b in zip(starts, ends)]
    assert words == data.split() and [words[first[g]] for g in group] == words
