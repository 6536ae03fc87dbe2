import random
import zlib

import numpy as np
from tokenizers import Tokenizer

from strataloom.llm import token_counts as t
from strataloom.llm.queries import vocabulary

from .helpers import documents

PATH = vocabulary("byte_bpe_50k.json")
PARTS = ["a", "the", " ", "  ", "\n", "'s", "'re", "'", "l", "don", "!!", "<|endoftext|>", "<|endof", "text|>", "é", "日本", "😀", "12", "\t", "\x85", "\xa0", "zz", "...", "re", "S", "\x1c", "_", "́", " 's", " \n", "thonre"]


def test_every_prefix_equals_the_library():
    library, count, rnd = Tokenizer.from_file(PATH), t.counter(PATH), random.Random(1)
    for _ in range(400):
        text = "".join(rnd.choice(PARTS) for _ in range(rnd.randrange(12)))
        sums = np.cumsum(np.frombuffer(count(text), np.int8))
        assert len(sums) == len(text)
        for k in range(1, len(text) + 1):
            assert sums[k - 1] == len(library.encode(text[:k], add_special_tokens=False).ids), (text, k)


def test_documents(spark):
    library = Tokenizer.from_file(PATH)
    docs = [(1, "The boat's here."), (2, None), (3, ""), (4, "longer words " * 20_000), (5, "x" * 5000), (None, "no id"), (6, "two"), (6, "two"), (7, " \n\t \n")]
    out = t.prefix_token_counts(documents(spark, docs), PATH).collect()
    assert len(out) == len(docs)
    by = {r.doc_id: r for r in out}
    for d, text in docs:
        text = text or ""
        assert (by[d].n_tokens, by[d].n_bytes) == (len(library.encode(text, add_special_tokens=False).ids), len(text.encode()))
        assert len(zlib.decompress(by[d].prefix_counts)) == len(text)
    assert t.prefix_token_counts(documents(spark, []), PATH).collect() == []


def test_budget_questions():
    library = Tokenizer.from_file(PATH)
    text = "Counting tokens, at every prefix!"
    stored = zlib.compress(t.counter(PATH)(text))
    for k in range(len(text) + 1):
        assert t.count_at(stored, k) == len(library.encode(text[:k], add_special_tokens=False).ids)
    for budget in range(9):
        best = max(k for k in range(len(text) + 1) if len(library.encode(text[:k], add_special_tokens=False).ids) <= budget)
        assert t.longest_prefix(stored, budget) == best


def test_many_special_strings_and_one_long_word(spark):
    library = Tokenizer.from_file(PATH)
    special, word, run = "<|endoftext|>" * 100_000, "abcdefghij" * 100_000, "日本語" * 100_000
    mixed = "a<|endoftext|>b, <|endoftext|><|endof" * 500
    docs = [(1, special), (2, word), (3, run), (4, mixed), (5, "short " * 2000)]
    out = {r.doc_id: r for r in t.prefix_token_counts(documents(spark, docs), PATH).collect()}
    assert out[1].n_tokens == 100_000 and out[1].n_bytes == len(special)
    for d, text in docs[1:]:
        assert out[d].n_tokens == len(library.encode(text, add_special_tokens=False).ids)
    for d, text in docs:
        k = out[d].chars_in_budget
        assert len(library.encode(text[:k], add_special_tokens=False).ids) <= 1024 < len(library.encode(text[: k + 1], add_special_tokens=False).ids)
