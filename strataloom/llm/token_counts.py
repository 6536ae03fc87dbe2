"""Exact BPE token counts at every prefix of a text, by dynamic programming.

prefix_token_counts adds a column that stores, for each code point, by how much the exact token count of the
prefix ending there differs from that of the prefix before it: one signed byte each, deflated. The running sum
is the count at every prefix, so that any truncation or budget question is answered without encoding again
(count_at, longest_prefix).

Byte-pair encoding has one valid last token at each position: the token t ending there whose predecessor p, the
last token of the prefix before t, stays apart from t when both are encoded together. The count is then that of
the shorter prefix plus one. The recurrence runs once per distinct piece of text; pieces begin where white space
follows something else, where the pre-tokeniser always cuts, so counts of pieces add up.

A null text counts as empty. Strings of special tokens inside a text are matched as the library does by
default. White space and letter classes are those of the `regex` module.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StructField, StructType

from .common import Kept, no_collector, ship

SPACE = "\t-\r \x85\xa0  -     　"
_WORDS = regex.compile(rf"(?<! )(?:'s|'t|'re|'ve|'m|'ll|'d)|[{SPACE}]+|\p{{L}}+|\p{{N}}+|[^{SPACE}\p{{L}}\p{{N}}]+")
_UNITS = regex.compile(rf"[{SPACE}]*[^{SPACE}]+|[{SPACE}]+")
_ODD_SPACE = re.compile(rf" [{SPACE}]|\n[{SPACE}]|[\t\x0b-\r\x85\xa0  -     　]")
_SPACES = frozenset(c for c in map(chr, range(0x3001)) if re.match(rf"[{SPACE}]", c))
_TWO = (2,)
#: Marks that make one pre-token behind letters. None of them begins a special string that ends in a mark, nor a contraction.
_MARKS = ",.;:!?$*&%#"
#: Beginnings of pieces of which a worker remembers the counts.
STATES = 120_000
_CONTRACTIONS = frozenset(("'s", "'t", "'re", "'ve", "'m", "'ll", "'d"))


def _byte_alphabet() -> dict[str, int]:
    """The visible character that byte-level vocabularies write for each byte, read backwards."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


class PrefixCounter:
    """Prefix deltas of byte-level BPE with the contraction, letter, number, other, white-space cutting rule."""

    PIECES = 200_000

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letter = _byte_alphabet()
        raw = lambda token: bytes(letter[c] for c in token)
        self.special = sorted((t["content"] for t in spec.get("added_tokens", [])), key=len, reverse=True)
        self.special_pattern = re.compile("|".join(map(re.escape, self.special))) if self.special else None
        merges = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        self.ranks = {(raw(a), raw(b)): i for i, (a, b) in reversed([*enumerate(merges)])}
        #: Of each token that merges make, the first merge that makes it: when, and of which two.
        self.made: dict[bytes, tuple[int, bytes, bytes]] = {a + b: (i, a, b) for (a, b), i in sorted(self.ranks.items(), key=lambda x: -x[1])}
        vocab = {raw(t) for t in spec["model"]["vocab"] if t not in self.special}
        #: Token lengths by last two bytes, longest first, so that few candidates are tried. Only tokens that BPE
        #: leaves whole can end a prefix.
        ends: dict[bytes, set[int]] = {}
        for t in vocab:
            if len(t) == 1 or (t in self.made and self.apart(*self.made[t][1:], before=self.made[t][0])):
                ends.setdefault(t[-2:], set()).add(len(t))
        self.vocab = {t: t for t in vocab if len(t) in ends.get(t[-2:], ())}
        #: The same by the last four bytes, as far as tokens have them; else by the last three, of tokens of two or three.
        self.short = {t: (3, 2) if t[-2:] in self.vocab else (3,) for t in self.vocab if len(t) == 3}
        self.short |= {t[-3:]: (2,) if t[-2:] in self.vocab else () for t in self.vocab if len(t) > 3 and t[-3:] not in self.short}
        tails: dict[bytes, set[int]] = {}
        for t in self.vocab:
            if len(t) > 3:
                tails.setdefault(t[-4:], set(self.short.get(t[-3:], _TWO))).add(len(t))
        self.tails = {k: tuple(sorted(v, reverse=True)) for k, v in tails.items()}
        self.pairs = Kept(lambda pair: self.apart(*pair), 200_000)
        self.states: dict[bytes, tuple[list[bytes], list[int]]] = {}
        self.pieces = Kept(self.make_piece, self.PIECES)
        self.units = Kept(self.unit, self.PIECES)

    def apart(self, p: bytes, t: bytes, before: int = 1 << 60) -> bool:
        """Whether no merge that comes before the given one joins something of p's end and t's beginning.

        Going back in time from both whole tokens, what was made last is taken apart first; at each moment the
        two parts that adjoin must not have a merge that comes earlier than their own joining with a neighbour.
        """
        ranks, made = self.ranks, self.made
        while True:
            joined = ranks.get((p, t))
            if joined is not None and joined < before:
                return False
            a, b = made.get(p), made.get(t)
            if a is None and b is None:
                return True
            if b is None or (a is not None and a[0] > b[0]):
                before, p = a[0], a[2]
            else:  # of equal merges the one further left comes first
                before, t = b[0] + 1, b[1]

    def piece(self, text: str) -> bytes:
        """Deltas at each code point of one pre-token, by the recurrence."""
        data = text.encode("utf-8", "surrogatepass")
        n = len(data)
        vocab, tails, short, pairs, states = self.vocab, self.tails, self.short, self.pairs, self.states
        at = min(n - n % 3, 63)
        while at and (state := states.get(data[:at])) is None:
            at -= 3
        if at:  # another piece began alike: go on from there
            last, count, steps = state[0][: at + 1], state[1][: at + 1], state[2][:at]
        else:
            at, last, count, steps = 1, [b"", data[:1]], [0, 1], [1]
        now = count[at]
        for i in range(at + 1, n + 1):
            lengths = tails.get(data[i - 4 : i]) if i > 3 else None
            if lengths is None:
                lengths = short.get(data[i - 3 : i], _TWO) if i > 2 else _TWO
            for k in lengths:
                if k <= i and (t := vocab.get(data[i - k : i])) is not None and (k == i or pairs[last[i - k], t]):
                    c = count[i - k] + 1
                    break
            else:
                t, c = data[i - 1 : i], now + 1
            last.append(t)
            count.append(c)
            steps.append(c - now)
            now = c
        if n <= 64:
            if len(states) >= STATES:
                states.clear()
            for i in range(at - at % 3 + 3, n + 1, 3):
                states[data[:i]] = last, count, steps
        if n != len(text):  # only where code points end
            steps, now, i = [], 0, 0
            for char in text:
                i += 1 if char < "\x80" else 2 if char < "\u0800" else 3 if char < "\U00010000" else 4
                steps.append(count[i] - now)
                now = count[i]
        try:
            return bytes(steps)
        except ValueError:
            return b"".join(map(_byte, steps))

    def make_piece(self, text: str) -> bytes:
        return self.contraction(text) if text in _CONTRACTIONS else self.piece(text)

    def plain(self, text: str) -> bytes:
        """Deltas of a text without special tokens."""
        out: list[bytes] = []
        space = ""
        for word in _WORDS.findall(text):
            if word[0] in _SPACES:
                space = word
                continue
            if space == " ":
                out.append(self.pieces[" " + word])
            elif not space:
                out.append(self.pieces[word])
            else:
                # A cut inside the white space keeps it whole; before anything else its last character stands
                # alone or, if it is a space, joins the word.
                joined = self.pieces[" " + word][1:] if space[-1] == " " else self.pieces[word]
                first = joined[0] if joined[0] < 128 else joined[0] - 256
                base = self.total(space[:-1]) + self.total(space[-1]) - self.total(space)
                out += (self.pieces[space], _byte(base + first), joined[1:])
            space = ""
        if space:
            out.append(self.pieces[space])
        return b"".join(out)

    def contraction(self, word: str) -> bytes:
        """A cut inside leaves the apostrophe and the letters apart."""
        tick = self.total("'")
        return _steps([0, tick, *(tick + sum_of(self.piece(word[1:k])) for k in range(2, len(word))), sum_of(self.piece(word))])

    def total(self, word: str) -> int:
        return sum_of(self.pieces[word]) if word else 0

    def unit(self, text: str) -> bytes:
        """Deltas of white space and what follows it."""
        if text[0] == " " and text.isascii() and text[1:].isalpha():
            return self.pieces.get(text) or self.pieces.old.get(text) or self.piece(text)
        word = text.rstrip(_MARKS)
        if len(word) > 1 and word[0] == " " and word.isascii() and word[1:].isalpha() and len(word) < len(text):
            return self.pieces[word] + self.pieces[text[len(word) :]]
        if not self.special_pattern:
            return self.plain(text)
        out, start = [], 0
        for found in self.special_pattern.finditer(text):
            # Up to the end of the special string it is plain text; then one token stands for it.
            whole, before = self.plain(text[start : found.end()]), self.plain(text[start : found.start()])
            out += (whole[:-1], _byte(sum_of(before) + 1 - sum_of(whole[:-1])))
            start = found.end()
        if not out:
            return self.plain(text)
        return b"".join((*out, self.plain(text[start:])))

    def __call__(self, text: str | None) -> bytes:
        """Deltas at each code point of a whole text."""
        if not text:
            return b""
        if _ODD_SPACE.search(text):
            parts = _UNITS.findall(text)
        else:  # only single spaces and line ends: cutting is a plain split
            head, *rest = text.replace("\n", " \n").split(" ")
            parts = [x if x[:1] == "\n" else " " + x for x in rest]
            if head:
                parts.insert(0, head)
        return b"".join(map(self.units.__getitem__, parts))


def _byte(step: int) -> bytes:
    """A signed byte. A code point has four bytes at most, so that no step of a real vocabulary comes near the limit."""
    if not -128 <= step <= 127:
        raise OverflowError("a step of the token count exceeds a byte")
    return bytes((step & 255,))


def _steps(count: list[int]) -> bytes:
    """Signed differences of counts that begin with 0."""
    try:
        return bytes([b - a for a, b in zip(count, count[1:])])
    except ValueError:
        return b"".join(_byte(b - a) for a, b in zip(count, count[1:]))


def sum_of(deltas: bytes) -> int:
    """The count that signed bytes add up to."""
    return int(np.frombuffer(deltas, np.int8).sum(dtype=np.int64)) if len(deltas) > 64 else sum(x - 256 if x > 127 else x for x in deltas)


_COUNTERS: dict[str, PrefixCounter] = {}


def counter(path: str) -> PrefixCounter:
    """One per worker process and vocabulary; its caches have fixed numbers of entries."""
    if path not in _COUNTERS:
        _COUNTERS[path] = PrefixCounter(path)
    return _COUNTERS[path]


def count_at(prefix_counts: bytes, chars: int) -> int:
    """Exact token count of the first `chars` code points."""
    return int(np.frombuffer(zlib.decompress(prefix_counts), np.int8)[:chars].sum(dtype=np.int64))


def longest_prefix(prefix_counts: bytes, budget: int) -> int:
    """The largest number of code points whose prefix has at most `budget` tokens."""
    return longest(zlib.decompress(prefix_counts), budget)


def longest(deltas: bytes, budget: int) -> int:
    sums = np.cumsum(np.frombuffer(deltas, np.int8), dtype=np.int64)
    fits = np.flatnonzero(sums <= budget)
    return int(fits[-1]) + 1 if len(fits) else 0


def prefix_token_counts(docs: DataFrame, vocabulary: str, *, budget: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per document: doc_id, n_bytes, n_tokens, chars_in_budget (the most code points that have at most `budget`
    tokens), prefix_counts (deflated signed bytes, one per code point).

    No shuffle: each task streams its rows and keeps caches of bounded size. Repeated rows give repeated rows.
    """
    ship(docs.sparkSession)
    schema = StructType([StructField("doc_id", LongType()), StructField("n_bytes", LongType()), StructField("n_tokens", LongType()), StructField("chars_in_budget", LongType()), StructField("prefix_counts", BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(vocabulary)
        for batch in batches:
            ids, n_bytes, n_tokens, fitting, stored = batch.column(0), [], [], [], []
            with no_collector():
                for text in batch.column(1):
                    text = text.as_py() or ""
                    deltas = count(text)
                    n_bytes.append(len(text.encode("utf-8", "surrogatepass")))
                    n_tokens.append(sum_of(deltas))
                    fitting.append(len(text) if n_tokens[-1] <= budget else longest(deltas, budget))
                    stored.append(zlib.compress(deltas, 1))
            yield pa.RecordBatch.from_arrays([ids, pa.array(n_bytes, pa.int64()), pa.array(n_tokens, pa.int64()), pa.array(fitting, pa.int64()), pa.array(stored, pa.binary())], ["doc_id", "n_bytes", "n_tokens", "chars_in_budget", "prefix_counts"])

    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(run, schema)


def over_limit(n_tokens: Column, limit: int = 1024) -> Column:
    return n_tokens > F.lit(limit)
