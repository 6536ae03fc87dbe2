"""Packing by power-of-two decomposition.

A document's token ids, end id included, are cut into pieces whose lengths are the binary digits of its length:
as many of the largest size as fit, then each smaller power of two at most once, in document order. Each piece is a
sequence of its own, so that no sequence crosses documents and none needs padding; sequences of one length form a
bucket, from which a trainer draws batches (write_buckets lays them out so).

No shuffle: every task cuts its own documents. A null text counts as empty and gives the end id alone. Repeated rows
give sequences of their own.

The vocabulary's normaliser and pre-tokeniser never look across white space, so that ids are found by word: the words of
some megabytes of texts are made distinct by array operations, each distinct one is encoded once (caches of a fixed number
of entries remember earlier ones), and the ids are gathered back into the order of the texts.
"""

from __future__ import annotations

import codecs
import json
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, IntegerType, LongType, StructField, StructType

from .common import WHITE, Kept, mix, no_collector, ship, text_bytes, tidy

_PLAIN = re.compile(rb"([A-Za-z]+)([,.;:!?]*)")
#: Letters of ASCII and Latin-1 in UTF-8, perhaps with marks behind them.
_LATIN = re.compile(rb"((?:[A-Za-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+)([,.;:!?]*)")
_SPLIT = re.compile(rb"'(?:s|t|re|ve|m|ll|d)|[a-z]+|[0-9]|[^a-z0-9]+")


def _stand_ins() -> str:
    """A character for each byte, as byte-level vocabularies spell them: printable ones of Latin-1 as they are, the others
    in order from 256 on."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return "".join(chr(b if b in printable else next(others)) for b in range(256))


_STAND_INS = _stand_ins()


class WordIds:
    """Token ids of whole texts, as little-endian unsigned 32-bit ids, for a lower-casing vocabulary with word ends."""

    def __init__(self, path: str, words: int = 500_000):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        kinds = [x["type"] for x in (spec.get("normalizer") or {}).get("normalizers", [])]
        pattern = ((spec.get("pre_tokenizer") or {}).get("pretokenizers", [{}])[0].get("pattern") or {}).get("Regex", "")
        #: Only for the rules known here are words taken apart; other vocabularies encode whole texts.
        self.by_word = kinds == ["NFC", "Replace", "Lowercase"] and "[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+" in pattern
        self.model = self.tokenizer.model
        self.special = re.compile("|".join(re.escape(t["content"]) for t in spec.get("added_tokens", [])).encode() or b"(?!)")
        self.words = Kept(self.word, words)
        self.parts = Kept(self.part, words // 5)

    def encode(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def part(self, part: bytes) -> bytes:
        """Ids of a pre-token in lower-case ASCII, or of a word that isn't ASCII."""
        if part.isascii():
            return array("I", [t.id for t in self.model.tokenize(part.decode())]).tobytes()
        return self.encode(part.decode("utf-8", "surrogatepass"))

    def word(self, word: bytes) -> bytes:
        """Ids of what stands between white space."""
        if plain := _PLAIN.fullmatch(word):  # letters, perhaps with marks behind them
            letters, marks = plain.groups()
            base = letters.lower()
            ids = self.part(base) if base == word else self.words[base]
            return ids + self.parts[marks] if marks else ids
        if word.isascii():
            if min(word) > 32 and max(word) < 127 and not self.special.search(word):
                return b"".join(map(self.parts.__getitem__, _SPLIT.findall(word.lower())))
        elif (core := word.rstrip(b",.;:!?")) != word and core.decode("utf-8", "surrogatepass").lower()[-1:].isalpha():
            # A letter never joins the marks behind it, so that both have their ids for themselves.
            return self.parts[core] + self.parts[word[len(core) :]]
        return self.parts[word] if len(word) <= 64 and not word.isascii() else self.encode(word.decode("utf-8", "surrogatepass"))

    def __call__(self, text: str | None) -> bytes:
        if not text:
            return b""
        if not self.by_word:
            return self.encode(text)
        return b"".join(map(self.words.__getitem__, text_bytes(text).split()))


    def learn(self, words: list[bytes]) -> None:
        """Remember the ids of words that are letters of ASCII and Latin-1 with marks behind them: one pre-token and another
        for the marks, which reach the model as the vocabulary's stand-ins of their bytes."""
        tokenize, parts, put = self.model.tokenize, self.parts, self.words.put
        for w in words:
            if m := _LATIN.fullmatch(w):
                letters, marks = m.groups()
                low = letters.lower() if letters.isascii() else letters.decode().lower().encode()
                ids = array("I", [t.id for t in tokenize(codecs.charmap_decode(low, "strict", _STAND_INS)[0])]).tobytes()
                put(w, ids + parts[marks] if marks else ids)

    def of_texts(self, texts: list[bytes]) -> list[bytes]:
        """Ids of each of some texts in UTF-8."""
        if not self.by_word:
            return [self.encode(t.decode("utf-8", "surrogatepass")) if t else b"" for t in texts]
        data = b"\n".join(texts)
        starts, ends, group, first = distinct_words(data)
        distinct = [data[a:b] for a, b in zip(starts[first].tolist(), ends[first].tolist())]
        self.learn([w for w in distinct if w not in self.words and w not in self.words.old])
        found = list(map(self.words.__getitem__, distinct))
        flat = np.frombuffer(b"".join(found), np.uint32)
        sizes = np.fromiter(map(len, found), np.int64, len(found)) // 4
        begins = np.cumsum(sizes) - sizes
        wanted = sizes[group]
        upto = np.concatenate([[0], np.cumsum(wanted)])
        ids = flat[np.repeat(begins[group] - upto[:-1], wanted) + np.arange(upto[-1])]
        offsets = np.cumsum([0] + [len(t) + 1 for t in texts])
        cuts = upto[np.searchsorted(starts, offsets)].tolist()
        return [ids[a:b].tobytes() for a, b in zip(cuts, cuts[1:])]


def distinct_words(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Where the words of some text begin and end, the number of each one's group, and a word of each group. Words of 16
    bytes at most are in one group exactly if they are equal; each longer one is a group of its own."""
    raw = np.frombuffer(data + b" " * 16, np.uint8)
    edges = np.ones(len(data) + 2, dtype=np.int8)
    edges[1:-1] = WHITE[raw[: len(data)]]
    edges = np.diff(edges)
    starts, ends = np.flatnonzero(edges == -1), np.flatnonzero(edges == 1)
    sizes = ends - starts
    eight = np.ndarray((len(raw) - 7,), "<u8", raw, strides=(1,))  # the eight bytes from each place on
    masks = np.array([(1 << (8 * i)) - 1 for i in range(9)], dtype=np.uint64)
    head = eight[starts] & masks[np.minimum(sizes, 8)]
    tail = np.where(sizes > 8, eight[np.maximum(ends - 8, 0)], np.uint64(0))
    key = mix(head, 3) ^ mix(tail, 5) ^ mix(sizes.astype(np.uint64), 7)
    _, first, group = np.unique(key, return_index=True, return_inverse=True)
    of = first[group]
    alone = np.flatnonzero((sizes > 16) | (head != head[of]) | (tail != tail[of]) | (sizes != sizes[of]))
    group[alone] = len(first) + np.arange(len(alone))
    return starts, ends, group, np.concatenate([first, alone])


_IDS: dict[tuple[str, int], WordIds] = {}


def word_ids(path: str, words: int) -> WordIds:
    if (path, words) not in _IDS:
        _IDS[path, words] = WordIds(path, words)
    return _IDS[path, words]


def piece_lengths(tokens: int, longest: int) -> list[int]:
    """Powers of two, largest first, that add up to `tokens`; `longest` is itself a power of two."""
    out = [longest] * (tokens // longest)
    rest = tokens % longest
    bit = longest >> 1
    while bit:
        if rest & bit:
            out.append(bit)
        bit >>= 1
    return out


def stretches(column: pa.Array, most: int = 4_000_000) -> Iterator[tuple[int, list[bytes]]]:
    """Texts of a column in stretches of about `most` bytes, each with the place of its first; null is empty."""
    begin, size, texts = 0, 0, []
    for i, text in enumerate(column.cast(pa.binary())):
        texts.append(text.as_py() or b"")
        size += len(texts[-1])
        if size >= most:
            yield begin, texts
            begin, size, texts = i + 1, 0, []
    if texts:
        yield begin, texts


PIECES = StructType([StructField("doc_id", LongType()), StructField("start", LongType()), StructField("length", LongType()), StructField("doc_tokens", LongType()), StructField("bucket", IntegerType()), StructField("ids", BinaryType())])


def pack(docs: DataFrame, vocabulary: str, *, max_length: int = 2048, end_id: int = 1, words: int = 500_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`words` is how many words a worker remembers the ids of, twice at most. A row per piece: doc_id, start, length, doc_tokens, bucket (log2 of length), ids (little-endian unsigned
    32-bit), sequence_id (one for each piece, unique over the table), offset (always 0)."""
    if max_length < 1 or max_length & (max_length - 1):
        raise ValueError("max_length must be a power of two")
    ship(docs.sparkSession)
    names = [f.name for f in PIECES]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = word_ids(vocabulary, words), array("I", [end_id]).tobytes()

        def out(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(),) * 4 + (pa.int32(), pa.binary()))], names)

        for batch in tidy(batches):
            ids_of = batch.column(0).to_pylist()
            for begin, texts in stretches(batch.column(1)):
                with no_collector():
                    encoded = encode.of_texts(texts)
                rows = []
                for doc_id, ids in zip(ids_of[begin:], encoded):
                    ids, start = ids + end, 0
                    tokens = len(ids) // 4
                    for n in piece_lengths(tokens, max_length):
                        rows.append((doc_id, start, n, tokens, n.bit_length() - 1, ids[4 * start : 4 * (start + n)]))
                        start += n
                yield out(rows)

    pieces = docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(run, PIECES)
    return pieces.withColumns({"sequence_id": F.monotonically_increasing_id(), "offset": F.lit(0).cast("long")})


def write_buckets(pieces: DataFrame, path: str) -> None:
    """One folder for each sequence length, so that batches of equal lengths are read without a filter."""
    pieces.write.partitionBy("bucket").parquet(path)
