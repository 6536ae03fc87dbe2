"""Secret scans by one automaton for all rules.

The patterns of all rules become one deterministic automaton over bytes (automaton.py: subset construction, then
minimisation into a transition array). A batch of texts is walked once, backwards, in lanes that step together in
numpy; a state's marks tell which rules can match from that byte on. Only there the rule's own automata find where the
match ends, so that matches are leftmost, longest and don't overlap within a rule.

A rule is a head and a body; `least` is the shortest body that counts. Matches are found first and short ones dropped
then, so that what a short match covers begins no other. Patterns name ASCII bytes; places are counted in code points.

No shuffle, and memory for a batch of bytes beyond the longest text. Null texts count as empty and have no spans; a row
is given for every document, repeated ones too, null ids as they are; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .automaton import Automaton
from .common import ship, tidy


@dataclass(frozen=True)
class Rule:
    kind: str
    body: str
    least: int = 1
    head: str = ""
    #: Letters of the head in either case.
    fold: bool = False


#: The base rules. A run of hexadecimal digits is cut where it is matched, as shorter ones begin everywhere.
BASE = (
    Rule("assign", "[A-Za-z0-9+/_.=-]+", 8, r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?""", True),
    Rule("access", "AKIA[A-Z0-9]+", 16),
    Rule("hex", "[0-9a-f]{32,}", 32),
)
#: Public forms of other secrets.
MORE = (
    Rule("pem", "-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("forge", "gh[pousr]_[A-Za-z0-9]+", 40),
    Rule("chat", "xox[abprs]-[A-Za-z0-9-]+", 24),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+"),
)
RULES = BASE + MORE


class Scanner:
    def __init__(self, rules: tuple[Rule, ...]):
        self.rules = rules
        self.all = Automaton([((r.head, r.fold), (r.body, False)) for r in rules], backwards=True, anywhere=True)
        self.heads = [Automaton([((r.head, r.fold),)]) if r.head else None for r in rules]
        self.bodies = [Automaton([((r.body, False),)]) for r in rules]

    def spans(self, texts: list[bytes]) -> list[list[tuple[int, int, int]]]:
        """(start, rule, end) of each text in bytes, sorted."""
        data = b"\xff".join(texts)
        where, marks = self.all.marks_backwards(data)
        out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
        if not len(where):
            return out
        offsets = np.cumsum([0] + [len(t) + 1 for t in texts[:-1]])
        of = np.searchsorted(offsets, where, "right") - 1
        free = {}
        for at, text, bits in zip((where - offsets[of]).tolist(), of.tolist(), marks.tolist()):
            for i in range(len(self.rules)):
                if bits >> i & 1 and at >= free.get((text, i), 0):
                    begin = self.heads[i].longest(texts[text], at) if self.heads[i] else at
                    end = self.bodies[i].longest(texts[text], begin)
                    free[text, i] = end
                    if end - begin >= self.rules[i].least:
                        out[text].append((at, i, end))
        for spans in out:
            spans.sort()
        return out


def in_code_points(text: bytes, spans: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    if not spans or text.isascii():
        return spans
    before = np.concatenate([[0], np.cumsum((np.frombuffer(text, np.uint8) & 0xC0) != 0x80)])
    return [(int(before[a]), i, int(before[b])) for a, i, b in spans]


_SCANNERS: dict[tuple[Rule, ...], Scanner] = {}


def scanner(rules: tuple[Rule, ...]) -> Scanner:
    if rules not in _SCANNERS:
        _SCANNERS[rules] = Scanner(rules)
    return _SCANNERS[rules]


def _batches(batch: pa.RecordBatch, most: int = 4_000_000) -> Iterator[tuple[int, int, list[bytes]]]:
    """Rows of a batch in stretches of about `most` bytes: first row, row behind the last, texts."""
    begin, size, texts = 0, 0, []
    for i, text in enumerate(batch.column(1).cast(pa.binary())):
        texts.append(text.as_py() or b"")
        size += len(texts[-1])
        if size >= most:
            yield begin, i + 1, texts
            begin, size, texts = i + 1, 0, []
    if texts:
        yield begin, batch.num_rows, texts


_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))


def find_secrets(docs: DataFrame, *, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per document: doc_id, spans (kind, start, end in code points; by start, then in the order of the rules)."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scan = scanner(rules)
        for batch in tidy(batches):
            for begin, end, texts in _batches(batch):
                spans = [[{"kind": rules[i].kind, "start": a, "end": b} for a, i, b in in_code_points(text, found)] for text, found in zip(texts, scan.spans(texts))]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(begin, end - begin), pa.array(spans, _SPANS)], ["doc_id", "spans"])

    return docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(run, "doc_id long, spans array<struct<kind: string, start: long, end: long>>")


def joined(spans: Column) -> Column:
    """kind:start:end, joined by commas."""
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))


def of_kinds(spans: Column, kinds: list[str]) -> Column:
    return F.filter(spans, lambda s: s["kind"].isin(kinds))


def redact(docs: DataFrame, *, rules: tuple[Rule, ...] = RULES, text_col: str = "text", mark: str = "[secret]") -> DataFrame:
    """docs with each secret in text_col replaced by `mark`, overlapping ones by one mark; null texts stay null. All other
    columns are kept."""
    ship(docs.sparkSession)
    at, sign = docs.columns.index(text_col), mark.encode()

    def clean(text: bytes, spans: list[tuple[int, int, int]]) -> bytes:
        out, upto = [], 0
        for a, _, b in spans:
            if a >= upto:
                out += [text[upto:a], sign]
            upto = max(upto, b)
        return b"".join([*out, text[upto:]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scan = scanner(rules)
        for batch in tidy(batches):
            column = batch.column(at)
            for begin, end, texts in _batches(pa.RecordBatch.from_arrays([column, column], ["a", "b"])):
                part = batch.slice(begin, end - begin)
                found = pa.array([clean(t, s) for t, s in zip(texts, scan.spans(texts))], pa.binary()).cast(column.type)
                null = part.column(at).is_null()
                arrays = list(part.columns)
                arrays[at] = pa.compute.if_else(null, pa.scalar(None, column.type), found)
                yield pa.RecordBatch.from_arrays(arrays, schema=part.schema)

    return docs.mapInArrow(run, docs.schema)
