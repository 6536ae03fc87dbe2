"""Ranked lexical search by Block-Max MaxScore over an inverted index in shards.

Terms are runs of ASCII letters and digits and of everything beyond ASCII, A-Z lower-cased. A task indexes its own
documents, one shard for each stretch of bounded size, so that no postings are shuffled to make the index. A term's
postings in a shard are blocks of 128: places and counts in as few bytes as they need, with the block's first place and
its greatest impact (the exact integer factor that a document's count and length give) readable without them.

A query is searched in each shard that holds one of its terms. Lists are read whole from the greatest bound down, until
the bounds of those left add up to less than the k-th score so far: documents outside what was read can't enter then.
Of the documents read, those whose score and block maxima in the other lists stay below the k-th score are rejected
before a block of those lists is decoded; blocks without survivors are never decoded. Shards give k documents each, and
the best k of those are the result. Bounds are exact integers and documents are rejected only when strictly below, so
that nothing that could be in the result is lost, ties by smallest id included.

Queries are taken in blocks of bounded size, each broadcast against the index. Null texts have no terms; documents
without terms count in nothing; queries without terms, or whose terms no document has, have no rows. Each row of
documents and of queries stands for itself, repeated ones too; null ids sort first among equal scores. Other columns are
not read.
"""

from __future__ import annotations

import itertools
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import lower_ascii, ship, tidy, written

#: Terms in SQL; term_list is the same over UTF-8.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_FORM = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))
BLOCK = 128
#: A place in a shard takes two bytes at most.
MOST_DOCUMENTS = 1 << 16
SCALE = 1_000_000_000


def term_list(text: bytes) -> list[bytes]:
    return text.translate(_FORM).split()


def corpus_size(docs: DataFrame, *, text_col: str = "text") -> tuple[int, int]:
    """Documents with a term, and all terms with repeats."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = total = 0
        for batch in tidy(batches):
            for text in batch.column(0).cast(pa.binary()):
                count = len(term_list(text.as_py() or b""))
                n, total = n + (count > 0), total + count
        yield pa.RecordBatch.from_pylist([{"n": n, "total": total}])

    sums = docs.select(F.col(text_col).cast("string")).mapInArrow(run, "n long, total long").agg(F.sum("n"), F.sum("total")).first()
    return sums[0] or 0, sums[1] or 0


def length_factor(terms: np.ndarray, n: int, total: int) -> np.ndarray:
    return 75 + (25 * terms * n) // max(total, 1)


def impact(counts: np.ndarray, factors: np.ndarray) -> np.ndarray:
    return (SCALE * counts) // (1000 * counts + 12 * factors)


class _Numbers(dict):
    """Numbers of terms in the order in which they are first seen."""

    def __missing__(self, term: bytes) -> int:
        self[term] = number = len(self)
        return number


INDEX = "shard long, term string, n long, top long, first binary, best binary, places binary, counts binary"
_INDEX = pa.schema([("shard", pa.int64()), ("term", pa.string()), ("n", pa.int64()), ("top", pa.int64()), *((c, pa.binary()) for c in ("first", "best", "places", "counts"))])


class _Shard:
    """Documents of a shard while it is made."""

    def __init__(self):
        self.numbers, self.terms, self.lengths, self.ids, self.size = _Numbers(), array("i"), [], [], 0

    def add(self, doc_id: int | None, text: bytes) -> None:
        terms = term_list(text)
        if terms:
            self.terms.extend(map(self.numbers.__getitem__, terms))
            self.lengths.append(len(terms))
            self.ids.append(doc_id)
            self.size += len(text)

    def rows(self, shard: int, n: int, total: int, at_once: int = 20_000) -> Iterator[pa.RecordBatch]:
        """A row for each term, and one without a term: `places` are ids, `counts` factors, `first` tells null ids."""
        if not self.ids:
            return
        lengths = np.array(self.lengths, dtype=np.int64)
        factors = length_factor(lengths, n, total)
        keys = np.frombuffer(self.terms, np.int32).astype(np.int64) << 16
        keys |= np.repeat(np.arange(len(lengths)), lengths)
        keys.sort()
        at = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        counts = np.diff(np.append(at, len(keys)))
        keys = keys[at]
        places, term = keys & 0xFFFF, keys >> 16
        impacts = impact(counts, factors[places])
        heads = np.flatnonzero(np.concatenate([[True], term[1:] != term[:-1]]))  # terms are numbered without a gap
        sizes = np.diff(np.append(heads, len(term)))
        blocks = -(-sizes // BLOCK)
        block_heads = np.concatenate([[0], np.cumsum(blocks)])
        within = np.arange(block_heads[-1]) - np.repeat(block_heads[:-1], blocks)
        begins = np.repeat(heads, blocks) + within * BLOCK
        first, best = places[begins], np.maximum.reduceat(impacts, begins)
        gaps = places - np.repeat(first, np.diff(np.append(begins, len(places))))
        tops = np.maximum.reduceat(impacts, heads)
        widest, most = np.maximum.reduceat(gaps, heads), np.maximum.reduceat(counts, heads)
        first, best = first.astype("<u2"), best.astype("<i4")
        gap_forms, count_forms = [gaps.astype("<u1"), gaps.astype("<u2")], [counts.astype("<u1"), counts.astype("<u4")]
        names = list(self.numbers)
        empty = np.array([i is None for i in self.ids])
        ids = np.array([i or 0 for i in self.ids], dtype="<i8")
        yield pa.RecordBatch.from_pylist([{"shard": shard, "term": None, "n": len(ids), "top": 0, "first": empty.tobytes(), "best": b"", "places": ids.tobytes(), "counts": factors.astype("<i8").tobytes()}], _INDEX)
        for begin in range(0, len(names), at_once):
            part = range(begin, min(begin + at_once, len(names)))
            ends = [(heads[i], heads[i] + sizes[i], block_heads[i], block_heads[i + 1]) for i in part]
            yield pa.RecordBatch.from_arrays([
                pa.array([shard] * len(part)), pa.array([names[i] for i in part], pa.binary()).cast(pa.string()), pa.array(sizes[begin : part.stop]), pa.array(tops[begin : part.stop]),
                pa.array([first[c:d].tobytes() for _, _, c, d in ends], pa.binary()), pa.array([best[c:d].tobytes() for _, _, c, d in ends], pa.binary()),
                pa.array([gap_forms[int(widest[i] > 255)][a:b].tobytes() for i, (a, b, _, _) in zip(part, ends)], pa.binary()),
                pa.array([count_forms[int(most[i] > 255)][a:b].tobytes() for i, (a, b, _, _) in zip(part, ends)], pa.binary()),
            ], schema=_INDEX)


def build_index(docs: DataFrame, n: int, total: int, *, shard_bytes: int = 16_000_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The index as a written table. n and total are the sizes of the whole corpus. A shard holds `shard_bytes` of text and
    what its last document has beyond, 65,536 documents at most."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, number = _Shard(), TaskContext.get().partitionId() << 32
        for batch in tidy(batches):
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary())):
                shard.add(doc_id, text.as_py() or b"")
                if shard.size >= shard_bytes or len(shard.ids) == MOST_DOCUMENTS:
                    yield from shard.rows(number, n, total)
                    shard, number = _Shard(), number + 1
        yield from shard.rows(number, n, total)

    return written(docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string")).mapInArrow(run, INDEX), "index")


def weight(n: int) -> Column:
    return F.floor(F.lit(1000.0) * F.log(F.lit(2.0 * n + 2) / (2.0 * F.col("df") + 1))).cast("long")


class Postings:
    """A term's list in a shard, decoded block by block."""

    def __init__(self, weight: int, n: int, top: int, first: bytes, best: bytes, places: bytes, counts: bytes):
        self.n, self.bound = n, weight * top
        self.weight, self.places, self.counts = weight, places, counts
        self.first, self.best = np.frombuffer(first, "<u2"), np.frombuffer(best, "<i4")
        self.gap_type, self.count_type = ("<u1", "<u2")[len(places) > n], ("<u1", "<u4")[len(counts) > n]

    def bounds(self, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Blocks that would hold the places wanted, and what they can add; -1 and 0 before the first block."""
        block = np.searchsorted(self.first, wanted, "right") - 1
        return block, np.where(block < 0, 0, self.weight * self.best[block].astype(np.int64))

    def decode(self, blocks: np.ndarray | None, factors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of some blocks, or of all, and what they add to a score."""
        gaps, counts = np.frombuffer(self.places, self.gap_type), np.frombuffer(self.counts, self.count_type)
        if blocks is None:
            places = gaps + np.repeat(self.first.astype(np.int64), BLOCK)[: self.n]
        else:
            at = (blocks[:, None] * BLOCK + np.arange(BLOCK)).ravel()
            at = at[at < self.n]
            gaps, counts = gaps[at], counts[at]
            places = gaps + self.first[at // BLOCK].astype(np.int64)
        return places, self.weight * impact(counts.astype(np.int64), factors[places])


class Searcher:
    """Best documents of a shard. `decoded` counts blocks that were decoded, `all` those of the lists asked for."""

    def __init__(self, ids: np.ndarray, no_id: np.ndarray, factors: np.ndarray, k: int):
        self.ids, self.no_id, self.factors, self.k = ids, no_id, factors, k
        self.scores = np.zeros(len(ids), dtype=np.int64)
        self.decoded = self.all = 0

    def kth(self, places: np.ndarray) -> int:
        """The k-th score so far: a lower limit of what the last document of the result has."""
        if len(places) < self.k:
            return 0
        return int(np.partition(self.scores[places], len(places) - self.k)[len(places) - self.k])

    def best(self, lists: list[Postings]) -> tuple[np.ndarray, np.ndarray]:
        """Places and scores of the k best."""
        lists = sorted(lists, key=lambda p: p.bound)
        self.all += sum(len(p.first) for p in lists)
        below = list(itertools.accumulate((p.bound for p in lists), initial=0))  # below[i]: what lists before i can add
        seen, rest, limit = np.zeros(0, dtype=np.int64), len(lists), 0
        while rest and (below[rest] >= limit or not limit):  # essential lists
            rest -= 1
            places, adds = lists[rest].decode(None, self.factors)
            self.decoded += len(lists[rest].first)
            new = places[self.scores[places] == 0]
            self.scores[places] += adds
            seen = np.concatenate([seen, new[self.scores[new] > 0]])
            if rest and below[rest]:
                limit = self.kth(seen)
        touched, alive = seen, np.sort(seen)
        alive = alive[self.scores[alive] + below[rest] >= limit]
        if rest and len(alive):
            found = [p.bounds(alive) for p in lists[:rest]]
            block, bound = np.array([f[0] for f in found]), np.array([f[1] for f in found])
            ahead = np.cumsum(bound, axis=0)  # what the lists up to one can add by their blocks
            for i in range(rest - 1, -1, -1):
                stay = self.scores[alive] + ahead[i] >= limit
                alive, block, ahead = alive[stay], block[:, stay], ahead[:, stay]
                blocks = np.unique(block[i][block[i] >= 0])
                if len(blocks):
                    self.decoded += len(blocks)
                    places, adds = lists[i].decode(blocks, self.factors)
                    at = np.searchsorted(places, alive)
                    at[at == len(places)] = 0
                    hit = places[at] == alive
                    self.scores[alive[hit]] += adds[at[hit]]
                    limit = max(limit, self.kth(alive))
        alive = alive[(self.scores[alive] > 0) & (self.scores[alive] >= limit)]
        scores = self.scores[alive].copy()
        self.scores[touched] = 0
        order = np.lexsort((self.ids[alive], ~self.no_id[alive], -scores))[: self.k]
        return alive[order], scores[order]


def _blocks(rows: Iterator[Row], most: int) -> Iterator[dict[int, list[tuple[str, int]]]]:
    """Queries with their weighted terms, in blocks of `most` terms and what the last query has beyond."""
    block, size = {}, 0
    for r in rows:
        block[r.query] = list(zip(r.terms, r.weights))
        size += len(r.terms)
        if size >= most:
            yield block
            block, size = {}, 0
    if block:
        yield block


FOUND = "query long, doc_id long, score long"
_FOUND = pa.schema([("query", pa.int64()), ("doc_id", pa.int64()), ("score", pa.int64())])


def _search_block(index: DataFrame, block: dict[int, list[tuple[str, int]]], k: int) -> DataFrame:
    """The k best documents of each query of a block in each shard."""
    spark = index.sparkSession
    wanted = spark.createDataFrame([(t,) for t in sorted({t for terms in block.values() for t, _ in terms})], "term string")
    lists = index.join(F.broadcast(wanted), "term", "left_semi").unionByName(index.filter("term IS NULL"))
    shared = spark.sparkContext.broadcast(block)

    def search(part: pa.Table) -> pa.Table:
        lists, searcher = {}, None
        for r in part.to_pylist():
            if r["term"] is not None:
                lists[r["term"]] = (r["n"], r["top"], r["first"], r["best"], r["places"], r["counts"])
            else:
                searcher = Searcher(np.frombuffer(r["places"], "<i8"), np.frombuffer(r["first"], bool), np.frombuffer(r["counts"], "<i8"), k)
        out = []
        for query, terms in shared.value.items():
            places, scores = searcher.best([Postings(w, *lists[t]) for t, w in terms if w and t in lists])
            if len(places):
                ids = pa.array(searcher.ids[places], mask=searcher.no_id[places])
                out.append(pa.Table.from_arrays([pa.array(np.full(len(places), query)), ids, pa.array(scores)], schema=_FOUND))
        return pa.concat_tables(out) if out else _FOUND.empty_table()

    return lists.groupBy("shard").applyInArrow(search, FOUND)


def search(index: DataFrame, n: int, queries: DataFrame, *, k: int = 20, block_terms: int = 65_536, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """item_id, rank (from 1), doc_id, score of the k best documents of each row of queries, those with score above 0."""
    ship(index.sparkSession)
    asked = written(_asked(queries, id_col, text_col), "queries")
    terms = asked.select("query", F.explode("terms").alias("term")).groupBy("query", "term").agg(F.count("*").alias("times"))
    df = index.filter("term IS NOT NULL").join(terms.select("term").distinct(), "term", "left_semi").groupBy("term").agg(F.sum("n").alias("df"))
    weighted = terms.join(df, "term").select("query", "term", (weight(n) * F.col("times")).alias("weight"))
    whole = weighted.groupBy("query").agg(F.sort_array(F.collect_list(F.struct("term", "weight"))).alias("x")).select("query", F.col("x.term").alias("terms"), F.col("x.weight").alias("weights"))
    found = [written(_search_block(index, block, k), "found") for block in _blocks(whole.orderBy("query").toLocalIterator(), block_terms)]
    spark = index.sparkSession
    all_found = spark.createDataFrame([], FOUND)
    for part in found:
        all_found = all_found.unionByName(part)
    best = Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_first("doc_id"))
    ranked = all_found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    return ranked.join(asked.select("query", "item_id"), "query").select("item_id", F.col("rank").cast("int"), "doc_id", "score")


def _asked(queries: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = lower_ascii(F.col(text_col).cast("string"))
    return queries.select(F.monotonically_increasing_id().alias("query"), F.col(id_col).alias("item_id"), F.regexp_extract_all(text, F.lit(f"({TERM})"), F.lit(1)).alias("terms"))


def rank(docs: DataFrame, queries: DataFrame, *, k: int = 20) -> DataFrame:
    """The k best documents of each query, over an index that is made for it."""
    n, total = corpus_size(docs)
    return search(build_index(docs, n, total), n, queries, k=k)
