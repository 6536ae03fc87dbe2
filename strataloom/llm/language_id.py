"""Language identification by multinomial naive Bayes over hashed character n-grams.

Texts are lower-cased; whatever isn't a letter becomes one space. Every n-gram of 1 to 3 characters is hashed into a
fixed number of buckets. Training counts each language's buckets: a task emits at most languages x buckets rows, which
Spark sums. The log-probability matrix (languages x buckets, 32-bit floats) is broadcast; MAX_LANGUAGES bounds it, and
more languages are an error. A batch of texts is a sparse matrix, the buckets of each text one after the other with an
offset for each text; it is scored by gathering the rows of the log-probability matrix and adding them up by text.

Null text or a text without a letter is predicted as `und` with score 0. Ties go to the language that sorts first. A
document with null lang is never learned from. With nothing to learn from, everything is `und`.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StringType, StructField, StructType

from .common import ship, tidy

_LETTER = regex.compile(r"\p{L}")
_OTHER = regex.compile(r"[^\p{L}\p{M}]+")
UNKNOWN = "und"
MAX_LANGUAGES = 512
#: n-grams that are scored together.
SLICE = 1 << 20


@dataclass(frozen=True)
class Model:
    langs: list[str]
    logp: np.ndarray  # buckets x languages, float32
    prior: np.ndarray  # languages
    buckets: int
    orders: tuple[int, ...]


def ngrams(text: str, buckets: int, orders: tuple[int, ...]) -> np.ndarray:
    """Buckets of all n-grams of a text, in no particular order; buckets is a power of two."""
    chars = np.frombuffer(f" {_OTHER.sub(' ', text.lower()).strip()} ".encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    out, shift = [], np.uint32(32 - (buckets.bit_length() - 1))
    with np.errstate(over="ignore"):
        key = np.zeros(len(chars), dtype=np.uint32)
        for n in range(1, max(orders) + 1):
            if len(chars) < n:
                break
            key = key[: len(chars) - n + 1] * np.uint32(0x01000193) + chars[n - 1 :] + np.uint32(n)
            if n in orders:
                out.append((key ^ (key >> np.uint32(15))) * np.uint32(0x9E3779B1) >> shift)
    return np.concatenate(out) if out else np.zeros(0, dtype=np.uint32)


def train(docs: DataFrame, *, text_col: str = "text", lang_col: str = "lang", buckets: int = 1 << 15, orders: tuple[int, ...] = (1, 2, 3), smoothing: float = 0.1) -> Model:
    """Learn from every row of docs with a text and a lang. The driver receives languages x buckets sums."""
    ship(docs.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables: dict[str, np.ndarray] = {}
        seen: dict[str, int] = {}
        for batch in tidy(batches):
            for text, lang in zip(batch.column(0), batch.column(1).to_pylist()):
                text = text.as_py()
                if not _LETTER.search(text):
                    continue
                seen[lang] = seen.get(lang, 0) + 1
                table = tables.setdefault(lang, np.zeros(buckets, dtype=np.int64))
                table += np.bincount(ngrams(text, buckets, orders), minlength=buckets)
        for lang, table in tables.items():
            at = np.flatnonzero(table)
            at, n = np.append(at, -1), np.append(table[at], seen[lang])
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int64()), pa.array(n, pa.int64())], ["lang", "bucket", "n"])

    rows = docs.select(F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang")).filter("text IS NOT NULL AND lang IS NOT NULL")
    if rows.select("lang").distinct().limit(MAX_LANGUAGES + 1).count() > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages to learn")
    sums = rows.mapInArrow(count, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    langs = sorted(set(sums.column("lang").to_pylist()))
    index = {x: i for i, x in enumerate(langs)}
    where = np.array([index[x] for x in sums.column("lang").to_pylist()], dtype=np.int64)
    at, n = sums.column("bucket").to_numpy(), sums.column("n").to_numpy()
    table, prior = np.full((buckets, len(langs)), smoothing), np.zeros(len(langs))
    real = at >= 0
    table[at[real], where[real]] += n[real]
    prior[where[~real]] = n[~real]
    logp = np.log(table) - np.log(table.sum(axis=0, keepdims=True)) if langs else table
    return Model(langs, logp.astype(np.float32), np.log(prior / prior.sum()) if langs else prior, buckets, orders)


def totals(model: Model, found: list[np.ndarray]) -> np.ndarray:
    """Prior plus log-probabilities of the buckets of each text: texts x languages. A long text comes in slices."""
    out = np.zeros((len(found), len(model.langs)))
    owners = np.repeat(np.arange(len(found)), [-(-len(x) // SLICE) for x in found])
    parts = [x[i : i + SLICE] for x in found for i in range(0, len(x), SLICE)]
    at = 0
    while at < len(parts):
        upto, size = at, 0
        while upto < len(parts) and (upto == at or size + len(parts[upto]) <= SLICE):
            size += len(parts[upto])
            upto += 1
        lengths = np.array([len(x) for x in parts[at:upto]])
        sums = np.add.reduceat(model.logp[np.concatenate(parts[at:upto])], np.cumsum(lengths) - lengths, axis=0, dtype=np.float64)
        np.add.at(out, owners[at:upto], sums)
        at = upto
    return out + model.prior


def predict_batch(model: Model, texts: pa.Array) -> tuple[list[str], list[float]]:
    langs, scores, where, found = [UNKNOWN] * len(texts), [0.0] * len(texts), [], []
    if not model.langs:
        return langs, scores

    def settle() -> None:
        total = totals(model, found)
        best = total.argmax(axis=1)
        score = 1.0 / np.exp(total - total.max(axis=1, keepdims=True)).sum(axis=1)
        for i, lang, p in zip(where, best.tolist(), score.tolist()):
            langs[i], scores[i] = model.langs[lang], p
        where.clear()
        found.clear()

    size = 0
    for i, text in enumerate(texts):
        text = text.as_py()
        if text is None or not _LETTER.search(text):
            continue
        where.append(i)
        found.append(ngrams(text, model.buckets, model.orders))
        size += len(found[-1])
        if size >= SLICE:
            settle()
            size = 0
    if found:
        settle()
    return langs, scores


def predict(spark: SparkSession, docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per document: doc_id, lang_pred, score (posterior of the language named). Only the text is looked at."""
    ship(spark)
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in tidy(batches):
            langs, scores = predict_batch(shared.value, batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "lang_pred", "score"])

    schema = StructType([StructField("doc_id", LongType()), StructField("lang_pred", StringType()), StructField("score", DoubleType())])
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, schema)


def held_out(id_col: str = "doc_id"):
    """One fifth of the documents, by a checksum of the id as text; a null id counts as empty text."""
    return F.crc32(F.encode(F.coalesce(F.col(id_col).cast("string"), F.lit("")), "UTF-8")) % 5 == 0
