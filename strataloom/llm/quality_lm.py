"""Perplexity under an interpolated modified Kneser-Ney n-gram model, thresholded by language.

The model runs over the characters of running text: `order - 2` pad characters, then each word with a space before it,
and a space at the end; every character after the first space is predicted from the order - 1 before it, across word
borders too. Words are runs of anything but ASCII white space, case kept, whole texts. It is trained on trusted
documents alone: counts grow with the trusted text, are summed in shards by n-gram, and continuation
counts, context totals and discounts come from joins and aggregations of those shards.

Scoring is a sum over n-grams: log p of a character is that of the unknown character, plus for each order whose
n-gram the model has the gain over the order below, plus for each known context the logarithm of its back-off weight.
Gains and weights are one table keyed by n-gram. Its most frequent rows, at most `head`, are broadcast as sorted
arrays; n-grams that a bitmap of fixed size lets through as possible others are joined with the rest of the table in
shards and summed by document. What is broadcast therefore never grows with the corpus, and no n-gram is left out.
Tasks know n-grams by 64-bit hashes; that two of a corpus share one is less likely than 1e-5 at ten million n-grams.

A model knows its own texts too well, so documents are dealt into `folds` by a hash of their ids, and a document is
scored by the model of the trusted documents of the other folds: no document, trusted or not, by a model that has seen
it, and all trusted documents set limits. The verdict compares the mean negative log-probability of a document's
characters, drawn towards the mean of its language by `prior` characters so that short texts aren't judged by chance,
with a limit of its language, and keeps what is at the limit or below:

* the `quantile` of that figure over the trusted documents of the language, where there are `least` of them or more
  (with fewer than 1 / (1 - quantile) a quantile is their maximum);
* with fewer, that quantile or the language's mean plus what trusted documents of all languages are above theirs (the
  quantile, or that of a normal distribution as wide), whichever is largest: what isn't known of a language doesn't
  count against its documents;
* without any, the quantile over all trusted documents.

Quantiles are exact up to 10,000 trusted documents and off by a ten-thousandth of the ranks at most beyond. Where a
fold has no trusted document there is one model of all of them, which scores everything. Empty or null texts have no
perplexity and aren't kept. Null lang is a language of its own, the empty one. Repeated rows give repeated rows.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Sequence
from functools import reduce
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bitmap import BITS, collect_bitmap, contains, positions
from .common import discard, mix, ship, shared_dir, text_bytes, tidy, written

PAD = "\x02"

#: Characters that are looked at together.
CHUNK = 1 << 20
_START, _STEP = np.uint64(0x2545F4914F6CDD1D), np.uint64(0x9E3779B97F4A7C15)


def padded(text: str, order: int) -> str:
    """The characters of a text as the model sees them; a text without words has none."""
    words = text_bytes(text).split()
    return PAD * (order - 2) + " " + b" ".join(words).decode("utf-8", "surrogatepass") + " " if words else ""


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)


def lengthened(keys: np.ndarray, chars: np.ndarray) -> np.ndarray:
    """Hashes of n-grams with a character more in front."""
    with np.errstate(over="ignore"):
        keys = (keys ^ (chars + np.uint64(1))) * _STEP
        return keys ^ (keys >> np.uint64(29))


def ending_at(chars: np.ndarray, order: int) -> Iterator[tuple[int, np.ndarray]]:
    """(n, hashes of the n-grams that end at each place from n - 1 on), n from 1 to order."""
    keys = np.full(len(chars), _START)
    for n in range(1, min(order, len(chars)) + 1):
        keys = lengthened(keys[1:] if n > 1 else keys, chars[: len(chars) - n + 1])
        yield n, keys


def gram_keys(grams: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of n-grams of any lengths, and of the same without their first characters."""
    keys, shorter = np.full(len(grams), _START), np.full(len(grams), _START)
    sizes = np.fromiter(map(len, grams), np.int64, len(grams))
    for n in np.unique(sizes[sizes > 0]):
        at = np.flatnonzero(sizes == n)
        chars = code_points("".join(grams[i] for i in at.tolist())).reshape(-1, n)
        key = np.full(len(at), _START)
        for k in range(n - 1, -1, -1):
            if k == 0:
                shorter[at] = key
            key = lengthened(key, chars[:, k])
        keys[at] = key
    return keys, shorter


def streams(texts: Iterator[str | None], order: int) -> Iterator[tuple[str, np.ndarray, np.ndarray]]:
    """Padded texts put together to about CHUNK characters, with the length and the place in `texts` of each. Longer
    texts come in pieces that share order - 1 characters, so that each n-gram of the order lies in one piece."""
    held, owners, size = [], [], 0
    for i, text in enumerate(texts):
        whole = padded(text, order) if text else ""
        for at in range(0, max(1, len(whole) - order + 1), CHUNK):
            held.append(whole[at : at + CHUNK + order - 1])
            owners.append(i)
            size += len(held[-1])
            if size >= CHUNK:
                yield "".join(held), np.array([len(x) for x in held]), np.array(owners)
                held, owners, size = [], [], 0
    if held:
        yield "".join(held), np.array([len(x) for x in held]), np.array(owners)


def count_ngrams(texts: DataFrame, order: int) -> DataFrame:
    """g, c: all n-grams of the highest order in texts(text), with counts, summed by n-gram."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, sums, grams = np.zeros(0, np.uint64), np.zeros(0, np.int64), []

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(grams, pa.string()), pa.array(sums)], ["g", "c"])

        for text, sizes, _ in streams((x.as_py() for batch in tidy(batches) for x in batch.column(0)), order):
            if not text:
                continue
            chars = code_points(text)
            for _, found in ending_at(chars, order):
                pass
            whole = np.ones(len(chars), dtype=bool)  # no n-gram crosses texts
            starts = np.cumsum(sizes) - sizes
            for k in range(order - 1):
                whole[starts[sizes > k] + k] = False
            last = np.flatnonzero(whole)
            new, first, n = np.unique(found[last - order + 1], return_index=True, return_counts=True)
            at = np.searchsorted(keys, new)
            known = np.zeros(len(new), dtype=bool)
            if len(keys):
                known = keys[np.minimum(at, len(keys) - 1)] == new
            sums[at[known]] += n[known]
            fresh = np.flatnonzero(~known)
            ends = last[first[fresh]].tolist()
            grams += [text[i - order + 1 : i + 1] for i in ends]
            keys, sums = np.concatenate([keys, new[fresh]]), np.concatenate([sums, n[fresh]])
            if len(keys) > 600_000:
                yield out()
                keys, sums, grams = np.zeros(0, np.uint64), np.zeros(0, np.int64), []
                continue
            by = np.argsort(keys, kind="stable")
            keys, sums, grams = keys[by], sums[by], [grams[i] for i in by.tolist()]
        if grams:
            yield out()

    return texts.select("text").mapInArrow(run, "g string, c long").groupBy("g").agg(F.sum("c").alias("c"))


def _discounts(counts: DataFrame) -> list[float]:
    """Of counts 1, 2 and 3 or more, from how many n-grams have counts 1 to 4; kept inside their bounds."""
    n = counts.agg(*[F.sum((F.col("c") == k).cast("long")).alias(f"n{k}") for k in (1, 2, 3, 4)]).first()
    n1, n2, n3, n4 = (float(x or 0) for x in n)
    y = n1 / (n1 + 2 * n2) if n1 + n2 else 0.5
    ratio = [n2 / n1 if n1 else 0.5, n3 / n2 if n2 else 0.5, n4 / n3 if n3 else 0.5]
    return [min(max(k + 1 - (k + 2) * y * ratio[k], 0.05), k + 0.95) for k in range(3)]


def _by_count(values: list[float], c: Column) -> Column:
    return F.when(c == 1, values[0]).when(c == 2, values[1]).otherwise(values[2])


def fit(texts: DataFrame, order: int = 5) -> tuple[DataFrame, float]:
    """(features, log p of an unknown character) of a model of texts(text). features: g, gain, backoff (null where g is
    no context), occ (how often g occurs as n-gram or context)."""
    shared_dir(texts.sparkSession)
    ship(texts.sparkSession)
    counts = {order: written(count_ngrams(texts, order).withColumn("occ", F.col("c")), "ngrams")}
    for n in range(order - 1, 0, -1):
        # How many different characters stand before it, and how often it occurs.
        counts[n] = written(counts[n + 1].groupBy(F.substring("g", 2, n).alias("g")).agg(F.count("*").alias("c"), F.sum("occ").alias("occ")), "ngrams")
    size = counts[1].count() + 1
    grams = contexts = None
    below = None
    unknown = float(-np.log(size))
    for n in range(1, order + 1):
        d = _discounts(counts[n])
        is_n = lambda k: (F.col("c") >= 3) if k == 3 else (F.col("c") == k)
        context = counts[n].groupBy(F.substring("g", 1, n - 1).alias("h")).agg(F.sum("c").alias("total"), F.sum("occ").alias("h_occ"), sum((d[k - 1] * F.sum(is_n(k).cast("long")) for k in (1, 2, 3)), F.lit(0.0)).alias("left"))
        context = context.withColumn("gamma", F.col("left") / F.col("total")).drop("left")
        rows = counts[n].withColumns({"h": F.substring("g", 1, n - 1), "s": F.substring("g", 2, n - 1)})
        own = (F.col("c") - _by_count(d, F.col("c"))) / F.col("total")
        if n == 1:
            first = context.first()
            unknown = float(np.log((first["gamma"] if first else 1.0) / size))
            rows = rows.join(context, "h").withColumn("p", own + F.col("gamma") / size).withColumn("gain", F.log("p") - unknown)
        else:
            rows = rows.join(context, "h").join(below, "s").withColumn("p", own + F.col("gamma") * F.col("p_below")).withColumn("gain", F.log("p") - F.log("gamma") - F.log("p_below"))
            part = context.select(F.col("h").alias("g"), F.log("gamma").alias("backoff"), "h_occ")
            contexts = part if contexts is None else contexts.unionByName(part)
        rows = written(rows.select("g", "p", "gain", "occ"), "model")
        below = rows.select(F.col("g").alias("s"), F.col("p").alias("p_below"))
        part = rows.select("g", "gain", "occ")
        grams = part if grams is None else grams.unionByName(part)
    features = grams.join(contexts, "g", "full_outer").select("g", F.coalesce("gain", F.lit(0.0)).alias("gain"), "backoff", F.greatest(F.coalesce("occ", F.lit(0)), F.coalesce("h_occ", F.lit(0))).alias("occ"))
    return written(features, "features"), unknown


class Head:
    """The most frequent n-grams: their hashes, sorted, with the sums of gains and of logarithms of back-off weights
    over each n-gram and all its suffixes. Every suffix of an n-gram in the model is in it too and is at least as
    frequent, so that a head that has an n-gram has its suffixes: the longest n-gram found settles a character."""

    def __init__(self, grams: Sequence[str], gains: np.ndarray, backoffs: np.ndarray):
        keys, shorter = gram_keys(grams)
        order = np.argsort(keys)
        self.keys, shorter = keys[order], shorter[order]
        self.gain, self.backoff = np.array(gains, dtype=np.float64)[order], np.array(backoffs, dtype=np.float64)[order]
        sizes = np.fromiter(map(len, grams), np.int64, len(grams))[order]
        self.index()
        for n in np.unique(sizes[sizes > 1]):
            at = np.flatnonzero(sizes == n)
            suffix = self.find(shorter[at])
            has = suffix >= 0
            self.gain[at[has]] += self.gain[suffix[has]]
            self.backoff[at[has]] += self.backoff[suffix[has]]

    def index(self) -> None:
        """Where the keys of each value of their upper bits begin."""
        self.bits = max(1, len(self.keys).bit_length())
        self.first = np.searchsorted(self.keys >> np.uint64(64 - self.bits), np.arange((1 << self.bits) + 1, dtype=np.uint64)).astype(np.int32)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The places of keys; -1 for those that aren't there."""
        part = (keys >> np.uint64(64 - self.bits)).astype(np.int64)
        at, end = self.first[part], self.first[part + 1]
        out = np.full(len(keys), -1, dtype=np.int32)
        live = np.flatnonzero(at < end)
        at, end, keys = at[live], end[live], keys[live]
        while len(live):
            hit = self.keys[at] == keys
            out[live[hit]] = at[hit]
            at += 1
            more = ~hit & (at < end)
            live, at, end, keys = live[more], at[more], end[more], keys[more]
        return out


def split_features(features: DataFrame, head: int) -> tuple[Head, DataFrame]:
    """The most frequent rows, at most `head` of them, and the others as a table."""
    steps = features.groupBy(F.least("occ", F.lit(100_000)).alias("occ")).count().orderBy(F.desc("occ")).collect()
    threshold, taken = 100_001, 0
    for row in steps:
        if taken + row["count"] > head:
            break
        taken += row["count"]
        threshold = row["occ"]
    top = features.filter(F.col("occ") >= threshold).select("g", "gain", F.coalesce("backoff", F.lit(0.0)).alias("backoff")).toArrow()
    return Head(top.column("g").to_pylist(), top.column("gain").to_numpy(), top.column("backoff").to_numpy()), features.filter(F.col("occ") < threshold)


def score_stream(text: str, sizes: np.ndarray, order: int, head: Head, unknown: float, bitmap: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, list, list]:
    """(characters predicted, log-probability) of each piece, and (places, hashes) of what may be in the tail as n-gram
    of a predicted character and as its context. What a context that ends a piece would weigh isn't asked for."""
    n_chars = np.maximum(sizes - (order - 1), 0)
    chars = code_points(text)
    starts = np.cumsum(sizes) - sizes
    real = starts[sizes > 0]
    first, last = real + order - 2, real + sizes[sizes > 0] - 1
    predicted, context = np.ones(len(chars), dtype=bool), np.ones(len(chars), dtype=bool)
    for k in range(order - 1):
        predicted[real + k] = False
        if k < order - 2:
            context[real + k] = False
    context[last] = False
    gain, backoff = np.zeros(len(chars)), np.zeros(len(chars))
    keys = dict(ending_at(chars, order))
    open_at, gains, backoffs = np.flatnonzero(predicted | context), [], []
    for n in range(order, 0, -1):
        now = open_at if n < order else open_at[predicted[open_at]]
        own = keys[n][now - n + 1] if len(now) else np.zeros(0, np.uint64)
        found = head.find(own)
        hit = found >= 0
        gain[now[hit]], backoff[now[hit]] = head.gain[found[hit]], head.backoff[found[hit]]
        left, own = now[~hit], own[~hit]
        if bitmap is not None and len(left):
            may = contains(bitmap, own)
            asked, key = left[may], own[may]
            gains.append((asked[predicted[asked]], key[predicted[asked]]))
            if n < order:
                backoffs.append((asked[context[asked]], key[context[asked]]))
        open_at = left if n < order else np.concatenate([left, first])
    sums = np.concatenate([[0.0], np.cumsum(np.where(predicted, gain, 0.0) + np.where(context, backoff, 0.0))])
    return n_chars, sums[starts + sizes] - sums[starts] + unknown * n_chars, gains, backoffs


def _listed(found: list[tuple[np.ndarray, np.ndarray]], texts: int) -> pa.ListArray:
    """Of (texts, hashes) a list of hashes for each text."""
    at = np.concatenate([np.zeros(0, np.int64), *[x for x, _ in found]])
    keys = np.concatenate([np.zeros(0, np.uint64), *[x for _, x in found]])
    order = np.argsort(at, kind="stable")
    offsets = np.searchsorted(at[order], np.arange(texts + 1))
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(keys[order].view(np.int64)))


_HEADS: dict[str, tuple] = {}


def score(docs: DataFrame, features: DataFrame, unknown: float, *, order: int = 5, head: int = 1 << 20, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """A row per document: doc_id, lang, n_chars (characters predicted), logp (their log-probability)."""
    spark = docs.sparkSession
    ship(spark)
    top, tail = split_features(features, head)

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, _ = gram_keys(batch.column(0).to_pylist())
            yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(positions(keys).astype(np.int64)), batch.column(1), batch.column(2)], ["key", "p", "gain", "backoff"])

    keys = written(tail.select("g", "gain", "backoff").mapInArrow(hashed, "key long, p long, gain double, backoff double"), "tail")
    some = bool(keys.limit(1).count())
    bitmap = collect_bitmap(keys, "p", BITS) if some else None
    shared = spark.sparkContext.broadcast((top, bitmap))
    name = uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if name not in _HEADS:  # one model a worker at a time
            _HEADS.clear()
            _HEADS[name] = shared.value
        top, bitmap = _HEADS[name]
        for batch in tidy(batches):
            texts = batch.num_rows
            n_chars, logp, asked = np.zeros(texts, np.int64), np.zeros(texts), ([], [])
            for text, sizes, owners in streams((x.as_py() for x in batch.column(2)), order):
                n, p, *found = score_stream(text, sizes, order, top, unknown, bitmap)
                np.add.at(n_chars, owners, n)
                np.add.at(logp, owners, p)
                for kept, parts in zip(asked, found):
                    kept += [(owners[np.searchsorted(np.cumsum(sizes), at, "right")], keys) for at, keys in parts]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n_chars), pa.array(logp), *[_listed(x, texts) for x in asked]], ["doc_id", "lang", "n_chars", "logp", "gains", "backoffs"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"))
    rows = rows.mapInArrow(run, "doc_id long, lang string, n_chars long, logp double, gains array<long>, backoffs array<long>").withColumn("row", F.monotonically_increasing_id())
    rows = written(rows, "scores")
    if not some:
        return rows.drop("row", "gains", "backoffs")
    asked = rows.select("row", F.explode("gains").alias("key"), F.lit(1).alias("g"), F.lit(0).alias("b")).unionByName(rows.select("row", F.explode("backoffs").alias("key"), F.lit(0).alias("g"), F.lit(1).alias("b")))
    asked = asked.groupBy("row", "key").agg(F.sum("g").alias("g"), F.sum("b").alias("b"))
    more = asked.join(keys.drop("p"), "key").groupBy("row").agg(F.sum(F.col("g") * F.col("gain") + F.col("b") * F.coalesce("backoff", F.lit(0.0))).alias("more"))
    return rows.drop("gains", "backoffs").join(more, "row", "left").withColumn("logp", F.col("logp") + F.coalesce("more", F.lit(0.0))).drop("row", "more")


def trusted_texts(docs: DataFrame, trusted: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """text of the documents whose id is in trusted(doc_id). Only rows that a bitmap lets through are shuffled."""
    spark = docs.sparkSession
    shared_dir(spark)
    ship(spark)
    ids = trusted.select(F.col("doc_id").cast("long")).filter("doc_id IS NOT NULL").distinct()

    def where(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(positions(batch.column(0).to_numpy().view(np.uint64)).astype(np.int64))], ["p"])

    bitmap = spark.sparkContext.broadcast(collect_bitmap(ids.mapInArrow(where, "p long"), "p", BITS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in tidy(batches):
            yield batch.filter(pa.array(contains(bitmap.value, batch.column(0).to_numpy().view(np.uint64))))

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).filter("doc_id IS NOT NULL AND text IS NOT NULL")
    return rows.mapInArrow(run, "doc_id long, text string").join(ids, "doc_id", "left_semi").select("text")


def out_of_fold(docs: DataFrame, trusted: DataFrame, *, order: int, head: int, folds: int, id_col: str, text_col: str, lang_col: str) -> DataFrame:
    """The columns of `score`: each document by the model of the trusted(doc_id) of the other folds."""
    names = {"id_col": id_col, "text_col": text_col}
    fold = lambda c: F.pmod(F.xxhash64(F.col(c).cast("long")), F.lit(folds))
    if trusted.select(fold("doc_id")).distinct().count() < folds or folds < 2:
        features, unknown = fit(trusted_texts(docs, trusted, **names), order)
        return score(docs, features, unknown, order=order, head=head, lang_col=lang_col, **names)
    parts = []
    for k in range(folds):
        features, unknown = fit(trusted_texts(docs, trusted.filter(fold("doc_id") != k), **names), order)
        parts.append(score(docs.filter(fold(id_col) == k), features, unknown, order=order, head=head, lang_col=lang_col, **names))
    return reduce(DataFrame.unionByName, parts)


def classify(docs: DataFrame, trusted: DataFrame, *, order: int = 5, head: int = 1 << 20, quantile: float = 0.995, prior: float = 200.0, folds: int = 2, least: int = 200, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """A row per document: doc_id, lang, n_chars, perplexity (of a character), threshold (the highest accepted), kept.
    The module's text says what the limits are; least is the number of trusted documents from which on a language's own
    quantile decides alone."""
    ids = written(trusted.select(F.col("doc_id").cast("long")).filter("doc_id IS NOT NULL").distinct(), "trusted")
    scores = out_of_fold(docs, ids, order=order, head=head, folds=folds, id_col=id_col, text_col=text_col, lang_col=lang_col)
    rows = written(scores.withColumn("lang", F.coalesce("lang", F.lit(""))), "scores")
    known = written(rows.filter("n_chars > 0").join(ids, "doc_id", "left_semi").select("lang", "n_chars", "logp"), "judges")
    means = known.groupBy("lang").agg((-F.sum("logp") / F.sum("n_chars")).alias("mean"))
    overall = known.agg((-F.sum("logp") / F.sum("n_chars")).alias("mean")).first()["mean"]
    overall = float(overall) if overall is not None else 0.0
    small = means.limit(10_001).count() <= 10_000  # languages; otherwise an ordinary join
    hint = F.broadcast if small else (lambda x: x)

    def drawn(df: DataFrame) -> DataFrame:
        mean = F.coalesce(F.col("mean"), F.lit(overall))
        return df.join(hint(means), "lang", "left").withColumn("drawn", (-F.col("logp") + prior * mean) / (F.col("n_chars") + prior))

    at = lambda c: F.percentile_approx(c, quantile, 10_000)
    over = F.col("drawn") - F.col("mean")
    every, above = drawn(known).agg(at("drawn"), F.greatest(at(over), F.stddev(over) * NormalDist().inv_cdf(quantile))).first()
    levels = drawn(known).groupBy("lang").agg(at("drawn").alias("own"), F.first("mean").alias("m"), F.count("*").alias("n"))
    levels = levels.select("lang", F.when(F.col("n") >= least, F.col("own")).otherwise(F.greatest("own", F.col("m") + F.lit(above))).alias("limit"))
    limits = drawn(rows).join(hint(levels), "lang", "left").withColumn("limit", F.coalesce("limit", F.lit(every).cast("double")))
    kept = (F.col("n_chars") > 0) & F.coalesce(F.col("drawn") <= F.col("limit"), F.lit(False))
    return limits.select("doc_id", "lang", "n_chars", F.when(F.col("n_chars") > 0, F.exp(-F.col("logp") / F.col("n_chars"))).alias("perplexity"), F.exp("limit").alias("threshold"), kept.alias("kept"))
