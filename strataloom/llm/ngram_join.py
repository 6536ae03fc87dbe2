"""N-gram Jaccard self-join and its components, by a prefix filter and parities of token classes.

A document's tokens are its distinct word n-grams, as 64-bit hashes (texts with fewer words count as one token, the
whole sequence; without words the set is empty and links with nothing). Sets that are equal are one node. Two sets of
Jaccard similarity t or more have, under ANY total order of tokens, a common token among the first
n - ceil(t n) + 1 of each. The order puts tokens that are frequent in the corpus last, by the logarithm of their
frequency; among their like a hash decides.

1. One pass summarises frequent tokens (a bounded number of counters a task, merged by a sum; only the order depends
   on it, never the result).
2. A second pass writes a narrow table: document, set id, set size, the parity of the set's tokens in each of 2,048
   classes, and in each of 512 wider ones, and the prefix. What later steps need of it is kept, the rest deleted as
   soon as the buckets are made.
3. Prefix tokens are shuffled once. In each token's bucket, entries whose size is too far from all others' go first; of
   the rest the entry that stands nearest to its document's front is the hub; pairs of the hub and another are
   candidates, linear in the bucket. Hubs of tokens that are frequent by step 1 are found by a minimum that combines
   before the shuffle, and are broadcast. Size and position filters come first; then as many parities as differ must not
   exceed what the sets of a similar pair may differ by (each differing token turns one parity at most, so that no
   similar pair is lost), then the sets are compared.
4. Verified pairs give components. What a bucket holds outside its hub's component is then compared with all others in
   that bucket that it isn't connected with yet, the wide parities first; this makes the search complete, and pairs
   within a component, the bulk of large groups of copies, are never made.

5. Links are counted afterwards, as they lie within components: each component is dealt into blocks of bounded size,
   every two of its blocks meet in a task of their own, and all their sets are compared; only sums leave the task.

Sets for verification are made again from whole texts, only for documents and sets that bitmaps of fixed size let
through; they are shuffled where they are compared.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .bitmap import BITS, collect_bitmap, contains, positions
from .common import discard, free_name, hash_words, mix, ship, shared_dir, text_bytes, tidy, windows, written
from .components import connected

PERCENT = 85
#: Classes of tokens whose parities are kept for each set, and wider ones; powers of two.
PARITIES, WIDE = 2048, 512
#: A token that more than one document in so many has is frequent enough for a hub of its own.
HOT_SHARE = 1000
#: Sets and tokens of a block, in the mean.
BLOCK_SETS, BLOCK_TOKENS = 1024, 400_000


def shingles(text: str | None, n: int) -> np.ndarray:
    """The distinct token hashes of a text, sorted."""
    words = hash_words(text_bytes(text).lower())
    return np.unique(windows(words, min(n, len(words)))) if len(words) else words


def set_id(tokens: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(tokens.tobytes(), seed=len(tokens)) - (1 << 63)


def prefix_length(n: int, percent: int) -> int:
    return n - -(-percent * n // 100) + 1 if n else 0


def frequent_tokens(docs: DataFrame, n: int, *, counters: int = 1 << 17, least: int = 16) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hashes, levels, counts) of at most `counters` tokens that many documents have, hashes sorted."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, sums = np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
        held: list[np.ndarray] = []
        size = 0

        def merged() -> tuple[np.ndarray, np.ndarray]:
            new, n_new = np.unique(np.concatenate(held), return_counts=True)
            every, at = np.unique(np.concatenate([keys, new]), return_inverse=True)
            total = np.zeros(len(every), dtype=np.int64)
            np.add.at(total, at, np.concatenate([sums, n_new]))
            if len(every) > counters:  # as Misra-Gries: all give up what the first to go has
                floor = np.partition(total, len(total) - counters)[len(total) - counters - 1]
                every, total = every[total > floor], total[total > floor] - floor
            return every, total

        for batch in tidy(batches):
            for text in batch.column(0):
                tokens = shingles(text.as_py(), n)
                held.append(tokens)
                size += len(tokens)
                if size > 1_500_000:
                    keys, sums = merged()
                    held, size = [], 0
        if held:
            keys, sums = merged()
        some = sums >= 2
        yield pa.RecordBatch.from_arrays([pa.array(keys[some].view(np.int64)), pa.array(sums[some])], ["token", "n"])

    rows = docs.select("text").mapInArrow(count, "token long, n long")
    top = rows.groupBy("token").agg(F.sum("n").alias("n")).filter(F.col("n") >= least).orderBy(F.desc("n"), "token").limit(counters).toArrow()
    keys, counts = top.column("token").to_numpy().view(np.uint64), top.column("n").to_numpy()
    levels = np.floor(np.log2(np.maximum(counts, 1))).astype(np.uint8)
    order = np.argsort(keys)
    return keys[order], levels[order], counts[order]


def level_bits(tokens: np.ndarray, keys: np.ndarray, levels: np.ndarray) -> np.ndarray:
    """The levels of tokens in the upper six bits; 0 for tokens that aren't frequent."""
    if not len(keys):
        return np.zeros(len(tokens), dtype=np.uint64)
    at = np.minimum(np.searchsorted(keys, tokens), len(keys) - 1)
    return np.where(keys[at] == tokens, levels[at], 0).astype(np.uint64) << np.uint64(58)


def first_tokens(tokens: np.ndarray, level: np.ndarray, seed: int, k: int) -> np.ndarray:
    """The first k of sorted tokens in the order of a seed: by level, then by hash, then by value."""
    return tokens[np.argsort(level | (mix(tokens, seed) >> np.uint64(6)), kind="stable")[:k]]


def ordered(tokens: np.ndarray, keys: np.ndarray, levels: np.ndarray, seed: int, k: int) -> np.ndarray:
    """The first k tokens in the order of a seed: rare ones first, by hash among their like."""
    return first_tokens(tokens, level_bits(tokens, keys, levels), seed, k)


def parities(tokens: np.ndarray, classes: int) -> np.ndarray:
    """Whether the number of tokens is odd in each class, as longs of 64 bits."""
    odd = np.bincount((tokens >> np.uint64(65 - classes.bit_length())).astype(np.int64), minlength=classes) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)


def features(docs: DataFrame, n: int, percent: int, keys: np.ndarray, levels: np.ndarray) -> DataFrame:
    """doc_id, sid, n, bits, wide, prefix: the last three are null where the task has given them for an equal set."""
    shared = docs.sparkSession.sparkContext.broadcast((keys, levels))
    schema = "doc_id long, sid long, n int, bits array<long>, wide array<long>, prefix array<long>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, levels = shared.value
        seen: set[int] = set()
        for batch in tidy(batches):
            sids, sizes, bits, wide, prefixes = [], [], [], [], []
            for text in batch.column(1):
                tokens = shingles(text.as_py(), n)
                sid = set_id(tokens)
                sids.append(sid)
                sizes.append(len(tokens))
                if sid in seen or not len(tokens):
                    for column in (bits, wide, prefixes):
                        column.append(None)
                    continue
                if len(seen) >= 200_000:
                    seen.clear()
                seen.add(sid)
                k = prefix_length(len(tokens), percent)
                level = level_bits(tokens, keys, levels)
                bits.append(parities(tokens, PARITIES))
                wide.append(parities(tokens, WIDE))
                prefixes.append(first_tokens(tokens, level, 0, k).view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sids, pa.int64()), pa.array(sizes, pa.int32()), pa.array(bits, pa.list_(pa.int64())), pa.array(wide, pa.list_(pa.int64())), pa.array(prefixes, pa.list_(pa.int64()))], ["doc_id", "sid", "n", "bits", "wide", "prefix"])

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def _may_reach(na: Column, ia: Column, nb: Column, ib: Column, percent: int) -> Column:
    """Whether what follows a first common token, at ia and ib, can still hold enough common tokens."""
    return (100 + percent) * F.least(na - ia, nb - ib) >= percent * (na + nb)


def _may_agree(na: Column, bits_a: Column, nb: Column, bits_b: Column, percent: int) -> Column:
    """Whether parities differ in no more classes than tokens may differ."""
    differ = F.aggregate(F.zip_with(bits_a, bits_b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda x, y: x + y)
    return (100 + percent) * differ <= (100 - percent) * (na + nb)


def _near(pairs: DataFrame, sketches: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose parities are near."""
    side = lambda x: sketches.select(F.col("sid").alias(x), F.col("n").alias(f"n{x}"), F.col("bits").alias(f"bits{x}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    return both.filter(_may_agree(F.col("na"), F.col("bitsa"), F.col("nb"), F.col("bitsb"), percent)).select("a", "b")


def _sets(docs: DataFrame, wanted: DataFrame, n: int) -> DataFrame:
    """sid, tokens of the wanted sets (sid, doc_id): one pass over the texts, without a shuffle. A set may come from several
    tasks, and a few that aren't wanted may come along."""
    spark = docs.sparkSession

    def bitmap(column: str):
        def where(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                at = positions(batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64))
                yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int64))], ["p"])

        return spark.sparkContext.broadcast(collect_bitmap(wanted.select(column).filter(F.col(column).isNotNull()).mapInArrow(where, "p long"), "p", BITS))

    ids, sids = bitmap("doc_id"), bitmap("sid")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        given: set[int] = set()
        for batch in tidy(batches):
            own = batch.column(0).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            maybe = contains(ids.value, own.view(np.uint64), BITS) | batch.column(0).is_null().to_numpy(zero_copy_only=False)
            found, sets = [], []
            for i in np.flatnonzero(maybe):
                tokens = shingles(batch.column(1)[int(i)].as_py(), n)
                sid = set_id(tokens)
                if sid not in given and contains(sids.value, np.array([sid], dtype=np.int64).view(np.uint64), BITS)[0]:
                    if len(given) >= 200_000:
                        given.clear()
                    given.add(sid)
                    found.append(sid)
                    sets.append(tokens.view(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64()), pa.array(sets, pa.list_(pa.int64()))], ["sid", "tokens"])

    return docs.select("doc_id", "text").mapInArrow(run, "sid long, tokens array<long>")


def _verified(pairs: DataFrame, docs: DataFrame, reps: DataFrame, n: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """Of the pairs, those whose sets are similar enough; and the sets of all pairs, some of them
    more than once. Both are written."""
    pairs = written(pairs, "pairs", few=True)
    wanted = written(pairs.select(F.explode(F.array("a", "b")).alias("sid")).distinct().join(reps, "sid"), "wanted", few=True)
    sets = written(_sets(docs, wanted, n), "sets")
    once = sets.dropDuplicates(["sid"])
    both = pairs.join(once.select(F.col("sid").alias("a"), F.col("tokens").alias("ta")), "a").join(once.select(F.col("sid").alias("b"), F.col("tokens").alias("tb")), "b")
    common = F.size(F.array_intersect("ta", "tb"))
    links = written(both.filter((100 + percent) * common >= percent * (F.size("ta") + F.size("tb"))).select("a", "b"), "links", few=True)
    discard(pairs, wanted)
    return links, sets


def linked(left: list[np.ndarray], right: list[np.ndarray], percent: int) -> np.ndarray:
    """Which sets of left are similar enough to which of right, as a matrix."""
    sizes = np.array([len(x) for x in right])
    tokens, owner = np.concatenate(right), np.repeat(np.arange(len(right)), sizes)
    order = np.argsort(tokens, kind="stable")
    tokens, owner = tokens[order], owner[order]
    out = np.zeros((len(left), len(right)), dtype=bool)
    for i, own in enumerate(left):
        first = np.searchsorted(tokens, own, "left")
        hits = np.searchsorted(tokens, own, "right") - first
        at = np.repeat(first - np.cumsum(hits) + hits, hits) + np.arange(hits.sum())
        common = np.bincount(owner[at], minlength=len(right))
        out[i] = (100 + percent) * common >= percent * (len(own) + sizes)
    return out


def _degrees(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """members(sid, root, n, copies) of components of three sets or more, sets(sid, tokens) -> (sid, others): documents
    of other sets that a set links with. Small components share groups, which changes no count: sets of different
    components are never similar."""
    total = members.agg(F.sum("n")).first()[0] or 0
    shared = max(1, total // BLOCK_TOKENS)
    blocks = F.ceil(F.greatest(F.col("m") / BLOCK_SETS, F.col("m_tokens") / BLOCK_TOKENS))
    rows = members.withColumn("k", blocks).withColumn("own", F.pmod(F.xxhash64("sid", F.lit(7)), F.col("k")))
    rows = rows.withColumn("g", F.when(F.col("k") == 1, F.pmod(F.xxhash64("root"), F.lit(shared))).otherwise(F.col("root")))
    rows = rows.withColumn("meets", F.explode(F.sequence(F.lit(0).cast("long"), F.col("k") - 1)))
    rows = rows.select("sid", "copies", "g", (F.col("k") == 1).alias("small"), "own", F.least("own", "meets").alias("i"), F.greatest("own", "meets").alias("j"))

    def count(table: pa.Table) -> pa.Table:
        sids, copies, own, i, j = (table.column(c).to_numpy() for c in ("sid", "copies", "own", "i", "j"))
        tokens = [x.values.to_numpy() for x in table.column("tokens")]
        sums = np.zeros(len(sids), dtype=np.int64)
        a, b = np.flatnonzero(own == i), np.flatnonzero(own == j)
        if len(a) and len(b):
            matrix = linked([tokens[x] for x in a], [tokens[x] for x in b], percent)
            if i[0] == j[0]:
                np.fill_diagonal(matrix, False)
                sums[a] = matrix @ copies[a]
            else:
                sums[a] = matrix @ copies[b]
                sums[b] = copies[a] @ matrix
        return pa.table({"sid": pa.array(sids), "others": pa.array(sums)})

    return rows.join(sets, "sid").groupBy("g", "small", "i", "j").applyInArrow(count, "sid long, others long").groupBy("sid").agg(F.sum("others").alias("others"))


def _followers(entries: DataFrame, hot: np.ndarray, percent: int) -> DataFrame:
    """entries(token, place, sid) -> token, place, sid, hub (place, sid): for each entry but the first of its bucket the
    first one. The same set may come from several tasks and counts once. Entries that are too small or too large for all
    others of their bucket go before. The buckets of hot tokens, a bounded number, aren't brought together."""
    front = Window.partitionBy("token").orderBy("place", "sid")
    cold = entries
    if len(hot):
        few = F.broadcast(entries.sparkSession.createDataFrame(pa.table({"token": hot.view(np.int64)})))
        cold = entries.join(few, "token", "left_anti")
        warm = entries.join(few, "token", "left_semi")
        hubs = warm.groupBy("token").agg(F.min(F.struct("place", "sid")).alias("hub"))
        warm = warm.dropDuplicates(["token", "sid"]).join(F.broadcast(hubs), "token").select("token", "place", "sid", "hub")
    hub = F.first(F.struct("place", "sid")).over(front.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    # If any entry is near enough in size, the next smaller or the next larger one is.
    n, sizes = F.col("place").bitwiseAND(F.lit((1 << 32) - 1)), Window.partitionBy("token").orderBy("n", "sid")
    cold = cold.withColumn("n", n).withColumns({"smaller": F.lag("n").over(sizes), "larger": F.lead("n").over(sizes)})
    cold = cold.filter((100 * F.col("smaller") >= percent * F.col("n")) | (100 * F.col("n") >= percent * F.col("larger"))).select("token", "place", "sid")
    # Equal sets of a token have equal places, so that they stand side by side.
    cold = cold.withColumns({"before": F.lag("sid").over(front), "hub": hub}).filter("before <> sid").drop("before")
    return (cold.unionByName(warm) if len(hot) else cold).filter("hub.sid <> sid")


def _places(df: DataFrame) -> DataFrame:
    """n and i, hub_n and hub_i, hub_sid out of the packed columns."""
    whole, part = lambda c: (F.col(c).bitwiseAND(F.lit((1 << 32) - 1))).cast("int"), lambda c: F.shiftright(c, 32).cast("int")
    return df.select("token", "sid", whole("place").alias("n"), part("place").alias("i"), F.col("hub.sid").alias("hub_sid"), whole("hub.place").alias("hub_n"), part("hub.place").alias("hub_i"))


def similar_groups(docs: DataFrame, *, n: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", counters: int = 1 << 17, count_links: bool = True) -> DataFrame:
    """A row per document: doc_id, n_shingles, component_id (the smallest id reachable; nulls are ignored unless a
    component has nothing else) and, unless they needn't be counted, n_links (all other documents that are similar
    enough to it, those with an equal set among them)."""
    spark = docs.sparkSession
    shared_dir(spark)
    ship(spark)
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    keys, levels, counts = frequent_tokens(docs, n, counters=counters)
    table = written(features(docs, n, percent, keys, levels), "features")
    narrow = written(table.select("doc_id", "sid", "n"), "narrow", few=True)
    reps = narrow.filter("n > 0").groupBy("sid").agg(F.min("doc_id").alias("doc_id"))
    entries = table.filter("prefix IS NOT NULL").select("sid", "n", F.posexplode("prefix").alias("i", "token"))
    entries = entries.select("token", F.shiftleft(F.col("i").cast("long"), 32).bitwiseOR(F.col("n")).alias("place"), "sid")
    packed = written(_followers(entries, keys[counts * HOT_SHARE > narrow.count()], percent), "buckets")
    buckets = _places(packed)
    star = buckets.filter(_may_reach(F.col("n"), F.col("i"), F.col("hub_n"), F.col("hub_i"), percent))
    pairs = written(star.select(F.least("sid", "hub_sid").alias("a"), F.greatest("sid", "hub_sid").alias("b")).distinct(), "pairs")
    sketches = table.filter("prefix IS NOT NULL").join(buckets.select(F.explode(F.array("sid", "hub_sid")).alias("sid")).distinct(), "sid", "left_semi")
    sketches = written(sketches.select("sid", "n", "bits", "wide").dropDuplicates(["sid"]), "sketches")
    discard(table)
    links, link_sets = _verified(_near(pairs, sketches, percent), docs, reps, n, percent)
    roots = connected(links)
    # What isn't in the component of a bucket's hub against all others in the bucket that it isn't connected with.
    known = buckets.join(roots.select(F.col("node").alias("sid"), "root"), "sid", "left").withColumn("root", F.coalesce("root", "sid"))
    known = known.join(roots.select(F.col("node").alias("hub_sid"), F.col("root").alias("hub_root")), "hub_sid", "left").withColumn("hub_root", F.coalesce("hub_root", "hub_sid"))
    known = written(known.select("token", "sid", "n", "i", "root", "hub_root"), "known")
    mixed = known.groupBy("token").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.max(F.col("root") != F.col("hub_root")).alias("apart")).filter("low <> high AND apart").select("token")
    rest = written(known.join(mixed, "token", "left_semi").join(sketches.select("sid", "wide"), "sid"), "known")
    other = rest.filter("root <> hub_root").select(*[F.col(c).alias(f"o_{c}") for c in ("token", "sid", "n", "i", "root", "wide")])
    reach = _may_reach(F.col("n"), F.col("i"), F.col("o_n"), F.col("o_i"), percent) & _may_agree(F.col("n"), F.col("wide"), F.col("o_n"), F.col("o_wide"), percent)
    both = rest.join(other, (F.col("token") == F.col("o_token")) & (F.col("root") != F.col("o_root")) & ((F.col("root") == F.col("hub_root")) | (F.col("sid") < F.col("o_sid"))) & reach)
    more = both.select(F.least("sid", "o_sid").alias("a"), F.greatest("sid", "o_sid").alias("b")).distinct().join(pairs, ["a", "b"], "left_anti")
    more_links, more_sets = _verified(_near(more, sketches, percent), docs, reps, n, percent)
    discard(packed, pairs, known, rest, sketches)
    if more_links.limit(1).count():
        roots = connected(links.unionByName(more_links))
    label = roots.select(F.col("node").alias("sid"), "root")
    sets = narrow.filter("n > 0").groupBy("sid").agg(F.min("doc_id").alias("least"), F.count("*").alias("copies"), F.first("n").alias("n")).join(label, "sid", "left").withColumn("root", F.coalesce("root", "sid"))
    least = sets.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("m"), F.sum("n").alias("m_tokens"), F.sum("copies").alias("m_copies"))
    sets = written(sets.join(least, "root"), "labels", few=True)
    given = ["component_id"]
    if count_links:
        # In a component of one or two sets all documents are linked.
        tokens = link_sets.unionByName(more_sets).dropDuplicates(["sid"])
        others = _degrees(sets.filter("m > 2").select("sid", "root", "n", "copies", "m", "m_tokens"), tokens, percent)
        n_links = F.when(F.col("m") > 2, F.col("others") + F.col("copies")).otherwise(F.col("m_copies")) - 1
        counted, sets = sets, written(sets.join(others, "sid", "left").withColumn("n_links", n_links), "labels", few=True)
        discard(counted)
        given.append("n_links")
    discard(link_sets, more_sets)
    sets = sets.select("sid", "copies", *given)
    # Equal sets may be a third of all documents: the frequent ones, at most 1,000 by their share, are broadcast.
    hot = F.col("copies") * 1000 > narrow.count()
    full = narrow.filter("n > 0")
    settled = full.join(F.broadcast(sets.filter(hot).drop("copies")), "sid")
    ordinary = full.join(F.broadcast(sets.filter(hot).select("sid")), "sid", "left_anti").join(sets.filter(~hot).drop("copies"), "sid")
    empty = narrow.filter("n = 0").withColumns({"component_id": F.col("doc_id"), "n_links": F.lit(0).cast("long")}).select("sid", "doc_id", "n", *given)
    return settled.unionByName(ordinary).unionByName(empty).select("doc_id", F.col("n").cast("long").alias("n_shingles"), *given)


def keep_one(docs: DataFrame, *, n: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs whose id is their group's smallest, all columns as they were. Texts without words stay; of
    rows that repeat an id all stay or go together."""
    groups = similar_groups(docs, n=n, percent=percent, id_col=id_col, text_col=text_col, count_links=False)
    (drop,) = free_name(docs, "dropped_id")
    dropped = groups.filter("doc_id <> component_id").select(F.col("doc_id").alias(drop)).distinct()
    return docs.join(dropped, docs[id_col].cast("long") == F.col(drop), "left_anti")
