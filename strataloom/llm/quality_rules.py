"""Quality rules: compression bands beside a few counts.

A text is compressed whole, and again in fixed chunks, with zstandard at a fixed level. Its ratio is compressed bytes
over bytes. Repetitive text compresses too well, random text too little; what is normal depends on length, as short
texts compress little. The bands below give the limits for each length; a document is rejected when its whole ratio
leaves the band of its length, or when more than a share of its chunks leave the bands of theirs. The last chunk is as
long as the text leaves it; a rest too short for a band of its own belongs to the chunk before.

Base counts: words are runs of anything but ASCII white space. A null text has no words. No shuffle; whole texts;
rows come out as many as went in, repeated ones too.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, LongType, StructField, StructType

from .common import hash_words, ship, text_bytes, tidy, windows

SYMBOLS = b"#*$%&|<>"
WHITE = b" \t\n\x0b\x0c\r"


@dataclass(frozen=True)
class Band:
    """For texts of at least `from_bytes` bytes: the lowest and highest accepted ratio."""

    from_bytes: int
    low: float
    high: float


#: From documents of known good quality (3,283 with 100 bytes or more, in four languages): at each length the 0.1 % quantile
#: of their ratios less 6 %, and the 99.9 % quantile plus 10 %. `measure_bands` makes such a table from other documents.
#: Below 100 bytes a ratio says little of the text; frames and headers weigh most.
WHOLE_BANDS = (
    Band(0, 0.0, 9.0), Band(100, 0.705, 1.194), Band(150, 0.619, 1.194), Band(200, 0.583, 0.905), Band(280, 0.563, 0.805),
    Band(400, 0.526, 0.770), Band(560, 0.491, 0.738), Band(800, 0.479, 0.690), Band(1_100, 0.460, 0.658), Band(1_600, 0.446, 0.608),
    Band(2_200, 0.437, 0.569), Band(3_200, 0.425, 0.548), Band(4_500, 0.411, 0.516), Band(6_400, 0.408, 0.502), Band(9_000, 0.395, 0.490),
    Band(16_000, 0.391, 0.490),
)
#: A chunk compresses as a text of its length does, but one part of a good text may be plainer or denser than the whole.
CHUNK_BANDS = tuple(Band(b.from_bytes, b.low * 0.97, b.high * 1.03) for b in WHOLE_BANDS)
#: A shorter rest joins the chunk before.
LEAST_REST = 1_000


def within(ratio: float, n_bytes: int, bands: Sequence[Band]) -> bool:
    band = max((b for b in bands if n_bytes >= b.from_bytes), key=lambda b: b.from_bytes)
    return band.low <= ratio <= band.high


def base_counts(data: bytes) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a text in UTF-8."""
    words = hash_words(data)
    n = len(words)
    dense = data.translate(None, WHITE)
    word_chars = len(dense) - int(np.count_nonzero((np.frombuffer(dense, np.uint8) & 0xC0) == 0x80)) if not dense.isascii() else len(dense)
    symbols = len(data) - len(data.translate(None, SYMBOLS))
    lines = [x for x in data.split(b"\n") if x.strip(WHITE)]
    dup_lines = len(lines) - len(set(lines))
    repeated = 0
    if n > 5:
        w = windows(words, 5)
        order = np.argsort(w)
        ranked = w[order]
        same = ranked[1:] == ranked[:-1]
        if same.any():
            twice = np.zeros(len(w), dtype=bool)
            twice[order[1:][same]] = True
            twice[order[:-1][same]] = True
            covered = np.zeros(n + 1, dtype=np.int32)
            at = np.flatnonzero(twice)
            np.add.at(covered, at, 1)
            np.add.at(covered, at + 5, -1)
            repeated = int(np.count_nonzero(np.cumsum(covered[:n])))
    return n, word_chars, symbols, dup_lines, repeated


def compression(data: bytes, packer: zstandard.ZstdCompressor, chunk: int) -> tuple[float, int, int]:
    """Ratio of the whole text, number of full chunks (1 for a shorter text), number of those outside their band. An
    empty text has ratio 0."""
    if not data:
        return 0.0, 0, 0
    whole = len(packer.compress(data)) / len(data)
    n = max(1, len(data) // chunk)
    bad = 0
    for i in range(n):
        part = data[i * chunk : (i + 1) * chunk]
        if i == n - 1 and len(data) - n * chunk < LEAST_REST:
            part = data[i * chunk :]
        bad += outside(part, packer)
    return whole, n, bad


def outside(part: bytes, packer: zstandard.ZstdCompressor) -> bool:
    return not within(len(packer.compress(part)) / len(part), len(part), CHUNK_BANDS)


def last_part(data: bytes, packer: zstandard.ZstdCompressor, chunk: int) -> tuple[int, int]:
    """1 and whether it leaves its band, for a rest behind the full chunks that is judged by itself; else 0 and 0."""
    rest = data[len(data) // chunk * chunk :] if len(data) > chunk else b""
    return (1, int(outside(rest, packer))) if len(rest) >= LEAST_REST else (0, 0)


RULES = StructType(
    [StructField(c, LongType()) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
    + [StructField("base_failed", BooleanType()), StructField("whole_ratio", DoubleType())]
    + [StructField(c, LongType()) for c in ("n_chunks", "n_bad_chunks")]
    + [StructField("kept", BooleanType())]
)


def rules(texts: pa.Array, level: int, chunk: int, bad_share: float) -> pa.StructArray:
    packer = zstandard.ZstdCompressor(level=level, write_checksum=False, write_content_size=False)
    rows = []
    for text in texts:
        data = text_bytes(text.as_py())
        counts = base_counts(data)
        failed = counts[0] < 10 or 100 * counts[4] > 20 * counts[0]
        ratio, chunks, bad = compression(data, packer, chunk)
        rest, bad_rest = last_part(data, packer, chunk)
        chunks, bad = chunks + rest, bad + bad_rest
        kept = not failed and within(ratio, len(data), WHOLE_BANDS) and bad <= bad_share * chunks
        rows.append((*counts, failed, ratio, chunks, bad, kept))
    return [pa.array(c, t) for c, t in zip(zip(*rows), [pa.int64()] * 5 + [pa.bool_(), pa.float64()] + [pa.int64()] * 2 + [pa.bool_()])] if rows else [pa.array([], t) for t in [pa.int64()] * 5 + [pa.bool_(), pa.float64()] + [pa.int64()] * 2 + [pa.bool_()]]


def score_rules(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", level: int = 1, chunk: int = 4096, bad_share: float = 0.25) -> DataFrame:
    """A row per document: doc_id, the counts, base_failed, the ratios, kept."""
    ship(docs.sparkSession)
    schema = StructType([StructField("doc_id", LongType()), *RULES.fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in tidy(batches):
            yield pa.RecordBatch.from_arrays([batch.column(0), *rules(batch.column(1), level, chunk, bad_share)], [f.name for f in schema])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, schema)


def keep_by_rules(docs: DataFrame, *, text_col: str = "text", level: int = 1, chunk: int = 4096, bad_share: float = 0.25) -> DataFrame:
    """The rows of docs that the rules keep, all columns as they were."""
    ship(docs.sparkSession)
    at = docs.columns.index(text_col)
    schema = StructType([*docs.schema.fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in tidy(batches):
            kept = rules(batch.column(at), level, chunk, bad_share)[-1]
            yield batch.filter(kept)

    return docs.mapInArrow(run, schema)


def measure_bands(docs: DataFrame, *, text_col: str = "text", level: int = 1, steps: Sequence[int] = tuple(b.from_bytes for b in WHOLE_BANDS[1:]), tail: float = 0.001, below: float = 0.94, above: float = 1.1) -> tuple[Band, ...]:
    """Bands from documents of known good quality: for each length in steps the quantiles `tail` and 1 - `tail` of their
    ratios, moved outwards. All documents count; a row a step reaches the driver. Steps without documents have no band
    of their own; texts shorter than the first step are all accepted."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = zstandard.ZstdCompressor(level=level, write_checksum=False, write_content_size=False)
        for batch in tidy(batches):
            texts = [text_bytes(x.as_py()) for x in batch.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array([len(x) for x in texts], pa.int64()), pa.array([len(packer.compress(x)) / max(1, len(x)) for x in texts], pa.float64())], ["size", "ratio"])

    ratios = docs.select(F.col(text_col).cast("string")).mapInArrow(run, "size long, ratio double")
    step = F.lit(0)
    for at in sorted(steps):
        step = F.when(F.col("size") >= at, at).otherwise(step)
    found = ratios.groupBy(step.alias("step")).agg(F.percentile_approx("ratio", F.array(F.lit(tail), F.lit(1 - tail)), 10_000).alias("q")).filter("step > 0").orderBy("step").collect()
    return (Band(0, 0.0, 9.0), *(Band(r["step"], r["q"][0] * below, r["q"][1] * above) for r in found))
