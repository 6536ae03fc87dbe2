"""A corpus pipeline: quality rules, exact dedup, n-gram Jaccard join, mixing to target weights, packing.

Each stage takes (spark, docs, sf_dir), works on everything that its predecessor kept, and returns the columns of
documents as they were; the last one returns the packed pieces. Between stages the rows are written as Parquet in the
shared folder and read again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from strataloom.llm import exact_dedup, mixing, ngram_join, packing, quality_rules
from strataloom.llm.common import discard, written
from strataloom.llm.queries import domain, table, vocabulary

#: Targets of the mix: weights of siblings in the tree of domain, language and source; 1 where none is given.
WEIGHTS = {"domain": {"domain0": 4, "domain1": 3, "domain2": 3}, "lang": {"en": 6, "de": 2, "fr": 2, "es": 1}, "source": {"src0": 7}}
#: Of the tokens that reach the mix, the share that the budget is.
BUDGET = 0.9


def filter_by_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    return quality_rules.keep_by_rules(docs)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the one with the largest id stays."""
    return exact_dedup.exact_dedup(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that are connected by a similarity of 0.8 or more on shingles of five words, one stays."""
    return ngram_join.keep_one(docs, n=5, percent=80)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each leaf's share of the budget, no document twice."""
    drawn = mixing.mix(docs, domain=domain(), fraction=BUDGET, weights=WEIGHTS, max_epochs=1, seed=17)
    return drawn.select(*docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces whose lengths are powers of two, with their token ids. Fewer words are remembered than by default, as the
    workers of earlier stages live on."""
    return packing.pack(docs, vocabulary("word_bpe_49k.json"), words=150_000)


STAGES = [
    ("quality_rules", filter_by_rules),
    ("exact_dedup", drop_exact_copies),
    ("ngram_join", drop_near_copies),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: Compression ratios and token ids have no SQL form; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES[:-1]):
        before, docs = docs, written(stage(spark, docs, sf_dir), name)
        if i:
            discard(before)
    return STAGES[-1][1](spark, docs, sf_dir)
