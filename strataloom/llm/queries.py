"""The corpus queries: each applies one operator with production parameters to its whole table."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat_format, exact_dedup, language_id, lexical_search, mixing, ngram_join, packing, quality_lm, quality_rules, secret_scan, token_counts, warc, whitening
from .common import new_folder


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary(name: str) -> str:
    """The folder of public vocabularies, from STRATALOOM_TOKENIZERS or the installed helper."""
    if folder := os.environ.get("STRATALOOM_TOKENIZERS"):
        return f"{folder}/{name}"
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.duplicate_groups(table(spark, sf_dir, "documents"))


OP1_SQL = """
WITH d AS (SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256 FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY text_sha256) AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size,
       row_number() OVER (PARTITION BY text_sha256 ORDER BY doc_id DESC) = 1 AS kept, text_sha256
FROM d
"""


def domain() -> Column:
    """Three domains, made from the number at the end of a source's name."""
    number = F.coalesce(F.regexp_extract("source", r"([0-9]+)$", 1).try_cast("int"), F.lit(0))
    return F.concat(F.lit("domain"), (number % 3).cast("string"))


MIX_WEIGHTS = {"domain": {"domain0": 5, "domain1": 3, "domain2": 2}, "lang": {"en": 4, "de": 2, "fr": 2, "es": 2}, "source": {"src0": 3}}


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    drawn = mixing.mix(table(spark, sf_dir, "documents"), domain=domain(), fraction=0.6, weights=MIX_WEIGHTS, max_epochs=2, seed=17)
    return drawn.select("doc_id", "mix.*")


OP2_SQL = r"""
WITH d AS (
  SELECT doc_id, 'domain' || (coalesce(try_cast(nullif(regexp_extract(source, '([0-9]+)$', 1), '') AS INT), 0) % 3)::VARCHAR AS domain, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS tokens
  FROM documents),
leaf AS (SELECT domain, lang, source, sum(tokens)::BIGINT AS tokens FROM d GROUP BY ALL),
n1 AS (SELECT domain, 2 * sum(tokens)::BIGINT AS cap, CASE domain WHEN 'domain0' THEN 5 WHEN 'domain1' THEN 3 WHEN 'domain2' THEN 2 ELSE 1 END AS w, (SELECT floor(0.6::DOUBLE * sum(tokens))::BIGINT FROM leaf) AS b FROM leaf GROUP BY domain),
l1 AS (SELECT *, (b - coalesce(sum(cap) OVER p, 0)) / (sum(w) OVER () - coalesce(sum(w) OVER p, 0)) AS lam FROM n1 WINDOW p AS (ORDER BY cap / w, domain ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
m1 AS (SELECT *, max(CASE WHEN lam <= cap / w THEN lam END) OVER () AS lev FROM l1),
b1 AS (SELECT domain, CASE WHEN lam > cap / w THEN cap ELSE least(cap, floor(greatest(lev, 0) * w))::BIGINT END AS b FROM m1),
n2 AS (SELECT l.domain, l.lang, l.cap, l.w, b1.b FROM (SELECT domain, lang, 2 * sum(tokens)::BIGINT AS cap, CASE lang WHEN 'en' THEN 4 WHEN 'de' THEN 2 WHEN 'fr' THEN 2 WHEN 'es' THEN 2 ELSE 1 END AS w FROM leaf GROUP BY ALL) l JOIN b1 USING (domain)),
l2 AS (SELECT *, (b - coalesce(sum(cap) OVER p, 0)) / (sum(w) OVER (PARTITION BY domain) - coalesce(sum(w) OVER p, 0)) AS lam FROM n2 WINDOW p AS (PARTITION BY domain ORDER BY cap / w, lang ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
m2 AS (SELECT *, max(CASE WHEN lam <= cap / w THEN lam END) OVER (PARTITION BY domain) AS lev FROM l2),
b2 AS (SELECT domain, lang, CASE WHEN lam > cap / w THEN cap ELSE least(cap, floor(greatest(lev, 0) * w))::BIGINT END AS b FROM m2),
n3 AS (SELECT l.*, b2.b FROM (SELECT domain, lang, source, tokens, 2 * tokens AS cap, CASE source WHEN 'src0' THEN 3 ELSE 1 END AS w FROM leaf) l JOIN b2 USING (domain, lang)),
l3 AS (SELECT *, (b - coalesce(sum(cap) OVER p, 0)) / (sum(w) OVER (PARTITION BY domain, lang) - coalesce(sum(w) OVER p, 0)) AS lam FROM n3 WINDOW p AS (PARTITION BY domain, lang ORDER BY cap / w, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
m3 AS (SELECT *, max(CASE WHEN lam <= cap / w THEN lam END) OVER (PARTITION BY domain, lang) AS lev FROM l3),
b3 AS (SELECT domain, lang, source, tokens AS t, CASE WHEN lam > cap / w THEN cap ELSE least(cap, floor(greatest(lev, 0) * w))::BIGINT END AS b FROM m3),
plan AS (SELECT domain, lang, source, b, CASE WHEN t > 0 THEN b // t ELSE 0 END AS e, CASE WHEN t > 0 THEN b - (b // t) * t ELSE b END AS rest FROM b3),
per AS (SELECT d.*, plan.b AS leaf_budget, plan.e, plan.rest, unnest(range(1, plan.e + 2)) AS epoch FROM d JOIN plan USING (domain, lang, source)),
keyed AS (SELECT *, md5('17|' || epoch::VARCHAR || '|' || coalesce(doc_id::VARCHAR, '')) AS order_key FROM per),
summed AS (SELECT *, sum(tokens) OVER (PARTITION BY domain, lang, source, epoch ORDER BY order_key, doc_id, tokens ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto FROM keyed)
SELECT doc_id, domain, lang, source, tokens, epoch, order_key, leaf_budget FROM summed WHERE epoch <= e OR (rest > 0 AND upto <= rest)
"""


def op3_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.similar_groups(table(spark, sf_dir, "documents"), n=4, percent=85)


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "bucket")


def op5_quality_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    trusted = table(spark, sf_dir, "labels").filter("quality = 1").select("doc_id")
    return quality_lm.classify(table(spark, sf_dir, "documents"), trusted)


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.score_rules(table(spark, sf_dir, "documents"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held = language_id.held_out()
    model = language_id.train(docs.filter(~held))
    out = language_id.predict(spark, docs, model)
    return out.select("doc_id", held.alias("held_out"), "lang_pred", "score")


def op8_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    more = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    return chat_format.turn_digests(chat_format.format_conversations(turns.unionByName(more)))


OP8_SQL = r"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL SELECT -7, i, CASE i WHEN 0 THEN 'user' ELSE 'assistant' END, '</s>[INST] ok [/INST]' FROM range(2) r(i)),
s AS (SELECT *, regexp_replace(role, '<([|~])', '<~\1', 'g') AS erole, regexp_replace(text, '<([|~])', '<~\1', 'g') AS etext,
             coalesce(lag(role) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) <> role, true) AS starts FROM t)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' ORDER BY turn NULLS FIRST, role, text), '')) AS loss_sha256,
       sum(length(etext) + CASE WHEN starts THEN length('<|turn|>') + length(erole) + length('<|text|>') + length('<|end|>') ELSE length('<|next|>') END)::BIGINT AS formatted_chars
FROM s GROUP BY conv_id
"""


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_folder(spark, "warc")
    warc.write_archives(table(spark, sf_dir, "pages"), path)
    return warc.read_archives(spark, path, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP9_SQL = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
w AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS best FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN payload_bytes >= 1000 AND page_id <> best THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 1000 AND page_id <> best THEN best END AS refers_to
FROM w
"""


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = token_counts.prefix_token_counts(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))
    return counts.select("doc_id", "n_bytes", "n_tokens", token_counts.over_limit(F.col("n_tokens")).alias("over_limit"), "chars_in_budget")


def op11_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.find_secrets(table(spark, sf_dir, "documents"))
    spans, kinds = F.col("spans"), [r.kind for r in secret_scan.BASE]
    counts = [F.size(secret_scan.of_kinds(spans, [kind])).cast("long").alias(f"n_{kind}") for kind in kinds]
    base = F.sha2(secret_scan.joined(secret_scan.of_kinds(spans, kinds)), 256)
    return found.select("doc_id", *counts, base.alias("base_sha256"), secret_scan.joined(spans).alias("spans"))


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search.rank(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), k=20)


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whitened_components(table(spark, sf_dir, "embeddings"), components=4)


QUERIES = {f.__name__: f for f in (op1_exact_dedup, op2_mixing, op3_ngram_join, op4_packing, op5_quality_lm, op6_quality_rules, op7_language_id, op8_chat_format, op9_warc, op10_token_counts, op11_secret_scan, op12_lexical_search, op13_whitening)}
ORACLES = {"op1_exact_dedup": OP1_SQL, "op2_mixing": OP2_SQL, "op8_chat_format": OP8_SQL, "op9_warc": OP9_SQL}
