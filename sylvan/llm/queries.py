"""Registered queries of the subpackage: each applies an operator with its production settings to its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, decontaminate, html_text, licenses, merkle, oracles, pii, quality, secrets_scan, simhash, token_counts, token_store, url_filter, whitening
from .common import pick, read

QUERIES: dict = {}
ORACLE: dict = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return add


@query("op1_quality_rules", oracles.quality_rules())
def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = pick(read(spark, sf_dir, "documents"), "doc_id", "text", "lang")
    out = quality.judged(docs, read(spark, sf_dir, "labels"))
    return out.select("doc.doc_id", *[f"q.{c}" for c in (*quality.BASE, "base_failed", "kept", "rejected_by")])


@query("op2_decontamination", oracles.decontamination())
def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = pick(read(spark, sf_dir, "documents"), "doc_id", "text")
    found = decontaminate.hits(docs, pick(read(spark, sf_dir, "benchmark"), "item_id", "text"))
    n_hit = decontaminate.covered(F.col("spans"))
    return found.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


@query("op3_byte_bpe")
def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = pick(read(spark, sf_dir, "documents"), "doc_id", "text")
    return bpe.digests(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


@query("op4_token_shards")
def op4_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = pick(read(spark, sf_dir, "documents"), "doc_id", "text")
    folder = token_store.new_folder(spark)
    manifest = token_store.written_shards(docs, folder, public_tokenizers.path("word_bpe_49k.json"))
    return token_store.read_documents(manifest, folder)


@query("op5_simhash")
def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.grouped(pick(read(spark, sf_dir, "documents"), "doc_id", "text"))


@query("op7_personal_data")
def op7_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = pick(read(spark, sf_dir, "documents"), "doc_id", "text")
    found = pii.found(docs, pii.fitted(docs))
    return found.select("doc_id", *[f"pii.{c}" for c in ("n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_added")])


@query("op8_html_text")
def op8_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extracted(pick(read(spark, sf_dir, "pages"), "page_id", "url", "html"))


@query("op9_url_filter", oracles.url_filter())
def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judged(pick(read(spark, sf_dir, "pages"), "page_id", "url")).drop("url_score")


@query("op10_license_scan", oracles.licenses())
def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scanned(pick(read(spark, sf_dir, "documents"), "doc_id", "text"))


@query("op6_token_counts")
def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = pick(read(spark, sf_dir, "documents"), "doc_id", "text")
    return token_counts.counted(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


@query("op11_secret_scan", oracles.secret_scan())
def op11_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets_scan.scanned(pick(read(spark, sf_dir, "documents"), "doc_id", "text"))
    of = lambda *kinds: F.filter("secrets", lambda s: s["kind"].isin(*kinds))
    base = [p[0] for p in secrets_scan.PATTERNS]
    return found.select(
        "doc_id", *[F.size(of(k)).cast("long").alias(f"n_{k}") for k in base], F.sha2(secrets_scan.joined(of(*base)), 256).alias("base_sha256"),
        secrets_scan.joined(F.col("secrets")).alias("spans"), (F.size("secrets") - F.size(of(*base))).cast("long").alias("n_entropy"))


@query("op13_merkle_manifest", oracles.merkle_manifest())
def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = merkle.build(pick(read(spark, sf_dir, "documents"), *merkle.FIELDS), tampered=merkle.lowered_sample())
    root = F.lit(m.root).cast("string")
    folded = merkle.folded(F.coalesce("other", "leaf"), F.col("way"))
    out = merkle.proofs(m).select(F.col("key").alias("doc_id"), "leaf", "subroot", root.alias("root"), F.sha2(merkle.siblings(F.col("way")), 256).alias("proof_sha256"), folded.alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


@query("op12_embedding_whitening")
def op12_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    out, model, error = whitening.whitened(pick(read(spark, sf_dir, "embeddings"), "vec_id", "embedding"))
    explained = F.array(*[F.lit(float(e)) for e in model.explained]) if model is not None and len(model.values) else F.array().cast("array<double>")
    return out.select(
        F.col("key").alias("vec_id"), "component", F.lit(model.n if model else None).cast("long").alias("n"), "deviation", "whitened",
        F.get(explained, F.col("component") - 1).alias("explained"), F.lit(error).alias("identity_error"))
