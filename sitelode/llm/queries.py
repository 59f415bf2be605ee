"""The registered queries of this subpackage: each applies an operator to its whole table and derives the digest columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import centroids, chat, codes, katz, language, media, near_dup, packing, piece_model, quality, secrets, shards, suffixes
from .common import shared_path, table
from .oracle import ORACLE  # noqa: F401


def op1_katz_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 7 == 2
    scores, _ = katz.katz(table(spark, sf_dir, "documents"), ~held_out)
    return scores.select("doc_id", (~F.col("train")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, _ = secrets.scan_versions(table(spark, sf_dir, "documents"))
    count = lambda kind: F.size(F.filter("findings", lambda s: s["kind"] == kind)).cast("long")
    base = F.filter("findings", lambda s: s["rank"] < len(secrets.BASE))
    return found.select(
        "doc_id",
        count("assign").alias("n_assign"),
        count("access").alias("n_access"),
        count("hex").alias("n_hex"),
        F.sha2(F.encode(secrets.joined(base), "UTF-8"), 256).alias("base_sha256"),
        secrets.joined(F.col("findings")).alias("spans"),
        "blob",
        "rule_version",
    )


def secret_ledger_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three scans into one stored ledger: documents; documents and benchmark items, of which only the latter are new; and
    all of them again under a second rule version that has the base rules alone."""
    path = shared_path(spark, "ledger-versions")
    docs = table(spark, sf_dir, "documents").select(F.concat(F.lit("documents/"), "doc_id").alias("path"), "text")
    items = table(spark, sf_dir, "benchmark").select(F.concat(F.lit("benchmark/"), "item_id").alias("path"), "text")
    before, steps = 0, []
    for step, (versions, rules, version) in enumerate(((docs, secrets.RULES, "1"), (docs.unionByName(items), secrets.RULES, "1"), (docs.unionByName(items), secrets.BASE, "2")), 1):
        found, ledger = secrets.scan_versions(versions, rules=rules, rule_version=version, id_col="path", ledger_path=path)
        now = ledger.count()
        sums = found.agg(F.count(F.lit(1)).alias("n_paths"), F.coalesce(F.sum(F.size("findings")), F.lit(0)).alias("n_spans"))
        steps.append(sums.select(F.lit(step).alias("step"), F.lit(version).alias("rule_version"), "n_paths", F.lit(now - before).cast("long").alias("n_new_blobs"), "n_spans"))
        before = now
    return steps[0].unionByName(steps[1]).unionByName(steps[2])


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_stratified_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    dealt = shards.interleave(table(spark, sf_dir, "documents"), shards=8)
    return dealt.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "source")


def op5_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.text_media(table(spark, sf_dir, "documents"))


def op6_bounded_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op7_chat_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.format_chats(table(spark, sf_dir, "conversations"))


def op8_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(table(spark, sf_dir, "documents")).drop("class_key", "text_hash")


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents (doc_id) and pages (page_id) in one evidence table; each row has one of the two ids."""
    columns = ["text", "declared", "host", "suffix"]
    docs = language.document_evidence(table(spark, sf_dir, "documents")).select("doc_id", F.lit(None).cast("long").alias("page_id"), *columns)
    pages = language.page_evidence(table(spark, sf_dir, "pages")).select(F.lit(None).cast("long").alias("doc_id"), "page_id", *columns)
    return language.identify(docs.unionByName(pages), ["doc_id", "page_id"])


def op10_piece_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_model.encode(table(spark, sf_dir, "documents"))


def op11_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = suffixes.repeated_passages(table(spark, sf_dir, "documents"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return left.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded, books = codes.compress(table(spark, sf_dir, "embeddings"))
    return coded.select("vec_id", F.lower(F.hex("codes")).alias("code"), "error", "label_error", F.lit(codes.digest(books)).alias("codebooks_sha256"))


def op13_centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, at = centroids.clusters(table(spark, sf_dir, "embeddings"))
    digest = F.array(*[F.lit(d) for d in centroids.digests(at)]).cast("array<string>")[F.col("cluster")]
    return found.withColumn("centroid_sha256", digest)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_katz_backoff": op1_katz_backoff,
    "op2_secret_scan": op2_secret_scan,
    "op3_quality_rules": op3_quality_rules,
    "op4_stratified_shards": op4_stratified_shards,
    "op5_media_columns": op5_media_columns,
    "op6_bounded_packing": op6_bounded_packing,
    "op7_chat_repair": op7_chat_repair,
    "op8_near_duplicates": op8_near_duplicates,
    "op9_language_id": op9_language_id,
    "op10_piece_model": op10_piece_model,
    "op11_suffix_dedup": op11_suffix_dedup,
    "op12_vector_codes": op12_vector_codes,
    "op13_centroid_clusters": op13_centroid_clusters,
    "secret_ledger_versions": secret_ledger_versions,
}
