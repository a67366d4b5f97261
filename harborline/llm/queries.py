"""One query for each operator, over its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from harborline.llm.common import table
from harborline.llm.decontamination import find_contained
from harborline.llm.divergence import audit_sources
from harborline.llm.fill_middle import fill_in_middle, restored
from harborline.llm.neighbours import nearest
from harborline.llm.packing import pack
from harborline.llm.secret_scan import scan_secrets
from harborline.llm.sentence_pieces import encode_texts, read_pieces
from harborline.llm.sharding import shard_by_bytes
from harborline.llm.simhash import near_classes
from harborline.llm.substring_dedup import remove_repeats
from harborline.llm.token_counts import count_tokens, read_vocabulary
from harborline.llm.toxicity import toxicity_scores
from harborline.llm.url_filter import judge_urls

SHARDS = 24
NEAREST = 5


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    scanned = scan_secrets(table(spark, sf_dir, "documents"))

    def joined(column: str):
        return F.array_join(
            F.transform(column, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ","
        )

    def count(kind: str):
        return F.size(F.filter("base", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return scanned.select(
        "doc_id", count("assign"), count("access"), count("hex"),
        F.sha2(joined("base"), 256).alias("base_sha256"), joined("found").alias("spans"),
    )


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = shard_by_bytes(table(spark, sf_dir, "documents"), SHARDS)
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op5_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, NEAREST)


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outcomes: a label's doc_id names the page of that number, and quality 0 is a bad outcome."""
    labels = table(spark, sf_dir, "labels")
    outcomes = labels.where("quality is not null").select(
        F.col("doc_id").alias("page_id"), (F.col("quality") == 0).cast("int").alias("bad")
    )
    return judge_urls(table(spark, sf_dir, "pages"), outcomes)


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    classes = near_classes(table(spark, sf_dir, "documents"))
    return classes.select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id")
    )


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    stripped = remove_repeats(table(spark, sf_dir, "documents"), keep_text=False)
    return stripped.select("doc_id", "n_words", "n_removed", "kept_sha256")


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"), read_vocabulary())


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_contained(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op11_sentence_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    coded = encode_texts(table(spark, sf_dir, "documents"), read_pieces(public_tokenizers.path("piece_bpe_32k.model")))
    return coded.select(
        "doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"), "agrees",
    )


def op12_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    def digest(text):
        return F.sha2(text.cast("binary"), 256)

    return fill_in_middle(table(spark, sf_dir, "documents")).select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars", digest(F.col("output")).alias("output_sha256"),
        digest(restored("output", "form")).alias("restored_sha256"),
    )


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit_sources(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in sorted(globals().items()) if name.startswith("op")}
