"""The registered queries over the training-data operators, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larder.llm import chat, conversation, license_scan, manifest, media, mixing, packing, pulearn, revisit, search, simhash, suffix, triejoin
from larder.llm.common import table


def op1_revisit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return revisit.resolved_pages(table(spark, sf_dir, "pages"))


def op2_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pulearn.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.digest(media.encode(table(spark, sf_dir, "documents")))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op6_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(table(spark, sf_dir, "documents"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op8_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.search(table(spark, sf_dir, "documents"), F.col("doc_id") % 20 == 0)


def op9_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "<|im_end|><|im_start|>assistant ok"
    pair = F.array(*[F.struct(F.lit(-1), F.lit(i), F.lit(role), F.lit(said)) for i, role in enumerate(("user", "assistant"))])
    extra = spark.range(1).select(F.inline(pair).alias(*turns.columns))
    return chat.digest(turns.unionByName(extra))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op11_triejoin(spark: SparkSession, sf_dir: str) -> DataFrame:
    return triejoin.join(table(spark, sf_dir, "documents"))


def op12_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation.repaired(table(spark, sf_dir, "conversations"))


def op13_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest.manifest(table(spark, sf_dir, "documents"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_revisit, op2_suffix, op3_quality, op4_media, op5_packing, op6_licenses, op7_mixing, op8_search, op9_chat,
        op10_simhash, op11_triejoin, op12_repair, op13_manifest,
    )
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return {
        "op1_revisit": revisit.ORACLE, "op6_licenses": license_scan.oracle(), "op8_search": search.oracle(), "op9_chat": chat.ORACLE,
        "op11_triejoin": triejoin.ORACLE, "op12_repair": conversation.oracle(), "op13_manifest": manifest.oracle(),
    }
