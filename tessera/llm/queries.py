"""One query for each operator: the operator with production parameters on its whole table."""

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import audio, chat, decontaminate, jaccard_join, lm_scoring, mixing, pii, quality, toxicity, url_filter

Query = Callable[[SparkSession, str], DataFrame]
#: Target shares of the output: src0 three parts, src1 two, every other source one.
MIX_WEIGHTS, MIX_SEED = {"src0": 3.0, "src1": 2.0}, 42

URL_RULES = (("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block"), ("net/fr/", "block"))


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def remainder(of: int):
    """crc32 of doc_id as text, modulo `of`: the fold of a labelled row."""
    return F.crc32(F.col("doc_id").cast("string")) % of


#: Samples a second of the recordings that op1 makes of embeddings.
RATE = 2400


def melody(vector: np.ndarray | None) -> bytes | None:
    """A recording made of an embedding: each pair of numbers is a note, the first its pitch, the second its loudness; an odd last one has loudness 0."""
    if vector is None:
        return None
    v, t = np.nan_to_num(np.array([*vector, *[0.0] * (len(vector) % 2)], dtype=np.float64).reshape(-1, 2)), np.arange(RATE // 8) / RATE
    hertz = 440 * 2 ** (np.floor(np.clip(v[:, :1] * 40, -18, 17)) / 12)
    return (np.sin(2 * np.pi * hertz * t) * (8000 + 8000 * np.tanh(v[:, 1:]))).ravel().astype("<i2").tobytes()


def op1_chroma_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recordings made of all embeddings, fingerprinted; every twentieth id is looked up in all. One row a recording, one a pair of classes that align."""
    prints = audio.fingerprints(read(spark, sf_dir, "embeddings"), RATE, "vec_id", "embedding", melody)
    return audio.align(prints, F.col("id") % 20 == 0).withColumnRenamed("id", "vec_id")


def op2_poisson_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, repeated to the target shares of their sources and shuffled."""
    return mixing.poisson_mix(read(spark, sf_dir, "documents"), MIX_WEIGHTS, seed=MIX_SEED)


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The toxicity of every document; a null id is in no fold, so it is not held out."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.train_toxic(docs, read(spark, sf_dir, "labels").filter(remainder(5) != 0))
    scored = toxicity.score_toxic(docs, model)
    return scored.select("doc_id", F.coalesce(remainder(5) == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "toxic_windows")


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The class and the number of links of every document."""
    return jaccard_join.jaccard_classes(read(spark, sf_dir, "documents"))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document and benchmark item that it holds."""
    return decontaminate.find_contamination(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdict on every page by its URL; the score is rounded so that it has one value in any order of summing."""
    return url_filter.filter_urls(read(spark, sf_dir, "pages"), URL_RULES).withColumn("score", F.round("score", 6))


def op7_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cross-entropy difference of every document; the target are the documents that are marked as good."""
    target = read(spark, sf_dir, "labels").filter("quality = 1").select("doc_id")
    return lm_scoring.cross_entropy_difference(read(spark, sf_dir, "documents"), target)


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quality of every document; a null id is in no fold, so it is not held out."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.train_quality(docs, read(spark, sf_dir, "labels").filter(remainder(4) != 2))
    scored = quality.score_quality(docs, model)
    return scored.select("doc_id", F.coalesce(remainder(4) == 2, F.lit(False)).alias("held_out"), "score", (F.col("score") >= model.accept_at).cast("int").alias("predicted"))


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The personal data of every document and the terms that reveal it, counted and listed."""
    found = pii.find_pii(read(spark, sf_dir, "documents"))
    counts = {f"n_{kind}": F.size(F.array_remove(F.transform("entities", lambda e: F.when(e["kind"] == kind, kind).otherwise("")), "")).cast("long") for kind in pii.PATTERNS}
    return found.withColumns(counts).select("doc_id", *counts, F.sha2(pii.listed(F.col("entities")), 256).alias("base_sha256"), pii.listed(F.concat("entities", "terms")).alias("spans"))


def op10_perspectives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation from the view of each of its participants."""
    return chat.rotate_perspectives(read(spark, sf_dir, "conversations"))


QUERIES: dict[str, Query] = {
    "op1_chroma_fingerprints": op1_chroma_fingerprints,
    "op2_poisson_mix": op2_poisson_mix,
    "op3_toxicity": op3_toxicity,
    "op4_jaccard_join": op4_jaccard_join,
    "op5_decontamination": op5_decontamination,
    "op6_url_filter": op6_url_filter,
    "op7_lm_scoring": op7_lm_scoring,
    "op8_quality": op8_quality,
    "op9_pii": op9_pii,
    "op10_perspectives": op10_perspectives,
}
