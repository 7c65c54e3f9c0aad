"""The corpus pipeline: stages, each of which reads what its predecessor kept.

For all stages: an empty table gives an empty table; further columns are kept as they are, whatever their names; rows with a null id
are rows like others; whole texts count, however long.
"""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import decontaminate, jaccard_join, mixing, pii, quality
from tessera.llm.common import dropped, saved
from tessera.llm.queries import MIX_SEED, MIX_WEIGHTS, read, remainder

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the quality classifier rejects. It learns from the labelled rows of the table `documents`.

    Null and empty texts are scored as empty ones, and share their fate; equal texts share theirs.
    """
    model = quality.train_quality(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels").filter(remainder(4) != 2))
    return quality.keep_quality(docs, model)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near copies: the one that names the group, which has the least id.

    Null and empty texts, and texts without words, are copies of nothing, and stay. So do rows with a null id, which can't name a group.
    Of rows that share id and text one stays.
    """
    return jaccard_join.drop_near_duplicates(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a passage of the benchmark. Null and empty texts hold none, and stay; equal texts share their fate."""
    return decontaminate.drop_contaminated(docs, read(spark, sf_dir, "benchmark"))


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data, and generalises or removes the terms that reveal it. n_chars follows the text.

    Null texts stay null, and their n_chars is null; empty texts stay empty; rows of the same id and text get the same text.
    """
    return pii.sanitise(docs).withColumn("n_chars", F.length("text").cast("long"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats documents to the target weights of their sources and shuffles them globally.

    Texts play no part. A null source is a source of its own; rows that share an id get equal counts.
    """
    return mixing.poisson_mix(docs, MIX_WEIGHTS, seed=MIX_SEED)


STAGES: list[tuple[str, Stage]] = [
    ("quality", quality_stage),
    ("near_duplicates", near_duplicate_stage),
    ("decontamination", decontamination_stage),
    ("pii", pii_stage),
    ("mixing", mixing_stage),
]

#: The quality classifier's floating-point training is not SQL.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies all stages to the table `documents`; each stage's rows are written to the shared folder and read again, and deleted after the next."""
    docs, before = read(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), name)
        if before is not None:
            dropped(spark, before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
