"""Mixing sources to target weights by Poisson replication, with DataFrame functions alone.

Each source gets a mean repetition rate (its target share of the output, over its rows). A document's count is
the inverse Poisson distribution at a uniform number that a hash of the seed and its id gives, so that a rerun,
a retried task and any partitioning draw the same counts. Documents are exploded by their counts and dealt out
by a hash of seed, id and copy, which shuffles all copies globally.
"""

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import col, fresh

#: Up to so many sources, their distributions are broadcast (some hundred bytes each); beyond, they are joined by shuffle.
BROADCAST_SOURCES = 20_000


def hashed_unit(*parts: Column) -> Column:
    """Uniform in [0, 1): the first 52 bits of the md5 of the parts, joined by colons."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts)), 1, 13), 16, 10).cast("double") / F.lit(float(2**52))


def poisson_tables(rates: DataFrame) -> DataFrame:
    """Of (key, rate): (key, cdf), the cumulative Poisson probabilities of 0, 1, 2 ... until further terms vanish in double precision.

    Terms are summed as logarithms, so that no rate underflows.
    """
    last = F.ceil(F.col("rate") + 12 * F.sqrt("rate") + 20)
    terms = rates.select("key", "rate", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("k"))
    upto = Window.partitionBy("key").orderBy("k")
    log_factorial = F.sum(F.when(F.col("k") > 0, F.ln("k")).otherwise(0.0)).over(upto)
    power = F.when(F.col("k") == 0, 0.0).otherwise(F.col("k") * F.ln("rate"))
    probability = F.when(F.col("rate") > 0, F.exp(power - F.col("rate") - log_factorial)).otherwise(F.when(F.col("k") == 0, 1.0).otherwise(0.0))
    summed = terms.withColumn("p", probability).select("key", "k", F.sum("p").over(upto).alias("c"))
    return summed.groupBy("key").agg(F.transform(F.sort_array(F.collect_list(F.struct("k", "c"))), lambda x: x["c"]).alias("cdf"))


def poisson_mix(docs: DataFrame, weights: Mapping[str, float], default_weight: float = 1.0, epochs: float = 1.0, seed: int = 0, id_col: str = "doc_id", source_col: str = "source") -> DataFrame:
    """`docs` repeated so that sources have shares in proportion to `weights` in expectation, shuffled globally.

    weights: by source; others, the null source included, weigh `default_weight`. epochs: expected rows out over rows in.
    Returns the columns of `docs` with copy_id (0, 1, ...) and shuffle_key (32 hexadecimal digits; rows are ordered by it
    within each partition, and partitions hold random parts of the whole). Columns of those names in `docs` are replaced.

    Edge cases: rows with a null id draw by a hash of all their columns but maps; rows that share an id get equal counts; a null source is a source of its own;
    sources of weight 0 vanish; texts play no part; an empty table gives an empty table.
    """
    if default_weight < 0 or epochs < 0 or any(w < 0 for w in weights.values()):
        raise ValueError("weights and epochs can't be negative")
    docs = docs.drop(*[c for c in docs.columns if c.lower() in ("copy_id", "shuffle_key")])
    key, cdf = fresh(docs, "mix_key"), fresh(docs, "mix_cdf")
    name = col(source_col).cast("string")
    keyed = docs.withColumn(key, F.when(name.isNull(), "null").otherwise(F.concat(F.lit("="), name)))
    weight = F.lit(float(default_weight))
    for source, w in weights.items():
        weight = F.when(F.col("key") == f"={source}", float(w)).otherwise(weight)
    sizes = keyed.groupBy(F.col(key).alias("key")).agg(F.count("*").alias("n")).withColumn("weight", weight)
    total = sizes.agg(F.sum("n").alias("n"), F.sum("weight").alias("weight"), F.count("*").alias("sources")).first()
    scale = epochs * (total.n or 0) / total.weight if total.weight else 0.0
    tables = poisson_tables(sizes.select("key", (F.col("weight") * scale / F.col("n")).alias("rate"))).withColumnsRenamed({"key": key, "cdf": cdf})
    if total.sources <= BROADCAST_SOURCES:
        tables = F.broadcast(tables)
    name_of = F.coalesce(col(id_col).cast("string"), F.concat(F.lit("null "), F.xxhash64(*[col(c) for c, t in docs.dtypes if "map<" not in t]).cast("string")))
    unit = hashed_unit(F.lit(str(seed)), name_of)
    drawn = keyed.join(tables, key).withColumn(cdf, F.size(F.filter(cdf, lambda c: c <= unit)))
    copies = drawn.filter(F.col(cdf) > 0).withColumn("copy_id", F.explode(F.sequence(F.lit(0), F.col(cdf) - 1)))
    order = F.md5(F.concat_ws(":", F.lit(f"{seed}-order"), name_of, F.col("copy_id").cast("string")))
    return copies.drop(key, cdf).withColumn("shuffle_key", order).repartition("shuffle_key").sortWithinPartitions("shuffle_key")
