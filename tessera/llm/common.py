"""Small helpers that the operators share."""

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import AbstractContextManager, contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: White space of the word rules: space, and tab to carriage return.
SPACE = " \t\n\x0b\x0c\r"


def fresh(df: DataFrame, base: str) -> str:
    """A column name that `df` doesn't have, whatever case Spark compares names in."""
    taken, name = {c.lower() for c in df.columns}, base
    while name.lower() in taken:
        name += "_"
    return name


def col(name: str) -> Column:
    """The column of that very name, also where the name has dots."""
    return F.col("`" + name.replace("`", "``") + "`")


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir that all executors share. Where the setting is absent, a local master, as in tests, gets a temporary folder.

    A cluster without the setting is an error: a folder of one machine would lose data.
    """
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        path = spark.conf.get("spark.checkpoint.dir", None)
        if not path and not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        context.setCheckpointDir(path or tempfile.mkdtemp(prefix="tessera-checkpoint-"))
    return context._jsc.sc().getCheckpointDir().get()


def saved(df: DataFrame, what: str) -> DataFrame:
    """Writes `df` to the shared folder and reads it again: lineage is cut, and lost executors lose nothing."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def same_again(df: DataFrame) -> bool:
    """Whether `df` is made of files by columns and filters of rows alone, so that it has the same rows whenever it is read, at little cost."""

    def plain(node) -> bool:
        name, below = node.nodeName(), node.children()
        if name == "LogicalRelation":
            return node.relation().getClass().getSimpleName() == "HadoopFsRelation"
        return name in ("Project", "Filter") and all(plain(below.apply(i)) for i in range(below.size()))

    plan = df._jdf.queryExecution().optimizedPlan()
    return plan.deterministic() and plain(plan)


@contextmanager
def setting(spark: SparkSession, name: str, value: str) -> Iterator[None]:
    """Within it, the session has that setting, for what is written there."""
    before = spark.conf.get(name, None)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def arrow_batches(spark: SparkSession, rows: int) -> AbstractContextManager[None]:
    """At most so many rows go to a Python worker at a time: whole texts and arrays can be large."""
    return setting(spark, "spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def shuffles_deleted(spark: SparkSession) -> AbstractContextManager[None]:
    """Shuffle files are deleted at the end of each query, not when the driver happens to collect its garbage: what saved() wrote is read instead."""
    return setting(spark, "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")


def small(df: DataFrame, rows: int) -> DataFrame:
    """`df`, to be broadcast if it has at most so many rows; otherwise it is joined by shuffle. It should be written first."""
    return F.broadcast(df) if df.count() <= rows else df


#: A key that holds more than one of so many rows is hot; there are fewer hot keys than that.
HOT_KEYS = 1000


def joined(rows: DataFrame, table: DataFrame, keys: list[str], least: int = 10_000) -> DataFrame:
    """rows joined to `table`, whose keys are distinct, without gathering the rows of a hot key in one task.

    The part of the table for hot keys has fewer than HOT_KEYS rows, and is broadcast; all else is joined as usual. Both frames
    should be written or cheap. Up to `least` rows no key is hot.
    """
    total = rows.count()
    if total <= least:
        return rows.join(table, keys)
    hot = rows.groupBy(*keys).count().filter(F.col("count") > total / HOT_KEYS).select(*keys)
    hot = saved(hot, "hot")
    if hot.isEmpty():
        return rows.join(table, keys)
    of_hot = rows.join(F.broadcast(table.join(F.broadcast(hot), keys, "left_semi")), keys)
    return of_hot.unionByName(rows.join(F.broadcast(hot), keys, "left_anti").join(table, keys))


def looked_up(rows: DataFrame, table: DataFrame, keys: list[str], most: int) -> DataFrame:
    """rows joined to a written `table` of distinct keys, which is broadcast if it has at most `most` rows."""
    return rows.join(F.broadcast(table), keys) if table.count() <= most else joined(rows, table, keys)


def dropped(spark: SparkSession, *frames: DataFrame) -> None:
    """Deletes what saved() wrote for `frames`, once nothing reads it any more."""
    context = spark.sparkContext
    for df in frames:
        for path in {f.rpartition("/")[0] for f in df.inputFiles()}:
            hadoop = context._jvm.org.apache.hadoop.fs.Path(path)
            hadoop.getFileSystem(context._jsc.hadoopConfiguration()).delete(hadoop, True)
