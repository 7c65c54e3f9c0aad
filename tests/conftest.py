import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).parent.parent))

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[*]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("checkpoint"))).config("spark.executorEnv.PYTHONPATH", str(Path(__file__).parent.parent)).getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    return session


@pytest.fixture
def sf_dir():
    return DATA


@pytest.fixture(scope="session")
def agree(spark):
    """Asserts that a query has the rows of its DuckDB SQL, in any order."""
    duckdb = pytest.importorskip("duckdb")
    from tessera.sources import TABLES

    db = duckdb.connect()
    for t in TABLES:
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")

    def rows(df):
        df = df[sorted(df.columns)].astype(object)
        return sorted(tuple(repr(round(v, 6)) if isinstance(v, float) else str(v) for v in r) for r in df.itertuples(index=False))

    def check(query, sql):
        ours, theirs = query(spark, DATA).toPandas(), db.execute(sql).df()
        assert sorted(ours.columns) == sorted(theirs.columns)
        assert rows(ours) == rows(theirs)

    return check
