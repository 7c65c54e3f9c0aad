"""The helpers that the operators share, and the entry module's guard."""

import time

import pytest
from pyspark.sql import functions as F

from tessera.llm import common, mixing, queries, url_filter


def test_joined_splits_hot_keys(spark):
    rows = spark.range(3000).select("id", F.when(F.col("id") < 2000, 7).otherwise(F.col("id")).alias("k"), F.lit("x").alias("v"))
    table = spark.range(0, 3000, 2).select(F.col("id").alias("k"), (F.col("id") * 2).alias("w")).union(spark.sql("SELECT 7L, 14L"))
    want = sorted(map(tuple, rows.join(table, ["k"]).collect()))
    got = common.joined(rows, table, ["k"], least=100)
    assert got.columns == ["k", "id", "v", "w"] and sorted(map(tuple, got.collect())) == want and len(want) > 2400
    assert sorted(map(tuple, common.looked_up(rows, table, ["k"], 10).collect())) == want
    assert common.joined(rows.limit(0), table, ["k"]).count() == 0


def test_same_again(spark, tmp_path):
    spark.range(10).selectExpr("id", "'t' AS text").write.parquet(str(tmp_path / "docs"))
    docs = spark.read.parquet(str(tmp_path / "docs"))
    assert all(map(common.same_again, (docs, docs.select(F.upper("text").alias("t"), "id").filter("id > 3"))))
    other = (docs.limit(3), docs.dropDuplicates(["text"]), docs.sample(0.5), docs.filter("rand() > 0.5"), docs.withColumn("text", F.udf(str)("id")), spark.range(3), docs.join(spark.range(3), "id"))
    assert not any(map(common.same_again, other))


def test_shuffles_deleted(spark, tmp_path):
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before, manager = spark.conf.get(name), spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def shuffled():
        blocks = manager.getAllBlocks()
        return {str(b) for b in (blocks.apply(i) for i in range(blocks.size())) if b.isShuffle()}

    old = shuffled()
    with common.shuffles_deleted(spark):
        for i in range(3):
            spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count().write.parquet(str(tmp_path / f"{i}"))
        until = time.time() + 20
        while shuffled() - old and time.time() < until:
            time.sleep(0.1)
    assert not shuffled() - old
    assert spark.conf.get(name) == before and spark.read.parquet(str(tmp_path / "2")).count() == 7


def test_shared_dir_needs_a_setting_on_a_cluster():
    class Answer:
        def __getattr__(self, name):
            return lambda *a: self

        def isEmpty(self):
            return True

    class Context:
        master, _jsc = "spark://host:7077", Answer()

    class Session:
        sparkContext, conf = Context(), {}

    with pytest.raises(ValueError):
        common.shared_dir(Session())


def test_rows_without_id_draw_by_content(spark):
    docs = spark.createDataFrame([(None, f"text {i}", "a") for i in range(2000)] + [(i, "t", "a") for i in range(2000)], "doc_id long, text string, source string")
    out = mixing.poisson_mix(docs, {}, seed=3).filter("doc_id is null")
    counts = [r["count"] for r in out.groupBy("text").count().collect()]
    assert 1100 < len(counts) < 1400 and sum(counts) == pytest.approx(2000, rel=0.1)  # 1 - 1/e of the texts are drawn
    assert out.select("shuffle_key").distinct().count() == out.count()


def test_urls_of_one_common_rest(spark, monkeypatch):
    monkeypatch.setattr(common.joined, "__defaults__", (50,))
    urls = [f"http://a{i}.example.com/en/{i}" for i in range(60)] + [f"http://b{i}.com/{i}" for i in range(60)] + [f"http://c{i}.net/es/x" for i in range(60)]
    pages = spark.createDataFrame([(i, u) for i, u in enumerate([*urls, *[None] * 300, *["http://q.org/one"] * 300])], "page_id long, url string")
    got = {r.page_id: r for r in url_filter.filter_urls(pages, queries.URL_RULES).collect()}
    assert len(got) == 780 and all(r.verdict in ("allow", "block") for r in got.values())
    assert len({(r.verdict, r.score) for i, r in got.items() if 180 <= i < 480}) == 1 and got[200].host == "" and got[200].rule is None


def test_url_threshold_and_verdict_brute_force(spark):
    """Mean log ratios, threshold and verdicts from plain counts; the ratios themselves are those of gram_ratios()."""
    import hashlib

    import numpy as np

    urls = [f"http://s{i}.com/{'news' if i % 2 else 'item'}/{i}" for i in range(80)] + [f"http://n{i}.net/{'es' if i % 2 else 'fr'}/buy{i}" for i in range(80)] + [f"http://o{i}.org/{'news' if i % 3 else 'buy'}{i}" for i in range(40)]
    got = {r.page_id: r for r in url_filter.filter_urls(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string"), queries.URL_RULES).collect()}
    rest = [u.split("://", 1)[1] for u in urls]
    says = [None if i >= 160 else "allow" if i < 80 else "block" for i in range(200)]
    held = [hashlib.md5(x.encode()).hexdigest()[0] in "012" for x in rest]
    grams = [[w[i : i + 4] for w in [f"^^^{x}$"] for i in range(len(w) - 3)] for x in rest]
    counts = {}
    for g, s, h in zip(grams, says, held, strict=True):
        if s and not h:
            for x in g:
                counts.setdefault(x, [0, 0])[s == "block"] += 1
    table = spark.createDataFrame([(g, *n) for g, n in counts.items()], "g string, a long, r long")
    ratio = dict(url_filter.gram_ratios(table, spark.createDataFrame([(x,) for x in {x for g in grams for x in g}], "g string")).collect())
    score = [np.mean([ratio[x] for x in g]) for g in grams]
    a, r = ([score[i] for i in range(160) if held[i] and says[i] == v] for v in ("allow", "block"))
    threshold = (np.mean(a) * np.std(r) + np.mean(r) * np.std(a)) / (np.std(a) + np.std(r))
    for i in range(160, 200):
        assert got[i].score == pytest.approx(score[i], abs=1e-9) and got[i].verdict == ("allow" if score[i] >= threshold else "block")
    assert {got[i].verdict for i in range(160, 200)} == {"allow", "block"}
