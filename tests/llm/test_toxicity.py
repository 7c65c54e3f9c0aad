"""Toxicity by compression distance: accuracy on inflected stems, plain lengths, ties and edge cases."""

import random

import numpy as np
import pytest
import zstandard

from tessera.llm import queries, toxicity


def syllables(draw, n):
    return "".join(draw.choice(["ba", "ke", "li", "mo", "nu", "ra", "si", "to", "ver", "wen"]) for _ in range(n))


def corpus(n=600, every=5, stems=("xuddra", "qopp", "zuvve"), seed=2):
    """Texts of random words; every fifth has words of toxic stems with free endings, few of which recur."""
    draw, texts, marks = random.Random(seed), [], []
    for i in range(n):
        words = [syllables(draw, draw.choice([1, 2, 2, 3])) for _ in range(draw.choice([40, 80, 160]))]
        if toxic := i % every == 0:
            for _ in range(max(3, len(words) // 25)):
                words[draw.randrange(len(words))] = draw.choice(stems) + syllables(draw, draw.choice([1, 2]))
        texts.append(" ".join(words))
        marks.append(int(toxic))
    return texts, np.array(marks)


@pytest.fixture(scope="module")
def model():
    return toxicity.fit_toxic(*corpus())


def test_inflected_stems_are_found(model):
    texts, marks = corpus(seed=9)
    flags = np.array([model.judged(t)[1] >= 0.5 for t in texts])
    assert flags[marks == 1].mean() >= 0.95 and flags[marks == 0].mean() <= 0.02


def test_lengths_brute_force(model):
    """Gains from plain lengths of windows, each compressed by an object of its own."""

    def length(window, dictionary):
        held = zstandard.ZstdCompressionDict(dictionary, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        settings = zstandard.ZstdCompressionParameters(window_log=23, hash_log=17, chain_log=17, search_log=3, min_match=5, target_length=16, strategy=zstandard.STRATEGY_DFAST, write_content_size=False, write_checksum=False, write_dict_id=False)
        held.precompute_compress(compression_params=settings)
        return len(zstandard.ZstdCompressor(compression_params=settings, dict_data=held).compress(window))

    for text in corpus(20, seed=4)[0]:
        words = toxicity.transcribed(text)
        wanted = [length(w, model.ordinary) - length(w, model.toxic + model.ordinary) for i in range(0, len(words), model.window_words) for w in [b"".join(words[i : i + model.window_words])]]
        assert model.gains(text).tolist() == wanted
        n, score = model.judged(text)
        assert n == sum(g >= model.least_gain for g in wanted) and (score >= 0.5) == (n / len(wanted) >= model.least_share)


def test_single_quotes_take_nothing_away():
    texts, marks = corpus()
    quoting = marks.copy()
    quoting[np.flatnonzero(marks == 1)[:3]] = 0
    model = toxicity.fit_toxic(texts, quoting)
    assert np.mean([model.judged(t)[1] >= 0.5 for t, m in zip(*corpus(seed=7), strict=True) if m]) >= 0.95


def test_edges(spark, model):
    rows = [(None, "a null id"), (1, None), (2, ""), (3, " \n "), (4, "... 12 _"), (5, "word " * 100_000), (6, "same text"), (6, "same text"), (7, "x" * 200_000), (8, "\U0001f600 \x00")]
    docs = spark.createDataFrame([(*r, "s", 7) for r in rows], "doc_id long, text string, score string, toxic_windows int")
    out = toxicity.score_toxic(docs, model).collect()
    assert len(out) == len(rows) and all(0 <= r.score < 0.5 for r in out)
    assert len({(r.toxic_windows, r.score) for r in out if r.doc_id == 6}) == 1
    empty = [r.score for r in out if r.doc_id in (1, 2, 3, 4)]
    assert len(set(empty)) == 1 and min(r.score for r in out) == empty[0]
    assert toxicity.score_toxic(docs.limit(0), model).count() == 0
    nothing = toxicity.train_toxic(docs.limit(0), spark.createDataFrame([], "doc_id long, toxic int"))
    assert nothing.judged("any text")[1] < 0.5


def test_training_does_not_depend_on_partitions(spark):
    texts, marks = corpus(150)
    texts[1] = texts[0]  # equal texts, marked both ways: toxic
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    labels = spark.createDataFrame([*enumerate(marks.tolist()), (None, 1), (3, None)], "doc_id long, toxic int")
    one, other = toxicity.train_toxic(docs.repartition(1), labels), toxicity.train_toxic(docs.repartition(7), labels.repartition(3))
    assert (one.toxic, one.ordinary, one.least_gain, one.least_share) == (other.toxic, other.ordinary, other.least_gain, other.least_share)


def test_held_out(spark, sf_dir):
    big = sf_dir.replace("0.001", "0.1")
    rows = queries.op3_toxicity(spark, big).join(spark.read.parquet(f"{big}/labels.parquet"), "doc_id").filter("held_out").collect()
    toxic = [r.predicted for r in rows if r.toxic]
    assert len(toxic) > 50 and np.mean(toxic) >= 0.85 and np.mean([r.predicted for r in rows if not r.toxic]) <= 0.01
