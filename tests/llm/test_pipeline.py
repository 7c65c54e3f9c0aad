"""The pipeline against a brute-force version of all its stages, and each stage on odd rows."""

import hashlib
import math
from collections import Counter, defaultdict

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from tessera.llm import decontaminate, quality, queries
from tests.llm.test_text_operators import ODD, brute_classes, brute_terms, entities

STAGES = dict(corpus_pipeline.STAGES)


def holds(text, items):
    """Whether any item-sized window of the text has the weighted similarity of any item."""
    w = decontaminate.words(text)
    for own, n, size in items:
        if len(w) < size or not own.keys() & decontaminate.weighted(w, size).keys():
            continue  # no window shares a shingle
        for p in range(max(1, len(w) - n + 1)):
            part = w[p : p + n]
            if len(part) >= size and decontaminate.similarity(decontaminate.weighted(part, size), own) >= 0.8:
                return True
    return False


def sanitised(text, spans):
    """Marks for the spans; one that begins within another is marked from its end on, if it reaches beyond."""
    out, at = [], 0
    for start, end, mark in sorted(spans, key=lambda s: (s[0], -s[1])):
        if end > at:
            out += [text[at:start] if start > at else "", mark]
            at = end
    return "".join(out) + text[at:]


def poisson(rate, u):
    """The inverse of the Poisson distribution at u."""
    k, p = 0, math.exp(-rate)
    total = p
    while total <= u and k < rate + 12 * math.sqrt(rate) + 20:
        k += 1
        p *= rate / k
        total += p
    return k


def test_run_against_brute_force(spark, sf_dir):
    docs = [r.asDict() for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    model = quality.train_quality(*(spark.read.parquet(f"{sf_dir}/{t}.parquet").filter(f) for t, f in (("documents", F.lit(True)), ("labels", queries.remainder(4) != 2))))
    docs = [d for d in docs if model.score(quality.np.array([quality.features(d["text"])]))[0] >= model.accept_at]

    label = {d: c for d, _, c, _ in brute_classes([(d["doc_id"], d["text"]) for d in docs])}
    docs = [d for d in docs if label[d["doc_id"]] == d["doc_id"]]

    items = []
    for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect():
        if w := decontaminate.words(r.text):
            items.append((decontaminate.weighted(w, min(5, len(w))), len(w), min(5, len(w))))
    docs = [d for d in docs if not holds(d["text"], items)]

    terms = brute_terms([d["text"] for d in docs])
    for d, more in zip(docs, terms, strict=True):
        marks = [(a, b, f"[{k.upper()}]") for k, a, b in entities(d["text"])] + [(a, b, "" if k == "remove" else "[TERM]") for k, a, b in more]
        d["text"] = sanitised(d["text"], marks)
        d["n_chars"] = len(d["text"])

    sizes = Counter(d["source"] for d in docs)
    weights = {s: queries.MIX_WEIGHTS.get(s, 1.0) for s in sizes}
    wanted = []
    for d in docs:
        u = int(hashlib.md5(f"{queries.MIX_SEED}:{d['doc_id']}".encode()).hexdigest()[:13], 16) / 2**52
        for i in range(poisson(weights[d["source"]] * len(docs) / sum(weights.values()) / sizes[d["source"]], u)):
            wanted.append((*d.values(), i, hashlib.md5(f"{queries.MIX_SEED}-order:{d['doc_id']}:{i}".encode()).hexdigest()))

    got = corpus_pipeline.run(spark, sf_dir)
    assert got.columns == [*(docs[0]), "copy_id", "shuffle_key"]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(wanted, key=str) and len(wanted) > 50


@pytest.mark.parametrize("name", list(STAGES))
def test_stage_on_odd_rows(spark, sf_dir, name):
    # Columns whose names the operators use within.
    schema = "doc_id long, text string, lang string, source string, n_chars long, id string, node long, label int, key string, score double, pii_spans string, `a.b` int, component_id long"
    rows = [(i, t, None, s, None, "x", 7, 1, "y", 9.0, "z", 3, 4) for i, t, s in [*ODD, (8, "mail a@b.cc now", None), (9, "😀 " * 300, "b")]]
    docs = spark.createDataFrame(rows, schema)
    out = STAGES[name](spark, docs, sf_dir)
    kept = out.collect()
    assert out.columns[: len(docs.columns)] == docs.columns and {r.id for r in kept} <= {"x"} and {r["a.b"] for r in kept} <= {3}
    if name == "pii":
        texts = defaultdict(list)
        for r in kept:
            texts[r.doc_id].append(r.text)
        assert texts[8] == ["mail [EMAIL] now"] and texts[1] == [None] and texts[2] == [""] and len(kept) == len(rows)
        assert all(r.n_chars == (None if r.text is None else len(r.text)) for r in kept)
    if name == "decontamination":
        assert len(kept) == len(rows)
    if name == "near_duplicates":
        assert sorted(str(r.doc_id) for r in kept) == ["1", "2", "3", "4", "6", "8", "9", "None"]
    assert STAGES[name](spark, docs.limit(0), sf_dir).count() == 0
