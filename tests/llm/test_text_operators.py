"""Operators on texts against brute-force versions, with the edge cases that their docstrings define."""

import hashlib
import math
import random
import re
from collections import defaultdict
from pathlib import Path
from urllib.parse import urlparse

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import common, decontaminate, jaccard_join, lm_scoring, mixing, oracles, pii, quality, queries
from tessera.llm.components import connected_components

SCHEMA = "doc_id long, text string, source string, score double, copy_id int, node long, id string, key string"


def table(spark, rows):
    """(doc_id, text, source) with further columns whose names the operators use too."""
    return spark.createDataFrame([(i, t, s, 9.0, 8, 7, "x", "y") for i, t, s in rows], SCHEMA)


ODD = [(None, "a null id with some words in it", None), (1, None, "a"), (2, "", "a"), (3, " \n\t ", "a"), (4, "one two", "b"), (5, "One  TWO", "b"), (6, "w " * 50_000, "b"), (4, "one two", "b")]


@pytest.mark.parametrize("name", sorted(set(oracles.ORACLES)))
def test_query_agrees_with_sql(name, agree):
    agree(queries.QUERIES[name], oracles.ORACLES[name])


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())


def brute_classes(rows):
    sets, label, links = [shingles(t) for _, t in rows], list(range(len(rows))), [0] * len(rows)

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                label[root(i)] = root(j)
                links[i] += 1
                links[j] += 1
    least = defaultdict(list)
    for i, (d, _) in enumerate(rows):
        least[root(i)].append(d)
    return sorted(((d, len(sets[i]), min((x for x in least[root(i)] if x is not None), default=None), links[i]) for i, (d, _) in enumerate(rows)), key=str)


def test_sets_of_takes_one_python_worker_a_task(spark):
    texts = [f"text number {i} with a word of its own w{i}" for i in range(200)] + [None, "", "text number 7 with a word of its own w7"]
    rows = spark.createDataFrame([(t,) for t in texts], "text string").withColumn("code", F.xxhash64("text"))
    codes = rows.filter(F.col("text").endswith("7")).select("code").distinct()
    found = jaccard_join.sets_of(rows, codes, 5)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"(?:EvalPython|InArrow|InPandas)\b", plan)) == 1

    wanted = {jaccard_join.node_of(h): h for h in (jaccard_join.shingle_set(t, 5) for t in texts[7:200:10])}
    got = {r.node: jaccard_join.unpacked(bytes(r.hashes)) for r in found.collect()}
    assert wanted.keys() <= got.keys() and len(got) < 30
    assert all((got[n] == h >> np.uint64(16) << np.uint64(16)).all() for n, h in wanted.items())


def test_jaccard_classes_brute_force(spark):
    draw = random.Random(3)
    vocabulary = [f"W{i}" for i in range(400)]
    rows = []
    for family in range(12):
        base = [draw.choice(vocabulary) for _ in range(draw.choice([3, 6, 30, 80, 200]))]
        for _ in range(draw.choice([1, 2, 15])):
            own = list(base)
            for _ in range(draw.choice([0, 0, 1, 2, 4])):
                own[draw.randrange(len(own))] = draw.choice(vocabulary)
            rows.append((len(rows), " ".join(own[: draw.choice([len(own), len(own) - 1])])))
    rows += [(i and 1000 + i, t) for i, t, _ in ODD]
    got = jaccard_join.jaccard_classes(table(spark, [(i, t, "s") for i, t in rows])).collect()
    assert sorted(map(tuple, got), key=str) == brute_classes(rows)


def test_jaccard_classes_of_hot_tokens_and_small_tiles(spark, monkeypatch):
    for name, value in (("SALT_ROWS", 4), ("TILE_ROWS", 5), ("HUB_CHUNK", 3)):
        monkeypatch.setattr(jaccard_join, name, value)
    monkeypatch.setattr(common, "HOT_KEYS", 20)
    monkeypatch.setattr(common.joined, "__defaults__", (10,))
    draw = random.Random(8)
    base = [f"w{i}" for i in range(60)]
    rows = [(i, " ".join(w if draw.random() > 0.02 else f"x{i}" for w in base)) for i in range(80)] + [(100 + i, " ".join(base)) for i in range(40)]
    rows += [(200 + i, " ".join([*(f"y{i} {j}" for j in range(60)), *base[:20]])) for i in range(30)]
    got = jaccard_join.jaccard_classes(table(spark, [(i, t, "s") for i, t in rows])).collect()
    assert sorted(map(tuple, got), key=str) == brute_classes(rows)


def test_jaccard_ids_of_any_size(spark):
    ids = [2**60 + 1, None, 2**60 + 3, -(2**62) - 1, None]
    got = jaccard_join.jaccard_classes(table(spark, [(i, f"one two three four five {n}", "s") for n, i in enumerate(ids)])).collect()
    assert sorted((tuple(r) for r in got), key=str) == sorted(((i, 2, i, 0) for i in ids), key=str)


def test_jaccard_classes_empty_table(spark):
    assert jaccard_join.jaccard_classes(table(spark, [])).count() == 0


def test_jaccard_classes_write_less_than_the_texts(spark, tmp_path, monkeypatch):
    """No frame holds the arrays of all sets, which take more than the texts do; those of sets that are compared are few here."""
    draw, written = random.Random(5), []
    rows = [(i, " ".join(f"{draw.randrange(10**7):07}" for _ in range(400))) for i in range(1000)]
    rows += [(2000 + i, rows[i][1] + " more") for i in range(10)]
    table(spark, [(i, t, "s") for i, t in rows]).coalesce(1).write.parquet(str(tmp_path / "docs"))
    saved = common.saved

    def measured(df, what):
        out = saved(df, what)
        written.extend((Path(urlparse(f).path).stat().st_size, what) for f in out.inputFiles())
        return out

    monkeypatch.setattr(jaccard_join, "saved", measured)
    got = {r.doc_id: (r.component_id, r.n_links) for r in jaccard_join.jaccard_classes(spark.read.parquet(str(tmp_path / "docs"))).collect()}
    assert got == {i: (i % 2000, int(i % 2000 < 10)) for i, _ in rows}
    assert sum(size for size, _ in written) < sum(len(t) for _, t in rows) / 2, written


def test_jaccard_classes_of_texts_that_differ_when_read_again(spark, tmp_path):
    spark.range(20).write.parquet(str(tmp_path / "ids"))
    text = F.udf(lambda i: " ".join([*(f"w{j}" for j in range(100)), random.SystemRandom().randbytes(8).hex()])).asNondeterministic()
    docs = spark.read.parquet(str(tmp_path / "ids")).select(F.col("id").alias("doc_id"), text("id").alias("text"))
    assert {(r.n_shingles, r.component_id, r.n_links) for r in jaccard_join.jaccard_classes(docs).collect()} == {(97, 0, 19)}


def test_drop_near_duplicates(spark):
    long = " ".join(f"w{i}" for i in range(100))
    docs = table(spark, [(1, long, "a"), (2, long + " more", "b"), (3, "other words", "a"), (3, "other words", "a"), (4, "", "a"), (5, None, "a"), (None, long, "a")])
    got = jaccard_join.drop_near_duplicates(docs)
    assert got.columns == docs.columns
    assert sorted(str(r.doc_id) for r in got.collect()) == ["1", "3", "4", "5", "None"]


def test_signature_bounds_difference():
    draw = np.random.default_rng(1)
    for n in (1, 5, 60, 400, 3000):
        a = np.unique(draw.integers(0, 2**63, n, dtype=np.uint64))
        b = np.unique(np.concatenate([a[: n - n // 10], draw.integers(0, 2**63, draw.integers(1, n + 2), dtype=np.uint64)]))
        assert jaccard_join.difference_at_least(jaccard_join.signature(a), jaccard_join.signature(b)) <= len(np.setxor1d(a, b))
        assert (jaccard_join.unpacked(jaccard_join.packed(a)) >> np.uint64(16) == a >> np.uint64(16)).all()


def test_tiles_find_pairs_across_blocks(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "TILE_ROWS", 3)
    h = np.arange(100, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    rows = [(5, i, i, 100 - i % 3, jaccard_join.signature(np.sort(h[: 100 - i % 3]))) for i in range(12)]
    df = spark.createDataFrame(rows, "token long, node long, label long, n long, bits binary")
    assert {(r.a, r.b) for r in jaccard_join.tiled_pairs(df.drop("bits"), df.select("node", "bits").distinct()).collect()} == {(i, j) for j in range(12) for i in range(j)}


def test_connected_components(spark):
    chain = [(i, i + 1) for i in range(20)]
    edges = spark.createDataFrame([*chain, (50, 40), (50, 60), (60, 50), (70, 70)], "a long, b long")
    assert dict(map(tuple, connected_components(edges).collect())) == {i: 0 for i in range(21)} | {40: 40, 50: 40, 60: 40}


ENTITIES = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def entities(text):
    def valid(kind, v):
        d = [int(c) for c in v if c.isdigit()]
        luhn = sum(sum(divmod(x * 2, 10)) if i % 2 else x for i, x in enumerate(reversed(d))) % 10 == 0
        return {"email": True, "ip": all(int(p) <= 255 for p in v.split(".") if p.isdigit()), "card": 13 <= len(d) <= 19 and luhn, "phone": 9 <= len(d) <= 15}[kind]

    return [(k, m.start(), m.end()) for k, p in ENTITIES.items() for m in re.finditer(p, text or "") if valid(k, m[0])]


def test_entities_brute_force(spark):
    draw, pools = random.Random(1), ["0123456789. -+()", "a@b.-_%+Z9@.", "4111 1111-1111 1111 ", "ü😀x ", "255.0.01.300 "]
    rows = [(i, "".join(draw.choice(draw.choice(pools)) for _ in range(draw.choice([5, 20, 60, 200]))), "s") for i in range(600)]
    rows += [(700, "a" * 100_000, "s"), (701, "a@" + "b." * 20_000, "s"), (702, "4111111111111111 x" * 600, "s"), (703, "a_@b.c_d@e.f.@g.h", "s"), (704, "0000255.1.1.00001 1.2.3.4.5.6.7.8", "s")]
    rows += [(800 + (i or 0), t, s) for i, t, s in ODD]
    got = pii.find_entities(table(spark, rows)).select("id", "entities").collect()
    assert sorted((r.id, [(e.kind, e.start, e.end) for e in r.entities]) for r in got) == sorted((i, entities(t)) for i, t, _ in rows)


def test_terms_that_reveal(spark):
    rows = [(i, f"The account of Wolfgang is mail{i // 10}@site.example at branch number {i}", "s") for i in range(40)]
    rows += [(100 + i, f"plain words about the account at branch number {i}", "s") for i in range(400)] + [(None, "A null id: x@y.zz", "s"), (900, None, "s")]
    docs = table(spark, rows)
    found = {r.doc_id: {t.value for t in r.terms} for r in pii.find_pii(docs).collect()}
    assert found[3] == {"wolfgang"} and found[100] == set() and found[None] == set() and len(found) == 442
    safe = pii.sanitise(docs)
    assert safe.columns == docs.columns and safe.count() == len(rows)
    texts = {r.doc_id: r.text for r in safe.collect()}
    assert texts[3] == "The account of  is [EMAIL] at branch number 3" and texts[100] == rows[40][1] and texts[None] == "A null id: [EMAIL]" and texts[900] is None
    assert pii.sanitise(docs.limit(0)).count() == 0


def brute_terms(texts, min_texts=3):
    """For each text the spans (kind, start, end) of its revealing terms, from plain counts of documents."""
    def part(kind, value):
        digits = re.sub("[^0-9]", "", value)
        return {"email": value.split("@")[-1], "ip": ".".join(value.split(".")[:2]), "card": digits[:6], "phone": digits[:4]}[kind]

    own, held, occurs, both = [], defaultdict(list), defaultdict(int), defaultdict(list)
    for i, text in enumerate(texts):
        text = text or ""
        found = [(k, text[a:b].lower(), a, b) for k, a, b in entities(text)]
        values = {v for _, v, _, _ in found} | {f"{k} of {part(k, v)}" for k, v, _, _ in found}
        words = [(m[0].lower(), m.start(), m.end()) for m in re.finditer(r"[^\W\d_]{4,}", text)]
        own.append((values, words, found))
        for v in values:
            held[v].append(i)
        for w in {w for w, _, _ in words}:
            occurs[w] += 1
            for v in values:
                both[v, w].append(i)
    weights, n, out = {}, len(texts), []
    for (v, w), rows in both.items():
        if len({texts[i] for i in rows}) >= min_texts and len(held[v]) < n:
            weights[v, w] = math.log2(len(rows) * n / (len(held[v]) * occurs[w])) / math.log2(n / len(held[v]))
    for values, words, found in own:
        spans = []
        for w, a, b in words:
            disclosure = max((weights.get((v, w), 0.0) for v in values), default=0.0)
            if disclosure >= 0.6 and not any(c < b and d > a for _, _, c, d in found):
                spans.append(("remove" if disclosure >= 0.9 else "generalise", a, b))
        out.append(sorted(spans))
    return out


def test_terms_brute_force(spark):
    draw = random.Random(4)
    names, common_words = [f"{x}name" for x in "abcdefghij"], [f"word{x}" for x in "abcdefghijklmnopqrst"]
    rows = []
    for i in range(300):
        words = [draw.choice(common_words) for _ in range(20)]
        if i % 3 == 0:
            who = draw.randrange(10)
            # The first of the names goes with one domain alone.
            words[draw.randrange(20)] = f"u{draw.randrange(3)}@site0.org" if who == 0 else draw.choice([f"u{draw.randrange(3)}@site{who}.org", f"10.{who}.0.{draw.randrange(4)}", f"+1 555 00{who} 12{draw.randrange(10, 99)}"])
            for _ in range(draw.choice([0, 1, 3])):
                words[draw.randrange(20)] = names[who].title()
        elif i % 10 == 0:
            words[3] = draw.choice(names[1:])
        rows.append((i, " ".join(words), "s"))
    rows += [(1000 + i, rows[0][1], "s") for i in range(5)]
    want = brute_terms([t for _, t, _ in rows])
    got = {r.doc_id: [(t.kind, t.start, t.end) for t in r.terms] for r in pii.find_pii(table(spark, rows)).collect()}
    assert [got[i] for i, _, _ in rows] == want and {k for w in want for k, _, _ in w} == {"remove", "generalise"}


def test_sanitise_overlapping_entities(spark):
    texts = ["Call +1 555 123 4567john@x.com now", "4111 1111 1111 1111@x.com", "mail 4111111111111111@x.com now", "+1 555 123 4567.1.2.3 end"]
    safe = {r.doc_id: r.text for r in pii.sanitise(table(spark, [(i, t, "s") for i, t in enumerate(texts)])).collect()}
    assert [safe[i] for i in range(3)] == ["Call [PHONE][EMAIL] now", "[CARD][EMAIL]", "mail [EMAIL] now"] and not entities(safe[3])


def test_op9_digest(spark, sf_dir):
    texts = dict(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect())
    for r in queries.op9_pii(spark, sf_dir).collect():
        base = ",".join(f"{k}:{a}:{b}" for k, a, b in entities(texts[r.doc_id]))
        assert r.base_sha256 == hashlib.sha256(base.encode()).hexdigest() and r.spans.startswith(base)


def test_decontamination_brute_force(spark, sf_dir):
    items = dict(spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect())
    texts = dict(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect())
    words, wanted = {d: decontaminate.words(t) for d, t in texts.items()}, set()
    shingles = {d: decontaminate.weighted(w, 5) if len(w) >= 5 else {} for d, w in words.items()}
    for i, item in items.items():
        n, own = len(item.split()), decontaminate.weighted(decontaminate.words(item), 5)
        for d, w in words.items():  # texts that share no shingle have no window that does
            if own.keys() & shingles[d].keys() and any(decontaminate.similarity(decontaminate.weighted(w[p : p + n], 5), own) >= 0.8 for p in range(max(1, len(w) - n + 1)) if len(w[p : p + n]) >= 5):
                wanted.add((d, i))
    assert {(r.doc_id, r.item_id) for r in queries.op5_decontamination(spark, sf_dir).collect()} == wanted


def test_decontamination_edges(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "ITEMS_A_PASS", 2)
    passage = " ".join(f"item{i}" for i in range(20))
    items = spark.createDataFrame([(1, passage), (2, None), (3, ""), (4, passage), (None, "three short words")], "item_id long, text string")
    docs = table(spark, [*ODD, (10, f"before {passage.upper()} after", "s"), (11, "has three short words inside", "s")])
    assert sorted(((r.doc_id, r.item_id) for r in decontaminate.find_contamination(docs, items).collect()), key=str) == [(10, 1), (10, 4), (11, None)]
    clean = decontaminate.drop_contaminated(docs, items)
    assert clean.columns == docs.columns and clean.count() == len(ODD)


def test_decontamination_finds_reordered_passages(spark):
    a, b, before, after = ([f"{x}{i}" for i in range(50)] for x in ("a", "b", "p", "q"))
    items = spark.createDataFrame([(1, " ".join(a + b))], "item_id long, text string")
    docs = table(spark, [(1, " ".join(before + b + a + after), "s"), (2, " ".join(before + b + after), "s")])
    assert [(r.doc_id, r.item_id, r.first_word, r.n_words) for r in decontaminate.find_contamination(docs, items).collect()] == [(1, 1, 50, 100)]
    assert [r.doc_id for r in decontaminate.drop_contaminated(docs, items).collect()] == [2]


def test_decontamination_looks_at_every_start():
    draw = random.Random(6)
    vocabulary = [f"v{i}" for i in range(30)]
    items = [(i, " ".join(draw.choice(vocabulary) for _ in range(n))) for i, n in enumerate([3, 8, 20, 20, 40])]
    benchmark = decontaminate.Benchmark(items, 2, 30, 0.5)
    for _ in range(40):
        w = [draw.choice(vocabulary) for _ in range(60)]
        for i in draw.sample(range(5), 2):
            part = items[i][1].split()
            cut = draw.randrange(len(part))
            w[10 * i : 10 * i] = part[cut:] + part[:cut]
        w, wanted = decontaminate.words(" ".join(w)), {}
        for i, item in items:
            own, n = decontaminate.weighted(decontaminate.words(item), 2), len(item.split())
            for p in range(len(w) - 1):
                part = decontaminate.weighted(w[p : p + n], 2)
                s, d = decontaminate.similarity(part, own), (decontaminate.simhash(part) ^ decontaminate.simhash(own)).bit_count()
                if s >= 0.5 and d <= 30 and (i not in wanted or s > wanted[i][4]):
                    wanted[i] = (i, p, min(n, len(w) - p), d, s)
        assert sorted(benchmark.matches(b" ".join(w).decode())) == sorted(wanted.values())


def test_decontamination_recall_of_edited_passages():
    """Passages with replaced, dropped, inserted and swapped words: of those with a window of similarity 0.8, at least 0.98 are found."""
    draw = random.Random(11)
    words = [f"{draw.choice('bcdfgklmnprst')}{draw.choice('aeiou')}{i}" for i in range(3000)]
    items = [(i, " ".join(draw.choice(words) for _ in range(draw.choice([12, 25, 40, 80])))) for i in range(60)]
    benchmark, similar, found = decontaminate.Benchmark(items, 5, 20, 0.8), 0, 0
    for _ in range(120):
        i, item = draw.choice(items)
        part = item.split()
        own, n = decontaminate.weighted(decontaminate.words(item), 5), len(part)
        for _ in range(draw.choice([0, 1, 1, 2])):
            at = draw.randrange(len(part))
            kind = draw.randrange(4)
            part[at : at + (kind > 0)] = [[draw.choice(words)], [draw.choice(words)], [], part[at : at + 1]][kind]
        if draw.random() < 0.2:
            part = part[n // 2 :] + part[: n // 2]
        w = [*(draw.choice(words) for _ in range(30)), *part, *(draw.choice(words) for _ in range(30))]
        best = max(decontaminate.similarity(decontaminate.weighted([x.encode() for x in w[p : p + n]], 5), own) for p in range(len(w) - n + 1))
        similar += best >= 0.8
        found += best >= 0.8 and any(m[0] == i and m[4] == best for m in benchmark.matches(" ".join(w)))
    assert similar > 30 and found >= 0.98 * similar


def test_decontamination_ids_of_any_size(spark):
    passage = " ".join(f"item{i}" for i in range(20))
    docs = table(spark, [(2**60 + 1, passage, "s"), (None, passage, "s"), (2**60 + 3, "x " + passage, "s")])
    found = decontaminate.find_contamination(docs, spark.createDataFrame([(2**61 + 1, passage), (None, "")], "item_id long, text string"))
    assert sorted(((r.doc_id, r.item_id) for r in found.collect()), key=str) == sorted([(2**60 + 1, 2**61 + 1), (None, 2**61 + 1), (2**60 + 3, 2**61 + 1)], key=str)


def test_hamming_index_finds_all():
    draw = random.Random(5)
    prints = [draw.getrandbits(64) for _ in range(300)]
    prints += [p ^ (1 << draw.randrange(64)) ^ (1 << draw.randrange(64)) for p in prints[:100]]
    index = decontaminate.HammingIndex(prints, 3)
    for p in prints[:50]:
        assert index.within(p) == [(i, (p ^ q).bit_count()) for i, q in enumerate(prints) if (p ^ q).bit_count() <= 3]


def test_quality_held_out(spark, sf_dir):
    big = sf_dir.replace("0.001", "0.01")
    labels = spark.read.parquet(f"{big}/labels.parquet")
    rows = queries.op8_quality(spark, big).join(labels, "doc_id").filter("held_out").collect()
    assert np.mean([r.predicted == r.quality for r in rows]) > 0.95


def test_quality_does_not_depend_on_partitions(spark, sf_dir):
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    one, other = quality.train_quality(docs.coalesce(1), labels), quality.train_quality(docs.repartition(7), labels.repartition(3))
    assert (one.weights == other.weights).all() and one.threshold == other.threshold


def test_quality_brute_force(spark, sf_dir):
    """The gradient of the plain loss over the drawn pairs vanishes at the weights, and no threshold among the scores has fewer errors by 0.5 %."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").join(spark.read.parquet(f"{sf_dir}/labels.parquet"), "doc_id").orderBy("doc_id").collect()
    x, good = np.array([quality.features(r.text) for r in docs]), np.array([r.quality for r in docs])
    model = quality.fit_bradley_terry(x, good)
    z = np.clip((x - x.mean(0)) / (x.std(0) + 1e-6), -6, 6)
    up, down, draw = np.flatnonzero(good == 1), np.flatnonzero(good == 0), np.random.default_rng(7)
    pairs = list(zip(draw.choice(up, len(down) * 16), np.repeat(down, 16), strict=True))
    gradient = 1e-2 * model.weights
    for a, b in pairs:
        d = z[a] - z[b]
        gradient = gradient - d / (1 + np.exp(d @ model.weights)) / len(pairs)
    assert np.abs(gradient).max() < 1e-6
    raw = z @ model.weights
    errors = [((raw >= t) != (good == 1)).sum() for t in (*np.sort(raw), model.threshold)]
    assert errors[-1] <= min(errors) + 0.005 * len(raw)
    assert ((model.score(x) >= 0.7) == (raw >= model.threshold)).all()


def test_quality_edges(spark):
    model = quality.fit_bradley_terry(np.array([quality.features("good words here. And more."), quality.features("BAD!! ### %%%")]), np.array([1, 0]))
    docs = table(spark, ODD)
    assert quality.score_quality(docs, model).filter("score between 0 and 1").count() == len(ODD)
    assert quality.keep_quality(docs, model).columns == docs.columns
    assert quality.fit_bradley_terry(np.zeros((0, len(quality.FEATURES))), np.zeros(0)).score(np.zeros((1, len(quality.FEATURES))))[0] >= 0.7
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert quality.score_quality(docs.limit(0), quality.train_quality(docs, none)).count() == 0


def test_cross_entropy_difference_brute_force(spark):
    docs = table(spark, [(1, "a b a b c", "s"), (2, "b b b a", "s"), (3, "c c rare c", "s"), (4, None, "s"), (5, "", "s"), (None, "a b", "s")])
    got = {r.doc_id: r for r in lm_scoring.cross_entropy_difference(docs, spark.createDataFrame([(1,), (1,)], "x long"), vocabulary_size=5, prior=2.0).collect()}
    texts = {r.doc_id: r.text for r in docs.collect()}
    ids = {"b": 2, "a": 3, "c": 4}

    def model(rows):
        n = np.zeros((5, 5))
        for t in rows:
            i = [1, *[ids.get(w, 0) for w in (t or "").split()]]
            for x, y in zip(i, i[1:], strict=False):
                n[x, y] += 1
        u = (n.sum(0) + 0.5) / (n.sum(0) + 0.5).sum()
        return lambda x, y: -np.log((n[x, y] + 2 * u[y]) / (n[x].sum() + 2))

    for d, t in texts.items():
        target, background = model([texts[i] for i in {1} - {d}]), model([x for i, x in texts.items() if i not in (1, d)])
        i = [1, *[ids.get(w, 0) for w in (t or "").split()]]
        want = np.mean([target(x, y) - background(x, y) for x, y in zip(i, i[1:], strict=False)]) if len(i) > 1 else 0.0
        assert got[d].score == pytest.approx(want, abs=1e-5) and got[d].n_tokens == len(i) - 1


def test_cross_entropy_difference_of_every_word(spark):
    draw, common = random.Random(4), [f"c{i}" for i in range(20)]
    texts = {i: " ".join(draw.choice(common) if draw.random() < 0.3 else f"w{draw.randrange(4000)}" for _ in range(60)) for i in range(100)} | {100: None, 101: " "}
    target = set(range(0, 100, 3))
    docs = table(spark, [(i, t, "s") for i, t in texts.items()])
    got = {r.doc_id: r for r in lm_scoring.cross_entropy_difference(docs, spark.createDataFrame([(i,) for i in target], "x long")).collect()}
    size = len({w for t in texts.values() for w in (t or "").split()}) + 2
    assert size > 1500

    def model(ids):
        pairs, words, contexts = defaultdict(int), defaultdict(int), defaultdict(int)
        for i in ids:
            w = [None, *(texts[i] or "").split()]
            for x, y in zip(w, w[1:], strict=False):
                pairs[x, y] += 1
                words[y] += 1
                contexts[x] += 1
        total = sum(words.values())
        return lambda x, y: -np.log((pairs[x, y] + 64 * (words[y] + 0.5) / (total + 0.5 * size)) / (contexts[x] + 64))

    for i, t in texts.items():
        models = model(target - {i}), model(set(texts) - target - {i})
        w = [None, *(t or "").split()]
        want = [np.mean([m(x, y) for x, y in zip(w, w[1:], strict=False)]) if len(w) > 1 else 0.0 for m in models]
        assert (got[i].ce_target, got[i].ce_background) == pytest.approx(want, abs=1e-9)


def test_poisson_mix(spark):
    docs = table(spark, [(i, "t", "big" if i % 3 else "small") for i in range(6000)])
    out = mixing.poisson_mix(docs, {"small": 3.0}, seed=1)
    n = {r.source: r["count"] for r in out.groupBy("source").count().collect()}
    assert n["small"] / (n["small"] + n["big"]) == pytest.approx(0.75, abs=0.03) and sum(n.values()) == pytest.approx(6000, rel=0.05)
    assert set(out.columns) == {*docs.columns, "shuffle_key"}
    again = mixing.poisson_mix(docs.repartition(7), {"small": 3.0}, seed=1)
    assert {r.shuffle_key for r in out.collect()} == {r.shuffle_key for r in again.collect()}


def test_poisson_mix_edges(spark):
    docs = table(spark, ODD)
    out = mixing.poisson_mix(docs, {"a": 0.0}, epochs=2000.0)
    n = {r.source: r["count"] for r in out.groupBy("source").count().collect()}
    assert set(n) == {None, "b"} and n[None] == pytest.approx(8000, rel=0.1)
    assert mixing.poisson_mix(docs.limit(0), {}).count() == 0
    rates = spark.createDataFrame([("k", 900.0)], "key string, rate double")
    cdf = mixing.poisson_tables(rates).first().cdf
    assert cdf[-1] == pytest.approx(1, abs=1e-9) and cdf[900] == pytest.approx(0.5, abs=0.02)
