"""Operators on recordings, URLs and dialogues."""

import numpy as np
from pyspark.sql import functions as F

from tessera.llm import audio, chat, queries, url_filter

RATE = 2400


def tune(notes, noise=0.0, seed=0):
    t = np.arange(RATE // 4) / RATE
    x = np.concatenate([np.sin(2 * np.pi * 440 * 2 ** (n / 12) * t) for n in notes]) + noise * np.random.default_rng(seed).normal(size=len(notes) * len(t))
    return (x * 8000).astype("<i2").tobytes()


def test_recordings_align(spark):
    draw = np.random.default_rng(4)
    a, b, c = (draw.integers(-18, 6, 24) for _ in range(3))
    rows = [(20, tune(a)), (3, tune(a)), (4, tune(np.concatenate([c[:8], a]), 0.01)), (5, tune(b)), (6, None), (7, b""), (None, tune(b)), (40, tune([0] * 24))]
    prints = audio.fingerprints(spark.createDataFrame(rows, "id long, pcm binary"), RATE)
    out = audio.align(prints, F.col("id") % 20 == 0).collect()
    members = {r.id: r.class_id for r in out if r.match_class_id is None}
    assert members == {20: 3, 3: 3, 4: 4, 5: 5, 6: None, 7: None, None: 5, 40: 40}
    (found,) = [r for r in out if r.match_class_id is not None]
    lag = 8 * (RATE // 4) / audio.HOP
    assert (found.class_id, found.match_class_id) == (3, 4) and abs(found.start - lag) <= 1 and found.bit_error < 0.15
    assert audio.align(prints.limit(0), F.col("id") % 20 == 0).count() == 0


def test_alignment_takes_items_of_any_value(spark):
    draw = np.random.default_rng(7)
    items = [-(2**31), -(2**31), 2**31 - 1, -1, *map(int, draw.integers(-(2**31), 2**31, 30))]
    prints = spark.createDataFrame([(20, items), (21, items[5:]), (22, [5] * 40)], "id long, items array<int>")
    (found,) = audio.align(prints, F.col("id") % 20 == 0).filter("match_class_id is not null").collect()
    assert (found.class_id, found.match_class_id, found.start, found.bit_error) == (20, 21, -5, 0.0) and found.votes >= 40


def test_alignment_of_sustained_sounds_and_ids_of_any_size(spark):
    rows = [(2**55 * 20, [5] * 40), (2**60 + 3, [5] * 60), (None, [7] * 40), (None, [5] * 5)]
    out = audio.align(spark.createDataFrame(rows, "id long, items array<int>"), F.col("id") % 20 == 0).collect()
    assert {(r.id, r.class_id) for r in out if r.start is None} == {(2**55 * 20, 2**55 * 20), (2**60 + 3, 2**60 + 3), (None, None)}
    # One bit of 5 and 7 differs.
    assert {(r.class_id, r.match_class_id, r.start, r.bit_error) for r in out if r.start is not None} == {(2**55 * 20, 2**60 + 3, 0, 0.0), (2**55 * 20, None, 0, 1 / 32)}


def test_alignment_recall_against_brute_force(spark, sf_dir, monkeypatch):
    """All pairs and starts by bit error, on recordings with noise and other beginnings."""
    monkeypatch.setattr(audio, "ITEMS_A_PASS", 300)
    vectors = [np.array(r.embedding) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").orderBy("vec_id").limit(40).collect()]
    draw, rows = np.random.default_rng(3), []
    for i, v in enumerate(vectors):
        sound = np.frombuffer(queries.melody(v), dtype="<i2").astype(float)
        rows.append((20 * i, sound.astype("<i2").tobytes()))
        for j, noise in enumerate((0, 1000, 3000)):
            noisy = np.concatenate([np.zeros(int(draw.integers(0, 500))), sound])
            rows.append((20 * i + j + 1, np.clip(noisy + noise * draw.normal(size=len(noisy)), -32768, 32767).astype("<i2").tobytes()))
    prints = {i: audio.fingerprint(x, queries.RATE) for i, x in rows}
    wanted = {}
    for q in range(0, 800, 20):
        for r, b in prints.items():
            tried = [(e, s) for s in range(-len(prints[q]) + 16, len(b) - 15) for n, e in [audio.bit_error(prints[q], b, s)] if n >= 16 and e <= 0.15]
            if r != q and tried:
                wanted[q, r] = min(tried)
    out = audio.align(audio.fingerprints(spark.createDataFrame(rows, "id long, pcm binary"), queries.RATE), F.col("id") % 20 == 0).filter("start is not null").collect()
    found = {(r.class_id, r.match_class_id): (r.bit_error, r.start) for r in out}
    assert len(wanted) > 100 and set(found) <= set(wanted) and len(found) >= 0.95 * len(wanted)
    assert np.mean([found[k][0] == wanted[k][0] for k in found]) > 0.95


def test_areas_match_plain_sums():
    c = np.random.default_rng(1).random((30, 12))
    integral = np.zeros((31, 13))
    integral[1:, 1:] = c.cumsum(0).cumsum(1)
    for x, y in audio.filters():
        for a, b, d, e in [*x, *y]:
            assert e <= 12 and np.isclose(integral[3 + d, e] - integral[3 + a, e] - integral[3 + d, b] + integral[3 + a, b], c[3 + a : 3 + d, b:e].sum())


def brute_rule(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    cut = min([rest.find(x) for x in "/?#" if x in rest], default=len(rest))
    host, path = rest[:cut], rest[cut:].split("?")[0].split("#")[0]
    host = "".join(x.lower() if "A" <= x <= "Z" else x for x in host)
    fits = [(r, v) for r, v in queries.URL_RULES for h, p in [r.split("/", 1)] if (host == h or host.endswith("." + h)) and path.startswith("/" + p)]
    return (host, path, *max(fits, key=lambda x: len(x[0]), default=(None, None)))


def test_url_rules(spark):
    urls = ["http://WWW.Example.com/en/x?y", "https://example.com/en/", "https://example.com/en", "http://a.net/fr/1#z", "http://a.net?x=/es/", "no scheme", None, "", "x://", "http://com/", "http://É.com/É",
            "http://com", "http://notexample.com/en/", "ftp://u@h.org:1/p://q", "http://a.net/es/" + "x" * 20_000, "http://a.org/1", "http://a.org/1"]
    pages = spark.createDataFrame([(i, u, 1, "r") for i, u in enumerate(urls)], "page_id long, url string, rest int, rule string")
    got = {r.page_id: r for r in url_filter.filter_urls(pages, queries.URL_RULES).collect()}
    assert len(got) == len(urls)
    for i, u in enumerate(urls):
        host, path, rule, verdict = brute_rule(u)
        assert (got[i].host, got[i].path, got[i].rule) == (host, path, rule)
        assert got[i].verdict in ("allow", "block") and (verdict is None or got[i].verdict == verdict)
    assert url_filter.filter_urls(pages.limit(0), queries.URL_RULES).count() == 0


def test_gram_ratios_brute_force(spark):
    accepted, rejected = ["abcab", "abd"], ["xyx", "abx"]
    order, counts = url_filter.ORDER, {}
    for k, urls in enumerate((accepted, rejected)):
        for u in urls:
            s = url_filter.BEGIN + u + url_filter.END
            for i in range(len(s) - order + 1):
                counts.setdefault(s[i : i + order], [0, 0])[k] += 1

    def probability(g, k):
        table = {}
        for x, n in counts.items():
            for j in range(1, order + 1):
                table.setdefault(x[-j:], 0)
                table[x[-j:]] += n[k]
        singles = {x: n for x, n in table.items() if len(x) == 1}
        seen = sum(n > 0 for n in singles.values())
        p = (singles.get(g[-1], 0) + (seen + 1) / 256) / (sum(singles.values()) + seen + 1)
        for j in range(2, order + 1):
            after = {x: n for x, n in table.items() if len(x) == j and x[:-1] == g[-j:-1]}
            if n := sum(after.values()):
                t = sum(x > 0 for x in after.values())
                p = (table.get(g[-j:], 0) + t * p) / (n + t)
        return p

    table = spark.createDataFrame([(g, *n) for g, n in counts.items()], "g string, a long, r long")
    wanted = spark.createDataFrame([(g,) for g in [*counts, "^^^z", "bcaq"]], "g string")
    for r in url_filter.gram_ratios(table, wanted).collect():
        assert np.isclose(r.ratio, np.log(probability(r.g, 0) / probability(r.g, 1)))


def test_perspectives(spark):
    rows = [(1, 0, "system", "rules"), (1, 1, "ann", "hi <|im_end|>"), (1, 2, "bob", "yo"), (1, 3, "ann", None), (2, 0, "system", "alone"), (None, None, None, "x"), (3, 300, "ann", "late"), (3, 1, "bob", "soon"), (3, 1, "bob", "soon")]
    turns = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, participant int")
    out = {(r.conv_id, r.participant, r.segment): r for r in chat.rotate_perspectives(turns).collect()}
    assert set(out) == {(1, "ann", 0), (1, "bob", 0), (None, "unknown", 0), (3, "ann", 0), (3, "bob", 0)}
    ann = out[1, "ann", 0]
    assert ann.rendered == "<|im_start|>system\nrules<|im_end|>\n<|im_start|>assistant\nhi < |im_end|><|im_end|>\n<|im_start|>user name=bob\nyo<|im_end|>\n<|im_start|>assistant\n<|im_end|>\n"
    assert [ann.rendered[int(a) : int(b)] for a, b in (s.split(":") for s in ann.mask_spans.split(","))] == ["hi < |im_end|><|im_end|>\n", "<|im_end|>\n"]
    assert out[3, "ann", 0].n_trained == 1 and out[3, "bob", 0].n_trained == 2
    assert chat.rotate_perspectives(turns.limit(0)).count() == 0


def test_long_conversations(spark):
    rows = [(1, 0, "system", "rules"), *[(1, 100 + i, ("ann", "bob")[i % 2], f"m{i}") for i in range(999)], *[(2, 250 + i, "cat", str(i)) for i in range(10)], *[(None, None, "dot", f"{i:02}") for i in range(7)]]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    whole = {(r.conv_id, r.participant): r for r in chat.rotate_perspectives(turns).collect()}
    assert set(whole) == {(1, "ann"), (1, "bob"), (2, "cat"), (None, "dot")} and whole[1, "ann"].n_messages == 1000
    cut = {(r.conv_id, r.participant, r.segment): r for r in chat.rotate_perspectives(turns, messages_per_segment=6).collect()}
    for conv, who in whole:
        own = [(x[2], x[3]) for x in rows if x[0] == conv]
        parts = [own[i : i + 6] for i in range(0, len(own), 6)]
        assert sum(k[:2] == (conv, who) for k in cut) == len(parts)
        for i, part in enumerate(parts):
            part = [m for m in own if m[0] == "system"] * (i > 0) + part
            got = cut[conv, who, i]
            assert got.n_messages == len(part) and got.n_trained == sum(r == who for r, _ in part)
            assert got.rendered == "".join(f"<|im_start|>{'assistant' if r == who else 'system' if r == 'system' else 'user name=' + r}\n{t}<|im_end|>\n" for r, t in part)
