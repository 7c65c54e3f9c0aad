"""Chroma audio fingerprints: pitch-class frames, integral-image filters, packed integers, and alignment by offsets and bit errors.

Recordings are looked up by keys that survive noise: a quarter of an item's bits (four filters) at four places, TAPS apart. In each quarter
bits differ rarely enough that some places agree, where whole items hardly ever do. Each key that a query and a recording share votes
for the offset between its places; offsets with votes enough are decided by the share of differing bits.
"""

from collections.abc import Callable, Iterator
from functools import lru_cache
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tessera.llm.common import col, joined, saved

FRAME, HOP, WIDTH, FILTERS = 512, 128, 16, 16
#: Frames whose spectra are held at once.
BLOCK = 256
#: Logarithms of ratios that separate a filter's four levels.
LEVELS = np.array([-0.2, 0.0, 0.2])
#: Places of a key's items, from its first; bits of a quarter.
TAPS, QUARTER = (0, 4, 8, 12), 8
#: Items of queries that are looked up at a time, sent to every task; more queries take several passes. Recordings that a task looks up at a time.
ITEMS_A_PASS, RECORDINGS = 200_000, 500


@lru_cache
def pitch_classes(rate: int) -> tuple[int, np.ndarray]:
    """The first heard bin of a padded frame's spectrum, and the pitch class of each heard bin (60 to 1200 Hz) as rows of ones; (bins, 12)."""
    hertz = np.fft.rfftfreq(4 * FRAME, 1 / rate)
    heard = np.flatnonzero((hertz >= 60) & (hertz <= min(1200, rate / 2)))
    return int(heard[0]) if len(heard) else 0, np.eye(12, dtype=np.float32)[np.round(12 * np.log2(hertz[heard] / 440)).astype(int) % 12]


def chroma(pcm: bytes | None, rate: int) -> np.ndarray:
    """The energy of the twelve pitch classes in each frame of 16-bit little-endian samples, scaled to a sum of one; (frames, 12).

    Spectra are made of BLOCK frames at a time, so that memory beyond the samples and the result is bounded.
    """
    x = np.frombuffer(pcm or b"", dtype="<i2", count=len(pcm or b"") // 2)
    n = (len(x) - FRAME) // HOP + 1
    if n <= 0:
        return np.zeros((0, 12))
    first, classes = pitch_classes(rate)
    window, out = np.hanning(FRAME).astype(np.float32), np.zeros((n, 12))
    frames = np.lib.stride_tricks.sliding_window_view(x, FRAME)[::HOP]
    for at in range(0, n, BLOCK):
        spectrum = np.fft.rfft(frames[at : at + BLOCK] * window, 4 * FRAME)[:, first : first + len(classes)]
        out[at : at + BLOCK] = (spectrum.real**2 + spectrum.imag**2) @ classes
    return out / (out.sum(1, keepdims=True) + 1e-9)


def filters() -> list[tuple[np.ndarray, np.ndarray]]:
    """Pairs of areas, as corner lists of (first frame, first class, last frame, last class; ends exclusive), of filters of three kinds."""
    out = []
    for i in range(FILTERS):
        low, height = (5 * i) % 8, 2 + 2 * (i % 2)
        middle, top, half = low + height // 2, low + height, WIDTH // 2
        if i % 3 == 0:  # lower against upper classes
            pair = [(0, low, WIDTH, middle)], [(0, middle, WIDTH, top)]
        elif i % 3 == 1:  # earlier against later frames
            pair = [(0, low, half, top)], [(half, low, WIDTH, top)]
        else:  # two diagonals
            pair = [(0, low, half, middle), (half, middle, WIDTH, top)], [(0, middle, half, top), (half, low, WIDTH, middle)]
        out.append(tuple(map(np.array, pair)))
    return out


@lru_cache
def corner_weights() -> tuple[list[int], np.ndarray]:
    """The frames at which areas begin or end, and the signs with which the integral's values there add up to areas.

    (frames * 13, 2 * FILTERS): the first area of each filter, then the second ones.
    """
    sides = [pair[side] for side in (0, 1) for pair in filters()]
    at = sorted({int(f) for areas in sides for a, _, d, _ in areas for f in (a, d)})
    out = np.zeros((len(at), 13, len(sides)))
    for k, areas in enumerate(sides):
        for a, b, d, e in areas:
            for frame, pitch, sign in ((d, e, 1), (a, e, -1), (d, b, -1), (a, b, 1)):
                out[at.index(frame), pitch, k] += sign
    return at, out.reshape(-1, len(sides))


def fingerprint(pcm: bytes | None, rate: int) -> np.ndarray:
    """A 32-bit integer for each run of WIDTH frames: two bits (a Gray code of four levels) from each filter."""
    c = chroma(pcm, rate)
    n = len(c) - WIDTH + 1
    if n <= 0:
        return np.zeros(0, dtype=np.int32)
    integral = np.zeros((len(c) + 1, 13))
    integral[1:, 1:] = c.cumsum(0).cumsum(1)
    at, weights = corner_weights()
    areas = np.hstack([integral[f : f + n] for f in at]) @ weights + 1e-2
    level = np.searchsorted(LEVELS, np.log(areas[:, :FILTERS] / areas[:, FILTERS:]), side="right").astype(np.uint32)
    places = np.arange(2 * FILTERS - 2, -1, -2, dtype=np.uint32)
    return np.bitwise_or.reduce((level ^ level >> np.uint32(1)) << places, axis=1).view(np.int32)


def fingerprints(recordings: DataFrame, rate: int, id_col: str = "id", pcm_col: str = "pcm", decode: Callable[[Any], bytes | None] | None = None) -> DataFrame:
    """For each row: its id and items, the fingerprint of its whole recording; null and short recordings have none.

    decode: makes 16-bit samples of one stored value, so that decoded sound never leaves the task, nor is held for more than one row.
    """
    rows = recordings.select(col(id_col).alias("id"), col(pcm_col).alias("pcm"))
    schema = T.StructType([T.StructField("id", rows.schema["id"].dataType), T.StructField("items", T.ArrayType(T.IntegerType()))])

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            items = [fingerprint(decode(p) if decode else p, rate) for p in b["pcm"].to_pylist()]
            yield pa.RecordBatch.from_arrays([b["id"], pa.array(items, pa.list_(pa.int32()))], schema=to_arrow_schema(schema))

    return rows.mapInArrow(made, schema)


def keys(items: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The keys of a fingerprint and their places. Of equal keys of a quarter in a row, as a sustained sound has, the first counts."""
    n = len(items) - TAPS[-1]
    if n <= 0:
        return np.empty(0, dtype=np.uint64), np.empty(0, dtype=np.int64)
    u, out, at = items.view(np.uint32).astype(np.uint64), [], []
    for quarter in range(32 // QUARTER):
        own = np.full(n, quarter, dtype=np.uint64)
        for tap in TAPS:
            own = own << np.uint64(QUARTER) | (u[tap : tap + n] >> np.uint64(QUARTER * quarter) & np.uint64(2**QUARTER - 1))
        starts = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
        out.append(own[starts])
        at.append(starts)
    return np.concatenate(out), np.concatenate(at)


def bit_error(a: np.ndarray, b: np.ndarray, start: int) -> tuple[int, float]:
    """The items that overlap if a begins at place `start` of b, and the share of their bits that differ."""
    a, b = a[max(-start, 0) :], b[max(start, 0) :]
    n = min(len(a), len(b))
    return n, float(np.bitwise_count((a[:n] ^ b[:n]).view(np.uint32)).sum()) / (32 * n) if n else 1.0


class Queries:
    """The queries of a pass: their names and items, and an index of their keys."""

    def __init__(self, names: list[int], items: list[np.ndarray]):
        self.names, self.items = names, items
        found = [keys(x) for x in items]
        owner = np.repeat(np.arange(len(items)), [len(k) for k, _ in found])
        every, at = (np.concatenate([np.empty(0, dtype=t), *x]) for t, x in ((np.uint64, [k for k, _ in found]), (np.int64, [p for _, p in found])))
        order = np.argsort(every, kind="stable")
        self.keys, self.owner, self.at = every[order], owner[order], at[order]

    def matches(self, recordings: list[np.ndarray], min_votes: int, max_bit_error: float, min_overlap: int) -> Iterator[tuple[int, int, int, int, float]]:
        """(query, recording, start, votes, bit error) of each pair of positions that aligns, at its start with the least bit error."""
        found = [keys(x) for x in recordings]
        owner = np.repeat(np.arange(len(found)), [len(k) for k, _ in found])
        every, at = (np.concatenate([np.empty(0, dtype=t), *x]) for t, x in ((np.uint64, [k for k, _ in found]), (np.int64, [p for _, p in found])))
        low, high = np.searchsorted(self.keys, every, "left"), np.searchsorted(self.keys, every, "right")
        # Recordings are taken in runs of some million votes, so that a key which very many have costs time, not memory.
        upto, r = np.cumsum([0, *np.bincount(owner, high - low, minlength=len(found)).astype(np.int64)]), 0
        while r < len(found):
            end = max(r + 1, int(np.searchsorted(upto, upto[r] + 4_000_000, "right")) - 1)
            a, b = np.searchsorted(owner, [r, end])
            n = high[a:b] - low[a:b]
            place = np.repeat(low[a:b] - np.cumsum(n) + n, n) + np.arange(n.sum())
            votes = np.stack([np.repeat(owner[a:b], n), self.owner[place], np.repeat(at[a:b], n) - self.at[place]])
            order = np.lexsort(votes[::-1])
            votes = votes[:, order]
            cuts = np.flatnonzero(np.concatenate([[True], (votes[:, 1:] != votes[:, :-1]).any(0), [True]])) if votes.shape[1] else np.zeros(1, dtype=np.int64)
            counts, firsts = np.diff(cuts), cuts[:-1]
            best: dict[tuple[int, int], tuple] = {}
            for i in np.flatnonzero(counts >= min_votes).tolist():
                recording, query, start = votes[:, firsts[i]].tolist()
                overlap, error = bit_error(self.items[query], recordings[recording], start)
                if overlap >= min_overlap and error <= max_bit_error:
                    tried = (error, -int(counts[i]), start)
                    best[query, recording] = min(best.get((query, recording), tried), tried)
            for (query, recording), (error, votes_of, start) in best.items():
                yield query, recording, start, -votes_of, error
            r = end


def align(prints: DataFrame, is_query: Column, min_votes: int = 2, max_bit_error: float = 0.15, min_overlap: int = 16) -> DataFrame:
    """Aligns recordings (id, items): the queries, by is_query over id, with all others.

    Recordings with equal fingerprints are a class, named by its least id. Returns one row for each recording (id, class_id, n_items,
    the other columns null), and one for each class that has a query and each other class that aligns with it: class_id, match_class_id,
    start (the item of the match that meets the class's first, negative if it begins later), votes (the keys that agree at that start)
    and bit_error (the share of differing bits where they overlap); id is null there. Two classes align if at a start with min_votes
    their overlap is min_overlap items or more and the bit error at most max_bit_error; of such starts, the one with the least
    bit error counts, then that with most votes, then the least.

    Queries are sent out in passes of ITEMS_A_PASS items; each task looks its recordings up in the pass's keys, and nothing is shuffled.

    Edge cases: recordings without items form no class (class_id null) and match nothing, nor do those of fewer than min_overlap
    items; repeated rows are of one class; null ids are members, and name a class only if all its ids are null; an empty table
    gives an empty table.
    """
    named = saved(prints.select("id", "items", F.when(F.size("items") > 0, F.xxhash64("items", F.size("items"))).alias("key"), F.coalesce(is_query, F.lit(False)).alias("asks")), "prints")
    classes = saved(named.filter("key is not null").groupBy("key").agg(F.min("id").alias("class_id"), F.first("items").alias("items"), F.max("asks").alias("asks")), "classes")
    asked = classes.filter("asks").select("key", "items")
    passes = max(1, -(-(asked.agg(F.sum(F.size("items"))).first()[0] or 0) // ITEMS_A_PASS))
    spark, found = prints.sparkSession, None
    for i in range(passes):
        part = asked.filter(F.pmod(F.xxhash64("key"), F.lit(passes)) == i).collect()
        sent = spark.sparkContext.broadcast(Queries([r.key for r in part], [np.array(r["items"], dtype=np.int32) for r in part]))

        def looked_up(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            queries, names = sent.value, ["q", "r", "start", "votes", "bit_error"]
            types = pa.schema([(x, t) for x, t in zip(names, (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.float64()), strict=True)])
            for b in batches:
                for at in range(0, b.num_rows, RECORDINGS):
                    cut = b.slice(at, RECORDINGS)
                    own, items = cut["key"].to_pylist(), [x.values.to_numpy() for x in cut["items"]]
                    rows = [(queries.names[q], own[r], start, votes, error) for q, r, start, votes, error in queries.matches(items, min_votes, max_bit_error, min_overlap) if queries.names[q] != own[r]]
                    yield pa.RecordBatch.from_pylist([dict(zip(names, row, strict=True)) for row in rows], schema=types)

        one = classes.select("key", "items").mapInArrow(looked_up, "q long, r long, start int, votes long, bit_error double")
        found = one if found is None else found.unionAll(one)
    found = saved(found, "found")
    q, r = (classes.select(F.col("key").alias(c), F.col("class_id").alias(f"{c}_class"), F.size("items").alias(f"{c}_items")) for c in "qr")
    matches = found.join(q, "q").join(r.drop("r_items"), "r")
    id_type = dict(prints.dtypes)["id"]
    nothing = [F.lit(None).cast(t).alias(c) for c, t in (("match_class_id", id_type), ("start", "int"), ("votes", "long"), ("bit_error", "double"))]
    members = joined(named.select("id", "items", "key").filter("key is not null"), classes.select("key", "class_id"), ["key"]).select("id", "class_id", F.size("items").alias("n_items"), *nothing)
    silent = named.filter("key is null").select("id", F.lit(None).cast(id_type).alias("class_id"), F.size("items").alias("n_items"), *nothing)
    return members.unionAll(silent).unionAll(matches.select(F.lit(None).cast(id_type).alias("id"), F.col("q_class").alias("class_id"), F.col("q_items").alias("n_items"), F.col("r_class").alias("match_class_id"), "start", "votes", "bit_error"))
