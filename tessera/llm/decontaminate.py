"""Benchmark decontamination: windows of each item's size, SimHash, multi-index Hamming search and exact weighted-shingle similarity.

A window that is similar enough shares shingles with its item, wherever in either they stand. So every start is looked at whose window
holds a shingle of an item of that size, and those are kept whose shingles that items of the size hold too weigh enough for any of them,
which loses none. Sums over the windows are carried from one start to the next. The SimHash of what is kept is looked up in an index of the items' fingerprints, cut into one more
block than the radius has bits: a fingerprint within the radius agrees in a block at least. Items within the radius are then verified by
the weighted Jaccard similarity of shingles; a shingle weighs as many bytes as its words have.
"""

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tessera.llm.common import col, fresh
from tessera.llm.shingles import shingle_hashes, words

#: Items that are broadcast at a time; larger benchmarks take several passes.
ITEMS_A_PASS = 20_000
#: Starts of windows whose sums are made at a time.
STARTS = 4096
_BITS = np.arange(64, dtype=np.uint64)


def weighted(w: list[bytes], k: int) -> dict[int, int]:
    """The weights of the distinct shingles of k words."""
    sizes = np.concatenate([[0], np.cumsum([len(x) for x in w])])
    return dict(zip(shingle_hashes(w, k).tolist(), (sizes[k:] - sizes[:-k]).tolist(), strict=True))


def simhash(shingles: dict[int, int]) -> int:
    """64 bits: each the sign of the sum of the weights of the shingles whose hash has it, less those whose hash hasn't."""
    h, w = np.array(list(shingles), dtype=np.uint64), np.array(list(shingles.values()), dtype=np.int64)
    signs = ((h[:, None] >> _BITS) & np.uint64(1)).astype(np.int64) * 2 - 1
    return int((((signs * w[:, None]).sum(0) > 0).astype(np.uint64) << _BITS).sum())


def similarity(a: dict[int, int], b: dict[int, int]) -> float:
    """The weight of the common shingles over that of all."""
    common = sum(a[h] for h in a.keys() & b.keys())
    return common / (sum(a.values()) + sum(b.values()) - common)


def window_sums(values: np.ndarray, previous: np.ndarray, size: int, first: int, last: int) -> np.ndarray:
    """For each start from `first` to `last`, the sum of `values` of the distinct shingles among the `size` (or fewer, at the end) from it on.

    previous: the place of the same shingle's occurrence before, -1 without one. A shingle counts where it first occurs in a window:
    it is added at one start and taken off at another, whatever the windows' size.
    """
    end = min(last + size, len(values))
    place, added = np.arange(first, end), np.maximum(previous[first:end], np.arange(first, end) - size) + 1
    change = np.zeros((end - first + 1, *values.shape[1:]), dtype=np.int64)
    np.add.at(change, np.maximum(added - first, 0), values[first:end])
    change[place - first + 1] -= values[first:end]
    return change.cumsum(0)[: last - first + 1]


class HammingIndex:
    """Fingerprints by blocks of their bits, one more than the radius: a search finds all within the radius.

    Up to a radius of 20 blocks have three or four bits, and most fingerprints agree in one of them; the sums that a window must reach
    before it is looked up are what keeps searches few.
    """

    def __init__(self, fingerprints: list[int], radius: int):
        self.fingerprints, self.radius = np.array(fingerprints, dtype=np.uint64), radius
        cuts = [round(i * 64 / (radius + 1)) for i in range(radius + 2)]
        self.blocks = []
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            own = (self.fingerprints >> np.uint64(a) & np.uint64((1 << b - a) - 1)).astype(np.int64)
            self.blocks.append((a, (1 << b - a) - 1, {int(v): np.flatnonzero(own == v) for v in np.unique(own)}))

    def within(self, f: int) -> list[tuple[int, int]]:
        """(position, distance) of the fingerprints at most radius bits from f."""
        agrees = np.zeros(len(self.fingerprints), dtype=bool)
        for shift, mask, held in self.blocks:
            agrees[held.get(f >> shift & mask, [])] = True
        near = np.flatnonzero(agrees)
        distances = np.bitwise_count(self.fingerprints[near] ^ np.uint64(f))
        return [(int(i), int(d)) for i, d in zip(near, distances, strict=True) if d <= self.radius]


class Benchmark:
    """The items of a pass, ready to be searched. Items without words never match; of fewer than k words, the whole item is one shingle."""

    def __init__(self, items: list[tuple], k: int, radius: int, least: float):
        self.least = least
        self.places: dict[int, dict[int, set[int]]] = {}
        by_size: dict[int, list[tuple]] = defaultdict(list)
        for item_id, text in items:
            if w := words(text):
                size, own = min(k, len(w)), shingle_hashes(words(text), k)
                shingles = weighted(w, size)
                by_size[len(w)].append((item_id, shingles, simhash(shingles)))
                held = self.places.setdefault(size, defaultdict(set))
                for h in own.tolist():
                    held[h].add(len(w))
        self.items = {n: [x[:2] for x in same] for n, same in by_size.items()}
        self.lightest = {n: min(sum(x[1].values()) for x in same) for n, same in by_size.items()}
        self.indexes = {n: HammingIndex([x[2] for x in same], radius) for n, same in by_size.items()}
        self.tables = {}
        for size, held in self.places.items():
            table = np.zeros(1 << 20, dtype=bool)
            table[np.array([h >> 44 for h in held], dtype=np.int64)] = True
            self.tables[size] = table

    def windows(self, h: np.ndarray, weights: np.ndarray, previous: np.ndarray, size: int, places: np.ndarray, least: float) -> Iterator[tuple[int, int]]:
        """(start, SimHash) of the windows of `size` shingles in which those at `places` weigh `least`, and enough of the window's own weight."""
        if weights[places].sum() < least * (1 - 1e-9):
            return
        shared = np.zeros(len(h), dtype=np.int64)
        shared[places] = weights[places]
        # Runs of starts that no window joins are looked at apart, so that the time follows the windows that hold a shared shingle.
        for run in np.split(places, np.flatnonzero(np.diff(places) >= size) + 1):
            for first in range(max(int(run[0]) - size + 1, 0), int(run[-1]) + 1, STARTS):
                last = min(first + STARTS - 1, int(run[-1]))
                common, total = (window_sums(x, previous, size, first, last) for x in (shared, weights))
                kept = first + np.flatnonzero((common > 0) & (common >= (1 - 1e-9) * np.maximum(least, self.least * total)))
                if len(kept) == 0:
                    continue
                a, b = int(kept[0]), int(kept[-1])
                signs = ((h[a : b + size, None] >> _BITS) & np.uint64(1)).astype(np.int64) * 2 - 1
                end = a + len(signs)
                sums = window_sums(signs * weights[a:end, None], previous[a:end] - a, size, 0, b - a)[kept - a]
                yield from zip(kept.tolist(), ((sums > 0).astype(np.uint64) << _BITS).sum(1).tolist(), strict=True)

    def matches(self, text: str | None) -> list[tuple]:
        """(item id, first word, words, distance, similarity) of each window that is similar enough to an item; the best window of each item."""
        w, best = words(text), {}
        for size, held in self.places.items():
            if len(w) < size:
                continue
            h = shingle_hashes(w, size)
            hits = defaultdict(list)
            for p in np.flatnonzero(self.tables[size][(h >> np.uint64(44)).astype(np.int64)]).tolist():
                for n in held.get(int(h[p]), ()):
                    hits[n].append(p)
            if not hits:
                continue
            sizes = np.concatenate([[0], np.cumsum([len(x) for x in w])])
            weights = sizes[size:] - sizes[:-size]
            order = np.argsort(h, kind="stable")
            previous = np.full(len(h), -1)
            same = h[order[1:]] == h[order[:-1]]
            previous[order[1:][same]] = order[:-1][same]
            for n, places in hits.items():
                for start, fingerprint in self.windows(h, weights, previous, n - size + 1, np.array(places), self.least * self.lightest[n]):
                    near = self.indexes[n].within(fingerprint)
                    shingles = weighted(w[start : start + n], size) if near else {}
                    for i, distance in near:
                        item_id, own = self.items[n][i]
                        s = similarity(shingles, own)
                        if s >= self.least and (item_id not in best or (-s, start) < best[item_id][0]):
                            best[item_id] = ((-s, start), (item_id, start, min(n, len(w) - start), distance, s))
        return [x for _, x in best.values()]


def find_contamination(docs: DataFrame, benchmark: DataFrame, k: int = 5, radius: int = 20, least: float = 0.8, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """For each row of `docs` and each item that it holds: doc id, item id, first_word, n_words, distance (bits) and similarity.

    Benchmarks of over ITEMS_A_PASS items are searched in passes over the documents, so that what is broadcast stays small.

    Edge cases: null and empty texts and items match nothing; repeated rows match each; items with equal texts match alike; null ids
    are kept; whole texts are searched, however long; empty tables give an empty table; other columns are ignored.
    """
    spark = docs.sparkSession
    rows = docs.select(col(id_col).alias("id"), col(text_col).cast("string").alias("text"))
    items = benchmark.select(col(item_col).alias("item"), col(item_text_col).cast("string").alias("text"))
    schema = T.StructType([T.StructField(id_col, rows.schema["id"].dataType), T.StructField(item_col, items.schema["item"].dataType), *(T.StructField(c, t) for c, t in (("first_word", T.LongType()), ("n_words", T.LongType()), ("distance", T.IntegerType()), ("similarity", T.DoubleType())))])
    passes = max(1, -(-items.count() // ITEMS_A_PASS))
    out = None
    for i in range(passes):
        part = items.filter(F.pmod(F.xxhash64("text"), F.lit(passes)) == i).collect()
        sent = spark.sparkContext.broadcast(Benchmark([tuple(r) for r in part], k, radius, least))

        def searched(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            types = to_arrow_schema(schema)
            for b in batches:
                found = [(d, *m) for d, t in zip(b["id"].to_pylist(), b["text"].to_pylist(), strict=True) for m in sent.value.matches(t)]
                yield pa.RecordBatch.from_pylist([dict(zip(types.names, f, strict=True)) for f in found], schema=types)

        found = rows.mapInArrow(searched, schema)
        out = found if out is None else out.unionAll(found)
    return out


def _clean(sent: Broadcast):
    @F.pandas_udf("boolean")
    def clean(text: pd.Series) -> pd.Series:
        return pd.Series([not sent.value.matches(t) for t in text], dtype=bool)

    return clean


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, k: int = 5, radius: int = 20, least: float = 0.8, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """The rows of `docs` that hold no item, with the columns of `docs`; rules as for find_contamination()."""
    items = benchmark.select(col(item_col).alias("item"), col(item_text_col).cast("string").alias("text"))
    passes = max(1, -(-items.count() // ITEMS_A_PASS))
    for i in range(passes):
        part = items.filter(F.pmod(F.xxhash64("text"), F.lit(passes)) == i).collect()
        sent = docs.sparkSession.sparkContext.broadcast(Benchmark([tuple(r) for r in part], k, radius, least))

        mark = fresh(docs, "clean")
        docs = docs.withColumn(mark, _clean(sent)(col(text_col).cast("string"))).filter(col(mark)).drop(mark)
    return docs
