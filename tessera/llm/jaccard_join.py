"""N-gram Jaccard join: documents whose sets of word shingles have a Jaccard similarity of 0.8 or more, their components and links.

1. Texts are shingled twice. The first time names and measures the sets: documents with equal sets are one node, and a sketch of fixed
   size counts all shingles, so that each node's shingles can be put in one order, rare before frequent. The second time sends each
   set's first shingles (its prefix) in that order. Two sets that link share one of these, whatever the order is: the sketch decides
   nothing but the size of groups. The sorted arrays, larger than the texts, are not kept: steps 2 to 4 shingle the few texts again
   whose sets they compare, one a node, found by a hash of the text.
2. Nodes that share a prefix shingle are a group. Every node is compared with two members of each of its groups, which costs little
   and joins nearly all that belongs together; components of those links follow.
3. Groups with the same least member are taken as one, so that nodes that share many shingles meet once. Where such a group still holds
   several components, its nodes are laid out in tiles by size band and block, and all pairs of different components are compared. So every
   link is found or lies within one component, and no group, however large, emits its pairs.
4. The nodes of each component are laid out in tiles again, with their arrays, and each tile counts its links by node.

Each comparison first bounds the overlap from above: the bit counts of hashed bitmap signatures, XORed, bound the symmetric difference from
below. Pairs that may link are decided by the exact intersection of their sorted arrays.
"""

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tessera.llm.common import arrow_batches, col, dropped, joined, same_again, saved, shuffles_deleted, small
from tessera.llm.components import connected_components
from tessera.llm.shingles import shingle_set

#: The sketch's counters, in so many chunks.
SLOT_BITS, CHUNKS = 22, 64
#: Nodes of a token that the sketch shows as hot are dealt into parts of so many; steps of the sketch's scale in a doubling.
SALT_ROWS, STEPS = 20_000, 8
#: Bits of the filter of texts: 64 a text, within these powers of two.
FILTER_BITS = (20, 28)
#: Members that one hub is compared with in a task; rows and shingles of a tile's block.
HUB_CHUNK, TILE_ROWS, TILE_SHINGLES = 64, 512, 1_000_000
#: Up to so many ids of copies are broadcast, 8 bytes each; beyond, they are joined by shuffle.
BROADCAST_IDS = 2_000_000
#: Texts or arrays that a task is handed at a time.
BATCH_ROWS = 500
GONE = "near_duplicate_of_"


def linked(shared: int | np.ndarray, n: int | np.ndarray, m: int | np.ndarray):
    """Whether sets of n and m shingles, `shared` of them in common, link: 100 shared >= 80 (n + m - shared)."""
    return 100 * shared >= 80 * (n + m - shared)


def sizes_fit(n, m):
    """Whether sets of these sizes can link at all."""
    return (10 * n >= 8 * m) & (10 * m >= 8 * n)


def prefix_length(n: int) -> int:
    """So many of a set's n shingles, in any common order, include one of any set that links with it."""
    return n - (4 * n + 4) // 5 + 1


def signature(h: np.ndarray) -> bytes:
    """The parities of the shingles in each of b hash classes, b the least power of two that is 2 n and 64 at least: b / 8 bytes."""
    b = 1 << max(6, int(2 * len(h) - 1).bit_length())
    return np.packbits((np.bincount((h & np.uint64(b - 1)).astype(np.int64), minlength=b) & 1).astype(np.uint8)).tobytes()


def folded(bits: np.ndarray, size: int) -> np.ndarray:
    """A signature, by bytes, made as short as `size` bytes: parities of classes modulo a smaller power of two."""
    while len(bits) > size:
        bits = bits[: len(bits) // 2] ^ bits[len(bits) // 2 :]
    return bits


def difference_at_least(x: bytes, y: bytes) -> int:
    """A lower bound of the symmetric difference of the sets of two signatures."""
    a, b = np.frombuffer(x, dtype=np.uint8), np.frombuffer(y, dtype=np.uint8)
    size = min(len(a), len(b))
    return int(np.bitwise_count(folded(a, size) ^ folded(b, size)).sum())


def may_link(x: bytes, y: bytes, n: int, m: int) -> bool:
    """By the upper bound of the overlap that the signatures give."""
    return bool(linked((n + m - difference_at_least(x, y)) // 2, n, m))


def packed(h: np.ndarray) -> bytes:
    """Sorted hashes by their 48 upper bits."""
    return h.astype("<u8").view(np.uint8).reshape(-1, 8)[:, 2:].tobytes()


def unpacked(b: bytes) -> np.ndarray:
    out = np.zeros((len(b) // 6, 8), dtype=np.uint8)
    out[:, 2:] = np.frombuffer(b, dtype=np.uint8).reshape(-1, 6)
    return out.view("<u8").ravel()


def node_of(h: np.ndarray) -> int:
    """A 64-bit name of a set."""
    return int(np.array(xxhash.xxh3_64_intdigest(h.tobytes()), dtype=np.uint64).astype(np.int64))


def packed_counts(n: np.ndarray) -> bytes:
    """Counts below 2 ** 32: a byte each, then four bytes for each that is 255 or more; compressed."""
    return zstandard.compress(np.minimum(n, 255).astype(np.uint8).tobytes() + n[n >= 255].astype("<u4").tobytes(), 1)


def unpacked_counts(b: bytes) -> np.ndarray:
    size, raw = (1 << SLOT_BITS) // CHUNKS, zstandard.decompress(b)
    n = np.frombuffer(raw, dtype=np.uint8, count=size).astype(np.int64)
    n[n == 255] = np.frombuffer(raw, dtype="<u4", offset=size)
    return n


def _merged(rows: DataFrame) -> np.ndarray:
    """The sum of the tasks' counts (part, chunk, counts), by 64 parts at a time."""

    def added(pdf: pd.DataFrame) -> pd.DataFrame:
        total = sum(map(unpacked_counts, pdf["counts"]))
        return pd.DataFrame({"part": [pdf["part"][0] // 64], "chunk": [pdf["chunk"][0]], "counts": [packed_counts(np.minimum(total, 2**32 - 1))]})

    parts = (rows.agg(F.max("part")).first()[0] or 0) + 1
    while parts > 1:
        rows = rows.groupBy(F.floor(F.col("part") / 64), F.col("chunk")).applyInPandas(added, "part long, chunk int, counts binary")
        parts = -(-parts // 64)
    out = np.zeros((CHUNKS, (1 << SLOT_BITS) // CHUNKS), dtype=np.int64)
    for r in rows.collect():  # CHUNKS rows
        out[r.chunk] = unpacked_counts(bytes(r.counts))
    return out.ravel()


def scaled(sketch: np.ndarray) -> np.ndarray:
    """What a slot's count exceeds the mean by, on a logarithmic scale of STEPS to a doubling, a byte each.

    Every slot is shared by very many rare shingles in a large corpus; frequent ones stand out above that.
    """
    return np.floor(STEPS * np.log2(np.maximum(sketch - sketch.mean(), 1))).astype(np.uint8)


def shingle_sets(rows: DataFrame, k: int) -> DataFrame:
    """Of (id, text, code): for each row id, code, n, node and bits (the signature); besides, rows of the sketch's counts (part, chunk, counts)."""
    schema = T.StructType([T.StructField("id", rows.schema["id"].dataType), *(T.StructField(c, t) for c, t in (("code", T.LongType()), ("n", T.LongType()), ("node", T.LongType()), ("bits", T.BinaryType()), ("part", T.LongType()), ("chunk", T.IntegerType()), ("counts", T.BinaryType())))])

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types, counts = to_arrow_schema(schema), np.zeros(1 << SLOT_BITS, dtype=np.uint32)

        def batch(columns: dict, size: int) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([c if isinstance(c := columns.get(f.name), pa.Array) else pa.array(c or [None] * size, f.type) for f in types], schema=types)

        for b in batches:
            n, node, bits = [], [], []
            for t in b["text"].to_pylist():
                h = shingle_set(t, k)
                if some := len(h) > 0:
                    counts[np.unique(h >> np.uint64(64 - SLOT_BITS)).astype(np.int64)] += np.uint32(1)
                n.append(len(h))
                node.append(node_of(h) if some else None)
                bits.append(signature(h) if some else None)
            yield batch({"id": b["id"], "code": b["code"], "n": n, "node": node, "bits": bits}, len(n))
        chunks = counts.reshape(CHUNKS, -1)
        some = [i for i in range(CHUNKS) if chunks[i].any()]
        if some:
            yield batch({"part": [TaskContext.get().partitionId()] * len(some), "chunk": some, "counts": [packed_counts(chunks[i]) for i in some]}, len(some))

    return rows.mapInArrow(made, schema)


def unmet(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[list[tuple[int, np.ndarray]]]:
    """For each batch of (text, code): node and sorted shingles of the sets that the task has not met before. Copies of a text are not shingled."""
    codes, nodes = set(), set()
    for b in batches:
        out = []
        for code, text in zip(b["code"].to_pylist(), b["text"], strict=True):
            if code not in codes:
                codes.add(code)
                h = shingle_set(text.as_py(), k)
                if len(h) and (node := node_of(h)) not in nodes:
                    nodes.add(node)
                    out.append((node, h))
        yield out


def prefixes(rows: DataFrame, scale: np.ndarray, k: int) -> DataFrame:
    """Of (text, code): a row (token, salt, node) for each shingle of each distinct set's prefix, once for each task that meets the set.

    salt: the part of the token's nodes that the node is dealt to if the sketch shows the token as hot, else -1.
    """
    sent = rows.sparkSession.sparkContext.broadcast(scale)  # 2 ** SLOT_BITS bytes

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scale = sent.value
        for sets in unmet(batches, k):
            tokens, nodes = [np.empty(0, dtype=np.uint64)], []
            for node, h in sets:
                h = h >> np.uint64(16)
                order = ((scale[(h >> np.uint64(48 - SLOT_BITS)).astype(np.int64)] // STEPS).astype(np.uint64) << np.uint64(48)) | h
                p = prefix_length(len(h))
                tokens.append(np.partition(order, p - 1)[:p] & np.uint64((1 << 48) - 1))
                nodes.append(node)
            node = np.repeat(np.array(nodes, dtype=np.int64), [len(t) for t in tokens[1:]])
            token = np.concatenate(tokens)
            parts = np.ceil(2.0 ** (scale[(token >> np.uint64(48 - SLOT_BITS)).astype(np.int64)] / STEPS) / SALT_ROWS).astype(np.int64)
            salt = np.where(parts > 1, np.abs(node >> 1) % parts, -1).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(token.astype(np.int64)), pa.array(salt), pa.array(node)], names=["token", "salt", "node"])

    return rows.select("text", "code").mapInArrow(made, "token long, salt int, node long")


def sharing(postings: DataFrame, hot: bool) -> DataFrame:
    """(node, low, high) for each token of a node that another node has too: the token's least and greatest node. hot: whether any token has parts."""
    part = Window.partitionBy("token", "salt")
    each = postings.withColumns({"low": F.min("node").over(part), "high": F.max("node").over(part)}).filter("low <> high or salt >= 0")
    if not hot:
        return each.select("node", "low", "high")
    each = saved(each, "parts")
    ends = each.filter("salt >= 0").groupBy("token").agg(F.min("low").alias("least"), F.max("high").alias("greatest")).filter("least <> greatest")
    whole = joined(each.filter("salt >= 0"), ends, ["token"]).select("node", F.col("least").alias("low"), F.col("greatest").alias("high"))
    out = saved(each.filter("salt < 0").select("node", "low", "high").unionAll(whole), "sharing")
    dropped(postings.sparkSession, each)
    return out


def sets_of(rows: DataFrame, codes: DataFrame, k: int) -> DataFrame:
    """Of (text, code): node and packed array of the sets of the texts that `codes` (code) names, and of few others, once for each task that meets them."""
    least, most = FILTER_BITS
    bits = min(most, max(least, (64 * codes.count()).bit_length()))
    slot = F.col("code").bitwiseAND(F.lit((1 << bits) - 1)) + 1
    parts = codes.select(slot.alias("s")).groupBy(F.bitmap_bucket_number("s").alias("i")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("s")).alias("b")).collect()
    filled = np.zeros((1 << bits) // 8, dtype=np.uint8)  # a bit for each slot, set by the bucket
    for r in parts:
        filled[(r.i - 1) * 4096 : r.i * 4096] = np.frombuffer(bytes(r.b), dtype=np.uint8)
    sent = rows.sparkSession.sparkContext.broadcast(filled)  # 2 ** FILTER_BITS / 8 bytes at most

    def wanted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = b["code"].to_numpy() & ((1 << bits) - 1)
            yield b.filter(pa.array((sent.value[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)))

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for sets in unmet(wanted(batches), k):
            yield pa.RecordBatch.from_arrays([pa.array([node for node, _ in sets], pa.int64()), pa.array([packed(h) for _, h in sets], pa.binary())], names=["node", "hashes"])

    # One Python worker a task: a filter by a UDF before this would need a second, and both are kept for the next stages.
    return rows.select("text", "code").mapInArrow(made, "node long, hashes binary")


def streamed(batches: Iterable[pd.DataFrame], key: list[str]) -> Iterator[pd.DataFrame]:
    """The groups of sorted rows, as they come."""
    held: list[pd.DataFrame] = []
    for b in batches:
        if not len(b):
            continue
        changes = np.any([b[c].to_numpy()[1:] != b[c].to_numpy()[:-1] for c in key], axis=0)
        starts = np.concatenate([[0], np.flatnonzero(changes) + 1])
        if held and (held[-1][key].iloc[-1] == b[key].iloc[0]).all():
            if len(starts) == 1:
                held.append(b)
                continue
            yield pd.concat([*held, b.iloc[: starts[1]]], ignore_index=True)
            starts = starts[1:]
        elif held:
            yield pd.concat(held, ignore_index=True)
        for i, j in zip(starts[:-1], starts[1:], strict=True):
            yield b.iloc[i:j].reset_index(drop=True)
        held = [b.iloc[starts[-1] :]]
    if held:
        yield pd.concat(held, ignore_index=True)


def grouped(df: DataFrame, key: list[str], order: list[str], f: Callable[[pd.DataFrame], Iterable[tuple]], schema: str) -> DataFrame:
    """The rows that f makes of each group of `key`. Groups are dealt out by their keys and read as a sorted stream."""
    names = [x.split(" ")[0] for x in schema.split(", ")]

    def made(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out: list[tuple] = []
        for g in streamed(batches, key):
            out.extend(f(g))
            if len(out) > 10_000:
                yield pd.DataFrame(out, columns=names)
                out = []
        yield pd.DataFrame(out, columns=names)

    return df.repartition(*key).sortWithinPartitions(*key, *order).mapInPandas(made, schema)


def bounded(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Those of the pairs (a, b) that may link, by size and by the overlap that the signatures bound; nodes: node, n and bits."""

    @F.pandas_udf("boolean")
    def fits(x: pd.Series, y: pd.Series, n: pd.Series, m: pd.Series) -> pd.Series:
        return pd.Series([may_link(*row) for row in zip(x, y, n, m, strict=True)], dtype=bool)

    def of(c: str, what: str) -> DataFrame:
        return nodes.select(F.col("node").alias(c), F.col(what).alias(f"{what}_{c}"))

    # Sizes first: signatures, the bulk of a pair, follow for the pairs whose sizes fit.
    pairs = joined(pairs, of("a", "n"), ["a"]).join(of("b", "n"), "b").filter(sizes_fit(F.col("n_a"), F.col("n_b")))
    fitting = saved(pairs, "fitting")
    both = joined(fitting, of("a", "bits"), ["a"]).join(of("b", "bits"), "b")
    out = saved(both.filter(fits("bits_a", "bits_b", "n_a", "n_b")).select("a", "b"), "bounded")
    dropped(pairs.sparkSession, fitting)
    return out


def verified(pairs: DataFrame, nodes: DataFrame, rows: DataFrame, k: int) -> DataFrame:
    """Those of the distinct pairs (a, b), a written frame, that link, by the exact intersection of their sets; nodes: node and code; rows: text and code.

    a is a hub: its array meets the arrays of HUB_CHUNK partners at a time, so that no task needs all partners of a hub.
    """
    counts = pairs.groupBy("a").agg(F.count("*").alias("c"))
    dealt = saved(joined(pairs, counts, ["a"]).select("a", "b", F.pmod(F.xxhash64("b"), F.ceil(F.col("c") / HUB_CHUNK)).alias("chunk")), "pairs")
    both = dealt.select(F.col("a").alias("node")).union(dealt.select(F.col("b").alias("node"))).distinct()
    codes = saved(nodes.join(both, "node", "left_semi").select("code"), "codes")
    arrays = saved(sets_of(rows, codes, k).dropDuplicates(["node"]), "arrays")
    wanted = dealt.select(F.col("b").alias("node"), "a", "chunk", F.lit(1).alias("member")).union(dealt.select(F.col("a").alias("node"), "a", "chunk", F.lit(0).alias("member")).distinct())

    def decided(g: pd.DataFrame) -> Iterable[tuple]:
        hub = None
        for node, a, member, hashes in zip(g["node"], g["a"], g["member"], g["hashes"], strict=True):
            own = unpacked(hashes)
            if not member:
                hub = own
            elif linked(len(np.intersect1d(hub, own, assume_unique=True)), len(hub), len(own)):
                yield (a, node)

    out = saved(grouped(joined(wanted, arrays, ["node"]), ["a", "chunk"], ["member"], decided, "a long, b long"), "links")
    dropped(pairs.sparkSession, dealt, codes, arrays)
    return out


def laid_out(groups: DataFrame, several: bool) -> DataFrame:
    """Of groups (token, node, label, n, a written frame): a row for each node and tile (token, band, i, j) that it is in, with block and home.

    A band holds the sizes that one factor of 1.25 spans, so that partners are in one band or in neighbouring ones. Each node is at home
    in its own band and a guest in the next. A band of over TILE_ROWS rows or TILE_SHINGLES shingles is cut into blocks; a tile is two
    blocks of it. several: only bands of more than one label. Every pair of nodes whose sizes fit meets in one tile of a token, at home
    in one of its bands; pairs of guests do not count.
    """
    band = F.floor(F.log(1.2500001, F.col("n"))).cast("int")
    laid = groups.withColumn("home", F.explode(F.array(F.lit(True), F.lit(False)))).withColumn("band", band + F.when(F.col("home"), 0).otherwise(1))
    blocks = F.ceil(F.greatest(F.count("*") / TILE_ROWS, F.sum("n") / TILE_SHINGLES)).alias("blocks")
    sizes = laid.groupBy("token", "band").agg(blocks, F.count("*").alias("rows"), F.count_if("home").alias("homes"), F.min("label").alias("one"), F.max("label").alias("other"))
    laid = joined(laid, sizes.filter("homes > 0 and rows > 1" + " and one <> other" * several).select("token", "band", "blocks"), ["token", "band"])
    laid = laid.withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")))
    laid = laid.withColumn("with", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    return laid.select("token", "band", F.least("block", "with").alias("i"), F.greatest("block", "with").alias("j"), "block", "home", "node", "label", "n").distinct()


def candidates(g: pd.DataFrame, across: bool) -> Iterator[tuple[int, np.ndarray]]:
    """The rows x of a tile, each with the later rows that may link with it by size and signature; across: of other labels only."""
    i, j = g["i"][0], g["j"][0]
    label, n, block, home, bits = (g[c].to_numpy() for c in ("label", "n", "block", "home", "bits"))
    size = min(map(len, bits))
    short = np.stack([folded(np.frombuffer(b, dtype=np.uint8), size) for b in bits])
    for x in range(len(n)):
        y = np.arange(x + 1, len(n))
        y = y[(home[y] | home[x]) & sizes_fit(n[y], n[x])]
        if across:
            y = y[label[y] != label[x]]
        if i != j:
            y = y[block[y] != block[x]]
        if len(y):
            least = np.bitwise_count(short[y] ^ short[x]).sum(axis=1, dtype=np.int64)
            y = y[linked((n[y] + n[x] - least) // 2, n[y], n[x])]
        if len(y):
            yield x, np.array([z for z in y if may_link(bits[x], bits[z], n[x], n[z])], dtype=np.int64)


def tiled_pairs(groups: DataFrame, signatures: DataFrame) -> DataFrame:
    """Pairs (a, b) of nodes of one group but different labels that may link; groups: token, node, label, n; signatures: node, bits."""

    def compared(g: pd.DataFrame) -> Iterable[tuple]:
        node, label = g["node"].to_numpy(), g["label"].to_numpy()
        if (label != label[0]).any():
            for x, ys in candidates(g, True):
                for y in ys:
                    yield (min(node[x], node[y]), max(node[x], node[y]))

    laid = laid_out(groups, True).join(signatures, "node")
    return grouped(laid, ["token", "band", "i", "j"], ["node"], compared, "a long, b long").distinct()


def link_counts(members: DataFrame, signatures: DataFrame, arrays: DataFrame) -> DataFrame:
    """For each node that links: node and links, the rows of the nodes that it links with.

    members: node, label (the component), n and rows; signatures: node, bits; arrays: node, hashes. All links lie within a component, and
    each pair meets in one tile of it.
    """

    def counted(g: pd.DataFrame) -> Iterable[tuple]:
        sets = list(map(unpacked, g["hashes"]))
        _, places = np.unique(np.concatenate(sets), return_inverse=True)
        cuts, n, rows = np.cumsum([0, *map(len, sets)]), g["n"].to_numpy(), g["rows"].to_numpy()
        links, mark = np.zeros(len(n), dtype=np.int64), np.zeros(int(places.max()) + 1, dtype=bool)
        for x, y in candidates(g, False):
            own = places[cuts[x] : cuts[x + 1]]
            mark[own] = True
            common = np.array([int(mark[places[cuts[z] : cuts[z + 1]]].sum()) for z in y], dtype=np.int64)
            mark[own] = False
            y = y[linked(common, n[y], n[x])] if len(y) else y
            links[x] += rows[y].sum()
            links[y] += rows[x]
        yield from zip(g["node"][links > 0].tolist(), links[links > 0].tolist(), strict=True)

    laid = laid_out(members.withColumn("token", F.col("label")), False)
    laid = laid.join(members.select("node", "rows"), "node").join(signatures, "node").join(arrays, "node")
    return grouped(laid, ["token", "band", "i", "j"], ["node"], counted, "node long, links long").groupBy("node").agg(F.sum("links").alias("links"))


def jaccard_classes(docs: DataFrame, k: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """For each row of `docs`: its id, n_shingles (the size of its set), component_id (the least id reachable by links, its own included)
    and n_links (the number of other rows that it links with).

    The id must be an integer column. The result is written to the shared folder. `docs` is read several times; unless it is made of
    files by plain columns and filters, its ids and texts are written first, so that each reading finds the same.

    Edge cases: null and empty texts, and texts without words, have an empty set, link with nothing and are their own component; fewer
    than k words are one shingle; rows with equal sets, repeated rows too, link; a null id is no candidate for component_id, so a
    component of null ids alone has a null one; whole texts count, however long; an empty table gives an empty table; other columns are ignored.
    """
    with arrow_batches(docs.sparkSession, BATCH_ROWS), shuffles_deleted(docs.sparkSession):
        return _classes(docs.select(col(id_col).alias("id"), col(text_col).cast("string").alias("text")), k).toDF(id_col, "n_shingles", "component_id", "n_links")


def _classes(rows: DataFrame, k: int) -> DataFrame:
    """Of (id, text): id, n, component and links, written to the shared folder."""
    spark = rows.sparkSession
    texts = None if same_again(rows) else saved(rows, "texts")
    rows = (texts or rows).withColumn("code", F.xxhash64("text"))
    made = saved(shingle_sets(rows, k), "sets")
    sets = made.filter("n > 0")
    scale = scaled(_merged(made.filter("part is not null").select("part", "chunk", "counts")))
    nodes = saved(sets.groupBy("node").agg(F.first("n").alias("n"), F.first("bits").alias("bits"), F.first("code").alias("code"), F.count("*").alias("rows"), F.min("id").alias("least")), "nodes")

    groups = saved(sharing(prefixes(rows, scale, k), 2.0 ** (int(scale.max()) / STEPS) > SALT_ROWS), "groups")
    hubs = saved(groups.select(F.explode(F.array("low", "high")).alias("a"), F.col("node").alias("b")).filter("a <> b").distinct(), "hubs")
    tried = bounded(hubs, nodes)
    dropped(spark, hubs)
    links = verified(tried, nodes, rows, k)

    labels = saved(connected_components(links), "labels")
    left = saved(groups.select(F.col("low").alias("token"), "node").distinct().join(labels, "node", "left").withColumn("label", F.coalesce("label", "node")), "left")
    dropped(spark, groups)
    mixed = left.groupBy("token").agg(F.min("label").alias("one"), F.max("label").alias("other")).filter("one <> other").select("token")
    several = saved(joined(left, mixed, ["token"]).join(nodes.select("node", "n"), "node"), "several")
    more = tiled_pairs(several, nodes.select("node", "bits")).join(tried, ["a", "b"], "left_anti").join(tried.select(F.col("b").alias("a"), F.col("a").alias("b")), ["a", "b"], "left_anti")
    more = saved(more, "more")
    dropped(spark, left, several, tried)
    if not more.isEmpty():
        labels = saved(connected_components(links.union(verified(more, nodes, rows, k))), "labels")

    # Copies and components, by node: rows come in last, so that no group of copies is gathered.
    members = saved(nodes.join(labels, "node").select("node", "label", "n", "rows", "least", "code"), "members")
    arrays = sets_of(rows, members.select("code"), k).dropDuplicates(["node"])
    counts = link_counts(members.drop("least", "code"), nodes.select("node", "bits"), arrays)
    least = members.groupBy("label").agg(F.min("least").alias("of_label"))
    of_members = joined(members, least, ["label"]).join(counts, "node", "left").select("node", F.col("of_label").alias("component"), (F.coalesce("links", F.lit(0)) + F.col("rows") - 1).alias("links"))
    others = nodes.join(members.select("node"), "node", "left_anti").select("node", F.col("least").alias("component"), (F.col("rows") - 1).alias("links"))
    named = saved(of_members.unionByName(others), "named")
    result = joined(sets.select("id", "n", "node"), named, ["node"]).select("id", "n", "component", "links").unionAll(made.filter("n = 0").select("id", "n", "id", F.lit(0).cast("long")))
    out = saved(result.toDF("id", "n", "component", "links"), "classes")
    dropped(spark, made, nodes, links, more, members, named)
    if texts:
        dropped(spark, texts)
    return out


def drop_near_duplicates(docs: DataFrame, k: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each component of jaccard_classes(), the one that names it, with the columns of `docs`.

    Documents with an empty set are copies of nothing, and stay; so do rows with a null id. Of rows that share id and text one stays;
    an id with several texts stays with all of them if it names any of their components.
    """
    found = jaccard_classes(docs, k, id_col, text_col).filter(col(id_col).isNotNull())
    ids = found.groupBy(col(id_col).alias(GONE)).agg(F.bool_and(F.col("component_id") != col(id_col)).alias("copy"), F.count("*").alias("rows"))
    ids = saved(ids.filter("copy or rows > 1"), "ids")
    kept = docs.join(small(ids.filter("copy").select(GONE), BROADCAST_IDS), col(id_col) == F.col(GONE), "left_anti")
    if ids.filter("not copy and rows > 1").isEmpty():
        return kept
    return kept.filter(col(id_col).isNotNull()).dropDuplicates([id_col, text_col]).unionAll(kept.filter(col(id_col).isNull()))
