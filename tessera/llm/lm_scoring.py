"""Cross-entropy difference: matched target and background bigram models over one vocabulary.

The vocabulary is every word of the whole corpus. Word and bigram counts cover every document. Each token's loss under either model is
the negative logarithm of its smoothed probability after the preceding token, and a document's score is the mean difference of the
losses, target less background: the lower, the more like the target. A document's own counts are left out of both models when it is
scored, so that neither knows its texts by heart.

The counts grow with the corpus and are never gathered in one place. Documents are dealt into chunks of bounded size; each chunk counts
its own words and bigrams, named by 63-bit hashes, and sends the counts to buckets, ranges of hashes. A bucket sums the counts of all
chunks and answers each chunk with the sums of its names, in the order in which it sent them. A name occurs once a chunk at most, however
frequent.
"""

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import col
from tessera.llm.shingles import mixed, word_hashes

# Tokens have no white space, so these are none.
UNKNOWN, START = "unknown word", "start of text"
#: Code points that a chunk holds on average, and the least number of chunks.
CHUNK_CHARS, LEAST_CHUNKS = 8_000_000, 16
_BIGRAM, _FIRST, _WORD, _CONTEXT = (np.uint64(xxhash.xxh3_64_intdigest(x) | 1) for x in ("bigram", "first", "word", "context"))
_START = np.uint64(xxhash.xxh3_64_intdigest(START))
#: Distinct words that a task gathers before it hands their counts on.
HELD_WORDS = 200_000


def tokens(text: str | None) -> list[str]:
    return (text or "").lower().split()


def build_vocabulary(docs: DataFrame, size: int, text_col: str = "text") -> list[str]:
    """The size - 2 most frequent words of all documents, ties in alphabetical order; their ids start at 2."""

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: Counter = Counter()
        for b in batches:
            for t in b["text"]:
                held.update(tokens(t))
                if len(held) >= HELD_WORDS:
                    yield pd.DataFrame({"word": list(held), "n": list(held.values())})
                    held.clear()
        yield pd.DataFrame({"word": list(held), "n": list(held.values())}).astype({"word": "object", "n": "int64"})

    counts = docs.select(col(text_col).alias("text")).mapInPandas(counted, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return [r.word for r in counts.orderBy(F.desc("n"), "word").limit(size - 2).collect()]


class Counts:
    """The counts of a chunk's texts by name, for the target (row 0) and the background (row 1).

    Each token has three names: of its bigram, of its word, and of the word before it as a context. Names of words alone are odd.
    """

    def __init__(self, texts: list[str | None], target: np.ndarray, known: frozenset[str] | None):
        each = [word_hashes(tokens(t) if known is None else [w if w in known else UNKNOWN for w in tokens(t)]) for t in texts]
        self.lengths = np.array([len(h) for h in each], dtype=np.int64)
        h = np.concatenate([*each, np.empty(0, dtype=np.uint64)])
        before = np.concatenate([h[:0], [_START], h[:-1]])[: len(h)].astype(np.uint64)
        before[(np.cumsum(self.lengths) - self.lengths)[self.lengths > 0]] = _START
        names = np.concatenate([mixed(before * _FIRST + h * _BIGRAM), mixed(h * _WORD), mixed(before * _CONTEXT)])
        names &= ~np.uint64(1)
        names[len(h) : 2 * len(h)] |= np.uint64(1)
        self.names, places = np.unique(names, return_inverse=True)
        self.bigrams, self.words, self.contexts = places.reshape(3, -1)
        self.target = target
        of_target = places[np.tile(np.repeat(target, self.lengths), 3)]
        n = np.bincount(of_target, minlength=len(self.names))
        self.n = np.array([n, np.bincount(places, minlength=len(self.names)) - n])

    def losses(self, totals: tuple[int, int], size: int, prior: float) -> np.ndarray:
        """For target and background, each text's mean loss of its tokens, 0 without any. A text's own counts are left out of its side's."""
        of, out = np.repeat(np.arange(len(self.lengths)), self.lengths), []
        own = []
        for places in (self.bigrams, self.words, self.contexts):
            _, at, times = np.unique(of * len(self.names) + places, return_inverse=True, return_counts=True)
            own.append(times[at])
        for side, (n, total) in enumerate(zip(self.n, totals, strict=True)):
            mine = self.target[of] == (side == 0)
            bigrams, words, contexts = (n[places] - x * mine for places, x in zip((self.bigrams, self.words, self.contexts), own, strict=True))
            unigram = (words + 0.5) / (total - self.lengths[of] * mine + 0.5 * size)
            loss = -np.log((bigrams + prior * unigram) / (contexts + prior))
            out.append(np.bincount(of, loss, minlength=len(self.lengths)) / np.maximum(self.lengths, 1))
        return np.array(out)


def packed(n: np.ndarray) -> bytes:
    """Two rows of counts: a byte for each, then 8 bytes for each that is 255 or more."""
    return np.minimum(n, 255).astype(np.uint8).tobytes() + n[n >= 255].astype(np.int64).tobytes()


def unpacked(b: bytes, size: int) -> np.ndarray:
    n = np.frombuffer(b, dtype=np.uint8, count=2 * size).astype(np.int64)
    n[n == 255] = np.frombuffer(b, dtype=np.int64, offset=2 * size)
    return n.reshape(2, size)


def planes(names: np.ndarray) -> bytes:
    """Sorted names byte by byte, so that the leading bytes compress."""
    return names.view(np.uint8).reshape(-1, 8).T.tobytes()


def of_planes(b: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(b, dtype=np.uint8).reshape(8, -1).T).view(np.uint64).ravel()


SENT = {"bucket": pa.int32(), "chunk": pa.int32(), "names": pa.binary(), "n": pa.binary()}
#: What a bucket answers to a chunk, with the bucket's numbers of distinct words and of tokens of the target and of the background.
ANSWERED = {"chunk": pa.int32(), "bucket": pa.int32(), "n": pa.binary(), "words": pa.int64(), "target": pa.int64(), "background": pa.int64()}


def arrow(rows: list[tuple], types: dict[str, pa.DataType]) -> pa.Table:
    columns = zip(*rows, strict=True) if rows else [()] * len(types)
    return pa.table([pa.array(c, t) for c, t in zip(columns, types.values(), strict=True)], names=list(types))


def summed(sent: pa.Table, chunks: int) -> pa.Table:
    """The answers of a bucket, one for each chunk."""
    keys = [of_planes(x.as_py()) for x in sent["names"]]
    names, places = np.unique(np.concatenate(keys), return_inverse=True)
    at, total = np.cumsum([0, *map(len, keys)]), np.zeros((2, len(names)), dtype=np.int64)
    own = {c: places[a:b] for c, a, b in zip(sent["chunk"].to_pylist(), at[:-1], at[1:], strict=True)}
    for place, n in zip(own.values(), sent["n"], strict=True):
        total[:, place] += unpacked(n.as_py(), len(place))  # names are distinct within a chunk
    odd = (names & np.uint64(1)).astype(bool)
    bucket, sums = sent["bucket"][0].as_py(), (int(odd.sum()), *map(int, total[:, odd].sum(1)))
    return arrow([(c, bucket, packed(total[:, own[c]]) if c in own else b"", *sums) for c in range(chunks)], ANSWERED)


def cross_entropy_difference(docs: DataFrame, target_ids: DataFrame, vocabulary_size: int | None = None, prior: float = 64.0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """For each row of `docs`: its id, n_tokens, ce_target, ce_background and score, their difference (lower: more like the target).

    target_ids: ids (one column) of the rows that make up the target; all others are the background. vocabulary_size: None for every
    word of `docs`; a number for its most frequent words, START and UNKNOWN, which then stands for all other words.

    Edge cases: null and empty texts have no token, cross-entropies and score 0; null ids belong to the background; rows that share
    an id are all target or all background; without target rows its model is the even one; an empty table gives an empty table.
    """
    rows = docs.select(col(id_col).alias("id"), col(text_col).cast("string").alias("text"))
    kind = rows.schema["id"].dataType
    wanted = target_ids.select(col(target_ids.columns[0]).cast(kind).alias("id")).dropna().distinct()
    known = None if vocabulary_size is None else frozenset(build_vocabulary(rows, vocabulary_size))
    chars = rows.agg(F.sum(F.length("text").cast("long"))).first()[0] or 0
    chunks = max(LEAST_CHUNKS, -(-chars // CHUNK_CHARS))
    of_id, of_text = (F.pmod(F.xxhash64(x), F.lit(chunks)).cast("int") for x in ("id", "text"))
    dealt = rows.select(F.when(F.col("id").isNull(), of_text).otherwise(of_id).alias("chunk"), "id", "text")
    wanted = wanted.select(of_id.alias("chunk"), "id")

    def counts(texts: pa.Table, ids: pa.Table) -> Counts:
        of_target = pc.is_in(texts["id"], value_set=ids["id"].combine_chunks().drop_null())
        return Counts(texts["text"].to_pylist(), of_target.to_numpy().astype(bool), known)

    def parts(names: np.ndarray) -> list[tuple[int, int, int]]:
        """(bucket, start, end) in sorted names."""
        buckets = ((names >> np.uint64(40)) * np.uint64(chunks) >> np.uint64(24)).astype(np.int64)
        cuts = np.flatnonzero(np.diff(buckets, prepend=-1)).tolist()
        return list(zip(buckets[cuts].tolist(), cuts, [*cuts, len(buckets)][1:], strict=True))

    def counted(texts: pa.Table, ids: pa.Table) -> pa.Table:
        if not texts.num_rows:
            return arrow([], SENT)
        c, at = counts(texts, ids), texts["chunk"][0].as_py()
        return arrow([(bucket, at, planes(c.names[a:b]), packed(c.n[:, a:b])) for bucket, a, b in parts(c.names)], SENT)

    def answered(sent: pa.Table) -> pa.Table:
        return summed(sent, chunks)

    sent = dealt.groupBy("chunk").cogroup(wanted.groupBy("chunk")).applyInArrow(counted, "bucket int, chunk int, names binary, n binary")
    answers = sent.groupBy("bucket").applyInArrow(answered, "chunk int, bucket int, n binary, words long, target long, background long")

    def scored(texts: pa.Table, heard: pa.Table) -> pa.Table:
        if not texts.num_rows:
            return pa.table([texts["id"], *[pa.array([], t) for t in (pa.int64(), *[pa.float64()] * 3)]], names=schema.names)
        answer = pc.is_valid(heard["bucket"])
        c, heard = counts(texts, heard.filter(pc.invert(answer))), heard.filter(answer)
        of_bucket = dict(zip(heard["bucket"].to_pylist(), heard["n"], strict=True))
        for bucket, a, b in parts(c.names):
            c.n[:, a:b] = unpacked(of_bucket[bucket].as_py(), b - a)
        words, *totals = (pc.sum(heard[x]).as_py() or 0 for x in ("words", "target", "background"))
        of_target, of_background = c.losses(totals, 2 + (words if known is None else len(known)), prior)
        return pa.table([texts["id"], c.lengths, of_target, of_background, of_target - of_background], names=schema.names)

    schema = T.StructType([T.StructField(id_col, kind), T.StructField("n_tokens", T.LongType()), *(T.StructField(x, T.DoubleType()) for x in ("ce_target", "ce_background", "score"))])
    heard = wanted.unionByName(answers, allowMissingColumns=True)
    return dealt.groupBy("chunk").cogroup(heard.groupBy("chunk")).applyInArrow(scored, schema)
