"""Toxicity by compression distance: separate zstandard dictionaries of toxic and ordinary text.

A text is cut into windows of words. Each window is compressed with the ordinary dictionary alone and with the toxic one beside it; its
gain is the difference of the lengths, what knowing toxic text saves beyond knowing ordinary text. Windows whose gain reaches a calibrated
threshold are toxic, and so is a document of whose windows a calibrated share is toxic.

Words are transcribed before they are compressed: each as the 16-byte codes of its prefixes of some lengths, so that an inflected word
shares the codes of its stem, and a stem of a few letters is long enough to pay for a match. On plain letters a match costs as much
as the five or six letters that it saves, and nothing could be told apart (README).

Most of a toxic text is ordinary. Its codes that ordinary texts have about as often are left out of the samples of the toxic dictionary,
by their share of documents, so that single ordinary texts that quote a toxic word take nothing away.
"""

import re
from collections import Counter
from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import col

WORD = re.compile(r"[^\W\d_]+")
#: Lengths of prefixes, in letters, that have a code; shorter words have one code. Bytes of a code.
PREFIXES, CODE = (3, 4, 5, 6, 7), 16
#: Words whose codes a process remembers at most; then it starts anew.
REMEMBERED = 400_000
#: Words in a sample that a dictionary is trained on.
SAMPLE_WORDS = 64
#: A code is kept for the toxic dictionary if so many toxic texts have it, at a rate so many times that of ordinary texts.
LEAST_TEXTS, LEAST_RATIO = 3, 8


class _Codes(dict):
    def __missing__(self, word: str) -> bytes:
        if len(self) >= REMEMBERED:
            self.clear()
        of = [word[:k] + ("" if len(word) > k else "$") for k in PREFIXES if len(word) >= k] or [word + "$"]
        out = self[word] = b"".join(xxhash.xxh3_128_digest(x.encode("utf-8", "replace")) for x in of)
        return out


_CODES = _Codes()


def transcribed(text: str | None) -> list[bytes]:
    """The codes of each word of the whole lower-cased text."""
    return list(map(_CODES.__getitem__, WORD.findall((text or "").lower())))


def windows(words: list[bytes], size: int) -> list[bytes]:
    return [b"".join(words[i : i + size]) for i in range(0, len(words), size)]


def codes(word: bytes) -> list[bytes]:
    return [word[i : i + CODE] for i in range(0, len(word), CODE)]


def trained(samples: list[bytes], size: int) -> bytes:
    """A zstandard dictionary; without enough samples, their plain bytes."""
    samples = [s for s in samples if len(s) >= 2 * CODE]
    try:
        return zstandard.train_dictionary(min(size, sum(map(len, samples)) // 2), samples, k=2 * CODE, d=8).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[:size]


def compressor(dictionary: bytes) -> zstandard.ZstdCompressor:
    settings = zstandard.ZstdCompressionParameters(
        window_log=23, hash_log=17, chain_log=17, search_log=3, min_match=5, target_length=16, strategy=zstandard.STRATEGY_DFAST, write_content_size=False, write_checksum=False, write_dict_id=False
    )
    held = zstandard.ZstdCompressionDict(dictionary, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    held.precompute_compress(compression_params=settings)
    return zstandard.ZstdCompressor(compression_params=settings, dict_data=held)


@dataclass
class ToxicModel:
    """Trained dictionaries (plain bytes, to be sent to executors) and calibrated thresholds; without a toxic dictionary nothing is toxic."""

    toxic: bytes
    ordinary: bytes
    window_words: int = 8
    least_gain: int = 20
    least_share: float = 0.05

    def __post_init__(self):
        self._with_toxic, self._ordinary = compressor(self.toxic + self.ordinary), compressor(self.ordinary)

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if not k.startswith("_")}

    def __setstate__(self, state):
        self.__dict__.update(state)
        self.__post_init__()

    def gains(self, text: str | None) -> np.ndarray:
        """Bytes that toxic text saves in each window of the whole text."""
        return np.array([len(self._ordinary.compress(w)) - len(self._with_toxic.compress(w)) for w in windows(transcribed(text), self.window_words)], dtype=np.int64)

    def judged(self, text: str | None) -> tuple[int, float]:
        """The toxic windows and a score in 0 to 1: 0.5 or more where their share is least_share or more. Null and empty texts have none."""
        gains = self.gains(text) if self.toxic else np.empty(0)
        n = int((gains >= self.least_gain).sum())
        return n, float(1 / (1 + np.exp(-np.clip(4 * (n / max(len(gains), 1) - self.least_share) / self.least_share, -30, 30))))


def calibrated(gains: list[np.ndarray], toxic: np.ndarray, grid: Iterable[int] = range(6, 33)) -> tuple[int, float]:
    """The thresholds of gain and of share with the fewest errors; of equally good ones, those with the widest gap between shares."""
    best = None
    for least_gain in grid:
        shares = np.array([(g >= least_gain).mean() if len(g) else 0.0 for g in gains])
        levels = np.unique(shares)
        for low, high in zip(levels[:-1], levels[1:], strict=True):
            tried = (int(((shares >= high) != (toxic == 1)).sum()), low / high, least_gain, float(low + high) / 2)
            best = min(best, tried) if best else tried
    return (best[2], best[3]) if best else (1 << 30, 1.0)


def fit_toxic(texts: list[str], toxic: np.ndarray, window_words: int = 8, toxic_bytes: int = 8192, ordinary_bytes: int = 1 << 21, calibrate_every: int = 3) -> ToxicModel:
    """Trains dictionaries on texts marked toxic (1) or not (0); every `calibrate_every`th text only calibrates the thresholds."""
    held, words = np.arange(len(texts)) % calibrate_every == 0, list(map(transcribed, texts))
    sides = [[words[i] for i in np.flatnonzero(~held & (toxic == y))] for y in (0, 1)]
    rates: list[dict[bytes, float]] = []
    for side in sides:
        counts = Counter(c for ws in side for c in {c for w in set(ws) for c in codes(w)})
        rates.append({c: n / len(side) for c, n in counts.items()})
    kept = {c for c, r in rates[1].items() if r * len(sides[1]) >= LEAST_TEXTS - 0.5 and r > LEAST_RATIO * rates[0].get(c, 0.0)}
    telling = [b"".join(c for w in ws for c in codes(w) if c in kept) for ws in sides[1]]
    ordinary = trained([w for ws in sides[0] for w in windows(ws, SAMPLE_WORDS)], ordinary_bytes)
    model = ToxicModel(trained(telling, toxic_bytes), ordinary, window_words)
    if not model.toxic:
        return model
    model.least_gain, model.least_share = calibrated([model.gains(texts[i]) for i in np.flatnonzero(held)], toxic[held])
    return model


def train_toxic(docs: DataFrame, labels: DataFrame, max_rows: int = 6000, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", **settings) -> ToxicModel:
    """Learns from the rows of `labels` (id, toxic 0 or 1), of which a sample of `max_rows`, the first by a hash of the id, is used.

    The sample bounds what is broadcast (ids) and what reaches the driver (its whole texts, each once). Rows with a null id or label are
    left out; an id or a text that is marked both ways counts as toxic. The model doesn't depend on how the tables are partitioned.
    """
    sample = labels.select(col(id_col).alias("id"), col(label_col).cast("int").alias("toxic")).dropna().groupBy("id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("id"), "id").limit(max_rows)
    texts = docs.select(col(id_col).alias("id"), F.coalesce(col(text_col).cast("string"), F.lit("")).alias("text")).join(F.broadcast(sample), "id").groupBy("text").agg(F.max("toxic").alias("toxic"))
    rows = texts.toPandas()
    rows = rows.iloc[np.argsort([xxhash.xxh3_128_hexdigest(t) for t in rows["text"]])]
    return fit_toxic(rows["text"].tolist(), rows["toxic"].to_numpy(), **settings)


def score_toxic(docs: DataFrame, model: ToxicModel, text_col: str = "text") -> DataFrame:
    """`docs` with score (0 to 1, 0.5 or more: toxic) and toxic_windows, of the whole texts. Columns of those names are replaced.

    Null and empty texts have no window and the lowest score; ties score alike; an empty table gives an empty table.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the sizes of the dictionaries

    @F.pandas_udf("toxic_windows long, score double")
    def judged(text: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([sent.value.judged(t) for t in text], columns=["toxic_windows", "score"])

    both = judged(col(text_col))
    return docs.withColumns({"toxic_windows": both["toxic_windows"], "score": both["score"]})
