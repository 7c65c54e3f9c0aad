"""Quality classifier: Bradley-Terry pairwise ranking.

A document's score is linear in features of its whole text. Preference pairs (a row marked good over one marked bad) train the
weights by logistic loss on feature differences; the threshold is a quantile of the training scores.
"""

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import col, fresh

FEATURES = (
    "log_length", "upper_of_letters", "digits", "symbols", "bars", "exclamations", "sentence_marks", "commas",
    "words_with_symbol_end", "words_all_upper", "word_repeated_at_once", "distinct_words", "word_length", "long_words", "log_words_a_mark", "empty",
)
_UPPER, _LOWER, _DIGIT = np.arange(65, 91), np.arange(97, 123), np.arange(48, 58)
_SYMBOL = np.frombuffer(b"#$%&*+/<=>@\\^_`{}~[]", dtype=np.uint8)


def features(text: str | None) -> list[float]:
    """The numbers of FEATURES for one whole text; a null text counts as empty."""
    text = text or ""
    words = text.split()
    if not words:
        return [0.0] * (len(FEATURES) - 1) + [1.0]
    n = np.bincount(np.frombuffer(text.encode("utf-8", "replace"), dtype=np.uint8), minlength=256)
    size, count = int(n.sum()), len(words)
    upper, lower = int(n[_UPPER].sum()), int(n[_LOWER].sum())
    marks = int(n[46] + n[33] + n[63])
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=count)
    return [
        np.log1p(size), upper / (upper + lower + 1), int(n[_DIGIT].sum()) / size, int(n[_SYMBOL].sum()) / size, int(n[124]) / size, int(n[33]) / size, int(n[46]) / size, int(n[44]) / size,
        sum(not w[-1].isalnum() and w[-1] not in ".,;:!?)\"'" for w in words) / count, sum(w.isupper() and len(w) > 1 for w in words) / count,
        sum(map(str.__eq__, words, words[1:])) / count, len(set(words)) / count, float(lengths.mean()) / 10, float((lengths > 20).mean()), np.log((count + 1) / (marks + 1)), 0.0,
    ]


@dataclass(frozen=True)
class QualityModel:
    """Standardising means and deviations, weights, and the score quantile that splits good from bad."""

    mean: np.ndarray
    deviation: np.ndarray
    weights: np.ndarray
    threshold: float
    scale: float
    accept_at: float

    def raw(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.deviation, -6, 6) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        """In 0 to 1: accept_at where the raw score is the threshold."""
        z = np.clip((self.raw(x) - self.threshold) / self.scale, -30, 30) + np.log(self.accept_at / (1 - self.accept_at))
        return 1 / (1 + np.exp(-z))


def fit_bradley_terry(x: np.ndarray, good: np.ndarray, accept_at: float = 0.7, rivals: int = 16, ridge: float = 1e-2, seed: int = 7) -> QualityModel:
    """Fits the model on a bounded sample: features x (rows, FEATURES) and marks `good` (0 or 1).

    rivals: good rows that each bad row is compared with. With one class only, every score is accept_at or above for
    good samples and below it for bad ones.
    """
    mean, deviation = (x.mean(0), x.std(0) + 1e-6) if len(x) else (np.zeros(len(FEATURES)), np.ones(len(FEATURES)))
    z, w = np.clip((x - mean) / deviation, -6, 6), np.zeros(len(FEATURES))
    up, down = np.flatnonzero(good == 1), np.flatnonzero(good == 0)
    if not len(up) or not len(down):
        return QualityModel(mean, deviation, w, 1.0 if len(down) else -1.0, 1.0, accept_at)
    draw = np.random.default_rng(seed)
    a, b = draw.choice(up, len(down) * rivals), np.repeat(down, rivals)
    difference = z[a] - z[b]
    for _ in range(30):  # Newton's method; the loss is convex
        p = 1 / (1 + np.exp(-np.clip(difference @ w, -30, 30)))
        gradient = difference.T @ (p - 1) / len(difference) + ridge * w
        step = np.linalg.solve((difference * (p * (1 - p))[:, None]).T @ difference / len(difference) + ridge * np.eye(len(w)), gradient)
        w = w - step
        if np.abs(step).max() < 1e-6:
            break
    s = z @ w
    # The quantile with the fewest errors; of those nearly as good, the middle of the widest gap between neighbouring scores.
    order = np.argsort(s)
    ranked, errors = s[order], np.cumsum(good[order] == 1)[:-1] + (good == 0).sum() - np.cumsum(good[order] == 0)[:-1]
    near = np.flatnonzero(errors <= errors.min() + 0.005 * len(s))
    cut = near[np.argmax(ranked[near + 1] - ranked[near])]
    threshold = (ranked[cut] + ranked[cut + 1]) / 2
    return QualityModel(mean, deviation, w, float(threshold), float(max(s.std() / 4, 1e-6)), accept_at)


def _featured(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        yield pd.DataFrame({"good": b["good"], "x": [features(t) for t in b["text"]]})


def train_quality(docs: DataFrame, labels: DataFrame, max_rows: int = 6000, accept_at: float = 0.7, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> QualityModel:
    """Learns from the rows of `labels` (id, quality 0 or 1), of which a sample of `max_rows`, the first by a hash of the id, is used.

    The sample bounds what is broadcast (ids) and what reaches the driver (features). Rows with a null id or label are left out; an id
    that is marked both ways counts as bad. Rows are put in one order before pairs are drawn, so that the model doesn't depend on how the
    tables are partitioned.
    """
    sample = labels.select(col(id_col).alias("id"), col(label_col).cast("int").alias("good")).dropna().groupBy("id").agg(F.min("good").alias("good")).orderBy(F.xxhash64("id"), "id").limit(max_rows)
    rows = docs.select(col(id_col).alias("id"), col(text_col).alias("text")).join(F.broadcast(sample), "id").select("good", "text").mapInPandas(_featured, "good int, x array<double>").toPandas()
    rows = rows.iloc[sorted(range(len(rows)), key=lambda i: (rows["good"].iat[i], tuple(rows["x"].iat[i])))]
    x = np.array(rows["x"].tolist(), dtype=float).reshape(-1, len(FEATURES))
    return fit_bradley_terry(x, rows["good"].to_numpy(), accept_at)


def score_quality(docs: DataFrame, model: QualityModel, text_col: str = "text") -> DataFrame:
    """`docs` with the column score, 0 to 1: model.accept_at or above where the text ranks above the threshold. A `score` column in `docs` is replaced.

    Null and empty texts have scores too (the feature `empty`); ties score alike; an empty table gives an empty table.
    """

    @F.pandas_udf("double")
    def scored(text: pd.Series) -> pd.Series:
        return pd.Series(model.score(np.array([features(t) for t in text], dtype=float).reshape(-1, len(FEATURES))))

    return docs.withColumn("score", scored(col(text_col)))


def keep_quality(docs: DataFrame, model: QualityModel, text_col: str = "text") -> DataFrame:
    """The rows of `docs` that the model accepts, with the columns of `docs`."""
    score = fresh(docs, "quality_score")
    kept = score_quality(docs.select(F.struct(*map(col, docs.columns)).alias("row"), col(text_col).alias("text_")), model, "text_")
    return kept.withColumnRenamed("score", score).filter(col(score) >= model.accept_at).select("row.*")
