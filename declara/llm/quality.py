"""Quality scores of texts: random Fourier features, ridge regression, isotonic calibration.

Every text is described by a fixed list of statistics of its characters, words and lines.  Random Fourier
features cos(w x + b) of the standardised statistics approximate a Gaussian kernel; each partition sums its share
of the normal equations, which Spark adds up by matrix row; ridge scores are then made probabilities by isotonic
regression (pool adjacent violators) over sums per score bin.

The model is bounded by its own size: ``features`` numbers per matrix row, ``bins`` calibration steps.  All
labelled rows are used.  The statistics are kept in a table of the shared folder, so texts are read once.

Defined results: null text is empty; a document whose id is null or has no label is not learned from; several labels
of one id count with their mean; without labelled rows every score is 0.5; repeated rows are scored alike; an empty
table gives no rows.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from declara.session import stored

_LOWER, _UPPER = np.zeros(256), np.zeros(256)
_LOWER[97:123], _UPPER[65:91] = 1, 1
_DIGIT, _SPACE, _HIGH = np.zeros(256), np.zeros(256), np.zeros(256)
_DIGIT[48:58], _SPACE[[32, *range(9, 14)]], _HIGH[128:] = 1, 1, 1
_MARK = ((np.arange(256) > 32) & (np.arange(256) < 127) & (_LOWER + _UPPER + _DIGIT == 0)).astype(float)
_CLASSES = np.stack([_LOWER, _UPPER, _DIGIT, _SPACE, _HIGH, _MARK])

#: Names of the statistics, in order.
STATISTICS = ["log_bytes", "log_words", "lower", "upper", "digit", "space", "high", "mark", "exclaim", "bar", "odd_marks",
              "word_bytes", "long_words", "distinct_words", "top_word", "marked_words", "caps_words", "lines",
              "distinct_lines", "line_words", "stops", "sentence_words"]


def statistics(text: str | None) -> np.ndarray:
    """The statistics of one whole text."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    counts = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    n = max(1, len(raw))
    classes = _CLASSES @ counts / n
    words = raw.split()
    k = max(1, len(words))
    seen: dict[bytes, int] = {}
    for w in words:
        seen[w] = seen.get(w, 0) + 1
    lines = [x for x in raw.split(b"\n") if x.strip()]
    m = max(1, len(lines))
    stops = counts[46] + counts[33] + counts[63]
    distinct = list(seen)
    marked = sum(seen[w] for w in distinct if not w[-1:].isalnum() and w[-1] < 128)
    caps = sum(seen[w] for w in distinct if w.isupper())
    long = sum(seen[w] for w in distinct if len(w) > 12)
    return np.array([
        math.log1p(len(raw)), math.log1p(len(words)), *classes, counts[33] / n, counts[124] / n,
        counts[[35, 36, 37, 38, 42, 64, 94, 126]].sum() / n, sum(map(len, words)) / k / 10, long / k, len(seen) / k,
        max(seen.values(), default=0) / k, marked / k, caps / k, math.log1p(len(lines)), len(set(lines)) / m,
        math.log1p(k / m), stops / k, math.log1p(k / (stops + 1))])


class Model:
    """Standardisation, random features, ridge weights and calibration steps."""

    def __init__(self, mean, scale, features: int, width: float, seed: int):
        rng = np.random.default_rng(seed)
        self.mean, self.scale = np.asarray(mean), np.asarray(scale)
        self.w = rng.normal(size=(len(self.mean), features)) / width
        self.b = rng.uniform(0, 2 * np.pi, features)
        self.beta: np.ndarray | None = None
        self.edges = self.steps = None

    def features(self, stats: np.ndarray) -> np.ndarray:
        z = np.clip((stats - self.mean) / self.scale, -8, 8)
        return np.hstack([np.cos(z @ self.w + self.b) * np.sqrt(2 / len(self.b)), np.ones((len(z), 1))])

    def ridge(self, stats: np.ndarray) -> np.ndarray:
        return self.features(stats) @ self.beta

    def probability(self, ridge: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(ridge, self.edges, self.steps), 0.0, 1.0)


def pooled(weights: np.ndarray, means: np.ndarray) -> np.ndarray:
    """Pool adjacent violators: the non-decreasing values nearest to the means."""
    blocks: list[list[float]] = []
    for w, m in zip(weights, means):
        blocks.append([w, m, 1])
        while len(blocks) > 1 and blocks[-2][1] >= blocks[-1][1]:
            w2, m2, k2 = blocks.pop()
            w1, m1, k1 = blocks.pop()
            blocks.append([w1 + w2, (w1 * m1 + w2 * m2) / (w1 + w2), k1 + k2])
    return np.repeat([b[1] for b in blocks], [int(b[2]) for b in blocks])


def describe(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, digest of the text and statistics of every row, kept in the shared folder."""
    slim = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("digest"),
                       F.col(text_col).cast("string").alias("text"))
    kind = slim.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for pdf in batches:
            stats = [statistics(t).tolist() for t in pdf["text"]]
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "digest": pdf["digest"], "stats": pd.Series(stats, dtype=object)})

    return stored(slim.mapInPandas(run, f"doc_id {kind}, digest bigint, stats array<double>"), "statistics")


def fit(train: DataFrame, features: int = 192, width: float = 4.0, ridge: float = 1e-3, bins: int = 400,
        seed: int = 11) -> Model | None:
    """A model from rows with ``stats`` and ``y`` (0 to 1); None without rows."""
    k = len(STATISTICS)
    sums = train.select(F.count("*").alias("n"), *[f(F.get("stats", F.lit(i))).alias(f"{name}{i}") for i in range(k)
                                                   for name, f in (("m", F.avg), ("s", F.stddev_pop))]).first()
    if not sums["n"]:
        return None
    model = Model([sums[f"m{i}"] for i in range(k)], [max(sums[f"s{i}"], 1e-6) for i in range(k)], features, width, seed)
    size = features + 1

    def normal(batches):
        total = np.zeros((size, size + 1))
        for pdf in batches:
            if len(pdf):
                x = model.features(np.array(pdf["stats"].tolist()))
                total += x.T @ np.hstack([x, pdf["y"].to_numpy()[:, None]])
        yield pd.DataFrame({"i": np.arange(size), "sums": list(total)})

    def add(pdf):
        return pd.DataFrame({"i": pdf["i"][:1], "sums": [np.sum(np.stack(pdf["sums"].to_numpy()), axis=0)]})

    parts = train.select("stats", "y").mapInPandas(normal, "i int, sums array<double>")
    rows = parts.groupBy("i").applyInPandas(add, "i int, sums array<double>").orderBy("i").collect()
    total = np.array([r["sums"] for r in rows])
    penalty = np.eye(size) * ridge * sums["n"]
    penalty[-1, -1] = 0
    model.beta = np.linalg.solve(total[:, :size] + penalty + np.eye(size) * 1e-9, total[:, size])

    def binned(batches):
        for pdf in batches:
            score = np.clip(model.ridge(np.array(pdf["stats"].tolist())), -0.5, 1.5) if len(pdf) else np.zeros(0)
            yield pd.DataFrame({"bin": np.floor((score + 0.5) / 2 * (bins - 1)).astype(int), "y": pdf["y"], "x": score})

    steps = (train.select("stats", "y").mapInPandas(binned, "bin int, y double, x double")
             .groupBy("bin").agg(F.count("*").alias("n"), F.avg("y").alias("y"), F.avg("x").alias("x")).orderBy("bin").collect())
    model.edges = np.array([s["x"] for s in steps])
    model.steps = pooled(np.array([float(s["n"]) for s in steps]), np.array([s["y"] for s in steps]))
    return model


def score_documents(described: DataFrame, labels: DataFrame, learn: str = "pmod(crc32(cast(doc_id as string)), 5) != 0",
                    **options) -> DataFrame:
    """doc_id, digest and score (0 to 1, higher: better) of every described row; only labels of ids that meet
    ``learn`` are used."""
    known = (labels.filter(F.col("quality").isNotNull()).groupBy("doc_id").agg(F.avg("quality").alias("y")))
    model = fit(described.filter(F.expr(learn)).join(known, "doc_id").select("stats", "y"), **options)
    kind = described.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for pdf in batches:
            if model is None or not len(pdf):
                score = np.full(len(pdf), 0.5)
            else:
                score = model.probability(model.ridge(np.array(pdf["stats"].tolist())))
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "digest": pdf["digest"], "score": score})

    return described.mapInPandas(run, f"doc_id {kind}, digest bigint, score double")
