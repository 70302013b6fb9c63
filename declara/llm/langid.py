"""Language identification of words by a linear-chain conditional random field.

A word gives emission scores from its affixes (up to 4 letters), its inner n-grams (2 to 4 letters), both hashed, and
from a lexicon of each language's most frequent words.  Learned transitions join neighbouring words, so that a text may
switch its language; forward-backward gives every word the probability of each language.  A text's language has the
largest share of its words; the score is that share.

Training rows are windows of at most ``windows`` x ``window`` words of at most ``per_language`` labelled texts of each
language (those of smallest hash; the bound of the training sample).  Windows of several languages are joined into
sequences that switch, so the transitions are learned too.  Shards of the sample run one pass of adaptive gradient
steps each, their weights are averaged in Spark, and the next round starts from the average.  The model is bounded by
its own size (``buckets`` x languages).

Defined results: a text that is null or has no letter is ``und`` with score 0, and so is every text where nothing can
be learned; a row whose id or language is null is not learned from; of equal shares the first language by code point
wins; repeated rows are scored alike; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import random
import re
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from declara.session import stored

#: A word: a run of letters of any script.
LETTERS = re.compile(r"[^\W\d_]+")
UNKNOWN = "und"
GRAMS, AFFIX = (2, 3, 4), 5  # an affix is a gram that touches the mark before or after the word
CACHE = 300_000
_MIX = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str | None) -> list[str]:
    """Lower-cased words of a whole text."""
    return LETTERS.findall(text.lower()) if text else []


def grams(words: list[str], buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashed features of all words one after another, and how many each word has."""
    marked = "".join(f"\x02{w}\x03" for w in words)
    codes = np.frombuffer(marked.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    lengths = np.fromiter(map(len, words), np.int64, len(words)) + 2
    owner = np.repeat(np.arange(len(words)), lengths)
    ends = np.repeat(np.cumsum(lengths), lengths)
    at = np.arange(len(codes))
    value = codes.copy()
    feature, of = [], []
    for n in range(2, AFFIX + 1):
        value = value[:-1] * _MIX + codes[n - 1:] if len(value) > 1 else value[:0]
        inside = at[:len(value)] + n <= ends[:len(value)]
        if n not in GRAMS:
            first = codes[:len(value)] == 2
            last = codes[n - 1:] == 3
            inside &= first | last
        rows = np.flatnonzero(inside)
        mixed = value[rows] ^ (value[rows] >> np.uint64(29))
        feature.append((mixed * _MIX >> np.uint64(20)) % np.uint64(buckets))
        of.append(owner[rows])
    feature, of = np.concatenate(feature).astype(np.int64), np.concatenate(of)
    order = np.argsort(of, kind="stable")
    return feature[order], np.bincount(of, minlength=len(words))


@dataclass
class Field:
    """Weights of the random field; lexicon weights follow the hashed ones, one row for each language's list."""

    languages: list[str]
    buckets: int
    lexicon: dict[str, list[int]]
    weights: np.ndarray | None = None  # (buckets + languages, languages)
    moves: np.ndarray | None = None  # log weights from language (row) to language; the last row starts a text
    cache: dict[str, int] = field(default_factory=dict)
    scores: np.ndarray | None = None

    def __post_init__(self):
        k = len(self.languages)
        if self.weights is None:
            self.weights = np.zeros((self.buckets + k, k), np.float32)
            self.moves = np.zeros((k + 1, k), np.float32)

    def features(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Feature rows of all words and how many each has, lexicon lists included."""
        rows, many = grams(words, self.buckets)
        listed = [(k, self.buckets + l) for k, w in enumerate(words) for l in self.lexicon.get(w, ())]
        if not listed:
            return rows, many
        of, extra = (np.array(c) for c in zip(*listed))
        rows = np.insert(rows, np.cumsum(many)[of], extra)
        return rows, many + np.bincount(of, minlength=len(words))

    def emissions(self, words: list[str]) -> np.ndarray:
        """Scores of distinct words, a row each."""
        out = np.empty((len(words), len(self.languages)), np.float32)
        for at in range(0, len(words), 20_000):
            rows, many = self.features(words[at:at + 20_000])
            out[at:at + 20_000] = np.add.reduceat(self.weights[rows], np.cumsum(many) - many, axis=0)
        return out

    def look_up(self, words: list[str]) -> np.ndarray:
        """Rows of ``scores`` of the words; new ones are scored once."""
        known = self.cache
        rows = np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, len(words))
        have = 0 if self.scores is None else len(self.scores)
        if len(known) > have:
            fresh = self.emissions(list(known)[have:])
            self.scores = fresh if have == 0 else np.concatenate([self.scores, fresh])
        return rows

    def forget(self) -> None:
        if len(self.cache) > CACHE:
            self.cache, self.scores = {}, None


def _norm(x: np.ndarray) -> np.ndarray:
    return x / x.sum(axis=1, keepdims=True)


def marginals(emission: np.ndarray, lengths: np.ndarray, moves: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Forward-backward over several sequences at once.

    ``emission`` holds log scores of the sequences one after another, ``lengths`` descending.  Returns the
    probabilities of each word in the same order; the expected moves of all sequences; the first words' probabilities.
    """
    k = emission.shape[1]
    total, steps = len(emission), int(lengths[0])
    rank = np.repeat(np.arange(len(lengths)), lengths)
    step = np.arange(total) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    active = len(lengths) - np.searchsorted(np.sort(lengths), np.arange(steps), "right")
    offset = np.r_[0, np.cumsum(active)]
    at = offset[step] + rank  # words by step, sequences still running first
    like = np.empty((total, k))
    like[at] = np.exp(emission - emission.max(axis=1, keepdims=True)) + 1e-30
    go, start = np.exp(moves[:k].astype(float)), np.exp(moves[k].astype(float))
    forward = np.empty((total, k))
    forward[:active[0]] = _norm(like[:active[0]] * start)
    for t in range(1, steps):
        a, b, n = offset[t], offset[t + 1], active[t]
        forward[a:b] = _norm((forward[offset[t - 1]:offset[t - 1] + n] @ go) * like[a:b])
    back, moved = np.ones((active[-1], k)), np.zeros((k, k))
    out = np.empty((total, k))
    for t in range(steps - 1, -1, -1):
        a, b = offset[t], offset[t + 1]
        out[a:b] = _norm(forward[a:b] * back)
        if t:
            ahead = like[a:b] * back
            before = forward[offset[t - 1]:offset[t - 1] + active[t]]
            pair = before.T @ (ahead / ((before @ go) * ahead).sum(axis=1, keepdims=True))
            moved += pair * go
            back = np.ones((active[t - 1], k))
            back[:len(ahead)] = _norm(ahead @ go.T)
    return out[at], moved, out[:active[0]]


def learn(model: Field, sequences: list[tuple[list[str], np.ndarray]], rate: float = 0.2, decay: float = 1e-4, at_once: int = 24) -> None:
    """One pass of adaptive gradient steps over labelled sequences (words, languages)."""
    k = len(model.languages)
    seen, seen_moves = np.full(model.weights.shape, 1e-2, np.float32), np.full(model.moves.shape, 1.0, np.float32)
    for first in range(0, len(sequences), at_once):
        part = sorted(sequences[first:first + at_once], key=lambda s: -len(s[0]))
        words = [w for ws, _ in part for w in ws]
        lengths = np.array([len(ws) for ws, _ in part])
        labels = np.concatenate([ls for _, ls in part])
        rows, many = model.features(words)
        emission = np.add.reduceat(model.weights[rows], np.cumsum(many) - many, axis=0)
        expected, moved, begun = marginals(emission, lengths, model.moves)
        expected[np.arange(len(labels)), labels] -= 1
        used, place = np.unique(rows, return_inverse=True)
        each = np.repeat(expected, many, axis=0)
        grad = np.stack([np.bincount(place, each[:, j], len(used)) for j in range(k)], axis=1).astype(np.float32)
        grad = grad + decay * model.weights[used]
        seen[used] += grad ** 2
        model.weights[used] -= rate * grad / np.sqrt(seen[used])
        firsts = np.cumsum(lengths) - lengths
        inner = np.ones(len(labels), bool)
        inner[firsts] = False
        to = np.flatnonzero(inner)
        gone = np.zeros((k + 1, k))
        gone[:k] = moved
        gone[k] = begun.sum(axis=0)
        np.subtract.at(gone, (labels[to - 1], labels[to]), 1)
        np.subtract.at(gone, (np.full(len(firsts), k), labels[firsts]), 1)
        gone = (gone + decay * model.moves).astype(np.float32)
        seen_moves += gone ** 2
        model.moves -= rate * gone / np.sqrt(seen_moves)


def sequences_of(windows: list[tuple[list[str], int]], length: int, rng: random.Random) -> list[tuple[list[str], np.ndarray]]:
    """Sequences of ``length`` words that switch between pieces of windows; every word of the windows is used once."""
    pieces = []
    for words, label in windows:
        at = 0
        while at < len(words):
            n = rng.randint(3, length)
            pieces.append((words[at:at + n], label))
            at += n
    rng.shuffle(pieces)
    words = [w for ws, _ in pieces for w in ws]
    labels = np.array([l for ws, l in pieces for _ in ws], np.int64)
    return [(words[k:k + length], labels[k:k + length]) for k in range(0, len(words), length)]


def _blob(array: np.ndarray, block: int):
    flat = array.astype(np.float32).ravel()
    for at in range(0, len(flat), block):
        yield at // block, flat[at:at + block].tobytes()


def fit(train: DataFrame, per_language: int = 300, windows: int = 4, window: int = 48, lexicon: int = 1000,
        buckets: int = 1 << 16, rounds: int = 4, shards: int = 8, seed: int = 17) -> Field | None:
    """A field from labelled rows (doc_id, text, lang); None without any.  The bounds of the sample stand above."""
    usable = (train.filter(F.col("lang").isNotNull() & (F.col("lang") != UNKNOWN) & F.col("doc_id").isNotNull() & F.col("text").rlike(r"\p{L}"))
              .select("lang", "text", F.xxhash64(F.col("doc_id").cast("string"), "text", F.lit(seed)).alias("_h")))
    ranked = usable.select("lang", "_h").distinct().withColumn("_r", F.row_number().over(Window.partitionBy("lang").orderBy("_h")))
    last = {r["lang"]: r["h"] for r in ranked.filter(F.col("_r") <= per_language).groupBy("lang").agg(F.max("_h").alias("h")).collect()}
    if not last:
        return None
    bound = F.create_map(*[F.lit(v) for pair in last.items() for v in pair])
    taken = usable.filter(F.col("_h") <= bound[F.col("lang")])

    def cut(batches):
        for batch in batches:
            h, lang, found = [], [], []
            for key, name, text in zip(*[batch.column(c).to_pylist() for c in ("_h", "lang", "text")]):
                words, rng = words_of(text), random.Random(key)
                if not words:
                    continue
                if len(words) <= windows * window:
                    parts = [words[k:k + window] for k in range(0, len(words), window)]
                else:
                    parts = [words[k:k + window] for k in (rng.randrange(len(words) - window + 1) for _ in range(windows))]
                h += [key] * len(parts)
                lang += [name] * len(parts)
                found += parts
            yield pa.RecordBatch.from_arrays([pa.array(h, pa.int64()), pa.array(lang, pa.string()), pa.array(found, pa.list_(pa.string()))],
                                             names=["h", "lang", "words"])

    sample = stored(taken.mapInArrow(cut, "h bigint, lang string, words array<string>").distinct(), "windows")
    languages = sorted(r["lang"] for r in sample.select("lang").distinct().collect())
    if not languages:
        return None
    often = (sample.select("lang", F.explode("words").alias("word")).groupBy("lang", "word").agg(F.count("*").alias("n")).filter("n > 1")
             .withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "word"))).filter(F.col("r") <= lexicon))
    listed: dict[str, list[int]] = {}
    for r in often.select("word", "lang").collect():
        listed.setdefault(r["word"], []).append(languages.index(r["lang"]))
    model = Field(languages, buckets, listed)
    dealt = stored(sample.withColumn("shard", F.pmod(F.xxhash64("h", "words"), F.lit(shards)).cast("int")), "shards")
    block = 1 << 16

    def passed(round_: int, start: Field):
        def run(key, pdf):
            pdf = pdf.sort_values(["h", "lang"], kind="stable")
            rng = random.Random(f"{seed}:{round_}:{key[0]}")
            given = sorted((list(w), languages.index(l)) for w, l in zip(pdf["words"], pdf["lang"]))
            own = Field(languages, buckets, listed, start.weights.copy(), start.moves.copy())
            learn(own, sequences_of(given, window, rng), rate=0.2 / (1 + round_))
            rows = list(_blob(np.concatenate([own.weights.ravel(), own.moves.ravel()]), block))
            return pd.DataFrame({"shard": key[0], "block": [k for k, _ in rows], "part": [p for _, p in rows]})
        return run

    def mean(pdf):
        parts = [np.frombuffer(p, np.float32) for p in pdf.sort_values("shard")["part"]]
        return pd.DataFrame({"block": pdf["block"][:1], "part": [np.mean(parts, axis=0, dtype=np.float64).astype(np.float32).tobytes()]})

    for round_ in range(rounds):
        parts = dealt.groupBy("shard").applyInPandas(passed(round_, model), "shard int, block int, part binary")
        rows = parts.groupBy("block").applyInPandas(mean, "block int, part binary").orderBy("block").collect()
        flat = np.frombuffer(b"".join(r["part"] for r in rows), np.float32)
        size = model.weights.size
        model = Field(languages, buckets, listed, flat[:size].reshape(model.weights.shape).copy(), flat[size:].reshape(model.moves.shape).copy())
    return model


def shares(model: Field, texts: list[str | None], at_once: int = 200_000) -> np.ndarray:
    """Share of each language in the words of every text; zeros where a text has no word."""
    out = np.zeros((len(texts), len(model.languages)))
    found, held = [], 0
    for k in sorted(range(len(texts)), key=lambda k: -len(texts[k] or "")):  # texts of like length step together
        words = words_of(texts[k])
        if words:
            found.append((len(words), k, words))
            held += len(words)
            if held >= at_once:
                _shares(model, found, out)
                found, held = [], 0
    _shares(model, found, out)
    return out


def _shares(model: Field, found: list, out: np.ndarray) -> None:
    if not found:
        return
    model.forget()
    found.sort(key=lambda f: -f[0])
    lengths = np.array([n for n, _, _ in found])
    rows = model.look_up([w for _, _, words in found for w in words])
    given, _, _ = marginals(model.scores[rows], lengths, model.moves)
    out[[k for _, k, _ in found]] = np.add.reduceat(given, np.cumsum(lengths) - lengths, axis=0) / lengths[:, None]


def label_words(model: Field, text: str | None) -> list[tuple[str, str, float]]:
    """Word, language and its probability for every word of a text."""
    words = words_of(text)
    if not words:
        return []
    given, _, _ = marginals(model.emissions(words), np.array([len(words)]), model.moves)
    best = given.argmax(axis=1)
    return [(w, model.languages[b], float(g[b])) for w, b, g in zip(words, best, given)]


def learnable(id_col: str = "doc_id", of: int = 4, held: int = 2) -> Column:
    """Rows that may be learned from: the checksum of their id does not leave ``held`` modulo ``of``."""
    return F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(of)) != held


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", **options) -> DataFrame:
    """doc_id, lang_pred, score of every row; learned from the rows that are ``learnable``.  Options as of ``fit``."""
    slim = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"))
    model = fit(slim.filter(learnable("doc_id")), **options)
    kind = slim.schema["doc_id"].dataType.simpleString()

    def run(batches):
        own = model and Field(model.languages, model.buckets, model.lexicon, model.weights, model.moves)
        for batch in batches:
            texts = batch.column("text").to_pylist()
            if own is None:
                names, scores = [UNKNOWN] * len(texts), np.zeros(len(texts))
            else:
                share = shares(own, texts)
                best = share.argmax(axis=1)
                scores = np.clip(share[np.arange(len(texts)), best], 0.0, 1.0)
                names = [own.languages[b] if s > 0 else UNKNOWN for b, s in zip(best, scores)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(names, pa.string()), pa.array(scores, pa.float64())],
                                             names=["doc_id", "lang_pred", "score"])

    return slim.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, lang_pred string, score double")
