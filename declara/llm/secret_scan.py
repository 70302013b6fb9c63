"""Secrets in texts: fixed patterns, and formats inferred from labelled credentials.

Base kinds, always reported: ``assign`` (a value given to a password, token, key), ``access`` (AKIA...), ``hex``
(32 and more lower-case hex digits).  From labelled credentials a probabilistic automaton per kind is learned by
merging statistically compatible states of their prefix tree; every other token of ``SHORTEST`` and more characters, the
least that the automata learn from, is scored by its likelihood under each automaton against ordinary words of the corpus.
It is reported as ``format_<kind>`` where it gains at least ``accept`` bits per character, and ``FEW * accept`` bits in
all: a short token must gain more per character.  What its characters are does not matter otherwise.

* A first pass over the texts keeps the values of base spans and counts the character pairs of all ordinary words and
  numbers (runs without white space outside base spans that are letters only, or digits and signs only, once punctuation
  around them is cut off).  A candidate of digits and signs is measured against numbers, any other one against words, so a
  hexadecimal format does not win over a plain number.  The counts are added up by pair;
  characters that no candidate holds count as one, so their table is bounded by the alphabet.  A second pass finds and scores.
* The automata learn from a bounded sample: the ``train`` distinct labelled values of each kind (of at most ``longest``
  characters) whose hash is smallest.  Only these and the table of pairs reach the driver.  Word statistics, search and
  scoring cover all texts and all candidates.

Defined results: null text is empty; positions count code points, ends are exclusive; without labelled values no
span is added; repeated rows and null ids are kept; an empty table gives no rows.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from functools import lru_cache
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from declara.llm.automata import Automaton, Background
from declara.session import stored

# The patterns of the base kinds, and what a candidate is made of.
ASSIGN = re.compile(r"""(?ai:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
SHORTEST, FEW = 8, 16
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=.-]{%d,}" % SHORTEST)
SIGNS = "+/_=.-"
NUMBER = frozenset("0123456789" + SIGNS)
PLAIN = frozenset("\nABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789" + SIGNS)
_NO_SIGNS = str.maketrans("", "", SIGNS)
AROUND = ".,;:!?()[]{}<>\"'"
KEYWORDS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")
KINDS = ["assign", "access", "hex"]

_READ = pa.schema([("kind", pa.list_(pa.string())), ("value", pa.list_(pa.string())), ("pair", pa.list_(pa.string())),
                   ("times", pa.list_(pa.int64()))])
_FOUND = pa.schema([("kind", pa.list_(pa.string())), ("start", pa.list_(pa.int64())), ("end", pa.list_(pa.int64()))])


def base_spans(text: str) -> list[tuple[int, int, int, str]]:
    """start, order of the kind, end, secret value; by start, then kind."""
    found = []
    low = text.encode("utf-8", "surrogatepass").lower()
    if any(k in low for k in KEYWORDS):
        found += [(m.start(), 0, m.end(), m[1]) for m in ASSIGN.finditer(text) if len(m[1]) >= 8]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end(), m[0]) for m in ACCESS.finditer(text) if len(m[0]) >= 16]
    found += [(m.start(), 2, m.end(), m[0]) for m in HEX.finditer(text)]
    return sorted(found)


def candidates(text: str, taken: list[tuple[int, int, int, str]]) -> list[tuple[int, int, str]]:
    """Tokens of ``SHORTEST`` and more characters that touch no base span."""
    starts = [t[0] for t in taken]
    reach = list(accumulate((t[2] for t in taken), max))
    out = []
    for m in CANDIDATE.finditer(text):
        before = bisect_left(starts, m.end())
        if before and reach[before - 1] > m.start():
            continue
        out.append((m.start(), m.end(), m[0]))
    return out


def word_pairs(texts: list[str]) -> Counter:
    """Character pairs of all ordinary words and numbers of whole texts, each as often as it stands there.

    Numbers count too: a format of hexadecimal digits must not win over a plain run of digits.
    """
    words: Counter = Counter()
    for text in texts:
        words.update(text.split())
    plain: Counter = Counter()
    for word, times in words.items():
        word = word.strip(AROUND)
        if word.isalpha() or word.translate(_NO_SIGNS).isdigit():
            plain[word] += times
    pairs: Counter = Counter()
    for word, times in plain.items():
        if not PLAIN.issuperset(word):
            word = "".join(c if c in PLAIN else "*" for c in word)
        for a, b in zip("\n" + word, word):
            pairs[a + b] += times
    return pairs


def _read(batches):
    for batch in batches:
        texts = [t or "" for t in batch.column("text").to_pylist()]
        rows, plain = [], []
        for text in texts:
            base, at = base_spans(text), 0
            if base:
                rows.append({"kind": [KINDS[b[1]] for b in base], "value": [b[3] for b in base], "pair": [], "times": []})
            for start, _, end, _ in base:
                plain.append(text[at:max(at, start)])
                at = max(at, end)
            plain.append(text[at:])
        pairs = word_pairs(plain)
        rows.append({"kind": [], "value": [], "pair": list(pairs.keys()), "times": list(pairs.values())})
        table = pa.Table.from_pylist(rows, _READ).combine_chunks()
        yield pa.RecordBatch.from_arrays([_whole(table.column(n)) for n in _READ.names], names=_READ.names)


def _whole(column: pa.ChunkedArray) -> pa.Array:
    return pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)


def _smallest(values: DataFrame, n: int) -> list[str]:
    """The n distinct values of the smallest hash."""
    rows = values.distinct().orderBy(F.xxhash64("value"), "value").limit(n).collect()
    return [r["value"] for r in rows]


def learn(read: DataFrame, labelled: DataFrame | None = None, train: int = 1000, longest: int = 128):
    """Automata by kind from labelled values (default: what the base patterns found), and what words and numbers are like."""
    if labelled is None:
        labelled = read.select(F.explode(F.arrays_zip("kind", "value")).alias("x")).select("x.kind", "x.value")
    short = labelled.filter(F.length("value").between(8, longest))
    models = {}
    for kind in KINDS:
        values = _smallest(short.filter(F.col("kind") == kind).select("value"), train)
        if values:
            models[kind] = Automaton(values)
    pairs = (read.select(F.explode(F.arrays_zip("pair", "times")).alias("x")).groupBy("x.pair")
             .agg(F.sum("x.times").alias("times")).collect()) if models else []
    counts = {(r["pair"][0], r["pair"][1]): r["times"] for r in pairs}
    numbers = {p: k for p, k in counts.items() if p[1] in NUMBER}
    return models, Background({p: k for p, k in counts.items() if p not in numbers}), Background(numbers)


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", accept: float = 1.0,
                 labelled: DataFrame | None = None, train: int = 1000) -> DataFrame:
    """doc_id and ``spans``: kind, start, end of every secret, by start, then kind as listed, added kinds last."""
    slim = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    id_type = slim.schema["doc_id"].dataType.simpleString()
    read = stored(slim.select("text").mapInArrow(_read, "kind array<string>, value array<string>, pair array<string>, "
                                                        "times array<bigint>"), "secrets")
    models, ordinary, numbers = learn(read, labelled, train)

    def score(batches):
        @lru_cache(maxsize=1 << 16)
        def format_of(token: str) -> str | None:
            usual = (numbers if NUMBER.issuperset(token) else ordinary).bits(token)
            need = accept * max(len(token), FEW)
            if need + usual > 0:  # no likelihood is above 1
                return None
            gain, kind = max((m.bits(token) - usual, k) for k, m in models.items())
            return f"format_{kind}" if gain >= need else None

        for batch in batches:
            rows = []
            for text in batch.column("text").to_pylist():
                text = text or ""
                base = base_spans(text)
                found = [(KINDS[k], a, b) for a, k, b, _ in base]
                if models:
                    found += [(kind, a, b) for a, b, token in candidates(text, base) if (kind := format_of(token))]
                rows.append({"kind": [f[0] for f in found], "start": [f[1] for f in found], "end": [f[2] for f in found]})
            table = pa.Table.from_pylist(rows, _FOUND).combine_chunks()
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *[_whole(table.column(n)) for n in _FOUND.names]],
                                             names=["doc_id", *_FOUND.names])

    scored = slim.mapInArrow(score, f"doc_id {id_type}, kind array<string>, start array<bigint>, end array<bigint>")

    def order(kind: Column) -> Column:
        return F.array_position(F.array(*[F.lit(k) for k in [*KINDS, *(f"format_{k}" for k in KINDS)]]), kind)

    spans = F.transform(F.arrays_zip("kind", "start", "end"), lambda s: F.struct(
        s["start"].alias("start"), order(s["kind"]).alias("order"), s["end"].alias("end"), s["kind"].alias("kind")))
    return scored.select("doc_id", F.array_sort(spans).alias("spans"))
