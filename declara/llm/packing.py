"""Packing documents into sequences: Martello-Toth reduction, then best fit, on counts of equal lengths.

Documents are tokenised and cut into pieces of at most ``capacity`` tokens.  A piece matters to the packing only by
its length, so the whole instance is a table of at most ``capacity`` counts, whatever the corpus: that is all the
driver sees.  Reduction fixes sets of up to three lengths that provably dominate every other way to fill up the
longest piece (such a set occurs in some best packing), as often as counts allow.  The rest is packed best fit,
longest first, many equal sequences at a time.  The outcome is a list of patterns with their number of sequences.

Pieces find their place by their rank among the pieces of equal length.  Ranks come from windows over length and a
hash bucket of about ``bucket`` pieces, and from the counts of the buckets before, so a hot length is split.

Tokens: every stretch between white space is encoded by the tokenizer once per worker and kept in a bounded cache;
the tokenizer (one that drops white space, separates letters from marks and lower-cases) never looks across these
borders, so the ids are those of the whole text.

Defined results: null text is empty and gives the end id alone; repeated rows and null ids are packed like others; an
empty table gives no rows.
"""

from __future__ import annotations

import os
import zlib
from array import array
from bisect import bisect_left, bisect_right
from collections import Counter
from unicodedata import is_normalized

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from declara.session import stored

#: Marks that end a word without reaching into it, whatever stands before them.
_TAIL = ".,!?;:*#$%&|()\"-"
_encoders: dict[str, tuple] = {}


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _byte_letters() -> list[str]:
    """Byte-level vocabularies write visible Latin-1 bytes as themselves and the others as U+0100 and up, in order."""
    visible = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return [chr(b) if b in visible else chr(next(others)) for b in range(256)]


_LETTERS = _byte_letters()


def _encoder(path: str) -> tuple:
    """The tokenizer, and the ids of words and other parts of texts met so far."""
    if path not in _encoders:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        _encoders[path] = Tokenizer.from_file(path), {}
    return _encoders[path]


def _plain(word: str) -> bool:
    """Whether a word is Latin letters that normalisation only lower-cases, one to one."""
    return word.isalpha() and (word.isascii() or (max(word) < "\u0250" and "\u0130" not in word
                                                  and is_normalized("NFC", word)))


def _parts(stretch: str) -> tuple[str, str]:
    """A stretch as word and trailing marks, which the tokenizer separates anyway; plain words lower-cased."""
    bare = stretch.rstrip(_TAIL)
    if bare and bare[-1] < "\u0250" and bare[-1].isalpha():
        return bare.lower() if _plain(bare) else bare, stretch[len(bare):]
    return stretch, ""


def _ids_of(stretches: list[str], path: str, most: int) -> list[bytes]:
    """Ids of distinct stretches; ``most`` bounds what is kept for later."""
    encoder, known = _encoder(path)
    if len(known) > most:
        known.clear()
    both = [_parts(s) for s in stretches]
    tokenize, other = encoder.model.tokenize, []
    for p in {p for pair in both for p in pair}:
        if p in known:
            continue
        if _plain(p):  # nothing to normalise or split
            spelt = p if p.isascii() else "".join([_LETTERS[b] for b in p.encode()])
            known[p] = array("I", [t.id for t in tokenize(spelt)]).tobytes()
        else:
            other.append(p)
    for at in range(0, len(other), 20_000):
        some = other[at:at + 20_000]
        for p, e in zip(some, encoder.encode_batch_fast(some, add_special_tokens=False)):
            known[p] = array("I", e.ids).tobytes()
    return [known[a] + known[b] if b else known[a] for a, b in both]


def encode(texts: pa.Array, path: str, most: int = 600_000) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts in one array, and where each text starts (one more entry than texts)."""
    words = pc.ascii_split_whitespace(texts.fill_null(""))
    coded = words.flatten().dictionary_encode()
    ids = _ids_of(coded.dictionary.to_pylist(), path, most)
    pool = np.frombuffer(b"".join(ids), np.uint32)
    lengths = np.array([len(i) for i in ids], np.int64) // 4
    first = np.cumsum(lengths) - lengths
    index = coded.indices.to_numpy()
    counts = lengths[index]
    reach = np.concatenate([[0], np.cumsum(counts)])
    all_ids = pool[np.repeat(first[index] - reach[:-1], counts) + np.arange(reach[-1])]
    borders = words.offsets.to_numpy() - words.offsets[0].as_py() if len(words) else np.zeros(1, int)
    return all_ids.astype("<u4"), reach[borders]


def _slices(texts: pa.Array, most: int = 3_000_000):
    """Neighbouring texts of about ``most`` bytes together; a longer text stands alone."""
    at, held = 0, 0
    for i, n in enumerate(pc.binary_length(texts).fill_null(0).to_pylist()):
        if held and held + n > most:
            yield at, i - at
            at, held = i, 0
        held += n
    yield at, len(texts) - at


def pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = 4096,
           tokenizer: str | None = None, end_id: int = 1) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every piece of every document."""
    slim = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kind = slim.schema["doc_id"].dataType.simpleString()
    end = np.array([end_id], "<u4").tobytes()

    def run(batches):
        path = tokenizer or default_tokenizer()
        for batch in batches:
            for at, n in _slices(batch.column("text")):
                part = batch.slice(at, n)
                ids, borders = encode(part.column("text"), path)
                rows, piece, start, length, crc = [], [], [], [], []
                for i in range(n):
                    own = ids[borders[i]:borders[i + 1]].tobytes() + end
                    for p, b in enumerate(range(0, len(own), 4 * capacity)):
                        cut = own[b:b + 4 * capacity]
                        rows.append(i)
                        piece.append(p)
                        start.append(b // 4)
                        length.append(len(cut) // 4)
                        crc.append(zlib.crc32(cut))
                yield pa.RecordBatch.from_arrays([
                    part.column("doc_id").take(pa.array(rows, pa.int64())), pa.array(piece, pa.int32()),
                    pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())],
                    names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return slim.mapInArrow(run, f"doc_id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint")


class _Counts:
    """Lengths that are left, in order, with their numbers."""

    def __init__(self, counts: dict[int, int]):
        self.n = {k: v for k, v in counts.items() if v > 0}
        self.sizes = sorted(self.n)

    def take(self, lengths: list[int], times: int) -> None:
        for size, k in Counter(lengths).items():
            self.n[size] -= k * times
            if not self.n[size]:
                del self.n[size]
                self.sizes.pop(bisect_left(self.sizes, size))

    def largest(self, limit: int, used: list[int]) -> int:
        """The largest length up to ``limit`` of which one is left beside ``used``; 0 if none."""
        at = bisect_right(self.sizes, limit)
        while at:
            size = self.sizes[at - 1]
            if self.n[size] > used.count(size):
                return size
            at -= 1
        return 0

    def smallest(self, k: int, used: list[int]) -> list[int]:
        out: list[int] = []
        for size in self.sizes:
            out += [size] * min(k - len(out), self.n[size] - used.count(size))
            if len(out) >= k:
                break
        return out


def reduced(left: _Counts, capacity: int) -> list[tuple[int, list[int]]]:
    """Sets that dominate, with their number; takes them out of ``left``.

    For the longest length j and room r beside it, k is the longest that fits:
    j alone if nothing fits; {j, k} if k fills the room, if no two others fit, or if no three fit and k is at
    least as long as any two that fit; {j, k, b} if no three fit, b is the longest beside k, and no two that fit
    have a second longer than b.
    """
    fixed = []
    for j in reversed(list(left.sizes)):
        while left.n.get(j):
            room = capacity - j
            k = left.largest(room, [j])
            if not k:
                chosen = [j]
            else:
                low = left.smallest(3, [j])
                chosen = [j, k] if k == room or len(low) < 2 or low[0] + low[1] > room else []
                if not chosen and (len(low) < 3 or sum(low) > room):
                    second = left.largest(room // 2, [j])
                    pair = max((s + left.largest(room - s, [j, s]) for s in left.sizes[:bisect_right(left.sizes, room)]
                                if left.n[s] > (s == j) and left.largest(room - s, [j, s])), default=0)
                    b = left.largest(room - k, [j, k])
                    chosen = [j, k] if k >= pair else [j, k, b] if b and b >= second else []
            if not chosen:
                break
            times = min(left.n[s] // m for s, m in Counter(chosen).items())
            left.take(chosen, times)
            fixed.append((times, chosen))
    return fixed


def best_fit(left: _Counts, capacity: int) -> list[tuple[int, list[int]]]:
    """Patterns of sequences that hold all that is left: longest first, each where the least room remains."""
    rooms: dict[int, list[tuple[int, tuple]]] = {}  # sequences alike: how many, and (length, copies, what came before)
    order: list[int] = []

    def put(room: int, times: int, pattern: tuple) -> None:
        if times:
            if room not in rooms:
                rooms[room] = []
                order.insert(bisect_left(order, room), room)
            rooms[room].append((times, pattern))

    for size in reversed(left.sizes):
        n = left.n[size]
        while n:
            at = bisect_left(order, size)
            if at == len(order):
                room, times, pattern = capacity, n, ()
            else:
                room = order[at]
                times, pattern = rooms[room].pop()
                if not rooms[room]:
                    del rooms[room]
                    order.pop(at)
            copies = room // size
            full = min(times, n // copies)
            put(room - full // max(full, 1) * copies * size, full, (size, copies, pattern))
            n -= full * copies
            rest = times - full
            if rest and n and n < copies:
                put(room - n * size, 1, (size, n, pattern))
                n, rest = 0, rest - 1
            if pattern:
                put(room, rest, pattern)
    out = []
    for groups in rooms.values():
        for times, pattern in groups:
            lengths = []
            while pattern:
                lengths += [pattern[0]] * pattern[1]
                pattern = pattern[2]
            out.append((times, lengths))
    return out


def patterns(counts: dict[int, int], capacity: int) -> list[tuple[int, list[int]]]:
    left = _Counts(counts)
    return reduced(left, capacity) + best_fit(left, capacity)


def slots(found: list[tuple[int, list[int]]]) -> dict[int, dict[str, np.ndarray]]:
    """By length: from which rank on a piece goes to which sequences, how many per sequence, and where in them."""
    rows: dict[int, list[tuple[int, int, int, int]]] = {}
    filled: Counter = Counter()
    base = 0
    for times, lengths in found:
        offset = 0
        for size, copies in sorted(Counter(lengths).items(), reverse=True):
            rows.setdefault(size, []).append((filled[size], base, copies, offset))
            filled[size] += times * copies
            offset += copies * size
        base += times
    return {size: dict(zip(("rank", "base", "copies", "offset"), np.array(r, np.int64).T)) for size, r in rows.items()}


def pack(cut: DataFrame, capacity: int = 4096, bucket: int = 50_000) -> DataFrame:
    """``cut`` (columns of ``pieces``) with sequence_id and offset."""
    spark = cut.sparkSession
    cut = stored(cut, "pieces")
    counts = {r["length"]: r["count"] for r in cut.groupBy("length").count().collect()}
    table = slots(patterns(counts, capacity))
    buckets = max(1, -(-sum(counts.values()) // bucket))
    dealt = cut.withColumn("_b", F.pmod(F.xxhash64("doc_id", "piece", "start", "ids_crc32"), F.lit(buckets)))
    before = (dealt.groupBy("length", "_b").agg(F.count("*").alias("_n"))
              .withColumn("_first", F.sum("_n").over(Window.partitionBy("length").orderBy("_b")) - F.col("_n")).drop("_n"))
    own = F.row_number().over(Window.partitionBy("length", "_b").orderBy("doc_id", "piece", "ids_crc32")) - 1
    ranked = (dealt.withColumn("_own", own).join(before, ["length", "_b"])
              .select(*cut.columns, (F.col("_own") + F.col("_first")).cast("bigint").alias("rank")))
    names = cut.columns
    shared = spark.sparkContext.broadcast(table)  # at most one entry per length and pattern

    def place(batches):
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            sequence, offset = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
            for size in np.unique(length):
                rows = np.flatnonzero(length == size)
                t = shared.value[int(size)]
                at = np.searchsorted(t["rank"], rank[rows], side="right") - 1
                local = rank[rows] - t["rank"][at]
                sequence[rows] = t["base"][at] + local // t["copies"][at]
                offset[rows] = t["offset"][at] + local % t["copies"][at] * size
            columns = {c: batch.column(c) for c in names} | {
                "sequence_id": pa.array(sequence), "offset": pa.array(offset)}
            yield pa.RecordBatch.from_pydict(columns)

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in cut.schema.fields)
    return ranked.mapInArrow(place, f"{kinds}, sequence_id bigint, offset bigint")
