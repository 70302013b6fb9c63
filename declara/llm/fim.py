"""Fill-in-middle texts, assembled by a secondary sort.

A text is cut into units (white space before a word belongs to it) and at two seeded places into prefix, middle and
suffix.  Every document gives pieces: chunks of whole units (only a unit longer than a chunk is cut, between code
points), keyed by document and place in the output, with marks as pieces of their own.  One shuffle by document and a
sort by place inside each partition (``repartition`` and ``sortWithinPartitions``, the DataFrame form of
repartitionAndSortWithinPartitions) bring the pieces in output order; they are streamed, never joined, into a digest.
The same stream is parsed at its marks, as a reader of the output would; its pieces are sorted again, by their place in
the restored text and inside the same partition, and streamed into a second digest.

The key also holds the task that cut the document, so a row that is repeated very often spreads over as many keys as
there are tasks; repeats within a task are counted, not emitted.

Defined results: null text is empty; a null id counts as an empty string in the seed; a repeated row is transformed
alike, once per row; texts of any length are streamed in chunks; an empty table gives no rows; other columns are not
read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MARKS = {"prefix": b"<P>", "suffix": b"<S>", "middle": b"<M>"}
#: Order of the parts in the output, and of the parts in the text.
FORMS = {"plain": ("text",), "psm": ("prefix", "suffix", "middle"), "spm": ("suffix", "prefix", "middle")}
IN_TEXT = ("text", "prefix", "middle", "suffix")
REPEATS = 100_000

_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
_FIELDS = "hi bigint, lo bigint, part int, place int, copies bigint, doc_id {kind}, n bigint, form string, prefix_chars bigint, middle_chars bigint, piece binary, output_sha256 string"


def unit_ends(raw: np.ndarray) -> np.ndarray:
    """Where the units of a text (its UTF-8 bytes) end."""
    space = _SPACE[raw]
    if not len(raw):
        return np.zeros(0, np.int64)
    ends = np.flatnonzero(~space & np.r_[space[1:], True]) + 1
    return np.r_[ends, len(raw)] if space[-1] else ends


def characters(raw: np.ndarray) -> int:
    """Code points of UTF-8 bytes."""
    return int(np.count_nonzero((raw & 0xC0) != 0x80))


def draws(doc_id: object, seed: int) -> list[int]:
    """The four seeded numbers of a document."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(digest[k:k + 8], 16) for k in range(0, 32, 8)]


def chunks(start: int, stop: int, ends: np.ndarray, raw: np.ndarray, size: int) -> Iterator[tuple[int, int]]:
    """Cut start..stop into pieces of at most ``size`` bytes at ends of units; longer units between code points."""
    while stop - start > size:
        at = int(np.searchsorted(ends, start + size, "right")) - 1
        cut = int(ends[at]) if at >= 0 else 0
        if cut <= start:
            cut = start + size
            while cut > start + 1 and raw[cut] & 0xC0 == 0x80:
                cut -= 1
        yield start, cut
        start = cut
    if stop > start:
        yield start, stop


def cut_document(doc_id: object, text: bytes, seed: int, rate: int, spm_rate: int, size: int):
    """Form, number of units, code points of prefix and middle (None if plain), and the pieces in output order."""
    raw = np.frombuffer(text, np.uint8)
    ends = unit_ends(raw)
    n = len(ends)
    h = draws(doc_id, seed)
    if not n or h[2] % 100 >= rate or any(m in text for m in MARKS.values()):
        return "plain", n, None, None, [text[a:b] for a, b in chunks(0, len(text), ends, raw, size)]
    first, second = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    places = np.r_[0, ends]
    a, b = int(places[first]), int(places[second])
    spans = {"prefix": (0, a), "middle": (a, b), "suffix": (b, len(text))}
    form = "spm" if h[3] % 100 < spm_rate else "psm"
    pieces = []
    for name in FORMS[form]:
        pieces.append(MARKS[name])
        pieces += [text[x:y] for x, y in chunks(*spans[name], ends, raw, size)]
    return form, n, characters(raw[:a]), characters(raw[a:b]), pieces


def split_piece(piece: bytes, form: str, current: str) -> tuple[str, list[tuple[str, bytes]]]:
    """Parts of the text in one piece of an output, and the part that goes on after it."""
    if form == "plain":
        return "text", [("text", piece)]
    found, order = [], FORMS[form]
    while True:
        after = order.index(current) + 1 if current else 0
        at = piece.find(MARKS[order[after]]) if after < len(order) else -1
        if at < 0:
            return current, [*found, (current, piece)] if piece else found
        if at:
            found.append((current, piece[:at]))
        current, piece = order[after], piece[at + 3:]


def restore(output: str, form: str) -> str:
    """The text behind one whole output."""
    _, parts = split_piece(output.encode("utf-8", "surrogatepass"), form, "")
    return b"".join(b for name in IN_TEXT for p, b in parts if p == name).decode("utf-8", "surrogatepass")


def pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = 42, rate: int = 50,
           spm_rate: int = 80, chunk: int = 32_768) -> DataFrame:
    """Pieces of all outputs: key (hi, lo), place, piece (UTF-8); the first piece of a document carries its id, form,
    unit and character counts and how often the row occurs in the task that cut it (``copies``).

    ``rate`` of 100 documents are transformed, ``spm_rate`` of 100 of these with the suffix first; ``chunk`` bounds
    the bytes of a piece.
    """
    if chunk < 8:
        raise ValueError("a piece has 8 bytes at least")
    slim = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").cast("binary").alias("text"))
    fields = _FIELDS.format(kind=slim.schema["doc_id"].dataType.simpleString())

    def run(batches):
        task = TaskContext.get().partitionId()
        again: dict[bytes, list] = {}

        def repeats():
            rows = [[*key_of(key), None, 0, k - 1, doc_id, *[None] * 6] for key, (k, doc_id) in again.items() if k > 1]
            again.clear()
            return rows

        for batch in batches:
            rows, held = [], 0
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                text = text or b""
                key = hashlib.sha256(f"{task}:{doc_id!r}:".encode() + text).digest()[:16]
                if key in again:
                    again[key][0] += 1
                    continue
                again[key] = [1, doc_id]
                form, n, before, middle, cut = cut_document(doc_id, text, seed, rate, spm_rate, chunk)
                hi, lo = key_of(key)
                rows.append([hi, lo, None, 0, 1, doc_id, n, form, before, middle, cut[0] if cut else b"", None])
                rows += [[hi, lo, None, k, None, None, None, form, None, None, p, None] for k, p in enumerate(cut) if k]
                held += len(text)
                if held > 8_000_000:
                    yield table(rows, batch.schema.field("doc_id").type)
                    rows, held = [], 0
                if len(again) >= REPEATS:
                    rows += repeats()
            yield table(rows, batch.schema.field("doc_id").type)
        rest = repeats()
        if rest:
            yield table(rest, batch.schema.field("doc_id").type)

    return slim.mapInArrow(run, fields)


def key_of(key: bytes) -> tuple[int, int]:
    return int.from_bytes(key[:8], "little", signed=True), int.from_bytes(key[8:], "little", signed=True)


def table(rows: list[list], id_type: pa.DataType) -> pa.RecordBatch:
    long = pa.int64()
    kinds = [long, long, pa.int32(), pa.int32(), long, id_type, long, pa.string(), long, long, pa.binary(), pa.string()]
    names = ["hi", "lo", "part", "place", "copies", "doc_id", "n", "form", "prefix_chars", "middle_chars", "piece", "output_sha256"]
    columns = list(zip(*rows)) if rows else [()] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)


def in_order(found: DataFrame) -> DataFrame:
    """Pieces side by side per document, in output order: the one shuffle."""
    return found.repartition("hi", "lo").sortWithinPartitions("hi", "lo", "place")


def _documents(batches, columns: list[str]):
    """Rows of sorted batches as tuples, each with its key and whether the key is new."""
    last = None
    for batch in batches:
        for row in zip(*[batch.column(c).to_pylist() for c in ["hi", "lo", *columns]]):
            key = row[:2]
            yield key != last, key, row[2:], batch.schema.field("doc_id").type
            last = key


def assembled(found: DataFrame) -> DataFrame:
    """From ``in_order`` pieces: a row per document (part -1) with the digest of its output, and its restored pieces
    (part: place of their part in the text)."""
    fields = found.schema.simpleString()[7:-1]

    def run(batches):
        rows, held, meta, digest, id_type = [], 0, None, None, None

        def closed():
            meta[-1] = digest.hexdigest()
            return meta

        for new, key, (place, copies, doc_id, n, form, before, middle, piece), id_type in _documents(
                batches, ["place", "copies", "doc_id", "n", "form", "prefix_chars", "middle_chars", "piece"]):
            if new:
                if meta is not None:
                    rows.append(closed())
                meta, digest, part, at, seen = [*key, -1, 0, 0, doc_id, None, None, None, None, None, None], hashlib.sha256(), "", 0, -1
            meta[4] += copies or 0
            if form is None or place == seen:  # a count of repeats, or the same piece again
                continue
            if place == 0:
                meta[6:10] = [n, form, before, middle]
            seen = place
            digest.update(piece)
            part, parts = split_piece(piece, form, part)
            for name, body in parts:
                rows.append([*key, IN_TEXT.index(name), at, None, None, None, None, None, None, body, None])
                at += 1
                held += len(body)
            if held > 8_000_000:
                yield table(rows, id_type)
                rows, held = [], 0
        if meta is not None:
            yield table([*rows, closed()], id_type)

    return found.mapInArrow(run, fields)


def digests(docs: DataFrame, **options) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256 of every row; options as of ``pieces``."""
    cut = in_order(pieces(docs, **options))
    again = assembled(cut).sortWithinPartitions("hi", "lo", "part", "place")
    kind = again.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256"]

    def run(batches):
        rows, meta, digest, id_type = [], None, None, None

        def batch_of(part):
            kinds = [id_type, pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*part)), kinds)], names=names)

        def closed():
            copies, *values = meta
            for at in range(0, copies, 10_000):
                yield from [[*values, digest.hexdigest()]] * min(10_000, copies - at)

        for new, _, (part, copies, doc_id, n, form, before, middle, piece, output), id_type in _documents(
                batches, ["part", "copies", "doc_id", "n", "form", "prefix_chars", "middle_chars", "piece", "output_sha256"]):
            if new:
                for row in closed() if meta is not None else ():
                    rows.append(row)
                    if len(rows) >= 10_000:
                        yield batch_of(rows)
                        rows = []
                meta, digest = [copies, doc_id, n, form, before, middle, output], hashlib.sha256()
                continue  # part -1 stands first
            digest.update(piece)
        for row in closed() if meta is not None else ():
            rows.append(row)
            if len(rows) >= 10_000:
                yield batch_of(rows)
                rows = []
        if rows:
            yield batch_of(rows)

    return again.mapInArrow(run, f"doc_id {kind}, n bigint, form string, prefix_chars bigint, middle_chars bigint, "
                                 "output_sha256 string, restored_sha256 string")


def outputs(docs: DataFrame, **options) -> DataFrame:
    """doc_id, form and the whole output text of every document (a row repeated within a task once); options as of
    ``pieces``.  A task holds one output at a time."""
    cut = in_order(pieces(docs, **options)).filter(F.col("form").isNotNull())
    kind = cut.schema["doc_id"].dataType.simpleString()

    def run(batches):
        head, parts, seen, id_type = None, [], -1, None

        def one():
            return pa.RecordBatch.from_arrays([pa.array([head[0]], id_type), pa.array([head[1]]), pa.array([b"".join(parts)], pa.binary())],
                                              names=["doc_id", "form", "output"])

        for new, _, (place, doc_id, form, piece), id_type in _documents(batches, ["place", "doc_id", "form", "piece"]):
            if new:
                if head is not None:
                    yield one()
                head, parts, seen = (doc_id, form), [], -1
            if place != seen:
                parts.append(piece)
            seen = place
        if head is not None:
            yield one()

    return cut.mapInArrow(run, f"doc_id {kind}, form string, output binary").withColumn("output", F.col("output").cast("string"))


def restored(outputs_: DataFrame, form: str = "form", output: str = "output") -> Column:
    """The text behind a whole output, as a column over native string functions."""
    text, kind = F.col(output), F.col(form)

    def between(a: str, b: str | None) -> Column:
        rest = F.substring_index(text, a, -1)
        return F.substring_index(rest, b, 1) if b else rest

    psm = F.concat(between("<P>", "<S>"), between("<M>", None), between("<S>", "<M>"))
    spm = F.concat(between("<P>", "<M>"), between("<M>", None), between("<S>", "<P>"))
    return F.when(kind == "psm", psm).when(kind == "spm", spm).otherwise(text)
