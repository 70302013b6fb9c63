"""Media columns: interleaved sequences of text and media, with payloads resolved by digest.

HTML is parsed into the ordered sequence of its texts and media references; each reference keeps its position, its
caption and the digest that its address names.  Payloads live in a media table: 8-bit mono WAV files (one sample per
byte) written to the shared folder and found by the digest of the payload.  References are joined to what was read
back from the stored files, so every row tells what is really there.

* A payload moves once, from the text to its file; joins carry digests and features only.
* Copies within a batch are stored once; further copies are equal files, of which any may serve, as features
  depend on the bytes alone.

Defined results: null html and text are empty; a reference whose digest is unknown keeps null payload columns;
repeated rows and null ids are kept; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import io
import wave
import zlib
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from declara.session import shared_dir

FRAME = 64
_ITEMS = pa.list_(pa.struct([("position", pa.int32()), ("kind", pa.string()), ("text", pa.string()),
                             ("digest", pa.string()), ("caption", pa.string())]))


class _Sequence(HTMLParser):
    """Texts and media in document order; a figure's caption goes to its media."""

    SKIPPED = {"script", "style", "template", "noscript"}
    MEDIA = {"img", "audio", "video", "source"}

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.items: list[dict] = []
        self._text: list[str] = []
        self._caption: list[str] | None = None
        self._skip = 0

    def _flush(self):
        text = "".join(self._text)
        self._text = []
        if text:
            self._add("text", text, None, None)

    def _add(self, kind, text, digest, caption):
        self.items.append({"position": len(self.items), "kind": kind, "text": text, "digest": digest, "caption": caption})

    def handle_starttag(self, tag, attrs):
        if tag in self.SKIPPED:
            self._skip += 1
        elif tag in self.MEDIA:
            self._flush()
            named = dict(attrs)
            address = named.get("src") or ""
            self._add("media", None, address.removeprefix("sha256:") if address.startswith("sha256:") else None, named.get("alt"))
        elif tag == "figcaption":
            self._flush()
            self._caption = []

    handle_startendtag = handle_starttag

    def handle_endtag(self, tag):
        if tag in self.SKIPPED:
            self._skip = max(0, self._skip - 1)
        elif tag == "figcaption" and self._caption is not None:
            last = next((i for i in reversed(self.items) if i["kind"] == "media"), None)
            if last:
                last["caption"] = "".join(self._caption)
            self._caption = None

    def handle_data(self, data):
        if not self._skip:
            (self._text if self._caption is None else self._caption).append(data)


def parse_sequence(html: str | None) -> list[dict]:
    parser = _Sequence()
    parser.feed(html or "")
    parser.close()
    parser._flush()
    return parser.items


def sequences(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """id and ``items`` (position, kind text or media, text, digest, caption) of every page."""
    slim = pages.select(F.col(id_col).alias("id"), F.col(html_col).cast("string").alias("html"))
    kind = slim.schema["id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                items = pa.array([parse_sequence(h.as_py()) for h in part.column("html")], _ITEMS)
                yield pa.RecordBatch.from_arrays([part.column("id"), items], names=["id", "items"])

    return slim.mapInArrow(run, f"id {kind}, items array<struct<position:int,kind:string,text:string,digest:string,caption:string>>")


def payload_of(text: Column) -> Column:
    """UTF-8 bytes of a text, filled up with zeros to a positive multiple of the frame."""
    raw = F.encode(F.coalesce(text, F.lit("")), "UTF-8")
    whole = F.greatest(F.lit(1), F.ceil(F.length(raw) / FRAME)) * FRAME
    return F.rpad(raw, whole.cast("int"), F.lit(b"\x00"))


def to_wave(payload: bytes) -> bytes:
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(1)
        w.setframerate(8000)
        w.writeframes(payload)
    return out.getvalue()


def from_wave(media: bytes) -> bytes:
    with wave.open(io.BytesIO(media), "rb") as w:
        return w.readframes(w.getnframes())


def feature(samples: bytes) -> str:
    """Level, spread, roughness and zero crossings of 8-bit samples around their middle."""
    x = np.frombuffer(samples, np.uint8).astype(np.float32) - 128
    steps = np.diff(x)
    cross = int(np.count_nonzero(np.signbit(x[1:]) != np.signbit(x[:-1])))
    return f"mean={x.mean(dtype=np.float64):.4f};std={x.std(dtype=np.float64):.4f};step={np.abs(steps).mean(dtype=np.float64):.4f};cross={cross}"


def store_media(payloads: DataFrame, name: str = "media") -> DataFrame:
    """Writes the binary column ``payload`` as media files of a table: digest (SHA-256 of the payload), media."""
    from uuid import uuid4

    def run(batches):
        for batch in batches:
            seen: set[str] = set()
            digests, media = [], []
            for p in batch.column("payload"):
                payload = p.as_py()
                digest = hashlib.sha256(payload).hexdigest()
                if digest not in seen:
                    seen.add(digest)
                    digests.append(digest)
                    media.append(to_wave(payload))
            for at in range(0, len(digests), 500):
                yield pa.RecordBatch.from_arrays([pa.array(digests[at:at + 500], pa.string()),
                                                  pa.array(media[at:at + 500], pa.binary())], names=["digest", "media"])

    spark = payloads.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid4().hex}"
    table = payloads.select("payload").mapInArrow(run, "digest string, media binary")
    table.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(table.schema).parquet(path)


def read_back(media: DataFrame) -> DataFrame:
    """One row per digest with what the stored bytes give: sizes, digests, checksum, feature."""
    def run(batches):
        for batch in batches:
            rows = []
            for digest, m in zip(batch.column("digest"), batch.column("media")):
                stored = m.as_py()
                payload = from_wave(stored)
                rows.append({"digest": digest.as_py(), "payload_bytes": len(payload),
                             "payload_sha256": hashlib.sha256(payload).hexdigest(), "tail_crc32": zlib.crc32(payload[-FRAME:]),
                             "media_bytes": len(stored), "media_sha256": hashlib.sha256(stored).hexdigest(),
                             "feature": feature(payload)})
            yield pa.RecordBatch.from_pylist(rows, pa.schema([
                ("digest", pa.string()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()),
                ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string())]))

    read = media.mapInArrow(run, "digest string, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, "
                                 "media_bytes bigint, media_sha256 string, feature string")
    return read.distinct()


def resolved(seqs: DataFrame, media: DataFrame) -> DataFrame:
    """One row per media reference: id, position, digest, caption, the text before it, and its payload's columns.

    ``media`` has ``digest`` and further columns, one row per digest.
    """
    items = seqs.select("id", F.filter("items", lambda i: i["kind"] == "media").alias("refs"),
                        F.transform(F.filter("items", lambda i: i["kind"] == "text"),
                                    lambda i: F.struct(i["position"].alias("position"),
                                                       F.octet_length(i["text"]).cast("bigint").alias("bytes"))).alias("texts"))
    refs = items.select("id", F.explode("refs").alias("r"), "texts").select(
        "id", F.col("r.position").alias("position"), F.col("r.digest").alias("digest"), F.col("r.caption").alias("caption"),
        F.aggregate(F.filter("texts", lambda t: t["position"] < F.col("r.position")), F.lit(0).cast("bigint"),
                    lambda s, t: s + t["bytes"]).alias("bytes_before"))
    return refs.join(media, "digest", "left")


def _escaped(text: Column) -> Column:
    out = F.coalesce(text, F.lit(""))
    for sign, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        out = F.replace(out, F.lit(sign), F.lit(name))
    return out


def as_page(text: Column, caption: Column) -> Column:
    """A text as a page that shows it and refers to its own payload; markup in text and caption is shown as it is."""
    return F.concat(F.lit("<p>"), _escaped(text), F.lit('</p><figure><img src="sha256:'), F.sha2(payload_of(text), 256),
                    F.lit('"><figcaption>'), _escaped(caption), F.lit("</figcaption></figure>"))
