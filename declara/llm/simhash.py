"""SimHash near-duplicates: fingerprints linked at few differing bits, found through Golay codewords.

A fingerprint has 64 bits.  It is cut into segments of 22, 21 and 21 bits; of three differing bits at most one
falls into each of the best two segments.  Segments at distance 1 share a codeword when one side takes its nearest
and the other all within distance 4 (see ``golay``).  So every fingerprint is filed under three keys (nearest
codewords of each pair of segments) and asked for under the products of its nearby codewords; what meets under a
key is compared in full.  This finds every pair, without a cap.

* Equal fingerprints are one row from the start; a group of copies costs nothing more.
* What meets under a key is reduced to a forest per batch, so near copies give as many rows as there are
  fingerprints, not as there are pairs.
* A key under which more than ``dense`` fingerprints are filed belongs to a dense cloud.  Its fingerprints are
  linked by midpoints instead: each is filed at all values within 1 bit and asked for at all within 2; whatever
  meets at a value where something is filed is within 3 bits of that.  Linear in the cloud, and exact.

Defined results: words are runs of non-white-space in the text with A-Z lower-cased; a text of fewer words than a
shingle is one shingle; null, empty and blank texts have fingerprint 0; repeated rows and ids are members like
any other; a component of null ids alone has a null id; an empty table gives no rows.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from declara.llm import golay
from declara.llm.common import fresh
from declara.llm.graph import components, forest
from declara.session import stored

SEGMENTS = ((0, 22), (22, 21), (43, 21))
PAIRS = ((0, 1), (0, 2), (1, 2))
_LANES = np.arange(8) * 256
_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)


def shingle_hashes(text: bytes | None, shingle: int) -> np.ndarray:
    """XXH64 of the shingles of a whole text in order, repeats included; none without words."""
    words = (text or b"").lower().split()
    if not words:
        return np.zeros(0, "<u8")
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    if len(words) <= shingle:
        spans = [(0, len(joined))]
    else:
        spans = zip([0, *(ends[:-shingle] + 1).tolist()], ends[shingle - 1:].tolist())
    return np.array([xxh64_intdigest(joined[a:b], 42) for a, b in spans], dtype="<u8")


def fingerprint(text: bytes | None, shingle: int = 3) -> int:
    """Signed 64-bit SimHash of the shingles of a whole text, repeats included."""
    hashes = shingle_hashes(text, shingle)
    counts = np.zeros(2048, np.int64)
    for at in range(0, len(hashes), 65536):
        lanes = hashes[at:at + 65536].view(np.uint8).reshape(-1, 8) + _LANES
        counts += np.bincount(lanes.ravel(), minlength=2048)
    ones = (counts.reshape(8, 256) @ _BITS).ravel()
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """doc_id, digest (xxhash64 of the text) and fp of every row."""
    slim = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("digest"),
                       F.col(text_col).cast("binary").alias("text"))
    kind = slim.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            fps = [fingerprint(t.as_py(), shingle) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("digest"), pa.array(fps, pa.int64())],
                                             names=["doc_id", "digest", "fp"])

    return slim.mapInArrow(run, f"doc_id {kind}, digest bigint, fp bigint")


def _keys(fps: np.ndarray, asked: bool):
    """key << 1 | (1 if asked) and fingerprint: where fingerprints are filed or asked for."""
    unsigned = fps.view(np.uint64)
    near = [golay.nearby((unsigned >> np.uint64(at)).astype(np.int64) & ((1 << bits) - 1)) for at, bits in SEGMENTS]
    keys, owners = [], []
    for n, (i, j) in enumerate(PAIRS):
        (a, ok_a), (b, ok_b) = near[i], near[j]
        if not asked:
            keys.append(((n << 24) | (a[:, 0] << 12) | b[:, 0]) << 1)
            owners.append(fps)
            continue
        key = (((n << 24) | (a[:, :, None] << 12) | b[:, None, :]) << 1) | 1
        ok = ok_a[:, :, None] & ok_b[:, None, :]
        keys.append(key[ok])
        owners.append(np.broadcast_to(fps[:, None, None], ok.shape)[ok])
    return np.concatenate(keys), np.concatenate(owners)


def _table(key: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(key, pa.int64()), pa.array(fp, pa.int64())], names=["key", "fp"])


def _keyed(filed_only: bool):
    def run(batches):
        for batch in batches:
            fps = batch.column("fp").to_numpy()
            for at in range(0, len(fps), 4096):
                part = np.ascontiguousarray(fps[at:at + 4096])
                yield _table(*_keys(part, False))
                if not filed_only:
                    yield _table(*_keys(part, True))
    return run


def _edges(a: list[np.ndarray], b: list[np.ndarray]) -> pa.RecordBatch:
    none = np.zeros(0, np.int64)
    u, v = forest(np.concatenate([none, *a]), np.concatenate([none, *b]))
    return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])


def _compare(max_bits: int, at_once: int = 2_000_000):
    """Links under each key of rows sorted by key, filed rows first."""
    def run(batches):
        held_key, held = -1, np.zeros(0, np.int64)  # filed rows of the key that the last batch ended in
        for batch in batches:
            key, fp = batch.column("key").to_numpy(), batch.column("fp").to_numpy()
            key = np.concatenate([np.full(len(held), held_key << 1), key])
            fp = np.concatenate([held, fp])
            if not len(key):
                continue
            group = key >> 1
            starts = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
            ends = np.r_[starts[1:], len(group)]
            filed = np.add.reduceat((key & 1) == 0, starts)
            held_key = int(group[-1])
            held = fp[starts[-1]:starts[-1] + filed[-1]].copy()
            asked = ends - starts - filed
            use = np.flatnonzero((filed > 0) & (asked > 0))
            a_out, b_out = [], []
            # every asked row of a group meets its filed rows; cut so that few pairs are in memory at once
            rows = np.repeat(starts[use] + filed[use], asked[use]) + _within(asked[use])
            width, first = np.repeat(filed[use], asked[use]), np.repeat(starts[use], asked[use])
            reach = np.cumsum(width)
            at = 0
            while at < len(rows):
                to = max(at + 1, int(np.searchsorted(reach, (reach[at - 1] if at else 0) + at_once)))
                x = np.repeat(rows[at:to], width[at:to])
                y = np.repeat(first[at:to], width[at:to]) + _within(width[at:to])
                differ = np.bitwise_count((fp[x] ^ fp[y]).view(np.uint64))
                close = (differ <= max_bits) & (differ > 0)
                u, v = forest(fp[x[close]], fp[y[close]])
                a_out.append(u)
                b_out.append(v)
                at = to
            yield _edges(a_out, b_out)
    return run


def _within(lengths: np.ndarray) -> np.ndarray:
    """0, 1, ... inside each of the lengths."""
    total = int(lengths.sum())
    return np.arange(total) - np.repeat(np.cumsum(lengths) - lengths, lengths)


def _masks(bits: int) -> np.ndarray:
    return np.array([sum(1 << b for b in c) for k in range(bits + 1) for c in combinations(range(64), k)], dtype=np.uint64)


def _midpoints(max_bits: int):
    near, far = _masks(max_bits // 2), _masks(max_bits - max_bits // 2)

    def run(batches):
        for batch in batches:
            fps = batch.column("fp").to_numpy()
            for at in range(0, len(fps), 128):
                part = np.ascontiguousarray(fps[at:at + 128])
                for asked, masks in ((0, near), (1, far)):
                    value = (part.view(np.uint64)[:, None] ^ masks).view(np.int64).ravel()
                    yield pa.RecordBatch.from_arrays([pa.array(value), pa.array(np.full(len(value), asked, np.int8)),
                                                      pa.array(np.repeat(part, len(masks)))], names=["value", "asked", "fp"])
    return run


def _meet(batches):
    """Links every row at a value to the first row filed there; rows sorted by value, filed rows first."""
    held, hub = None, None
    for batch in batches:
        value, asked, fp = (batch.column(c).to_numpy() for c in ("value", "asked", "fp"))
        if not len(value):
            continue
        starts = np.flatnonzero(np.r_[True, value[1:] != value[:-1]])
        first, has = fp[starts].copy(), asked[starts] == 0
        if held is not None and value[0] == held[0]:
            first[0], has[0] = hub, held[1]
        sizes = np.diff(np.r_[starts, len(value)])
        u, v, ok = fp, np.repeat(first, sizes), np.repeat(has, sizes)
        ok &= u != v
        held, hub = (int(value[-1]), bool(has[-1])), int(first[-1])
        yield _edges([u[ok]], [v[ok]])


def links(spark: SparkSession, fps: DataFrame, max_bits: int = 3, dense: int = 2000) -> DataFrame:
    """Edges u, v whose components are those of all pairs of distinct ``fp`` within ``max_bits``."""
    if not 0 < max_bits <= 3:
        raise ValueError("max_bits is 1 to 3")
    n = fps.count()
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = fps.repartition(max(least, -(-n // 50_000)), "fp")
    filed = dealt.mapInArrow(_keyed(True), "key bigint, fp bigint")
    hot = stored(filed.groupBy("key").count().filter(F.col("count") > dense).select(F.shiftright("key", 1).alias("hot")), "hot")
    keyed = dealt.mapInArrow(_keyed(False), "key bigint, fp bigint")
    crowded = hot.count() > 0
    if crowded:
        cloud = keyed.join(hot, F.shiftright("key", 1) == F.col("hot"), "left_semi").select("fp").distinct()
        keyed = keyed.join(hot, F.shiftright("key", 1) == F.col("hot"), "left_anti")
    parts = max(least, -(-n * 90 // 1_000_000))
    out = (keyed.repartition(parts, F.shiftright("key", 1)).sortWithinPartitions("key")
           .mapInArrow(_compare(max_bits), "u bigint, v bigint"))
    if crowded:
        cloud = stored(cloud, "cloud")
        parts = max(least, -(-cloud.count() * 2146 // 2_000_000))
        spread = cloud.repartition(parts, "fp").mapInArrow(_midpoints(max_bits), "value bigint, asked tinyint, fp bigint")
        out = out.union(spread.repartition(parts, "value").sortWithinPartitions("value", "asked")
                        .mapInArrow(_meet, "u bigint, v bigint"))
    return out


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3,
                    max_bits: int = 3, dense: int = 2000) -> DataFrame:
    """doc_id, digest, fp and component_id (smallest id among all that links reach) of every row."""
    spark = docs.sparkSession
    rows = stored(fingerprints(docs, id_col, text_col, shingle), "fingerprints")
    distinct = stored(rows.groupBy("fp").agg(F.min("doc_id").alias("low")), "distinct")
    roots = components(links(spark, distinct.select("fp"), max_bits, dense))
    placed = (distinct.join(roots, distinct["fp"] == roots["node"], "left")
              .select("fp", "low", F.coalesce("root", "fp").alias("root")))
    lowest = placed.groupBy("root").agg(F.min("low").alias("component_id"))
    classes = placed.join(lowest, "root").select(F.col("fp").alias("_fp"), "component_id")
    return rows.join(classes, rows["fp"] == classes["_fp"]).select("doc_id", "digest", "fp", "component_id")


def deduplicated(docs: DataFrame, found: DataFrame | None = None) -> DataFrame:
    """One row of ``docs`` per component: that of the smallest id (then digest); null ids come last.

    ``found`` has doc_id, digest and component_id of every row; by default those of ``near_duplicates``.
    """
    found = near_duplicates(docs) if found is None else found
    who, what, own = fresh(docs, "_doc", "_digest", "_text_digest")
    kept = (found.groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "digest")).alias("k"))
            .select(F.col("k.doc_id").alias(who), F.col("k.digest").alias(what)))
    keyed = docs.withColumn(own, F.xxhash64("text"))
    return (keyed.join(kept, keyed["doc_id"].eqNullSafe(F.col(who)) & (F.col(own) == F.col(what)), "left_semi")
            .dropDuplicates(["doc_id", own]).select(*[F.col(f"`{c}`") for c in docs.columns]))
