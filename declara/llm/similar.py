"""Documents alike in word shingles at a Jaccard similarity of 0.8 and more: fingerprints propose, an exact join completes.

Texts are sets of distinct shingles (64-bit hashes); equal sets are one node from the start.  Every link is confirmed
by the exact Jaccard similarity of the two sets.

1. Proposals.  A wide SimHash has 24 lanes of 64 bits over the set.  Lanes 1 to 23 are cut into 64 segments of 23 bits,
   each decoded to its nearest Golay codeword (index of 12 bits), which forgives errors.  Two segments next to each
   other on a ring (distance up to ``reach``) make a key.  Under a key, rows within ``loose`` bits of lane 0 of a
   leader, then within the expected number of wide bits, are proposed: the first row not linked yet leads, rows come
   in one order under all keys, and a row is linked once under a key.  So there are at most 64 ``reach`` proposals per
   row, however large a group of near copies is.  Confirmed proposals give clusters.
2. Completion.  Sets of Jaccard ``similarity`` and more share an element among the first ``n - ceil(similarity n) + 1``
   of each, in any order that is the same for all sets (prefix filter).  The order puts shingles in rarely used hash
   buckets first, so common lines are seldom in a prefix.  Sets of different clusters that share such an element, whose
   sizes and places there leave room for enough overlap, are compared in full.  Pairs inside a cluster need no
   comparison, so the classes are those of all pairs at ``similarity`` and more, from one word up.

Defined results: null, empty and blank texts are alike; a text of fewer words than a shingle is one shingle; repeated
rows and ids are members like others; an empty table gives no rows.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from declara.llm import golay
from declara.llm.graph import components
from declara.llm.simhash import shingle_hashes
from declara.session import stored

LANES, SEGMENTS, BITS = 24, 64, 23
_OFFSETS = np.arange(LANES * 8) * 256
_STEPS = (np.arange(LANES, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_BYTE_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.float64)
_WEIGHTS = 1 << np.arange(BITS)
#: Shingles are ordered by the use of so many hash buckets.
BUCKETS = 1 << 17


def shingle_set(text: bytes | None, shingle: int = 5) -> np.ndarray:
    """Distinct shingle hashes of a whole text, in order."""
    return np.unique(shingle_hashes(text, shingle))


def _node(hashes: np.ndarray) -> int:
    return int(np.uint64(xxh64_intdigest(hashes.tobytes(), 7)).view(np.int64))


def wide_fingerprint(text: bytes | None, shingle: int = 5) -> bytes:
    """SimHash of 24 lanes over the distinct shingles of a whole text; lane 0 takes the hashes as they are."""
    return _wide(shingle_set(text, shingle))


def _wide(hashes: np.ndarray) -> bytes:
    counts = np.zeros(LANES * 2048, np.int64)
    for at in range(0, len(hashes), 8192):
        lanes = hashes[at:at + 8192, None] + _STEPS
        mixed = (lanes ^ (lanes >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        mixed ^= mixed >> np.uint64(27)
        mixed[:, 0] = lanes[:, 0]
        counts += np.bincount((mixed.view(np.uint8) + _OFFSETS).ravel(), minlength=LANES * 2048)
    ones = counts.reshape(LANES * 8, 256).astype(np.float64) @ _BYTE_BITS
    return np.packbits((ones * 2 > len(hashes)).ravel(), bitorder="little").tobytes()


def most_bits(similarity: float) -> int:
    """Bits of a wide fingerprint that differ, as expected, between sets of this Jaccard similarity."""
    return math.floor(LANES * 64 * math.acos(2 * similarity / (1 + similarity)) / math.pi)


def wide_fingerprints(docs: DataFrame, id_col: str, text_col: str, shingle: int) -> DataFrame:
    """doc_id, digest (xxhash64 of the text), node (of the shingle set), fp (lane 0) and wide (binary) of every row."""
    slim = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("digest"),
                       F.col(text_col).cast("binary").alias("text"))
    kind = slim.schema["doc_id"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            nodes, wides = [], []
            for t in batch.column("text"):
                hashes = shingle_set(t.as_py(), shingle)
                nodes.append(_node(hashes))
                wides.append(_wide(hashes))
            lane = pa.array([int.from_bytes(w[:8], "little", signed=True) for w in wides], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("digest"), pa.array(nodes, pa.int64()), lane,
                                              pa.array(wides, pa.binary())], names=["doc_id", "digest", "node", "fp", "wide"])

    return slim.mapInArrow(run, f"doc_id {kind}, digest bigint, node bigint, fp bigint, wide binary")


def _matrix(column: pa.Array, kind: str) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(len(column), -1)


def keys_of(wides: np.ndarray, reach: int) -> np.ndarray:
    """Keys of wide fingerprints (rows of 192 bytes), shape (n, 64 * reach)."""
    bits = np.unpackbits(wides[:, 8:], axis=1, bitorder="little").reshape(len(wides), SEGMENTS, BITS)
    index = golay.nearby((bits @ _WEIGHTS).ravel())[0][:, 0].reshape(len(wides), SEGMENTS)
    keys = [((np.arange(SEGMENTS) * reach + step - 1) << 24) | (index << 12) | np.roll(index, -step, axis=1)
            for step in range(1, reach + 1)]
    return np.concatenate(keys, axis=1)


def _filed(reach: int):
    def run(batches):
        for batch in batches:
            for at in range(0, len(batch), 512):
                wides = _matrix(batch.column("wide").slice(at, 512), np.uint8)
                lane = np.ascontiguousarray(wides[:, :8]).view("<i8").ravel()
                yield pa.RecordBatch.from_arrays([pa.array(keys_of(wides, reach).ravel()), pa.array(np.repeat(lane, SEGMENTS * reach))],
                                                 names=["key", "fp"])
    return run


def led(key: np.ndarray, bits: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Links (row, leader) inside the groups of sorted keys, and which rows lead.  ``bits`` has one row of words each.

    The first row that is not linked yet leads; a row is linked once, so there are fewer links than rows.
    """
    starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    sizes = np.diff(np.r_[starts, len(key)])
    free, leads = np.ones(len(key), bool), np.zeros(len(key), bool)
    rows_out, leaders_out = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    leads[starts[sizes == 1]] = True
    starts, sizes = starts[sizes > 1], sizes[sizes > 1]
    while len(starts):
        total = int(sizes.sum())
        rows = np.arange(total) + np.repeat(starts - (np.cumsum(sizes) - sizes), sizes)
        group = np.repeat(np.arange(len(starts)), sizes)
        open_rows = np.flatnonzero(free[rows])
        which, first = np.unique(group[open_rows], return_index=True)
        leader = np.zeros(len(starts), np.int64)
        leader[which] = rows[open_rows[first]]
        leads[leader[which]], free[leader[which]] = True, False
        asked = np.flatnonzero(free[rows])
        for at in range(0, len(asked), 500_000):
            x = rows[asked[at:at + 500_000]]
            y = leader[group[asked[at:at + 500_000]]]
            close = np.bitwise_count(bits[x] ^ bits[y]).sum(axis=1) <= most
            free[x[close]] = False
            rows_out.append(x[close])
            leaders_out.append(y[close])
        left = np.add.reduceat(free[rows], np.cumsum(sizes) - sizes) > 0
        starts, sizes = starts[left], sizes[left]
    return np.concatenate(rows_out), np.concatenate(leaders_out), leads


def _stream(most: int, words: str, emit):
    """Rows sorted by key, led batch by batch; the leaders of the last key meet its rows of the next batch.

    ``emit`` gets a set of its own per task, in which it may note what it has put out.
    """
    def run(batches):
        held, sent = None, set()
        for batch in batches:
            if not len(batch):
                continue
            key, fp = batch.column("key").to_numpy(), batch.column("fp").to_numpy()
            bits = fp.view(np.uint64)[:, None] if words == "fp" else _matrix(batch.column(words), "<u8")
            if held is not None and held[0][0] == key[0]:
                key, fp, bits = (np.concatenate([a, b]) for a, b in zip(held, (key, fp, bits)))
            row, leader, leads = led(key, bits, most)
            keep = leads & (key == key[-1])
            held = key[keep], fp[keep], bits[keep]
            yield emit(key, fp, row, leader, sent)
    return run


def _candidates(key, fp, row, leader, sent):
    rows = np.unique(np.concatenate([row, leader]))
    return pa.RecordBatch.from_arrays([pa.array(key[rows], pa.int64()), pa.array(fp[rows], pa.int64())], names=["key", "fp"])


def _links(key, node, row, leader, sent):
    """Links of smaller and larger node; one that several keys of a task give is put out once."""
    pairs = np.stack([np.minimum(node[row], node[leader]), np.maximum(node[row], node[leader])], axis=1)
    fresh = list(dict.fromkeys(p for p in map(tuple, pairs.tolist()) if p not in sent))
    if len(sent) > 1_000_000:
        sent.clear()
    sent.update(fresh)
    u, v = zip(*fresh) if fresh else ((), ())
    return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])


def proposals(spark: SparkSession, wides: DataFrame, similarity: float = 0.8, loose: int = 18, reach: int = 1) -> DataFrame:
    """Pairs u < v of nodes that fingerprints hold for alike, among ``wides`` (node, fp, wide; distinct)."""
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    n = wides.count()
    parts = max(least, -(-n * SEGMENTS * reach // 4_000_000))
    filed = wides.select("wide").repartition(max(least, -(-n // 50_000))).mapInArrow(_filed(reach), "key bigint, fp bigint")
    met = (filed.repartition(parts, "key").sortWithinPartitions("key", "fp")
           .mapInArrow(_stream(loose, "fp", _candidates), "key bigint, fp bigint"))
    met = stored(met.distinct(), "met")
    full = (met.join(wides, "fp").select("key", F.col("node").alias("fp"), "wide")
            .repartition(max(least, -(-met.count() // 1_000_000)), "key").sortWithinPartitions("key", "fp"))
    return full.mapInArrow(_stream(most_bits(similarity), "wide", _links), "u bigint, v bigint").filter("u != v").distinct()


def confirmed(pairs: DataFrame, rows: DataFrame, docs: DataFrame, text_col: str, shingle: int, similarity: float) -> DataFrame:
    """The pairs u, v whose shingle sets have Jaccard ``similarity`` and more; ``rows`` has node and digest."""
    pairs = stored(pairs, "pairs")
    asked = pairs.select(F.col("u").alias("node")).union(pairs.select(F.col("v").alias("node"))).distinct()
    of_node = rows.join(asked, "node", "left_semi").groupBy("node").agg(F.min("digest").alias("digest"))
    texts = docs.select(F.xxhash64(text_col).alias("digest"), F.col(text_col).cast("binary").alias("text"))
    texts = texts.join(of_node.select("digest"), "digest", "left_semi")

    def run(batches):
        seen = set()
        for batch in batches:
            sets = {}
            for digest, text in zip(batch.column("digest").to_pylist(), batch.column("text")):
                if digest not in seen:
                    seen.add(digest)
                    hashes = shingle_set(text.as_py(), shingle)
                    sets[_node(hashes)] = hashes.view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(sets.keys(), pa.int64()), pa.array(sets.values(), pa.list_(pa.int64()))],
                                             names=["node", "set"])

    sets = texts.mapInArrow(run, "node bigint, set array<bigint>").dropDuplicates(["node"])
    one, two = sets.select(F.col("node").alias("u"), F.col("set").alias("a")), sets.select(F.col("node").alias("v"), F.col("set").alias("b"))
    shared = F.size(F.array_intersect("a", "b"))
    return (pairs.join(one, "u").join(two, "v").select("u", "v", shared.alias("s"), (F.size("a") + F.size("b")).alias("n"))
            .filter(F.col("s") >= similarity * (F.col("n") - F.col("s")) - 1e-9).select("u", "v"))


def bucket_use(docs: DataFrame, text_col: str, shingle: int) -> np.ndarray:
    """How many shingles of all sets fall into each of the hash buckets."""
    def run(batches):
        total = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for t in batch.column("text"):
                np.add.at(total, (shingle_set(t.as_py(), shingle) & np.uint64(BUCKETS - 1)).astype(np.int64), 1)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], names=["bucket", "n"])

    counts = (docs.select(F.col(text_col).cast("binary").alias("text")).mapInArrow(run, "bucket bigint, n bigint")
              .groupBy("bucket").agg(F.sum("n").alias("n")).toArrow())
    use = np.zeros(BUCKETS, np.int64)
    use[counts.column("bucket").to_numpy()] = counts.column("n").to_numpy()
    return use


def prefixes(docs: DataFrame, text_col: str, shingle: int, similarity: float, use: np.ndarray) -> DataFrame:
    """h, node, n (size of the set), place of the first elements of every set, in the order of ``use``."""
    def run(batches):
        seen = set()
        for batch in batches:
            h, node, size, place = [], [], [], []
            for t in batch.column("text"):
                hashes = shingle_set(t.as_py(), shingle)
                n, name = len(hashes), _node(hashes)
                if not n or name in seen:
                    continue
                seen.add(name)
                keep = n - math.ceil(similarity * n - 1e-9) + 1
                order = np.argsort(use[(hashes & np.uint64(BUCKETS - 1)).astype(np.int64)], kind="stable")[:keep]
                h.append(hashes[order].view(np.int64))
                node.append(np.full(keep, name, np.int64))
                size.append(np.full(keep, n, np.int32))
                place.append(np.arange(keep, dtype=np.int32))
            if h:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in (h, node, size, place)],
                                                 names=["h", "node", "n", "place"])

    return docs.select(F.col(text_col).cast("binary").alias("text")).mapInArrow(run, "h bigint, node bigint, n int, place int")


def shared(parts: DataFrame) -> DataFrame:
    """The distinct rows of ``parts`` whose element stands in the prefixes of two nodes and more, after one shuffle by element."""
    w = Window.partitionBy("h")
    return (parts.withColumn("a", F.min("node").over(w)).withColumn("b", F.max("node").over(w)).filter("a != b")
            .drop("a", "b").distinct())


def across(met: DataFrame, roots: DataFrame, similarity: float, block: int = 1000) -> DataFrame:
    """Pairs u, v of different clusters that share an element of ``met`` and can overlap enough by size and place.

    Sets that can be alike differ by one class of size at most, so an element and a class are the key.  Where more than
    ``block`` sets stand under a key, one side is dealt to blocks and the other stands in each: a common line of
    very many short texts spreads over many tasks.
    """
    placed = met.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    mixed = placed.groupBy("h").agg(F.min("root").alias("a"), F.max("root").alias("b")).filter("a != b").select("h")
    size = F.floor(F.log("n") / math.log(1 / similarity) + 1e-9).cast("int")
    left = stored(placed.join(mixed, "h", "left_semi").withColumn("class", size), "across")
    near = left.withColumn("class", F.explode(F.array(*[F.col("class") + d for d in (-1, 0, 1)])))
    heavy = (near.groupBy("h", "class").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks")).filter("blocks > 1"))
    blocks = F.coalesce("blocks", F.lit(1))
    x = left.join(heavy, ["h", "class"], "left").withColumn("block", F.pmod(F.xxhash64("node"), blocks).cast("int")).alias("x")
    y = near.join(heavy, ["h", "class"], "left").withColumn("block", F.explode(F.sequence(F.lit(0), blocks - 1))).alias("y")
    room = F.least(F.col("x.n") - F.col("x.place"), F.col("y.n") - F.col("y.place"))
    fits = ((F.col("x.h") == F.col("y.h")) & (F.col("x.class") == F.col("y.class")) & (F.col("x.block") == F.col("y.block"))
            & (F.col("x.root") < F.col("y.root"))
            & (F.least("x.n", "y.n") >= similarity * F.greatest("x.n", "y.n") - 1e-9)
            & (room * (1 + similarity) >= similarity * (F.col("x.n") + F.col("y.n")) - 1e-9))
    return x.join(y, fits).select(F.col("x.node").alias("u"), F.col("y.node").alias("v")).distinct()


def similar_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5,
                      similarity: float = 0.8, reach: int = 1) -> DataFrame:
    """doc_id, digest, component_id (smallest id among all that links reach) of every row."""
    spark = docs.sparkSession
    rows = stored(wide_fingerprints(docs, id_col, text_col, shingle), "wide")
    wides = stored(rows.groupBy("node").agg(F.min("doc_id").alias("low"), F.first("fp").alias("fp"), F.first("wide").alias("wide")), "distinct")
    near = components(confirmed(proposals(spark, wides.select("node", "fp", "wide"), similarity, reach=reach),
                                rows, docs, text_col, shingle, similarity))
    parts = prefixes(docs, text_col, shingle, similarity, bucket_use(docs, text_col, shingle))
    met = stored(shared(parts), "prefixes")
    far = stored(confirmed(across(met, near, similarity), rows, docs, text_col, shingle, similarity), "far")
    roots = components(near.select(F.col("node").alias("u"), F.col("root").alias("v")).union(far))
    placed = (wides.join(roots, "node", "left").select("node", "low", F.coalesce("root", "node").alias("root")))
    lowest = placed.groupBy("root").agg(F.min("low").alias("component_id"))
    classes = placed.join(lowest, "root").select("node", "component_id")
    return rows.join(classes, "node").select("doc_id", "digest", "component_id")
