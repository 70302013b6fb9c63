"""Alike documents (five-word shingles, Jaccard 0.8 and more) against brute force."""

import random
import time

import numpy as np
import pyarrow as pa
from declara.llm import similar, simhash
from declara.session import SHUFFLE_CLEANUP, stored
from pyspark.sql import functions as F

RND = random.Random(11)
VOCABULARY = [f"w{i}" for i in range(500)]
SCHEMA = "doc_id bigint, text string, digest string, fp string, node int, wide string"


def _jaccard(a: str, b: str) -> float:
    x, y = (set(simhash.shingle_hashes((t or "").encode(), 5).tolist()) for t in (a, b))
    return len(x & y) / max(1, len(x | y))


def _copies():
    texts = []
    for length in (60, 200, 900):
        for _ in range(6):
            words = [RND.choice(VOCABULARY) for _ in range(length)]
            texts.append(" ".join(words))
            for changes in (1, max(1, length // 100), length // 12):
                near = list(words)
                for at in RND.sample(range(length), changes):
                    near[at] = "changed"
                texts.append(" ".join(near))
    return texts


def test_alike_texts_meet_and_others_stay(spark):
    texts = _copies()
    rows = spark.createDataFrame([(i, t, "x", "x", 1, "x") for i, t in enumerate(texts)], SCHEMA).repartition(3)
    found = {r.doc_id: r.component_id for r in similar.similar_documents(rows).collect()}
    assert len(found) == len(texts)
    for i, a in enumerate(texts):
        for j in range(i):
            likeness = _jaccard(a, texts[j])
            if likeness >= 0.87:
                assert found[i] == found[j]
            if likeness == 0:
                assert found[i] != found[j]
    wide = [np.frombuffer(similar.wide_fingerprint(t.encode()), "<u8") for t in texts]
    alike = {i: i for i in range(len(texts))}
    for i in range(len(texts)):
        for j in range(i):
            if np.bitwise_count(wide[i] ^ wide[j]).sum() <= similar.most_bits(0.8):
                low, high = sorted((alike[i], alike[j]))
                alike = {k: low if v == high else v for k, v in alike.items()}
    assert all(alike[found[i]] == alike[i] for i in found)  # never more than brute force links


def test_odd_rows(spark):
    texts = [None, "", " \n\t ", "one", "ONE", "two words", "long " * 9000, "long " * 9001, *["same text in many rows here"] * 5]
    rows = spark.createDataFrame([(i if i != 9 else None, t, "x", "x", 1, "x") for i, t in enumerate(texts)], SCHEMA)
    rows = rows.union(rows.limit(1))
    found = [(r.doc_id, r.component_id) for r in similar.similar_documents(rows).collect()]
    assert len(found) == len(texts) + 1
    assert sorted(set(found), key=str) == sorted(
        [(0, 0), (1, 0), (2, 0), (3, 3), (4, 3), (5, 5), (6, 6), (7, 6), (8, 8), (None, 8), (10, 8), (11, 8), (12, 8)], key=str)
    kept = simhash.deduplicated(rows, similar.similar_documents(rows))
    assert kept.columns == rows.columns and sorted(r.doc_id for r in kept.collect()) == [0, 3, 5, 6, 8]
    empty = spark.createDataFrame([], SCHEMA)
    assert similar.similar_documents(empty).count() == 0 and simhash.deduplicated(empty, similar.similar_documents(empty)).count() == 0


def test_leaders_over_batches():
    centres = np.array([RND.getrandbits(64) for _ in range(5)], np.uint64)
    fps = np.array([int(RND.choice(centres)) ^ (1 << RND.randrange(64)) for _ in range(3000)], np.uint64).view(np.int64)
    key = np.sort(np.array([RND.choice([7, 7, 7, 8, 9]) for _ in range(3000)], np.int64))
    batches = [pa.RecordBatch.from_arrays([pa.array(key[at:at + 64]), pa.array(fps[at:at + 64])], names=["key", "fp"])
               for at in range(0, 3000, 64)]
    links = []
    for out in similar._stream(2, "fp", lambda k, f, row, leader, sent: (k[row], f[row], f[leader]))(iter(batches)):
        links += list(zip(*(c.tolist() for c in out)))
    for k in (7, 8, 9):
        group = {}
        for _, a, b in (x for x in links if x[0] == k):
            one, two = group.setdefault(a, {a}), group.setdefault(b, {b})
            if one is not two:
                one |= two
                for member in two:
                    group[member] = one
        assert len({id(g) for g in group.values()}) == len(centres)
        assert set(group) == set(fps[key == k].tolist())


def test_classes_are_those_of_exact_jaccard(spark):
    """Texts of one word up, with pairs just above and just below 0.8."""
    rnd = random.Random(5)
    texts = ["one", "One", "two", "a b c d e", "a b c d e f", None]
    for length in (8, 9, 12, 13, 14, 15, 24, 25, 40, 49, 50, 60, 90, 150, 400):
        for _ in range(4):
            words = [rnd.choice(VOCABULARY) for _ in range(length)]
            texts.append(" ".join(words))
            texts.append(" ".join([*words, "tail"]))
            for share in (0.018, 0.022, 0.026, 0.03):
                near = list(words)
                for at in rnd.sample(range(length), max(1, round(length * share))):
                    near[at] = f"x{rnd.randrange(99)}"
                texts.append(" ".join(near))
            for drop in (round(length * 0.18), round(length * 0.2), round(length * 0.22)):
                texts.append(" ".join(words[drop:]))
    rows = spark.createDataFrame([(i, t, "x", "x", 1, "x") for i, t in enumerate(texts)], SCHEMA).repartition(3)
    found = {r.doc_id: r.component_id for r in similar.similar_documents(rows).collect()}
    alike, borderline = {i: i for i in range(len(texts))}, 0
    for i in range(len(texts)):
        for j in range(i):
            likeness = _jaccard(texts[i], texts[j])
            borderline += 0.78 <= likeness < 0.82
            if likeness >= 0.8:
                low, high = sorted((alike[i], alike[j]))
                alike = {k: low if v == high else v for k, v in alike.items()}
    assert borderline > 20 and found == alike


def test_a_row_is_linked_once_per_key():
    """Near copies of one text: under a key every row leads or has one link, whatever their number."""
    for n in (100, 1000, 4000):
        centre = RND.getrandbits(64)
        bits = np.array([[centre ^ (1 << RND.randrange(64)) ^ (1 << RND.randrange(64))] for _ in range(n)], np.uint64)
        key = np.sort(np.array([RND.choice([3, 4, 4, 4]) for _ in range(n)], np.int64))
        for most in (1, 3, 64):
            row, leader, leads = similar.led(key, bits, most)
            assert len(row) == len(set(row.tolist())) and len(row) + leads.sum() == n
            assert (key[row] == key[leader]).all() and leads[leader].all()
            assert (np.bitwise_count(bits[row] ^ bits[leader]).sum(axis=1) <= most).all()


def test_common_lines_are_split_into_blocks(spark):
    """Short posts that share a line: the pairs found are those of all sets, block by block."""
    met = spark.createDataFrame([(7, i, 4 + i % 3, i % 2) for i in range(60)] + [(8, i, 5, 0) for i in range(10)], "h bigint, node bigint, n int, place int")
    roots = spark.createDataFrame([(i, i - i % 2) for i in range(20)], "node bigint, root bigint")
    pairs = [{tuple(r) for r in similar.across(met, roots, 0.5, block).collect()} for block in (1000, 7)]
    assert pairs[0] == pairs[1] and len(pairs[0]) > 1000


def test_clashing_columns(spark):
    from declara.llm import mixing

    names = ["_doc", "_digest", "_text_digest", "_low", "_copies", "_copy", "__doc"]
    texts = ["a b c d e f g", "A b c d e f g", "one two three", None, "", "a b c d e f g"]
    rows = spark.createDataFrame([(i % 5, t, "s", *["x"] * len(names)) for i, t in enumerate(texts)],
                                 "doc_id bigint, text string, source string, " + ", ".join(f"`{n}` string" for n in names))
    kept = simhash.deduplicated(rows, similar.similar_documents(rows))
    assert kept.columns == rows.columns and sorted(r.doc_id for r in kept.collect()) == [0, 2, 3]
    assert mixing.mixed_documents(rows).columns == rows.columns


def test_shared_elements_keep_the_distinct_rows_of_several_nodes(spark):
    rows = [(1, 10, 3, 0), (1, 10, 3, 0), (1, 11, 4, 1), (2, 10, 3, 1), (2, 10, 3, 1), (3, 12, 1, 0), (4, 11, 4, 0), (4, 12, 1, 2)]
    parts = spark.createDataFrame(rows, "h bigint, node bigint, n int, place int").repartition(3)
    kept = sorted(map(tuple, similar.shared(parts).collect()))
    assert kept == [(1, 10, 3, 0), (1, 11, 4, 1), (4, 11, 4, 0), (4, 12, 1, 2)]


def test_stored_tables_leave_no_shuffle_files(spark):
    def shuffled():
        files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        return {f for f in (files.apply(i).getName() for i in range(files.size())) if f.startswith("shuffle_")}

    before, setting = shuffled(), spark.conf.get(SHUFFLE_CLEANUP, None)
    table = stored(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count(), "seven")
    for _ in range(50):  # files are removed in the background
        if shuffled() <= before:
            break
        time.sleep(0.2)
    assert shuffled() <= before
    assert table.count() == 7 and spark.conf.get(SHUFFLE_CLEANUP, None) == setting
