"""Spelling variants: words one edit apart, found by k-d trees over letter counts.

A word becomes a vector of letter counts (32 classes: the code point modulo 32; merging letters only shortens
distances).  One edit gives vectors at L1 distance 2 at most: a replacement takes one letter and adds one, an
insertion adds one.  Words of one length lie in cells of a k-d tree; a word is stored in its own cell and asked for in
all cells, of its length and of the next one, whose box it can reach by that.  Inside a cell a second tree with tight
boxes prunes further; what is left in a leaf is compared by counts and then by the order of letters, exactly.  Pairs
are counted where they are found and never leave the task: a word sends its number of near words and the best one.

* The cuts of the trees over cells are medians of a sample of words (``sample``, by hash), as range partitioning
  takes them: they decide how even the cells are, never what is found.  At most ``cells`` cells hold all words, so the
  trees that travel with a task are bounded; a task holds one cell and streams what is asked of it.
* Form chains grow by the ratio at each step, so roots settle after few doublings.

Defined results: null text has no words; a null id counts as an empty string in the seeded deletion; words may hold
any letters; equal words with several rows count together; an empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from declara.session import stored

CLASSES = 32
FLUSH = 400_000
#: Latin-1 letters stay, A-Z become a-z, everything else separates words.
_LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 0xC0 else 32 for b in range(256))


# words ----------------------------------------------------------------------------------------


def words_of(text: str | None, doc_id: object, delete_every: int | None) -> Counter:
    """Lower-cased runs of letters of a whole text and their number; with ``delete_every`` some lose a seeded letter."""
    if not text:
        return Counter()
    found = Counter(text.encode("latin-1", "replace").translate(_LETTERS).split(b" "))
    found.pop(b"", None)
    if not delete_every:
        return found
    start = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
    crc = zlib.crc32
    out = Counter()
    for word, n in found.items():
        h = crc(word if word.isascii() else word.decode("latin-1").encode(), start)
        if h % delete_every == 0:
            at = h % len(word)
            word = word[:at] + word[at + 1:]
        out[word] += n
    return out


def count_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", delete_every: int | None = None,
                least: int = 3, shortest: int = 5) -> DataFrame:
    """word and n of all words of at least ``shortest`` letters that occur ``least`` times or more in all texts.

    Words are added up per task before they travel.
    """
    slim = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def batch_of(total: Counter) -> pa.RecordBatch:
        kept = [(w.decode("latin-1"), n) for w, n in total.items() if len(w) >= shortest]
        return pa.RecordBatch.from_arrays([pa.array([w for w, _ in kept], pa.string()), pa.array([n for _, n in kept], pa.int64())],
                                          names=["word", "n"])

    def run(batches):
        total: Counter = Counter()
        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                for word, n in words_of(text, doc_id, delete_every).items():
                    total[word] += n
                if len(total) > FLUSH:
                    yield batch_of(total)
                    total.clear()
        yield batch_of(total)

    return slim.mapInArrow(run, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least)


# k-d trees ------------------------------------------------------------------------------------


def letters(words: list[str], length: int) -> np.ndarray:
    """Code points of words of one length, a row each."""
    return np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(len(words), length)


def counts(codes: np.ndarray) -> np.ndarray:
    """Letter counts of each row, clipped to 255."""
    k, length = codes.shape
    flat = (codes & 31).astype(np.int64) + np.arange(k)[:, None] * CLASSES
    return np.minimum(np.bincount(flat.ravel(), minlength=k * CLASSES), 255).reshape(k, CLASSES).astype(np.int16)


class Tree:
    """A k-d tree: cuts at medians of the most evenly cut class; leaves hold at most ``leaf`` points, unless equal."""

    def __init__(self, points: np.ndarray, leaf: int, tight: bool):
        self.dim, self.cut, self.left, self.right = [], [], [], []
        self.low, self.high, self.members = [], [], []
        open_box = np.zeros(CLASSES, np.int16), np.full(CLASSES, 255, np.int16)
        todo = [(self._node(), np.arange(len(points)), *open_box)]
        while todo:
            node, rows, low, high = todo.pop()
            part = points[rows]
            if tight and len(rows):
                low, high = part.min(axis=0), part.max(axis=0)
            self.low[node], self.high[node] = low, high
            if len(rows) <= leaf:
                self.members[node] = rows
                continue
            middle = np.partition(part, len(rows) // 2, axis=0)[len(rows) // 2]
            below = np.stack([(part <= middle - 1).sum(axis=0), (part <= middle).sum(axis=0)])
            even = np.minimum(below, len(rows) - below)
            step, dim = divmod(int(even.argmax()), CLASSES)
            if even[step, dim] == 0:
                self.members[node] = rows
                continue
            cut = int(middle[dim]) - 1 + step
            goes = part[:, dim] <= cut
            self.dim[node], self.cut[node] = dim, cut
            self.left[node], self.right[node] = self._node(), self._node()
            under, over = high.copy(), low.copy()
            under[dim], over[dim] = cut, cut + 1
            todo += [(self.left[node], rows[goes], low, under), (self.right[node], rows[~goes], over, high)]

    def _node(self) -> int:
        for column in (self.dim, self.cut, self.left, self.right, self.low, self.high, self.members):
            column.append(0)
        return len(self.dim) - 1

    def home(self, points: np.ndarray) -> np.ndarray:
        """Leaf (node number) of each point."""
        at = np.zeros(len(points), np.int64)
        dim, cut, left, right = (np.array(c) for c in (self.dim, self.cut, self.left, self.right))
        while True:
            inner = np.flatnonzero(left[at] > 0)
            if not len(inner):
                return at
            node = at[inner]
            at[inner] = np.where(points[inner, dim[node]] <= cut[node], left[node], right[node])

    def reach(self, points: np.ndarray, add: int, take: int):
        """Leaf and rows of the points that come into its box by adding and taking so many letters."""
        todo = [(0, np.arange(len(points)))]
        while todo:
            node, rows = todo.pop()
            part = points[rows]
            up = np.maximum(self.low[node] - part, 0).sum(axis=1)
            down = np.maximum(part - self.high[node], 0).sum(axis=1)
            rows = rows[(up <= add) & (down <= take)]
            if not len(rows):
                continue
            if self.left[node]:
                todo += [(self.left[node], rows), (self.right[node], rows)]
            else:
                yield node, rows


def codes_of_counts(points: np.ndarray) -> np.ndarray:
    """Counts in unary, two bits a class: as many differing bits as L1 distance, or fewer."""
    bits = np.stack([points >= 1, points >= 2], axis=2).reshape(len(points), -1)
    return np.packbits(bits, axis=1).view(np.uint64).ravel()


def one_replaced(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a != b).sum(axis=1) == 1


def one_inserted(short: np.ndarray, long: np.ndarray) -> np.ndarray:
    """Rows of which the longer word is the shorter one with one more letter."""
    n = short.shape[1]
    head = np.cumprod(short == long[:, :n], axis=1).sum(axis=1) if n else np.zeros(len(short), np.int64)
    tail = np.cumprod((short == long[:, 1:])[:, ::-1], axis=1).sum(axis=1) if n else np.zeros(len(short), np.int64)
    return head + tail >= n


class Cell:
    """The words of one cell, all of one length, and what is near them."""

    def __init__(self, words: list[str], ns: np.ndarray, leaf: int):
        self.words, self.ns, self.length = words, ns, len(words[0])
        self.letters = letters(words, self.length)
        self.counts = counts(self.letters)
        self.bits = codes_of_counts(self.counts)
        self.tree = Tree(self.counts, leaf, True)

    def near(self, asked: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (row of ``asked``, row of the cell) one edit apart; words asked have the cell's length or one less."""
        x = letters(asked, len(asked[0]))
        same = x.shape[1] == self.length
        points = counts(x)
        bits = codes_of_counts(points)
        rows_out, found_out = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for node, rows in self.tree.reach(points, 1, 1 if same else 0):
            members = self.tree.members[node]
            for at in range(0, len(rows), max(1, 2_000_000 // len(members))):
                part = rows[at:at + max(1, 2_000_000 // len(members))]
                i, j = np.nonzero(np.bitwise_count(bits[part][:, None] ^ self.bits[members]) <= (2 if same else 1))
                i, j = part[i], members[j]
                for k in range(0, len(i), 500_000):
                    a, b = i[k:k + 500_000], j[k:k + 500_000]
                    ok = (one_replaced if same else one_inserted)(x[a], self.letters[b])
                    rows_out.append(a[ok])
                    found_out.append(b[ok])
        return np.concatenate(rows_out), np.concatenate(found_out)


# search ---------------------------------------------------------------------------------------


def cell_trees(words: DataFrame, target: int, cells: int, sample: int) -> tuple[dict[int, Tree], int]:
    """Trees over the cells of the lengths that need more than one, and the number of words."""
    per_length = words.groupBy(F.length("word").alias("length")).agg(F.count("*").alias("n"))
    total = per_length.agg(F.sum("n")).first()[0] or 0
    target = max(target, -(-total // cells))
    wide = {r["length"]: r["n"] for r in per_length.filter(F.col("n") > target).collect()}
    if not wide:
        return {}, total
    share = min(1.0, sample / total)
    taken = words.filter(F.length("word").isin(*wide) & (F.pmod(F.xxhash64("word", F.lit(5)), F.lit(1_000_000)) < int(share * 1_000_000)))
    by_length: dict[int, list[str]] = {}
    for word in taken.select("word").toArrow().column("word").to_pylist():
        by_length.setdefault(len(word), []).append(word)
    return {length: Tree(counts(letters(sorted(found), length)), max(1, int(target * share)), False)
            for length, found in by_length.items()}, total


def place(words: DataFrame, trees: dict[int, Tree]) -> DataFrame:
    """cell, asked (0 where a word is stored, 1 where it is asked for), word, n."""
    def keyed(length: int, node) -> np.ndarray:
        return np.asarray(node, np.int64) + (length << 24)

    def run(batches):
        for batch in batches:
            words_, ns = batch.column("word").to_pylist(), batch.column("n").to_numpy()
            by_length: dict[int, list[int]] = {}
            for k, w in enumerate(words_):
                by_length.setdefault(len(w), []).append(k)
            for length, rows in by_length.items():
                rows = np.array(rows)
                points = counts(letters([words_[k] for k in rows], length))
                cell, asked, row = [], [], []
                tree = trees.get(length)
                cell.append(keyed(length, tree.home(points) if tree else np.zeros(len(rows), np.int64)))
                asked.append(np.zeros(len(rows), np.int8))
                row.append(rows)
                for to, take in ((length, 1), (length + 1, 0)):
                    tree = trees.get(to)
                    for node, part in tree.reach(points, 1, take) if tree else [(0, np.arange(len(rows)))]:
                        cell.append(keyed(to, np.full(len(part), node)))
                        asked.append(np.ones(len(part), np.int8))
                        row.append(rows[part])
                row = np.concatenate(row)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(cell)), pa.array(np.concatenate(asked)), pa.array([words_[k] for k in row], pa.string()),
                     pa.array(ns[row])], names=["cell", "asked", "word", "n"])

    return words.mapInArrow(run, "cell bigint, asked tinyint, word string, n bigint")


def _best(row: np.ndarray, words: list[str], other: np.ndarray, others: list[str], other_n: np.ndarray):
    """word, number of near words, n and word of the best of each row that has any; ``others`` are in order."""
    order = np.lexsort((other, -other_n[other], row))
    row, other = row[order], other[order]
    starts = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
    many = np.diff(np.r_[starts, len(row)])
    return pa.RecordBatch.from_arrays(
        [pa.array([words[k] for k in row[starts]], pa.string()), pa.array(many.astype(np.int64)),
         pa.array(other_n[other[starts]].astype(np.int64)), pa.array([others[k] for k in other[starts]], pa.string())],
        names=["word", "n_near", "best_n", "best"])


def _searched(leaf: int):
    def run(batches):
        cell, words, ns, built = None, [], [], None
        for batch in batches:
            if not len(batch):
                continue
            key, asked = batch.column("cell").to_numpy(), batch.column("asked").to_numpy()
            all_words, all_n = batch.column("word"), batch.column("n").to_numpy()
            starts = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (asked[1:] != asked[:-1])])
            for a, b in zip(starts, [*starts[1:], len(key)]):
                part, part_n = all_words.slice(a, b - a).to_pylist(), all_n[a:b]
                if key[a] != cell:
                    cell, words, ns, built = key[a], [], [], None
                if asked[a] == 0:
                    words += part
                    ns.append(part_n)
                    continue
                if not words:
                    continue
                if built is None:
                    built = Cell(words, np.concatenate(ns), leaf)
                for length in {len(w) for w in part}:
                    rows = [k for k, w in enumerate(part) if len(w) == length]
                    given, given_n = [part[k] for k in rows], part_n[rows]
                    i, j = built.near(given)
                    if not len(i):
                        continue
                    yield _best(i, given, j, built.words, built.ns)
                    if length < built.length:
                        yield _best(j, built.words, i, given, given_n)
    return run


def near_words(words: DataFrame, target: int = 10_000, cells: int = 4096, sample: int = 200_000, leaf: int = 48) -> DataFrame:
    """word, n_near, best_n and best of every word with words one edit apart; ``words`` has word (distinct) and n.

    The best near word has the largest n; of equal ones the first in code point order.
    """
    trees, total = cell_trees(words, target, cells, sample)
    placed = place(words, trees)
    parts = max(int(words.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // target))
    found = (placed.repartition(parts, "cell").sortWithinPartitions("cell", "asked", "word")
             .mapInArrow(_searched(leaf), "word string, n_near bigint, best_n bigint, best string"))
    best = F.min(F.struct((-F.col("best_n")).alias("n"), F.col("best").alias("w")))
    return (found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("b"))
            .select("word", "n_near", (-F.col("b.n")).alias("best_n"), F.col("b.w").alias("best")))


def followed(forms: DataFrame) -> DataFrame:
    """word and root of the links (word, form), by doubling: each round a word takes the root of its root."""
    now = stored(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        ahead = now.select(F.col("word").alias("_at"), F.col("root").alias("_next"))
        nxt = stored(now.join(ahead, now["root"] == ahead["_at"], "left")
                     .select("word", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("moved")), "roots")
        now = nxt.select("word", "root")
        if nxt.filter("moved").isEmpty():
            return now


def variants(words: DataFrame, ratio: float = 2, **options) -> DataFrame:
    """word, form, root, n, n_near, form_n of all ``words`` (word, n); options as of ``near_words``.

    A word's form is its best near word if that occurs ``ratio`` times as often or more; its root follows forms.
    """
    if ratio <= 1:
        raise ValueError("the ratio is above 1")
    words = stored(words.filter(F.col("word").isNotNull()).groupBy("word").agg(F.sum("n").alias("n")), "words")
    near = near_words(words, **options)
    has = F.col("best_n") >= F.col("n") * ratio
    linked = stored(words.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"),
        F.when(has, F.col("best")).alias("form"), F.when(has, F.col("best_n")).alias("form_n")), "linked")
    roots = followed(linked.filter(F.col("form").isNotNull()))
    return (linked.join(roots, "word", "left")
            .select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"))
