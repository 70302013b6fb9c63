"""Fill-in-middle, spelling variants and language identification against brute force and held-out accuracy."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from declara.llm import fim, langid, spelling
from declara.llm.queries import op11_fim, op12_spelling, op13_language

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, word string, n bigint, form string, hi bigint, place int"


def frame(spark, texts, langs=None):
    rows = [(i if i != 5 else None, t, (langs or ["x"] * len(texts))[i], "s", 1, "w", 1, "f", 1, 1) for i, t in enumerate(texts)]
    return spark.createDataFrame([*rows, rows[-1], rows[-1]], SCHEMA).repartition(3)


# fill-in-middle -------------------------------------------------------------------------------

UNITS = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plain_fim(doc_id, text):
    """n, form, prefix_chars, middle_chars, output of one document, by the contract's words."""
    units = UNITS.findall(text)
    n = len(units)
    digest = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[k:k + 8], 16) for k in (0, 8, 16, 24))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 50:
        return n, "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h4 % 100 < 80:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def fim_texts():
    rnd = random.Random(4)
    alphabet = ["a", "é", "😀", " ", "\n", "\t", "\x1c", "<", "P>", "S", ">", "M", " ", "word"]
    return [None, "", " ", " \n\t", "one", " one", "one ", "<P>", "a<S>b c", "<", "x" * 9000, "é" * 9001 + " " + "😀" * 777, "ab c " * 5000,
            *["".join(rnd.choice(alphabet) for _ in range(rnd.randint(1, 80))) for _ in range(150)]]


@pytest.mark.parametrize("chunk", [8, 100, 32768])
def test_outputs_and_digests(spark, chunk):
    texts = fim_texts()
    docs = frame(spark, texts)
    got = Counter(tuple(r) for r in fim.digests(docs, chunk=chunk).collect())
    want = Counter()
    for i, t in [*enumerate(texts), (len(texts) - 1, texts[-1]), (len(texts) - 1, texts[-1])]:
        doc_id = i if i != 5 else None
        n, form, a, b, out = plain_fim(doc_id, t or "")
        want[(doc_id, n, form, a, b, sha(out), sha(t or ""))] += 1
    assert got == want
    for r in fim.outputs(docs, chunk=chunk).select("*", fim.restored(docs).alias("back")).collect():
        given = texts[5 if r.doc_id is None else r.doc_id] or ""
        assert r.output == plain_fim(r.doc_id, given)[4] and r.back == given == fim.restore(r.output, r.form)


def test_pieces_are_bounded_and_repeats_counted(spark):
    docs = spark.createDataFrame([(7, "x y " * 300 + "😀" * 400)] * 5000, "doc_id int, text string").repartition(2)
    assert fim.pieces(docs, chunk=64).agg(F.max(F.octet_length("piece"))).first()[0] <= 64
    assert fim.pieces(docs, chunk=64).agg(F.sum("copies")).first()[0] == 5000
    assert fim.pieces(docs, chunk=64).filter("place = 0 and form is not null").count() <= 2
    assert Counter(r.n for r in fim.digests(docs, chunk=64).collect()) == {601: 5000}


def test_empty_tables(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert fim.digests(none).count() == fim.outputs(none).count() == 0
    assert spelling.variants(spelling.count_words(none)).count() == 0
    assert langid.identify(none).count() == 0


# spelling variants ----------------------------------------------------------------------------


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:k] + b[k + 1:] == a for k in range(len(b)))


def plain_variants(ns):
    by_length = defaultdict(list)
    for w in ns:
        by_length[len(w)].append(w)
    out, form = {}, {}
    for w, n in ns.items():
        around = [v for k in (-1, 0, 1) for v in by_length[len(w) + k] if near(w, v)]
        best = min(around, key=lambda v: (-ns[v], v), default=None)
        form[w] = best if best is not None and ns[best] >= 2 * n else None
        out[w] = len(around)
    rows = set()
    for w, n in ns.items():
        root = w
        while form[root] is not None:
            root = form[root]
        rows.add((w, form[w], root, n, out[w], ns.get(form[w])))
    return rows


def plain_counts(docs, every=97):
    out = Counter()
    for doc_id, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % every == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            out[run] += 1
    return {w: n for w, n in out.items() if len(w) >= 5 and n >= 3}


@pytest.mark.parametrize("target,leaf", [(10_000, 48), (20, 3)])
def test_variants_match_brute_force(spark, target, leaf):
    rnd = random.Random(target)
    ns = {"".join(rnd.choice("abÀé") for _ in range(rnd.randint(3, 8))): rnd.randint(1, 60) for _ in range(900)}
    ns |= {"aaaaa" + "a" * k: 2 ** k for k in range(12)}  # a long chain of forms
    ns |= {"".join(rnd.sample("abcdefg", 7)): 3 for _ in range(200)} | {"z" * 300: 9, "z" * 301: 1, "語彙語彙語": 4, "語彙語彙文": 9}
    words = spark.createDataFrame(list(ns.items()), "word string, n bigint")
    assert {tuple(r) for r in spelling.variants(words, target=target, leaf=leaf).collect()} == plain_variants(ns)


def test_words_are_counted_with_deletions(spark):
    rnd = random.Random(1)
    texts = [None, "", "123 !!", "ÀÉÈ×÷ ŁódźŁódź ﬀ", "Tea TEA tea coffee COFFEE coffée " * 40, "x" * 20_000,
             *[" ".join("".join(rnd.choice("AbÉç") for _ in range(rnd.randint(4, 6))) for _ in range(80)) for _ in range(80)]]
    docs = frame(spark, texts)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    for every, planted in ((97, 97), (3, 3)):
        got = {r.word: r.n for r in spelling.count_words(docs, delete_every=planted).collect()}
        assert got == plain_counts(rows, every)


def test_spelling_query(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    ns = plain_counts([(r.doc_id, r.text) for r in docs.collect()])
    got = op12_spelling(spark, data).select("word", "form", "root", "n", "n_near", "form_n")
    assert {tuple(r) for r in got.collect()} == plain_variants(ns)


# language -------------------------------------------------------------------------------------


def brute_marginals(emission, moves):
    """Probabilities by listing all label sequences."""
    t, k = emission.shape
    out, total = np.zeros((t, k)), 0.0
    for code in range(k ** t):
        path = [code // k ** i % k for i in range(t)]
        p = np.exp(moves[k, path[0]] + sum(emission[i, l] for i, l in enumerate(path)) + sum(moves[a, b] for a, b in zip(path, path[1:])))
        total += p
        for i, l in enumerate(path):
            out[i, l] += p
    return out / total


def test_forward_backward_lists_all_paths():
    rng = np.random.default_rng(0)
    lengths = np.array([5, 3, 3, 1])
    emission, moves = rng.normal(size=(12, 3)), rng.normal(size=(4, 3))
    got, moved, begun = langid.marginals(emission, lengths, moves)
    starts = np.cumsum(lengths) - lengths
    for a, n in zip(starts, lengths):
        assert np.allclose(got[a:a + n], brute_marginals(emission[a:a + n], moves))
    assert np.isclose(moved.sum(), (lengths - 1).sum()) and np.allclose(begun, got[starts])


def test_features_hold_affixes_and_grams():
    rows, many = langid.grams(["ab", "é", "abab"], 1 << 16)
    # |ab| : 3 pairs, 2 triples, 1 of four letters; |é| : 2 pairs and a triple; |abab| : 5, 4, 3 grams and two affixes of four letters
    assert list(many) == [6, 3, 14] and len(rows) == 23
    again, _ = langid.grams(["abab"], 1 << 16)
    assert list(again) == list(rows[9:])


LANGS = {"aa": ["lorem", "ipsum", "dolor", "amet", "sit"], "bb": ["zug", "weg", "haus", "baum", "über"], "cc": ["ñandú", "año", "niña", "el", "la"]}


def language_docs(spark, n=240):
    rnd = random.Random(8)
    texts, langs = [], []
    for i in range(n):
        name = rnd.choice(list(LANGS))
        texts.append(" ".join(rnd.choice(LANGS[name]) for _ in range(rnd.randint(1, 60))))
        langs.append(name)
    texts[:5], langs[:5] = [None, "", "12 34 !", "weg " * 30_000, "Zug 7 WEG\n\x00"], ["aa", "aa", "bb", "bb", None]
    return frame(spark, texts, langs), texts, langs


def test_languages_are_told_apart(spark):
    docs, texts, langs = language_docs(spark)
    found = langid.identify(docs).collect()
    assert len(found) == len(texts) + 2
    by_id = {r.doc_id: r for r in found}
    assert all((by_id[i].lang_pred, by_id[i].score) == ("und", 0.0) for i in range(3))
    assert by_id[3].lang_pred == "bb" and by_id[4].lang_pred == "bb"
    assert all(0.0 <= r.score <= 1.0 for r in found)
    wrong = [i for i in range(6, len(texts)) if by_id[i].lang_pred != langs[i]]
    assert len(wrong) <= 0.02 * len(texts)


def test_words_of_mixed_text_are_labelled(spark):
    docs, _, _ = language_docs(spark)
    model = langid.fit(docs)
    text = "lorem dolor amet weg baum haus zug niña año la"
    assert [l for _, l, _ in langid.label_words(model, text)] == ["aa"] * 3 + ["bb"] * 4 + ["cc"] * 3
    stays = model.moves[:3].diagonal() - np.sort(model.moves[:3], axis=1)[:, -2]
    assert (stays >= 0).all()


def test_nothing_to_learn_from(spark):
    docs = spark.createDataFrame([(1, "some words", None), (None, "x", "en")], "doc_id bigint, text string, lang string")
    assert {(r.lang_pred, r.score) for r in langid.identify(docs).collect()} == {("und", 0.0)}


def test_held_out_languages(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "lang")
    got = op13_language(spark, data).join(docs, "doc_id").collect()
    held = [r for r in got if r.held_out]
    assert {r.doc_id for r in held} == {r.doc_id for r in got if zlib.crc32(str(r.doc_id).encode()) % 4 == 2}
    assert sum(r.lang == r.lang_pred for r in held) >= 0.97 * len(held)


def test_every_text_is_restored(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in op11_fim(spark, data).collect():
        n, form, a, b, out = plain_fim(r.doc_id, texts[r.doc_id] or "")
        assert (r.n, r.form, r.prefix_chars, r.middle_chars, r.output_sha256, r.restored_sha256) == (n, form, a, b, sha(out), sha(texts[r.doc_id] or ""))
