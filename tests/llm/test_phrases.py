"""Collocations against a brute-force count."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from salesloom.llm import phrases


def expected(rows, longest, least, covered, top):
    f, n = Counter(), Counter()
    for text, lang in rows:
        lang = lang or "und"
        lower = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0a-\x0d]", lower):
            ws = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(ws)
            for k in range(1, longest + 1):
                f.update((lang, *ws[i : i + k]) for i in range(len(ws) - k + 1))
    often = {p: a for p, a in f.items() if len(p) > 2 and a >= least}
    out = {}
    for p, a in often.items():
        lang, ws = p[0], p[1:]
        inside = [q for q in often if q[0] == lang and len(q) > len(p) and any(q[i : i + len(ws)] == ws for i in range(1, len(q)))]
        if any(100 * often[q] >= covered * a for q in inside):
            continue
        cuts = [(2000000 * a // (f[lang, *ws[:k]] + f[lang, *ws[k:]]), k) for k in range(1, len(ws))]
        score, k = min(cuts)
        out.setdefault(lang, []).append((-score, -a, " ".join(ws).encode(), f[lang, *ws[:k]], f[lang, *ws[k:]]))
    return sorted(
        (lang, rank, p.decode(), -a, left, right, n[lang], -score)
        for lang, found in out.items()
        for rank, (score, a, p, left, right) in enumerate(sorted(found)[:top], 1)
    )


def got(frame):
    return sorted(tuple(r[c] for c in ("lang", "rank", "phrase", "a", "l", "r", "n", "score")) for r in frame.collect())


@pytest.fixture(scope="module")
def rows():
    draw = random.Random(3)
    some = ["alpha", "Beta", "gamma", "é", "日本", "x y", "delta\x1c", "🙂"]
    texts = []
    for k in range(300):
        words = [draw.choice(some) for _ in range(draw.randrange(40))]
        apart = [draw.choice([" ", " ", "  ", "\t", " ", ", ", ".", "\n", "\x0b", "\r\n"]) for _ in words]
        texts.append(("".join(w + s for w, s in zip(words, apart)), draw.choice(["en", "fr", None])))
    texts += [(None, "en"), ("", "en"), (" \t\n.", None), ("beta beta beta beta " * 4000, "en"), ("beta gamma", "und")]
    return texts + texts[:20]


@pytest.mark.parametrize("least,top,covered", [(30, 2000, 80), (2, 15, 80), (5, 2000, 40)])
def test_collocations_are_brute_force(spark, rows, least, top, covered):
    frame = spark.createDataFrame([(k, *r, "x", "y") for k, r in enumerate(rows)], "doc_id long, text string, lang string, key string, words string")
    found = phrases.collocations(frame.repartition(5), least=least, top=top, covered=covered)
    assert got(found) == expected(rows, 4, least, covered, top)


def test_a_full_filter_changes_nothing(spark, rows):
    frame = spark.createDataFrame([(str(k), *r) for k, r in enumerate(rows)], "doc_id string, text string, lang string")
    assert got(phrases.collocations(frame, least=3, bits=6)) == expected(rows, 4, 3, 80, 2000)


def test_pointers_show_the_phrase(spark, rows):
    frame = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "doc_id long, text string, lang string")
    found = phrases.frequent_phrases(frame, least=3).where("words > 0").collect()
    assert found
    for r in found:
        there = (rows[r.id][0] or "").encode()[r.place :].decode().lower()
        assert " ".join(there.split(" ")).startswith(r.phrase.split(" ")[0])
        assert r.phrase == " ".join(re.findall(r"[^ \t]+", there)[: r.words])[: len(r.phrase)]


def test_entries_survive_their_blobs():
    keys = np.sort(np.random.default_rng(1).integers(0, 1 << 63, 1000).astype(np.uint64) * np.uint64(2))
    keys = np.unique(keys)
    counts, buckets = np.arange(len(keys)) + 1, np.arange(len(keys)) % phrases.BUCKETS
    batch = phrases._blobs((keys, counts, buckets), 60)
    parts = [phrases._entries(b) for b in batch.column("blob").to_pylist()]
    assert len(parts) == 16
    again = phrases._added(parts + parts)
    assert (again[0] == keys).all() and (again[1] == 2 * counts).all() and (again[2] == buckets).all()


@pytest.mark.parametrize("width", [3, 12])
def test_colliding_fingerprints_are_told_apart(spark, rows, width):
    frame = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "doc_id long, text string, lang string")
    assert got(phrases.collocations(frame, least=3, width=width)) == expected(rows, 4, 3, 80, 2000)


def test_fingerprints_do_not_depend_on_place():
    one = phrases.sequences([b"a bb ccc"], np.zeros(1, np.uint64))
    two = phrases.sequences([b"x", b"zz  A\tbb   ccc!", b""], np.zeros(3, np.uint64))
    for k in (1, 2, 3):
        assert set(one.fingerprints(k)) <= set(two.fingerprints(k))
    assert two.whole(2).tolist() == [False, True, True, True]
    assert len(phrases.sequences([b""], np.zeros(1, np.uint64)).fingerprints(2)) == 0


def test_empty_table_and_other_columns(spark, docs, none):
    renamed = ["doc_id", "text", "row", "key", "lang", "n_words", "kept", "id", "line"]
    assert phrases.collocations(none.toDF(*renamed)).collect() == []
    table = docs.toDF(*renamed)
    assert got(phrases.collocations(table, least=2)) == expected([(r.text, r.lang) for r in table.collect()], 4, 2, 80, 2000)


def test_languages_of_similar_names_are_counted_apart(spark):
    # "b" of one language and "z" of another had one fingerprint by both polynomials
    rows = [("b x b y b", "a"), ("z x z y z", "b"), ("c at c at", "en"), ("d at d at", "en"), ("x at x at", "es")]
    rows = [(" ".join([t] * 9), lang) for t, lang in rows]
    frame = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "doc_id long, text string, lang string")
    assert got(phrases.collocations(frame, least=2, covered=101)) == expected(rows, 4, 2, 101, 2000)
    langs = ["a", "b", "en", "es", "de", "da", "und", ""]
    words = [bytes([c, *end]) for end in (b"", b"at", b" house") for c in range(97, 123)]
    seen = set()
    for lang in langs:
        for w in words:
            one = phrases.sequences([w], np.array([phrases._salt(lang)], np.uint64))
            seen.add(int(one.fingerprints(1 + w.count(b" "))[0]))
    assert len(seen) == len(langs) * len(words)


def test_long_words_whose_polynomials_are_equal(spark):
    one = "a"
    while len(one) < 2048:  # Thue-Morse
        one += one.translate(str.maketrans("ab", "ba"))
    other = one.translate(str.maketrans("ab", "ba"))
    rows = [(f"{one} x {other} y", "en")] * 3 + [(f"{other} x", "en")] * 2
    frame = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "doc_id long, text string, lang string")
    assert got(phrases.collocations(frame, least=2, covered=101)) == expected(rows, 4, 2, 101, 2000)


def test_texts_without_any_word(spark):
    frame = spark.createDataFrame([(1, None, "en"), (2, " \t.", "fr"), (3, "", None)], "doc_id long, text string, lang string")
    assert phrases.collocations(frame.coalesce(1), least=2).collect() == []


def test_a_task_hands_on_small_batches(spark, rows, monkeypatch):
    # Two tasks and the heap of an executor of 3000 MB leave some 500 MB to a Python worker
    assert phrases.HELD * 24 <= 32 << 20 and phrases.CHUNK * 2 * 4 * 8 <= 64 << 20
    monkeypatch.setattr(phrases, "HELD", 50)
    monkeypatch.setattr(phrases, "CHUNK", 100)
    frame = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "doc_id long, text string, lang string")
    assert got(phrases.collocations(frame.coalesce(1), least=3)) == expected(rows, 4, 3, 80, 2000)
