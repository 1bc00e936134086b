import hashlib
import random
import re

import numpy as np
import pytest

from terralex.llm import decontam

LOW = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOW))


def brute(text, items):
    w, hit, found = words(text), set(), set()
    for i, t in items:
        own = words(t)
        for k in range(max(1, len(own) - 9)) if own else ():
            window = own[k : k + 10]
            for s in range(len(w) - len(window) + 1):
                if w[s : s + len(window)] == window:
                    hit.update(range(s, s + len(window)))
                    found |= {str(i)} - {"None"}
    return len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)


@pytest.mark.parametrize("size", [decontam.SLICE, 300])
def test_equals_brute_force(spark, odd_docs, no_docs, monkeypatch, size):
    monkeypatch.setattr(decontam, "SLICE", size)  # 300: several slices
    rng = random.Random(0)
    word = lambda: rng.choice(["the", "of", "and", "to"]) if rng.random() < 0.7 else "".join(rng.choices("abcé", k=3))
    items = [(k, " ".join(word() for _ in range(rng.choice([0, 1, 3, 9, 10, 11, 25])))) for k in range(40)] + [(40, None), (41, "the the the the the the the the the the the"), (None, "of of of")]
    rows = []
    for k in range(80):
        parts = [" ".join(word() for _ in range(20))]
        if k % 2:
            own = words(rng.choice(items[:40])[1])
            parts.append(rng.choice([" ", "... ", "-\n"]).join(own[rng.randrange(3) :]).upper())
        parts.append("the " * (k % 13))
        rows.append((k, " ".join(parts)))
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontam.contamination(spark.createDataFrame(rows, "doc_id long, text string"), bench).collect()
    for r in got:
        assert (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) == brute(rows[r.doc_id][1], items)
        assert len(r["items"]) == r.n_items
    assert decontam.contamination(odd_docs, bench, keep=("text", "lang")).count() == odd_docs.count()
    assert decontam.contamination(no_docs, bench).count() == 0
    assert not any(r.contaminated for r in decontam.contamination(odd_docs, bench.limit(0)).collect())


def test_windows_of_items():
    p = decontam.phrases([(str(k % 9), f"a b c d e f g h i j k{k} l{k}") for k in range(10)] + [("x", "a b"), (None, "a b"), ("y", "")])
    assert [w.shape for w in p.words] == [(1, 2), (21, 10)] and [len(w) for w in p.who] == [2, 30]


def test_an_item_without_an_id_hits_words(spark):
    bench = spark.createDataFrame([(None, "one two three"), (4, "three four")], "item_id long, text string")
    r = decontam.contamination(spark.createDataFrame([(1, "zero one two three four")], "doc_id long, text string"), bench).first()
    assert (r.n_hit, r.n_items, r["items"], r.contaminated) == (4, 1, ["4"], True)


def test_postings_and_proximity(spark):
    rows = spark.createDataFrame([(1, "The cat. the CAT sat"), (2, None), (3, "sat")], "doc_id long, text string")
    got = {(r.term, r.doc_id): r.positions for r in decontam.postings(rows, ["cat", "sat", "dog"]).collect()}
    assert got == {("cat", 1): [1, 3], ("sat", 1): [4], ("sat", 3): [0]}
    raw = b"cat x sat y y y y cat cat sat"
    terms = np.sort(decontam.tokens(np.frombuffer(b"cat sat", np.uint8), np.array([0, 7]))[0])
    shard = decontam.Shard(*decontam.tokens(np.frombuffer(raw, np.uint8), np.array([0, len(raw)])), terms)
    cat = int(np.searchsorted(terms, decontam.tokens(np.frombuffer(b"cat", np.uint8), np.array([0, 3]))[0][0]))
    a, b = shard.near(cat, 1 - cat, 2)
    assert list(zip(a.tolist(), b.tolist())) == [(0, 2), (7, 9), (8, 9)]


def brute_near(text, items):
    """Words in, and items of, places that are a window but for one word: left out, other or added inside."""
    w, hit, found = words(text), set(), set()
    for i, t in items:
        own = words(t)
        for k in range(max(1, len(own) - 9)) if own else ():
            window = own[k : k + 10]
            forms = [window]
            if len(window) >= 5:
                forms += [window[:x] + window[x + 1 :] for x in range(len(window))]
                forms += [window[:x] + [None] + window[x + 1 :] for x in range(1, len(window) - 1)]
                forms += [window[:x] + [None] + window[x:] for x in range(1, len(window))]
            for form in forms:
                for s in range(len(w) - len(form) + 1):
                    if all(x is None or x == y for x, y in zip(form, w[s : s + len(form)])):
                        hit.update(range(s, s + len(form)))
                        found.add(str(i))
    return len(hit), sorted(found)


@pytest.mark.parametrize("size", [decontam.SLICE, 400])
def test_proximity_equals_brute_force(spark, monkeypatch, size):
    monkeypatch.setattr(decontam, "SLICE", size)
    monkeypatch.setattr(decontam, "MAX_PLACES", 100)
    rng = random.Random(1)
    word = lambda: rng.choice(["the", "of"]) if rng.random() < 0.5 else "".join(rng.choices("abc", k=2))
    items = [(k, " ".join(word() for _ in range(rng.choice([1, 4, 5, 6, 7, 9, 10, 11, 25])))) for k in range(40)] + [(40, "the the the the the the the the the the the")]
    rows = []
    for k in range(120):
        own = words(rng.choice(items)[1])
        for _ in range(rng.randrange(3)):
            x = rng.randrange(len(own) + 1)
            own[x : x + rng.randrange(2)] = [word()] * rng.randrange(2)
        rows.append((k, " ".join([word() for _ in range(rng.randrange(4))] + own + ["the"] * (k % 12))))
    got = decontam.contamination(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert len(got) == len(rows) and any(r.n_near > r.n_hit for r in got)
    for r in got:
        assert (r.n_near, r.near_items) == brute_near(rows[r.doc_id][1], items)
        assert (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) == brute(rows[r.doc_id][1], items)


def test_a_passage_altered_in_every_window_is_near(spark):
    own = [f"w{k}" for k in range(40)]
    altered = [x if k % 10 != 5 else "other" for k, x in enumerate(own)]
    added = [y for k, x in enumerate(own) for y in ([x, "more"] if k % 9 == 4 else [x])]
    rows = [(1, " ".join(altered)), (2, " ".join(added)), (3, " ".join(own)), (4, " ".join(own[::2]))]
    got = {r.doc_id: r for r in decontam.contamination(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(7, " ".join(own))], "item_id long, text string")).collect()}
    assert [got[k].contaminated for k in (1, 2, 3, 4)] == [False, False, True, False]
    assert [got[k].near_items for k in (1, 2, 3, 4)] == [["7"], ["7"], ["7"], []]
    assert got[1].n_near == 40 and got[2].n_near == len(added)


def test_the_index_is_a_stored_table(spark):
    docs = spark.createDataFrame([("The cat. the CAT sat",), (None,), ("sat",)], "text string")
    terms = np.sort(decontam.tokens(np.frombuffer(b"cat sat", np.uint8), np.array([0, 7]))[0])
    cat = int(np.searchsorted(terms, decontam.tokens(np.frombuffer(b"cat", np.uint8), np.array([0, 3]))[0][0]))
    by = {cat: [1, 3], 1 - cat: [4]}
    got = [(r.n_words, r.terms, r.counts, r.positions) for r in decontam.indexed(docs, terms).collect()]
    assert sorted(got) == sorted([(5, [0, 1], [len(by[0]), len(by[1])], by[0] + by[1]), (0, [], [], []), (1, [1 - cat], [1], [0])])
    assert decontam.term_counts(decontam.indexed(docs, terms), 2)[cat] == 2
