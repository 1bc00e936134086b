import random
import re
from itertools import combinations

import numpy as np
import pytest

from terralex.llm import graph, minhash
from terralex.llm.store import Shelf

LOW = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOW))
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute(rows):
    """Component of each id, over all pairs."""
    sets = {}
    for i, t in rows:
        if i is not None:
            sets.setdefault(i, []).append(shingles(t))
    up = {i: i for i in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in combinations(sorted(sets), 2):
        for x in sets[a]:
            for y in sets[b]:
                c = len(x & y)
                if c and 100 * c >= 75 * (len(x) + len(y) - c):
                    p, q = find(a), find(b)
                    up[max(p, q)] = min(p, q)
    return {i: find(i) for i in sets}


def corpus(seed=0, n=60):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices("abcdefgh", k=rng.randint(1, 4)))
    rows, base = [], []
    for k in range(n):
        base.append([word() for _ in range(rng.choice([1, 3, 5, 8, 40, 200]))])
    for k in range(4 * n):
        w = list(rng.choice(base[: n // 3] if k % 3 else base))
        for _ in range(rng.choice([0, 0, 1, 2, 4, 8])):
            w[rng.randrange(len(w))] = word()
        text = " ".join(w)
        rows.append((rng.randrange(10**6), text.upper() if k % 7 == 0 else text.replace(" ", "\n", 2)))
    passage = " ".join(word() for _ in range(70))
    rows += [(2 * 10**6 + k, f"{passage} {' '.join(word() for _ in range(30))}") for k in range(30)]
    return rows


@pytest.mark.parametrize("block", [8, 256])
def test_components_equal_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(minhash, "BLOCK", block)  # 8: all bands go by blocks
    rows = list({i: (i, t) for i, t in corpus(block)}.values())
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    want = brute(rows)
    assert {r.doc_id: r.component_id for r in got} == want and len(got) == len(rows)
    assert {r.doc_id: r.n_shingles for r in got} == {i: len(shingles(t)) for i, t in rows}
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_open_members_of_a_band_of_one_block_are_sent_once(spark, monkeypatch):
    rows = spark.range(1500).selectExpr("7L as key", "3 as band", "id as cid", "if(id < 900, 0, id) as c", "100L as n", "cast('' as binary) as registers", "1500L as size", "0L as lead")
    sent = minhash.dealt(rows)
    assert sent.count() == 1500 and sent.select("led", "x", "y").distinct().count() == 1
    monkeypatch.setattr(minhash, "BLOCK", 400)
    groups = {}
    for r in minhash.dealt(rows).collect():
        groups.setdefault((r.led, r.x, r.y), []).append(r.cid)
    assert max(map(len, groups.values())) <= 1000
    met = {frozenset((a, b)) for g in groups.values() for a in g for b in g if a >= 900 and b >= 900 or (a < 900) != (b < 900)}
    assert len(met) == 600 * 601 // 2 + 600 * 900


def test_odd_texts(spark, odd_docs, no_docs):
    got = minhash.near_duplicates(odd_docs).collect()
    assert len(got) == odd_docs.count()
    want = brute([(r.doc_id, r.text) for r in odd_docs.collect()])
    assert all(r.component_id == (None if r.doc_id is None else want[r.doc_id]) for r in got)
    assert [r.kept for r in got if r.doc_id is None] == [True]
    assert minhash.near_duplicates(no_docs).count() == 0


def test_rows_of_one_id_share_what_can_be_reached(spark):
    rng = random.Random(9)
    a, b, c = (" ".join(f"{x}{rng.randrange(1000)}" for _ in range(30)) for x in "abc")
    rows = [(1, a), (5, a), (5, b), (9, b), (12, c), (5, c), (20, "x y"), (21, "x y"), (22, "x z")]
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.component_id) for r in got) == [(1, 1), (5, 1), (5, 1), (5, 1), (9, 1), (12, 1), (20, 20), (21, 20), (22, 22)]
    # an id with several texts of which the least id's is not the one in question
    near = a.split()
    near[0] = "other"
    rows = [(1, b), (1, a), (7, " ".join(near)), (8, "w" + b)]
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: c for i, c in brute(rows).items()}


def test_words_with_a_pattern_of_their_own_are_told_apart(spark):
    x = "a"
    for _ in range(10):
        x += x.translate(str.maketrans("ab", "ba"))
    y = x.translate(str.maketrans("ab", "ba"))
    got = minhash.near_duplicates(spark.createDataFrame([(1, x), (2, y), (3, x[:32]), (4, y[:32])], "doc_id long, text string")).collect()
    assert all(r.kept for r in got)


def test_registers_and_estimate():
    rng = np.random.default_rng(4)
    for j in (0.3, 0.75, 0.95):
        n = 2000
        common = int(2 * n * j / (1 + j))
        shared, a, b = (rng.integers(0, 1 << 63, k).astype(np.uint64) for k in (common, n - common, n - common))
        sets = [np.unique(np.concatenate([shared, x])) for x in (a, b)]
        regs = minhash.registers(np.concatenate(sets), np.cumsum([0, *map(len, sets)]))
        e = minhash.accident(np.array([float(n)]), np.array([float(n)]))[0]
        assert ((regs[0] == regs[1]).mean() - e) / (1 - e) == pytest.approx(j, abs=0.12)
    assert minhash.accident(np.array([5000.0]), np.array([300.0]))[0] < 0.001


@pytest.mark.parametrize("finish", [0, 1 << 20])
def test_chain_components(spark, monkeypatch, finish):
    monkeypatch.setattr(graph, "FINISH", finish)
    rng = random.Random(2)
    ids = rng.sample(range(10**6), 300)
    edges = [(ids[k], ids[k + 1]) for k in range(199)] + [(ids[200], x) for x in ids[201:]] + [(ids[0], ids[0])]
    got = {r.id: r.component for r in graph.components(spark.createDataFrame(edges, "a long, b long"), Shelf(spark, "t"), "c").collect()}
    assert got == {x: min(ids[:200]) for x in ids[:200]} | {x: min(ids[200:]) for x in ids[200:]}
    assert graph.components(spark.createDataFrame([], "a long, b long"), Shelf(spark, "t"), "d").count() == 0
