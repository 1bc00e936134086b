import math

import pytest

from terralex.operators import autocomplete, lm, spell
from terralex.operators import index as ix

CORPUS = [(1, ["3", "4", "5"]), (2, ["6", "5", "5", "5", "5"]), (3, ["11", "12", "6", "6", "6"])]


@pytest.fixture(scope="module")
def model(spark):
    return lm.Model.build(spark.createDataFrame(CORPUS, "doc_id long, tokens array<string>"))


def test_counts(model):
    rows = model.table().collect()
    assert [sum(len(r.g) == n for r in rows) for n in range(1, 5)] == [8, 13, 16, 17]
    assert model.total.first().total == 19
    assert {r.g[0]: r.c for r in rows if len(r.g) == 1} == {"<s>": 3, "</s>": 3, "3": 1, "4": 1, "5": 5, "6": 4, "11": 1, "12": 1}


def test_estimates_and_backoff(model, spark):
    rows = spark.createDataFrame([("6", "6", "6", "6"), ("5", "5", "5", "5"), ("9", "10", "11", "12"), ("9", "9", "9", "99")], "h3 string, h2 string, h1 string, w string")
    got = {r.w: r for r in model.estimates(rows).collect()}
    assert (got["6"].p1, got["6"].p2, got["6"].p3, got["5"].p4) == (4 / 19, 0.5, 0.5, 0.5)
    p = {r.w: r.p for r in model.backoff(rows).collect()}
    assert p["12"] == pytest.approx(0.16) and p["99"] == 0


def test_sequences(model, spark):
    seq = spark.createDataFrame([(1, ["5", "5", "12", "11"]), (2, ["99"]), (3, [])], "seq_id long, tokens array<string>")
    got = {r.seq_id: r.logp for r in model.score(seq).collect()}
    want = [0.4**3 * 5 / 19, 0.4**2 * 3 / 5, 0.4**3 / 19, 0.4**3 / 19, 0.4**3 * 3 / 19]
    assert got[1] == pytest.approx(sum(map(math.log, want)))
    assert got[2] is None and got[3] is not None


def test_stored_model(model, spark, tmp_path):
    model.save(str(tmp_path))
    again = lm.Model.load(spark, str(tmp_path))
    seq = spark.createDataFrame([(1, ["5", "5", "12", "11"]), (2, ["6"])], "seq_id long, tokens array<string>")
    assert again.total.first().total == 19 and {r.seq_id: r.logp for r in again.score(seq).collect()} == pytest.approx({r.seq_id: r.logp for r in model.score(seq).collect()})


def test_candidates_within_two_edits(spark):
    from itertools import product

    vocab = ["".join(p) for n in range(1, 5) for p in product("ab", repeat=n)] + ["kebun", "kebin", "tuben"]
    words = ["abba", "kebn", "b", "zzzzz", "kebunn"]
    frame = lambda xs: spark.createDataFrame([(x,) for x in xs], "term string")

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        return row[-1]

    want = {(w, v, distance(w, v)) for w in words for v in vocab if distance(w, v) <= 2}
    assert set(map(tuple, spell.candidates(frame(words), frame(vocab)).collect())) == want


@pytest.fixture(scope="module")
def places(spark):
    docs = spark.createDataFrame([(1, "Dunia Fantasi", "Ancol"), (2, "Kebun Binatang Ragunan", "Jakarta Selatan"), (3, "Monumen Nasional", "Gambir"), (4, "Monumen Pancasila", ""), (5, "Taman Mini", "")], "doc_id long, name string, address string")
    from terralex.plans.inputs import token_lists

    return ix.Index.build(docs), lm.Model.build(token_lists(docs))


def test_correction(spark, places):
    index, model = places
    q = spark.createDataFrame([(1, "Duniu Fsntaso"), (2, "Kebun Bibatqng Raginan"), (3, "zzzzzzzz"), (4, "taman qqqqqqqqq")], "query_id long, query string")
    got = {r.query_id: r.query for r in spell.corrected(q, index.vocabulary, model).collect()}
    assert got == {1: "dunia fantasi", 2: "kebun binatang ragunan", 4: "taman"}


def test_autocomplete(spark, places):
    index, model = places
    q = spark.createDataFrame([(1, "Monumen Nasi"), (2, "Kebun Binatang Ra"), (3, "unknown Ra"), (4, ""), (5, "mon")], "query_id long, query string")
    got = [(r.query_id, r.place, r.doc_id) for r in autocomplete.autocomplete(index, q, model).orderBy("query_id", "place").collect()]
    assert got == [(1, 1, 3), (2, 1, 2), (5, 1, 3), (5, 2, 4)]


def test_whole_benchmark_texts_are_scored(spark, sf):
    import re

    from terralex.plans import registry

    items = spark.read.parquet(f"{sf}/benchmark.parquet").collect()
    asked = set()
    for r in items:
        t = ["<s>"] * 4 + re.findall("[a-z0-9]+", r.text.lower()) + ["</s>"]
        asked |= {tuple(t[k - 3 : k + 1]) for k in range(4, len(t))}
    assert max(len(r.text.split()) for r in items) > 4
    assert {(r.h3, r.h2, r.h1, r.w) for r in registry.queries()["stupid_backoff"](spark, sf).collect()} == asked
