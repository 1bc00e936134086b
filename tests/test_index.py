import math

import pytest

from terralex.operators import boolean, rank
from terralex.operators import index as ix

DOCS = [(1, "Jalan Sentosa Harapan", "Kota Baru"), (2, "Jalan Dunia Baru", ""), (3, "Jalan Mulwo Apel Apel", "apel"), (4, "Kebun", "Jalan-Raya 7"), (5, None, None)]


@pytest.fixture(scope="module")
def index(spark):
    return ix.Index.build(spark.createDataFrame(DOCS, "doc_id long, name string, address string"))


def test_postings_count_tokens(index):
    got = {(r.field, r.term, r.doc_id): r.tf for r in index.postings.collect()}
    assert got["name", "apel", 3] == 2 and got["address", "apel", 3] == 1 and got["address", "jalan", 4] == 1
    assert {d for f, t, d in got if t == "jalan"} == {1, 2, 3, 4}


def test_lengths_and_statistics(index):
    got = {(r.field, r.doc_id): r.len for r in index.lengths.collect()}
    assert got == {("name", 1): 3, ("name", 2): 3, ("name", 3): 4, ("name", 4): 1, ("address", 1): 2, ("address", 3): 1, ("address", 4): 3}
    stats = {r.field: r.avg_len for r in index.stats.collect()}
    assert stats == {"name": 11 / 4, "address": 2.0}
    assert index.corpus.first().n == 5 and index.corpus.first().avgdl == pytest.approx(17 / 5)


def test_bm25f_by_hand(index, spark):
    hits = rank.search(index, spark.createDataFrame([(1, "apel apel unknown")], "query_id long, query string")).collect()
    n, df = 5, 1
    idf = math.log10(n - df + 0.5) - math.log10(df + 0.5)
    part = lambda w, tf, length, avg: (x := w * tf / (1 + 0.95 * (length / avg - 1))) / (10 + x)
    want = 2 * idf * (part(20, 2, 4, 11 / 4) + part(1, 1, 1, 2))
    assert [(h.doc_id, h.score) for h in hits] == [(3, pytest.approx(want, abs=1e-6))]


def test_common_term_has_negative_weight(index, spark):
    hits = rank.search(index, spark.createDataFrame([(1, "jalan")], "query_id long, query string")).collect()
    assert len(hits) == 4 and all(h.score < 0 for h in hits)


def test_bm25_plus_and_tf_idf_by_hand(index, spark):
    q = spark.createDataFrame([(1, "apel apel")], "query_id long, query string")
    plus = rank.search(index, q, model="BM25_PLUS").first().score
    idf = math.log10(6) - math.log10(1)
    assert plus == pytest.approx(idf * (1 + (2.2 + 3) / (1.2 * (1 - 0.98 + 0.98 * 5 / 3.4) + 3)), abs=1e-6)
    tfidf = rank.search(index, q, model="TF_IDF_COSINE").first().score
    assert tfidf == pytest.approx((1 + math.log10(3)) * (1 + math.log10(2)) * math.log10(5) ** 2, abs=1e-6)


def test_pages(index, spark):
    q = spark.createDataFrame([(1, "jalan")], "query_id long, query string")
    everything = [r.doc_id for r in rank.search(index, q).orderBy("rank").collect()]
    assert [r.doc_id for r in rank.search(index, q, k=2, offset=1).orderBy("rank").collect()] == everything[1:3]
    assert rank.search(index, q, offset=4).count() == 0 and rank.search(index, q, k=0).count() == 4


def test_empty_query_and_corpus(spark, index):
    q = spark.createDataFrame([(1, ""), (2, None), (3, "?!")], "query_id long, query string")
    assert rank.search(index, q).count() == 0
    nothing = ix.Index.build(spark.createDataFrame([], "doc_id long, name string, address string"))
    assert rank.search(nothing, spark.createDataFrame([(1, "a")], "query_id long, query string")).count() == 0


def test_save_and_load(spark, index, tmp_path):
    index.save(str(tmp_path))
    again = ix.Index.load(spark, str(tmp_path))
    assert sorted(map(tuple, again.postings.select("field", "term", "doc_id", "tf").collect())) == sorted(map(tuple, index.postings.select("field", "term", "doc_id", "tf").collect()))
    assert "PushedFilters: [IsNotNull(term), EqualTo(term,apel)]" in ix.posting_list(again.postings, "apel")._jdf.queryExecution().toString()


def test_boolean_syntax(index):
    run = lambda e, f=None: sorted(r.doc_id for r in boolean.matches(index.docs, index.postings, e, f).collect())
    assert run("jalan AND baru") == [1, 2] and run("jalan baru", "name") == [2]
    assert run("apel OR kebun") == [3, 4] and run("NOT jalan") == [5] and run("jalan AND NOT (apel OR baru)") == [4]
    assert boolean.postfix("a OR b AND NOT c") == ["a", "b", "c", "NOT", "AND", "OR"]
    for wrong in ("", "a AND", "(a", "a)"):
        with pytest.raises(ValueError):
            run(wrong)


def test_runs(spark):
    rows = spark.createDataFrame([(1, k, v) for k, v in enumerate([4, 4, 5, 4])], "g int, o int, v int")
    assert sorted(map(tuple, ix.run_lengths(rows, "g", "o", "v").collect())) == [(1, 0, 4, 2), (1, 2, 5, 1), (1, 3, 4, 1)]
