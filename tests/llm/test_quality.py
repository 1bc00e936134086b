import collections
import re

import numpy as np
import pytest

from terralex.llm import quality, rules
from terralex.llm.queries import queries


def brute(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    at, again = collections.defaultdict(list), set()
    for k in range(len(w) - 7):
        at[tuple(w[k : k + 8])].append(k)
    for places in at.values():
        if len(places) > 1:
            again.update(p + j for p in places for j in range(8))
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(again), len(w) < 20 or 100 * len(again) > 30 * len(w)


PROSE = "It was a bright day and the road went on past the old mill where nobody had lived for years, as far as we knew. "
CASES = {
    "clean": (PROSE * 1 + "Then came the river.\nA second line ends here too, and says something else about the hills and the sheep.", True),
    "shouting": ("\n".join(f"BUY THIS THING NUMBER {k} NOW OR REGRET IT FOREVER MY FRIEND!!" for k in range(9)), False),
    "navigation": ("\n".join(f"home{k} | about{k} | news{k} | shop{k} | help{k} | more{k}" for k in range(9)), False),
    "symbols": ("\n".join(f"wo{k}*** th{k}### is%%% odd&&& te{k}$$$ xt###" for k in range(9)), False),
    "boilerplate": ("\n".join(f"{k} cookies privacy terms of use, copyright {k} all rights reserved." for k in range(9)), False),
    "endless": (" ".join(f"w{k}" for k in range(300)), False),
    "short": ("Only a few words.", False),
}


def test_rules_by_case(spark):
    rows = spark.createDataFrame([(k, t) for k, (t, _) in CASES.items()], "doc_id string, text string")
    got = {r.doc_id: r for r in rules.clean(rows).collect()}
    assert {k: r.kept for k, r in got.items()} == {k: want for k, (_, want) in CASES.items()}
    assert got["clean"].clean_text == CASES["clean"][0] and got["shouting"].clean_text == ""


def test_mixed_document_keeps_its_good_lines(spark):
    nav = "home | about | news"
    text = f"{nav}\n{PROSE}\n{nav}\nAnd the last line says one more thing about the valley."
    r = rules.clean(spark.createDataFrame([(1, text)], "doc_id int, text string")).first()
    assert r.kept and r.clean_text == text.replace(f"{nav}\n", "") and r.n_bad_lines == 2 and r.n_dup_lines == 1


def test_base_counts_equal_brute_force(spark, sf, odd, no_docs):
    texts = odd + [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()] + ["a b c d e f g h " * 3, "\n\n a \n\n a \n", "é ü\nñ\n", "x\r\nx\nx\r"]
    got = {r.k: r for r in rules.clean(spark.createDataFrame(list(enumerate(texts)), "k int, text string"), id_col="k").collect()}
    for k, t in enumerate(texts):
        r = got[k]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == brute(t), t
    assert rules.clean(no_docs).count() == 0


def features(text):
    """The statistics by their definitions, one text at a time."""
    raw = (text or "").encode()
    w = re.findall(rb"[^\x20\x09-\x0D]+", raw)
    lines = raw.split(b"\n") if raw else []
    lines = lines[:-1] if lines and not lines[-1] else lines
    chars, n = sum(map(len, w)), len(w)
    share = lambda a, b: (a / max(b, 1)) ** 0.5
    count = lambda what: sum(c in what for c in raw)
    upper, lower = count(bytes(range(65, 91))), count(bytes(range(97, 123)))
    ends = collections.Counter(x[-1:] for x in w)
    top = max(collections.Counter(w).values(), default=0)
    return [
        np.log1p(n), np.log1p(chars / max(n, 1)), share(count(b"#*$%&|<>"), chars), share(upper, upper + lower), share(count(b"0123456789"), chars), share(sum(ends[bytes([c])] for c in b".!?:;\"')],"), n),
        share(n - len(set(w)), n), share(len(lines) - len(set(lines)), len(lines)), share(top, n), np.log1p(n / max(len(lines), 1)), share(ends[b"."], n), share(ends[b"!"], n),
    ]


def test_statistics_equal_their_definitions(spark, sf, odd):
    texts = odd + [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()] + ["a\n\nb\n\n", "\n", "A! b. c, 12"]
    got = {r.doc_id: r.x for r in quality.featured(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    for k, t in enumerate(texts):
        assert got[k] == pytest.approx(features(t)), (k, t)


def test_scores_come_from_the_statistics(spark):
    sf = "/root/testdata/sf0.001"
    from terralex.llm.queries import bucket

    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    got = {r.doc_id: r.score for r in quality.scored(docs, labels, bucket(5) != 0).collect()}
    texts = {r.doc_id: r.text for r in docs.collect()}
    known = [(r.doc_id, r.quality) for r in labels.where(bucket(5) != 0).orderBy("doc_id").collect() if r.quality in (0, 1) and r.doc_id in texts]
    y = np.array([q for _, q in known])
    model = quality.fit(np.array([features(texts[i]) for i, _ in known]), y, float(np.log((y == 1).sum() / (y == 0).sum())))
    assert got == pytest.approx({i: float(model.score(np.array([features(t)]))[0]) for i, t in texts.items()}, abs=1e-9)


def test_lines_with_a_pattern_of_their_own_are_told_apart():
    x = "a"
    for _ in range(10):
        x += x.translate(str.maketrans("ab", "ba"))
    raw = (x + "\n" + x.translate(str.maketrans("ab", "ba"))).encode()
    assert rules.judge(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))["n_dup_lines"].tolist() == [0]


def test_discriminant_equals_densities():
    rng = np.random.default_rng(0)
    x = np.concatenate([rng.normal(0, 1, (300, 3)), rng.normal(1, 2, (200, 3))])
    y = np.repeat([0, 1], [300, 200])
    m = quality.fit(x, y, 0.3)
    z = (x - m.center) / m.spread
    for k in (0, 1):
        cov = np.linalg.inv(m.factors[k].T @ m.factors[k])
        assert np.allclose(np.linalg.slogdet(cov)[1], m.logdets[k])
        d = z - m.means[k]
        assert np.allclose(((d @ m.factors[k].T) ** 2).sum(1), np.einsum("ij,jk,ik->i", d, np.linalg.inv(cov), d))
    assert ((m.score(x) > 0.5) == y).mean() > 0.7


def test_held_out_quality(spark):
    sf = "/root/testdata/sf0.01"
    got = queries()["op2_quality"](spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out").collect()
    good, bad = [r.score for r in got if r.quality == 1], [r.score for r in got if r.quality == 0]
    assert np.mean([g > b for g in good for b in bad]) > 0.97
    assert np.mean([r.predicted == r.quality for r in got]) > 0.95 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)


@pytest.mark.parametrize("labels,want", [([], 0.5), ([(1, 1, None), (2, 1, 0)], 1.0)])
def test_without_both_classes(spark, odd_docs, no_docs, labels, want):
    from terralex.llm.queries import bucket

    table = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = quality.scored(odd_docs, table, bucket(5) >= 0).collect()
    assert len(got) == odd_docs.count() and {r.score for r in got} == {want}
    assert quality.scored(no_docs, table, bucket(5) >= 0).count() == 0
