import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from terralex.llm import langid
from terralex.llm.queries import bucket, queries


def brute(grams, lang, raw):
    """Code length by the definition, byte by byte; grams: (context, byte) -> count for contexts of three bytes."""
    seen = sorted({b for _, c, b, _ in grams for b in (*c, b)} | {0})
    classes = seen + [None]
    weight = {b: 1 for b in seen} | {None: 256 - len(seen)}

    def counts(context):
        out = {}
        for who, c, b, n in grams:
            if who == lang and c[3 - len(context) :] == context:
                out[b] = out.get(b, 0) + n
        return out

    def p(context):
        low = p(context[1:]) if context else {b: 1 / 256 for b in classes}
        n = counts(context)
        if not n:
            return low
        left = sum(low[b] * weight[b] for b in classes if b not in n)
        total, kinds = sum(n.values()), len(n) if left > 0 else 0
        return {b: n[b] / (total + kinds) if b in n else low[b] / left * kinds / (total + kinds) for b in classes}

    bits, before = 0.0, (0, 0, 0)
    for b in raw:
        bits -= math.log2(p(before)[b if b in seen else None])
        before = (*before[1:], b)
    return bits


def test_code_lengths_equal_the_definition():
    rng = random.Random(1)
    texts = {"x": b"abracadabra abra", "y": b"bananas and ananas"}
    grams = []
    for lang, raw in texts.items():
        c = {}
        before = (0, 0, 0)
        for b in raw:
            c[before, b] = c.get((before, b), 0) + 1
            before = (*before[1:], b)
        grams += [(lang, k[0], k[1], n) for k, n in c.items()]
    codes = {who: [(c[0] << 24 | c[1] << 16 | c[2] << 8 | b, n) for w, c, b, n in grams if w == who] for who in texts}
    model = langid.Model(list(texts), [langid.fit(*(np.array(x) for x in zip(*codes[who]))) for who in texts])
    tests = [b"", b"abra", b"bandana", b"zz\xffz", bytes(rng.choices(b"abn ", k=60))]
    got = model.lengths(np.frombuffer(b"".join(tests), np.uint8), np.cumsum([0, *map(len, tests)]))
    for k, raw in enumerate(tests):
        for j, lang in enumerate(model.langs):
            assert got[k, j] == pytest.approx(brute(grams, lang, raw), rel=1e-5)
    for tree in model.trees:  # each node is a distribution over bytes
        for context in (0, ord("a"), ord("b") << 8 | ord("a"), ord("a") << 16 | ord("b") << 8 | ord("r"), 0xFFFFFF):
            assert np.exp2(-tree.cost((context << 8) + np.arange(256))).sum() == pytest.approx(1)


def test_a_context_that_has_seen_all_bytes():
    raw = bytes(range(256)) * 3
    tree = langid.fit(np.arange(256) + (7 << 8), np.ones(256))
    assert np.exp2(-tree.cost((7 << 8) + np.arange(256))).sum() == pytest.approx(1)
    assert np.isfinite(langid.Model(["x"], [tree]).lengths(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))).all()


def test_held_out_accuracy(spark, sf):
    got = queries()["op1_langid"](spark, sf)
    rows = got.join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert len(rows) > 20 and sum(r.lang == r.lang_pred for r in rows) >= 0.97 * len(rows)
    assert all(0 <= r.score <= 1 for r in rows)


def test_odd_texts(spark, odd_docs, no_docs):
    model = langid.train(odd_docs, bucket(3) != 1)
    got = langid.predict(odd_docs, model, keep=("text", "lang", "source")).collect()
    assert len(got) == odd_docs.count()
    for r in got:
        none = r.text is None or not any(ch.isalpha() for ch in r.text)
        assert (r.lang_pred == "und") == none and (r.score == 0) == none
    assert {r.lang_pred for r in langid.predict(odd_docs, None).collect()} == {"und"}
    assert langid.train(no_docs, F.lit(True)) is None and langid.predict(no_docs, model).count() == 0


def test_sample_is_bounded(spark):
    rows = spark.range(20_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 10 == 0, "b").otherwise("a").alias("lang"))
    n = {r.lang: r["count"] for r in langid.sampled(rows, "lang", "doc_id", 500).groupBy("lang").count().collect()}
    assert all(400 < k < 600 for k in n.values())
