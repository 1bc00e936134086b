import hashlib
import random

import numpy as np
import pytest
import tiktoken

from terralex.llm import bpe, lengths
from terralex.llm.queries import tokenizer


@pytest.fixture(scope="module")
def both():
    path, pattern = tokenizer()
    ranks = bpe.read_ranks(path)
    return bpe.Codec(ranks, pattern), tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def test_each_token_is_its_own_encoding(both):
    own, _ = both
    assert all(own.merge(t) == (i,) for t, i in list(own.ranks.items())[::7])


def test_a_vocabulary_without_the_property_is_refused(tmp_path):
    import base64

    tokens = [bytes([b]) for b in range(256)] + [b"ab", b"bc", b"abc"]  # b, c merge later than a, b: abc is a, b, c -> ab, c -> abc
    lines = lambda ts: b"\n".join(base64.b64encode(t) + f" {i}".encode() for i, t in enumerate(ts))
    (tmp_path / "good").write_bytes(lines(tokens))
    bpe.checked(str(tmp_path / "good"), "(?s).+")
    for name, ts in (("no byte", tokens[1:]), ("no way", [*tokens, b"xyz"])):
        (tmp_path / name).write_bytes(lines(ts))
        with pytest.raises(ValueError):
            bpe.checked(str(tmp_path / name), "(?s).+")


@pytest.mark.parametrize("leaf", [1, 2, 6, 16])
def test_trees_equal_the_library(both, leaf):
    own, library = bpe.Codec(both[0].ranks, tokenizer()[1], leaf=leaf, memo=500), both[1]
    rng = random.Random(leaf)
    pieces = list(own.ranks)
    for _ in range(150):
        text = rng.choice([
            "".join(rng.choices("tionherandé ß", k=rng.randint(0, 400))), b"".join(rng.choices(pieces, k=rng.randint(1, 80))).decode("utf-8", "replace"),
            rng.choice("aé=日") * rng.randint(1, 900), "".join(rng.choices("ab", k=rng.randint(1, 600))),
        ])
        assert own.encode(text) == library.encode_ordinary(text)
        assert own.decode(own.encode(text)).decode() == text


def test_long_match(both):
    text = "".join(random.Random(0).choices("etaoinshrdlu", k=30_000))
    assert both[0].encode(text) == both[1].encode_ordinary(text)


def test_table_of_odd_texts(spark, both, odd_docs, no_docs):
    got = bpe.encode(odd_docs, *tokenizer(), keep=("lang", "id")).collect()
    assert len(got) == odd_docs.count()
    texts = sorted((r.text or "" for r in odd_docs.collect()), key=lambda t: hashlib.sha256(t.encode()).hexdigest())
    for r, t in zip(sorted(got, key=lambda r: r.decoded_sha256), texts):
        want = both[1].encode_ordinary(t)
        assert (r.n_tokens, r.ids) == (len(want), want)
        assert r.ids_sha256 == hashlib.sha256(np.array(want, "<u4").tobytes()).hexdigest() and r.decoded_sha256 == hashlib.sha256(t.encode()).hexdigest()
    assert bpe.encode(no_docs, *tokenizer()).count() == 0
    with pytest.raises(ValueError):
        bpe.encode(odd_docs.withColumnRenamed("id", "ids"), *tokenizer(), keep=("ids",))


def test_decoding_concatenates(spark):
    rows = spark.createDataFrame([(1, both_ids := [1, 2, 3]), (2, []), (3, None)], "doc_id long, ids array<int>")
    got = {r.doc_id: r.text for r in bpe.decode(rows, *tokenizer()).collect()}
    codec = bpe.codec(*tokenizer())
    assert got == {1: codec.decode(both_ids).decode("utf-8", "replace"), 2: "", 3: ""}


def test_histogram_and_sums(spark, both, odd_docs, no_docs):
    n = sorted(len(both[1].encode_ordinary(r.text or "")) for r in odd_docs.collect())
    histogram = lengths.histogram(odd_docs, *tokenizer())
    sums = lengths.suffix_sums(histogram).orderBy("n_tokens").collect()
    assert [(r.n_tokens, r.n_docs) for r in sums] == [(k, n.count(k)) for k in sorted(set(n))]
    for r in sums:
        assert r.docs_at_least == sum(x >= r.n_tokens for x in n) and r.tokens_at_least == sum(x for x in n if x >= r.n_tokens)
        assert r.truncated_total == sum(min(x, r.n_tokens) for x in n)
    table = spark.createDataFrame(sums)
    limits = spark.createDataFrame([(k,) for k in (0, 1, 5, 100, 2500, 10**6)], "limit long")
    assert {r.limit: (r.total, r.n_cut) for r in lengths.truncated(histogram, limits).collect()} == {k: (sum(min(x, k) for x in n), sum(x > k for x in n)) for k in (0, 1, 5, 100, 2500, 10**6)}
    for q in (0.1, 0.5, 0.9, 1.0):
        assert lengths.quantile(table, q) == next(x for x in n if sum(y <= x for y in n) >= q * len(n))
    assert lengths.suffix_sums(lengths.histogram(no_docs, *tokenizer())).count() == 0 and lengths.quantile(table.limit(0), 0.5) is None
