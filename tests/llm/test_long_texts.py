"""A text of ten megabytes beside a short one goes through every operator."""

import hashlib
import re

import pytest

from terralex.llm import bpe, decontam, langid, lengths, minhash, pii, quality, rules, suffix, warc
from terralex.llm.queries import bucket, tokenizer

UNIT = "The river runs past the old mill, and box {} holds what was left of it in {}.\n"


@pytest.fixture(scope="module")
def long_text():
    return "".join(UNIT.format(k, k % 977) for k in range(125_000))  # ten megabytes


@pytest.fixture(scope="module")
def docs(spark, long_text):
    return spark.createDataFrame([(1, long_text, "en"), (2, long_text[: 10**6] + "end", "en"), (3, "Der Fluss war alt. " * 9, "de")], "doc_id long, text string, lang string")


def test_every_operator_takes_a_very_long_text(spark, docs, long_text):
    assert len(long_text) > 9 * 10**6
    model = langid.train(docs, bucket(3) >= 0)
    assert {r.doc_id: r.lang_pred for r in langid.predict(docs, model).collect()} == {1: "en", 2: "en", 3: "de"}
    assert quality.featured(docs).count() == 3
    near = {r.doc_id: r for r in minhash.near_duplicates(docs).collect()}
    w = re.findall(r"[^\x20\x09-\x0D]+", long_text.lower())
    assert near[1].n_shingles == len({tuple(w[k : k + 5]) for k in range(len(w) - 4)}) and all(r.kept for r in near.values())
    cut = {r.doc_id: r for r in suffix.without_repeats(docs, text=False).collect()}
    assert cut[1].n_bytes == len(long_text) and 10**6 - 100 <= cut[2].n_removed <= 10**6 and cut[2].n_spans >= 1
    pages = docs.selectExpr("doc_id AS page_id", "'u' AS url", "text AS html")
    assert {r.page_id: r.payload_digest for r in warc.round_trip(pages).collect()}[1] == hashlib.sha256(long_text.encode()).hexdigest()
    found = pii.report(pii.find(docs), "doc_id")
    assert {r.doc_id: r.n_email for r in found.collect()} == {1: 0, 2: 0, 3: 0}
    bench = spark.createDataFrame([(7, "box 100 holds what was left of it in 100 the river")], "item_id long, text string")
    hit = {r.doc_id: r.n_hit for r in decontam.contamination(docs, bench).collect()}
    assert hit[1] >= 10 and hit[3] == 0
    judged = {r.doc_id: r for r in rules.clean(docs, text=False).collect()}
    assert judged[1].n_words == len(w) and judged[1].word_chars == sum(map(len, w))
    coded = {r.doc_id: r for r in bpe.encode(docs, *tokenizer(), ids=False).collect()}
    assert coded[1].decoded_sha256 == hashlib.sha256(long_text.encode()).hexdigest()
    sums = lengths.suffix_sums(lengths.histogram(docs, *tokenizer())).collect()
    assert {r.n_tokens for r in sums} == {r.n_tokens for r in coded.values()}
