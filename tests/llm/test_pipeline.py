import hashlib
import importlib


pipeline = importlib.import_module("corpus_pipeline")


def applied(spark, docs, sf, tmp_path):
    seen = [docs]
    for k, (_, stage) in enumerate(pipeline.STAGES):
        stage(spark, seen[-1], sf).write.parquet(f"{tmp_path}/{k}")
        seen.append(spark.read.parquet(f"{tmp_path}/{k}"))
    return seen


def test_stages_against_their_operators(spark, sf, tmp_path):
    from test_decontam import brute as hits
    from test_minhash import brute as groups
    from test_pii import brute as spans

    import tiktoken

    from terralex.llm import bpe
    from terralex.llm.queries import tokenizer

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    seen = [{r.doc_id: r for r in df.collect()} for df in applied(spark, docs, sf, tmp_path)]
    assert set(seen[1]) == {i for i, r in seen[0].items() if r.text and any(c.isalpha() for c in r.text)}
    want = groups([(i, r.text) for i, r in seen[1].items()])
    assert set(seen[2]) == {i for i, c in want.items() if i == c}
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    assert set(seen[3]) == {i for i, r in seen[2].items() if not hits(r.text, items)[4]}
    for i, r in seen[3].items():
        text = r.text
        for kind, a, b in sorted(spans(text), key=lambda s: -s[1]):
            text = text[:a] + f"[{kind.upper()}]" + text[b:]
        assert seen[4][i].text == text and seen[4][i].n_chars == len(text)
    path, pattern = tokenizer()
    library = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=bpe.read_ranks(path), special_tokens={})
    for i, r in seen[4].items():
        assert seen[5][i].ids == library.encode_ordinary(r.text) and seen[5][i].decoded_sha256 == hashlib.sha256(r.text.encode()).hexdigest()
    ran = pipeline.run(spark, sf)
    assert sorted((r.doc_id, r.ids_sha256) for r in ran.collect()) == sorted((i, r.ids_sha256) for i, r in seen[5].items())


def test_odd_rows_and_clashing_columns(spark, odd_docs, sf, tmp_path):
    docs = odd_docs.selectExpr("*", "1 AS lang_pred", "'x' AS contaminated", "2 AS spans_email", "3 AS n_tokens", "4 AS component_id", "5 AS ids")
    seen = applied(spark, docs, sf, tmp_path)
    assert all(df.columns == docs.columns for df in seen[1:-1]) and seen[-1].count() > 0 and {"n_tokens", "ids"} <= set(seen[-1].columns)


def test_empty_table(spark, no_docs, sf, tmp_path):
    assert applied(spark, no_docs, sf, tmp_path)[-1].count() == 0
