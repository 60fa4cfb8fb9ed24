import base64

import public_tokenizers as P
import tiktoken

import corpus_pipeline
from tests.conftest import SF0001
from tests.llm.test_rules_and_secrets import brute_spans
from tests.llm.test_simhash import brute_fp, brute_labels
from verdin.llm import decontaminate, queries, trigram_secrets


def test_stages_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF0001}/documents.parquet")
    rows = {r.doc_id: r.asDict() for r in docs.collect()}
    named = corpus_pipeline.language(spark, docs, SF0001)
    assert named.columns == docs.columns
    left = {r.doc_id for r in named.collect()}
    assert left == {i for i, r in rows.items() if any(c.isalpha() for c in r["text"])}
    ids = sorted(left)
    label = brute_labels([brute_fp(rows[i]["text"]) for i in ids])
    once = {ids[k] for k in set(label)}
    single = corpus_pipeline.near_duplicates(spark, named, SF0001)
    assert single.columns == docs.columns and {r.doc_id for r in single.collect()} == once
    items = [decontaminate.plain(r.text) for r in spark.read.parquet(f"{SF0001}/benchmark.parquet").collect()]
    clean = corpus_pipeline.decontamination(spark, single, SF0001)
    kept = {r.doc_id for r in clean.collect()}
    exact = {i for i in once if any(f" {x} " in f" {decontaminate.plain(rows[i]['text'])} " for x in items)}
    assert clean.columns == docs.columns and kept <= once - exact and len(once - exact - kept) < 5
    hidden = corpus_pipeline.secrets(spark, clean, SF0001)
    texts = {r.doc_id: r.text for r in hidden.collect()}
    assert hidden.columns == docs.columns and texts.keys() == kept
    rules = trigram_secrets.BASE + trigram_secrets.MORE
    assert all(("[SECRET]" in t) == bool(brute_spans(rows[i]["text"], rules)) for i, t in texts.items())
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = {r.doc_id: r.n_tokens for r in corpus_pipeline.run(spark, SF0001).collect()}
    assert got == {i: len(enc.encode_ordinary(t)) for i, t in texts.items()}


def test_pipeline_on_odd_rows_and_empty_tables(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long, h string, spans int"
    rows = [(1, "the and of " * 40, "en", None, 1, "a", 1), (1, "the and of " * 40, "en", None, 1, "a", 1), (None, None, None, None, None, None, None),
            (2, "", "en", "s", 0, "b", 2), (3, "der die das und " * 30 + " token = 'abcdef99'", "de", "s", 3, "c", 3)]
    spark.createDataFrame([(1, "some other item text")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for name, some in (("documents", rows), ("none", [])):
        docs = spark.createDataFrame(some, schema)
        for _, stage in corpus_pipeline.STAGES[:-1]:
            docs = stage(spark, docs, str(tmp_path))
            assert docs.columns == [c.split()[0] for c in schema.split(", ")]
        out = corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).collect()
        assert sorted(r.doc_id for r in out) == ([1, 3] if some else [])


def test_every_operator_has_a_query():
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 14))
    assert trigram_secrets.BASE[0].kind == "assign" and [n for n, _ in corpus_pipeline.STAGES][-1] == "tokens"
