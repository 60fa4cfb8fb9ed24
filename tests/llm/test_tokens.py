import base64
import hashlib
import random
import zlib

import numpy as np
import public_tokenizers as P
import pytest
import regex
import tiktoken
from tokenizers import Tokenizer

from verdin.llm import bpe_duck, token_store
from verdin.llm.pretoken import split_texts

RANKS = P.path("byte_bpe_50k.tiktoken")
JSON = P.path("byte_bpe_50k.json")
TEXTS = ["", None, "it's  \n\n x", "é" * 50, "a" * 3000, "🎉 ok ñandú's", "we'll 're 'S ''s", " \t ", "<|endoftext|> x",
         "same text", "same text", "x" * 40 + " " + "token " * 500, "ab" * 700 + " z"]


def test_split_equals_the_pattern():
    pat, rnd = regex.compile(P.PATTERN), random.Random(5)
    letters = "  \n\t'' stmdrevla1²½ß,.!é日　\x1c\x85​🎉S"
    for _ in range(3000):
        texts = ["".join(rnd.choice(letters) for _ in range(rnd.randint(0, 14))) for _ in range(3)]
        tokens, counts = split_texts(texts)
        assert [t.decode() for t in tokens.to_pylist()] == [w for t in texts for w in pat.findall(t)]
        assert list(counts) == [len(pat.findall(t)) for t in texts]


def test_every_token_contracts_back_to_itself():
    bpe = bpe_duck.DuckBpe(RANKS)
    words = list(bpe.ranks)
    for a in range(0, len(words), 20000):
        part = words[a:a + 20000]
        for w, ids in zip(part, bpe._contract(part), strict=True):
            assert ids.tolist() == [bpe.ranks[w]]


def test_bpe_equals_tiktoken_and_round_trips(spark):
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    df = spark.createDataFrame([(i if i != 3 else None, t, 7) for i, t in enumerate(TEXTS)], "doc_id long, text string, n_tokens int")
    got = bpe_duck.encode_decode(df, RANKS, with_ids=True).collect()
    assert len(got) == len(TEXTS)
    want = sorted((i if i != 3 else -1, tuple(enc.encode_ordinary(t or "")), (t or "").encode()) for i, t in enumerate(TEXTS))
    assert sorted((r.doc_id if r.doc_id is not None else -1, tuple(r.ids), bytes(r.decoded)) for r in got) == want
    for r in got:
        assert r.ids_sha256 == hashlib.sha256(np.array(r.ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(bytes(r.decoded)).hexdigest() and r.n_tokens == len(r.ids)
    assert bpe_duck.encode_decode(df.limit(0), RANKS).collect() == []


@pytest.mark.parametrize("values", [[], [0], [5, 5, 5], [0, 0, 9], list(range(0, 90000, 7)), [1, 10**9]])
def test_elias_fano(values):
    code = token_store.EliasFano.of(np.array(values, np.int64))
    back, end = token_store.EliasFano.from_bytes(code.to_bytes())
    assert end == len(code.to_bytes())
    assert [back.select(k) for k in range(len(values))] == values
    if len(values) > 1000:
        assert len(code.to_bytes()) < len(values) * 2


def test_store_round_trip(spark, tmp_path):
    tok = Tokenizer.from_file(JSON)
    keys = [i if i not in (2, 5) else None for i in range(len(TEXTS))]
    keys[9] = keys[10] = 9
    df = spark.createDataFrame(list(zip(keys, TEXTS, range(len(TEXTS)), strict=True)), "doc_id long, text string, start int")
    path = f"{tmp_path}/store"
    token_store.write_store(df, JSON, 2, path, ids_a_segment=1000, partitions=3)
    got = sorted(token_store.read_store(spark, path, with_ids=True).collect(), key=lambda r: r.start)
    assert [r.doc_id if r.doc_id is not None else -1 for r in got] == sorted(k if k is not None else -1 for k in keys)
    at = 0
    for r in got:
        assert r.start == at and r.n_tokens == len(r.ids) and r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
        at += r.n_tokens
    want = sorted((k if k is not None else -1, tuple(tok.encode(t or "", add_special_tokens=False).ids + [2]))
                  for k, t in zip(keys, TEXTS, strict=True))
    assert sorted((r.doc_id if r.doc_id is not None else -1, tuple(r.ids)) for r in got) == want


def test_keys_are_coded_like_boundaries():
    ids = [np.arange(i % 3 + 1, dtype=np.uint32) for i in range(9000)]
    for keys in ([None] * 9000, list(range(9000)), [None, None, *range(-5, 8993)], [7] * 9000, [None] + [-2**63 + i * 10**14 for i in range(8999)]):
        data = token_store.seal(keys, ids, 11, False)
        seg = token_store.Segment(data)
        assert [seg.key(k) for k in range(seg.n)] == keys and seg.first == 11
        assert all(seg.document(k).tolist() == ids[k].tolist() for k in (0, 1, 255, 256, 4095, 4096, 8999))
    # a boundary and a dense key together take a few bits a document, not 128
    assert len(token_store.seal(list(range(9000)), ids, 0, False)) - 2 * sum(map(len, ids)) < 9000


def test_keys_far_apart_are_cut_into_segments(spark, tmp_path):
    keys = [None, -2**63, -2**63 + 1, -5, 0, 2**62, 2**63 - 1, 2**63 - 1]
    df = spark.createDataFrame([(k, f"text {i}") for i, k in enumerate(keys)], "doc_id long, text string")
    token_store.write_store(df, JSON, 2, f"{tmp_path}/far", partitions=1)
    got = sorted(token_store.read_store(spark, f"{tmp_path}/far").collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == keys
    assert spark.read.parquet(f"{tmp_path}/far").count() > 1


def test_empty_store(spark, tmp_path):
    df = spark.createDataFrame([], "doc_id long, text string")
    token_store.write_store(df, JSON, 2, f"{tmp_path}/none")
    assert token_store.read_store(spark, f"{tmp_path}/none").collect() == []
