import bisect
import collections
import hashlib
import itertools
import random

import numpy as np
import public_tokenizers as P
import pytest

from tests.conftest import SF0001
from verdin.llm import align, queries

FIRST, SECOND = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")


def tokens(text):
    """([(id, bytes)], [(id, bytes)]) by the libraries alone, or two empty lists."""
    import sentencepiece
    from tokenizers import Tokenizer
    if "a" not in tokens.__dict__:
        tokens.a = Tokenizer.from_file(FIRST)
        tokens.a.encode_special_tokens = True
        tokens.b = sentencepiece.SentencePieceProcessor(model_file=SECOND)
        own = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in own]
        tokens.byte = {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(rest)}
    if not text:
        return [], []
    a = [(i, bytes(tokens.byte[c] for c in tokens.a.id_to_token(i))) for i in tokens.a.encode(" " + text, add_special_tokens=False).ids]
    b = []
    for i in tokens.b.encode(text):
        piece = tokens.b.id_to_piece(i)
        b.append((i, bytes([int(piece[3:5], 16)]) if tokens.b.is_byte(i) else piece.replace("▁", " ").encode()))
    want = (" " + text).encode()
    return (a, b) if b"".join(x for _, x in a) == want == b"".join(x for _, x in b) else ([], [])


def brute(texts):
    """Rows of the contract without doc_id."""
    split = []
    for t in texts:
        a, b = tokens(t)
        ends_a, ends_b = np.cumsum([len(x) for _, x in a]), np.cumsum([len(x) for _, x in b])
        common = sorted(set(ends_a.tolist()) & set(ends_b.tolist()))
        parts = []
        for ends, ids in ((ends_a, [i for i, _ in a]), (ends_b, [i for i, _ in b])):
            cuts = [0, *(bisect.bisect_right(ends, e) for e in common)]
            parts.append([ids[x:y] for x, y in itertools.pairwise(cuts)])
        split.append(list(zip(*parts, strict=True)))
    count = collections.Counter(p for groups in split for p in {(x, y) for a, b in groups for x in a for y in b})
    best = collections.defaultdict(int)
    for (x, _), n in count.items():
        best[x] = max(best[x], n)
    out = []
    for groups in split:
        links = [(x, y) for a, b in groups for x in a for y in b]
        written = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in groups)
        out.append((sum(len(a) for a, _ in groups), sum(len(b) for _, b in groups), len(groups), len(links),
                    sum(count[p] == best[p[0]] for p in links), sum(count[p] for p in links),
                    hashlib.sha256(written.encode()).hexdigest() if groups else ""))
    return out


FIELDS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def rows(df):
    return sorted(((r.doc_id or 0, *(r[f] for f in FIELDS)) for r in df.collect()))


def test_query_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF0001}/documents.parquet").select("doc_id", "text").collect()
    want = brute([r.text for r in docs])
    got = rows(queries.QUERIES["op13_token_alignment"](spark, SF0001))
    assert got == sorted((r.doc_id, *w) for r, w in zip(docs, want, strict=True)) and sum(g[4] for g in got) > 1000


def odd_texts():
    rnd = random.Random(2)
    alphabet = ["a", "the", " ", "  ", "\n", "\t", "é", "ß", "日本", "😀", "👩‍👩‍👧", "123456", "'s", "</s>", "<s>", "<0x0A>", "<|endoftext|>", "\x00", "=", "a" * 37, "İ", " ", "　", "́"]
    return [None, "", " ", "   ", "\n", "a", "a ", " a", "with ▁ mark", "▁", "a" * 5000, "= " * 400, "<|endoftext|>", "<s> x </s>", "<unk>", "<0x41>", "word", "word",
            *("".join(rnd.choice(alphabet) for _ in range(rnd.randrange(40))) for _ in range(150))]


def test_odd_texts_in_blocks_of_any_size(spark):
    texts = odd_texts()
    df = spark.createDataFrame([(i if i else None, t, "x", 1) for i, t in enumerate(texts)], "doc_id long, text string, pair string, block int").repartition(3)
    want = sorted((i, *w) for i, w in enumerate(brute(texts)))
    for block_chars, run_chars in ((300, 50), (16_000_000, 500_000)):
        assert rows(align.align(df, FIRST, SECOND, block_chars=block_chars, run_chars=run_chars)) == want
    assert align.align(df.limit(0), FIRST, SECOND).collect() == []


def test_thousands_of_equal_rows(spark):
    df = spark.range(6000).selectExpr("7 AS doc_id", "'the same text, again' AS text")
    got = align.align(df, FIRST, SECOND, block_chars=20_000).collect()
    assert len(got) == 6000 and len(set(got)) == 1 and got[0].count_sum == 6000 * got[0].n_links == 6000 * got[0].n_best


@pytest.mark.parametrize("seed", range(5))
def test_pointers_against_common_ends(seed):
    rng = np.random.default_rng(seed)
    total = 4000
    a = np.unique(np.append(rng.integers(1, total, 1500), total))
    b = np.unique(np.append(rng.integers(1, total, 5 if seed == 4 else 900), total))
    common = np.intersect1d(a, b)
    ga, gb = align.groups(a, b)
    assert np.array_equal(ga, np.searchsorted(common, a)) and np.array_equal(gb, np.searchsorted(common, b))


def test_pairs_in_slices_are_the_same():
    rng = np.random.default_rng(0)
    ga, gb = np.sort(rng.integers(0, 50, 2000)), np.sort(np.concatenate([np.arange(50), rng.integers(0, 50, 1500)]))
    ia, ib, doc = rng.integers(0, 40, 2000), rng.integers(0, 30, len(gb)), np.sort(rng.integers(0, 8, 50))
    want = collections.Counter((doc[g], x, y) for g in range(50) for x in ia[ga == g] for y in ib[gb == g])
    for most in (10, 3000, 10 ** 7):
        d, key, n = align.pairs_of(doc, ga, ia, gb, ib, 40, 30, most)
        assert {(i, k // 30, k % 30): v for i, k, v in zip(d, key, n, strict=True)} == want
