import hashlib
import random

import numpy as np
import pytest

from verdin.llm import suffix_dedup as X


def brute(texts, length):
    seen = {}
    data = [(t or "").encode() for t in texts]
    for b in data:
        for i in range(len(b) - length + 1):
            seen[b[i:i + length]] = seen.get(b[i:i + length], 0) + 1
    out = []
    for b in data:
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if seen[b[i:i + length]] > 1:
                gone[i:i + length] = b"\1" * length
        kept = bytes(c for c, g in zip(b, gone, strict=True) if not g)
        spans = sum(1 for i, g in enumerate(gone) if g and (not i or not gone[i - 1]))
        out.append((len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def corpus(rnd):
    def words(n):
        return " ".join(rnd.choice(["the", "ouié", "erst", "tion", "re", "in", "onble"]) + str(rnd.randrange(50)) for _ in range(n))
    passage, line = words(60), words(25)
    texts = [words(rnd.randint(1, 250)) for _ in range(25)]
    texts += [words(rnd.randint(0, 60)) + passage + words(rnd.randint(0, 60)) for _ in range(9)]
    texts += [words(40) + line + words(40) for _ in range(9)]
    near = words(300)
    for _ in range(8):
        k = rnd.randrange(len(near))
        texts.append(near[:k] + "#" + near[k + 1:])
    texts += [near, near, "ab" * 900, "x" * 900, "", None, "short", words(80) * 3, "é" * 350, texts[0]]
    return texts


def test_difference_cover():
    d = X.difference_cover()
    assert {(a - b) % X.COVER for a in d for b in d} == set(range(X.COVER))


@pytest.mark.parametrize("hot", [2000, 2])
def test_equals_brute_force(spark, hot):
    rnd = random.Random(hot)
    texts = corpus(rnd)
    ids = [i if i not in (3, 30) else None for i in range(len(texts))]
    df = spark.createDataFrame(list(zip(ids, texts, ["s"] * len(texts), strict=True)) + [(60, texts[40], "again"), (60, texts[40], "again")],
                               "doc_id long, text string, spans string")
    want = brute([*texts, texts[40], texts[40]], 200)
    got = X.remove_repeats(df, 200, with_kept=True) if hot == 2000 else None
    if got is None:   # through the cut of hot buckets
        base = df.selectExpr("doc_id", "coalesce(text, '') AS text")
        gone = {(r.doc_id, r.h): X.merged([s.asDict() for s in r.spans]) for r in X.removals(base, 200, hot=2, block_starts=500).collect()}
        rows = base.selectExpr("doc_id", "xxhash64(text) AS h", "octet_length(text) AS n").collect()
        assert sorted((r.n, sum(b - a for a, b in gone.get((r.doc_id, r.h), [])), len(gone.get((r.doc_id, r.h), []))) for r in rows) == sorted(w[:3] for w in want)
        return
    rows = got.collect()
    assert sorted((r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in rows) == sorted(want)
    assert all(hashlib.sha256(bytes(r.kept)).hexdigest() == r.kept_sha256 and len(r.removed) == r.n_spans for r in rows)
    assert sorted(r.doc_id or 0 for r in rows) == sorted([i or 0 for i in ids] + [60, 60])


def test_no_sort_holds_a_group_of_many_contexts(spark, monkeypatch):
    rnd, solve = random.Random(5), X.repeated_starts

    def words(n):
        return " ".join(str(rnd.randrange(10**6)) for _ in range(n))

    def bounded(bucket, *rest):
        assert np.bincount(bucket).max() <= 6, "more contents of a group in one task than hot"
        return solve(bucket, *rest)

    monkeypatch.setattr(X, "repeated_starts", bounded)
    long, short = words(40), words(28)   # over and under the length
    assert len(long) > 200 > len(short) > 186
    texts = [words(30) + p + words(30) for p in [long, short] for _ in range(40)]
    texts += [words(30) + "#" + short + "!" + words(30) for _ in range(3)] + [texts[0], texts[50], words(99)]
    df = spark.createDataFrame([*enumerate(texts), (1, texts[1])], "doc_id long, text string")
    gone = {(r.doc_id, r.h): X.merged(r.spans) for r in X.removals(df, 200, hot=6, block_starts=500).collect()}
    rows = df.selectExpr("doc_id", "xxhash64(text) AS h", "octet_length(text) AS n").collect()
    got = [(r.n, sum(b - a for a, b in gone.get((r.doc_id, r.h), [])), len(gone.get((r.doc_id, r.h), []))) for r in rows]
    assert got == [w[:3] for w in brute([*texts, texts[1]], 200)]


def test_long_text_in_segments(monkeypatch):
    rnd = np.random.default_rng(1)
    data = rnd.integers(97, 101, 5000, np.uint8)
    a, n, shift, gram, content = X.text_runs(data, 150)
    assert a[0] == 0 and (a[1:] == a[:-1] + n[:-1]).all() and a[-1] + n[-1] == 5000 - 150 + 1
    monkeypatch.setattr(X, "SEGMENT", 777)
    b = X.text_runs(data, 150)
    grams = {int(s): int(g) for x, k, g in zip(a, n, gram, strict=True) for s in range(x, x + k)}
    assert all(grams[s] == int(g) for x, k, g in zip(b[0], b[1], b[3], strict=True) for s in range(x, x + k))


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert X.remove_repeats(df).collect() == []


def test_thousands_of_equal_rows_are_fetched_once(spark, monkeypatch):
    """Equal rows whose text shares grams with others: one copy of their bytes goes into the sort."""
    rnd = random.Random(9)
    words = lambda n: " ".join(rnd.choice(["alpha", "beta", "gamma", "delta"]) + str(rnd.randrange(90)) for _ in range(n))
    shared = words(40)
    texts = [words(20) + shared + words(20) for _ in range(4)]
    rows = [(1, texts[0])] * 3000 + [(i + 2, t) for i, t in enumerate(texts[1:])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    tables, real = {}, X.stored
    monkeypatch.setattr(X, "stored", lambda frame, name: tables.setdefault(name, real(frame, name)))
    got = X.remove_repeats(df, 200).collect()
    want = brute([t for _, t in rows[:2]] + texts[1:], 200)      # two copies repeat all that three thousand do
    by = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got}
    assert len(got) == 3003 and by == {1: want[0], **{i + 2: w for i, w in enumerate(want[2:])}}
    assert tables["pieces"].groupBy("gram", "cell", "content", "n", "shift", "at").count().where("count > 1").count() == 0 and tables["pieces"].count() < 60
