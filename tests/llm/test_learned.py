import math
import random
import zlib

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tests.conftest import SF001
from verdin.llm import langid, lattice_lm, quality_qda, queries
from verdin.llm.common import documents, remainder

PIECES = P.path("piece_bpe_32k.model")


def test_gru_gradients_through_time():
    model = langid.BiGru(["a", "b", "c"], 3)
    rng = np.random.default_rng(0)
    x, y = rng.integers(0, 256, (6, 4)), np.array([0, 2, 1, 0])
    _, grad = model.gradients(x, y)
    for part, weights in model.parameters().items():
        for name, w in weights.items():
            for _ in range(4):
                at = tuple(rng.integers(0, s) for s in w.shape) if name != "wx" else (x[rng.integers(6), rng.integers(4)], rng.integers(9))
                w[at] += 1e-5
                up, _ = model.gradients(x, y)
                w[at] -= 2e-5
                down, _ = model.gradients(x, y)
                w[at] += 1e-5
                assert abs((up - down) / 2e-5 - grad[part][name][at]) < 1e-6


def test_batched_inference_equals_one_by_one():
    model = langid.BiGru(["a", "b"], 4)
    net, rng = model.frozen(), random.Random(2)
    texts = [bytes(rng.randrange(256) for _ in range(n)) for n in (1, 5, 255, 256, 257, 700, 0)]
    got = net.documents(texts, windows_at_once=3)
    for t, p in zip(texts, got, strict=True):
        want = np.zeros(2)
        for a in range(0, len(t), langid.WINDOW):
            steps = np.frombuffer(t[a:a + langid.WINDOW], np.uint8)[:, None]
            f, b = model.ahead.forward(steps)[0], model.back.forward(steps[::-1])[0][::-1]
            z = np.concatenate([f, b], axis=2) @ model.head["w"] + model.head["c"]
            e = np.exp(z)
            want += (e / e.sum(axis=2, keepdims=True)).sum(axis=(0, 1))
        assert np.allclose(p, want / max(1, len(t)), atol=1e-4)


def test_language_accuracy_on_held_out_rows(spark):
    got = queries.QUERIES["op2_language_id"](spark, SF001).join(documents(spark, SF001).select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in got if r.held_out and r.lang_pred != "und"]
    assert len(got) == 1000 and np.mean([r.lang_pred == r.lang for r in held]) > 0.98
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in got)


def test_language_of_odd_rows(spark):
    rows = [(1, "the and of thing " * 30, "en", "x"), (2, "der die und sch " * 30, "de", "y"), (None, None, None, None), (4, "", "en", "z"),
            (5, "1234 !!", "de", "z"), (6, "the thing", None, "z"), (6, "the thing", None, "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, score string")
    model = langid.fit(df, F.lit(True))
    got = sorted(((r[0] or 0), r["lang_pred"]) for r in langid.predict(df, model).collect())
    assert got == [(0, "und"), (1, "en"), (2, "de"), (4, "und"), (5, "und"), (6, "en"), (6, "en")]
    kept = langid.keep_identified(df, model).collect()
    assert sorted(r.doc_id for r in kept) == [1, 2, 6, 6] and kept[0].asDict().keys() == {"doc_id", "text", "lang", "score"}
    none = df.limit(0)
    assert langid.fit(none, F.lit(True)) is None
    assert [r.lang_pred for r in langid.predict(df.limit(1), None).collect()] == ["und"] and langid.predict(none, model).collect() == []


def test_quality_on_held_out_labels(spark):
    got = queries.QUERIES["op3_quality_classifier"](spark, SF001)
    rows = got.join(spark.read.parquet(f"{SF001}/labels.parquet"), "doc_id").where("held_out").collect()
    assert got.count() == 1000 and rows
    assert np.mean([r.predicted == r.quality for r in rows]) > 0.9
    assert all(r.predicted == (r.score >= 0.3) and 0 <= r.score <= 1 for r in got.collect())


def test_quality_of_odd_rows(spark):
    df = spark.createDataFrame([(None, None), (1, ""), (2, "a b c"), (2, "a b c"), (3, "x " * 50000)], "doc_id long, text string")
    labels = spark.createDataFrame([(2, 1, 0), (None, 0, 0), (7, None, 1)], "doc_id long, quality int, toxic int")
    got = quality_qda.classify(df, labels, F.lit(True)).collect()
    assert len(got) == 5 and {r.score for r in got} == {1.0}   # one class alone: its share
    assert quality_qda.classify(df.limit(0), labels, F.lit(True)).collect() == []
    assert {r.score for r in quality_qda.classify(df, labels.limit(0), F.lit(True)).collect()} == {0.5}


def test_qda_equals_log_densities():
    rng = np.random.default_rng(3)
    x = [rng.normal(0, 1, (400, 3)) @ rng.normal(0, 1, (3, 3)), rng.normal(1, 2, (300, 3))]
    q = quality_qda.Qda([400, 300], np.array([a.sum(0) for a in x]), np.array([a.T @ a for a in x]), pooled=0.0, round_=0.0)
    points = rng.normal(0, 1, (50, 3))
    log = []
    for k in (0, 1):
        s = np.cov(x[k].T, bias=True)
        w = 3 / (3 + len(x[k]))
        both = (400 * np.cov(x[0].T, bias=True) + 300 * np.cov(x[1].T, bias=True)) / 700
        s = (1 - w) * s + w * both
        d = points - x[k].mean(0)
        log.append(-0.5 * np.einsum("ij,jk,ik->i", d, np.linalg.inv(s), d) - 0.5 * np.linalg.slogdet(s)[1])
    want = 1 / (1 + np.exp(-(log[1] - log[0] + math.log(300 / 400))))
    assert np.allclose(q.scores(points), want, atol=1e-3)


def segmentations(lattice, s):
    if not s:
        yield 0.0
        return
    for k in range(1, len(s) + 1):
        lp = lattice.pieces.get(s[:k])
        if lp is not None:
            for rest in segmentations(lattice, s[k:]):
                yield lp + rest
    if s[0] not in lattice.pieces:
        for rest in segmentations(lattice, s[1:]):
            yield sum(lattice.spelled[b] for b in s[0].encode()) + rest


def test_lattice_sums_all_segmentations():
    lattice = lattice_lm.from_vocabulary(PIECES)
    for w in ("the", "there", "öß", "naïve", "\U0001f389x", "a"):
        each = list(segmentations(lattice, lattice_lm.START + w))
        assert math.isclose(lattice.word(w), math.log(sum(map(math.exp, each))), rel_tol=1e-9)
        into: dict = {}
        lattice.expected(w, 3.0, into)
        # expected characters spelled are those of the word, three times
        n = sum(v * len(k) for k, v in into.items() if isinstance(k, str))
        n += sum(v * len(c) / len(c.encode()) for c in set(w) if c not in lattice.pieces for b in [None] for v in [3.0 * w.count(c) * len(c.encode())])
        assert math.isclose(n, 3 * len(lattice_lm.START + w), rel_tol=1e-6)
    total = sum(map(math.exp, lattice.pieces.values())) + sum(map(math.exp, lattice.spelled)) + math.exp(lattice.end)
    assert math.isclose(total, 1, rel_tol=1e-9) and math.isfinite(lattice.word("x" * 5000))


def test_many_words_at_once_equal_one_by_one(monkeypatch):
    rnd = random.Random(8)
    words = ["".join(rnd.choice("aethnors éß日🎉▁0") .strip() or "x" for _ in range(rnd.choice([1, 2, 5, 9, 17, 46, 47, 48, 49, 200]))) for _ in range(300)] + ["the", "the"]
    counts = np.array([rnd.randint(1, 9) for _ in words], float)
    lattice = lattice_lm.from_vocabulary(PIECES)
    want: dict = {}
    for w, c in zip(words, counts, strict=True):
        lattice.expected(w, c, want)
    for many in (7, 1000):
        monkeypatch.setattr(lattice_lm, "MANY", many)
        assert np.allclose(lattice.marginals(words), [lattice.word(w) for w in words], rtol=1e-12)
        got: dict = {}
        lattice.expected_all(words, counts, got)
        assert {k for k, v in want.items() if v > 1e-200} <= got.keys() and all(math.isclose(v, want.get(k, 0.0), rel_tol=1e-8, abs_tol=1e-12) for k, v in got.items())
    assert lattice.marginals([]).tolist() == []


def test_thousands_of_equal_rows_are_dealt(spark, monkeypatch):
    sizes = []
    df = spark.range(20_000).selectExpr("5 AS doc_id", "'the same words of the same row' AS text")
    got = lattice_lm.score(df, PIECES, F.lit(True), block_bytes=50_000).collect()
    assert len(got) == 20_000 and len(set(got)) == 1 and got[0].train_tokens == 20_000 * 8 and got[0].n_known == 8
    real = lattice_lm.Block.closed

    def closed(block):
        sizes.append(sum(map(len, block.ids)))
        return real(block)

    monkeypatch.setattr(lattice_lm.Block, "closed", closed)
    block = lattice_lm.Block()
    block.add(pa.RecordBatch.from_pydict({"doc_id": [1, None], "text": ["a b a", ""], "train": [True, False]}))
    words, n, rest = block.closed()
    ids, each, index = lattice_lm.Block.opened(rest)
    assert words.to_pylist() == ["a", "b"] and n.tolist() == [2, 1] and ids == [1, None] and each.tolist() == [3, 0] and index.tolist() == [0, 0, 1]
    assert sizes == [2]


def test_words_of_a_slice():
    texts = [f"Ähre {i} THE\tthe  \u00a0x" if i % 7 else None for i in range(900)]
    for a, n in ((0, 900), (300, 400), (899, 1)):
        words, index, per, times = lattice_lm._distinct(pa.array(texts).slice(a, n), np.ones(n))
        want = [w.decode() for t in texts[a:a + n] for w in (t or "").encode().lower().split()]
        assert [words[i].as_py() for i in index] == want and times.sum() == len(want)
        assert list(np.bincount(per, minlength=n)) == [len((t or "").encode().split()) for t in texts[a:a + n]]


@pytest.mark.parametrize("block_bytes", [200, 10**9])
def test_scores_equal_brute_force(spark, block_bytes):
    rnd = random.Random(4)
    texts = [" ".join(rnd.choice(["The", "the", "of", "ouié", "Ähre", "x" * 40, "é b"]) for _ in range(rnd.randint(0, 30))) for _ in range(30)]
    texts += ["", None, " \t\n", texts[0], " a "]
    ids = [i if i != 7 else None for i in range(len(texts))]
    df = spark.createDataFrame(list(zip(ids, texts, texts, strict=True)), "doc_id long, text string, train string")
    got = lattice_lm.score(df, PIECES, remainder("doc_id", 7) != 2, block_bytes=block_bytes, rounds=1).collect()

    def tokens(t):
        return (t or "").encode().lower().split()
    training = [zlib.crc32(("" if i is None else str(i)).encode()) % 7 != 2 for i in ids]
    counts: dict = {}
    for t, use in zip(texts, training, strict=True):
        for w in [*tokens(t), None] if use else []:
            counts[w] = counts.get(w, 0) + 1
    n, v = sum(counts.values()), len(counts)
    lattice = lattice_lm.from_vocabulary(PIECES)
    into: dict = {}
    for w, c in counts.items():
        if w is not None:
            lattice.expected(w.decode(), c, into)
    ends, strength = counts.get(None, 0), 1000.0
    total = sum(into.values()) + ends + strength
    new = lattice_lm.Lattice({p: math.log((into.get(p, 0) + strength * math.exp(lp)) / total) for p, lp in lattice.pieces.items()},
                             [math.log((into.get(b, 0) + strength * math.exp(lp)) / total) for b, lp in enumerate(lattice.spelled)],
                             math.log((ends + strength * math.exp(lattice.end)) / total))
    want = []
    for i, t in zip(ids, texts, strict=True):
        all_ = [*tokens(t), None]
        base = sum(math.log10((counts.get(w, 0) + 1) / (n + v + 1)) for w in all_)
        mine = sum(new.word(w.decode()) for w in all_[:-1]) + new.end
        want.append((i if i is not None else -1, len(all_), sum(counts.get(w, 0) > 0 for w in all_), n, round(base, 6), round(mine / math.log(10), 6)))
    assert sorted((r.doc_id if r.doc_id is not None else -1, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6), round(r.score, 6)) for r in got) == sorted(want)
    assert lattice_lm.score(df.limit(0), PIECES, F.lit(True)).collect() == []
