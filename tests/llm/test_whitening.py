import math
import random

import numpy as np
from pyspark.sql import functions as F

from tests.conftest import SF0001
from verdin.llm import queries, whitening
from verdin.llm.whitening import Spectrum, secular_roots


def test_secular_roots_interlace_and_solve():
    rng = np.random.default_rng(1)
    for k in (1, 2, 7, 40):
        d = np.sort(rng.normal(size=k)).cumsum() if k < 3 else np.cumsum(rng.exponential(size=k) * 10.0 ** rng.integers(-6, 3, k))
        d = np.sort(d)
        z, rho = rng.normal(size=k) * 10.0 ** rng.integers(-3, 2, k), 0.7
        roots = d - np.diagonal(secular_roots(d, z * z, rho))
        want = np.linalg.eigvalsh(np.diag(d) + rho * np.outer(z, z))
        assert np.allclose(roots, want, rtol=0, atol=1e-12 * np.abs(want).max()) and np.all(roots >= d)
        assert np.all(roots[:-1] <= d[1:])


def test_spectrum_of_points_copies_and_parts():
    rng = np.random.default_rng(0)
    for dim in (1, 3, 20):
        x = np.floor(1024 * rng.normal(size=(120, dim)) * np.linspace(0.05, 0.3, dim)) + 100_000
        x[10:30], x[:, -1] = x[3], x[0, -1]           # equal rows; a dimension without variance
        about = x - x.mean(axis=0)
        want = about.T @ about
        top = max(1.0, np.linalg.eigvalsh(want)[-1])
        one, weighted, a, b = (Spectrum(dim) for _ in range(4))
        for v in x:
            one.add(v)
        for v, n in zip(*np.unique(x, axis=0, return_counts=True), strict=True):
            weighted.add(v, int(n))
        for v in x[:40]:
            a.add(v)
        for v in x[40:]:
            b.add(v)
        a.combine(b)
        a.combine(Spectrum(dim))
        for s in (one, weighted, a):
            assert s.n == 120 and np.allclose(s.mean, x.mean(axis=0)) and np.all(np.diff(s.values) >= -1e-9 * top)
            assert np.allclose((s.vectors * s.values) @ s.vectors.T, want, rtol=0, atol=1e-11 * top)
            assert np.allclose(s.vectors.T @ s.vectors, np.eye(dim), atol=1e-11)


def brute(vectors: list, k: int = 8):
    x = np.array([[math.floor(1024 * float(np.float32(c))) + 100_000 for c in v] for v in vectors], object)
    n = len(x)
    total = [sum(col) for col in x.T]
    apart = np.array([[n * int(c) - s for c, s in zip(row, total, strict=True)] for row in x], object)
    about = (apart / n).astype(float)
    cov = about.T @ about / n
    e, q = np.linalg.eigh(cov)
    e, q = e[::-1][:k], q[:, ::-1][:, :k]
    return [sum(int(c) ** 2 for c in row) for row in apart], about @ q / np.sqrt(e), e / np.trace(cov)


def same(got, keys, vectors, k=8):
    deviation, white, explained = brute(vectors, k)
    by = {}
    for r in got:
        by.setdefault(r.vec_id, {})[r.component] = r
    assert len(got) == k * len(keys) and sorted(by) == sorted(keys)
    found = np.array([[by[i][c + 1].whitened for c in range(k)] for i in keys])
    sign = np.sign((found * white).sum(axis=0))
    assert np.allclose(found, white * sign, atol=1e-9)
    assert [by[i][1].deviation for i in keys] == deviation and {r.n for r in got} == {len(keys)}
    assert np.allclose([by[keys[0]][c + 1].explained for c in range(k)], explained, rtol=1e-9)
    assert len({r.identity_error for r in got}) == 1 and got[0].identity_error < 1e-9


def test_query_against_brute_force(spark):
    rows = spark.read.parquet(f"{SF0001}/embeddings.parquet").select("vec_id", "embedding").collect()
    same(queries.QUERIES["op11_whitening"](spark, SF0001).collect(), [r.vec_id for r in rows], [r.embedding for r in rows])


def test_many_partitions_and_odd_rows(spark):
    rnd = random.Random(3)
    good = [(i, [rnd.gauss(0, 0.1 * (j + 1)) for j in range(9)], "x") for i in range(400)] + [(400 + i, [0.25] * 9, "hot") for i in range(200)]
    bad = [(1000, None, "a"), (1001, [None] + [0.0] * 8, "b"), (1002, [math.nan] * 9, "c"), (1003, [math.inf] + [0.0] * 8, "d"), (1004, [], "e"),
           (1005, [0.5] * 4, "f"), (1006, [1e30] + [0.0] * 8, "g")]
    schema = "vec_id long, embedding array<float>, component string"
    df = spark.createDataFrame(good + bad, schema).repartition(40)
    same(whitening.whiten(df).collect(), [r[0] for r in good], [r[1] for r in good])
    assert whitening.whiten(df.limit(0)).collect() == [] and whitening.whiten(df.where("vec_id >= 1000 and vec_id <> 1005")).collect() == []
    equal = df.where("component = 'hot'")
    assert whitening.whiten(equal).collect() == [] and whitening.fit(equal).n == 200    # no variance, no component
    twice = spark.createDataFrame([(None, [0.0, 1.0], "x"), (None, [0.0, 3.0], "x"), (7, [0.0, 1.0], "y")], schema)
    got = whitening.whiten(twice).collect()
    assert sorted((r.vec_id or 0, r.component) for r in got) == [(0, 1), (0, 1), (7, 1)] and all(abs(r.explained - 1) < 1e-12 for r in got)


def test_exact_deviation_of_large_entries(spark):
    df = spark.createDataFrame([(1, [2.0 ** 20, 0.0]), (2, [0.0, 1.0]), (3, [-2.0 ** 29, 5.0])], "vec_id long, embedding array<double>")
    model = whitening.fit(df)
    x = [[2 ** 30 + 100_000, 100_000], [100_000, 101_024], [-2 ** 39 + 100_000, 105_120]]
    total = [sum(c) for c in zip(*x, strict=True)]
    exact = [sum((3 * v - t) ** 2 for v, t in zip(r, total, strict=True)) for r in x]
    got = {r.vec_id: r.deviation for r in whitening.transform(df, model).where(F.col("component") == 1).collect()}
    assert got == {i + 1: e if e < 2 ** 63 else None for i, e in enumerate(exact)} and None in got.values()
