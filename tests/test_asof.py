import random
from datetime import datetime, timedelta

from verdin.operators import asof


def test_postfactum_fixture(spark):
    base = datetime(2024, 1, 5, 0)
    pts = spark.createDataFrame([(1, base, 100.0), (2, base + timedelta(hours=1), 110.0),
                                 (3, base + timedelta(hours=2), 120.0)], "step int, ts timestamp_ntz, prediction double")
    act = spark.createDataFrame([(base, 105.0, 0), (base + timedelta(hours=1, minutes=10), 106.75, 1)],
                                "actual_ts timestamp_ntz, actual double, ord long")
    m = asof.postfactum_errors(asof.nearest_match(pts, act, [], 1800, ["step"], actual_order=["ord"]))
    rows = {r["step"]: r for r in m.collect()}
    assert rows[1]["abs_error"] == 5.0 and rows[2]["abs_error"] == -3.25
    assert rows[3]["actual"] is None and rows[3]["abs_error"] is None and rows[3]["ape"] is None
    assert rows[1]["ape"] == round(5 / 105 * 100, 4)
    s = asof.comparison_summary(m).first()
    assert s["matched"] == 2 and s["points"] == 3


def test_nearest_match_against_brute_force(spark):
    rng = random.Random(3)
    base = datetime(2024, 1, 1)
    pts = [(i, "a" if i % 2 else "b", base + timedelta(seconds=rng.randint(0, 40_000)), 0.0) for i in range(60)]
    act = [("a" if rng.random() < 0.5 else "b", base + timedelta(seconds=rng.randint(0, 40_000)), float(j), j)
           for j in range(300)]
    p = spark.createDataFrame(pts, "pid int, k string, ts timestamp_ntz, prediction double")
    a = spark.createDataFrame(act, "k string, actual_ts timestamp_ntz, actual double, ord long")
    got = {r["pid"]: r["actual"] for r in asof.nearest_match(p, a, ["k"], 300, ["pid"], actual_order=["ord"]).collect()}
    for pid, k, ts, _ in pts:
        cands = [(abs((t - ts).total_seconds()), o, v) for kk, t, v, o in act if kk == k and abs((t - ts).total_seconds()) <= 300]
        exp = min(cands)[2] if cands else None
        assert got[pid] == exp
