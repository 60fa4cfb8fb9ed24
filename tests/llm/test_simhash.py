import random

import numpy as np
import xxhash

from verdin.llm import simhash_bk as S


def brute_fp(text, width=3):
    words = (text or "").encode().lower().split()
    sh = [b" ".join(words[i:i + width]) for i in range(len(words) - width + 1)] or ([b" ".join(words)] if words else [])
    hs = [xxhash.xxh64_intdigest(s, seed=42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute_labels(fps, radius=3):
    label = list(range(len(fps)))

    def find(x):
        while label[x] != x:
            x = label[x]
        return x
    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= radius:
                a, b = find(i), find(j)
                label[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(fps))]


def cluster(rnd, n, flips):
    base = rnd.getrandbits(64)
    out = set()
    while len(out) < n:
        x = base
        for _ in range(rnd.randint(0, flips)):
            x ^= 1 << rnd.randrange(64)
        out.add(x)
    return list(out)


def partition(labels, items):
    groups = {}
    for x, y in zip(labels, items, strict=True):
        groups.setdefault(x, set()).add(y)
    return sorted(map(sorted, groups.values()))


def test_fingerprints():
    for t in ["", None, "a", "A b", "a b c", "A  b\tc d " * 40, "é ñ   x y"]:
        assert S.fingerprint(t) == brute_fp(t)


def test_tree_search_and_recursive_cut_equal_brute_force():
    rnd = random.Random(3)
    fps = list(dict.fromkeys(cluster(rnd, 120, 9) + cluster(rnd, 60, 5) + [rnd.getrandbits(64) for _ in range(200)]))
    a = np.array(fps, np.uint64)
    want = partition(brute_labels(fps), range(len(fps)))
    assert partition(S.shard_components(np.zeros(len(a), np.int64), a, 3, frontier=500), range(len(a))) == want
    assert partition(S.linked(a, list(range(64)), 3, 16), range(len(a))) == want


def test_links_and_components_in_spark(spark):
    rnd = random.Random(7)
    fps = list(dict.fromkeys(cluster(rnd, 300, 8) + [x for _ in range(30) for x in cluster(rnd, 3, 3)] + [0, 1, 7, 15]))
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    rows = spark.createDataFrame([(i if i % 11 else None, f) for i, f in enumerate(signed)] + [(1000, signed[5])], "doc_id long, fp long")
    for most in (4, 512):
        links = S.links(rows.select("fp").distinct(), 3, most)
        root = {r.node: r.root for r in S.components(links).collect()}
        assert partition([root.get(f, f) for f in signed], fps) == partition(brute_labels(fps), fps)
    label = brute_labels(fps)
    got = {(r.doc_id, r.fp): r.component_id for r in S.grouped(rows).collect()}
    for i, f in enumerate(signed):
        ids = [j for j in range(len(fps)) if label[j] == label[i] and j % 11] + ([1000] if label[5] == label[i] else [])
        assert got[(i if i % 11 else None, f)] == min(ids, default=None)


def test_near_duplicates_on_odd_rows(spark):
    text = " ".join(f"w{i}" for i in range(300))
    rows = [(1, text, "x"), (2, text, None), (2, text, None), (5, text + " end", "y"), (None, "alone here now", "z"), (4, None, "n"), (3, "", "e"),
            (9, "other words " * 200, "q")]
    df = spark.createDataFrame(rows, "doc_id long, text string, group string")
    got = sorted(((r.doc_id or 0, r.component_id) for r in S.near_duplicates(df).collect()), key=str)
    want = {1: 1, 2: 1, 5: 1, 0: None, 4: 3, 3: 3, 9: 9}
    assert len(got) == len(rows) and all(want[a] == b for a, b in got)
    kept = S.keep_one(df).collect()
    assert sorted(r.doc_id or 0 for r in kept) == [0, 1, 3, 9] and kept[0].asDict().keys() == {"doc_id", "text", "group"}
    assert S.near_duplicates(df.limit(0)).collect() == [] and S.keep_one(df.limit(0)).collect() == []
