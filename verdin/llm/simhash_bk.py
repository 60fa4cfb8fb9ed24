"""SimHash near-duplicates through BK-trees.

Fingerprints: a text in lower case (A-Z) is cut into words, words into shingles, and a bit of the
64-bit fingerprint is set where over half the shingle hashes (XXH64, seed 42) have it.

Search: two fingerprints within r bits agree on one of r + 1 slices of the bits (pigeonhole), so each
slice value is a shard of distinct fingerprints, and each shard gets a BK-tree whose children are
keyed by their Hamming distance to the parent; a query follows only edges whose key is within r of
its own distance.  A shard's tree is sent to its queries by the shuffle on the shard key: to
broadcast the trees of all shards from the driver would gather the fingerprints of all documents
there.  A shard of over ``most`` fingerprints is cut again by slices of its other bits, which
is exact by the same argument.  Inside a shard only a spanning forest of the links is kept, every
node linked to one earlier of its component, so a group of near copies makes as many links as it has
members.  Components of the links come from alternating star contractions in Spark.

Null text: the empty text.  Texts without words have fingerprint zero and link like any other.  Null
ids never become a component id unless the whole component has none; repeated rows stay.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verdin.llm.common import fresh, ship_package, stored


def fingerprint(text: str | None, width: int = 3) -> int:
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    if len(words) < width:
        shingles = [b" ".join(words)]
    else:
        shingles = list(map(b" ".join, zip(*[words[i:] for i in range(width)], strict=False)))
    digest, ones = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for a in range(0, len(shingles), 100_000):   # bounds the memory of a very long text
        h = np.fromiter((digest(s, 42) for s in shingles[a:a + 100_000]), np.uint64)
        ones += np.unpackbits(h.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = (2 * ones > len(shingles)).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view("<u8")[0])


def with_fingerprints(docs: DataFrame, text: str = "text", width: int = 3, out: str = "fp") -> DataFrame:
    """``docs`` without the text and with the fingerprint as a long (its 64 bits)."""
    ship_package(docs.sparkSession)
    others = [c for c in docs.columns if c != text]
    inner = docs.select(*[docs[c].alias(f"k{i}") for i, c in enumerate(others)], docs[text].alias("body"))
    schema = ", ".join([f"k{i} {inner.schema[f'k{i}'].dataType.simpleString()}" for i in range(len(others))] + ["fp long"])
    names = [*[f"k{i}" for i in range(len(others))], "fp"]

    def run(batches):
        for batch in batches:
            fp = np.array([fingerprint(t, width) for t in batch.column("body").to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(fp, pa.int64())], names=names)

    return inner.mapInArrow(run, schema).withColumnsRenamed({f"k{i}": c for i, c in enumerate(others)}).withColumnRenamed("fp", out)


def bk_forest(shard: np.ndarray, fps: np.ndarray):
    """BK-trees of all shards of a batch, built level by level.  ``shard`` numbers the shards from 0
    and is sorted; the first of each shard is its root.  Returns (children's offsets of each node,
    children, their edge keys)."""
    n = len(fps)
    root = np.searchsorted(shard, shard)
    parent, edge, at = np.full(n, -1), np.zeros(n, np.int64), root.copy()
    left = np.flatnonzero(root != np.arange(n))
    while len(left):
        d = np.bitwise_count(fps[left] ^ fps[at[left]]).astype(np.int64)
        _, first, group = np.unique(at[left] * 65 + d, return_index=True, return_inverse=True)
        child = left[first]
        parent[child], edge[child] = at[child], d[first]
        at[left] = child[group]
        left = left[at[left] != left]
    kids = np.flatnonzero(parent >= 0)
    kids = kids[np.argsort(parent[kids], kind="stable")]
    return np.searchsorted(parent[kids], np.arange(n + 1)), kids, edge[kids]


def _roots(link: np.ndarray) -> np.ndarray:
    while not np.array_equal(jump := link[link], link):
        link = jump
    return link


def _merge(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels after joining the components of each pair."""
    while len(a):
        x, y = label[a], label[b]
        differ = x != y
        if not differ.any():
            break
        a, b, x, y = a[differ], b[differ], x[differ], y[differ]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        label = _roots(label)
    return label


def shard_components(shard: np.ndarray, fps: np.ndarray, radius: int, frontier: int = 1_000_000) -> np.ndarray:
    """For each fingerprint the index of the first member of its component among the links
    inside its shard, found by searching each shard's BK-tree with each member."""
    n = len(fps)
    offsets, kids, keys = bk_forest(shard, fps)
    label, root = np.arange(n), np.searchsorted(shard, shard)
    work = [(np.arange(n), root)]
    while work:
        q, node = work.pop()
        if len(q) > frontier:
            work += [(q[frontier:], node[frontier:])]
            q, node = q[:frontier], node[:frontier]
        d = np.bitwise_count(fps[q] ^ fps[node]).astype(np.int64)
        hit = d <= radius
        label = _merge(label, q[hit], node[hit])
        count = offsets[node + 1] - offsets[node]
        total = int(count.sum())
        if not total:
            continue
        step = np.arange(total) - np.repeat(np.cumsum(count) - count, count)
        at = np.repeat(offsets[node], count) + step
        near = np.abs(keys[at] - np.repeat(d, count)) <= radius
        work.append((np.repeat(q, count)[near], kids[at[near]]))
    return label


def _slices(bits: list[int], parts: int) -> list[list[int]]:
    return [list(map(int, x)) for x in np.array_split(np.array(bits), parts)]


def _gather(fps: np.ndarray, bits: list[int]) -> np.ndarray:
    out = np.zeros(len(fps), np.uint64)
    for i, b in enumerate(bits):
        out |= ((fps >> np.uint64(b)) & np.uint64(1)) << np.uint64(i)
    return out


def linked(fps: np.ndarray, bits: list[int], radius: int, most: int) -> np.ndarray:
    """Component labels of one shard; beyond ``most`` members it is cut again by slices of the
    bits that its members need not share."""
    if len(fps) <= most or len(bits) < 2 * (radius + 1):
        return shard_components(np.zeros(len(fps), np.int64), fps, radius)
    label = np.arange(len(fps))
    for part in _slices(bits, radius + 1):
        key = _gather(fps, part)
        order = np.argsort(key, kind="stable")
        rest = [b for b in bits if b not in part]
        cuts = np.flatnonzero(np.diff(key[order])) + 1
        groups = np.split(order, cuts)
        small = [g for g in groups if 1 < len(g) <= most]
        if small:
            at = np.concatenate(small)
            number = np.repeat(np.arange(len(small)), [len(g) for g in small])
            label = _merge(label, at, at[shard_components(number, fps[at], radius)])
        for g in groups:
            if len(g) > most:
                label = _merge(label, g, g[linked(fps[g], rest, radius, most)])
    return label


def _free(path: int, parts: int) -> list[int]:
    """Bits that the members of a shard need not share.  A path is the digits of the slices taken,
    after a leading 1."""
    steps = []
    while path > 1:
        path, step = divmod(path, parts)
        steps.append(step)
    bits = list(range(64))
    for step in reversed(steps):
        gone = set(_slices(bits, parts)[step])
        bits = [b for b in bits if b not in gone]
    return bits


def _value(col, bits: list[int]):
    """These bits of a long, side by side: one shift and mask for each run of adjacent bits."""
    out, i = F.lit(0).cast("long"), 0
    while i < len(bits):
        j = i
        while j + 1 < len(bits) and bits[j + 1] == bits[j] + 1:
            j += 1
        piece = F.shiftrightunsigned(col, bits[i]).bitwiseAND(F.lit((1 << (j - i + 1)) - 1).cast("long"))
        out = out.bitwiseOR(F.shiftleft(piece, i))
        i = j + 1
    return out


def links(distinct: DataFrame, radius: int = 3, most: int = 512, partitions: int | None = None) -> DataFrame:
    """(a, b): links that join the fingerprints (column fp, distinct) within ``radius`` bits into
    the same components as all such links would.

    Shards are counted first.  A shard of one has no link; one of over ``most`` is dealt again by slices
    of its other bits, so that a hot slice value is spread over tasks.  What is still larger after that
    is cut in its task in the same way."""
    ship_package(distinct.sparkSession)
    parts = radius + 1
    n = partitions or int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def dealt(rows: DataFrame, path: int, used: int) -> DataFrame:
        return rows.select("fp", F.explode(F.array(*[
            F.struct(F.lit(path * parts + i).alias("path"),
                     F.col("shard").bitwiseOR(F.shiftleft(_value(F.col("fp"), s), used)).alias("shard"))
            for i, s in enumerate(_slices(_free(path, parts), parts))])).alias("s")).select("fp", "s.path", "s.shard")

    first = dealt(distinct.select("fp", F.lit(0).cast("long").alias("shard")), 1, 0)
    counts = first.groupBy("path", "shard").agg(F.count("*").alias("n")).where("n > 1")
    first = first.join(counts, ["path", "shard"])
    every = first.where(F.col("n") <= most).select("fp", "path", "shard")
    for path in range(parts, 2 * parts):
        again = first.where((F.col("n") > most) & (F.col("path") == path)).select("fp", "shard")
        every = every.unionByName(dealt(again, path, 64 - len(_free(path, parts))))

    def solve(path, shard, fps):
        cuts = np.flatnonzero((path[1:] != path[:-1]) | (shard[1:] != shard[:-1])) + 1
        ends = np.concatenate([[0], cuts, [len(fps)]])
        sizes = np.diff(ends)
        out = np.arange(len(fps))
        small = np.flatnonzero(np.repeat((sizes > 1) & (sizes <= 8 * most), sizes))
        if len(small):
            number = np.unique(np.repeat(np.arange(len(sizes)), sizes)[small], return_inverse=True)[1]
            out[small] = small[shard_components(number, fps[small], radius)]
        for k in np.flatnonzero(sizes > 8 * most):
            lo, hi = ends[k], ends[k + 1]
            out[lo:hi] = lo + linked(fps[lo:hi], _free(int(path[lo]), parts), radius, 8 * most)
        at = np.flatnonzero(out != np.arange(len(fps)))
        return pa.RecordBatch.from_arrays([pa.array(fps[at].view(np.int64)), pa.array(fps[out[at]].view(np.int64))], names=["a", "b"])

    def run(batches):
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            got = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("path", "shard", "fp")]
            got[2] = got[2].astype(np.int64).view(np.uint64)
            if held is not None:
                got = [np.concatenate(x) for x in zip(held, got, strict=True)]
            # the last shard may go on in the next batch
            cut = int(np.argmax((got[0] == got[0][-1]) & (got[1] == got[1][-1])))
            if cut:
                yield solve(*[x[:cut] for x in got])
            held = [x[cut:] for x in got]
        if held is not None:
            yield solve(*held)

    return (every.repartition(n, "path", "shard").sortWithinPartitions("path", "shard", "fp")
            .select("path", "shard", "fp").mapInArrow(run, "a long, b long").distinct())


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root): the smallest node of each node's component, for nodes with a link.

    Large-star and small-star rounds; each round's links are written to the shared folder.  The
    rounds end when the links no longer change (compared by count and sum of hashes)."""
    def state(e):
        return e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()

    cur = stored(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "links")
    seen = state(cur)
    for _ in range(max_rounds):
        if not seen[0]:
            break
        # large star: every larger neighbour of u goes to the smallest of u's neighbourhood
        both = cur.select("u", "v").unionByName(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
        large = both.join(low, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.unionByName(low.where(F.col("m") < F.col("u")).select("u", F.col("m").alias("v"))).distinct()
        # small star: the smaller neighbours of u, and u, go to the smallest of them
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        cur = stored(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct(), "links")
        now = state(cur)
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError(f"components are not settled after {max_rounds} rounds")
    roots = cur.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.unionByName(cur.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = 3, radius: int = 3) -> DataFrame:
    """One row per row of ``docs``: doc_id, fp (long), component_id (the smallest doc_id reachable),
    group (the component's smallest fingerprint as a long, never null)."""
    base = docs.select(docs[doc_id].cast("long").alias("doc_id"), docs[text].alias("body"))
    rows = stored(with_fingerprints(base, "body", width), "fingerprints")
    return grouped(rows, radius)


def grouped(rows: DataFrame, radius: int = 3) -> DataFrame:
    """Adds component_id and group to rows with doc_id and fp."""
    lows = stored(rows.groupBy("fp").agg(F.min("doc_id").alias("low")), "distinct")
    roots = components(links(lows, radius))
    named = lows.join(roots, lows["fp"] == roots["node"], "left").select("fp", "low", F.coalesce("root", "fp").alias("group"))
    least = named.groupBy("group").agg(F.min("low").alias("component_id"))
    names = stored(named.select("fp", "group").join(least, "group"), "components")
    return rows.join(names, "fp")


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = 3, radius: int = 3) -> DataFrame:
    """The rows of ``docs`` but for near-duplicates: of each component the row with the smallest
    doc_id (nulls last) and of equal ids the smallest text hash; of repeated rows one."""
    h, g, keep_id, keep_h = fresh(docs.columns, "h", "g", "keep_id", "keep_h")
    base = docs.select(docs[doc_id].cast("long").alias("doc_id"), F.xxhash64(docs[text]).alias("h"), docs[text].alias("body"))
    rows = grouped(stored(with_fingerprints(base, "body", width), "fingerprints"), radius)
    best = rows.groupBy("group").agg(F.min(F.struct(F.col("doc_id").isNull().alias("z"), "doc_id", "h")).alias("b")) \
        .select(F.col("b.doc_id").alias(keep_id), F.col("b.h").alias(keep_h), F.col("group").alias(g))
    held = docs.withColumn(h, F.xxhash64(docs[text])).join(
        best, F.expr(f"`{h}` = `{keep_h}` AND CAST(`{doc_id}` AS BIGINT) <=> `{keep_id}`"))
    return held.dropDuplicates([g]).select(*docs.columns)
