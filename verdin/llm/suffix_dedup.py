"""Exact removal of repeated byte strings by blockwise suffix sorting with a difference cover.

Every window of ``length`` bytes of every text is a suffix cut to that length; a byte goes if some
window over it starts anywhere else too.  Suffixes are sorted one bucket at a time:

* Buckets.  A suffix belongs to the bucket of its window's leftmost smallest 64-byte gram (by hash),
  so equal windows meet in one bucket at the same distance from that gram, and neighbouring suffixes
  of a text travel together as one run.  Runs are rows of two hashes; buckets with one run in the
  whole corpus, nearly all of them, end there.
* Copies.  Runs of equal content are counted with map-side aggregation.  All windows of a content that
  occurs twice are repeated; only one representative of each content goes on, however many copies.
* Sorting.  Buckets with several contents get the bytes of their representatives.  The ranks of a
  difference-cover sample of positions (modulo 31, six residues) are computed first, from
  ``length - 31`` bytes each; a suffix is then the short record of its first 31 bytes, the rank at
  its next sample position and its last 31 bytes, so long ties are settled by ranks.  Positions count
  from the bucket's gram, so suffixes that can tie have equal residues and share that sample.
  A task sorts bounded blocks of buckets; a bucket of over ``hot`` contents is first cut into cells by
  the bytes that all windows of an eighth of it share.
* Dealing.  A cell that still has over ``hot`` contents (a passage longer than those bytes, in many
  contexts) is not sorted: its windows are dealt one a row by their 128-bit digests, counted with map-side
  aggregation, and the repeated ones joined back.  Equal windows have one gram, distance and cell.

Null text: no bytes.  Texts shorter than ``length`` stay as they are.  Repeated rows are texts like any
other, so their windows count as repeated.  Matches never cross texts.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verdin.llm.common import ship_package, stored

GRAM, COVER, CELLS = 64, 31, 8
SEGMENT = 1 << 20          # starts handled at once in a long text
PLACE = 21                 # bits of a place in a segment (its starts and a window more)
_TABLES: dict = {}


def difference_cover(v: int = COVER, size: int = 6) -> list[int]:
    """The first set of ``size`` residues, by depth-first search, whose differences give every residue."""
    def extend(chosen, gone):
        if len(chosen) == size:
            return chosen if len(gone) == v - 1 else None
        for x in range(chosen[-1] + 1, v):
            new = {(x - y) % v for y in chosen} | {(y - x) % v for y in chosen}
            if len(new) == 2 * len(chosen) and not new & gone and (got := extend([*chosen, x], gone | new)):
                return got
        return None
    return extend([0], set())


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(32))


def _tables():
    """Values of the 256 bytes, powers of an odd base and of its inverse modulo 2**64."""
    if not _TABLES:
        base, n = 0x9E3779B97F4A7C15, SEGMENT + (1 << 12)
        for name, b in (("power", base), ("inverse", pow(base, -1, 1 << 64))):
            p = np.full(n, b, np.uint64)
            p[0] = 1
            _TABLES[name] = np.cumprod(p, dtype=np.uint64)
        _TABLES["byte"] = _mix(np.arange(1, 257, dtype=np.uint64))
    return _TABLES["byte"], _TABLES["power"], _TABLES["inverse"]


def text_runs(data: np.ndarray, length: int):
    """(first start, number of starts, distance of the gram, gram hash, content hash) of the runs of
    one text, as arrays.  A long text is handled in segments of starts."""
    byte, power, inverse = _tables()
    out, starts, width = [], len(data) - length + 1, length - GRAM + 1
    for x in range(0, starts, SEGMENT):
        part = data[x:x + SEGMENT + length - 1]
        total = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(byte[part] * power[:len(part)], out=total[1:])
        grams = len(part) - GRAM + 1
        h = _mix((total[GRAM:] - total[:grams]) * inverse[:grams])
        # order by the hash's upper bits, then place: the leftmost of equal ones is the smallest
        ranked = (h & ~np.uint64((1 << PLACE) - 1)) | np.arange(grams, dtype=np.uint64)
        n = grams - width + 1
        pad = np.concatenate([ranked, np.full(-grams % width, ~np.uint64(0))]).reshape(-1, width)
        ahead = np.minimum.accumulate(pad, axis=1).ravel()
        behind = np.minimum.accumulate(pad[:, ::-1], axis=1)[:, ::-1].ravel()
        place = (np.minimum(behind[:n], ahead[width - 1:width - 1 + n]) & np.uint64((1 << PLACE) - 1)).astype(np.int64)
        first = np.concatenate([[0], np.flatnonzero(place[1:] != place[:-1]) + 1])
        after = np.concatenate([first[1:], [n]])
        content = _mix((total[after + length - 1] - total[first]) * inverse[first])
        out.append((first + x, after - first, place[first] - first, h[place[first]], content))
    return [np.concatenate(c) for c in zip(*out, strict=True)]


def _bodies(column: pa.Array):
    """Each text of a column as an array of bytes, without copies."""
    column = column.cast(pa.large_binary()) if not pa.types.is_large_binary(column.type) else column
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None else np.zeros(0, np.uint8)
    for a, b in zip(offsets[:-1], offsets[1:], strict=True):
        yield data[a:b]


def repeated_starts(bucket: np.ndarray, shift: np.ndarray, count: np.ndarray, flat: np.ndarray, begin: np.ndarray,
                    length: int) -> tuple[np.ndarray, np.ndarray]:
    """Of contents (bucket number, distance of the first start to the bucket's gram, number of starts,
    place of their bytes in ``flat``): (index of the content, start inside it) of the windows that
    occur in two contents of one bucket."""
    cover = np.zeros(COVER, bool)
    cover[difference_cover()] = True
    block = length - COVER
    # ranks of the sample: positions are taken relative to the gram, modulo the cover
    def spread(n):
        which = np.repeat(np.arange(len(n)), n)
        return which, np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)

    which, i = spread(count + COVER)
    rel = i - shift[which]
    sample = cover[rel % COVER] & (i + block <= (count + length - 1)[which])
    which, i, rel = which[sample], i[sample], rel[sample]
    blocks = np.lib.stride_tricks.sliding_window_view(flat, block)
    texts = np.ascontiguousarray(blocks[begin[which] + i]).view(f"V{block}").ravel()
    rank = np.unique(texts, return_inverse=True)[1]
    table = np.full(int((count + COVER).sum()), -1, np.int64)
    base = np.cumsum(count + COVER) - (count + COVER)
    table[base[which] + i] = rank
    # records of the suffixes
    which, i = spread(count)
    rel = i - shift[which]
    step = np.array([next(d for d in range(COVER) if cover[(r + d) % COVER]) for r in range(COVER)])
    edge = np.lib.stride_tricks.sliding_window_view(flat, COVER)
    at = begin[which] + i
    record = np.concatenate([
        bucket[which].astype("<i4").view(np.uint8).reshape(-1, 4), rel.astype("<i4").view(np.uint8).reshape(-1, 4),
        table[base[which] + i + step[rel % COVER]].astype("<i4").view(np.uint8).reshape(-1, 4),
        edge[at], edge[at + length - COVER]], axis=1)
    same, times = np.unique(np.ascontiguousarray(record).view(f"V{record.shape[1]}").ravel(), return_inverse=True, return_counts=True)[1:]
    again = times[same] > 1
    return which[again], i[again]


def removals(docs: DataFrame, length: int = 400, hot: int = 2000, block_starts: int = 150_000) -> DataFrame:
    """(doc_id, h, spans): for each text (h: its XXH64) with repeated windows the bytes to remove, as
    pairs of first byte and end, not merged.  ``docs``: doc_id, text."""
    ship_package(docs.sparkSession)
    if length < GRAM + COVER:
        raise ValueError(f"length must be at least {GRAM + COVER}")
    base = docs.select("doc_id", F.xxhash64("text").alias("h"), "text").where(F.octet_length("text") >= length)
    names = ["doc_id", "h", "a", "n", "shift", "gram", "content"]

    def cut(batches):
        for batch in batches:
            ids, hs, out, sizes = batch.column("doc_id"), batch.column("h"), [], []
            for body in _bodies(batch.column("text")):
                out.append(text_runs(body, length))
                sizes.append(len(out[-1][0]))
            if not out:
                continue
            a, n, shift, gram, content = (np.concatenate(c) for c in zip(*out, strict=True))
            which = pa.array(np.repeat(np.arange(len(sizes)), sizes))
            yield pa.RecordBatch.from_arrays([ids.take(which), hs.take(which), pa.array(a), pa.array(n.astype(np.int32)), pa.array(shift.astype(np.int32)),
                                              pa.array(gram.view(np.int64)), pa.array(content.view(np.int64))], names=names)

    runs = stored(base.mapInArrow(cut, "doc_id long, h long, a long, n int, shift int, gram long, content long"), "runs")
    # tables of their own, so that a join reads two plain shuffles and a hot gram can be split
    often = stored(runs.groupBy("gram").agg(F.count("*").alias("m")).where("m > 1").select("gram"), "grams")
    runs = stored(runs.join(often, "gram"), "shared-runs")
    content = ["gram", "content", "n", "shift"]
    contents = stored(runs.groupBy(*content).agg(F.count("*").alias("m"), F.min(F.struct("doc_id", "h", "a")).alias("at")), "contents")
    several = stored(contents.groupBy("gram").agg(F.count("*").alias("k")).where("k > 1"), "several")
    wanted = (contents.join(several, "gram").groupBy(F.col("at.doc_id").alias("w_id"), F.col("at.h").alias("w_h"))
              .agg(F.collect_list(F.struct("at.a", *content, "k")).alias("wanted")))
    piece = "gram long, cell long, content long, n int, shift int, at int, count int, bytes binary"

    def fetch(batches):
        byte, power, inverse = _tables()
        for batch in batches:
            rows = []
            for body, wanted in zip(_bodies(batch.column("text")), batch.column("wanted"), strict=True):
                for w in wanted.as_py():
                    a, n, shift = w["a"], w["n"], w["shift"]
                    if w["k"] <= hot:
                        rows.append((w["gram"], 0, w["content"], n, shift, 0, n, body[a:a + n + length - 1].tobytes()))
                        continue
                    # starts by their distance to the gram; all windows of a cell hold its common bytes
                    wide = -(-(length - GRAM + 1) // CELLS)
                    for cell in range((shift - n + 1) // wide, shift // wide + 1):
                        i, j = max(0, shift - (cell + 1) * wide + 1), min(n - 1, shift - cell * wide)
                        shared = body[a + shift - cell * wide:a + shift - (cell + 1) * wide + 1 + length]
                        name = int.from_bytes(hashlib.blake2b(bytes([cell]) + shared.tobytes(), digest_size=8).digest(), "little", signed=True)
                        rows.append((w["gram"], name, w["content"], n, shift, i, j - i + 1, body[a + i:a + j + length].tobytes()))
            if rows:
                types = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)],
                                                 names=[c.split()[0] for c in piece.split(", ")])

    same = (base["doc_id"].eqNullSafe(F.col("w_id"))) & (base["h"] == F.col("w_h"))
    # of equal rows one is asked: they hold the same bytes
    once = base.join(wanted, same).dropDuplicates(["doc_id", "h"])
    pieces = stored(once.select("text", "wanted").mapInArrow(fetch, piece), "pieces")
    # cell 0: of a bucket that is not cut
    full = stored(pieces.where("cell <> 0").groupBy("gram", "cell").agg(F.count("*").alias("k")).where(F.col("k") > hot).select("gram", "cell"), "full-cells")

    def deal(batches):
        for batch in batches:
            for x in range(0, batch.num_rows, 1000):
                part = batch.slice(x, 1000)
                count = part.column("count").to_numpy()
                which = np.repeat(np.arange(len(count)), count)
                i = np.arange(len(which)) - np.repeat(np.cumsum(count) - count, count) + part.column("at").to_numpy()[which]
                keys = [hashlib.blake2b(body[k:k + length].tobytes(), digest_size=16).digest()
                        for body, c in zip(_bodies(part.column("bytes")), count, strict=True) for k in range(c)]
                yield pa.RecordBatch.from_arrays([*(part.column(c).take(pa.array(which)) for c in content), pa.array(i.astype(np.int32)), pa.array(keys, pa.binary())],
                                                 names=[*content, "i", "key"])

    windows = stored(pieces.join(full, ["gram", "cell"], "left_semi").mapInArrow(deal, "gram long, content long, n int, shift int, i int, key binary"), "windows")
    keys = stored(windows.groupBy("key").agg(F.count("*").alias("m")).where("m > 1").select("key"), "window-keys")
    # windows of a content start less than ``length`` apart: from the first to the last all bytes are covered
    dealt = windows.join(keys, "key").groupBy(*content).agg(F.min("i").alias("first"), F.max("i").alias("last"))

    def sort(batches):
        def solve(rows):
            head, cell, named, n, shift, at, count, data = rows
            bucket = np.cumsum(np.concatenate([[0], (head[1:] != head[:-1]) | (cell[1:] != cell[:-1])]))
            # each piece once
            _, first = np.unique(np.stack([bucket, named, n, shift, at]), axis=1, return_index=True)
            first.sort()
            sizes = np.array([len(data[k]) for k in first])
            flat = np.frombuffer(b"".join(data[k] for k in first), np.uint8)
            which, i = repeated_starts(bucket[first], (shift - at)[first], count[first].astype(np.int64), flat, np.cumsum(sizes) - sizes, length)
            if not len(which):
                return None
            new = np.concatenate([[True], (which[1:] != which[:-1]) | (i[1:] != i[:-1] + 1)])
            lo = np.flatnonzero(new)
            hi = np.concatenate([lo[1:], [len(which)]]) - 1
            k = first[which[lo]]
            return pa.RecordBatch.from_arrays([pa.array(x) for x in (head[k], named[k], n[k], shift[k], (i[lo] + at[k]).astype(np.int32), (i[hi] + at[k]).astype(np.int32))],
                                              names=[*content, "first", "last"])

        held, starts = None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            got = [batch.column(c).to_numpy(zero_copy_only=False) for c in range(7)] + [np.array(batch.column(7).to_pylist(), object)]
            held = got if held is None else [np.concatenate(x) for x in zip(held, got, strict=True)]
            starts = int(held[6].sum())
            while starts > block_starts:
                # whole buckets up to the block's size, one at least; the last may go on in the next batch
                new = np.flatnonzero((held[0][1:] != held[0][:-1]) | (held[1][1:] != held[1][:-1])) + 1
                if not len(new):
                    break
                upto = np.cumsum(held[6])[new - 1]
                cut = int(new[max(0, np.searchsorted(upto, block_starts, "right") - 1)])
                done = solve([x[:cut] for x in held])
                if done is not None:
                    yield done
                held = [x[cut:] for x in held]
                starts = int(held[6].sum())
        if held is not None and len(held[0]):
            done = solve(held)
            if done is not None:
                yield done

    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = (pieces.join(full, ["gram", "cell"], "left_anti").select(*pieces.columns).repartition(parts, "gram", "cell").sortWithinPartitions("gram", "cell")
             .mapInArrow(sort, "gram long, content long, n int, shift int, first int, last int")).unionByName(dealt)
    whole = contents.where("m > 1").select(*content, F.lit(0).alias("first"), (F.col("n") - 1).alias("last"))
    single = found.join(contents.where("m = 1").select(*content), content, "left_semi")
    spans = runs.join(stored(whole.unionByName(single), "repeated"), content).select(
        "doc_id", "h", F.struct((F.col("a") + F.col("first")).alias("a"), (F.col("a") + F.col("last") + F.lit(length)).alias("b")).alias("span"))
    return spans.distinct().groupBy("doc_id", "h").agg(F.collect_list("span").alias("spans"))


def merged(spans: list) -> list[tuple[int, int]]:
    out: list = []
    for a, b in sorted((s["a"], s["b"]) for s in spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [tuple(x) for x in out]


def remove_repeats(docs: DataFrame, length: int = 400, doc_id: str = "doc_id", text: str = "text", with_kept: bool = False) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_bytes, n_removed, n_spans (maximal removed runs),
    kept_sha256, and with ``with_kept`` the remaining bytes and the removed spans."""
    base = docs.select(docs[doc_id].cast("long").alias("doc_id"), F.coalesce(docs[text], F.lit("")).alias("text"))
    gone = removals(base, length).select(F.col("doc_id").alias("g_id"), F.col("h").alias("g_h"), "spans")
    rows = base.withColumn("h", F.xxhash64("text"))
    joined = rows.join(gone, rows["doc_id"].eqNullSafe(gone["g_id"]) & (rows["h"] == gone["g_h"]), "left").select("doc_id", "text", "spans")
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + \
        ", kept binary, removed array<struct<a:bigint,b:bigint>>" * with_kept

    def run(batches):
        for batch in batches:
            n, removed, number, digest, kept, cuts = [], [], [], [], [], []
            for body, spans in zip(_bodies(batch.column("text")), batch.column("spans"), strict=True):
                spans = merged(spans.as_py() or [])
                parts, at = [], 0
                for a, b in spans:
                    parts.append(body[at:a].tobytes())
                    at = b
                rest = b"".join([*parts, body[at:].tobytes()])
                n.append(len(body))
                removed.append(len(body) - len(rest))
                number.append(len(spans))
                digest.append(hashlib.sha256(rest).hexdigest())
                if with_kept:
                    kept.append(rest)
                    cuts.append([{"a": a, "b": b} for a, b in spans])
            columns = [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(number, pa.int64()), pa.array(digest, pa.string())]
            if with_kept:
                columns += [pa.array(kept, pa.binary()), pa.array(cuts, pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())])))]
            yield pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in schema.split(", ")])

    return joined.mapInArrow(run, schema)
