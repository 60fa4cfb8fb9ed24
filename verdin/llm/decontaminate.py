"""Benchmark decontamination by pigeonhole edit matching.

Texts and test items are compared in a plain form: letters in lower case, each run of characters that
are neither letters nor digits as one blank.  An item of m characters has an error budget of k =
floor(rate * m) edits and is cut into k + 1 pieces; a passage within k edits of the item holds one piece
at least unchanged.  Pieces are found exactly, all at once, by an Aho-Corasick automaton; around each hit
the item is verified by Myers' bit-parallel algorithm, which gives the least edit distance of the item
to any part of the window.

A benchmark of at most ``block_chars`` characters goes to the tasks at once.  A larger one is numbered
by Spark into blocks of that size; one block at a time is broadcast, matched against all texts and freed,
and what the blocks found is united by the text's digest, since it depends on the text alone.  Items too short for an
edit (k = 0) are matched without errors and only as whole words; items without any
character match nothing.  Null texts match nothing; repeated items each match; repeated rows each
keep a row.
"""

from __future__ import annotations

from functools import reduce

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verdin.llm.common import ship_package, stored

_GAP = regex.compile(r"[^\p{L}\p{N}]+")


def plain(text: str | None) -> str:
    return _GAP.sub(" ", (text or "").lower()).strip()


def distance(pattern: str, text: str, most: int) -> int | None:
    """The least edit distance of the pattern to any part of the text, None beyond ``most``.

    Columns of the distance table are kept as differences of neighbouring rows in two integers of one
    bit a row; the last row's value is followed from column to column."""
    m = len(pattern)
    if not m:
        return 0
    rows: dict = {}
    for i, c in enumerate(pattern):
        rows[c] = rows.get(c, 0) | 1 << i
    full, last = (1 << m) - 1, 1 << (m - 1)
    plus, minus, score, best = full, 0, m, m
    get = rows.get
    for c in text:
        eq = get(c, 0)
        diagonal = (((eq & plus) + plus) ^ plus) | eq | minus
        up = minus | ~(diagonal | plus) & full
        down = plus & diagonal
        if up & last:
            score += 1
        elif down & last:
            score -= 1
            if score < best:
                best = score
        up = (up << 1) & full   # the first row is zero everywhere: a match may start anywhere
        down = (down << 1) & full
        plus = down | ~(diagonal | up) & full
        minus = up & diagonal
    return best if best <= most else None


class Matcher:
    """The automaton and patterns of one block of items."""

    def __init__(self, items: list[tuple], rate: float):
        self.items = []
        pieces: dict[str, list] = {}
        for item_id, text in items:
            p = plain(text)
            if not p:
                continue
            k = int(rate * len(p))
            at = len(self.items)
            if k == 0:
                # blanks around it: whole words
                p = f" {p} "
            self.items.append((item_id, p, k))
            cuts = [len(p) * i // (k + 1) for i in range(k + 2)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                pieces.setdefault(p[a:b], []).append((at, a))
        self.automaton = ahocorasick.Automaton()
        for p, where in pieces.items():
            self.automaton.add_word(p, (len(p), where))
        if pieces:
            self.automaton.make_automaton()
        self.any = bool(pieces)

    def find(self, text: str | None) -> dict:
        """item -> least distance, of the items found in a text."""
        if not self.any or not text:
            return {}
        body = f" {plain(text)} "
        windows: dict[int, list] = {}
        for end, (size, where) in self.automaton.iter(body):
            for at, a in where:
                start = end - size + 1 - a
                k = self.items[at][2]
                lo, hi = max(0, start - k), start + len(self.items[at][1]) + k
                spans = windows.setdefault(at, [])
                # hits of one passage follow each other: join their windows
                if spans and lo <= spans[-1][1]:
                    spans[-1] = (min(lo, spans[-1][0]), max(hi, spans[-1][1]))
                else:
                    spans.append((lo, hi))
        out: dict = {}
        for at, spans in windows.items():
            item_id, p, k = self.items[at]
            for lo, hi in spans:
                d = 0 if body.find(p, lo, hi) >= 0 else distance(p, body[lo:hi], k) if k else None
                if d is not None:
                    out[at] = min(d, out.get(at, d))
        return {(at, self.items[at][0]): d for at, d in out.items()}


def _chars(column):
    """What an item counts for in a block."""
    return F.coalesce(F.length(column), F.lit(0)).cast("long") + 1


def numbered(items: DataFrame, block_chars: int) -> DataFrame:
    """``items`` (i, t) and their task and part: parts of a task hold at most ``block_chars`` characters, one item at
    least."""
    def run(batches):
        import pyspark
        task, part, chars = pyspark.TaskContext.get().partitionId(), 0, 0
        for batch in batches:
            parts = []
            for t in batch.column("t").to_pylist():
                size = len(t or "") + 1
                if chars and chars + size > block_chars:
                    part, chars = part + 1, 0
                chars += size
                parts.append(part)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([task] * len(parts), pa.int64()), pa.array(parts, pa.int64())],
                                             names=["i", "t", "task", "part"])

    return stored(items.mapInArrow(run, f"i {items.schema['i'].dataType.simpleString()}, t string, task long, part long"), "benchmark-blocks")


def item_blocks(items: DataFrame, block_chars: int):
    """Lists of (id, text) of at most ``block_chars`` characters, one item at least, one list at a time."""
    parts = numbered(items, block_chars)
    sizes = parts.groupBy("task", "part").agg(F.sum(_chars("t")).alias("n")).orderBy("task", "part").collect()   # a row a part
    bound = lambda k: F.struct(*[F.lit(sizes[k][c]).cast("long") for c in ("task", "part")])
    at = 0
    while at < len(sizes):
        upto, chars = at + 1, sizes[at]["n"]
        while upto < len(sizes) and chars + sizes[upto]["n"] <= block_chars:
            chars, upto = chars + sizes[upto]["n"], upto + 1
        yield [(r["i"], r["t"]) for r in parts.where((F.struct("task", "part") >= bound(at)) & (F.struct("task", "part") <= bound(upto - 1))).select("i", "t").collect()]
        at = upto


def _order(found: list) -> list:
    return sorted(found, key=lambda r: (r[0] is None, r[0], r[1]))


def _found(inner: DataFrame, block, rate: float, item_type) -> DataFrame:
    """``inner`` with found in the place of its last column, the text: the pairs of one broadcast block, sorted."""
    names = [*inner.columns[:-1], "found"]
    schema = ", ".join([f"{c} {inner.schema[c].dataType.simpleString()}" for c in names[:-1]] + [f"found array<struct<item:{item_type.simpleString()},distance:int>>"])

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_type
        kind = pa.list_(pa.struct([("item", to_arrow_type(item_type)), ("distance", pa.int32())]))
        m = None
        for batch in batches:
            m = m or Matcher(block.value, rate)
            rows = [[{"item": x, "distance": d} for x, d in _order([(x, d) for (_, x), d in m.find(t).items()])] for t in batch.column(batch.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(rows, kind)], names=names)

    return inner.mapInArrow(run, schema)


def matches(docs: DataFrame, benchmark: DataFrame, rate: float = 0.08, keep: tuple = ("doc_id",), text: str = "text",
            item_id: str = "item_id", item_text: str = "text", block_chars: int = 4_000_000) -> DataFrame:
    """The columns ``keep`` of every row, and found: its (item, distance) pairs, sorted."""
    spark = docs.sparkSession
    ship_package(spark)
    item_type = benchmark.schema[item_id].dataType
    items = benchmark.select(benchmark[item_id].alias("i"), benchmark[item_text].alias("t"))
    names = {f"k{i}": c for i, c in enumerate(keep)}
    inner = docs.select(*[docs[c].alias(k) for k, c in names.items()], docs[text].alias("body"))
    if (items.agg(F.sum(_chars("t"))).first()[0] or 0) <= block_chars:
        block = spark.sparkContext.broadcast([(r["i"], r["t"]) for r in items.collect()])
        return _found(inner, block, rate, item_type).withColumnsRenamed(names)
    digest = F.sha2("body", 256)
    texts = inner.where("body IS NOT NULL").select(digest.alias("h"), "body")
    parts = []
    for number, held in enumerate(item_blocks(items, block_chars)):
        block = spark.sparkContext.broadcast(held)
        parts.append(stored(_found(texts, block, rate, item_type).where(F.size("found") > 0)
                            .groupBy("h").agg(F.first("found").alias("found")), f"found-{number}"))   # equal texts have equal pairs
        block.destroy()
    every = reduce(DataFrame.unionAll, parts).groupBy("h").agg(F.flatten(F.collect_list("found")).alias("found"))
    ordered = F.transform(F.sort_array(F.transform("found", lambda f: F.struct(f["item"].isNull().alias("last"), f["item"].alias("item"), f["distance"].alias("distance")))),
                          lambda f: F.struct(f["item"].alias("item"), f["distance"].alias("distance")))
    out = inner.withColumn("h", digest).join(every, "h", "left")
    return out.select(*names, F.coalesce(ordered, F.array().cast(parts[0].schema["found"].dataType)).alias("found")).withColumnsRenamed(names)


def clean(docs: DataFrame, benchmark: DataFrame, text: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` in which no item is found, decided in one pass over them."""
    names = docs.columns
    plain_ = docs.toDF(*[f"c{i}" for i in range(len(names))])
    body = f"c{names.index(text)}"
    got = matches(plain_, benchmark, keep=tuple(plain_.columns), text=body, **options)
    return got.where(F.size("found") == 0).select(*[F.col(f"c{i}").alias(n) for i, n in enumerate(names)])
