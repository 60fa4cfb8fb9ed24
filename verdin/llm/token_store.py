"""Token-id files: concatenated ids with Elias-Fano coded document boundaries.

A store is a Parquet table of segments in ascending key order.  A segment holds whole documents:
their ids as one little-endian array (16 bits an id where the vocabulary allows, else 32), the
boundaries (the running totals of tokens) as Elias-Fano code, and their keys in the same code, as
distances from the segment's first key after a count of null keys.  For n boundaries up to u the code keeps the low floor(log2(u / n)) bits of each in a packed array and the high parts as a
unary bit string, at most 2 bits a document more; select finds the k-th one bit through a
directory with one 32-bit entry for each 256 ones, so no table of 64-bit offsets exists, and readers
take every boundary and key through it.  A segment ends before a key 2^62 or more above its first.  Segments
are rows that Spark's committed writer puts into the shared folder, so lost tasks leave nothing
half written, and any store that Spark reads can hold them.

Null texts count as empty: such a document has its end id alone.  Null keys come first.  Rows of
equal key follow each other by their text; repeated rows each keep their place.  An empty table
gives an empty store.  Very long texts make a segment of their own size.  Further columns of the
documents, whatever their names, are not stored.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from verdin.llm.common import ship_package
from verdin.llm.pretoken import Encoded, encode_batch
from verdin.session import ensure_checkpoint_dir

MAGIC, SAMPLE, BLOCK = b"EFT2", 256, 4096
SPAN = 1 << 62
SEGMENT = "part int, segment int, n_docs long, n_ids long, payload binary"
_TOKENIZERS: dict = {}
_TABLES: dict = {}


def pack(values: np.ndarray, width: int) -> bytes:
    """The low ``width`` bits of each value, least significant bit first, in blocks that end at whole bytes."""
    if not width:
        return b""
    blocks = (values[a:a + BLOCK] for a in range(0, len(values), BLOCK))
    return b"".join(np.packbits(((x[:, None] >> np.arange(width)) & 1).astype(np.uint8).ravel(), bitorder="little").tobytes() for x in blocks)


def unpack(data: bytes, width: int, k: int) -> int:
    """The k-th value of a packed array."""
    first = k * width
    raw = int.from_bytes(data[first >> 3:(first + width + 7) >> 3], "little")
    return (raw >> (first & 7)) & ((1 << width) - 1)


class EliasFano:
    """A non-decreasing sequence of n integers up to ``universe``."""

    def __init__(self, n: int, universe: int, low_bits: int, low: bytes, high: bytes, directory: np.ndarray):
        self.n, self.universe, self.low_bits = n, universe, low_bits
        self.low, self.high, self.directory = low, high, directory

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        values = np.asarray(values, np.int64)
        n, universe = len(values), int(values[-1]) if len(values) else 0
        low_bits = max(0, (universe // n).bit_length() - 1) if n else 0
        ones = (values >> low_bits) + np.arange(n)
        bits = np.zeros(int(ones[-1]) + 1 if n else 0, np.uint8)
        bits[ones] = 1
        return cls(n, universe, low_bits, pack(values & ((1 << low_bits) - 1), low_bits),
                   np.packbits(bits, bitorder="little").tobytes(), ones[::SAMPLE].astype("<u4"))

    def to_bytes(self) -> bytes:
        head = struct.pack("<QQBQQQ", self.n, self.universe, self.low_bits, len(self.low), len(self.high), len(self.directory))
        return head + self.low + self.high + self.directory.tobytes()

    @classmethod
    def from_bytes(cls, data: bytes, at: int = 0) -> tuple[EliasFano, int]:
        n, universe, low_bits, a, b, c = struct.unpack_from("<QQBQQQ", data, at)
        at += struct.calcsize("<QQBQQQ")
        low, high = data[at:at + a], data[at + a:at + a + b]
        directory = np.frombuffer(data, "<u4", c, at + a + b)
        return cls(n, universe, low_bits, low, high, directory), at + a + b + 4 * c

    def select(self, k: int) -> int:
        """The k-th value: the directory names a bit near its one, a short scan finds it."""
        if not 0 <= k < self.n:
            raise IndexError(k)
        bit = int(self.directory[k // SAMPLE])
        left, byte = k % SAMPLE, bit >> 3
        word = self.high[byte] & (0xFF << (bit & 7)) & 0xFF
        while (ones := word.bit_count()) <= left:
            left -= ones
            byte += 1
            word = self.high[byte]
        for _ in range(left):
            word &= word - 1
        place = 8 * byte + (word & -word).bit_length() - 1
        return ((place - k) << self.low_bits) | unpack(self.low, self.low_bits, k)


def seal(keys: list, ids: list[np.ndarray], first: int, wide: bool) -> bytes:
    """One segment: header (id width, first offset, documents, null keys, first key), boundaries, keys, ids.  Keys ascend, nulls first."""
    ends = np.cumsum([len(x) for x in ids])
    flat = np.concatenate(ids).astype("<u4" if wide else "<u2").tobytes()
    known = [k for k in keys if k is not None]
    low = known[0] if known else 0
    head = MAGIC + struct.pack("<BQQQq", wide, first, len(keys), len(keys) - len(known), low)
    return head + EliasFano.of(ends).to_bytes() + EliasFano.of(np.array([k - low for k in known], np.int64)).to_bytes() + flat


class Segment:
    """A sealed segment, read: ``document(k)`` gives the ids of its k-th document, ``key(k)`` its key."""

    def __init__(self, data: bytes):
        if data[:4] != MAGIC:
            raise ValueError("not a token segment")
        wide, self.first, self.n, self.nulls, self.low = struct.unpack_from("<BQQQq", data, 4)
        self.ends, at = EliasFano.from_bytes(data, 4 + struct.calcsize("<BQQQq"))
        self.above, at = EliasFano.from_bytes(data, at)
        self.ids = np.frombuffer(data, "<u4" if wide else "<u2", self.ends.universe, at)

    def key(self, k: int) -> int | None:
        return None if k < self.nulls else self.low + self.above.select(k - self.nulls)

    def bounds(self, k: int) -> tuple[int, int]:
        return (self.ends.select(k - 1) if k else 0), self.ends.select(k)

    def document(self, k: int) -> np.ndarray:
        a, b = self.bounds(k)
        return self.ids[a:b]


def _tokenizer(path: str):
    if path not in _TOKENIZERS:
        import os
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        _TOKENIZERS[path] = Tokenizer.from_file(path)
    return _TOKENIZERS[path]


def _encoder(path: str):
    """Encodes the distinct tokens of a batch with the tokenizers library.  The tokenizer's own
    first step cuts a text by the public pattern and encodes each piece alone, so the ids of a
    text are those of its pieces, joined; special tokens in a text are found by the library."""
    tok = _tokenizer(path)

    def encode(words: list[bytes]):
        got = [e.ids for e in tok.encode_batch_fast([w.decode() for w in words], add_special_tokens=False)]
        sizes = np.fromiter(map(len, got), np.int64, len(got))
        return np.fromiter(chain.from_iterable(got), np.uint32, int(sizes.sum())), sizes

    return encode


def _table(path: str) -> Encoded:
    """This worker's ids of distinct tokens, which the tasks it runs one after another share."""
    if path not in _TABLES:
        _TABLES.clear()
        _TABLES[path] = Encoded(_encoder(path))
    return _TABLES[path]


def write_store(docs: DataFrame, tokenizer: str, end_id: int, path: str, key: str = "doc_id", text: str = "text",
                ids_a_segment: int = 500_000, partitions: int | None = None) -> None:
    """Encode the texts and write the segments in ascending order of the integer key.

    Ranges of the key are dealt over ``partitions`` tasks (rows of one key by their text's hash);
    a task sorts its rows, encodes them batch by batch and closes a segment at ``ids_a_segment``
    ids, so it holds one segment at a time.  A document is never cut."""
    spark = docs.sparkSession
    ship_package(spark)
    import json
    with open(tokenizer, encoding="utf-8") as f:
        spec = json.load(f)
    special = [t["content"] for t in spec.get("added_tokens", [])]
    wide = max([end_id, *spec["model"]["vocab"].values(), *(t["id"] for t in spec.get("added_tokens", []))]) > 0xFFFF
    n = partitions or max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2)
    rows = docs.select(docs[key].cast("long").alias("k"), docs[text].alias("body"))
    dealt = (rows.repartitionByRange(n, F.col("k").asc_nulls_first(), F.xxhash64("body"))
             .sortWithinPartitions(F.col("k").asc_nulls_first(), F.xxhash64("body"), "body"))

    def run(batches):
        part = TaskContext.get().partitionId()
        table, tok = _table(tokenizer), _tokenizer(tokenizer)
        keys, ids, held, first, number, low = [], [], 0, 0, 0, None

        def close():
            return pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()), pa.array([number], pa.int32()), pa.array([len(keys)], pa.int64()),
                 pa.array([held], pa.int64()), pa.array([seal(keys, ids, first, wide)], pa.binary())],
                names=["part", "segment", "n_docs", "n_ids", "payload"])

        for batch in batches:
            bodies = [x or "" for x in batch.column("body").to_pylist()]
            coded = encode_batch(bodies, table)
            for i, body in enumerate(bodies):
                if any(s in body for s in special):
                    coded[i] = np.array(tok.encode(body, add_special_tokens=False).ids, np.uint32)
            for k, x in zip(batch.column("k").to_pylist(), coded, strict=True):
                low = low if low is not None else k
                if low is not None and k - low >= SPAN:
                    yield close()
                    keys, ids, held, first, number, low = [], [], 0, first + held, number + 1, k
                keys.append(k)
                ids.append(np.append(x, np.uint32(end_id)))
                held += len(x) + 1
                if held >= ids_a_segment:
                    yield close()
                    keys, ids, held, first, number, low = [], [], 0, first + held, number + 1, None
        if keys:
            yield close()

    dealt.mapInArrow(run, SEGMENT).write.parquet(path)


def read_store(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """One row per document of a store: doc_id, start (ids of all documents before it), n_tokens,
    ids_crc32, and with ``with_ids`` the ids.

    Inside its part a segment knows its first offset; parts are added up from one total each, as
    many rows as the store has parts."""
    ship_package(spark)
    segments = spark.read.schema(SEGMENT).parquet(path)
    totals = segments.groupBy("part").agg(F.sum("n_ids").alias("n"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = totals.select("part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    schema = "part int, doc_id long, offset long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids

    def run(batches):
        for batch in batches:
            for part, payload in zip(batch.column("part").to_pylist(), batch.column("payload"), strict=True):
                seg = Segment(payload.as_py())
                ends = np.fromiter(map(seg.ends.select, range(seg.n)), np.int64, seg.n)
                starts = np.concatenate([[0], ends[:-1]])
                data = np.ascontiguousarray(seg.ids, "<u4")
                out = [pa.array([part] * seg.n, pa.int32()), pa.array(map(seg.key, range(seg.n)), pa.int64()),
                       pa.array(starts + seg.first, pa.int64()), pa.array(ends - starts, pa.int64()),
                       pa.array([zlib.crc32(data[a:b].tobytes()) for a, b in zip(starts, ends, strict=True)], pa.int64())]
                if with_ids:
                    out.append(pa.ListArray.from_arrays(np.append(starts, ends[-1]).astype(np.int32), data.astype(np.int64)))
                yield pa.RecordBatch.from_arrays(out, names=[c.split()[0] for c in schema.split(", ")])

    docs = segments.select("part", "payload").mapInArrow(run, schema)
    joined = docs.join(before, "part")
    return joined.select("doc_id", (F.col("before") + F.col("offset")).alias("start"), "n_tokens", "ids_crc32",
                         *["ids"] * with_ids)


def store_path(spark: SparkSession, name: str) -> str:
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/llm/{name}-{uuid.uuid4().hex}"
