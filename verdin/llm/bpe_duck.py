"""Byte-level BPE encoding and decoding with DuckDB recursive queries per partition.

Every task opens an in-memory DuckDB with the merge table: one row (a, b, r) for each way to cut a
token of rank r into two tokens.  The distinct tokens-to-be ("words") of a block become position
rows (word, position, id); a recursive query joins neighbours with the merge table, contracts the
leftmost pair of the word's lowest rank, and every further pair of that rank that does not
overlap one already taken, until no pair of the word is in the table.  Contracting all pairs of
the lowest rank in one round gives what contracting one a round gives: a contraction makes no
pair of a lower rank, as every token's own bytes contract back to it (``tests/llm`` verifies that
for the whole vocabulary).  Words of one token are found by their bytes.  Ordered aggregation
joins the ids of a word, and decodes id rows back into bytes.

Nulls and empty texts have no ids and decode to no bytes; ids, ties and repeated rows stay one
result row per input row.
"""

from __future__ import annotations

import base64
import hashlib

import duckdb
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from verdin.llm.common import ship_package
from verdin.llm.pretoken import Encoded, encode_batch

CONTRACT = """
WITH RECURSIVE s AS (
  SELECT w, p, t, true AS live FROM cells
  UNION ALL
  (WITH pr AS (SELECT w, p, t, lead(t) OVER o AS nx, lead(w) OVER o AS nw, row_number() OVER o AS n
               FROM s WHERE live WINDOW o AS (ORDER BY p)),
        rk AS (SELECT w, n, r FROM pr JOIN merges ON a = t AND b = nx WHERE w = nw),
        best AS (SELECT w, min(r) AS r FROM rk GROUP BY w),
        hit AS (SELECT rk.n, rk.r, rk.n - row_number() OVER (ORDER BY rk.n) AS isle
                FROM rk JOIN best ON rk.w = best.w AND rk.r = best.r),
        cut AS (SELECT n, r FROM (SELECT *, min(n) OVER (PARTITION BY isle) AS first FROM hit)
                WHERE (n - first) % 2 = 0),
        done AS (SELECT n, r FROM cut UNION ALL SELECT n + 1, -1 FROM cut)
   SELECT pr.w, pr.p, coalesce(done.r, pr.t), best.w IS NOT NULL
   FROM pr LEFT JOIN best ON pr.w = best.w LEFT JOIN done ON done.n = pr.n
   WHERE done.r IS NULL OR done.r >= 0)
)
SELECT w, t FROM s WHERE NOT live ORDER BY p
"""

DECODE = """
SELECT b.d, string_agg(v.c, '' ORDER BY b.n) AS c FROM blocks b JOIN vocabulary v ON v.id = b.id GROUP BY b.d
"""

_OPEN: dict = {}


class DuckBpe:
    """One DuckDB with the tables of a rank file; kept for the life of a Python worker."""

    def __init__(self, rank_file: str, words_a_query: int = 40_000, cells_a_query: int = 400_000):
        with open(rank_file, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.words_a_query, self.cells_a_query = words_a_query, cells_a_query
        rows = [(self.ranks[w[:k]], self.ranks[w[k:]], r) for w, r in self.ranks.items()
                for k in range(1, len(w)) if w[:k] in self.ranks and w[k:] in self.ranks]
        self.byte_id = np.array([self.ranks[bytes([i])] for i in range(256)], np.int32)
        self.con = duckdb.connect(":memory:", config={"threads": 1, "memory_limit": "450MB"})
        self._table("merges", dict(zip("abr", np.array(rows, np.int32).T.copy(), strict=True)))
        self._table("vocabulary", {"id": np.array(list(self.ranks.values()), np.int32),
                                   "c": [w.decode("latin-1") for w in self.ranks]})   # a character a byte

    def _table(self, name: str, columns: dict) -> None:
        self.con.register("given", pa.table(columns))
        self.con.execute(f"CREATE OR REPLACE TABLE {name} AS SELECT * FROM given")
        self.con.unregister("given")

    def encode_words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words, joined; number of ids of each)."""
        whole = np.fromiter((self.ranks.get(w, -1) for w in words), np.int64, len(words))
        sizes = (whole >= 0).astype(np.int64)
        rest = np.array([i for i in np.flatnonzero(whole < 0) if words[i]], np.int64)
        contracted, a = [np.zeros(0, np.uint32)], 0
        while a < len(rest):
            b, cells = a, 0
            while b < len(rest) and b - a < self.words_a_query and (b == a or cells + len(words[rest[b]]) <= self.cells_a_query):
                cells += len(words[rest[b]])
                b += 1
            sizes[rest[a:b]], ids = self._contract_flat([words[i] for i in rest[a:b]])
            contracted.append(ids)
            a = b
        first = np.cumsum(sizes) - sizes
        flat = np.empty(int(sizes.sum()), np.uint32)
        flat[first[whole >= 0]] = whole[whole >= 0]
        n = sizes[rest]
        flat[np.arange(int(n.sum())) + np.repeat(first[rest] - (np.cumsum(n) - n), n)] = np.concatenate(contracted)
        return flat, sizes

    def _contract(self, words: list[bytes]) -> list[np.ndarray]:
        """The ids of each word."""
        sizes, ids = self._contract_flat(words)
        return np.split(ids, np.cumsum(sizes)[:-1])

    def _contract_flat(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(number of ids of each word, ids of all words in order).  Positions count through all words."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        data = np.frombuffer(b"".join(words), np.uint8)
        self.con.register("cells", pa.table({
            "w": np.repeat(np.arange(len(words), dtype=np.int32), sizes),
            "p": np.arange(len(data), dtype=np.int32), "t": self.byte_id[data]}))
        got = self.con.execute(CONTRACT).fetchnumpy()
        self.con.unregister("cells")
        return np.bincount(np.asarray(got["w"]), minlength=len(words)), np.asarray(got["t"]).astype(np.uint32)

    def decode(self, documents: list[np.ndarray], ids_a_query: int = 300_000) -> list[bytes]:
        """The bytes of each list of ids.  A long list is decoded in pieces, joined in order."""
        pieces = [(d, ids[k:k + ids_a_query]) for d, ids in enumerate(documents) for k in range(0, len(ids), ids_a_query)]
        out = [[] for _ in documents]
        a = 0
        while a < len(pieces):
            b, n = a, 0
            while b < len(pieces) and (b == a or n + len(pieces[b][1]) <= ids_a_query):
                n += len(pieces[b][1])
                b += 1
            flat = np.concatenate([x for _, x in pieces[a:b]]).astype(np.int32)
            owner = np.repeat(np.arange(b - a, dtype=np.int32), [len(x) for _, x in pieces[a:b]])
            self.con.register("blocks", pa.table({"d": owner, "n": np.arange(len(flat), dtype=np.int32), "id": flat}))
            got = dict(self.con.execute(DECODE).fetchall())
            self.con.unregister("blocks")
            for k in range(a, b):
                out[pieces[k][0]].append(got[k - a].encode("latin-1"))
            a = b
        return [b"".join(x) for x in out]


def opened(rank_file: str) -> DuckBpe:
    if rank_file not in _OPEN:
        _OPEN[rank_file] = DuckBpe(rank_file)
    return _OPEN[rank_file]


def encode_decode(docs: DataFrame, rank_file: str, text: str = "text", keep: tuple = ("doc_id",),
                  with_ids: bool = False) -> DataFrame:
    """One row per row of ``docs``: the columns ``keep``, n_tokens, ids_sha256 (of the ids as
    little-endian unsigned 32-bit integers) and decoded_sha256 (of the bytes that the ids decode
    to); with ``with_ids`` also ids and decoded themselves.  Null text: empty."""
    ship_package(docs.sparkSession)
    kept = list(keep)
    inner = docs.select(*[docs[c].alias(f"k{i}") for i, c in enumerate(kept)], docs[text].alias("body"))
    schema = ", ".join([f"k{i} {inner.schema[f'k{i}'].dataType.simpleString()}" for i in range(len(kept))]
                       + ["n_tokens long", "ids_sha256 string", "decoded_sha256 string"]
                       + ["ids array<long>", "decoded binary"] * with_ids)

    def run(batches):
        bpe = opened(rank_file)
        table = Encoded(bpe.encode_words)
        for batch in batches:
            bodies = batch.column("body").to_pylist()
            n, enc, dec, all_ids, all_raw = [], [], [], [], []
            ids = encode_batch(bodies, table)
            raw = bpe.decode(ids)
            for x, y in zip(ids, raw, strict=True):
                n.append(len(x))
                enc.append(hashlib.sha256(x.astype("<u4").tobytes()).hexdigest())
                dec.append(hashlib.sha256(y).hexdigest())
                if with_ids:
                    all_ids.append(x.astype(np.int64))
                    all_raw.append(y)
            columns = [batch.column(i) for i in range(len(kept))] + [pa.array(n, pa.int64()), pa.array(enc, pa.string()), pa.array(dec, pa.string())]
            if with_ids:
                columns += [pa.array(all_ids, pa.list_(pa.int64())), pa.array(all_raw, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in schema.split(", ")])

    out = inner.mapInArrow(run, schema)
    return out.withColumnsRenamed({f"k{i}": c for i, c in enumerate(kept)})


__all__ = ["DuckBpe", "encode_decode", "opened"]
