"""Alignment of the tokens of two tokenizers by pointer jumping.

Both token sequences of a text are cut from the same bytes.  Every token points to its farthest-right
overlapping token: a token of the second tokenizer to the first's token over its last byte, a token of
the first to the second's token over its last byte where that one goes on beyond it, else to itself.
Replacing each pointer by its successor's pointer, for all tokens at once, doubles the reach until all
stand on the last token of their component; that token names the group.  Groups end where tokens of
both end.

Tokens a and b are linked in a text where they share a group.  How many documents hold a pair is counted over
the whole corpus: each block of documents asks once for each of its pairs, by a shuffle on the pair, so
frequent pairs cost a row a block and not a row a document, and nothing of the corpus passes the
driver.  Only the highest count of each id of the first tokenizer is broadcast: as many rows at most as
its vocabulary has.

Null and empty texts, and texts whose tokens do not give the bytes of blank + text back (such as those with U+2581,
which the second tokenizer takes for a blank), have no tokens: zeros.  Repeated rows each count as a
document.  A text is handled whole, however long.  An empty table gives no rows; other columns are
never read.  Ties for the highest count all count as best.
"""

from __future__ import annotations

import hashlib
import pickle
from itertools import chain

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from verdin.llm.common import ship_package, stored
from verdin.llm.pretoken import Encoded, blocks_of, split_texts

_TOKENIZERS: dict = {}


class Side:
    """One tokenizer: the ids of whole texts, and the bytes of each id."""

    def __init__(self, split, encode, pieces: list[bytes], most: int):
        self.split, self.table = split, Encoded(encode, most)
        sizes = np.array([len(p) for p in pieces], np.int64)
        self.flat, self.sizes, self.starts = np.frombuffer(b"".join(pieces), np.uint8), sizes, np.cumsum(sizes) - sizes
        digits = [str(i).encode() for i in range(len(pieces))]
        self.width = np.array([len(x) for x in digits], np.int64)
        self.digits = np.zeros((len(pieces), int(self.width.max()) + 1), np.uint8)
        for i, x in enumerate(digits):
            self.digits[i, :len(x)] = list(x)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, how many each has)."""
        tokens, counts = self.split(texts)
        numbers = self.table.numbers(tokens)
        per = np.concatenate([[0], np.cumsum(self.table.sizes[numbers])])
        return self.table.ids(numbers).astype(np.int64), np.diff(per[np.concatenate([[0], np.cumsum(counts)])])

    def joined(self, ids: np.ndarray) -> np.ndarray:
        size = self.sizes[ids]
        shift = np.repeat(self.starts[ids] - (np.cumsum(size) - size), size)
        return self.flat[np.arange(int(size.sum())) + shift]


def _byte_of_character() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable ones for themselves, the others by
    characters from 256 on, in order."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(sorted({*range(256)} - {*own}))}


def _byte_level(path: str, most: int) -> Side:
    import os
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer
    tok = Tokenizer.from_file(path)
    tok.encode_special_tokens = True   # their strings in a text are plain text
    byte = _byte_of_character()
    vocabulary = tok.get_vocab(with_added_tokens=True)
    pieces = [b""] * (max(vocabulary.values()) + 1)
    for piece, i in vocabulary.items():
        pieces[i] = bytes(byte[c] for c in piece) if all(c in byte for c in piece) else piece.encode()

    def encode(words: list[bytes]):
        got = [e.ids for e in tok.encode_batch_fast([w.decode() for w in words], add_special_tokens=False)]
        sizes = np.fromiter(map(len, got), np.int64, len(got))
        return np.fromiter(chain.from_iterable(got), np.uint32, int(sizes.sum())), sizes

    return Side(split_texts, encode, pieces, most)


def split_blanks(texts: list[str]) -> tuple[pa.Array, np.ndarray]:
    """As ``split_texts``, before each run of blanks (or of U+2581): where no piece of the vocabulary has a
    blank after another character, no merge crosses these cuts."""
    joined = "".join(texts)
    codes = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    blank = (codes == 0x20) | (codes == 0x2581)
    start = blank.copy()
    start[1:] &= ~blank[:-1]
    start[(np.cumsum(sizes) - sizes)[sizes > 0]] = True
    data = joined.encode()
    width = 1 + (codes > 0x7F).astype(np.int64) + (codes > 0x7FF) + (codes > 0xFFFF)
    at = np.flatnonzero(start)
    offsets = np.append((np.cumsum(width) - width)[at], len(data))
    tokens = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(at), [None, pa.py_buffer(offsets), pa.py_buffer(data)])
    seen = np.concatenate([[0], np.cumsum(start)])
    ends = np.cumsum(sizes)
    return tokens, seen[ends] - seen[ends - sizes]


def _with_blank(path: str, most: int) -> Side:
    import sentencepiece
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    n, mark = sp.get_piece_size(), "▁"
    names = [sp.id_to_piece(i) for i in range(n)]
    pieces = [bytes([int(p[3:5], 16)]) if sp.is_byte(i) else p.replace(mark, " ").encode() for i, p in enumerate(names)]
    alone = [sp.piece_to_id(mark)]
    apart = not any(mark in p.lstrip(mark) for p in names)

    def encode(words: list[bytes]):
        # the library adds the first blank, but to no empty text
        got = [g or alone for g in sp.encode([w.decode()[1:] for w in words], num_threads=1)]
        sizes = np.fromiter(map(len, got), np.int64, len(got))
        return np.fromiter(chain.from_iterable(got), np.uint32, int(sizes.sum())), sizes

    def whole(texts: list[str]):
        data = [t.encode() for t in texts]
        offsets = np.cumsum([0, *map(len, data)])
        tokens = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(texts), [None, pa.py_buffer(offsets), pa.py_buffer(b"".join(data))])
        return tokens, np.ones(len(texts), np.int64)

    return Side(split_blanks if apart else whole, encode, pieces, most)


def sides(first: str, second: str, most: int = 300_000) -> tuple[Side, Side]:
    """Both tokenizers, loaded once a worker."""
    key = (first, second)
    if key not in _TOKENIZERS:
        _TOKENIZERS.clear()
        _TOKENIZERS[key] = _byte_level(first, most), _with_blank(second, most)
    return _TOKENIZERS[key]


def groups(end_a: np.ndarray, end_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(group of each first token, group of each second token), numbered from 0 in order, from the rising ends
    of the tokens of the same bytes."""
    n = len(end_a)
    over = np.searchsorted(end_b, end_a)     # the second's token over the last byte of each first token
    on = np.arange(n)
    pointer = np.concatenate([np.where(end_b[over] > end_a, n + over, on) if n else on, np.searchsorted(end_a, end_b)])
    while True:
        further = pointer[pointer]
        if np.array_equal(further, pointer):
            break
        pointer = further
    number = np.cumsum(pointer[:n] == on) - 1
    named = number[pointer]
    return named[:n], named[n:]


def _linked(group: np.ndarray, ids: np.ndarray, vocabulary: int):
    """(group, id, occurrences) of the distinct ids of each group."""
    key, n = np.unique(group * vocabulary + ids, return_counts=True)
    return key // vocabulary, key % vocabulary, n


def pairs_of(doc_of_group: np.ndarray, group_a, ids_a, group_b, ids_b, va: int, vb: int, most: int = 4_000_000):
    """(document, a * vb + b, links) of the distinct linked pairs of each document, in order."""
    ga, a, na = _linked(group_a, ids_a, va)
    gb, b, nb = _linked(group_b, ids_b, vb)
    several = np.bincount(gb, minlength=len(doc_of_group))
    first = np.cumsum(several) - several
    out, span = [], vb * va
    upto = np.cumsum(several[ga])
    x = 0
    while x < len(ga):   # slices of bounded numbers of pairs
        y = max(x + 1, int(np.searchsorted(upto, (upto[x - 1] if x else 0) + most, "right")))
        k = several[ga[x:y]]
        which = np.repeat(np.arange(x, y), k)
        other = np.arange(int(k.sum())) - np.repeat(np.cumsum(k) - k, k) + first[ga[which]]
        out.append(_summed(doc_of_group[ga[which]] * span + a[which] * vb + b[other], na[which] * nb[other]))
        x = y
    if not out:
        return (np.zeros(0, np.int64),) * 3
    key, n = _summed(*map(np.concatenate, zip(*out, strict=True))) if len(out) > 1 else out[0]
    return key // span, key % span, n


def _summed(key: np.ndarray, n: np.ndarray):
    order = np.argsort(key, kind="stable")
    key = key[order]
    at = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    return key[at], np.add.reduceat(n[order], at) if len(at) else n


def _written(side: Side, ids: np.ndarray, mark: np.ndarray):
    """Rows of decimal digits, each with its mark behind (0: none), and their widths."""
    text = side.digits[ids]
    text[np.arange(len(ids)), side.width[ids]] = mark
    return text, side.width[ids] + (mark > 0)


def aligned(texts: list, a: Side, b: Side):
    """For a run of texts: (n_a, n_b, n_groups, n_links, digest) of each, and the arrays of ``pairs_of``."""
    n = len(texts)
    spaced = [" " + t if t else "" for t in texts]
    size = np.array([len(t.encode()) for t in spaced], np.int64)
    got = []
    for side in (a, b):
        ids, counts = side.encode(spaced)
        doc = np.repeat(np.arange(n), counts)
        total = np.bincount(doc, weights=side.sizes[ids], minlength=n).astype(np.int64)
        got.append((ids, counts, doc, total))
    fine = (size > 0) & (got[0][3] == size) & (got[1][3] == size)
    plain = np.frombuffer("".join(t for t, f in zip(spaced, fine, strict=True) if f).encode(), np.uint8)
    doc_of_byte = np.repeat(np.flatnonzero(fine), size[fine])
    for side, (ids, _, doc, _) in zip((a, b), got, strict=True):
        wrong = side.joined(ids[fine[doc]]) != plain
        fine[doc_of_byte[wrong]] = False
    (ia, da), (ib, db) = ((ids[fine[doc]], doc[fine[doc]]) for ids, _, doc, _ in got)
    ga, gb = groups(np.cumsum(a.sizes[ia]), np.cumsum(b.sizes[ib]))
    many = int(ga[-1]) + 1 if len(ga) else 0
    ends = np.flatnonzero(np.concatenate([ga[1:] != ga[:-1], [True]])) if many else np.zeros(0, np.int64)
    doc_of_group = da[ends]
    in_a, in_b = np.bincount(ga, minlength=many), np.bincount(gb, minlength=many)
    n_groups = np.bincount(doc_of_group, minlength=n)
    n_links = np.zeros(n, np.int64)
    np.add.at(n_links, doc_of_group, in_a * in_b)
    # the written groups: first tokens of a group, then second ones
    mark_a, mark_b = np.full(len(ia), ord(","), np.uint8), np.full(len(ib), ord(","), np.uint8)
    mark_a[ends] = ord("|")
    last = np.cumsum(in_b) - 1
    mark_b[last] = ord(";")
    if many:
        mark_b[last[np.concatenate([doc_of_group[1:] != doc_of_group[:-1], [True]])]] = 0
    before_b, upto_a = np.concatenate([[0], np.cumsum(in_b)]), np.cumsum(in_a)
    place_a, place_b = np.arange(len(ia)) + before_b[ga], np.arange(len(ib)) + upto_a[gb]
    wide = max(a.digits.shape[1], b.digits.shape[1])
    text, length, doc = np.zeros((len(ia) + len(ib), wide), np.uint8), np.zeros(len(ia) + len(ib), np.int64), np.zeros(len(ia) + len(ib), np.int64)
    for side, ids, mark, place, of in ((a, ia, mark_a, place_a, da), (b, ib, mark_b, place_b, db)):
        rows, length[place] = _written(side, ids, mark)
        text[place, :rows.shape[1]] = rows
        doc[place] = of
    body = text[np.arange(wide) < length[:, None]].tobytes()
    cut = np.concatenate([[0], np.cumsum(np.bincount(doc, weights=length, minlength=n).astype(np.int64))])
    digest = [hashlib.sha256(body[x:y]).hexdigest() if y > x else "" for x, y in zip(cut[:-1], cut[1:], strict=True)]
    figures = np.bincount(da, minlength=n), np.bincount(db, minlength=n), n_groups, n_links
    return figures, digest, pairs_of(doc_of_group, ga, ia, gb, ib, len(a.sizes), len(b.sizes))


class Block:
    """Results of a run of documents, and for each document its distinct pairs as places in the block's list of pairs."""

    def __init__(self):
        self.ids, self.figures, self.digests, self.sizes, self.keys, self.links, self.chars = [], [], [], [], [], [], 0

    def add(self, ids: list, texts: list, a: Side, b: Side) -> None:
        figures, digest, (doc, key, links) = aligned(texts, a, b)
        self.ids += ids
        self.figures.append(np.stack(figures, axis=1))
        self.digests += digest
        self.sizes.append(np.bincount(doc, minlength=len(ids)))
        self.keys.append(key)
        self.links.append(links)
        self.chars += sum(len(t) if t else 0 for t in texts)

    def closed(self) -> tuple[np.ndarray, np.ndarray, bytes]:
        """(pairs, documents that hold each, the rest)."""
        keys = np.concatenate(self.keys)
        pairs, place, n = np.unique(keys, return_inverse=True, return_counts=True)
        sizes = np.concatenate(self.sizes)
        step = np.diff(place, prepend=0)                  # small inside a document, whose pairs rise
        first = (np.cumsum(sizes) - sizes)[sizes > 0]
        step[first] = place[first]
        links = np.concatenate(self.links)
        rest = {"ids": self.ids, "figures": np.concatenate(self.figures), "digests": self.digests, "sizes": sizes,
                "step": [(step >> s & 255).astype(np.uint8) for s in (0, 8, 16, 24)],
                "few": np.minimum(links, 255).astype(np.uint8), "many": links[links >= 255]}
        return pairs, n, zstandard.ZstdCompressor(level=1).compress(pickle.dumps(rest))

    @staticmethod
    def opened(data: bytes) -> dict:
        rest = pickle.loads(zstandard.ZstdDecompressor().decompress(data))
        step = sum(p.astype(np.int64) << s for p, s in zip(rest["step"], (0, 8, 16, 24), strict=True))
        sizes = rest["sizes"]
        total = np.cumsum(step)
        first = np.cumsum(sizes) - sizes
        before = np.repeat(np.concatenate([[0], total])[first], sizes)
        links = rest["few"].astype(np.int64)
        links[links == 255] = rest["many"]
        return rest | {"place": total - before, "links": links, "doc": np.repeat(np.arange(len(sizes)), sizes)}


RESULT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def align(docs: DataFrame, first: str, second: str, doc_id: str = "doc_id", text: str = "text",
          block_chars: int = 16_000_000, run_chars: int = 500_000) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_a, n_b, n_groups, n_links, n_best (links whose pair is held by as many
    documents as any pair of its first id), count_sum (documents that hold the pair, over links), groups_sha256.
    ``first``: a byte-level vocabulary of the tokenizers library; ``second``: a sentencepiece model.
    A block closes at ``block_chars``, its texts are aligned in runs of ``run_chars`` (one text at least)."""
    spark = docs.sparkSession
    ship_package(spark)
    names = ["block", "pair", "n", "at", "payload"]

    def rows_of(block: Block, name: str):
        pairs, n, rest = block.closed()
        for x in range(0, len(pairs), 200_000):
            k = len(pairs[x:x + 200_000])
            yield pa.RecordBatch.from_arrays([pa.array([name] * k, pa.string()), pa.array(pairs[x:x + k]), pa.array(n[x:x + k].astype(np.int64)),
                                              pa.array(np.arange(x, x + k, dtype=np.int32)), pa.nulls(k, pa.binary())], names=names)
        yield pa.RecordBatch.from_arrays([pa.array([name]), pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.int32()),
                                          pa.array([rest], pa.binary())], names=names)

    def cut(batches):
        a, b = sides(first, second)
        part, number, block = TaskContext.get().partitionId(), 0, Block()
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for x, y in blocks_of(texts, run_chars):
                block.add(ids[x:y], texts[x:y], a, b)
                if block.chars >= block_chars:
                    yield from rows_of(block, f"{part}-{number}")
                    number, block = number + 1, Block()
        if block.ids:
            yield from rows_of(block, f"{part}-{number}")

    base = docs.select(docs[doc_id].cast("long").alias("doc_id"), docs[text].alias("text"))
    blocks = stored(base.mapInArrow(cut, "block string, pair long, n long, at int, payload binary"), "align-blocks")
    asked = blocks.where("payload is null").select(F.col("block").alias("of"), "pair", "n", "at")
    counts = stored(asked.groupBy("pair").agg(F.sum("n").alias("count")), "align-counts")
    vb = _second_size(second)
    id_a = F.expr(f"pair div {vb}")
    best = counts.groupBy(id_a.alias("a")).agg(F.max("count").alias("highest"))   # at most the first vocabulary's ids
    judged = counts.withColumn("a", id_a).join(F.broadcast(best), "a").select("pair", "count", (F.col("count") == F.col("highest")).alias("is_best"))
    answers = asked.select("of", "at", "pair").join(judged, "pair").select("of", "at", "count", "is_best")

    def tell(left: pa.Table, right: pa.Table) -> pa.Table:
        fields = pa.schema([(c.split()[0], pa.string() if c.endswith("string") else pa.int64()) for c in RESULT.split(", ")])
        if not left.num_rows:
            return fields.empty_table()
        rest = Block.opened(left.column("payload")[0].as_py())
        at = np.asarray(right.column("at"), np.int64)
        count, is_best = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
        count[at], is_best[at] = np.asarray(right.column("count")), np.asarray(right.column("is_best")).astype(np.int64)
        n = len(rest["ids"])
        n_best, count_sum = np.zeros(n, np.int64), np.zeros(n, np.int64)
        np.add.at(n_best, rest["doc"], rest["links"] * is_best[rest["place"]])
        np.add.at(count_sum, rest["doc"], rest["links"] * count[rest["place"]])
        columns = [pa.array(rest["ids"], pa.int64()), *(pa.array(rest["figures"][:, k].astype(np.int64)) for k in range(4)),
                   pa.array(n_best), pa.array(count_sum), pa.array(rest["digests"], pa.string())]
        return pa.Table.from_arrays(columns, schema=fields)

    held = blocks.where("payload is not null").select("block", "payload")
    return held.groupBy("block").cogroup(answers.groupBy("of")).applyInArrow(tell, RESULT)


def _second_size(path: str) -> int:
    import sentencepiece
    return sentencepiece.SentencePieceProcessor(model_file=path).get_piece_size()
