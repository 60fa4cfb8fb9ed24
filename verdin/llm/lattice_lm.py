"""Language-model scores from a subword lattice, with corpus word counts.

The model reads a text as words (letters A-Z in lower case) and an end.  A word, with the vocabulary's
mark for a word's start before it, is spelled by the pieces of an existing vocabulary in every possible
way; each segmentation has the product of its pieces' probabilities, and forward recursion in log
space adds all of them up: the marginal probability of the word.  Pieces never cross words, so a
text's marginal probability is the product of its words' and of the end's.

Piece probabilities start from the vocabulary's own scores: as they are where they are log
probabilities; where they are merge ranks (whole numbers), by Zipf's law over the ranks.  ``rounds``
re-estimations follow: expected piece counts over all segmentations of all training words, by their
counts, with the first probabilities as a prior of ``strength`` pieces.  Pieces stay as they are.

A block of documents (the rows that a task reads one after another, some ``block_bytes`` each) asks once for
the figures of each of its distinct words and keeps its documents as sorted word numbers, so texts are split
once and never shuffled, equal rows are dealt like any others, the table of all words is joined once for each block and word, not for each
occurrence, and never leaves the executors.  Words are summed up in numpy, many at once; words of over
``LONG`` characters one by one, to the same values.  Null text: empty, the end alone.  Repeated rows each count.  Texts are scored whole,
however long.  An empty table gives no rows; other columns are never read.
"""

from __future__ import annotations

import math
import pickle

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verdin.llm.common import ship_package, stored

START = "▁"
LONG = 48           # characters of a word (with its mark) that are summed up in numpy
MANY = 200_000      # words handled at once


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(32))


class Pieces:
    """Places of pieces by rolling 64-bit hashes of their characters, in a few open tables: a hash that
    finds its cell taken goes to the next table, by other bits of it."""

    BASE = np.uint64(0x9E3779B97F4A7C15)

    def __init__(self, pieces: list[str]):
        self.widest = max(map(len, pieces), default=1)
        self.powers = np.cumprod(np.full(max(self.widest, LONG) + 2, self.BASE, np.uint64)) * np.uint64(pow(int(self.BASE), -1, 1 << 64))
        hashes = np.stack(self.prefixes(self.codes(pieces)))[np.fromiter(map(len, pieces), np.int64, len(pieces)), np.arange(len(pieces))]
        self.hashes, self.layers, left, shift = np.append(hashes, np.uint64(0)), [], np.arange(len(pieces)), 0
        bits = max(4, (4 * max(1, len(pieces))).bit_length())
        while len(left):
            cell = self._cell(hashes[left], shift, bits)
            table = np.full(1 << bits, len(pieces), np.int32)
            table[cell] = left
            self.layers.append((table, shift, bits))
            left = left[table[cell] != left]
            shift, bits = shift + 7, max(8, bits - 2)

    @staticmethod
    def _cell(h: np.ndarray, shift: int, bits: int) -> np.ndarray:
        return ((h >> np.uint64(shift)) & np.uint64((1 << bits) - 1)).astype(np.int64)

    @staticmethod
    def codes(words: list[str]) -> np.ndarray:
        """Characters (from 1) of words, a row a place, filled up with zeros."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        flat = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
        out = np.zeros((int(sizes.max(initial=0)), len(words)), np.uint32)
        which = np.repeat(np.arange(len(words)), sizes)
        out[np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes), which] = flat + 1
        return out

    def prefixes(self, codes: np.ndarray) -> list[np.ndarray]:
        total = np.zeros(codes.shape[1], np.uint64)
        out = [total]
        for row in codes:
            total = total * self.BASE + _mix(row.astype(np.uint64))
            out.append(total)
        return out

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """The place of each hash; the number of pieces where it is none."""
        none = len(self.hashes) - 1
        found = np.full(len(hashes), none, np.int32)
        for table, shift, bits in self.layers:
            place = table[self._cell(hashes, shift, bits)]
            hit = (self.hashes[place] == hashes) & (place < none)
            found[hit] = place[hit]
        return found


class Lattice:
    """Pieces with natural-log probabilities."""

    def __init__(self, pieces: dict[str, float], spelled: list[float], end: float, widest: int | None = None):
        """``spelled``: of the 256 byte pieces, for characters that are no piece."""
        self.pieces, self.spelled, self.end = pieces, spelled, end
        self.widest = widest or max(map(len, pieces), default=1)

    def _edges(self, s: str, j: int):
        """(start, log probability, piece) of the edges that end before character j."""
        get = self.pieces.get
        for i in range(max(0, j - self.widest), j):
            lp = get(s[i:j])
            if lp is not None:
                yield i, lp, s[i:j]
        if s[j - 1] not in self.pieces:
            yield j - 1, sum(self.spelled[b] for b in s[j - 1].encode()), None

    def forward(self, s: str) -> list[float]:
        alpha = [0.0]
        get, widest, pieces, exp, log1p = self.pieces.get, self.widest, self.pieces, math.exp, math.log1p
        for j in range(1, len(s) + 1):
            total = None
            for i in range(j - widest if j > widest else 0, j):
                lp = get(s[i:j])
                if lp is not None:
                    x = alpha[i] + lp
                    if total is None:
                        total = x
                    elif x > total:
                        total = x + log1p(exp(total - x))
                    else:
                        total += log1p(exp(x - total))
            if s[j - 1] not in pieces:
                x = alpha[j - 1] + sum(self.spelled[b] for b in s[j - 1].encode())
                total = x if total is None else max(x, total) + log1p(exp(-abs(x - total)))
            alpha.append(total)
        return alpha

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "_tables"}

    def tables(self):
        """(hash tables of the pieces, their log probabilities, the pieces)."""
        if "_tables" not in self.__dict__:
            names = list(self.pieces)
            self._tables = Pieces(names), np.array([self.pieces[p] for p in names]), names
        return self._tables

    def _sweep(self, words: list[str]):
        """Forward recursion of many words at once: (log alpha by place, edges by end), longest words first.  An
        edge (start, rows, log probability, piece) with piece -1 is a character spelled in bytes."""
        table, lp, _ = self.tables()
        codes = table.codes(words)
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        hashes = table.prefixes(codes)
        reach = np.searchsorted(-sizes, -np.arange(len(codes) + 1), "right")   # words of at least j characters
        spell = {int(c): sum(self.spelled[b] for b in chr(int(c) - 1).encode()) for c in np.unique(codes) if c}
        known = np.array(sorted(spell), np.uint32)
        cost = np.array([spell[int(c)] for c in known])
        alpha, edges = [np.zeros(len(words))], []
        for j in range(1, len(codes) + 1):
            n = int(reach[j])
            total, ending = np.full(n, -np.inf), []
            for i in range(max(0, j - table.widest), j):
                place = table.find(hashes[j][:n] - hashes[i][:n] * table.powers[j - i])
                rows = np.flatnonzero(place < len(lp))
                if i == j - 1:
                    bare = np.flatnonzero(place == len(lp))
                    if len(bare):
                        ending.append((i, bare, cost[np.searchsorted(known, codes[i][bare])], -1))
                if len(rows):
                    ending.append((i, rows, lp[place[rows]], place[rows]))
            for i, rows, weight, _ in ending:
                total[rows] = np.logaddexp(total[rows], alpha[i][rows] + weight)
            alpha.append(total)
            edges.append(ending)
        return alpha, edges, codes, sizes

    def _in_order(self, words: list[str]):
        """Places of the words by falling length, those too long for a sweep apart, as (sweeps of places, single places)."""
        sizes = np.fromiter(map(len, words), np.int64, len(words)) + 1
        order = np.argsort(-sizes, kind="stable")
        long = int((sizes > LONG).sum())
        return [order[x:x + MANY] for x in range(long, len(order), MANY)], order[:long]

    def marginals(self, words: list[str]) -> np.ndarray:
        """``word`` of each word."""
        out = np.zeros(len(words))
        sweeps, single = self._in_order(words)
        for at in sweeps:
            alpha, _, _, sizes = self._sweep([START + words[k] for k in at])
            out[at] = [alpha[n][k] for k, n in enumerate(sizes)]
        for k in single:
            out[k] = self.word(words[k])
        return out

    def expected_all(self, words: list[str], counts: np.ndarray, into: dict) -> None:
        """``expected`` of each word with its count."""
        sweeps, single = self._in_order(words)
        names = self.tables()[2]
        sums, bare = np.zeros(len(names)), {}
        for at in sweeps:
            alpha, edges, codes, sizes = self._sweep([START + words[k] for k in at])
            count, k = counts[at].astype(float), np.arange(len(at))
            beta = [np.full(len(at), -np.inf) for _ in range(len(codes) + 1)]
            whole = np.zeros(len(at))
            for n in np.unique(sizes):
                of = k[sizes == n]
                beta[n][of], whole[of] = 0.0, alpha[n][of]
            for j in range(len(codes), 0, -1):
                for i, rows, weight, place in edges[j - 1]:
                    x = weight + beta[j][rows]
                    beta[i][rows] = np.logaddexp(beta[i][rows], x)
                    p = np.exp(np.minimum(0.0, alpha[i][rows] + x - whole[rows])) * count[rows]
                    if isinstance(place, int):
                        for c, v in zip(*_totals(codes[i][rows], p), strict=True):
                            bare[c] = bare.get(c, 0.0) + v
                    else:
                        sums += np.bincount(place, weights=p, minlength=len(names))
        for k in np.flatnonzero(sums):
            into[names[k]] = into.get(names[k], 0.0) + float(sums[k])
        for c, v in bare.items():
            for b in chr(c - 1).encode():
                into[b] = into.get(b, 0.0) + v
        for k in single:
            self.expected(words[k], counts[k], into)

    def word(self, word: str) -> float:
        """Natural-log marginal probability of one word."""
        return self.forward(START + word)[-1]

    def expected(self, word: str, count: float, into: dict) -> None:
        """Add the expected piece counts of ``count`` occurrences; bytes under their numbers."""
        s = START + word
        alpha = self.forward(s)
        beta = [-math.inf] * len(s) + [0.0]
        whole = alpha[-1]
        for j in range(len(s), 0, -1):
            if beta[j] == -math.inf:
                continue
            for i, lp, piece in self._edges(s, j):
                x = lp + beta[j]
                beta[i] = x if beta[i] == -math.inf else max(x, beta[i]) + math.log1p(math.exp(-abs(x - beta[i])))
                p = math.exp(min(0.0, alpha[i] + x - whole)) * count
                if piece is not None:
                    into[piece] = into.get(piece, 0.0) + p
                else:
                    for b in s[i].encode():
                        into[b] = into.get(b, 0.0) + p


def _totals(keys: np.ndarray, values: np.ndarray):
    kinds, at = np.unique(keys, return_inverse=True)
    return kinds.tolist(), np.bincount(at, weights=values).tolist()


def from_vocabulary(path: str) -> Lattice:
    """The lattice of a sentencepiece model, from the scores in it."""
    import sentencepiece
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    n = sp.get_piece_size()
    score = {i: sp.get_score(i) for i in range(n) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))}
    if all(float(x).is_integer() for x in score.values()):   # merge ranks
        score = {i: -math.log(3.0 - x) for i, x in score.items()}
    # the end is as likely as the likeliest piece; all bytes together as the least likely one
    top, low = max(score.values()), min(score.values())
    total = math.log(sum(math.exp(x) for x in score.values()) + math.exp(top) + math.exp(low))
    return Lattice({sp.id_to_piece(i): x - total for i, x in score.items()}, [low - math.log(256) - total] * 256, top - total)


def _distinct(texts: pa.Array, weight: np.ndarray):
    """(distinct words, their occurrences by weight): words of ASCII lower case, cut at ASCII space."""
    texts = texts.take(pa.array(np.arange(len(texts))))   # a copy: ascii_lower misreads slices of arrays
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts.cast(pa.large_string()).fill_null("")))
    flat = lists.flatten()
    per = np.repeat(np.arange(len(texts)), np.diff(np.asarray(lists.offsets)))
    full = np.asarray(pc.binary_length(flat)) > 0
    coded = flat.filter(pa.array(full)).dictionary_encode()
    index, per = np.asarray(coded.indices, np.int64), per[full]
    return coded.dictionary, index, per, np.bincount(index, weights=weight[per], minlength=len(coded.dictionary))


class Block:
    """Documents as sorted numbers of the block's distinct words."""

    def __init__(self):
        self.ids, self.sizes, self.words, self.train, self.bytes = [], [], [], [], 0

    def add(self, batch: pa.RecordBatch) -> None:
        """A batch of doc_id, text, train."""
        for x in range(0, batch.num_rows, 2000):
            part = batch.slice(x, 2000)
            texts, train = part.column(1), np.asarray(part.column(2).cast(pa.int8()), np.float64)
            words, index, per, _ = _distinct(texts, train)
            self.ids.append(part.column(0))
            self.sizes.append(np.bincount(per, minlength=part.num_rows))
            self.words.append(pa.DictionaryArray.from_arrays(pa.array(index.astype(np.int32)), words.cast(pa.large_string())))
            self.train.append(train[per])
            self.bytes += int(pc.sum(pc.binary_length(texts)).as_py() or 0)

    def closed(self) -> tuple[pa.Array, np.ndarray, bytes]:
        """(distinct words, their training occurrences, the rest)."""
        joined = pa.chunked_array(self.words).unify_dictionaries()
        words = joined.chunk(0).dictionary
        index = np.concatenate([np.asarray(c.indices, np.int64) for c in joined.chunks])
        n = np.bincount(index, weights=np.concatenate(self.train), minlength=len(words)).astype(np.int64)
        sizes = np.concatenate(self.sizes)
        doc = np.repeat(np.arange(len(sizes)), sizes)
        index = np.sort(doc * len(words) + index) - doc * len(words)     # sorted inside each document
        step = np.diff(index, prepend=0)
        first = (np.cumsum(sizes) - sizes)[sizes > 0]
        step[first] = index[first]
        rest = {"ids": pa.chunked_array(self.ids).to_pylist(), "sizes": sizes, "step": [(step >> s & 255).astype(np.uint8) for s in (0, 8, 16, 24)]}
        return words, n, zstandard.ZstdCompressor(level=1).compress(pickle.dumps(rest))

    @staticmethod
    def opened(data: bytes) -> tuple[list, np.ndarray, np.ndarray]:
        """(ids, words of each document, numbers of the words)."""
        rest = pickle.loads(zstandard.ZstdDecompressor().decompress(data))
        step = sum(p.astype(np.int64) << s for p, s in zip(rest["step"], (0, 8, 16, 24), strict=True))
        total, sizes = np.concatenate([[0], np.cumsum(step)]), rest["sizes"]
        return rest["ids"], sizes, total[1:] - np.repeat(total[np.cumsum(sizes) - sizes], sizes)


def score(docs: DataFrame, vocabulary: str, train: Column, doc_id: str = "doc_id", text: str = "text", rounds: int = 1,
          strength: float = 1000.0, block_bytes: int = 24_000_000) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_tokens, n_known, train_tokens, base_score (add-one word
    unigram) and score (the lattice's), both log10.  ``train``: a condition on doc_id."""
    spark = docs.sparkSession
    ship_package(spark)
    rows = docs.select(docs[doc_id].cast("long").alias("doc_id"), F.coalesce(docs[text], F.lit("")).alias("text")) \
        .withColumn("train", F.coalesce(train, F.lit(False)))
    names = ["block", "word", "n", "at", "payload"]

    def rows_of(block: Block, name: str):
        words, n, rest = block.closed()
        for x in range(0, len(words), 200_000):
            k = len(words[x:x + 200_000])
            yield pa.RecordBatch.from_arrays([pa.array([name] * k, pa.string()), words.slice(x, k).cast(pa.string()), pa.array(n[x:x + k]),
                                              pa.array(np.arange(x, x + k, dtype=np.int32)), pa.nulls(k, pa.binary())], names=names)
        yield pa.RecordBatch.from_arrays([pa.array([name]), pa.nulls(1, pa.string()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.int32()),
                                          pa.array([rest], pa.binary())], names=names)

    def cut(batches):
        part, number, block = TaskContext.get().partitionId(), 0, Block()
        for batch in batches:
            for x in range(0, batch.num_rows, 2000):
                block.add(batch.slice(x, 2000))
                if block.bytes >= block_bytes:
                    yield from rows_of(block, f"{part}-{number}")
                    number, block = number + 1, Block()
        if block.ids:
            yield from rows_of(block, f"{part}-{number}")

    blocks = stored(rows.mapInArrow(cut, "block string, word string, n long, at int, payload binary"), "lm-blocks")
    asked = blocks.where("payload is null").select(F.col("block").alias("of"), "word", "n", "at")
    counts = stored(asked.groupBy("word").agg(F.sum("n").alias("c")), "counts")
    ends = rows.where("train").count()
    known = counts.where("c > 0").agg(F.count("*").alias("v"), F.coalesce(F.sum("c"), F.lit(0)).alias("n")).first()
    tokens, kinds = known["n"] + ends, known["v"] + (ends > 0)
    lattice = from_vocabulary(vocabulary)
    for _ in range(rounds):
        lattice = estimate(lattice, counts, ends, strength)
    shared = spark.sparkContext.broadcast(lattice)   # as large as the vocabulary

    def weigh(batches):
        for words, c in _joined(batches):
            yield pa.RecordBatch.from_arrays(
                [words, pa.array(c > 0), pa.array(np.log10((c + 1) / (tokens + kinds + 1))),
                 pa.array(shared.value.marginals(words.to_pylist()) / math.log(10))], names=["word", "known", "base", "marginal"])

    weights = stored(_spread(counts).mapInArrow(weigh, "word string, known boolean, base double, marginal double"), "weights")
    answers = asked.select("of", "at", "word").join(weights, "word").select("of", "at", "known", "base", "marginal")
    end_base, end_marginal, end_known = math.log10((ends + 1) / (tokens + kinds + 1)), lattice.end / math.log(10), int(ends > 0)

    def tell(left: pa.Table, right: pa.Table) -> pa.Table:
        ids, sizes, index = Block.opened(left.column("payload")[0].as_py())
        at, doc, sums = np.asarray(right.column("at"), np.int64), np.repeat(np.arange(len(sizes)), sizes), []
        for c in ("known", "base", "marginal"):
            value = np.full(int(index.max(initial=-1)) + 1, np.nan)
            value[at] = np.asarray(right.column(c).cast(pa.float64()))
            sums.append(np.bincount(doc, weights=value[index], minlength=len(sizes)))
        k, b, m = sums
        if not np.isfinite(k).all():
            raise RuntimeError("a word of the block has no figures")
        return pa.table({"doc_id": pa.array(ids, pa.int64()), "n_tokens": pa.array(sizes.astype(np.int64) + 1), "n_known": pa.array(np.rint(k).astype(np.int64) + end_known),
                         "train_tokens": pa.array(np.full(len(sizes), tokens, np.int64)), "base_score": pa.array(b + end_base), "score": pa.array(m + end_marginal)})

    held = blocks.where("payload is not null").select("block", "payload")
    return held.groupBy("block").cogroup(answers.groupBy("of")).applyInArrow(
        tell, "doc_id long, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def _joined(batches):
    """(words, counts) of runs of Arrow batches of about ``MANY`` rows."""
    held, rows = [], 0
    for batch in batches:
        held.append(batch)
        rows += batch.num_rows
        if rows >= MANY:
            yield _run(held)
            held, rows = [], 0
    if rows:
        yield _run(held)


def _run(held: list):
    table = pa.Table.from_batches(held)
    return table.column("word").combine_chunks(), np.asarray(table.column("c"), np.float64)


def _spread(df: DataFrame) -> DataFrame:
    """Deal rows of costly work over at least as many tasks as the session shuffles into."""
    return df.repartition(max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1))


def estimate(lattice: Lattice, counts: DataFrame, ends: int, strength: float) -> Lattice:
    """One round of expectation and maximisation over all counted words (word, c)."""
    shared = counts.sparkSession.sparkContext.broadcast(lattice)

    def expect(batches):
        into: dict = {}
        for words, c in _joined(batches):
            shared.value.expected_all(words.to_pylist(), c, into)
        if into:
            yield pa.RecordBatch.from_arrays(
                [pa.array([k if isinstance(k, str) else None for k in into], pa.string()),
                 pa.array([k if isinstance(k, int) else None for k in into], pa.int32()), pa.array(list(into.values()), pa.float64())],
                names=["piece", "byte", "n"])

    sums = _spread(counts.where("c > 0")).mapInArrow(expect, "piece string, byte int, n double") \
        .groupBy("piece", "byte").agg(F.sum("n").alias("n")).collect()   # as many rows as the vocabulary at most
    got = {r["piece"] if r["piece"] is not None else r["byte"]: r["n"] for r in sums}
    total = math.log(sum(got.values()) + ends + strength)
    new = lambda key, lp: math.log(got.get(key, 0.0) + strength * math.exp(lp)) - total
    return Lattice({p: new(p, lp) for p, lp in lattice.pieces.items()}, [new(b, lp) for b, lp in enumerate(lattice.spelled)],
                   math.log(ends + strength * math.exp(lattice.end)) - total, lattice.widest)
