"""Language identification: a bidirectional gated recurrent network over bytes, in numpy.

A text's bytes are read in windows of ``WINDOW`` from its first byte to its last.  Two GRUs run over a
window in either direction; a linear layer on both states labels every position, and the softmax
of all positions of a document is averaged into its language probabilities.  The network is
trained on the driver by backpropagation through time, on excerpts of a bounded, documented sample:
about ``docs_a_language`` texts of each language, chosen by the hash of their id, whatever the
table's size.

Null texts, and texts without a letter, get ``und`` with score 0; without any labelled text every
row is ``und``.  Language names, ids and sources are never inputs of a prediction.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verdin.llm.common import ship_package

WINDOW = 256
_LETTER = regex.compile(r"\p{L}")


def _sigmoid(x):
    return 0.5 * (1 + np.tanh(0.5 * x))


class Gru:
    """One direction: update z, reset r, candidate n; h' = (1 - z) n + z h."""

    def __init__(self, rng, hidden: int):
        s = 1 / np.sqrt(hidden)
        self.p = {"wx": rng.normal(0, 0.3, (256, 3 * hidden)), "u": rng.normal(0, s, (hidden, 3 * hidden)),
                  "bn": np.zeros(hidden)}
        self.hidden = hidden

    def forward(self, steps: np.ndarray):
        """steps: (T, B) bytes.  States of all steps, and what backward needs."""
        h, size = np.zeros((steps.shape[1], self.hidden)), self.hidden
        states, saved = [], []
        for x in steps:
            gx, gh = self.p["wx"][x], h @ self.p["u"]
            zr = _sigmoid(gx[:, :2 * size] + gh[:, :2 * size])
            z, r = zr[:, :size], zr[:, size:]
            inner = gh[:, 2 * size:] + self.p["bn"]
            n = np.tanh(gx[:, 2 * size:] + r * inner)
            saved.append((x, h, z, r, inner, n))
            h = n + z * (h - n)
            states.append(h)
        return np.stack(states), saved

    def backward(self, saved, grads: np.ndarray) -> dict:
        """Gradients through time, given those of the states."""
        out = {k: np.zeros_like(v) for k, v in self.p.items()}
        dh = np.zeros_like(grads[0])
        for (x, h, z, r, inner, n), g in zip(reversed(saved), reversed(grads), strict=True):
            dh = dh + g
            dn = dh * (1 - z) * (1 - n * n)
            dz = dh * (h - n) * z * (1 - z)
            dr = dn * inner * r * (1 - r)
            gate = np.concatenate([dz, dr, dn], axis=1)
            gate_h = np.concatenate([dz, dr, dn * r], axis=1)
            np.add.at(out["wx"], x, gate)
            out["u"] += h.T @ gate_h
            out["bn"] += (dn * r).sum(axis=0)
            dh = dh * z + gate_h @ self.p["u"].T
        return out


class BiGru:
    def __init__(self, languages: list[str], hidden: int = 10, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.languages, self.hidden = languages, hidden
        self.ahead, self.back = Gru(rng, hidden), Gru(rng, hidden)
        self.head = {"w": rng.normal(0, 0.1, (2 * hidden, len(languages))), "c": np.zeros(len(languages))}

    def gradients(self, steps: np.ndarray, label: np.ndarray):
        """Mean cross-entropy over all positions of (T, B) bytes, and its gradients."""
        a, sa = self.ahead.forward(steps)
        b, sb = self.back.forward(steps[::-1])
        both = np.concatenate([a, b[::-1]], axis=2)
        logits = both @ self.head["w"] + self.head["c"]
        logits -= logits.max(axis=2, keepdims=True)
        prob = np.exp(logits)
        prob /= prob.sum(axis=2, keepdims=True)
        t, n = steps.shape
        right = prob[:, np.arange(n), label]
        d = prob.copy()
        d[:, np.arange(n), label] -= 1
        d /= t * n
        grad = {"head": {"w": np.einsum("tbh,tbc->hc", both, d), "c": d.sum(axis=(0, 1))}}
        ds = d @ self.head["w"].T
        grad["ahead"] = self.ahead.backward(sa, ds[:, :, :self.hidden])
        grad["back"] = self.back.backward(sb, ds[::-1, :, self.hidden:])
        return float(-np.log(np.maximum(right, 1e-12)).mean()), grad

    def parameters(self):
        return {"head": self.head, "ahead": self.ahead.p, "back": self.back.p}

    def train(self, excerpts: list[bytes], labels: list[int], steps: int = 220, batch: int = 64, length: int = 48,
              rate: float = 0.02, seed: int = 11) -> list[float]:
        """Adam over random windows of the excerpts, languages drawn alike often."""
        rng = np.random.default_rng(seed)
        by = [[x for x, y in zip(excerpts, labels, strict=True) if y == k and x] for k in range(len(self.languages))]
        if not all(by):
            raise ValueError("each language needs an excerpt that is not empty")
        m = {k: {p: np.zeros_like(v) for p, v in d.items()} for k, d in self.parameters().items()}
        v = {k: {p: np.zeros_like(x) for p, x in d.items()} for k, d in self.parameters().items()}
        losses = []
        for step in range(1, steps + 1):
            y = rng.integers(0, len(by), batch)
            rows = []
            for k in y:
                x = by[k][rng.integers(len(by[k]))]
                x = x * (-(-length // len(x))) if len(x) < length else x
                at = rng.integers(0, len(x) - length + 1)
                rows.append(np.frombuffer(x[at:at + length], np.uint8))
            loss, grad = self.gradients(np.stack(rows, axis=1), y)
            losses.append(loss)
            slow = rate * min(1.0, 2 * (1 - (step - 1) / steps))
            for k, d in self.parameters().items():
                for p in d:
                    g = np.clip(grad[k][p], -1, 1)
                    m[k][p] = 0.9 * m[k][p] + 0.1 * g
                    v[k][p] = 0.98 * v[k][p] + 0.02 * g * g
                    d[p] -= slow * (m[k][p] / (1 - 0.9 ** step)) / (np.sqrt(v[k][p] / (1 - 0.98 ** step)) + 1e-8)
        return losses

    def frozen(self) -> Frozen:
        return Frozen(self)


class Frozen:
    """Single-precision weights and inference over many windows at once."""

    def __init__(self, model: BiGru):
        f = np.float32
        self.languages, self.hidden = model.languages, model.hidden
        self.cells = []
        for cell in (model.ahead, model.back):
            size = cell.hidden
            scale = np.concatenate([np.full(2 * size, 0.5), np.ones(size)])   # sigmoid(x) = (1 + tanh(x / 2)) / 2
            self.cells.append(((cell.p["wx"] * scale).astype(f), np.ascontiguousarray((cell.p["u"] * scale).T.astype(f)),
                               cell.p["bn"].astype(f)[:, None]))
        self.w, self.c = np.ascontiguousarray(model.head["w"].T.astype(f)), model.head["c"].astype(f)[:, None]

    def _states(self, cell, steps, valid):
        wx, u, bn = cell
        size, n = self.hidden, steps.shape[1]
        out = np.empty((len(steps), size, n), np.float32)
        h, gates = np.zeros((size, n), np.float32), np.empty((3 * size, n), np.float32)
        for t, x in enumerate(steps):
            gx = wx[x].T
            np.matmul(u, h, out=gates)
            zr = gates[:2 * size]
            zr += gx[:2 * size]
            np.tanh(zr, out=zr)
            zr += 1
            zr *= np.float32(0.5)
            new = gates[2 * size:]
            new += bn
            new *= zr[size:]
            new += gx[2 * size:]
            np.tanh(new, out=new)
            h = np.subtract(h, new, out=out[t])
            h *= zr[:size]
            h += new
            if valid is not None:
                h *= valid[t]
        return out

    def positions(self, windows: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Probabilities (T, languages, B) of every position of (B, T) bytes, zero beyond ``sizes``."""
        steps = np.ascontiguousarray(windows.T)
        valid = None if (sizes == windows.shape[1]).all() else (np.arange(len(steps))[:, None] < sizes).astype(np.float32)
        a = self._states(self.cells[0], steps, valid)
        b = self._states(self.cells[1], steps[::-1], None if valid is None else valid[::-1])[::-1]
        logits = np.matmul(self.w[:, :self.hidden], a) + np.matmul(self.w[:, self.hidden:], b) + self.c
        logits -= logits.max(axis=1, keepdims=True)
        np.exp(logits, out=logits)
        logits /= logits.sum(axis=1, keepdims=True)
        if valid is not None:
            logits *= valid[:, None, :]
        return logits

    def documents(self, texts: list[bytes], windows_at_once: int = 1024) -> np.ndarray:
        """Mean probabilities (documents, languages) over all positions; zero for empty texts."""
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        number = -(-sizes // WINDOW)
        doc = np.repeat(np.arange(len(texts)), number)
        first = (np.arange(len(doc)) - np.repeat(np.cumsum(number) - number, number)) * WINDOW
        size = np.minimum(WINDOW, sizes[doc] - first)
        start = (np.cumsum(sizes) - sizes)[doc] + first
        flat = np.frombuffer(b"".join(texts) + bytes(WINDOW), np.uint8)
        total = np.zeros((len(texts), len(self.languages)))
        order = np.argsort(size, kind="stable")   # windows of like size together, cut to the longest
        for a in range(0, len(order), windows_at_once):
            at = order[a:a + windows_at_once]
            wide = int(size[at].max())
            some = flat[start[at][:, None] + np.arange(wide)]
            np.add.at(total, doc[at], self.positions(some, size[at]).sum(axis=0, dtype=np.float64).T)
        return total / np.maximum(sizes, 1)[:, None]


def training_sample(docs: DataFrame, train: Column, docs_a_language: int = 250, excerpt_chars: int = 400,
                    doc_id: str = "doc_id", text: str = "text", lang: str = "lang"):
    """(languages, excerpts, labels): of each language about ``docs_a_language`` texts at most, those
    of the smallest id hash, and of each an excerpt at a place set by that hash."""
    rows = docs.select(docs[doc_id].alias("i"), docs[lang].cast("string").alias("l"), docs[text].alias("t")) \
        .where(train & F.col("l").isNotNull() & F.col("t").rlike(r"\p{L}"))
    known = {r["l"]: r["n"] for r in rows.groupBy("l").agg(F.count("*").alias("n")).collect()}
    if not known:
        return [], [], []
    share = F.create_map(*[F.lit(x) for l, n in sorted(known.items()) for x in (l, min(1.0, 1.5 * docs_a_language / n))])
    h = F.xxhash64(F.col("i"), F.length("t"))
    place = F.pmod(F.shiftrightunsigned(h, 8), F.greatest(F.length("t") - excerpt_chars, F.lit(0)) + 1)
    picked = rows.withColumn("h", h).where(F.pmod("h", F.lit(1 << 20)) < F.element_at(share, F.col("l")) * (1 << 20)) \
        .select("l", "h", F.col("t").substr((place + 1).cast("int"), F.lit(excerpt_chars)).alias("x")).collect()
    languages = sorted({r["l"] for r in picked})
    excerpts, labels = [], []
    for k, name in enumerate(languages):
        of = sorted((r for r in picked if r["l"] == name), key=lambda r: (r["h"] % (1 << 20), r["h"]))
        for r in of[:docs_a_language]:
            excerpts.append(r["x"].encode())
            labels.append(k)
    return languages, excerpts, labels


def fit(docs: DataFrame, train: Column, hidden: int = 10, **options) -> Frozen | None:
    """A trained network, or None when no text of ``train`` rows (a condition on i, the id) has a language."""
    languages, excerpts, labels = training_sample(docs, train, **options)
    if not languages:
        return None
    model = BiGru(languages, hidden)
    if len(languages) > 1:
        model.train(excerpts, labels)
    return model.frozen()


def predict(docs: DataFrame, model: Frozen | None, text: str = "text", keep: tuple = ("doc_id",)) -> DataFrame:
    """The columns ``keep`` of every row, lang_pred and score (the mean probability of lang_pred)."""
    ship_package(docs.sparkSession)
    inner = docs.select(*[docs[c].alias(f"k{i}") for i, c in enumerate(keep)], docs[text].alias("body"))
    schema = ", ".join([f"k{i} {inner.schema[f'k{i}'].dataType.simpleString()}" for i in range(len(keep))] + ["lang_pred string", "score double"])
    shared = docs.sparkSession.sparkContext.broadcast(model)   # a few thousand weights

    def run(batches):
        net = shared.value
        for batch in batches:
            texts = batch.column("body").to_pylist()
            name, score = ["und"] * len(texts), [0.0] * len(texts)
            at = [i for i, t in enumerate(texts) if net is not None and t and _LETTER.search(t)]
            for a, b in _portions([len(texts[i]) for i in at]):
                part = at[a:b]
                prob = net.documents([texts[i].encode() for i in part])
                best = prob.argmax(axis=1)
                for i, k, p in zip(part, best, prob, strict=True):
                    name[i], score[i] = net.languages[k], float(min(1.0, p[k]))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(name, pa.string()), pa.array(score, pa.float64())],
                                             names=[c.split()[0] for c in schema.split(", ")])

    return inner.mapInArrow(run, schema).withColumnsRenamed({f"k{i}": c for i, c in enumerate(keep)})


def keep_identified(docs: DataFrame, model: Frozen | None, text: str = "text") -> DataFrame:
    """The rows of ``docs`` whose language the model names: ``und`` goes."""
    names = docs.columns
    plain = docs.toDF(*[f"c{i}" for i in range(len(names))])
    got = predict(plain, model, f"c{names.index(text)}", keep=tuple(plain.columns))
    return got.where("lang_pred <> 'und'").select(*[F.col(f"c{i}").alias(n) for i, n in enumerate(names)])


def _portions(sizes: list[int], most: int = 4_000_000):
    a, held = 0, 0
    for i, n in enumerate(sizes):
        if i > a and held + n > most:
            yield a, i
            a, held = i, 0
        held += n
    if a < len(sizes):
        yield a, len(sizes)
