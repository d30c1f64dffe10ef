"""Toxicity scores from a bidirectional gated recurrent network with attention pooling, trained in numpy.

A word enters as its own embedding, and by its letters: the embedding of its first letters and the mean of embeddings
of its letter trigrams, so unseen and altered words have an input too. The network reads windows of words that overlap by half; a document scores as its worst window.
Training is multiple-instance: a document's label reaches the window that the model finds worst.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import portions
from .common import alone, give_back, held_out, learns, parts, ship, unused

FOLDS = 5
#: Bounds of what is learned from: labelled documents of each class; words and word beginnings with an embedding
#: of their own.
TOXIC_DOCS, CLEAN_DOCS, MAX_WORDS, MAX_STEMS = 1500, 3000, 30_000, 20_000
#: Letters of a training document that are read; documents that a word or beginning must have.
TRAIN_LETTERS, LEAST_DOCS = 100_000, 2
WINDOW, STRIDE = 64, 32
WORD_DIM, STEM_DIM, CHAR_DIM, HIDDEN, ATTENTION, TRIGRAMS, STEM_LETTERS = 4, 4, 6, 8, 8, 4096, 5
EPOCHS, BATCH, RATE, SEED = (2, 2, 2), 32, 0.01, 7
#: Words whose inputs a worker keeps.
CACHE_WORDS = 150_000
SCHEMA = "doc_id long, held_out boolean, score double, predicted int"

words_of = re.compile(r"\w+").findall


def _tanh_gate(x):
    return 0.5 * np.tanh(0.5 * x) + 0.5


def trigrams(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed letter trigrams of all words, bounded by marks, and where each word's begin."""
    flat = np.frombuffer("".join(f"\x02{w}\x03\x03" for w in words).encode("utf-32-le", "replace"), "<u4").astype(np.uint64)
    sizes = np.array([len(w) for w in words]) + 3
    h = ((flat[:-2] * 1_000_003 + flat[1:-1]) * 1_000_003 + flat[2:]) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(40)
    begins = np.cumsum(sizes) - sizes
    keep = np.ones(len(flat), bool)
    ends = begins + sizes
    keep[ends - 1] = keep[ends - 2] = False
    counts = sizes - 2
    return (h % TRIGRAMS).astype(np.int32)[keep[: len(h)]], np.cumsum(counts) - counts


class Network:
    """Parameters, forward and backward pass. p: name to array."""

    def __init__(self, p: dict[str, np.ndarray], stems: list[str]):
        self.p, self.stems = p, stems
        self.stem_row = {x: i for i, x in enumerate(stems)}

    @staticmethod
    def fresh(odds: np.ndarray, stems: list[str], stem_odds: np.ndarray) -> Network:
        r = np.random.default_rng(SEED)
        d, n, h = WORD_DIM + STEM_DIM + CHAR_DIM, len(odds), HIDDEN
        f = lambda *s, scale=None: (r.standard_normal(s) * (scale or s[0] ** -0.5)).astype(np.float32)
        words = f(n + 1, WORD_DIM, scale=0.1)
        words[:n, 0] = odds  # an embedding starts from how the word's documents are labelled
        words[n] = 0
        begin = f(len(stems) + 1, STEM_DIM, scale=0.1)
        begin[: len(stems), 0] = stem_odds
        begin[len(stems)] = 0
        p = {"words": words, "stems": begin, "chars": f(TRIGRAMS, CHAR_DIM, scale=0.1), "att": f(2 * h, ATTENTION), "att_b": np.zeros(ATTENTION, np.float32), "att_v": f(ATTENTION), "out": f(2 * h), "out_b": np.zeros(1, np.float32)}
        for k in "fb":
            p |= {f"w{k}": f(d, 3 * h), f"u{k}": f(h, 3 * h), f"c{k}": np.zeros(3 * h, np.float32)}
        return Network(p, stems)

    def stem_rows(self, words: list[str]) -> np.ndarray:
        return np.array([self.stem_row.get(w[:STEM_LETTERS], len(self.stems)) for w in words], np.int64)

    def inputs(self, word_rows: np.ndarray, words: list[str]) -> np.ndarray:
        return np.hstack([self.p["words"][word_rows], self.p["stems"][self.stem_rows(words)], self.char_inputs(words)]).astype(np.float32)

    def char_inputs(self, words: list[str]) -> np.ndarray:
        t, begins = trigrams(words)
        sums = np.add.reduceat(self.p["chars"][t], begins, axis=0)
        return sums / np.diff(np.append(begins, len(t)))[:, None]

    def gates(self, word_rows: np.ndarray, words: list[str]) -> np.ndarray:
        """Inputs to all gates of both directions for these words."""
        x = self.inputs(word_rows, words)
        return np.hstack([x @ self.p["wf"] + self.p["cf"], x @ self.p["wb"] + self.p["cb"]])

    def forward(self, gate: np.ndarray, ids: np.ndarray, lengths: np.ndarray, keep: bool = False):
        """Logits of windows. gate: inputs by word; ids: (WINDOW, n) rows of gate; lengths: words in each window."""
        p, h = self.p, HIDDEN
        steps, n = ids.shape
        states = np.zeros((steps, n, 2 * h), np.float32)
        mask = (np.arange(steps)[:, None] < lengths).astype(np.float32)
        caches = {}
        for k, at, times in (("f", 0, range(steps)), ("b", 1, range(steps - 1, -1, -1))):
            s, u = np.zeros((n, h), np.float32), p[f"u{k}"]
            g = gate[:, 3 * h * at : 3 * h * (at + 1)]
            saved = caches[k] = [None] * steps
            for t in times:
                a = g[ids[t]]
                b = s @ u
                zr = _tanh_gate(a[:, : 2 * h] + b[:, : 2 * h])
                z, r = zr[:, :h], zr[:, h:]
                c = np.tanh(a[:, 2 * h :] + r * b[:, 2 * h :])
                new = c + z * (s - c)
                new *= mask[t][:, None]
                if keep:
                    saved[t] = (s, z, r, c, b[:, 2 * h :])
                s = states[t, :, h * at : h * (at + 1)] = new
        u = np.tanh(states @ p["att"] + p["att_b"])
        e = u @ p["att_v"]
        e[mask == 0] = -1e30
        e -= e.max(axis=0)
        w = np.exp(e)
        w /= w.sum(axis=0)
        pooled = np.einsum("tn,tnh->nh", w, states)
        logit = pooled @ p["out"] + p["out_b"]
        return (logit, (ids, mask, states, caches, u, w, pooled)) if keep else logit

    def backward(self, d: np.ndarray, kept) -> tuple[dict[str, np.ndarray], np.ndarray]:
        """Gradients of parameters, and of gate inputs by step and window, for gradients d of the logits."""
        ids, mask, states, caches, u, w, pooled = kept
        p, h = self.p, HIDDEN
        grads = {"out": pooled.T @ d, "out_b": np.array([d.sum()], np.float32)}
        dp = d[:, None] * p["out"]
        ds = w[:, :, None] * dp
        dw = np.einsum("tnh,nh->tn", states, dp)
        de = w * (dw - (w * dw).sum(axis=0))
        grads["att_v"] = np.einsum("tn,tna->a", de, u)
        du = de[:, :, None] * p["att_v"] * (1 - u * u)
        grads["att_b"] = du.sum(axis=(0, 1))
        grads["att"] = np.einsum("tnh,tna->ha", states, du)
        ds = ds + du @ p["att"].T
        steps, n = ids.shape
        dg = np.zeros((steps, n, 6 * h), np.float32)
        for k, at, times in (("f", 0, range(steps - 1, -1, -1)), ("b", 1, range(steps))):
            uk, gu, back = p[f"u{k}"], np.zeros_like(p[f"u{k}"]), np.zeros((n, h), np.float32)
            for t in times:
                s, z, r, c, bn = caches[k][t]
                dn = (ds[t, :, h * at : h * (at + 1)] + back) * mask[t][:, None]
                dc = dn * (1 - z) * (1 - c * c)
                da = np.hstack([dn * (s - c) * z * (1 - z), dc * bn * r * (1 - r), dc])
                db = np.hstack([da[:, : 2 * h], dc * r])
                dg[t, :, 3 * h * at : 3 * h * (at + 1)] = da
                gu += s.T @ db
                back = dn * z + db @ uk.T
            grads[f"u{k}"] = gu
        return grads, dg


def windows(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All overlapping windows of documents of so many words: owner, begin (in the document), length."""
    n = np.where(sizes > 0, np.maximum(1, -(-(sizes - (WINDOW - STRIDE)) // STRIDE)), 0)
    owner = np.repeat(np.arange(len(sizes)), n)
    begin = (np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)) * STRIDE
    return owner, begin, np.minimum(WINDOW, sizes[owner] - begin)


def gathered(flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    at = starts[None, :] + np.arange(WINDOW)[:, None]
    return np.where(np.arange(WINDOW)[:, None] < lengths, flat[np.minimum(at, len(flat) - 1)], 0)


def train(texts: list[str], labels: list[int], weights: list[float]) -> dict | None:
    """Fit on labelled texts: parameters, vocabulary and calibration. None unless both labels occur. weights: how many
    labelled documents each stands for, used for the calibration only."""
    # words become numbers document by document: their strings, far larger, never stand all at once
    rows, local = [], {}
    df, sf = [Counter(), Counter()], [Counter(), Counter()]
    for text, label, weight in zip(texts, labels, weights, strict=True):
        if ws := words_of(text.lower()):
            df[label].update(set(ws))
            sf[label].update({w[:STEM_LETTERS] for w in ws})
            rows.append((np.array([local.setdefault(w, len(local)) for w in ws], np.int32), label, weight))
    y = np.array([r[1] for r in rows], np.float32)
    if not len(y) or y.min() == y.max():
        return None
    n = [(y == 0).sum(), (y == 1).sum()]

    def known(f: list[Counter], most: int) -> tuple[list[str], np.ndarray]:
        """The most frequent keys, and how their documents' labels lean, shrunk towards 0 where few have them."""
        total = f[0] + f[1]
        top = sorted((k for k, v in total.items() if v >= LEAST_DOCS), key=lambda k: (-total[k], k))[:most]
        odds = [(np.log((f[1][k] + 0.5) / (n[1] + 1)) - np.log((f[0][k] + 0.5) / (n[0] + 1))) * total[k] / (total[k] + 5) for k in top]
        return top, np.array(odds, np.float32)

    frequent, start = known(df, MAX_WORDS)
    stems, stem_start = known(sf, MAX_STEMS)
    net = Network.fresh(start, stems, stem_start)
    row_of = {w: i for i, w in enumerate(frequent)}
    every = list(local)
    word_rows = np.array([row_of.get(w, len(frequent)) for w in every])
    stem_rows = net.stem_rows(every)
    word_odds = np.maximum(np.append(start, 0)[word_rows], np.append(stem_start, 0)[stem_rows])
    tri, tri_begin = trigrams(every)
    tri_end = np.append(tri_begin[1:], len(tri))
    flat = np.concatenate([r[0] for r in rows])
    sizes = np.array([len(r[0]) for r in rows])
    first = np.cumsum(sizes) - sizes
    owner, begin, lengths = windows(sizes)
    starts = first[owner] + begin
    rng = np.random.default_rng(SEED)

    def worst(value: np.ndarray) -> np.ndarray:
        order = np.lexsort((-value, owner))
        return order[np.unique(owner[order], return_index=True)[1]]

    def values() -> np.ndarray:
        gate = net.gates(word_rows, every)
        return np.concatenate([net.forward(gate, gathered(flat, starts[i : i + 2048], lengths[i : i + 2048]), lengths[i : i + 2048]) for i in range(0, len(owner), 2048)])

    seen = np.concatenate([word_odds[gathered(flat, starts[i : i + 2048], lengths[i : i + 2048])].max(axis=0) for i in range(0, len(owner), 2048)])
    moment = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in net.p.items()}
    step = 0
    balance = np.where(y == 1, len(y) / (2 * n[1]), len(y) / (2 * n[0])).astype(np.float32)
    for turn, epochs in enumerate(EPOCHS):
        chosen = worst(seen if turn == 0 else values())
        for _ in range(epochs):
            for part in np.array_split(rng.permutation(len(y)), max(1, len(y) // BATCH)):
                win = chosen[part]
                ids = gathered(flat, starts[win], lengths[win])
                used, inside = np.unique(ids, return_inverse=True)
                ws, wr = [every[i] for i in used], word_rows[used]
                x = net.inputs(wr, ws)
                gate = np.hstack([x @ net.p["wf"] + net.p["cf"], x @ net.p["wb"] + net.p["cb"]])
                logit, kept = net.forward(gate, inside.reshape(ids.shape), lengths[win], True)
                d = ((1 / (1 + np.exp(-logit)) - y[part]) * balance[part] / len(part)).astype(np.float32)
                grads, dg = net.backward(d, kept)
                by_word = np.zeros((len(used), 6 * HIDDEN), np.float32)
                np.add.at(by_word, inside.ravel(), dg.reshape(-1, 6 * HIDDEN))
                dx = np.zeros_like(x)
                for k, at in (("f", 0), ("b", 1)):
                    g = by_word[:, 3 * HIDDEN * at : 3 * HIDDEN * (at + 1)]
                    grads[f"w{k}"], grads[f"c{k}"] = x.T @ g, g.sum(axis=0)
                    dx += g @ net.p[f"w{k}"].T
                gw, gs, gc = (np.zeros_like(net.p[k]) for k in ("words", "stems", "chars"))
                np.add.at(gw, wr, dx[:, :WORD_DIM])
                np.add.at(gs, stem_rows[used], dx[:, WORD_DIM : WORD_DIM + STEM_DIM])
                gw[-1] = gs[-1] = 0
                counts = (tri_end - tri_begin)[used]
                spans = np.concatenate([tri[tri_begin[i] : tri_end[i]] for i in used])
                np.add.at(gc, spans, np.repeat(dx[:, WORD_DIM + STEM_DIM :] / counts[:, None], counts, axis=0))
                grads["words"], grads["stems"], grads["chars"] = gw, gs, gc
                step += 1
                for k, g in grads.items():
                    m, v = moment[k]
                    m += 0.1 * (g - m)
                    v += 0.001 * (g * g - v)
                    net.p[k] = (net.p[k] - RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    value = values()
    top = value[worst(value)].astype(float)
    stands = np.array([r[2] for r in rows])
    a, b = 1.0, 0.0
    for _ in range(50):  # logistic calibration by Newton steps, slightly shrunk
        q = 1 / (1 + np.exp(-np.clip(a * top + b, -30, 30)))
        g = np.array([(stands * (q - y) * top).sum() + 0.5 * (a - 1), (stands * (q - y)).sum() + 1e-3 * b])
        k = stands * q * (1 - q)
        hess = np.array([[(k * top * top).sum() + 0.5, (k * top).sum()], [(k * top).sum(), k.sum() + 1e-3]])
        move = np.linalg.solve(hess, g)
        a, b = a - np.clip(move[0], -1, 1), b - np.clip(move[1], -1, 1)
    return {"p": net.p, "vocabulary": frequent, "stems": stems, "scale": (max(a, 0.05), b), "base": float((stands * y).sum() / stands.sum())}


class Scorer:
    """A worker's copy of the model, with the gate inputs of words met so far."""

    def __init__(self, model: dict):
        self.model, self.net = model, Network(model["p"], model["stems"])
        self.unknown = len(model["vocabulary"])
        self.reset()

    def reset(self) -> None:
        v = self.model["vocabulary"]
        self.rows = {w: i for i, w in enumerate(v)}
        self.gate = self.net.gates(np.arange(len(v)), v) if v else np.zeros((0, 6 * HIDDEN), np.float32)
        self.size = len(self.gate)

    def admit(self, new: list[str]) -> None:
        for i in range(0, len(new), 10_000):
            part = new[i : i + 10_000]
            g = self.net.gates(np.full(len(part), self.unknown), part)
            need = self.size + len(part)
            if need > len(self.gate):
                self.gate = np.vstack([self.gate[: self.size], np.empty((max(need, self.size * 3 // 2) - self.size, g.shape[1]), np.float32)])
            self.gate[self.size : need] = g
            self.rows.update(zip(part, range(self.size, need), strict=True))
            self.size = need

    def scores(self, texts: list[str]) -> list[float]:
        out: list[float] = []
        a, b = self.model["scale"]
        for some in portions(texts, 500_000):
            lists = [words_of(t.lower()) for t in some]
            new = set(chain.from_iterable(lists)).difference(self.rows)
            if self.size + len(new) > CACHE_WORDS and self.size > self.unknown:
                self.reset()
                new = set(chain.from_iterable(lists)).difference(self.rows)
            if new:
                self.admit(sorted(new))
            get = self.rows.__getitem__
            sizes = np.array([len(x) for x in lists])
            flat = np.fromiter(map(get, chain.from_iterable(lists)), np.int32, int(sizes.sum()))
            owner, begin, lengths = windows(sizes)
            starts = (np.cumsum(sizes) - sizes)[owner] + begin
            top = np.full(len(some), -np.inf)
            for i in range(0, len(owner), 2048):
                s = slice(i, i + 2048)
                np.maximum.at(top, owner[s], self.net.forward(self.gate, gathered(flat, starts[s], lengths[s]), lengths[s]))
            q = 1 / (1 + np.exp(-np.clip(a * top + b, -30, 30)))
            out += np.where(sizes > 0, q, self.model["base"] if self.model["base"] < 0.5 else 0.0).tolist()
        return out


_LOADED: dict[int, Scorer] = {}


def loaded(model: dict) -> Scorer:
    alone(_LOADED)
    if id(model) not in _LOADED:
        _LOADED.clear()
        _LOADED[id(model)] = Scorer(model)
    return _LOADED[id(model)]


def fit(docs: DataFrame, labels: DataFrame, folds: int = FOLDS) -> dict | None:
    """Train on a bounded sample of the learnable labelled documents: TOXIC_DOCS and CLEAN_DOCS texts at most, chosen by
    hash of the id, TRAIN_LETTERS of each at most. A document labelled more than once is toxic if one label says so; of an
    id with several texts, the first in order is learned from."""
    known = labels.filter(F.col("toxic").isNotNull() & learns(F.col("doc_id"), folds)).groupBy(F.col("doc_id").alias("_id")).agg(F.max(F.col("toxic").cast("int")).alias("_toxic"))
    h = F.xxhash64("_id", F.lit(5))
    counts = {r["_toxic"]: r["n"] for r in known.groupBy("_toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    some = known.filter("_toxic = 1").orderBy(h, "_id").limit(TOXIC_DOCS).union(known.filter("_toxic = 0").orderBy(h, "_id").limit(CLEAN_DOCS))
    texts = docs.select(docs["doc_id"].alias("_id"), F.substring(docs["text"].cast("string"), 1, TRAIN_LETTERS).alias("_text"))
    rows = texts.join(F.broadcast(some), "_id").groupBy("_id", "_toxic").agg(F.min("_text").alias("_text")).collect()
    rows = sorted(rows, key=lambda r: (r["_id"], r["_text"] or ""))
    stands = {k: counts.get(k, 0) / max(1, min(counts.get(k, 0), m)) for k, m in ((1, TOXIC_DOCS), (0, CLEAN_DOCS))}
    model = train([r["_text"] or "" for r in rows], [r["_toxic"] for r in rows], [stands[r["_toxic"]] for r in rows])
    give_back()
    return model


def score(docs: DataFrame, labels: DataFrame, folds: int = FOLDS, keep: bool = False, training: DataFrame | None = None) -> DataFrame:
    """Score every whole text: doc_id, held_out, score (0 to 1), predicted (1 from 0.5 on); with keep, docs' own
    columns, toxic_score and toxic_predicted instead (the last two, with marks after their names where docs has columns
    named so). training: the documents that labels speak of, if not docs.

    Null, empty and wordless texts score the share of toxic labels (0 if that is half or more); without labels of both
    kinds every row scores 0. Repeated rows score alike. A long text is read whole, window after window. Memory:
    the model (bounded by its sample), a bounded word cache and one portion of text."""
    spark = docs.sparkSession
    ship(spark)
    model = spark.sparkContext.broadcast(fit(training if training is not None else docs, labels, folds))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from quillspark.llm.toxicity import loaded

        m = model.value
        scorer = loaded(m) if m else None
        for b in parts(batches):
            at = b.num_columns - 1
            texts = [t or "" for t in b.column(at).to_pylist()]
            s = scorer.scores(texts) if scorer else [0.0] * len(texts)
            yield pa.RecordBatch.from_arrays([*b.columns[:at], pa.array(s, pa.float64()), pa.array([int(x >= 0.5) for x in s], pa.int32())], names)

    text = docs["text"].cast("string").alias(unused("_text", docs.columns))
    if keep:
        names = [*docs.columns, unused("toxic_score", docs.columns), unused("toxic_predicted", docs.columns)]
        schema = docs.select(*docs.columns, F.lit(0.0).alias(names[-2]), F.lit(0).alias(names[-1])).schema
        return docs.select(*docs.columns, text).mapInArrow(run, schema)
    names = [x.split()[0] for x in SCHEMA.split(", ")]
    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), held_out(docs["doc_id"], folds).alias("held_out"), text).mapInArrow(run, SCHEMA)


def op3_toxicity(spark, sf_dir: str) -> DataFrame:
    return score(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))


QUERIES = {"op3_toxicity": op3_toxicity}
ORACLES: dict[str, str] = {}
