"""Language-model scoring by deleted interpolation.

Trigram, bigram, unigram and uniform estimates are mixed with weights that depend on how often the context was seen:
P2 = w2 f2 + w1 f1 + w0 / types by the count of the word before, P3 = v f3 + (1 - v) P2 by the count of the two words
before. The weights come from expectation-maximisation on held-out counts: each training token in turn is taken out of
the counts and predicted from the rest. What is unseen is one more type; its unigram share is that of tokens seen once.

Counts cover all learnable documents and live in tables. Documents are dealt into chunks, each with its own small
vocabulary; a chunk asks for the counts of its distinct words, pairs and triples by hash, in blocks by hash range, and
gets them back. So shuffles move distinct n-grams of a chunk, not tokens, and no word, however frequent, makes a block
large. Chunks and ranges grow with the root of the corpus, so that blocks hold a thousand entries (twenty at 100 TB).

Words have 64-bit hashes. Those of pairs and triples are as wide as the number of tokens asks for: another n-gram falls
on a given one with a probability of 2^-SPARE, at every size.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import alone, discard, learns, parts, scratch, ship, tidy
from .wordhash import BORDER, hashes, joined, letter_values, stretches

FOLDS = 10
#: Tokens of a chunk (a single longer document is a chunk of its own): least, most, and the entries a block should have.
CHUNK, CHUNK_MOST, BLOCK = 1_000_000, 16_000_000, 1_000
#: Letters hashed at once; bits of an n-gram's hash beyond those that number the tokens.
PORTION, SPARE = 400_000, 14
ROUNDS = 60
END_HASH = 0x9AE16A3B2F90404F
SCHEMA = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
_CHUNK = "chunk long, n_docs long, n_words long, n_tokens long, doc_ids binary, nulls binary, learn binary, sizes binary, tokens binary, words binary, counts binary"
_BLOCK = "chunk long, part long, n long, data binary, counts binary, codes binary"
_REPLY = "chunk long, part long, n long, counts binary, types long, total long, once long"


def chunk_size(letters: int) -> int:
    """Tokens of a chunk for so many letters of text; a range of hashes is twice as large."""
    return max(CHUNK, min(CHUNK_MOST, int(math.sqrt(letters / 5 * BLOCK / 2))))


def squeeze(a: np.ndarray) -> bytes:
    """Compressed bytes of an array, byte by byte of its items."""
    a = np.ascontiguousarray(a)
    return pa.compress(a.view(np.uint8).reshape(len(a), a.itemsize).T.tobytes(), codec="zstd", asbytes=True) if len(a) else b""


def unsqueeze(data: bytes, kind, n: int) -> np.ndarray:
    kind = np.dtype(kind)
    if not n:
        return np.zeros(0, kind)
    x = np.frombuffer(pa.decompress(data, decompressed_size=n * kind.itemsize, codec="zstd", asbytes=True), np.uint8)
    return np.ascontiguousarray(x.reshape(kind.itemsize, n).T).view(kind).ravel()


def each(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """Rows one at a time: a row may be large."""
    for b in batches:
        for i in range(b.num_rows):
            yield b.slice(i, 1).to_pylist()[0]


@cache
def _letters() -> tuple[np.ndarray, np.ndarray]:
    """Which codes part words, and the value of each with A-Z lower-cased."""
    value, space = letter_values(), np.zeros(BORDER + 1, bool)
    value[65:91] = value[97:123]
    space[[*range(9, 14), 32, BORDER]] = True
    return space, value


_breaks = re.compile(r"[ \t-\r]", re.ASCII)


def word_hashes(texts: list[str]) -> list[np.ndarray]:
    """Hashes of each text's words: A-Z lower-cased, split at ASCII white space."""
    space, value = _letters()
    out: list[list[np.ndarray]] = [[] for _ in texts]
    for some in stretches(texts, PORTION, _breaks):
        _, codes, begins = joined([t for _, t in some])
        word = ~space[codes]
        edge = np.flatnonzero(word[1:] != word[:-1]) + 1  # a border ends the last word
        edge = np.append(0, edge) if word[0] else edge
        begin, end = edge[::2], edge[1::2]
        h = hashes(value[codes], begin, end)
        for (k, _), x in zip(some, np.split(h, np.searchsorted(begin, begins[1:-1])), strict=True):
            out[k].append(x)
    return [x[0] if len(x) == 1 else np.concatenate(x) for x in out]


def distinct(h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct values in order, where each occurs, and the number of each element's value."""
    order = np.argsort(h)
    x = h[order]
    new = np.append(True, x[1:] != x[:-1])
    at = np.empty(len(h), np.int64)
    at[order] = np.cumsum(new) - 1
    return x[new], order[new], at


def _mixed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hash of a pair of hashes."""
    x = (a * np.uint64(0x9E3779B97F4A7C15)) ^ (b + np.uint64(0xD6E8FEB86659FD93))
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0x9FB21C651E98DF25)
    return x ^ (x >> np.uint64(32))


def chunked(docs: DataFrame, folds: int = FOLDS, size: int = CHUNK) -> DataFrame:
    """Documents as chunks of numbered tokens (END closes every document)."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        from quillspark.llm.lm import END_HASH, _LOADED, alone, distinct, squeeze, word_hashes

        alone(_LOADED)
        first = TaskContext.get().partitionId() << 32
        made, held = 0, 0
        ids, learn, sizes, tokens = [], [], [], []
        end = np.array([END_HASH], np.uint64)

        def packed():
            words, _, at = distinct(np.concatenate(tokens))
            n, can = np.array(sizes, np.int64), np.array(learn, np.uint8)
            counts = np.bincount(at[np.repeat(can, n).astype(bool)], minlength=len(words)).astype(np.int64)
            nulls = np.array([i is None for i in ids], np.uint8)
            row = [first + made, len(ids), len(words), len(at), squeeze(np.array([i or 0 for i in ids], np.int64)), squeeze(nulls), squeeze(can), squeeze(n), squeeze(at.astype(np.int32)), squeeze(np.diff(words, prepend=np.uint64(0))), squeeze(counts)]
            kinds = [pa.int64()] * 4 + [pa.binary()] * 7
            return pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(row, kinds, strict=True)], [c.split()[0] for c in _CHUNK.split(", ")])

        for batch in parts(batches):
            texts = [t or "" for t in batch.column(2).to_pylist()]
            for i, can, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), word_hashes(texts), strict=True):
                ids.append(i)
                learn.append(can)
                sizes.append(len(t) + 1)
                tokens += [t, end]
                held += len(t) + 1
                if held >= size:
                    yield packed()
                    made, held = made + 1, 0
                    ids, learn, sizes, tokens = [], [], [], []
        if ids:
            yield packed()

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), learns(docs["doc_id"], folds).alias("learn"), docs["text"].cast("string").alias("text")).mapInArrow(run, _CHUNK)


_LOADED: dict = {}


def _blocks(chunk: int, keys: np.ndarray, counts: np.ndarray, codes: np.ndarray | None, parts: int, bits: int, first: int = 0) -> pa.RecordBatch:
    """Requests of a chunk: its hashes of so many bits, which must be sorted, cut into equal ranges."""
    width = (1 << bits) // parts + 1
    edges = np.searchsorted(keys, np.array([min(k * width, (1 << bits) - 1) for k in range(1, parts)], np.uint64))
    rows = []
    for k, (a, b) in enumerate(zip([0, *edges], [*edges, len(keys)], strict=True)):
        if a < b:
            rows.append((chunk, first + k, b - a, squeeze(np.diff(keys[a:b], prepend=np.uint64(0))), squeeze(counts[a:b].astype(np.int64)), squeeze(codes[a:b]) if codes is not None else b""))
    kinds = [pa.int64()] * 3 + [pa.binary()] * 3
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], [c.split()[0] for c in _BLOCK.split(", ")])


def _counted(pdf: pd.DataFrame) -> tuple[pd.DataFrame, np.ndarray, np.ndarray]:
    """Sums of the counts of equal hashes over all chunks' blocks of one range, for each block in its order; also where
    each hash first occurs, and its sum. The first row carries how many types the range has, their total and how many
    occur once."""
    from quillspark.llm.lm import distinct, squeeze, unsqueeze

    keys = np.concatenate([np.cumsum(unsqueeze(d, np.uint64, n)) for d, n in zip(pdf["data"], pdf["n"], strict=True)])
    counts = np.concatenate([unsqueeze(d, np.int64, n) for d, n in zip(pdf["counts"], pdf["n"], strict=True)])
    _, one, at = distinct(keys)
    # sums of integers, exact beyond what a double holds
    order = np.argsort(at, kind="stable")
    total = np.add.reduceat(counts[order], np.searchsorted(at[order], np.arange(len(one))))
    replies = np.split(total[at], np.cumsum(pdf["n"].to_numpy())[:-1])
    out = pd.DataFrame({"chunk": pdf["chunk"], "part": pdf["part"], "n": pdf["n"], "counts": [squeeze(r) for r in replies], "types": 0, "total": 0, "once": 0})
    out.iloc[0, 4:] = [int((total > 0).sum()), int(total.sum()), int((total == 1).sum())]
    return out, one, total


def count_words(pdf: pd.DataFrame) -> pd.DataFrame:
    from quillspark.llm.lm import _counted

    return _counted(pdf.sort_values("chunk"))[0]


def count_ngrams(pdf: pd.DataFrame) -> pd.DataFrame:
    """Replies; for a range of pairs also, in one more row (chunk -1), its held-out tokens by bucket and counts."""
    from quillspark.llm.lm import _counted, squeeze, unsqueeze

    pdf = pdf.sort_values("chunk")
    out, one, total = _counted(pdf)
    if not len(pdf["codes"].iloc[0]):
        return out
    codes = np.concatenate([unsqueeze(d, np.uint32, k) for d, k in zip(pdf["codes"], pdf["n"], strict=True)])
    keep = total > 0
    c12, codes = total[keep], codes[one[keep]].astype(np.int64)
    left = np.where(c12 > 1, 1 + np.round(4 * np.log2(np.maximum(c12 - 1, 1))).astype(np.int64), 0)
    cells, at = np.unique((codes << 8) | left, return_inverse=True)
    held = np.bincount(at, c12).astype(np.int64)
    extra = pd.DataFrame({"chunk": [-1], "part": [pdf["part"].iloc[0]], "n": [len(cells)], "counts": [squeeze(np.stack([cells, held], axis=1).ravel())], "types": [0], "total": [0], "once": [0]})
    return pd.concat([out, extra])


def _with_replies(chunks: DataFrame, replies: DataFrame, parts: int) -> DataFrame:
    """Chunks with their replies, joined in order of range, as the array column replies."""
    back = replies.repartition(parts, "chunk").groupBy("chunk").agg(F.sort_array(F.collect_list(F.struct("part", "n", "counts"))).alias("replies"))
    return chunks.repartition(parts, "chunk").join(back, "chunk", "left")


def _joined(replies) -> np.ndarray:
    return np.concatenate([unsqueeze(r["counts"], np.int64, r["n"]) for r in replies]) if replies is not None and len(replies) else np.zeros(0, np.int64)


class Chunk:
    """One chunk with the corpus counts of its words."""

    def __init__(self, r: dict):
        self.id, d, w, t = r["chunk"], r["n_docs"], r["n_words"], r["n_tokens"]
        self.ids, self.nulls = unsqueeze(r["doc_ids"], np.int64, d), unsqueeze(r["nulls"], np.uint8, d)
        self.learn, self.sizes = unsqueeze(r["learn"], np.uint8, d).astype(bool), unsqueeze(r["sizes"], np.int64, d)
        self.tokens, self.words = unsqueeze(r["tokens"], np.int32, t), np.cumsum(unsqueeze(r["words"], np.uint64, w))
        self.counts = unsqueeze(r["counts"], np.int64, w)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.learned = np.repeat(self.learn, self.sizes)  # by token
        end = int(np.searchsorted(self.words, np.uint64(END_HASH)))
        self.before = np.append(np.int32(end), self.tokens[:-1])  # a document follows another's END, or nothing

    def ngrams(self, bits: int) -> tuple[tuple, tuple]:
        """distinct() of the hashes, of so many bits, of each token with the word before, and with the two before. Each
        document starts from END."""
        h = self.words[self.tokens]
        h1 = self.words[self.before]
        h2 = np.append(np.uint64(END_HASH), h1[:-1])
        h2[self.starts] = END_HASH
        pair = _mixed(h1, h)
        cut = np.uint64(64 - bits)
        return distinct(pair >> cut), distinct(_mixed(h2 + np.uint64(0x632BE59BD9B4E019), pair) >> cut)

    def all_counts(self, replies, bits: int) -> tuple[np.ndarray, ...]:
        """Of each token: counts of the word, the word before, the pair, the two words before, the triple."""
        (pairs, _, at2), (_, _, at3) = self.ngrams(bits)
        got = _joined(replies)
        pair, triple = got[: len(pairs)][at2], got[len(pairs) :][at3]
        word, context = self.counts[self.tokens], self.counts[self.before]
        two = np.append(np.int64(0), pair[:-1])
        two[self.starts] = context[self.starts]  # END and END: as many as documents
        return word, context, pair, two, triple


def _log2(c: np.ndarray) -> np.ndarray:
    return np.log2(np.maximum(c, 1))


def _octave(c: np.ndarray) -> np.ndarray:
    """Bucket of a context's frequency: 0 for unseen ones, then by powers of two."""
    return np.where(c > 0, np.floor(_log2(c)).astype(np.int64) + 1, 0)


def weights(cells: list[tuple], rounds: int = ROUNDS) -> dict[int, tuple[float, ...]]:
    """Mixture weights of each bucket by expectation-maximisation. cells: bucket, the estimates of held-out tokens,
    and their number."""
    out = {}
    by: dict[int, list] = {}
    for bucket, *x in cells:
        by.setdefault(bucket, []).append(x)
    for bucket, x in by.items():
        *p, n = np.array(x, float).T
        p = np.stack(p)
        w = np.full(len(p), 1 / len(p))
        for _ in range(rounds):
            share = w[:, None] * p
            share /= np.maximum(share.sum(axis=0), 1e-300)
            w = np.maximum((share * n).sum(axis=1) / n.sum(), 1e-9)
            w /= w.sum()
        out[bucket] = tuple(w.tolist())
    return out


class Model:
    """Totals and mixture weights: everything of the model that is not counts in tables."""

    def __init__(self, types: int, total: int, once: int):
        self.types, self.total = types, total
        unseen = once / total if total else 0.0
        self.unseen = min(max(unseen, 1 / (total + 1)), 0.5) if total and not 0 < unseen < 1 else unseen
        self.uniform = 1 / (types + 1)
        self.two: dict[int, tuple[float, ...]] = {}
        self.three: dict[int, tuple[float, ...]] = {}

    def below(self, word: np.ndarray, context: np.ndarray, pair: np.ndarray, total: int) -> np.ndarray:
        """P2 of tokens by these counts; a context never seen gives its bigram weight to the unigram."""
        bucket = _octave(context)
        mix = np.array([self.two.get(k, (0.0, 1.0 - 1e-6, 1e-6)) if self.total else (0.0, 0.0, 1.0) for k in range(int(bucket.max(initial=0)) + 1)])
        w2, w1, w0 = mix[bucket].T
        idle = context == 0
        w1, w2 = np.where(idle, w1 + w2, w1), np.where(idle, 0.0, w2)
        one = np.where(word > 0, (1 - self.unseen) * word / max(total, 1), self.unseen)
        return w2 * pair / np.maximum(context, 1) + w1 * one + w0 * self.uniform

    def probability(self, word, context, pair, two, triple) -> np.ndarray:
        p2 = self.below(word, context, pair, self.total)
        bucket = _octave(two)
        v = np.array([0.0, *(self.three.get(k, (0.0, 1.0))[0] for k in range(1, int(bucket.max(initial=0)) + 1))])[bucket]
        return v * triple / np.maximum(two, 1) + (1 - v) * p2


def score(docs: DataFrame, folds: int = FOLDS) -> DataFrame:
    """Score all whole texts with a model of the learnable ones (SCHEMA). base_score is the add-0.1 unigram score.

    A null or empty text is one END token. Repeated rows are scored each and, where learnable, counted each. A null
    doc_id is scored, never learned from. An empty table gives no rows; with nothing to learn from, both scores are 0.
    Further columns are not read. Counts are 64 bits wide. A very long text is a chunk of its own. Tables lie in the
    shared folder; tasks hold a chunk or a hash range, both bounded (but for a single longer document). The mixture
    weights are learned from estimates rounded to quarter octaves, each in its exact bucket."""
    spark = docs.sparkSession
    ship(spark)
    letters = docs.agg(F.sum(F.length(F.col("text").cast("string")))).first()[0]
    size = chunk_size(letters or 0)
    chunks = scratch(chunked(docs, folds, size), "lm-chunks")
    found = chunks.agg(F.sum("n_words"), F.sum("n_tokens"), F.count(F.lit(1))).first()
    if found[0] is None:
        return spark.createDataFrame([], SCHEMA)
    parts1, parts2 = (max(8, -(-int(x) // (2 * size))) for x in found[:2])
    parts_c = max(8, -(-int(found[2]) // 2))
    bits = min(64, max(40, int(found[1]).bit_length() + SPARE))

    def ask_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from quillspark.llm.lm import _blocks, each, unsqueeze

        for r in each(batches):
            h, c = np.cumsum(unsqueeze(r["words"], np.uint64, r["n_words"])), unsqueeze(r["counts"], np.int64, r["n_words"])
            yield _blocks(r["chunk"], h, c, None, parts1, 64)

    asked = chunks.select("chunk", "n_words", "words", "counts").mapInArrow(ask_words, _BLOCK)
    known = scratch(asked.repartition(parts1, "part").groupBy("part").applyInPandas(count_words, _REPLY), "lm-words")
    totals = known.agg(F.sum("types"), F.sum("total"), F.sum("once")).first()
    model = Model(*(int(x or 0) for x in totals))

    def with_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from quillspark.llm.lm import _joined, each, squeeze

        for r in each(batches):
            r["counts"] = squeeze(_joined(r.pop("replies")))
            yield pa.RecordBatch.from_pylist([r], schema=pa.schema([(x.split()[0], pa.binary() if x.endswith("binary") else pa.int64()) for x in _CHUNK.split(", ")]))

    full = scratch(_with_replies(chunks.drop("counts"), known, parts_c).mapInArrow(with_counts, _CHUNK), "lm-counted")
    discard(chunks)
    discard(known)

    def ask_ngrams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from quillspark.llm.lm import Chunk, _blocks, _log2, _octave, each

        for r in each(batches):
            c = Chunk(r)
            pairs, triples = c.ngrams(bits)
            rounded = np.round(4 * _log2(c.counts)).astype(np.uint32)
            first, second = c.before[pairs[1]], c.tokens[pairs[1]]
            codes = _octave(c.counts - 1).astype(np.uint32)[first] << 16 | rounded[second] << 8 | rounded[first]
            for k, (keys, _, at) in enumerate((pairs, triples)):
                n = np.bincount(at[c.learned], minlength=len(keys))
                yield _blocks(c.id, keys, n, None if k else codes, parts2, bits, k * parts2)

    asked = full.mapInArrow(ask_ngrams, _BLOCK).repartition(2 * parts2, "part")
    replies = scratch(asked.groupBy("part").applyInPandas(count_ngrams, _REPLY), "lm-ngrams")

    # Held-out tokens by bucket and rounded counts: tables bounded by the rounding, not the corpus.
    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from quillspark.llm.lm import unsqueeze

        for b in batches:
            for n, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                x = unsqueeze(data, np.int64, 2 * n).reshape(n, 2)
                yield pa.RecordBatch.from_arrays([pa.array(x[:, 0]), pa.array(x[:, 1])], ["cell", "held"])

    with tidy(spark):
        table = replies.filter("chunk = -1").select("n", "counts").mapInArrow(listed, "cell long, held long").groupBy("cell").agg(F.sum("held").alias("held")).collect()
    model.two = weights([_two_cell(model, cell, n) for cell, n in table])
    answers = replies.filter("chunk >= 0")

    def held_out_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Learnable tokens by bucket of the two words before, and both estimates without the token itself."""
        from quillspark.llm.lm import Chunk, _octave, each

        for r in each(batches):
            c = Chunk(r)
            word, context, pair, two, triple = (x[c.learned] - 1 for x in c.all_counts(r["replies"], bits))
            keep = two > 0  # an unseen context has no trigram estimate
            p2 = model.below(word[keep], context[keep], pair[keep], model.total - 1)
            two, triple = two[keep], triple[keep]
            q3 = np.where(triple > 0, np.round(-4 * np.log2(np.maximum(triple, 1) / two)).astype(np.int64), 1023)
            cell, n = np.unique(_octave(two) << 20 | q3 << 10 | np.clip(np.round(-4 * np.log2(p2)).astype(np.int64), 0, 1023), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(n)], ["cell", "held"])

    if model.total:
        with tidy(spark):
            table = _with_replies(full, answers, parts_c).mapInArrow(held_out_cells, "cell long, held long").groupBy("cell").agg(F.sum("held").alias("held")).collect()
        model.three = weights([(cell >> 20, 0.0 if (q := cell >> 10 & 1023) == 1023 else 2 ** (-q / 4), 2 ** (-(cell & 1023) / 4), float(n)) for cell, n in table])

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from quillspark.llm.lm import Chunk, each

        for r in each(batches):
            c = Chunk(r)
            log_p = np.log10(model.probability(*c.all_counts(r["replies"], bits)))
            base = np.log10((c.counts + 0.1) / (model.total + 0.1 * (model.types + 1)))
            cols = [
                pa.array(c.ids, pa.int64(), mask=c.nulls.astype(bool)),
                pa.array(~c.learn & ~c.nulls.astype(bool)),
                pa.array(c.sizes),
                pa.array(np.add.reduceat((c.counts > 0)[c.tokens].astype(np.int64), c.starts)),
                pa.array(np.full(len(c.ids), model.total)),
                pa.array(np.add.reduceat(base[c.tokens], c.starts)),
                pa.array(np.add.reduceat(log_p, c.starts)),
            ]
            yield pa.RecordBatch.from_arrays(cols, [x.split()[0] for x in SCHEMA.split(", ")])

    return _with_replies(full, answers, parts_c).mapInArrow(scored, SCHEMA)


def _two_cell(model: Model, cell: int, n: int) -> tuple:
    """Bucket, bigram, unigram and uniform estimate of held-out tokens, from rounded counts."""
    bucket, code2, code1, left = cell >> 24, cell >> 16 & 255, cell >> 8 & 255, cell & 255
    c1, c2 = 2 ** (code1 / 4), 2 ** (code2 / 4)
    p2 = min(1.0, 2 ** ((left - 1) / 4) / max(c1 - 1, 1)) if left else 0.0
    p1 = (1 - model.unseen) * (c2 - 1) / max(model.total - 1, 1) if code2 else model.unseen
    return bucket, p2, p1, model.uniform, float(n)


def op5_lm(spark, sf_dir: str) -> DataFrame:
    return score(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op5_lm": op5_lm}
ORACLES: dict[str, str] = {}
