"""Order-preserving packing of token streams into sequences.

Each input partition is a stream of documents in their order. Cuts may fall at document and sentence ends (and, where
a sentence is longer than the gap allowed, at spaced positions inside it); dynamic programming chooses them so that
padding plus penalties for cutting documents is least. A window from cut i to cut j costs limit - (p_j - p_i), except
where its length is a power of two, which is not padded. The first kind of transition is a minimum of d_i + p_i over a
sliding range, held by a monotone queue; the second looks up the cut at exactly p_j - 2^k.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import alone, parts, ship
from .wordhash import BORDER, LONG, Kept, hashes, joined, letter_values, spans, stretches

LIMIT = 4096
END_ID = 2
SENTENCE_COST, FORCED_COST, SEQUENCE_COST = 4, 64, 64
#: Longest stretch without a place to cut, and the spacing of forced places within.
GAP, SPACING = 1024, 256
#: Ids held before cuts are settled; the windows nearest the end are settled with the next ids.
HORIZON, TAIL = 524_288, 16 * LIMIT
#: Pieces of words that a worker keeps with their ids (about 60 MB), and letters encoded at once.
CACHE_PIECES, PORTION = 1_000_000, 400_000
#: What the public tokenizer takes for white space.
SPACE = (*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)
#: Letters and signs that lower-case one to one and that no normalisation changes; words of others, and words that may
#: hold contractions or special tokens, are given to the tokenizer whole.
PLAIN = ((0x21, 0x7F), (0xA1, 0x180), (0x400, 0x460), (0x2010, 0x2028), (0x2030, 0x205F), (0x20AC, 0x20AD), (0x3041, 0x3097), (0x30A1, 0x30FB), (0x4E00, 0xA000), (0xAC00, 0xD7A4))
_SPACE, _NUMBER, _LETTER, _OTHER, _WHOLE = range(5)
#: Stands between words that are encoded together; alone it is one id.
MARK = "\x01"
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def kinds() -> tuple[np.ndarray, np.ndarray]:
    """Kind and lower case of every code. White space and borders part words; runs of one kind are pieces, each number
    letter is one; words with a letter of kind _WHOLE are one piece."""
    kind, lower = np.full(BORDER + 1, _WHOLE, np.uint8), np.arange(BORDER + 1, dtype=np.int32)
    for x in chain.from_iterable(range(a, b) for a, b in PLAIN):
        c = chr(x)
        low = c.lower()
        if len(low) == 1 and c not in "'<" and unicodedata.normalize("NFC", c) == c and unicodedata.normalize("NFC", low) == low:
            kind[x] = {"L": _LETTER, "N": _NUMBER}.get(unicodedata.category(c)[0], _OTHER)
            lower[x] = ord(low)
    kind[[*SPACE, BORDER]] = _SPACE
    return kind, lower


class WordEncoder:
    """Ids of the public tokenizer, kept by piece: its normaliser and its splits never reach across white space, and
    runs of letters, numbers and other signs are encoded each for itself."""

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        if self.tokenizer.get_vocab_size() > 65_536:
            raise ValueError("ids must fit in 16 bits")
        self.encode_batch = getattr(self.tokenizer, "encode_batch_fast", self.tokenizer.encode_batch)
        bare = Tokenizer.from_file(path)
        bare.normalizer = normalizers.Sequence([])
        bare.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self.encode_bare = getattr(bare, "encode_batch_fast", bare.encode_batch)
        self.kept = Kept(CACHE_PIECES)
        self.kind, lower = kinds()
        self.value = letter_values()
        self.low_value = self.value[lower]
        self.breaks = re.compile("[" + "".join(map(chr, SPACE)) + "]")
        (self.mark,) = self.tokenizer.encode(MARK, add_special_tokens=False).ids
        ends = [i for t, i in self.tokenizer.get_vocab().items() if re.fullmatch(r"[^0-9A-Za-z]*[.!?][^0-9A-Za-z]*", t.removesuffix("</w>"))]
        self.sentence_end = np.zeros(65_536, bool)
        self.sentence_end[ends] = True

    def apart(self, words: list[str], bare: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words and how many each has: they are encoded as one text, with a mark between them that no word
        holds. bare: the words are normalised and split already."""
        if not bare and any(MARK in w or "<|" in w for w in words):
            each = [e.ids for e in self.encode_batch(words, add_special_tokens=False)]
            return np.array([*chain.from_iterable(each)], np.uint16), np.array([len(x) for x in each], np.int32)
        encode = self.encode_bare if bare else self.encode_batch
        ids = np.array(encode([f" {MARK} ".join([*words, ""])], add_special_tokens=False)[0].ids, np.uint16)
        marks = ids == self.mark
        return ids[~marks], np.diff(np.flatnonzero(marks), prepend=-1).astype(np.int32) - 1

    def learn(self, words: list[str], bare: bool) -> tuple[np.ndarray, np.ndarray]:
        found = [self.apart(words[i : i + 20_000], bare) for i in range(0, len(words), 20_000)]
        return (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.uint16), np.zeros(0, np.int32))

    def encode_some(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after the other, and where each text's end."""
        whole, codes, begins = joined(texts)
        kind, values = self.kind[codes], self.low_value[codes]
        odd = np.flatnonzero(kind == _WHOLE)
        if len(odd):
            space = np.flatnonzero(kind == _SPACE)
            after = np.unique(np.searchsorted(space, odd))
            first = np.where(after > 0, space[after - 1] + 1, 0)
            rows = spans(first, space[after] - first)
            kind[rows], values[rows] = _WHOLE, self.value[codes[rows]]
        change = kind == _NUMBER
        change[1:] |= kind[1:] != kind[:-1]
        change[0] = True
        edge = np.flatnonzero(change)
        piece = kind[edge] != _SPACE
        begin, end = edge[piece], np.append(edge[1:], len(kind))[piece]
        key, is_whole, short = hashes(values, begin, end), kind[begin] == _WHOLE, end - begin <= LONG
        row = self.kept.find(key)
        new = np.flatnonzero((row < 0) & short)
        if len(new):
            fresh, at = np.unique(key[new], return_index=True)
            at = new[at]
            for bare in (True, False):
                mine = is_whole[at] != bare
                words = [whole[a:b] for a, b in zip(begin[at[mine]].tolist(), end[at[mine]].tolist(), strict=True)]
                ids, length = self.learn([w.lower() for w in words] if bare else words, bare)
                self.kept.add(fresh[mine], ids, length)
            row[new] = self.kept.find(key[new])
        start, size, flat = self.kept.begin[row], self.kept.length[row].astype(np.int64), self.kept.flat
        if not short.all():  # encoded each time
            self.kept.note(row[short])
            flat = [flat[: self.kept.size]]
            held = self.kept.size
            for k in np.flatnonzero(~short).tolist():
                w = whole[begin[k] : end[k]]
                ids, _ = self.learn([w if is_whole[k] else w.lower()], not is_whole[k])
                flat.append(ids)
                start[k], size[k], held = held, len(ids), held + len(ids)
            flat = np.concatenate(flat)
        else:
            self.kept.note(row)
        stops = np.append(0, np.cumsum(size))[np.searchsorted(begin, begins[1:])]
        out = flat[spans(start, size)]
        self.kept.prune()
        return out, stops

    def encode(self, texts: list[str]) -> Iterator[np.ndarray]:
        """Ids of each text."""
        held: list[np.ndarray] = []
        now = 0
        for some in stretches(texts, PORTION, self.breaks):
            ids, stops = self.encode_some([t for _, t in some])
            for (k, _), x in zip(some, np.split(ids, stops[:-1]), strict=True):
                if k != now:
                    yield np.concatenate(held)
                    held, now = [], k
                held.append(x)
        if held:
            yield np.concatenate(held)


_LOADED: dict[str, WordEncoder] = {}


def loaded(path: str) -> WordEncoder:
    alone(_LOADED)
    if path not in _LOADED:
        _LOADED.clear()
        _LOADED[path] = WordEncoder(path)
    return _LOADED[path]


def cuts(places: list[int], costs: list[int], limit: int = LIMIT) -> list[int]:
    """Cheapest cuts of the stream 0..places[-1]. places: ascending positions, each within limit of the one before;
    costs: of cutting there. Returns the chosen positions, the last place always among them; of equal costs the
    earlier found start wins."""
    pos = [0, *places]
    at = np.array(pos)
    # pairs of places that lie a power of two apart, in order of the later one
    later, earlier = [], []
    for k in range(limit.bit_length()):
        if 1 << k <= limit:
            found = np.searchsorted(at, at - (1 << k))
            j = np.flatnonzero(at[found] == at - (1 << k))
            later.append(j)
            earlier.append(found[j])
    order = np.argsort(np.concatenate(later), kind="stable")
    ahead, behind = [*np.concatenate(later)[order].tolist(), len(pos)], np.concatenate(earlier)[order].tolist()
    pair = 0
    total, back = [0], [0]
    queue, keys, head = [0], [0], 0
    for j in range(1, len(pos)):
        p = pos[j]
        while p - pos[queue[head]] > limit:
            head += 1
        start = queue[head]
        best = keys[head] + limit - p
        while ahead[pair] == j:
            i = behind[pair]
            pair += 1
            if total[i] < best:
                best, start = total[i], i
        best += costs[j - 1] + SEQUENCE_COST
        total.append(best)
        back.append(start)
        key = best + p
        while len(queue) > head and keys[-1] >= key:
            queue.pop()
            keys.pop()
        queue.append(j)
        keys.append(key)
    out, j = [], len(places)
    while j:
        out.append(pos[j])
        j = back[j]
    return out[::-1]


class Packer:
    """Packs one stream. add() takes documents, flush() gives settled pieces."""

    def __init__(self, sentence_end: np.ndarray, first_sequence: int, limit: int = LIMIT):
        self.ends, self.limit, self.sequence = sentence_end, limit, first_sequence
        self.docs: list[tuple[int | None, int, int]] = []  # id, position of its first id (may be negative), ids
        self.ids: list[np.ndarray] = []
        self.held = 0

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.docs.append((doc_id, self.held, len(ids)))
        self.ids.append(ids)
        self.held += len(ids)

    def places(self, ids: np.ndarray) -> tuple[list[int], list[int]]:
        cost = np.full(len(ids) + 1, -1, np.int32)
        cost[np.flatnonzero(self.ends[ids]) + 1] = SENTENCE_COST
        cost[[s + n for _, s, n in self.docs]] = 0
        cost[0] = 0
        found = np.flatnonzero(cost >= 0)
        wide = np.flatnonzero(np.diff(found) > min(GAP, self.limit))
        for k in wide:
            cost[found[k] + min(SPACING, self.limit) : found[k + 1] : min(SPACING, self.limit)] = FORCED_COST
        found = np.flatnonzero(cost >= 0)[1:]
        return found.tolist(), cost[found].tolist()

    def flush(self, last: bool) -> list[tuple]:
        if not self.held:
            return []
        ids = np.concatenate(self.ids)
        chosen = cuts(*self.places(ids), self.limit)
        if not last:
            chosen = [c for c in chosen if c <= self.held - TAIL]
        out, d, begin = [], 0, 0
        for end in chosen:
            at = begin
            while at < end:
                doc_id, s, n = self.docs[d]
                stop = min(end, s + n)
                out.append((doc_id, at - s, stop - at, zlib.crc32(ids[at:stop].astype("<u4").tobytes()), n, self.sequence, at - begin))
                at = stop
                if stop == s + n:
                    d += 1
            self.sequence += 1
            begin = end
        self.docs = [(i, s - begin, n) for i, s, n in self.docs[d:]]
        self.ids = [ids[begin:].copy()]
        self.held -= begin
        return out


def pack(docs: DataFrame, path: str | None = None, limit: int = LIMIT, end_id: int = END_ID) -> DataFrame:
    """Pack all texts into sequences of at most limit ids: one row per piece (SCHEMA). sequence_id is unique in the
    result (input partition and running number); offset counts a sequence's ids from 0 without gaps.

    Null texts count as empty: the document is its end id alone. Repeated rows are packed each; a null doc_id stays
    null. Documents longer than limit are cut. An empty table gives no rows; further columns are not read. Narrow: no
    shuffle; a task holds HORIZON ids at a time (and one document's)."""
    path = path or default_vocabulary()
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        from quillspark.llm.packing import HORIZON, Packer, loaded

        enc = loaded(path)
        packer = Packer(enc.sentence_end, TaskContext.get().partitionId() << 32, limit)
        end = np.array([end_id], "<u2")

        def rows(found):
            kinds = [pa.int64()] * 7
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*found, strict=True), kinds, strict=True)], [x.split()[0] for x in SCHEMA.split(", ")])

        for batch in parts(batches):
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for doc_id, ids in zip(batch.column(0).to_pylist(), enc.encode(texts), strict=True):
                packer.add(doc_id, np.concatenate([ids, end]))
                if packer.held >= HORIZON:
                    yield rows(packer.flush(False))
        if found := packer.flush(True):
            yield rows(found)

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text")).mapInArrow(run, SCHEMA)


def op4_packing(spark, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op4_packing": op4_packing}
ORACLES: dict[str, str] = {}
