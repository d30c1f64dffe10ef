"""Byte-level BPE by per-prefix dynamic programming.

For every prefix of a word there is exactly one token that its encoding can end with. An automaton over the
vocabulary reports, for each position, all tokens that are suffixes of the prefix ending there; a token is the last
one if the token that ends the prefix before it can stand next to it, which a walk over both tokens' merge trees
tells. One pass stores the last token of every prefix; the back-pointers then give the ids.
"""

from __future__ import annotations

import hashlib
import json
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import alone, parts, ship
from .wordhash import BORDER, LONG, Kept, hashes, joined, letter_values, spans, stretches

#: The split of the public byte-level tokenizer, as regular expression.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Pieces that a worker keeps with their ids (about 60 MB), and letters encoded at once.
CACHE_PIECES, PORTION = 1_000_000, 400_000
_SPACE, _LETTER, _NUMBER, _OTHER, _WHOLE, _BORDER = range(6)


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in the vocabulary file: printable Latin-1 bytes stand for
    themselves, the others follow from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, extra = [""] * 256, 256
    for b in range(256):
        if b in own:
            out[b] = chr(b)
        else:
            out[b] = chr(extra)
            extra += 1
    return out


def portions(texts: list[str], letters: int = 1_000_000) -> Iterator[list[str]]:
    """Consecutive texts, about so many letters at a time."""
    some: list[str] = []
    size = 0
    for t in texts:
        some.append(t)
        size += len(t)
        if size >= letters:
            yield some
            some, size = [], 0
    if some:
        yield some


def kinds() -> np.ndarray:
    """Kind of every code in the split: white space, letters, numbers, others. A word with an apostrophe, which may be
    a contraction, is split by the pattern itself."""
    import regex

    every = "".join(map(chr, (*range(0xD800), *range(0xE000, BORDER))))
    out = np.full(BORDER + 1, _OTHER, np.uint8)
    for kind, p in ((_SPACE, r"\s+"), (_LETTER, r"\p{L}+"), (_NUMBER, r"\p{N}+")):
        for m in regex.finditer(p, every):
            a, b = ord(every[m.start()]), ord(every[m.end() - 1])
            out[a : b + 1] = kind
    out[ord("'")], out[BORDER] = _WHOLE, _BORDER
    return out


class ByteBpe:
    """Encoder and decoder for one vocabulary file."""

    def __init__(self, path: str):
        import ahocorasick
        import regex

        with open(path, encoding="utf-8") as f:
            data = json.load(f)
        vocab: dict[str, int] = data["model"]["vocab"]
        letters = byte_letters()
        self.letters = {b: x for b, x in enumerate(letters)}
        back = {x: b for b, x in enumerate(letters)}
        size = max([*vocab.values(), *(t["id"] for t in data["added_tokens"])]) + 1
        if size > 65_536:
            raise ValueError("ids must fit in 16 bits")
        self.bytes: list[bytes] = [b""] * size
        for s, i in vocab.items():
            self.bytes[i] = bytes(back[x] for x in s)
        self.special: dict[str, int] = {t["content"]: t["id"] for t in data["added_tokens"]}
        for s, i in self.special.items():
            self.bytes[i] = s.encode()
        self.special_split = regex.compile("(" + "|".join(regex.escape(s) for s in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None
        never = size + len(data["model"]["merges"])
        self.rank = [-1] * size  # when the merge that makes a token happens; -1 for single bytes
        self.left, self.right = list(range(size)), list(range(size))
        self.pair: dict[tuple[int, int], int] = {}
        for r, m in enumerate(data["model"]["merges"]):
            x, y = m.split(" ") if isinstance(m, str) else m
            a, b, t = vocab[x], vocab[y], vocab[x + y]
            self.pair.setdefault((a, b), r)
            if self.rank[t] < 0:
                self.rank[t], self.left[t], self.right[t] = r, a, b
        self.never = never
        self.fits: dict[int, bool] = {}
        self.automaton = ahocorasick.Automaton()
        for s, i in vocab.items():
            self.automaton.add_word(s, (len(s), i))
        self.automaton.make_automaton()
        self.split = regex.compile(SPLIT).findall
        self.kind, self.value, self.kept = kinds(), letter_values(), Kept(CACHE_PIECES)
        self.breaks = re.compile(r"(?<=\S)[ \t\n\r]")
        self.byte_size = np.array([len(x) for x in self.bytes])
        self.byte_begin = np.cumsum(self.byte_size) - self.byte_size
        self.byte_flat = np.frombuffer(b"".join(self.bytes), np.uint8)

    def compatible(self, a: int, b: int) -> bool:
        """True if no merge ever joins the tokens a and b across their border, so that both stay side by side.

        Going back in time from the finished tokens, the later-made of the two facing symbols is undone first; while
        a pair of facing symbols existed, a merge for it must not have come before the merge that ended it. Of equal
        merges the leftmost comes first."""
        key = a << 16 | b
        known = self.fits.get(key)
        if known is not None:
            return known
        rank, pair, end = self.rank, self.pair, self.never
        x, y, ok = a, b, True
        while True:
            r = pair.get((x, y))
            if r is not None and r < end:
                ok = False
                break
            rx, ry = rank[x], rank[y]
            if rx < 0 and ry < 0:
                break
            if rx > ry:
                end, x = rx, self.right[x]
            else:
                end, y = ry + 1, self.left[y]
        if len(self.fits) > 400_000:
            self.fits.clear()
        self.fits[key] = ok
        return ok

    def words(self, mapped: list[str]) -> list[bytes]:
        """Little-endian 16-bit ids of words given in the vocabulary's letters, which must be sorted: the last token
        of a prefix depends on the prefix alone, so a word starts from the prefixes that it shares with the one
        before."""
        compatible, fits, scan = self.compatible, self.fits.get, self.automaton.iter
        out: list[bytes] = []
        last, start = array("i", [-1]), array("i", [0])
        unset, zero = array("i", [-1]), array("i", [0])
        prior = ""
        for w in mapped:
            n = len(w)
            same = 0
            for x, y in zip(prior, w):  # noqa: B905
                if x != y:
                    break
                same += 1
            del last[same + 1 :], start[same + 1 :]
            prior = w
            fill = n - same
            last += unset * fill
            start += zero * fill
            for at, (length, token) in scan(w):
                if at < same or last[at + 1] >= 0:
                    continue
                begin = at + 1 - length
                if begin:
                    before = last[begin]
                    ok = fits(before << 16 | token)
                    if ok is None:
                        ok = compatible(before, token)
                    if not ok:
                        continue
                last[at + 1], start[at + 1] = token, begin
            ids = []
            while n:
                ids.append(last[n])
                n = start[n]
            ids.reverse()
            out.append(array("H", ids).tobytes())
        return out

    def learn(self, pieces: list[str], whole: list[bool]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all these pieces, and how many each has. Those marked whole are words that the pattern splits."""
        cut = [self.split(p) if w else (p,) for p, w in zip(pieces, whole, strict=True)]
        letters = self.letters
        mapped = sorted({w.encode().decode("latin-1").translate(letters) for x in cut for w in x})
        made = dict(zip(mapped, self.words(mapped), strict=True))
        ids = [b"".join([made[w.encode().decode("latin-1").translate(letters)] for w in x]) for x in cut]
        return np.frombuffer(b"".join(ids), "<u2"), np.array([len(x) >> 1 for x in ids], np.int32)

    def encode_some(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after the other, and where each text's end. No special tokens."""
        whole, codes, begins = joined(texts)
        kind, values = self.kind[codes], self.value[codes]
        odd = np.flatnonzero(kind == _WHOLE)
        if len(odd):
            gap = np.flatnonzero((kind == _SPACE) | (kind == _BORDER))
            after = np.unique(np.searchsorted(gap, odd))
            first = np.where(after > 0, gap[after - 1] + 1, 0)
            kind[spans(first, gap[after] - first)] = _WHOLE
        edge = np.append(0, np.flatnonzero(kind[1:] != kind[:-1]) + 1)
        end, what = np.append(edge[1:], len(kind)), kind[edge]
        word, blank = (what != _SPACE) & (what != _BORDER), what == _SPACE
        b, e = edge[word], end[word]
        b = b - ((b > 0) & (codes[b - 1] == 32))  # the blank before a piece is part of it
        # of a run of white space before a piece, all but the last letter is one piece; the last, unless a blank, another
        wb, we = edge[blank], end[blank]
        last = kind[we] != _BORDER
        run = we - last
        single = last & (codes[we - 1] != 32)
        begin = np.concatenate([b, wb[run > wb], run[single]])
        end = np.concatenate([e, run[run > wb], we[single]])
        order = np.argsort(begin, kind="stable")
        begin, end = begin[order], end[order]
        key, short = hashes(values, begin, end), end - begin <= LONG
        row = self.kept.find(key)
        new = np.flatnonzero((row < 0) & short)
        if len(new):
            fresh, at = np.unique(key[new], return_index=True)
            at = new[at]
            words = [whole[x:y] for x, y in zip(begin[at].tolist(), end[at].tolist(), strict=True)]
            self.kept.add(fresh, *self.learn(words, (kind[end[at] - 1] == _WHOLE).tolist()))
            row[new] = self.kept.find(key[new])
        self.kept.note(row[short])
        start, size, flat = self.kept.begin[row], self.kept.length[row].astype(np.int64), self.kept.flat
        if not short.all():  # encoded each time
            at = np.flatnonzero(~short)
            words = [whole[x:y] for x, y in zip(begin[at].tolist(), end[at].tolist(), strict=True)]
            ids, length = self.learn(words, (kind[end[at] - 1] == _WHOLE).tolist())
            flat = np.concatenate([flat[: self.kept.size], ids])
            start[at], size[at] = self.kept.size + np.cumsum(length) - length, length
        stops = np.append(0, np.cumsum(size))[np.searchsorted(begin, begins[1:])]
        out = flat[spans(start, size)]
        self.kept.prune()
        return out, stops

    def plain(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of texts without special tokens."""
        out: list[list[np.ndarray]] = [[] for _ in texts]
        for some in stretches(texts, PORTION, self.breaks):
            ids, stops = self.encode_some([t for _, t in some])
            for (k, _), x in zip(some, np.split(ids, stops[:-1]), strict=True):
                out[k].append(x)
        return [x[0] if len(x) == 1 else np.concatenate(x) for x in out]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of whole texts; the strings of special tokens become their ids, as in the public library."""
        out: list[np.ndarray] = []
        for some in portions(texts):
            if any(s in t for s in self.special for t in some):
                cut = [[x for x in self.special_split.split(t) if x] for t in some]
                ids = iter(self.plain([x for c in cut for x in c if x not in self.special]))
                out += [np.concatenate([np.zeros(0, np.uint16), *(np.array([self.special[x]], np.uint16) if x in self.special else next(ids) for x in c)]) for c in cut]
            else:
                out += self.plain(some)
        return out

    def decode(self, ids: np.ndarray) -> str:
        return self.byte_flat[spans(self.byte_begin[ids], self.byte_size[ids])].tobytes().decode("utf-8", "replace")


_LOADED: dict[str, ByteBpe] = {}


def loaded(path: str) -> ByteBpe:
    """The encoder of this worker process."""
    alone(_LOADED)
    if path not in _LOADED:
        _LOADED.clear()
        _LOADED[path] = ByteBpe(path)
    return _LOADED[path]


def encode_decode(docs: DataFrame, path: str | None = None, with_text: bool = False) -> DataFrame:
    """Encode every text and decode it again: doc_id, n_tokens, ids_sha256, decoded_sha256; with_text adds ids and
    decoded text. Null texts count as empty (0 tokens). Rows stay one to one, repeated ids too; further columns are not
    read. Narrow: no shuffle, memory is one Arrow batch and a bounded word cache."""
    path = path or default_vocabulary()
    ship(docs.sparkSession)
    extra = ", ids array<int>, decoded string" if with_text else ""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from quillspark.llm.bpe import loaded

        enc = loaded(path)
        for batch in parts(batches):
            n, a, b, ids_out, text_out = [], [], [], [], []
            for ids in enc.encode([t or "" for t in batch.column(1).to_pylist()]):
                n.append(len(ids))
                a.append(hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest())
                decoded = enc.decode(ids)
                b.append(hashlib.sha256(decoded.encode()).hexdigest())
                if with_text:
                    ids_out.append(ids.tolist())
                    text_out.append(decoded)
            cols = [batch.column(0), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if with_text:
                cols += [pa.array(ids_out, pa.list_(pa.int32())), pa.array(text_out, pa.string())]
                names += ["ids", "decoded"]
            yield pa.RecordBatch.from_arrays(cols, names)

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text")).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + extra)


def token_counts(docs: DataFrame, path: str | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """Number of ids of every text, with the columns in keep: one row per row of docs."""
    path = path or default_vocabulary()
    ship(docs.sparkSession)
    kept = [docs[c] for c in keep]
    schema = ", ".join([*(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep), "n_tokens long"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from quillspark.llm.bpe import loaded

        enc = loaded(path)
        for batch in parts(batches):
            at = batch.num_columns - 1
            n = [len(x) for x in enc.encode([t or "" for t in batch.column(at).to_pylist()])]
            yield pa.RecordBatch.from_arrays([*batch.columns[:at], pa.array(n, pa.int64())], [*keep, "n_tokens"])

    return docs.select(*kept, docs["text"].cast("string").alias("_text")).mapInArrow(run, schema)


def op9_bpe(spark, sf_dir: str) -> DataFrame:
    return encode_decode(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op9_bpe": op9_bpe}
ORACLES: dict[str, str] = {}
