"""Tokens, packing, counts, language, toxicity: against the libraries, round trips and held-out labels."""

import hashlib
import random
import zlib

import numpy as np
import pytest

pytest.importorskip("quillspark.llm")
from quillspark.llm import bpe, langid, packing, tokencount, toxicity  # noqa: E402

ODD = ["", None, " ", "\n\n\t", "don't WE'LL 's", "<|endoftext|> x", "é日本 テ 🎉", "x" * 3000, "a\x1cb\x85c\xa0d", "1a2b33 4.5,6", "µª½ İ ǅ ﬁ", "same", "same"]


def texts():
    r = random.Random(5)
    return ODD + ["".join(r.choice("aAbé'sStLl ÉßTd.,!?12µª½İ\n\x01<|>日") for _ in range(r.randint(0, 60))) for _ in range(300)]


def frame(spark, rows):
    """documents, with columns whose names clash with inner ones."""
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), "x", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, _text string, n_tokens int")


def library(path):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.no_padding()
    t.no_truncation()
    return t


def test_bpe_equals_library(spark):
    all_texts = texts()
    lib = library(bpe.default_vocabulary())
    got = {r["doc_id"]: r for r in bpe.encode_decode(frame(spark, list(enumerate(all_texts))), with_text=True).collect()}
    assert len(got) == len(all_texts)
    for i, t in enumerate(all_texts):
        ids = lib.encode(t or "", add_special_tokens=False).ids
        assert got[i]["ids"] == ids and got[i]["n_tokens"] == len(ids)
        assert got[i]["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert got[i]["decoded"] == lib.decode(ids, skip_special_tokens=False)
        assert got[i]["decoded_sha256"] == hashlib.sha256(got[i]["decoded"].encode()).hexdigest()


def test_pieces_of_any_letters_equal_the_libraries(monkeypatch):
    """Strings of letters that are hard to split or normalise, in small portions and with a table that overflows."""
    r = random.Random(7)
    pool = "aAbéÉ'sStTlLrRvVmMdDßzZ.,!?12µª½İıŉſ\n\t\r \x0b\x1c\x85\xa0\u2003\u3000日本ガギが゙́é한ᆨЖжйЙ́Σσς<|>–—‘’“”…€ĐđŠš\x00\x01ǅﬁ🎉\u200b\xad٣Ⅷ²"
    some = ["".join(r.choice(r.choice([pool, "aA's ,.", "bB  \n\n.1", "é日 ガ゙\n"])) for _ in range(r.choice([0, 1, 3, 10, 40, 120]))) for _ in range(1500)]
    some += ["<|endoftext|>", "a<|endoftext|>b <|startoftext|>c", "x" * 70 + " '" + "y" * 90, " " * 100 + "a" + "\n" * 100, "".join(some[:300])]
    for module, encoder in ((bpe, bpe.ByteBpe), (packing, packing.WordEncoder)):
        lib = library(module.default_vocabulary())
        want = [e.ids for e in lib.encode_batch(some, add_special_tokens=False)]
        for portion, most in ((module.PORTION, module.CACHE_PIECES), (200, 50)):
            monkeypatch.setattr(module, "PORTION", portion)
            e = encoder(module.default_vocabulary())
            e.kept.most = most
            assert [x.tolist() for x in e.encode(some)] == want


def brute_cost(places, costs, limit):
    best = {0: 0}
    for p, c in zip(places, costs, strict=True):
        best[p] = min(v + c + packing.SEQUENCE_COST + (0 if (p - q) & (p - q - 1) == 0 else limit - (p - q)) for q, v in best.items() if 0 < p - q <= limit)
    return best[places[-1]]


def test_cuts_are_cheapest():
    r = random.Random(2)
    for _ in range(60):
        limit = r.choice([8, 16, 20])
        places = list(np.cumsum([r.randint(1, 7) for _ in range(r.randint(1, 40))]))
        costs = [r.randint(0, 5) for _ in places]
        chosen = packing.cuts([int(p) for p in places], costs, limit)
        paid, at = 0, 0
        for c in chosen:
            n = c - at
            assert 0 < n <= limit
            paid += costs[places.index(c)] + packing.SEQUENCE_COST + (0 if n & (n - 1) == 0 else limit - n)
            at = c
        assert at == places[-1] and paid == brute_cost([int(p) for p in places], costs, limit)


def test_every_sentence_end_is_a_place_to_cut():
    """places() and cuts() together are as cheap as any choice among all document and sentence ends."""
    r = random.Random(3)
    for _ in range(60):
        limit = r.choice([16, 64, 100])
        ends = np.zeros(65_536, bool)
        ends[5] = True
        packer = packing.Packer(ends, 0, limit)
        at, every = 0, {}
        for i in range(r.randint(1, 12)):
            ids = [r.choice((7, 7, 7, 5)) for _ in range(r.randint(0, 30))] + [2]
            for k, x in enumerate(ids, at + 1):
                if x == 5:
                    every[k] = packing.SENTENCE_COST
            at += len(ids)
            every[at] = 0
            packer.add(i, np.array(ids, "<u2"))
        want = sorted(every)
        if np.diff([0, *want]).max() > limit:
            continue
        places, costs = packer.places(np.concatenate(packer.ids))
        chosen = packing.cuts(places, costs, limit)
        sizes = np.diff([0, *chosen]).tolist()
        paid = sum(every[c] + packing.SEQUENCE_COST + (0 if n & (n - 1) == 0 else limit - n) for c, n in zip(chosen, sizes, strict=True))
        assert chosen[-1] == at and max(sizes) <= limit and paid == brute_cost(want, [every[p] for p in want], limit)


def test_packing_covers_every_id_once(spark):
    rows = list(enumerate(texts() + ["word. " * 6000]))
    lib = library(packing.default_vocabulary())
    pieces = packing.pack(frame(spark, rows)).toPandas()
    for i, t in rows:
        ids = np.array([*lib.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        own = pieces[pieces.doc_id == i].sort_values("start")
        assert (own.doc_tokens == len(ids)).all() and own.length.sum() == len(ids)
        assert (own.start == own.length.cumsum() - own.length).all()
        assert all(zlib.crc32(ids[p.start : p.start + p.length].tobytes()) == p.ids_crc32 for p in own.itertuples())
    by = pieces.sort_values(["sequence_id", "offset"]).groupby("sequence_id")
    assert (by.length.cumsum() - pieces.sort_values(["sequence_id", "offset"]).length == pieces.sort_values(["sequence_id", "offset"]).offset).all()
    assert by.length.sum().max() <= packing.LIMIT


def test_empty_tables(spark):
    none = frame(spark, []).limit(0)
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert bpe.encode_decode(none).count() == packing.pack(none).count() == langid.identify(none).count() == toxicity.score(none, labels).count() == 0
    assert tokencount.answers(tokencount.histogram(none)).agg({"total_docs": "max"}).first()[0] == 0


def test_token_counts(spark):
    rows = list(enumerate(texts()))
    lib = library(bpe.default_vocabulary())
    n = np.array([len(lib.encode(t or "", add_special_tokens=False).ids) for _, t in rows])
    table = tokencount.answers(tokencount.histogram(frame(spark, rows)))
    got = table.collect()
    assert {r["context_limit"] for r in got} == set(n) | set(tokencount.LIMITS)
    for r in got:
        limit = r["context_limit"]
        assert r["n_docs"] == (n == limit).sum() and r["docs_above"] == (n > limit).sum() and r["tokens_above"] == n[n > limit].sum()
        assert r["kept_tokens"] == np.minimum(n, limit).sum() and r["lost_tokens"] == (n - np.minimum(n, limit)).sum()
        assert r["total_docs"] == len(n) and r["total_tokens"] == n.sum()
    for r in tokencount.quantiles(table, (0.25, 0.5, 1.0)).collect():
        assert r["context_limit"] == min(x["context_limit"] for x in got if x["share_within"] >= r["share"])


@pytest.mark.parametrize("stretch", [512, 7, 2, 1])
def test_cross_parse_against_plain_parse(monkeypatch, stretch):
    """Whole texts, over many stretches, among others."""
    monkeypatch.setattr(langid, "STRETCH", stretch)
    r = random.Random(3)
    trained = {"a": "abcabcabdx" * 3, "b": "zzyzxyzzab" + "abdxabcabc" * 40}
    p = langid.Parser(trained)
    texts = ["abcab zzy", "xxxx", "q", "abdxabcabc" * 200, *("".join(r.choice("abcdxyzq ") for _ in range(r.randint(1, 1300))) for _ in range(12))]
    every = p.counts([p.codes(t) for t in texts])
    for t, found in zip(texts, every.T, strict=True):
        codes = p.codes(t)
        for k, text in enumerate(trained.values()):
            inner = "".join(chr(p.code.get(c, 1) + 65) for c in text)
            whole = "".join(chr(c + 65) for c in codes)
            i = n = 0
            while i < len(whole):
                j = i + 1
                while j < len(whole) and whole[i : j + 1] in inner and whole[i:j] in inner:
                    j += 1
                i, n = j, n + 1
            assert found[k] == n


def test_every_letter_has_its_code():
    """Languages of many letters, none of them frequent: of two that differ in letters alone each knows its own."""
    r = random.Random(6)
    words = {k: ["".join(chr(r.randrange(a, a + 512)) for _ in range(3)) for _ in range(400)] for k, a in (("a", 0x4E00), ("b", 0x6000), ("c", 0x7000))}
    draw = lambda k, n: "".join(r.choice(words[k]) for _ in range(n))
    p = langid.Parser({k: draw(k, 3000) for k in words})
    assert [p.predict([draw(k, 60)])[0][0] for k in words for _ in range(10)] == [k for k in words for _ in range(10)]
    assert p.counts([p.codes("\u9000" * 50)])[:, 0].tolist() == [50, 50, 50]


def test_sparse_transitions_equal_the_automaton():
    r = random.Random(8)
    for letters, size in ((3, 300), (40, 4000), (900, 5000)):
        moves = langid.suffix_automaton([r.randrange(letters) for _ in range(size)])
        t = langid.Transitions(moves, letters)
        state = np.repeat(np.arange(len(moves)), letters)[: 2_000_000]
        code = np.tile(np.arange(letters), len(moves))[: 2_000_000]
        assert t.follow(state.astype(np.int32), code.astype(np.int32)).tolist() == [moves[s].get(c, -1) for s, c in zip(state.tolist(), code.tolist(), strict=True)]


def test_no_document_fills_the_sample():
    got = langid.shared(["a" * 100_000, "b" * 10, "c" * 300], 400)
    assert got[1:] == ["b" * 10, "c" * 193] and got[0] == "a" * 193
    assert langid.shared(["ab", "c"], 400) == ["ab", "c"]


def test_every_language_is_learned(spark):
    rows = [(10 * i + k, chr(0x4E00 + i) * 30, f"l{i:03d}") for i in range(300) for k in range(2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    learned = langid.sample(docs)
    want = {r["lang"] for r in docs.filter(langid.learns(docs["doc_id"], langid.FOLDS)).select("lang").collect()}
    assert set(learned) == want and len(want) > 256


def test_language_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = langid.identify(docs).toPandas().merge(docs.select("doc_id", "lang").toPandas(), on="doc_id")
    held = got[got.held_out]
    assert len(held) > 10 and (held.lang == held.lang_pred).mean() > 0.9 and got.score.between(0, 1).all()
    odd = {r["doc_id"]: r for r in langid.identify(docs.select("doc_id", "text", "lang").union(spark.createDataFrame([(-1, None, "en"), (-2, " 12 .", "en"), (None, "the", None)], "doc_id long, text string, lang string"))).collect()}
    assert odd[-1]["lang_pred"] == odd[-2]["lang_pred"] == "und" and odd[None]["lang_pred"] != "und"


def test_toxicity_gradient():
    r = np.random.default_rng(0)
    net = toxicity.Network.fresh(np.zeros(5, np.float32), ["abcde"], np.zeros(1, np.float32))
    words = ["ab", "abcde", "x", "yz", "q"]
    gate = net.gates(np.arange(5), words)
    ids = r.integers(0, 5, (toxicity.WINDOW, 3))
    lengths = np.array([toxicity.WINDOW, 10, 1])
    d = np.array([0.5, -1.0, 2.0], np.float32)
    _, kept = net.forward(gate, ids, lengths, True)
    grads, _ = net.backward(d, kept)
    for k in ("uf", "ub", "att", "att_v", "out"):
        at = tuple(r.integers(0, n) for n in net.p[k].shape)
        net.p[k] = net.p[k].astype(np.float64)
        net.p[k][at] += 1e-3
        up = float(net.forward(gate, ids, lengths) @ d)
        net.p[k][at] -= 2e-3
        down = float(net.forward(gate, ids, lengths) @ d)
        net.p[k][at] += 1e-3
        assert abs((up - down) / 2e-3 - grads[k][at]) < 2e-2 * max(1, abs(grads[k][at]))


def test_toxicity_scores_against_a_plain_network():
    """Both recurrences, attention and the worst of all windows, step by step in plain numpy."""
    r = random.Random(4)
    words = ["sun", "moon", "tree", "river", "awful", "stone"]
    texts = [" ".join(r.choice(words) for _ in range(r.randint(1, 40))) for _ in range(60)]
    model = toxicity.train(texts, [int("awful" in t) for t in texts], [1.0] * 60)
    p, h = {k: v.astype(float) for k, v in model["p"].items()}, toxicity.HIDDEN
    row, stem = {w: i for i, w in enumerate(model["vocabulary"])}, {w: i for i, w in enumerate(model["stems"])}
    gate = lambda x: 1 / (1 + np.exp(-x))

    def inputs(w):
        tri, _ = toxicity.trigrams([w])
        return np.concatenate([p["words"][row.get(w, len(row))], p["stems"][stem.get(w[: toxicity.STEM_LETTERS], len(stem))], p["chars"][tri].mean(axis=0)])

    def logit(ws):
        states = []
        for k, order in (("f", ws), ("b", ws[::-1])):
            s, out = np.zeros(h), []
            for w in order:
                a, b = inputs(w) @ p[f"w{k}"] + p[f"c{k}"], s @ p[f"u{k}"]
                z, g = gate(a[:h] + b[:h]), gate(a[h : 2 * h] + b[h : 2 * h])
                c = np.tanh(a[2 * h :] + g * b[2 * h :])
                s = (1 - z) * c + z * s
                out.append(s)
            states.append(out if k == "f" else out[::-1])
        states = np.hstack(states)
        e = np.exp(np.tanh(states @ p["att"] + p["att_b"]) @ p["att_v"])
        return float((e / e.sum()) @ states @ p["out"] + p["out_b"][0])

    some = [*texts[:8], "", "unknownword awfully sun", " ".join(r.choice([*words, "new"]) for _ in range(300)), "awful"]
    a, b = model["scale"]
    for t, got in zip(some, toxicity.Scorer(model).scores(some), strict=True):
        ws = t.split()
        last = max(0, len(ws) - (toxicity.WINDOW - toxicity.STRIDE))
        tops = [logit(ws[i : i + toxicity.WINDOW]) for i in range(0, max(1, last), toxicity.STRIDE)] if ws else None
        want = 1 / (1 + np.exp(-(a * max(tops) + b))) if ws else (model["base"] if model["base"] < 0.5 else 0.0)
        assert abs(got - want) < 1e-3


def test_windows_cover_and_overlap():
    owner, begin, length = toxicity.windows(np.array([0, 1, 64, 65, 200]))
    for i, n in enumerate((0, 1, 64, 65, 200)):
        seen = {w for b, m in zip(begin[owner == i], length[owner == i], strict=True) for w in range(b, b + m)}
        assert seen == set(range(n))


def test_toxicity_learns(spark):
    r = random.Random(1)
    plain = [" ".join(r.choice("sun moon tree river stone cloud field grass".split()) for _ in range(90)) for _ in range(240)]
    rows, labels = [], []
    for i, t in enumerate(plain):
        bad = i % 3 == 0
        rows.append((i, t + " awfulword" if bad else t))
        labels.append((i, 1, int(bad)))
    rows += [(900, None), (901, ""), (902, "tree awfulwords river"), (902, "tree awfulwords river")]
    got = toxicity.score(frame(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).toPandas()
    held = got[got.held_out & (got.doc_id < 240)]
    assert (held.predicted == (held.doc_id % 3 == 0)).mean() > 0.95 and got.score.between(0, 1).all()
    assert (got[got.doc_id.isin([900, 901])].predicted == 0).all() and got[got.doc_id == 902].score.nunique() == 1
    none = toxicity.score(frame(spark, rows), spark.createDataFrame([], "doc_id long, quality int, toxic int")).toPandas()
    assert (none.score == 0).all()
