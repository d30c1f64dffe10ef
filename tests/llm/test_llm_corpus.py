"""Fill-in-middle, importance resampling and exact dedup against plain Python."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

pytest.importorskip("quillspark.llm")
from quillspark.llm import exact, fim, importance  # noqa: E402

ODD = ["", None, " ", "\n", "\n\n", "a\nb", "a\nb\n", "same Text", "same Text", "SAME text", "x<P>y\nz", "<", "<P", "S>\n<M", "é日\n本\r\nテ 🎉\n", "a\x00b\nc", "one two\x0bthree\n"]


def frame(spark, rows, ids="long"):
    """documents, with columns whose names clash with inner ones."""
    wide = [(i, t, "x", 7, {"a": 1}, b"d", 1, "f") for i, t in rows]
    return spark.createDataFrame(wide, f"doc_id {ids}, text string, digest string, row int, winner map<string,int>, data binary, bucket int, form string")


def drawn_texts(seed=3, n=200):
    r = random.Random(seed)
    words = ["der", "The", "of", "é日", "x1", "zürich", "quick", "Fox", "a", "b"] + [f"w{i}" for i in range(300)]
    return [" ".join(r.choice(words) for _ in range(r.randint(0, 60))) + r.choice(["", "\n", ".\nNext <p> line"]) for _ in range(n)]


# ---- fill-in-middle


def plain_fim(doc_id, text, pattern=r"[^\n]*\n|[^\n]+", seed="7", rate=100, spm=50):
    text = text or ""
    units = re.findall(pattern, text, re.S)
    h = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * k : 8 * k + 8], 16) for k in range(4))
    n = len(units)
    if not text or any(s in text for s in fim.SENTINELS) or h3 % 100 >= rate:
        return n, "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    x, y, z = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    return (n, "spm", len(x), len(y), f"<S>{z}<P>{x}<M>{y}") if h4 % 100 < spm else (n, "psm", len(x), len(y), f"<P>{x}<S>{z}<M>{y}")


@pytest.mark.parametrize(("unit", "pattern", "rate", "spm"), [("lines", r"[^\n]*\n|[^\n]+", 100, 50), ("chars", r".", 100, 100), ("words", r"[^ \t\n\r\f\v]*[ \t\n\r\f\v]+|[^ \t\n\r\f\v]+", 60, 0)])
def test_fim_equals_plain_python_and_is_undone(spark, unit, pattern, rate, spm):
    long = "line of words\n" * 40_000 + "end <M>"
    texts = ODD + drawn_texts() + [long, long.replace("<M>", "< M>")]
    rows = list(enumerate(texts)) + [(None, "no\nid"), (5, "a\nb"), (5, "a\nb"), (-3, "z\ny\nx")]
    out = fim.transform(frame(spark, rows), unit=unit, rate=rate, spm=spm)
    back = fim.restored(out["output"], out["form"])
    got = sorted(out.withColumn("back", back).collect(), key=repr)
    want = sorted(((i, *plain_fim(i, t, pattern, rate=rate, spm=spm), t or "") for i, t in rows), key=repr)
    assert sorted((tuple(r) for r in got), key=repr) == want
    assert {r["form"] for r in got} == ({"plain", "psm", "spm"} if 0 < spm < 100 else {"plain", "spm"} if spm else {"plain", "psm"})


def test_fim_of_an_empty_table_and_of_bad_sentinels(spark):
    assert fim.transform(frame(spark, [])).count() == 0
    for bad in (("<P>", "<P>", "<M>"), ("ab", "bc", "x"), ("aa", "b", "c"), ("", "b", "c")):
        with pytest.raises(ValueError, match="sentinel"):
            fim.checked(bad)


# ---- importance resampling


def plain_resample(docs, target, buckets=10_000, ngram=1, least=20, percent=10):
    def features(text):
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
        return len(w), [zlib.crc32(" ".join(w[i : i + k]).encode()) % buckets for k in range(1, ngram + 1) for i in range(len(w) - k + 1)]

    found = [(i, *features(t)) for i, t in docs]
    s, t = Counter(b for _, _, f in found for b in f), Counter(b for x in target for b in features(x)[1])
    all_s, all_t = sum(s.values()), sum(t.values())
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (all_s + buckets) / ((s[b] + 1) * (all_t + buckets)))) for b in s}
    out = []
    for i, words, f in found:
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in f)
        out.append([i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), words])
    order = sorted((x for x in out if x[4] >= least), key=lambda x: (-x[3], x[0] is None, x[0]))
    rank = {id(x): k + 1 for k, x in enumerate(order[: percent * len(order) // 100])}
    return [(*x[:4], rank.get(id(x))) for x in out]


@pytest.mark.parametrize(("ngram", "buckets", "percent"), [(1, 10_000, 10), (2, 64, 100), (3, 500, 50)])
def test_resampling_equals_plain_python(spark, monkeypatch, ngram, buckets, percent):
    for name, value in (("BLOCK", 16), ("BLOCK_BYTES", 3_000), ("PORTION", 150), ("SHARE", 50), ("_KEPT", 20)):
        monkeypatch.setattr(importance, name, value)
    texts = ODD + drawn_texts() + ["the fox " * 2_000, "é" * 1_000, "quick " * 25]
    rows = list(enumerate(texts)) + [(None, "der The of " * 10), (7, "der der " * 12), (7, "der der " * 12), (8, "w1 w2 " * 11)]
    target = ["The quick fox", "the of w1 w2 w3", "", None]
    docs = frame(spark, rows).repartition(3)
    aim = spark.createDataFrame([(k, t) for k, t in enumerate(target)], "item_id long, text string")
    out = importance.resample(docs, aim, buckets=buckets, ngram=ngram, percent=percent)
    want = plain_resample(rows, target, buckets, ngram, 20, percent)
    assert sorted(map(tuple, out.collect()), key=repr) == sorted(want, key=repr)


def test_words_of_portions_are_whole(monkeypatch):
    text = " ".join(drawn_texts(4, 30)).encode()
    whole = list(importance.text_buckets(text, importance._Buckets(100), 3))
    monkeypatch.setattr(importance, "PORTION", 70)
    cut = list(importance.text_buckets(text, importance._Buckets(100), 3))
    assert len(whole) == 1 < len(cut) and sum(n for n, _ in cut) == whole[0][0]
    assert Counter(np.concatenate([f for _, f in cut]).tolist()) == Counter(whole[0][1].tolist())


def test_resampling_of_empty_tables(spark):
    some = spark.createDataFrame([(1, "a few words")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, text string")
    assert importance.resample(none, some).count() == 0
    assert sorted(map(tuple, importance.resample(some, none, least_words=0, percent=100).collect())) == plain_resample([(1, "a few words")], [], least=0, percent=100)
    assert importance.drawn(some, importance.resample(some, none, least_words=0, percent=100)).collect() == some.collect()


# ---- exact dedup


def plain_dedup(rows):
    digest = [hashlib.sha256("".join(c.lower() if "A" <= c <= "Z" else c for c in t or "").encode()).hexdigest() for _, t in rows]
    sizes = Counter(digest)
    best = {d: max((i for (i, _), e in zip(rows, digest, strict=True) if e == d and i is not None), default=None) for d in sizes}
    return [(i, best[d], sizes[d], d) for (i, _), d in zip(rows, digest, strict=True)]


@pytest.mark.parametrize("rule", ["doc_id % 2 = 0", "true", "false", "doc_id < 40", "doc_id IS NULL"])
def test_exact_dedup_does_not_depend_on_what_is_history(spark, monkeypatch, rule):
    from pyspark.sql import functions as F

    monkeypatch.setattr(exact, "SHARD", 8)
    texts = ODD + drawn_texts(n=80) + ["Hot text"] * 150 + ["x" * 300_000, "X" * 300_000, "É", "é", "İ"]
    rows = list(enumerate(texts)) + [(None, "Hot Text"), (None, "only null"), (None, "only NULL"), (3, "a\nb"), (9_007_199_254_740_993, "hot text"), (9_007_199_254_740_993, "hot text")]
    got = exact.dedup(frame(spark, rows).repartition(3), F.expr(rule)).collect()
    assert sorted(((r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in got), key=repr) == sorted(plain_dedup(rows), key=repr)
    stay = [r for r in got if r["kept"]]
    assert len(stay) == len({r["text_sha256"] for r in got}) == len({r["text_sha256"] for r in stay}) and all(r["doc_id"] == r["keep_id"] for r in stay)


def test_exact_dedup_of_an_empty_table(spark):
    from pyspark.sql import functions as F

    assert exact.dedup(frame(spark, []), F.lit(True)).count() == 0


@pytest.mark.parametrize("n", [0, 1, 2, 1_000, 50_000])
def test_perfect_hash_is_minimal_and_perfect(n):
    keys = exact.as_words([hashlib.sha256(str(i).encode()).digest() for i in range(n)])
    found = exact.PerfectHash.of(keys)
    again = exact.PerfectHash.read(found.sizes, found.packed())
    assert sorted(again.slots(keys)) == list(range(n))
    others = again.slots(exact.as_words([hashlib.sha256(f"x{i}".encode()).digest() for i in range(1_000)]))
    assert (others < max(n, 1)).all() and (others >= -1).all()
    with pytest.raises(ValueError, match="distinct"):
        exact.PerfectHash.of(np.ones((2, 4), np.uint64))


def test_a_saved_history_tells_repeats_from_new_texts(spark, tmp_path):
    old, new = frame(spark, [(1, "One"), (2, "two"), (9, "three")]), frame(spark, [(5, "ONE"), (6, "four"), (7, "FOUR"), (8, "Three")])
    exact.Index.build(exact.groups(exact.digested(old))).save(str(tmp_path / "index"))
    index = exact.Index.load(spark, str(tmp_path / "index"))
    found = {r["winner"]["doc_id"]: r["slot"] for r in index.lookup(exact.groups(exact.digested(new))).collect()}
    assert set(found) == {5, 7, 8} and found[7] is None and found[5] is not None and found[8] is not None
    both, _ = exact.merged(index, exact.groups(exact.digested(new)))
    assert sorted((r["winner"]["doc_id"], r["n"]) for r in both.collect()) == [(2, 1), (5, 2), (7, 2), (9, 2)]
