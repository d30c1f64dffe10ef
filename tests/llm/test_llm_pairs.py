"""Vectors, near-duplicate texts, language model, quotations and the pipeline: against brute force."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

pytest.importorskip("quillspark.llm")
from quillspark.llm import lm, ngram, quotes, vectors  # noqa: E402
from quillspark.llm.common import components, tiled  # noqa: E402

VECTORS = "vec_id long, embedding array<float>, label int, score string"


def some_vectors(n=400, dim=8, seed=3):
    r = np.random.default_rng(seed)
    x = r.standard_normal((n, dim)).astype(np.float32)
    for i in range(0, n, 3):  # near copies, copies and multiples
        x[i] = x[(i * 7 + 1) % n] + r.standard_normal(dim).astype(np.float32) * r.choice([0, 0.05, 0.12])
    x[10] = x[11] * 3
    rows = [(i, [float(v) for v in x[i]], int(i % 2), "s") for i in range(n)]
    return [*rows, (n, None, 1, "s"), (n + 1, [0.0] * dim, 1, "s"), (n + 2, [float("nan")] * dim, 1, "s"), (n + 3, [1.0] * dim, None, "s"), (n + 20, [None] * dim, 0, "s"), (n + 5, [float("inf")] * dim, 0, "s"), (n + 6, [], 0, "s")]


def test_top_k(spark):
    rows = some_vectors()
    got = {tuple(r) for r in vectors.exact_top_k(spark.createDataFrame(rows, VECTORS)).select("query_id", "rank", "vec_id", "score").collect()}
    fine = {i: np.floor(64 * np.array(v, float)) for i, v, *_ in rows if v and all(c is not None and math.isfinite(c) for c in v)}
    want = set()
    for q in fine:
        if q % 20 == 0:
            best = sorted((-int(fine[q] @ fine[p]), p) for p in fine if p != q)[:20]
            want |= {(q, k + 1, p, -s) for k, (s, p) in enumerate(best)}
    assert got == want


def test_top_k_few(spark):
    rows = [(0, [1.0, 2.0], 1, "s"), (20, [1.0, 2.0], 1, "s"), (21, [1.0, 2.0], 1, "s")]
    got = sorted(tuple(r) for r in vectors.exact_top_k(spark.createDataFrame(rows, VECTORS)).select("query_id", "vec_id").collect())
    assert got == [(0, 20), (0, 21), (20, 0), (20, 21)]
    assert vectors.exact_top_k(spark.createDataFrame([], VECTORS)).count() == vectors.near_duplicates(spark.createDataFrame([], VECTORS)).count() == 0


@pytest.mark.parametrize("tile", [2048, 16])
def test_near_vectors(spark, monkeypatch, tile):
    monkeypatch.setattr(vectors, "TILE", tile)
    rows = some_vectors()
    got = {r["vec_id"]: r for r in vectors.near_duplicates(spark.createDataFrame(rows, VECTORS)).collect()}
    assert len(got) == len(rows)
    unit = {i: np.array(v, float) / np.linalg.norm(v) for i, v, label, _ in rows if label is not None and v and all(c is not None and math.isfinite(c) for c in v) and any(v)}
    links = {i: {j for j in unit if j != i and rows_label(rows, i) == rows_label(rows, j) and unit[i] @ unit[j] >= 0.98} if i in unit else set() for i, *_ in rows}
    total, found = sum(map(len, links.values())), sum(r["n_links"] for r in got.values())
    assert total > 20 and found == total
    comp = brute_components(links)
    assert all(got[i]["component_id"] == comp[i] for i in comp)
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in got.values())


def test_repeated_ids_of_vectors(spark):
    """Rows that share an id are rows of their own, in searches and links."""
    near = [1.0, 0.0, 0.0], [1.0, 0.01, 0.0], [1.0, 0.0, 0.01]
    rows = [(5, near[0], 1, "s"), (5, [0.0, 0.0, 9.0], 1, "s"), (7, near[1], 1, "s"), (8, near[2], 1, "s"), (None, near[0], 1, "s"), (9, near[0], None, "s")]
    got = sorted((r["vec_id"] or -1, r["n_links"], r["component_id"] or -1, r["kept"]) for r in vectors.near_duplicates(spark.createDataFrame(rows, VECTORS)).collect())
    assert got == [(-1, 0, -1, True), (5, 0, 5, True), (5, 2, 5, True), (7, 2, 5, False), (8, 2, 5, False), (9, 0, 9, True)]
    rows = [(0, [1.0, 2.0], 1, "s"), *[(5, [float(k), 1.0], 1, "s") for k in range(6)], (20, [3.0, 3.0], 1, "s"), (20, [3.0, 3.0], 1, "s")]
    got = sorted(tuple(r) for r in vectors.exact_top_k(spark.createDataFrame(rows, VECTORS)).select("query_id", "rank", "vec_id", "score").collect())
    assert [r[:3] for r in got if r[0] == 0] == [(0, 1, 20), (0, 2, 20), *[(0, k, 5) for k in range(3, 9)]]
    assert len([r for r in got if r[0] == 20]) == 16 and [{r[2] for r in got if r[0] == 20 and r[1] == k} for k in (1, 2)] == [{5}, {20}]  # a tie goes to the smaller id


@pytest.mark.parametrize("query", ["op1_top_k", "op10_near_dedup"])
def test_vectors_against_sql(spark, query, tmp_path):
    import duckdb

    spark.createDataFrame([*some_vectors(300), (5, [0.5] * 8, 1, "s"), (20, [0.5] * 8, 1, "s"), (20, [0.1] * 8, 1, "s")], VECTORS).coalesce(1).write.parquet(f"{tmp_path}/embeddings.parquet")
    c = duckdb.connect()
    c.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    sql = c.sql(vectors.ORACLES[query])
    got = vectors.QUERIES[query](spark, str(tmp_path)).select(*sql.columns).collect()
    assert Counter(map(str, sql.fetchall())) == Counter(str(tuple(r)) for r in got)


def test_cover_tree():
    """Covering, separation, nesting; every row below one leaf; and the search against brute force."""
    r = np.random.default_rng(5)
    middles = r.standard_normal((12, 6)) * 300
    x = np.floor(np.concatenate([m + r.standard_normal((200, 6)) * r.choice([1, 10, 40]) for m in middles]))
    x = np.concatenate([x, np.repeat(x[:1], 300, axis=0)])
    t = vectors.CoverTree(x)
    assert sorted(t.order.tolist()) == list(range(len(x))) and len(t.begin) > 30
    for k, children in enumerate(t.children):
        rows = x[t.order[t.begin[k] : t.end[k]]]
        assert np.sqrt(((rows - t.centre[k]) ** 2).sum(axis=1)).max() <= t.radius[k] + 1e-9 and (t.radius[k] == 0 or t.radius[k] <= vectors.BASE ** t.level[k] * (1 + 1e-9))
        if children:
            c, below = t.centre[children], vectors.BASE ** (t.level[k] - 1)
            gaps = np.sqrt(((c[:, None] - c[None]) ** 2).sum(axis=2))[np.triu_indices(len(c), 1)]
            assert (gaps > below).all() and max(t.radius[i] for i in children) <= below and (c == t.centre[k]).all(axis=1).any()
            assert sorted((t.begin[i], t.end[i]) for i in children)[0][0] == t.begin[k] and sum(t.end[i] - t.begin[i] for i in children) == t.end[k] - t.begin[k]
    ids = r.permutation(len(x)) // 2
    rows = np.arange(len(x))
    q = np.arange(0, len(x), 9)
    for large in (1, 2**18):
        a, b, s = vectors.top_of_block(x[q] * large, rows[q], x * large, ids, rows, 20)
        got = {}
        for i, j, v in zip(a, b, s, strict=True):
            got.setdefault(q[i], []).append((-int(v), int(j)))
        for i in q.tolist():
            scores = x.astype(np.int64) @ x[i].astype(np.int64) * large * large
            assert sorted(got[i]) == sorted((-int(scores[j]), int(ids[j])) for j in rows if j != i)[:20]


def test_hot_groups_are_spread(spark):
    """Without broadcasts of any size but the hot keys', no task gets much more than its share."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        rows = spark.range(6000).selectExpr("CASE WHEN id % 3 = 0 THEN 0 ELSE id div 4 END AS g", "id")
        x = tiled(rows, ["g"], "id", 100, [])[0].repartition(16, "g", "tile_i", "tile_j")
        sizes = sorted(r["count"] for r in x.groupBy(F.spark_partition_id()).count().collect())
        assert sizes[-1] < 3 * sizes[len(sizes) // 2]
        hub = spark.range(1, 5000).selectExpr("id AS a", "CAST(0 AS LONG) AS b")
        assert components(hub).filter("component = 0").count() == 5000
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.enabled")


def rows_label(rows, i):
    return next(r[2] for r in rows if r[0] == i)


def brute_components(links):
    out = {i: i for i in links}
    changed = True
    while changed:
        changed = False
        for i, js in links.items():
            low = min([out[i], *(out[j] for j in js)])
            for j in (i, *js):
                if out[j] > low:
                    out[j], changed = low, True
    return out


def test_components_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101), (102, 101), (5, 5)], "a long, b long")
    got = dict(components(edges).collect())
    assert got == {**dict.fromkeys(range(61), 0), 100: 100, 101: 100, 102: 100}


def test_components_without_hubs_ask_for_no_broadcast(spark, monkeypatch):
    """op2: a broadcast of hot keys in every round filled the driver; edges of a hub are still spread."""
    from quillspark.llm import common

    asked, attach = [], common.attached
    monkeypatch.setattr(common, "attached", lambda *a, **k: asked.append(1) or attach(*a, **k))
    edges = [(i, i * 7 % 300) for i in range(300) if i % 5] + [(i + 1_000, i // 2 + 1_000) for i in range(1, 90)]
    links = {x: [] for e in edges for x in e}
    for a, b in edges:
        links[a].append(b)
        links[b].append(a)
    rows = lambda e: spark.createDataFrame(e, "a long, b long")
    assert dict(components(rows(edges)).collect()) == brute_components(links) and not asked
    hub = [(5_000, 5_000 + i) for i in range(1, 400)] + [(5_001, 4_000)]
    assert set(components(rows(hub)).toPandas()["component"]) == {4_000} and asked


def test_tiles_meet_once(spark):
    rows = [("hot", i) for i in range(50)] + [("one", 99), ("two", 1), ("two", 2)]
    got = tiled(spark.createDataFrame(rows, "g string, id long"), ["g"], "id", 7, [])[0].collect()
    seen = Counter()
    cells = {}
    for r in got:
        cells.setdefault((r["g"], r["tile_i"], r["tile_j"]), []).append(r)
    for (_, i, j), rs in cells.items():
        for a in rs:
            for b in rs:
                if a["id"] < b["id"] and {a["tile_own"], b["tile_own"]} == {i, j}:
                    seen[a["g"], a["id"], b["id"]] += 1
    assert len(seen) == 50 * 49 // 2 + 1 and set(seen.values()) == {1}


def near_texts():
    r = random.Random(4)
    base = [" ".join(r.choice("alpha beta gamma delta eps zeta eta theta iota kappa lam mu nu".split()) + str(r.randint(0, 9)) for _ in range(r.randint(6, 80))) for _ in range(40)]
    out = []
    for i, t in enumerate(base):
        out.append(t)
        for _ in range(i % 4):
            w = t.split()
            w[r.randrange(len(w))] = "changed"
            out.append(" ".join(w))
    return [*out, base[0], base[0].upper(), "two words", "Two  words!", "", None, "!!", "one"]


@pytest.mark.parametrize("tile", [2048, 5])
def test_near_texts(spark, monkeypatch, tile):
    monkeypatch.setattr(ngram, "TILE", tile)
    all_texts = near_texts()
    rows = [(i, t, "x") for i, t in enumerate(all_texts)]
    got = {r["doc_id"]: r for r in ngram.near_duplicates(spark.createDataFrame([*rows, (None, "two words", "x")], "doc_id long, text string, sig string")).collect()}
    assert len(got) == len(rows) + 1 and got[None]["n_links"] == 0

    def shingles(t):
        w = re.findall(r"\w+", (t or "").lower())
        n = min(5, len(w))
        return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if n else set()

    sets = [shingles(t) for t in all_texts]
    links = {i: {j for j in range(len(sets)) if j != i and sets[i] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])} for i in range(len(sets))}
    comp = brute_components(links)
    for i in links:
        assert got[i]["n_links"] == len(links[i]) and got[i]["class_id"] == comp[i] and got[i]["kept"] == (comp[i] == i)


def test_near_texts_repeated_ids(spark):
    t = "a b c d e f g h i j"
    rows = [(1, t), (1, t), (2, t), (3, "k l m n o p q"), (3, "r s t u v w x"), (4, "r s t u v w x")]
    got = ngram.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == len(rows) and all(r["n_links"] == 2 for r in got if r["doc_id"] in (1, 2))
    assert ngram.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_posterior_bound():
    least = ngram.least_agreeing(0.8, 1e-5)
    n = 40
    grid = np.linspace(0, 1, 20001)
    for m in (int(least[n]) - 1, int(least[n])):
        p = grid**m * (1 - grid) ** (n - m)
        assert (p[grid >= 0.8].sum() / p.sum() < 1e-5) == (m < least[n])


def test_language_model(spark):
    r = random.Random(9)
    words = [f"w{i}" for i in range(40)]
    rows = [(i, " ".join(words[min(39, int(r.expovariate(0.2)))] + ("" if r.random() < 0.97 else str(r.randint(0, 999))) for _ in range(r.randint(1, 60)))) for i in range(300)]
    rows += [(300, None), (301, ""), (302, "W1\x0bw2 w3 É"), (302, "W1\x0bw2 w3 É"), (None, "w1 w2")]
    got = lm.score(spark.createDataFrame([(i, t, 1.0) for i, t in rows], "doc_id long, text string, score double")).collect()
    assert len(got) == len(rows)
    lower = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    toks = [[*re.findall("[^\x20\x09-\x0d]+", (t or "").translate(lower)), None] for _, t in rows]
    learn = [i is not None and zlib.crc32(str(i).encode()) % 10 != 0 for i, _ in rows]
    c = Counter(w for t, ok in zip(toks, learn, strict=True) if ok for w in t)
    total, types = sum(c.values()), len(c)
    want = Counter()
    for (i, _), t in zip(rows, toks, strict=True):
        want[i, len(t), sum(c[w] > 0 for w in t), total, round(sum(math.log10((c[w] + 0.1) / (total + 0.1 * (types + 1))) for w in t), 6)] += 1
    assert Counter((x["doc_id"], x["n_tokens"], x["n_known"], x["train_tokens"], round(x["base_score"], 6)) for x in got) == want
    held = [x for x in got if x["held_out"]]
    assert held and sum(x["score"] for x in held) > sum(x["base_score"] for x in held) and all(x["score"] <= 0 for x in got)
    assert lm.score(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def octave(c):
    return c.bit_length()


def test_language_model_scores_against_plain_counts(spark, monkeypatch):
    """The interpolated score, from counters of words, pairs and triples; in many small chunks."""
    monkeypatch.setattr(lm, "chunk_size", lambda letters: 200)
    r = random.Random(12)
    words = [f"w{i}" for i in range(25)]
    rows = [(i, " ".join(words[min(24, int(r.expovariate(0.25)))] for _ in range(r.randint(0, 40)))) for i in range(150)]
    rows += [(i + 1000, rows[i][1]) for i in range(0, 60, 2)] + [(5000, None)]
    got = {x["doc_id"]: x["score"] for x in lm.score(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    toks = {i: [*(t or "").split(), None] for i, t in rows}
    learn = {i for i in toks if zlib.crc32(str(i).encode()) % 10 != 0}
    c1, c2, c3, docs = Counter(), Counter(), Counter(), len(learn)
    grams = lambda t: zip([None, None, *t], [None, *t], t)
    for i in learn:
        for a, b, w in grams(toks[i]):
            c1[w] += 1
            c2[b, w] += 1
            c3[a, b, w] += 1
    two_before = lambda a, b, k: docs if k == 0 else c2[a, b]
    total = sum(c1.values())
    model = lm.Model(len(c1), total, sum(n == 1 for n in c1.values()))
    q = lambda n: round(4 * math.log2(n)) if n else 0
    cells = Counter()
    for (b, w), n in c2.items():
        cells[octave(c1[b] - 1) << 24 | q(c1[w]) << 16 | q(c1[b]) << 8 | (1 + q(n - 1) if n > 1 else 0)] += n
    model.two = lm.weights([lm._two_cell(model, k, n) for k, n in cells.items()])
    below = lambda *x: float(model.below(*(np.array([v]) for v in x[:3]), x[3])[0])
    cells = Counter()
    for i in learn:
        for k, (a, b, w) in enumerate(grams(toks[i])):
            two = two_before(a, b, k) - 1
            if two > 0:
                n, p2 = c3[a, b, w] - 1, below(c1[w] - 1, c1[b] - 1, c2[b, w] - 1, total - 1)
                cells[octave(two), round(-4 * math.log2(n / two)) if n else None, round(-4 * math.log2(p2))] += 1
    model.three = lm.weights([(k, 0.0 if x is None else 2 ** (-x / 4), 2 ** (-y / 4), n) for (k, x, y), n in cells.items()])
    for i, t in toks.items():
        want = 0.0
        for k, (a, b, w) in enumerate(grams(t)):
            two = two_before(a, b, k)
            v = model.three.get(octave(two), (0.0,))[0] if two else 0.0
            want += math.log10(v * c3[a, b, w] / max(two, 1) + (1 - v) * below(c1[w], c1[b], c2[b, w], total))
        assert abs(got[i] - want) < 1e-6, i


def test_counts_beyond_32_bits():
    import pandas as pd

    keys = np.array([3, 9], np.uint64)
    blocks = [lm._blocks(c, keys, np.array([n, 1]), None, 1, 64).to_pandas() for c, n in ((1, 6_000_000_000), (2, 5))]
    out = lm.count_words(pd.concat(blocks))
    assert [lm.unsqueeze(x, np.int64, 2).tolist() for x in out["counts"]] == [[6_000_000_005, 2]] * 2 and out["total"].sum() == 6_000_000_007


def test_mixture_is_a_distribution():
    mix = lm.weights([(1, 0.5, 0.1, 0.001, 10.0), (1, 0.0, 0.2, 0.001, 5.0), (2, 0.9, 0.01, 0.001, 3.0)])
    assert all(abs(sum(w) - 1) < 1e-9 and min(w) > 0 for w in mix.values())


CONVERSATIONS = [
    (1, 0, "user", "Hello there friend.\nHow are you?"),
    (1, 1, "assistant", "Fine, thanks, and well.\n\nAnd you?"),
    (1, 2, "user", "On Monday X wrote:\n> Hello there   friend.\n> How are you?\nI said that."),
    (1, 3, "user", "> > Hello there friend.\n> fine, THANKS,  and well.\nGood"),
    (2, 0, "user", "new conv"),
    (2, 5, "user", "> Fine, thanks, and well.\nquoting other"),
    (6, 0, "user", "ok"),
    (7, 4, "user", "> ok\ntoo short a line to come from elsewhere"),
    (3, None, "user", "x"),
    (None, 1, "user", None),
    (4, 0, "user", None),
    (4, 1, "user", ""),
    (4, 1, "user", ""),
    (5, 0, "user", "> nobody said this\nok"),
]


def test_quotes(spark):
    got = quotes.reply_ordered(spark.createDataFrame([(*r, 1) for r in CONVERSATIONS], "conv_id long, turn long, role string, text string, root_turn int")).collect()
    assert len(got) == len(CONVERSATIONS)
    x = {(r["conv_id"], r["turn"]): r for r in got}
    assert x[1, 2]["own_text"] == "I said that." and (x[1, 2]["reply_turn"], x[1, 2]["linked"], x[1, 2]["reply_depth"]) == (0, True, 1)
    assert (x[1, 3]["reply_turn"], x[1, 3]["n_quoted"], x[1, 3]["reply_depth"], x[1, 3]["position"]) == (1, 2, 2, 3)
    assert (x[2, 5]["reply_conv"], x[2, 5]["reply_turn"], x[2, 5]["linked"], x[2, 5]["root_turn"]) == (1, 1, True, 0)
    assert x[7, 4]["reply_conv"] is None and not x[7, 4]["linked"]
    assert x[5, 0]["reply_turn"] is None and not x[5, 0]["linked"] and x[5, 0]["own_text"] == "ok"
    assert x[3, None]["position"] is None and x[None, 1]["own_text"] == ""
    assert sorted(r["position"] for r in got if r["conv_id"] == 4) == [0, 1, 2]
    assert quotes.reply_ordered(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0
    import duckdb
    import pandas as pd

    c = duckdb.connect()
    conversations = pd.DataFrame(CONVERSATIONS, columns=["conv_id", "turn", "role", "text"]).astype({"conv_id": "Int64", "turn": "Int64"})
    c.register("conversations", conversations)
    sql = c.sql(quotes.ORACLES["op7_chat_format"])
    assert sorted(map(str, sql.fetchall())) == sorted(str(tuple(r[k] for k in sql.columns)) for r in got)


def test_long_conversation(spark):
    """Longer than a block: each replies to the one before, but for one that quotes the first."""
    rows = [(7, 2 * i, "u", f"message number {i}") for i in range(1100)]
    rows[900] = (7, 1800, "u", "> message number 0\nback")
    got = {r["turn"]: r for r in quotes.reply_ordered(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert got[1798]["reply_depth"] == 899 and got[1800]["reply_depth"] == 1 and got[1802]["reply_depth"] == 2
    assert sorted(r["position"] for r in got.values()) == list(range(1100)) and all(r["root_turn"] == 0 for r in got.values())


def test_all_reply_to_one(spark):
    """Thousands of replies to one message, far apart in turn: no block of the orders holds them all."""
    rows = [(7, 0, "u", "the first message of all"), *((7, 3 * i, "u", f"> the first message of all\nanswer {i}") for i in range(1, 2000))]
    got = {r["turn"]: r for r in quotes.reply_ordered(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert all(r["reply_turn"] == 0 and r["reply_depth"] == 1 for t, r in got.items() if t)
    assert [got[t]["position"] for t in sorted(got)] == list(range(2000))


def test_native_plan(spark):
    plan = quotes.op7_chat_format(spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_pipeline(spark):
    import corpus_pipeline

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    d, columns = "/root/testdata/sf0.001", docs.columns
    extra = spark.createDataFrame([(10**6, None, "en", "s", 0), (10**6 + 1, "123 !", "en", "s", 5)], docs.schema)
    docs = docs.union(extra)
    left = corpus_pipeline.STAGES[0][1](spark, docs, d)
    assert left.columns == columns and left.count() == docs.count() - 2 - docs.filter("NOT text RLIKE '\\\\p{L}'").count() + extra.filter("doc_id = 1000001").count()
    left = corpus_pipeline.STAGES[2][1](spark, left, d)
    assert left.columns == columns
    kept = {r["doc_id"] for r in ngram.near_duplicates(docs).filter("kept").collect()}
    assert {r["doc_id"] for r in left.select("doc_id").collect()} == kept - {10**6, 10**6 + 1}


def test_pipeline_near_duplicates_by_text(spark):
    """Ids that come with several texts: each text is judged for itself, whatever its id's other texts are."""
    import corpus_pipeline

    long = " ".join(f"w{i}" for i in range(60))
    rows = [
        (3, "k l m n o p q"),
        (3, "r s t u v w x"),
        (4, "r s t u v w x"),
        (5, long + " end"),
        (5, "a text of its own that is like no other"),
        (2, long),
        (2, long + "!"),
        (6, "one two three four five six"),
        (6, "one two three four five six"),
        (7, ""),
        (7, ""),
        (7, "!!"),
        (8, None),
        (None, long),
    ]
    docs = spark.createDataFrame([(i, t, "en", "s", n) for n, (i, t) in enumerate(rows)], "doc_id long, text string, lang string, source string, n_chars long")
    left = corpus_pipeline.near_duplicates(spark, docs, "")
    assert left.columns == docs.columns
    want = [rows[k] for k in (0, 1, 4, 5, 7, 9, 11, 12, 13)]
    assert sorted(map(str, want)) == sorted(str((r["doc_id"], r["text"])) for r in left.collect())


def test_near_texts_against_sql(spark):
    import duckdb

    c = duckdb.connect()
    c.sql("CREATE VIEW documents AS SELECT * FROM '/root/testdata/sf0.001/documents.parquet'")
    sql = c.sql(ngram.ORACLES["op2_ngram_jaccard"])
    got = ngram.op2_ngram_jaccard(spark, "/root/testdata/sf0.001").select(*sql.columns).collect()
    assert Counter(map(str, sql.fetchall())) == Counter(str(tuple(r)) for r in got)


def test_pipeline_stage_by_stage(spark, tmp_path):
    """Each stage against brute force over what the one before kept; run() gives what the stages give. The table has
    null, empty, wordless, toxic and repeated texts, copies, near copies, and columns with the names that stages add."""
    import corpus_pipeline

    from quillspark.llm import packing, toxicity

    r = random.Random(3)
    plain = lambda n: " ".join(r.choice("sun moon tree river stone cloud field grass hill lake".split()) + r.choice("abcdefgh") for _ in range(n))
    texts = [plain(r.randint(30, 120)) for _ in range(220)]
    for i in range(0, 220, 3):
        texts[i] += " awfulword" * 2
    near = texts[1].split()
    near[5] = "changed"
    texts += [texts[1], " ".join(near), texts[1], None, "", "123 !", texts[2].upper()]
    rows = [(i, t, "en" if t and i % 2 else "de", "s", len(t or ""), "x", 7) for i, t in enumerate(texts)]
    rows.append(rows[4])
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, lang_pred string, toxic_predicted int")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    labels = spark.createDataFrame([(i, 1, int(i % 3 == 0)) for i in range(220)], "doc_id long, quality int, toxic int")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    now = spark.read.parquet(f"{tmp_path}/documents.parquet")
    key = lambda d: Counter((x["doc_id"], x["text"]) for x in d.collect())
    stages = dict(corpus_pipeline.STAGES)
    kept = stages["language"](spark, now, str(tmp_path))
    assert kept.columns == now.columns and key(kept) == Counter({k: n for k, n in key(now).items() if any(c.isalpha() for c in k[1] or "")})
    clean = stages["toxicity"](spark, kept, str(tmp_path))
    want = {x["doc_id"] for x in toxicity.score(kept, labels).collect() if x["predicted"] == 0}
    assert clean.columns == now.columns and key(clean) == Counter({k: n for k, n in key(kept).items() if k[0] in want})
    assert len([i for i in want if i < 220 and i % 3]) > 130 and len([i for i in want if i < 220 and i % 3 == 0]) < 10
    single = stages["near_duplicates"](spark, clean, str(tmp_path))
    sets = {}
    for i, t in key(clean):
        w = re.findall(r"\w+", t.lower())
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))}
    links = {i: {j for j in sets if j != i and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])} for i in sets}
    assert single.columns == now.columns and Counter(i for i, _ in key(single).elements()) == Counter(i for i, low in brute_components(links).items() if i == low)
    pieces = corpus_pipeline.run(spark, str(tmp_path)).toPandas()
    enc = packing.WordEncoder(packing.default_vocabulary())
    for i, t in key(single):
        own = pieces[pieces.doc_id == i].sort_values("start")
        assert own.length.sum() == own.doc_tokens.iloc[0] == len(next(enc.encode([t]))) + 1
    assert set(pieces.doc_id) == {i for i, _ in key(single)}
