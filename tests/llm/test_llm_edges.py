"""Odd tables, clashing columns, hot and heavy groups: cases that once failed."""

import random
from collections import Counter

import numpy as np
import pytest

pytest.importorskip("quillspark.llm")
from quillspark.llm import langid, ngram, quotes, toxicity, vectors  # noqa: E402

VECTORS = "vec_id long, embedding array<double>, label int"


def brute_top(x, ids, k=20, mod=20):
    return {(int(ids[q]), r + 1, p, s) for q in range(len(x)) if ids[q] % mod == 0 for r, (s, p) in enumerate([(-a, b) for a, b in sorted((-int(x[q] @ x[j]), int(ids[j])) for j in range(len(x)) if j != q)[:k]])}


def test_tree_of_the_given_table_has_levels():
    import pyarrow.parquet as pq

    x = np.floor(64 * np.array(pq.read_table("/root/testdata/sf0.1/embeddings.parquet").column("embedding").to_pylist(), float))
    t = vectors.CoverTree(x)
    assert len(t.begin) > 20 and max(map(len, t.children)) <= len(x) // vectors.ROOM + 1


def test_node_pairs_are_dropped():
    r = np.random.default_rng(2)
    x = np.floor(np.concatenate([m + r.standard_normal((150, 16)) * 5 for m in r.standard_normal((30, 16)) * 200]))
    seen = {}
    a, b, s = vectors.top_of_block(x[::3], np.arange(0, len(x), 3), x, np.arange(len(x)), np.arange(len(x)), 20, seen=seen)
    got = {(int(i) * 3, int(j), int(v)) for i, j, v in zip(a, b, s, strict=True)}
    assert got == {(q, p, v) for q, _, p, v in brute_top(x.astype(np.int64), np.arange(len(x)), mod=3)}
    assert seen["dropped"] > 100 and seen["products"] < 0.5 * len(x) * len(x[::3])


@pytest.mark.parametrize("few", [1, 3])
def test_search_in_rounds(spark, monkeypatch, few):
    """Many cells and blocks, few of them in a round."""
    for name, value in (("BLOCK", 40), ("GROUP", 3), ("FEW", few)):
        monkeypatch.setattr(vectors, name, value)
    r = np.random.default_rng(9)
    x = np.concatenate([m + r.standard_normal((60, 6)) for m in r.standard_normal((8, 6)) * 4] + [np.ones((90, 6))])
    rows = [(i, [float(c) for c in v], 0) for i, v in enumerate(x)]
    got = {tuple(t) for t in vectors.exact_top_k(spark.createDataFrame(rows, VECTORS)).select("query_id", "rank", "vec_id", "score").collect()}
    assert got == brute_top(np.floor(64 * x).astype(np.int64), np.arange(len(x)))


def test_components_too_large_for_64_bits_take_no_part(spark):
    rows = [(0, [1e20, 1.0], 0), (20, [1e20, 1.0], 0), (40, [1.0, 2.0], 0), (3, [4e6, 1.0], 0), (5, [-1e300, 0.0], 0)]
    got = sorted(tuple(r) for r in vectors.exact_top_k(spark.createDataFrame(rows, VECTORS)).collect())
    assert got == [(40, 1, 3, 64 * 64 * 4_000_000 + 128 * 64)]


CLASH = "doc_id long, text string, lang string, source string, n_chars long, _text string, same string, _same int, m map<string,int>, row string, lead int"


def clashing(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", 1, f"own{k}", "a", k, {"k": k}, "r", k) for k, (i, t) in enumerate(rows)], CLASH)


def test_stages_with_clashing_columns(spark, tmp_path):
    import corpus_pipeline

    spark.createDataFrame([(i, 1, i % 2) for i in range(40)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    words = "sun moon tree river stone cloud field grass hill lake".split()
    r = random.Random(4)
    rows = [(i, " ".join(r.choice(words) for _ in range(40)) + " badword" * (i % 2)) for i in range(40)]
    rows += [rows[2], rows[2], (2, "another text of the same id that is like none"), (2, ""), (2, ""), (None, "x y"), (99, None)]
    docs = clashing(spark, rows)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        got = out.collect()
        assert out.columns == docs.columns and {x["_text"] for x in got} <= {f"own{k}" for k in range(len(rows))}, name
        assert all(rows[x["_same"]] == (x["doc_id"], x["text"]) and x["m"] == {"k": x["_same"]} for x in got), name
    kept = Counter((x["doc_id"], x["text"]) for x in corpus_pipeline.near_duplicates(spark, docs, "").collect())
    assert kept[rows[2]] == 1 and kept[(2, "another text of the same id that is like none")] == 1 and kept[(2, "")] == 1 and kept[(99, None)] == 1 and kept[(None, "x y")] == 1
    for found in (langid.identify(docs, keep=True), toxicity.score(docs, spark.read.parquet(f"{tmp_path}/labels.parquet"), keep=True)):
        assert [x["_text"] for x in found.collect()] == [f"own{k}" for k in range(len(rows))]


def test_quotation_of_what_its_own_conversation_says_later(spark):
    passage = "a passage that is long enough to link"
    rows = [(0, 1, "u", f"> {passage}\nyes"), (0, 3, "u", passage), (1, 0, "u", passage), (2, 5, "u", passage), (3, 0, "u", f"> {passage}\nno")]
    got = {(r["conv_id"], r["turn"]): (r["reply_conv"], r["reply_turn"], r["linked"]) for r in quotes.reply_ordered(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert got[(0, 1)] == (1, 0, True) and got[(3, 0)] == (0, 3, True)


def test_the_sample_of_a_language_is_bounded_before_the_driver(spark, monkeypatch):
    monkeypatch.setattr(langid, "SAMPLE_LETTERS", 500)
    rows = [(i, f"{'abcdefgh'[i % 8]}word{'x' * (i % 5)} der die das " * 20, "de" if i % 2 else "en") for i in range(300)]
    one = next(i for i in range(300) if rows[i][2] == "de")
    rows += [(rows[one][0], "a repeated id", "de")] * 200 + [(7, None, "fr"), (None, "text", "fr"), (8, "no language", None)]
    found = langid.sample(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert set(found) <= {"de", "en", "fr"} and {"de", "en"} <= set(found) and all(0 < len(t) <= 500 for t in found.values())


def test_heavy_texts_get_smaller_blocks(spark, monkeypatch):
    """Near copies of long texts, ids repeated many times, blocks of a few texts."""
    for name, value in (("TILE", 64), ("HEAVY", 900)):
        monkeypatch.setattr(ngram, name, value)
    r = random.Random(1)
    base = [f"w{r.randint(0, 10**6)}" for _ in range(300)]
    rows = []
    for i in range(30):
        words = list(base)
        words[r.randrange(300)] = f"x{i}"
        rows.append((i, " ".join(words)))
    rows += [(5, rows[4][1])] * 40 + [(5, "one two three four five six seven")] * 40 + [(77, "one two three four five six seven")]
    got = ngram.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    sets = [frozenset(zip(*(t.split()[k:] for k in range(5)), strict=False)) for _, t in rows]
    like = [[len(a & b) >= 0.8 * len(a | b) for b in sets] for a in sets]
    want = Counter((i, sum(like[k]) - 1) for k, (i, _) in enumerate(rows))
    assert Counter((x["doc_id"], x["n_links"]) for x in got) == want
