"""The search engine: facts that must hold, and every query against its DuckDB oracle on the smallest tables."""

import io
import math
import random
import re
import sys
import time
import types
import zipfile

import duckdb
import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

import __spark_entry__ as entry
from quillspark import catalog
from quillspark.functions import phonetic, text
from quillspark.functions.stemmer import stem
from quillspark.operators import boundaries, chunking, ranking, scoring
from quillspark.operators import index as ix
from quillspark.plans import search
from quillspark.plans.query import Thesaurus, parse, single_intent
from quillspark.sources import books, files
from quillspark.streaming import ingest

D = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{D}/{t}.parquet'")
    return c


def rows_of(rows):
    return sorted(tuple("~" if v is None else repr(round(v, 5) + 0.0) if isinstance(v, float) else str(v) for v in r) for r in rows)


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_equals_oracle(spark, duck, name):
    df = catalog.queries()[name](spark, D)
    columns = sorted(df.columns)
    r = duck.sql(catalog.oracle_sql()[name])
    at = [r.columns.index(c) for c in columns]
    assert rows_of(tuple(x[c] for c in columns) for x in df.collect()) == rows_of(tuple(x[i] for i in at) for x in r.fetchall())


def test_partial_ratio_sees_whole_texts(spark, tmp_path):
    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row, old = [i], row
            for j, y in enumerate(b, 1):
                row.append(min(old[j] + 1, row[-1] + 1, old[j - 1] + (x != y)))
        return row[-1]

    texts = ["q" * 200 + " zuerst", "eérst und q", "eürsét", "e\u0301rst", "q" * 500 + "erzt", "Erst", "er", "", None]
    spark.createDataFrame(list(enumerate(texts)), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {r["item_id"]: r["ratio"] for r in catalog.queries()["fuzzy_partial_ratio"](spark, str(tmp_path)).collect()}
    for i, t in enumerate(texts):
        t = (t or "").lower()
        assert got[i] == max(max(0.0, 100 * (1 - distance(t[k : k + 4], "erst") / 4)) for k in range(max(1, len(t) - 3))), t


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(catalog.oracle_sql())))
def test_query_runs(spark, name):
    got = catalog.queries()[name](spark, D)
    assert got.columns and (got.count() > 0 or name in ("search_spelling_and_sound", "search_filtered"))


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def one(spark, column, value="x"):
    return spark.createDataFrame([(value,)], "t string").select(column.alias("c")).first()["c"]


def test_tokens(spark):
    assert one(spark, text.tokens(F.col("t")), "Hello, World! 2024") == ["hello", "world"]
    assert one(spark, text.tokens(F.col("t")), None) == []
    assert one(spark, text.count_tokens(F.col("t")), "one two three") == 3
    assert one(spark, text.sentences(F.col("t")), "One. Two! three? Four.") == ["One.", "Two! three?", "Four."]


def test_stems():
    assert stem("running") == stem("run") and stem("optimizer") == "optim"
    for word, want in {"caresses": "caress", "ties": "tie", "hoping": "hope", "hopping": "hop", "happiness": "happi", "agreed": "agre", "dying": "die", "generously": "generous", "conditional": "condit"}.items():
        assert stem(word) == want


def test_phonetic():
    assert phonetic.key("Shakespear") == phonetic.key("Shakespeare") and phonetic.key("") == ""


def test_queries_parse():
    q = parse('"deep learning" optimizer')
    assert q.phrases == ["deep learning"] and q.stems == ["optim"]
    assert "definition" in parse("what is BM25 ranking").intents and "bm25" in parse("what is BM25 ranking").tokens
    assert parse('find "search engine"').phrases == ["search engine"] and parse("   ").empty and parse("").empty
    assert single_intent("define consciousness") == "definition"


def test_thesaurus(tmp_path):
    t = Thesaurus({"a": {"direct": ["b", "c"], "concepts": ["d"]}, "b": ["a", "e"], "c": {"direct": [], "concepts": ["f", "b"]}, "_note": "x", "bad": 3})
    assert t.expand("a") == (["c", "e"], ["b", "d", "f"])
    files.save_thesaurus(t, str(tmp_path / "t.json"))
    assert files.load_thesaurus(str(tmp_path / "t.json"), {"z": ["y"]}).direct["z"] == ["y"]
    assert files.load_thesaurus(str(tmp_path / "none.json"), {"z": ["y"]}).expand("z") == (["y"], [])


def test_chunks(spark):
    long = "This is sentence one. " * 300
    pages = spark.createDataFrame([(1, 1, long), (1, 2, "Short page here."), (2, 1, ""), (3, 1, None), (4, 1, "word " * 3000)], "doc_id int, page_num int, text string")
    for mode in ("sentence", "words", "paragraph", "flush"):
        got = chunking.chunk_pages(pages, mode).orderBy("doc_id", "chunk_idx").collect()
        assert {r["doc_id"] for r in got} == {1, 4} and (mode == "flush" or max(r["token_count"] for r in got) <= 900)
        own = [r for r in got if r["doc_id"] == 1]
        assert [r["chunk_idx"] for r in own] == list(range(len(own)))
        assert all(a["next_id"] == b["chunk_id"] and b["prev_id"] == a["chunk_id"] for a, b in zip(own, own[1:], strict=False))
    assert len({r["chunk_id"] for r in got}) == len(got)


def test_chunks_begin_where_they_stand(spark):
    """The start of each chunk, in a text whose chunks open alike; a paragraph's end closes a chunk that is full."""
    page = "This is sentence one. " * 300
    chunks = chunking.chunk_pages(spark.createDataFrame([(1, 1, page)], "doc_id int, page_num int, text string")).orderBy("chunk_idx").collect()
    starts = [r["start"] for r in chunks]
    assert len(starts) == 3 and starts[0] == 0 and all(page[r["start"] :].startswith(r["content"]) for r in chunks)
    assert starts[1] == 22 * 120 and starts[2] == 22 * 240
    page = "\n\n".join(f"Paragraph {k} has so many words of its own. " * n + "It ends." for k, n in enumerate((45, 3, 50, 60, 2)))
    got = [r["content"] for r in chunking.chunk_pages(spark.createDataFrame([(1, 1, page)], "doc_id int, page_num int, text string"), "flush").orderBy("chunk_idx").collect()]
    assert [c.split()[1] for c in got] == ["0", "1", "3", "4"][: len(got)] and got[0].endswith("It ends.") and "Paragraph 1" in got[1]


def test_phonetic_keys():
    want = {"judge": "JJ|HJ", "school": "SKL", "thick": "0KK|TKK", "phone": "FN", "apple": "APL", "gnome": "NNM|KNNM", "x": "SK", "": "", "12": "", "back": "PKK", "jam": "JM|HM", "nation": "NXN", "vision": "FXN", "edgya": "AJ", "yes": "YS", "cite": "ST", "chat": "XT|KT", "aggie": "AKJ|AKK", "whole": "HL", "daddy's": "TTTS"}
    assert {w: phonetic.key(w) for w in want} == want


def test_search_answers_misses_and_headers(spark):
    index = library(spark)
    assert [r["chunk_id"] for r in search.search(index, "Okapy").collect()][0] == "a"
    assert [r["chunk_id"] for r in search.search(index, "travel").collect()] == ["c"]  # in the header alone
    assert search.search(index, "Okapy", filters={"year": 1999}).filter("chunk_id = 'a'").count() == 0


def test_structure(spark):
    kind = lambda t: one(spark, text.structure(F.col("t"))["kind"], t)
    assert kind("- . x\n1. one\n2. two\n3. three") == "list"
    assert kind('He said "this is a long enough quote" to them') == "quote_block"
    assert kind("Roses red\nViolets blue\nSugar sweet\nAnd so on") == "poetry"
    assert kind("A Heading\n" + "plain words follow here without end and go on " * 3) == "heading_body"
    assert kind("plain words follow here without end and go on " * 3) == "exposition"


def test_bm25_facts(spark):
    stats = spark.createDataFrame([(100.0, 120.0)], "n double, avgdl double")
    df = spark.createDataFrame([("bm25", 5), ("rank", 30)], "term string, df int")
    tf = spark.createDataFrame([(1, "bm25", 3, 120.0), (1, "rank", 2, 120.0), (2, "bm25", 4, 120.0), (3, "bm25", 3, 240.0)], "doc_id int, term string, tf int, dl double")
    q = spark.createDataFrame([("bm25", 1), ("none", 1)], "term string, qtf int")
    got = dict(scoring.bm25(tf, df, q, stats, ["doc_id"]).collect())
    assert got[2] > got[1] > got[3] > 0
    corpus = spark.createDataFrame([(0, "Hello there good man!"), (1, "It is quite windy in London"), (2, "How is the weather today?")], "doc_id int, t string").select("doc_id", F.split("t", " ").alias("toks"))
    assert [r["n"] for r in corpus.orderBy("doc_id").select(F.size("toks").alias("n")).collect()] == [4, 6, 5]
    assert ix.corpus_stats(corpus, F.size("toks")).first()["avgdl"] == 5


def test_normalise(spark):
    got = lambda xs: [r["norm"] for r in ranking.normalised(spark.createDataFrame(list(enumerate(xs)), "doc_id int, score double")).orderBy("doc_id").collect()]
    assert got([0.0, 5.0, 10.0]) == [0, 0.5, 1] and got([5.0]) == [1] and got([0.0, 0.0]) == [0, 0] and got([]) == []


def library(spark):
    chunks = [(1, "a", "The Okapi BM25 algorithm is a probabilistic information retrieval model.", "Introduction", None, "b"), (1, "b", "Neural networks and deep learning have transformed artificial intelligence research.", "Introduction", "a", None), (2, "c", "A cafe in London serves tea.", "Travel", None, None)]
    docs = spark.createDataFrame([(1, "Test Document", 2023), (2, "Guide", 1999)], "doc_id int, title string, year int")
    return search.Index.build(spark.createDataFrame(chunks, "doc_id int, chunk_id string, content string, header string, prev_id string, next_id string"), docs)


def test_search(spark, tmp_path):
    index = library(spark)
    got = search.search(index, "BM25 probabilistic").collect()
    assert got[0]["chunk_id"] == "a" and all(0 <= r["norm"] <= 1 for r in got)
    assert search.search(index, " ").count() == 0
    assert search.search(index, "BM25", filters={"year": "1999"}).count() == 0 and search.search(index, "BM25", filters={"year": "bad"}).count() == 1
    assert [r["chunk_id"] for r in search.search(index, '"deep learning"').collect()] == ["b"]
    assert [r["chunk_id"] for r in search.search(index, "tea", scope=[2]).collect()] == ["c"]
    assert search.fallback(index, "Okapy").first()["how"] == "spelling" and search.fallback(index, "Okapy", filters={"year": 1999}).filter("how = 'spelling'").count() == 0
    q = spark.createDataFrame([(1, "okapi model"), (2, "tea"), (3, "zzz")], "query_id int, text string")
    assert {(r["query_id"], r["chunk_id"]) for r in search.batch_search(index, q).filter("rank = 1").collect()} == {(1, "a"), (2, "c")}
    index.save(str(tmp_path / "index"))
    again = search.Index.load(spark, str(tmp_path / "index"))
    assert search.search(again, "BM25 probabilistic").collect() == got
    left = index.deleted(spark.createDataFrame([(1,)], "doc_id int"))
    assert rows_of(left.df.collect()) == rows_of(search.Index.build(index.chunks.filter("doc_id = 2").drop("token_count", "structure"), index.documents.filter("doc_id = 2")).df.collect())
    assert rows_of(left.cooc.collect()) == rows_of(ix.cooccurrence(index.chunks.filter("doc_id = 2"), "content").collect())
    same = index.upserted(index.chunks.filter("doc_id = 1").drop("token_count", "structure"), index.documents.filter("doc_id = 1"))
    assert rows_of(same.tf.select("chunk_id", "term", "tf").collect()) == rows_of(index.tf.select("chunk_id", "term", "tf").collect())
    assert rows_of(same.df.collect()) == rows_of(index.df.collect()) and rows_of(same.cooc.collect()) == rows_of(index.cooc.collect()) and rows_of(same.stats.collect()) == rows_of(index.stats.collect())


def test_files(spark, tmp_path):
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        z.writestr("1.xhtml", "<html><head><title>x</title></head><body><h1>One</h1><p>Text &amp; more</p><script>bad()</script></body></html>")
        z.writestr("2.xhtml", b"\xff\xfe\xff")
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "Book 1984.epub").write_bytes(data.getvalue())
    (tmp_path / "in" / "broken.epub").write_bytes(b"no zip")
    (tmp_path / "in" / "note.txt").write_text("Plain text of 2001")
    x = files.pages(files.listing(spark, str(tmp_path / "in"))).cache()
    r = {(a["title"].replace("%20", " "), a["page_num"]): a for a in x.collect()}
    assert r["Book 1984", 1]["heading"] == "One" and "Text & more" in r["Book 1984", 1]["text"] and "bad" not in r["Book 1984", 1]["text"]
    assert r["Book 1984", 2]["error"] and r["broken", 1]["error"] and r["note", 1]["year"] == 2001 and r["Book 1984", 1]["year"] == 1984
    assert dict(files.ingest_report(x).collect()) == {"ok": 2, "failed": 1}
    pages = spark.createDataFrame([(1, 1, "a"), (1, 2, "b")], "doc_id int, page_num int, text string")
    assert files.page(pages, 1, 9).first()["text"] == "b" and files.page(pages, 1, 0).first()["text"] == "a"
    files.export_text(pages, str(tmp_path / "out"))
    assert spark.read.text(str(tmp_path / "out"), wholetext=True).first()[0].startswith("a\n\nb")


BOX = '<container xmlns="urn:oasis:names:tc:opendocument:xmlns:container"><rootfiles><rootfile full-path="OPS/book.opf"/></rootfiles></container>'
OPF = """<package xmlns="http://www.idpf.org/2007/opf" xmlns:dc="http://purl.org/dc/elements/1.1/">
<metadata><dc:title>A Book</dc:title><dc:creator> Some Body </dc:creator></metadata>
<manifest><item id="x" href="z%20first.xhtml"/><item id="y" href="a.xhtml"/><item id="m" href="gone.xhtml"/></manifest>
<spine><itemref idref="x"/><itemref idref="m"/><itemref idref="y"/><itemref idref="unknown"/></spine></package>"""


def zipped(**content):
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        for name, body in content.items():
            z.writestr(name, body)
    return data.getvalue()


def test_epub_reading_order():
    book = zipped(**{"META-INF/container.xml": BOX, "OPS/book.opf": OPF, "OPS/a.xhtml": "second", "OPS/z first.xhtml": "first", "OPS/notes.html": "last"})
    found = files.epub_chapters(book)
    assert [t for t, e in found if not e] == ["first", "second", "last"] and [bool(e) for _, e in found] == [False, True, False, False]
    bare = zipped(**{"b.html": "two", "a.html": "one", "META-INF/container.xml": "no xml"})
    assert [t for t, _ in files.epub_chapters(bare)] == ["one", "two"]
    assert files.epub_metadata(book) == {"title": "A Book", "author": "Some Body"} and files.epub_metadata(bare) == {}


def test_metadata(spark):
    book = zipped(**{"META-INF/container.xml": BOX, "OPS/book.opf": OPF})
    rows = [("/x/one.epub", bytearray(book)), ("/x/bad.epub", bytearray(b"?")), ("/x/plain.txt", bytearray(b"text"))]
    got = files.metadata(spark.createDataFrame(rows, "path string, content binary")).collect()
    assert sorted((r["title"], r["author"]) for r in got) == [("A Book", "Some Body"), ("bad", ""), ("plain", "")]


def test_pdf_readers_take_turns(monkeypatch):
    class Page:
        def __init__(self, text):
            self.text = text

        def extract_text(self):
            if self.text == "bad":
                raise ValueError("bad page")
            return self.text

    class Reader:
        def __init__(self, _):
            self.pages, self.metadata = [Page("hello"), Page("bad"), Page(None)], {"/Title": " T ", "/Author": None}

    def fails(_):
        raise ValueError("not for me")

    monkeypatch.setitem(sys.modules, "pdfplumber", None)
    monkeypatch.setitem(sys.modules, "pypdf", None)
    assert files.pdf_pages(b"x") == [("", "no PDF library installed")] and files.pdf_metadata(b"x") == {}
    monkeypatch.setitem(sys.modules, "pdfplumber", types.SimpleNamespace(open=fails))
    assert files.pdf_pages(b"x") == [("", "not for me")]
    monkeypatch.setitem(sys.modules, "pypdf", types.SimpleNamespace(PdfReader=Reader))
    assert files.pdf_pages(b"x") == [("hello", None), ("", "bad page"), ("", None)] and files.pdf_metadata(b"x") == {"title": "T"}


def test_scan_plan_and_report(spark):
    kind = "path string, size int, mtime double"
    now = spark.createDataFrame([("same", 1, 1.0), ("grown", 2, 1.0), ("new", 1, 1.0), ("odd", None, 1.0)], kind)
    known = spark.createDataFrame([("same", 1, 1.4), ("grown", 1, 1.0), ("gone", 1, 1.0), ("odd", None, 1.0)], kind)
    want = {"same": "skip", "grown": "index", "new": "index", "odd": "index", "gone": "delete"}
    plan = ix.scan_plan(now, known, tolerance=0.5)
    assert dict(plan.collect()) == want
    assert dict(ix.scan_plan(now, known, tolerance=0.5, force=True).collect()) == want | {"same": "index"}
    read = spark.createDataFrame([("grown", None), ("new", "broken")], "path string, error string")
    assert dict(files.ingest_report(read, plan=plan).collect()) == {"ok": 1, "failed": 1, "skipped": 1, "deleted": 1}
    assert ix.scan_plan(now.limit(0), known.limit(0)).collect() == []


def test_folded_letters(spark):
    words = ["Écoute", "Łódź", "Dvořák", "ñandú", "Việt", "e\u0301te\u0301", None, ""]
    got = [r[0] for r in spark.createDataFrame([(i, w) for i, w in enumerate(words)], "i int, w string").orderBy("i").select(text.folded(F.col("w"))).collect()]
    assert got == ["ecoute", "łodz", "dvorak", "nandu", "viet", "ete", None, ""]


def test_concepts_take_two_hops(spark):
    t = Thesaurus({"cat": {"direct": ["feline", "big cats"], "concepts": ["pets"]}, "feline": {"direct": ["lion"], "concepts": ["animals"]}, "only": {"concepts": ["one"]}})
    got = {(r["word"], r["concept"]): r["weight"] for r in t.frame(spark).collect()}
    assert got["cat", "lion"] == 0.85 and got["cat", "anim"] == 0.6 and got["cat", "big"] == 0.85 and got["only", "one"] == 0.6
    assert t.frame(spark, "none").filter("concept = 'animals'").count() == 2 and Thesaurus({}).frame(spark).count() == 0


def test_search_with_vectors(spark):
    chunks = spark.createDataFrame([(1, "a", "green apple tree"), (2, "b", "green apple pie"), (3, "c", "green apple juice"), (4, "d", "blue car")], "doc_id int, chunk_id string, content string")
    index = search.Index.build(chunks, chunks.select("doc_id"))
    vectors = spark.createDataFrame([("a", [0.0, 1.0]), ("b", [2.0, 0.0]), ("b", [2.0, 0.0]), ("c", None), ("d", [1.0, 0.0])], "chunk_id string, vector array<double>")
    plain = {r["chunk_id"]: r["score"] for r in search.search(index, "green apple").collect()}
    got = {r["chunk_id"]: r["score"] for r in search.search(index, "green apple", vector=[1, 0], vectors=vectors).collect()}
    assert set(got) == {"a", "b", "c"} and got["a"] == plain["a"] and got["c"] == plain["c"]
    assert abs(got["b"] - plain["b"] - scoring.WEIGHTS["cosine"]) < 2e-4


def test_upkeep(spark):
    old = spark.createDataFrame([("a", 1), ("b", 5)], "k string, v int")
    new = spark.createDataFrame([("b", 2), ("c", 3)], "k string, v int")
    merged = lambda how: dict(ix.merge_counts(old, new, ["k"], "v", how).collect())
    assert merged("sum") == {"a": 1, "b": 7, "c": 3} and merged("max") == {"a": 1, "b": 5, "c": 3} and merged("last") == {"a": 1, "b": 2, "c": 3}
    files_now = spark.createDataFrame([("p", 1, 1.0), ("q", 2, 2.0)], "path string, size int, mtime double")
    assert ix.changed(files_now, files_now).count() == 0 and ix.changed(files_now, files_now.filter("path = 'p'")).count() == 1


def test_streaming(spark, tmp_path):
    src, out = str(tmp_path / "src"), str(tmp_path / "out")
    kind = "doc_id int, text string, mtime double"
    stream = lambda: spark.readStream.schema(kind).parquet(src)
    texts = lambda: {tuple(r) for r in ingest.current(spark, out).select("doc_id", "text").collect()}

    def batch(*rows):
        spark.createDataFrame(rows, kind).coalesce(1).write.mode("append").parquet(src)
        ingest.keep_current(stream(), out, str(tmp_path / "cp"), every=3).awaitTermination(60)

    batch((1, "old", 1.0), (2, "x", 1.0), (1, "new", 2.0))
    batch((2, "y", 2.0), (3, "z", 1.0))
    assert texts() == {(1, "new"), (2, "y"), (3, "z")}
    batch((1, "late and old", 1.5), (3, "newest", 3.0), (2, "y", 2.0))
    assert texts() == {(1, "new"), (2, "y"), (3, "newest")}
    assert dict(ingest.report(spark, out).filter("batch = 2").select("status", "n").collect()) == {"ok": 1, "skipped": 2}
    # what a batch writes is what it changes
    assert spark.read.parquet(f"{out}/changes/batch=2").select("doc_id").collect() == [(3,)]
    for k in range(3, 9):
        batch((k, f"text {k}", 1.0), (1, f"version {k}", float(k)))
    want = {(2, "y"), (1, "version 8"), *((k, f"text {k}") for k in range(4, 9)), (3, "newest")}
    assert texts() == want and not (tmp_path / "out" / "base" / "v2").exists() and not (tmp_path / "out" / "changes" / "batch=2").exists()
    ingest.keep_current(stream(), out, str(tmp_path / "cp"), every=3).awaitTermination(60)  # nothing new
    assert texts() == want


def test_streaming_of_files(spark, tmp_path):
    """Failed files leave the last good version; the same size and time is skipped, a new size is not; odd values pass."""
    import datetime as dt

    src, out = str(tmp_path / "src"), str(tmp_path / "out")
    kind = "path string, size long, mtime timestamp, text string, error string"
    at = lambda us: dt.datetime(2024, 5, 1, 12, 0, 0, us)

    def batch(*rows):
        spark.createDataFrame(rows, kind).coalesce(1).write.mode("append").parquet(src)
        ingest.keep_current(spark.readStream.schema(kind).parquet(src), out, str(tmp_path / "cp"), key="path", size="size", error="error").awaitTermination(60)

    batch(("a", 9_007_199_254_740_993, at(123_456), 'quote " \\ \n é', None), ("b", None, at(1), None, None), ("c", 5, at(1), None, "broken"), (None, 1, at(1), "x", None), ("d", 1, None, "x", None))
    batch(("a", 9_007_199_254_740_993, at(123_456), "same", None), ("b", 3, at(1), "grown", None), ("c", 5, at(1), "mended", None))
    batch(("c", 6, at(2), None, "broken again"), ("a", 1, at(123_455), "older", None))
    got = {tuple(r) for r in ingest.current(spark, out, "path").select("path", "size", "mtime", "text").collect()}
    assert got == {("a", 9_007_199_254_740_993, at(123_456), 'quote " \\ \n é'), ("b", 3, at(1), "grown"), ("c", 5, at(1), "mended")}
    counts = {(r["batch"], r["status"]): r["n"] for r in ingest.report(spark, out).collect()}
    assert counts == {(0, "ok"): 2, (0, "failed"): 3, (1, "skipped"): 1, (1, "ok"): 2, (2, "failed"): 1, (2, "skipped"): 1}


def test_event_counts(spark, tmp_path):
    src = str(tmp_path / "src")
    spark.createDataFrame([("2024-01-01 00:01:00", "a"), ("2024-01-01 00:04:00", "a"), ("2024-01-01 00:06:00", "b")], "t string, event_type string").select(F.to_timestamp("t").alias("ts"), "event_type").coalesce(1).write.parquet(src)
    x = ingest.event_counts(spark.readStream.schema("ts timestamp, event_type string").parquet(src))
    q = x.writeStream.format("memory").queryName("counted").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(60)
    got = {(r["window"]["start"].minute, r["event_type"], r["n"]) for r in spark.table("counted").collect()}
    assert got == {(0, "a", 2), (5, "b", 1)}


def test_phrases_by_position(spark):
    """Against the plain test on token lists."""
    import random

    from quillspark.operators import match, postings

    r = random.Random(2)
    texts = ["", None, "a", "a a a", "b a a b", "x, y", "x y"] + [" ".join(r.choice("abcx") for _ in range(r.randint(0, 30))) for _ in range(60)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    places = postings.positional(docs, ["doc_id"])
    for asked in ("a", "a b", "a a", "b a a b", "x y", "A B c", "nowhere a", "a nowhere", " ", "x, y"):
        got = sorted(x["doc_id"] for x in postings.phrase(places, asked).collect())
        assert got == (sorted(x["doc_id"] for x in match.phrase(docs, asked).collect()) if asked.strip() else []), asked


def test_top_k_by_bounds_is_exact(spark):
    import random

    from quillspark.operators import postings

    r = random.Random(5)
    words = [f"w{i}" for i in range(60)]
    rows = [(i, str(i), " ".join(r.choice(words[: r.choice([3, 10, 60])]) for _ in range(r.randint(1, 200)))) for i in range(700)]
    rows += [(700 + i, f"t{i}", "w1 w59 same") for i in range(30)]
    chunks = spark.createDataFrame(rows, "doc_id long, chunk_id string, content string")
    index = search.Index.build(chunks, chunks.select("doc_id"), stem=False).cached()
    skipped = 0
    for terms, k in ((["w59"], 3), (["w1", "w59", "w59"], 10), (["w0", "w1", "w2"], 25), (["nothing"], 5), (["w58", "nothing"], 1000), ([], 3), (["same"], 7)):
        got, report = postings.bounded_top_k(index.tf, index.limits, index.df, index.stats, terms, k)
        every = scoring.bm25(index.tf, index.df, spark.createDataFrame([(t, terms.count(t)) for t in dict.fromkeys(terms)] or [("", 0)], "term string, qtf int"), index.stats, ["chunk_id"])
        want = every.withColumn("score", F.round("score", 9)).orderBy(F.desc("score"), "chunk_id").limit(k).collect()
        assert [x["chunk_id"] for x in got.collect()] == [x["chunk_id"] for x in want]
        assert all(abs(a["score"] - b["score"]) < 1e-9 for a, b in zip(got.collect(), want, strict=True))
        skipped += report["cells"] - report["cells_read"]
    assert skipped > 20


def test_saved_index_reads_few_buckets_and_keeps_postings_in_place(spark, tmp_path, capsys):
    from quillspark.sources import store

    path = str(tmp_path / "index")
    chunks = spark.createDataFrame([(i, str(i), f"word{i} common text number{i % 7}") for i in range(200)], "doc_id long, chunk_id string, content string")
    search.Index.build(chunks, chunks.select("doc_id"), stem=False).save(path, hot=150)
    index = search.Index.load(spark, path)
    assert {r["term"] for r in index.hot.select("term").distinct().collect()} == {"common", "text"}
    spark.conf.set("spark.sql.sources.bucketing.autoBucketedScan.enabled", "false")  # else buckets are pruned without a word in the plan
    index.cold.filter("term = 'word3'").explain("formatted")
    spark.conf.unset("spark.sql.sources.bucketing.autoBucketedScan.enabled")
    assert f"SelectedBucketsCount: 1 out of {store.BUCKETS}" in capsys.readouterr().out
    asked = spark.createDataFrame([(i, f"word{i} common") for i in range(50)] + [(99, "nothing here")], "query_id int, text string")
    before = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        found = search.batch_search(index, asked, 3)
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert [line for line in plan.splitlines() if "FileScan parquet" in line and "Bucketed: true" in line]  # no exchange between it and its join
        got = {(r["query_id"], r["chunk_id"], r["rank"], round(r["score"], 9)) for r in found.collect()}
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    plain = search.Index.build(chunks, chunks.select("doc_id"), stem=False)
    want = {(r["query_id"], r["chunk_id"], r["rank"], round(r["score"], 9)) for r in search.batch_search(plain, asked, 3).collect()}
    assert got == want and {c for q, c, rank, _ in got if rank == 1} == {str(i) for i in range(50)}


def test_a_job_that_dies_leaves_the_version_before(spark, tmp_path):
    from quillspark.sources import store

    path = str(tmp_path / "index")
    index = library(spark)
    assert index.save(path) == 1
    old = search.Index.load(spark, path)
    broken = old.upserted(spark.createDataFrame([(2, "c", "All new words here")], "doc_id int, chunk_id string, content string"), old.documents.filter("doc_id = 2"))
    whole = broken.stats
    broken.stats = whole.select(F.raise_error(F.lit("killed")).cast("double").alias("n"), "avgdl")
    with pytest.raises(Exception, match="killed"):
        broken.save(path)
    again = search.Index.load(spark, path)
    assert store.versions(spark, path) == [1] and rows_of(again.tf.collect()) == rows_of(index.tf.collect())
    assert [r["chunk_id"] for r in search.search(again, "tea").collect()] == ["c"]
    broken.stats = whole
    assert broken.save(path) == 2 and search.search(search.Index.load(spark, path), "new").first()["chunk_id"] == "c"
    with pytest.raises(RuntimeError, match="not the current one"):
        broken.save(path)  # follows version 1 still
    assert [r["chunk_id"] for r in search.search(search.Index.load(spark, path, 1), "tea").collect()] == ["c"]
    assert store.vacuum(spark, path, keep=1) == 2 and store.versions(spark, path) == [2]
    assert search.search(search.Index.load(spark, path), "new").count() == 1
    with pytest.raises(FileNotFoundError):
        store.tables(spark, path, 1)


def test_misspelt_words_against_every_term(spark):
    import random

    from quillspark.operators import fuzzy

    r = random.Random(8)
    terms = sorted({"".join(r.choice("abcde") for _ in range(r.randint(1, 9))) for _ in range(400)} | {"aa", "aaaa", "banana", "bananas"})
    words = ["abc", "banana", "bananan", "aaaa", "e", "abcdeabcde", "zzz"]

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        return row[-1]

    for least in (0.6, 0.8, 0.34):
        got = {(x["word"], x["term"]) for x in fuzzy.similar(fuzzy.gram_index(spark.createDataFrame([(t,) for t in terms], "term string")), spark.createDataFrame([(w,) for w in words], "word string"), least).collect()}
        assert got == {(w, t) for w in words for t in terms if 1 - distance(w, t) / max(len(w), len(t)) >= least - 1e-12}


def test_fallback_ranks_by_partial_ratio(spark):
    chunks = spark.createDataFrame([(1, "a", "the okapi algorithm ranks"), (2, "b", "an okapy algorithm"), (3, "c", "nothing like it"), (4, "d", "okapi")], "doc_id int, chunk_id string, content string")
    index = search.Index.build(chunks, chunks.select("doc_id"))
    got = search.fallback(index, "okapy algoritm").collect()
    assert [r["chunk_id"] for r in got[:1]] == ["b"] and {r["chunk_id"] for r in got} == {"a", "b", "d"} and all(r["how"] == "spelling" and 0 <= r["score"] <= 1 for r in got)


def test_answer(spark):
    index = library(spark)
    got = search.answer(index, "BM25 probabilistic", facets=("year", "title"))
    assert [h["chunk_id"] for h in got.hits] == ["a"] and [h["rank"] for h in got.hits] == [1] and got.total == 1 and not got.used_fallback and got.elapsed_ms > 0
    assert [tuple(f) for f in got.facets] == [("title", "Test Document", 1), ("year", "2023", 1)]
    assert search.answer(index, "Okapj").used_fallback and search.answer(index, " ").hits == []
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        norms = [r["norm"] for r in search.search(index, "the algorithm networks tea").collect()]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert norms == sorted(norms, reverse=True)


def plain_words(t):
    """Cores of a text's words by plain Python: what the learned boundaries count."""
    out = []
    for w in re.findall(r"[^ \t\r\n\f]+", t or ""):
        out.append(re.sub(boundaries.AFTER + "$", "", re.sub("^" + boundaries.BEFORE, "", w)))
    return out


def plain_term(c):
    return re.sub(boundaries.LAST, "", c).lower()


LETTERS = [
    "We met Dr. Smith at noon. He spoke of Prof. Jones, who met Dr. Brown. The talk went on.",
    "Dr. Green came, e.g. for tea. The tea was hot! The cups (of Mr. Hill) were cold... He left. The end",
    'Did the doctor see Mr. Hill? "The man left." The rest saw Prof. Gray and Mr. Gray. The noon bell rang.',
    "He saw e.g. the man. Mr. Smith saw Dr. Hill. The tea of Prof. Hill and J. Brown, etc. The doctor knew the end.\n\nHe left, etc.",
    "", None, "   \n ", "one", "the tea. the tea. THE TEA!? x", "Dr.",
]


def test_boundaries_count_as_by_hand(spark):
    texts = spark.createDataFrame([(t,) for t in LETTERS], "text string")
    w = boundaries.words(texts)
    want, after = {}, {}
    for t in LETTERS:
        cores = plain_words(t)
        for i, c in enumerate(cores):
            dot = c.endswith(".") and not re.search(r"[!?][.!?]*$", c)
            n = want.setdefault(plain_term(c), [0, 0, 0, 0])
            n[0 if dot else 1] += 1
            n[2] += c[:1].islower()
            n[3] += c[:1].isupper() and i > 0 and not re.search(r"[.!?]$", cores[i - 1])
            if re.search(r"[.!?]$", c) and i + 1 < len(cores):
                k = (plain_term(c), dot, plain_term(cores[i + 1]))
                after[k] = after.get(k, 0) + 1
    assert {r["term"]: [*r[1:]] for r in boundaries.counts(w).collect()} == want
    assert {(r["term"], r["dot"], r["after"]): r["m"] for r in boundaries.ends(w).collect()} == after
    n, dots = sum(a + b for a, b, *_ in want.values()), sum(v[0] for v in want.values())
    scores = {r["term"]: r["score"] for r in boundaries.abbreviation_scores(boundaries.counts(w)).collect()}
    for t, (d, b, *_) in want.items():
        if d and t.lower() != t.upper():
            k = len(t.replace(".", ""))
            ratio = -2 * (d * math.log(dots / n) + b * math.log(1 - dots / n) - d * math.log(0.99) - b * math.log(0.01))
            assert math.isclose(scores.pop(t), ratio * math.exp(-k) * (t.count(".") + 1) * k**-b, rel_tol=1e-9, abs_tol=1e-12)
    assert not scores


def test_boundaries_split(spark, tmp_path):
    texts = spark.createDataFrame(list(enumerate(LETTERS * 3)), "_id long, text string")
    model = boundaries.Boundaries.learn(texts)
    model.save(str(tmp_path))
    again = boundaries.Boundaries.load(spark, str(tmp_path))
    assert {"dr", "mr", "e.g"} <= {r["term"] for r in again.abbreviations.collect()}
    got = {r["_id"]: r["sentences"] for r in boundaries.split(texts, again).collect()}
    assert len(got) == 3 * len(LETTERS) and all(got[i] == got[i + len(LETTERS)] for i in range(len(LETTERS)))
    assert got[0] == ["We met Dr. Smith at noon.", "He spoke of Prof. Jones, who met Dr. Brown.", "The talk went on."]
    assert got[1] == ["Dr. Green came, e.g. for tea.", "The tea was hot!", "The cups (of Mr. Hill) were cold... He left.", "The end"]
    assert got[2][:2] == ["Did the doctor see Mr. Hill?", '"The man left."'] and "The rest saw Prof. Gray and Mr. Gray." in got[2]
    assert got[4] == got[5] == got[6] == [] and got[7] == ["one"] and got[9] == ["Dr."]
    for i, t in enumerate(LETTERS):  # nothing is lost, nothing twice
        assert "".join("".join(got[i]).split()) == "".join((t or "").split())
    nothing = spark.createDataFrame([], "text string")
    assert boundaries.split(nothing, boundaries.Boundaries.learn(nothing)).count() == 0
    long = spark.createDataFrame([("Dr. Smith met Mr. Hill. " * 20000,)], "text string")
    assert len(boundaries.split(long, again).first()["sentences"]) == 20000


def shelf(folder):
    folder.mkdir()
    (folder / "sub").mkdir()
    big = {"META-INF/container.xml": BOX, "OPS/book.opf": OPF, "OPS/a.xhtml": "<h1>Second</h1>", "OPS/z first.xhtml": "<p>first &amp; foremost</p>"}
    big |= {f"OPS/n{i:03d}.html": f"<p>note {i} {random.Random(i).random()}</p>" for i in range(40)}
    (folder / "Great Book 1984.epub").write_bytes(zipped(**big))
    (folder / "sub" / "broken.epub").write_bytes(b"no zip")
    (folder / "sub" / "page.HTML").write_text("<title>t</title><h2>Chapter</h2><p>body</p>")
    (folder / "note.txt").write_bytes(b"")
    (folder / "_draft.txt").write_text("hidden")
    (folder / "other.bin").write_text("no book")
    return folder


def test_books_as_a_data_source(spark, tmp_path):
    folder = shelf(tmp_path / "my books")
    plain = books.pages(spark, str(folder)).collect()
    assert len(plain) == 46 and plain[0].asDict().keys() >= {"author", "size", "mtime", "text", "heading", "year", "error"}
    size = (folder / "Great Book 1984.epub").stat().st_size
    for split in (size // 7, size // 60, 10 * size):  # several tasks a book, more tasks than chapters, all files in one
        x = books.pages(spark, str(folder), split=split)
        assert rows_of(x.collect()) == rows_of(plain)
    assert spark.read.format("quillspark_books").option("split", size // 7).load(str(folder)).rdd.getNumPartitions() >= 7
    assert rows_of(books.pages(spark, f"file://{folder}").drop("path").collect()) == rows_of([[v for k, v in r.asDict().items() if k != "path"] for r in plain])
    book = sorted((r for r in plain if r["file_type"] == "epub" and "Great" in r["path"]), key=lambda r: r["page_num"])
    assert [r["page_num"] for r in book] == list(range(1, 44)) and {(r["title"], r["author"], r["year"]) for r in book} == {("A Book", "Some Body", 1984)}
    assert book[0]["text"] == "first & foremost" and book[1]["error"] and book[2]["heading"] == "Second" and "note 39 " in book[-1]["text"]
    rest = {r["path"].rsplit("/", 1)[1]: r for r in plain if r["page_num"] == 1}
    assert rest["broken.epub"]["error"] and rest["page.HTML"]["heading"] == "Chapter" and rest["note.txt"]["text"] == "" and rest["broken.epub"]["title"] == "broken"
    old = files.pages(files.listing(spark, str(folder), "*.{epub,HTML}")).collect()  # the reader of whole files agrees
    assert rows_of((r["page_num"], r["text"], r["heading"]) for r in old if not r["error"]) == rows_of((r["page_num"], r["text"], r["heading"]) for r in plain if not r["error"] and r["file_type"] != "txt")
    assert books.pages(spark, str(folder), keep_empty=False).count() == 43
    (tmp_path / "bare").mkdir()
    assert books.pages(spark, str(tmp_path / "bare")).count() == 0


def test_books_read_only_what_is_asked(spark, tmp_path, monkeypatch):
    folder = shelf(tmp_path / "in")
    found = books.listing(spark, str(folder)).collect()
    assert sorted(r["path"].rsplit("/", 1)[1] for r in found) == ["Great Book 1984.epub", "broken.epub", "note.txt", "page.HTML"] and all(r["mtime"] > 1e9 for r in found)
    opened, unpacked = [], []
    plain, read = books.Folder.open, zipfile.ZipFile.read
    monkeypatch.setattr(books.Folder, "open", lambda self, path: opened.append(path) or plain(self, path))
    monkeypatch.setattr(zipfile.ZipFile, "read", lambda self, name, *a: unpacked.append(name) or read(self, name, *a))

    def rows(columns, **options):
        opened.clear(), unpacked.clear()
        reader = books.BookReader(StructType.fromDDL(columns), {"path": str(folder), **options})
        return [r for p in reader.partitions() for r in reader.read(p)]

    assert len(rows("path string, mtime double, size long", rows="files")) == 4 and not opened
    assert ("A Book",) in rows("title string", rows="files") and not [n for n in unpacked if n.endswith("html")]
    assert len(rows("path string, page_num int")) == 46 and not [n for n in unpacked if n.endswith("html")]
    assert len(rows("raw string")) == 46 and len([n for n in unpacked if n.endswith("html")]) == 43
    for columns, options in (("nothing string", {}), ("path string", {"rows": "lines"}), ("path string", {"split": "0"})):
        with pytest.raises(ValueError):
            rows(columns, **options)


def test_books_as_a_stream(spark, tmp_path):
    folder, out = shelf(tmp_path / "in"), tmp_path / "out"

    def step():
        x = books.page_stream(spark, str(folder)).select("path", "page_num", "text", "mtime")
        x.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start(str(out)).awaitTermination()
        return spark.read.schema("path string, page_num int, text string, mtime double").parquet(str(out))

    assert step().count() == 46 and step().count() == 46  # nothing twice
    time.sleep(0.01)
    (folder / "late.txt").write_text("late")
    (folder / "note.txt").write_text("changed")
    got = step()
    assert got.count() == 48 and {r["text"] for r in got.filter("path LIKE '%note.txt' OR path LIKE '%late.txt'").collect()} == {"", "changed", "late"}
    (folder / "late.txt").unlink()
    assert step().count() == 48


def test_sound_index(spark, tmp_path):
    rows = [(1, "a", "Shakespeare wrote of Smyth"), (2, "b", "smith and shakespear"), (3, "c", "nothing"), (4, "d", "x " * 300 + "smith"), (5, "e", "no of"), (6, "f", None), (7, "g", "")]
    chunks = spark.createDataFrame(rows, "doc_id long, chunk_id string, content string")
    index = search.Index.build(chunks, chunks.select("doc_id"))
    index.save(str(tmp_path / "index"))
    for i in (index, search.Index.load(spark, str(tmp_path / "index"))):
        for asked in (["shakespeer", "smithe"], ["smeth"], ["zzzz"], ["no"], ["of", "of"], []):
            assert rows_of(search.sounding_like(i, i.chunks, asked).collect()) == rows_of(search.sounding(chunks, asked).collect())
    assert {r["chunk_id"]: r["score"] for r in search.sounding_like(index, index.chunks, ["shakespeer", "smithe"]).collect()} == {"a": 2.0, "b": 2.0}
    more = spark.createDataFrame([(2, "b", "a knight rode"), (8, "h", "night and nite")], "doc_id long, chunk_id string, content string")
    for changed, left in ((index.upserted(more, more.select("doc_id")), chunks.filter("doc_id <> 2").union(more)), (index.deleted(spark.createDataFrame([(1,)], "doc_id long")), chunks.filter("doc_id <> 1"))):
        assert rows_of(changed.sounds.collect()) == rows_of(search.Index.build(left, left.select("doc_id")).sounds.collect())
    plan = search.sounding_like(search.Index.load(spark, str(tmp_path / "index")), index.chunks, ["smith"])._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PushedFilters: \[[^\]]*EqualTo\(key", plan)  # the sorted keys are read, not the contents' words


def test_jaccard_pairs_of_frequent_words(spark):
    """texts of few, frequent words: every pair that resembles is found, and others are next to no candidates."""
    import random

    r = random.Random(4)
    letters = "abcdefghijklmnopqrstuvwxyz"
    words = [a + b for a in letters[:12] for b in letters[:10]]
    texts = [" ".join(r.sample(words, 30)) for _ in range(300)] + [" ".join(r.sample(words[:7], r.randint(1, 6))) for _ in range(60)] + ["", "aa", None, "aa ab", "zz"]
    texts += [t + " aa ab zz" for t in texts[:10]] + [" ".join(w for w in t.split()[:26]) for t in texts[:10]]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    sets = {}
    for i, t in enumerate(texts):
        sets.setdefault(frozenset((t or "").split()), i)
    sets.pop(frozenset())
    for least in (0.3, 0.5, 0.7, 1.0):
        want = {(min(i, j), max(i, j)) for a, i in sets.items() for b, j in sets.items() if i != j and len(a & b) >= least * len(a | b) - 1e-9}
        assert {(x["id_a"], x["id_b"]) for x in ranking.jaccard_pairs(docs, "text", threshold=least).collect()} == want, least
    words = [a + b for a in letters for b in letters[:15]]
    classes = spark.createDataFrame([(i, sorted(r.sample(words, 30))) for i in range(300)], "id long, t array<string>")
    assert ranking.jaccard_candidates(classes, 0.7).count() < 5_000  # of 44,850 pairs; 18,805 share one of their 10 rarest words


def test_segmented_index_equals_the_other(spark, tmp_path):
    """F2 to F12: an index whose postings no shuffle makes, of the tables that a query reads alone, gives what the other gives."""
    from quillspark.operators import postings

    r = random.Random(3)
    words = ["okapi", "okapis", "Model", "models", "the", "of", "smith", "smyth", "x1", "don't"]
    texts = [" ".join(r.choice(words) for _ in range(r.randint(0, 40))) for _ in range(120)] + ["", None, "...", "of the models", "okapi " * 700]
    chunks = spark.createDataFrame([(i, f"c{i}", t) for i, t in enumerate(texts)], "doc_id long, chunk_id string, content string")
    path, documents = str(tmp_path / "index"), chunks.select("doc_id", (F.col("doc_id") % 2).alias("odd"))
    asked = spark.createDataFrame([(1, "okapi models"), (2, "the smith of x1"), (3, "nothing"), (4, "models model")], "query_id int, text string")
    for stems in (False, True):
        plain, kept = search.Index.build(chunks, documents, stems), search.Segmented(chunks, documents, path, stems)
        for name in ("places", "tf", "words", "df", "stats", "sounds", "limits", "cooc"):
            one = getattr(plain, name)
            assert rows_of(getattr(kept, name).select(one.columns).collect()) == rows_of(one.collect()), (stems, name)
        assert stems or search.search(kept, '"of the" models', filters={"odd": 1}).collect() == search.search(plain, '"of the" models', filters={"odd": 1}).collect()
        assert rows_of(search.batch_search(kept, asked, 5).collect()) == rows_of(search.batch_search(plain, asked, 5).collect())
    made = postings.segments(chunks, ["doc_id", "chunk_id"], "content")._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in made
    (tmp_path / "few").mkdir()
    search.Segmented(chunks, documents, str(tmp_path / "few"), False).sounds.collect()
    assert sorted(p.name for p in (tmp_path / "few").iterdir()) == ["places", "sounds", "words"]  # what is not asked for is not made
    found = search.batch_search(search.Segmented(chunks, documents, path, False), asked, 5)
    found.collect()
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan


def test_segmented_search_by_stems_keeps_words_alone(spark, tmp_path):
    """a search by stems reads the postings of words and keeps none of stems beside them."""
    r = random.Random(9)
    words = ["okapi", "okapis", "Model", "models", "modelled", "the", "of", "theory", "relational", "don't"]
    texts = [" ".join(r.choice(words) for _ in range(r.randint(0, 30))) for _ in range(150)] + ["", None, "...", "of the models"]
    chunks = spark.createDataFrame([(i, f"c{i}", t) for i, t in enumerate(texts)], "doc_id long, chunk_id string, content string")
    documents = chunks.select("doc_id", (F.col("doc_id") % 2).alias("odd"))
    plain, made = search.Index.build(chunks, documents), ["places", "spelt", "stats", "words"]
    (tmp_path / "a").mkdir()
    (tmp_path / "b").mkdir()
    kept = search.Segmented(chunks, documents, str(tmp_path / "a"))
    for raw, filters in (('"of the" models', {"odd": 1}), ("the okapis", None), ("modelling relate", None)):
        assert search.search(kept, raw, filters=filters).collect() == search.search(plain, raw, filters=filters).collect(), raw
    assert sorted(p.name for p in (tmp_path / "a").iterdir()) == made
    for terms in (["model", "okapi"], ["the", "nowhere"], []):
        assert rows_of(kept.counted(terms).collect()) == rows_of(plain.counted(terms).collect())
        assert rows_of(kept.asked(terms).collect()) == rows_of(plain.asked(terms).collect())
    kept = search.Segmented(chunks, documents, str(tmp_path / "b"))
    assert search.diagnostics(kept, 'what is "of the" okap').collect() == search.diagnostics(plain, 'what is "of the" okap').collect()
    assert sorted(p.name for p in (tmp_path / "b").iterdir()) == ["places", "spelt", "words"]
    assert all("zstd" in p.name for p in (tmp_path / "b").rglob("*.parquet"))


def test_heads_pass_on_words_that_sound_alike_alone(spark, tmp_path, monkeypatch):
    """other words of the heads are not shuffled."""
    texts = ["a smith of models", "smyth smith smyth", "x " * 400 + "smith", "models", "", None]
    chunks = spark.createDataFrame([(i, f"c{i}", t) for i, t in enumerate(texts)], "doc_id long, chunk_id string, content string")
    index = search.Segmented(chunks, chunks.select("doc_id"), str(tmp_path / "index"))
    found = search.sounding_like(index, index.chunks, ["smythe", "modal"])
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert [x for x in plan.splitlines() if "filter(" in x and "smith" in x and "smyth" in x], plan
    want = rows_of(search.sounding(chunks, ["smythe", "modal"]).collect())
    assert rows_of(found.collect()) == want and len(want) == 2
    monkeypatch.setattr(search, "LISTED", 1)  # by a join
    assert rows_of(search.sounding_like(index, index.chunks, ["smythe", "modal"]).collect()) == want


def test_closest_window_equals_partial_ratio(spark):
    """the edit distances of all windows in step."""
    r = random.Random(6)
    texts = ["", None, "ab", "Erstt", "xxErsTyy", "é\U0001f600erst"] + ["".join(r.choice("erst é\U0001f600") for _ in range(r.randint(0, 90))) for _ in range(20)]
    chunks = spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "chunk_id string, content string")
    for needle in ("erstt", "Erst tsre", "rst" * 60):
        want = chunks.select("chunk_id", search.partial_ratio(F.col("content"), needle).alias("score")).collect()
        assert rows_of(search.closest(chunks, needle).collect()) == rows_of(want), needle
    assert "MapInArrow" in search.closest(chunks, "erst")._jdf.queryExecution().analyzed().toString()


def test_search_drops_duplicates_by_whole_texts(spark):
    """chunks of one beginning that go on differently are no duplicates, those of different beginnings that go on alike are."""
    word = lambda i: "".join(chr(97 + int(x)) for x in f"{i:04d}")
    of = lambda *r: " ".join(map(word, range(*r)))
    start = "okapi " + of(100)  # over 400 letters
    texts = {"a": f"{start} {of(1000, 1300)}", "b": f"{start} {of(2000, 2300)}", "c": f"okapi {of(3000, 3100)} {of(4000, 4700)}", "d": f"okapi {of(5000, 5100)} {of(4000, 4700)}"}
    chunks = spark.createDataFrame([(i, k, t) for i, (k, t) in enumerate(texts.items())], "doc_id long, chunk_id string, content string")
    index = search.Index.build(chunks, chunks.select("doc_id"))
    found = search.search(index, "okapi")
    assert {r["chunk_id"] for r in found.collect()} == {"a", "b", "c"}
    assert found._jdf.queryExecution().optimizedPlan().toString().count("InMemoryRelation") < 20  # what found the candidates is not repeated
    assert {r["chunk_id"] for r in search.search(index, "okapi", dedup=False).collect()} == set(texts)

    r = random.Random(1)
    words = [word(i) for i in range(60)]
    texts = [" ".join(r.sample(words[:k], r.randint(0, k))) for k in (3, 8, 25, 60) for _ in range(25)] + ["", None, "", "1 2", "Aa aa"]
    rows = [(i, float(r.randint(0, 20)), t) for i, t in enumerate(texts)]
    ranked = spark.createDataFrame(rows, "doc_id long, score double, text string")
    for head in (None, 20):
        kept = []
        for i, _, t in sorted(rows, key=lambda x: (-x[1], x[0]))[:100]:
            t = set(re.findall("[a-z]{2,}", (t or "").lower()[:head]))
            if not any(len(t & o) >= 0.7 * len(t | o) - 1e-9 for _, o in kept if t | o):
                kept.append((i, t))
        got = ranking.greedy_dedup(ranked, "text", limit=100, head=head).collect()
        assert sorted((x["position"], x["doc_id"]) for x in got) == [(n, i) for n, (i, _) in enumerate(kept)], head


def test_fallback_hears_words_anywhere(spark, tmp_path):
    """words that sound like the query's are found wherever they stand in a text, under filters."""
    r = random.Random(2)
    words = ["phase", "phases", "faze", "smith", "smyth", "xx", "the", "theory", "x1", "fhase"]
    texts = ["x " * 400 + "phase", "phase", "x " * 400, "x " * 300 + "Phase " + "y " * 300, "", None] + [" ".join(r.choice(words) for _ in range(r.randint(0, 300))) for _ in range(40)]
    chunks = spark.createDataFrame([(i, f"c{i}", t) for i, t in enumerate(texts)], "doc_id long, chunk_id string, content string")
    few = chunks.filter("doc_id < 6")
    docs = few.select("doc_id", (F.col("doc_id") % 2).alias("odd"))
    for index in (search.Index.build(few, docs), search.Segmented(few, docs, str(tmp_path / "few"))):
        for filters, want in ((None, {"c0", "c1", "c3"}), ({"odd": 0}, {"c0"})):
            got = search.fallback(index, "fyze", filters=filters).collect()
            assert {(x["chunk_id"], x["how"]) for x in got} == {(c, "sound") for c in want}
    every = search.Segmented(chunks, chunks.select("doc_id"), str(tmp_path / "every"))
    for asked in (["faze", "smeth"], ["the"], ["zzzz"], ["x", "xx"], []):
        for some in (every.chunks, every.chunks.filter("doc_id % 3 = 0")):
            assert rows_of(search.sounding_like(every, some, asked, head=None).collect()) == rows_of(search.sounding(some, asked, head=None).collect()), asked


def test_search_spelling_and_sound_hears_words_anywhere(spark, tmp_path):
    """the query counts words that sound like its own wherever they stand."""
    texts = ["x " * 400 + "airst", "airst", "airst shun", "x " * 400 + "airst " + "y " * 400 + "Shun", "x " * 400, None]
    spark.createDataFrame([(i, "en", "s", t) for i, t in enumerate(texts)], "doc_id long, lang string, source string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["chunk_id"]: r["heard"] for r in catalog.queries()["search_spelling_and_sound"](spark, str(tmp_path)).collect()}
    assert got == {"0": 1.0, "1": 1.0, "2": 2.0, "3": 2.0}
