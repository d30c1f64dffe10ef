"""Chunkers: pages to linked, identified chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillspark.functions.text import chunk_key, count_tokens, sentences

MAX_TOKENS, OVERLAP, MIN_TOKENS, HARD_CAP = 512, 32, 20, 800
#: Share of the limit from which a paragraph's end closes a chunk, where chunks are flushed so.
FULL = 0.7


def paragraphs(text: Column, pattern: str = r"\n[ \t\r]*\n+") -> Column:
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), pattern), F.trim), lambda p: p != "")


def fixed_windows(text: Column, size: int) -> Column:
    """White-space words, so many at a time, as array of strings."""
    words = F.filter(F.split(F.coalesce(text, F.lit("")), r"[ \t\r\n]+"), lambda w: w != "")
    starts = F.when(F.size(words) > 0, F.sequence(F.lit(0), F.size(words) - 1, F.lit(size))).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda s: F.array_join(F.slice(words, s + 1, F.lit(size)), " "))


def _units(text: Column, mode: str, cap: int) -> Column:
    """What is packed: struct<body, n>; sentences longer than cap are cut by words."""
    if mode == "flush":  # sentences; last: ends a paragraph
        by = F.transform(paragraphs(text), sentences)
        each = F.flatten(F.transform(by, lambda p: F.transform(p, lambda s, i: F.struct(s.alias("body"), count_tokens(s).alias("n"), (i == F.size(p) - 1).alias("last")))))
        return each
    whole = paragraphs(text) if mode == "paragraph" else sentences(text)
    if mode == "paragraph":
        whole = F.flatten(F.transform(whole, lambda p: F.when(count_tokens(p) > MAX_TOKENS, sentences(p)).otherwise(F.array(p))))
    cut = F.flatten(F.transform(whole, lambda s: F.when(count_tokens(s) > cap, fixed_windows(s, MAX_TOKENS)).otherwise(F.array(s))))
    return F.transform(cut, lambda s: F.struct(s.alias("body"), count_tokens(s).alias("n"), F.lit(False).alias("last")))


def packed(text: Column, mode: str = "sentence", limit: int = MAX_TOKENS, overlap: int = OVERLAP, cap: int = HARD_CAP) -> Column:
    """Greedy packing into chunks of at most limit tokens, as array<struct<body, lap>>; lap: how many letters of the
    chunk before open it.

    sentence: trailing whole sentences of at most `overlap` tokens open the next chunk; words: the last `overlap`
    words do; paragraph: paragraphs, no overlap; flush: sentences, no overlap, and a paragraph's end closes a chunk that
    is FULL. One pass over the units with a struct as state."""
    units = _units(text, mode, cap)
    unit = "struct<body:string,n:int,last:boolean>"
    state = F.struct(
        F.array().cast("array<struct<body:string,lap:int>>").alias("done"),
        F.array().cast(f"array<{unit}>").alias("cur"),
        F.lit(0).alias("total"),
        F.lit(0).alias("lap"),
        F.lit(False).alias("fresh"),
    )
    body = lambda cur: F.array_join(F.transform(cur, lambda u: u["body"]), "\n\n" if mode == "paragraph" else " ")

    def tail(cur: Column) -> Column:
        if mode in ("paragraph", "flush") or overlap <= 0:
            return F.array().cast(f"array<{unit}>")
        if mode == "words":
            words = F.split(body(cur), " ")
            kept = F.array_join(F.slice(words, F.greatest(F.lit(1), F.size(words) - overlap + 1), F.lit(overlap)), " ")
            return F.array(F.struct(kept.alias("body"), count_tokens(kept).alias("n"), F.lit(False).alias("last")))
        back = F.aggregate(
            F.reverse(cur),
            F.struct(F.array().cast(f"array<{unit}>").alias("keep"), F.lit(0).alias("n"), F.lit(True).alias("on")),
            lambda a, u: F.when(
                a["on"] & (a["n"] + u["n"] <= overlap),
                F.struct(F.concat(F.array(u), a["keep"]).alias("keep"), (a["n"] + u["n"]).alias("n"), F.lit(True).alias("on")),
            ).otherwise(F.struct(a["keep"].alias("keep"), a["n"].alias("n"), F.lit(False).alias("on"))),
        )
        return back["keep"]

    def total(cur: Column) -> Column:
        return F.aggregate(cur, F.lit(0), lambda s, u: s + u["n"])

    def closed(a: Column) -> Column:
        return F.concat(a["done"], F.array(F.struct(body(a["cur"]).alias("body"), a["lap"].alias("lap"))))

    def step(a: Column, u: Column) -> Column:
        kept = tail(a["cur"])
        fits = ~a["fresh"] | (a["total"] + u["n"] <= limit)
        full = u["last"] & (F.when(fits, a["total"]).otherwise(0) + u["n"] > int(FULL * limit)) if mode == "flush" else F.lit(False)
        nothing = F.array().cast(f"array<{unit}>")
        add = F.struct(a["done"].alias("done"), F.concat(a["cur"], F.array(u)).alias("cur"), (a["total"] + u["n"]).alias("total"), a["lap"].alias("lap"), F.lit(True).alias("fresh"))
        lap = F.when(F.size(kept) > 0, F.length(body(kept)) + 1).otherwise(0)
        flush = F.struct(closed(a).alias("done"), F.concat(kept, F.array(u)).alias("cur"), (total(kept) + u["n"]).alias("total"), lap.alias("lap"), F.lit(True).alias("fresh"))
        now = F.when(fits, add).otherwise(flush)
        return F.when(full, F.struct(closed(now).alias("done"), nothing.alias("cur"), F.lit(0).alias("total"), F.lit(0).alias("lap"), F.lit(False).alias("fresh"))).otherwise(now) if mode == "flush" else now

    return F.aggregate(units, state, step, lambda a: F.when(a["fresh"], closed(a)).otherwise(a["done"]))


def merge_small_tail(chunks: Column, least: int = MIN_TOKENS, most: int = MAX_TOKENS + 20) -> Column:
    """Of array<struct<body, lap>>: a last chunk of fewer than least tokens joins the one before if both fit."""
    n = F.size(chunks)
    last, prior = F.try_element_at(chunks, F.lit(-1)), F.try_element_at(chunks, F.lit(-2))
    small = (n > 1) & (count_tokens(last["body"]) < least) & (count_tokens(prior["body"]) + count_tokens(last["body"]) <= most)
    both = F.struct(F.concat_ws(" ", prior["body"], last["body"]).alias("body"), prior["lap"].alias("lap"))
    return F.when(small, F.concat(F.slice(chunks, F.lit(1), F.greatest(n - 2, F.lit(0))), F.array(both))).otherwise(chunks)


def placed(chunks: Column, text: Column) -> Column:
    """array<struct<body, start>> of array<struct<body, lap>>: where each chunk begins in the text. White space between
    units may be longer in the text than in the chunk, never shorter, so a chunk begins no earlier than the end of the
    one before less what both share; from there its first 60 letters are looked for, or if they span such a gap, its first
    word."""
    at = lambda what, low: F.call_function("locate", what, text, low + 1) - 1

    def step(a: Column, c: Column) -> Column:
        low = F.greatest(F.lit(0), a["stop"] - c["lap"])
        whole, word = at(F.substring(c["body"], 1, 60), low), at(F.regexp_extract(c["body"], r"^\S+", 0), low)
        start = F.when(whole >= 0, whole).when(word >= 0, word).otherwise(low)
        return F.struct(F.concat(a["done"], F.array(F.struct(c["body"].alias("body"), start.alias("start")))).alias("done"), (start + F.length(c["body"])).alias("stop"))

    begin = F.struct(F.array().cast("array<struct<body:string,start:int>>").alias("done"), F.lit(0).alias("stop"))
    return F.aggregate(chunks, begin, step, lambda a: a["done"])


def chunk_pages(pages: DataFrame, mode: str = "sentence", **options) -> DataFrame:
    """(doc_id, page_num, text) to chunks: doc_id, page_num, chunk_idx (over the document), chunk_id, content,
    token_count, start (where the chunk begins in the page), prev_id, next_id. A null or empty page gives none."""
    pieces = placed(merge_small_tail(packed(F.col("text"), mode, **options)), F.col("text"))
    x = pages.select("doc_id", "page_num", F.posexplode(pieces).alias("at", "piece")).select("doc_id", "page_num", "at", F.col("piece.body").alias("content"), F.col("piece.start").alias("found"))
    x = x.withColumn("token_count", count_tokens(F.col("content"))).withColumn("stop", F.col("found") + F.length("content"))
    x = x.withColumn("chunk_id", F.sha1(F.concat_ws("|", "doc_id", "page_num", "found", "stop", "at")))
    return linked(x, ["page_num", "at"]).select("doc_id", "page_num", "chunk_idx", "chunk_id", "content", "token_count", F.col("found").alias("start"), "prev_id", "next_id")


def linked(chunks: DataFrame, order: list[str]) -> DataFrame:
    """chunk_idx from 0 and the ids of the chunks before and after, by document."""
    w = W.partitionBy("doc_id").orderBy(*order)
    return chunks.withColumns({"chunk_idx": F.row_number().over(w) - 1, "prev_id": F.lag("chunk_id").over(w), "next_id": F.lead("chunk_id").over(w)})


def fixed_chunks(docs: DataFrame, size: int = MAX_TOKENS) -> DataFrame:
    """Documents in windows of so many white-space words, identified and linked."""
    x = docs.select("doc_id", F.posexplode(fixed_windows(F.col("text"), size)).alias("at", "content"))
    first = (F.col("at") * size).cast("int")
    x = x.withColumn("chunk_id", chunk_key(F.col("doc_id").cast("string"), F.lit(1), first, first + F.size(F.split("content", " "))))
    return linked(x, ["at"]).select("doc_id", "chunk_idx", "chunk_id", "content", "prev_id", "next_id")
