"""Quotation linking: reply-ordered conversations without quotes, in DataFrame functions only.

A line's quote level is the number of `>` before it. Lines of one level in a row are a passage; its whole, its
paragraphs and its lines are normalised and hashed, as are those of every message's own text. A message replies to the
one that first said the longest passage it quotes; where it quotes nothing known, to the message before it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import attached, discard, scratch

#: Turns, or depths, of one block of the stepwise windows; keeps any one conversation from landing in one task.
BLOCK = 512
#: Letters that a passage must have to be linked to another conversation: what is shorter is said in many.
AWAY_LETTERS = 16
#: How mail programs close the line that introduces a quotation.
ATTRIBUTION = r"(?i)(wrote|writes|schrieb|a écrit|escribió)[ \t]*:[ \t]*$"
MARK = r"^([ \t]*>)+"


def trimmed(c: Column) -> Column:
    return F.regexp_replace(c, r"^[ \t\r\n]+|[ \t\r\n]+$", "")


def normalised(c: Column) -> Column:
    return F.lower(trimmed(F.regexp_replace(c, r"[ \t\r\n]+", " ")))


def passages(text: Column) -> Column:
    """array<struct<level, body>>: stretches of lines of one quote level, in order. Control letters 1 and 2, which
    part them on the way, are blanked first."""
    lines = F.split(F.translate(F.coalesce(text, F.lit("")), "\x01\x02", "  "), r"\r?\n")
    levels = F.transform(lines, lambda x: F.length(F.regexp_replace(F.regexp_extract(x, MARK, 0), "[^>]", "")))
    bodies = F.transform(lines, lambda x: F.regexp_replace(x, MARK + "[ ]?", ""))
    before = F.concat(F.array(F.lit(-1)), F.slice(levels, F.lit(1), F.size(levels) - 1))
    marks = F.zip_with(levels, before, lambda x, y: F.when(x == y, F.lit("\n")).otherwise(F.concat(F.lit("\x01"), x.cast("string"), F.lit("\x02"))))
    joined = F.array_join(F.zip_with(marks, bodies, lambda m, b: F.concat(m, b)), "")
    parts = F.filter(F.split(joined, "\x01"), lambda x: x != "")
    return F.transform(parts, lambda x: F.struct(F.substring_index(x, "\x02", 1).cast("int").alias("level"), F.substring_index(x, "\x02", -1).alias("body")))


def own_text(runs: Column) -> Column:
    """What a message says itself: level 0, without the lines that introduce quotations."""
    after = F.concat(F.slice(runs["level"], F.lit(2), F.size(runs)), F.array(F.lit(-1)))
    said = F.zip_with(
        runs,
        after,
        lambda r, n: F.when(r["level"] == 0, F.when((n > 0) & F.regexp_extract(r["body"], r"[^\n]*\n?$", 0).rlike(ATTRIBUTION), F.regexp_replace(r["body"], r"[^\n]*$", "")).otherwise(r["body"])),
    )
    return trimmed(F.array_join(F.filter(said, lambda x: x.isNotNull()), "\n"))


def units(bodies: Column) -> Column:
    """Normalised wholes, paragraphs and lines of these bodies, each once, without empty ones."""
    cut = lambda p: F.flatten(F.transform(bodies, lambda b: F.split(b, p)))
    every = F.concat(bodies, cut(r"\n[ \t\r]*\n"), cut(r"\n"))
    return F.array_distinct(F.filter(F.transform(every, normalised), lambda x: x != ""))


def reply_ordered(messages: DataFrame) -> DataFrame:
    """One row per row of messages (conv_id, turn, role, text): the same with own_text instead of text, and
    n_quoted (quoted passages), reply_conv and reply_turn (null for a message that replies to none), linked (by a quotation), root_turn, reply_depth
    and position (from 0) in the reply order of its conversation: by root, depth, turn.

    Originals are earlier messages of the conversation; of several, the first that said the passage. Of several
    passages found, those of the outermost level count, then the longest, then the later original. A passage of at least
    AWAY_LETTERS letters that is found only in other conversations (or later in its own) links to the first of them: that
    gives reply_conv and linked, but leaves the message's place to its own conversation. Null or empty texts quote nothing.
    Rows without conv_id or turn come back with no reply, place or position. Repeated (conv_id, turn) rows share a
    place, ties in position going by role and text. Extra columns are dropped. No conversation or passage, however
    common, is gathered in one task: originals are aggregated per passage before the join, rows that share a passage or
    an ancestor meet it where they are (attached), orders are made in blocks."""
    m = messages.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), passages(F.col("text").cast("string")).alias("runs"))
    m = m.select(
        "conv_id",
        "turn",
        "role",
        own_text(F.col("runs")).alias("own_text"),
        F.filter("runs", lambda r: r["level"] > 0).alias("quoted"),
    )
    m = scratch(m, "quotes-messages")
    placed = m.filter("conv_id IS NOT NULL AND turn IS NOT NULL")
    hashed = lambda c: F.struct(F.xxhash64(c).alias("h1"), F.crc32(c).alias("h2"), F.length(c).alias("n"))
    said = placed.select("conv_id", "turn", F.explode(units(F.array("own_text"))).alias("u")).select("conv_id", "turn", hashed(F.col("u")).alias("h"))
    said = scratch(said.groupBy("conv_id", "h").agg(F.min("turn").alias("turn")), "quotes-said")
    asks = placed.filter(F.size("quoted") > 0).select("conv_id", "turn", F.explode("quoted").alias("q")).select("conv_id", "turn", (-F.col("q.level")).alias("near"), F.explode(units(F.array("q.body"))).alias("u"))
    asks = scratch(asks.groupBy("conv_id", "turn", hashed(F.col("u")).alias("h")).agg(F.max("near").alias("near")), "quotes-asks")
    n_asks = asks.count()
    times = lambda rows, *keys: rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    first = said.select("conv_id", "h", F.col("turn").alias("orig")).join(times(asks, "conv_id", "h"), ["conv_id", "h"])
    here = attached(asks, first, ["conv_id", "h"], n_asks).filter("orig < turn").select("conv_id", "turn", F.struct("near", F.col("h.n").alias("n"), F.col("orig")).alias("best"))
    here = here.groupBy("conv_id", "turn").agg(F.max("best").alias("best")).select("conv_id", "turn", F.col("best.orig").alias("orig"))
    # of each passage the first conversation that said it, and the first but that one, which the first one's own rows take
    asked_n = times(asks, "h")
    long_said = said.filter(F.col("h.n") >= AWAY_LETTERS)
    ahead_of = long_said.groupBy("h").agg(F.min(F.struct("conv_id", "turn")).alias("first"), F.count(F.lit(1)).alias("n"))
    ahead_of = scratch(ahead_of.join(asked_n.select("h"), "h", "left_semi"), "quotes-first")
    others = attached(long_said, ahead_of, ["h"], said.count()).filter("first.conv_id <> conv_id")
    others = others.groupBy("h").agg(F.min(F.struct("conv_id", "turn")).alias("second"))
    origin = ahead_of.drop("n").join(others, "h", "left").join(asked_n, "h")
    found = attached(asks, origin, ["h"], n_asks).withColumn("first", F.when(F.col("first.conv_id") == F.col("conv_id"), F.col("second")).otherwise(F.col("first")))
    away = found.filter("first IS NOT NULL").groupBy("conv_id", "turn").agg(F.max(F.struct("near", F.col("h.n").alias("n"), F.col("first.conv_id").alias("c"), F.col("first.turn").alias("t"))).alias("away"))
    # the turn before, in blocks of turns
    turns = placed.select("conv_id", "turn").distinct().withColumn("block", F.floor(F.col("turn") / BLOCK))
    inside = W.partitionBy("conv_id", "block").orderBy("turn")
    blocks = turns.groupBy("conv_id", "block").agg(F.max("turn").alias("last"))
    blocks = blocks.withColumn("before", F.lag("last").over(W.partitionBy("conv_id").orderBy("block"))).drop("last")
    turns = turns.withColumn("prior", F.lag("turn").over(inside)).join(blocks, ["conv_id", "block"]).select("conv_id", "turn", F.coalesce("prior", "before").alias("prior"))
    tree = turns.join(here, ["conv_id", "turn"], "left").join(away, ["conv_id", "turn"], "left")
    tree = scratch(tree.select("conv_id", "turn", F.coalesce("orig", "prior").alias("parent"), F.col("orig").isNotNull().alias("by_quote"), "away"), "quotes-tree")
    # roots and depths by doubling: up is an ancestor, depth the steps to it; a row whose up is known for a root rests
    root = F.col("parent").isNull()
    now = scratch(tree.select("conv_id", "turn", F.coalesce("parent", "turn").alias("up"), (~root).cast("long").alias("depth"), root.alias("top")), "quotes-up")
    discard(asks)
    discard(said)
    discard(ahead_of)
    while going := now.filter("NOT top").count():
        left = now.filter("NOT top")
        above = now.select("conv_id", F.col("turn").alias("up"), F.col("up").alias("up2"), F.col("depth").alias("depth2"), F.col("top").alias("top2")).join(times(left, "conv_id", "up"), ["conv_id", "up"])
        moved = attached(left, above, ["conv_id", "up"], going).select("conv_id", "turn", F.col("up2").alias("up"), (F.col("depth") + F.col("depth2")).alias("depth"), F.col("top2").alias("top"))
        new = scratch(now.filter("top").unionByName(moved), "quotes-up")
        discard(now)
        now = new
    now = now.drop("top")
    tree = tree.join(now.withColumnRenamed("up", "root_turn"), ["conv_id", "turn"])
    # position: rows before in the cell of a depth and some turns, cells before in the block of some depths, blocks before
    x = placed.join(tree, ["conv_id", "turn"]).withColumns({"block": F.floor(F.col("depth") / BLOCK), "cell": F.floor(F.col("turn") / BLOCK)})
    ahead = lambda rows, by, order, name: rows.withColumn(name, F.coalesce(F.sum("n").over(W.partitionBy(*by).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    cells = times(x, "conv_id", "root_turn", "block", "depth", "cell")
    blocks = ahead(cells.groupBy("conv_id", "root_turn", "block").agg(F.sum("n").alias("n")), ["conv_id"], ["root_turn", "block"], "ahead").drop("n")
    cells = ahead(cells, ["conv_id", "root_turn", "block"], ["depth", "cell"], "within").drop("n")
    cells = cells.join(blocks, ["conv_id", "root_turn", "block"]).select("conv_id", "root_turn", "depth", "cell", (F.col("ahead") + F.col("within")).alias("ahead"))
    place = F.row_number().over(W.partitionBy("conv_id", "root_turn", "depth", "cell").orderBy("turn", "role", "own_text")) - 1
    x = x.withColumn("place", place).join(cells, ["conv_id", "root_turn", "depth", "cell"])
    away_only = F.col("away").isNotNull() & ~F.col("by_quote")
    said_by = ["conv_id", "turn", "role", "own_text", F.size("quoted").cast("long").alias("n_quoted")]
    null = F.lit(None).cast("long")
    no_place = m.filter("conv_id IS NULL OR turn IS NULL").select(*said_by, null.alias("reply_conv"), null.alias("reply_turn"), F.lit(False).alias("linked"), *(null.alias(c) for c in ("root_turn", "reply_depth", "position")))
    in_place = x.select(
        *said_by,
        F.when(away_only, F.col("away.c")).when(F.col("parent").isNotNull(), F.col("conv_id")).alias("reply_conv"),
        F.when(away_only, F.col("away.t")).otherwise(F.col("parent")).alias("reply_turn"),
        (F.col("by_quote") | F.col("away").isNotNull()).alias("linked"),
        "root_turn",
        F.col("depth").alias("reply_depth"),
        (F.col("ahead") + F.col("place")).alias("position"),
    )
    return in_place.union(no_place)


def op7_chat_format(spark, sf_dir: str) -> DataFrame:
    return reply_ordered(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


QUERIES = {"op7_chat_format": op7_chat_format}

_ATTRIBUTED = r"(?i)(wrote|writes|schrieb|a écrit|escribió)[ \t]*:[ \t]*\n?$"


def _unit_sql(source: str, columns: str) -> str:
    clean = r"lower(regexp_replace(regexp_replace(x, '[ \t\r\n]+', ' ', 'g'), '^[ \t\r\n]+|[ \t\r\n]+$', '', 'g'))"
    parts = r"list_concat([body], regexp_split_to_array(body, '\n[ \t\r]*\n'), string_split(body, chr(10)))"
    return f"SELECT DISTINCT {columns}, u FROM (SELECT {columns}, {clean} AS u FROM (SELECT {columns}, unnest({parts}) AS x FROM {source})) WHERE u <> ''"


_OP7_SQL = rf"""
WITH RECURSIVE m AS (SELECT row_number() OVER () AS id, conv_id, turn, role, translate(coalesce(text, ''), chr(1) || chr(2), '  ') AS text FROM conversations),
l AS (SELECT id, unnest(a) AS line, generate_subscripts(a, 1) AS i FROM (SELECT id, regexp_split_to_array(text, '\r?\n') AS a FROM m)),
v AS (SELECT id, i, length(regexp_replace(regexp_extract(line, '^([ \t]*>)+', 0), '[^>]', '', 'g')) AS level, regexp_replace(line, '^([ \t]*>)+[ ]?', '') AS body FROM l),
g AS (SELECT *, sum(fresh) OVER (PARTITION BY id ORDER BY i) AS run FROM (SELECT *, (level IS DISTINCT FROM lag(level) OVER (PARTITION BY id ORDER BY i))::INTEGER AS fresh FROM v)),
r AS (SELECT id, run, any_value(level) AS level, string_agg(body, chr(10) ORDER BY i) AS body FROM g GROUP BY id, run),
n AS (SELECT *, lead(level) OVER (PARTITION BY id ORDER BY run) AS following FROM r),
own AS (SELECT id, regexp_replace(string_agg(CASE WHEN following > 0 AND regexp_matches(regexp_extract(body, '[^\n]*\n?$', 0), '{_ATTRIBUTED}')
  THEN regexp_replace(body, '[^\n]*(\n?)$', '\1') ELSE body END, chr(10) ORDER BY run), '^[ \t\r\n]+|[ \t\r\n]+$', '', 'g') AS body FROM n WHERE level = 0 GROUP BY id),
x AS (SELECT m.*, coalesce(own.body, '') AS own_text, (SELECT count(*) FROM r WHERE r.id = m.id AND level > 0) AS n_quoted FROM m LEFT JOIN own USING (id)),
said AS ({_unit_sql("(SELECT conv_id, turn, own_text AS body FROM x WHERE conv_id IS NOT NULL AND turn IS NOT NULL)", "conv_id, turn")}),
asks AS (SELECT conv_id, turn, u, min(level) AS level FROM ({_unit_sql("(SELECT m.conv_id, m.turn, r.level, r.body FROM r JOIN m USING (id) WHERE r.level > 0 AND conv_id IS NOT NULL AND turn IS NOT NULL)", "conv_id, turn, level")}) GROUP BY ALL),
firsts AS (SELECT conv_id, u, min(turn) AS orig FROM said GROUP BY ALL),
here AS (SELECT a.conv_id, a.turn, first(orig ORDER BY level, length(u) DESC, orig DESC) AS orig FROM asks a JOIN firsts USING (conv_id, u) WHERE orig < a.turn GROUP BY ALL),
origin AS (SELECT a.conv_id, a.turn, a.level, a.u, first(f.conv_id ORDER BY f.conv_id) AS c, first(f.orig ORDER BY f.conv_id) AS t
  FROM asks a JOIN firsts f ON a.u = f.u AND a.conv_id <> f.conv_id WHERE length(a.u) >= {AWAY_LETTERS} GROUP BY ALL),
away AS (SELECT conv_id, turn, first(c ORDER BY level, length(u) DESC, c DESC, t DESC) AS c, first(t ORDER BY level, length(u) DESC, c DESC, t DESC) AS t FROM origin GROUP BY conv_id, turn),
turns AS (SELECT conv_id, turn, lag(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS prior FROM (SELECT DISTINCT conv_id, turn FROM x WHERE conv_id IS NOT NULL AND turn IS NOT NULL)),
tree AS (SELECT t.conv_id, t.turn, coalesce(h.orig, t.prior) AS parent, h.orig IS NOT NULL AS by_quote, a.c, a.t FROM turns t LEFT JOIN here h USING (conv_id, turn) LEFT JOIN away a USING (conv_id, turn)),
deep AS (SELECT conv_id, turn, turn AS root_turn, 0::BIGINT AS depth FROM tree WHERE parent IS NULL
  UNION ALL SELECT k.conv_id, k.turn, d.root_turn, d.depth + 1 FROM tree k JOIN deep d ON k.conv_id = d.conv_id AND k.parent = d.turn)
SELECT x.conv_id, x.turn, x.role, own_text, n_quoted,
  CASE WHEN c IS NOT NULL AND NOT by_quote THEN c WHEN parent IS NOT NULL THEN x.conv_id END AS reply_conv,
  CASE WHEN c IS NOT NULL AND NOT by_quote THEN t ELSE parent END AS reply_turn,
  coalesce(by_quote OR c IS NOT NULL, false) AS linked, root_turn, depth AS reply_depth,
  CASE WHEN depth IS NOT NULL THEN row_number() OVER (PARTITION BY x.conv_id, depth IS NULL ORDER BY root_turn, depth, x.turn, x.role, own_text) - 1 END AS position
FROM x LEFT JOIN tree USING (conv_id, turn) LEFT JOIN deep USING (conv_id, turn)
"""
ORACLES = {"op7_chat_format": _OP7_SQL}
