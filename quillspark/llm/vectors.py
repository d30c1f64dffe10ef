"""Vectors: exact top-k by inner product with two cover trees, and near-duplicate links by collision counting."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import attached, components, discard, runs, scratch, ship, spanning, tiled

# ---------------------------------------------------------------- exact top-k

TOP, QUERY_MOD, SCALE = 20, 20, 64
#: Candidates of a block with its own tree, queries of a group with its own tree.
BLOCK, GROUP = 16_384, 8_192
#: Cells that rows are dealt into by nearest centre at most, and rows that the centres are found from.
CELLS, SAMPLE, SEED_CELLS = 4_096, 8_192, 3
#: Blocks of other cells that a query is sent to in one round.
FEW = 8
#: A level's radius against the next one's; rows of a node that is not split; rows that a child must have on average; rows
#: of a leaf compared at once.
BASE, LEAF, ROOM, STEP = 1.1, 64, 16, 1_024


class CoverTree:
    """A cover tree. A node of level l has a centre among its rows and covers them all within BASE**l. The centres of its
    children, the first its own, lie more than BASE**(l - 1) apart, and each row goes to the child with the nearest centre,
    within BASE**(l - 1). The small base makes many levels of few children where dimensions are many. Levels at which a
    node would have one child are left out. A node of at most LEAF rows is a leaf, as is one whose children would have
    fewer than ROOM rows on average: rows about equally far from each other fall into no groups, and comparing them costs
    less than walking them. radius is the measured distance of the farthest row, longest the largest norm of a row. Nodes
    are listed parents first; rows are reordered so that a node's are consecutive."""

    def __init__(self, x: np.ndarray):
        self.order = np.arange(len(x))
        self.begin, self.end, self.children, self.level = [], [], [], []
        centres, radii, longest = [], [], []
        norms = np.sqrt((x * x).sum(axis=1))
        mean = x.mean(axis=0)
        todo = [(0, len(x), int(np.argmin(((x - mean) ** 2).sum(axis=1))), -1)]
        while todo:
            a, b, centre, parent = todo.pop()
            node = len(self.begin)
            rows = self.order[a:b]
            dist = np.sqrt(((x[rows] - x[centre]) ** 2).sum(axis=1))
            radius = dist.max()
            self.begin.append(a)
            self.end.append(b)
            self.children.append([])
            centres.append(x[centre])
            radii.append(radius)
            longest.append(norms[rows].max())
            self.level.append(math.ceil(math.log(radius, BASE) - 1e-9) if radius > 0 else None)
            if parent >= 0:
                self.children[parent].append(node)
            if b - a <= LEAF or radius == 0:
                continue
            net, nearest, owner = [centre], dist, np.zeros(b - a, np.int64)
            while nearest.max() > BASE ** (self.level[node] - 1) and len(net) * ROOM <= b - a:
                far = int(rows[np.argmax(nearest)])
                d = np.sqrt(((x[rows] - x[far]) ** 2).sum(axis=1))
                owner[d < nearest] = len(net)
                nearest = np.minimum(nearest, d)
                net.append(far)
            if len(net) * ROOM > b - a or len(net) == 1:
                continue
            by = np.argsort(owner, kind="stable")
            self.order[a:b] = rows[by]
            at = a + np.searchsorted(owner[by], np.arange(len(net) + 1))
            todo += [(int(at[k]), int(at[k + 1]), c, node) for k, c in enumerate(net)]
        self.centre, self.radius, self.longest = np.array(centres), np.array(radii), np.array(longest)
        self.norm = np.sqrt((self.centre**2).sum(axis=1))


def top_of_block(q: np.ndarray, q_rows: np.ndarray, p: np.ndarray, p_ids: np.ndarray, p_rows: np.ndarray, k: int, least: np.ndarray | None = None, seen: dict | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Every query's k best rows of p by inner product, ties to smaller id, never the query's own row: number of the
    query, id, score. q and p hold integers as doubles; products too large to be exact in them are taken as 64-bit
    integers. least: scores below these don't matter. Both trees are walked together: a pair of nodes is dropped if no
    inner product below it can reach the worst k-th score of its queries. What a pair can reach follows from the covering
    radii in two ways, by the centres' product and by the gap between the two balls; the lower one holds. seen: gets how
    many node pairs were met, how many of them dropped, and how many products were taken."""
    tq, tp = CoverTree(q), CoverTree(p)
    q, qr, p, pi, pr = q[tq.order], q_rows[tq.order], p[tp.order], p_ids[tp.order], p_rows[tp.order]
    large = np.abs(q).max() * np.abs(p).max() * q.shape[1] >= 2.0**53
    worst = -np.inf if not large else np.iinfo(np.int64).min
    best = np.full((len(q), k), worst)
    who = np.full((len(q), k), np.iinfo(np.int64).max)
    bar = np.full(len(q), -np.inf) if least is None else least[tq.order].astype(float)
    floor = np.array([bar[b:e].min() for b, e in zip(tq.begin, tq.end, strict=True)])  # of each query node

    def most(a: int, b) -> np.ndarray:
        reach = (tq.norm[a] + tq.radius[a]) * (tp.norm[b] + tp.radius[b])
        product = tp.centre[b] @ tq.centre[a] + tq.radius[a] * tp.norm[b] + tp.radius[b] * tq.norm[a] + tq.radius[a] * tp.radius[b]
        gap = np.maximum(0.0, np.sqrt(((tp.centre[b] - tq.centre[a]) ** 2).sum(axis=-1)) * (1 - 1e-9) - tq.radius[a] - tp.radius[b])
        return np.minimum(product, (tq.longest[a] ** 2 + tp.longest[b] ** 2 - gap * gap) / 2) + 1e-9 * reach

    def compare(s: slice, e: slice) -> None:
        got = q[s] @ p[e].T if not large else q[s].astype(np.int64) @ p[e].T.astype(np.int64)
        _, x, y = np.intersect1d(qr[s], pr[e], return_indices=True)
        got[x, y] = worst
        hit = np.flatnonzero((got.max(axis=1) >= np.maximum(best[s, -1], bar[s])) & (got.max(axis=1) > worst))
        if not len(hit):
            return
        every = np.hstack([best[s][hit], got[hit]])
        cut = np.partition(every, every.shape[1] - k, axis=1)[:, -k]
        row, col = np.nonzero((every >= cut[:, None]) & (every > worst))
        name = np.where(col < k, who[s][hit][row, np.minimum(col, k - 1)], pi[e][np.maximum(col - k, 0)])
        order = np.lexsort((name, -every[row, col], row))
        row, col, name = row[order], col[order], name[order]
        place = np.arange(len(row)) - np.searchsorted(row, row)
        keep = place < k
        at = s.start + hit[row[keep]]
        best[s.start + hit], who[s.start + hit] = worst, np.iinfo(np.int64).max
        best[at, place[keep]], who[at, place[keep]] = every[row[keep], col[keep]], name[keep]

    stack = [(0, 0, float("inf"))]
    met = dropped = taken = 0
    while stack:
        a, b, bound = stack.pop()
        met += 1
        if bound < floor[a]:
            dropped += 1
            continue
        ca, cb = tq.children[a], tp.children[b]
        if not ca and not cb:
            s = slice(tq.begin[a], tq.end[a])
            taken += (tq.end[a] - tq.begin[a]) * (tp.end[b] - tp.begin[b])
            for c in range(tp.begin[b], tp.end[b], STEP):
                compare(s, slice(c, min(c + STEP, tp.end[b])))
            floor[a] = np.maximum(best[s, -1].astype(float), bar[s]).min()
            continue
        if ca and (not cb or tq.end[a] - tq.begin[a] > tp.end[b] - tp.begin[b]):
            for x in ca:
                floor[x] = max(floor[x], floor[a])
            stack += [(x, b, float(most(x, b))) for x in ca]
        else:
            bounds = most(a, np.array(cb))
            stack += [(a, cb[i], float(bounds[i])) for i in np.argsort(bounds)]  # the most promising comes off first
    if seen is not None:
        seen.update(met=met, dropped=dropped, products=taken)
    keep = best > worst
    return np.repeat(tq.order, keep.sum(axis=1)), who[keep], best[keep].astype(np.int64)


def centres_of(sample: np.ndarray, n: int, rounds: int = 4) -> np.ndarray:
    """So many centres of the sample, by a few rounds of k-means."""
    x = sample[np.random.default_rng(SEED_CELLS).permutation(len(sample))]
    c = x[: min(n, len(x))].copy()
    for _ in range(rounds):
        own = np.argmax(x @ c.T - 0.5 * (c**2).sum(axis=1), axis=1)
        n_own = np.bincount(own, minlength=len(c))
        total = np.zeros_like(c)
        np.add.at(total, own, x)
        c[n_own > 0] = total[n_own > 0] / n_own[n_own > 0, None]
    return c


def matrices(column) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Vectors of a list column (without nulls) by their length: row numbers, matrix."""
    flat, at = column.flatten().to_numpy(), np.diff(column.offsets.to_numpy())
    first = np.cumsum(at) - at
    for d in np.unique(at):
        rows = np.flatnonzero(at == d)
        yield rows, flat[first[rows][:, None] + np.arange(d)]


def usable(vector) -> F.Column:
    """Not null, without null or non-finite components."""
    fine = F.forall(vector, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    return F.coalesce(fine & (F.size(vector) > 0), F.lit(False))


def exact_top_k(vectors: DataFrame, k: int = TOP, query_mod: int = QUERY_MOD, scale: int = SCALE) -> DataFrame:
    """The k highest inner products of floor(scale * x) of every row whose vec_id is divisible by query_mod, against
    every other row: query_id, rank, vec_id, score; fewer rows if there are fewer candidates. Ties go to the smaller
    vec_id.

    Vectors that are null or hold null or non-finite components take no part, nor do rows without id, nor vectors with a
    scaled component beyond sqrt(2^62 / length), whose products need more than 64 bits. Rows that share an id are rows of
    their own: each is a candidate (also of the others), and each a query with its own ranks. Only vectors of equal length
    meet.

    Rows are dealt into cells by nearest centre (of a bounded sample), cells into blocks by hash. A query is first
    searched in its own cell; its k-th score there then tells which other cells can hold better ones, by their centre and
    radius. It is sent to the most promising FEW of their blocks, which may raise its k-th score, then to the next, until
    none can hold a better row: no more than FEW copies of the queries stand on disk at once. A task searches one block
    for one group of queries with two trees; k rows per query and block go on to the ranking. Memory: a block, a group
    and their trees; the driver holds at most CELLS centres of each length."""
    spark = vectors.sparkSession
    ship(spark)
    v = F.col("embedding").cast("array<double>")
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).filter(F.col("vec_id").isNotNull() & usable(F.col("v")))
    rows = rows.select(F.monotonically_increasing_id().alias("r"), "vec_id", F.transform("v", lambda x: F.floor(x * scale).cast("double")).alias("v"), F.size("v").alias("n"))
    first = scratch(rows.filter(F.forall("v", lambda x: F.abs(x) <= F.sqrt(F.lit(2.0**62) / F.col("n")))), "topk-rows")
    rows = first
    totals = {x["n"]: x["c"] for x in rows.groupBy("n").agg(F.count(F.lit(1)).alias("c")).collect()}
    some = rows.filter(F.pmod(F.xxhash64("r", F.lit(7)), F.lit(max(1, sum(totals.values()) // SAMPLE))) == 0).select("n", "v").collect()
    found: dict[int, list] = {}
    for x in sorted(some, key=lambda x: x["v"]):
        found.setdefault(x["n"], []).append(x["v"])
    centres = {n: centres_of(np.array(found[n]), min(CELLS, -(-c // BLOCK))) if n in found else np.zeros((1, n)) for n, c in totals.items()}
    shared = spark.sparkContext.broadcast(centres)

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from quillspark.llm.vectors import matrices

        for b in batches:
            cell, dist = np.zeros(b.num_rows, np.int32), np.zeros(b.num_rows)
            for at, x in matrices(b.column(2)):
                c = shared.value[x.shape[1]]
                cell[at] = np.argmax(x @ c.T - 0.5 * (c**2).sum(axis=1), axis=1)
                dist[at] = np.sqrt(((x - c[cell[at]]) ** 2).sum(axis=1))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cell), pa.array(dist)], ["r", "vec_id", "v", "n", "cell", "dist"])

    rows = scratch(rows.mapInArrow(dealt, "r long, vec_id long, v array<double>, n int, cell int, dist double"), "topk-cells")
    discard(first)
    rows_held = rows
    cells = rows.groupBy("n", "cell").agg(F.max("dist").alias("radius"), F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks")).collect()
    sizes = spark.createDataFrame([(x["n"], x["cell"], x["blocks"]) for x in cells], "n int, cell int, blocks int")
    reach = spark.sparkContext.broadcast({n: [(x["cell"], x["radius"], x["blocks"]) for x in cells if x["n"] == n] for n in totals})
    rows = rows.drop("dist").join(F.broadcast(sizes), ["n", "cell"]).withColumn("block", F.pmod(F.xxhash64("r", F.lit(1)), F.col("blocks")).cast("int"))
    is_query = F.pmod("vec_id", F.lit(query_mod)) == 0
    low = F.lit(float("-inf"))

    def search(asks: DataFrame) -> DataFrame:
        """asks: (r, vec_id, v, least, n, cell, block): r of the query, query_id, vec_id, score."""
        load = asks.groupBy("n", "cell", "block").agg(F.ceil(F.count(F.lit(1)) / GROUP).cast("int").alias("groups"))
        q = asks.join(load, ["n", "cell", "block"]).withColumn("g", F.pmod(F.xxhash64("r", F.lit(2)), F.col("groups")).cast("int"))
        p = rows.join(load, ["n", "cell", "block"]).withColumn("g", F.explode(F.sequence(F.lit(0), F.col("groups") - 1)))
        columns = ["n", "cell", "block", "g", "r", "vec_id", "v"]
        both = p.select(*columns, low.alias("least"), F.lit(0).alias("side")).unionByName(q.select(*columns, "least", F.lit(1).alias("side")))
        return both.groupBy("n", "cell", "block", "g").applyInPandas(task, "r long, query_id long, vec_id long, score long")

    def task(pdf: pd.DataFrame) -> pd.DataFrame:
        from quillspark.llm.vectors import top_of_block

        a, b = pdf[pdf["side"] == 1], pdf[pdf["side"] == 0]
        if not len(a) or not len(b):
            return pd.DataFrame({"r": [], "query_id": [], "vec_id": [], "score": []}).astype("int64")
        x, y, s = top_of_block(np.stack(a["v"]), a["r"].to_numpy(), np.stack(b["v"]), b["vec_id"].to_numpy(), b["r"].to_numpy(), k, a["least"].to_numpy())
        return pd.DataFrame({"r": a["r"].to_numpy()[x], "query_id": a["vec_id"].to_numpy()[x], "vec_id": y, "score": s})

    own = rows.filter(is_query).select("r", "vec_id", "v", low.alias("least"), "n", "cell", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    best_first = W.partitionBy("r").orderBy(F.desc("score"), "vec_id")

    def sent(batches: Iterator[pa.RecordBatch], done: int) -> Iterator[pa.RecordBatch]:
        """Each query once for each of the FEW blocks after the first `done` in its own order, most promising first, that
        can hold one of its k best. Blocks of its own cell are behind it."""
        from quillspark.llm.vectors import matrices

        for b in batches:
            own_cell, least = b.column(3).to_numpy(), b.column(4).to_numpy(zero_copy_only=False)
            least = np.where(np.isnan(least), -np.inf, least)
            for at, x in matrices(b.column(2)):
                cells, radius, blocks = (np.array(z) for z in zip(*reach.value[x.shape[1]], strict=True))
                unit, block = np.repeat(np.arange(len(cells)), blocks), np.concatenate([np.arange(m) for m in blocks])
                c = shared.value[x.shape[1]][cells]
                norm = np.sqrt((x * x).sum(axis=1))[:, None]
                most = x @ c.T + norm * radius + 1e-9 * norm * (radius + np.sqrt((c * c).sum(axis=1)))
                most[cells[None, :] == own_cell[at][:, None]] = -np.inf
                most = most[:, unit]
                next_ones = np.argsort(-most, axis=1, kind="stable")[:, done : done + FEW]
                value = np.take_along_axis(most, next_ones, axis=1)
                i, j = np.nonzero((value >= least[at][:, None]) & (value > -np.inf))
                go, u = at[i], next_ones[i, j]
                part = b.take(pa.array(go))
                ints = (np.full(len(go), x.shape[1]), cells[unit[u]], block[u])
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), part.column(2), pa.array(least[go]), *(pa.array(z.astype(np.int32)) for z in ints)], ["r", "vec_id", "v", "least", "n", "cell", "block"])

    best = scratch(search(own), "topk-best")
    queries = rows.filter(is_query).select("r", "vec_id", "v", "cell")
    for done in range(0, max((sum(x["blocks"] for x in cells if x["n"] == n) for n in totals), default=0), FEW):
        bar = best.select("r", "score", F.row_number().over(best_first).alias("rank")).filter(F.col("rank") == k).select("r", F.col("score").cast("double").alias("least"))
        asks = queries.join(bar, "r", "left").select("r", "vec_id", "v", "cell", "least")
        asks = scratch(asks.mapInArrow(lambda batches, done=done: sent(batches, done), "r long, vec_id long, v array<double>, least double, n int, cell int, block int"), "topk-asks")
        if asks.isEmpty():
            discard(asks)
            break
        found = best.unionByName(search(asks)).withColumn("rank", F.row_number().over(best_first)).filter(F.col("rank") <= k).drop("rank")
        better = scratch(found, "topk-best")
        discard(asks)
        discard(best)
        best = better
    discard(rows_held)
    return best.withColumn("rank", F.row_number().over(best_first)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op1_top_k(spark, sf_dir: str) -> DataFrame:
    return exact_top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


_OP1_SQL = """
WITH e AS (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(embedding) > 0
), s AS (
  SELECT q.r, q.vec_id AS query_id, p.vec_id, list_inner_product(q.v, p.v)::BIGINT AS score
  FROM e q JOIN e p ON q.vec_id % 20 = 0 AND q.r <> p.r AND len(q.v) = len(p.v)
), t AS (
  SELECT query_id, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score FROM s
)
SELECT query_id, rank, vec_id, score FROM t WHERE rank <= 20
"""

# ---------------------------------------------------------------- near duplicates

COSINE = 0.98
#: Projections counted, and the chance that a linked pair at the threshold misses the count asked for.
PROJECTIONS, MISS = 64, 1e-6
#: Width of a counting window, and of a slab, in standard deviations of a projected difference at the threshold.
SPREAD, SLAB = 1.75, 8.0
TILE, SEED = 2_048, 11


def asked_count(n: int, spread: float, miss: float) -> int:
    """Largest count that a pair at the threshold reaches but with probability miss: its collisions are binomial."""
    hit = math.erf(spread / math.sqrt(2))
    tail, c = 0.0, 0
    while c <= n:
        tail += math.comb(n, c) * hit**c * (1 - hit) ** (n - c)
        if tail > miss:
            return c
        c += 1
    return n


def projections(dim: int, n: int, seed: int = SEED) -> np.ndarray:
    return np.random.default_rng([seed, dim]).standard_normal((dim, n))


def same_slab(spread: float, width: float) -> float:
    """Chance that two values whose difference is normal with this spread fall into one slab of a random grid."""
    r = width / spread
    return math.erf(r / math.sqrt(2)) - math.sqrt(2 / math.pi) / r * (1 - math.exp(-r * r / 2))


def layout(n: int, sigma: float, miss: float = MISS) -> tuple[int, int]:
    """Tables, and projections of each, for n vectors: so many projections that an unlike vector shares all slabs of a
    table with about one other, and so many tables that a pair at the threshold meets in none with probability miss."""
    each = max(1, math.ceil(math.log(max(n, 2)) / -math.log(same_slab(math.sqrt(2), SLAB * sigma))))
    meet = same_slab(sigma, SLAB * sigma) ** each
    return math.ceil(math.log(miss) / math.log(1 - meet)), each


def units(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def table_keys(x: np.ndarray, label: np.ndarray, tables: int, each: int, slab: float) -> np.ndarray:
    """Of unit vectors, a key in each table: of their label, length and slabs in its projections."""
    r = np.random.default_rng([SEED, x.shape[1], tables, each])
    p, shift = r.standard_normal((x.shape[1], tables * each)), r.random(tables * each)
    s = np.floor(x @ p / slab + shift).astype(np.int64).astype(np.uint64).reshape(len(x), tables, each)
    key = np.broadcast_to(np.arange(1, tables + 1, dtype=np.uint64) * np.uint64(x.shape[1]), s.shape[:2]) ^ label[:, None].astype(np.int64).view(np.uint64)
    for k in range(each):
        key = (key ^ s[:, :, k]) * np.uint64(0x9E3779B97F4A7C15)
        key ^= key >> np.uint64(29)
    return key.view(np.int64)


def colliding(y: np.ndarray, a: np.ndarray, b: np.ndarray, width: float, asked: int) -> np.ndarray:
    """Numbers of the pairs (a, b) of rows of y that collide at least asked times: in so many projections the second
    lies in the window centred on the first. Pairs that can't reach the count any more go as soon as that is known."""
    n = y.shape[1]
    live, misses = np.arange(len(a)), np.zeros(len(a), np.int16)
    for k in range(0, n, 8):
        misses = misses + (np.abs(y[b[live], k : k + 8] - y[a[live], k : k + 8]) > width).sum(axis=1, dtype=np.int16)
        keep = misses <= n - asked
        live, misses = live[keep], misses[keep]
        if not len(live):
            break
    return live


def near_duplicates(vectors: DataFrame, cosine: float = COSINE) -> DataFrame:
    """Links between vectors of the same label with cosine >= the threshold, in double precision: vec_id, n_links,
    component_id, kept.

    Rows with null id or label, or a vector that is null, empty, zero or holds null or non-finite components, link with
    nothing: they return with 0 links as their own component. Equal vectors of a label are one class with a count;
    only different vectors are compared, and a class's links count all members. Vectors of different length never
    link. Rows that share an id are rows of their own: each returns with its own vector's links.

    Several tables of projections are cut into slabs and their keys sorted; vectors with one key in a table, crowded
    keys in pairs of blocks, are candidates, each pair in the first table where it meets. There the collisions of
    PROJECTIONS further projections, windows centred on one vector, are counted; pairs that reach the count are
    verified. Tables and count are set so that a pair at the threshold is missed with probability MISS each, pairs above
    it more rarely; with n vectors of a label there are about n**0.12 tables times a logarithm, so work grows little
    faster than the rows. A task holds two blocks."""
    spark = vectors.sparkSession
    ship(spark)
    ids = scratch(vectors.select(F.monotonically_increasing_id().alias("r"), F.col("vec_id").cast("long").alias("vec_id"), F.col("label").alias("label"), F.col("embedding").cast("array<double>").alias("v")), "dedup-rows")
    nonzero = F.coalesce(F.exists("v", lambda x: x != 0), F.lit(False))
    fine = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & usable(F.col("v")) & nonzero
    valid = ids.filter(fine)
    classes = valid.groupBy("label", "v").agg(F.min("vec_id").alias("low"), F.count(F.lit(1)).alias("n"))
    classes = scratch(classes.select(F.monotonically_increasing_id().alias("rep"), F.xxhash64("label").alias("mark"), "label", "v", "low", "n"), "dedup-classes")
    most = classes.groupBy("label").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
    total = classes.agg(F.sum("n")).first()[0] or 0
    sigma = math.sqrt(2 - 2 * cosine)
    slab, width, asked = SLAB * sigma, SPREAD * sigma, asked_count(PROJECTIONS, SPREAD, MISS)
    tables, each = layout(most, sigma)

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from quillspark.llm.vectors import matrices, table_keys, units

        for b in batches:
            rep, mark = b.column(0).to_numpy(), b.column(1).to_numpy()
            for at, x in matrices(b.column(2)):
                for i in range(0, len(at), 4_096):
                    rows = at[i : i + 4_096]
                    key = table_keys(units(x[i : i + 4_096]), mark[rows], tables, each, slab)
                    yield pa.RecordBatch.from_arrays([pa.array(key.ravel()), pa.array(np.tile(np.arange(tables, dtype=np.int32), len(rows))), pa.array(np.repeat(rep[rows], tables))], ["key", "table", "rep"])

    held: list[DataFrame] = []
    keyed = classes.select("rep", "mark", "v").mapInArrow(dealt, "key long, table int, rep long")
    rows, parts = tiled(keyed, ["key", "table"], "rep", TILE, held)
    rows = rows.join(classes.select("rep", "mark", F.col("n").alias("copies"), "v"), "rep")
    rows = rows.select("key", "tile_i", "tile_j", "tile_own", "table", "rep", "mark", "copies", "v").repartition(parts, "key", "tile_i", "tile_j").sortWithinPartitions("key", "tile_i", "tile_j")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Links of each vector in a pair of blocks, its neighbours' copies counted, and edges that connect what the
        links do."""
        from quillspark.llm.common import runs, spanning
        from quillspark.llm.ngram import pairs_of
        from quillspark.llm.vectors import colliding, matrices, projections, table_keys, units

        for t, group in runs(batches, 3, 16_384):
            t = t.combine_chunks()
            ti, tj, own, table, rep, mark, copies = (t.column(k).to_numpy() for k in range(1, 8))
            for at, x in matrices(t.column(8).chunk(0)):
                v = units(x)
                y, keys = v @ projections(v.shape[1], PROJECTIONS), table_keys(v, mark[at], tables, each, slab)
                when = table[at]
                for a, b in pairs_of(group[at], own[at], ti[at], tj[at], 1 << 18):
                    for k in range(tables):  # a pair that shares an earlier table meets there
                        fresh = (when[a] <= k) | (keys[a, k] != keys[b, k])
                        a, b = a[fresh], b[fresh]
                    keep = (mark[at][a] == mark[at][b]) & (when[a] == when[b])
                    a, b = a[keep], b[keep]
                    live = colliding(y, a, b, width, asked)
                    a, b = a[live], b[live]
                    good = np.einsum("ij,ij->i", v[a], v[b]) >= cosine
                    a, b = a[good], b[good]
                    if not len(a):
                        continue
                    n = copies[at]
                    links = np.bincount(a, n[b], len(at)) + np.bincount(b, n[a], len(at))
                    some = np.flatnonzero(links)
                    names, row = np.unique(rep[at], return_inverse=True)
                    low, high = spanning(names, row[a], row[b])
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([rep[at][some], low])), pa.array(np.concatenate([links[some].astype(np.int64), np.zeros(len(low), np.int64)])), pa.array(np.concatenate([rep[at][some], high]))], ["rep", "links", "low"])

    found = scratch(rows.mapInArrow(compare, "rep long, links long, low long"), "dedup-links")
    for x in held:
        discard(x)
    links = found.groupBy("rep").agg(F.sum("links").alias("links"))
    joined = components(found.filter("rep <> low").select(F.col("rep").alias("a"), F.col("low").alias("b"))).toDF("rep", "component")
    reps = classes.join(links, "rep", "left").join(joined, "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    least = reps.groupBy("component").agg(F.min("low").alias("component_id"), F.count(F.lit(1)).alias("n"))
    own = attached(reps.select("label", "v", "component", F.col("n").alias("copies"), (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links")), least, ["component"], total)
    own = own.select("label", "v", "n_links", "component_id", F.col("copies").alias("n"))
    linked = attached(valid.select("vec_id", "label", "v"), own, ["label", "v"], total).select("vec_id", "n_links", "component_id")
    rest = ids.filter(~fine).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.union(rest).select("vec_id", F.col("n_links").cast("long").alias("n_links"), "component_id", F.coalesce(F.col("component_id") == F.col("vec_id"), F.lit(True)).alias("kept"))


def op10_near_dedup(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


QUERIES = {"op1_top_k": op1_top_k, "op10_near_dedup": op10_near_dedup}
_OP10_SQL = """
WITH RECURSIVE e AS (
  SELECT row_number() OVER () AS r, vec_id, label, embedding::DOUBLE[] AS v,
    coalesce(vec_id IS NOT NULL AND label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
      AND len(list_filter(embedding, lambda x: x <> 0)) > 0, false) AS fine FROM embeddings
), f AS MATERIALIZED (SELECT r, vec_id, label, v FROM e WHERE fine),
u AS MATERIALIZED (SELECT r, vec_id, label, list_transform(v, lambda x: x / sqrt(list_inner_product(v, v))) AS v FROM f),
l AS MATERIALIZED (SELECT a.r AS a, b.r AS b, b.vec_id AS other FROM u a JOIN u b ON a.label = b.label AND a.r <> b.r AND CASE WHEN len(a.v) = len(b.v) THEN list_inner_product(a.v, b.v) >= 0.98 ELSE false END),
c(r, low) AS (SELECT r, vec_id FROM u UNION SELECT l.a, c.low FROM c JOIN l ON l.b = c.r)
SELECT e.vec_id, (SELECT count(*) FROM l WHERE l.a = e.r) AS n_links, coalesce(m.low, e.vec_id) AS component_id, coalesce(coalesce(m.low, e.vec_id) = e.vec_id, true) AS kept
FROM e LEFT JOIN (SELECT r, min(low) AS low FROM c GROUP BY r) m USING (r)
"""
ORACLES = {"op1_top_k": _OP1_SQL, "op10_near_dedup": _OP10_SQL}
