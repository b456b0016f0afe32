"""Exact top-k by inner product: vectors grouped by length, pruned by local cosine thresholds, products verified.

Pruning happens twice: block by block on small descriptions (length, cone of directions) before any vector is shuffled,
and inside a bucket by coordinates or lengths, from the floor that each query already has.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meterlake.llm.common import materialize

#: Vectors in a bucket, queries in a block, candidate buckets in a group that one query block meets at once.
BUCKET_ROWS, QUERY_ROWS, GROUP_BUCKETS = 1024, 256, 4
#: Lengths of a bucket's vectors lie within this factor of each other, so that its threshold is nearly that of each.
LENGTH_STEP = 1.25
#: Below this local cosine lengths prune; above it coordinates do, on this many of the query's largest ones.
COORDINATE_COSINE, FOCUS = 0.6, 4


def quantised(vectors: DataFrame, scale: float = 256.0, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id long, v array<long>, norm double, dim int): components floor(scale * x); rows with a null id or vector, or
    a component that is null or not finite, are left out."""
    x = F.transform(vector_col, lambda c: c.cast("double"))
    clean = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")))
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), x.alias("x")).where(F.col("vec_id").isNotNull() & F.col("x").isNotNull() & clean)
    v = rows.select("vec_id", F.transform("x", lambda c: F.floor(c * scale).cast("long")).alias("v"))
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, c: a + c.cast("double") * c.cast("double")))
    return v.select("vec_id", "v", norm.alias("norm"), F.size("v").alias("dim"))


#: Stands for "no floor" among the floors of a query block.
NO_FLOOR = -(1 << 63)


def _direction() -> list:
    """Order that puts vectors of like direction side by side: greatest coordinate, its sign, then how great it is."""
    size = F.transform("v", lambda c: F.abs(c.cast("double")))
    at = F.array_position(size, F.array_max(size))
    lead = F.get("v", (at - 1).cast("int"))
    return [at, lead > 0, F.try_divide(lead.cast("double"), F.col("norm"))]


def blocks(rows: DataFrame, size: int, order: list, label: str) -> DataFrame:
    """(dim int, longest, least, reach double, centre array<double>, width int, ids, vectors, norms, floors binary, block
    long): ``rows`` (vec_id, v, norm, dim, floor) dealt by ranges of ``order``, ``size`` to a block.

    Every block holds vectors of one dimension only. ``least`` is its least floor by the query's length (null: a query has
    none), ``centre`` the mean direction, ``reach`` the greatest angle between it and a vector. Components take ``width`` bytes, as few as hold
    them. Ranges are of several columns, so one vector that repeats often is dealt to many tasks.
    """

    def run(batches):
        held: dict[int, list] = {}

        def block(dim, rows):
            ids, vs, norms, floors = zip(*rows)
            v, n = np.array(vs, np.int64).reshape(len(ids), dim), np.array(norms)
            top = max(int(v.max(initial=0)), -int(v.min(initial=0)) - 1)
            width = 2 if top < 1 << 15 else 4 if top < 1 << 31 else 8
            unit = v / np.maximum(n, 1e-300)[:, None]
            centre = unit.sum(axis=0)
            centre /= max(float(np.linalg.norm(centre)), 1e-300)
            reach = float(np.arccos(np.clip((unit @ centre).min(initial=1.0) if (n > 0).all() else -1.0, -1.0, 1.0)))
            parts = [x.tobytes() for x in (np.array(ids, "<i8"), v.astype(f"<i{width}"), n.astype("<f8"), np.array([NO_FLOOR if f is None else f for f in floors], "<i8"))]
            least = None if any(f is None for f in floors) or not (n > 0).all() else float((np.array(floors, float) / n).min())
            facts = [pa.array([dim], pa.int32()), pa.array([float(n.max())]), pa.array([least], pa.float64()), pa.array([reach]), pa.array([centre.tolist()], pa.list_(pa.float64())), pa.array([width], pa.int32())]
            return pa.RecordBatch.from_arrays([*facts, *(pa.array([x], pa.binary()) for x in parts)], ["dim", "longest", "least", "reach", "centre", "width", "ids", "vectors", "norms", "floors"])

        for batch in batches:
            for *row, dim, floor in zip(*(batch.column(k).to_pylist() for k in range(5))):
                held.setdefault(dim, []).append((*row, floor))
                if len(held[dim]) >= size:
                    yield block(dim, held.pop(dim))
        for dim, rows in held.items():
            yield block(dim, rows)

    keys = [c.alias(f"o{k}") for k, c in enumerate(order)]
    dealt = rows.select("vec_id", "v", "norm", "dim", "floor", *keys)
    by = [f"o{k}" for k in range(len(order))]
    dealt = dealt.repartitionByRange(*by, "vec_id").sortWithinPartitions(*by, "vec_id").select("vec_id", "v", "norm", "dim", "floor")
    schema = "dim int, longest double, least double, reach double, centre array<double>, width int, ids binary, vectors binary, norms binary, floors binary"
    return materialize(dealt.mapInArrow(run, schema), label).withColumn("block", F.xxhash64("ids", "vectors"))


def alike() -> Column:
    """Cosine of the angle between the centres of a query block and a bucket."""
    return F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.aggregate(F.zip_with("q_centre", "c_centre", lambda a, b: a * b), F.lit(0.0), lambda a, x: a + x)))


def reach() -> Column:
    """The most that a product of a vector of query block q and one of bucket c can be, by the query's length: the bucket's
    greatest length times the cosine of the angle that at least lies between their cones, or zero if that is obtuse."""
    apart = F.greatest(F.lit(0.0), F.acos("cosine") - F.col("q_reach") - F.col("c_reach") - 1e-6)
    return F.col("c_longest") * (F.greatest(F.cos(apart), F.lit(0.0)) + 1e-9) + 1e-9


def _described(queries: DataFrame, buckets: DataFrame) -> DataFrame:
    """(q_block, dim, group, c_block, q_least, reach, likely) of query blocks and buckets of one dimension.

    Only the blocks' descriptions meet here (some hundred bytes each), by dimension and group.
    """
    c = buckets.select("dim", "group", F.col("block").alias("c_block"), *(F.col(x).alias(f"c_{x}") for x in ("longest", "reach", "centre")))
    last = buckets.groupBy("dim").agg(F.max("group").alias("last"))
    q = queries.select("dim", F.col("block").alias("q_block"), *(F.col(x).alias(f"q_{x}") for x in ("reach", "centre", "least")))
    q = q.join(last, "dim").withColumn("group", F.explode(F.sequence(F.lit(0), F.col("last")))).drop("last")
    both = q.join(c, ["dim", "group"]).withColumn("cosine", alike())
    return both.select("q_block", "dim", "group", "c_block", "q_least", reach().alias("reach"), (F.col("c_longest") * F.col("cosine")).alias("likely"))


def nearest(queries: DataFrame, buckets: DataFrame, number: int) -> DataFrame:
    """(q_block, dim, group, chosen): the ``number`` buckets of each query block whose centres promise the greatest products."""
    order = Window.partitionBy("q_block").orderBy(F.desc("likely"), "c_block")
    best = _described(queries, buckets).withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= number)
    return best.groupBy("q_block", "dim", "group").agg(F.collect_set("c_block").alias("chosen"))


def surviving(queries: DataFrame, buckets: DataFrame) -> DataFrame:
    """(q_block, dim, group, chosen): for each query block and group the buckets that may reach a query's floor."""
    kept = _described(queries, buckets).where(F.col("q_least").isNull() | (F.col("q_least") <= F.col("reach")))
    return kept.groupBy("q_block", "dim", "group").agg(F.collect_set("c_block").alias("chosen"))


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k greatest scores, ties to the smaller id."""
    return np.lexsort((ids, -scores))[:k]


def _products(vectors: np.ndarray, query: np.ndarray, exact: bool) -> np.ndarray:
    if exact:
        return (vectors @ query).astype(np.int64)
    whole = (sum(int(a) * int(b) for a, b in zip(v, query)) for v in vectors)
    return np.array([max(NO_FLOOR, min((1 << 63) - 1, x)) for x in whole], np.int64)


def within_ranges(unit: np.ndarray, direction: np.ndarray, cosine: float) -> np.ndarray:
    """Places of the unit vectors whose coordinates lie in the ranges that a cosine with ``direction`` of at least
    ``cosine`` allows, on the direction's FOCUS greatest coordinates."""
    keep = np.arange(len(unit))
    slack = np.sqrt(max(0.0, 1 - cosine * cosine))
    for f in np.argsort(-np.abs(direction))[:FOCUS]:
        middle, width = direction[f] * cosine, slack * np.sqrt(max(0.0, 1 - direction[f] ** 2)) + 1e-9
        x = unit[keep, f]
        # a unit vector whose cosine with the query is at least the threshold has x_f on the near side of these bounds
        low = middle - width if direction[f] > -cosine else -1.0
        high = middle + width if direction[f] < cosine else 1.0
        keep = keep[(x >= low) & (x <= high)]
    return keep


def may_reach(partial: np.ndarray, rest: np.ndarray, query_rest: float, least: float) -> np.ndarray:
    """Places of the candidates whose product may reach ``least``: what the leading coordinates give, and at most the
    product of the lengths of the others."""
    return np.flatnonzero(partial + rest * (query_rest * (1 + 1e-9)) + 1e-6 >= least)


def search(query: tuple, candidate: tuple, floor: dict[int, int], k: int) -> list[tuple[int, int, int]]:
    """(query id, vector id, score) of each query's k best in a bucket that aren't below the query's ``floor`` score.

    A bucket's local cosine threshold for a query is the floor over the product of the query's and the bucket's
    greatest length. Above 1 the bucket is skipped. If it is high, candidates outside the ranges that it allows on the
    query's largest coordinates are dropped. Else lengths prune: all such queries are multiplied with the bucket's leading
    coordinates (those with most of its squares) at once, and only candidates whose remaining length can make up for what
    is missing are multiplied to the end.
    """
    q_ids, q, q_norms = query
    ids, vectors, norms = candidate
    longest, dim = float(norms.max()), vectors.shape[1]
    bound = float(np.abs(vectors).max(initial=0)) * float(np.abs(q).max(initial=0)) * dim
    exact = bound < 2**53  # products and sums are exact in doubles
    whole, asked = (vectors.astype(np.float64), q.astype(np.float64)) if exact else (vectors.astype(object), q.astype(object))
    least = [floor.get(i) for i in q_ids.tolist()]
    cosine = [None if f is None or f <= 0 else f / max(n * longest, 1e-300) / (1 + 1e-9) for f, n in zip(least, q_norms)]
    by_length = [n for n, c in enumerate(cosine) if c is None or c < COORDINATE_COSINE] if exact else []
    unit = vectors / np.maximum(norms, 1e-300)[:, None]
    if by_length:
        lead = np.argsort(-(whole * whole).sum(axis=0), kind="stable")
        lead, rest = lead[: -(-dim // 2)], lead[-(-dim // 2) :]
        partial = whole[:, lead] @ asked[by_length][:, lead].T
        tail, asked_tail = np.ascontiguousarray(whole[:, rest]), asked[:, rest]
        tail_norms, asked_norms = np.sqrt((tail * tail).sum(axis=1)), np.sqrt((asked_tail * asked_tail).sum(axis=1))
    at, out = {n: j for j, n in enumerate(by_length)}, []
    for n, q_id in enumerate(q_ids.tolist()):
        if cosine[n] is not None and cosine[n] > 1:
            continue
        if n in at:
            first = partial[:, at[n]]
            keep = np.arange(len(ids)) if least[n] is None else may_reach(first, tail_norms, float(asked_norms[n]), least[n])
            scores = (first[keep] + tail[keep] @ asked_tail[n]).astype(np.int64)
        else:
            near = cosine[n] is not None and cosine[n] >= COORDINATE_COSINE
            keep = within_ranges(unit, q[n] / q_norms[n], cosine[n]) if near else np.arange(len(ids))
            scores = _products(whole[keep], asked[n], exact)
        found = ids[keep]
        other = found != q_id
        scores, found = scores[other], found[other]
        best = _best(scores, found, k)
        out += [(q_id, i, s) for i, s in zip(found[best].tolist(), scores[best].tolist()) if least[n] is None or s >= least[n]]
        if len(best) == k:
            floor[q_id] = max(int(scores[best[-1]]), least[n]) if least[n] is not None else int(scores[best[-1]])
    return out


def _meet(pairs: DataFrame, k: int) -> DataFrame:
    """(query_id, vec_id, score) of joined query blocks and buckets, with floors that rise from bucket to bucket."""

    def load(row, side):
        ids, vectors, norms = (np.frombuffer(row[f"{side}_{c}"], t) for c, t in (("ids", "<i8"), ("vectors", f"<i{row[f'{side}_width']}"), ("norms", "<f8")))
        return ids, vectors.reshape(len(ids), row["dim"]).astype(np.int64), norms

    def run(batches):
        floor: dict[int, int] = {}
        block = None
        for batch in batches:
            for n in range(batch.num_rows):
                row = batch.slice(n, 1).to_pylist()[0]
                query = load(row, "q")
                if row["q_block"] != block:
                    block, floors = row["q_block"], np.frombuffer(row["q_floors"], "<i8").tolist()
                    floor = {q: f for q, f in zip(query[0].tolist(), floors) if f != NO_FLOOR}
                found = search(query, load(row, "c"), floor, k)
                q, v, s = zip(*found) if found else ([], [], [])
                yield pa.RecordBatch.from_arrays([pa.array(q, pa.int64()), pa.array(v, pa.int64()), pa.array(s, pa.int64())], ["query_id", "vec_id", "score"])

    return pairs.mapInArrow(run, "query_id long, vec_id long, score long")


def _first(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def top_k(vectors: DataFrame, k: int = 5, every: int = 50, scale: float = 256.0) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row whose vec_id is divisible by ``every`` the k best of all other rows.

    Exact: integer inner products of floor(scale * x), ties to the smaller vec_id. Vectors of different dimension don't
    meet; null ids, null vectors and those with unclean components take no part; empty vectors score 0 with each other.
    Rows that repeat a vec_id are candidates each, and one query. Fewer rows than k give fewer results; an empty table
    gives none; other columns are ignored. Components and scores beyond the range of a long are cut to it.

    Buckets are of similar length (within LENGTH_STEP) and, inside that, of like direction; query blocks of like direction.
    First every query block meets the GROUP_BUCKETS buckets whose centres promise its greatest products, whose results give each
    query a floor. Then it meets those buckets only whose description says that they may reach a floor, so pairs that
    can't are dropped before vectors are shuffled. Vectors of random direction leave nothing to prune; see README.
    """
    rows = materialize(quantised(vectors, scale), "vectors")
    no_floor = F.lit(None).cast("long").alias("floor")
    wanted = rows.where(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min(F.struct("v", "norm", "dim")).alias("r")).select("vec_id", "r.*")
    level = F.floor(F.log(F.greatest(F.col("norm"), F.lit(1.0))) / math.log(LENGTH_STEP))
    c = blocks(rows.select("*", no_floor), BUCKET_ROWS, [-level, *_direction()], "buckets")
    # one small row for each bucket, ranked by length within its dimension
    longest_first = Window.partitionBy("dim").orderBy(F.desc("longest"), "block")
    facts = c.select("block", "dim", "longest", "reach", "centre").withColumn("nth", F.row_number().over(longest_first) - 1).withColumn("group", F.floor(F.col("nth") / GROUP_BUCKETS).cast("int"))
    facts = materialize(facts, "bucket-facts")
    bucket = c.join(facts.select("block", "group", "nth"), "block").select("dim", "group", "nth", F.col("block").alias("c_block"), *(F.col(x).alias(f"c_{x}") for x in ("width", "ids", "vectors", "norms")))

    def met(queries: DataFrame, pairs: DataFrame) -> DataFrame:
        asked = queries.select(F.col("block").alias("q_block"), *(F.col(x).alias(f"q_{x}") for x in ("width", "ids", "vectors", "norms", "floors")))
        both = pairs.join(asked, "q_block").join(bucket, ["dim", "group"]).where(F.array_contains("chosen", F.col("c_block"))).drop("chosen")
        return _first(_meet(both.sortWithinPartitions("q_block", "nth"), k), k)

    first = blocks(wanted.select("*", no_floor), QUERY_ROWS, _direction(), "query-blocks")
    seeds = materialize(met(first, nearest(first, facts, GROUP_BUCKETS)), "seeds")
    floors = seeds.where(F.col("rank") == k).select(F.col("query_id").alias("vec_id"), F.col("score").alias("floor"))
    again = blocks(wanted.join(floors, "vec_id", "left"), QUERY_ROWS, _direction(), "query-blocks-with-floors")
    return met(again, surviving(again, facts)).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
