"""Exact k nearest neighbours (Euclidean) without a cross join.

Training rows are grouped into blocks: the nearest of some pivot rows (their number grows with the root of the
rows), and a ring of distances to that pivot. A block is described by its size and its smallest and largest
distance to the pivot, so the triangle inequality gives, for any query, bounds on every distance into the block;
so does the plane half-way between two pivots. Pivots are grouped into balls, which bound many blocks at once.

What travels are lots and shares: neighbouring blocks make up a lot, a share is a part of the queries, and both are as
large as a task can hold. A query goes once to each lot with a block that it must visit, however many blocks that are;
a task compares the rows of one lot with the queries of one share, a slice at a time and without the blocks that no
query of the slice can reach. Where nothing can be left out (many dimensions, no clusters) rows and queries thus travel
as often as there are shares and lots, not as there are blocks.

The search has two phases. A query first meets the lot of the block that it would be in itself, which gives a true k-th
distance. Then it visits only lots with a block whose bound is below that distance, and takes only rows within it. A
last step merges the closest rows of all lots.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from gridwright.functions.storage import staged

# Pivots per root of the number of rows; rings per pivot.
PIVOT_SHARE = 1.0
RINGS = 4
# Rows of a piece and queries of a share, at least; lots and shares take as many as make LOT_BYTES of vectors, but
# there are LEAST_LOTS of them where pieces and shares are that many.
PIECE_ROWS = 4096
QUERY_PIECE = 4096
LOT_BYTES = 32 << 20
LEAST_LOTS = 4
# Queries whose visits are listed at once.
QUERY_SLICE = 256
# Rough distances that a task holds at once.
PAIRS = 1 << 22
# So many times as many rows as different vectors make it worth to look up each vector once.
TIMES = 4
# Below this many pieces, comparing with all rows is cheaper than finding blocks.
FEW_PIECES = 16


@dataclass(frozen=True)
class Blocks:
    """What a query needs to know about the blocks: a few numbers each, some times the root of the rows in all."""

    pivots: np.ndarray
    block: np.ndarray
    pivot_of: np.ndarray
    size: np.ndarray
    near: np.ndarray
    far: np.ndarray
    lot: np.ndarray  # the first lot of each block
    lots: np.ndarray  # and their number: a large block has lots of its own
    center: np.ndarray  # of each ball, the number of its middle pivot
    radius: np.ndarray  # of each ball, from its middle to its farthest row
    members: list[np.ndarray]  # of each ball, the positions of its blocks


def _balls(pivots: np.ndarray, pivot_of: np.ndarray, far: np.ndarray):
    """Group the pivots around as many of them as the root of their number."""
    count = math.ceil(math.sqrt(len(pivots)))
    center = np.arange(len(pivots))[:: max(1, len(pivots) // count)][:count]
    away = _distances(pivots, pivots[center])
    ball = away.argmin(axis=1)
    reach = away[np.arange(len(pivots)), ball][pivot_of] + far
    members = [np.nonzero(ball[pivot_of] == b)[0] for b in range(len(center))]
    radius = np.array([reach[m].max() if len(m) else -np.inf for m in members])
    return center, radius, members


def _distances(rows: np.ndarray, to: np.ndarray) -> np.ndarray:
    """Euclidean distances, accurate also for close points, a bounded slice at a time."""
    out = np.empty((len(rows), len(to)))
    step = max(1, 4_000_000 // max(1, to.size))
    for at in range(0, len(rows), step):
        gap = rows[at : at + step, None, :] - to[None, :, :]
        out[at : at + step] = np.sqrt(np.einsum("ijk,ijk->ij", gap, gap))
    return out


def _nearest(points: np.ndarray, to: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The closest of ``to`` for each point (the first on a tie), and how far it is.

    A matrix product gives rough distances; those that may be the least are measured exactly.
    """
    at, away = np.empty(len(points), int), np.empty(len(points))
    lengths = np.einsum("ij,ij->i", to, to)
    step = max(1, PAIRS // max(1, len(to)))
    for start in range(0, len(points), step):
        part, here = points[start : start + step], slice(start, start + step)
        own = np.einsum("ij,ij->i", part, part)
        rough = own[:, None] + lengths[None, :] - 2.0 * (part @ to.T)
        limit = rough.min(axis=1) + 2e-12 * (own + lengths.max())
        if not np.isfinite(limit).all():
            d = _distances(part, to)
            at[here] = d.argmin(axis=1)
            away[here] = d[np.arange(len(d)), at[here]]
            continue
        point, row = np.nonzero(rough <= limit[:, None])
        d = _gaps(to, row, part[point])
        order = np.lexsort((row, d, point))
        first = order[np.searchsorted(point, np.arange(len(part)))]
        at[here], away[here] = row[first], d[first]
    return at, away


def _with_pivot(train: DataFrame, pivots: np.ndarray) -> DataFrame:
    def locate(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                batch["_pivot"], batch["_away"] = _nearest(np.stack(batch["_vec"].to_numpy()), pivots)
                yield batch

    extra = [T.StructField("_pivot", T.LongType()), T.StructField("_away", T.DoubleType())]
    return train.mapInPandas(locate, T.StructType(train.schema.fields + extra))


def _lot_count(rows: int, least: int, width: int) -> int:
    """Lots (or shares) for so many vectors of ``width`` numbers, none of them below ``least`` vectors."""
    return max(1, min(math.ceil(rows / least), max(LEAST_LOTS, math.ceil(rows * max(width, 1) * 8 / LOT_BYTES))))


def _one_block(train: DataFrame, rows: int, lots: int):
    """All rows as one block that every query visits."""
    blocks = Blocks(
        np.zeros((0, 0)), np.zeros(1, dtype=int), np.zeros(1, dtype=int), np.array([rows]), np.zeros(1),
        np.array([np.inf]), np.zeros(1, dtype=int), np.array([lots]), np.zeros(1, dtype=int), np.array([np.inf]), [np.zeros(1, dtype=int)],
    )
    placed = train.withColumn("_block", F.lit(0).cast("long"))
    return placed.withColumn("_lot", F.pmod(F.xxhash64("_id", F.lit(7)), F.lit(lots)).cast("int")), blocks


def _lots(size: np.ndarray, members: list[np.ndarray], rows: int) -> tuple[np.ndarray, np.ndarray]:
    """The first lot of each block, and how many it has: neighbouring blocks share a lot of ``rows`` rows."""
    first, count = np.zeros(len(size), int), np.ones(len(size), int)
    lot, held = 0, 0
    for at in (int(b) for ball in members for b in ball):
        if held and held + size[at] > rows:
            lot, held = lot + 1, 0
        first[at], held = lot, held + size[at]
        if held > rows:
            count[at] = math.ceil(size[at] / rows)
            lot, held = lot + int(count[at]), 0
    return first, count


def _build_blocks(train: DataFrame, rows: int, piece_rows: int, pivots: int | None, rings: int):
    """Assign every training row to a block and collect the block facts."""
    count = min(pivots or math.ceil(PIVOT_SHARE * math.sqrt(rows)), rows)
    chosen = train.orderBy(F.xxhash64("_id"), "_id").limit(count).select("_vec").collect()
    points = np.array([r["_vec"] for r in chosen], dtype="float64")
    # Written out once: the block facts and the rows must come from the same distances.
    located = staged(_with_pivot(train, points))
    edges = np.full((len(points), rings - 1), np.inf)
    shares = F.array(*[F.lit((i + 1) / rings) for i in range(rings - 1)])
    for r in located.groupBy("_pivot").agg(F.percentile_approx("_away", shares, F.lit(200)).alias("e")).collect():
        edges[r["_pivot"]] = r["e"]
    limits = F.array(*[F.array(*[F.lit(float(e)) for e in row]) for row in edges])
    own = F.element_at(limits, (F.col("_pivot") + 1).cast("int"))
    ring = F.lit(0)
    for i in range(rings - 1):
        ring = ring + (F.col("_away") > F.element_at(own, i + 1)).cast("int")
    placed = located.withColumn("_block", F.col("_pivot") * rings + ring)
    facts = (
        placed.groupBy("_block")
        .agg(F.count("*").alias("n"), F.min("_away").alias("lo"), F.max("_away").alias("hi"))
        .orderBy("_block").collect()
    )
    size = np.array([r["n"] for r in facts])
    block = np.array([r["_block"] for r in facts])
    far = np.array([r["hi"] for r in facts])
    size_of_lot = math.ceil(rows / _lot_count(rows, piece_rows, points.shape[1]))
    center, radius, members = _balls(points, block // rings, far)
    lot, lots = _lots(size, members, size_of_lot)
    blocks = Blocks(points, block, block // rings, size, np.array([r["lo"] for r in facts]), far, lot, lots, center, radius, members)
    table = train.sparkSession.createDataFrame(
        list(zip(block.tolist(), lot.tolist(), lots.tolist())), "_block long, _first int, _lots int"
    )
    placed = placed.join(F.broadcast(table), "_block")
    lot = (F.col("_first") + F.pmod(F.xxhash64("_id", F.lit(7)), F.col("_lots"))).cast("int")
    return placed.withColumn("_lot", lot).drop("_pivot", "_away", "_first", "_lots"), blocks


def _least(d: np.ndarray, near: np.ndarray, far: np.ndarray) -> np.ndarray:
    """No row of a block is closer, by the distances to its pivot."""
    return np.maximum(np.maximum(d - far, near - d), 0.0)


def _home(points: np.ndarray, blocks: Blocks, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Queries and the blocks of their own pivot: the nearest ones, until they hold ``k`` rows."""
    closest, _ = _nearest(points, blocks.pivots)
    queries, at = [], []
    for pivot in np.unique(closest):
        own, here = np.nonzero(closest == pivot)[0], np.nonzero(blocks.pivot_of == pivot)[0]
        d = _distances(points[own], blocks.pivots[[pivot]])
        order = np.argsort(_least(d, blocks.near[here], blocks.far[here]), axis=1, kind="stable")
        sizes = blocks.size[here][order]
        row, place = np.nonzero(np.cumsum(sizes, axis=1) - sizes < k)
        queries.append(own[row])
        at.append(here[order[row, place]])
    return np.concatenate(queries), np.concatenate(at)


def _surely(points: np.ndarray, blocks: Blocks, k: int) -> np.ndarray:
    """The smallest radius within which the blocks surely hold ``k`` rows."""
    most = _distances(points, blocks.pivots)[:, blocks.pivot_of] + blocks.far
    order = np.argsort(most, axis=1)
    held = np.cumsum(blocks.size[order], axis=1)
    enough = np.minimum((held < k).sum(axis=1), held.shape[1] - 1)
    radius = np.take_along_axis(most, order, axis=1)[np.arange(len(points)), enough]
    radius[held[:, -1] < k] = np.inf
    return radius


def _in_reach(points: np.ndarray, blocks: Blocks, radius: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Queries and the blocks that may hold a row within the query's radius, ball by ball."""
    closest, best = _nearest(points, blocks.pivots)
    to_balls = _distances(points, blocks.pivots[blocks.center])
    queries, at = [], []
    for ball, members in enumerate(blocks.members):
        slack = 1e-9 * (1.0 + to_balls[:, ball] + abs(blocks.radius[ball]))
        own = np.nonzero(to_balls[:, ball] - blocks.radius[ball] <= radius + slack)[0] if len(members) else []
        if not len(own):
            continue
        pivots, place = np.unique(blocks.pivot_of[members], return_inverse=True)
        d = _distances(points[own], blocks.pivots[pivots])[:, place]
        # A block's rows are on its pivot's side of the plane half-way to any other pivot.
        seen, which = np.unique(closest[own], return_inverse=True)
        gap = _distances(blocks.pivots[seen], blocks.pivots[pivots])[which][:, place]
        nearest = best[own][:, None]
        plane = np.divide(d**2 - nearest**2 - 1e-12 * (d**2 + nearest**2), 2 * gap, out=np.zeros_like(d), where=gap > 0)
        least = np.maximum(_least(d, blocks.near[members], blocks.far[members]), plane)
        row, place = np.nonzero(least <= radius[own][:, None] + 1e-9 * (1.0 + d + blocks.far[members]))
        queries.append(own[row])
        at.append(members[place])
    if not queries:
        return np.empty(0, int), np.empty(0, int)
    return np.concatenate(queries), np.concatenate(at)


def _reached(points: np.ndarray, radius: np.ndarray, blocks: Blocks, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Queries and the blocks within their radius (NaN: not known)."""
    open_ = np.isnan(radius)
    if open_.any():
        radius = radius.copy()
        radius[open_] = _surely(points[open_], blocks, k)
    return _in_reach(points, blocks, radius)


def _in_lots(at: np.ndarray, blocks: Blocks) -> tuple[np.ndarray, np.ndarray]:
    """For each of the visited blocks its lots, as (place in ``at``, lot)."""
    times = blocks.lots[at]
    place = np.repeat(np.arange(len(at)), times)
    return place, blocks.lot[at][place] + np.arange(len(place)) - np.repeat(np.cumsum(times) - times, times)


def _radius(batch: pd.DataFrame) -> np.ndarray:
    return batch["_radius"].to_numpy(dtype="float64", na_value=np.nan)


def _visits(queries: DataFrame, blocks: Blocks, k: int, first: bool, by_lot: bool = False) -> DataFrame:
    """One row per query and block: the query's own blocks ``first``, else all others within its ``_radius``.

    With ``by_lot`` one row per query and lot of those blocks, lots of its own blocks only ``first``.
    """
    slim = queries.select("_query", "_vec", (F.lit(None).cast("double") if first else F.col("_radius")).alias("_radius"))
    name = "_lot" if by_lot else "_block"
    lots = int((blocks.lot + blocks.lots).max())
    if not len(blocks.pivots):
        return slim.withColumn(name, F.explode(F.sequence(F.lit(0), F.lit(lots - 1))) if by_lot else F.lit(0))

    def plan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for whole in batches:
            for start in range(0, len(whole), QUERY_SLICE):
                batch = whole.iloc[start : start + QUERY_SLICE]
                points = np.stack(batch["_vec"].to_numpy())
                wanted = np.zeros((len(points), lots if by_lot else len(blocks.block)), bool)

                def mark(query: np.ndarray, at: np.ndarray, value: bool) -> None:
                    if by_lot:
                        place, at = _in_lots(at, blocks)
                        query = query[place]
                    wanted[query, at] = value

                if not first:
                    mark(*_reached(points, _radius(batch), blocks, k), True)
                mark(*_home(points, blocks, k), first)
                query, at = np.nonzero(wanted)
                for lo in range(0, len(query), 16384):
                    part = slice(lo, lo + 16384)
                    out = batch[["_query", "_vec", "_radius"]].iloc[query[part]].copy()
                    out[name] = at[part] if by_lot else blocks.block[at[part]]
                    yield out

    return slim.mapInPandas(plan, f"_query long, _vec array<double>, _radius double, {name} {'int' if by_lot else 'long'}")


def _met(placed: DataFrame, visits: DataFrame, blocks: Blocks, k: int, shares: int, first: bool) -> DataFrame:
    """The ``k`` closest rows of each lot for each of its visitors."""
    placed = placed.withColumn("_share", F.explode(F.sequence(F.lit(0), F.lit(shares - 1))))
    visits = visits.withColumn("_share", F.pmod(F.xxhash64("_query"), F.lit(shares)).cast("int"))
    cut = ["_lot", "_share"]

    def compare(rows: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        if not len(rows) or not len(queries):
            return pd.DataFrame({"_query": [], "_id": [], "distance": [], "_label": []})
        return _closest(rows, queries, k, blocks, first)

    return (
        placed.groupBy(*cut).cogroup(visits.groupBy(*cut))
        .applyInPandas(compare, "_query long, _id long, distance double, _label double")
    )


def _gaps(data: np.ndarray, rows: np.ndarray, point: np.ndarray) -> np.ndarray:
    """Exact distances; one way to add them up, so that equal distances are equal numbers."""
    gap = data[rows] - point
    return np.sqrt(np.einsum("ij,ij->i", gap, gap))


def _closest(rows: pd.DataFrame, queries: pd.DataFrame, k: int, blocks: Blocks, first: bool) -> pd.DataFrame:
    """The k closest rows of one lot for each query of one share, of those within the query's radius if it is known.

    ``first``: no query comes to this lot again. Its own blocks are compared first; the distance of the k-th of their rows
    says which of the lot's other blocks it must visit. Without so many rows there it visits all.
    """
    data, points = np.stack(rows["_vec"].to_numpy()), np.stack(queries["_vec"].to_numpy())
    radius = _radius(queries).copy()
    order = np.arange(len(points))
    if len(blocks.pivots):  # queries that are close to each other visit the same blocks
        listed = np.concatenate(blocks.members)
        rank = np.zeros(len(blocks.pivots), int)
        rank[blocks.pivot_of[listed]] = np.arange(len(listed))
        order = np.argsort(rank[_nearest(points, blocks.pivots)[0]], kind="stable")
        own = np.searchsorted(blocks.block, rows["_block"].to_numpy())
        sort = np.argsort(own, kind="stable")
        data, rows, own = data[sort], rows.iloc[sort], own[sort]
        here = np.zeros(len(blocks.block), bool)
        here[own] = True
        blocks = replace(blocks, members=[m[here[m]] for m in blocks.members])
    ids, labels = rows["_id"].to_numpy(), rows["_label"].to_numpy()
    lengths = np.einsum("ij,ij->i", data, data)
    found = []

    def among(asked: np.ndarray, taken: np.ndarray | None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """The closest of the rows ``taken`` (None: all), so many queries at a time as a task can hold."""
        at = None if taken is None or taken.all() else np.nonzero(taken)[0]
        near, near_lengths, near_ids = (data, lengths, ids) if at is None else (data[at], lengths[at], ids[at])
        step = max(8, min(512, PAIRS // max(1, len(near))))
        for start in range(0, len(asked) if len(near) else 0, step):
            part = asked[start : start + step]
            query, row, away = _best(near, near_lengths, near_ids, points[part], radius[part], k)
            yield part[query], row if at is None else at[row], away

    def visited(at: np.ndarray) -> np.ndarray:
        seen = np.zeros(len(blocks.block), bool)
        seen[at] = True
        return seen[own]

    if not len(blocks.pivots):
        found += among(order, None)
        order = order[:0]
    elif first:
        # The rows of its own blocks tell each query how far the others can matter.
        for start in range(0, len(order), QUERY_SLICE):
            asked = order[start : start + QUERY_SLICE]
            taken = visited(_home(points[asked], blocks, k)[1])
            if 2 * np.count_nonzero(taken) < len(data):
                for query, _, away in list(among(asked, taken)):
                    last = np.flatnonzero(np.diff(query, append=-1))
                    full = last[np.diff(last, prepend=-1) == k]
                    radius[query[full]] = away[full]
        open_ = np.isnan(radius[order])
        found += among(order[open_], None)
        order = order[~open_]
    for start in range(0, len(order), QUERY_SLICE):
        asked = order[start : start + QUERY_SLICE]
        found += among(asked, visited(_reached(points[asked], radius[asked], blocks, k)[1]))
    query, row, away = (np.concatenate(c) for c in zip(*found)) if found else (np.empty(0, int), np.empty(0, int), np.empty(0))
    return pd.DataFrame({"_query": queries["_query"].to_numpy()[query], "_id": ids[row], "distance": away, "_label": labels[row]})


def _best(data, lengths, ids, part, radius, k):
    """(query, row, distance) of the k closest rows of each query.

    A matrix product gives rough distances; the few best are measured exactly. Where
    too many are tied for that, the query is measured against all rows in reach.
    """
    kept = min(k, len(data))
    tried = min(len(data), kept + 16)
    own = np.einsum("ij,ij->i", part, part)
    rough = own[:, None] + lengths[None, :] - 2.0 * (part @ data.T)
    slack = 1e-12 * (own + lengths.max())
    limit = np.where(np.isnan(radius), np.inf, radius**2) + 2 * slack
    if not np.isnan(radius).any():
        within = rough <= limit[:, None]
        if np.count_nonzero(within) <= tried * len(part):
            query, row = np.nonzero(within)
            away = _gaps(data, row, part[query])
            order = np.lexsort((ids[row], away, query))
            query, row, away = query[order], row[order], away[order]
            place = np.arange(len(query)) - np.searchsorted(query, query)
            return query[place < k], row[place < k], away[place < k]
    near = np.argpartition(rough, tried - 1, axis=1)[:, :tried]
    sorted_ = np.sort(np.take_along_axis(rough, near, axis=1), axis=1)
    reach = sorted_[:, kept - 1] + 2 * slack
    away = _gaps(data, near.ravel(), np.repeat(part, tried, axis=0)).reshape(near.shape)
    order = np.lexsort((ids[near], away), axis=-1)[:, :kept]
    hits, away = np.take_along_axis(near, order, axis=1), np.take_along_axis(away, order, axis=1)
    for i in np.nonzero(sorted_[:, -1] <= reach)[0] if tried < len(data) else []:
        all_near = np.nonzero(rough[i] <= reach[i])[0]
        gaps = _gaps(data, all_near, part[i])
        best = np.lexsort((ids[all_near], gaps))[:kept]
        hits[i], away[i] = all_near[best], gaps[best]
    query = np.repeat(np.arange(len(part)), kept)
    inside = (away**2 <= limit[:, None]).ravel()
    return query[inside], hits.ravel()[inside], away.ravel()[inside]


def nearest_rows(
    queries: DataFrame, train: DataFrame, k: int, piece_rows: int = PIECE_ROWS, query_piece: int = QUERY_PIECE,
    pivots: int | None = None, rings: int = RINGS,
) -> DataFrame:
    """``_query, rank, _id, distance, _label`` of the k nearest training rows.

    ``queries`` has ``_query bigint, _vec array<double>``; ``train`` has ``_id bigint,
    _vec array<double>, _label double``. Equal distances are ordered by ``_id``.
    ``piece_rows`` and ``query_piece`` are the least rows of a lot and queries of a share.
    """
    rows, width = train.agg(F.count("*"), F.max(F.size("_vec"))).first()
    if rows == 0:
        raise ValueError("No training rows.")
    shares = _lot_count(queries.count(), query_piece, width)
    if rows <= FEW_PIECES * piece_rows and pivots is None:
        placed, blocks = _one_block(train, rows, _lot_count(rows, piece_rows, width))
    else:
        placed, blocks = _build_blocks(train, rows, piece_rows, pivots, rings)
        queries = queries.repartition("_query")  # a file of few bytes is one task's, its visits are not
    near = _met(placed, _visits(queries, blocks, k, True, True), blocks, k, shares, True)
    order = Window.partitionBy("_query").orderBy("distance", "_id")
    best = lambda found: found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    if len(blocks.pivots):
        # The k-th distance so far is true, so no farther block can hold a nearer row.
        first = staged(best(near).drop("rank"))
        radius = first.groupBy("_query").agg(F.count("*").alias("_n"), F.max("distance").alias("_far"))
        known = queries.join(radius, "_query", "left").select("_query", "_vec", F.when(F.col("_n") >= k, F.col("_far")).alias("_radius"))
        near = first.unionByName(_met(placed, _visits(known, blocks, k, False, True), blocks, k, shares, False))
    return best(near)


def vote(neighbours: DataFrame, weights: str = "uniform", classes: bool = True) -> DataFrame:
    """``_query, prediction``: the class with most weight (the smallest on a tie) or the weighted mean.

    ``distance`` weighs by 1/d; where a neighbour is at distance 0, only such ones count.
    """
    if weights not in ("uniform", "distance"):
        raise ValueError(f"Unknown weights: {weights}")
    weight = F.lit(1.0)
    if weights == "distance":
        closest = F.min("distance").over(Window.partitionBy("_query"))
        neighbours = neighbours.withColumn("_least", closest)
        weight = F.when(F.col("_least") == 0, (F.col("distance") == 0).cast("double")).otherwise(
            F.try_divide(F.lit(1.0), F.col("distance"))
        )
    weighed = neighbours.select("_query", "_label", weight.alias("_w"))
    if not classes:
        mean = F.sum(F.col("_label") * F.col("_w")) / F.sum("_w")
        return weighed.groupBy("_query").agg(mean.alias("prediction"))
    sums = weighed.groupBy("_query", "_label").agg(F.sum("_w").alias("_w"))
    best = F.max(F.struct(F.col("_w"), (-F.col("_label")).alias("_minus")))
    return sums.groupBy("_query").agg((-best["_minus"]).alias("prediction"))


def votes_of_nearest(queries: DataFrame, train: DataFrame, k: int, weights: str = "uniform", classes: bool = True) -> DataFrame:
    """``_query, prediction``: the vote of each query's ``k`` nearest rows.

    Equal vectors have the same neighbours, and of equal training vectors only the ``k`` least ids can be among them.
    So where vectors are much fewer than rows, as with columns of few values, each is looked up once.
    """
    hashed = F.xxhash64("_vec").alias("_hash")
    rows, kinds = train.agg(F.count("*"), F.approx_count_distinct(hashed)).first()
    asked, asked_kinds = queries.agg(F.count("*"), F.approx_count_distinct(hashed)).first()
    if TIMES * k * kinds <= rows:
        order = Window.partitionBy("_hash", "_vec").orderBy("_id")
        ranked = train.select("*", hashed).withColumn("_rank", F.row_number().over(order))
        train = staged(ranked.where(F.col("_rank") <= k).select(*train.columns))
    if TIMES * asked_kinds > asked:
        return vote(nearest_rows(queries, train, k), weights, classes)
    named = queries.select("_query", "_vec", hashed)
    once = staged(named.groupBy("_hash", "_vec").agg(F.min("_query").alias("_query")))
    found = vote(nearest_rows(once.select("_query", "_vec"), train, k), weights, classes)
    return named.join(once.join(found, "_query").drop("_query"), ["_hash", "_vec"]).select("_query", "prediction")


def nearest_neighbours(
    queries: DataFrame, train: DataFrame, k: int, vector: str, query_key: str, train_key: str, **limits
) -> DataFrame:
    """Neighbours between two tables with an ``array`` column of numbers and a bigint key."""
    asked = queries.select(F.col(query_key).cast("long").alias("_query"), F.col(vector).cast("array<double>").alias("_vec"))
    known_rows = train.select(
        F.col(train_key).cast("long").alias("_id"), F.col(vector).cast("array<double>").alias("_vec"),
        F.lit(None).cast("double").alias("_label"),
    )
    found = nearest_rows(asked, known_rows, k, **limits)
    return found.select(F.col("_query").alias("query"), "rank", F.col("_id").alias("neighbour"), "distance")
