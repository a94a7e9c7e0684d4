"""Average linkage of any number of vectors: near pairs through pivots, parts of any size over several tasks.

Vectors have length 1 or are zero.  The mean cosine distance of two clusters is 1 less the product of their mean
vectors, so a cluster is its size and its mean, and no matrix of all distances is needed.

Equal vectors are folded into one point first: they are at distance 0, which nothing can undercut.  A zero vector is at
distance 1 from all others and from its equals, so each stays a point of its own.

A mean distance under the threshold needs a pair under it, so clusters never leave a connected part of near pairs.
Parts of up to ``WHOLE`` points are clustered in a task each.  Larger ones are clustered in rounds.  Neighbouring clusters
form groups of about ``WHOLE``; by blocks every cluster looks for its nearest one and for its least distance to other groups, and all pairs that
are each other's nearest merge: a merged cluster is never nearer to a third than the nearer of its halves was, so these
merges are those of always taking the closest pair.  Of equal distances (to 12 digits) a hash of the pair decides, so
that ties do not queue.  Then each group goes on by itself as long as its merges are nearer than anything outside can be,
so that a cluster that takes its neighbours one by one does not take a round for each.  A cluster whose nearest one is
beyond the threshold is complete.  The rounds end when a part's open clusters fit in a task; their number depends on the data.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewright.shared import cut, made, release, written

#: Points of a block at least.  Blocks grow with the points, so that a point is copied to ``MEETINGS`` blocks at most, up to ``LARGEST`` numbers
#: (32 MB; 65,536 points of 64 dimensions); a task holds two blocks, and their products by ``TILE`` rows on either side.
BLOCK, LARGEST, MEETINGS, TILE = 2000, 1 << 22, 24, 2000
#: Clusters of a part that are linked in one task at most (a matrix of 288 MB).
WHOLE = 6000
#: Vectors that pivots are chosen from, and pivots at most.  They decide what is shuffled, not what is found.
SAMPLE, PIVOTS = 2048, 512
#: Pivots for each block of points: narrow cells, several of which make a block.
CELLS = 8
#: Blocks of a round at most, so a cluster is copied to so many; a block is several groups.
ROUND_BLOCKS = 12
#: Distances are compared with this much room.
ROUNDED = 1e-12
#: Pairs for each row of a tile that are looked at one by one at most.
DENSE = 16
#: Vectors that parts are begun with.
SEEDS = 2048
#: Angles are looked at with this much room: lengths may be off by 1e-7, as those of single-precision vectors are.
ROOM = 1e-3


def usable(vector: str) -> Column:
    """Whether a vector is there and all its components are numbers; others are near to nothing."""
    return F.coalesce(F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))


def folded(vectors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(points, members): points (point, vector, size), point the smallest failure_id of equal vectors; members (failure_id, digest).

    Rows: failure_id, vector.  Members find their point by ``digest``, so vectors travel once, after folding.
    """
    plain = F.transform("vector", lambda x: x + F.lit(0.0))
    zero = ~F.exists("vector", lambda x: x != 0)
    digest = F.when(zero | ~usable("vector"), F.concat(F.lit("0:"), "failure_id")).otherwise(F.sha2(F.to_json(plain), 256))
    rows = cut(vectors.select("failure_id", digest.alias("digest"), plain.alias("vector")))
    points = rows.groupBy("digest").agg(F.min("failure_id").alias("point"), F.first("vector").alias("vector"), F.count(F.lit(1)).alias("size"))
    return cut(points), rows.select("failure_id", "digest")


# --- near pairs ----------------------------------------------------------------------------------


def _spread(sample: np.ndarray, n: int) -> np.ndarray:
    """Up to ``n`` directions: vectors of the sample, each as far as can be from those before it, then moved to the middle of their cells."""
    near = np.full(len(sample), -np.inf)
    chosen: list[int] = []
    for _ in range(min(n, len(sample))):
        k = int(near.argmin()) if chosen else 0
        if chosen and near[k] > 1 - 1e-9:
            break
        chosen.append(k)
        near = np.maximum(near, sample @ sample[k])
    pivots = sample[chosen]
    for _ in range(4):
        cell = (sample @ pivots.T).argmax(axis=1)
        total = np.zeros_like(pivots)
        np.add.at(total, cell, sample)
        length = np.linalg.norm(total, axis=1, keepdims=True)
        pivots = np.where(length > 1e-9, total / np.maximum(length, 1e-9), pivots)
    return pivots


def _angles(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(x @ pivots.T, -1, 1))


def _matrix(vectors: pd.Series) -> np.ndarray:
    return np.array(vectors.tolist(), dtype=float)


def _blocks(sizes: np.ndarray, pivots: np.ndarray | None, block: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each cell's first block and number of blocks, and which cells (rows) a block (column) holds; cells are taken from neighbour to neighbour."""
    start, chunks = np.zeros(len(sizes), int), np.maximum(1, -(-sizes // block))
    left, here, number, room = set(range(len(sizes))), 0, -1, 0
    while left:
        left.discard(here)
        if sizes[here] > room:
            number += 1
            start[here], room = number, chunks[here] * block
            number += chunks[here] - 1
        else:
            start[here] = number
        # blocks of a large cell take no others
        room = room - sizes[here] if chunks[here] == 1 else 0
        rest = np.array(sorted(left), dtype=int)
        here = int(rest[(pivots[rest] @ pivots[here]).argmax()]) if len(rest) and pivots is not None else int(rest[0]) if len(rest) else 0
    held = np.zeros((len(sizes), number + 1), dtype=np.float32)
    for cell in range(len(sizes)):
        held[cell, start[cell] : start[cell] + chunks[cell]] = 1
    return start, chunks, held


def dealt(points: DataFrame, threshold: float, block: int = BLOCK) -> DataFrame:
    """(point, vector, blk, targets): each point's block, and the blocks that can hold a point nearer than ``threshold``.

    A point lies in the cell of its nearest pivot, the largest angle in a cell is its radius: what is farther from the
    pivot than radius and threshold together has no partner in it.  Neighbouring cells share a block, cells of many
    points are several.  Two points that are near name each other's block.  Rows: point, vector.
    """
    points = points.where(usable("vector"))
    n = points.count()
    if n <= block:
        return points.select("point", "vector", F.lit(0).alias("blk"), F.array(F.lit(0)).alias("targets"))
    first = points.where(F.exists("vector", lambda x: x != 0)).orderBy(F.xxhash64("point"), "point").limit(SAMPLE).select("vector").collect()
    # angles tell nothing of zero vectors, which are near to all beyond a threshold of 1
    metric = threshold <= 1 and len(first) > 0
    block = block_size(n, max((len(r["vector"]) for r in first), default=LARGEST), block)
    pivots = _spread(np.array([r["vector"] for r in first], dtype=float), min(PIVOTS, CELLS * -(-n // block))) if metric else None

    @F.pandas_udf("cell int, angle double")
    def place(vectors: pd.Series) -> pd.DataFrame:
        if pivots is None:
            return pd.DataFrame({"cell": np.zeros(len(vectors), np.int32), "angle": math.pi})
        a = _angles(_matrix(vectors), pivots)
        return pd.DataFrame({"cell": a.argmin(axis=1).astype(np.int32), "angle": a.min(axis=1)})

    placed = cut(points.select("point", "vector", place("vector").alias("at")))
    cells = placed.groupBy("at.cell").agg(F.count(F.lit(1)).alias("n"), F.max("at.angle").alias("radius")).orderBy("cell").collect()
    number = np.array([r["cell"] for r in cells])
    radius = np.array([r["radius"] for r in cells])
    start, chunks, held = _blocks(np.array([r["n"] for r in cells]), None if pivots is None else pivots[number], block)
    reach = (math.acos(1 - threshold) if metric else math.pi) + ROOM

    @F.pandas_udf("blk int, targets array<int>")
    def aim(vectors: pd.Series, cell: pd.Series, h: pd.Series) -> pd.DataFrame:
        at = np.searchsorted(number, cell.to_numpy())
        blk = start[at] + h.to_numpy() % chunks[at]
        if pivots is None:
            return pd.DataFrame({"blk": blk, "targets": [np.arange(held.shape[1])] * len(at)})
        x = _matrix(vectors)
        hit = (_angles(x, pivots[number]) - radius <= reach) & x.any(axis=1)[:, None]
        return pd.DataFrame({"blk": blk, "targets": [np.flatnonzero(row).astype(np.int32) for row in hit.astype(np.float32) @ held]})

    return placed.withColumn("to", aim("vector", "at.cell", F.xxhash64("point"))).select("point", "vector", "to.blk", "to.targets")


def block_size(n: int, width: int, least: int) -> int:
    """Points of a block, of ``n`` in all."""
    return max(least, min(LARGEST // max(width, 1), -(-n // MEETINGS)))


def _tiles(x: np.ndarray, left: np.ndarray, right: np.ndarray, reach: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places in ``x``, of pairs from left and right that are nearer than ``reach``, tile by tile."""
    for i in range(0, len(left), TILE):
        for j in range(0, len(right), TILE):
            a, b = np.nonzero(1 - x[left[i : i + TILE]] @ x[right[j : j + TILE]].T < reach)
            yield left[i + a], right[j + b]


def meetings(points: DataFrame, threshold: float, block: int = BLOCK) -> DataFrame:
    """(i, j, point, vector, blk): the points of each pair of blocks that can hold near ones."""
    rows = dealt(points, threshold, block).withColumn("other", F.explode("targets"))
    return rows.select(F.least("blk", "other").alias("i"), F.greatest("blk", "other").alias("j"), "point", "vector", "blk")


def near_pairs(points: DataFrame, threshold: float, block: int = BLOCK) -> DataFrame:
    """(a, b), a < b: all pairs of points nearer than ``threshold``."""

    def near(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        x, ids, blk = _matrix(part["vector"]), part["point"].to_numpy(), part["blk"].to_numpy()
        left, right = np.flatnonzero(blk == key[0]), np.flatnonzero(blk == key[1])
        found = []
        for a, b in _tiles(x, left, right, threshold):
            a, b = ids[a], ids[b]
            keep = a < b if key[0] == key[1] else a != b
            found.append(pd.DataFrame({"a": np.minimum(a, b)[keep], "b": np.maximum(a, b)[keep]}))
        return pd.concat(found) if found else pd.DataFrame({"a": ids[:0], "b": ids[:0]})

    kind = points.schema["point"].dataType.simpleString()
    return meetings(points, threshold, block).groupBy("i", "j").applyInPandas(near, f"a {kind}, b {kind}")


def _stars(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """The smallest place that each of ``n`` is connected with, by pairs of places."""
    label = np.arange(n)
    while True:
        new = label.copy()
        np.minimum.at(new, a, label[b])
        np.minimum.at(new, b, label[a])
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _seeded(points: DataFrame, threshold: float) -> DataFrame:
    """Adds ``seed``: the part of some vectors, themselves held together by near pairs, that a point's nearest one belongs to; null where it is not near."""
    some = points.where(usable("vector") & F.exists("vector", lambda x: x != 0)).orderBy(F.xxhash64("point"), "point").limit(SEEDS).select("vector").collect()
    if not some:
        return points.withColumn("seed", F.lit(None).cast("int"))
    sample = np.array([r["vector"] for r in some], dtype=float)
    root = np.arange(len(sample))
    for a, b in _tiles(sample, root, root, threshold):
        root = _stars(root[a], root[b], len(sample))[root]

    @F.pandas_udf("int")
    def seed(vectors: pd.Series) -> pd.Series:
        product = _matrix(vectors) @ sample.T
        near = product.argmax(axis=1)
        return pd.Series(np.where(1 - product[np.arange(len(near)), near] < threshold, root[near], -1)).astype("int32")

    # Arrow knows no null components; such vectors are near to nothing
    return points.withColumn("seed", F.when(usable("vector"), F.nullif(seed(F.when(usable("vector"), F.col("vector")).otherwise(F.array_repeat(F.lit(0.0), sample.shape[1]))), F.lit(-1))))


def parts(points: DataFrame, threshold: float, block: int = BLOCK) -> DataFrame:
    """(point, part): parts hold all pairs nearer than the threshold.

    Points are first told by the vectors of a sample that they are near to; often that makes one part of all, and no block need meet another.
    What comes out of a pair of blocks is not the near pairs but a link for each row to the smallest one it is connected with there;
    rows that are connected already are not compared.
    """

    def near(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("point").reset_index(drop=True)
        x, ids, blk = _matrix(part["vector"]), part["point"].to_numpy(), part["blk"].to_numpy()
        left, right = np.flatnonzero(blk == key[0]), np.flatnonzero(blk == key[1])
        root = np.arange(len(ids))
        for i in range(0, len(left), TILE):
            for j in range(0, len(right), TILE):
                own, others = left[i : i + TILE], right[j : j + TILE]
                if (root[own] == root[own[0]]).all() and (root[others] == root[own[0]]).all():
                    continue
                for a, b in _tiles(x, own, others, threshold + 1e-9):
                    # pairs of a tile join what earlier tiles have joined
                    a, b = root[a], root[b]
                    apart = a != b
                    root = _stars(a[apart], b[apart], len(ids))[root]
        far = root != np.arange(len(ids))
        return pd.DataFrame({"a": ids[far], "b": ids[root[far]]})

    n = points.count()
    seeds = None
    if n > block:
        seeded = cut(_seeded(points, threshold).select("point", "seed"))
        seeds = seeded.where("seed is not null").groupBy("seed").agg(F.min("point").alias("b"), F.count(F.lit(1)).alias("n"))
        one = seeds.where(F.col("n") == n).first()
        if one is not None:
            return points.select("point", F.lit(one["b"]).alias("part"))
    links = meetings(points, threshold, block).groupBy("i", "j").applyInPandas(near, "a string, b string")
    if seeds is not None:
        links = links.unionByName(seeded.join(seeds.select("seed", "b"), "seed").where("point <> b").select(F.col("point").alias("a"), "b"))
    links = cut(links)
    label = cut(points.select("point", F.col("point").alias("part")))
    both = cut(links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))))
    while not both.isEmpty():
        low = both.join(label.withColumnRenamed("point", "b"), "b").groupBy("a").agg(F.min("part").alias("low"))
        new = label.join(low.withColumnRenamed("a", "point"), "point", "left").select("point", F.least("part", F.coalesce("low", "part")).alias("part"), F.col("part").alias("old"))
        # pointer jump: take the part of the part
        up = new.select(F.col("point").alias("part"), F.col("part").alias("up"))
        new = written(new.join(up, "part", "left").select("point", F.coalesce("up", "part").alias("part"), "old"), "linkage")
        label = new.drop("old")
        if new.where("part <> old").isEmpty():
            break
    return label


# --- linkage -------------------------------------------------------------------------------------


def _merged(vectors: np.ndarray, threshold: float, sizes: np.ndarray, outside: np.ndarray, pairs: np.ndarray, away: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(the first member of each one's cluster, which clusters are complete) after all merges that a group can decide alone.

    Nearest-neighbour chains: from a cluster to its nearest one and on, until two are each other's nearest; these
    merge.  Mean distances never fall below both of their parts, so the merges are those of always taking the
    closest pair, and a cluster whose nearest one is beyond the threshold is complete.

    ``outside``: each one's distance to all clusters that are not in the group, at least.  A mean of such bounds is the bound of
    a merged cluster, whatever merges outside.  What is not nearer to its nearest one than to the outside waits, and so does all that waits for it.
    ``pairs`` (the place of a partner or -1) merge first; what is ``away`` has its partner elsewhere and counts as outside.
    """
    n = len(vectors)
    weight, bound, root = np.array(sizes, dtype=float), np.array(outside, dtype=float), np.arange(n)
    gone, complete = away.copy(), np.zeros(n, dtype=bool)
    if away.any():
        bound = np.minimum(bound, np.clip(1 - vectors @ vectors[away].T, 0, 2).min(axis=1))
    low = np.flatnonzero(pairs > np.arange(n))
    high = pairs[low]
    if len(low):
        share = weight[low] / (weight[low] + weight[high])
        vectors = vectors.copy()
        vectors[low] = share[:, None] * vectors[low] + (1 - share)[:, None] * vectors[high]
        bound[low] = np.where(np.isinf(bound[low]) | np.isinf(bound[high]), np.inf, share * bound[low] + (1 - share) * bound[high])
        weight[low] += weight[high]
        root[high], gone[high] = low, True
    # what has gone elsewhere needs no distances
    live = np.flatnonzero(~gone)
    inner, complete[live] = _chains(vectors[live], threshold, weight[live], bound[live])
    root[live] = live[inner]
    while (root[root] != root).any():
        root = root[root]
    return root, complete


def _chains(vectors: np.ndarray, threshold: float, weight: np.ndarray, bound: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """:func:`_merged` of clusters none of which has a partner yet."""
    n = len(vectors)
    gap = vectors @ vectors.T
    np.clip(np.subtract(1, gap, out=gap), 0, 2, out=gap)
    gap[np.arange(n), np.arange(n)] = np.inf
    root, nearest = np.arange(n), gap.min(axis=1) if n else np.zeros(0)
    # most of a large table is told at once: a nearest one never comes nearer, and what is beyond the threshold is so for all
    complete = ~(np.minimum(nearest, bound) < threshold)
    waits, gone = (nearest > bound - ROUNDED) & ~complete, complete.copy()

    def join(low: int, high: int) -> None:
        share = weight[low] / (weight[low] + weight[high])
        mean = share * gap[low] + (1 - share) * gap[high]
        gap[high, :] = gap[:, high] = np.inf
        gap[low, :] = gap[:, low] = mean
        gap[low, [low, high]] = gap[[low, high], low] = np.inf
        # an end of infinity is one on both sides
        bound[low] = share * bound[low] + (1 - share) * bound[high]
        weight[low] += weight[high]
        root[high], gone[high] = low, True

    chain: list[int] = []
    first = 0
    while True:
        if not chain:
            while first < n and (gone[first] or waits[first]):
                first += 1
            if first == n:
                break
            chain.append(first)
        here = chain[-1]
        there = int(gap[here].argmin())
        least = gap[here, there]
        if not min(least, bound[here]) < threshold:
            complete[here] = gone[here] = True
            gap[here, :] = gap[:, here] = np.inf
            chain.pop()
            continue
        if len(chain) > 1 and gap[here, chain[-2]] <= least:
            there = chain[-2]
        if least > bound[here] - ROUNDED or waits[there]:
            # its nearest one never comes nearer, and those before it in the chain have it as theirs
            waits[chain] = True
            chain.clear()
        elif len(chain) > 1 and there == chain[-2]:
            low, high = sorted((chain.pop(), chain.pop()))
            join(low, high)
            first = min(first, low)
        else:
            chain.append(there)
    return root, complete


def average_linkage(vectors: np.ndarray, threshold: float, sizes: np.ndarray | None = None) -> list[list[int]]:
    """Clusters of average linkage, cut where mean distances reach the threshold; of means with ``sizes`` of what they stand for."""
    n = len(vectors)
    none = np.full(n, -1)
    root, _ = _merged(vectors, threshold, np.ones(n) if sizes is None else sizes, np.full(n, np.inf), none, none > 0)
    groups: dict[int, list[int]] = {}
    for k, r in enumerate(root.tolist()):
        groups.setdefault(r, []).append(k)
    return sorted(groups.values())


def _finish(threshold: float):
    """(part, cid, root) of a part that fits in a task."""

    def go(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("cid").reset_index(drop=True)
        root = part["cid"].to_numpy().copy()
        for members in average_linkage(_matrix(part["mean"]), threshold, part["size"].to_numpy()):
            root[members] = part["cid"][members[0]]
        return part.assign(root=root)[["part", "cid", "root"]]

    return go


def _mixed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A number of each pair of hashes, either way round."""
    x = (a ^ b).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return ((x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)).view(np.int64)


def _nearest(threshold: float):
    """The nearest cluster of each one in a pair of blocks (null: none under the threshold), and its least distance to another group there, at least.

    Tile by tile, both ways from one product, so that both ends see the same distance.  Tiles are products in single precision,
    which is off by ``room`` at most; what can be the nearest by them is looked at again in double precision.
    """

    def go(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["blk", "grp"], kind="stable").reset_index(drop=True)
        x, h, blk, grp = _matrix(rows["mean"]), rows["h"].to_numpy(), rows["blk"].to_numpy(), rows["grp"].to_numpy()
        n, width = x.shape
        y = x.astype(np.float32)
        # the sum of ``width`` products, in any order, of rounded factors
        room = np.float32(1.01 * (width + 3) * 2.0**-24 * max(float(np.einsum("ij,ij->i", x, x).max()), 1e-9))
        least = np.float32(1 - threshold) - np.float32(1e-6)
        gap, tie, other = np.full(n, np.inf), np.zeros(n, np.int64), np.full(n, -1)
        ends = np.r_[np.flatnonzero(np.diff(grp)) + 1, n]
        tiles = [(a, min(a + TILE, e)) for b, e in zip(np.r_[0, ends[:-1]].tolist(), ends.tolist()) for a in range(b, e, TILE)]
        def meet(at: np.ndarray, to: np.ndarray, products: np.ndarray) -> None:
            """Takes the nearest of each one ``at`` from its products with those of ``to``."""
            low = np.round(np.clip(1 - products, 0, 2), 12)
            mixed = _mixed(h[at], h[to])
            order = np.lexsort((mixed, low, at))
            order = order[np.r_[True, np.diff(at[order]) > 0]] if len(at) else order
            at, to, low, mixed = at[order], to[order], low[order], mixed[order]
            nearer = (low < gap[at]) | (low == gap[at]) & (mixed < tie[at])
            at, to = at[nearer], to[nearer]
            gap[at], tie[at], other[at] = low[nearer], mixed[nearer], to

        pairs = [(own, to) for a, own in enumerate(tiles) for to in tiles[a:] if (blk[own[0]], blk[to[0]]) == (key[1], key[2])]
        # what each one has in each tile at most, by one piece of memory for all products
        most = {own: np.full((len(tiles), own[1] - own[0]), -np.inf, np.float32) for own in tiles}
        place = {own: k for k, own in enumerate(tiles)}
        held, apart_top = np.empty(TILE * TILE, np.float32), np.full(n, -np.inf, np.float32)
        for own, to in pairs:
            product = held[: (own[1] - own[0]) * (to[1] - to[0])].reshape(own[1] - own[0], to[1] - to[0])
            np.matmul(y[slice(*own)], y[slice(*to)].T, out=product)
            if own == to:
                np.fill_diagonal(product, -np.inf)
            product.max(axis=1, out=most[own][place[to]])
            if own != to:
                product.max(axis=0, out=most[to][place[own]])
            if grp[own[0]] != grp[to[0]]:
                for one, another in ((own, to), (to, own)):
                    mine = apart_top[slice(*one)]
                    np.maximum(mine, most[one][place[another]], out=mine)
        floor = {own: np.maximum(m.max(axis=0), least) - 2 * room for own, m in most.items()}

        def candidates(own: tuple[int, int], to: tuple[int, int]) -> tuple[np.ndarray, np.ndarray]:
            """Pairs of places of two tiles that can be the nearest of the first, of all tiles."""
            hit = np.flatnonzero(most[own][place[to]] >= floor[own])
            product = y[own[0] + hit] @ y[slice(*to)].T
            if own == to:
                product[np.arange(len(hit)), hit] = -np.inf
            i, j = np.nonzero(product >= floor[own][hit, None])
            return hit[i], j

        for own, to in pairs:
            ways = [(own, to)] if own == to else [(own, to), (to, own)]
            found = [candidates(*way) for way in ways]
            if sum(len(i) for i, _ in found) > DENSE * (own[1] - own[0] + to[1] - to[0]):
                # many are equally near: as pairs of their own they would be more than the tile
                exact = x[slice(*own)] @ x[slice(*to)].T
                exact = np.maximum(exact, exact.T) if own == to else exact
                for (one, another), (i, j), product in zip(ways, found, (exact, exact.T)):
                    best = np.full(len(product), -np.inf)
                    np.maximum.at(best, i, product[i, j])
                    keep = product[i, j] >= best[i] - 2 * ROUNDED
                    meet(one[0] + i[keep], another[0] + j[keep], product[i[keep], j[keep]])
            else:
                for (one, another), (i, j) in zip(ways, found):
                    meet(one[0] + i, another[0] + j, np.einsum("ij,ij->i", x[one[0] + i], x[another[0] + j]))
        ids = rows["cid"].to_numpy()
        out = np.clip(1 - (apart_top.astype(float) + float(room)), 0, None)
        return pd.DataFrame({"part": key[0], "cid": ids, "gap": gap, "tie": tie, "other": np.where(other >= 0, ids[other], None), "out": out})

    return go


def _grouped(open_: DataFrame, most: int) -> DataFrame:
    """Adds to clusters (part, cid, size, mean) a hash, their group of about ``most`` neighbours, its block, and the blocks of the part.

    Groups are made as :func:`dealt` makes blocks.  They decide how many rounds it takes, not what merges."""
    some = open_.select("cid", "mean").orderBy(F.xxhash64("cid"), "cid").limit(SAMPLE).collect()
    sample = np.array([r["mean"] for r in some], dtype=float)
    length = np.linalg.norm(sample, axis=1, keepdims=True)
    sample = (sample / np.maximum(length, 1e-9))[length[:, 0] > 1e-9]
    pivots = _spread(sample, min(PIVOTS, CELLS * -(-open_.count() // most))) if len(sample) else np.zeros((1, len(some[0]["mean"])))

    @F.pandas_udf("int")
    def place(means: pd.Series) -> pd.Series:
        return pd.Series((_matrix(means) @ pivots.T).argmax(axis=1).astype(np.int32))

    placed = written(open_.select("part", "cid", "size", "mean", F.xxhash64("cid").alias("h"), place("mean").alias("cell")), "linkage")
    counts: dict[str, list[tuple[int, int]]] = {}
    for r in placed.groupBy("part", "cell").count().orderBy("part", "cell").collect():
        counts.setdefault(r["part"], []).append((r["cell"], r["count"]))
    dealt_to = {}
    for part, cells in counts.items():
        number = [c for c, _ in cells]
        start, chunks, _ = _blocks(np.array([n for _, n in cells]), pivots[number], most)
        groups = int((start + chunks).max())
        each = -(-groups // ROUND_BLOCKS)
        dealt_to |= {(part, c): (int(a), int(k), each, -(-groups // each)) for c, a, k in zip(number, start, chunks)}

    @F.pandas_udf("grp int, blk int, blocks int")
    def deal(part: pd.Series, cell: pd.Series, h: pd.Series) -> pd.DataFrame:
        start, chunks, each, blocks = np.array([dealt_to[k] for k in zip(part, cell)], dtype=np.int64).reshape(-1, 4).T
        grp = start + h.to_numpy() % chunks
        return pd.DataFrame({"grp": grp, "blk": grp // each, "blocks": blocks})

    return placed.withColumn("to", deal("part", "cell", "h")).select("part", "cid", "size", "mean", "h", "to.grp", "to.blk", "to.blocks")


def _group_merges(threshold: float):
    """A row for each cluster of a group: what it merges into, with size and mean where it stays (or goes to a partner elsewhere)."""

    def go(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("cid").reset_index(drop=True)
        ids, x, size = rows["cid"].to_numpy(), _matrix(rows["mean"]), rows["size"].to_numpy()
        mutual = (rows["mutual"] == True).to_numpy(dtype=bool)  # noqa: E712
        place = {c: k for k, c in enumerate(ids)}
        partner = np.array([place.get(o, -1) if m else -1 for o, m in zip(rows["other"], mutual)], dtype=np.int64)
        away = mutual & (partner < 0)
        root, complete = _merged(x, threshold, size, rows["out"].fillna(np.inf).to_numpy(dtype=float), partner, away)
        total, many = np.zeros_like(x), np.zeros(len(x), dtype=np.int64)
        np.add.at(total, root, x * size[:, None])
        np.add.at(many, root, size)
        stays = root == np.arange(len(x))
        mean = [m if s else None for m, s in zip(total / np.maximum(many, 1)[:, None], stays)]
        to = np.where(away, np.minimum(ids, rows["other"].where(away, ids).to_numpy()), ids[root])
        return pd.DataFrame({"part": rows["part"], "cid": ids, "root": to, "size": many, "mean": mean, "complete": complete})

    return go


def _mutual(open_: DataFrame, threshold: float, most: int) -> tuple[DataFrame, DataFrame]:
    """(moves, clusters that stay open) of a round over the clusters ``open_`` (part, cid, size, mean) in groups of about ``most``."""
    live = written(_grouped(open_, most), "linkage")
    rows = live.withColumn("to", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.select("part", F.least("blk", "to").alias("i"), F.greatest("blk", "to").alias("j"), "cid", "mean", "h", "grp", "blk")
    found = rows.groupBy("part", "i", "j").applyInPandas(_nearest(threshold), "part string, cid string, gap double, tie long, other string, out double")
    best = written(found.groupBy("part", "cid").agg(F.min(F.struct("gap", "tie", "other")).alias("b"), F.min("out").alias("out")).select("part", "cid", "b.gap", "b.other", "out"), "linkage")
    near = best.where(F.col("gap") < threshold)
    back = near.select("part", F.col("cid").alias("other"), F.col("other").alias("cid"), F.lit(True).alias("mutual"))
    joined = live.join(best, ["part", "cid"], "left").join(back, ["part", "cid", "other"], "left")
    schema = "part string, cid string, root string, size long, mean array<double>, complete boolean"
    given = joined.select("part", "grp", "cid", "size", "mean", "other", "out", "mutual").groupBy("part", "grp")
    moved = written(given.applyInPandas(_group_merges(threshold), schema), "linkage")
    halves = moved.where(F.col("mean").isNotNull() & ~F.col("complete")).groupBy("part", "root").agg(F.collect_list(F.struct("size", "mean")).alias("x"))
    a, b = F.get("x", F.lit(0)), F.get("x", F.lit(1))
    size = a["size"] + F.coalesce(b["size"], F.lit(0))
    mean = F.when(b.isNull(), a["mean"]).otherwise(F.zip_with(a["mean"], b["mean"], lambda p, q: (p * a["size"] + q * b["size"]) / size))
    return moved.select("part", "cid", "root"), halves.select("part", F.col("root").alias("cid"), size.alias("size"), mean.alias("mean"))


def linked(points: DataFrame, threshold: float, whole: int = WHOLE) -> DataFrame:
    """(point, root): clusters of rows (point, vector, size, part), named by one of their points."""
    members = points.select("part", "point", F.col("point").alias("cid"))
    live = points.select("part", F.col("point").alias("cid"), "size", F.col("vector").alias("mean"))
    schema = "part string, cid string, root string"
    follow = lambda members, moves: members.join(moves, ["part", "cid"], "left").select("part", "point", F.coalesce("root", "cid").alias("cid"))
    others, held = made(), ()
    while True:
        live = written(live, "linkage")
        # the rounds before have been read
        held = (*held, made()[-1])
        release(points.sparkSession, keep=(*others, *held))
        n = written(live.groupBy("part").agg(F.count(F.lit(1)).alias("n_open")).where("n_open > 1"), "linkage")
        small, large = n.where(F.col("n_open") <= whole), n.where(F.col("n_open") > whole)
        done = live.join(small, "part").select("part", "cid", "size", "mean").groupBy("part").applyInPandas(_finish(threshold), schema)
        if large.isEmpty():
            return follow(members, done).select("point", F.col("cid").alias("root"))
        moves, live = _mutual(live.join(large, "part"), threshold, whole)
        members = written(follow(members, moves if small.isEmpty() else done.unionByName(moves)), "linkage")
        held = made()[-1:]


def cluster(vectors: DataFrame, threshold: float, block: int = BLOCK, whole: int = WHOLE) -> DataFrame:
    """(failure_id, root) of rows (failure_id, vector): equal roots are one cluster."""
    points, members = folded(vectors)
    near = parts(points, threshold, block)
    roots = linked(points.join(near, "point"), threshold, whole)
    return members.join(points.select("digest", "point"), "digest").join(roots, "point").select("failure_id", "root")
