"""Operator 8: embedding near-dedup by dual traversal of cover trees.

Vectors of length 1 with cosine at least t are at most sqrt(2 - 2t) apart. The
top of the tree is a net of points that covers a bounded sample; every vector
belongs to the node of its nearest point, whose covering radius is taken over
all its vectors. A vector is sent to the nodes whose radius and the bound reach
it, and to no others. Nodes of too many vectors are split into blocks.

Within a block the cover tree goes on: nested levels whose radii halve, a node's
point being one of its children's too, each node with its true covering radius.
Each pair of blocks is a group of its own, whose trees are traversed together:
a pair of nodes further apart than the radii and the bound allow is pruned; one
whose points must all link is counted whole; the rest descend, and points are
compared by their cosine in double precision.

The sample decides how much is pruned, not what is found. Where vectors have no
structure, all nodes reach each other, and a vector is sent to about as many
blocks as there are: as many as the square root of the vectors, in steps of
``SPREAD``, unless memory asks for more.

Edge cases: vectors that are null or zero, or hold null or non-finite
components, link with nothing. Only vectors of one dimension are compared.
Rows without an id come back unlinked. Rows that share an id are one vector:
links join the id, and each row counts as a vector for the others' links. An
empty table gives no rows; further columns have no influence.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import map_arrow, persist
from .graph import connected_components
from .words import grouped

THRESHOLD = 0.95
#: Vectors of a block: the square root of their number times SPREAD, at least LEAST, at most so many bytes.
SPREAD, LEAST, BLOCK_BYTES = 16, 2048, 32 << 20
#: Points at the top of the tree, and vectors that are sampled for each.
TOP, SAMPLED = 512, 8
RADII = (1.0, 0.5, 0.25, 0.125, 0.0625)
_SLACK = 1e-9


def net(points: np.ndarray, radius: float) -> tuple[np.ndarray, np.ndarray]:
    """Centers no closer than ``radius`` that cover all points; each point's center."""
    centers: list[int] = []
    label = np.zeros(len(points), np.int64)
    for at in range(0, len(points), 512):
        part = points[at : at + 512]
        best = np.full(len(part), np.inf)
        if centers:
            d = 2 - 2 * part @ points[centers].T
            label[at : at + len(part)] = d.argmin(1)
            best = d.min(1)
        own = 2 - 2 * part @ part.T
        for i in np.flatnonzero(best > radius * radius):
            if best[i] > radius * radius:  # not covered by a center found meanwhile
                closer = own[i] < best
                closer[i] = True
                best = np.where(closer, own[i], best)
                best[i] = 0
                label[at + np.flatnonzero(closer)] = len(centers)
                centers.append(at + int(i))
    return np.array(centers, np.int64), label


def levels(points: np.ndarray) -> np.ndarray:
    """The node of each point at each level, named by the number of its center.

    Finer levels refine coarser ones, and a center stays one at all finer levels.
    """
    out = np.zeros((len(points), len(RADII)), np.int32)
    group = np.zeros(len(points), np.int64)
    for k, radius in enumerate(RADII):
        order = np.argsort(group, kind="stable")
        cut = np.append(np.flatnonzero(np.diff(group[order], prepend=-1)), len(order))
        new = group.copy()
        for a, b in zip(cut, cut[1:], strict=False):
            rows = order[a:b]
            if b - a == 1:
                new[rows] = rows
                continue
            if k:  # the parent's center comes first, and so becomes a center
                rows = np.append(group[rows[0]], rows[rows != group[rows[0]]])
            centers, label = net(points[rows], radius)
            new[rows] = rows[centers[label]]
        out[:, k] = group = new
    return out


class Tree:
    """Nodes of all levels over points sorted by level; each a range of points.

    ``at`` holds the points' numbers in their block, rising. Where only some of a
    block are here, a node whose center is not takes its first point instead.
    """

    def __init__(self, points: np.ndarray, label: np.ndarray, at: np.ndarray):
        self.order = np.lexsort(label.T[::-1])
        self.points = points[self.order]
        label = label[self.order]
        n = len(points)
        cuts = [np.append(np.flatnonzero((np.diff(label[:, k], prepend=-1) != 0)), n) for k in range(label.shape[1])] + [np.arange(n + 1)]
        self.levels = []
        for k, cut in enumerate(cuts):
            start, size = cut[:-1], np.diff(cut)
            center = self.points[start]
            if k < label.shape[1]:
                place = np.minimum(np.searchsorted(at, label[start, k]), n - 1)
                here = at[place] == label[start, k]
                center[here] = points[place[here]]
            gap = self.points - np.repeat(center, size, axis=0)
            radius = np.sqrt(np.maximum.reduceat((gap * gap).sum(1), start))
            child = np.searchsorted(cuts[k + 1], cut) if k + 1 < len(cuts) else None
            self.levels.append((center, radius, start, size, child))


def _expand(a: np.ndarray, b: np.ndarray, ca: np.ndarray, cb: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of children of each pair of nodes."""
    na, nb = ca[a + 1] - ca[a], cb[b + 1] - cb[b]
    total = na * nb
    at = np.arange(total.sum()) - np.repeat(np.cumsum(total) - total, total)
    nb_ = np.repeat(nb, total)
    return np.repeat(ca[a], total) + at // nb_, np.repeat(cb[b], total) + at % nb_


def dual_traversal(left: Tree, right: Tree, threshold: float, found) -> None:
    """Call ``found(a0, a1, b0, b1)`` with ranges of points that all link.

    Ranges are arrays: starts and sizes on either side. If both trees are the
    same, each pair of points comes both ways, and points come with themselves.
    """
    bound = np.sqrt(2 - 2 * threshold) + _SLACK
    ca, ra, _, sa, _ = left.levels[0]
    cb, rb, _, sb, _ = right.levels[0]
    norm_b = (cb * cb).sum(1)
    work = []
    for at in range(0, len(ca), 1024):
        part = ca[at : at + 1024]
        d2 = (part * part).sum(1)[:, None] + norm_b[None, :] - 2 * part @ cb.T
        reach = ra[at : at + 1024, None] + rb[None, :] + bound
        i, j = np.nonzero(d2 <= reach * reach + _SLACK)
        if len(i):
            work.append((0, i + at, j))
    last = len(left.levels) - 1
    while work:
        k, a, b = work.pop()
        ca, ra, pa_, sa, ka = left.levels[k]
        cb, rb, pb, sb, kb = right.levels[k]
        if k == last:
            for at in range(0, len(a), 200_000):
                x, y = a[at : at + 200_000], b[at : at + 200_000]
                ok = np.einsum("ij,ij->i", left.points[x], right.points[y]) >= threshold
                found(x[ok], np.ones(int(ok.sum()), np.int64), y[ok], np.ones(int(ok.sum()), np.int64))
            continue
        if k:
            d = np.concatenate([np.sqrt(((ca[a[i : i + 200_000]] - cb[b[i : i + 200_000]]) ** 2).sum(1)) for i in range(0, len(a), 200_000)])
        else:
            d = np.sqrt(((ca[a] - cb[b]) ** 2).sum(1))
        near = d <= ra[a] + rb[b] + bound
        whole = near & (d + ra[a] + rb[b] <= bound - 3 * _SLACK) & ((sa[a] > 1) | (sb[b] > 1))
        found(pa_[a[whole]], sa[a[whole]], pb[b[whole]], sb[b[whole]])
        a, b = a[near & ~whole], b[near & ~whole]
        sizes = np.cumsum((ka[a + 1] - ka[a]) * (kb[b + 1] - kb[b]))
        for part in np.split(np.arange(len(a)), np.flatnonzero(np.diff(sizes // 1_000_000)) + 1):
            if len(part):
                work.append((k + 1, *_expand(a[part], b[part], ka, kb)))


def block_links(x: tuple, y: tuple | None, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids, their number of links, and the least id they reach in this pair of blocks.

    ``x`` and ``y`` are (ids, points, nodes, numbers); without ``y``, within x.
    """
    left = Tree(*x[1:])
    right = left if y is None else Tree(*y[1:])
    ids = x[0][left.order] if y is None else np.concatenate([x[0][left.order], y[0][right.order]])
    shift = 0 if y is None else len(x[0])
    n = len(ids)
    links, edges = np.zeros(n + 1, np.int64), []

    def found(a, sa, b, sb):
        if not len(a):
            return
        np.add.at(links, a, sb)
        np.add.at(links, a + sa, -sb)
        if shift:
            np.add.at(links, b + shift, sa)
            np.add.at(links, b + shift + sb, -sa)
        # a chain through both ranges connects them
        edges.append((a, b + shift))
        for start, size in ((a, sa), (b + shift, sb)):
            start, size = start[size > 1], size[size > 1]
            step = np.repeat(start, size - 1) + np.arange((size - 1).sum()) - np.repeat(np.cumsum(size - 1) - (size - 1), size - 1)
            edges.append((step, step + 1))

    dual_traversal(left, right, threshold, found)
    counts = np.cumsum(links)[:n] - (0 if shift else 1)  # a point links with itself there
    root = ids.copy()
    if edges:
        u, v = (np.concatenate(e) for e in zip(*edges, strict=True))
        while True:
            before = root.copy()
            m = np.minimum(root[u], root[v])
            np.minimum.at(root, u, m)
            np.minimum.at(root, v, m)
            if (root == before).all():
                break
    some = counts > 0
    return ids[some], counts[some], root[some]


def _unit(values: list, kind=np.float64) -> np.ndarray | None:
    """The vector with length 1, or None where it links with nothing."""
    if values is None or not len(values) or None in values:
        return None
    v = np.array(values, kind)
    if not np.isfinite(v).all() or not v.any():
        return None
    v = v / np.abs(v).max()
    return v / np.sqrt(v @ v)


class Top:
    """The points at the top of the trees of all vectors of one dimension, and their blocks."""

    def __init__(self, sample: np.ndarray, most: int):
        radius, self.points = 2.0, sample[:1]
        while radius > RADII[-1]:  # the finest net that is not too large
            centers, _ = net(sample, radius)
            if len(centers) > most:
                break
            self.points, radius = sample[centers], radius / 2
        self.radius = np.zeros(len(self.points))
        self.blocks = np.ones(len(self.points), np.int64)

    def distances(self, units: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum(2 - 2 * units @ self.points.T, 0))

    def cover(self, node: int, radius: float, count: int, block: int) -> None:
        self.radius[node] = radius + _SLACK
        self.blocks[node] = -(-count // block)

    def reached(self, units: np.ndarray, bound: float) -> np.ndarray:
        """Which nodes each vector can have partners in."""
        return self.distances(units) <= self.radius + bound + 1e-7


def block_rows(n: int, dims: int) -> int:
    """Vectors of a block, for ``n`` vectors in all."""
    return max(64, min(max(LEAST, SPREAD * math.isqrt(n)), BLOCK_BYTES // (8 * dims)))


def tops(good: DataFrame, block: int | None) -> dict[int, tuple[Top, int]]:
    """For each dimension the top of its trees and the vectors of a block; a row a dimension and node come to the driver."""
    sizes = {r[0]: r[1] for r in good.groupBy("dims").count().collect()}
    rows = {d: block or block_rows(n, d) for d, n in sizes.items()}
    most = {d: min(TOP, -(-n // rows[d])) for d, n in sizes.items()}
    by_hash = Window.partitionBy("dims").orderBy(F.xxhash64("unit"), "id")
    sample = good.select("dims", "unit", F.row_number().over(by_hash).alias("n")).where(F.col("n") <= SAMPLED * max(most.values(), default=0))
    units: dict[int, list] = {}
    for r in sample.orderBy("dims", "n").toLocalIterator():  # TOP * SAMPLED vectors a dimension at most
        if r.n <= SAMPLED * most[r.dims]:
            units.setdefault(r.dims, []).append(np.frombuffer(r.unit))
    return {d: (Top(np.array(u), most[d]), rows[d]) for d, u in units.items()}


def embedding_groups(df: DataFrame, vector: str = "embedding", id_col: str = "vec_id", threshold: float = THRESHOLD, block: int | None = None) -> DataFrame:
    """``id_col, n_links, component_id, kept``, one row a vector."""

    def units(batch):
        keep, out = [], []
        for i, v in enumerate(batch.column(1).to_pylist()):
            u = _unit(v)
            if u is not None:
                keep.append(i)
                out.append(u)
        return {"id": batch.column(0).take(pa.array(keep, pa.int64())), "dims": [len(u) for u in out], "unit": [u.tobytes() for u in out]}

    source = df.select(F.col(id_col).cast("long").alias("id"), F.col(vector).alias("v"))
    good = persist(map_arrow(source.where("id IS NOT NULL"), units, "id long, dims long, unit binary"), "units")
    top, bound = tops(good, block), math.sqrt(2 - 2 * threshold)

    def parts(batch, at, column):
        dims = np.asarray(batch.column(at))
        for d in np.unique(dims):
            rows = np.flatnonzero(dims == d)
            data = b"".join(batch.column(column).take(pa.array(rows)).to_pylist())
            yield int(d), rows, np.frombuffer(data).reshape(len(rows), -1)

    def nearest(batch):
        node, gap = np.zeros(len(batch), np.int64), np.zeros(len(batch))
        for d, rows, x in parts(batch, 1, 2):
            far = top[d][0].distances(x)
            node[rows], gap[rows] = far.argmin(1), far.min(1)
        return {"dims": batch.column(1), "node": node, "gap": gap, "id": batch.column(0), "unit": batch.column(2)}

    dealt = persist(map_arrow(good.select("id", "dims", "unit"), nearest, "dims long, node long, gap double, id long, unit binary", "unit"), "dealt")
    for r in dealt.groupBy("dims", "node").agg(F.max("gap").alias("radius"), F.count("*").alias("n")).collect():  # TOP rows a dimension at most
        top[r.dims][0].cover(r.node, r.radius, r.n, top[r.dims][1])
    first = {d: np.cumsum(t.blocks) - t.blocks for d, (t, _) in top.items()}  # numbers of the nodes' blocks

    def own(batch):
        out = np.zeros(len(batch), np.int64)
        node, salt = np.asarray(batch.column(1)), np.asarray(batch.column(2))
        for d in np.unique(np.asarray(batch.column(0))):
            rows = np.flatnonzero(np.asarray(batch.column(0)) == d)
            out[rows] = first[d][node[rows]] + salt[rows] % top[d][0].blocks[node[rows]]
        return {"dims": batch.column(0), "own": out, "id": batch.column(3), "unit": batch.column(4)}

    blocks = map_arrow(dealt.select("dims", "node", F.pmod(F.xxhash64("id", "unit"), F.lit(1 << 40)).alias("salt"), "id", "unit"), own, "dims long, own long, id long, unit binary", "unit")

    def plant(table: pa.Table):
        for a, b in _cuts(table, 2):
            part = table.slice(a, b - a)
            points = np.frombuffer(b"".join(part.column(3).to_pylist())).reshape(b - a, -1)
            label = np.column_stack([np.arange(b - a, dtype=np.int32), levels(points)])
            yield pa.RecordBatch.from_arrays([*(part.column(k).combine_chunks() for k in range(4)), pa.array([r.tobytes() for r in label], pa.binary())], names=["dims", "own", "id", "unit", "nodes"])

    trees = persist(blocks.repartition("dims", "own").sortWithinPartitions("dims", "own").mapInArrow(lambda it: grouped(it, 2, 1, plant), "dims long, own long, id long, unit binary, nodes binary"), "trees")

    def visit(batch):
        """A row for each block that a vector can have partners in."""
        take, other = [], []
        for d, rows, x in parts(batch, 0, 3):
            i, node = np.nonzero(top[d][0].reached(x, bound))
            n = top[d][0].blocks[node]
            take.append(np.repeat(rows[i], n))
            other.append(np.repeat(first[d][node] - (np.cumsum(n) - n), n) + np.arange(n.sum()))
        take, other = (np.concatenate(c) if c else np.zeros(0, np.int64) for c in (take, other))
        mine = np.asarray(batch.column(1))[take]
        rest = [batch.column(k).take(pa.array(take)) for k in range(5)]
        return {"dims": rest[0], "a": np.minimum(mine, other), "b": np.maximum(mine, other), "own": rest[1], "id": rest[2], "unit": rest[3], "nodes": rest[4]}

    pairs = map_arrow(trees, visit, "dims long, a long, b long, own long, id long, unit binary, nodes binary", "unit", 256 << 10)

    def traverse(table: pa.Table):
        for a, b in _cuts(table, 3):
            part = table.slice(a, b - a)
            own = np.asarray(part.column(3))
            label = np.frombuffer(b"".join(part.column(6).to_pylist()), np.int32).reshape(b - a, -1)
            order = np.lexsort((label[:, 0], own))  # labels are numbers of centers, in the order of planting
            own, at, label, ids = own[order], label[order, 0], label[order, 1:], np.asarray(part.column(4))[order]
            points = np.frombuffer(b"".join(part.column(5).to_pylist())).reshape(b - a, -1)[order]
            if part.column(1)[0].as_py() == part.column(2)[0].as_py():
                got = block_links((ids, points, label, at), None, threshold)
            else:
                x, y = own == own[0], own != own[0]
                if not y.any():
                    continue
                got = block_links(*((ids[s], points[s], label[s], at[s]) for s in (x, y)), threshold)
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in got], names=["id", "links", "root"])

    linked = persist(pairs.repartition("dims", "a", "b").sortWithinPartitions("dims", "a", "b").mapInArrow(lambda it: grouped(it, 3, 1, traverse), "id long, links long, root long"), "linked")
    parts = connected_components(linked.select(F.col("id").alias("u"), F.col("root").alias("v")))
    known = linked.groupBy("id").agg(F.sum("links").alias("links")).join(parts, "id", "left")
    valid = good.select("id").distinct().withColumn("valid", F.lit(True))
    out = source.select("id").join(known.join(valid, "id"), "id", "left")
    component = F.coalesce("component", "id")
    return out.select(F.col("id").alias(id_col), F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(component == F.col("id"), F.lit(True)).alias("kept"))


def _cuts(table: pa.Table, keys: int) -> list[tuple[int, int]]:
    change = np.zeros(table.num_rows, bool)
    change[0] = True
    for k in range(keys):
        c = np.asarray(table.column(k))
        change[1:] |= c[1:] != c[:-1]
    cut = [*np.flatnonzero(change).tolist(), table.num_rows]
    return list(zip(cut, cut[1:], strict=False))


def op8_embeddings(df: DataFrame, **options) -> DataFrame:
    """The near-dedup with its default parameters; see :func:`embedding_groups`."""
    return embedding_groups(df, **options)
