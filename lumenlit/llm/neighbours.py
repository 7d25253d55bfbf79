"""Most similar vectors for every vector, by a robust-pruned directed graph per shard.

1. Exact copies collapse to one representative (map-side combining); membership is kept beside the pairs.
2. A shard holds about ``SHARD_ROWS`` vectors. Cells come from spherical k-means on a bounded sample and are joined to shards of neighbouring
   cells; every representative is indexed in its own shard and also asks the shards of the cells that are nearly as near. A cell too large for
   a shard is divided by the same rule once more, from a sample of its own, and so on: nothing is capped.
3. Inside a shard every vector is a node of a directed graph. Nodes are inserted in batches: a greedy beam search proposes neighbours, relaxed
   distance pruning (``ALPHA``) keeps diverse edges, edges also run backwards and are pruned again where a node has too many.
4. A query walks the graph with a beam of ``BEAM`` nodes; members start at their own node, visitors at the nearest of a few pivots. Work per
   query is the beam times the degree, whatever the shard holds (a shard of fewer vectors than that is seen whole).
5. The shards' lists merge into the ``k`` best per vector.

Shards that cannot be divided (more than ``SHARD_ROWS`` vectors in one direction) are cut at random and asked part by part; visitors
beyond ``GUEST_ROWS`` go to copies of a shard. So a task's input is bounded.

Defined results: vectors that are NULL, empty, all zero or hold NULL, NaN or infinite components are not usable and give no
rows; vectors compare only with others of the same length; repeated rows of a chunk count once; ties go to the
smaller id; an empty table gives no rows; a vector alone in its length has no neighbours.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from functools import cache
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenlit.session import checkpoint

#: Rows of the bounded sample that the cells of one table (or of one divided cell) are fitted on, rows a cell aims at, most cells of one fit.
SAMPLE, CELL_ROWS, FINE = 20_000, 1_000, 1_024
#: Vectors indexed in one shard, and visitors that ask one copy of it.
SHARD_ROWS, GUEST_ROWS = 16_384, 65_536
#: A vector asks the shards of every cell less than ``MARGIN`` (in cosine) behind its nearest one, of its ``PROBES`` nearest cells. Partners of
#: a cosine of at least ``least`` lie no further apart than sqrt(2 - 2 least); half of that is margin enough for them.
MARGIN, PROBES = 0.25, 8
#: How often an oversized cell is divided before it is cut at random.
LEVELS = 4
#: Out-degree after pruning, relaxation of pruning, beam while building and of a query, nodes a beam expands at once, rows of one batch, and how
#: many of its own batch a new node is offered as neighbours.
DEGREE, ALPHA, BUILD_BEAM, BEAM, EXPAND, BATCH, MATES = 24, 1.2, 32, 32, 8, 256, 6


def usable(chunks: DataFrame) -> DataFrame:
    """(chunk_id, dim, vector) of rows whose vector can be compared; replays still repeat."""
    v = F.col("vector")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = chunks.where(F.col("chunk_id").isNotNull() & v.isNotNull() & (F.size(v) > 0))
    return rows.where(finite & F.exists(v, lambda x: x != 0)).select("chunk_id", F.size(v).alias("dim"), v.cast("array<float>").alias("vector"))


def classes(vectors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(representatives: id, dim, vector; members: chunk_id, id). The id of a class of equal vectors is its smallest chunk_id."""
    keyed = vectors.select("chunk_id", "dim", "vector", F.xxhash64(F.lit(1), "vector").alias("h1"), F.xxhash64(F.lit(2), "vector").alias("h2"))
    reps = keyed.groupBy("h1", "h2", "dim").agg(F.min("chunk_id").alias("id"), F.first("vector").alias("vector"))
    reps = checkpoint(reps)
    members = keyed.select("chunk_id", "h1", "h2").distinct()
    return reps.select("id", "dim", "vector"), members.join(reps.select("h1", "h2", "id"), ["h1", "h2"]).select("chunk_id", "id")


@cache
def one_thread() -> None:
    """One thread for matrix products in this worker: tasks run side by side, and waiting helper threads would take their cores."""
    for path in Path(np.__file__).parent.parent.glob("numpy.libs/*openblas*"):
        library = ctypes.CDLL(str(path))
        for name in ("scipy_openblas_set_num_threads64_", "scipy_openblas_set_num_threads", "openblas_set_num_threads64_", "openblas_set_num_threads"):
            if hasattr(library, name):
                getattr(library, name)(1)


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of length one; scaled by the largest component first, so that no square overflows."""
    x = x.astype(np.float64)
    x /= np.abs(x).max(1, keepdims=True)
    return (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)


def matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """A list<float> column of equal lengths as rows of a matrix."""
    a = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    n = len(a)
    flat = a.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(n, -1) if n else np.zeros((0, 1), np.float32)


# --- shards


def centres(sample: np.ndarray, k: int, rounds: int = 8, seed: int = 7) -> np.ndarray:
    """Spherical k-means; an emptied cell restarts at the sample row that fits worst."""
    rng = np.random.default_rng(seed)
    c = sample[rng.choice(len(sample), min(k, len(sample)), replace=False)].copy()
    for _ in range(rounds):
        s = np.concatenate([sample[i : i + 4096] @ c.T for i in range(0, len(sample), 4096)])
        a = s.argmax(1)
        sums = np.zeros_like(c)
        np.add.at(sums, a, sample)
        empty = np.flatnonzero(np.bincount(a, minlength=len(c)) == 0)
        if len(empty):
            sums[empty] = sample[np.argsort(s.max(1), kind="stable")[: len(empty)]]
        c = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-12)
    return c.astype(np.float32)


def plan(sample: np.ndarray, rows: int, fine: int, shard_rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(cell centres, shard of every cell, whether that shard is oversized) for ``rows`` vectors of which ``sample`` is a sample."""
    one_thread()
    c = centres(sample, max(2, min(fine, round(rows / CELL_ROWS))))
    nearest = np.concatenate([(sample[i : i + 4096] @ c.T).argmax(1) for i in range(0, len(sample), 4096)])
    weight = np.bincount(nearest, minlength=len(c)) * (rows / max(len(sample), 1))
    shard, over, stack = np.zeros(len(c), np.int64), np.zeros(len(c), bool), [np.arange(len(c))]
    count = 0
    while stack:
        cells = stack.pop()
        if len(cells) == 1 or weight[cells].sum() <= shard_rows:
            shard[cells], over[cells] = count, weight[cells].sum() > 1.5 * shard_rows
            count += 1
            continue
        # Halved by weight along the line between two far centres.
        part = c[cells]
        far = part[(part @ part[0]).argmin()]
        order = cells[np.argsort(part @ (far - part[(part @ far).argmin()]), kind="stable")]
        half = int(np.searchsorted(np.cumsum(weight[order]), weight[order].sum() / 2))
        half = min(max(half, 1), len(order) - 1)
        stack += [order[:half], order[half:]]
    return c, shard, over


def ask(x: np.ndarray, c: np.ndarray, shard: np.ndarray, margin: float) -> tuple[np.ndarray, np.ndarray]:
    """(row, shard) of every shard that the unit vectors ask, a row's own shard first."""
    s = x @ c.T
    p = min(PROBES, s.shape[1])
    top = np.argpartition(-s, p - 1, axis=1)[:, :p]
    best = np.take_along_axis(s, top, 1)
    order = np.argsort(-best, axis=1, kind="stable")
    top, best = np.take_along_axis(top, order, 1), np.take_along_axis(best, order, 1)
    near = best >= best[:, :1] - margin
    to = shard[top]
    for j in range(1, p):
        near[:, j] &= (to[:, :j] != to[:, j : j + 1]).all(1)
    rows, cols = np.nonzero(near)
    return rows, to[rows, cols]


VISITS = "id bigint, dim int, vector array<float>, shard bigint, home boolean, over boolean"


def _visits(b: pa.RecordBatch | pa.Table, rows: np.ndarray, shard: np.ndarray, home: np.ndarray, over: np.ndarray) -> pa.Table:
    taken = pa.Table.from_batches([b]) if isinstance(b, pa.RecordBatch) else b
    taken = taken.select(["id", "dim", "vector"]).take(pa.array(rows))
    for name, values in (("shard", pa.array(shard, pa.int64())), ("home", pa.array(home)), ("over", pa.array(over))):
        taken = taken.append_column(name, values)
    return taken


def _first(rows: np.ndarray) -> np.ndarray:
    return np.concatenate([[True], rows[1:] != rows[:-1]]) if len(rows) else np.zeros(0, bool)


def route(reps: DataFrame, fine: int, shard_rows: int, margin: float) -> DataFrame:
    """``VISITS``: every vector in its own shard (home) and in those it asks."""
    # Lengths with more vectors than a shard holds: at most rows / SHARD_ROWS of them.
    large = {r[0]: r[1] for r in reps.groupBy("dim").count().where(F.col("count") > shard_rows).collect()}
    plans: dict[int, tuple] = {}
    if large:
        rate = F.create_map(*[F.lit(v) for d, n in large.items() for v in (d, min(1.0, SAMPLE / n))])
        chosen = F.pmod(F.xxhash64(F.lit("sample"), "id"), F.lit(1 << 20)) < F.try_element_at(rate, F.col("dim")) * (1 << 20)
        sample = reps.where(F.col("dim").isin(*large)).where(chosen).select("dim", "vector")

        def fit(t: pa.Table) -> pa.Table:
            dim = t["dim"][0].as_py()
            c, shard, over = plan(unit(matrix(t["vector"])), large[dim], fine, shard_rows)
            return pa.table({"dim": pa.array([dim], pa.int32()), "c": pa.array([c.ravel().tolist()], pa.list_(pa.float32())), "shard": pa.array([shard.tolist()], pa.list_(pa.int64())), "over": pa.array([over.tolist()])})

        # One row per such length, of at most FINE centres.
        for r in sample.groupBy("dim").applyInArrow(fit, "dim int, c array<float>, shard array<bigint>, over array<boolean>").collect():
            plans[r.dim] = (np.array(r.c, np.float32).reshape(-1, r.dim), np.array(r.shard), np.array(r.over))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one_thread()
        for b in batches:
            if not b.num_rows:
                continue
            dims = b["dim"].to_numpy()
            for dim in np.unique(dims).tolist():
                part = pa.Table.from_batches([b]).take(pa.array(np.flatnonzero(dims == dim)))
                if dim in plans:
                    c, shard, over = plans[dim]
                    rows, to = ask(unit(matrix(part["vector"])), c, shard, margin)
                    yield from _visits(part, rows, to, _first(rows), np.isin(to, shard[over])).to_batches()
                else:
                    n = part.num_rows
                    yield from _visits(part, np.arange(n), np.zeros(n, np.int64), np.ones(n, bool), np.zeros(n, bool)).to_batches()

    placed = checkpoint(reps.select("id", "dim", "vector").mapInArrow(place, VISITS))
    for _ in range(LEVELS):
        if placed.where("over").isEmpty():
            break
        placed = checkpoint(placed.where("not over").unionByName(divided(placed.where("over"), fine, shard_rows, margin)))
    return placed


def divided(visits: DataFrame, fine: int, shard_rows: int, margin: float) -> DataFrame:
    """``VISITS`` of oversized shards, each divided by cells of its own. Every group of rows is at most about a shard."""
    sizes = visits.groupBy("dim", "shard").agg(F.count_if("home").alias("rows"), F.ceil(F.count("*") / shard_rows).cast("int").alias("salts"))
    sized = visits.join(sizes, ["dim", "shard"])
    chosen = F.pmod(F.xxhash64(F.lit("sample"), "id"), F.lit(1 << 20)) < F.lit(SAMPLE << 20) / F.col("rows")

    def fit(t: pa.Table) -> pa.Table:
        dim, mother, rows, salts = (t[c][0].as_py() for c in ("dim", "shard", "rows", "salts"))
        c, shard, over = plan(unit(matrix(t["vector"])), rows, fine, shard_rows)
        over &= len(np.unique(shard)) > 1  # what cannot be divided is cut at random later
        row = {"dim": [dim], "shard": [mother], "salts": [salts], "c": [c.ravel().tolist()], "sub": [((mother + 1) * FINE + shard).tolist()], "sub_over": [over.tolist()]}
        return pa.table(row, schema=pa.schema([("dim", pa.int32()), ("shard", pa.int64()), ("salts", pa.int32()), ("c", pa.list_(pa.float32())), ("sub", pa.list_(pa.int64())), ("sub_over", pa.list_(pa.bool_()))]))

    sample = sized.where(F.col("home") & chosen).select("dim", "shard", "rows", "salts", "vector")
    fits = sample.groupBy("dim", "shard").applyInArrow(fit, "dim int, shard bigint, salts int, c array<float>, sub array<bigint>, sub_over array<boolean>")
    fits = checkpoint(fits).select("dim", "shard", "c", "sub", "sub_over", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
    salted = sized.withColumn("salt", F.pmod(F.xxhash64(F.lit("salt"), "id"), F.col("salts")).cast("int")).select("id", "dim", "vector", "shard", "home", "salt")

    def again(rows: pa.Table, found: pa.Table) -> pa.Table:
        one_thread()
        if not rows.num_rows or not found.num_rows:
            return pa.table({"id": [], "dim": [], "vector": [], "shard": [], "home": [], "over": []}, schema=pa.schema([("id", pa.int64()), ("dim", pa.int32()), ("vector", pa.list_(pa.float32())), ("shard", pa.int64()), ("home", pa.bool_()), ("over", pa.bool_())]))
        dim = found["dim"][0].as_py()
        c = np.array(found["c"][0].as_py(), np.float32).reshape(-1, dim)
        shard, over = np.array(found["sub"][0].as_py()), np.array(found["sub_over"][0].as_py())
        at, to = ask(unit(matrix(rows["vector"])), c, shard, margin)
        home = rows["home"].to_numpy(zero_copy_only=False).astype(bool)
        return _visits(rows, at, to, home[at] & _first(at), np.isin(to, shard[over]))

    return salted.groupBy("dim", "shard", "salt").cogroup(fits.groupBy("dim", "shard", "salt")).applyInArrow(again, VISITS)


def groups(visits: DataFrame, shard_rows: int, guest_rows: int) -> DataFrame:
    """id, dim, vector, shard, part, copy, indexed, asks: the input of one task per (dim, shard, part, copy), each of bounded size."""
    sizes = visits.groupBy("dim", "shard").agg(F.count_if("home").alias("members"), F.count("*").alias("n"))
    parts = F.when(F.col("members") > 2 * shard_rows, F.ceil(F.col("members") / shard_rows)).otherwise(F.lit(1)).cast("int")
    copies = F.greatest(F.ceil((F.col("n") - F.col("members")) / guest_rows), F.lit(1)).cast("int")
    large = sizes.select("dim", "shard", parts.alias("parts"), copies.alias("copies")).where("parts > 1 or copies > 1")
    if large.isEmpty():
        return visits.select("id", "dim", "vector", "shard", F.lit(0).alias("part"), F.lit(0).alias("copy"), F.col("home").alias("indexed"), F.lit(True).alias("asks"))
    sized = visits.join(large, ["dim", "shard"], "left").fillna(1, ["parts", "copies"])
    own = F.pmod(F.xxhash64(F.lit("part"), "id"), F.col("parts")).cast("int")
    mine = F.pmod(F.xxhash64(F.lit("copy"), "id"), F.col("copies")).cast("int")
    each = sized.withColumns({"own": own, "mine": mine}).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    # A member is indexed in every copy of its part and asks one copy of every part; a visitor asks one copy of every part.
    each = each.withColumn("copy", F.explode(F.when(F.col("home") & (F.col("part") == F.col("own")), F.sequence(F.lit(0), F.col("copies") - 1)).otherwise(F.array("mine"))))
    return each.select("id", "dim", "vector", "shard", "part", "copy", (F.col("home") & (F.col("part") == F.col("own"))).alias("indexed"), (F.col("copy") == F.col("mine")).alias("asks"))


# --- the graph of a shard


def walk(q: np.ndarray, x: np.ndarray, links: np.ndarray, entry: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Beam search of many queries at once: (nodes, their cosines, nodes visited in all); -1 fills a beam that found fewer.

    ``entry``: the nodes each query starts at. Every round expands the ``EXPAND`` best nodes of each beam that were not expanded yet.
    """
    count, n = len(q), len(x)
    ids, scores = np.full((count, beam), -1, np.int32), np.full((count, beam), -4, np.float32)
    done = np.ones((count, beam), bool)
    seen = np.zeros((count, n), np.int16)
    live, new, visits = np.arange(count), entry.astype(np.int32), 0
    while True:
        width = new.shape[1]
        column = np.arange(1, width + 1, dtype=np.int16)
        node = np.maximum(new, 0)
        a, b = np.nonzero((new >= 0) & (seen[live[:, None], node] == 0))
        to = node[a, b]
        seen[live[a], to] = column[b]
        once = seen[live[a], to] == column[b]  # a node that two expanded ones link to
        a, b, to = a[once], b[once], to[once]
        visits += len(to)
        fresh = np.full((len(live), width), -4, np.float32)
        fresh[a, b] = np.einsum("ij,ij->i", x[to], q[live[a]])
        score = np.concatenate([scores[live], fresh], 1)
        node = np.concatenate([ids[live], new], 1)
        old = np.concatenate([done[live], np.zeros(new.shape, bool)], 1)
        top = np.argpartition(-score, beam - 1, axis=1)[:, :beam]
        score, node, old = (np.take_along_axis(m, top, 1) for m in (score, node, old))
        old |= score < -3
        rank = np.where(old, -9, score)
        best = np.argpartition(-rank, min(EXPAND, beam) - 1, axis=1)[:, :EXPAND]
        good = np.take_along_axis(rank, best, 1) > -8
        out = np.where(good, np.take_along_axis(node, best, 1), -1)
        np.put_along_axis(old, best, True, 1)
        scores[live], ids[live], done[live] = score, np.where(score < -3, -1, node), old
        more = good.any(1)
        live, out = live[more], out[more]
        if not len(live):
            break
        new = np.where((out >= 0)[:, :, None], links[np.maximum(out, 0)], -1).reshape(len(live), -1)
    return ids, scores, visits


def prune(nodes: np.ndarray, candidates: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Robust pruning of many nodes at once: of each one's candidates (-1: none) the nearest first, dropping what a kept one is closer to by
    the factor ``ALPHA``; at most ``DEGREE`` stay."""
    node = np.maximum(candidates, 0)
    v = x[node]
    own = np.where((candidates >= 0) & (candidates != nodes[:, None]), 1 - np.einsum("bcd,bd->bc", v, x[nodes]), 9)
    order = np.argsort(own, axis=1, kind="stable")
    own, node, v = np.take_along_axis(own, order, 1), np.take_along_axis(node, order, 1), np.take_along_axis(v, order[:, :, None], 1)
    between = 1 - v @ v.transpose(0, 2, 1)
    alive, kept, size = own < 8, np.full((len(nodes), DEGREE), -1, np.int32), np.zeros(len(nodes), int)
    for i in range(candidates.shape[1]):
        rows = np.flatnonzero(alive[:, i] & (size < DEGREE))
        kept[rows, size[rows]] = node[rows, i]
        size[rows] += 1
        alive[rows] &= ALPHA * np.maximum(between[rows, i], 0) > np.maximum(own[rows], 1e-9)
    return kept


def nearest_pivots(q: np.ndarray, x: np.ndarray, pivots: np.ndarray, most: int = 4) -> np.ndarray:
    s = q @ x[pivots].T
    e = min(most, len(pivots))
    return pivots[np.argpartition(-s, e - 1, axis=1)[:, :e]]


def build(x: np.ndarray, seed: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """(links of every node, -1 for none; pivots). Nodes are inserted in batches that at most double what is there."""
    n = len(x)
    order, width = np.random.default_rng(seed).permutation(n), DEGREE + DEGREE // 2
    links, size = np.full((n, width), -1, np.int32), np.zeros(n, int)
    head = order[: min(n, 64)]
    links[head, :DEGREE] = prune(head, np.tile(head, (len(head), 1)), x)
    size[head] = (links[head] >= 0).sum(1)
    low = len(head)
    while low < n:
        new = order[low : low + min(low, BATCH)]
        pivots = order[: max(8, low // 128)]
        near, _, _ = walk(x[new], x, links, nearest_pivots(x[new], x, pivots), BUILD_BEAM)
        # The batch is not in the graph yet: its own nearest are proposed beside what the search found.
        mates = x[new] @ x[new].T
        np.fill_diagonal(mates, -4)
        few = min(MATES, len(new) - 1)
        near = np.concatenate([near, new[np.argpartition(-mates, few - 1, axis=1)[:, :few]]], 1) if few > 0 else near
        links[new, :DEGREE] = prune(new, near, x)
        size[new] = (links[new] >= 0).sum(1)
        # Edges back, grouped by the node they start at.
        src, dst = np.repeat(new, DEGREE), links[new, :DEGREE].ravel()
        src, dst = src[dst >= 0], dst[dst >= 0]
        by = np.argsort(dst, kind="stable")
        src, dst = src[by], dst[by]
        node, first, count = np.unique(dst, return_index=True, return_counts=True)
        nth = np.arange(len(dst)) - np.repeat(first, count)
        roomy = size[node] + count <= width
        each = np.repeat(roomy, count)
        links[dst[each], size[dst[each]] + nth[each]] = src[each]
        size[node[roomy]] += count[roomy]
        full = node[~roomy]
        if len(full):
            wide = np.full((len(full), width + int(count[~roomy].max())), -1, np.int32)
            wide[:, :width] = links[full]
            wide[np.repeat(np.arange(len(full)), count[~roomy]), width + nth[~each]] = src[~each]
            for i in range(0, len(full), BATCH):
                some = full[i : i + BATCH]
                links[some] = -1
                links[some, :DEGREE] = prune(some, wide[i : i + BATCH], x)
            size[full] = (links[full] >= 0).sum(1)
        low += len(new)
    return links, order[: max(8, n // 128)]


def search(x: np.ndarray, q: np.ndarray, own: np.ndarray, links: np.ndarray, pivots: np.ndarray, k: int, beam: int = 0) -> tuple[np.ndarray, np.ndarray, int]:
    """The ``k`` best nodes of every query (-1: none), their cosines and the nodes visited. ``own``: the query's own node, or -1."""
    entry = nearest_pivots(q, x, pivots)
    entry = np.concatenate([np.where(own >= 0, own, entry[:, 0])[:, None], np.where((own >= 0)[:, None], -1, entry[:, 1:])], 1)
    ids, scores, visits = walk(q, x, links, entry, max(beam or BEAM, k + 1))
    scores = np.where((ids == own[:, None]) | (ids < 0), -4, scores)
    top = np.argpartition(-scores, k - 1, axis=1)[:, :k]
    scores = np.take_along_axis(scores, top, 1)
    return np.where(scores < -3, -1, np.take_along_axis(ids, top, 1)), scores, visits


def search_shard(table: pa.Table, k: int, least: float, exhaust: bool) -> pa.Table:
    """Candidate pairs (id, other, cosine) of one shard. ``exhaust``: a query whose ``k`` best all reach ``least`` may have more such partners
    and is compared with the whole shard, as is one whose walk found fewer than ``k`` nodes."""
    one_thread()
    table = table.sort_by("id")  # ties go to the smaller id
    ids, indexed = table["id"].to_numpy(), table["indexed"].to_numpy(zero_copy_only=False).astype(bool)
    asks = table["asks"].to_numpy(zero_copy_only=False).astype(bool)
    src, dst, cos = [], [], []
    if indexed.any():
        x = unit(matrix(table["vector"]))
        nodes, node_ids = x[indexed], ids[indexed]
        links, pivots = build(nodes)
        own = np.where(indexed, np.cumsum(indexed) - 1, -1)

        def report(q: np.ndarray, to: np.ndarray) -> None:
            s = np.einsum("ij,ij->i", x[q].astype(np.float64), nodes[to].astype(np.float64))  # exact for what is reported
            good = s >= least
            src.append(ids[q][good]), dst.append(node_ids[to][good]), cos.append(s[good])

        for i in range(0, int(asks.sum()), BATCH):
            q = np.flatnonzero(asks)[i : i + BATCH]
            found, scores, _ = search(nodes, x[q], own[q], links, pivots, k)
            a, b = np.nonzero((found >= 0) & (scores >= least - 1e-5))
            report(q[a], found[a, b])
            # Exact ways: a walk that ended in a part of the graph of fewer than k nodes; a full list that may have been cut.
            stuck = (found < 0).any(1)
            whole = stuck | (scores >= least - 1e-5).all(1) if exhaust else stuck
            for some in np.array_split(q[whole], max(1, int(whole.sum()) // 64)):
                s = x[some] @ nodes.T
                s[own[some] >= 0, own[some][own[some] >= 0]] = -4
                if exhaust or len(nodes) <= k:
                    a, b = np.nonzero(s >= max(least - 1e-5, -3))
                else:
                    b = np.argsort(-s, axis=1, kind="stable")[:, :k]
                    a, b = np.repeat(np.arange(len(some)), k), b.ravel()
                    a, b = a[s[a, b] > -3], b[s[a, b] > -3]
                report(some[a], b)
    join = lambda parts, kind: np.concatenate(parts).astype(kind) if parts else np.zeros(0, kind)
    return pa.table({"id": join(src, np.int64), "other": join(dst, np.int64), "cosine": join(cos, np.float64)})


def candidates(reps: DataFrame, k: int, least: float, exhaust: bool = False) -> DataFrame:
    """(id, other, cosine) proposed by the shards; up to ``k`` for every vector and shard asked, more where ``exhaust`` says so."""
    margin = min(MARGIN, 0.5 * (2 - 2 * max(least, -1.0)) ** 0.5)
    tasks = groups(route(reps, FINE, SHARD_ROWS, margin), SHARD_ROWS, GUEST_ROWS)
    return tasks.groupBy("dim", "shard", "part", "copy").applyInArrow(lambda t: search_shard(t, k, least, exhaust), "id bigint, other bigint, cosine double")


def nearest_classes(reps: DataFrame, k: int = 10, least: float = -1.0) -> DataFrame:
    """(id, other, cosine, place): the ``k`` best of every class; ``least`` leaves out pairs below it."""
    best = F.slice(F.sort_array(F.collect_list(F.struct(F.col("cosine"), (-F.col("other")).alias("m"))), asc=False), 1, k)
    # At most k rows for each shard asked, so a list has at most PROBES * k entries.
    merged = candidates(reps, k, least).groupBy("id", "other").agg(F.max("cosine").alias("cosine")).groupBy("id").agg(best.alias("best"))
    return merged.select("id", F.posexplode("best").alias("place", "b")).select("id", (-F.col("b.m")).alias("other"), F.col("b.cosine").alias("cosine"), (F.col("place") + 1).alias("place"))


def knn(chunks: DataFrame, k: int = 10) -> DataFrame:
    """(chunk_id, class_id, neighbour_class, cosine, place): every usable chunk's nearest classes of equal vectors; a chunk's own
    class is not repeated. One row per chunk and neighbour; ``class_id`` is the smallest chunk_id with the same vector."""
    reps, members = classes(usable(chunks))
    near = nearest_classes(reps, k)
    return members.join(near, "id").select("chunk_id", F.col("id").alias("class_id"), F.col("other").alias("neighbour_class"), "cosine", "place")


def close_pairs(chunks: DataFrame, least: float = 0.95, k: int = 10) -> DataFrame:
    """(chunk_id_a, chunk_id_b), a < b: chunks whose cosine is at least ``least``; a class with ``k`` close ones or more is compared with its
    whole shard, so that none of its partners is cut off."""
    reps, members = classes(usable(chunks))
    near = candidates(reps, k, least - 1e-9, exhaust=True)
    sides = near.select(F.least("id", "other").alias("a"), F.greatest("id", "other").alias("b")).distinct()
    m = lambda x: members.select(F.col("id").alias(x), F.col("chunk_id").alias(f"chunk_id_{x}"))
    across = sides.join(m("a"), "a").join(m("b"), "b").select(
        F.least("chunk_id_a", "chunk_id_b").alias("chunk_id_a"), F.greatest("chunk_id_a", "chunk_id_b").alias("chunk_id_b")
    )
    several = members.groupBy("id").count().where(F.col("count") > 1).select("id")
    inside = members.join(several, "id", "left_semi")
    within = inside.alias("x").join(inside.alias("y"), "id").where(F.col("x.chunk_id") < F.col("y.chunk_id"))
    return across.unionByName(within.select(F.col("x.chunk_id").alias("chunk_id_a"), F.col("y.chunk_id").alias("chunk_id_b")))
