"""Grouping pages into similarity clusters by Markov clustering of a sparse similarity graph.

1. The latest row of each page with a usable vector is kept as 64 signed bytes of its unit vector (the cosine of two such codes is
   off by less than :data:`CODE_ERROR`). Pages with equal codes collapse to one node before anything else meets.
2. Candidate search: every page goes to the cells of its ``probes`` nearest pivots. Pivots are a sample of the pages, so crowded
   regions get more cells and no cell grows with a group's size. Where the pivots that a task can hold leave cells too large, cells are
   split again by pivots of their own, until they are of the size asked for, however many pages there are. Within a cell all pages are
   compared in blocks; what leaves it is the sparse graph of its alike pages: the ``degree`` most alike of each page, and the most alike
   pairs that join what these leave apart. Pairs that are within the code error of the threshold are decided on the full vectors where
   they join two local groups, the likeliest few; a cell with more of them, or with one that may be among a page's most alike, is
   compared once more, on the full vectors of all its pages.
3. Markov clustering of the pages' graph: columns are expanded (sparse matrix squaring), inflated, pruned and normalised until they stand
   still; each page goes to the attractor of its greatest flow, which makes the clusters. Flow never leaves what pairs join: the matrix
   falls into blocks, which tasks square in memory, and blocks that are too large for that are squared as join and sum.
4. Clusters that an alike pair of two pages links are joined, so a group is all pages joined by alike pages.
5. A page's strength is its alike mass (the sum of its cosines to alike pages) times the share of its flow that ends at the attractor of
   its group that receives most mass; the pages of the greatest strength represent the group.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foliolake.llm.components import connected_components
from foliolake.llm.flow import block_flow
from foliolake.runtime import drop_materialized, materialize, spread

DIM = 64
#: A code is the unit vector times 127 over its largest component, rounded: bounds the error of a cosine.
CODE_ERROR = 0.02
#: At most this many pages serve as pivots of the whole table (64 bytes each), and as pivots of one of its cells.
MAX_PIVOTS, CELL_PIVOTS = 65_536, 1024
#: Pages of a cell that one task splits at most, on average.
SPLIT_AT_ONCE = 50_000
#: Undecided pairs that a cell gives for two of its local groups at most, and that it holds before it looks again which are needed.
PAIR_LIMIT, HELD_PAIRS = 16, 1 << 20
#: Pages that each page is joined to in a cell: its most alike.
DEGREE = 8
#: Edges of a block that a task clusters in memory at most, and of the blocks that meet in a task on average.
BLOCK_EDGES, TASK_EDGES = 1_000_000, 100_000
#: Width of the pivot blocks whose maxima are compared first; bounds the similarities a task holds at once.
PIVOT_BLOCK, SIMS_AT_ONCE = 64, 1 << 22


def _codes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        vec = batch.column("page_embeddings")
        if pa.types.is_large_list(vec.type):
            vec = vec.cast(pa.list_(pa.float32()))
        n = batch.num_rows
        offsets = vec.offsets.to_numpy()
        ok = (np.diff(offsets) == DIM) & ~np.asarray(vec.is_null())
        out: list = [None] * n
        if ok.any():
            flat = vec.values.cast(pa.float64()).to_numpy(zero_copy_only=False)
            rows = np.nonzero(ok)[0]
            m = flat[offsets[rows][:, None] + np.arange(DIM)]
            top = np.abs(m).max(axis=1)
            good = np.isfinite(m).all(axis=1) & (top > 0)
            codes = np.rint(m[good] / top[good][:, None] * 127).astype(np.int8)
            for r, c in zip(rows[good], codes):
                out[r] = c.tobytes()
        yield pa.record_batch([batch.column("page_id"), batch.column("written_at"), pa.array(out, pa.binary())], names=["page_id", "written_at", "code"])


def page_codes(vectors: DataFrame) -> DataFrame:
    """(page_id, code): the latest row of every page, if its vector is usable. Among rows of equal time a usable one is preferred;
    rows without a page or a time are ignored."""
    slim = vectors.select("page_id", "written_at", "page_embeddings").filter("page_id is not null and written_at is not null")
    coded = spread(slim).mapInArrow(_codes, slim.select("page_id", "written_at", F.lit(None).cast("binary").alias("code")).schema)
    latest = coded.groupBy("page_id").agg(F.max(F.struct("written_at", F.col("code").isNotNull().alias("ok"), "code"))["code"].alias("code"))
    return latest.filter("code is not null")


def _unit(codes: list[bytes]) -> np.ndarray:
    m = np.frombuffer(b"".join(codes), np.int8).reshape(-1, DIM).astype(np.float32)
    return m / np.linalg.norm(m, axis=1, keepdims=True)


def _nearest(x: np.ndarray, pivots: np.ndarray, coarse: np.ndarray | None, home: list[np.ndarray] | None, probes: int) -> np.ndarray:
    """Numbers of the ``probes`` nearest pivots of each row. All pivots given are looked at, so ``coarse`` and ``home``, which once
    narrowed the search, change nothing.

    The nearest pivots lie in the ``probes`` blocks of the greatest maxima; only these blocks are ranked.
    """
    probes = min(probes, len(pivots))
    blocks = len(pivots) // PIVOT_BLOCK
    rest = np.arange(blocks * PIVOT_BLOCK, len(pivots))
    step = max(64, SIMS_AT_ONCE // len(pivots))
    out = np.empty((len(x), probes), np.int64)
    for lo in range(0, len(x), step):
        sims = x[lo : lo + step] @ pivots.T
        n = len(sims)
        if blocks <= 4 * probes:
            out[lo : lo + n] = np.argpartition(-sims, probes - 1, axis=1)[:, :probes]
            continue
        # A block is every blocks-th pivot, so the maxima of all blocks come from whole rows at a time.
        top = sims[:, : len(pivots) - len(rest)].reshape(n, PIVOT_BLOCK, blocks).max(axis=1)
        best = np.argpartition(-top, probes - 1, axis=1)[:, :probes]
        ids = (best[:, :, None] + np.arange(PIVOT_BLOCK) * blocks).reshape(n, -1)
        ids = np.hstack([ids, np.broadcast_to(rest, (n, len(rest)))])
        pick = np.argpartition(-np.take_along_axis(sims, ids, 1), probes - 1, axis=1)[:, :probes]
        out[lo : lo + n] = np.take_along_axis(ids, pick, 1)
    return out


CELL_SCHEMA = "cell long, page_id long, code binary, n long"


def _cells(codes: DataFrame, pivots: list[bytes], probes: int) -> DataFrame:
    """(cell, page_id, code, n): each node in the cells of its nearest pivots."""
    piv = _unit(pivots)
    share = codes.sparkSession.sparkContext.broadcast(np.ascontiguousarray(piv))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pivots = share.value
        for batch in batches:
            code, page, n = batch.column("code").to_pylist(), batch.column("page_id").to_numpy(), batch.column("n").to_numpy()
            for lo in range(0, len(code), 2048):
                part = code[lo : lo + 2048]
                at = _nearest(_unit(part), pivots, None, None, probes)
                r, k = np.nonzero(at >= 0)
                yield pa.record_batch(
                    [pa.array(at[r, k].astype(np.int64)), pa.array(page[lo : lo + 2048][r]), pa.array(np.array(part, dtype=object)[r], pa.binary()), pa.array(n[lo : lo + 2048][r])],
                    names=["cell", "page_id", "code", "n"],
                )

    return spread(codes.select("page_id", "code", "n")).mapInArrow(assign, CELL_SCHEMA)


def _split_cells(cells: DataFrame, size: float, cell_size: int, probes: int, level: int) -> DataFrame:
    """The cells, of ``size`` pages on average, split by pivots of their own: each page goes to the new cells of its ``probes`` nearest
    pivots of its cell. A cell is worked on in parts of about :data:`SPLIT_AT_ONCE` pages, each with all the cell's pivots."""
    share = min(CELL_PIVOTS / size, 1.0 / cell_size)
    drawn = F.pmod(F.xxhash64("page_id", F.lit(level)), F.lit(1 << 30)) < F.lit(int(share * (1 << 30)))
    parts = max(1, round(size / SPLIT_AT_ONCE))
    rows = cells.withColumn("part", F.pmod(F.xxhash64("page_id", "cell"), F.lit(parts)))
    pivots = cells.filter(drawn).select("cell", "page_id", "code", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long"))).alias("part"))

    def assign(key: tuple, own: pa.Table, drawn: pa.Table) -> pa.Table:
        cell, page, code, n = key[0].as_py(), own.column("page_id"), own.column("code"), own.column("n")
        if drawn.num_rows < 2:
            return pa.table({"cell": pa.array(np.full(own.num_rows, cell, np.int64)), "page_id": page, "code": code, "n": n})
        drawn = drawn.sort_by("page_id")
        names = np.array([hash((cell, level, p)) for p in drawn.column("page_id").to_pylist()], np.int64)
        at = _nearest(_unit(code.to_pylist()), _unit(drawn.column("code").to_pylist()), None, None, probes)
        row = pa.array(np.repeat(np.arange(len(at)), at.shape[1]))
        return pa.table({"cell": pa.array(names[at.ravel()]), "page_id": page.take(row), "code": code.take(row), "n": n.take(row)})

    return rows.groupBy("cell", "part").cogroup(pivots.groupBy("cell", "part")).applyInArrow(assign, CELL_SCHEMA)


def _likeliest(pairs: np.ndarray, sims: np.ndarray, roots: np.ndarray, limit: int) -> tuple[np.ndarray, np.ndarray, bool]:
    """(pairs, sims, whether any were left out): of the pairs of two different groups the ``limit`` of the highest cosines."""
    a, b = roots[pairs].min(axis=1), roots[pairs].max(axis=1)
    apart = a != b
    pairs, sims, a, b = pairs[apart], sims[apart], a[apart], b[apart]
    order = np.lexsort([pairs[:, 1], pairs[:, 0], -sims, b, a])
    pairs, sims, a, b = pairs[order], sims[order], a[order], b[order]
    new = np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])]) if len(a) else np.zeros(0, bool)
    at = np.arange(len(a))
    keep = at - np.maximum.accumulate(np.where(new, at, 0)) < limit if len(a) else new
    return pairs[keep], sims[keep], bool((~keep).any())


def _joined(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest row of each row's component, when edges (a, b) are added to components ``root``."""
    root = root.copy()
    while len(a):
        ra, rb = root[a], root[b]
        apart = ra != rb
        a, b, ra, rb = a[apart], b[apart], ra[apart], rb[apart]
        low = np.minimum(ra, rb)
        np.minimum.at(root, ra, low)
        np.minimum.at(root, rb, low)
        while (root != (up := root[root])).any():
            root = up
    return root


def local_graph(
    x: np.ndarray, copies: np.ndarray, threshold: float, margin: float, degree: int = DEGREE, block: int = 1024, limit: int = PAIR_LIMIT
) -> tuple[np.ndarray, np.ndarray, list[tuple[int, int]], bool, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """The sparse graph of the surely alike pairs (cosine of at least threshold + margin) of the unit rows ``x``, each of which stands
    for ``copies`` pages: the ``degree`` most alike of each row, and the most alike pairs that join what these leave apart.

    Returns each row's component (its smallest row), its alike mass (the sum of its cosines to alike pages, itself included), the
    undecided pairs (cosine within ``margin`` of the threshold) of different components, at most ``limit`` for two components, whether
    there were more or one that may be among the ``degree`` most alike of a row, and the graph: rows, lower rows, cosines.
    """
    n = len(x)
    mass, weight, count = np.zeros(n), copies.astype(x.dtype), np.zeros(n, np.int64)
    held = [(lo, x[lo : lo + block] @ x.T) for lo in range(0, n, block)] if n <= 2 * block else None
    edges, unsure = [], False

    def blocks() -> Iterator[tuple[int, np.ndarray]]:
        return iter(held) if held else ((lo, x[lo : lo + block] @ x.T) for lo in range(0, n, block))

    for lo, sims in blocks():
        own = np.arange(len(sims))
        sure = sims >= threshold + margin
        alike = np.where(sure, sims, 0)
        mass[lo : lo + len(sims)] = alike @ weight
        sure[own, lo + own], alike[own, lo + own] = False, 0
        count[lo : lo + len(sims)] = found = np.count_nonzero(sure, axis=1)
        unsure = unsure or bool(margin and np.count_nonzero(sims >= threshold - margin) > found.sum() + len(sims))
        few, many = np.nonzero((found > 0) & (found <= degree))[0], np.nonzero(found > degree)[0]
        if len(few):
            r, c = np.nonzero(sure[few])
            edges.append((few[r] + lo, c, alike[few[r], c]))
        if len(many):
            c = np.argpartition(-alike[many], degree - 1, axis=1)[:, :degree].ravel()
            r = np.repeat(many, degree)
            edges.append((r + lo, c, alike[r, c]))
    a, b, w = (np.concatenate(e) for e in zip(*edges)) if edges else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, x.dtype))
    roots = _joined(np.arange(n), a, b)
    # A pair that no list has is one of two rows with more alike rows than a list holds.
    crowded, label = np.nonzero(count > degree)[0], roots.astype(np.int32)
    apart = len(crowded) > 1 and any(((sims >= threshold + margin) & (label[lo : lo + len(sims), None] != label)).any() for lo, sims in blocks())
    while apart:
        best, at = np.zeros(len(crowded), x.dtype), np.zeros(len(crowded), np.int64)
        for lo, sims in blocks():
            rows = np.nonzero((crowded >= lo) & (crowded < lo + len(sims)))[0]
            if len(rows):
                part = sims[np.ix_(crowded[rows] - lo, crowded)]
                out = np.where((part >= threshold + margin) & (roots[crowded[rows]][:, None] != roots[crowded]), part, 0)
                at[rows] = crowded[out.argmax(axis=1)]
                best[rows] = out.max(axis=1)
        order = np.lexsort([at, crowded, -best, roots[crowded]])
        order = order[best[order] > 0]
        if not len(order):
            break
        # Each component's most alike pair with another.
        order = order[np.unique(roots[crowded[order]], return_index=True)[1]]
        a, b, w = np.concatenate([a, crowded[order]]), np.concatenate([b, at[order]]), np.concatenate([w, best[order]])
        roots = _joined(roots, crowded[order], at[order])
    _, first = np.unique(np.maximum(a, b) * n + np.minimum(a, b), return_index=True)
    graph = np.maximum(a, b)[first], np.minimum(a, b)[first], w[first]
    pairs, sims_of, more = [np.zeros((0, 2), np.int64)], [np.zeros(0, x.dtype)], False
    for lo, sims in blocks() if unsure else ():
        r, c = np.nonzero((sims >= threshold - margin) & (sims < threshold + margin))
        more = more or bool(((roots[r + lo] == roots[c]) & (r + lo != c) & (count[r + lo] < degree)).any())
        keep = (c < r + lo) & (roots[r + lo] != roots[c])
        r, c = r[keep], c[keep]
        pairs.append(np.stack([r + lo, c], axis=1))
        sims_of.append(sims[r, c])
        if sum(map(len, pairs)) > HELD_PAIRS:
            few, few_sims, cut = _likeliest(np.concatenate(pairs), np.concatenate(sims_of), roots, limit)
            pairs, sims_of, more = [few], [few_sims], more or cut
    few, _, cut = _likeliest(np.concatenate(pairs), np.concatenate(sims_of), roots, limit)
    return roots, mass, [tuple(p) for p in few.tolist()], more or cut, graph


def local_groups(x: np.ndarray, copies: np.ndarray, threshold: float, margin: float) -> tuple[np.ndarray, np.ndarray, list[tuple[int, int]], bool]:
    """What :func:`local_graph` says of the components, without the graph."""
    return local_graph(x, copies, threshold, margin)[:4]


def _stars(cells: DataFrame, threshold: float, margin: float) -> DataFrame:
    """(cell, a, b, mass, back, sure, more, near, cos): from each cell, each page with the smallest page of what its cell's graph joins
    it to (a, b; also for that page itself), if that is two nodes or more, and undecided pairs. ``mass`` is the alike mass of page a,
    ``near`` and ``cos`` its smaller neighbours in the graph and 10,000 times their cosines; an undecided pair would give page b
    ``back``. ``more``: the cell has undecided pairs beyond these. ``cells`` has a code for each page, or its full vector (``v``), on
    which nothing is undecided."""
    full = "v" in cells.columns

    def group(key: tuple, table: pa.Table) -> pa.Table:
        page = table.column("page_id").to_numpy()
        order = np.argsort(page, kind="stable")
        page = page[order]
        n = table.column("n").to_numpy()[order]
        if full:
            x = table.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, DIM)[order]
            unit = x / np.linalg.norm(x, axis=1, keepdims=True)
        else:
            codes = table.column("code").to_pylist()
            unit = _unit([codes[i] for i in order])
        roots, mass, unsure, more, (hi, lo, cos) = local_graph(unit, n, threshold, 0.0 if full else margin)
        size = np.bincount(roots, minlength=len(roots))
        rows = np.nonzero(size[roots] > 1)[0]
        i, j = (np.array(v, np.int64) for v in zip(*unsure)) if unsure else (np.zeros(0, np.int64),) * 2
        both = len(rows) + len(i)
        ends = np.concatenate([[0], np.cumsum(np.bincount(hi, minlength=len(roots))[rows]), np.full(len(i), len(hi))]).astype(np.int32)
        return pa.table(
            {
                "cell": np.full(both, key[0].as_py(), np.int64),
                "a": np.concatenate([page[rows], page[i]]),
                "b": np.concatenate([page[roots[rows]], page[j]]),
                "mass": np.concatenate([mass[rows], threshold * n[j] + n[i]]),
                "back": np.concatenate([np.zeros(len(rows)), threshold * n[i] + n[j]]),
                "sure": np.concatenate([np.ones(len(rows), bool), np.zeros(len(i), bool)]),
                "more": np.full(both, more),
                "near": pa.ListArray.from_arrays(ends, page[lo]),
                "cos": pa.ListArray.from_arrays(ends, np.rint(cos * 10_000).astype(np.int16)),
            }
        )

    return cells.groupBy("cell").applyInArrow(
        group, "cell long, a long, b long, mass double, back double, sure boolean, more boolean, near array<long>, cos array<short>"
    )


def _full_vectors(vectors: DataFrame, pages: DataFrame) -> DataFrame:
    """(page_id, v): the latest vectors of the pages."""
    need = vectors.select("page_id", "written_at", "page_embeddings").join(pages, "page_id", "left_semi")
    return need.groupBy("page_id").agg(F.max(F.struct("written_at", "page_embeddings"))["page_embeddings"].alias("v"))


def _decide(unsure: DataFrame, vectors: DataFrame, threshold: float) -> DataFrame:
    """The undecided pairs whose full vectors have a cosine of at least ``threshold``."""
    pages = unsure.select(F.col("a").alias("page_id")).unionByName(unsure.select(F.col("b").alias("page_id"))).distinct()
    full = _full_vectors(vectors, pages)
    x = unsure.join(full.select(F.col("page_id").alias("a"), F.col("v").alias("va")), "a").join(full.select(F.col("page_id").alias("b"), F.col("v").alias("vb")), "b")

    def dot(p: str, q: str):
        return F.aggregate(F.zip_with(p, q, lambda s, t: s.cast("double") * t.cast("double")), F.lit(0.0), lambda acc, y: acc + y)

    return x.filter(dot("va", "vb") >= threshold * F.sqrt(dot("va", "va")) * F.sqrt(dot("vb", "vb"))).select(unsure.columns)


def markov_cluster(edges: DataFrame, *, inflation: float = 1.6, keep: int = 40, least: float = 1e-3, max_rounds: int = 12, still: float = 1e-3) -> DataFrame:
    """(node, attractor, flow) of the weighted graph ``edges`` (a, b, w; each pair once, a != b): a node with flow to several
    attractors has a row for each. Where ``edges`` has a ``block``, rows also have their node's ``cluster``, as in :func:`_by_joins`.

    The matrix is kept as (column j, row i, value). A round squares it, raises it to ``inflation``, drops entries under ``least`` and
    all but the ``keep`` largest of a column, and normalises: a column never has more than ``keep`` entries, so the work of a round is
    in proportion to the number of nodes. Nodes that no path joins exchange no flow: where ``edges`` has a ``block`` of each pair, which
    joined pairs share, or else the component, blocks of at most :data:`BLOCK_EDGES` edges meet in tasks, each until it stands still.
    """
    how = {"inflation": inflation, "keep": keep, "least": least, "max_rounds": max_rounds, "still": still}
    given = "block" in edges.columns
    if not given:
        edges = edges.join(connected_components(edges).select(F.col("node").alias("a"), F.col("root").alias("block")), "a")
    edges = edges.select("a", "b", F.col("w").cast("double").alias("w"), "block")
    if not given:
        edges = materialize(edges, "graph")
    sizes = edges.groupBy("block").agg(F.count(F.lit(1)).alias("m"))
    every, most = sizes.agg(F.coalesce(F.sum("m"), F.lit(0)), F.coalesce(F.max("m"), F.lit(0))).first()
    parts = max(edges.sparkSession.sparkContext.defaultParallelism, every // TASK_EDGES)

    def cluster(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if held := [x for x in batches if x.num_rows]:
            t = pa.Table.from_batches(held)
            block, a, b, w = (t.column(c).to_numpy() for c in ("block", "a", "b", "w"))
            node, attractor, flow = block_flow(block, a, b, w, **how)
            out = {"node": node, "attractor": attractor, "flow": flow} | ({"cluster": _in_memory(a, b, node, attractor, flow)} if given else {})
            yield from pa.table(out).to_batches(max_chunksize=1 << 16)

    schema = "node long, attractor long, flow double" + ", cluster long" * given
    small = edges
    if most > BLOCK_EDGES:
        large = materialize(sizes.filter(F.col("m") > BLOCK_EDGES).select("block"), "large")
        small, rest = edges.join(large, "block", "left_anti"), edges.join(large, "block", "left_semi")
    flow = small.repartition(parts, "block").mapInArrow(cluster, schema)
    if most <= BLOCK_EDGES:
        return flow
    squared = _squared_by_joins(rest, **how)
    return flow.unionByName(_by_joins(squared, rest) if given else squared)


def _squared_by_joins(edges: DataFrame, *, inflation: float, keep: int, least: float, max_rounds: int, still: float) -> DataFrame:
    """:func:`markov_cluster` of blocks of any size: a round squares the matrix as a join of the columns' entries with the columns they
    name, and a sum."""
    both = edges.select(F.col("a").alias("j"), F.col("b").alias("i"), "w").unionByName(edges.select(F.col("b").alias("j"), F.col("a").alias("i"), "w"))
    loops = both.groupBy("j").agg(F.max("w").alias("w")).select("j", F.col("j").alias("i"), "w")

    def settle(m: DataFrame, power: float) -> DataFrame:
        col = Window.partitionBy("j")
        x = m.withColumn("w", F.pow("w", F.lit(power)))
        x = x.withColumn("w", F.col("w") / F.sum("w").over(col)).withColumn("rank", F.row_number().over(col.orderBy(F.desc("w"), "i")))
        x = x.filter((F.col("rank") == 1) | ((F.col("rank") <= keep) & (F.col("w") >= least))).drop("rank")
        return x.withColumn("w", F.col("w") / F.sum("w").over(col))

    m = materialize(settle(both.unionByName(loops), 1.0), "flow")
    for _ in range(max_rounds):
        step = m.select("j", F.col("i").alias("k"), F.col("w").alias("u")).join(m.select(F.col("j").alias("k"), "i", "w"), "k")
        squared = step.groupBy("j", "i").agg(F.sum(F.col("u") * F.col("w")).alias("w"))
        nxt = materialize(settle(squared, inflation), "flow")
        # A column that stands still has equal entries: its largest entry is the sum of its squares.
        chaos = nxt.groupBy("j").agg((F.max("w") - F.sum(F.col("w") * F.col("w"))).alias("c")).agg(F.max("c")).first()[0]
        drop_materialized(m)
        m = nxt
        if chaos is None or chaos < still:
            break
    return m.select(F.col("j").alias("node"), F.col("i").alias("attractor"), F.col("w").alias("flow"))


def _in_memory(a: np.ndarray, b: np.ndarray, node: np.ndarray, attractor: np.ndarray, flow: np.ndarray) -> np.ndarray:
    """The cluster of each row of the flow of whole blocks, a node's rows together, as in :func:`_by_joins`."""
    first = np.nonzero(np.concatenate([[True], node[1:] != node[:-1]]))[0]
    times = np.diff(np.append(first, len(node)))
    flow = np.round(flow, 6)
    greatest = flow == np.repeat(np.maximum.reduceat(flow, first), times)
    home = np.minimum.reduceat(np.where(greatest, attractor, np.iinfo(np.int64).max), first)
    # Pages are numbered in their order, so that the smallest number of a cluster is its smallest page.
    page, order = node[first], np.argsort(node[first])
    named = page[order]
    home = np.searchsorted(named, home[order])
    a, b = home[np.searchsorted(named, a)], home[np.searchsorted(named, b)]
    root = _joined(np.arange(len(named)), a[a != b], b[a != b])[home]
    least = np.full(len(named), len(named))
    np.minimum.at(least, root, np.arange(len(named)))
    cluster = np.empty(len(named), np.int64)
    cluster[order] = named[least[root]]
    return np.repeat(cluster, times)


def _by_joins(flow: DataFrame, graph: DataFrame) -> DataFrame:
    """``flow`` with the ``cluster`` of its nodes, the cluster's smallest page.

    Markov clustering gives each page the attractor of its greatest flow; attractors whose pages an edge links are joined. Flow never
    leaves what edges join, so nothing else is joined.
    """
    flow = materialize(flow.select("node", "attractor", "flow"), "flow")
    own = flow.groupBy("node").agg(F.max(F.struct(F.round("flow", 6).alias("flow"), (-F.col("attractor")).alias("no")))["no"].alias("no")).select("node", (-F.col("no")).alias("home"))
    own = materialize(own, "homes")
    ends = graph.select("a", "b").join(own.select(F.col("node").alias("a"), F.col("home").alias("ha")), "a").join(own.select(F.col("node").alias("b"), F.col("home").alias("hb")), "b")
    comp = connected_components(ends.filter("ha != hb").select("ha", "hb").distinct(), "ha", "hb")
    placed = own.join(comp.select(F.col("node").alias("home"), "root"), "home", "left").select("node", F.coalesce("root", "home").alias("root"))
    placed = materialize(placed, "homes")
    return flow.join(placed.join(placed.groupBy("root").agg(F.min("node").alias("cluster")), "root").select("node", "cluster"), "node")


def similarity_clusters(vectors: DataFrame, *, threshold: float = 0.8, probes: int = 4, cell_size: int = 512, max_pivots: int = MAX_PIVOTS) -> DataFrame:
    """(page_id, cluster, strength): every page of a group of two or more, the group's smallest page, and the page's alike mass as
    far as its flow ends at the group's main attractor.

    ``vectors``: page_id, written_at, page_embeddings. Pages in no group have no row; neither have pages without a usable vector in
    their latest row. Equal and repeated rows count once, an empty table gives no rows, other columns are ignored.
    ``probes`` and ``cell_size`` set recall against work: recall against brute force is measured in the tests.
    """
    codes = materialize(page_codes(vectors), "codes")
    # Equal codes collapse: map-side the aggregate keeps one state for each code.
    nodes = materialize(codes.groupBy("code").agg(F.min("page_id").alias("page_id"), F.count(F.lit(1)).alias("n")), "nodes")
    n = nodes.count()
    if not n:
        return vectors.sparkSession.createDataFrame([], "page_id long, cluster long, strength double")
    # Pivots by hash threshold: what the tasks send is about as many codes in all, at most max_pivots and chance deviation.
    wanted = max(64, min(max_pivots, n * probes // cell_size))
    below = F.pmod(F.xxhash64("page_id"), F.lit(1 << 30)) < F.lit(min(1 << 30, -(-(wanted << 30) // n)))
    pivots = sorted(bytes(r["code"]) for r in nodes.filter(below).select("code").collect())
    cells, size, level = _cells(nodes, pivots, probes), n * probes / max(1, len(pivots)), 0
    while size > 2 * cell_size:
        # Each page goes on in the two nearest of its cell's new cells.
        level += 1
        before = materialize(cells, "cells")
        cells = materialize(_split_cells(before, size, cell_size, 2, level), "cells")
        size *= 2 * max(cell_size / size, 1 / CELL_PIVOTS)
        drop_materialized(before)
    stars = materialize(_stars(cells, threshold, CODE_ERROR), "stars")
    crowded = stars.filter("more").select("cell").distinct()
    if crowded.limit(1).count():
        again = cells.join(crowded, "cell", "left_semi").select("cell", "page_id", "n")
        exact = _stars(again.join(_full_vectors(vectors, again.select("page_id").distinct()), "page_id"), threshold, 0.0)
        stars = materialize(stars.filter("not more").unionByName(exact), "stars")
    unsure = stars.filter("not sure").select("a", "b", "mass", "back").distinct()
    links, near = stars.filter("sure").select("a", "b", "mass"), None
    if unsure.limit(1).count():
        near = materialize(_decide(unsure, vectors, threshold), "near")
        links = links.unionByName(near.select("a", "b", "mass")).unionByName(near.select(F.col("b").alias("a"), "b", F.col("back").alias("mass")))
    # Two stars overlap where a page is in both; what overlaps is a block of the pages' matrix.
    tops = links.groupBy("a").agg(F.collect_set("b").alias("bs"), F.max("mass").alias("mass"))
    tops = materialize(tops.select(F.col("a").alias("page"), "bs", "mass"), "tops")
    overlap = tops.filter(F.size("bs") > 1).select(F.array_min("bs").alias("a"), F.explode("bs").alias("b")).filter("a != b").distinct()
    block = connected_components(overlap).select(F.col("node").alias("star"), F.col("root").alias("block"))
    pages = tops.select("page", "mass", F.array_min("bs").alias("star")).join(block, "star", "left")
    pages = materialize(pages.select("page", "mass", F.coalesce("block", "star").alias("block")), "pages")
    lists = stars.filter("sure").filter(F.size("near") > 0).select("a", "near", "cos")
    if near is not None:
        lists = lists.unionByName(near.select("a", F.array("b").alias("near"), F.array(F.lit(round(threshold * 10_000)).cast("short")).alias("cos")))
    # Lists of a page meet before they are taken apart, so that its pairs are put together where they are.
    found = lists.join(pages.select(F.col("page").alias("a"), "block"), "a").select("block", "a", "cos", F.posexplode("near").alias("i", "b"))
    graph = found.groupBy("a", "b").agg((F.max(F.get("cos", "i")) / 10_000.0).alias("w"), F.min("block").alias("block"))
    graph = materialize(graph, "graph")
    flow = markov_cluster(graph)
    if "cluster" not in flow.columns:
        flow = _by_joins(flow, graph)
    moved = flow.select(F.col("node").alias("page"), "cluster", "attractor", F.round("flow", 6).alias("flow")).join(pages.select("page", "mass"), "page")
    moved = materialize(moved.select("page", "cluster", "attractor", (F.col("flow") * F.col("mass")).alias("sent")), "moved")
    got = moved.groupBy("cluster", "attractor").agg(F.sum("sent").alias("got"))
    main = got.groupBy("cluster").agg(F.max(F.struct(F.round("got", 6).alias("got"), (-F.col("attractor")).alias("no")))["no"].alias("no")).select("cluster", (-F.col("no")).alias("main"))
    # The main attractor's flow is one row of a page at most.
    sent = F.when(F.col("attractor") == F.col("main"), F.col("sent")).otherwise(0.0)
    placed = moved.join(main, "cluster").groupBy(F.col("page").alias("page_id")).agg(F.min("cluster").alias("cluster"), F.max(sent).alias("strength"))
    placed = materialize(placed, "placed")
    # A code of several pages is a group by itself, and its pages go where its node goes; all other nodes are their one page. Every
    # cluster is named by its smallest page, as nodes are.
    shared = nodes.filter("n > 1")
    at = shared.join(placed, "page_id", "left").select("code", F.coalesce("cluster", "page_id").alias("cluster"), F.coalesce("strength", F.col("n").cast("double")).alias("strength"))
    copies = codes.join(at, "code").select("page_id", "cluster", "strength")
    return placed.join(shared.select("page_id"), "page_id", "left_anti").unionByName(copies)


def cluster_pairs(clusters: DataFrame) -> DataFrame:
    """(page_a, page_b): each page of a group with the group's smallest page, that page itself left out."""
    return clusters.filter("page_id != cluster").select(F.col("cluster").alias("page_a"), F.col("page_id").alias("page_b"))


def describe_clusters(clusters: DataFrame, *, members: int = 3) -> DataFrame:
    """(cluster, size, typical): each group's size and its ``members`` pages of the strongest flow (ties: smaller page first).

    Only the strongest of each cluster and salt come together, so a group with a third of all pages needs no sort in one task."""
    order = [F.desc(F.round("strength", 6)), F.col("page_id")]
    salted = Window.partitionBy("cluster", F.pmod(F.xxhash64("page_id"), F.lit(64))).orderBy(*order)
    few = clusters.withColumn("rn", F.row_number().over(salted)).filter(F.col("rn") <= members)
    best = F.struct((-F.round("strength", 6)).alias("s"), F.col("page_id").alias("p"))
    top = few.groupBy("cluster").agg(F.transform(F.slice(F.sort_array(F.collect_list(best)), 1, members), lambda x: x["p"]).alias("typical"))
    return clusters.groupBy("cluster").agg(F.count(F.lit(1)).alias("size")).join(top, "cluster").select("cluster", "size", "typical")
