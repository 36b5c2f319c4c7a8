"""Exact and near duplicates."""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def exact_groups(df: DataFrame, *, ident: str, content: Column) -> DataFrame:
    """(ident, digest, canonical, n): rows of equal content with the least id of their group. The hash meets, never the content; a null
    content is in no group. A group with a third of all rows is one state in the aggregate, joined back by digest."""
    d = df.select(ident, F.md5(content.cast("binary")).alias("digest")).filter("digest is not null")
    g = d.groupBy("digest").agg(F.min(ident).alias("canonical"), F.count(F.lit(1)).alias("n"))
    return d.join(g, "digest").select(ident, "digest", "canonical", "n")


def keep_first(df: DataFrame, keys: list[str], order: list[Column]) -> tuple[DataFrame, DataFrame]:
    """(kept, dropped): the first row of each key and the rest, for an audit."""
    marked = df.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return marked.filter("_rn = 1").drop("_rn"), marked.filter("_rn > 1").drop("_rn")


def suffix_repeats(df: DataFrame, *, key: str, content: Column, length: int = 8) -> DataFrame:
    """``unique_key``: the key, with a short digest of the content where several rows have it."""
    n = F.count(F.lit(1)).over(Window.partitionBy(key))
    return df.withColumn("unique_key", F.when(n > 1, F.concat(F.col(key), F.lit("_"), F.substring(F.sha1(content.cast("binary")), 1, length))).otherwise(F.col(key)))


def offenders(df: DataFrame, keys: list[str], *, tolerance: int, order: list[Column], samples: int = 10) -> DataFrame:
    """Keys in more than ``tolerance`` rows: their count and the first sample rows, numbered."""
    w = Window.partitionBy(*keys)
    return df.withColumn("n", F.count(F.lit(1)).over(w)).filter(F.col("n") > tolerance).withColumn("sample", F.row_number().over(w.orderBy(*order))).filter(F.col("sample") <= samples)


class TooManyRepeats(RuntimeError):
    """More rows share a key than the caller tolerates."""


def require_unique(df: DataFrame, keys: list[str], *, tolerance: int = 0) -> DataFrame:
    """``df``, or an error if keys of more than one row number above ``tolerance``."""
    n = df.groupBy(*keys).count().filter("count > 1").count()
    if n > tolerance:
        raise TooManyRepeats(f"{n} keys of {', '.join(keys)} have several rows; {tolerance} are tolerated")
    return df


def simhash(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """64-bit similarity hashes of the words of ``text``."""
    import numpy as np
    import xxhash

    known: dict[str, np.ndarray] = {}
    for pdf in batches:
        out = []
        for text in pdf["text"]:
            total = np.zeros(64, np.int64)
            for w in (text or "").lower().split():
                bits = known.get(w)
                if bits is None:
                    if len(known) > 200_000:
                        known.clear()
                    raw = np.frombuffer(xxhash.xxh64(w.encode()).digest(), np.uint8)
                    bits = known[w] = np.unpackbits(raw).astype(np.int64) * 2 - 1
                total += bits
            out.append(int.from_bytes(np.packbits(total > 0).tobytes(), "big", signed=True))
        yield pd.DataFrame({"id": pdf["id"], "hash": out})


def block_count(n: int, *, distance: int = 6) -> int:
    """The number of blocks that ``n`` distinct 64-bit hashes are best cut into: least rows and expected pairs together."""

    def work(blocks: int) -> float:
        choices = math.comb(blocks, blocks - distance)
        return choices * (n + n * n / 2.0 ** (64 * (blocks - distance) / blocks))

    return min(range(distance + 1, 2 * distance + 3), key=work)


#: Values of a part of :func:`value_links` at most on average, parts that a table is cut into for the sake of the cores, and pairs that a task looks at at once.
PART_VALUES, PARTS, PAIRS_AT_ONCE = 250_000, 12, 1 << 21


def _near(x, y, own: bool, blocks: int, distance: int):
    """Positions (i, j) of values of ``x`` and ``y`` at most ``distance`` bits apart and their distances, by and by, each pair once;
    ``own``: ``y`` is ``x``, and only i < j is given."""
    import numpy as np

    agree = max(1, blocks - distance)
    cuts = [64 * i // blocks for i in range(blocks + 1)]
    masks = [np.uint64(((1 << (hi - lo)) - 1) << lo) for lo, hi in zip(cuts, cuts[1:])]
    for choice in itertools.combinations(range(blocks), agree):
        mask = np.uint64(sum(int(masks[i]) for i in choice))
        kx, ky = x & mask, y & mask
        order = np.argsort(ky)
        ky = ky[order]
        rows = np.argsort(kx)
        lo, hi = np.searchsorted(ky, kx[rows], "left"), np.searchsorted(ky, kx[rows], "right")
        rows, lo, n = rows[hi > lo], lo[hi > lo], (hi - lo)[hi > lo]
        upto = np.cumsum(n)
        at = 0
        while at < len(rows):
            end = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + PAIRS_AT_ONCE, "right")))
            m = n[at:end]
            i = np.repeat(rows[at:end], m)
            j = order[np.arange(m.sum()) + np.repeat(lo[at:end] - (np.cumsum(m) - m), m)]
            at = end
            apart = x[i] ^ y[j]
            d = np.bitwise_count(apart)
            keep = np.nonzero(d <= distance)[0]
            if own:
                keep = keep[i[keep] < j[keep]]
            for b in set(range(choice[-1])) - set(choice):  # else an earlier choice has the pair
                keep = keep[(apart[keep] & masks[b]) != 0]
            if len(keep):
                yield i[keep], j[keep], d[keep]


def value_links(values: DataFrame, *, distance: int = 6, blocks: int | None = None) -> DataFrame:
    """(a, b, id_a, id_b, n_a, n_b, distance), a < b: the rows of ``values`` (hash, id, n; each hash once) whose hashes are at most
    ``distance`` bits apart, with what belongs to either.

    Values are cut into parts by hash, and each two parts meet in a task, which makes the pairs and hands them on: a value is sent once
    for each part, pairs are neither shuffled nor joined, and no task holds more than two parts. In a task the 64 bits are cut into
    ``blocks``; near values agree in at least ``blocks - distance`` of them whole, so values meet on each choice of that many
    blocks, what meets is checked exactly, and a pair counts under the first choice it agrees in. Unless given, the number of blocks comes from
    the count of values (:func:`block_count`) and changes no result.
    """
    n = values.count()
    parts = max(min(PARTS, -(-n // 4096)), -(-n // PART_VALUES), 1)
    cut = block_count(-(-n // parts), distance=distance) if blocks is None else blocks
    part = F.pmod(F.xxhash64("hash"), F.lit(parts)).cast("int")
    sent = values.select("hash", "id", "n", part.alias("p")).withColumn("q", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    sent = sent.select(F.least("p", "q").alias("p"), F.greatest("p", "q").alias("q"), (F.col("p") <= F.col("q")).alias("left"), "hash", "id", "n")
    kind = values.schema["id"].dataType.simpleString()

    def meet(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        t = pa.Table.from_batches(batches)
        own, left = key[0].as_py() == key[1].as_py(), t.column("left")
        x = t.filter(left)
        y = x if own else t.filter(pc.invert(left))
        hx, hy = (v.column("hash").to_numpy() for v in (x, y))
        for i, j, d in _near(hx.view(np.uint64), hy.view(np.uint64), own, cut, distance):
            swap = hx[i] > hy[j]
            a, b = x.take(pa.array(i)), y.take(pa.array(j))
            least = lambda c, first: pc.if_else(pa.array(swap == first), b.column(c), a.column(c))  # noqa: B023, E731
            yield from pa.table(
                [least("hash", True), least("hash", False), least("id", True), least("id", False), least("n", True), least("n", False), pa.array(d.astype(np.int32))],
                names=["a", "b", "id_a", "id_b", "n_a", "n_b", "distance"],
            ).combine_chunks().to_batches()

    return sent.repartition(parts * (parts + 1) // 2, "p", "q").groupBy("p", "q").applyInArrow(meet, f"a long, b long, id_a {kind}, id_b {kind}, n_a long, n_b long, distance int")


def hash_values(hashes: DataFrame) -> DataFrame:
    """(hash, id, n): each hash value once, with the least id of its rows and their number."""
    return hashes.groupBy("hash").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("n"))


def hash_links(hashes: DataFrame, *, distance: int = 6, blocks: int | None = None) -> DataFrame:
    """(a, b, distance), a < b: distinct hash values at most ``distance`` bits apart (:func:`value_links`). Equal hashes are one value, so
    copies form no pairs."""
    values = hashes.select("hash").filter("hash is not null").distinct().select("hash", F.lit(0).cast("long").alias("id"), F.lit(1).cast("long").alias("n"))
    return value_links(values, distance=distance, blocks=blocks).select("a", "b", "distance")


def split_hash(df: DataFrame, *, key: str, parts: int) -> DataFrame:
    """``part``: Adler-32 of the key modulo ``parts``, the same on every engine that has this checksum."""

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import zlib

        for pdf in batches:
            yield pdf.assign(part=[None if k is None else zlib.adler32(str(k).encode()) % parts for k in pdf[key]])

    kind = df.schema[key].dataType.simpleString()
    mapped = df.select(key).distinct().mapInPandas(add, f"{key} {kind}, part int")
    return df.join(mapped, key, "left")


def ranked_split(keys: DataFrame, *, key: str, shares: list[tuple[str, float]], seed: int = 42) -> DataFrame:
    """(key, split): keys in the order of their MD5 with the seed, cut at whole numbers; the last share takes the rest."""
    h = F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")).cast("binary"))
    own = keys.select(key).distinct().withColumn("h", h).withColumn("b", F.substring("h", 1, 3))
    # The order is (bucket, hash, key): ranks start from each bucket's offset, so no task ranks all keys.
    sizes = own.groupBy("b").agg(F.count(F.lit(1)).alias("c"))
    every = Window.partitionBy(F.lit(0))  # at most 4,096 rows
    offsets = sizes.withColumn("before", F.sum("c").over(every.orderBy("b")) - F.col("c")).withColumn("n", F.sum("c").over(every))
    ranked = own.join(offsets, "b").withColumn("rn", F.col("before") + F.row_number().over(Window.partitionBy("b").orderBy("h", key)))
    split, upto = F.lit(shares[-1][0]), 0.0
    cuts = []
    for name, share in shares[:-1]:
        cuts.append((name, upto, upto + share))
        upto += share
    for name, _, hi in reversed(cuts):
        split = F.when(F.col("rn") <= F.floor(F.col("n") * hi), name).otherwise(split)
    return ranked.select(key, split.alias("split"))


#: Links between undecided values that :func:`leader_clusters` leaves to one task.
LAST_LINKS = 1_000_000


def _first_leaders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node) of the leaders among the nodes of all rows (node, smaller), in order of the nodes."""
    import numpy as np

    t = pa.Table.from_batches(batches, pa.schema([("node", pa.int64()), ("smaller", pa.int64())]))
    node, smaller = (t.column(c).to_numpy() for c in ("node", "smaller"))
    order = np.argsort(node, kind="stable")
    node, smaller = node[order], smaller[order]
    names, at = np.unique(node, return_index=True)
    # A smaller node that has no row itself leads.
    pos = np.searchsorted(names, smaller)
    known = (pos < len(names)) & (names[np.minimum(pos, len(names) - 1)] == smaller) if len(names) else np.zeros(0, bool)
    pos = np.where(known, pos, len(names))
    leads = np.zeros(len(names) + 1, bool)
    leads[len(names)] = True
    for k, (lo, hi) in enumerate(zip(at, np.append(at[1:], len(node)))):
        leads[k] = not leads[pos[lo:hi]].any()
    yield pa.record_batch([pa.array(names[leads[:-1]])], names=["node"])


def leader_clusters(hashes: DataFrame, links: DataFrame) -> DataFrame:
    """(id, leader, n_links) for every row of ``hashes`` (id, hash): greedy leader clustering in order of id, without going through the
    rows one by one. ``links``: pairs of near hash values (a, b), or with their least ids too, each once (:func:`value_links`).

    Rows of one hash are one node with the least of their ids; it joins the first leader it is linked to, or leads. In a round all nodes
    without an undecided smaller neighbour lead, and what is linked to them does not; both are done with, and so are their links. When
    few links are left (:data:`LAST_LINKS`) one task goes through them in order. The result is that of the row-by-row pass.
    ``n_links`` counts the other hash values linked to the row's own.
    """
    from foliolake.runtime import drop_materialized, materialize

    nodes = materialize(hash_values(hashes).select("hash", F.col("id").alias("node")), "nodes")
    if "id_a" not in links.columns:
        a, b = nodes.select(F.col("hash").alias("a"), F.col("node").alias("id_a")), nodes.select(F.col("hash").alias("b"), F.col("node").alias("id_b"))
        links = links.select("a", "b").distinct().join(a, "a").join(b, "b")
    down = materialize(links.select(F.greatest("id_a", "id_b").alias("node"), F.least("id_a", "id_b").alias("smaller")), "down")
    left, leaders, held = down, nodes.select("node").join(down.select("node").distinct(), "node", "left_anti"), None
    leaders = materialize(leaders, "leaders")
    new = leaders
    while True:
        # Of the links, those remain whose nodes are both undecided: neither lead nor are linked to a leader.
        out = materialize(left.join(new.select(F.col("node").alias("smaller")), "smaller", "left_semi").select("node").distinct(), "out")
        rest = materialize(left.join(out, "node", "left_anti").join(out.select(F.col("node").alias("smaller")), "smaller", "left_anti").select("node", "smaller"), "down")
        # Undecided nodes that lost all their smaller neighbours lead, whether or not any link to them remains.
        lost = left.select("node").distinct().join(out, "node", "left_anti").join(rest.select("node").distinct(), "node", "left_anti")
        n = rest.count()
        if n <= LAST_LINKS:
            last = rest.coalesce(1).mapInArrow(_first_leaders, "node long") if n else lost.limit(0)
            done = materialize(leaders.unionByName(lost).unionByName(last), "leaders")
            break
        new = materialize(lost, "new")
        grown = materialize(leaders.unionByName(new), "leaders")
        drop_materialized(leaders)
        drop_materialized(out)
        if held is not None:
            drop_materialized(held)
        left, leaders, held = rest, grown, rest
    first = down.join(done.select(F.col("node").alias("smaller")), "smaller", "left_semi").groupBy("node").agg(F.min("smaller").alias("leader"))
    n = down.select("node").unionByName(down.select(F.col("smaller").alias("node"))).groupBy("node").agg(F.count(F.lit(1)).alias("n_links"))
    whole = nodes.join(n, "node", "left").join(first, "node", "left")
    return hashes.join(whole, "hash").select("id", F.coalesce("leader", "node").alias("leader"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
