"""Filling fixed-capacity containers: minimum bin slack with bitset subset sums.

Items are spread over groups of about ``group_items`` by hash, so no group grows with the table; each group is packed by itself.
A container starts with the longest item left; a bitset dynamic program over the lengths still available then finds the fullest
feasible combination for the rest of its room, which is removed. Groups leave one container partly filled each.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def fullest(counts: dict[int, int], lengths: list[int], room: int) -> list[int]:
    """Lengths (each at most as often as ``counts`` has it) whose sum is the greatest up to ``room``; ``lengths``: descending."""
    reach, mask, steps = 1, (1 << (room + 1)) - 1, []
    for size in lengths:
        if size > room:
            continue
        for _ in range(min(counts[size], room // size)):
            grown = (reach | reach << size) & mask
            if grown == reach:
                break
            steps.append((size, reach))
            reach = grown
            if reach >> room:
                break
        if reach >> room:
            break
    at, chosen = reach.bit_length() - 1, []
    for size, before in reversed(steps):
        if not before >> at & 1:
            chosen.append(size)
            at -= size
    return chosen


def pack_sizes(sizes: list[int], capacity: int) -> list[list[int]]:
    """Containers as lists of positions in ``sizes`` (each 1..capacity), by minimum bin slack."""
    held: dict[int, list[int]] = {}
    for i, s in enumerate(sizes):
        held.setdefault(s, []).append(i)
    counts = {s: len(v) for s, v in held.items()}
    lengths = sorted(counts, reverse=True)
    out = []
    while lengths:
        first = lengths[0]
        counts[first] -= 1
        chosen = [first]
        for s in fullest(counts, lengths, capacity - first):
            counts[s] -= 1
            chosen.append(s)
        out.append([held[s].pop() for s in chosen])
        if any(not counts[s] for s in chosen):
            lengths = [s for s in lengths if counts[s]]
    return out


def pack(items: DataFrame, kinds: DataFrame, *, group_items: int = 8_000) -> DataFrame:
    """(container_kind, container_id, doc_id, part, token_start, n_tokens): every text of ``items`` (doc_id, n_tokens) placed once in
    containers of every kind (``kinds``: container_kind, capacity_tokens).

    A text longer than the capacity is cut into full containers and a rest that is packed like a text; ``part`` counts from 1.
    Texts of no tokens (null, empty) need no room and have no row; a kind without a positive capacity has none either. Equal sizes are
    placed by doc_id.
    """
    real = items.filter("doc_id is not null and n_tokens > 0").select("doc_id", "n_tokens")
    caps = kinds.select("container_kind", F.col("capacity_tokens").cast("long").alias("capacity")).filter("capacity > 0").distinct()
    caps = [(r["container_kind"], r["capacity"]) for r in caps.collect()]  # the fixed table of kinds
    groups = max(1, -(-real.count() // group_items))
    kind = F.explode(F.array(*[F.struct(F.lit(k).alias("container_kind"), F.lit(c).alias("capacity")) for k, c in caps])) if caps else None
    if kind is None:
        return real.sparkSession.createDataFrame([], "container_kind string, container_id string, doc_id long, part int, token_start long, n_tokens long")
    placed = real.withColumn("grp", F.pmod(F.xxhash64("doc_id"), F.lit(groups)).cast("int")).withColumn("k", kind).select("doc_id", "n_tokens", "grp", "k.*")
    schema = "container_kind string, container_id string, doc_id long, part int, token_start long, n_tokens long"

    def fill(pdf: pd.DataFrame) -> pd.DataFrame:
        name, cap, grp = pdf["container_kind"].iloc[0], int(pdf["capacity"].iloc[0]), int(pdf["grp"].iloc[0])
        pdf = pdf.sort_values("doc_id", kind="stable")
        doc, size = pdf["doc_id"].to_numpy(np.int64), pdf["n_tokens"].to_numpy(np.int64)
        whole, rest = size // cap, size % cap
        rows: list[tuple] = []
        n = 0
        for d, w in zip(doc[whole > 0], whole[whole > 0]):
            for part in range(int(w)):
                rows.append((name, f"{name}-{grp}-{n}", d, part + 1, part * cap, cap))
                n += 1
        keep = np.nonzero(rest)[0][::-1]  # popped from the end: smaller doc_id first
        for box in pack_sizes(rest[keep].tolist(), cap):
            for i in box:
                j = keep[i]
                rows.append((name, f"{name}-{grp}-{n}", doc[j], int(whole[j]) + 1, int(whole[j]) * cap, int(rest[j])))
            n += 1
        return pd.DataFrame(rows, columns=["container_kind", "container_id", "doc_id", "part", "token_start", "n_tokens"])

    return placed.groupBy("container_kind", "capacity", "grp").applyInPandas(fill, schema)


def fill_report(packed: DataFrame, kinds: DataFrame) -> DataFrame:
    """Per kind: texts, containers, the least number of containers possible, tokens and the share of the room that is used."""
    each = packed.groupBy("container_kind").agg(
        F.countDistinct("doc_id").alias("n_texts"), F.countDistinct("container_id").alias("n_containers"), F.sum("n_tokens").alias("n_tokens")
    )
    cap = F.col("capacity_tokens")
    return each.join(F.broadcast(kinds.select("container_kind", "capacity_tokens")), "container_kind").select(
        "container_kind", "n_texts", "n_containers", F.ceil(F.col("n_tokens") / cap).alias("least_containers"), "n_tokens",
        F.round(F.col("n_tokens") / (F.col("n_containers") * cap), 6).alias("fill"),
    )
