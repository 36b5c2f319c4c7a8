"""Mixing sources to target weights by hash-threshold histograms.

Tokens are summed by source and hash bucket; each source's budget becomes a number of whole uses of all its texts and a nested
hash threshold for one use more (:mod:`.thresholds`); the texts are then filtered, never sorted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliolake.llm.thresholds import take_by_hash


def source_name(source: Column) -> Column:
    """A source however it is written: without case, outer blanks and the kind of dash."""
    return F.regexp_replace(F.lower(F.trim(source)), r"[\s-]+", "_")


def budgets(available: dict[str, float], targets: dict[str, tuple[float, int]], total: float) -> dict[str, float]:
    """Tokens to take from each source so that they sum to ``total`` in the target proportions. A source that can't fill its share
    even when repeated as often as it may gives all it can, and the others share what is missing in their own proportions."""
    cap = {s: available.get(s, 0.0) * max(0, r) for s, (_, r) in targets.items()}
    out: dict[str, float] = {}
    free = {s for s in targets if targets[s][0] > 0}
    left = min(total, sum(cap[s] for s in free))
    while free:
        weight = sum(targets[s][0] for s in free)
        short = {s for s in free if cap[s] < left * targets[s][0] / weight}
        if not short:
            out |= {s: left * targets[s][0] / weight for s in free}
            break
        for s in short:
            out[s] = cap[s]
        left -= sum(cap[s] for s in short)
        free -= short
    return out


def mix(sizes: DataFrame, targets: DataFrame, *, total_tokens: float | None = None) -> DataFrame:
    """(doc_id, source, n_tokens, uses) of every text used at least once.

    ``sizes``: doc_id (unique), source, n_tokens. ``targets``: source, target_share, max_repeats: a fixed table of a few rows; null
    shares and repeats count as 0. ``total_tokens``: size of the mixture, by default all tokens of the sources with a target.
    Texts whose source is null or has no target, and texts of no tokens, are never used.
    """
    want = {}
    for r in targets.select(source_name(F.col("source")).alias("s"), "target_share", "max_repeats").collect():
        if r["s"] is not None:
            want[r["s"]] = (float(r["target_share"] or 0), int(r["max_repeats"] or 0))
    own = sizes.select("doc_id", source_name(F.col("source")).alias("source"), "n_tokens").filter(F.col("source").isin(list(want)) & (F.col("n_tokens") > 0))
    have = {r["source"]: float(r["n"]) for r in own.groupBy("source").agg(F.sum("n_tokens").alias("n")).collect()}
    take = budgets(have, want, sum(have.values()) if total_tokens is None else total_tokens)
    whole = {s: min(want[s][1], int(b // have[s])) for s, b in take.items() if have.get(s)}
    rest = {s: take[s] - n * have[s] for s, n in whole.items() if n < want[s][1]}
    base = F.lit(0)
    for s, n in whole.items():
        base = F.when(F.col("source") == s, n).otherwise(base)
    marked = take_by_hash(own, rest, key="source", ident="doc_id", weight="n_tokens")
    return marked.select("doc_id", "source", "n_tokens", (base + F.col("taken").cast("int")).alias("uses")).filter("uses > 0")


def reached_shares(mixed: DataFrame, sizes: DataFrame, targets: DataFrame) -> DataFrame:
    """Per target: its share, the tokens there are and were taken, the share actually reached, the most uses of one text, and whether
    the target was met within half a percent of the mixture."""
    have = sizes.select(source_name(F.col("source")).alias("source"), "n_tokens").groupBy("source").agg(F.sum("n_tokens").alias("available_tokens"))
    got = mixed.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("uses")).alias("taken_tokens"), F.max("uses").alias("most_uses"))
    want = targets.select(source_name(F.col("source")).alias("source"), "target_share", "max_repeats")
    all_taken = got.agg(F.sum("taken_tokens").alias("all_taken"))
    out = F.broadcast(want).join(have, "source", "left").join(got, "source", "left").crossJoin(F.broadcast(all_taken))  # one row
    share = F.coalesce(F.col("taken_tokens") / F.col("all_taken"), F.lit(0.0))
    return out.select(
        "source", "target_share", "max_repeats", F.coalesce("available_tokens", F.lit(0)).alias("available_tokens"),
        F.coalesce("taken_tokens", F.lit(0)).alias("taken_tokens"), F.round(share, 6).alias("actual_share"),
        F.coalesce("most_uses", F.lit(0)).alias("most_uses"), (F.abs(share - F.col("target_share")) <= 0.005).alias("met"),
    )
