"""Splits that keep related records together: an incremental component table that is persisted, with pointer jumping for merges.

1. A delivery's distinct (series, issue) values are all that is compared: series that write one title share a key or a misprint's
   remainder, an issue that names another series links the two. Values that the table holds already are not compared again.
2. The links join components of the table; star rounds (:mod:`.components`) jump the pointers of those a link touches, and the table's
   new version is written. A component with members split before keeps their split, a new one fills the deficits, one whose members
   have different splits is quarantined.
3. New components above ``large`` of all records are few (at most 1 / ``large``) and placed one by one, greatest deficit first;
   all others fall to a split by the hash of their name, through thresholds found on a fixed number of hash buckets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foliolake.llm.components import connected_components
from foliolake.llm.titles import misprint_pairs, remainders, title_keys
from foliolake.operators.incremental import VersionedTable
from foliolake.runtime import materialize

HASH_BUCKETS = 4096


def issue_mentions(issue: Column) -> Column:
    """Array of the title keys an issue may name beside its own number: each way to write a shared issue gives one candidate;
    what is no title simply matches none."""
    ways = (
        r"^\S+\s*/\s*(.+?)\s*#?\s*\S+$",
        r"(?i)^crossover:\s*(.+?)\s*,\s*no\.?\s*\S+$",
        r"^(.+?)\s+#?\S+\s+&\s+\S+$",
        r"(?i)^#?\S+\s+x\s+(.+?)\s+#?\S+$",
        r"(?i)\(\s*with\s+(.+?)\s*\)\s*$",
        r"(?i)\(\s*with\s+(.+?)\s+#?\d+\s*\)\s*$",
    )
    found = [F.coalesce(title_keys(F.nullif(F.regexp_extract(issue, w, 1), F.lit(""))), F.array().cast("array<string>")) for w in ways]
    return F.filter(F.array_distinct(F.concat(*found)), lambda k: k.isNotNull() & k.rlike(r"\p{L}"))


TABLE_SCHEMA = "series string, keys array<string>, rests array<bigint>, named array<string>, component string"


def _told(pages: DataFrame, series: str, issue: str) -> DataFrame:
    """(series, keys, rests, named): each distinct non-null value of ``series`` with its title keys, their remainders, and what its
    issues name. Keys are worked out once for each value, mentions once for each distinct issue."""
    pairs = materialize(pages.select(F.col(series).alias("series"), F.col(issue).alias("issue")).filter("series is not null").distinct(), "pairs")
    values = pairs.select("series").distinct()
    named = pairs.select("series", F.explode(issue_mentions(F.col("issue"))).alias("other")).groupBy("series").agg(F.collect_set("other").alias("named"))
    keyed = values.join(named, "series", "left").withColumn("keys", _value_keys("series"))
    rests = F.array_distinct(F.flatten(F.transform("keys", remainders)))
    return keyed.select("series", "keys", rests.alias("rests"), F.coalesce("named", F.array().cast("array<string>")).alias("named"))


def grow_components(known: DataFrame | None, pages: DataFrame, *, series: str = "series", issue: str = "issue") -> DataFrame:
    """The component table (:data:`TABLE_SCHEMA`) of ``known``, that of earlier deliveries, and ``pages``: a row for each value of
    ``series`` exactly as stored, with the smallest title key it hangs together with as its component.

    Only what is new is compared: values that ``known`` lacks, and mentions that none of its issues made before. They link to keys by
    equality and by misprint; a mention counts once its title is there, in whichever delivery. The links join components, not values:
    pointer jumping runs over the components that a link touches, and all their values follow by one join. Whatever the order and the
    number of deliveries, the components are those of all pages at once. Null values of ``series`` are left out.
    """
    told = materialize(_told(pages, series, issue), "told")
    if known is None:
        known = told.sparkSession.createDataFrame([], TABLE_SCHEMA)
    old = known.select("series", F.col("named").alias("named_before"), F.lit(True).alias("seen"))
    told = told.join(old, "series", "left")
    new = told.filter("seen is null").select("series", "keys", "rests", "named", F.col("keys")[0].alias("component"))
    more = told.filter("seen").select("series", F.array_except("named", "named_before").alias("more")).filter(F.size("more") > 0)
    table = known.join(more, "series", "left").select("series", "keys", "rests", F.when(F.col("more").isNull(), F.col("named")).otherwise(F.concat("named", "more")).alias("named"), "component", F.lit(False).alias("fresh"), "more")
    table = materialize(table.unionByName(new.select("*", F.lit(True).alias("fresh"), F.col("named").alias("more"))), "values")

    # (key, component, fresh) of all titles; a key is fresh if no earlier value had it.
    title = table.select(F.explode("keys").alias("key"), "component", "fresh").groupBy("key").agg(F.min("component").alias("component"), F.min("fresh").alias("fresh"))
    title = materialize(title, "titles")
    # (component, other, fresh) of all mentions.
    said = table.select("component", F.explode("named").alias("other"), F.array_contains("more", F.col("other")).alias("fresh"))
    said = materialize(said.groupBy("component", "other").agg(F.max(F.coalesce("fresh", F.lit(False))).alias("fresh")), "mentions")
    # Components that share a key.
    own = table.select(F.col("component").alias("a"), F.explode("keys").alias("key")).distinct().join(title, "key").select("a", F.col("component").alias("b"))
    named = said.join(title.select(F.col("key").alias("other"), F.col("component").alias("b"), F.col("fresh").alias("new")), "other", "left")
    exact = named.filter("b is not null and (fresh or new)").select(F.col("component").alias("a"), "b")
    # Misprints: of titles among themselves, and of mentions that are no title.
    loose = named.filter("b is null").groupBy("other").agg(F.max("fresh").alias("fresh"))
    either = title.select("key", "fresh").unionByName(loose.select(F.col("other").alias("key"), "fresh"))
    near = materialize(misprint_pairs(either), "misprints")
    near = near.unionByName(near.select(F.col("b").alias("a"), F.col("a").alias("b")))
    first = title.select(F.col("key").alias("a"), F.col("component").alias("ca"))
    second = title.select(F.col("key").alias("b"), F.col("component").alias("cb"))
    same = near.join(first, "a").join(second, "b").select(F.col("ca").alias("a"), F.col("cb").alias("b"))
    misread = near.join(said.select(F.col("other").alias("a"), "component").join(title.select(F.col("key").alias("a")), "a", "left_anti"), "a").join(second, "b").select(F.col("component").alias("a"), F.col("cb").alias("b"))
    links = own.unionByName(exact).unionByName(same).unionByName(misread).filter("a != b")
    joined = connected_components(links)
    moved = table.join(joined.select(F.col("node").alias("component"), "root"), "component", "left")
    return moved.select("series", "keys", "rests", "named", F.coalesce("root", "component").alias("component"))


def _value_keys(name: str) -> Column:
    """The title keys of a value; the value itself where it has no letter or digit."""
    return F.coalesce(title_keys(F.col(name)), F.array(F.col(name)))


def series_components(pages: DataFrame, *, series: str = "series", issue: str = "issue") -> DataFrame:
    """(series, component): every non-null series value exactly as stored, and the smallest title key it hangs together with."""
    return grow_components(None, pages, series=series, issue=issue).select("series", "component")


class SplitTables:
    """What is persisted under ``path`` between deliveries: the component table, and the splits of its members (member, component, size,
    split, state). Each is a table of versions, written whole and read again by the next run: a run that dies leaves the last version."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.components, self.splits = VersionedTable(spark, f"{path}/components"), VersionedTable(spark, f"{path}/splits")

    def deliver(self, pages: DataFrame, *, series: str = "series", issue: str = "issue") -> DataFrame:
        """Merges the values of ``pages`` into the component table and returns its new version: (series, component)."""
        self.components.write(grow_components(self.components.read(), pages, series=series, issue=issue))
        return self.components.read().select("series", "component")

    def split(self, members: DataFrame, shares: DataFrame, *, large: float = 0.001) -> DataFrame:
        """:func:`assign_splits` of ``members`` with the splits of the last version kept, written as the new version. Members of earlier
        runs that are not among ``members`` stay in the table."""
        kept = self.splits.read()
        now = assign_splits(members, shares, None if kept is None else kept.select("member", "split"), large=large)
        if kept is not None:
            now = materialize(now, "splits")
            now = now.unionByName(kept.join(now.select("member"), "member", "left_anti"))
        self.splits.write(now)
        return self.splits.read()


def inseparable_pairs(components: DataFrame) -> DataFrame:
    """(series_a, series_b), series_a < series_b, of one component. The result lists these pairs by definition; only values that
    share a component meet."""
    a = components.select(F.col("series").alias("series_a"), "component")
    b = components.select(F.col("series").alias("series_b"), "component")
    return a.join(b, "component").filter("series_a < series_b").select("series_a", "series_b")


def page_components(pages: DataFrame, components: DataFrame) -> DataFrame:
    """(page_id, member, component): one row for each page. A page's series is that of its latest row with a series; a page
    without any is a component of its own. Pages whose id is null are left out."""
    latest = pages.filter("page_id is not null").groupBy("page_id").agg(F.max(F.when(F.col("series").isNotNull(), F.struct("written_at", "series")))["series"].alias("series"))
    joined = latest.join(components, "series", "left")
    alone = F.concat(F.lit("page "), F.col("page_id").cast("string"))
    return joined.select("page_id", F.coalesce("series", alone).alias("member"), F.coalesce("component", alone).alias("component"))


def _share(name: str) -> Column:
    return (F.pmod(F.xxhash64(name, F.lit("split")), F.lit(HASH_BUCKETS))).cast("int")


def assign_splits(members: DataFrame, shares: DataFrame, kept: DataFrame | None = None, *, large: float = 0.001) -> DataFrame:
    """(member, component, size, split, state) for each member (``members``: member, component, one row for each record).

    ``shares``: split_name, target_share (a few rows). ``kept``: the table of an earlier run (member, split). state: kept, new,
    or quarantined, where members of one component were kept in different splits: its split is then null and it waits for a
    decision. Sizes are numbers of records. Shares that are null count as 0; an empty members table gives no rows.
    """
    spark = members.sparkSession
    sizes = members.groupBy("component").agg(F.count(F.lit(1)).alias("size"))
    ids = members.select("member", "component").distinct()
    if kept is None:
        kept = spark.createDataFrame([], T.StructType([T.StructField("member", T.StringType()), T.StructField("split", T.StringType())]))
    old = ids.join(kept.filter("split is not null").select("member", "split"), "member").groupBy("component").agg(F.min("split").alias("lo"), F.max("split").alias("hi"))
    comp = sizes.join(old, "component", "left").withColumn(
        "state", F.when(F.col("lo").isNull(), "new").when(F.col("lo") == F.col("hi"), "kept").otherwise("quarantined")
    )
    target = {r["split_name"]: r["target_share"] or 0.0 for r in shares.select("split_name", "target_share").collect()}
    total = comp.filter("state != 'quarantined'").agg(F.sum("size")).first()[0] or 0
    have = dict.fromkeys(target, 0)
    for r in comp.filter("state = 'kept'").groupBy("lo").agg(F.sum("size").alias("n")).collect():
        have[r["lo"]] = have.get(r["lo"], 0) + r["n"]
    lack = {k: target.get(k, 0.0) * total - have[k] for k in have}
    big = comp.filter((F.col("state") == "new") & (F.col("size") > large * total)).select("component", "size").orderBy(F.desc("size"), "component").collect()
    placed = []  # at most 1 / large rows
    for r in big:
        to = max(sorted(lack), key=lambda k: lack[k])
        lack[to] -= r["size"]
        placed.append((r["component"], to))
    rest = comp.filter((F.col("state") == "new") & (F.col("size") <= large * total))
    filled = {r["bucket"]: r["n"] for r in rest.groupBy(_share("component").alias("bucket")).agg(F.sum("size").alias("n")).collect()}
    need, bounds, bucket = {k: max(0.0, v) for k, v in lack.items()}, [], 0
    scale = sum(filled.values()) / (sum(need.values()) or 1)
    for k in sorted(need, key=lambda k: (need[k], k)):
        start, got = bucket, 0
        while bucket < HASH_BUCKETS and got + filled.get(bucket, 0) / 2 <= need[k] * scale and need[k]:
            got += filled.get(bucket, 0)
            bucket += 1
        bounds.append((k, start, bucket))
    if bounds:
        bounds[-1] = (bounds[-1][0], bounds[-1][1], HASH_BUCKETS)
    by_hash = F.lit(None).cast("string")
    for k, lo, hi in bounds:
        by_hash = F.when((_share("component") >= lo) & (_share("component") < hi), k).otherwise(by_hash)
    big_df = spark.createDataFrame(placed, "component string, given string")
    split = F.when(F.col("state") == "kept", F.col("lo")).when(F.col("state") == "new", F.coalesce("given", by_hash))
    chosen = comp.join(F.broadcast(big_df), "component", "left").select("component", "size", "state", split.alias("split"))
    return ids.join(chosen, "component").select("member", "component", "size", "split", "state")
