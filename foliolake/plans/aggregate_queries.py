"""Aggregations, metrics and quality summaries, with SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from foliolake.operators import label_rules, metrics, quality
from foliolake.operators import windows as W
from foliolake.plans.relational_queries import _L, _P, _labels, _pages
from foliolake.runtime import table

C = F.col


def _images(spark, d):
    """One row for each image."""
    return table(spark, d, "coco_images").groupBy("image_id").agg(F.max(F.struct("file_name", "width", "height", "rcnn_panels", "text_coverage")).alias("x")).select("image_id", "x.*")


def category_counts(spark, d):
    return table(spark, d, "page_labels").groupBy("page_type").agg(F.count(F.lit(1)).alias("n"))


def category_pivot(spark, d):
    """Counts by two categories, wide, 0 where there is none."""
    li = table(spark, d, "lineitem")
    return li.groupBy("l_returnflag").pivot("l_linestatus", ["F", "O"]).agg(F.count(F.lit(1))).na.fill(0)


def category_means(spark, d):
    li = table(spark, d, "lineitem")
    p = li.groupBy("l_returnflag").pivot("l_linestatus", ["F", "O"]).agg(F.round(F.avg("l_quantity"), 6)).na.fill(0)
    return p


def zero_category(spark, d):
    """Orders without a returned line."""
    return table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.max((C("l_returnflag") == "R").cast("int")).alias("r")).filter("r = 0").select("l_orderkey")


def value_counts_pct(spark, d):
    lab = table(spark, d, "page_labels").groupBy("page_type").agg(F.count(F.lit(1)).alias("n"))
    total = lab.agg(F.sum("n").alias("t"))
    return lab.crossJoin(F.broadcast(total)).select("page_type", "n", F.round(100 * C("n") / C("t"), 2).alias("pct"))  # one row


def value_counts_known(spark, d):
    """The same over known types only."""
    lab = table(spark, d, "page_labels").filter("page_type is not null").groupBy("page_type").agg(F.count(F.lit(1)).alias("n"))
    total = lab.agg(F.sum("n").alias("t"))
    return lab.crossJoin(F.broadcast(total)).select("page_type", "n", F.round(100 * C("n") / C("t"), 2).alias("pct"))  # one row


def group_stats(spark, d):
    x = C("n_chars")
    return table(spark, d, "documents").groupBy("lang").agg(
        F.round(F.avg(x), 6).alias("mean"), F.round(F.stddev_samp(x), 6).alias("std"), F.round(F.stddev_pop(x), 6).alias("std_pop"), F.count(x).alias("n"),
        F.round(F.log1p(F.sum(x)), 6).alias("log_sum"), F.round(F.log1p(F.max(x)), 6).alias("log_max"),
    )


def length_percentiles(spark, d):
    ps = [0.5, 0.75, 0.9, 0.95, 0.97, 0.99, 1.0]
    a = table(spark, d, "documents").filter("n_chars is not null").agg(F.percentile("n_chars", F.array(*[F.lit(p) for p in ps])).alias("p"))
    rows = a.select(F.posexplode("p").alias("i", "v"))
    return rows.select(F.round(F.element_at(F.array(*[F.lit(p) for p in ps]), C("i") + 1), 2).alias("p"), C("v").cast("int").alias("chars"), F.least(F.greatest(F.ceil(C("v") / 16) * 16, F.lit(64)), F.lit(4096)).alias("recommended"))


def length_histogram(spark, d):
    n = C("n_chars")
    b = F.when(n.isNull(), "unknown").when(n < 100, "[0,100)").when(n < 1000, "[100,1000)").when(n < 10000, "[1000,10000)").otherwise("[10000,)")
    return table(spark, d, "documents").groupBy(b.alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


def panel_histogram(spark, d):
    return _images(spark, d).groupBy(F.coalesce("rcnn_panels", F.lit(0)).alias("panels")).agg(F.count(F.lit(1)).alias("n"))


def size_buckets(spark, d):
    mp = C("width") * C("height") / 1e6
    b = F.when(mp.isNull(), "unknown").when(mp < 4, "under 4").when(mp < 8, "4 to 8").otherwise("8 and more")
    return _images(spark, d).groupBy(b.alias("megapixels"), F.lower(F.regexp_extract("file_name", r"\.([A-Za-z]+)$", 1)).alias("format")).agg(F.count(F.lit(1)).alias("n"))


def source_rollup(spark, d):
    """Statistics by source and over all in one pass."""
    p = table(spark, d, "documents").filter("source is not null")
    return p.rollup("source").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("n_chars"), 6).alias("mean"), F.max("n_chars").alias("longest"))


def series_rollup(spark, d):
    """Pages by series, by series and volume, and by series and issue: one scan, grouping sets."""
    _pages(spark, d).filter("series is not null").createOrReplaceTempView("_series_rollup_pages")
    return spark.sql("""SELECT series, volume, issue, grouping_id(series, volume, issue) AS level, count(*) AS n, count(DISTINCT source) AS sources
        FROM _series_rollup_pages GROUP BY GROUPING SETS ((series), (series, volume), (series, issue))""")


def usage_projection(spark, d):
    """Sums and averages of a log by kind, kinds of at least 5 entries, projected to a corpus."""
    e = table(spark, d, "events").groupBy("event_type").agg(F.sum("value").alias("total"), F.count(F.lit(1)).alias("requests"), F.avg("value").alias("mean"))
    return e.filter("requests >= 5").select("event_type", F.round("total", 4).alias("total"), "requests", F.round("mean", 6).alias("mean"), F.round(C("mean") * 1_220_000, 2).alias("projected"))


def catalog_stats(spark, d):
    p = table(spark, d, "part")
    return p.groupBy("p_brand").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg("p_retailprice"), 6).alias("mean"), F.round(F.median("p_retailprice"), 6).alias("median"), F.min("p_retailprice").alias("lo"),
        F.max("p_retailprice").alias("hi"), F.sum((C("p_size") > 25).cast("int")).alias("large"),
    )


def metadata_lengths(spark, d):
    v = table(spark, d, "page_vectors")
    return v.agg(*[F.max(F.length(c)).alias(c) for c in ("std_id", "manifest_path", "source", "series", "volume", "issue")])


def nearest_rank_p95(spark, d):
    """Least, floor of the mean, nearest-rank 95th percentile and greatest."""
    x = table(spark, d, "documents").filter("n_chars is not null")
    n = x.count()
    k = min(int(n * 0.95), n - 1) if n else 0
    # The rank's value from a histogram of the values: no list of all of them anywhere.
    from pyspark.sql import Window

    h = x.groupBy("n_chars").agg(F.count(F.lit(1)).alias("c")).withColumn("b", F.floor(F.log2(F.greatest(C("n_chars"), F.lit(1)))))
    per = h.groupBy("b").agg(F.sum("c").alias("bc")).withColumn("before", F.sum("bc").over(Window.orderBy("b")) - C("bc"))  # at most 64 rows
    at = h.join(F.broadcast(per), "b").withColumn("upto", C("before") + F.sum("c").over(Window.partitionBy("b").orderBy("n_chars")))
    p95 = at.filter(C("upto") > k).agg(F.min("n_chars").alias("p95"))
    return x.agg(F.min("n_chars").alias("least"), F.floor(F.sum("n_chars") / F.count(F.lit(1))).alias("mean_floor"), F.max("n_chars").alias("greatest")).crossJoin(p95)  # one row each


def top_groups(spark, d):
    return table(spark, d, "page_vectors").filter("series is not null").groupBy("series").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("issue").alias("issues")).orderBy(F.desc("n"), "series").limit(10)


def top_by_size(spark, d):
    im = _images(spark, d).select("image_id", (F.coalesce("width", F.lit(0)).cast("long") * F.coalesce("height", F.lit(0))).alias("pixels"))
    return im.orderBy(F.desc("pixels"), "image_id").limit(20)


def cheapest(spark, d):
    p = table(spark, d, "part").filter(~F.lower("p_name").rlike("(free|auto)"))
    return p.select("p_partkey", F.round(C("p_retailprice") * 1.5 + C("p_size") * 0.2, 4).alias("estimate")).orderBy("estimate", "p_partkey").limit(20)


def page_text_frame(spark, d):
    """Texts by series: number, whether any has text, sum, mean and greatest length."""
    n = F.length(F.coalesce("text", F.lit("")))
    some = F.trim(F.coalesce("text", F.lit(""))) != ""
    return table(spark, d, "documents").groupBy("series").agg(
        F.count(F.lit(1)).alias("texts"), F.max(some).alias("has_text"), F.sum(n).alias("total"), F.round(F.avg(F.when(some, n)), 6).alias("mean"), F.max(F.when(some, n)).alias("longest")
    )


def run_summary(spark, d):
    """Scores by flags counted for every value from 0 to 5."""
    im = _images(spark, d)
    s = im.select(quality.score_by_flags(C("rcnn_panels"), C("width").isNotNull(), quality.ratio(C("rcnn_panels"), F.lit(5)), C("text_coverage"), C("text_coverage") * 3).alias("score"))
    return quality.zero_filled(s, "score", range(0, 6))


def quality_flags(spark, d):
    im = _images(spark, d)
    r = quality.ratio(F.lit(5.0), C("rcnn_panels"))
    return im.select("image_id", F.round(r, 6).alias("vlm_per_rcnn"), quality.score_by_flags(C("rcnn_panels"), C("width").isNotNull(), r, C("text_coverage"), C("text_coverage") * 2).alias("score"))


def quality_steps(spark, d):
    im = _images(spark, d)
    r = quality.ratio(C("rcnn_panels"), F.lit(5.0))
    return im.select("image_id", F.round(r, 6).alias("rcnn_per_vlm"), quality.score_by_steps(r, C("text_coverage"), C("rcnn_panels"), least_cover=0.6).alias("score"))


def tier_counts(spark, d):
    im = _images(spark, d)
    r = quality.ratio(C("rcnn_panels"), F.lit(5.0))
    s = im.select(r.alias("r"), quality.score_by_steps(r, C("text_coverage"), C("rcnn_panels"), least_cover=0.6).alias("s"))
    return s.agg(*[F.sum(c.cast("int")).alias(k) for k, c in quality.tiers(C("s"), C("r")).items()])


def _scans(spark, d):
    """Panel counts of the rows of one image name: two scans of a page."""
    return _images(spark, d).groupBy("file_name").agg(F.min(F.struct("image_id", "rcnn_panels"))["rcnn_panels"].alias("a"), F.max(F.struct("image_id", "rcnn_panels"))["rcnn_panels"].alias("b"), F.count(F.lit(1)).alias("n")).filter("n > 1")


def diff_summary(spark, d):
    s = quality.difference_summary(_scans(spark, d), "a", "b")
    return s.select("n", *[F.round(c, 6).alias(c) for c in s.columns if c != "n"])


def diff_distribution(spark, d):
    return quality.difference_histogram(_scans(spark, d), "a", "b")


def page_type_rules(spark, d):
    """Page types by weighted rules over position, panel count and the paths' words."""
    p = W.position_share(_pages(spark, d).filter("series is not null"), ["series", "issue"], [C("page_num").asc_nulls_last(), C("page_id")])
    p = p.withColumn("corpus", F.lower("manifest_path")).withColumn("panels", C("page_id") % 7).withColumn("text_coverage", (C("page_id") % 10) / 10)
    return label_rules.score_labels(p).select("page_id", "page_type", "confidence")


def _predictions(spark, d):
    """The first and the last label of pages labelled more than once stand for truth and prediction."""
    lab = table(spark, d, "page_labels").filter("page_type is not null").groupBy("page_id").agg(
        F.min(F.struct("labeled_at", "page_type"))["page_type"].alias("pred"), F.max(F.struct("labeled_at", "page_type"))["page_type"].alias("label"))
    return lab


def class_metrics(spark, d):
    s = metrics.class_scores(metrics.confusion(_predictions(spark, d), "label", "pred"))
    return s.select("cls", "support", "predicted", "hits", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")])


def overall_metrics(spark, d):
    s = metrics.overall_scores(metrics.class_scores(metrics.confusion(_predictions(spark, d), "label", "pred")), declared=9)
    return s.select(*[F.round(c, 6).alias(c) for c in s.columns])


def confusion_norm(spark, d):
    return metrics.confusion(_predictions(spark, d), "label", "pred").withColumn("share", F.round("share", 6))


def class_weighting(spark, d):
    return metrics.class_weights(_labels(spark, d), "page_type").withColumn("weight", F.round("weight", 6))


def _runs(spark, d, label):
    p = _pages(spark, d).join(_predictions(spark, d), "page_id").filter("series is not null and issue is not null and page_num is not null")
    return W.label_runs(p, ["series", "issue"], ["page_num", "page_id"], label).withColumnRenamed(label, "name").select("series", "issue", C("name").alias("label"), "first", "last")


def segment_metrics(spark, d):
    s = metrics.segment_scores(_runs(spark, d, "label"), _runs(spark, d, "pred"), book=["series", "issue"])
    return s.select("nt", "nf", "tp", *[F.round(c, 6).alias(c) for c in ("sq", "rq", "pq")])


def boundary_metrics(spark, d):
    m = metrics.boundary_distance(_runs(spark, d, "label"), _runs(spark, d, "pred"), book=["series", "issue"])
    return m.withColumn("mndd", F.round("mndd", 6))


def coverage_sample(spark, d):
    """Share of a stable sample of pages that have a label."""
    from foliolake.operators.search import stable_sample

    s = stable_sample(_pages(spark, d).select("page_id"), 200, ident="page_id")
    j = s.join(_labels(spark, d).select("page_id", F.lit(1).alias("has")), "page_id", "left")
    return j.agg(F.count(F.lit(1)).alias("n"), F.round(100 * F.avg(F.coalesce("has", F.lit(0))), 2).alias("pct"))


def model_page_matrix(spark, d):
    """For each source the map from language to texts: nested collection of a small model by group table."""
    c = table(spark, d, "documents").filter("source is not null and lang is not null").groupBy("source", "lang").agg(F.count(F.lit(1)).alias("n"))
    return c.groupBy("source").agg(F.sort_array(F.collect_list(F.concat_ws("=", "lang", C("n").cast("string")))).alias("cells"))


def root_causes(spark, d):
    """Why images have no usable panel count."""
    im = _images(spark, d)
    b = F.when(C("rcnn_panels") > 0, "found valid").when(C("rcnn_panels") == 0, "found none").when(C("width").isNull(), "not found").otherwise("no count")
    return im.groupBy(b.alias("cause")).agg(F.count(F.lit(1)).alias("n"))


_IM = """im AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY file_name DESC NULLS LAST, width DESC NULLS LAST, height DESC NULLS LAST, rcnn_panels DESC NULLS LAST, text_coverage DESC NULLS LAST) AS rn FROM coco_images) WHERE rn = 1)"""
_PRED = """lab AS (SELECT page_id, arg_min(page_type, (labeled_at, page_type)) AS pred, arg_max(page_type, (labeled_at, page_type)) AS label FROM page_labels WHERE page_type IS NOT NULL GROUP BY page_id)"""
_CONF = f"""WITH {_PRED}, c AS (SELECT label, pred, count(*) AS n FROM lab GROUP BY ALL), k AS (SELECT label AS cls FROM c UNION SELECT pred FROM c),
    s AS (SELECT cls, coalesce((SELECT sum(n) FROM c WHERE label = cls), 0) AS support, coalesce((SELECT sum(n) FROM c WHERE pred = cls), 0) AS predicted, coalesce((SELECT sum(n) FROM c WHERE label = cls AND pred = cls), 0) AS hits FROM k),
    f AS (SELECT *, CASE WHEN predicted > 0 THEN hits / predicted ELSE 0 END AS p, CASE WHEN support > 0 THEN hits / support ELSE 0 END AS r FROM s), g AS (SELECT *, CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END AS f1 FROM f)"""
_FLAG = "(coalesce(rcnn_panels > 0, false)::INT + (width IS NOT NULL)::INT + coalesce(rcnn_panels > 0 AND {r} BETWEEN 0.7 AND 1.3, false)::INT + coalesce(rcnn_panels > 0 AND text_coverage >= 0.3, false)::INT + coalesce(text_coverage * {m} >= 1.0, false)::INT)"
_STEP = """(CASE WHEN r BETWEEN 0.9 AND 1.1 THEN 2.0 WHEN r BETWEEN 0.8 AND 1.2 THEN 1.0 ELSE 0.0 END + CASE WHEN text_coverage >= 0.6::DOUBLE THEN 1.0 WHEN text_coverage >= (0.6::DOUBLE - 0.2::DOUBLE) THEN 0.5 ELSE 0.0 END
    + CASE WHEN rcnn_panels BETWEEN 1 AND 15 THEN 1.0 WHEN rcnn_panels BETWEEN 1 AND 20 THEN 0.5 ELSE 0.0 END)::DOUBLE"""
_SCANS = f"WITH {_IM}, s AS (SELECT file_name, arg_min(coalesce(rcnn_panels, -1), image_id) AS a, arg_max(coalesce(rcnn_panels, -1), image_id) AS b FROM im GROUP BY file_name HAVING count(*) > 1), p AS (SELECT a - b AS d FROM s WHERE a >= 0 AND b >= 0)"
_RUNS = f"""WITH {_P}, {_PRED}, j AS (SELECT series, issue, page_num, page_id, label, pred FROM pages JOIN lab USING (page_id) WHERE series IS NOT NULL AND issue IS NOT NULL AND page_num IS NOT NULL),
    n AS (SELECT *, row_number() OVER o AS k, (label IS DISTINCT FROM lag(label) OVER o)::INT AS f1, (pred IS DISTINCT FROM lag(pred) OVER o)::INT AS f2 FROM j WINDOW o AS (PARTITION BY series, issue ORDER BY page_num, page_id)),
    r AS (SELECT *, sum(f1) OVER (PARTITION BY series, issue ORDER BY k) AS r1, sum(f2) OVER (PARTITION BY series, issue ORDER BY k) AS r2 FROM n),
    t AS (SELECT series, issue, label, min(page_num) AS a, max(page_num) AS b FROM r GROUP BY series, issue, r1, label), g AS (SELECT series, issue, pred AS label, min(page_num) AS a, max(page_num) AS b FROM r GROUP BY series, issue, r2, pred)"""

SQL = {
    "category_counts": "SELECT page_type, count(*) AS n FROM page_labels GROUP BY page_type",
    "category_pivot": "SELECT l_returnflag, count(*) FILTER (l_linestatus = 'F') AS F, count(*) FILTER (l_linestatus = 'O') AS O FROM lineitem GROUP BY 1",
    "category_means": "SELECT l_returnflag, coalesce(round(avg(l_quantity) FILTER (l_linestatus = 'F'), 6), 0) AS F, coalesce(round(avg(l_quantity) FILTER (l_linestatus = 'O'), 6), 0) AS O FROM lineitem GROUP BY 1",
    "zero_category": "SELECT DISTINCT l_orderkey FROM lineitem a WHERE NOT EXISTS (SELECT 1 FROM lineitem b WHERE b.l_orderkey = a.l_orderkey AND b.l_returnflag = 'R')",
    "value_counts_pct": "SELECT page_type, count(*) AS n, round(100 * count(*) / sum(count(*)) OVER (), 2) AS pct FROM page_labels GROUP BY page_type",
    "value_counts_known": "SELECT page_type, count(*) AS n, round(100 * count(*) / sum(count(*)) OVER (), 2) AS pct FROM page_labels WHERE page_type IS NOT NULL GROUP BY page_type",
    "group_stats": """SELECT lang, round(avg(n_chars), 6) AS mean, round(stddev_samp(n_chars), 6) AS std, round(stddev_pop(n_chars), 6) AS std_pop, count(n_chars) AS n, round(ln(1 + sum(n_chars)), 6) AS log_sum, round(ln(1 + max(n_chars)), 6) AS log_max
        FROM documents GROUP BY lang""",
    "length_percentiles": """SELECT round(p, 2) AS p, v::DOUBLE::BIGINT AS chars, least(greatest(ceil(raw / 16) * 16, 64), 4096)::BIGINT AS recommended FROM (SELECT unnest([0.5, 0.75, 0.9, 0.95, 0.97, 0.99, 1.0])::DOUBLE AS p,
        unnest(q) AS raw, trunc(unnest(q)) AS v FROM (SELECT quantile_cont(n_chars, [0.5, 0.75, 0.9, 0.95, 0.97, 0.99, 1.0]) AS q FROM documents))""",
    "length_histogram": "SELECT CASE WHEN n_chars IS NULL THEN 'unknown' WHEN n_chars < 100 THEN '[0,100)' WHEN n_chars < 1000 THEN '[100,1000)' WHEN n_chars < 10000 THEN '[1000,10000)' ELSE '[10000,)' END AS bucket, count(*) AS n FROM documents GROUP BY 1",
    "panel_histogram": f"WITH {_IM} SELECT coalesce(rcnn_panels, 0) AS panels, count(*) AS n FROM im GROUP BY 1",
    "size_buckets": f"""WITH {_IM}, m AS (SELECT width::DOUBLE * height / 1e6 AS mp, lower(regexp_extract(file_name, '\\.([A-Za-z]+)$', 1)) AS format FROM im) SELECT CASE WHEN mp IS NULL THEN 'unknown' WHEN mp < 4 THEN 'under 4' WHEN mp < 8 THEN '4 to 8' ELSE '8 and more' END AS megapixels, format, count(*) AS n FROM m GROUP BY ALL""",
    "source_rollup": "SELECT source, count(*) AS n, round(avg(n_chars), 6) AS mean, max(n_chars) AS longest FROM documents WHERE source IS NOT NULL GROUP BY ROLLUP (source)",
    "series_rollup": f"WITH {_P} SELECT series, volume, issue, grouping_id(series, volume, issue) AS level, count(*) AS n, count(DISTINCT source) AS sources FROM pages WHERE series IS NOT NULL GROUP BY GROUPING SETS ((series), (series, volume), (series, issue))",
    "usage_projection": "SELECT event_type, round(sum(value), 4) AS total, count(*) AS requests, round(avg(value), 6) AS mean, round(avg(value) * 1220000, 2) AS projected FROM events GROUP BY event_type HAVING count(*) >= 5",
    "catalog_stats": "SELECT p_brand, count(*) AS n, round(avg(p_retailprice), 6) AS mean, round(median(p_retailprice), 6) AS median, min(p_retailprice) AS lo, max(p_retailprice) AS hi, sum((p_size > 25)::INT) AS large FROM part GROUP BY p_brand",
    "metadata_lengths": "SELECT max(length(std_id)) AS std_id, max(length(manifest_path)) AS manifest_path, max(length(source)) AS source, max(length(series)) AS series, max(length(volume)) AS volume, max(length(issue)) AS issue FROM page_vectors",
    "nearest_rank_p95": "SELECT min(n_chars) AS least, floor(avg(n_chars)) AS mean_floor, max(n_chars) AS greatest, list_sort(list(n_chars))[least(floor(count(*) * 0.95::DOUBLE)::BIGINT, count(*) - 1) + 1] AS p95 FROM documents WHERE n_chars IS NOT NULL",
    "top_groups": "SELECT series, count(*) AS n, count(DISTINCT issue) AS issues FROM page_vectors WHERE series IS NOT NULL GROUP BY series ORDER BY n DESC, series LIMIT 10",
    "top_by_size": f"WITH {_IM} SELECT image_id, coalesce(width, 0)::BIGINT * coalesce(height, 0) AS pixels FROM im ORDER BY pixels DESC, image_id LIMIT 20",
    "cheapest": "SELECT p_partkey, round(p_retailprice * 1.5 + p_size * 0.2, 4) AS estimate FROM part WHERE NOT regexp_matches(lower(p_name), '(free|auto)') ORDER BY estimate, p_partkey LIMIT 20",
    "page_text_frame": """WITH t AS (SELECT series, length(coalesce(text, '')) AS n, trim(coalesce(text, '')) <> '' AS has FROM documents)
        SELECT series, count(*) AS texts, bool_or(has) AS has_text, sum(n) AS total, round(avg(n) FILTER (has), 6) AS mean, max(n) FILTER (has) AS longest FROM t GROUP BY series""",
    "run_summary": f"WITH {_IM}, s AS (SELECT {_FLAG.format(r='coalesce(rcnn_panels / 5, 0)', m=3)} AS score FROM im) SELECT i::INT AS score, count(s.score) AS n FROM range(0, 6) t(i) LEFT JOIN s ON s.score = i GROUP BY i",
    "quality_flags": f"WITH {_IM}, q AS (SELECT *, CASE WHEN rcnn_panels > 0 THEN 5.0 / rcnn_panels ELSE 0 END AS r FROM im) SELECT image_id, round(r, 6) AS vlm_per_rcnn, {_FLAG.format(r='r', m=2)} AS score FROM q",
    "quality_steps": f"WITH {_IM}, q AS (SELECT *, coalesce(rcnn_panels / 5.0::DOUBLE, 0) AS r FROM im) SELECT image_id, round(r, 6) AS rcnn_per_vlm, {_STEP} AS score FROM q",
    "tier_counts": f"""WITH {_IM}, q AS (SELECT *, coalesce(rcnn_panels / 5.0::DOUBLE, 0) AS r FROM im), s AS (SELECT r, {_STEP} AS s FROM q)
        SELECT sum((s >= 4)::INT) AS flags_high, sum((s = 3)::INT) AS flags_medium, sum((s <= 2)::INT) AS flags_low, sum((r BETWEEN 0.9 AND 1.1)::INT) AS flags_near, sum((s >= 4)::INT) AS steps_high, sum((s = 3)::INT) AS steps_medium,
        sum((s < 3)::INT) AS steps_low, sum((r BETWEEN 0.9 AND 1.1 AND r <> 1)::INT) AS steps_near, sum((r = 1)::INT) AS perfect, sum((s >= 3.5)::INT) AS bands_near, sum((s >= 2.5)::INT) AS bands_high, sum((s >= 1.5 AND s < 2.5)::INT) AS bands_medium,
        sum((s < 1.5)::INT) AS bands_low FROM s""",
    "diff_summary": _SCANS + " SELECT count(*) AS n, round(avg(d), 6) AS mean_diff, round(avg((d = 0)::INT), 6) AS exact, round(avg((abs(d) <= 1)::INT), 6) AS within_one, round(avg((d > 0)::INT), 6) AS above, round(avg((d < 0)::INT), 6) AS below FROM p",
    "diff_distribution": _SCANS + " SELECT d AS diff, count(*) AS n FROM p GROUP BY d ORDER BY n DESC, d LIMIT 15",
    "class_metrics": _CONF + " SELECT cls, support, predicted, hits, round(p, 6) AS precision, round(r, 6) AS recall, round(f1, 6) AS f1 FROM g",
    "overall_metrics": _CONF + " SELECT round(sum(hits) / sum(support), 6) AS accuracy, round(avg(f1), 6) AS macro_f1, round(sum(f1) / 9, 6) AS macro_f1_declared, round(sum(f1 * support) / sum(support), 6) AS weighted_f1 FROM g",
    "confusion_norm": f"WITH {_PRED} SELECT label, pred, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY label), 6) AS share FROM lab GROUP BY label, pred",
    "class_weighting": f"WITH {_L} SELECT page_type, count(*) AS n, round(sum(count(*)) OVER () / (count(*) OVER () * count(*)), 6) AS weight FROM labels WHERE page_type IS NOT NULL GROUP BY page_type",
    "segment_metrics": _RUNS + """, m AS (SELECT greatest(0, least(t.b, g.b) - greatest(t.a, g.a) + 1) AS i, t.b - t.a + 1 + g.b - g.a + 1 AS u FROM t JOIN g USING (series, issue, label)), h AS (SELECT i / (u - i) AS iou FROM m WHERE i / (u - i) > 0.5),
        s AS (SELECT (SELECT count(*) FROM t) AS nt, (SELECT count(*) FROM g) AS nf, (SELECT count(*) FROM h) AS tp, coalesce((SELECT avg(iou) FROM h), 0) AS sq)
        SELECT nt, nf, tp, round(sq, 6) AS sq, round(2 * tp / (nt + nf), 6) AS rq, round(sq * 2 * tp / (nt + nf), 6) AS pq FROM s""",
    "boundary_metrics": _RUNS + """, len AS (SELECT series, issue, max(b) AS length FROM t GROUP BY ALL), d AS (SELECT t.series, t.issue, t.a, min(abs(t.a - g.a)) AS d FROM (SELECT DISTINCT series, issue, a FROM t) t LEFT JOIN (SELECT DISTINCT series, issue, a FROM g) g USING (series, issue) GROUP BY ALL),
        p AS (SELECT series, issue, avg(coalesce(d, length)) AS d FROM d JOIN len USING (series, issue) GROUP BY ALL) SELECT round(avg(d), 6) AS mndd, count(*) AS books FROM p""",
    "model_page_matrix": "SELECT source, list_sort(list(lang || '=' || n)) AS cells FROM (SELECT source, lang, count(*) AS n FROM documents WHERE source IS NOT NULL AND lang IS NOT NULL GROUP BY ALL) GROUP BY source",
    "root_causes": f"WITH {_IM} SELECT CASE WHEN rcnn_panels > 0 THEN 'found valid' WHEN rcnn_panels = 0 THEN 'found none' WHEN width IS NULL THEN 'not found' ELSE 'no count' END AS cause, count(*) AS n FROM im GROUP BY 1",
    "coverage_sample": f"""WITH {_P}, s AS (SELECT page_id FROM pages ORDER BY md5('42:' || page_id), page_id LIMIT 200)
        SELECT count(*) AS n, round(100 * avg((page_id IN (SELECT page_id FROM page_labels))::INT), 2) AS pct FROM s""",
    "page_type_rules": f"""WITH {_P}, q AS (SELECT page_id, lower(manifest_path) AS t, page_id % 7 AS panels, (page_id % 10) / 10 AS cov, (row_number() OVER (PARTITION BY series, issue ORDER BY page_num NULLS LAST, page_id) - 1) / greatest(1, count(*) OVER (PARTITION BY series, issue) - 1) AS pos FROM pages WHERE series IS NOT NULL),
        s AS (SELECT page_id, [CASE WHEN pos <= 0.03 THEN 2.0 ELSE 0 END + CASE WHEN regexp_matches(t, 'cover|barcode|logo') THEN 2.0 ELSE 0 END + CASE WHEN panels <= 1 THEN 0.5 ELSE 0 END, CASE WHEN pos >= 0.97 THEN 2.0 ELSE 0 END,
        CASE WHEN pos BETWEEN 0.05 AND 0.95 AND panels <= 1 THEN 1.8 ELSE 0 END + CASE WHEN regexp_matches(t, 'splash page|full-page|full page') THEN 0.7 ELSE 0 END, CASE WHEN regexp_matches(t, 'letters page|letter column|fan mail|mailbag|letters to the editor') THEN 3.0 ELSE 0 END,
        CASE WHEN pos <= 0.15 AND regexp_matches(t, 'previously|recap|last issue|summary') THEN 2.0 ELSE 0 END, CASE WHEN panels >= 3 AND regexp_matches(t, 'preview|first look|sample pages') THEN 2.5 ELSE 0 END,
        CASE WHEN pos BETWEEN 0.05 AND 0.95 AND panels >= 2 THEN 1.5 ELSE 0 END + CASE WHEN cov >= 0.4 THEN 0.7 ELSE 0 END]::DOUBLE[] AS w FROM q)
        SELECT page_id, ['cover', 'back_cover', 'splash', 'letters', 'recap', 'preview', 'interior'][list_position(w, list_max(w))] AS page_type, list_max(w) AS confidence FROM s""",
}

QUERIES = {
    f.__name__: f
    for f in (
        category_counts, category_pivot, category_means, zero_category, value_counts_pct, value_counts_known, group_stats, length_percentiles, length_histogram,
        panel_histogram, size_buckets, source_rollup, series_rollup, usage_projection, catalog_stats, metadata_lengths, nearest_rank_p95, top_groups, top_by_size, cheapest,
        page_text_frame, run_summary, quality_flags, quality_steps, tier_counts, diff_summary, diff_distribution, page_type_rules, class_metrics, overall_metrics,
        confusion_norm, class_weighting, segment_metrics, boundary_metrics, coverage_sample, model_page_matrix, root_causes,
    )
}
