"""Joins, windows and duplicates over the page tables, with SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from foliolake.functions import keys as K
from foliolake.operators import dedup as U
from foliolake.operators import joins as J
from foliolake.operators import windows as W
from foliolake.operators.filters import with_reasons
from foliolake.runtime import materialize, spread, table

C = F.col


def _pages(spark, d):
    """The latest row of each page."""
    v = table(spark, d, "page_vectors").select("page_id", "series", "issue", "volume", "page_num", "source", "manifest_path", "std_id", "written_at")
    return v.groupBy("page_id").agg(F.max(F.struct("written_at", "manifest_path", "series", "issue", "volume", "page_num", "source", "std_id")).alias("x")).select("page_id", "x.*")


def _labels(spark, d):
    """The latest label of each page."""
    lab = table(spark, d, "page_labels")
    return lab.groupBy("page_id").agg(F.max(F.struct("labeled_at", "page_type"))["page_type"].alias("page_type"))


# joins


def resume_anti(spark, d):
    return J.not_done(table(spark, d, "page_vectors").select("page_id").distinct(), table(spark, d, "page_labels"), ["page_id"])


def resume_composite(spark, d):
    """Orders' lines not yet shipped, by a key of two columns."""
    li = table(spark, d, "lineitem")
    done = li.filter("l_linestatus = 'F'").select("l_orderkey", "l_linenumber")
    return J.not_done(li.select("l_orderkey", "l_linenumber").distinct(), done, ["l_orderkey", "l_linenumber"])


def split_train_val(spark, d):
    lab = _labels(spark, d)
    val, train = lab.filter("page_type = 'cover'"), lab.filter("page_type in ('story', 'cover')")
    return J.membership(_pages(spark, d).select("page_id"), [("val", val), ("train", train)], key="page_id").groupBy("split").agg(F.count(F.lit(1)).alias("n"))


def suffix_bridge(spark, d):
    """Pages whose path, or the longest part of its end, is a known last-two-parts key."""
    p = _pages(spark, d).select("page_id", "manifest_path")
    known = p.filter("page_id % 3 = 0").select(K.last_parts(C("manifest_path"), 2).alias("suffix"))
    return J.bridge(p, known, K.suffixes_of(C("manifest_path")), key="page_id", target="suffix")


def variant_join(spark, d):
    """Unpadded page keys brought to the padded keys of the other side."""
    p = _pages(spark, d).filter("series is not null and page_num is not null").select(F.concat_ws("|", K.token(C("series")), "issue").alias("base"), "page_num", "page_id")
    known = p.select(F.concat(C("base"), F.lit("_p"), F.lpad(C("page_num").cast("string"), 3, "0")).alias("variant")).distinct()
    return J.bridge(p.select("page_id", "base", "page_num"), known, K.padded_variants(C("base"), C("page_num")), key="page_id", target="variant")


def path_lookup_cascade(spark, d):
    p = _pages(spark, d).select("page_id", "manifest_path")
    asked = p.select(C("page_id").alias("ask"), F.when(C("page_id") % 3 == 0, C("manifest_path")).when(C("page_id") % 3 == 1, F.upper("manifest_path")).otherwise(F.concat(F.lit("/mnt/copy/"), K.last_parts(C("manifest_path")))).alias("asked"))
    norm = lambda c: F.lower(F.translate(c, "\\", "/"))
    rules = [("exact", C("asked"), C("manifest_path")), ("normal", norm("asked"), norm("manifest_path")), ("last parts", F.lower(K.last_parts(C("asked"))), F.lower(K.last_parts(C("manifest_path"))))]
    return J.cascade(asked, p, rules, probe_id="ask", build_id="page_id")


def filename_resolution(spark, d):
    """File names to page ids by name, by stem, by alphanumeric key, by last number: the first that finds one; n_candidates above one shows
    that it is ambiguous."""
    p = _pages(spark, d).select("page_id", F.lower(F.element_at(K.path_parts(C("manifest_path")), -1)).alias("name"))
    im = table(spark, d, "coco_images").groupBy("image_id").agg(F.lower(F.max("file_name")).alias("file_name"))
    mine, other = K.without_suffix(C("file_name")), K.without_suffix(C("name"))
    rules = [("name", C("file_name"), C("name")), ("stem", mine, other), ("alnum", K.alnum_key(mine), K.alnum_key(other)), ("last number", K.last_number_key(mine), K.last_number_key(other))]
    return J.cascade(im, p, rules, probe_id="image_id", build_id="page_id")


def substring_join(spark, d):
    """Series whose title holds another's, met on their first word."""
    s = table(spark, d, "page_vectors").select(F.lower(F.trim("series")).alias("s")).filter("s is not null and s != ''").distinct()
    first = lambda c: F.array(F.regexp_extract(c, r"^(?:the )?([^ ]*)", 1))
    j = J.contains_join(s.select(C("s").alias("a")), s.select(C("s").alias("b")), a_id="a", a_text="a", b_id="b", b_text="b", block=first)
    return j.filter("a < b")


def label_chain_reasons(spark, d):
    p = _pages(spark, d).join(_labels(spark, d), "page_id", "left").join(table(spark, d, "documents").select("series").filter("series is not null").distinct().withColumn("has_text", F.lit(True)), "series", "left")
    checks = [("skipped: label", C("page_type") == "story"), ("skipped: page number", C("page_num").isNotNull()), ("skipped: text", C("has_text"))]
    return with_reasons(p, checks).groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


def three_way_compare(spark, d):
    e = table(spark, d, "events")
    one = lambda t: e.filter(C("event_type") == t).groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))
    return J.three_way([("views", one("view")), ("clicks", one("click")), ("purchases", one("purchase"))], key="user_id", value="n")


def presence_audit(spark, d):
    p = J.presence(table(spark, d, "page_vectors").select("series"), table(spark, d, "documents").select("series"), key="series")
    return p.groupBy("in_a", "in_b").agg(F.count(F.lit(1)).alias("n"))


def category_lookup(spark, d):
    c = table(spark, d, "customer").withColumn("n_nationkey", C("c_nationkey"))
    return J.lookup(c, table(spark, d, "nation").filter("n_nationkey < 20"), key="n_nationkey", name="n_name").groupBy("n_name").agg(F.count(F.lit(1)).alias("n"))


def page_frame_join(spark, d):
    """Aggregates joined back to the page frame."""
    p = _pages(spark, d)
    agg = p.groupBy("series").agg(F.count(F.lit(1)).alias("pages"), F.countDistinct("issue").alias("issues"))
    return p.join(agg, "series").select("page_id", "pages", "issues")


# windows


def book_position(spark, d):
    p = W.position_share(_pages(spark, d).filter("series is not null"), ["series", "issue"], [C("page_num").asc_nulls_last(), C("page_id")])
    return W.ends(p).select("page_id", "position", "n_pages", F.round("pos_share", 6).alias("pos_share"), "page_end")


def contiguous_blocks(spark, d):
    p = _pages(spark, d).join(_labels(spark, d), "page_id").filter("page_type is not null and series is not null")
    return W.blocks(p, ["series", "issue", "page_type"], "page_num")


def block_expand(spark, d):
    blocks = contiguous_blocks(spark, d)
    return W.expand(blocks, ["series", "issue"], label="page_type", precedence=["story", "cover", "advertisement", "credits", "art", "text"])


def label_runs(spark, d):
    p = _pages(spark, d).join(_labels(spark, d), "page_id", "left").filter("series is not null and page_num is not null")
    return W.label_runs(p, ["series", "issue"], ["page_num", "page_id"], "page_type")


def chunk_512(spark, d):
    return W.chunks(_pages(spark, d).select("page_id", "series"), ["series"], ["page_id"], 512)


def sliding_windows(spark, d):
    return W.sliding(_pages(spark, d).select("page_id", "series"), ["series"], ["page_id"], size=8, stride=4)


# duplicates


def exact_dedup(spark, d):
    return U.exact_groups(table(spark, d, "documents"), ident="doc_id", content=C("text")).select("doc_id", "digest", "canonical", "n")


def dropped_repeats(spark, d):
    kept, dropped = U.keep_first(table(spark, d, "page_vectors"), ["page_id"], [C("written_at").desc(), C("ingested_at"), C("std_id"), C("manifest_path")])
    k, x = kept.agg(F.count(F.lit(1)).alias("n")).withColumn("part", F.lit("kept")), dropped.agg(F.count(F.lit(1)).alias("n")).withColumn("part", F.lit("dropped"))
    return k.unionByName(x)


def repeated_keys(spark, d):
    im = table(spark, d, "coco_images").select("image_id", "file_name").distinct()
    return U.suffix_repeats(im, key="file_name", content=C("image_id")).select("image_id", "unique_key")


def key_offenders(spark, d):
    return U.offenders(table(spark, d, "page_vectors").select("page_id", "std_id", "ingested_at").distinct(), ["std_id"], tolerance=1, order=[C("page_id"), C("ingested_at")], samples=3).select("std_id", "page_id", "n", "sample")


def name_collisions(spark, d):
    s = table(spark, d, "page_vectors").select("series").filter("series is not null").distinct().withColumn("stem", F.trim(F.regexp_replace(F.lower("series"), r"\s*\(\d[\d-]*\)\s*$", "")))
    return s.groupBy("stem").agg(F.count(F.lit(1)).alias("n"), F.sort_array(F.collect_list("series")).alias("names")).filter("n > 1")


def _hashes(spark, d):
    docs = table(spark, d, "documents").filter("text is not null and trim(text) != ''").select(C("doc_id").alias("id"), "text")
    return materialize(spread(docs).mapInPandas(U.simhash, "id long, hash long"), "hashes")


def near_dedup(spark, d):
    """Every text with the leader of its group of near copies, and the number of other hash values it is linked to."""
    h = _hashes(spark, d)
    return U.leader_clusters(h, U.value_links(U.hash_values(h)))


def near_links(spark, d):
    """Links between hash values at most 6 bits apart; copies are one value, their texts are counted."""
    h = _hashes(spark, d)
    links = U.value_links(U.hash_values(h))
    return links.select(F.least("id_a", "id_b").alias("id_a"), F.greatest("id_a", "id_b").alias("id_b"), "distance", (C("n_a") + C("n_b")).alias("n_texts"))


def split_by_checksum(spark, d):
    s = table(spark, d, "page_vectors").filter("series is not null").select("series", "page_id").distinct()
    return U.split_hash(s, key="series", parts=4).groupBy("part").agg(F.countDistinct("series").alias("books"), F.count(F.lit(1)).alias("pages"))


def bucket_split(spark, d):
    s = table(spark, d, "page_vectors").filter("series is not null").select("series")
    return U.ranked_split(s, key="series", shares=[("train", 0.8), ("validation", 0.1), ("test", 0.1)]).groupBy("split").agg(F.count(F.lit(1)).alias("books"))


def union_splits(spark, d):
    """Parts of a table, one of them without a column, put together again."""
    docs = table(spark, d, "documents").select("doc_id", "lang", "n_chars")
    a, b = docs.filter("doc_id % 2 = 0"), docs.filter("doc_id % 2 = 1").drop("n_chars")
    return a.unionByName(b, allowMissingColumns=True)


_P = """pages AS (SELECT * FROM (SELECT page_id, series, issue, volume, page_num, source, manifest_path, std_id, written_at,
    row_number() OVER (PARTITION BY page_id ORDER BY written_at DESC, manifest_path DESC, series DESC NULLS LAST, issue DESC NULLS LAST, volume DESC NULLS LAST, page_num DESC NULLS LAST, source DESC NULLS LAST, std_id DESC) AS rn FROM page_vectors) WHERE rn = 1)"""
_L = """labels AS (SELECT page_id, page_type FROM (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY labeled_at DESC NULLS LAST, page_type DESC NULLS LAST) AS rn FROM page_labels) WHERE rn = 1)"""
_PARTS = r"string_split(replace(manifest_path, '\', '/'), '/')"
_LAST = rf"array_to_string(list_filter(string_split(replace({{0}}, '\', '/'), '/'), lambda x: x <> '')[-{{1}}:], '/')"
_TOK = r"regexp_replace(lower(trim(series)), '[\s_-]+', '_', 'g')"
_BLOCKS = f"""WITH {_P}, {_L}, j AS (SELECT p.series, p.issue, l.page_type, p.page_num FROM pages p JOIN labels l USING (page_id) WHERE l.page_type IS NOT NULL AND p.series IS NOT NULL AND p.page_num IS NOT NULL),
    n AS (SELECT *, row_number() OVER o AS k, CASE WHEN page_num = lag(page_num) OVER o + 1 THEN 0 ELSE 1 END AS fresh FROM j WINDOW o AS (PARTITION BY series, issue, page_type ORDER BY page_num)),
    r AS (SELECT *, sum(fresh) OVER (PARTITION BY series, issue, page_type ORDER BY k) AS run FROM n),
    blocks AS (SELECT series, issue, page_type, min(page_num) AS page_start, max(page_num) AS page_end, count(*) AS n FROM r GROUP BY series, issue, page_type, run)"""

_STEM = "CASE WHEN {0} LIKE '%.jpg.png' THEN left({0}, length({0}) - 8) WHEN {0} LIKE '%.png' OR {0} LIKE '%.jpg' THEN left({0}, length({0}) - 4) WHEN {0} LIKE '%.jpeg' THEN left({0}, length({0}) - 5) ELSE {0} END"
_NUM = r"CASE WHEN regexp_matches({0}, '(^|[^a-z0-9])[0-9]+[^a-z0-9]*$') THEN coalesce(nullif(ltrim(regexp_extract({0}, '([0-9]+)[^a-z0-9]*$', 1), '0'), ''), '0') END"

SQL = {
    "filename_resolution": rf"""WITH {_P}, p AS (SELECT page_id, lower({_PARTS}[-1]) AS name FROM pages), q AS (SELECT *, {_STEM.format("name")} AS stem FROM p),
        i AS (SELECT image_id, lower(max(file_name)) AS name FROM coco_images GROUP BY image_id), j AS (SELECT *, {_STEM.format("name")} AS stem FROM i),
        b AS (SELECT 0 AS n, 'name' AS rule, name AS k, page_id FROM q UNION ALL SELECT 1, 'stem', stem, page_id FROM q UNION ALL SELECT 2, 'alnum', regexp_replace(stem, '[^a-z0-9]+', '', 'g'), page_id FROM q
            UNION ALL SELECT 3, 'last number', {_NUM.format("stem")}, page_id FROM q),
        a AS (SELECT 0 AS n, name AS k, image_id FROM j UNION ALL SELECT 1, stem, image_id FROM j UNION ALL SELECT 2, regexp_replace(stem, '[^a-z0-9]+', '', 'g'), image_id FROM j UNION ALL SELECT 3, {_NUM.format("stem")}, image_id FROM j),
        g AS (SELECT n, rule, k, min(page_id) AS page_id, count(DISTINCT page_id) AS n_candidates FROM b WHERE k <> '' GROUP BY ALL),
        r AS (SELECT a.image_id, g.*, row_number() OVER (PARTITION BY image_id ORDER BY g.n) AS rn FROM a JOIN g ON a.n = g.n AND a.k = g.k) SELECT image_id, page_id, rule, n_candidates FROM r WHERE rn = 1""",
    "bucket_split": """WITH k AS (SELECT DISTINCT series FROM page_vectors WHERE series IS NOT NULL), r AS (SELECT *, row_number() OVER (ORDER BY md5('42:' || series), series) AS rn, count(*) OVER () AS n FROM k)
        SELECT CASE WHEN rn <= floor(n * 0.8) THEN 'train' WHEN rn <= floor(n * 0.9) THEN 'validation' ELSE 'test' END AS split, count(*) AS books FROM r GROUP BY 1""",
    "resume_anti": "SELECT DISTINCT page_id FROM page_vectors WHERE page_id NOT IN (SELECT page_id FROM page_labels WHERE page_id IS NOT NULL)",
    "resume_composite": "SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem a WHERE NOT EXISTS (SELECT 1 FROM lineitem b WHERE b.l_linestatus = 'F' AND a.l_orderkey = b.l_orderkey AND a.l_linenumber = b.l_linenumber)",
    "split_train_val": f"WITH {_P}, {_L} SELECT CASE WHEN l.page_type = 'cover' THEN 'val' WHEN l.page_type = 'story' THEN 'train' ELSE 'neither' END AS split, count(*) AS n FROM pages p LEFT JOIN labels l USING (page_id) GROUP BY 1",
    "suffix_bridge": f"""WITH {_P}, k AS (SELECT DISTINCT {_LAST.format("manifest_path", 2)} AS suffix FROM pages WHERE page_id % 3 = 0),
        f AS (SELECT page_id, unnest(range(len(p))) AS priority, array_to_string(p[unnest(range(len(p))) + 1:], '/') AS suffix FROM (SELECT page_id, {_PARTS} AS p FROM pages)),
        h AS (SELECT f.*, row_number() OVER (PARTITION BY page_id ORDER BY priority) AS rn, count(*) OVER (PARTITION BY page_id) AS n_candidates FROM f JOIN k USING (suffix)) SELECT page_id, suffix, priority, n_candidates FROM h WHERE rn = 1""",
    "variant_join": f"""WITH {_P}, b AS (SELECT page_id, concat_ws('|', {_TOK}, issue) AS base, page_num FROM pages WHERE series IS NOT NULL AND page_num IS NOT NULL),
        k AS (SELECT DISTINCT base || '_p' || lpad(page_num::VARCHAR, greatest(3, 3), '0') AS variant FROM b),
        v AS (SELECT page_id, base || '_p' || form AS variant, pos FROM (SELECT page_id, base, unnest([page_num::VARCHAR, lpad(page_num::VARCHAR, 2, '0'), lpad(page_num::VARCHAR, 3, '0'), lpad(page_num::VARCHAR, 4, '0'), lpad(page_num::VARCHAR, 5, '0')]) AS form, unnest(range(5)) AS pos FROM b)),
        u AS (SELECT page_id, variant, row_number() OVER (PARTITION BY page_id ORDER BY min(pos)) - 1 AS priority FROM v GROUP BY page_id, variant),
        h AS (SELECT u.*, row_number() OVER (PARTITION BY page_id ORDER BY priority) AS rn, count(*) OVER (PARTITION BY page_id) AS n_candidates FROM u JOIN k USING (variant)) SELECT page_id, variant, priority, n_candidates FROM h WHERE rn = 1""",
    "path_lookup_cascade": rf"""WITH {_P}, a AS (SELECT page_id AS ask, CASE page_id % 3 WHEN 0 THEN manifest_path WHEN 1 THEN upper(manifest_path) ELSE '/mnt/copy/' || {_LAST.format("manifest_path", 3)} END AS asked FROM pages),
        m AS (SELECT ask, 0 AS n, 'exact' AS rule, page_id FROM a JOIN pages ON asked = manifest_path UNION ALL SELECT ask, 1, 'normal', page_id FROM a JOIN pages ON lower(replace(asked, '\', '/')) = lower(replace(manifest_path, '\', '/'))
        UNION ALL SELECT ask, 2, 'last parts', page_id FROM a JOIN pages ON lower({_LAST.format("asked", 3)}) = lower({_LAST.format("manifest_path", 3)})),
        g AS (SELECT ask, n, rule, min(page_id) AS page_id, count(DISTINCT page_id) AS n_candidates FROM m GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY ask ORDER BY n) AS rn FROM g)
        SELECT ask, page_id, rule, n_candidates FROM r WHERE rn = 1""",
    "substring_join": r"""WITH s AS (SELECT DISTINCT lower(trim(series)) AS s FROM page_vectors WHERE trim(series) <> '')
        SELECT x.s AS a, y.s AS b FROM s x, s y WHERE x.s < y.s AND regexp_extract(x.s, '^(?:the )?([^ ]*)', 1) = regexp_extract(y.s, '^(?:the )?([^ ]*)', 1) AND (contains(x.s, y.s) OR contains(y.s, x.s))""",
    "label_chain_reasons": f"""WITH {_P}, {_L} SELECT CASE WHEN l.page_type IS DISTINCT FROM 'story' THEN 'skipped: label' WHEN page_num IS NULL THEN 'skipped: page number'
        WHEN series IS NULL OR series NOT IN (SELECT series FROM documents WHERE series IS NOT NULL) THEN 'skipped: text' ELSE 'added' END AS reason, count(*) AS n FROM pages p LEFT JOIN labels l USING (page_id) GROUP BY 1""",
    "three_way_compare": """WITH c AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL) SELECT v.user_id, v.n AS views, c.n AS clicks, p.n AS purchases FROM (SELECT * FROM c WHERE event_type = 'view') v
        LEFT JOIN (SELECT * FROM c WHERE event_type = 'click') c USING (user_id) LEFT JOIN (SELECT * FROM c WHERE event_type = 'purchase') p USING (user_id)""",
    "presence_audit": """WITH a AS (SELECT DISTINCT series, true AS in_a FROM page_vectors), b AS (SELECT DISTINCT series, true AS in_b FROM documents)
        SELECT coalesce(in_a, false) AS in_a, coalesce(in_b, false) AS in_b, count(*) AS n FROM a FULL JOIN b USING (series) GROUP BY ALL""",
    "category_lookup": "SELECT coalesce(n_name, c_nationkey::VARCHAR) AS n_name, count(*) AS n FROM customer LEFT JOIN (SELECT * FROM nation WHERE n_nationkey < 20) ON n_nationkey = c_nationkey GROUP BY 1",
    "page_frame_join": f"WITH {_P}, a AS (SELECT series, count(*) AS pages, count(DISTINCT issue) AS issues FROM pages GROUP BY series) SELECT page_id, a.pages, issues FROM pages p JOIN a USING (series)",
    "book_position": f"""WITH {_P}, r AS (SELECT page_id, row_number() OVER (PARTITION BY series, issue ORDER BY page_num NULLS LAST, page_id) AS position, count(*) OVER (PARTITION BY series, issue) AS n_pages FROM pages WHERE series IS NOT NULL)
        SELECT *, round((position - 1) / greatest(1, n_pages - 1), 6) AS pos_share, CASE WHEN position = 1 THEN 'cover' WHEN position = n_pages THEN 'back_cover' END AS page_end FROM r""",
    "contiguous_blocks": _BLOCKS + " SELECT * FROM blocks",
    "block_expand": _BLOCKS
    + """, e AS (SELECT series, issue, page_type, unnest(generate_series(page_start, page_end)) AS page FROM blocks),
        o AS (SELECT *, coalesce(list_position(['story', 'cover', 'advertisement', 'credits', 'art', 'text'], page_type), 0) AS k FROM e),
        w AS (SELECT *, row_number() OVER (PARTITION BY series, issue, page ORDER BY k DESC, page_type DESC) AS rn FROM o) SELECT series, issue, page, page_type FROM w WHERE rn = 1""",
    "label_runs": f"""WITH {_P}, {_L}, j AS (SELECT series, issue, page_num, page_id, page_type FROM pages LEFT JOIN labels USING (page_id) WHERE series IS NOT NULL AND page_num IS NOT NULL),
        n AS (SELECT *, row_number() OVER o AS k, CASE WHEN row_number() OVER o > 1 AND page_type IS NOT DISTINCT FROM lag(page_type) OVER o THEN 0 ELSE 1 END AS fresh FROM j WINDOW o AS (PARTITION BY series, issue ORDER BY page_num, page_id)),
        r AS (SELECT *, sum(fresh) OVER (PARTITION BY series, issue ORDER BY k) AS run FROM n)
        SELECT series, issue, run, page_type, min(page_num) AS first, max(page_num) AS last, count(*) AS n FROM r GROUP BY series, issue, run, page_type""",
    "chunk_512": f"WITH {_P} SELECT page_id, series, (row_number() OVER w - 1) // 512 AS chunk, (row_number() OVER w - 1) % 512 AS slot FROM pages WINDOW w AS (PARTITION BY series ORDER BY page_id)",
    "sliding_windows": f"""WITH {_P}, r AS (SELECT page_id, series, row_number() OVER (PARTITION BY series ORDER BY page_id) - 1 AS k, count(*) OVER (PARTITION BY series) AS n FROM pages),
        w AS (SELECT *, unnest(generate_series(0, greatest(ceil((n - 8) / 4)::BIGINT, 0))) AS window FROM r) SELECT page_id, series, "window", k - "window" * 4 AS slot FROM w WHERE k - "window" * 4 BETWEEN 0 AND 7""",
    "exact_dedup": "SELECT doc_id, md5(text) AS digest, min(doc_id) OVER (PARTITION BY md5(text)) AS canonical, count(*) OVER (PARTITION BY md5(text)) AS n FROM documents WHERE text IS NOT NULL",
    "dropped_repeats": "SELECT 'kept' AS part, count(DISTINCT page_id) AS n FROM page_vectors UNION ALL SELECT 'dropped', count(*) - count(DISTINCT page_id) FROM page_vectors",
    "repeated_keys": "SELECT image_id, CASE WHEN count(*) OVER (PARTITION BY file_name) > 1 THEN file_name || '_' || left(sha1(image_id), 8) ELSE file_name END AS unique_key FROM (SELECT DISTINCT image_id, file_name FROM coco_images)",
    "key_offenders": """WITH c AS (SELECT std_id, page_id, count(*) OVER (PARTITION BY std_id) AS n, row_number() OVER (PARTITION BY std_id ORDER BY page_id, ingested_at) AS sample FROM (SELECT DISTINCT page_id, std_id, ingested_at FROM page_vectors))
        SELECT std_id, page_id, n, sample FROM c WHERE n > 1 AND sample <= 3""",
    "name_collisions": r"""SELECT stem, count(*) AS n, list_sort(list(series)) AS names FROM (SELECT series, trim(regexp_replace(lower(series), '\s*\(\d[\d-]*\)\s*$', '')) AS stem FROM (SELECT DISTINCT series FROM page_vectors WHERE series IS NOT NULL)) GROUP BY stem HAVING count(*) > 1""",
    "union_splits": "SELECT doc_id, lang, CASE WHEN doc_id % 2 = 0 THEN n_chars END AS n_chars FROM documents",
}

QUERIES = {
    f.__name__: f
    for f in (
        resume_anti, resume_composite, split_train_val, suffix_bridge, variant_join, path_lookup_cascade, filename_resolution, substring_join, label_chain_reasons,
        three_way_compare, presence_audit, category_lookup, page_frame_join, book_position, contiguous_blocks, block_expand, label_runs, chunk_512, sliding_windows,
        exact_dedup, dropped_repeats, repeated_keys, key_offenders, name_collisions, near_dedup, near_links, split_by_checksum, bucket_split, union_splits,
    )
}
