"""Key normalisation, id parsing and filters, with SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from foliolake.functions import keys as K
from foliolake.operators import filters as P
from foliolake.runtime import table

C = F.col


def _paths(spark, d):
    return table(spark, d, "page_vectors").select("page_id", "manifest_path", "source", "std_id").distinct()


def key_normalise(spark, d):
    p = table(spark, d, "coco_images").select("image_id", "file_name").distinct()
    key = F.concat(F.lit("scans/ink/"), C("file_name"))
    front = ("scans/", "ink/")
    return p.select("image_id", K.normal_key(key, front).alias("every_prefix"), K.normal_key(key, front, first_only=True).alias("first_prefix"), K.without_suffix(C("file_name")).alias("stem"))


def series_names(spark, d):
    s = table(spark, d, "page_vectors").select("series").filter("series is not null").distinct()
    return s.select("series", K.series_name(C("series")).alias("clean"), K.volume_of(C("series")).alias("volume"))


def standard_ids(spark, d):
    p = _paths(spark, d)
    return p.select("page_id", "manifest_path", "source", K.standard_id(C("manifest_path"), F.coalesce("source", F.lit("none"))).alias("made_id"))


def id_parts(spark, d):
    i = _paths(spark, d).select("std_id").distinct()
    return i.select(
        "std_id", K.id_series(C("std_id")).alias("series"), K.id_part(C("std_id"), 3, "unknown").alias("volume"), K.id_part(C("std_id"), 2, "000").alias("issue"),
        K.id_part(C("std_id"), 1, "p000").alias("page"),
    )


def path_metadata(spark, d):
    p = _paths(spark, d).select("manifest_path").distinct()
    x = C("manifest_path")
    return p.select("manifest_path", K.source_of(x, ("storefront", "calibre", "inkvault", "scans")).alias("from_source"), K.book_folder(x).alias("book"), K.issue_of(x).alias("issue"), K.page_of(x).alias("page"))


def page_numbers(spark, d):
    p = _paths(spark, d).select("manifest_path").distinct()
    return p.select("manifest_path", K.page_number(C("manifest_path")).alias("page_num"), K.shown_page(F.translate("manifest_path", "\\", "/")).alias("shown"), K.trailing_number(C("manifest_path")).alias("last_number"))


def path_converters(spark, d):
    p = _paths(spark, d).select("manifest_path").distinct()
    x = C("manifest_path")
    return p.select("manifest_path", K.to_posix(x).alias("posix"), K.to_windows(K.to_posix(x)).alias("windows"), K.without_scheme(x).alias("object_key"))


def safe_keys(spark, d):
    p = table(spark, d, "coco_images").select("file_name").distinct()
    x = C("file_name")
    return p.select("file_name", K.alnum_key(x).alias("alnum"), K.safe_name(x).alias("safe"), K.all_digits(x).cast("string").alias("digits"), K.token(x).alias("token"), K.undoubled(K.token(K.without_suffix(x))).alias("undoubled"))


def uri_encode(spark, d):
    p = _paths(spark, d).select("manifest_path").distinct()
    return p.select("manifest_path", K.uri_key(F.translate("manifest_path", "\\", "/")).alias("uri"))


def key_variants(spark, d):
    p = table(spark, d, "page_vectors").filter("page_num is not null and series is not null").select("series", "page_num").distinct()
    v = K.padded_variants(K.token(C("series")), C("page_num"))
    return p.select("series", "page_num", F.posexplode(v).alias("priority", "variant"))


def path_suffixes(spark, d):
    p = _paths(spark, d).select("manifest_path").distinct()
    return p.select("manifest_path", F.posexplode(K.suffixes_of(C("manifest_path"))).alias("cut", "suffix"))


def last_three_parts(spark, d):
    p = _paths(spark, d).select("manifest_path").distinct()
    return p.select("manifest_path", K.last_parts(C("manifest_path")).alias("signature"))


def filter_meta(spark, d):
    docs = table(spark, d, "documents")
    return P.by_metadata(docs, {"lang": ["en", "fr"], "source": "vlm_summary", "no_such_column": 1}).select("doc_id", "lang", "source", "n_chars")


def keyword_search(spark, d):
    docs = table(spark, d, "documents")
    return P.keyword_search(docs, "captain", 20, order=["doc_id"]).select("doc_id", "lang")


def text_search_counts(spark, d):
    docs = table(spark, d, "documents")
    return docs.groupBy("source").agg(
        F.sum(P.holds_text(C("text"), "Lantern").cast("int")).alias("any_case"), F.sum(P.holds_text(C("text"), "Lantern", case=True).cast("int")).alias("same_case")
    )


def id_search(spark, d):
    return P.id_search(_paths(spark, d), "v01\\002", ident="manifest_path").select("page_id", "manifest_path")


def text_exists_filter(spark, d):
    """Series of which some text holds a word: a semi join."""
    docs = table(spark, d, "documents").filter(P.holds_text(C("text"), "lantern")).select("series")
    return table(spark, d, "page_vectors").join(docs, "series", "left_semi").groupBy("series").agg(F.count(F.lit(1)).alias("n"))


def junk_audit(spark, d):
    p = table(spark, d, "coco_images").select(F.concat(F.when(F.ascii(F.md5("image_id")) % 3 == 0, "__MACOSX/._").when(F.ascii(F.md5("image_id")) % 3 == 1, "a/._").otherwise("a/"), "file_name").alias("path"))
    return p.groupBy(P.junk_reason(C("path")).alias("reason")).agg(F.count(F.lit(1)).alias("n"), F.sum(P.is_junk_path(C("path")).cast("int")).alias("junk"))


def disagreements(spark, d):
    im = table(spark, d, "coco_images").groupBy("file_name").agg(F.min("rcnn_panels").alias("a"), F.max("rcnn_panels").alias("b"))
    return im.filter(P.disagree(C("a"), C("b"))).select("file_name", "a", "b")


def label_thresholds(spark, d):
    lab = table(spark, d, "page_labels")
    ok = P.confident(C("page_type"), C("page_type_conf"), {"story": 0.8, "cover": 0.6}, default=0.7)
    strict = P.confident(C("page_type"), C("page_type_conf"), {"story": 0.8, "cover": 0.6}, default=0.7, strict=True)
    return lab.filter("not isnan(page_type_conf)").groupBy("page_type").agg(F.sum(ok.cast("int")).alias("at_least"), F.sum(strict.cast("int")).alias("above"), F.count(F.lit(1)).alias("n"))


def sequence_lengths(spark, d):
    """Issues of between 10 and 30 pages."""
    n = table(spark, d, "page_vectors").groupBy("series", "issue").agg(F.countDistinct("page_id").alias("pages"))
    return n.filter(C("pages").between(10, 30))


def skip_reasons(spark, d):
    im = table(spark, d, "coco_images")
    checks = [("no size", C("width").isNotNull()), ("no panels", C("rcnn_panels") > 0), ("no text", C("text_coverage") > 0.2)]
    return P.with_reasons(im, checks).groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


_V = r"(v\d+|\(\d{4}-\d{4}\)|\d{4})"
_PARTS = r"string_split(replace(manifest_path, '\', '/'), '/')"
_PATHS = "(SELECT DISTINCT page_id, manifest_path, source, std_id FROM page_vectors)"
_MP = "(SELECT DISTINCT manifest_path FROM page_vectors)"


def _x(text: str, pattern: str, default: str, lead: str = "") -> str:
    got = f"nullif(regexp_extract({text}, '{pattern}', 1), '')"
    return f"coalesce('{lead}' || {got}, '{default}')" if lead else f"coalesce({got}, '{default}')"


def _clean(x: str) -> str:
    return rf"lower(regexp_replace(trim(regexp_replace(regexp_replace({x}, '\s+{_V}', '', 'g'), '[^\p{{L}}\p{{N}}_\s]', '', 'g')), '\s+', '_', 'g'))"


_STEM = "CASE WHEN lower({0}) LIKE '%.jpg.png' THEN left({0}, length({0}) - 8) WHEN lower({0}) LIKE '%.png' OR lower({0}) LIKE '%.jpg' THEN left({0}, length({0}) - 4) WHEN lower({0}) LIKE '%.jpeg' THEN left({0}, length({0}) - 5) ELSE {0} END"
_TOKEN = r"regexp_replace(lower(trim({0})), '[\s_-]+', '_', 'g')"

SQL = {
    "key_normalise": f"""SELECT image_id, replace(replace({_STEM.format("lower(file_name)")}, '/', '_'), '\\', '_') AS every_prefix,
        'ink_' || replace(replace({_STEM.format("lower(file_name)")}, '/', '_'), '\\', '_') AS first_prefix, {_STEM.format("file_name")} AS stem
        FROM (SELECT DISTINCT image_id, file_name FROM coco_images)""",
    "series_names": f"""SELECT series, {_clean("series")} AS clean, {_x("series", _V, "unknown")} AS volume FROM (SELECT DISTINCT series FROM page_vectors WHERE series IS NOT NULL)""",
    "standard_ids": f"""SELECT page_id, manifest_path, source, CASE WHEN len(p) >= 2 THEN concat_ws('_', s, {_clean("p[-2]")}, {_x("p[-2]", _V, "unknown")}, {_x("p[-1]", r"(\d{3})", "000")},
        {_x("p[-1]", r"p(\d{3})", "p000", "p")}) ELSE s || '_unknown_unknown_000_p000' END AS made_id FROM (SELECT *, {_PARTS} AS p, coalesce(source, 'none') AS s FROM {_PATHS})""",
    "id_parts": """SELECT std_id, array_to_string(p[2:len(p) - 3], '_') AS series, p[-3] AS volume, p[-2] AS issue, p[-1] AS page
        FROM (SELECT std_id, string_split(std_id, '_') AS p FROM (SELECT DISTINCT std_id FROM page_vectors))""",
    "path_metadata": rf"""SELECT manifest_path, CASE WHEN contains(lower(manifest_path), 'storefront') THEN 'storefront' WHEN contains(lower(manifest_path), 'calibre') THEN 'calibre'
        WHEN contains(lower(manifest_path), 'inkvault') THEN 'inkvault' WHEN contains(lower(manifest_path), 'scans') THEN 'scans' ELSE 'unknown' END AS from_source,
        CASE WHEN len(p) >= 3 AND lower(p[-2]) IN ('jpg4cbz', 'pages', 'page') THEN p[-3] WHEN len(p) >= 2 THEN p[-2] ELSE '' END AS book,
        {_x("manifest_path", r"(\d{3})", "000")} AS issue, {_x("manifest_path", r"p(\d{3})", "p000", "p")} AS page FROM (SELECT manifest_path, {_PARTS} AS p FROM {_MP})""",
    "page_numbers": rf"""WITH s AS (SELECT manifest_path, regexp_replace(regexp_replace(lower(({_PARTS})[-1]), '\.[^.]*$', ''), '\.[a-z0-9]+$', '') AS stem, regexp_replace(({_PARTS})[-1], '\.[^.]*$', '') AS raw FROM {_MP}),
        g AS (SELECT *, coalesce(nullif(regexp_extract(raw, '(?i)page[_\- ]?(\d+)$', 1), ''), nullif(regexp_extract(raw, '(?i)p(\d+)$', 1), ''), nullif(regexp_extract(raw, '[_\- ](\d+)$', 1), '')) AS digits FROM s)
        SELECT manifest_path, regexp_extract_all(stem || '.', '(\d{{1,6}})[^0-9a-z]', 1)[-1]::INT AS page_num,
        CASE WHEN digits IS NULL THEN '' ELSE coalesce(nullif(ltrim(digits, '0'), ''), '0') END AS shown, nullif(regexp_extract(manifest_path, '(\d+)\D*$', 1), '')::INT AS last_number FROM g""",
    "path_converters": r"""WITH p AS (SELECT manifest_path, regexp_extract(manifest_path, '^([A-Za-z]):', 1) AS drive, replace(regexp_replace(manifest_path, '^[A-Za-z]:', ''), '\', '/') AS rest FROM """
    + _MP
    + r"""), q AS (SELECT *, CASE WHEN drive <> '' THEN '/mnt/' || lower(drive) || rest ELSE rest END AS posix FROM p)
        SELECT manifest_path, posix, CASE WHEN regexp_matches(posix, '^/mnt/[a-z]/') THEN upper(posix[6]) || ':' || replace(posix[7:], '/', '\') ELSE replace(posix, '/', '\') END AS windows,
        regexp_replace(manifest_path, '^[a-z0-9]+://', '') AS object_key FROM q""",
    "safe_keys": rf"""WITH t AS (SELECT file_name, {_TOKEN.format("file_name")} AS token, string_split({_TOKEN.format("(" + _STEM.format("file_name") + ")")}, '_') AS p FROM (SELECT DISTINCT file_name FROM coco_images))
        SELECT file_name, regexp_replace(lower(file_name), '[^a-z0-9]+', '', 'g') AS alnum, trim(regexp_replace(regexp_replace(file_name, '[^A-Za-z0-9._-]+', '_', 'g'), '_+', '_', 'g'), '_') AS safe,
        coalesce(nullif(ltrim(regexp_replace(file_name, '\D', '', 'g'), '0'), ''), '0') AS digits, token,
        CASE WHEN len(p) % 2 = 0 AND p[1:len(p) // 2] = p[len(p) // 2 + 1:] THEN array_to_string(p[1:len(p) // 2], '_') ELSE array_to_string(p, '_') END AS undoubled FROM t""",
    "uri_encode": rf"SELECT manifest_path, replace(url_encode(replace(manifest_path, '\', '/')), '%2F', '/') AS uri FROM {_MP}",
    "key_variants": rf"""WITH p AS (SELECT DISTINCT series, page_num FROM page_vectors WHERE page_num IS NOT NULL AND series IS NOT NULL),
        f AS (SELECT series, page_num, unnest([page_num::VARCHAR, lpad(page_num::VARCHAR, 2, '0'), lpad(page_num::VARCHAR, 3, '0'), lpad(page_num::VARCHAR, 4, '0'), lpad(page_num::VARCHAR, 5, '0')]) AS form, unnest(range(5)) AS pos FROM p),
        u AS (SELECT series, page_num, form, min(pos) AS pos FROM f GROUP BY ALL)
        SELECT series, page_num, row_number() OVER (PARTITION BY series, page_num ORDER BY pos) - 1 AS priority, {_TOKEN.format("series")} || '_p' || form AS variant FROM u""",
    "path_suffixes": f"SELECT manifest_path, unnest(range(len(p))) AS cut, array_to_string(p[unnest(range(len(p))) + 1:], '/') AS suffix FROM (SELECT manifest_path, {_PARTS} AS p FROM {_MP})",
    "last_three_parts": f"SELECT manifest_path, array_to_string(p[greatest(len(p) - 2, 1):], '/') AS signature FROM (SELECT manifest_path, list_filter({_PARTS}, lambda x: x <> '') AS p FROM {_MP})",
    "filter_meta": "SELECT doc_id, lang, source, n_chars FROM documents WHERE lang IN ('en', 'fr') AND source = 'vlm_summary'",
    "keyword_search": "SELECT doc_id, lang FROM documents WHERE contains(lower(text), 'captain') ORDER BY doc_id LIMIT 20",
    "text_search_counts": """SELECT source, sum(coalesce(contains(lower(text), 'lantern'), false)::INT) AS any_case, sum(coalesce(contains(text, 'Lantern'), false)::INT) AS same_case FROM documents GROUP BY source""",
    "id_search": rf"SELECT page_id, manifest_path FROM {_PATHS} WHERE contains(replace(lower(manifest_path), '\', '/'), 'v01/002')",
    "text_exists_filter": "SELECT series, count(*) AS n FROM page_vectors p WHERE EXISTS (SELECT 1 FROM documents q WHERE q.series = p.series AND contains(lower(q.text), 'lantern')) GROUP BY series",
    "junk_audit": """SELECT CASE ascii(md5(image_id)) % 3 WHEN 0 THEN '__MACOSX' WHEN 1 THEN '._' END AS reason, count(*) AS n, sum((ascii(md5(image_id)) % 3 < 2)::INT) AS junk FROM coco_images GROUP BY 1""",
    "disagreements": "SELECT * FROM (SELECT file_name, min(rcnn_panels) AS a, max(rcnn_panels) AS b FROM coco_images GROUP BY 1) WHERE a IS NULL OR b IS NULL OR a <> b",
    "label_thresholds": """SELECT page_type, sum((page_type_conf >= bar)::INT) AS at_least, sum((page_type_conf > bar)::INT) AS above, count(*) AS n
        FROM (SELECT *, CASE page_type WHEN 'story' THEN 0.8 WHEN 'cover' THEN 0.6 ELSE 0.7 END::DOUBLE AS bar FROM page_labels WHERE NOT coalesce(isnan(page_type_conf), false)) GROUP BY page_type""",
    "sequence_lengths": "SELECT series, issue, count(DISTINCT page_id) AS pages FROM page_vectors GROUP BY ALL HAVING count(DISTINCT page_id) BETWEEN 10 AND 30",
    "skip_reasons": """SELECT CASE WHEN width IS NULL THEN 'no size' WHEN rcnn_panels IS NULL OR rcnn_panels <= 0 THEN 'no panels' WHEN text_coverage IS NULL OR text_coverage <= 0.2 THEN 'no text' ELSE 'added' END AS reason,
        count(*) AS n FROM coco_images GROUP BY 1""",
}

QUERIES = {
    f.__name__: f
    for f in (
        key_normalise, series_names, standard_ids, id_parts, path_metadata, page_numbers, path_converters, safe_keys, uri_encode, key_variants, path_suffixes,
        last_three_parts, filter_meta, keyword_search, text_search_counts, id_search, text_exists_filter, junk_audit, disagreements, label_thresholds,
        sequence_lengths, skip_reasons,
    )
}
