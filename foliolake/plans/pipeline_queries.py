"""Incremental runs, streams, engine hooks and the query API, with SQL where SQL says the same."""

from __future__ import annotations

from pyspark.sql import functions as F

from foliolake.catalog import Corpus
from foliolake.operators import hooks, incremental
from foliolake.plans.relational_queries import _L, _P, _labels, _pages
from foliolake.runtime import materialize, shared_dir, table
from foliolake.streaming import pages as stream

C = F.col


def incremental_upsert(spark, d):
    """Two deliveries of events into one table, the second with corrections of the first: the latest by user and type stays."""
    e = table(spark, d, "events")
    keys, order = ["user_id", "event_type"], [C("ts").desc_nulls_last(), C("event_id").desc()]
    span = e.agg(F.min("ts").alias("a"), F.max("ts").alias("b")).first()
    if span["a"] is None:
        return incremental.upsert(None, e, keys, order).select("user_id", "event_type", "event_id", "value")
    day = (span["b"] - span["a"]) / 10
    # The deliveries overlap by two tenths of the time; events of no time come in the second.
    first = incremental.upsert(None, e.filter(C("ts") < span["a"] + 6 * day), keys, order)
    second = e.filter(C("ts").isNull() | (C("ts") >= span["a"] + 4 * day))
    return incremental.upsert(first, second, keys, order).select("user_id", "event_type", "event_id", "value")


def key_collisions(spark, d):
    p = table(spark, d, "coco_images").select("file_name").distinct()
    return incremental.collisions(p, ["file_name"], F.lower(F.regexp_replace("file_name", r"\.[^.]*$", "")), [C("file_name")])


def stream_page_metrics(spark, d):
    """The stream over all documents, run until it has seen them; equal to the batch result."""
    import uuid

    base = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    schema = table(spark, d, "vlm_docs").schema
    q = stream.refresh(spark, f"{d}/vlm_docs.parquet*", f"{base}/out", f"{base}/checkpoint", schema=schema)
    q.awaitTermination()
    if q.exception() is not None:
        raise q.exception()
    return spark.read.parquet(f"{base}/out/metrics").drop("batch")


def page_metrics(spark, d):
    return stream.page_metrics(table(spark, d, "vlm_docs"))


def windowed_events(spark, d):
    w = stream.windowed_events(table(spark, d, "events").withColumn("ts", C("ts").cast("timestamp")))
    return w.select(C("window.start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


def user_sessions(spark, d):
    s = stream.sessions(table(spark, d, "events").withColumn("ts", C("ts").cast("timestamp")), gap="6 hours")
    return s.select("user_id", C("session_window.start").cast("timestamp_ntz").alias("start"), "n")


def _length_engine(row: dict) -> dict:
    """Stub engine: refuses blank texts, else counts."""
    text = row["text"] or ""
    if not text.strip():
        raise ValueError("blank page")
    return {"n_words": len(text.split()), "first": text.split()[0]}


def _fallback_engine(row: dict) -> dict:
    return {"n_words": 0, "first": None}


def engine_run(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text")
    return hooks.escalate(docs, [_length_engine, _fallback_engine], "n_words int, first string", key="doc_id").select("doc_id", "n_words", "status", "step")


def text_meaning(spark, d):
    """Texts nearest to a query under the stub encoder."""
    docs = table(spark, d, "documents").select("doc_id", "text")
    enc = materialize(hooks.encode(docs, ident="doc_id", text="text"), "encoded")
    c = Corpus(table(spark, d, "page_vectors"), docs)
    return c.meaning("the captain trades the brass key for a lantern", enc, 10).withColumn("similarity", F.round("similarity", 6))


def task_samples(spark, d):
    return hooks.task_samples(_pages(spark, d).select("page_id", (C("page_id") % 7).cast("int").alias("panels")))


def shuffled_stories(spark, d):
    p = _pages(spark, d).join(_labels(spark, d), "page_id").filter("series is not null and page_num is not null and page_type is not null")
    p = p.select("page_id", "series", "issue", "page_type", C("page_num").alias("position"))
    return hooks.shuffled_stories(p, ["series", "issue"]).select("page_id", "position", "new_position")


def _corpus(spark, d):
    return Corpus(table(spark, d, "page_vectors"), table(spark, d, "documents"))


def catalog_details(spark, d):
    first = _pages(spark, d).agg(F.min("page_id").alias("page_id"))
    p = table(spark, d, "page_vectors").join(first, "page_id", "left_semi")
    return p.join(_labels(spark, d), "page_id", "left").select("page_id", "std_id", "series", "issue", "page_num", "page_type").distinct()


def catalog_similar(spark, d):
    c = Corpus(_pages(spark, d).join(table(spark, d, "page_vectors").select("page_id", "written_at", "page_embeddings"), ["page_id", "written_at"]).dropDuplicates(["page_id"]))
    ask = c.pages.filter("size(page_embeddings) = 64").agg(F.min("page_id")).first()[0]
    return c.similar(ask, 10, source=["press_kit", "storefront"]).withColumn("similarity", F.round("similarity", 6))


def catalog_analyze(spark, d):
    return _corpus(spark, d).analyze("Harbor Lantern")


def catalog_find(spark, d):
    return _corpus(spark, d).find("v01_002_p00").distinct()


SQL = {
    "incremental_upsert": """SELECT user_id, event_type, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC NULLS LAST, event_id DESC) AS rn FROM events) WHERE rn = 1""",
    "task_samples": f"""WITH {_P}, k AS (SELECT page_id, page_id % 7 AS panels FROM pages) SELECT page_id, 'reading_order' AS task, NULL::INT AS subject FROM k WHERE panels >= 2
        UNION ALL SELECT page_id, 'panel_picking', (('0x' || left(md5('42:panel_picking:' || page_id), 8))::BIGINT % panels)::INT FROM k WHERE panels >= 2
        UNION ALL SELECT page_id, 'closure', (('0x' || left(md5('42:closure:' || page_id), 8))::BIGINT % (panels - 2) + 1)::INT FROM k WHERE panels >= 4""",
    "shuffled_stories": f"""WITH {_P}, {_L}, p AS (SELECT page_id, series, issue, page_type, page_num AS position FROM pages JOIN labels USING (page_id) WHERE series IS NOT NULL AND page_num IS NOT NULL AND page_type IS NOT NULL),
        s AS (SELECT *, row_number() OVER (PARTITION BY series, issue ORDER BY position, page_id) AS place, row_number() OVER (PARTITION BY series, issue ORDER BY md5('42:' || page_id), page_id) AS ord FROM p WHERE page_type = 'story')
        SELECT page_id, position, position AS new_position FROM p WHERE page_type <> 'story'
        UNION ALL SELECT a.page_id, a.position, b.position FROM s a JOIN s b ON a.series = b.series AND a.issue IS NOT DISTINCT FROM b.issue AND a.ord = b.place""",
    "key_collisions": r"""SELECT file_name, normal_key FROM (SELECT *, row_number() OVER (PARTITION BY normal_key ORDER BY file_name) AS rn FROM (SELECT DISTINCT file_name, lower(regexp_replace(file_name, '\.[^.]*$', '')) AS normal_key FROM coco_images)) WHERE rn > 1""",
    "windowed_events": "SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL",
    "user_sessions": """WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
        s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM g) SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, k""",
    "engine_run": """SELECT doc_id, CASE WHEN trim(coalesce(text, ''), ' ' || chr(9) || chr(10) || chr(13) || chr(12) || chr(160) || chr(12288)) = '' THEN 0 ELSE len(list_filter(regexp_split_to_array(text, '[\\s\\x{00a0}\\x{0085}\\x{3000}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{001c}-\\x{001f}]+'), lambda x: x <> '')) END AS n_words, 'ok' AS status,
        (trim(coalesce(text, ''), ' ' || chr(9) || chr(10) || chr(13) || chr(12) || chr(160) || chr(12288)) = '')::INT AS step FROM documents""",
    "catalog_details": f"""WITH {_P}, l AS (SELECT page_id, page_type FROM (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY labeled_at DESC NULLS LAST, page_type DESC NULLS LAST) AS rn FROM page_labels) WHERE rn = 1)
        SELECT DISTINCT v.page_id, v.std_id, v.series, v.issue, v.page_num, page_type FROM page_vectors v LEFT JOIN l USING (page_id) WHERE v.page_id = (SELECT min(page_id) FROM pages)""",
    "catalog_analyze": """WITH k AS (SELECT page_id, unnest(['all', 'volume', 'issue', 'source']) AS kind, unnest(['', volume, issue, source]) AS value FROM page_vectors WHERE series = 'Harbor Lantern')
        SELECT kind, value, count(DISTINCT page_id) AS pages FROM k GROUP BY ALL""",
    "catalog_find": "SELECT DISTINCT page_id, std_id FROM page_vectors WHERE contains(lower(std_id), 'v01_002_p00')",
}

QUERIES = {
    f.__name__: f
    for f in (
        incremental_upsert, key_collisions, stream_page_metrics, page_metrics, windowed_events, user_sessions, engine_run, text_meaning, task_samples, shuffled_stories,
        catalog_details, catalog_similar, catalog_analyze, catalog_find,
    )
}
