"""The reference's own operators on small fixtures, against plain Python."""

import datetime as dt
import io
import itertools
import json
import os
import random
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from foliolake.catalog import Corpus
from foliolake.functions import geometry as G
from foliolake.functions import json_repair as R
from foliolake.functions import keys as K
from foliolake.functions import page_text as T
from foliolake.operators import boxes as B
from foliolake.operators import dedup as U
from foliolake.operators import filters as P
from foliolake.operators import hooks, incremental, joins, label_rules, metrics, search, windows
from foliolake.sources import archives, readers, sinks
from foliolake.streaming import pages as stream

C = F.col


def one(spark, expr_of, *values):
    names = [f"v{i}" for i in range(len(values))]
    return spark.createDataFrame([tuple(values)], ", ".join(f"{n} string" for n in names)).select(expr_of(*[C(n) for n in names]).alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("path", "source", "want"),
    [
        ("E:\\a\\Night Harbour (2016-2018)\\Night Harbour (2016-2018) 012 - p019.jpg", "calibre", "calibre_night_harbour_(2016-2018)_201_p019"),
        ("E:\\a\\Stone Kite v03\\Stone Kite v03 - p001.jpg", "store", "store_stone_kite_v03_001_p001"),
        ("lonely.jpg", "store", "store_unknown_unknown_000_p000"),
        ("a/Élan Vital/x.jpg", "s", "s_élan_vital_unknown_000_p000"),
    ],
)
def test_standard_id(spark, path, source, want):
    assert one(spark, K.standard_id, path, source) == want


@pytest.mark.parametrize(
    ("key", "every", "first"),
    [
        ("scans/ink/A/b.JPG.png", "a_b", "ink_a_b"),
        ("ink/x\\y.jpeg", "x_y", "x_y"),
        ("plain", "plain", "plain"),
        ("", "", ""),
    ],
)
def test_normal_key(spark, key, every, first):
    assert one(spark, K.normal_key, key) == every
    assert one(spark, lambda k: K.normal_key(k, first_only=True), key) == first


def test_keys_of_null_are_null_or_default(spark):
    for f in (K.normal_key, K.series_name, K.alnum_key, K.uri_key, K.page_number, K.to_posix):
        assert one(spark, f, None) is None
    assert one(spark, K.volume_of, None) == "unknown" and one(spark, K.issue_of, None) == "000" and one(spark, K.page_of, None) == "p000"


@pytest.mark.parametrize(("path", "n"), [("a/page_012.jpg", 12), ("a/jpg4cbz_0007.jpg.png", 7), ("a/x12b.jpg", None), ("a/3 of 40.png", 40), ("a/cover.jpg", None)])
def test_page_number(spark, path, n):
    assert one(spark, K.page_number, path) == n


def test_paths_there_and_back(spark):
    assert one(spark, lambda p: K.to_windows(K.to_posix(p)), "E:\\x\\y z.jpg") == "E:\\x\\y z.jpg"
    assert one(spark, K.uri_key, "a b/ü&.jpg") == "a%20b/%C3%BC%26.jpg"
    assert one(spark, K.undoubled, "x_y_x_y") == "x_y" and one(spark, K.undoubled, "x_y_x") == "x_y_x"


def test_filters_ignore_unknown_and_treat_wildcards_as_text(spark):
    df = spark.createDataFrame([("a_b",), ("axb",), (None,), ("",)], "s string")
    assert P.by_metadata(df, {"nope": 1}).count() == 4
    assert [r["s"] for r in df.filter(P.holds_text(C("s"), "a_b")).collect()] == ["a_b"]
    d = spark.createDataFrame([(1, 1), (1, 2), (None, 1), (None, None)], "a int, b int")
    assert d.filter(P.disagree(C("a"), C("b"))).count() == 3
    b = spark.createDataFrame([([1.0, 2.0, 3.0, 4.0],), ([1.0],), (None,), ([1.0, None, 2.0, 3.0],)], "b array<double>")
    assert b.filter(P.valid_box(C("b"))).count() == 1


def boxes(spark, n_pages=12, seed=3):
    rng = random.Random(seed)
    rows = []
    for p in range(n_pages):
        for i in range(rng.randint(0, 7)):
            x, y, w, h = (float(rng.randint(0, 60)) for _ in range(4))
            rows.append((p, i, x, y, w + 1, h + 1, rng.choice([0.2, 0.5, 0.9]), rng.choice(["panel", "text", "face"])))
    df = spark.createDataFrame(rows, "page int, box_id int, x double, y double, w double, h double, score double, label string")
    return rows, df.withColumn("box", G.box(C("x"), C("y"), C("w"), C("h")))


def iou(a, b):
    iw, ih = min(a[2] + a[4], b[2] + b[4]) - max(a[2], b[2]), min(a[3] + a[5], b[3] + b[5]) - max(a[3], b[3])
    i = max(0, iw) * max(0, ih)
    return i / (a[4] * a[5] + b[4] * b[5] - i)


def by_page(rows):
    return {p: [r for r in rows if r[0] == p] for p in {r[0] for r in rows}}


def test_suppression(spark):
    rows, df = boxes(spark)
    want = set()
    for p, own in by_page(rows).items():
        kept = []
        for r in sorted(own, key=lambda r: (r[6], r[1]), reverse=True):
            if all(iou(r, k) < 0.25 for k in kept):
                kept.append(r)
        want |= {(p, r[1], n) for n, r in enumerate(kept, 1)}
    assert {tuple(r) for r in B.suppress(df).collect()} == want


def test_repeats_across_labels(spark):
    rows, df = boxes(spark)
    order = {"text": 0, "face": 1, "panel": 2}
    want = set()
    for p, own in by_page(rows).items():
        kept = []
        for r in sorted(own, key=lambda r: (order[r[7]], r[1])):
            if all(iou(r, k) <= 0.3 for k in kept):
                kept.append(r)
        want |= {(p, r[1], r[7]) for r in kept}
    assert {tuple(r) for r in B.drop_repeats(df, ["text", "face", "panel"], threshold=0.3).collect()} == want


def test_greedy_match(spark):
    rows, df = boxes(spark, seed=9)
    a, b = df.filter("box_id % 2 = 0"), df.filter("box_id % 2 = 1")
    want = set()
    for p, own in by_page(rows).items():
        x, y = [r for r in own if r[1] % 2 == 0], [r for r in own if r[1] % 2]
        pairs = sorted(((-iou(i, j), i[1], j[1]) for i in x for j in y if iou(i, j) > 0.1))
        ua, ub = set(), set()
        for v, i, j in pairs:
            if i not in ua and j not in ub:
                ua.add(i)
                ub.add(j)
                want.add((p, i, j, round(-v, 9), "111"))
        want |= {(p, r[1], None, 0.0, "010") for r in x if r[1] not in ua} | {(p, None, r[1], 0.0, "101") for r in y if r[1] not in ub}
    assert {(r[0], r[1], r[2], round(r[3], 9), r[4]) for r in B.greedy_match(a, b).collect()} == want


def test_reading_order_rows(spark):
    rows = [(1, 0, 50.0, 0.0, 40.0, 40.0), (1, 1, 0.0, 5.0, 40.0, 40.0), (1, 2, 0.0, 60.0, 90.0, 30.0)]
    df = spark.createDataFrame(rows, "page int, box_id int, x double, y double, w double, h double")
    assert [r["box_id"] for r in B.reading_order(df).orderBy("position").collect()] == [1, 0, 2]
    got = B.next_panel(B.reading_order(df, rtl=True)).orderBy("position").collect()
    assert [(r["box_id"], r["next_id"]) for r in got] == [(0, 1), (1, 2), (2, None)]


def test_box_kernels_on_nothing(spark):
    _, df = boxes(spark)
    none = df.filter("page < 0")
    assert B.suppress(none).count() == B.greedy_match(none, none).count() == B.drop_repeats(none, []).count() == B.reading_order(none).count() == 0


def test_box_encodings(spark):
    df = spark.createDataFrame([([1.0, 2.0, 11.0, 22.0], None, None), (None, [-1.0, 2.0, 0.0, 5.0], None), (None, None, [[1.0, 1.0], [4.0, 3.0]]), (None, None, None)], "c array<double>, x array<double>, p array<array<double>>")
    got = [r["b"] if r["b"] is None else tuple(r["b"]) for r in df.select(G.any_box(C("c"), C("x"), C("p")).alias("b")).collect()]
    assert got == [(1, 2, 10, 20), (0, 2, 1, 5), (1, 1, 3, 2), None]


def vectors(spark, n=40, seed=1):
    rng = np.random.default_rng(seed)
    m = rng.normal(size=(n, 6))
    rows = [(i, [float(x) for x in v], i % 3) for i, v in enumerate(m)] + [(n, None, 0), (n + 1, [0.0] * 6, 1), (n + 2, [1.0], 1)]
    return m, spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")


def test_search(spark):
    m, df = vectors(spark)
    u = m / np.linalg.norm(m, axis=1, keepdims=True)
    q = df.filter("vec_id = 4")
    want = np.argsort(-(u @ u[4]))[:5].tolist()
    assert [r["vec_id"] for r in search.top_k(df, q, 5).orderBy("rank").collect()] == want
    assert search.top_k(df, q, 1000).count() == 40
    assert search.top_k(df, df.filter("vec_id = -1"), 5).count() == 0
    assert [r["vec_id"] for r in search.pinned(df.filter("vec_id != 9"), df.filter("vec_id = 8"), 3).orderBy("rank").collect()][0] == 8
    batch = search.top_k_batch(df, df.filter("vec_id < 3"), 2).collect()
    assert {(r["query_id"], r["vec_id"]) for r in batch if r["rank"] == 1} == {(0, 0), (1, 1), (2, 2)}


def test_intra_inter_without_pairs(spark):
    m, df = vectors(spark)
    u = m / np.linalg.norm(m, axis=1, keepdims=True)
    s = u @ u.T
    lab = np.arange(40) % 3
    off = ~np.eye(40, dtype=bool)
    same = lab[:, None] == lab[None]
    r = search.intra_inter(df.filter("vec_id < 40")).first()
    assert r["intra"] == pytest.approx(s[same & off].mean()) and r["inter"] == pytest.approx(s[~same].mean())


def test_blocks_break_on_repeats_and_gaps(spark):
    df = spark.createDataFrame([("b", "story", p) for p in (1, 2, 2, 3, 5, 6, None)], "book string, label string, page int")
    got = {(r["page_start"], r["page_end"], r["n"]) for r in windows.blocks(df, ["book", "label"], "page").collect()}
    assert got == {(1, 2, 2), (2, 3, 2), (5, 6, 2)}
    seg = spark.createDataFrame([("b", "story", 1, 3), ("b", "ad", 2, 2)], "book string, label string, page_start int, page_end int")
    assert {(r["page"], r["label"]) for r in windows.expand(seg, ["book"], label="label", precedence=["story", "ad"]).collect()} == {(1, "story"), (2, "ad"), (3, "story")}


@pytest.mark.parametrize(("n", "size", "stride"), [(0, 4, 2), (3, 4, 2), (10, 4, 3), (9, 4, 4)])
def test_sliding(spark, n, size, stride):
    df = spark.range(n).select(F.lit("g").alias("g"), "id")
    last = max(-(-(n - size) // stride), 0)
    want = {(w, i) for w in range(last + 1) for i in range(w * stride, min(n, w * stride + size))} if n else set()
    assert {(r["window"], r["id"]) for r in windows.sliding(df, ["g"], ["id"], size=size, stride=stride).collect()} == want


def test_bridge_takes_the_longest_suffix(spark):
    probe = spark.createDataFrame([(1, "a/b/c"), (2, "x/c"), (3, "q")], "id int, path string")
    build = spark.createDataFrame([("b/c",), ("c",), ("c",)], "suffix string")
    got = {r["id"]: (r["suffix"], r["n_candidates"]) for r in joins.bridge(probe, build, K.suffixes_of(C("path")), key="id", target="suffix").collect()}
    assert got == {1: ("b/c", 2), 2: ("c", 1)}


def test_hash_links_and_leaders_against_brute_force(spark):
    rng = random.Random(7)
    values = []
    for _ in range(25):
        base = rng.getrandbits(64)
        values += [base] + [base ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 8))) for _ in range(4)]
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    df = spark.createDataFrame(list(enumerate(signed)), "id long, hash long")
    d = lambda a, b: bin((a ^ b) & (1 << 64) - 1).count("1")
    links = {(min(a, b), max(a, b)) for a, b in itertools.combinations(set(signed), 2) if d(a, b) <= 6}
    got = U.hash_links(df)
    assert {(r["a"], r["b"]) for r in got.collect()} == links
    leaders, want = [], {}
    for i, v in enumerate(signed):
        hit = next((x for x in leaders if d(signed[x], v) <= 6), None)
        want[i] = i if hit is None else hit
        if hit is None:
            leaders.append(i)
    assert {r["id"]: r["leader"] for r in U.leader_clusters(df, got).collect()} == want


def test_hash_links_meet_without_a_join(spark, monkeypatch):
    """Each pair once however values are cut into parts, and no plan that hands the keys of all values to the driver or joins pairs."""
    rng = random.Random(11)
    base = [rng.getrandbits(63) for _ in range(20)]
    values = sorted({b ^ sum(1 << i for i in rng.sample(range(63), rng.randint(0, 4))) for b in base for _ in range(15)})
    want = {(a, b, (a ^ b).bit_count()) for a, b in itertools.combinations(values, 2) if (a ^ b).bit_count() <= 6}
    df = spark.createDataFrame([(v,) for v in values + values[:9]], "hash long").withColumn("id", F.monotonically_increasing_id())
    for most, at_once, blocks in ((10**6, 1 << 21, None), (40, 7, None), (100, 1 << 21, 7), (100, 50, 10)):
        monkeypatch.setattr(U, "PART_VALUES", most)
        monkeypatch.setattr(U, "PAIRS_AT_ONCE", at_once)
        links = U.hash_links(df, blocks=blocks)
        got = [tuple(r) for r in links.collect()]
        assert set(got) == want and len(got) == len(want)
        assert "Join" not in links._jdf.queryExecution().executedPlan().toString()


def test_leaders_of_long_chains_and_in_rounds(spark, monkeypatch):
    """A chain in the order of ids settles half its nodes one by one; rounds and the last task give what a pass row by row gives."""
    rng = random.Random(5)
    chain = [(i, i + 1) for i in range(400)]
    drawn = sorted({tuple(sorted(rng.sample(range(500, 620), 2))) for _ in range(300)})
    pairs = chain + drawn
    hashes = spark.createDataFrame([(i, i * 7) for i in range(620)], "id long, hash long")
    leads, want = [], {}
    near = {frozenset(p) for p in pairs}
    for i in range(620):
        want[i] = next((x for x in leads if frozenset((x, i)) in near), i)
        if want[i] == i:
            leads.append(i)
    frames = [(pairs, U.LAST_LINKS), (drawn, 0)]
    for links, last in frames:
        monkeypatch.setattr(U, "LAST_LINKS", last)
        got = U.leader_clusters(hashes, spark.createDataFrame([(a * 7, b * 7) for a, b in links], "a long, b long")).collect()
        in_links = {x for p in links for x in p}
        assert {r["id"]: r["leader"] for r in got} == {i: want[i] if i in in_links else i for i in range(620)}
        assert {r["id"]: r["n_links"] for r in got} == {i: sum(i in p for p in links) for i in range(620)}


def test_ranked_split_is_exact(spark):
    keys = spark.range(997).select(C("id").cast("string").alias("k"))
    n = {r["split"]: r["count"] for r in U.ranked_split(keys, key="k", shares=[("a", 0.8), ("b", 0.1), ("c", 0.1)]).groupBy("split").count().collect()}
    assert n == {"a": 797, "b": 100, "c": 100}


def test_unique_guard_and_suffixes(spark):
    df = spark.createDataFrame([("a", "1"), ("a", "2"), ("b", "3"), (None, "4")], "k string, v string")
    with pytest.raises(U.TooManyRepeats):
        U.require_unique(df, ["k"])
    assert U.require_unique(df, ["k"], tolerance=1) is df
    got = {r["v"]: r["unique_key"] for r in U.suffix_repeats(df, key="k", content=C("v")).collect()}
    assert got["3"] == "b" and got["4"] is None and got["1"] != got["2"] and got["1"].startswith("a_")


REPAIR = ['```json\n{"a": 1}\n```', 'Sure! {"a": [1, 2', '{"a": {"b": [1, {"c": "x', '{"a": 1 "b": 2}', '{"a": 1,}', '{"a": None, "b": NaN}', '{"a": "he said "hi" to me", "b": 1}', '{"a":1}{"b":2}', '{"a": "x", "b":', "{'a': 1}"]
FIXED = [{"a": 1}, {"a": [1, 2]}, {"a": {"b": [1, {"c": "x"}]}}, {"a": 1, "b": 2}, {"a": 1}, {"a": None, "b": None}, {"a": 'he said "hi" to me', "b": 1}, {"a": 1}, {"a": "x"}, {}]


@pytest.mark.parametrize(("text", "want"), list(zip(REPAIR, FIXED))[:-1])
def test_repair(text, want):
    assert json.loads(R.repair_json(text)) == want


def test_repair_of_every_prefix_is_json():
    doc = json.dumps({"panels": [{"text": [{"t": 'a "q" \\ b', "n": -1.5e3}], "ok": True}, None, {}], "x": {"y": []}})
    for i in range(1, len(doc) + 1):
        out = R.repair_json(doc[:i])
        assert isinstance(json.loads(out), dict)
    assert json.loads(R.repair_json(doc)) == json.loads(doc)
    assert R.repair_json(None) is None and R.repair_json("") is None and R.repair_json("no object") is None


def test_page_text(spark):
    doc = {"overall_summary": "S", "summary": {"plot": "P"}, "panels": {"p1": {"description": ["D", "e"], "text_content": [{"text": "hi", "speaker": "A"}, {"text": ["x", "y"]}, {"text": " "}]}, "p2": {"description": None, "caption": "Cap", "text_content": {"dialogue": ["d"], "sfx": []}}}}
    df = spark.createDataFrame([(1, json.dumps(doc)), (2, "{}"), (3, None)], "record_id long, doc string")
    p = T.pages(df, C("doc"))
    rows = {r["record_id"]: r for r in p.select("record_id", F.transform("panels", T.panel_text).alias("t"), F.transform("panels", T.dialogue_lines).alias("l"), T.preview(C("panels")).alias("v"), T.sequence_text(p, "all_text").alias("s")).collect()}
    assert rows[1]["t"] == ["D e hi x y", ""] and rows[1]["l"] == [["A: hi", "x y"], []] and rows[1]["v"] == "D e hi x y" and rows[1]["s"].startswith("S P")
    assert rows[2]["t"] == [] and rows[2]["v"] == ""
    cat = p.select(F.explode("panels").alias("p")).select(T.category(T.bucket(C("p"), "dialogue"), T.bucket(C("p"), "narration"), T.bucket(C("p"), "sfx")).alias("c")).collect()
    assert [r["c"] for r in cat] == ["no_text", "dialogue_and_narration"]


def test_label_rules_ties_go_to_the_first(spark):
    rules = (label_rules.Rule("x", 1.0, words=("w",)), label_rules.Rule("y", 1.0, where="n > 0"))
    df = spark.createDataFrame([("w", 1), ("", 1), (None, None)], "corpus string, n int")
    assert [r["page_type"] for r in label_rules.score_labels(df, rules).collect()] == ["x", "y", "x"]


def test_metrics(spark):
    df = spark.createDataFrame([("a", "a")] * 3 + [("a", "b"), ("b", "b"), ("c", "a"), (None, "a")], "l string, p string")
    s = {r["cls"]: r for r in metrics.class_scores(metrics.confusion(df, "l", "p")).collect()}
    assert s["a"]["precision"] == s["a"]["recall"] == 0.75 and s["b"]["recall"] == 1.0 and s["c"]["f1"] == 0.0
    t = spark.createDataFrame([("k", "a", 1, 4), ("k", "b", 5, 6)], "book string, label string, first int, last int")
    f = spark.createDataFrame([("k", "a", 1, 3), ("k", "b", 6, 9)], "book string, label string, first int, last int")
    r = metrics.segment_scores(t, f, book=["book"]).first()
    assert (r["tp"], r["sq"], r["rq"], r["pq"]) == (1, 0.75, 0.5, 0.375)
    assert metrics.boundary_distance(t, f, book=["book"]).first()["mndd"] == 0.5


def test_upsert_twice_changes_nothing(spark, tmp_path):
    a = spark.createDataFrame([(1, 1, "x"), (1, 2, "y"), (2, 1, "z")], "k int, v int, t string")
    order = [C("v").desc()]
    table = incremental.VersionedTable(spark, str(tmp_path / "t"))
    assert table.read() is None
    assert table.merge(a, ["k"], order) == 2 and table.merge(a, ["k"], order) == 2
    assert {(r["k"], r["t"]) for r in table.read().collect()} == {(1, "y"), (2, "z")}
    p = str(tmp_path / "log")
    assert incremental.append_new(spark, p, a, ["k", "v"]) == 3 and incremental.append_new(spark, p, a, ["k", "v"]) == 0


def test_stream_runs_once(spark, tmp_path):
    doc = json.dumps({"panels": [{"description": "d", "text_content": [{"text": "hi"}], "speakers": ["A: b"]}, {}]})
    schema = "record_id long, doc string"
    src = f"{tmp_path}/in"
    spark.createDataFrame([(1, doc), (1, doc), (2, "broken {")], schema).coalesce(1).write.mode("append").parquet(src)
    run = lambda: stream.refresh(spark, src, f"{tmp_path}/out", f"{tmp_path}/ck", schema=schema).awaitTermination()
    run()
    spark.createDataFrame([(1, doc), (3, doc)], schema).write.mode("append").parquet(src)
    run()
    assert sorted(r["record_id"] for r in spark.read.parquet(f"{tmp_path}/out/metrics").collect()) == [1, 3]
    assert spark.read.parquet(f"{tmp_path}/out/panels").count() == 4


def test_engine_failures_are_rows(spark):
    def engine(row):
        if row["t"] == "busy":
            raise hooks.Retryable("later", 429)
        if row["t"] is None:
            raise KeyError("t")
        return {"n": len(row["t"])}

    df = spark.createDataFrame([(1, "abc"), (2, "busy"), (3, None)], "page_id long, t string")
    got = {r["page_id"]: (r["n"], r["status"]) for r in hooks.run_engine(df, engine, "n int", sleep=lambda s: None).collect()}
    assert got == {1: (3, "ok"), 2: (None, "failed"), 3: (None, "failed")}
    assert hooks.wait_seconds(429, 1, 0.5) == 35.0 and hooks.wait_seconds(500, 0, 0.0) == 5.0 and hooks.wait_seconds(404, 0, 0.0) is None


def test_archives_and_manifest(spark, tmp_path):
    png = b"\x89PNG\r\n\x1a\n" + b"0" * 20
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w") as z:
        for n, c in (("b/2.png", png), ("b/1.jpg", b"\xff\xd8\xff00"), ("__MACOSX/._1.jpg", png), ("bad.png", b"zz"), ("note.txt", b"x")):
            z.writestr(n, c)
    (tmp_path / "one.cbz").write_bytes(buf.getvalue())
    (tmp_path / "two.cbz").write_bytes(b"not a zip")
    (tmp_path / "three.cbr").write_bytes(b"x")
    pages = archives.archive_pages(spark, str(tmp_path))
    st = sorted((r["status"].split(":")[0], r["member"] or "") for r in pages.collect())
    assert st == [("corrupt", ""), ("invalid image", "bad.png"), ("ok", "__MACOSX/._1.jpg"), ("ok", "b/1.jpg"), ("ok", "b/2.png"), ("unsupported", "")]
    loose = spark.createDataFrame([(f"{tmp_path}/one/b/1.jpg",), (f"{tmp_path}/x/9.png",)], "path string")
    m, audit = archives.build_manifest(pages, loose, root=str(tmp_path))
    assert sorted(r["canonical_id"] for r in m.collect()) == ["one/b/1", "one/b/2", "x/9"] and audit.count() == 3


def test_readers_and_writers(spark, tmp_path):
    df = spark.createDataFrame([("001", "a/1.jpg"), ("2", None)], "canonical_id string, absolute_image_path string")
    sinks.csv(df, f"{tmp_path}/m", gzip=True)
    assert sorted(r["canonical_id"] for r in readers.manifest(spark, f"{tmp_path}/m").collect()) == ["001", "2"]
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "x.json").write_bytes('\ufeff{"a": "é"}'.encode())
    (tmp_path / "d" / "y.json").write_bytes('{"a": "é"}'.encode("cp1252"))
    got = {r["key"]: r["doc"] for r in readers.documents(spark, f"{tmp_path}/d").collect()}
    assert got == {"x": '{"a": "é"}', "y": '{"a": "é"}'}
    (tmp_path / "coco.json").write_text(json.dumps({"categories": [{"id": 1, "name": "panel"}], "images": [{"id": "i", "file_name": "f", "width": 1, "height": 2}], "annotations": [{"id": 1, "image_id": "i", "category_id": 1, "bbox": [1, 2, 3.7, 4]}, {"id": 2, "image_id": "i", "category_id": 9, "bbox": [0, 0, 1, 1], "score": 0.5}]}))
    b = readers.coco(spark, f"{tmp_path}/coco.json")["boxes"]
    assert {(r["label"], r["score"]) for r in b.collect()} == {("panel", 1.0), ("9", 0.5)}
    doc = json.loads(sinks.coco_documents(b).first()["doc"])
    assert doc["annotations"][0]["bbox"] == [1, 2, 3, 4]
    np.save(tmp_path / "v.npy", np.arange(6.0).reshape(3, 2))
    assert [r["vector"] for r in readers.vectors_npy(spark, str(tmp_path)).orderBy("row").collect()] == [[0.0, 1.0], [2.0, 3.0], [4.0, 5.0]]
    (tmp_path / "l.txt").write_text("A\\b.jpg\na/b.jpg\n\nc.jpg\n")
    assert readers.path_list(spark, f"{tmp_path}/l.txt").count() == 2
    (tmp_path / "e.log").write_text("ERROR E:\\x\\y.jpg: cannot read\nfine\n")
    assert [tuple(r) for r in readers.error_log(spark, f"{tmp_path}/e.log").collect()] == [("E:\\x\\y.jpg", "cannot read")]
    sinks.one_file_per_key(spark.createDataFrame([("k/1", "{}")], "k string, t string"), f"{tmp_path}/out", key="k", text="t")
    assert (tmp_path / "out" / "k" / "1.json").read_text() == "{}"
    sinks.tier_lists(spark.createDataFrame([("high", "p")], "t string, v string"), f"{tmp_path}/tiers", tier="t", value="v")
    assert spark.read.text(f"{tmp_path}/tiers/tier=high").first()[0] == "p"
    sinks.json_lines(df, f"{tmp_path}/jl")
    assert spark.read.json(f"{tmp_path}/jl").count() == 2
    assert "| 001 |" in sinks.markdown(df)


def test_catalog(spark):
    rows = [(1, "S", "v1", "1", "a", "a_s_v1_1_p001", 1, [1.0, 0.0]), (2, "S", None, "1", "b", "b_s", 2, [0.9, 0.1]), (3, "T", "v1", "2", "a", "a_t", 1, [0.0, 1.0])]
    p = spark.createDataFrame(rows, "page_id long, series string, volume string, issue string, source string, std_id string, page_num int, page_embeddings array<double>")
    c = Corpus(p, spark.createDataFrame([(1, "a lantern"), (2, None)], "doc_id long, text string"))
    assert [r["page_id"] for r in c.similar(1, 2).orderBy("rank").collect()] == [1, 2]
    assert [r["page_id"] for r in c.similar(1, 2, source="a").orderBy("rank").collect()] == [1, 3]
    assert {r["page_id"] for r in c.covers(2).collect()} == {1, 3}
    assert c.text("LANTERN").count() == 1 and c.filter(series=["S"]).count() == 2 and c.find("A_S").count() == 1
    assert {(r["kind"], r["value"], r["pages"]) for r in c.analyze("S").collect()} == {("all", "", 2), ("volume", "v1", 1), ("volume", None, 1), ("issue", "1", 2), ("source", "a", 1), ("source", "b", 1)}
    assert "page_embeddings" not in c.details(1).columns


def test_windowed_events_drop_nothing_in_batch(spark):
    t = dt.datetime(2024, 1, 1)
    e = spark.createDataFrame([(t, "a", 1.0), (t + dt.timedelta(minutes=59), "a", 2.0), (t - dt.timedelta(days=9), "b", None)], "ts timestamp, event_type string, value double")
    assert sorted(r["n"] for r in stream.windowed_events(e).collect()) == [1, 2]


@pytest.mark.parametrize(
    ("path", "some", "key"),
    [
        ("A Kite\\Kite Kite 007.JPG.png", {"kite_kite_007", "a_kite_7", "a_kite_007", "a_kite_00007"}, "a_kite_7"),
        ("x/My Book/jpg4cbz/page_012.jpg", {"page_012", "jpg4cbz_12", "my_book_jpg4cbz_0012"}, "my_book_12"),
        ("cover_cover.png", {"cover_cover", "cover"}, "cover_cover"),
        ("a/123456.tif", {"a_123456"}, "a_123456"),
    ],
)
def test_candidate_and_image_keys(spark, path, some, key):
    got = one(spark, K.candidate_keys, path)
    assert some <= set(got) and len(got) == len(set(got)) <= 14 and one(spark, K.image_key, path) == key


def test_near_join_against_brute_force(spark):
    rng = random.Random(4)
    words = list({"".join(rng.choice("ab") for _ in range(rng.randint(0, 7))) for _ in range(60)})

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row, last = [i], row
            for j, y in enumerate(b, 1):
                row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
        return row[-1]

    df = spark.createDataFrame([(w,) for w in words] * 2 + [(None,)], "a string")
    for most in (1, 2):
        want = {(a, b, distance(a, b)) for a in words for b in words if a != b and distance(a, b) <= most}
        assert {tuple(r) for r in joins.near_join(df, df.withColumnRenamed("a", "b"), a_text="a", b_text="b", most=most).collect()} == want


def test_multimap_takes_the_first_key_that_leads_anywhere(spark):
    ask = spark.createDataFrame([(1, "b1__x", "x"), (2, "b9__x", "x"), (3, None, ""), (4, "q", None)], "ask int, k1 string, k2 string")
    build = spark.createDataFrame([(10, "b1__x", "x"), (11, "b2__x", "x"), (11, "b2__x", "x"), (12, None, None)], "id int, k1 string, k2 string")
    got = joins.multimap(ask, build, [("book", C("k1"), C("k1")), ("name", C("k2"), C("k2"))], probe_id="ask", build_id="id").collect()
    assert {tuple(r) for r in got} == {(1, 10, "book"), (2, 10, "name"), (2, 11, "name")} and len(got) == 3


def test_multimap_counts_make_no_pairs(spark):
    """20,000 pages ask for a name that as many have: 400 million pairs, which are counted and never made."""
    ids = spark.range(20_000)
    keys = [("book", F.when(C("id") == 5, "b5"), F.concat(F.lit("b"), C("id").cast("string"))), ("name", F.when(C("id") != 7, "x"), F.lit("x"))]
    got = joins.multimap_counts(ids.withColumnRenamed("id", "ask").withColumn("id", C("ask")), ids, keys, probe_id="ask", build_id="id")
    assert {tuple(r) for r in got.groupBy("rule", "first", "n").count().collect()} == {("book", 5, 1, 1), ("name", 0, 20_000, 19_998)}
    few = ids.limit(30).select(C("id").alias("ask"), F.concat(F.lit("k"), (C("id") % 4).cast("string")).alias("k1"), F.when(C("id") % 3 > 0, F.lit("n")).alias("k2"))
    build = ids.limit(40).select("id", F.concat(F.lit("k"), (C("id") % 3).cast("string")).alias("k1"), F.lit("n").alias("k2"))
    keys = [("one", C("k1"), C("k1")), ("two", C("k2"), C("k2"))]
    want = joins.multimap(few, build, keys, probe_id="ask", build_id="id").groupBy("ask", "rule").agg(F.min("id").alias("first"), F.count("*").alias("n"))
    assert sorted(joins.multimap_counts(few, build, keys, probe_id="ask", build_id="id").collect()) == sorted(want.collect())


def test_block_count_grows_with_the_table():
    counts = [U.block_count(n) for n in (10, 10**6, 10**9, 10**12)]
    assert counts == sorted(counts) and counts[0] < counts[-1]


def test_shuffled_stories_keep_every_page(spark):
    rows = [(i, b, None if i % 3 else "1", lab, i // 2) for i, (b, lab) in enumerate((b, lab) for b in ("a", None) for lab in ("story", "story", "cover", None) * 6)]
    df = spark.createDataFrame(rows, "page_id long, series string, issue string, page_type string, position int")
    got = {r["page_id"]: r for r in hooks.shuffled_stories(df, ["series", "issue"]).collect()}
    assert set(got) == {r[0] for r in rows}
    books = {}
    for i, s, iss, lab, pos in rows:
        if lab == "story":
            books.setdefault((s, iss), []).append((pos, got[i]["new_position"]))
        else:
            assert got[i]["new_position"] == pos
    assert all(sorted(a for a, _ in v) == sorted(b for _, b in v) for v in books.values()) and any(a != b for v in books.values() for a, b in v)


def test_dead_letters(spark):
    pages = spark.createDataFrame([(i, str(i)) for i in range(6)], "page_id long, t string")
    dead = spark.createDataFrame([(1, 1, "old"), (2, 3, "old"), (3, 1, "old"), (99, 1, "gone")], "page_id long, attempts int, error string")

    def engine(row):
        if row["page_id"] == 3:
            raise ValueError("no")
        return {"n": 1}

    done, left = hooks.retry_failed(pages, dead, engine, "n int")
    assert [tuple(r) for r in done.collect()] == [(1, 1)]
    assert {tuple(r) for r in left.collect()} == {(2, 3, "old"), (3, 2, "ValueError: no"), (99, 1, "gone")}


def test_classifier_over_stored_vectors(spark):
    df = spark.createDataFrame([(1, [0.0, 2.0]), (2, [3.0, 3.0]), (3, None), (4, [1.0]), (5, [float("nan"), 1.0])], "page_id long, page_embeddings array<float>")
    got = hooks.classify(df, lambda x: x, ["a", "b"], dim=2).collect()
    assert {tuple(r) for r in got} == {(1, 1, "b"), (2, 0, "a")} and hooks.classify(df.limit(0), lambda x: x, ["a", "b"], dim=2).count() == 0


def test_listing_counts_hash_names_and_safe_json(spark, tmp_path):
    for name in ("x/a.jpg", "x/b.JPG", "y/c.json", "y/d"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text("12")
    got = {(r["folder"].rpartition("/")[2], r["suffix"]): (r["n"], r["size"]) for r in readers.file_counts(spark, str(tmp_path)).collect()}
    assert got == {("x", "jpg"): (2, 4), ("y", "json"): (1, 2), ("y", ""): (1, 2)}
    (tmp_path / "map.csv").write_text("book_chapter_hash,book_name,chapter_name\nh1,B,1\nh1,C,2\nh2,D,\n")
    assert {tuple(r) for r in readers.hash_names(spark, f"{tmp_path}/map.csv").collect()} == {("h1", "C", "2"), ("h2", "D", None)}
    odd = spark.createDataFrame([(float("nan"), b"ok", dt.datetime(2024, 1, 2, 3)), (1.5, b"\xff", None)], "x double, b binary, t timestamp_ntz")
    assert [tuple(r) for r in sinks.json_safe(odd).collect()] == [(None, "ok", "2024-01-02T03:00:00.000000"), (1.5, "/w==", None)]


def test_no_temporary_folder_off_one_machine(spark, monkeypatch):
    from foliolake import runtime

    class Cluster:
        class conf:  # noqa: N801
            get = staticmethod(lambda *a: None)

        class sparkContext:  # noqa: N801
            master = "spark://host:7077"

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        runtime.shared_dir(Cluster())


def test_two_writers_of_one_version(spark, tmp_path):
    a, b = (incremental.VersionedTable(spark, f"file://{tmp_path}/t") for _ in range(2))
    row = spark.createDataFrame([(1, 1)], "k int, v int")
    assert a.read() is None and b.read() is None
    assert a.write(row) == 1
    with pytest.raises(incremental.VersionConflict):
        b.write(row)
    assert b.read().count() == 1 and b.merge(spark.createDataFrame([(2, 1)], "k int, v int"), ["k"], [C("v")]) == 2 and a.read().count() == 2
    (tmp_path / "t" / "_log" / "000000000002").write_text("v-half")
    assert a.read().count() == 2


def test_large_enough_boxes(spark):
    df = spark.createDataFrame([(32.0, 32.0, 90_000.0), (31.0, 900.0, 1.0), (40.0, 40.0, 1e6), (None, 40.0, 1.0)], "w double, h double, a double")
    assert [r[0] for r in df.select(P.large_enough(C("w"), C("h"), C("a"))).collect()] == [True, False, False, None]


def test_materialized_tables_are_cleared(spark):
    from foliolake import runtime

    made = runtime.materialize(spark.range(3), "cleared")
    folder = made.inputFiles()[0].removeprefix("file://").rpartition("/")[0]
    assert os.path.isdir(folder)
    runtime.drop_materialized(made)
    assert not os.path.isdir(folder) and not any(x.endswith(folder.rpartition("/")[2]) for x in runtime._written)


@pytest.mark.parametrize(("packed", "wide", "apart"), [(None, 6, "."), ("zlib", 4, "."), ("gzip", 6, "/"), ("zstd", 2, ".")])
def test_zarr_round_trip(spark, tmp_path, packed, wide, apart):
    import gzip
    import zlib

    import zstandard

    a, tall = np.arange(7 * 6, dtype="<f4").reshape(7, 6), 3
    store = tmp_path / "v"
    store.mkdir()
    meta = {"zarr_format": 2, "shape": [7, 6], "chunks": [tall, wide], "dtype": "<f4", "order": "C", "filters": None, "compressor": packed and {"id": packed}, "dimension_separator": apart, "fill_value": 0}
    (store / ".zarray").write_text(json.dumps(meta))
    pack = {None: bytes, "zlib": zlib.compress, "gzip": gzip.compress, "zstd": zstandard.ZstdCompressor().compress}[packed]
    for i in range(2):  # the third row of chunks was never written
        for j in range(-(-6 // wide)):
            chunk = np.zeros((tall, wide), "<f4")
            part = a[i * tall : (i + 1) * tall, j * wide : (j + 1) * wide]
            chunk[: part.shape[0], : part.shape[1]] = part
            (store / f"{i}{apart}{j}").parent.mkdir(exist_ok=True)
            (store / f"{i}{apart}{j}").write_bytes(pack(chunk.tobytes()))
    got = {r["row"]: r["vector"] for r in readers.vectors_zarr(spark, str(store)).collect()}
    assert got == {i: a[i].tolist() for i in range(6)}
    (store / ".zarray").write_text(json.dumps(meta | {"compressor": {"id": "blosc"}}))
    with pytest.raises(ValueError, match="blosc"):
        readers.vectors_zarr(spark, str(store))


def test_store_aligned_with_metadata_and_manifest(spark):
    vectors = spark.createDataFrame([(i, [float(i)]) for i in range(4)], "row long, vector array<float>")
    meta = spark.createDataFrame([(0, "a"), (1, "b"), (2, None), (9, "z")], "row long, canonical_id string")
    manifest = spark.createDataFrame([("a", "p2", 1), ("a", "p1", 2), ("z", "p", 3)], "canonical_id string, path string, row int")
    assert [tuple(r) for r in readers.aligned_store(vectors, meta, manifest).select("row", "canonical_id", "path").collect()] == [(0, "a", "p1")]


def test_documents_in_old_encodings(spark, tmp_path):
    for name, raw in (("a", "é".encode()), ("b", b"\xef\xbb\xbf\xc3\xa9"), ("c", b"\xe9\x80"), ("d", b"\xe9\x81")):
        (tmp_path / f"{name}.json").write_bytes(raw)
    assert {r["key"]: r["doc"] for r in readers.documents(spark, str(tmp_path)).collect()} == {"a": "é", "b": "é", "c": "é€", "d": "é\x81"}
