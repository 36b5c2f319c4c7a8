"""The driver's contract: registered queries, and SQL that gives the same rows on the smallest test data."""

import datetime
import decimal
import glob
import math
import os
import subprocess
import sys

import pytest

import __spark_entry__ as entry

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
needs_data = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
CORE = {n: f for n, f in entry.queries().items() if f.__module__.split(".")[1] != "llm"}


def plain(v):
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, bool):
        return v
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 5) + 0.0
    if isinstance(v, int):
        return float(v)
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    if isinstance(v, datetime.datetime):
        return v.isoformat()
    return v


def test_every_sql_has_its_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert {f"p{n}_found" for n in (1, 6, 7)} <= set(CORE)


def test_the_core_stands_without_the_subpackage():
    code = (
        "import sys, importlib.abc\n"
        "class No(importlib.abc.MetaPathFinder):\n"
        "    def find_spec(self, name, path=None, target=None):\n"
        "        if name.startswith('foliolake.llm'): raise ModuleNotFoundError(name)\n"
        "sys.meta_path.insert(0, No())\n"
        "import __spark_entry__ as e\n"
        "assert 'p6_found' in e.queries() and 'p4_found' not in e.queries()\n"
    )
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True)


def test_nothing_outside_imports_the_subpackage():
    for path in glob.glob(f"{ROOT}/foliolake/**/*.py", recursive=True):
        if "/llm/" not in path:
            assert "foliolake.llm" not in open(path, encoding="utf-8").read(), path


@needs_data
def test_entry(spark):
    assert entry.entry(spark).count() == 10


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return con


@needs_data
@pytest.mark.parametrize("name", sorted(set(CORE) & set(entry.oracle_sql())))
def test_query_equals_sql(spark, duck, name):
    df = CORE[name](spark, SF)
    cur = duck.execute(entry.oracle_sql()[name])
    columns = [c[0] for c in cur.description]
    assert sorted(columns) == sorted(df.columns)
    order = sorted(columns)
    want = sorted((tuple(plain(r[columns.index(c)]) for c in order) for r in cur.fetchall()), key=repr)
    got = sorted((tuple(plain(r[c]) for c in order) for r in df.collect()), key=repr)
    assert got == want


@needs_data
@pytest.mark.parametrize("name", sorted(set(CORE) - set(entry.oracle_sql())))
def test_query_without_sql_runs(spark, name):
    """Rows there are, the same ones again, no column without any value but where the data has none, and one row for each thing it is of."""
    df = CORE[name](spark, SF)
    rows = df.collect()
    assert (rows or name in NO_ROWS) and all(not rows or any(r[c] is not None for r in rows) for c in df.columns if (name, c) not in EMPTY)
    again = CORE[name](spark, SF).collect()
    if name not in ("kmeans_clusters", "planar_coordinates"):
        assert sorted(map(repr, rows)) == sorted(map(repr, again))
    if name in KEYS:
        assert len({tuple(r[k] for k in KEYS[name]) for r in rows}) == len(rows)


#: Columns that are empty on the smallest data, and the key of queries that give one row for each.
EMPTY = {("p1_consistent_panels", "shot"), ("p1_consistent_panels", "full_page"), ("p7_pages", "status"), ("p7_speaker_lines", "speaker")}
NO_ROWS = {"speech_lengths"}  # its speaker lines are strings there
KEYS = {
    "p1_found": ("feed", "file_seq", "field_path", "change_kind"), "p1_distances": ("feed", "file_seq"), "p1_consistent_panels": ("record_id", "panel_pos"), "p7_pages": ("record_id",), "p7_panels": ("record_id", "panel_pos"),
    "p7_text_items": ("record_id", "panel_pos", "item_pos"), "p7_speaker_lines": ("record_id", "panel_pos", "item_pos"), "p7_found": ("record_id", "panel_pos", "item_kind", "item_pos"), "near_dedup": ("id",), "near_links": ("id_a", "id_b"),
    "nms": ("page", "box_id"), "page_metrics": ("record_id",), "stream_page_metrics": ("record_id",), "json_repair": ("record_id",), "kmeans_clusters": ("vec_id",), "planar_coordinates": ("vec_id",), "vlm_preview": ("record_id",),
}


@needs_data
def test_stream_ends_in_what_a_batch_gives(spark):
    stream, batch = (sorted(map(repr, CORE[n](spark, SF).collect())) for n in ("stream_page_metrics", "page_metrics"))
    assert stream == batch


@needs_data
def test_flat_tables_belong_together(spark):
    """Every row's parent is there, positions have no gaps, and p7_found is what has a word in it."""
    pages, panels = CORE["p7_pages"](spark, SF).collect(), {(r["record_id"], r["panel_pos"]) for r in CORE["p7_panels"](spark, SF).collect()}
    assert {(r["record_id"], k) for r in pages for k in range(1, r["n_panels"] + 1)} == panels
    found = {tuple(r) for r in CORE["p7_found"](spark, SF).collect()}
    for kind, name in (("text", "p7_text_items"), ("speakers", "p7_speaker_lines")):
        rows = CORE[name](spark, SF).collect()
        assert {(r["record_id"], r["panel_pos"]) for r in rows} <= panels
        last = {}
        for r in rows:
            last.setdefault((r["record_id"], r["panel_pos"]), []).append(r["item_pos"])
        assert all(sorted(v) == list(range(1, len(v) + 1)) for v in last.values())
        assert {(r["record_id"], r["panel_pos"], kind, r["item_pos"]) for r in rows if r["has_word"]} == {x for x in found if x[2] == kind}
