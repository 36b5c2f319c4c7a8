"""The registered queries of the llm problems, with production parameters on the smallest data."""

import os
from collections import Counter

import numpy as np
import pytest

from foliolake.llm.queries import QUERIES

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")


@pytest.fixture(scope="module")
def rows(spark):
    held = {}
    return lambda name: held.setdefault(name, QUERIES[name](spark, SF).collect()) if name not in held else held[name]


@pytest.fixture(scope="module")
def data(spark):
    return lambda name: spark.read.parquet(f"{SF}/{name}.parquet")


def test_matches(rows, data):
    found, told = {tuple(r) for r in rows("p2_found")}, rows("p2_matches")
    assert found and {(r["image_id"], r["record_id"]) for r in told} == found and len(told) == len(found)
    assert all(0 < r["confidence"] <= 1 and r["rule"] for r in told)
    assert {i for i, _ in found} <= {r["image_id"] for r in data("coco_images").collect()} and {d for _, d in found} <= {r["record_id"] for r in data("vlm_docs").collect()}


def usable(data):
    latest = {}
    for r in data("page_vectors").select("page_id", "written_at", "page_embeddings").collect():
        v = r["page_embeddings"]
        ok = v is not None and len(v) == 64 and all(x is not None and np.isfinite(x) for x in v) and any(v)
        if r["page_id"] not in latest or (r["written_at"], ok) > latest[r["page_id"]][:2]:
            latest[r["page_id"]] = (r["written_at"], ok, v)
    return {p: v for p, (_, ok, v) in latest.items() if ok}


def test_subset(rows, data):
    got, pages = rows("p3_subset"), usable(data)
    assert len(got) == max(1, round(len(pages) * 0.01)) == len({r["page_id"] for r in got}) and {r["page_id"] for r in got} <= set(pages)


def test_clusters_are_those_of_brute_force(rows, data):
    pages = usable(data)
    ids = sorted(pages)
    x = np.array([pages[i] for i in ids], np.float64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    root = list(range(len(ids)))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i, j in zip(*np.nonzero(np.triu(x @ x.T >= 0.8, 1))):
        a, b = find(i), find(j)
        root[max(a, b)] = min(a, b)
    want = {(ids[find(i)], ids[i]) for i in range(len(ids)) if find(i) != i}
    got = {tuple(r) for r in rows("p4_found")}
    assert len(got & want) >= 0.99 * len(want) and len(got - want) <= 0.01 * len(want)
    sizes = Counter(a for a, _ in got)
    told = {r["cluster"]: r for r in rows("p4_clusters")}
    assert {c: r["size"] for c, r in told.items()} == {c: n + 1 for c, n in sizes.items()}
    assert all(1 <= len(r["typical"]) <= 3 and all(p == c or (c, p) in got for p in r["typical"]) for c, r in told.items())


def test_splits(rows, data):
    found, splits = rows("p5_found"), rows("p5_splits")
    assert all(r["series_a"] < r["series_b"] for r in found) and len({tuple(r) for r in found}) == len(found)
    assert {r["page_id"] for r in splits} == {r["page_id"] for r in data("page_vectors").select("page_id").collect()} and len({r["page_id"] for r in splits}) == len(splits)
    of = {}
    for r in splits:
        of.setdefault(r["component"], set()).add(r["split"])
    assert all(len(s) == 1 and None not in s for s in of.values())
    series = {}
    by_page = {r["page_id"]: r["component"] for r in splits}
    for r in data("page_vectors").select("page_id", "series").collect():
        if r["series"] is not None:
            series.setdefault(r["series"], set()).add(by_page[r["page_id"]])
    for r in found:
        assert series[r["series_a"]] & series[r["series_b"]]
    parts = rows("p5_deliveries")
    assert {r["delivery"] for r in parts} == {1, 2} and {r["state"] for r in parts if r["delivery"] == 2} >= {"kept"}
    assert sum(r["records"] for r in parts if r["delivery"] == 2) == len(splits)


def test_containers(rows, data):
    room = {r["container_kind"]: r["capacity_tokens"] for r in data("pack_sizes").collect()}
    used, parts = Counter(), Counter()
    for r in rows("p8_containers"):
        used[r["container_kind"], r["container_id"]] += r["n_tokens"]
        parts[r["container_kind"], r["doc_id"], r["part"]] += 1
    assert {k for k, _ in used} == set(room) and all(n <= room[k] for (k, _), n in used.items()) and set(parts.values()) == {1}
    assert len(rows("p8_fill")) == len(room)


def test_mixture(rows, data):
    most = {r["source"]: r["max_repeats"] for r in data("source_targets").collect()}
    got = rows("p9_mixture")
    assert got and all(1 <= r["uses"] <= most[r["source"]] for r in got) and len({r["doc_id"] for r in got}) == len(got)
    shares = rows("p9_shares")
    assert {r["source"] for r in shares} == set(most) and sum(r["actual_share"] for r in shares) == pytest.approx(1, abs=1e-6)


def test_encodings(rows, data):
    found, restored = {r["doc_id"] for r in rows("p10_found")}, rows("p10_restored")
    assert {r["doc_id"] for r in restored} == found and len(restored) == len(found)
    texts = {r["doc_id"]: r["text"] for r in data("documents").collect()}
    assert all(r["text_restored"] != texts[r["doc_id"]] for r in restored if r["restored"]) and all(0.5 <= r["probability"] <= 1.0001 for r in restored)
