"""Problems 1, 6 and 7 on small fixtures, against plain Python."""

import datetime as dt
import json
import math
import random

import numpy as np
import pytest

from foliolake.functions.vlm_json import read_doc
from foliolake.operators import nested_flatten as nf
from foliolake.operators import schema_drift as sd
from foliolake.operators import skew_agg as sa

DOCS = "record_id long, feed string, file_seq int, doc string, extra string, kind string"


def docs(spark, rows):
    return spark.createDataFrame([(*r, "x", "clash") for r in rows], DOCS)


def changes(spark, files, feed="f"):
    rows = [(n * 100 + i, feed, n, d if isinstance(d, (str, type(None))) else json.dumps(d)) for n, docs_ in files.items() for i, d in enumerate(docs_)]
    got = sd.reported_changes(sd.schema_changes(sd.file_profiles(docs(spark, rows)))).collect()
    return {(r["file_seq"], r["field_path"], r["change_kind"]) for r in got}


WORDS = ["laughing", "running", "hiding", "waiting"]
MOODS = ["tense", "comic", "eerie", "hopeful"]


def page(i, **fields):
    return {"canonical_id": f"c{i}", "model": "m", "panels": [{k: v(i, j) for k, v in fields.items()} for j in range(3)]}


def file(number, **fields):
    return [page(i + 10 * number, **fields) for i in range(8)]


ACT = lambda i, j: [WORDS[(i + j) % 4]]
NUM = lambda i, j: j + 1


def test_rename_needs_like_content(spark):
    got = changes(spark, {1: file(1, actions=ACT, n=NUM), 2: file(2, activity=ACT, n=NUM), 3: file(3, mood=lambda i, j: MOODS[(i + j) % 4], n=NUM)})
    assert got == {(2, "panels.activity", "renamed"), (3, "panels.activity", "removed"), (3, "panels.mood", "added")}


def test_retyped_and_renamed_at_once_and_what_lies_below(spark):
    a = file(1, texts=lambda i, j: [{"text": WORDS[j % 4] + " now", "by": "Ann"}])
    b = file(2, words=lambda i, j: [{"line": WORDS[j % 4] + " now", "by": "Ann"}])
    c = file(3, words=lambda i, j: [WORDS[j % 4] + " now"])
    got = changes(spark, {1: a, 2: b, 3: c})
    assert got == {(2, "panels.words", "renamed"), (2, "panels.words.line", "renamed"), (3, "panels.words", "retyped")}


def test_panel_list_that_becomes_an_object_and_another_name(spark):
    one, two = file(1, n=NUM), file(2, n=NUM)
    for p in two:
        p["panels"] = {f"p{j}": x for j, x in enumerate(p["panels"])}
    three = [{**{k: v for k, v in p.items() if k != "panels"}, "frames": p["panels"]} for p in two]
    got = changes(spark, {1: one, 2: two, 3: three})
    assert got == {(2, "panels", "retyped"), (3, "frames", "renamed")}


def test_what_counts_for_nothing(spark):
    a, b = file(1, x=NUM, y=ACT), file(2, x=NUM, y=ACT)
    broken = json.dumps({"panels": [{"new": 1}]})[:-3]
    b += [broken, None, "", "no json", json.dumps({"canonical_id": "c", "error": "timeout"})]
    b[0]["panels"][0]["y"] = []
    b[1]["panels"][0]["y"] = None
    b[2]["panels"].append(None)
    assert changes(spark, {1: a, 2: b}) == set()
    assert changes(spark, {1: a, 3: file(3, other=lambda i, j: "q")}) == set()  # no file 2


def test_text_around_the_json_counts(spark):
    b = ["Sure!\n" + json.dumps(p) + "\n```" for p in file(2, n=NUM, z=NUM)]
    assert changes(spark, {1: file(1, n=NUM), 2: b}) == {(2, "panels.z", "added")}


def test_mixed_types_are_a_set(spark):
    b = file(2, y=lambda i, j: "a b" if i % 2 else ["a", "b"])
    got = changes(spark, {1: file(1, y=lambda i, j: "a b"), 2: b, 3: file(3, y=lambda i, j: ["a", "b"])})
    assert got == {(2, "panels.y", "retyped"), (3, "panels.y", "retyped")}


def test_moves_are_reported_beside(spark):
    a = file(1, inner=lambda i, j: {"mood": MOODS[j], "k": 1}, n=NUM)
    b = file(2, inner=lambda i, j: {"k": 1}, n=NUM, mood=lambda i, j: MOODS[j])
    rows = [(n * 100 + i, "f", n, json.dumps(p)) for n, f in ((1, a), (2, b)) for i, p in enumerate(f)]
    kinds = {r["change_kind"] for r in sd.schema_changes(sd.file_profiles(docs(spark, rows))).collect()}
    assert kinds == {"added", "removed", "moved"}


def test_assignment_is_the_cheapest():
    rng = random.Random(1)
    for _ in range(50):
        n, m = rng.randint(1, 4), rng.randint(1, 4)
        cost = [[rng.random() * 3 for _ in range(m)] for _ in range(n)]

        def brute(i, free):
            if i == n:
                return len(free)
            return min([1 + brute(i + 1, free)] + [cost[i][j] + brute(i + 1, free - {j}) for j in free])

        pairs = sd.best_assignment(cost, 1.0)
        own = sum(cost[i][j] for i, j in pairs) + (n - len(pairs)) + (m - len(pairs))
        assert math.isclose(own, brute(0, frozenset(range(m))))


def tree(fields):
    """path -> (n, types, histogram) from path -> (type, bucket)."""
    out = {}
    for p, (t, b) in fields.items():
        h = np.zeros(sd.BUCKETS)
        h[list(b)] = 1
        out[p] = (1, [t], h)
    return out


def test_the_script_is_the_cheapest():
    """Flat trees: the sum of the costs is the least of all ways to match, delete and add; no move is possible."""
    rng = random.Random(2)
    for _ in range(60):
        some = lambda: {n: (rng.choice(["string", "number"]), rng.sample(range(6), rng.randint(1, 4))) for n in rng.sample("abcdef", rng.randint(0, 4))}
        old, new = tree(some()), tree(some())

        def pair(a, b):
            x = sd.likeness(old[a][2], new[b][2])
            first = 0 if a == b else 2 * (1 - x) if x > 0.5 else math.inf
            inside = sd.RETYPE if old[a][1] != new[b][1] else 0
            return first + inside / (1 + inside), first + inside

        def brute(left, free):
            if not left:
                return len(free)
            return min([1 + brute(left[1:], free)] + [pair(left[0], b)[0] + brute(left[1:], free - {b}) for b in free])

        script = sd.edit_script(old, new)
        kept = {e.old_path: e.path for e in script if e.kind in ("renamed", "retyped")} | {a: a for a in old if not any(e.old_path == a for e in script)}
        bounded = sum(pair(a, b)[0] for a, b in kept.items()) + sum(e.cost for e in script if e.kind in ("added", "removed"))
        assert math.isclose(bounded, brute(sorted(old), frozenset(new)), abs_tol=1e-9)
        assert math.isclose(sum(e.cost for e in script), sum(pair(a, b)[1] for a, b in kept.items()) + sum(e.cost for e in script if e.kind in ("added", "removed")), abs_tol=1e-9)


def test_what_lies_inside_decides_between_likely_names():
    """Two new fields are equally like the old one; the one with the same members is its new name."""
    old = tree({"x": ("object", [1]), "x.p": ("string", [1]), "x.q": ("number", [7])})
    new = tree({"a": ("object", [1]), "a.r": ("number", [1]), "b": ("object", [1]), "b.p": ("string", [1]), "b.q": ("number", [7])})
    assert {(e.path, e.kind) for e in sd.edit_script(old, new)} == {("b", "renamed"), ("a", "added")}
    many = tree({"x": ("object", [1])} | {f"x.{c}": ("string", [i]) for i, c in enumerate("abcdef")})
    none = tree({"x": ("object", [1])} | {f"x.{c}": ("string", [10 + i]) for i, c in enumerate("uvw")})
    assert {e.kind for e in sd.edit_script(many, none)} == {"added", "removed"} and all("." in e.path for e in sd.edit_script(many, none))


def test_a_move_costs_less_than_dropping_and_adding():
    old = tree({"x": ("object", [1, 2]), "x.m": ("string", [5]), "x.k": ("string", [6])})
    new = tree({"x": ("object", [1, 2]), "x.k": ("string", [6]), "m": ("string", [5])})
    script = sd.edit_script(old, new)
    assert {(e.path, e.kind, e.cost) for e in script} == {("x.m", "removed", 0.0), ("m", "added", 0.0), ("m", "moved", sd.MOVE)}


def test_nested_renames_and_types_are_projected(spark):
    """A member of the texts takes the name the panel's own text list had; numbers, flags and boxes change their type."""
    said = lambda i, j: f"{WORDS[(i + j) % 4]} by the door"
    one = file(1, text=lambda i, j: [{"words": said(i, j), "by": "Ann"}], certainty=lambda i, j: 0.5, bbox=lambda i, j: [1, 2, 3, j], actions=lambda i, j: ["a", "b"])
    two = file(2, text=lambda i, j: [{"text": said(i, j), "by": "Ann"}], certainty=lambda i, j: "0.5", bbox=lambda i, j: f"1, 2,3,{j}", actions=lambda i, j: "a, b")
    three = file(3, lettering=lambda i, j: [{"text": said(i, j), "by": "Ann"}], certainty=lambda i, j: "?", bbox=lambda i, j: [1, 2, 3, j], actions=lambda i, j: ["a", "b"])
    rows = [(n * 100 + i, "f", n, json.dumps(p)) for n, f in ((1, one), (2, two), (3, three)) for i, p in enumerate(f)]
    d = docs(spark, rows)
    p = sd.file_profiles(d)
    got = sd.consistent_panels(d, sd.name_maps(p, sd.schema_changes(p))).collect()
    assert len(got) == 72
    for r in got:
        i, j = r["record_id"] % 100 + 10 * r["file_seq"], r["panel_pos"] - 1
        assert [x["content"] for x in r["texts"]] == [said(i, j)] and r["box"] == [1.0, 2.0, 3.0, j] and r["actions"] == ["a", "b"]
        assert r["certainty"] == (None if r["file_seq"] == 3 else 0.5) and r["other"] == ({"certainty": "?"} if r["file_seq"] == 3 else {})


def test_consistent_panels_follow_renames(spark):
    rows = [(n * 100 + i, "f", n, json.dumps(p)) for n, f in ((1, file(1, actions=ACT)), (2, file(2, activity=ACT))) for i, p in enumerate(f)]
    d = docs(spark, rows)
    p = sd.file_profiles(d)
    got = sd.consistent_panels(d, sd.name_maps(p, sd.schema_changes(p))).collect()
    assert len(got) == 48 and all(r["actions"] is not None and not r["other"] for r in got)


def test_empty_tables(spark):
    d = docs(spark, [])
    assert sd.reported_changes(sd.schema_changes(sd.file_profiles(d))).count() == 0
    assert nf.items_with_words(nf.flatten_pages(d)).count() == 0
    v = spark.createDataFrame([], "series string, page_id long, written_at timestamp_ntz, page_embeddings array<float>")
    assert sa.heavy_keys(sa.skewed_group_stats(v)).count() == 0


def expected_items(doc):
    p = read_doc(doc)
    out = set()
    if p is None:
        return out
    panels = next((v for k, v in p.items() if k not in ("canonical_id", "summary", "overall_summary", "error")), None) or []
    panels = list(panels.values()) if isinstance(panels, dict) else panels
    for pos, x in enumerate(panels, 1):
        for names, kind, keys in ((("text", "text_content"), "text", ("text",)), (("speakers", "voices"), "speakers", ("dialogue", "line"))):
            items = []
            for n in names:
                v = (x or {}).get(n)
                if isinstance(v, list):
                    items += v
                elif isinstance(v, dict):
                    for part in v.values():
                        items += part or []
                elif v is not None:
                    items.append(v)
            for i, it in enumerate(items, 1):
                s = it
                if isinstance(it, dict):
                    s = next((it[k] for k in keys if k in it), None)
                if isinstance(s, list):
                    s = " ".join(y for y in s if y)
                if s and s.strip():
                    out.add((pos, kind, i))
    return out


CASES = [
    {"panels": [{"text_content": [{"text": "a", "speaker": "B"}, None, {"text": "  "}, {"text": ["x", "y"]}], "caption": "no"}, None, {"speakers": [{"character": "C", "dialogue": "hi"}]}]},
    {"panels": {"p2": {"text": {"dialogue": ["a", None, ""], "sfx": None, "narration": ["z"]}}, "p10": {"voices": ["Ann: hi", " "]}}},
    {"frames": [{"text_content": "alone"}, {"text_content": ""}, {"text_content": [["two", "lines"], ["", " "]]}, {"voices": [{"who": "x", "line": ["a"]}]}]},
    {"panels": None},
    {"panels": []},
    {"canonical_id": "x", "error": "timeout"},
]


def test_items_with_words(spark):
    texts = [json.dumps(c) for c in CASES] + ["```json\n" + json.dumps(CASES[0]) + "\n```", json.dumps(CASES[0])[:-4], "", None]
    d = docs(spark, [(i, "f", 1, t) for i, t in enumerate(texts)] * 2)
    flat = nf.flatten_pages(d)
    got = {(r["record_id"], r["panel_pos"], r["item_kind"], r["item_pos"]) for r in nf.items_with_words(flat).collect()}
    assert got == {(i, *x) for i, t in enumerate(texts) for x in expected_items(t)}
    assert nf.items_with_words(flat).count() == len(got)
    pages = {r["record_id"]: r["n_panels"] for r in nf.flat_table(flat, "page").collect()}
    assert pages == {0: 3, 1: 2, 2: 4, 3: 0, 4: 0, 5: 0, 6: 3}
    assert nf.flat_table(flat, "panel").count() == 3 + 2 + 4 + 3


def test_lists_keep_their_role_through_renames(spark, tmp_path):
    """Plain strings, a list of lists and a single string under names that tell nothing, one of them a fixed member's name."""
    from foliolake.plans.core_problems import p7_found

    names = {1: ("text_content", "speakers"), 2: ("scrawl", "heard"), 3: ("items", "scene")}
    rows, want = [], set()
    for seq, (text, who) in names.items():
        for i in range(12):
            said = [f"{WORDS[i % 4]} by the door", ["to", f"{MOODS[i % 4]} night"]] if i % 3 else f"{WORDS[i % 4]} by the door"
            panel = {"caption": f"cap {MOODS[(i + 1) % 4]} roof", text: said, who: f"captain {i % 2} shouts orders"}
            rows.append((seq * 100 + i, "f", seq, json.dumps({"canonical_id": f"c{i}", "panels": [panel] * 2})))
            for pos in (1, 2):
                want |= {(seq * 100 + i, pos, "text", k) for k in range(1, 3 if i % 3 else 2)} | {(seq * 100 + i, pos, "speakers", 1)}
    docs(spark, rows).write.parquet(str(tmp_path / "vlm_docs.parquet"))
    assert {tuple(r) for r in p7_found(spark, str(tmp_path)).collect()} == want


def test_text_views_read_documents_of_any_shape(spark, tmp_path):
    from foliolake.plans.json_queries import vlm_dialogue_lines, vlm_panel_text
    from foliolake.plans.misc_queries import speech_lengths

    fixed = {"panels": [{"description": "A roof", "text_content": [{"text": "hi", "speaker": "Ann"}], "speakers": [{"character": "Ann", "dialogue": "hi"}]}]}
    other = {"page_panels": [{"scene": "A roof", "lettering": [{"words": "hi", "said_by": "Ann"}], "voices": [{"who": "Ann", "line": "hi"}]}]}
    docs(spark, [(1, "f", 1, json.dumps(fixed)), (2, "f", 2, json.dumps(other))]).write.parquet(str(tmp_path / "vlm_docs.parquet"))
    assert {tuple(r) for r in vlm_panel_text(spark, str(tmp_path)).collect()} == {(i, 0, "A roof hi") for i in (1, 2)}
    assert {tuple(r) for r in vlm_dialogue_lines(spark, str(tmp_path)).collect()} == {(i, 0, 0, "Ann: hi") for i in (1, 2)}
    assert [(r["n"], r["chars"]) for r in speech_lengths(spark, str(tmp_path)).collect()] == [(2, 4)]


def test_long_text_and_many_items(spark):
    doc = json.dumps({"panels": [{"text_content": [{"text": "w " * 200_000}] * 3}]})
    assert nf.items_with_words(nf.flatten_pages(docs(spark, [(1, "f", 1, doc)]))).count() == 3


def test_skewed_stats_against_python(spark):
    rng = random.Random(5)
    t0 = dt.datetime(2024, 1, 1)
    rows = []
    for i in range(400):
        series = rng.choice(["hot"] * 6 + ["a", "b", None])
        vec = rng.choice([[rng.random(), 1.0, -2.0], [0.0, 0.0, 0.0], [1.0, float("nan"), 0.0], [1.0], None, [1.0, None, 2.0], [float("inf"), 0.0, 1.0]])
        rows.append((series, rng.choice([None, *range(60)]), rng.choice([None, t0 + dt.timedelta(days=rng.randint(0, 5))]), vec, "x"))
    df = spark.createDataFrame(rows, "series string, page_id long, written_at timestamp_ntz, page_embeddings array<float>, key string")
    got = {r["series"]: r for r in sa.skewed_group_stats(df, dim=3).collect()}
    ok = lambda v: v is not None and len(v) == 3 and all(x is not None and math.isfinite(x) for x in v) and any(v)
    for s in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == s]
        assert got[s]["n_rows"] == len(own) and got[s]["n_pages"] == len({r[1] for r in own} - {None})
        assert got[s]["latest_written_at"] == max((r[2] for r in own if r[2]), default=None)
        used = []
        for p in {r[1] for r in own} - {None}:
            rs = [r for r in own if r[1] == p]
            top = max((r[2] or dt.datetime(1, 1, 1)) for r in rs)
            vs = [r[3] for r in rs if (r[2] or dt.datetime(1, 1, 1)) == top and ok(r[3])]
            if vs:
                used.append(max(tuple(spark_float(x) for x in v) for v in vs))
        assert got[s]["n_usable"] == len(used)
        if used:
            assert got[s]["mean_vector"] == pytest.approx([sum(v[k] for v in used) / len(used) for k in range(3)], rel=1e-5)
    heavy = {r["series"] for r in sa.heavy_keys(sa.skewed_group_stats(df, dim=3), share=0.12).collect()}
    assert heavy == {s for s in ("hot", "a", "b") if sum(r[0] == s for r in rows) >= 0.12 * len(rows)}


def spark_float(x):
    import numpy as np

    return float(np.float32(x))


def test_lists_of_unknown_name():
    assert nf.list_role("spoken", [{"character": "A", "line": "x"}]) == "speakers" and nf.list_role("spoken", ["Ann Lee: hi", None]) == "speakers"
    assert nf.list_role("balloons", [{"words": "x"}]) == "text" and nf.list_role("balloons", {"dialogue": ["x"], "sfx": None}) == "text"
    for v in (["rope", "mask"], {"x1": 1}, {"a": []}, "alone", None, [], [1, 2], [{"x": 1}]):
        assert nf.list_role("other", v) is None
