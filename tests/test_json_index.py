"""The structural index and the flattening kernels against an ordinary parser, one document after the other."""

import json
import random

import numpy as np
import pyarrow as pa
import pytest

from foliolake.functions.json_index import ARRAY, OBJECT, JsonIndex, indexed
from foliolake.functions.vlm_json import panel_list, panels_of, read_doc
from foliolake.operators import nested_flatten as nf
from foliolake.operators import schema_drift as sd


def rebuilt(ix, i):
    def inside():
        j = i + 1
        while j < ix.stop[i]:
            yield j
            j = ix.stop[j]

    if ix.kind[i] == OBJECT:
        return {ix.names[ix.key[j]]: rebuilt(ix, j) for j in inside()}
    if ix.kind[i] == ARRAY:
        return [rebuilt(ix, j) for j in inside()]
    return json.loads(ix.buf[ix.begin[i] : ix.end[i]].tobytes())


def read_all(docs):
    whole, rest, numbers = indexed(pa.array(docs, pa.string()))
    out = [None if r < 0 else rebuilt(whole, r) for r in whole.root]
    for k, n in enumerate(numbers):
        out[n] = rebuilt(rest, rest.root[k])
    return out


ODD = [
    None, "", " ", "no json", "{", "}", "{}", '{"a"}', '{"a":}', '{"a":1,}', "{,}", '{"a":1 "b":2}', '{"a":[1,]}', '{"a":[,1]}', '{"a":[1 2]}', '{"a":1}}', '{"a":[1}]', '{"a":(1)}', '{"a":01}', '{"a":tru}',
    '{"a":NaN,"b":-Infinity}', '{"a":"\\u00e9\\n\\"x\\\\"}', '{"a":"\\x"}', '{"a":"\\u00g1"}', '{"a":"line\nbreak"}', '{"a":"unfinished', '{"a":"b"} it\'s "quoted', 'Sure "so": {"a": {"b": [null, true, -1.5e3, "{[,:]}"]}} } "', '```json\n{"a": 1}\n```',
    '{"a":1,"a":2}', '{"x":{"k":1,"k":[2]}}', '{"a":"\\ud800"}', '{"a":"' + "\\\\" * 3001 + '"}', "[1, {\"a\": 2}]", '{"a":' + "[" * 150 + "]" * 150 + "}", '{"\\u0061":1}', '{"a":1.}', '{"a":-}', "{'a':1}", '{"a":1}{"b":2}', '\\"{"a":"b\\\\"}', '{"é…誰":"誰も"}', '{"a": {"b": "c"}',
]


def test_index_reads_what_the_parser_reads():
    for docs in (ODD, ODD[::-1], [x for x in ODD for _ in range(2)], [], [None]):
        assert json.dumps(read_all(docs)) == json.dumps([read_doc(x) for x in docs])


def anything(rng, depth=0):
    kind = rng.randrange(8 if depth < 4 else 5)
    if kind >= 6:
        return {rng.choice(["a", "text", "panels", "é\n", 'q"', "k" * 30]) + str(rng.randrange(3)): anything(rng, depth + 1) for _ in range(rng.randrange(4))}
    if kind == 5:
        return [anything(rng, depth + 1) for _ in range(rng.randrange(4))]
    return [None, True, rng.randrange(-99, 99), rng.random() * 1e9, "".join(rng.choice('ab"\\{}[],: é誰\n\t') for _ in range(rng.randrange(9)))][kind]


def test_index_of_random_and_damaged_documents():
    rng = random.Random(1)
    docs = []
    for i in range(600):
        text = json.dumps({"d": anything(rng), "e": anything(rng)}, ensure_ascii=rng.random() < 0.5)
        if i % 3 == 1:
            at = rng.randrange(len(text))
            text = text[:at] + rng.choice(["", '"', "}", "{", ",", "x"]) + text[at + rng.randrange(2) :]
        elif i % 3 == 2:
            text = rng.choice(["", "Here it is: ", '"', "\\"]) + text + rng.choice(["", " done.", ' "', "}", "\n```"])
        docs.append(text)
    assert json.dumps(read_all(docs)) == json.dumps([read_doc(x) for x in docs])


def flat_rows(doc, before):
    """The four tables' rows of one document, by the functions that say what a role, an item and its words are."""
    page = read_doc(doc)
    if page is None:
        return
    cid, told = page.get("canonical_id"), page["error"] if "error" in page else page.get("overall_summary")
    cid = None if cid is None else nf.flat_text(cid)
    panels = panels_of(panel_list(page)[1])
    yield ("page", cid, len(panels), None, None, "error" if "error" in page else None, nf.flat_text(told))
    for pos, panel in enumerate(panels, 1):
        x = panel if isinstance(panel, dict) else {}
        first = lambda names, x=x: next((nf.flat_text(x[k]) for k in names if x.get(k) is not None), None)
        number = first(("panel_number", "panel_no", "panel_id"))
        yield ("panel", cid, pos, number, None, None if panel is None else "panel", first(("description", "panel_description", "scene")))
        items = {"text": [], "speakers": []}
        for name, value in x.items():
            if role := nf.list_role(name, value, before.get(name)):
                items[role] += nf.items_of(value)
        for role, names in (("text", nf.TEXT_WORDS), ("speakers", nf.SPEAKER_WORDS)):
            for k, item in enumerate(items[role], 1):
                who, said = nf.item_words(item, names)
                yield (role, cid, pos, number, k, who, said)


def some_item(rng):
    words = lambda: rng.choice(["hi", " ", "", "Ann: hi there", None, ["a", None, "b"], 7, True, {"z": ["x"]}, [], {}])
    if rng.random() < 0.4:
        return words()
    return {k: words() for k in rng.sample(["text", "words", "dialogue", "line", "who", "character", "speaker", "said_by", "mood", "speech_type", "content"], rng.randrange(5))}


def some_list(rng):
    shape = rng.randrange(5)
    if shape == 0:
        return some_item(rng)
    if shape == 1:
        return {k: rng.choice([None, [], [some_item(rng) for _ in range(3)], ["a", None], some_item(rng)]) for k in rng.sample(["dialogue", "sfx", "narration"], rng.randrange(4))}
    if shape == 2:
        return [rng.choice(["Ann Lee: hi", "Bo: no", None, "plain"]) for _ in range(rng.randrange(4))]
    return [some_item(rng) for _ in range(rng.randrange(5))]


@pytest.mark.parametrize("seed", range(4))
def test_kernels_flatten_as_the_functions_for_one_document(seed):
    rng = random.Random(seed)
    docs, names = [], []
    for _ in range(250):
        fields = ["text", "text_content", "voices", "speakers", "items", "scrawl", "heard", "balloons", "panel_no", "panel_id", "description", "scene", "caption"]
        panels = [rng.choice([None, "x", 3, [], *[{k: some_list(rng) for k in rng.sample(fields, rng.randrange(7))}] * 6]) for _ in range(rng.randrange(5))]
        if rng.random() < 0.3:
            panels = {f"p{j}": x for j, x in enumerate(panels)}
        page = {rng.choice(["canonical_id", "model"]): rng.choice(["c", None, ["c", 1]]), "extra": rng.choice([None, 1, [], "x"]), rng.choice(["panels", "frames"]): panels}
        page |= rng.choice([{}, {"error": rng.choice([None, "timeout"])}, {"overall_summary": rng.choice([None, "told", ["a", "b"]])}, {"summary": {"plot": {"a": 1}}}])
        docs.append(json.dumps(page, ensure_ascii=rng.random() < 0.5) if rng.random() > 0.05 else rng.choice(ODD))
        names.append(rng.choice([None, [], [("scrawl", "text"), ("items", "speakers")], [("heard", "voices"), ("text", "voices"), ("caption", "texts")]]))
    kind = pa.list_(pa.struct([("k", pa.string()), ("v", pa.string())]))
    pairs = pa.array([None if x is None else [{"k": k, "v": v} for k, v in x] for x in names], kind)
    batch = pa.record_batch([pa.array(range(len(docs)), pa.int64()), pa.array(docs, pa.string()), pairs], names=["record_id", "doc", "names"])
    got: dict = {}
    for part in nf._flat_batches([batch]):
        for r in part.to_pylist():
            got.setdefault(r["record_id"], []).append((r["kind"], r["canonical_id"], r["panel_pos"], r["panel_number"], r["item_pos"], r["label"], r["content"]))
            assert r["has_word"] == bool(r["content"] and r["content"].strip())
    for i, doc in enumerate(docs):
        want = list(flat_rows(doc, dict(names[i] or [])))
        assert sorted(map(repr, got.get(i, []))) == sorted(map(repr, want)), (doc, names[i])


def test_pieces_do_not_matter(monkeypatch):
    docs = [json.dumps({"panels": [{"text": ["a"] * (i % 5)}] * (i % 4)}) for i in range(50)] + ["", None, "x" * 500]
    batch = pa.record_batch([pa.array(range(53), pa.int64()), pa.array(docs, pa.string()), pa.nulls(53, pa.list_(pa.struct([("k", pa.string()), ("v", pa.string())])))], names=["record_id", "doc", "names"])
    rows = lambda: sorted(map(repr, (r for part in nf._flat_batches([batch]) for r in part.to_pylist())))
    whole = rows()
    monkeypatch.setattr(nf, "PIECE", 100)
    assert rows() == whole and len(whole) > 100


def test_sliced_columns():
    docs = pa.array(["{}", '{"a":1}', None, '{"b":[1,2]}'], pa.string()).slice(1, 3)
    ix = JsonIndex(docs)
    assert ix.root.tolist()[1] == -1 and [rebuilt(ix, ix.root[i]) for i in (0, 2)] == [{"a": 1}, {"b": [1, 2]}] and not np.any(ix.rest)


def walked(page):
    """(path, JSON type) of every field in the panel list, by the plain rule."""
    name, value = panel_list(page)
    if name is None:
        return

    def visit(path, v, top=False):
        yield path, sd.json_type(v)
        if isinstance(v, dict):
            keyless = top and (not v or any(isinstance(x, dict) for x in v.values()))
            for k, x in v.items():
                yield from inside(path, x) if keyless else visit(f"{path}.{k}", x)
        elif isinstance(v, list):
            for x in v:
                yield from inside(path, x)

    def inside(path, x):
        if isinstance(x, dict):
            for k, y in x.items():
                yield from visit(f"{path}.{k}", y)
        elif isinstance(x, list):
            for y in x:
                yield from inside(path, y)

    yield from visit(name, value, True)


@pytest.mark.parametrize("seed", range(3))
def test_profiles_have_the_types_of_the_plain_rule(seed):
    rng = random.Random(seed)
    docs, feeds, seqs = [], [], []
    for i in range(300):
        panels = [rng.choice([None, "x", anything(rng), {"a": anything(rng), "text": anything(rng)}]) for _ in range(rng.randrange(4))]
        if rng.random() < 0.3:
            panels = {f"p{j}": x for j, x in enumerate(panels)}
        docs.append(rng.choice([json.dumps({"model": "m", "panels": panels, "z": rng.choice([None, {}, [{"q": 1}]])}), rng.choice(ODD)]))
        feeds.append(rng.choice("fg"))
        seqs.append(rng.randrange(1, 4))
    batch = pa.record_batch([pa.array(feeds), pa.array(seqs, pa.int32()), pa.array(docs, pa.string())], names=["feed", "file_seq", "doc"])
    got = {(r["feed"], r["file_seq"], r["path"]): (r["n"], r["types"]) for part in sd._profile_batches([batch]) for r in part.to_pylist()}
    want: dict = {}
    for feed, seq, doc in zip(feeds, seqs, docs):
        for path, kind in walked(read_doc(doc) or {}):
            own = want.setdefault((feed, seq, path), [0, set()])
            own[0] += 1
            own[1] |= {kind} - {None}
    assert got == {k: (n, sorted(t)) for k, (n, t) in want.items()}


def test_words_and_numbers_of_a_sketch():
    texts = ["Don't stop — now… Now!", "ÉTÉ été", "", "x", "a-b -c '", "誰も。誰も", "rock’n’roll"]
    of, bucket = sd.word_buckets(pa.array(texts, pa.large_string()))
    words = [["don't", "stop", "now", "now"], ["été", "été"], [], ["x"], ["a-b", "c"], ["誰も", "誰も"], ["rock'n'roll"]]
    assert [(i, sd.bucket_of(w)) for i, own in enumerate(words) for w in own] == list(zip(of.tolist(), bucket.tolist()))
    assert sd.number_words("3") == sd.number_words("3.0") == ["#3"] and sd.number_words("true") == ["#1"] and sd.number_words(" 1, 2.5") == ["#1", "#f2.5"]
    docs = [json.dumps({"panels": [{"t": ["one two", {"u": "two"}], "n": v}]}) for v in (3, "3", True)]
    batch = pa.record_batch([pa.array(["f"] * 3), pa.array([1] * 3, pa.int32()), pa.array(docs)], names=["feed", "file_seq", "doc"])
    sketches = {r["path"]: sd.unpack_sketch(r["sketch"]) for part in sd._profile_batches([batch]) for r in part.to_pylist()}
    assert sketches["panels.t"].sum() == 9 and sketches["panels.t.u"][sd.bucket_of("two")] == 3 and sketches["panels.t"][sd.bucket_of("two")] == 6
    assert sketches["panels"].sum() == 12 and sketches["panels.n"][sd.bucket_of("#3")] == 2 and sketches["panels.n"].sum() == 3
