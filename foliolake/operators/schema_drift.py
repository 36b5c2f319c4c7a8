"""Schemas that drift between the files of a feed: one consistent table, and a report of each change.

1. *Profile*: one pass over the documents, by the structural index of Arrow batches, keeps, for each (feed, file, field path), the JSON types of the non-null values and a
   hashed histogram of the words and numbers under the field. Profiles merge by addition, so they are combined within each
   partition before anything is shuffled; one feed with a third of all rows sends no more than its number of files and fields.
2. *Edit script*: the schema trees of consecutive files are compared by a top-down tree edit distance (:func:`edit_script`), whose
   cheapest script says what was added, removed, renamed, moved or changed its type.
3. *Projection*: the scripts of a feed compose into a map from every path of every file to one consistent path, and each
   document is projected by its file's map and brought to the types of one table.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliolake.functions.json_index import ARRAY, LITERAL, OBJECT, STRING, JsonIndex, column_bytes, indexed, panel_lists, pieces, ranges
from foliolake.functions.vlm_json import flat_text, items_of, panel_list, panels_of, read_doc
from foliolake.runtime import spread

#: Costs of deleting or adding a subtree, of a change of types, and of a move beside the unlikeness.
DROP, RETYPE, MOVE = 1.0, 0.5, 0.5
#: Buckets of a content histogram.
BUCKETS = 2048
#: Profiles that a partition keeps before it passes them on: bounds the memory of a task.
HELD_PROFILES, HELD_COUNTS = 30_000, 4_000_000
#: A batch is worked on in pieces of about this many bytes.
PIECE = 8 << 20

PROFILE_SCHEMA = "feed string, file_seq int, path string, n long, types array<string>, sketch binary"
CHANGE_SCHEMA = "feed string, file_seq int, field_path string, old_path string, change_kind string, old_types array<string>, new_types array<string>, likeness double, cost double"


def json_type(value: object) -> str | None:
    """string, number, boolean, object or array<types of the elements>; None for null, and for an array without a non-null element."""
    if value is None:
        return None
    if isinstance(value, bool):
        return "boolean"
    if isinstance(value, (int, float)):
        return "number"
    if isinstance(value, str):
        return "string"
    if isinstance(value, dict):
        return "object"
    inner = sorted({t for t in map(json_type, value) if t})
    return f"array<{','.join(inner)}>" if inner else None


def _number_word(x: float) -> str:
    if x != x or x in (math.inf, -math.inf):
        return "#nan"
    if x == int(x):
        return f"#{int(x)}" if abs(x) <= 20 else f"#e{int(math.log2(abs(x)))}"
    return f"#f{x:.1f}"


_SCALARS = {"string": 1, "number": 2, "boolean": 3, "object": 4}
_POWERS = np.cumprod(np.full(256, 0x9E3779B97F4A7C15 | 1, np.uint64))
_ALNUM = np.zeros(256, bool)
_ALNUM[list(b"0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ")] = True
_ALNUM[128:] = True
_NUMBERS_TEXT = r"^\s*-?[0-9]+(?:\.[0-9]+)?\s*(?:,\s*-?[0-9]+(?:\.[0-9]+)?\s*)*$"


def _mixed(h: np.ndarray) -> np.ndarray:
    return (((h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(40)).astype(np.int64) % BUCKETS


def bucket_of(word: str) -> int:
    raw = np.frombuffer(word.encode(), np.uint8).astype(np.uint64)
    return int(_mixed(np.array([(raw * _POWERS[np.arange(len(raw)) % 256]).sum()], np.uint64))[0])


def number_words(text: str) -> list[str]:
    """The words of a number, of several between commas, or of a truth value, written so that a change of type keeps them alike."""
    if text in ("true", "false"):
        return ["#1" if text == "true" else "#0"]
    return [_number_word(float(x.strip().replace("Infinity", "inf"))) for x in text.split(",")]


def word_buckets(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(text, bucket) of each word: a run of letters and digits, apostrophes and hyphens between them included, in lower case. From the
    bytes of all texts at once; general punctuation, signs and CJK punctuation divide words as ASCII signs do."""
    texts = pc.replace_substring(pc.utf8_lower(texts), "’", "'")
    buf, starts = column_bytes(texts)
    word = _ALNUM[buf]
    n = len(buf)
    for lead, seconds, width in ((0xE2, (0x80, 0x81), 3), (0xE3, (0x80,), 3), (0xC2, range(0x80, 0xC0), 2)):
        at = np.flatnonzero(buf[: max(n - 1, 0)] == lead)
        at = at[np.isin(buf[at + 1], list(seconds))]
        for k in range(width):
            word[np.minimum(at + k, n - 1)] = False
    join = np.flatnonzero((buf == ord("'")) | (buf == ord("-")))
    join = join[(join > 0) & (join < n - 1)]
    join = join[word[join - 1] & word[join + 1]]
    edge = np.zeros(n + 1, bool)
    edge[starts] = True
    word[join[~edge[join] & ~edge[join + 1]]] = True
    first = word & (edge[:n] | ~np.concatenate([[False], word[:-1]])) if n else word
    at = np.flatnonzero(word)
    heads = np.flatnonzero(first[at])
    if not len(heads):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    place = np.arange(len(at)) - np.repeat(heads, np.diff(np.concatenate([heads, [len(at)]])))
    h = np.add.reduceat(buf[at].astype(np.uint64) * _POWERS[place % 256], heads)
    return np.searchsorted(starts, at[heads], "right") - 1, _mixed(h)


def _node_types(ix: JsonIndex) -> tuple[np.ndarray, list[str | None]]:
    """(code of each value's JSON type, names of the codes); 0 for nulls and for arrays without a non-null element."""
    names: list[str | None] = [None, *_SCALARS]
    code = np.zeros(len(ix.doc), np.int64)
    first = ix.buf[ix.begin]
    code[ix.kind == STRING] = _SCALARS["string"]
    code[ix.kind == OBJECT] = _SCALARS["object"]
    code[ix.kind == LITERAL] = np.select([first == ord("n"), (first == ord("t")) | (first == ord("f"))], [0, _SCALARS["boolean"]], _SCALARS["number"])[ix.kind == LITERAL]
    code[(ix.kind == LITERAL) & (first == ord("N"))] = _SCALARS["number"]
    known: dict[int, int] = {}
    order = np.argsort(ix.level, kind="stable")
    cuts = np.searchsorted(ix.level[order], np.arange((ix.level.max() if len(order) else 0) + 2))
    for d in range(len(cuts) - 2, 0, -1):
        own = order[cuts[d] : cuts[d + 1]]
        own = own[(ix.kind[ix.parent[own]] == ARRAY) & (code[own] > 0)]
        if not len(own):
            continue
        bits = np.array([1 << int(c) for c in range(len(names))], object if len(names) > 62 else np.int64)[code[own]]
        heads = np.flatnonzero(np.concatenate([[True], ix.parent[own][1:] != ix.parent[own][:-1]]))
        sets = np.bitwise_or.reduceat(bits, heads)
        for mask in set(sets.tolist()) - set(known):
            inner = sorted(names[c] for c in range(len(names)) if mask >> c & 1)
            known[mask] = len(names)
            names.append(f"array<{','.join(inner)}>")
        code[ix.parent[own[heads]]] = [known[m] for m in sets.tolist()]
    return code, names


class _Profiles:
    """(feed, file, path) -> [times seen, types, [(buckets, counts)]]."""

    def __init__(self) -> None:
        self.held: dict[tuple[str, int, str], list] = {}
        self.size = 0

    def add(self, ix: JsonIndex, feeds: list, seqs: np.ndarray) -> None:
        """Adds the fields in the panel lists of all documents of an index; ``feeds`` and ``seqs`` by document."""
        tops = np.flatnonzero(ix.level == 0)
        lists = panel_lists(ix)[tops]
        lists = lists[lists >= 0]
        if not len(lists):
            return
        turn = np.zeros(len(ix.doc) + 1, np.int64)
        turn[lists] += 1
        np.subtract.at(turn, ix.stop[lists], 1)
        within = np.cumsum(turn[:-1]) > 0
        # The keys of a panel list that is an object are no names.
        has_child, has_object = np.zeros(len(ix.doc), bool), np.zeros(len(ix.doc), bool)
        has_child[ix.parent[ix.parent >= 0]] = True
        has_object[ix.parent[(ix.kind == OBJECT) & (ix.parent >= 0)]] = True
        dropped = np.zeros(len(ix.doc) + 1, bool)
        dropped[lists[(ix.kind[lists] == OBJECT) & (has_object[lists] | ~has_child[lists])]] = True
        is_list = np.zeros(len(ix.doc), bool)
        is_list[lists] = True
        seen = within & (is_list | ((ix.key >= 0) & ~dropped[ix.parent]))
        paths, above, path = [], [], np.full(len(ix.doc), -1)
        width = len(ix.names) + 1
        order = np.flatnonzero(within)
        order = order[np.argsort(ix.level[order], kind="stable")]
        levels = ix.level[order]
        for d in range(1, (levels[-1] if len(levels) else 0) + 1):
            own = order[np.searchsorted(levels, d) : np.searchsorted(levels, d + 1)]
            up = np.where(is_list[own], -1, path[ix.parent[own]])
            new = seen[own]
            path[own] = up
            pairs, place = np.unique((up[new] + 1) * width + ix.key[own[new]], return_inverse=True)
            path[own[new]] = place + len(paths)
            for x in pairs.tolist():
                parent = x // width - 1
                paths.append(ix.names[x % width] if parent < 0 else f"{paths[parent]}.{ix.names[x % width]}")
                above.append(parent)
        keys = list(zip(feeds, seqs.tolist()))
        files = list(dict.fromkeys(keys))
        number = {k: i for i, k in enumerate(files)}
        file_of = np.array([number[k] for k in keys])
        n_paths = len(paths)

        own = np.flatnonzero(seen)
        group = file_of[ix.doc[own]] * n_paths + path[own]
        times = np.bincount(group, minlength=len(files) * n_paths)
        codes, type_names = _node_types(ix)
        types: dict[int, set] = {}
        for x in np.unique(group * len(type_names) + codes[own]).tolist():
            if x % len(type_names):
                types.setdefault(x // len(type_names), set()).add(type_names[x % len(type_names)])

        leaves = ix.leaves[within[ix.leaves]]
        group = file_of[ix.doc[leaves]] * n_paths + path[leaves]
        is_text = ix.kind[leaves] == STRING
        texts = ix.strings(leaves[is_text])
        numeric = pc.match_substring_regex(texts, _NUMBERS_TEXT).to_numpy(zero_copy_only=False)
        of, bucket = word_buckets(texts.filter(pa.array(~numeric)))
        found = [(group[is_text][~numeric][of], bucket)]
        for values, groups in ((texts.filter(pa.array(numeric)), group[is_text][numeric]), (ix.written(leaves[~is_text]), group[~is_text])):
            coded = values.dictionary_encode()
            words = [[bucket_of(w) for w in number_words(x)] for x in coded.dictionary.to_pylist()]
            counts = np.array([len(w) for w in words], np.int64)
            starts = np.concatenate([[0], np.cumsum(counts)])[:-1].astype(np.int64)
            code = coded.indices.to_numpy()
            flat = np.array([b for w in words for b in w], np.int64)
            found.append((np.repeat(groups, counts[code]), flat[ranges(starts[code], counts[code])] if len(code) else flat[:0]))
        at = np.concatenate([g for g, _ in found]) * BUCKETS + np.concatenate([b for _, b in found])
        at, n = np.unique(at, return_counts=True)
        # What lies in a field lies in all fields around it.
        up = np.array(above, np.int64)
        every, sums = [at], [n]
        while len(at):
            parent = up[at // BUCKETS % n_paths]
            at, n, parent = at[parent >= 0], n[parent >= 0], parent[parent >= 0]
            at = (at // BUCKETS // n_paths * n_paths + parent) * BUCKETS + at % BUCKETS
            every.append(at)
            sums.append(n)
        at, place = np.unique(np.concatenate(every), return_inverse=True)
        n = np.bincount(place, np.concatenate(sums)).astype(np.int64)
        bounds = np.searchsorted(at // BUCKETS, np.arange(len(times) + 1))
        self.size += len(at)
        for g in np.flatnonzero(times).tolist():
            profile = self.held.setdefault((*files[g // n_paths], paths[g % n_paths]), [0, set(), []])
            profile[0] += int(times[g])
            profile[1] |= types.get(g, set())
            lo, hi = bounds[g], bounds[g + 1]
            if hi > lo:
                profile[2].append((at[lo:hi] % BUCKETS, n[lo:hi]))

    def flush(self) -> pd.DataFrame:
        rows = []
        for (f, s, p), (n, t, parts) in self.held.items():
            own = np.zeros(BUCKETS, np.int64)
            for b, c in parts:
                own[b] += c
            rows.append((f, s, p, n, sorted(t), pack_sketch(own)))
        self.held, self.size = {}, 0
        return pd.DataFrame(rows, columns=["feed", "file_seq", "path", "n", "types", "sketch"])


def pack_sketch(counts: np.ndarray) -> bytes:
    """Bucket numbers, then counts: two arrays of little-endian integers."""
    at = np.flatnonzero(counts)
    return at.astype(np.uint16).tobytes() + counts[at].astype(np.uint32).tobytes()


def unpack_sketch(raw: bytes) -> np.ndarray:
    n = len(raw) // 6
    out = np.zeros(BUCKETS)
    out[np.frombuffer(raw, np.uint16, n)] = np.frombuffer(raw, np.uint32, n, 2 * n)
    return out


def _profile_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("feed", pa.string()), ("file_seq", pa.int32()), ("path", pa.string()), ("n", pa.int64()), ("types", pa.list_(pa.string())), ("sketch", pa.binary())])
    held = _Profiles()

    def flushed() -> pa.RecordBatch:
        return pa.RecordBatch.from_pandas(held.flush(), schema, preserve_index=False)

    for batch in batches:
        for part in pieces(batch, "doc", PIECE):
            feeds, seqs = part.column("feed").to_pylist(), part.column("file_seq").to_numpy()
            whole, rest, numbers = indexed(part.column("doc"))
            held.add(whole, feeds, seqs)
            if rest is not None:
                held.add(rest, [feeds[i] for i in numbers], seqs[numbers])
            if len(held.held) > HELD_PROFILES or held.size > HELD_COUNTS:
                yield flushed()
    if held.held:
        yield flushed()


def _merge_profiles(pdf: pd.DataFrame) -> dict[str, tuple[int, list[str], np.ndarray]]:
    out: dict[str, list] = {}
    for path, n, types, sketch in zip(pdf["path"], pdf["n"], pdf["types"], pdf["sketch"]):
        at = out.setdefault(path, [0, set(), np.zeros(BUCKETS)])
        at[0] += int(n)
        at[1].update(types)
        at[2] += unpack_sketch(sketch)
    return {p: (n, sorted(t), s) for p, (n, t, s) in out.items()}


def _merge_file(pdf: pd.DataFrame) -> pd.DataFrame:
    feed, seq = pdf["feed"].iloc[0], int(pdf["file_seq"].iloc[0])
    rows = []
    for p, (n, t, s) in _merge_profiles(pdf).items():
        rows.append((feed, seq, p, n, t, pack_sketch(s)))
    return pd.DataFrame(rows, columns=["feed", "file_seq", "path", "n", "types", "sketch"])


def file_profiles(docs: DataFrame) -> DataFrame:
    """One row for each (feed, file_seq, field path): times seen, types, content histogram.

    ``docs`` has ``feed``, ``file_seq`` and ``doc``; other columns are ignored, so are rows whose feed or file number is null and
    documents that are null, empty or break off. Rows delivered twice change no type and no script.
    """
    slim = docs.select("feed", "file_seq", "doc").filter("feed is not null and file_seq is not null and doc is not null")
    partial = spread(slim).mapInArrow(_profile_batches, PROFILE_SCHEMA)
    return partial.groupBy("feed", "file_seq").applyInPandas(_merge_file, PROFILE_SCHEMA)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Bhattacharyya coefficient of two histograms, 0..1; 0 where one is empty."""
    sa, sb = a.sum(), b.sum()
    return float(np.sqrt(a * b).sum() / math.sqrt(sa * sb)) if sa and sb else 0.0


def best_assignment(cost: list[list[float]], drop: float) -> list[tuple[int, int]]:
    """Pairs (i, j) that minimise the sum of their costs plus ``drop`` for each row and column left out: shortest augmenting
    paths on the matrix padded with the option to leave out."""
    n, m = len(cost), len(cost[0]) if cost else 0
    if not n or not m:
        return []
    size = n + m
    big = np.zeros((size, size))
    big[:n, :m] = cost
    big[:n, m:] = drop
    big[n:, :m] = drop
    u, v, way, match = np.zeros(size + 1), np.zeros(size + 1), np.zeros(size + 1, int), np.zeros(size + 1, int)
    for i in range(1, size + 1):
        match[0], j0 = i, 0
        least, used = np.full(size + 1, np.inf), np.zeros(size + 1, bool)
        while True:
            used[j0] = True
            i0, delta, j1 = match[j0], np.inf, 0
            for j in range(1, size + 1):
                if not used[j]:
                    cur = big[i0 - 1, j - 1] - u[i0] - v[j]
                    if cur < least[j]:
                        least[j], way[j] = cur, j0
                    if least[j] < delta:
                        delta, j1 = least[j], j
            for j in range(size + 1):
                if used[j]:
                    u[match[j]] += delta
                    v[j] -= delta
                else:
                    least[j] -= delta
            j0 = j1
            if match[j0] == 0:
                break
        while j0:
            match[j0] = match[way[j0]]
            j0 = way[j0]
    return [(match[j] - 1, j - 1) for j in range(1, m + 1) if 0 < match[j] <= n]


class Edit(NamedTuple):
    path: str
    old_path: str | None
    kind: str
    old_types: list[str] | None
    new_types: list[str] | None
    likeness: float | None
    cost: float


def edit_script(old: dict, new: dict, min_likeness: float = 0.5) -> list[Edit]:
    """The cheapest script between two schema trees given as path -> (n, types, histogram): a top-down tree edit distance.

    Deleting or adding a subtree costs :data:`DROP`, a rename as much as the contents differ (from 0 to DROP, at ``min_likeness``; less
    alike fields are never a rename), a change of types :data:`RETYPE`. Matching two fields costs the rename and what the cheapest
    matching of their members costs, s / (1 + s) for a sum s, so that edits inside never make it cheaper to drop a field than to keep
    it. Members are matched by a minimum-cost assignment, those of one name like all others at no cost for the name. Of the deleted and
    added subtrees that remain, those under different parents are paired by another assignment: a move costs the unlikeness and
    :data:`MOVE`, and takes the place of a deletion and an addition, which stay in the script at no cost.

    Kinds: added, removed, renamed, retyped, moved. A field whose types are unknown on one side (nulls and empty arrays only) is not
    retyped. What lies under an added, removed or retyped field isn't compared; ties go to the first names in order. The sum of the
    costs is the distance of the trees.
    """
    below: list[dict[str, list[str]]] = []
    for tree in (old, new):
        kids: dict[str, list[str]] = {}
        for p in sorted(tree):
            kids.setdefault(p.rpartition(".")[0], []).append(p)
        below.append(kids)
    known: dict[tuple[str, str], tuple[float, list[Edit]]] = {}

    def rename(a: str, b: str) -> tuple[float, float | None]:
        if a.rpartition(".")[2] == b.rpartition(".")[2]:
            return 0.0, None
        x = likeness(old[a][2], new[b][2])
        return (DROP * (1 - x) / (1 - min_likeness), x) if x > min_likeness else (math.inf, x)

    def match(a: str, b: str) -> tuple[float, list[Edit]]:
        if (a, b) not in known:
            ta, tb = (old[a][1], new[b][1]) if a else (None, None)
            if ta and tb and ta != tb:
                known[a, b] = RETYPE, [Edit(b, a, "retyped", ta, tb, None, RETYPE)]
            else:
                known[a, b] = members(a, b)
        return known[a, b]

    def members(a: str, b: str) -> tuple[float, list[Edit]]:
        left, right = below[0].get(a, []), below[1].get(b, [])
        named, cost, script = {}, [], []
        for g in left:
            row = []
            for c in right:
                first, x = rename(g, c)
                named[g, c] = x
                inside = match(g, c)[0] if first < math.inf else 0.0
                row.append(min(first + inside / (1 + inside), 2 * DROP + 1))
            cost.append(row)
        total, gone, come = 0.0, set(left), set(right)
        for i, j in best_assignment(cost, DROP):
            g, c = left[i], right[j]
            if cost[i][j] > 2 * DROP:
                continue
            gone.discard(g)
            come.discard(c)
            total += cost[i][j]
            if named[g, c] is not None:
                script.append(Edit(c, g, "renamed", old[g][1], new[c][1], named[g, c], rename(g, c)[0]))
            script += match(g, c)[1]
        script += [Edit(g, g, "removed", old[g][1], None, None, DROP) for g in left if g in gone]
        script += [Edit(c, None, "added", None, new[c][1], None, DROP) for c in right if c in come]
        return total + DROP * (len(gone) + len(come)), script

    script = members("", "")[1]
    gone, come = [e for e in script if e.kind == "removed"], [e for e in script if e.kind == "added"]
    cost, like = [], {}
    for i, g in enumerate(gone):
        row = []
        for j, c in enumerate(come):
            apart = g.path.rpartition(".")[0] != c.path.rpartition(".")[0]
            like[i, j] = x = likeness(old[g.path][2], new[c.path][2]) if apart else 0.0
            row.append(MOVE + DROP * (1 - x) / (1 - min_likeness) if x > min_likeness else 2 * DROP + 1)
        cost.append(row)
    for i, j in best_assignment(cost, DROP):
        if cost[i][j] < 2 * DROP:
            g, c = gone[i], come[j]
            script[script.index(g)], script[script.index(c)] = g._replace(cost=0.0), c._replace(cost=0.0)
            script.append(Edit(c.path, g.path, "moved", g.old_types, c.new_types, like[i, j], cost[i][j]))
    return script


def schema_changes(profiles: DataFrame, *, min_likeness: float = 0.5) -> DataFrame:
    """The edit script of every file against the file before it (``file_seq`` - 1) in its feed: feed, file_seq, field_path,
    old_path, change_kind, types before and after, likeness of the contents of a rename or move, cost.

    The first file of a feed, and a file whose predecessor is missing or holds no whole document, has no rows. A move is
    reported beside its removal and its addition.
    """
    # Each file's schema goes to its own comparison and to the next one: a group holds the schemas of two files.
    twice = profiles.withColumn("side", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn("at", F.col("file_seq") + F.col("side"))

    def compare(pdf: pd.DataFrame) -> pd.DataFrame:
        feed, seq = pdf["feed"].iloc[0], int(pdf["at"].iloc[0])
        old, new = _merge_profiles(pdf[pdf["side"] == 1]), _merge_profiles(pdf[pdf["side"] == 0])
        rows = [(feed, seq, *x) for x in edit_script(old, new, min_likeness)] if old and new else []
        return pd.DataFrame(rows, columns=["feed", "file_seq", "field_path", "old_path", "change_kind", "old_types", "new_types", "likeness", "cost"])

    return twice.groupBy("feed", "at").applyInPandas(compare, CHANGE_SCHEMA)


def distances(changes: DataFrame) -> DataFrame:
    """(feed, file_seq, distance, n_edits): the tree edit distance of each file that differs from the file before it."""
    return changes.groupBy("feed", "file_seq").agg(F.sum("cost").alias("distance"), F.count(F.lit(1)).alias("n_edits"))


def reported_changes(changes: DataFrame) -> DataFrame:
    """(feed, file_seq, field_path, change_kind) without the moves, which stand there as removed and added."""
    return changes.filter("change_kind != 'moved'").select("feed", "file_seq", "field_path", "change_kind").distinct()


#: The consistent table's columns, their types, and for each the fixed names a feed's first file may give the field.
CONSISTENT = {
    "panel_number": ("string", ("panel_number", "panel_no", "panel_id")),
    "description": ("string", ("description", "panel_description", "scene")),
    "caption": ("string", ("caption", "caption_text", "narration_box")),
    "box": ("array<double>", ("box_2d", "bbox", "bounds")),
    "texts": ("array<struct<speaker:string,content:string>>", ("text_content", "text", "lettering")),
    "speakers": ("array<struct<speaker:string,content:string>>", ("speakers", "voices", "speaking")),
    "elements": ("array<string>", ("key_elements", "items", "objects_seen")),
    "actions": ("array<string>", ("actions", "activity", "movements")),
    "mood": ("string", ("mood", "tone")),
    "shot": ("string", ("shot", "framing")),
    "certainty": ("double", ("certainty", "confidence")),
    "full_page": ("boolean", ("full_page", "is_splash")),
    "colors": ("array<string>", ("colors", "palette")),
}
#: Names of the members of texts and speaker lines, and what they are called in the consistent table.
INNER = {
    "texts": {"text": "content", "words": "content", "content": "content", "lettering": "content", "dialogue": "content", "line": "content", "speaker": "speaker", "said_by": "speaker", "character": "speaker", "who": "speaker"},
    "speakers": {"dialogue": "content", "line": "content", "text": "content", "words": "content", "content": "content", "character": "speaker", "who": "speaker", "speaker": "speaker", "name": "speaker"},
}
PANEL_SCHEMA = (
    "record_id long, feed string, file_seq int, panel_pos int, " + ", ".join(f"{c} {t}" for c, (t, _) in CONSISTENT.items()) + ", other map<string,string>"
)


def name_maps(profiles: DataFrame, changes: DataFrame) -> DataFrame:
    """For each file the map from its fields' paths, below the panel list, to consistent paths: (feed, file_seq, names).

    A field keeps the place and name it has in the feed's first file through all later renames, at every depth: a path's map is that of
    its parent and the field's own name. Only paths and renames travel to the feed's group, some short rows for each file.
    """
    files = profiles.select("feed", "file_seq", "path", F.lit("field").alias("kind"), F.lit(None).cast("string").alias("old_path"))
    renames = changes.filter("change_kind = 'renamed'").select("feed", "file_seq", F.col("field_path").alias("path"), F.lit("renamed").alias("kind"), "old_path")
    known = {alias: c for c, (_, names) in CONSISTENT.items() for alias in names}
    inner = lambda path: path.partition(".")[2]

    def compose(pdf: pd.DataFrame) -> pd.DataFrame:
        feed, line, rows = pdf["feed"].iloc[0], {}, []
        for seq, part in pdf.groupby("file_seq", sort=True):
            was = {inner(p): inner(o) for p, o in part.loc[part["kind"] == "renamed", ["path", "old_path"]].itertuples(index=False) if "." in p}
            now: dict[str, str] = {}
            before = {"": ""}  # the path in the file before
            for p in sorted(inner(x) for x in part.loc[part["kind"] == "field", "path"] if "." in x):
                up, _, name = p.rpartition(".")
                old = was.get(p) or ".".join(filter(None, [before.get(up, up), name]))
                before[p], parent = old, now.get(up, up)
                if old in line:
                    own = line[old].rpartition(".")[2]
                elif not parent:
                    own = known.get(name, name)
                else:
                    own = INNER.get(parent, {}).get(name, name)
                now[p] = f"{parent}.{own}" if parent else own
            line.update(now)
            rows.append((feed, int(seq), list(now.items())))
        return pd.DataFrame(rows, columns=["feed", "file_seq", "names"])

    return files.unionByName(renames).groupBy("feed").applyInPandas(compose, "feed string, file_seq int, names array<struct<k:string,v:string>>")


def renamed(value: object, path: str, names: dict[str, str]) -> object:
    """A value with its members, at every depth, under their consistent names; the first of two that come to one name stays there."""
    if isinstance(value, list):
        return [renamed(x, path, names) for x in value]
    if not isinstance(value, dict):
        return value
    out: dict = {}
    for k, v in value.items():
        at = f"{path}.{k}"
        to = names.get(at, k).rpartition(".")[2]
        out[k if to in out else to] = renamed(v, at, names)
    return out


def as_type(value: object, kind: str) -> object:
    """The value as the consistent type, whatever type a file gives it; None where it can't be one."""
    if value is None:
        return None
    if kind == "string":
        return flat_text(value)
    if kind == "double":
        try:
            return float(value) if isinstance(value, (int, float, str)) else None
        except ValueError:
            return None
    if kind == "boolean":
        return {"true": True, "1": True, "1.0": True, "yes": True, "false": False, "0": False, "0.0": False, "no": False}.get(flat_text(value).strip().lower())
    if kind == "array<double>":
        parts = value.split(",") if isinstance(value, str) else list(value.values()) if isinstance(value, dict) else value if isinstance(value, list) else [value]
        return [as_type(x, "double") for x in parts]
    if kind == "array<string>":
        return [x.strip() for x in value.split(",")] if isinstance(value, str) else [None if x is None else flat_text(x) for x in items_of(value)]
    out = []
    for x in items_of(value):
        if isinstance(x, dict):
            free = [v for k, v in x.items() if k not in ("speaker", "speech_type")]
            out.append((as_type(x.get("speaker"), "string"), as_type(x["content"] if "content" in x else free, "string")))
        else:
            out.append((None, as_type(x, "string")))
    return out


def consistent_panels(docs: DataFrame, maps: DataFrame) -> DataFrame:
    """Every panel of every file in one table of fixed names and types: each document projected by its file's map, at every depth, and
    each value brought to its column's type. Fields beyond the fixed columns stand in ``other`` as text or JSON.

    Repeated rows give repeated panels only once; nulls among the panels keep their position and have nulls in all fields. A value that
    can't be of its column's type is null there and stands in ``other`` too.
    """
    slim = docs.select("record_id", "feed", "file_seq", "doc").dropDuplicates(["record_id"])
    joined = slim.join(maps, ["feed", "file_seq"], "left")
    columns = {c: t for c, (t, _) in CONSISTENT.items()}

    def project(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for rid, feed, seq, doc, pairs in zip(pdf["record_id"], pdf["feed"], pdf["file_seq"], pdf["doc"], pdf["names"]):
                if (page := read_doc(doc)) is None:
                    continue
                names = {x["k"]: x["v"] for x in pairs} if pairs is not None else {}
                for pos, panel in enumerate(panels_of(panel_list(page)[1]), 1):
                    row, other = dict.fromkeys(columns), {}
                    for k, v in (panel if isinstance(panel, dict) else {}).items():
                        at, v = names.get(k, k), renamed(v, k, names)
                        made = as_type(v, columns[at]) if at in row and row[at] is None else None
                        if made is not None:
                            row[at] = made
                        elif v is not None or at not in row:
                            other[at if at not in row else k] = v if v is None or isinstance(v, str) else json.dumps(v, ensure_ascii=False)
                    rows.append((rid, feed, seq, pos, *row.values(), other))
            yield pd.DataFrame(rows, columns=["record_id", "feed", "file_seq", "panel_pos", *columns, "other"])

    return joined.mapInPandas(project, PANEL_SCHEMA)
