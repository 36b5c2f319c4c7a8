"""Deeply nested page documents as flat tables of pages, panels, speaker lines and text items.

No document is read by itself: a structural index (:mod:`foliolake.functions.json_index`) over the bytes of an Arrow batch gives all
its JSON values at once, with parent indices and offsets. The panels of all documents and the items of all panels are taken from it by
array kernels, a child's position is its place in its list, and keys travel down by a vectorised ``take``. The four tables come from
one pass as one tagged stream, so a caller that filters by ``kind`` prunes nothing it needs and shuffles nothing. :func:`list_role`,
:func:`items_of` and :func:`item_words` say the same for one document; the tests hold the kernels against them.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliolake.functions.json_index import ARRAY, OBJECT, STRING, JsonIndex, indexed, panel_lists, pieces, place_in_group
from foliolake.functions.vlm_json import flat_text, items_of, panel_list, read_doc
from foliolake.runtime import spread

#: Names the two lists of a panel go by.
TEXT_LISTS = frozenset(["lettering", "text", "text_content", "text_items", "texts"])
SPEAKER_LISTS = frozenset(["speakers", "speaking", "voices"])
#: Members of an item that hold its words, and members that say who speaks and how.
TEXT_WORDS = ("text", "words", "content", "dialogue", "line", "lettering")
SPEAKER_WORDS = ("dialogue", "line", "text", "words", "content")
ITEM_LABELS = frozenset(["balloon", "character", "name", "position", "said_by", "speaker", "speech_type", "type", "who"])
#: Members of a panel that are never one of the two lists.
PANEL_MEMBERS = frozenset(
    ["actions", "activity", "bbox", "bounds", "box_2d", "caption", "caption_text", "certainty", "colors", "confidence", "description",
     "framing", "full_page", "is_splash", "items", "key_elements", "mood", "movements", "narration_box", "objects_seen", "palette",
     "panel_description", "panel_id", "panel_no", "panel_number", "scene", "shot", "tone"]
)

FLAT_SCHEMA = (
    "kind string, record_id long, canonical_id string, panel_pos int, panel_number string, item_pos int, "
    "label string, content string, has_word boolean"
)


def list_role(name: str, value: object, before: str | None = None) -> str | None:
    """'text', 'speakers' or None for a member of a panel: by its name, by the name it had ``before`` the renames of its feed, else by
    what the objects in it look like."""
    for known in (name, before):
        if known in TEXT_LISTS:
            return "text"
        if known in SPEAKER_LISTS:
            return "speakers"
    if name in PANEL_MEMBERS:
        return None
    if isinstance(value, dict):
        # Lists of texts by kind: dialogue, narration and the like.
        parts = [v for v in value.values() if v is not None]
        lists = parts and all(isinstance(v, list) for v in parts)
        return "text" if lists and any(isinstance(x, str) for v in parts for x in v) else None
    if not isinstance(value, list):
        return None
    first = next((x for x in value if isinstance(x, dict)), None)
    if first is None:
        said = [x for x in value if isinstance(x, str)]
        return "speakers" if said and all(re.match(r"[^\W\d_][^:]{0,40}: \S", x) for x in said) else None
    if "character" in first or "who" in first or "speech_type" in first or "dialogue" in first or "line" in first:
        return "speakers"
    return "text" if any(k in first for k in TEXT_WORDS) else None


def in_fixed_shape(page: dict) -> dict:
    """The document with the names of the reference's fixed shape: ``panels`` with description, caption, text_content (text, speaker) and
    speakers (dialogue). What has its fixed name already stays, and so does what is in no known place."""

    def renamed(part: dict, to: dict[str, str]) -> dict:
        return {to.get(k, k): v for k, v in part.items()}

    def first(part: dict, name: str, others: Iterable[str]) -> dict[str, str]:
        return {} if name in part else dict.fromkeys([k for k in others if k in part][:1], name)

    def item(value: object, role: str) -> object:
        if not isinstance(value, dict):
            return value
        if role == "text":
            return renamed(value, first(value, "text", TEXT_WORDS) | first(value, "speaker", ("said_by", "character", "who")))
        return renamed(value, first(value, "dialogue", SPEAKER_WORDS))

    def panel(value: object) -> object:
        if not isinstance(value, dict):
            return value
        roles = {k: list_role(k, v) for k, v in value.items()}
        value = {k: [item(x, roles[k]) for x in v] if roles[k] and isinstance(v, list) else v for k, v in value.items()}
        to = first(value, "description", ("panel_description", "scene")) | first(value, "caption", ("caption_text", "narration_box"))
        to |= first(value, "text_content", [k for k, x in roles.items() if x == "text"]) | first(value, "speakers", [k for k, x in roles.items() if x == "speakers"])
        return renamed(value, to)

    name, panels = ("panels", page["panels"]) if "panels" in page else panel_list(page)
    if isinstance(panels, list):
        panels = [panel(x) for x in panels]
    elif isinstance(panels, dict):
        panels = {k: panel(x) for k, x in panels.items()}
    return {"panels" if k == name else k: panels if k == name else v for k, v in page.items()}


def fixed_shape(docs: DataFrame) -> DataFrame:
    """(record_id, doc): the documents in the fixed shape; those in it already, and those that don't parse, as they are."""

    def rename(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc in batch.column("doc").to_pylist():
                page = read_doc(doc)
                fixed = page and in_fixed_shape(page)
                out.append(doc if fixed == page else json.dumps(fixed, ensure_ascii=False))
            yield pa.record_batch([batch.column("record_id"), pa.array(out, pa.string())], names=["record_id", "doc"])

    return spread(docs.select("record_id", "doc")).mapInArrow(rename, "record_id long, doc string")


def item_words(item: object, names: tuple[str, ...]) -> tuple[str | None, str | None]:
    """(who or how, text) of an item."""
    if item is None:
        return None, None
    if isinstance(item, dict):
        label = next((flat_text(item[k]) for k in ("speaker", "said_by", "character", "who") if item.get(k) is not None), None)
        known = [k for k in names if k in item]
        content = item[known[0]] if known else [v for k, v in item.items() if k not in ITEM_LABELS]
        return label, None if content is None else flat_text(content)
    return None, flat_text(item)


#: A batch is worked on in pieces of about this many bytes, which bounds the index arrays of a task.
PIECE = 8 << 20
_SCHEMA = pa.schema(
    [("kind", pa.string()), ("record_id", pa.int64()), ("canonical_id", pa.string()), ("panel_pos", pa.int32()), ("panel_number", pa.string()),
     ("item_pos", pa.int32()), ("label", pa.string()), ("content", pa.string()), ("has_word", pa.bool_())]
)
_NUMBER, _TOLD, _WHO = ("panel_number", "panel_no", "panel_id"), ("description", "panel_description", "scene"), ("speaker", "said_by", "character", "who")
_PLAIN, _TEXT, _SPEAKERS = 0, 1, 2


def _optional(ix: JsonIndex, chosen: np.ndarray) -> pa.Array:
    """The flat text of each chosen value, null for -1."""
    have = chosen >= 0
    rows = np.flatnonzero(have)
    return pc.if_else(pa.array(have), ix.flat_texts(chosen[rows], rows, len(chosen)), pa.scalar(None, pa.string()))


def _has_word(content: pa.Array) -> pa.Array:
    return pc.fill_null(pc.not_equal(pc.utf8_trim_whitespace(content), ""), False)


def _field_roles(ix: JsonIndex, fields: np.ndarray, names: pa.Array | None) -> np.ndarray:
    """The role of each panel field (as :func:`list_role`). ``names``: for each document the earlier names of its lists."""
    known = np.select([ix.codes(TEXT_LISTS), ix.codes(SPEAKER_LISTS), ix.codes(PANEL_MEMBERS)], [_TEXT, _SPEAKERS, 3], -1)
    role = known[ix.key[fields]]
    if names is not None and len(pairs := names.flatten()):
        # (document, name) -> role of the name it had before.
        of_doc = pc.list_parent_indices(names).to_numpy()
        code = pc.fill_null(pc.index_in(pairs.field("k"), pa.array([*ix.names, ""], pa.string())), -1).to_numpy()
        was = np.array([_TEXT if v in TEXT_LISTS else _SPEAKERS if v in SPEAKER_LISTS else 0 for v in pairs.field("v").to_pylist()])
        use = (code >= 0) & (was > 0)
        width = len(ix.names) + 1
        keys, was = (of_doc * width + code)[use], was[use]
        order = np.argsort(keys)
        keys, was = keys[order], was[order]
        mine = ix.doc[fields] * width + ix.key[fields]
        at = np.minimum(np.searchsorted(keys, mine), max(len(keys) - 1, 0))
        if len(keys):
            role = np.where((role != _TEXT) & (role != _SPEAKERS) & (keys[at] == mine), was[at], role)
    role[role == 3] = _PLAIN
    new = fields[role < 0]
    if len(new):
        role[role < 0] = _roles_by_content(ix, new)
    return role


def _roles_by_content(ix: JsonIndex, fields: np.ndarray) -> np.ndarray:
    n = len(ix.doc)
    mine = np.zeros(n, bool)
    mine[fields] = True
    inside = ix.children(mine)
    up = ix.parent[inside]

    def any_of(hit: np.ndarray, parents: np.ndarray) -> np.ndarray:
        out = np.zeros(n, bool)
        out[parents[hit]] = True
        return out

    # An object of lists of strings: texts by kind.
    said = np.flatnonzero((ix.kind == STRING) & (ix.parent >= 0))
    holds_string = any_of(np.ones(len(said), bool), ix.parent[said])
    listy = any_of((ix.kind[inside] == ARRAY) & holds_string[inside], up) & ~any_of((ix.kind[inside] != ARRAY) & ~ix.null[inside], up)
    # A list of objects: by the members of the first.
    first = np.full(n, -1)
    objects = inside[ix.kind[inside] == OBJECT][::-1]
    first[ix.parent[objects]] = objects
    lead = np.zeros(n, bool)
    lead[first[fields][first[fields] >= 0]] = True
    members = ix.children(lead)
    speaks = any_of(ix.codes(("character", "who", "speech_type", "dialogue", "line"))[ix.key[members]], ix.parent[members])
    tells = any_of(ix.codes(TEXT_WORDS)[ix.key[members]], ix.parent[members])
    # A list of strings: lines that begin with a name.
    strings = inside[ix.kind[inside] == STRING]
    strings = strings[(ix.kind[ix.parent[strings]] == ARRAY) & (first[ix.parent[strings]] < 0)]
    named = pc.match_substring_regex(ix.strings(strings), r"^\p{L}[^:]{0,40}: \S").to_numpy(zero_copy_only=False)
    lines = any_of(named, ix.parent[strings]) & ~any_of(~named, ix.parent[strings])
    array, lead_of = ix.kind[fields] == ARRAY, first[fields]
    return np.select(
        [(ix.kind[fields] == OBJECT) & listy[fields], array & (lead_of >= 0) & speaks[lead_of], array & (lead_of >= 0) & tells[lead_of], array & lines[fields]],
        [_TEXT, _SPEAKERS, _TEXT, _SPEAKERS], _PLAIN,
    )


def _items(ix: JsonIndex, lists: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(items, place of its list among ``lists``), as :func:`items_of`: in the order of the documents."""
    at = np.full(len(ix.doc), -1)
    at[lists] = np.arange(len(lists))
    single = lists[~ix.null[lists] & (ix.kind[lists] != ARRAY) & (ix.kind[lists] != OBJECT)]
    inside = ix.children(at >= 0)
    by_kind = ix.kind[ix.parent[inside]] == OBJECT
    parts = inside[by_kind]
    at[parts] = at[ix.parent[parts]]
    below = np.zeros(len(ix.doc), bool)
    below[parts[ix.kind[parts] == ARRAY]] = True
    items = np.concatenate([single, inside[~by_kind], parts[(ix.kind[parts] != ARRAY) & ~ix.null[parts]], ix.children(below)])
    items.sort()
    direct = np.isin(items, single) | np.isin(items, parts)
    return items, np.where(direct, at[items], at[ix.parent[items]])


def _item_texts(ix: JsonIndex, items: np.ndarray, names: tuple[str, ...]) -> tuple[pa.Array, pa.Array]:
    """(who, text) of each item, as :func:`item_words`."""
    mine = np.zeros(len(ix.doc), bool)
    mine[items[ix.kind[items] == OBJECT]] = True
    label = _optional(ix, ix.first_named(mine, _WHO)[items])
    best = ix.first_named(mine, names, nulls=True)[items]
    plain = ~mine[items]
    own = np.where(plain, items, best)
    # Without a known member, all that is no label.
    at = np.full(len(ix.doc), -1)
    at[items] = np.arange(len(items))
    free = ix.children(mine)
    free = free[(best[at[ix.parent[free]]] < 0) & ~ix.codes(ITEM_LABELS)[ix.key[free]]]
    chosen = own >= 0
    values, owner = np.concatenate([own[chosen], free]), np.concatenate([np.flatnonzero(chosen), at[ix.parent[free]]])
    order = np.lexsort([values, owner])
    content = ix.flat_texts(values[order], owner[order], len(items))
    nothing = chosen & ix.null[np.maximum(own, 0)]
    return label, pc.if_else(pa.array(nothing), pa.scalar(None, pa.string()), content)


def _flat_pieces(ix: JsonIndex, ids: pa.Array, names: pa.Array | None) -> Iterator[pa.RecordBatch]:
    pages = np.flatnonzero(ix.level == 0)
    if not len(pages):
        return
    record = ids.take(pa.array(ix.doc[pages]))
    is_page = ix.level == 0
    page_key = _optional(ix, ix.first_named(is_page, ("canonical_id",))[pages])
    error = ix.first_named(is_page, ("error",), nulls=True)[pages]
    summary = pc.fill_null(_optional(ix, np.where(error >= 0, error, ix.first_named(is_page, ("overall_summary",))[pages])), "")
    held = panel_lists(ix)[pages]
    page_of = np.full(len(ix.doc), -1)
    page_of[held[held >= 0]] = np.flatnonzero(held >= 0)
    panels = ix.children(page_of >= 0)
    parent = page_of[ix.parent[panels]]
    n = len(pages)
    yield pa.record_batch(
        [pa.array(["page"] * n), record, page_key, pa.array(np.bincount(parent, minlength=n).astype(np.int32)), pa.nulls(n, pa.string()), pa.nulls(n, pa.int32()),
         pc.if_else(pa.array(error >= 0), "error", pa.scalar(None, pa.string())), summary, _has_word(summary)],
        schema=_SCHEMA,
    )
    m = len(panels)
    if not m:
        return
    pos = pa.array((place_in_group(parent) + 1).astype(np.int32))
    is_panel = np.zeros(len(ix.doc), bool)
    is_panel[panels[ix.kind[panels] == OBJECT]] = True
    number, told = (_optional(ix, ix.first_named(is_panel, x)[panels]) for x in (_NUMBER, _TOLD))
    up = pa.array(parent)
    rid, cid = record.take(up), page_key.take(up)
    yield pa.record_batch(
        [pa.array(["panel"] * m), rid, cid, pos, number, pa.nulls(m, pa.int32()), pc.if_else(pa.array(~ix.null[panels]), "panel", pa.scalar(None, pa.string())), told, _has_word(told)],
        schema=_SCHEMA,
    )
    place = np.full(len(ix.doc), -1)
    place[panels] = np.arange(m)
    fields = ix.children(is_panel)
    roles = _field_roles(ix, fields, names)
    for kind, role, words in (("text", _TEXT, TEXT_WORDS), ("speakers", _SPEAKERS, SPEAKER_WORDS)):
        lists = fields[roles == role]
        items, of_list = _items(ix, lists)
        if not len(items):
            continue
        panel = place[ix.parent[lists]][of_list]
        label, content = _item_texts(ix, items, words)
        above = pa.array(panel)
        yield pa.record_batch(
            [pa.array([kind] * len(items)), rid.take(above), cid.take(above), pos.take(above), number.take(above), pa.array((place_in_group(panel) + 1).astype(np.int32)),
             label, content, _has_word(content)],
            schema=_SCHEMA,
        )


def _flat_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in pieces(batch, "doc", PIECE):
            ids, names = part.column("record_id"), part.column("names")
            names = None if names.null_count == len(names) else names
            whole, rest, numbers = indexed(part.column("doc"))
            yield from _flat_pieces(whole, ids, names)
            if rest is not None:
                at = pa.array(numbers)
                yield from _flat_pieces(rest, ids.take(at), None if names is None else names.take(at))


def renamed_lists(maps: DataFrame) -> DataFrame:
    """(feed, file_seq, names) of the files in which a list goes by a new name: ``maps`` (of ``schema_drift.name_maps``) without all other
    files and names."""
    lists = [*sorted(TEXT_LISTS), *sorted(SPEAKER_LISTS)]
    new = F.filter("names", lambda x: x["v"].isin(lists) & ~x["k"].isin(lists))
    return maps.select("feed", "file_seq", new.alias("names")).filter(F.size("names") > 0)


def flatten_pages(docs: DataFrame, renamed: DataFrame | None = None) -> DataFrame:
    """One tagged table of all four levels (``kind``: page, panel, text, speakers); each row names its parents.

    ``docs`` has ``record_id`` and ``doc``; other columns are ignored. A document that is null, empty, broken off or no object
    gives no row. A page has its panel count in ``panel_pos`` and its summary (or error) in ``content``. Rows delivered twice come
    out twice here: :func:`flat_table` removes repeats. Nulls among panels and items keep their position and have a null content.
    ``renamed``: the lists' new names by file (of :func:`renamed_lists`, then ``docs`` has ``feed`` and ``file_seq`` too). Without it, or in
    a feed whose first file has a new name, a list of new name is known by its objects only.
    """
    if renamed is None:
        given = spread(docs.select("record_id", "doc")).withColumn("names", F.lit(None).cast("array<struct<k:string,v:string>>"))
    else:
        given = spread(docs.select("record_id", "doc", "feed", "file_seq")).join(renamed, ["feed", "file_seq"], "left").select("record_id", "doc", "names")
    return given.mapInArrow(_flat_batches, FLAT_SCHEMA)


def flat_table(flat: DataFrame, kind: str) -> DataFrame:
    """The rows of one level, without repeats: pages, panels, text items or speaker lines."""
    own = flat.filter(F.col("kind") == kind)
    if kind == "page":
        return own.select("record_id", "canonical_id", F.col("panel_pos").alias("n_panels"), F.col("label").alias("status"), "content").distinct()
    if kind == "panel":
        return own.select("record_id", "panel_pos", "panel_number", F.col("content").alias("description")).distinct()
    return own.select("record_id", "panel_pos", "item_pos", F.col("label").alias("speaker"), "content", "has_word").distinct()


def items_with_words(flat: DataFrame) -> DataFrame:
    """(record_id, panel_pos, item_kind, item_pos) of the text items and speaker lines that hold at least one non-blank word."""
    return (
        flat.filter(F.col("kind").isin("text", "speakers") & F.col("has_word"))
        .select("record_id", "panel_pos", F.col("kind").alias("item_kind"), "item_pos")
        .distinct()
    )
