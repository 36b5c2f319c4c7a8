"""Reading page analyses: text around the JSON is skipped, documents that break off give nothing."""

from __future__ import annotations

import json
from collections.abc import Iterator

#: Members of a page document that are not the panel list.
PAGE_MEMBERS = frozenset(
    ["canonical_id", "error", "image_path", "image_size_wh", "model", "overall_summary", "processed_at", "summary", "usage"]
)


def read_doc(doc: str | None) -> dict | None:
    """The first complete JSON object in ``doc``, or None where there is none, it breaks off or isn't an object."""
    if not doc:
        return None
    start = doc.find("{")
    if start < 0:
        return None
    try:
        value, _ = json.JSONDecoder().raw_decode(doc, start)
    except (ValueError, RecursionError):
        return None
    return value if isinstance(value, dict) else None


def holds_objects(value: object) -> bool:
    """True for a list with an object in it and for an object of objects."""
    if isinstance(value, list):
        return any(isinstance(x, dict) for x in value)
    return isinstance(value, dict) and any(isinstance(x, dict) for x in value.values())


def panel_list(page: dict) -> tuple[str | None, object]:
    """Name and value of the panel list: the first member beyond :data:`PAGE_MEMBERS` that holds objects, else the first
    such member that is null, a list or an object; (None, None) where there is none."""
    spare: tuple[str | None, object] = (None, None)
    for name, value in page.items():
        if name in PAGE_MEMBERS:
            continue
        if holds_objects(value):
            return name, value
        if spare[0] is None and (value is None or isinstance(value, (list, dict))):
            spare = (name, value)
    return spare


def panels_of(value: object) -> list:
    """The panels in document order, nulls included; an object's keys are dropped."""
    if isinstance(value, dict):
        return list(value.values())
    return value if isinstance(value, list) else []


def items_of(value: object) -> list:
    """The items in document order, nulls and blanks included: an object of lists counts on through its lists, a list within the
    list is one item, a single string is the only item."""
    if isinstance(value, list):
        return value
    if isinstance(value, dict):
        out: list = []
        for part in value.values():
            out.extend(part if isinstance(part, list) else [] if part is None else [part])
        return out
    return [] if value is None else [value]


def _leaves(value: object) -> Iterator[str]:
    if isinstance(value, (list, dict)):
        for x in value.values() if isinstance(value, dict) else value:
            yield from _leaves(x)
    elif value is not None:
        yield value if isinstance(value, str) else json.dumps(value)


def flat_text(value: object) -> str:
    """All strings, numbers and truth values in a value, joined by blanks; "" for null."""
    return " ".join(_leaves(value))
