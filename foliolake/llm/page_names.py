"""Series, volume, issue and page read from image file names and image paths of many makes."""

from __future__ import annotations

import re
from urllib.parse import unquote

_SUFFIX = re.compile(r"(?:\.(?:jpe?g|png|webp|gif|bmp|tiff?))+$", re.I)
_ROMAN = {"I": 1, "V": 5, "X": 10, "L": 50, "C": 100}
_SCAN_NOTES = re.compile(r"\s*\((?:digital|\d+p|c2c|hd|scan)\)", re.I)

#: Ways to write a page in a file name, tried in order; groups t(itle), v(olume), i(ssue), p(age).
FILE_WAYS = [
    re.compile(x, re.I)
    for x in (
        r"^p\.?\s*(?P<p>\d+) of (?P<t>.+?)(?: vol(?:ume)?\.? (?P<v>\d+))?(?: issue (?P<i>\d+))?$",
        r"^(?P<t>.+?)(?:, vol\. (?P<rv>[IVXLC]+|\d+))?(?:, no\. (?P<i>\d+))?(?:, p\. (?P<p>\d+))$",
        r"^scan[ _](?P<t>.+?)(?: v(?P<v>\d+))?(?: (?P<i>\d+))? page (?P<p>\d+)$",
        r"^(?P<t>.+?)(?: v(?P<v>\d+))?(?: #?(?P<i>\d+))? - p(?P<p>\d+)$",
        r"^(?P<short>[^\s~]+)~\d+(?:_v(?P<v>\d+))?(?:_(?P<i>\d+))?_(?P<p>\d+)$",
        r"^(?P<t>.+?)(?:_v(?P<v>\d+))?(?:_(?P<i>\d+))?_p(?P<p>\d+)$",
        r"^(?P<acr>[A-Z&]{2,12})(?:_v(?P<v>\d+))?(?:_(?P<i>\d+))?_(?P<p>\d+)$",
        r"^(?P<t>[^\s_]+?)(?:-v(?P<v>\d+))?(?:-(?P<i>\d+))?-(?P<p>\d+)$",
    )
]

#: Ways to write a page in an image path.
PATH_WAYS = [
    re.compile(x, re.I)
    for x in (
        r"(?:^|/)(?P<t>[^/]+?) - volume (?P<v>\d+) - [^/]*/issue (?P<i>\d+)/page-(?P<p>\d+)$",
        r"(?:^|/)(?P<t>[^/]+)/v(?P<v>\d+)/(?P<i>\d+)/page_(?P<p>\d+)$",
        r"(?:^|/)(?P<t>[^/]+?) v(?P<v>\d+) #(?P<i>\d+)/[a-z0-9]*_(?P<p>\d+)$",
        r"(?:^|/)(?P<t>[^/]+)/vol\.(?P<v>\d+)/[^/]*?_(?P<i>\d+)/(?P<p>\d+)$",
        r"(?:^|/)(?P<t>[^/]+?)(?: v(?P<v>\d+))? (?P<i>\d+) - p(?P<p>\d+)$",
    )
]

Page = tuple[str | None, str | None, int | None, int | None, int | None]


def roman(text: str) -> int:
    total = 0
    for a, b in zip(text.upper(), text.upper()[1:] + " "):
        total += -_ROMAN[a] if _ROMAN.get(b, 0) > _ROMAN[a] else _ROMAN[a]
    return total


def undouble(title: str) -> str:
    """The title once where it stands twice, joined by "_" ("X v01_X v01")."""
    half, bar, rest = title.partition("_")
    return rest if bar and re.sub(r" v\d+$", "", half) == re.sub(r" v\d+$", "", rest) else title


def read_file_name(name: str | None) -> Page:
    """(title, kind, volume, issue, page) of a detector's file name; kind: title, acronym or start (the first letters of a title
    that was cut off). Parts that are missing or unreadable are None; a name of no known make gives only None."""
    if not name:
        return None, None, None, None, None
    stem = _SCAN_NOTES.sub("", unquote(_SUFFIX.sub("", name.strip()))).strip()
    acronym = re.match(r"^[A-Z&]{2,12}_", stem)
    for way in FILE_WAYS:
        if way.groupindex.get("acr") and not acronym:
            continue
        m = way.match(stem)
        if not m or (acronym and "acr" not in way.groupindex):
            continue
        g = m.groupdict()
        volume = int(g["v"]) if g.get("v") else (int(g["rv"]) if g["rv"].isdigit() else roman(g["rv"])) if g.get("rv") else None
        title, kind = (g["acr"], "acronym") if g.get("acr") else (g["short"], "start") if g.get("short") else (undouble(g["t"]), "title")
        return title, kind, volume, int(g["i"]) if g.get("i") else None, int(g["p"])
    return None, None, None, None, None


def read_path(path: str | None) -> Page:
    """As :func:`read_file_name` for the image path of an analysis."""
    if not path:
        return None, None, None, None, None
    stem = _SUFFIX.sub("", path.strip().replace("\\", "/"))
    for way in PATH_WAYS:
        if m := way.search(stem):
            g = m.groupdict()
            return undouble(g["t"]), "title", int(g["v"]) if g.get("v") else None, int(g["i"]), int(g["p"])
    title, _, volume, issue, page = read_file_name(stem.rpartition("/")[2])
    return (title, "title", volume, issue, page) if title else (None, None, None, None, None)


def initials(title: str) -> str:
    """Upper-case first letters of a title's words."""
    words = re.findall(r"[^\W_]+(?:['’][^\W_]+)*|&", re.sub(r"_", " ", title))
    return "".join(w[0].upper() for w in words if w != "&")
