"""Key normalisers and parsers of page paths and ids, as column expressions."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Prefixes that producers put in front of one and the same key, and double or single image suffixes.
PREFIXES = (
    "CalibreComics_extracted/", "CalibreComics_extracted_20251107/", "CalibreComics_extracted\\", "amazon/", "scans/", "ink/", "calibre_lib/", "Digital Comics/",
)
SUFFIXES = (".jpg.png", ".png", ".jpg", ".jpeg")
#: Folders that hold pages and are no book.
CONTAINER_FOLDERS = ("jpg4cbz", "pages", "page")

_VOLUME = r"(v\d+|\(\d{4}-\d{4}\)|\d{4})"


def _or(x: Column, default: str) -> Column:
    return F.coalesce(F.nullif(x, F.lit("")), F.lit(default))


def without_suffix(key: Column, suffixes: tuple[str, ...] = SUFFIXES) -> Column:
    """One suffix off the end, the first of the list that fits."""
    out = key
    for s in reversed(suffixes):
        out = F.when(F.lower(key).endswith(s), F.substring(key, F.lit(1), F.length(key) - len(s))).otherwise(out)
    return out


def normal_key(key: Column, prefixes: tuple[str, ...] = PREFIXES, *, first_only: bool = False) -> Column:
    """Prefixes off the front (each in turn, or only the first that fits), lower case, one suffix off, path separators to "_"."""
    out = key
    if first_only:
        for p in reversed(prefixes):
            out = F.when(key.startswith(p), F.substring(key, F.lit(len(p) + 1), F.length(key))).otherwise(out)
    else:
        for p in prefixes:
            out = F.regexp_replace(out, "^" + re.escape(p), "")
    return F.translate(without_suffix(F.lower(out)), "/\\", "__")


def series_name(name: Column) -> Column:
    """Volume and years off, punctuation off, blanks to "_", lower case."""
    bare = F.regexp_replace(name, r"\s+" + _VOLUME, "")
    return F.lower(F.regexp_replace(F.trim(F.regexp_replace(bare, r"(?U)[^\w\s]", "")), r"\s+", "_"))


def volume_of(name: Column) -> Column:
    return _or(F.regexp_extract(name, _VOLUME, 1), "unknown")


def issue_of(file_name: Column) -> Column:
    return _or(F.regexp_extract(file_name, r"(\d{3})", 1), "000")


def page_of(file_name: Column) -> Column:
    return F.coalesce(F.concat(F.lit("p"), F.nullif(F.regexp_extract(file_name, r"p(\d{3})", 1), F.lit(""))), F.lit("p000"))


def path_parts(path: Column) -> Column:
    return F.split(F.translate(path, "\\", "/"), "/")


def standard_id(path: Column, source: Column) -> Column:
    """source_series_volume_issue_page from the last folder and the file name; fixed defaults where a part can't be read or the path
    has no folder."""
    parts = path_parts(path)
    folder, name = F.try_element_at(parts, F.lit(-2)), F.try_element_at(parts, F.lit(-1))
    full = F.concat_ws("_", source, series_name(folder), volume_of(folder), issue_of(name), page_of(name))
    return F.when(F.size(parts) >= 2, full).otherwise(F.concat(source, F.lit("_unknown_unknown_000_p000")))


def id_series(std_id: Column) -> Column:
    parts = F.split(std_id, "_")
    return F.when(F.size(parts) >= 2, F.array_join(F.slice(parts, 2, F.greatest(F.size(parts) - 4, F.lit(0))), "_")).otherwise("unknown")


def id_part(std_id: Column, from_end: int, default: str) -> Column:
    """The part ``from_end`` places from the end (1: page, 2: issue, 3: volume)."""
    parts = F.split(std_id, "_")
    return F.when(F.size(parts) >= 2, F.try_element_at(parts, F.lit(-from_end))).otherwise(default)


def source_of(path: Column, known: tuple[str, ...]) -> Column:
    """The first of ``known`` that the path contains in any case."""
    out = F.lit("unknown")
    for k in reversed(known):
        out = F.when(F.contains(F.lower(path), F.lit(k)), F.lit(k)).otherwise(out)
    return out


def book_folder(path: Column) -> Column:
    """The folder a page lies in; the one above where that is a mere container of pages."""
    parts = path_parts(path)
    inner = F.lower(F.try_element_at(parts, F.lit(-2))).isin(*CONTAINER_FOLDERS) & (F.size(parts) >= 3)
    return F.when(inner, F.element_at(parts, -3)).when(F.size(parts) >= 2, F.element_at(parts, -2)).otherwise("")


def page_number(path: Column) -> Column:
    """The last number of the file name that no letter or digit follows; null where there is none."""
    stem = F.regexp_replace(F.regexp_replace(F.lower(F.element_at(path_parts(path), -1)), r"\.[^.]*$", ""), r"\.[a-z0-9]+$", "")
    found = F.regexp_extract_all(stem, F.lit(r"(\d{1,6})(?![0-9a-z])"), 1)
    return F.try_element_at(found, F.lit(-1)).cast("int")


def shown_page(canonical_id: Column) -> Column:
    """Page number for display, without leading zeros: "0" for zeros alone, "" where there is none."""
    stem = F.regexp_replace(F.element_at(F.split(canonical_id, "/"), -1), r"\.[^.]*$", "")
    ways = [F.nullif(F.regexp_extract(stem, w, 1), F.lit("")) for w in (r"(?i)page[_\- ]?(\d+)$", r"(?i)p(\d+)$", r"[_\- ](\d+)$")]
    digits = F.coalesce(*ways)
    return F.when(digits.isNull(), "").otherwise(_or(F.regexp_replace(digits, "^0+", ""), "0"))


def to_posix(path: Column) -> Column:
    """X:\\a\\b -> /mnt/x/a/b; other separators to "/"."""
    drive = F.regexp_extract(path, r"^([A-Za-z]):", 1)
    rest = F.translate(F.regexp_replace(path, r"^[A-Za-z]:", ""), "\\", "/")
    return F.when(drive != "", F.concat(F.lit("/mnt/"), F.lower(drive), rest)).otherwise(rest)


def to_windows(path: Column) -> Column:
    """/mnt/x/a/b -> X:\\a\\b; other paths only change separators."""
    drive = F.regexp_extract(path, r"^/mnt/([a-z])/", 1)
    rest = F.translate(F.regexp_replace(path, r"^/mnt/[a-z]/", "/"), "/", "\\")
    return F.when(drive != "", F.concat(F.upper(drive), F.lit(":"), rest)).otherwise(rest)


def without_scheme(uri: Column) -> Column:
    """bucket/key of an object-store address."""
    return F.regexp_replace(uri, r"^[a-z0-9]+://", "")


def alnum_key(text: Column) -> Column:
    return F.regexp_replace(F.lower(text), "[^a-z0-9]+", "")


def safe_name(text: Column) -> Column:
    """Fit for a file name: other characters than letters, digits, ".", "-" and "_" to "_", no "_" doubled or at the ends."""
    return F.trim(F.regexp_replace(F.regexp_replace(text, r"[^A-Za-z0-9._-]+", "_"), "_+", "_"), F.lit("_"))


def uri_key(key: Column) -> Column:
    """Percent-encoded, "/" kept."""
    return F.array_join(F.transform(F.split(key, "/"), lambda x: F.replace(F.url_encode(x), F.lit("+"), F.lit("%20"))), "/")


def all_digits(name: Column) -> Column:
    """All digits of a name read as one number; 0 where there is none."""
    return F.coalesce(F.try_to_number(F.nullif(F.regexp_replace(name, r"\D", ""), F.lit("")), F.lit("9" * 30)).cast("decimal(30,0)"), F.lit(0))


def token(text: Column) -> Column:
    return F.regexp_replace(F.lower(F.trim(text)), r"[\s_-]+", "_")


def trailing_number(text: Column) -> Column:
    return F.nullif(F.regexp_extract(text, r"(\d+)\D*$", 1), F.lit("")).cast("int")


def last_number_key(stem: Column) -> Column:
    """The last run of letters and digits of a lower-case stem if it is a number, without leading zeros; else null."""
    found = F.nullif(F.regexp_extract(stem, r"(?:^|[^a-z0-9])([0-9]+)[^a-z0-9]*$", 1), F.lit(""))
    return F.when(found.isNotNull(), _or(F.regexp_replace(found, "^0+", ""), "0"))


def image_stem(path: Column) -> Column:
    """The file name of a path in lower case without its image suffixes."""
    return F.regexp_replace(F.lower(F.element_at(path_parts(path), -1)), r"(\.(jpg|jpeg|png|webp|tif|tiff|bmp))+$", "")


def number_forms(number: Column, widths: tuple[int, ...] = (2, 3, 4, 5)) -> Column:
    """The ways to write a number: as it stands, without leading zeros, filled up to each width. Never cut."""
    filled = [F.when(F.length(number) >= w, number).otherwise(F.lpad(number, w, "0")) for w in widths]
    return F.array_distinct(F.array(number, _or(F.regexp_replace(number, "^0+", ""), "0"), *filled))


def candidate_keys(path: Column) -> Column:
    """A bounded array of keys that a path may be known by, the likeliest first: its name, the name once where it stands twice, and its
    folder, or the two folders above it, with each form of the name's last number. No table is needed to make them."""
    stem, parts = image_stem(path), path_parts(path)
    number = F.nullif(F.regexp_extract(stem, r"(\d+)\D*$", 1), F.lit(""))
    folder, above = F.try_element_at(parts, F.lit(-2)), F.try_element_at(parts, F.lit(-3))
    none = F.array().cast("array<string>")

    def numbered(scope: Column) -> Column:
        return F.when(scope.isNotNull() & number.isNotNull(), F.transform(number_forms(number), lambda f: F.concat(scope, F.lit("_"), f))).otherwise(none)

    names = F.array(token(stem), undoubled(token(stem)))
    return F.array_distinct(F.concat(names, numbered(token(folder)), numbered(token(F.concat(above, F.lit("_"), folder)))))


def image_key(path: Column) -> Column:
    """One key of a page image: book folder and last number without leading zeros, or book folder and name where there is no number; the
    name alone in no folder. Folders that merely hold pages are passed over."""
    stem = image_stem(path)
    number = F.nullif(F.regexp_extract(stem, r"(\d+)\D*$", 1), F.lit(""))
    own = F.when(number.isNull(), token(stem)).otherwise(_or(F.regexp_replace(number, "^0+", ""), "0"))
    book = F.nullif(token(book_folder(path)), F.lit(""))
    return F.when(book.isNull(), token(stem)).otherwise(F.concat(undoubled(book), F.lit("_"), own))


def undoubled(text: Column) -> Column:
    """A token list that is the same half twice, once."""
    t = F.split(text, "_")
    h = (F.size(t) / 2).cast("int")
    twice = (F.size(t) % 2 == 0) & (F.slice(t, F.lit(1), h) == F.slice(t, h + 1, h))
    return F.when(twice, F.array_join(F.slice(t, F.lit(1), h), "_")).otherwise(text)


def padded_variants(base: Column, number: Column, widths: tuple[int, ...] = (2, 3, 4, 5)) -> Column:
    """base_p<number> with the number unpadded and padded to each width: position in the array is the priority."""
    forms = [number.cast("string"), *[F.lpad(number.cast("string"), w, "0") for w in widths]]
    return F.array_distinct(F.array(*[F.concat(base, F.lit("_p"), f) for f in forms]))


def suffixes_of(path: Column) -> Column:
    """All path suffixes of whole parts, longest first."""
    parts = path_parts(path)
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "/"))


def last_parts(path: Column, n: int = 3) -> Column:
    parts = F.filter(path_parts(path), lambda x: x != "")
    return F.array_join(F.slice(parts, F.greatest(F.size(parts) - n + 1, F.lit(1)), n), "/")


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions)
