"""Series titles: one key for all ways to write a title, and the keys of titles that differ by one misprint."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def spaced_title(title: Column) -> Column:
    """The title with spaces for underscores, without years or volume at its end, an inverted article put back in front."""
    t = F.regexp_replace(F.trim(F.regexp_replace(title, r"[\s_]+", " ")), r"(?i)[\s,]*\(\d{4}(?:\s*[-–]\s*\d{2,4})?\)\s*$", "")
    t = F.regexp_replace(t, r"(?i)[\s,]+v(?:ol(?:ume)?)?\.?\s*\d+\s*$", "")
    t = F.regexp_replace(t, r"(?i)[\s,]*\(\d{4}(?:\s*[-–]\s*\d{2,4})?\)\s*$", "")
    return F.trim(F.regexp_replace(t, r"(?i)^(.*\S)\s*,\s*(the|a|an)$", "$2 $1"))


def title_key(title: Column) -> Column:
    """Lower-case letters and digits of :func:`spaced_title` alone: equal for a title however its words are joined, cased or
    punctuated. Null for a null or empty title."""
    return F.nullif(F.regexp_replace(F.lower(spaced_title(title)), r"[^\p{L}\p{N}]+", ""), F.lit(""))


def title_keys(title: Column) -> Column:
    """Array of the keys a title is known by, :func:`title_key` first: with and without an article in front, and with "and" for
    "&". The ways to write one title share at least one of them. Null for a null or empty title."""
    t = F.regexp_replace(spaced_title(title), r"[’`]", "'")
    bare = F.lower(F.regexp_replace(t, r"[^\p{L}\p{N}&]+", ""))
    full, spelt = F.regexp_replace(bare, "&", ""), F.regexp_replace(bare, "&", "and")
    ways = [k for x in (full, spelt) for k in (x, F.regexp_replace(x, r"^the(?=.{4})", ""))]
    return F.when(F.length(full) > 0, F.array_distinct(F.array(*ways)))


def misprint(a: str, b: str) -> bool:
    """True for two different keys one of which is a misprint of the other, or both of one title: a letter left out, doubled or
    put in, two neighbours exchanged, or one letter missing in each at different places. One letter for another is no misprint
    (it makes another word), and a digit makes another title."""
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) > len(b):
        a, b = b, a
    i = 0
    while i < len(a) and a[i] == b[i]:
        i += 1
    if len(b) == len(a) + 1:
        return a[i:] == b[i + 1 :] and b[i].isalpha()
    j = len(a)
    while j > i and a[j - 1] == b[j - 1]:
        j -= 1
    x, y = a[i:j], b[i:j]
    if len(x) < 2 or not (x + y).isalpha():
        return False
    return (len(x) == 2 and x == y[::-1]) or x[1:] == y[:-1] or y[1:] == x[:-1]


def shortened(key: str) -> set[str]:
    """The key itself and the key with any one character left out: two keys one misprint apart share one of these."""
    return {key} | {key[:i] + key[i + 1 :] for i in range(len(key))}


def remainders(key: Column) -> Column:
    """Hashes of what :func:`shortened` gives: of the key and of the key with any one character left out."""
    cut = F.transform(F.sequence(F.lit(1), F.length(key)), lambda i: F.xxhash64(F.concat(F.substring(key, F.lit(1), i - 1), F.substring(key, i + 1, F.length(key)))))
    return F.array_distinct(F.concat(F.array(F.xxhash64(key)), cut))


def misprint_pairs(keys: DataFrame, *, min_length: int = 4) -> DataFrame:
    """(a, b), a < b: pairs among the distinct ``key`` values that :func:`misprint` holds for.

    Keys meet on what remains when one character is left out, so no key is held against all others; the keys that share a
    remainder differ from it in one character, which bounds each group whatever the number of keys. Keys shorter than
    ``min_length`` only pair with themselves: of so few letters one more makes another title ("V", "VI"). ``keys`` may have a truth
    value ``fresh``: then only pairs with a fresh key are sought; and ``rests``, their :func:`remainders`.
    """
    told = [c for c in ("fresh", "rests") if c in keys.columns]
    distinct = keys.select("key", *told).filter(F.length("key") >= min_length)
    fresh = F.col("fresh") if "fresh" in told else F.lit(True)
    rests = F.col("rests") if "rests" in told else remainders(F.col("key"))
    own = F.struct("key", fresh.alias("fresh"))
    met = distinct.select(F.explode(rests).alias("rest"), own.alias("own")).groupBy("rest").agg(F.collect_set("own").alias("ks"))
    met = met.filter((F.size("ks") > 1) & F.exists("ks", lambda x: x["fresh"])).select(F.col("ks.key").alias("keys"), F.col("ks.fresh").alias("fresh"))

    def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = set()
            for ks, new in zip(pdf["keys"], pdf["fresh"]):
                ks = sorted(zip(ks, new))
                out.update((a, b) for i, (a, x) in enumerate(ks) for b, y in ks[i + 1 :] if (x or y) and misprint(a, b))
            yield pd.DataFrame(sorted(out), columns=["a", "b"])

    return met.mapInPandas(verify, "a string, b string").distinct()
