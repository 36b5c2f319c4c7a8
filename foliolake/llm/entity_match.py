"""Matching detector images and page analyses without a shared key: a cascade of exact joins.

Names are read into (title, volume, issue, page); titles of both sides are resolved once to classes (equal keys, misprints).
Then each rule joins on a weaker combination of attributes the records that no earlier rule resolved: images left over with all
analyses, and analyses left over with all images, so that second scans and second analyses of a page are found too. Where a rule
leaves several pages open, image sizes decide (a scan and its reduced copy keep their proportions), or nothing is matched.
At the end each image meets all analyses of the pages it was matched to, whichever rules resolved the two.

A pair's confidence is its rule's precision on labelled pairs, smoothed: (right + 1) / (labelled + 2).
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliolake.functions.vlm_json import panel_list, panels_of, read_doc
from foliolake.llm.components import connected_components
from foliolake.llm.page_names import initials, read_file_name, read_path
from foliolake.llm.titles import misprint, misprint_pairs, shortened, title_keys
from foliolake.runtime import materialize, spread

#: Sizes agree up to this in proportion; of one scan or its half-size copy, up to this in scale.
PROPORTION, SCALE = 0.006, 0.012

_SIDE = "title string, kind string, volume int, issue int, page int, width double, height double, panels int"


def read_images(images: DataFrame) -> DataFrame:
    """One row for each image_id with what its file name tells. Repeated rows count once; of rows with one id and different contents
    the greatest is kept; rows without an id are ignored."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            told = [read_file_name(x) for x in pdf["file_name"]]
            out = pd.DataFrame(told, columns=["title", "kind", "volume", "issue", "page"])
            for c in ("volume", "issue", "page"):
                out[c] = out[c].astype("Int32")
            out.insert(0, "image_id", pdf["image_id"].to_numpy())
            out["width"], out["height"] = pdf["width"].astype(float).to_numpy(), pdf["height"].astype(float).to_numpy()
            out["panels"] = pdf["rcnn_panels"].astype("Int32").to_numpy()
            yield out

    slim = images.select("image_id", "file_name", "width", "height", "rcnn_panels").filter("image_id is not null")
    own = slim.groupBy("image_id").agg(F.max(F.struct("file_name", "width", "height", "rcnn_panels")).alias("x")).select("image_id", "x.*")
    return own.mapInPandas(read, "image_id string, " + _SIDE)


def read_analyses(docs: DataFrame) -> DataFrame:
    """One row for each record_id whose document is whole (an error is), with what its image path tells, else its canonical id."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for rid, doc in zip(pdf["record_id"], pdf["doc"]):
                if (page := read_doc(doc)) is None:
                    continue
                path, cid = page.get("image_path"), page.get("canonical_id")
                told = read_path(path if isinstance(path, str) else None)
                if told[0] is None:
                    told = read_path(cid if isinstance(cid, str) else None)
                wh = page.get("image_size_wh")
                ok = isinstance(wh, list) and len(wh) == 2 and all(isinstance(x, (int, float)) and x > 0 for x in wh)
                value = panel_list(page)[1]
                panels = len(panels_of(value)) if value is not None else None
                rows.append((rid, *told, *(map(float, wh) if ok else (None, None)), panels))
            out = pd.DataFrame(rows, columns=["record_id", "title", "kind", "volume", "issue", "page", "width", "height", "panels"])
            for c in ("volume", "issue", "page", "panels"):
                out[c] = out[c].astype("Int32")
            yield out

    slim = docs.select("record_id", "doc").filter("record_id is not null and doc is not null")
    return spread(slim).mapInPandas(read, "record_id long, " + _SIDE).dropDuplicates(["record_id"])


def title_classes(names: DataFrame) -> DataFrame:
    """(key, class): the keys of all titles, equal class for the keys of one title and for misprints of it. ``names``: title, ks."""
    alike = names.filter("ks is not null").select(F.col("ks")[0].alias("a"), F.explode("ks").alias("b")).distinct()
    near = misprint_pairs(alike.select(F.col("b").alias("key")))
    comp = connected_components(alike.unionByName(near))
    return comp.select(F.col("node").alias("key"), F.col("root").alias("class"))


def short_names(names: DataFrame, starts: DataFrame, classes: DataFrame) -> DataFrame:
    """(short, kind, class): the initials of the titles of each class, and the cut-off starts that begin one of its titles, misprinted
    or not. ``names``: title, ks. ``starts``: short. Starts meet titles on what remains when one letter is left out."""

    def letters(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for t, k in zip(pdf["title"], pdf["key"]):
                a = initials(t)
                rows += [(a, k), (a[1:], k)] if t.lower().startswith("the") else [(a, k), ("T" + a, k)]
            yield pd.DataFrame(rows, columns=["short", "key"])

    spaced = names.filter(F.col("title").rlike(r"[^\s_][\s_-]+[^\s_]")).select("title", F.col("ks")[0].alias("key")).filter("key is not null")
    acronyms = spaced.mapInPandas(letters, "short string, key string").filter(F.length("short") >= 2).join(classes, "key").select("short", F.lit("acronym").alias("kind"), "class").distinct()

    # A misprint makes a start one letter shorter or longer than what it begins: a title is cut at every length that occurs, and one off.
    letters_only = F.length(F.regexp_replace("short", r"[^\p{L}\p{N}]", ""))
    occur = {r["n"] for r in starts.select(letters_only.alias("n")).distinct().collect()}  # lengths of file names' parts
    lengths = sorted({n + d for n in occur for d in (-1, 0, 1)} - {-1, 0})

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = {(s, k[:n], c) for k, c in zip(pdf["key"], pdf["class"]) for n in lengths if len(k) >= n for s in shortened(k[:n])}
            yield pd.DataFrame(sorted(rows), columns=["rest", "begin", "class"])

    def cut_start(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = {(s, x) for x in pdf["short"] for s in shortened("".join(c for c in x.lower() if c.isalnum()))}
            yield pd.DataFrame(sorted(rows), columns=["rest", "short"])

    def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            low = ["".join(c for c in x.lower() if c.isalnum()) for x in pdf["short"]]
            yield pdf[[a == b or misprint(a, b) for a, b in zip(low, pdf["begin"])]][["short", "class"]]

    begins = classes.mapInPandas(cut, "rest string, begin string, class string")
    meet = starts.select("short").distinct().mapInPandas(cut_start, "rest string, short string").join(begins, "rest").select("short", "begin", "class").distinct()
    begun = meet.mapInPandas(verify, "short string, class string").select("short", F.lit("start").alias("kind"), "class").distinct()
    return acronyms.unionByName(begun)


def _agreement() -> Column:
    """2: of one scan or its half-size copy; 1: of the same proportions; 0: a size is missing; -1: another shape."""
    sx, sy = F.col("d.width") / F.col("i.width"), F.col("d.height") / F.col("i.height")
    scale = F.sqrt(sx * sy)
    like = F.abs(sx / sy - 1) <= PROPORTION
    return (
        F.when(scale.isNull(), 0)
        .when(like & ((F.abs(scale - 1) <= SCALE) | (F.abs(scale - 0.5) <= SCALE / 2)), 2)
        .when(like, 1)
        .otherwise(-1)
    )


def match_pages(images: DataFrame, docs: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """(image_id, record_id, rule, confidence) of the pairs that show one page.

    ``labels`` (image_id, record_id, same): labelled pairs for the rules' precision. Without it the label of a pair is an
    attribute its rule did not use, where both sides have it: the sizes' proportions, or for rules that used these, panel counts
    that differ by one at most. Names that tell no page match nothing; empty tables give no rows.
    """
    im = read_images(images)
    an = read_analyses(docs).withColumn("kind", F.lit("title"))
    im, an = materialize(im.filter("title is not null and page is not null"), "images"), materialize(an.filter("title is not null and page is not null"), "analyses")
    # The keys of a title are worked out once for each way to write it.
    named = im.filter("kind = 'title'").select("title").unionByName(an.select("title")).distinct()
    names = materialize(named.select("title", title_keys(F.col("title")).alias("ks")), "names")
    classes = materialize(title_classes(names), "classes")
    known = materialize(names.select("title", F.col("ks")[0].alias("key")).join(classes, "key"), "known")
    shorts = short_names(names, im.filter("kind = 'start'").select(F.col("title").alias("short")), classes)

    def with_class(df: DataFrame) -> DataFrame:
        return df.join(known, "title", "left")

    i_all = with_class(im.filter("kind = 'title'"))
    i_short = im.filter("kind != 'title'").withColumnRenamed("title", "short").join(shorts, ["short", "kind"]).withColumn("key", F.lit(None).cast("string"))
    cols = ["image_id", "kind", "key", "class", "volume", "issue", "page", "width", "height", "panels"]
    i_all = materialize(i_all.select(cols).unionByName(i_short.select(cols)), "images_classed")
    d_all = materialize(with_class(an).select("record_id", *cols[2:]), "analyses_classed")
    volumes = i_all.filter("kind = 'title'").select("class", "volume").unionByName(d_all.select("class", "volume")).filter("volume is not null")
    single = volumes.groupBy("class").agg(F.countDistinct("volume").alias("n_volumes")).filter("n_volumes = 1").select("class", F.lit(True).alias("one_volume"))
    i_all = i_all.join(single, "class", "left")

    def pairs(i: DataFrame, d: DataFrame, on: list[str]) -> DataFrame:
        cond = [F.col(f"i.{c}") == F.col(f"d.{c}") for c in on]
        return i.alias("i").join(d.alias("d"), cond).select(
            "i.image_id", "d.record_id", "i.kind", F.col("d.class").alias("class"), F.col("d.volume").alias("volume"), F.struct("d.volume", "d.issue").alias("book"), _agreement().alias("agree"),
            F.abs(F.col("i.panels") - F.col("d.panels")).alias("panels_off"), "i.one_volume",
        )

    def decided(p: DataFrame, page_by: str) -> DataFrame:
        """Of each image's open pages (values of ``page_by``) the only one that sizes leave: of the highest agreement above "another shape"."""
        w = Window.partitionBy("image_id")
        ok = p.filter("agree >= 0").withColumn("top", F.max("agree").over(w))
        ok = ok.withColumn("pages", F.size(F.collect_set(F.when(F.col("agree") == F.col("top"), F.col(page_by))).over(w)))
        best = F.max(F.when(F.col("agree") == F.col("top"), F.col(page_by))).over(w)
        return ok.withColumn("chosen", best).filter((F.col("pages") == 1) & (F.col(page_by) == F.col("chosen"))).drop("top", "pages", "chosen")

    every, i_all = i_all, i_all.filter("issue is not null")
    full = i_all.filter("volume is not null")
    no_issue = every.filter("issue is null and kind = 'title'")
    # (rule, images, key of the join, how the rule's open pages are decided, whether sizes were used)
    rules = [
        ("same title", full.filter("kind = 'title'"), ["key", "volume", "issue", "page"], None, False),
        ("title misprinted", full.filter("kind = 'title'"), ["class", "volume", "issue", "page"], None, False),
        ("volume missing, title has one", i_all.filter("volume is null and kind = 'title' and one_volume"), ["class", "issue", "page"], None, False),
        ("volume missing, size decides", i_all.filter("volume is null and kind = 'title' and one_volume is null"), ["class", "issue", "page"], "volume", True),
        ("issue missing, size decides", no_issue.filter("volume is not null"), ["class", "volume", "page"], "book", True),
        ("volume and issue missing, size decides", no_issue.filter("volume is null"), ["class", "page"], "book", True),
        ("initials, size decides", full.filter("kind = 'acronym'"), ["class", "volume", "issue", "page"], "class", True),
        ("start of title, size decides", full.filter("kind = 'start'"), ["class", "volume", "issue", "page"], "class", True),
    ]
    found: DataFrame | None = None
    for name, i, on, page_by, sized in rules:
        # Records resolved by an earlier rule meet only records that are still open.
        if found is None:
            p = pairs(i, d_all, on)
        else:
            fi, fd = found.select("image_id").distinct(), found.select("record_id").distinct()
            left = i.join(fi, "image_id", "left_anti")
            p = pairs(left, d_all, on)
            if page_by is None:
                p = p.unionByName(pairs(i, d_all.join(fd, "record_id", "left_anti"), on)).dropDuplicates(["image_id", "record_id"])
        if page_by is not None:
            p = decided(p, page_by)
        p = p.select("image_id", "record_id", F.lit(name).alias("rule"), F.lit(sized).alias("sized"), "agree", "panels_off")
        p = materialize(p, "pairs")
        found = p if found is None else found.unionByName(p)
    same_page = ["class", "volume", "issue", "page"]
    shown = found.select("image_id", "record_id").join(d_all.select("record_id", *same_page), "record_id").select("image_id", *same_page).distinct()
    shown = shown.join(im.select("image_id", "width", "height", "panels"), "image_id").select("*", F.lit("title").alias("kind"), F.lit(None).cast("boolean").alias("one_volume"))
    p = pairs(shown, d_all, same_page).join(found.select("image_id", "record_id"), ["image_id", "record_id"], "left_anti").dropDuplicates(["image_id", "record_id"])
    p = p.select("image_id", "record_id", F.lit("page of another pair").alias("rule"), F.lit(False).alias("sized"), "agree", "panels_off")
    found = found.unionByName(materialize(p, "pairs"))
    if labels is not None:
        told = found.join(labels.select("image_id", "record_id", "same"), ["image_id", "record_id"])
    else:
        same = F.when(~F.col("sized") & (F.col("agree") != 0), F.col("agree") > 0).when(F.col("sized"), F.col("panels_off") <= 1)
        told = found.withColumn("same", same).filter("same is not null")
    precision = told.groupBy("rule").agg(((F.sum(F.col("same").cast("int")) + 1) / (F.count(F.lit(1)) + 2)).alias("confidence"))
    scored = found.join(F.broadcast(precision), "rule", "left")  # a row for each rule
    return scored.select("image_id", "record_id", "rule", F.coalesce("confidence", F.lit(0.5)).alias("confidence"))
