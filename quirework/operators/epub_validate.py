"""Structural validation of packaged books: each rule a query over the facts of ``sources.epub``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.files import css_references, invalid_entry_name
from ..sources.epub import CSS, NCX, XHTML

IMAGE_EXTENSIONS = ["png", "jpg", "jpeg", "gif", "webp", "bmp", "svg", "tif", "tiff"]
NCNAME, MEDIA_TYPE = r"^[A-Za-z_][\w.\-]*$", r"^[\w.+\-]+/[\w.+\-]+$"
PAGE_BREAK_RULE = r"\.page-break\b"


def _issue(rows: DataFrame, layer: int, code: str | Column, location: Column | None = None, severity: str = "error") -> DataFrame:
    code = F.lit(code) if isinstance(code, str) else code
    return rows.select("artifact", F.lit(layer).alias("layer"), F.col("seq"), code.alias("code"), F.lit(severity).alias("severity"), (location if location is not None else F.col("location")).alias("location"))


def issues(facts: DataFrame) -> DataFrame:
    """(artifact, layer, seq, code, severity, location) of every broken rule, in layers.

    Rules of a layer only see what earlier layers let be read: an archive without a readable
    package has no manifest facts, so it has no manifest issues. ``facts`` is read many times;
    give a stored table.
    """
    kind = {k: facts.where(F.col("kind") == k) for k in ("entry", "mimetype", "problem", "version", "metadata", "meta", "manifest", "item", "nav_item", "spine", "itemref", "ref", "page_break", "css", "nav", "nav_link", "ncx_point")}
    archives = facts.select("artifact").distinct()
    readable = kind["entry"].select("artifact").distinct()
    out = [_issue(kind["problem"], 2, F.col("value"))]
    # entries
    names = kind["entry"].groupBy("artifact", "name").agg(F.count(F.lit(1)).alias("n"), F.min("seq").alias("seq")).where("n > 1")
    out.append(_issue(names, 0, "duplicate_archive_entry", F.col("name")))
    out.append(_issue(kind["entry"].where(invalid_entry_name(F.col("name"))), 0, "invalid_archive_entry"))
    # mimetype
    mime = kind["entry"].where("name = 'mimetype'")
    none = readable.join(mime.select("artifact"), "artifact", "left_anti").select("artifact", F.lit(0).alias("seq"), F.lit("mimetype").alias("location"))
    out += [_issue(none, 1, "missing_mimetype"), _issue(mime.where("flag"), 1, "compressed_mimetype"), _issue(mime.where("seq > 0"), 1, "mimetype_not_first"), _issue(kind["mimetype"].where("NOT flag"), 1, "invalid_mimetype")]
    # package and metadata
    out.append(_issue(kind["version"].where(~F.col("value").rlike(r"^3(\.\d+)*$")), 3, "unsupported_epub_version"))
    head = kind["metadata"]
    out.append(_issue(head.where("NOT flag"), 4, "missing_metadata"))
    for k, name in enumerate(("title", "language", "identifier")):
        have = kind["meta"].where(F.col("name") == name).select("artifact")
        out.append(_issue(head.where("flag").join(have, "artifact", "left_anti").withColumn("seq", F.lit(k)), 4, "missing_metadata"))
    out.append(_issue(head.where("flag AND name = ''"), 4, "missing_metadata"))
    ids = kind["meta"].where("name = 'identifier'").select(F.col("artifact").alias("ia"), F.col("target").alias("id"))
    out.append(_issue(head.where("flag AND name <> ''").join(ids, (F.col("artifact") == F.col("ia")) & (F.col("name") == F.col("id")), "left_anti"), 4, "invalid_package_document"))
    # manifest
    item = kind["item"]
    present = kind["manifest"].where("flag")
    out.append(_issue(kind["manifest"].where("NOT flag"), 5, "missing_manifest"))
    out.append(_issue(present.join(item.select("artifact"), "artifact", "left_anti"), 5, "invalid_manifest"))
    for bad in (~F.col("name").rlike(NCNAME), (F.col("value") == "") | F.col("value").rlike("[#?]"), ~F.col("media_type").rlike(MEDIA_TYPE)):
        out.append(_issue(item.where(bad), 5, "invalid_manifest"))
    lost = item.where("value <> '' AND target IS NULL")
    out.append(_issue(lost, 5, F.when(F.col("flag"), "missing_resource").otherwise("invalid_manifest")))
    for key in ("name", "target"):
        again = item.where(f"{key} <> ''").withColumn("rank", F.row_number().over(Window.partitionBy("artifact", key).orderBy("seq"))).where("rank > 1")
        out.append(_issue(again, 5, "invalid_manifest"))
    with_items = item.groupBy("artifact").agg(F.max("seq").alias("seq"), F.min("location").alias("location"), F.bool_or(F.col("media_type") == XHTML).alias("xhtml"), F.bool_or(F.col("media_type") == CSS).alias("css"))
    out += [_issue(with_items.where("NOT xhtml"), 5, "missing_resource"), _issue(with_items.where("NOT css"), 5, "missing_resource")]
    navs = kind["nav_item"].groupBy("artifact").agg(F.count(F.lit(1)).alias("n_nav"))
    out.append(_issue(with_items.join(navs, "artifact", "left").where("n_nav IS NULL OR n_nav > 1"), 5, "invalid_navigation"))
    # images: the name's extension and the declared type say the same
    is_image, named = F.col("media_type").startswith("image/"), F.lower(F.regexp_extract("value", r"\.([A-Za-z0-9]+)$", 1)).isin(*IMAGE_EXTENSIONS)
    out.append(_issue(item.where(is_image != named), 6, "invalid_image"))
    # spine; of items with one id the first is meant
    first = item.withColumn("rank", F.row_number().over(Window.partitionBy("artifact", "name").orderBy("seq"))).where("rank = 1")
    first = first.select(F.col("artifact").alias("ma"), F.col("name").alias("mid"), F.col("target").alias("path"), F.col("media_type").alias("mtype"))
    refs = kind["itemref"].join(first, (F.col("artifact") == F.col("ma")) & (F.col("name") == F.col("mid")), "left").join(item.select(F.col("artifact").alias("xa")).distinct(), F.col("artifact") == F.col("xa"), "left")
    has_spine = kind["spine"].where("flag")
    out += [_issue(kind["spine"].where("NOT flag"), 7, "missing_spine"), _issue(has_spine.join(kind["itemref"].select("artifact"), "artifact", "left_anti"), 7, "invalid_spine")]
    out.append(_issue(refs.where("name = ''"), 7, "invalid_spine"))
    twice = kind["itemref"].where("name <> ''").withColumn("rank", F.row_number().over(Window.partitionBy("artifact", "name").orderBy("seq"))).where("rank > 1")
    out.append(_issue(twice, 7, "invalid_spine"))
    out.append(_issue(refs.where("name <> '' AND mid IS NULL AND xa IS NOT NULL"), 7, "invalid_spine"))
    out.append(_issue(refs.where(F.col("mid").isNotNull() & ~F.col("mtype").isin(XHTML, "image/svg+xml")), 7, "invalid_spine"))
    ncx = item.where(F.col("media_type") == NCX).select(F.col("artifact").alias("na")).distinct()
    toc = has_spine.join(ncx, F.col("artifact") == F.col("na"), "left").join(first, (F.col("artifact") == F.col("ma")) & (F.col("name") == F.col("mid")), "left")
    out.append(_issue(toc.where((F.col("name") == "") & F.col("na").isNotNull() | (F.col("name") != "") & (F.col("mid").isNull() | (F.col("mtype") != NCX))), 7, "invalid_spine"))
    # documents
    by_path = item.where("target IS NOT NULL").withColumn("rank", F.row_number().over(Window.partitionBy("artifact", "target").orderBy("seq"))).where("rank = 1")
    by_path = by_path.select(F.col("artifact").alias("pa"), F.col("target").alias("p"), F.col("media_type").alias("ptype"))

    def declared(rows: DataFrame) -> DataFrame:
        return rows.join(by_path, (F.col("artifact") == F.col("pa")) & (F.col("target") == F.col("p")), "left")

    ref = declared(kind["ref"])
    solid = F.col("name").isin("img", "stylesheet")
    out.append(_issue(ref.where(solid & (F.col("value") == "")), 8, "invalid_xhtml"))
    out.append(_issue(ref.where(solid & (F.col("value") != "") & F.col("p").isNull()), 8, "broken_resource_reference"))
    out.append(_issue(ref.where((F.col("name") == "a") & (F.col("value") != "") & ~F.col("value").startswith("#") & ~F.col("flag") & F.col("p").isNull()), 8, "broken_resource_reference"))
    out.append(_issue(ref.where((F.col("name") == "img") & ~F.col("ptype").startswith("image/")), 8, "invalid_image"))
    out.append(_issue(ref.where((F.col("name") == "stylesheet") & (F.col("ptype") != CSS)), 8, "invalid_stylesheet"))
    out.append(_issue(kind["page_break"].where("NOT flag"), 8, "invalid_xhtml"))
    # stylesheets: their references, by the folder they are in
    css = kind["css"].withColumn("name", F.explode(css_references(F.col("value")))).where("NOT startswith(name, '#')")
    folder = F.regexp_extract("location", r"^(.*/)?[^/]*$", 1)
    css = declared(css.withColumn("target", _joined(folder, F.regexp_replace("name", r"[#?].*$", ""))))
    out.append(_issue(css.where("p IS NULL"), 9, "broken_resource_reference"))
    # a page break that no readable stylesheet defines
    defined = kind["css"].where(F.col("value").rlike(PAGE_BREAK_RULE)).select("artifact")
    used = kind["page_break"].groupBy("artifact").agg(F.min("seq").alias("seq"), F.min("location").alias("location"))
    out.append(_issue(used.join(defined, "artifact", "left_anti"), 10, "undefined_page_break_style", severity="warning"))
    # navigation document and NCX
    nav_paths = kind["nav_item"].withColumn("rank", F.row_number().over(Window.partitionBy("artifact").orderBy("seq"))).where("rank = 1")
    out.append(_issue(nav_paths.where(F.col("media_type") != XHTML), 11, "invalid_navigation"))
    which = nav_paths.where(F.col("media_type") == XHTML).select(F.col("artifact").alias("va"), F.col("target").alias("vp"))
    at_nav = (F.col("artifact") == F.col("va")) & (F.col("location") == F.col("vp"))
    out.append(_issue(kind["nav"].join(which, at_nav, "left_semi").where("NOT flag"), 11, "invalid_navigation"))
    in_spine = refs.where("path IS NOT NULL").select(F.col("artifact").alias("sa"), F.col("path").alias("sp"), F.col("seq").alias("spine_seq"))
    in_spine = in_spine.groupBy("sa", "sp").agg(F.min("spine_seq").alias("spine_seq"))
    links = declared(kind["nav_link"].join(which, at_nav, "left_semi")).join(in_spine, (F.col("artifact") == F.col("sa")) & (F.col("target") == F.col("sp")), "left")
    points = declared(kind["ncx_point"]).join(in_spine, (F.col("artifact") == F.col("sa")) & (F.col("target") == F.col("sp")), "left")
    for layer, rows in ((11, links), (12, points)):
        out.append(_issue(rows.where("value = ''"), layer, "invalid_navigation"))
        out.append(_issue(rows.where("value <> '' AND NOT startswith(value, '#') AND p IS NULL"), layer, "broken_resource_reference"))
        out.append(_issue(rows.where(F.col("p").isNotNull() & ((F.col("ptype") != XHTML) | F.col("sp").isNull())), layer, "invalid_navigation"))
    back = links.where("spine_seq IS NOT NULL").withColumn("before", F.lag("spine_seq").over(Window.partitionBy("artifact").orderBy("seq"))).where("before > spine_seq")
    back = back.groupBy("artifact").agg(F.min("seq").alias("seq"), F.min("location").alias("location"))
    out.append(_issue(back, 11, "incoherent_navigation_order", severity="warning"))
    all_issues = out[0]
    for more in out[1:]:
        all_issues = all_issues.unionByName(more)
    return all_issues.join(archives, "artifact", "left_semi")


def _joined(folder: Column, path: Column) -> Column:
    """``folder`` and ``path`` as one normal path; null when it steps above the root or leaves the package."""
    external = path.rlike(r"^(/|[A-Za-z][A-Za-z0-9+.-]*:)|\\")
    parts = F.filter(F.split(F.concat(F.coalesce(folder, F.lit("")), path), "/"), lambda p: (p != "") & (p != "."))
    walked = F.aggregate(
        parts, F.struct(F.array().cast("array<string>").alias("at"), F.lit(True).alias("ok")),
        lambda s, p: F.struct(F.when(p == "..", F.slice(s.at, 1, F.greatest(F.size(s.at) - 1, F.lit(0)))).otherwise(F.array_append(s.at, p)).alias("at"), (s.ok & ((p != "..") | (F.size(s.at) > 0))).alias("ok")),
        lambda s: F.when(s.ok, F.array_join(s.at, "/")),
    )
    return F.when(~external, walked)


def verdicts(facts: DataFrame, found: DataFrame) -> DataFrame:
    """Per archive: errors, warnings, and whether it is valid (no error)."""
    counts = found.groupBy("artifact").agg(F.count_if(F.col("severity") == "error").alias("n_errors"), F.count_if(F.col("severity") == "warning").alias("n_warnings"))
    rows = facts.select("artifact").distinct().join(counts, "artifact", "left").na.fill(0)
    return rows.withColumn("valid", F.col("n_errors") == 0)


