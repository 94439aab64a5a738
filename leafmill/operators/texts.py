"""Links inside documents: found, rewritten in place, and collected, without leaving the row."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafmill.functions.paths import LINK_SCHEME, OPEN_ADDRESS, absolute_document_path, url_to_id
from leafmill.functions.text import url_hash
from leafmill.operators.running import cut

MARKDOWN_LINK = r"\[([^\]]+)\]\(([^)]+?)\)"
SVG_LINK = r'(xlink:href=")([^"]*)'
HTML_LINK = r'(<a [^>]*?href=")([^"]*)'


def replace_each(text: Column, pattern: str, new: Callable[[Column, Column], Column]) -> Column:
    """The text with every match of a pattern of two groups replaced by ``new(group 1, group 2)``."""
    gaps = F.split(text, re.sub(r"(?<!\\)\((?!\?)", "(?:", pattern), -1)
    found = F.arrays_zip(F.regexp_extract_all(text, F.lit(pattern), 1).alias("a"), F.regexp_extract_all(text, F.lit(pattern), 2).alias("b"))
    made = F.transform(found, lambda x: new(x["a"], x["b"]))
    return F.array_join(F.zip_with(gaps, F.concat(made, F.array(F.lit(""))), lambda gap, link: F.concat(gap, link)), "")


def document_target(href: Column) -> Column:
    """A link's target: ``gdoc:id#hash`` where its address names a document, else as it is, without back slashes."""
    plain = F.replace(href, F.lit("\\"), F.lit(""))
    id = url_to_id(plain)
    return F.when(id.isNotNull(), F.concat(F.lit(LINK_SCHEME), id, url_hash(plain))).otherwise(plain)


def _collected(targets: Column) -> Column:
    return F.array_distinct(F.filter(targets, lambda t: (t != "") & ~t.startswith("#") & t.contains(":")))


def native_markdown(text: Column) -> tuple[Column, Column]:
    """A document's Markdown with its links between documents, and macros freed of stars; and its distinct links."""
    linked = replace_each(text, MARKDOWN_LINK, lambda label, href: F.concat(F.lit("["), label, F.lit("]("), document_target(href), F.lit(")")))
    free = F.regexp_replace(linked, r"\*(\{\{%\s+.*?\s+%\}\})\*", "$1")
    return free, _collected(F.transform(F.regexp_extract_all(text, F.lit(MARKDOWN_LINK), 2), document_target))


def svg_links(text: Column) -> tuple[Column, Column]:
    """A drawing with its links between documents (without hash), and these, distinct."""

    def target(href: Column) -> Column:
        return F.coalesce(F.concat(F.lit(LINK_SCHEME), url_to_id(href)), href)

    linked = replace_each(text, SVG_LINK, lambda before, href: F.concat(before, target(href)))
    targets = F.transform(F.regexp_extract_all(text, F.lit(SVG_LINK), 2), target)
    return linked, F.array_distinct(F.filter(targets, lambda t: t.startswith(LINK_SCHEME)))


def header_map(documents: DataFrame, headers: str) -> DataFrame:
    """link and means of all documents: the maps (map<string, string>) of each, merged; the last id wins."""
    each = documents.select("id", F.explode(headers).alias("link", "means"))
    return each.groupBy("link").agg(F.max_by("means", F.struct("id", "means")).alias("means"))


def uploaded_links(pages: DataFrame, ids: DataFrame) -> DataFrame:
    """path and html of pages (path, html) whose relative links go to the uploaded documents (path, id).

    Links are looked up by page number, place and target alone; a page's text is shuffled once, to meet its links.
    """
    numbered = cut(pages.select("path", "html").withColumn("__page", F.monotonically_increasing_id()))
    rows = numbered.select("__page", "path", F.posexplode(F.regexp_extract_all("html", F.lit(HTML_LINK), 2)).alias("at", "href"))
    targets = rows.select("__page", "at", absolute_document_path(F.col("path"), F.col("href")).alias("target"))
    found = targets.join(ids.select(F.col("path").alias("target"), "id"), "target", "left").groupBy("__page", "at").agg(F.max("id").alias("id"))
    links = found.groupBy("__page").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "id"))), lambda x: x["id"]).alias("links"))
    befores, hrefs = (F.regexp_extract_all("html", F.lit(HTML_LINK), n) for n in (1, 2))
    gaps = F.split("html", re.sub(r"(?<!\\)\((?!\?)", "(?:", HTML_LINK), -1)
    parts = F.arrays_zip(gaps.alias("gap"), befores.alias("before"), hrefs.alias("href"), F.coalesce("links", F.array().cast("array<string>")).alias("id"))
    whole = F.transform(parts, lambda x: F.concat(x["gap"], F.coalesce(x["before"], F.lit("")), F.coalesce(F.concat(F.lit(OPEN_ADDRESS), x["id"]), x["href"], F.lit(""))))
    return numbered.join(links, "__page", "left").select("path", F.array_join(whole, "").alias("html"))


def rewrite_rules(tag: Column, href: Column, label: Column, rules: tuple[tuple[str, str, str | None, str], ...]) -> Column:
    """The text of the first rule (tag, match, replace, template) that fits a link, else null.

    A rule of match ``$alt`` fits where the address is the label. ``replace`` is a pattern whose first group is the
    value. Templates hold ``$href``, ``$basename``, ``$label`` and ``$value``.
    """
    out = F.lit(None).cast("string")
    for own, match, replace, template in reversed(rules):
        fits = (href == label) if match == "$alt" else href.rlike(match) if match else F.lit(True)
        if own:
            fits = fits & (F.lower(F.replace(tag, F.lit("/"), F.lit(""))) == own.replace("/", "").lower())
        value = F.regexp_extract(href, replace, 1) if replace else href
        text = F.lit(template)
        for name, part in (("$href", href), ("$basename", F.substring_index(href, "/", -1)), ("$label", label), ("$value", value)):
            text = F.replace(text, F.lit(name), part)
        out = F.when(fits, text).otherwise(out)
    return out


def companion_files(selected: DataFrame, files: DataFrame, rule: str) -> DataFrame:
    """The files that go with selected ones: ``rule`` is a Spark SQL predicate over ``picked`` and ``file``.

    Its equalities are the join's keys; a rule must have one. Repeated files stay.
    """
    return selected.alias("picked").join(files.alias("file"), F.expr(rule)).select("file.*")
