"""URL clean-up and parts."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from pagesearch.functions.text import let


def trim_slashes(url: Column) -> Column:
    return F.regexp_replace(url, r"/+\z", "")


def normalize_url(url: Column) -> Column:
    """Drop the query string and all trailing slashes; a fragment before any ``?`` stays."""
    return trim_slashes(F.substring_index(url, "?", 1))


def site_of(url: Column) -> Column:
    return F.regexp_extract(url, r"\A(https?://[^/?#]+)", 1)


def url_section(root: Column, url: Column) -> Column:
    """First non-empty path part under the root, from the raw URL; empty off the site."""
    path = F.replace(F.replace(url, root, F.lit("")), F.lit("//"), F.lit("/"))
    parts = F.filter(F.split(path, "/"), lambda p: p != "")
    inside = F.startswith(url, root) & (root != "")
    return F.when(inside, F.coalesce(F.get(parts, F.lit(0)), F.lit(""))).otherwise(F.lit(""))


def join_url(root: Column, path: Column) -> Column:
    return F.concat(trim_slashes(root), F.lit("/"), F.regexp_replace(path, r"\A/+", ""))


def fold_dots(url: Column) -> Column:
    """An absolute URL without ``.`` and ``..`` in its path; query and fragment stay as they are."""
    def upward(seen: Column) -> Column:
        return F.slice(seen, F.lit(1), F.greatest(F.size(seen) - 1, F.lit(1)))

    def folded(path: Column) -> Column:
        parts = F.aggregate(
            F.split(path, "/", -1), F.array().cast("array<string>"),
            lambda seen, part: F.when(part == "..", upward(seen)).when(part == ".", seen).otherwise(F.concat(seen, F.array(part))))
        return F.concat(F.array_join(parts, "/"), F.when(path.rlike(r"/\.{1,2}\z"), "/").otherwise(""))

    def rebuilt(u: Column) -> Column:
        part = lambda number: F.regexp_extract(u, r"(?s)\A([A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*)([^?#]*)(.*)\z", number)
        return F.when(u.rlike(r"\A[^?#]*/\.{1,2}(?:[/?#]|\z)"), F.concat(part(1), let(part(2), folded), part(3))).otherwise(u)

    return let(url, rebuilt)


def link_base(page_url: Column, base_href: Column) -> Column:
    """The URL that a page's links are relative to; ``base_href`` is its ``<base href>``, null or empty when it has none."""
    return F.coalesce(F.when(base_href != "", _absolute(page_url, base_href)), page_url)


def resolve_link(page_url: Column, href: Column, base_href: Column | None = None) -> Column:
    """Absolute form of a link found on a page; null for links that are not pages. See ``link_base``."""
    if base_href is None:
        return fold_dots(_absolute(page_url, href))
    return let(link_base(page_url, base_href), lambda base: let(href, lambda link: fold_dots(_absolute(base, link))))


def _absolute(page_url: Column, href: Column) -> Column:
    scheme = F.regexp_extract(page_url, r"\A(https?):", 1)
    folder = F.regexp_replace(
        F.regexp_replace(page_url, r"[?#].*\z", ""), r"\A(https?://[^/]+)(/.*/|/)?.*\z", "$1$2")
    folder = F.when(folder.endswith("/"), folder).otherwise(F.concat(folder, F.lit("/")))
    return (
        F.when(href.isNull() | (href == "") | href.startswith("#"), None)
        .when(href.rlike(r"(?i)\Ahttps?://"), href)
        .when(href.rlike(r"(?i)\A[a-z][a-z0-9+.\-]*:"), None)
        .when(href.startswith("//"), F.concat(scheme, F.lit(":"), href))
        .when(href.startswith("/"), F.concat(site_of(page_url), href))
        .when(href.startswith("?"), F.concat(F.regexp_replace(page_url, r"[?#].*\z", ""), href))
        .otherwise(F.concat(folder, href))
    )
