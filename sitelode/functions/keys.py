"""Address keys as column expressions; the four normalisers are not interchangeable."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_AUTHORITY = r"^[A-Za-z][A-Za-z0-9+.\-]*:(?://[^/?#]*)?"


def page_key(page: Column) -> Column:
    """The path of an address: no host, query or fragment; single slashes; no trailing slash. Empty or null: ``/``.

    Case is preserved. Percent-encoding and dot segments are left as they are.
    """
    path = F.regexp_replace(F.regexp_replace(F.trim(F.coalesce(page, F.lit(""))), _AUTHORITY, ""), r"[?#].*$", "")
    rooted = F.regexp_replace(F.concat(F.lit("/"), path), r"/{2,}", "/")
    return F.when(rooted == "/", rooted).otherwise(F.regexp_replace(rooted, r"/$", ""))


def host_of(url: Column) -> Column:
    """Lower-case host without port, user or a leading ``www.``; empty where there is none."""
    host = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)
    return F.regexp_replace(F.lower(host), r"^www\.", "")


def same_host(a: Column, b: Column) -> Column:
    return (host_of(a) == host_of(b)) & (host_of(a) != "")


def resolved_key(url: Column, canonical: Column, site: Column) -> Column:
    """The canonical address's key if it is on the site's host, else the page's own."""
    relative = ~canonical.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*:") & (F.trim(canonical) != "")
    return F.when(canonical.isNotNull() & (same_host(canonical, site) | relative), page_key(canonical)).otherwise(page_key(url))


def effective_key(key: Column, page: Column) -> Column:
    return F.coalesce(F.nullif(key, F.lit("")), page)


def folder(key: Column) -> Column:
    """First path segment; the root for the home page."""
    first = F.split(key, "/")[1]
    return F.when(F.coalesce(first, F.lit("")) == "", "/").otherwise(F.concat(F.lit("/"), first))


def section(key: Column) -> Column:
    """As ``folder``, but a page directly under the root belongs to the root."""
    parts = F.filter(F.split(key, "/"), lambda x: x != "")
    return F.when(F.size(parts) > 1, F.concat(F.lit("/"), parts[0], F.lit("/"))).otherwise("/")


def crawl_url(url: Column, keep_query: bool = False) -> Column:
    """Scheme and host lower-cased, no fragment, no trailing slashes; the query only on request."""
    head = F.lower(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*)", 1))
    rest = F.regexp_replace(F.regexp_replace(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*", ""), r"#.*$", "")
    path, query = F.regexp_replace(rest, r"\?.*$", ""), F.regexp_extract(rest, r"(\?.*)$", 1)
    trimmed = F.concat(head, F.regexp_replace(path, r"/+$", ""))
    return F.when(head == "", F.lit(None)).otherwise(F.concat(trimmed, query) if keep_query else trimmed)


def grid_url(url: Column) -> Column:
    """Origin and path with a trailing slash."""
    bare = F.regexp_replace(F.regexp_replace(F.trim(url), r"[?#].*$", ""), r"/+$", "")
    return F.concat(bare, F.lit("/"))


def compared_url(url: Column) -> Column:
    return F.lower(F.regexp_replace(F.regexp_replace(F.trim(F.coalesce(url, F.lit(""))), r"[#?].*$", ""), r"/+$", ""))


def is_asset(url: Column) -> Column:
    return url.rlike(r"(?i)\.(?:avif|css|gif|ico|jpe?g|js|json|mov|mp3|mp4|pdf|png|svg|webm|webp|woff2?|xml|zip)(?:[?#].*)?$")


def url_skeleton(url: Column) -> Column:
    """struct<path, family, hash>: path segments replaced by their kind, and sorted query names, under the host."""
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    bare = F.regexp_replace(F.regexp_replace(url, _AUTHORITY, ""), r"[?#].*$", "")
    parts = F.transform(F.filter(F.split(bare, "/"), lambda x: x != ""), lambda x: F.lower(F.trim(x)))
    year = r"^(19|20)\d{2}$"

    def kind(x: Column, i: Column) -> Column:
        before = lambda n: F.coalesce(F.get(parts, i - n).rlike(year), F.lit(False))
        words = F.size(F.filter(F.split(x, "-"), lambda y: y != ""))
        return (
            F.when(x.rlike(r"^[a-z]{2}(?:-[a-z]{2})?$"), "{locale}")
            .when(x.rlike(year), "{year}")
            .when(x.rlike(r"^(0?[1-9]|1[0-2])$") & before(1), "{month}")
            .when(x.rlike(r"^(0?[1-9]|[12]\d|3[01])$") & before(2), "{day}")
            .when(x.rlike(r"^\d+$"), "{n}")
            .when(words >= 3, "{slug}")
            .when(x.contains("-"), "{compound}")
            .otherwise(x)
        )

    path = F.concat(F.lit("/"), F.array_join(F.transform(parts, kind), "/"))
    query = F.regexp_extract(url, r"\?([^#]*)", 1)
    names = F.transform(F.split(query, "&"), lambda x: F.lower(F.regexp_replace(x, "=.*$", "")))
    names = F.array_sort(F.array_distinct(F.filter(names, lambda x: x != "")))
    family = F.concat(host, path, F.when(F.size(names) > 0, F.concat(F.lit("?"), F.array_join(names, "&"))).otherwise(""))
    return F.struct(path.alias("path"), family.alias("family"), F.substring(F.sha2(family, 256), 1, 16).alias("hash"))


def scope_domain(site: Column) -> Column:
    """Domain of a property name: without the ``sc-domain:`` prefix, scheme, ``www.`` and path."""
    bare = F.regexp_replace(F.lower(F.trim(site)), r"^(sc-domain:|https?://)", "")
    return F.regexp_replace(F.regexp_replace(bare, r"^www\.", ""), r"[/?#:].*$", "")


def scope_id(owner: Column, domain: Column) -> Column:
    return F.substring(F.sha2(F.concat(owner, F.lit("\n"), domain), 256), 1, 24)


def is_noise(path: Column) -> Column:
    """Paths that scanners probe: hidden files, scripts, environment and backup files."""
    return path.contains("/.") | path.endswith(".php") | path.contains(".env") | path.endswith(".bak")
