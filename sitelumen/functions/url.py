"""URLs as columns, by regular expressions: they take any string, where the built-in parsers throw or give null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Paths of pages that serve a purpose of their own.
UTILITY = (
    r"(?i)/(contact|contact-us|privacy|privacy-policy|terms|terms-and-conditions|refund|"
    r"refund-policy|cancellation|disclaimer|login|signin|sign-in|register|signup|cart|"
    r"checkout|account|my-account|careers?|faq|sitemap|search|thank-you|thankyou)(/|$)"
)
#: Host endings of content networks.
CDN_SUFFIXES = (
    ".cloudfront.net", ".amazonaws.com", ".azureedge.net", ".akamaized.net", ".fastly.net", ".b-cdn.net",
    ".cdn77.org", ".imgix.net", ".r2.dev", "res.cloudinary.com", ".gumlet.io", ".imagekit.io",
)
LONG_URL, LONG_PATH = 115, 75


#: The scheme is taken whole (``?+``), or a URL without a path would give its slashes for one.
_START = r"^\s*(?:[A-Za-z][A-Za-z0-9+.-]*://)?+"


def netloc(url: Column) -> Column:
    """The host with user and port, lower-case, without ``www.``."""
    return F.regexp_replace(F.lower(F.regexp_extract(url, _START + r"([^/?#\s]*)", 1)), r"^www\.", "")


def host(url: Column) -> Column:
    """The host, lower-case, without ``www.``, user and port."""
    return F.regexp_replace(F.lower(F.regexp_extract(url, _START + r"(?:[^/?#@]*@)?([^/?#:\s]*)", 1)), r"^www\.", "")


def path(url: Column) -> Column:
    """The path, ``/`` if there is none."""
    return F.coalesce(F.nullif(F.regexp_extract(url, _START + r"[^/?#]*(/[^?#]*)", 1), F.lit("")), F.lit("/"))


def query(url: Column) -> Column:
    return F.regexp_extract(url, r"^[^#?]*\?([^#]*)", 1)


def norm_url(url: Column) -> Column:
    """The key under which a page is known: host and path, no trailing slash, the query kept."""
    trimmed = F.regexp_replace(F.regexp_extract(url, _START + r"[^/?#]*(/[^?#]*)", 1), "/+$", "")
    return F.concat(netloc(url), F.coalesce(F.nullif(trimmed, F.lit("")), F.lit("/")), F.regexp_extract(url, r"^[^#?]*(\?[^#]+)", 1))


def normalize_domain(text: Column) -> Column:
    """A plain domain name, or null where there is none."""
    name = F.regexp_replace(host(text), r"\.$", "")
    return F.when(name.rlike(r"^[a-z0-9.-]+$") & name.contains("."), name)


def slug(name: Column) -> Column:
    """Lower-case letters and digits with single hyphens between them."""
    return F.regexp_replace(F.regexp_replace(F.lower(name), r"[^a-z0-9]+", "-"), r"^-+|-+$", "")


def page_type(url: Column, sitemaps: Column | None = None) -> Column:
    """A struct of type and subtype, by the names of the ``sitemaps`` that list a page (an array) and the URL's shape."""
    parts = F.filter(F.split(path(url), "/"), lambda s: s != "")
    n, first, last = F.size(parts), F.lower(F.get(parts, F.lit(0))), F.coalesce(F.lower(F.get(parts, F.size(parts) - 1)), F.lit(""))
    listed, whole = F.lower(F.array_join(sitemaps, " ")) if sitemaps is not None else F.lit(""), F.lower(path(url))
    kind = lambda t, s: F.struct(F.lit(t).alias("type"), F.lit(s).alias("subtype"))
    archive = listed.contains("category") | listed.contains("tag") | (n == 1)
    post = listed.contains("post") | (n >= 3) | ((n == 2) & ~listed.contains("category"))
    blog = F.when(~archive & post, kind("blog_post", "article")).otherwise(kind("blog_category", "archive"))
    return (
        F.when(path(url) == "/", kind("home", "home"))
        .when(first == "blog", blog)
        .when(path(url).rlike(UTILITY), kind("utility", "utility"))
        .when(whole.rlike("topper|result"), kind("landing", "proof"))
        .when(whole.rlike("resource|resourse|download"), kind("landing", "resource"))
        .when(listed.rlike("center|centre"), kind("landing", "centre"))
        .when((n >= 2) & last.rlike("coaching|classes|course"), kind("landing", "location"))
        .when(last.rlike("coaching|course|classes|test-series"), kind("landing", "service"))
        .otherwise(kind("landing", "page"))
    )


def section(url: Column) -> Column:
    """The first part of the path."""
    return F.regexp_extract(path(url), r"^/([^/]+)", 1)


def party(url: Column, own: Column, cdn_suffixes: tuple[str, ...] = CDN_SUFFIXES) -> Column:
    """own, cdn or third: whose host serves ``url`` for the site ``own``."""
    served = host(url)
    of_own = (served == own) | served.endswith(F.concat(F.lit("."), own))
    of_cdn = F.lit(False)
    for suffix in cdn_suffixes:
        of_cdn = of_cdn | served.endswith(suffix)
    return F.when(of_own, "own").when(of_cdn, "cdn").otherwise("third")


def lints(url: Column) -> dict[str, Column]:
    """Flags of a URL's shape."""
    return {
        "has_query": query(url) != "",
        "has_uppercase": path(url).rlike("[A-Z]"),
        "has_underscore": path(url).contains("_"),
        "is_http": F.lower(F.trim(url)).startswith("http://"),
        "is_long": F.length(url) > LONG_URL,
        "is_raw_ip": host(url).rlike(r"^\d{1,3}(?:\.\d{1,3}){3}$"),
    }
