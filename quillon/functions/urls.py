"""URL expressions: domain link, relative link, link mask, link extraction and acceptance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed value: everything up to and with the last ``//`` and the host behind it.
DOMAIN = "^.*[/]{2}[^/]*"
HREF = r'(?i)<a\s+[^>]*?href="([^"]*)"'


def domain_link(url: Column) -> Column:
    """Scheme and host; the last ``//`` counts. No match gives an empty string."""
    return F.regexp_extract(url, DOMAIN, 0)


def relative_link(url: Column) -> Column:
    """The link without any occurrence of its domain link."""
    domain = domain_link(url)
    return F.when(domain == "", url).otherwise(F.replace(url, domain, F.lit("")))


def close_slash(url: Column) -> Column:
    """The link with a slash at its end. An empty link stays empty."""
    return F.when((url == "") | F.endswith(url, F.lit("/")), url).otherwise(F.concat(url, F.lit("/")))


def link_mask(site_url: Column) -> Column:
    """The pattern of a site's own pages: under its url, without ``?`` and ``#``, and without a dot unless it ends in .html."""
    root = F.concat(site_url, F.lit("/"))
    return F.concat(F.lit("^"), F.replace(F.replace(root, F.lit("/"), F.lit(r"\/")), F.lit("."), F.lit(r"\.")), F.lit(r"([^?#.]*|[^?#]*\.html[\/]{0,1})$"))


def url_decoded(url: Column) -> Column:
    """Percent and plus decoding; null where the input is malformed."""
    return F.try_url_decode(url)


def extract_links(pages: DataFrame, site_url: Column, html: Column, *keys: str) -> DataFrame:
    """Rows (keys, pos, link) of the links in document order, absolute and closed with a slash."""
    found = pages.select(*keys, site_url.alias("_u"), F.posexplode(F.regexp_extract_all(html, F.lit(HREF), 1)).alias("pos", "_h"))
    h = F.col("_h")
    absolute = F.when(F.startswith(h, F.lit("/")), F.concat(domain_link(F.col("_u")), h)).when(h.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), h).otherwise(
        F.concat(close_slash(F.col("_u")), h)
    )
    return found.select(*keys, "pos", F.col("_u").alias("site_url"), close_slash(absolute).alias("link")).filter(F.col("link") != "")


def accept_links(links: DataFrame, page_link: Column, *keys: str) -> DataFrame:
    """The links a crawler follows: not the page itself, not the root or a prefix of it, within the mask, each once."""
    root = F.concat(domain_link(F.col("site_url")), F.lit("/"))
    return (
        links.filter(F.col("link") != page_link)
        .filter(~F.contains(root, F.col("link")))
        .filter(F.rlike(F.col("link"), link_mask(F.col("site_url"))))
        .select(*keys, "site_url", "link")
        .distinct()
    )
