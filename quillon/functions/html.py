"""Text, title and description of an HTML page."""

from __future__ import annotations

from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

HIDDEN = r"(?is)<head\b.*?</head\s*>|<!--.*?-->|<script\b.*?</script\s*>|<style\b.*?</style\s*>"
TAG = r"<[^>]*>"
ENTITY = r"&[#0-9A-Za-z]+;"


def token_text(html: Column) -> Column:
    """Text for tokens, by built-in expressions only: hidden parts, tags and entities each become a space."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(html, HIDDEN, " "), TAG, " "), ENTITY, " ")


def title(html: Column) -> Column:
    """The document's title with white space collapsed and the basic entities decoded; empty where there is none."""
    t = F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1)
    # The entities that titles hold.
    for entity, text in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&copy;", "©"), ("&middot;", "·"), ("&nbsp;", " "), ("&amp;", "&")):
        t = F.replace(t, F.lit(entity), F.lit(text))
    return F.coalesce(F.trim(F.regexp_replace(t, r"\s+", " ")), F.lit(""))


def description(html: Column) -> Column:
    """The content of the first description meta tag; empty where there is none."""
    return F.coalesce(F.regexp_extract(html, r'(?i)<meta\s+name="description"\s+content="([^"]*)"', 1), F.lit(""))


class _Text(HTMLParser):
    SKIP = {"head", "script", "style", "title"}
    INLINE = {"a", "b", "i", "em", "strong", "span", "u", "s", "sub", "sup", "code", "small", "mark", "font"}

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.parts: list[str] = []
        self.hidden: list[str] = []

    def handle_starttag(self, tag, attrs):
        if tag in self.SKIP:
            self.hidden.append(tag)
        elif tag not in self.INLINE:
            self.parts.append(" ")

    def handle_endtag(self, tag):
        if tag in self.SKIP:
            if tag in self.hidden:
                del self.hidden[self.hidden.index(tag) :]
        elif tag not in self.INLINE:
            self.parts.append(" ")

    def handle_data(self, data):
        if not self.hidden:
            self.parts.append(data)


def html_to_text(html: str | None) -> str:
    """Display text of the body: entities decoded, white space collapsed, inline tags joining their neighbours."""
    if not html:
        return ""
    p = _Text()
    p.feed(html)
    p.close()
    return " ".join("".join(p.parts).split())


@F.pandas_udf(T.StringType())
def display_text(html: pd.Series) -> pd.Series:
    """``html_to_text`` over Arrow batches; meant for the few rows of a result page."""
    return html.map(html_to_text)
