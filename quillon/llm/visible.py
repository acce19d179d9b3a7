"""The visible text of a page, line by line.

Visible text: content without the head block, comments, scripts and styles, without tags (each replaced by
a space), with entities decoded. Line breaks inside hidden parts and tags are kept, so lines keep their numbers.
"""

from __future__ import annotations

import html
import re

HIDDEN = re.compile(r"<head\b.*?(?:</head\s*>|\Z)|<!--.*?(?:-->|\Z)|<script\b.*?(?:</script\s*>|\Z)|<style\b.*?(?:</style\s*>|\Z)", re.S | re.I)
TAG = re.compile(r"<[/!?]?[A-Za-z][^<>]*>")


def _blank(m: re.Match) -> str:
    t = m[0]
    return " " + "\n" * t.count("\n") if "\n" in t else " "


def bare(content: str) -> str:
    """The content without hidden parts; tags and entities still stand."""
    return HIDDEN.sub(_blank, content) if "<" in content else content


def visible(content: str) -> str:
    """The visible text with the content's line breaks. An entity that stands for a line break becomes a space."""
    return shown(bare(content))


def shown(text: str) -> str:
    """The visible text of a content without hidden parts."""
    if "<" in text:
        text = TAG.sub(_blank, text)
    if "&" in text:
        text = "\n".join(html.unescape(x).replace("\n", " ") if "&" in x else x for x in text.split("\n"))
    return text
