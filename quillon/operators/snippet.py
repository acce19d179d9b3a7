"""Snippets: fragments of about thirty characters around the query's words, highlighted."""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillon.functions.html import html_to_text

WORD = re.compile("[а-яёА-ЯЁa-zA-Z]+")
LETTER = re.compile("[a-zA-Zа-яА-ЯёЁ]")


class _NoSnippet(Exception):
    pass


def matching_words(text: str, lemmas: set[str], normal_forms: Callable[[str], list[str]]) -> dict[str, list[str]]:
    """Surface forms whose lemmas meet the query's, by the first normal form, in text order."""
    found: dict[str, list[str]] = {}
    for w in WORD.findall(text):
        forms = normal_forms(w.lower())
        if forms and not lemmas.isdisjoint(forms):
            own = found.setdefault(forms[0], [])
            if w not in own:
                own.append(w)
    return found


def _is_letter(text: str, at: int) -> bool:
    if at >= len(text):
        raise _NoSnippet  # a word that ends the text can't be checked
    return bool(LETTER.match(text[at]))


def _locate(text: str, word: str) -> int:
    """Where the first whole occurrence begins, -1 if there is none. A search that fails after a hit inside
    another word goes on one character before the rest, as the defined behaviour has it."""
    at = text.find(word)
    while at != -1:
        end = at + len(word)
        before = at == 0 or not _is_letter(text, at - 1)
        if before and (end == len(text) - 1 or not _is_letter(text, end)):
            break
        if end > len(text):
            raise _NoSnippet
        at = end + text[end:].find(word)
    return at


def _fragment_end(text: str, size: int) -> int:
    """The first white space at every second position from ``size`` on; may lie one behind the end."""
    if size >= len(text):
        return len(text)
    at = size
    while at < len(text):
        if text[at].isspace():
            return at
        at += 2
    return at


def _highlight(part: str, words: list[str]) -> str:
    """The fragment with whole words in <b>, in one pass so that tags never nest; empty if none occurs."""
    if not part or not words:
        return ""
    alt = "|".join(map(re.escape, sorted(words, key=len, reverse=True)))
    out, n = re.subn(rf"(?<![^\W_])(?:{alt})(?![^\W_])", r"<b>\g<0></b>", part)
    return out if n else ""


def make_snippet(text: str | None, lemmas: set[str], normal_forms: Callable[[str], list[str]] = lambda w: [w], max_size: int = 180, part_size: int = 30) -> str:
    """A snippet of the text for the lemmas; empty where no word matches or where a word can't be placed."""
    if not text:
        return ""
    found = matching_words(text, lemmas, normal_forms)
    words, every = [v[0] for v in found.values()], [w for v in found.values() for w in v]
    if not words:
        return ""
    try:
        out, used, start = "", 0, _locate(text, words[0])
        if start < 0:
            return ""
        end = len(text) if len(text) <= part_size else start + _fragment_end(text[start:], part_size)
        while len(out) < max_size and used < len(words) and end <= len(text):
            part = _highlight(text[start:end], every)
            out += ("..." if out and part else "") + part
            used += 1
            if end >= len(text) or used >= len(words):
                break
            rest = text[end + 1 :]
            start = _locate(rest, words[used])
            while start == -1 and used < len(words) - 1:
                out += f"...<b>{words[used]}</b>..."
                used += 1
                start = _locate(rest, words[used])
            if start == -1:
                break
            start += end + 1
            end = len(text) if len(text) <= start + part_size else start + _fragment_end(text[start:], part_size)
    except _NoSnippet:
        return ""
    tail = ", ".join(f"<b>{w}</b>" for w in words[used:])
    return out + ("..." + tail if tail else "")


def snippet_udf(lemmas: set[str], forms: Mapping[str, list[str]] | None = None, html: bool = True, max_size: int = 180, part_size: int = 30):
    """An Arrow UDF over page contents; for the rows of a result page. ``forms``: normal forms of the words that
    have others than themselves; it holds the forms of the query's lemmas only."""

    @F.pandas_udf(T.StringType())
    def snippet(content: pd.Series) -> pd.Series:
        normal = (lambda w: forms.get(w, [w])) if forms is not None else (lambda w: [w])
        return content.map(lambda c: make_snippet(html_to_text(c) if html else c, lemmas, normal, max_size, part_size))

    return snippet


@F.pandas_udf(T.StringType())
def snippet_of(text: pd.Series, lemmas: pd.Series) -> pd.Series:
    """A snippet of each text for its own lemmas, every word being its own lemma."""
    return pd.Series([make_snippet(t, set(x)) for t, x in zip(text, lemmas, strict=True)], dtype=object)
