"""Items over a size limit, cut at natural boundaries into pieces under it that overlap.

A text falls into units (lines, sentences; a unit that is too long falls further, at white space, then
between words of the tokenizer, at last between characters). Between neighbouring units the cosine of the
word counts of a block of units on either side tells how well the text holds together; a valley of that
curve marks a change of topic. Within each window of admissible sizes the deepest valley is cut; ties go to
the later one. The next piece starts so far before the cut that it repeats the given overlap.

Scale: one pass; a text with fewer bytes than the limit can't have more tokens and is not read further.
Whole texts are read. Defined results: null and empty texts, and texts within the limit, have no pieces; a
piece's size is that of its own text, encoded alone; pieces cover the text from its start to its end.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.tokens import blocks, default_path, encoder

BLOCK_UNITS = 5
BREAK = re.compile(r"\n+|(?<=[.!?…])\s+")
WORD = re.compile(r"[^\W\d_]+")


def units(text: str, words: list[str], size, most: int) -> list[tuple[int, int, int]]:
    """(start, end, tokens) of the text's units, in order and without gaps. size: the tokens of a word."""
    bounds = [m.end() for m in BREAK.finditer(text) if m.end() < len(text)] + [len(text)]
    out, k, at, start = [], 0, 0, 0
    fine = []  # (end, tokens) of word pieces, words that are too long in pieces of characters
    for w in words:
        n = size(w)
        if n > most:
            step = max(1, most // 4)
            fine += [(at + min(i + step, len(w)), min(step, len(w) - i) * 4) for i in range(0, len(w), step)]
        else:
            fine.append((at + len(w), n))
        at += len(w)
    for b in bounds:
        own = []
        while k < len(fine) and fine[k][0] <= b:
            own.append(fine[k])
            k += 1
        if k < len(fine) and (not own or own[-1][0] < b):  # a word reaches over the bound: the unit ends with it
            own.append(fine[k])
            k += 1
        if not own:
            continue
        end, total = own[-1][0], sum(n for _, n in own)
        if total <= most:
            out.append((start, end, total))
        else:
            a, first, size_ = start, 0, 0
            for i, (_, n) in enumerate(own):
                if i > first and size_ + n > most:
                    j = next((j for j in range(i - 1, first - 1, -1) if text[own[j][0] : own[j][0] + 1].isspace() or text[own[j][0] - 1].isspace()), i - 1)
                    out.append((a, own[j][0], sum(x for _, x in own[first : j + 1])))
                    a, first = own[j][0], j + 1
                    size_ = sum(x for _, x in own[first:i])
                size_ += n
            out.append((a, end, size_))
        start = end
    return out


def valleys(text: str, parts: list[tuple[int, int, int]], width: int = BLOCK_UNITS) -> list[float]:
    """The depth of the cohesion valley before each unit but the first, 0 where the curve does not dip."""
    bags = [Counter(WORD.findall(text[a:b].lower())) for a, b, _ in parts]

    def cosine(x: Counter, y: Counter) -> float:
        dot = sum(n * y[w] for w, n in x.items() if w in y)
        norm = math.sqrt(sum(n * n for n in x.values()) * sum(n * n for n in y.values()))
        return dot / norm if norm else 0.0

    sim = []
    left, right = Counter(), Counter()
    for b in bags[:width]:
        right.update(b)
    for k in range(1, len(bags)):
        left.update(bags[k - 1])
        right.subtract(bags[k - 1])
        if k - 1 - width >= 0:
            left.subtract(bags[k - 1 - width])
        if k - 1 + width < len(bags):
            right.update(bags[k - 1 + width])
        left, right = +left, +right
        sim.append(cosine(left, right))
    up, down = sim[:], sim[:]
    for k in range(1, len(sim)):  # the peak reached by climbing to either side
        if sim[k - 1] >= sim[k]:
            up[k] = up[k - 1]
        if sim[-k] >= sim[-k - 1]:
            down[-k - 1] = down[-k]
    return [0.0, *((u - s) + (d - s) for s, u, d in zip(sim, up, down, strict=True))]


def split_text(text: str, words: list[str], size, tokens_of, limit: int, overlap: int) -> list[tuple[int, int, int]]:
    """(start, end, tokens) of the pieces. size: tokens of a word; tokens_of: tokens of any text, encoded alone."""
    if not 0 <= overlap < limit // 2:
        raise ValueError("the overlap must be less than half the limit")
    parts = units(text, words, size, max(1, (limit - overlap) // 4))
    depth = valleys(text, parts)
    word_ends, at = [0], 0
    for w in words:
        at += len(w)
        word_ends.append(at)
    word_sizes = [size(w) for w in words]
    out, k, start = [], 0, 0
    while k < len(parts):
        used, n, e = tokens_between(word_ends, word_sizes, start, parts[k][0]), 0, k
        while e < len(parts) and used + n + parts[e][2] <= limit - 4:
            n += parts[e][2]
            e += 1
        e = max(e, k + 1)
        if e < len(parts):
            reach, least, c = used, (limit - 4) // 2, k
            while c < e and reach < least:
                reach += parts[c][2]
                c += 1
            c = min(max(c, k + 1), e)
            e = max(range(c, e + 1), key=lambda x: (depth[x], x))
        got = tokens_of(text[start : parts[e - 1][1]])
        while got > limit and e > k + 1:
            e -= 1
            got = tokens_of(text[start : parts[e - 1][1]])
        while got > limit and start < parts[k][0]:  # less overlap, word by word
            start = min(word_ends[bisect_left(word_ends, start + 1)], parts[k][0])
            got = tokens_of(text[start : parts[e - 1][1]])
        end = parts[e - 1][1]
        out.append((start, end, got))
        k = e
        if k < len(parts):
            start = overlap_start(word_ends, word_sizes, end, overlap)
    return out


def tokens_between(ends: list[int], sizes: list[int], a: int, b: int) -> int:
    """Tokens of the words between two positions."""
    i, j = bisect_left(ends, a), bisect_left(ends, b)
    return sum(sizes[i:j])


def overlap_start(ends: list[int], sizes: list[int], end: int, overlap: int) -> int:
    """Where the words before ``end`` add up to at least ``overlap`` tokens."""
    i, n = bisect_left(ends, end), 0
    if not overlap:
        return end
    while i > 0 and n < overlap:
        i -= 1
        n += sizes[i]
    return min(ends[i], end)


def split_oversized(rows: DataFrame, key: str, text: str, limit: int = 2048, overlap: int = 128, path: str | None = None) -> DataFrame:
    """(key, piece, start, end, tokens, text) of the texts of more than ``limit`` tokens."""
    path = path or default_path()
    src = rows.select(F.col(key).alias("key"), F.col(text).alias("text")).filter(F.octet_length("text") > limit)
    kind = src.schema["key"].dataType.simpleString()

    def run(batches):
        e = encoder(path)
        size = lambda w: len(e.memory[w])
        tokens_of = lambda t: e.sizes([t])[0]
        for pdf in batches:
            keys, texts = pdf["key"].tolist(), pdf["text"].tolist()
            for i, j in blocks(texts):
                out = []
                for x, t, n in zip(keys[i:j], texts[i:j], e.sizes(texts[i:j]), strict=True):
                    if n > limit:
                        words = e.words([t])[0]
                        out += [(x, k, a, b, m, t[a:b]) for k, (a, b, m) in enumerate(split_text(t, words, size, tokens_of, limit, overlap))]
                if out:
                    yield pd.DataFrame(out, columns=["key", "piece", "start", "end", "tokens", "text"])

    return src.mapInPandas(run, f"key {kind}, piece int, start int, end int, tokens int, text string")
