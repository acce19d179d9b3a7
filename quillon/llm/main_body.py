"""The main body of each page, by minimum-cut labelling of its lines.

Every line with visible text is a node. Its capacities to the two terminals are the costs of a classifier of the
line's words and shape, and on pages built of nav, aside or footer elements what HTML says its element is for. Smoothness edges join
neighbouring lines, and lines of equal markup (element with class or id) wherever they stand; they are the weaker, the farther
the lines are from each other in the DOM. The minimum cut separates body from boilerplate: nodes that their own capacities
decide and nodes with at most two edges are folded into their neighbours exactly, max-flow labels what is left.

The classifier is trained on the spot, on lines whose element HTML itself defines as content or as something else
(nav, aside, footer and such against headings, paragraphs and lists) or whose class has a usual name for either, without any feature of the markup: so it
holds for pages of tables, of arbitrary class names and of plain text. No class name has a part in the costs. The sample is that of the pages with
the smallest hashes, at most ``SAMPLE_PAGES``; everything else covers all pages.

Scale: one pass over the pages, no shuffle of contents. Text garbled by a wrong encoding is restored first. Pages of
template residue have no body. Defined results: null and empty contents have no lines; repeated
deliveries give equal rows.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from functools import lru_cache
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.repair import Model, worker_model
from quillon.llm.residue import residue_of
from quillon.llm.visible import bare, shown
from quillon.sources.tables import cut, if_small

SAMPLE_PAGES = 2_500
NEAR, ALIKE, MARKUP = 0.35, 0.9, 3.0

# Elements and roles that HTML defines as content, and as something beside it.
BODY = frozenset("h1 h2 h3 h4 h5 h6 p li blockquote tr td th article main figure figcaption caption pre dl dt dd".split())
CHROME = frozenset("nav aside footer header address small noscript dialog form menu navigation contentinfo banner complementary search".split())
TELLING = re.compile(r"<(?:nav|aside|footer)\b")
# Usual class names of either kind. They label lines to train on and have no part in a page's costs.
NAMED_BODY = frozenset("article body content entry text post story main title headline heading caption paragraph quote pull list point item".split())
NAMED_CHROME = frozenset(
    "nav menu navigation breadcrumb breadcrumbs crumbs path cookie cookies consent gdpr warn warning notice banner ad ads advert advertisement sponsor sponsored promo teaser related sidebar author byline meta "
    "share social subscribe newsletter letter intro about tag tags cloud footer bottom legal copyright disclaimer widget popup modal comments login search".split()
)
NAMED = re.compile(r"class=\"(?:nav|menu|navigation|sidebar|footer|bottom|content|text|article)\"")
LABELLED = re.compile(f"{TELLING.pattern}|{NAMED.pattern}")
VOID = re.compile(r"<(?:br|hr|img|input|meta|link|wbr|col|source)\b|<!|/>", re.I)
FIRST = re.compile(r"<([a-zA-Z][a-zA-Z0-9]*)\b([^<>]*)>")
ATTR = re.compile(r"\b(class|id|role)=\"([^\"]*)\"")
LINK = re.compile(r"<a\b[^<>]*>(.*?)</a\s*>", re.S | re.I)
TITLE = re.compile(r"<title[^>]*>(.*?)</title>", re.S | re.I)
WORD = re.compile(r"[^\W_]+")
DATE = re.compile(r"\d{1,2}\.\d{1,2}\.\d{4}|\d{4}-\d\d-\d\d")
NUMBER = re.compile(r"\d+")
MARKS = re.compile("[|©·›:«»“”„€₽$%?—@_-]")
BULLETS = frozenset("-–—•*·")
SIZE = [f"n{n if n < 8 else 8 + min(n // 6, 6)}" for n in range(50)]
LEAD, TAIL, LINKS = [f"lead{k}" for k in range(4)], [f"tail{k}" for k in range(3)], [f"links{k}" for k in range(4)]
NOTHING = repeat(0.0)
OF_MARKUP = frozenset(["link1", "link2", *LINKS, "cells"])


@lru_cache(20_000)
def _tag(tag: str, attrs: str) -> tuple[str, str]:
    tag, own = tag.lower(), dict(ATTR.findall(attrs)) if attrs else {}
    sign = f"{tag}.{own['class']}" if own.get("class") else f"{tag}#{own['id']}" if own.get("id") else tag if tag not in ("p", "tr", "td", "div", "span", "a", "table") else ""
    return own.get("role", "").lower() or tag, sign


def markup(raw: str) -> tuple[str, str]:
    """(mark, signature) of a line: the element or role that HTML gives a meaning, and what lines of equal markup share."""
    m = FIRST.search(raw) if "<" in raw else None
    return _tag(m[1], m[2]) if m else ("", "")


def depths(raws: list[str]) -> list[tuple[int, int]]:
    """(depth, least depth since the line before) of each line in the DOM: how many elements are open that began on earlier lines."""
    out, depth = [], 0
    for raw in raws:
        opened, closed = raw.count("<"), raw.count("</")
        low = depth
        if opened != 2 * closed:
            change = opened - 2 * closed - len(VOID.findall(raw))
            # a line that closes more than it opens stands in what it leaves
            out.append((depth, low))
            depth = max(0, depth + change)
        else:
            out.append((depth, low))
    return [(d, min(d, out[k - 1][0] if k else 0)) for k, (d, _) in enumerate(out)]


def line_traits(raw: str, t: str, low: str, brand: str) -> tuple[list[str], list[str], str, str, str]:
    """(words, flags, mark, signature, case) of a line by itself. low: the line in lower case, a 0 for each number."""
    digit, low = "0" in low, WORD.findall(low)
    named = bool(brand) and brand in low
    if named:
        low = ["BRAND" if x == brand else x for x in low]
    n, z = len(low), t[-1]
    start = t[2:] if t[0] in BULLETS and t[1:2] == " " and len(t) > 2 else t
    case = "caseA" if n and t.isupper() else "casea" if start[0].islower() else "caseT"
    flags = ["*", SIZE[n] if n < 50 else "n14", "end" + (z if not z.isalnum() else "a" if z.isalpha() else "0"), case, case + ("0" if z.isdigit() else "a")]
    if "<a " in raw:
        linked = sum(map(len, LINK.findall(raw)))
        flags += ["link1" if linked < 0.6 * len(t) else "link2", LINKS[min(raw.count("<a "), 3)]]
    else:
        flags.append("link0")
    if digit:
        if DATE.search(t):
            flags.append("date")
        if NUMBER.search(t[-12:]):
            flags.append("endnum")
    if named:
        flags += ["brand", "brandfirst" if low[0] == "BRAND" else "brandin"]
    flags += ["c" + c for c in set(MARKS.findall(start))]
    if raw.count("<td") > 1:
        flags.append("cells")
    if low:
        flags += ["f" + low[0], "ff" + " ".join(low[:2]), "l" + low[-1]]
        if t[0].isupper() and ":" in t[: len(low[0]) + 24]:
            flags.append("label")
    return (low, flags, *markup(raw), case)


def page_nodes(content: str, brand: str | None, plain: str | None = None, text: str | None = None) -> list[tuple]:
    """(line_no, raw line, visible line, traits, flags of its place on the page) of the lines with visible text. plain, text: what
    ``bare`` and ``visible`` make of the content."""
    plain = bare(content) if plain is None else plain
    text = shown(plain) if text is None else text
    title = TITLE.search(content) if "<title" in content else None
    title = " ".join(title[1].split()).rsplit(" — ", 1)[0].lower() if title else ""
    raws, brand = plain.split("\n"), (brand or "").lower()
    lines = [(i, " ".join(w)) for i, t in enumerate(text.split("\n")) if (w := t.split())]
    lows = NUMBER.sub("0", text.lower()).split("\n")  # neither changes the line breaks
    crumbs = {t.rsplit("›", 1)[1].strip().lower() for _, t in lines if "›" in t}
    traits = [line_traits(raws[i], t, lows[i], brand) for i, t in lines]
    long = [k for k, x in enumerate(traits) if len(x[0]) >= 18]
    begin, end = (long[0], long[-1]) if long else (-1, -1)
    out, total = [], len(lines)
    for k, ((i, t), own) in enumerate(zip(lines, traits, strict=True)):
        place = ("atb1" if k < begin else "ate1" if k > end else "atm1") if long else "atb0"
        placed = [place, own[4] + place, LEAD[k] if k < 4 else "lead4", TAIL[total - 1 - k] if total - 1 - k < 3 else "tail3"]
        if crumbs or title:
            head = t.lower()
            if head == title or head in crumbs or (title and head.startswith(title) and t.rstrip("»>! .…)[]0123456789").lower() == title):
                placed.append("heading")
        out.append((i, raws[i], t, own, placed))
    return out


class Classifier:
    """Logistic regression over flags and words; the words of a line share one unit of length. Words are stored behind a w."""

    def __init__(self, weights: dict[str, float]):
        self.weights = weights
        self.flag = {k: v for k, v in weights.items() if k[0] != "w"}.get
        self.word = {k[1:]: v for k, v in weights.items() if k[0] == "w"}.get

    def score(self, flags: list[str], words: list[str]) -> float:
        """The log-odds of being body."""
        s = sum(map(self.flag, flags, NOTHING))
        return s + sum(map(self.word, words, NOTHING)) / math.sqrt(len(words)) if words else s

    @classmethod
    def fit(cls, lines: list[tuple[list[str], list[str], bool]], steps: int = 160, l2: float = 1e-5) -> Classifier:
        """Full-batch training with adaptive moments; keys seen once are left out."""
        rows = [([*flags, *("w" + w for w in words)], len(words), y) for flags, words, y in lines]
        seen = Counter(k for keys, _, _ in rows for k in set(keys))
        names = {k: i for i, k in enumerate(sorted(k for k, c in seen.items() if c > 1))}
        if not names:
            return cls({})
        at, col, val = [], [], []
        for r, (keys, n, _) in enumerate(rows):
            split, unit = len(keys) - n, 1 / math.sqrt(n) if n else 0.0
            for p, k in enumerate(keys):
                if k in names:
                    at.append(r)
                    col.append(names[k])
                    val.append(1.0 if p < split else unit)
        at, col, val = np.array(at), np.array(col), np.array(val)
        y = np.array([float(b) for _, _, b in rows])
        w, m, v = np.zeros(len(names)), np.zeros(len(names)), np.zeros(len(names))
        for t in range(1, steps + 1):
            z = np.bincount(at, val * w[col], len(rows))
            g = np.bincount(col, val * ((1 / (1 + np.exp(-np.clip(z, -30, 30)))) - y)[at], len(names)) / len(rows) + l2 * w
            m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
            w -= 0.08 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-9)
        return cls({k: float(w[i]) for k, i in names.items() if abs(w[i]) > 1e-4})


def weak_labels(content: str, brand: str | None) -> list[tuple[list[str], list[str], bool]]:
    """Labelled lines of a page whose markup says what its blocks are; none of other pages."""
    if not LABELLED.search(content):
        return []
    out = []
    for _, _, _, (words, own, mark, sign, _), placed in page_nodes(content, brand):
        flags = [*own, *placed]
        name = sign.partition(".")[2].split(" ")[0].lower()
        body, chrome = (name in NAMED_BODY, name in NAMED_CHROME) if name else (mark in BODY, mark in CHROME)
        if body or chrome:
            out.append((flags, words, body))
            bare_flags = [f for f in flags if f not in OF_MARKUP]
            if len(bare_flags) < len(flags):  # the same line as a page without markup has it
                out.append(([*bare_flags, "link0"], words, body))
    return out


def min_cut(costs: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """The labels (True: source side) of least cost. costs: what label False costs more than True, for each node.

    A node whose own capacity exceeds all its edges is decided. A node with one or two edges is folded: the least it costs,
    as a function of its neighbours' labels, is again a capacity for each and an edge between them. Both are exact and
    linear in time, and leave what is densely linked for max-flow."""
    n = len(costs)
    weight = [0.0] * n
    for a, b, c in edges:
        weight[a] += c
        weight[b] += c
    if all(abs(x) >= w for x, w in zip(costs, weight, strict=True)):
        return [x >= 0 for x in costs]
    near: list[dict[int, float]] = [{} for _ in range(n)]
    for a, b, c in edges:
        if a != b and c > 0:
            near[a][b] = near[a].get(b, 0.0) + c
            near[b][a] = near[b].get(a, 0.0) + c
    costs, label, folded = list(costs), [None] * n, []
    gone, queue = [False] * n, list(range(n))
    while queue:
        v = queue.pop()
        if gone[v]:
            continue
        own = near[v]
        if abs(costs[v]) >= sum(own.values()):
            gone[v], label[v] = True, costs[v] >= 0
            for b, c in own.items():
                costs[b] += c if label[v] else -c
                del near[b][v]
                queue.append(b)
            near[v] = {}
        elif len(own) <= 2:
            gone[v] = True
            (a, w), (b, x) = (*own.items(), (None, 0.0))[:2]
            folded.append((v, costs[v], a, w, b, x))
            c = costs[v]
            both, first, second, none = min(0.0, c + w + x), min(x, c + w), min(w, c + x), min(c, w + x)  # by the neighbours with label True
            link = max(0.0, (first + second - both - none) / 2)
            costs[a] += second - both - link
            del near[a][v]
            queue.append(a)
            if b is not None:
                costs[b] += first - both - link
                del near[b][v]
                if link:
                    near[a][b] = near[b][a] = near[a].get(b, 0.0) + link
                queue.append(b)
            near[v] = {}
    rest = [v for v in range(n) if not gone[v]]
    if rest:
        for v, side in zip(rest, max_flow_sides([costs[v] for v in rest], [near[v] for v in rest], {v: k for k, v in enumerate(rest)}), strict=True):
            label[v] = side
    for v, c, a, w, b, x in reversed(folded):
        true = (0.0 if label[a] else w) + (0.0 if b is None or label[b] else x)
        false = c + (w if label[a] else 0.0) + (x if b is not None and label[b] else 0.0)
        label[v] = true <= false
    return label


def max_flow_sides(costs: list[float], near: list[dict[int, float]], at: dict[int, int]) -> list[bool]:
    """For each node whether it lies on the source's side of the minimum cut. Blocking flows along shortest paths."""
    n = len(costs)
    head, room, out = [], [], [[] for _ in range(n)]
    for k, own in enumerate(near):
        for v, c in own.items():
            j = at[v]
            if k < j:
                out[k].append(len(head))
                out[j].append(len(head) + 1)
                head += [j, k]
                room += [c, c]
    give, take = [max(c, 0.0) for c in costs], [max(-c, 0.0) for c in costs]
    tiny = 1e-12
    while True:
        level, todo = [-1] * n, [k for k in range(n) if give[k] > tiny]
        for k in todo:
            level[k] = 0
        ends = False
        for k in todo:  # grows while it is read
            if take[k] > tiny:
                ends = True
            for e in out[k]:
                if room[e] > tiny and level[head[e]] < 0:
                    level[head[e]] = level[k] + 1
                    todo.append(head[e])
        if not ends:
            return [x >= 0 for x in level]
        turn = [0] * n
        for start in range(n):
            while give[start] > tiny and level[start] == 0:
                path, k = [], start
                while take[k] <= tiny:
                    while turn[k] < len(out[k]):
                        e = out[k][turn[k]]
                        if room[e] > tiny and level[head[e]] == level[k] + 1:
                            break
                        turn[k] += 1
                    if turn[k] < len(out[k]):
                        path.append(out[k][turn[k]])
                        k = head[path[-1]]
                    elif path:  # a dead end
                        e = path.pop()
                        k = head[e ^ 1]
                        turn[k] += 1
                    else:
                        k = -1
                        break
                if k < 0:
                    break
                flow = min([give[start], take[k], *(room[e] for e in path)])
                give[start] -= flow
                take[k] -= flow
                for e in path:
                    room[e] -= flow
                    room[e ^ 1] += flow
            if level[start] == 0 and give[start] > tiny and turn[start] >= len(out[start]):
                continue


def body_lines(content: str, brand: str | None, classifier: Classifier, plain: str | None = None, text: str | None = None) -> list[int]:
    """The numbers of the lines of the main body."""
    plain = bare(content) if plain is None else plain
    nodes = page_nodes(content, brand, plain, text)
    telling = bool(TELLING.search(content))
    place = depths(plain.split("\n")) if "<" in plain else None
    costs, edges, last, low, seen = [], [], {}, {}, 0
    for k, (line, _, _, own, placed) in enumerate(nodes):
        c, mark, sign = max(-9.0, min(9.0, classifier.score(own[1], own[0]) + sum(map(classifier.flag, placed, NOTHING)))), own[2], own[3]
        if telling:
            c += MARKUP if mark in BODY else -MARKUP if mark in CHROME else 0.0
        costs.append(c)
        between = depth = 0
        if place:  # the least depth since the node before, for all lines that wait for their like
            depth = place[line][0]
            between = place[line][1] if seen == line else min(place[i][1] for i in range(seen, line + 1))
            for s, d in low.items():
                if between < d:
                    low[s] = between
        if k:
            apart = depth + (place[nodes[k - 1][0]][0] if place else 0) - 2 * between
            edges.append((k - 1, k, NEAR / (1 + max(apart, 0))))
        if sign:
            if sign in last:
                apart = depth + place[nodes[last[sign]][0]][0] - 2 * low[sign] if place else 0
                edges.append((last[sign], k, ALIKE / (1 + max(apart, 0))))
            last[sign], low[sign] = k, depth
        seen = line + 1
    return [node[0] for node, body in zip(nodes, min_cut(costs, edges), strict=True) if body]


def _with_brand(pages: DataFrame, sites: DataFrame, page: str, site: str, content: str) -> DataFrame:
    names = sites.filter(F.col(site).isNotNull()).groupBy(F.col(site).alias("_s")).agg(F.min("name").alias("_n"))
    brand = F.split(F.trim(F.col("_n")), r"\s+").getItem(0)
    rows = pages.select(F.col(page).alias("page"), F.col(content).alias("content"), F.col(site).alias("site")).filter("page is not null and content is not null and content <> ''")
    return rows.join(if_small(names), F.col("site") == F.col("_s"), "left").select("page", "content", brand.alias("brand"))


def train(rows: DataFrame, sample_pages: int = SAMPLE_PAGES) -> Classifier:
    """A classifier from rows (page, content, brand): of at most ``sample_pages`` pages, those of the smallest hashes."""
    ids = rows.filter(F.col("content").rlike(LABELLED.pattern)).select(F.col("page").alias("_p")).orderBy(F.xxhash64("_p"), "_p").limit(sample_pages)
    sample = rows.join(F.broadcast(cut(ids)), F.col("page") == F.col("_p"), "left_semi")  # at most sample_pages ids
    out = []
    for r in sample.toLocalIterator():  # at most sample_pages rows
        out += weak_labels(r["content"], r["brand"])
    return Classifier.fit(out)


def main_body(pages: DataFrame, sites: DataFrame, model: Model, page: str = "page_id", site: str = "site_id", content: str = "content", sample_pages: int = SAMPLE_PAGES, residue: float = 0.03) -> DataFrame:
    """(page, line_no) of the lines of each page's main body."""
    rows = _with_brand(pages, sites, page, site, content)
    sc = pages.sparkSession.sparkContext
    weights, shared = sc.broadcast(train(rows, sample_pages).weights), sc.broadcast(model.shared())

    def run(batches):
        m, c = worker_model(shared), Classifier(weights.value)
        for b in batches:
            at, lines = [], []
            for i, (text, brand) in enumerate(zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)):
                text = m.restore(text)[1]
                plain = bare(text)
                seen = shown(plain)
                share, inside = residue_of(text, seen)
                if share >= residue or inside:
                    continue
                own = body_lines(text, brand, c, plain, seen)
                at += [i] * len(own)
                lines += own
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at, pa.int32())), pa.array(lines, pa.int32())], ["page", "line_no"])

    return rows.mapInArrow(run, f"page {rows.schema['page'].dataType.simpleString()}, line_no int")
