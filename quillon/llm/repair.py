"""Text garbled by a wrong character encoding: found by a noisy-channel model and restored where possible.

A channel is a pair (true encoding, wrong decoding), or two in a row. Under each channel the characters of a
word that is not plain ASCII turn back into a row of bytes, with a wildcard for each byte that was lost (U+FFFD). Over that
row stands a lattice: an arc leads from one byte position to another for every letter that the bytes between them can be, for
all letters of the corpus that fit where a byte is a wildcard or missing. Viterbi search over the byte positions, with a beam, finds the
letters of least cost under letter pairs and word frequencies. A second Viterbi search over the words of a line picks one
channel for each word, with a cost for changing channels, under the word frequencies of the whole corpus (unknown
words fall back to letter pairs of the same counts).

Scale: the word counts are one aggregation over all pages, combined in each worker before the shuffle. The workers get the
``VOCABULARY`` most frequent words by themselves and the counts of all others in a table of ``CELLS`` cells, in which a
word has two places and the smaller number counts: so no word is left out, whatever the corpus, and with W words
beyond the first a word that does not occur passes for one that does with a probability of about (2W / CELLS)^2. Finding and restoring is
one pass without a shuffle.

Defined results: null and empty texts are no case; U+FFFD is always a case, restored only where a word
fits; foreign letters, symbols and capitals that the corpus knows as they are stay as they are.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.sources.tables import cut, uncut

#: The most frequent words, which the workers hold by themselves, and the cells that hold the counts of all others.
VOCABULARY, CELLS = 60_000, 2**22
#: Hypotheses of the search at one byte position; what a missing byte costs.
BEAM, MISSING = 48, 2.0
WILD = -1
PIECE = re.compile(r"[^\W\d_]+|[^\x00-\x7f]")
COUNTED = re.compile(r"[A-Za-z]*[^\W\d_\x00-\x7f][^\W\d_]*|[^\x00-\x7f]")
CHUNK = re.compile(r"[A-Za-z]*[^\x00-\x7f](?:[A-Za-z]|[^\x00-\x7f])*")
#: What CHUNK finds are those of these runs that are not ASCII; to search for runs is linear in the text.
RUN = re.compile(r"[A-Za-z\x80-\U0010ffff]+")
TAG = re.compile(r"<[/!?]?[A-Za-z][^<>]*>")
LOST = "�"
#: A whole letter of UTF-8 (group 1), or what is left of one where bytes are lost (0xFF) or missing.
LETTER = re.compile(
    rb"([\x00-\x7f]|[\xc2-\xdf][\x80-\xbf]|(?:\xe0[\xa0-\xbf]|[\xe1-\xec\xee\xef][\x80-\xbf]|\xed[\x80-\x9f])[\x80-\xbf]|(?:\xf0[\x90-\xbf]|[\xf1-\xf3][\x80-\xbf]|\xf4[\x80-\x8f])[\x80-\xbf]{2})"
    rb"|[\xc2-\xdf]\xff?|[\xe0-\xef][\x80-\xbf\xff]{0,2}|[\xf0-\xf4][\x80-\xbf\xff]{0,3}|\xff[\x80-\xbf\xff]?[\x80-\xbf]{0,2}|[^\xff]",
    re.S,
)
# The pairs (true encoding, wrong decoding).
CHANNELS = (
    *((t,) for t in (
        ("utf-8", "cp1251"), ("utf-8", "cp1252"), ("utf-8", "koi8-r"), ("utf-8", "cp866"), ("utf-8", "cp437"), ("utf-8", "mac-roman"), ("utf-8", "cp850"), ("utf-8", "latin-1"),
        ("cp1251", "cp1252"), ("cp1251", "koi8-r"), ("cp1251", "cp866"), ("koi8-r", "cp1251"), ("koi8-r", "cp1252"), ("koi8-r", "cp866"), ("cp866", "cp1251"), ("cp866", "cp1252"), ("cp866", "koi8-r"),
        ("cp1251", "mac-roman"), ("koi8-r", "latin-1"), ("cp866", "latin-1"), ("cp1251", "latin-1"), ("cp1252", "cp437"), ("cp1252", "cp850"), ("cp1252", "mac-roman"), ("cp437", "cp1252"), ("cp850", "cp1252"),
    )),
    (("utf-8", "cp1252"), ("utf-8", "cp1252")), (("utf-8", "cp1251"), ("utf-8", "cp1251")), (("utf-8", "latin-1"), ("utf-8", "latin-1")), (("utf-8", "cp1252"), ("utf-8", "cp1251")), (("utf-8", "cp1251"), ("utf-8", "cp1252")),
)
#: What only the channels between the two Russian 8-bit encodings can make of letters in one alphabet: their bytes form no UTF-8.
FLIPS = tuple(k for k, c in enumerate(CHANNELS) if c in ((("cp1251", "koi8-r"),), (("koi8-r", "cp1251"),)))
PLAIN = re.compile("[А-Я]?[а-я]{3,}")
# Punctuation that stands beside words in clean text.
PUNCTUATION = frozenset("«»–—“”„…’‘№₽€©·›‹\xa0•")
#: Characters that restored text hardly holds.
STRANGE = re.compile("[\u0080-\u009f\u0530-\u1fff\u2200-\ufffc]")
MIXED = re.compile("[a-zA-Z].*[\u0400-\u052f]|[\u0400-\u052f].*[a-zA-Z]")
SWITCH = 4.0


@lru_cache(None)
def _byte_of(codec: str) -> dict[str, int]:
    """The byte of each character of an 8-bit decoding; bytes it lacks stand for the control of the same number."""
    out = {chr(b): b for b in range(256)} if codec in ("cp1252", "latin-1") else {chr(b): b for b in range(128, 160)}
    for b in range(128, 256):
        try:
            out[bytes([b]).decode(codec)] = b
        except UnicodeDecodeError:
            out[chr(b)] = b
    return out


def byte_row(text: str, wrong: str) -> list[int] | None:
    """The bytes of a text that was read in the wrong decoding, ``WILD`` for lost ones; None where it can't have come this way."""
    table, out = _byte_of(wrong), []
    for c in text:
        b = ord(c) if c < "\x80" else WILD if c == LOST else table.get(c)
        if b is None:
            return None
        out.append(b)
    return out


@lru_cache(None)
def _to_bytes(wrong: str) -> dict[int, str]:
    """For ``str.translate``: each character of a decoding becomes that of its byte's number, characters it lacks none of those."""
    return {b: "\uffff" for b in range(128, 256)} | {ord(c): chr(b) for c, b in _byte_of(wrong).items()}


def whole_bytes(text: str, wrong: str) -> bytes | None:
    """The same of a text without lost bytes."""
    try:
        return text.translate(_to_bytes(wrong)).encode("latin-1")
    except UnicodeEncodeError:
        return None


def _letters(raw: bytes) -> str:
    """UTF-8 in which 0xFF stands for a lost byte; one U+FFFD for each damaged letter."""
    return "".join(m[0].decode("utf-8", "replace") if m[1] else LOST for m in LETTER.finditer(raw))


def _raw(row: list[int]) -> bytes:
    return bytes(0xFF if b == WILD else b for b in row)


def _damaged(row: list[int], true: str) -> str | None:
    """The text of a row of bytes with U+FFFD for damaged letters; None where too little of it is whole."""
    if WILD not in row:
        try:
            return bytes(row).decode(true)
        except UnicodeDecodeError:
            pass
    if true != "utf-8":
        return None
    out = _letters(_raw(row))
    whole = sum(c > "\x7f" for c in out) - out.count(LOST)
    return out if whole and 2 * row.count(WILD) < len(row) else None


class Alphabet:
    """The letters of a corpus beyond ASCII, by their bytes in UTF-8."""

    def __init__(self, letters):
        self.letters = "".join(sorted(letters))
        self.bytes = [(c, c.encode("utf-8", "surrogatepass")) for c in self.letters]
        self.known: dict[tuple, str] = {}

    def fitting(self, row: tuple, size: int | None = None) -> str:
        """The letters whose bytes begin with the row (wildcards fit all), of so many bytes if a size is given."""
        key = (row, size)
        if key not in self.known:
            self.known[key] = "".join(c for c, b in self.bytes if len(b) >= len(row) and size in (None, len(b)) and all(x in (WILD, y) for x, y in zip(row, b)))
        return self.known[key]

    def ending(self, byte: int) -> str:
        """The letters whose last byte it is."""
        key = (byte, 0)
        if key not in self.known:
            self.known[key] = "".join(c for c, b in self.bytes if b[-1] == byte)
        return self.known[key]


def utf8_arcs(row: list[int], alphabet: Alphabet) -> list[list[tuple[int, str, float, bool]]]:
    """The lattice of a row of bytes: for each position the arcs (next position, letters that fit, cost, whether a byte is lost)."""
    out = []
    for i, b in enumerate(row):
        arcs: list[tuple[int, str, float, bool]] = []
        if 0 <= b < 0x80:
            arcs.append((i + 1, chr(b), 0.0, False))
        else:
            for size in (2, 3, 4):
                part = tuple(row[i : i + size])
                if len(part) < size or any(0 <= x < 0x80 or x > 0xBF for x in part[1:]) or 0x80 <= b <= 0xBF:
                    continue
                if WILD in part:
                    if fit := alphabet.fitting(part, size):
                        arcs.append((i + size, fit, 0.0, True))
                else:
                    try:
                        arcs = [(i + size, bytes(part).decode("utf-8"), 0.0, False)]
                        break
                    except UnicodeDecodeError:
                        pass
            if not any(cost == 0 and not lost for _, _, cost, lost in arcs):
                if 0x80 <= b <= 0xBF:  # the bytes before it are missing
                    arcs.append((i + 1, alphabet.ending(b), MISSING, True))
                else:
                    for size in (1, 2, 3):  # bytes behind these are missing
                        part = tuple(row[i : i + size])
                        if len(part) == size and all(x == WILD or 0x80 <= x <= 0xBF for x in part[1:]) and part.count(WILD) < size:
                            arcs.append((i + size, "".join(c for c in alphabet.fitting(part) if len(c.encode("utf-8", "surrogatepass")) > size), MISSING, True))
                    if b == WILD:
                        arcs.append((i + 1, alphabet.letters, 2 * MISSING, True))
        out.append([(j, fit, cost, lost) for j, fit, cost, lost in arcs if fit])
    return out


def letter_arcs(text: str, alphabet: Alphabet) -> list[list[tuple[int, str, float, bool]]]:
    """The lattice of a text that is right but for lost letters."""
    return [[(i + 1, alphabet.letters if c == LOST else c, 0.0, c == LOST)] for i, c in enumerate(text)]


class Model:
    """Word frequencies of a corpus with letter pairs for the words it lacks. Words of two scripts are no words."""

    def __init__(self, counts: dict[str, int], tail: tuple[np.ndarray, np.ndarray] | None = None):
        counts = {w: n for w, n in counts.items() if w.isascii() or not MIXED.search(w)}
        self.counts, self.tail = counts, tail
        self.total = float(sum(counts.values()) or 1)
        pairs: Counter = Counter()
        first: Counter = Counter()
        self.fold: Counter = Counter()
        for w, n in counts.items():
            self.fold[w.lower()] += n
            for a, b in zip("^" + w, w + "$"):
                pairs[a, b] += n
                first[a] += n
        self.pair = {k: math.log((n + 0.01) / (first[k[0]] + 3)) for k, n in pairs.items()}
        self.unseen = {a: math.log(0.01 / (n + 3)) for a, n in first.items()}
        self.prefixes: set[str] | None = None
        self.follow: dict[str, dict[str, float]] = {}
        self.paths: dict[tuple, str | None] = {}
        self.memo: dict[str, tuple] = {}
        self.clean: set[str] = set()

    def shared(self) -> tuple:
        """What the workers need to build the model again."""
        return self.counts, self.tail

    def count(self, w: str) -> int:
        """How often the corpus has a word."""
        n = self.counts.get(w)
        return n if n is not None else self._beyond(w) if self.tail is not None else 0

    def _beyond(self, w: str) -> int:
        cells, n = self.tail
        own = cells_of(w)
        at = np.searchsorted(cells, own)
        return min(int(n[k]) if k < len(cells) and cells[k] == c else 0 for k, c in zip(at, own))

    def purged(self) -> Model:
        """A model without the words that are themselves garbled: those that a channel explains much better."""
        bad = {w for w in self.counts if self.explained(w)}
        return Model({w: n for w, n in self.counts.items() if w not in bad}, self.tail)

    def explained(self, w: str) -> bool:
        """Whether a channel explains a word much better than it is."""
        return not w.isascii() and bool((o := self.options(w))[1:]) and max(s for _, s, _ in o[1:]) > o[0][1] + 4 * len(CHUNK.findall(w))

    def word(self, w: str) -> float:
        """The log-probability of a piece; words of ASCII are alike under every channel."""
        if w.isascii():
            return -9.0
        n = self.count(w)
        if n < 3:
            f = self.fold.get(w.lower(), 0)
            if f >= 3 and (w.isupper() or w.islower() or w.istitle()):
                return math.log(f / self.total) - 2.0
        if n >= 3 or len(w) == 1:
            return math.log((n + 0.01) / self.total)
        return sum(max(self.pair.get((a, b)) or self.unseen.get(a, -12.0), -12.0) for a, b in zip("^" + w, w + "$")) - 5.0

    def score(self, text: str) -> float:
        """The log-probability of a chunk's pieces."""
        return sum(self.word(p) for p in PIECE.findall(text))

    @property
    def alphabet(self) -> Alphabet:
        if self.prefixes is None:
            words = [w for w, n in self.counts.items() if n >= 3 and w.isalpha()]
            self.prefixes = {w[:k] for w in words for k in range(1, len(w) + 1)}
            self._alphabet = Alphabet({c for w in words for c in w if c > "\x7f"})
            for (x, y), p in self.pair.items():
                self.follow.setdefault(x, {})[y] = p
        return self._alphabet

    def best_path(self, arcs: list[list[tuple[int, str, float, bool]]]) -> str | None:
        """The likeliest text of a lattice, by Viterbi search with a beam: of equal last letters of a word's beginning the better one
        goes on. Lost letters are filled only within words of the corpus, and stay U+FFFD elsewhere; None where no path leads through."""
        self.alphabet  # noqa: B018  makes the prefixes
        # hypotheses (cost so far of whole words, cost of the open word by letter pairs, open word, the same with lost letters, text before it)
        at: list[dict[str, tuple]] = [{} for _ in range(len(arcs) + 1)]
        at[0][""] = (0.0, 0.0, "", "", "")

        def closed(h: tuple) -> tuple[float, str]:
            done, _, word, seen, before = h
            if not word:
                return done, before
            if LOST in seen and not self.known(word):
                return done - 3.0 * seen.count(LOST) + self.word(seen.replace(LOST, "")) - 5.0, before + seen
            return done + self.word(word), before + word

        for i, own in enumerate(arcs):
            best = at[i].values() if len(at[i]) == 1 else sorted(at[i].values(), key=lambda h: h[0] + h[1] + (6.0 if h[2] in self.prefixes else 0.0), reverse=True)[:BEAM]
            for h in best:
                done, open_, word, seen, before = h
                follow = self.follow.get(word[-1] if word else "^", {})
                for j, letters, cost, lost in own:
                    ahead = at[j]
                    # a lost letter is one that the corpus knows behind the letter before it
                    for c in ([c for c in letters if c in follow] if lost else letters):
                        if c.isalpha():
                            new = (done - cost, open_ + follow.get(c, -12.0), word + c, seen + (LOST if lost else c), before)
                        else:
                            total, text = closed(h)
                            new = (total - cost + (-3.0 if lost else self.word(c)), 0.0, "", "", text + (LOST if lost else c))
                        old = ahead.get(new[2])
                        if old is None or new[0] + new[1] > old[0] + old[1]:
                            ahead[new[2]] = new
            at[i] = {}
        if not at[-1]:
            return None
        return max((closed(h) for h in at[-1].values()), key=lambda x: x[0])[1]

    def undo(self, text: str, channel, seen: dict) -> str | None:
        """The text under a channel undone; U+FFFD where letters are lost for good; None where it can't have come this way.
        seen: bytes by text and decoding, for the channels that share one."""
        for k, (true, wrong) in enumerate(channel):
            if LOST in text:
                row = byte_row(text, wrong)
            else:
                key = (text, wrong)
                if key in seen:
                    raw = seen[key]
                else:
                    raw = seen[key] = whole_bytes(text, wrong)
                if raw is None:
                    return None
                try:
                    text = raw.decode(true)
                    continue
                except UnicodeDecodeError:
                    row = list(raw)
            if row is None:
                return None
            text = _damaged(row, true)
            if text is None:
                return None
            if LOST in text and k == len(channel) - 1:
                whole = sum(c > "\x7f" for c in text) - text.count(LOST)
                few = whole > text.count(LOST) and whole >= 2
                at = tuple(row)
                if at not in self.paths:
                    if len(self.paths) > 300_000:
                        self.paths.clear()
                    self.paths[at] = self.best_path(utf8_arcs(row, self.alphabet))
                text = self.paths[at] or text
                if LOST in text and not few:
                    return None  # too little is left to tell
        return text

    def fill(self, text: str) -> str:
        """Lost letters of words that are right otherwise, filled where a word of the corpus fits; more than half of a word must be there."""

        def best(m: re.Match) -> str:
            if LOST not in m[0] or len(m[0]) <= 2 * m[0].count(LOST):
                return m[0]
            return self.best_path(letter_arcs(m[0], self.alphabet)) or m[0]

        return re.sub(rf"(?:[^\W\d_]|{LOST})+", best, text)

    def known(self, w: str) -> bool:
        return w.isascii() or self.count(w) >= 3 or self.fold.get(w.lower(), 0) >= 3

    def options(self, chunk: str) -> tuple:
        """((channel, score, text), ...) of a chunk, the unchanged one first.

        Bytes that form valid UTF-8 by chance are rare, so every sequence counts for that channel; between
        8-bit encodings any text decodes, so words the corpus lacks and symbols count against it."""
        got = self.memo.get(chunk)
        if got is None:
            if len(self.memo) > 300_000:
                self.memo.clear()
            got, seen = [(-1, self.score(chunk), chunk)], {}
            for k in FLIPS if PLAIN.fullmatch(chunk) else range(len(CHANNELS)):
                ch = CHANNELS[k]
                t = self.undo(chunk, ch, seen)
                if t is None or t == chunk:
                    continue
                own = self.score(t) - 3.0 * t.count(LOST) - 1.0
                if ch[0][0] == "utf-8":
                    own += 2.5 * (len(chunk) - len(t)) - 15.0 * len(STRANGE.findall(t))
                else:
                    parts = PIECE.findall(t)
                    own -= sum((4.0 if p.isascii() else 0.0 if self.known(p) else 8.0) if p[0].isalpha() else 1.5 for p in parts)
                    if any(c < "\x80" for c in chunk) and self.count(t) < 3:
                        continue  # a word of ASCII letters with others among them must come out as a word
                got.append((k, own, t))
            got = self.memo[chunk] = tuple(got)
        return got

    def is_clean(self, chunk: str) -> bool:
        """Whether no channel can explain a chunk better than it is."""
        if len(self.clean) > 300_000:
            self.clean.clear()
        pieces = PIECE.findall(chunk)
        if all(p in PUNCTUATION or (len(p) > 1 or len(pieces) == 1) and p[0].isalpha() and (p.isascii() or self.count(p) >= 3) for p in pieces):
            return True
        o = self.options(chunk)
        return all(s <= o[0][1] for _, s, _ in o[1:])

    def line(self, line: str) -> tuple[float, str]:
        """(gain, restored) of a line: how much likelier the best path makes it than it is as it stands."""
        spans = [m for m in CHUNK.finditer(line)]
        lattice = [self.options(m[0]) for m in spans]
        if all(len(o) == 1 for o in lattice):
            return 0.0, line
        best: dict[int, tuple[float, tuple]] = {-1: (0.0, ())}
        for options in lattice:
            top = max(best.items(), key=lambda x: x[1][0])
            now = {}
            for k, s, t in options:
                stay = best.get(k, (-math.inf, ()))
                leave = top[1][0] - SWITCH
                score, back = (stay[0], stay[1]) if stay[0] >= leave else (leave, top[1][1])
                now[k] = (score + s, (back, t))
            best = now
        score, back = max(best.values(), key=lambda x: x[0])
        gain = score - sum(o[0][1] for o in lattice)
        if gain <= 0:
            return 0.0, line
        texts = []
        while back:
            back, t = back
            texts.append(t)
        out, at = [], 0
        for m, t in zip(spans, reversed(texts)):
            out += [line[at : m.start()], t]
            at = m.end()
        return gain, "".join(out) + line[at:]

    def restore(self, text: str | None, least: float = 6.0) -> tuple[bool, str | None]:
        """(garbled, restored text); whole texts, line by line. Tags are left as they are."""
        if not text or text.isascii():
            return False, text
        found, out = LOST in text, []
        chunks = {c for c in set(RUN.findall(text)) if not c.isascii()}
        bad = [c for c in chunks - self.clean if not self.is_clean(c) or self.clean.add(c)]
        if not bad:
            return found, text
        for line in text.split("\n"):
            if line.isascii() or not any(c in line for c in bad):
                out.append(line)
                continue
            parts, at, gain = [], 0, 0.0
            for m in [*TAG.finditer(line), None]:
                piece = line[at : m.start() if m else len(line)]
                if piece.isascii():
                    parts.append(piece)
                else:
                    g, t = self.line(piece)
                    gain += g
                    parts.append(self.fill(t) if LOST in t else t)
                if m:
                    parts.append(m[0])
                    at = m.end()
            if gain >= least:
                found = True
            if gain >= least or LOST in line:
                out.append("".join(parts))
            else:
                out.append(line)
        return found, "\n".join(out)


def word_counts(texts: DataFrame, text: str) -> DataFrame:
    """(word, n) over all texts: words with a letter beyond ASCII, and characters beyond it that are no letters. Counted in each worker first."""
    rows = texts.select(F.col(text).alias("t")).filter("t is not null")

    def counted(c: Counter) -> pa.RecordBatch:
        words: Counter = Counter()
        for run, n in c.items():
            for w in COUNTED.findall(run):
                words[w] += n
        return pa.RecordBatch.from_arrays([pa.array(list(words)), pa.array(list(words.values()), pa.int64())], ["word", "n"])

    def count(batches):
        c: Counter = Counter()
        for b in batches:
            for t in b.column(0).to_pylist():
                if not t.isascii():
                    c.update(x for x in RUN.findall(t) if not x.isascii())
            if len(c) > 500_000:
                yield counted(c)
                c.clear()
        if c:
            yield counted(c)

    return rows.mapInArrow(count, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


def cells_of(word: str) -> tuple[int, int]:
    """The two cells of a word."""
    h, half = xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass")), CELLS // 2
    return h % half, half + (h >> 32) % half


def build_model(texts: DataFrame, text: str = "content", vocabulary: int = VOCABULARY) -> Model:
    """The model of a corpus, from the counts of all its words. Garbled words are left out of it."""
    counts = cut(word_counts(texts, text).filter("n >= 2"))
    top = [tuple(r) for r in counts.orderBy(F.desc("n"), "word").limit(vocabulary).collect()]  # at most ``vocabulary`` rows
    model = Model(dict(top)).purged()
    if len(top) == vocabulary:
        last, n = top[-1]
        shared = texts.sparkSession.sparkContext.broadcast(model.shared())

        def cells(batches):
            m = worker_model(shared)
            for pdf in batches:
                rows = [(c, n) for w, n in zip(pdf["word"], pdf["n"], strict=True) if not (MIXED.search(w) or m.explained(w)) for c in cells_of(w)]
                yield pd.DataFrame(rows, columns=["cell", "n"])

        rest = counts.filter((F.col("n") >= 3) & ((F.col("n") < n) | ((F.col("n") == n) & (F.col("word") > last))))
        got = rest.mapInPandas(cells, "cell int, n bigint").groupBy("cell").agg(F.sum("n").alias("n")).orderBy("cell").toArrow()  # at most CELLS rows
        model = Model(model.counts, (got["cell"].to_numpy().astype(np.int64), np.minimum(got["n"].to_numpy(), 2**31 - 1).astype(np.int32)))
    uncut(counts)
    return model


def restore_rows(rows: DataFrame, model: Model, key: str, text: str) -> DataFrame:
    """(key, garbled, text, restored) of every row with a text."""
    shared = rows.sparkSession.sparkContext.broadcast(model.shared())
    src = rows.select(F.col(key).alias("key"), F.col(text).alias("text")).filter("text is not null")

    def run(batches):
        m = worker_model(shared)
        for pdf in batches:
            got = [m.restore(t) for t in pdf["text"]]
            yield pd.DataFrame({"key": pdf["key"], "garbled": [g for g, _ in got], "text": pdf["text"], "restored": [t for _, t in got]})

    return src.mapInPandas(run, f"key {src.schema['key'].dataType.simpleString()}, garbled boolean, text string, restored string")


_MODELS: list[tuple[object, Model]] = []


def worker_model(shared) -> Model:
    """The model of a broadcast, built once in each Python worker."""
    tables = shared.value
    if not _MODELS or _MODELS[0][0] is not tables:
        _MODELS[:] = [(tables, Model(*tables))]
    return _MODELS[0][1]


def garbled(rows: DataFrame, model: Model, key: str, text: str) -> DataFrame:
    """The keys of garbled texts."""
    return restore_rows(rows, model, key, text).filter("garbled").select("key")
