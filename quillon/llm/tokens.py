"""Encoding of all texts by a public byte-level BPE tokenizer, whose files are given by a path.

A text is split into words by the tokenizer's pattern. Words a worker has not met are encoded in DuckDB:
one row for each token position, joined with the merge table; a recursive query contracts each word's
leftmost minimum-rank pair until no pair is left, and an ordered aggregation gives the ids. The worker
remembers its words, so a word is encoded once in each worker.

Scale: one pass over the texts, no shuffle; the memory of words and parts is bounded by ``REMEMBER`` bytes in all, and the words of one
recursive query by ``BLOCK``; words over ``LONG`` bytes go one table at a time, with all leftmost
occurrences of the minimum-rank pair contracted at once, which gives the same ids.

Defined results: null and empty texts have no ids; strings of special tokens are ordinary text.
"""

from __future__ import annotations

import json
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

REMEMBER, BLOCK, LONG = 200_000_000, 12_000, 48
#: What an entry takes besides its characters and ids.
ENTRY = 300
#: Fixed value: the pattern that splits text before merging.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: A single space between two characters that are no white space.
GAP = re.compile(r"(?<=\S) (?=\S)")

# The next state of every word in {st} (w, i, t) that has a pair to merge: its leftmost minimum-rank pair is contracted.
STEP = """SELECT p.w, p.i, CASE WHEN p.i = m.i THEN m.id ELSE p.t END AS t FROM {st} p JOIN (
  SELECT w, arg_min(i, (rank, i)) AS i, arg_min(j, (rank, i)) AS j, arg_min(id, (rank, i)) AS id
  FROM (SELECT w, i, t, lead(t) OVER o AS nxt, lead(i) OVER o AS j FROM {st} WINDOW o AS (PARTITION BY w ORDER BY i)) q
  JOIN merges g ON q.t = g.l AND q.nxt = g.r GROUP BY w) m ON p.w = m.w
WHERE p.i <> m.j"""
# The same for long words: all leftmost occurrences of that pair that don't overlap; i counts without gaps.
LEAP = """SELECT w, row_number() OVER (PARTITION BY w ORDER BY i) AS i, t FROM (
  SELECT b.w, b.i, CASE WHEN b.take THEN b.id ELSE b.t END AS t, coalesce(lag(b.take) OVER (PARTITION BY b.w ORDER BY b.i), false) AS gone FROM (
    SELECT *, coalesce(rank = best AND (t <> nxt OR row_number() OVER (PARTITION BY w, rank = best, run ORDER BY i) % 2 = 1), false) AS take FROM (
      SELECT *, i - row_number() OVER (PARTITION BY w, rank = best ORDER BY i) AS run FROM (
        SELECT p.*, m.rank, m.id, min(m.rank) OVER (PARTITION BY p.w) AS best
        FROM (SELECT w, i, t, lead(t) OVER (PARTITION BY w ORDER BY i) AS nxt FROM {st}) p LEFT JOIN merges m ON p.t = m.l AND p.nxt = m.r)
      WHERE best IS NOT NULL)) b)
WHERE NOT gone"""


def default_path() -> str:
    """Where the box keeps the tokenizer's file."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _byte_letters() -> dict[str, int]:
    """The printable letter that the file writes for each byte: printable bytes stand for themselves, the rest follow from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class Encoder:
    """Encodes texts by a tokenizer file; made once in each worker."""

    def __init__(self, path: str):
        import duckdb
        import regex

        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        vocab = model["vocab"]
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.byte_id = np.zeros(256, np.int32)
        for letter, b in _byte_letters().items():
            self.byte_id[b] = vocab[letter]
        self.split = regex.compile(PATTERN).findall
        self.memory: dict[str, np.ndarray] = {}
        self.heads: dict[str, np.ndarray] = {}
        self.tails: dict[str, np.ndarray] = {}
        self.held = 0
        self.db = duckdb.connect(":memory:", config={"threads": 1, "memory_limit": "400MB", "temp_directory": ""})
        merges = pa.table({  # noqa: F841  read by DuckDB
            "l": pa.array([vocab[a] for a, _ in pairs], pa.int32()), "r": pa.array([vocab[b] for _, b in pairs], pa.int32()),
            "rank": pa.array(range(len(pairs)), pa.int32()), "id": pa.array([vocab[a + b] for a, b in pairs], pa.int32()),
        })
        self.db.execute("CREATE TABLE merges AS SELECT * FROM merges")

    def _rows(self, words: list[bytes]):
        n = np.fromiter(map(len, words), np.int64, len(words))
        start = np.repeat(np.cumsum(n) - n, n)
        return pa.table({"w": pa.array(np.repeat(np.arange(len(words), dtype=np.int32), n)), "i": pa.array(np.arange(n.sum()) - start + 1), "t": pa.array(self.byte_id[np.frombuffer(b"".join(words), np.uint8)])})

    def _fixpoint(self, words: list[bytes]) -> list[np.ndarray]:
        """Ids of words by one recursive query; a word's last state counts."""
        base = self._rows(words)  # noqa: F841  read by DuckDB
        got = self.db.execute(f"""
            WITH RECURSIVE s(n, w, i, t) AS (
              SELECT 0, w, i, t FROM base UNION ALL SELECT (SELECT max(n) FROM s) + 1, x.w, x.i, x.t FROM ({STEP.format(st="s")}) x)
            SELECT w, list(t ORDER BY i) AS ids FROM (SELECT *, max(n) OVER (PARTITION BY w) AS last FROM s) WHERE n = last GROUP BY w ORDER BY w""").fetchall()
        return [np.asarray(x, np.int32) for _, x in got]

    def _stepwise(self, words: list[bytes]) -> list[np.ndarray]:
        """The same for long words: each contraction replaces the table, so nothing piles up."""
        base = self._rows(words)  # noqa: F841
        self.db.execute("CREATE OR REPLACE TEMP TABLE a AS SELECT * FROM base")
        ids: list = [None] * len(words)
        while True:
            self.db.execute(f"CREATE OR REPLACE TEMP TABLE b AS {LEAP.format(st='a')}")
            done = self.db.execute("SELECT w, list(t ORDER BY i) FROM a WHERE w NOT IN (SELECT w FROM b) GROUP BY w").fetchall()
            for w, t in done:
                ids[w] = np.asarray(t, np.int32)
            if not self.db.execute("SELECT 1 FROM b LIMIT 1").fetchall():
                return ids
            self.db.execute("CREATE OR REPLACE TEMP TABLE a AS SELECT * FROM b")

    def _keep(self, known: dict[str, np.ndarray], key: str, ids: np.ndarray) -> None:
        known[key] = ids
        self.held += ENTRY + 2 * len(key) + ids.nbytes

    def _make_room(self) -> None:
        """Forgets everything once the bytes held pass the limit."""
        if self.held > REMEMBER:
            for known in (self.memory, self.heads, self.tails):
                known.clear()
            self.held = 0

    def learn(self, words: set[str]) -> None:
        """Encodes the words that are new."""
        new = sorted(w for w in words if w not in self.memory)
        raw = [w.encode("utf-8", "surrogatepass") for w in new]
        for long, encode in ((False, self._fixpoint), (True, self._stepwise)):
            some = [k for k, b in enumerate(raw) if (len(b) > LONG) is long]
            for at in range(0, len(some), BLOCK):
                part = some[at : at + BLOCK]
                for k, ids in zip(part, encode([raw[k] for k in part]), strict=True):
                    self._keep(self.memory, new[k], ids)

    def words(self, texts: list[str | None]) -> list[list[str]]:
        """The words of each text, all of them known afterwards."""
        self._make_room()
        return self._words(texts)

    def _words(self, texts: list[str | None]) -> list[list[str]]:
        out = [self.split(t) if t else [] for t in texts]
        self.learn(set().union(*out))
        return out

    def _parts(self, texts: list[str | None]) -> list[list[np.ndarray]]:
        """The ids of each text, in parts. No word reaches over a single space between two other characters, so a
        text is cut there first; parts are remembered: those at a text's start, and those behind a space."""
        self._make_room()
        cut = [GAP.split(t) if t else [] for t in texts]
        heads = {c[0] for c in cut if c}
        tails = set().union(*(c[1:] for c in cut))
        for parts, known, before in ((heads, self.heads, ""), (tails, self.tails, " ")):
            new = [x for x in parts if x not in known]
            for part, ws in zip(new, self._words([before + x for x in new]), strict=True):
                self._keep(known, part, np.concatenate([self.memory[w] for w in ws]) if len(ws) > 1 else self.memory[ws[0]])
        head, tail = self.heads.__getitem__, self.tails.__getitem__
        return [[head(c[0]), *map(tail, c[1:])] if c else [] for c in cut]

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """The ids of each text."""
        none = np.zeros(0, np.int32)
        return [np.concatenate(p) if p else none for p in self._parts(texts)]

    def sizes(self, texts: list[str | None]) -> list[int]:
        """The number of ids of each text."""
        return [sum(map(len, p)) for p in self._parts(texts)]


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def blocks(texts: list, most: int = 4_000_000):
    """Index ranges of texts of some million characters each; a longer text is its own range."""
    start = size = 0
    for k, t in enumerate(texts):
        n = len(t or "")
        if k > start and size + n > most:
            yield start, k
            start, size = k, 0
        size += n
    if start < len(texts):
        yield start, len(texts)


def encode_texts(rows: DataFrame, key: str, text: str, path: str | None = None) -> DataFrame:
    """(key, ids) of every row."""
    path = path or default_path()
    src = rows.select(F.col(key).alias("key"), F.col(text).alias("text"))

    def run(batches):
        e = encoder(path)
        for b in batches:
            texts = b.column(1).to_pylist()
            for i, j in blocks(texts):
                ids = e.encode(texts[i:j])
                offsets = np.zeros(len(ids) + 1, np.int32)
                np.cumsum([len(x) for x in ids], out=offsets[1:])
                flat = np.concatenate(ids) if ids else np.zeros(0, np.int32)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))], ["key", "ids"])

    return src.mapInArrow(run, f"key {src.schema['key'].dataType.simpleString()}, ids array<int>")


def token_sizes(rows: DataFrame, key: str, text: str, path: str | None = None) -> DataFrame:
    """(key, tokens) of every row."""
    path = path or default_path()
    src = rows.select(F.col(key).alias("key"), F.col(text).alias("text"))

    def run(batches):
        e = encoder(path)
        for b in batches:
            texts = b.column(1).to_pylist()
            for i, j in blocks(texts):
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), pa.array(e.sizes(texts[i:j]), pa.int64())], ["key", "tokens"])

    return src.mapInArrow(run, f"key {src.schema['key'].dataType.simpleString()}, tokens bigint")
