"""How often every distinct term occurs, and in how many records, counted in burst tries.

Each worker routes its terms down an access trie into small containers; a container that grows past
``BURST`` terms bursts into one container for each next letter, so the depth adapts to the data. A trie
that holds ``HOLD`` counters is written out in term order and emptied, which bounds a worker's memory. The
written subtrees meet again by ranges of terms and records, whose bounds are sampled from the data (prefixes shared by
many terms are split further than rare ones), sorted, and merged in one pass with one open term. A term whose records fill several
ranges comes out of each with its part, and the parts are added up.

Scale: occurrences are combined before the shuffle of the counters, so a term that makes up a third of the rows is a
few counters for each worker; a term that stands in a third of all records is split among ranges. The merge holds one term at a
time. The last sum moves one row for each term and range.

Defined results: terms are in NFC, lower-cased, without outer white space; null and empty terms are none;
rows whose count is null, zero or negative are left out; repeated rows add up; a null record id counts
occurrences but no record.
"""

from __future__ import annotations

import unicodedata

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.sources.tables import cut

BURST, HOLD = 512, 400_000


class BurstTrie:
    """Counters by (term, record) in containers below an access trie."""

    def __init__(self, burst: int = BURST):
        self.burst, self.size = burst, 0
        self.root: list = [False, {}, None]  # [burst yet, children or terms, the term that ends here]

    def add(self, term: str, record, n: int) -> None:
        """Adds n occurrences of a term in a record."""
        node, at = self.root, 0
        while node[0]:
            if at == len(term):
                if node[2] is None:
                    node[2] = {}
                self._count(node[2], record, n)
                return
            node, at = node[1].setdefault(term[at], [False, {}, None]), at + 1
        own = node[1].get(term[at:])
        if own is None:
            own = node[1][term[at:]] = {}
            self._count(own, record, n)
            if len(node[1]) > self.burst:
                self._burst(node)
        else:
            self._count(own, record, n)

    def _count(self, own: dict, record, n: int) -> None:
        if record in own:
            own[record] += n
        else:
            own[record] = n
            self.size += 1

    @staticmethod
    def _burst(node: list) -> None:
        children: dict = {}
        for rest, own in node[1].items():
            if rest:
                children.setdefault(rest[0], [False, {}, None])[1][rest[1:]] = own
            else:
                node[2] = own
        node[0], node[1] = True, children

    def items(self):
        """(term, record, n) in the order of terms."""
        stack = [("", self.root)]
        while stack:
            prefix, (was, inner, end) = stack.pop()
            if not was:
                for rest in sorted(inner):
                    for record, n in inner[rest].items():
                        yield prefix + rest, record, n
                continue
            if end is not None:
                for record, n in end.items():
                    yield prefix, record, n
            stack += [(prefix + c, inner[c]) for c in sorted(inner, reverse=True)]


def normal_term(term: str) -> str:
    """NFC, lower case, no outer white space."""
    return unicodedata.normalize("NFC", unicodedata.normalize("NFC", term).lower()).strip()


def partial_counts(rows: DataFrame, term: str, record: str, count: str | None = None, burst: int = BURST, hold: int = HOLD) -> DataFrame:
    """(term, record, n): the counters of each worker's tries, in the order of terms."""
    n = F.lit(1).cast("long") if count is None else F.col(count).cast("long")
    src = rows.select(F.col(term).alias("term"), F.col(record).alias("record"), n.alias("n")).filter("term is not null and n > 0")
    kind = src.schema["record"].dataType.simpleString()

    def run(batches):
        trie, arrow = BurstTrie(burst), None

        def out():
            t, r, c = zip(*trie.items(), strict=True)
            return pa.RecordBatch.from_arrays([pa.array(t, pa.string()), pa.array(r, arrow), pa.array(c, pa.int64())], ["term", "record", "n"])

        for b in batches:
            arrow = b.column(1).type
            raw = b.column(0).dictionary_encode()
            names = [normal_term(x) for x in raw.dictionary.to_pylist()]
            for i, r, c in zip(raw.indices.to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                if names[i]:
                    trie.add(names[i], r, c)
            if trie.size >= hold:
                yield out()
                trie = BurstTrie(burst)
        if trie.size:
            yield out()

    return src.mapInArrow(run, f"term string, record {kind}, n bigint")


def term_frequencies(rows: DataFrame, term: str, record: str, count: str | None = None, burst: int = BURST, hold: int = HOLD) -> DataFrame:
    """(term, occurrences, records) of every distinct term."""
    parts = cut(partial_counts(rows, term, record, count, burst, hold))
    meeting = parts.repartitionByRange("term", "record").sortWithinPartitions("term", "record")

    def merge(batches):
        now, last, occurrences, records = None, None, 0, 0
        for b in batches:
            t, o, k = [], [], []
            for term_, r, n in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                if term_ != now:
                    if now is not None:
                        t.append(now)
                        o.append(occurrences)
                        k.append(records)
                    now, last, occurrences, records = term_, None, 0, 0
                occurrences += n
                if r is not None and r != last:
                    records += 1
                    last = r
            yield pa.RecordBatch.from_arrays([pa.array(t, pa.string()), pa.array(o, pa.int64()), pa.array(k, pa.int64())], ["term", "occurrences", "records"])
        if now is not None:
            yield pa.RecordBatch.from_arrays([pa.array([now]), pa.array([occurrences], pa.int64()), pa.array([records], pa.int64())], ["term", "occurrences", "records"])

    split = meeting.mapInArrow(merge, "term string, occurrences bigint, records bigint")
    return split.groupBy("term").agg(F.sum("occurrences").alias("occurrences"), F.sum("records").alias("records"))


def marks(terms: DataFrame, common_from: Column, rare_to: int = 2) -> DataFrame:
    """(term, mark): ``rare`` up to ``rare_to`` occurrences, ``common`` from ``common_from`` on; a term may be both."""
    both = F.array(F.when(F.col("occurrences") <= rare_to, F.lit("rare")), F.when(F.col("occurrences") >= common_from, F.lit("common")))
    return terms.select("term", F.explode(F.filter(both, lambda x: x.isNotNull())).alias("mark"))
