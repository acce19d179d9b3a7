"""Groups of records whose word shingles are similar, by HyperMinHash.

A record is the set of its runs of consecutive words. Each of ``SKETCHES`` hash functions sends every run into
one of ``BUCKETS`` buckets; of the least hash in a bucket the count of leading zeros and some mantissa bits
behind the leading one are kept, 16 bits together. An empty bucket borrows from a bucket of its sketch that a fixed
probe order names. Bands of registers, each of five sketches, are hashed to 40 bits; records that share a band meet in its
bucket. There the Jaccard similarity is estimated from the registers' last bits, corrected for their chance
collisions, and what the estimate leaves is verified on the sets themselves. Linked records form groups by iterated star
contraction.

Losses: with 128 bands of 5 registers a pair at similarity 0.6 is missed with a probability of 3.2e-5, one at 0.65
of 1e-7; the estimate, with five standard errors of slack, drops another 9e-7 of the pairs at 0.6: 3.3e-5 together.
Sets are known by 64-bit hashes.

Scale: equal sets are one node until the end, and a task sends the bands of a set once. The bands are partitioned by
key once, sorted, and read as a stream, so no bucket is gathered: members of shared bands go on with 64 bytes of
register bits each. A bucket of up to ``SMALL`` members gives its pairs at once. Larger ones are compared in blocks of ``BLOCK`` members,
and every member passes on its nearest partners of other groups only; rounds with more partners follow until
no pair of two groups is left unverified, so that no link that connects groups is lost. Texts are read again for the wanted records
alone: a bitmap of fixed size tells which rows can be wanted. Nothing else is broadcast, and nothing depends on a table's size.

Defined results: null and empty texts and those of fewer than ``least_words`` words are in no group; a repeated
delivery must be dropped by the caller (one row for each id); equal texts are similar whatever their length beyond that.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.visible import visible
from quillon.sources.tables import cut, uncut

SKETCHES, BUCKETS, MANTISSA = 40, 16, 10
BANDS, ROWS, BITS = 128, 5, 512
SMALL, BLOCK = 64, 8192
#: Nearest partners that a member of a large bucket passes on in the first round, and the factor for the next ones.
NEAREST, MORE = 8, 8
_WORDS: dict[str, int] = {}

_random = np.random.default_rng(20240917)
SALT = _random.integers(0, 2**64, (SKETCHES, 1), np.uint64)
ODD = _random.integers(0, 2**64, (SKETCHES, 1), np.uint64) | np.uint64(1)
PROBES = _random.integers(0, BUCKETS, (64, SKETCHES, BUCKETS))


def shingles(text: str | None, width: int = 3, least_words: int = 40) -> np.ndarray:
    """The 64-bit hashes of the distinct runs of words in a text's visible part; empty for short texts."""
    words = visible(text).lower().split() if text else []
    if len(words) < max(least_words, width):
        return np.zeros(0, np.uint64)
    if len(_WORDS) > 1_000_000:
        _WORDS.clear()
    for w in words:
        if w not in _WORDS:
            _WORDS[w] = xxhash.xxh3_64_intdigest(w.encode("utf-8", "surrogatepass"))
    h = np.fromiter(map(_WORDS.__getitem__, words), np.uint64, len(words))
    n = len(h) - width + 1
    x = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(width):
            x = (x ^ (h[k : k + n] >> np.uint64(k))) * np.uint64(0x9E3779B97F4A7C15)
            x ^= x >> np.uint64(29)
        x *= np.uint64(0xBF58476D1CE4E5B9)
    return np.unique(x ^ (x >> np.uint64(32)))


def _least(x: np.ndarray) -> np.ndarray:
    """The least hash of each sketch's buckets, 0 where a bucket is empty; the bucket's bits are shifted out."""
    with np.errstate(over="ignore"):
        h = (x ^ SALT) * ODD
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(32)
    h.sort(axis=1)
    own = (h >> np.uint64(60)).astype(np.intp)
    first = np.ones(own.shape, bool)
    first[:, 1:] = own[:, 1:] != own[:, :-1]
    out = np.zeros((SKETCHES, BUCKETS), np.uint64)
    s, k = np.nonzero(first)
    out[s, own[s, k]] = (h[s, k] << np.uint64(4)) | np.uint64(1)
    return out


def registers(x: np.ndarray, block: int = 4096) -> np.ndarray:
    """The 16-bit registers of a set of hashes, bucket by bucket: neighbours are of different sketches."""
    least = np.zeros((SKETCHES, BUCKETS), np.uint64)
    for i in range(0, len(x), block):
        part = _least(x[i : i + block])
        least = np.where((least == 0) | ((part != 0) & (part < least)), part, least)
    held = least.copy()
    for probe in PROBES:
        s, k = np.nonzero(least == 0)
        if not len(s):
            break
        least[s, k] = held[s, probe[s, k]]
    else:
        s, k = np.nonzero(least == 0)
        least[s, k] = held[s].max(axis=1)
    # the head of the floating-point form: exponent (64 - leading zeros) and mantissa
    head = least.astype(np.float64).view(np.uint64) >> np.uint64(52 - MANTISSA)
    return (np.uint64((1023 + 64) << MANTISSA) - head).astype(np.uint16).T.reshape(-1)


def band_keys(registers_: np.ndarray) -> np.ndarray:
    """The 40-bit hashes of the bands, five bytes each."""
    r = registers_.reshape(BANDS, ROWS).astype(np.uint64)
    h = np.arange(BANDS, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    with np.errstate(over="ignore"):
        for k in range(ROWS):
            h = (h ^ r[:, k]) * np.uint64(0xBF58476D1CE4E5B9)
            h ^= h >> np.uint64(31)
    return h.view(np.uint8).reshape(BANDS, 8)[:, :5]


def register_bits(registers_: np.ndarray) -> bytes:
    """The last mantissa bits of ``BITS`` registers."""
    return np.packbits((registers_[:BITS] & 1).astype(np.uint8)).tobytes()


def estimate(differing):
    """The Jaccard similarity of two sets of whose register bits so many differ: bits of unlike registers agree by
    chance half the time, which is corrected for."""
    return 1 - 2 * differing / BITS


def most_differing(least: float) -> int:
    """How many bits may differ at a similarity of ``least``: what is expected and five standard errors."""
    share = (1 - least) / 2
    return int(BITS * share + 5 * (BITS * share * (1 - share)) ** 0.5)


def sketches(rows: DataFrame, key: str, text: str, width: int, least_words: int) -> DataFrame:
    """(id, node, keys, bits): the hash of the whole set, its bands and register bits. A task gives those of a set once, else null."""
    src = rows.select(F.col(key).alias("id"), F.col(text).alias("text")).filter("id is not null and text is not null and text <> ''")

    def run(batches):
        seen: set[int] = set()
        for b in batches:
            at, nodes, keys, bits = [], [], [], []
            if len(seen) > 2_000_000:
                seen.clear()
            for i, t in enumerate(b.column(1).to_pylist()):
                x = shingles(t, width, least_words)
                if len(x):
                    at.append(i)
                    node = xxhash.xxh3_64_intdigest(x.tobytes()) - 2**63
                    nodes.append(node)
                    if node in seen:
                        keys.append(None)
                        bits.append(None)
                    else:
                        seen.add(node)
                        r = registers(x)
                        keys.append(band_keys(r).tobytes())
                        bits.append(register_bits(r))
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at, pa.int32())), pa.array(nodes, pa.int64()), pa.array(keys, pa.binary()), pa.array(bits, pa.binary())], ["id", "node", "keys", "bits"])

    return src.mapInArrow(run, f"id {src.schema['id'].dataType.simpleString()}, node bigint, keys binary, bits binary")


def _shared_bands(sk: DataFrame) -> DataFrame:
    """(key, node) of the bands that more than one node has, each once. One shuffle of the bands, by key."""

    def explode(batches):
        for b in batches:
            if b.num_rows:
                raw = np.zeros((b.num_rows, BANDS, 8), np.uint8)
                raw[:, :, :5] = np.frombuffer(b"".join(b.column(1).to_pylist()), np.uint8).reshape(b.num_rows, BANDS, 5)
                at = pa.array(np.repeat(np.arange(b.num_rows), BANDS))
                yield pa.RecordBatch.from_arrays([pa.array(raw.reshape(-1, 8).view(np.int64).reshape(-1)), b.column(0).take(at)], ["key", "node"])

    def shared(batches):
        last: tuple | None = None  # (key, node, whether it was given)
        for b in batches:
            k, n = b.column(0).to_numpy(), b.column(1).to_numpy()
            if not len(k):
                continue
            if last is not None:
                k, n = np.concatenate([[last[0]], k]), np.concatenate([[last[1]], n])
            fresh = np.ones(len(k), bool)
            fresh[1:] = (k[1:] != k[:-1]) | (n[1:] != n[:-1])
            given = last is not None and last[2]
            k, n = k[fresh], n[fresh]
            near = np.zeros(len(k), bool)
            near[1:] = k[1:] == k[:-1]
            near[:-1] |= near[1:]
            more = near.copy()
            if given:
                more[0] = False
            last = (k[-1], n[-1], bool(near[-1]) or (given and len(k) == 1))
            yield pa.RecordBatch.from_arrays([pa.array(k[more]), pa.array(n[more])], ["key", "node"])

    rows = sk.filter("keys is not null").select("node", "keys").mapInArrow(explode, "key bigint, node bigint")
    return rows.repartition("key").sortWithinPartitions("key", "node").mapInArrow(shared, "key bigint, node bigint")


def _differing(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The numbers of differing bits between the rows of two arrays of 64-bit words."""
    out = np.zeros((len(x), len(y)), np.uint16)
    for w in range(x.shape[1]):
        out += np.bitwise_count(x[:, w, None] ^ y[None, :, w])
    return out


def _words(bits: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(bits), np.uint64).reshape(len(bits), BITS // 64)


def _bucket_pairs(members: DataFrame, most: int) -> DataFrame:
    """Of buckets (key, node, bits): (a, b) of the pairs of small ones that the estimate leaves; (key, node, bits) of large ones' members."""

    def run(batches):
        key, nodes, bits, large = None, [], [], False
        a, b, k, n, v = [], [], [], [], []

        def settle():
            if not large and len(nodes) > 1:
                w = _words(bits)
                for i, j in np.argwhere(np.triu(_differing(w, w) <= most, 1)):
                    a.append(nodes[i])
                    b.append(nodes[j])

        def flush():
            pairs = len(a)
            pad = lambda x, kind, before, after: pa.concat_arrays([pa.nulls(before, kind), pa.array(x, kind), pa.nulls(after, kind)])
            out = pa.RecordBatch.from_arrays(
                [pad(a, pa.int64(), 0, len(k)), pad(b, pa.int64(), 0, len(k)), pad(k, pa.int64(), pairs, 0), pad(n, pa.int64(), pairs, 0), pad(v, pa.binary(), pairs, 0)], ["a", "b", "key", "node", "bits"]
            )
            for x in (a, b, k, n, v):
                x.clear()
            return out

        for batch in batches:
            for x, y, z in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if x != key:
                    settle()
                    key, nodes, bits, large = x, [], [], False
                if large:
                    k.append(x)
                    n.append(y)
                    v.append(z)
                    continue
                nodes.append(y)
                bits.append(z)
                if len(nodes) > SMALL:
                    k += [key] * len(nodes)
                    n += nodes
                    v += bits
                    nodes, bits, large = [], [], True
            yield flush()
        settle()
        yield flush()

    return members.repartition("key").sortWithinPartitions("key", "node").mapInArrow(run, "a bigint, b bigint, key bigint, node bigint, bits binary")


def _near_blocks(members: DataFrame, most: int, nearest: int) -> DataFrame:
    """(a, b, more): in large buckets (key, node, bits, label) each member's nearest partners of other labels that the estimate
    leaves, at most ``nearest`` for each pair of blocks; more: whether any were left out there. No pair of blocks is larger than two blocks."""
    counts = members.groupBy("key").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    own = members.join(counts, "key").withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    others = F.sequence(F.lit(0), F.col("blocks") - 1)
    units = own.select("node", "bits", "label", "key", "own", F.explode(others).alias("other")).select(
        "key", F.least("own", "other").alias("p"), F.greatest("own", "other").alias("q"), "own", "node", "bits", "label"
    )

    def run(t: pa.Table) -> pa.Table:
        node, label, side = t["node"].to_numpy(), t["label"].to_numpy(), t["own"].to_numpy()
        w = _words(t["bits"].to_pylist())
        p, q = t["p"][0].as_py(), t["q"][0].as_py()
        found, cut_off = set(), False
        sides = ((side == p, side == q), (side == q, side == p)) if p != q else ((side == p, side == p),)
        for left, right in sides:
            x, y = np.flatnonzero(left), np.flatnonzero(right)
            for i in range(0, len(x), 256):
                part = x[i : i + 256]
                d = _differing(w[part], w[y])
                d[label[part][:, None] == label[y][None, :]] = BITS + 1
                ok = d <= most
                many = ok.sum(axis=1)
                for r in np.flatnonzero(many):
                    c = np.flatnonzero(ok[r])
                    if len(c) > nearest:
                        cut_off = True
                        c = c[np.argpartition(d[r, c], nearest)[:nearest]]
                    found |= {(min(node[part[r]], e), max(node[part[r]], e)) for e in node[y[c]]}
        a, b = zip(*found, strict=True) if found else ((), ())
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64()), "more": pa.array([cut_off] * len(a), pa.bool_())})

    return units.groupBy("key", "p", "q").applyInArrow(run, "a bigint, b bigint, more boolean")


BITMAP_WORDS = 2**20


def bitmap(values: DataFrame) -> np.ndarray:
    """A bitmap of fixed size (8 MB) over the hashes of a column of longs: what it lacks is not among the values."""
    at = values.toDF("h").selectExpr("shiftright(h, 20) ^ h AS x")
    words = at.selectExpr(f"int(pmod(shiftright(x, 6), {BITMAP_WORDS})) AS w", "shiftleft(1L, int(x & 63)) AS v")
    got = words.groupBy("w").agg(F.bit_or("v").alias("v")).toArrow()  # at most BITMAP_WORDS rows
    out = np.zeros(BITMAP_WORDS, np.int64)
    out[got["w"].to_numpy()] = got["v"].to_numpy()
    return out


def in_bitmap(bits: np.ndarray, values: np.ndarray) -> np.ndarray:
    at = (values >> 20) ^ values
    return (bits[(at >> 6) % BITMAP_WORDS] >> (at & 63)) & 1 == 1


def _similar(pairs: DataFrame, sk: DataFrame, rows: DataFrame, key: str, text: str, width: int, least_words: int, threshold: float) -> DataFrame:
    """The pairs of nodes whose sets reach the threshold exactly. Texts are read again; only those the bitmap lets through are looked at."""
    wanted = cut(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct())
    heads = sk.filter("keys is not null").join(wanted, "node", "left_semi").groupBy("node").agg(F.min("id").alias("id"))
    heads = cut(heads.select("node", "id", F.xxhash64("id").alias("h")))
    shared = rows.sparkSession.sparkContext.broadcast(bitmap(heads.select("h")))
    texts = rows.select(F.col(key).alias("id"), F.xxhash64(F.col(key)).alias("h"), F.col(text).alias("text")).filter("text is not null and id is not null")
    kind = texts.schema["id"].dataType.simpleString()

    def sets(batches):
        bits = shared.value
        for b in batches:
            at = np.flatnonzero(in_bitmap(bits, b.column(1).to_numpy()))
            own = [shingles(t, width, least_words).tobytes() for t in b.column(2).take(pa.array(at)).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at)), pa.array(own, pa.binary())], ["id", "set"])

    own = cut(texts.mapInArrow(sets, f"id {kind}, set binary").join(heads.select("id", "node"), "id").dropDuplicates(["node"]).select("node", "set"))
    both = pairs.join(own.select(F.col("node").alias("a"), F.col("set").alias("sa")), "a").join(own.select(F.col("node").alias("b"), F.col("set").alias("sb")), "b")

    def run(batches):
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                i = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(i >= threshold * (len(x) + len(y) - i) - 1e-9)
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    links = cut(both.select("a", "b", "sa", "sb").mapInArrow(run, "a bigint, b bigint"))
    uncut(wanted, heads, own)
    return links


def components(links: DataFrame) -> DataFrame:
    """(id, group) of all ids on links (a, b): the group is its smallest id. Large-star and small-star rounds until nothing changes."""
    edges = cut(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct())
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").filter("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.filter("m < u").select("u", F.col("m").alias("v"))).distinct()
        large = cut(large)
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        now_edges = cut(small)
        uncut(edges, large)
        edges = now_edges
        now = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == before:
            break
        before = now
    member = edges.select(F.col("u").alias("id"), F.col("v").alias("group"))
    return member.unionByName(edges.select(F.col("v").alias("id"), F.col("v").alias("group"))).distinct()


def similar_groups(rows: DataFrame, key: str, text: str, threshold: float = 0.8, width: int = 5, least_words: int = 40) -> DataFrame:
    """(id, group) of the records that are linked to others; the group is its smallest id."""
    sk = cut(sketches(rows, key, text, width, least_words))
    most = most_differing(threshold)
    shared = cut(_shared_bands(sk))
    bits = sk.filter("bits is not null").select("node", "bits").join(shared.select("node").distinct(), "node", "left_semi").dropDuplicates(["node"])
    buckets = cut(_bucket_pairs(shared.join(bits, "node").select("key", "node", "bits"), most))
    check = lambda p: _similar(p, sk, rows, key, text, width, least_words, threshold)
    pairs = cut(buckets.filter("a is not null").select("a", "b").distinct())
    links = check(pairs)
    large = buckets.filter("key is not null").select("key", "node", "bits")
    if not large.isEmpty():
        links = _large_buckets(large, pairs, links, most, check)
    uncut(shared, buckets)
    linked = cut(components(links))
    sizes = sk.groupBy("node").agg(F.min("id").alias("head"), F.count("*").alias("copies"))
    nodes = sizes.join(linked.withColumnRenamed("id", "node"), "node", "left").filter("copies > 1 or group is not null")
    nodes = cut(nodes.select("node", "head", F.coalesce("group", "node").alias("class")))
    names = nodes.groupBy("class").agg(F.min("head").alias("group"))
    return sk.select("id", "node").join(nodes.join(names, "class").select("node", "group"), "node").select("id", "group")


def _large_buckets(large: DataFrame, tested: DataFrame, links: DataFrame, most: int, check) -> DataFrame:
    """Links (those given and more) that connect what the pairs within large buckets connect.

    Buckets of the same members count once. Each round verifies new nearest pairs of two groups; it ends when every pair of two groups
    that the estimate leaves has been verified."""
    same = large.groupBy("key").agg(F.count("*").alias("c"), F.sum(F.xxhash64("node").cast("decimal(38,0)")).alias("s"), F.min("node").alias("x"), F.max("node").alias("y"))
    members = cut(large.join(same.groupBy("c", "s", "x", "y").agg(F.min("key").alias("key")).select("key"), "key", "left_semi"))
    nearest = NEAREST
    while True:
        groups = cut(components(links))
        label = members.join(groups.withColumnRenamed("id", "node"), "node", "left").select("key", "node", "bits", F.coalesce("group", "node").alias("label"))
        found = cut(_near_blocks(label, most, nearest))
        fresh = cut(found.select("a", "b").distinct().join(tested, ["a", "b"], "left_anti"))
        more = not found.filter("more").isEmpty()
        uncut(groups, found)
        if not fresh.isEmpty():
            links = cut(links.unionByName(check(fresh)))
            tested = cut(tested.unionByName(fresh))
        elif not more:
            return links
        nearest *= MORE


def pairs_of_groups(groups: DataFrame) -> DataFrame:
    """(a, b), a < b: all pairs of different records of one group."""
    other = groups.select("group", F.col("id").alias("b"))
    return groups.select("group", F.col("id").alias("a")).join(other, "group").filter("a < b").select("a", "b")
