import random

import pytest

from quillon.llm import near_duplicates as N

WORDS = [f"w{k}" for k in range(400)]


def _texts(seed=1):
    r = random.Random(seed)
    out = []
    for g in range(12):
        base = r.choices(WORDS, k=120)
        for _ in range(r.choice([1, 2, 6])):
            t = base[:]
            for _ in range(r.choice([0, 2, 5, 9, 14])):
                t[r.randrange(len(t))] = r.choice(WORDS)
            out.append(" ".join(t))
    out += [out[0], out[0], "", None, "too short"]
    return list(enumerate(out))


def _brute(rows, threshold, width=3):
    sets = {}
    for k, t in rows:
        w = (t or "").split()
        if len(w) >= 40:
            sets[k] = {tuple(w[i : i + width]) for i in range(len(w) - width + 1)}
    parent = {k: k for k in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for i in ids:
        for j in ids:
            if i < j and len(sets[i] & sets[j]) >= threshold * len(sets[i] | sets[j]):
                parent[find(i)] = find(j)
    return {(a, b) for a in ids for b in ids if a < b and find(a) == find(b)}


@pytest.mark.parametrize("small", [32, 2])
def test_groups_equal_brute_force(spark, monkeypatch, small):
    monkeypatch.setattr(N, "SMALL", small)
    rows = _texts()
    df = spark.createDataFrame(rows, "page_id long, content string")
    got = {tuple(r) for r in N.pairs_of_groups(N.similar_groups(df, "page_id", "content", 0.6, 3, 40)).collect()}
    assert got == _brute(rows, 0.6)


def test_empty_table(spark):
    df = spark.createDataFrame([], "page_id long, content string")
    assert N.similar_groups(df, "page_id", "content").collect() == []


def test_registers_estimate_similarity():
    r = random.Random(7)
    for common in (0.0, 0.5, 0.75, 1.0):
        both = [r.getrandbits(64) for _ in range(int(300 * common))]
        x, y = (N.np.array(both + [r.getrandbits(64) for _ in range(300 - len(both))], N.np.uint64) for _ in range(2))
        true = len(both) / (600 - len(both))
        a, b = N.registers(N.np.unique(x)), N.registers(N.np.unique(y))
        assert abs((a == b).mean() - true) < 0.1
        bits = [N._words([N.register_bits(v)]) for v in (a, b)]
        assert abs(N.estimate(int(N._differing(*bits)[0, 0])) - true) < 0.2


def test_registers_of_blocks_are_those_of_the_whole():
    x = N.np.array([random.Random(3).getrandbits(64) for _ in range(1)] + [random.Random(k).getrandbits(64) for k in range(5000)], N.np.uint64)
    assert (N.registers(x, 100) == N.registers(x, 10**6)).all()
    assert N.registers(x[:1]).shape == (N.BANDS * N.ROWS,)


def test_recall_at_the_threshold():
    """Pairs at similarity 0.6 share a band and pass the estimate."""
    r, most, missed = N.np.random.default_rng(11), N.most_differing(0.6), 0
    for _ in range(1500):
        u = r.integers(0, 2**64, 75, N.np.uint64)
        a, b = N.registers(u[:60]), N.registers(N.np.concatenate([u[:45], u[60:]]))
        band = (N.band_keys(a) == N.band_keys(b)).all(axis=1).any()
        bits = N._differing(N._words([N.register_bits(a)]), N._words([N.register_bits(b)]))[0, 0]
        missed += not (band and bits <= most)
    assert missed <= 1


def test_bits_allow_five_standard_errors():
    assert N.most_differing(0.6) == 147
    assert N.estimate(N.BITS / 2) == 0 and N.estimate(0) == 1


def test_large_bucket_of_unlike_pages(spark):
    """10,000 members without similar partners and some copies with edits, all in one bucket: blocks, no pairs of all."""
    r = N.np.random.default_rng(2)
    bits = N.np.packbits(r.integers(0, 2, (10_000, N.BITS), N.np.uint8), axis=1)
    near = N.np.repeat(bits[:3], 40, axis=0)
    rows = [(1, k, bytes(v)) for k, v in enumerate(N.np.concatenate([bits, near]))]
    members = spark.createDataFrame(rows, "key long, node long, bits binary").repartition(4)
    asked = []

    def check(p):
        asked.append(p.count())
        return N.cut(p)

    none = spark.createDataFrame([], "a long, b long")
    got = {r["id"]: r["group"] for r in N.components(N._large_buckets(members, none, none, N.most_differing(0.6), check)).collect()}
    assert got == {k: k for k in range(3)} | {10_000 + k: k // 40 for k in range(120)}
    assert sum(asked) <= 123 * N.NEAREST * 2  # two blocks


def test_bitmap(spark):
    values = [random.Random(k).getrandbits(64) - 2**63 for k in range(500)]
    bits = N.bitmap(spark.createDataFrame([(v,) for v in values], "h long"))
    assert N.in_bitmap(bits, N.np.array(values)).all()
    assert N.in_bitmap(bits, N.np.array([random.Random(-k).getrandbits(64) - 2**63 for k in range(1000, 2000)])).mean() < 0.01
