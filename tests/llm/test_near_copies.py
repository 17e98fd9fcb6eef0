"""The pipeline's near-copy stage against brute force over five-word shingles."""

import random

import pytest
from fieldloom.llm import simhash


def shingled(text):
    words = text.lower().split()
    return {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()


def brute_kept(rows):
    """Smallest ids of the components of 'Jaccard similarity 0.8 or more'."""
    sets = {d: shingled(t) for d, t in rows}
    up = {d: d for d in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            both = len(sets[a] & sets[b])
            if sets[a] == sets[b] or both >= 0.8 * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((find(a), find(b)))
                up[y] = x
    return {d for d in ids if find(d) == d}


@pytest.fixture(scope="module")
def rows():
    """Pairs that share a passage, of Jaccard 0.5 to 0.95, most of them around 0.8; a chain; repeats; short and empty texts."""
    rng = random.Random(8)
    words = lambda n: [f"w{rng.randrange(5000)}" for _ in range(n)]
    rows = []
    for k in range(150):
        j, n = rng.choice([0.5, 0.6, 0.7, 0.75, 0.78, 0.79, 0.81, 0.82, 0.85, 0.9, 0.95]), rng.randrange(60, 400)
        common = words(round(2 * n * j / (1 + j)) + 4)
        rows += [(2 * k, " ".join(common + words(n - len(common) + 4))), (2 * k + 1, " ".join(words(n - len(common) + 4) + common))]
    long = words(700)
    rows += [(1000 + k, " ".join(long[30 * k : 30 * k + 400])) for k in range(8)]
    rows += [(1100, rows[0][1] + " spam" * 900), (1101, "a b c"), (1102, "A  b c"), (1103, "a b d"), (1104, ""), (1105, None)]
    return [(d, t) for d, t in rows]


def test_near_copies_are_those_of_brute_force(spark, rows):
    got = {r.doc_id for r in simhash.drop_near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute_kept([(d, t or "") for d, t in rows])


def test_large_blocks_are_compared_completely(spark, monkeypatch):
    """All texts share a passage, so the blocks of its shingles hold them all; pairs of 0.82 often share no other key."""
    rng = random.Random(5)
    words = lambda n: [f"w{rng.randrange(5000)}" for _ in range(n)]
    passage, rows = words(150), []
    for k in range(60):
        common = passage + words(30)
        rows += [(2 * k, " ".join(common + words(18))), (2 * k + 1, " ".join(common + words(18)))]
    monkeypatch.setattr(simhash, "LIMIT", 8)
    got = {r.doc_id for r in simhash.drop_near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute_kept(rows)


def test_parts_of_a_block_meet_each_other(spark, monkeypatch):
    """One key for 50 nodes and no second key: every pair shares a bucket, and no bucket holds the block."""
    monkeypatch.setattr(simhash, "LIMIT", 10)
    nodes = spark.createDataFrame([(k, k, [7, 1000 + k]) for k in range(50)], "id long, fp long, keys array<long>")
    buckets = {}
    for r in simhash._blocks(nodes).collect():
        buckets.setdefault((r.band, r.key, r.i, r.j), set()).add(r.id)
    assert {(a, b) for x in buckets.values() for a in x for b in x if a < b} == {(a, b) for b in range(50) for a in range(b)}
    assert max(map(len, buckets.values())) < 30


def test_blocks_of_long_texts_are_dealt_by_bytes(spark, rows, monkeypatch):
    """A block holds few texts, but more of their hashes than one comparison may: same classes, no bucket above the limit."""
    monkeypatch.setattr(simhash, "LIMIT_BYTES", 12_000)
    got = {r.doc_id for r in simhash.drop_near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute_kept([(d, t or "") for d, t in rows])
    nodes = spark.createDataFrame([(k, k, [7, 1000 + k], 900) for k in range(60)], "id long, fp long, keys array<long>, bytes long")
    buckets = {}
    for r in simhash._blocks(nodes).collect():
        buckets.setdefault((r.band, r.key, r.i, r.j), set()).add(r.id)
    assert {(a, b) for x in buckets.values() for a in x for b in x if a < b} == {(a, b) for b in range(60) for a in range(b)}
    assert len(buckets) > 10 and max(map(len, buckets.values())) * 900 < 24_000
