"""SimHash, substring dedup and components against plain versions."""

from __future__ import annotations

import hashlib
from collections import Counter, defaultdict

import xxhash

from budgetlens.llm import graph, simhash, substrings


def plain_fingerprint(text):
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    sh = [b" ".join(w[i:i + 3]) for i in range(len(w) - 2)] or [b" ".join(w)]
    h = [xxhash.xxh64_intdigest(s, seed=42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_groups(items, near):
    parent = {x: x for x in items}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for x in items:
        for y in items:
            if x < y and near(x, y):
                parent[max(top(x), top(y))] = min(top(x), top(y))
    return {x: top(x) for x in items}


def test_simhash_equals_all_pairs(awkward, rows):
    got = Counter((r["doc_id"], r["fingerprint"], r["component_id"]) for r in simhash.near_duplicates(awkward).collect())
    fps = [(i, plain_fingerprint(t)) for i, t in rows]
    group = plain_groups({f for _, f in fps}, lambda x, y: (x ^ y).bit_count() <= 2)
    least = defaultdict(list)
    for i, f in fps:
        if i is not None:
            least[group[f]].append(i)
    want = Counter((i, f"{f:016x}", min(least[group[f]], default=None)) for i, f in fps)
    assert got == want


def test_index_links_chains_across_and_within_segments(spark):
    fps = [0, 1, 3, 7, 1 << 63, (1 << 63) | (1 << 20), 0b11 << 40, 0b1111 << 40, 0xFFFF << 16, (1 << 64) - 1]
    df = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f,) for f in fps], "fp long")
    for most in (0, 1, 2):
        got = {r["node"] & (2 ** 64 - 1): r["root"] for r in graph.components(simhash.links(df, most)).collect()}
        want = plain_groups(set(fps), lambda x, y, most=most: (x ^ y).bit_count() <= most)
        for x in fps:
            for y in fps:
                together = want[x] == want[y]
                assert together == (x == y or x in got and got.get(x) == got.get(y)), (most, x, y)


def test_buckets_of_any_size_link_alike(spark):
    """Groups of near copies, thin and crowded: whole buckets, split ones and
    a mixture of both give the components of all pairs."""
    import random

    rng = random.Random(8)
    fps = {0, (1 << 64) - 1}
    for size in (2, 5, 60, 250):
        centre = rng.getrandbits(64)
        for _ in range(size):
            fps.add(centre ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 3))))
    fps |= {rng.getrandbits(64) for _ in range(50)}
    df = spark.createDataFrame([(simhash._signed(f),) for f in fps], "fp long")
    for most in (1, 2):
        want = plain_groups(fps, lambda x, y, most=most: (x ^ y).bit_count() <= most)
        for crowd in (1, 8, 10_000):
            edges = simhash.links(df, most, crowd=crowd)
            assert edges.filter(f"bit_count(u ^ v) > {most} or u <= v").isEmpty()
            root = {r["node"] & (2 ** 64 - 1): r["root"] for r in graph.components(edges).collect()}
            groups, plain = defaultdict(set), defaultdict(set)
            for f in fps:
                groups[root.get(f, ("alone", f))].add(f)
                plain[want[f]].add(f)
            assert sorted(map(sorted, groups.values())) == sorted(map(sorted, plain.values())), (most, crowd)
    assert simhash.index_entries(df).count() == 6 * len(fps)


def test_components_of_long_chain_and_hub(spark):
    edges = [(i, i + 1) for i in range(300)] + [(1000, 1001 + i) for i in range(500)] + [(5, 5), (None, 3)]
    got = {r["node"]: r["root"] for r in graph.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert set(got) == set(range(301)) | set(range(1000, 1501))
    assert all(v == (0 if k < 500 else 1000) for k, v in got.items())


def test_keep_one_keeps_one_of_each_group(awkward, rows):
    kept = simhash.keep_one(awkward)
    assert kept.columns == awkward.columns
    marks = simhash.near_duplicates(awkward).collect()
    want = Counter({r["component_id"] for r in marks if r["doc_id"] is not None})
    want[None] = sum(i is None for i, _ in rows)
    assert Counter(r["doc_id"] for r in kept.collect()) == want


def test_keep_one_keeps_texts_that_are_nobodys_copy(spark, words):
    """Unrelated texts under one id are no copies; equal and near ones are."""
    import random

    rng = random.Random(21)
    a, b, c, d = (" ".join(rng.choices(words, k=150)) for _ in range(4))
    rows = [(1, a, "x"), (1, b, "x"), (2, c, "x"), (3, b, "y"), (2, c, "z"), (2, c, "z"), (4, None, "x"), (4, "", "x"),
            (None, d, "x"), (5, d, "x"), (None, None, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, fp string").repartition(4)
    kept = [tuple(r) for r in simhash.keep_one(df).collect()]
    assert sorted((i, t) for i, t, _ in kept if i not in (None, 4)) == sorted([(1, a), (1, b), (2, c), (5, d)])
    assert len([r for r in kept if r[0] == 4]) == 1 and len([r for r in kept if r[0] is None]) == 2
    marks = simhash.near_duplicates(df).collect()
    assert len(marks) == len(rows)


def plain_removed(rows, n=13):
    first = {}
    for i, t in rows:
        w = (t or "").encode().split()
        for k in range(len(w) - n + 1):
            g = tuple(w[k:k + n])
            if i is not None:
                first[g] = min(first.get(g, i), i)
    out = Counter()
    for i, t in rows:
        w = (t or "").encode().split()
        gone = set()
        for k in range(len(w) - n + 1):
            if i is not None and first[tuple(w[k:k + n])] < i:
                gone |= set(range(k, k + n))
        kept = b" ".join(x for k, x in enumerate(w) if k not in gone)
        out[i, len(w), len(gone), hashlib.sha256(kept).hexdigest()] += 1
    return out


def test_substrings_equal_brute_force(awkward, rows):
    for n in (13, 40):  # one level and two levels of doubling
        got = Counter(tuple(r) for r in substrings.remove_repeats(awkward, n).collect())
        assert got == plain_removed(rows, n)


def test_levels_at_most_double():
    for n in range(9, 300):
        steps = substrings.levels(n)
        assert steps[-1] == n and all(b <= 2 * a for a, b in zip(steps, steps[1:], strict=False))


def test_empty_tables(empty):
    assert simhash.near_duplicates(empty).count() == 0
    assert simhash.keep_one(empty).count() == 0
    assert substrings.remove_repeats(empty).count() == 0
