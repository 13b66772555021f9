"""Spelling variants against brute force over all pairs of words."""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from budgetlens.llm import spelling
from budgetlens.llm.common import mixed

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_words(rows, min_length, min_count):
    out = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(UPPER)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            out[run[:h % len(run)] + run[h % len(run) + 1:] if h % 97 == 0 else run] += 1
    return {w: n for w, n in out.items() if len(w) >= min_length and n >= min_count}


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:k] + b[k + 1:] == a for k in range(len(b)))


def plain(rows, min_length=5, min_count=3, factor=2):
    n = plain_words(rows, min_length, min_count)
    form, count = {}, {}
    for w in n:
        some = [v for v in n if near(w, v)]
        best = min(some, key=lambda v: (-n[v], v), default=None)
        count[w] = len(some)
        form[w] = best if best and n[best] >= factor * n[w] else None
    out = {}
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out[w] = (form[w], root, n[w], count[w], n[form[w]] if form[w] else None)
    return out


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(12)
    stems = ["".join(rng.choices("abcde", k=rng.randint(4, 7))) for _ in range(60)] + ["éàüß", "aaaaa", "ÀBÇDÉ", "x" * 300]

    def word():
        w = rng.choice(stems)
        for _ in range(rng.choice([0, 0, 1, 1, 2])):
            k = rng.randrange(len(w))
            w = rng.choice([w[:k] + w[k + 1:], w[:k] + rng.choice("abcdeé÷") + w[k:], w[:k] + rng.choice("abcdeß") + w[k + 1:]])
        return w.upper() if rng.random() < 0.1 else w
    rows = [(i, " ".join(word() + rng.choice(["", "", ".", "-", "9"]) for _ in range(rng.randint(1, 120))))
            for i in range(120)]
    rows += [(None, rows[0][1]), (500, None), (501, ""), (502, " 12 \n"), rows[1], rows[1], (503, rows[2][1] * 60)]
    df = spark.createDataFrame([(*r, "w", 1) for r in rows], "doc_id long, text string, word string, n int")
    return df.repartition(5), rows


@pytest.mark.parametrize("filter_bytes", [16 << 20, 64])
def test_variants_equal_all_pairs(corpus, filter_bytes):
    df, rows = corpus
    want = plain(rows)
    got = spelling.variants(df, filter_bytes=filter_bytes).collect()
    assert len(got) == len(want) > 200
    assert {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in got} == want
    assert max(v[3] for v in want.values()) > 8 and any(v[1] not in (v[0], w) for w, v in want.items())


def test_edits_are_the_neighbours_from_one_side():
    rng = np.random.default_rng(1)
    words = sorted({"".join(rng.choice(list("abc"), rng.integers(3, 6))) for _ in range(150)})
    counts = Counter(map(len, words))
    shards = spelling.Shards(counts, 1 << 10)
    filters = {(n, 0): np.full(shards.size[n][1], 2**64 - 1, np.uint64) for n in counts}  # let all through
    probe = spelling.Probe(shards, filters, np.array([97, 98, 99], np.uint8))
    for length, at, codes in spelling.by_length(words):
        for k, w in zip(at.tolist(), codes, strict=True):
            made = [(words[k][:p] + (chr(c) if c >= 0 else "") + words[k][p + 1:])
                    for _, place, new in probe.edits(w[None], set(counts)) for p, c in zip(place.tolist(), new.tolist(), strict=True)]
            assert len(made) == len(set(made))
            longer = {w2 for w2 in words if near(words[k], w2) and (len(w2) < length or len(w2) == length and
                                                                   w2 > words[k])}
            assert longer <= set(made) and all(near(words[k], m) for m in made)


def test_edit_hashes_are_those_of_the_words():
    probe_codes = spelling.letters(["abcde", "éaßzz"], 5)
    shards = spelling.Shards({5: 10, 4: 10}, 1 << 20)
    for word in ("abce", "aßzz"):
        h = mixed(spelling.hashes(spelling.letters([word], 4)))
        part, block, mask = shards.place(4, h)
        bits = np.zeros(shards.size[4][1], np.uint64)
        bits[block] |= mask
        probe = spelling.Probe(shards, {(4, 0): bits}, np.array([97], np.uint8))
        made = [(int(r), int(p)) for row, place, _ in probe.edits(probe_codes, {4}) for r, p in zip(row, place, strict=True)]
        assert made == [(0, 3) if word == "abce" else (1, 0)]


def test_no_words(spark, empty):
    assert spelling.variants(empty).collect() == []
    few = spark.createDataFrame([(1, "alpha beta"), (2, None)], "doc_id long, text string")
    assert spelling.variants(few).collect() == []
    one = spark.createDataFrame([(1, "alpha alpha alpha"), (2, "bb bb bb")], "doc_id long, text string")
    assert [tuple(r) for r in spelling.variants(one).collect()] == [("alpha", None, "alpha", 3, 0, None)]
