"""Spelling variants by Bloom-guided neighbourhoods.

Words of the corpus that differ by one inserted, deleted or replaced code point
are near. Every word generates its edits and probes them against blocked Bloom
filters of the vocabulary, one for each word length, which are broadcast; only
edits that a filter lets through are shuffled, to an exact join with the
vocabulary that removes the false positives. An insertion in the shorter word is
a deletion in the longer one, and a replacement by a larger code point is one by
a smaller one in the other word, so each pair is generated once, from one side.

A filter is sized by the number of its words. Filters go out in passes of at
most ``filter_bytes``; a length whose filter would be larger is cut into slices
by word hash, so that the broadcast is bounded however large the vocabulary is.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from budgetlens.llm.common import each_text, in_arrow, map_batches, mixed, release, stored

#: Maximal runs of these code points are words; all of them fit into one byte.
RUN = re.compile("[A-Za-zÀ-ÿ]+")
#: Distinct words that a task counts before it hands its counts on.
FLUSH_WORDS = 100_000
#: Edits that are probed at once.
BLOCK_EDITS = 1 << 19
#: Bits of a filter for each word, and bits that a word sets in its block of 64.
BITS_PER_WORD, PROBES = 16, 4
#: Pseudo-random value of each code point, and the multiplier of the word hash.
VALUE = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
STEP = 0xD1342543DE82EF95


def lowered(text: str) -> str:
    """A-Z in lower case, everything else as it is."""
    return text.lower() if text.isascii() else text.encode("utf-8", "surrogatepass").lower().decode(
        "utf-8", "surrogatepass")


def words_of(text: str, doc_id, rare: int = 97) -> Counter:
    """Counts of the text's words: its lower-cased runs, of which one code point
    is deleted where ``rare`` divides the crc32 of ``<doc_id>:<run>``."""
    begin = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
    out: Counter = Counter()
    for run, n in Counter(RUN.findall(lowered(text))).items():
        h = zlib.crc32(run.encode(), begin)
        if h % rare == 0:
            k = h % len(run)
            run = run[:k] + run[k + 1:]
        out[run] += n
    return out


def vocabulary(docs: DataFrame, min_length: int = 5, min_count: int = 3, rare: int = 97) -> DataFrame:
    """(word, n): the words of at least ``min_length`` code points and ``min_count`` occurrences."""
    pick = docs.select(F.col("doc_id").alias("doc_id"), F.col("text").alias("text")).filter("text is not null")

    def count(batches):
        seen: Counter = Counter()
        for batch in batches:
            for i, text in zip(batch.column("doc_id").to_pylist(), each_text(batch), strict=True):
                for w, n in words_of(text, i, rare).items():
                    if len(w) >= min_length:
                        seen[w] += n
                if len(seen) > FLUSH_WORDS:
                    yield _counts(seen)
                    seen = Counter()
        if seen:
            yield _counts(seen)

    return (in_arrow(pick, count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
            .filter(F.col("n") >= min_count))


def _counts(seen: Counter) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())],
                                      ["word", "n"])


def letters(words: list[str], length: int) -> np.ndarray:
    """Code points of words of one length, a row each."""
    return np.frombuffer("".join(words).encode("latin-1"), np.uint8).reshape(len(words), length)


def powers(length: int) -> np.ndarray:
    out = np.full(length + 1, STEP, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def hashes(codes: np.ndarray) -> np.ndarray:
    """Polynomial hash of each row of code points, before the finaliser."""
    return (VALUE[codes] * powers(codes.shape[1])[:-1]).sum(axis=1, dtype=np.uint64)


class Shards:
    """Sizes of the filters: for each length its slices and the blocks of a slice."""

    def __init__(self, counts: dict[int, int], filter_bytes: int):
        most = max(1, filter_bytes // 8)
        self.size = {}
        for length, n in counts.items():
            blocks = n * BITS_PER_WORD // 64 + 1
            slices = math.ceil(blocks / most)
            self.size[length] = (slices, math.ceil(blocks / slices))

    def place(self, length: int, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(slice, block, mask) of finished hashes of words of a length."""
        slices, blocks = self.size[length]
        part = (h >> np.uint64(40)) % np.uint64(slices) if slices > 1 else np.zeros(h.shape, np.uint64)
        block = ((h >> np.uint64(32)) * np.uint64(0x9E3779B1) & np.uint64(0xFFFFFFFF)) * np.uint64(blocks) >> np.uint64(32)
        mask = np.zeros(h.shape, np.uint64)
        for k in range(PROBES):
            mask |= np.uint64(1) << (h >> np.uint64(6 * k) & np.uint64(63))
        return part, block, mask

    def passes(self, filter_bytes: int) -> list[list[tuple[int, int]]]:
        """The (length, slice) shards, put together so that a pass has at most
        ``filter_bytes`` (one shard alone has no more)."""
        out: list[list[tuple[int, int]]] = []
        room = 0
        for length in sorted(self.size):
            slices, blocks = self.size[length]
            for s in range(slices):
                if not out or 8 * blocks > room:
                    out.append([])
                    room = filter_bytes
                out[-1].append((length, s))
                room -= 8 * blocks
        return out


def by_length(words: list[str]):
    """(length, places, code points) of the words, together by length."""
    size = np.array([len(w) for w in words])
    order = np.argsort(size, kind="stable")
    edge = np.nonzero(np.diff(size[order], prepend=-1))[0].tolist() + [len(order)]
    for a, b in zip(edge, edge[1:], strict=False):
        at = order[a:b]
        length = int(size[at[0]])
        yield length, at, letters([words[i] for i in at], length)


def filter_blocks(words: DataFrame, shards: Shards) -> DataFrame:
    """(length, slice, block, bits): the filters' blocks that are not empty."""
    def run(batch):
        out: dict = {k: [] for k in ("length", "slice", "block", "mask")}
        for length, _, codes in by_length(batch.column("word").to_pylist()):
            part, block, mask = shards.place(length, mixed(hashes(codes)))
            for k, v in (("length", np.full(len(codes), length)), ("slice", part), ("block", block), ("mask", mask)):
                out[k].append(v.astype(np.uint64).view(np.int64))
        return {k: np.concatenate(v) for k, v in out.items()}

    return (map_batches(words.select("word"), run, "length long, slice long, block long, mask long")
            .groupBy("length", "slice", "block").agg(F.expr("bit_or(mask)").alias("bits")))


class Probe:
    """The filters of one pass and the alphabet from which edits are made."""

    def __init__(self, shards: Shards, filters: dict[tuple[int, int], np.ndarray], alphabet: np.ndarray):
        self.shards, self.filters, self.alphabet = shards, filters, alphabet

    def hits(self, length: int, h: np.ndarray) -> np.ndarray:
        """Which of the edits of a length the filters let through."""
        out = np.zeros(h.shape, bool)
        here = [s for n, s in self.filters if n == length]
        if here:
            part, block, mask = self.shards.place(length, mixed(h))
            for s in here:
                bits = self.filters[length, s]
                own = (bits[block] & mask) == mask
                out |= own & (part == np.uint64(s))
        return out

    def edits(self, codes: np.ndarray, wanted: set[int]):
        """(row, position, code point or -1) of the edits of words of one length that
        pass: deletions of one of a run of equal letters, replacements by larger letters."""
        m, length = codes.shape
        power = powers(length)
        value = VALUE[codes] * power[:-1]
        whole = value.sum(axis=1, dtype=np.uint64)
        if length - 1 in wanted:
            before = np.cumsum(value, axis=1, dtype=np.uint64) - value
            after = (whole[:, None] - before - value) * np.uint64(pow(STEP, -1, 1 << 64))
            first = np.ones(codes.shape, bool)
            first[:, 1:] = codes[:, 1:] != codes[:, :-1]
            row, at = np.nonzero(self.hits(length - 1, before + after) & first)
            yield row, at, np.full(len(row), -1)
        if length in wanted:
            letter = VALUE[self.alphabet]
            wide = max(1, BLOCK_EDITS // (m * len(letter)))
            for a in range(0, length, wide):
                part = codes[:, a:a + wide]
                rest = whole[:, None] - value[:, a:a + wide]
                h = rest[:, :, None] + letter * power[a:a + wide][:part.shape[1], None][None]
                row, at, new = np.nonzero(self.hits(length, h) & (self.alphabet > part[:, :, None]))
                yield row, at + a, self.alphabet[new].astype(np.int64)


def candidates(words: DataFrame, sent) -> DataFrame:
    """(word, n, edit): the edits of the words that the filters of the broadcast
    ``Probe`` let through."""
    def run(batch):
        probe = sent.value
        wanted = {length for length, _ in probe.filters}
        every, n = batch.column("word").to_pylist(), batch.column("n").to_numpy()
        for length, at, codes in by_length(every):
            if not wanted & {length, length - 1}:
                continue
            rows = max(1, BLOCK_EDITS // (length * len(probe.alphabet)))
            for k in range(0, len(at), rows):
                some = at[k:k + rows]
                for row, place, new in probe.edits(codes[k:k + rows], wanted):
                    src = some[row]
                    made = [w[:p] + (chr(c) if c >= 0 else "") + w[p + 1:] for w, p, c in
                            zip([every[i] for i in src], place.tolist(), new.tolist(), strict=True)]
                    if made:
                        yield {"word": [every[i] for i in src], "n": n[src], "edit": made}

    return map_batches(words, run, "word string, n long, edit string")


def near_pairs(words: DataFrame, filter_bytes: int = 16 << 20) -> DataFrame:
    """(word, near, near_n): both directions of every pair of near words of (word, n)."""
    spark = words.sparkSession
    counts = {r["l"]: r["count"] for r in words.groupBy(F.length("word").alias("l")).count().collect()}
    # Words are made of 90 code points at most.
    alphabet = np.array(sorted(ord(r["c"]) for r in words.select(F.explode(F.split("word", "")).alias("c"))
                               .filter("c <> ''").distinct().collect()), np.uint8)
    shards = Shards(counts, filter_bytes)
    out = None
    passes = shards.passes(filter_bytes)
    blocks = stored(filter_blocks(words, shards), "filters") if passes else None
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    for some in passes:
        lengths = sorted({length for length, _ in some})
        filters = {(length, s): np.zeros(shards.size[length][1], np.uint64) for length, s in some}
        inside = F.struct("length", "slice").isin([F.struct(F.lit(a).cast("long"), F.lit(b).cast("long")) for a, b in some])
        got = blocks.filter(inside).toArrow()  # filter_bytes bounds its rows
        where, bits = (got.column(c).to_numpy() for c in ("block", "bits"))
        key = got.column("length").to_numpy() * (1 << 32) + got.column("slice").to_numpy()
        for length, s in some:
            own = key == (length << 32) + s
            filters[length, s][where[own]] = bits[own].view(np.uint64)
        sent = spark.sparkContext.broadcast(Probe(shards, filters, alphabet))
        # The vocabulary is small beside its edits: all cores share it.
        part = words.filter(F.length("word").isin(lengths + [n + 1 for n in lengths])).repartition(tasks, F.xxhash64("word"))
        found = candidates(part, sent)
        exact = found.join(words.select(F.col("word").alias("edit"), F.col("n").alias("edit_n")), "edit")
        both = stored(exact.select(F.explode(F.array(
            F.struct("word", F.col("edit").alias("near"), F.col("edit_n").alias("near_n")),
            F.struct(F.col("edit").alias("word"), F.col("word").alias("near"), F.col("n").alias("near_n")))).alias("p"))
            .select("p.*"), "near")
        out = both if out is None else out.unionAll(both)
    return out if out is not None else words.limit(0).select(
        "word", F.col("word").alias("near"), F.col("n").alias("near_n"))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) for the words of (word, form): the end of the chain of forms.
    A form occurs at least twice as often as its word, so a chain has some forty
    links at most; every round doubles the links that are followed."""
    cur = stored(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        further = cur.select(F.col("word").alias("at"), F.col("root").alias("next"))
        new = stored(cur.join(further, F.col("root") == F.col("at"), "left")
                     .select("word", F.coalesce("next", "root").alias("root"),
                             F.col("next").isNotNull().alias("moved")), "roots")
        cur = new.drop("moved")
        if new.filter("moved").isEmpty():
            return cur


def variants(docs: DataFrame, min_length: int = 5, min_count: int = 3, factor: int = 2, rare: int = 97,
             filter_bytes: int = 16 << 20) -> DataFrame:
    """One row per word: (word, form, root, n, n_near, form_n).

    ``form``: the near word of largest n (of ties the smallest in code-point
    order) if that n is at least ``factor`` times the word's; ``root``: the last
    word that forms lead to. ``filter_bytes`` bounds what a pass broadcasts.

    Defined cases: a null text has no words; a null id counts as the empty text
    in the hash that picks runs to change; repeated rows count as often as they
    occur; a text of any length is read whole, a word of any length has its
    edits probed in blocks; an empty table gives an empty result; other columns
    are not read.
    """
    words = stored(vocabulary(docs, min_length, min_count, rare), "vocabulary")
    best = near_pairs(words, filter_bytes).groupBy("word").agg(
        F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("m"), "near")).alias("best"))
    rows = stored(words.join(best, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(-F.col("best.m") >= factor * F.col("n"), F.col("best")).alias("best")), "variants")
    rows = rows.select("word", "n", "n_near", F.col("best.near").alias("form"), (-F.col("best.m")).alias("form_n"))
    ends = roots(rows.filter("form is not null"))
    release(docs.sparkSession)
    return rows.join(ends, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
