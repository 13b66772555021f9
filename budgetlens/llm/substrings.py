"""Substring dedup by level-wise doubling.

Windows of a short length that occur in two documents are found first; only
where they occur are windows of up to twice that length tried, and so on until
the wanted length is reached or no candidate survives. At the first, shortest
level not every window is needed: of the short windows inside a longer one the
one with the smallest hash is taken (two equal longer windows take the same one),
which leaves about a quarter of all positions to shuffle. From then on windows
carry 128-bit hashes.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from budgetlens.llm.common import (
    WordHashes, chunks, map_batches, signed, stored, texts_of, window_hashes)

#: Multiplier of the second window hash.
BASE2 = 0xC2B2AE3D27D4EB4F
#: A first level has at least this many words.
SHORTEST = 5


def levels(window: int) -> list[int]:
    """Window lengths from the shortest level to the wanted one, each at most
    twice the one before."""
    out = [window]
    while (half := -(-out[0] // 2)) >= SHORTEST:
        out.insert(0, half)
    return out


def selected(h: np.ndarray, short: int, long: int) -> np.ndarray:
    """For every window of ``long`` words the smallest hash among its short
    windows, by minima over spans that double."""
    low, span, want = window_hashes(h, short), 1, long - short + 1
    while span < want and len(low):
        step = min(span, want - span)
        low = np.minimum(low[:-step], low[step:]) if len(low) > step else low[:0]
        span += step
    return low


def _whole(starts: np.ndarray, at: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The positions of which a window of ``width`` stays in its document, and that document."""
    doc = np.searchsorted(starts, at, side="right") - 1
    ok = at + width <= starts[doc + 1]
    return at[ok], doc[ok]


def marks(pick: DataFrame) -> DataFrame:
    """(doc_id, key, n_words, sha): ``key`` stands for the word sequence."""
    def run(batch):
        keys, sizes, shas = [], [], []
        for t in texts_of(batch):
            w = t.encode("utf-8", "surrogatepass").split()
            d = hashlib.sha256(b" ".join(w))
            keys.append(int.from_bytes(d.digest()[:8], "big", signed=True))
            sizes.append(len(w))
            shas.append(d.hexdigest())
        return {"doc_id": batch.column("doc_id"), "key": keys, "n_words": sizes, "sha": shas}

    return map_batches(pick, run, "doc_id long, key long, n_words long, sha string")


def anchors(pick: DataFrame, short: int, long: int) -> DataFrame:
    """(a, doc_id): the chosen short windows of every document."""
    def run(batch):
        ids, hashes = _ids(batch), WordHashes()
        for begin, texts in chunks(texts_of(batch)):
            h, starts = hashes.of_texts(texts)
            at, doc = _whole(starts, np.arange(max(0, len(h) - long + 1)), long)
            if len(at):
                a = selected(h, short, long)[at]
                # Neighbours mostly choose the same short window.
                new = np.concatenate(([True], (doc[1:] != doc[:-1]) | (a[1:] != a[:-1])))
                yield {"a": signed(a[new]), "doc_id": ids[begin + doc[new]]}

    return map_batches(pick, run, "a long, doc_id long")


def first_windows(texts: DataFrame, short: int, long: int) -> DataFrame:
    """(h1, h2, doc_id, key, pos): windows of ``long`` words whose chosen short
    window is one of the document's ``alive`` hashes."""
    def run(batch):
        ids, keys, hashes = _ids(batch), batch.column("key").to_numpy(), WordHashes()
        alive, offset = _lists(batch)
        for begin, texts in chunks(texts_of(batch)):
            h, starts = hashes.of_texts(texts)
            at, doc = _whole(starts, np.arange(max(0, len(h) - long + 1)), long)
            if not len(at):
                continue
            a = signed(selected(h, short, long)[at])
            keep = np.zeros(len(at), bool)
            edge = np.searchsorted(doc, np.arange(len(texts) + 1)).tolist()
            for d in range(len(texts)):
                known = alive[offset[begin + d]:offset[begin + d + 1]]
                keep[edge[d]:edge[d + 1]] = np.isin(a[edge[d]:edge[d + 1]], known)
            yield _windows(h, long, at[keep], begin + doc[keep], at[keep] - starts[doc[keep]], ids, keys)

    return map_batches(texts, run, "h1 long, h2 long, doc_id long, key long, pos int")


def next_windows(texts: DataFrame, short: int, long: int) -> DataFrame:
    """As first_windows, but from the ``alive`` positions of repeated windows of
    ``short`` words: both ends of the longer window must be repeated."""
    def run(batch):
        ids, keys, hashes = _ids(batch), batch.column("key").to_numpy(), WordHashes()
        alive, offset = _lists(batch)
        for begin, texts in chunks(texts_of(batch)):
            h, starts = hashes.of_texts(texts)
            on = np.zeros(len(h) + long, bool)
            for d in range(len(texts)):
                on[starts[d] + alive[offset[begin + d]:offset[begin + d + 1]]] = True
            at = np.nonzero(on[:len(h)] & on[long - short:long - short + len(h)])[0]
            at, doc = _whole(starts, at, long)
            if len(at):
                yield _windows(h, long, at, begin + doc, at - starts[doc], ids, keys)

    return map_batches(texts, run, "h1 long, h2 long, doc_id long, key long, pos int")


def _ids(batch) -> np.ndarray:
    return batch.column("doc_id").to_numpy(zero_copy_only=False)


def _lists(batch) -> tuple[np.ndarray, np.ndarray]:
    """Values and offsets of the ``alive`` lists."""
    lists = batch.column("alive")
    return lists.values.to_numpy(), lists.offsets.to_numpy()


def _windows(h, width, at, row, place, ids, keys) -> dict:
    return {"h1": signed(window_hashes(h, width)[at]), "h2": signed(window_hashes(h, width, BASE2)[at]),
            "doc_id": ids[row], "key": keys[row], "pos": place.astype(np.int32)}


def repeated(windows: DataFrame) -> DataFrame:
    """(h1, h2, first): windows that start in two documents, and the smallest of those.
    Reduced before the shuffle, so a passage that very many documents share is
    one row a task."""
    return (windows.groupBy("h1", "h2").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"))
            .filter("first < last").select("h1", "h2", "first"))


def remove_repeats(docs: DataFrame, window: int = 13) -> DataFrame:
    """One row per document: (doc_id, n_words, n_removed, kept_sha256). A word
    is removed if a window of ``window`` words covers it whose word sequence
    also starts in a document with a smaller id.

    Defined cases: a null text has no words; a null id is neither smaller nor
    larger than any other, so such a row keeps its words and takes none from
    others; rows that share an id are judged one by one and take nothing from
    each other; repeated rows come back as often as they occur; documents
    shorter than a window keep everything; other columns are not read.
    """
    steps = levels(window)
    pick = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text"))
    named = pick.filter("doc_id is not null")
    all_marks = stored(marks(pick), "marks")

    # Whole copies of a document with a smaller id lose every word at once.
    firsts = all_marks.filter("doc_id is not null").groupBy("key", "sha").agg(F.min("doc_id").alias("first_id"))
    copied = F.coalesce((F.col("doc_id") > F.col("first_id")) & (F.col("n_words") >= window), F.lit(False))
    all_marks = stored(all_marks.join(firsts, ["key", "sha"], "left").withColumn("copied", copied)
                       .drop("first_id"), "marks")
    single = all_marks.filter("doc_id is not null and not copied").select("doc_id").distinct()

    if len(steps) == 1:
        raise ValueError(f"window must be at least {2 * SHORTEST - 1} words")
    spread = anchors(named, steps[0], steps[1])
    shared = stored(spread.groupBy("a").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"))
                    .filter("lo < hi").select("a"), "shared")
    alive = stored(spread.join(shared, "a", "left_semi").groupBy("doc_id")
                   .agg(F.collect_set("a").alias("alive")), "alive")  # bounded by the document
    texts = stored(_with_key(named.join(alive.join(single, "doc_id", "left_semi"), "doc_id")), "texts")
    make = first_windows
    for short, long in zip(steps, steps[1:], strict=False):
        windows = make(texts, short, long)
        found = stored(repeated(windows), "repeated")
        met = windows.join(found, ["h1", "h2"])
        if long == window:
            met = met.filter("doc_id > first")
        alive = stored(met.groupBy("doc_id", "key").agg(F.collect_set("pos").alias("alive")), "alive")
        texts = texts.drop("alive").join(alive, ["doc_id", "key"])
        if long < window:
            texts, make = stored(texts, "texts"), next_windows

    cut = _cut(texts, window)
    empty = hashlib.sha256(b"").hexdigest()
    return all_marks.join(cut.dropDuplicates(["doc_id", "key"]), ["doc_id", "key"], "left").select(
        "doc_id", "n_words",
        F.when(F.col("copied"), F.col("n_words")).otherwise(F.coalesce("removed", F.lit(0))).alias("n_removed"),
        F.when(F.col("copied"), F.lit(empty)).otherwise(F.coalesce("kept", F.col("sha"))).alias("kept_sha256"))


def _with_key(texts: DataFrame) -> DataFrame:
    """doc_id, text and alive with the key that marks() gives the word sequence."""
    def run(batch):
        keys = [int.from_bytes(hashlib.sha256(b" ".join(t.encode("utf-8", "surrogatepass").split())).digest()[:8],
                               "big", signed=True) for t in texts_of(batch)]
        return {"doc_id": batch.column("doc_id"), "key": keys, "text": batch.column("text"),
                "alive": batch.column("alive")}

    return map_batches(texts.select("doc_id", "text", "alive"), run,
                       "doc_id long, key long, text string, alive array<long>")


def _cut(texts: DataFrame, window: int) -> DataFrame:
    """(doc_id, key, removed, kept): words that the windows at ``alive`` cover are out."""
    def run(batch):
        removed, kept = [], []
        for t, pos in zip(texts_of(batch), batch.column("alive"), strict=True):
            words = t.encode("utf-8", "surrogatepass").split()
            edge = np.zeros(len(words) + 1, np.int32)
            at = pos.values.to_numpy()
            np.add.at(edge, at, 1)
            np.add.at(edge, at + window, -1)
            out = np.cumsum(edge[:-1]) > 0
            removed.append(int(out.sum()))
            kept.append(hashlib.sha256(b" ".join(w for w, o in zip(words, out.tolist(), strict=True) if not o)).hexdigest())
        return {"doc_id": batch.column("doc_id"), "key": batch.column("key"), "removed": removed, "kept": kept}

    return map_batches(texts, run, "doc_id long, key long, removed long, kept string")
