"""Quality rules by distribution divergence.

A document's character-class histogram and its histogram over the common words
of a language are compared with that language's reference distributions by
Jensen-Shannon divergence. References are counts over all documents: character
classes and words by language, the language's most frequent words being its
common ones.
"""

from __future__ import annotations

import json
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from budgetlens.llm.common import map_batches, stored, texts_of

#: Character classes: letter, digit, white space, sentence mark, symbol, upper case, other.
N_CLASSES = 7
SYMBOLS = "#*$%&|<>"
#: Distinct (language, word) pairs a task holds before it hands its counts on.
FLUSH_WORDS = 200_000
#: Languages whose references one pass over the documents of no language carries.
BLOCK_LANGS = 1024


def char_classes(text: str) -> np.ndarray:
    """Counts of the character classes of a text."""
    out = np.zeros(N_CLASSES, np.int64)
    raw = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")
    low = np.bincount(raw[raw < 128], minlength=128)
    out[:] = np.bincount(_ASCII_CLASS, weights=low, minlength=N_CLASSES).astype(np.int64)
    high = Counter(chr(c) for c in raw[raw >= 128].tolist()) if len(raw) != low.sum() else {}
    for ch, n in high.items():
        out[5 if ch.isupper() else 0 if ch.isalpha() else 1 if ch.isdigit()
            else 2 if ch.isspace() else 6] += n
    return out


def _ascii_class(c: int) -> int:
    ch = chr(c)
    if ch.isupper():
        return 5
    if ch.isalpha():
        return 0
    if ch.isdigit():
        return 1
    if ch.isspace():
        return 2
    return 3 if ch in ".,;:!?'\"-()" else 4


_ASCII_CLASS = np.array([_ascii_class(c) for c in range(128)])


def base_features(text: str) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a text."""
    words = text.encode("utf-8", "surrogatepass").split()
    chars = len("".join(w.decode("utf-8", "surrogatepass") for w in words)) if not text.isascii() \
        else sum(map(len, words))
    symbols = sum(map(text.count, SYMBOLS))
    dup = 0
    seen: set[str] = set()
    for line in text.split("\n"):
        if line in seen:
            dup += 1
        elif line.encode("utf-8", "surrogatepass").split():
            seen.add(line)
    n = len(words)
    repeat = 0
    if n >= 4:
        grams = list(zip(words, words[1:], words[2:], strict=False))
        if len(set(grams)) < len(grams):
            counts = Counter(grams)
            hit = np.fromiter((counts[g] > 1 for g in grams), dtype=bool, count=n - 2)
            cover = np.zeros(n, bool)
            for k in range(3):
                cover[k:n - 2 + k] |= hit
            repeat = int(cover.sum())
    return n, chars, symbols, dup, repeat


def divergence(p: np.ndarray, q: np.ndarray) -> float:
    """Jensen-Shannon divergence in bits (0 to 1) of two histograms; 0 if one is empty."""
    if not p.sum() or not q.sum():
        return 0.0
    p, q = p / p.sum(), q / q.sum()
    m = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        a = np.where(p > 0, p * np.log2(p / m), 0).sum()
        b = np.where(q > 0, q * np.log2(q / m), 0).sum()
    return float((a + b) / 2)


def scatter(q: np.ndarray, n: int) -> float:
    """About the divergence that ``n`` draws from the histogram ``q`` have from
    it: an eighth of each bin's relative variance, at most half of its mass."""
    q = q / q.sum()
    return float(np.minimum((1 - q) / (8 * n * np.log(2)), q / 2).sum())


def references(docs: DataFrame, top_words: int = 200, min_words: int = 2000) -> DataFrame:
    """(lang, ref): one row for every language with ``min_words`` words, its
    character-class counts, common words with their counts, and the count of
    all its words as JSON (``Reference`` reads it). Counted in Spark over all
    documents; a null language counts as the empty one."""
    pick = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("lang"),
                       F.col("text"))

    def counts(batch):
        langs, words, classes = batch.column("lang").to_pylist(), defaultdict(Counter), {}
        size = 0
        for lang, text in zip(langs, texts_of(batch), strict=True):
            classes[lang] = classes.get(lang, 0) + char_classes(text)
            c = words[lang]
            size -= len(c)
            c.update(text.lower().encode("utf-8", "surrogatepass").split())
            size += len(c)
            if size > FLUSH_WORDS:
                yield _rows(words, {})
                words, size = defaultdict(Counter), 0
        yield _rows(words, classes)

    def _rows(words, classes):
        rows = [(lang, "w", w.decode("utf-8", "replace"), n) for lang, c in words.items() for w, n in c.items()]
        rows += [(lang, "c", str(k), int(n)) for lang, c in classes.items() for k, n in enumerate(c)]
        a, b, c, d = zip(*rows, strict=True) if rows else ((), (), (), ())
        return {"lang": a, "kind": b, "item": c, "n": d}

    total = map_batches(pick, counts, "lang string, kind string, item string, n long") \
        .groupBy("lang", "kind", "item").agg(F.sum("n").alias("n"))
    # Per language: the sum of all its words, its classes, and its commonest
    # words by a bounded top-k per task before the ranks are taken.
    spread = total.withColumn("part", F.pmod(F.xxhash64("item"), F.lit(64)))
    local = Window.partitionBy("lang", "kind", "part").orderBy(F.desc("n"), "item")
    ranked = spread.withColumn("r", F.row_number().over(local)) \
        .withColumn("part_n", F.sum("n").over(Window.partitionBy("lang", "kind", "part"))) \
        .filter(F.col("r") <= top_words)
    last = Window.partitionBy("lang", "kind").orderBy(F.desc("n"), "item")
    final = ranked.withColumn("rank", F.row_number().over(last)) \
        .withColumn("all_n", F.sum(F.when(F.col("r") == 1, F.col("part_n"))).over(
            Window.partitionBy("lang", "kind"))) \
        .filter(F.col("rank") <= top_words) \
        .filter((F.col("kind") == "c") | (F.col("all_n") >= min_words))
    # A row a language and common word; written, so that it is counted once.
    final = stored(final.select("lang", "kind", "item", "n", "rank", "all_n"), "references")
    of_kind = lambda k: F.sort_array(F.collect_list(  # noqa: E731  (top_words or classes at most)
        F.when(F.col("kind") == k, F.struct("rank", "item", "n"))))
    rows = final.groupBy("lang").agg(
        of_kind("c").alias("classes"), of_kind("w").alias("words"),
        F.max(F.when(F.col("kind") == "w", F.col("all_n"))).alias("size")).filter("size is not null")
    return stored(rows.select("lang", F.to_json(F.struct("classes", "words", "size")).alias("ref")), "reference-rows")


class Reference:
    """A language's class counts, common words (rank by word), and their counts
    with the rest as a last entry."""

    def __init__(self, ref: str):
        made = json.loads(ref)
        self.classes = np.zeros(N_CLASSES, np.int64)
        for r in made["classes"]:
            self.classes[int(r["item"])] = r["n"]
        self.ranks = {r["item"].encode("utf-8"): k for k, r in enumerate(made["words"])}
        n = [r["n"] for r in made["words"]]
        self.words = np.array([*n, max(0, made["size"] - sum(n))])


def closest(text: str, n: int, refs: list[Reference]) -> tuple[float, float, float, float]:
    """Least sum of the class and word divergences of a text of ``n`` words from
    the references, both, and the part of the latter that scatter gives."""
    classes = char_classes(text)
    counts = Counter(text.lower().encode("utf-8", "surrogatepass").split())
    best = (3.0, 0.0, 0.0, 0.0)
    for ref in refs:
        seen = np.zeros(len(ref.words))
        for w, r in ref.ranks.items():
            seen[r] = counts.get(w, 0)
        seen[-1] = n - seen.sum()
        a, b = divergence(classes, ref.classes), divergence(seen, ref.words)
        best = min(best, (a + b, a, b, scatter(ref.words, n)))
    return best


def without_language(docs: DataFrame, refs: DataFrame, min_words: int) -> DataFrame:
    """(doc_id, text, best): documents of no language with what ``closest`` gives
    over all references, which go round in blocks of ``BLOCK_LANGS``."""
    schema = "doc_id long, text string, best array<double>"
    out = docs.select("doc_id", "text", F.lit(None).cast("array<double>").alias("best"))
    if docs.isEmpty():
        return out
    blocks = -(-refs.count() // BLOCK_LANGS)
    for k in range(blocks):
        block = [r["ref"] for r in refs.filter(F.pmod(F.xxhash64("lang"), F.lit(blocks)) == k).collect()]

        def run(batch, block=block):
            made, found = [Reference(r) for r in block], []
            for text, best in zip(texts_of(batch), batch.column("best").to_pylist(), strict=True):
                n = len(text.encode("utf-8", "surrogatepass").split())
                if n >= min_words and made:
                    best = min(tuple(best or (3.0, 0.0, 0.0, 0.0)), closest(text, n, made))
                found.append(best)
            return {"doc_id": batch.column("doc_id"), "text": batch.column("text"), "best": found}

        out = map_batches(out, run, schema)
    return out


def judge(docs: DataFrame, min_words: int = 50, max_class_divergence: float = 0.03,
          max_word_divergence: float = 0.15, class_noise: float = 2.0, top_words: int = 200) -> DataFrame:
    """One row per document: base features, verdict and the divergences.

    ``base_failed``: fewer than ``min_words`` words, or more than half of the
    words in repeated three-word windows. The divergence test is the method's:
    a document with at least ``min_words`` words is compared with its
    language's references (the closest ones of all if its language is null) and
    kept when both divergences are within their limits. The histogram
    of a short text scatters about its source's, so the limits grow by what
    scatter alone gives: for classes ``class_noise`` / n_words, for words the
    expected divergence of n_words draws from the reference itself.

    Defined cases: a null text counts as empty (all features 0, base failed);
    rows come back as often as they occur; a language with too few words for a
    reference is undecided, and nothing of it diverges; null ids stay null; other columns
    are not read.
    """
    refs = references(docs, top_words)
    pick = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"),
                       F.col("text").alias("text"))
    # Catalyst broadcasts the references or deals both sides by language, where
    # AQE splits a hot one.
    own = pick.filter("lang is not null").join(refs, "lang", "left").select(
        "doc_id", "text", "ref", F.lit(None).cast("array<double>").alias("best"))
    none = without_language(pick.filter("lang is null"), refs, min_words).select(
        "doc_id", "text", F.lit(None).cast("string").alias("ref"), "best")

    def run(batch):
        out, made = [], {}
        column = batch.column("ref").dictionary_encode()
        kinds, which = column.dictionary.to_pylist(), column.indices.to_pylist()
        for text, k, best in zip(texts_of(batch), which, batch.column("best").to_pylist(), strict=True):
            f = base_features(text)
            failed = f[0] < min_words or 100 * f[4] > 50 * f[0]
            if f[0] >= min_words and k is not None:
                if k not in made:
                    made[k] = Reference(kinds[k])
                best = closest(text, f[0], [made[k]])
            _, a, b, by_chance = best or (0.0, 0.0, 0.0, 0.0)
            kept = (not failed and a <= max_class_divergence + class_noise / max(1, f[0])
                    and b <= max_word_divergence + by_chance)
            out.append((*f, failed, kept, a, b))
        names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                 "base_failed", "kept", "class_divergence", "word_divergence")
        return {"doc_id": batch.column("doc_id")} | dict(zip(names, zip(*out, strict=True), strict=True))

    return map_batches(own.unionByName(none), run, "doc_id long, n_words long, word_chars long, n_symbols long, "
                       "n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, "
                       "class_divergence double, word_divergence double")
