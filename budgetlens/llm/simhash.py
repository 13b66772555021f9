"""SimHash near-duplicates through multi-index hashing.

Fingerprints are 64-bit SimHashes of word shingles. The 64 bits are cut into
segments, four by default. Two fingerprints that differ in two bits at most
agree in two whole segments at least, so there is one table for each pair of
segments, keyed by their values: a fingerprint has six entries, and is found by
all its neighbours in one of them (radius zero in both segments). The members
of a bucket are compared by their complete distances.

A large group of near copies agrees in many bits and crowds into few buckets.
Fingerprints in a bucket of more than ``crowd`` members are indexed anew, by
the Hamming ball of radius one within each segment, the other segments
unchanged: two neighbours meet half way, and such an entry holds 65
fingerprints at most. No pairs of a crowd are listed: an entry's members are
linked to its smallest.
"""

from __future__ import annotations

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from budgetlens.llm.common import each_text, map_batches, signed, stored
from budgetlens.llm.graph import components

BITS = 64


def fingerprint(text: str, shingle: int = 3, seed: int = 42) -> int:
    """SimHash of the text's word shingles: A-Z lower-cased, words separated by
    ASCII white space, a text of fewer words is one shingle, none gives 0."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    n = max(1, len(words) - shingle + 1)
    ends = np.cumsum([len(w) + 1 for w in words])
    first = np.concatenate(([0], ends[:n - 1])).tolist()
    last = (ends[-n:] - 1).tolist()
    digest = xxhash.xxh64_intdigest
    h = np.fromiter((digest(joined[a:b], seed) for a, b in zip(first, last, strict=True)),
                    dtype=np.uint64, count=n)
    ones = np.zeros(BITS, np.int64)
    for k in range(0, n, 1 << 16):
        part = h[k:k + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = (2 * ones > n).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 shingle: int = 3) -> DataFrame:
    """(doc_id, fp, text_hash): one row per input row; a null text has
    fingerprint 0; ``text_hash`` tells texts under one id apart."""
    pick = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"),
                       _text_hash(text_col).alias("text_hash"))

    def run(batch):
        made = np.array([fingerprint(t, shingle) for t in each_text(batch)], dtype=np.uint64)
        return {"doc_id": batch.column("doc_id"), "fp": signed(made), "text_hash": batch.column("text_hash")}

    return map_batches(pick, run, "doc_id long, fp long, text_hash long", bounded=True)


def _text_hash(text_col: str):
    """A null text, which has the empty one's fingerprint, hashes like it."""
    return F.xxhash64(F.coalesce(F.col(text_col).cast("string"), F.lit("")))


def segment_masks(segments: int) -> list[int]:
    """The bits of each segment, as signed longs."""
    cuts = [BITS * k // segments for k in range(segments + 1)]
    return [_signed((1 << b) - (1 << a)) for a, b in zip(cuts, cuts[1:], strict=False)]


def _signed(bits: int) -> int:
    return bits if bits < 1 << 63 else bits - (1 << 64)


def index_entries(distinct: DataFrame, segments: int = 4) -> DataFrame:
    """(pair, key, fp): the entry of each distinct fingerprint in the table of
    each pair of segments."""
    masks = segment_masks(segments)
    both = [x | y for k, x in enumerate(masks) for y in masks[k + 1:]]
    keys = F.array(*[F.col("fp").bitwiseAND(F.lit(m)) for m in both])
    return distinct.select("fp", F.posexplode(keys).alias("pair", "key"))


def ball_entries(distinct: DataFrame, segments: int = 4) -> DataFrame:
    """(z, fp): each distinct fingerprint under itself and under every value of
    the radius-one Hamming ball within each of its segments."""
    cuts = [BITS * k // segments for k in range(segments + 1)]
    balls = F.flatten(F.array(*[
        F.array(*[F.col("fp").bitwiseXOR(F.lit(_signed(1 << bit))) for bit in range(a, b)])
        for a, b in zip(cuts, cuts[1:], strict=False)]))
    return distinct.select("fp", F.explode(F.concat(F.array("fp"), balls)).alias("z"))


def links(distinct: DataFrame, max_distance: int = 2, segments: int = 4, crowd: int = 64) -> DataFrame:
    """(u, v) of fingerprints with u > v whose complete distance was verified;
    connects exactly the fingerprints that a chain of distances of at most
    ``max_distance`` (0 to 2) connects. ``segments``: at least two more than
    that distance. ``crowd``: the members up to which a bucket is compared as a
    whole; larger ones are split by Hamming balls, with the same components."""
    if max_distance not in (0, 1, 2):
        raise ValueError("max_distance must be 0, 1 or 2")
    if not max_distance + 2 <= segments <= BITS:
        raise ValueError("segments must be at least max_distance + 2, and at most 64")
    # Dealt evenly before the rows multiply: a small table is read back in few splits.
    spread = distinct.select("fp").repartition("fp")
    entries = index_entries(spread, segments)
    sizes = entries.groupBy("pair", "key").agg(F.count("*").alias("n")).filter("n > 1")
    # The written join is one whose hot side AQE may split.
    shared = stored(entries.join(sizes, ["pair", "key"]), "buckets")

    buckets = (shared.filter(F.col("n") <= crowd).groupBy("pair", "key")
               .agg(F.collect_list("fp").alias("members")))  # at most `crowd`
    near = F.expr(f"filter(members, v -> v < u and bit_count(u ^ v) <= {max_distance})")
    found = (buckets.select("members", F.explode("members").alias("u"))
             .select("u", F.explode(near).alias("v")))

    crowded = shared.filter(F.col("n") > crowd).select("fp").distinct()
    return found.unionByName(_crowd_links(crowded, max_distance, segments)).distinct()


def _crowd_links(distinct: DataFrame, max_distance: int, segments: int) -> DataFrame:
    """Links by whole values with one bit changed: members of an entry lie within one bit of it."""
    entries = (ball_entries(distinct, segments).groupBy("z")
               .agg(F.count("*").alias("n"), F.min("fp").alias("v"),
                    F.collect_list("fp").alias("members"))  # 65 at most: the ball of z
               .filter("n > 1"))
    if max_distance < 2:  # a chain of one-bit steps passes through its own members
        entries = entries.filter("array_contains(members, z)").withColumn("v", F.col("z"))
    pairs = entries.select("v", F.explode("members").alias("u")).filter("u <> v")
    near = F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= max_distance
    return pairs.filter(near).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))


def _rooted(marks: DataFrame, max_distance: int, segments: int) -> DataFrame:
    """(fp, first_id, root): every fingerprint with its smallest id and its component."""
    distinct = stored(marks.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "distinct")
    roots = components(links(distinct, max_distance, segments))
    return stored(distinct.join(roots, distinct["fp"] == roots["node"], "left")
                  .select("fp", "first_id", F.coalesce("root", "fp").alias("root")), "rooted")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    shingle: int = 3, max_distance: int = 2, segments: int = 4) -> DataFrame:
    """One row per input row: (doc_id, fingerprint, component_id).

    Defined cases: null or empty texts have fingerprint 0 and link like any
    other; a null id keeps its row, and is never the smallest id of a
    component unless all its ids are null; repeated rows are returned as often
    as they occur; an empty table gives an empty result; other columns of the
    input are not read.
    """
    marks = stored(fingerprints(docs, id_col, text_col, shingle), "fingerprints")
    rooted = _rooted(marks, max_distance, segments)
    least = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    member = rooted.join(least, "root").select("fp", "component_id")
    return marks.join(member, "fp").select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
             shingle: int = 3, max_distance: int = 2, segments: int = 4) -> DataFrame:
    """One document of each component, all columns unchanged: the one with the
    component's smallest id and, where that id stands on several texts of the
    component, the text whose hash is smallest; of equal rows of both, the row
    whose columns hash lowest. Texts under one id that are no copies of each
    other are in components of their own, and each of those keeps its one.

    Defined cases: a row with a null id cannot stand for a component or be named
    as a copy, so it stays; null and empty texts are copies of each other; an
    empty table gives an empty result; a text of any length is read whole.
    """
    marks = stored(fingerprints(docs, id_col, text_col, shingle).filter("doc_id is not null"), "fingerprints")
    rooted = _rooted(marks, max_distance, segments)
    # One row a (component, id, text); only texts that stand on several rows need a choice among rows.
    each = (marks.groupBy("fp", "doc_id", "text_hash").agg(F.count("*").alias("rows"))
            .join(rooted.select("fp", "root"), "fp"))
    chosen = stored(each.groupBy("root").agg(F.min(F.struct("doc_id", "text_hash", "rows")).alias("one"))
                    .select(F.col("one.doc_id").alias("__id"), F.col("one.text_hash").alias("__text"),
                            F.col("one.rows").alias("__rows")), "chosen")
    key, text = F.col(id_col).cast("long"), _text_hash(text_col)
    at = (key == F.col("__id")) & (text == F.col("__text"))
    kept = docs.join(chosen.filter("__rows = 1"), at).select(*docs.columns).unionByName(docs.filter(F.col(id_col).isNull()))
    several = chosen.filter("__rows > 1")
    if several.isEmpty():
        return kept
    lowest = F.min_by(F.struct(*docs.columns), F.xxhash64(*[F.col(c).cast("string") for c in docs.columns]))
    again = docs.join(several, at).groupBy("__id", "__text").agg(lowest.alias("__row")).select("__row.*")
    return kept.unionByName(again)
