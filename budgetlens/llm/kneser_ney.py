"""Language-model scoring: an interpolated modified Kneser-Ney n-gram model.

The n-grams are counted in Spark: tasks turn texts into sorted arrays of
distinct n-gram hashes with counts, cut by shard of the hash; a shard is the
unit of the shuffle and is merged by one task. Merged shards are written as
sorted hash arrays below the shared checkpoint folder, where every worker maps
them into memory to score.

Shards go by the hash of an n-gram's context, so that a context's totals are
found in one place; contexts that hold more than a shard's share of the tokens
are spread over all shards by the hash of the whole n-gram, and their totals
are added up from the shards.
"""

from __future__ import annotations

import math
import os
import uuid
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from budgetlens.llm.common import BASE, WordHashes, chunks, doc_bucket, each_text, in_arrow, map_batches, mixed, release, stored
from budgetlens.session import scratch_path

#: Tokens that one shard should hold on average.
SHARD_TOKENS = 1 << 19
#: Bytes of text that a task counts, and scores, at once, and of packed
#: n-grams that it hands on together.
CHUNK_BYTES, SCORE_BYTES, OUT_BYTES = 8 << 20, 4 << 20, 2 << 20
#: Shards of one array that a task keeps mapped.
OPEN_SHARDS = 128
#: Hashes of the end token and of the begin mark.
END, BEGIN = np.uint64(0x1D8E4E27C47D124F), np.uint64(0xEB44ACCAB455D165)


def shared_folder(spark) -> str:
    """A new folder below the shared checkpoint folder, as a path that workers
    can map files of. The folder must be mounted on every worker."""
    where = urlparse(scratch_path(spark, "ngrams"))
    if where.scheme not in ("", "file"):
        raise ValueError("the model's arrays are memory-mapped: spark.checkpoint.dir must be a mounted folder")
    os.makedirs(where.path, exist_ok=True)
    return where.path


class Tokens:
    """Token hashes of texts: A-Z lower-cased words, then one end."""

    def __init__(self) -> None:
        self.hashes = WordHashes()
        self.end, self.begin = END, BEGIN

    def chunks(self, texts, size: int):
        """(hashes, sizes): the tokens of several texts, of about ``size`` bytes, one after the other."""
        for _, run in chunks(texts, bytes.lower, size):
            words, starts = self.hashes.of_texts(run)
            sizes = np.diff(starts) + 1
            h = np.full(len(words) + len(run), self.end, np.uint64)
            inner = np.ones(len(h), bool)
            inner[np.cumsum(sizes) - 1] = False
            h[inner] = words
            del run, words, inner  # the arrays of a chunk are large; none stays while it is used
            yield h, sizes

    def grams(self, h: np.ndarray, sizes: np.ndarray, n: int) -> list[np.ndarray]:
        """n columns: for every token the n - 1 tokens before it (begin marks
        where the text starts) and itself."""
        starts = np.concatenate(([0], np.cumsum(sizes)[:-1]))
        out = []
        for back in range(n - 1, 0, -1):
            c = np.roll(h, back)
            for k in range(back):
                c[starts[sizes > k] + k] = self.begin
            out.append(c)
        return [*out, h]


def chained(columns: list[np.ndarray]) -> np.ndarray:
    """One hash of each row of word hashes."""
    h = columns[0].copy()
    for c in columns[1:]:
        h = mixed(h) * np.uint64(BASE) + c
    return mixed(h)


def unique_rows(columns: list[np.ndarray], counts: np.ndarray | None = None) -> tuple[list[np.ndarray], np.ndarray]:
    """Distinct rows in order, with summed counts (without counts: 1 a row)."""
    if len(columns) == 1:
        order = np.argsort(columns[0])
    elif len(columns) == 2:
        # One fast sort by the upper halves; exact unless two different rows
        # agree in both, which is seen and sorted again.
        half = np.uint64(32)
        key = columns[0] >> half << half
        key |= columns[1] >> half
        order = np.argsort(key)
        key = key[order]
        same = key[1:] == key[:-1]
        del key
        for c in columns:
            c = c[order]
            if (same & (c[1:] != c[:-1])).any():
                order = np.lexsort(columns[::-1])
                break
    else:
        order = np.lexsort(columns[::-1])
    columns = [c[order] for c in columns]
    new = np.zeros(len(order), bool)
    new[:1] = True
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    first = np.nonzero(new)[0]
    if counts is None:
        sums = np.diff(first, append=len(new)).astype(np.uint64)
    else:
        sums = np.add.reduceat(counts[order], first) if len(first) else counts[:0]
    return [c[first] for c in columns], sums


def distinct(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One place of each distinct key, by key, and for every place the number of its key."""
    order = np.argsort(key)
    key = key[order]
    new = np.ones(len(key), bool)
    np.not_equal(key[1:], key[:-1], out=new[1:])
    del key
    number = np.empty(len(order), np.int32)
    number[order] = np.cumsum(new, dtype=np.int32) - np.int32(1)
    return order[new], number


def _packed(columns: list[np.ndarray], counts: np.ndarray) -> bytes:
    """Sorted columns by differences, bytes of equal weight together, compressed."""
    raw = []
    for c in [*columns, counts.astype(np.uint64)]:
        d = np.diff(c, prepend=np.uint64(0))
        raw.append(np.ascontiguousarray(d.view(np.uint8).reshape(-1, 8).T).tobytes())
    return len(counts).to_bytes(8, "little") + zstandard.ZstdCompressor(level=1).compress(b"".join(raw))


def _unpacked(blob: bytes, k: int) -> tuple[list[np.ndarray], np.ndarray]:
    n = int.from_bytes(blob[:8], "little")
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob[8:], max_output_size=8 * n * (k + 1) or 1), np.uint8)
    cols = [np.cumsum(np.ascontiguousarray(raw[8 * n * j:8 * n * (j + 1)].reshape(8, -1).T).view(np.uint64).ravel(),
                      dtype=np.uint64) for j in range(k + 1)]
    return cols[:k], cols[k]


class Layout:
    """Which shard an n-gram belongs to."""

    def __init__(self, shards: int, hot: np.ndarray):
        self.shards, self.hot = shards, np.sort(hot)

    def of(self, context: np.ndarray, whole: np.ndarray) -> np.ndarray:
        key = context
        if len(self.hot):
            at = np.minimum(np.searchsorted(self.hot, context), len(self.hot) - 1)
            key = np.where(self.hot[at] == context, whole, context)
        return (mixed(key ^ np.uint64(0x5851F42D4C957F2D)) % np.uint64(self.shards)).astype(np.int32)


def by_shard(shard: np.ndarray) -> np.ndarray:
    """A stable order by shard number."""
    return np.argsort(shard.astype(np.uint16) if shard.max(initial=0) < 1 << 16 else shard, kind="stable")


def _blobs(columns, counts, shard):
    """One packed row for each shard."""
    order = by_shard(shard)
    shard = shard[order]
    edge = np.nonzero(np.diff(shard, prepend=-1))[0].tolist() + [len(shard)]
    columns, counts = [c[order] for c in columns], counts[order]
    for a, b in zip(edge, edge[1:], strict=False):
        yield int(shard[a]), _packed([c[a:b] for c in columns], counts[a:b])


def _rows_by_shard(made):
    """The packed rows in columns of about ``OUT_BYTES``."""
    ids, blobs, size = [], [], 0
    for shard, blob in made:
        ids.append(shard)
        blobs.append(blob)
        size += len(blob)
        if size >= OUT_BYTES:
            yield {"shard": ids, "blob": blobs}
            ids, blobs, size = [], [], 0
    if ids:
        yield {"shard": ids, "blob": blobs}


def counted(pick: DataFrame, n: int, layout: Layout) -> DataFrame:
    """(shard, blob): distinct n-grams of the training texts by task and chunk."""
    def run(batch):
        tokens = Tokens()
        for h, sizes in tokens.chunks(each_text(batch), CHUNK_BYTES):
            cols, counts = unique_rows(tokens.grams(h, sizes, n))
            del h
            whole = chained(cols)
            shard = layout.of(chained(cols[:-1]) if n > 1 else whole, whole)
            del whole
            yield from _rows_by_shard(_blobs(cols, counts, shard))
            del cols, counts, shard

    return map_batches(pick, run, "shard int, blob binary", bounded=True)


STATS = ("level int, shard int, n long, total long, n1 long, n2 long, n3 long, n4 long, hot binary, "
         "blobs array<struct<shard:int,blob:binary>>")


def merged(blobs: DataFrame, n: int, layout: Layout, below: Layout | None, folder: str, raw: bool,
           partitions: int) -> DataFrame:
    """Merge every shard, write its arrays, and return a row a shard: numbers
    of n-grams, counts of counts, partial totals of hot contexts, and the
    shard's distinct lower-order n-grams cut by the lower level's shards."""
    target = to_arrow_schema(StructType.fromDDL(STATS))
    tag = "raw" if raw else str(n)

    def finish(shard, parts):
        got = [_unpacked(p, n) for p in parts]
        cols, counts = unique_rows([np.concatenate([g[0][j] for g in got]) for j in range(n)],
                                   np.concatenate([g[1] for g in got]))
        del got
        whole = chained(cols)
        hot = b""
        if n > 1:
            context = chained(cols[:-1])
            hot = _contexts(f"{folder}/{tag}-{shard}", context, counts, layout)
        order = np.argsort(whole)
        _write(f"{folder}/{tag}-{shard}-key", whole[order])
        _write(f"{folder}/{tag}-{shard}-n", counts[order].astype(np.min_scalar_type(int(counts.max()))))
        lower = []
        if below is not None:
            sub, ones = unique_rows(cols[1:])
            w = chained(sub)
            c = chained(sub[:-1]) if n > 2 else w
            lower = [{"shard": s, "blob": b} for s, b in _blobs(sub, ones, below.of(c, w))]
        of = [int((counts == k).sum()) for k in (1, 2, 3, 4)]
        return (n, shard, len(counts), int(counts.sum()), *of, hot, lower)

    def run(batches):
        shard, parts = None, []
        for batch in batches:
            for s, b in zip(batch.column("shard").to_pylist(), batch.column("blob").to_pylist(), strict=True):
                if s != shard and parts:
                    yield _one(finish(shard, parts), target)
                    parts = []
                shard = s
                parts.append(b)
        if parts:
            yield _one(finish(shard, parts), target)

    return in_arrow(blobs.repartition(partitions, "shard").sortWithinPartitions("shard"), run, STATS)


def _one(row, target):
    return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(row, target, strict=True)], schema=target)


def _contexts(base, context, counts, layout) -> bytes:
    """Write the totals of the shard's own contexts; return those of hot ones."""
    order = np.argsort(context, kind="stable")
    context, counts = context[order], counts[order]
    first = np.nonzero(np.concatenate(([True], context[1:] != context[:-1])))[0]
    keys = context[first]
    stats = np.stack([np.add.reduceat(v.astype(np.int64), first) for v in
                      (counts, counts == 1, counts == 2, counts >= 3)], axis=1)
    hot = np.isin(keys, layout.hot)
    _write(f"{base}-ctx", keys[~hot])
    _write(f"{base}-sum", stats[~hot].astype(np.min_scalar_type(int(stats.max()))))
    return keys[hot].tobytes() + stats[hot].tobytes()


def _write(path: str, a: np.ndarray) -> None:
    """Whole or not at all: a repeated task replaces the same content."""
    part = f"{path}.{uuid.uuid4().hex}"
    with open(part, "wb") as f:
        np.save(f, a)
    os.replace(part, f"{path}.npy")


def discounts(n1: int, n2: int, n3: int, n4: int) -> tuple[float, float, float]:
    """Chen and Goodman's three discounts; 0.5, 1 and 1.5 where the counts of
    counts do not give a value between 0 and the count."""
    y = n1 / (n1 + 2 * n2) if n1 else 0.0
    raw = [k - (k + 1) * y * b / a if a else -1.0 for k, a, b in ((1, n1, n2), (2, n2, n3), (3, n3, n4))]
    return tuple(d if 0 < d < k else k / 2 for k, d in zip((1, 2, 3), raw, strict=True))


class Mapped:
    """One sorted hash array with its values, mapped when first used."""

    def __init__(self, base: str, keys: str, values: str):
        self.base, self.keys, self.values, self.open = base, keys, values, {}

    def rows(self, shard: int):
        if shard not in self.open:
            if len(self.open) >= OPEN_SHARDS:
                self.open.clear()
            k, v = (f"{self.base}-{shard}-{x}.npy" for x in (self.keys, self.values))
            self.open[shard] = (np.load(k, mmap_mode="r"), np.load(v, mmap_mode="r")) if os.path.exists(k) else None
        return self.open[shard]

    def get(self, shard: np.ndarray, key: np.ndarray, width: int = 0) -> np.ndarray:
        """Values by key, 0 where it is not found; quickest if keys come sorted."""
        out = np.zeros((len(key), width) if width else len(key), np.int64)
        order = by_shard(shard)
        s = shard[order]
        edge = np.nonzero(np.diff(s, prepend=-1))[0].tolist() + [len(s)]
        for a, b in zip(edge, edge[1:], strict=False):
            if (found := self.rows(int(s[a]))) is None or not len(found[0]):
                continue
            keys, values = found
            want = key[order[a:b]]
            at = np.minimum(np.searchsorted(keys, want), len(keys) - 1)
            hit = keys[at] == want
            out[order[a:b][hit]] = values[at[hit]]
        return out


class Model:
    """What scoring needs besides the arrays: sizes, discounts, hot contexts."""

    def __init__(self, folder: str, order: int):
        self.folder, self.order = folder, order
        self.layout: dict[int, Layout] = {}
        self.discount: dict[int, tuple[float, float, float]] = {}
        self.hot: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        self.words = self.tokens = self.base_total = 0
        self.base_stats = (0, 0, 0, 0)

    def probabilities(self, maps: dict, cols: list[np.ndarray]) -> np.ndarray:
        """P(last column | columns before it)."""
        unseen = 1.0 / (self.words + 1)
        if not self.tokens:
            return np.full(len(cols[0]), unseen)
        p = np.full(len(cols[0]), unseen)
        for n in range(1, self.order + 1):
            part = cols[self.order - n:]
            whole = chained(part)
            d = np.array([0.0, *self.discount[n]])
            if n == 1:
                shard = self.layout[1].of(whole, whole)
                total = np.broadcast_to(np.array(self.base_stats, np.int64), (len(whole), 4))
            else:
                context = chained(part[:-1])
                shard = self.layout[n].of(context, whole)
                total = maps[n, "ctx"].get(shard, context, 4)
                keys, stats = self.hot[n]
                if len(keys):
                    at = np.minimum(np.searchsorted(keys, context), len(keys) - 1)
                    hit = keys[at] == context
                    total[hit] = stats[at[hit]]
                del context
            c = maps[n, "n"].get(shard, whole)
            del shard, whole
            seen = total[:, 0] > 0
            here = (total[:, 1:] @ d[1:]) * p
            here += np.maximum(c - d[np.minimum(c, 3)], 0.0)
            here /= np.maximum(total[:, 0], 1)
            p = np.where(seen, here, p)
        return p

    def token_scores(self, maps: dict, h: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For every token of several texts its count in training and its log10
        probabilities by the base and by the model. Every distinct n-gram, and
        word, of the texts is looked up once, in the order of its hash."""
        cols = Tokens().grams(h, sizes, self.order)
        some, number = distinct(chained(cols))
        cols = [c[some] for c in cols]
        del some
        p = np.log10(self.probabilities(maps, cols))[number]
        del cols, number
        word = chained([h])
        some, number = distinct(word)
        word = word[some]
        c = np.zeros(len(word), np.int64)
        if self.tokens:
            c = maps["raw"].get(self.layout[0].of(word, word), word)
        base = np.log10((c + 0.1) / (self.tokens + 0.1 * (self.words + 1)))
        return c[number], base[number], p

    def maps(self) -> dict:
        out: dict = {"raw": Mapped(f"{self.folder}/raw", "key", "n")}
        for n in range(1, self.order + 1):
            out[n, "n"] = Mapped(f"{self.folder}/{n}", "key", "n")
            out[n, "ctx"] = Mapped(f"{self.folder}/{n}", "ctx", "sum")
        return out


def train(docs: DataFrame, order: int = 2, shard_tokens: int = SHARD_TOKENS) -> Model:
    """Count the texts of ``docs`` and write the model. ``order`` is the
    longest n-gram (two or more)."""
    if order < 2:
        raise ValueError("order must be at least 2")
    spark = docs.sparkSession
    pick = docs.select(F.col("text").alias("text"))
    model = Model(shared_folder(spark), order)
    # Shards follow the input's size: about a token for every eight characters.
    size = pick.agg(F.sum(F.length("text") / 6 + 1)).first()[0] or 0
    shards = max(8, math.ceil(size / shard_tokens))
    partitions = max(shards // 4, int(spark.conf.get("spark.sql.shuffle.partitions")))
    none = np.zeros(0, np.uint64)
    flat = Layout(shards, none)
    model.layout[1] = model.layout[0] = flat
    raw = stored(merged(counted(pick, 1, flat), 1, flat, None, model.folder, True, partitions)
                 .drop("hot", "blobs"), "raw")
    got = raw.agg(F.sum("n"), F.sum("total")).first()
    model.words, model.tokens = got[0] or 0, got[1] or 0
    if not model.tokens:
        return model
    begin = np.full(1, Tokens().begin, np.uint64)
    model.layout[2] = Layout(shards, np.unique(np.concatenate((_hot_words(raw, model, shards), chained([begin])))))
    for n in range(3, order + 1):
        model.layout[n] = Layout(shards, chained([begin] * (n - 1)))
    blobs = counted(pick, order, model.layout[order])
    for n in range(order, 0, -1):
        below = model.layout[n - 1] if n > 1 else None
        rows = stored(merged(blobs, n, model.layout[n], below, model.folder, False, partitions), f"level{n}")
        s = rows.agg(*[F.sum(c) for c in ("n1", "n2", "n3", "n4", "total", "n")]).first()
        model.discount[n] = discounts(*s[:4])
        if n == 1:
            model.base_stats = (s[4], s[0], s[1], s[5] - s[0] - s[1])
        else:
            model.hot[n] = _hot_totals(rows, len(model.layout[n].hot))
            blobs = rows.select(F.inline("blobs"))
    release(spark)
    return model


def _hot_words(raw: DataFrame, model: Model, shards: int) -> np.ndarray:
    """Context hashes of the words with more than a quarter of a shard's tokens, of
    which there are at most four times the number of shards."""
    limit, folder = max(1, model.tokens // (4 * shards)), model.folder

    def run(batch):
        out = []
        for s in batch.column("shard").to_pylist():
            n = np.load(f"{folder}/raw-{s}-n.npy", mmap_mode="r")
            key = np.load(f"{folder}/raw-{s}-key.npy", mmap_mode="r")
            out += np.asarray(key[n > limit]).view(np.int64).tolist()
        return {"h": out}

    rows = map_batches(raw.select("shard"), run, "h long").collect()
    return np.array([r["h"] for r in rows], np.int64).view(np.uint64)


def _hot_totals(rows: DataFrame, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The totals of the hot contexts (a bounded set), added up over the shards."""
    schema = "key long, total long, n1 long, n2 long, n3 long"

    def run(batch):
        keys, stats = [], []
        for b in batch.column("hot").to_pylist():
            k = len(b) // 40
            keys.append(np.frombuffer(b[:8 * k], np.int64))
            stats.append(np.frombuffer(b[8 * k:], np.int64).reshape(k, 4))
        s = np.concatenate(stats)
        return {"key": np.concatenate(keys)} | {c: np.ascontiguousarray(s[:, j]) for j, c in
                                                enumerate(("total", "n1", "n2", "n3"))}

    got = map_batches(rows.select("hot"), run, schema).groupBy("key").agg(
        *[F.sum(c).alias(c) for c in ("total", "n1", "n2", "n3")]).limit(most + 1).collect()
    keys = np.array([r["key"] for r in got], np.int64).view(np.uint64)
    stats = np.array([[r["total"], r["n1"], r["n2"], r["n3"]] for r in got], np.int64).reshape(-1, 4)
    order = np.argsort(keys)
    return keys[order], stats[order]


def score(docs: DataFrame, model: Model, flag) -> DataFrame:
    """One row per document: (doc_id, held_out, n_tokens, n_known, train_tokens,
    base_score, score, perplexity); ``flag``: the column expression of held_out."""
    pick = docs.select(F.col("doc_id").cast("long").alias("doc_id"), flag.alias("held_out"), F.col("text").alias("text"))
    held: list[dict] = []

    def run(batch):
        if not held:
            held.append(model.maps())
        maps, tokens = held[0], Tokens()
        out: dict[str, list] = {k: [] for k in ("n_tokens", "n_known", "base_score", "score")}
        for h, sizes in tokens.chunks(each_text(batch), SCORE_BYTES):
            c, base, p = model.token_scores(maps, h, sizes)
            known = c > 0
            first = np.concatenate(([0], np.cumsum(sizes)[:-1]))
            out["n_tokens"] += sizes.tolist()
            out["n_known"] += np.add.reduceat(known.astype(np.int64), first).tolist()
            out["base_score"] += np.add.reduceat(base, first).tolist()
            out["score"] += np.add.reduceat(p, first).tolist()
            del h, c, base, p, known
        n = len(out["score"])
        return {"doc_id": batch.column("doc_id"), "held_out": batch.column("held_out"), **out,
                "train_tokens": [model.tokens] * n,
                "perplexity": [10 ** (-s / t) for s, t in zip(out["score"], out["n_tokens"], strict=True)]}

    return map_batches(pick, run, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, "
                       "base_score double, score double, perplexity double", bounded=True)


def held_out_scores(docs: DataFrame, order: int = 2, modulus: int = 10) -> DataFrame:
    """Train on the documents whose crc32(doc_id as text) modulo ``modulus`` is
    not 0 and score all of them.

    Defined cases: a null text counts as empty (its end alone); a null id
    counts as the empty text, whose remainder is 0; repeated rows count and
    are scored as often as they occur; without training tokens every token has
    the same probability 1 / (V + 1) = 1; other columns are not read.
    """
    held = doc_bucket("doc_id", modulus) == 0
    return score(docs, train(docs.filter(~held), order), held)
