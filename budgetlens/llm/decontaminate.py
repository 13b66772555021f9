"""Benchmark decontamination by greedy string tiling.

Documents and test items meet through shared token seeds, as long as the
shortest tile. For every document and item whose shared seeds could cover
enough of the item, the longest common token run is marked again and
again, without overlap, until no run of the minimum length is left; runs are
found by running Karp-Rabin hashes. The share of the item's tokens that the
tiles cover does not depend on their order, so reordered passages count.

Tiles count together only inside one window of the document, some item lengths
long: a long text holds nearly every short run somewhere, a passage holds them
together. Windows overlap by half and cover the whole text.
"""

from __future__ import annotations

import heapq

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from budgetlens.llm.common import BASE, WordHashes, chunks, each_text, in_arrow, window_hashes
from budgetlens.llm.licenses import fold

#: Characters of test items that one pass over the documents carries.
BLOCK_CHARS = 32 << 20
#: Places of shared seeds that are looked at together; one window's are never parted.
POSTINGS = 1 << 20
#: Pairs of equal seeds of a window and an item that are joined to runs together.
PAIRS = 1 << 18


class Items:
    """Token hashes of a bounded block of test items and their sorted seeds."""

    def __init__(self, rows: list[tuple[int, str]], seed: int, spread: int):
        cache = WordHashes()
        self.ids, self.tokens = [], []
        parts: dict[int, dict[int, list]] = {}
        for item_id, text in rows:
            h, _ = cache.of_bytes(fold((text or "").encode("utf-8", "surrogatepass")))
            if not len(h):
                continue
            width = min(seed, len(h))
            half = spread << (len(h) - 1).bit_length()
            s = window_hashes(h, width)
            parts.setdefault(width, {}).setdefault(half, []).append(
                (s, np.full(len(s), len(self.ids)), np.arange(len(s))))
            self.ids.append(item_id)
            self.tokens.append(h)
        self.sizes = np.array([len(h) for h in self.tokens], np.int64)
        # By width: all distinct seeds; by half window: distinct seeds, where the places
        # of each begin, and the end, items, places.
        self.seeds: list[tuple[int, np.ndarray, list[tuple]]] = []
        for width, by_half in sorted(parts.items()):
            tables = []
            for half, group in sorted(by_half.items()):
                keys, owner, place = (np.concatenate(x) for x in zip(*group, strict=True))
                order = np.argsort(keys, kind="stable")
                keys, first = np.unique(keys[order], return_index=True)
                tables.append((half, keys, np.append(first, len(order)), owner[order], place[order]))
            self.seeds.append((width, np.unique(np.concatenate([t[1] for t in tables])), tables))

    def candidates(self, h: np.ndarray, starts: np.ndarray, coverage: float) -> list[tuple[int, int, int, int]]:
        """(document, item, begin, end) of the windows where the places of the
        shared seeds cover the item to ``coverage``; tiles cover no other token.
        ``h``: the token hashes of several documents; ``starts``: where each
        begins, and the end."""
        found: list[tuple[int, int, int, int]] = []
        for width, seeds, tables in self.seeds:
            s = window_hashes(h, width)
            at = np.nonzero(seeds[np.minimum(np.searchsorted(seeds, s), len(seeds) - 1)] == s)[0]
            doc = np.searchsorted(starts, at, side="right") - 1
            whole = at + width <= starts[doc + 1]
            at, doc = at[whole], doc[whole]
            for half, *table in tables:
                found += self._in_windows(at, doc, s[at], starts, width, half, table, coverage)
        return found

    def _in_windows(self, at, doc, s, starts, width: int, half: int, table,
                    coverage: float) -> list[tuple[int, int, int, int]]:
        keys, first, owner, place = table
        key = np.minimum(np.searchsorted(keys, s), len(keys) - 1)
        mine = keys[key] == s
        at, doc, key = at[mine], doc[mine], key[mine]
        # Window w of a document begins at w * half and is two halves long.
        windows = np.maximum(1, -(-np.diff(starts) // half) - 1)
        base = np.append(0, np.cumsum(windows))
        at = at - starts[doc]
        w = np.minimum(at // half, windows[doc] - 1)
        earlier = (w > 0) & (at + width <= (w + 1) * half)
        both = np.unique(np.concatenate(((base[doc] + w) * len(keys) + key,
                                         ((base[doc] + w - 1) * len(keys) + key)[earlier])))
        window, key = both // len(keys), both % len(keys)
        n = first[key + 1] - first[key]
        ends = np.cumsum(n)
        found: list[tuple[int, int]] = []
        a = 0
        while a < len(window):  # some whole windows at a time
            upto = int(np.searchsorted(ends, ends[a] - n[a] + POSTINGS, side="right"))
            b = len(window) if upto == len(window) else int(np.searchsorted(window, window[upto]))
            if b <= a:
                b = int(np.searchsorted(window, window[a], side="right"))
            k = np.repeat(first[key[a:b]] - (ends[a:b] - n[a:b]), n[a:b]) + np.arange(ends[a] - n[a], ends[b - 1])
            found += self._covered(np.repeat(window[a:b], n[a:b]), owner[k], place[k], width, coverage)
            a = b
        out = []
        for w, item in found:
            d = int(np.searchsorted(base, w, side="right")) - 1
            begin = int(starts[d]) + (w - int(base[d])) * half
            out.append((d, item, begin, min(begin + 2 * half, int(starts[d + 1]))))
        return out

    def _covered(self, window, item, place, width: int, coverage: float) -> list[tuple[int, int]]:
        code = window * len(self.ids) + item
        pair, which, n = np.unique(code, return_inverse=True, return_counts=True)
        enough = n * width >= coverage * self.sizes[pair % len(self.ids)]
        some = enough[which]
        code, place = code[some], place[some]
        if not len(code):
            return []
        order = np.lexsort((place, code))
        code, place = code[order], place[order]
        new = np.diff(code, prepend=-1) != 0
        step = np.minimum(np.diff(place, append=0), width)
        step[np.append(new[1:], True)] = width  # a pair's last seed
        first = np.nonzero(new)[0]
        covered, pair = np.add.reduceat(step, first), code[first]
        pair = pair[covered >= coverage * self.sizes[pair % len(self.ids)]]
        return list(zip((pair // len(self.ids)).tolist(), (pair % len(self.ids)).tolist(), strict=True))


def runs(text: np.ndarray, item: np.ndarray, width: int) -> list[tuple[int, int, int]]:
    """Maximal common runs (length, place in text, place in item) of at least
    ``width`` tokens, from running Karp-Rabin hashes of that width."""
    a, b = window_hashes(text, width, BASE), window_hashes(item, width, BASE)
    order = np.argsort(b, kind="stable")
    b = b[order]
    lo, hi = np.searchsorted(b, a), np.searchsorted(b, a, side="right")
    at = np.nonzero(hi > lo)[0]
    lo, n = lo[at], (hi - lo)[at]
    ends = np.cumsum(n)
    out: list[tuple[int, int, int]] = []
    size = x = y = np.zeros(0, np.int64)  # runs that may go on
    i = 0
    while i < len(at):  # a bounded number of pairs at a time
        begin = int(ends[i] - n[i])
        j = max(i + 1, int(np.searchsorted(ends, begin + PAIRS, side="right")))
        more = np.repeat(at[i:j], n[i:j])
        y = np.append(y, order[np.repeat(lo[i:j] - (ends[i:j] - n[i:j]), n[i:j]) + np.arange(begin, ends[j - 1])])
        x, size = np.append(x, more), np.append(size, np.ones(len(more), np.int64))
        # Seeds next to each other on a diagonal form one run.
        by = np.lexsort((x, x - y))
        size, x, y = size[by], x[by], y[by]
        new = np.append(True, (x[1:] != x[:-1] + size[:-1]) | (np.diff(x - y) != 0))
        first = np.nonzero(new)[0]
        size, x, y = np.add.reduceat(size, first), x[first], y[first]
        goes_on = (x + size == at[j - 1] + 1) & (j < len(at))
        out += zip((size + width - 1)[~goes_on].tolist(), x[~goes_on].tolist(), y[~goes_on].tolist(), strict=True)
        size, x, y = size[goes_on], x[goes_on], y[goes_on]
        i = j
    return out


def tile(text: np.ndarray, item: np.ndarray, min_match: int) -> tuple[int, int]:
    """(covered tokens of the item, tiles). The longest unmarked common run is
    marked first; ties by place in the item, then in the text. A run that a
    mark has cut goes back with its longest free rest."""
    width = min(min_match, len(item))
    if len(text) < width:
        return 0, 0
    in_text, in_item = np.zeros(len(text), bool), np.zeros(len(item), bool)
    heap = [(-n, y, x) for n, x, y in runs(text, item, width)]
    heapq.heapify(heap)
    covered = tiles = 0
    while heap:
        n, y, x = heapq.heappop(heap)
        n = -n
        taken = in_text[x:x + n] | in_item[y:y + n]
        if not taken.any():
            in_text[x:x + n] = True
            in_item[y:y + n] = True
            covered, tiles = covered + n, tiles + 1
            if covered == len(item):
                break
            continue
        edge = np.diff(np.concatenate(([1], taken.view(np.int8), [1])))
        for a, b in zip(np.nonzero(edge == -1)[0].tolist(), np.nonzero(edge == 1)[0].tolist(), strict=True):
            if b - a >= width:
                heapq.heappush(heap, (-(b - a), y + a, x + a))
    return covered, tiles


def _blocks(benchmark: DataFrame):
    """The benchmark in lists of rows of bounded size, one after the other."""
    rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").alias("text")) \
        .filter("text is not null").distinct()
    size = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    n = -(-size // BLOCK_CHARS)
    for k in range(n):
        part = rows if n == 1 else rows.filter(
            F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k)
        yield [(r["item_id"], r["text"]) for r in part.collect()]


def _batched_hits(batch, items: Items, min_match: int, coverage: float):
    """(row, item, covered, tiles) of a batch of texts, several hashed at once."""
    hashes = WordHashes()
    for begin, texts in chunks(each_text(batch), fold):
        h, starts = hashes.of_texts(texts)
        best: dict[tuple[int, int], tuple[int, int]] = {}
        for d, k, a, b in sorted(items.candidates(h, starts, coverage)):
            item, had = items.tokens[k], best.get((d, k), (0, 0))
            if had[0] == len(item):
                continue
            covered, tiles = tile(h[a:b], item, min_match)
            if covered >= coverage * len(item) and covered > had[0]:
                best[d, k] = covered, tiles
        for (d, k), (covered, tiles) in best.items():
            yield begin + d, k, covered, tiles


def leaks(docs: DataFrame, benchmark: DataFrame, min_match: int = 3,
          coverage: float = 0.8, spread: int = 2) -> DataFrame:
    """One row per document and test item whose tokens a window of the document
    covers to at least ``coverage``: (doc_id, item_id, coverage, covered,
    item_tokens, tiles) of the window that covers most, the first of equals.
    Tiles have ``min_match`` tokens at least, seeds so many; an item shorter than
    that is its own seed. With L the item's length rounded up to a power of two,
    windows are 2 * ``spread`` * L tokens long and begin every ``spread`` * L: a
    passage that is scattered over at most ``spread`` item lengths is always whole
    in one. A shorter document is one window.

    The items are broadcast in blocks of bounded size; a larger benchmark
    takes one pass over the documents for each block.

    Defined cases: null and empty texts and items match nothing; null ids stay
    null; a repeated document repeats its rows, a repeated item counts once;
    other columns are not read; empty tables give an empty result; very long
    texts are read whole, their memory grows with the text and, for runs, with
    the runs of one window.
    """
    pick = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text"))
    schema = "doc_id long, item_id long, coverage double, covered long, item_tokens long, tiles long"
    target = to_arrow_schema(StructType.fromDDL(schema))
    out = docs.sparkSession.createDataFrame([], schema)
    for block in _blocks(benchmark):
        items = Items(block, min_match, spread)

        def run(batches, items=items):
            import pyarrow as pa

            for batch in batches:
                ids = batch.column("doc_id").to_pylist()
                rows = [(ids[r], items.ids[k], c / len(items.tokens[k]), c, len(items.tokens[k]), t)
                        for r, k, c, t in _batched_hits(batch, items, min_match, coverage)]
                if rows:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(v, f.type) for v, f in zip(zip(*rows, strict=True), target, strict=True)],
                        schema=target)

        out = out.unionByName(in_arrow(pick, run, schema))
    return out


def clean(docs: DataFrame, benchmark: DataFrame, min_match: int = 3,
          coverage: float = 0.8, spread: int = 2) -> DataFrame:
    """The documents that leak no test item, all columns unchanged. Defined cases
    as for ``leaks``; null and empty texts, null ids and repeated rows stay."""
    for block in _blocks(benchmark):
        items = Items(block, min_match, spread)

        def run(batches, items=items):
            import pyarrow as pa

            for batch in batches:
                bad = {r for r, *_ in _batched_hits(batch, items, min_match, coverage)}
                yield batch.filter(pa.array([r not in bad for r in range(batch.num_rows)])) if bad else batch

        docs = in_arrow(docs, run, docs.schema)
    return docs
