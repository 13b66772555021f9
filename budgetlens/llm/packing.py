"""Sequence packing by power-of-two decomposition.

A document's ids are cut into pieces whose lengths are powers of two: whole
pieces of the maximum length, then the binary digits of the rest, largest
first. Every piece is a sequence of its own and pieces of equal length share a
bucket, so a batch of one bucket needs no padding and no sequence crosses
documents.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from budgetlens.llm.common import WordHashes, _array, chunks, each_text, in_arrow, per_worker, spans

TOKENIZER = "word_bpe_49k.json"
#: Bytes of text that are encoded at once (its arrays take many times as
#: much), word parts whose ids a task remembers before it starts afresh, and
#: pieces that are handed on together.
CHUNK_BYTES, KNOWN_PARTS, ROWS_OUT = 2 << 20, 500_000, 20_000
#: Parts that go through the tokenizer together.
JOINED = 64
#: ASCII signs that the tokenizer splits from a letter or digit before them.
SIGN = np.zeros(256, bool)
SIGN[list(b".,;:!?%*#$&|()[]\"/-")] = True
ALNUM = np.array([c < 128 and chr(c).isalnum() for c in range(256)])


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER)


class Encoder:
    """Ids of texts through a tokenizer whose tokens never cross white space.

    Texts are cut into words, and words into a stem and closing signs, which
    the tokenizer's splitting keeps apart. Each distinct part is encoded once,
    and the ids of whole texts are gathered from the parts' ids.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        self.closes = np.zeros(max(vocabulary.values()) + 1, bool)  # ids that end a run of letters
        self.closes[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.hashes = WordHashes()
        self.forget()

    def forget(self) -> None:
        self.keys = np.zeros(0, np.uint64)  # sorted hashes of known parts
        self.first, self.size = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.store = np.zeros(0, np.uint32)

    def encode(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, where each part's ids begin, how many they are)."""
        plain = [k for k, p in enumerate(parts) if p.isalpha() and (p.isascii() or max(p) < "\u0100")]
        first, size = np.zeros(len(parts), np.int64), np.zeros(len(parts), np.int64)
        # Runs of plain letters are one word each, so several go in one text
        # and are told apart by the ids that end a word.
        alone = np.ones(len(parts), bool)
        made, at = [], 0
        for ks, several in ((plain, JOINED), (None, 1)):
            ks = np.nonzero(alone)[0].tolist() if ks is None else ks
            groups = [ks[k:k + several] for k in range(0, len(ks), several)]
            texts = [" ".join([parts[k] for k in g]) for g in groups]
            for g, e in zip(groups, self.tokenizer.encode_batch_fast(texts, add_special_tokens=False), strict=True):
                ids = np.array(e.ids, np.uint32)
                ends = np.nonzero(self.closes[ids])[0] + 1 if several > 1 else np.array([len(ids)])
                if len(ends) == len(g) and ends[-1] == len(ids):
                    size[g] = np.diff(ends, prepend=0)
                    first[g] = at + ends - size[g]
                    alone[g] = False
                    made.append(ids)
                    at += len(ids)
        return (np.concatenate(made) if made else np.zeros(0, np.uint32)), first, size

    def learn(self, keys: np.ndarray, parts: list[str]) -> None:
        store, first, size = self.encode(parts)
        first += len(self.store)
        self.store = np.concatenate((self.store, store))
        keys = np.concatenate((self.keys, keys))
        order = np.argsort(keys, kind="stable")  # two sorted runs: one merge
        self.keys = keys[order]
        self.first = np.concatenate((self.first, first))[order]
        self.size = np.concatenate((self.size, size))[order]

    def ids(self, texts: Iterable[str]):
        """The ids of each text, one text after the other."""
        for _, run in chunks(texts, None, CHUNK_BYTES):
            raw = b"\n".join(run)
            if b"<|" not in raw:  # special tokens are matched before letters are lower-cased
                raw = raw.lower()
            buf = np.frombuffer(raw, np.uint8)
            first, end = self.cut(buf)
            key = self.hashes.of_spans(buf, first, end)
            some, where, back = np.unique(key, return_index=True, return_inverse=True)
            if len(self.keys) + len(some) > KNOWN_PARTS:
                self.forget()
            new = np.ones(len(some), bool)
            if len(self.keys):
                new = self.keys[np.minimum(np.searchsorted(self.keys, some), len(self.keys) - 1)] != some
            if new.any():
                w = where[new]
                self.learn(some[new], [raw[a:b].decode("utf-8", "replace") for a, b in
                                       zip(first[w].tolist(), end[w].tolist(), strict=True)])
            at = np.searchsorted(self.keys, some)[back]
            size = self.size[at]
            done = np.concatenate(([0], np.cumsum(size)))
            ids = self.store[np.repeat(self.first[at] - done[:-1], size) + np.arange(done[-1])]
            begins = np.cumsum([0, *(len(t) + 1 for t in run)])
            edge = done[np.searchsorted(first, begins)].tolist()
            for a, b in zip(edge, edge[1:], strict=False):
                yield ids[a:b]

    @staticmethod
    def cut(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Spans of the parts: words, cut before closing signs that follow an
        ASCII letter or digit."""
        first, end = spans(buf)
        if not len(first):
            return first, end
        last = np.maximum.accumulate(np.where(  # the last byte that is no sign
            SIGN[buf], np.int32(-1), np.arange(len(buf), dtype=np.int32)))
        tail = last[end - 1] + 1
        has = (tail < end) & (tail > first)
        has[has] = ALNUM[buf[tail[has] - 1]]
        at = np.nonzero(has)[0]
        return np.insert(first, at + 1, tail[at]), np.insert(end, at, tail[at])


def pieces(n: int, longest: int) -> list[tuple[int, int]]:
    """(start, length) of the power-of-two pieces of n ids; ``longest`` is a power of two."""
    out = [(k, longest) for k in range(0, n - longest + 1, longest)]
    at = len(out) * longest
    size = longest >> 1
    while size:
        if (n - at) & size:
            out.append((at, size))
            at += size
        size >>= 1
    return out


def pack(docs: DataFrame, path: str | None = None, longest: int = 4096, end_id: int = 2,
         with_ids: bool = False) -> DataFrame:
    """One row per piece: (doc_id, start, length, ids_crc32, doc_tokens,
    sequence_id, offset, bucket), and with ``with_ids`` the ids themselves.
    bucket is the exponent of the length. Writing the result with
    ``partitionBy("bucket")`` puts equal lengths together without a shuffle.

    sequence_id is unique and follows the input's partitions and rows; it is
    the same again when a lost task is repeated.

    Defined cases: a null text counts as empty and gives the end id alone; a
    null id stays null; repeated rows are packed as often as they occur; an
    empty table gives no pieces; other columns are not read. White space alone
    gives the end id alone.
    """
    if longest & (longest - 1) or longest < 1:
        raise ValueError("the longest piece must be a power of two")
    path = path or tokenizer_path()
    pick = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text"))
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, bucket int"
    names = ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "bucket")
    if with_ids:
        schema, names = schema + ", ids array<int>", (*names, "ids")
    target = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches):
        # The tokenizer stays in the worker; what it has learned goes with the task.
        encoder = per_worker(f"encoder {path}", lambda: Encoder(path))
        try:
            for batch in batches:
                yield from packed(encoder, batch)
        finally:
            encoder.forget()

    def packed(encoder, batch):
        rows = []
        for doc_id, ids in zip(batch.column("doc_id").to_pylist(), encoder.ids(each_text(batch)), strict=True):
            a = np.append(ids, np.uint32(end_id)).astype("<u4", copy=False)
            raw = memoryview(a).cast("B")
            for s, n in pieces(len(a), longest):
                row = (doc_id, s, n, zlib.crc32(raw[4 * s:4 * (s + n)]), len(a), n.bit_length() - 1)
                rows.append((*row, a[s:s + n].tolist()) if with_ids else row)
            if len(rows) >= ROWS_OUT:
                yield columns(rows)
                rows = []
        if rows:
            yield columns(rows)

    def columns(rows):
        return pa.RecordBatch.from_arrays([_array(v, f.type) for v, f in zip(zip(*rows, strict=True), target, strict=True)],
                                          schema=target)

    made = in_arrow(pick, run, schema)
    return made.select("doc_id", "start", "length", "ids_crc32", "doc_tokens",
                       F.monotonically_increasing_id().alias("sequence_id"),
                       F.lit(0).cast("long").alias("offset"), "bucket", *(["ids"] if with_ids else []))
