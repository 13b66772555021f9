"""Secret scans: fixed patterns, and novelty against a primed zstandard dictionary.

The fixed patterns report their spans as they are. Beside them, a long string
in a sensitive context is a candidate; its novelty is the number of bytes by
which it lengthens the compressed surrounding text when the compressor was
primed with common identifiers, with the identifiers that the texts of the table
share, and with the nearby code, other copies of the
candidate itself left out. Text made of its surroundings or of known
identifiers costs almost nothing; a random string costs about its entropy,
however often it is written, and is reported. What counts as incompressible
follows the alphabet: of hexadecimal digits no more than half a byte each.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_left
from collections.abc import Iterable

import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from budgetlens.llm.common import each_text, in_arrow, map_batches

KINDS = ("assign", "access", "hex", "novel")
ASSIGN = re.compile(r"""(?ai:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
HEX = re.compile(r"[0-9a-f]{16,}")
#: A candidate: 16 or more token characters.
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
#: The short last line of a wrapped key: padded, or before the key's end mark.
TAIL = re.compile(r"""[\x20\t"',+\\]*\r?\n[\x20\t"']*([A-Za-z0-9+/]{1,15}(?<!=)(?:={1,2}|(?=\s*-----END))|={1,2})"""
                  r"(?![A-Za-z0-9+/_=])")
#: A part of a candidate that may be written elsewhere without the rest.
PART = re.compile(r"[A-Za-z0-9+/_-]{16,}")
SENSITIVE = re.compile(r"(?ai:pass(?:word|wd|phrase)?|secret|token|api.?key|access.?key|auth|credential|"
                       r"private.?key|bearer|signature|client.?id|connection.?string)")
#: Words that code and configuration are full of, to prime the compressor (fixed values).
IDENTIFIERS = (
    "password passwd secret token api_key apikey access_key private_key client_id client_secret bearer "
    "authorization credential signature connection_string username user host port database config "
    "environment variable default import from return function class public private static const string "
    "value name type key id true false null none http https www com org net example localhost "
    "abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ 0123456789 0000000000000000 xxxxxxxxxxxxxxxx "
    "changeme placeholder your_token_here your_api_key_here YOUR_SECRET_KEY example_password test_secret_key "
    "00000000-0000-0000-0000-000000000000 deadbeef 1234567890abcdef")
#: Common words of longer identifiers and paths, as they stand and capitalised (fixed values).
WORDS = (
    "access account action active adapter address admin agent algorithm amount android apache application "
    "array assert async auth authenticate authenticated authentication authorize authorized backend base64 "
    "basic batch buffer builder button cache callback certificate change channel character check child click "
    "cloud code collection color column command component configuration connect connection container content "
    "context controller convert cookie count create created credentials current custom data date decode "
    "decrypt delete description details device dialog directory document domain download dynamic element email "
    "enable enabled encode encoding encrypt encryption endpoint engine entity entry error event exception "
    "execute expired expires expiration extension external factory failed failure feature field file filter "
    "find flag folder format frame framework function generate generator group handle handler hash header "
    "helper history identifier image implementation index information init initialize input instance integer "
    "interface internal invalid item java javascript language layout length level library link list listener "
    "load local location login logout machine main manager message metadata method middleware missing model "
    "module monitor multi network node notification number object open operation option options output "
    "package page parameter params parent parse password path pattern payload permission platform plugin "
    "policy position post process processor production profile project properties property protocol provider "
    "proxy query queue random read receive record redirect reference refresh register registration release "
    "remote remove render repository request required reset resolver resource response rest result resource "
    "role root route router rule sample scope script search section security select send sequence server "
    "service session settings setup shared signature signing size source start state status storage store "
    "stream string style submit success support switch system table target task template test text thread "
    "time timeout title total transaction transfer transform type unknown update upload user utils valid "
    "validate validation validator values verification verify version view virtual web widget window with "
    "without worker wrapper write get set has max min len com org src lib bin app http json xml html css sql "
    "core common spring springframework oauth for and not the our call calls new old add all any str int obj env")
#: A word of a longer identifier; a candidate is no secret with fewer characters beside known words.
WORD, UNKNOWN = re.compile(r"[A-Z]?[a-z]{2,}|[A-Z]{3,}(?![a-z])"), 12
#: Runs of which a plain word is a whole one: it is no part of a candidate or of any run of its characters.
RUN, PLAIN = re.compile(r"[A-Za-z0-9+/_=-]{4,}"), re.compile("[A-Za-z]{4,15}")
#: Alphabets of fewer than 64 characters that secrets are written in, and their sizes.
ALPHABETS = tuple((re.compile(p), n) for p, n in (
    ("[0-9]+", 10), ("[0-9A-F]+|[0-9a-f]+", 16), ("[A-Z2-7]+=*|[a-z2-7]+=*", 32)))
#: Context: so many lines above and below, and characters, at most. Candidates
#: adjoin over a line's end at most and so many characters besides white space.
LINES, AROUND, GAP = 2, 512, 8


class Novelty:
    """Marginal compressed bytes of a string in its surroundings."""

    def __init__(self, learned: Iterable[str] = ()) -> None:
        more = " ".join(learned)
        self.identifiers = (f"{more.title().replace(' ', '')} {more} "
                            f"{WORDS.title().replace(' ', '')} {WORDS} {IDENTIFIERS}").encode()
        self.known = {w.lower() for w in WORD.findall(f"{WORDS} {IDENTIFIERS} {more}") if len(w) < UNKNOWN + 4}

    def made_of_words(self, candidate: str) -> bool:
        rest = WORD.sub(lambda m: "" if m[0].lower() in self.known or m[0].lower().removesuffix("s") in self.known
                        else m[0], candidate)
        return sum(map(str.isalnum, rest)) < UNKNOWN

    def bytes_of(self, around: str, candidate: str) -> int:
        primed = zstandard.ZstdCompressionDict(
            self.identifiers + b" " + around.encode("utf-8", "replace"),
            dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        size = zstandard.ZstdCompressor(level=3, dict_data=primed, write_content_size=False)
        probe = b"key = "
        return len(size.compress(probe + candidate.encode("utf-8", "replace"))) - len(size.compress(probe))


def plain_words(text: str) -> set[str]:
    """The distinct plain words of a text, in lower case."""
    return {r.lower() for r in set(RUN.findall(text)) if PLAIN.fullmatch(r)}


def identifiers(docs: DataFrame, sample: int | None = None, words: int = 1000, least: int = 3) -> list[str]:
    """Plain words of 4 to 15 letters, in lower case, that stand in at least
    ``least`` distinct texts of the table; the ``words`` that stand in most of
    them, ties by word. Copies of one text count once, and parts of candidates
    are no plain words, so a secret's pieces are not learned. ``sample``: count
    in so many distinct texts of smallest hash only (None: in all of them).
    """
    texts = docs.select(F.xxhash64("text").alias("h"), F.col("text").alias("text")).filter("text is not null")
    if sample is not None:
        last = texts.groupBy("h").count().orderBy("h").limit(sample).agg(F.max("h")).first()[0]
        texts = texts.filter(F.col("h") <= F.lit(last))

    def run(batch):
        return {"h": batch.column("h"), "words": [" ".join(sorted(plain_words(t))) for t in each_text(batch)]}

    once = map_batches(texts, run, "h long, words string", bounded=True).dropDuplicates(["h"])
    counts = once.select(F.explode(F.split("words", " ")).alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    top = counts.filter((F.col("n") >= least) & (F.col("word") != "")).orderBy(F.desc("n"), "word").limit(words)
    return sorted(r["word"] for r in top.collect())


def least_bytes(candidate: str, min_ratio: float) -> float:
    """The marginal bytes from which a candidate is novel: ``min_ratio`` of its
    length, less for an alphabet of fewer than 64 characters, whose random
    strings compress to log2(size) / 8 bytes a character."""
    size = min((n for p, n in ALPHABETS if p.fullmatch(candidate)), default=64)
    return min_ratio * len(candidate) * math.log2(size) / 6


def surroundings(text: str, a: int, b: int) -> str:
    """The text up to ``AROUND`` characters on both sides of a candidate, copies
    of the candidate, or of a long part of it beside an equals sign, blanked
    (those that the edge cuts too)."""
    n = b - a
    before, after = text[max(0, a - AROUND - n):a], text[b:b + AROUND + n]
    for part in sorted({text[a:b], *PART.findall(text[a:b])}, key=len, reverse=True):
        before, after = (side.replace(part, " " * len(part)) for side in (before, after))
    return before[-AROUND:] + after[:AROUND]


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the fixed patterns, by start, then kind."""
    out = []
    if ":" in text or "=" in text:
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(1) - m.start(1) >= 12]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def in_context(text: str, found: list[tuple[int, int]]) -> list[bool]:
    """Whether a sensitive word stands near each of the candidates: before or
    after it within ``LINES`` lines and ``AROUND`` characters, or as its name up
    to an equals sign. Adjoining candidates share what one of them has."""
    words = [m.span() for m in SENSITIVE.finditer(text)]
    starts, ends = [a for a, _ in words], [b for _, b in words]
    near = []
    for a, b in found:
        low, high = a, b
        for _ in range(LINES + 1):
            if (low := text.rfind("\n", max(0, a - AROUND), low)) < 0:
                low = max(0, a - AROUND)
                break
        for _ in range(LINES + 1):
            if (high := text.find("\n", high, b + AROUND) + 1) <= 0:
                high = b + AROUND
                break
        value = max(a, text.rfind("=", a, len(text[a:b].rstrip("=")) + a))
        i, j = bisect_left(starts, low), bisect_left(starts, b)
        near.append(i < len(ends) and ends[i] <= value or j < len(ends) and ends[j] <= high)
    first = 0  # of the run of adjoining candidates
    for k in range(1, len(found) + 1):
        if k == len(found) or not adjoin(text, found[k - 1][1], found[k][0]):
            near[first:k] = [any(near[first:k])] * (k - first)
            first = k
    return near


def adjoin(text: str, end: int, start: int) -> bool:
    gap = text[end:start] if start - end <= AROUND else "\n\n"
    return gap.count("\n") <= 1 and len("".join(gap.split())) <= GAP


def novel_spans(text: str, base: list[tuple[int, int, int]], novelty: Novelty,
                min_ratio: float) -> list[tuple[int, int, int]]:
    """Candidates in a sensitive context that no base span touches, that are
    not made of known words and whose marginal bytes reach ``least_bytes``, and the short last line after them if they are a wrapped
    key's."""
    out: list[tuple[int, int, int]] = []
    if not SENSITIVE.search(text):
        return out
    found = [m.span() for m in CANDIDATE.finditer(text)]
    at = 0  # the first base span that ends after the candidate's start
    for (a, b), near in zip(found, in_context(text, found), strict=True):
        while at < len(base) and base[at][2] <= a:
            at += 1
        if not near or any(s < b and e > a for s, _, e in base[at:at + 4]):
            continue
        if not novelty.made_of_words(text[a:b]) and novelty.bytes_of(surroundings(text, a, b), text[a:b]) \
                >= least_bytes(text[a:b], min_ratio):
            out.append((a, 3, b))
            if tail := TAIL.match(text, b):
                out.append((*tail.span(1)[:1], 3, tail.end(1)))
    return out


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def scan(docs: DataFrame, min_ratio: float = 0.6) -> DataFrame:
    """One row per document: counts by fixed kind, the SHA-256 of the fixed
    spans, all spans (``kind:start:end``, code points, end exclusive), and
    n_novel.

    Defined cases: a null text counts as empty (no spans); a null id stays
    null; rows come back as often as they occur; other columns are not read; an
    empty table gives an empty result; very long texts are scanned whole, a
    candidate at a time in its surroundings.
    """
    pick = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text"))
    learned = identifiers(pick)

    def run(batch):
        novelty, rows = Novelty(learned), []
        for text in each_text(batch):
            base = base_spans(text)
            more = novel_spans(text, base, novelty, min_ratio)
            n = [sum(k == kind for _, k, _ in base) for kind in range(3)]
            rows.append((*n, hashlib.sha256(joined(base).encode()).hexdigest(),
                         joined(sorted(base + more)), len(more)))
        names = ("n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_novel")
        return {"doc_id": batch.column("doc_id")} | dict(zip(names, zip(*rows, strict=True), strict=True))

    return map_batches(pick, run, "doc_id long, n_assign long, n_access long, n_hex long, "
                       "base_sha256 string, spans string, n_novel long", bounded=True)


def masked(text: str, spans: list[tuple[int, int, int]], mark: str = "[SECRET]") -> str:
    """The text with every union of overlapping spans replaced by ``mark``."""
    parts, at = [], 0
    for a, _, b in spans:
        if a > at or a == 0 and not parts:
            parts += [text[at:a], mark]
        at = max(at, b)
    return "".join(parts) + text[at:]


def redact(docs: DataFrame, min_ratio: float = 0.6, mark: str = "[SECRET]") -> DataFrame:
    """The documents with their secrets masked, all columns in place; an
    ``n_chars`` column follows the new text. Documents without secrets, and null
    texts, come back unchanged. Further cases as for ``scan``."""
    schema, learned = docs.schema, identifiers(docs)

    def run(batches):
        import pyarrow as pa

        novelty = Novelty(learned)
        for batch in batches:
            k = batch.schema.get_field_index("text")
            texts, changed = batch.column(k).to_pylist(), {}
            for i, text in enumerate(texts):
                if text:
                    base = base_spans(text)
                    if spans := sorted(base + novel_spans(text, base, novelty, min_ratio)):
                        changed[i] = texts[i] = masked(text, spans, mark)
            if changed:
                batch = batch.set_column(k, batch.schema.field(k), pa.array(texts, batch.schema.field(k).type))
                if (j := batch.schema.get_field_index("n_chars")) >= 0:
                    sizes = batch.column(j).to_pylist()
                    for i, text in changed.items():
                        sizes[i] = len(text)
                    batch = batch.set_column(j, batch.schema.field(j), pa.array(sizes, batch.schema.field(j).type))
            yield batch

    return in_arrow(docs, run, schema)
