"""Text operators (F6-F14, X1, X7, X8) as Column expressions.

Everything here is built from JVM-side functions, so it runs inside
whole-stage codegen over whole texts; no Python UDF is involved.
Positions follow Spark (1-based, 0 = not found); the comments give the
equivalent 0-based view where it matters.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from budgetlens.functions.safe import col_

# Fixed value: the characters Python's ``str.strip()`` removes (those for
# which ``str.isspace`` is true), as a character set and as a regex class
# that Java and RE2 read the same way.
PY_WHITESPACE_CHARS = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
PY_WHITESPACE = (
    r"[\t\n\x{0b}\x{0c}\r\x{1c}-\x{1f} \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
    r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
)
# Longer than any string: "the rest of the text" without counting its characters.
REST = 2147483647

# Headings the section extractor looks for, in order of
# preference, and the marks that end the summary.
SUMMARY_PATTERNS = [
    "# Executive Summary",
    "## Executive Summary",
    "Executive Summary",
    "EXECUTIVE SUMMARY",
    "**Executive Summary**",
]
STOP_MARKS = ["# ", "## ", "\n\n", "**", "Budget Performance", "Infrastructure Project"]
# Substrings one of which every heading pattern contains (used to skip
# searching for patterns that cannot occur).
HEADING_PROBES = ["Executive Summary", "EXECUTIVE SUMMARY"]

# Fixed value: the summary used when none can be extracted.
PLACEHOLDER_SUMMARY = (
    "This comprehensive report analyzes the performance of the Panchayati Raj "
    "Department across key areas including budget utilization, project status, "
    "e-governance initiatives, and district-wise achievements for the reporting period."
)
# Fixed values of ``compat``: a shorter summary becomes the placeholder, a first
# paragraph must be longer to count, a shorter rest gives way to the whole text.
MIN_SUMMARY_CHARS = 50
MIN_DETAILED_CHARS = 200
# Both limits by mode: ``markdown`` keeps every real text, however short.
MIN_CHARS = {"compat": (MIN_SUMMARY_CHARS, MIN_DETAILED_CHARS), "markdown": (1, 1)}


def py_strip(c: str | Column) -> Column:
    """Python ``str.strip()``: remove leading and trailing whitespace.

    A character-set trim: it only touches the ends of the string."""
    return F.trim(col_(c), F.lit(PY_WHITESPACE_CHARS))


def ascii_only(c: str | Column) -> Column:
    """Remove runs of non-ASCII characters."""
    return F.regexp_replace(col_(c), r"[^\x00-\x7F]+", "")


def latin1_replace(c: str | Column) -> Column:
    """Replace each character outside Latin-1 by ``?`` (F8)."""
    return F.regexp_replace(col_(c), r"[^\x00-\xFF]", "?")


def utf8_ignore(c: str | Column) -> Column:
    """Drop byte sequences that are not valid UTF-8 (F9: ``encode('utf-8',
    'ignore')``). Valid strings pass unchanged; invalid ones are repaired
    and the replacement characters the repair inserts are removed."""
    v = col_(c)
    return F.when(F.is_valid_utf8(v), v).otherwise(F.regexp_replace(F.make_valid_utf8(v), "\uFFFD", ""))


def locate(needle: str | Column, haystack: str | Column, pos: Column | int = 1) -> Column:
    """1-based position of ``needle`` in ``haystack`` at or after ``pos``;
    0 when absent (F10). Unlike ``F.locate`` the needle may be a column."""
    n = F.lit(needle) if isinstance(needle, str) else needle
    p = F.lit(pos) if isinstance(pos, int) else pos
    return F.call_function("locate", n, col_(haystack), p)


def first_positive(*positions: Column) -> Column:
    """Smallest position > 0, NULL if none (F14). ``least`` skips NULLs, so
    this stays inside whole-stage codegen (a lambda ``filter`` does not)."""
    if len(positions) == 1:
        return F.when(positions[0] > 0, positions[0])
    return F.least(*[F.when(p > 0, p) for p in positions])


def first_paragraph(c: str | Column) -> Column:
    """Text before the first blank line (F13: ``split('\\n\\n')[0]``)."""
    return F.substring_index(col_(c), "\n\n", 1)


def _check_mode(mode: str) -> str:
    if mode not in ("compat", "markdown"):
        raise ValueError(f"mode must be 'compat' or 'markdown', not {mode!r}")
    return mode


def add_report_sections(df: DataFrame, text_col: str, mode: str = "compat",
                        summary_col: str = "executive_summary",
                        detailed_col: str = "detailed_report") -> DataFrame:
    """Add the executive summary and the detailed report of a report text
    (X1).

    ``compat`` follows the reference step by step: the first heading pattern
    that is present *and* followed by a stop mark decides the summary, even
    when that summary is empty; then the first paragraph if it is longer
    than 50 characters; then a fixed placeholder when the summary is shorter
    than 50. ``markdown`` skips the blank lines right after the heading
    before looking for the stop mark, which a normal ``## Executive
    Summary`` section needs, and keeps short texts: the placeholder stands
    only for a summary that is missing. The detailed report is the text after
    the first occurrence of the summary, stripped, or the whole text when the
    summary does not occur or the rest is under 200 characters (``compat``)
    or empty (``markdown``).
    """
    return add_report_sections_modes(df, text_col, {mode: (summary_col, detailed_col)})


def add_report_sections_modes(df: DataFrame, text_col: str,
                              modes: dict[str, tuple[str, str]]) -> DataFrame:
    """X1 in several modes at once: ``{mode: (summary_col, detailed_col)}``.

    The steps are separate projections, so every intermediate value is
    computed once per row (Catalyst does not inline a non-trivial value
    that is used more than once). A heading pattern is searched for only
    while some mode is still undecided, and the search, the first paragraph
    and the detailed-report search are shared between modes.
    """
    for m in modes:
        _check_mode(m)
    names = list(modes)
    text = F.col(text_col)
    win_type = "struct<st:int,sp:int>"
    wins = [f"_win_{m}" for m in names]
    # Every heading pattern contains one of the probes: a text without the
    # probe cannot contain the pattern, so most texts need two searches, not
    # five; a pattern equal to its probe reuses the probe's position.
    probes = {q: f"_probe{i}" for i, q in enumerate(HEADING_PROBES)}
    step = df.select("*", *[F.lit(None).cast(win_type).alias(w) for w in wins],
                     *[locate(q, text).alias(c) for q, c in probes.items()])
    keep = step.columns
    for p in SUMMARY_PATTERNS:
        undecided = F.lit(False)
        for w in wins:
            undecided = undecided | F.col(w).isNull()
        probe = next(q for q in HEADING_PROBES if q in p)
        found = F.col(probes[probe]) if p == probe else \
            F.when(F.col(probes[probe]) > 0, locate(p, text)).otherwise(F.lit(0))
        step = step.select(*keep, F.when(undecided, found).alias("_at"))
        starts = []
        for m, w in zip(names, wins):
            st = F.col("_at") + F.lit(len(p))
            if m == "markdown":
                ws = F.regexp_extract(F.substring(text, st, F.lit(REST)), rf"\A{PY_WHITESPACE}*", 0)
                st = st + F.length(ws)
            starts.append(F.when(F.col(w).isNull() & (F.col("_at") > 0), st).alias(f"_st_{m}"))
        step = step.select(*keep, *starts)
        stops = [F.when(F.col(f"_st_{m}").isNotNull(),
                        first_positive(*[locate(mk, text, F.col(f"_st_{m}")) for mk in STOP_MARKS]))
                  .alias(f"_sp_{m}") for m in names]
        step = step.select(*keep, *[f"_st_{m}" for m in names], *stops)
        wons = [F.coalesce(F.col(w), F.when(F.col(f"_sp_{m}").isNotNull(),
                                             F.struct(F.col(f"_st_{m}").alias("st"),
                                                      F.col(f"_sp_{m}").alias("sp")))).alias(w)
                for m, w in zip(names, wins)]
        step = step.select(*[c for c in keep if c not in wins], *wons)
    base = [c for c in keep if c not in wins and c not in probes.values()]
    by_heading = [F.when(F.col(w).isNotNull(),
                         py_strip(F.substring(text, F.col(f"{w}.st"), F.col(f"{w}.sp") - F.col(f"{w}.st"))))
                   .otherwise(F.lit("")).alias(f"_byh_{m}") for m, w in zip(names, wins)]
    step = step.select(*base, *by_heading)
    need_para = F.lit(False)
    for m in names:
        need_para = need_para | (F.col(f"_byh_{m}") == "")
    step = step.select("*", F.when(need_para, first_paragraph(text)).alias("_para"))
    step = step.select("*", py_strip(F.col("_para")).alias("_para_s"))
    summaries = []
    for m in names:
        least = MIN_CHARS[m][0]
        para = F.when(F.length("_para") > (least if m == "compat" else 0), F.col("_para_s"))
        chosen = F.when(F.col(f"_byh_{m}") != "", F.col(f"_byh_{m}")).otherwise(F.coalesce(para, F.lit("")))
        summaries.append(F.when(F.length(chosen) < least, F.lit(PLACEHOLDER_SUMMARY))
                         .otherwise(chosen).alias(modes[m][0]))
    step = step.select(*base, *summaries)
    # The detailed report: the search is shared when the modes agree.
    first = modes[names[0]][0]
    outs = []
    for i, m in enumerate(names):
        s_col = modes[m][0]
        at = locate(F.col(s_col), text)
        if i > 0:
            at = F.when(F.col(s_col) == F.col(first), F.col("_sat_0")).otherwise(at)
        outs.append(at.alias(f"_sat_{i}"))
        step = step.select("*", outs[-1])
    rests = []
    for i, m in enumerate(names):
        s_col = modes[m][0]
        rest = F.when(F.col(f"_sat_{i}") > 0,
                      py_strip(F.substring(text, F.col(f"_sat_{i}") + F.length(s_col), F.lit(REST))))
        if i > 0:
            rest = F.when(F.col(s_col) == F.col(first), F.col("_rest_0")).otherwise(rest)
        step = step.select("*", rest.alias(f"_rest_{i}"))
        rests.append(f"_rest_{i}")
    details = [F.when(F.length(f"_rest_{i}") >= MIN_CHARS[m][1], F.col(f"_rest_{i}")).otherwise(text)
               .alias(modes[m][1]) for i, m in enumerate(names)]
    temp = [f"_sat_{i}" for i in range(len(names))] + rests
    return step.select("*", *details).drop(*temp)


def split_markdown_sections(df: DataFrame, text_col: str, keys: list[str]) -> DataFrame:
    """One row per ``## `` section of a Markdown text.

    Output: ``keys``, ``ord`` (0 = text before the first heading), ``title``
    (the heading line), ``body`` (the rest, stripped). An empty preamble is
    dropped.
    """
    parts = F.split(F.col(text_col), r"(?m)^## ")
    exploded = df.select(*keys, F.posexplode(parts).alias("ord", "chunk"))
    title = F.when(F.col("ord") > 0, py_strip(F.substring_index(F.col("chunk"), "\n", 1)))
    nl = locate("\n", F.col("chunk"))
    body = F.when(F.col("ord") == 0, py_strip(F.col("chunk"))).otherwise(
        F.when(nl > 0, py_strip(F.substring(F.col("chunk"), nl + 1, F.lit(REST))))
         .otherwise(F.lit("")))
    out = exploded.select(*keys, F.col("ord"), title.alias("title"), body.alias("body"))
    return out.filter((F.col("ord") > 0) | (F.col("body") != ""))


def missing_sections(sections: DataFrame, required: list[str], keys: list[str]) -> DataFrame:
    """Required section titles absent from each text (anti join, X7)."""
    req = F.array(*[F.struct(F.lit(i).alias("req_ord"), F.lit(t).alias("title"))
                    for i, t in enumerate(required)])
    docs = sections.select(*keys).distinct()
    expected = docs.select(*keys, F.explode(req).alias("_r")).select(*keys, "_r.req_ord", "_r.title")
    return expected.join(sections.select(*keys, "title"), on=[*keys, "title"], how="left_anti")


def json_facts(df: DataFrame, json_col: str, keys: list[str],
               value_type: str = "bigint") -> DataFrame:
    """Flat JSON objects -> long facts ``(keys, path, raw, value)``.

    ``raw`` is the value's text (JSON text of a nested one), ``value`` its
    ``value_type`` or NULL. A text that is no JSON object is one row with a NULL
    path and the whole text as ``raw``; a NULL text has no rows.
    """
    text = F.col(json_col)
    m = F.from_json(text, T.MapType(T.StringType(), T.StringType()))
    entry = "array<struct<path:string,raw:string>>"
    entries = F.when(F.col("_m").isNotNull(), F.map_entries("_m").cast(entry)) \
               .when(text.isNotNull(), F.array(F.struct(F.lit(None).cast("string"), text)).cast(entry))
    parsed = df.select(*keys, json_col, m.alias("_m")).select(*keys, F.explode(entries).alias("_e"))
    return parsed.select(*keys, "_e.path", "_e.raw", F.col("_e.raw").try_cast(value_type).alias("value"))


def _leaves(dtype: T.DataType, path: list[str]):
    if isinstance(dtype, T.StructType):
        for f in dtype.fields:
            yield from _leaves(f.dataType, path + [f.name])
    else:
        yield path, dtype


def flatten_document(df: DataFrame, doc_col: str = None, keys: list[str] | None = None) -> DataFrame:
    """Nested JSON struct -> long facts ``(path, value)`` with dotted paths;
    arrays and maps are rendered as JSON text (X8 on the report document).

    The leaf list comes from the schema (known when the plan is built); the
    data itself never leaves the executors.
    """
    keys = keys or []
    base = F.col(doc_col) if doc_col else None
    schema = df.schema[doc_col].dataType if doc_col else T.StructType(
        [f for f in df.schema.fields if f.name not in keys])
    rows = []
    for path, dtype in _leaves(schema, []):
        ref = base
        for part in path:
            ref = ref.getField(part) if ref is not None else F.col(f"`{part}`")
        if isinstance(dtype, (T.ArrayType, T.MapType, T.StructType)):
            val = F.to_json(ref)
        else:
            val = ref.cast("string")
        rows.append(F.struct(F.lit(".".join(path)).alias("path"), val.alias("value")))
    return df.select(*keys, F.explode(F.array(*rows)).alias("f")).select(*keys, "f.path", "f.value")


# Fixed value: the texts that are one amount or share: an optional currency mark,
# a number with or without grouping commas, an optional unit.
AMOUNT_TEXT = (r"^\s*(?:Rs[.]?|INR|\x{20B9})?\s*([-+]?(?:[0-9]{1,3}(?:,[0-9]{2,3})*,[0-9]{3}|[0-9]+)(?:[.][0-9]+)?)"
               r"\s*(?:%|Cr[.]?|Crores?|Lakhs?|Lacs?)?\s*$")


def money_text_value(c: str | Column) -> Column:
    """The number of a text that is one amount or share as a whole: ``Rs. 163.98 Cr``
    -> 163.98; ``Rs. 1,234.56 Cr`` -> 1234.56; ``70%`` -> 70.0; any other text
    (``12 of 30``, ``FY 2023-24``) -> NULL. Units do not scale the number."""
    num = F.regexp_replace(F.regexp_extract(col_(c), AMOUNT_TEXT, 1), "[,+]", "")
    return F.when(num != "", num.try_cast("double"))


def preview_text(c: str | Column, n: int = 500) -> Column:
    """First ``n`` characters, with ``...`` when longer."""
    t = col_(c)
    return F.when(F.length(t) > n, F.concat(F.substring(t, 1, n), F.lit("..."))).otherwise(t)
