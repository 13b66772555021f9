"""Text queries on the star schema's ``documents`` and ``events`` tables.

Every text is processed whole. Long text outputs are reported as length +
MD5, which pins the exact content while keeping result rows small.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from budgetlens.functions import text as X
from budgetlens.functions.fmt import ascii_cell
from budgetlens.session import spread_for_cpu
from budgetlens.sources.tables import Tables

# How a report text is built around a document to exercise
# the heading paths of the section extractor.
SUMMARY_HEADING = "## Executive Summary\n"
DETAILS_HEADING = "\n\n## Details\n"
VARIANTS = ("raw", "heading", "heading_blank")


def variant_text(text: Column, variant: str) -> Column:
    if variant == "raw":
        return text
    if variant == "heading":
        return F.concat(F.lit(SUMMARY_HEADING), text, F.lit(DETAILS_HEADING), text)
    if variant == "heading_blank":
        return F.concat(F.lit(SUMMARY_HEADING + "\n"), text, F.lit(DETAILS_HEADING), text)
    raise ValueError(variant)


def fingerprint(c: Column, name: str) -> list[Column]:
    return [F.length(c).cast("long").alias(f"{name}_len"), F.md5(c).alias(f"{name}_md5")]


def text_functions(spark, sf_dir) -> DataFrame:
    """F6-F14 and S9 on every document."""
    d = spread_for_cpu(Tables(spark, sf_dir).documents.select("doc_id", "text"))
    t = F.col("text")
    return d.select(
        "doc_id",
        F.length(t).cast("long").alias("n_chars"),
        *fingerprint(X.ascii_only(t), "ascii"),
        F.md5(X.latin1_replace(t)).alias("latin1_md5"),
        F.length(X.py_strip(t)).cast("long").alias("stripped_len"),
        F.length(X.first_paragraph(t)).cast("long").alias("first_para_len"),
        X.locate("the", t).cast("long").alias("pos_the"),
        X.locate("the", t, 100).cast("long").alias("pos_the_after_100"),
        X.first_positive(X.locate(". ", t), X.locate(", ", t), X.locate("\n", t)).cast("long")
         .alias("first_mark"),
        t.contains("http").alias("has_http"),
        F.md5(X.preview_text(t, 500)).alias("preview_md5"),
    )


def report_sections(spark, sf_dir) -> DataFrame:
    """X1 in both modes over three report texts per document (Q21).

    The two modes run as two projection chains (a single chain computing
    both produced generated code too large for the JIT and ran slower)."""
    d = spread_for_cpu(Tables(spark, sf_dir).documents.select("doc_id", "text"))
    texts = F.array(*[F.struct(F.lit(v).alias("variant"), variant_text(F.col("text"), v).alias("t"))
                      for v in VARIANTS])
    v = d.select("doc_id", F.explode(texts).alias("x")).select("doc_id", "x.variant", "x.t")
    out = None
    for mode in ("compat", "markdown"):
        s = X.add_report_sections(v, "t", mode, "s", "dr").withColumn("mode", F.lit(mode))
        out = s if out is None else out.unionByName(s)
    return out.select("doc_id", "variant", "mode",
                      *fingerprint(F.col("s"), "summary"), *fingerprint(F.col("dr"), "detailed"))


def headed_documents(spark, sf_dir) -> DataFrame:
    """Each document as a report with a summary and a details heading: (doc_id, md)."""
    return spread_for_cpu(Tables(spark, sf_dir).documents.select("doc_id", "text")) \
        .select("doc_id", variant_text(F.col("text"), "heading").alias("md"))


def markdown_sections(spark, sf_dir) -> DataFrame:
    """The ``## `` sections of each document's report text."""
    s = X.split_markdown_sections(headed_documents(spark, sf_dir), "md", ["doc_id"])
    return s.select("doc_id", F.col("ord").cast("long").alias("ord"), "title",
                    *fingerprint(F.col("body"), "body"))


def cell_functions(spark, sf_dir) -> DataFrame:
    """F9 and F18 on every document: the text's bytes after two that are not
    UTF-8, and the table cell made of the text and of its length."""
    d = spread_for_cpu(Tables(spark, sf_dir).documents.select("doc_id", "text", "n_chars"))
    raw = F.concat(F.unhex(F.lit("FFFE")), F.encode("text", "UTF-8")).cast("string")
    return d.select("doc_id", F.md5(X.utf8_ignore(raw)).alias("utf8_md5"),
                    F.md5(ascii_cell("text")).alias("cell_md5"), ascii_cell("n_chars").alias("n_chars_cell"))


def json_facts(spark, sf_dir) -> DataFrame:
    """Event properties as long facts ``(event_id, path, value)``."""
    e = Tables(spark, sf_dir).events.select("event_id", "props")
    return X.json_facts(e, "props", ["event_id"], "bigint")


QUERIES = {
    "cell_functions": cell_functions,
    "text_functions": text_functions,
    "report_sections": report_sections,
    "markdown_sections": markdown_sections,
    "json_facts": json_facts,
}
