"""JSON documents of any shape as long facts.

No schema is declared or inferred: texts become variants, and every level of
nesting is opened by one ``variant_explode``. A level is a table of its own, of
the nodes of that depth, so an array of any length is spread over rows and no
document is walked in one task's memory.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from budgetlens.session import materialize

#: A key that stands in a path without quotes.
PLAIN_KEY = "^[A-Za-z_][A-Za-z0-9_]*$"


def json_leaves(df: DataFrame, json_col: str, keys: list[str]) -> DataFrame:
    """(keys, path, value): one row for every value that is no object or array,
    and for every empty object or array; ``path`` like ``$.a."odd key"[0].b``,
    ``value`` the text of a string, number or truth value, ``{}``, ``[]``, and
    NULL for a JSON null.

    A text that is not JSON is one row with a NULL path and the whole text; a
    NULL text has no rows; rows that agree in ``keys`` are not told apart.
    """
    names = [f"_k{i}" for i in range(len(keys))]
    own = [F.col(f"`{k}`").alias(n) for k, n in zip(keys, names)]
    texts = df.select(*own, F.col(f"`{json_col}`").alias("_text")).filter("_text is not null")
    parsed = texts.withColumn("_v", F.try_parse_json("_text"))
    bad = parsed.filter("_v is null").select(*names, F.lit(None).cast("string").alias("path"), F.col("_text").alias("value"))
    nodes = parsed.filter("_v is not null").select(*names, F.lit("$").alias("path"), "_v")
    out = [bad]
    listed = "".join(f"t.{n}, " for n in names)
    while True:
        opened = df.sparkSession.sql(
            f"SELECT {listed}t.path, t._v, e.pos, e.key, e.value FROM {{t}} t, LATERAL variant_explode_outer(t._v) e",
            t=nodes)
        leaf = F.col("pos").isNull()
        step = F.when(F.col("key").isNull(), F.concat(F.lit("["), F.col("pos").cast("string"), F.lit("]"))) \
            .when(F.col("key").rlike(PLAIN_KEY), F.concat(F.lit("."), "key")) \
            .otherwise(F.concat(F.lit('."'), F.col("key"), F.lit('"')))
        level = materialize(opened.select(
            *names, F.when(leaf, F.col("path")).otherwise(F.concat("path", step)).alias("path"), leaf.alias("_leaf"),
            F.when(leaf, F.col("_v").cast("string")).alias("value"), F.when(~leaf, F.col("value")).alias("_v")),
            "json-level")
        out.append(level.filter("_leaf").select(*names, "path", "value"))
        nodes = level.filter("not _leaf").select(*names, "path", "_v")
        if nodes.isEmpty():
            break
    every = out[0]
    for part in out[1:]:
        every = every.unionByName(part)
    return every.select(*[F.col(n).alias(k) for n, k in zip(names, keys)], "path", "value")
