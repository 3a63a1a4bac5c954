"""Removing lines that many sites share.

Each line is hashed and every line hash gets a HyperLogLog sketch of the sites it occurs on; sketches merge by
aggregation, so a line of a third of all documents is summed map-side. Lines whose estimate is far above or below
the limit are settled; the few near it get an exact distinct count. All work is in DataFrame functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from queuelens.llm.common import SPACES, unused
from queuelens.session import cut_lineage


def _trimmed(line: Column) -> Column:
    return F.trim(line, F.lit(SPACES))


def _hash(line: Column) -> Column:
    """96 bits of a line, without the white space around it."""
    return F.struct(F.xxhash64(_trimmed(line)).alias("a"), F.hash(_trimmed(line)).alias("b"))


def shared_lines(lines: DataFrame, min_sites: int, margin: float, lg_k: int) -> DataFrame:
    """Hashes ``h`` of the lines of (h, site) that occur on ``min_sites`` sites or more."""
    spread = cut_lineage(lines.groupBy("h").agg(F.hll_sketch_agg("site", lg_k).alias("sketch"))
                         .select("h", F.hll_sketch_estimate("sketch").alias("sites")).filter(F.col("sites") >= min_sites * (1 - margin)))
    sure = spread.filter(F.col("sites") > min_sites * (1 + margin)).select("h")
    near = spread.filter(F.col("sites") <= min_sites * (1 + margin)).select("h")
    exact = lines.join(near, "h", "left_semi").distinct().groupBy("h").agg(F.count(F.lit(1)).alias("sites"))
    return sure.unionByName(exact.filter(F.col("sites") >= min_sites).select("h"))


def remove_shared_lines(docs: DataFrame, min_sites: int = 5, margin: float = 0.4, lg_k: int = 12, text: str = "text",
                        site: str = "source", key: str = "doc_id") -> DataFrame:
    """``docs`` with ``text`` freed of boilerplate, and ``n_lines``, ``n_shared``, ``n_removed``, ``left_alone``.

    A line (split at \\n, white space around it ignored, blank lines never counted) is shared if it occurs on
    ``min_sites`` sites or more; null is a site of its own. Shared lines go from every document but those that
    consist of them: where all lines, or three and more and at least half of the non-blank lines, are shared,
    the document is a copy of others rather than a page with boilerplate; it is ``left_alone`` for document
    dedup. Null texts stay null with 0 lines. Equal ids are treated as one document when lines are looked up, so
    repeated rows all lose their shared lines. Columns named like the four new ones are replaced.
    """
    extra = ["n_lines", "n_shared", "n_removed", "left_alone"]
    docs = docs.drop(*extra)
    solid = lambda x: _trimmed(x) != ""
    lines = cut_lineage(docs.select(F.col(key).alias("id"), F.coalesce(F.col(site).cast("string"), F.lit("\0null")).alias("site"),
                                    F.explode(F.filter(F.split(text, "\n"), solid)).alias("line"))
                        .select("id", "site", _hash(F.col("line")).alias("h")))
    shared = cut_lineage(shared_lines(lines.select("h", "site"), min_sites, margin, lg_k))
    id_name, found_name, lines_name = (unused(docs, name) for name in ("_id", "_found", "_lines"))
    found = lines.select("id", "h").join(shared, "h", "left_semi").groupBy("id").agg(F.collect_set("h").alias(found_name))
    joined = docs.join(found.withColumnRenamed("id", id_name), F.col(key).eqNullSafe(F.col(id_name)), "left")
    none = F.array().cast("array<struct<a:bigint,b:int>>")
    marked = joined.withColumn(found_name, F.coalesce(found_name, none)).withColumn(
        lines_name, F.transform(F.split(text, "\n"), lambda x: F.struct(
            x.alias("line"), solid(x).alias("solid"),
            F.when(F.size(found_name) > 0, solid(x) & F.array_contains(found_name, _hash(x))).otherwise(F.lit(False)).alias("shared"))))
    counted = marked.withColumns({
        "n_lines": F.coalesce(F.size(F.filter(lines_name, lambda x: x["solid"])), F.lit(0)).cast("long"),
        "n_shared": F.coalesce(F.size(F.filter(lines_name, lambda x: x["shared"])), F.lit(0)).cast("long")})
    n, m = F.col("n_lines"), F.col("n_shared")
    copy = (m > 0) & ((n == m) | ((m >= 3) & (2 * m >= n)))
    rest = F.array_join(F.transform(F.filter(lines_name, lambda x: ~x["shared"]), lambda x: x["line"]), "\n")
    cleaned = F.when((m > 0) & ~copy, rest).otherwise(F.col(text))
    return counted.withColumns({"n_removed": F.when(copy, 0).otherwise(m).cast("long"), "left_alone": copy, text: cleaned}).drop(id_name, found_name, lines_name)
