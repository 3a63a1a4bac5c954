"""Readers. Schemas are explicit; nothing is inferred in jobs."""

from __future__ import annotations

import os
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from queuelens.operators.slices import micros


def scan_csv(spark: SparkSession, path, schema, nrows: int | None = None, sep: str = ",") -> DataFrame:
    df = spark.read.schema(schema).option("header", True).option("sep", sep).csv(path)
    return df.limit(nrows) if nrows is not None else df


def scan_jsonl(spark: SparkSession, path, schema: T.StructType, nrows: int | None = None) -> DataFrame:
    """JSON lines; lines that do not parse are skipped.

    Each line is parsed whole, so that which lines are skipped does not depend
    on the columns a query reads.
    """
    good = scan_jsonl_marked(spark, path, schema).filter(F.col("_corrupt_record").isNull()).drop("_corrupt_record")
    return good.limit(nrows) if nrows is not None else good


def scan_jsonl_marked(spark: SparkSession, path, schema: T.StructType) -> DataFrame:
    """As ``scan_jsonl`` but bad lines are kept, with their text in ``_corrupt_record``."""
    full = T.StructType([*schema.fields, T.StructField("_corrupt_record", T.StringType())])
    parsed = F.from_json("value", full, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"})
    return spark.read.text(path).filter(F.length(F.trim("value")) > 0).select(parsed.alias("_r")).select("_r.*")


# Reader of each file suffix.
SUFFIX_FORMATS = {"csv": "csv", "tsv": "tsv", "parquet": "parquet", "pq": "parquet", "jsonl": "json", "ndjson": "json", "json": "json"}


def scan_auto(spark: SparkSession, paths: Sequence[str], schema: T.StructType) -> DataFrame:
    """Files of several formats stacked by column name; globs are allowed.

    All paths of one format go into one reader.
    """
    groups: dict[str, list[str]] = {}
    for path in paths:
        base = os.path.basename(path.rstrip("/"))
        parts = [p for p in base.lower().split(".") if p not in ("gz", "snappy", "zst")]
        fmt = SUFFIX_FORMATS.get(parts[-1].strip("*")) if len(parts) > 1 else None
        if fmt is None:
            raise ValueError(f"no reader for {path}")
        groups.setdefault(fmt, []).append(path)
    read = {"csv": lambda p: scan_csv(spark, p, schema), "tsv": lambda p: scan_csv(spark, p, schema, sep="\t"),
            "json": lambda p: scan_jsonl(spark, p, schema), "parquet": lambda p: spark.read.schema(schema).parquet(*p)}
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [read[f](p) for f, p in groups.items()])


def scan_trace(spark: SparkSession, path, steps: int) -> DataFrame:
    """Arrival counts of a trace, cut or repeated to ``steps`` rows.

    A line is JSON (``count``, else ``cnt``, else ``c``), ``ts,count`` or a
    number. Line numbers come from file blocks: lines are counted per block, the
    few block sizes are accumulated, and lines are numbered within their block.
    """
    lines = spark.read.text(path).select(
        F.col("value"), F.col("_metadata.file_path").alias("_f"), F.col("_metadata.file_block_start").alias("_b"),
        F.monotonically_increasing_id().alias("_i"))
    t = F.trim("value")
    field = lambda k: F.get_json_object(t, f"$.{k}").try_cast("long")
    count = (F.when(t.startswith("{"), F.coalesce(field("count"), field("cnt"), field("c")))
             .when(F.contains(t, F.lit(",")), F.element_at(F.split(t, ","), 2).try_cast("long"))
             .otherwise(t.try_cast("long")))
    counted = lines.withColumn("count", count).filter(F.col("count").isNotNull()).drop("value")
    blocks = counted.groupBy("_f", "_b").agg(F.count(F.lit(1)).alias("_n"))
    upto = Window.orderBy("_f", "_b")
    placed = blocks.select("_f", "_b", (F.sum("_n").over(upto.rowsBetween(Window.unboundedPreceding, 0)) - F.col("_n")).alias("_before"),
                           F.sum("_n").over(Window.partitionBy()).alias("_total"))
    numbered = counted.join(placed, ["_f", "_b"]).select(
        "count", "_total", (F.col("_before") + F.row_number().over(Window.partitionBy("_f", "_b").orderBy("_i")) - 1).alias("_line"))
    # line l serves the steps l, l + total, l + 2 * total, ... below steps
    return (numbered.filter(F.col("_line") < steps)
            .select(F.explode(F.sequence(F.col("_line"), F.lit(steps - 1).cast("long"), F.col("_total"))).alias("step"), "count"))


def find_docs(df: DataFrame, where: Column, cols: Sequence[str] | None = None, order: Sequence[Column] | None = None,
              limit: int | None = None) -> DataFrame:
    out = df.filter(where)
    if order:
        out = out.orderBy(*order)
    if limit is not None:
        out = out.limit(limit)
    return out.select(*cols) if cols else out


def page_by_ts(df: DataFrame, token, page_size: int, ts: str = "ts", id_col: str = "id") -> DataFrame:
    """Rows after the token, newest first, equal times by ascending id; ``next_token`` gives the token of a page.

    A token is a time, or the (time, id) of the last row seen, with which rows of that very time are not lost.
    """
    if token is None:
        kept = df
    elif isinstance(token, tuple):
        last, row = token
        kept = df.filter((F.col(ts) <= F.lit(last)) & ((F.col(ts) < F.lit(last)) | (F.col(id_col) > F.lit(row))))
    else:
        kept = df.filter(F.col(ts) < F.lit(token))
    return kept.orderBy(F.col(ts).desc(), F.col(id_col)).limit(page_size)


def next_token(page: DataFrame, ts: str = "ts", id_col: str = "id") -> tuple | None:
    """The (time, id) of the last row of a page, to ask for the next one; None for an empty page."""
    row = page.orderBy(F.col(ts), F.col(id_col).desc()).select(ts, id_col).first()
    return (row[0], row[1]) if row else None


def tail_n(df: DataFrame, n: int, ts: str = "ts", id_col: str = "id") -> DataFrame:
    return df.orderBy(F.col(ts).desc(), F.col(id_col).desc()).limit(n)


#: Bytes of a block of a file's digest, and of what one row may hold.
BLOCK = 1 << 22
IN_A_ROW = 1 << 26


def file_manifest(spark: SparkSession, path: str, block: int = BLOCK, in_a_row: int = IN_A_ROW) -> DataFrame:
    """(path, size, digest) of all files below a folder, by one rule for files of any size.

    The digest is the sha256 of the sha256 values (as hex, one after the other) of a file's blocks of ``block``
    bytes. Empty files are not listed, as Spark's reader passes them by. Files of up to ``in_a_row`` bytes come as rows of Spark's reader. Larger ones
    are read block by block, blocks dealt over all tasks, through the file system that their path names; that has
    to be one that Arrow knows (local and mounted folders, S3, GCS, HDFS).
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    whole = F.transform(F.sequence(F.lit(0).cast("long"), F.ceil(F.col("length") / block) - 1),
                        lambda i: F.sha2(F.substring(F.col("content"), (i * block + 1).cast("int"), F.lit(block)), 256))
    small = files.filter(F.col("length") <= in_a_row).select("path", F.col("length").alias("size"), F.sha2(F.array_join(whole, "").cast("binary"), 256).alias("digest"))
    blocks = (files.filter(F.col("length") > in_a_row).select("path", F.col("length").alias("size"))
              .withColumn("at", F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.col("size") / block) - 1))))
    read = blocks.repartition("path", "at").mapInPandas(_block_hashes(block), "path string, size long, at long, hash string")
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "hash"))), lambda b: b["hash"]), "")
    large = read.groupBy("path", "size").agg(F.sha2(joined.cast("binary"), 256).alias("digest"))
    return small.unionByName(large)


def _block_hashes(block: int):
    def run(batches):
        import hashlib
        from urllib.parse import unquote

        from pyarrow import fs
        for pdf in batches:
            hashes = []
            for path, at in zip(pdf["path"], pdf["at"]):
                local = path.startswith("file:")
                store, name = (fs.LocalFileSystem(), unquote(path.split(":", 1)[1])) if local else fs.FileSystem.from_uri(path)
                with store.open_input_file(name) as f:
                    hashes.append(hashlib.sha256(f.read_at(block, int(at) * block)).hexdigest())
            yield pdf.assign(hash=hashes)

    return run


LOG_LINE = T.StructType([T.StructField(n, T.StringType()) for n in (
    "ts", "level", "logger", "message", "module", "service", "trace_id", "span_id")] + [
    T.StructField("line", T.LongType()), T.StructField("extra", T.MapType(T.StringType(), T.StringType()))])


def scan_logs(spark: SparkSession, path) -> DataFrame:
    """Structured log lines as columns, ``ts`` as an instant."""
    return scan_jsonl(spark, path, LOG_LINE).withColumn("ts", F.try_to_timestamp("ts"))


def log_levels(logs: DataFrame) -> DataFrame:
    return logs.groupBy("service", "level").agg(F.count(F.lit(1)).alias("lines"), F.max(micros("ts")).alias("last_us"))


def read_stream(spark: SparkSession, fmt: str, options: dict[str, str], schema: T.StructType | None = None,
                path: str | None = None) -> DataFrame:
    """A stream of files, or of a topic where the kafka package is deployed."""
    reader = spark.readStream.format(fmt).options(**options)
    if schema is not None and fmt != "kafka":
        reader = reader.schema(schema)
    return reader.load(path) if path else reader.load()


def sample_rows(df: DataFrame, share: float, key: str, seed: int = 0) -> DataFrame:
    """Each row with probability ``share``, repeatable for a key and seed on any engine: by the md5 of ``<seed>:<key>``."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")).cast("binary"))
    return df.filter(F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") % 1_000_000 < int(share * 1_000_000))
