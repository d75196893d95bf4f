"""Scans, sinks, batch envelopes, registries of metrics and claims."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Names of files that Spark unpacks as it reads their lines, and the mark of byte order that it drops before the first.
PACKED, MARK = r"\.(deflate|gz|bz2|lz4|snappy|zst|passthrough)$", bytearray(b"\xef\xbb\xbf")

def scan_csv(spark: SparkSession, path: str, schema: StructType | str, blank_as_null: bool = True) -> DataFrame:
    """CSV with a declared schema, so ids stay strings. Blank fields are null, or empty strings if not ``blank_as_null``."""
    if blank_as_null:
        return spark.read.schema(schema).option("header", True).option("nullValue", "").csv(path)
    return spark.read.schema(schema).option("header", True).option("nullValue", "\u0000").option("emptyValue", "").csv(path).fillna("")


def scan_parquet(spark: SparkSession, path: str, columns: Sequence[str]) -> DataFrame:
    return spark.read.parquet(path).select(*columns)


def write_table(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "errorifexists", partition_by: Sequence[str] = ()) -> None:
    """Parquet or CSV with a header. By default an existing table is an error; mode "append" adds a batch."""
    w = df.write.format(fmt).mode(mode).partitionBy(*partition_by)
    (w.option("header", True) if fmt == "csv" else w).save(path)


def flatten_batches(df: DataFrame, payload: str, schema: str, batch: Column, success: Column, key: str) -> DataFrame:
    """JSON payloads of the successful batches as columns; the last batch of a key wins."""
    d = df.where(success).withColumn("_p", F.from_json(payload, schema)).withColumn("_b", batch)
    fields = [n.split(" ")[0] for n in schema.split(", ")]
    g = d.groupBy(key).agg(F.max_by(F.struct(*(F.col(f"_p.{n}").alias(n) for n in fields)), "_b").alias("_r"))
    return g.select(key, *(F.col(f"_r.{n}").alias(n) for n in fields))


def missing_ids(requested: DataFrame, returned: DataFrame, key: str) -> DataFrame:
    """Every requested id with RETURNED or REVIEW_NEEDED."""
    got = returned.select(F.col(key).alias("_k")).distinct()
    j = requested.select(key).distinct().join(got.hint("merge"), F.col(key) == F.col("_k"), "left")
    return j.select(key, F.when(F.col("_k").isNull(), "REVIEW_NEEDED").otherwise("RETURNED").alias("status"))


def file_manifest(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(file, bytes, sha256) of every file below ``path`` whose name fits ``pattern``, read where it lies. Empty files are not read.

    A file is read in pieces, as lines whatever its bytes are, and put together again in order while it is hashed: its hash is one task's
    work, but what that task holds is a few pieces. One row is what lies between two line feeds. Files by whose names Spark would unpack
    them are rows as a whole, so they may have 2 GB at most."""
    found = lambda kind: spark.read.format(kind).option("recursiveFileLookup", True).option("pathGlobFilter", pattern)
    where, name = F.col("_metadata.file_path"), F.element_at(F.split("path", "/"), -1).alias("file")
    packed = where.rlike(PACKED)
    whole = found("binaryFile").load(path).where(packed).select(name, F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))
    lines = found("text").option("lineSep", "\n").load(path).where(~packed)
    lines = lines.select(F.xxhash64(where).alias("key"), F.col("_metadata.file_block_start").alias("start"), F.col("value").cast("binary").alias("line"))
    pieces = lines.mapInArrow(_pieces, "key long, start long, at long, piece binary")
    hashed = pieces.repartition("key").sortWithinPartitions("key", "start", "at").mapInArrow(_hashes, "key long, n long, hashes array<string>")
    files = found("binaryFile").load(path).where(~packed).select(name, F.col("length").alias("bytes"), F.xxhash64(where).alias("_key"))
    j = files.join(hashed.hint("merge"), F.col("_key") == F.col("key"), "left").withColumn("_off", F.col("bytes") - F.coalesce("n", F.lit(0)))
    # a last line feed that was not there, and a mark of byte order that was: neither is told by lines
    place = F.when(F.col("_off") == 0, 0).when(F.col("_off") == -1, 1).when(F.col("_off") == 3, 2).when(F.col("_off") == 2, 3)
    sha = F.coalesce(F.get("hashes", place), F.when((F.col("bytes") == 3) & F.col("n").isNull(), F.sha2(F.lit(MARK), 256)), F.raise_error(F.concat(F.lit("changed while it was read: "), "file")))
    return whole.unionByName(j.select("file", "bytes", sha.alias("sha256")))


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, start, line) in order -> (key, start, at, piece): whole lines with their line feeds, some of a file's split, in order."""
    at = 0
    for b in batches:
        key, start, line = b.column(0).to_numpy(), b.column(1).to_numpy(), b.column(2)
        edges = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (start[1:] != start[:-1])])) if len(key) else []
        for i, j in zip(edges, [*edges[1:], len(key)], strict=True):
            piece = b"\n".join([*line.slice(i, j - i).to_pylist(), b""])
            yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in ((key[i], pa.int64()), (start[i], pa.int64()), (at, pa.int64()), (piece, pa.binary()))], names=["key", "start", "at", "piece"])
            at += 1


def _hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces in order -> (key, n: bytes, hashes) of each file: of all, without the last byte, and both after a mark of byte order."""

    def told() -> pa.RecordBatch:
        out = []
        for h in (plain, marked):
            end = h.copy()
            end.update(last)
            out += [end.hexdigest(), h.hexdigest()]
        return pa.RecordBatch.from_arrays([pa.array([key]), pa.array([n]), pa.array([out], pa.list_(pa.string()))], names=["key", "n", "hashes"])

    key = None
    for b in batches:
        for i in range(b.num_rows):
            if (now := b.column(0)[i].as_py()) != key:
                if key is not None:
                    yield told()
                key, n, last, plain, marked = now, 0, b"", sha256(), sha256(MARK)
            piece = memoryview(b.column(3)[i].as_buffer())
            for h in (plain, marked):
                h.update(last)
                h.update(piece[:-1])
            last, n = bytes(piece[-1:]), n + len(piece)
    if key is not None:
        yield told()


def compare_manifests(before: DataFrame, after: DataFrame) -> DataFrame:
    """(file, status): SAME, CHANGED, ADDED or REMOVED for every file of two manifests."""
    a, b = before.select("file", F.col("sha256").alias("_a")), after.select("file", F.col("sha256").alias("_b"))
    status = F.when(F.col("_a").isNull(), "ADDED").when(F.col("_b").isNull(), "REMOVED").when(F.col("_a") == F.col("_b"), "SAME").otherwise("CHANGED")
    return a.join(b, "file", "full").select("file", status.alias("status"))


def metrics_registry(metrics: Sequence[tuple[str, str, DataFrame, Column, str]]) -> DataFrame:
    """(category, metric, value, source) rows, each an aggregate over a table."""
    out = None
    for category, metric, df, value, source in metrics:
        row = df.agg(value.cast("double").alias("value")).select(F.lit(category).alias("category"), F.lit(metric).alias("metric"), "value", F.lit(source).alias("source"))
        out = row if out is None else out.unionByName(row)
    return out


def check_claims(registry: DataFrame, expected: Mapping[str, float], tolerance: float = 1e-9) -> DataFrame:
    """PASS, FAIL or NOT_COMPUTED for each claimed metric."""
    spark = registry.sparkSession
    claims = spark.createDataFrame([(k, float(v)) for k, v in expected.items()], "metric string, expected double")
    j = claims.join(registry.select("metric", "value"), "metric", "left")
    return j.withColumn("status", F.when(F.col("value").isNull(), "NOT_COMPUTED").when(F.abs(F.col("value") - F.col("expected")) <= tolerance, "PASS").otherwise("FAIL"))
