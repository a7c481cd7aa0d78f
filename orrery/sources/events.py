"""Sources of events, bundles, vectors and files."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_OWN = "bucket string, key string, size bigint, content_type string, timestamp string"
_S3 = "Records array<struct<eventName:string,eventTime:string,s3:struct<bucket:struct<name:string>,object:struct<key:string,size:bigint>>>>"


def upload_events(messages: DataFrame, value: str = "value") -> DataFrame:
    """(bucket, key, size, content_type, timestamp, error) of messages: the plain event, or a storage notification of which only created
    objects count, with their keys percent-decoded. A message with neither is a row with an error. Works on streams."""
    own = messages.select(F.col(value).cast("string").alias("raw"))
    own = own.withColumns({"plain": F.from_json("raw", _OWN), "s3": F.from_json("raw", _S3)})
    made = F.filter("s3.Records", lambda r: r["eventName"].startswith("s3:ObjectCreated:") | r["eventName"].startswith("ObjectCreated:"))
    shape = lambda b, k, s, c, t, e: F.struct(b.alias("bucket"), k.alias("key"), s.alias("size"), c.alias("content_type"), t.alias("timestamp"), e.alias("error"))
    none = F.lit(None).cast("string")
    plain = F.array(shape(F.col("plain.bucket"), F.col("plain.key"), F.col("plain.size"), F.col("plain.content_type"), F.col("plain.timestamp"), none))
    from_s3 = F.transform(made, lambda r: shape(r["s3"]["bucket"]["name"], F.try_url_decode(r["s3"]["object"]["key"]), r["s3"]["object"]["size"], none, r["eventTime"], none))
    bad = F.array(shape(none, none, F.lit(None).cast("bigint"), none, none, F.lit("no upload event")))
    rows = F.when(F.col("plain.bucket").isNotNull() & F.col("plain.key").isNotNull(), plain).when(F.coalesce(F.size(made), F.lit(0)) > 0, from_s3).otherwise(bad)
    return own.select(F.explode(rows).alias("e")).select("e.*")


def read_bundle(spark: SparkSession, path: str) -> DataFrame:
    """Lines of an NDJSON bundle with their ordinal: (ordinal, section, id, line). One file is one ordered text, read by one task; gzip
    and zstd are known by the name's ending."""
    whole = spark.read.format("binaryFile").load(path).select("content", "path")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import gzip
        import json

        for b in batches:
            for data, name in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if name.endswith(".gz"):
                    data = gzip.decompress(data)
                elif name.endswith(".zst"):
                    import zstandard

                    data = zstandard.ZstdDecompressor().stream_reader(data).read()
                lines = data.decode().split("\n")
                lines = lines[:-1] if lines and not lines[-1] else lines
                rows = [json.loads(x) if x.strip() else {} for x in lines]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(range(len(lines)), pa.int64()), pa.array([r.get("type") or r.get("section") for r in rows], pa.string()), pa.array([None if r.get("id") is None else str(r["id"]) for r in rows], pa.string()), pa.array(lines, pa.string())],
                    names=["ordinal", "section", "id", "line"],
                )

    return whole.mapInArrow(run, "ordinal long, section string, id string, line string")


def read_vecs(spark: SparkSession, path: str) -> DataFrame:
    """(ordinal, vector) of fvecs or ivecs files: each vector is a little-endian int32 dimension and that many values."""
    floats = not path.rstrip("/*").endswith("ivecs")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        for b in batches:
            for data in b.column(0).to_pylist():
                if not data:
                    continue
                (dim,) = struct.unpack_from("<i", data)
                table = np.frombuffer(data, "<i4").reshape(-1, dim + 1)
                body = np.ascontiguousarray(table[:, 1:])
                body = body.view("<f4") if floats else body
                yield pa.RecordBatch.from_arrays([pa.array(range(len(body)), pa.int64()), pa.array(list(body.astype(float)), pa.list_(pa.float64()))], names=["ordinal", "vector"])

    kind = "array<double>"
    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, f"ordinal long, vector {kind}").withColumn("vector", F.col("vector").cast("array<float>" if floats else "array<int>"))


#: Names and folders that a folder scan leaves out, and the endings it takes.
SKIPPED = r"(^|/)(\.[^/]+|node_modules|target|dist|build|vendor|__pycache__|venv)(/|$)"
SECRET = r"(^|/)(id_rsa[^/]*|[^/]*\.(pem|key|p12|pfx)|credentials[^/]*|\.env[^/]*)$"
TEXT = r"\.(txt|md|rst|rs|py|ts|tsx|js|jsx|go|java|kt|c|h|cc|cpp|hpp|cs|rb|php|swift|scala|sh|sql|json|yaml|yml|toml|html|css|xml|csv)$"
MAX_BYTES = 1 << 20


def scan_folder(spark: SparkSession, path: str) -> DataFrame:
    """(path, length, content) of text files below a folder: no hidden, dependency, credential, binary or large ones."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    root = path.rstrip("/")
    rel = F.regexp_replace("path", rf"^.*?\Q{root}\E/?", "")
    own = files.filter(F.col("length") <= MAX_BYTES).withColumn("rel", rel)
    own = own.filter(~F.col("rel").rlike(SKIPPED) & ~F.col("rel").rlike(SECRET) & F.col("rel").rlike(TEXT))
    return own.filter(F.instr(F.hex(F.substring("content", 1, 8000)), "00") % 2 == 0).select(F.col("rel").alias("path"), "length", "content")


def verified(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """Fetched objects (path, content) whose sha-256 is the manifest's (path, sha256), with ok."""
    return files.join(manifest, "path").select("path", "content", (F.sha2("content", 256) == F.col("sha256")).alias("ok"))
