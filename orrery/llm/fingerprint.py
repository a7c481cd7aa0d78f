"""Document fingerprints: mergeable bottom-k sketches of word shingles."""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SHINGLE, K = 5, 128
#: A sketch keeps the HASH_BYTES high bytes of a shingle's hash.
HASH_BYTES = 5
#: Buckets of ids for each shuffle partition.
BUCKETS_PER_PARTITION = 4
_TOP = 1 << 8 * HASH_BYTES


def shingle_hashes(text: str | None, shingle: int = SHINGLE) -> np.ndarray:
    """A hash a shingle, below _TOP. Words are separated by ASCII white space, A-Z in lower case; fewer words than a shingle's make one."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    w = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    n = min(shingle, len(words))
    h = np.full(len(words) - n + 1, n, np.uint64)
    for i in range(n):
        h = (h ^ w[i : i + len(h)]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return (h ^ (h >> np.uint64(32))) >> np.uint64(64 - 8 * HASH_BYTES)


def bottom(hashes: np.ndarray, k: int = K) -> np.ndarray:
    """The sketch: the k smallest distinct hashes, sorted."""
    if len(hashes) > 4 * k:
        small = np.unique(np.partition(hashes, 4 * k)[: 4 * k])
        if len(small) >= k:  # else repeats crowd out others
            return small[:k]
    return np.unique(hashes)[:k]


def merge(a: np.ndarray, b: np.ndarray, k: int = K) -> np.ndarray:
    """The sketch of two parts together (shingles over the seam aside)."""
    return np.union1d(a, b)[:k]


def distinct(sketch: np.ndarray, k: int = K) -> float:
    """Estimated number of distinct shingles; exact below k."""
    return float(len(sketch)) if len(sketch) < k else (k - 1) / ((int(sketch[k - 1]) + 1) / _TOP)


def resemblance(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimated share of shingles in both among those in either. Two empty sketches are alike."""
    both = merge(a, b, k)
    if not len(both):
        return 1.0
    return float(np.isin(both, np.intersect1d(a, b, True), True).sum() / len(both))


def containment(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimated share of a's shingles that are in b. The empty sketch is in any."""
    n = distinct(a, k)
    return 1.0 if not n else min(1.0, resemblance(a, b, k) * distinct(merge(a, b, k), k) / n)


def encode(sketch: np.ndarray) -> str:
    raw = sketch.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 8 - HASH_BYTES :]
    return base64.b64encode(raw.tobytes()).decode()


def decode(fingerprint: str) -> np.ndarray:
    raw = np.frombuffer(base64.b64decode(fingerprint), np.uint8).reshape(-1, HASH_BYTES)
    return np.concatenate((np.zeros((len(raw), 8 - HASH_BYTES), np.uint8), raw), axis=1).copy().view(">u8").ravel().astype(np.uint64)


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """A row a document: doc_id, n_chars, fingerprint, n_shingles (estimated distinct). No shuffle. Null text: empty. Repeated
    rows: each its own. Empty table: no rows. Other columns are ignored."""
    own = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [t or "" for t in b.column(1).to_pylist()]
            found = [bottom(shingle_hashes(t)) for t in texts]
            cols = [b.column(0), pa.array([len(t) for t in texts], pa.int64()), pa.array([encode(s) for s in found], pa.string()), pa.array([distinct(s) for s in found], pa.float64())]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "n_chars", "fingerprint", "n_shingles"])

    return own.mapInArrow(run, f"doc_id {dict(own.dtypes)['doc_id']}, n_chars long, fingerprint string, n_shingles double").withColumnRenamed("doc_id", doc_id)


def _bucket(order: Column, splits: list[int]) -> Column:
    """How many of the sorted splits are below the value, by binary search."""
    at = F.array(*[F.lit(s).cast("long") for s in splits])
    start = F.struct(F.lit(0).alias("lo"), F.lit(len(splits)).alias("hi"))

    def step(s: Column, _: Column) -> Column:
        mid = F.floor((s["lo"] + s["hi"]) / 2).cast("int")
        below = F.coalesce(F.get(at, mid) < order, F.lit(False))
        live = s["lo"] < s["hi"]
        return F.struct(F.when(live & below, mid + 1).otherwise(s["lo"]).alias("lo"), F.when(live & ~below, mid).otherwise(s["hi"]).alias("hi"))

    return F.aggregate(F.sequence(F.lit(0), F.lit(len(splits).bit_length())), start, step, lambda s: s["lo"])


def edited(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprints of each document, of its edited text and the likeness to that and to the next document's.

    In descending order of doc_id (null last; rows of one id by a hash of the text), the last third of a text (rounded down) is
    replaced by the first as many code points, or all, of the next; after the last comes the first. Texts are dealt to buckets of
    neighbouring ids between quantiles of doc_id and sorted there; the first document of each bucket is also sent to the one before,
    so no row crosses a task otherwise. A document alone is its own next. Null text: empty. Empty table: no rows.
    """
    low = -(1 << 63)
    own = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"), F.coalesce(F.col(doc_id).cast("long"), F.lit(low)).alias("ord"))
    parts = BUCKETS_PER_PARTITION * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ids = docs.select(F.coalesce(F.col(doc_id).cast("long"), F.lit(low)).alias("ord"))
    splits = sorted({int(x) for x in ids.filter(F.col("ord") > low).approxQuantile("ord", [i / parts for i in range(1, parts)], 0.2 / parts)})
    bucket = _bucket(F.col("ord"), splits) if splits else F.lit(0)
    # one row a bucket that holds documents: at most `parts`, by the number of splits
    heads = {r["b"]: r["top"] for r in ids.groupBy(bucket.alias("b")).agg(F.max("ord").alias("top")).collect()}
    filled = sorted(heads)
    to = {heads[b]: filled[(i + 1) % len(filled)] for i, b in enumerate(filled)}  # its predecessor in descending order is the bucket above
    guests = F.create_map(*[x for k, v in to.items() for x in (F.lit(k).cast("long"), F.lit(v))]) if to else F.create_map().cast("map<bigint,int>")
    host = F.struct(F.col("home").alias("bucket"), F.lit(0).alias("guest"))
    guest = F.struct(F.get(F.map_values(F.map_filter(guests, lambda k, _: k == F.col("ord"))), F.lit(0)).alias("bucket"), F.lit(1).alias("guest"))
    is_head = F.col("ord").isin(*to) if to else F.lit(False)
    rows = own.withColumn("home", bucket.cast("int")).withColumn("at", F.explode(F.when(is_head, F.array(host, guest)).otherwise(F.array(host))))
    rows = rows.select("at.bucket", "at.guest", "ord", F.xxhash64("text").alias("tie"), "doc_id", "text")
    dealt = rows.repartition(len(filled) or 1, "bucket").sortWithinPartitions("bucket", "guest", F.desc("ord"), "tie")
    kind = dict(own.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for b in batches:
            out = []
            for bucket, guest, doc, text in zip(*[b.column(i).to_pylist() for i in (0, 1, 4, 5)], strict=True):
                now = (bucket, guest, doc, text, bottom(shingle_hashes(text)))
                if held and held[0] == bucket and not held[1]:
                    out.append(_edit(held, now))
                held = now
            if out:
                cols = zip(*out, strict=True)
                types = (b.schema.field(4).type, pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=_NAMES)

    schema = f"doc_id {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return dealt.mapInArrow(run, schema).withColumnRenamed("doc_id", doc_id)


_NAMES = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]


def _edit(row: tuple, after: tuple) -> tuple:
    text, sketch = row[3], row[4]
    third = len(text) // 3
    changed = text[: len(text) - third] + after[3][:third]
    other = bottom(shingle_hashes(changed))
    sha = hashlib.sha256(changed.encode("utf-8", "surrogatepass")).hexdigest()
    return row[2], len(text), sha, encode(sketch), encode(other), resemblance(sketch, other), resemblance(sketch, after[4])
