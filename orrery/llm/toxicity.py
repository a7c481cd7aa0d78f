"""Toxicity: a factorization machine over hashed terms, fitted on a bounded sample of labelled documents."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Hash buckets of terms; factors of a term; labelled documents a class that the fit takes at most (by hash of the id, the same
#: every time); evidence of a term's own counts from which it is kept; that of a pair's, from which both its terms are kept.
BUCKETS, FACTORS, SAMPLE_PER_CLASS, EVIDENCE, PAIR_EVIDENCE = 1 << 22, 4, 6000, 3.0, 6.0
#: Terms whose pairs are counted at a time with as many others.
BLOCK = 512
EPOCHS, RATE, L2, PREFIX = 100, 0.05, 2e-4, 5
#: Documents of ids with this remainder are held out.
PARTS, HELD_OUT = 4, 2
_MARKS = bytes.maketrans(
    b"ABCDEFGHIJKLMNOPQRSTUVWXYZ!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~",
    b"abcdefghijklmnopqrstuvwxyz                                ",
)


def terms(text: str | None) -> np.ndarray:
    """Distinct hashed terms of a whole text: its words, and the first PREFIX bytes of its longer words."""
    words = set((text or "").encode("utf-8", "surrogatepass").translate(_MARKS).split())
    words |= {b"\x00" + w[:PREFIX] for w in words if len(w) > PREFIX}
    return np.unique(np.fromiter(map(zlib.crc32, words), np.int64, len(words)) % BUCKETS)


@dataclass
class Model:
    """Kept buckets, sorted; bias; weights; factors."""

    kept: np.ndarray
    bias: float
    w: np.ndarray
    v: np.ndarray

    def score(self, found: np.ndarray) -> float:
        """Probability of toxic, by the bias, the weights and the pairs of the kept terms found."""
        at = np.searchsorted(self.kept, found)
        at = at[(at < len(self.kept)) & (self.kept[np.minimum(at, len(self.kept) - 1)] == found)] if len(self.kept) else at[:0]
        x = self.v[at]
        z = self.bias + self.w[at].sum() + 0.5 * ((x.sum(axis=0) ** 2).sum() - (x**2).sum())
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def _sums(index: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    if values.ndim == 1:
        return np.bincount(index, values, n)
    return np.stack([np.bincount(index, values[:, f], n) for f in range(values.shape[1])], axis=1)


def _log_ratio(seen: np.ndarray, expected: np.ndarray) -> np.ndarray:
    return seen * np.log(np.where(seen > 0, seen, 1) / np.where(seen > 0, expected, 1))


def _paired(row: np.ndarray, col: np.ndarray, toxic: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether a term tells together with another, whatever it tells alone. row, col: documents and terms; a, b: toxic and other
    documents of a term.

    The documents of a pair must be toxic more often than all, than those of either term and than the two terms' log odds added up
    give, or less often than all of these, by a likelihood ratio of PAIR_EVIDENCE squared: that is what chance leaves of some 10^8
    pairs. Every pair that can reach it is counted: it takes as many toxic (or other) documents as if it were in no others.
    """
    p, m = toxic.mean(), len(toxic)
    enough = PAIR_EVIDENCE**2 / 2
    at = np.flatnonzero((a >= enough / -np.log(p)) | (b >= enough / -np.log1p(-p)))
    base, odds = np.log(p / (1 - p)), np.log((a[at] + 0.5) / (b[at] + 0.5))
    order = np.argsort(col, kind="stable")
    row, first = row[order], np.searchsorted(col[order], np.arange(len(a) + 1))
    found = np.zeros(len(a), bool)

    def dense(ids: np.ndarray) -> np.ndarray:
        x = np.zeros((m, len(ids)), np.float32)
        for k, i in enumerate(ids.tolist()):
            x[row[first[i] : first[i + 1]], k] = 1
        return x

    for i in range(0, len(at), BLOCK):
        x = dense(at[i : i + BLOCK])
        bad = x * toxic[:, None].astype(np.float32)
        for j in range(i, len(at), BLOCK):
            y = dense(at[j : j + BLOCK]) if j > i else x
            n, c = (x.T @ y).astype(float), (bad.T @ y).astype(float)
            one, two = odds[i : i + BLOCK, None], odds[None, j : j + BLOCK]
            high = np.maximum(np.maximum(one + two - base, base), np.maximum(one, two))
            low = np.minimum(np.minimum(one + two - base, base), np.minimum(one, two))
            high, low = 1 / (1 + np.exp(-high)), 1 / (1 + np.exp(-low))
            q = n * np.where(c > n * high, high, np.where(c < n * low, low, c / np.maximum(n, 1)))
            told = _log_ratio(c, q) + _log_ratio(n - c, n - q) >= enough
            if i == j:
                np.fill_diagonal(told, False)
            found[at[i : i + BLOCK]] |= told.any(axis=1)
            found[at[j : j + BLOCK]] |= told.any(axis=0)
    return found


def fit(docs: list[np.ndarray], toxic: np.ndarray, share: float, seed: int = 7) -> Model:
    """A factorization machine with logistic loss, by full-batch Adam, over the terms that tell alone or with another. share: of toxic documents where the scores are used; the
    sample may hold another one, and the bias is moved by the difference of the log odds."""
    toxic = np.asarray(toxic, float)
    pos, neg = toxic.sum(), (1 - toxic).sum()
    if not pos or not neg:
        p = min(max(share, 1e-3), 1 - 1e-3)
        return Model(np.zeros(0, np.int64), float(np.log(p / (1 - p))), np.zeros(0), np.zeros((0, FACTORS)))
    row = np.repeat(np.arange(len(docs)), [len(d) for d in docs])
    names, col = np.unique(np.concatenate(docs), return_inverse=True)
    a, n = np.bincount(col, toxic[row]), np.bincount(col)
    b = n - a
    z = (np.log((a + 0.5) / (pos - a + 0.5)) - np.log((b + 0.5) / (neg - b + 0.5))) / np.sqrt(1 / (a + 0.5) + 1 / (b + 0.5) + 1 / (pos - a + 0.5) + 1 / (neg - b + 0.5))
    ok = np.flatnonzero((np.abs(z) >= EVIDENCE) | _paired(row, col, toxic, a, b))
    place = np.full(len(names), -1)
    place[ok] = np.arange(len(ok))
    used = place[col] >= 0
    row, col, m, size = row[used], place[col[used]], len(docs), len(ok)
    rng = np.random.default_rng(seed)
    bias, w, v = float(np.log(pos / neg)), np.zeros(size), rng.normal(0, 0.02, (size, FACTORS))
    state = [[np.zeros_like(x), np.zeros_like(x)] for x in (np.zeros(1), w, v)]
    for t in range(1, EPOCHS + 1):
        x = v[col]
        s = _sums(row, x, m)
        y = bias + np.bincount(row, w[col], m) + 0.5 * ((s**2).sum(axis=1) - np.bincount(row, (x**2).sum(axis=1), m))
        g = 1 / (1 + np.exp(-np.clip(y, -30, 30))) - toxic
        gr = g[row]
        grads = (np.array([g.mean()]), _sums(col, gr, size) / m + L2 * w, _sums(col, gr[:, None] * (s[row] - x), size) / m + L2 * v)
        steps = []
        for (m1, m2), d in zip(state, grads, strict=True):
            m1 *= 0.9
            m1 += 0.1 * d
            m2 *= 0.99
            m2 += 0.01 * d * d
            steps.append(RATE * (m1 / (1 - 0.9**t)) / (np.sqrt(m2 / (1 - 0.99**t)) + 1e-8))
        bias, w, v = bias - float(steps[0][0]), w - steps[1], v - steps[2]
    p = min(max(share, 1e-4), 1 - 1e-4)
    return Model(names[ok], bias + float(np.log(p / (1 - p)) - np.log(pos / neg)), w, v)


def _remainder(doc_id: str):
    return F.pmod(F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")), F.lit(PARTS))


def sample(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic") -> tuple[list[np.ndarray], np.ndarray, float]:
    """Terms and labels of at most SAMPLE_PER_CLASS documents a class, none held out, and the share of toxic labels."""
    own = labels.select(F.col(doc_id).alias("doc_id"), F.col(label).cast("int").alias("y")).filter("y in (0, 1) and doc_id is not null")
    own = own.groupBy("doc_id").agg(F.max("y").alias("y")).filter(_remainder("doc_id") != HELD_OUT)
    counts = {r["y"]: r["n"] for r in own.groupBy("y").agg(F.count("*").alias("n")).collect()}
    chosen = [own.filter(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE_PER_CLASS) for y in (0, 1)]
    few = F.broadcast(chosen[0].unionByName(chosen[1]))  # 2 * SAMPLE_PER_CLASS rows at most
    texts = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).join(few, "doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array([terms(t.as_py()).astype("<i4").tobytes() for t in b.column(1)], pa.binary())], names=["doc_id", "y", "terms"])

    kind = dict(texts.dtypes)["doc_id"]
    got = texts.select("doc_id", "text", "y").mapInArrow(run, f"doc_id {kind}, y int, terms binary").dropDuplicates(["doc_id"]).toArrow().sort_by("doc_id")
    found = [np.frombuffer(x, "<i4").astype(np.int64) for x in got["terms"].to_pylist()]
    return found, np.array(got["y"].to_pylist(), float), (counts.get(1, 0) + 0.5) / (sum(counts.values()) + 1)


def score(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic", threshold: float = 0.3) -> DataFrame:
    """A row a document: doc_id, held_out, score (0 to 1), predicted (1 if score >= threshold).

    The text alone makes the score. Null or empty text: no terms, the bias alone. Null doc_id: scored, never learnt from; its id
    counts as the empty text. Repeated rows: scored apart. Repeated labels of an id: toxic if one says so. No labels of one class:
    the prior alone. Empty table: no rows. Other columns are ignored.
    """
    model = fit(*sample(docs, labels, doc_id, text, label))
    own = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([model.score(terms(t.as_py())) for t in b.column(1)], pa.float64())], names=["doc_id", "score"])

    scored = own.mapInArrow(run, f"doc_id {dict(own.dtypes)['doc_id']}, score double")
    return scored.select(F.col("doc_id").alias(doc_id), (_remainder("doc_id") == HELD_OUT).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
