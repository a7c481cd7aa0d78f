"""Lexical retrieval packing: documents are dealt to shards by their weightiest term; the BM25 index of a shard gives each seed its
unused neighbours, which fill its window."""

from __future__ import annotations

import base64
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orrery.llm.common import process_cache, stored
from orrery.llm.segments import Codes, groups

WINDOW, END_ID, VOCAB = 1024, 0, 50257
#: Documents a shard holds, about: its index fits in a task many times over, whatever the corpus holds.
SHARD_DOCS = 10240
K1, B = 1.2, 0.75
#: Terms that more than one in COMMON documents of a shard hold are rows of a matrix, the others are posting lists; seeds scored at a time.
COMMON, SEEDS = 32, 128
#: Key of a document without a term that another one holds.
NO_KEY = -1


def default_ranks() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def _ascii(test: Callable[[str], bool]) -> np.ndarray:
    return np.array([i < 128 and test(chr(i)) for i in range(256)])


_ALNUM, _SIGN = _ascii(str.isalnum), _ascii(lambda c: c.isprintable() and not c.isalnum() and c != " ")


class Encoder:
    """Ids of the byte-level BPE as unsigned 16-bit numbers. No id spans a single space or line end between two non-spaces, nor goes
    on from an ASCII letter or digit to a sign, so texts are cut there and equal parts are encoded once. Texts with other
    runs of white space are encoded whole."""

    def __init__(self, ranks: str):
        import public_tokenizers
        import tiktoken

        with open(ranks, "rb") as f:
            table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        plain = tiktoken.Encoding("byte_bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={}).encode_ordinary
        self.codes = Codes(lambda part: plain(part.decode("utf-8", "surrogatepass")), "<u2")

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        made = [t.encode("utf-8", "surrogatepass") for t in texts]
        out: list[np.ndarray] = []
        for lo, hi in groups([len(m) for m in made]):
            raw, ends = b"".join(made[lo:hi]), np.cumsum([len(m) for m in made[lo:hi]])
            b, starts = np.frombuffer(raw, np.uint8), np.append(0, ends[:-1])
            begins = (b == 32) | (b == 10)
            begins[1:] |= _SIGN[b[1:]] & _ALNUM[b[:-1]]
            for t, i, j in zip(texts[lo:hi], starts.tolist(), ends.tolist(), strict=True):
                if t and " ".join(t.split()) != t.replace("\n", " "):
                    begins[i:j] = False
            begins[starts[starts < ends]] = True
            first = np.flatnonzero(begins)
            ids, before = self.codes(raw, first)
            out += [ids[before[i] : before[j]] for i, j in zip(np.searchsorted(first, starts), np.searchsorted(first, ends), strict=True)]
        return out


def _counted(ids: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct ids of each document with their counts over its whole text, and how many of them come before each document."""
    doc = np.repeat(np.arange(len(ids), dtype=np.int64), [len(x) for x in ids])
    key, tf = np.unique(doc << 16 | np.concatenate([*ids, np.zeros(0, "<u2")]), return_counts=True)
    return (key & 0xFFFF).astype("<u2"), tf.astype("<u4"), np.searchsorted(key, np.arange(len(ids) + 1, dtype=np.int64) << 16)


def tokenized(docs: DataFrame, doc_id: str, text: str, ranks: str) -> DataFrame:
    """A row a document: seq (a number of its own), doc_id, n_tokens with the end id, the checksums of its full windows, the ids
    after them, the distinct ids of the whole text and their counts (arrays of unsigned little-endian numbers: 32, 16, 16, 32 bits)."""
    own = docs.select(F.monotonically_increasing_id().alias("seq"), F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    kind = dict(own.dtypes)["doc_id"]
    end = np.array([END_ID], "<u2")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = process_cache(f"bpe:{ranks}", lambda: Encoder(ranks))
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                b = batch.slice(at, 2048)
                found = encoder.encode([t or "" for t in b.column(2).to_pylist()])
                terms, tf, first = _counted(found)
                n, full, rest = [], [], []
                for x in found:
                    ids = np.append(x, end)
                    cut = len(ids) // WINDOW * WINDOW
                    n.append(len(ids))
                    full.append(np.array([zlib.crc32(ids[i : i + WINDOW].astype("<u4")) for i in range(0, cut, WINDOW)], "<u4").tobytes())
                    rest.append(ids[cut:].tobytes())
                spans = list(zip(first[:-1].tolist(), first[1:].tolist(), strict=True))
                made = (full, rest, [terms[i:j].tobytes() for i, j in spans], [tf[i:j].tobytes() for i, j in spans])
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(n, pa.int64()), *[pa.array(m, pa.binary()) for m in made]], names=["seq", "doc_id", "n_tokens", "full", "rest", "terms", "tf"])

    return own.mapInArrow(run, f"seq long, doc_id {kind}, n_tokens long, full binary, rest binary, terms binary, tf binary")


def _read(terms: list[bytes], tf: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The terms of some documents, one after the other, with the number of each's document and their counts."""
    term = np.frombuffer(b"".join(terms), "<u2").astype(np.int64)
    of = np.repeat(np.arange(len(terms)), [len(t) // 2 for t in terms])
    return term, of, np.frombuffer(b"".join(tf), "<u4").astype(np.int64)


def _document_frequencies(rows: DataFrame) -> tuple[np.ndarray, int, float]:
    """df of every id, the number of documents and the mean number of ids, over all documents. At most VOCAB rows reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n, length = np.zeros(VOCAB, np.int64), 0, 0
        for b in batches:
            term, _, tf = _read(b.column(0).to_pylist(), b.column(1).to_pylist())
            df += np.bincount(term, minlength=VOCAB)
            n, length = n + b.num_rows, length + int(tf.sum())
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, [-1, -2])), pa.array(np.append(df[at], [n, length]))], names=["id", "n"])

    got = {r["id"]: r["n"] for r in rows.select("terms", "tf").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect()}
    n, length = got.pop(-1, 0), got.pop(-2, 0)
    df = np.zeros(VOCAB, np.int64)
    df[list(got)] = list(got.values())
    return df, n, length / max(n, 1)


def _weights(term: np.ndarray, of: np.ndarray, tf: np.ndarray, n: int, idf: np.ndarray, mean_length: float) -> np.ndarray:
    """BM25 weights of the terms of n documents."""
    length = np.bincount(of, tf, n)
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * length[of] / max(mean_length, 1.0))) * idf[term]


def _keyed(rows: DataFrame, idf: np.ndarray, mean_length: float, df: np.ndarray) -> DataFrame:
    """rows with key, the weightiest term of each document that another document holds too, or NO_KEY. Of equal weights, the smallest."""
    shared = np.where(df > 1, idf, 0.0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            term, of, tf = _read(b.column("terms").to_pylist(), b.column("tf").to_pylist())
            w = _weights(term, of, tf, b.num_rows, shared, mean_length)
            best = np.zeros(b.num_rows)
            np.maximum.at(best, of, w)
            at = np.flatnonzero((w == best[of]) & (w > 0))
            doc, first = np.unique(of[at], return_index=True)
            key = np.full(b.num_rows, NO_KEY, np.int32)
            key[doc] = term[at[first]]
            yield b.append_column("key", pa.array(key))

    schema = ", ".join(f"{k} {v}" for k, v in rows.dtypes)
    return rows.mapInArrow(run, f"{schema}, key int")


def _powers(n: int) -> list[int]:
    return [1 << i for i in range(n.bit_length() - 1, -1, -1) if n >> i & 1]


def _shards(counts: dict[int, int]) -> list[tuple[int, int, int]]:
    """(key, first shard, shards) of every key: a key with more than SHARD_DOCS documents has shards of its own, others share one."""
    out, shard, room = [], -1, 0
    for key in sorted(counts):
        many = max(1, -(-counts[key] // SHARD_DOCS))
        if counts[key] > room:
            out.append((key, shard + 1, many))
            shard, room = shard + many, SHARD_DOCS - counts[key] if many == 1 else 0
        else:
            out.append((key, shard, 1))
            room -= counts[key]
    return out


class Index:
    """BM25 index of a shard: the rows of common terms as a matrix, the others as posting lists. Columns are the documents live when
    it was built, in their order."""

    def __init__(self, term: np.ndarray, of: np.ndarray, weight: np.ndarray, live: np.ndarray):
        self.docs = np.flatnonzero(live)
        column = np.cumsum(live) - 1
        keep = live[of]
        term, of, weight = term[keep], column[of[keep]], weight[keep]
        count = np.bincount(term, minlength=VOCAB)
        common = count * COMMON > len(self.docs)
        self.row = np.where(common, np.cumsum(common) - 1, -1)
        self.matrix = np.zeros((int(common.sum()), len(self.docs)), np.float32)
        dense = common[term]
        self.matrix[self.row[term[dense]], of[dense]] = weight[dense]
        term, of, weight = term[~dense], of[~dense], weight[~dense]
        order = np.argsort(term, kind="stable")
        self.of, self.weight = of[order], weight[order].astype(np.float32)
        self.first = np.searchsorted(term[order], np.arange(VOCAB + 1))

    def scores(self, queries: list[np.ndarray]) -> np.ndarray:
        """A row a query (its distinct terms): the score of every column."""
        q = np.zeros((len(queries), len(self.matrix)), np.float32)
        for i, ids in enumerate(queries):
            rows = self.row[ids]
            q[i, rows[rows >= 0]] = 1
        out = q @ self.matrix
        for i, ids in enumerate(queries):
            for t in ids[self.row[ids] < 0].tolist():
                a, b = self.first[t], self.first[t + 1]
                out[i, self.of[a:b]] += self.weight[a:b]
        return out


def pack_shard(left: np.ndarray, term: np.ndarray, of: np.ndarray, tf: np.ndarray, idf: np.ndarray, mean_length: float) -> list[list[tuple[int, int, int]]]:
    """Sequences of (document, start, length) over what is left of a shard's documents; left: their numbers of ids. term, of, tf: the
    terms of their whole texts, by document.

    Seeds are the documents not used up, in the order of what they had at first, the longest first. Each asks with all its terms; neighbours follow by BM25 score, then by place; the one
    that overfills is cut, and its rest stays unused. What is left at the end is cut into powers of two, so nothing is padded. Seeds
    are scored some at a time against the documents live then; the index is built anew whenever half of its documents are used."""
    n = len(left)
    weight = _weights(term, of, tf, n, idf, mean_length)
    first = np.searchsorted(of, np.arange(n + 1))
    start, left = np.zeros(n, np.int64), left.astype(np.int64)
    order = [i for i in np.argsort(-left, kind="stable").tolist() if left[i]]
    live = left > 0
    index, out, at = Index(term, of, weight, live), [], 0
    while at < len(order):
        if 2 * live.sum() < len(index.docs):
            index = Index(term, of, weight, live)
        seeds = []
        while at < len(order) and len(seeds) < SEEDS:
            if live[order[at]]:
                seeds.append(order[at])
            at += 1
        rows = index.scores([term[first[i] : first[i + 1]] for i in seeds])
        for seed, scores in zip(seeds, rows, strict=True):
            if not live[seed]:
                continue
            window, gap = [(seed, int(start[seed]), int(left[seed]))], WINDOW - int(left[seed])
            live[seed], left[seed] = False, 0
            scores[~live[index.docs]] = -1
            while gap:
                top = int(np.argmax(scores))
                if scores[top] < 0:
                    break
                doc, scores[top] = int(index.docs[top]), -1
                take = min(gap, int(left[doc]))
                window.append((doc, int(start[doc]), take))
                start[doc], left[doc], gap = start[doc] + take, left[doc] - take, gap - take
                live[doc] = left[doc] > 0
            out.append(window)
    return [part for window in out for part in _cut(window)]


def _cut(window: list[tuple[int, int, int]]) -> list[list[tuple[int, int, int]]]:
    """A window that isn't full as sequences of powers of two."""
    sizes = [WINDOW] if (total := sum(p[2] for p in window)) == WINDOW else _powers(total)
    out, pieces = [], list(reversed(window))
    for size in sizes:
        part = []
        while size:
            d, s, n = pieces.pop()
            if n > size:
                pieces.append((d, s + size, n - size))
                n = size
            part.append((d, s, n))
            size -= n
        out.append(part)
    return out


def pack(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", ranks: str | None = None) -> DataFrame:
    """A row a piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A document's ids are those of the byte-level BPE and then END_ID. Full windows of a long document are sequences of their own.
    What is left of each (at most WINDOW - 1 ids) is dealt by the document's weightiest term to shards of about SHARD_DOCS documents,
    and packed there; a term with more documents than that has several shards, dealt by hash. A seed's neighbours are the best of its
    shard by all terms of both whole texts: up to SHARD_DOCS documents those of the corpus, beyond that documents dealt elsewhere are
    not reached. Document frequencies are over all documents. Every id lies in one piece; every sequence is full or a power of two.

    Null or empty text: END_ID alone. Repeated rows and equal ids: documents of their own. Null doc_id: kept as null. Empty
    table: no rows. Other columns are ignored. A very long text is held once, with its ids, by the task that reads it.
    """
    rows = stored(tokenized(docs, doc_id, text, ranks or default_ranks()), "packing-ids")
    df, n, mean_length = _document_frequencies(rows)
    idf = np.log1p((n - df + 0.5) / (df + 0.5))
    kind = dict(rows.dtypes)["doc_id"]
    # a row a term: at most VOCAB
    keys = _keyed(rows.select("terms", "tf"), idf, mean_length, df)
    counts = {r["key"]: r["n"] for r in keys.groupBy("key").agg(F.count("*").alias("n")).collect()}
    placed = _shards(counts)
    places = docs.sparkSession.createDataFrame(placed, "key int, first long, many long")

    def run(key: tuple, g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("seq")
        tokens, rest = g["n_tokens"].tolist(), g["rest"].tolist()
        pieces, seq = [], 0
        for d, full in enumerate(g["full"]):
            for j, crc in enumerate(np.frombuffer(full, "<u4").tolist()):
                pieces.append((d, j * WINDOW, WINDOW, crc, seq, 0))
                seq += 1
        term, of, tf = _read(g["terms"].tolist(), g["tf"].tolist())
        for sequence in pack_shard(np.array([len(r) // 2 for r in rest]), term, of, tf, idf, mean_length):
            at = 0
            for d, s, size in sequence:
                pieces.append((d, tokens[d] // WINDOW * WINDOW + s, size, zlib.crc32(np.frombuffer(rest[d], "<u2")[s : s + size].astype("<u4")), seq, at))
                at += size
            seq += 1
        out = pd.DataFrame(pieces, columns=["d", "start", "length", "ids_crc32", "sequence_id", "offset"])
        out["sequence_id"] += int(key[0]) << 32
        out["doc_id"], out["doc_tokens"] = g["doc_id"].to_numpy()[out["d"]], np.array(tokens)[out["d"]]
        return out[["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]]

    # as text, for pandas would turn integers with nulls into floats
    dealt = _keyed(rows, idf, mean_length, df).join(F.broadcast(places), "key").drop("key")
    dealt = dealt.withColumns({"shard": F.col("first") + F.pmod(F.xxhash64("seq"), F.col("many")), "doc_id": F.col("doc_id").cast("string")}).drop("first", "many")
    schema = "doc_id string, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    # few shards a task, however many there are
    dealt = dealt.repartition(2 * max((first + many for _, first, many in placed), default=1), "shard")
    return dealt.groupBy("shard").applyInPandas(run, schema).withColumn("doc_id", F.col("doc_id").cast(kind)).withColumnRenamed("doc_id", doc_id)
