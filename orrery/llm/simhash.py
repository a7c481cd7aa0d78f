"""SimHash near-duplicates: whole-text fingerprints, pigeonhole blocks, exact verification, connected components."""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orrery.llm.common import lookup, stored
from orrery.llm.fingerprint import shingle_hashes

SHINGLE, SEED, BITS, BLOCKS, MAX_DIFF = 3, 42, 64, 4, 2
#: Distinct fingerprints of one block value up to which all its pairs are compared; a fuller block is linked by midpoints.
PAIRS_UP_TO = 64
_CHUNK = 1 << 15
#: Near-duplicates by shingles: words a shingle, least similarity, parts of the shingles that have blocks, mean shingles of a part at most.
WORDS, SIMILARITY, PARTS, PART_SHINGLES = 5, 0.8, 32, 4
#: Sets in a block up to which all its pairs are compared; a fuller one is linked through a leader.
SMALL = 8
#: Differing bits of whole fingerprints up to which a pair is verified: 5.7 standard errors above what SIMILARITY gives.
FAR = 26
#: Bits of a shingle's hash that name the counter of its frequency: 2 MB of counters.
RARE_BITS = 18


def simhash(text: str | None, shingle: int = SHINGLE) -> int:
    """Unsigned 64-bit fingerprint: a bit is set if it is set in over half of the shingles' XXH64."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z only, ASCII white space only
    if not words:
        return 0
    joined, n = b" ".join(words), max(1, len(words) - shingle + 1)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    spans = zip(starts[:n].tolist(), ends[min(shingle, len(words)) - 1 :].tolist(), strict=True)
    h = np.fromiter((xxhash.xxh64_intdigest(joined[a:b], SEED) for a, b in spans), np.uint64, n).astype("<u8")
    counts = np.zeros(BITS, np.int64)
    for at in range(0, n, _CHUNK):
        counts += np.unpackbits(h[at : at + _CHUNK].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, fp): a row a document, fp the fingerprint as a signed long. No shuffle; a text is read whole, one at a time."""
    own = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.fromiter((simhash(t.as_py()) for t in b.column(1)), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp.view(np.int64))], names=["doc_id", "fp"])

    kind = dict(own.dtypes)["doc_id"]
    return own.mapInArrow(run, f"doc_id {kind}, fp long")


def _keys(fp: Column) -> Column:
    """A struct (key, rest) for each way to keep BLOCKS - MAX_DIFF blocks: key is what must be equal, rest the other bits."""
    width = BITS // BLOCKS
    block = lambda i: F.shiftrightunsigned(fp, i * width).bitwiseAND(F.lit((1 << width) - 1))
    join = lambda ids: F.shiftleft(block(ids[0]), width).bitwiseOR(block(ids[1]))
    made = []
    for k, same in enumerate(combinations(range(BLOCKS), BLOCKS - MAX_DIFF)):
        other = [i for i in range(BLOCKS) if i not in same]
        made.append(F.struct((join(same) + F.lit(k << 2 * width)).alias("key"), join(other).alias("rest")))
    return F.array(*made)


def links(nodes: DataFrame) -> DataFrame:
    """Links (a, b) between representatives whose fingerprints differ in MAX_DIFF bits at most, a != b. They connect whatever the
    full set of such pairs connects, but are not all of them.

    nodes: (rep, fp), fp distinct. Two fingerprints at MAX_DIFF bits share BLOCKS - MAX_DIFF blocks. Block values with one
    fingerprint are dropped; up to PAIRS_UP_TO, all pairs of a block are verified. A fuller block emits no pairs: each of its
    fingerprints is put to the 33 values at one bit or less from its other bits. Two that differ in 2 bits or less meet at a
    value between them, and all that meet there are 2 bits apart at most; each is linked to the smallest there. That is exact,
    and linear in the block.
    """
    keyed = nodes.select("rep", F.explode(_keys(F.col("fp"))).alias("k")).select("rep", "k.key", "k.rest")
    counts = stored(keyed.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1"), "simhash-blocks")
    full = stored(keyed.join(counts, "key"), "simhash-keys")
    light = full.filter(F.col("n") <= PAIRS_UP_TO).select("key", "rep", "rest")
    a, b = light.toDF("key", "a", "rest_a"), light.toDF("key", "b", "rest_b")
    pairs = a.join(b, "key").filter((F.col("a") < F.col("b")) & (F.bit_count(F.col("rest_a").bitwiseXOR(F.col("rest_b"))) <= MAX_DIFF)).select("a", "b")
    near = F.array(F.col("rest"), *[F.col("rest").bitwiseXOR(F.lit(1 << i)) for i in range(BITS // 2)])
    spread = full.filter(F.col("n") > PAIRS_UP_TO).select("key", "rep", F.explode(near).alias("value"))
    # The smallest by partial aggregation, then at most 33 rows a (key, value) in the join.
    least = spread.groupBy("key", "value").agg(F.min("rep").alias("b"), F.count("*").alias("m")).filter("m > 1").drop("m")
    stars = spread.join(least, ["key", "value"]).filter("rep <> b").select(F.col("rep").alias("a"), "b")
    return pairs.unionByName(stars).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, component): component is the smallest node reachable; nodes that are no smallest only. edges: (a, b), a <> b.

    Alternating large and small stars: each round replaces every link by one to a smaller node, until all links are stars.
    The smallest neighbour comes from partial aggregation; the joins are between stored tables, which adaptive execution can
    broadcast or split where one node has most links. Every step is written to the shared folder.
    """
    def mark(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    now = stored(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct(), "cc")
    seen = mark(now)
    while seen[0]:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = stored(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), "cc-large")
        large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        now = stored(large, "cc")
        least = stored(now.groupBy("a").agg(F.min("b").alias("m")), "cc-small")
        small = now.join(least, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e"))
        now = stored(small.select("e.a", "e.b").filter("a <> b").distinct(), "cc")
        before, seen = seen, mark(now)
        if before == seen:
            break
    return now.select(F.col("a").alias("node"), F.col("b").alias("component"))


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """A row a document: doc_id, fingerprint (16 hex digits), component_id, the smallest doc_id reachable by links.

    Null, empty or blank text: fingerprint zero, linked like any other. Equal fingerprints are one node, so copies are never
    paired. Repeated rows: each gets its row. Null doc_id: its component is the smallest id reachable, or null if it reaches
    none; links go through it. Ties: the smallest id. Empty table: no rows. Other columns are ignored.
    """
    fps = stored(fingerprints(docs, doc_id, text), "simhash")
    nodes = stored(fps.groupBy("fp").agg(F.min("doc_id").alias("id")), "simhash-nodes")
    found = components(links(nodes.select(F.col("fp").alias("rep"), "fp")))
    named = nodes.join(found, F.col("fp") == F.col("node"), "left").select("fp", "id", F.coalesce("component", "fp").alias("component"))
    least = named.groupBy("component").agg(F.min("id").alias("component_id"))
    named = stored(named.join(least, "component").select("fp", "component_id"), "simhash-named")
    return fps.join(named, "fp").select(F.col("doc_id").alias(doc_id), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def _bits(h: np.ndarray) -> np.ndarray:
    """A row of bits a hash."""
    h = (h + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    h = (h ^ h >> np.uint64(32)) * np.uint64(0xBF58476D1CE4E5B9)
    return np.unpackbits((h ^ h >> np.uint64(29)).astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


def _parts(n: int) -> int:
    """Parts of n shingles: a power of two, PARTS at least."""
    return max(PARTS, 1 << (int(n) // PART_SHINGLES).bit_length())


def blocks(h: np.ndarray, similarity: float = SIMILARITY) -> np.ndarray:
    """Keys of the blocks of distinct shingle hashes.

    A shingle's hash puts it in one of _parts(n) parts; a block is the SimHash of one of the first PARTS parts that hold any. Two
    texts at `similarity` share blocks wherever a part holds none of the shingles that differ: each block with a probability of
    0.4 at the least, all missed by less than 1e-6. Of texts at both sides of a power of two, the smaller has the larger one's blocks too.
    """
    out = []
    for k in {_parts(len(h)), _parts(int(len(h) / similarity))}:
        part = h % np.uint64(k)
        near = part < PARTS
        part, order = part[near], np.argsort(part[near], kind="stable")
        if not len(order):
            continue
        which, first, n = np.unique(part[order], return_index=True, return_counts=True)
        counts = np.add.reduceat(_bits(h[near][order]).astype(np.int32), first, axis=0)
        value = np.packbits(2 * counts > n[:, None], axis=1, bitorder="little").view("<u8").ravel()
        out.append((value ^ which * np.uint64(0xD6E8FEB86659FD93)) * np.uint64(2 * k + 1))
    return np.concatenate(out).view(np.int64) if out else np.zeros(0, np.int64)


def _sketches(docs: DataFrame, doc_id: str, text: str, shingle: int, similarity: float) -> DataFrame:
    """A row a document: seq, doc_id, hash of the text, id of its set of shingles, their number, fingerprint, blocks and the
    shingles themselves (sorted, 32 bits each)."""
    own = docs.select(F.monotonically_increasing_id().alias("seq"), F.col(doc_id).alias("doc_id"), F.xxhash64(F.col(text)).alias("told"), F.col(text).alias("text"))
    kind = dict(own.dtypes)["doc_id"]
    names = ["seq", "doc_id", "told", "set_id", "n", "fp", "keys", "shingles"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, n, fp, keys, kept = [], [], [], [], []
            for t in b.column(3):
                h = np.unique(shingle_hashes(t.as_py(), shingle))
                counts = np.zeros(BITS, np.int64)
                for at in range(0, len(h), _CHUNK):
                    counts += _bits(h[at : at + _CHUNK]).sum(axis=0, dtype=np.int64)
                ids.append(xxhash.xxh3_128_digest(h.astype("<u8").tobytes()))
                n.append(len(h))
                fp.append(int(np.packbits(2 * counts > len(h), bitorder="little").view("<i8")[0]))
                keys.append(blocks(h, similarity))
                kept.append(np.unique((h & np.uint64(0xFFFFFFFF)).astype("<u4")).tobytes())
            cols = [b.column(0), b.column(1), b.column(2), pa.array(ids, pa.binary()), pa.array(n, pa.int64()), pa.array(fp, pa.int64()), pa.array(keys, pa.list_(pa.int64())), pa.array(kept, pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, names=names)

    return own.mapInArrow(run, f"seq long, doc_id {kind}, told long, set_id binary, n long, fp long, keys array<long>, shingles binary")


def _verified(pairs: DataFrame, shingles: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) whose shingles are as similar as that. shingles: (seq, shingles)."""
    full = pairs.join(shingles.toDF("a", "sa"), "a").join(shingles.toDF("b", "sb"), "b").select("a", "b", "sa", "sb")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ok = []
            for x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                x, y = np.frombuffer(x, "<u4"), np.frombuffer(y, "<u4")
                both = len(np.intersect1d(x, y, assume_unique=True))
                ok.append(both >= similarity * (len(x) + len(y) - both) - 1e-9)
            yield b.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return full.mapInArrow(run, "a long, b long")


def _rare_pairs(nodes: DataFrame, similarity: float) -> DataFrame:
    """Pairs (a, b) of sets of different parts that share one of their rarest shingles: all such pairs at `similarity` whose whole
    fingerprints are near, and some others. nodes: (seq, fp, shingles), and part, the number of what is joined already; without it
    each set is one.

    Two tables of rare shingles s, of sets as the smaller one of a pair and as the larger one, are joined by s and by a band of sizes:
    it is so wide that the smaller is in the band of the larger or in the next lower one. Sets of k and l shingles share
    c = similarity / (1 + similarity) * (k + l) at the least, so the rarest that they share is among the k - c + 1 and l - c + 1 rarest
    of theirs. Shingles of one part only have no rows, but their places (at) count: sets that all differ from a common
    origin in more than it takes to be unlike it don't meet. How often a shingle occurs is counted in 2 ** RARE_BITS counters by the
    first bits of its hash, the size of the only table that is broadcast; any order common to all sets loses no pair."""
    share = similarity / (1 + similarity)
    # a hundredth wider than sizes at `similarity` can be apart
    band = lambda k: F.floor(F.log(k) / math.log(1.01 / similarity)).cast("int")
    nodes = nodes.select("seq", "fp", "part" if "part" in nodes.columns else F.col("seq").alias("part"), "shingles")
    drop = np.uint32(32 - RARE_BITS)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = np.zeros(1 << RARE_BITS, np.int64)
        for b in batches:
            m += np.bincount(np.frombuffer(b"".join(b.column(0).to_pylist()), "<u4") >> drop, minlength=len(m))
        m = m.reshape(-1, 1 << RARE_BITS // 2)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(m))), pa.array([x.tobytes() for x in m], pa.binary())], names=["row", "m"])

    def add(t: pa.Table) -> pa.Table:
        m = sum(np.frombuffer(x.as_py(), np.int64) for x in t["m"])
        return pa.table({"row": t["row"][:1], "m": pa.array([m.tobytes()], pa.binary())})

    counted = nodes.select("shingles").mapInArrow(count, "row long, m binary").groupBy("row").applyInArrow(add, "row long, m binary").toArrow()
    often = np.zeros((1 << RARE_BITS - RARE_BITS // 2, 1 << RARE_BITS // 2), np.int64)
    for row, m in zip(*(c.to_pylist() for c in counted.columns), strict=True):
        often[row] = np.frombuffer(m, np.int64)
    often = nodes.sparkSession.sparkContext.broadcast(often.ravel())

    def rarest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["seq", "fp", "part", "k", "s", "at"]
        whole = lambda made: pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*made, strict=True)], names=names)
        made, n = [], 0
        for b in batches:
            for *own, kept in zip(*(c.to_pylist() for c in b.columns), strict=True):
                h = np.frombuffer(kept, "<u4")
                k, m = len(h), often.value[h >> drop]
                order = np.lexsort((h, m))[: k - math.ceil(similarity * k - 1e-6) + 1]
                at = np.flatnonzero(m[order] > 1)
                made.append([*(np.full(len(at), x, np.int64) for x in (*own, k)), h[order[at]].astype(np.int64), at + 1])
                n += len(at)
                if n >= 1 << 16:
                    yield whole(made)
                    made, n = [], 0
        if made:
            yield whole(made)

    rows = stored(nodes.mapInArrow(rarest, "seq long, fp long, part long, k long, s long, at long"), "similar-rarest")
    met = rows.groupBy("s").agg(F.min("part").alias("x"), F.max("part").alias("y")).filter("x < y").select("s")
    rows = stored(rows.join(met.hint("merge"), "s", "left_semi").withColumn("band", band(F.col("k"))), "similar-rarest")
    # the largest of the smaller sizes at which a place still counts
    most = F.least(F.col("k").cast("double"), (F.col("k") - F.col("at") + 1 + 1e-6) / share - F.col("k") + 1e-6)
    smaller = rows.filter(F.col("at") <= F.col("k") - F.ceil(2 * share * F.col("k") - 1e-6) + 1)
    same, lower = rows.filter(band(most) >= F.col("band")), rows.filter(band(similarity * F.col("k") - 1e-6) < F.col("band")).withColumn("band", F.col("band") - 1)
    named = lambda t, x: t.select("s", "band", *[F.col(c).alias(d + x) for c, d in (("seq", ""), ("fp", "f"), ("part", "p"), ("k", "k"), ("at", "at_"))])
    common = F.ceil(share * (F.col("ka") + F.col("kb")) - 1e-6)
    placed = (F.col("at_a") <= F.col("ka") - common + 1) & (F.col("at_b") <= F.col("kb") - common + 1)
    ordered = (F.col("ka") < F.col("kb")) | (F.col("ka") == F.col("kb")) & (F.col("a") < F.col("b"))
    fits = (F.col("pa") != F.col("pb")) & ordered & placed & (F.col("ka") >= similarity * F.col("kb") - 1e-9) & (F.bit_count(F.col("fa").bitwiseXOR(F.col("fb"))) <= FAR)

    def meet(larger: DataFrame) -> DataFrame:
        a, b = named(smaller, "a"), named(larger, "b")
        return a.join(b.hint("merge"), (a["s"] == b["s"]) & (a["band"] == b["band"]) & fits).select("a", "b")

    return meet(same).unionByName(meet(lower)).distinct()


def _similar_pairs(nodes: DataFrame, similarity: float) -> DataFrame:
    """Verified links (a, b) between different sets. nodes: (seq, n, fp, keys, shingles).

    First each set is put to the leader of its largest block; sets that this connects are not compared again. Then all pairs of
    a block with up to SMALL sets are verified. In a fuller one each set is put to one leader, the set with the most full
    blocks: in a family of edits that is the text they come from. Those not
    similar to a leader have their other blocks; so all sets of a full block that isn't of one part (what the leaders of the largest
    blocks have joined) are compared with those that share one of their rarest shingles and are of another part (_rare_pairs): sets
    that share but a passage, or that were edited too far from a common origin, don't meet. So pairs grow with the blocks, and every link
    between sets that share a block is found, or both its ends are joined already. Joins that grow with the documents are by shuffle at every size.
    """
    far = lambda x, y: F.bit_count(F.col(x).bitwiseXOR(F.col(y))) <= FAR
    sized = lambda x, y: (F.col(x) >= similarity * F.col(y) - 1e-9) & (F.col(y) >= similarity * F.col(x) - 1e-9)
    keyed = nodes.select("seq", "n", "fp", F.size("keys").alias("of"), F.explode("keys").alias("key"))
    counts = stored(keyed.groupBy("key").agg(F.count("*").alias("m")).filter("m > 1"), "similar-blocks")
    shared = stored(keyed.join(counts.hint("merge"), "key"), "similar-keys")

    def verified(p: DataFrame) -> DataFrame:
        needed = p.select(F.explode(F.array("a", "b")).alias("seq")).distinct()
        return _verified(p, stored(nodes.select("seq", "shingles").join(needed.hint("merge"), "seq", "left_semi"), "similar-shingles"), similarity)

    full = shared.filter(F.col("m") > SMALL)
    central = stored(full.groupBy("seq").agg(F.count("*").alias("c"), F.max(F.struct("m", "key"))["key"].alias("key")), "similar-central")
    best = full.join(central.select("seq", "c").hint("merge"), "seq").groupBy("key").agg(F.max(F.struct("c", F.negative("seq").alias("s"), "n", "fp")).alias("l"))
    leaders = stored(best.select("key", F.negative("l.s").alias("b"), F.col("l.n").alias("nb"), F.col("l.fp").alias("fb")), "similar-leaders")
    # each set with the leader of its largest block first; what that connects is compared no more
    first = lookup(full.join(central.select("seq", "key").hint("merge"), ["seq", "key"], "left_semi"), leaders, ["key"])
    first = first.filter((F.col("seq") != F.col("b")) & sized("n", "nb") & far("fp", "fb")).select(F.col("seq").alias("a"), "b")
    first = stored(verified(stored(first, "similar-first")), "similar-links")
    joined = components(first).select(F.col("node").alias("seq"), "component")
    shared = stored(shared.join(joined.hint("merge"), "seq", "left").withColumn("part", F.coalesce("component", "seq")).drop("component"), "similar-parts")
    light, full = shared.filter(F.col("m") <= SMALL), shared.filter(F.col("m") > SMALL)
    a, b = (light.select("key", F.col("seq").alias(x), F.col("n").alias("n" + x), F.col("fp").alias("f" + x), F.col("part").alias("p" + x)) for x in "ab")
    pairs = a.join(b.hint("merge"), (a["key"] == b["key"]) & (F.col("a") < F.col("b")) & (F.col("pa") != F.col("pb")) & sized("na", "nb") & far("fa", "fb")).select("a", "b")
    named = stored(leaders.join(shared.select(F.col("seq").alias("b"), F.col("part").alias("pb")).distinct(), "b"), "similar-leaders")
    stars = lookup(full, named, ["key"]).filter((F.col("part") != F.col("pb")) & sized("n", "nb") & far("fp", "fb"))
    pairs = stored(pairs.unionByName(stars.select(F.col("seq").alias("a"), "b")).distinct(), "similar-pairs")

    found = stored(first.unionByName(verified(pairs)), "similar-links")
    mixed = full.groupBy("key").agg(F.min("part").alias("x"), F.max("part").alias("y")).filter("x < y").select("key")
    near = stored(full.join(mixed.hint("merge"), "key", "left_semi").select("seq", "part").distinct(), "similar-near")
    if not near.head(1):
        return found
    own = nodes.join(near.hint("merge"), "seq").select("seq", "fp", "part", "shingles")
    more = stored(_rare_pairs(own, similarity), "similar-rest")
    return found.unionByName(verified(more))


def similar_groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """A row a document: doc_id, told (hash of the text), component (a number), of near-duplicates by word shingles: links join texts
    whose sets of shingles have a Jaccard similarity of `similarity` or more, components what links reach.

    Whole fingerprints differ in some ten bits at that similarity, too many for blocks of their bits. So the fingerprint is split by
    shingles instead: each block is the SimHash of one part of them, and close texts share the blocks of parts that no edit
    touched. Pairs that share a block are verified by the Hamming distance of whole fingerprints and then by the shingles.
    Null or blank text: the empty set, equal to any other such. Fewer words than a shingle's make one. Equal sets are one node. Repeated
    rows and null ids: rows of their own. Empty table: no rows. Other columns are ignored."""
    rows = stored(_sketches(docs, doc_id, text, shingle, similarity), "similar")
    first = stored(rows.groupBy("set_id").agg(F.min("seq").alias("node")), "similar-nodes")
    nodes = rows.join(first.select(F.col("node").alias("seq")).hint("merge"), "seq", "left_semi").select("seq", "n", "fp", "keys", "shingles")
    found = components(_similar_pairs(nodes, similarity))
    named = first.join(found, "node", "left").select("set_id", F.coalesce("component", "node").alias("component"))
    named = stored(named, "similar-named")
    return rows.select("doc_id", "told", "set_id").join(named, "set_id").select(F.col("doc_id").alias(doc_id), "told", "component")


def keep_first(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = WORDS, similarity: float = SIMILARITY) -> DataFrame:
    """One document of each component of similar_groups stays, the one with the smallest id (none if all lack one; of equal ids, the
    smallest hash of the text), with its columns as they were. Equal rows of that document are one."""
    found = similar_groups(docs, doc_id, text, shingle, similarity)
    best = F.min(F.struct(F.col(doc_id).isNull().alias("none"), F.col(doc_id).alias("id"), F.col("told").alias("told"))).alias("k")
    kept = stored(found.groupBy("component").agg(best).select(F.col("k.id").alias("__id"), F.col("k.told").alias("__told")), "similar-kept")
    # by shuffle at every size: the kept ids grow with the documents
    same = F.col(doc_id).eqNullSafe(F.col("__id")) & (F.xxhash64(F.col(text)) == F.col("__told"))
    rest = docs.join(kept.hint("merge"), same, "left_semi")
    repeated = found.groupBy(doc_id, "told").agg(F.count("*").alias("n")).filter("n > 1").head(1)
    return rest.withColumn("__told", F.xxhash64(F.col(text))).dropDuplicates([doc_id, "__told"]).drop("__told") if repeated else rest
