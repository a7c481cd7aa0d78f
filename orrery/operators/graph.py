"""Property graphs: nodes (id, kind, ...) and edges (edge_id, from_id, to_id, kind, weight). Bounded traversals are unrolled joins with
a cut after each hop, so what a hop moves is bounded by the frontier and its limit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orrery.functions.stage import stored


def scoped_id(workspace: Column, local: Column) -> Column:
    return F.concat(F.lit("workspace:"), F.octet_length(workspace).cast("string"), F.lit(":"), workspace, F.lit(":"), local)


def directed(edges: DataFrame, direction: str = "out") -> DataFrame:
    """(node, other, edge_id, kind, weight)."""
    out = edges.select(F.col("from_id").alias("node"), F.col("to_id").alias("other"), "edge_id", "kind", "weight")
    into = edges.select(F.col("to_id").alias("node"), F.col("from_id").alias("other"), "edge_id", "kind", "weight")
    if direction == "both":
        return out.unionByName(into.filter("node <> other"))
    return {"out": out, "in": into}[direction]


def neighbors(edges: DataFrame, seeds: DataFrame, direction: str = "out", kinds: list[str] | None = None, min_weight: float | None = None, limit: int = 100) -> DataFrame:
    """(node, other, edge_id, kind, weight, rank) for each of seeds (node): heaviest edges first, then by neighbour and edge."""
    d = directed(edges, direction)
    if kinds:
        d = d.filter(F.col("kind").isin(kinds))
    if min_weight is not None:
        d = d.filter(F.col("weight") >= min_weight)
    d = d.join(seeds.select("node").distinct(), "node")
    w = Window.partitionBy("node").orderBy(F.desc("weight"), "other", "edge_id")
    return d.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= limit)


def two_hop(edges: DataFrame, seeds: DataFrame, first: int = 50, second: int = 20, limit: int = 100) -> DataFrame:
    """(node, via, last, score, rank): out-out paths, cut after each hop; score is the mean weight."""
    one = neighbors(edges, seeds, limit=first).select("node", F.col("other").alias("via"), F.col("weight").alias("w1"), F.col("edge_id").alias("e1"))
    nxt = neighbors(edges, one.select(F.col("via").alias("node")), limit=second).select(F.col("node").alias("via"), F.col("other").alias("last"), F.col("weight").alias("w2"), F.col("edge_id").alias("e2"))
    paths = one.join(nxt, "via").select("node", "via", "last", F.round((F.col("w1") + F.col("w2")) / 2, 7).alias("score"), "e1", "e2")
    w = Window.partitionBy("node").orderBy(F.desc("score"), "last", "via", "e1", "e2")
    return paths.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= limit).drop("e1", "e2")


def reach(edges: DataFrame, seeds: DataFrame, depth: int = 3, per_hop: int = 10, direction: str = "both", limit: int | None = None) -> DataFrame:
    """(seed, id, hop, path): breadth first to `depth`; a node is reached by its first path only (smallest hop, then path). Each hop follows
    the per_hop best edges of each frontier node. The visited set is a left anti join."""
    edges = edges if depth < 2 else stored(edges, "graph-edges")
    seen = stored(seeds.select(F.col("node").alias("seed"), F.col("node").alias("id")).distinct().withColumns({"hop": F.lit(0), "path": F.array("id")}), "graph-seeds")
    front = seen
    for hop in range(1, depth + 1):
        step = neighbors(edges, front.select(F.col("id").alias("node")), direction, limit=per_hop)
        grown = front.join(step.select(F.col("node").alias("id"), "other"), "id").select("seed", F.col("other").alias("id"), F.lit(hop).alias("hop"), F.concat("path", F.array("other")).alias("path"))
        fresh = grown.groupBy("seed", "id", "hop").agg(F.min("path").alias("path")).join(seen.select("seed", "id"), ["seed", "id"], "left_anti")
        front = stored(fresh.select("seed", "id", "hop", "path"), "graph-front")
        seen = seen.unionByName(front)
    found = seen.filter("hop > 0")
    if limit is None:
        return found
    w = Window.partitionBy("seed").orderBy("hop", "path")
    return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= limit).drop("rank")


def path_exists(edges: DataFrame, pairs: DataFrame, depth: int = 3, per_node: int = 256) -> DataFrame:
    """(source, target, found, hops) for pairs (source, target): directed, up to `depth` hops. A node is its own target at 0 hops."""
    hops = reach(edges, pairs.select(F.col("source").alias("node")), depth, per_node, "out").select(F.col("seed").alias("source"), F.col("id").alias("target"), "hop")
    near = pairs.join(hops, ["source", "target"], "left").withColumn("hop", F.when(F.col("source") == F.col("target"), 0).otherwise(F.col("hop")))
    return near.select("source", "target", F.col("hop").isNotNull().alias("found"), F.coalesce("hop", F.lit(-1)).alias("hops"))


def related(edges: DataFrame, links: DataFrame, seeds: DataFrame, limit: int = 10) -> DataFrame:
    """Chunks next to a node (limit * 8 neighbours by weight), then its direct links (node, id) by id, each once."""
    near = neighbors(edges, seeds, "both", limit=limit * 8).filter(F.col("other").startswith("chunk:")).select("node", F.col("other").alias("id"), F.lit(0).alias("way"), "rank")
    own = links.join(seeds.select("node").distinct(), "node").select("node", "id", F.lit(1).alias("way"), F.row_number().over(Window.partitionBy("node").orderBy("id")).alias("rank"))
    first = near.unionByName(own).groupBy("node", "id").agg(F.min(F.struct("way", "rank")).alias("at"))
    return first.withColumn("rank", F.row_number().over(Window.partitionBy("node").orderBy("at", "id"))).filter(F.col("rank") <= limit).select("node", "id", F.col("at.way").alias("way"), "rank")


def stats(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(part, kind, n)."""
    n = nodes.groupBy("kind").agg(F.count("*").alias("n")).select(F.lit("node").alias("part"), "kind", "n")
    return n.unionByName(edges.groupBy("kind").agg(F.count("*").alias("n")).select(F.lit("edge").alias("part"), "kind", "n"))


def upsert(nodes: DataFrame, batch: DataFrame) -> DataFrame:
    """Merge of (id, kind, props map, created, updated, ordinal): later properties win, the first creation and last update stay."""
    both = nodes.withColumn("ordinal", F.lit(-1).cast("long")).unionByName(batch)
    entries = F.explode_outer(F.map_entries("props")).alias("e")
    latest = both.select("id", "ordinal", entries).filter("e is not null").groupBy("id", F.col("e.key").alias("key")).agg(F.max_by("e.value", "ordinal").alias("value"))
    props = latest.groupBy("id").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("key", "value")))).alias("props"))
    heads = both.groupBy("id").agg(F.max_by("kind", "ordinal").alias("kind"), F.min("created").alias("created"), F.max("updated").alias("updated"))
    return heads.join(props, "id", "left").select("id", "kind", "props", "created", "updated")


def delete_cascade(nodes: DataFrame, edges: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges without the ids of gone (id); an edge goes with either end."""
    ids = gone.select("id").distinct()
    left = edges.join(ids.select(F.col("id").alias("from_id")), "from_id", "left_anti").join(ids.select(F.col("id").alias("to_id")), "to_id", "left_anti")
    return nodes.join(ids, "id", "left_anti"), left


def dangling(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges with an end that is no node: (edge_id, missing)."""
    ends = edges.select("edge_id", F.explode(F.array("from_id", "to_id")).alias("missing"))
    return ends.join(nodes.select(F.col("id").alias("missing")), "missing", "left_anti").select("edge_id", "missing").distinct()


#: metadata key -> (edge kind, from this row to the value or back, kind of the other node)
PROJECTION = {
    "parent_id": ("child_of", True, "chunk"),
    "related_ids": ("related_to", True, "chunk"),
    "imports": ("imports", True, "module"),
    "calls": ("calls", True, "function"),
    "depends_on": ("depends_on", True, "module"),
    "tests": ("tests", True, "function"),
    "owned_by": ("owned_by", True, "person"),
    "changed_by": ("changed_by", True, "commit"),
    "document_id": ("contains", False, "document"),
    "section_id": ("contains", False, "section"),
    "file": ("contains", False, "file"),
    "symbol": ("contains", False, "symbol"),
}
#: kinds that are also stored in the other direction
MIRRORED = {"child_of": "parent_of", "related_to": "related_to"}


def project(rows: DataFrame, row_id: str = "id", meta: str = "meta") -> DataFrame:
    """Edges (from_id, to_id, kind) told by metadata, a variant; a key holds a text or a list of texts. Distinct."""
    m = F.col(meta)
    near = F.concat(F.lit("chunk:"), F.col(row_id).cast("string"))
    parts = []
    for key, (kind, out, other) in PROJECTION.items():
        v = F.try_variant_get(m, f"$.{key}", "variant")
        items = F.coalesce(F.try_variant_get(v, "$", "array<string>"), F.array(F.try_variant_get(v, "$", "string")))
        each = F.array_distinct(F.array_compact(items))
        parts.append(F.transform(each, _edge(near, other, kind, out)))
        if kind in MIRRORED:
            parts.append(F.transform(each, _edge(near, other, MIRRORED[kind], not out)))
    none = F.array().cast("array<struct<from_id:string,to_id:string,kind:string>>")
    whole = F.concat(*[F.coalesce(p, none) for p in parts])
    return rows.select(F.explode(whole).alias("e")).select("e.*").distinct()


def _edge(near: Column, other: str, kind: str, out: bool):
    def make(x: Column) -> Column:
        far = F.concat(F.lit(f"{other}:"), x)
        return F.struct((near if out else far).alias("from_id"), (far if out else near).alias("to_id"), F.lit(kind).alias("kind"))

    return make


def seeds_from_query(queries: DataFrame, text: str = "text", limit: int = 16) -> DataFrame:
    """(qid, seed, kind): file names with a path or a code suffix (a line mark is cut), and functions written with :: or ()."""
    words = F.posexplode(F.split(F.col(text), r"\s+")).alias("at", "w")
    own = queries.select("qid", words)
    w = F.regexp_replace(F.regexp_replace("w", r"^[\"'`(\[,;]+|[\"'`)\],;?!.]+$", ""), r"(:\d+(-\d+)?|#L\d+(-L\d+)?)$", "")
    call = F.col("w").rlike(r"::") | F.col("w").rlike(r"\(\)")
    file = w.contains("/") | w.rlike(r"\.(rs|py|ts|tsx|js|jsx|go|java|kt|c|h|cc|cpp|hpp|cs|rb|php|swift|scala|md|toml)$")
    seed = F.when(call, F.concat(F.lit("function:"), F.regexp_replace(w, r"\(\)?$", ""))).when(file, F.concat(F.lit("file:"), w))
    found = own.select("qid", "at", seed.alias("seed")).filter("seed is not null").groupBy("qid", "seed").agg(F.min("at").alias("at"))
    first = found.withColumn("n", F.row_number().over(Window.partitionBy("qid").orderBy("at"))).filter(F.col("n") <= limit)
    return first.select("qid", "seed", F.substring_index("seed", ":", 1).alias("kind"))


def evidence_walk(nodes: DataFrame, edges: DataFrame, roots: DataFrame, depth: int = 8, max_nodes: int = 1000) -> tuple[DataFrame, DataFrame]:
    """Directed walk from roots (id): nodes (id, hop, truncated) and the edges among them. At most max_nodes, nearest first, then by id;
    truncated tells that more were reachable."""
    known = nodes.select("id")
    hops = reach(edges.join(known.select(F.col("id").alias("to_id")), "to_id", "left_semi"), roots.select(F.col("id").alias("node")), depth, max_nodes, "out")
    own = roots.join(known, "id", "left_semi").select("id", F.lit(0).alias("hop"))
    best = own.unionByName(hops.select("id", "hop")).groupBy("id").agg(F.min("hop").alias("hop"))
    first = stored(best.orderBy("hop", "id").limit(max_nodes + 1), "graph-evidence")
    n = first.agg((F.count("*") > max_nodes).alias("truncated"))
    kept = first.orderBy("hop", "id").limit(max_nodes).join(F.broadcast(n))
    among = edges.join(kept.select(F.col("id").alias("from_id")), "from_id", "left_semi").join(kept.select(F.col("id").alias("to_id")), "to_id", "left_semi")
    return kept, among
