"""Queries of property graphs, packing and citations."""

from __future__ import annotations

from pyspark.sql import functions as F

from orrery.functions.stage import micros
from orrery.functions.text import contextualize, estimate_tokens, render, sql_estimate
from orrery.operators import graph, lexical, pack
from orrery.plans.base import Registry, t
from orrery.plans.retrieval import _LEX, index, text_queries

query = Registry()

#: customers place orders, orders contain parts, suppliers offer parts, nations hold customers
_E = """e AS (
  SELECT 'p' || o_orderkey AS edge_id, 'c' || o_custkey AS from_id, 'o' || o_orderkey AS to_id, 'placed' AS kind, round(o_totalprice / 1000000, 6) AS weight FROM orders
  UNION ALL SELECT DISTINCT 'l' || l_orderkey || '-' || l_partkey, 'o' || l_orderkey, 'x' || l_partkey, 'contains', 0.5::DOUBLE FROM lineitem
  UNION ALL SELECT DISTINCT 's' || l_partkey || '-' || l_suppkey, 'x' || l_partkey, 's' || l_suppkey, 'offered_by', round(1.0::DOUBLE / (1 + l_suppkey % 5), 6) FROM lineitem)"""


def edges(spark, sf):
    o, li = t(spark, sf, "orders"), t(spark, sf, "lineitem")
    s = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    placed = o.select(s("p", "o_orderkey").alias("edge_id"), s("c", "o_custkey").alias("from_id"), s("o", "o_orderkey").alias("to_id"), F.lit("placed").alias("kind"), F.round(F.col("o_totalprice") / 1000000, 6).alias("weight"))
    held = li.select(F.concat(s("l", "l_orderkey"), F.lit("-"), F.col("l_partkey")).alias("edge_id"), s("o", "l_orderkey").alias("from_id"), s("x", "l_partkey").alias("to_id"), F.lit("contains").alias("kind"), F.lit(0.5).alias("weight")).distinct()
    by = li.select(F.concat(s("s", "l_partkey"), F.lit("-"), F.col("l_suppkey")).alias("edge_id"), s("x", "l_partkey").alias("from_id"), s("s", "l_suppkey").alias("to_id"), F.lit("offered_by").alias("kind"), F.round(1.0 / (1 + F.col("l_suppkey") % 5), 6).alias("weight")).distinct()
    return placed.unionByName(held).unionByName(by)


def seeds(spark, sf, n: int = 20):
    return spark.range(n).select(F.concat(F.lit("c"), F.col("id").cast("string")).alias("node"))


_S = "sd AS (SELECT 'c' || i AS node FROM range(20) AS r(i))"
_BOTH = "d AS (SELECT from_id AS node, to_id AS other, edge_id, kind, weight FROM e UNION ALL SELECT to_id, from_id, edge_id, kind, weight FROM e WHERE from_id <> to_id)"


@query(f"WITH {_E}, {_S} SELECT node, to_id AS other, edge_id, kind, weight, row_number() OVER (PARTITION BY node ORDER BY weight DESC, to_id, edge_id)::INTEGER AS rank FROM e JOIN sd ON node = from_id WHERE weight >= 0.05 QUALIFY rank <= 5")
def graph_neighbors(spark, sf):
    return graph.neighbors(edges(spark, sf), seeds(spark, sf), kinds=["placed", "contains"], min_weight=0.05, limit=5)


@query(f"""WITH {_E}, {_S}, h AS (SELECT *, row_number() OVER (PARTITION BY from_id ORDER BY weight DESC, to_id, edge_id) AS n FROM e),
p AS (SELECT node, a.to_id AS via, b.to_id AS last, round((a.weight + b.weight) / 2, 7) AS score, a.edge_id AS e1, b.edge_id AS e2 FROM sd JOIN h a ON a.from_id = node AND a.n <= 50 JOIN h b ON b.from_id = a.to_id AND b.n <= 20)
SELECT node, via, last, score, row_number() OVER (PARTITION BY node ORDER BY score DESC, last, via, e1, e2)::INTEGER AS rank FROM p QUALIFY rank <= 15""")
def graph_two_hop(spark, sf):
    return graph.two_hop(edges(spark, sf), seeds(spark, sf), limit=15)


def _hops(n: int, per: int, source: str, over: str) -> str:
    """CTEs of an unrolled breadth-first search: f0 .. fn, v0 .. vn."""
    out = [f"s AS (SELECT node, other, row_number() OVER (PARTITION BY node ORDER BY weight DESC, other, edge_id) AS n FROM {over})", f"f0 AS (SELECT node AS seed, node AS id, 0 AS hop, [node] AS path FROM {source})", "v0 AS (SELECT * FROM f0)"]
    for i in range(1, n + 1):
        out.append(f"f{i} AS (SELECT seed, other AS id, {i} AS hop, min(list_append(path, other)) AS path FROM f{i - 1} JOIN s ON s.node = f{i - 1}.id AND n <= {per} WHERE NOT EXISTS (FROM v{i - 1} v WHERE v.seed = f{i - 1}.seed AND v.id = other) GROUP BY ALL)")
        out.append(f"v{i} AS (FROM v{i - 1} UNION ALL FROM f{i})")
    return ", ".join(out)


@query(f"WITH {_E}, {_S}, {_BOTH}, {_hops(3, 4, 'sd', 'd')} SELECT seed, id, hop, array_to_string(path, '>') AS path FROM v3 WHERE hop > 0")
def graph_related_chunks(spark, sf):
    return graph.reach(edges(spark, sf), seeds(spark, sf), 3, 4).withColumn("path", F.array_join("path", ">"))


@query(f"WITH {_E}, d AS (SELECT from_id AS node, to_id AS other, edge_id, weight FROM e), pr AS (SELECT 'c' || i AS source, 's' || (i * 3 % 10) AS target FROM range(20) AS r(i)), so AS (SELECT DISTINCT source AS node FROM pr), {_hops(3, 256, 'so', 'd')} SELECT source, target, hop IS NOT NULL AS found, coalesce(hop, -1) AS hops FROM pr LEFT JOIN v3 ON seed = source AND id = target")
def graph_path_exists(spark, sf):
    pairs = spark.range(20).select(F.concat(F.lit("c"), F.col("id").cast("string")).alias("source"), F.concat(F.lit("s"), (F.col("id") * 3 % 10).cast("string")).alias("target"))
    return graph.path_exists(edges(spark, sf), pairs)


@query(f"WITH {_E}, n AS (SELECT 'customer' AS kind FROM customer UNION ALL SELECT 'order' FROM orders UNION ALL SELECT 'part' FROM part UNION ALL SELECT 'supplier' FROM supplier) SELECT 'node' AS part, kind, count(*) AS n FROM n GROUP BY kind UNION ALL SELECT 'edge', kind, count(*) FROM e GROUP BY kind")
def graph_stats(spark, sf):
    return graph.stats(nodes(spark, sf), edges(spark, sf))


def nodes(spark, sf):
    parts = [("customer", "c", "c_custkey"), ("orders", "o", "o_orderkey"), ("part", "x", "p_partkey"), ("supplier", "s", "s_suppkey")]
    each = [t(spark, sf, name).select(F.concat(F.lit(p), F.col(k).cast("string")).alias("id"), F.lit(name.rstrip("s")).alias("kind")) for name, p, k in parts]
    return each[0].unionByName(each[1]).unionByName(each[2]).unionByName(each[3])


_N = "n AS (SELECT 'c' || c_custkey AS id, 'customer' AS kind FROM customer UNION ALL SELECT 'o' || o_orderkey, 'order' FROM orders UNION ALL SELECT 'x' || p_partkey, 'part' FROM part UNION ALL SELECT 's' || s_suppkey, 'supplier' FROM supplier)"


@query(f"WITH {_E}, {_N}, g AS (SELECT id FROM n WHERE id IN ('c1', 'c2', 'x5', 's3', 'none')) SELECT (SELECT count(*) FROM n WHERE id NOT IN (FROM g)) AS nodes_left, count(*) AS edges_left FROM e WHERE from_id NOT IN (FROM g) AND to_id NOT IN (FROM g)")
def graph_delete_cascade(spark, sf):
    gone = spark.range(1).select(F.explode(F.array(*[F.lit(x) for x in ("c1", "c2", "x5", "s3", "none")])).alias("id"))
    n, e = graph.delete_cascade(nodes(spark, sf), edges(spark, sf), gone)
    return n.agg(F.count("*").alias("nodes_left")).crossJoin(e.agg(F.count("*").alias("edges_left")))


@query(f"WITH {_E}, {_N}, k AS (FROM n WHERE id NOT LIKE 's%3') SELECT edge_id, to_id AS missing FROM e WHERE to_id NOT IN (SELECT id FROM k) UNION SELECT edge_id, from_id FROM e WHERE from_id NOT IN (SELECT id FROM k)")
def graph_integrity(spark, sf):
    return graph.dangling(nodes(spark, sf).filter("id not like 's%3'"), edges(spark, sf))


@query("""WITH b AS (SELECT 'u' || user_id AS id, event_type AS kind, event_id AS o, epoch_us(ts) AS us, 'e' || (event_id % 3) AS k, 'v' || event_id AS v FROM events),
m AS (SELECT id, k, max_by(v, o) AS v FROM b GROUP BY id, k)
SELECT b.id, max_by(kind, o) AS kind, (SELECT string_agg(k || '=' || v, ',' ORDER BY k) FROM m WHERE m.id = b.id) AS props, min(us) AS created, max(us) AS updated FROM b GROUP BY b.id""")
def graph_upsert_merge(spark, sf):
    e = t(spark, sf, "events").select(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("id"), F.col("event_type").alias("kind"), F.create_map(F.concat(F.lit("e"), F.col("event_id") % 3), F.concat(F.lit("v"), F.col("event_id").cast("string"))).alias("props"), micros("ts").alias("created"), micros("ts").alias("updated"), F.col("event_id").alias("ordinal"))
    first, rest = e.filter("ordinal < 100").drop("ordinal"), e.filter("ordinal >= 100")
    old = graph.upsert(first.limit(0), e.filter("ordinal < 100")).select("id", "kind", "props", "created", "updated")
    out = graph.upsert(old, rest)
    return out.select("id", "kind", F.array_join(F.transform(F.array_sort(F.map_entries("props")), lambda x: F.concat(x["key"], F.lit("="), x["value"])), ",").alias("props"), "created", "updated")


@query("""WITH d AS (SELECT doc_id AS i, 'chunk:' || doc_id AS me FROM documents)
SELECT me AS from_id, 'chunk:' || (i // 10) AS to_id, 'child_of' AS kind FROM d UNION SELECT 'chunk:' || (i // 10), me, 'parent_of' FROM d
UNION SELECT me, 'chunk:r' || (i % 4), 'related_to' FROM d UNION SELECT 'chunk:r' || (i % 4), me, 'related_to' FROM d UNION SELECT me, 'chunk:r' || (i % 3), 'related_to' FROM d UNION SELECT 'chunk:r' || (i % 3), me, 'related_to' FROM d
UNION SELECT me, 'person:p' || (i % 7), 'owned_by' FROM d UNION SELECT 'file:f' || (i % 5), me, 'contains' FROM d""")
def graph_projection(spark, sf):
    meta = F.parse_json(F.expr("concat('{\"parent_id\":\"', doc_id div 10, '\",\"related_ids\":[\"r', doc_id % 4, '\",\"r', doc_id % 3, '\"],\"owned_by\":\"p', doc_id % 7, '\",\"file\":[\"f', doc_id % 5, '\"]}')"))
    return graph.project(t(spark, sf, "documents").select(F.col("doc_id").alias("id"), meta.alias("meta")))


_ASKED = ("see src/main.rs:12 and `lib/util.py#L3-L9`", "who calls parse::config() or load()", "nothing here", "README.md, README.md; docs/a.md")


@query("SELECT * FROM (VALUES (0, 'file:src/main.rs', 'file'), (0, 'file:lib/util.py', 'file'), (1, 'function:parse::config', 'function'), (1, 'function:load', 'function'), (3, 'file:README.md', 'file'), (3, 'file:docs/a.md', 'file')) AS v(qid, seed, kind)")
def graph_query_seeds(spark, sf):
    q = spark.range(1).select(F.posexplode(F.array(*[F.lit(s) for s in _ASKED])).alias("qid", "text"))
    return graph.seeds_from_query(q)


@query(f"""WITH {_E}, d AS (SELECT from_id AS node, to_id AS other, edge_id, weight FROM e), sd AS (SELECT 'c1' AS node UNION ALL SELECT 'c4'), {_hops(3, 1000, 'sd', 'd')},
b AS (SELECT id, min(hop) AS hop FROM v3 GROUP BY id ORDER BY hop, id LIMIT 40), n AS (SELECT count(DISTINCT id) > 40 AS truncated FROM v3)
SELECT id, hop, truncated, (SELECT count(*) FROM e WHERE from_id IN (SELECT id FROM b) AND to_id IN (SELECT id FROM b)) AS edges_among FROM b, n""")
def evidence_graph(spark, sf):
    n = nodes(spark, sf)
    kept, among = graph.evidence_walk(n, edges(spark, sf), n.filter("id in ('c1', 'c4')").select("id"), 3, 40)
    return kept.crossJoin(F.broadcast(among.agg(F.count("*").alias("edges_among"))))


@query("""WITH k AS (SELECT 'doc:' || (i // 20) AS d, 'chunk:' || i AS c, 'entity:' || (i % 37) AS n FROM range(400) AS r(i)),
o AS (SELECT c AS node, n AS other FROM k UNION SELECT c, d FROM k)
SELECT a.c AS chunk, b.c AS related FROM k a JOIN k b ON a.n = b.n AND a.c <> b.c WHERE a.c IN ('chunk:0', 'chunk:41')""")
def graph_known_answer(spark, sf):
    """A generated topology with known answers: chunks that mention a chunk's entity, two hops away."""
    k = spark.range(400).select(F.concat(F.lit("chunk:"), F.col("id").cast("string")).alias("c"), F.concat(F.lit("entity:"), (F.col("id") % 37).cast("string")).alias("n"))
    e = k.select(F.concat("c", F.lit("-"), "n").alias("edge_id"), F.col("c").alias("from_id"), F.col("n").alias("to_id"), F.lit("mentions").alias("kind"), F.lit(1.0).alias("weight"))
    s = k.filter("c in ('chunk:0', 'chunk:41')").select(F.col("c").alias("node"))
    return graph.reach(e, s, 2, 100).filter("hop = 2").select(F.col("seed").alias("chunk"), F.col("id").alias("related"))


@query("""SELECT 'documents' AS part, count(*) AS n FROM documents UNION ALL SELECT 'labelled', count(*) FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)
UNION ALL SELECT 'drift', abs((SELECT count(*) FROM documents) - (SELECT count(*) FROM labels WHERE doc_id IN (SELECT doc_id FROM documents)))""")
def graph_reconcile(spark, sf):
    d, la = t(spark, sf, "documents").select("doc_id"), t(spark, sf, "labels").select("doc_id")
    n = d.agg(F.count("*").alias("a")).crossJoin(d.join(la, "doc_id", "left_semi").agg(F.count("*").alias("b"))).crossJoin(la.join(d, "doc_id", "left_semi").agg(F.count("*").alias("c")))
    each = [("documents", F.col("a")), ("labelled", F.col("b")), ("drift", F.abs(F.col("a") - F.col("c")))]
    return n.select(F.explode(F.array(*[F.struct(F.lit(k).alias("part"), v.alias("n")) for k, v in each])).alias("x")).select("x.*")


# packing


@query(f"SELECT doc_id, {sql_estimate('text')} AS tokens FROM documents")
def pack_tokens(spark, sf):
    return t(spark, sf, "documents").select("doc_id", estimate_tokens(F.col("text")).alias("tokens"))


_PACK = f"""WITH RECURSIVE {_LEX}, h AS (SELECT qid, id, rank, {sql_estimate('text')} AS cost FROM br JOIN documents ON doc_id = id WHERE rank <= 20),
k AS (SELECT qid, 0 AS r, 0::BIGINT AS used, 0 AS n, false AS took FROM (SELECT DISTINCT qid FROM h)
  UNION ALL SELECT k.qid, k.r + 1, CASE WHEN used + cost <= 3000 THEN used + cost ELSE used END, CASE WHEN used + cost <= 3000 THEN n + 1 ELSE n END, used + cost <= 3000 FROM k JOIN h ON h.qid = k.qid AND h.rank = k.r + 1)
SELECT h.qid, id, rank, cost, used, n AS position FROM k JOIN h ON h.qid = k.qid AND h.rank = k.r WHERE took"""


@query(_PACK)
def pack_greedy(spark, sf):
    d = t(spark, sf, "documents")
    return pack.token_pack(lexical.search(index(spark, sf), text_queries(spark, sf), 20), d.select(F.col("doc_id").alias("id"), "text"), 3000)


@query(f"""WITH {_LEX}, h AS (SELECT qid, br.id, score, rank, p.doc_id AS pid, coalesce(p.doc_id, br.id) AS rid, coalesce(p.text, d.text) AS txt FROM br JOIN documents d ON d.doc_id = br.id LEFT JOIN documents p ON p.doc_id = br.id - br.id % 4 AND br.id % 3 <> 0 WHERE rank <= 20)
SELECT qid, rid AS id, min_by(txt, rank) AS text, max(score) AS score, row_number() OVER (PARTITION BY qid ORDER BY min(rank))::INTEGER AS rank FROM h GROUP BY qid, rid""")
def pack_parents(spark, sf):
    d = t(spark, sf, "documents")
    child = d.select(F.col("doc_id").alias("id"), F.when(F.col("doc_id") % 3 != 0, F.col("doc_id") - F.col("doc_id") % 4).alias("parent_id"), F.col("text"))
    up = d.select(F.col("doc_id").alias("parent_id"), F.col("text").alias("parent_text"))
    return pack.parents(lexical.search(index(spark, sf), text_queries(spark, sf), 20), child, up)


@query("""SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN source || '/' || doc_id WHEN doc_id % 3 = 1 THEN 'f' || doc_id ELSE doc_id::VARCHAR END AS uri, CASE WHEN doc_id % 2 = 0 THEN '3' ELSE sha256(text) END AS version, sha256(text) AS hash,
  0::BIGINT AS "start", n_chars::BIGINT AS "end", CASE WHEN doc_id % 3 = 2 THEN 'missing_source' ELSE 'complete' END AS status FROM documents""")
def pack_citations(spark, sf):
    meta = F.parse_json(F.expr("concat('{', CASE doc_id % 3 WHEN 0 THEN concat('\"source_uri\":\"', source, '/', doc_id, '\",') WHEN 1 THEN concat('\"source_uri\":5,\"file\":\"f', doc_id, '\",') ELSE '' END, CASE WHEN doc_id % 2 = 0 THEN '\"version\":\"3\",' ELSE '' END, '\"content_hash\":\"', sha2(text, 256), '\",\"start\":0,\"end_offset\":', n_chars, '}')"))
    return t(spark, sf, "documents").select("doc_id", pack.citation(F.col("doc_id").cast("string"), meta).alias("c")).select("doc_id", "c.*")


@query("SELECT doc_id, '[' || source || '@v1#0:' || length(text) || '] ' || text AS inline, text || chr(10) || '— source: ' || source AS full_form, lang || ' > ' || source || ':' || chr(10) || text AS context FROM documents")
def pack_render(spark, sf):
    d = t(spark, sf, "documents").withColumn("s", F.col("text"))
    none = F.lit(None).cast("string")
    return d.select(
        "doc_id",
        render(F.col("s"), F.col("source"), F.lit("v1"), F.lit(0), F.length("s"), "inline").alias("inline"),
        render(F.col("s"), F.col("source"), none, none, none, "full").alias("full_form"),
        contextualize(F.col("s"), F.col("lang"), F.array(F.lit(" "), F.col("source"), none)).alias("context"),
    )


@query("SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN 'hash_mismatch' WHEN doc_id % 4 = 1 THEN 'span_mismatch' ELSE 'ok' END AS status FROM documents WHERE n_chars > 20")
def pack_verify(spark, sf):
    d = t(spark, sf, "documents").filter("n_chars > 20")
    # the middle third, by characters; verify_citation reads it by bytes
    at, size = F.floor(F.length("text") / 3).cast("int"), F.floor(F.length("text") / 3).cast("int")
    span = F.substring(F.col("text"), at + 1, size)
    start = F.octet_length(F.substring(F.col("text"), F.lit(1), at))
    sha = F.when(F.col("doc_id") % 4 == 0, F.sha2(F.lit("x"), 256)).otherwise(F.sha2("text", 256))
    return d.select("doc_id", pack.verify_citation(F.col("text"), F.when(F.col("doc_id") % 4 == 1, "?").otherwise(span), start, start + F.octet_length(span), sha).alias("status"))


@query("""WITH RECURSIVE h AS (SELECT user_id AS qid, event_id AS id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS rank, 60 + event_id % 40 AS head, event_id % 500 AS body FROM events),
k AS (SELECT DISTINCT qid, 0::BIGINT AS r, 0::BIGINT AS total, 0::BIGINT AS bytes, true AS took FROM h
  UNION ALL SELECT k.qid, h.rank, total + head + least(body, 2000 - total - head) + CASE WHEN k.r > 0 THEN 1 ELSE 0 END, head + least(body, 2000 - total - head), true FROM k JOIN h ON h.qid = k.qid AND h.rank = k.r + 1 AND h.rank <= 12 WHERE 2000 - total >= 96 AND head < 2000 - total)
SELECT k.qid, h.id, k.r AS rank, bytes, total FROM k JOIN h ON h.qid = k.qid AND h.rank = k.r WHERE k.r > 0""")
def pack_ledger(spark, sf):
    from pyspark.sql import Window

    e = t(spark, sf, "events")
    h = e.select(F.col("user_id").alias("qid"), F.col("event_id").alias("id"), F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")).cast("long").alias("rank"), (60 + F.col("event_id") % 40).alias("head_bytes"), (F.col("event_id") % 500).alias("body_bytes"))
    return pack.ledger_pack(h, 500, 12)


QUERIES, SQL = query.queries, query.sql
