"""Queries of evaluation, ledgers, mutations and sharding."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from orrery.functions.stage import micros
from orrery.operators import cluster, dense, evaluate, ledger, lexical, mutations
from orrery.plans.base import Registry, t
from orrery.plans.retrieval import _METRIC, _Q, vec_queries

query = Registry()

_TOP = f"""{_Q}, s AS (SELECT qid, vec_id AS id, label, round({_METRIC['cosine']}, 6) AS score FROM q, v),
h AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id::VARCHAR) AS rank FROM s QUALIFY rank <= 20),
rel AS (SELECT q.qid, v.vec_id AS id, 1 + v.vec_id % 3 AS grade FROM q JOIN embeddings e ON e.vec_id = q.qid JOIN v ON v.label = e.label)"""


def hits(spark, sf, k=20):
    return dense.top_k(t(spark, sf, "embeddings"), vec_queries(spark, sf), k)


def relevant(spark, sf):
    v = t(spark, sf, "embeddings")
    q = v.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("qid"), "label")
    return v.join(F.broadcast(q), "label").select("qid", F.col("vec_id").alias("id"), (1 + F.col("vec_id") % 3).alias("grade"))


@query(f"WITH {_TOP} SELECT qid, round((SELECT count(*) FROM h JOIN rel USING (qid, id) WHERE h.qid = x.qid AND rank <= 10) / count(*), 6) AS recall FROM rel x GROUP BY qid")
def eval_recall(spark, sf):
    return evaluate.recall(hits(spark, sf), relevant(spark, sf), 10)


@query(f"WITH {_TOP}, g AS (SELECT qid, id FROM h WHERE rank <= 10), c AS (SELECT * FROM h WHERE id % 4 <> 1) SELECT q.qid, round((SELECT count(*) FROM (SELECT id, row_number() OVER (ORDER BY rank) AS r FROM c WHERE c.qid = q.qid) z WHERE r <= 10 AND id IN (SELECT id FROM g WHERE g.qid = q.qid)) / 10, 6) AS recall FROM q")
def eval_recall_ann(spark, sf):
    """Recall of a search that misses a quarter of the vectors, against the exact one."""
    part = hits(spark, sf).filter("id % 4 <> 1")
    part = part.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy("rank")))
    return evaluate.recall(part, hits(spark, sf, 10), 10, "k")


@query(f"WITH {_TOP}, d AS (SELECT qid, sum(1 / log2(rank + 1)) AS dcg FROM h JOIN rel USING (qid, id) WHERE rank <= 10 GROUP BY qid), i AS (SELECT qid, sum(1 / log2(r + 1)) AS ideal FROM (SELECT qid, row_number() OVER (PARTITION BY qid ORDER BY id) AS r FROM rel) WHERE r <= 10 GROUP BY qid) SELECT qid, round(coalesce(dcg, 0) / ideal, 6) AS ndcg FROM i LEFT JOIN d USING (qid)")
def eval_ndcg_binary(spark, sf):
    return evaluate.ndcg(hits(spark, sf), relevant(spark, sf), 10)


@query(f"WITH {_TOP}, d AS (SELECT qid, sum((pow(2, grade) - 1) / log2(rank + 1)) AS dcg FROM h JOIN rel USING (qid, id) WHERE rank <= 10 GROUP BY qid), i AS (SELECT qid, sum((pow(2, grade) - 1) / log2(r + 1)) AS ideal FROM (SELECT qid, grade, row_number() OVER (PARTITION BY qid ORDER BY grade DESC, id) AS r FROM rel) WHERE r <= 10 GROUP BY qid) SELECT qid, round(coalesce(dcg, 0) / ideal, 6) AS ndcg FROM i LEFT JOIN d USING (qid)")
def eval_ndcg_graded(spark, sf):
    return evaluate.ndcg(hits(spark, sf), relevant(spark, sf), 10, graded=True)


@query(f"WITH {_TOP}, f AS (SELECT qid, min(rank) AS r FROM h JOIN rel USING (qid, id) WHERE id <> qid GROUP BY qid) SELECT qid, round(coalesce(1.0::DOUBLE / r, 0), 6) AS rr, r IS NOT NULL AS hit FROM q LEFT JOIN f USING (qid)")
def eval_mrr(spark, sf):
    return evaluate.reciprocal_rank(hits(spark, sf), relevant(spark, sf).filter("id <> qid"))


@query(f"WITH {_TOP} SELECT qid, id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id::VARCHAR)::INTEGER AS rank FROM s WHERE id % 5 = 2 QUALIFY rank <= 5")
def eval_filtered_truth(spark, sf):
    return dense.top_k(t(spark, sf, "embeddings"), vec_queries(spark, sf), 5, where=F.col("vec_id") % 5 == 2)


_W = r"regexp_extract_all(lower(coalesce({}, '')), '[\p{{L}}\p{{N}}_]+')"


@query(f"""WITH p AS (SELECT a.conv_id AS id, {_W.format('a.text')} AS a, {_W.format('b.text')} AS r FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND a.turn = 0 AND b.turn = 1),
x AS (SELECT id, w, count(*) AS n FROM (SELECT id, unnest(a) AS w FROM p) GROUP BY ALL), y AS (SELECT id, w, count(*) AS n FROM (SELECT id, unnest(r) AS w FROM p) GROUP BY ALL),
c AS (SELECT id, sum(least(x.n, y.n)) AS n FROM x JOIN y USING (id, w) GROUP BY id)
SELECT id, round(CASE WHEN len(a) + len(r) = 0 THEN 1 ELSE 2 * coalesce(n, 0) / (len(a) + len(r)) END, 6) AS f1, array_to_string(a, ' ') = array_to_string(r, ' ') AS exact FROM p LEFT JOIN c USING (id)""")
def eval_token_f1(spark, sf):
    c = t(spark, sf, "conversations")
    a, b = (c.filter(F.col("turn") == i).select(F.col("conv_id").alias("id"), F.col("text").alias(n)) for i, n in ((0, "answer"), (1, "reference")))
    return evaluate.token_f1(a.join(b, "id"))


@query("SELECT event_type, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.95) AS p95, quantile_disc(value, 0.99) AS p99 FROM events GROUP BY event_type")
def stats_percentiles(spark, sf):
    return evaluate.nearest_rank(t(spark, sf, "events"), ["event_type"], "value", {"p50": 0.5, "p95": 0.95, "p99": 0.99})


@query("SELECT user_id, list_sort(list(value))[1 + floor((count(*) - 1) * 0.5 + 0.5)::BIGINT] AS p50, list_sort(list(value))[1 + floor((count(*) - 1) * 0.95 + 0.5)::BIGINT] AS p95 FROM events GROUP BY user_id")
def stats_percentiles_rounded(spark, sf):
    return evaluate.rounded_rank(t(spark, sf, "events"), ["user_id"], "value", {"p50": 0.5, "p95": 0.95})


@query("SELECT event_type, count(*) AS n, min(value) AS min, round(avg(value), 6) AS avg, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.95) AS p95, quantile_disc(value, 0.99) AS p99, max(value) AS max FROM events GROUP BY event_type")
def stats_latency(spark, sf):
    return evaluate.latency(t(spark, sf, "events"), ["event_type"], "value")


@query("WITH r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS r FROM events QUALIFY r <= 50), a AS (SELECT user_id, count(*) AS n, round(avg((value <= 40)::INTEGER), 6) AS within, quantile_disc(value, 0.95) AS p95 FROM r GROUP BY user_id) SELECT *, round(p95 * 1.2, 6) AS loaded_p95, round(p95 * 1.2 * 1.5, 6) AS timeout FROM a")
def slo_window(spark, sf):
    return evaluate.slo(t(spark, sf, "events"), "user_id", "event_id", "value", 50, 40, 1.2)


@query("SELECT event_id, user_id, round(avg(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS 9 PRECEDING), 6) AS moving_avg FROM events")
def stats_sliding(spark, sf):
    return evaluate.moving(t(spark, sf, "events"), "user_id", "event_id", "value", 10).select("event_id", "user_id", "moving_avg")


@query("SELECT event_type, round(avg((value > 0)::INTEGER), 6) AS acknowledged, round(avg((value > 1)::INTEGER), 6) AS found, round(avg((value > 10)::INTEGER), 6) AS matched FROM events GROUP BY event_type")
def eval_kpi(spark, sf):
    v = F.col("value")
    return t(spark, sf, "events").groupBy("event_type").agg(evaluate.rate("acknowledged", v > 0), evaluate.rate("found", v > 1), evaluate.rate("matched", v > 10))


@query()
def eval_bootstrap(spark, sf):
    """Resampling by hashes, which DuckDB hasn't."""
    e = t(spark, sf, "events").select(F.col("event_id").alias("id"), F.col("value").alias("a"), (F.col("value") + F.col("event_id") % 3).alias("b"))
    return evaluate.bootstrap_ci(e, "a", "b", 200)


# ledger: an event is a version of its user's assertion, valid for a day; every seventh is retracted 50 sequences later

_V = """v AS (SELECT 'v' || event_id AS version_id, 'a' || user_id AS assertion_id, event_id AS committed_sequence, epoch_us(ts) AS valid_from,
  CASE WHEN event_id % 3 > 0 THEN epoch_us(ts) + 86400000000 END AS valid_to FROM events),
l AS (SELECT 'v' || event_id AS version_id, event_id AS sequence, 'active' AS state FROM events UNION ALL SELECT 'v' || event_id, event_id + 50, 'retracted' FROM events WHERE event_id % 7 = 0)"""


def versions(spark, sf):
    e = t(spark, sf, "events").withColumn("us", micros("ts"))
    s = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    v = e.select(s("v", "event_id").alias("version_id"), s("a", "user_id").alias("assertion_id"), F.col("event_id").alias("committed_sequence"), F.col("us").alias("valid_from"), F.when(F.col("event_id") % 3 > 0, F.col("us") + 86400000000).alias("valid_to"))
    live = e.select(s("v", "event_id").alias("version_id"), F.col("event_id").alias("sequence"), F.lit("active").alias("state"))
    gone = e.filter("event_id % 7 = 0").select(s("v", "event_id").alias("version_id"), (F.col("event_id") + 50).alias("sequence"), F.lit("retracted").alias("state"))
    return v, live.unionByName(gone)


_AT = 1704844800000000  # 2024-01-10


@query(f"WITH {_V}, s AS (SELECT version_id, max_by(state, sequence) AS state FROM l WHERE sequence <= 600 GROUP BY version_id) SELECT v.version_id, assertion_id, committed_sequence, valid_from, valid_to FROM v JOIN s USING (version_id) WHERE state = 'active' AND committed_sequence <= 600 AND valid_from <= {_AT} AND (valid_to IS NULL OR {_AT} < valid_to) ORDER BY committed_sequence, version_id LIMIT 100")
def ledger_as_of(spark, sf):
    v, life = versions(spark, sf)
    at, seq = ledger.modes("bitemporal", 0, 0, _AT, 600)
    return ledger.as_of(v, life, at, seq, 100).select("version_id", "assertion_id", "committed_sequence", "valid_from", "valid_to")


@query(f"WITH {_V} SELECT committed_sequence AS sequence, 'commit' AS kind, version_id, 'active' AS detail FROM v WHERE committed_sequence BETWEEN 100 AND 300 UNION ALL SELECT sequence, 'transition', version_id, state FROM l WHERE sequence BETWEEN 100 AND 300")
def ledger_history(spark, sf):
    return ledger.history(*versions(spark, sf), 100, 300)


@query(f"WITH {_V}, h AS (SELECT assertion_id, max_by(version_id, committed_sequence) AS version_id FROM v GROUP BY assertion_id ORDER BY assertion_id LIMIT 20) SELECT assertion_id, version_id, committed_sequence FROM h JOIN v USING (assertion_id, version_id)")
def ledger_heads(spark, sf):
    v, _ = versions(spark, sf)
    table = v.groupBy("assertion_id").agg(F.array(F.max_by("version_id", "committed_sequence")).alias("version_ids"))
    return ledger.heads(v, table, 20).select("assertion_id", "version_id", "committed_sequence")


_PT = r"list_transform(list_filter(regexp_extract_all(coalesce(text, ''), '[\p{L}\p{N}]+'), lambda x: strlen(x) <= 256), lambda x: lower(x))"


@query(f"""WITH c AS (SELECT conv_id AS qid, turn AS id, text FROM conversations), q AS (SELECT qid, array_to_string(string_split(text, ' ')[1:6], ' ') AS text FROM c WHERE id = 0),
d AS (SELECT qid, id, {_PT} AS toks FROM c), st AS (SELECT qid, count(*) AS n, avg(len(toks)) AS avgdl FROM d GROUP BY qid),
qt AS (SELECT qid, term, count(*) AS qtf FROM (SELECT qid, unnest({_PT}) AS term FROM q) GROUP BY ALL), tf AS (SELECT qid, id, term, len(toks) AS dl, count(*) AS tf FROM (SELECT qid, id, toks, unnest(toks) AS term FROM d) GROUP BY ALL),
df AS (SELECT qid, term, count(*) AS df FROM tf GROUP BY ALL),
b AS (SELECT tf.qid, id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * greatest(dl, 1) / greatest(avgdl, 1))) * qtf) AS lex FROM tf JOIN qt USING (qid, term) JOIN df USING (qid, term) JOIN st USING (qid) GROUP BY ALL),
r AS (SELECT c.qid, c.id, coalesce(lex > 0, false) AS ok, CASE WHEN coalesce(lex > 0, false) THEN round(lex + (c.id + 1) / 10 * 0.001, 6) ELSE 0 END AS score FROM c LEFT JOIN b USING (qid, id))
SELECT qid, id, score, CASE WHEN ok THEN row_number() OVER (PARTITION BY qid ORDER BY ok DESC, score DESC, id::VARCHAR)::INTEGER END AS rank,
  CASE WHEN ok THEN 'ADMITTED_TO_BOUNDED_POOL,LEXICAL_MATCH,RANKED_CANDIDATE' ELSE 'ADMITTED_TO_BOUNDED_POOL,EXCLUDED_NO_LEXICAL_MATCH' END AS codes FROM r""")
def ledger_recall(spark, sf):
    c = t(spark, sf, "conversations").select(F.col("conv_id").alias("qid"), F.col("turn").alias("id"), "text")
    q = c.filter("id = 0").select("qid", F.array_join(F.slice(F.split("text", " "), 1, 6), " ").alias("text"))
    out = ledger.recall(lexical.pool_bm25(c, q), c.select("qid", "id", (F.col("id") + 1).alias("sequence")), 10)
    return out.withColumn("codes", F.array_join("codes", ","))


_C = "c AS (SELECT event_id AS version_id, user_id AS scope, event_type AS predicate, 'fact' AS kind, floor(value / 20)::BIGINT AS content, event_id % 4 AS ev FROM events), g AS (SELECT scope, predicate, kind, content, min(version_id) AS retained, count(*) AS n, list_sort(list(DISTINCT ev)) AS ev FROM c GROUP BY ALL)"


def consolidated(spark, sf):
    e = t(spark, sf, "events").select(F.col("event_id").alias("version_id"), F.col("user_id").alias("scope"), F.col("event_type").alias("predicate"), F.lit("fact").alias("kind"), F.floor(F.col("value") / 20).alias("content"), F.array(F.col("event_id") % 4).alias("evidence"), F.col("event_id").alias("committed_sequence"))
    return ledger.consolidate(e)


@query(f"WITH {_C} SELECT scope, predicate, content, retained, n, array_to_string(ev, ',') AS evidence FROM g WHERE n > 1")
def ledger_duplicates(spark, sf):
    return consolidated(spark, sf)[0].select("scope", "predicate", "content", "retained", "n", F.array_join(F.col("evidence").cast("array<string>"), ",").alias("evidence"))


@query(f"WITH {_C} SELECT a.scope, a.predicate, a.retained AS one, b.retained AS other FROM g a JOIN g b USING (scope, predicate, kind) WHERE a.retained < b.retained")
def ledger_conflicts(spark, sf):
    return consolidated(spark, sf)[1].select("scope", "predicate", "one", "other")


@query("WITH e AS (SELECT user_id AS scope, row_number() OVER (PARTITION BY user_id ORDER BY event_id) + CASE WHEN user_id % 10 = 0 AND event_id % 2 = 0 THEN 1 ELSE 0 END AS o, event_type AS action, value > 20 AS ok, CASE WHEN event_type = 'error' THEN 'retry' || event_id END AS rec FROM events) SELECT scope, min(o) = 1 AND max(o) = count(*) AND count(DISTINCT o) = count(*) AS contiguous, count(*) FILTER (ok)::INTEGER AS n_steps, coalesce(string_agg(action, '>' ORDER BY o, action) FILTER (ok), '') AS steps, (count(rec))::INTEGER AS recoveries FROM e GROUP BY scope")
def ledger_trajectory(spark, sf):
    o = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id"))
    e = t(spark, sf, "events").select(F.col("user_id").alias("scope"), (o + F.when((F.col("user_id") % 10 == 0) & (F.col("event_id") % 2 == 0), 1).otherwise(0)).alias("ordinal"), F.col("event_type").alias("action"), F.when(F.col("value") > 20, "succeeded").otherwise("failed").alias("outcome"), F.when(F.col("event_type") == "error", F.concat(F.lit("retry"), F.col("event_id").cast("string"))).alias("recovery"))
    return ledger.trajectories(e).select("scope", "contiguous", "n_steps", F.array_join("steps", ">").alias("steps"), F.size("recoveries").alias("recoveries"))


@query("WITH RECURSIVE d AS (SELECT event_id AS s, event_id * 2 + 1 AS t FROM events UNION ALL SELECT event_id, event_id * 3 FROM events WHERE event_id > 0), c AS (SELECT 1::BIGINT AS id, 0 AS depth UNION SELECT t, depth + 1 FROM c JOIN d ON s = id) SELECT id, min(depth) AS depth FROM c GROUP BY id")
def ledger_delete_closure(spark, sf):
    e = t(spark, sf, "events")
    d = e.select(F.col("event_id").alias("source"), (F.col("event_id") * 2 + 1).alias("target")).unionByName(e.filter("event_id > 0").select(F.col("event_id").alias("source"), (F.col("event_id") * 3).alias("target")))
    return ledger.deletion_closure(d, spark.range(1, 2).select("id"))


@query("""WITH o AS (SELECT event_id AS ordinal, 'k' || (user_id % 40) AS key, event_type AS content FROM events), h AS (SELECT 'k' || i AS key, 'h' || i AS head_id, CASE WHEN i % 2 = 0 THEN 'view' ELSE 'click' END AS hc FROM range(30) AS r(i))
SELECT ordinal, o.key, content, coalesce(head_id, '') AS expected, CASE WHEN head_id IS NULL THEN 'new' WHEN hc = content THEN 'duplicate' ELSE 'contradiction' END AS relation FROM o LEFT JOIN h USING (key)""")
def ledger_observations(spark, sf):
    o = t(spark, sf, "events").select(F.col("event_id").alias("ordinal"), F.concat(F.lit("k"), F.col("user_id") % 40).alias("key"), F.col("event_type").alias("content"))
    h = spark.range(30).select(F.concat(F.lit("k"), F.col("id").cast("string")).alias("key"), F.concat(F.lit("h"), F.col("id").cast("string")).alias("head_id"), F.when(F.col("id") % 2 == 0, "view").otherwise("click").alias("head_content"))
    return ledger.observations(o, h).withColumn("expected", F.array_join("expected", ","))


@query("WITH p AS (SELECT event_type AS stream, user_id % 4 AS proj, max(event_id) AS applied FROM events GROUP BY ALL) SELECT stream, min(applied) AS visible, max(applied) - min(applied) AS lag FROM p GROUP BY stream")
def ledger_visibility(spark, sf):
    p = t(spark, sf, "events").groupBy(F.col("event_type").alias("stream"), F.col("user_id") % 4).agg(F.max("event_id").alias("applied"))
    return ledger.visibility(p)


# mutations


@query("WITH l AS (SELECT user_id AS id, event_id AS lsn, CASE WHEN event_type = 'error' THEN 'delete' ELSE 'put' END AS op, value FROM events) SELECT id, max(lsn) AS lsn, max_by(value, lsn) AS value FROM l GROUP BY id HAVING max_by(op, lsn) <> 'delete'")
def wal_last_write(spark, sf):
    e = t(spark, sf, "events").select(F.col("user_id").alias("id"), F.col("event_id").alias("lsn"), F.when(F.col("event_type") == "error", "delete").otherwise("put").alias("op"), "value")
    return mutations.latest(e, "id", "lsn").select("id", "lsn", "value")


@query("""WITH m AS (SELECT event_id AS arrival, 9 * (event_id // 10) + least(event_id % 10, 8) AS s, event_id % 20 AS r FROM events WHERE event_id <> 525),
hole AS (SELECT min(g) AS hole FROM generate_series(21, (SELECT max(s) + 1 FROM m)) AS x(g) WHERE g NOT IN (SELECT s FROM m))
SELECT s AS sequence, CASE WHEN r = 9 THEN 'x' || arrival ELSE 'm' || s END AS mutation_id,
  CASE WHEN s > 800 THEN 'beyond' WHEN s > hole THEN 'gap' WHEN r = 19 THEN 'duplicate' WHEN r = 9 THEN 'conflict' WHEN s <= 20 THEN 'already_applied' ELSE 'apply' END AS status FROM m, hole""")
def mutation_replay(spark, sf):
    """Every tenth event repeats the sequence before it, in turn with its content or another; one sequence is missing."""
    e, i = t(spark, sf, "events").filter("event_id <> 525"), F.col("event_id")
    s = (F.floor(i / 10) * 9 + F.least(i % 10, F.lit(8))).cast("long")
    name = F.when(i % 20 == 9, F.concat(F.lit("x"), i.cast("string"))).otherwise(F.concat(F.lit("m"), s.cast("string")))
    m = e.select(s.alias("sequence"), name.alias("mutation_id"), F.concat(F.lit("h"), s.cast("string")).alias("hash"), i.alias("arrival"))
    return mutations.replay(m, 20, 800)


@query("WITH b AS (SELECT 'b' || (event_id % 990) AS id, event_id FROM events) SELECT count(*) FILTER (dup > 1) AS repeated, count(*) AS n FROM (SELECT id, count(*) OVER (PARTITION BY id) AS dup FROM b)")
def batch_duplicates(spark, sf):
    b = t(spark, sf, "events").select(F.concat(F.lit("b"), F.col("event_id") % 990).alias("id"))
    return b.groupBy("id").agg(F.count("*").alias("c")).agg(F.coalesce(F.sum(F.when(F.col("c") > 1, F.col("c"))), F.lit(0)).alias("repeated"), F.sum("c").alias("n"))


@query("SELECT CASE WHEN vec_id % 11 = 0 THEN '' ELSE 'v' || vec_id END AS id, CASE WHEN (SELECT count(*) FROM embeddings WHERE vec_id % 11 = 0) > 1 THEN 'rejected_duplicate' ELSE 'ok' END AS status FROM embeddings")
def batch_rejected(spark, sf):
    v = t(spark, sf, "embeddings").select(F.when(F.col("vec_id") % 11 == 0, "").otherwise(F.concat(F.lit("v"), F.col("vec_id").cast("string"))).alias("id"), F.col("embedding").alias("vec"))
    return mutations.batch_check(v, 64)


@query("SELECT 'v' || vec_id AS id, CASE WHEN vec_id % 9 = 0 THEN 'failed' ELSE 'ok' END AS status FROM embeddings")
def batch_failed(spark, sf):
    vec = F.when(F.col("vec_id") % 9 == 0, F.slice("embedding", 1, 3)).otherwise(F.col("embedding"))
    return mutations.batch_check(t(spark, sf, "embeddings").select(F.concat(F.lit("v"), F.col("vec_id").cast("string")).alias("id"), vec.alias("vec")), 64)


@query("SELECT i AS id, CASE WHEN i >= (SELECT count(*) FROM customer) THEN 'not_found' WHEN i % 5 = 0 THEN 'already_deleted' ELSE 'deleted' END AS status FROM range(0, 3000, 7) AS r(i)")
def delete_status(spark, sf):
    rows = t(spark, sf, "customer").select(F.col("c_custkey").alias("id"), (F.col("c_custkey") % 5 == 0).alias("deleted"))
    return mutations.delete_status(spark.range(0, 3000, 7), rows)


@query("SELECT i AS id, CASE WHEN i >= (SELECT count(*) FROM customer) THEN 'created' ELSE 'updated' END AS status FROM range(0, 3000, 7) AS r(i)")
def update_status(spark, sf):
    return mutations.update_status(spark.range(0, 3000, 7), t(spark, sf, "customer").select(F.col("c_custkey").alias("id")))


@query("SELECT o_orderkey AS id FROM orders WHERE o_orderkey % 8 = 0 AND o_orderstatus = 'F'")
def insert_reused(spark, sf):
    o = t(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), "o_orderstatus")
    return mutations.reused(o.filter("o_orderstatus = 'F'"), o.filter("id % 8 = 0")).select("id")


@query("""WITH d AS (SELECT doc_id AS k, sha256(text) AS e FROM documents), l AS (SELECT k, CASE WHEN k % 10 = 1 THEN 'changed' ELSE e END AS e FROM d WHERE k % 7 <> 0), m AS (SELECT k, e, k % 4 AS n FROM d WHERE k % 9 <> 0),
x AS (SELECT coalesce(l.k, m.k) AS key, CASE WHEN m.k IS NULL THEN 'new' WHEN l.k IS NULL AND n + 1 >= 3 THEN 'confirmed_delete' WHEN l.k IS NULL THEN 'missing' WHEN l.e <> m.e THEN 'updated' END AS change FROM l FULL JOIN m ON l.k = m.k) FROM x WHERE change IS NOT NULL""")
def sync_diff(spark, sf):
    d = t(spark, sf, "documents").select(F.col("doc_id").alias("key"), F.sha2("text", 256).alias("etag"))
    now = d.filter("key % 7 <> 0").withColumn("etag", F.when(F.col("key") % 10 == 1, "changed").otherwise(F.col("etag")))
    return mutations.diff(now, d.filter("key % 9 <> 0").withColumn("missing_count", F.col("key") % 4))


_DAY = 86_400_000


@query(f"""WITH m AS (SELECT doc_id AS key, ['active', 'marked_for_deletion', 'confirmed_missing', 'hard_delete_scheduled'][1 + doc_id % 4] AS state, doc_id % 5 = 0 AS seen, doc_id % 4 AS n, doc_id % 14 * {_DAY} AS since FROM documents)
SELECT key, CASE WHEN seen THEN 'active' WHEN state = 'hard_delete_scheduled' THEN state WHEN state = 'confirmed_missing' AND {14 * _DAY} - since >= {7 * _DAY} THEN 'hard_delete_scheduled' WHEN state = 'confirmed_missing' THEN state WHEN n + 1 >= 3 THEN 'confirmed_missing' ELSE 'marked_for_deletion' END AS state FROM m""")
def lifecycle_states(spark, sf):
    d = F.col("doc_id")
    states = F.array(*[F.lit(s) for s in ("active", "marked_for_deletion", "confirmed_missing", "hard_delete_scheduled")])
    m = t(spark, sf, "documents").select(d.alias("key"), F.get(states, (d % 4).cast("int")).alias("state"), (d % 5 == 0).alias("seen"), (d % 4).alias("missing_count"), (d % 14 * _DAY).alias("since"))
    return mutations.lifecycle(m, 14 * _DAY)


@query("SELECT state, count(*) AS n FROM (SELECT CASE WHEN doc_id % 3 = 0 THEN 'active' ELSE 'missing' END AS state FROM documents) GROUP BY state")
def manifest_counts(spark, sf):
    return t(spark, sf, "documents").groupBy(F.when(F.col("doc_id") % 3 == 0, "active").otherwise("missing").alias("state")).agg(F.count("*").alias("n"))


@query("SELECT sha256(text) AS sha256, count(*) AS copies, min(doc_id) AS doc_id FROM documents GROUP BY 1")
def content_dedup(spark, sf):
    d = t(spark, sf, "documents")
    return mutations.content_dedup(d.select("doc_id", "text"), "text", "doc_id").select("sha256", "copies", "doc_id")


@query("SELECT event_id, CASE WHEN event_type NOT IN ('error', 'click') THEN 'ok' WHEN event_type = 'click' OR event_id % 5 >= 3 THEN 'dead_letter' ELSE 'retry' END AS route FROM events")
def dlq_routing(spark, sf):
    e = t(spark, sf, "events").select("event_id", F.when(F.col("event_type") == "click", "parse").when(F.col("event_type") == "error", "io").alias("error"), (F.col("event_id") % 5).alias("attempt"))
    return mutations.route_failures(e).select("event_id", "route")


@query("WITH l AS (SELECT event_id AS o, CASE WHEN event_id = 0 THEN 'header' WHEN event_id < 400 THEN 'record' WHEN event_id < 700 THEN 'node' WHEN event_id = 800 THEN 'record' ELSE 'edge' END AS s, CASE WHEN event_id % 97 = 5 THEN 0 ELSE event_id END AS id FROM events) SELECT b.o AS ordinal, CASE WHEN a.s = 'edge' AND b.s = 'record' THEN 'section_order' ELSE 'id_order' END AS violation FROM l a JOIN l b ON b.o = a.o + 1 WHERE (a.s = 'edge' AND b.s = 'record') OR (a.s = b.s AND b.id <= a.id)")
def bundle_order_check(spark, sf):
    i = F.col("event_id")
    s = F.when(i == 0, "header").when(i < 400, "record").when(i < 700, "node").when(i == 800, "record").otherwise("edge")
    return mutations.bundle_order(t(spark, sf, "events").select(i.alias("ordinal"), s.alias("section"), F.when(i % 97 == 5, 0).otherwise(i).alias("id")))


@query("WITH m AS (SELECT doc_id % 100 AS c, max(doc_id) AS s FROM documents WHERE doc_id % 3 = 0 GROUP BY 1) SELECT (SELECT count(*) FROM (SELECT i FROM range(150) r(i) WHERE i NOT IN (SELECT c FROM m) UNION ALL SELECT c FROM m WHERE s % 2 = 0)) AS records, (SELECT count(*) FROM range(300) r(i) WHERE i % 150 NOT IN (SELECT c FROM m) AND (i + 1) % 150 NOT IN (SELECT c FROM m) AND (i * 7) % 150 NOT IN (SELECT c FROM m)) AS edges")
def generation_materialize(spark, sf):
    s = lambda c: F.concat(F.lit("c"), c.cast("string"))
    m = t(spark, sf, "documents").filter("doc_id % 3 = 0").select(F.col("doc_id").alias("sequence"), s(F.col("doc_id") % 100).alias("chunk_id"), F.when(F.col("doc_id") % 2 == 0, "upsert").otherwise("delete").alias("op"), F.lit("p").alias("payload"))
    rec = spark.range(150).select(s(F.col("id")).alias("chunk_id"), F.lit("old").alias("payload"))
    e = spark.range(300).select(F.col("id").alias("edge_id"), s(F.col("id") % 150).alias("from_id"), s((F.col("id") + 1) % 150).alias("to_id"), F.array(s(F.col("id") * 7 % 150)).alias("evidence"))
    r, left = mutations.materialize(rec, e, m)
    return r.agg(F.count("*").alias("records")).crossJoin(left.agg(F.count("*").alias("edges")))


_STEPS = [("none", "stage"), ("staged", "stage"), ("staged", "catch_up"), ("catching_up", "ready"), ("ready", "activate"), ("active", "rollback"), ("none", "activate"), ("failed", "ready")]
_TO = ["staged", "staged", "catching_up", "ready", "active", "ready", "invalid", "invalid"]


@query("SELECT * FROM (VALUES " + ", ".join(f"({i}, '{s}')" for i, s in enumerate(_TO)) + ") AS v(i, next)")
def generation_states(spark, sf):
    rows = spark.range(1).select(F.posexplode(F.array(*[F.struct(F.lit(s).alias("s"), F.lit(a).alias("a")) for s, a in _STEPS])).alias("i", "x"))
    return rows.select("i", mutations.generation_step(F.col("x.s"), F.col("x.a")).alias("next"))


@query("SELECT doc_id AS id, doc_id % 6 AS version, 1 + (SELECT max(doc_id % 6) FROM documents WHERE lang = 'de' AND doc_id % 5 > 0) AS new_version FROM documents WHERE lang = 'de' AND doc_id % 5 > 0")
def reindex_plan(spark, sf):
    d = t(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.col("lang").alias("category"), F.when(F.col("doc_id") % 5 > 0, "active").otherwise("missing").alias("state"), (F.col("doc_id") % 6).alias("version"))
    return mutations.reindex_plan(d, "de")


@query("SELECT doc_id % 50 AS document_id, max(doc_id) AS revision, count(*) AS chunks FROM documents GROUP BY 1")
def document_replace(spark, sf):
    d = t(spark, sf, "documents")
    rev = d.groupBy((F.col("doc_id") % 50).alias("document_id")).agg(F.max("doc_id").alias("m"), F.count("*").alias("n"))
    chunks = rev.select("document_id", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("i"), "m").select("document_id", F.col("m").alias("revision"), "i")
    heads = d.select((F.col("doc_id") % 50).alias("document_id"), F.col("doc_id").alias("revision"), F.col("doc_id").cast("string").alias("request_hash"))
    return mutations.replace_document(chunks, heads).groupBy("document_id", "revision").agg(F.count("*").alias("chunks"))


@query("SELECT user_id, count(*) FILTER (d > 1) AS gaps FROM (SELECT user_id, event_id // 100 - lag(event_id // 100) OVER (PARTITION BY user_id ORDER BY event_id // 100) AS d FROM events) GROUP BY user_id")
def sequence_gaps(spark, sf):
    return mutations.first_gap(t(spark, sf, "events").select("user_id", F.floor(F.col("event_id") / 100).alias("seq")), "seq", "user_id")


# cluster


@query(f"WITH {_Q}, s AS (SELECT qid, vec_id AS id, round({_METRIC['cosine']}, 6) AS score FROM q, v) SELECT qid, id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id::VARCHAR)::INTEGER AS rank FROM s QUALIFY rank <= 10")
def shard_merge(spark, sf):
    """Four overlapping shards; their merge is the global search."""
    v, q = t(spark, sf, "embeddings"), vec_queries(spark, sf)
    parts = [dense.top_k(v.filter((F.col("vec_id") % 4 == i) | (F.col("vec_id") % 4 == (i + 1) % 4)), q, 10).select("qid", "id", "score") for i in range(4)]
    return cluster.merge(parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3]), 10)


@query()
def ring_distribution(spark, sf):
    """The ring's hash wraps at 64 bits, which SQL can't express."""
    return cluster.distribution(cluster.route(t(spark, sf, "documents").select("doc_id"), "doc_id", ["a", "b", "c", "d"]))


@query("SELECT user_id AS qid, count(*) FILTER (event_type <> 'error') AS answered, round(avg((event_type <> 'error')::INTEGER), 6) AS coverage, bool_or(event_type = 'error') AS partial FROM events GROUP BY 1")
def fanout_coverage(spark, sf):
    return cluster.coverage(t(spark, sf, "events").select(F.col("user_id").alias("qid"), F.col("event_id").alias("shard"), (F.col("event_type") != "error").alias("ok")))


@query("SELECT lang AS name, count(DISTINCT source) AS shards, sum(n_chars)::BIGINT AS vectors, count(DISTINCT CASE WHEN lang = 'de' THEN doc_id % 2 ELSE 0 END) = 1 AS same_schema FROM documents GROUP BY lang")
def collection_merge(spark, sf):
    return cluster.collections(t(spark, sf, "documents").select(F.col("lang").alias("name"), F.col("source").alias("shard"), F.when(F.col("lang") == "de", F.col("doc_id") % 2).otherwise(0).alias("dimensions"), F.lit("cosine").alias("metric"), F.col("n_chars").alias("vectors")))


@query("SELECT o_custkey, o_orderkey FROM orders WHERE o_custkey > 500 OR (o_custkey = 500 AND o_orderkey > 7000) ORDER BY o_custkey, o_orderkey LIMIT 50")
def page_after_token(spark, sf):
    return cluster.page(t(spark, sf, "orders").select("o_custkey", "o_orderkey"), ["o_custkey", "o_orderkey"], {"o_custkey": 500, "o_orderkey": 7000}, 50)


@query("SELECT c_custkey, c_name FROM customer WHERE c_name LIKE 'Customer#00000001%' ORDER BY c_name LIMIT 5")
def scan_prefix(spark, sf):
    return t(spark, sf, "customer").filter(F.col("c_name").startswith("Customer#00000001")).orderBy("c_name").limit(5).select("c_custkey", "c_name")


@query("SELECT doc_id, text FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1) AND text IS NOT NULL")
def scan_live_texts(spark, sf):
    live = t(spark, sf, "labels").filter("quality = 1").select("doc_id")
    return t(spark, sf, "documents").select("doc_id", "text").filter("text is not null").join(live, "doc_id", "left_semi")


@query("SELECT doc_id, lang, source FROM documents WHERE doc_id = 17 AND lang IS NOT NULL")
def point_get(spark, sf):
    return t(spark, sf, "documents").filter((F.col("doc_id") == 17) & F.col("lang").isNotNull()).select("doc_id", "lang", "source")


QUERIES, SQL = query.queries, query.sql
