"""Queries of dense, lexical and fused retrieval, with their oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from orrery.functions.text import sql_tokens, tokens
from orrery.operators import dense, fusion, lexical
from orrery.plans.base import Registry, t


query = Registry()


def vec_queries(spark, sf, all_rows: bool = False) -> DataFrame:
    """The vectors with an id divisible by 50, or all."""
    return t(spark, sf, "embeddings").filter(F.lit(all_rows) | (F.col("vec_id") % 50 == 0)).select(F.col("vec_id").alias("qid"), F.col("embedding").alias("qvec"))


def text_queries(spark, sf) -> DataFrame:
    return t(spark, sf, "benchmark").select(F.col("item_id").alias("qid"), "text")


_INDEXES: dict[tuple, lexical.Index] = {}


def index(spark, sf) -> lexical.Index:
    """The index of the documents, built and stored once a session: the tables don't change."""
    key = (spark.sparkContext.applicationId, sf)
    if key not in _INDEXES:
        _INDEXES[key] = lexical.build_index(t(spark, sf, "documents"))
    return _INDEXES[key]


_Q = "q AS (SELECT vec_id AS qid, embedding::DOUBLE[] AS qv FROM embeddings WHERE vec_id % 50 = 0), v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings)"
_METRIC = {"cosine": "list_cosine_similarity(qv, e)", "l2": "1 / (1 + pow(list_distance(qv, e), 2))", "ip": "list_inner_product(qv, e)"}


def _dense_sql(metric: str, k: int = 10, where: str = "true", all_rows: bool = False, final: str = "SELECT qid, id, score, rank FROM r WHERE rank <= {k}") -> str:
    return f"""WITH {_Q.replace(' WHERE vec_id % 50 = 0', '') if all_rows else _Q}, s AS (SELECT qid, vec_id AS id, label, round({_METRIC[metric]}, 6) AS score FROM q, v WHERE {where}),
r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id::VARCHAR)::INTEGER AS rank FROM s) """ + final.format(k=k)


@query(_dense_sql("cosine", all_rows=True))
def dense_topk_cosine(spark, sf):
    return dense.top_k(t(spark, sf, "embeddings"), vec_queries(spark, sf, True), 10)


@query(_dense_sql("l2"))
def dense_topk_l2(spark, sf):
    return dense.top_k(t(spark, sf, "embeddings"), vec_queries(spark, sf), 10, "l2")


@query(_dense_sql("ip"))
def dense_topk_ip(spark, sf):
    return dense.top_k(t(spark, sf, "embeddings"), vec_queries(spark, sf), 10, "ip")


@query(f"WITH {_Q} SELECT qid, vec_id AS id, round({_METRIC['cosine']}, 6) AS cosine, round({_METRIC['l2']}, 6) AS l2, round({_METRIC['ip']}, 6) AS ip FROM q, v")
def dense_scores(spark, sf):
    return dense.scores(t(spark, sf, "embeddings"), vec_queries(spark, sf))  # a stated query set against all rows


@query(_dense_sql("cosine", where="label IN (1, 3)", all_rows=True))
def dense_topk_filtered(spark, sf):
    return dense.top_k(t(spark, sf, "embeddings"), vec_queries(spark, sf, True), 10, where=F.col("label").isin(1, 3))


@query(_dense_sql("cosine", 50, final="SELECT qid, id, score, rank FROM r WHERE score >= 0.2 AND rank <= {k}"))
def dense_threshold(spark, sf):
    return dense.top_k(t(spark, sf, "embeddings"), vec_queries(spark, sf), 50, min_score=0.2)


@query(
    _dense_sql("cosine", final="")
    + """, p AS (SELECT qid, id, label, score, rank FROM r WHERE rank <= 40),
g AS (SELECT *, row_number() OVER (PARTITION BY qid, label ORDER BY rank) AS n FROM p)
SELECT qid, id, score, label, place AS rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY rank)::INTEGER AS place FROM g WHERE n <= 1) WHERE place <= 10"""
)
def dense_group_cap(spark, sf):
    v = t(spark, sf, "embeddings")
    hits = dense.top_k(v, vec_queries(spark, sf), 4 * 10).join(v.select(F.col("vec_id").alias("id"), "label"), "id")
    return dense.group_cap(hits, F.col("label"), 10).select("qid", "id", "score", "label", "rank")


@query(
    _dense_sql("cosine", final="")
    + """, p AS (SELECT *, count(*) OVER (PARTITION BY qid) AS seen, count(*) FILTER (label = 4) OVER (PARTITION BY qid) AS found FROM r WHERE rank <= 50)
SELECT qid, id, score, place AS rank, found < 10 AND seen >= 50 AS candidate_limited FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY rank)::INTEGER AS place FROM p WHERE label = 4) WHERE place <= 10"""
)
def dense_postfilter_window(spark, sf):
    return dense.windowed_filter(t(spark, sf, "embeddings"), vec_queries(spark, sf), 10, F.col("label") == 4, dense.window_size(10, "post"))


@query(_dense_sql("cosine", where="vec_id % 10 <> 3"))
def dense_tombstone_scan(spark, sf):
    v = t(spark, sf, "embeddings")
    return dense.top_k(dense.live(v, v.filter("vec_id % 10 = 3").select(F.col("vec_id").alias("id"))), vec_queries(spark, sf), 10)


@query("SELECT count(*) FILTER (vec_id % 10 = 3)::BIGINT AS deleted, count(*) AS capacity, round(count(*) FILTER (vec_id % 10 = 3) / count(*), 6) AS ratio, count(*) FILTER (vec_id % 10 = 3) / count(*) >= 0.1 AS compact FROM embeddings")
def dense_tombstone_ratio(spark, sf):
    n = t(spark, sf, "embeddings").agg(F.count_if(F.col("vec_id") % 10 == 3).alias("deleted"), F.count("*").alias("capacity"))
    return n.select("deleted", "capacity", F.round(F.col("deleted") / F.col("capacity"), 6).alias("ratio"), (F.col("deleted") / F.col("capacity") >= 0.1).alias("compact"))


@query(_dense_sql("cosine"))
def dense_quantized_rescored(spark, sf):
    """Candidates well over k, so that the exact rescoring finds the exact top k here."""
    return dense.quantized_top_k(t(spark, sf, "embeddings"), vec_queries(spark, sf), 10, candidates=64)


@query()
def dense_mock_hybrid(spark, sf):
    """Dense search by the mock embedder, fused with BM25; the embedder is a byte-wise hash, which SQL can't express."""
    d = dense.mock_embedding(t(spark, sf, "documents").select(F.col("doc_id").alias("vec_id"), "text"))
    q = text_queries(spark, sf).filter("qid % 50 = 0")
    de = dense.top_k(d, dense.mock_embedding(q).select("qid", F.col("embedding").alias("qvec")), 40)
    return fusion.hybrid(de, lexical.search(index(spark, sf), q, 40), 10)


_LEX = f"""dt AS (SELECT doc_id AS id, {sql_tokens('text')} AS toks FROM documents), dl AS (SELECT id, toks, len(toks) AS dl FROM dt WHERE len(toks) > 0),
st AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM dl),
qt AS (SELECT qid, term, count(*) AS qtf FROM (SELECT item_id AS qid, unnest({sql_tokens('text')}) AS term FROM benchmark) GROUP BY ALL),
tf AS (SELECT id, dl, term, count(*) AS tf FROM (SELECT id, dl, unnest(toks) AS term FROM dl) WHERE term IN (SELECT term FROM qt) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
bs AS (SELECT qid, id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl)) * qtf), 6) AS score
  FROM tf JOIN df USING (term) JOIN qt USING (term) CROSS JOIN st GROUP BY qid, id),
br AS (SELECT qid, id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id::VARCHAR)::INTEGER AS rank FROM bs),
qn AS (SELECT qid, count(*) AS n FROM qt GROUP BY qid),
os AS (SELECT qid, id, round(count(*) / any_value(qn.n), 6) AS score FROM tf JOIN qt USING (term) JOIN qn USING (qid) GROUP BY qid, id),
orr AS (SELECT qid, id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id::VARCHAR)::INTEGER AS rank FROM os)"""


@query(f"WITH x AS (SELECT doc_id, unnest({sql_tokens('text')}) AS term FROM documents) SELECT doc_id, term, count(*) AS tf FROM x GROUP BY ALL")
def lex_tokens(spark, sf):
    return lexical.postings(t(spark, sf, "documents")).select(F.col("id").alias("doc_id"), "term", "tf")


_SAMPLES = ("parseHTTPServer2", "snake_case_name", "kebab-case", "C++ and C#", "::std::vec", "a1B2c", "Größe_X", "XMLHttpRequest", "plain", "v2.0", "--", "ünïCode9")


@query("SELECT s, unnest(" + sql_tokens("s") + ") AS term FROM (VALUES " + ", ".join(f"('{s}')" for s in _SAMPLES) + ") AS x(s)")
def lex_identifiers(spark, sf):
    return spark.range(1).select(F.explode(F.array(*[F.lit(s) for s in _SAMPLES])).alias("s")).select("s", F.explode(tokens(F.col("s"))).alias("term"))


@query("WITH " + _LEX + " SELECT n AS n_docs, (SELECT sum(dl) FROM dl)::BIGINT AS total_terms, round(avgdl, 6) AS avgdl FROM st")
def lex_corpus_stats(spark, sf):
    return lexical.corpus_stats(t(spark, sf, "documents")).withColumn("avgdl", F.round("avgdl", 6))


@query("WITH " + _LEX + " SELECT term, df, round(ln(1 + (n - df + 0.5) / (df + 0.5)), 6) AS idf FROM df, st")
def lex_idf(spark, sf):
    own = index(spark, sf)
    df = lexical.matches(own, lexical.query_terms(text_queries(spark, sf))).select("term", "df").distinct()
    return df.withColumn("n_docs", F.lit(own.n_docs)).select("term", "df", F.round(lexical.idf(), 6).alias("idf"))


@query(f"""WITH d AS (SELECT doc_id AS id, CASE WHEN doc_id % 10 = 4 THEN 'renewedWord and ' || text ELSE text END AS text FROM documents WHERE doc_id % 10 <> 3),
x AS (SELECT id, unnest({sql_tokens('text')}) AS term FROM d), tf AS (SELECT id, term, count(*) AS tf FROM x GROUP BY ALL)
SELECT term, count(*) AS df, sum(tf)::BIGINT AS total, (SELECT count(DISTINCT id) FROM x) AS n_docs, round((SELECT count(*) / count(DISTINCT id) FROM x), 6) AS avgdl FROM tf GROUP BY term""")
def lex_index_update(spark, sf):
    """The stored index after documents were removed and others upserted."""
    d = t(spark, sf, "documents")
    new = d.filter("doc_id % 10 = 4").select("doc_id", F.concat(F.lit("renewedWord and "), "text").alias("text"))
    now = lexical.update_index(index(spark, sf), d.filter("doc_id % 10 = 3").select(F.col("doc_id").alias("id")), new)
    return now.rows.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("total")).select("term", "df", "total", F.lit(now.n_docs).alias("n_docs"), F.round(F.lit(now.avgdl), 6).alias("avgdl"))


@query("WITH " + _LEX + " SELECT * FROM br WHERE rank <= 10")
def lex_bm25_topk(spark, sf):
    return lexical.search(index(spark, sf), text_queries(spark, sf), 10)


@query("WITH " + _LEX + " SELECT * FROM orr WHERE rank <= 10")
def lex_overlap_topk(spark, sf):
    return lexical.overlap(index(spark, sf), text_queries(spark, sf), 10)


def _fused(w1: float, w2: float, k: int = 10) -> str:
    return f"""WITH {_LEX}, u AS (SELECT qid, id, {w1} / (60 + rank) AS part FROM br WHERE rank <= 40 UNION ALL SELECT qid, id, {w2} / (60 + rank) FROM orr WHERE rank <= 40),
f AS (SELECT qid, id, round(sum(part), 9) AS score FROM u WHERE part > 0 GROUP BY qid, id)
SELECT qid, id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id::VARCHAR)::INTEGER AS rank FROM f QUALIFY rank <= {k}"""


@query(_fused(1.0, 1.0))
def fusion_rrf(spark, sf):
    d, q = index(spark, sf), text_queries(spark, sf)
    return fusion.rrf([(lexical.search(d, q, 40), 1.0), (lexical.overlap(d, q, 40), 1.0)], 10)


@query(_fused(0.7, 0.3))
def fusion_weighted(spark, sf):
    bm25, overlap = lexical.search_and_overlap(index(spark, sf), text_queries(spark, sf), 40)
    return fusion.rrf([(bm25, 0.7), (overlap, 0.3), (overlap, 0.0)], 10)


@query(f"""WITH {_LEX}, s AS (SELECT item_id AS qid, v.vec_id AS id, round(list_cosine_similarity(x.embedding::DOUBLE[], v.embedding::DOUBLE[]), 6) AS score
  FROM benchmark JOIN embeddings x ON x.vec_id = item_id CROSS JOIN embeddings v WHERE v.vec_id IN (SELECT doc_id FROM documents)),
de AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id::VARCHAR) AS rank FROM s QUALIFY rank <= 40),
lex AS (SELECT qid, id, rank FROM br WHERE rank <= 40),
kept AS (SELECT qid, id, row_number() OVER (PARTITION BY qid ORDER BY rank) AS rank FROM de
  WHERE score > 0 OR (qid, id) IN (SELECT (qid, id) FROM lex) OR qid NOT IN (SELECT qid FROM lex)),
u AS (SELECT qid, id, 1.0 / (60 + rank) AS part FROM kept UNION ALL SELECT qid, id, 1.0 / (60 + rank) FROM lex),
f AS (SELECT qid, id, round(sum(part), 9) AS score FROM u GROUP BY qid, id)
SELECT qid, id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id::VARCHAR)::INTEGER AS rank FROM f QUALIFY rank <= 10""")
def text_search_hybrid(spark, sf):
    """Hybrid search: dense hits by the vectors of `embeddings` (a row's id is that of the document or query it stands for), fused with
    BM25 hits by the texts."""
    q, v = text_queries(spark, sf), t(spark, sf, "embeddings")
    n = fusion.pool_size(10, True)
    asked = q.select("qid").join(v.select(F.col("vec_id").alias("qid"), F.col("embedding").alias("qvec")), "qid")
    own = v.join(t(spark, sf, "documents").select(F.col("doc_id").alias("vec_id")), "vec_id", "left_semi")
    return fusion.hybrid(dense.top_k(own, asked, n), lexical.search(index(spark, sf), q, n), 10)


@query(f"""WITH {_Q}, s AS (SELECT qid, vec_id AS id, round({_METRIC['cosine']}, 6) AS score FROM q, v),
de AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id::VARCHAR) AS rank FROM s QUALIFY rank <= 400),
lex AS (SELECT qid, vec_id AS id, row_number() OVER (PARTITION BY qid ORDER BY vec_id) AS rank FROM q, v WHERE qid >= 100 AND vec_id % 20 = qid // 50 % 20),
kept AS (SELECT qid, id, row_number() OVER (PARTITION BY qid ORDER BY rank) AS rank FROM de WHERE score > 0 OR qid < 100 OR id % 20 = qid // 50 % 20),
u AS (SELECT qid, id, 1.0 / (60 + rank) AS part FROM kept UNION ALL SELECT qid, id, 1.0 / (60 + rank) FROM lex),
f AS (SELECT qid, id, round(sum(part), 9) AS score FROM u GROUP BY qid, id)
SELECT qid, id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id::VARCHAR)::INTEGER AS rank FROM f QUALIFY rank <= 30""")
def hybrid_rule(spark, sf):
    v, q = t(spark, sf, "embeddings"), vec_queries(spark, sf)
    lex = v.crossJoin(F.broadcast(q.select("qid"))).filter("qid >= 100 and vec_id % 20 = qid div 50 % 20").select("qid", F.col("vec_id").alias("id"))
    lex = lex.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy("id")))
    return fusion.hybrid(dense.top_k(v, q, 400), lex, 30)


@query("WITH " + _LEX + f""", qd AS (SELECT qid, list(term) AS terms FROM qt GROUP BY qid)
, h AS (SELECT br.qid, br.id, br.score AS before, round(len(list_intersect(terms, list_distinct(toks))) / len(terms), 6) AS score FROM br JOIN qd USING (qid) JOIN dl USING (id) WHERE rank <= 20)
SELECT qid, id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, before DESC, id::VARCHAR)::INTEGER AS rank FROM h""")
def rerank_overlap(spark, sf):
    d, q = t(spark, sf, "documents"), text_queries(spark, sf)
    return fusion.overlap_rerank(lexical.search(index(spark, sf), q, 20), q, d)


@query(_dense_sql("cosine"))
def rerank_identity(spark, sf):
    return fusion.identity_rerank(dense.top_k(t(spark, sf, "embeddings"), vec_queries(spark, sf), 10))


@query(f"""WITH RECURSIVE {_Q}, s AS (SELECT qid, vec_id AS id, e, round({_METRIC['cosine']}, 6) AS score FROM q, v),
p AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id::VARCHAR) AS rank FROM s) WHERE rank <= 20),
m AS (
  SELECT qid, id, score, 1 AS rank, [id] AS chosen FROM p WHERE rank = 1
  UNION ALL
  SELECT qid, id, score, rank, chosen FROM (
    SELECT m.qid, c.id, round(0.5 * c.score - 0.5 * (SELECT max(list_cosine_similarity(c.e, x.e)) FROM p x WHERE x.qid = m.qid AND list_contains(m.chosen, x.id)), 6) AS score,
      m.rank + 1 AS rank, list_append(m.chosen, c.id) AS chosen,
      row_number() OVER (PARTITION BY m.qid ORDER BY round(0.5 * c.score - 0.5 * (SELECT max(list_cosine_similarity(c.e, x.e)) FROM p x WHERE x.qid = m.qid AND list_contains(m.chosen, x.id)), 6) DESC, c.id::VARCHAR) AS n
    FROM m JOIN p c ON c.qid = m.qid AND NOT list_contains(m.chosen, c.id) WHERE m.rank < 6) WHERE n = 1)
SELECT qid, id, score, rank::INTEGER AS rank FROM m""")
def mmr_select(spark, sf):
    v = t(spark, sf, "embeddings")
    return fusion.mmr(dense.top_k(v, vec_queries(spark, sf), 20).select("qid", "id", "score"), v, 6)


_PLANNED = (
    "what calls parse_config", "where is the timeout used", "where is Waldo", "who owns billing", "explain retention", "find src/main.rs", 'the "exact phrase"',
    "which invoice was sent yesterday", "show dependencies of core", "weather tomorrow", "how does sharding work", "whatcalls nothing", "module::function", "plan for ()", "由誰負責 這份文件", "dependency",
)
_SQL_PLANNED = "VALUES " + ", ".join("('" + s.replace("'", "''") + "')" for s in _PLANNED)


def _rx(name: str) -> str:
    over = "q" if name in ("cjk", "exact") else "lower(q)"
    return "(" + " AND ".join("regexp_matches(%s, '%s')" % (over, p.replace("'", "''")) for p in fusion.PATTERNS[name]) + ")"


@query(f"""WITH x AS (SELECT trim(s) AS q FROM ({_SQL_PLANNED}) AS v(s)), y AS (SELECT q, {' OR '.join(_rx(n) for n in ('where', 'does', 'records', 'relation', 'cjk'))} AS related, {_rx('exact')} AS exact, {_rx('explain')} AS expl FROM x)
SELECT q, CASE WHEN related THEN 'graph_hybrid' ELSE 'hybrid' END AS mode, 1.0::DOUBLE AS vector_weight, 1.0::DOUBLE AS lexical_weight, CASE WHEN related THEN 1 ELSE 0 END AS graph_depth,
  CASE WHEN related THEN 'relationship query detected' WHEN exact THEN 'identifier/path/exact term signal detected' WHEN expl THEN 'explanatory query detected' ELSE 'default hybrid retrieval' END AS reasons FROM y""")
def planner_modes(spark, sf):
    q = spark.range(1).select(F.explode(F.array(*[F.lit(s) for s in _PLANNED])).alias("q"))
    return fusion.plan(q, "q").withColumn("reasons", F.array_join("reasons", "; "))


@query("""WITH e AS (SELECT vec_id % 5 AS qid, vec_id AS id, (vec_id % 4)::INTEGER AS hop, round(vec_id / 1000.0, 6)::DOUBLE AS seed FROM embeddings),
u AS (SELECT qid, id, seed AS score FROM e WHERE id % 3 = 0 UNION ALL SELECT qid, id, seed * pow(0.85, hop) FROM e),
f AS (SELECT qid, id, round(max(score), 6) AS score FROM u GROUP BY qid, id)
SELECT qid, id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id::VARCHAR)::INTEGER AS rank FROM f QUALIFY rank <= 8""")
def graph_score_merge(spark, sf):
    e = t(spark, sf, "embeddings").select((F.col("vec_id") % 5).alias("qid"), F.col("vec_id").alias("id"), (F.col("vec_id") % 4).cast("int").alias("hop"), F.round(F.col("vec_id") / 1000.0, 6).alias("seed_score"))
    return fusion.merge_graph_scores(e.filter("id % 3 = 0").select("qid", "id", F.col("seed_score").alias("score")), e, 8)


@query("WITH " + _LEX + """ SELECT (SELECT count(*) FROM br WHERE rank <= 40)::BIGINT AS lexical_candidates, (SELECT count(*) FROM orr WHERE rank <= 40)::BIGINT AS overlap_candidates,
  (SELECT count(*) FROM (SELECT DISTINCT qid, id FROM br WHERE rank <= 40 UNION SELECT DISTINCT qid, id FROM orr WHERE rank <= 40))::BIGINT AS fused_candidates""")
def search_diagnostics(spark, sf):
    d, q = index(spark, sf), text_queries(spark, sf)
    both = lexical.search(d, q, 40).select("qid", "id", F.lit(1).alias("a"), F.lit(0).alias("b")).unionByName(lexical.overlap(d, q, 40).select("qid", "id", F.lit(0).alias("a"), F.lit(1).alias("b")))
    return both.groupBy("qid", "id").agg(F.sum("a").alias("a"), F.sum("b").alias("b")).agg(F.sum("a").alias("lexical_candidates"), F.sum("b").alias("overlap_candidates"), F.count("*").alias("fused_candidates"))


QUERIES, SQL = query.queries, query.sql
