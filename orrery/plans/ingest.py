"""Queries of parsing, chunking, sources and streaming."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from orrery.functions.stage import shared_dir
from orrery.plans.base import Registry, t
from orrery.sources import chunking, events, parsers
from orrery.streaming import ingest

query = Registry()


def values(spark, rows, *names):
    s = F.array(*[F.struct(*[F.lit(v).alias(n) for v, n in zip(r, names, strict=True)]) for r in rows])
    return spark.range(1).select(F.explode(s).alias("x")).select("x.*")


def _sql_values(rows, names) -> str:
    q = lambda v: "NULL" if v is None else str(v) if isinstance(v, (int, float)) else "'" + v.replace("'", "''") + "'"
    return "SELECT * FROM (VALUES " + ", ".join("(" + ", ".join(map(q, r)) + ")" for r in rows) + f") AS v({', '.join(names)})"


_FORMATS = [("a/b.PDF", "", "pdf"), ("http://x/y.html?q=1.csv#z", "", "html"), ("noext", "application/vnd.api+json; charset=utf-8", "json"), ("x.tar.gz", "text/csv", "csv"), ("r.docm", "", "docx"), ("f", "image/svg+xml", "xml"), ("README", "", "unknown"), ("t.tsv/", "", "tsv")]


@query(_sql_values([(r[0], r[2]) for r in _FORMATS], ["name", "format"]))
def parse_format(spark, sf):
    return values(spark, [r[:2] for r in _FORMATS], "name", "mime").select("name", parsers.detect_format(F.col("name"), F.col("mime")).alias("format"))


@query()
def parse_html(spark, sf):
    """Rows only: SQL has no HTML parser; tests hold it against written cases."""
    p = t(spark, sf, "pages").select("page_id", F.encode("html", "utf-8").alias("content"), F.lit("html").alias("format"))
    return parsers.parse_documents(p).select("page_id", "text", "word_count", "meta", "error")


_JSON = "concat('{\"a\":{\"b\":', event_id, ',\"c\":null},\"t\":\"', event_type, '\",\"l\":[1,true]}')"


@query("SELECT event_id, concat('a b ', event_id, ' a.b ', event_id, ' a.c t ', event_type, ' l 1 true') AS text FROM events")
def parse_json(spark, sf):
    e = t(spark, sf, "events").select("event_id", F.encode(F.expr(_JSON), "utf-8").alias("content"), F.lit("json").alias("format"))
    return parsers.parse_documents(e).select("event_id", "text")


@query("SELECT user_id, 'id type value' || chr(10) || string_agg('id ' || event_id || ' type ' || event_type || ' value ' || (event_id % 9), chr(10) ORDER BY event_id) AS text, count(*)::BIGINT AS n_rows FROM events GROUP BY user_id")
def parse_csv(spark, sf):
    line = F.concat_ws(",", F.col("event_id").cast("string"), "event_type", (F.col("event_id") % 9).cast("string"), F.lit(""))
    rows = t(spark, sf, "events").groupBy("user_id").agg(F.sort_array(F.collect_list(F.struct("event_id", line.alias("line")))).alias("x"))
    content = F.concat(F.lit("id,type,value,\n,,,\n"), F.array_join(F.transform("x", lambda r: r["line"]), "\n"))
    out = parsers.parse_documents(rows.select("user_id", F.encode(content, "utf-8").alias("content"), F.lit("csv").alias("format")))
    return out.select("user_id", "text", F.get_json_object("meta", "$.rows").cast("long").alias("n_rows"))


@query("SELECT event_id, concat('r k ', event_id, ' e v ', user_id, ' r.e.v ', user_id, ' e ', event_type, ' r.e ', event_type) AS text FROM events")
def parse_xml(spark, sf):
    x = F.expr("concat('<r k=\"', event_id, '\"><e v=\"', user_id, '\">', event_type, '</e></r>')")
    e = t(spark, sf, "events").select("event_id", F.encode(x, "utf-8").alias("content"), F.lit("xml").alias("format"))
    return parsers.parse_documents(e).select("event_id", "text")


@query("SELECT doc_id, true AS whole, true AS filled FROM documents WHERE regexp_matches(text, '\\S')")
def chunk_lines(spark, sf):
    """The chunks of a text, joined, are the text, but for blank slices."""
    d = t(spark, sf, "documents")
    c = chunking.explode_chunks(d, lambda x: chunking.line_chunks(x, 500))
    joined = c.groupBy("doc_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("chunk_index", "chunk"))), lambda x: x["chunk"]), "").alias("joined"), (F.max(F.octet_length("chunk")) > 0).alias("filled"))
    return joined.join(d.select("doc_id", "text"), "doc_id").select("doc_id", (F.regexp_replace("joined", r"\s+", "") == F.regexp_replace("text", r"\s+", "")).alias("whole"), "filled")


@query()
def chunk_sentences(spark, sf):
    """Rows only: a sequential packing with overlap; tests check offsets, budgets and cover."""
    return chunking.explode_chunks(t(spark, sf, "documents"), lambda x: chunking.sentence_chunks(x))


@query("SELECT doc_id, sha256(text) || ':' || (doc_id % 3) AS id, substr(sha256(source || '/' || doc_id), 1, 16) || '-' || (doc_id % 3) AS path_id FROM documents")
def chunk_ids(spark, sf):
    i = F.col("doc_id") % 3
    return t(spark, sf, "documents").select("doc_id", chunking.chunk_id(F.sha2("text", 256), i).alias("id"), chunking.path_chunk_id(F.concat("source", F.lit("/"), F.col("doc_id").cast("string")), i).alias("path_id"))


_CODE = [
    ("a.py", "python", "import os\nfrom sys import path\n@dec\ndef f(x):\n    return x\n\nclass A:\n    def m(self):\n        pass\n"),
    ("b.rs", "rust", "use std::fmt;\nuse a::b as c;\n/// doc\npub fn run() {\n    util::go(1);\n}\nstruct S { x: u8 }\n"),
    ("c.js", "javascript", "import x from './x';\nexport const go = (a) => {\n  return a;\n};\nclass K {\n}\n"),
    ("d.go", "go", 'import "fmt"\nfunc (s *S) Run() {\n}\n'),
]
_EDGES = [("a.py", "imports", "os"), ("a.py", "imports", "sys"), ("b.rs", "imports", "std::fmt"), ("b.rs", "imports", "a::b"), ("b.rs", "calls", "fmt"), ("b.rs", "calls", "b"), ("b.rs", "calls", "go"), ("c.js", "imports", "./x"), ("d.go", "imports", "fmt")]
_SYMBOLS = [("a.py", "function", "f", 3, 5), ("a.py", "class", "A", 7, 9), ("b.rs", "function", "run", 3, 6), ("b.rs", "struct", "S", 7, 7), ("c.js", "function", "go", 2, 4), ("c.js", "class", "K", 5, 6), ("d.go", "function", "Run", 2, 3)]


@query(_sql_values(_EDGES, ["file", "kind", "target"]))
def code_edges(spark, sf):
    return chunking.code_edges(values(spark, _CODE, "file", "language", "source"))


@query(_sql_values(_SYMBOLS, ["file", "kind", "name", "first", "last"]))
def code_chunks(spark, sf):
    import pyarrow as pa

    def run(batches):
        for b in batches:
            rows = [(f, k, n, a, z) for f, lang, s in zip(*[b.column(i).to_pylist() for i in range(3)], strict=True) for k, n, a, z, _ in chunking.code_chunks(s, lang)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], names=["file", "kind", "name", "first", "last"]).cast(pa.schema([("file", pa.string()), ("kind", pa.string()), ("name", pa.string()), ("first", pa.int32()), ("last", pa.int32())]))

    return values(spark, _CODE, "file", "language", "source").mapInArrow(run, "file string, kind string, name string, first int, last int")


_MESSAGES = [
    ('{"bucket":"b","key":"a b.txt","size":3,"timestamp":"t1"}',),
    ('{"Records":[{"eventName":"s3:ObjectCreated:Put","eventTime":"t2","s3":{"bucket":{"name":"c"},"object":{"key":"x+y%2Fz.pdf","size":9}}},{"eventName":"s3:ObjectRemoved:Delete","s3":{"bucket":{"name":"c"},"object":{"key":"gone"}}}]}',),
    ('{"Records":[]}',),
    ("not json",),
]


@query(_sql_values([("b", "a b.txt", 3, None, "t1", None), ("c", "x y/z.pdf", 9, None, "t2", None), (None, None, None, None, None, "no upload event"), (None, None, None, None, None, "no upload event")], ["bucket", "key", "size", "content_type", "timestamp", "error"]))
def upload_events(spark, sf):
    return events.upload_events(values(spark, _MESSAGES, "value")).withColumn("size", F.col("size").cast("int"))


def _folder(spark, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


_EVENT = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"


@query("SELECT props, min(event_id) AS event_id FROM events GROUP BY props")
def stream_dedup(spark, sf):
    """A stream of the events file, idempotent by content: the same as the batch answer."""
    src, out = _folder(spark, "stream-source"), _folder(spark, "stream-dedup")
    t(spark, sf, "events").write.parquet(src)
    s = ingest.read_stream(spark, src, _EVENT)
    ingest.idempotent_sink(ingest.least_seen(s, "props", "event_id"), out, out + "-checkpoint", "update").awaitTermination()
    return spark.read.parquet(out).groupBy("props").agg(F.min("event_id").alias("event_id"))


@query("SELECT user_id, n AS sequence, 'applied' AS status FROM (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events)")
def stream_ordered_apply(spark, sf):
    from pyspark.sql import Window

    src, out = _folder(spark, "mutations"), _folder(spark, "applied")
    n = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id"))
    t(spark, sf, "events").select("user_id", n.cast("long").alias("sequence")).repartition(4, F.col("sequence") % 4).write.parquet(src)
    s = ingest.read_stream(spark, src, "user_id bigint, sequence bigint", 1)
    ingest.idempotent_sink(ingest.ordered_apply(s, "user_id", "sequence"), out, out + "-checkpoint").awaitTermination()
    return spark.read.parquet(out).select("user_id", "sequence", "status")


@query("SELECT event_id % 200 AS doc_id, ['queued', 'parsing', 'chunking', 'embedding', 'inserting', 'completed', 'failed'][1 + max(event_id % 7)] AS state, count(*) AS n_events FROM events GROUP BY 1")
def document_states(spark, sf):
    names = F.array(*[F.lit(s) for s in ("queued", "parsing", "chunking", "embedding", "inserting", "completed", "failed")])
    return ingest.document_states(t(spark, sf, "events").select((F.col("event_id") % 200).alias("doc_id"), F.get(names, (F.col("event_id") % 7).cast("int")).alias("state")))


QUERIES, SQL = query.queries, query.sql
