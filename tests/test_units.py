"""Edge cases of the operators on small written inputs."""

import io
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from orrery.functions import predicates as P
from orrery.functions import vectors as V
from orrery.functions.text import estimate_tokens, tokens
from orrery.operators import cluster, dense, evaluate, fusion, graph, ledger, lexical, mutations, pack
from orrery.sources import chunking, events, parsers


def rows(df, *names):
    return sorted(tuple(r[n] for n in (names or df.columns)) for r in df.collect())


def test_tokens(spark):
    d = spark.createDataFrame([("parseHTTPServer2 snake_case C++ ::x",), (None,), ("",)], "t string")
    got = [r[0] for r in d.select(tokens(F.col("t"))).collect()]
    assert got[0] == ["parsehttpserver2", "parse", "http", "server", "2", "snake_case", "snake", "case", "c++", "c", "x"]
    assert got[1] == got[2] == []


def test_token_estimate(spark):
    d = spark.createDataFrame([("abcd efghi",), ("é",), ("a\x0bb",), (None,)], "t string")
    assert [r[0] for r in d.select(estimate_tokens(F.col("t"))).collect()] == [3, 2, 1, 0]


def test_python_estimate_is_the_same(spark):
    texts = ["abcd efghi", "éa b", "x" * 9 + " \t\n", "a\x0bb"]
    d = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r[0] for r in d.select(estimate_tokens(F.col("t"))).collect()] == [chunking.count_tokens(t) for t in texts]


def test_vector_edge_cases(spark):
    d = spark.createDataFrame([([0.0, 0.0], [1.0, 0.0]), ([1.0], [1.0, 2.0]), ([float("nan")], [1.0]), ([3.0, 4.0], [3.0, 4.0])], "a array<double>, b array<double>")
    got = [r[0] for r in d.select(V.cosine(F.col("a"), F.col("b"))).collect()]
    assert got[:3] == [0, 0, 0] and abs(got[3] - 1) < 1e-12


def test_top_k_ties_bad_vectors_and_errors(spark):
    v = spark.createDataFrame([(10, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0]), (4, None), (None, [1.0, 0.0]), (5, [float("nan"), 1.0])], "vec_id long, embedding array<float>")
    q = spark.createDataFrame([(0, [1.0, 0.0])], "qid long, qvec array<float>")
    assert rows(dense.top_k(v, q, 5), "id", "rank") == [(2, 2), (10, 1)]  # ids compare as text
    assert dense.top_k(v.limit(0), q, 5).count() == 0
    assert dense.top_k(v, q.limit(0), 5).count() == 0
    with pytest.raises(ValueError):
        dense.top_k(v, q, 0)
    with pytest.raises(ValueError):
        dense.top_k(v, spark.createDataFrame([(0, [float("inf"), 0.0])], "qid long, qvec array<float>"), 1)


def test_bm25_empty_corpus_and_parameters(spark):
    d = spark.createDataFrame([], "doc_id long, text string")
    q = spark.createDataFrame([(1, "a b")], "qid long, text string")
    assert lexical.bm25(d, q, 5).count() == 0
    assert lexical.parameters(float("nan"), 2.0) == (1.2, 1.0) and lexical.parameters(-1, None) == (1.2, 0.75)


def test_bm25_counts_repeated_query_terms(spark):
    d = spark.createDataFrame([(1, "x y"), (2, "y z"), (3, "w")], "doc_id long, text string")
    one = lexical.bm25(d, spark.createDataFrame([(1, "x")], "qid long, text string"), 5).first()["score"]
    two = lexical.bm25(d, spark.createDataFrame([(1, "x x")], "qid long, text string"), 5).first()["score"]
    assert abs(two - 2 * one) < 1e-5


def test_rrf_exact(spark):
    a = spark.createDataFrame([(1, "x", 1), (1, "y", 2), (1, "x", 3)], "qid int, id string, rank int")
    b = spark.createDataFrame([(1, "y", 1)], "qid int, id string, rank int")
    got = {r["id"]: (r["score"], r["rank"]) for r in fusion.rrf([(a, 1.0), (b, 1.0), (b, -1.0), (b, float("nan"))]).collect()}
    assert got == {"y": (round(1 / 62 + 1 / 61, 9), 1), "x": (round(1 / 61, 9), 2)}


def test_modes():
    assert fusion.parse_mode("") == "vector" and fusion.parse_mode(None, True) == "hybrid" and fusion.parse_mode(" Dense ") == "vector"
    with pytest.raises(ValueError):
        fusion.parse_mode("other")
    assert fusion.pool_size(10, True) == 40 and fusion.pool_size(100, True) == 200 and fusion.pool_size(300, True) == 300
    assert dense.window_size(10, "post") == 50 and dense.window_size(600, "post") == 600


def test_filter_two_valued(spark):
    d = spark.createDataFrame([(1, '{"a":1}'), (2, "{}"), (3, '{"a":null}'), (4, '{"a":["x","y"]}'), (5, '{"a":"xy"}')], "id int, m string").withColumn("m", F.parse_json("m"))
    ids = lambda node: [r["id"] for r in d.filter(P.tree(F.col("m"), node)).orderBy("id").collect()]
    c = lambda op, v=None: {"key": "a", "op": op, "value": v}
    assert ids({"not": c("eq", 1)}) == [2, 3, 4, 5]
    assert ids(c("exists")) == [1, 4, 5]
    assert ids(c("eq", ["y", "x", "x"])) == [4]
    assert ids(c("contains", "x")) == [4, 5]
    assert ids(c("gt", 0)) == [1] and ids(c("gt", "a")) == [5]
    assert ids(None) == [1, 2, 3, 4, 5] and ids({"or": []}) == []
    with pytest.raises(ValueError):
        P.tree(F.col("m"), c("like", "x"))


def test_metadata_query_rejects_paths(spark):
    d = spark.createDataFrame([(1, 1, "{}")], "id int, updated_at int, m string").withColumn("meta", F.parse_json("m"))
    with pytest.raises(ValueError):
        P.metadata_query(d, [{"path": "a-b", "op": "exists"}], 1)
    assert P.metadata_query(d, [], 0).count() == 0
    assert P.pushable({"key": "a", "op": "eq", "value": 1}) and not P.pushable({"key": "a.b", "op": "eq", "value": 1})


def test_stamp_conflict(spark):
    d = spark.createDataFrame([("a",), (None,)], "workspace_id string")
    assert rows(P.stamp(d, "a")) == [("a",), ("a",)]
    with pytest.raises(Exception, match="workspace differs"):
        P.stamp(d, "b").collect()


def test_greedy_skips_and_goes_on(spark):
    h = spark.createDataFrame([(1, "a", 1, 6), (1, "b", 2, 5), (1, "c", 3, 4)], "qid int, id string, rank int, cost int")
    assert rows(pack.greedy(h, 10), "id", "used", "position") == [("a", 6, 1), ("c", 10, 2)]


def test_cut_utf8(spark):
    d = spark.createDataFrame([("aé", 2), ("aé", 3), ("aé", 1), ("", 0)], "t string, n int")
    assert [r[0] for r in d.select(pack.cut_utf8(F.col("t"), F.col("n"))).collect()] == ["a", "aé", "a", ""]


def test_graph_self_loops_cycles_and_limits(spark):
    e = spark.createDataFrame([("1", "a", "b", "k", 1.0), ("2", "b", "a", "k", 0.5), ("3", "a", "a", "k", 2.0), ("4", "b", "c", "k", 0.1)], "edge_id string, from_id string, to_id string, kind string, weight double")
    s = spark.createDataFrame([("a",)], "node string")
    assert rows(graph.reach(e, s, 3, 10, "out"), "id", "hop") == [("b", 1), ("c", 2)]
    assert rows(graph.neighbors(e, s, "both", limit=2), "edge_id", "rank") == [("1", 2), ("3", 1)]
    p = spark.createDataFrame([("a", "c"), ("c", "a"), ("a", "a")], "source string, target string")
    assert rows(graph.path_exists(e, p)) == [("a", "a", True, 0), ("a", "c", True, 2), ("c", "a", False, -1)]


def test_bitemporal_truth_table(spark):
    v = spark.createDataFrame([("v1", 1, 10, 20), ("v2", 2, 20, None), ("v3", 5, 10, 20)], "version_id string, committed_sequence long, valid_from long, valid_to long")
    life = spark.createDataFrame([("v1", 1, "active"), ("v1", 5, "superseded"), ("v2", 2, "active"), ("v3", 5, "active")], "version_id string, sequence long, state string")
    at = lambda t, s: [r[0] for r in rows(ledger.as_of(v, life, t, s), "version_id")]
    assert at(10, 1) == ["v1"] and at(20, 1) == [] and at(20, 2) == ["v2"] and at(19, 4) == ["v1"] and at(19, 5) == ["v3"] and at(9, 9) == []


def test_closure_with_cycle(spark):
    d = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (7, 8)], "source long, target long")
    assert rows(ledger.deletion_closure(d, spark.createDataFrame([(1,)], "id long"))) == [(1, 0), (2, 1), (3, 2)]


def test_replay_statuses(spark):
    m = spark.createDataFrame([(1, "a", "h", 0), (1, "a", "h", 1), (2, "b", "h", 2), (2, "x", "h", 3), (4, "d", "h", 4), (9, "z", "h", 5)], "sequence long, mutation_id string, hash string, arrival long")
    assert rows(mutations.replay(m, 0, 8)) == [(1, "a", "apply"), (1, "a", "duplicate"), (2, "b", "apply"), (2, "x", "conflict"), (4, "d", "gap"), (9, "z", "beyond")]


def test_percentile_definitions_differ(spark):
    d = spark.createDataFrame([(1, float(i)) for i in range(1, 5)], "g int, v double")
    assert evaluate.nearest_rank(d, ["g"], "v", {"p": 0.5}).first()["p"] == 2 and evaluate.rounded_rank(d, ["g"], "v", {"p": 0.5}).first()["p"] == 3


def test_empty_conventions(spark):
    h = spark.createDataFrame([], "qid int, id int, rank int")
    g = spark.createDataFrame([(1, 1, 0)], "qid int, id int, grade int")
    assert evaluate.ndcg(h, g, 5).first()["ndcg"] == 0 and evaluate.ndcg(h, g, 5, graded=True).first()["ndcg"] == 1


def test_mmr_dedup_and_order(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [0.0, 1.0])], "vec_id long, embedding array<float>")
    h = spark.createDataFrame([(0, 1, 0.9), (0, 1, 0.5), (0, 2, 0.8), (0, 3, 0.3)], "qid int, id long, score double")
    got = [(r["id"], r["score"]) for r in fusion.mmr(h, v, 3).orderBy("rank").collect()]
    assert got == [(1, 0.9), (3, 0.15), (2, -0.1)]


def test_ring_is_stable_and_wraps():
    points = cluster.ring(["a", "b"], 3)
    assert points == sorted(points) and len(points) == 6 and all(0 <= p < 1 << 64 for p, _ in points)
    assert cluster.ring_hash("") != cluster.ring_hash("a")


def test_html_visibility():
    page = b'<title>T</title><p style="display:none">no</p><p style="display:none !important;display:block">no</p><p hidden>no</p><img alt="pic"><script>no</script>a &amp; b<div aria-hidden="true">no<b>no</b></div>'
    assert parsers.parse_html(page)[0] == "T pic a & b"


def test_csv_header_rules():
    assert parsers.parse_csv(b"id,note\n1,x\n,\n2,\n")[0] == "id note\nid 1 note x\nid 2"
    assert parsers.parse_csv(b"foo bar,baz\nqux,zip\n")[1]["rows"] == 2
    assert parsers.parse_csv(b"") == ("", {"rows": 0, "columns": 0})


def test_office_files():
    ns = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
    x = io.BytesIO()
    with zipfile.ZipFile(x, "w") as z:
        z.writestr("xl/sharedStrings.xml", f'<sst xmlns="{ns}"><si><t>name</t></si><si><t>Ann</t></si></sst>')
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet xmlns="{ns}"><sheetData><row><c r="A1" t="s"><v>0</v></c><c r="C1" t="inlineStr"><is><t>user_id</t></is></c></row><row><c r="A2" t="s"><v>1</v></c><c r="C2"><v>7</v></c></row></sheetData></worksheet>')
    assert parsers.parse_xlsx(x.getvalue())[0] == "name user_id\nname Ann user_id 7"
    w = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    d = io.BytesIO()
    with zipfile.ZipFile(d, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="{w}"><w:body><w:p><w:r><w:t>Hi</w:t></w:r></w:p><w:tbl><w:tr><w:tc><w:p><w:r><w:t>a</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>b</w:t></w:r></w:p></w:tc></w:tr></w:tbl></w:body></w:document>')
    assert parsers.parse_docx(d.getvalue()) == ("Hi\na\tb", {"complex": False})


def test_endnote_and_ris():
    ris = b"TY  - JOUR\nAU  - Roe, A\nTI  - On X\nJO  - J. X\nPY  - 2001/02\nER  - \n"
    assert parsers.parse_endnote(ris) == ("Roe, A. On X. J. X. 2001", {"references": 1, "years": ["2001"], "journals": ["J. X"], "types": ["JOUR"]})


def test_broken_files_keep_their_error(spark):
    d = spark.createDataFrame([(1, bytearray(b"{"), "json"), (2, bytearray(b"x y"), "txt"), (3, bytearray(b""), "pdf")], "id int, content binary, format string")
    got = {r["id"]: r for r in parsers.parse_documents(d).collect()}
    assert got[1]["error"] and got[2]["text"] == "x y" and got[2]["word_count"] == 2 and "no parser" in got[3]["error"]


def test_sentence_chunks_cover_and_fit():
    text = "One two three. " * 200 + "x" * 5000 + ". Ende é."
    found = chunking.sentence_chunks(text, 100, 20)
    raw = text.encode()
    assert all(raw[a:b].decode() == c for a, b, c in found)
    assert found[0][0] == 0 and found[-1][1] == len(raw)
    assert all(b2 >= a2 and a2 <= b1 + 1 for (_, b1, _), (a2, b2, _) in zip(found, found[1:]))
    assert chunking.sentence_chunks("  \n ") == [] and chunking.line_chunks("", 5) == []


def test_line_chunks():
    assert chunking.line_chunks("ab\ncd\nefghijk\n", 6) == [(0, 6, "ab\ncd\n"), (6, 12, "efghij"), (12, 14, "k\n")]


def test_segments_name_symbols():
    src = "import a\ndef f():\n    pass\ndef g():\n    pass\n"
    assert chunking.segments(chunking.code_chunks(src, "python"), src, 1000)[0][:3] == ("f, g", 1, 5)


def test_bundle_and_vecs(spark, tmp_path):
    import numpy as np

    lines = [{"type": "header"}, {"type": "record", "id": "a"}, {"type": "record", "id": "a"}, {"type": "edge", "id": "e"}, {"type": "node", "id": "n"}]
    (tmp_path / "b.ndjson").write_text("\n".join(map(json.dumps, lines)) + "\n")
    got = rows(mutations.bundle_order(events.read_bundle(spark, str(tmp_path / "b.ndjson"))))
    assert got == [(2, "id_order"), (4, "section_order")]
    (tmp_path / "x.fvecs").write_bytes(b"".join(np.int32(2).tobytes() + np.array(v, "<f4").tobytes() for v in ([1, 2], [3, 4])))
    assert rows(events.read_vecs(spark, str(tmp_path / "x.fvecs"))) == [(0, [1.0, 2.0]), (1, [3.0, 4.0])]


def test_folder_scan(spark, tmp_path):
    for name in ("a.md", ".git/c.txt", "node_modules/x.js", "id_rsa", "sub/b.py", "p.bin"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text("hello")
    assert [r[0] for r in rows(events.scan_folder(spark, str(tmp_path)), "path")] == ["a.md", "sub/b.py"]


def test_pack_verify_rereads_cited_bytes(spark, sf, monkeypatch):
    """Every citation spans bytes of its document, and the text cited is as long."""
    from orrery.plans import graphs

    def asked(source, text, start, end, sha256):
        return F.when(text == "?", "planted").when((end > start) & (F.octet_length(text) == end - start), "read").otherwise("empty")

    monkeypatch.setattr(graphs.pack, "verify_citation", asked)
    assert {r["status"] for r in graphs.pack_verify(spark, sf).collect()} == {"planted", "read"}


def test_mock_hybrid_asks_every_fiftieth(spark):
    """The queries grow with their table."""
    from orrery.plans import retrieval

    sf = "/root/testdata/sf0.1"
    asked = {r["item_id"] for r in spark.read.parquet(f"{sf}/benchmark.parquet").filter("item_id % 50 = 0").collect()}
    assert len(asked) > 1 and {r["qid"] for r in retrieval.dense_mock_hybrid(spark, sf).select("qid").distinct().collect()} == asked
