"""Chat formatting, quality rules and URL filters: SQL, brute force and edge cases."""

import hashlib
import re

import pytest
from pyspark.sql import functions as F

from orrery.llm import chat_format, quality_rules, queries, url_filter
from tests.oracle import both


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_matches_sql(spark, sf, name):
    names, mine, their_names, theirs = both(spark, sf, queries.QUERIES[name], queries.SQL[name])
    assert names == their_names
    assert mine == theirs


TURNS = [
    (1, 2, "assistant", "b<|im_end|>", "x"), (1, 0, "user", "<\\|im_start|> <|", "x"), (1, 1, "assistant", "a\n<", None), (1, 3, "assistant", None, "x"), (1, 4, "user", "", "x"),
    (2, None, None, "no role", "x"), (2, 0, "us%\ner", "r", "x"), (2, 0, "us%\ner", "r", "x"), (None, 0, "assistant", "<|im_sep|>", "x"), (3, 0, "assistant", "", "x"),
]


def test_chats_read_back(spark):
    d = spark.createDataFrame(TURNS, "conv_id long, turn long, role string, text string, formatted string")
    out = chat_format.format_chats(d)
    got = {r["conv_id"]: r for r in out.withColumns({"turns": chat_format.read_turns(F.col("formatted")), "loss": chat_format.read_loss(F.col("formatted"), F.col("loss_spans"))}).collect()}
    for conv in (1, 2, 3, None):
        want = sorted([t for t in TURNS if t[0] == conv], key=lambda t: (t[1] is not None, t[1] or 0, t[2] or "", t[3] or ""))
        assert [(t["role"], t["text"]) for t in got[conv]["turns"]] == [(t[2] or "", t[3] or "") for t in want]
        assert got[conv]["loss"] == "".join(t[3] or "" for t in want if t[2] == "assistant")
    assert got[1]["n_blocks"] == 3 and got[1]["formatted"].count("<|im_start|>") == 3
    assert chat_format.format_chats(d.limit(0)).count() == 0


def brute_rules(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    covered = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(3)}
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered))


TEXTS = [None, "", " \n\t ", "a", "a b c a b c", "x x x x x", "a\n\na\n b\n b", "é\u00a0ü #|<>\x0b\x0c\r z", "w " * 3000, "a b c d\n" * 40, "é" * 5000]


def test_rules_by_brute_force(spark):
    d = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(TEXTS + ["a"])], "doc_id long, text string, n_words string")
    got = {r["doc_id"]: r for r in quality_rules.ledger(d).collect()}
    for i, t in enumerate(TEXTS):
        m = got[i]["measures"]
        assert (m["n_words"], m["word_chars"], m["n_symbols"], m["n_dup_lines"], m["n_repeat_words"]) == brute_rules(t), t
    kept = quality_rules.keep(d)
    assert kept.columns == d.columns
    assert {r["doc_id"] for r in kept.collect()} == {i for i, r in got.items() if not r["fail_bits"] & quality_rules.POLICIES["v2"]}


def test_ablation(spark):
    d = spark.createDataFrame([(0b101,), (0b100,), (0b100,), (0,)], "fail_bits long")
    got = {r["rule"]: (r["n_failed"], r["n_only"], r["n_kept_without"]) for r in quality_rules.ablation(d).collect()}
    assert got["symbol_heavy"] == (3, 2, 3) and got["too_few_words"] == (1, 0, 1) and got["shouting"] == (0, 0, 1)


def test_urls(spark):
    urls = [None, "", "nope", "://", "http://A.Example.COM/en/x?y#z", "http://www.example.com/en/", "http://xexample.com/en/", "https://example.com:80/en/", "h://b.net/es/1", "h://b.net/esx", "h://u@good.org/a/1", "h://bad.org/a/2", "h://com"]
    d = spark.createDataFrame([(i, u, "clash") for i, u in enumerate(urls)], "page_id long, url string, host string")
    outcomes = spark.createDataFrame([("h://bad.org/", 1)] * 40 + [("h://good.org/", 0)] * 40 + [(None, 1), ("h://good.org/", None)], "url string, bad int")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filter.filter_urls(d, outcomes).collect()}
    assert len(got) == len(urls)
    assert got[0] == got[1] == got[2] == got[3] == ("", "", None, "allow")
    assert got[4] == ("a.example.com", "/en/x", "example.com/en/", "block")
    assert got[5] == ("www.example.com", "/en/", "www.example.com/en/", "allow") and got[6][2] == "com/"
    assert got[7] == ("example.com:80", "/en/", None, "allow")
    assert got[8][2:] == ("net/es/", "block") and got[9][2] is None
    assert got[10][3] == "allow" and got[11][2:] == (None, "block") and got[12] == ("com", "", None, "allow")
    assert url_filter.filter_urls(d.limit(0), outcomes.limit(0)).count() == 0
    assert url_filter.filter_urls(d, outcomes.limit(0)).count() == len(urls)


def test_hash_of_an_empty_conversation_text(spark, sf):
    got = queries.QUERIES["op1_chat_format"](spark, sf).filter("conv_id = -1").first()
    s = "<|im_end|><|im_start|>assistant ok"
    assert got["n_turns"] == 2 and got["turns_sha256"] == hashlib.sha256(f"user\n{s}\nassistant\n{s}\n".encode()).hexdigest()
    assert got["loss_sha256"] == hashlib.sha256(s.encode()).hexdigest()
