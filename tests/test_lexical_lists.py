"""Both lexical lists by one pass."""

from orrery.operators import lexical
from orrery.plans import retrieval


def test_search_and_overlap_are_the_separate_lists(spark, sf, monkeypatch):
    index, q = retrieval.index(spark, sf), retrieval.text_queries(spark, sf)
    want = [sorted(map(tuple, f(index, q, 7).select("qid", "id", "score", "rank").collect())) for f in (lexical.search, lexical.overlap)]
    passes, matches = [], lexical.matches
    monkeypatch.setattr(lexical, "matches", lambda *a: passes.append(1) or matches(*a))
    got = [sorted(map(tuple, d.select("qid", "id", "score", "rank").collect())) for d in lexical.search_and_overlap(index, q, 7)]
    assert got == want and len(got[0]) > 100
    passes.clear()
    assert retrieval.fusion_weighted(spark, sf).count() == 400 and len(passes) == 1
