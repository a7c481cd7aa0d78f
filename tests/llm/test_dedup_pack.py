"""Fingerprints, SimHash, packing and the pipeline, against brute force."""

import hashlib
import random
import zlib

import numpy as np
import pyarrow.parquet as pq
import pytest
import xxhash

import corpus_pipeline
from orrery.llm import fingerprint, packing, quality_classifier, quality_rules, queries, simhash
from orrery.llm.common import table

TEXTS = [None, "", "  ", "one", "two words", "a b c", "A B C", "x y z " * 500, "same text here", "same text here", "é" * 3000 + " ü", "w\x0bx\ty\r\nz", "1 2 3 4 5 6 7 8 9 10"]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, t, "c") for i, t in enumerate(TEXTS)] + [(5, "a b c", "c"), (None, "no id", "c")]
    return spark.createDataFrame(rows, "doc_id long, text string, fingerprint string")


def slow_simhash(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(fps):
    up = {i: i for i in fps}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(fps)
    for n, i in enumerate(ids):
        for j in ids[:n]:
            if (fps[i] ^ fps[j]).bit_count() <= 2:
                a, b = find(i), find(j)
                up[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def test_simhash_of_odd_texts(odd):
    got = simhash.near_duplicates(odd).collect()
    assert len(got) == len(TEXTS) + 2
    want = {i: slow_simhash(t) for i, t in enumerate(TEXTS)}
    comp = brute_components(want)
    assert all(r["fingerprint"] == f"{want[r['doc_id']]:016x}" and r["component_id"] == comp[r["doc_id"]] for r in got if r["doc_id"] is not None)
    assert simhash.near_duplicates(odd.limit(0)).count() == 0


@pytest.mark.parametrize("pairs_up_to", [64, 2])
def test_components_by_brute_force(spark, monkeypatch, pairs_up_to):
    """Chains, dense groups and strangers; with pairs_up_to 2 nearly all blocks take the midpoint way."""
    monkeypatch.setattr(simhash, "PAIRS_UP_TO", pairs_up_to)
    rng = random.Random(3)
    fps = [rng.getrandbits(64) for _ in range(60)]
    for _ in range(240):
        f = rng.choice(fps)
        for _ in range(rng.randint(0, 4)):
            f ^= 1 << rng.randrange(64)
        fps.append(f)
    by_id = dict(enumerate(fps))
    first = {}
    for i, f in by_id.items():
        first.setdefault(f, i)
    signed = lambda f: f - (1 << 64) if f >> 63 else f
    nodes = spark.createDataFrame([(i, signed(f)) for f, i in first.items()], "rep long, fp long")
    found = {r["node"]: r["component"] for r in simhash.components(simhash.links(nodes)).collect()}
    want = brute_components({i: f for f, i in first.items()})
    assert {i: found.get(i, i) for i in want} == want


def test_long_chain(spark):
    e = spark.range(1, 200).selectExpr("id as a", "id - 1 as b")
    assert {(r["node"], r["component"]) for r in simhash.components(e).collect()} == {(i, 0) for i in range(1, 200)}


def test_keep_first(odd):
    kept = simhash.keep_first(odd)
    assert kept.columns == odd.columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert sorted(i for i in ids if i is not None).count(5) == 1 and None in ids and 9 not in ids and 8 in ids and 6 not in ids


def shingle_set(text):
    words = (text or "").encode().lower().split()
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def brute_similar(texts):
    """Components of texts (id to text) by all pairs of five-word shingle sets with a Jaccard similarity of 0.8 or more."""
    sets, up = {i: shingle_set(t) for i, t in texts.items()}, {i: i for i in texts}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for n, i in enumerate(ids):
        for j in ids[:n]:
            x, y = sets[i], sets[j]
            if x == y or 10 * len(x & y) >= 8 * len(x | y):
                a, b = find(i), find(j)
                up[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def families(rng):
    """Texts with edits of many sizes, passages that many share, short and long ones."""
    word = lambda: f"w{rng.randrange(3000)}"
    passages = [[word() for _ in range(60)] for _ in range(3)]
    texts = []
    for size in (3, 5, 6, 12, 40, 90, 200, 700):
        for _ in range(6):
            base = [word() for _ in range(size)] + (rng.choice(passages) if rng.random() < 0.5 else [])
            texts.append(" ".join(base))
            for _ in range(rng.choice((4, 4, 12))):
                copy = list(base)
                for _ in range(rng.randint(1, max(1, len(base) // 30))):
                    at = rng.randrange(len(copy))
                    copy[at : at + 1] = rng.choice(([], [word()], [copy[at], word()]))
                texts.append(" ".join(copy))
    return texts


@pytest.mark.parametrize("small", [8, 4])
def test_similar_groups_by_brute_force(spark, monkeypatch, small):
    """Families fill blocks of more than `small`, which are linked through leaders."""
    monkeypatch.setattr(simhash, "SMALL", small)
    texts = dict(enumerate(families(random.Random(11)) + [t or "" for t in TEXTS] + ["", " \n", "same text here"]))
    want = brute_similar(texts)
    d = spark.createDataFrame([(i, t, "c", i) for i, t in texts.items()], "doc_id long, text string, component string, seq long").repartition(5)
    got = {}
    for r in simhash.similar_groups(d).collect():
        got.setdefault(r["component"], set()).add(r["doc_id"])
    exact = {}
    for i, c in want.items():
        exact.setdefault(c, set()).add(i)
    assert len(exact) < len(texts) - 80 and sorted(map(sorted, got.values())) == sorted(map(sorted, exact.values()))
    assert {r["doc_id"] for r in simhash.keep_first(d).collect()} == set(exact)


def test_blocks_are_shared_at_the_least_similarity():
    """Sets of every size with a similarity of just 0.8: how many of 300 pairs share a block."""
    rng = np.random.default_rng(4)
    for n in (5, 9, 20, 33, 60, 100, 127, 128, 260, 1000, 4100):
        missed = 0
        for _ in range(300):
            h = np.unique(rng.integers(0, 1 << 40, 2 * n, dtype=np.uint64))
            rng.shuffle(h)
            change = n // 9 if rng.random() < 0.5 else 0  # as many in each alone, or all in one
            a, b = (h[:n], h[change : n + change]) if change else (h[:n], h[: n + n // 4])
            missed += not len(np.intersect1d(simhash.blocks(np.sort(a)), simhash.blocks(np.sort(b))))
        assert missed == 0, n


def test_rare_pairs_by_brute_force(spark):
    """Edits of common origins near the least similarity, sets that share a passage, small and equal ones."""
    rng = random.Random(8)
    number = lambda: rng.randrange(1 << 32)
    passage, sets = {number() for _ in range(40)}, []
    for size in (1, 2, 4, 5, 9, 10, 30, 90, 400):
        for _ in range(4):
            base = {number() for _ in range(size)}
            for _ in range(9):
                lost = rng.randint(0, max(1, size // 8))
                sets.append(set(rng.sample(sorted(base), size - min(lost, size - 1))) | {number() for _ in range(rng.randint(0, max(1, size // 7)))})
    sets += [passage | {number() for _ in range(80)} for _ in range(60)] + [set(), set()]
    alone = [rng.random() < 0.5 for _ in sets]
    rows = [(i, 0, np.array(sorted(x), "<u4").tobytes(), alone[i]) for i, x in enumerate(sets)]
    d = spark.createDataFrame(rows, "seq long, fp long, shingles binary, alone boolean").repartition(4)
    got = {tuple(sorted((r["a"], r["b"]))) for r in simhash._rare_pairs(d, 0.8).collect()}
    pairs = [(i, j) for j in range(len(sets)) for i in range(j) if alone[i] or alone[j]]
    want = {(i, j) for i, j in pairs if sets[i] and 10 * len(sets[i] & sets[j]) >= 8 * len(sets[i] | sets[j])}
    assert len(want) > 300 and want <= got
    first = len(sets) - 62
    assert not [p for p in got if first <= p[0] and p[1] < first + 60]  # a shared passage alone brings none together


def test_groups_without_ids_and_repeated_ids(spark):
    one, two = "one two three four five six seven eight", "nine ten eleven twelve thirteen fourteen"
    d = spark.createDataFrame([(None, one, 1), (None, one, 1), (None, one + " more", 2), (3, two, 3), (3, one[:20], 4), (2, two.upper(), 5), (3, two, 3), (None, None, 6), (9, "", 7)], "doc_id long, text string, __x int")
    kept = sorted(((r["doc_id"], r["text"]) for r in simhash.keep_first(d).collect()), key=repr)
    assert len(kept) == 4 and kept[:3] == [(2, two.upper()), (3, one[:20]), (9, "")] and kept[3][0] is None  # 4 of 5 shingles are 0.8
    # links go through a row without an id
    a = "a b c d e f g h i j k l"
    got = {r["doc_id"]: r["component_id"] for r in simhash.near_duplicates(spark.createDataFrame([(None, a), (5, a), (7, "z")], "doc_id long, text string")).collect()}
    assert got == {None: 5, 5: 5, 7: 7}


def test_edited_by_brute_force(spark, odd):
    unique = odd.filter("doc_id is not null").dropDuplicates(["doc_id"])
    got = {r["doc_id"]: r for r in fingerprint.edited(unique).collect()}
    order = sorted(range(len(TEXTS)), reverse=True)
    for n, i in enumerate(order):
        t, after = TEXTS[i] or "", TEXTS[order[(n + 1) % len(order)]] or ""
        k = len(t) // 3
        changed = t[: len(t) - k] + after[:k]
        assert got[i]["edited_sha256"] == hashlib.sha256(changed.encode()).hexdigest() and got[i]["n_chars"] == len(t)
        assert got[i]["fingerprint"] == fingerprint.encode(fingerprint.bottom(fingerprint.shingle_hashes(t)))
    assert got[8]["fingerprint"] == got[9]["fingerprint"] and got[9]["near_next"] == 1
    assert fingerprint.edited(odd).count() == len(TEXTS) + 2 and fingerprint.edited(odd.limit(0)).count() == 0
    assert fingerprint.fingerprints(odd).count() == len(TEXTS) + 2
    assert fingerprint.edited(odd.limit(1)).first()["near_next"] == 1


def test_sketch_estimates():
    rng = random.Random(5)
    words = [f"w{rng.getrandbits(40)}" for _ in range(6000)]
    a, b = " ".join(words[:4000]), " ".join(words[2000:])
    sa, sb = (fingerprint.bottom(fingerprint.shingle_hashes(t)) for t in (a, b))
    assert abs(fingerprint.resemblance(sa, sb) - 1996 / 5996) < 0.13 and abs(fingerprint.containment(sa, sb) - 0.5) < 0.17
    assert abs(fingerprint.distinct(sa) - 3996) < 0.25 * 3996
    parts = [fingerprint.bottom(fingerprint.shingle_hashes(" ".join(words[i : i + 1004]))) for i in (0, 1000, 2000, 2996)]
    merged = parts[0]
    for p in parts[1:]:
        merged = fingerprint.merge(merged, p)
    assert (merged == sa).all() and (fingerprint.decode(fingerprint.encode(sa)) == sa).all()


def check_packing(rows, texts):
    from tokenizers import Tokenizer
    import public_tokenizers

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    ids = {d: t.encode(x or "", add_special_tokens=False).ids + [0] for d, x in texts.items()}
    pieces, sequences = {}, {}
    for r in rows:
        part = ids[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert len(part) == r["length"] and zlib.crc32(np.array(part, "<u4").tobytes()) == r["ids_crc32"] and r["doc_tokens"] == len(ids[r["doc_id"]])
        pieces.setdefault(r["doc_id"], []).append((r["start"], r["length"]))
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for d, x in ids.items():
        at = 0
        for start, n in sorted(pieces[d]):
            assert start == at
            at += n
        assert at == len(x)
    for parts in sequences.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= 1024 and at & (at - 1) == 0


def test_packing_of_odd_texts(spark, odd):
    unique = odd.filter("doc_id is not null").dropDuplicates(["doc_id"])
    check_packing(packing.pack(unique).collect(), dict(enumerate(TEXTS)))
    assert {r["doc_id"] for r in packing.pack(odd).collect()} == {*range(len(TEXTS)), None}
    assert packing.pack(odd.limit(0)).count() == 0
    clash = odd.select("doc_id", "text", *[odd.fingerprint.alias(c) for c in ("seq", "shard", "key", "rest", "first", "many")])
    assert packing.pack(clash).count() == packing.pack(odd).count()


def test_encoder_equals_the_tokenizer():
    from tokenizers import Tokenizer
    import public_tokenizers

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    texts = [x for x in TEXTS if x] + ["it's  two\n\n spaces ", "tab\there", "a \n b", "<|endoftext|> x", "don't\nwe'll 123abc !?", "\u00a0x\u2003y"]
    texts += [r["text"] for r in pq.read_table("/root/testdata/sf0.001/documents.parquet").to_pylist()]
    texts += ["a-b,c 1.5's x_y", "é, —, ü'll", " lead", "trail ", "a'sb 'tis rock'n'roll"]
    e = packing.Encoder(packing.default_ranks())
    assert [x.tolist() for x in e.encode(texts)] == [t.encode(x, add_special_tokens=False).ids for x in texts]


def packed(ids, idf=None):
    """Sequences of pack_shard, the weights and the lengths of its documents."""
    term, tf, first = packing._counted([np.array(x, "<u2") for x in ids])
    term, tf, of = term.astype(np.int64), tf.astype(np.int64), np.repeat(np.arange(len(ids)), np.diff(first))
    n, df = len(ids), np.bincount(term, minlength=packing.VOCAB)
    idf = np.log1p((n - df + 0.5) / (df + 0.5)) if idf is None else idf
    left, mean = np.array([(len(x) + 1) % packing.WINDOW for x in ids]), tf.sum() / n
    return packing.pack_shard(left, term, of, tf, idf, mean), [{t: c for t, c in zip(term[a:b].tolist(), tf[a:b].tolist(), strict=True)} for a, b in zip(first, first[1:], strict=False)], idf, left, mean


def test_neighbours_fill_windows():
    """A seed's window takes the documents that share its rare terms."""
    docs = [[7] * 50 + [100 + g] * 250 for g in (0, 1, 0, 1, 0, 1)]
    first = packed(docs, np.log1p(np.where(np.arange(packing.VOCAB) == 7, 0.01, 3.0)))[0][0]
    assert [d for d, _, _ in first] == [0, 2, 4, 1]


@pytest.mark.parametrize("common, seeds", [(32, 128), (1, 3), (10**9, 1)])
def test_neighbours_are_the_best_of_the_corpus(monkeypatch, common, seeds):
    """Replays the windows of 1,000 documents: each seed had the most ids of all unused, each neighbour scores best of all unused, by a plain BM25."""
    monkeypatch.setattr(packing, "COMMON", common)
    monkeypatch.setattr(packing, "SEEDS", seeds)
    e = packing.Encoder(packing.default_ranks())
    ids = [x.tolist() for x in e.encode([r["text"] or "" for r in pq.read_table("/root/testdata/sf0.01/documents.parquet").to_pylist()])]
    sequences, terms, idf, left, mean = packed(ids)
    postings = {}
    for d, counts in enumerate(terms):
        norm = packing.K1 * (1 - packing.B + packing.B * sum(counts.values()) / mean)
        for t, c in counts.items():
            postings.setdefault(t, []).append((d, c * (packing.K1 + 1) / (c + norm) * idf[t]))
    full = [s for s in sequences if sum(p[2] for p in s) == packing.WINDOW]
    assert len(full) > 100
    was = left.copy()
    for window in full:
        seed = window[0][0]
        assert was[seed] == was[left > 0].max() and window[0][2] == left[seed]
        left[seed] = 0
        scores = np.zeros(len(ids))
        for t in terms[seed]:
            for d, w in postings[t]:
                scores[d] += w
        for d, _, n in window[1:]:
            assert left[d] and scores[d] >= scores[left > 0].max() - 1e-3
            scores[d], left[d] = -1, left[d] - n


def test_a_corpus_of_ten_thousand_is_one_shard():
    assert packing._shards({k: 100 for k in range(100)}) == [(k, 0, 1) for k in range(100)]


def test_neighbours_meet_across_the_corpus(spark, monkeypatch):
    """Documents about one thing lie far apart in the table, with many more shards than a window needs."""
    monkeypatch.setattr(packing, "SHARD_DOCS", 8)
    things = "river stone bread music paper horse glass light water train house table chair green black white sugar metal ocean forest".split()
    docs = spark.createDataFrame([(i, "the one and other " * 20 + f"{things[i % 20]} " * 120) for i in range(80)], "doc_id long, text string").repartition(4)
    sequences = {}
    for r in packing.pack(docs).collect():
        sequences.setdefault(r["sequence_id"], []).append(r["doc_id"] % 20)
    full = [x for x in sequences.values() if len(x) > 1]
    assert sum(len(set(x)) <= 2 for x in full) >= 0.8 * len(full)


def test_shards_of_terms(monkeypatch):
    monkeypatch.setattr(packing, "SHARD_DOCS", 512)
    assert packing._shards({1: 200, 2: 400, 3: 100, 4: 1200, 5: 1}) == [(1, 0, 1), (2, 1, 1), (3, 1, 1), (4, 2, 3), (5, 5, 1)]


def test_pipeline_by_stages(spark, sf):
    docs = table(spark, sf, "documents")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    ruled = {r["doc_id"] for r in quality_rules.ledger(docs).filter(quality_rules.passes()).collect()}
    judged = {r["doc_id"] for r in quality_classifier.classify(docs.filter(docs.doc_id.isin(list(ruled))), table(spark, sf, "labels")).filter("kept").collect()}
    left = set(brute_similar({i: texts[i] for i in judged}).values())
    out = corpus_pipeline.run(spark, sf).collect()
    assert {r["doc_id"] for r in out} == left
    check_packing(out, {i: texts[i] for i in left})


def test_stages_return_documents(spark, sf):
    docs = table(spark, sf, "documents")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, sf).schema.names == docs.schema.names
        assert stage(spark, docs.limit(0), sf).count() == 0


def test_queries_have_results(spark, sf):
    assert queries.QUERIES["op6_fingerprints"](spark, sf).count() == table(spark, sf, "documents").count()
