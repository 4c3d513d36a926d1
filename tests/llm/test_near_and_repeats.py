import hashlib
import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from palisade.llm import graph, jaccard_join, suffix_dedup
from palisade.llm.graph import components
from palisade.llm.jaccard_join import join_similar
from palisade.llm.suffix_dedup import anchors, cut_repeats, multikey_quicksort, sorted_suffixes


def shingles(text):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def brute_components(texts):
    sets, parent = [shingles(x) for x in texts], list(range(len(texts)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a and b and 100 * len(a & b) >= 75 * len(a | b):
                x, y = root(i), root(j)
                parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), root(i)) for i in range(len(texts))}


def families(seed):
    """Families of near copies, some linked only by way of others, among texts that share passages."""
    r = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    line = [r.choice(words) for _ in range(12)]
    found = []
    for _ in range(6):
        own = [r.choice(words) for _ in range(r.choice([6, 20, 60]))]
        for _ in range(r.choice([1, 3, 25])):
            found.append(" ".join(own))
            own = list(own)
            own[r.randrange(len(own))] = r.choice(words)
    found += [" ".join([*line, *(r.choice(words) for _ in range(r.randint(0, 6)))]) for _ in range(40)]
    r.shuffle(found)
    return found


@pytest.mark.parametrize("seed", range(2))
def test_join_is_exact(spark, seed):
    texts = families(seed)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in join_similar(docs).collect()}
    assert got == brute_components(texts)


def test_join_of_large_groups(spark, monkeypatch):
    """Groups and queries of several parts, and links between groups that only the matrix finds."""
    monkeypatch.setattr(jaccard_join, "CHUNK", 3)
    monkeypatch.setattr(jaccard_join, "QUERIES", 2)
    texts = families(7)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in join_similar(docs).collect()}
    assert got == brute_components(texts)


def test_nodes_stand_for_one_set_each(spark):
    """Two sets under one hash are told apart by the other, and equal ones stay together."""
    rows = [(1, 3, 50, 7, None, None, None), (2, 3, 50, 9, None, None, None), (3, 3, 50, 9, None, None, None), (4, 3, 60, 7, None, None, None), (5, 0, None, None, None, None, None)]
    made = spark.createDataFrame(rows, f"doc_id long, {jaccard_join.MADE}")
    got = {r["doc_id"]: r["node"] for r in jaccard_join._told_apart(made).collect()}
    assert got[1] == 50 and got[2] == got[3] != 50 and got[4] == 60 and got[5] is None


def test_join_on_odd_texts(documents, texts):
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in join_similar(documents).collect()}
    assert got == brute_components(texts)


def test_join_edges(empty, odd_ids):
    assert join_similar(empty).count() == 0
    got = sorted(map(str, (tuple(r) for r in join_similar(odd_ids).collect())))
    assert got == sorted(map(str, [(None, 2, 1), (1, 2, 1), (1, 1, 1), (1, 1, 1), (None, 0, None)]))


@pytest.mark.parametrize("hub", [graph.HUB, 50])
def test_components_of_long_chains(spark, monkeypatch, hub):
    monkeypatch.setattr(graph, "HUB", hub)
    r = random.Random(7)
    nodes = [r.randrange(-(1 << 63), 1 << 63) for _ in range(1300)]
    chain, small, star = nodes[:1000], nodes[1000:1100], nodes[1100:]
    links = [*zip(chain, chain[1:], strict=False), *zip(small, small[1:], strict=False), *((star[0], x) for x in star), (small[1], small[0])]
    df = spark.createDataFrame([x if r.random() < 0.5 else x[::-1] for x in links], "a long, b long").repartition(3)
    got = {x["node"]: x["component"] for x in components(df).collect()}
    assert got == {x: min(own) for own in (chain, small, star) for x in own}
    assert components(df.where("false")).count() == 0


def brute_cut(texts, width):
    raw = [(x or "").encode() for x in texts]
    times = defaultdict(int)
    for b in raw:
        for s in range(len(b) - width + 1):
            times[b[s : s + width]] += 1
    found = {}
    for i, b in enumerate(raw):
        gone = np.zeros(len(b) + 1, bool)
        for s in range(len(b) - width + 1):
            if times[b[s : s + width]] > 1:
                gone[s : s + width] = True
        kept = bytes(c for c, g in zip(b, gone, strict=False) if not g)
        found[i] = (len(b), int(gone.sum()), int((np.diff(np.r_[0, gone.astype(int)]) == 1).sum()), hashlib.sha256(kept).hexdigest())
    return found


@pytest.mark.parametrize("width", [200, 50])
def test_repeats(documents, texts, width):
    rows = cut_repeats(documents, width=width).withColumn("sha", F.sha2("kept", 256)).collect()
    assert {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["sha"]) for r in rows} == brute_cut(texts, width)


def test_one_anchor_in_every_document(spark, monkeypatch):
    """A passage that more documents than MANY hold, each with words of its own around it, and copies of one text."""
    monkeypatch.setattr(suffix_dedup, "HOT", 100)
    r = random.Random(9)
    words = lambda k: "".join(r.choice("abcdefghijklmnop ") for _ in range(k))
    passage = words(230)
    texts = [words(r.randint(60, 120)) + passage + words(r.randint(60, 120)) for _ in range(suffix_dedup.MANY + 100)] + [words(500)] * 300 + ["é" * 250, passage]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    rows = cut_repeats(docs).withColumn("sha", F.sha2("kept", 256)).collect()
    assert {x["doc_id"]: (x["n_bytes"], x["n_removed"], x["n_spans"], x["sha"]) for x in rows} == brute_cut(texts, 200)


def test_keys_stand_for_one_text(spark, monkeypatch):
    """Where hashes meet, all but one text get keys of their own."""
    real = F.xxhash64
    monkeypatch.setattr(suffix_dedup.F, "xxhash64", lambda *x: F.lit(5).cast("long") if [str(y) for y in x] == ["text"] else real(*x))
    texts = ["a" * 300, "b" * 300, "c" * 300, "b" * 300, "xyz"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = cut_repeats(docs).withColumn("sha", F.sha2("kept", 256)).collect()
    assert {x["doc_id"]: (x["n_bytes"], x["n_removed"], x["n_spans"], x["sha"]) for x in rows} == brute_cut(texts, 200)


def test_repeats_edges(empty, odd_ids, documents):
    assert cut_repeats(empty).count() == 0
    longer = odd_ids.withColumn("text", F.repeat("text", F.when(F.length("text") > 10, 2).otherwise(1)))
    assert sorted((str(x["doc_id"]), x["n_bytes"], x["n_removed"]) for x in cut_repeats(longer, width=40).collect()) == [
        ("1", 5, 0), ("1", 5, 0), ("1", 54, 54), ("None", 0, 0), ("None", 54, 54),
    ]
    with pytest.raises(ValueError):
        cut_repeats(longer, width=20)
    text = cut_repeats(documents, width=50, carry=("lang", "key"), as_text=True)
    assert set(text.columns) == {"doc_id", "lang", "key", "kept", "n_bytes", "n_removed", "n_spans"} and {r["key"] for r in text.collect()} == {1}


@pytest.mark.parametrize("seed", range(30))
def test_suffixes_are_sorted(seed):
    r, width = random.Random(seed), 40
    base = bytes(r.choice(b"ab") for _ in range(r.randint(60, 200)))
    data = base + base[: r.randint(0, 60)] + bytes(60)
    starts = np.arange(len(data) - width - 10)
    group = np.array([r.randint(0, 1) for _ in starts])
    order, fresh = sorted_suffixes(data, starts, group, width)
    got = [x.tolist() for x in np.split(order, np.flatnonzero(fresh)[1:])]
    keys = [(int(group[x[0]]), data[x[0] : x[0] + width]) for x in got]
    assert keys == sorted(set(keys)) and sum(map(len, got)) == len(starts)
    assert all((int(group[i]), data[i : i + width]) == k for x, k in zip(got, keys, strict=True) for i in x)


@pytest.mark.parametrize("seed", range(10))
def test_multikey_quicksort(seed):
    r = np.random.default_rng(seed)
    n = int(r.choice([0, 1, 2, 50, 3000]))
    words = r.integers(0, r.choice([1, 2, 5, 1 << 60]), (n, 3)).astype(np.uint64)
    group = np.sort(r.integers(0, 4, n))
    order, fresh = multikey_quicksort(words, group)
    rows = [(int(group[i]), *words[i].tolist()) for i in order]
    assert rows == sorted(rows) and sorted(order.tolist()) == list(range(n))
    assert fresh.tolist() == [k == 0 or rows[k] != rows[k - 1] for k in range(n)]


def test_anchors_own_every_window_once():
    r = random.Random(1)
    texts = [bytes(r.choice(b"abc") for _ in range(n)) for n in (0, 10, 200, 199, 1000, 200)]
    ends = np.cumsum([len(x) for x in texts])
    data = np.frombuffer(b"".join(texts), np.uint8)
    h, place, first, last = anchors(data, ends, 200)
    owned = sorted(x for a, b in zip(first.tolist(), last.tolist(), strict=True) for x in range(a, b + 1))
    want = [s for e, x in zip(ends.tolist(), texts, strict=True) for s in range(e - len(x), e - 199)]
    assert owned == want and all(f <= p <= f + 200 - 32 and t <= p for p, f, t in zip(place, first, last, strict=True))
