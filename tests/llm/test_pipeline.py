import os
import random
import subprocess
import sys
from collections import Counter
from pathlib import Path

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P
from palisade.llm.common import stored
from palisade.llm.mixing import mix

from .test_near_and_repeats import brute_components, brute_cut

DATA = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables here")
def test_stages_against_brute_force(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    results = [docs]
    for _, stage in P.STAGES:
        results.append(stored(stage(spark, results[-1], DATA)))
    raw, known, single, cut, mixed, packed = results
    for x in (known, single, cut, mixed):
        assert x.columns == list(P.COLUMNS)
    assert known.count() == raw.where("text RLIKE '\\\\p{L}'").count()
    rows = {r["doc_id"]: r["text"] for r in known.collect()}
    ids = sorted(rows)
    groups = brute_components([rows[i] for i in ids])
    assert {r["doc_id"] for r in single.collect()} == {ids[k] for k, (_, c) in groups.items() if c == k}
    rows = {r["doc_id"]: r["text"] for r in single.collect()}
    ids = sorted(rows)
    want = brute_cut([rows[i] for i in ids], 200)
    got = {r["doc_id"]: r["text"] for r in cut.collect()}
    assert set(got) == set(ids)
    for k, i in enumerate(ids):
        assert len(rows[i].encode()) - want[k][1] >= len(got[i].encode()) >= len(rows[i].encode()) - want[k][1] - 6 * want[k][2]
        assert want[k][1] or got[i] == rows[i]
    copies = {r["doc_id"]: r["n"] for r in mixed.groupBy("doc_id").agg(F.count("*").alias("n")).collect()}
    assert set(copies) <= set(ids) and max(copies.values()) <= 2
    assert packed.select("doc_id").distinct().count() == len(copies)
    whole = packed.groupBy("doc_id").agg(F.sum("length").alias("n"), F.max("doc_tokens").alias("of")).collect()
    assert all(r["n"] == copies[r["doc_id"]] * r["of"] for r in whole)


def counted(df):
    return Counter(tuple(r) for r in df.collect())


def test_one_row_of_each_group_stays(spark, odd_ids):
    r = random.Random(5)
    text = lambda k: " ".join("".join(r.choice("abcdefgh") for _ in range(6)) for _ in range(k))
    again, copied, third, alone, nobody = (text(60) for _ in range(5))
    rows = [(1, again)] * 3 + [(None, copied), (2, copied), (None, copied), (3, third), (7, third), (7, alone), (None, nobody), (None, nobody), (9, " "), (9, " ")]
    docs = spark.createDataFrame([(i, x, "en", "a", len(x)) for i, x in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    single = stored(P.near_copies(spark, docs, DATA))
    want = Counter({(1, again): 1, (2, copied): 1, (3, third): 1, (7, alone): 1, (None, nobody): 1, (9, " "): 2})
    assert counted(single.select("doc_id", "text")) == want
    assert counted(P.repeats(spark, single, DATA).select("doc_id", "text")) == want
    left = P.near_copies(spark, odd_ids, DATA).select("doc_id", "text")
    assert counted(left) == {(1, "one two three four five six"): 1, (1, "other"): 1, (None, None): 1}


def test_every_stage_on_odd_rows(spark, documents, odd_ids):
    """Empty tables, nulls in any column, ties, repeated rows, a text of some megabytes, clashing columns: each stage
    gives the columns of documents and the rows that it says."""
    r = random.Random(2)
    words = ["".join(r.choice("abcdefghij") for _ in range(r.randint(2, 8))) for _ in range(3000)]
    long = " ".join(r.choice(words) for _ in range(300_000))
    rows = [(1, long, "en", "a", len(long)), (2, long, "en", "a", None), (None, "a few words more of it", None, None, None), (3, "", "de", "b", 0), (3, None, "de", "b", 0)]
    given = spark.createDataFrame([(*x, "t", 1) for x in rows], "doc_id long, text string, lang string, source string, n_chars long, row string, size long")
    none = given.where("false")
    for _, stage in P.STAGES[:-1]:
        got = stage(spark, none, DATA)
        assert got.columns == list(P.COLUMNS) and got.count() == 0
    assert P.packed(spark, none, DATA).count() == 0
    known = P.language(spark, given, DATA)
    assert counted(known.select("doc_id")) == Counter({(1,): 1, (2,): 1, (None,): 1})
    assert counted(P.near_copies(spark, given, DATA).select("doc_id", "n_chars")) == Counter({(1, len(long)): 1, (None, None): 1, (3, 0): 2})
    cut = counted(P.repeats(spark, given, DATA).select("doc_id", "text", "n_chars"))
    assert cut == Counter({(1, "", 0): 1, (2, "", 0): 1, (None, "a few words more of it", 22): 1, (3, "", 0): 2})
    mixed = counted(P.mixture(spark, given, DATA).select("doc_id", "source"))
    # 1.5 times all words: a's weight is 3, b has none, null's is 2 and stops at twice its 6 words
    assert mixed[None, None] == 2 and not mixed[3, "b"] and 2 <= mixed[1, "a"] + mixed[2, "a"] <= 4
    pieces = P.packed(spark, given, DATA).groupBy("doc_id").agg(F.sum("length").alias("n")).collect()
    assert {x["doc_id"]: x["n"] for x in pieces}[3] == 2


def test_row_keys_tell_nulls_apart(spark):
    rows = [(1, "some words here", *x) for x in (("en", None, 5), (None, "en", 5), ("en", None, 5), ("en", "en", None))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert P.near_copies(spark, docs, DATA).count() == 1
    assert docs.select(P.row_key().alias("row")).distinct().count() == 3


def test_mixture_of_repeated_ids(spark, odd_ids):
    rows = [(7, f"words {i} here", "en", "a", 1) for i in range(6)] + [(None, "same again", "en", "a", 1)] * 5
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    for given in (docs, odd_ids):
        taken, of = counted(P.mixture(spark, given, DATA)), counted(given)
        assert set(taken) <= set(of) and all(n <= 2 * of[x] for x, n in taken.items())
        words = sum(len(x[1].split()) * n for x, n in taken.items())
        assert words == sum(x["taken"] for x in mix(given.withColumn("row", P.row_key()), id_col="row").collect())


def test_nothing_else_imports_this_package():
    root = Path(__file__).parents[2]
    others = [p for p in root.joinpath("palisade").rglob("*.py") if "llm" not in p.relative_to(root).parts]
    assert not [p for p in others if "palisade.llm" in p.read_text()]


def test_importing_needs_no_session():
    root = Path(__file__).parents[2]
    subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; e.queries(); e.oracle_sql()"], cwd=root, check=True)


def plans(node):
    """Of a physical plan: (name, names of what it takes rows from within its stage)."""
    if node.nodeName() == "AdaptiveSparkPlan":
        node = node.initialPlan()
    below = [node.children().apply(i) for i in range(node.children().size())]
    own = node.nodeName()
    inside = [] if "Exchange" in own else [x for b in below for x in (b.nodeName(), *plans(b)[0])]
    return inside, [(own, inside), *(x for b in below for x in plans(b)[1])]


def test_a_task_of_repeats_has_one_python_worker(spark, documents):
    """Workers stay for the session: of two in a task both count for an executor's memory from then on."""
    _, found = plans(P.repeats(spark, documents, DATA)._jdf.queryExecution().executedPlan())
    cuts = [inside for name, inside in found if name.startswith("MapInArrow")]
    assert cuts and any(name.startswith("ArrowEvalPython") for name, _ in found)
    assert not [x for inside in cuts for x in inside if "Python" in x or "MapInArrow" in x]


def test_small_tables_come_without_python_workers_of_another_kind(spark, documents, monkeypatch):
    def refused(*_, **__):
        raise AssertionError("a list became an RDD that Python has to read")

    monkeypatch.setattr(type(spark.sparkContext), "parallelize", refused)
    assert P.train(documents).names == ["de", "en"]


def test_an_encoder_loads_the_slower_library_for_texts_that_need_it():
    from palisade.llm.queries import tokenizer_path
    from palisade.llm.tokens import Encoder, special_strings, tokenizer

    path = tokenizer_path("byte_bpe_50k.json")
    own, plain = Encoder(path), tokenizer(path)
    assert sorted(own.special) == sorted(special_strings(plain))
    assert own("a text, é 日本").tolist() == plain.encode("a text, é 日本", add_special_tokens=False).ids and "tok" not in vars(own)
    for text in (f"a{own.special[0]}b", "x\x1cy"):
        assert own(text).tolist() == plain.encode(text, add_special_tokens=False).ids
    assert "tok" in vars(own)


def test_counting_shingles_takes_little_memory(monkeypatch):
    """What a task counts together, sorted in place: at most thrice the shingles themselves, values and all."""
    import tracemalloc

    import numpy as np
    import pyarrow as pa

    from palisade.llm import jaccard_join as J

    r = np.random.default_rng(4)
    sets = [np.unique(r.integers(0, 1 << 62, 20_000).astype(np.uint64)) for _ in range(40)]
    sets.append(sets[0][:500])
    given = iter(sets)
    monkeypatch.setattr(J, "shingles", lambda raw, width: next(given))
    batch = pa.record_batch([pa.array(range(41), pa.int64()), pa.array(["x"] * 41)], ["doc_id", "text"])
    made = J._sets(iter([batch]), 5, pa.int64())
    next(made)
    tracemalloc.start()
    rows = next(made)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert dict(zip(rows.column("token").to_pylist(), rows.column("times").to_pylist())) == {int(x): 2 for x in sets[0][:500]}
    assert peak < 3 * sum(x.nbytes for x in sets)
