"""Models are fitted on all of their training texts, however many there are."""

import math
import random
from pathlib import Path
from urllib.parse import urlparse

import numpy as np
import pytest
from pyspark.sql import functions as F

from palisade.llm import kneser_ney, lm_scoring
from palisade.llm.common import shared_dir

from .test_quality_and_mixing import brute_model


def test_all_trusted_texts_of_a_half_are_fitted_on(spark, monkeypatch):
    n, fitted = 3000, []
    docs = spark.createDataFrame([(i, f"text {i}" if i % 7 else "", "en") for i in range(n)], "doc_id int, text string, lang string")
    labels = spark.createDataFrame([(i, int(i % 10 > 0)) for i in range(n)], "doc_id long, quality int")
    own = kneser_ney.perplexities
    monkeypatch.setattr(kneser_ney, "perplexities", lambda rows, trusted, table: (fitted.extend(r[0] for r in trusted.collect()), own(rows, trusted.limit(5), table))[1])
    kneser_ney.rate(docs, labels)
    half = {r[0] for r in docs.where(kneser_ney._in_training()).select("doc_id").collect()}
    want = [f"text {i}" for i in range(n) if i in half and i % 7 and i % 10]
    assert sorted(fitted) == sorted(want) and len(want) > 1000


def test_each_window_is_trained_on_in_one_round():
    windows = np.arange(1000)
    for seed in (0, 1, 12345, 0xFFFFFFFF):
        assert sorted(np.concatenate([np.flatnonzero(lm_scoring._round_of(windows, seed) == k) for k in range(lm_scoring.ROUNDS)]).tolist()) == windows.tolist()


def test_counts_go_once_the_model_is_made(spark, documents):
    """Of what the model is made from only its own n-grams stay in the shared folder."""
    from pathlib import Path
    from urllib.parse import urlparse

    from palisade.llm.common import shared_dir

    shared = Path(urlparse(shared_dir(spark)).path)
    before = set(shared.iterdir())
    whole, _, _ = kneser_ney.model(documents.where("text IS NOT NULL").select("text"))
    assert len(set(shared.iterdir()) - before) == kneser_ney.ORDER and whole.where("m = 3").count() > 0


def trusted_texts(n, words, seed=2):
    r = random.Random(seed)
    return [" ".join(r.choice(words) for _ in range(r.randint(1, 200))) for _ in range(n)]


def test_model_and_questions_stay_small_on_disk(spark, monkeypatch):
    """What is stored at any time is less than the texts, though nearly every n-gram of theirs is another."""
    texts = trusted_texts(1500, ["the", "of", *(f"word{i}" for i in range(4000))])
    docs = spark.createDataFrame([(i, x, "en") for i, x in enumerate(texts)], "doc_id long, text string, lang string").repartition(4)
    shared, own, sizes = Path(urlparse(shared_dir(spark)).path), kneser_ney.stored, []
    before = {x.name for x in shared.iterdir()}

    def watched(df):
        found = own(df)
        sizes.append(sum(f.stat().st_size for x in shared.iterdir() if x.name not in before for f in x.rglob("*.parquet")))
        return found

    monkeypatch.setattr(kneser_ney, "stored", watched)
    rows = kneser_ney.perplexities(docs, docs.select("text")).collect()
    assert len(rows) == len(texts) and all(r["perplexity"] > 1 for r in rows)
    assert max(sizes) < sum(map(len, texts))


@pytest.mark.parametrize("heavy", [1, 40])
def test_what_stands_amid_frequent_words_is_dealt_to_several_shards(spark, monkeypatch, heavy):
    monkeypatch.setattr(kneser_ney, "HEAVY", heavy)
    words = ["a", "a", "a", "a", "the", "the", *(f"w{i}" for i in range(30))]
    trusted, scored = trusted_texts(25, words), trusted_texts(12, [*words, "new"], 5)
    docs = spark.createDataFrame([(i, x, "x") for i, x in enumerate(scored)], "doc_id long, text string, lang string").repartition(3)
    known = kneser_ney.Known(np.array([10]), np.array([90]), 24)
    assert known.spread.max() == min(24, -(-90 // heavy))
    got = {x["doc_id"]: x["perplexity"] for x in kneser_ney.perplexities(docs, spark.createDataFrame([(x,) for x in trusted], "text string"), 1 << 17).collect()}
    p = brute_model([x.split() for x in trusted])
    for i, x in enumerate(scored):
        s = ("<s>", "<s>", *x.split(), "</s>")
        total = sum(math.log(p(s[j - 2 : j], s[j])) for j in range(2, len(s)))
        assert math.isclose(got[i], math.exp(-total / (len(s) - 2)), rel_tol=1e-5)


def test_words_are_told_apart():
    r = random.Random(1)
    parts, seen = [b"a", b"b", b" ", b"\n", b"\t", b"\x0b", b"\x1c", b"\xc3\xa9", b"\x85", b"\x00", b"zz"], {}
    for _ in range(2000):
        texts = [b"".join(r.choice(parts) for _ in range(r.randint(0, 12))) for _ in range(r.randint(1, 5))]
        for text, own in zip(texts, kneser_ney._words(texts)):
            assert len(own) == len(text.split()) and all(seen.setdefault(w, h) == h for w, h in zip(text.split(), own.tolist()))
    assert len(set(seen.values())) == len(seen) and min(seen.values()) > kneser_ney.END
    long = b"word and, " * 60_000 + b"x" * 300_000
    short, own = kneser_ney._words([b"word and,", long])
    assert len(own) == 120_001 and own[:-1].tolist() == short.tolist() * 60_000


def test_texts_in_another_order_are_an_error(spark):
    docs = spark.createDataFrame([(i, f"a b {i}", "x") for i in range(40)], "doc_id long, text string, lang string").repartition(2)
    same = docs.withColumn("text", F.concat("text", F.lit(" "), F.rand().cast("string")))
    again = same.withColumn("text", F.udf(lambda x: f"{x} {random.random()}")("text"))
    with pytest.raises(RuntimeError):
        kneser_ney.perplexities(again, docs.select("text")).collect()
