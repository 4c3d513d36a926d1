import math
import random
from collections import defaultdict

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from palisade.llm.language_id import BEGIN, ORDER, UNKNOWN, Models, _grams, held_out, identify, keep_identified, train
from palisade.llm.token_counts import count_tokens

PATH = public_tokenizers.path("word_bpe_49k.json")


def test_token_counts(documents, texts, empty, odd_ids):
    tok = Tokenizer.from_file(PATH)
    got = {r["doc_id"]: (r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in count_tokens(documents, PATH, limit=50).collect()}
    for i, x in enumerate(texts):
        n = len(tok.encode(x or "", add_special_tokens=False).ids)
        assert got[i] == (len((x or "").encode()), n, n > 50), repr(x)
    assert count_tokens(empty, PATH).count() == 0 and count_tokens(odd_ids, PATH).count() == 5


def test_pieces_count_alone_as_in_their_text():
    r, tok = random.Random(4), Tokenizer.from_file(PATH)
    parts = list("ab Cd '\n\t  \x0b\x85\xa0 ​é́İΣςß1٣\x1c$﻿") + ["'ll", "!!", "日本"]
    import re

    for _ in range(2000):
        x = "".join(r.choice(parts) for _ in range(r.randint(0, 14)))
        pieces = re.findall("[^ \t\n\r\v\f]+", x)
        assert sum(len(tok.encode(p, add_special_tokens=False).ids) for p in pieces) == len(tok.encode(x, add_special_tokens=False).ids), repr(x)


def brute(train_texts, text):
    counts = defaultdict(lambda: defaultdict(int))
    for t in train_texts:
        s = BEGIN + t
        for i in range(ORDER, len(s)):
            for k in range(ORDER + 1):
                counts[s[i - k : i]][s[i]] += 1
    s, total = BEGIN + text, 0.0
    for i in range(ORDER, len(s)):
        for k in range(ORDER, -1, -1):
            v = counts.get(s[i - k : i])
            if v is None:
                continue
            n, d = sum(v.values()), len(v)
            if s[i] in v:
                total -= math.log2(v[s[i]] / (n + d))
                break
            total -= math.log2(d / (n + d))
        else:
            total += 8
    return total


def test_code_lengths_are_exact():
    r = random.Random(3)
    some = lambda letters: [bytes(r.choice(letters) for _ in range(r.randint(0, 200))) for _ in range(5)]
    own = {"a": some(b"abcd e"), "b": some(b"bcdx f")}
    models = Models({k: np.unique(_grams([BEGIN + x for x in t])[0], return_counts=True) for k, t in own.items()})
    unseen = [bytes(r.choice(b"abcdx ef\xff") for _ in range(r.randint(0, 50))) for _ in range(60)]
    assert np.allclose(models.code_lengths(unseen), [[brute(own[k], x) for k in models.names] for x in unseen], atol=1e-3)
    # a text of several pieces
    long = bytes(r.choice(b"abcdx ef") for _ in range(300_000))
    assert np.allclose(models.code_lengths([b"", long, b"ab"])[1], [brute(own[k], long) for k in models.names], rtol=1e-5)


def test_languages(spark):
    r = random.Random(5)
    words = {"en": ["the", "of", "and", "river", "stone"], "de": ["der", "und", "fluß", "stein", "ich"]}
    rows = [(i, " ".join(r.choice(words[x]) for _ in range(20)), x) for i in range(200) for x in [("en", "de")[i % 2]]]
    rows += [(900, None, "en"), (901, "123 !!", "en"), (902, "", None), (903, "the river", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    models = train(docs.where(~held_out()), docs=40)
    got = {x["doc_id"]: x for x in identify(docs, models).collect()}
    assert all(got[i]["lang_pred"] == x for i, _, x in rows[:200]) and all(0 <= x["score"] <= 1 for x in got.values())
    assert [got[i]["lang_pred"] for i in (900, 901, 902, 903)] == [UNKNOWN] * 3 + ["en"]
    assert {x["doc_id"] for x in keep_identified(docs, models).collect()} == {*range(200), 903}


def test_training_sample(spark):
    """The rows with the smallest hashes of each language, all of the languages there are, their whole texts."""
    rows = [(i, f"text {i} of " + "xyz" * (i % 7), f"l{i % 90:02d}" if i % 3 else "main") for i in range(600)] + [(None, "no id", "main"), (5, None, "l01"), (6, "no lang", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(5)
    hashed = docs.where("text IS NOT NULL AND lang IS NOT NULL").withColumn("h", F.xxhash64("doc_id", "text")).collect()
    for limits, own in (((3, 10_000), 3), ((4, 130), 2), ((4, 5), 1)):
        models, want = train(docs, docs=limits[0], rows=limits[1]), {}
        for lang in {x["lang"] for x in hashed}:
            texts = [x["text"].encode() for x in sorted((x for x in hashed if x["lang"] == lang), key=lambda x: x["h"])[:own]]
            want[lang] = np.unique(_grams([BEGIN + x for x in texts])[0], return_counts=True)
        assert models.names == sorted(want) and len(want) == 61
        again = Models(want)
        assert np.array_equal(models.rows, again.rows) and np.array_equal(models.table.keys, again.table.keys)


def test_no_languages(documents, empty, odd_ids):
    models = train(empty)
    assert {r["lang_pred"] for r in identify(odd_ids, models).collect()} == {UNKNOWN}
    assert identify(empty, train(documents)).count() == 0 and keep_identified(documents, models).count() == documents.count()
