"""Every operator on a text of some megabytes among short ones."""

import random
import re

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from palisade.llm.common import stored
from palisade.llm.fingerprints import compare_with_next
from palisade.llm.jaccard_join import join_similar
from palisade.llm.kneser_ney import rate
from palisade.llm.language_id import identify, train
from palisade.llm.mixing import mix
from palisade.llm.packing import pack_best_fit, pack_cost_balanced, unpacked
from palisade.llm.quality_rules import apply_rules
from palisade.llm.suffix_dedup import BYTES, cut_repeats
from palisade.llm.token_counts import count_tokens

BYTE_LEVEL, WORDS = (public_tokenizers.path(x) for x in ("byte_bpe_50k.json", "word_bpe_49k.json"))


@pytest.fixture(scope="module")
def long_texts():
    r = random.Random(1)
    words = ["".join(r.choice("abcdefghijé") for _ in range(r.randint(2, 8))) for _ in range(5000)]
    long = " ".join(r.choice(words) for _ in range(800_000))
    near = long.replace(words[0], "otherword")
    return [long, near, "a short text", None]


@pytest.fixture(scope="module")
def long_docs(spark, long_texts):
    rows = [(i, x, ["en", "de"][i % 2], "s", len(x or "")) for i, x in enumerate(long_texts)]
    return stored(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"))


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(0, 1), (1, 1), (2, 0)], "doc_id long, quality long")


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


def test_words(long_docs, long_texts, labels):
    words = [len(re.findall(r"[^\x20\x09-\x0D]+", x or "")) for x in long_texts]
    assert {i: r["n_words"] for i, r in by_id(apply_rules(long_docs, labels)).items()} == dict(enumerate(words))
    assert {i: r["n_words"] for i, r in by_id(rate(long_docs, labels)).items()} == dict(enumerate(words))
    assert {i: r["size"] for i, r in by_id(mix(long_docs)).items()} == dict(enumerate(words))


def test_tokens(long_docs, long_texts):
    ids = [Tokenizer.from_file(BYTE_LEVEL).encode(x or "", add_special_tokens=False).ids for x in long_texts]
    pieces = pack_cost_balanced(long_docs, BYTE_LEVEL).collect()
    parts = unpacked(pack_best_fit(long_docs, BYTE_LEVEL)).collect()
    for i, own in enumerate(ids):
        for rows, end in ((pieces, 0), (parts, 50256)):
            mine = sorted((r["start"], r["ids"]) for r in rows if r["doc_id"] == i)
            assert np.concatenate([np.frombuffer(x, "<u4") for _, x in mine]).tolist() == [*own, end]
    counts = [len(Tokenizer.from_file(WORDS).encode(x or "", add_special_tokens=False).ids) for x in long_texts]
    assert {i: r["n_tokens"] for i, r in by_id(count_tokens(long_docs, WORDS)).items()} == dict(enumerate(counts))


def test_likeness_and_language(long_docs):
    found = by_id(compare_with_next(long_docs))
    assert found[0]["near_next"] > 0.8 and found[1]["near_next"] < 0.05 and abs(found[0]["near_edited"] - 0.6) < 0.25
    assert {r["lang_pred"] for r in identify(long_docs.where("doc_id < 2"), train(long_docs)).collect()} <= {"en", "de"}
    joined = by_id(join_similar(long_docs))
    assert [joined[i]["component_id"] for i in range(4)] == [0, 0, 2, 3]


def test_repeats_across_pieces(spark):
    """A passage that lies over the border of two pieces, and once more elsewhere."""
    r = np.random.default_rng(3)
    text = "".join(map(chr, r.integers(97, 123, 5_000_000)))
    passage = text[BYTES - 150 : BYTES + 150]
    own = text[:1000] + passage + text[1000:]
    got = cut_repeats(spark.createDataFrame([(1, own)], "doc_id long, text string")).first()
    assert got["n_removed"] == 600 and got["n_spans"] == 2 and got["n_bytes"] == 5_000_300
