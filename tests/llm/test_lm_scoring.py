import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest

from palisade.llm import lm_scoring, queries
from palisade.llm.attention import HEAD, STRIDE, WINDOW, Frame, Model, Trainer, initial, packed, unpacked
from palisade.llm.lm_scoring import Vocabulary, encoded, held_out, score, score_texts, split, train

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def words_of(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x20\x09-\x0D]+", lower) + [" end"]


def small_frame(seed=1, size=3000):
    r = np.random.default_rng(seed)
    chain = (r.integers(0, 60, 4000) + r.integers(0, 3, 4000)) * 7
    chain[::40] = size - 1
    frame = Frame(np.bincount(chain, minlength=size).astype(float), size - 1)
    leaves = frame.leaf_of[chain].astype(np.int64)
    pairs, n = np.unique(leaves[:-1] * HEAD + leaves[1:], return_counts=True)
    frame.fit(pairs // HEAD, pairs % HEAD, n)
    return frame, chain


def rough(seed=3):
    r = np.random.default_rng(seed)
    return {k: x + r.standard_normal(x.shape).astype(np.float32) * 0.1 for k, x in initial().items()}


def test_gradients_are_slopes():
    frame, chain = small_frame()
    model = Model(frame, rough())
    r = np.random.default_rng(5)
    x, y = (frame.leaf_of[r.choice(chain, (3, WINDOW))] for _ in range(2))
    weight = (r.random((3, WINDOW)) < 0.8).astype(np.float32)
    _, g = model.gradients(x, y, weight)
    for name in model.w:
        norm = float(np.sqrt((g[name] ** 2).sum()))
        step = g[name] / np.float32(norm)
        both = []
        for sign in (1, -1):
            moved = dict(model.w)
            moved[name] = moved[name] + sign * np.float32(3e-2) * step
            both.append(Model(frame, moved).gradients(x, y, weight)[0])
        assert math.isclose((both[0] - both[1]) / 6e-2, norm, rel_tol=0.05), name


def test_probabilities_of_the_next_id_sum_to_one():
    frame, chain = small_frame()
    model = Model(frame, rough())
    before = [chain[:k] for k in (0, 1, 5, 40)]
    for own in before:
        every = model.score([np.concatenate([own, [i]]) for i in range(3000)])
        given = model.score([own])[0] if len(own) else 0.0
        assert math.isclose((10 ** (every - given)).sum(), 1, rel_tol=1e-3)


def test_each_position_is_scored_once():
    """Whole texts against one window at a time, by the definition."""
    frame, chain = small_frame()
    model = Model(frame, rough())
    texts = [chain[a : a + n] for a, n in ((0, 1), (3, 0), (7, WINDOW), (50, WINDOW + 1), (90, STRIDE + WINDOW), (200, 333))]
    for text, got in zip(texts, model.score(texts)):
        leaves, total = frame.leaf_of[text], float(frame.inner[text].sum())
        x = np.concatenate([[frame.end], leaves[:-1]]) if len(text) else leaves
        for p in range(len(text)):
            i = 0 if p < WINDOW else -(-(p - WINDOW + 1) // STRIDE)
            lo = i * STRIDE
            window = np.zeros((1, WINDOW), np.int64)
            window[0, : p - lo + 1] = x[lo : p + 1]  # what comes later is not seen
            out, _ = model._hidden(window)
            at = p - lo
            total += float(model.chosen(out[:, at], x[p : p + 1], frame.place[leaves[p : p + 1]])[0])
        assert math.isclose(total, got, rel_tol=1e-4, abs_tol=1e-4)


def test_training_helps():
    frame, chain = small_frame()
    model = Model(frame, initial())
    before = model.score([chain[-800:]])[0]
    own = Trainer(model)
    for _ in range(6):
        for k in range(0, len(chain) - WINDOW - 900, WINDOW):
            own.feed(frame.leaf_of[chain[k : k + WINDOW + 1]])
    assert own.steps > 5 and model.score([chain[-800:]])[0] > before
    again = unpacked(packed(model.w))
    assert all(np.array_equal(again[k], x) for k, x in model.w.items())


def test_words_and_ids():
    know, r = Vocabulary(PATH), random.Random(3)
    parts = list("ab Cd '\n\t  \x0b\x85\xa0\u3000é́İΣß1٣\x1c$") + ["foo.", "bar,", "é,", "²,", "日本", " the", "x" * 90, "<|endoftext|>"]
    for _ in range(2000):
        text = "".join(r.choice(parts) for _ in range(r.randint(0, 12)))
        words = [w for part in split(text.encode()) for w in part]
        assert [w.decode() for w in words] == words_of(text)[:-1]
        assert know.ids(words).tolist() == [i for w in words for i in know.encoding.encode_ordinary(" " + w.decode())], text
        for w in words:
            assert know.ids([w]).tolist() == know.encoding.encode_ordinary(" " + w.decode()), w
    distinct = {w for text in ("a b ab", "ab, a b", "x" * 90 + " é ") for w in text.encode().split()}
    keys = {w: int(know.keys(know.ids([w]))[0][0]) for w in distinct}
    assert len(set(keys.values())) == len(distinct) and lm_scoring.END_KEY not in keys.values()
    assert know.keys(know.ids(sorted(distinct)))[0].tolist() == [keys[w] for w in sorted(distinct)]
    long = ("é word " * 400_000).encode()
    assert [w for part in split(long) for w in part] == long.split()


@pytest.mark.parametrize("sent", [1 << 19, 20])
def test_counts_equal_brute_force(spark, documents, texts, monkeypatch, sent):
    monkeypatch.setattr(lm_scoring, "SENT", sent)
    monkeypatch.setattr(lm_scoring, "HELD", 200)
    monkeypatch.setattr(lm_scoring, "SQUARE", 30)
    got = {r["doc_id"]: r for r in score_texts(documents, PATH, held_out()).collect()}
    trained = [i for i in range(len(texts)) if zlib.crc32(str(i).encode()) % 5 != 1]
    c = Counter(w for i in trained for w in words_of(texts[i]))
    n, v = sum(c.values()), len(c)
    assert len(got) == len(texts) and 0 < len(trained) < len(texts)
    for i, x in enumerate(texts):
        own = words_of(x)
        r = got[i]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(own), sum(c[w] > 0 for w in own), n)
        assert math.isclose(r["base_score"], sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in own), rel_tol=1e-9)
        assert r["score"] < 0


@pytest.mark.parametrize("square", [5, 2048])
def test_unigrams_and_pairs(documents, texts, monkeypatch, square):
    monkeypatch.setattr(lm_scoring, "SQUARE", square)
    counts, know = train(encoded(documents, PATH), PATH).counts, Vocabulary(PATH)
    want = Counter()
    for x in texts:
        ids = [know.end, *(i for w in words_of(x)[:-1] for i in know.encoding.encode_ordinary(" " + w)), know.end]
        want.update(zip(ids, ids[1:]))
    assert {(r["key"] >> 20, r["key"] % (1 << 20)): r["n"] for r in counts.where("kind = 1").collect()} == want


def test_better_than_word_counts_on_texts_it_has_not_seen(spark):
    """Two languages of syllables: new words are made of known parts, and a text keeps to its language."""
    r = random.Random(9)
    parts = {k: ["".join(r.choice(x) for _ in range(2)) for _ in range(12)] for k, x in (("a", "bdfglm"), ("b", "kprstv"))}
    text = lambda k: " ".join("".join(r.choice(parts[k]) for _ in range(r.randint(1, 3))) for _ in range(60))
    docs = spark.createDataFrame([(i, text("ab"[i % 2])) for i in range(1500)], "doc_id long, text string").repartition(4)
    rows = score_texts(docs, PATH, held_out()).where("held").collect()
    assert len(rows) > 200 and sum(x["score"] for x in rows) > sum(x["base_score"] for x in rows)


def test_odd_rows(spark, empty, odd_ids, documents):
    model = train(encoded(empty, PATH), PATH)
    assert (model.tokens, model.distinct) == (0, 0) and score_texts(empty, PATH).count() == 0
    rows = score(encoded(odd_ids, PATH), model).collect()
    assert sorted((str(r["doc_id"]), r["n_tokens"], r["n_known"]) for r in rows) == [("1", 2, 0), ("1", 2, 0), ("1", 7, 0), ("None", 1, 0), ("None", 7, 0)]
    assert all(math.isfinite(r["score"]) and math.isclose(r["base_score"], r["n_tokens"] * 0.0, abs_tol=1e-9) for r in rows)
    equal = [r["score"] for r in rows if r["doc_id"] == 1 and r["n_tokens"] == 2]
    assert equal[0] == equal[1]
    long = spark.createDataFrame([(1, "wörd and, more. " * 150_000), (2, "x" * 1_500_000), (3, None)], "doc_id long, text string")
    got = {r["doc_id"]: r for r in score_texts(long, PATH).collect()}
    assert [got[i]["n_tokens"] for i in (1, 2, 3)] == [450_001, 2, 1] and all(math.isfinite(r["score"]) for r in got.values())


def test_query(spark):
    got = queries.QUERIES["op12_lm_scoring"](spark, "/root/testdata/sf0.001")
    assert {"doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"} <= set(got.columns)
    for r in got.collect():
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 1) and (r["held_out"] or r["n_known"] == r["n_tokens"])


def test_steps_sum_rows_of_a_leaf_together(monkeypatch):
    """Gradients by leaf without a row at a time, exact whatever the exponents."""
    frame, chain = small_frame()
    model = Model(frame, rough())
    x, y = frame.leaf_of[chain[: 4 * WINDOW]].reshape(4, WINDOW), frame.leaf_of[chain[1 : 4 * WINDOW + 1]].reshape(4, WINDOW)
    weight = np.ones((4, WINDOW), np.float32)
    safe = model._gradients(x, y, weight, True) if hasattr(model, "_gradients") else model.gradients(x, y, weight)

    class NoAt:
        def __getattr__(self, name):
            return getattr(np.add, name)

        def at(self, *_):
            raise AssertionError("a row at a time")

    monkeypatch.setattr("palisade.llm.attention.np", type("N", (), {"__getattr__": lambda _, name: NoAt() if name == "add" else getattr(np, name)})())
    loss, g = model.gradients(x, y, weight)
    assert math.isclose(loss, safe[0], rel_tol=1e-5)
    assert all(np.allclose(g[k], safe[1][k], rtol=1e-3, atol=1e-6) for k in g)
    model.w["cluster_bias"] += np.float32(100)  # beyond what float32 holds as a power of e: the same shares
    model._bias = None
    loss, g = model.gradients(x, y, weight)
    assert math.isclose(loss, safe[0], rel_tol=1e-4) and all(np.allclose(g[k], safe[1][k], rtol=1e-2, atol=1e-5) for k in g)


def test_every_window_of_every_training_text_is_trained_on_once(documents, texts):
    know = Vocabulary(PATH)
    sizes = [1 + sum(len(know.encoding.encode_ordinary(" " + w)) for w in words_of(x)[:-1]) for i, x in enumerate(texts) if zlib.crc32(str(i).encode()) % 5 != 1]
    model = train(encoded(documents, PATH, held_out()), PATH)
    assert model.windows == sum(-(-n // WINDOW) for n in sizes) and 0 < len(sizes) < len(texts)


def test_windows_are_fed_together_as_one_by_one():
    """Steps are of the same windows, in the same order, however many come at a time."""
    frame, chain = small_frame()
    runs = [frame.leaf_of[chain[a : a + n + 1]] for a, n in ((0, 1), (5, WINDOW), (9, 70 * WINDOW + 3), (100, 700), (40, 0))]
    one, many = (Trainer(Model(frame, initial())) for _ in range(2))
    fed = 0
    for run in runs:
        which = np.flatnonzero(np.arange(-(-(len(run) - 1) // WINDOW)) % 7 != 3)
        fed += len(which)
        for k in which.tolist():
            one.feed(run[k * WINDOW : (k + 1) * WINDOW + 1])
        many.feed_windows(run, which)
    one.step(), many.step()
    assert (one.steps, one.windows) == (many.steps, many.windows) == (2, fed)
    assert all(np.array_equal(x, many.model.w[k]) for k, x in one.model.w.items())


def test_texts_read_together_have_the_ids_of_each():
    know, r = Vocabulary(PATH), random.Random(7)
    parts = list("ab Cd '\n\t  \x0b\x85\xa0\u3000é́İΣß1٣\x1c$") + ["foo.", "bar,", "é,", "²,", "日本", " the", "x" * 200, "<|endoftext|>"]
    for _ in range(500):
        raws = ["".join(r.choice(parts) for _ in range(r.randint(0, 12))).encode().lower() for _ in range(r.randint(1, 6))]
        found, ids, of = know.texts(raws)
        keys = know.keys(ids)[0].tolist()
        met = Counter((x // max(1, len(keys)), keys[x % max(1, len(keys))]) for x in of.tolist())
        want = Counter()
        for i, (raw, own) in enumerate(zip(raws, found)):
            words = [w for part in split(raw) for w in part]
            assert own.tolist() == [x for w in words for x in know.encoding.encode_ordinary(" " + w.decode())], raw
            want.update((i, k) for k in know.keys(own)[0].tolist())
        assert met == want
