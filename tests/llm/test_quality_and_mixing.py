import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from palisade.llm import kneser_ney as K
from palisade.llm.fingerprints import EMPTY, SAMPLES, both_samples, compare_with_next, draws, fingerprint, likeness, weighted_sample, weighted_terms
from palisade.llm.hashing import Table
from palisade.llm import mixing
from palisade.llm.mixing import mix, targets, tilts
from palisade.llm.quality_features import features
from palisade.llm.quality_rules import apply_rules, binomial_tail, chosen_rungs


# ---- fingerprints

def pairs(text):
    w = text.encode().lower().split()
    return Counter(zip(w, w[1:], strict=False)) if len(w) > 1 else Counter(w)


def test_fingerprints(documents, texts, empty, odd_ids):
    rows = sorted(compare_with_next(documents).collect(), key=lambda r: r["doc_id"])
    assert [r["doc_id"] for r in rows] == list(range(len(texts)))
    for i, r in enumerate(rows):
        x, after = texts[i] or "", texts[(i + 1) % len(texts)] or ""
        n = len(x) // 4
        edited = x[: len(x) - n] + after[:n]
        assert r["n_chars"] == len(x) and r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert r["fingerprint"] == fingerprint(x) and r["edited_fingerprint"] == fingerprint(edited)
        assert r["near_edited"] == likeness(fingerprint(x), fingerprint(edited)) and r["near_next"] == likeness(fingerprint(x), fingerprint(after))
    assert compare_with_next(empty).count() == 0
    # null first, ties by the text's hash; the last is followed by the first
    odd = odd_ids.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("h", F.xxhash64("text")).orderBy("doc_id", "h").collect()
    want = sorted((str(x["doc_id"]), len(x["text"]), likeness(fingerprint(x["text"]), fingerprint(odd[(k + 1) % 5]["text"]))) for k, x in enumerate(odd))
    assert sorted((str(x["doc_id"]), x["n_chars"], x["near_next"]) for x in compare_with_next(odd_ids).collect()) == want


def test_draws_are_distributed_right():
    r, c, b = (x.ravel().astype(float) for x in draws(np.arange(4000, dtype=np.uint64)))
    for x in (r, c):  # gamma(2, 1)
        assert abs(x.mean() - 2) < 0.02 and abs(x.var() - 2) < 0.05
        for q in (0.05, 0.5, 2.0, 6.0):
            assert abs((x < q).mean() - (1 - (1 + q) * math.exp(-q))) < 0.005
    assert abs(b.mean() - 0.5) < 0.005 and abs(b.var() - 1 / 12) < 0.002
    assert abs(np.corrcoef([r, c, b]) - np.eye(3)).max() < 0.01


@pytest.mark.parametrize("seed", range(4))
def test_sampler_by_definition(seed):
    """Each sample is the term and level with the least a, term by term."""
    rng = random.Random(seed)
    terms = np.array(sorted({rng.getrandbits(64) for _ in range(rng.choice([1, 5, 700]))}), np.uint64)
    weights = np.array([rng.choice([1, 1, 1, 2, 9, 1000]) for _ in terms])
    r, c, b = draws(terms)
    got = weighted_sample(terms, weights)
    for k in range(SAMPLES):
        found = []
        for i, w in enumerate(weights.tolist()):
            ri, ci, bi = (float(x[i, k]) for x in (r, c, b))
            t = math.floor(math.log(w) / ri + bi)
            found.append((math.log(ci) - ri * (t - bi) - ri, i, t))
        a, i, t = min(found)
        if sum(x[0] < a + 1e-4 for x in found) == 1:
            # the same term at the same level alone gives the same 16 bits
            level = weighted_sample(terms[i : i + 1], weights[i : i + 1])
            assert got[2 * k : 2 * k + 2] == level[2 * k : 2 * k + 2]


def test_long_texts_without_a_common_word_are_unlike():
    a, b = (" ".join(f"{x}{i}" for i in range(400_000)) for x in "ab")
    assert likeness(fingerprint(a), fingerprint(b)) < 0.05 and fingerprint(" \n") == EMPTY
    half = " ".join([*(f"a{i}" for i in range(200_000)), *(f"b{i}" for i in range(200_000))])
    assert abs(likeness(fingerprint(a), fingerprint(half)) - 1 / 3) < 0.2


def test_collision_rate_is_weighted_jaccard():
    r = random.Random(2)
    errors = []
    for _ in range(150):
        words = [r.choice("abcdefghij") * r.randint(1, 2) for _ in range(120)]
        a, b = " ".join(words), " ".join(words[: r.randint(0, 120)] + [r.choice("klm") for _ in range(30)])
        assert both_samples(weighted_terms(a), weighted_terms(b)) == (fingerprint(a), fingerprint(b))
        p, q = pairs(a), pairs(b)
        want = sum((p & q).values()) / sum((p | q).values())
        errors.append(likeness(fingerprint(a), fingerprint(b)) - want)
    assert abs(np.mean(errors)) < 0.02 and np.std(errors) < 0.08


# ---- mixing

def brute_targets(sizes, share=1.5, cap=2):
    names = sorted(sizes, key=lambda x: (x is None, (x or "").encode()))
    weight = {x: (3, 1, 2)[i % 3] for i, x in enumerate(names)}
    full, left = {}, share * sum(sizes.values())
    while True:
        rest = [x for x in names if x not in full]
        per = left / sum(weight[x] for x in rest) if rest else 0
        over = [x for x in rest if weight[x] * per > cap * sizes[x]]
        if not over:
            return full | {x: weight[x] * per for x in rest}
        for x in over:
            full[x] = cap * sizes[x]
            left -= full[x]


@pytest.mark.parametrize("seed", range(3))
def test_targets(spark, seed):
    r = random.Random(seed)
    sizes = {x: r.choice([0, 10, 100, 1000]) for x in [*"abcdeZé", None]}
    df = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    got = {x["source"]: x["target"] for x in targets(df).collect()}
    want = brute_targets(sizes)
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)


def test_mix(spark):
    r = random.Random(3)
    rows = [(i, " ".join("w" * r.randint(1, 3) for _ in range(r.choice([0, 1, 5, 20, 20, 200]))), r.choice(["a", "a", "a", "b", "c", None])) for i in range(1500)]
    rows += [(2000 + i, "same size here", "a") for i in range(2500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4)
    first, again = ({x["doc_id"]: x.asDict() for x in mix(d).collect()} for d in (docs, docs.repartition(7)))
    assert first == again and len(first) == len(rows)
    size = {i: len(re.findall(r"[^\x20\x09-\x0D]+", t)) for i, t, _ in rows}
    sources = {s: sum(size[i] for i, _, x in rows if x == s) for s in ("a", "b", "c", None)}
    want = brute_targets(sources)
    for s, total in sources.items():
        own = [x for x in first.values() if x["source"] == s]
        assert {x["source_size"] for x in own} == {total} and own[0]["target"] == pytest.approx(want[s])
        assert abs(sum(x["taken"] for x in own) - want[s]) <= max(5, 0.002 * want[s])
    assert all(x["size"] == size[i] and x["copies"] in (0, 1, 2) and x["taken"] == x["copies"] * size[i] for i, x in first.items())


def brute_tilt(sizes, target, cap=2):
    """The dual's solution by halving: rates min(cap, exp(tilt * size / (size + mean))) that give the target."""
    mean = sum(s * n for s, n in sizes.items()) / sum(sizes.values())
    low, high = -500.0, 500.0
    for _ in range(200):
        middle = (low + high) / 2
        got = sum(s * n * min(cap, math.exp(min(50, middle * s / (s + mean)))) for s, n in sizes.items())
        low, high = (middle, high) if got < target else (low, middle)
    return low, mean


@pytest.mark.parametrize("sent", [mixing.SENT, 0])
def test_rates_solve_the_dual(spark, monkeypatch, sent):
    """Tilts equal those of an independent solver, and copies follow the rates, largest sizes first."""
    monkeypatch.setattr(mixing, "SENT", sent)
    r = random.Random(8)
    rows = [(i, " ".join(["w"] * r.choice([0, 1, 2, 9, 50, 400])), r.choice(["a", "a", "a", "b", None])) for i in range(1200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mix(docs).collect()
    strata, taken = {}, Counter()
    for x in got:
        strata.setdefault(x["source"], Counter())[x["size"]] += 1
        taken[x["source"], x["size"]] += x["copies"]
    want = brute_targets({s: sum(k * n for k, n in own.items()) for s, own in strata.items()})
    counts = spark.createDataFrame([(s, k, n) for s, own in strata.items() for k, n in own.items()], "source string, size long, n long")
    wanted = spark.createDataFrame([(s, sum(k * n for k, n in strata[s].items()), float(t)) for s, t in want.items()], "source string, source_size long, target double")
    solved = {x["source"]: x["tilt"] for x in tilts(counts, wanted).collect()}
    for s, own in strata.items():
        if want[s] >= 2 * sum(k * n for k, n in own.items()):
            assert all(taken[s, k] == 2 * n for k, n in own.items() if k)
            continue
        tilt, mean = brute_tilt(own, want[s])
        assert solved[s] == pytest.approx(tilt, abs=1e-6)
        for k, n in own.items():
            # the smallest sizes settle what rounding leaves
            if k >= 9:
                assert abs(taken[s, k] - n * min(2, math.exp(tilt * k / (k + mean)))) <= 1
    with pytest.raises(RuntimeError):
        tilts(counts, wanted, iterations=1)


def test_mix_edges(documents, empty, odd_ids, texts):
    assert mix(empty).count() == 0 and mix(documents).count() == len(texts)
    # 1.5 * (6 + 6 + 1 + 1) = 21 words: three quarters for "a", a quarter for null sources
    odd = sorted((str(x["doc_id"]), str(x["source"]), x["size"], x["taken"] <= 2 * x["size"], x["target"]) for x in mix(odd_ids).collect())
    assert odd == [("1", "None", 6, True, 5.25), ("1", "a", 1, True, 15.75), ("1", "a", 1, True, 15.75), ("None", "None", 0, True, 5.25), ("None", "a", 6, True, 15.75)]
    assert {r["taken"] for r in mix(documents.where("text = ''")).collect()} == {0}


# ---- quality rules

def brute_features(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    hit = set()
    for i in range(len(words) - 2):
        if windows[tuple(words[i : i + 3])] > 1:
            hit |= {i, i + 1, i + 2}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(hit), len(lines)


def test_features(texts):
    r = random.Random(1)
    more = ["".join(r.choice("ab \n#é") for _ in range(80)) for _ in range(200)]
    for x in [t or "" for t in texts] + more:
        assert features(x.encode()) == brute_features(x), repr(x)


def test_binomial_tail():
    for n, p in ((10, 0.3), (200, 0.05)):
        total = 0.0
        for k in range(int(n * p)):
            total += math.comb(n, k) * p**k * (1 - p) ** (n - k)
            assert binomial_tail(k, n, p) == pytest.approx(total)
    assert binomial_tail(0, 10**6, 0.05) == 0.0 or binomial_tail(0, 10**6, 0.05) < 1e-300


def test_rungs_hold_the_risk():
    """Strata whose good texts are rejected too often, or too few to tell, get no rung."""
    counts = []
    for stratum, good, bad in (("right", [(11, 500)], [(3, 80)]), ("risky", [(3, 100), (11, 400)], [(3, 80)]), ("few", [(11, 5)], [(3, 5)])):
        for holdout in (True, False):
            counts += [(stratum, holdout, True, r, n) for r, n in good] + [(stratum, holdout, False, r, n) for r, n in bad]
    got = chosen_rungs(counts)
    assert got["right"] == 3 and got["risky"] == -1 and got["few"] == -1


def test_rules(spark, documents, texts, empty, odd_ids):
    r = random.Random(4)
    rows = [(i, " ".join(f"w{r.randrange(10**6)}" + ("#$%" if i % 5 == 0 else "") for _ in range(60)), ("en", None)[i % 2]) for i in range(2000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = docs.select("doc_id", F.when(F.col("doc_id") % 5 == 0, 0).otherwise(1).alias("quality"))
    got = {x["doc_id"]: x for x in apply_rules(docs, labels).collect()}
    assert all(x["kept"] == (i % 5 != 0) and not x["base_failed"] for i, x in got.items())
    plain = {x["doc_id"]: x for x in apply_rules(documents, labels.where("false")).collect()}
    for i, x in enumerate(texts):
        f = brute_features(x or "")
        failed = f[0] < 50 or 100 * f[4] > 50 * f[0]
        assert tuple(plain[i][k] for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) == f[:5]
        assert plain[i]["base_failed"] == failed and plain[i]["kept"] == (not failed)
    assert apply_rules(empty, labels).count() == 0 and apply_rules(odd_ids, labels).count() == 5


# ---- language model

def brute_model(texts):
    """Interpolated modified Kneser-Ney by definition: ln p(word | context)."""
    order = K.ORDER
    counts = {order: Counter()}
    for t in texts:
        s = ("<s>",) * (order - 1) + tuple(t) + ("</s>",)
        for i in range(order - 1, len(s)):
            counts[order][s[i - order + 1 : i + 1]] += 1
    for m in range(order - 1, 0, -1):
        counts[m] = Counter(g[1:] for g in counts[m + 1])
    d = {}
    for m, c in counts.items():
        n = [sum(1 for v in c.values() if v == k) for k in range(1, 5)]
        y = n[0] / (n[0] + 2 * n[1]) if n[0] else 0.5
        own = [k - (k + 1) * y * n[k] / n[k - 1] if n[k - 1] else k / 2 for k in (1, 2, 3)]
        d[m] = [min(max(x, 0.05), k - 0.05) for k, x in enumerate(own, 1)]
    after = {m: {} for m in counts}
    for m, c in counts.items():
        for g, v in c.items():
            after[m].setdefault(g[:-1], []).append(v)

    def p(context, word):
        m = len(context) + 1
        below = p(context[1:], word) if m > 1 else 1 / (len(counts[1]) + 1)
        if context not in after[m]:
            return below
        own = after[m][context]
        gamma = sum(d[m][min(v, 3) - 1] for v in own) / sum(own)
        v = counts[m].get((*context, word), 0)
        return (v - d[m][min(v, 3) - 1]) / sum(own) + gamma * below if v else gamma * below

    return p


@pytest.mark.parametrize("table", [1 << 17, 20, 0])
def test_perplexities(spark, table):
    """Also where most of the model, or all of it, lies beyond the broadcast table."""
    r = random.Random(6)
    make = lambda words: " ".join(r.choice(words) for _ in range(r.randint(1, 60)))
    vocabulary = ["a", "a", "a", "B", "b", "cé", "dd", "the", "the", *(f"w{i}" for i in range(20))]
    trusted = [make(vocabulary) for _ in range(30)]
    scored = [*trusted[:5], *(make(vocabulary + ["never", "seen", "A"]) for _ in range(15)), "only unknown words", None, "", " \n"]
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(scored)], "doc_id long, text string, lang string").withColumn("text", F.coalesce("text", F.lit("")))
    got = {x["doc_id"]: x["perplexity"] for x in K.perplexities(docs.repartition(3), spark.createDataFrame([(t,) for t in trusted], "text string"), table).collect()}
    p = brute_model([t.split() for t in trusted])
    for i, t in enumerate(scored):
        if not (t or "").split():
            assert got[i] is None
            continue
        s = ("<s>",) * (K.ORDER - 1) + tuple(t.split()) + ("</s>",)
        total = sum(math.log(p(s[j - K.ORDER + 1 : j], s[j])) for j in range(K.ORDER - 1, len(s)))
        assert got[i] == pytest.approx(math.exp(-total / (len(t.split()) + 1)), rel=1e-3)


def test_quality(documents, empty, odd_ids, spark, texts):
    """Thresholds are quantiles of trusted texts that the model was not fitted on."""
    labels = spark.createDataFrame([(i, 1) for i in range(80)] + [(0, 0), (None, 1), (1, None)], "doc_id long, quality long")
    rows = K.rate(documents, labels, quantile=0.8)
    rows = rows.withColumn("training", K._in_training()).collect()
    got = {x["doc_id"]: x for x in rows}
    assert len(rows) == len(got) == len(texts)
    held = [x for i, x in got.items() if 1 <= i < 80 and not x["training"] and x["perplexity"] is not None]
    for x in rows:
        own = sorted(y["perplexity"] for y in held if y["lang"] == x["lang"])
        assert x["threshold"] == own[math.ceil(0.8 * len(own)) - 1]
        assert x["kept"] == (x["perplexity"] is not None and x["perplexity"] <= x["threshold"])
    assert {x["kept"] for x in rows} == {True, False} and got[[i for i, x in enumerate(texts) if x is None][0]]["perplexity"] is None
    assert K.rate(empty, labels).count() == 0
    odd = sorted((str(x["doc_id"]), x["n_words"], x["kept"]) for x in K.rate(odd_ids, labels.where("false")).collect())
    assert odd == [("1", 1, True), ("1", 1, True), ("1", 6, True), ("None", 0, False), ("None", 6, True)]


def test_table():
    r = np.random.default_rng(1)
    keys = np.unique(r.integers(0, 1 << 60, 5000))
    t = Table(keys, np.arange(len(keys), dtype=np.int32), -1)
    assert t.get(keys).tolist() == list(range(len(keys))) and (t.get(keys + 1)[~np.isin(keys + 1, keys)] == -1).all()
