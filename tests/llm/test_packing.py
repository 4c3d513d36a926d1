import math
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from palisade.llm.packing import best_fit, cost_balanced, pack_best_fit, pack_cost_balanced, unpacked, write_packed
from palisade.llm.tokens import Encoder

PATH = public_tokenizers.path("byte_bpe_50k.json")


def library(text):
    return Tokenizer.from_file(PATH).encode(text or "", add_special_tokens=False).ids


def test_encoder_is_the_library():
    r, tok, own = random.Random(2), Tokenizer.from_file(PATH), Encoder(PATH)
    parts = list("ab cd '\n\t\r  \x0b\x85\xa0 ​é́İ1٣\x1c$﻿") + ["<|endoftext|>", "'s", "  ", "日本"]
    for _ in range(2000):
        x = "".join(r.choice(parts) for _ in range(r.randint(0, 14)))
        assert own(x).tolist() == tok.encode(x, add_special_tokens=False).ids, repr(x)


@pytest.mark.parametrize("seed", range(20))
def test_best_fit(seed):
    r = random.Random(seed)
    lengths = [r.choice([0, 1, 3, 7, 16, 40]) for _ in range(r.randint(0, 40))]
    bins = best_fit(lengths, 16)
    assert all(sum(n for *_, n in b) <= 16 for b in bins)
    got = sorted((d, at, n) for b in bins for d, at, n in b)
    assert got == sorted((d, at, min(16, n - at)) for d, n in enumerate(lengths) for at in range(0, n, 16))
    # the plain rule: each piece, longest first, into the fullest bin that holds it
    rooms = []
    for n in sorted((n for *_, n in got), reverse=True):
        fit = [x for x in rooms if x >= n]
        best = min(fit) if fit else 16
        if fit:
            rooms.remove(best)
        rooms.append(best - n)
    assert sorted(16 - sum(n for *_, n in b) for b in bins) == sorted(rooms)


def brute_balanced(lengths, capacity, quadratic, slack):
    """The rule itself: whole bins of overlong documents; the others from the longest on, then the overlong ones'
    rests, each to the cheapest bin with room, else cut over the roomiest."""
    n_bins = math.ceil(sum(lengths) * (1 + slack) / capacity)
    full = [(d, at, capacity) for d, n in enumerate(lengths) if n > capacity for at in range(0, n - capacity + 1, capacity)]
    bins = [[] for _ in range(n_bins - len(full))]
    items = sorted((-n, d, 0) for d, n in enumerate(lengths) if n <= capacity)
    items += sorted((-(n % capacity), d, n - n % capacity) for d, n in enumerate(lengths) if n > capacity and n % capacity)
    room = lambda b: capacity - sum(n for *_, n in b)
    cost = lambda b: sum(n + quadratic * n * n for *_, n in b)
    for n, d, at in items:
        n = -n
        while n:
            fit = [b for b in bins if room(b) >= n] or [b for b in bins if room(b) == max(map(room, bins))]
            best = min(fit, key=cost)
            part = min(n, room(best))
            best.append((d, at, part))
            n, at = n - part, at + part
    return sorted([[x] for x in full] + [b for b in bins if b])


@pytest.mark.parametrize("seed", range(30))
def test_cost_balanced(seed):
    r = random.Random(seed)
    lengths = [r.choice([1, 3, 7, 16, 40]) for _ in range(r.randint(1, 40))]
    slack = r.choice([0.0, 0.02, 0.2])
    bins = cost_balanced(lengths, 16, 1.0, 1 / 16, slack)
    assert sorted(bins) == brute_balanced(lengths, 16, 1 / 16, slack)
    assert len(bins) <= math.ceil(sum(lengths) * (1 + slack) / 16) and all(0 < sum(n for *_, n in b) <= 16 for b in bins)
    covered = {d: [] for d in range(len(lengths))}
    for b in bins:
        for d, at, n in b:
            covered[d] += range(at, at + n)
    assert all(sorted(x) == list(range(lengths[d])) for d, x in covered.items())


def test_documents_that_fit_stay_whole():
    r = random.Random(3)
    lengths = [min(20_000, int(r.lognormvariate(6.4, 1.1)) + 1) for _ in range(1500)]
    bins = cost_balanced(lengths, 1024, 1.0, 1 / 1024, 0.01)
    pieces = Counter(d for b in bins for d, *_ in b)
    fit = [d for d, n in enumerate(lengths) if n <= 1024]
    assert sum(pieces[d] > 1 for d in fit) < 0.03 * len(fit) and len(bins) * 1024 < 1.02 * sum(lengths)


def test_pieces(documents, texts):
    rows = pack_cost_balanced(documents, PATH, capacity=64).collect()
    by = {}
    for r in rows:
        by.setdefault(r["doc_id"], []).append(r)
    assert set(by) == set(range(len(texts)))
    for i, own in by.items():
        own.sort(key=lambda r: r["start"])
        ids = np.concatenate([np.frombuffer(r["ids"], "<u4") for r in own]).tolist()
        assert ids == library(texts[i]) + [0]
        assert [r["start"] for r in own] == np.cumsum([0, *(r["length"] for r in own)])[:-1].tolist() and own[0]["doc_tokens"] == len(ids)
    sequences = {}
    for r in rows:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for own in sequences.values():
        assert [a for a, _ in sorted(own)] == np.cumsum([0, *(n for _, n in sorted(own))])[:-1].tolist() and sum(n for _, n in own) <= 64
    assert 64 * len(sequences) < 1.1 * sum(r["length"] for r in rows)


def test_sequences_round_trip(documents, texts, tmp_path, spark):
    packed = pack_best_fit(documents, PATH, capacity=64)
    write_packed(packed, str(tmp_path / "p"))
    read = spark.read.parquet(str(tmp_path / "p"))
    by = {}
    for r in unpacked(read).collect():
        by.setdefault(r["doc_id"], []).append((r["start"], np.frombuffer(r["ids"], "<u4").tolist()))
    assert {i: [x for _, ids in sorted(own) for x in ids] for i, own in by.items()} == {i: library(t) + [50256] for i, t in enumerate(texts)}
    for r in read.collect():
        positions = np.frombuffer(r["position_ids"], "<u4")
        assert len(positions) == 64 and all(positions[a:b].tolist() == list(range(b - a)) for a, b in zip(r["cu_seqlens"], r["cu_seqlens"][1:], strict=False))
        assert r["cu_seqlens"][-1] == r["n_tokens"] and set(np.frombuffer(r["input_ids"], "<u4")[r["n_tokens"] :].tolist()) <= {50256}


def test_edges(empty, odd_ids):
    assert pack_cost_balanced(empty, PATH).count() == pack_best_fit(empty, PATH).count() == 0
    assert pack_cost_balanced(odd_ids, PATH).count() == 5
    assert sorted(str(x) for r in pack_best_fit(odd_ids, PATH).collect() for x in r["doc_ids"]) == ["1", "1", "1", "None", "None"]
