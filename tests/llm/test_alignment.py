import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from palisade.llm import alignment
from palisade.llm.alignment import Aligner, Block, Memory, align, bitmap, merged, opened, pair_table, popcount
from palisade.llm.tokens import _byte_of

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def whole():
    """Both tokenizers over whole texts, by the contract's words: ids with the bytes of each, or None."""
    a, b, byte_of = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B), _byte_of()
    a.encode_special_tokens = True

    def run(text):
        if not text:
            return None
        tokens_a = [(i, bytes(byte_of[c] for c in a.id_to_token(i))) for i in a.encode(" " + text, add_special_tokens=False).ids]
        tokens_b = [(i, bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()) for i in b.encode(text)]
        raw = (" " + text).encode()
        return (tokens_a, tokens_b) if b"".join(x for _, x in tokens_a) == raw == b"".join(x for _, x in tokens_b) else None

    return run


def ends(tokens):
    return np.cumsum([len(x) for _, x in tokens]).tolist()


def brute(texts, whole):
    """n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of each text."""
    parsed, counts = [whole(x) for x in texts], Counter()
    links = []
    for x in parsed:
        own = []
        if x:
            ends_a, ends_b = ends(x[0]), ends(x[1])
            own = [(x[0][i][0], x[1][j][0]) for i, e in enumerate(ends_a) for j in range(min(e, len(ends_b))) if ends_b[j] == e]
        links.append(own)
        counts.update(own)
    best = {}
    for (_, b), n in counts.items():
        best[b] = max(best.get(b, 0), n)
    rows = []
    for x, own in zip(parsed, links):
        if not x:
            rows.append((0, 0, 0, 0, 0, 0, ""))
            continue
        ends_a, ends_b = ends(x[0]), ends(x[1])
        groups, lo = [], 0
        for e in sorted(set(ends_a) & set(ends_b)):
            one = [",".join(str(i) for (i, _), end in zip(t, at) if lo < end <= e) for t, at in ((x[0], ends_a), (x[1], ends_b))]
            groups.append("|".join(one))
            lo = e
        rows.append((len(x[0]), len(x[1]), len(groups), len(own), sum(counts[p] == best[p[1]] for p in own), sum(counts[p] for p in own), hashlib.sha256(";".join(groups).encode()).hexdigest()))
    return rows, counts, links


NAMES = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


@pytest.mark.parametrize("sent,postings", [(1 << 16, 1 << 21), (5, 300)])
def test_equals_brute_force(documents, texts, whole, monkeypatch, sent, postings):
    monkeypatch.setattr(alignment, "SENT", sent)
    monkeypatch.setattr(alignment, "POSTINGS", postings)
    got = {r["doc_id"]: tuple(r[x] for x in NAMES) for r in align(documents, A, B).collect()}
    want, _, _ = brute(texts, whole)
    assert len(got) == len(texts)
    for i, x in enumerate(texts):
        assert got[i] == want[i], repr(x)


def test_pair_table(documents, texts, whole):
    _, counts, links = brute(texts, whole)
    docs = Counter(p for own in links for p in set(own))
    got = {(r["id_a"], r["id_b"]): (r["n_docs"], r["n_links"]) for r in pair_table(documents, A, B).collect()}
    assert got == {p: (docs[p], n) for p, n in counts.items()}


def test_odd_rows(empty, odd_ids, whole):
    assert align(empty, A, B).count() == 0
    rows = odd_ids.collect()
    want, _, _ = brute([r["text"] for r in rows], whole)
    assert sorted(map(repr, [(r["doc_id"], *w) for r, w in zip(rows, want)])) == sorted(repr((r["doc_id"], *(r[x] for x in NAMES))) for r in align(odd_ids, A, B).collect())


def test_chunks_encode_as_whole_texts(whole, monkeypatch):
    monkeypatch.setattr(alignment, "CHUNKS", 500)  # entries go and come again
    r, know = random.Random(4), Memory(Aligner(A, B))
    parts = list("ab Cd '\n\t  \x0b\x85\xa0​▁é́İΣςß1٣\x1c$﻿") + ["'ll", "!!", "日本", "<|endoftext|>", "</s>", "<unk>", "<0x0A>", "\n\n", " \n", " the", " of\n", "foo. ", "bar,", "é.", "².", "_.", "\nfoo"]
    for _ in range(6000):
        text = "".join(r.choice(parts) for _ in range(r.randint(1, 16)))
        found, want = know.text(text), whole(text)
        if want is None:
            assert found is None, repr(text)
        else:
            spelled = b";".join(x[0] for x in found).decode()
            ids = [[int(i) for g in spelled.split(";") for i in g.split("|")[k].split(",")] for k in (0, 1)]
            assert ids == [[i for i, _ in t] for t in want], repr(text)


def test_bitmaps_and_planes():
    r = random.Random(2)
    for size in (1, 9, 100, 5000, 1 << 16):
        for n in {0, 1, size // 40, size // 3, size}:
            own = np.array(sorted(r.sample(range(size), n)), np.int64)
            bits = bitmap(own, size)
            assert opened(bits).tolist() == own.tolist() and popcount(bits) == n and len(bits) <= 2 + max(1, size / 8)
    block, want = Block(3), Counter()
    for d in range(300):
        pairs = np.array(sorted(r.sample(range(40), r.randint(0, 12))), np.int64)
        times = np.array([r.choice([1, 2, 3, 900]) for _ in pairs], np.int64)
        block.add(pairs, times)
        want.update({(int(p), d): int(t) for p, t in zip(pairs, times)})
    got = Counter()
    for pair, planes in block.planes():
        for k, plane in enumerate(planes):
            got.update({(pair, int(d)): 1 << k for d in opened(plane)})
        union = {d for p, d in want if p == pair}
        assert opened(merged(planes)).tolist() == sorted(union) and popcount(merged(planes)) == len(union)
    assert got == want


def test_texts_of_megabytes(spark, whole):
    texts = ["word and, another. " * 100_000, "x" * 400_000, "é\n" * 200_000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r for r in align(df, A, B).collect()}
    for i, x in enumerate(texts):
        a, b = whole(x)
        assert (got[i]["n_a"], got[i]["n_b"]) == (len(a), len(b)) and got[i]["n_links"] == len(set(ends(a)) & set(ends(b)))
