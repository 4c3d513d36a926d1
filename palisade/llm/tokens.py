"""Token ids by public tokenizer files, as the tokenizers library gives them."""

from __future__ import annotations

import json
import re
from functools import cached_property, lru_cache

import numpy as np

#: The pre-tokenizer of byte-level files (fixed value, as their library defines it).
BYTE_LEVEL = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Characters that are white space to one regular expression engine and not to another.
DOUBTFUL = re.compile("[\x1c-\x1f]")


def tokenizer(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def special_strings(tok) -> tuple[str, ...]:
    return tuple(x.content for x in tok.get_added_tokens_decoder().values())


def _byte_of() -> dict[str, int]:
    """The printable character that stands for each byte in byte-level vocabularies -> that byte."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


def specified(path: str) -> dict:
    with open(path, encoding="utf-8") as file:
        return json.load(file)


def _ranked(spec: dict):
    """A file's vocabulary for the faster library, or None where the file isn't plain byte-level BPE."""
    import tiktoken

    model, pre = spec["model"], spec.get("pre_tokenizer") or {}
    plain = model["type"] == "BPE" and not spec.get("normalizer") and not model.get("end_of_word_suffix")
    if not (plain and pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space")):
        return None
    byte_of, special = _byte_of(), {x["content"] for x in spec["added_tokens"]}
    ranks = {bytes(byte_of[c] for c in k): i for k, i in model["vocab"].items() if k not in special}
    return tiktoken.Encoding("own", pat_str=BYTE_LEVEL, mergeable_ranks=ranks, special_tokens={})


class Encoder:
    """Ids of whole texts, without begin, end or added special tokens.

    Plain byte-level files run on the faster of the two libraries; texts with special strings or
    characters that the two class differently go to the file's own library, which is loaded for those alone."""

    def __init__(self, path: str):
        spec = specified(path)
        self.path, self.ranked = path, _ranked(spec)
        self.special = tuple(x["content"] for x in spec.get("added_tokens") or ())

    @cached_property
    def tok(self):
        return tokenizer(self.path)

    def __call__(self, text: str | None) -> np.ndarray:
        if not text:
            return np.empty(0, "<u4")
        if self.ranked is None or DOUBTFUL.search(text) or any(x in text for x in self.special):
            return np.array(self.tok.encode(text, add_special_tokens=False).ids, "<u4")
        return np.array(self.ranked.encode_ordinary(text), "<u4")


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One for each worker process."""
    return Encoder(path)
