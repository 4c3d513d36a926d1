import random

import pytest

#: Columns that operators don't look at, with names that they use themselves.
CLASH = "token string, key long, h long, n long, node string, size long, copies string"


def corpus(seed: int = 1, n: int = 60) -> list[str | None]:
    """Texts with copies, near copies, shared passages, repeated lines, empty, null and odd ones."""
    r = random.Random(seed)
    words = ["".join(r.choice("abcdeéß") for _ in range(r.randint(1, 7))) for _ in range(150)]
    text = lambda k: " ".join(r.choice(words) for _ in range(k))
    passage = text(60)
    base = [text(r.choice([3, 8, 40, 90])) for _ in range(n)]
    near = []
    for x in base[:20]:
        own = x.split()
        if len(own) > 10:
            own[r.randrange(len(own))] = "changed"
        near.append(" ".join(own))
    shared = [f"{text(10)} {passage} {text(5)}" for _ in range(6)]
    odd = [None, "", " \n\t", "a", "A b", "a B", "1234 !!!", "x\n" * 30, "日本語 " * 30, passage, passage + passage, "<|endoftext|> a  <|startoftext|>", "x" * 3000, "\x1c a\x85b"]
    every = base + near + shared + odd + base[:5]
    return every


@pytest.fixture(scope="session")
def texts():
    return corpus()


@pytest.fixture(scope="session")
def documents(spark, texts):
    langs = ["en", "de", None]
    rows = [(i, x, langs[i % 3], ["s1", "s0", None][i % 3], len(x or ""), "t", 1, 2, 3, "n", 4, "c") for i, x in enumerate(texts)]
    return spark.createDataFrame(rows, f"doc_id long, text string, lang string, source string, n_chars long, {CLASH}").repartition(3)


@pytest.fixture(scope="session")
def empty(documents):
    return documents.where("false")


@pytest.fixture(scope="session")
def odd_ids(spark):
    """Null and repeated ids, repeated rows."""
    rows = [(None, "one two three four five six", "en", "a", 1), (1, "one two three four five six", None, None, 1), (1, "other", "en", "a", 1), (1, "other", "en", "a", 1), (None, None, None, None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
