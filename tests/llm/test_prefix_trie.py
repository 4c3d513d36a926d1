import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from palisade.llm import queries
from palisade.llm.prefix_trie import conversation_trie

SCHEMA = "conv_id long, turn long, role string, text string, key string, n long, last string, copies long"


def brute(rows):
    own, nodes, kids, leaves, saved, ends = {}, {}, {}, {}, {}, {}
    for c, turn, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append(((turn is not None, turn or 0), (role or "", text or "")))
    own = {c: [x for _, x in sorted(v, key=lambda p: p[0])] for c, v in own.items()}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        whole = tuple(own.get(c - c % 100, [])[:h] + turns[h:])
        ends.setdefault(whole, []).append(c)
        for d in range(len(whole) + 1):
            nodes.setdefault(whole[:d], []).append(c)
    for k in nodes:
        if k:
            kids.setdefault(k[:-1], []).append(k)
    for k in sorted(nodes, key=len, reverse=True):
        below = kids.get(k, [])
        leaves[k] = sum(leaves[x] for x in below) or 1
        saved[k] = sum(saved[x] for x in below) + ((len(nodes[k]) - 1) * len(k[-1][1]) if k else 0)
    digest = lambda ids: hashlib.sha256(",".join(map(str, sorted(ids))).encode()).hexdigest()
    return sorted(
        (min(m), len(k), min(nodes[k[:-1]]) if k else -1, len(m), len(kids.get(k, [])), leaves[k], saved[k], digest(ends.get(k, [])))
        for k, m in nodes.items()
    )


def rows_of(df):
    return sorted(tuple(-1 if v is None else v for v in r) for r in df.collect())


@pytest.fixture(scope="module")
def conversations():
    """Hot copies, shared beginnings, missing bases, nulls, a long conversation, rows of few turns."""
    r, rows = random.Random(8), []
    for c in [*range(0, 60), *range(100, 180), *range(305, 330), 400]:
        turns = [("user", f"t{r.randint(0, 2)}") for _ in range(r.randint(1, 9))]
        if c % 3 == 0:
            turns = [("user", "same"), ("assistant", "é same"), ("user", "again"), ("user", "end"), ("user", "5"), ("user", "6"), ("user", "7")]
        rows += [(c, i, role, text) for i, (role, text) in enumerate(turns)]
    rows += [(500, i, "user", "x" * (i % 4)) for i in range(700)]
    rows += [(501, None, "user", "before all"), (501, 2, None, None), (502, 0, "", ""), (503, 0, None, ""), (None, 0, "user", "lost"), (7, -3, "user", "first")]
    return rows


@pytest.mark.parametrize("container", [1, 3, 10_000])
def test_nodes_equal_brute_force(spark, conversations, container):
    df = spark.createDataFrame([(*x, "k", 1, "l", 2) for x in conversations], SCHEMA).repartition(4)
    assert rows_of(conversation_trie(df, container)) == brute(conversations)


def test_empty_and_lost_rows(spark):
    assert conversation_trie(spark.createDataFrame([], SCHEMA)).count() == 0
    assert conversation_trie(spark.createDataFrame([(None, 1, "user", "a", "k", 1, "l", 2)], SCHEMA)).count() == 0


def test_turnless_conversations_are_members_of_the_root(spark):
    rows = [(c, 0, "user", "own") for c in range(201, 240)]  # no base, one turn of their own
    got = rows_of(conversation_trie(spark.createDataFrame([(*x, "k", 1, "l", 2) for x in rows], SCHEMA)))
    assert got == brute(rows) and got[0][3] == 39 and got[0][7] != hashlib.sha256(b"").hexdigest()


def test_equal_rows_and_ties_are_turns(spark):
    """Turns of one number and equal rows all count; which comes first depends on the rows alone."""
    rows = [(600, 1, "user", "a"), (600, 1, "user", "a"), (600, 1, "user", "b"), (604, 1, "user", "b"), (604, 1, "user", "a"), (604, 1, "user", "a")]
    df = spark.createDataFrame([(*x, "k", 1, "l", 2) for x in rows], SCHEMA)
    got = rows_of(conversation_trie(df))
    assert got == rows_of(conversation_trie(df.orderBy(F.desc("text")))) and max(x[1] for x in got) == 3
    assert [x[3] for x in got] == [2, 2, 2, 2]


def test_long_texts(spark):
    rows = [(700 + i, 0, "user", "é" * 2_000_000) for i in range(3)] + [(700 + i, 1, "user", f"{i}") for i in range(3)]
    assert rows_of(conversation_trie(spark.createDataFrame([(*x, "k", 1, "l", 2) for x in rows], SCHEMA))) == brute(rows)


def test_query_and_sql(spark, tmp_path):
    import duckdb

    path = "/root/testdata/sf0.001"
    got = queries.QUERIES["op13_prefix_trie"](spark, path)
    with duckdb.connect() as con:
        con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{path}/conversations.parquet'")
        want = con.execute(queries.ORACLES["op13_prefix_trie"])
        names = [x[0] for x in want.description]
        assert sorted(names) == sorted(got.columns)
        assert rows_of(got.select(names)) == sorted(tuple(-1 if v is None else v for v in r) for r in want.fetchall())
