"""Patterns against the shell's own expansion, as Python's glob module has it, over a real tree."""

import glob
import os
import random

from palisade.operators.globs import BRACES, NAMED_CLASS, compiled, expanded

NAMES = ("a", "ab", "b.txt", ".env", ".env.local", "[x]", "c d", "a*b", "é", "x{1,2}", "q?")


def tree(folder):
    r = random.Random(3)
    for d in ("", "one", "one/two", ".hid", "one/.hid/in", "o-e"):
        os.makedirs(f"{folder}/{d}", exist_ok=True)
        for name in r.sample(NAMES, 7):
            with open(f"{folder}/{d}/{name}", "w"):
                pass


PATTERNS = ("*", "*/*", "o?e/*", "one/*/*", ".*", "one/.[a-z]*", "[!a]*", "[^a]*", "[ab]*", "?", "a*", "*.txt", "one/two/?b", "[[]x]", "a[*]b", "*/.env", "c d", "q[?]", "**", "*/[a-", "é", "x{1,2}", "one/tw[o]/*", "**/ab")


def test_matches_are_the_shells(spark, tmp_path):
    tree(tmp_path)
    paths = [f"{d}/{x}" for d, _, files in os.walk(tmp_path) for x in files]
    asked = spark.createDataFrame([(p, f"{tmp_path}/{p}") for p in PATTERNS if p != "x{1,2}"], "name string, pattern string").repartition(3)
    inventory = spark.createDataFrame([(p,) for p in paths + paths[:5]], "path string")
    found, refused = expanded(asked, "name", "pattern", inventory)
    got = {}
    for r in found.collect():
        got.setdefault(r["name"], set()).add(r["path"])
    assert refused.count() == 0
    for p in PATTERNS:
        if p == "x{1,2}":
            continue
        want = {x for x in glob.glob(f"{glob.escape(str(tmp_path))}/{p.replace('[^', '[!')}") if os.path.isfile(x)}  # which knows no ^
        want |= {f"{tmp_path}/{p}"} & set(paths)  # what is there by that very name
        assert got.get(p, set()) == want, p


def test_deep_patterns(spark, tmp_path):
    tree(tmp_path)
    paths = [f"{d}/{x}" for d, _, files in os.walk(tmp_path) for x in files]
    asked = spark.createDataFrame([(p, f"{tmp_path}/{p}") for p in ("**/*", "**/a*", "one/**/?b")], "name string, pattern string")
    found, _ = expanded(asked, "name", "pattern", spark.createDataFrame([(p,) for p in paths], "path string"), deep=True)
    for p in ("**/*", "**/a*", "one/**/?b"):
        want = {x for x in glob.glob(f"{glob.escape(str(tmp_path))}/{p}", recursive=True) if os.path.isfile(x)}
        assert {r["path"] for r in found.where(f"name = '{p}'").collect()} == want, p


def test_what_is_refused(spark):
    asked = spark.createDataFrame([(0, "a/{b,c}"), (1, "a/[[:alpha:]]"), (2, "a/{b}"), (3, None), (4, "{1..3}")], "k long, p string")
    found, refused = expanded(asked, "k", "p", spark.createDataFrame([("a/{b}",), ("a/b",), (None,)], "path string"))
    assert sorted(map(tuple, refused.collect())) == [(0, BRACES), (1, NAMED_CLASS), (4, BRACES)] and [tuple(r) for r in found.collect()] == [(2, "a/{b}")]


def test_prefix_and_depth():
    assert compiled("/home/u/*.txt")[:2] == ("/home/u", 3) and compiled("*")[:2] == ("", 0) and compiled("a/b*/c")[:2] == ("a", 2)
    assert compiled("/a/**/b", deep=True)[:2] == ("/a", None) and compiled(r"a\*/b")[3] == "a*/b"
