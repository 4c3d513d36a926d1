"""Queries over small tables made here, as the shipped ones hold few odd rows."""

import random

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import functions as F

from palisade.functions import text
from palisade.operators import rule_documents, scan
from palisade.plans.rules import BY_ID
from palisade.queries import ORACLES, QUERIES, spread


def same(spark, folder, name, **tables):
    """A query's rows, once they are found to be those of its SQL."""
    con = duckdb.connect()
    for table, columns in tables.items():
        pq.write_table(pa.table(columns), f"{folder}/{table}.parquet")
        con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    got = QUERIES[name](spark, str(folder))
    want = con.sql(f"SELECT {', '.join(map('\"{}\"'.format, got.columns))} FROM ({ORACLES[name]})").fetchall()
    rows = list(map(tuple, got.collect()))
    assert sorted(map(str, rows)) == sorted(map(str, want))
    return rows


def test_card_stages_beyond_ascii(spark, tmp_path):
    r = random.Random(5)
    words = ["é", "身份", "card", "pan", "cc", "_", " ", " ", "4111 1111 1111 1111", "4242-4242-4242-4241", "1234567890123456", "\n", "K", "İ", "9", "credit card", "CARD", "x", "\U0001f600", "...."]
    texts = [None, "", *("".join(r.choice(words) for _ in range(r.randint(1, 40))) for _ in range(400))]
    rows = same(spark, tmp_path, "card_stages", documents={"doc_id": list(range(len(texts))), "text": texts})
    assert {x[4] for x in rows} == {True, False}


def tasks_of(spark, df):
    """Tasks that give rows of a table."""
    return df.select(F.spark_partition_id()).distinct().count()


def test_short_rows_of_one_file_go_to_several_tasks(spark, tmp_path):
    n = 400_000
    pq.write_table(pa.table({"k": [x * 7919 % (1 << 40) for x in range(n)]}), f"{tmp_path}/short.parquet")
    given = spark.read.parquet(f"{tmp_path}/short.parquet")
    assert tasks_of(spark, given) == 1 and tasks_of(spark, spread(given, "k")) > 1


def test_equal_documents_are_checked_once(spark):
    text = '{"rules": []}'
    rule_documents._known.cache_clear()
    for x in (text, None, text, "{", text, None):
        assert rule_documents._known(rule_documents.problems_of, x) == rule_documents.problems_of(x)
    assert rule_documents._known.cache_info().misses == 3
    got = rule_documents.problems(spark.createDataFrame([(i, text) for i in range(20)] + [(20, None), (21, text + " " * rule_documents.SHORT)], "id int, text string"), "id", "text")
    assert sorted(r["id"] for r in got.collect()) == list(range(22))


def test_batches_of_a_scan_are_small(spark):
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    was = spark.conf.get(name)
    try:
        spark.conf.set(name, "268435456")
        docs = spark.createDataFrame([(1, "8.8.8.8".encode("utf-16"))], "id int, content binary")
        found, _ = scan.scan_content(docs, "id", "content", [BY_ID["ipv4-public"]])
        assert int(spark.conf.get(name)) == text.BATCH and [r["offset"] for r in found.collect()] == [2]
        spark.conf.set(name, "1000")
        assert text.small_batches(docs) is docs and spark.conf.get(name) == "1000"
    finally:
        spark.conf.set(name, was)


def test_clean_names_do_not_go_through_the_rules(spark):
    names = [None, "", "notes.txt", "a_b", "ssn_212-09-1234.txt", "x\x07", "ghp_0123456789abcdefghijklmnopqrstuvwxyz", "ghp_0123456789abcdefghijklmnopqrstuvwxyz\n"]
    shown = spark.createDataFrame(list(enumerate(names)), "i int, name string").select("i", scan.withheld(F.col("name")).alias("shown"))
    assert [r["shown"] for r in shown.orderBy("i").collect()] == [None, "", "notes.txt", "a_b", *[scan.WITHHELD] * 4]
    assert "UDF" in shown._jdf.queryExecution().toString() and "rlike" in shown._jdf.queryExecution().toString().lower().split("arrowevalpython")[-1]
