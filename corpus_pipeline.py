"""A corpus made ready for training: five operators of palisade.llm in a row over `documents`."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from palisade.llm.common import likely, stored, table
from palisade.llm.jaccard_join import join_similar
from palisade.llm.language_id import held_out, keep_identified, train
from palisade.llm.mixing import mix
from palisade.llm.packing import pack_cost_balanced
from palisade.llm.queries import tokenizer_path
from palisade.llm.suffix_dedup import cut_repeats

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of no known language go: null and empty texts, texts without a letter, and those that two languages
    explain equally well. Models are trained on the documents given, but for the held-out quarter of their ids; where
    none has a language, all rows stay. Repeated rows and null ids are rows like others; an empty table stays empty,
    and columns beyond those of documents go."""
    return keep_identified(docs.select(*COLUMNS), train(docs.where(~held_out())))


def row_key() -> Column:
    """What tells rows apart where ids are null or repeated: the id (null last), then 64-bit hashes of the text and
    of the rest. It depends on the row alone, so it can be made anew; rows that share it are equal."""
    rest = (x for c in COLUMNS[2:] for x in (F.col(c), F.col(c).isNull()))
    return F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", F.xxhash64("text").alias("text"), F.xxhash64(*rest).alias("rest"))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents one row stays: the first by row_key, so the one with the smallest id, and one
    with an id before those without. Of equal rows one stays. Null texts and texts without a word link with nothing:
    all stay. An id that two texts share tells nothing: rows are judged each on their own. Whole texts count, however
    long."""
    docs = docs.select(*COLUMNS).withColumn("row", row_key())
    found = join_similar(docs, id_col="row").withColumn("gone", F.expr("doc_id <> component_id"))
    found = found.groupBy(F.col("doc_id").alias("key"), "gone", F.expr("n_shingles > 0").alias("linked")).agg(F.count("*").alias("n"))
    listed = stored(found.where("gone OR (linked AND n > 1)").select("key", "gone"))
    marked = likely(docs, "row", listed.select("key"), rest=True)
    doubtful = marked.where("likely")
    unlisted = doubtful.join(listed, F.col("row") == F.col("key"), "left_anti")
    repeated = doubtful.join(listed.where("NOT gone"), F.col("row") == F.col("key"), "left_semi").select(*COLUMNS).distinct()
    return marked.where("NOT likely").unionByName(unlisted).select(*COLUMNS).unionByName(repeated)


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated strings of 200 bytes go from the texts; a character that loses some of its bytes goes whole. Each row
    stays, null texts as empty ones, and n_chars is counted anew."""
    cut = cut_repeats(docs, carry=("lang", "source"), as_text=True).withColumnRenamed("kept", "text")
    return cut.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row comes as often as the mix takes it, not at all up to twice; equal rows divide what the mix takes of them
    all. Texts without a word, and null ones, are taken no times. Null sources are a source of their own; a source's
    words come near its target whatever ids are null or repeated."""
    docs = docs.select(*COLUMNS).withColumn("row", row_key())
    copies = mix(docs, id_col="row").groupBy(F.col("doc_id").alias("key")).agg(F.sum("copies").alias("copies"), F.count("*").alias("n"))
    taken = docs.join(copies.where("copies > 0"), F.col("row") == F.col("key"))
    taken = taken.withColumn("nth", F.row_number().over(Window.partitionBy("row").orderBy("row")))
    taken = taken.withColumn("own", F.expr("cast(copies div n + if(nth <= copies % n, 1, 0) as int)")).where("own > 0")
    return taken.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("own")))).select(*COLUMNS)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each piece of a document in a sequence of 1024 tokens at most; every row's tokens, and an end, lie in
    pieces once, copies' too. Null and empty texts are the end alone; an empty table packs nothing."""
    pieces = pack_cost_balanced(docs, tokenizer_path("byte_bpe_50k.json"))
    return pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids")


STAGES = [
    ("language", language),
    ("near_copies", near_copies),
    ("repeats", repeats),
    ("mixture", mixture),
    ("packed", packed),
]

#: Trained models, token ids and Newton iterations are beyond SQL: the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
