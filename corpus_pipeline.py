"""From raw documents to token ids: five stages, each over all that the one before kept.

Every stage takes (spark, docs, folder of the tables) and returns a DataFrame; all but
the last return the columns of ``docs``, whatever else these hold. ``run`` writes the
result of each into the shared folder and reads it back for the next.

Null or empty texts pass: they are not toxic, nobody's copy, hold no passage and no
words to mix, and encode to nothing. An empty table gives an empty table.
"""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from patronage.llm import bpe, minhash, mixing, suffixes, toxicity
from patronage.llm.common import fresh, held_out, read, staged
from patronage.llm.queries import ship, vocabulary_path
from patronage.operators.ranking import global_row_number


def without_toxic(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Documents scored below the threshold; learnt from labels of rows that are not held out."""
    ship(spark)
    training = docs.select("doc_id", "text").filter(~held_out("doc_id"))
    model = toxicity.fit(training, "doc_id", "text", read(spark, folder, "labels", "doc_id", "toxic"), "doc_id", "toxic")
    return docs.filter(toxicity.score(F.col("text"), model) < toxicity.THRESHOLD)


class Keyed(NamedTuple):
    """Rows with a key of their own, and what it was made from."""

    rows: DataFrame
    texts: DataFrame  # doc_id, key, by_id (the key is the id), rows: one row per key


def keyed(docs: DataFrame, key: str) -> Keyed:
    """``docs`` with a key per id, or per id and text where an id has several texts or is missing.

    Rows alike in id and text share their key.
    """
    digest, flag, rows = fresh("digest"), fresh("flag"), fresh("rows")
    named = docs.withColumn(digest, F.xxhash64("text"))
    texts = staged(named.groupBy("doc_id", digest).agg(F.count("*").alias(rows)), "texts")
    several = staged(texts.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(F.count("*").alias(flag))
                     .filter(F.col(flag) > 1).select("doc_id", F.lit(True).alias(flag)), "several")
    by_id = F.col("doc_id").isNotNull() & F.col(flag).isNull()
    own = F.when(by_id, F.col("doc_id").cast("long")).otherwise(F.xxhash64("doc_id", digest)).alias(key)
    return Keyed(named.join(several, "doc_id", "left").select(*docs.columns, own),
                 texts.join(several, "doc_id", "left").select("doc_id", own, by_id.alias("by_id"),
                                                              F.col(rows).alias("rows")))


def without_near_duplicates(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """The document with the smallest id of every group; rows without an id all stay.

    Rows of one id with other texts are documents of their own; of those alike one stays.
    """
    ship(spark)
    key, own_id = fresh("key"), fresh("own_id")
    all_rows, texts = keyed(docs.filter(F.col("doc_id").isNotNull()), key)
    found = staged(minhash.near_duplicates(all_rows, key, "text").select(
        F.col("doc_id").alias(key), "component_id", "kept"), "found")

    # groups with a key that is no id are told by the ids of their rows
    others = staged(texts.filter(~F.col("by_id")).select(key, F.col("doc_id").cast("long").alias(own_id)), "others")
    mixed = staged(found.join(others, key, "left_semi").select("component_id").distinct(), "mixed")
    least = F.min(F.struct(F.coalesce(own_id, key).alias(own_id), F.col(key))).alias("_least")
    first = (found.join(mixed, "component_id").join(others, key, "left").groupBy("component_id").agg(least)
             .select(F.col("_least").getField(key).alias(key)))
    kept = staged(found.filter("kept").join(mixed, "component_id", "left_anti").select(key).distinct().union(first), "kept")
    # those that go are the fewer
    gone = staged(found.select(key).distinct().join(kept, key, "left_anti"), "gone")

    copies = staged(texts.filter("rows > 1").select(key), "copies")
    left = all_rows.join(gone, key, "left_anti")
    once = (left.join(copies, key, "left_semi").groupBy(key).agg(F.first(F.struct(*docs.columns)).alias("_row"))
            .select("_row.*"))
    return (left.join(copies, key, "left_anti").select(*docs.columns).unionByName(once)
            .unionByName(docs.filter(F.col("doc_id").isNull())))


def without_repeated_passages(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Texts less the passages that stand in an earlier document or further up; texts left without a word go.

    Rows of one id with other texts, and rows without an id, are documents of their own;
    rows alike in id and text are one, cut alike. ``n_chars`` is kept right.
    """
    ship(spark)
    key, spans = fresh("key"), fresh("spans")
    all_rows = keyed(docs, key).rows
    found = (suffixes.repeated_spans(all_rows, key, "text").groupBy("doc_id")
             .agg(F.collect_list(F.struct("start_word", "n_words")).alias(spans)).withColumnRenamed("doc_id", key))
    text = suffixes.cut(F.col("text"), F.col(spans))
    cut = all_rows.join(found, key, "left").withColumn("text", text)
    cut = cut.filter(F.col(spans).isNull() | F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        length = F.when(F.col(spans).isNull(), F.col("n_chars")).otherwise(F.length("text").cast(kind))
        cut = cut.withColumn("n_chars", length)
    return cut.select(*docs.columns)


def mixed_sources(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Every document as often as the mix of sources takes it."""
    ship(spark)
    size, copies, rows, read_ = fresh("size"), fresh("copies"), fresh("rows"), fresh("read")
    sized = docs.withColumn(size, mixing.word_count(F.col("text")))
    taken = staged(mixing.mixed(docs, "doc_id", "source", mixing.word_count(F.col("text")))
                   .groupBy("doc_id", "source", "size").agg(F.sum("copies").alias(copies), F.count("*").alias(rows)),
                   "taken")
    same = (F.col("d.doc_id").eqNullSafe(F.col("t.doc_id")) & F.col("d.source").eqNullSafe(F.col("t.source"))
            & (F.col(f"d.{size}") == F.col("t.size")))

    def counted(groups: DataFrame) -> DataFrame:
        """The documents of some groups, with the copies taken of the group and its number of rows."""
        return sized.alias("d").join(groups.alias("t"), same).select("d.*", f"t.{copies}", f"t.{rows}")

    single = counted(taken.filter((F.col(copies) > 0) & (F.col(rows) == 1)))
    # rows alike in id, source and size share the copies they are taken together: numbered in sorted runs, as any
    # number of rows may be alike, down to where they were read. Few groups have several rows; they are stored, so
    # that Spark knows how few before it moves the documents
    alike = staged(taken.filter((F.col(copies) > 0) & (F.col(rows) > 1)), "alike")
    several = staged(counted(alike).withColumn(read_, F.monotonically_increasing_id()), "several")
    group = ["doc_id", "source", size]
    numbered = global_row_number(several, [*group, F.xxhash64("text"), read_], "_number").alias("n")
    begins = staged(numbered.groupBy(*group).agg(F.min("_number").alias("_begin")), "begins").alias("b")
    match = reduce(lambda one, other: one & other, [F.col(f"n.`{name}`").eqNullSafe(F.col(f"b.`{name}`")) for name in group])
    place = F.col("_number") - F.col("_begin")
    own = F.floor(F.col(copies) / F.col(rows)) + (place < F.col(copies) % F.col(rows)).cast("long")
    shared = numbered.join(begins, match).select(*[F.col(f"n.`{name}`") for name in docs.columns], own.alias(copies))
    taking = single.select(*docs.columns, copies).unionByName(shared)
    return mixing.emitted(taking, F.col(copies)).select(*docs.columns)


def encoded(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """doc_id, source, n_tokens, the ids of every text, and the text they decode to."""
    ship(spark)
    ids = bpe.round_trip(docs, "text", vocabulary_path(), ["doc_id", "source"])
    return ids.select("doc_id", "source", F.size("ids").cast("long").alias("n_tokens"), "ids", "decoded")


STAGES = [
    ("toxicity", without_toxic),
    ("near_duplicates", without_near_duplicates),
    ("repeated_passages", without_repeated_passages),
    ("mixing", mixed_sources),
    ("encoding", encoded),
]

#: What the first stage rejects is learnt, which SQL cannot express; tests hold every stage against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, folder: str) -> DataFrame:
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, folder), name)
    return STAGES[-1][1](spark, docs, folder)
