"""One query per operator over whole tables of a data folder."""

from __future__ import annotations

import atexit
import functools
import shutil
import tempfile
import zipfile
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from patronage.llm import bpe, gnat, langid, minhash, mixing, pages, quality, runs, simhash, suffixes, toxicity, urls, vptree
from patronage.llm.common import WORD, held_out, read

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
VOCABULARY = "byte_bpe_50k.json"
WEB_POLICY = "web.2"
BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"
#: Exact: the vectors have so little structure that leaving out more loses more than it saves.
NEAREST_FACTOR = 1.0
URL_RULES = (
    urls.UrlRule("allow", "com", "/"),
    urls.UrlRule("block", "example.com", "/en/"),
    urls.UrlRule("allow", "www.example.com", "/en/"),
    urls.UrlRule("block", "net", "/es/"),
    urls.UrlRule("block", "net", "/fr/"),
)


def query(function: Query) -> Query:
    @functools.wraps(function)
    def with_package(spark: SparkSession, folder: str) -> DataFrame:
        ship(spark)
        return function(spark, folder)

    QUERIES[function.__name__] = with_package
    return with_package


@functools.lru_cache(maxsize=8)
def _ship(application: str) -> None:
    package = Path(__file__).resolve().parent.parent
    folder = tempfile.mkdtemp()  # the driver serves the file from here until it ends
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    archive = f"{folder}/{package.name}-{application}.zip"
    with zipfile.ZipFile(archive, "w") as file:
        for source in sorted(package.rglob("*.py")):
            file.write(source, source.relative_to(package.parent))
    SparkSession.active().sparkContext.addPyFile(archive)


def ship(spark: SparkSession) -> None:
    """Give the executors this package, once per application, as ``--py-files`` would.

    Batches of rows for Python are bounded by bytes as well, unless the session says how;
    ten thousand long texts are more than a worker should hold.
    """
    _ship(spark.sparkContext.applicationId)
    if spark.conf.get(BATCH_BYTES, None) is None:
        spark.conf.set(BATCH_BYTES, "8m")


def vocabulary_path(name: str = VOCABULARY) -> str:
    """Where the executors have a vocabulary file; it is installed on all of them."""
    import public_tokenizers

    return public_tokenizers.path(name)


@query
def op1_bpe(spark: SparkSession, folder: str) -> DataFrame:
    path = vocabulary_path()
    documents = read(spark, folder, "documents", "doc_id", "text")
    return bpe.round_trip(documents, "text", path, ["doc_id"]).select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"))


@query
def op4_mixing(spark: SparkSession, folder: str) -> DataFrame:
    documents = read(spark, folder, "documents", "doc_id", "source", "text")
    return mixing.mixed(documents, "doc_id", "source", mixing.word_count(F.col("text"))).select(
        "doc_id", "size", "source_size", "target", "taken", "copies")


@query
def op6_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    entries = quality.ledger(read(spark, folder, "documents", "doc_id", "text"), "doc_id", "text")
    return entries.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        (~quality.kept(quality.POLICIES["base.1"])).alias("base_failed"),
        quality.kept(quality.POLICIES[WEB_POLICY]).alias("kept"), "failed")


@query
def op8_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    crawled = read(spark, folder, "pages", "page_id", "url")
    # a page shows the document whose number its path ends in; the label of that document is the page's outcome
    number = F.regexp_extract(urls.path_of(F.col("url")), r"/(\d{1,18})(?:\.html|/)?$", 1)
    shown = crawled.filter(number != "").select("url", number.cast("long").alias("doc_id"))
    outcomes = shown.join(read(spark, folder, "labels", "doc_id", "quality"), "doc_id").select(
        "url", (1 - F.col("quality")).alias("bad"))
    return urls.judged(crawled, "page_id", "url", outcomes, URL_RULES)


@query
def op9_minhash(spark: SparkSession, folder: str) -> DataFrame:
    return minhash.near_duplicates(read(spark, folder, "documents", "doc_id", "text"), "doc_id", "text")


@query
def op10_repeated_passages(spark: SparkSession, folder: str) -> DataFrame:
    return suffixes.repeated_spans(read(spark, folder, "documents", "doc_id", "text"), "doc_id", "text")


@query
def op3_language(spark: SparkSession, folder: str) -> DataFrame:
    documents = read(spark, folder, "documents", "doc_id", "text", "lang")
    model = langid.fit(documents.filter(~held_out("doc_id")), "text", "lang", "doc_id")
    found = documents.select("doc_id", held_out("doc_id").alias("held_out"),
                             langid.predicted(F.col("text"), model).alias("_p"))
    return found.select("doc_id", "held_out", F.col("_p.lang").alias("lang_pred"), "_p.score", "_p.rejected")


@query
def op7_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    documents = read(spark, folder, "documents", "doc_id", "text")
    labels = read(spark, folder, "labels", "doc_id", "toxic")
    model = toxicity.fit(documents.filter(~held_out("doc_id")), "doc_id", "text", labels, "doc_id", "toxic")
    scored = documents.select("doc_id", held_out("doc_id").alias("held_out"),
                              toxicity.score(F.col("text"), model).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= toxicity.THRESHOLD).cast("int"))


@query
def op2_nearest(spark: SparkSession, folder: str) -> DataFrame:
    found = vptree.nearest(read(spark, folder, "embeddings", "vec_id", "embedding"), "vec_id", "embedding",
                           F.col("vec_id") % 20 == 0, k=20, factor=NEAREST_FACTOR)
    return found.select("query_id", "rank", F.col("id").alias("vec_id"), "score")


@query
def op5_main_text(spark: SparkSession, folder: str) -> DataFrame:
    found = pages.extracted(read(spark, folder, "pages", "page_id", "url", "html"), "page_id", "url", "html")
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def with_planted_periods(documents: DataFrame) -> DataFrame:
    """Texts of which a tenth repeat some of their own words to the end, as a hash of the id says; others are left alone.

    With h the CRC-32 of the decimal id, every word i >= a becomes word a + (i - a) % p.
    A row without an id has no hash and stays as it is.
    """
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    found = F.when(h % 10 == 0, F.regexp_extract_all("text", F.lit(WORD), F.lit(0)))
    n, g = F.size("_words"), F.floor(h / 10)
    a = F.col("_a")
    # the stretch of p words from a on, as often as fits and cut to length; no word is looked up one by one
    repeated = F.flatten(F.array_repeat(F.slice("_words", a + 1, F.col("_p")),
                                        F.ceil((n - a) / F.col("_p")).cast("int")))
    planted = F.array_join(F.slice(F.concat(F.slice("_words", F.lit(1), a), repeated), F.lit(1), n), " ")
    hit = F.col("_words").isNotNull() & (n > 0)
    return (documents.withColumn("_words", found)
            .withColumn("_a", F.when(hit, (g % n).cast("int")))
            .withColumn("_p", F.when(hit, (1 + F.floor((n - a) / (3 + g % 8))).cast("int")))
            .select("doc_id", F.when(hit, planted).otherwise(F.col("text")).alias("text")))


@query
def op11_periodic_runs(spark: SparkSession, folder: str) -> DataFrame:
    documents = with_planted_periods(read(spark, folder, "documents", "doc_id", "text"))
    found = runs.periodic_runs(documents, "text", ["doc_id"])
    order = F.transform("runs", lambda run: F.struct(run["length"].alias("length"), (-run["start"]).alias("start"),
                                                     (-run["period"]).alias("period")))
    best = F.array_max(order)
    lines = F.transform("runs", lambda run: F.concat_ws(",", run["start"], run["length"], run["period"]))
    listed = F.when(F.size("runs") > 0, F.concat(F.array_join(lines, "\n"), F.lit("\n"))).otherwise("")
    return found.withColumn("_best", best).select(
        "doc_id", "n_words", F.size("runs").cast("long").alias("n_runs"), (-F.col("_best.start")).alias("start"),
        F.col("_best.length").alias("length"), (-F.col("_best.period")).alias("period"),
        F.floor(1000 * F.col("_best.length") / -F.col("_best.period")).alias("exponent_milli"),
        F.sha2(listed, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))


@query
def op13_simhash(spark: SparkSession, folder: str) -> DataFrame:
    found = simhash.near_duplicates(read(spark, folder, "documents", "doc_id", "text"), "doc_id", "text")
    return found.select("doc_id", simhash.as_hex(F.col("fingerprint")).alias("fingerprint"), "component_id")


@query
def op12_hard_negatives(spark: SparkSession, folder: str) -> DataFrame:
    label = F.col("label").cast("long")
    whole = F.transform("embedding", lambda x: F.floor(256 * x.cast("double")).cast("double"))
    rows = read(spark, folder, "embeddings", "vec_id", "label", "embedding").select(
        "vec_id", F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label).alias("label"),
        F.when(gnat.usable(F.col("embedding")), whole).alias("vector"))
    return gnat.hard_negatives(rows, "vec_id", "label", "vector", F.col("id") % 100 == 0)
