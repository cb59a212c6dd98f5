"""Keyword lookup by an inverted index of characters: which nodes hold a word anywhere in their text, without reading texts.

The index has a posting (gram, node, place) for each run of ``GRAM`` characters of a node's lower-case text. A word is in a
text exactly if the runs that cover the word stand there side by side: a run at offset o found at place p votes for the start
p - o, and a start with the votes of all runs is an occurrence. So postings alone decide, without false hits.

Postings are written by bucket of gram and sorted by gram and node, a lookup's grams are filters on both, and files hold
their least and greatest grams: a lookup opens the buckets and row groups of its grams only. A gram that most nodes
hold is spread over files by node.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions.text import keywords

GRAM, BUCKETS = 3, 64
#: Distinct grams of a set of questions up to which they are filters of the scan; more only join.
FILTER_GRAMS = 20_000


def _bucket(gram: Column) -> Column:
    return F.pmod(F.xxhash64(gram), F.lit(BUCKETS)).cast("int")


def write_index(nodes: DataFrame, path: str, node: str, text: Column) -> None:
    """Postings of the nodes' texts (null counts as empty; texts of fewer than ``GRAM`` characters have none)."""
    low = nodes.select(F.col(node).alias("node"), F.lower(F.coalesce(text, F.lit(""))).alias("t")).filter(F.length("t") >= GRAM)
    runs = F.transform(
        F.sequence(F.lit(1), F.length("t") - (GRAM - 1)), lambda i: F.struct(F.substring("t", i, F.lit(GRAM)).alias("gram"), i.alias("place"))
    )
    rows = low.select("node", F.explode(runs).alias("x")).select("x.gram", "node", "x.place").withColumn("bucket", _bucket(F.col("gram")))
    rows = rows.repartitionByRange("bucket", "gram", "node").sortWithinPartitions("bucket", "gram", "node")
    rows.write.partitionBy("bucket").mode("overwrite").parquet(path)


def _cover(word: Column) -> Column:
    """Runs that cover a word, with their offsets: every ``GRAM`` characters, and the last one."""
    last = F.length(word) - GRAM
    offsets = F.array_distinct(F.concat(F.sequence(F.lit(0), last, F.lit(GRAM)), F.array(last)))
    return F.transform(offsets, lambda o: F.struct(F.substring(word, o + 1, F.lit(GRAM)).alias("gram"), o.alias("offset")))


def occurrences(spark: SparkSession, path: str, words: DataFrame) -> DataFrame:
    """(word, node): the nodes that hold each word (lower case, ``GRAM`` characters or more; shorter ones are an error)."""
    long = F.when(F.length("word") >= GRAM, F.col("word")).otherwise(F.raise_error(F.lit(f"words of the index have {GRAM} characters or more")))
    own = words.select(long.alias("word")).distinct().select("word", _cover(F.col("word")).alias("runs"))
    runs = own.select("word", F.size("runs").alias("n"), F.explode("runs").alias("x"))
    runs = runs.select("word", "n", "x.gram", "x.offset", _bucket(F.col("x.gram")).alias("bucket"))
    postings = spark.read.schema("gram string, node long, place int, bucket int").parquet(path)
    wanted = [r["gram"] for r in runs.select("gram").distinct().limit(FILTER_GRAMS + 1).collect()]
    if len(wanted) <= FILTER_GRAMS:
        buckets = [r[0] for r in spark.createDataFrame([(g,) for g in wanted], "g string").select(_bucket(F.col("g"))).distinct().collect()]
        postings = postings.filter(F.col("bucket").isin(buckets) & F.col("gram").isin(wanted))
    met = postings.join(runs, ["bucket", "gram"]).groupBy("word", "node", (F.col("place") - F.col("offset")).alias("start"), "n")
    # A run that a word holds twice votes for two starts with one posting, so each start counts its own votes.
    return met.agg(F.count("*").alias("votes")).filter(F.col("votes") == F.col("n")).select("word", "node").distinct()


def keyword_ranks(spark: SparkSession, path: str, asked: DataFrame) -> DataFrame:
    """(ask_id, node, score): how many keywords of each question, repeats counted, each node holds; nodes without any have no row.

    asked: ask_id, question. Equal to scoring every node's text against every question.
    """
    words = asked.select("ask_id", F.explode(keywords(F.col("question"))).alias("word"))
    words = words.groupBy("ask_id", "word").agg(F.count("*").alias("times"))
    found = occurrences(spark, path, words.select("word"))
    return found.join(words, "word").groupBy("ask_id", "node").agg(F.sum("times").cast("int").alias("score"))
