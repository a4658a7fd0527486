"""Readers and writers."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexmill.functions import text as tx


def whole_text(spark: SparkSession, path: str) -> DataFrame:
    """One row a file, line ends as they are."""
    return spark.read.text(path, wholetext=True).withColumnRenamed("value", "text")


def wordset(spark: SparkSession, path: str) -> DataFrame:
    """Distinct words of a file, split at any white space."""
    return spark.read.text(path).select(F.explode(F.split(F.trim("value"), r"(?U)\s+")).alias("word")).where("word <> ''").distinct()


def expert_list(spark: SparkSession, path: str) -> DataFrame:
    """Distinct concepts as word arrays; ``::`` joins the words of one."""
    return wordset(spark, path).select(F.split("word", "::").alias("words"))


def commented_lines(spark: SparkSession, path: str, keep_empty: bool = False, cut_comments: bool = False) -> DataFrame:
    """Lines that are no ``#`` comments; optionally without trailing comments, and with empty lines."""
    lines = spark.read.text(path).where(~F.col("value").rlike(r"^\s*#"))
    if cut_comments:
        lines = lines.select(F.regexp_replace("value", r"\s*#.*$", "").alias("value"))
    return lines if keep_empty else lines.where("value <> ''")


def article(spark: SparkSession, path: str, number: int) -> DataFrame:
    """The stored record of a number; a negative marker wins over the article."""
    rows = spark.read.parquet(path).where(F.abs("number") == number)
    return rows.orderBy("number").limit(1)


def blog_corpus(posts: DataFrame, min_keywords: int = 0, limit: int | None = None) -> DataFrame:
    """Usable posts with the union of their filtered tags and hubs as keywords, in id order."""
    rows = posts.where("id >= 0 and status = 'ok'").withColumn("keywords", F.array_union(tx.filter_tags(F.col("tags")), tx.filter_tags(F.col("hubs"))))
    return _limited(rows.where(F.size("keywords") >= min_keywords).select("id", "title", "text", "keywords"), "id", limit)


def library_corpus(articles: DataFrame, min_keywords: int = 0, limit: int | None = None) -> DataFrame:
    """Usable articles; keywords keep repetitions, and articles without any stay only if none are asked for."""
    rows = articles.where("number >= 0 and status = 'ok'").withColumn("keywords", tx.filter_tags(F.col("keywords")))
    return _limited(rows.where(F.coalesce(F.size("keywords"), F.lit(0)) >= min_keywords), "number", limit)


def _limited(rows: DataFrame, key: str, limit: int | None) -> DataFrame:
    return rows.orderBy(key).limit(limit) if limit is not None else rows


def topic_previews(spark: SparkSession, path: str, topic: str) -> DataFrame:
    """Previews of one topic: only its partition is read."""
    return spark.read.parquet(path).where(F.col("topic") == topic)


def save_topics(old: DataFrame, new: DataFrame, path: str) -> None:
    """Old and new previews, by topic and in number order."""
    merged = old.unionByName(new)
    merged.repartition("topic").sortWithinPartitions("topic", "number").write.mode("overwrite").partitionBy("topic").parquet(path)


def save_new(rows: DataFrame, path: str, key: str, overwrite: bool = False) -> None:
    """Append rows whose key is not stored yet; marked ``-`` if they are not ok."""
    spark = rows.sparkSession
    marked = rows.withColumn(key, F.when(F.col("status") == "ok", F.col(key)).otherwise(-F.col(key)))
    if not overwrite:
        try:
            stored = spark.read.parquet(path).select(F.abs(key).alias("_k")).distinct()
            marked = marked.join(stored, F.abs(marked[key]) == stored["_k"], "left_anti")
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":  # else nothing is stored yet
                raise
    marked.write.mode("overwrite" if overwrite else "append").parquet(path)


def write_terms(terms: DataFrame, path: str, **parameters) -> None:
    """The result as text: ``#`` lines with the parameters, a blank line, then the terms in code-point order."""
    spark = terms.sparkSession
    head = [f"# {k}: {v}" for k, v in parameters.items()] + [""]
    lines = spark.createDataFrame([(0, i, x) for i, x in enumerate(head)], "part int, no int, value string")
    body = terms.select(F.lit(1).alias("part"), F.lit(0).alias("no"), F.col("term").alias("value"))
    lines.unionByName(body).orderBy("part", "no", "value").select("value").coalesce(1).write.mode("overwrite").text(path)


def write_terms_by_text(texts: DataFrame, terms: DataFrame, path: str, parameters: str, key: str = "file") -> None:
    """A result for each text (key), in a folder named by it: ``#`` lines with source, parameters and number of terms, a blank line, the terms in code-point order.

    Texts without terms have a result of the head alone. Each text is written by one task, all texts by many.
    """
    n = terms.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    head = texts.select(key).distinct().join(n, key, "left").select(
        key, F.lit(0).alias("part"), F.posexplode(F.array(F.concat(F.lit("# Source text: "), F.col(key)), F.lit(f"# Parameters : {parameters}"), F.concat(F.lit("# Terms extracted: "), F.coalesce("n", F.lit(0)).cast("string")), F.lit(""))).alias("no", "value")
    )
    body = terms.select(key, F.lit(1).alias("part"), F.lit(0).alias("no"), F.col("term").alias("value"))
    named = head.unionByName(body).withColumn("text", F.element_at(F.split(key, "/"), -1))
    named.repartition(key).sortWithinPartitions("text", key, "part", "no", "value").select("text", "value").write.mode("overwrite").partitionBy("text").text(path)


def stored_result(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").parquet(path)


def last_page(html: Column) -> Column:
    """The number of the last page of a paginated listing."""
    return F.array_max(F.transform(F.regexp_extract_all(html, F.lit(r"/page/?(\d+)"), F.lit(1)), lambda x: x.cast("int")))
