"""Which file a question names, by what the files call themselves."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafmill.functions.text import ALIAS_STOPWORDS
from leafmill.operators import lexical


def acronyms(text: Column) -> Column:
    return F.transform(F.regexp_extract_all(text, F.lit(r"\b[A-Z]{2,}\b"), 0), lambda x: F.lower(x))


def alias_lists(files: DataFrame, text: str) -> DataFrame:
    """(filename, aliases) of files (filename, first text): acronyms, words of the name, words of five letters on of the text."""
    stem = F.lower(F.regexp_replace("filename", r"\.[^.]*$", ""))
    body = F.coalesce(F.col(text), F.lit(""))
    plain = F.array_union(F.regexp_extract_all(stem, F.lit("[a-z]{4,}"), 0), F.regexp_extract_all(F.lower(body), F.lit(r"\b[a-z]{5,}\b"), 0))
    stop = F.array(*(F.lit(s) for s in ALIAS_STOPWORDS))
    return files.select("filename", F.array_union(acronyms(body), F.array_except(plain, stop)).alias("aliases"))


def aliases(files: DataFrame, text: str) -> DataFrame:
    """(filename, alias): a row for each of alias_lists()."""
    return alias_lists(files, text).select("filename", F.explode("aliases").alias("alias"))


def detect(questions: DataFrame, known: DataFrame, question: str = "query") -> DataFrame:
    """(query_id, filename, shared): the file that shares most aliases with a question, two at least; the first by name on ties.

    known: alias_lists(), read once. Files are scored where they lie; only the best of each task move on."""
    found = F.array_distinct(F.array_union(acronyms(F.col(question)), F.regexp_extract_all(F.lower(question), F.lit("[a-z]{4,}"), 0)))
    asked = questions.select("query_id", F.explode(found).alias("term")).distinct().withColumn("w", F.lit(1.0)).persist()
    top = lexical.best(known.select(F.col("filename").alias("key"), F.col("aliases").alias("words")), asked, 1, 0, lambda tf, dl: np.ones(len(tf)), 1.0)
    return top.select("query_id", F.col("key").alias("filename"), F.col("score").cast("bigint").alias("shared"))
