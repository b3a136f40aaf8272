"""Prompts as text columns: pages by document, web results, dated excerpts, history, and how a model is told to answer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What a model is told, by what is asked; a deployment passes its own.
SYSTEM = {
    "en": "Answer from the given pages only and name the page of each statement. Answer in English.",
    "nl": "Antwoord alleen op grond van de gegeven pagina's en noem bij elke uitspraak de pagina. Antwoord in het Nederlands.",
    "comparison": "Compare what the excerpts say, source by source.",
    "aggregation": "Sum up what the excerpts say together.",
    "multi-topic": "Answer each of the questions on its own.",
}


def system(language: Column, texts: dict[str, str] = SYSTEM) -> Column:
    """The instruction in the language that the code begins with."""
    return F.when(F.lower(language).startswith("nl"), texts["nl"]).otherwise(texts["en"])


def system_by_intent(intent: Column, texts: dict[str, str] = SYSTEM) -> Column:
    return F.when(intent == "comparison", texts["comparison"]).when(intent == "multi-topic", texts["multi-topic"]).otherwise(texts["aggregation"])


def _joined(rows: DataFrame, order: list[str], line: Column, sep: str) -> DataFrame:
    """(query_id, body): the lines of each question in order; a question has a prompt's worth of them."""
    ordered = F.sort_array(F.collect_list(F.struct(*order, line.alias("_line"))))
    return rows.groupBy("query_id").agg(F.array_join(F.transform(ordered, lambda x: x["_line"]), sep).alias("body"))


def history(turns: DataFrame) -> DataFrame:
    """(query_id, history) of turns (query_id, pos, role, content): a block of who said what."""
    line = F.concat(F.when(F.col("role") == "user", "User: ").otherwise("Assistant: "), F.coalesce("content", F.lit("")))
    said = _joined(turns, ["pos"], line, "\n")
    return said.select("query_id", F.concat(F.lit("--- CONVERSATION SO FAR ---\n\n"), "body", F.lit("\n--- END CONVERSATION ---\n\n")).alias("history"))


def _asked(bodies: DataFrame, questions: DataFrame, turns: DataFrame | None, name: str) -> DataFrame:
    out = questions.join(bodies, "query_id", "left")
    out = out.join(history(turns), "query_id", "left") if turns is not None else out.withColumn("history", F.lit(""))
    body = F.coalesce(F.concat("body", F.lit("\n")), F.lit(""))
    return out.select("query_id", F.concat(F.coalesce("history", F.lit("")), F.lit(f"--- {name} ---\n\n"), body, F.lit(f"--- END {name} ---\n\nQuestion: "), "query").alias("prompt"))


def pages(pages: DataFrame, questions: DataFrame, turns: DataFrame | None = None) -> DataFrame:
    """(query_id, prompt): history, then the pages (query_id, doc_id, page_num, filename, headers, raw_text) of each document together, in
    order of its first page's place, then the question. A question without pages has a prompt as well."""
    trail = F.when(F.size("headers") > 0, F.concat(F.lit("  ["), F.array_join("headers", " > "), F.lit("]"))).otherwise("")
    line = F.concat(F.lit("=== "), "filename", F.lit(" — Page "), F.col("page_num").cast("string"), trail, F.lit(" ===\n"), "raw_text", F.lit("\n=== END PAGE ===\n"))
    return _asked(_joined(pages, ["doc_id", "page_num"], line, "\n"), questions, turns, "DOCUMENT PAGES")


def web(results: DataFrame, questions: DataFrame, turns: DataFrame | None = None) -> DataFrame:
    """(query_id, prompt): history, numbered results (query_id, pos, title, url, snippet), the question."""
    line = F.concat(F.lit("["), F.col("pos").cast("string"), F.lit("] "), "title", F.lit("\nURL: "), "url", F.lit("\n"), "snippet", F.lit("\n"))
    return _asked(_joined(results, ["pos"], line, "\n"), questions, turns, "WEB RESULTS")


def excerpts(hits: DataFrame, questions: DataFrame) -> DataFrame:
    """(query_id, prompt): dated excerpts (query_id, pos, filename, page, at, text), then the question."""
    day = F.coalesce(F.date_format("at", "yyyy-MM-dd"), F.lit("unknown"))
    line = F.concat(F.lit("["), "filename", F.lit(", Page "), F.col("page").cast("string"), F.lit(", Ingested: "), day, F.lit("]\n"), "text")
    out = questions.join(_joined(hits, ["pos"], line, "\n\n"), "query_id")
    return out.select("query_id", F.concat(F.lit("Using the document excerpts below, answer the question at the end.\n\n"), "body", F.lit("\n\nQuestion: "), "query").alias("prompt"))


def web_results(found: DataFrame, most: int = 5) -> DataFrame:
    """(query_id, pos, title, url, snippet) of a search provider's rows (query_id, rank, title, url, content, snippet): of the first `most`
    those with a title and an address; the snippet is the content where there is one."""
    from pyspark.sql import Window

    trim = lambda c: F.trim(F.coalesce(c, F.lit("")))
    w = Window.partitionBy("query_id").orderBy("rank")
    rows = found.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= most).where((trim("title") != "") & (trim("url") != ""))
    rows = rows.withColumn("pos", F.row_number().over(w))
    return rows.select("query_id", "pos", trim("title").alias("title"), trim("url").alias("url"), trim(F.coalesce("content", "snippet")).alias("snippet"))
