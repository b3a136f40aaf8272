"""Stored answers of a wiki's page interface, and a sample page."""

from __future__ import annotations

import html

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCHEMA = (
    "title string, body struct<storage: struct<value: string>>, version struct<createdAt: string, `when`: string, `by`: struct<displayName: string>, authorId: string>, "
    "_links struct<base: string, webui: string>, history struct<lastUpdated: struct<`when`: string>>"
)


def normalised(answers: DataFrame, column: str = "json") -> DataFrame:
    """answers with title, content, url, updated and author, from either version of the interface; null where the JSON can't be read."""
    j = F.from_json(column, SCHEMA)
    title = j["title"]
    for entity in ("&lt;", "&gt;", "&quot;", "&#39;", "&nbsp;", "&amp;"):
        title = F.replace(title, F.lit(entity), F.lit(html.unescape(entity)))
    return answers.select(
        *answers.columns,
        title.alias("title"),
        F.coalesce(j["body"]["storage"]["value"], F.lit("")).alias("content"),
        F.concat(F.coalesce(j["_links"]["base"], F.lit("")), F.coalesce(j["_links"]["webui"], F.lit(""))).alias("url"),
        F.coalesce(j["version"]["createdAt"], j["version"]["when"], j["history"]["lastUpdated"]["when"], F.lit("")).alias("updated"),
        F.coalesce(j["version"]["by"]["displayName"], j["version"]["authorId"], F.lit("")).alias("author"),
    )


SAMPLE = """<h1>Release notes of the spring build</h1><p>All desks move on Monday.</p><h2>Steps</h2><ul><li>Stop imports</li><li>Run checks</li></ul>
<table><tr><th>Desk</th><th>Owner</th></tr><tr><td>Credit</td><td>Ada</td></tr><tr><td>Fraud</td><td>Bo</td></tr></table><pre>run --all</pre>"""
