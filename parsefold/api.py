"""What programs may call: add a text, and ask for the state of the selected document."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from parsefold.functions import fixed_values as v
from parsefold.sources.imports import add_text

ADDED = "doc_id long, name string, text string"


class InvalidArgument(ValueError):
    pass


def insert_reading_text(spark: SparkSession, arguments: dict) -> tuple[DataFrame, dict]:
    """The new document and {id, title, pages, words}. arguments: text, not blank; title,
    at most 200 characters; nothing else."""
    if not isinstance(arguments, dict) or set(arguments) - {"text", "title"}:
        raise InvalidArgument("only text and title are accepted")
    text, title = arguments.get("text"), arguments.get("title")
    if not isinstance(text, str) or not text.strip():
        raise InvalidArgument("text must be a string that is not blank")
    if title is not None and (not isinstance(title, str) or len(title) > v.MAX_TITLE):
        raise InvalidArgument(f"title must be a string of at most {v.MAX_TITLE} characters")
    rows = spark.createDataFrame([(text, title)], "text string, name string").withColumn("doc_id", F.xxhash64("text", F.coalesce("name", F.lit(""))))
    made = add_text(rows)
    r = made.select("doc_id", "name", F.size("pages").alias("pages"), "words", "error").first()
    if r["error"]:
        raise InvalidArgument(r["error"])
    return made, {"id": r["doc_id"], "title": r["name"], "pages": r["pages"], "words": r["words"]}


def get_reading_status(selected: DataFrame, arguments: dict) -> dict:
    """{title, pages, words} of the selected document, never its text."""
    if arguments != {}:
        raise InvalidArgument("no arguments are accepted")
    r = selected.select("name", F.size("pages").alias("pages"), "words").first()
    return {"title": r["name"], "pages": r["pages"], "words": r["words"]}
