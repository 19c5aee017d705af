"""Texts made of tables: search results, FAQ, llms files, transcripts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions.scalar import answer

#: Fixed parts of the result formats.
NOTHING, NOTHING_FAQ = "No results found.", "No FAQ results found."
FORMATS = {
    "docs": [("TITLE", ["title", "file_path"]), ("SOURCE", ["source_url", "file_path"])],
    "code": [("REPOSITORY", ["repo_url"]), ("PATH", ["file_path"])],
    "raw": [("SOURCE", ["source_url", "file_path"])],
}


def _first_filled(columns: list[str]) -> Column:
    return F.coalesce(*[F.nullif(F.col(c), F.lit("")) for c in columns])


def _joined(rows: DataFrame, text: Column, between: str, nothing: str) -> DataFrame:
    """One row with the texts of some result rows in the order of n."""
    whole = rows.select("n", text.alias("text")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "text"))), lambda r: r["text"]), between).alias("text"))
    return whole.select(F.when(F.length("text") > 0, F.col("text")).otherwise(nothing).alias("text"))


def numbered(results: DataFrame) -> DataFrame:
    return results.withColumn("n", F.row_number().over(Window.orderBy(F.desc("similarity"), "id")))


def search_results(results: DataFrame, form: str = "raw") -> DataFrame:
    """The results of a search as one text."""
    lines = [F.concat(F.lit("SNIPPET "), F.col("n"))] + [F.concat(F.lit(f"{k}: "), F.coalesce(_first_filled(c), F.lit("null"))) for k, c in FORMATS.get(form, FORMATS["raw"])]
    return _joined(numbered(results), F.concat_ws("\n", *lines, F.lit("CONTENT:"), F.col("content")), "\n\n---\n\n", NOTHING)


def faq_results(results: DataFrame) -> DataFrame:
    lines = [
        F.concat(F.lit("Q&A "), F.col("n")), F.concat(F.lit("QUESTION: "), F.coalesce(_first_filled(["title"]), F.lit("(untitled)"))), F.concat(F.lit("ANSWER: "), answer(F.col("content"))),
        F.concat(F.lit("SOURCE: "), _first_filled(["source_url", "file_path"])), F.concat(F.lit("CONFIDENCE: "), F.format_string("%.2f", "confidence")),
    ]
    return _joined(numbered(results), F.concat_ws("\n", *lines), "\n\n", NOTHING_FAQ)


def llms_index(chunks: DataFrame) -> DataFrame:
    """The title of each file: its first chunk's, else its path."""
    by = chunks.groupBy("source_name", "file_path").agg(F.min_by("title", F.struct("chunk_index", "id")).alias("title"))
    return by.select("source_name", "file_path", F.coalesce(F.nullif("title", F.lit("")), "file_path").alias("title")).orderBy("source_name", "file_path")


def llms_full(chunks: DataFrame, by_source: bool = True) -> DataFrame:
    """The chunks of each file in one text; by_source keeps equal paths of different sources apart."""
    key = ["source_name", "file_path"] if by_source else ["file_path"]
    by = chunks.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("chunk_index", "id", "content"))).alias("parts"))
    return by.select(*key, F.array_join(F.transform("parts", lambda p: p["content"]), "\n").alias("content"))


def faq_text(faq: DataFrame, order: list[str]) -> DataFrame:
    """FAQ rows by source in the order of the configuration."""
    place = F.create_map(*[F.lit(x) for pair in zip(order, range(len(order)), strict=True) for x in pair])
    rows = faq.where(F.col("source_name").isin(order)).withColumn("_place", F.element_at(place, F.col("source_name")))
    return rows.orderBy("_place", F.desc("indexed_at"), "id").select("source_name", "title", answer(F.col("content")).alias("answer"))


def transcripts(messages: DataFrame) -> DataFrame:
    """The messages of each thread as one text, in their order."""
    line = F.concat(F.lit("["), F.col("position"), F.lit("] "), F.coalesce("author", F.lit("unknown")), F.lit(": "), F.coalesce("text", F.lit("")))
    by = messages.groupBy("thread").agg(F.array_sort(F.collect_list(F.struct("position", line.alias("line")))).alias("lines"))
    return by.select("thread", F.array_join(F.transform("lines", lambda r: r["line"]), "\n\n").alias("transcript"))


def skill_text(config: dict) -> str:
    """What an assistant is told about a server: its tools, what they search and how to call them."""
    lines = [f"# {config['server']['name']}", "", config["server"].get("description") or "Search tools over indexed sources.", "", "## Tools", ""]
    for t in config.get("tools") or []:
        sources = t.get("sources") or [t["source"]] if t.get("sources") or t.get("source") else []
        lines.append(f"- `{t['name']}` ({t['type']}{', over ' + ', '.join(sources) if sources else ''})" + (f": {t['description']}" if t.get("description") else ""))
    return "\n".join(lines) + "\n"


def index_text(chunks: DataFrame) -> DataFrame:
    """One row: the text of the file INDEX, a line for each folder of sources with its numbers of files and chunks."""
    by = chunks.groupBy("source_name").agg(F.count_distinct("file_path").alias("files"), F.count("*").alias("chunks"))
    line = F.concat(F.lit("/"), "source_name", F.lit("/  "), "files", F.lit(" files, "), "chunks", F.lit(" chunks"))
    return by.agg(F.array_join(F.array_sort(F.collect_list(line)), "\n").alias("text"))
