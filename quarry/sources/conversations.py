"""Chat threads as items: which threads to take, their messages in order, and questions and answers distilled from them."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fixed limits of what a distiller sees.
MESSAGES_SEEN, ANSWER_CHARS = 100, 8000


def slack_threads(messages: DataFrame, min_replies: int = 2, since: str | None = None) -> DataFrame:
    """Parents of threads with enough replies, newer than the token; ts are compared as text."""
    rows = messages.where((F.col("thread_ts") == F.col("ts")) & (F.col("reply_count") >= min_replies))
    return rows if since is None else rows.where(F.col("ts") > since)


def slack_token(threads: DataFrame) -> DataFrame:
    return threads.agg(F.max("ts").alias("token"))


def with_authors(messages: DataFrame, users: DataFrame, teams: DataFrame | None = None) -> DataFrame:
    """The names of users, with their team's in parentheses, in the place of ids; unknown ids stay."""
    named = messages.join(users.select(F.col("id").alias("user"), F.col("name").alias("_name"), *([F.col("team").alias("_team")] if teams is not None else [])), "user", "left")
    author = F.coalesce("_name", "user")
    if teams is not None:
        named = named.join(teams.select(F.col("id").alias("_team"), F.col("name").alias("_team_name")), "_team", "left")
        author = F.when(F.col("_team_name").isNotNull(), F.concat(author, F.lit(" ("), "_team_name", F.lit(")"))).otherwise(author)
    return named.withColumn("author", author).drop("_name", "_team", "_team_name")


def participants(messages: DataFrame) -> DataFrame:
    """The authors of each thread by their first message."""
    firsts = messages.groupBy("thread", "author").agg(F.min("position").alias("position"))
    by = firsts.groupBy("thread").agg(F.array_sort(F.collect_list(F.struct("position", "author"))).alias("all"))
    return by.select("thread", F.transform("all", lambda m: m["author"]).alias("participants"))


def discord_threads(threads: DataFrame, min_messages: int = 2, since: str | None = None) -> DataFrame:
    """Threads with enough messages whose last message is newer than the token; ids are compared as numbers. Of a thread listed twice the first row is
    taken, that of the least place where there is such a column."""
    columns = threads.columns
    first = threads.groupBy("id").agg(F.min_by(F.struct(*columns), "place").alias("r")).select("r.*") if "place" in columns else threads.dropDuplicates(["id"])
    rows = first.where(F.col("message_count") >= min_messages)
    if since is not None:
        rows = rows.where(F.col("last_message_id").try_cast("decimal(20,0)") > F.lit(since).try_cast("decimal(20,0)"))
    return rows


def discord_token(threads: DataFrame) -> DataFrame:
    return threads.agg(F.max(F.col("last_message_id").try_cast("decimal(20,0)")).cast("string").alias("token"))


def shortened(text: Column, most: int = ANSWER_CHARS) -> Column:
    """At most so many characters, cut at the last paragraph's end."""
    head = F.substring(text, 1, most)
    cut = F.when(F.contains(head, F.lit("\n\n")), F.call_function("substring_index", head, F.lit("\n\n"), F.regexp_count(head, F.lit("\n\n")))).otherwise(head)
    return F.when(F.length(text) <= most, text).otherwise(F.concat(cut, F.lit("\n\n[truncated]")))


def forum_items(threads: DataFrame, messages: DataFrame) -> DataFrame:
    """A question and answer of each forum thread: its name, and its messages with their authors but blank ones and a first one that says no
    more than the name or a beginning of it. Threads that have a column url pass it on."""
    said = messages.groupBy("thread").agg(F.array_sort(F.collect_list(F.struct("position", "author", "text"))).alias("all"))
    rows = threads.join(said, threads["id"] == said["thread"])
    opening = F.lower(F.btrim(F.get("all", F.lit(0))["text"]))
    repeats = (opening != "") & F.startswith(F.lower(F.btrim("name")), opening)
    own = F.filter(F.when(repeats, F.slice("all", F.lit(2), F.size("all"))).otherwise(F.col("all")), lambda m: F.length(F.btrim(m["text"])) > 0)
    text = F.array_join(F.transform(own, lambda m: F.concat(m["author"], F.lit(": "), m["text"])), "\n\n")
    rows = rows.withColumn("answer", shortened(text)).where(F.length("answer") > 0)
    url = F.col("url") if "url" in threads.columns else F.lit(None)
    return rows.select(
        F.concat("channel", F.lit(":"), "id").alias("id"), F.concat(F.lit("Q: "), "name", F.lit("\n\nA: "), "answer").alias("content"), F.col("name").alias("title"), url.cast("string").alias("source_url"),
        F.to_json(F.struct("channel", F.lit(1.0).alias("confidence"), F.lit(True).alias("forumThread"))).alias("metadata"),
    )


def for_distilling(messages: DataFrame) -> DataFrame:
    """The transcript of each thread's first messages, with times and reactions; longer threads are cut to what a distiller sees."""
    first = messages.withColumn("_n", F.row_number().over(Window.partitionBy("thread").orderBy("position"))).where(F.col("_n") <= MESSAGES_SEEN)
    reactions = F.array_join(F.transform("reactions", lambda r: F.concat(F.lit(":"), r["name"], F.lit(": x"), r["count"])), " ")
    line = F.concat(F.lit("["), "timestamp", F.lit("] "), "author", F.lit(": "), "text", F.when(F.size(F.coalesce("reactions", F.array())) > 0, F.concat(F.lit(" [reactions: "), reactions, F.lit("]"))).otherwise(""))
    by = first.groupBy("thread").agg(F.array_sort(F.collect_list(F.struct("_n", line.alias("line")))).alias("lines"))
    return by.select("thread", F.array_join(F.transform("lines", lambda r: r["line"]), "\n\n").alias("transcript"))


PAIRS = "thread string, i int, question string, answer string, confidence double"


def distilled(transcripts: DataFrame, distil: Callable[[str], str], min_confidence: float = 0.7) -> DataFrame:
    """Questions and answers of threads by a client that returns JSON: a list of objects with question, answer and confidence. What isn't valid is left out."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for thread, text in zip(batch.thread, batch.transcript, strict=True):
                try:
                    pairs = json.loads(distil(text))
                except (ValueError, TypeError):
                    continue
                for i, p in enumerate(pairs if isinstance(pairs, list) else []):
                    if isinstance(p, dict) and all(isinstance(p.get(k), str) for k in ("question", "answer")) and isinstance(p.get("confidence"), (int, float)):
                        out.append((str(thread), i, p["question"], p["answer"], float(p["confidence"])))
            yield pd.DataFrame(out, columns=["thread", "i", "question", "answer", "confidence"])

    pairs = transcripts.select(F.col("thread").cast("string").alias("thread"), "transcript").mapInPandas(run, PAIRS)
    pairs = pairs.withColumn("question", F.btrim("question")).withColumn("answer", F.btrim("answer"))
    return pairs.where("question != '' and answer != '' and confidence between 0 and 1").where(F.col("confidence") >= min_confidence)


def pair_items(pairs: DataFrame) -> DataFrame:
    """Items of distilled pairs."""
    return pairs.select(
        F.concat_ws(":", "thread", F.col("i").cast("string")).alias("id"), F.concat(F.lit("Q: "), "question", F.lit("\n\nA: "), "answer").alias("content"), F.col("question").alias("title"),
        F.lit(None).cast("string").alias("source_url"), F.to_json(F.struct("confidence")).alias("metadata"),
    )
