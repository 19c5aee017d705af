"""Files as items: scans, globs, snapshots and their differences, and extraction of documents' text."""

from __future__ import annotations

import io
import json
import shutil
import subprocess
import uuid
import zipfile
from pathlib import Path
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.functions.scalar import glob_match, low_semantic_value

#: Fixed values of the scan.
SKIPPED = ["node_modules", "dist", "build", ".git"]
MAX_BYTES, MAX_DOCUMENT_BYTES, SHORT_TEXT = 100 * 1024, 10 * 1024 * 1024, 50
_WORD = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def scan(spark: SparkSession, root: str, include: list[str] = ["**"], exclude: list[str] = [], max_bytes: int = MAX_BYTES, skipped: list[str] = SKIPPED) -> DataFrame:
    """path (relative to root), modified, bytes and content of the files under root that match. Spark lists and reads them; folders of the
    skipped names, files over max_bytes and files that match no include or any exclude are left out before contents are read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    at = F.concat(F.lit("/"), F.substring_index("path", root.rstrip("/").split(":", 1)[-1].lstrip("/") + "/", -1))
    rows = found.where(F.col("length") <= max_bytes).withColumn("relative", F.substring(at, 2, 1 << 30))
    inside = F.exists(F.slice(F.split("relative", "/"), F.lit(1), F.size(F.split("relative", "/")) - 1), lambda p: p.isin(skipped))
    return rows.where(~inside & glob_match(F.col("relative"), include, exclude)).select(F.col("relative").alias("path"), F.col("modificationTime").alias("modified"), F.col("length").alias("bytes"), "content")


def _docx(raw: bytes) -> str:
    """The paragraphs of a word-processing document."""
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        root = ElementTree.fromstring(z.read("word/document.xml"))
    return "\n\n".join("".join(t.text or "" for t in p.iter(f"{_WORD}t")) for p in root.iter(f"{_WORD}p"))


def _pdf(raw: bytes) -> tuple[str, dict]:
    """The text of a PDF, a form feed between pages, and what it tells of itself."""
    from pypdf import PdfReader  # optional

    reader = PdfReader(io.BytesIO(raw))
    told = reader.metadata or {}
    values = {"title": told.get("/Title"), "author": told.get("/Author"), "creationDate": told.get("/CreationDate"), "pageCount": len(reader.pages)}
    return "\f".join(page.extract_text() or "" for page in reader.pages), {k: v if isinstance(v, int) else str(v) for k, v in values.items() if v}


def extract(path: str, raw: bytes) -> tuple[str | None, str | None, str | None]:
    """Text, metadata (JSON) and problem of a document. One that can't be read has no text, but does not stop the others; a PDF with pages but hardly
    any text has a problem too, as it may be scanned."""
    try:
        if path.lower().endswith(".docx"):
            return _docx(raw), None, None
        text, told = _pdf(raw)
    except ImportError:
        return None, None, "reading PDF needs the optional library pypdf"
    except Exception as e:  # noqa: BLE001  readers of broken files raise anything
        return None, None, f"{type(e).__name__}: {e}"[:500]
    short = told.get("pageCount") and len(text.strip()) < SHORT_TEXT
    return text, json.dumps(told, ensure_ascii=False) if told else None, f"{told['pageCount']} pages, {len(text.strip())} characters: scanned?" if short else None


@F.pandas_udf(T.StructType([T.StructField(n, T.StringType()) for n in ("text", "metadata", "problem")]))
def _extracted(paths: pd.Series, contents: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([extract(p, c) for p, c in zip(paths, contents, strict=True)], columns=["text", "metadata", "problem"], dtype=object)


def _is_document(path: Column) -> Column:
    return F.lower(path).rlike(r"\.(pdf|docx)$")


def items(files: DataFrame, base: Column | None = None, documents: bool = False) -> DataFrame:
    """Items of scanned files, without those of low semantic value. Of documents, .pdf and .docx are extracted, and broken ones left out (see problems);
    all other bytes are UTF-8."""
    plain = F.struct(F.decode("content", "UTF-8").alias("text"), F.lit(None).cast("string").alias("metadata"), F.lit(None).cast("string").alias("problem"))
    found = F.when(_is_document(F.col("path")), _extracted("path", "content")).otherwise(plain) if documents else plain
    rows = files.select("path", found.alias("found")).select("path", F.col("found.text").alias("content"), F.col("found.metadata").alias("told"))
    rows = rows.where(F.col("content").isNotNull() & ~low_semantic_value(F.col("content")))
    return rows.select(F.col("path").alias("id"), "content", F.lit(None).cast("string").alias("title"), (F.lit(None).cast("string") if base is None else base).alias("source_url"), F.coalesce("told", F.lit("{}")).alias("metadata"))


def problems(files: DataFrame) -> DataFrame:
    """path and problem of the documents that can't be read, or hardly."""
    return files.where(_is_document(F.col("path"))).select("path", _extracted("path", "content").getField("problem").alias("problem")).where("problem IS NOT NULL")


def snapshot(files: DataFrame) -> DataFrame:
    """path and hash of each file, to tell changes by."""
    return files.select("path", F.sha2("content", 256).alias("hash"))


def changes(before: DataFrame, now: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Paths that are new or differ, and paths that are gone."""
    return now.join(before, ["path", "hash"], "left_anti").select("path"), before.join(now, "path", "left_anti").select("path")


def digests(lines: DataFrame, *keys: str) -> DataFrame:
    """The number of lines (column line) of each key and a SHA-256 of them that does not hang on their order. Lines are digested in 4096 parts, by the
    first digits of their MD5, and then the parts, so no task gathers the lines of a key."""
    parts = lines.groupBy(*keys, F.substring(F.md5("line"), 1, 3).alias("part")).agg(F.count("*").alias("n"), F.sha2(F.array_join(F.array_sort(F.collect_list("line")), ""), 256).alias("digest"))
    told = F.concat("part", F.lit(":"), "digest", F.lit("\n"))
    return parts.groupBy(*keys).agg(F.sum("n").alias("n"), F.sha2(F.array_join(F.array_sort(F.collect_list(told)), ""), 256).alias("digest"))


def state_token(files: DataFrame) -> DataFrame:
    """One row with a token that changes with any path or time of change."""
    lines = files.select(F.concat("path", F.lit(":"), F.unix_millis("modified"), F.lit("\n")).alias("line"))
    return digests(lines).select(F.concat(F.lit("local-"), F.substring("digest", 1, 12)).alias("token"))


def git(folder: str, *args: str) -> str:
    return subprocess.run(["git", "-C", folder, *args], capture_output=True, text=True, check=True, timeout=300).stdout


def authorised(url: str, access: str | None) -> str:
    """An https url with an access token in it."""
    return url.replace("https://", f"https://x-access-token:{access}@", 1) if access and url.startswith("https://") else url


def checkout(url: str, folder: str, branch: str | None = None, access: str | None = None) -> str:
    """The folder, with the newest commit of a repository: pulled where it holds a checkout, else cloned, one commit deep. A checkout that can't be pulled is
    replaced once a new clone is there; a folder that is no checkout is left alone, which is an error. The access token is not kept in the checkout.
    On a cluster the folder must be one that driver and executors share."""
    place, address = Path(folder), authorised(url, access)
    there = (place / ".git").exists()
    if place.exists() and not there and any(place.iterdir()):
        raise ValueError(f"{folder} is not empty and no checkout")
    if there:
        try:
            git(folder, "pull", "-q", "--ff-only", address, *([branch] if branch else []))
            return folder
        except (subprocess.SubprocessError, OSError):
            pass
    place.parent.mkdir(parents=True, exist_ok=True)
    fresh = place.with_name(f"{place.name}.{uuid.uuid4().hex}")
    done = subprocess.run(["git", "clone", "-q", "--depth=1", *(["--branch", branch] if branch else []), "--", address, str(fresh)], capture_output=True, text=True, timeout=3600, check=False)
    if done.returncode:
        raise RuntimeError(f"can't clone {url}: {done.stderr.replace(address, url).strip()[-500:]}")
    git(str(fresh), "remote", "set-url", "origin", url)
    if place.exists():
        shutil.rmtree(place)
    fresh.rename(place)
    return folder


def git_token(folder: str, branch: str = "HEAD") -> str | None:
    """The commit of the remote branch, else of the local one, else None."""
    for args in (("ls-remote", "origin", branch), ("rev-parse", "HEAD")):
        try:
            if out := git(folder, *args).split():
                return out[0]
        except (subprocess.SubprocessError, OSError):
            continue
    return None


def git_changes(folder: str, since: str) -> tuple[list[str], list[str]] | None:
    """Changed and deleted paths since a commit; None where git can't tell, so that all is read."""
    try:
        rows = [line.split("\t") for line in git(folder, "diff", "--name-status", "--no-renames", since, "HEAD").splitlines()]
    except (subprocess.SubprocessError, OSError):
        return None
    return [r[1] for r in rows if r[0] != "D"], [r[1] for r in rows if r[0] == "D"]
