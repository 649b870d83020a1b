"""Assembly of documents: merged Markdown, log lines, conversion that failures don't stop, and hashes of configurations."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .masking import safe_id

#: The fields that a job's log may hold.
LOG_FIELDS = ("time", "job_id", "event", "status", "item_id", "stage", "progress", "count", "size_bytes", "duration_ms", "error_code", "summary")


def merged_markdown(items: DataFrame, project: str = "project", path: str = "path", text: str = "text", *, names: bool = False, status: str | None = None) -> DataFrame:
    """(project, markdown, n_items): a title, then each item under its own, in order of the paths.

    Titles are hashes, or with ``names`` the names themselves. Image comments and blanks about a text go; with ``status`` only
    succeeded items are taken, and a project without one has no row. A project's texts stand together in a row of theirs.
    """
    taken = items if status is None else items.where(F.col(status) == "succeeded")
    shown = (lambda c: F.regexp_extract(c, "[^/]*$", 0)) if names else (lambda c: F.concat(F.lit("document-"), safe_id(c)))
    clean = F.regexp_replace(F.regexp_replace(F.coalesce(F.col(text), F.lit("")), r"<!--\s*image\s*-->", ""), r"(?U)^\s+|\s+\z", "")
    section = F.concat(F.lit("# ---- "), shown(F.col(path)), F.lit(" ----\n\n"), clean, F.lit("\n"))
    per = taken.groupBy(project).agg(F.array_sort(F.collect_list(F.struct(F.col(path).alias("p"), section.alias("s")))).alias("_s"))
    title = F.col(project) if names else F.concat(F.lit("document-project-"), safe_id(F.col(project)))
    body = F.array_join(F.transform("_s", lambda x: x["s"]), "\n")
    return per.select(project, F.concat(F.lit("# "), title, F.lit("\n\n"), body).alias("markdown"), F.size("_s").alias("n_items"))


def log_lines(records: DataFrame) -> DataFrame:
    """(line): a JSON object per record with its safe fields, in alphabetical order and without nulls; other columns stay out."""
    fields = sorted(set(LOG_FIELDS) & set(records.columns))
    return records.select(F.to_json(F.struct(*fields)).alias("line"))


def write_log(records: DataFrame, path: str) -> None:
    """Appends the records' lines to the log in a folder."""
    log_lines(records).write.mode("append").text(path)


def converted(files: DataFrame, convert: Callable[[str, bytes], str], *, name: str = "path", content: str = "content") -> DataFrame:
    """(name, text, error): each file's text by ``convert``; one that fails has a placeholder and its error's kind, and stops no other.

    Messages of errors may hold parts of texts, so only the kind of an error leaves.
    """

    def run(batches: Iterator) -> Iterator:
        for batch in batches:
            rows = []
            for n, c in zip(batch[name], batch[content], strict=True):
                try:
                    rows.append((n, convert(n, None if c is None else bytes(c)), None))
                except Exception as e:  # noqa: BLE001 - any converter's failure is a result
                    rows.append((n, "<!-- conversion failed -->", type(e).__name__))
            yield type(batch)(rows, columns=[name, "text", "error"])

    return files.select(name, content).mapInPandas(run, f"{name} string, text string, error string")


def config_hash(config: dict) -> str:
    """The SHA-256 of a configuration as canonical JSON: keys in order, no blanks, letters as they are."""
    return hashlib.sha256(json.dumps(config, sort_keys=True, ensure_ascii=False, separators=(",", ":")).encode()).hexdigest()


def mask_job_id(text: Column, config: dict) -> Column:
    """The id of masking a normalised text under a configuration."""
    return safe_id(F.concat(F.sha2(text, 256), F.lit(config_hash(config))))
