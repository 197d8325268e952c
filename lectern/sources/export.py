"""Pages and documents as Markdown files, one each, with an index and a log."""

from __future__ import annotations

import json
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def slug(text: Column, fallback: str = "untitled") -> Column:
    plain = F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    return F.coalesce(F.nullif(F.substring(plain, 1, 80), F.lit("")), F.lit(fallback))


def frontmatter(fields: dict[str, Column]) -> Column:
    lines = [F.concat(F.lit(f"{k}: "), F.to_json(F.struct(F.coalesce(v.cast("string"), F.lit("")).alias("v")))) for k, v in fields.items()]
    quoted = [F.regexp_replace(line, r"\{\"v\":(.*)\}$", "$1") for line in lines]
    return F.concat(F.lit("---\n"), F.array_join(F.array(*quoted), "\n"), F.lit("\n---\n"))


def file_names(rows: DataFrame, title: str, key: str) -> DataFrame:
    """rows with file_name: the title as a slug, and the id beside it where several rows have one slug."""
    named = rows.withColumn("_slug", slug(F.col(title)))
    several = named.groupBy("_slug").agg(F.count(F.lit(1)).alias("_n"))
    unique = F.when(F.col("_n") > 1, F.concat_ws("-", "_slug", slug(F.col(key).cast("string")))).otherwise(F.col("_slug"))
    return named.join(several, "_slug").withColumn("file_name", F.concat(unique, F.lit(".md"))).drop("_slug", "_n")


def entity_markdown(pages: DataFrame, evidence: DataFrame, confirmed_only: bool = False) -> DataFrame:
    """(entity_id, file_name, body): one page each, every value with the documents that state it; pages without a mention are left out.

    pages: entity_id, type_id, canonical_name, status. evidence: entity_id, property_id, value, document_id, excerpt, status.
    """
    told = evidence.where("status IN ('confirmed', 'amended')") if confirmed_only else evidence.where("status <> 'rejected'")
    line = F.concat(F.lit("- **"), F.col("property_id"), F.lit("**: "), F.col("value"), F.lit(" ("), F.col("document_id").cast("string"), F.when(F.coalesce("excerpt", F.lit("")) != "", F.concat(F.lit(": \""), F.col("excerpt"), F.lit("\""))).otherwise(""), F.lit(")"), F.when(F.col("status").isin("confirmed", "amended"), "").otherwise(" _unconfirmed_"))
    lines = told.groupBy("entity_id").agg(F.array_join(F.array_sort(F.collect_set(line)), "\n").alias("_lines"), F.count_distinct("document_id").alias("_docs"))
    named = file_names(pages.join(lines, "entity_id"), "canonical_name", "entity_id")
    head = frontmatter({"id": F.col("entity_id"), "type": F.col("type_id"), "status": F.col("status"), "documents": F.col("_docs")})
    return named.select("entity_id", F.concat(F.lit("entities/"), "file_name").alias("file_name"), F.concat(head, F.lit("\n# "), F.col("canonical_name"), F.lit("\n\n"), F.col("_lines"), F.lit("\n")).alias("body"))


def document_markdown(documents: DataFrame, findings: DataFrame) -> DataFrame:
    """(document_id, file_name, body): one file each, with what was found in it. findings: document_id, type_id, label, status."""
    line = F.concat(F.lit("- "), F.col("type_id"), F.lit(": "), F.col("label"), F.when(F.col("status").isin("confirmed", "amended"), "").otherwise(" _unconfirmed_"))
    lines = findings.where("status <> 'rejected'").groupBy("document_id").agg(F.array_join(F.array_sort(F.collect_set(line)), "\n").alias("_lines"))
    named = file_names(documents.join(lines, "document_id", "left"), "filename", "document_id")
    body = F.concat(frontmatter({"id": F.col("document_id")}), F.lit("\n# "), F.col("filename"), F.lit("\n\n"), F.coalesce("_lines", F.lit("Nothing was found.")), F.lit("\n"))
    return named.select("document_id", F.concat(F.lit("documents/"), "file_name").alias("file_name"), body.alias("body"))


def index(files: DataFrame) -> DataFrame:
    """(file_name, body) of an index in parts, one for each first letter, so that no one row holds all names."""
    letter = F.upper(F.substring(F.element_at(F.split("file_name", "/"), -1), 1, 1))
    lines = F.array_join(F.array_sort(F.collect_set(F.concat(F.lit("- [["), F.regexp_replace("file_name", r"\.md$", ""), F.lit("]]")))), "\n")
    return files.groupBy(letter.alias("letter")).agg(lines.alias("body")).select(F.concat(F.lit("index/"), F.col("letter"), F.lit(".md")).alias("file_name"), F.concat(F.lit("# "), F.col("letter"), F.lit("\n\n"), F.col("body"), F.lit("\n")).alias("body"))


def write(files: DataFrame, folder: str) -> int:
    """Write files (file_name, body) under a folder that driver and executors share; how many there are. A task that runs again writes the same files."""
    local = folder.removeprefix("file://").removeprefix("file:")
    if re.match(r"^[a-z0-9]+://", local):
        from pyarrow import fs

        fs.FileSystem.from_uri(folder)  # refuse what can't be reached before any task runs

    def run(batches):
        import os

        import pandas as pd

        n = 0
        for batch in batches:
            for name, body in zip(batch["file_name"], batch["body"], strict=True):
                if local.startswith("/"):
                    path = os.path.join(local, name)
                    os.makedirs(os.path.dirname(path), exist_ok=True)
                    with open(f"{path}.part", "w", encoding="utf-8") as f:
                        f.write(body)
                    os.replace(f"{path}.part", path)
                else:
                    from pyarrow import fs

                    system, base = fs.FileSystem.from_uri(folder)
                    with system.open_output_stream(f"{base}/{name}") as f:
                        f.write(body.encode())
                n += 1
        yield pd.DataFrame({"n": [n]})

    return files.select("file_name", "body").mapInPandas(run, "n long").agg({"n": "sum"}).first()[0] or 0


def as_log(entries: list[dict]) -> str:
    """What an export did, one JSON line each."""
    return "".join(json.dumps(e, sort_keys=True) + "\n" for e in entries)
