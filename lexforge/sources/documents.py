"""Document sources: Markdown, plain text and (by a converter that the caller supplies) PDF files, with warnings instead of failures."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexforge.functions.text import content_id

SUFFIXES = ("md", "txt", "pdf")


def read_documents(spark: SparkSession, path: str, convert_pdf: Callable[[bytes], tuple[str, int]] | None = None) -> tuple[DataFrame, DataFrame]:
    """(documents, warnings) of a folder or glob.

    documents: document_id (a content hash), source, source_name, text, pages. A file with another suffix, an unreadable PDF, and any PDF
    without a converter give a warning row (source, warning) and no document. Empty files hold no text and give no document (the reader skips them).
    """
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    files = files.withColumn("suffix", F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1)))
    texts = files.filter(F.col("suffix").isin("md", "txt")).select("path", F.decode("content", "UTF-8").alias("text"), F.lit(None).cast("int").alias("pages"), F.lit(None).cast("string").alias("warning"))
    pdfs = files.filter(F.col("suffix") == "pdf")
    if convert_pdf is None:
        converted = pdfs.select("path", F.lit(None).cast("string").alias("text"), F.lit(None).cast("int").alias("pages"), F.lit("no PDF converter").alias("warning"))
    else:

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                rows = []
                for path_, content in zip(pdf["path"], pdf["content"]):
                    try:
                        text, pages = convert_pdf(bytes(content))
                        rows.append((path_, text, pages, None))
                    except Exception as e:  # noqa: BLE001 - any converter failure is a warning of that file
                        rows.append((path_, None, None, f"conversion failed: {type(e).__name__}"))
                yield pd.DataFrame(rows, columns=["path", "text", "pages", "warning"]).astype({"pages": "Int32"})

        converted = pdfs.select("path", "content").mapInPandas(run, "path string, text string, pages int, warning string")
    other = files.filter(~F.col("suffix").isin(*SUFFIXES)).select("path", F.lit(None).cast("string").alias("text"), F.lit(None).cast("int").alias("pages"), F.lit("unsupported file type").alias("warning"))
    rows = texts.unionByName(converted).unionByName(other)
    good = rows.filter("warning IS NULL").select(
        content_id("document", F.col("path"), F.col("text")).alias("document_id"), F.col("path").alias("source"), F.regexp_extract("path", r"([^/]+)$", 1).alias("source_name"), "text", "pages"
    )
    return good, rows.filter("warning IS NOT NULL").select(F.col("path").alias("source"), "warning")
