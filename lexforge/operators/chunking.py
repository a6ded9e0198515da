"""Markdown documents to parent and child chunks.

The recursion over boundaries is order-dependent inside one document, so it is a small helper over one text; documents are spread by Spark and
the ids are Column expressions. Every text is cut whole: the segments of a body, joined, are the body.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexforge.functions.text import content_id

TOKEN = re.compile(r"\w+|\s+|[^\w\s]")
HEADING = re.compile(r"^[ ]{0,3}(#{1,6})[ \t]+(.*?)[ \t]*#*[ \t]*$", re.MULTILINE)
#: What opens an agreement, and how a numbered section's heading begins.
INTRO = ("agreement", "between", "by and between", "effective", "parties to this agreement", "employer", "employee")
NUMBERED = re.compile(r"(section\s+)?\d{1,3}(?:\.\d+)*[).:\-]?\s+\S", re.IGNORECASE)
BREAKS = (re.compile(r"(?<=\n)\s*\n"), re.compile(r"(?<=[.!?])\s+"))


def tokens(text: str) -> int:
    return sum(1 for _ in TOKEN.finditer(text))


def sections(text: str) -> list[tuple[list[str], str]]:
    """(heading path, body with its heading line) of each section; text before the first heading has an empty path.

    Two or more sections before the first one with a numbered heading are one, under the first's path, if they read like an agreement's opening.
    """
    marks = list(HEADING.finditer(text))
    out: list[tuple[list[str], str]] = []
    if not marks or text[: marks[0].start()].strip():
        out.append(([], text[: marks[0].start()] if marks else text))
    open_: list[tuple[int, str]] = []
    for m, end in zip(marks, [*(x.start() for x in marks[1:]), len(text)]):
        level = len(m[1])
        open_ = [*(x for x in open_ if x[0] < level), (level, m[2].strip())]
        out.append(([name for _, name in open_], text[m.start() : end]))
    first = next((i for i, (path, _) in enumerate(out) if path and NUMBERED.match(path[-1])), 0)
    opening = "".join(body for _, body in out[:first])
    if first > 1 and any(word in opening.lower() for word in INTRO):
        out = [(out[0][0], opening), *out[first:]]
    return out


def split(text: str, limit: int, level: int = 0) -> list[str]:
    """Segments of at most `limit` tokens whose concatenation is the text: cut at paragraphs, then sentences, then tokens."""
    if tokens(text) <= limit:
        return [text]
    if level == len(BREAKS):
        ends = [m.end() for m in TOKEN.finditer(text)]
        cuts = [0, *ends[limit - 1 :: limit]]
        return [text[a:b] for a, b in zip(cuts, [*cuts[1:], len(text)]) if b > a]
    cuts = [0, *(m.end() for m in BREAKS[level].finditer(text)), len(text)]
    out: list[str] = []
    held, held_tokens = "", 0
    for a, b in zip(cuts, cuts[1:]):
        piece = text[a:b]
        n = tokens(piece)
        if n > limit:
            if held:
                out.append(held)
                held, held_tokens = "", 0
            out.extend(split(piece, limit, level + 1))
        elif held_tokens + n > limit:
            out.append(held)
            held, held_tokens = piece, n
        else:
            held, held_tokens = held + piece, held_tokens + n
    return [*out, held] if held else out


#: Segments of up to so many tokens join a neighbour, which may then have so many tokens more than the limit.
TINY, SLACK = 25, 10


def rebalance(segments: list[str], limit: int) -> list[str]:
    """Tiny segments join the one before them, a tiny first one the next, where at most `limit` tokens come out. The text stays whole."""
    out: list[str] = []
    for segment in segments:
        if out and tokens(segment) <= TINY and tokens(out[-1] + segment) <= limit:
            out[-1] += segment
        else:
            out.append(segment)
    if len(out) > 1 and tokens(out[0]) <= TINY and tokens(out[0] + out[1]) <= limit:
        out[:2] = [out[0] + out[1]]
    return out


def parts_of(body: str, limit: int) -> list[str]:
    """A section as parents: whole up to `limit` tokens, else its body in parts, each below the section's heading line."""
    if tokens(body) <= limit:
        return [body]
    line = HEADING.match(body)
    head = body[: line.end()].rstrip("\n") + "\n" if line else ""
    rest = body[line.end() :].lstrip("\n") if line else body
    return [head + part for part in split(rest, max(min(100, limit), limit - tokens(head)))]


def chunks(text: str, parent_limit: int, child_limit: int, overlap: int) -> Iterator[tuple]:
    """(parent_order, heading_path, part_number, total_parts, parent_text, child_order, child_text): children overlap by `overlap` tokens."""
    order = 0
    for path, body in sections(text):
        if not body.strip():
            continue
        parts = parts_of(body, parent_limit)
        for number, part in enumerate(parts, 1):
            order += 1
            before: list[str] = []
            segments = rebalance(split(part, child_limit - overlap), min(child_limit - overlap + SLACK, child_limit))
            for child, segment in enumerate(segments, 1):
                own = [m.group() for m in TOKEN.finditer(segment)]
                room = min(overlap, child_limit - len(own))
                yield order, path, number, len(parts), part, child, "".join(before[len(before) - min(room, len(before)) :]) + segment
                before = own


CHUNK_SCHEMA = "document_id string, parent_order int, heading_path array<string>, part_number int, total_parts int, parent_text string, child_order int, child_text string"


def chunk(documents: DataFrame, parent_limit: int = 2000, child_limit: int = 300, overlap: int = 30) -> DataFrame:
    """Child chunks with their parents' columns and content-hash ids. `documents` has document_id and text; null and blank texts have none."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [f.split()[0] for f in CHUNK_SCHEMA.split(", ")]
        for pdf in batches:
            rows = [(key, *row) for key, text in zip(pdf["document_id"], pdf["text"]) for row in chunks(text, parent_limit, child_limit, overlap)]
            if rows:
                yield pd.DataFrame(rows, columns=names)

    found = documents.select(F.col("document_id").cast("string").alias("document_id"), "text").filter(F.col("text").rlike(r"\S")).mapInPandas(run, CHUNK_SCHEMA)
    found = found.withColumn("parent_chunk_id", content_id("parent", F.col("document_id"), F.col("parent_order"), F.col("parent_text")))
    return found.withColumn("child_chunk_id", content_id("child", F.col("document_id"), F.col("parent_chunk_id"), F.col("child_order") - 1, F.col("child_text")))
