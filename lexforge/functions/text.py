"""Text functions as Column expressions: tokens, plain text, sentences, paragraphs, canonical phrases, dates and citations."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Unicode white space, as both Java and RE2 read it.
BLANK = r"[\s\p{Z}\x{0b}\x{1c}-\x{1f}\x{85}]+"

#: Words that carry no meaning in a question.
STOP_WORDS = ("the", "a", "an", "is", "are", "what", "how", "when", "where", "why", "under", "for", "to", "of", "in", "on", "and", "or")


def whitespace_tokens(text: Column) -> Column:
    """Lower-case tokens between Unicode white space; null and blank texts give an empty list."""
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), BLANK), "")


def word_tokens(text: Column) -> Column:
    """Tokens as a chunker counts them: words, runs of white space, single other signs."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"(?U)\w+|\s+|[^\w\s]"), F.lit(0))


def token_count(text: Column) -> Column:
    return F.size(word_tokens(text))


def canonical(text: Column) -> Column:
    """Lower case, everything but a-z, 0-9 and blanks to a blank, blanks collapsed (accented letters go, on purpose)."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(text), r"[^a-z0-9\s]+", " "), r"\s+", " "))


def plain_text(markdown: Column) -> Column:
    """Markdown to text: code fences, inline code, heading marks, bullets and links lose their marks, then blanks collapse."""
    t = F.regexp_replace(markdown, r"(?s)```.*?```", " ")
    t = F.regexp_replace(t, r"`([^`]*)`", "$1")
    t = F.regexp_replace(t, r"(?m)^\s{0,3}#{1,6}\s+", "")
    t = F.regexp_replace(t, r"(?m)^\s*[-*+]\s+", "")
    t = F.regexp_replace(t, r"\[([^\]]+)\]\([^)]+\)", "$1")
    return F.trim(F.regexp_replace(t, r"\s+", " "))


def _stripped(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def sentences(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, r"(?<=[.!?])\s+"), _stripped), lambda s: s != "")


def paragraphs(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, r"\n\s*\n"), _stripped), lambda s: s != "")


def query_terms(text: Column) -> Column:
    """Distinct lower-case words of letters and digits (a-z, 0-9) that aren't stop words, in order."""
    words = F.regexp_extract_all(F.lower(text), F.lit(r"[a-z0-9]+"), F.lit(0))
    return F.filter(F.array_distinct(words), lambda w: ~w.isin(*STOP_WORDS))


#: The forms of references to sections, rules and statutes.
REFERENCES = (r"(?i)\bSection\s+[\w.\-()]+", r"(?i)\bRule\s+[\w.\-()]+", r"(?i)\b\d+\s+U\.S\.C\.\s+§+\s*[\w.\-()]+")


def legal_references(text: Column) -> Column:
    """Section, rule and statute references as written, those of each form in order, one form after the other."""
    return F.flatten(F.array(*[F.regexp_extract_all(text, F.lit(r), F.lit(0)) for r in REFERENCES]))


def dates(text: Column) -> Column:
    """Dates in the text, in order: ISO, `March 5, 2024`, `Mar 5, 2024`, `5 March 2024`; impossible ones are dropped."""
    month = "(?:January|February|March|April|May|June|July|August|September|October|November|December|Jan|Feb|Mar|Apr|Jun|Jul|Aug|Sep|Oct|Nov|Dec)"
    found = F.regexp_extract_all(text, F.lit(rf"\b\d{{4}}-\d{{2}}-\d{{2}}\b|\b{month} \d{{1,2}}, \d{{4}}\b|\b\d{{1,2}} {month} \d{{4}}\b"), F.lit(0))

    def parsed(d: Column) -> Column:
        formats = ("yyyy-MM-dd", "MMMM d, yyyy", "MMM d, yyyy", "d MMMM yyyy", "d MMM yyyy")
        return F.coalesce(*[F.call_function("try_to_date", d, F.lit(f)) for f in formats])

    return F.array_compact(F.transform(found, parsed))


def content_id(kind: str, *parts: Column) -> Column:
    """A content-hash id over NUL-separated parts; null parts count as empty."""
    return F.sha2(F.concat_ws("\x00", F.lit(kind), *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]), 256)


def uuid5(name: Column, namespace: str = "6ba7b8119dad11d180b400c04fd430c8") -> Column:
    """A version 5 UUID of a name in a namespace (given as 32 hex digits; by default the URL namespace)."""
    h = F.substring(F.sha1(F.concat(F.unhex(F.lit(namespace)), F.encode(name, "UTF-8"))), 1, 32)
    variant = F.lower(F.hex((F.conv(F.substring(h, 17, 1), 16, 10).cast("int").bitwiseAND(3)) + 8))
    bits = F.concat(F.substring(h, 1, 12), F.lit("5"), F.substring(h, 14, 3), variant, F.substring(h, 18, 15))
    return F.concat_ws("-", F.substring(bits, 1, 8), F.substring(bits, 9, 4), F.substring(bits, 13, 4), F.substring(bits, 17, 4), F.substring(bits, 21, 12))


#: A date as chronologies know it: ISO, or a month's name or its beginning, the day and the year.
EVENT_DATE = r"\d{4}-\d{2}-\d{2}|(?:jan|feb|mar|apr|may|jun|jul|aug|sep|sept|oct|nov|dec)[a-z]*\s+\d{1,2},\s*\d{4}"


def event_date(text: Column) -> Column:
    """The date of an EVENT_DATE match; null where it isn't one (a month misspelt, no blank after the comma, a day that doesn't exist)."""
    one = F.initcap(F.regexp_replace(text, r"\s+", " "))
    spaced = F.when(~text.rlike(r",\d"), one)
    return F.coalesce(F.call_function("try_to_date", text, F.lit("yyyy-MM-dd")), F.call_function("try_to_date", spaced, F.lit("MMMM d, yyyy")), F.call_function("try_to_date", spaced, F.lit("MMM d, yyyy")))


def normal_term(text: Column) -> Column:
    """Lower case, letters and digits in single blanks, a plural s taken off words of four letters or more."""
    low = F.trim(F.regexp_replace(F.lower(text), r"[^a-z0-9\s]", " "))
    return F.regexp_replace(F.regexp_replace(low, r"\b([a-z]{3,})s\b", "$1"), r"\s+", " ")


def _stem(word: Column) -> Column:
    return F.when((F.length(word) > 4) & word.endswith("es"), F.substring(word, F.lit(1), F.length(word) - 2)).when((F.length(word) > 3) & word.endswith("s"), F.substring(word, F.lit(1), F.length(word) - 1)).otherwise(word)


def topic_in_text(text: Column, topic: Column) -> Column:
    """Whether a topic's words are in the text: as they stand, or (two words of three letters or more) in order and close to one another.

    Words match if their stems are equal, or begin with the same six letters. Each takes its first match after the one before; the span is at
    most the greater of 6 and the number of words plus 3.
    """
    body, want = canonical(text), canonical(topic)
    words = F.transform(F.filter(F.split(body, " "), lambda w: w != ""), _stem)
    asked = F.transform(F.filter(F.split(want, " "), lambda w: F.length(w) >= 3), _stem)
    alike = lambda a, b: (a == b) | ((F.length(a) >= 6) & (F.length(b) >= 6) & (F.left(a, F.lit(6)) == F.left(b, F.lit(6))))
    start = F.struct(F.lit(0).alias("at"), F.lit(0).alias("first"))

    def step(state: Column, word: Column) -> Column:
        hits = F.filter(F.transform(words, lambda w, i: F.when(alike(word, w) & (i >= state["at"]), i + 1)), lambda i: i.isNotNull())
        at = F.when(state["at"] >= 0, F.coalesce(F.get(hits, F.lit(0)), F.lit(-1))).otherwise(-1)
        return F.struct(at.alias("at"), F.when(state["first"] == 0, at).otherwise(state["first"]).alias("first"))

    found = F.aggregate(asked, start, step)
    close = (F.size(asked) >= 2) & (F.size(words) >= 2) & (found["at"] > 0) & (found["at"] - found["first"] <= F.greatest(F.lit(6), F.size(asked) + 3))
    return F.coalesce((body != "") & (want != "") & (F.contains(body, want) | close), F.lit(False))


def date_boundary(text: Column, lower: bool) -> Column:
    """The day that `after` or `since` a year (lower), or `before` or `until` it, sets as a bound; null without a year or such a word."""
    year = F.nullif(F.regexp_extract(text, r"\b((?:19|20)\d{2})\b", 1), F.lit(""))
    words = ("after", "since") if lower else ("before", "until")
    said = F.contains(F.lower(text), F.lit(words[0])) | F.contains(F.lower(text), F.lit(words[1]))
    return F.when(said, F.concat(year, F.lit("-01-01" if lower else "-12-31")))


def hint_confidence(subject: Column, hint: Column) -> Column:
    """How well a hint names a subject: 1 for the same phrase, the ratio of their word counts where one holds the other, else shared words by
    the longer one's count."""
    a, b = canonical(subject), canonical(hint)
    x, y = F.split(a, " "), F.split(b, " ")
    longer, shorter = F.greatest(F.size(x), F.size(y)), F.least(F.size(x), F.size(y))
    score = F.when(a == b, 1.0).when(F.contains(a, b) | F.contains(b, a), shorter / longer).otherwise(F.size(F.array_intersect(x, y)) / longer)
    return F.when((F.coalesce(a, F.lit("")) == "") | (F.coalesce(b, F.lit("")) == ""), 0.0).otherwise(F.round(score, 6))


def safe_count(value: Column) -> Column:
    """A count from a variant: whole numbers from 0 on, also as text; booleans, fractions, negative numbers and other text are null."""
    kind = F.schema_of_variant(value)
    text = F.trim(F.try_variant_get(value, "$", "string"))
    number = F.when(kind.isin("BIGINT", "STRING") & text.rlike(r"^[+-]?\d+$"), text.try_cast("bigint")).when(kind.startswith("DECIMAL") | (kind == "DOUBLE"), F.when(text.try_cast("double") % 1 == 0, text.try_cast("double").try_cast("bigint")))
    return F.when(number >= 0, number)


def json_object(text: Column) -> Column:
    """The JSON of an answer: inside a code fence, else as it stands, else from its first brace to its last; null where none is valid."""
    bare = F.trim(F.regexp_replace(text, r"^\s+|\s+$", ""))
    inner = F.nullif(F.regexp_extract(bare, r"(?is)^```(?:json)?\s*(.*?)\s*```$", 1), F.lit(""))
    candidate = F.coalesce(inner, bare)
    block = F.nullif(F.regexp_extract(candidate, r"(?s)(\{.*\})", 1), F.lit(""))
    closed = lambda c: F.when(c.rlike(r"(?s)^(\{.*\}|\[.*\])$"), F.try_parse_json(c))
    return F.coalesce(closed(candidate), closed(block))


#: Words two of which let a question be split at `and`.
SPLIT_ANCHORS = ("what is", "what are", "compare", "difference", "definition", "enforcement", "remedy", "elements", "defenses", "jurisdiction", "procedural", "substantive")


def sub_queries(query: Column) -> Column:
    """The parts of a question, once each and in order: at semicolons; at the first `and` of a rule with an exception; at each `and` of a part
    with two anchor words."""
    strip = lambda s: F.regexp_replace(s, r"^[ .]+|[ .]+$", "")
    parts = F.filter(F.transform(F.split(F.trim(F.regexp_replace(query, r"\s+", " ")), r"\s*;\s*"), strip), lambda p: p != "")

    def split(part: Column) -> Column:
        low = F.lower(part)
        joined = F.contains(low, F.lit(" and "))
        rule = F.contains(low, F.lit("rule")) & F.contains(low, F.lit("exception")) & joined
        anchors = sum((F.contains(low, F.lit(a)).cast("int") for a in SPLIT_ANCHORS), F.lit(0))
        pieces = F.when(rule, F.split(part, r"(?i)\band\b", 2)).when(joined & (anchors >= 2), F.split(part, r"(?i)\band\b")).otherwise(F.array(part))
        return F.filter(F.transform(pieces, strip), lambda p: p != "")

    return F.array_distinct(F.flatten(F.transform(parts, split)))


def version_or(value: Column, default: str = "unknown") -> Column:
    """A version as given, trimmed; blank and null ones are the default."""
    return F.coalesce(F.nullif(F.trim(value), F.lit("")), F.lit(default))
