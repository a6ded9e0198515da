"""Template residue, filler, error pages and script notices in place of content.

Three kinds of evidence are put together for every document, whatever its length:

* Terms. Each unit (line or sentence) is compared with two term profiles: that of texts which look like residue, and that of all others. The
  first is seeded by detectors and by host evidence (units that short texts of several hosts share although they match neither slug nor title),
  and it then speaks for wordings that no detector names. Profiles are counts over all documents in a hashed vocabulary of fixed size.
* Slug and title. A body that shares no term with its slug (document type, jurisdiction) or its title needs less term evidence.
* Detectors: patterns of unfilled fields, filler and notices, behind plain substring cues that one pass over a text finds.

The text work is Column expressions in one scan; its result is written once. Only hashed counts (a bounded array) reach the driver.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexforge.session import cut

# Wordings of unfilled fields, filler, error pages and script notices. Java regular expressions.

_FILL = "insert|enter|fill in|complete|tbc|tbd|to be (?:completed|confirmed|inserted|determined)|ins[ée]rer|saisir|[àa] compl[ée]ter|einf[üu]gen|eintragen|insertar|completar|por completar|a completar"

#: Unfilled template fields, each group behind its cues. Quoted mentions are removed before these apply.
PLACEHOLDERS = (
    (("{",), (r"\{\{[^{}\n]{1,80}\}\}", r"\{%[^%\n]{1,80}%\}", r"\{![^}\n]{2,80}\}", r"(?<![{$!%\\])\{\p{L}[\p{L}\p{N}_]{2,40}\}(?!\})")),
    (("<%", "<<", "«", "@@", "__", "~"), (r"<%[^%\n]{1,80}%>", r"<<[^<>\n]{2,60}>>", r"«\p{L}[\p{L}\p{N}_]*(?: [\p{L}\p{N}_]+){0,4}»", r"@@[\p{L}\p{N}_ ]{2,40}@@", r"__\p{Lu}[\p{Lu}\p{N}_]{1,40}__", r"(?<!~)~\p{Ll}[\p{Ll}\p{N}_]{2,40}~(?!~)")),
    (("$[", "${", "$(", "$X", "$ X"), (r"\$[\[{(]\p{L}[^\])}\n]{1,60}[\])}]", r"\$\s?X[X,.]{2,}")),
    (("%",), (r"%{1,2}\p{Lu}[\p{Lu}\p{N}_]{2,40}%",)),
    (("#",), (r"#\p{Lu}[\p{Lu}\p{N}_]{2,40}#",)),
    (("X/", "X-", "X."), (r"\bXX?[/.-]XX?[/.-](?:[X\d]{2,4})\b",)),
    (
        ("[",),
        (
            r"\[\[[^\[\]\n]{2,60}\]\]",
            r"\[\s*[•●]\s*\]",
            r"\[(?!SIC\]|REDACTED|EMPHASIS|CITATIONS?|FOOTNOTES?|TRANSLAT|SEAL\]|AT\]|DOT\]|ORIGINAL|ILLEGIBLE|INAUDIBLE|PAUSE|SIGNED|SIGNATURE|END)\p{Lu}[\p{Lu}\p{N}'’ _/-]{2,50}\]",
            rf"(?iu)\[[^\[\]\n]{{2,60}}(?:[:,-]|\s)\s*(?:{_FILL})\s*\]",
        ),
    ),
    (
        ("<",),
        (
            r"<(?!/|NOSCRIPT|SCRIPT|HTML|HEAD|BODY|TITLE|TABLE|TBODY|SPAN|DIV|STRONG|CENTER|FONT|STYLE|META|LINK|LIST|FOOTER|HEADER|SECTION)\p{Lu}[\p{Lu}\p{N}'’ _-]{2,50}>",
            rf"(?iu)<(?:{_FILL})\s[^<>\n]{{1,60}}>",
        ),
    ),
    (("[", "("), (rf"(?iu)[\[(](?:{_FILL})\b(?:[^\])\n]{{0,60}})[\])]",)),
)

#: The words of the standard filler passage, or their stems; up to four more letters may follow each.
_LATIN = (
    "lorem|ipsum|dolor|sit|amet|consect|adipis|elit|sed|eiusm|tempor|incidu|labor|magn|aliqu|enim|minim|venia|quis|nostr|exerci|ullam|nisi|commod|consequ|duis|aute|irur|reprehen|volupt|velit|esse|cill|eu|fugi|null|pariatu|"
    "ex|except|sint|occaec|cupid|proid|sunt|culp|offic|deser|moll|anim|vel"
)
_PART = "heading|title|text|content|paragraph|clause|wording|body copy|copy|section|sentence"
_PLACE = r"will appear here|goes here|here|for layout only|to be replaced"

#: Four words of filler Latin in a row, in lower-case text.
LATIN_RUN = rf"(?:\b(?:{_LATIN})\p{{L}}{{0,4}}\b[\s,.;]+){{4,}}"

#: Texts without any of these hold no such run: four of its words in a row have one of them at least.
LATIN_CUES = ("lorem", "ipsum", "dolor", "amet", "consect", "adipis", "eiusm", "elit", "incidu", "labor", "magn", "aliqu", "enim", "minim", "venia", "nostr", "exerci", "ullam", "nisi", "commod", "duis", "irur", "reprehen", "volupt", "velit", "cill", "fugi", "null", "pariatu", "occaec", "cupid", "proid", "deser", "moll")

#: Texts without any of these hold no unit of FILLER_UNITS.
FILLER_CUES = ("your ", "example", "sample", "dummy", "placeholder", "\ntest ", ". test ", "insert test", "generic", "filler", "mock", "xx", "zz", "texte", "paragraphe d", "ici ", "ins\u00e9rer", "inserer", "beispiel", "blindtext", "platzhalter", "mustertext", "lltext", "ihr text", "rrafo de ejemplo", "parrafo de ejemplo", "texto", "su texto", "inserte")

#: Filler as a whole unit.
FILLER_UNITS = (
    rf"(?iu)^\W*(?:insert )?(?:your|example|sample|dummy|placeholder|test|generic|filler|mock) (?:{_PART})(?: (?:{_PART}))?\s*(?:{_PLACE})?\W*$",
    # set apart by a dash, or with what it is for
    rf"(?iu)^\W*(?:insert )?(?:your|example|sample|dummy|placeholder|test|generic|filler|mock) (?:{_PART})(?: (?:{_PART}))?(?:\s*[-–—:]\s*|\s+(?:to|will)\s+)(?:\p{{L}}+\s?){{1,6}}\W*$",
    r"(?iu)^\W*(?:(?:x{2,}|z{2,})\b\s*){3,}\W*$",
    r"(?iu)^\W*(?:votre texte ici|texte fictif|texte d'exemple|paragraphe d'exemple|faux texte|ins[ée]rer (?:le|votre|ici) (?:contenu|texte))\b.{0,50}$",
    r"(?iu)^\W*(?:beispiel(?:absatz|text)|blindtext|platzhalter(?:text)?|mustertext|f[üu]lltext|ihr text hier|hier steht ihr text|hier text einf[üu]gen)\b.{0,50}$",
    r"(?iu)^\W*(?:p[áa]rrafo de ejemplo|texto de (?:relleno|ejemplo|muestra)|su texto aqu[íi]|texto aqu[íi]|inserte (?:su|el) (?:texto|contenido))\b.{0,50}$",
)

_SCRIPT = r"(?:java ?scripts?|(?:active )?script(?:s|ing)|js)(?: and cookies)?"
_REASON = (
    "bad request|unauthorized|payment required|method not allowed|not acceptable|request time-?out|length required|precondition failed|payload too large|uri too long|unsupported media type|"
    "too many requests|internal server error|not implemented|bad gateway|service (?:temporarily )?unavailable|gateway time-?out|insufficient storage|unprocessable (?:entity|content)|not found|http version not supported"
)
_THING = (
    r"(?:(?:the|this|that|your|our|an?|it|la|le|cette|die|das|der|el) )?(?:\p{L}+ ){0,3}?(?:file|page|document|record|exhibit|transcript|scan|attachment|item|entry|link|session|token|permit|login|password|connection|archive|service|registry|portal|viewer|"
    r"site|docket|server|app|application|player|form|preview|account|download|image|folder|resource|url)s?(?: (?:you asked for|to view|requested))?(?: (?:[a-z]{0,2}-?\d+))?"
)
_OPEN = r"(?:(?:sorry|oops|notice|error|warning|we are sorry|we're sorry|access denied|login required|fatal)\s*[.,!:-]*\s*)?"
_STATE = (
    r"(?:(?:could ?not|couldn't|can ?not|can't) be (?:loaded|found|opened|read|shown|displayed|converted|rendered|processed|reached)(?: to text)?|(?:could not|couldn't|failed to) (?:open|load|render|convert|start|respond)|do(?:es)? not exist|no longer exists?|"
    r"(?:has|have) (?:been (?:moved|deleted|removed|revoked|moved or deleted)|expired|timed out)|(?:is|are) (?:temporarily |currently |momentarily )?(?:unavailable|not available|no longer available|offline|overloaded|busy|too busy|corrupted|corrupted or password protected|password protected|not valid|invalid|"
    r"not accessible(?: with your account)?|down(?: for maintenance)?|under(?:going)? (?:scheduled )?maintenance)|(?:was|were) (?:revoked|not found|moved|deleted|rejected)|timed out|expired)"
)

#: Texts without any of these hold no unit of NOTICE_UNITS.
NOTICE_CUES = (
    "script", " js", "js ", "browser", "navegador", "skript", "cookies", "loading", "checking your", "if nothing appears", "\nerror", ". error", "error:", "error at ", "erreur", "fehler", "exception", "fault at ", "fatal", "traceback", "http", "\nstatus", "server re", "server error",
    "bad request", "unauthorized", "payment required", "not allowed", "not acceptable", "time-out", "timeout", "length required", "precondition failed", "too large", "too long", "unsupported media", "too many requests", "not implemented", "bad gateway",
    "unavailable", "insufficient storage", "unprocessable", "not found", "not supported", "forbidden", "gone", "conflict", "locked", "access denied", "login required", "permission denied", "acc\u00e8s refus", "acces refus", "acceso denegado", "verweigert",
    "not be ", "couldn't be", "can't be", "failed to", "could not", "couldn't", "not exist", "no longer", "been moved", "been deleted", "been removed", "been revoked", "expired", "timed out", "not available", "offline", "overloaded", "busy",
    "corrupted", "password protected", "not valid", "invalid", "not accessible", "is down", "are down", "maintenance", "revoked", "were moved", "was moved", "was deleted", "were deleted", "was rejected", "were rejected", "ocr ", "conversion", "empty response", "rate limited",
    "no preview", "unsupported file", "no text", "n'existe plus", "expir\u00e9", "indisponible", "introuvable", "konnte nicht", "nicht gefunden", "nicht erreichbar", "nicht verf", "abgelaufen", "caducado", "expirado", "no est", "no se ", "no existe", "ya no",
)

#: Error messages and script notices as a whole unit.
NOTICE_UNITS = (
    rf"(?iu)^\W*{_OPEN}{_THING} {_STATE}(?: right now| at (?:this|the) (?:time|moment)| at present| yet)?(?: (?:for about|for|until|after|in) [\p{{L}}\p{{N}}, -]{{1,40}})?\W*$",
    rf"(?iu)^\W*(?:(?:http(?:/\d(?:\.\d)?)?|error|status)(?: code)?\s*[:#-]?\s*)?[1-5]\d\d\s*[-–:.]?\s*(?:{_REASON}|forbidden|gone|conflict|locked)\W*$",
    rf"(?iu)^\W*(?:{_REASON})\W*$",
    r"(?iu)^\W*(?:http(?:/\d(?:\.\d)?)?|error|status|erreur|fehler)(?: code)?\s*[:#-]?\s*\d{1,4}\s*[:.]?(?:\s.{0,60})?$",
    r"(?iu)^\W*server (?:returned|responded with|error) \d{3}\b.{0,40}$",
    r"(?iu)^\W*(?:access denied|login required|acc[èe]s refus[ée]|acceso denegado|zugriff verweigert|permission denied)\W*$",
    r"(?iu)^\W*(?:unhandled exception|fatal(?: error)?:?\s+\w*(?:error|exception)|traceback \(most recent call last\))",
    r"(?iu)^\W*(?:fatal\S{0,3}\s+)?(?:[\w.$]*(?:error|exception|fault)|[\w-]{2,20}-\d{2,6})(?:: .{0,80})? at [\w.$]+\(",
    r"(?iu)^\W*fatal\S{0,3}\s+(?:[\w$]+\.[\w.$]+|[A-Z]{2,8}-\d{2,6})\b",
    r"^\W*[A-Z]{2,8}-\d{4,6}: \S",
    r"^\W*(?:[\w.]+\.)?\w+(?:Error|Exception): \S",
    r"(?iu)^\W*(?:ocr (?:engine )?returned|conversion job \S+ (?:finished|failed|ended)|empty response from|you have been rate limited|no preview available|unsupported file format|no text (?:could be|was) extracted)\b",
    r"(?iu)^\W*(?:cette page n'existe plus|la conversion du fichier \S+ a [ée]chou[ée]|votre session a expir[ée]|le (?:service|document|site) est (?:momentan[ée]ment|temporairement) indisponible)\b.{0,40}",
    r"(?iu)^\W*(?:erreur|fehler|error) \d+\s*:",
    r"(?iu)^\W*.{0,50}\b(?:document|fichier|page)\b.{0,20}\best introuvable\W*$",
    r"(?iu)^\W*(?:die|das|der) (?:datei|dokument|seite|dienst|server|sitzung)\b.{0,30}(?:konnte nicht \p{L}+ werden|wurde nicht gefunden|nicht erreichbar|nicht verf[üu]gbar|ist abgelaufen)\W*$",
    r"(?iu)^\W*(?:ihre sitzung ist abgelaufen|la sesi[óo]n ha (?:caducado|expirado)|el (?:servicio|documento|archivo|sitio)\b.{0,30}(?:no est[áa] disponible|no se (?:pudo|encontr[óo]|ha podido))|la p[áa]gina\b.{0,20}(?:no existe|no se encontr[óo]|ya no existe)|no se (?:pudo|ha podido) (?:cargar|abrir|convertir|encontrar))\b.{0,50}",
    rf"(?iu)^\W*(?:please )?(?:enable|activate|allow|turn on|switch on|unblock) {_SCRIPT}\b(?! in order).{{0,60}}$",
    rf"(?iu)^\W*(?:this|the|our|you|your) [\p{{L}} -]{{0,30}}?(?:needs?|requires?|relies on|depends on|uses|(?:does|do|will) not (?:work|run|load|open) without|must have|must (?:enable|allow)) {_SCRIPT}\b.{{0,50}}$",
    rf"(?iu)^\W*(?:loading|checking)\b.{{0,60}}{_SCRIPT}\b.{{0,40}}$",
    r"(?iu)^\W*(?:loading [\p{L} -]{2,30}\.\.\.|checking your browser\b.{0,60}|if nothing appears, .{0,60})$",
    rf"(?iu)^\W*{_SCRIPT} (?:(?:is|are) )?(?:(?:must|ha(?:s|ve) to|should|needs? to) be|disabled|turned off|switched off|required|needed|blocked|not (?:allowed|enabled|supported|running|available))\b.{{0,60}}$",
    rf"(?iu)^\W*your browser (?:is|does|has|blocks?|doesn't|isn't|set)\b.{{0,40}}{_SCRIPT}\b.{{0,40}}$",
    r"(?iu)^\W*(?:veuillez activer|activez|merci d'activer) (?:le |les )?(?:javascript|scripts?)\b.{0,60}$",
    r"(?iu)^\W*(?:javascript|les scripts?) (?:est|sont|doit|doivent)\b.{0,60}(?:bloqu|d[ée]sactiv|activ|autoris|requis).{0,40}$",
    r"(?iu)^\W*(?:ce|cette|cet|le|la) .{0,40}(?:ne fonctionne pas sans|(?:ne )?fonctionne (?:qu.avec|uniquement avec)|n[ée]cessite|requiert|a besoin de) (?:le |les )?(?:javascript|scripts?)\b.{0,40}$",
    r"(?iu)^\W*(?:diese[rs]?|der|die|das) .{0,40}(?:ben[öo]tigt|erfordert|funktioniert (?:nicht ohne|nur mit)|braucht) (?:javascript|skripte|scripts?)\b.{0,40}$",
    r"(?iu)^\W*(?:est[ea]|el|la) .{0,40}(?:requiere|necesita|no funciona sin|s[óo]lo funciona con) (?:el |los )?(?:javascript|scripts?)\b.{0,40}$",
    r"(?iu)^\W*(?:bitte )?(?:aktivieren sie|erlauben sie) (?:bitte )?(?:javascript|skripte|scripts)\b.{0,60}$",
    r"(?iu)^\W*(?:javascript|skripte|ihr browser)\b.{0,40}(?:deaktiviert|blockiert|erforderlich|ben[öo]tigt|aktiviert werden).{0,40}$",
    r"(?iu)^\W*(?:por favor,? )?(?:active|habilite|permita|active usted) (?:el |los )?(?:javascript|scripts?)\b.{0,60}$",
    r"(?iu)^\W*(?:javascript|su navegador|los scripts?)\b.{0,40}(?:bloque|desactivad|deshabilitad|necesari|permitid|activad).{0,40}$",
)

#: Error pages recognised in their markup, before tags and quotes are removed.
RAW_NOTICES = (
    r"(?iu)<noscript",
    r"(?iu)\{\s*\"(?:error|errors|status|code|message)\"\s*:",
    rf"(?iu)<(title|h1)>\s*(?:\d{{3}}\s*)?(?:{_REASON}|forbidden|gone|conflict|error)\s*</\1>",
    r"(?iu)traceback \(most recent call last\)",
)

#: Size of the hashed vocabulary, as a power of two: what the driver and each task hold of it doesn't grow with the data.
VOCABULARY_BITS = 18

#: A text of up to so many distinct words is one of low information.
PLAIN_WORDS = 40

#: A unit in so many documents, of two hosts or matters at least, counts as copied.
COPIES = 3

#: The mean log-odds a term that flags a unit, and what a mismatch with the slug or with the title takes off it.
NEEDED, MISMATCH = 1.0, 0.25

#: Words and phrases that alone prove nothing, but count with host evidence.
WEAK_WORDS = (
    "error", "errors", "unavailable", "denied", "expired", "forbidden", "javascript", "browser", "cookie", "cookies", "script", "scripts", "reload", "refresh", "login", "timeout", "maintenance", "placeholder", "lorem", "sample", "dummy",
    "template", "exception", "server", "introuvable", "indisponible", "fehler", "erreur",
)
WEAK_PHRASES = ("not found", "sign in", "log in", "timed out", "time out", "coming soon", "under construction", "no content", "no disponible")

#: The score from which host evidence flags a text: one each for slug, title, low information and a weak word, up to COPIED for copies.
SCORE, COPIED = 5.0, 2.0

#: So many copies of a text's rarest unit count in full, fewer by their logarithm.
MANY = 8

#: Units of fewer distinct terms are flagged only where they are copied.
FEW_TERMS = 3

#: Documents' worth of prior behind each term's share in a profile, and the bound of one term's log-odds.
PRIOR, BOUND = 2.0, 4.0


def cleaned(text: Column) -> Column:
    """One kind of blank, one kind of line end, the common character references decoded."""
    has = lambda sign: F.contains(text, F.lit(sign))
    t = F.when(has("\r"), F.regexp_replace(text, "\r\n?", "\n")).otherwise(text)
    t = F.regexp_replace(t, r"[\t\x0B\f\u00A0\u1680\u2000-\u200B\u202F\u205F\u3000\uFEFF]+| {2,}", " ")
    decoded = t
    for reference, sign in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&nbsp;", " "), ("&amp;", "&")):
        decoded = F.replace(decoded, F.lit(reference), F.lit(sign))
    return F.when(has("&"), decoded).otherwise(t)


def _any(text: Column, patterns: tuple[str, ...]) -> Column:
    """Whether any pattern is found; the patterns are tried one after the other, the first that fits ends it."""
    hit = F.lit(False)
    for p in patterns:
        hit = hit | text.rlike(p)
    return hit


def _cued(text: Column, cues: tuple[str, ...]) -> Column:
    """Whether any cue is in the text: a plain substring search, before the dearer patterns."""
    hit = F.lit(False)
    for c in cues:
        hit = hit | F.contains(text, F.lit(c))
    return hit


def _placeholders(text: Column) -> Column:
    hit = F.lit(False)
    for cues, patterns in PLACEHOLDERS:
        hit = hit | (_cued(text, cues) & _any(text, patterns))
    return hit


#: The bit of each set of cues in `_cue_bits`.
LATIN, FILLER, NOTICE, WEAK = 1, 2, 4, 8


def _cue_bits(low: Column) -> Column:
    """Which sets of cues a lower-case text has: all of them in one pass over each text (Aho-Corasick), in Arrow batches."""

    @F.pandas_udf("int")
    def bits(texts: pd.Series) -> pd.Series:
        import ahocorasick

        automaton = ahocorasick.Automaton()
        for bit, cues in ((LATIN, LATIN_CUES), (FILLER, FILLER_CUES), (NOTICE, NOTICE_CUES), (WEAK, WEAK_PHRASES)):
            for cue in cues:
                automaton.add_word(cue, automaton.get(cue, 0) | bit)
        automaton.make_automaton()

        def of(text: str) -> int:
            found = 0
            for _, bit in automaton.iter(text):
                found |= bit
            return found

        return texts.map(of)

    return bits(low)


def _words(text: Column) -> Column:
    """The words of a unit in lower case, without digits: numbers, and codes of one letter, don't count."""
    return F.filter(F.split(F.lower(F.translate(text, "0123456789", "")), r"[^\p{L}]+"), lambda w: F.length(w) > 1)


def evidence(documents: DataFrame) -> DataFrame:
    """One row per document with text: doc_id, host, matter_id, kind of the detectors (template, filler, notice, or null), plain (how many
    distinct words), missed (0 to 2: slug and title that share no term with the body), score (of host evidence, but for copies), units (hash of
    its words, hashes of its distinct terms).

    Null and blank texts have no row. Quoted mentions are removed first, so a text that only quotes such things isn't flagged.
    """
    d = documents.filter(F.col("text").rlike(r"\S")).withColumn("_t", cleaned(F.col("text")))
    d = d.withColumn("_q", F.when(_cued(F.col("_t"), ('"', "“", "„")), F.regexp_replace("_t", r"\"[^\"\n]*\"|“[^”\n]*”|„[^“\n]*“", " ")).otherwise(F.col("_t")))
    d = d.withColumn("_l", F.concat(F.lit("\n"), F.lower("_q")))
    d = d.withColumn("_c", _cue_bits(F.col("_l")))
    has = lambda bit: F.col("_c").bitwiseAND(bit) > 0
    lines = F.when(F.contains("_q", F.lit("<")), F.regexp_replace("_q", r"</?(?i:html|head|body|title|h[1-6]|p|div|br|span|noscript)[^<>]{0,80}>", "\n")).otherwise(F.col("_q"))
    d = d.withColumn("_u", F.filter(F.split(lines, r"\n+|(?<=[.!?])\s+"), lambda u: F.length(u) > 2))
    d = d.withColumn("_w", F.transform("_u", _words))
    # a unit of one word said five times or more, or of eight words or more with each said four times on average
    few = lambda w: F.size(F.array_distinct(w)) * F.when(F.size(w) >= 8, 4).otherwise(F.size(w)) <= F.size(w)
    monotone = F.exists("_u", lambda u: (lambda w: (F.size(w) >= 5) & few(w))(F.split(F.lower(F.trim(u)), " ")))
    kind = (
        F.when(_placeholders(F.col("_q")), "template")
        .when((has(LATIN) & F.col("_l").rlike(LATIN_RUN)) | monotone | (has(FILLER) & F.exists("_u", lambda u: _any(u, FILLER_UNITS))), "filler")
        .when(_any(F.col("_t"), RAW_NOTICES) | (has(NOTICE) & F.exists("_u", lambda u: _any(u, NOTICE_UNITS))), "notice")
    )
    terms = lambda text: F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: F.length(w) > 3)
    slug = terms(F.concat_ws(" ", "document_type", "jurisdiction"))
    title = terms(F.when(F.contains("_t", F.lit("#")), F.regexp_extract("_t", r"(?m)^#{1,6} +(\S.*)$", 1)).otherwise(""))
    body = F.when(F.contains("_l", F.lit("#")), F.regexp_replace("_l", r"(?m)^#{1,6} .*$", " ")).otherwise(F.col("_l"))
    d = d.withColumn("_b", body)
    missed = lambda words: (~F.exists(words, lambda w: F.contains(F.col("_b"), w))).cast("int")
    hashes = lambda w: F.transform(F.array_distinct(w), lambda t: F.pmod(F.xxhash64(t), F.lit(1 << VOCABULARY_BITS)).cast("int"))
    units = F.transform("_w", lambda w: F.struct(F.xxhash64(w).alias("unit"), hashes(w).alias("terms")))
    d = d.withColumns({"_d": F.array_distinct(F.flatten("_w")), "_m": missed(slug) + missed(title)})
    weak = has(WEAK) | F.arrays_overlap("_d", F.array(*[F.lit(w) for w in WEAK_WORDS]))
    score = F.col("_m") + F.least(F.lit(1.0), PLAIN_WORDS / F.greatest(F.size("_d"), F.lit(1))) + weak.cast("int")
    host = F.lower(F.trim("source")).alias("host")
    return d.select("doc_id", host, "matter_id", kind.alias("kind"), F.size("_d").alias("plain"), F.col("_m").alias("missed"), score.alias("score"), units.alias("units"))


def _several(group: DataFrame) -> DataFrame:
    """Units that are copied: in COPIES documents at least, from two hosts or matters. Counts are pre-aggregated before the shuffle."""
    ends = [f(c).alias(f"_{f.__name__}_{c}") for c in ("host", "matter_id") for f in (F.min, F.max)]
    counted = group.groupBy("unit").agg(F.count("*").alias("n"), *ends)
    return counted.filter((F.col("n") >= COPIES) & ((F.col("_min_host") != F.col("_max_host")) | (F.col("_min_matter_id") != F.col("_max_matter_id"))))


def seeded(found: DataFrame) -> Column:
    """Whether a document seeds the residue profile by a detector: filler or a notice, with little else in it."""
    return F.coalesce(F.col("kind").isin("filler", "notice") & (F.col("plain") <= PLAIN_WORDS), F.lit(False))


def duplicates(found: DataFrame) -> DataFrame:
    """doc_id and terms of the documents that host evidence flags: mismatched texts of low information, all of whose units are copied."""
    open_ = found.filter(F.col("kind").isNull() & (F.col("score") >= SCORE - COPIED)).select("doc_id", "host", "matter_id", "score", F.explode("units").alias("u")).select("doc_id", "host", "matter_id", "score", "u.unit", "u.terms")
    weight = F.least(F.lit(1.0), F.log2("n") / F.log2(F.lit(float(MANY))))
    placed = open_.join(_several(open_).select("unit", weight.alias("copied")), "unit", "left")
    rarest = placed.groupBy("doc_id", "score").agg(F.min(F.coalesce("copied", F.lit(0.0))).alias("copied"), F.array_distinct(F.flatten(F.collect_list("terms"))).alias("terms"))
    return rarest.filter((F.col("copied") > 0) & (F.col("score") + COPIED * F.col("copied") >= SCORE)).select("doc_id", "terms")


def term_odds(found: DataFrame, copied: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Log-odds of each hashed term between the two profiles, for a document of the other texts and for a seed.

    A document's own count is left out of its profile, so a term is judged by other documents alone; a term of one document has odds of 0.
    """
    size = 1 << VOCABULARY_BITS
    own = found.select(seeded(found).alias("seed"), F.array_distinct(F.flatten(F.transform("units", lambda u: u["terms"]))).alias("terms"))
    counts = own.select("seed", F.explode("terms").alias("term")).groupBy("term").agg(F.count_if("seed").alias("a"), F.count_if(~F.col("seed")).alias("b"))
    shared = copied.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("a"), F.lit(0).cast("bigint").alias("b"))
    total = found.agg(F.count_if(seeded(found)).alias("a"), F.count_if(~seeded(found)).alias("b")).union(copied.agg(F.count("*"), F.lit(0).cast("bigint"))).agg(F.sum("a"), F.sum("b")).first()
    rows = counts.unionByName(shared).groupBy("term").agg(F.sum("a").alias("a"), F.sum("b").alias("b")).toPandas()  # VOCABULARY_BITS bounds it
    a, b = np.zeros(size), np.zeros(size)
    a[rows["term"].to_numpy(dtype=np.int64)], b[rows["term"].to_numpy(dtype=np.int64)] = rows["a"], rows["b"]
    na, nb = (float(x or 0) for x in total)
    if not na or not nb:
        return np.zeros(size, np.float32), np.zeros(size, np.float32)
    share = lambda c, n: np.log((np.maximum(c, 0) + PRIOR * n / (na + nb)) / n)
    odds = lambda x, y: np.clip(share(x, na) - share(y, nb), -BOUND, BOUND).astype(np.float32)
    return odds(a, b - 1), odds(a - 1, b)


HIT_SCHEMA = "doc_id bigint, host string, matter_id string, unit bigint, terms int"


def unit_hits(found: DataFrame, odds: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """HIT_SCHEMA of each unit whose terms speak for residue: their mean log-odds reach NEEDED, less MISMATCH for slug and for title."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            units = batch.column("units")
            of_doc = pc.list_parent_indices(units).to_numpy()
            unit, terms = units.flatten().flatten()
            of_unit = pc.list_parent_indices(terms).to_numpy()
            term = terms.flatten().to_numpy()
            seed = batch.column("seed").to_numpy(zero_copy_only=False).astype(bool)[of_doc][of_unit]
            n = np.bincount(of_unit, minlength=len(unit))
            mean = np.bincount(of_unit, weights=np.where(seed, odds[1][term], odds[0][term]), minlength=len(unit)) / np.maximum(n, 1)
            hit = np.flatnonzero((n > 0) & (mean >= NEEDED - MISMATCH * batch.column("missed").to_numpy()[of_doc]))
            docs = batch.select(["doc_id", "host", "matter_id"]).take(pa.array(of_doc[hit]))
            yield pa.RecordBatch.from_arrays([*docs.columns, unit.take(pa.array(hit)), pa.array(n[hit].astype(np.int32))], names=["doc_id", "host", "matter_id", "unit", "terms"])

    return found.select("doc_id", "host", "matter_id", "missed", seeded(found).alias("seed"), "units").mapInArrow(run, HIT_SCHEMA)


def reasons(documents: DataFrame) -> DataFrame:
    """One row per document that is no real content: doc_id, kind, by_detector, by_hosts, by_terms.

    kind is the detectors' (template, filler, notice), else `duplicate` where host evidence flags it, else `combined` by its terms.
    """
    found = cut(evidence(documents), "residue")
    copied = cut(duplicates(found), "residue-copied")
    hits = cut(unit_hits(found, term_odds(found, copied)), "residue-hits")
    enough = hits.filter(F.col("terms") >= FEW_TERMS).select("doc_id")
    few = hits.filter(F.col("terms") < FEW_TERMS)
    repeated = _several(few.select("unit", "host", "matter_id", "doc_id").distinct()).select("unit")
    by_terms = enough.union(few.join(repeated, "unit", "left_semi").select("doc_id"))
    no, yes, none = F.lit(False), F.lit(True), F.lit(None).cast("string")
    rows = found.filter("kind IS NOT NULL").select("doc_id", "kind", yes.alias("by_detector"), no.alias("by_hosts"), no.alias("by_terms"))
    rows = rows.union(copied.select("doc_id", none, no, yes, no)).union(by_terms.select("doc_id", none, no, no, yes))
    each = rows.groupBy("doc_id").agg(F.max("kind").alias("kind"), *[F.max(c).alias(c) for c in ("by_detector", "by_hosts", "by_terms")])
    return each.withColumn("kind", F.coalesce("kind", F.when(F.col("by_hosts"), "duplicate").otherwise("combined")))


def flagged(documents: DataFrame) -> DataFrame:
    """doc_id and kind of each document that is no real content."""
    return reasons(documents).select("doc_id", "kind")


def without_residue(documents: DataFrame) -> DataFrame:
    """The documents that aren't flagged, all columns kept; rows with a null doc_id are kept."""
    return documents.join(flagged(documents).select("doc_id"), "doc_id", "left_anti").select(documents.columns)
