"""Personal information in free text, by a semi-Markov conditional random field.

A text's candidate segments of bounded length are proposed for each type; whole-span features score each candidate; a dynamic program over
segments picks the best set that doesn't overlap (all other text is one background label of score 0). The weights are trained here on the
marked sentences of `pii_seeds` (a fixed, bounded sample) by maximum likelihood; training takes seconds on the driver and its result, some
eighty numbers, travels with the tasks. Texts are scored where they lie; nothing is gathered.
"""

from __future__ import annotations

import base64
import math
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexforge.llm.pii_seeds import SEEDS
from lexforge.llm.pii_words import (
    ARTICLES, COMMON, FAMILY, FILE_WORDS, GIVEN, ID_WORDS, MORE_GIVEN, ORDINARY, ORDINARY_ENDINGS, ORGANISATION, PARTICLES, PERSON_LEFT, PERSON_RIGHT, PHONE_WORDS, PLACE_LEFT, STREETS, TITLES,
)
from lexforge.llm.tokens import DEFAULT_VOCABULARY

TYPES = ("email", "phone", "id_number", "address", "person_name")

Segment = tuple[int, int, str, tuple[str, ...]]  # start, end, type, features

_AT = r"(?:\s{0,2}@\s{0,2}|\s{0,2}[\[({<]\s?[Aa][Tt]\s?[\])}>]\s{0,2}|\s{1,2}AT\s{1,2}(?=[\w.-]+\s{1,2}DOT\s)|\s{1,2}at\s{1,2}(?=[\w.-]+\s{1,2}dot\s))"
_DOT = r"(?:\.|\s{0,2}[\[({<]\s?[Dd][Oo][Tt]\s?[\])}>]\s{0,2}|\s{1,2}(?:DOT|dot)\s{1,2})"
EMAIL = re.compile(rf"(?<![\w.+-])[\w+%-]+(?:\.[\w+%-]+)*{_AT}[a-zA-Z0-9-]+(?:{_DOT}[a-zA-Z0-9-]+)+")
EMAIL_CUE = re.compile(r"@|[\[({<]\s?[Aa][Tt]\s?[\])}>]|\sAT\s|\sat\s+[\w.-]+\s+dot\s")

_S = r"[\s ]{0,2}[-./‐‑–]?[\s ]{0,2}"
NUMBER = re.compile(
    rf"(?<![\w$£€])(?<!\d[.,/-])(?:"
    rf"(?P<uk>(?:\+\s?44|0044){_S}(?:\(0\)){_S}\d{{2,5}}{_S}\d{{3,4}}{_S}\d{{3,6}}|(?:\+\s?44|0044){_S}\d{{2,5}}{_S}\d{{3,4}}{_S}\d{{3,6}}|\+\s?44{_S}\d{{2,5}}{_S}\d{{5,7}}|(?:\(0\d{{2,4}}\)|0\d{{2,4}}){_S}\d{{3,4}}{_S}\d{{3,4}}|0\d{{4}}{_S}\d{{6}})"
    rf"|(?P<nanp>(?:(?:\+|00)?1{_S}|001{_S})?(?:\(\d{{3}}\)|\d{{3}}){_S}\d{{3}}{_S}\d{{4}})"
    rf"|(?P<intl>\+\d{{1,3}}(?:{_S}\(?\d{{1,4}}\)?){{2,5}})"
    rf")(?![\w]|[.,]\d|-\d)(?:\s{{0,2}}(?:ext|x|extension)\.?\s{{0,2}}\d{{1,5}})?",
    re.IGNORECASE,
)
#: Stretches of digits and what may stand between them: every phone and identity number holds one, with little before and after it.
CLUSTER = re.compile(r"\d[\d\s().+/‐‑–-]{4,}\d")
BEFORE, AFTER = 8, 16
IDENTITY = re.compile(
    r"(?<![\w$£€])(?<!\d[.,/-])(?:"
    r"(?P<health>\d{4}[- ]{1,2}\d{3}[- ]{1,2}\d{3}[- ]{1,2}[A-Z]{2})"
    r"|(?P<licence>[A-Z]\d{4}[- ]?\d{5}[- ]?\d{5})"
    r"|(?P<insurance>[A-Z]{2}\s{0,2}\d{2}\s{0,2}\d{2}\s{0,2}\d{2}\s{0,2}[A-D])"
    r"|(?P<passport>[A-Z]{1,2}\s?\d{6,8})"
    r"|(?P<ssn>\d{3}[- ]{1,2}\d{2}[- ]{1,2}\d{4})"
    r"|(?P<sin>\d{3}[- ]{1,2}\d{3}[- ]{1,2}\d{3})"
    r"|(?P<nine>\d{9})"
    r")(?![\w]|[.,]\d|-\d)",
    re.IGNORECASE,
)

_NAME = r"(?:[A-Z][\w'’.-]*|de|la|du)"
_PLACE = r"[A-Z][^\W\d_]+(?:['’-][^\W\d_]+)*(?:\s+[A-Z][^\W\d_]+\b)?"
_UNIT = r"(?:(?:unit|flat|apt|apartment|suite|ste|room|rm|no)\.?\s+#?\d+[a-z]?\s{0,2},?\s{1,2}|#\s?\d+[a-z]?,?\s{1,2})"
ADDRESS = re.compile(
    rf"(?<![\w$£€.,/-])(?:"
    rf"(?P<box>(?i:p\.?\s?o\.?\s{{0,2}}box|post\s+office\s+box|postal\s+box|p\.?o\.?b\.?|(?<!\w)box)\s{{1,2}}#?\d+)"
    rf"|(?P<street>(?P<unit>(?i:{_UNIT}))?(?P<house>\d{{1,5}}[A-Za-z]?(?:\s?[-–]\s?\d{{1,5}}[A-Za-z]?)?)\s{{1,3}}(?:{_NAME}\s{{1,3}}){{1,4}}(?i:{STREETS})\b\.?)"
    rf"|(?P<french>(?P<house2>\d{{1,5}}[A-Za-z]?),?\s{{1,2}}(?i:rue|avenue|boulevard|chemin|place|all[ée]e|calle|avenida|via|piazza)\s+(?:(?:de|du|des|la|le|del|della|l['’])\s*)*[A-Z][\w'’-]+)"
    rf"|(?P<coded>(?P<house3>\d{{1,5}}[A-Za-z]?)\s{{1,2}}(?:{_NAME}\s{{1,2}}){{0,2}}{_NAME},?\s{{1,2}}(?={_PLACE},?\s{{1,2}}[A-Z]{{2}}\s{{1,2}}(?:\d{{5}}|[A-Z]\d[A-Z])))"
    rf"|(?P<german>[A-Z][\w-]+(?:stra(?:ß|ss)e|str\.|weg|platz|allee)\s{{1,2}}\d{{1,4}}[a-z]?)"
    rf")"
    rf"(?P<tail>(?:,?\s{{1,2}}(?i:apt|apartment|unit|suite|flat)\.?\s{{1,2}}#?\d+[a-z]?)?(?:\s{{0,2}},?\s{{0,2}}(?<=\s){_PLACE})?(?:,?\s{{1,2}}[A-Z]{{2}}\b)?(?:,?\s{{1,2}}(?:[A-Z]\d[A-Z]\s?\d[A-Z]\d|\d{{5}}|[A-Z]{{1,2}}\d[A-Z\d]?\s?\d[A-Z]{{2}}))?)"
)

WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*(?:-[^\W\d_]+(?:['’][^\W\d_]+)*)*")
_ORDINARY = tuple(ORDINARY_ENDINGS)
_DIGIT = re.compile(r"\d")
_ID_LEFT, _PHONE_LEFT, _FILE_LEFT = (re.compile(rf"\b{w}\b[^\w]{{0,4}}(?:(?:number|no|nr|id|is|was|of|from|at)\b[^\w]{{0,4}}){{0,2}}$", re.IGNORECASE) for w in (ID_WORDS, PHONE_WORDS, FILE_WORDS))
_ANY_ID = re.compile(rf"\b{ID_WORDS}\b[^.;\n]{{0,25}}$", re.IGNORECASE)
_ANY_PHONE = re.compile(rf"\b{PHONE_WORDS}\b[^;\n]{{0,25}}$", re.IGNORECASE)


def _left(text: str, start: int) -> list[str]:
    window = text[max(0, start - 45) : start]
    found = []
    if _ID_LEFT.search(window):
        found.append("after_id_word")
    elif _ANY_ID.search(window):
        found.append("near_id_word")
    if _PHONE_LEFT.search(window):
        found.append("after_phone_word")
    elif _ANY_PHONE.search(window):
        found.append("near_phone_word")
    if _FILE_LEFT.search(window):
        found.append("after_file_word")
    return found


def _stretches(text: str) -> list[tuple[int, int]]:
    """Where numbers of persons may be: the clusters of digits with their surroundings, those that touch put together."""
    out: list[tuple[int, int]] = []
    for m in CLUSTER.finditer(text):
        a, b = max(m.start() - BEFORE, 0), min(m.end() + AFTER, len(text))
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], b)
        else:
            out.append((a, b))
    return out


def _numbers(text: str) -> Iterator[Segment]:
    for m in EMAIL.finditer(text) if EMAIL_CUE.search(text) else ():
        s = m.group()
        last = re.split(r"[.\s\])}>]+", s.rstrip(".] )}>"))[-1]
        yield m.start(), m.start() + len(s.rstrip()), "email", tuple(["bias", "at_sign" if "@" in s else "spelled_at", "letters_end" if last.isalpha() and len(last) > 1 else "odd_end"] + (["broken"] if re.search(r"@\s|\s@", s) else []))
    if not _DIGIT.search(text):
        return
    near = _stretches(text)
    for m in (m for a, b in near for m in NUMBER.finditer(text, a, b)):
        s = m.group()
        digits = sum(c.isdigit() for c in re.split(r"(?i)[ex]", s)[0])
        f = ["bias", f"form={m.lastgroup}", f"digits={digits}" if 9 < digits < 14 else "digits=odd", "separated" if re.search(r"\d[\s ./)-]+\d", s) else "bare"]
        f += ["plus"] if s[0] == "+" else ["parenthesis"] if s[0] == "(" else []
        yield m.start(), m.end(), "phone", tuple(f + _left(text, m.start()))
    for m in (m for a, b in near for m in IDENTITY.finditer(text, a, b)):
        s = m.group()
        f = ["bias", f"form={m.lastgroup}"] + _left(text, m.start())
        if m.lastgroup in ("ssn", "sin", "nine") and not {"after_id_word", "near_id_word"} & set(f):
            f.append("ambiguous_alone")
        if m.lastgroup in ("passport", "insurance", "licence") and s != s.upper():
            f.append("lower")
        yield m.start(), m.end(), "id_number", tuple(f)
    for m in ADDRESS.finditer(text):
        kind = "box" if m["box"] else "street" if m["street"] else "coded" if m["coded"] else "other"
        f = ["bias", f"form={kind}"] + (["unit"] if m["unit"] else []) + (["tail"] if m["tail"] else [])
        f += ["bare_box"] if kind == "box" and m.group()[0] in "bB" else []
        f += ["money_left"] if re.search(r"(?:[$£€]|CAD|USD|EUR|dollars)\s*$", text[max(0, m.start() - 8) : m.start()]) else []
        # the dot of an abbreviation is the address's, that of a sentence isn't
        ends = re.search(r"(\w+)\.$", m.group())
        yield m.start(), m.end() - bool(ends and len(ends[1]) > 4), "address", tuple(f)


@lru_cache(maxsize=2)
def _vocabulary(path: str) -> dict[bytes, int]:
    """The ranks of a public tokenizer's word-initial pieces: a frequent form has a low rank."""
    with open(path, "rb") as f:
        return {piece: int(rank) for piece, rank in ((base64.b64decode(a), b) for a, b in map(bytes.split, f)) if piece[:1] == b" "}


#: Pieces of up to four letters are words by themselves below this rank; rarer ones mostly begin longer words.
SHORT_RANK = 8000


@lru_cache(maxsize=1 << 16)
def _class(word: str) -> str:
    """What a word is by itself: o ordinary, g listed given name, f listed family name, b both, p usually capitalised, u unknown.

    Ordinary words are those listed, those with an ordinary ending, and those whose lower-case form is the more frequent one by the ranks of
    a public tokenizer's vocabulary. Words that the vocabulary doesn't hold whole are unknown, as most family names are.
    """
    low = word.lower()
    base, last = low.split("-")[0], low.split("-")[-1]
    given, family = base in GIVEN or base in MORE_GIVEN, last in FAMILY
    if low in COMMON or low in ORGANISATION or low in TITLES or low in ORDINARY:
        return "o"
    if given or family:
        return "b" if given and family else "g" if given else "f"
    ranks = _vocabulary(DEFAULT_VOCABULARY)
    small, big = ranks.get(f" {last}".encode()), ranks.get(f" {last.capitalize()}".encode())
    if small is not None and (big is None or small < big) and (len(last) > 4 or small < SHORT_RANK):
        return "o"
    if len(low) > 5 and low.endswith(_ORDINARY):
        return "o"
    return "u" if big is None else "p"


def _surname(word: str) -> bool:
    """Whether a word may be a family name: it isn't an ordinary word."""
    return _class(word) != "o"


@lru_cache(maxsize=1 << 16)
def _traits(word: str) -> tuple[bool, bool, bool, str]:
    """Whether a word is capitalised, a listed name, an ordinary word, and its class."""
    c = _class(word)
    return word[0].isupper(), c in "gfb", c == "o", c


#: The most words of a run that is a candidate by itself.
RUN = 4


def _runs(text: str, words: list[tuple[int, int, str]], plain: bool = False) -> Iterator[Segment]:
    """Every run of 2 to RUN neighbouring words as a person's name, in any case pattern; lists, shape and context are features.

    Runs that aren't all capitalised and hold no listed name have the features of a `PLAIN_RUNS` alone, and so one score. They are left out:
    `trained` makes sure that this score can't enter the best set. With `plain` they are proposed all the same, for training.
    """
    n = len(words)
    traits = [_traits(w[2]) for w in words]
    marked = {k for k, t in enumerate(traits) if t[1]}
    starts = set(range(n)) if plain else marked.union(*((k - 1, k - 2, k - 3) for k in marked), (k for k, t in enumerate(traits) if t[0]))

    def near(i: int) -> bool:
        """Word i + 1 stands beside word i on the same line."""
        if not 0 <= i < n - 1:
            return False
        a, b = words[i][1], words[i + 1][0]
        return text[a:b] == " " or (0 < b - a <= 4 and not (g := text[a:b]).strip() and "\n" not in g)

    for i in sorted(starts):
        if not near(i):
            continue
        cap, listed, ordinary = traits[i][0], traits[i][1], traits[i][2]
        lower = not cap
        for j in range(i + 1, min(n, i + RUN)):
            if not near(j - 1):
                break
            t = traits[j]
            particle = words[j][2] in PARTICLES
            cap, lower = cap and (t[0] or particle), lower and not t[0]
            listed, ordinary = listed or t[1], ordinary or t[2]
            if not (cap or listed):
                if plain and not particle:
                    yield words[i][0], words[j][1], "person_name", ("run", "run_lower" if lower else "run_mixed", "run_unlisted")
                continue
            if particle:
                continue
            f = ["run", "run_cap" if cap else "run_lower" if lower else "run_mixed", f"run_words={j - i + 1}"]
            f.append(f"run_{traits[i][3]}{t[3]}" if cap or listed else "run_unlisted")
            f.append(f"run_{'lower' if lower else 'upper'}_{traits[i][3]}{t[3]}" if not cap else f"run_cap_{'listed' if listed else 'unlisted'}")
            if ordinary:
                f.append("run_ordinary")
            before = words[i - 1][2].lower() if i else ""
            gap = text[words[i - 1][1] if i else 0 : words[i][0]]
            joined = i > 0 and not gap.strip() and "\n" not in gap
            if joined and traits[i - 1][0] and not traits[i - 1][2]:
                f.append("run_left_cap")
            elif joined or (i and gap.strip() in (":", ",", "(")):
                f.append("run_left_person" if before in PERSON_LEFT else "run_left_place" if before in PLACE_LEFT else "run_left_article" if before in ARTICLES else "run_left_other")
            else:
                f.append("run_left_start")
            follows = near(j)
            if follows and traits[j + 1][0]:
                f.append("run_right_cap_ordinary" if traits[j + 1][2] else "run_right_cap")
            elif follows and words[j + 1][2] in PERSON_RIGHT:
                f.append("run_right_person")
            else:
                f.append("run_right_other")
            if follows and words[j + 1][2].lower() in ORGANISATION:
                f.append("organisation_right")
            if any(words[k][2].lower() in ORGANISATION for k in range(i, j + 1)):
                f.append("run_organisation")
            right = text[words[j][1] : words[j][1] + 5]
            if "&" in right or (" v" in right and re.match(r"\s+v\.?s?\.?\s", right)) or text[max(0, words[i][0] - 3) : words[i][0]].rstrip().endswith("&") or before in ("v", "vs"):
                f.append("connector")
            yield words[i][0], words[j][1], "person_name", tuple(f)


#: All features of runs that aren't all capitalised and hold no listed name: context tells nothing of them.
PLAIN_RUNS = (("run", "run_lower", "run_unlisted"), ("run", "run_mixed", "run_unlisted"))


@lru_cache(maxsize=1 << 16)
def _opens(word: str) -> bool:
    """Whether one of the forms of `_names` can begin at a word."""
    low = word.lower()
    return len(word) == 1 or _class(word) in "gb" or low.split("-")[0] in GIVEN or low in TITLES or (word[0].isupper() and _surname(word))


def _names(text: str, words: list[tuple[int, int, str]]) -> Iterator[Segment]:
    n = len(words)

    def gap(i: int, j: int) -> str:
        return text[words[i][1] : words[j][0]]

    def blank(i: int, j: int) -> bool:
        return j < n and 0 < len(g := gap(i, j)) <= 4 and not g.strip()

    def initial(i: int) -> bool:
        return i < n and words[i][1] - words[i][0] == 1 and words[i][2].isalpha() and text[words[i][1] : words[i][1] + 1] == "."

    def after(i: int, j: int) -> bool:
        """Word j follows word i as in a name; a dot may close an initial."""
        return j < n and (blank(i, j) or (initial(i) and 0 < len(g := gap(i, j)) <= 4 and not g[1:].strip()))

    def family(i: int) -> int | None:
        """The last word of a family name that begins with word i (particles allowed)."""
        j = i
        while j < n and words[j][2].lower() in PARTICLES and after(j, j + 1) and j - i < 3:
            j += 1
        if j >= n:
            return None
        w = words[j][2]
        return j if len(w) > 1 and w.lower() not in COMMON and w.lower() not in ORGANISATION and (w[0].isupper() or _surname(w)) else None

    def segment(i: int, j: int, form: str, given: bool, sure: bool) -> Segment:
        start, end = words[i][0], words[j][1] + initial(j)
        cap = all(words[k][2][0].isupper() or words[k][2].lower() in PARTICLES for k in range(i, j + 1))
        f = ["bias", f"form={form}", "cap" if cap else "lower"]
        f += ["given"] if given else []
        f += ["surname" if sure else "plain_surname", f"{form}_{'surname' if sure else 'plain'}"]
        before = words[i - 1][2].lower() if i else ""
        left, right = text[max(0, start - 3) : start], text[end : end + 5]
        if before in TITLES and len(gap(i - 1, i).strip()) <= 1 and "\n" not in gap(i - 1, i):
            f.append("title")
        follows = words[j + 1][2].lower() if j + 1 < n else ""
        if follows in ORGANISATION and not gap(j, j + 1).strip(" \t\n "):
            f.append("organisation_right")
        if re.match(r"\s*&|\s+v\.?s?\.?\s", right) or left.rstrip().endswith("&") or (before in ("v", "vs") and "." in gap(i - 1, i)):
            f.append("connector")
        if left.endswith("@") or right.startswith("@") or (left and left[-1] in "._+"):
            f.append("in_address")
        if before in ("port", "saint", "lower", "upper") or words[i][2].lower() in COMMON:
            f.append("place_like")
        return start, end, "person_name", tuple(f)

    for i in range(n):
        word = words[i][2]
        if not _opens(word):
            continue
        low = word.lower()
        base = low.split("-")[0]
        listed = base in GIVEN or base in MORE_GIVEN
        if listed and low not in TITLES:
            j = i + 1
            while after(j - 1, j) and initial(j) and j - i < 3:
                j += 1
            if after(j - 1, j) and (k := family(j)) is not None:
                if not (word[0].isupper() and not words[k][2][0].isupper() and not _surname(words[k][2])):
                    yield segment(i, k, "given_first", True, _surname(words[k][2]))
                # a second given name before the family name
                if words[k][2].lower().split("-")[0] in GIVEN | MORE_GIVEN and after(k, k + 1) and (q := family(k + 1)) is not None:
                    yield segment(i, q, "given_twice", True, _surname(words[q][2]))
            # family name first
            if i and words[i - 1][2].lower() not in COMMON and len(words[i - 1][2]) > 1 and _surname(words[i - 1][2]):
                g = gap(i - 1, i)
                form = "comma" if re.fullmatch(r",\s{1,3}", g) else "reversed" if blank(i - 1, i) else None
                if form:
                    first = i - 1
                    while first and words[first - 1][2].lower() in PARTICLES and blank(first - 1, first):
                        first -= 1
                    last = i + 1 if after(i, i + 1) and initial(i + 1) else i
                    yield segment(first, last, form, True, True)
        elif initial(i) and (word.isupper() or word == low):
            j = i + 1
            while after(j - 1, j) and initial(j) and j - i < 3:
                j += 1
            if after(j - 1, j) and (k := family(j)) is not None and words[k][2][0].isupper() == word.isupper() and not (i and initial(i - 1) and after(i - 1, i)):
                if not (i and words[i - 1][2].lower().split("-")[0] in GIVEN | MORE_GIVEN and after(i - 1, i)):
                    yield segment(i, k, "initial", False, _surname(words[k][2]))
            if i and re.fullmatch(r",\s{1,3}", gap(i - 1, i)) and _surname(words[i - 1][2]) and words[i - 1][2][0].isupper():
                first = i - 1
                while first and words[first - 1][2].lower() in PARTICLES and blank(first - 1, first):
                    first -= 1
                yield segment(first, i, "comma_initial", False, True)
        elif low in TITLES and i + 1 < n and re.fullmatch(r"\.?\s{1,3}", gap(i, i + 1)) and base not in GIVEN:
            nxt = words[i + 1][2].lower().split("-")[0]
            if nxt not in GIVEN and nxt not in MORE_GIVEN and not initial(i + 1) and (k := family(i + 1)) is not None:
                yield segment(i + 1, k, "after_title", False, _surname(words[k][2]))
        elif word[0].isupper() and i + 1 < n and after(i, i + 1):
            # a given name outside the lists, before initials or a family name with particles
            j = i + 1
            while after(j - 1, j) and initial(j) and j - i < 3:
                j += 1
            if (j > i + 1 or words[j][2].lower() in PARTICLES) and after(j - 1, j) and (k := family(j)) is not None and words[k][2][0].isupper():
                yield segment(i, k, "middle_initial" if j > i + 1 else "particle", False, _surname(words[k][2]))


def segments(text: str, plain: bool = False) -> list[Segment]:
    """All candidates of a text, by end."""
    words = [(m.start(), m.end(), m.group()) for m in WORD.finditer(text)]
    found = {(s, e, t): f for s, e, t, f in (*_runs(text, words, plain), *_numbers(text), *_names(text, words))}
    return sorted(((s, e, t, f) for (s, e, t), f in found.items()), key=lambda x: (x[1], x[0], x[2]))


#: Segments this close count as neighbours, with a weight for each pair of types.
NEAR = 3


def _score(weights: dict[str, float], segment: Segment) -> float:
    return sum(weights.get(f"{segment[2]}:{f}", 0.0) for f in segment[3])


def _link(a: Segment, b: Segment) -> str | None:
    return f"{a[2]}>{b[2]}" if b[0] - a[1] <= NEAR else None


def best(text: str, weights: dict[str, float]) -> list[tuple[int, int, str]]:
    """The highest-scoring set of segments that don't overlap: a Viterbi pass over segments in order of their ends."""
    found = segments(text)
    total: list[float] = []
    back: list[int] = []
    top: list[tuple[int, float, int]] = []  # (end, best total up to it, its segment), rising in both
    for i, b in enumerate(found):
        value, previous = 0.0, -1
        for end, t, j in reversed(top):
            if end <= b[0]:
                if t > value:
                    value, previous = t, j
                break
        for j in range(i - 1, -1, -1):
            a = found[j]
            if a[1] < b[0] - NEAR:
                break
            if a[1] <= b[0] and (link := _link(a, b)) and (w := weights.get(link)) is not None and total[j] + w > value:
                value, previous = total[j] + w, j
        total.append(value + _score(weights, b))
        back.append(previous)
        if total[i] > (top[-1][1] if top else 0.0):
            top.append((b[1], total[i], i))
    out = []
    i = top[-1][2] if top else -1
    while i >= 0:
        out.append(found[i][:3])
        i = back[i]
    return out[::-1]


_MARK = re.compile(r"\[\[(\w+):(.*?)\]\]", re.DOTALL)


def unmark(marked: str) -> tuple[str, set[tuple[int, int, str]]]:
    """The plain text of a marked sentence, and its gold segments."""
    text, gold, at = "", set(), 0
    for m in _MARK.finditer(marked):
        text += marked[at : m.start()]
        gold.add((len(text), len(text) + len(m[2]), m[1]))
        text += m[2]
        at = m.end()
    return text + marked[at:], gold


def _logsum(values: list[float]) -> float:
    top = max(values)
    return top + math.log(sum(math.exp(v - top) for v in values))


def _expected(found: list[Segment], weights: dict[str, float]) -> dict[str, float]:
    """Expected feature counts of one text, by the forward and backward sums over segments."""
    n = len(found)
    score = [_score(weights, s) for s in found]
    before = [[j for j in range(n) if found[j][1] <= found[i][0]] for i in range(n)]
    link = {(j, i): _link(found[j], found[i]) for i in range(n) for j in before[i]}
    forward = [0.0] * n
    for i in range(n):
        forward[i] = score[i] + _logsum([0.0, *(forward[j] + weights.get(link[j, i] or "", 0.0) for j in before[i])])
    backward = [0.0] * n
    for i in range(n - 1, -1, -1):
        backward[i] = _logsum([0.0, *(weights.get(link[i, k] or "", 0.0) + score[k] + backward[k] for k in range(n) if (i, k) in link)])
    z = _logsum([0.0, *forward])
    counts: dict[str, float] = {}
    for i in range(n):
        p = math.exp(forward[i] + backward[i] - z)
        for f in found[i][3]:
            counts[f"{found[i][2]}:{f}"] = counts.get(f"{found[i][2]}:{f}", 0.0) + p
    for (j, i), name in link.items():
        if name:
            counts[name] = counts.get(name, 0.0) + math.exp(forward[j] + weights.get(name, 0.0) + score[i] + backward[i] - z)
    return counts


#: Every so many training sentences all runs of words are candidates; in the others, as in use, those that can't be in the best set aren't.
PLAIN_EVERY = 6


@lru_cache(maxsize=1)
def trained(rounds: int = 150, rate: float = 0.6, ridge: float = 0.01) -> tuple[tuple[str, float], ...]:
    """The weights, by AdaGrad on the conditional log-likelihood of the marked sentences. Deterministic."""
    data = []
    for i, marked in enumerate(SEEDS):
        text, gold = unmark(marked)
        found = segments(text, plain=i % PLAIN_EVERY == 0)
        # a candidate is right if it begins where the detail does; of several, the one that ends there too, else the longest
        at = {(start, kind): max((s for s in found if (s[0], s[2]) == (start, kind)), key=lambda s: (s[1] == end, s[1]), default=None) for start, end, kind in gold}
        true = [s for s in found if at.get((s[0], s[2])) is s]
        data.append((found, true))
    weights: dict[str, float] = {}
    grown: dict[str, float] = {}
    for _ in range(rounds):
        gradient: dict[str, float] = {}
        for found, true in data:
            if not found:
                continue
            for s in true:
                for f in s[3]:
                    gradient[f"{s[2]}:{f}"] = gradient.get(f"{s[2]}:{f}", 0.0) + 1
            for a, b in zip(true, true[1:]):
                if a[1] <= b[0] and (name := _link(a, b)):
                    gradient[name] = gradient.get(name, 0.0) + 1
            for name, c in _expected(found, weights).items():
                gradient[name] = gradient.get(name, 0.0) - c
        for name, g in gradient.items():
            g -= ridge * weights.get(name, 0.0)
            grown[name] = grown.get(name, 0.0) + g * g
            weights[name] = weights.get(name, 0.0) + rate * g / math.sqrt(grown[name] + 1e-8)
    links = sum(max([0.0, *(w for n, w in weights.items() if ">" in n and n.split(">")[side] == "person_name")]) for side in (0, 1))
    if max(sum(weights.get(f"person_name:{f}", 0.0) for f in plain) for plain in PLAIN_RUNS) + links > 0:
        raise ValueError("a run of plain words could be a name: _runs must propose them all")
    return tuple(sorted(weights.items()))


FOUND_SCHEMA = "table_name string, record_key string, field_name string, pii_type string, start_pos int, end_pos int"


def find(texts: DataFrame) -> DataFrame:
    """FOUND_SCHEMA of each detail in (table_name, record_key, field_name, text). Null and empty texts hold none; keys must be unique."""
    weights = dict(trained())
    names = [f.split()[0] for f in FOUND_SCHEMA.split(", ")]
    types = [pa.string()] * 4 + [pa.int32()] * 2

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for table, key, field, text in zip(*(c.to_pylist() for c in batch.columns)):
                rows.extend((table, key, field, kind, s, e) for s, e, kind in best(text, weights))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

    return texts.select("table_name", "record_key", "field_name", "text").filter(F.length("text") > 0).mapInArrow(run, FOUND_SCHEMA)


def masked(text_column: str, df: DataFrame) -> DataFrame:
    """df with `text_column` masked: each detail replaced by [EMAIL], [PHONE], [ID_NUMBER], [ADDRESS] or [PERSON_NAME]; null stays null."""
    weights = dict(trained())

    @F.pandas_udf("string")
    def mask(texts):
        return texts.map(lambda t: replace(t, best(t, weights)) if t else t)

    return df.withColumn(text_column, mask(F.col(text_column)))


def replace(text: str, found: list[tuple[int, int, str]]) -> str:
    parts, at = [], 0
    for s, e, kind in found:
        parts += [text[at:s], f"[{kind.upper()}]"]
        at = e
    return "".join(parts) + text[at:]
