"""Text functions as Column expressions."""

from __future__ import annotations

import html as _html
import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Words that end like plurals and aren't.
NO_PLURALS = (
    "acoustics", "alias", "analysis", "analytics", "athletics", "atlas", "business", "canvas", "chaos", "classics", "css", "devops", "economics", "ethics", "gas", "go", "graphics", "lens",
    "linguistics", "mathematics", "mechanics", "news", "physics", "plus", "politics", "postgres", "robotics", "series", "species", "statistics", "this", "windows",
)
#: Slugs that keep their plural; words that name a subject only in context; fillers that open no subject.
WHOLE_SLUGS, AMBIGUOUS = ("internet-of-things", "united-states"), ("apple", "go", "java", "python", "rust", "windows")
FILLERS = ("actually", "basically", "currently", "definitely", "freely", "probably", "really", "simply", "usually")
#: How a sentence uses an ambiguous word as a subject; those without an entry never are.
SUBJECTS = {"go": r"\bin Go\b|\bGolang\b|\bGo programming\b", "rust": r"\bin Rust\b|\bRust programming\b|\bRust language\b", "python": r"\bin Python\b|\bPython programming\b", "java": r"\bin Java\b|\bJava programming\b"}
#: Words without a subject.
STOPWORDS = tuple("""
a about above after again against all am an and another any are as at be because been before being below between both but by can could did do does doing down
during each every few for from further had has have having he her here hers herself him himself his how i if in into is it its itself just me more most my myself
no nor not of off on once one only or other our ours ourselves out over own same she should so some such than that the their theirs them themselves then there
these they this those through to too under until up very was we were what when where which while who whom why will with without you your yours yourself yourselves
also via etc com www http https html made may need now
""".split())
#: Named character references that are read; each stands for what HTML says, nbsp for a plain space.
ENTITIES = tuple("""
amp lt gt quot apos nbsp ldquo rdquo lsquo rsquo sbquo bdquo ndash mdash hellip middot bull copy reg trade euro pound yen cent sect para deg plusmn times divide laquo raquo iexcl iquest
agrave aacute acirc atilde auml aring aelig ccedil egrave eacute ecirc euml igrave iacute icirc iuml ntilde ograve oacute ocirc otilde ouml oslash ugrave uacute ucirc uuml yacute yuml
Agrave Aacute Acirc Atilde Auml Aring AElig Ccedil Egrave Eacute Ecirc Euml Igrave Iacute Icirc Iuml Ntilde Ograve Oacute Ocirc Otilde Ouml Oslash Ugrave Uacute Ucirc Uuml Yacute
""".split())
#: The longest summary, and markup's leftovers that are no subjects.
SUMMARY, ARTIFACTS = 400, r"^(quot|x27|nbsp|amp|class|span|div|script|style)$|^(?:feeds?|keywords?|tags?)-|^class-|^\d{4}$|^\d{4}-"
#: White space that a browser collapses, beyond ASCII.
_WIDE_SPACE = r"[\s   -     　﻿]+"


def squeezed(c: Column) -> Column:
    """Runs of white space as one space, none at the ends."""
    return F.trim(F.regexp_replace(c, _WIDE_SPACE, " "))


def without_tags(html: Column) -> Column:
    """Visible text of simple HTML: embedded scripts and tags give way to spaces."""
    bare = F.regexp_replace(html, r"(?is)<(script|style|noscript)\b.*?</\1\s*>", " ")
    return squeezed(F.regexp_replace(bare, r"<[^>]+>", " "))


def slug(c: Column) -> Column:
    """Lower-case ASCII words joined by hyphens, 80 characters at most; a text without any is named by its hash."""
    plain = F.regexp_replace(F.regexp_replace(F.lower(c), r"[^a-z0-9]+", "-"), r"^-+|-+$", "")
    cut = F.regexp_replace(F.substring(plain, 1, 80), r"-+$", "")
    return F.when(cut != "", cut).otherwise(F.concat(F.lit("u-"), F.substring(F.sha2(c, 256), 1, 12)))


def singular(word: Column) -> Column:
    """A regular English plural's singular; other words as they are."""
    cut = lambda n, tail="": F.concat(F.substring(word, 1, F.length(word) - n), F.lit(tail))
    return (
        F.when(word.isin(*NO_PLURALS) | (F.length(word) < 5), word)
        .when(word.endswith("ies"), cut(3, "y"))
        .when(word.rlike("(xes|zes|ches|shes|sses)$"), cut(2))
        .when(word.rlike("s$") & ~word.rlike("(ss|sis|us|is|as|os)$"), cut(1))
        .otherwise(word)
    )


def plain_singular(word: str) -> str:
    """singular of a plain string."""
    if word in NO_PLURALS or len(word) < 5 or not word.endswith("s"):
        return word
    if word.endswith("ies"):
        return word[:-3] + "y"
    if word.endswith(("xes", "zes", "ches", "shes", "sses")):
        return word[:-2]
    return word if word.endswith(("ss", "sis", "us", "is", "as", "os")) else word[:-1]


def singular_slug(c: Column) -> Column:
    return F.when(c.isin(*WHOLE_SLUGS), c).otherwise(F.array_join(F.transform(F.filter(F.split(c, "-"), lambda p: p != ""), singular), "-"))


def letter_tokens(c: Column) -> Column:
    """Lower-case runs of letters, marks and digits."""
    return F.regexp_extract_all(F.lower(c), F.lit(r"([\p{L}\p{M}\p{N}]+)"), 1)


def search_score(query: str, title: Column, summary: Column, domain: Column, topics: Column) -> Column:
    """Summed over the query's tokens: 12 for a whole title or domain, else 8 within the title; 5 within topics, 2 within the
    summary, 3 within the domain. The query is a constant, so its tokens are written out; give long texts as columns of their own."""
    t, s, d, p = (F.lower(F.coalesce(c, F.lit(""))) for c in (title, summary, domain, F.array_join(topics, " ")))
    worth = lambda cond, n: F.when(cond, n).otherwise(0)
    out = F.lit(0)
    for token in re.findall(r"[^\W_]+", query.lower()):
        k = F.lit(token)
        out = out + F.when((t == k) | (d == k), 12).when(F.contains(t, k), 8).otherwise(0) + worth(F.contains(p, k), 5) + worth(F.contains(s, k), 2) + worth(F.contains(d, k), 3)
    return out


def _character(m: re.Match) -> str:
    hexa, number, name = m.groups()
    if name is None:
        code = int(hexa, 16) if hexa else int(number)
        return chr(code) if code <= 0x10FFFF and not 0xD800 <= code <= 0xDFFF else m[0]
    name = name if name in ENTITIES else name.lower()
    return m[0] if name not in ENTITIES else " " if name == "nbsp" else _html.unescape(f"&{name};")


_NUMBERS, _NAMES = re.compile("&#(?:x([0-9a-fA-F]+)|([0-9]+));(?P<name>(?!))?"), re.compile("(?P<hexa>(?!))?(?P<number>(?!))?&([a-zA-Z]+);")


@F.pandas_udf(StringType())
def decoded(c: pd.Series) -> pd.Series:
    """Character references as characters, numbers first, then names; unknown ones stay. Only texts with an & are looked at."""
    at = c.str.contains("&", regex=False, na=False)
    out = c.copy()
    out[at] = [_NAMES.sub(_character, _NUMBERS.sub(_character, t)) for t in c[at]]
    return out


@F.pandas_udf(StringType())
def composed(c: pd.Series) -> pd.Series:
    """Texts in composed form (NFC)."""
    return c.str.normalize("NFC")


@F.pandas_udf(StringType())
def compatible(c: pd.Series) -> pd.Series:
    """Texts in compatibility form (NFKC)."""
    return c.str.normalize("NFKC")


@F.pandas_udf(StringType())
def unaccented(c: pd.Series) -> pd.Series:
    """Texts without the combining marks of their decomposed form."""
    return c.map(lambda t: t if t is None or t.isascii() else re.sub("[\u0300-\u036f]", "", unicodedata.normalize("NFKD", t)))


def without_cdata(c: Column) -> Column:
    """CDATA sections as their content; stray marks of them go."""
    return F.replace(F.regexp_replace(F.regexp_replace(c, r"(?is)<!\[CDATA\[(.*?)\]\]>", "$1"), r"(?i)<!\[CDATA\[", ""), F.lit("]]>"), F.lit(""))


def extracted(c: Column) -> Column:
    """Text out of markup: CDATA and references read, composed, without control characters, squeezed. Null: empty."""
    return squeezed(F.regexp_replace(composed(decoded(without_cdata(F.coalesce(c, F.lit(""))))), r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]", ""))


def capped(c: Column, most: int) -> Column:
    return F.substring(extracted(c), 1, most)


def readable(c: Column, most: int = SUMMARY) -> Column:
    """A text as a summary. With two links or more, labels before links stay and links go."""
    text = extracted(c)
    labelled = F.regexp_replace(text, r"(?i)\s*([^:]+?):\s*https?://\S+", " $1.")
    return F.substring(F.when(F.regexp_count(text, F.lit(r"(?i)https?://\S+")) < 2, text).otherwise(squeezed(F.regexp_replace(labelled, r"(?i)https?://\S+", " "))), 1, most)


def summary(c: Column, most: int = SUMMARY) -> Column:
    """Plain text of simple HTML as a summary."""
    return readable(F.regexp_replace(F.regexp_replace(decoded(without_cdata(F.coalesce(c, F.lit("")))), r"<[^>]*>", " "), r"<[^>]*$", " "), most)


def truncated(c: Column, most: int) -> Column:
    """At most `most` characters, the last an ellipsis where it was cut. Characters are those that readers see: marks and joined
    signs stay with their base."""
    unit = r"(?:\X)"
    units = F.regexp_extract_all(F.trim(c), F.lit(f"({unit})"), 1)
    return F.when(F.size(units) <= most, F.trim(c)).otherwise(F.concat(F.array_join(F.slice(units, 1, max(0, most - 1)), ""), F.lit("…")))


def content_tokens(c: Column) -> Column:
    """Lower-case words of three characters or more that aren't stopwords."""
    return F.filter(letter_tokens(c), lambda t: (F.length(t) > 2) & ~t.isin(*STOPWORDS))


def phrases(tokens: Column) -> Column:
    """Tokens, then neighbouring pairs of them."""
    n = F.greatest(F.size(tokens) - 1, F.lit(0))
    return F.concat(tokens, F.zip_with(F.slice(tokens, F.lit(1), n), F.slice(tokens, F.lit(2), n), lambda a, b: F.concat_ws(" ", a, b)))


def names_subject(sentence: Column, word: Column) -> Column:
    """Whether a sentence uses an ambiguous word as a subject: by its own spelling after `in`, or with its kind."""
    out = F.when(~word.isin(*AMBIGUOUS), True)
    for w, pattern in SUBJECTS.items():
        out = out.when(word == w, sentence.rlike(pattern))
    return out.otherwise(False)


def title_key(c: Column) -> Column:
    """What titles are compared by: compatibility form in lower case, without tags and marks."""
    bare = F.regexp_replace(F.lower(compatible(F.coalesce(c, F.lit("")))), r"<[^>]+>", " ")
    return squeezed(F.regexp_replace(bare, r"[^\p{L}\p{N}\s]+", " "))


def is_weak_title(c: Column) -> Column:
    """A title that names no more than a home page."""
    t = squeezed(F.coalesce(c, F.lit("")))
    own = r"(?i)(?:^|\b)(?:my|your|our|his|her|their|\w+(?:'s|s))\s+(?:very\s+own\s+)?(?:home\s*)?(?:page|site|website)\b"
    return (t == "") | t.rlike(own) | t.rlike(r"(?i)^(?:home|index|untitled|website|homepage|my\s+site|my\s+website|personal\s+(?:home\s*)?page)$")


def is_artifact(slug_: Column) -> Column:
    """A slug that markup or a taxonomy's path left behind."""
    return slug_.rlike(ARTIFACTS)


def is_no_subject(slug_: Column, general: tuple[str, ...] = ()) -> Column:
    """A slug that names no subject: empty, of stopwords, general words or numbers only, led by a filler, a post's number, an artifact."""
    s = F.lower(F.coalesce(slug_, F.lit("")))
    parts = F.filter(F.split(s, "-"), lambda p: p != "")
    plain = lambda p: p.isin(*STOPWORDS, *general) | p.rlike(r"^\d+$")
    return (s == "") | s.isin(*general) | (s.rlike(r"\d") & s.contains("post")) | s.startswith("about-") | ((F.size(parts) >= 2) & F.get(parts, F.lit(0)).isin(*FILLERS)) | F.forall(parts, plain) | is_artifact(s)


def label(c: Column, most: int = 120) -> Column:
    """A label on one line without control characters."""
    return F.substring(squeezed(F.regexp_replace(composed(F.coalesce(c, F.lit(""))), r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]", "")), 1, most)


def comparison_label(c: Column) -> Column:
    """What labels are compared by: without accents, in lower case, of letters, digits and + # . - only."""
    return squeezed(F.regexp_replace(F.lower(unaccented(F.regexp_replace(label(c), r"(?i)^(?:observed:\s*)+", ""))), r"[^a-z0-9+#.\s-]+", " "))


def escaped(c: Column) -> Column:
    """XML text: five characters as references."""
    out = c
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def content_id(c: Column) -> Column:
    """sha256: and the digest of a text; a null text counts as empty."""
    return F.concat(F.lit("sha256:"), F.sha2(F.coalesce(c, F.lit("")), 256))
