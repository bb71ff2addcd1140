"""Labels of pages and sites as Column expressions: languages, descriptions, names, video ids."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from loomspan.functions.text import squeezed

#: Languages written from right to left; the longest description and language tag.
RIGHT_TO_LEFT, DESCRIPTION, TAG = ("ar", "he", "fa", "ur", "yi", "dv"), 260, 35


def language_tag(c: Column) -> Column:
    """A well-formed language tag in lower case with hyphens, else the empty string."""
    tag = F.regexp_replace(F.lower(F.trim(c)), "_", "-")
    return F.when((F.length(F.trim(c)) <= TAG) & tag.rlike(r"^[a-z]{2,8}(-[a-z0-9]{1,8})*$"), tag).otherwise("")


def is_english(c: Column) -> Column:
    return F.substring_index(language_tag(c), "-", 1) == "en"


def is_right_to_left(c: Column) -> Column:
    return F.coalesce(F.split(F.lower(c), "[-_]")[0].isin(*RIGHT_TO_LEFT), F.lit(False))


def description(c: Column, most: int = DESCRIPTION) -> Column:
    """At most `most` characters: up to the last sentence's end if that keeps 45 %, else the last space if that keeps half,
    else cut there; an ellipsis unless it ends with a sentence."""
    text = squeezed(c)
    head = F.substring(text, 1, most + 1)
    # Lengths up to the last mark before a space, and up to the last space.
    sentence = F.length(F.regexp_extract(head, r"(?s)^(.*[.!?]) ", 1))
    space = F.length(F.regexp_extract(head, r"(?s)^(.*) ", 1))
    return (
        F.when(F.length(text) <= most, text)
        .when(sentence - 1 >= int(most * 0.45), F.trim(F.substring(text, F.lit(1), sentence)))
        .when(space >= int(most * 0.5), F.concat(F.trim(F.substring(text, F.lit(1), space)), F.lit("…")))
        .otherwise(F.concat(F.rtrim(F.substring(text, 1, most)), F.lit("…")))
    )


def video_id(url: Column) -> Column:
    """The id in a watch, shorts or short-host video URL; null without one."""
    host = F.regexp_replace(F.regexp_extract(F.lower(url), r"^https?://([^/:?#]+)", 1), r"^www\.", "")
    ok = "([A-Za-z0-9_-]{6,})"
    short = F.regexp_extract(url, rf"(?i)^https?://[^/]+/+{ok}(?:[/?#]|$)", 1)
    watch = F.regexp_extract(url, rf"[?&]v={ok}(?:[&#]|$)", 1)
    shorts = F.regexp_extract(url, rf"(?i)/shorts/{ok}(?:[/?#]|$)", 1)
    long_host = (host == "youtube.com") | host.endswith(".youtube.com")
    return F.nullif(F.when(host == "youtu.be", short).when(long_host & (watch != ""), watch).when(long_host, shorts).otherwise(""), F.lit(""))


#: Labels of hosts that are no person's name.
RESERVED = ("www", "www2", "blog", "mail", "shop", "store", "app", "api", "dev", "staging", "cdn", "static", "docs", "wiki", "news", "forum", "forums", "status", "support")


def person_of_domain(domain: Column, reserved: tuple[str, ...] = RESERVED) -> Column:
    """First Last of first.last.tld, where none of the labels is reserved; null otherwise."""
    parts = F.split(F.regexp_replace(F.lower(F.trim(domain)), r"\.$", ""), r"\.")
    good = (F.size(parts) == 3) & F.forall(parts, lambda p: p.rlike("^[a-z]{2,24}$")) & ~F.get(parts, F.lit(0)).isin(*reserved) & ~F.get(parts, F.lit(1)).isin(*reserved)
    return F.when(good, F.initcap(F.concat_ws(" ", F.get(parts, F.lit(0)), F.get(parts, F.lit(1)))))


def person_of_intro(text: Column, domain: Column) -> Column:
    """The name of two or three words in `I'm …`, `I am …` or `My name is …` at a sentence's start, if the host's first label is that
    name written together; null otherwise."""
    pattern = r"(?:^|[.!?]\s+)(?i:I['’]m|I am|My name is)\s+(\p{L}[\p{L}'’-]*(?:\s+\p{L}[\p{L}'’-]*){1,2}?)(?=\s*[.,:;!?]|\s|$)"
    three = pattern.replace("{1,2}?", "{2}")
    own = F.regexp_replace(F.lower(F.split(F.regexp_replace(domain, r"^www\.", ""), r"\.")[0]), "[^a-z0-9]", "")
    fits = lambda n: (n != "") & (F.regexp_replace(F.lower(n), r"[^\p{L}]", "") == own)
    names = [F.regexp_extract(squeezed(text), p, 1) for p in (three, pattern)]
    return F.coalesce(*(F.when(fits(n) & n.rlike(r"^\p{Lu}"), n) for n in names))
