"""URL functions as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Query parameters that only track, besides those that start with utm_.
TRACKING = ("fbclid", "gclid", "dclid", "gbraid", "wbraid", "msclkid", "mc_cid", "mc_eid", "igshid", "_ga", "_gl")


def origin(url: Column) -> Column:
    """scheme://host[:port] in lower case without a default port; null for other schemes or with credentials."""
    found = F.regexp_extract(F.lower(url), r"^(https?://[^/?#@]+)(?:[/?#]|$)", 1)
    bare = F.regexp_replace(F.regexp_replace(found, r"^(http://.*):80$", "$1"), r"^(https://.*):443$", "$1")
    return F.when(bare != "", bare)


def host(url: Column) -> Column:
    return F.regexp_replace(origin(url), r"^https?://", "")


def path(url: Column) -> Column:
    """The path without slashes at its end; / for the root."""
    p = F.regexp_replace(F.regexp_extract(url, r"^[a-zA-Z]+://[^/?#]*([^?#]*)", 1), r"/+$", "")
    return F.when(p == "", F.lit("/")).otherwise(p)


def without_fragment(url: Column) -> Column:
    return F.regexp_replace(url, r"#.*$", "")


def without_tracking(url: Column) -> Column:
    """The URL without tracking parameters; unchanged where it has none."""
    query = F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1)
    name = lambda p: F.lower(F.substring_index(p, "=", 1))
    tracks = lambda p: name(p).startswith("utm_") | name(p).isin(*TRACKING)
    kept = F.array_join(F.filter(F.split(query, "&"), lambda p: ~tracks(p)), "&")
    base, tail = F.regexp_extract(url, r"^([^?#]*)", 1), F.regexp_extract(url, r"(#.*)$", 1)
    changed = F.concat(base, F.when(kept != "", F.concat(F.lit("?"), kept)).otherwise(F.lit("")), tail)
    return F.when(F.exists(F.split(query, "&"), tracks), changed).otherwise(url)


#: Names of first segments by role, and patterns over a lower-case path or title. The first rule that holds decides.
_OWN = "me|now|uses|health|homelab|workouts|social|elsewhere|colophon|neighborhood|interests|site"
_WORKS = "portfolio|work|projects?|gallery|galleries|albums|photography|photos|art|illustration|artwork|music|discography|tracks|videos|film|animation|games?|interactive|exhibitions|design"
TALKS, COLLECTIONS = ("speaking", "talks", "presentations", "slides"), ("sitemap", "html-sitemap", "collections", "tools")
ROLES = (
    ("legal", r"license|licen[cs]e|third.?party|privacy|terms|legal|cookie|datenschutz|impressum"),
    ("tag-index", r"/(tag|tags|category|categories|topic|topics)\b"),
    ("archive", r"/(archive|archives|posts/?$|blog/?$|index)\b"),
    ("about", r"/(about|bio|profile)\b"),
    ("about", rf"^/({_OWN})(?:/|$|\.html?$)"),
    ("project", rf"^/({_WORKS}|paintings?|fiction)/[^/]+"),
    ("portfolio", rf"^/({_WORKS})$"),
    ("documentation", r"/(docs?|documentation|guide|handbook)\b"),
    ("utility", r"^/seeking(?:/|\.html?)?$"),
    ("utility", r"/(util|utility|login|search|feed|rss|atom)\b"),
    ("speaking-archive", rf"^/+({'|'.join(TALKS)})(\.(html?|php))?$"),
    ("collection", rf"^/+({'|'.join(COLLECTIONS)})(\.(html?|php))?$"),
    ("home", r"^/$|^/index[.]html?$"),
    ("article", None),
    ("about", None),
    ("note", r"/notes/\d{4}-\d{2}-\d{2}(?:-\d{3,4})?(?:/|$|\.html?$)"),
    ("article", r"/(posts?|blog|notes?|essays?|tips?)/"),
    ("portfolio", r"^/(photos?|photography|gallery|galleries|albums)(?:/|$)"),
)
#: Types that a page may declare, at the rules above without a pattern.
_TYPES = {"article": "(?i)BlogPosting|Article|NewsArticle", "about": "(?i)AboutPage"}
_LEGAL_TITLE, _LOST_TITLE = r"license|privacy policy|terms of|datapolicy|datenschutz|impressum", r"\b404\b|not found"


def page_role(url: Column, title: Column | None = None, types: Column | None = None, status: Column | None = None, made: Column | None = None) -> Column:
    """A page's role by its path and by what is known besides: title, declared types (array), HTTP status, whether it was made by a program."""
    p, t = F.lower(path(url)), F.lower(F.coalesce(title, F.lit(""))) if title is not None else F.lit("")
    out = F.when(F.coalesce(made, F.lit(False)) if made is not None else F.lit(False), F.lit("generated"))
    out = out.when(F.coalesce(status >= 400, F.lit(False)) if status is not None else F.lit(False), F.lit("error")).when(t.rlike(_LOST_TITLE), F.lit("error"))
    out = out.when(origin(url).isNull(), F.lit("unknown")).when(t.rlike(_LEGAL_TITLE), F.lit("legal"))
    for role, pattern in ROLES:
        if pattern is not None:
            out = out.when(p.rlike(pattern), F.lit(role))
        elif types is not None:
            out = out.when(_declares(types, _TYPES[role]), F.lit(role))
    return out.otherwise(F.lit("unknown"))


def _declares(types: Column, pattern: str) -> Column:
    return F.coalesce(F.exists(types, lambda x: x.rlike(pattern)), F.lit(False))


def is_directory(url: Column) -> Column:
    """A page that only lists others, by its one segment."""
    return F.coalesce(path(url).rlike(rf"(?i)^/+({'|'.join(TALKS + COLLECTIONS)})(\.(html?|php))?$"), F.lit(False))


def topic_share(role: Column) -> Column:
    """How much a page of a role says of its site's topics."""
    return F.when(role.isin("article", "note", "project"), "full").when(role.isin("home", "about", "portfolio", "documentation"), "profile").when(role.isin("utility", "legal", "error", "generated"), "none").otherwise("limited")


def allows_topics(role: Column, noindex: Column, public: bool = False) -> Column:
    """Whether a page's text may name topics; with public, whether it may count towards communities."""
    return ~F.coalesce(noindex, F.lit(False)) & ((topic_share(role) != "none") if public else topic_share(role).isin("full", "profile"))


def site_id(origin_: Column) -> Column:
    """The digest that names a site."""
    return F.sha2(origin_, 256)


def identity(url: Column, item: Column, site: Column, feed: Column) -> Column:
    """What items are the same by: the URL without a fragment, else the id within its site or feed, else nothing."""
    blank = lambda c: F.nullif(F.trim(c), F.lit(""))
    where = F.coalesce(blank(site), blank(feed))
    return F.when(origin(url).isNotNull(), F.concat(F.lit("url:"), without_fragment(url))).when(blank(item).isNotNull() & where.isNotNull(), F.concat(F.lit("id:"), where, F.lit(":"), blank(item))).otherwise(F.lit(""))


def of_site(url: Column, site: Column) -> Column:
    """Whether a URL lies on a site's host, www or not, or on a part of it."""
    h, s = F.regexp_replace(host(url), r"^www\.", ""), F.regexp_replace(host(site), r"^www\.", "")
    return F.coalesce((h == s) | h.endswith(F.concat(F.lit("."), s)), F.lit(False))


def segments(c: Column) -> Column:
    """A slash path as it is looked up: one slash before, none at the end, none twice, in lower case."""
    p = F.regexp_replace(F.lower(F.trim(c)), r"[?#].*$", "")
    return F.concat(F.lit("/"), F.regexp_replace(F.regexp_replace(p, r"/+", "/"), r"^/|/$", ""))


def playlist_id(url: Column) -> Column:
    """The id of a playlist in a video site's URL; null without one."""
    h = F.regexp_replace(host(url), r"^(www|m)\.", "")
    return F.nullif(F.when((h == "youtube.com") | (h == "youtu.be"), F.regexp_extract(url, r"[?&]list=([A-Za-z0-9_-]+)", 1)).otherwise(""), F.lit(""))


def same_resource(base: Column, href: Column) -> Column:
    """href resolved against an absolute base: absolute ones stay, // takes the scheme, / the origin, others the folder; ? and #
    alone keep the path. Dots in paths are taken as they are. Other schemes give null."""
    h = F.trim(href)
    folder = F.regexp_extract(base, r"^(https?://[^/?#]+(?:/[^?#]*/|/)?)", 1)
    folder = F.when(folder.endswith("/"), folder).otherwise(F.concat(folder, F.lit("/")))
    whole = F.regexp_replace(base, r"#.*$", "")
    return (
        F.when(h.rlike("(?i)^https?://"), h).when(h.rlike("(?i)^[a-z][a-z0-9+.-]*:"), F.lit(None).cast("string"))
        .when(h.startswith("//"), F.concat(F.regexp_extract(base, "^(https?:)", 1), h)).when(h.startswith("/"), F.concat(origin(base), h))
        .when(h.startswith("#"), F.concat(whole, h)).when(h.startswith("?"), F.concat(F.regexp_replace(whole, r"\?.*$", ""), h)).when(h == "", whole).otherwise(F.concat(folder, h))
    )
