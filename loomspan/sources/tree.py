"""Pages as trees, parsed once: sections, passages, repeated blocks, tables, links, what the head declares.

A page's elements stand in a flat list, each with its parent, its depth and the stretch of text pieces it covers, so that any element's text
is a slice and nothing walks up or down a deep tree. End tags that writers leave out are implied (paragraphs, list items, terms, rows and
cells, headings); an end tag without a start is ignored. Scripts, styles and templates have no text.

Defined results: a null or empty page is a page without anything. Tags that are never closed end with the page. Pages are parsed row by row
in Arrow batches; however deep or long one is, its parse is linear in its length.
"""

from __future__ import annotations

import json
from collections import Counter, defaultdict
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from loomspan.sources.html import SILENT, loose_references, whole_references

#: Elements without an end; those that end an open paragraph; those whose text is around the page's own; the least repeated siblings.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
CHROME, CELLS, LEAST_REPEATED = frozenset({"nav", "footer", "header"}), frozenset({"li", "dt", "tr", "td"}), 3
#: What a start tag ends, up to the element that holds it.
_ENDS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table", "thead", "tbody", "tfoot"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"})}
_ENDS |= {t: ({"tr", "td", "th", "thead", "tbody", "tfoot"}, {"table"}) for t in ("thead", "tbody", "tfoot")}
_HEADINGS = {f"h{k}": k for k in range(1, 7)}

_LINK = "struct<n:int,href:string,text:string,rel:string,place:string,section:string>"
TREE = f"""lang string, title string, metas array<struct<key:string,content:string>>, heads array<struct<rel:string,type:string,href:string>>, objects array<string>,
passages array<struct<n:int,kind:string,section:string,text:string>>, paragraphs array<struct<n:int,section:string,text:string,chrome:boolean>>,
repeated array<struct<n:int,path:string,chrome:boolean,items:array<struct<text:string,href:string>>>>, tables array<struct<n:int,names:array<string>,rows:array<array<string>>>>,
figures array<struct<n:int,caption:string,href:string,image:string>>, links array<{_LINK}>"""


def _label(text: str) -> str:
    """A heading's text without the signs of a link to itself at its end; a single letter keeps them (C#)."""
    bare = text.rstrip("#")
    return text if len(bare) == 1 and bare.isascii() and bare.isalpha() else bare.rstrip()


class Tree(HTMLParser):
    """The elements of a page in order: tag, attributes, parent, start and end in `pieces`, and what it stands in."""

    def __init__(self):
        super().__init__()
        self.pieces: list[str] = []
        self.tag, self.attrs, self.parent, self.start, self.end = [], [], [], [], []
        self.chrome, self.cell, self.main = [], [], []
        self.open: list[int] = []
        self.now: Counter[str] = Counter()
        self.silent = 0

    def _close(self, at: int) -> None:
        """End the open elements from place `at` of the stack on."""
        for e in self.open[at:]:
            self.end[e] = len(self.pieces)
            self.now[self.tag[e]] -= 1
            self.silent -= self.tag[e] in SILENT
        del self.open[at:]

    def _close_within(self, tags: set, holders: set) -> None:
        """End open elements of tags, up to the next that holds them."""
        at = len(self.open) - 1
        while at >= 0 and any(self.now[t] for t in tags) and self.tag[self.open[at]] not in holders:
            if self.tag[self.open[at]] in tags:
                self._close(at)
            at -= 1

    def handle_starttag(self, tag, attrs):
        if tag in BLOCKS and self.now["p"]:
            self._close_within({"p"}, {"td", "th", "li", "div", "article", "section", "blockquote"} if tag != "p" else {"td", "th"})
        if tag in _ENDS:
            self._close_within(*_ENDS[tag])
        if tag in _HEADINGS and self.open and self.tag[self.open[-1]] in _HEADINGS:
            self._close(len(self.open) - 1)
        up, e = self.open[-1] if self.open else -1, len(self.tag)
        of = self.tag[up] if up >= 0 else ""
        self.tag.append(tag)
        self.attrs.append({k: v or "" for k, v in reversed(attrs)})  # the first of repeated attributes counts
        self.parent.append(up)
        self.start.append(len(self.pieces))
        self.end.append(len(self.pieces))
        self.chrome.append(of in CHROME or up >= 0 and self.chrome[up])
        self.cell.append(of in CELLS or up >= 0 and self.cell[up])
        self.main.append(of in ("main", "article") or up >= 0 and self.main[up])
        if tag not in VOID:
            self.open.append(e)
            self.now[tag] += 1
            self.silent += tag in SILENT

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag):
        for at in range(len(self.open) - 1, -1, -1) if self.now[tag] else ():
            if self.tag[self.open[at]] == tag:
                return self._close(at)
            if tag in _ENDS and self.tag[self.open[at]] in _ENDS[tag][1]:
                return None
        return None

    def handle_data(self, data):
        if self.silent and self.open and self.tag[self.open[-1]] == "script":
            self.attrs[self.open[-1]]["\0"] = self.attrs[self.open[-1]].get("\0", "") + data
        self.pieces.append("" if self.silent else data)

    # What a page holds

    def text(self, e: int) -> str:
        return " ".join("".join(self.pieces[self.start[e]:self.end[e]]).split())

    def sections(self) -> list[str]:
        """For each element, the headings above it, outer first. Headings in navigation and in items or cells, and those that an element
        stands in, don't count; a heading ends those of its level and deeper ones."""
        out, stack, inside = [], [], []
        for e, tag in enumerate(self.tag):
            level = _HEADINGS.get(tag, 0)
            inside = [h for h in inside if self.end[h] > self.start[e] or self.parent[e] == h]
            held = {h for h in inside if self._within(e, h)}
            path = [t for k, t, h in stack if h not in held]
            if level:
                path = [t for k, t, h in stack if h not in held and k < level]
            out.append(" / ".join(path))
            if level and not self.chrome[e] and not self.cell[e]:
                if label := _label(self.text(e)):
                    stack = [x for x in stack if x[0] < level] + [(level, label, e)]
                    inside.append(e)
        return out

    def _within(self, e: int, holder: int) -> bool:
        while e > holder:
            e = self.parent[e]
        return e == holder

    def objects(self) -> list[str]:
        """JSON-LD objects one by one, those of lists and graphs too; what isn't JSON is left out."""
        out = []
        for tag, a in zip(self.tag, self.attrs):
            if tag == "script" and a.get("type", "").lower() == "application/ld+json":
                try:
                    found = json.loads(a.get("\0", ""))
                except ValueError:
                    continue
                for o in found if isinstance(found, list) else [found]:
                    if isinstance(o, dict):
                        graph = o.get("@graph")
                        out += [json.dumps(x) for x in (o, *(graph if isinstance(graph, list) else ())) if isinstance(x, dict)]
        return out

    def repeated(self) -> list[dict]:
        """Runs of siblings of one kind (tag and classes), LEAST_REPEATED or more: their place in the tree, and each one's text and first link."""
        kinds, first = defaultdict(list), {}
        for e, tag in enumerate(self.tag):
            if self.parent[e] >= 0 and tag not in VOID and tag not in SILENT:
                kinds[self.parent[e], tag, " ".join(sorted(self.attrs[e].get("class", "").split()))].append(e)
            if tag == "a" and "href" in self.attrs[e]:
                up = e
                while up >= 0 and up not in first:
                    first[up] = self.attrs[e]["href"]
                    up = self.parent[up]
        out = []
        for (up, tag, _), own in kinds.items():
            if len(own) >= LEAST_REPEATED:
                items = [{"text": self.text(e), "href": first.get(e)} for e in own]
                out.append({"n": own[0], "path": f"{self.tag[up]}/{tag}", "chrome": self.chrome[own[0]], "items": [i for i in items if i["text"]]})
        return [x for x in sorted(out, key=lambda x: x["n"]) if len(x["items"]) >= LEAST_REPEATED]

    def tables(self) -> list[dict]:
        """Tables with named columns: names from cells of the first row (what they sort by, else their text), rows of cells by place."""
        cells, heads, rows, holder = defaultdict(list), defaultdict(list), defaultdict(list), {}
        for e, tag in enumerate(self.tag):
            up = self.parent[e]
            holder[e] = e if tag == "table" else holder.get(up, -1)
            if tag == "tr" and holder[e] >= 0:
                rows[holder[e]].append(e)
            elif tag in ("td", "th") and up >= 0:
                (heads if tag == "th" else cells)[up].append(e)
        out = []
        for t, own in rows.items():
            if names := [self.attrs[e].get("data-sort-col", "").strip().lower() or self.text(e).lower() for e in heads[own[0]]]:
                out.append({"n": t, "names": names, "rows": [[self.text(e) for e in cells[r]] for r in own if cells[r] and not heads[r]]})
        return out

    def figures(self) -> list[dict]:
        out = []
        at = {}
        for e, tag in enumerate(self.tag):
            up = self.parent[e]
            at[e] = e if tag == "figure" else at.get(up, -1)
            if tag == "figure":
                out.append({"n": e, "caption": "", "href": None, "image": None})
            elif at[e] >= 0:
                x, a = out[-1], self.attrs[e]
                if tag == "figcaption":
                    x["caption"] = self.text(e)
                elif tag == "img":
                    x["image"], x["caption"] = x["image"] or a.get("src") or None, x["caption"] or " ".join(a.get("alt", "").split())
                elif tag == "a":
                    x["href"] = x["href"] or a.get("href") or None
        return out

    def row(self) -> dict:
        every, sections = range(len(self.tag)), self.sections()
        of = lambda *t: [e for e in every if self.tag[e] in t]
        articles = of("article")
        place, near = {}, {"footer": "footer", "nav": "nav", "header": "header", "main": "main", "article": "main"}
        for e in every:
            up = self.parent[e]
            above = place.get(up, "body")
            own = near.get(self.tag[e])
            place[e] = above if above in ("footer", "nav", "header") or own is None else own
        kind = "article" if articles else "paragraph"
        return {
            "lang": next((self.attrs[e].get("lang") for e in of("html")), None), "title": next((self.text(e) for e in of("title")), ""),
            "metas": [{"key": (a.get("property") or a.get("name") or "").strip().lower(), "content": a.get("content", "").strip()} for a in (self.attrs[e] for e in of("meta")) if a.get("property") or a.get("name")],
            "heads": [{"rel": a.get("rel", "").lower(), "type": a.get("type", "").lower(), "href": a["href"]} for a in (self.attrs[e] for e in of("link")) if a.get("href")],
            "objects": self.objects(), "repeated": self.repeated(), "tables": self.tables(), "figures": self.figures(),
            "passages": [{"n": e, "kind": kind, "section": sections[e], "text": t} for e in articles or of("p") if not self.chrome[e] and (t := self.text(e))],
            "paragraphs": [{"n": e, "section": sections[e], "text": t, "chrome": self.chrome[e]} for e in of("p") if (t := self.text(e))],
            "links": [{"n": e, "href": self.attrs[e]["href"].strip(), "text": self.text(e), "rel": self.attrs[e].get("rel", "").lower(), "place": place[e], "section": sections[e]} for e in of("a") if self.attrs[e].get("href", "").strip()],
        }


def parse(html: str | None, loose: bool = False) -> Tree:
    """loose: &amp is read without its semicolon too."""
    t = Tree()
    t.feed(loose_references(html) if loose else whole_references(html))
    t.close()
    t._close(0)
    return t


def trees(pages: DataFrame, key: str = "page_id", html: str = "html", keep: tuple[str, ...] = (), loose: bool = False) -> DataFrame:
    """key, the columns of keep, and tree, a struct of TREE, for each row. loose: &amp is read without its semicolon too."""
    from pyspark.sql.pandas.types import to_arrow_schema

    head = pages.select(key, *keep).schema
    schema = StructType([*head, *StructType.fromDDL(f"tree struct<{StructType.fromDDL(TREE).simpleString()[7:-1]}>")])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for a in range(0, b.num_rows, 64):
                part = b.slice(a, 64)
                rows = [parse(h, loose).row() for h in part.column(part.num_columns - 1).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(rows, arrow.field(len(arrow) - 1).type)], schema=arrow)

    return pages.select(key, *keep, F.col(html).alias("_html")).mapInArrow(run, schema)
