"""Units of marked-up editions: an XML scan that recovers from errors, and the rules that divide a text into works.

A document is read once, as a stream of tags.  Each element gets the interval of places
that it spans, so that a unit is an interval without some inner intervals, and the lines of a unit
are those whose place lies in it.  A file is one row; its size bounds a task's memory.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_left
from xml.parsers import expat

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_schema

# Names of elements and types of divisions.
DROPPED = {"speaker", "stage", "note", "head", "gap", "figure", "fw"}
LINES = {"l", "p"}
WORKS = {"masque", "maque", "entertainment", "pageant", "play", "tragedy", "comedy", "interlude", "dialogue"}
HEADED = WORKS - {"maque"} | {"part"}
WRAPPERS = {"collection_of_masques", "text", "masques", "entertainments", "section"}
PARTED = {"entertainment", "entertainments", "pageant"}
NUMBERED_PART = re.compile(
    r"\b(firste?|seconde?|thirde?|fourth|fift|fifth|1|2|3|4|5|i|ii|iii|iv|v)\.?\s+(part|parte)\b|\b(part|parte)\s+(the\s+)?(firste?|seconde?|thirde?|1|2|3|i|ii|iii)\b|\b(prima|secunda|tertia)\s+pars\b|\b(prim[ae]|secund[ae]|terti[ae])\s+partis\b",
    re.I,
)
DEPTH = 3

_TAG = re.compile(r"<!--.*?-->|<!\[CDATA\[(?P<cdata>.*?)\]\]>|<[?!][^>]*>|<(?P<end>/?)(?P<name>[A-Za-z_][\w:.-]*)(?P<attrs>(?:[^<>\"']|\"[^\"]*\"|'[^']*')*?)(?P<empty>/?)>", re.S)
_ATTR = re.compile(r"([\w:.-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)')")
_space = lambda s: " ".join(s.split())


class Edition:
    """Elements and lines of a document, by place."""

    def __init__(self):
        self.tag, self.attrs, self.up, self.path, self.last = [], [], [], [], []  # by element; ``last``: the last place inside
        self.kids: list[list[int]] = []
        self.said: list[str] = []  # all pieces of text
        self.heard: list[list[int]] = []  # by element: its first piece and the first after it
        self.lines: list[dict] = []
        self.open: list[tuple[int, int | None, bool, dict]] = []  # element, its line, whether dropped, tags seen in it
        self.joins = False
        self.well_formed = True

    def start(self, tag: str, attrs: dict) -> None:
        tag = tag.rsplit(":", 1)[-1]
        up, line, dropped, seen = self.open[-1] if self.open else (-1, None, False, {})
        seen[tag] = n = seen.get(tag, 0) + 1
        at = len(self.tag)
        self.tag.append(tag)
        self.attrs.append(attrs)
        self.up.append(up)
        self.last.append(at)
        self.kids.append([])
        self.heard.append([len(self.said), len(self.said)])
        self.path.append((self.path[up] if up >= 0 else "") + f"/{tag}[{n}]")
        if up >= 0:
            self.kids[up].append(at)
        dropped = dropped or tag in DROPPED or self._hyphen(at)
        if tag in LINES and line is None and not dropped:
            line = len(self.lines)
            above = self.above(at)
            self.lines.append({"at": at, "pieces": [], "in_sp": any(self.tag[x] == "sp" for x in above), "div_path": ">".join(self.attrs[x].get("type") or "?" for x in reversed(above) if self.tag[x] == "div"), "parent": self.tag[up] if up >= 0 else ""})
        self.open.append((at, line, dropped, {}))
        self.joins = False

    def _hyphen(self, at: int) -> bool:
        return self.tag[at] == "g" and "EOLhyphen" in self.attrs[at].get("ref", "")

    def end(self, *_) -> None:
        at = self.open.pop()[0]
        self.last[at] = len(self.tag) - 1
        self.heard[at][1] = len(self.said)
        self.joins = self._hyphen(at)

    def data(self, text: str) -> None:
        if not self.open:
            return
        _, line, dropped, _ = self.open[-1]
        if self.joins:  # a word that the end of a printed line has cut
            text = text.lstrip()
            self.joins = not text
        self.said.append(text)
        if line is not None and not dropped:
            self.lines[line]["pieces"].append(text)

    def above(self, at: int) -> list[int]:
        out = []
        while self.up[at] >= 0:
            at = self.up[at]
            out.append(at)
        return out

    def child(self, at: int, tag: str) -> int | None:
        return next((k for k in self.kids[at] if self.tag[k] == tag), None)

    def kind(self, at: int) -> str:
        return self.attrs[at].get("type", "") if self.tag[at] == "div" else ""

    def text(self, at: int) -> str:
        return _space("".join(self.said[slice(*self.heard[at])]))


def parse(xml: str | None) -> Edition:
    """Read strictly; on an error read again with a scan that skips stray end tags and closes what is left open."""
    ed = Edition()
    p = expat.ParserCreate("utf-8")  # the text is decoded, whatever its declaration names
    p.buffer_text = True
    p.StartElementHandler, p.EndElementHandler, p.CharacterDataHandler = ed.start, ed.end, ed.data
    try:
        p.Parse((xml or "").encode("utf-8", "replace"), True)
        return ed
    except expat.ExpatError:
        return recover(xml or "")


def recover(xml: str) -> Edition:
    ed, at = Edition(), 0
    ed.well_formed = False
    for m in _TAG.finditer(xml):
        ed.data(html.unescape(xml[at : m.start()]))
        at = m.end()
        name = m["name"]
        if m["cdata"] is not None:
            ed.data(m["cdata"])
        elif name and m["end"]:
            local = name.rsplit(":", 1)[-1]
            if any(ed.tag[x] == local for x, *_ in ed.open):
                while ed.tag[ed.open[-1][0]] != local:
                    ed.end()
                ed.end()
        elif name:
            ed.start(name, {k: html.unescape(a or b) for k, a, b in _ATTR.findall(m["attrs"])})
            if m["empty"]:
                ed.end()
    ed.data(html.unescape(xml[at:]))
    while ed.open:
        ed.end()
    return ed


def _unit(uid, kind, div_type, node, text, without=(), parent="", span=""):
    return {"uid": uid, "kind": kind, "div_type": div_type, "node": node, "text": text, "without": list(without), "parent": parent, "span": span}


def _texts(ed: Edition, text: int, base: str):
    """(text element, id) of the texts that have no texts of their own."""
    group = ed.child(text, "group")
    if group is None:
        yield text, base
    else:
        inner = [k for k in ed.kids[group] if ed.tag[k] == "text"]
        for n, k in enumerate(inner, 1):
            yield from _texts(ed, k, f"{base}.{n}")


def _works(ed: Edition, node: int, forced: bool) -> list[int]:
    """Divisions of a container that are works of their own."""
    divs = lambda x: [k for k in ed.kids[x] if ed.tag[k] == "div"]
    found = divs(node)
    if len(found) == 1 and ed.kind(found[0]) in WRAPPERS:
        found = divs(found[0])
    by_kind = lambda kinds: [d for d in found if ed.kind(d) in kinds]
    if by_kind({"act", "scene"}):
        return []
    works = by_kind({"section"} if forced else WORKS)
    parts = by_kind({"part"})
    if not works and len(parts) > 1:
        heads = [ed.child(d, "head") for d in parts]
        if ed.kind(node) in PARTED or any(h is not None and NUMBERED_PART.search(ed.text(h)) for h in heads):
            works = parts
    return works if len(works) > (ed.kind(node) not in WORKS) else []


def divide(ed: Edition, base: str, collection: bool, forced: frozenset = frozenset()) -> list[dict]:
    """Units of a document: group texts, a collection's divisions, works within works (three deep), and what is left of each container."""
    root = next((i for i, t in enumerate(ed.tag) if t == "text"), None)
    if root is None:
        return []
    todo = []
    grouped = ed.child(root, "group") is not None
    for text, uid in _texts(ed, root, base):
        body = ed.child(text, "body")
        if body is None:
            continue
        if collection and not grouped:
            divs = [k for k in ed.kids[body] if ed.tag[k] == "div"]
            todo += [(_unit(f"{uid}.{n}", "body_div", ed.kind(d), d, text, parent=uid), 0) for n, d in enumerate(divs, 1)]
            todo.append((_unit(f"{uid}.0", "residual", "residual", body, text, divs, uid), DEPTH))
        else:
            todo.append((_unit(uid, "group_text" if grouped else "single", "", body, text), 0))
    out = []
    todo.reverse()
    while todo:
        u, depth = todo.pop()
        works = _works(ed, u["node"], u["uid"] in forced) if depth < DEPTH else []
        if not works:
            out.append(u)
            continue
        inner = [(_unit(f"{u['uid']}.{n}", "work_div", ed.kind(d), d, u["text"], parent=u["uid"]), depth + 1) for n, d in enumerate(works, 1)]
        inner.append((_unit(f"{u['uid']}.0", "residual", "residual", u["node"], u["text"], works, u["uid"]), DEPTH))
        todo += reversed(inner)
    return out


def cut(ed: Edition, units: list[dict], splits: list[dict]) -> list[dict]:
    """Units divided by decided ranges of a container's children; a range beyond them, or children that no part takes, are errors."""
    decided: dict[str, list[dict]] = {}
    for s in splits:
        decided.setdefault(s["unit_id"], []).append(s)
    places = {p: i for i, p in enumerate(ed.path)}
    out = []
    for u in units:
        rules = sorted(decided.get(u["uid"], []), key=lambda s: s["first"])
        if not rules:
            out.append(u)
            continue
        where = rules[0]["container"]
        box = places.get(where)
        if box is None or not u["node"] <= box <= ed.last[u["node"]]:
            raise ValueError(f"split of {u['uid']}: no container {where} inside the unit")
        kids, taken = ed.kids[box], []
        for s in rules:
            if not 1 <= s["first"] <= s["last"] <= len(kids):
                raise ValueError(f"split of {u['uid']}: range {s['first']}-{s['last']} of {len(kids)} children")
            part = kids[s["first"] - 1 : s["last"]]
            if set(part) & set(taken):
                raise ValueError(f"split of {u['uid']}: ranges overlap")
            taken += part
            out.append(_unit(f"{u['uid']}.{s['part']}", "work_div", s["div_type"], box, u["text"], [k for k in kids if k not in set(part)] + u["without"], u["uid"], f"{where} {s['first']}-{s['last']}"))
        if any(s["residual"] for s in rules):
            out.append(_unit(f"{u['uid']}.0", "residual", "residual", u["node"], u["text"], taken + u["without"], u["uid"], f"{where} without the parts"))
        elif len(taken) < len(kids):
            raise ValueError(f"split of {u['uid']}: {len(kids) - len(taken)} children are in no part")
    return out


class _Within:
    """Whether a place belongs to a unit."""

    def __init__(self, ed: Edition, unit: dict):
        self.low, self.high = unit["node"], ed.last[unit["node"]]
        gone, end = [], -1
        for a in sorted(unit["without"]):
            if a > end:  # not inside the one before
                gone.append((a, ed.last[a]))
                end = ed.last[a]
        self.starts, self.ends = [a for a, _ in gone], [b for _, b in gone]

    def __call__(self, at: int) -> bool:
        k = bisect_left(self.starts, at + 1) - 1
        return self.low <= at <= self.high and not (k >= 0 and at <= self.ends[k])


def _head(ed: Edition, inside: list[int]) -> str:
    """The heading of the first work division that has one, else the first heading."""
    kept = set(inside)
    tops = (ed.child(x, "head") for x in inside if ed.kind(x) in HEADED)
    for h in [*(h for h in tops if h in kept), *(x for x in inside if ed.tag[x] == "head")]:
        if words := ed.text(h):
            return words[:120]
    return ""


def read(key, xml, collection: bool, splits: list[dict], forced: frozenset) -> list[dict]:
    """The units of one document with their lines; an empty rest is no unit."""
    ed = parse(xml)
    for line in ed.lines:
        line["text"] = _space("".join(line["pieces"]))
    lines = [x for x in ed.lines if x["text"]]
    out = []
    for u in cut(ed, divide(ed, str(key), collection, forced), splits):
        within = _Within(ed, u)
        held = [x for x in lines if within(x["at"])]
        if u["kind"] == "residual" and not held:
            continue
        inside = [i for i in range(u["node"], ed.last[u["node"]] + 1) if within(i)]
        count = lambda tag: sum(ed.tag[i] == tag for i in inside)
        gaps = [ed.attrs[i].get("extent") or "?" for i in inside if ed.tag[i] == "gap" and ed.attrs[i].get("reason", "").startswith("missing")]
        spoken = sum(len(x["text"]) for x in held if x["in_sp"])
        out.append({
            "unit_id": u["uid"], "parent_unit": u["parent"] or None, "kind": u["kind"], "div_type": u["div_type"], "node_path": ed.path[u["node"]], "child_range": u["span"], "head": _head(ed, inside), "n_speeches": count("sp"), "n_lines": len(held), "spoken_chars": spoken,
            "other_chars": sum(len(x["text"]) for x in held) - spoken, "dropped_stage": count("stage"), "dropped_note": count("note"), "missing_gaps": len(gaps), "missing_extent": ";".join(gaps), "has_front": ed.child(u["text"], "front") is not None, "well_formed": ed.well_formed,
            "lines": [{"seq": n, "node_path": ed.path[x["at"]], "div_path": x["div_path"], "in_sp": x["in_sp"], "parent": x["parent"], "text": x["text"]} for n, x in enumerate(held, 1)],
        })
    return out


def matter(key, xml) -> list[dict]:
    """Lines before and after the body of each text of a document, nested texts included."""
    ed = parse(xml)
    out = []
    for at, tag in enumerate(ed.tag):
        if tag not in ("front", "back") or ed.up[at] < 0 or ed.tag[ed.up[at]] != "text":
            continue
        held = [(x, words) for x in ed.lines if at <= x["at"] <= ed.last[at] and (words := _space("".join(x["pieces"])))]
        out += [{"text_path": ed.path[ed.up[at]], "section": tag, "seq": n, "node_path": ed.path[x["at"]], "div_path": x["div_path"], "in_sp": x["in_sp"], "parent": x["parent"], "text": words} for n, (x, words) in enumerate(held, 1)]
    return out


_LINE = "struct<seq: long, node_path: string, div_path: string, in_sp: boolean, parent: string, text: string>"
UNITS = f"unit_id string, parent_unit string, kind string, div_type string, node_path string, child_range string, head string, n_speeches long, n_lines long, spoken_chars long, other_chars long, dropped_stage long, dropped_note long, missing_gaps long, missing_extent string, has_front boolean, well_formed boolean, lines array<{_LINE}>"


def units(files: DataFrame, splits: DataFrame | None = None, forced: frozenset[str] = frozenset()) -> DataFrame:
    """Units, with their lines, of marked-up editions.

    ``files`` has key (distinct), xml and collection.  ``splits`` has key, unit_id, part, container,
    first, last, div_type and residual: decided ranges of children.  ``forced`` names units whose
    sections are works.  A null or empty text has no units; a file without a text element neither.
    """
    rule = "array<struct<unit_id: string, part: string, container: string, first: long, last: long, div_type: string, residual: boolean>>"
    files = files.select(F.col("key").cast("string").alias("key"), "xml", F.coalesce("collection", F.lit(False)).alias("collection"))
    if splits is None:
        given = files.withColumn("splits", F.array().cast(rule))
    else:
        cols = ("unit_id", "part", "container", F.col("first").cast("long").alias("first"), F.col("last").cast("long").alias("last"), "div_type", "residual")
        by_key = splits.groupBy(F.col("key").cast("string").alias("key")).agg(F.collect_list(F.struct(*cols)).cast(rule).alias("splits"))
        given = files.join(by_key, "key", "left").withColumn("splits", F.coalesce("splits", F.array().cast(rule)))
    return _rows(given.select("key", "xml", "collection", "splits"), lambda xml, collection, rules, key: read(key, xml, collection, rules or [], forced), UNITS)


def front_and_back(files: DataFrame) -> DataFrame:
    """key and lines of the matter around the body of each text."""
    return _rows(files.select(F.col("key").cast("string").alias("key"), "xml"), lambda xml, key: matter(key, xml), "text_path string, section string, seq long, node_path string, div_path string, in_sp boolean, parent string, text string")


def _rows(files: DataFrame, f, cols: str) -> DataFrame:
    """The rows that ``f`` makes of each document, which come out before the next is read."""
    schema = files.sparkSession.createDataFrame([], "key string, " + cols).schema
    kinds = to_arrow_schema(schema)

    def run(batches):
        for b in batches:
            for row in zip(*(c.to_pylist() for c in b.columns)):
                found = [{"key": row[0], **r} for r in f(*row[1:], key=row[0])]
                if found:
                    yield pa.RecordBatch.from_pylist(found, schema=kinds)

    return files.mapInArrow(run, schema)


def unit_lines(units: DataFrame) -> DataFrame:
    """One row a line: key, unit_id, parent_unit and the line's fields."""
    return units.select("key", "unit_id", "parent_unit", F.explode("lines").alias("line")).select("key", "unit_id", "parent_unit", "line.*")
