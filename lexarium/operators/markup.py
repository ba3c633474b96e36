"""Units of text in marked-up pages: an HTML scan that recovers from errors.

Pages are parsed one by one in Arrow batches; each block of text becomes a row
with its structural path, its place and the language in force.
"""

from __future__ import annotations

from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame

VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
DROP = {"script", "style", "nav", "footer", "head", "aside", "form", "noscript"}
BLOCK = {"p", "li", "h1", "h2", "h3", "h4", "h5", "h6", "td", "th", "pre", "blockquote", "dt", "dd", "figcaption"}


#: Openers that end a paragraph (fixed by HTML).
ENDS_P = {"p", "div", "ul", "ol", "dl", "table", "pre", "blockquote", "section", "article", "header", "footer", "nav", "aside", "form", "h1", "h2", "h3", "h4", "h5", "h6"}


class _Blocks(HTMLParser):
    """Collects (path, tag, lang, linked, text) of blocks; a closing tag ends whatever lies open above its opener."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open: list[tuple[str, str, str, bool]] = []  # tag, path, lang, dropped
        self.counts: list[dict] = [{}]
        self.blocks: list[dict] = []
        self.well_formed = True

    def handle_starttag(self, tag, attrs):
        if tag in VOID:
            self._say(" ")
            return
        if tag in ENDS_P and self.open and self.open[-1][0] == "p":
            self.handle_endtag("p")
        if tag == "li" and next((t for t, *_ in reversed(self.open) if t in ("li", "ul", "ol")), "") == "li":
            self.handle_endtag("li")
        n = self.counts[-1].setdefault(tag, 0) + 1
        self.counts[-1][tag] = n
        a = dict(attrs)
        up = self.open[-1] if self.open else ("", "", "", False)
        drop = up[3] or tag in DROP or "ad" in (a.get("class") or "").split()
        self.open.append((tag, f"{up[1]}/{tag}[{n}]", a.get("lang") or up[2], drop))
        self.counts.append({})
        if tag in BLOCK and not drop:
            self.blocks.append({"path": self.open[-1][1], "tag": tag, "lang": self.open[-1][2], "text": "", "linked": 0})

    def handle_endtag(self, tag):
        if tag in VOID:
            return
        if not any(t == tag for t, *_ in self.open):
            self.well_formed = False
            return
        while self.open:
            t = self.open.pop()[0]
            self.counts.pop()
            if t == tag:
                return
            self.well_formed = False

    def _say(self, data):
        if not self.open or self.open[-1][3]:
            return
        for tag, path, lang, _ in reversed(self.open):
            if tag in BLOCK:
                block = next((b for b in reversed(self.blocks) if b["path"] == path), None)
                break
        else:  # text outside any block is a block of its container
            path, lang = self.open[-1][1], self.open[-1][2]
            block = self.blocks[-1] if self.blocks and self.blocks[-1]["path"] == path else None
            if block is None:
                if not data.strip():
                    return
                block = {"path": path, "tag": self.open[-1][0], "lang": lang, "text": "", "linked": 0}
                self.blocks.append(block)
        if block is not None:
            block["text"] += data
            if any(t == "a" for t, *_ in self.open):
                block["linked"] += len(data)

    def handle_data(self, data):
        self._say(data)


def blocks_of(html: str | None) -> tuple[list[dict], bool]:
    p = _Blocks()
    try:
        p.feed(html or "")
        p.close()
    except (AssertionError, ValueError):  # what the parser raises on broken declarations; what came before stays
        p.well_formed = False
    out = []
    for b in p.blocks:
        text = " ".join(b["text"].replace("-\n", "").split())
        if text:
            out.append(b | {"text": text})
    return out, p.well_formed and not p.open


def units(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """page_id, seq, path, tag, lang, n_chars, link_share, text, well_formed of each block of text."""
    kinds = {"page_id": pa.int64(), "seq": pa.int64(), "path": pa.string(), "tag": pa.string(), "lang": pa.string(), "n_chars": pa.int64(), "link_share": pa.float64(), "text": pa.string(), "well_formed": pa.bool_()}

    def run(batches):
        for b in batches:
            rows = []
            for k, h in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                found, ok = blocks_of(h)
                rows += [{"page_id": k, "seq": i, "path": x["path"], "tag": x["tag"], "lang": x["lang"] or None, "n_chars": len(x["text"]), "link_share": min(1.0, x["linked"] / len(x["text"])), "text": x["text"], "well_formed": ok} for i, x in enumerate(found)]
            yield pa.RecordBatch.from_pylist(rows, schema=pa.schema(list(kinds.items())))

    return pages.select(pages[key].cast("long").alias("page_id"), html).mapInArrow(run, "page_id long, seq long, path string, tag string, lang string, n_chars long, link_share double, text string, well_formed boolean")
