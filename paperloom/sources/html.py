"""HTML: title, headings, links and metas; scripts, styles and the head's other text do not count."""

from __future__ import annotations

import json
from html.parser import HTMLParser

from paperloom.sources.model import Parsed, add_outline, enclosing, sha

_HEADINGS = {f"h{i}": i for i in range(1, 7)}
_SILENT = {"script", "style", "noscript", "template"}


class _Reader(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.title, self.metas, self.headings, self.links = "", [], [], []
        self.lines: dict[int, list[str]] = {}
        self.silent, self.in_title, self.in_head, self.open = 0, False, False, None
        self.counts: dict[int, int] = {}

    def handle_starttag(self, tag, attributes):
        a, line = {k: v or "" for k, v in attributes}, self.getpos()[0]
        if tag in _SILENT:
            self.silent += 1
        elif tag == "head":
            self.in_head = True
        elif tag == "body":
            self.in_head = False
        elif tag == "title":
            self.in_title = True
        elif tag == "meta" and a.get("content") and (a.get("name") or a.get("property")):
            self.metas.append((a.get("name") or a["property"], a["content"]))
        elif tag == "a" and a.get("href"):
            self.links.append((a["href"].strip(), line))
        elif tag in _HEADINGS:
            level = _HEADINGS[tag]
            self.counts[0] = self.counts.get(0, 0) + 1
            self.open = [a.get("id") or f"h{level}-{self.counts[0]}", level, line, []]

    def handle_endtag(self, tag):
        if tag in _SILENT:
            self.silent = max(0, self.silent - 1)
        elif tag == "head":
            self.in_head = False
        elif tag == "title":
            self.in_title = False
        elif tag in _HEADINGS and self.open:
            self.headings.append((self.open[0], " ".join("".join(self.open[3]).split()), self.open[1], self.open[2]))
            self.open = None

    def handle_data(self, data):
        if self.silent:
            return
        if self.in_title:
            self.title += data
        elif not self.in_head:
            if self.open:
                self.open[3].append(data)
            first = self.getpos()[0]
            for i, part in enumerate(data.split("\n")):
                if part.strip():
                    self.lines.setdefault(first + i, []).append(part)


def parse(path: str, data: bytes) -> Parsed:
    text = data.decode("utf-8-sig", errors="replace")
    out, reader = Parsed(path, sha(data), len(data)), _Reader()
    try:
        reader.feed(text)
        reader.close()
    except Exception as e:  # noqa: BLE001  a broken page keeps what was read before the fault
        out.error = f"html: {str(e)[:200]}"
    total = text.count("\n") + 1
    lines = [" ".join(" ".join(reader.lines.get(i, [])).split()) for i in range(1, total + 1)]
    title = " ".join(reader.title.split()) or next((h[1] for h in reader.headings if h[2] == 1), "") or path.rsplit("/", 1)[-1].rsplit(".", 1)[0]
    body = "\n".join(line for line in lines if line)
    out.node(path, "document", title, path, 1, total, 0, json.dumps({"title": title}, ensure_ascii=False), body)
    out.chunk(path, 1, total, "", body)
    places = add_outline(out, path, [(f"{path}#{i}", name, level, line) for i, name, level, line in reader.headings], lines)
    for href, line in reader.links:
        source = enclosing(places, path, line)
        out.link(source, href, "external" if href.startswith(("http://", "https://")) else "html_link", line)
    for key, value in reader.metas:
        out.tuple(path, key, value, "html_meta")
    return out
