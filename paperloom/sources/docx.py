"""Word documents: a zip of XML with limits on entries and sizes."""

from __future__ import annotations

import io
import json
import re
import zipfile
from xml.etree import ElementTree

from paperloom.sources.model import Parsed, add_outline, enclosing, sha, slug

MAX_ENTRIES, MAX_DOCUMENT, MAX_OTHER, MAX_TOTAL = 500, 30 << 20, 1 << 20, 50 << 20

_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
_STYLE = re.compile(r"(?i)^(?:heading|überschrift|titre)\s*([1-6])$")


def _check(archive: zipfile.ZipFile) -> None:
    entries = archive.infolist()
    if len(entries) > MAX_ENTRIES:
        raise ValueError("too many entries")
    total = 0
    for e in entries:
        if e.filename.startswith(("/", "\\")) or ".." in re.split(r"[/\\]", e.filename):
            raise ValueError("entry leaves the archive")
        total += e.file_size
        if e.file_size > (MAX_DOCUMENT if e.filename == "word/document.xml" else MAX_OTHER) and e.filename.endswith((".xml", ".rels")):
            raise ValueError(f"{e.filename} exceeds size limit")
    if total > MAX_TOTAL:
        raise ValueError("archive exceeds size limit")


def _xml(archive: zipfile.ZipFile, name: str):
    if name not in archive.namelist():
        return None
    data = archive.read(name)
    if b"<!DOCTYPE" in data[:2000] or b"<!ENTITY" in data:
        raise ValueError("document type declarations are not read")
    return ElementTree.fromstring(data)


def parse(path: str, data: bytes) -> Parsed:
    out = Parsed(path, sha(data), len(data))
    stem = path.rsplit("/", 1)[-1].rsplit(".", 1)[0]
    try:
        with zipfile.ZipFile(io.BytesIO(data)) as archive:
            _check(archive)
            body, rels, core = (_xml(archive, n) for n in ("word/document.xml", "word/_rels/document.xml.rels", "docProps/core.xml"))
            if body is None:
                raise ValueError("no word/document.xml")
    except Exception as e:  # noqa: BLE001  a damaged file becomes a document with an error
        out.error = f"docx: {str(e)[:200]}"
        out.node(path, "document", stem, path, 1, 1)
        return out
    targets = {r.get("Id"): r.get("Target") for r in rels} if rels is not None else {}
    lines, headings, links = [], [], []
    for p in body.iter(f"{_W}p"):
        text = "".join("\t" if t.tag == f"{_W}tab" else t.text or "" for t in p.iter() if t.tag in (f"{_W}t", f"{_W}tab"))
        lines.append(text)
        style = p.find(f"{_W}pPr/{_W}pStyle")
        if style is not None and text.strip() and (m := _STYLE.match(style.get(f"{_W}val", ""))):
            headings.append((f"{path}#heading-{slug(text)}-{len(headings)}", text.strip(), int(m[1]), len(lines)))
        for h in p.iter(f"{_W}hyperlink"):
            if target := targets.get(h.get(f"{_R}id")):
                links.append((target, len(lines)))
    props = {e.tag.rsplit("}", 1)[-1]: (e.text or "").strip() for e in core} if core is not None else {}
    title = props.get("title") or next((h[1] for h in headings if h[2] == 1), stem)
    text = "\n".join(lines)
    out.node(path, "document", title, path, 1, max(1, len(lines)), 0, json.dumps({"title": title}, ensure_ascii=False), text)
    out.chunk(path, 1, max(1, len(lines)), "", text)
    places = add_outline(out, path, headings, lines)
    for target, line in links:
        source = enclosing(places, path, line)
        out.link(source, target, "external" if target.startswith(("http://", "https://")) else "docx_hyperlink", line)
    for key, value in props.items():
        out.tuple(path, key, value, "docx_core_xml")
    return out
