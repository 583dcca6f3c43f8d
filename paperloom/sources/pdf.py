"""PDF pages that were extracted elsewhere; with the optional ``pypdf`` also the files themselves."""

from __future__ import annotations

import io

from paperloom.sources.model import Parsed, sha

MAX_PAGES, GARBAGE, SPARSE = 500, 0.3, 50


def pages_to_document(path: str, data: bytes, pages: list[str], info: dict[str, str] | None = None) -> Parsed:
    """A document whose pages are headings; pages of mostly unreadable characters are left out."""
    out = Parsed(path, sha(data), len(data))
    stem = path.rsplit("/", 1)[-1].rsplit(".", 1)[0]
    info = info or {}
    kept = [(n, p) for n, p in enumerate(pages[:MAX_PAGES], 1) if p.strip() and p.count("�") < GARBAGE * len(p)]
    if pages and sum(len(p.strip()) for _, p in kept) < SPARSE * min(len(pages), MAX_PAGES):
        out.error = "image-only-pdf"
    if len(pages) > MAX_PAGES:
        out.error = out.error or f"only the first {MAX_PAGES} pages are read"
    out.node(path, "document", info.get("title") or stem, path, 1, max(1, len(pages)), 0, None, "\n".join(p for _, p in kept))
    out.chunk(path, 1, max(1, len(pages)), "", "\n".join(p for _, p in kept))
    for n, text in kept:
        node = f"{path}#page-{n}"
        out.node(node, "heading", f"Page {n}", f"{path}#Page {n}", n, n, 1, None, text)
        out.edge(path, node, "contains", n)
        out.chunk(node, n, n, f"Page {n}", text)
    for key, value in info.items():
        out.tuple(path, key, value, "pdf_info")
    return out


def parse(path: str, data: bytes) -> Parsed:
    try:
        from pypdf import PdfReader
    except ImportError:
        out = pages_to_document(path, data, [])
        out.error = "no PDF reader is installed"
        return out
    try:
        reader = PdfReader(io.BytesIO(data))
        pages = [(p.extract_text() or "") for p in reader.pages[:MAX_PAGES]]
        info = {k.lstrip("/").lower(): str(v) for k, v in (reader.metadata or {}).items()}
        return pages_to_document(path, data, pages, info)
    except Exception as e:  # noqa: BLE001
        out = pages_to_document(path, data, [])
        out.error = f"pdf: {str(e)[:200]}"
        return out
