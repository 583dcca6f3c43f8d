"""What a reader returns for one file, and the helpers all readers share."""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass, field

CHUNK_BYTES, EXCERPT_BYTES, MAX_TUPLES, TUPLE_BYTES = 10_240, 500, 200, 2000

NODE = "id string, kind string, name string, qualified_name string, file_path string, start_line int, end_line int, level int, metadata string, body_excerpt string"
EDGE = "source string, target string, kind string, line int"
LINK = "from_node_id string, reference_text string, reference_kind string, line int, file_path string"
CHUNK = "node_id string, file_path string, start_line int, end_line int, content_hash string, section_hash string, heading_path string, text string"
TUPLE = "node_id string, key string, value string, value_type string, source string, confidence double"
ENTITY = "node_id string, name string, entity_type string, alias string, line int"
RESULT = f"path string, content_hash string, size long, error string, nodes array<struct<{{n}}>>, edges array<struct<{{e}}>>, links array<struct<{{l}}>>, chunks array<struct<{{c}}>>, tuples array<struct<{{t}}>>, entities array<struct<{{x}}>>".format(
    **{k: re.sub(r"(\w+) (\w+)", r"\1:\2", v) for k, v in (("n", NODE), ("e", EDGE), ("l", LINK), ("c", CHUNK), ("t", TUPLE), ("x", ENTITY))}
)


@dataclass
class Parsed:
    path: str
    content_hash: str
    size: int
    error: str | None = None
    nodes: list[dict] = field(default_factory=list)
    edges: list[dict] = field(default_factory=list)
    links: list[dict] = field(default_factory=list)
    chunks: list[dict] = field(default_factory=list)
    tuples: list[dict] = field(default_factory=list)
    entities: list[dict] = field(default_factory=list)

    def entity(self, node: str, name: str, kind: str, alias: str | None, line: int) -> None:
        self.entities.append({"node_id": node, "name": name, "entity_type": kind, "alias": alias, "line": line})

    def node(self, id: str, kind: str, name: str, qualified: str, start: int, end: int, level: int = 0, metadata: str | None = None, text: str = "") -> None:
        self.nodes.append({"id": id, "kind": kind, "name": name, "qualified_name": qualified, "file_path": self.path, "start_line": start, "end_line": end,
                           "level": level, "metadata": metadata, "body_excerpt": excerpt(text)})

    def edge(self, source: str, target: str, kind: str, line: int = 0) -> None:
        self.edges.append({"source": source, "target": target, "kind": kind, "line": line})

    def link(self, source: str, text: str, kind: str, line: int) -> None:
        self.links.append({"from_node_id": source, "reference_text": text, "reference_kind": kind, "line": line, "file_path": self.path})

    def chunk(self, node: str, start: int, end: int, heading_path: str, text: str) -> None:
        text = cut(text, CHUNK_BYTES, "\n[...truncated]")
        self.chunks.append({"node_id": node, "file_path": self.path, "start_line": start, "end_line": end, "content_hash": self.content_hash,
                            "section_hash": sha(text.encode()), "heading_path": heading_path, "text": text})

    def tuple(self, node: str, key: str, value: str, source: str, confidence: float = 1.0) -> None:
        if value and len(self.tuples) >= MAX_TUPLES:
            self.error = self.error or f"only the first {MAX_TUPLES} metadata values are kept"
        elif value:
            self.tuples.append({"node_id": node, "key": key, "value": cut(value, TUPLE_BYTES), "value_type": value_type(value), "source": source, "confidence": confidence})


def sha(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def cut(text: str, most: int, mark: str = "") -> str:
    data = text.encode()
    return text if len(data) <= most else data[:most].decode(errors="ignore") + mark


def excerpt(text: str, most: int = EXCERPT_BYTES) -> str:
    text = " ".join(text.split())
    head = cut(text, most)
    at = head.rfind(" ")
    return head[:at] if len(head) < len(text) and at > len(head) // 2 else head


def slug(name: str) -> str:
    kept = "".join(c for c in name.lower() if c.isalnum() or c == "-" or c.isspace())
    return re.sub(r"\s+", "-", kept).strip("-")


def value_type(value: str) -> str:
    if re.fullmatch(r"\d{4}-\d{2}-\d{2}(?:[T ].*)?", value):
        return "date"
    if re.fullmatch(r"\[\[[^\]]+\]\]", value):
        return "ref"
    return "number" if re.fullmatch(r"[+-]?\d+(?:\.\d+)?", value) else "string"


def add_outline(out: Parsed, document: str, headings: list[tuple[str, str, int, int]], lines: list[str], body_from: int = 1) -> list[tuple[int, str]]:
    """Adds heading nodes, containment edges and chunks for headings (id, name, level, line).

    Returns (line, node) in order, for looking up the node that encloses a line.
    """
    places, stack = [], []
    for i, (node, name, level, line) in enumerate(headings):
        end = next((h[3] - 1 for h in headings[i + 1 :] if h[2] <= level), len(lines))
        while stack and stack[-1][1] >= level:
            stack.pop()
        crumbs = " > ".join([*(s[2] for s in stack), name])
        body = "\n".join(lines[line:end])
        out.node(node, "heading", name, f"{out.path}#{crumbs}", line, end, level, None, body)
        out.edge(stack[-1][0] if stack else document, node, "contains", line)
        out.chunk(node, line, end, crumbs, "\n".join(lines[line - 1 : end]))
        stack.append((node, level, name))
        places.append((line, node))
    return places


def enclosing(places: list[tuple[int, str]], document: str, line: int) -> str:
    import bisect

    at = bisect.bisect_right(places, (line, "\U0010ffff"))
    return places[at - 1][1] if at else document
