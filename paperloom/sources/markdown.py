"""Markdown: front matter, headings, links, wikilinks, embeds, definitions and tags."""

from __future__ import annotations

import json
import re

from paperloom.sources.model import Parsed, add_outline, enclosing, sha, slug

FRONT_MATTER_BYTES = 8192

_ATX = re.compile(r"^ {0,3}(#{1,6})(?:[ \t]+(.*?))?(?:[ \t]+#+)?[ \t]*$")
_SETEXT = re.compile(r"^ {0,3}(=+|-+)[ \t]*$")
_FENCE = re.compile(r"^ {0,3}(`{3,}|~{3,})(.*)$")
_CODE = re.compile(r"(`+)(?!`).*?(?<!`)\1(?!`)")
_INLINE = re.compile(r"(!?)\[((?:[^\[\]]|\[[^\]]*\])*)\]\(\s*<?([^()\s<>]*(?:\([^()\s]*\)[^()\s<>]*)*)>?(?:\s+[\"'(][^\n]*?[\"')])?\s*\)")
_REFERENCE = re.compile(r"(?<!!)\[([^\[\]]+)\]\[([^\[\]]*)\]")
_DEFINED = re.compile(r"^ {0,3}\[([^\]^]+)\]:\s*<?(\S+?)>?(?:\s+[\"'(].*)?$")
_AUTO = re.compile(r"<((?:https?|mailto):[^\s<>]+)>|(?<![(\[<\"'=\w])(https?://[^\s<>()\[\]]+[^\s<>()\[\].,;:!?'\"])")
_WIKI = re.compile(r"(!?)\[\[([^\[\]|\n]+)(?:\|([^\[\]\n]*))?\]\]")
_TERM = re.compile(r"^\*\*([^*\n]+?):?\*\*:?[ \t]+(\S.*)$")


def front_matter(text: str) -> tuple[dict, int, str | None]:
    """(values, lines taken, error): the first line must be dashes only."""
    lines = text.split("\n")
    if not re.fullmatch(r"-{3,}\s*", lines[0] if lines else ""):
        return {}, 0, None
    end = next((i for i in range(1, len(lines)) if re.fullmatch(r"(?:-{3,}|\.{3})\s*", lines[i])), None)
    if end is None:
        return {}, 0, "unexpected end of frontmatter"
    body = "\n".join(lines[1:end])
    if len(body.encode()) > FRONT_MATTER_BYTES:
        return {}, end + 1, "frontmatter exceeds size limit"
    try:
        import yaml

        values = yaml.safe_load(body)
    except ImportError:
        values = {k.strip(): v.strip() for k, _, v in (line.partition(":") for line in body.split("\n") if ":" in line)}
    except Exception as e:  # noqa: BLE001  whatever a broken header raises, the document is still read
        return {}, end + 1, f"frontmatter: {str(e)[:200]}"
    return (values if isinstance(values, dict) else {}), end + 1, None


def _flat(value) -> str:
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, (list, dict)):
        return json.dumps(value, ensure_ascii=False, default=str)
    return "" if value is None else str(value)


def _strings(value) -> list[str]:
    return [s for v in value for s in _strings(v)] if isinstance(value, list) else [value] if isinstance(value, str) else []


MAX_ENTITIES = 500


def parse(path: str, data: bytes) -> Parsed:
    text = data.decode("utf-8-sig", errors="replace").replace("\r\n", "\n")
    out = Parsed(path, sha(data), len(data))
    values, skip, out.error = front_matter(text)
    lines = text.split("\n")
    headings, plain, targets = [], [], {}
    fence = comment = False
    seen: dict[str, int] = {}
    for number, line in enumerate(lines, 1):
        shown = ""
        if number <= skip:
            pass
        elif fence:
            mark = _FENCE.match(line)
            fence = False if mark and mark[1].startswith(fence) and not mark[2].strip() else fence
        elif comment:
            comment = "-->" not in line
        elif mark := _FENCE.match(line):
            fence = mark[1]
        elif line.lstrip().startswith("<!--"):
            comment = "-->" not in line
        else:
            shown = line
        level = name = at = None
        if shown and (m := _ATX.match(shown)):
            level, name, at = len(m[1]), m[2] or "", number
        elif shown and (m := _SETEXT.match(shown)) and plain and plain[-1].strip() and not re.match(r"\s*(?:[-*+>#|]|\d+[.)])", plain[-1]):
            level, name, at = (1 if m[1][0] == "=" else 2), plain[-1].strip(), number - 1
        if level:
            name = re.sub(r"[*_`]|!?\[([^\]]*)\]\([^)]*\)", lambda x: x[1] or "", name).strip()
            base = slug(name)
            seen[base] = seen.get(base, 0) + 1
            headings.append((f"{path}#{base}" + (f"-{seen[base]}" if seen[base] > 1 else ""), name, level, at))
        elif shown and (m := _DEFINED.match(shown)):
            targets[m[1].lower()] = m[2]
            shown = ""
        plain.append(shown)
    first = next((h[1] for h in headings if h[2] == 1), None)
    stem = re.sub(r"(?<=.)\.[^.]*$", "", path.rsplit("/", 1)[-1])
    title = first or (str(values["title"]) if values.get("title") else stem)
    tags = [t for v in (values.get("tags") or []) for t in [str(v).strip()] if t] if isinstance(values.get("tags"), list) else str(values.get("tags") or "").split()
    meta = json.dumps({**({"title": str(values["title"])} if values.get("title") else {}), "tags": tags}, ensure_ascii=False) if values else None
    out.node(path, "document", title, path, 1, len(lines), 0, meta, "\n".join(lines[skip:]))
    out.chunk(path, 1, len(lines), "", "\n".join(lines[skip:]))
    places = add_outline(out, path, headings, lines)
    for number, line in enumerate(plain, 1):
        bare = _CODE.sub(" ", line)
        if not bare.strip():
            continue
        source = enclosing(places, path, number)
        if m := _TERM.match(bare):
            node = f"{path}#def-{slug(m[1])}"
            out.node(node, "definition", m[1].strip(), node, number, number, 0, None, m[2])
            out.edge(source, node, "contains", number)
        for m in _WIKI.finditer(bare):
            out.link(source, m[2] + (f"|{m[3]}" if m[3] else ""), "embed" if m[1] else "wikilink", number)
            if not m[1] and (named := re.split(r"[#|]", m[2])[0].strip()):
                out.entity(source, named, "concept", None, number)
        bare = _WIKI.sub(" ", bare)
        for m in _INLINE.finditer(bare):
            if m[3] and not m[1]:
                out.link(source, m[3], _kind(m[3]), number)
        bare = _INLINE.sub(" ", bare)
        for m in _REFERENCE.finditer(bare):
            if target := targets.get((m[2] or m[1]).lower()):
                out.link(source, target, _kind(target), number)
        for m in _AUTO.finditer(bare):
            out.link(source, m[1] or m[2], "external", number)
    for tag in {t.lower(): t for t in reversed(tags)}.values():
        out.node(f"tag:{tag.lower()}", "tag", tag, tag, 0, 0)
        out.edge(path, f"tag:{tag.lower()}", "tagged")
    for key, value in values.items():
        for s in _strings(value):
            for m in _WIKI.finditer(s):
                out.link(path, m[2], "wikilink", 0)
        if key == "skill_advisory" and isinstance(value, dict):
            for k, v in value.items():
                out.tuple(path, str(k), _flat(v), "skill_advisory", 0.5)
        elif key not in ("tags", "entities"):
            out.tuple(path, str(key), _flat(value), "frontmatter")
    named = entities(values)
    if len(named) > MAX_ENTITIES:
        out.error = out.error or f"only the first {MAX_ENTITIES} entities are kept"
    for e in named[:MAX_ENTITIES]:
        for alias in [None, *e["aliases"]]:
            out.entity(path, e["name"], e["type"], alias, 0)
    return out


def _kind(target: str) -> str:
    return "external" if re.match(r"https?://", target) else "markdown_link"


def entities(values: dict) -> list[dict]:
    """The ``entities`` of a front matter: name, type, aliases."""
    rows = values.get("entities") if isinstance(values.get("entities"), list) else []
    return [{"name": str(e["name"]), "type": str(e.get("type") or "concept"), "aliases": _strings(e.get("aliases") or [])} for e in rows if isinstance(e, dict) and e.get("name")]
