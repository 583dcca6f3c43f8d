"""Documentation inside source code: file headers, documented symbols, tests and examples.

One scanner serves all languages; a language is a row of its table: how comments look, which lines
declare a symbol, and what marks a test or an example.
"""

from __future__ import annotations

import json
import re
from dataclasses import dataclass

from paperloom.sources.model import Parsed, cut, sha

MAX_ENTRIES, MAX_TEXT = 500, 10_240


@dataclass(frozen=True)
class Language:
    name: str
    line: str = ""  # what starts a line comment
    block: tuple[str, str] = ("", "")
    symbol: str = ""  # declaration; group "name"
    test: str = ""  # declaration of a test; group "name"
    marker: str = ""  # a line before a declaration that makes it a test
    exported: str = ""  # names that count; all if empty
    example: str = ""  # names or comments of examples
    test_file: str = r"(?i)(?:^|/)tests?/|[._-](?:test|spec)\.|(?:test|spec)s?\.\w+$"
    docstring: bool = False
    script: str = ""  # only what stands in this element
    doc_only: str = ""  # comments that document (by their start); all if empty


_C = dict(line="//", block=("/*", "*/"))
_FUNC = r"^\s*(?:[\w:<>,\[\]&*~?]+[ \t]+)+[*&]?(?P<name>[A-Za-z_]\w*)\s*\("
_CLASS = r"^\s*(?:[\w@()\[\]]+\s+)*(?:class|interface|struct|enum|object|record|trait|protocol|extension|mixin)\s+(?P<name>\w+)"
_JS = r"^\s*(?:export\s+)?(?:default\s+)?(?:async\s+)?(?:function\*?|class|interface|type|enum|const|let|var)\s+(?P<name>[\w$]+)"
_JSTEST = r"^\s*(?:describe|it|test)(?:\.\w+)*(?:\([^)]*\))?\(\s*[\"'`](?P<name>[^\"'`]+)"

#: Extension -> language.
LANGUAGES: dict[str, Language] = {
    e: language
    for extensions, language in [
        ("go", Language("go", **_C, symbol=r"^(?:func\s+(?:\([^)]*\)\s*)?|type\s+|const\s+|var\s+)(?P<name>\w+)", test=r"^func\s+(?P<name>Test\w+)\s*\(", exported=r"^[A-Z]", example=r"^Example", test_file=r"_test\.go$")),
        ("py", Language("python", line="#", symbol=r"^\s*(?:async\s+)?(?:def|class)\s+(?P<name>\w+)", test=r"^\s*(?:async\s+)?(?:def\s+(?P<name>test_\w+)|class\s+(?P<name2>Test\w*))", exported=r"^(?!_)", docstring=True)),
        ("rb", Language("ruby", line="#", symbol=r"^\s*(?:def|class|module)\s+(?:self\.)?(?P<name>[\w?!=]+)", test=r"^\s*(?:def\s+(?P<name>test_\w+)|(?:it|describe|context)\s+[\"'](?P<name2>[^\"']+))")),
        ("js jsx mjs", Language("javascript", **_C, symbol=_JS, test=_JSTEST, doc_only="/**")), ("ts tsx", Language("typescript", **_C, symbol=_JS, test=_JSTEST, doc_only="/**")),
        ("svelte", Language("svelte", **_C, symbol=_JS, test=_JSTEST, doc_only="/**", script="script")), ("vue", Language("vue", **_C, symbol=_JS, test=_JSTEST, doc_only="/**", script="script")),
        ("rs", Language("rust", line="///", block=("/**", "*/"), symbol=r"^\s*pub(?:\([^)]*\))?\s+(?:async\s+|unsafe\s+|const\s+)*(?:fn|struct|enum|trait|type|mod|static)\s+(?P<name>\w+)", test=r"^\s*(?:async\s+)?fn\s+(?P<name>\w+)", marker=r"^\s*#\[(?:\w+::)?test", example=r"# Examples")),
        ("c cc h", Language("c", **_C, symbol=_FUNC, test=r"^\s*(?:\w+\s+)+(?P<name>test_\w+)\s*\(")), ("cpp cxx hpp hh", Language("cpp", **_C, symbol=rf"{_FUNC}|^\s*(?:class|struct)\s+(?P<name2>\w+)", test=r"^\s*TEST(?:_F|_P)?\s*\((?P<name>[^)]*)\)")),
        ("java", Language("java", **_C, symbol=rf"{_CLASS}|^\s*(?:public|protected)\s+(?:[\w<>,\[\]?]+\s+)+(?P<name2>\w+)\s*\(", test=r"^\s*(?:[\w<>]+\s+)+(?P<name>\w+)\s*\(", marker=r"^\s*@(?:\w*Test)\b", doc_only="/**", test_file=r"(?:^|/)src/test/|(?:Test|Spec)s?\.java$")),
        ("kt kts", Language("kotlin", **_C, symbol=rf"{_CLASS}|^\s*(?:\w+\s+)*(?:fun|val|var)\s+(?:<[^>]*>\s*)?(?:\w+\.)?(?P<name2>\w+)", test=r"^\s*(?:\w+\s+)*fun\s+`?(?P<name>[^`(]+)", marker=r"^\s*@(?:\w*Test)\b", doc_only="/**")),
        ("cs", Language("csharp", line="///", block=("/*", "*/"), symbol=rf"{_CLASS}|^\s*public\s+(?:[\w<>,\[\]?]+\s+)+(?P<name2>\w+)\s*\(", test=r"^\s*(?:[\w<>]+\s+)+(?P<name>\w+)\s*\(", marker=r"^\s*\[(?:Test|Fact|Theory|TestMethod|TestCase)")),
        ("swift", Language("swift", line="///", block=("/**", "*/"), symbol=rf"{_CLASS}|^\s*(?:\w+\s+)*func\s+(?P<name2>\w+)", test=r"^\s*(?:\w+\s+)*func\s+(?P<name>test\w*)\s*\(")),
        ("php", Language("php", line="//", block=("/*", "*/"), symbol=rf"{_CLASS}|^\s*(?:\w+\s+)*function\s+(?P<name2>\w+)", test=r"^\s*(?:\w+\s+)*function\s+(?P<name>test\w*)\s*\(", doc_only="/**")),
        ("dart", Language("dart", line="///", block=("/*", "*/"), symbol=rf"{_CLASS}|{_FUNC.replace('<name>', '<name2>')}", test=r"^\s*(?:test|testWidgets|group)\(\s*[\"'](?P<name>[^\"']+)")),
        ("lua", Language("lua", line="--", block=("--[[", "]]"), symbol=r"^\s*(?:local\s+)?function\s+(?P<name>[\w.:]+)", test=r"^\s*(?:describe|it)\(\s*[\"'](?P<name>[^\"']+)")),
        ("luau", Language("luau", line="--", block=("--[[", "]]"), symbol=r"^\s*(?:local\s+)?function\s+(?P<name>[\w.:]+)", test=r"^\s*(?:describe|it)\(\s*[\"'](?P<name>[^\"']+)")),
        ("pas pp", Language("pascal", line="//", block=("{", "}"), symbol=r"(?i)^\s*(?:procedure|function|constructor|destructor)\s+(?P<name>[\w.]+)")),
        ("sql", Language("sql", line="--", block=("/*", "*/"), symbol=r"(?i)^\s*create\s+(?:or\s+replace\s+)?(?:procedure|function|view|table)\s+(?:if\s+not\s+exists\s+)?(?P<name>[\w.\"\[\]]+)")),
        ("liquid", Language("liquid", block=("{% comment %}", "{% endcomment %}"))),
    ]
    for e in extensions.split()
}


def _name(m: re.Match) -> str:
    return next((v for k, v in m.groupdict().items() if k.startswith("name") and v), "")


def _comments(lines: list[str], lang: Language) -> list[tuple[int, int, str, bool]]:
    """(first line, last line, text, documents) of comments that stand on lines of their own."""
    out, i = [], 0
    begin, end = lang.block
    while i < len(lines):
        s = lines[i].strip()
        if begin and s.startswith(begin):
            j = i
            while j < len(lines) and end not in (lines[j].strip()[len(begin) :] if j == i else lines[j]):
                j += 1
            last = min(j, len(lines) - 1)
            raw = "\n".join(lines[i : last + 1]).strip()
            raw = raw[len(begin) :].split(end)[0]
            text = "\n".join(re.sub(r"^\s*\*+ ?", "", x.lstrip("*") if k == 0 else x).strip() for k, x in enumerate(raw.split("\n"))).strip()
            out.append((i + 1, last + 1, text, not lang.doc_only or s.startswith(lang.doc_only)))
            i = last + 1
        elif lang.line and s.startswith(lang.line) and not s.startswith("#!"):
            j = i
            while j + 1 < len(lines) and lines[j + 1].strip().startswith(lang.line):
                j += 1
            text = "\n".join(re.sub(rf"^{re.escape(lang.line)}[/!]*\s?", "", x.strip()) for x in lines[i : j + 1]).strip()
            out.append((i + 1, j + 1, text, not lang.doc_only))
            i = j + 1
        else:
            i += 1
    return [c for c in out if c[2]]


def _docstring(lines: list[str], at: int) -> tuple[int, int, str] | None:
    while at < len(lines) and not lines[at].strip():
        at += 1
    if at >= len(lines) or not (m := re.match(r"\s*[rRuU]?(\"\"\"|''')", lines[at])):
        return None
    mark, j = m[1], at
    rest = lines[at][m.end() :]
    if mark in rest:
        return at + 1, at + 1, rest.split(mark)[0].strip()
    parts = [rest]
    while j + 1 < len(lines):
        j += 1
        if mark in lines[j]:
            parts.append(lines[j].split(mark)[0])
            break
        parts.append(lines[j])
    return at + 1, j + 1, "\n".join(p.strip() for p in parts).strip()


def entries(path: str, text: str, lang: Language) -> list[tuple[str, str, int, int, str]]:
    """(kind, symbol, first line, last line, text) of each documented place, in order."""
    lines = text.split("\n")
    if lang.script:
        keep = set()
        for m in re.finditer(rf"<{lang.script}[^>]*>([\s\S]*?)</{lang.script}>", text):
            keep.update(range(text.count("\n", 0, m.start(1)) + 1, text.count("\n", 0, m.end(1)) + 2))
        lines = [line if i in keep else "" for i, line in enumerate(lines, 1)]
    is_test_file = bool(re.search(lang.test_file, path))
    comments = {} if lang.docstring else {c[1]: c for c in _comments(lines, lang)}
    out, header_to = [], 0
    first_code = next((i for i, x in enumerate(lines, 1) if x.strip() and not x.startswith("#!") and not (lang.docstring and x.strip().startswith("#"))), 0)
    if lang.docstring:
        if first_code and (d := _docstring(lines, first_code - 1)) and d[0] == first_code:
            out.append(("file_header", "", d[0], d[1], d[2]))
    else:
        head = next((c for c in sorted(comments.values()) if c[0] <= max(first_code, 1) + 2 or lang.name == "go" and re.match(r"package\s", lines[min(c[1], len(lines) - 1)])), None)
        below = lines[head[1]].strip() if head and head[1] < len(lines) else ""
        if head and not (lang.symbol and re.match(lang.symbol, below)):
            out.append(("file_header", "", head[0], head[1], head[2]))
            header_to = head[1]
    marked = False
    for i, line in enumerate(lines, 1):
        if lang.marker and re.match(lang.marker, line):
            marked = True
            continue
        test = re.match(lang.test, line) if lang.test and (marked or not lang.marker) else None
        symbol = re.match(lang.symbol, line) if lang.symbol else None
        if not test and not symbol:
            marked = marked and (not line.strip() or line.strip().startswith(("@", "#[", "[")))
            continue
        marked, name = False, _name(test or symbol)
        doc = _docstring(lines, i) if lang.docstring else None
        if not lang.docstring:
            above = i - 1
            while above > 0 and (re.match(r"\s*(?:@|#\[|\[)", lines[above - 1]) and above not in comments):
                above -= 1
            c = comments.get(above)
            doc = (c[0], c[1], c[2]) if c and c[1] != header_to and (c[3] or test) else None
        if lang.example and (re.search(lang.example, name) or doc and re.search(lang.example, doc[2])):
            out.append(("example_func", name, i, max(i, doc[1] if doc else i), doc[2] if doc else name))
        elif test:
            out.append(("test_func", name, i, max(i, doc[1] if doc else i), doc[2] if doc else name))
        elif doc and (not lang.exported or re.search(lang.exported, name)) and not (is_test_file and lang.test and not lang.docstring and not symbol):
            out.append(("doc_comment", name, doc[0] if doc[0] < i else i, max(i, doc[1]), doc[2]))
    return out


_TITLE = {"file_header": "File Header", "test_func": "Tests", "example_func": "Examples", "doc_comment": "DocComment"}


def parse(path: str, data: bytes) -> Parsed:
    """A ``code_file`` node with one heading per documented place; no links and no containment edges."""
    out = Parsed(path, sha(data), len(data))
    lang = LANGUAGES.get(path.rsplit(".", 1)[-1].lower())
    text = data.decode("utf-8", errors="replace").replace("\r\n", "\n")
    name = path.rsplit("/", 1)[-1]
    if lang is None:
        out.error = "no reader for this language"
        out.node(path, "code_file", name, path, 1, text.count("\n") + 1)
        return out
    out.node(path, "code_file", name, path, 1, text.count("\n") + 1, 0, json.dumps({"source_language": lang.name}))
    file_type = "test" if re.search(lang.test_file, path) else "source"
    found = entries(path, text, lang)
    if len(found) > MAX_ENTRIES:
        out.error = f"only the first {MAX_ENTRIES} documented places are kept"
    for kind, symbol, first, last, body in found[:MAX_ENTRIES]:
        node = f"{path}#{kind}-{first}"
        meta = json.dumps({"comment_kind": kind, "file_type": file_type, "source_language": lang.name, "symbol": symbol})
        out.node(node, "heading", symbol or _TITLE[kind], node, first, last, 2, meta, body)
        out.chunk(node, first, last, _TITLE[kind] + (f" > {symbol}" if symbol else ""), cut(body, MAX_TEXT))
    return out
