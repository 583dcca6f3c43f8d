"""Rewriting one marked-up text to clean Markdown structure: the text side of :mod:`paperloom.llm.markup`.

A text is read once from left to right.  Every mark that opens something puts a frame on a stack, every
mark that closes something takes its frame off and gives the frame's content a clean form, so nesting
of any depth and code inside a link or a comment are read as their authors meant them.  Code and
formulas are set aside as soon as they are met and put back at the end, so no later rule sees them.
What an entity stands for may be a mark again; the text is then read once more, until it holds no mark.

Defined results: a mark that is opened and never closed loses its mark at most, never the text after
it; a mark that only closes stays as it is; names of templates and of files are no text; an unknown
entity leaves its name.
"""

from __future__ import annotations

import html
import html.entities
import re

_TAG = r"</?[A-Za-z][A-Za-z0-9]*(?:\s[^<>]*)?/?>"
#: What a text is searched for, by kind; the first kind that matches at a place counts.
_KINDS = {
    "fence": r"^(?:```|~~~)[^\n]*",
    "ticks": r"`+",
    "comment": r"<!--",
    "declared": r"<!DOCTYPE[^>]*>|<\?xml[^>]*>|<!DOCTYPE|<\?xml",
    "tag": _TAG,
    "entity": r"&(?:amp;)*(?:#\d{1,7}|#[xX][0-9A-Fa-f]{1,6}|[A-Za-z][A-Za-z0-9]{1,31});",
    "table": r"^[ \t]*\{\|[^\n]*",
    "title": r"^[ \t]*(?P<level>={1,6})(?!=)[ \t]*(?P<words>[^=\s](?:[^\n]*[^=\s])?)[ \t]*(?P=level)[ \t]*$",
    "outside": r"\[(?P<url>(?:https?|ftp)://[^\s\]]+)(?: (?P<label>[^\]\n]*))?\](?!\()",
    "link_on": r"\[\[",
    "link_off": r"\]\]",
    "template_on": r"\{\{",
    "template_off": r"\}\}",
    "display": r"\\\[|\$\$",
    "inline": r"\\\(|(?<![\\$\w])\$(?=[^\s$])(?:[^$\n]*[^\s$\\])?\$(?![\d$])",
    "begin": r"\\begin\{(?P<envname>[A-Za-z]+\*?)\}(?:\[[^\]\n]*\])?",
    "end": r"\\end\{[A-Za-z]+\*?\}",
    "item": r"\\item(?![A-Za-z])(?:\[[^\]\n]*\])?[ \t]*",
    "command": r"~?\\(?P<name>[A-Za-z]+)\*?(?:\[[^\]\n]*\])?\{",
    "symbol": r"(?:^|(?<=[\s({$~]))\\(?P<word>[A-Za-z]+)(?![\\A-Za-z])[ \t]?",
    "brace": r"[{}]",
}
_NEXT = re.compile("|".join(f"(?P<{kind}>{pattern})" for kind, pattern in _KINDS.items()), re.M)
#: Places where something may begin; lines that begin with equals signs or a table are looked for only if there are any.
_PLACE = re.compile(r"[<&\[\]{}\\$`~]")
_LINED = re.compile(r"^[ \t]*(?==|\{\|)", re.M)
_PLACE_OR_LINE = re.compile(r"^[ \t]*(?==|\{\|)|[<&\[\]{}\\$`~]", re.M)
_MARK = re.compile(r"[<&\[{\\$`=~']")
_LEFT = re.compile("|".join(re.sub(r"\?P<\w+>", "", _KINDS[k]) for k in ("comment", "declared", "tag", "entity", "table", "outside", "begin", "end", "item", "symbol"))
                   + r"|\{\{[^{}]+\}\}|\[\[[^\[\]\n]+\]\]|''|\\[A-Za-z]+\*?(?:\[[^\]\n]*\])?\{|\\[(\[]|\$|^[ \t]*=", re.M)
_CLOSERS = {"-->": re.compile("-->"), r"\]": re.compile(r"\\\]"), "$$": re.compile(r"\$\$"), r"\)": re.compile(r"\\\)"), "|}": re.compile(r"^[ \t]*\|\}[ \t]*", re.M)}
_OUTER = {"pre", "script", "style", "head"}
_BREAKS = {"br", "hr", "p", "div", "ul", "ol", "table", "tr", "section", "article", "blockquote", "body", "html", "tbody", "thead", "dl", "dt", "dd", "figure", "center"}
_FORMULAS = {"equation", "align", "gather", "multline", "displaymath", "math", "eqnarray"}
_VERBATIM = {"verbatim", "lstlisting", "minted"}
_TITLES = {"part": 1, "chapter": 1, "section": 1, "subsection": 2, "subsubsection": 3, "paragraph": 4}
#: Commands that set no text, and what some others print.
_SILENT = set("noindent newpage par hline centering maketitle bigskip medskip smallskip clearpage tableofcontents small large Large footnotesize itshape bfseries".split())
_PRINTED = {"ldots": "…", "dots": "…", "quad": " ", "qquad": " ", "textbackslash": "\\", "newline": "\n"}
_FILES = re.compile(r"^\s*:?(?:File|Image|Datei|Fichier|Archivo|Bild)\s*:", re.I)
_ROW_SPLIT = re.compile(r"\|\||!!")
_SETEXT = re.compile(r"^[ ]{0,3}(={2,}|-{3,})[ \t]*$")
_TABLE_RULE = re.compile(r"^[ \t]*+(?:\|[ \t]*+)?:?-{3,}+:?[ \t]*+(?:\|[ \t]*+:?-{3,}+:?[ \t]*+)++\|?[ \t]*$")
#: Markdown that is only dress in an excerpt.
_DRESS = [
    (re.compile(r"!?\[([^\[\]\n]*)\]\([^()\n]*\)"), r"\1"), (re.compile(r"\[\^[^\]\s]+\]:?"), ""), (re.compile(r"\*\*(?=[^\s*])([^*\n]*(?<=[^\s*]))\*\*"), r"\1"),
    (re.compile(r"(?<![\w*])\*(?=[^\s*])([^*\n]*(?<=[^\s*]))\*(?![\w*])"), r"\1"), (re.compile(r"~~(?=\S)([^~\n]+)~~"), r"\1"), (re.compile(r"^[ ]{0,3}>[ \t]?", re.M), ""),
]
_UNDER = {n: (re.compile(rf"(?<![\w_])_{{{n}}}(?=[^\s_])"), re.compile(rf"(?<=[^\s_])_{{{n}}}(?![\w_])")) for n in (2, 1)}
_RUN = re.compile(r"'{2,}")
_UNUSED = [chr(c) for c in range(0xFDD0, 0xFDF0)]  # code points that are never characters


class _Frame:
    __slots__ = ("kind", "mark", "data", "out")

    def __init__(self, kind: str, mark: str = "", data: str = ""):
        self.kind, self.mark, self.data, self.out = kind, mark, data, []


class _Reader:
    def __init__(self, text: str):
        self.seal = next((c for c in _UNUSED if c not in text), "\x00")
        self.kept: list[str] = []
        self.last = "\n"  # the last character put

    def keep(self, text: str) -> str:
        """A stand-in for a piece of code or a formula."""
        self.kept.append(text)
        return f"{self.seal}{len(self.kept) - 1}{self.seal}"

    def restored(self, text: str) -> str:
        return text if not self.kept else re.sub(f"{self.seal}(\\d+){self.seal}", lambda m: self.restored(self.kept[int(m[1])]), text)

    def fenced(self, text: str) -> str:
        mark = "~~~" if "```" in text else "```"
        return "\n" + self.keep(f"{mark}\n{text.strip(chr(10))}\n{mark}") + "\n"

    def formula(self, text: str, display: bool, after: str) -> str | None:
        """A stand-in for a formula, set off from what stands next to it; null if it is none that dollars could enclose."""
        body = " ".join(html.unescape(text).split())
        if not body or "$" in body:
            return None
        before = " " if self.last in (self.seal, "$", "\\") or self.last == "_" or self.last.isalnum() else ""
        whole = self.keep(f"$$ {body} $$" if display or body.endswith("\\") else f"${body}$")
        return before + whole + (" " if after[:1] == "$" or after[:1].isdigit() else "")

    def read(self, text: str) -> str:
        """One pass over ``text``."""
        stack, open_frames, lists, ended = [_Frame("text")], {}, [], {}
        at, n = 0, len(text)

        def find(closer: str, pattern: re.Pattern, start: int):
            """The next closing mark; that there is none is found out once."""
            if start >= ended.get(closer, n + 1):
                return None
            found = pattern.search(text, start)
            if found is None:
                ended[closer] = min(start, ended.get(closer, n + 1))
            return found

        def push(frame: _Frame) -> None:
            stack.append(frame)
            open_frames[frame.kind] = open_frames.get(frame.kind, 0) + 1

        def pop() -> _Frame:
            frame = stack.pop()
            open_frames[frame.kind] -= 1
            return frame

        def unclosed() -> None:
            frame = pop()
            put(self.loose(frame))

        def close(kind: str):
            """The frame of ``kind`` that ends here, with what is still open inside it let loose."""
            if not open_frames.get(kind):
                return None
            while stack[-1].kind != kind:
                unclosed()
            return pop()

        def put(piece: str) -> None:
            if piece:
                stack[-1].out.append(piece)
                self.last = piece[-1]

        places = _PLACE_OR_LINE if _LINED.search(text) else _PLACE
        begun = 0  # text from here on is not yet put
        while True:
            place = places.search(text, at)
            if place is None:
                put(text[begun:])
                break
            m = _NEXT.match(text, place.start())
            if m is None:
                at = max(place.end(), place.start() + 1)
                continue
            kind, mark = m.lastgroup, m[0]
            put(text[begun : m.start()])
            at = m.end()
            if kind == "fence":
                end = find("fence" + mark[:3], re.compile(rf"^{mark[:3]}[^\n]*", re.M), min(at + 1, n))
                at = end.end() if end else n
                put(self.keep(text[m.start() : at]))
            elif kind == "ticks":
                line_end = text.find("\n", at)
                end = re.compile(rf"(?<!`)`{{{len(mark)}}}(?!`)").search(text, at, line_end if line_end >= 0 else n)
                at = end.end() if end else at
                put(self.keep(text[m.start() : at]) if end else mark)
            elif kind == "comment":
                end = find("-->", _CLOSERS["-->"], at)
                at = end.end() if end else at
            elif kind == "tag":
                at = self.tag(text, m, at, push, close, find, put, lists)
            elif kind == "entity":
                put(self.entity(mark))
            elif kind == "table":
                end = find("|}", _CLOSERS["|}"], at)
                stop = end.start() if end else re.compile(r"(?:\n[ \t]*[|!][^\n]*)*").match(text, at).end()
                put("\n" + self.read("\n".join(wiki_rows(text[at:stop].split("\n")))) + "\n")
                at = end.end() if end else stop
            elif kind == "title":
                put(f"{'#' * len(m['level'])} {m['words']}")
            elif kind == "outside":
                put(m["label"] or m["url"])
            elif kind == "link_on":
                push(_Frame("link", mark))
            elif kind == "link_off":
                frame = close("link")
                put(self.link("".join(frame.out)) if frame else mark)
            elif kind == "template_on" and stack[-1].kind in ("command", "brace") and not stack[-1].out:
                at -= 1
                push(_Frame("brace", "{"))
            elif kind == "template_on":
                push(_Frame("template", mark))
            elif kind == "template_off" and open_frames.get("template"):
                put(self.template("".join(close("template").out)))
            elif kind in ("brace", "template_off"):
                at = m.start() + 1
                if text[m.start()] == "{":
                    if open_frames.get("command"):
                        push(_Frame("brace", "{"))
                    else:
                        put("{")
                elif open_frames.get("command") or open_frames.get("brace"):
                    while stack[-1].kind not in ("command", "brace"):
                        unclosed()
                    frame = pop()
                    inner = "".join(frame.out)
                    put(inner if frame.kind == "brace" else self.command(frame.data, inner, frame.mark))
                else:
                    put("}")
            elif kind == "display":
                closer = "$$" if mark == "$$" else r"\]"
                end = find(closer, _CLOSERS[closer], at)
                got = self.formula(text[at : end.start()], True, text[end.end() : end.end() + 1]) if end else None
                put(got if got is not None else mark if mark == "$$" else "")
                at = end.end() if got is not None else at
            elif kind == "inline" and mark[0] == "$":
                put(self.formula(mark[1:-1], False, text[at : at + 1]) or mark)
            elif kind == "inline":
                end = find(r"\)", _CLOSERS[r"\)"], at)
                got = self.formula(text[at : end.start()], False, text[end.end() : end.end() + 1]) if end else None
                put(got or "")
                at = end.end() if got is not None else at
            elif kind == "begin":
                at = self.environment(text, m["envname"], at, put, find)
            elif kind == "item":
                put(("" if self.last == "\n" else "\n") + "- ")
            elif kind == "command":
                push(_Frame("command", mark, m["name"]))
            elif kind == "symbol":
                name = m["word"]
                put("" if name in _SILENT else _PRINTED.get(name, name + (" " if mark[-1] in " \t" else "")))
            begun = at
        while len(stack) > 1:
            unclosed()
        return "".join(stack[0].out)

    def loose(self, frame: _Frame) -> str:
        """What is left of a frame that nothing closes."""
        inner = "".join(frame.out)
        return inner if frame.kind in ("command", "heading") else frame.mark + inner

    def command(self, name: str, inner: str, mark: str) -> str:
        if name in _TITLES:
            return f"\n{'#' * _TITLES[name]} {' '.join(inner.split())}\n"
        if "cite" in name or name in ("label", "vspace", "hspace", "bibliography", "usepackage", "documentclass", "index"):
            return ""
        tied = " " if mark.startswith("~") else ""
        if name.endswith("ref"):
            return tied + inner
        return f" ({inner})" if name == "footnote" else tied + inner

    def link(self, inner: str) -> str:
        if "\n" in inner or not inner:
            return f"[[{inner}]]"
        parts = inner.split("|")
        if _FILES.match(parts[0]):
            return parts[-1].strip() if len(parts) > 1 else ""
        return "|".join(parts[1:]) if len(parts) > 1 else inner

    def template(self, inner: str) -> str:
        parts = inner.split("|")[1:]
        return ", ".join(v for v in (p.split("=", 1)[-1].strip() for p in parts) if v)

    def entity(self, mark: str) -> str:
        name = re.sub(r"^&(?:amp;)*(?=.)", "", mark)[:-1] or "amp"
        return html.unescape(f"&{name};") if name[0] == "#" else html.entities.html5.get(name + ";", name)

    def tag(self, text: str, m: re.Match, at: int, push, close, find, put, lists: list) -> int:
        mark, fresh = m[0], "" if self.last == "\n" else "\n"
        name, ends = re.match(r"</?([A-Za-z][A-Za-z0-9]*)", mark)[1].lower(), mark.startswith("</")
        if name in _OUTER and not ends:
            end = find(name, re.compile(rf"</{name}\s*>", re.I), at)
            if end and name == "pre":
                put(self.fenced(html.unescape(re.sub(_TAG, "", text[at : end.start()]))))
            return end.end() if end else at
        if name == "code" and not ends:
            end = re.compile(r"([^<\n`]*)</code>", re.I).match(text, at)
            if end and end[1].strip():
                put(self.keep(f"`{html.unescape(end[1])}`"))
            return end.end() if end else at
        if re.fullmatch("h[1-6]", name):
            if not ends:
                put(fresh)
                push(_Frame("heading", mark, name[1]))
            elif frame := close("heading"):
                put(f"{'#' * int(frame.data)} {' '.join(''.join(frame.out).split())}\n")
        elif name == "li" and not ends:
            if lists and lists[-1] is not None:
                lists[-1] += 1
            put(fresh + "  " * max(len(lists) - 1, 0) + (f"{lists[-1]}. " if lists and lists[-1] is not None else "- "))
            return re.compile(r"\s*").match(text, at).end()
        elif name in ("td", "th") and not ends:
            put(" | " if fresh else "| ")
        elif name == "tr" and ends:
            put(" |\n")
        elif name == "img":
            named = re.search(r"""\balt\s*=\s*(?:"([^"]*)"|'([^']*)')""", mark, re.I)
            put((named[1] or named[2] or "") if named else "")
        elif name in _BREAKS:
            if name in ("ul", "ol") and not ends:
                lists.append(0 if name == "ol" else None)
            elif name in ("ul", "ol") and lists:
                lists.pop()
            put(fresh + ("\n" if name in ("p", "blockquote", "section", "article") else ""))
        return at

    def environment(self, text: str, env: str, at: int, put, find) -> int:
        bare = env.rstrip("*")
        if bare not in _FORMULAS | _VERBATIM and not bare.startswith("tabular"):
            put("\n" if bare in ("itemize", "enumerate", "description") else "")
            return at
        end = find("end " + env, re.compile(r"\\end\{" + re.escape(env) + r"\}"), at)
        if end is None:
            return at
        body = text[at : end.start()]
        if bare in _FORMULAS:
            got = self.formula(body, True, text[end.end() : end.end() + 1])
            put(got or "")
            return end.end() if got is not None else at
        if bare in _VERBATIM:
            put(self.fenced(body))
        else:
            body = re.sub(r"^\{[^{}\n]*\}", "", body).replace("\\hline", "")
            rows = [r for r in (row.strip() for row in body.split("\\\\")) if r]
            put("\n" + self.read("\n".join("| " + " | ".join(c.strip() for c in re.split(r"(?<!\\)&(?!\w+;|#)", r)) + " |" for r in rows)) + "\n")
        return end.end()


def wiki_rows(lines: list[str]) -> list[str]:
    """Lines of a wiki table as rows of cells; cells on lines of their own are put into one row."""
    rows: list[list[str]] = [[]]
    for line in lines:
        bare = line.strip()
        if bare.startswith(("|-", "|}", "{|")):
            rows.append([])
        elif bare.startswith("|+"):
            rows += [[bare[2:].strip()], []]
        elif bare.startswith(("|", "!")):
            for cell in _ROW_SPLIT.split(bare[1:]):
                head, bar, rest = cell.partition("|")
                rows[-1].append((rest if bar and "=" in head and "[[" not in head else cell).strip())
        elif bare:
            if rows[-1]:
                rows[-1][-1] += " " + bare
            else:
                rows[-1].append(bare)
    return ["| " + " | ".join(r) + " |" if len(r) > 1 else r[0] for r in rows if r]


def without_quotes(line: str) -> str:
    """A line without the runs of quote marks that stand for emphasis; quotes that pair with nothing stay."""
    runs = [(m.start(), m.end()) for m in _RUN.finditer(line)]
    dropped, k = [], 0
    while k + 1 < len(runs):
        (a, b), (c, _) = runs[k], runs[k + 1]
        if b < c and not line[b].isspace():
            size, last = b - a, k + 1
            if size >= 5:  # bold and italic together may end one after the other
                while runs[last][1] - runs[last][0] < size and last + 1 < len(runs) and sum(y - x for x, y in runs[k + 1 : last + 1]) < size:
                    last += 1
            dropped += runs[k : last + 1]
            k = last + 1
        else:
            k += 1
    for a, b in reversed(dropped):
        line = line[:a] + line[b:]
    return line


def _undressed(text: str) -> str:
    """An excerpt without emphasis, links, images, footnote marks, quote marks and table rules; underlined titles get a hash."""
    for pattern, replacement in _DRESS:
        text = pattern.sub(replacement, text)
    lines: list[str] = []
    titled = not text.startswith("---")  # front matter is no title
    for line in text.split("\n"):
        under = _SETEXT.match(line) if titled else None
        if under and lines and lines[-1].strip() and not lines[-1].lstrip().startswith(("#", "- ", "|")):
            lines[-1] = ("# " if under[1][0] == "=" else "## ") + lines[-1].strip()
        elif not _TABLE_RULE.match(line):
            lines.append(_without_underscores(line) if "_" in line else line)
    return "\n".join(lines)


def _without_underscores(line: str) -> str:
    for n, (opens, closes) in _UNDER.items():
        at, done = 0, []
        while (a := opens.search(line, at)) and (b := closes.search(line, a.end() + 1)):
            done += [(a.start(), a.end()), (b.start(), b.end())]
            at = b.end()
        for x, y in reversed(done):
            line = line[:x] + line[y:]
    return line


def tidy(text: str) -> str:
    if " \n" in text or "\t\n" in text:
        text = re.sub(r"(?<![ \t])[ \t]+$", "", text, flags=re.M)
    return re.sub(r"\n{3,}", "\n\n", text) if "\n\n\n" in text else text


def rewrite(text: str, excerpt: bool) -> str:
    """The clean form of a text."""
    if not _MARK.search(text) and not (excerpt and re.search(r"[*_>\]|-]", text)):
        return tidy(text)
    reader = _Reader(text)
    while True:
        new = reader.read(text)
        if "''" in new:
            new = "\n".join(without_quotes(line) if "''" in line else line for line in new.split("\n"))
        if new == text or not _LEFT.search(new):
            break
        text = new
    if excerpt:
        new = _undressed(new)
    return reader.restored(tidy(new))
