"""Ruby: blocks that keywords open and `end` closes."""

from __future__ import annotations

import re

from .lexer import Code, exported, imported

#: Keywords that open a block wherever they stand, and those that do so only at the start of a statement.
_TOKEN = re.compile(r"(?<![\w.:@$])(class|module|def|do|begin|case|if|unless|while|until|for|end)(?![\w?!:=])|(?<![\w.:@$])(?:end)(?==)")
_ONLY_FIRST = frozenset(("if", "unless", "while", "until", "for"))
_HEAD = re.compile(r"(class|module)\s+(?:<<\s*(\w+)|([\w:]+))\s*(<\s*[\w:]+(?:\.\w+)?)?")
_DEF = re.compile(r"def\s+(?:(self|\w+)\s*\.\s*)?([\w]+[?!=]?|[+\-*/%<>=!~\[\]&|^]+)")
_ENDLESS = re.compile(r"[ \t]*(?:\([^()\n]*(?:\([^()\n]*\)[^()\n]*)*\))?[ \t]*=(?![=~>])")


def _first_in_statement(code: str, at: int) -> bool:
    line = code[code.rfind("\n", 0, at) + 1 : at].rstrip()
    return not line or line.endswith((";", "=", "(", "do", "then", "else", "begin", "{", "|", "&&", "||", "return"))


def ruby(c: Code) -> dict:
    imports, symbols, exports = [], [], []
    for m in re.finditer(r"(?<![\w.])(require_relative|require|load)\b[ \t]*\(?[ \t]*(['\"])", c.code):
        source = c.literal(m.start(2))
        if source:
            source = f"./{source}" if m[1] == "require_relative" else source
            imports.append(imported(source, [source.rsplit("/", 1)[-1]], dynamic=m[1] == "load"))

    rows: list[tuple[int, dict]] = []
    blocks: list[dict] = []  # open blocks: kind, start, and what names them

    def enclosing() -> str | None:
        return next((b["name"] for b in reversed(blocks) if b["kind"] in ("class", "module") and b["name"]), None)

    def top() -> bool:
        return not blocks

    def close(block: dict, end: int) -> None:
        if block.get("make"):
            rows.append((block["start"], block["make"](end)))

    listed = list(re.finditer(r"^[ \t]*(attr_(?:accessor|reader|writer))\b([^\n]*(?:,[ \t]*\n[^\n]*)*)", c.code, re.M))[::-1]

    def attributes(before: int) -> None:
        """Properties that are listed before an offset, in the class that is open there."""
        while listed and listed[-1].start(1) < before:
            m, owner = listed.pop(), enclosing()
            for name in re.findall(r":(\w+[?!]?)", m[2]):
                rows.append((m.start(1), c.symbol("property", f"{owner}.{name}" if owner else name, m.start(1), m.start(2) + len(m[2].rstrip()))))

    loop_line = None  # a `do` after while, until or for on its line belongs to that keyword
    for m in _TOKEN.finditer(c.code):
        word, at = m.group(), m.start()
        attributes(at)
        if word == "end":
            if blocks:
                close(blocks.pop(), m.end())
            continue
        if word in _ONLY_FIRST and not _first_in_statement(c.code, at):
            continue
        if word == "do":
            if loop_line is not None and "\n" not in c.code[loop_line:at]:
                loop_line = None
                continue
            blocks.append({"kind": "do", "start": at, "name": None})
        elif word in ("class", "module"):
            head = _HEAD.match(c.code, at)
            if not head:
                continue
            if head[2]:
                blocks.append({"kind": "singleton", "start": at, "name": None})
                continue
            name, base = head[3], re.sub(r"\s+", " ", head[4]) if head[4] else None
            if top():
                exports.append(exported(name))
            blocks.append({"kind": word, "start": at, "name": name, "make": lambda end, k=word, n=name, s=at, b=base: c.symbol(k, n, s, end, b)})
        elif word == "def":
            head = _DEF.match(c.code, at)
            if not head:
                continue
            owner = enclosing()
            name = f"{owner}.{head[2]}" if owner else head[2]
            kind = "method" if owner or head[1] else "function"
            if top():
                exports.append(exported(head[2]))
            make = lambda end, k=kind, n=name, s=at: c.symbol(k, n, s, end)
            if _ENDLESS.match(c.code, head.end()):
                line_end = c.code.find("\n", at)
                rows.append((at, make(len(c.code) if line_end < 0 else line_end)))
            else:
                blocks.append({"kind": "def", "start": at, "name": None, "make": make})
        else:
            if word in ("while", "until", "for"):
                loop_line = at
            blocks.append({"kind": word, "start": at, "name": None})
    attributes(len(c.code))
    while blocks:
        close(blocks.pop(), len(c.code.rstrip()))

    for m in re.finditer(r"^[ \t]*([A-Z]\w*)[ \t]*(?:\|\|)?=(?![=~>])", c.code, re.M):
        line_end = c.code.find("\n", m.end())
        rows.append((m.start(1), c.symbol("constant", m[1], m.start(1), len(c.code) if line_end < 0 else line_end)))
    symbols = [r for _, r in sorted(rows, key=lambda x: x[0])]
    return {"imports": imports, "exports": exports, "symbols": symbols}
