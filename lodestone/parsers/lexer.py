"""Source text with comments and strings blanked out, its bracket pairs, statements and positions.

Every extractor reads `code`, which is as long as the text, so offsets are the same in both.  Literals keep
their delimiters; what stands between them is blank.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator

_C = r"//[^\n]*|/\*.*?(?:\*/|\Z)"
_DOUBLE = r'"(?:\\.|[^"\\\n])*"?'
_SINGLE = r"'(?:\\.|[^'\\\n])*'?"
_TRIPLE = r'"""(?:\\.|[^\\])*?(?:"""|\Z)'

#: What is blank, by language.  Scripts and Ruby need more than an expression; see below.
_BLANK = {
    lang: re.compile(pattern, re.S | re.M)
    for lang, pattern in {
        "c": rf"{_C}|{_DOUBLE}|{_SINGLE}",
        "cpp": rf'{_C}|\bR"(?P<d>[^\s()\\]*)\(.*?\)(?P=d)"|{_DOUBLE}|(?<![0-9a-fA-F]){_SINGLE}',
        "csharp": rf'{_C}|\$?@\$?"(?:""|[^"])*"|{_TRIPLE}|{_DOUBLE}|{_SINGLE}',
        "go": rf"{_C}|`[^`]*`?|{_DOUBLE}|{_SINGLE}",
        "java": rf"{_C}|{_TRIPLE}|{_DOUBLE}|{_SINGLE}",
        "php": rf"{_C}|\#(?!\[)[^\n]*|<<<[ \t]*['\"]?(?P<h>\w+)['\"]?\n.*?^[ \t]*(?P=h)\b|\"(?:\\.|[^\"\\])*\"?|'(?:\\.|[^'\\])*'?|\?>.*?(?:<\?php|<\?=|\Z)",
        "python": rf"\#[^\n]*|[rbfuRBFU]{{0,2}}(?:{_TRIPLE}|'''(?:\\.|[^\\])*?(?:'''|\Z)|{_DOUBLE}|{_SINGLE})",
        "ruby": rf"\#[^\n]*|^=begin\b.*?(?:^=end\b|\Z)|^__END__$.*|<<[~-]?(?P<q>['\"]?)(?P<h>[A-Z_]\w*)(?P=q)[^\n]*\n.*?^\s*(?P=h)\b|%[wWiIqQ]?(?:\([^()]*\)|\[[^\[\]]*\]|\{{[^{{}}]*\}})|\"(?:\\.|[^\"\\])*\"?|'(?:\\.|[^'\\])*'?|(?<=[\s(,=~])/(?![\s=])(?:\\.|[^/\\\n])+/",
        "rust": rf"//[^\n]*|/\*.*?(?:\*/|\Z)|\bb?r(?P<n>\#*)\".*?\"(?P=n)|b?\"(?:\\.|[^\"\\])*\"?|b?'(?:\\[^'\n]*|[^'\\\n])'",
    }.items()
}
_SCRIPT_STOP = re.compile(r"""//[^\n]*|/\*.*?(?:\*/|\Z)|"(?:\\.|[^"\\\n])*"?|'(?:\\.|[^'\\\n])*'?|[`{}/]""", re.S)
_PATTERN_LITERAL = re.compile(r"/(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\n\[])+/[a-z]*")
#: After one of these a slash begins a pattern, not a division.
_BEFORE_PATTERN = re.compile(r"(?:^|[(,=:\[!&|?{};+\-*%<>~^]|\b(?:return|typeof|case|in|of|delete|void|throw|new|instanceof|else|do|await|yield))\s*\Z")
_OPEN, _CLOSE = "([{", {")": "(", "]": "[", "}": "{"}


def _blanked(s: str, keep: bool = True) -> str:
    """s with everything but line ends and, for literals, its first and last character made blank."""
    blank = re.sub(r"[^\n]", " ", s)
    return s[0] + blank[1:-1] + s[-1] if keep and len(s) > 1 else blank


def _is_comment(s: str, lang: str) -> bool:
    if s.startswith(("//", "/*")) and lang not in ("python", "ruby"):
        return True
    return s.startswith(("#", "=begin", "__END__", "?>"))


def _blank_script(text: str) -> str:
    """Scripts nest code in templates, and a slash may begin a pattern."""
    out: list[str] = []
    nested: list[int] = []  # open braces within each template expression that is open
    at = 0

    def template(start: int) -> int:
        """From within a template's text to its end or to the next expression."""
        i = start
        while i < len(text):
            if text[i] == "\\":
                i += 2
            elif text[i] == "`":
                out.append(re.sub(r"[^\n]", " ", text[start:i]) + "`")
                return i + 1
            elif text.startswith("${", i):
                out.append(re.sub(r"[^\n]", " ", text[start:i]) + "  ")
                nested.append(0)
                return i + 2
            else:
                i += 1
        out.append(re.sub(r"[^\n]", " ", text[start:]))
        return len(text)

    while at < len(text):
        m = _SCRIPT_STOP.search(text, at)
        if not m:
            out.append(text[at:])
            break
        out.append(text[at : m.start()])
        token, at = m.group(), m.end()
        if token == "`":
            out.append("`")
            at = template(at)
        elif token == "{":
            out.append("{")
            if nested:
                nested[-1] += 1
        elif token == "}":
            if nested and nested[-1] == 0:
                nested.pop()
                out.append(" ")
                at = template(at)
            else:
                out.append("}")
                if nested:
                    nested[-1] -= 1
        elif token == "/":
            literal = _PATTERN_LITERAL.match(text, m.start())
            before = "".join(out[-8:])[-200:]
            if literal and _BEFORE_PATTERN.search(before):
                out.append(_blanked(literal.group()))
                at = literal.end()
            else:
                out.append("/")
        else:
            out.append(_blanked(token, not token.startswith("/")))
    return "".join(out)[: len(text)]


def _drop_directives(code: str) -> str:
    """C directives, with their continued lines, made blank."""
    return re.sub(r"^[ \t]*\#(?:\\\n|[^\n])*", lambda m: _blanked(m.group(), False), code, flags=re.M)


class Code:
    """A source file as the extractors read it."""

    def __init__(self, text: str, lang: str):
        self.text = text
        if lang in ("typescript", "javascript"):
            self.code = _blank_script(text)
        else:
            begun = text
            if lang == "php":
                first = re.search(r"<\?(?:php|=)?", text)
                cut = first.end() if first else len(text)
                begun = re.sub(r"[^\n]", " ", text[:cut]) + text[cut:]
            self.code = _BLANK[lang].sub(lambda m: _blanked(m.group(), not _is_comment(m.group(), lang)), begun)
        self.lines = self.code
        if lang in ("c", "cpp"):
            self.code = _drop_directives(self.code)
        self._starts = [0, *(m.end() for m in re.finditer("\n", text))]
        self.pairs = self._matched()

    def _matched(self) -> dict[int, int]:
        """Offset of each opening bracket -> that of its closing one, or the end of the text."""
        pairs, open_ = {}, []
        for m in re.finditer(r"[()\[\]{}]", self.code):
            c, i = m.group(), m.start()
            if c in _OPEN:
                open_.append(i)
            elif any(self.code[o] == _CLOSE[c] for o in open_[-3:]):
                while self.code[open_[-1]] != _CLOSE[c]:
                    pairs[open_.pop()] = i
                pairs[open_.pop()] = i
        pairs.update((o, len(self.code)) for o in open_)
        return pairs

    def position(self, offset: int) -> tuple[int, int]:
        line = bisect_right(self._starts, offset)
        return line, offset - self._starts[line - 1] + 1

    def symbol(self, kind: str, name: str, start: int, end: int, extends: str | None = None, implements: list[str] | None = None) -> dict:
        first = self.text[start:end].split("\n", 1)[0]
        (l0, c0), (l1, c1) = self.position(start), self.position(end)
        return {
            "kind": kind, "name": name, "signature": first[:200] + "..." if len(first) > 200 else first,
            "start_line": l0, "start_col": c0, "end_line": l1, "end_col": c1,
            "extends": extends, "implements": implements or [],
        }

    def literal(self, quote: int) -> str | None:
        """What stands in the string that begins at a quote; None where it does not end."""
        end = self.code.find(self.code[quote], quote + 1)
        return self.text[quote + 1 : end] if end > 0 else None

    def after_blank(self, at: int) -> int:
        while at < len(self.code) and self.code[at].isspace():
            at += 1
        return at

    def depth_zero(self, lo: int, hi: int) -> Iterator[int]:
        """Offsets from lo to hi that stand in no bracket opened there; opening brackets are given, too."""
        i = lo
        while i < hi:
            yield i
            i = self.pairs.get(i, i) + 1

    def statements(self, lo: int, hi: int, tail: str = "") -> Iterator[tuple[int, int, int | None, int]]:
        """start, end of the head, brace of the body or None, end, of each statement from lo to hi.

        A statement ends at a semicolon or with its body; a brace after an equals sign is a value, not a body.  One
        whose head matches `tail` goes on from its body to the semicolon."""
        start, assigned, i = self.after_blank(lo), False, lo
        while i < hi:
            c = self.code[i]
            if c == ";":
                if start < i:
                    yield start, i, None, i + 1
                start, assigned = self.after_blank(i + 1), False
            elif c == "{":
                close = min(self.pairs.get(i, hi), hi)
                if not assigned:
                    end = close + 1
                    following = self.after_blank(end)
                    if (tail and re.search(tail, self.code[start:i])) or self.code[following : following + 1] == "=":
                        stop = next((j for j in self.depth_zero(end, hi) if self.code[j] == ";"), end - 1)
                        end = stop + 1
                    yield start, i, i, min(end, len(self.code))
                    start = self.after_blank(end)
                    i = end - 1
                else:
                    i = close
            elif c in "([":
                i = min(self.pairs.get(i, hi), hi)
            elif c == "=" and self.code[i - 1] not in "=!<>+-*/" and self.code[i + 1 : i + 2] not in ("=", ">") and not self.code.endswith("operator", 0, i):
                assigned = True
            i += 1
        if start < hi and self.code[start:hi].strip():
            yield start, hi, None, start + len(self.code[start:hi].rstrip())


def split_top(s: str, separator: str = ",") -> list[str]:
    """Parts of s between separators that stand in no bracket; angle brackets count."""
    parts, depth, last = [], 0, 0
    for i, c in enumerate(s):
        if c in "([{<":
            depth += 1
        elif c in ")]}" or (c == ">" and s[i - 1 : i] not in ("-", "=")):
            depth -= 1
        elif c == separator and depth <= 0:
            parts.append(s[last:i])
            last = i + 1
    return [p.strip() for p in [*parts, s[last:]] if p.strip()]


def without_generics(s: str) -> str:
    """s less everything in angle brackets."""
    while True:
        shorter = re.sub(r"<[^<>]*>", "", s)
        if shorter == s:
            return s.strip()
        s = shorter


def imported(source: str, names: list[str] | None = None, default: bool = False, namespace: bool = False, type_only: bool = False, dynamic: bool = False) -> dict:
    return {"source": source, "names": names or [], "is_default": default, "is_namespace": namespace, "is_type_only": type_only, "is_dynamic": dynamic}


def exported(name: str, default: bool = False, source: str | None = None) -> dict:
    return {"name": name, "is_default": default, "is_re_export": source is not None, "source": source}


def distinct(items: list[dict], key: str = "name") -> list[dict]:
    return list({item[key]: item for item in reversed(items)}.values())[::-1]
