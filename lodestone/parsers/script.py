"""TypeScript and JavaScript."""

from __future__ import annotations

import re

from .lexer import Code, distinct, exported, imported, split_top

_NAME = r"[\w$]+"
_CLAUSE = re.compile(rf"\s*(type\s+)?(?:({_NAME})\s*,?\s*)?(?:\*\s*as\s+({_NAME})|\{{([^{{}}]*)\}})?\s*from\s*", re.S)
_WORD = r"(?<![\w$.])"
_NOT_A_STATEMENT = re.compile(r"(?:[=(,:?&|!+\-*/\[<>~^%]|\b(?:return|typeof|new|await|yield|void|delete|in|of|case|throw|instanceof))\s*\Z")
_FUNCTION = re.compile(rf"{_WORD}(?:async\s+)?function\s+({_NAME})")
_CLASS = re.compile(rf"{_WORD}(abstract\s+)?class\s+({_NAME})([^{{]*)\{{")
_INTERFACE = re.compile(rf"{_WORD}interface\s+({_NAME})([^{{]*)\{{")
_ENUM = re.compile(rf"{_WORD}(?:const\s+)?enum\s+({_NAME})\s*\{{")
_TYPE = re.compile(rf"{_WORD}type\s+({_NAME})\s*(?=[<=])")
_VARIABLES = re.compile(rf"{_WORD}(?:const|let|var)\s+(?!enum\b)")
_METHOD = re.compile(rf"((?:(?:public|private|protected|static|abstract|override|readonly|async|get|set|declare)\s+)*)(\*\s*)?([#\w$]+|\[[^\]]*\]|['\"][^'\"\n]*['\"])\s*\??\s*(?=[(<])")
_CONTROL = frozenset("if for while switch catch function return with await new super typeof do else".split())


def _names(clause: str) -> list[str]:
    found = []
    for part in split_top(clause):
        words = re.findall(_NAME, part)
        if words and words[0] == "type" and len(words) > 1 and words[1] != "as":
            words = words[1:]
        if words:
            found.append(words[-1])
    return found


def _imports(c: Code) -> list[dict]:
    found = []
    for m in re.finditer(rf"{_WORD}import\b(?!\s*[(.])", c.code):
        quote = re.compile(r"['\"]").search(c.code, m.end())
        if not quote:
            continue
        source, clause = c.literal(quote.start()), c.code[m.end() : quote.start()]
        if source is None:
            continue
        if not clause.strip():
            found.append(imported(source))
            continue
        parts = _CLAUSE.fullmatch(clause)
        if parts and any(parts.groups()):
            type_only, default, namespace, named = parts.groups()
            names = [n for n in (default, namespace) if n] + (_names(named) if named else [])
            found.append(imported(source, names, bool(default), bool(namespace), bool(type_only)))
    for m in re.finditer(rf"{_WORD}import\s*\(\s*(['\"])", c.code):
        source = c.literal(m.end() - 1)
        if source is not None:
            found.append(imported(source, dynamic=True))
    return found


def _bound_names(c: Code, lo: int, hi: int) -> list[tuple[str, bool]]:
    """Names that a const, let or var binds, and whether each stands alone."""
    names = []
    for part in _declarators(c, lo, hi):
        part = part.strip()
        if part[:1] in ("{", "["):
            inner = part[1 : part.rfind("}" if part[0] == "{" else "]")]
            for item in split_top(inner):
                last = re.findall(rf"\.\.\.\s*({_NAME})|({_NAME})", item.split("=")[0])
                if last:
                    names.append(("".join(last[-1]), False))
        elif m := re.match(_NAME, part):
            names.append((m.group(), True))
    return names


def _declarators(c: Code, lo: int, hi: int) -> list[str]:
    """Targets of the declarators between lo and hi: what stands left of the equals sign or type."""
    out, start, seen = [], lo, None
    for i in [*c.depth_zero(lo, hi), hi]:
        ch = c.code[i] if i < hi else ","
        if ch in "=:" and seen is None:
            seen = i
        if ch == ",":
            target = c.code[start : seen if seen is not None else i]
            # A comma among type arguments is not a new declarator.
            if re.match(rf"\s*(?:{_NAME}!?\s*\Z|[{{\[])", target):
                out.append(target)
            start, seen = i + 1, None
    return out


def _end_of_statement(c: Code, at: int) -> int:
    """The end of a statement: its semicolon, or a line end after which another begins."""
    last = at
    for i in c.depth_zero(at, len(c.code)):
        ch = c.code[i]
        if ch == ";":
            return i + 1
        if ch in ")]}":
            break
        if ch == "\n" and last > at:
            following = c.after_blank(i)
            rest = c.code[following : following + 12]
            if c.code[last] not in "=,|&?:+-*/<(.[{" and not re.match(r"[=,|&?:+\-*/.(\[`]|(?:extends|instanceof|in|as|satisfies)\b", rest):
                break
        if not ch.isspace():
            last = c.pairs.get(i, i) if ch in "([{" else i
    return min(last + 1, len(c.code))


def _statement_here(c: Code, at: int) -> bool:
    return not _NOT_A_STATEMENT.search(c.code[max(0, at - 40) : at])


_STAR = re.compile(rf"\s*(?:type\s+)?\*\s*(?:as\s+({_NAME})\s*)?from\s*(['\"])")
_LISTED = re.compile(r"\s*(?:type\s+)?\{([^{}]*)\}\s*(?:from\s*(['\"]))?")
_DEFAULT = re.compile(rf"\s*default\b\s*(?:(?:async\s+)?function\b\s*\*?|(?:abstract\s+)?class\b|interface\b)?\s*(?:({_NAME})\s*(?=[({{<;\n]|extends\b|implements\b|\Z))?")
_DECLARED = re.compile(rf"\s*(?:declare\s+)?(?:(?:async\s+)?function\s*\*?|(?:abstract\s+)?class|interface|type|(?:const\s+)?enum|namespace|module)\s+({_NAME})")
_BOUND = re.compile(r"\s*(?:declare\s+)?(?:const|let|var)\s+")


def _exports(c: Code) -> list[dict]:
    found = []
    for m in re.finditer(rf"{_WORD}export\b", c.code):
        at = m.end()
        if star := _STAR.match(c.code, at):
            found.append(exported(star[1] or "*", source=c.literal(star.end() - 1) or ""))
        elif listed := _LISTED.match(c.code, at):
            source = c.literal(listed.end() - 1) if listed[2] else None
            found += [exported(n, n == "default", source) for n in _names(listed[1])]
        elif default := _DEFAULT.match(c.code, at):
            name = default[1]
            found.append(exported(name if name and name not in ("extends", "new", "async", "function", "class") else "default", True))
        elif declared := _DECLARED.match(c.code, at):
            found.append(exported(declared[1]))
        elif bound := _BOUND.match(c.code, at):
            found += [exported(n) for n, _ in _bound_names(c, bound.end(), _end_of_value(c, bound.end()))]
    return found


def _end_of_value(c: Code, lo: int) -> int:
    end = _end_of_statement(c, lo)
    return end - 1 if c.code[end - 1 : end] == ";" else end


def _type_names(clause: str) -> list[str]:
    return [re.sub(r"\s+", " ", p) for p in split_top(clause)]


def _methods(c: Code, owner: str, lo: int, hi: int) -> tuple[list[dict], list[dict]]:
    """Methods with a body and abstract ones, nested classes' included."""
    bodied, abstract = [], []
    for m in _METHOD.finditer(c.code, lo, hi):
        name = c.text[m.start(3) : m.end(3)]
        before = c.code[max(lo, m.start() - 60) : m.start()].rstrip()
        line_start = not before or before[-1] in "{};" or "\n" in c.code[max(lo, m.start() - 200) : m.start()].rsplit(before[-1:], 1)[-1] or re.search(r"@[\w.]+(?:\([^)]*\))?\Z", before)
        if name in _CONTROL or not line_start or (before and before[-1] in "=.,(?:&|+-"):
            continue
        at = c.after_blank(m.end())
        if c.code[at] == "<":
            close = c.code.find("(", at)
            at = close if close > 0 else at
        if c.code[at : at + 1] != "(":
            continue
        after = c.after_blank(c.pairs.get(at, hi) + 1)
        brace = None
        if c.code[after : after + 1] == ":":
            for i in c.depth_zero(after + 1, hi):
                if c.code[i] == "{" and not re.search(r"[:|&<,]\s*\Z", c.code[after:i]):
                    brace = i
                    break
                if c.code[i] in ";}" or (c.code[i] == "\n" and "abstract" in m[1]):
                    after = i
                    break
        elif c.code[after : after + 1] == "{":
            brace = after
        if brace is not None and brace < hi:
            bodied.append(c.symbol("method", f"{owner}.{name}", m.start(), min(c.pairs[brace] + 1, hi)))
        elif "abstract" in m[1]:
            end = c.code.find(";", m.end(), hi)
            stop = end if end > 0 else after
            abstract.append(c.symbol("method", f"{owner}.{name}", m.start(), stop))
    return bodied, abstract


def _heritage(clause: str) -> tuple[str | None, list[str]]:
    clause = re.sub(r"\s+", " ", clause)
    parts = re.split(r"\bimplements\b", clause, maxsplit=1)
    base = re.search(r"\bextends\s+(.+)", re.sub(r"^\s*<.*?>(?=\s*(?:extends|implements|$))", "", parts[0]))
    name = re.match(r"[\w$.]+", base[1]) if base else None
    return name.group() if name else None, _type_names(parts[1]) if len(parts) > 1 else []


def _symbols(c: Code) -> list[dict]:
    found = []
    end_of = lambda brace: min(c.pairs.get(brace, len(c.code) - 1) + 1, len(c.code))
    for m in _FUNCTION.finditer(c.code):
        at = c.code.find("(", m.end())
        if at < 0 or not _statement_here(c, m.start()):
            continue
        brace = next((i for i in c.depth_zero(c.pairs[at] + 1, len(c.code)) if c.code[i] in "{;" and not re.search(r"[:|&<,]\s*\Z", c.code[c.pairs[at] + 1 : i])), None)
        # An overload has no body and is no declaration of its own.
        if brace is not None and c.code[brace] == "{":
            found.append(c.symbol("function", m[1], m.start(), end_of(brace)))
    plain = [m for m in _CLASS.finditer(c.code) if _statement_here(c, m.start())]
    for m in sorted(plain, key=lambda m: bool(m[1])):
        base, traits = _heritage(m[3])
        brace = m.end() - 1
        bodied, abstract = _methods(c, m[2], brace + 1, end_of(brace) - 1)
        found.append(c.symbol("class", m[2], m.start(), end_of(brace), base, traits))
        found += bodied + (abstract if m[1] else [])
    for m in _INTERFACE.finditer(c.code):
        base = re.search(r"\bextends\s+(.+)", m[2], re.S)
        found.append(c.symbol("interface", m[1], m.start(), end_of(m.end() - 1), _type_names(base[1])[0] if base else None))
    for m in _TYPE.finditer(c.code):
        if _statement_here(c, m.start()):
            found.append(c.symbol("type", m[1], m.start(), _end_of_statement(c, m.start())))
    for m in _ENUM.finditer(c.code):
        found.append(c.symbol("enum", m[1], m.start(), end_of(m.end() - 1)))
    top = set(c.depth_zero(0, len(c.code)))
    for m in _VARIABLES.finditer(c.code):
        if m.start() in top and _statement_here(c, m.start()):
            end = _end_of_statement(c, m.start())
            found += [c.symbol("variable", n, m.start(), end) for n, alone in _bound_names(c, m.end(), _end_of_value(c, m.end())) if alone]
    return found


def typescript(c: Code) -> dict:
    return {"imports": _imports(c), "exports": _exports(c), "symbols": _symbols(c)}


def _required(c: Code) -> list[dict]:
    found = []
    for m in re.finditer(rf"{_WORD}(?:const|let|var)\s+({_NAME}|\{{[^{{}}]*\}})\s*=\s*require\s*\(\s*(['\"])", c.code):
        source = c.literal(m.end() - 1)
        if source is None:
            continue
        if m[1][0] == "{":
            names = [re.findall(_NAME, p.split("=")[0])[-1] for p in split_top(m[1][1:-1]) if re.search(_NAME, p)]
            found.append(imported(source, names))
        else:
            found.append(imported(source, [m[1]], default=True))
    return found


def _common_exports(c: Code) -> list[dict]:
    found = []
    for m in re.finditer(rf"{_WORD}module\.exports\s*=(?!=)\s*(\{{|{_NAME}(?=\s*(?:;|\n|\Z)))?", c.code):
        if m[1] == "{":
            brace = m.end() - 1
            keys = (re.match(rf"(?:async\s+)?\*?\s*({_NAME})", p) for p in split_top(c.code[brace + 1 : c.pairs[brace]]))
            found += [exported(k[1]) for k in keys if k]
        else:
            found.append(exported(m[1] or "default", True))
    for m in re.finditer(rf"{_WORD}(?:module\.)?exports\.({_NAME})\s*=(?!=)", c.code):
        found.append(exported(m[1]))
    return found


def javascript(c: Code) -> dict:
    parsed = typescript(c)
    known = {i["source"] for i in parsed["imports"]}
    parsed["imports"] += [i for i in _required(c) if i["source"] not in known]
    parsed["exports"] = distinct(parsed["exports"] + _common_exports(c))
    return parsed
