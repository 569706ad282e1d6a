"""Go, Rust, PHP, Java, C# and the C family: statements and bodies between braces."""

from __future__ import annotations

import re
from bisect import bisect_left

from .lexer import Code, distinct, exported, imported, split_top, without_generics


# ---- Go


def _go_import(c: Code, lo: int, hi: int) -> list[dict]:
    found = []
    for m in re.compile(r"(?:([\w.]+)[ \t]+)?([\"`])").finditer(c.code, lo, hi):
        source = c.literal(m.end() - 1)
        if not source or (found and m.start() < found[-1][1]):
            continue
        name = m[1] or source.rsplit("/", 1)[-1]
        dotted = m[1] == "."
        found.append((imported(source, [] if dotted else [name], default=not dotted and m[1] != "_", namespace=dotted), m.end() + len(source) + 1))
    return [f for f, _ in found]


def _go_specs(c: Code, at: int) -> tuple[list[tuple[int, int]], int]:
    """The specs of a declaration, grouped in round brackets or alone, and its end."""

    def line_end(i: int, hi: int) -> int:
        for j in c.depth_zero(i, hi):
            if c.code[j] in "\n;" and c.code[i:j].strip() and not re.search(r"[,=+\-*/|&]\s*\Z", c.code[i:j]):
                return j
        return hi

    if c.code[at : at + 1] == "(":
        close, specs, i = c.pairs[at], [], at + 1
        while (i := c.after_blank(i)) < close:
            j = line_end(i, close)
            specs.append((i, i + len(c.code[i:j].rstrip())))
            i = j + 1
        return specs, min(close + 1, len(c.code))
    end = line_end(at, len(c.code))
    end = at + len(c.code[at:end].rstrip())
    return [(at, end)], end


def go(c: Code) -> dict:
    imports, symbols = [], []
    top = set(c.depth_zero(0, len(c.code)))
    for m in re.finditer(r"^(import|func|type|const|var)\b[ \t]*", c.code, re.M):
        if m.start() not in top:
            continue
        at, kind = m.end(), m[1]
        if kind == "func":
            receiver = re.compile(r"\(([^()]*)\)\s*(\w+)").match(c.code, at)
            name = re.compile(r"(\w+)").match(c.code, at)
            if not receiver and not name:
                continue
            open_ = c.code.find("(", receiver.end() if receiver else at)
            end = c.pairs.get(open_, at) + 1
            # The result may hold brackets of its own; the body is the first brace on the same line.
            for i in c.depth_zero(end, len(c.code)):
                if c.code[i] == "\n":
                    break
                if c.code[i] == "{" and not re.search(r"\b(?:struct|interface)\s*\Z", c.code[end:i]):
                    end = c.pairs[i] + 1
                    break
            if receiver:
                owner = re.sub(r"\[.*", "", receiver[1].split()[-1].lstrip("*")) if receiver[1].split() else ""
                symbols.append(c.symbol("method", f"{owner}.{receiver[2]}", m.start(), min(end, len(c.code))))
            else:
                symbols.append(c.symbol("function", name[1], m.start(), min(end, len(c.code))))
            continue
        specs, end = _go_specs(c, at)
        if kind == "import":
            for lo, hi in specs:
                imports += _go_import(c, lo, hi)
        for lo, hi in specs if kind != "import" else []:
            spec = re.compile(r"(\w+)(?:\s*\[[^\]]*\](?=\s*(?:struct|interface)\b))?\s*=?\s*(struct|interface)?\b").match(c.code, lo)
            if kind == "type" and spec:
                embedded = None
                if spec[2] == "struct" and (brace := c.code.find("{", spec.end())) > 0:
                    for line in re.split(r"[\n;]", c.code[brace + 1 : c.pairs[brace]]):
                        if alone := re.fullmatch(r"\s*\*?([\w.]+)(?:\[.*\])?\s*(?:[\"`].*)?", line):
                            embedded = alone[1]
                            break
                symbols.append(c.symbol(spec[2] or "type", spec[1], lo, hi, embedded))
            elif kind in ("const", "var") and (names := re.compile(r"\w+(?:\s*,\s*\w+)*").match(c.code, lo)):
                symbols += [c.symbol("constant" if kind == "const" else "variable", n, m.start(), end) for n in re.split(r"\s*,\s*", names.group())]
    exports = [exported(s["name"]) for s in symbols if "A" <= s["name"].rsplit(".", 1)[-1][:1] <= "Z"]
    return {"imports": imports, "exports": exports, "symbols": symbols}


# ---- Rust


def _use_leaves(prefix: str, tree: str) -> list[dict]:
    tree = tree.strip()
    if m := re.fullmatch(r"(?:([\w:]*?)(?:::)?)\{(.*)\}", tree, re.S):
        inner = "::".join(p for p in (prefix, m[1]) if p)
        return [leaf for part in split_top(m[2]) for leaf in _use_leaves(inner, part)]
    path = re.sub(r"\s+as\s+\w+\Z", "", tree)
    head, _, last = path.rpartition("::")
    source = "::".join(p for p in (prefix, head) if p)
    if last == "*":
        return [imported(source, namespace=True)]
    if last == "self" and prefix and not head:
        outer, _, name = prefix.rpartition("::")
        return [imported(outer or name, [name])]
    return [imported(source or last, [last])] if last else []


_ITEM = re.compile(
    r"(?:\#!?\[[^\]]*\]\s*)*(?P<start>(?P<pub>pub(?:\s*\([^)]*\))?\s+)?(?:default\s+|async\s+|unsafe\s+|extern\s*(?:\"\s*\")?\s*|const\s+(?=fn|unsafe|async|extern))*(?P<kind>fn|struct|enum|union|trait|impl|type|const|static|mod|use|macro_rules!)\b)\s*(?:mut\s+)?(?P<name>\w+)?", re.S
)
_RUST_KIND = {"struct": "struct", "union": "struct", "enum": "enum", "trait": "trait", "type": "type", "const": "constant", "static": "variable", "mod": "module", "fn": "function"}


def _rust_items(c: Code, lo: int, hi: int):
    for start, head, brace, end in c.statements(lo, hi, r"\b(?:use\b[^;]*|const\s[^;{]*=|static\s[^;{]*=)\Z"):
        m = _ITEM.match(c.code, start, end)
        if m:
            yield m, m.start("start"), head, brace, end


def rust(c: Code) -> dict:
    imports, symbols, exports, of_type = [], [], [], {}

    def walk(lo: int, hi: int) -> None:
        for m, start, head, brace, end in _rust_items(c, lo, hi):
            kind, public = m["kind"], m["pub"] is not None
            if kind == "use":
                imports.extend(_use_leaves("", re.sub(r"\s+", " ", c.code[m.end("start") : end].rstrip("; \n"))))
            elif kind == "impl" and brace is not None:
                target = c.code[m.end("start") : head]
                target = re.sub(r"^\s*<(?:[^<>]|<[^<>]*>)*>", "", target)
                target = without_generics(re.split(r"\bwhere\b", target)[0])
                trait, _, owner = target.rpartition(" for ")
                owner, trait = owner.strip(" &'"), trait.strip().lstrip("!")
                if trait:
                    of_type.setdefault(owner, []).append(trait)
                for inner, at, _, _, stop in _rust_items(c, brace + 1, c.pairs[brace]):
                    if inner["kind"] == "fn" and inner["name"]:
                        symbols.append(c.symbol("method", f"{owner}.{inner['name']}", at, stop, None, [trait] if trait else []))
                        if inner["pub"] is not None:
                            exports.append(exported(f"{owner}.{inner['name']}"))
            elif kind in _RUST_KIND and m["name"]:
                symbols.append(c.symbol(_RUST_KIND[kind], m["name"], start, end))
                if public:
                    exports.append(exported(m["name"]))
                if kind == "mod" and brace is not None:
                    walk(brace + 1, c.pairs[brace])

    walk(0, len(c.code))
    for s in symbols:
        if s["kind"] in ("struct", "enum"):
            s["implements"] = of_type.get(s["name"], [])
    return {"imports": imports, "exports": exports, "symbols": symbols}


# ---- PHP


_PHP_TYPE = re.compile(r"(?:\#\[[^\]]*\]\s*)*(?:(?:abstract|final|readonly)\s+)*(class|interface|trait|enum)\s+(\w+)([^{]*)")
_PHP_FUNCTION = re.compile(r"(?:\#\[[^\]]*\]\s*)*(?:(?:abstract|final|public|protected|private|static)\s+)*function\s+&?\s*(\w+)")


def _php_use(clause: str) -> list[dict]:
    clause = re.sub(r"\s+", " ", clause).strip()
    if group := re.fullmatch(r"(?:function |const )?\\?([\w\\]+?)\\?\{(.*)\}", clause):
        return [imported(group[1], [re.split(r" as ", p)[0].rsplit("\\", 1)[-1].strip() for p in split_top(group[2])])]
    found = []
    for part in split_top(clause):
        path = re.sub(r"^(?:function|const) ", "", re.split(r" as ", part)[0]).strip().strip("\\")
        head, _, last = path.rpartition("\\")
        if last:
            found.append(imported(head, [last]))
    return found


def php(c: Code) -> dict:
    imports, symbols, exports = [], [], []
    methods_of: list[dict] = []

    def walk(lo: int, hi: int) -> None:
        for start, head, brace, end in c.statements(lo, hi, r"^\s*use\b"):
            text = c.code[start:head]
            if m := re.match(r"namespace\s+([\w\\]+)", text):
                symbols.append(c.symbol("namespace", m[1], start, end))
                exports.append(exported(m[1]))
                if brace is not None:
                    walk(brace + 1, c.pairs[brace])
            elif re.match(r"use\b", text):
                imports.extend(_php_use(c.code[start + 3 : end].rstrip("; \n")))
            elif (m := _PHP_TYPE.match(text)) and brace is not None:
                base = re.search(r"\bextends\s+([\w\\]+)", m[3])
                listed = re.search(r"\bimplements\s+([\w\\,\s]+)", m[3])
                symbols.append(c.symbol(m[1], m[2], start, end, base[1] if base else None, split_top(listed[1]) if listed else []))
                exports.append(exported(m[2]))
                for s, _, _, e in c.statements(brace + 1, c.pairs[brace]):
                    if f := _PHP_FUNCTION.match(c.code, s, e):
                        symbols.append(c.symbol("method", f"{m[2]}.{f[1]}", s, e))
                    elif f := re.compile(r"(?:(?:final|public|protected|private)\s+)*const\s+(?:[\w\\|?]+\s+)?(\w+)\s*=").match(c.code, s, e):
                        symbols.append(c.symbol("constant", f[1], s, e))
            elif m := _PHP_FUNCTION.match(text):
                symbols.append(c.symbol("function", m[1], start, end))
                exports.append(exported(m[1]))
            elif re.match(r"const\b", text):
                for name in re.findall(r"(\w+)\s*=(?!=)", text):
                    symbols.append(c.symbol("constant", name, start, end))
                    exports.append(exported(name))

    walk(0, len(c.code))
    for m in re.finditer(r"(?<![\w$>:])(?:include|require)(?:_once)?\b\s*\(?\s*", c.code):
        stop = next((i for i in c.depth_zero(m.end(), len(c.code)) if c.code[i] in ";)"), len(c.code))
        quote = re.compile(r"['\"]").search(c.code, m.end(), stop)
        source = c.literal(quote.start()) if quote else c.text[m.end() : stop].strip()
        if source:
            imports.append(imported(source, dynamic=True))
    return {"imports": imports, "exports": exports, "symbols": symbols}


# ---- Java


_MODIFIER = r"(?:@[\w.]+(?:\s*\([^()]*(?:\([^()]*\)[^()]*)*\))?\s*|(?:public|protected|private|static|abstract|final|sealed|non-sealed|strictfp|default|synchronized|native|transient|volatile)\s+)*"
_JAVA_TYPE = re.compile(rf"(?P<mods>{_MODIFIER})(?P<kind>class|interface|enum|@interface|record)\s+(?P<name>\w+)(?P<rest>[^{{]*)")
_JAVA_METHOD = re.compile(rf"{_MODIFIER}(?:<[^(){{}}]*?>\s*)?(?:(?P<type>[\w.$]+(?:\s*<[^(){{}};=]*>)?(?:\s*\[\s*\])*)\s+)?(?P<name>\w+)\s*\(")
_JAVA_FIELD = re.compile(rf"{_MODIFIER}(?P<type>[\w.$]+(?:\s*<[^(){{}};=]*>)?(?:\s*\[\s*\])*)\s+(?P<names>\w+[^;(]*?)\s*(?:=|;|\Z)")
_JAVA_KIND = {"class": "class", "record": "class", "interface": "interface", "@interface": "interface", "enum": "enum"}


def _named_types(clause: str) -> list[str]:
    return [p for p in (re.sub(r"^@\w+\s+", "", without_generics(x)) for x in split_top(clause)) if p]


def java(c: Code) -> dict:
    imports, symbols, exports = [], [], []
    for m in re.finditer(r"(?<![\w.])import\s+(static\s+)?([\w.]+?)(\.\*)?\s*;", c.code):
        head, _, last = m[2].rpartition(".")
        if m[3]:
            imports.append(imported(m[2], namespace=True, type_only=not m[1]))
        else:
            imports.append(imported(head, [last], type_only=not m[1]))

    def walk(lo: int, hi: int, owner: str | None) -> None:
        for start, head, brace, end in c.statements(lo, hi):
            t = _JAVA_TYPE.match(c.code, start, head)
            if t and brace is not None:
                rest = re.sub(r"^\s*\([^{]*?\)(?=\s*(?:implements|\Z))", "", without_generics(t["rest"]))
                base = re.search(r"\bextends\s+(.+?)(?=\bimplements\b|\bpermits\b|\Z)", rest, re.S)
                traits = re.search(r"\bimplements\s+(.+?)(?=\bpermits\b|\Z)", rest, re.S)
                bases = _named_types(base[1]) if base else []
                listed = _named_types(traits[1]) if traits else []
                if t["kind"] == "interface":
                    listed = bases[1:]
                symbols.append(c.symbol(_JAVA_KIND[t["kind"]], t["name"], start, end, bases[0] if bases else None, listed))
                if owner is None and re.search(r"\bpublic\b", t["mods"]):
                    exports.append(exported(t["name"]))
                body = brace + 1
                if t["kind"] == "enum":
                    body = next((i + 1 for i in c.depth_zero(body, c.pairs[brace]) if c.code[i] == ";"), c.pairs[brace])
                walk(body, c.pairs[brace], t["name"])
            elif owner is not None:
                f = _JAVA_METHOD.match(c.code, start, head)
                if f and (f["type"] or f["name"] == owner) and f["type"] not in ("return", "new", "throw"):
                    symbols.append(c.symbol("method", f"{owner}.{f['name']}", start, end))
                elif (v := _JAVA_FIELD.match(c.code, start, end)) and brace is None and v["type"] not in ("return", "import", "package"):
                    names = [re.match(r"\w+", p) for p in split_top(c.code[v.start("names") : end].rstrip("; \n"))]
                    symbols.extend(c.symbol("variable", f"{owner}.{n.group()}", start, end) for n in names if n)

    walk(0, len(c.code), None)
    return {"imports": imports, "exports": distinct(exports), "symbols": symbols}


# ---- C#


_CS_MODIFIER = r"(?P<mods>(?:\[[^\]]*\]\s*)*(?:(?:public|private|protected|internal|static|abstract|sealed|partial|readonly|virtual|override|async|extern|unsafe|new|ref|required|volatile|const|event|file)\s+)*)"
_CS_TYPE = re.compile(rf"{_CS_MODIFIER}(?P<kind>class|interface|struct|enum|record(?:\s+(?:class|struct))?|delegate)\s+(?P<rest>.*)", re.S)
_CS_TOKEN = r"[\w.]+(?:\s*<[^(){};=]*>)?(?:\s*\?)?(?:\s*\[[\s,]*\])*(?:\s*\?)?|\([^()]*\)"
_CS_METHOD = re.compile(rf"{_CS_MODIFIER}(?:(?P<type>{_CS_TOKEN})\s+)?(?P<name>[\w.]+)\s*(?:<[^(){{}};=]*>)?\s*\(")
_CS_MEMBER = re.compile(rf"{_CS_MODIFIER}(?P<type>{_CS_TOKEN})\s+(?P<name>\w+)")
_CS_KIND = {"class": "class", "interface": "interface", "struct": "struct", "enum": "enum", "record": "class", "record class": "class", "record struct": "struct"}


def csharp(c: Code) -> dict:
    imports, symbols, exports = [], [], []

    def members(lo: int, hi: int, owner: str, implicit: bool) -> None:
        for start, head, brace, end in c.statements(lo, hi):
            text = c.code[start:head]
            if (t := _CS_TYPE.match(text)) and not re.match(r"\w+\s*\(", t["rest"]):
                declared(start, head, brace, end, t)
                continue
            f, p = _CS_METHOD.match(c.code, start, head), _CS_MEMBER.match(c.code, start, head)
            if p and re.search(r"\bevent\b", p["mods"]):
                continue
            name = kind = None
            arrow = text.find("=>")
            if f and (f["type"] or f["name"] == owner) and (arrow < 0 or f.end() - start < arrow) and "=" not in text[: f.end() - start]:
                kind, names, mods = "method", [f["name"].rsplit(".", 1)[-1]], f["mods"]
            elif p and (brace is not None or arrow >= 0) and "=" not in text.replace("=>", "") or (p and brace is not None):
                kind, names, mods = "property", [p["name"]], p["mods"]
            elif p:
                kind, mods = "variable", p["mods"]
                names = [n.group() for n in (re.match(r"\w+", x) for x in split_top(c.code[p.start("name") : end].rstrip("; \n"))) if n]
            if kind:
                for name in names:
                    symbols.append(c.symbol(kind, f"{owner}.{name}", start, end))
                    if implicit or re.search(r"\bpublic\b", mods):
                        exports.append(exported(f"{owner}.{name}"))

    def declared(start: int, head: int, brace: int | None, end: int, t: re.Match) -> None:
        public = re.search(r"\bpublic\b", t["mods"])
        if t["kind"] == "delegate":
            name = re.search(r"(\w+)\s*(?:<[^(]*>)?\s*\(", t["rest"])
            if name:
                symbols.append(c.symbol("type", name[1], start, end))
                if public:
                    exports.append(exported(name[1]))
            return
        name = re.match(r"\w+", t["rest"])
        if not name:
            return
        clause = re.split(r"\bwhere\b", t["rest"])[0]
        clause = re.sub(r"\([^()]*\)", "", clause)
        bases = _named_types(clause.split(":", 1)[1]) if ":" in clause else []
        kind = re.sub(r"\s+", " ", t["kind"])
        if kind == "enum":
            bases = []
        symbols.append(c.symbol(_CS_KIND[kind], name.group(), start, end, bases[0] if bases else None, bases[1:]))
        if public:
            exports.append(exported(name.group()))
        if brace is not None and kind != "enum":
            members(brace + 1, c.pairs[brace], name.group(), False)

    def walk(lo: int, hi: int) -> None:
        for start, head, brace, end in c.statements(lo, hi):
            text = c.code[start:head]
            if m := re.match(r"(?:global\s+)?using\s+(static\s+)?(?:(\w+)\s*=\s*)?([\w.:]+)", text):
                if brace is None:
                    source = m[2] or m[3]
                    imports.append(imported(source, [source.rsplit(".", 1)[-1]], default=not m[1]))
            elif m := re.match(r"namespace\s+([\w.]+)", text):
                symbols.append(c.symbol("namespace", m[1], start, end if brace is not None else end))
                if brace is not None:
                    walk(brace + 1, c.pairs[brace])
            elif t := _CS_TYPE.match(text):
                declared(start, head, brace, end, t)

    walk(0, len(c.code))
    return {"imports": imports, "exports": distinct(exports), "symbols": symbols}


# ---- C and C++


def _includes(c: Code) -> list[dict]:
    found = []
    for m in re.finditer(r"^[ \t]*\#[ \t]*include[ \t]*(?:(\")|<([^>\n]*)>)", c.lines, re.M):
        source = c.text[m.end(1) : c.lines.find('"', m.end(1))] if m[1] else m[2]
        if source:
            found.append(imported(source, [re.sub(r"\.[^.]*\Z", "", source.rsplit("/", 1)[-1])], default=True))
    return found


_DEFINE = re.compile(r"^[ \t]*\#[ \t]*define[ \t]+(\w+)(\()?(?:\\\n|[^\n])*", re.M)
_TAG = re.compile(r"(?:(?:static|const|extern|volatile|inline|constexpr)\s+)*(struct|enum|union)(?:\s+(?:class|struct))?\s+(\w+)")
_CALL = re.compile(r"(?P<name>(?:[\w]+\s*(?:<[^<>]*>)?\s*::\s*)*(?:~?\w+|operator\s*(?:\(\s*\)|[^\s\w(]+|\w+)))\s*\(")
_NOT_NAMES = frozenset("if for while switch return sizeof else do case goto throw new delete catch alignof decltype static_assert __attribute__ __declspec defined using".split())


def _declared_call(text: str) -> re.Match | None:
    """The name before the parameter list of a function, where text declares one."""
    flat = text.split("=")[0] if "operator" not in text else text
    for m in _CALL.finditer(flat):
        if m["name"].strip() not in _NOT_NAMES:
            return m
    return None


def _variables(text: str) -> list[str]:
    """Names that a declaration without a parameter list introduces."""
    parts = split_top(re.sub(r"\{.*\}", "", text, flags=re.S))
    names = []
    for i, part in enumerate(parts):
        target = re.sub(r"\[[^\]]*\]", "", part.split("=")[0]).strip()
        words = re.findall(r"\w+", target)
        if words and (i > 0 or len(words) > 1) and not words[-1][0].isdigit():
            names.append(words[-1])
    return names


def c_language(c: Code) -> dict:
    found, exports = [], []
    for m in _DEFINE.finditer(c.lines):
        found.append((m.start(), [c.symbol("function" if m[2] else "constant", m[1], m.start(), m.end())]))
        exports.append((m.start(), [m[1]]))
    # What stands between conditional directives is no child of the file itself.
    hidden, open_ = [], []
    for m in re.finditer(r"^[ \t]*\#[ \t]*(if|ifdef|ifndef|endif)\b", c.lines, re.M):
        if m[1] != "endif":
            open_.append(m.start())
        elif open_:
            hidden.append((open_.pop(), m.end()))
    # A guard around the whole file hides nothing.
    guard = re.match(r"\s*\#[ \t]*ifndef\s+(\w+)\s+\#[ \t]*define\s+\1\b", c.lines)
    hidden.sort()
    if guard and hidden:
        del hidden[0]
    outer: list[tuple[int, int]] = []
    for lo, hi in hidden:
        if not outer or lo > outer[-1][1]:
            outer.append((lo, hi))
    starts = [lo for lo, _ in outer]

    def inside(at: int) -> bool:
        i = bisect_left(starts, at) - 1
        return i >= 0 and at < outer[i][1]

    for start, head, brace, end in c.statements(0, len(c.code), r"^\s*(?:typedef\b|(?:static\s+|const\s+|extern\s+)*(?:struct|enum|union)\b[^()]*\Z)"):
        text, whole = c.code[start:head], c.code[start:end]
        static = re.match(r"(?:\w+\s+)*?static\b", text)
        rows, names = [], []
        if text.startswith("typedef"):
            rest = re.sub(r"\{.*\}", " ", whole, flags=re.S).rstrip("; \n")
            pointer = re.search(r"\(\s*\*\s*(\w+)\s*\)", rest)
            words = re.findall(r"\w+", re.sub(r"\[[^\]]*\]", "", rest))
            name = pointer[1] if pointer else words[-1] if len(words) > 1 else None
            if name:
                rows.append(c.symbol("type", name, start, end))
                names.append(name)
        elif brace is not None and (m := _declared_call(text)) and not re.match(r"(?:static\s+|const\s+)*(?:struct|enum|union)\s+\w+\s*\Z", text):
            rows.append(c.symbol("function", m["name"].strip(), start, end))
            names.append(m["name"].strip())
        else:
            tag = _TAG.match(text)
            if tag and brace is not None:
                rest = c.code[c.pairs[brace] + 1 : end].strip(" ;\n")
                if tag[1] != "union":
                    rows.append(c.symbol("struct" if tag[1] == "struct" else "enum", tag[2], start, end))
                    names.append(tag[2])
                names_after = _variables("x " + rest) if rest else []
                rows += [c.symbol("variable", n, start, end) for n in names_after]
                names += names_after
            elif (m := _declared_call(text)) and not re.search(r"\(\s*\*", text) and brace is None and re.search(r"\w[\s*]+\Z|\w\Z", text[: m.start()] or " "):
                rows.append(c.symbol("function", m["name"].strip(), start, end))
                names.append(m["name"].strip())
            elif not re.match(r"(?:extern\s*\"|using\b|return\b|struct\s+\w+\s*\Z)", text):
                pointers = re.findall(r"\(\s*\*\s*(\w+)", text.split("=")[0])
                listed = pointers[:1] or _variables(whole.rstrip("; \n"))
                rows += [c.symbol("variable", n, start, end) for n in listed]
                names += listed
        if not inside(start):
            found.append((start, rows))
            if not static:
                exports.append((start, names))
    found = [f for f in found if not inside(f[0])]
    exports = [e for e in exports if not inside(e[0])]
    symbols = [s for _, rows in sorted(found, key=lambda f: f[0]) for s in rows]
    listed = [exported(n) for _, names in sorted(exports, key=lambda e: e[0]) for n in names]
    return {"imports": _includes(c), "exports": distinct(listed), "symbols": symbols}


_CPP_TYPE = re.compile(r"(?:(?:typedef|static|inline|const|extern|alignas\([^)]*\)|\[\[[^\]]*\]\])\s+)*(class|struct|union)\s+(?:\[\[[^\]]*\]\]\s*|\w+\s+(?=\w+\s*(?::|final|\Z)))?(\w+)\s*(?:<[^{]*?>)?\s*(?:final\s*)?(?::(?!:)([^{]*))?\s*\Z", re.S)


def _bases(clause: str | None) -> list[str]:
    listed = split_top(clause or "")
    return [b for b in (without_generics(re.sub(r"\b(?:public|private|protected|virtual)\b", "", p)) for p in listed) if b]


def cpp(c: Code) -> dict:
    imports, symbols, static = _includes(c), [], set()
    for m in re.finditer(r"^[ \t]*(?:export\s+)?import\s+([\w.:]+)\s*;", c.code, re.M):
        imports.append(imported(m[1], [re.split(r"[.:]", m[1])[-1]]))

    def walk(lo: int, hi: int, owner: str | None, root: bool) -> None:
        tail = r"(?:^|\s|;)(?:typedef\s+)?(?:class|struct|union|enum)\b[^()]*\Z"
        for start, head, brace, end in c.statements(lo, hi, tail):
            # Access labels and template headers stand before the statement proper.
            proper = start
            while label := re.compile(r"\s*(?:(?:public|private|protected|signals|(?:public|private|protected)\s+slots)\s*:(?!:)|template\s*<(?:[^<>]|<[^<>]*>)*>(?:\s*requires\s+[^{;]*?(?=\s(?:class|struct)))?)\s*").match(c.code, proper, head):
                proper = c.after_blank(label.end())
            text, whole = c.code[proper:head], c.code[proper:end]
            before = len(symbols)
            if m := re.match(r"(?:inline\s+)?namespace\b\s*([\w:]+)?", text):
                if brace is not None:
                    symbols.append(c.symbol("namespace", m[1] or "<anonymous>", proper, end))
                    walk(brace + 1, c.pairs[brace], None, False)
            elif re.match(r"extern\s*\"", text) and brace is not None:
                walk(brace + 1, c.pairs[brace], None, root)
            elif brace is not None and (m := _CPP_TYPE.match(text)) and not text.startswith("typedef"):
                name, bases = f"{owner}::{m[2]}" if owner else m[2], _bases(m[3])
                symbols.append(c.symbol("class" if m[1] == "class" else "struct", name, proper, min(c.pairs[brace] + 1, len(c.code)), bases[0] if bases else None, bases[1:]))
                walk(brace + 1, c.pairs[brace], name, False)
            elif m := re.match(r"enum\s+(?:class\s+|struct\s+)?(\w+)", text):
                if brace is not None:
                    symbols.append(c.symbol("enum", f"{owner}::{m[1]}" if owner else m[1], proper, min(c.pairs[brace] + 1, len(c.code))))
            elif text.startswith("typedef"):
                rest = re.sub(r"\{.*\}", " ", whole, flags=re.S).rstrip("; \n")
                pointer, words = re.search(r"\(\s*\*\s*(\w+)\s*\)", rest), re.findall(r"\w+", rest)
                if pointer or len(words) > 1:
                    symbols.append(c.symbol("type", pointer[1] if pointer else words[-1], proper, end))
            elif m := re.match(r"using\s+(\w+)\s*=", text):
                symbols.append(c.symbol("type", m[1], proper, end))
            elif re.match(r"(?:using|friend|static_assert|return|import|export|class|struct)\b", text):
                continue
            elif m := _declared_call(text):
                name = re.sub(r"\s+", "", without_generics(m["name"])) if "operator" not in m["name"] else re.sub(r"\s+", "", m["name"])
                if owner:
                    # Members that are only declared here have no symbol; their definitions have.
                    if brace is not None or re.search(r"=\s*default\s*\Z", text):
                        symbols.append(c.symbol("method", f"{owner}::{name}", proper, end))
                elif brace is not None or re.search(r"\w[\s*&>]+\Z", text[: m.start()]):
                    symbols.append(c.symbol("method" if "::" in name else "function", name, proper, end))
            elif not owner and (brace is None or re.fullmatch(r"[\w:<>,*&\s]+\s[*&]*\w+\s*", text)):
                symbols.extend(c.symbol("variable", n, proper, end) for n in _variables(whole.rstrip("; \n")))
            if root and re.match(r"(?:inline\s+|const\s+|constexpr\s+)*static\b", text):
                static.update(s["name"] for s in symbols[before:])

    walk(0, len(c.code), None, True)
    exports = distinct([exported(s["name"]) for s in symbols if s["name"] not in static])
    return {"imports": imports, "exports": exports, "symbols": symbols}
