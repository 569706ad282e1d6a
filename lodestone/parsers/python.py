"""Python, by the standard library's syntax tree; by lines where a file does not parse."""

from __future__ import annotations

import ast
import re
import warnings

from .lexer import Code, distinct, exported, imported


def _start(node: ast.AST) -> tuple[int, int]:
    decorators = getattr(node, "decorator_list", [])
    first = min([node, *decorators], key=lambda n: (n.lineno, n.col_offset))
    return first.lineno, first.col_offset - (1 if decorators else 0)


class _Places:
    """Offsets of the tree's lines and byte columns."""

    def __init__(self, c: Code):
        self.c, self.lines = c, c.text.split("\n")
        self.starts = [0]
        for line in self.lines:
            self.starts.append(self.starts[-1] + len(line) + 1)

    def offset(self, line: int, column: int) -> int:
        text = self.lines[line - 1]
        return self.starts[line - 1] + (column if text.isascii() else len(text.encode()[:column].decode(errors="ignore")))

    def symbol(self, kind: str, name: str, node: ast.AST, bases: list[str] | None = None) -> dict:
        start, end = self.offset(*_start(node)), self.offset(node.end_lineno, node.end_col_offset)
        return self.c.symbol(kind, name, start, end, bases[0] if bases else None, bases[1:] if bases else [])


def _base(node: ast.expr) -> str:
    while isinstance(node, (ast.Call, ast.Subscript)):
        node = node.func if isinstance(node, ast.Call) else node.value
    return ast.unparse(node)


def _targets(node: ast.stmt) -> list[str]:
    targets = node.targets if isinstance(node, ast.Assign) else [node.target]
    flat = [t for top in targets for t in (top.elts if isinstance(top, (ast.Tuple, ast.List)) else [top])]
    return [t.id for t in flat if isinstance(t, ast.Name)]


def _tree_imports(tree: ast.Module) -> list[dict]:
    found = []
    nodes = [n for n in ast.walk(tree) if isinstance(n, (ast.Import, ast.ImportFrom))]
    for node in sorted(nodes, key=lambda n: (n.lineno, n.col_offset)):
        if isinstance(node, ast.Import):
            found += [imported(a.name, [a.asname or a.name.rsplit(".", 1)[-1]], default=True) for a in node.names]
        else:
            source = "." * node.level + (node.module or "")
            if any(a.name == "*" for a in node.names):
                found.append(imported(source, namespace=True))
            else:
                found.append(imported(source, [a.asname or a.name for a in node.names]))
    return found


def _listed(tree: ast.Module) -> list[str] | None:
    """The names in __all__, if the module has one."""
    names = None
    for node in tree.body:
        if isinstance(node, (ast.Assign, ast.AugAssign, ast.AnnAssign)) and "__all__" in _targets(node) and isinstance(node.value, (ast.List, ast.Tuple)):
            names = (names or []) + [e.value for e in node.value.elts if isinstance(e, ast.Constant) and isinstance(e.value, str)]
    return names


def _tree_symbols(c: Code, tree: ast.Module) -> list[dict]:
    at, found = _Places(c), []
    for node in tree.body:
        if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef)):
            found.append(at.symbol("function", node.name, node))
        elif isinstance(node, ast.ClassDef):
            found.append(at.symbol("class", node.name, node, [_base(b) for b in node.bases]))
            found += [at.symbol("method", f"{node.name}.{f.name}", f) for f in node.body if isinstance(f, (ast.FunctionDef, ast.AsyncFunctionDef))]
        elif isinstance(node, (ast.Assign, ast.AnnAssign)):
            found += [at.symbol("variable", n, node) for n in _targets(node)]
    return found


_FROM = re.compile(r"^[ \t]*from[ \t]+([.\w]+)[ \t]+import[ \t]+(\([^)]*\)|[^\n]+)", re.M)
_IMPORT = re.compile(r"^[ \t]*import[ \t]+([^\n]+)", re.M)
_DEFINED = re.compile(r"^(?:async[ \t]+)?(def|class)[ \t]+(\w+)[ \t]*(?:\(([^()]*)\))?", re.M)
_METHOD = re.compile(r"^([ \t]+)(?:async[ \t]+)?def[ \t]+(\w+)", re.M)
_SET = re.compile(r"^(\w+)[ \t]*(?::[^=\n]+)?=(?!=)", re.M)


def _block_end(c: Code, start: int, indent: int) -> int:
    """The end of an indented block: its last line with text before one that is not deeper."""
    end = c.code.find("\n", start)
    end = len(c.code) if end < 0 else end
    for m in re.compile(r"\n([ \t]*)(\S[^\n]*)").finditer(c.code, end):
        if len(m[1]) <= indent:
            break
        end = m.end()
    return end


def _by_lines(c: Code) -> dict:
    """A file that does not parse: what its lines say."""
    imports, symbols = [], []
    for m in sorted([*_FROM.finditer(c.code), *_IMPORT.finditer(c.code)], key=lambda m: m.start()):
        names = [p.split(" as ") for p in re.split(r"\s*,\s*", m[m.lastindex].strip(" ()\n\t\\")) if p.strip()]
        if m.re is _FROM:
            if names == [["*"]]:
                imports.append(imported(m[1], namespace=True))
            else:
                imports.append(imported(m[1], [n[-1].strip() for n in names]))
        else:
            imports += [imported(n[0].strip(), [n[1].strip() if len(n) > 1 else n[0].strip().rsplit(".", 1)[-1]], default=True) for n in names]
    found = []
    for m in _DEFINED.finditer(c.code):
        end = _block_end(c, m.start(), 0)
        bases = [b.strip() for b in (m[3] or "").split(",") if b.strip() and "=" not in b] if m[1] == "class" else []
        found.append(c.symbol("class" if m[1] == "class" else "function", m[2], m.start(), end, bases[0] if bases else None, bases[1:]))
        if m[1] == "class":
            methods = [k for k in _METHOD.finditer(c.code, m.end(), end)]
            depth = min((len(k[1]) for k in methods), default=0)
            found += [c.symbol("method", f"{m[2]}.{k[2]}", k.end(1), _block_end(c, k.start(), depth)) for k in methods if len(k[1]) == depth]
    for m in _SET.finditer(c.code):
        line_end = c.code.find("\n", m.end())
        found.append(c.symbol("variable", m[1], m.start(), len(c.code) if line_end < 0 else line_end))
    symbols = sorted(found, key=lambda s: (s["start_line"], s["start_col"]))
    return {"imports": imports, "exports": _public(symbols), "symbols": symbols}


def _public(symbols: list[dict]) -> list[dict]:
    return distinct([exported(s["name"]) for s in symbols if "." not in s["name"] and not s["name"].startswith("_")])


def python(c: Code) -> dict:
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            tree = ast.parse(c.text.replace("\r", " ").replace("\f", " "))
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return _by_lines(c)
    symbols, listed = _tree_symbols(c, tree), _listed(tree)
    exports = _public(symbols) if listed is None else distinct([exported(n) for n in listed])
    return {"imports": _tree_imports(tree), "exports": exports, "symbols": symbols}
