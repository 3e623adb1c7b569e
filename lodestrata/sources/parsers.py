"""Functions found in a source file, by a registry of parsers for file extensions."""

from __future__ import annotations

import ast
import re
from collections.abc import Callable

#: (name, container, start_line, end_line, cc, nloc); lines count from 1, the last included.
Unit = tuple[str, str, int, int, int, int]
Parser = Callable[[str, str], list[Unit]]

_REGISTRY: dict[str, tuple[str, Parser]] = {}


def register(name: str, parser: Parser, extensions: list[str] | None = None, default: bool = False) -> None:
    """Make `parser(text, path)` responsible for extensions, or for all that have none of their own."""
    for ext in extensions or []:
        _REGISTRY[ext] = (name, parser)
    if default:
        _REGISTRY[""] = (name, parser)


def get_parser(ext: str) -> tuple[str, Parser] | None:
    """(name, parser) for an extension. Results are kept by content and this name, as parsers may differ."""
    return _REGISTRY.get(ext) or _REGISTRY.get("")


def parse_units(text: str, path: str, ext: str) -> list[Unit]:
    """The units of a file; none if there is no parser or it fails."""
    found = get_parser(ext)
    try:
        return found[1](text, path) if found else []
    except (SyntaxError, ValueError, RecursionError):
        return []


_BRANCHES = (ast.If, ast.IfExp, ast.For, ast.AsyncFor, ast.While, ast.ExceptHandler, ast.Assert, ast.comprehension, ast.match_case)


def parse_python(text: str, path: str) -> list[Unit]:
    """Functions and methods of Python source; complexity is 1 + branches + operands of and/or beyond the first."""
    units: list[Unit] = []
    lines = text.split("\n")

    def complexity(node: ast.AST) -> int:
        n = 0
        for child in ast.iter_child_nodes(node):
            if isinstance(child, (ast.FunctionDef, ast.AsyncFunctionDef, ast.Lambda)):
                continue
            n += isinstance(child, _BRANCHES) + (len(child.values) - 1 if isinstance(child, ast.BoolOp) else 0) + complexity(child)
        return n

    def walk(node: ast.AST, outer: list[str]) -> None:
        for child in ast.iter_child_nodes(node):
            if isinstance(child, (ast.FunctionDef, ast.AsyncFunctionDef)):
                end = child.end_lineno or child.lineno
                nloc = sum(1 for x in lines[child.lineno - 1 : end] if x.strip() and not x.strip().startswith("#"))
                units.append(("::".join([*outer, child.name]), "::".join(outer), child.lineno, end, 1 + complexity(child), nloc))
                walk(child, outer)
            elif isinstance(child, ast.ClassDef):
                walk(child, [*outer, child.name])
            else:
                walk(child, outer)

    walk(ast.parse(text), [])
    return units


_HIDDEN = re.compile(r"//[^\n]*|/\*.*?\*/|\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'|`(?:\\.|[^`\\])*`", re.S)
_TYPE = re.compile(r"\b(?:class|struct|interface|impl|trait|object|enum|namespace|extension)\s+(\w+)")
_CALLABLE = re.compile(r"([A-Za-z_$~][\w$]*(?:::~?\w+)*)\s*(?:<[^<>{};]*>)?\s*\([^;{}]*\)[^;{}()=]*$")
_DECISION = re.compile(r"\b(?:if|for|while|case|catch|when|guard|elif|foreach)\b|&&|\|\||\?(?![.?:])")
# Words before a bracket that are no names of functions.
_NO_NAMES = {"if", "for", "while", "switch", "catch", "return", "do", "else", "try", "synchronized", "using", "lock", "foreach", "match", "guard", "sizeof", "new"}


def parse_braces(text: str, path: str) -> list[Unit]:
    """Functions of languages with braces: a name and brackets before a block that is no control statement.

    Complexity is 1 + decision words and operators. Values are those of this parser and comparable only with it.
    """
    clean = _HIDDEN.sub(lambda m: re.sub(r"[^\n]", " ", m.group()), text)
    units: list[Unit] = []
    stack: list[tuple[str, str, int]] = []  # kind, name, place of the opening brace or head
    head_from = 0
    for i, c in enumerate(clean):
        if c not in "{};":
            continue
        if c == "{":
            head = clean[head_from:i]
            kind, name, at = "block", "", head_from
            called, typed = _CALLABLE.search(head.rstrip()), None
            for typed in _TYPE.finditer(head):
                pass
            if typed and not (called and called.start() > typed.start() and called.group(1) not in _NO_NAMES):
                kind, name = "type", typed.group(1)
            elif called and called.group(1) not in _NO_NAMES and not any(k == "unit" for k, _, _ in stack):
                kind, name, at = "unit", called.group(1), head_from + called.start(1)
            stack.append((kind, name, at))
        elif c == "}" and stack:
            kind, name, at = stack.pop()
            if kind == "unit":
                outer = [n for k, n, _ in stack if k == "type"]
                full = "::".join([*outer, name])
                body = clean[at:i]
                first, last = clean.count("\n", 0, at) + 1, clean.count("\n", 0, i) + 1
                nloc = sum(1 for x in body.split("\n") if x.strip())
                units.append((full, full.rpartition("::")[0], first, last, 1 + len(_DECISION.findall(body)), nloc))
        head_from = i + 1
    return sorted(units, key=lambda u: (u[2], u[3]))


register("python-ast", parse_python, [".py"])
register("braces", parse_braces, default=True)
