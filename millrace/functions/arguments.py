"""Parameters of function signatures in five languages, as an Arrow-batched function: a bracket depth needs a scan.

The result is ``array<struct<name, type, default>>``; a signature without parameters, or none at all, gives an empty one.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import col

_OPEN, _CLOSE = "([{<", ")]}>"
ARGUMENTS = "array<struct<name: string, type: string, default: string>>"


def split_top(text: str, separators: str = ",") -> list[str]:
    """Parts between separators outside brackets, trimmed; an arrow ``->`` or ``=>`` closes nothing; empty parts are left out."""
    parts, current, depth = [], [], 0
    for i, c in enumerate(text):
        if c in separators and depth == 0:
            parts.append("".join(current).strip())
            current = []
            continue
        if c in _OPEN:
            depth += 1
        elif c in _CLOSE and not (c == ">" and i and text[i - 1] in "-="):
            depth = max(0, depth - 1)
        current.append(c)
    parts.append("".join(current).strip())
    return [p for p in parts if p]


def parameter_text(signature: str, receiver: bool = False) -> str:
    """Text between the first pair of round brackets (the second one after a receiver)."""
    start = signature.find("(")
    if receiver and start >= 0:
        end = _closing(signature, start)
        start = signature.find("(", end + 1) if end >= 0 else -1
    if start < 0:
        return ""
    end = _closing(signature, start)
    return signature[start + 1 : end if end >= 0 else len(signature)]


def _closing(text: str, start: int) -> int:
    depth = 0
    for i in range(start, len(text)):
        depth += (text[i] == "(") - (text[i] == ")")
        if depth == 0:
            return i
    return -1


def _go(s: str) -> list[tuple]:
    s = re.sub(r"//[^\n]*", "", s)
    receiver = bool(re.match(r"\s*func\s*\(", s))
    out, waiting = [], []
    for p in split_top(parameter_text(s, receiver)):
        name, _, kind = p.partition(" ")
        if not kind.strip():
            waiting.append(name)
            continue
        out += [(n, kind.strip(), None) for n in (*waiting, name)]
        waiting = []
    return out + [("", n, None) for n in waiting]  # types without names


def _rust(s: str) -> list[tuple]:
    s = re.sub(r"^(\s*(?:pub(?:\([^)]*\))?\s+)?(?:async\s+|unsafe\s+|const\s+)*fn\s+\w+)\s*<[^(]*>", r"\1", s)
    out = []
    for p in split_top(parameter_text(s)):
        if re.fullmatch(r"(?:&\s*)?(?:'\w+\s+)?(?:mut\s+)?self(?:\s*:.*)?", p):
            continue
        name, _, kind = p.partition(":")
        out.append((re.sub(r"^(?:mut|ref)\s+", "", name.strip()), kind.strip() or None, None))
    return out


def _julia(s: str) -> list[tuple]:
    callable_object = bool(re.match(r"\s*(?:function\s+)?\([^)]*::", s))
    out = []
    for p in split_top(parameter_text(s, callable_object), ",;"):
        head, eq, default = _assignment(p)
        name, _, kind = head.partition("::")
        out.append((name.strip(), kind.strip() or None, default.strip() if eq else None))
    return out


def _php(s: str) -> list[tuple]:
    out = []
    for p in split_top(parameter_text(s)):
        m = re.match(r"(?:(?:public|protected|private|readonly)\s+)*(?P<type>[^$&.]*?)\s*&?\s*(?:\.\.\.)?\s*\$(?P<name>\w+)\s*(?:=\s*(?P<default>.*))?$", p, re.S)
        if m:
            out.append((m["name"], m["type"].strip() or None, m["default"]))
    return out


def _ruby(s: str) -> list[tuple]:
    inner = parameter_text(s) if "(" in s else re.sub(r"^\s*def\s+[\w.!?=]+\s*", "", s)
    out = []
    for p in split_top(inner):
        head, eq, default = _assignment(p)
        if not eq and (m := re.match(r"^(\w+):\s*(.*)$", p)):
            head, default, eq = m[1], m[2], m[2] != ""
        out.append((head.strip().lstrip("*&"), None, default.strip() if eq else None))
    return out


def _assignment(p: str) -> tuple[str, bool, str]:
    m = re.search(r"(?<![=<>!])=(?![=>])", p)
    return (p[: m.start()], True, p[m.end() :]) if m else (p, False, "")


PARSERS = {"go": _go, "rust": _rust, "julia": _julia, "php": _php, "ruby": _ruby}


def arguments(signature: str | Column, language: str | Column) -> Column:
    """Parameters of a signature (TXT-13 to TXT-18)."""

    @F.pandas_udf(ARGUMENTS)
    def parse(s: pd.Series, lang: pd.Series) -> pd.Series:
        def one(x, kind):
            parser = PARSERS.get((kind or "").strip().lower())
            return [{"name": n, "type": t, "default": d} for n, t, d in parser(re.sub(r"\s+", " ", x))] if parser and x else []

        return pd.Series([one(x, kind) for x, kind in zip(s, lang, strict=True)])

    return parse(col(signature), col(language))
