"""Ignore patterns (as in .gitignore files) as regular expressions, for Python and for Spark columns."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from echoline.operators.focus import ancestors


@dataclass(frozen=True)
class Pattern:
    regex: str
    negated: bool
    folders_only: bool


def compile_pattern(line: str) -> Pattern | None:
    """One line of an ignore file; None for blank lines and comments.

    A slash at the start or inside binds the pattern to the root; otherwise it holds at any depth.
    '**' spans folders, '*' and '?' stay within a name. ValueError where a class isn't closed.
    """
    text = line.rstrip("\r\n")
    text = re.sub(r"(?<!\\) +$", "", text)
    if not text or text.startswith("#"):
        return None
    negated = text.startswith("!")
    text = text[negated:]
    folders_only = text.endswith("/")
    text = text.rstrip("/") if folders_only else text
    bound = "/" in text
    text = text.lstrip("/")
    if not text:
        return None
    out, i = "" if bound else "(?:.*/)?", 0
    while i < len(text):
        c = text[i]
        if text.startswith("**/", i) and (i == 0 or text[i - 1] == "/"):
            out, i = out + "(?:.*/)?", i + 3
        elif text[i:] == "**" and i and text[i - 1] == "/":
            out, i = out + ".+", i + 2
        elif c == "*":
            while text.startswith("*", i):
                i += 1
            out += "[^/]*"
        elif c == "?":
            out, i = out + "[^/]", i + 1
        elif c == "[":
            close = text.find("]", i + 2)
            if close < 0:
                raise ValueError(f"unclosed class in pattern {line!r}")
            inner = text[i + 1 : close].replace("\\", r"\\")
            out, i = out + "[" + ("^" + inner[1:] if inner[0] in "!^" else inner).replace("[", r"\[") + "]", close + 1
        else:
            if c == "\\" and i + 1 < len(text):
                i += 1
                c = text[i]
            out, i = out + re.escape(c), i + 1
    return Pattern(out, negated, folders_only)


def compile_patterns(lines: list[str]) -> list[Pattern]:
    return [p for p in map(compile_pattern, lines) if p]


def decides(patterns: list[Pattern], path: str, is_folder: bool) -> bool | None:
    """Whether the last pattern that names this very path excludes it; None if none does."""
    for p in reversed(patterns):
        if (is_folder or not p.folders_only) and re.fullmatch(p.regex, path):
            return not p.negated
    return None


def excluded(patterns: list[Pattern], path: str, is_folder: bool = False) -> bool:
    """Whether path, or else the nearest folder above it that a pattern names, is excluded."""
    while path:
        verdict = decides(patterns, path, is_folder)
        if verdict is not None:
            return verdict
        path, is_folder = path.rpartition("/")[0], True
    return False


def is_excluded(path: Column, lines: list[str]) -> Column:
    """The same for a column of file paths, in one expression."""
    patterns = compile_patterns(lines)
    if not patterns:
        return F.lit(False)

    def verdict(own: Column) -> Column:
        found = F.lit(None).cast("boolean")
        for p in patterns:  # the last that holds wins
            hit = own.rlike(f"^(?:{p.regex})$")
            hit = hit & (own != path) if p.folders_only else hit
            found = F.when(hit, F.lit(not p.negated)).otherwise(found)
        return found

    levels = F.reverse(ancestors(path))
    return F.coalesce(F.try_element_at(F.array_compact(F.transform(levels, verdict)), F.lit(1)), F.lit(False))


def is_python_path(path: Column) -> Column:
    """Names that end in .py or .pyi; a bare '.py' has no extension."""
    return path.rlike(r"[^/]\.pyi?$")
