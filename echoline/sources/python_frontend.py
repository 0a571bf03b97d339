"""Python source to normalized lines: masks for what is ignored, context and scope for what is left."""

from __future__ import annotations

import ast
import io
import re
import tokenize
import warnings
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from echoline.session import spread

#: Unicode White_Space (fixed values); Python's strip takes U+001C to U+001F as well.
_BLANK = "\t\n\v\f\r \x85\xa0                　"
_EFFECTIVE = regex.compile(r"[\p{Alphabetic}\p{N}_]")
_LONE_RETURN = re.compile(r"\r(?!\n)")
SCOPE_RANK = {"module": 0, "class": 1, "function": 2}


@dataclass(frozen=True)
class NormalizationOptions:
    """What is masked before lines are compared."""

    ignore_comments: bool = True
    ignore_docstrings: bool = True
    ignore_imports: bool = True
    ignore_signatures: bool = True


class SourceError(Exception):
    """A source that can't be prepared; line and column count from 1."""

    def __init__(self, kind: str, message: str, line: int = 1, column: int = 1):
        super().__init__(message)
        self.kind, self.message, self.line, self.column = kind, message, line, column


def source_line_count(source: str) -> int:
    return source.count("\n") + (bool(source) and not source.endswith("\n"))


class _Analysis:
    def __init__(self, source: str, options: NormalizationOptions, directive: str):
        self.options = options
        self.masks: list[tuple[int, int]] = []
        self.events: list[tuple[int, str]] = []
        self.regions: list[tuple[int, int, str, str]] = []
        # both parser and tokenizer take a lone carriage return for a line end; one character stays one
        text = _LONE_RETURN.sub("\n", source)
        self.text = text
        self.starts = [0, *(m.end() for m in re.finditer("\n", text))]
        tree = self._parse(text)
        self._tokenize(text, directive)
        if options.ignore_docstrings:
            self._docstring(tree.body)
        self._visit(tree.body, "module", 0)
        self.masks = self._merged(self.masks)
        self.regions.sort(key=lambda r: r[:2])

    def _parse(self, text: str) -> ast.Module:
        try:
            with warnings.catch_warnings():
                warnings.simplefilter("ignore")
                return ast.parse(text)
        except SyntaxError as e:
            raise SourceError("parse", e.msg or "invalid syntax", e.lineno or 1, max(1, e.offset or 1)) from None
        except (ValueError, RecursionError, MemoryError) as e:
            raise SourceError("parse", str(e) or type(e).__name__) from None

    def _tokenize(self, text: str, directive: str) -> None:
        skipped = (tokenize.INDENT, tokenize.DEDENT, tokenize.ENDMARKER)
        try:
            found = [t for t in tokenize.generate_tokens(io.StringIO(text).readline) if t.type not in skipped]
        except (tokenize.TokenError, SyntaxError) as e:
            raise SourceError("parse", str(e.args[0])) from None
        self.tokens = [(t.type, t.string, self.starts[t.start[0] - 1] + t.start[1], self.starts[t.end[0] - 1] + t.end[1]) for t in found]
        self.token_starts = [t[2] for t in self.tokens]
        for kind, string, start, end in self.tokens:
            if kind == tokenize.COMMENT:
                said = string[1:].strip(_BLANK)
                event = said.removeprefix(directive + ": ") if said in (f"{directive}: disable", f"{directive}: enable") else None
                if event:
                    self.events.append((start, event))
                if event or self.options.ignore_comments:
                    self.masks.append((start, end))

    def _offset(self, line: int, column: int) -> int:
        start = self.starts[line - 1]
        stop = self.starts[line] if line < len(self.starts) else len(self.text)
        row = self.text[start:stop]
        return start + (column if row.isascii() else len(row.encode("utf-8", "surrogatepass")[:column].decode("utf-8", "ignore")))

    def _range(self, node: ast.stmt) -> tuple[int, int]:
        start = self._offset(node.lineno, node.col_offset)
        if decorators := getattr(node, "decorator_list", None):
            first = self._offset(decorators[0].lineno, decorators[0].col_offset)
            at = bisect_left(self.token_starts, first)
            while at and self.tokens[at - 1][1] != "@":
                at -= 1
            start = min(start, self.tokens[at - 1][2]) if at else start
        return start, self._offset(node.end_lineno, node.end_col_offset)

    def _whole_statement(self, start: int, end: int) -> tuple[int, int]:
        """A removed statement takes one semicolon of its line along, the one after it if there is one."""
        broken = lambda a, b: any(c in "\r\n" for c in self.text[a:b])
        after = bisect_left(self.token_starts, end)
        if after < len(self.tokens) and self.tokens[after][1] == ";" and not broken(end, self.tokens[after][2]):
            return start, self.tokens[after][3]
        before = bisect_left(self.token_starts, start) - 1
        if before >= 0 and self.tokens[before][1] == ";" and not broken(self.tokens[before][3], start):
            return self.tokens[before][2], end
        return start, end

    def _docstring(self, body: list[ast.stmt]) -> None:
        if body and isinstance(body[0], ast.Expr) and isinstance(body[0].value, ast.Constant) and isinstance(body[0].value.value, str):
            self.masks.append(self._whole_statement(*self._range(body[0])))

    def _signature(self, start: int, end: int) -> None:
        depth, begin = 0, None
        for at in range(bisect_left(self.token_starts, start), len(self.tokens)):
            kind, string, left, right = self.tokens[at]
            if left >= end:
                return
            if kind == tokenize.NAME and depth == 0 and string in ("async", "def"):
                begin = left if begin is None else begin
            elif kind == tokenize.OP and string in "([{":
                depth += 1
            elif kind == tokenize.OP and string in ")]}":
                depth = max(0, depth - 1)
            elif kind == tokenize.OP and string == ":" and depth == 0 and begin is not None:
                self.masks.append((begin, right))
                return

    def _visit(self, body: list[ast.stmt], scope: str, depth: int) -> None:
        for node in body:
            start, end = self._range(node)
            inner_scope, inner_depth = scope, depth + 1
            if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef)):
                context, own, inner_scope, inner_depth = "declarative", "function", "function", 0
                if self.options.ignore_signatures:
                    self._signature(start, end)
                if self.options.ignore_docstrings:
                    self._docstring(node.body)
            elif isinstance(node, ast.ClassDef):
                context, own, inner_scope, inner_depth = "declarative", "class", "class", 0
                if self.options.ignore_docstrings:
                    self._docstring(node.body)
            else:
                states = isinstance(node, (ast.TypeAlias, ast.Assign, ast.AnnAssign, ast.Import, ast.ImportFrom))
                context, own = "declarative" if states and scope != "function" and depth == 0 else "executable", scope
                if isinstance(node, (ast.Import, ast.ImportFrom)) and self.options.ignore_imports:
                    self.masks.append(self._whole_statement(start, end))
            self.regions.append((start, end, context, own))
            for part in ("body", "orelse", "finalbody"):
                self._visit(getattr(node, part, None) or [], inner_scope, inner_depth)
            for part in (*getattr(node, "handlers", ()), *getattr(node, "cases", ())):
                self._visit(part.body, inner_scope, inner_depth)

    @staticmethod
    def _merged(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
        merged: list[tuple[int, int]] = []
        for start, end in sorted(ranges):
            if merged and start <= merged[-1][1]:
                merged[-1] = (merged[-1][0], max(end, merged[-1][1]))
            else:
                merged.append((start, end))
        return merged


def _left_over(start: int, end: int, masks: list[tuple[int, int]], ends: list[int]) -> list[tuple[int, int]]:
    """What masks leave of a line."""
    kept, at = [], start
    for a, b in masks[bisect_right(ends, start) :]:
        if a >= end:
            break
        if at < a:
            kept.append((at, a))
        at = max(at, b)
    if at < end:
        kept.append((at, end))
    return kept


def _classified(text: str, kept: list[tuple[int, int]], regions: list[tuple[int, int, str, str]]) -> tuple[str, str]:
    """Context and scope of a line: of each piece, those of the shortest region around it."""
    context = scope = None
    for start, end in kept:
        over = [r for r in regions if r[0] < end and r[1] > start]
        cuts = sorted({start, end, *(max(r[0], start) for r in over), *(min(r[1], end) for r in over)})
        for a, b in zip(cuts, cuts[1:], strict=False):
            if not text[a:b].strip(_BLANK):
                continue
            around = min((r for r in over if r[0] <= a and r[1] >= b), key=lambda r: r[1] - r[0], default=(0, 0, "executable", "module"))
            context = around[2] if context in (None, around[2]) else "mixed"
            scope = around[3] if scope is None or SCOPE_RANK[around[3]] > SCOPE_RANK[scope] else scope
    return context or "executable", scope or "module"


@dataclass(frozen=True)
class Line:
    nline: int
    segment_id: int
    source_line: int
    text: str
    effective: bool
    context: str
    scope: str


def prepare(source: str, options: NormalizationOptions | None = None, directive: str = "echoline") -> list[Line]:
    """The normalized lines of a Python source; raises SourceError where it doesn't parse.

    One leading byte order mark is dropped. Lines end at line feeds; a carriage return before one belongs
    to it. A comment '# <directive>: disable' (or enable) takes effect after its own line and is never
    compared; each disable that takes effect ends a segment.
    """
    source = source.removeprefix("﻿")
    found = _Analysis(source, options or NormalizationOptions(), directive)
    mask_ends = [b for _, b in found.masks]
    lines: list[Line] = []
    regions, active, begun = found.regions, [], 0
    disabled, segment, fresh, event = False, -1, True, 0
    start = 0
    for number, raw in enumerate(source.split("\n")):
        end = start + len(raw.removesuffix("\r"))
        active = [r for r in active if r[1] > start]
        while begun < len(regions) and regions[begun][0] < end:
            if regions[begun][1] > start:
                active.append(regions[begun])
            begun += 1
        if not disabled:
            kept = _left_over(start, end, found.masks, mask_ends)
            text = "".join(source[a:b] for a, b in kept).strip(_BLANK)
            if text:
                segment += fresh
                fresh = False
                lines.append(Line(len(lines), segment, number, text, bool(_EFFECTIVE.search(text)), *_classified(source, kept, active)))
        start += len(raw) + 1
        while event < len(found.events) and found.events[event][0] < start:
            if found.events[event][1] == "disable":
                fresh |= not disabled
                disabled = True
            else:
                disabled = False
            event += 1
    return lines


LINE_TYPE = "nline int, segment_id int, source_line int, text string, effective boolean, context string, scope string"
PREPARED_SCHEMA = "file_id bigint, path string, source_lines int, lines array<struct<" + ", ".join(p.replace(" ", ":", 1) for p in LINE_TYPE.split(", ")) + ">>, error struct<kind:string,message:string,line:int,column:int>"


def prepared(files: DataFrame, options: NormalizationOptions | None = None, directive: str = "echoline", option_columns: bool = False) -> DataFrame:
    """One row per file: its lines, or the error that kept it from being prepared.

    files: file_id, path, source and, with option_columns, the four options as columns (null is true). A
    null source is a read error, told by the column problem where files have one.
    """
    base = options or NormalizationOptions()
    names = list(NormalizationOptions.__dataclass_fields__)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            lines, errors, counts = [], [], []
            for row in batch.itertuples(index=False):
                own = NormalizationOptions(**{n: v is None or v is pd.NA or bool(v) for n in names for v in [getattr(row, n)]}) if option_columns else base
                done, error = [], None
                try:
                    if row.source is None:
                        raise SourceError("read", getattr(row, "problem", None) or "no text")
                    done = [vars(x) for x in prepare(row.source, own, directive)]
                except SourceError as e:
                    error = {"kind": e.kind, "message": e.message, "line": e.line, "column": e.column}
                lines.append(done)
                errors.append(error)
                counts.append(source_line_count(row.source or ""))
            yield pd.DataFrame({"file_id": batch["file_id"], "path": batch["path"], "source_lines": counts, "lines": lines, "error": errors})

    wanted = ["file_id", "path", "source", *(c for c in ("problem",) if c in files.columns), *(names if option_columns else [])]
    return spread(files.select(*wanted)).mapInPandas(run, PREPARED_SCHEMA)


def prepared_files(done: DataFrame) -> DataFrame:
    """file_id, path and source_lines of what was prepared."""
    return done.where("error IS NULL").select("file_id", "path", "source_lines")


def prepared_lines(done: DataFrame) -> DataFrame:
    return done.where("error IS NULL").select("file_id", F.inline("lines"))


def preparation_errors(done: DataFrame) -> DataFrame:
    """Files left out and why; the first in path order is the one that a scan that doesn't go on reports."""
    return done.where("error IS NOT NULL").select("file_id", "path", "error.*")
