"""Generated, minified, vendored and data files among collected source files.

Every file is lexed once. Its tokens are written out again in a canonical layout (one statement a line, one
space between words, wrapped at a fixed width), which is compared with the layout as found:
  minified   the canonical layout needs many times the lines, and names are cut to a few letters or the
             expansion is extreme;
  data       literals that are no prose make up nearly all of the code, which does nothing;
  generated  lines, or elements of a line, repeat one shape in strict period;
  vendored   half of the lines stand in published packages; lines of many files, as imports, prove nothing.
The first that holds, in the order minified, data, generated, vendored, is the kind. What content proves to be
vendored then teaches folders: one counts if a lower bound of its share of vendored files is high, in several
projects. Open files in such a folder are vendored, and so are those whose header names one, as packages are
named; they teach the next round. So neither folder names nor phrases are given.
"""

from __future__ import annotations

import keyword
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from echoline.session import Scratch, materialize, spread

TOKEN = re.compile(
    r"""[^\S\n]*(?:(\n)|(\#[^\n]*|//[^\n]*|/\*.*?(?:\*/|\Z))
    |([rbuf]{0,2}(?:\"{3}(?:\\.|[^\\])*?(?:\"{3}|\Z)|'{3}(?:\\.|[^\\])*?(?:'{3}|\Z)|"(?:\\.|[^"\\\n])*"?|'(?:\\.|[^'\\\n])*'?|`(?:\\.|[^`\\])*`?))
    |((?:0[xbo][0-9a-f_]+|\d[\d_]*(?:\.\d*)?(?:e[+-]?\d+)?|\.\d+)[jln]?)
    |([^\W\d]\w*)|(\S))""",
    re.S | re.X | re.I,
)
#: Kinds of tokens, as numbered in TOKEN.
LINE, NOTE, STRING, NUMBER, NAME, SIGN = 1, 2, 3, 4, 5, 6
WORDS = frozenset(keyword.kwlist) | {"function", "var", "let", "const", "new", "typeof", "this"}
CONSTANTS = frozenset({"None", "True", "False"})
#: Words that do nothing by themselves.
IDLE = CONSTANTS | {"not", "const", "var", "let"}
SHAPE_WORDS = WORDS - CONSTANTS
PROSE = re.compile(r"(?:[^\W\d_]{2,}[,.;:!?]?\s+){4,}")
HEADER_WORD = re.compile(r"[^\W\d_]{3,}")
#: Signs that separate values in data.
SEPARATORS = frozenset(",[](){}:-\\")


@dataclass(frozen=True)
class ForeignOptions:
    """Limits of the tests."""

    width: int = 100
    #: lines of the canonical layout for one found, mean length of a name, and the expansion that needs no short names
    minified_lines: float = 4.0
    minified_name: float = 3.0
    minified_extreme: float = 12.0
    minified_chars: int = 200
    data_share: float = 0.6
    data_chars: int = 200
    #: share of the code in strict period, over so many lines at least, with a period of so many at most
    uniform_share: float = 0.3
    uniform_lines: int = 7
    longest_period: int = 12
    #: share of a file's lines that published files have; shorter lines don't count
    known_share: float = 0.5
    line_chars: int = 16
    #: a line in more than this share of all files, and in more than so many, is common property
    common_share: float = 0.01
    common_files: int = 20
    #: folders: lower bound of the share of vendored files, files and projects that show it, rounds of learning
    folder_share: float = 0.3
    folder_files: int = 4
    folder_projects: int = 3
    rounds: int = 3


def periodic(shapes: list, weights: np.ndarray, longest: int, least: int, kinds: int = 1, shortest: int = 1) -> float:
    """The weight of all stretches in which a period of up to `longest` shapes, `kinds` of them different, repeats `least` times or more and over `shortest` shapes."""
    number: dict = {}
    codes = np.array([number.setdefault(x, len(number)) for x in shapes], np.int64)
    if len(codes) < least or len(number) > len(codes) - least + 1:  # too few repeats for any period
        return 0.0
    held = np.zeros(len(codes), bool)
    for period in range(1, min(longest, len(codes) // least) + 1):
        same = np.zeros(len(codes) - period + 2, np.int8)
        same[1:-1] = codes[period:] == codes[:-period]
        edges = np.flatnonzero(np.diff(same))
        for start, end in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
            if end - start + period >= max(least * period, shortest) and len(set(codes[start : start + period].tolist())) >= kinds:
                held[start : end + period] = True
    return float(weights[held].sum())


class Layout:
    """What one pass over the tokens of a file tells."""

    def __init__(self, source: str):
        text = source.replace("\r\n", "\n").replace("\r", "\n").lstrip("\ufeff").rstrip()
        #: per line with code: its indent, kinds and texts of its tokens
        self.lines: list[tuple[int, list[int], list[str]]] = []
        self.header: list[str] = []
        kinds: list[int] = []
        texts: list[str] = []
        indent = 0
        for m in TOKEN.finditer(text):
            kind = m.lastindex
            if kind == LINE:
                if kinds:
                    self.lines.append((indent, kinds, texts))
                    kinds, texts = [], []
                continue
            token = m[kind]
            if kind == NOTE or kind == STRING and not kinds and token.lstrip("rbufRBUF")[:3] in ('"""', "'''"):
                if not self.lines and not kinds:
                    self.header.append(token)  # a docstring is a note as well
                continue
            if not kinds:
                indent = m.start(kind) - m.start()
            kinds.append(kind)
            texts.append(token)
        if kinds:
            self.lines.append((indent, kinds, texts))
        self.chars = sum(len(t) for _, _, texts in self.lines for t in texts)

    def canonical(self, width: int) -> list[str]:
        """The code in canonical layout: one statement a line, wrapped at `width`, a token never split."""
        out = []
        for _, kinds, texts in self.lines:
            depth, own = 0, []
            for kind, text in zip(kinds, texts, strict=True):
                if kind == SIGN:
                    if text in "([":
                        depth += 1
                    elif text in ")]":
                        depth -= 1
                    elif text == ";" or text in "{}" and depth <= 0:
                        if own:
                            out.extend(_wrapped(own, width))
                            own = []
                        continue
                elif own and own[-1][-1:].isalnum():
                    own.append(" ")
                own.append(text)
            if own:
                out.extend(_wrapped(own, width))
        return out

    def expansion(self, width: int, least: float) -> float:
        """Lines of the canonical layout for each found; 0 where it can't reach `least`, which needs no layout to be seen.

        A statement ends at a line's end or at one of three signs, and of its wrapped parts any two neighbours
        exceed the width, spaces between words, at most one a character, included.
        """
        n = max(1, len(self.lines))
        signs = sum(texts.count(c) for _, _, texts in self.lines for c in ";{}")
        return len(self.canonical(width)) / n if n + signs + 4 * self.chars / width >= least * n else 0.0

    def data(self) -> int:
        """Characters of literals that are no prose."""
        return sum(len(t) for _, kinds, texts in self.lines for k, t in zip(kinds, texts, strict=True) if k == NUMBER or k == STRING and not PROSE.search(t))

    def name_length(self) -> float:
        lengths = [len(t) for _, kinds, texts in self.lines for k, t in zip(kinds, texts, strict=True) if k == NAME and t not in WORDS]
        return sum(lengths) / len(lengths) if lengths else 0.0

    def acts(self) -> bool:
        """Whether any token does something: a call, or a word of control flow or definition."""
        for _, kinds, texts in self.lines:
            if texts[0] in ("import", "from"):
                continue
            for i, (kind, text) in enumerate(zip(kinds, texts, strict=True)):
                if kind == NAME and (text not in IDLE if text in WORDS else texts[i + 1 : i + 2] == ["("]):
                    return True
        return False

    def uniform(self, options: ForeignOptions) -> float:
        """The share of the code that keeps one shape in strict period, line by line or within a line."""
        shapes, weights, inner = [], [], 0.0
        for indent, kinds, texts in self.lines:
            own = [t if k == SIGN or t in SHAPE_WORDS else k for k, t in zip(kinds, texts, strict=True) if t != "-"]
            shapes.append((indent, *own))
            weights.append(sum(map(len, texts)))
            if len(own) > 60:
                lengths = np.array([len(t) for t in texts if t != "-"], float)
                inner += periodic(own, lengths, 60, 4, kinds=4)  # a plain list of numbers has two
        lined = periodic(shapes, np.array(weights, float), options.longest_period, 4, shortest=options.uniform_lines)
        return max(lined, inner) / max(1, self.chars)

    def line_digests(self, least: int) -> list[int]:
        """Digests of the lines' tokens, without spaces, letter case, comments and styles of quotes."""
        found = set()
        for _, kinds, texts in self.lines:
            text = "".join([" ".join(t.lstrip("rbufRBUF").strip("\"'`").split()) if k == STRING else t for k, t in zip(kinds, texts, strict=True)]).lower().rstrip(";")
            if len(text) >= least:
                found.add(xxhash.xxh64_intdigest(text) - (1 << 63))
        return sorted(found)

    def whole_digest(self) -> int:
        """The digest of all code at once, for files with too few lines to be told by them."""
        return xxhash.xxh64_intdigest("\n".join("".join(texts) for _, _, texts in self.lines)) - (1 << 63)


def _wrapped(own: list[str], width: int) -> list[str]:
    line = "".join(own)
    if len(line) <= width:
        return [line]
    out, part = [], ""
    for token in own:
        if part and len(part) + len(token) > width:
            out.append(part)
            part = token.lstrip(" ")
        else:
            part += token
    return [*out, part] if part else out


def own_kind(source: str | None, options: ForeignOptions) -> tuple[str | None, Layout | None]:
    """The kind that a file's layout shows, if any; and its layout, unless it is empty."""
    if not source or not source.strip():
        return None, None
    layout = Layout(source)
    data = layout.data()
    if layout.chars >= options.minified_chars and data <= options.data_share * layout.chars:
        expansion = layout.expansion(options.width, options.minified_lines)
        if expansion >= options.minified_extreme or expansion >= options.minified_lines and 0 < layout.name_length() <= options.minified_name:
            return "minified", layout
    if data >= options.data_chars:
        signs = sum(k == SIGN and t in SEPARATORS for _, kinds, texts in layout.lines for k, t in zip(kinds, texts, strict=True))
        if data >= options.data_share * (layout.chars - signs) and not layout.acts():
            return "data", layout
    return ("generated" if layout.uniform(options) >= options.uniform_share else None), layout


LEXED_SCHEMA = "id bigint, project string, kind string, digests array<bigint>, marks array<string>"


def _marks(path: str | None, layout: Layout) -> list[str]:
    """Folders of the path, with a slash before, and words of the header."""
    words = {w for note in layout.header for w in HEADER_WORD.findall(note.lower())}
    return sorted({"/" + w.lower() for w in (path or "").split("/")[:-1] if w} | words)


def _lexed(files: DataFrame, options: ForeignOptions) -> DataFrame:
    """files: id, project, path, source."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            kinds, digests, marks = [], [], []
            for path, source in zip(batch["path"], batch["source"], strict=True):
                kind, layout = own_kind(source, options)
                open_ = kind is None and layout is not None
                found = layout.line_digests(options.line_chars) if open_ else []
                kinds.append(kind)
                digests.append(found if len(found) >= 4 or not open_ or not layout.lines else [layout.whole_digest()])
                marks.append(_marks(path, layout) if open_ else [])
            yield pd.DataFrame({"id": batch["id"], "project": batch["project"], "kind": kinds, "digests": digests, "marks": marks})

    return spread(files).mapInPandas(run, LEXED_SCHEMA)


def _lower_bound(hits: str, all_: str) -> Column:
    """Of a share, with 95 % confidence from below (Wilson)."""
    k, n, z = F.col(hits), F.col(all_), 1.64
    p = k / n
    return (p + z * z / (2 * n) - z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n)


def _marked(files: DataFrame, vendored: DataFrame, options: ForeignOptions, scratch: Scratch) -> DataFrame:
    """id of every one of files (id, project, marks) in a folder, or naming one, that holds vendored files far more often than others.

    Folders are counted for each project first, so one that all files lie in reaches the shuffle as one row per
    project and task; those that tell are few and are written before they meet the files.
    """
    told = files.join(vendored.select("id", F.lit(1).alias("hit")), "id", "left").select("project", F.coalesce("hit", F.lit(0)).alias("hit"), F.explode("marks").alias("mark"))
    each = told.where(F.col("mark").startswith("/")).groupBy("mark", "project").agg(F.count("*").alias("n"), F.sum("hit").alias("k"))
    counts = each.groupBy("mark").agg(F.sum("n").alias("n"), F.sum("k").alias("k"), F.count_if(F.col("k") > 0).alias("projects"))
    good = counts.where((F.col("k") >= options.folder_files) & (F.col("projects") >= options.folder_projects) & (_lower_bound("k", "n") >= options.folder_share))
    telling = scratch.write(good.select(F.explode(F.array("mark", F.substr("mark", F.lit(2)))).alias("mark")), "source-folders")
    return files.select("id", F.explode("marks").alias("mark")).join(telling, "mark", "left_semi").select("id").distinct()


def classify(
    files: DataFrame, packages: DataFrame, id_column: str = "file_id", path_column: str = "path", source_column: str = "source", project_column: str = "project", options: ForeignOptions | None = None
) -> DataFrame:
    """id and kind of every file that is generated, minified, vendored or data; hand-written, empty and null files give no row.

    Folders need several files and projects, so a table of few files is told by layout and content alone.

    packages: published files (path and source columns named as in files) that vendored ones may be copies of;
    may be empty. Null projects form one. Repeated rows of one id give a row each.
    """
    options = options or ForeignOptions()
    rows = files.select(F.col(id_column).cast("bigint").alias("id"), F.coalesce(F.col(project_column), F.lit("")).alias("project"), F.col(path_column).alias("path"), F.col(source_column).alias("source"))
    given = packages.select(F.lit(0).cast("bigint").alias("id"), F.lit("").alias("project"), F.col(path_column).alias("path"), F.col(source_column).alias("source"))
    scratch = Scratch()
    with scratch:
        lexed = scratch.write(_lexed(rows, options), "source-lexed")
        published = _lexed(given, options).select(F.explode("digests").alias("digest")).distinct()
        open_files = lexed.where("kind IS NULL AND size(digests) > 0")
        common = max(options.common_files, options.common_share * lexed.count())
        lines = open_files.select("id", F.explode("digests").alias("digest"))
        # of published lines only, how many files have them; then what is common property goes
        known = scratch.write(lines.join(published, "digest", "left_semi").groupBy("digest").agg(F.count("*").alias("n")).where(F.col("n") <= common).select("digest"), "source-known")
        alike = lines.join(known, "digest", "left_semi").groupBy("id").agg(F.count("*").alias("n"))
        proven = open_files.select("id", F.size("digests").alias("lines")).join(alike, "id").where(F.col("n") >= options.known_share * F.col("lines"))
        vendored = scratch.write(proven.select("id").distinct(), "source-proven")
        marks = open_files.select("id", "project", "marks")
        for _ in range(options.rounds):
            vendored = scratch.write(vendored.unionByName(_marked(marks, vendored, options, scratch)).distinct(), "source-vendored")
        rest = open_files.select("id").join(vendored, "id", "left_semi").select("id", F.lit("vendored").alias("kind"))
        return materialize(lexed.where("kind IS NOT NULL").select("id", "kind").unionByName(rest), "source-kinds")
