"""Documents whose fields drift from file to file: one consistent table, and every change.

1. Each file's schema (names and JSON types, two levels deep) is read in parallel where the file lies.
2. Names that stand for the same field are brought together: by spelling, and by evidence of the whole
   corpus, namely that a name never stands beside the field it replaces.
3. The types of a field over all files are folded through a promotion lattice to the type that holds them.
4. The schemas of a feed are folded in order and each difference is reported. A feed is folded in blocks:
   every block is first reduced to what it does to the state that enters it, these summaries are chained,
   and then all blocks report side by side, so a feed with a third of all files is not one task's work.
"""

from __future__ import annotations

import json
import math
import re
from collections.abc import Iterator
from decimal import Decimal
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from echoline.session import materialize, spread

#: Run numbers of one block of a feed, and so the most files of one.
BLOCK_RUNS = 512

#: JSON types and, for each, those it is promoted to, nearest first (fixed values). null is below all.
PROMOTION = {
    "boolean": ("string",),
    "integer": ("number", "string"),
    "number": ("string",),
    "string": (),
    "list": ("string",),
    "object": ("string",),
}
SPARK_TYPES = {"boolean": "boolean", "integer": "bigint", "number": "double", "string": "string", "list": "string", "object": "string"}

SIGNATURE_SCHEMA = "feed string, run_no int, received_at timestamp_ntz, delivery_id bigint, fields string, items string"


def promote(a: str | None, b: str | None) -> str | None:
    """The least type that holds values of both; null (None) is held by all."""
    if a is None or b is None or a == b:
        return a or b
    return next(t for t in (a, *PROMOTION[a]) if t in (b, *PROMOTION[b]))


def json_type(value: object) -> str | None:
    if value is None:
        return None
    if isinstance(value, bool):
        return "boolean"
    return {int: "integer", float: "number", str: "string", list: "list", dict: "object"}[type(value)]


def _no_constant(name: str) -> None:
    raise ValueError(name)


def read_document(payload: str | None) -> dict | None:
    """The JSON object in payload, or None; NaN and infinities are no JSON."""
    try:
        value = json.loads(payload, parse_constant=_no_constant) if payload else None
    except (ValueError, RecursionError):
        return None
    return value if isinstance(value, dict) else None


def elements(value: object) -> list[dict]:
    """The elements of a repeated field, whatever form it takes: a list, an object of them, or a single one."""
    if isinstance(value, str):
        try:
            value = json.loads(value)
        except ValueError:
            return []
    if isinstance(value, dict):
        value = list(value.values()) if value and all(isinstance(x, dict) for x in value.values()) else [value] if value else []
    return [x for x in value if isinstance(x, dict)] if isinstance(value, list) else []


def squash(name: str) -> str:
    return re.sub(r"[^0-9a-z]", "", name.lower())


def _words(name: str) -> list[str]:
    return re.findall(r"[a-z0-9]+", re.sub(r"(?<=[a-z0-9])(?=[A-Z])", "_", name).lower())


def likeness(name: str, known: str) -> float:
    """How alike two names are, from 0 to 1: spelling, common words, or an abbreviation."""
    a, b = squash(name), squash(known)
    if a == b:
        return 1.0
    letters = iter(b)
    short = 0.6 if a and a[0] == b[:1] and all(x in letters for x in a) else 0.0
    words, others = _words(name), _words(known)
    same = sum(any(w == o or len(w) > 2 and len(o) > 2 and (o.startswith(w[:4]) or w.startswith(o[:4])) for o in others) for w in words)
    return max(short, 0.9 * same / max(len(words), len(others), 1), 0.9 * SequenceMatcher(None, a, b).ratio())


def signatures(files: DataFrame, payload: str, repeated: str) -> DataFrame:
    """feed, run_no and the schema of each valid file as JSON: fields, and those of the elements of
    `repeated` (null without one) under each of the names that hold elements.

    Of several valid deliveries of one run the first received counts.
    """

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for feed, run, at, delivery, text in zip(batch["feed"], batch["run_no"], batch["received_at"], batch["delivery_id"], batch["payload"], strict=True):
                if (document := read_document(text)) is None:
                    continue
                fields = {k: json_type(v) for k, v in document.items()}
                inner: dict[str, dict[str, str | None]] = {}
                for k, v in document.items():
                    if (isinstance(v, (list, dict)) or isinstance(v, str) and v[:1] in ("[", "{")) and (found := elements(v)):
                        types = inner.setdefault(k, {})
                        for element in found:
                            for name, x in element.items():
                                if types.get(name) is None:
                                    types[name] = json_type(x)
                out.append((feed, run, at, delivery, json.dumps(fields), json.dumps(inner)))
            yield pd.DataFrame(out, columns=["feed", "run_no", "received_at", "delivery_id", "fields", "items"])

    rows = files.select(
        F.col("feed").cast("string").alias("feed"),
        F.col("run_no").cast("int").alias("run_no"),
        F.col("received_at").cast("timestamp_ntz").alias("received_at"),
        F.col("delivery_id").cast("bigint").alias("delivery_id"),
        F.col(payload).alias("payload"),
    ).where("payload IS NOT NULL AND run_no IS NOT NULL")
    first = F.struct(F.coalesce("received_at", F.lit("9999-01-01").cast("timestamp_ntz")), "delivery_id")
    return spread(rows).mapInPandas(read, SIGNATURE_SCHEMA).groupBy("feed", "run_no").agg(F.min_by(F.struct("fields", "items"), first).alias("s")).select("feed", "run_no", "s.*")


class Names:
    """Which field a name stands for, at the top and inside the repeated field.

    A field's own name goes before other spellings of it, and these before the names that evidence brings
    (top and inner: name -> field).
    """

    def __init__(self, known: list[str], repeated: str, top: dict[str, str], inner: dict[str, str]):
        self.known, self.repeated, self.top, self.inner = frozenset(known), repeated, top, inner
        self._top, self._inner = spelled([p for p in known if "." not in p]), spelled([p.partition(".")[2] for p in known if p.startswith(repeated + ".")])

    @staticmethod
    def _of(names, of: dict[str, str], same: dict[str, str]) -> list[tuple[str, str]]:
        """(field, name) of each name, in the order in which names go before others."""
        own = set(same.values())
        pairs = [(n if n in own else same.get(squash(n)) or of.get(n, n), n) for n in names]
        return sorted(pairs, key=lambda p: (p[0] != p[1], p[1]))

    def _bring(self, types: dict[str, str | None], inner: bool = False) -> dict[str, tuple[str, str | None]]:
        """field -> (spelling, type)."""
        found: dict[str, tuple[str, str | None]] = {}
        prefix = self.repeated + "." if inner else ""
        for field, name in self._of(types, *((self.inner, self._inner) if inner else (self.top, self._top))):
            found.setdefault(prefix + field, (name, types[name]))
        return found

    def values(self, document: dict, inner: bool = False) -> dict[str, list]:
        """field -> its values other than null."""
        found: dict[str, list] = {}
        for field, name in self._of(document, *((self.inner, self._inner) if inner else (self.top, self._top))):
            if document[name] is not None:
                found.setdefault(field, []).append(document[name])
        return found

    def fields(self, types: dict[str, str | None]) -> dict[str, tuple[str, str | None]]:
        return self._bring(types)

    def items(self, fields: dict[str, str | None], items: dict[str, dict[str, str | None]]) -> dict[str, tuple[str, str | None]] | None:
        holder = self.fields(fields).get(self.repeated)
        types = items.get(holder[0]) if holder else None
        return self._bring(types, inner=True) if types else None


def spelled(known: list[str]) -> dict[str, str]:
    """Squashed spelling -> field."""
    return {squash(k): k for k in sorted(known)}


def _evidence(maps: DataFrame, known: list[str]) -> dict[str, str]:
    """Name -> known field, from rows (feed, m: name -> type), for names that never stand beside the field they replace.

    All counts and scores stay distributed, however many names there are; only names that replace a field
    come to the driver, and other spellings of a field, which need no evidence, don't.
    """

    @F.pandas_udf("double")
    def alike(name: pd.Series, field: pd.Series) -> pd.Series:
        return pd.Series([likeness(a, b) for a, b in zip(name, field, strict=True)], dtype="float64")

    # which known fields a file lacks, as a text of 0 and 1
    lacks = F.concat(*[F.when(F.map_contains_key("m", F.lit(k)), "0").otherwise("1") for k in known])
    each = maps.select("feed", lacks.alias("lacks"), F.explode("m").alias("name", "type"))
    total = maps.count()
    there, types = dict.fromkeys(known, 0), {k: [] for k in known}
    for r in each.where(F.col("name").isin(known)).groupBy("name", "type").count().collect():  # a row for each known field and JSON type
        there[r["name"]] += r["count"]
        types[r["name"]] += [r["type"]] if r["type"] else []
    rate = {k: -math.log10(min(max((total - there[k]) / max(total, 1), 0.01), 0.99)) for k in known}
    facts = F.array(*[F.struct(F.lit(i + 1).alias("place"), F.lit(k).alias("field"), F.lit(rate[k]).alias("weight"), F.array(*map(F.lit, sorted(types[k]))).cast("array<string>").alias("known_types")) for i, k in enumerate(known)])
    fresh = ~F.col("name").isin(known) & ~F.regexp_replace(F.lower("name"), "[^0-9a-z]", "").isin(list(spelled(known)))
    by_feed = each.where(fresh).groupBy("name", "feed", "lacks").agg(F.count("*").alias("n"), F.collect_set("type").alias("types"))
    names = by_feed.groupBy("name").agg(F.sum("n").alias("n"), F.count_distinct(F.coalesce("feed", F.lit(""))).alias("feeds"), F.array_distinct(F.flatten(F.collect_set("types"))).alias("types"))
    fields = by_feed.groupBy("name", "lacks").agg(F.sum("n").alias("n")).select("name", "lacks", F.col("n").alias("beside"), F.inline(facts)).where(F.substr("lacks", "place", F.lit(1)) == "1")
    pairs = fields.groupBy("name", "field", "weight", "known_types").agg(F.sum("beside").alias("beside")).join(names, "name").where(F.col("beside") >= 0.98 * F.col("n"))
    pairs = pairs.where((F.size("types") == 0) | (F.size("known_types") == 0) | F.arrays_overlap("types", "known_types"))
    weighed = pairs.select("name", "field", alike("name", "field").alias("like"), (F.col("feeds") * F.col("weight")).alias("weight")).where("like >= 0.55 OR weight >= 3")
    score = F.least(F.lit(0.999), F.col("like") + F.least(F.col("weight"), F.lit(30.0)) / 30 * 0.3)
    best = weighed.groupBy("name").agg(F.max(F.struct(score.alias("score"), "field")).alias("best"))
    return {r["name"]: r["field"] for r in best.select("name", "best.field").collect()}


def resolve_names(signed: DataFrame, field_paths: list[str], repeated: str) -> Names:
    """Decide over the whole corpus which names stand for which of field_paths."""
    top = [p for p in field_paths if "." not in p]
    inner = [p.partition(".")[2] for p in field_paths if p.startswith(repeated + ".")]
    schema = "map<string,string>"
    of_top = _evidence(signed.select("feed", F.from_json("fields", schema).alias("m")), top)
    if not inner:
        return Names(field_paths, repeated, of_top, {})
    # in each file, the elements under the name that stands for the repeated field there
    found = F.from_json("items", f"map<string,{schema}>")
    holders = [repeated, *sorted(n for n, k in of_top.items() if k == repeated)]
    other = F.try_element_at(F.map_values(F.map_filter(found, lambda k, _: F.regexp_replace(F.lower(k), "[^0-9a-z]", "") == squash(repeated))), F.lit(1))
    maps = signed.select("feed", F.coalesce(*[found.getItem(h) for h in holders[:1]], other, *[found.getItem(h) for h in holders[1:]]).alias("m")).where("m IS NOT NULL")
    return Names(field_paths, repeated, of_top, _evidence(maps, inner))


State = dict[str, list]


def _step(state: State | None, now: dict[str, tuple[str, str | None]], known: frozenset[str], report) -> State:
    """state after a file with fields `now`; state: field -> [spelling, last type, whether it came in with the block]."""
    if state is None:
        return {f: [spelling, kind, True] for f, (spelling, kind) in now.items()}
    new: State = {}
    for field, (spelling, kind) in now.items():
        before = state.get(field)
        if before is None:
            report(field, "added")
            new[field] = [spelling, kind, False]
            continue
        if before[0] != spelling and field in known:
            report(field, "renamed")
        if kind and before[1] and kind != before[1]:
            report(field, "retyped")
        new[field] = [spelling, kind or before[1], before[2]]
    for field in state.keys() - now.keys():
        report(field, "removed")
    return new


def _chain(into: State | None, through: State | None) -> State | None:
    """The state that leaves a block, from the one that enters it and the block's own."""
    if through is None:
        return into
    return {
        f: [spelling, kind or (into[f][1] if whole and into and f in into else None), False] for f, (spelling, kind, whole) in through.items()
    }


def _summaries(names: Names):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, states = None, [None, None]
        silent = lambda field, kind: None
        row = lambda: pd.DataFrame([(*key, json.dumps(states))], columns=["feed", "block", "state"])
        for batch in batches:
            for feed, block, fields, items in zip(batch["feed"], batch["block"], batch["fields"], batch["items"], strict=True):
                if key != (feed, block):
                    if key:
                        yield row()
                    key, states = (feed, block), [None, None]
                types = json.loads(fields)
                states[0] = _step(states[0], names.fields(types), names.known, silent)
                if inner := names.items(types, json.loads(items)):
                    states[1] = _step(states[1], inner, names.known, silent)
        if key:
            yield row()

    return run


def _carry(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The state that enters each block, from the summaries of its feed in order."""
    feed, states = None, [None, None]
    started = False
    for batch in batches:
        out = []
        for f, block, state in zip(batch["feed"], batch["block"], batch["state"], strict=True):
            if not started or f != feed:
                feed, states, started = f, [None, None], True
            out.append((f, block, json.dumps(states)))
            states = [_chain(a, b) for a, b in zip(states, json.loads(state), strict=True)]
        yield pd.DataFrame(out, columns=["feed", "block", "state"])


def _changes(names: Names):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        states = [None, None]
        for batch in batches:
            out: list[tuple] = []
            for feed, run_no, state, fields, items in zip(batch["feed"], batch["run_no"], batch["state"], batch["fields"], batch["items"], strict=True):
                if state is not None:
                    states = json.loads(state)
                    continue
                report = lambda field, kind: out.append((feed, run_no, field, kind))  # noqa: E731, B023
                types = json.loads(fields)
                states[0] = _step(states[0], names.fields(types), names.known, report)
                if inner := names.items(types, json.loads(items)):
                    states[1] = _step(states[1], inner, names.known, report)
            yield pd.DataFrame(out, columns=["feed", "run_no", "field_path", "change_kind"])

    return run


def changes(signed: DataFrame, names: Names) -> DataFrame:
    """feed, run_no, field_path and change_kind of every change of a file against an earlier one of its feed."""
    blocked = signed.withColumn("block", F.floor(F.col("run_no") / BLOCK_RUNS).cast("int"))
    ordered = blocked.repartition("feed", "block").sortWithinPartitions("feed", "block", "run_no")
    summary = ordered.mapInPandas(_summaries(names), "feed string, block int, state string")
    entering = summary.repartition("feed").sortWithinPartitions("feed", "block").mapInPandas(_carry, "feed string, block int, state string")
    none = lambda kind: F.lit(None).cast(kind)
    heads = entering.select("feed", "block", none("int").alias("run_no"), "state", none("string").alias("fields"), none("string").alias("items"))
    body = blocked.select("feed", "block", "run_no", none("string").alias("state"), "fields", "items")
    rows = heads.unionByName(body).repartition("feed", "block").sortWithinPartitions("feed", "block", F.col("run_no").asc_nulls_first())
    return rows.mapInPandas(_changes(names), "feed string, run_no int, field_path string, change_kind string")


def drift(files: DataFrame, field_paths: list[str], payload: str = "payload", repeated: str = "findings") -> tuple[DataFrame, DataFrame, Names]:
    """The changes, the signatures they come from, and how names were resolved.

    Payloads that are null or no JSON object are passed over. Empty tables give no change; null feeds
    form one feed; files without a run number have no order and are left out.
    """
    signed = materialize(signatures(files, payload, repeated), "drift-signatures")
    names = resolve_names(signed, field_paths, repeated)
    return changes(signed, names), signed, names


def union_schema(files: DataFrame, names: Names, types: dict[str, str], payload: str = "payload") -> dict[str, str]:
    """The fields of `types` with the type that the promotion lattice gives for their values in all files; a field never seen keeps its own.

    Every batch is folded where it lies to a row for each field and type.
    """

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            seen: set[tuple[str, str | None]] = set()
            for document in batch["payload"].map(read_document).dropna():
                given = names.values(document)
                seen.update((f, json_type(x)) for f, values in given.items() for x in values)
                for element in elements(given.get(names.repeated, [None])[0]):
                    seen.update((f"{names.repeated}.{f}", json_type(x)) for f, values in names.values(element, True).items() for x in values)
            yield pd.DataFrame([s for s in seen if s[0] in types], columns=["field_path", "type"])

    found: dict[str, str | None] = {}
    rows = spread(files.select(F.col(payload).alias("payload"))).mapInPandas(read, "field_path string, type string").distinct()
    for r in sorted(rows.collect()):  # a row for each given field and JSON type
        found[r["field_path"]] = promote(found.get(r["field_path"]), r["type"])
    return {p: t if p == names.repeated else found.get(p) or t for p, t in types.items()}


def union_types(signed: DataFrame, names: Names) -> DataFrame:
    """field_path, the types it was seen with, their promotion, and in how many files it stands."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for fields, items in zip(batch["fields"], batch["items"], strict=True):
                types = json.loads(fields)
                both = names.fields(types) | (names.items(types, json.loads(items)) or {})
                out += [(f, kind) for f, (_, kind) in both.items()]
            yield pd.DataFrame(out, columns=["field_path", "type"])

    seen = signed.select("fields", "items").mapInPandas(read, "field_path string, type string")
    held = seen.groupBy("field_path").agg(F.count("*").alias("files"), F.sort_array(F.collect_set("type")).alias("types"))

    @F.pandas_udf("string")
    def fold(types: pd.Series) -> pd.Series:
        def one(found):
            kind = None
            for t in found:
                kind = promote(kind, t)
            return kind

        return types.map(one)

    return held.select("field_path", "files", F.concat_ws(",", "types").alias("types"), fold("types").alias("union_type"))


def _number(value: object, percent: bool) -> int | float | Decimal | None:
    """value, or what its text says, as a number; a text may end in % where the field is in percent."""
    if isinstance(value, str):
        value = Decimal(value.strip().removesuffix("%") if percent else value)
    return value if isinstance(value, (int, float, Decimal)) and math.isfinite(value) else None


def _cast(value: object, kind: str, percent: bool = False) -> object:
    """value as the target type, or None where that type can't hold it."""
    if value is None:
        return None
    try:
        if kind == "integer":
            number = _number(value, percent)
            return int(number) if number is not None and abs(number) < 2**63 and number == int(number) else None
        if kind == "number":
            number = _number(value, percent)
            x = math.nan if number is None else float(number)
            return x if math.isfinite(x) and not (x.is_integer() and x != number) else None
        if kind == "boolean":
            word = value.strip().lower() if isinstance(value, str) else value
            return {"true": True, "1": True, "yes": True, "false": False, "0": False, "no": False, 1: True, 0: False}.get(word) if not isinstance(word, (list, dict)) else None
    except (ValueError, ArithmeticError):
        return None
    return value if isinstance(value, str) else json.dumps(value)


def _in_percent(name: str) -> bool:
    return bool({"percent", "percentage", "pct"} & set(_words(name)))


def _no_elements(value: object) -> list:
    """What elements() passes over in a repeated field."""
    if isinstance(value, str):
        try:
            value = json.loads(text := value)
        except ValueError:
            return [text]
    if isinstance(value, list):
        return [x for x in value if x is not None and not isinstance(x, dict)]
    return [] if value is None or isinstance(value, dict) else [value]


def consistent_table(files: DataFrame, names: Names, types: dict[str, str], payload: str = "payload") -> DataFrame:
    """One row per valid delivery: delivery_id, feed, run_no and the fields of `types` (path -> JSON type), cast.

    The repeated field is an array of structs; lists and objects else are kept as JSON text. Texts such as
    '0.03%' are numbers in fields named as percent. What the types can't hold stands in `unheld` with its
    field_path, the position of its element (from 0, null at the top) and its text, and so does the second
    of two values that one field has under several names. Names that stand for no field of `types` are left out.
    """
    top = {p: t for p, t in types.items() if "." not in p and p != names.repeated}
    inner = {p.partition(".")[2]: t for p, t in types.items() if p.startswith(names.repeated + ".")}
    percent = {p for p in (*top, *inner) if _in_percent(p)}

    def one(document: dict) -> str:
        unheld: list[dict] = []

        def keep(path: str, position: int | None, value: object) -> None:
            unheld.append({"field_path": path, "position": position, "value": value if isinstance(value, str) else json.dumps(value)})

        def fill(values: dict[str, list], kinds: dict[str, str], prefix: str = "", position: int | None = None) -> dict:
            row: dict[str, object] = {}
            for p, t in kinds.items():
                for value in values.get(p, ()):
                    held = _cast(value, t, p in percent)
                    if held is None or row.setdefault(p, held) != held:
                        keep(prefix + p, position, value)
            return row

        given = names.values(document)
        row = fill(given, top)
        for k, value in enumerate(given.get(names.repeated, ()) if inner else ()):
            if k:
                keep(names.repeated, None, value)
                continue
            row[names.repeated] = [fill(names.values(e, True), inner, names.repeated + ".", n) for n, e in enumerate(elements(value))]
            for lost in _no_elements(value):
                keep(names.repeated, None, lost)
        return json.dumps(row | {"unheld": unheld})

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            documents = batch["payload"].map(read_document)
            kept = batch[documents.notna()].drop(columns="payload")
            yield kept.assign(row=[one(d) for d in documents.dropna()])

    columns = [f"`{p}`: {SPARK_TYPES[t]}" for p, t in top.items()]
    if inner:
        columns.append(f"`{names.repeated}`: array<struct<{', '.join(f'`{p}`: {SPARK_TYPES[t]}' for p, t in inner.items())}>>")
    columns.append("unheld: array<struct<field_path: string, position: int, value: string>>")
    rows = files.select("delivery_id", "feed", "run_no", F.col(payload).alias("payload"))
    text = spread(rows).mapInPandas(read, "delivery_id bigint, feed string, run_no int, row string")
    return text.select("delivery_id", "feed", "run_no", F.from_json("row", f"struct<{', '.join(columns)}>").alias("r")).select("delivery_id", "feed", "run_no", "r.*")
