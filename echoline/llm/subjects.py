"""Subject areas of documents: seeded non-negative factorisation of the document-term matrix.

One component is anchored to each subject, one to the background of each language. Labels of a bounded
sample tell which terms a subject is known by; these seed its component, terms that are spread over all
subjects are kept to the backgrounds, and terms without evidence are open. Then documents' mixtures and
components' terms are updated in turn (multiplicative updates for the Kullback-Leibler divergence), each
over all documents; what co-occurs with a subject's terms joins it, and words of two subjects are told
apart by their company. A document has a subject if enough of its words, and several different ones, fall
to that component: a passing word is too little.

Only sums per term cross the network. The vocabulary holds terms above a share of the documents, so its
size is bounded by words per document over that share, however many documents there are.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from echoline.session import materialize, spread

#: Words, cut at changes of letter case within identifiers.
ASCII_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])", re.A)
WORD = regex.compile(r"\p{Lu}?[\p{Ll}\p{Lo}\p{M}]+|\p{Lu}+(?!\p{Ll})")


@dataclass(frozen=True)
class SubjectOptions:
    """Parameters of the factorisation; the bound on labelled documents is the only sample."""

    max_labelled: int = 50_000
    least_documents: int = 3
    least_share: float = 2e-5
    rounds: int = 3
    inner: int = 8
    #: expected words of a subject, and different words, that a document needs
    words: float = 2.5
    different: int = 2
    #: a term's share among the documents of one language from which it is no subject's own
    common: float = 0.25
    #: documents worked on at once, so few that their entries stay in a core's cache
    block: int = 250


def terms(text: str) -> list[str]:
    """Words of 3 letters or more in lower case, a plural s cut off."""
    found = (ASCII_WORD if text.isascii() else WORD).findall(text)
    low = map(str.lower, found)
    return [w[:-1] if len(w) > 4 and w[-1] == "s" and w[-2] != "s" else w for w in low if len(w) > 2]


def _document_terms(documents: DataFrame, id_column: str, text_column: str, language_column: str | None) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 1000):
                part = batch.slice(start, 1000)
                ends, words, counts = [0], [], []
                for text in part.column("text").to_pylist():
                    held = Counter(terms(text))
                    words.extend(held)
                    counts.extend(held.values())
                    ends.append(len(words))
                offsets = pa.array(ends, pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [part.column("id"), part.column("language"), pa.ListArray.from_arrays(offsets, pa.array(words, pa.string())), pa.ListArray.from_arrays(offsets, pa.array(counts, pa.int32()))],
                    names=["id", "language", "terms", "counts"],
                )

    language = F.coalesce(F.col(language_column).cast("string"), F.lit("")) if language_column else F.lit("")
    rows = documents.select(F.col(id_column).cast("bigint").alias("id"), language.alias("language"), F.col(text_column).alias("text")).where("text IS NOT NULL AND text <> ''")
    return spread(rows).mapInArrow(run, "id bigint, language string, terms array<string>, counts array<int>")


@dataclass
class Factors:
    """The vocabulary and, for each of its terms, the weight of every component; subjects come first."""

    vocabulary: pa.Array
    subjects: list[str]
    weights: np.ndarray


def _vocabulary(matrix: DataFrame, options: SubjectOptions) -> tuple[list[str], np.ndarray, np.ndarray, dict[str, int]]:
    """Terms, their occurrences by language, and the documents they stand in by language."""
    sizes = {r["language"]: r["n"] for r in matrix.groupBy("language").agg(F.count("*").alias("n")).collect()}
    total = sum(sizes.values())
    least = max(options.least_documents, int(np.ceil(options.least_share * total)))
    # languages of a share too small to have a background of their own are put together
    big = sorted(k for k, n in sizes.items() if n >= max(20, 0.005 * total)) or sorted(sizes)[:1]
    group = F.when(F.col("language").isin(big), F.col("language")).otherwise(F.lit(None))
    each = matrix.select(group.alias("language"), F.explode(F.arrays_zip("terms", "counts")).alias("e"))
    by = each.groupBy(F.col("e.terms").alias("term"), "language").agg(F.count("*").alias("documents"), F.sum("e.counts").alias("n"))
    held = by.groupBy("term").agg(F.sum("documents").alias("all"), F.collect_list(F.struct("language", "documents", "n")).alias("by")).where(F.col("all") >= least)
    rows = sorted(held.collect(), key=lambda r: r["term"])
    names = [r["term"] for r in rows]
    places = {k: i for i, k in enumerate(big)} | {None: len(big)}
    occurrences, documents = np.zeros((len(rows), len(places))), np.zeros((len(rows), len(places)))
    for i, r in enumerate(rows):
        for e in r["by"]:
            occurrences[i, places[e["language"]]] = e["n"]
            documents[i, places[e["language"]]] = e["documents"]
    counts = {k: sizes[k] for k in big}
    return names, occurrences, documents, counts


def _label_counts(matrix: DataFrame, labels: DataFrame, subjects: list[str], vocabulary: list[str], options: SubjectOptions) -> tuple[dict[str, np.ndarray], np.ndarray, int]:
    """For each term of the vocabulary the labelled documents it stands in, by subject and in all (last place)."""
    known = labels.select(F.col("doc_id").cast("bigint").alias("id"), F.lower(F.trim("subject")).alias("subject")).where(F.col("subject").isin(subjects)).distinct()
    sample = known.groupBy("id").agg(F.collect_set("subject").alias("subjects")).orderBy(F.xxhash64("id"), "id").limit(options.max_labelled)
    # at most max_labelled rows, so they may be sent to every executor
    labelled = matrix.join(F.broadcast(sample), "id")
    sums = [F.count_if(F.array_contains("subjects", s)).alias(f"s{i}") for i, s in enumerate(subjects)]
    whole = labelled.agg(*sums, F.count("*").alias("n")).first()
    known_terms = matrix.sparkSession.createDataFrame(pa.table({"term": pa.array(vocabulary, pa.string())}))  # as bounded as the vocabulary
    each = labelled.select("subjects", F.explode("terms").alias("term")).groupBy("term").agg(*sums, F.count("*").alias("n"))
    rows = each.join(known_terms, "term", "left_semi").collect()
    return {r["term"]: np.array(r[1:], float) for r in rows}, np.array(whole[:-1], float), whole["n"]


def _seed(matrix: DataFrame, labels: DataFrame, subjects: dict[str, str], options: SubjectOptions) -> Factors:
    names, occurrences, documents, sizes = _vocabulary(matrix, options)
    areas = sorted(subjects)
    by_term, per_subject, n = _label_counts(matrix, labels, areas, names, options)
    labelled = np.array([by_term.get(t, np.zeros(len(areas) + 1)) for t in names]).reshape(len(names), len(areas) + 1)
    for i, area in enumerate(areas):  # a subject's description counts as one more labelled document
        for t in {*terms(area), *terms(subjects[area] or "")}:
            if (at := np.searchsorted(names, t)) < len(names) and names[at] == t:
                labelled[at, i] += 1
                labelled[at, -1] += 1
    prior = (per_subject + 1) / (n + len(areas))
    seen = labelled[:, -1:]
    share = (labelled[:, :-1] + 2 * prior) / (seen + 2)
    telling = (share >= 0.35) & (share >= np.minimum(2 * prior, (1 + prior) / 2)) & (seen >= 2)
    frequency = occurrences.sum(1, keepdims=True) / max(occurrences.sum(), 1)
    anchored = np.where(telling, frequency * share**2, 1e-3 * frequency)
    in_language = documents[:, : len(sizes)] / np.maximum(np.array([list(sizes.values())], float), 1)
    big = np.array(list(sizes.values())) >= 20
    common = (in_language[:, big] >= options.common).any(1) if big.any() else np.zeros(len(names), bool)
    anchored[(seen[:, 0] >= 12) & ~telling.any(1) | common] = 0
    ground = occurrences / np.maximum(occurrences.sum(0, keepdims=True), 1)
    # a term nearly always beside its subjects is an anchor: no background may take it
    held = np.where(telling, share, 0).sum(1)
    ground[(held >= 0.65) & ~common] = 0
    weights = np.concatenate([anchored, ground[:, occurrences.sum(0) > 0]], 1)
    return Factors(pa.array(names, pa.string()), areas, _scaled(weights))


def _scaled(weights: np.ndarray) -> np.ndarray:
    return (weights / np.maximum(weights.sum(0, keepdims=True), 1e-300)).astype(np.float32)


def _blocks(batches: Iterator[pa.RecordBatch], factors: Factors, options: SubjectOptions) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """ids, first entry of each document, and term and count of each entry; documents without a known term are left out."""
    for batch in batches:
        for start in range(0, batch.num_rows, options.block):
            part = batch.slice(start, options.block)
            lists = part.column("terms")
            place = pc.index_in(lists.flatten(), factors.vocabulary)
            known = pc.is_valid(place).to_numpy(zero_copy_only=False)
            sizes = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
            owner = np.repeat(np.arange(len(sizes)), sizes)[known]
            if not len(owner):
                continue
            kept, starts = np.unique(owner, return_index=True)
            count = part.column("counts").flatten().to_numpy()[known].astype(np.float32)
            yield part.column("id").to_numpy()[kept], starts, pc.fill_null(place, 0).to_numpy()[known], count


def _mix(starts: np.ndarray, term: np.ndarray, count: np.ndarray, weights: np.ndarray, rounds: int) -> np.ndarray:
    """For each entry the expected occurrences by component, at the documents' mixtures that fit best."""
    given = weights[term]
    sizes = np.diff(np.append(starts, len(term)))
    mixture = np.full((len(starts), weights.shape[1]), 1.0 / weights.shape[1], np.float32)
    for _ in range(rounds + 1):
        around = np.repeat(mixture, sizes, axis=0)
        scale = count / np.maximum(np.einsum("ij,ij->i", given, around), 1e-30)
        mixture = mixture * np.add.reduceat(given * scale[:, None], starts, axis=0) + 0.01
        mixture /= mixture.sum(1, keepdims=True)
    around *= given
    around *= scale[:, None]
    return around


def _update(matrix: DataFrame, factors: Factors, options: SubjectOptions) -> Factors:
    """New component weights: the expected occurrences of every term, summed over all documents."""
    shared = matrix.sparkSession.sparkContext.broadcast(factors)
    k = factors.weights.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = shared.value
        total = np.zeros(held.weights.shape)
        for _, starts, term, count in _blocks(batches, held, options):
            part = _mix(starts, term, count, held.weights, options.inner)
            for j in range(k):
                total[:, j] += np.bincount(term, part[:, j], len(total))
        rows = np.flatnonzero(total.any(1))
        yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int64()), *[pa.array(total[rows, j]) for j in range(k)]], names=["term", *[f"c{j}" for j in range(k)]])

    sums = matrix.mapInArrow(run, "term bigint, " + ", ".join(f"c{j} double" for j in range(k)))
    rows = sums.groupBy("term").agg(*[F.sum(f"c{j}").alias(f"c{j}") for j in range(k)]).collect()
    new = np.zeros(factors.weights.shape)
    for r in rows:
        new[r["term"]] = r[1:]
    return Factors(factors.vocabulary, factors.subjects, _scaled(new + 1e-9 * (factors.weights > 0)))


def factorise(matrix: DataFrame, labels: DataFrame, subjects: dict[str, str], options: SubjectOptions) -> Factors:
    factors = _seed(matrix, labels, subjects, options)
    for _ in range(options.rounds if len(factors.vocabulary) else 0):
        factors = _update(matrix, factors, options)
    return factors


def subjects_of(
    documents: DataFrame,
    labels: DataFrame,
    areas: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    language_column: str | None = "lang",
    options: SubjectOptions | None = None,
) -> DataFrame:
    """id, subject and words (expected words of the subject) of each subject a document deals with.

    areas: subject and description. labels: doc_id and subject, as loose as hand-made labels are; those of
    unknown subjects count for nothing. Null and empty texts have no subject; repeated ids are treated as
    documents of their own. Without areas or known terms there are no rows.
    """
    options = options or SubjectOptions()
    matrix = materialize(_document_terms(documents, id_column, text_column, language_column), "subject-terms")
    subjects = {r["subject"].strip().lower(): r["description"] for r in areas.where("subject IS NOT NULL").collect()}
    schema = "id bigint, subject string, words double"
    if not subjects:
        return documents.sparkSession.createDataFrame([], schema)
    factors = factorise(matrix, labels, subjects, options)
    if not len(factors.vocabulary):
        return documents.sparkSession.createDataFrame([], schema)
    shared = documents.sparkSession.sparkContext.broadcast(factors)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = shared.value
        n = len(held.subjects)
        names = np.array(held.subjects, dtype=object)
        for ids, starts, term, count in _blocks(batches, held, options):
            part = _mix(starts, term, count, held.weights, options.inner)[:, :n]
            words = np.add.reduceat(part, starts, axis=0)
            different = np.add.reduceat((part > 0.5 * count[:, None]).astype(np.int32), starts, axis=0)
            row, subject = np.nonzero((words >= options.words) & (different >= options.different))
            yield pa.RecordBatch.from_arrays([pa.array(ids[row], pa.int64()), pa.array(names[subject], pa.string()), pa.array(words[row, subject].astype(float))], names=["id", "subject", "words"])

    return matrix.mapInArrow(run, schema)
