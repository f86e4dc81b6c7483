"""Toxicity by a weighted lexicon that an Aho-Corasick automaton matches.

Texts are folded first: lower case, accents and look-alike letters of other
scripts to plain letters, digits and signs that stand for letters to these,
everything else to a space.  Entries of the lexicon are folded words or word
beginnings with a weight, and phrases that make a match harmless.  The sum of
the weights of all matches outside such phrases, divided by the root of the
text's length, gives the score.

``learn`` finds lexicon, phrases and calibration from labelled texts: entries
occur in toxic texts more often than chance allows among so many candidates.
An own lexicon can be given instead.

Null and empty texts have no match and get the score of a text without match.
Without labelled texts of both kinds the lexicon is empty and every score is 0.
"""

import math
import re
import unicodedata
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import islice

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trophos.llm.labelled import MAX_LABELLED, held_out, training_rows
from trophos.plans.scratch import Scratch

# Look-alikes in other scripts, and digits and signs used as letters.
# i, l, 1 and | are told apart by nobody, so all of them become i.
HOMOGLYPHS = {
    "а": "a", "в": "b", "е": "e", "ё": "e", "і": "i", "ї": "i", "ј": "j", "к": "k", "м": "m", "н": "h",
    "о": "o", "р": "p", "с": "c", "ѕ": "s", "т": "t", "у": "y", "х": "x", "ԁ": "d", "ԛ": "q", "ԝ": "w",
    "α": "a", "β": "b", "γ": "y", "ε": "e", "η": "n", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p",
    "τ": "t", "υ": "u", "χ": "x", "ω": "w", "ı": "i", "ɑ": "a", "ɡ": "g", "ո": "n", "ս": "u", "օ": "o",
    "0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s", "|": "i", "l": "i",
}

MAX_ENTRIES = 4_096
#: Of the texts that hold an entry, at least so many are toxic.
MIN_SHARE = 0.8
PREFIXES = range(4, 9)
WORDS_SCALE = 100.0


class _Fold(dict):
    """Translation table that is filled as characters occur."""

    def __missing__(self, code: int):
        base = unicodedata.normalize("NFKD", chr(code).lower())
        letters = "".join(
            HOMOGLYPHS.get(c, c if c.isalpha() else " ") for c in base if not unicodedata.combining(c)
        )
        # a mark on its own, or a character without width, is left out
        invisible = unicodedata.category(chr(code)) in ("Mn", "Cf", "Me")
        self[code] = None if invisible else letters or " "
        return self[code]


_FOLD = _Fold()
# 2, 6 and 9 are letters where a run of digits and signs has letters on both sides; elsewhere they are numbers.
_BETWEEN = str.maketrans("269２６９", "zggzgg")
_INSIDE = re.compile(r"(?<=[^\W\d_])[\d@$|\u00AD\u0300-\u036F\u200B-\u200F\u2060\uFEFF]+(?=[^\W\d_])")
_AFTER_WORD = str.maketrans({"@": " ", "$": " ", "|": " "})


def fold(text: str) -> str:
    """Folded words with one space around each."""
    words = text.split()
    if "$" in text or "@" in text or "|" in text:  # as letters only inside or before a word
        words = [w[: len(r)] + w[len(r) :].translate(_AFTER_WORD) for w in words for r in (w.rstrip("@$|.,;:!?"),)]
    text = " ".join(words)
    text = _INSIDE.sub(lambda m: m[0].translate(_BETWEEN), text)
    return f" {' '.join(text.translate(_FOLD).split())} "


@dataclass
class Lexicon:
    """``entries``: weight by " word " or " beginning"; ``exceptions``: " phrases "."""

    entries: dict[str, float] = field(default_factory=dict)
    exceptions: list[str] = field(default_factory=list)
    slope: float = 0.0
    offset: float = 0.0

    def automaton(self):
        found = ahocorasick.Automaton()
        for entry, weight in self.entries.items():
            found.add_word(entry, (len(entry), weight))
        for phrase in self.exceptions:
            found.add_word(phrase, (len(phrase), 0.0))
        found.make_automaton()
        return found


def statistic(folded: str, automaton) -> float:
    """Weight of the matches outside exception phrases, over the root of the length."""
    if not len(automaton):
        return 0.0
    matches = [(end - n + 1, end, w) for end, (n, w) in automaton.iter(folded)]
    if not matches:
        return 0.0
    excused = [(a, b) for a, b, w in matches if w == 0]
    total = sum(w for a, b, w in matches if w and not any(x <= a and b <= y for x, y in excused))
    return total / math.sqrt(1 + (folded.count(" ") - 1) / WORDS_SCALE)


def scorer(lexicon: Lexicon):
    """Function of a text column: the score, 0 to 1.

    Not by Arrow, whose batches are of 10,000 rows: their texts would be held
    several times over, in the executor and its worker, by each task.  A row of
    a plain function goes with at most 99 others.
    """
    ready = []

    def score(text: str | None) -> float:
        if not ready:
            ready.append(lexicon.automaton())
        raw = 0.0 if text is None else statistic(fold(text), ready[0])
        return float(_probability(lexicon, np.array([raw]))[0])

    return F.udf(score, "double", useArrow=False)


def _probability(lexicon: Lexicon, raw: np.ndarray) -> np.ndarray:
    if not lexicon.entries:
        return np.zeros(len(raw))
    return 1 / (1 + np.exp(-(lexicon.slope * np.log1p(raw) + lexicon.offset)))


# --- learning ---------------------------------------------------------------


#: Terms that a task counts before it passes them on.
COUNTED = 500_000


def _counted(batches: Iterator[pa.RecordBatch], found_in) -> Iterator[pa.RecordBatch]:
    """(term, toxic, clean): texts of each label with a term, added up within the task."""
    counts: dict[str, list[int]] = defaultdict(lambda: [0, 0])
    for batch in batches:
        for text, label in zip(batch["text"].to_pylist(), batch["label"].to_pylist()):
            for term in found_in(fold(text or "")):
                counts[term][label <= 0] += 1
            if len(counts) > COUNTED:
                yield from _passed_on(counts)
                counts.clear()
    yield from _passed_on(counts)


def _passed_on(counts: dict[str, list[int]], rows: int = 50_000) -> Iterator[pa.RecordBatch]:
    items = iter(counts.items())
    while part := list(islice(items, rows)):
        terms, both = zip(*part)
        columns = [pa.array(terms, pa.string()), *(pa.array(n, pa.int64()) for n in zip(*both))]
        yield pa.RecordBatch.from_arrays(columns, ["term", "toxic", "clean"])


def _count(rows: DataFrame, found_in) -> DataFrame:
    found = rows.mapInArrow(lambda batches: _counted(batches, found_in), "term string, toxic long, clean long")
    return found.groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def _words_and_beginnings(folded: str) -> set[str]:
    words = set(folded.split())
    return {f" {w} " for w in words} | {f" {w[:n]}" for w in words for n in PREFIXES if len(w) > n}


def _choose(rows: list, toxic: int, clean: int) -> dict[str, float]:
    """Whole words, and beginnings that stand for several words."""
    by_word = {r["term"]: r["toxic"] for r in rows if r["term"].endswith(" ")}
    most: Counter = Counter()
    for word, n in by_word.items():
        for k in PREFIXES:
            most[word[: k + 1]] = max(most[word[: k + 1]], n)
    starts = [r for r in rows if not r["term"].endswith(" ") and r["toxic"] > 1.2 * most[r["term"]]]
    kept: list[str] = []
    weights = {}
    for r in sorted(starts, key=lambda r: (-r["toxic"], -len(r["term"]), r["term"])):
        if not any(r["term"].startswith(k) or k.startswith(r["term"]) for k in kept):
            kept.append(r["term"])
            weights[r["term"]] = _weight(r, toxic, clean)
    for r in rows:
        if r["term"].endswith(" ") and not any(r["term"].startswith(k) for k in kept):
            weights[r["term"]] = _weight(r, toxic, clean)
    return weights


def _weight(row, toxic: int, clean: int) -> float:
    return math.log((row["toxic"] + 0.5) / (toxic + 1)) - math.log((row["clean"] + 0.5) / (clean + 1))


def _phrases(lexicon: Lexicon):
    """Function of a folded text: its matches with the word before, and with the word after."""
    ready = []

    def find(folded: str) -> set[str]:
        if not ready:
            ready.append(lexicon.automaton())
        found = set()
        for end, (n, _) in ready[0].iter(folded):
            start, stop = end - n + 1, folded.index(" ", end)
            found.add(folded[folded.rfind(" ", 0, start) if start else 0 : stop + 1])
            found.add(folded[start : (folded.find(" ", stop + 1) + 1 or len(folded))])
        return found

    return find


def _calibrate(raw: np.ndarray, label: np.ndarray) -> tuple[float, float]:
    """Logistic regression on log1p(raw), by Newton steps with a small ridge."""
    x = np.column_stack([np.log1p(raw), np.ones(len(raw))])
    beta = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        step = np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + 0.01 * np.eye(2), x.T @ (label - p) - 0.01 * beta)
        beta += np.clip(step, -2, 2)
    return max(0.0, float(beta[0])), float(beta[1])


def learn(rows: DataFrame, max_entries: int = MAX_ENTRIES) -> Lexicon:
    """Lexicon from (text, label); the rows are read a few times, so write them first.

    What comes to the driver is bounded: at most ``max_entries`` entries, as
    many phrases, and for the calibration a count by statistic and label, the
    statistic rounded to 1/50 below 40.
    """
    totals = {bool(r["k"]): r["n"] for r in rows.groupBy((F.col("label") > 0).alias("k")).agg(F.count("*").alias("n")).collect()}
    toxic, clean = totals.get(True, 0), totals.get(False, 0)
    if not toxic or not clean:
        return Lexicon()
    terms = Scratch(rows.sparkSession).keep(_count(rows, _words_and_beginnings).where("toxic >= 3"), "terms")
    n, share = F.col("toxic") + F.col("clean"), toxic / (toxic + clean)
    evidence = 2 * (
        F.col("toxic") * F.log(F.col("toxic") / (n * share))
        + F.when(F.col("clean") > 0, F.col("clean") * F.log(F.col("clean") / (n * (1 - share)))).otherwise(0.0)
    )
    needed = 2 * math.log(100 * max(terms.count(), 1))
    strong = (
        terms.withColumn("evidence", evidence)
        .where((F.col("toxic") / n >= max(MIN_SHARE, share)) & (F.col("evidence") >= needed))
        .orderBy(F.desc("evidence"), "term")
        .limit(max_entries)
        .collect()
    )
    lexicon = Lexicon(_choose(strong, toxic, clean))
    if any(r["clean"] for r in strong if r["term"] in lexicon.entries):
        found = _count(rows, _phrases(lexicon)).where("clean >= 3 and toxic = 0")
        found = found.orderBy(F.desc("clean"), "term").limit(max_entries)
        lexicon = Lexicon(lexicon.entries, sorted(r["term"] for r in found.collect()))
    full = lexicon

    def raw(texts: pa.Array) -> pa.Array:
        automaton = full.automaton()
        return pa.array([min(40.0, round(50 * statistic(fold(t.as_py() or ""), automaton)) / 50) for t in texts])

    seen = (
        rows.select(F.arrow_udf(raw, "double")("text").alias("raw"), (F.col("label") > 0).cast("int").alias("label"))
        .groupBy("raw", "label")
        .agg(F.count("*").alias("n"))
        .collect()
    )
    at = np.repeat([r["raw"] for r in seen], [r["n"] for r in seen])
    label = np.repeat([float(r["label"]) for r in seen], [r["n"] for r in seen])
    slope, offset = _calibrate(at, label)
    return Lexicon(lexicon.entries, lexicon.exceptions, slope, offset)


def fit(documents: DataFrame, labels: DataFrame, limit: int = MAX_LABELLED) -> Lexicon:
    """Lexicon from at most ``limit`` labelled documents outside the held-out fold."""
    rows = training_rows(documents, labels, "toxic", limit=limit)
    return learn(Scratch(documents.sparkSession).keep(rows, "toxicity"))


def score(documents: DataFrame, lexicon: Lexicon, text: str = "text") -> Column:
    """Score of each text as a column of ``documents``."""
    return scorer(lexicon)(documents[text])


def score_documents(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per row of ``documents``: doc_id, held_out, score, predicted."""
    lexicon = fit(documents, labels)
    scored = documents.select("doc_id", score(documents, lexicon).alias("score"))
    return scored.select(
        "doc_id",
        held_out(F.col("doc_id"), 5, 0).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )


def reject_toxic(documents: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The documents, all columns, whose score is below ``threshold``."""
    lexicon = fit(documents, labels)
    return documents.where(score(documents, lexicon) < threshold)
