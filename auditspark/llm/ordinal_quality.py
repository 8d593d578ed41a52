"""Quality grades by ordinal cumulative-link regression on hashed text.

Ratings are grades 0..2: one point for good quality, one for not being toxic. One set of weights over hashed features is
shared by all grades, and ordered thresholds cut the score: P(grade >= k) = 1 / (1 + exp(t_k - w.x)), t_1 < t_2. The
expected grade is the sum of the tail probabilities; a document is kept if its top grade is likelier than not.

Features: distinct lower-case words, the first five letters of longer words, and shapes of the text in steps (capitals, symbols, repeated neighbours, distinct
words, length of words), all hashed to 2^22 places. Places seen in under 1 in 500 sampled documents are dropped, so a
model has at most 500 times the mean number of features of a document. It is fitted in one task on a sample of at
most SAMPLE labelled rows, chosen by a hash of their id; everything else reads all rows.

Defined cases: null and empty texts, and texts without words, have no features: they are graded by the thresholds alone
and never kept; labels that are null or not 0 or 1, or without a document, take no part; rows that share a doc_id
are graded each by its own text; without labels of two grades at least there is no model and every text with words is
kept with null grades; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import operator
import re

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditspark.llm.common import map_batches
from auditspark.session import cut_lineage, ship_package

#: Labelled rows that the model is fitted on, at most.
SAMPLE = 20_000
PLACES = 1 << 22
#: Letters of a word's start.
START = 5
#: A feature must be in this share of the sampled documents.
LEAST_SHARE = 0.002
GRADES = 3
#: and its mean grade so many standard errors off the mean of all, or its weight would be fitted to noise.
SCREEN = 4.0
STEPS, RATE, DECAY = 200, 0.1, 1e-5
#: Words whose weights a task remembers.
CACHE = 500_000

_WORD = re.compile(r"\w+")
_SYMBOL = re.compile(r"[^\w\s.,;:'\"()?-]")


def place(feature: str) -> int:
    return xxhash.xxh32_intdigest(feature) % PLACES


def shapes(text: str, words: list[str]) -> list[str]:
    """Shapes of a text, each as a name and a step; names hold a space, which no word does."""
    parts = text.split()
    n = max(1, len(parts))
    step = lambda share: min(10, int(10 * share + 0.999))  # noqa: E731  0 only for none
    return [f"capitals {step(sum(map(str.isupper, parts)) / n)}", f"symbols {step(len(_SYMBOL.findall(text)) / n)}",
            f"repeats {step(sum(map(operator.eq, parts, parts[1:])) / n)}", f"distinct {step(len(set(parts)) / n)} {min(8, n.bit_length())}",
            f"length {min(20, len(text) // n)}"]


def named(text: str, words: list[str]) -> set[str]:
    """Distinct words, starts of longer words, and shapes."""
    found = set(words)
    found.update([f"{w[:START]} " for w in found if len(w) > START])
    found.update(shapes(text, words))
    return found


def features(text: str | None) -> list[int]:
    """Distinct places of a text's features; none without words."""
    words = _WORD.findall((text or "").lower())
    return sorted({place(x) for x in named(text, words)}) if words else []


def fit(rows: list[np.ndarray], grades: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(places, their weights, thresholds) by full-batch Adam on the mean log-likelihood with weight decay."""
    n, off = len(rows), grades - grades.mean()
    count, told = np.zeros(PLACES, np.int64), np.zeros(PLACES)
    for i in range(0, n, 2000):  # some rows at a time: only what is kept of them stays
        part = rows[i:i + 2000]
        flat = np.concatenate(part)
        count += np.bincount(flat, minlength=PLACES)
        told += np.bincount(flat, np.repeat(off[i:i + 2000], [len(r) for r in part]), PLACES)
    chance = count / n * (1 - count / n) * (off @ off)  # variance of a feature's summed deviation if it told nothing
    kept = (np.abs(told) >= SCREEN * np.sqrt(np.maximum(chance, 1e-12))) & (count >= max(3, LEAST_SHARE * n))
    new, places = np.cumsum(kept) - 1, np.flatnonzero(kept)
    used = [new[r[kept[r]]] for r in rows]
    doc, col = np.repeat(np.arange(n), [len(u) for u in used]), np.concatenate(used)
    share = np.array([np.mean(grades >= k) for k in range(1, GRADES)]).clip(1e-3, 1 - 1e-3)
    params = np.concatenate([np.zeros(len(places)), np.maximum.accumulate(-np.log(share / (1 - share)))])
    k = len(places)
    m, v = np.zeros_like(params), np.zeros_like(params)
    rate = np.full(len(params), RATE)
    for t in range(1, STEPS + 1):
        w, cuts = params[:k], params[k:]
        score = np.bincount(doc, w[col], n)
        tail = np.column_stack([np.ones(n), 1 / (1 + np.exp(np.clip(cuts - score[:, None], -30, 30))), np.zeros(n)])
        here, up = tail[np.arange(n), grades], tail[np.arange(n), grades + 1]
        p = np.maximum(here - up, 1e-9)
        dhere, dup = here * (1 - here) / p, up * (1 - up) / p  # the ends have slope 0
        dscore = -(dhere - dup) / n
        dcuts = np.array([(np.where(grades == j, dhere, 0) - np.where(grades == j - 1, dup, 0)).sum() / n for j in range(1, GRADES)])
        g = np.concatenate([np.bincount(col, dscore[doc], k) + DECAY * w, dcuts])
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        params = params - rate * (1 - t / (STEPS + 1)) * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-6)
        params[k:] = np.maximum.accumulate(params[k:] + 1e-6 * np.arange(GRADES - 1))  # thresholds stay ordered
    return places, params[:k], params[k:]


class Grader(dict):
    """Expected grade and tail probability of a text; remembers the weights of words."""

    def __init__(self, places: np.ndarray, weights: np.ndarray, cuts: np.ndarray):
        super().__init__()
        self.weights, self.cuts = dict(zip(places.tolist(), weights.tolist())), cuts

    def __missing__(self, feature: str) -> tuple[int, float]:
        if len(self) >= CACHE:
            self.clear()
        i = place(feature)
        got = self[feature] = (i, self.weights.get(i, 0.0))
        return got

    def __call__(self, text: str | None) -> tuple[float, float, bool]:
        words = _WORD.findall((text or "").lower())
        found = dict(map(self.__getitem__, named(text, words))) if words else {}  # features of one place count once
        tail = 1 / (1 + np.exp(np.clip(self.cuts - sum(found[i] for i in sorted(found) if found[i]), -30, 30)))
        return float(tail.sum()), float(tail[-1]), bool(words) and tail[-1] >= 0.5


def model(docs: DataFrame, labels: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
    """The model fitted on a sample of labelled documents; its size doesn't depend on the number of rows."""
    valid = labels.where(F.col("quality").isin(0, 1) & F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull())
    rated = valid.select("doc_id", (F.col("quality") + 1 - F.col("toxic")).cast("int").alias("grade"))
    sample = rated.orderBy(F.xxhash64("doc_id"), "doc_id", "grade").limit(SAMPLE)

    def rows(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [np.array(features(t), np.int32).tobytes() for t in batch.column(1).to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(found, pa.binary())], ["id", "grade", "features"])

    rated_docs = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id")  # SAMPLE rows of two numbers
    seen = cut_lineage(map_batches(rated_docs.select("doc_id", "text", "grade"), rows, "id long, grade int, features binary"))
    ship_package(docs.sparkSession)

    def fitted(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["id", "features"])  # the sum's order, and so the model, doesn't depend on the partitions
        if pdf["grade"].nunique() < 2:
            return pd.DataFrame({"places": [], "weights": [], "cuts": []})
        places, weights, cuts = fit([np.frombuffer(x, np.int32) for x in pdf["features"]], pdf["grade"].to_numpy())
        return pd.DataFrame({"places": [places.tobytes()], "weights": [weights.tobytes()], "cuts": [cuts.tobytes()]})

    got = seen.groupBy().applyInPandas(fitted, "places binary, weights binary, cuts binary").first()
    return (np.frombuffer(got[0], np.int64), np.frombuffer(got[1]), np.frombuffer(got[2])) if got else None


def graded(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, expected_grade, tail_probability (of the top grade), keep for every row of *docs*, and the row as `document`."""
    parts = model(docs, labels)
    rows = docs.select("doc_id", "text")
    if parts is None:
        return rows.select("doc_id", F.lit(None).cast("double").alias("expected_grade"), F.lit(None).cast("double").alias("tail_probability"),
                           F.coalesce(F.col("text"), F.lit("")).rlike(r"(?U)\w").alias("keep"))

    def grade(batch: pa.RecordBatch, grader: Grader) -> pa.RecordBatch:
        got = [grader(t) for t in batch.column(1).to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x) for x in zip(*got))], ["doc_id", "expected_grade", "tail_probability", "keep"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_batches(rows, grade, f"doc_id {kind}, expected_grade double, tail_probability double, keep boolean", lambda: Grader(*parts))


def selected(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of *docs* that are kept, with all their columns."""
    parts = model(docs, labels)
    if parts is None:
        return docs.where(F.coalesce(F.col("text"), F.lit("")).rlike(r"(?U)\w"))
    at = docs.columns.index("text")

    def keep(batch: pa.RecordBatch, grader: Grader) -> pa.RecordBatch:
        return batch.filter(pa.array([grader(t)[2] for t in batch.column(at).to_pylist()]))

    return map_batches(docs, keep, docs.schema, lambda: Grader(*parts))
