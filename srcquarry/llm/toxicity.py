"""Toxicity (operator 5): cumulative-link ordinal regression on sparse text features.

Features are the distinct words of a text (lower case, punctuation stripped from both ends) and their beginnings of four
to seven characters, hashed to 2^20 numbers.  The model has one weight for each feature, shared by all thresholds, and one
threshold between neighbouring grades: P(grade > k) = sigmoid(w.x - theta_k), theta ascending.  Its likelihood is
maximised with an L1 penalty by proximal gradient steps, after features whose shares among clean and toxic rows hardly
differ have been screened out by a Spark aggregation.  The output is the expected severity, the sum over k of P(grade > k).

Grades.  ``labels`` may hold a graded column; where it holds only toxic 0/1, grade 0 is clean, and toxic rows get 1 to 3 by
how many features of theirs are markers, that is, stand only in toxic rows of the sample.

The classifier is fitted on at most ``sample`` labelled rows, those with the smallest hash of their id; all rows are scored.

Cases: null or empty text has severity of the thresholds alone; without labels of both kinds every severity is 0; repeated
labels of one document count as often as they stand; labels without a document are ignored.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from srcquarry.llm.common import Memo, keyed_text, map_rows, pa_schema, released, slices, stored

SAMPLE = 12_000
BITS = 20
#: Expected severity from which a text counts as toxic; held-out figures are in the tests.
CUT = 0.25
EDGES = re.compile(r"^\W+|\W+$")


def _features(word: str) -> tuple[int, ...]:
    core = EDGES.sub("", word)
    if not core:
        return ()
    forms = {core, *(core[:k] + "*" for k in (4, 5, 6, 7) if len(core) >= k)}
    return tuple(xxhash.xxh32_intdigest(f) & ((1 << BITS) - 1) for f in forms)


class Severity:
    """The fitted model: sparse weights and ascending thresholds."""

    def __init__(self, weights: dict[int, float], thresholds: list[float]):
        self.weights, self.thresholds = weights, np.array(thresholds)
        self.word = Memo(lambda w: tuple(f for f in _features(w) if f in weights), 200_000)

    def __reduce__(self):
        return Severity, (self.weights, list(self.thresholds))

    def expected(self, text: str) -> float:
        some = set().union(*map(self.word.__getitem__, set(text.lower().split())))
        score = sum(self.weights[f] for f in sorted(some))
        return float((1 / (1 + np.exp(self.thresholds - score))).sum())


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def fit(rows: list[np.ndarray], grades: np.ndarray, penalty: float = 0.5, rounds: int = 300) -> Severity:
    """``rows``: the screened feature numbers of each document; ``grades``: 0, 1, ... K."""
    top = int(grades.max()) if len(grades) else 0
    if not top or not (grades == 0).any():
        return Severity({}, [])
    of = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    kept, col = np.unique(np.concatenate(rows).astype(np.int64), return_inverse=True)
    seen = np.maximum(np.bincount(col, minlength=len(kept)), 1)
    n1, n0 = (grades > 0).sum(), (grades == 0).sum()
    # thresholds are kept ascending as a first one and positive gaps
    w, n = np.zeros(len(kept)), len(rows)
    first, gaps = np.log((n0 + 1) / (n1 + 1)), np.full(top - 1, 0.5)
    vw, vf, vg = np.zeros_like(w), 0.0, np.zeros(top - 1)
    step = 4.0 / np.bincount(of, minlength=n).max(initial=1)
    for _ in range(rounds):
        theta = first + np.concatenate([[0.0], np.cumsum(gaps)])
        score = np.bincount(of, w[col], n)
        above = sigmoid(score[:, None] - theta)  # P(grade > k)
        lo = np.concatenate([np.ones((n, 1)), above], 1)[np.arange(n), grades]  # P(grade >= y)
        hi = np.concatenate([above, np.zeros((n, 1))], 1)[np.arange(n), grades]  # P(grade > y)
        p = np.maximum(lo - hi, 1e-9)
        g_score = -(lo * (1 - lo) - hi * (1 - hi)) / p
        g_theta = np.array([((lo * (1 - lo) / p)[grades == k + 1].sum() - (hi * (1 - hi) / p)[grades == k].sum()) for k in range(top)])
        vw = 0.9 * vw - step * np.bincount(col, g_score[of], len(w)) / np.sqrt(seen) / 10
        vf = 0.9 * vf - g_theta.sum() / n
        vg = 0.9 * vg - np.array([g_theta[k:].sum() for k in range(1, top)]) / n
        w = w + vw
        w = np.sign(w) * np.maximum(np.abs(w) - step * penalty / np.sqrt(seen), 0)
        first, gaps = first + vf, np.maximum(gaps + vg, 0.05)
    used = np.flatnonzero(np.abs(w) > 1e-6)
    return Severity({int(kept[i]): round(float(w[i]), 6) for i in used}, list(np.round(first + np.concatenate([[0.0], np.cumsum(gaps)]), 6)))


def grades_of(markers: np.ndarray, toxic: np.ndarray, cuts: tuple[int, ...] = (8, 20)) -> np.ndarray:
    """Grades for 0/1 labels: 1, and one more for each of ``cuts`` that the number of marker features reaches."""
    return np.where(toxic > 0, 1 + sum((markers >= c).astype(int) for c in cuts), 0)


def featured(docs: DataFrame, labels: DataFrame, sample: int, key: str, text: str, grade: str) -> DataFrame:
    """(key, _y, f array<int>): the features of at most ``sample`` labelled rows."""
    chosen = labels.where(F.col(key).isNotNull() & F.col(grade).isNotNull()).select(F.col(key).cast("long").alias(key), F.col(grade).cast("int").alias("_y")).orderBy(F.xxhash64(key), key, "_y").limit(sample)
    texts = keyed_text(docs, key, text).join(F.broadcast(chosen), key)  # at most ``sample`` rows of two numbers
    ddl = f"{key} long, _y int, f array<int>"
    out = pa_schema(docs.sparkSession, ddl)

    def run(batches):
        released()
        memo = Memo(_features, 200_000)
        for b in slices(batches):
            f = [sorted(set().union(*map(memo.__getitem__, set(t.lower().split())))) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(f, out.field(2).type)], schema=out)

    return texts.select(key, text, "_y").mapInArrow(run, ddl)


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, most: int = 4096, key: str = "doc_id", text: str = "text", grade: str = "toxic") -> Severity:
    """Screen the features by the difference of their shares in toxic and clean rows (Spark), then fit the ``most`` best."""
    rows = stored(featured(docs, labels, sample, key, text, grade), "toxic-sample")
    n = rows.agg(F.count("*").alias("n"), F.count_if(F.col("_y") > 0).alias("n1"), F.max("_y").alias("top")).first()
    if not n.n1 or n.n1 == n.n:
        return Severity({}, [])
    share = F.col("d") / n.n
    z = (F.col("d1") / n.n1 - (F.col("d") - F.col("d1")) / (n.n - n.n1)) / F.sqrt(share * (1 - share) * (1 / n.n1 + 1 / (n.n - n.n1)))
    seen = rows.select(F.explode("f").alias("f"), (F.col("_y") > 0).cast("int").alias("y")).groupBy("f").agg(F.count("*").alias("d"), F.sum("y").alias("d1"))
    best = seen.where((F.col("d") >= 4) & (F.col("d") < n.n)).select("f", z.alias("z"), ((F.col("d1") == F.col("d")) & (F.col("d") >= 5)).alias("marker")).where(F.abs("z") >= 5).orderBy(F.abs("z").desc(), "f").limit(most).collect()
    kept, markers = sorted(r.f for r in best), {r.f for r in best if r.marker}
    inside = F.array_intersect("f", F.lit(kept).cast("array<int>")) if kept else F.array().cast("array<int>")
    got = sorted((r[0], r[1], r[2]) for r in rows.select(key, "_y", inside).collect())  # at most ``sample`` short rows
    y = np.array([y for _, y, _ in got], int)
    grades = y if n.top > 1 else grades_of(np.array([sum(f in markers for f in r) for _, _, r in got]), y)
    return fit([np.array(sorted(r), np.int64) for _, _, r in got], np.maximum(grades, 0))


def score(docs: DataFrame, model: Severity, cut: float = CUT, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, severity, toxic): expected severity of every text, and whether it reaches ``cut``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # at most ``most`` weights

    def start():
        released()
        m = shared.value
        return lambda keys, texts: {key: keys, "severity": [round(m.expected(t), 4) for t in texts]}

    return map_rows(keyed_text(docs, key, text), f"{key} long, severity double", start, key, text).withColumn("toxic", F.col("severity") >= cut)


def clean(docs: DataFrame, model: Severity, cut: float = CUT, text: str = "text") -> DataFrame:
    """The rows of ``docs``, whole, whose severity is below ``cut``; a null text is clean."""
    shared, at = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index(text)

    def run(batches):
        released()
        m = shared.value
        for b in slices(batches):
            yield b.filter(pa.array([t is None or m.expected(t) < cut for t in b.column(at).to_pylist()], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
