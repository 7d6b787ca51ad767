"""Toxicity severity by cumulative-link (proportional odds) regression.

Grades are ordered: 0 for clean rows; the labels give no severity themselves, so
a labelled toxic row has grade 1 to ``GRADES - 1`` by its dose, the number of
its words that mark toxic rows in the other half of the sample: what a row's
grade rests on comes from rows that it isn't among.  One weight vector is shared
by all thresholds: P(grade > k) = logistic(w.x - theta_k) with theta increasing,
and the expected severity is the sum of these over k.

Features are words and their prefixes (sparse, log of a count).  The vocabulary
is chosen on the labelled sample by one Spark aggregation; only the ``FEATURES``
strongest and the sample's sparse rows reach the driver.  The fit takes at most
``LABELLED`` labelled rows, chosen by a hash, one per id; scoring reads every
row's whole text.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, texts_of

#: Bound of the labelled sample.
LABELLED = 8000
#: Bound of the vocabulary.
FEATURES = 600
GRADES = 4
PREFIXES = (4, 5, 6, 7)
MIN_DOCS = 4
#: Times that a term must be more frequent in toxic rows than in others.
LIFT = 3
FALSE_ALARM = 5
WORD = re.compile(r"[^\W\d_]+")


def forms(word: str) -> list[str]:
    """The terms of a word: itself and its prefixes, with a hyphen."""
    return [word, *(word[:k] + "-" for k in PREFIXES if len(word) > k)]


def terms(text: str | None) -> Counter:
    """Counts of the terms of a text."""
    out: Counter = Counter()
    for word, n in Counter(WORD.findall((text or "").lower())).items():
        for t in forms(word):
            out[t] += n
    return out


def dose(text: str | None, marking: frozenset) -> int:
    """Number of a text's words that have a marking term."""
    words = Counter(WORD.findall((text or "").lower()))
    return sum(n for w, n in words.items() if any(t in marking for t in forms(w)))


def labelled_sample(docs: DataFrame, labels: DataFrame, rows: int = LABELLED) -> DataFrame:
    """At most ``rows`` labelled documents: text, toxic (0/1) and half (0/1).

    Null ids and labels are left out, of several labels of an id the greatest
    counts, of several texts the one with the least hash.
    """
    chosen = labels.where("doc_id is not null and toxic is not null").select("doc_id", F.col("toxic").cast("int").alias("toxic"))
    chosen = chosen.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    # The sample is bounded by ``rows``, so it may be sent to every executor.
    found = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    found = found.groupBy("doc_id").agg(F.min_by("text", F.xxhash64("text")).alias("text"), F.max("toxic").alias("toxic"))
    return found.select("text", "toxic", F.pmod(F.xxhash64("text", F.lit(1)), F.lit(2)).cast("int").alias("half"))


def vocabulary(sample: DataFrame, size: int = FEATURES) -> list[list[str]]:
    """The terms that mark toxic rows most (more frequent there, and by more than chance would have it): of each half of the sample, and of all.

    Null texts have no terms; a part without toxic, or without clean rows gives none.
    """

    def run(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                counts: dict[str, list[int]] = {}
                for text, toxic, half in zip(*(part.column(i).to_pylist() for i in range(3)), strict=True):
                    for t in terms(text):
                        c = counts.setdefault(t, [0] * 4)
                        c[2 * half + (toxic > 0)] += 1
                cols = [pa.array([c[k] for c in counts.values()], pa.int64()) for k in range(4)]
                yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), *cols], names=["term", "c0", "t0", "c1", "t1"])

    totals = {(r.half, r.toxic): r.n for r in sample.groupBy("half", (F.col("toxic") > 0).cast("int").alias("toxic")).agg(F.count(F.lit(1)).alias("n")).collect()}
    by = sample.select("text", "toxic", "half").mapInArrow(run, "term string, c0 bigint, t0 bigint, c1 bigint, t1 bigint").groupBy("term").agg(*(F.sum(c).alias(c) for c in ("c0", "t0", "c1", "t1")))
    by, out = cut(by), []
    for halves in ((0,), (1,), (0, 1)):
        pos, neg = (sum(totals.get((h, t), 0) for h in halves) for t in (1, 0))
        if not pos or not neg:
            out.append([])
            continue
        toxic, clean = (sum((F.col(f"{k}{h}") for h in halves), F.lit(0)) for k in "tc")
        n, rate, base = pos + neg, toxic / pos, clean / neg
        rare = toxic + clean < max(MIN_DOCS, n // 1000)
        best = by.where(~rare & (rate > LIFT * base)).orderBy(((rate - base) / F.sqrt((toxic + clean + 1.0) / n)).desc(), "term").limit(size)
        out.append([r.term for r in best.select("term").collect()])
    return out


class Model:
    """Weights by term, thresholds; ``terms`` in a fixed order."""

    def __init__(self, names: list[str], weights, thresholds, cut: float = 0.5):
        self.weights = {t: float(w) for t, w in zip(names, weights, strict=True) if abs(w) > 1e-3}
        self.thresholds = [float(t) for t in thresholds]
        self.cut = cut
        self.known: dict[str, tuple[str, ...]] = {}

    def score(self, text: str | None) -> float:
        counts: Counter = Counter()
        for word, n in Counter(WORD.findall((text or "").lower())).items():
            hits = self.known.get(word)
            if hits is None:
                hits = tuple(t for t in forms(word) if t in self.weights)
                if len(self.known) < 200_000:
                    self.known[word] = hits
            for t in hits:
                counts[t] += n
        return sum(self.weights[t] * np.log1p(n) for t, n in counts.items())

    def above(self, text: str | None) -> list[float]:
        """P(grade > k) for every threshold."""
        s = self.score(text)
        return [float(1 / (1 + np.exp(np.clip(t - s, -500, 500)))) for t in self.thresholds]


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def _loss(z, y, theta):
    edges = np.r_[-np.inf, theta, np.inf]
    mass = _sigmoid(z - edges[y]) - _sigmoid(z - edges[y + 1])
    return -np.log(np.maximum(mass, 1e-12)).mean()


def _thresholds(z, y, p):
    """Newton steps on the first threshold and the logarithms of the gaps, by differences; z stays."""

    def theta(q):
        return q[0] + np.r_[0.0, np.cumsum(np.exp(q[1:]))]

    n, step = len(p), 1e-3
    for _ in range(3):
        e = np.eye(n) * step
        here = _loss(z, y, theta(p))
        up, down = ([_loss(z, y, theta(p + s * d)) for d in e] for s in (1, -1))
        grad = (np.array(up) - down) / (2 * step)
        curve = np.maximum((np.array(up) + down - 2 * here) / step**2, 1e-3)
        size = 1.0
        while size > 1e-3 and _loss(z, y, theta(p - size * grad / curve)) > here:
            size /= 2
        p = p - size * grad / curve if size > 1e-3 else p
    return p, theta(p)


def fit(names: list[str], rows: list[tuple[list[int], list[int], int, int]], grades: int = GRADES, ridge: float = 0.5, rounds: int = 12) -> Model:
    """Ridge-penalised maximum likelihood: Newton steps on the shared weights, then on the thresholds.

    ``rows``: (term indexes, counts, toxic, dose).  For a grade between
    thresholds a and b the log likelihood is log(s(z-a) - s(z-b)), whose slope in
    z is 1 - s(z-a) - s(z-b).
    """
    if not names or not rows:
        return Model([], np.zeros(0), np.full(grades - 1, 20.0) + np.arange(grades - 1))
    x = np.zeros((len(rows), len(names)), np.float32)
    for i, (at, n, *_) in enumerate(rows):
        x[i, at] = np.log1p(n)
    toxic = np.array([t > 0 for _, _, t, _ in rows])
    doses = np.array([d for *_, d in rows])
    bounds = np.quantile(doses[toxic], np.arange(1, grades - 1) / (grades - 1))
    y = np.where(toxic, 1 + np.searchsorted(bounds, doses), 0)
    w, p = np.zeros(len(names)), np.r_[-np.log(toxic.mean() / (1 - toxic.mean())), np.zeros(grades - 2)]
    p, theta = _thresholds(np.zeros(len(y)), y, p)

    def total(w, theta):
        return len(y) * _loss(x @ w, y, theta) + ridge / 2 * w @ w

    for _ in range(rounds):
        edges = np.r_[-np.inf, theta, np.inf]
        z = x @ w
        a, b = _sigmoid(z - edges[y]), _sigmoid(z - edges[y + 1])
        grad = -(x.T @ (1 - a - b).astype(np.float32)) + ridge * w
        curve = (a * (1 - a) + b * (1 - b)).astype(np.float32)
        hessian = (x.T @ (x * curve[:, None])).astype(float) + ridge * np.eye(len(w))
        step, size, here = np.linalg.solve(hessian, grad), 1.0, total(w, theta)
        while size > 1e-3 and total(w - size * step, theta) > here:
            size /= 2
        w = w - size * step
        p, theta = _thresholds(x @ w, y, p)
    # The flag's cut on P(grade > 0) loses least on the sample, a clean row flagged counting as FALSE_ALARM toxic ones missed.
    order = np.argsort(-(x @ w), kind="stable")
    first = _sigmoid((x @ w)[order] - theta[0])
    gain = np.cumsum(np.where(toxic[order], 1.0, -FALSE_ALARM))
    gain[:-1][first[1:] == first[:-1]] = -np.inf  # rows of one score stay together
    at = int(np.argmax(gain))
    cut = (first[at] + first[at + 1]) / 2 if at + 1 < len(first) else first[at]
    return Model(names, w, theta, float(min(cut, 0.5)))


def train(docs: DataFrame, labels: DataFrame, rows: int = LABELLED, size: int = FEATURES) -> Model:
    """The model of a labelled sample; without toxic or without clean rows one that flags nothing."""
    sample = cut(labelled_sample(docs, labels, rows))
    *halves, names = vocabulary(sample, size)
    index, others = {t: i for i, t in enumerate(names)}, [frozenset(halves[1]), frozenset(halves[0])]

    def run(batches):
        for batch in batches:
            ats, ns, doses = [], [], []
            for text, half in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                hit = {index[t]: n for t, n in terms(text).items() if t in index}
                ats.append(list(hit))
                ns.append(list(hit.values()))
                doses.append(dose(text, others[half]))
            cols = [pa.array(ats, pa.list_(pa.int32())), pa.array(ns, pa.list_(pa.int32())), batch.column(1), pa.array(doses, pa.int64())]
            yield pa.RecordBatch.from_arrays(cols, names=["at", "n", "toxic", "dose"])

    sparse = sample.mapInArrow(run, "at array<int>, n array<int>, toxic int, dose bigint").collect()
    return fit(names, sorted((list(r.at), list(r.n), r.toxic, r.dose) for r in sparse))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, expected_severity, severity (thresholds more likely than not exceeded) and toxic (P(grade > 0) reaches the model's cut).

    Null and empty texts score as texts without features; repeated rows repeat; other columns are not read.
    """
    # Plain values, as executors may have no copy of this module.
    sent = docs.sparkSession.sparkContext.broadcast((list(model.weights), list(model.weights.values()), model.thresholds, model.cut))

    def run(batches):
        m = Model(*sent.value)
        for batch in batches:
            above = [m.above(t) for t in texts_of(batch.column(1))]
            cols = [pa.array([sum(a) for a in above], pa.float64()), pa.array([sum(p >= 0.5 for p in a) for a in above], pa.int32()), pa.array([a[0] >= m.cut for a in above], pa.bool_())]
            yield pa.RecordBatch.from_arrays([batch.column(0), *cols], names=["doc_id", "expected_severity", "severity", "toxic"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, expected_severity double, severity int, toxic boolean")
