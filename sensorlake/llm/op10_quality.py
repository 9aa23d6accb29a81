"""Document quality from a linear-chain conditional random field over lines.

Each line is good or bad. Its potentials come from measures of the line and of
its neighbours; transitions tie neighbouring labels. The field is fitted on a
bounded sample of labelled documents: lines start with their document's label,
then lines of bad documents that look good are relabelled and the field is fitted
again. Forward-backward marginals, weighted by line length, give a document's
share of good text, and a logistic curve fitted on the same sample turns that
into the score.

* null or empty text: one empty line, scored like any other
* null id: not held out, never part of the sample
* no usable labels, or only one kind: every document gets the constant prior of the labels (0.5 without any)
* repeated rows are scored each; of repeated labels the larger counts
* other columns are untouched and may have any name
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sensorlake.llm.common import labelled_sample, map_rows, table

SAMPLE = 3000
#: Documents with more lines are not used for fitting (all are scored whole).
SAMPLE_LINES = 2000
THRESHOLD = 0.3
FOLDS, HELD_OUT = 5, 0

# Classes of bytes.
UPPER, LOWER, DIGIT = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz", b"0123456789"
SYMBOL, MARK, SPACE = b"#$%&*|!<>{}[]=+~^\\_@/", b".,;:?'\"()-", b" \t\r\x0b\x0c"

MEASURES = 10
BINS = 6


def held_out(key: str, folds: int, which: int) -> Column:
    """Whether crc32 of the id as text falls into the held-out remainder."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % folds == which, F.lit(False))


def measures(line: str) -> tuple[float, ...]:
    b = line.encode("utf-8", "surrogatepass")
    n = len(b)
    count = lambda kind: n - len(b.translate(None, kind))
    up, low = count(UPPER), count(LOWER)
    sym, mark, digit, space = count(SYMBOL), count(MARK), count(DIGIT), count(SPACE)
    words = line.split()
    nw = len(words)
    same = sum(map(str.__eq__, words, words[1:]))
    return (
        math.log1p(n) / 8,
        up / (up + low + 1),
        sym / (n + 1),
        digit / (n + 1),
        mark / (n + 1),
        len(set(words)) / nw if nw else 1.0,
        math.log1p(nw) / 6,
        min(3.0, (n - space) / (10 * nw) if nw else 0.0),
        same / nw if nw else 0.0,
        sym / nw if nw else 0.0,
    )


def measure_docs(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(measures of all lines, lines per text, weight of each line)."""
    rows, sizes, weights = [], [], []
    for t in texts:
        lines = (t or "").split("\n")
        sizes.append(len(lines))
        rows.extend(map(measures, lines))
        weights.extend(len(x) + 1 for x in lines)
    return np.array(rows, np.float64).reshape(-1, MEASURES), np.array(sizes, np.int64), np.array(weights, np.float64)


@dataclass
class Field:
    """``node`` weighs the features for good against bad; ``pair[a, b]`` is the score of label a before label b."""

    cuts: np.ndarray = field(default_factory=lambda: np.zeros((MEASURES, BINS - 1)))
    mean: np.ndarray = field(default_factory=lambda: np.zeros(0))
    scale: np.ndarray = field(default_factory=lambda: np.ones(0))
    node: np.ndarray = field(default_factory=lambda: np.zeros(0))
    pair: np.ndarray = field(default_factory=lambda: np.zeros((2, 2)))
    curve: np.ndarray = field(default_factory=lambda: np.zeros(3))
    prior: float | None = None


def _raw_features(m: np.ndarray, sizes: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """Own measures and their bins, both neighbours' measures, whether there is a neighbour, whether it equals this line in all measures."""
    n = len(m)
    starts = np.cumsum(sizes) - sizes
    first, last = np.zeros(n, bool), np.zeros(n, bool)
    first[starts], last[starts + sizes - 1] = True, True
    before, after = np.vstack([m[:1] * 0, m[:-1]]), np.vstack([m[1:], m[:1] * 0])
    before[first], after[last] = 0, 0
    bins = [(np.digitize(m[:, i], cuts[i])[:, None] == np.arange(BINS)[None, :]) for i in range(MEASURES)]
    like = [((before == m).all(axis=1) & ~first)[:, None], ((after == m).all(axis=1) & ~last)[:, None]]
    return np.hstack([m, *bins, before, after, first[:, None], last[:, None], *like, np.ones((n, 1))]).astype(np.float64)


def _features(m: np.ndarray, sizes: np.ndarray, f: Field) -> np.ndarray:
    return (_raw_features(m, sizes, f.cuts) - f.mean) / f.scale


def _log_sum(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.logaddexp(a, b)


def forward_backward(score: np.ndarray, sizes: np.ndarray, pair: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(P(good) per line, P(label a before label b) summed over all neighbours): all chains step together, the longest first."""
    n, docs = len(score), len(sizes)
    starts = np.cumsum(sizes) - sizes
    order = np.argsort(-sizes, kind="stable")
    at, left = starts[order], sizes[order]
    alpha, beta = np.zeros((n, 2)), np.zeros((n, 2))
    alpha[at, 1] = score[at]
    steps = int(sizes.max()) if docs else 0
    active = np.searchsorted(-left, -np.arange(1, steps + 1), side="right")  # chains with at least t lines
    for t in range(1, steps):
        i = at[: active[t]] + t
        p = alpha[i - 1]
        alpha[i, 0] = _log_sum(p[:, 0] + pair[0, 0], p[:, 1] + pair[1, 0])
        alpha[i, 1] = _log_sum(p[:, 0] + pair[0, 1], p[:, 1] + pair[1, 1]) + score[i]
    for t in range(steps - 2, -1, -1):
        i = at[: active[t + 1]] + t
        q0, q1 = beta[i + 1, 0], beta[i + 1, 1] + score[i + 1]
        beta[i, 0] = _log_sum(q0 + pair[0, 0], q1 + pair[0, 1])
        beta[i, 1] = _log_sum(q0 + pair[1, 0], q1 + pair[1, 1])
    both = alpha + beta
    total = _log_sum(both[:, 0], both[:, 1])
    good = np.exp(both[:, 1] - total)
    inner = np.ones(n, bool)
    inner[starts + sizes - 1] = False
    i = np.flatnonzero(inner)
    joint = np.zeros((2, 2))
    for a in (0, 1):
        for b in (0, 1):
            joint[a, b] = np.exp(alpha[i, a] + pair[a, b] + (score[i + 1] if b else 0.0) + beta[i + 1, b] - total[i]).sum()
    return good, joint


def _fit_chain(x: np.ndarray, y: np.ndarray, sizes: np.ndarray, share: np.ndarray, node: np.ndarray, pair: np.ndarray, rounds: int, ridge: float = 1e-3) -> tuple[np.ndarray, np.ndarray]:
    """Gradient ascent (Adam) on the mean log-likelihood of the line labels; ``share`` weighs lines so that long documents do not rule."""
    inner = np.ones(len(y), bool)
    inner[np.cumsum(sizes) - 1] = False
    i = np.flatnonzero(inner)
    seen = np.zeros((2, 2))
    np.add.at(seen, (y[i], y[i + 1]), 1.0)
    theta = np.concatenate([node, pair.ravel()])
    m1, m2 = np.zeros_like(theta), np.zeros_like(theta)
    for r in range(1, rounds + 1):
        good, joint = forward_backward(x @ theta[:-4], sizes, theta[-4:].reshape(2, 2))
        g = np.concatenate([x.T @ (share * (y - good)) / share.sum(), ((seen - joint) / max(1, len(i))).ravel()]) - ridge * theta
        m1, m2 = 0.9 * m1 + 0.1 * g, 0.999 * m2 + 0.001 * g * g
        theta = theta + 0.05 * (m1 / (1 - 0.9**r)) / (np.sqrt(m2 / (1 - 0.999**r)) + 1e-8)
    return theta[:-4], theta[-4:].reshape(2, 2)


def _doc_features(good: np.ndarray, weights: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    starts = np.cumsum(sizes) - sizes
    mean = np.add.reduceat(good * weights, starts) / np.add.reduceat(weights, starts)
    mean = np.clip(mean, 1e-4, 1 - 1e-4)
    return np.column_stack([np.log(mean / (1 - mean)), mean, np.ones(len(sizes))])


def _fit_curve(z: np.ndarray, y: np.ndarray, rounds: int = 60, ridge: float = 1e-2) -> np.ndarray:
    """Logistic regression by Newton steps."""
    w = np.zeros(z.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-z @ w))
        h = (z * (p * (1 - p))[:, None]).T @ z + ridge * np.eye(len(w))
        step = np.linalg.solve(h, z.T @ (y - p) - ridge * w)
        w = w + np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return w


def fit_field(m: np.ndarray, sizes: np.ndarray, weights: np.ndarray, y: np.ndarray, rounds: int = 90) -> Field:
    """``y`` is the label of each document."""
    if len(y) == 0 or y.min() == y.max():
        return Field(prior=float(y.mean()) if len(y) else 0.5)
    f = Field(cuts=np.quantile(m, np.linspace(0, 1, BINS + 1)[1:-1], axis=0).T)
    raw = _raw_features(m, sizes, f.cuts)
    f.mean, f.scale = raw.mean(axis=0), np.where(raw.std(axis=0) > 1e-9, raw.std(axis=0), 1.0)
    f.mean[-1] = 0.0  # the constant stays
    x = (raw - f.mean) / f.scale
    doc = np.repeat(np.arange(len(sizes)), sizes)
    share = weights / np.add.reduceat(weights, np.cumsum(sizes) - sizes)[doc]
    lines = y[doc].astype(np.int64)
    f.node, f.pair = _fit_chain(x, lines, sizes, share, np.zeros(x.shape[1]), np.zeros((2, 2)), rounds)
    # Lines of bad documents that the field takes for good by their own features become good, but the worst line of each stays bad.
    alone = 1 / (1 + np.exp(-x @ f.node))
    worst = np.zeros(len(lines), bool)
    low = np.minimum.reduceat(alone, np.cumsum(sizes) - sizes)[doc]
    worst[alone <= low] = True
    lines = np.where((lines == 0) & (alone > 0.7) & ~worst, 1, lines)
    f.node, f.pair = _fit_chain(x, lines, sizes, share, f.node, f.pair, rounds // 2)
    good, _ = forward_backward(x @ f.node, sizes, f.pair)
    f.curve = _fit_curve(_doc_features(good, weights, sizes), y.astype(np.float64))
    return f


def score_texts(texts: list[str | None], f: Field) -> np.ndarray:
    if f.prior is not None or not texts:
        return np.full(len(texts), 0.5 if f.prior is None else f.prior)
    m, sizes, weights = measure_docs(texts)
    good, _ = forward_backward(_features(m, sizes, f) @ f.node, sizes, f.pair)
    return 1 / (1 + np.exp(-np.clip(_doc_features(good, weights, sizes) @ f.curve, -50, 50)))


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", learn: Column | None = None, bound: int = SAMPLE) -> Field:
    """Fits the field on at most ``bound`` labelled documents; their line measures, not their texts, reach the driver."""
    sample = labelled_sample(docs, labels, label, F.lit(True) if learn is None else learn, bound)
    sample = sample.where(F.length("text") - F.length(F.regexp_replace("text", "\n", "")) < SAMPLE_LINES)

    def run(c: dict) -> dict:
        out: dict[str, list] = {"m": [], "w": []}
        for t in c["text"].to_pylist():
            m, _, w = measure_docs([t])
            out["m"].append(m.ravel().astype(np.float32))
            out["w"].append(w.astype(np.float32))
        return {"y": c["y"], "doc_id": c["doc_id"], **out}

    got = map_rows(sample.select("doc_id", "text", "y"), run, "doc_id bigint, y int, m array<float>, w array<float>").toPandas().sort_values("doc_id", kind="stable")
    if not len(got):
        return Field(prior=0.5)
    w = [np.asarray(v) for v in got["w"]]
    m = np.concatenate([np.asarray(v) for v in got["m"]]).reshape(-1, MEASURES).astype(np.float64)
    return fit_field(m, np.array([len(v) for v in w]), np.concatenate(w).astype(np.float64), got["y"].to_numpy())


def score(docs: DataFrame, f: Field, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, score) per row."""
    kind = dict(docs.dtypes)[key]
    run = lambda c: {"key": c["key"], "score": score_texts(c["text"].to_pylist(), f)}
    return map_rows(docs.select(F.col(key).alias("key"), F.col(text).alias("text")), run, f"key {kind}, score double").withColumnRenamed("key", key)


def keep_good(docs: DataFrame, f: Field, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that score at least ``threshold``, same columns; texts do not move."""

    def run(c: dict) -> dict:
        import pyarrow as pa

        keep = pa.array(score_texts(c["text"].to_pylist(), f) >= threshold)
        return {n: v.filter(keep) for n, v in c.items()}

    return map_rows(docs, run, docs.schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op10: every whole text of ``documents``; learned from labels of the four other folds."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    f = fit(docs, labels, learn=~held_out("doc_id", FOLDS, HELD_OUT))
    out = score(docs, f)
    return out.select("doc_id", held_out("doc_id", FOLDS, HELD_OUT).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
