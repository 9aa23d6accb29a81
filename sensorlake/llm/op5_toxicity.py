"""Toxicity scores of texts restored through a noisy channel.

A character trigram model is counted over all documents. A token, or a run of
short tokens with the spaces between them, that may be disguised (letters
written as digits or signs, also at the ends, letters set apart, letters
repeated) spans a lattice of readings; Viterbi decoding finds the reading that
the channel and the model together find likeliest. A token with a single
reading is that reading. Words of the restored text, and their beginnings, that
labelled documents show to be marks of toxicity give the score.

* digits and signs without any letter in the token or run stand for themselves
* null or empty text: no word, gets the score of texts without marks
* null id: not held out, never part of the sample
* no usable labels, or only one kind: every document gets the prior of the labels (0.5 without any)
* repeated rows are scored each; of repeated labels the larger counts
* other columns are untouched and may have any name
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sensorlake.llm.common import labelled_sample, map_rows, table
from sensorlake.llm.op2_bpe import _Cache
from sensorlake.llm.op10_quality import _fit_curve, held_out
from sensorlake.session import cut_lineage

SAMPLE = 8000
THRESHOLD = 0.3
FOLDS, HELD_OUT = 4, 2

# The letters that signs stand for, the signs that set letters apart.
LEET = {"0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "*": "aeiou"}
APART = ".-_*~'`/\\,"
EDGE = ".,;:!?\"'()[]{}<>#%&*|~=+-_/\\^`"
#: Signs that stand for no letter, and where those that do are plain punctuation as a rule: before, after and between words.
PLAIN = "".join(c for c in EDGE if c not in LEET)
BEFORE, AFTER, ALONE = "*", "!)*", "|*"
#: Costs of the channel in nats: a letter read from a sign, a sign dropped, a sign as an end of word, a repeated letter dropped.
READ, DROP, BREAK, REPEAT = 1.0, 0.7, 1.2, 0.4
#: A space between short tokens dropped (single letters rather belong together, there a space costs BREAK), a sign at an end that no punctuation explains.
JOIN, STRAY = 2.0, 6.0

#: A run of tokens so short that they may be one word set apart, or one token.
SHORT = 3
PIECE = re.compile(rf"\S{{1,{SHORT}}}(?:\s+\S{{1,{SHORT}}})+(?!\S)|\S+")
TWICE = re.compile(r"([^\W\d_])\1")

PREFIXES = (3, 4, 5, 6)
LEAST_SEEN = 3


def _fold_table() -> np.ndarray:
    """Latin-1 byte -> 1..26 for the letter it is or carries, 0 for all else."""
    import unicodedata

    out = np.zeros(256, np.int64)
    for b in range(256):
        base = unicodedata.normalize("NFKD", chr(b).lower())[0]
        if "a" <= base <= "z":
            out[b] = ord(base) - 96
    out[0xDF] = 19  # sharp s
    return out


FOLD = _fold_table()


def letters_of(text: str) -> np.ndarray:
    return FOLD[np.frombuffer(text.encode("latin-1", "replace"), np.uint8)]


def trigram_counts(texts: list[str | None]) -> np.ndarray:
    """Counts of (a, b, c) with 0 for what is no letter; two ends of word before each text."""
    total = np.zeros(27**3, np.int64)
    for t in texts:
        if t:
            c = np.concatenate([[0, 0], letters_of(t), [0]])
            total += np.bincount(c[:-2] * 729 + c[1:-1] * 27 + c[2:], minlength=27**3)
    return total


def model_of(counts: np.ndarray) -> list[float]:
    """Log-probabilities of the third character, smoothed by those of shorter contexts."""
    tri = counts.reshape(27, 27, 27).astype(np.float64)
    bi, uni = tri.sum(axis=0), tri.sum(axis=(0, 1))
    p1 = (uni + 1) / (uni.sum() + 27)
    p2 = (bi + 20 * p1[None, :]) / (bi.sum(axis=1, keepdims=True) + 20)
    p3 = (tri + 20 * p2[None, :, :]) / (tri.sum(axis=2, keepdims=True) + 20)
    return np.log(p3).ravel().tolist()


def corpus_model(docs: DataFrame, text: str = "text") -> list[float]:
    """The model of all documents; at most 27^3 counts reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(27**3, np.int64)
        for b in batches:
            total += trigram_counts(b.column(0).to_pylist())
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"gram": at, "n": total[at]})

    counts = np.zeros(27**3, np.int64)
    for r in docs.select(text).mapInArrow(run, "gram bigint, n bigint").groupBy("gram").agg(F.sum("n").alias("n")).collect():
        counts[r.gram] = r.n
    return model_of(counts)


CODE = {chr(b): int(k) for b, k in enumerate(FOLD)}


def _code(c: str) -> int:
    return CODE.get(c, 0)


def _sign_at_end(c: str, repeated: bool, usual: str) -> list[tuple[str, float]]:
    """Readings of a sign before or after a word: nothing, or a letter."""
    return [("", 0.0 if c not in LEET or repeated or c in usual else STRAY), *((x, READ) for x in LEET.get(c, ""))]


def _token_lattice(token: str, in_run: bool) -> list[list[tuple[str, float]]]:
    if token.isalpha():
        return [[(c, 0.0), ("", REPEAT)] if c == before else [(c, 0.0)] for before, c in zip(" " + token, token)]
    out = []
    body = [i for i, c in enumerate(token) if c not in EDGE]
    first, last = (body[0], body[-1]) if body else (len(token), -1)
    number = in_run and not any(map(str.isalpha, token))
    for i, c in enumerate(token):
        before = i > 0 and token[i - 1] == c
        if c.isalpha():
            ways = [(c, 0.0)]
            if before:
                ways.append(("", REPEAT))
        elif not body or i < first or i > last:
            ways = _sign_at_end(c, before or token[i + 1 : i + 2] == c, ALONE if not body else BEFORE if i < first else AFTER)
        else:
            ways = [(c, 0.0) if number else (" ", BREAK)]
            ways += [(x, READ) for x in LEET.get(c, "")]
            if c in APART or before:
                ways.append(("", DROP))
        out.append(ways)
    return out


def lattice(piece: str) -> list[list[tuple[str, float]]]:
    """Readings of each character with their cost: a string to write ('' drops it, ' ' ends the word). Spaces of a run stay or go."""
    tokens = piece.split()
    out = []
    for i, t in enumerate(tokens):
        if i:
            out.append([(" ", BREAK), ("", 0.0)] if len(t) == len(tokens[i - 1]) == 1 else [(" ", 0.0), ("", JOIN)])
        out += _token_lattice(t, len(tokens) > 1)
    return out


def viterbi(ways: list[list[tuple[str, float]]], model: list[float]) -> str:
    """Likeliest reading of the lattice. A state is the last two characters as the model knows them."""
    best: dict[int, tuple[float, tuple]] = {0: (0.0, ())}
    for options in ways:
        step: dict[int, tuple[float, tuple]] = {}
        if len(options) == 1 and len(best) == 1 and (c := options[0][0]):
            ((s, (cost, path)),) = best.items()
            k = CODE.get(c, 0)
            best = {s % 27 * 27 + k: (cost + options[0][1] - (model[s * 27 + k] if k or s % 27 else 0.0), (path, c))}
            continue
        coded = [(c, extra, CODE.get(c, 0)) for c, extra in options]
        for s, (cost, path) in best.items():
            for c, extra, k in coded:
                if c:
                    to, now = s % 27 * 27 + k, cost + extra - (model[s * 27 + k] if k or s % 27 else 0.0)
                    way = (path, c)
                else:
                    to, now, way = s, cost + extra, path
                if to not in step or now < step[to][0]:
                    step[to] = (now, way)
        best = step
    _, path = min(((cost - model[s * 27], path) for s, (cost, path) in best.items()), key=lambda x: x[0])
    out = []
    while path:
        path, c = path
        out.append(c)
    return "".join(reversed(out)).strip()


def _cleared(token: str) -> str:
    """In lower case, without signs at the ends that stand for no letter and without the signs that mark up rows of words."""
    t = token.lower().strip(PLAIN)
    while t.endswith("$$$") or t.endswith("@@@"):
        t = t[:-3].rstrip(t[-1]).strip(PLAIN)
    return t


def spaced(tokens: list[str]) -> list[str]:
    """Words set letter by letter: runs of three or more tokens of one character each."""
    out, run = [], []
    for t in [*tokens, ""]:
        if len(t) == 1 and (t.isalpha() or t in LEET):
            run.append(t)
        else:
            if len(run) >= 3:
                out.append("".join(run))
            run = []
    return out


def reading(piece: str, model: list[float]) -> str:
    """What a token or a run of short tokens says: itself if there is one reading only, else the decoded one."""
    tokens = [t for t in map(_cleared, piece.split()) if t]
    if len(tokens) == 1 and tokens[0].isalpha() and not TWICE.search(tokens[0]):
        return tokens[0]
    if not any(c.isalpha() for t in tokens for c in t):
        return " ".join(filter(None, (t.strip(EDGE) for t in tokens)))  # numbers and signs alone are no disguised word
    words = viterbi(lattice(" ".join(tokens)), model).split()
    # Letters set singly are also read as one word, wherever the model would cut them.
    if len(tokens) > 2:
        words += [w for s in spaced(tokens) for w in viterbi(lattice(s), model).split() if w not in words]
    return " ".join(words)


class Reader:
    """Readings of tokens and runs, remembered within a fixed number of entries."""

    def __init__(self, model: list[float]):
        self.model = model
        self.of = _Cache(lambda t: reading(t, model))

    def restore(self, text: str | None) -> str:
        """The restored text: the reading of every token and of every run of short tokens."""
        return " ".join(map(self.of.__getitem__, PIECE.findall(text or "")))

    def words(self, text: str | None) -> set[str]:
        seen = set(map(self.of.__getitem__, set(PIECE.findall(text or ""))))
        return {w for r in seen for w in r.split()} if any(" " in r for r in seen) else seen - {""}


def marks_in(word: str) -> list[str]:
    """The word itself and its beginnings."""
    return [f"={word}", *(word[:n] for n in PREFIXES if len(word) >= n)]


@dataclass
class Scorer:
    model: list[float]
    marks: dict[str, float] = field(default_factory=dict)
    curve: np.ndarray = field(default_factory=lambda: np.zeros(6))
    prior: float | None = None

    def __post_init__(self):
        self.reader = Reader(self.model)
        self.of_piece = _Cache(lambda p: tuple((w, v) for w in self.reader.of[p].split() if (v := self.of_word(w))))

    def __getstate__(self):
        return {"model": self.model, "marks": self.marks, "curve": self.curve, "prior": self.prior}

    def __setstate__(self, state):
        self.__dict__.update(state)
        self.__post_init__()

    def of_word(self, word: str) -> float:
        return max((self.marks.get(m, 0.0) for m in marks_in(word)), default=0.0)

    def features(self, text: str | None) -> tuple[float, ...]:
        """Strongest mark, sum of the marks, their sum against the length, the length, whether there is a mark, constant."""
        text = text or ""
        hits = {w: v for found in map(self.of_piece.__getitem__, set(PIECE.findall(text))) for w, v in found}.values()
        total, length = sum(hits), len(text.split())
        return (max(hits, default=0.0), math.log1p(total), math.log1p(1000 * total / (length + 20)), math.log1p(length), float(bool(hits)), 1.0)

    def score(self, texts: list[str | None]) -> np.ndarray:
        if self.prior is not None or not texts:
            return np.full(len(texts), 0.5 if self.prior is None else self.prior)
        z = np.array([self.features(t) for t in texts])
        return 1 / (1 + np.exp(-np.clip(z @ self.curve, -50, 50)))


def pick_marks(seen: list[tuple[str, int, int]], n1: int, n0: int) -> dict[str, float]:
    """Log-odds of the marks that more toxic documents have than chance among so many marks explains."""
    base = n1 / (n1 + n0)
    need = math.log(max(2, len(seen))) + 5
    out = {}
    for m, c1, c0 in seen:
        c = c1 + c0
        p = c1 / c
        if p <= base:
            continue
        gain = c1 * math.log(p / base) + (c0 * math.log((1 - p) / (1 - base)) if c0 else 0.0)
        odds = math.log((c1 + 0.5) / (n1 + 1)) - math.log((c0 + 0.5) / (n0 + 1))
        if gain > need and odds > 1:
            out[m] = odds
    return out


def fit(docs: DataFrame, labels: DataFrame, model: list[float], label: str = "toxic", learn: Column | None = None, bound: int = SAMPLE) -> Scorer:
    """Learns the marks from at most ``bound`` labelled documents; counts are reduced by Spark before the driver picks."""
    sample = cut_lineage(labelled_sample(docs, labels, label, F.lit(True) if learn is None else learn, bound))
    kinds = {r.y: r.n for r in sample.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    n1, n0 = sum(n for y, n in kinds.items() if y), kinds.get(0, 0)
    if not n1 or not n0:
        return Scorer(model, prior=0.5 if not n1 + n0 else n1 / (n1 + n0))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(model)
        for b in batches:
            seen: tuple[Counter, Counter] = (Counter(), Counter())
            for t, y in zip(b.column("text").to_pylist(), b.column("y").to_pylist()):
                seen[int(y > 0)].update({m for w in reader.words(t) for m in marks_in(w)})
            names = list(seen[0] | seen[1])
            yield pa.RecordBatch.from_pydict({"mark": pa.array(names, pa.string()), "c1": pa.array([seen[1][m] for m in names], pa.int64()), "c0": pa.array([seen[0][m] for m in names], pa.int64())})

    counted = sample.select("text", "y").mapInArrow(count, "mark string, c1 bigint, c0 bigint").groupBy("mark").agg(F.sum("c1").alias("c1"), F.sum("c0").alias("c0"))
    # Far fewer than the sample's words: at least so often in toxic documents, and more often than by chance.
    often = counted.where((F.col("c1") >= LEAST_SEEN) & (F.col("c1") * F.lit(n0) > F.col("c0") * F.lit(2 * n1))).collect()
    scorer = Scorer(model, pick_marks([(r.mark, r.c1, r.c0) for r in often], n1, n0))

    def measure(c: dict) -> dict:
        return {"y": c["y"], "z": [scorer.features(t) for t in c["text"].to_pylist()]}

    got = map_rows(sample.select("text", "y"), measure, "y int, z array<double>").collect()
    scorer.curve = _fit_curve(np.array([r.z for r in got]), np.array([float(r.y > 0) for r in got]), ridge=0.1)
    return scorer


def score(docs: DataFrame, scorer: Scorer, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, score) per row."""
    kind = dict(docs.dtypes)[key]
    shared = docs.sparkSession.sparkContext.broadcast(scorer)  # 27^3 numbers and the marks of a bounded sample

    def run(c: dict) -> dict:
        return {"key": c["key"], "score": shared.value.score(c["text"].to_pylist())}

    return map_rows(docs.select(F.col(key).alias("key"), F.col(text).alias("text")), run, f"key {kind}, score double").withColumnRenamed("key", key)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op5: every whole text of ``documents``; learned from labels of the three other folds."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held = held_out("doc_id", FOLDS, HELD_OUT)
    scorer = fit(docs, labels, corpus_model(docs), learn=~held)
    return score(docs, scorer).select("doc_id", held.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
