"""Quality classification by a sparse rule ensemble.

Small gradient-boosted trees are grown on text statistics of a bounded sample of labelled rows; every path from a root to a node is a
conjunctive rule; a lasso logistic regression weighs the rules, most of them with zero; the rules left are compiled into one Spark column
over the statistics. The fit stops after STEPS steps, near the optimum of the lasso. Statistics are counted over whole texts in one pass: shares of byte classes, lengths of words and lines, repetition.

Null and empty texts have zero statistics and a score like any other. With one class among the labels, or none, the score is that class's
smoothed share for every row. Repeated labels and repeated documents of an id count once; labels other than 0 and 1 are left out. Very long texts are measured whole,
in chunks of bounded size; columns named like a result give way, others are carried and never read; an empty table gives none.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import appended, groups, remainder, utf8, words

#: Labelled rows to learn from; trees, their depth, and candidate thresholds of a statistic; lasso penalty and steps.
SAMPLE, TREES, DEPTH, BINS, PENALTY, STEPS = 20_000, 30, 3, 32, 5e-4, 400

CLASSES = {"upper": range(65, 91), "lower": range(97, 123), "digit": range(48, 58), "high": range(128, 256), "newline": (10,), "blank": (32, 9), "stop": b".,", "loud": b"!?", "rule": b"|_=<>{}[]\\/", "sign": b"*#$%&@^~+"}
STATISTICS = (*(f"share_{c}" for c in CLASSES), "word_bytes", "repeated", "distinct", "periodic", "log_words", "line_words")
PREFIX = "__stat_"

_CLASS = np.zeros(256, np.int64)
for _k, _bytes in enumerate(CLASSES.values(), 1):
    _CLASS[list(_bytes)] = _k


def statistics(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A row for each text data[at[i]:at[i + 1]], a column for each of STATISTICS."""
    out = np.zeros((len(at) - 1, len(STATISTICS)))
    for lo, hi in groups(at):
        own, n = at[lo : hi + 1] - at[lo], hi - lo
        size = np.diff(own)
        doc = np.repeat(np.arange(n), size)
        counts = np.bincount(doc * (len(CLASSES) + 1) + _CLASS[data[at[lo] : at[hi]]], minlength=n * (len(CLASSES) + 1)).reshape(n, -1)[:, 1:]
        hashes, edge = words(data, at[lo : hi + 1])
        many = np.diff(edge)
        of = np.repeat(np.arange(n), many)
        same = np.zeros((2, len(hashes)), bool)
        for k, lag in enumerate((1, 2)):
            same[k, lag:] = (hashes[lag:] == hashes[:-lag]) & (of[lag:] == of[:-lag])
        order = np.lexsort((hashes, of))
        first = np.ones(len(hashes), bool)
        first[1:] = (hashes[order][1:] != hashes[order][:-1]) | (of[order][1:] != of[order][:-1])
        shares = counts / np.maximum(size, 1)[:, None]
        per_word = np.maximum(many, 1)
        solid = size - counts[:, list(CLASSES).index("blank")] - counts[:, list(CLASSES).index("newline")]
        rest = (solid / per_word, np.bincount(of, same[0], n) / per_word, np.bincount(of[order], first, n) / per_word, np.bincount(of, same[1], n) / per_word, np.log1p(many), many / (1 + counts[:, list(CLASSES).index("newline")]))
        out[lo:hi] = np.column_stack([shares, *rest])
    return out


def measured(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with a column for each statistic of its whole text."""

    def run(batch: pa.RecordBatch) -> list[pa.Array]:
        found = statistics(*utf8(batch.column(batch.schema.get_field_index(text))))
        return [pa.array(np.ascontiguousarray(found[:, k])) for k in range(found.shape[1])]

    return appended(docs, run, ", ".join(f"`{PREFIX}{s}` double" for s in STATISTICS))


@dataclass
class Rules:
    """bias + the weights of the rules that hold, through the logistic function. A rule: (statistic, is above, threshold) that all hold."""

    bias: float
    rules: list[tuple[float, tuple[tuple[int, bool, float], ...]]]

    def column(self) -> Column:
        """The score as one column over the statistics."""
        total = f"{self.bias!r}D"
        for weight, rule in self.rules:
            total += f" + CASE WHEN {' AND '.join(f'`{PREFIX}{STATISTICS[k]}` {">" if above else "<="} {t!r}D' for k, above, t in rule)} THEN {weight!r}D ELSE 0.0D END"
        return F.expr(f"1.0D / (1.0D + exp(-({total})))")

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.bias)
        for weight, rule in self.rules:
            total += weight * holds(x, rule)
        return 1 / (1 + np.exp(-total))


def holds(x: np.ndarray, rule: tuple[tuple[int, bool, float], ...]) -> np.ndarray:
    out = np.ones(len(x), bool)
    for k, above, t in rule:
        out &= (x[:, k] > t) == above
    return out


def _grow(bins: np.ndarray, cuts: list[np.ndarray], gradient: np.ndarray, hessian: np.ndarray, rows: np.ndarray, path: tuple, found: list, leaves: list) -> None:
    """Splits rows where the loss falls most; found gets the paths of all nodes, leaves each leaf's rows and step."""
    g, h = gradient[rows].sum(), hessian[rows].sum()
    best = (1e-6, None)
    if len(path) < DEPTH and len(rows) >= 20:
        for k, cut in enumerate(cuts):
            if len(cut):
                gk, hk = (np.cumsum(np.bincount(bins[rows, k], w[rows], len(cut) + 1))[:-1] for w in (gradient, hessian))
                n = np.cumsum(np.bincount(bins[rows, k], minlength=len(cut) + 1))[:-1]
                gain = gk**2 / (hk + 1) + (g - gk) ** 2 / (h - hk + 1) - g**2 / (h + 1)
                gain[(n < 5) | (n > len(rows) - 5)] = 0
                if gain.max() > best[0]:
                    best = (gain.max(), (k, int(gain.argmax())))
    if best[1] is None:
        leaves.append((rows, -g / (h + 1)))
        return
    k, b = best[1]
    for above in (False, True):
        below = (*path, (k, above, float(cuts[k][b])))
        found.append(below)
        _grow(bins, cuts, gradient, hessian, rows[(bins[rows, k] > b) == above], below, found, leaves)


def fit(x: np.ndarray, y: np.ndarray) -> Rules:
    """The rule ensemble of labelled statistics."""
    share = (y.sum() + 0.5) / (len(y) + 1)
    prior = Rules(float(np.log(share / (1 - share))), [])
    if len(np.unique(y)) < 2:
        return prior
    cuts = [np.unique(np.quantile(x[:, k], np.linspace(0, 1, BINS + 1)[1:-1])) for k in range(x.shape[1])]
    bins = np.column_stack([np.searchsorted(c, x[:, k], "left") for k, c in enumerate(cuts)])
    raw, paths = np.full(len(y), prior.bias), {}
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-raw))
        found: list = []
        leaves: list = []
        _grow(bins, cuts, p - y, p * (1 - p), np.arange(len(y)), (), found, leaves)
        for rows, step in leaves:
            raw[rows] += 0.3 * step
        paths |= dict.fromkeys(tuple(sorted(f)) for f in found)
    seen: dict[bytes, tuple] = {}
    for path in paths:  # of rules that hold on the same rows, the first
        on = holds(x, path)
        if 0 < on.sum() < len(y):
            seen.setdefault(np.packbits(on).tobytes(), path)
    rules = list(seen.values())
    a = np.column_stack([holds(x, r) for r in rules]).astype(np.float32) if rules else np.zeros((len(y), 0), np.float32)
    w, v, bias, vb, t = np.zeros(len(rules)), np.zeros(len(rules)), prior.bias, prior.bias, 1.0
    step = 4 / max(1.0, np.linalg.norm(a.T @ np.concatenate([a, np.ones((len(y), 1), np.float32)], 1) / len(y), 2) if rules else 1.0)
    for _ in range(STEPS):  # accelerated proximal gradient
        r = (1 / (1 + np.exp(-(a @ v.astype(np.float32) + vb))) - y) / len(y)
        new = v - step * (a.T @ r.astype(np.float32))
        new = np.sign(new) * np.maximum(np.abs(new) - step * PENALTY, 0)
        new_bias = vb - step * r.sum()
        t, last = (1 + np.sqrt(1 + 4 * t * t)) / 2, t
        v, vb = new + (last - 1) / t * (new - w), new_bias + (last - 1) / t * (new_bias - bias)
        w, bias = new, new_bias
    return Rules(float(bias), [(float(k), r) for k, r in zip(w, rules, strict=True) if k])


def learned(docs: DataFrame, labels: DataFrame, label: str = "quality", sample: int = SAMPLE) -> Rules:
    """The ensemble of at most `sample` labelled documents, spread evenly by a hash; labels: doc_id and the label, already of rows to learn from."""
    rows = labels.select("doc_id", F.col(label).cast("int").alias("label")).where("doc_id is not null and label in (0, 1)")
    mark = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30))
    share = min(1.0, 1.2 * sample / max(1, rows.distinct().count()))
    some = rows.where(mark < int(share * (1 << 30)) + 1).distinct().orderBy(mark, "doc_id", "label").limit(2 * sample)
    found = measured(docs.select("doc_id", "text").join(F.broadcast(some), "doc_id"))  # at most 2 * sample rows of two numbers
    columns = [f"{PREFIX}{s}" for s in STATISTICS]  # of documents that share an id the one with the least statistics, so that copies weigh nothing
    found = found.groupBy("doc_id", "label").agg(F.min(F.struct(*columns)).alias("one")).select("doc_id", "label", "one.*")
    got = found.orderBy("doc_id", "label").limit(2 * sample).toArrow()
    x = np.column_stack([got.column(k).to_numpy() for k in range(got.num_columns)])
    x = x[np.lexsort(x.T[::-1])][: 2 * sample]
    return fit(x[:, 2:], x[:, 1])


def scored(docs: DataFrame, model: Rules, text: str = "text") -> DataFrame:
    """docs with score, the estimated chance of label 1, and predicted, 1 from a half on."""
    kept = [F.col(f"`{c}`") for c in docs.columns if c.lower() not in ("score", "predicted")]
    return measured(docs, text).select(*kept, model.column().alias("score")).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def judged(docs: DataFrame, labels: DataFrame, folds: int = 3, held: int = 1) -> DataFrame:
    """doc_id, held_out, score and predicted of every row; learns from labels outside the held-out fold only."""
    fold = remainder(F.col("doc_id"), folds)
    model = learned(docs, labels.where(fold != held))
    rows = docs.select("doc_id", F.coalesce(fold == held, F.lit(False)).alias("held_out"), "text")
    return scored(rows, model).select("doc_id", "held_out", "score", "predicted")
