"""Document quality from a linear-chain conditional random field over lines.

Every line is labelled good or bad. A line's features are bins of what it is made of (length, words, capitals,
digits, symbols, separators, repeats) and the bins of the lines before and after it; a transition matrix ties
neighbours. Forward-backward gives each line's marginal, and the marginals, weighted by the lines' lengths,
give the document's quality, which a logistic curve maps to a probability.

The field is fitted on a bounded sample of labelled training documents, the ones of smallest hash: at most `sample`
documents and `lines` lines in all. Documents are left out whole; every line of a document in the sample is learned from,
under its document's label. Only bin numbers of those documents reach the driver. The model is a few hundred numbers.
Scoring is one pass over the texts, without a shuffle. Inputs of a score are the text alone.

Nulls and edges: a null, empty or blank text is one blank line; a very long text is scored over all its lines; a null id
counts as crc32 remainder 0 (training, but without a label); unlabelled rows are scored only; with labels of one class or
none every score is 0.5; several labels of an id count as their maximum; of several texts of an id the one of smallest
hash is learned from; repeated rows each return; an empty table gives no rows; the report leaves other columns out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import remainder, steps

#: Bounds on the training documents and on the lines of all of them.
SAMPLE, SAMPLE_LINES = 6_000, 200_000

_EDGES = {
    "bytes": (1, 8, 20, 40, 80, 160, 320, 640, 1280),
    "words": (1, 2, 4, 8, 16, 32, 64, 128),
    "word_bytes": (2, 3, 4, 5, 6, 7, 9, 12),
    "upper": (0.001, 0.02, 0.04, 0.08, 0.15, 0.3, 0.6),
    "digits": (0.001, 0.01, 0.03, 0.1, 0.3),
    "symbols": (0.001, 0.005, 0.02, 0.05, 0.1, 0.3),
    "bars": (0.001, 0.01, 0.05, 0.1),
    "marks": (0.001, 0.005, 0.01, 0.02, 0.03, 0.05, 0.1),
    "other": (0.001, 0.01, 0.05, 0.1),
    "beyond_ascii": (0.001, 0.01, 0.03, 0.06, 0.12, 0.3),
    "distinct": (0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 0.99),
    "copy": (0.5,),
    "copies_so_far": (0.01, 0.1, 0.3, 0.6),
    "ends": (0.5,),
}
WIDTH = 12
FEATURES = len(_EDGES)
#: This line, the one before, the one after; one more bin (the last) for a missing neighbour.
PARAMETERS = 3 * FEATURES * WIDTH

_CLASS = np.zeros(256, dtype=np.uint8)
for _c, _chars in enumerate((b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b"#*$%&<>@^~=_+{}[]\\", b"|", b".,;:!?'\"()-", bytes(range(128, 256)), b"\t\r\x0b\x0c/`" + bytes(range(9)) + bytes(range(14, 32)))):
    _CLASS[np.frombuffer(_chars, dtype=np.uint8)] = _c + 1


def line_bins(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bins (lines x FEATURES) and byte lengths of the lines of all texts, and each text's number of lines."""
    lines: list[str] = []
    extra: list[tuple] = []
    counts = np.zeros(len(texts), dtype=np.int64)
    for k, text in enumerate(texts):
        own = [x for x in text.split("\n") if x and not x.isspace()] or [""]
        seen: set[str] = set()
        copies = 0
        for i, x in enumerate(own):
            words = x.split()
            copy = x in seen
            copies += copy
            seen.add(x)
            extra.append((len(words), len(set(words)), copy, copies / (i + 1), x.rstrip()[-1:] in ".!?:;,"))
        lines += own
        counts[k] = len(own)
    flat = np.frombuffer("\n".join(lines).encode("utf-8", "replace") + b"\n", dtype=np.uint8)
    ends = np.flatnonzero(flat == 10)
    starts = np.concatenate(([0], ends[:-1] + 1))
    size = (ends - starts).astype(np.float64)
    kinds = _CLASS[flat]
    share = [np.add.reduceat(kinds == c, starts, dtype=np.int64) / np.maximum(size, 1) for c in range(1, 8)]
    more = np.array(extra, dtype=np.float64).reshape(-1, 5)
    words = more[:, 0]
    values = {
        "bytes": size,
        "words": words,
        "word_bytes": size / np.maximum(words, 1) - 1,
        "upper": share[0],
        "digits": share[1],
        "symbols": share[2],
        "bars": share[3],
        "marks": share[4],
        "other": share[6],
        "beyond_ascii": share[5],
        "distinct": more[:, 1] / np.maximum(words, 1),
        "copy": more[:, 2],
        "copies_so_far": more[:, 3],
        "ends": more[:, 4],
    }
    bins = np.stack([np.searchsorted(_EDGES[k], values[k], side="right") for k in _EDGES], axis=1).astype(np.uint8)
    return bins, size + 1, counts


def _indices(bins: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Parameter numbers of each line: its own bins and those of its neighbours in the same text."""
    n = len(bins)
    last = np.cumsum(counts)
    first = last - counts
    own = bins.astype(np.int64) + np.arange(FEATURES) * WIDTH
    missing = WIDTH - 1 + np.arange(FEATURES) * WIDTH
    before, after = np.empty_like(own), np.empty_like(own)
    before[1:], after[:-1] = own[:-1], own[1:]
    before[first], after[last - 1] = missing, missing
    return np.concatenate([own, before + FEATURES * WIDTH, after + 2 * FEATURES * WIDTH], axis=1) if n else np.zeros((0, 3 * FEATURES), dtype=np.int64)


class Field:
    """A two-state chain: emission weights of `good` against `bad`, transitions[from, to] and start scores."""

    def __init__(self, weights: np.ndarray, transitions: np.ndarray, start: np.ndarray, scale: float = 1.0, shift: float = 0.0):
        self.weights, self.transitions, self.start, self.scale, self.shift = weights, transitions, start, scale, shift

    def chains(self, emission: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Marginal of `good` per line, expected transitions (2 x 2) and log partition per text, for all texts side by side."""
        order = np.argsort(-counts, kind="stable")
        first = (np.cumsum(counts) - counts)[order]
        counts = counts[order]
        steps = int(counts[0]) if len(counts) else 0
        alive = np.searchsorted(-counts, -np.arange(steps), side="left")  # texts with a line t
        n = len(emission)
        score = np.zeros((n, 2))
        score[:, 1] = emission
        alpha, beta = np.zeros((n, 2)), np.zeros((n, 2))
        for t in range(steps):
            at = first[: alive[t]] + t
            if t == 0:
                alpha[at] = score[at] + self.start
            else:
                before = alpha[at - 1][:, :, None] + self.transitions
                alpha[at] = np.logaddexp(before[:, 0], before[:, 1]) + score[at]
        for t in range(steps - 2, -1, -1):
            at = first[: alive[t + 1]] + t
            after = self.transitions + (score[at + 1] + beta[at + 1])[:, None, :]
            beta[at] = np.logaddexp(after[:, :, 0], after[:, :, 1])
        ends = first + counts - 1
        total = np.logaddexp(alpha[ends, 0], alpha[ends, 1])
        of = np.empty(n)
        of[np.repeat(first, counts) + _within(counts)] = np.repeat(total, counts)
        good = np.exp(np.minimum(0, alpha[:, 1] + beta[:, 1] - of))
        has_next = np.ones(n, dtype=bool)
        has_next[ends] = False
        i = np.flatnonzero(has_next)
        pair = alpha[i][:, :, None] + self.transitions + (score[i + 1] + beta[i + 1])[:, None, :] - of[i][:, None, None]
        back = np.empty(len(order))
        back[order] = total
        return good, np.exp(pair).sum(axis=0), back

    def score(self, texts: list[str]) -> np.ndarray:
        """Probability of label 1 per text."""
        bins, size, counts = line_bins(texts)
        return self.of_bins(bins, size, counts)

    def of_bins(self, bins: np.ndarray, size: np.ndarray, counts: np.ndarray) -> np.ndarray:
        if not len(counts):
            return np.zeros(0)
        good, _, _ = self.chains(self.weights[_indices(bins, counts)].sum(axis=1), counts)
        share = _weighted(good, size, counts)
        return 1 / (1 + np.exp(-(self.scale * _logit(share) + self.shift)))


def _within(counts: np.ndarray) -> np.ndarray:
    return np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)


def _weighted(good: np.ndarray, size: np.ndarray, counts: np.ndarray) -> np.ndarray:
    first = np.cumsum(counts) - counts
    return np.add.reduceat(good * size, first) / np.add.reduceat(size, first)


def _logit(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-4, 1 - 1e-4)
    return np.log(p / (1 - p))


def fit(bins: np.ndarray, size: np.ndarray, counts: np.ndarray, labels: np.ndarray, rounds: int = 250, decay: float = 1e-3) -> Field:
    """Maximum likelihood of the labels' chains with weight decay, by Adam on all texts at once."""
    if len(set(labels.tolist())) < 2:
        return Field(np.zeros(PARAMETERS), np.zeros((2, 2)), np.zeros(2), scale=0.0)
    index = _indices(bins, counts)
    truth = np.repeat(labels, counts).astype(np.float64)
    texts = len(counts)
    seen = np.zeros((2, 2))
    for c in (0, 1):
        seen[c, c] = (counts[labels == c] - 1).sum()
    # A long document counts as much as a short one.
    share = 1 / np.repeat(counts, counts)
    theta = np.zeros(PARAMETERS + 5)
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    lines = len(truth)
    for k in range(1, rounds + 1):
        field = Field(theta[:PARAMETERS], theta[PARAMETERS : PARAMETERS + 4].reshape(2, 2), np.array([0.0, theta[-1]]))
        good, pairs, _ = field.chains(field.weights[index].sum(axis=1), counts)
        gap = (truth - good) * share
        gradient = np.zeros_like(theta)
        gradient[:PARAMETERS] = np.bincount(index.ravel(), np.repeat(gap, index.shape[1]), PARAMETERS) / texts
        gradient[PARAMETERS : PARAMETERS + 4] = (seen - pairs).ravel() / lines
        gradient[-1] = gap.sum() / texts
        gradient -= decay * theta
        m, v = 0.9 * m + 0.1 * gradient, 0.99 * v + 0.01 * gradient**2
        theta += 0.05 * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.99**k)) + 1e-8)
    field = Field(theta[:PARAMETERS].copy(), theta[PARAMETERS : PARAMETERS + 4].reshape(2, 2).copy(), np.array([0.0, theta[-1]]))
    good, _, _ = field.chains(field.weights[index].sum(axis=1), counts)
    field.scale, field.shift = _curve(_logit(_weighted(good, size, counts)), labels.astype(np.float64))
    return field


def _curve(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Logistic regression of y on x by Newton steps."""
    w = np.zeros(2)
    design = np.stack([x, np.ones_like(x)], axis=1)
    for _ in range(30):
        p = 1 / (1 + np.exp(-design @ w))
        hessian = (design * (p * (1 - p))[:, None]).T @ design + 1e-3 * np.eye(2)
        w += np.linalg.solve(hessian, design.T @ (y - p) - 1e-3 * w)
    return max(float(w[0]), 1e-3), float(w[1])


def fit_documents(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, lines: int = SAMPLE_LINES) -> Field:
    """The field fitted on at most `sample` labelled documents, of at most `lines` lines in all, whose crc32(doc_id as text)
    mod 3 is not 1. A document of more than a tenth of `lines` is not learned from."""
    truth = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull() & (remainder("doc_id", 3) != 1))
    truth = truth.groupBy("doc_id").agg(F.max("quality").cast("int").alias("quality"))
    chosen = truth.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    content = F.coalesce("text", F.lit(""))
    texts = docs.select("doc_id", content.alias("text")).join(F.broadcast(chosen), "doc_id")
    # One text of each id; copies of an id are reduced before they are shuffled.
    texts = texts.groupBy("doc_id", "quality").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text")).alias("s")).select("doc_id", "quality", "s.text")

    def bins_of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            bins, size, counts = line_bins(list(b["text"]))
            ends = np.cumsum(counts)
            cuts = [slice(e - c, e) for e, c in zip(ends, counts)]
            out = pd.DataFrame({"doc_id": b["doc_id"], "quality": b["quality"], "n": counts, "bins": [bins[c].tobytes() for c in cuts], "size": [size[c].tobytes() for c in cuts]})
            yield out[out["n"] <= lines // 10]

    with steps(docs.sparkSession, "line-bins") as own:
        rows = own(texts.mapInPandas(bins_of, "doc_id long, quality int, n long, bins binary, size binary"), "lines")
        so_far = F.sum("n").over(Window.orderBy(F.xxhash64("doc_id"), "doc_id"))  # at most `sample` narrow rows
        used = rows.select("doc_id", so_far.alias("so_far")).where(F.col("so_far") <= lines).select("doc_id")
        rows = rows.join(F.broadcast(used), "doc_id").toPandas().sort_values("doc_id")
    bins = np.frombuffer(b"".join(rows["bins"]), dtype=np.uint8).reshape(-1, FEATURES)
    size = np.frombuffer(b"".join(rows["size"]), dtype=np.float64)
    return fit(bins, size, rows["n"].to_numpy(dtype=np.int64), rows["quality"].to_numpy(dtype=np.int64))


def score_documents(docs: DataFrame, field: Field) -> DataFrame:
    """The input with score (0 to 1) of every row's text."""

    @F.pandas_udf("double")
    def scored(texts: pd.Series) -> pd.Series:
        return pd.Series(field.score(list(texts)))

    return docs.withColumn("score", scored(F.coalesce(F.col("text"), F.lit(""))))


def quality_report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    found = score_documents(docs.select("doc_id", "text"), fit_documents(docs, labels))
    return found.select("doc_id", (remainder("doc_id", 3) == 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
