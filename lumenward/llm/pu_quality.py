"""Quality scores by positive-unlabelled learning.

Trusted good documents and unlabelled web text are told apart by measurements of
the whole text; the class prior is estimated from the two samples, and a linear
model is fitted by minimising the non-negative unbiased risk: the loss on
positives weighted by the prior, plus what remains of the loss on unlabelled
text, taken as negative, once the positives' share in it is subtracted, that
remainder held at zero or above.  No negative label is ever used.

Fitting uses at most :data:`POSITIVES` trusted documents, those with the smallest
hashes of their ids, and all unlabelled ones: every step's loss, gradient and second
derivative, and the counts that the prior rests on, are sums over all of them.
Everything is measured once for all documents, kept as a table, and scored by
plain column arithmetic.

Defined results: null and empty texts have no words, all their measurements are
0 and they get that point's score; very long texts are measured whole; repeated
rows give repeated rows; without trusted documents every score is a half; an
empty table gives an empty one.  Columns other than id and text are no inputs.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenward.llm.quality_rules import measure
from lumenward.llm.words import BLANK, slices, text_buffer, word_hashes, word_spans
from lumenward.storage import Scratch

POSITIVES = 8192
#: Standardised measurements are held within this many deviations.
CLIP = 8.0

_DIGIT = np.zeros(256, bool)
_DIGIT[0x30:0x3A] = True
_PUNCTUATION = np.zeros(256, bool)
_PUNCTUATION[[*range(0x21, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x7F)]] = True
FEATURES = ("log_words", "word_length", "symbols", "duplicate_lines", "repeated", "upper", "digits", "punctuation",
            "wide", "distinct", "top_word", "words_per_line", "no_words")


def features(column: pa.Array) -> np.ndarray:
    """One row of :data:`FEATURES` for each text."""
    found = measure(column)
    data, bounds = text_buffer(column)
    starts, ends, counts = word_spans(data, bounds)
    row = np.repeat(np.arange(len(counts)), counts)
    value = word_hashes(data, starts, ends)
    order = np.lexsort((value, row))
    new = np.ones(len(row), bool)
    new[1:] = (value[order][1:] != value[order][:-1]) | (row[order][1:] != row[order][:-1])
    firsts = np.flatnonzero(new)
    runs = np.diff(np.append(firsts, len(row)))
    top = np.zeros(len(counts))
    np.maximum.at(top, row[order][firsts], runs)

    def per_row(flags: np.ndarray) -> np.ndarray:
        return np.diff(np.searchsorted(np.flatnonzero(flags), bounds))

    words, length = np.maximum(counts, 1), np.maximum(per_row(~BLANK[data]), 1)
    return np.column_stack([
        np.log1p(counts), found["word_chars"] / words, found["n_symbols"] / words,
        found["n_dup_lines"] / np.maximum(found["n_lines"], 1), found["n_repeat_words"] / words,
        found["n_upper"] / np.maximum(found["n_letters"], 1), per_row(_DIGIT[data]) / length,
        per_row(_PUNCTUATION[data]) / length, per_row(data >= 0x80) / length,
        np.bincount(row[order][firsts], minlength=len(counts)) / words, top / words,
        np.log1p(counts / np.maximum(found["n_lines"], 1)), (counts == 0).astype(float)])


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in slices(batches, "text"):
        values = features(part.column(1)).astype(np.float64)
        offsets = np.arange(0, values.size + 1, len(FEATURES), dtype=np.int32)
        yield pa.RecordBatch.from_arrays(
            [part.column(0), pa.ListArray.from_arrays(pa.array(offsets), pa.array(values.ravel()))],
            names=["doc_id", "features"])


@dataclass(frozen=True)
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    bias: float
    prior: float

    def expression(self, name: str = "features") -> str:
        """The score as column arithmetic."""
        def number(x) -> str:
            return f"cast('{float(x)!r}' AS double)"

        terms = [
            f"{number(w)} * greatest(-{CLIP}D, least({CLIP}D, ({name}[{i}] - {number(m)}) / {number(s)}))"
            for i, (w, m, s) in enumerate(zip(self.weights, self.mean, self.scale))]
        return f"1D / (1D + exp(-({' + '.join([number(self.bias), *terms])})))"


def _softplus(x: np.ndarray) -> np.ndarray:
    return np.logaddexp(0, x)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


def standardised(rows: np.ndarray, mean: np.ndarray, scale: np.ndarray) -> np.ndarray:
    """Held within the bound, with a one for the bias."""
    return np.hstack([np.clip((rows - mean) / scale, -CLIP, CLIP), np.ones((len(rows), 1))])


def loss_sums(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Rows, their loss as negatives, its gradient and the upper half of its second derivative, as sums."""
    z = x @ w
    s = _sigmoid(z)
    second = (x * (s * (1 - s))[:, None]).T @ x
    return np.concatenate([[len(x), _softplus(z).sum()], x.T @ s, second[np.triu_indices(x.shape[1])]])


class ArrayRows:
    """Unlabelled rows in memory."""

    def __init__(self, rows: np.ndarray):
        self.rows = rows

    def sums(self, mean, scale, weights: list[np.ndarray]) -> list[np.ndarray]:
        x = standardised(self.rows, mean, scale)
        return [loss_sums(x, w) for w in weights]

    def above(self, mean, scale, w: np.ndarray, marks: np.ndarray) -> np.ndarray:
        """How many rows have a score of each of the ascending marks or more."""
        scores = np.sort(standardised(self.rows, mean, scale) @ w)
        return len(scores) - np.searchsorted(scores, marks, "left")


class TableRows:
    """Unlabelled rows of a table with ``features``: every sum is over all of them.

    Tasks add up their own rows; the sums of tasks are added as decimals, so that
    their order makes no difference."""

    def __init__(self, table: DataFrame):
        self.table = table

    def _added(self, of_rows, size: int) -> np.ndarray:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = np.zeros(size)
            for batch in batches:
                rows = np.asarray(batch.column(0).flatten(), float).reshape(-1, len(FEATURES))
                for at in range(0, len(rows), 4096):
                    total += of_rows(rows[at:at + 4096])
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(size), pa.int32()), pa.array(total)], names=["k", "v"])

        parts = self.table.select("features").mapInArrow(run, "k int, v double")
        found = parts.groupBy("k").agg(F.expr("cast(sum(cast(v AS decimal(38, 10))) AS double) AS v")).collect()
        out = np.zeros(size)
        for row in found:
            out[row.k] = row.v
        return out

    def sums(self, mean, scale, weights: list[np.ndarray]) -> list[np.ndarray]:
        width = len(FEATURES) + 1
        each = 2 + width + width * (width + 1) // 2

        def of_rows(rows: np.ndarray) -> np.ndarray:
            x = standardised(rows, mean, scale)
            return np.concatenate([loss_sums(x, w) for w in weights])

        return list(self._added(of_rows, each * len(weights)).reshape(len(weights), each))

    def above(self, mean, scale, w: np.ndarray, marks: np.ndarray) -> np.ndarray:
        def of_rows(rows: np.ndarray) -> np.ndarray:
            place = np.searchsorted(marks, standardised(rows, mean, scale) @ w, "right")
            return np.bincount(place, minlength=len(marks) + 1).astype(float)

        return self._added(of_rows, len(marks) + 1)[::-1].cumsum()[::-1][1:]


def _newton(rows, mean, scale, on_positives, allowed=lambda w, loss: True, ridge: float = 1e-4, rounds: int = 20) -> np.ndarray:
    """Minimise the unlabelled rows' mean loss as negatives plus ``on_positives``, which gives value,
    gradient and second derivative, by Newton's steps.

    Several lengths of a step are tried in one pass over the rows; the longest that
    lowers the risk and is ``allowed`` is taken."""
    width = len(mean) + 1
    upper = np.triu_indices(width)

    def risk(w: np.ndarray, sums: np.ndarray):
        value, gradient, second = on_positives(w)
        half = np.zeros((width, width))
        half[upper] = sums[2 + width:] / sums[0]
        whole = half + half.T - np.diag(np.diag(half))
        loss = sums[1] / sums[0]
        return (value + loss + 0.5 * ridge * w @ w, gradient + sums[2:2 + width] / sums[0] + ridge * w,
                second + whole + ridge * np.eye(width), loss)

    w = np.zeros(width)
    now = risk(w, rows.sums(mean, scale, [w])[0])
    for _ in range(rounds):
        step = -np.linalg.solve(now[2], now[1])
        if np.abs(step).max() < 1e-6:
            break
        tried = [w + step * 0.5 ** k for k in range(6)]
        for candidate, sums in zip(tried, rows.sums(mean, scale, tried)):
            found = risk(candidate, sums)
            if found[0] < now[0] and allowed(candidate, found[3]):
                gained, w, now = now[0] - found[0], candidate, found
                break
        else:
            break
        if gained < 1e-7:
            break
    return w


def estimate_prior(positive: np.ndarray, rows, mean: np.ndarray, scale: np.ndarray, least: float = 0.05) -> float:
    """The share of positives among the unlabelled rows.

    A model of positives against unlabelled ranks both.  From any rank up,
    unlabelled text holds at least prior times what positives hold, so the smallest
    ratio of the two shares bounds the prior; ranks that keep fewer than ``least`` of
    the positives are too noisy to be used.  Ranks are those of the positives, and all
    unlabelled rows are counted at each."""
    x = standardised(positive, mean, scale)

    def as_positives(w: np.ndarray):
        s = _sigmoid(-(x @ w))
        return (_softplus(-(x @ w)).mean(), -(x.T @ s) / len(x), (x * (s * (1 - s))[:, None]).T @ x / len(x))

    w = _newton(rows, mean, scale, as_positives, ridge=1e-3)
    p = np.sort(x @ w)
    at = p[:int(len(p) * (1 - least)) + 1]
    n = rows.sums(mean, scale, [w])[0][0]
    share_p = 1 - np.searchsorted(p, at, "left") / len(p)
    share_u = rows.above(mean, scale, w, at) / n
    slack = np.sqrt(1 / len(p)) + np.sqrt(1 / n)
    return float(np.clip(np.min((share_u + 0.5 * slack * share_p) / share_p), 0.01, 0.99))


def fit(positive: np.ndarray, rows, prior: float | None = None) -> Model:
    """Non-negative unbiased risk with the logistic loss.

    With it the risk of positives as positives less that of positives as negatives is
    linear, so the unbiased risk is convex: the unlabelled rows' loss as negatives, less
    the prior times the positives' mean score.  The remainder that has to stay at zero or above is the
    former less the prior times the positives' loss as negatives; steps that would take
    it below are shortened."""
    width = len(FEATURES) if isinstance(rows, TableRows) else rows.rows.shape[1]
    nothing = Model(np.zeros(width), np.ones(width), np.zeros(width), 0.0, 0.5)
    if not len(positive):
        return nothing
    # Centre and spread of trusted text, so that whatever is odd about other text stands out.
    mean, scale = positive.mean(axis=0), np.maximum(positive.std(axis=0), 1e-2)
    if not rows.sums(mean, scale, [np.zeros(width + 1)])[0][0]:
        return nothing
    prior = estimate_prior(positive, rows, mean, scale) if prior is None else prior
    x = standardised(positive, mean, scale)
    centre = x.mean(axis=0)

    def linear(w: np.ndarray):
        return -prior * centre @ w, -prior * centre, np.zeros((width + 1, width + 1))

    w = _newton(rows, mean, scale, linear, lambda w, loss: loss - prior * _softplus(x @ w).mean() >= 0)
    return Model(mean, scale, w[:-1], float(w[-1]), prior)


def score_quality(docs: DataFrame, labels: DataFrame, scratch: Scratch,
                  training: str = "crc32(cast(doc_id AS string)) % 3 <> 1", prior: float | None = None) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of (doc_id, text).

    Trusted are the training documents whose rows in ``labels`` (doc_id, quality)
    all say 1; unlabelled are training documents whatever their labels."""
    measured = scratch.table(
        docs.selectExpr("cast(doc_id AS bigint) AS doc_id", "coalesce(cast(text AS string), '') AS text")
        .mapInArrow(_measured, "doc_id bigint, features array<double>"), "features")
    lessons = measured.where(f"coalesce({training}, false)")
    trusted = labels.selectExpr("cast(doc_id AS bigint) AS _id", "quality").where("quality IS NOT NULL").groupBy("_id").agg(
        F.min("quality").alias("q")).where("q = 1").select("_id")

    known = lessons.join(trusted, F.col("doc_id") == F.col("_id"), "left_semi")
    picked = known.orderBy(F.expr("xxhash64(doc_id)"), "doc_id").limit(POSITIVES).select("features").toArrow()["features"]
    positive = np.asarray(picked.combine_chunks().flatten(), float).reshape(-1, len(FEATURES))
    model = fit(positive, TableRows(lessons), prior)
    return measured.selectExpr("doc_id", f"coalesce(NOT ({training}), false) AS held_out", f"{model.expression()} AS score").selectExpr(
        "*", "if(score >= 0.5D, 1, 0) AS predicted")
