"""Toxicity by non-negative learning from positive and unlabelled text.

Confirmed toxic documents are the positives; the text of all training documents is
the unlabelled set, whatever its labels say. With the share of toxic text known (the
class prior, from the labelled rows), the risk on negatives is estimated as the risk
of the unlabelled set less the prior's part of the positives. Where that difference
turns negative, the step is taken the other way, so that the model cannot win by
learning the unlabelled texts by heart.

Features are the words (runs of letters) of the lower-cased text and their beginnings
of four to eight letters, as hashes; meeting one a second and a third time counts of
its own. The length of the text is a feature too, since a long text has any word
sooner by chance. Which words say something is counted: they must occur in a share of
the positives, and there more often than in all training documents beyond chance. The
linear model on these features is fitted in numpy on a bounded sample of rows.

Null and empty texts have no features and get the score of such a text. Without any
positive or without any label every score is 0. Rows without an id are scored and
never learnt from; several labels of an id count as toxic if one of them is. Rows that
repeat an id are documents each when features are counted. Long texts are read whole,
one at a time. Equal texts get equal scores, so there are no ties to break. An empty
table teaches nothing and gives no rows.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import islice
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from patronage.llm.common import Index, letters, parts, staged
from patronage.llm.suffixes import Rolling

THRESHOLD = 0.3
BEGINNINGS = (4, 5, 6, 7, 8)
#: Features 1 to 32 tell the length of a text, in powers of two words.
LENGTHS = 32
#: A word or beginning met once, twice and three times in a text are features of their own.
AGAIN = (0, 0x5851F42D4C957F2D, 0x14057B7EF767814F)
#: A feature must be in this share of the positives, and in as many documents at least.
LEAST_SHARE, LEAST_COUNT = 0.002, 3
#: Its excess in the positives must be this much less likely by chance (as a logarithm) than one in all candidates.
LEAST_ODDS = 2.0
#: The model keeps the most telling features, so many at most.
FEATURES = 8192
#: Bounds of the rows that the classifier is fitted on.
POSITIVES, UNLABELLED = 10_000, 20_000
KNOWN_PIECES = 200_000
#: Bytes of text that a worker takes apart at a time.
PART = 1_000_000
#: So many counts a task holds before it adds them up, and hands them on if still more than half.
HELD_COUNTS = 1_000_000
BASE = 0x9E3779B97F4A7C15


class Model(NamedTuple):
    features: np.ndarray  # sorted hashes
    weights: np.ndarray
    bias: float


class Features:
    """Features of texts; of all, or only those in a sorted array of hashes.

    Texts are split at white space; which words a piece such as ``rock'n'roll,`` holds
    is found once and remembered, up to a bound.
    """

    def __init__(self, wanted: np.ndarray | None = None):
        self.wanted = wanted
        self._forget()

    def _forget(self) -> None:
        self.index = Index()
        self.first = np.zeros(1, np.int64)  # where the words of a piece begin in the table
        self.table = np.zeros((1024, 1 + len(BEGINNINGS)), np.int64)  # with room for more words
        self.words = 0
        self.useful = np.zeros(0, bool)

    def _is_wanted(self, hashes: np.ndarray) -> np.ndarray:
        if self.wanted is None:
            return np.ones(hashes.shape, bool)
        if not len(self.wanted):
            return np.zeros(hashes.shape, bool)
        at = np.minimum(np.searchsorted(self.wanted, hashes), len(self.wanted) - 1)
        return self.wanted[at] == hashes

    def _learn(self) -> None:
        """Words, hashes and use of the pieces that are new."""
        pieces = list(islice(reversed(self.index), len(self.index) - len(self.first) + 1))[::-1]
        points = np.frombuffer("\n".join([*pieces, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
        edges = np.diff(np.concatenate(([0], letters()[points].view(np.int8), [0])))
        begin, end = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
        of = np.searchsorted(np.flatnonzero(points == 10), begin)  # pieces hold no line break
        counts = np.bincount(of, minlength=len(pieces))
        self.first = np.concatenate((self.first, self.first[-1] + np.cumsum(counts)))
        rolling = Rolling(points.astype(np.uint64) + np.uint64(1), BASE)
        table = np.zeros((len(begin), 1 + len(BEGINNINGS)), np.int64)
        table[:, 0] = rolling.of(begin, end).view(np.int64)
        for column, size in enumerate(BEGINNINGS, 1):
            longer = end - begin > size
            start = rolling.of(begin[longer], begin[longer] + size)
            table[longer, column] = (start ^ np.uint64(BASE)).view(np.int64)
        useful = np.zeros(len(begin), bool)
        for again in AGAIN:
            useful |= (self._is_wanted(table ^ again) & (table != 0)).any(axis=1)
        end = self.words + len(table)
        if end > len(self.table):
            grown = np.zeros((2 * end, self.table.shape[1]), np.int64)
            grown[:self.words] = self.table[:self.words]
            self.table = grown
        self.table[self.words:end] = table
        self.words = end
        self.useful = np.concatenate((self.useful, np.bincount(of[useful], minlength=len(pieces)) > 0))

    def of(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(text number, feature) pairs, each once, in order of both."""
        if len(self.index) > KNOWN_PIECES:
            self._forget()
        numbers, times = [], []
        for text in texts:
            pieces = Counter(text.lower().split()) if text else Counter()
            numbers.append(np.fromiter(map(self.index.__getitem__, pieces), np.int64, len(pieces)))
            times.append(np.fromiter(pieces.values(), np.int64, len(pieces)))
        self._learn()
        owner = np.repeat(np.arange(len(texts)), list(map(len, numbers)))
        number, time = np.concatenate([*numbers, np.zeros(0, np.int64)]), np.concatenate([*times, np.zeros(0, np.int64)])
        count = np.diff(self.first)[number]
        words = np.bincount(owner, time * count, minlength=len(texts)).astype(np.int64)
        lengths = np.array([min(n.bit_length(), LENGTHS) for n in words.tolist()], np.int64)
        keep = self.useful[number]
        number, time, owner, count = number[keep], time[keep], owner[keep], count[keep]
        ends = np.cumsum(count)
        row = np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - count - self.first[number], count)
        time, owner = np.repeat(time, count), np.repeat(owner, count)
        feature = self.table[row].ravel()
        text_number, time = np.repeat(owner, self.table.shape[1]), np.repeat(time, self.table.shape[1])
        order = np.lexsort((feature, text_number))
        feature, text_number, time = feature[order], text_number[order], time[order]
        new = np.ones(len(feature), bool)
        new[1:] = (feature[1:] != feature[:-1]) | (text_number[1:] != text_number[:-1])
        first = np.flatnonzero(new)
        time = np.add.reduceat(time, first) if len(first) else time
        feature, text_number = feature[first], text_number[first]
        filled = np.flatnonzero(lengths)
        features, owners = [lengths[filled]], [filled]
        for i, again in enumerate(AGAIN):
            real = (feature != 0) & (time > i)
            features.append(feature[real] ^ again)
            owners.append(text_number[real])
        feature, text_number = np.concatenate(features), np.concatenate(owners)
        keep = self._is_wanted(feature)
        feature, text_number = feature[keep], text_number[keep]
        order = np.lexsort((feature, text_number))
        return text_number[order], feature[order]


def _summed(features: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Every feature once, with the sum of its counts."""
    flat, number = np.concatenate(features), np.concatenate(counts)
    order = np.argsort(flat, kind="stable")
    flat, number = flat[order], number[order]
    first = np.flatnonzero(np.concatenate(([True], flat[1:] != flat[:-1])))
    return flat[first], np.add.reduceat(number, first)


def _counts(wanted: np.ndarray | None):
    """Documents per feature in a task, of the wanted features or of all; feature 0 counts the documents."""
    def rows(features: list[np.ndarray], counts: list[np.ndarray]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(list(map(pa.array, _summed(features, counts))), ["feature", "n"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = Features(wanted)
        features, counts, documents = [], [], 0
        for batch in batches:
            documents += batch.num_rows
            for texts in parts(batch.column(0), PART):
                new, number = np.unique(found.of(texts)[1], return_counts=True)
                features.append(new)
                counts.append(number)
                if sum(map(len, features)) > HELD_COUNTS:
                    feature, n = _summed(features, counts)
                    features, counts = [feature], [n]
                    if len(feature) > HELD_COUNTS // 2:
                        yield rows(features, counts)
                        features, counts = [], []
        yield rows([*features, np.zeros(1, np.int64)], [*counts, np.array([documents])])
    return count


def _rows_of(features: np.ndarray):
    """Places of the model's features in each text."""
    lookup = Features(features)

    def find(values: list[str | None]) -> list[np.ndarray]:
        owner, feature = lookup.of(values)
        at = np.searchsorted(features, feature)
        bounds = np.searchsorted(owner, np.arange(len(values) + 1))
        return [at[bounds[i]:bounds[i + 1]] for i in range(len(values))]
    return find


def nnpu(positive: list[np.ndarray], unlabelled: list[np.ndarray], prior: float, size: int, rounds: int = 400,
         rate: float = 0.05, decay: float = 1e-4, beta: float = 0.0) -> tuple[np.ndarray, float]:
    """Weights and bias of the non-negative estimator with the logistic loss, by Adam on all rows."""
    def flat(rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, int]:
        sizes = [len(row) for row in rows]
        return (np.concatenate([*rows, np.zeros(0, np.int64)]).astype(np.int64), np.repeat(np.arange(len(rows)), sizes),
                len(rows))

    parts = [flat(positive), flat(unlabelled)]
    theta = np.zeros(size + 1)
    theta[-1] = np.log(prior / (1 - prior))
    mean, square = np.zeros(size + 1), np.zeros(size + 1)

    def back(part: tuple, by_row: np.ndarray) -> np.ndarray:
        gradient = np.zeros(size + 1)
        gradient[:-1] = np.bincount(part[0], by_row[part[1]], minlength=size)
        gradient[-1] = by_row.sum()
        return gradient / part[2]

    for step in range(1, rounds + 1):
        chance, loss = [], []
        for part in parts:
            value = np.bincount(part[1], theta[:-1][part[0]], minlength=part[2]) + theta[-1]
            chance.append(1 / (1 + np.exp(-value)))
            loss.append(np.logaddexp(0, value).mean())  # the loss of calling a row negative
        excess = loss[1] - prior * loss[0]
        negative = back(parts[1], chance[1]) - prior * back(parts[0], chance[0])
        if excess < -beta:
            gradient = -negative
        else:
            gradient = negative - prior * back(parts[0], 1 - chance[0])
        gradient[:-1] += decay * theta[:-1]
        mean = 0.9 * mean + 0.1 * gradient
        square = 0.999 * square + 0.001 * gradient ** 2
        theta -= rate * (mean / (1 - 0.9 ** step)) / (np.sqrt(square / (1 - 0.999 ** step)) + 1e-8)
    # steps taken the other way lift all scores: move the bias so that the unlabelled rows score the prior on average
    value = np.bincount(parts[1][1], theta[:-1][parts[1][0]], minlength=parts[1][2])
    low, high = -50.0, 50.0
    for _ in range(60):
        middle = (low + high) / 2
        low, high = (middle, high) if (1 / (1 + np.exp(-value - middle))).mean() < prior else (low, middle)
    return theta[:-1], (low + high) / 2


def fit(training: DataFrame, doc_id: str, text: str, labels: DataFrame, label_id: str, toxic: str,
        prior: float | None = None, positives: int = POSITIVES, unlabelled: int = UNLABELLED,
        features: int = FEATURES) -> Model:
    """Learn from the documents of ``training`` and the labels of these documents.

    ``prior`` is the share of toxic documents; by default that of the labelled ones.
    ``positives`` and ``unlabelled`` bound the rows that the classifier is fitted on,
    drawn by a hash of id and text; rows that repeat both are drawn once. How frequent
    features are, in the positives and in all documents, is counted over all rows; the
    model keeps the ``features`` most telling ones.
    """
    texts = training.select(F.col(doc_id).alias("id"), F.col(text).alias("text")).filter("id IS NOT NULL")
    marks = (labels.select(F.col(label_id).alias("id"), F.col(toxic).alias("toxic")).filter("toxic IS NOT NULL")
             .groupBy("id").agg(F.max("toxic").alias("toxic")))
    labelled = staged(texts.select("id").join(marks, "id"), "labelled")
    found = labelled.agg(F.count("*").alias("n"), F.coalesce(F.sum("toxic"), F.lit(0)).alias("toxic")).first()
    nothing = Model(np.zeros(0, np.int64), np.zeros(0), -np.inf)
    if not found["toxic"]:
        return nothing
    prior = found["toxic"] / found["n"] if prior is None else prior
    prior = min(max(prior, 1e-4), 0.9)
    least = max(LEAST_COUNT, LEAST_SHARE * found["toxic"])

    def counted(rows: DataFrame, wanted: np.ndarray | None) -> dict[int, int]:
        sums = (rows.select("text").mapInArrow(_counts(wanted), "feature long, n long").groupBy("feature")
                .agg(F.sum("n").alias("n")))
        # of all features those in LEAST_SHARE of the texts: at most (features of a text) / LEAST_SHARE rows
        return {row["feature"]: row["n"] for row in (sums if wanted is not None else
                                                     sums.filter((F.col("n") >= least) | (F.col("feature") == 0))).collect()}

    # ids of the positives are few, so that Spark can broadcast them and the texts need no shuffle
    confirmed = staged(labelled.filter(F.col("toxic") == 1).select("id").distinct(), "confirmed")
    toxic_texts = texts.join(confirmed, "id", "left_semi")
    frequent = counted(toxic_texts, None)
    in_toxic = frequent.pop(0)
    candidates = np.array(sorted(feature for feature in frequent if not 0 < feature <= LENGTHS), np.int64)

    def surprise(wanted: np.ndarray) -> np.ndarray:
        """How unlikely the positives have a feature so often if they were like all documents (Poisson tail)."""
        elsewhere = counted(texts, wanted)  # as many rows as features wanted
        count = max(elsewhere.pop(0, 1), 1)
        usual = np.array([elsewhere.get(feature, 0) for feature in wanted.tolist()]) / count
        seen = np.array([frequent[feature] for feature in wanted.tolist()], float)
        expected = np.maximum(usual, 1 / count) * in_toxic
        return np.where(seen > expected, seen * np.log(seen / expected) - (seen - expected), 0.0)

    enough = np.log(max(len(candidates), 1)) + LEAST_ODDS
    found_odds = surprise(candidates)
    telling = candidates[np.argsort(-found_odds, kind="stable")[:np.count_nonzero(found_odds >= enough)]][:features]
    chosen = np.union1d(telling, np.arange(1, LENGTHS + 1))
    find = _rows_of(chosen)

    @F.arrow_udf("array<int>")
    def places(values: pa.Array) -> pa.Array:
        return pa.array([row.astype(np.int32) for texts in parts(values, PART) for row in find(texts)],
                        pa.list_(pa.int32()))

    def drawn(rows: DataFrame, bound: int) -> list[np.ndarray]:
        """Features of at most ``bound`` rows, in an order that does not depend on how rows are dealt out."""
        content = F.xxhash64("id", "text")
        different = rows.agg(F.approx_count_distinct(content, 0.02)).first()[0]
        draw = F.pmod(F.xxhash64(content, F.lit(7)), F.lit(1 << 30)).alias("draw")
        some = rows.filter(draw * max(different, 1) < float(bound) * (1 << 30)).select(
            draw, content.alias("content"), places("text").alias("row"))
        once = some.groupBy("draw", "content").agg(F.first("row").alias("row"))  # repeated rows are drawn alike
        taken = sorted(once.collect(), key=lambda row: (row["draw"], row["content"]))[:bound]
        return [np.array(row["row"], np.int64) for row in taken]

    # the classifier alone is fitted on a bounded number of rows
    rows = [drawn(toxic_texts, positives), drawn(texts, unlabelled)]
    if not rows[0] or not rows[1]:
        return nothing
    return Model(chosen, *nnpu(rows[0], rows[1], prior, len(chosen)))


def score(text: Column, model: Model) -> Column:
    """Chance that a text is toxic, 0 to 1."""
    find = _rows_of(model.features)

    @F.arrow_udf("double")
    def rate(values: pa.Array) -> pa.Array:
        sums = [float(model.weights[row].sum()) + model.bias for texts in parts(values, PART) for row in find(texts)]
        with np.errstate(over="ignore"):
            return pa.array(1 / (1 + np.exp(-np.array(sums, float))))

    return rate(text)
