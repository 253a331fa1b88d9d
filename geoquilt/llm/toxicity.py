"""Toxicity by logistic regression with a counterfactual penalty.

A text shows which words and word beginnings occur in it, hashed. Of these features those that
tell the labelled classes apart are kept, and the features of identity terms always are. In each
labelled text, every identity term among its words is exchanged for the others of its group, and
the features of the new sentence are computed; a text without such terms gets one inserted, and
that one exchanged. Squared differences of the log odds of a sentence and its counterpart are
added to the loss, so that a mention of a group by itself cannot move a score far.

Every text gets a score; null counts as empty, and an empty text has the score of the
intercept. Nothing but the text enters a score. Without labelled rows of both classes, every
score is the share of toxic rows (0 without rows). Rows that repeat a doc_id are scored by their
own text each and are one row in training; rows without an id are scored and never trained on. A
score of exactly the threshold is toxic. Empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geoquilt.llm.common import labelled_sample

#: Labelled rows that the model is fitted on, at most.
MAX_TRAINING = 12_000
THRESHOLD = 0.3
BUCKETS = 1 << 20
BEGINNINGS = (4, 5, 6, 7)
#: Features kept, the least number of texts with one, and the weights of the two penalties.
FEATURES, LEAST_TEXTS, RIDGE, COUNTERFACTUAL = 3000, 3, 2e-4, 1.0
#: 0: each row weighs the same; 1: each class does.
BALANCE = 0.5
STEPS = 400
REMEMBERED = 200_000

#: Groups of terms that name people; one of a group may stand for another.
IDENTITY = (
    ("women", "men", "girls", "boys", "transgender", "frauen", "männer", "femmes", "hommes", "mujeres", "hombres"),
    ("gay", "straight", "lesbian", "bisexual", "schwul", "lesbisch", "homosexuel", "homosexual"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists", "muslime", "christen", "juden"),
    ("musulmans", "chrétiens", "juifs", "musulmanes", "cristianos", "judíos"),
    ("black", "white", "asian", "latino", "african", "european", "arab", "indigenous"),
    ("immigrants", "refugees", "foreigners", "einwanderer", "flüchtlinge", "immigrés", "réfugiés", "inmigrantes"),
    ("disabled", "blind", "deaf", "elderly", "behinderte", "handicapés", "discapacitados"),
)

#: ASCII to lower case; what is no letter becomes a space. Other bytes stay.
_LETTERS = bytes(
    b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)


def words(text: str) -> list[bytes]:
    return text.encode().translate(_LETTERS).split()


def buckets(word: bytes) -> list[int]:
    """The hashed features of one word."""
    keys = [word] + [word[:k] + b"*" for k in BEGINNINGS if len(word) > k]
    return [xxhash.xxh3_64_intdigest(k) % BUCKETS for k in keys]


def features(sentence: list[bytes]) -> set[int]:
    return {b for w in set(sentence) for b in buckets(w)}


def _distinct(text: str) -> list[int]:
    return sorted(features(words(text)))


#: Identity terms as words of a text, and the group of each.
GROUPS = [[t.encode().translate(_LETTERS) for t in group] for group in IDENTITY]
GROUP_OF = {term: group for group in GROUPS for term in group}


def counterfactuals(text: str) -> list[list[int]]:
    """Features that go and features that come, in turn, for every exchange of one identity term
    of the text for another of its group. Without any, a term that follows from the text's hash
    is put in front, then exchanged for the next of its group."""
    own = words(text)
    shown = features(own)
    pairs = []
    for a in sorted(GROUP_OF.keys() & set(own)):
        pairs += [(shown, features([b if w == a else w for w in own])) for b in GROUP_OF[a] if b != a]
    if not pairs:
        chance = xxhash.xxh3_64_intdigest(text)
        group = GROUPS[chance % len(GROUPS)]
        at = (chance >> 16) % len(group)
        one, two = (shown.union(buckets(group[i % len(group)])) for i in (at, at + 1))
        pairs = [(shown, one), (one, two)]
    return [side for x, y in pairs for side in (sorted(x - y), sorted(y - x))]


@dataclass
class Model:
    weights: dict[int, float]
    intercept: float
    memory: dict[bytes, tuple[int, ...]] = field(default_factory=dict, repr=False)
    beginnings: dict[bytes, tuple[int, ...]] = field(default_factory=dict, repr=False)

    def _known(self, word: bytes) -> tuple[int, ...]:
        """The word's features that have weights; those of beginnings are looked up by them."""
        hit = [b] if (b := xxhash.xxh3_64_intdigest(word) % BUCKETS) in self.weights else []
        for k in BEGINNINGS:
            if len(word) <= k:
                break
            key = word[:k]
            if (of_key := self.beginnings.get(key)) is None:
                b = xxhash.xxh3_64_intdigest(key + b"*") % BUCKETS
                of_key = (b,) if b in self.weights else ()
                if len(self.beginnings) >= REMEMBERED:
                    self.beginnings.clear()
                self.beginnings[key] = of_key
            hit += of_key
        if len(self.memory) >= REMEMBERED:
            self.memory.clear()
        found = self.memory[word] = tuple(hit)
        return found

    def log_odds(self, text: str) -> float:
        memory, weights = self.memory, self.weights
        found = set()
        for word in set(words(text)):
            hit = memory.get(word)
            if hit is None:
                hit = self._known(word)
            if hit:
                found.update(hit)
        return self.intercept + sum(weights[b] for b in sorted(found))

    def score(self, text: str) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.log_odds(text), -30, 30))))


def select(rows: list[np.ndarray], y: np.ndarray) -> np.ndarray:
    """Features whose document frequencies differ most between the classes, in deviations."""
    count = np.zeros((2, BUCKETS), np.int32)
    for row, c in zip(rows, y, strict=True):
        count[int(c), row] += 1  # a row names each feature once
    n0, n1 = max((y == 0).sum(), 1), max((y == 1).sum(), 1)
    overall = (count[0] + count[1] + 1) / (n0 + n1 + 2)
    gap = count[1] / n1 - count[0] / n0
    z = np.abs(gap) / np.sqrt(overall * (1 - overall) * (1 / n0 + 1 / n1))
    z[count[0] + count[1] < LEAST_TEXTS] = 0
    order = np.lexsort((np.arange(BUCKETS), -z))[:FEATURES]
    return order[z[order] > 2]


def fit(rows: list[np.ndarray], y: np.ndarray, pairs: list[list[list[int]]], penalty: float = COUNTERFACTUAL) -> Model:
    """rows: the distinct features of each text; pairs: its counterfactuals()."""
    share = float(y.mean()) if len(y) else 0.0
    if not 0 < share < 1:
        return Model({}, float(np.log((share + 1e-6) / (1 - share + 1e-6))))
    seen: dict[bytes, int] = {}
    for i, row in enumerate(rows):  # copies count once
        seen.setdefault(row.tobytes() + bytes([int(y[i])]), i)
    kept = sorted(seen.values())
    rows, y = [rows[i] for i in kept], y[kept].astype(float)
    changes = [side for i in kept for side in pairs[i]]
    identity = [b for group in IDENTITY for t in group for b in buckets(t.encode().translate(_LETTERS))]
    chosen = np.unique(np.r_[select(rows, y), np.array(identity)])
    column = np.full(BUCKETS, -1)
    column[chosen] = np.arange(len(chosen))

    def sparse(sets):
        at = [column[s][column[s] >= 0] for s in sets]
        return np.repeat(np.arange(len(at)), [len(a) for a in at]), np.concatenate(at) if at else np.empty(0, int)

    r, c = sparse(rows)
    # features that go and features that come by turns, two entries a change
    changed, pc = sparse([np.array(x, np.int64) for x in changes])
    pr, ps = changed // 2, np.where(changed % 2 == 0, 1.0, -1.0)
    m = len(changes) // 2 if penalty else 0
    n, d = len(rows), len(chosen)
    # toxic rows are few, and to miss one is worse: together they weigh more than their share
    weight = np.where(y == 1, y.mean(), 1 - y.mean()) ** -BALANCE
    weight /= weight.mean()
    # A diagonal that bounds the curvature from above: every row by its number of features. The
    # intercept is a feature of all rows.
    r, c = np.r_[r, np.arange(n)], np.r_[c, np.full(n, d)]
    filled = np.bincount(r, minlength=n)
    bound = 0.25 / n * np.bincount(c, (weight * filled)[r], minlength=d + 1) + RIDGE
    if m:
        moved = np.bincount(pr, minlength=m)
        bound += 2 * penalty / m * np.bincount(pc, moved[pr], minlength=d + 1)
    ridge = np.r_[np.full(d, RIDGE), 0.0]
    w = np.zeros(d + 1)
    w[d] = np.log(y.mean() / (1 - y.mean()))
    ahead, pace = w.copy(), 1.0
    for _ in range(STEPS):
        odds = np.bincount(r, ahead[c], minlength=n)
        error = weight * (1 / (1 + np.exp(-np.clip(odds, -30, 30))) - y) / n
        slope = np.bincount(c, error[r], minlength=d + 1) + ridge * ahead
        if m:
            change = np.bincount(pr, ahead[pc] * ps, minlength=m)
            slope += 2 * penalty / m * np.bincount(pc, ps * change[pr], minlength=d + 1)
        new = ahead - slope / bound
        if (ahead - new) @ (bound * (new - w)) > 0:  # the push points uphill: start afresh
            pace = 1.0
        grown = (1 + np.sqrt(1 + 4 * pace * pace)) / 2
        ahead, w, pace = new + (pace - 1) / grown * (new - w), new, grown
    return Model({int(f): float(x) for f, x in zip(chosen, w[:d], strict=True) if x}, float(w[d]))


def train(docs: DataFrame, labels: DataFrame, folds: int = 4, held: int = 2, bound: int = MAX_TRAINING) -> Model:
    """Fitted on at most `bound` labelled documents outside the held-out fold."""

    @F.pandas_udf("array<int>")
    def shown(text: pd.Series) -> pd.Series:
        return text.map(_distinct)

    @F.pandas_udf("array<array<int>>")
    def exchanged(text: pd.Series) -> pd.Series:
        return text.map(counterfactuals)

    sample = labelled_sample(docs, labels, "toxic", folds, held, bound)
    sample = sample.select("doc_id", "y", shown("text").alias("x"), exchanged("text").alias("pairs"))
    found = sample.toArrow().sort_by("doc_id").combine_chunks()
    lists = found.column("x").combine_chunks()
    flat, ends = lists.flatten().to_numpy(), np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))
    rows = [flat[a:b] for a, b in zip(np.r_[0, ends].astype(int)[:-1], ends.astype(int), strict=True)]
    return fit(rows, found.column("y").to_numpy(), found.column("pairs").to_pylist())


def score(model: Model, text: Column) -> Column:
    @F.pandas_udf("double")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield batch.map(model.score).astype(float)

    return scored(F.coalesce(text, F.lit("")))
