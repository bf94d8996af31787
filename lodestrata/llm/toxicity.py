"""Toxicity by weak supervision.

1. Voters. Lexicon entries (words and word beginnings of 4 to 8 bytes) are picked by how much more often the bounded labelled sample
   has them, repeated, in toxic than in other texts, next to a small fixed word list. Each entry votes "toxic" when a text has it
   at least once, another voter when it has it twice; pattern voters look at the density, the variety and the repetition of hits;
   silence of all entries is a voter for "clean".
2. Label model. A generative model in which each voter depends on the class and on one other voter: the tree of the strongest
   dependencies given the class (conditional mutual information), learned with all rates by expectation-maximisation. A nested entry
   tells little beyond the voter it depends on, so it is not counted twice. The sample's labels are one more voter while the model is
   fitted, with rates that are estimated like any other's; the posteriors come from the lexicon and pattern voters alone. Rows without
   a label take part as well.
3. Classifier. A logistic regression on smooth features of the same hits is trained on the posteriors; it scores all texts.

Scoring is one narrow numpy pass: hashes of all words and beginnings are looked up in the sorted lexicon.

A text of more than ``STEP_BYTES`` is counted in slices that cut no word. Defined results: null and empty texts get the score of a text without any hit; without labelled rows only the fixed list counts;
equal texts get equal scores; repeated rows stay; an empty table stays empty; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import STEP_BYTES, Rolling, bounded_sample, crc_mod, hash_text, letter_slices, letters, map_batches, mix, row_of, steps, table, utf8

#: Fixed entries, in use whatever the labels say.
SEED_WORDS = ("idiot", "moron", "stupid", "scum", "loser", "trash", "worthless", "pathetic", "disgusting", "clown", "imbecile", "dumb", "vermin", "filth")
_LENGTHS = (0, 4, 5, 6, 7, 8)  # 0: the whole word; else a beginning of so many bytes


def _keys(roll: Rolling, start: np.ndarray, end: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of one kind of unit and the words that have it."""
    salt = np.uint64((0xD1B54A32D192ED03 * (length + 1)) & 0xFFFFFFFFFFFFFFFF)
    if not length:
        return mix(roll.spans(start, end) ^ salt), np.arange(len(start))
    has = np.flatnonzero(end - start >= length)
    return mix(roll.spans(start[has], start[has] + length) ^ salt), has


def word_key(word: str) -> int:
    salt = (0xD1B54A32D192ED03 * 1) & 0xFFFFFFFFFFFFFFFF
    return int(mix(np.array([hash_text(word.encode()) ^ salt], np.uint64))[0])


@dataclass
class Model:
    keys: np.ndarray  # sorted hashes of the lexicon's entries
    polarity: np.ndarray  # log-odds of each entry
    weights: np.ndarray
    bias: float


def hits(keys: np.ndarray, buf: np.ndarray, offs: np.ndarray, last: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(word, entry) of each match, each word's row, and words per row."""
    low, start, end = letters(buf, offs, last)
    row = row_of(offs, start)
    n = len(offs) - 1
    words, entries = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    if len(start) and len(keys):
        roll = Rolling(low)
        for length in _LENGTHS:
            found, who = _keys(roll, start, end, length)
            at = np.minimum(np.searchsorted(keys, found), len(keys) - 1)
            ok = keys[at] == found
            words.append(who[ok])
            entries.append(at[ok])
    return np.concatenate(words), np.concatenate(entries), row, np.bincount(row, minlength=n)


def counts(keys: np.ndarray, buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rows, entries) counts and words per row."""
    n = len(offs) - 1
    if n == 1 and len(buf) > STEP_BYTES:
        parts = [_counts(keys, buf[a:b], np.array([0, b - a]), int(buf[a - 1]) if a else 0) for a, b in letter_slices(buf)]
        return sum(p[0] for p in parts), sum(p[1] for p in parts)
    return _counts(keys, buf, offs)


def _counts(keys: np.ndarray, buf: np.ndarray, offs: np.ndarray, last: int = 0) -> tuple[np.ndarray, np.ndarray]:
    n = len(offs) - 1
    word, entry, row, size = hits(keys, buf, offs, last)
    flat = np.bincount(row[word] * len(keys) + entry, minlength=n * len(keys)) if len(keys) else np.zeros(0)
    return flat.reshape(n, len(keys)).astype(np.float64), size


def votes(count: np.ndarray, size: np.ndarray, polarity: np.ndarray) -> np.ndarray:
    """1 toxic, -1 clean, 0 no opinion."""
    toxic = count[:, polarity > 0]
    total, kinds = toxic.sum(1), (toxic > 0).sum(1)
    pattern = [
        np.where(total == 0, -1, 0),
        np.where(total >= 2, 1, 0),
        np.where(total >= 4, 1, 0),
        np.where(kinds >= 2, 1, 0),
        np.where(kinds >= 4, 1, 0),
        np.where(total * 100 >= np.maximum(size, 1), 1, np.where(total * 1000 < size, -1, 0)),
        np.where(toxic.max(1, initial=0) >= 3, 1, 0),
    ]
    return np.concatenate([(toxic >= 1).astype(int), (toxic >= 2).astype(int), np.stack(pattern, 1)], 1)


def features(count: np.ndarray, size: np.ndarray, polarity: np.ndarray) -> np.ndarray:
    toxic = count * (polarity > 0)
    strength = toxic @ np.clip(polarity, 0, 6)
    total, kinds = toxic.sum(1), (toxic > 0).sum(1)
    density = 100 * total / np.maximum(size, 1)
    own = np.stack([np.log1p(strength), np.log1p(total), total == 0, total == 1, total >= 2, np.log1p(kinds), np.minimum(density, 5), np.log1p(size) / 10], 1)
    return np.concatenate([own, np.minimum(np.log1p(toxic), 2)], 1)


class LabelModel:
    """Class -> voters in {-1, 0, 1}, each with the class and at most one other voter as parents."""

    def fit(self, vote: np.ndarray, label: np.ndarray, rounds: int = 20, relearn: int = 5) -> LabelModel:
        """``label``: 1, 0 or -1 for unknown. The tree is learned anew every ``relearn`` rounds; dependencies that chance would show among
        so many rows (10 / rows) are left out."""
        n, m = vote.shape
        least = 10 / max(n, 1)
        known = label >= 0
        self.prior = float(np.clip((label[known] == 1).mean(), 1e-3, 1 - 1e-3)) if known.any() else 0.1
        post = np.where(known, label, np.where((vote > 0).sum(1) > (vote < 0).sum(1), 0.5, self.prior * 0.5)).astype(np.float64)
        one_hot = (vote[:, :, None] == np.array([-1, 0, 1])).reshape(n, 3 * m).astype(np.float32)
        said = (label[:, None] == np.array([0, 1])).astype(np.float64)  # unknown: neither
        for k in range(rounds):
            joint = np.stack([((one_hot * p[:, None].astype(np.float32)).T @ one_hot).astype(np.float64).reshape(m, 3, m, 3) for p in (1 - post, post)])
            if k % relearn == 0:
                self._tree(joint, least)
            self._rates(joint)
            self.prior = float(np.clip(post.mean(), 1e-3, 1 - 1e-3))
            # The labels as a voter: how often it says 0 or 1 in either class.
            accuracy = np.stack([said.T @ (1 - post), said.T @ post]) + 1
            accuracy /= accuracy.sum(1, keepdims=True)
            self.label_rates = accuracy
            post = self.posterior(vote, said @ np.log(accuracy[1] / accuracy[0]))
        return self

    def _tree(self, joint: np.ndarray, least: float) -> None:
        """Parents by the maximum spanning tree of the voters' mutual information given the class."""
        m = joint.shape[1]
        both = joint.transpose(0, 1, 3, 2, 4) + 0.1  # class, j, k, value of j, value of k
        both /= both.sum((0, 3, 4), keepdims=True)
        j, k = both.sum(4, keepdims=True), both.sum(3, keepdims=True)
        y = j.sum(3, keepdims=True)
        self.dependence = (both * np.log(both * y / (j * k))).sum((0, 3, 4))
        np.fill_diagonal(self.dependence, 0)
        self.parent = np.full(m, -1)
        best, source = np.full(m, -1.0), np.full(m, -1)
        done = np.zeros(m, bool)
        for _ in range(m):
            at = int(np.where(done, -2, best).argmax())
            done[at] = True
            if best[at] >= least:
                self.parent[at] = source[at]
            closer = ~done & (self.dependence[at] > best)
            best[closer], source[closer] = self.dependence[at][closer], at

    def _rates(self, joint: np.ndarray) -> None:
        """Log-rates of each voter's value given the class and its parent's value: (class, voter, parent's value, value)."""
        m = joint.shape[1]
        every = np.arange(m)
        alone = joint[:, every, :, every, :].transpose(1, 0, 2, 3).diagonal(axis1=2, axis2=3) + 1.0
        alone /= alone.sum(2, keepdims=True)
        given = joint[:, self.parent, :, every, :].transpose(1, 0, 2, 3) + 2 * alone[:, :, None, :]
        given /= given.sum(3, keepdims=True)
        self.rates = np.log(np.where((self.parent >= 0)[None, :, None, None], given, alone[:, :, None, :]))

    def posterior(self, vote: np.ndarray, extra: np.ndarray | float = 0.0) -> np.ndarray:
        """Probability of the class 1 from the votes."""
        ratio = self.rates[1] - self.rates[0]
        above = np.where(self.parent >= 0, vote[:, self.parent], 0) + 1
        z = np.log(self.prior / (1 - self.prior)) + extra + sum(ratio[j, above[:, j], vote[:, j] + 1] for j in range(vote.shape[1]))
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _logistic(x: np.ndarray, y: np.ndarray, l2: float = 0.3, rounds: int = 40) -> tuple[np.ndarray, float]:
    """Newton steps on soft labels."""
    a = np.concatenate([x, np.ones((len(x), 1))], 1)
    w = np.zeros(a.shape[1])
    ridge = np.full(len(w), l2)
    ridge[-1] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + np.diag(ridge), a.T @ (y - p) - ridge * w)
        w += step * min(1.0, 5 / (np.abs(step).max() + 1e-12))
        if np.abs(step).max() < 1e-8:
            break
    return w[:-1], float(w[-1])


def _lexicon(texts: pa.Array, label: np.ndarray, entries: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys and log-odds of the units that mark toxic texts best, by the lower bound of their precision and their repetition."""
    buf, offs = utf8(texts)
    gathered: dict[int, list] = {length: [] for length in _LENGTHS}
    for i, j in steps(offs):
        at = offs[i : j + 1] - offs[i]
        low, start, end = letters(buf[offs[i] : offs[j]], at)
        row, roll = row_of(at, start) + i, Rolling(low)
        for length in _LENGTHS:
            found, who = _keys(roll, start, end, length)
            # A unit's times in a row: rows don't straddle steps, so each pair is complete here.
            both = mix(found ^ (row[who].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
            _, first, times = np.unique(both, return_index=True, return_counts=True)
            gathered[length].append((found[first], row[who[first]].astype(np.int32), times.astype(np.int32)))
    n1, n0 = max(int((label == 1).sum()), 1), max(int((label == 0).sum()), 1)
    keys, scores, odds = [], [], []
    for length in _LENGTHS:
        found, rows, times = (np.concatenate(x) for x in zip(*gathered.pop(length)))
        unit, back = np.unique(found, return_inverse=True)
        toxic = label[rows] == 1
        for least in (1, 2):
            ok = times >= least
            t = np.bincount(back, toxic & ok, len(unit))
            f = np.bincount(back, ~toxic & ok, len(unit))
            precision = (t + 0.1) / (t + f + 0.2) - 1.3 * np.sqrt(0.25 / (t + f + 1)) * (t + f < 30)
            gain = t / n1 - f / n0
            good = (t >= 4) & (t / n1 > 6 * (f + 0.3) / n0) & (precision > 0.35)
            keys.append(unit[good])
            scores.append(gain[good] * np.where(precision[good] > 0.8, 1.5, 1))
            odds.append(np.log(((t + 0.5) / (n1 + 1)) / ((f + 0.5) / (n0 + 1)))[good])
    keys, scores, odds = np.concatenate(keys), np.concatenate(scores), np.concatenate(odds)
    order = np.argsort(-scores, kind="stable")
    keys, odds = keys[order], odds[order]
    _, first = np.unique(keys, return_index=True)
    first = np.sort(first)[:entries]
    return keys[first], odds[first]


def train(texts: list[str | None], label: list[int], entries: int = 96) -> Model:
    y = np.array(label, np.int64)
    column = pa.array(texts, pa.string())
    keys, odds = _lexicon(column, y, entries) if len(y) else (np.zeros(0, np.uint64), np.zeros(0))
    fixed = np.array([k for k in map(word_key, SEED_WORDS) if k not in set(keys.tolist())], np.uint64)
    keys, odds = np.concatenate([keys, fixed]), np.concatenate([odds, np.full(len(fixed), 3.0)])
    order = np.argsort(keys)
    keys, odds = keys[order], odds[order]
    model = Model(keys, odds, np.zeros(8 + len(keys)), -3.0)
    model.weights[:3] = (1.5, 1.0, -1.0)
    if len(y) and 0 < y.sum() < len(y):
        buf, offs = utf8(column)
        parts = [counts(keys, buf[offs[i] : offs[j]], offs[i : j + 1] - offs[i]) for i, j in steps(offs)]
        count, size = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
        vote = votes(count, size, odds)
        model.weights, model.bias = _logistic(features(count, size, odds), LabelModel().fit(vote, y).posterior(vote))
    return model


def score_buffer(model: Model, buf: np.ndarray, offs: np.ndarray) -> np.ndarray:
    count, size = counts(model.keys, buf, offs)
    z = features(count, size, model.polarity) @ model.weights + model.bias
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit(docs: DataFrame, labels: DataFrame, train_rows: int = 6000, longest: int = 200_000) -> Model:
    """Train on at most ``train_rows`` labelled rows, the ones of smallest id hash, of texts of at most ``longest`` bytes; a document with
    several labels counts as toxic if one says so, of documents that share an id one text (the first in order) is used."""
    marks = bounded_sample(labels.filter("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic")), "doc_id", train_rows)
    texts = docs.filter(F.octet_length("text") <= longest).select("doc_id", "text").join(F.broadcast(marks), "doc_id")
    rows = texts.groupBy("doc_id").agg(F.min("text").alias("text"), F.first("toxic").alias("toxic")).select("text", "toxic").collect()
    rows.sort()
    return train([r["text"] for r in rows], [r["toxic"] for r in rows])


def score(docs: DataFrame, model: Model, threshold: float = 0.3) -> DataFrame:
    """(doc_id, score, predicted) for each row from its text alone."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # about a hundred entries, whatever the data's size

    def kernel(batch: pa.RecordBatch):
        buf, offs = utf8(batch.column(1))
        p = np.concatenate([score_buffer(shared.value, buf[offs[i] : offs[j]], offs[i : j + 1] - offs[i]) for i, j in steps(offs)])
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(p), pa.array((p >= threshold).astype(np.int32))], ["doc_id", "score", "predicted"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_batches(docs.select("doc_id", docs["text"].cast("string").alias("text")), kernel, f"doc_id {kind}, score double, predicted int")


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = fit(docs, labels.filter(crc_mod("doc_id", 4) != 2))
    return score(docs, model).select("doc_id", (crc_mod("doc_id", 4) == 2).alias("held_out"), "score", "predicted")
