"""Word-level language identification with a linear-chain conditional random field.

Each run of letters is a position of the chain. Its emission scores are sums of learned weights of hashed features: the word itself
(lexicon), prefixes and suffixes of one to four bytes (affixes) and all inner byte 2- and 3-grams; learned transitions tie
neighbouring words together, so foreign words inside a sentence are labelled in context. Marginals come from exact forward-backward,
run over a whole step of documents at once: the chain restarts at each document and is cut into blocks whose transition products
are chained, which gives the same marginals as going word by word.

Training (on the driver, from a bounded sample): documents' sentences of different languages are interleaved into code-switched
sequences, and the regularised log-likelihood is climbed by AdaGrad with the exact gradient. The sample's bounds are parameters.

A document's prediction is the label with the largest sum of word marginals, weighted by word length, and its score that label's
share. A text of more than ``STEP_BYTES`` goes through in slices twice: the first time for each slice's transition product, the second
with the exact messages from both sides, so the marginals are those of the whole chain and memory doesn't grow with the text.

Defined results: null texts and texts without a letter are ``und`` with score 0; without training rows every text is
``und``; repeated rows get equal results; ties go to the label first in code-point order; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import STEP_BYTES, Memo, Rolling, bounded_sample, crc_mod, distinct_spans, letter_slices, letters, map_batches, mix, row_of, small_batches, steps, table, utf8

UNDETERMINED = "und"
#: Words per block of the blocked forward-backward pass.
BLOCK = 112


@dataclass
class Model:
    labels: list[str]
    weights: np.ndarray  # (buckets, labels) float32
    transition: np.ndarray  # (labels, labels) scores from row to column
    start: np.ndarray

    @property
    def buckets(self) -> int:
        return len(self.weights)


def features(low: np.ndarray, start: np.ndarray, end: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Feature indices of each span, flat, and where each span's begin. A span's features follow from its bytes alone."""
    roll = Rolling(low)
    size = end - start
    parts, owners = [], []
    every = np.arange(len(start))

    def add(kind: int, who: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
        salt = np.uint64((0x9E3779B97F4A7C15 * (kind + 1)) & 0xFFFFFFFFFFFFFFFF)
        parts.append((mix(roll.spans(a, b) ^ salt) % np.uint64(buckets)).astype(np.int32))
        owners.append(who.astype(np.int32))

    add(0, every, start, end)
    for k in (1, 2, 3, 4):
        has = np.flatnonzero(size >= k)
        add(k, has, start[has], start[has] + k)
        add(10 + k, has, end[has] - k, end[has])
    for k in (2, 3):
        inner = np.maximum(size - k + 1, 0)
        who = np.repeat(every, inner)
        at = np.arange(len(who)) - np.repeat(np.cumsum(inner) - inner, inner) + start[who]
        add(20 + k, who, at, at + k)
    flat, owner = np.concatenate(parts), np.concatenate(owners)
    order = np.argsort(owner, kind="stable")
    counts = np.bincount(owner, minlength=len(start))
    return flat[order], np.cumsum(counts) - counts


def emissions(weights: np.ndarray, flat: np.ndarray, first: np.ndarray) -> np.ndarray:
    return np.add.reduceat(weights[flat], first, axis=0) if len(first) else np.zeros((0, weights.shape[1]), np.float32)


def _scaled(x: np.ndarray, axes: tuple[int, ...]) -> np.ndarray:
    return x / x.max(axis=axes, keepdims=True)


def marginals(score: np.ndarray, fresh: np.ndarray, transition: np.ndarray, start: np.ndarray, pairs: bool = False, before: np.ndarray | None = None, after: np.ndarray | None = None, product_only: bool = False):
    """Posterior of each position's label; with ``pairs`` also expected transition counts, start counts and the log-likelihood's
    normaliser. ``fresh`` marks the positions at which a chain begins. Inside a chain, ``before`` is the forward message of the position
    before and ``after`` the backward message of the last one; ``product_only`` gives the positions' transition product instead."""
    n, k = score.shape
    if not n:
        return np.eye(k) if product_only else (score, np.zeros((k, k)), np.zeros(k), 0.0) if pairs else score
    top = score.max(1, keepdims=True)
    a_top, s_top = transition.max(), start.max()
    a, s = np.exp(transition - a_top), np.exp(start - s_top)
    blocks = -(-n // BLOCK)
    e = np.ones((blocks * BLOCK, k))
    e[:n] = np.exp(score - top)
    new = np.zeros(blocks * BLOCK, bool)
    new[:n] = fresh
    live = np.zeros(blocks * BLOCK, bool)
    live[:n] = True
    e = np.ascontiguousarray(e.reshape(blocks, BLOCK, k).swapaxes(0, 1))
    new = np.ascontiguousarray(new.reshape(blocks, BLOCK).T)
    live = np.ascontiguousarray(live.reshape(blocks, BLOCK).T)

    def forward(x: np.ndarray, t: int) -> np.ndarray:
        """One step for row vectors (blocks, ..., labels)."""
        shape = (blocks,) + (1,) * (x.ndim - 1)
        moved = (x.reshape(-1, k) @ a).reshape(x.shape)
        at = new[t]
        if at.any():
            moved[at] = x[at].sum(-1, keepdims=True) * s
        moved *= e[t].reshape((blocks,) + (1,) * (x.ndim - 2) + (k,))
        return np.where(live[t].reshape(shape), moved, x) if not live[t].all() else moved

    product = np.broadcast_to(np.eye(k), (blocks, k, k)).copy()
    for t in range(BLOCK):
        product = _scaled(forward(product, t), (1, 2))
    if product_only:
        whole = np.eye(k)
        for b in range(blocks):
            whole = whole @ product[b]
            whole /= whole.max()
        return whole
    enter = np.empty((blocks, k))
    vector = np.full(k, 1.0 / k) if before is None else before
    for b in range(blocks):
        enter[b] = vector
        vector = vector @ product[b]
        vector /= vector.sum()
    leave = np.empty((blocks, k))
    vector = np.ones(k) if after is None else after
    for b in range(blocks - 1, -1, -1):
        leave[b] = vector
        vector = product[b] @ vector
        vector /= vector.max()
    alpha = np.empty((BLOCK, blocks, k))
    x = enter
    log_z = np.zeros((BLOCK, blocks)) if pairs else None
    for t in range(BLOCK):
        x = forward(x, t)
        total = x.sum(1, keepdims=True)
        if pairs:
            log_z[t] = np.log(total[:, 0])
        x = x / total
        alpha[t] = x
    out = np.empty((BLOCK, blocks, k))
    right_hand = np.empty((BLOCK, blocks, k)) if pairs else None
    beta = leave
    for t in range(BLOCK - 1, -1, -1):
        p = alpha[t] * beta
        out[t] = p / p.sum(1, keepdims=True)
        eb = e[t] * beta
        if pairs:
            right_hand[t] = eb
        moved = eb @ a.T
        at = new[t]
        if at.any():
            moved[at] = (eb[at] @ s)[:, None]
        moved = _scaled(moved, (1,))
        beta = np.where(live[t][:, None], moved, beta) if not live[t].all() else moved
    post = out.swapaxes(0, 1).reshape(-1, k)[:n]
    if not pairs:
        return post
    al = alpha.swapaxes(0, 1).reshape(-1, k)[:n]
    eb = right_hand.swapaxes(0, 1).reshape(-1, k)[:n]
    inner = np.flatnonzero(~fresh)
    inner = inner[inner > 0]
    left, right = al[inner - 1], eb[inner]
    weight = np.einsum("ni,ij,nj->n", left, a, right, optimize=True)
    moves = a * ((left / weight[:, None]).T @ right)
    z = log_z.T.reshape(-1)[:n].sum() + top.sum() + a_top * len(inner) + s_top * fresh.sum()
    return post, moves, post[fresh].sum(0), float(z)


def _switched(texts: list[str], labels: list[int], seed: int, longest: int) -> tuple[list[str], list[list[int]]]:
    """Code-switched sequences: runs of words of one text, then of another, until every text is used up."""
    rng = np.random.default_rng(seed)
    queue = [(t.split(), y) for t, y in zip(texts, labels)]
    rng.shuffle(queue)
    pieces, tags = [], []
    active: list[list] = []
    while queue or active:
        while queue and len(active) < 4:
            w, y = queue.pop()
            if w:
                active.append([w, 0, y])
        if not active:
            break
        sentence, sides = [], []
        for _ in range(int(rng.integers(1, 5))):
            if not active:
                break
            pick = int(rng.integers(len(active)))
            w, at, y = active[pick]
            n = int(rng.integers(3, longest))
            sentence.append(" ".join(w[at : at + n]))
            sides.append(y)
            active[pick][1] = at + n
            if at + n >= len(w):
                active.pop(pick)
        pieces.append(sentence)
        tags.append(sides)
    return pieces, tags


def train(texts: list[str], langs: list[str], buckets: int = 1 << 17, epochs: int = 12, rate: float = 0.35, l2: float = 1e-6, most_words: int = 250_000, seed: int = 0) -> Model | None:
    """Fit on labelled texts; ``most_words`` bounds the words used (texts are taken in the given order until it is reached)."""
    labels = sorted(set(langs))
    if not labels:
        return None
    used, total = 0, 0
    while used < len(texts) and total < most_words:
        total += len(texts[used].split())
        used += 1
    pieces, tags = _switched(texts[:used], [labels.index(x) for x in langs[:used]], seed, 40)
    flat = [p for s in pieces for p in s]
    side = np.array([y for s in tags for y in s], np.int64)
    heads = np.cumsum([0] + [len(s) for s in pieces])[:-1]
    buf, offs = utf8(pa.array(flat, pa.string()))
    low, start, end = letters(buf, offs)
    k = len(labels)
    if not len(start):
        return None
    piece = row_of(offs, start)
    gold = side[piece]
    sentence = np.searchsorted(heads, piece, "right")
    fresh = np.ones(len(start), bool)
    fresh[1:] = sentence[1:] != sentence[:-1]
    _, index, inverse = distinct_spans(low, start, end)
    feats, first = features(low, start[index], end[index], buckets)
    repeats = np.diff(np.append(first, len(feats)))
    weights = np.zeros((buckets, k), np.float32)
    transition, begin = np.zeros((k, k)), np.zeros(k)
    seen_w, seen_t, seen_s = np.zeros((buckets, k), np.float32), np.full((k, k), 1e-8), np.full(k, 1e-8)
    inner = np.flatnonzero(~fresh)
    moves_gold = np.zeros((k, k))
    np.add.at(moves_gold, (gold[inner - 1], gold[inner]), 1)
    starts_gold = np.bincount(gold[fresh], minlength=k)
    n = len(start)
    for _ in range(epochs):
        post, moves, starts, _ = marginals(emissions(weights, feats, first)[inverse].astype(np.float64), fresh, transition, begin, True)
        error = -post
        error[np.arange(n), gold] += 1
        for y in range(k):
            per_word = np.bincount(inverse, error[:, y], len(index))
            g = np.bincount(feats, np.repeat(per_word, repeats), buckets).astype(np.float32) / n - l2 * weights[:, y]
            seen_w[:, y] += g * g
            weights[:, y] += rate * g / np.sqrt(seen_w[:, y] + 1e-12)
        g = (moves_gold - moves) / n
        seen_t += g * g
        transition += rate * g / np.sqrt(seen_t)
        g = (starts_gold - starts) / n
        seen_s += g * g
        begin += rate * g / np.sqrt(seen_s)
    return Model(labels, weights, transition, begin)


#: Words from which on a text's unsure words speak against it; fewer may be unsure in any language.
_ENOUGH = 12


class Tagger:
    def __init__(self, model: Model, step: int = STEP_BYTES):
        self.model, self.step, self.memo = model, step, Memo(len(model.labels), dtype=np.float32)

    def scores(self, buf: np.ndarray, offs: np.ndarray, last: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Starts, ends and rows of the words of a UTF-8 buffer, and each word's emission scores."""
        low, start, end = letters(buf, offs, last)
        row = row_of(offs, start)
        if not len(start):
            return start, end, row, np.zeros((0, len(self.model.labels)))
        hashes, index, inverse = distinct_spans(low, start, end)
        if self.memo.full:
            self.memo.clear()
        known, rows = self.memo.find(hashes)
        fresh_words = index[~known]
        flat, first = features(low, start[fresh_words], end[fresh_words], self.model.buckets)
        rows[~known] = emissions(self.model.weights, flat, first)
        self.memo.add(hashes[~known], rows[~known])
        return start, end, row, rows[inverse].astype(np.float64)

    def words(self, buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Starts, ends and rows of the words of a UTF-8 buffer, and each word's label marginals."""
        start, end, row, score = self.scores(buf, offs)
        fresh = np.ones(len(start), bool)
        fresh[1:] = row[1:] != row[:-1]
        return start, end, row, marginals(score, fresh, self.model.transition, self.model.start)

    def _sums(self, buf: np.ndarray, offs: np.ndarray) -> np.ndarray:
        """(rows, 2, labels + 3): sums over a row's words and over its plain words: marginals by length, the largest marginal by length,
        length, and number. A word beside a digit isn't plain."""
        n, k = len(offs) - 1, len(self.model.labels)
        if n == 1 and len(buf) > self.step:
            return self._long(buf)
        start, end, row, post = self.words(buf, offs)
        return self._add(buf, offs, start, end, row, post, n)

    @staticmethod
    def _add(buf: np.ndarray, offs: np.ndarray, start: np.ndarray, end: np.ndarray, row: np.ndarray, post: np.ndarray, n: int, left: bool = False, right: bool = False) -> np.ndarray:
        k = post.shape[1]
        out = np.zeros((n, 2, k + 3))
        if not len(row):
            return out
        digit = np.concatenate([[False], (buf >= 48) & (buf <= 57), [False]])
        digit[0], digit[-1] = left, right
        plain = ~(((start > offs[row]) | left) & digit[start] | ((end < offs[row + 1]) | right) & digit[end + 1])
        size = (end - start).astype(np.float64)
        columns = [*(post[:, y] * size for y in range(k)), post.max(1) * size, size, np.ones(len(row))]
        for c, values in enumerate(columns):
            out[:, 0, c] = np.bincount(row, values, n)
            out[:, 1, c] = np.bincount(row[plain], values[plain], n)
        return out

    def _long(self, buf: np.ndarray) -> np.ndarray:
        """``_sums`` of one text in slices, by the messages of the whole chain."""
        model = self.model
        cuts = list(letter_slices(buf, self.step))
        products: list[np.ndarray | None] = []
        began = False
        for a, b in cuts:
            _, _, _, score = self.scores(buf[a:b], np.array([0, b - a]), int(buf[a - 1]) if a else 0)
            fresh = np.zeros(len(score), bool)
            fresh[:1] = not began
            products.append(marginals(score, fresh, model.transition, model.start, product_only=True) if len(score) else None)
            began |= len(score) > 0
        k = len(model.labels)
        after, vector = [np.ones(k)] * len(cuts), np.ones(k)
        for i in range(len(cuts) - 1, -1, -1):
            after[i] = vector
            if products[i] is not None:
                vector = products[i] @ vector
                vector = vector / vector.max()
        total, before, began = np.zeros((1, 2, k + 3)), np.full(k, 1.0 / k), False
        for i, (a, b) in enumerate(cuts):
            start, end, row, score = self.scores(buf[a:b], np.array([0, b - a]), int(buf[a - 1]) if a else 0)
            if not len(score):
                continue
            fresh = np.zeros(len(score), bool)
            fresh[0] = not began
            began = True
            post = marginals(score, fresh, model.transition, model.start, before=before, after=after[i])
            before = before @ products[i]
            before = before / before.sum()
            digit = lambda p: bool(0 <= p < len(buf) and 48 <= buf[p] <= 57)
            total += self._add(buf[a:b], np.array([0, b - a]), start, end, row, post, 1, digit(a - 1), digit(b))
        return total

    def documents(self, buf: np.ndarray, offs: np.ndarray) -> np.ndarray:
        """(rows, labels) shares of the words' marginals, weighted by length; zeros for rows without words."""
        return self._shares(self._sums(buf, offs)[:, 0])

    def _shares(self, sums: np.ndarray) -> np.ndarray:
        total = sums[:, : len(self.model.labels)]
        # A word's marginals depend in their last bits on where its blocks begin: equal texts get equal shares.
        return np.round(total / np.maximum(total.sum(1, keepdims=True), 1e-300), 9)

    def certainty(self, buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``documents`` and each row's certainty: 0 when its shares are even, whatever the number of labels, and 1 when one label
        has all. In rows of ``_ENOUGH`` words or more it falls with the square of how sure the words are, on the same scale: words of
        no known language may lean to one label together, but no single one is sure. Letter runs beside a digit (hashes, ids) are left
        out where a row has others. With one label nothing can be told: 1."""
        sums = self._sums(buf, offs)
        share, k = self._shares(sums[:, 0]), len(self.model.labels)
        if k < 2:
            return share, np.ones(len(share))
        used = np.where(sums[:, 1:2, -1] > 0, sums[:, 1], sums[:, 0])
        above = lambda x: np.clip((k * x - 1) / (k - 1), 0, 1)
        sure = used[:, k] / np.maximum(used[:, k + 1], 1)
        return share, above(self._shares(used).max(1)) * np.where(used[:, -1] >= _ENOUGH, above(sure) ** 2, 1)


def fit(docs: DataFrame, train_rows: int = 1500, key: str = "doc_id", longest: int = 200_000) -> Model | None:
    """Train on at most ``train_rows`` rows with a label and a text of at most ``longest`` bytes: as many of each language as far as it
    has them, the ones of smallest key hash."""
    rows = docs.filter((F.col("lang").isNotNull()) & (F.octet_length("text") <= longest)).select(key, "text", "lang")
    sample = bounded_sample(rows, key, train_rows, label="lang").collect()
    return train([r["text"] for r in sample], [r["lang"] for r in sample])


def predict(tagger: Tagger, buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Label and score of each row of a UTF-8 buffer."""
    return _labelled(tagger, buf, offs, tagger.documents(buf, offs))


def _labelled(tagger: Tagger, buf: np.ndarray, offs: np.ndarray, share: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    # Non-ASCII bytes need not be letters: texts without an ASCII letter are looked at one by one.
    if len(offs) == 2:
        some = np.array([any((((part := buf[a : a + STEP_BYTES] | 32) >= 97) & (part <= 122)).any() for a in range(0, len(buf), STEP_BYTES))])
    else:
        ascii_letter = ((buf | 32) >= 97) & ((buf | 32) <= 122)
        some = np.diff(np.concatenate([[0], np.cumsum(ascii_letter)])[offs]) > 0
    for r in np.flatnonzero(~some & (offs[1:] > offs[:-1])):
        some[r] = any(c.isalpha() for c in buf[offs[r] : offs[r + 1]].tobytes().decode())
    names = np.array(tagger.model.labels, object)
    return np.where(some, names[share.argmax(1)], UNDETERMINED), np.where(some, share.max(1), 0.0)


def identify(docs: DataFrame, model: Model | None) -> DataFrame:
    """(doc_id, lang_pred, score) for each row from its text alone."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    source = docs.select("doc_id", docs["text"].cast("string").alias("text"))
    if model is None:
        return source.select("doc_id", F.lit(UNDETERMINED).alias("lang_pred"), F.lit(0.0).alias("score"))
    shared = docs.sparkSession.sparkContext.broadcast(model)  # buckets x labels floats, whatever the data's size

    def kernel(batch: pa.RecordBatch, tagger: Tagger):
        buf, offs = utf8(batch.column(1))
        for i, j in steps(offs):
            pred, score = predict(tagger, buf[offs[i] : offs[j]], offs[i : j + 1] - offs[i])
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(pred.tolist(), pa.string()), pa.array(score)], ["doc_id", "lang_pred", "score"])

    return map_batches(source, kernel, f"doc_id {kind}, lang_pred string, score double", lambda: Tagger(shared.value))


def keep_identified(docs: DataFrame, model: Model | None, least: float = 0.15) -> DataFrame:
    """The rows of ``docs`` whose text has a language, by a certainty (see ``Tagger``) of at least ``least``; a null ``lang`` is filled
    in. All columns stay. Without a model nothing can be told and nothing goes but texts that are null or have no letter."""
    if model is None:
        return docs.filter(F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    text, lang = docs.columns.index("text"), docs.columns.index("lang")

    def run(batches):
        tagger = Tagger(shared.value)
        for batch in batches:
            if not batch.num_rows:
                continue
            buf, offs = utf8(batch.column(text))
            found = []
            for i, j in steps(offs):
                part, at = buf[offs[i] : offs[j]], offs[i : j + 1] - offs[i]
                share, sure = tagger.certainty(part, at)
                found.append((_labelled(tagger, part, at, share)[0], sure))
            pred, sure = (np.concatenate(x) for x in zip(*found))
            kept = pa.array((pred != UNDETERMINED) & (sure >= least))
            columns = batch.columns
            columns[lang] = pc.coalesce(columns[lang], pa.array(pred.tolist(), columns[lang].type))
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema).filter(kept)

    small_batches(docs.sparkSession)
    return docs.mapInArrow(run, docs.schema)


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit(docs.filter(crc_mod("doc_id", 3) != 1))
    return identify(docs, model).select("doc_id", (crc_mod("doc_id", 3) == 1).alias("held_out"), "lang_pred", "score")
