"""Token counts with overlap resynchronisation.

The library is asked only for pieces that it provably cuts the same way inside the whole text.

* In texts of at most ``window`` characters: between a non-space and a white-space character the byte-level pre-tokenizer always
  ends a pre-token, whatever stands further left, so texts are spliced at those boundaries and each distinct piece is encoded once
  per task (a bounded memo).
* Pieces of ASCII and Latin letters (whose classes no Unicode version disputes) go through tiktoken with ranks made from the same
  .json: where every merge yields the next id, a pair can only be joined at rank r when all lower merges inside its bytes are
  done, so joining "any pair that spells a token" and joining "listed pairs" take the same course. ``Counter`` checks that
  premise when it loads the model and otherwise uses the library alone.
* A text that is longer than ``window`` characters, or has white space outside ASCII, is encoded in overlapping windows with
  offsets. Two neighbours are spliced at the first pre-token boundary that both show, far enough from
  the left window's end for look-ahead and special strings; from there both follow the same course, since matching runs left to
  right and depends on the position alone. When no boundary agrees the overlap is doubled, up to the rest of the text. Characters
  are decoded as the windows reach them, so memory doesn't grow with a text. ``n_windows`` says how many windows a text took (0:
  counted without), ``n_widened`` how often an overlap or a window had to grow.

Defined results: a null text counts as empty (0 tokens); repeated rows stay; an empty table stays empty; other columns are ignored.
"""

from __future__ import annotations

import codecs
import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import Memo, distinct_spans, gather, map_batches, row_of, steps, table, utf8

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: First bytes of the white space outside ASCII. Texts with such characters are spliced by windows alone.
_ODD_BYTES = np.zeros(256, bool)
_ODD_BYTES[[0xC2, 0xE1, 0xE2, 0xE3]] = True
#: Bytes of characters other than ASCII and U+00A1 to U+017F, whose classes are the same for either library.
_NOT_PLAIN = np.zeros(256, bool)
_NOT_PLAIN[0x1C:0x20] = True
_NOT_PLAIN[0xC6:] = True


def _odd_space(buf: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Which positions begin U+0085, U+00A0, U+1680, U+2000 to U+200A, U+2028, U+2029, U+202F, U+205F or U+3000 (a few neighbours count too)."""
    b1 = buf[np.minimum(at + 1, len(buf) - 1)]
    b2 = buf[np.minimum(at + 2, len(buf) - 1)]
    a = buf[at]
    return ((a == 0xC2) & ((b1 == 0x85) | (b1 == 0xA0))) | ((a == 0xE1) & (b1 == 0x9A) & (b2 == 0x80)) | ((a == 0xE2) & (b1 == 0x80) & ((b2 <= 0x8D) | (b2 == 0xA8) | (b2 == 0xA9) | (b2 == 0xAF))) | ((a == 0xE2) & (b1 == 0x81) & (b2 == 0x9F)) | ((a == 0xE3) & (b1 == 0x80) & (b2 == 0x80))



def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def _byte_letters() -> dict[str, int]:
    """The byte-level alphabet: which letter of the vocabulary stands for which byte."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


def rank_encoder(model: str):
    """A tiktoken encoding of the same vocabulary, or None if the .json doesn't meet the premise above."""
    import tiktoken

    with open(model, encoding="utf-8") as file:
        spec = json.load(file)
    pre, bpe = spec.get("pre_tokenizer") or {}, spec["model"]
    if spec.get("normalizer") or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True) or bpe.get("type") != "BPE" or bpe.get("ignore_merges") or bpe.get("dropout"):
        return None
    vocab, letters = bpe["vocab"], _byte_letters()
    special = {t["content"] for t in spec.get("added_tokens", [])}
    pairs = [m.split(" ") if isinstance(m, str) else m for m in bpe["merges"]]
    first = len(vocab.keys() - special) - len(pairs)
    if first != 256 or any(vocab.get(a + b) != first + k for k, (a, b) in enumerate(pairs)):
        return None
    ranks = {bytes(letters[c] for c in t): i for t, i in vocab.items() if t not in special}
    return tiktoken.Encoding("ranks", pat_str=_PATTERN, mergeable_ranks=ranks, special_tokens={})


class Characters:
    """Slices of a UTF-8 buffer by characters, decoded as far as asked for; what lies before ``forget`` is let go."""

    def __init__(self, buf: np.ndarray, step: int = 1 << 18):
        self.buf, self.step, self.read, self.base, self.text = buf, step, 0, 0, ""
        self.decoder = codecs.getincrementaldecoder("utf-8")()
        self.length = sum(int(np.count_nonzero((buf[k : k + step] & 0xC0) != 0x80)) for k in range(0, len(buf), step))

    def __len__(self) -> int:
        return self.length

    def __getitem__(self, at: slice) -> str:
        while self.base + len(self.text) < at.stop and self.read < len(self.buf):
            self.text += self.decoder.decode(self.buf[self.read : self.read + self.step].tobytes())
            self.read += self.step
        return self.text[at.start - self.base : at.stop - self.base]

    def forget(self, before: int) -> None:
        if before - self.base >= self.step:
            self.text, self.base = self.text[before - self.base :], before


class Counter:
    """Token counts of whole texts, exactly those of the library."""

    def __init__(self, model: str, window: int = 1 << 15, overlap: int = 256):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(model)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.window, self.overlap, self.memo = window, overlap, Memo(1)
        self.ranked = rank_encoder(model)
        if self.ranked:
            self.lengths = np.array([len(b) for b, _ in sorted(self.ranked._mergeable_ranks.items(), key=lambda x: x[1])], np.int64)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.margin = 2 + max([len(t) for t in self.special], default=0)

    def counts(self, buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Tokens of each row of a UTF-8 buffer; windows and widenings of each row."""
        n = len(offs) - 1
        out, used = np.zeros(n, np.int64), np.zeros((n, 2), np.int64)
        if not len(buf):
            return out, used
        if n == 1 and len(buf) > 4 * self.window:  # more than ``window`` characters, whatever they are
            out[0], *used[0] = self.long(Characters(buf))
            return out, used
        odd = np.flatnonzero(_ODD_BYTES[buf])
        odd = odd[_odd_space(buf, odd)]
        # A row's characters are its bytes but those that continue a character.
        chars = np.diff(np.concatenate([[0], np.cumsum((buf & 0xC0) != 0x80)])[offs])
        whole = np.union1d(row_of(offs, odd), np.flatnonzero(chars > self.window))
        start, row = self._cut(buf, offs)
        end = np.append(start[1:], len(buf))
        if len(whole):
            for r in whole:
                out[r], *used[r] = self.long(Characters(buf[offs[r] : offs[r + 1]]))
            keep = ~np.isin(row, whole)
            start, end, row = start[keep], end[keep], row[keep]
        if not len(start):
            return out, used
        hashes, index, inverse = distinct_spans(buf, start, end)
        if self.memo.full:
            self.memo.clear()
        known, rows = self.memo.find(hashes)
        size = rows[:, 0]
        s, e = start[index], end[index]
        regular = ~known & _SPACE[buf[s]] & ~_SPACE[buf[e - 1]] & (e - s <= self.window)
        if self.ranked:
            # A piece is plain unless a byte says otherwise; `<` may begin a special string.
            bad = np.cumsum(np.concatenate([[0], _NOT_PLAIN[buf] | ((buf == ord("<")) if self.special else False)]))
            regular &= bad[e] == bad[s]
        else:
            regular[:] = False
        if regular.any():
            rs, re_ = s[regular], e[regular]
            ids = self.ranked._core_bpe.encode_ordinary(gather(buf, rs, re_).decode())
            begins = np.cumsum(self.lengths[np.asarray(ids, np.int64)])  # each token's end; a piece owns the tokens that end in it
            size[regular] = np.diff(np.searchsorted(begins, np.concatenate([[0], np.cumsum(re_ - rs)]), "right"))
        others = np.flatnonzero(~regular & ~known)
        for at in range(0, len(others), 2048):
            texts = [buf[s[k] : e[k]].tobytes().decode() for k in others[at : at + 2048]]
            size[others[at : at + 2048]] = [len(e) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        self.memo.add(hashes[~known], size[~known, None])
        return out + np.bincount(row, size[inverse], n).astype(np.int64), used

    @staticmethod
    def _cut(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts of pieces: the rows' starts and every white-space byte behind another byte."""
        space = _SPACE[buf]
        first = space.copy()
        first[1:] &= ~space[:-1]
        first[offs[:-1][offs[:-1] < offs[1:]]] = True
        start = np.flatnonzero(first)
        return start, row_of(offs, start)

    def _encode(self, text: str) -> tuple[list[int], list[int]]:
        """Character position and running number of tokens at each pre-token's start."""
        e = self.tokenizer.encode(text, add_special_tokens=False)
        starts, before, last = [], [], object()
        for n, (word, (begin, _)) in enumerate(zip(e.word_ids, e.offsets)):
            if word != last or word is None:
                starts.append(begin)
                before.append(n)
                last = word
        return starts + [len(text)], before + [len(e.ids)]

    def long(self, text: Characters) -> tuple[int, int, int]:
        """The count by windows spliced at proven boundaries, the windows encoded, and how often one or its overlap was widened."""
        n, window = len(text), self.window
        at, total, starts_at, windows, widened = 0, 0, 0, 1, 0  # the current window begins at `at`; what counts in it begins at `starts_at`
        end = min(n, window)
        starts, before = self._encode(text[at:end])
        while end < n:
            overlap = self.overlap
            while True:
                begin = max(starts_at + 1, end - overlap)
                stop = min(n, max(end, begin) + window)
                windows += 1
                if begin >= end or overlap >= end - at:
                    stop = min(n, at + 2 * (end - at))  # no agreement in this window: widen it as a whole
                    starts, before = self._encode(text[at:stop])
                    end = stop
                    widened += 1
                    break
                s2, b2 = self._encode(text[begin:stop])
                right = {s + begin: b for s, b in zip(s2[:-1], b2)}
                safe = end - self.margin
                common = next(((s + at, b) for s, b in zip(starts[:-2], before) if begin < s + at <= safe and s + at in right), None)
                if common is None:
                    overlap *= 2
                    widened += 1
                    continue
                position, left = common
                total += left - self._before(starts, before, starts_at - at)
                at, starts_at, end, starts, before = begin, position, stop, s2, b2
                text.forget(at)
                break
        return total + before[-1] - self._before(starts, before, starts_at - at), windows, widened

    @staticmethod
    def _before(starts: list[int], before: list[int], position: int) -> int:
        return before[starts.index(position)] if position > 0 else 0


@lru_cache(1)
def counter(model: str, window: int) -> Counter:
    """One per Python worker, kept between its tasks."""
    return Counter(model, window)


def token_counts(docs: DataFrame, model: str, limit: int = 512, window: int = 1 << 15) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit, n_windows, n_widened) for each row; ``model`` is a tokenizers .json with a byte-level
    pre-tokenizer."""

    def kernel(batch: pa.RecordBatch, counter: Counter) -> Iterator[pa.RecordBatch]:
        buf, offs = utf8(batch.column(1))
        for i, j in steps(offs, 2 << 20):
            n, used = counter.counts(buf[offs[i] : offs[j]], offs[i : j + 1] - offs[i])
            columns = [batch.column(0).slice(i, j - i), *map(pa.array, (np.diff(offs[i : j + 1]), n, n > limit, used[:, 0], used[:, 1]))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_bytes", "n_tokens", "over_limit", "n_windows", "n_widened"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_bytes long, n_tokens long, over_limit boolean, n_windows long, n_widened long"
    return map_batches(docs.select("doc_id", docs["text"].cast("string").alias("text")), kernel, schema, lambda: counter(model, window))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"), default_model())
