"""Secret scans: candidate strings, then a random forest that removes false positives.

Candidates are runs of at least 16 characters of [A-Za-z0-9+/=_.~-] with a digit or with both cases, found by one numpy pass over
the bytes, and, whatever their length and characters, the values that follow a key word and an assignment sign. For each one the
forest sees its length, entropy and character classes, how likely its character transitions are in ordinary words, how much of it
dictionary words cover, whether it lies in a path, URL or e-mail address, and which words stand next to it.

The dictionary and the transitions are learned from all the texts at hand (``learn_language``): a word is in the dictionary if one in
500 of the texts that have words has it, and two at least. The forest is trained
from labelled findings: the caller's (``findings``: text, begin, end, label) or those that ``generated_findings`` makes from a fixed
seed after public formats of keys on the one side and of hashes, ids, numbers, paths and placeholders on the other, with words of the
dictionary. ``held_out_formats`` measures what it makes of formats that it was not trained on.

Defined results: null and empty texts have no findings; a candidate is judged in its own row alone, so repeated rows get equal
results; candidates don't overlap (an assigned value goes before a run); an empty table stays empty; other columns are kept by ``redact`` and ignored by ``scan``.
"""

from __future__ import annotations

import random
import re
import string
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import STEP_BYTES, map_batches, runs, save, small_batches, steps, table, utf8

SHORTEST = 16
MASK = "[REDACTED]"
_TOKEN = np.zeros(256, bool)
_TOKEN[[ord(c) for c in string.ascii_letters + string.digits + "+/=_-.~"]] = True
_KEY_WORDS = ("token", "secret", "password", "passwd", "pwd", "apikey", "api_key", "api-key", "access", "auth", "bearer", "credential", "private", "client_secret", "key", "signature")
_CLEAN_WORDS = ("sha1", "sha256", "md5", "commit", "checksum", "digest", "etag", "uuid", "guid", "revision", "integrity", "hash", "build", "version", "example", "sample", "placeholder", "dummy", "isbn", "phone", "order", "invoice", "card")
_PREFIXES = ("AKIA", "ASIA", "ghp_", "gho_", "ghs_", "github_pat_", "glpat-", "xoxb-", "xoxp-", "sk_live_", "rk_live_", "sk-", "AIza", "ya29.", "eyJ", "npm_", "SG.", "shpat_", "dop_v1_", "hf_")
_WORDS = frozenset("the of and to in is for that with this from not are was have you page index image file data user name content static assets docs test main source section article product news about article home public default value string example sample report order number index list view item group level system model table query".split())
_SYLLABLES = frozenset("th he in er an re on at en nd ti es or te of ed is it al ar st to nt ng se ha as ou io le ve co me de hi ri ro ic ne ea ra ce li ch ll be ma si om ur un ie ei sc ge ei ue os ad ci da la el au il eu ai ns".split())
_FEATURES = 31
#: The name before an assignment sign: a key word, perhaps with more parts behind it, closing marks and blanks.
_NAME = re.compile(rb"(?:" + b"|".join(re.escape(w.encode()) for w in sorted(_KEY_WORDS, key=len, reverse=True)) + rb")s?(?:[_.\-0-9][\w.\-]*)?[\"'`\])]*[ \t]*$", re.I)
#: An assignment sign and its value: quoted on one line, or up to white space or a quote.
_VALUE = re.compile(rb"[:=]+>?[ \t]*(?:\"([^\"\n]+)\"|'([^'\n]+)'|`([^`\n]+)`|[\"'`]?([^\s\"'`]+))")
_BARE = re.compile(rb"[:=]+>?[ \t]*[\"'`]?()()()([^\s\"'`]+)")
_BLANK = re.compile(rb"\s")


@dataclass(frozen=True)
class Language:
    """What ordinary words look like: the words themselves, and the mean log-likelihood of a letter after another."""

    words: frozenset[str]
    transitions: np.ndarray  # (27, 27): letters a to z and any other

    def likelihood(self, low: str) -> float:
        """Mean over the transitions between letters; 0 without any."""
        at = [min(max(ord(c) - 97, -1), 26) for c in low]
        pairs = [(a, b) for a, b in zip(at, at[1:]) if 0 <= a < 26 and 0 <= b < 26]
        return sum(self.transitions[p] for p in pairs) / len(pairs) if pairs else 0.0

    def coverage(self, token: str) -> int:
        """Letters in dictionary words of at least three letters; capitals inside begin a word, and a run that is no word may be two."""
        total = 0
        for piece in _PARTS.findall(token):
            low = piece.lower()
            if low in self.words:
                total += len(low)
            else:
                total += max((len(low) for k in range(3, len(low) - 2) if low[:k] in self.words and low[k:] in self.words), default=0)
        return total


_PARTS = re.compile(r"[A-Z]?[a-zà-ÿ]{2,}|[A-Z]{3,}")


_WORD = re.compile(r"[a-zà-ÿ]{3,20}(?![\w])")
_OTHER = re.compile(r"\W")

#: Words that a task counts before it hands its counts on.
COUNTED_WORDS = 200_000


def words_of(text: str, step: int = STEP_BYTES) -> set[str]:
    """Words of three to 20 letters; a long text goes in slices that end outside of words."""
    found, at = set(), 0
    while at < len(text):
        cut = _OTHER.search(text, at + step)
        stop = cut.end() if cut else len(text)
        found.update(_WORD.findall(text[at:stop].lower()))
        at = stop
    return found


def language_of(texts: Iterable[str], least: int = 2, rare: int = 500) -> Language:
    """From texts: words that ``least`` of them have, and one in ``rare`` of those with words, and transitions inside these words."""
    seen, n = Counter(), 0
    for t in texts:
        found = words_of(t)
        seen.update(found)
        n += bool(found)
    return _language([w for w, k in seen.items() if k >= least and k * rare >= n])


def _language(known: list[str]) -> Language:
    words = frozenset(known) | _WORDS
    counts = np.full((27, 27), 0.5)
    for w in sorted(words):
        at = [min(max(ord(c) - 97, 0), 26) if "a" <= c <= "z" else 26 for c in w]
        for a, b in zip(at, at[1:]):
            counts[a, b] += 1
    for pair in _SYLLABLES if not known else ():
        counts[ord(pair[0]) - 97, ord(pair[1]) - 97] += 5
    return Language(words, np.log(counts / counts.sum(1, keepdims=True) * 27))


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, n): how many texts have it; the empty word stands for the texts that have any."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[str] = Counter()
        flush = lambda: pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], ["word", "n"])
        for batch in batches:
            buf, offs = utf8(batch.column(0))
            for a, b in zip(offs.tolist(), offs[1:].tolist()):
                found = words_of(buf[a:b].tobytes().decode("utf-8", "replace"))
                if found:
                    seen.update(found)
                    seen[""] += 1
                if len(seen) > COUNTED_WORDS:
                    yield flush()
                    seen.clear()
        if seen:
            yield flush()

    small_batches(docs.sparkSession)
    counts = docs.select(docs["text"].cast("string").alias("text")).mapInArrow(run, "word string, n long")
    return counts.groupBy("word").agg(F.sum("n").alias("n"))


def learn_language(docs: DataFrame, least: int = 2, rare: int = 500) -> Language:
    """``language_of`` all the texts. The dictionary doesn't grow with their number: it has at most ``rare`` times as many words as a
    text has on average."""
    counts = save(word_counts(docs).filter((F.col("n") >= least) | (F.col("word") == "")), "words")
    n = counts.filter(F.col("word") == "").agg(F.sum("n")).first()[0] or 0
    known = counts.filter((F.col("word") != "") & (F.col("n") >= least) & (F.col("n") * rare >= n))
    return _language([r["word"] for r in known.select("word").collect()])


def assigned(buf: np.ndarray, offs: np.ndarray, low: int = 0, high: int | None = None, last: int = 0) -> list[tuple[int, int, int]]:
    """(begin of the name, begin, end) of each value that follows a key word and an assignment sign, in order and apart; of signs in
    [low, high) only, and behind ``last``."""
    found: list[tuple[int, int, int]] = []
    part = buf[low:high]
    signs = np.flatnonzero((part == 61) | (part == 58)) + low
    for p, r in zip(signs.tolist(), (np.searchsorted(offs, signs, "right") - 1).tolist()):
        head, tail = max(int(offs[r]), last, p - 80), int(offs[r + 1])
        if p < last or not (name := _NAME.search(before := buf[head:p].tobytes())):
            continue
        text = buf[p:tail].tobytes() if tail - p < 4096 else buf[p : p + 4096].tobytes()
        value = _VALUE.match(text)
        # A quoted sentence with an assignment or a run of its own is no value: its parts are judged.
        if value and not value[4] and _BLANK.search(body := value[value.lastindex]) and (b"=" in body or b":" in body or max(map(len, body.split())) >= SHORTEST):
            value = _BARE.match(text)
        if not value:
            continue
        if value.end() == 4096 and tail - p > 4096:  # a value longer than that: its end is looked for in the rest of its row
            value = _VALUE.match(buf[p:tail].tobytes()) or value
        a, b = value.span(value.lastindex)
        if value.lastindex == 4:
            body = value[4]
            if name.start() and before[name.start() - 1 : name.start()] in (b"?", b"&"):
                body = body.split(b"&", 1)[0]
            b = a + len(body.rstrip(b".,;)]}>"))
        if b > a:
            found.append((head + name.start(), p + a, p + b))
            last = p + b
    return found


def candidates(buf: np.ndarray, offs: np.ndarray, step: int = STEP_BYTES) -> tuple[np.ndarray, np.ndarray]:
    """Byte spans of the candidates of a UTF-8 buffer. One long text goes in slices that end with a line, or, where a line is longer
    than a slice, outside of runs of token characters."""
    if len(offs) > 2 or len(buf) <= step:
        return _candidates(buf, offs, assigned(buf, offs))
    parts, at, last = [], 0, 0
    while at < len(buf):
        stop = min(len(buf), at + step)
        if stop < len(buf):
            cut = np.flatnonzero(buf[at:stop] == 10)
            cut = cut if len(cut) else np.flatnonzero(~_TOKEN[buf[at:stop]])
            stop = at + int(cut[-1]) + 1 if len(cut) else stop
            while not len(cut) and stop < len(buf):
                cut = np.flatnonzero(~_TOKEN[buf[stop : stop + step]])
                stop = stop + int(cut[0]) + 1 if len(cut) else min(len(buf), stop + step)
        values = assigned(buf, offs, at, stop, last)
        inside = [(max(n, at) - at, max(a, at) - at, b - at) for n, a, b in values]
        if last > at:
            inside = [(0, -1, last - at), *inside]
        start, end = _candidates(buf[at:stop], np.array([0, stop - at]), inside)
        parts.append((start + at, end + at))
        last = values[-1][2] if values else last
        at = stop
    return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])


def _candidates(buf: np.ndarray, offs: np.ndarray, values: list[tuple[int, int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """Runs outside of the assigned values, and these (those that begin at -1 are only left out)."""
    if not len(buf):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    token = _TOKEN[buf]
    for name, _, stop in values:
        token[name:stop] = False
    values = [v for v in values if v[1] >= 0]
    start, end = runs(token, offs)
    long = end - start >= SHORTEST
    start, end = start[long], end[long]
    # Trailing full stops belong to the sentence, leading and trailing marks to the markup.
    for _ in range(3):
        trim = (end > start) & np.isin(buf[np.maximum(end - 1, 0)], [46, 45, 61, 95, 126])
        keep_padding = (buf[np.maximum(end - 1, 0)] == 61)
        end = end - (trim & ~keep_padding)
        start = start + ((end > start) & np.isin(buf[np.minimum(start, len(buf) - 1)], [46, 61, 126]))
    digit = np.concatenate([[0], np.cumsum((buf >= 48) & (buf <= 57))])
    upper = np.concatenate([[0], np.cumsum((buf >= 65) & (buf <= 90))])
    lower = np.concatenate([[0], np.cumsum((buf >= 97) & (buf <= 122))])
    has = lambda c: c[end] > c[start]
    ok = (end - start >= SHORTEST) & (has(digit) | (has(upper) & has(lower)))
    start = np.concatenate([start[ok], np.array([a for _, a, _ in values], np.int64)])
    order = np.argsort(start, kind="stable")
    return start[order], np.concatenate([end[ok], np.array([b for _, _, b in values], np.int64)])[order]


def describe(token: str, before: str, after: str, language: Language) -> list[float]:
    """Features of one candidate in its surroundings."""
    n = len(token)
    counts: dict[str, int] = {}
    for c in token:
        counts[c] = counts.get(c, 0) + 1
    entropy = -sum(v / n * np.log2(v / n) for v in counts.values())
    kinds = ["d" if c.isdigit() else "u" if c.isupper() else "l" if c.islower() else "o" for c in token]
    changes = sum(a != b for a, b in zip(kinds, kinds[1:]))
    low = token.lower()
    pieces = [p for p in "".join(c if c.isalpha() else " " for c in low).split() if p]
    covered = language.coverage(token)
    pairs = [a + b for a, b in zip(low, low[1:]) if a.isalpha() and b.isalpha()]
    ordinary = sum(p in _SYLLABLES for p in pairs) / max(1, len(pairs))
    near = before[-40:].lower()
    gap = near.rstrip(" \t\"'`")
    assigned = gap.endswith(("=", ":", "=>")) or (gap + " ").endswith(("is ", "= "))
    inside = token.split("=", 1)[0].lower() if "=" in token[:-2] else ""
    nearby = near + " " + inside
    letters = kinds.count("l") + kinds.count("u")
    return [
        n, entropy, kinds.count("d") / n, kinds.count("u") / n, kinds.count("l") / n, kinds.count("o") / n, changes / max(1, n - 1),
        covered / n, ordinary, language.likelihood(low), float(all(c in "0123456789abcdef" for c in low)), float(token.isdigit()), max(counts.values()) / n,
        token.count("/"), token.count("."), token.count("-"), float(any(token.startswith(p) for p in _PREFIXES)),
        float(assigned), float(any(w in nearby for w in _KEY_WORDS)), float(any(w in nearby for w in _CLEAN_WORDS)),
        float("://" in near[-12:] or near.endswith(("/", "www.", "?", "&"))), float(after[:1] == "@" or before[-1:] == "@"), float(after[:1] in ("/", "?")),
        float(before[-1:] in "\"'`" and after[:1] in "\"'`" and bool(before[-1:]) and bool(after[:1])), float(n in (32, 40, 64)), float(n == 36 and token.count("-") == 4),
        letters / n, len(pieces), float(low.endswith((".com", ".org", ".net", ".html", ".png", ".jpg", ".js", ".py", ".php"))), float("xxxx" in low or "1234" in low or "0000" in low), len(counts) / n,
    ]


# ---------------------------------------------------------------- forest


@dataclass
class Forest:
    """Trees as flat arrays: a leaf has feature -1 and its share of positives in ``value``."""

    feature: list[np.ndarray]
    cut: list[np.ndarray]
    left: list[np.ndarray]
    right: list[np.ndarray]
    value: list[np.ndarray]
    language: Language | None = None  # what the features were taken by

    def predict(self, x: np.ndarray) -> np.ndarray:
        total = np.zeros(len(x))
        for f, c, lt, rt, v in zip(self.feature, self.cut, self.left, self.right, self.value):
            at = np.zeros(len(x), np.int64)
            while True:
                inner = np.flatnonzero(f[at] >= 0)
                if not len(inner):
                    break
                node = at[inner]
                go = x[inner, f[node]] <= c[node]
                at[inner] = np.where(go, lt[node], rt[node])
            total += v[at]
        return total / max(1, len(self.feature))


def grow(x: np.ndarray, y: np.ndarray, trees: int = 40, depth: int = 9, least: int = 3, seed: int = 0) -> Forest:
    """Bootstrap rows per tree, sqrt(features) per split, Gini impurity."""
    rng = np.random.default_rng(seed)
    out = Forest([], [], [], [], [])
    tries = max(1, int(np.sqrt(x.shape[1])) + 1)
    for _ in range(trees):
        rows = rng.integers(0, len(x), len(x))
        feature, cut, left, right, value = [], [], [], [], []

        def node(idx: np.ndarray, level: int) -> int:
            me = len(feature)
            for a, v in ((feature, -1), (cut, 0.0), (left, 0), (right, 0), (value, float(y[idx].mean()))):
                a.append(v)
            if level == 0 or len(idx) < 2 * least or value[me] in (0.0, 1.0):
                return me
            best = (value[me] * (1 - value[me]) * len(idx) - 1e-9, -1, 0.0)
            for k in rng.permutation(x.shape[1])[:tries]:
                order = np.argsort(x[idx, k], kind="stable")
                v, t = x[idx[order], k], np.cumsum(y[idx[order]])
                n = np.arange(1, len(idx))
                ok = (v[:-1] < v[1:]) & (n >= least) & (len(idx) - n >= least)
                if not ok.any():
                    continue
                a, b = t[:-1] / n, (t[-1] - t[:-1]) / (len(idx) - n)
                impurity = np.where(ok, n * a * (1 - a) + (len(idx) - n) * b * (1 - b), np.inf)
                at = int(impurity.argmin())
                if impurity[at] < best[0]:
                    best = (impurity[at], int(k), (v[at] + v[at + 1]) / 2)
            if best[1] < 0:
                return me
            feature[me], cut[me] = best[1], best[2]
            go = x[idx, best[1]] <= best[2]
            if go.all():  # the middle of two neighbouring floats may be the upper one
                feature[me] = -1
                return me
            left[me] = node(idx[go], level - 1)
            right[me] = node(idx[~go], level - 1)
            return me

        node(rows, depth)
        for name, a, kind in (("feature", feature, np.int64), ("cut", cut, float), ("left", left, np.int64), ("right", right, np.int64), ("value", value, float)):
            getattr(out, name).append(np.array(a, kind))
    return out


SECRET_FORMATS, CLEAN_FORMATS = 12, 16


def generated_findings(n: int = 3000, seed: int = 7, language: Language | None = None, formats: tuple[tuple[int, ...], tuple[int, ...]] | None = None) -> list[tuple[str, int, int, int]]:
    """Labelled findings (text, begin, end, 1 for a secret) after public formats; ``formats``: only these numbers of formats of secrets
    and of others. Half of the words are made of syllables, half are from the ``language``, if there is one."""
    secret_kinds, clean_kinds = formats or (tuple(range(SECRET_FORMATS)), tuple(range(CLEAN_FORMATS)))
    vocabulary = sorted(w for w in language.words if w.isascii()) if language else []
    r = random.Random(seed)
    pick = lambda alphabet, k: "".join(r.choice(alphabet) for _ in range(k))
    hexa, b62, b64 = "0123456789abcdef", string.ascii_letters + string.digits, string.ascii_letters + string.digits + "+/"
    syl = sorted(_SYLLABLES)
    word = lambda: r.choice(vocabulary) if vocabulary and r.random() < 0.5 else "".join(r.choice(syl) for _ in range(r.randint(1, 4)))
    sentence = lambda: " ".join(word() for _ in range(r.randint(0, 6)))

    def secret() -> tuple[str, str]:
        kind = r.choice(secret_kinds)
        if kind == 0:
            return "", r.choice(["AKIA", "ASIA"]) + pick(string.ascii_uppercase + string.digits, 16)
        if kind == 1:
            return "", r.choice(["ghp_", "gho_", "ghs_", "glpat-", "npm_", "hf_", "sk_live_", "sk-", "AIza", "shpat_"]) + pick(b62, r.choice([20, 35, 36, 40]))
        if kind == 2:
            return "", "eyJ" + pick(b62, 17) + "." + "eyJ" + pick(b62, r.randint(30, 80)) + "." + pick(b62 + "-_", 43)
        if kind == 8:
            value = pick(b62 + "!@#$%^&*", r.randint(7, 15)) + r.choice(string.digits) + r.choice("!@#$%*7")
        elif kind == 9:
            value = pick(string.ascii_lowercase, r.choice([16, 20, 24, 32, 40]))
        elif kind == 10:
            value = word().capitalize() + r.choice("!@#$%_-") + pick(b62, r.randint(3, 12)) + r.choice("!@#$%:") + pick(string.digits, r.randint(1, 4))
        elif kind == 11:
            value = (word() + word())[:9] + pick(string.digits, r.randint(2, 4)) + r.choice(["", "!", "#", "$"])
        else:
            value = pick(r.choice([hexa, b62, b64, b62 + "-_"]), r.choice([20, 24, 32, 32, 40, 40, 40, 48, 64]))
        if r.random() < 0.1:
            value = value.upper()
        name = r.choice(["token", "TOKEN", "secret", "api_key", "API_KEY", "apikey", "password", "access_key", "auth", "client_secret", "private_key", "Bearer", "secret key", "credential"])
        return name + r.choice([" = ", "=", ": ", ' = "', "='", '": "', " "]), value

    def clean() -> tuple[str, str]:
        kind = r.choice(clean_kinds)
        if kind == 0:
            return r.choice(["sha256:", "commit ", "md5 ", "checksum: ", "etag: ", "revision ", "integrity hash ", "digest = ", "build "]), pick(hexa, r.choice([32, 40, 64]))
        if kind == 1:
            return r.choice(["", "uuid ", "id="]), "-".join(pick(hexa, k) for k in (8, 4, 4, 4, 12))
        if kind == 2:
            return r.choice(["https://", "http://www.", "/"]), "/".join(word() for _ in range(r.randint(3, 7))) + r.choice(["", ".html", ".png"]) + str(r.randint(0, 99))
        if kind == 3:
            return "", r.choice(["Index", "My", "Get"]) + "".join(word().capitalize() for _ in range(r.randint(2, 5)))
        if kind in (4, 10):
            return r.choice(["", "card ", "order ", "phone ", "no. "]), pick(string.digits, r.choice([16, 16, 18, 20]))
        if kind == 5:
            return r.choice(["token = ", "password: ", "api_key="]), r.choice(["xxxxxxxxxxxxxxxxxxxx1", "YOUR_API_KEY_HERE_1", "changeme-changeme-1", "1234567890123456", "example-" + word() + "-token1", "0000000000000000000"])
        if kind == 6:
            return "", word() + "." + word() + "." + pick(string.digits, 2)
        if kind == 7:
            return "", "-".join(word() for _ in range(r.randint(3, 6))) + "-" + str(r.randint(1, 2030))
        if kind == 8:
            return "data:image/png;base64,", pick(b64, r.randint(60, 200))
        if kind == 9:
            return "", f"{word()}.{r.randint(1, 99)}" + word() + "." + word() + "com"
        if kind >= 12:
            name = r.choice(["token", "secret", "api_key", "password", "Password", "key", "access", "auth", "signature", "private"]) + r.choice([" = ", "=", ": ", ": ", ' = "', "='"])
            if kind == 12:
                return name, r.choice([word(), word().capitalize(), word() + "." + word(), word() + "_" + word(), word() + "()", " ".join((word(), word()))])
            if kind == 13:
                return name, r.choice(["None", "null", "true", "false", "required", "string", "optional", "********", "<password>", "${PASSWORD}", "$TOKEN", "your_password", "changeme", "os.environ", "[REDACTED]", "{}", "...", "xxxxxxxx"])
            if kind == 14:
                return name, r.choice([pick(string.digits, r.randint(1, 6)), f"20{r.randint(10, 29)}-0{r.randint(1, 9)}-{r.randint(10, 28)}", r.choice(string.ascii_letters), f"{r.randint(1, 99)}.{r.randint(0, 9)}"])
            return name, word() + r.choice(["", "?", "!", "s", "'s"])
        return "", (word() + word() + word()).capitalize() + r.choice(["9", "A", "B2"])

    out = []
    for k in range(n):
        lead, value = secret() if k % 2 else clean()
        text = sentence()
        text += (" " if text else "") + lead
        begin = len(text)
        tail = '"' if lead.endswith('"') else "'" if lead.endswith("'") else r.choice(["", "", ".", ",", "@mail.example.com"]) if not k % 2 else r.choice(["", "", ";", ","])
        out.append((text + value + tail + " " + sentence(), begin, begin + len(value), k % 2))
    return out


def _described(findings: list[tuple[str, int, int, int]], language: Language) -> tuple[np.ndarray, np.ndarray]:
    x = [describe(t[a:b], t[max(0, a - 60) : a], t[b : b + 10], language) for t, a, b, _ in findings]
    return np.array(x).reshape(-1, _FEATURES), np.array([y for *_, y in findings], float)


def train(findings: list[tuple[str, int, int, int]], trees: int = 40, seed: int = 0, language: Language | None = None) -> Forest:
    """Fit on labelled findings (text, begin, end, label)."""
    language = language or language_of([])
    forest = grow(*_described(findings, language), trees, seed=seed)
    forest.language = language
    return forest


@lru_cache(1)
def default_forest() -> Forest:
    """From generated findings, without a corpus; the same at each call."""
    return train(generated_findings())


def fit(docs: DataFrame) -> Forest:
    """From findings generated with the words of ``docs``, and features by their language."""
    language = learn_language(docs)
    return train(generated_findings(language=language), language=language)


def held_out_formats(language: Language | None = None, folds: int = 4, n: int = 3000) -> dict[str, float]:
    """Precision and recall on formats left out of training, each once, at a threshold of a half."""
    language = language or language_of([])
    hit = found = true = 0
    for f in range(folds):
        inside = tuple(k for k in range(SECRET_FORMATS) if k % folds != f), tuple(k for k in range(CLEAN_FORMATS) if k % folds != f)
        outside = tuple(k for k in range(SECRET_FORMATS) if k % folds == f), tuple(k for k in range(CLEAN_FORMATS) if k % folds == f)
        forest = train(generated_findings(n, 7, language, inside), language=language)
        x, y = _described(generated_findings(n // folds, 8, language, outside), language)
        said = forest.predict(x) >= 0.5
        hit, found, true = hit + int((said & (y == 1)).sum()), found + int(said.sum()), true + int(y.sum())
    return {"precision": hit / max(1, found), "recall": hit / max(1, true)}


def judge(buf: np.ndarray, offs: np.ndarray, forest: Forest) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Rows, byte spans and scores of a buffer's candidates."""
    start, end = candidates(buf, offs)
    language = forest.language or language_of([])
    row = np.searchsorted(offs, start, "right") - 1
    x = []
    for r, a, b in zip(row, start, end):
        text = lambda p, q: buf[max(p, offs[r]) : min(q, offs[r + 1])].tobytes().decode("utf-8", "ignore")  # noqa: B023, E731
        x.append(describe(text(a, b), text(a - 60, a), text(b, b + 10), language))
    return row, start, end, forest.predict(np.array(x).reshape(-1, _FEATURES))


_FINDING = "array<struct<begin:long,end:long,score:double>>"


def scan(docs: DataFrame, forest: Forest | None = None, threshold: float = 0.5, masked: bool = False) -> DataFrame:
    """(doc_id, n_candidates, n_secrets, max_score, findings[, masked]) per row.

    ``findings`` holds the UTF-8 byte spans judged secret, in order; ``masked`` the text with each of them replaced by MASK (a null
    text stays null).
    """
    shared = docs.sparkSession.sparkContext.broadcast(forest or default_forest())  # some thousand nodes, whatever the data's size

    def kernel(batch: pa.RecordBatch):
        whole, offs = utf8(batch.column(1))
        for i, j in steps(offs):
            buf, at = whole[offs[i] : offs[j]], offs[i : j + 1] - offs[i]
            row, start, end, p = judge(buf, at, shared.value)
            n = j - i
            hit = p >= threshold
            per_row = np.bincount(row[hit], minlength=n)
            bounds = np.concatenate([[0], np.cumsum(per_row)])
            top = np.zeros(n)
            np.maximum.at(top, row, p)
            spans = pa.StructArray.from_arrays([pa.array(start[hit] - at[row[hit]]), pa.array(end[hit] - at[row[hit]]), pa.array(p[hit])], ["begin", "end", "score"])
            out = {"doc_id": batch.column(0).slice(i, n), "n_candidates": pa.array(np.bincount(row, minlength=n)), "n_secrets": pa.array(per_row), "max_score": pa.array(top), "findings": pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), spans)}
            if masked:
                texts = batch.column(1).slice(i, n)
                if hit.any():
                    values = texts.to_pylist()
                    for r in np.flatnonzero(per_row):
                        raw, parts, last = buf[at[r] : at[r + 1]].tobytes(), [], 0
                        for k in np.flatnonzero(hit & (row == r)):
                            parts += [raw[last : start[k] - at[r]], MASK.encode()]
                            last = end[k] - at[r]
                        values[r] = b"".join([*parts, raw[last:]]).decode()
                    texts = pa.array(values, pa.string())
                out["masked"] = texts
            yield pa.RecordBatch.from_arrays(list(out.values()), list(out))

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_candidates long, n_secrets long, max_score double, findings {_FINDING}" + ", masked string" * masked
    return map_batches(docs.select("doc_id", docs["text"].cast("string").alias("text")), kernel, schema)


def redact(docs: DataFrame, forest: Forest | None = None, threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs``, all columns kept, with secrets in ``text`` masked. One narrow pass over whole rows."""
    shared = docs.sparkSession.sparkContext.broadcast(forest or default_forest())
    place = docs.columns.index("text")

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            whole, offs = utf8(batch.column(place))
            values = None
            for i, j in steps(offs):
                buf, at = whole[offs[i] : offs[j]], offs[i : j + 1] - offs[i]
                row, start, end, p = judge(buf, at, shared.value)
                hit = np.flatnonzero(p >= threshold)
                for r in np.unique(row[hit]):
                    values = values or batch.column(place).to_pylist()
                    raw, parts, last = buf[at[r] : at[r + 1]].tobytes(), [], 0
                    for k in hit[row[hit] == r]:
                        parts += [raw[last : start[k] - at[r]], MASK.encode()]
                        last = end[k] - at[r]
                    values[i + r] = b"".join([*parts, raw[last:]]).decode()
            columns = batch.columns
            if values is not None:
                columns[place] = pa.array(values, pa.string())
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    small_batches(docs.sparkSession)
    return docs.mapInArrow(run, docs.schema)


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return scan(docs, fit(docs))
