"""Toxicity by a support vector machine over a gap-weighted subsequence kernel, with Nystroem landmarks.

The kernel compares stretches of a sentence, of one to three neighbouring words, by the three-character subsequences
they share, spaces between words being characters too; each is weighted by decay ** (characters spanned), so an insult
with letters inserted or left out stays near the insult, and so does one of several words. Training reads labelled
documents by sentences and by multiple instances: a toxic document has a toxic stretch, a clean one has none. The first
stretches chosen are those of diverse density: in many toxic documents, between different neighbours, and in no clean
one. They are landmarks, with frequent clean ones, and a support vector machine over the landmarks takes turns with
choosing the toxic documents' stretches by its own margins. The
trained machine is a weighted sum over landmarks, kept as one weight for each subsequence, so that a text is scored in
one pass over its characters without visiting landmarks. A document's score is the calibrated margin of its most toxic
stretch and of the next one beside it.
"""

from __future__ import annotations

import pickle
from collections import Counter, defaultdict
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from netloom.llm.common import bounded_sample, ship, tune

ship(__name__)

#: Bounds of the sample of labelled rows that training reads: toxic documents, clean documents, bytes of text of each label.
TOXIC_SAMPLE, CLEAN_SAMPLE, SAMPLE_BYTES = 1000, 2500, 12 << 20
#: Bounds of what a machine is trained on: clean stretches drawn, frequent clean words, and hard clean stretches added in each round.
CLEAN_DRAWN, CLEAN_COMMON, CLEAN_HARD = 8_000, 1_500, 1_500
LANDMARKS, ROUNDS = 144, 3
#: Stretches of a toxic document that may be what makes it so.
WITNESSES = 5
DECAY, SPAN, WIDEST = 0.6, 7, 3
#: Words longer than this are cut into stretches of half of it.
LONGEST = 24
SEPARATOR = bytes([27])
LETTERS, SPACE = 64, 27  # 0 parts sentences, a-z are 1 to 26, other letters share the classes from 28 on
DROPPED, STOP, BREAK = 255, 254, 253  # marks within words; marks that end a sentence before white space; breaks of lines and sentences
#: Margins beyond this count as this in the calibration.
CLIP = 2.5
RIDGE = 0.5
THRESHOLD = 0.7
#: Characters that are scored at a time.
SLICE = 1 << 19


def character_classes() -> np.ndarray:
    """The class of every code point."""
    out = np.full(0x110000, DROPPED, np.uint8)
    for point in range(0x110000):
        c = chr(point)
        if c.isalpha():
            out[point] = 28 + point % 36
        elif c.isspace():
            out[point] = SPACE
    out[97:123] = np.arange(1, 27)
    out[[ord(c) for c in ".!?"]] = STOP
    out[[ord(c) for c in "\n\r\v\f  。！？"]] = BREAK
    return out


CLASSES: list[np.ndarray] = []


@dataclass
class Words:
    """The words of some texts: letters of all, and by word the first letter, the length, the sentence and the text."""

    letters: np.ndarray
    start: np.ndarray
    length: np.ndarray
    sentence: np.ndarray
    text: np.ndarray

    def cut(self, keep: np.ndarray) -> None:
        """Words that aren't kept become part of the word before."""
        self.start, self.sentence, self.text = self.start[keep], self.sentence[keep], self.text[keep]
        self.length = np.diff(np.append(self.start, len(self.letters)))


def words_of(texts: list[str]) -> Words:
    """What is left of words when marks and digits are dropped. Three words of one letter in a row, or more, are one word spelled out."""
    if not CLASSES:
        CLASSES.append(character_classes())
    low = [t.lower() + "\n" for t in texts]
    c = CLASSES[0][np.frombuffer("".join(low).encode("utf-32-le", "replace"), np.uint32)]
    after = np.append(c[1:], BREAK)
    parts = (c == BREAK) | ((c == STOP) & ((after == SPACE) | (after >= BREAK) & (after < DROPPED)))
    at = np.nonzero((c < BREAK) & (c != SPACE))[0]
    spaces, breaks = np.cumsum(parts | (c == SPACE), dtype=np.int32)[at], np.cumsum(parts, dtype=np.int32)[at]
    start = np.nonzero(np.diff(spaces, prepend=-1))[0]
    text = np.searchsorted(np.cumsum([len(t) for t in low]), at[start], side="right")
    out = Words(c[at], start, np.diff(np.append(start, len(at))), breaks[start], text)
    one = out.length == 1
    if one.any():
        joined = np.zeros(len(start) + 1, bool)  # with the word before
        joined[1:-1] = one[1:] & one[:-1] & (out.sentence[1:] == out.sentence[:-1])
        first, last = np.nonzero(one & ~joined[:-1])[0], np.nonzero(one & ~joined[1:])[0]
        first, last = first[last - first >= 2], last[last - first >= 2]
        inside = np.zeros(len(start) + 1, np.int32)
        np.add.at(inside, first + 1, 1)
        np.add.at(inside, last + 1, -1)
        out.cut(np.cumsum(inside)[:-1] == 0)
    if (out.length > LONGEST).any():
        times = np.where(out.length > LONGEST, -(-out.length // (LONGEST // 2)), 1)
        of = np.repeat(np.arange(len(times)), times)
        nth = np.arange(len(of)) - np.repeat(np.cumsum(times) - times, times)
        out.start = out.start[of] + nth * (LONGEST // 2)
        out.sentence, out.text = out.sentence[of], out.text[of]
        out.length = np.diff(np.append(out.start, len(out.letters)))
    return out


@dataclass
class Line:
    """Sentences in a row, a space before, between and behind words, and parted by more zeros than a subsequence spans."""

    codes: np.ndarray
    opens: np.ndarray  # by place: the word that a stretch from here begins with
    closes: np.ndarray  # the word that a stretch up to here ends with
    at: np.ndarray  # by word: the place of the space before it


def line_of(words: Words) -> Line:
    n = len(words.start)
    new = np.diff(words.sentence, prepend=-1) != 0
    last = np.append(new[1:], True)[:n]
    before = np.arange(n) + np.cumsum(new) * SPAN
    size = len(words.letters) + n + (int(new.sum()) + 1) * SPAN + 1
    codes, opens = np.zeros(size, np.int32), np.zeros(size, np.int32)
    at, ends = words.start + before, (words.start + words.length + before + 1)[last]
    codes[np.arange(len(words.letters)) + np.repeat(before, words.length) + 1] = words.letters
    codes[at] = codes[ends] = SPACE
    opens[at] = 1
    opens = np.cumsum(opens, dtype=np.int32) - 1
    closes = opens.copy()
    closes[at] -= 1
    closes[ends] = np.nonzero(last)[0]
    return Line(codes, opens, closes, at)


def gathered(codes: np.ndarray, span: int, weights: np.ndarray) -> np.ndarray:
    """By place, the decayed weights of the subsequences that start there and span ``span`` + 1 characters."""
    n = len(codes) - span
    first, third = codes[:n] * LETTERS**2 + codes[span:], codes * LETTERS
    out = np.zeros(n, np.float32)
    for middle in range(1, span):
        out += weights[first + third[middle : n + middle]]
    return out * np.float32(DECAY ** (span + 1))


def norm(letters: np.ndarray) -> np.ndarray:
    """Square root of the kernel of so many characters, bounding spaces not counted, with themselves when no subsequence repeats."""
    own = sum((d - 1) * np.maximum(letters + 2 - d, 0) * DECAY ** (2 * (d + 1)) for d in range(2, SPAN))
    return np.sqrt(np.maximum(own, DECAY**6))


def stretches(words: Words, weights: np.ndarray) -> np.ndarray:
    """Normalised kernel sums of the stretches of one word, two and three that begin with each word; -inf where a sentence has no more words."""
    line, n = line_of(words), len(words.start)
    if not n:
        return np.zeros((WIDEST, 0))
    by = np.zeros((WIDEST, len(line.codes)), np.float32)  # by place and by the words that the subsequence reaches into besides its first
    for span in range(2, SPAN):
        value = gathered(line.codes, span, weights)
        reach = line.closes[span:] - line.opens[: len(value)]
        for k in range(WIDEST):
            by[k, : len(value)] += np.where(reach == k, value, 0)
    own = np.add.reduceat(by, line.at, axis=1).astype(np.float64)
    out, raw, letters = np.full((WIDEST, n), -np.inf), np.zeros(n), np.zeros(n)
    for k in range(WIDEST):
        m = n - k
        if m <= 0:
            break
        raw, letters = raw[:m] + sum(own[k - j, j : j + m] for j in range(k + 1)), letters[:m] + words.length[k:] + (k > 0)
        out[k, :m] = np.where(words.sentence[:m] == words.sentence[k:], raw / norm(letters), -np.inf)
    return out


def strings(words: Words, firsts: np.ndarray, more: np.ndarray) -> list[bytes]:
    """Stretches as bytes of codes, the spaces around them included."""
    line = line_of(words)
    codes, ends = line.codes.astype(np.uint8), line.at[firsts + more] + words.length[firsts + more] + 2
    return [codes[a:b].tobytes() for a, b in zip(line.at[firsts].tolist(), ends.tolist(), strict=True)]


class Landmarks:
    """The subsequences of some stretches, each over its stretch's norm: a row for each that any of them has, a column a stretch."""

    def __init__(self, some: list[bytes]):
        own = [subsequences(s) for s in some]
        keys = np.unique(np.concatenate([k for k, _ in own]))
        self.row, self.table = np.zeros(LETTERS**3, np.int32), np.zeros((len(keys) + 1, len(some)), np.float32)
        self.row[keys] = np.arange(1, len(keys) + 1)
        for column, (k, v) in enumerate(own):
            np.add.at(self.table[:, column], self.row[k], v)

    def kernel(self, some: list[bytes]) -> np.ndarray:
        """Normalised kernel of stretches, given as bytes, with each landmark."""
        out = []
        for at in range(0, len(some), 1000):
            part = some[at : at + 1000]
            sizes = np.array([len(s) for s in part])
            codes = np.frombuffer(bytes(SPAN).join([*part, b""]), np.uint8).astype(np.int32)
            total = np.zeros((len(codes), self.table.shape[1]), np.float32)
            for span in range(2, SPAN):
                n = len(codes) - span
                for middle in range(1, span):
                    total[:n] += self.table[self.row[(codes[:n] * LETTERS + codes[middle : n + middle]) * LETTERS + codes[span:]]] * np.float32(DECAY ** (span + 1))
            out.append(np.add.reduceat(total, np.cumsum(sizes + SPAN) - sizes - SPAN, axis=0) / norm(sizes - 2)[:, None])
        return np.vstack(out).astype(float) if out else np.zeros((0, self.table.shape[1]))

    def weights(self, beta: np.ndarray) -> np.ndarray:
        """The landmarks' weighted sum, by subsequence."""
        return (self.table @ beta.astype(np.float32))[self.row]


def subsequences(stretch: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of a stretch's subsequences and their weights over its norm."""
    codes, keys, values = np.frombuffer(stretch, np.uint8).astype(np.int64), [], []
    for span in range(2, min(SPAN, len(codes))):
        n = len(codes) - span
        for middle in range(1, span):
            keys.append((codes[:n] * LETTERS + codes[middle : n + middle]) * LETTERS + codes[span:])
            values.append(np.full(n, DECAY ** (span + 1)))
    return np.concatenate([*keys, []]).astype(np.int64), np.concatenate([*values, []]) / norm(np.array([len(codes) - 2]))[0]


def cleared(weights: np.ndarray) -> np.ndarray:
    """Weights without those of subsequences that hold a break between sentences."""
    cube = weights.reshape(LETTERS, LETTERS, LETTERS)
    cube[0], cube[:, 0], cube[:, :, 0] = 0, 0, 0
    return weights


def evidence(margins: np.ndarray) -> np.ndarray:
    """What the calibration sees of the two largest margins: a second toxic stretch adds, its absence takes nothing away."""
    return np.stack([np.clip(margins[:, 0], -CLIP, CLIP), np.clip(margins[:, 1], 0, CLIP), np.ones(len(margins))], axis=1)


def best_of(found: np.ndarray, words: Words, n: int, many: int = 2) -> list[list[tuple[float, int, int]]]:
    """By text, its ``many`` largest stretches that share no word and differ in value: (value, first word, further words)."""
    out, best = [[] for _ in range(n)], found.max(axis=0)
    bounds = np.searchsorted(words.text, np.arange(n + 1)).tolist()
    for own, a, b in zip(out, bounds[:-1], bounds[1:], strict=True):
        if a == b:
            continue
        k = int(best[a:b].argmax())
        more = int(found[:, a + k].argmax())
        own.append((float(found[more, a + k]), a + k, more))
        rest = found[:, a:b].copy() if many > 1 else None
        while len(own) < many:
            for wide in range(WIDEST):
                rest[wide, max(0, k - wide) : k + more + 1] = -np.inf
            rest[np.abs(rest - own[-1][0]) <= 1e-4] = -np.inf
            more, k = divmod(int(rest.argmax()), b - a)
            if rest[more, k] == -np.inf:
                break
            own.append((float(rest[more, k]), a + k, more))
    return out


@dataclass
class Machine:
    weights: np.ndarray  # by subsequence
    bias: float
    slopes: np.ndarray  # of the calibration of a document's two largest margins, and its offset

    def margins(self, texts: list[str]) -> np.ndarray:
        """The two largest margins of each text; -inf where it has none."""
        words, out = words_of(texts), np.full((len(texts), 2), -np.inf)
        for row, own in zip(out, best_of(stretches(words, self.weights), words, len(texts)), strict=True):
            row[: len(own)] = [value for value, _, _ in own]
        return out + self.bias

    def scores(self, texts: list[str]) -> np.ndarray:
        """Scores of texts, in parts of SLICE characters at least; a longer one is cut at white space and its parts' margins put together."""
        pieces, owner = [], []
        for i, text in enumerate(texts):
            for part in cut(text):
                pieces.append(part)
                owner.append(i)
        best, at = np.full((len(texts), 2), -np.inf), 0
        while at < len(pieces):
            end, size = at, 0
            while end < len(pieces) and (end == at or size + len(pieces[end]) <= SLICE):
                size += len(pieces[end])
                end += 1
            for i, pair in zip(owner[at:end], self.margins(pieces[at:end]), strict=True):
                distinct = sorted({round(float(x), 4): x for x in (*best[i], *pair)}.values(), reverse=True)
                best[i] = (distinct + [-np.inf])[:2]
            at = end
        return 1 / (1 + np.exp(-np.clip(evidence(np.maximum(best, -CLIP)) @ self.slopes, -30, 30)))


def cut(text: str) -> list[str]:
    """A very long text in parts, each ending at white space where there is any."""
    out = []
    while len(text) > SLICE:
        at = max(text.rfind("\n", SLICE // 2, SLICE), text.rfind(". ", SLICE // 2, SLICE) + 1) + 1
        at = at if at > SLICE // 2 else text.rfind(" ", SLICE // 2, SLICE) + 1 or SLICE
        out.append(text[:at])
        text = text[at:]
    return [*out, text]


def squared_hinge(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 0.3) -> np.ndarray:
    """Weights of a linear support vector machine, the last one its bias, by Newton steps with halving."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w, keep = np.zeros(x.shape[1]), np.eye(x.shape[1]) * ridge
    keep[-1, -1] = 1e-6
    loss = lambda w: w @ keep @ w + (weight * np.maximum(1 - y * (x @ w), 0) ** 2).sum()
    now = loss(w)
    for _ in range(40):
        on = y * (x @ w) < 1
        a = x[on] * weight[on, None]
        step = np.linalg.solve(keep + a.T @ x[on], a.T @ y[on]) - w
        size = 1.0
        while size > 1e-4 and loss(w + size * step) > now:
            size /= 2
        w = w + size * step
        before, now = now, loss(w)
        if size <= 1e-4 or before - now < 1e-6 * before:
            break
    return w


def parted(texts: list[str]) -> list[list[str]]:
    """Texts in groups of SLICE characters, longer ones alone."""
    out, size = [[]], 0
    for t in texts:
        if out[-1] and size + len(t) > SLICE:
            out.append([])
            size = 0
        out[-1].append(t)
        size += len(t)
    return [g for g in out if g]


def key_of(ids: list[np.ndarray]) -> np.ndarray:
    """64-bit keys of words in a row, given by number."""
    key = np.full(len(ids[0]), len(ids), np.uint64)
    for own in ids:
        key = (key ^ own.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        key ^= key >> np.uint64(29)
    return key


def distinct(keys: np.ndarray) -> np.ndarray:
    keys = np.sort(keys)
    return keys[np.diff(keys, prepend=keys[:1] ^ np.uint64(1)) != 0]


@dataclass
class Clean:
    """What clean texts hold: words by number and how often, keys of all their stretches, and some stretches drawn from them."""

    number: dict[bytes, int]
    count: Counter
    keys: np.ndarray
    drawn: list[bytes]

    def has(self, stretch: bytes) -> bool:
        """Whether a clean text has the stretch, word by word."""
        ids = [self.number.get(SEPARATOR + w + SEPARATOR, -1) for w in stretch[1:-1].split(SEPARATOR)]
        key = key_of([np.array([i]) for i in ids])
        at = np.searchsorted(self.keys, key)[0]
        return min(ids) >= 0 and at < len(self.keys) and self.keys[at] == key[0]


def clean_stretches(texts: list[str], rng) -> Clean:
    number, count, keys, drawn, total = {}, Counter(), [], {}, sum(map(len, texts)) or 1
    for group in parted(texts):
        words = words_of(group)
        n = len(words.start)
        own = strings(words, np.arange(n), np.zeros(n, int))
        count.update(own)
        ids = np.array([number.setdefault(w, len(number)) for w in own])
        for more in range(min(WIDEST, n)):
            at = np.nonzero(words.sentence[: n - more] == words.sentence[more:])[0]
            keys.append(distinct(key_of([ids[at + k] for k in range(more + 1)])))
            pick = rng.permutation(at)[: round(CLEAN_DRAWN / WIDEST * sum(map(len, group)) / total)]
            drawn.update(dict.fromkeys(strings(words, pick, np.full(len(pick), more))))
    return Clean(number, count, distinct(np.concatenate([*keys, np.zeros(0, np.uint64)])), list(drawn))


def diverse(texts: list[str], clean: Clean, clean_texts: int) -> Counter:
    """The stretches of toxic texts that no clean text has, and between how many different neighbours each stands.

    So many neighbours are asked for that chance would leave less than one stretch; copies of a text have the same
    neighbours and count once. Of stretches that share a word the shorter one, then the more frequent one, stays.
    """
    number, parts = dict(clean.number), []
    for group in parted(texts):
        words = words_of(group)
        n = len(words.start)
        ids = np.array([number.setdefault(w, len(number)) for w in strings(words, np.arange(n), np.zeros(n, int))], int)
        sides = np.concatenate([[-1], ids, np.full(WIDEST, -1)])
        for more in range(min(WIDEST, n)):
            at = np.nonzero(words.sentence[: n - more] == words.sentence[more:])[0]
            key = key_of([ids[at + k] for k in range(more + 1)])
            new = ~np.isin(key, clean.keys)
            at, key = at[new], key[new]
            context = key_of([key, sides[at], sides[at + more + 2]])
            _, once = np.unique(context, return_index=True)
            parts.append((key[once], context[once], [ids[at[once] + k] for k in range(more + 1)]))
    if not parts:
        return Counter()
    names, between, seen = {v: k for k, v in number.items()}, Counter(), np.zeros(0, np.uint64)
    for more in range(WIDEST):
        own = [p for p in parts if len(p[2]) == more + 1]
        if own:
            key, context = (np.concatenate([p[i] for p in own]) for i in (0, 1))
            _, once = np.unique(context, return_index=True)
            _, first, n = np.unique(key[once], return_index=True, return_counts=True)
            of = [np.concatenate([p[2][k] for p in own])[once][first] for k in range(more + 1)]
            for i in np.nonzero(n > 1)[0] if (n > 1).any() or between else range(len(n)):
                between[SEPARATOR + SEPARATOR.join(names[int(w[i])][1:-1] for w in of) + SEPARATOR] = int(n[i])
    chance = len(texts) / (len(texts) + clean_texts)
    enough = min(int(np.ceil(np.log(len(between) + 1) / -np.log(chance))), max(between.values(), default=1))
    out, taken = Counter(), set()
    for stretch, n in sorted(between.items(), key=lambda x: (x[0].count(SEPARATOR), -x[1], x[0])):
        own = set(stretch[1:-1].split(SEPARATOR))
        if n >= enough and not own & taken:
            out[stretch] = n
            taken |= own
    return out


def witnesses(texts: list[str], weights: np.ndarray, bias: float, clean: Clean) -> Counter:
    """The stretches with margins above 0, WITNESSES of a text at most, that no clean text has, and between how many different neighbours they stand."""
    between = defaultdict(set)
    for group in parted(texts):
        words = words_of(group)
        n = len(words.start)
        own = [(first, more) for found in best_of(stretches(words, weights), words, len(group), WITNESSES) for value, first, more in found if value + bias > 0]
        if own:
            first, more = np.array(own).T
            sides = [strings(words, np.clip(at, 0, n - 1), np.zeros(len(own), int)) for at in (first - 1, first + more + 1)]
            for stretch, left, right in zip(strings(words, first, more), *sides, strict=True):
                between[stretch].add((left, right))
    return Counter({s: len(x) for s, x in between.items() if not clean.has(s)})


def hard_stretches(texts: list[str], weights: np.ndarray, bias: float, bar: float = -0.8) -> dict[bytes, float]:
    """The CLEAN_HARD stretches of clean texts with the largest margins above ``bar``."""
    out: dict[bytes, float] = {}
    for group in parted(texts):
        words = words_of(group)
        margins = stretches(words, weights) + bias
        for more in range(WIDEST):
            at = np.nonzero(margins[more] > bar)[0] if margins.size else np.zeros(0, int)
            at = at[np.argsort(-margins[more][at], kind="stable")[: 4 * CLEAN_HARD]]
            out.update(zip(strings(words, at, np.full(len(at), more)), margins[more][at].tolist(), strict=True))
        if len(out) > 4 * CLEAN_HARD:
            out = dict(sorted(out.items(), key=lambda x: (-x[1], x[0]))[: 2 * CLEAN_HARD])
    return dict(sorted(out.items(), key=lambda x: (-x[1], x[0]))[:CLEAN_HARD])


def inserted(stretch: bytes, rng) -> bytes:
    """The stretch with a letter more."""
    at = int(rng.integers(1, len(stretch)))
    return stretch[:at] + bytes([int(rng.integers(1, 27))]) + stretch[at:]


def train(texts: list[str], toxic: list[int], rounds: int = ROUNDS) -> Machine | None:
    """A machine from labelled texts; None if either label is missing or no toxic text has a letter.

    Where a session is active a task of its trains, so that what training takes is not added to the driver's memory.
    """
    spark = SparkSession.getActiveSession()
    if spark is None or len(set(toxic)) < 2:
        return trained(texts, toxic, rounds)
    held = pa.py_buffer(pickle.dumps((texts, toxic, rounds)))
    size, block = held.size, pa.compress(held, "zstd", asbytes=True)
    del held
    found = spark.sparkContext.parallelize([block], 1).map(lambda b: _fields(trained(*pickle.loads(pa.decompress(b, size, "zstd"))))).collect()[0]
    return Machine(*found) if found else None


def _fields(machine: Machine | None) -> tuple | None:
    """What a machine holds: a worker's class is not the driver's."""
    return machine and (machine.weights, machine.bias, machine.slopes)


def trained(texts: list[str], toxic: list[int], rounds: int = ROUNDS) -> Machine | None:
    """train() where it is called."""
    flags = np.array(toxic, bool)
    if not flags.any() or flags.all():
        return None
    # a quarter of either label calibrates: its words are as new to the machine as those of other documents
    rest = np.zeros(len(flags), bool)
    for flag in (True, False):
        rest[np.nonzero(flags == flag)[0][3::4]] = True
    bad = [t for t, f, out in zip(texts, flags, rest, strict=True) if f and not out]
    good = [t for t, f, out in zip(texts, flags, rest, strict=True) if not f and not out]
    rng = np.random.default_rng(7)
    clean = clean_stretches(good, rng)
    frequent = [w for w, _ in sorted(clean.count.items(), key=lambda x: (-x[1], x[0]))[:CLEAN_COMMON]]
    negative = list(dict.fromkeys([*frequent, *clean.drawn]))
    light = np.sqrt([clean.count.get(s, 1) for s in negative])
    times, machine = diverse(bad, clean, len(good)), None
    for turn in range(rounds):
        if turn:  # what the machine itself finds in toxic documents, and what it found before
            times = Counter({s: n for s, n in times.items() if margin[s] > 0})
            times.update({s: n for s, n in witnesses(bad, weights, bias, clean).items() if n > 1 and s not in times})
        if not times:
            return machine
        positive = sorted(times, key=lambda s: (-times[s], s))
        some = positive[: 2 * LANDMARKS // 3]
        some += [frequent[i] for i in sorted(rng.permutation(len(frequent))[: LANDMARKS - len(some)])]
        marks = Landmarks(some)
        value, vector = np.linalg.eigh(marks.kernel(some) + 1e-3 * np.eye(len(some)))
        root = vector / np.sqrt(np.maximum(value, 1e-2)) @ vector.T
        heavy = np.sqrt([times[s] for s in positive])
        x = np.vstack([marks.kernel(positive), marks.kernel([inserted(s, rng) for s in positive for _ in range(2)]), marks.kernel(negative)]) @ root
        heavy = np.concatenate([heavy, np.repeat(heavy / 2, 2)])
        y = np.concatenate([np.ones(len(heavy)), -np.ones(len(negative))])
        w = squared_hinge(x, y, np.concatenate([heavy / heavy.sum(), 4 * light / light.sum()]) * 10_000)
        weights, bias = cleared(marks.weights(root @ w[:-1])), float(w[-1])
        machine = Machine(weights, bias, np.zeros(3))
        if turn < rounds - 1:
            margin = dict(zip(positive, (x[: len(positive)] @ w[:-1] + bias).tolist(), strict=True))
            fresh = [s for s in hard_stretches(good, weights, bias) if s not in set(negative)]
            negative, light = negative + fresh, np.concatenate([light, np.full(len(fresh), 5.0)])
    if flags[rest].all() or not flags[rest].any():
        rest[:] = True
    some = [t for t, out in zip(texts, rest, strict=True) if out]
    top = np.maximum(np.vstack([machine.margins(g) for g in parted(some)]), -CLIP)
    machine.slopes = calibrated(top, flags[rest])
    return machine


def calibrated(top: np.ndarray, flags: np.ndarray) -> np.ndarray:
    """Logistic regression of the label on the two largest margins; its prior says that one strong stretch is enough where the sample is too small to tell."""
    prior = np.array([1.8, 1.8, -3.2])
    fit, x, sign = prior.copy(), evidence(top), np.where(flags, 1.0, -1.0)
    loss = lambda w: np.logaddexp(0, -sign * (x @ w)).sum() + RIDGE / 2 * ((w - prior) ** 2).sum()
    for _ in range(50):
        q = 1 / (1 + np.exp(-np.clip(x @ fit, -30, 30)))
        step = np.linalg.solve(x.T @ (x * (q * (1 - q))[:, None]) + RIDGE * np.eye(3), x.T @ (flags - q) - RIDGE * (fit - prior))
        size = 1.0
        while size > 1e-6 and loss(fit + size * step) > loss(fit):
            size /= 2
        fit = fit + size * step
    return np.array([max(fit[0], 1e-3), max(fit[1], 0.0), fit[2]])


def held_out(doc_id="doc_id"):
    """Whether a row is never learnt from; false for a row without an id, which no label names."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 3 == 1, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame) -> Machine | None:
    """A machine from labelled rows that aren't held out: at most TOXIC_SAMPLE and CLEAN_SAMPLE, and SAMPLE_BYTES of whole texts of either label.

    An id with several labels is toxic if one of them says so; one with several texts is read by the first of them in
    order. Texts are taken in the order of a hash of their ids, those that don't fit any more are left out.
    """
    known = labels.where("toxic is not null and doc_id is not null").where(~held_out())
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    chosen = bounded_sample(known.where("toxic = 1"), "doc_id", TOXIC_SAMPLE).unionByName(bounded_sample(known.where("toxic = 0"), "doc_id", CLEAN_SAMPLE))
    rows = docs.select(F.col("doc_id").cast("long"), "text").join(F.broadcast(chosen), "doc_id")
    rows = rows.groupBy("doc_id", "toxic").agg(F.coalesce(F.min("text"), F.lit("")).alias("text")).withColumn("order", F.xxhash64("doc_id"))
    rows = rows.withColumn("size", F.octet_length("text"))
    before = Window.partitionBy("toxic").orderBy("order", "doc_id").rowsBetween(Window.unboundedPreceding, 0)  # 3,500 rows at most
    sizes = rows.where(F.col("size") <= SAMPLE_BYTES // 4).select("doc_id", "toxic", "order", "size").withColumn("total", F.sum("size").over(before)).where(F.col("total") <= SAMPLE_BYTES)
    found = sorted((r["doc_id"], r["text"], r["toxic"]) for r in rows.join(F.broadcast(sizes.select("doc_id")), "doc_id").select("doc_id", "text", "toxic").collect())
    return train([t for _, t, _ in found], [y for *_, y in found])


def score(docs: DataFrame, machine: Machine | None, threshold: float = THRESHOLD) -> DataFrame:
    """docs with score (0 to 1) and predicted (0 or 1); columns by these names are replaced, others pass through.

    Null and empty texts score as texts without a toxic stretch; repeated rows score alike. A text is read once from end
    to end, in parts of SLICE characters if it is very long. Without a machine all scores are 0; an empty table stays empty.
    """
    tune(docs.sparkSession)
    docs = docs.drop("score", "predicted")
    at = docs.columns.index("text")

    def rate(batches):
        for batch in batches:
            texts = [t or "" for t in batch.column(at).to_pylist()]
            scores = machine.scores(texts) if machine and texts else np.zeros(len(texts))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, pa.float64())], names=[*batch.schema.names, "score"])

    kind = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields), "score double"])
    return docs.mapInArrow(rate, kind).withColumn("predicted", (F.col("score") >= threshold).cast("int"))
