"""Personal data: fixed patterns, and a linear-chain conditional random field over word shapes.

The base patterns (e-mail, IP address, card, phone) are always reported. The field adds spans that no base span touches:
phones without a plus, national ids, and addresses spelled out ("name at mail dot com"). It is trained by gradient
ascent on a small labelled table and decoded by Viterbi over every word of every text, many texts at once, in numpy.

A long text is decoded in segments, cut only where that changes nothing: in a window of words in which the best paths from
any label to any label all pass through one and the same label, the best path of the whole text does so too. Texts without
such windows are decoded in one piece.

Words are runs of ASCII letters, runs of digits, and single other visible characters; runs of non-ASCII characters are
letters. Features are the shape of a word, of its two neighbours on either side, pairs of adjacent shapes, whether white
space stands before, and cue words ("phone", "ssn") within the five words before.

Defined results: null and empty texts hold nothing; very long texts are read whole, in some 30 bytes a word; rows stay
apart even if they agree; a null id is carried along; an empty table gives an empty result; spans that begin at the same
place are in order of their kind; other columns are not looked at.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_and_text, slices

KINDS = ("email", "ip", "card", "phone", "id")
#: The base patterns, and the words that cue a kind.
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
CUES = {"phone": 1, "tel": 1, "telephone": 1, "call": 1, "mobile": 1, "cell": 1, "fax": 1, "dial": 1, "ssn": 2, "social": 2, "security": 2, "passport": 2, "email": 3, "mail": 3, "contact": 3, "write": 3, "reach": 3, "version": 4, "date": 4, "page": 4, "order": 4, "invoice": 4, "total": 4, "price": 4, "isbn": 4, "item": 4, "part": 4}


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        x = ord(d) - 48
        total += x if k % 2 == 0 else 2 * x - 9 * (x > 4)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) by start, then kind. No pattern can backtrack over a long run more than once."""
    found, done, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        if start < at and (m := DOMAIN.match(text, at + 1)):
            found.append((start, 0, done := m.end()))
        at = text.find("@", max(at + 1, done))
    for m in IP.finditer(text):
        if all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or 0) <= 255 for x in m[0].split(".")):
            found.append((m.start(), 1, m.end()))
    for m in CARD.finditer(text):
        if m.end() - m.start() <= 37 and 14 <= len(digits := re.sub("[^0-9]", "", m[0])) <= 19 and luhn(digits):
            found.append((m.start(), 2, m.end()))
    for m in PHONE.finditer(text) if "+" in text else ():
        if 10 <= sum(c in "0123456789" for c in m[0]) <= 15:
            found.append((m.start(), 3, m.end()))
    return sorted(found)


# --- words and features ---

TOKEN = re.compile(r"(?P<letters>(?:[A-Za-z]|[^\x00-\x7F])+)|(?P<digits>[0-9]+)|[^\s]")
#: Shapes: none (beyond the ends), words by case and length, digits by length, and marks of their own.
MARKS = {c: 21 + k for k, c in enumerate(".-+()[]@:/,_#%$*")}
N_SHAPES, N_CUES = 40, 5
AT_WORDS, DOT_WORDS = {"at", "arroba"}, {"dot", "punto", "point"}
OTHER_MARK, AT, DOT = 37, 38, 39

#: Characters by kind: white space, letters, digits, other marks (each a word of its own). All beyond ASCII are letters.
BLANK, LETTER, DIGIT, MARK = range(4)
KIND_OF = np.array([BLANK if chr(c).isspace() else LETTER if chr(c).isalpha() else DIGIT if chr(c).isdigit() else MARK for c in range(128)], np.uint8)
SHAPE_OF_MARK = np.array([MARKS.get(chr(c), OTHER_MARK) for c in range(128)], np.uint8)
FOLDED = np.array([c + 32 if 65 <= c <= 90 else c for c in range(128)], np.uint64)


def packed(word: str) -> int:
    """The first eight characters of an ASCII word as a number."""
    return int.from_bytes(word[:8].encode().ljust(8, b"\0"), "little")


KNOWN = sorted([*CUES, *AT_WORDS, *DOT_WORDS], key=packed)
KNOWN_KEYS, KNOWN_SIZES = np.array([packed(w) for w in KNOWN], np.uint64), np.array([len(w) for w in KNOWN])
KNOWN_CUES = np.array([CUES.get(w, 0) for w in KNOWN], np.uint8)
KNOWN_SHAPES = np.array([AT if w in AT_WORDS else DOT if w in DOT_WORDS else 0 for w in KNOWN], np.uint8)
assert len(set(KNOWN_KEYS.tolist())) == len(KNOWN)


@lru_cache(1)
def cased() -> tuple[np.ndarray, np.ndarray]:
    """For the first 65,536 characters: whether lower(), and whether upper(), changes it."""
    every = [chr(c) for c in range(1 << 16)]
    return np.array([c.lower() != c for c in every]), np.array([c.upper() != c for c in every])


def changed(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether lower(), and whether upper(), changes each character; those beyond the first 65,536 count as lower case."""
    low, up = cased()
    inside = np.minimum(points, 0xFFFF)  # U+FFFF has no case
    return low[inside], up[inside]


@dataclass
class Words:
    """Words of some texts, one after another; ``first`` has where each text's begin, and their number. Positions are in characters of the text."""

    first: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    shapes: np.ndarray
    spaced: np.ndarray
    cues: np.ndarray


#: Characters that are read at once.
WINDOW = 1 << 20


def kind_of(c: str) -> int:
    return int(KIND_OF[ord(c)]) if c < "\x80" else LETTER


def windows(text: str):
    """(begin, end) of parts of about WINDOW characters that don't cut a word."""
    low = 0
    while low < len(text):
        high = min(len(text), low + WINDOW)
        while high < len(text) and kind_of(text[high]) in (LETTER, DIGIT) and kind_of(text[high - 1]) == kind_of(text[high]):
            high += 1
        yield low, high
        low = high


def read(texts: list[str]) -> Words:
    """Words with shapes, white space before them and cues, of whole texts."""
    parts, sizes = [], []
    group: list[tuple[int, int, int]] = []  # text, begin, end
    held = 0
    for k, text in enumerate(texts):
        for low, high in windows(text):
            group.append((k, low, high))
            held += high - low
            if held >= WINDOW:
                parts.append(read_parts(texts, group))
                group, held = [], 0
    if group:
        parts.append(read_parts(texts, group))
    if not parts:
        none = np.zeros(0, np.int32)
        return Words(np.zeros(len(texts) + 1, np.int64), none, none, none.astype(np.uint8), none.astype(np.uint8), none.astype(np.uint8))
    sizes = sum(np.bincount(p[0], minlength=len(texts)) for p in parts)
    columns = []
    for c in range(1, 6):  # one after another, so that little is held twice
        columns.append(np.concatenate([p[c] for p in parts]))
        parts = [(*p[:c], None, *p[c + 1 :]) for p in parts]
    starts, ends, shapes, spaced, known = columns
    first = np.r_[0, np.cumsum(sizes)]
    spaced[first[:-1][sizes > 0]] = 1
    return Words(first, starts, ends, shapes, spaced, cues_of(known, np.repeat(first[:-1].astype(np.int32), sizes)))


def read_parts(texts: list[str], group: list[tuple[int, int, int]]) -> tuple[np.ndarray, ...]:
    """(text, start, end, shape, spaced, cue of the word itself) of each word of parts of texts."""
    joined = " ".join(texts[k][a:b] for k, a, b in group)
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), "<u4")
    kind = np.where(points < 128, KIND_OF[np.minimum(points, 127)], LETTER).astype(np.uint8)
    before = np.r_[np.uint8(BLANK), kind[:-1]]
    starts = np.flatnonzero((kind != BLANK) & ((kind == MARK) | (kind != before)))
    if not len(starts):
        none = np.zeros(0, np.int32)
        return none, none, none, none.astype(np.uint8), none.astype(np.uint8), none.astype(np.uint8)
    after = np.r_[kind[1:], np.uint8(BLANK)]
    ends = np.flatnonzero((kind != BLANK) & ((kind == MARK) | (kind != after))) + 1
    of_kind, size = kind[starts], ends - starts
    low, up = changed(points)
    not_low, not_up = (np.add.reduceat(x.astype(np.int32), starts) > 0 for x in (low & (kind == LETTER), up & (kind == LETTER)))
    word = 1 + np.where(~not_low, 0, np.where(~not_up & (size > 1), 2, 4)) + (size > 3)
    digits = np.where(size <= 11, 8 + size, np.where(size <= 13, 19, 20))
    mark = SHAPE_OF_MARK[np.minimum(points[starts], 127)]
    shapes = np.where(of_kind == LETTER, word, np.where(of_kind == DIGIT, digits, mark)).astype(np.uint8)
    known = np.zeros(len(starts), np.uint8)
    some = np.flatnonzero((of_kind == LETTER) & (size <= int(KNOWN_SIZES.max())) & (size >= int(KNOWN_SIZES.min())))
    keys = np.zeros(len(some), np.uint64)
    for j in range(8):
        own = size[some] > j
        c = points[np.minimum(starts[some] + j, len(points) - 1)]
        keys |= np.where(own, FOLDED[np.minimum(c, 127)], 0).astype(np.uint64) << np.uint64(8 * j)
    place = np.minimum(np.searchsorted(KNOWN_KEYS, keys), len(KNOWN) - 1)
    hits = np.flatnonzero((KNOWN_KEYS[place] == keys) & (KNOWN_SIZES[place] == size[some]))
    hits = hits[[joined[a:b].lower() == KNOWN[k] for a, b, k in zip(starts[some[hits]].tolist(), ends[some[hits]].tolist(), place[hits].tolist(), strict=True)]] if len(hits) else hits
    known[some[hits]] = KNOWN_CUES[place[hits]]
    own = KNOWN_SHAPES[place[hits]]
    shapes[some[hits]] = np.where(own > 0, own, shapes[some[hits]])
    lengths = np.array([b - a for _, a, b in group])
    offsets = np.cumsum(lengths + 1) - lengths - 1
    part = np.searchsorted(offsets, starts, side="right") - 1
    shift = np.array([a for _, a, _ in group]) - offsets
    spaced = (before[starts] == BLANK).astype(np.uint8)
    inner = np.array([a > 0 and not texts[k][a - 1].isspace() for k, a, _ in group])  # parts that go on right after a word
    spaced[(starts == offsets[part]) & inner[part]] = 0
    return np.array([k for k, _, _ in group], np.int32)[part], (starts + shift[part]).astype(np.int32), (ends + shift[part]).astype(np.int32), shapes, spaced, known


def cues_of(known: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The cue of the last cue word among the five words before each word; ``first`` is where its text begins."""
    if not len(known):
        return known
    at = np.arange(len(known), dtype=np.int32)
    before = np.empty_like(at)
    before[0] = -1
    np.maximum.accumulate(np.where(known[:-1] > 0, at[:-1], np.int32(-1)), out=before[1:])
    return np.where((before >= first) & (at - before <= 5), known[np.maximum(before, 0)], np.uint8(0))


@dataclass
class Stretch:
    starts: np.ndarray
    ends: np.ndarray
    shapes: np.ndarray
    spaced: np.ndarray
    cues: np.ndarray


def read_words(text: str, low: int, high: int) -> Stretch:
    w = read([text[low:high]])
    return Stretch(w.starts + low, w.ends + low, *(x.astype(np.int64) for x in (w.shapes, w.spaced, w.cues)))


#: Feature tables: shape here, two before, one before, one after, two after; pairs here-before and here-after; space; cue with shape.
SIZES = (N_SHAPES,) * 5 + (N_SHAPES * N_SHAPES,) * 2 + (2 * N_SHAPES, N_CUES * N_SHAPES)
OFFSETS = np.cumsum((0, *SIZES))[:-1]
N_FEATURES = sum(SIZES)


def features(s: Stretch) -> np.ndarray:
    """len x 9 feature numbers."""
    x = np.r_[0, 0, s.shapes, 0, 0]
    a, b, c, d, e = (x[k : k + len(s.shapes)] for k in range(5))
    return np.stack([c, a, b, d, e, c * N_SHAPES + b, c * N_SHAPES + d, s.spaced * N_SHAPES + c, s.cues * N_SHAPES + c], axis=1) + OFFSETS


LABELS = 1 + 2 * len(KINDS)  # none, then begin and inside of each kind


#: Padded words that are decoded side by side, sequences of a group, and steps whose scores are held at once.
PADDED, SIDE_BY_SIDE, STEPS = 1 << 17, 1024, 2048
#: Words between places where a long text may be cut, and words of the window that is looked at there.
PIECE, LOOK = 512, 32


@dataclass
class Field:
    """emit: features x labels; move: labels x labels, -inf where an inside would follow another kind."""

    emit: np.ndarray
    move: np.ndarray

    def tables(self) -> tuple[np.ndarray, ...]:
        """Scores of pairs of shapes (before and here, here and after), of a shape two before and two after, and of space, cue and shape."""
        if not hasattr(self, "_tables"):
            n = N_SHAPES
            here, two_before, before, after, two_after, pair_before, pair_after, spaced, cue = (self.emit[o : o + size] for o, size in zip(OFFSETS, SIZES, strict=True))
            back = before[:, None] + pair_before.reshape(n, n, -1).transpose(1, 0, 2)  # [before, here]
            forth = after[None, :] + pair_after.reshape(n, n, -1)  # [here, after]
            own = here[None, None] + spaced.reshape(2, 1, n, -1) + cue.reshape(1, N_CUES, n, -1)
            self._tables = tuple(np.ascontiguousarray(x.reshape(-1, LABELS)) for x in (back, forth, two_before, two_after, own))
        return self._tables

    def __getstate__(self):
        return {"emit": self.emit, "move": self.move}

    def paths(self, score, sizes: np.ndarray, previous: np.ndarray, last: np.ndarray) -> list[np.ndarray]:
        """Best labels of sequences. score(sequences, low, high) gives their scores of words low ... high - 1, padded; previous: the label before a sequence, or -1 at the start of a text; last: the label it must end with, or -1."""
        out: list[np.ndarray] = [np.zeros(0, np.int8)] * len(sizes)
        order = np.argsort(sizes, kind="stable")
        order = order[sizes[order] > 0]
        high = len(order)
        while high:  # the longest first
            longest = int(sizes[order[high - 1]])
            low = max(0, high - max(1, min(SIDE_BY_SIDE, PADDED // longest)))
            group, high = order[low:high], low
            own = sizes[group]
            back = np.zeros((longest, len(group), LABELS), np.int8)
            begun = np.where((previous[group] < 0)[:, None], self.start(), self.move[np.maximum(previous[group], 0)])
            for at in range(0, longest, STEPS):
                scores = score(group, at, min(longest, at + STEPS))
                for t in range(at, min(longest, at + STEPS)):
                    if t == 0:
                        best = begun + scores[:, 0]
                        continue
                    through = best[:, None, :] + self.move.T  # [sequence, to, from]
                    back[t] = came = through.argmax(axis=2)
                    new = np.take_along_axis(through, came[:, :, None], 2)[:, :, 0] + scores[:, t - at]
                    best = new if t < own[0] else np.where((t < own)[:, None], new, best)
            state = np.where(last[group] < 0, best.argmax(axis=1), last[group])
            path, rows = np.zeros((longest, len(group)), np.int8), np.arange(len(group))
            for t in range(longest - 1, -1, -1):
                inside = t < own
                path[t] = np.where(inside, state, 0)
                state = np.where(inside, back[t, rows, state], state)
            for j, k in enumerate(group.tolist()):
                out[k] = path[: own[j], j]
        return out

    def viterbi(self, batch: list[np.ndarray]) -> list[np.ndarray]:
        """Best labels of each sequence of feature rows."""

        def score(group: np.ndarray, low: int, high: int) -> np.ndarray:
            out = np.zeros((len(group), high - low, LABELS))
            for j, k in enumerate(group):
                part = batch[k][low:high]
                out[j, : len(part)] = self.emit[part].sum(axis=1)
            return out

        none = np.full(len(batch), -1)
        return [x.astype(np.int64) for x in self.paths(score, np.array([len(x) for x in batch], np.int64), none, none)]

    def scores_of(self, words: Words):
        """A function of places to their scores."""
        sizes = np.diff(words.first)
        left, right = (np.full(len(words.shapes), 2, np.uint8) for _ in range(2))  # words of the text on either side, two at most
        for least in (2, 1):
            some = sizes >= least
            left[words.first[:-1][some] + least - 1] = right[words.first[1:][some] - least] = least - 1
        shapes = words.shapes
        back, forth, two_before, two_after, own = self.tables()

        def score(places: np.ndarray) -> np.ndarray:
            p = places
            here, l, r = shapes[p].astype(np.int64), left[p], right[p]  # noqa: E741
            near = lambda d, there: np.where(there, shapes[np.clip(p + d, 0, len(shapes) - 1)], 0).astype(np.int64)
            total = back[near(-1, l > 0) * N_SHAPES + here]
            total += forth[here * N_SHAPES + near(1, r > 0)]
            total += two_before[near(-2, l > 1)]
            total += two_after[near(2, r > 1)]
            total += own[(words.spaced[p].astype(np.int64) * N_CUES + words.cues[p]) * N_SHAPES + here]
            return total

        return score

    def cuts(self, score, low: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For windows of LOOK words from ``low``: a place that all best paths through the window pass with one label, and that label; -1 if there is none."""
        places, labels = np.full(len(low), -1, np.int64), np.full(len(low), -1, np.int64)
        for first in range(0, len(low), 256):
            part = low[first : first + 256]
            n = len(part)
            scores = score((part[:, None] + np.arange(LOOK)).ravel()).reshape(n, LOOK, LABELS)
            best = self.move[None] + scores[:, None, 0]  # [window, label before it, label]
            back = np.zeros((LOOK, n, LABELS, LABELS), np.int8)
            for t in range(1, LOOK):
                through = best[:, :, None, :] + self.move.T
                back[t] = came = through.argmax(axis=3)
                best = np.take_along_axis(through, came[..., None], 3)[..., 0] + scores[:, None, t]
            possible = np.isfinite(best)
            state = np.broadcast_to(np.arange(LABELS), best.shape)
            found = np.zeros(n, bool)
            for t in range(LOOK - 1, -1, -1):
                least, most = np.where(possible, state, LABELS).min(axis=(1, 2)), np.where(possible, state, -1).max(axis=(1, 2))
                new = (least == most) & ~found
                places[first : first + n][new], labels[first : first + n][new] = part[new] + t, most[new]
                found |= new
                if found.all():
                    break
                state = np.take_along_axis(back[t].astype(np.int64), state, 2)
        return places, labels

    def labels(self, words: Words) -> np.ndarray:
        """The best path of each text, one after another."""
        score = self.scores_of(words)
        begin, end = words.first[:-1], words.first[1:]
        long = np.flatnonzero(end - begin > 2 * PIECE)
        tried = np.concatenate([np.arange(begin[k] + PIECE, end[k] - PIECE, PIECE) for k in long]) if len(long) else np.zeros(0, np.int64)
        places, states = self.cuts(score, tried)
        places, states = places[places >= 0], states[places >= 0]
        # a sequence ends with the word at a cut, or at the end of a text
        stops = np.concatenate([places + 1, end[end > begin]])
        last = np.concatenate([states, np.full(int((end > begin).sum()), -1)])
        order = np.argsort(stops, kind="stable")
        stops, last = stops[order], last[order]
        starts = np.r_[0, stops[:-1]]
        previous = np.r_[-1, last[:-1]]

        def of(group: np.ndarray, low: int, high: int) -> np.ndarray:
            at = starts[group][:, None] + np.arange(low, high)
            inside = at < stops[group][:, None]
            out = np.zeros((*at.shape, LABELS))
            out[inside] = score(at[inside])
            return out

        found = self.paths(of, stops - starts, previous, last)
        return np.concatenate(found) if found else np.zeros(0, np.int8)

    @staticmethod
    def start() -> np.ndarray:
        return np.array([0.0] + [0.0, -np.inf] * len(KINDS))


def allowed() -> np.ndarray:
    ok = np.zeros((LABELS, LABELS))
    for b in range(2, LABELS, 2):  # insides
        for a in range(LABELS):
            if a not in (b, b - 1):
                ok[a, b] = -np.inf
    return ok


def train(rows: list[tuple[str, list[tuple[int, int, str]]]], rounds: int = 100, l2: float = 2e-3) -> Field:
    """rows: (text, [(start, end, kind)]). Maximises the penalised conditional likelihood by Adam, all rows at once."""
    coded = []
    for text, spans in rows:
        s = read_words(text, 0, len(text))
        y = np.zeros(len(s.starts), np.int64)
        for start, end, kind in spans:
            inside = [k for k in range(len(y)) if start <= s.starts[k] < end]
            y[inside] = 2 + 2 * KINDS.index(kind)
            y[inside[:1]] -= 1
        if len(y):
            coded.append((features(s), y))
    n, longest = len(coded), max(len(y) for _, y in coded)
    x, y, mask = np.zeros((n, longest, len(SIZES)), np.int64), np.zeros((n, longest), np.int64), np.zeros((n, longest), bool)
    for k, (f, labels) in enumerate(coded):
        x[k, : len(labels)], y[k, : len(labels)], mask[k, : len(labels)] = f, labels, True
    gold_move = np.zeros((LABELS, LABELS))
    np.add.at(gold_move, (y[:, :-1][mask[:, 1:]], y[:, 1:][mask[:, 1:]]), 1)
    truth = np.eye(LABELS)[y] * mask[:, :, None]
    free = allowed()
    emit, move = np.zeros((N_FEATURES, LABELS)), np.zeros((LABELS, LABELS))
    state = [np.zeros_like(emit), np.zeros_like(emit), np.zeros_like(move), np.zeros_like(move)]
    flat = x[mask]

    def soft(v, axis):
        top = v.max(axis=axis, keepdims=True)
        top = np.where(np.isfinite(top), top, 0)
        with np.errstate(divide="ignore"):
            return np.log(np.exp(v - top).sum(axis=axis)) + top.squeeze(axis)

    for r in range(1, rounds + 1):
        scores, step = emit[x].sum(axis=2), move + free
        alpha, beta = np.zeros((n, longest, LABELS)), np.zeros((n, longest, LABELS))
        alpha[:, 0] = scores[:, 0] + Field.start()
        for t in range(1, longest):
            new = soft(alpha[:, t - 1, :, None] + step, 1) + scores[:, t]
            alpha[:, t] = np.where(mask[:, t, None], new, alpha[:, t - 1])
        total = soft(alpha[:, -1], 1)
        for t in range(longest - 2, -1, -1):
            new = soft(step + (scores[:, t + 1] + beta[:, t + 1])[:, None, :], 2)
            beta[:, t] = np.where(mask[:, t + 1, None], new, 0)
        p = np.exp(alpha + beta - total[:, None, None]) * mask[:, :, None]
        with np.errstate(invalid="ignore"):
            joint = np.exp(alpha[:, :-1, :, None] + step + (scores[:, 1:] + beta[:, 1:])[:, :, None, :] - total[:, None, None, None])
        joint = (np.nan_to_num(joint) * mask[:, 1:, None, None]).sum(axis=(0, 1))
        miss = (truth - p)[mask]
        g_emit = np.zeros_like(emit)
        for c in range(len(SIZES)):
            np.add.at(g_emit, flat[:, c], miss)
        g_emit, g_move = g_emit / n - l2 * emit, (gold_move - joint) / n - l2 * move
        for k, (w, g) in enumerate(((emit, g_emit), (move, g_move))):
            m, v = state[2 * k], state[2 * k + 1]
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            w += 0.1 * (m / (1 - 0.9**r)) / (np.sqrt(v / (1 - 0.99**r)) + 1e-8)
    return Field(emit, move + free)


def train_table(table: DataFrame, max_rows: int = 5000, **options) -> Field:
    """table: (text, spans array<struct<start, end, kind>>). Trains on at most ``max_rows`` of its rows, chosen by a hash of the text."""
    rows = table.select("text", "spans").orderBy(F.xxhash64("text"), "text").limit(max_rows).collect()
    return train([(r.text or "", [(x["start"], x["end"], x["kind"]) for x in r.spans or []]) for r in rows], **options)


# --- the small labelled table ---

#: Sentences with slots; {kind:form} is a labelled value, {kind} alone an unlabelled one.
SENTENCES = """
call me at {phone} tomorrow|my phone is {phone}.|phone: {phone}, office hours only|tel {phone} or fax {phone}|reach us by phone ({phone}) any time
dial {phone} now|{phone}|ring {phone} and ask for the clerk|mobile {phone} / home {phone}|the number {phone} is mine
ssn {id} on file|social security number: {id}|{id} is her ssn|his ssn is {id}, as noted|passport {id} was lost|id {id}
write to {spelled} please|{spelled}|my address is {spelled}, thanks|contact {spelled} for more|mail {spelled} today
mail {email} today|contact: {email}|{email}|send it to <{email}> soon|the host {ip} is down|ping {ip}:8080|{ip}|from {ip} to {ip}
pay with {card} please|card {card} expired|{card}|card number: {card}, valid
on {date} we met|the year {year} was fine|version {version} is out|it costs {price} now|page {small} of {small}|order {order} shipped|total: {price}
see {date} and {date}|invoice {order}, item {small}|call number {small}|room {small}, floor {small}|{version}|{date}|{time}|{order}|token = "{hex}" in code
the plain words go on here|meet at the house at noon|look at the dot on the page|a word, and another. then one more|at {time} we start|isbn {isbn} in print
between {year} and {year}|{small} {small} {small} {small}|{price}, {price}, {price}|chapter {small}.{small} at the end|the {order} of {small}-{small} points
look at. then go {small} steps|is at. of the {order} end|pour oitre le {small} etions|von. von. von. {small} von. von|und. at the. {date} dot the i|ending at {small}. dot com boom|go there. {phone}|{year}. at. {small}. dot
and {bad_ip} is no address|build {version}-{small}|{long} units|the sum {long} is large|matrix {small}x{small}|ratio {small}/{small}|score {small}-{small}|x{small}y{small}
""".replace("\n", "|").strip("|")
FILL = "the of ereth ande with letion que enle der ungver sch ciónes lla and thion ing re".split()


def labelled_table(copies: int = 4, seed: int = 7) -> list[tuple[str, list[tuple[int, int, str]]]]:
    """The training table: every sentence ``copies`` times with fresh values, some between filler words or in capitals."""
    rng = np.random.default_rng(seed)
    d = lambda n: "".join(str(x) for x in rng.integers(0, 10, n))
    pick = lambda *a: a[int(rng.integers(0, len(a)))]
    name = lambda: pick("anna", "john", "maria", "k", "info", "sales", "peter", "li")
    host = lambda: pick("mail", "example", "post", "acme", "web")
    end = lambda: pick("com", "org", "net", "de", "fr")

    def card():
        head = "4" + d(14)
        return next(head + str(k) for k in range(10) if luhn(head + str(k)))

    made = {
        "phone": lambda: pick(f"({d(3)}) {d(3)}-{d(4)}", f"{d(3)}-{d(3)}-{d(4)}", f"{d(3)}.{d(3)}.{d(4)}", f"{d(3)} {d(3)} {d(4)}", f"+1 ({d(3)}) {d(3)}-{d(4)}", f"+{d(2)} {d(3)} {d(6)}", f"1-{d(3)}-{d(3)}-{d(4)}", f"0{d(3)}/{d(7)}"),
        "id": lambda: f"{d(3)}-{d(2)}-{d(4)}",
        "spelled": lambda: pick(f"{name()} at {host()} dot {end()}", f"{name()} (at) {host()} (dot) {end()}", f"{name()} [at] {host()} [dot] {end()}", f"{name()} dot {name()} at {host()} dot {end()}", f"{name()}{d(2)} at {host()} dot {end()}", f"{name()} arroba {host()} punto {end()}"),
        "email": lambda: pick(f"{name()}.{name()}@{host()}.{end()}", f"{name()}{d(2)}@{host()}.{end()}", f"{name()}@{host()}{d(1)}.{host()}.{end()}"),
        "ip": lambda: ".".join(str(x) for x in rng.integers(0, 256, 4)),
        "card": lambda: pick(lambda x: x, lambda x: " ".join(x[k : k + 4] for k in (0, 4, 8, 12)), lambda x: "-".join(x[k : k + 4] for k in (0, 4, 8, 12)))(card()),
        "date": lambda: pick(f"20{d(2)}-0{d(1)}-1{d(1)}", f"1{d(1)}/0{d(1)}/19{d(2)}", f"0{d(1)}.1{d(1)}.20{d(2)}"),
        "year": lambda: pick("19", "20") + d(2),
        "version": lambda: pick(f"{d(1)}.{d(1)}.{d(2)}", f"v{d(1)}.{d(2)}", f"{d(1)}.{d(1)}"),
        "price": lambda: pick(f"${d(2)}.{d(2)}", f"{d(1)},{d(3)}.{d(2)}", f"{d(3)} euro"),
        "small": lambda: d(int(rng.integers(1, 4))),
        "order": lambda: pick(f"#{d(5)}", f"A-{d(6)}", d(6), d(8)),
        "time": lambda: f"{d(2)}:{d(2)}",
        "hex": lambda: hashlib.sha1(d(9).encode()).hexdigest(),
        "isbn": lambda: f"978-{d(1)}-{d(3)}-{d(5)}-{d(1)}",
        "bad_ip": lambda: f"{d(3)}.9{d(2)}.{d(3)}.4{d(2)}",
        "long": lambda: d(int(rng.integers(12, 24))),
    }
    kinds = {"phone": "phone", "id": "id", "spelled": "email", "email": "email", "ip": "ip"}
    rows = []
    for _ in range(copies):
        for sentence in SENTENCES.split("|"):
            text, spans = "", []
            junk = rng.random() < 0.25
            filler = lambda: " ".join(pick(*FILL) + (pick("***", "%%%", "$$$", "&&&", "###", "!!", ",", ".###", ",&&&", ".") if junk else "") for _ in range(int(rng.integers(0, 9))))  # noqa: B023, E731
            fill = filler()
            text += fill + " " if fill else ""
            for k, part in enumerate(re.split(r"\{(\w+)\}", sentence)):
                if k % 2:
                    value = made[part]()
                    if part in kinds:
                        spans.append((len(text), len(text) + len(value), kinds[part]))
                    text += value
                else:
                    text += part
            fill = filler()
            text += (pick("***", "%%%", "$$$", "&&&", "###", "!!") if junk else "") + " " + fill if fill else ""
            rows.append((text.upper() if rng.random() < 0.15 else text, spans))
    return rows


@lru_cache(1)
def default_field() -> Field:
    return train(labelled_table())


def plausible(kind: int, value: str) -> bool:
    """Whether a decoded value can be of its kind at all: what shapes alone don't tell."""
    digits = re.sub("[^0-9]", "", value)
    words = set(re.findall("[a-z]+", value.lower()))
    return (
        ("@" in value or bool(words & AT_WORDS and words & DOT_WORDS)),
        len(p := value.split(".")) == 4 and all(x.isdecimal() and int(x[:4]) <= 255 for x in p),
        14 <= len(digits) <= 19 and luhn(digits),
        7 <= len(digits) <= 15,
        len(digits) == 9,
    )[kind]


def texts_spans(texts: list[str], field: Field) -> list[list[tuple[int, int, int, bool]]]:
    """(start, kind, end, added) of each text, by start, then kind; the words of all texts are decoded together."""
    out = [[(a, kind, b, False) for a, kind, b in base_spans(text)] for text in texts]
    words = read(texts)
    labels = field.labels(words)
    begins = np.flatnonzero((labels > 0) & (labels % 2 == 1))
    of = np.searchsorted(words.first, begins, side="right") - 1
    base_of, base, ends = -1, [], []
    for at, k in zip(begins.tolist(), of.tolist(), strict=True):
        end, stop = at + 1, int(words.first[k + 1])
        while end < stop and labels[end] == labels[at] + 1:
            end += 1
        first, last, kind = int(words.starts[at]), int(words.ends[end - 1]), int(labels[at]) // 2
        if not plausible(kind, texts[k][first:last]):
            continue
        if k != base_of:  # base spans by start; the greatest end so far tells whether any reaches a place
            base_of, base = k, [x for x in out[k] if not x[3]]
            ends = np.maximum.accumulate([b for _, _, b, _ in base]).tolist() if base else []
        before = bisect_left(base, (last,)) if base else 0
        if not before or ends[before - 1] <= first:
            out[k].append((first, kind, last, True))
    return [sorted(set(x)) for x in out]


def scan(docs: DataFrame, field: Field | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, spans array<struct<start, kind, end, added>>), a row a document, whole texts."""
    shared = docs.sparkSession.sparkContext.broadcast(field or default_field())  # of fixed size
    kind = pa.list_(pa.struct([("start", pa.int32()), ("kind", pa.string()), ("end", pa.int32()), ("added", pa.bool_())]))

    def run(batches):
        for whole in batches:
            for batch in slices(whole):
                found = texts_spans([t or "" for t in batch.column(1).to_pylist()], shared.value)
                yield pa.record_batch([batch.column(0), pa.array([[{"start": a, "kind": KINDS[k], "end": b, "added": new} for a, k, b, new in x] for x in found], kind)], names=["doc_id", "spans"])

    return id_and_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, spans array<struct<start: int, kind: string, end: int, added: boolean>>")


def summary(found: DataFrame) -> DataFrame:
    base = F.filter("spans", lambda x: ~x["added"])
    joined = lambda spans: F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    count = lambda kind: F.size(F.filter("spans", lambda x: (x["kind"] == kind) & ~x["added"])).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *[count(k) for k in KINDS[:4]], F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))
