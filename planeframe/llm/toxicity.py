"""Toxicity by a support vector machine over a gapped subsequence string kernel with Nystrom landmarks.

The kernel of two strings is the gap-weighted subsequence kernel of order three: every three letters in order, at most SPAN
places from first to last, weigh LAMBDA to the power of the places they span; the kernel is the normalised inner product. Both ends of a string count as
letters. Characters that are no letters are places without a letter, so inserted characters and gaps lower a match but do not hide it. Letters are
lower-cased and lose their accents; a to z have codes of their own, all other letters share 35 codes so that neighbours in an alphabet differ.

A sentence is the set of its windows: all runs of neighbouring letter runs of two letters or more that take at most LONGEST places, where what parts two runs (blanks, signs, digits,
at most GAP characters) is one place without a letter. So words are read alone, runs glued by signs are also read alone, and spelled-out or
parted words are also read together. A letter run longer than that is read in overlapping windows of 22 and of 8 places. A sentence's value is the highest of its windows'.

The machine is trained on sentences of labelled documents (multiple-instance learning): sentences of clean documents are negative in all their windows; a
sentence of a toxic document is positive where a window of it has a positive value that almost no clean sentence reaches, and that window is its witness. The first witnesses are words with letter groups that go with the label; then
witnesses and the highest windows of all clean sentences are chosen by the machine itself and it is trained again. Each machine (squared hinge, Newton steps) lives in the
space of landmarks picked from both sides by farthest-first search. As the kernel's feature space is explicit, it folds to one weight for each letter triple.

Scoring never builds a window that cannot matter: sums over places and their running totals give every window's value up to repeated triples, which only
lower it, in a few operations; windows whose bound is above a document's second highest sentence are evaluated in full.

A document's score is a logistic function of its two highest sentence values, calibrated on values that machines trained on the other half of the documents gave.
The bounds of the training sample are the fields of ``Training``; scoring has none.

Edge cases: null and empty texts have the lowest value and a score like any other; repeated rows are scored alike; texts of more than PART characters are read in parts that
end with a sentence (where a part has no sentence's end, at a blank, with OVERLAP characters read twice); without labels of both kinds all scores are 0; null labels are not used; a null doc_id is not held out.
"""

from __future__ import annotations

import contextlib
import ctypes
import gc
import math
import pickle
import re
import unicodedata
import zlib
from array import array
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import held, small_batches, table

LAMBDA, SPAN, LONGEST, GAP = 0.5, 7, 24, 4
LETTERS, START, STOP = 64, 63, 62
OTHERS = 35
PLACES = LONGEST - 2
PIECES = ((PLACES, PLACES // 2), (8, 4))  # sizes and steps of the windows of longer runs
PART, OVERLAP = 1_000_000, 200
CUT = 0.7
NONE = -4.0
_WORD = re.compile(r"[^\W\d_]+")


@dataclass(frozen=True)
class Training:
    """What the machine learns from: at most ``per_class`` labelled documents of each label, lowest hash of doc_id first, of at most ``longest`` bytes each;
    ``landmarks`` chosen from all witnesses and ``pool`` clean windows; ``negatives`` clean windows drawn at random and the ``hard`` highest of all of them, in each of ``rounds``;
    a sentence is positive only where its value is higher than that of all clean sentences but the share ``noise``."""

    per_class: int = 2000
    longest: int = 65_536
    landmarks: int = 192
    pool: int = 2000
    negatives: int = 8000
    hard: int = 4000
    rounds: int = 2
    noise: float = 0.001
    seed: int = 5


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def _code(c: int) -> int:
    s = chr(c)
    if not s.isalpha():
        return 0
    base = ord(unicodedata.normalize("NFKD", s)[0])
    return base - 96 if 97 <= base <= 122 else 27 + base % OTHERS


@lru_cache(maxsize=1)
def _codes() -> np.ndarray:
    return np.array([_code(c) for c in range(0x10000)], np.int64)


@lru_cache(maxsize=None)
def _triples(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Places (3, k) of all subsequences of three in n places, and their weights."""
    at = [(i, j, k) for i in range(n) for j in range(i + 1, min(n, i + SPAN)) for k in range(j + 1, min(n, i + SPAN))]
    at = np.array(at, np.int64).reshape(-1, 3).T
    return at, LAMBDA ** (at[2] - at[0] + 1 - 3.0)


def features(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code rows of equal length, ends included -> triple ids, weights (0 where a place is no letter), norms. Repeats of a triple are summed in the norm."""
    at, weight = _triples(rows.shape[1])
    a, b, c = rows[:, at[0]], rows[:, at[1]], rows[:, at[2]]
    ids = (a * LETTERS + b) * LETTERS + c
    w = np.where((a > 0) & (b > 0) & (c > 0), weight, 0.0)
    order = np.argsort(ids, axis=1)
    ids, w = np.take_along_axis(ids, order, 1), np.take_along_axis(w, order, 1)
    first = np.ones(ids.shape, bool)
    first[:, 1:] = ids[:, 1:] != ids[:, :-1]
    starts = np.flatnonzero(first)
    sums = np.add.reduceat(w.ravel(), starts)
    norm2 = np.bincount(starts // ids.shape[1], sums * sums, len(ids))
    return ids, w, np.sqrt(norm2)


class Strings:
    """Windows as strings of their own: code rows by length with their features."""

    def __init__(self, rows: list[np.ndarray]):
        self.size = len(rows)
        lengths = np.array([len(r) for r in rows], np.int64)
        self.groups = []
        for n in np.unique(lengths).tolist():
            at = np.flatnonzero(lengths == n)
            for i in range(0, len(at), 2000):
                ids, w, norm = features(np.array([rows[k] for k in at[i : i + 2000]]))
                self.groups.append((at[i : i + 2000], ids, (w / np.maximum(norm, 1e-12)[:, None]).astype(np.float32)))

    def dot(self, weights: np.ndarray) -> np.ndarray:
        """Inner products with one weight for each triple."""
        out = np.zeros(self.size)
        for at, ids, w in self.groups:
            out[at] = (w * weights[ids]).sum(1)
        return out

    def dense(self, k: int) -> np.ndarray:
        """The feature vector of one string."""
        out = np.zeros(LETTERS**3, np.float32)
        for at, ids, w in self.groups:
            for row in np.flatnonzero(at == k):
                np.add.at(out, ids[row], w[row])
        return out

    def kernel(self, marks: Landmarks) -> np.ndarray:
        out = np.zeros((self.size, len(marks.rows)), np.float32)
        for at, ids, w in self.groups:
            where = marks.place[ids]
            got = np.zeros((len(at), len(marks.rows)), np.float32)
            for k in range(ids.shape[1]):
                got += w[:, k, None] * marks.by_triple[where[:, k]]
            out[at] = got
        return out


class Landmarks:
    """Feature vectors of the landmarks over the triples that any of them has."""

    def __init__(self, rows: list[np.ndarray]):
        self.rows, strings = rows, Strings(rows)
        self.triples = np.unique(np.concatenate([ids.ravel() for _, ids, _ in strings.groups]))
        self.place = np.full(LETTERS**3, len(self.triples), np.int64)
        self.place[self.triples] = np.arange(len(self.triples))
        self.by_triple = np.zeros((len(self.triples) + 1, len(rows)), np.float32)  # the last row: triples of no landmark
        for at, ids, w in strings.groups:
            np.add.at(self.by_triple, (self.place[ids], at[:, None]), w)


def spread(rows: list[np.ndarray], n: int) -> list[np.ndarray]:
    """Farthest-first choice of n strings by kernel, the first one first."""
    if len(rows) <= n:
        return rows
    strings, chosen, near = Strings(rows), [0], np.full(len(rows), -1.0)
    for _ in range(n - 1):
        near = np.maximum(near, strings.dot(strings.dense(chosen[-1])))
        chosen.append(int(near.argmin()))
    return [rows[k] for k in dict.fromkeys(chosen)]


def machine(positive: list[np.ndarray], negative: list[np.ndarray], marks: list[np.ndarray]) -> tuple[np.ndarray, float]:
    """The squared-hinge machine in the space of the landmarks, folded to (a weight for each letter triple, bias)."""
    marks = Landmarks(marks)
    value, vector = np.linalg.eigh(marks.by_triple.T.astype(np.float64) @ marks.by_triple)
    keep = value > 1e-4 * value.max()
    root = vector[:, keep] / np.sqrt(value[keep])
    x = np.ones((len(positive) + len(negative), root.shape[1] + 1))
    x[:, :-1] = Strings(positive + negative).kernel(marks) @ root
    y = np.r_[np.ones(len(positive)), -np.ones(len(negative))]
    weight = np.r_[np.full(len(positive), 1 / len(positive)), np.full(len(negative), 6 / len(negative))]
    ridge = 1e-4 * np.eye(x.shape[1])
    w = np.zeros(x.shape[1])
    for _ in range(40):  # Newton steps of the squared hinge: a weighted ridge over the rows inside the margin
        inside = y * (x @ w) < 1
        scaled = x[inside] * weight[inside, None]
        new = np.linalg.solve(ridge + scaled.T @ x[inside], scaled.T @ y[inside])
        if np.allclose(new, w, atol=1e-9):
            break
        w = new
    weights = np.zeros(LETTERS**3)
    weights[marks.triples] = marks.by_triple[:-1] @ (root @ w[:-1])
    return weights, float(w[-1])


def _ends(valid: np.ndarray) -> np.ndarray:
    """(5, n) from (6, n) of the six places from an end inwards, 1 where there is a letter: squared weights of the triples of
    that end and two places, the farther one at most q places away, q = 1 to 5."""
    return np.cumsum([valid[q] * valid[:q].sum(0) * LAMBDA ** (2 * (q - 1.0)) for q in range(1, 6)], axis=0)


@lru_cache(maxsize=1)
def _squares() -> np.ndarray:
    """For each pattern of letters on seven places: squared weights of the triples that begin at the first and reach 2 to 6 places on."""
    bits = (np.arange(128)[:, None] >> np.arange(7)) & 1
    reach = [bits[:, 0] * bits[:, k] * bits[:, 1:k].sum(1) * LAMBDA ** (2 * (k - 2.0)) for k in range(2, 7)]
    return np.cumsum(reach, axis=0)


class Sentences:
    """Texts as one line of codes, six empty places at both ends, with their windows: from run ``left`` to run ``right``."""

    def __init__(self, texts: list[str | None]):
        points = [np.frombuffer((t or "").lower().encode("utf-32-le", "replace"), np.uint32) for t in texts]
        sizes = np.array([len(x) for x in points], np.int64)
        chars = np.concatenate(points) if points else np.zeros(0, np.uint32)
        codes = _codes()[np.minimum(chars, 0xFFFF)]
        for k in np.flatnonzero(chars > 0xFFFF).tolist():
            codes[k] = _code(int(chars[k]))
        owner = np.repeat(np.arange(len(texts)), sizes)
        letter = codes > 0
        breaks = np.ones(len(codes), bool)
        breaks[1:] = owner[1:] != owner[:-1]
        start = np.flatnonzero(letter & (breaks | ~np.r_[False, letter[:-1]]))
        end = np.flatnonzero(letter & (np.r_[breaks[1:], True] | ~np.r_[letter[1:], False])) + 1
        blank = np.r_[(chars[1:] == 32) | (chars[1:] == 9), True] | np.r_[breaks[1:], True]
        stops = (chars == 10) | (chars == 33) | (chars == 63) | ((chars == 46) & blank)
        number = np.r_[0, np.cumsum(stops | breaks)]  # of the sentence before a place; a text begins a new one
        joins = np.zeros(len(start), bool)
        if len(start) > 1:
            joins[:-1] = (start[1:] - end[:-1] <= GAP) & (number[start[1:] + 1] == number[end[:-1]])
        size = end - start
        at = np.cumsum(size + 1) - size - 1 + 6  # one place without a letter behind each run
        self.codes = np.zeros(int((size + 1).sum()) + 12, np.int8)
        keep = np.flatnonzero(letter)
        self.codes[6 + np.arange(len(keep)) + np.repeat(np.arange(len(start)), size)] = codes[keep]
        _, sentence = np.unique(number[start + 1], return_inverse=True)
        text = owner[start]
        long = np.flatnonzero(size > PLACES)
        more = [(at[k] + i, at[k] + min(i + n, size[k]), k) for k in long.tolist() for n, step in PIECES for i in range(0, max(1, int(size[k]) - n + step), step)]
        first, last, of = (np.array(x, np.int64) for x in (zip(*more) if more else ((), (), ())))
        small = lambda a, b: np.r_[a, b].astype(np.int32)
        self.start, self.end = small(at, first), small(at + size, last)
        self.text, self.sentence = small(text, text[of]), small(sentence, sentence[of])
        self.joins = np.r_[joins, np.zeros(len(of), bool)]
        self.n_texts, self.n_sentences = len(texts), int(sentence.max()) + 1 if len(sentence) else 0
        left, right = [], []
        a = b = np.arange(len(self.start), dtype=np.int32)
        while len(a):
            fits = self.end[b] - self.start[a] <= PLACES
            a, b = a[fits], b[fits]
            some = self.end[b] - self.start[a] - (b - a) >= 2
            left.append(a[some]), right.append(b[some])
            on = self.joins[b]
            a, b = a[on], b[on] + np.int32(1)
        self.left, self.right = np.concatenate(left or [a]), np.concatenate(right or [b])

    def strings(self, windows: np.ndarray) -> list[np.ndarray]:
        """The code rows of windows, ends included."""
        out = []
        for a, b in zip(self.start[self.left[windows]].tolist(), self.end[self.right[windows]].tolist()):
            row = np.empty(b - a + 2, np.int64)
            row[0], row[-1], row[1:-1] = START, STOP, self.codes[a:b]
            out.append(row)
        return out

    def bounds(self, weights: np.ndarray, bias: float) -> np.ndarray:
        """Upper bounds of the windows' values, equal to them where no triple repeats and the value is over the bias."""
        if not len(self.left):
            return np.zeros(0)
        grid = np.arange(LETTERS) > 0
        table = np.where((grid[:, None, None] & grid[None, :, None] & grid[None, None]).ravel(), weights, 0).astype(np.float32)
        x, n = self.codes.astype(np.int64), len(self.codes) - 6
        reach = np.zeros((5, n + 6), np.float32)  # of each place: triples that begin there and reach 2 to 6 places on
        for i in range(0, n, 1 << 15):
            y = x[i : min(n, i + (1 << 15)) + 6]
            m = len(y) - 6
            first = y[:m] * LETTERS**2
            pairs = [None] + [first + y[j : j + m] * LETTERS for j in range(1, 6)]
            total = np.zeros(m, np.float32)
            for k in range(2, 7):
                third = y[k : k + m]
                part = table.take(pairs[1] + third)
                for j in range(2, k):
                    part += table.take(pairs[j] + third)
                total += part * np.float32(LAMBDA ** (k - 2))
                reach[k - 2, i : i + m] = total
        there = (x > 0).astype(np.int64)
        pattern = sum(there[j : j + n] << j for j in range(7) if j < 6)
        pattern += np.r_[there[6:]] << 6
        squares = _squares()
        start, end = self.start, self.end
        s, e = x[start + np.arange(6)[:, None]], x[end - 1 - np.arange(6)[:, None]]
        heads = np.cumsum([sum(table[(START * LETTERS + s[p]) * LETTERS + s[q]] for p in range(q)) * LAMBDA ** (q - 1.0) for q in range(1, 6)], axis=0)
        tails = np.cumsum([sum(table[(e[q] * LETTERS + e[p]) * LETTERS + STOP] for p in range(q)) * LAMBDA ** (q - 1.0) for q in range(1, 6)], axis=0)
        back = end - 3 - np.arange(4)[:, None]  # triples that begin 3 to 6 places before the end and stay inside
        none = np.zeros((1, len(end)))
        inner = np.r_[none, np.cumsum(reach[np.arange(4)[:, None], back], axis=0)]
        inner2 = np.r_[none, np.cumsum(squares[np.arange(4)[:, None], pattern[np.minimum(back, n - 1)]], axis=0)]
        run = np.r_[0.0, np.cumsum(reach[4], dtype=np.float64)]
        run2 = np.r_[0.0, np.cumsum(squares[4][pattern])]
        out = np.empty(len(self.left))
        heads2, tails2 = _ends((s > 0).astype(np.int64)), _ends((e > 0).astype(np.int64))
        for i in range(0, len(out), 1 << 16):
            a, b = self.left[i : i + (1 << 16)], self.right[i : i + (1 << 16)]
            p, q = start[a], end[b]
            size = q - p
            near, edge, cut = np.minimum(size - 2, 4), np.minimum(size - 2, 4), np.maximum(p, q - 6)
            dot = run[cut] - run[p] + inner[near, b] + heads[edge, a] + tails[edge, b]
            norm2 = run2[cut] - run2[p] + inner2[near, b] + heads2[edge, a] + tails2[edge, b]
            short = np.flatnonzero(size <= 5)
            for k in range(5):  # both ends and one letter between
                at = short[size[short] > k]
                c = x[p[at] + k]
                dot[at] += table[(START * LETTERS + c) * LETTERS + STOP] * LAMBDA ** (size[at] - 1.0)
                norm2[at] += (c > 0) * LAMBDA ** (2 * (size[at] - 1.0))
            out[i : i + (1 << 16)] = np.where(dot > 0, dot / np.sqrt(np.maximum(norm2, 1e-12)), 0) + bias + 1e-4
        return out

    def exact(self, windows: np.ndarray, weights: np.ndarray, bias: float) -> np.ndarray:
        return Strings(self.strings(windows)).dot(weights) + bias if len(windows) else np.zeros(0)

    def highest(self, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each sentence with a window: the window of highest bound; and the sentence."""
        owner = self.sentence[self.left]
        best = np.full(self.n_sentences, -np.inf)
        np.maximum.at(best, owner, bounds)
        at = np.flatnonzero(bounds == best[owner])
        sentence, first = np.unique(owner[at], return_index=True)
        return at[first], sentence

    def top_two(self, weights: np.ndarray, bias: float) -> np.ndarray:
        """The two highest sentence values of each text, NONE where there is none."""
        out = np.full((self.n_texts, 2), NONE)
        if not len(self.left):
            return out
        bounds = self.bounds(weights, bias)
        owner, text = self.sentence[self.left], self.text[self.left]
        window, sentence = self.highest(bounds)
        of = text[window]
        order = np.lexsort((-bounds[window], of))
        rank = np.arange(len(order)) - np.searchsorted(of[order], of[order])
        probe = order[rank < 2]
        values = np.full(len(bounds), NONE)
        values[window[probe]] = self.exact(window[probe], weights, bias)
        floor = np.full(self.n_texts, np.inf)
        np.minimum.at(floor, of[probe], values[window[probe]])
        left = bounds > floor[text]
        left[window[probe]] = False
        left = np.flatnonzero(left)
        values[left] = self.exact(left, weights, bias)
        best = np.full(self.n_sentences, NONE)
        np.maximum.at(best, owner, values)
        order = np.lexsort((-best[sentence], of))
        rank = np.arange(len(order)) - np.searchsorted(of[order], of[order])
        for k in (0, 1):
            at = order[rank == k]
            out[of[at], k] = np.maximum(NONE, best[sentence[at]])
        return out


def parts(text: str | None) -> list[str]:
    """A text as it is, or a very long one in parts."""
    text, out = text or "", []
    while len(text) > PART:
        cut = max(text.rfind(x, PART // 2, PART) for x in "\n!?") + 1
        if cut:
            out.append(text[:cut])
            text = text[cut:]
        else:
            cut = text.rfind(" ", PART // 2, PART) + 1 or PART
            out.append(text[:cut])
            back = text.rfind(" ", cut - OVERLAP, cut - 1) + 1
            text = text[back or cut :]
    return [*out, text]


def _chunks(texts: list[str], limit: int = 250_000):
    """Slices of a list that hold about ``limit`` characters."""
    at = size = 0
    for k, t in enumerate(texts):
        if size and size + len(t) > limit:
            yield at, k
            at, size = k, 0
        size += len(t)
    if at < len(texts):
        yield at, len(texts)


def points_of(texts: list[str | None], weights: np.ndarray, bias: float) -> np.ndarray:
    """The two highest sentence values of each text."""
    cut = [parts(t) for t in texts]
    flat, owner = [p for x in cut for p in x], np.repeat(np.arange(len(cut)), [len(x) for x in cut])
    tops = [Sentences(flat[a:b]).top_two(weights, bias) for a, b in _chunks(flat)]
    tops = np.concatenate(tops) if tops else np.zeros((0, 2))
    if len(flat) == len(texts):
        return tops
    return np.array([np.sort(tops[owner == k].ravel())[::-1][:2] for k in range(len(texts))]).reshape(-1, 2)


# training ------------------------------------------------------------------------------------------------------------
def _groups_of(word: str) -> set[str]:
    """Letter groups whose documents are counted: inner groups of four, and beginnings of three to eight."""
    return {word[i : i + 4] for i in range(max(1, len(word) - 3))} | {"^" + word[:n] for n in range(3, min(8, len(word)) + 1)}


def first_witnesses(docs: list[tuple[int, str]], chance: float = 1e-3) -> list[str]:
    """Of each toxic document the word whose letter group marks toxic documents most clearly, if any does: clean documents almost never have the group, and that any group of as many
    documents came out so by chance, over all groups, is less likely than ``chance``; where there is no such group at all, the five least likely by chance serve."""
    words: dict[str, int] = {}
    bags = [np.array([words.setdefault(w, len(words)) for w in sorted(set(_WORD.findall((t or "").lower())))], np.int64) for _, t in docs]
    groups: dict[str, int] = {}
    flat, begin = array("q"), array("q", [0])
    for w in words:
        flat.extend([groups.setdefault(g, len(groups)) for g in sorted(_groups_of(w))])
        begin.append(len(flat))
    flat, begin = np.array(flat, np.int64), np.array(begin, np.int64)
    counts = np.zeros((2, len(groups)), np.int64)
    in_clean = np.zeros(len(words), np.int64)
    for (y, _), bag in zip(docs, bags):
        if len(bag):
            counts[int(bool(y)), np.unique(np.concatenate([flat[begin[w] : begin[w + 1]] for w in bag.tolist()]))] += 1
            in_clean[bag] += not y
    share = sum(bool(y) for y, _ in docs) / len(docs)
    limit = math.log(chance / max(1, int((counts[1] >= 3).sum())))
    rare = (counts[1] >= 3) & (counts[0] * share <= 0.02 * counts[1] * (1 - share))
    names = list(groups)
    told = []
    for g in np.flatnonzero(rare).tolist():
        n, k = int(counts[:, g].sum()), int(counts[1, g])
        tail = sum(math.exp(math.lgamma(n + 1) - math.lgamma(j + 1) - math.lgamma(n - j + 1) + j * math.log(share) + (n - j) * math.log1p(-share)) for j in range(k, n + 1))
        told.append((math.log(tail) if tail > 0 else -700.0, -k, names[g], g))
    told.sort()
    place = np.full(len(groups) + 1, len(told))
    for k, (p, _, _, g) in enumerate(told):
        if p <= limit or (told[0][0] > limit and k < 5):
            place[g] = k
    of = np.minimum.reduceat(place[flat], begin[:-1]) if len(flat) else np.zeros(0, np.int64)  # no word is without a group
    of[in_clean > 0] = len(told)
    names = list(words)
    clearest = {int(bag[of[bag].argmin()]) for (y, _), bag in zip(docs, bags) if y and len(bag) and of[bag].min() < len(told)}
    return sorted(names[w] for w in clearest)


def _distinct(rows: list[np.ndarray]) -> list[np.ndarray]:
    return list({r.tobytes(): r for r in rows}.values())


def train_machine(docs: list[tuple[int, str]], how: Training = Training()) -> tuple[np.ndarray, float] | None:
    """Labelled documents [(toxic, text)] -> (a weight for each letter triple, bias); None where one of the labels is missing."""
    toxic, clean = [t for y, t in docs if y], [t for y, t in docs if not y]
    if not toxic or not clean:
        return None
    words = Sentences(first_witnesses(docs))
    positive = seeds = _distinct(words.strings(np.flatnonzero(words.left == words.right)))
    sides = [[Sentences(side[a:b]) for a, b in _chunks([t or "" for t in side], 500_000)] for side in (toxic, clean)]
    windows = sum(len(s.left) for s in sides[1])
    if not positive or not windows:
        return None
    rng = np.random.default_rng(how.seed)
    drawn = np.sort(rng.permutation(windows)[: how.negatives])
    begin = np.cumsum([0, *(len(s.left) for s in sides[1])])
    negative = _distinct([r for s, lo, hi in zip(sides[1], begin, begin[1:]) for r in s.strings(drawn[(drawn >= lo) & (drawn < hi)] - lo)])
    pool = [negative[k] for k in rng.permutation(len(negative))[: how.pool]]
    model = machine(positive, negative, spread(positive, how.landmarks * 2 // 3) + spread(pool, how.landmarks // 3))
    for _ in range(how.rounds):
        usual = np.concatenate([_sentence_bounds(s, model) for s in sides[1]])
        least = max(0.0, float(np.quantile(usual, 1 - how.noise)))
        positive, hard = _distinct(seeds + _positive(sides[0], model, least)), _hardest(sides[1], model, how.hard)
        marks = spread(positive, how.landmarks * 2 // 3) + spread(hard or pool, how.landmarks // 6) + spread(pool, how.landmarks // 6)
        model = machine(positive, _distinct(negative + hard), marks)
    return model


def _sentence_bounds(s: Sentences, model: tuple[np.ndarray, float]) -> np.ndarray:
    bounds = s.bounds(*model)
    return bounds[s.highest(bounds)[0]]


def _positive(chunks: list[Sentences], model: tuple[np.ndarray, float], least: float) -> list[np.ndarray]:
    """The witnesses of the positive sentences, those with a value over ``least``."""
    out = []
    for s in chunks:
        bounds = s.bounds(*model)
        at = s.highest(bounds)[0]
        at = at[bounds[at] > least]
        out += s.strings(at[s.exact(at, *model) > least])
    return out


def _hardest(chunks: list[Sentences], model: tuple[np.ndarray, float], n: int) -> list[np.ndarray]:
    """The n distinct clean windows of highest bound, over all of them."""
    best: dict[bytes, tuple[float, np.ndarray]] = {}
    for s in chunks:
        bounds = s.bounds(*model)
        at = np.argsort(-bounds, kind="stable")[: 4 * n]
        best |= {r.tobytes(): (b, r) for b, r in zip(bounds[at].tolist(), s.strings(at))}
        best = dict(sorted(best.items(), key=lambda x: (-x[1][0], x[0]))[:n])
    return [r for _, r in best.values()]


def _platt(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Logistic regression with a small ridge on (x, 1); clean documents weigh three times as much as toxic ones."""
    x = np.c_[x, np.ones(len(x))]
    c = np.where(y, 0.25 / max(1, y.sum()), 0.75 / max(1, (~y).sum()))
    w = np.zeros(x.shape[1])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (c * (p - y)) + 1e-4 * w * [1, 1, 0]
        hessian = (x * (c * p * (1 - p) + 1e-9)[:, None]).T @ x + 1e-4 * np.diag([1, 1, 1e-3])
        step = np.linalg.solve(hessian, gradient)
        w -= step * min(1, 5 / np.abs(step).max()) if np.abs(step).max() > 0 else 0
    return w


def train_part(docs: list[tuple[int, str]], part: int, how: Training = Training()):
    """Part 0: the machine of all documents. Parts 1 and 2: (sentence values, labels) of one half by a machine of the other."""
    if part == 0:
        return train_machine(docs, how)
    side = [zlib.crc32(b"%d" % k) >> 7 & 1 for k in range(len(docs))]
    half, rest = [d for k, d in zip(side, docs) if k == part - 1], [d for k, d in zip(side, docs) if k != part - 1]
    model = train_machine(half, how) or train_machine(docs, how)
    return None if model is None else (points_of([t for _, t in rest], *model), np.array([bool(y) for y, _ in rest]))


def assembled(found: list) -> dict | None:
    """The three parts -> {weights, bias, platt}."""
    if found[0] is None:
        return None
    x, y = (np.concatenate([f[k] for f in found[1:]]) for k in (0, 1))
    return {"weights": found[0][0], "bias": found[0][1], "platt": _platt(x, y)}


def train(docs: list[tuple[int, str]], how: Training = Training()) -> dict | None:
    """Labelled documents -> {weights, bias, platt}; None where one of the labels is missing."""
    return assembled([train_part(docs, part, how) for part in range(3)])


def labelled(docs: DataFrame, labels: DataFrame, how: Training = Training()) -> list[tuple[int, str]]:
    """The training documents: not held out, at most ``per_class`` rows of each label and ``longest`` bytes each, lowest hash of doc_id first."""
    marks = labels.where("toxic is not null and doc_id is not null").where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    ids = rows = None
    for y in (0, 1):
        part = marks.where(F.col("toxic") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(how.per_class)
        ids = part if ids is None else ids.unionAll(part)
    texts = docs.select("doc_id", "text").where(F.coalesce(F.octet_length("text"), F.lit(0)) <= how.longest).join(F.broadcast(ids), "doc_id")
    for y in (0, 1):  # an id may stand for many rows
        part = texts.where(F.col("toxic") == y).orderBy(F.xxhash64("doc_id"), "doc_id", F.xxhash64("text")).limit(how.per_class)
        rows = part if rows is None else rows.unionAll(part)
    return [(r.toxic, r.text) for r in sorted(rows.collect(), key=lambda r: (r.doc_id, r.text or ""))]


def train_in_tasks(spark: SparkSession, docs: list[tuple[int, str]], how: Training = Training()) -> dict | None:
    """``train``, with its three parts as three tasks."""
    sent = spark.sparkContext.broadcast(docs)

    def run(it):
        held(("toxicity", "training"), int)  # what another operator left in this worker goes
        for batch in it:
            for part in batch.column(0).to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array([part]), pa.array([pickle.dumps(train_part(sent.value, part, how))])], ["part", "model"])
        _give_back()

    found = {r.part: pickle.loads(r.model) for r in spark.range(0, 3, 1, 3).mapInArrow(run, "part long, model binary").collect()}
    sent.destroy()
    return assembled([found[k] for k in range(3)])


# scoring -------------------------------------------------------------------------------------------------------------
class Scorer:
    """Document scores of a model; all 0 without one."""

    def __init__(self, model: dict | None):
        self.model = model

    def __call__(self, texts: list[str | None]) -> np.ndarray:
        if self.model is None:
            return np.zeros(len(texts))
        points = points_of(texts, self.model["weights"], self.model["bias"])
        return 1 / (1 + np.exp(-np.clip(np.c_[points, np.ones(len(points))] @ self.model["platt"], -30, 30)))


def _scoring(model, key: int, finish):
    def run(it):
        scorer = held(("toxicity", key), lambda: Scorer(model.value))
        for batch in it:
            if batch.num_rows:
                texts = batch.column(batch.schema.get_field_index("text")).to_pylist()
                yield finish(batch, scorer(texts))
        _give_back()

    return run


def _give_back() -> None:
    """Returns free memory to the system, where the C library can: the driver and the workers live on."""
    gc.collect()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def _shared_model(docs: DataFrame, labels: DataFrame, how: Training):
    spark = docs.sparkSession
    model = train_in_tasks(spark, labelled(docs, labels, how), how)
    _give_back()
    key = 0 if model is None else hash((model["weights"].tobytes(), model["bias"]))
    small_batches(spark)
    return spark.sparkContext.broadcast(model), key


def scores(docs: DataFrame, labels: DataFrame, how: Training = Training()) -> DataFrame:
    """Documents (doc_id, text) -> (doc_id, held_out, score, predicted), one row for each input row."""
    model, key = _shared_model(docs, labels, how)

    def finish(batch, score):
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(score), pa.array((score >= CUT).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    rows = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text")
    return rows.mapInArrow(_scoring(model, key, finish), "doc_id long, held_out boolean, score double, predicted int")


def without_toxic(docs: DataFrame, labels: DataFrame, how: Training = Training()) -> DataFrame:
    """The documents whose score is under CUT, all columns as they are."""
    model, key = _shared_model(docs, labels, how)
    names = [f"_{i}" for i in range(len(docs.columns))]
    plain = docs.toDF(*[("text" if c == "text" else n) for c, n in zip(docs.columns, names)])
    kept = plain.mapInArrow(_scoring(model, key, lambda batch, score: batch.filter(pa.array(score < CUT))), plain.schema)
    return kept.toDF(*docs.columns)


def op6_subsequence_svm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
