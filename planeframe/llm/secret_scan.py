"""Secret scans: fixed patterns, and a character convolutional network in numpy over every candidate with its context.

Base kinds, each leftmost and non-overlapping: ``assign`` (a key word, = or :, a value of six or more characters), ``access``
(AKIA and at least 20 characters) and ``hex`` (24 or more hex digits). They always stay.

A candidate is every run of MIN_LENGTH or more non-blank characters, or what base spans leave of it where that is as long. The network
reads WIDTH characters around it as classes, with a mark on the candidate's own places; one longer than INSIDE is read whole in windows
of INSIDE characters, STEP apart, and has the highest probability of them. The network is one convolution, maxima inside and
outside the candidate, one hidden layer. It is trained on labelled findings: the base findings of a bounded sample of documents, with their key words
as they stand and with other random secrets put in their place, against the sample's own runs (some at random, more of those that a first network takes for findings), words, identifiers, dates, numbers and addresses
in the contexts of the same sample. Short secrets, passwords with signs and those of letters or digits only are made after lead words alone,
as nothing but the context tells them from words and numbers. Every fifth document of the sample, with all that is made from it, is held out: the threshold is the
highest that keeps RECALL of such findings with 95 % certainty, after a temperature is fitted on them. The bounds of the sample are the fields of ``Training``.

Edge cases: null and empty texts have no spans; texts are read whole; repeated rows are scanned alike; without findings in the sample
the network is trained on the made ones in plain contexts.
"""

from __future__ import annotations

import hashlib
import re
import string
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import done, forget, small_batches, table, written

KINDS = ("assign", "access", "hex", "cnn")
ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.A | re.I)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
MIN_LENGTH = 8
CANDIDATE = re.compile(r"\S{%d,}" % MIN_LENGTH)
BEFORE, INSIDE, AFTER = 24, 48, 8
WIDTH = BEFORE + INSIDE + AFTER
STEP = INSIDE // 2
FILTERS, KERNEL, HIDDEN = 24, 5, 16
RECALL, UNSEEN = 0.99, 0.5  # UNSEEN: the threshold where no finding was held out to set it by
KEYED = r"(?i)(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]|AKIA[A-Z0-9]{16}"
HELD_OUT = 5  # every so many documents of the sample is held out of training


@dataclass(frozen=True)
class Training:
    """What the network learns from: at most ``documents`` rows, half of them with a key word, lowest hash of doc_id first, of at most ``longest`` bytes each;
    in each the ``findings`` first base findings, ``own`` runs and ``contexts`` places for made strings; of all that ``rows`` rows drawn at random; and ``hard`` runs, drawn from all that a first network finds in the sample's texts."""

    documents: int = 2000
    longest: int = 65_536
    findings: int = 20
    own: int = 4
    contexts: int = 3
    rows: int = 12_000
    hard: int = 3_000
    seed: int = 11

_CLASSES = [string.digits, "abcdef", "ghijklm", "nopqrstuvwxyz", "ABCDEF", "GHIJKLMNOPQRSTUVWXYZ", "+/", "=", ":", "_-", ".,", "\"'", " ", "\n\t", "@#&?%"]
N_CLASSES = len(_CLASSES) + 3
_CLASS = np.full(256, len(_CLASSES) + 1, np.int8)
for _k, _chars in enumerate(_CLASSES):
    _CLASS[[ord(c) for c in _chars]] = _k + 1
_CLASS[128:] = len(_CLASSES) + 2


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Findings of the fixed patterns by start, then kind as listed; code points, end exclusive."""
    found = [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        found += [("access", m.start(), m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    found += [("hex", m.start(), m.end()) for m in HEX.finditer(text)]
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0])))


def candidates(text: str, base: list[tuple[str, int, int]]) -> list[tuple[int, int]]:
    """Runs of MIN_LENGTH or more non-blank characters outside the base spans."""
    found, k, covers = [], 0, sorted((s, e) for _, s, e in base)
    for m in CANDIDATE.finditer(text):
        at, end = m.span()
        while k < len(covers) and covers[k][1] <= at:
            k += 1
        for s, e in covers[k:]:
            if s >= end:
                break
            if s - at >= MIN_LENGTH:
                found.append((at, s))
            at = max(at, e)
        if end - at >= MIN_LENGTH:
            found.append((at, end))
    return found


def windows(start: int, end: int) -> list[tuple[int, int]]:
    """A candidate as it is, or the overlapping windows of a long one."""
    if end - start <= INSIDE:
        return [(start, end)]
    return [(s, s + INSIDE) for s in [*range(start, end - INSIDE, STEP), end - INSIDE]]


def encode(text: str, start: int, end: int) -> tuple[np.ndarray, np.ndarray]:
    """Character classes (0: no character) of what is around a window and in it, and the mark of the window."""
    left, right = text[max(0, start - BEFORE) : start], text[end : end + AFTER]
    own = text[start:end]
    out, mark = np.zeros(WIDTH, np.int8), np.zeros(WIDTH, np.float32)
    for part, at in ((left, BEFORE - len(left)), (own, BEFORE), (right, BEFORE + len(own))):
        out[at : at + len(part)] = _CLASS[np.frombuffer(part.encode("latin-1", "replace"), np.uint8)]
    mark[BEFORE : BEFORE + len(own)] = 1
    return out, mark


class Network:
    """Embedding by class, convolution with ReLU, maxima inside and outside the candidate, a hidden layer, one logit."""

    def __init__(self, rng: np.random.Generator):
        n = lambda *shape, scale: (rng.standard_normal(shape) * scale).astype(np.float32)
        self.p = {"conv": n(KERNEL, N_CLASSES + 1, FILTERS, scale=0.2), "cb": np.zeros(FILTERS, np.float32), "hid": n(3 * FILTERS + 1, HIDDEN, scale=0.15), "hb": np.zeros(HIDDEN, np.float32), "out": n(HIDDEN, scale=0.3), "ob": np.zeros(1, np.float32)}
        self.temperature, self.threshold = 1.0, UNSEEN

    def _input(self, codes: np.ndarray, mark: np.ndarray) -> np.ndarray:
        x = np.zeros((*codes.shape, N_CLASSES + 1), np.float32)
        np.put_along_axis(x, codes[..., None].astype(np.int64), 1, 2)
        x[..., 0] = 0
        x[..., -1] = mark
        return x

    def forward(self, codes: np.ndarray, mark: np.ndarray):
        p, x = self.p, self._input(codes, mark)
        n = WIDTH - KERNEL + 1
        cols = np.lib.stride_tricks.sliding_window_view(x, KERNEL, axis=1).transpose(0, 1, 3, 2).reshape(len(codes) * n, -1)
        conv = np.maximum(cols @ p["conv"].reshape(-1, FILTERS) + p["cb"], 0).reshape(len(codes), n, FILTERS)
        m = mark[:, KERNEL // 2 : KERNEL // 2 + n, None]
        inside, outside = conv * m, conv * (1 - m)
        length = mark.sum(1, keepdims=True)
        features = np.concatenate([inside.max(1), outside.max(1), inside.sum(1) / np.maximum(length, 1), length / INSIDE], 1)
        hidden = np.maximum(features @ p["hid"] + p["hb"], 0)
        return hidden @ p["out"] + p["ob"], (cols, conv, m, inside, outside, length, features, hidden)

    def gradients(self, codes: np.ndarray, mark: np.ndarray, y: np.ndarray) -> dict:
        p = self.p
        logit, (cols, conv, m, inside, outside, length, features, hidden) = self.forward(codes, mark)
        d = ((1 / (1 + np.exp(-np.clip(logit, -30, 30))) - y) / len(y)).astype(np.float32)
        g = {"out": hidden.T @ d, "ob": d.sum(keepdims=True)}
        dh = d[:, None] * p["out"] * (hidden > 0)
        g |= {"hid": features.T @ dh, "hb": dh.sum(0)}
        df = dh @ p["hid"].T
        dc = np.zeros_like(conv)
        rows, filters = np.arange(len(y))[:, None], np.arange(FILTERS)[None]
        for k, (part, w) in enumerate(((inside, m), (outside, 1 - m))):
            at = part.argmax(1)
            dc[rows, at, filters] += df[:, k * FILTERS : (k + 1) * FILTERS] * w[rows, at, 0]
        dc += (df[:, 2 * FILTERS : 3 * FILTERS] / np.maximum(length, 1))[:, None, :] * m
        dc = (dc * (conv > 0)).reshape(-1, FILTERS)
        return g | {"conv": (cols.T @ dc).reshape(p["conv"].shape), "cb": dc.sum(0)}

    def train(self, codes, mark, y, rng, epochs: int = 12, batch: int = 128, rate: float = 3e-3) -> None:
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        s = {k: np.zeros_like(v) for k, v in self.p.items()}
        step = 0
        for _ in range(epochs):
            order = rng.permutation(len(y))
            for i in range(0, len(y), batch):
                at, step = order[i : i + batch], step + 1
                for k, g in self.gradients(codes[at], mark[at], y[at]).items():
                    m[k] = 0.9 * m[k] + 0.1 * g
                    s[k] = 0.999 * s[k] + 0.001 * g * g
                    self.p[k] = (self.p[k] - rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(s[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)

    def calibrate(self, codes, mark, y) -> None:
        """Temperature of least log loss on held-out rows, then the highest threshold that keeps RECALL of all such findings, as far as the held-out ones tell (95 % sure)."""
        logit = self.forward(codes, mark)[0]
        loss = lambda t: np.logaddexp(0, np.where(y > 0, -logit, logit) / t).mean()
        self.temperature = min(np.geomspace(0.25, 8, 41), key=loss)
        p = np.sort(self.probability(codes[y > 0], mark[y > 0]))
        missed = len(p) * (1 - RECALL) - 1.645 * (len(p) * (1 - RECALL) * RECALL) ** 0.5
        self.threshold = float(p[max(0, int(missed))]) if len(p) else UNSEEN

    def sure(self, logit: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(logit / self.temperature, -30, 30)))

    def tables(self) -> tuple[np.ndarray, np.ndarray]:
        """The convolution's sums for every three classes, and for every two after them."""
        t = self.p["conv"][:, :N_CLASSES].copy()
        t[:, 0] = 0
        return (t[0][:, None, None] + t[1][None, :, None] + t[2][None, None]).reshape(-1, FILTERS), (t[3][:, None] + t[4][None]).reshape(-1, FILTERS)

    def quick(self, codes: np.ndarray, length: int, tables: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
        """Logits, as of ``forward``, of candidates of one length: codes from BEFORE places before to AFTER places behind each."""
        p = self.p
        codes = np.pad(codes.astype(np.int32), ((0, 0), (0, min(KERNEL, INSIDE - length))))
        n = codes.shape[1] - KERNEL + 1
        pairs = codes[:, :-1] * N_CLASSES + codes[:, 1:]
        mark = np.zeros(codes.shape[1], np.float32)
        mark[BEFORE : BEFORE + length] = 1
        conv = tables[0][pairs[:, :n] * N_CLASSES + codes[:, 2 : 2 + n]]
        conv += tables[1][pairs[:, 3 : 3 + n]]
        conv += np.lib.stride_tricks.sliding_window_view(mark, KERNEL) @ p["conv"][:, -1] + p["cb"]
        np.maximum(conv, 0, out=conv)
        a = BEFORE - KERNEL // 2
        inside = conv[:, a : a + length]
        outside = np.maximum(conv[:, :a].max(1), conv[:, a + length :].max(1))
        features = np.concatenate([inside.max(1), outside, inside.sum(1) / length, np.full((len(codes), 1), length / INSIDE, np.float32)], 1)
        return np.maximum(features @ p["hid"] + p["hb"], 0) @ p["out"] + p["ob"]

    def probability(self, codes: np.ndarray, mark: np.ndarray) -> np.ndarray:
        parts = [self.forward(codes[i : i + 256], mark[i : i + 256])[0] for i in range(0, len(codes), 256)]
        return self.sure(np.concatenate(parts)) if parts else np.zeros(0)


_LEADS = ("", "key: ", "credential=", "bearer ", "pwd is ")
_LOWER, _ALNUM = string.ascii_lowercase, string.ascii_letters + string.digits


def _made(rng: np.random.Generator, secret: bool) -> str:
    """A random secret, or a string of the same shape of characters that is none."""
    pick = lambda chars, n: "".join(rng.choice(list(chars), n))
    word = lambda: pick(_LOWER, int(rng.integers(3, 9)))
    if secret:
        kind = rng.integers(0, 4)
        n = int(rng.integers(20, 49))
        return [lambda: pick(_ALNUM, n), lambda: pick(_ALNUM + "+/", n) + "=" * int(rng.integers(0, 3)), lambda: pick("0123456789ABCDEF", n), lambda: word()[:2] + "_" + pick(_ALNUM, n)][kind]()
    kind = rng.integers(0, 6)
    number = str(int(rng.integers(1, 10**6)))
    return [
        lambda: "-".join(word() for _ in range(4)) + "-" + number,
        lambda: "_".join(word() for _ in range(3)) + "_" + number,
        lambda: "/".join(word() for _ in range(4)) + "/" + number,
        lambda: f"2024-{rng.integers(1, 13):02d}-{rng.integers(1, 29):02d}T{rng.integers(0, 24):02d}-" + word(),
        lambda: number + word() + word() + word(),
        lambda: "".join(word().title() for _ in range(4)) + number,
    ][kind]()


def _weak(rng: np.random.Generator) -> str:
    """A random secret that only its context tells from other text: short, of letters or digits alone, or with signs."""
    n = int(rng.integers(MIN_LENGTH, 25))
    chars = [_ALNUM, _LOWER, string.ascii_letters, string.digits, _ALNUM + "!@#$%.^&*?"][rng.integers(0, 5)]
    return "".join(rng.choice(list(chars), n))


def _labelled(text: str, start: int, end: int, secret: bool) -> list[tuple]:
    return [(*encode(text, s, e), float(secret)) for s, e in windows(start, end)]


def _chained(rng: np.random.Generator, around: str) -> list[tuple]:
    """A secret within a path or chain of keys: the windows with most a window can have of it are findings, those with none are not."""
    word = lambda: "".join(rng.choice(list(_LOWER), int(rng.integers(3, 9))))
    sign = ["/", "_", "-", "=", "&", "/"][rng.integers(0, 6)]
    head, tail = (sign.join(word() for _ in range(rng.integers(6, 14))) for _ in range(2))
    made = _made(rng, True)
    text, at = f"{around} {head}{sign}{made}{sign}{tail} {around}", len(around) + len(head) + 2
    rows = []
    for s, e in windows(len(around) + 1, len(text) - len(around) - 1):
        shared = min(e, at + len(made)) - max(s, at)
        if shared <= 0 or shared >= min(len(made), STEP):
            rows.append((*encode(text, s, e), float(shared > 0)))
    return rows


def training_rows(texts: list[str], rng: np.random.Generator, how: Training = Training()):
    """Labelled findings of the sample: (codes, marks, labels, number of the document)."""
    rows, document, plain = [], [], []

    def add(found: list[tuple], k: int) -> None:
        rows.extend(found)
        document.extend([k] * len(found))

    for k, text in enumerate(texts):
        base = base_spans(text)
        for kind, s, e in base[: how.findings]:
            if kind == "assign":
                s, e = ASSIGN.match(text, s).span(2)
            if e - s >= MIN_LENGTH:
                add(_labelled(text, s, e, True), k)
            head, tail = text[max(0, s - BEFORE) : s], text[e : e + AFTER]
            for secret in (True, False):
                made = _made(rng, secret)
                add(_labelled(head + made + tail, len(head), len(head) + len(made), secret), k)
        words, own = text.split(), candidates(text, base)
        for c in rng.integers(0, len(own), how.own) if own else ():
            add(_labelled(text, *own[c], False), k)
        if len(words) > 6:
            plain += [(k, " ".join(words[c : c + 3])) for c in rng.integers(0, max(1, len(words) - 3), how.contexts)]
    if not plain:  # nothing to learn contexts from: three random words each
        word = lambda: "".join(rng.choice(list(_LOWER), int(rng.integers(2, 9))))
        plain = [(len(texts) + c, f"{word()} {word()} {word()}") for c in range(600)]
    for k, around in plain:
        made, at = _made(rng, False), len(around) + 1
        add(_labelled(f"{around} {made} {around}", at, at + len(made), False), k)
        made, lead = _made(rng, True), _LEADS[rng.integers(0, 5)]
        add(_labelled(f"{around} {lead}{made} {around}", at + len(lead), at + len(lead) + len(made), True), k)
        weak, lead = _weak(rng), _LEADS[rng.integers(1, 5)]
        add(_labelled(f"{around} {lead}{weak} {around}", at + len(lead), at + len(lead) + len(weak), True), k)
        if lead[-1] != " ":  # as candidates have it: one run from the lead on
            add(_labelled(f"{around} {lead}{weak} {around}", at, at + len(lead) + len(weak), True), k)
        add(_chained(rng, around), k)
    at = rng.permutation(len(rows))[: how.rows]
    return (*(np.array([rows[r][c] for r in at]) for c in range(3)), np.array(document)[at])


def _hard(texts: list[str], network: Network, rng: np.random.Generator, n: int) -> list[tuple]:
    """Runs outside the base spans that the network takes for findings, as other strings: n of them."""
    found = []
    for at in range(0, len(texts), 250):
        for text, (_, spans) in zip(texts[at : at + 250], all_spans(texts[at : at + 250], network)):
            found += [(text, s, e) for kind, s, e in spans if kind == "cnn"]
    return [row for k in rng.permutation(len(found))[:n] for row in _labelled(*found[k], False)]


def trained(texts: list[str], how: Training = Training()) -> Network:
    """The network, its temperature and threshold set by documents that it has not seen."""
    rng = np.random.default_rng(how.seed)
    codes, mark, y, document = training_rows(texts, rng, how)
    y, held = y.astype(np.float32), document % HELD_OUT == HELD_OUT - 1
    seen = [t for k, t in enumerate(texts) if k % HELD_OUT != HELD_OUT - 1]
    learn = codes[~held], mark[~held], y[~held]
    for last in (False, True):
        network = Network(np.random.default_rng(how.seed))
        network.train(*learn, rng)
        network.calibrate(codes[held], mark[held], y[held])
        more = [] if last else _hard(seen, network, rng, how.hard)
        if not more:
            break
        learn = tuple(np.concatenate([x, np.array([row[c] for row in more], x.dtype)]) for c, x in enumerate(learn))
    return network


def _highest(texts: list[str], where: list[tuple[int, int, int]], network: Network) -> np.ndarray:
    """The probability of each candidate (text, start, end), the highest of its windows."""
    if not where:
        return np.zeros(0)
    gap = np.zeros(BEFORE, np.int8)
    codes = np.concatenate([gap, *(x for t in texts for x in (_CLASS[np.frombuffer(t.encode("latin-1", "replace"), np.uint8)], gap))])
    begins = np.cumsum([BEFORE, *(len(t) + BEFORE for t in texts)])
    text, start, end = np.array(where, np.int64).T
    start, end = start + begins[text], end + begins[text]
    size = end - start
    tables, out = network.tables(), np.zeros(len(where))
    for n in np.unique(np.minimum(size, INSIDE)).tolist():
        rows = np.flatnonzero(np.minimum(size, INSIDE) == n)
        if n == INSIDE:  # one row for each window, from the first place and every STEP places, the last one at the candidate's end
            count = -(-(size[rows] - INSIDE) // STEP) + 1
            rows = np.repeat(rows, count)
            place = np.arange(len(rows)) - np.repeat(np.cumsum(count) - count, count)
            first = np.minimum(start[rows] + place * STEP, end[rows] - INSIDE)
        else:
            first = start[rows]
        for i in range(0, len(rows), 256):
            at = first[i : i + 256]
            p = network.sure(network.quick(codes[at[:, None] - BEFORE + np.arange(BEFORE + n + AFTER)], n, tables))
            np.maximum.at(out, rows[i : i + 256], p)
    return out


def all_spans(texts: list[str], network: Network) -> list[tuple[list, list]]:
    """(base spans, all spans) of each text; the network sees all candidates of the texts at once."""
    bases = [base_spans(t) for t in texts]
    where = [(k, s, e) for k, t in enumerate(texts) for s, e in candidates(t, bases[k])]
    extra: dict[int, list] = {}
    for (k, s, e), p in zip(where, _highest(texts, where, network).tolist()):
        if p >= network.threshold:
            extra.setdefault(k, []).append(("cnn", s, e))
    return [(b, sorted(b + extra.get(k, []), key=lambda s: (s[1], KINDS.index(s[0])))) for k, b in enumerate(bases)]


def _joined(spans: list) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def _scan(network):
    def run(it):
        for batch in it:
            if not batch.num_rows:
                continue
            found = all_spans([t or "" for t in batch.column(1).to_pylist()], network.value)
            counts = [pa.array([sum(k == kind for k, _, _ in b) for b, _ in found], pa.int64()) for kind in KINDS[:3]]
            sha = pa.array([hashlib.sha256(_joined(b).encode()).hexdigest() for b, _ in found])
            yield pa.RecordBatch.from_arrays([batch.column(0), *counts, sha, pa.array([_joined(s) for _, s in found])], ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    return run


def sampled(docs: DataFrame, how: Training = Training()) -> list[str]:
    """The texts of the sample; each text is searched for key words once, ids travel without texts."""
    marked = docs.where("text is not null and doc_id is not null").where(F.octet_length("text") <= how.longest)
    marked = written(marked.select("doc_id", F.col("text").rlike(KEYED).alias("keyed"), F.xxhash64("doc_id").alias("h")), "keyed")
    ids = None
    for flag in (True, False):
        part = marked.where(F.col("keyed") == flag).orderBy("h", "doc_id").limit(how.documents // 2).select("doc_id")
        ids = part if ids is None else ids.unionAll(part)
    ids = done(ids.distinct(), "ids", [marked])
    rows = docs.select("doc_id", "text").where(F.octet_length("text") <= how.longest).join(F.broadcast(ids), "doc_id")
    rows = rows.orderBy(F.xxhash64("doc_id"), "doc_id", F.xxhash64("text")).limit(how.documents).collect()  # an id may stand for many rows
    forget(ids)
    return [r.text for r in sorted(rows, key=lambda r: (r.doc_id, r.text))]


def secrets(docs: DataFrame, how: Training = Training()) -> DataFrame:
    """Documents (doc_id, text) -> (doc_id, n_assign, n_access, n_hex, base_sha256, spans), one row for each input row."""
    spark = docs.sparkSession
    small_batches(spark)
    network = trained(sampled(docs, how), how)
    return docs.select("doc_id", "text").mapInArrow(_scan(spark.sparkContext.broadcast(network)), "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def op9_secret_network(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets(table(spark, sf_dir, "documents"))
