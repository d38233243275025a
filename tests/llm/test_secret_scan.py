import hashlib
import random
import re

import numpy as np
import pytest

from planeframe.llm import secret_scan as S

ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I | re.A)


def brute(t):
    out = [(m.start(), 0, "assign", m.end()) for m in ASSIGN.finditer(t) if len(m[2]) >= 6]
    out += [(m.start(), 1, "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
    out += [(m.start(), 2, "hex", m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]
    return [(k, s, e) for s, _, k, e in sorted(out)]


TEXTS = [
    "secret: token = \"abcdef123\"", "PASSWORD='hunter22' x", "api_key=abc", "apikey: " + "0af3" * 10, "AKIA" + "Z9" * 10 + " AKIAAKIA1", "é" * 5 + "a1" * 13, "toKen = abcdefgh", "token=token=abcdef", "AKIAab" + "AKIA" + "X" * 16,
]


def test_base_spans():
    rng = random.Random(1)
    more = ["".join(rng.choice(["token", "=", " ", "abcdef0123", "AKIA", "X7", "'", ":", "secret", "é", "-"]) for _ in range(30)) for _ in range(300)]
    for t in TEXTS + more:
        assert S.base_spans(t) == brute(t), t


def test_gradients():
    rng = np.random.default_rng(0)
    network = S.Network(rng)
    codes, mark, y, _ = S.training_rows(["token = abcdefghij0123456789 here and some more words to sample from"] * 4, rng, S.Training(rows=24))
    network.p = {k: v.astype(np.float64) for k, v in network.p.items()}
    y = y.astype(np.float64)
    loss = lambda: np.logaddexp(0, np.where(y > 0, -1, 1) * network.forward(codes, mark)[0]).mean()
    g = network.gradients(codes, mark, y)
    for k in ("conv", "hid", "out", "cb", "hb", "ob"):
        at = np.unravel_index(np.abs(g[k]).argmax(), g[k].shape)
        network.p[k][at] += 1e-3
        up = loss()
        network.p[k][at] -= 2e-3
        down = loss()
        network.p[k][at] += 1e-3
        assert abs((up - down) / 2e-3 - g[k][at]) < 0.1 * abs(g[k][at]) + 1e-4


@pytest.fixture(scope="module")
def network():
    rng = random.Random(3)
    words = ["the", "and", "ertion", "thand", "over", "ing", "of"]
    texts = []
    for k in range(120):
        text = " ".join(rng.choice(words) for _ in range(60))
        texts.append(text + (f' token = "{rng.getrandbits(160):040x}" more' if k % 2 else ""))
    return S.trained(texts)


def _rows_of_unseen(texts, seed):
    codes, mark, y, _ = S.training_rows(texts, np.random.default_rng(seed))
    return codes, mark, y > 0


def test_held_out_recall():
    """RECALL of the findings of documents the network has not seen, also where its sample had no finding at all."""
    rng = random.Random(12)
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrst") for _ in range(rng.randint(2, 9)))
    plain = lambda: " ".join(word() for _ in range(rng.randint(20, 80)))
    keyed = lambda: f"{plain()} token = '{''.join(rng.choice('abcXYZ0189') for _ in range(24))}' {plain()}"
    for make, other in ((keyed, keyed), (plain, plain)):
        network = S.trained([make() for _ in range(600)])
        codes, mark, y = _rows_of_unseen([other() for _ in range(400)], 77)
        found = network.probability(codes, mark) >= network.threshold
        assert found[y].mean() >= S.RECALL
        assert found[~y].mean() <= 0.05


def test_documents_are_held_out_whole():
    texts = [f"{k} some plain words and more of them here" for k in range(50)]
    *_, document = S.training_rows(texts, np.random.default_rng(0))
    assert set(document) == set(range(50))
    seen = {}
    for fold in (True, False):
        seen[fold] = set(document[(document % S.HELD_OUT == S.HELD_OUT - 1) == fold].tolist())
    assert not seen[True] & seen[False] and seen[True]


def test_sample_is_bounded(docs_of):
    docs = docs_of([(k, f"token = 'abcdefgh{k}x1234' " + "w " * (k % 7)) for k in range(60)] + [(1, f"again {k}") for k in range(40)] + [(200, "long " * 10_000), (201, None)])
    got = S.sampled(docs, S.Training(documents=10, longest=1000))
    assert len(got) == 10 and all(len(t) <= 1000 for t in got)
    assert S.sampled(docs_of([])) == []


def test_threshold_keeps_recall():
    """Findings that the network is unsure of lower the threshold; none is dropped beyond what RECALL leaves."""
    rng = np.random.default_rng(5)
    y = np.repeat([1.0, 0.0], 1000)
    logit = np.where(y > 0, 1.0, -1.0) + rng.standard_normal(2000)
    network = S.Network(rng)
    network.forward = lambda codes, mark: (codes[:, 0], None)
    network.calibrate(logit[:, None], logit[:, None], y)
    found = network.probability(logit[:, None], logit[:, None]) >= network.threshold
    assert found[y > 0].mean() >= S.RECALL


def test_every_long_run_is_a_candidate():
    text = "pw hunter2hunter abcdefghij 1234567890 p@ss!w%rd.9 short x=" + "a1" * 12 + "/QwErTyUiOp é"
    assert [text[s:e] for s, e in S.candidates(text, S.base_spans(text))] == ["hunter2hunter", "abcdefghij", "1234567890", "p@ss!w%rd.9", "/QwErTyUiOp"]
    rng = random.Random(4)
    for _ in range(200):
        text = "".join(rng.choice(["token", "=", " ", "abcdef0123" * 3, "AKIA", "X7", "'", "secret: ", "é", "-"]) for _ in range(30))
        base, left = S.base_spans(text), list(text)
        for _, s, e in base:
            left[s:e] = " " * (e - s)
        assert S.candidates(text, base) == [m.span() for m in re.finditer(r"\S{8,}", "".join(left))]


def test_quick_scores(network):
    text = "a pwd is x7!kQ2#z and " + "word/" * 6 + "abcdefghijk " + "0123456789abc" + " end"
    where = [(0, s, e) for s, e in S.candidates(text, [])]
    codes, mark = map(np.array, zip(*(S.encode(text, s, e) for _, s, e in where)))
    assert np.allclose(S._highest([text], where, network), network.probability(codes, mark), atol=1e-5)


def test_weak_secrets(network):
    """Secrets that were no candidates before, found by their context."""
    rng = np.random.default_rng(7)
    hit = [S.all_spans([f"of the and over pwd is {S._weak(rng)} and the"], network)[0][1] for _ in range(200)]
    assert sum(any(k == "cnn" for k, _, _ in x) for x in hit) >= 160


def test_secret_in_a_long_run(network):
    """Long runs are read whole: a secret in the middle counts as one alone, and windows leave no place out."""
    for end in range(49, 400):
        read = S.windows(0, end)
        assert read[0][0] == 0 and read[-1][1] == end and all(b - a == S.INSIDE for a, b in read) and all(c[0] - b[0] <= S.STEP for b, c in zip(read, read[1:]))
    rng = np.random.default_rng(8)
    path = "/the/over/and/thing/of/ertion/ing/over/thand/of/the/"
    hit, miss = 0, 0
    for _ in range(100):
        text = f"see {path}{S._made(rng, True)}{path} and"
        hit += any(k == "cnn" for k, _, _ in S.all_spans([text], network)[0][1])
        miss += any(k == "cnn" for k, _, _ in S.all_spans([f"see {path}{path[int(rng.integers(0, 20)):]} and"], network)[0][1])
        where = [(0, s, e) for s, e in S.candidates(text, [])]
        rows = [S.encode(text, s, e) for s, e in S.windows(*where[0][1:])]
        assert np.allclose(S._highest([text], where, network)[0], network.probability(*map(np.array, zip(*rows))).max(), atol=1e-5)
    assert hit >= 85 and miss <= 10


def test_scan(docs_of, edge):
    docs = edge.unionAll(docs_of([(100 + k, t) for k, t in enumerate(TEXTS)]))
    rows = S.secrets(docs).collect()
    assert len(rows) == docs.count()
    texts = {(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()}
    want = {}
    for i, t in texts:
        base = brute(t or "")
        want.setdefault(i, set()).add((*(sum(k == x for k, _, _ in base) for x in ("assign", "access", "hex")), hashlib.sha256(",".join(f"{k}:{s}:{e}" for k, s, e in base).encode()).hexdigest()))
    for r in rows:
        assert (r.n_assign, r.n_access, r.n_hex, r.base_sha256) in want[r.doc_id]
        base = [x for x in r.spans.split(",") if x and not x.startswith("cnn")]
        assert hashlib.sha256(",".join(base).encode()).hexdigest() == r.base_sha256
    assert S.secrets(docs_of([])).collect() == []
