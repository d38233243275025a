import random
import zlib

import numpy as np

from planeframe.llm import toxicity as T


def word(rng):
    return "".join(rng.choice(["an", "er", "th", "tion", "re", "ou", "st", "in", "ha", "ea"]) for _ in range(rng.randint(1, 4)))


def corpus(n, seed):
    rng = random.Random(seed)
    rows = []
    for k in range(n):
        words = [word(rng) for _ in range(rng.randint(20, 60))]
        bad = k % 4 == 0
        if bad:
            for _ in range(3):
                words[rng.randrange(len(words))] = rng.choice(["idiot", "scumbag", "clown", "worthless"])
        rows.append((k, " ".join(words) + ".", int(bad)))
    return rows


def string(w):
    """The code row of a word, ends included, by definition: letters, and 0 for what is none."""
    codes = [T._code(ord(x)) for x in w.lower()]
    return np.array([T.START, *codes, T.STOP])


def slow_features(row):
    out, codes = {}, row.tolist()
    for i in range(len(codes)):
        for j in range(i + 1, len(codes)):
            for k in range(j + 1, len(codes)):
                if k - i < T.SPAN and codes[i] and codes[j] and codes[k]:
                    key = (codes[i] * T.LETTERS + codes[j]) * T.LETTERS + codes[k]
                    out[key] = out.get(key, 0) + T.LAMBDA ** (k - i + 1 - 3)
    return out


def slow_kernel(a, b):
    x, y = slow_features(a), slow_features(b)
    norm = lambda f: np.sqrt(sum(v * v for v in f.values()))
    return sum(v * y.get(k, 0) for k, v in x.items()) / (norm(x) * norm(y))


WORDS = ["idiot", "id1ot", "i-d-i-o-t", "idiots", "banana", "thread", "aaaaaa", "дурак", "дурка", "馬鹿", "é"]


def test_kernel_against_definition():
    rows = [string(w) for w in WORDS]
    got = T.Strings(rows).kernel(T.Landmarks(rows))
    for i, a in enumerate(rows):
        for j, b in enumerate(rows):
            assert abs(got[i, j] - slow_kernel(a, b)) < 1e-4
    assert slow_kernel(string("idiot"), string("id*iot")) > 0.5 > slow_kernel(string("idiot"), string("banana"))
    assert slow_kernel(string("дурак"), string("мирно")) < 0.2 and (string("idiot") == string("ïdiöt")).all()


def test_machine_against_its_problem():
    """With all strings as landmarks the machine is the kernel machine itself: its folded weights give the values of the dual form, and it solves the squared-hinge problem."""
    rng = random.Random(4)
    good, bad = list({word(rng) for _ in range(40)}), ["idiot", "idiots", "id*iot", "moron", "mor.on", "clown", "clowns"]
    rows = [string(w) for w in bad + good]
    weights, bias = T.machine(rows[: len(bad)], rows[len(bad) :], rows)
    gram = np.array([[slow_kernel(a, b) for b in rows] for a in rows])
    values = T.Strings(rows).dot(weights)
    alpha = np.linalg.lstsq(gram, values, rcond=1e-6)[0]
    assert np.allclose(gram @ alpha, values, atol=1e-3)
    y, c = np.r_[np.ones(len(bad)), -np.ones(len(good))], np.r_[np.full(len(bad), 1 / len(bad)), np.full(len(good), 6 / len(good))]

    def loss(v, b, norm2):
        return (c * np.maximum(0, 1 - y * (v + b)) ** 2).sum() + 1e-4 * (norm2 + b * b)

    best = loss(values, bias, alpha @ gram @ alpha)
    noise = np.random.default_rng(0)
    for scale in (1e-2, 1e-1, 1):
        for _ in range(30):
            other = alpha + noise.standard_normal(len(rows)) * scale
            assert loss(gram @ other, bias + noise.standard_normal() * scale, other @ gram @ other) >= best - 1e-5


def test_sentences_against_brute_force():
    """Bounds are bounds, and the two highest sentence values are those of all windows one by one."""
    noise = np.random.default_rng(7)
    weights, bias = noise.standard_normal(T.LETTERS**3), -0.3
    rng = random.Random(3)
    texts = ["", None, "x", "...", "a" * 60 + " b", *("".join(rng.choice(["idiot", "id iot", "re,st", "x", "scum-bag. ", "ea1ou", "end!\nnew", "日本語", "é", " ", "    ", "      "]) for _ in range(rng.randint(1, 14))) for _ in range(80))]

    def windows(text):
        """[(sentence, string)] by definition."""
        runs = [(m.start(), m.end()) for m in T._WORD.finditer((text or "").lower())]
        low, out, sentence = (text or "").lower(), [], 0
        ends = lambda x, at: any(ch in "\n!?" or ch == "." and (at + k + 1 >= len(low) or low[at + k + 1] in " \t") for k, ch in enumerate(x))
        number = [0]
        for (_, e), (s, _) in zip(runs, runs[1:]):
            sentence += ends(low[e:s], e)
            number.append(sentence)
        for i, (s, e) in enumerate(runs):
            if e - s > T.PLACES:
                for n, step in T.PIECES:
                    out += [(number[i], string(low[s + k : min(s + k + n, e)])) for k in range(0, max(1, e - s - n + step), step)]
            for j in range(i, len(runs)):
                if number[j] != number[i] or any(runs[k + 1][0] - runs[k][1] > T.GAP for k in range(i, j)):
                    break
                joined = " ".join(low[a:b] for a, b in runs[i : j + 1])
                if len(joined) <= T.PLACES and sum(b - a for a, b in runs[i : j + 1]) >= 2:
                    out.append((number[i], string(joined)))
        return out

    lines = T.Sentences(texts)
    bounds, exact = lines.bounds(weights, bias), lines.exact(np.arange(len(lines.left)), weights, bias)
    once = np.array([len(slow_features(r)) == (T.features(r[None])[1] > 0).sum() for r in lines.strings(np.arange(len(lines.left)))])
    assert (bounds >= exact).all() and once.sum() > 100 and np.allclose(bounds[once], np.maximum(exact[once], bias), atol=1e-3)
    want = []
    for text in texts:
        best = {}
        for number, row in windows(text):
            x = slow_features(row)
            value = sum(v * weights[k] for k, v in x.items()) / np.sqrt(sum(v * v for v in x.values())) + bias
            best[number] = max(best.get(number, T.NONE), value)
        want.append((sorted(best.values(), reverse=True) + [T.NONE] * 2)[:2])
    assert np.allclose(T.points_of(texts, weights, bias), want, atol=1e-3)


def test_very_long_texts_are_read_in_parts(monkeypatch):
    weights = np.random.default_rng(1).standard_normal(T.LETTERS**3)
    rng = random.Random(5)
    lined = "".join(word(rng) + rng.choice([" ", " ", " ", ".\n"]) for _ in range(3000))
    plain = lined.replace(".\n", " ")
    whole = T.points_of([lined, plain], weights, 0.0)
    monkeypatch.setattr(T, "PART", 2000)
    assert "".join(T.parts(lined)) == lined and max(map(len, T.parts(plain))) <= 2000 + T.OVERLAP
    got = T.points_of([lined, plain, None], weights, 0.0)
    assert np.allclose(got[0], whole[0]) and np.isclose(got[1, 0], whole[1, 0]) and got[2, 0] == T.NONE


def test_held_out_accuracy_and_spelling(spark, docs_of):
    rows = corpus(600, 1)
    rows += [(1000, "he is an i d i o t really", 1), (1001, "such an id.iot here", 1), (1002, "than er th ou st", 0)]
    docs = docs_of([(i, t) for i, t, _ in rows])
    labels = spark.createDataFrame([(i, 1, y) for i, _, y in rows if i < 1000] + [(3, 1, None), (None, 0, 1)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in T.scores(docs, labels).collect()}
    assert len(got) == len(rows)
    for i, _, _ in rows:
        assert got[i].held_out == (zlib.crc32(str(i).encode()) % 3 == 1)
        assert 0 <= got[i].score <= 1 and got[i].predicted == int(got[i].score >= 0.7)
    out = [(y, got[i].predicted) for i, _, y in rows if got[i].held_out and i < 1000]
    assert sum(p for y, p in out if y) / sum(y for y, _ in out) >= 0.9
    assert sum(p for y, p in out if not y) <= 0.03 * sum(not y for y, _ in out)
    assert got[1000].predicted and got[1001].predicted and not got[1002].predicted
    kept = T.without_toxic(docs, labels)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {i for i in got if not got[i].predicted}
    turned = labels.where("crc32(cast(doc_id as string)) % 3 = 1").selectExpr("doc_id", "quality", "1 - toxic as toxic").unionAll(labels.where("crc32(cast(doc_id as string)) % 3 <> 1"))
    assert {r.doc_id: r.score for r in T.scores(docs, turned).collect()} == {i: r.score for i, r in got.items()}


def test_inserted_and_parted_insults():
    """Parts of a word with blanks between, and words glued by signs, are predicted."""
    model = T.train([(y, t) for _, t, y in corpus(600, 1)])
    scorer = T.Scorer(model)
    clean = "than er th ou st in ha reer ea tion an "
    for w in ("id iot", "scum bag", "i d i o t", "worth less", "you,idiot,go", "a/idiot/b", "thanstouin,scumbag,hareerea", "(id)iot", "íd*iot", "wor.thl.ess"):
        assert scorer([clean + w + " anth re"])[0] >= T.CUT, w
    assert scorer([clean + "anth re", None, ""]).max() < T.CUT


def test_other_scripts():
    """Insults in Cyrillic and in two-sign words are told from other words of the same script."""
    rng = random.Random(8)
    plain = {"ru": ["мирно", "карта", "снег", "вода", "город", "трава", "рука", "окно"], "zh": ["天気", "今日", "散歩", "公園", "青空", "花火"]}
    rows = []
    for k in range(400):
        lang = ("ru", "zh")[k % 2]
        words = [rng.choice(plain[lang]) + rng.choice(["", "а", "и"] if lang == "ru" else [""]) for _ in range(20)]
        if k % 8 < 2:
            words[rng.randrange(20)] = {"ru": "дурак", "zh": "馬鹿"}[lang]
        rows.append((int(k % 8 < 2), " ".join(words)))
    scorer = T.Scorer(T.train(rows))
    assert scorer(["мирно вода дурак снег", "今日 馬鹿 公園"]).min() >= T.CUT > scorer(["мирно вода карта снег", "今日 青空 公園"]).max()


def test_training_sample_is_bounded(spark, docs_of):
    rows = corpus(300, 3)
    docs = docs_of([(i, t) for i, t, _ in rows] + [(0, "idiot " * 5000)] + [(4, f"again {k}") for k in range(50)])
    labels = spark.createDataFrame([(i, 1, y) for i, _, y in rows], "doc_id long, quality int, toxic int")
    got = T.labelled(docs, labels, T.Training(per_class=10, longest=20_000))
    assert sum(y for y, _ in got) == 10 and len(got) == 20 and max(len(t) for _, t in got) <= 20_000


def test_edge(spark, docs_of, edge):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r.score for r in T.scores(edge, none).collect()} == {0.0}
    rows = corpus(200, 2)
    labels = spark.createDataFrame([(i, 1, y) for i, _, y in rows], "doc_id long, quality int, toxic int")
    got = T.scores(docs_of([(i, t) for i, t, _ in rows]).unionAll(edge), labels).collect()
    assert len(got) == 200 + edge.count() and all(0 <= r.score <= 1 for r in got)
    assert T.scores(docs_of([]), labels).collect() == []
