import json
import random

import pytest

from planeframe.llm.wordpiece import END, LongestMatch, token_counts


def greedy(word, pieces):
    word += END
    i = n = 0
    while i < len(word):
        j = next((j for j in range(len(word), i, -1) if word[i:j] in pieces), None)
        if j is None:
            return 1
        i, n = j, n + 1
    return n


def test_against_greedy():
    rng = random.Random(5)
    for _ in range(300):
        letters = "abc"[: rng.randint(1, 3)]
        make = lambda n: "".join(rng.choice(letters) for _ in range(rng.randint(1, n)))
        pieces = {make(4) for _ in range(rng.randint(1, 8))} | {make(3) + END for _ in range(rng.randint(0, 4))} | (set(letters) if rng.random() < 0.7 else set()) | ({END} if rng.random() < 0.5 else set())
        machine = LongestMatch(pieces)
        for _ in range(30):
            w = make(12)
            assert machine.count(w) == greedy(w, pieces), (w, pieces)


def test_whole_query_against_greedy(spark, sf):
    """Counts of whole documents, each word greedily from the tokenizer's own vocabulary."""
    public, tokenizers = pytest.importorskip("public_tokenizers"), pytest.importorskip("tokenizers")
    path = public.path("word_bpe_49k.json")
    with open(path, encoding="utf-8") as f:
        pieces = {p.removesuffix("</w>") + END if p.endswith("</w>") else p for p in json.load(f)["model"]["vocab"]}
    whole, memo = tokenizers.Tokenizer.from_file(path), {}
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = {r.doc_id: (r.n_words, r.n_tokens) for r in token_counts(docs).collect()}
    rows = docs.select("doc_id", "text").collect()
    assert len(rows) == len(got)
    for r in rows:
        words = [w for w, _ in whole.pre_tokenizer.pre_tokenize_str(whole.normalizer.normalize_str(r.text or ""))]
        for w in words:
            if w not in memo:
                memo[w] = greedy(w, pieces)
        assert got[r.doc_id] == (len(words), sum(memo[w] for w in words))


def test_edge(spark, docs_of, edge):
    pytest.importorskip("public_tokenizers")
    got = sorted((tuple(r) for r in token_counts(edge).collect()), key=str)
    assert len(got) == edge.count()
    by = {i: (w, t) for i, w, t in got}
    assert by[1] == by[2] == by[3] == (0, 0) and by[4] == (30_000, 30_000) and by[5] == (3, 3)
    assert token_counts(docs_of([])).collect() == []
