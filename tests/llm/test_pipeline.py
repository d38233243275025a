import importlib.util
import os
import sys
import zlib
from collections import Counter

import numpy as np
import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))
if importlib.util.find_spec("corpus_pipeline") is None:
    pytest.skip("the pipeline is not here", allow_module_level=True)

import corpus_pipeline  # noqa: E402
from planeframe.llm import toxicity  # noqa: E402
from planeframe.llm.common import new_path  # noqa: E402

from . import test_decontaminate, test_mixing, test_neardup  # noqa: E402

WORD = test_mixing.WORD


def cut(spark, sf, folder):
    """Documents, labels and benchmark small enough for brute force, with copies of documents and benchmark passages in some."""
    docs = [r.asDict() for r in spark.read.parquet(f"{sf}/documents.parquet").where("n_chars < 3000").orderBy("doc_id").limit(90).collect()]
    items = spark.read.parquet(f"{sf}/benchmark.parquet").orderBy("item_id").limit(6)
    passages = [r.text for r in items.collect()]
    for k in range(8):
        docs.append(docs[k] | {"doc_id": 10**6 + k, "text": (docs[k]["text"] or "") + (" end" if k % 2 else "")})
        docs.append(docs[20 + k] | {"doc_id": 10**7 + k, "text": f"{docs[20 + k]['text']} {passages[k % 6]} {docs[21 + k]['text']}"})
    spark.createDataFrame(docs, spark.read.parquet(f"{sf}/documents.parquet").schema).write.parquet(f"{folder}/documents.parquet")
    items.write.parquet(f"{folder}/benchmark.parquet")
    spark.read.parquet(f"{sf}/labels.parquet").write.parquet(f"{folder}/labels.parquet")
    return [(r.item_id, r.text) for r in items.collect()]


def test_stages_against_brute_force(spark, sf):
    """Near copies by all pairs of sets, benchmark passages by all windows, the mix by targets and by words, token tables by whole-text encoding."""
    tokenizers, public = pytest.importorskip("tokenizers"), pytest.importorskip("public_tokenizers")
    folder = new_path(spark, "cut")
    items = cut(spark, sf, folder)
    stage, docs = dict(corpus_pipeline.STAGES), spark.read.parquet(f"{folder}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    kept = stage["near_dedup"](spark, docs, folder)
    want = {i for i, _, low, _ in test_neardup.brute(rows) if i == low}
    assert sorted(r.doc_id for r in kept.collect()) == sorted(want) and len(want) < len(rows)
    clean = stage["decontamination"](spark, docs, folder)
    hit = {i for i, t in rows if test_decontaminate.brute(t, items)[-1]}
    assert sorted(r.doc_id for r in clean.collect()) == sorted({i for i, _ in rows} - hit) and hit
    mixed = [(r.doc_id, r.text, r.source) for r in stage["mix"](spark, docs, folder).collect()]
    size = lambda t: len(WORD.findall(t or ""))
    texts, sizes, taken, given = {r.doc_id: r.text for r in docs.collect()}, {}, {}, {}
    for r in docs.collect():
        sizes[r.source] = sizes.get(r.source, 0) + size(r.text)
    for i, t, s in mixed:
        taken[s] = taken.get(s, 0) + size(t)
        given.setdefault(i, []).extend(WORD.findall(t))
    for s, target in test_mixing.targets(sizes).items():
        assert abs(taken.get(s, 0) - target) <= 1
    for i, ws in given.items():  # no word more than twice as often as the document has it
        own = Counter(WORD.findall(texts[i]))
        assert all(n <= 2 * own[w] for w, n in Counter(ws).items())
    whole, start = tokenizers.Tokenizer.from_file(public.path("word_bpe_49k.json")), 0
    got = sorted(tuple(r)[:4] for r in stage["token_tables"](spark, docs, folder).collect())
    for i, t in sorted(rows):
        ids = [*whole.encode(t or "", add_special_tokens=False).ids, 2]
        assert got.pop(0) == (i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


def test_toxic_documents_go(spark, sf):
    """The first stage leaves what the scorer, run outside Spark on the same model, leaves."""
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    scorer = toxicity.Scorer(toxicity.train(toxicity.labelled(docs, labels)))
    rows = docs.select("doc_id", "text").collect()
    want = {r.doc_id for r, x in zip(rows, scorer([r.text for r in rows])) if x < toxicity.CUT}
    assert {r.doc_id for r in dict(corpus_pipeline.STAGES)["toxicity"](spark, docs, sf).collect()} == want


def test_stages(spark, sf):
    """The stages one after the other keep the columns, and each has only documents of the one before."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_dedup", "decontamination", "mix", "token_tables"]
    for name, stage in corpus_pipeline.STAGES:
        path = new_path(spark, "t")
        stage(spark, docs, sf).write.parquet(path)
        out = spark.read.parquet(path)
        assert {r.doc_id for r in out.select("doc_id").collect()} <= {r.doc_id for r in docs.select("doc_id").collect()}
        if name != "token_tables":
            assert out.columns == docs.columns
        docs, before = out, docs
    assert docs.count() == before.count()


def test_edge_documents(spark, sf, edge):
    """Nulls, empty and very long texts, repeated rows and clashing columns go through every stage."""
    docs = edge
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf)
        if name != "token_tables":
            assert out.columns == edge.columns
        path = new_path(spark, "t")
        out.write.parquet(path)
        docs = spark.read.parquet(path)
    assert docs.count() > 0


def test_empty_documents(spark, sf, docs_of):
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs_of([]), sf).count() == 0
