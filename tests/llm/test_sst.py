import random
import zlib

import numpy as np
import pytest

from planeframe.llm import sst
from planeframe.workspace import new_path

tokenizers = pytest.importorskip("tokenizers")
public = pytest.importorskip("public_tokenizers")
PATH = public.path("word_bpe_49k.json")


def test_encoder_agrees_with_whole_texts():
    whole = tokenizers.Tokenizer.from_file(PATH)
    encode = sst.Encoder(PATH, keep=300)
    letters = list("abzABé É.,'ʼİıßſ́ \t\n\r\x1c\x85  日本ΣςΑ1٣²½😀_-ŉǅ") + ["<|endoftext|>", "'s", "don't", " "]
    rng = random.Random(3)
    for _ in range(3000):
        text = "".join(rng.choice(letters) for _ in range(rng.randrange(30)))
        want = [*whole.encode(text, add_special_tokens=False).ids, 2]
        assert np.frombuffer(encode(text), "<u2").tolist() == want, text


def test_many_texts_agree_with_whole_texts():
    whole = tokenizers.Tokenizer.from_file(PATH)
    encode = sst.Encoder(PATH, keep=300)
    latin = [*map(chr, range(256)), *"''''strevmdl  lllsss" * 8, "'s", "don't", " "]
    letters = [*latin, *"ʼİıßſ́ 日本ΣςΑ٣😀ŉǅ", "<|endoftext|>"]
    rng = random.Random(5)
    for k in range(60):
        texts = [None, "", "  ", *("".join(rng.choice(letters if k % 3 == 0 else latin) for _ in range(rng.randrange(40))) for _ in range(100))]
        got = [np.frombuffer(x, "<u2").tolist() for x in encode.many(texts)]
        assert got == [[*whole.encode(t or "", add_special_tokens=False).ids, 2] for t in texts]


def test_many_texts_are_cut_by_arrays(monkeypatch):
    """A text costs array steps and each new unit once; only texts beyond Latin-1, with added tokens or very long go alone."""
    encode, alone, units = sst.Encoder(PATH), [], []
    monkeypatch.setattr(sst, "CHUNK_BYTES", 4000)
    monkeypatch.setattr(sst.Encoder, "__call__", lambda self, text: alone.append(text) or b"")
    monkeypatch.setattr(sst.Encoder, "_unit", lambda self, unit, real=sst.Encoder._unit: (units.append(unit), real(self, unit))[1])
    odd = ["日本", "a <|endoftext|> b", "x" * 4001]
    texts = ["Überall water, water,*** it's 10 %"] * 1000 + odd
    encode.units.clear()
    got = encode.many(texts)
    assert encode.by_units and alone == odd and len(set(got[:1000])) == 1 and got[0]
    assert sorted(units) == sorted({x.encode("latin-1") for x in ("überall", "water", ",", ",***", "it", "'s", "1", "0", "%")})


def test_keys_keep_order():
    ids = [None, -(2**63), -5, -1, 0, 1, 2**40, 2**63 - 1]
    keys = [sst.key_of(i) for i in ids]
    assert keys == sorted(keys) and [sst.id_of(k) for k in keys] == ids


def test_round_trip_and_lookup(spark, edge, docs_of, monkeypatch):
    monkeypatch.setattr(sst, "BLOCK_BYTES", 300)
    more = docs_of([(k, f"document number {k} " * (k % 7 + 1)) for k in range(100, 900)])
    docs = edge.unionAll(more)
    folder = new_path(spark, "t")
    manifest = sst.write_tables(docs, folder, PATH, file_bytes=4000)
    assert manifest.agg({"docs": "sum"}).first()[0] == docs.count()
    got = sorted(((r.doc_id is not None, r.doc_id, r.start), r.n_tokens, r.ids_crc32) for r in sst.read_tables(manifest).collect())
    whole = tokenizers.Tokenizer.from_file(PATH)
    want = {}
    for r in docs.select("doc_id", "text").collect():
        ids = [*whole.encode(r.text or "", add_special_tokens=False).ids, 2]
        want.setdefault(r.doc_id, []).append((len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
    start, found = 0, {}
    for (_, doc_id, at), n, crc in got:
        assert at == start
        start += n
        found.setdefault(doc_id, []).append((n, crc))
    assert {k: sorted(v) for k, v in found.items()} == {k: sorted(v) for k, v in want.items()}
    assert [len(x) for x in sst.lookup(folder, 5)] == [want[5][0][0]] * 2
    assert sst.lookup(folder, 123456) == [] and len(sst.lookup(folder, None)) == 1


def test_point_reads_touch_few_blocks(tmp_path):
    with open(tmp_path / "t.sst", "wb") as f:
        w = sst.TableWriter(2, f)
        rng = np.random.default_rng(1)
        for k in range(2000):
            w.add(sst.key_of(k * 3), rng.integers(0, 1 << 16, 200).astype("<u2").tobytes())
        w.finish()
    r = sst.TableReader(f"file://{tmp_path}/t.sst")
    assert len(r.index) > 8
    assert len(r.get(300)) == 1 and r.blocks_read == 1
    assert sum(bool(r.get(k * 3 + 1)) for k in range(2000)) == 0 and r.blocks_read < 60
    raw = bytearray((tmp_path / "t.sst").read_bytes())
    raw[r.footer["index"][0]] ^= 1
    (tmp_path / "bad.sst").write_bytes(raw)
    with pytest.raises(ValueError):
        sst.TableReader(f"file://{tmp_path}/bad.sst")


def test_empty(docs_of):
    assert sst.token_tables(docs_of([])).collect() == []
