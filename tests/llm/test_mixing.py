import math
import re
from collections import Counter

import xxhash
from pyspark.sql import functions as F

from planeframe.llm import mixing

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def targets(sizes):
    """Water-filling step by step."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    out, rest, open_ = {}, 1.5 * sum(sizes.values()), set(order)
    while open_:
        total = sum(weight[s] for s in open_)
        full = {s for s in open_ if rest * weight[s] / total > 2 * sizes[s] + 1e-9}
        if not full:
            out |= {s: rest * weight[s] / total for s in open_}
            break
        out |= {s: 2.0 * sizes[s] for s in full}
        rest -= sum(2 * sizes[s] for s in full)
        open_ -= full
    return out


ROWS = [(k, " ".join(f"w{k}x{j}" for j in range(k * 7 % 60)), ["b", "a", "é", None, "tiny"][0 if k % 3 else k % 5]) for k in range(300)]
ROWS += [(900, None, "a"), (901, "", "empty"), (902, "one", "zz"), (5, ROWS[5][1], ROWS[5][2]), (5, "other text", ROWS[5][2]), (None, "a b c", "b")]


def test_contract(docs_of):
    docs = docs_of(ROWS)
    got = mixing.taken_words(docs).collect()
    assert len(got) == len(ROWS)
    size = lambda t: len(WORD.findall(t or ""))
    assert Counter((r.doc_id, r.size) for r in got) == Counter((i, size(t)) for i, t, _ in ROWS)
    sizes = Counter()
    for _, t, s in ROWS:
        sizes[s] += size(t)
    want = targets(sizes)
    by_size = {}
    for r in got:
        assert 0 <= r.taken <= 2 * r.size
        by_size.setdefault((r.source_size, round(r.target, 6)), []).append(r.taken)
    for s, n in sizes.items():
        key = next(k for k in by_size if k[0] == n and abs(k[1] - want[s]) < 1e-3)
        total = sum(sum(v) for k, v in by_size.items() if k == key)
        count = sum(1 for x in sizes if sizes[x] == n and abs(want[x] - want[s]) < 1e-3)
        assert abs(total - count * want[s]) <= count
    again = mixing.taken_words(docs).collect()
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, again), key=str)


def test_slots_and_blocks(docs_of, spark):
    docs = docs_of(ROWS)
    parts, placed, sources = mixing.mix(docs, block=16, shard_blocks=40)
    slots = mixing.slots(sources, 16, 40)
    n = {r.skey: r for r in sources.collect()}
    for key, rows in ((k, slots.where(F.col("skey") == k).collect()) for k in n):
        blocks = [(r["pass"], r.block) for r in rows]
        assert len(set(blocks)) == len(blocks)  # a permutation in every pass
        assert abs(sum(r.words for r in rows) - n[key].target) <= 0.5
    lines = {(r.skey, r.at): r.size for r in placed.where("size > 0").collect()}
    for key in n:
        at = 0
        for (k, o), size in sorted(lines.items()):
            if k == key:
                assert o == at
                at += size
        assert at == n[key].source_size
    assert parts.selectExpr("sum(to_word - from_word)").first()[0] == slots.selectExpr("sum(words)").first()[0]
    per_shard = [r["count"] for r in slots.groupBy("shard").count().orderBy("shard").collect()]
    assert len(per_shard) > 4 and set(per_shard[:-1]) == {40} and per_shard[-1] <= 40


def hashed(*values):
    """Spark's xxhash64 of longs, ints (given as (int,)) and strings; None is skipped."""
    h = 42
    for v in values:
        if v is not None:
            raw = v.encode() if isinstance(v, str) else v[0].to_bytes(4, "little", signed=True) if isinstance(v, tuple) else v.to_bytes(8, "little", signed=True)
            h = xxhash.xxh64_intdigest(raw, h)
    return h - (1 << 64) if h >> 63 else h


def permuted(value, size, *key):
    b = max(1, math.ceil(math.sqrt(size)))
    a = max(1, -(-size // b))
    while True:
        x, y = divmod(value, b)
        for r in range(6):
            if r % 2 == 0:
                x = (x + hashed(*key, (r,), y) % a) % a
            else:
                y = (y + hashed(*key, (r,), x) % b) % b
        value = x * b + y
        if value < size:
            return value


def brute_force(rows, block, shard_blocks, seed=mixing.SEED):
    """{(doc_id, size, taken, first shard, shards): rows} from the texts alone."""
    lines = {}
    for i, t, s in rows:
        n = len(WORD.findall(t or ""))
        lines.setdefault("n" if s is None else "v" + s, []).append((hashed((seed,), i, n) % 64, i is not None, i or 0, n, i))
    want = targets({None if k == "n" else k[1:]: sum(x[3] for x in v) for k, v in lines.items()})
    slots, total = [], 0
    for key in sorted(lines):
        words = sum(x[3] for x in lines[key])
        take = math.floor(want[None if key == "n" else key[1:]] + 0.5)
        if not words or not take:
            continue
        full, tail = divmod(words, block)
        each = full + (tail > 0)
        count = take // words * each + -(-(take % words) // block)
        taken = 0
        for k in range(count):
            turn, place = divmod(k, each)
            got = min(tail if place == full else block, take - taken) if k < count - 1 else take - taken
            slots.append([key, k, full if place == full else permuted(place, full, seed, key, turn), got, total + k])
            taken += got
        total += count
    drawn = Counter((permuted(g, total, seed) // shard_blocks, key) for key, _, _, _, g in slots)
    out, start = Counter(), {}
    shard_of = {key: [j for j in sorted({j for j, _ in drawn}) for _ in range(drawn[j, key])] for key in lines}
    for key, docs in lines.items():
        mine = [x for x in slots if x[0] == key]
        at = 0
        for _, _, _, n, i in sorted(docs):
            got, shards = 0, set()
            for _, k, b, words, _ in mine:
                shared = min(at + n, b * block + words) - max(at, b * block)
                if shared > 0:
                    got += shared
                    shards.add(shard_of[key][k])
            out[i, n, got, min(shards, default=None), len(shards)] += 1
            at += n
    return out


def test_against_brute_force(docs_of, monkeypatch):
    """Every row, from texts to words taken and shards. Without the draw, slots would fill the shards source by source."""
    rows = [(k, " ".join(["w"] * (k * 13 % 47)), ["b", "a", "é", None, "tiny"][0 if k % 3 else k % 5]) for k in range(120)]
    whole = mixing.mix
    monkeypatch.setattr(mixing, "mix", lambda docs: whole(docs, 8, 16))
    got = mixing.taken_words(docs_of(rows)).collect()
    want = brute_force(rows, 8, 16)
    assert Counter((r.doc_id, r.size, r.taken, r.first_shard, r.n_shards) for r in got) == want
    parts, _, _ = whole(docs_of(rows), 8, 16)
    sources = [r["count(DISTINCT skey)"] for r in parts.groupBy("shard").agg(F.countDistinct("skey")).collect()]
    assert sum(n > 1 for n in sources) > len(sources) * 0.8


def test_permutations(spark):
    """Every size gives a permutation, none of which is a rotation or a reflection; keys give different ones."""
    rows = spark.createDataFrame([(n, k, i) for n in [*range(1, 40), 97, 577, 1050, 4096] for k in (0, 1) for i in range(n)], "m long, k long, i long")
    got = {}
    for r in rows.withColumn("p", F.expr(mixing.permuted("i", "m", "17L", "'vx'", "k"))).orderBy("m", "k", "i").collect():
        got.setdefault((r.m, r.k), []).append(r.p)
        if r.i < 50:
            assert r.p == permuted(r.i, r.m, 17, "vx", r.k)
    for (n, k), p in got.items():
        assert sorted(p) == list(range(n))
        if n > 20:
            assert max(Counter((b - a) % n for a, b in zip(p, p[1:])).values()) < max(6, 0.1 * n)
            assert p != got[n, 1 - k]


def test_mixed_documents(docs_of):
    docs = docs_of(ROWS)
    out = mixing.mixed_documents(docs)
    assert out.columns == docs.columns
    words = sum(len(WORD.findall(r.text)) for r in out.collect())
    assert words == sum(r.taken for r in mixing.taken_words(docs).collect())
    known = {}
    for i, t, _ in ROWS:
        known.setdefault(i, set()).update(WORD.findall(t or ""))
    assert all(set(WORD.findall(r.text)) <= known[r.doc_id] for r in out.collect())


def test_no_python_in_the_plan(docs_of):
    plan = mixing.taken_words(docs_of(ROWS[:20]))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_empty_and_edge(docs_of, edge):
    assert mixing.taken_words(docs_of([])).collect() == []
    assert mixing.taken_words(edge).count() == edge.count()
    assert {r.taken for r in mixing.taken_words(docs_of([(1, None), (2, "")])).collect()} == {0}
