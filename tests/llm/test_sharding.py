import heapq
import random
import zlib
from collections import Counter

from planeframe.llm.sharding import lpt_plan, shard


def test_plan_is_the_heap():
    rng = random.Random(1)
    for _ in range(200):
        sizes = {rng.randint(1, 60): rng.randint(1, 30) for _ in range(rng.randint(1, 12))}
        shards = rng.randint(1, 9)
        plan = lpt_plan([(s, n, s * n) for s, n in sizes.items()], shards)
        loads = Counter()
        covered = Counter()
        for kind, lo, hi, turn in plan:
            for k in range(lo, hi):
                loads[turn[(k - lo) % len(turn)]] += kind
            covered[kind] += hi - lo
        assert covered == sizes
        heap = [(0, i) for i in range(shards)]
        for s in sorted((s for s, n in sizes.items() for _ in range(n)), reverse=True):
            load, i = heapq.heappop(heap)
            heapq.heappush(heap, (load + s, i))
        assert sorted(loads.get(i, 0) for i in range(shards)) == sorted(x for x, _ in heap)


def rows_of(docs, shards=8):
    return shard(docs, shards).collect()


def test_contract(docs_of, edge):
    rng = random.Random(2)
    texts = ["t" * rng.randint(0, 9000) + str(rng.randint(0, 300)) for _ in range(600)]
    docs = docs_of([(k + 100, t) for k, t in enumerate(texts)] + [(k + 5000, "copy") for k in range(50)]).unionAll(edge)
    rows = rows_of(docs)
    want = Counter((r.doc_id, len((r.text or "").encode()) + 1, zlib.crc32((r.text or "").encode())) for r in docs.select("doc_id", "text").collect())
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in rows) == want
    loads = Counter()
    for r in rows:
        loads[r.shard] += r["size"]
        assert r.law == "bytes" and r.grown_shard is None
    largest = 150_001  # the very long text
    assert max(loads.values()) - min(loads.values()) <= largest
    for k in range(8):
        assert sorted(r.slot for r in rows if r.shard == k) == list(range(sum(r.shard == k for r in rows)))
    assert len({r.shard for r in rows if r.doc_id and 5000 <= r.doc_id < 5050}) == 1
    again = rows_of(docs)
    assert Counter(map(tuple, rows)) == Counter(map(tuple, again))


def test_balance(docs_of):
    rng = random.Random(5)
    rows = rows_of(docs_of([(k, "x" * rng.randint(1, 20_000) + str(k)) for k in range(800)]))
    loads = Counter()
    for r in rows:
        loads[r.shard] += r["size"]
    assert max(loads.values()) - min(loads.values()) < 0.01 * max(loads.values())


def test_empty(docs_of):
    assert rows_of(docs_of([])) == []


def test_whole_query_against_the_heap(docs_of):
    """Group by text, sort by size, pop the heap: the loads are the exact plan's, and those of the classes within their width."""
    rng = random.Random(9)
    texts = [str(rng.randint(0, 120)) * rng.randint(1, 4000) for _ in range(500)] + ["hot"] * 300 + [None] * 7
    docs = docs_of(list(enumerate(texts)))
    groups = Counter()
    for t in texts:
        groups[t] += len((t or "").encode()) + 1
    heap = [(0, i) for i in range(8)]
    for size in sorted(groups.values(), reverse=True):
        load, i = heapq.heappop(heap)
        heapq.heappush(heap, (load + size, i))
    want = sorted(x for x, _ in heap)
    for places in (None, 12):
        loads, homes = Counter(), {}
        for r in shard(docs, places=places).collect():
            loads[r.shard] += r["size"]
            homes.setdefault(texts[r.doc_id], set()).add(r.shard)
        assert all(len(x) == 1 for x in homes.values())
        got = sorted(loads.values())
        if places is None:
            assert got == want
        else:
            assert all(abs(a - b) <= 0.001 * b for a, b in zip(got, want))
