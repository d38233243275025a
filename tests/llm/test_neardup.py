import random
import re

from planeframe.llm import neardup

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(t):
    ws = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    return {" ".join(ws[i : i + 5]) for i in range(len(ws) - 4)} if len(ws) >= 5 else {" ".join(ws)} if ws else set()


def brute(rows):
    sets = [shingles(t) for _, t in rows]
    near = {}
    for a in range(len(rows)):
        for b in range(a):
            x, y = sets[a], sets[b]
            if x and y and None not in (rows[a][0], rows[b][0]) and 100 * len(x & y) >= 75 * len(x | y):
                near.setdefault(rows[a][0], set()).add(rows[b][0])
                near.setdefault(rows[b][0], set()).add(rows[a][0])
    out = []
    for k, (i, _) in enumerate(rows):
        seen, todo = {i}, [i]
        while todo:
            for n in near.get(todo.pop(), ()):
                if n not in seen:
                    seen.add(n)
                    todo.append(n)
        low = None if i is None else min(seen)
        out.append((i, len(sets[k]), low, i is None or i == low))
    return sorted(out, key=str)


def family(rng, words, n):
    """A text and copies of it with a few words changed."""
    base = [rng.choice(words) for _ in range(rng.randint(5, 120))]
    out = [" ".join(base)]
    for _ in range(n):
        copy = list(base)
        for _ in range(rng.randint(0, 1 + len(base) // 25)):
            copy[rng.randrange(len(copy))] = rng.choice(words)
        out.append("  ".join(copy).upper())
    return out


def rows_of(seed, families, size):
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(400)]
    texts = [t for _ in range(families) for t in family(rng, words, rng.randint(0, size))]
    shared = " ".join(rng.choice(words) for _ in range(60))
    texts += [shared + " " + " ".join(rng.choice(words) for _ in range(rng.randint(5, 60))) for _ in range(40)]
    rng.shuffle(texts)
    return list(enumerate(texts))


EDGE = [(1000, None), (1001, ""), (1002, " \n"), (1003, "one two"), (1004, "ONE\ttwo"), (1005, "long " * 20_000), (1006, "long " * 30_000), (None, "one two"), (1007, "é É"), (3, "one two"), (1003, "one two")]


def got(docs):
    return sorted((tuple(r) for r in neardup.near_duplicates(docs).collect()), key=str)


def test_against_brute_force(docs_of):
    for seed in (1, 2):
        rows = rows_of(seed, 25, 5) + EDGE
        assert got(docs_of(rows)) == brute(rows)


def test_crowded_regions(docs_of, monkeypatch):
    """Small limits send regions through sorted neighbours and tiles, of one tile and of many."""
    monkeypatch.setattr(neardup, "SMALL", 3)
    rows = rows_of(3, 4, 40)
    for tile in (8, 1000):
        monkeypatch.setattr(neardup, "TILE", tile)
        assert got(docs_of(rows)) == brute(rows)
    repeated = rows + [rows[0], rows[1]] * 20
    assert got(docs_of(repeated)) == brute(repeated)


def signature(numbers):
    return bytearray(b"".join(x.to_bytes(4, "big") for x in numbers))


def test_neighbours_within_a_region(spark):
    """In a region's sorted order each row names its likeliest partner of another component, however deep the common prefix is; rows that cannot link name none."""
    rows = []
    for k in range(60):  # three thirds: of each other component the first row of the next third agrees best
        tail = [k // 20, k % 20, *range(100, 100 + 90 - 2)]
        rows.append((k, k, 10, signature([1, 2, 3, *tail, *range(3)])))
    rows += [(100 + k, 100 + k, 10, signature([1, 2, 3, 7, *(1000 * (k + 1) + x for x in range(92))])) for k in range(5)]
    reps = spark.createDataFrame(rows, "rep long, comp long, n long, sig binary")
    crowded = reps.selectExpr("99L as region", "0 as tree", "*")
    found = {tuple(r) for r in neardup._within(crowded).collect()}
    # within a third 95 of 96 hashes agree, over its border 94 or 95
    assert {x for pair in found for x in pair} == set(range(60))
    assert all(0 < b - a <= neardup.NEAREST for a, b in found)
    alike = crowded.selectExpr("region", "tree", "rep", "5L as comp", "n", "sig")
    assert not neardup._within(alike).count()


def test_tiles_leave_out_pairs_of_the_largest_component_only(spark, monkeypatch):
    monkeypatch.setattr(neardup, "TILE", 8)
    sizes = {1: [70, 3, 1, 1, 1], 2: [30] * 2, 3: [5, 2], 4: [40], 5: [1] * 20}  # 4 is closed, 3 fits a tile
    rows = [(region, 0, 1000 * region + 100 * c + k, 1000 * region + 100 * c, 10, b"") for region, parts in sizes.items() for c, m in enumerate(parts) for k in range(m)]
    crowded = spark.createDataFrame(rows, "region long, tree int, rep long, comp long, n long, sig binary")
    comp = {r[2]: r[3] for r in rows}
    groups, made = {}, {}
    for r in neardup._tiled(crowded, []).collect():
        groups.setdefault((r.region, r.i, r.j), []).append((r.side, r.rep))
        made[r.region] = made.get(r.region, 0) + 1
    met = {}
    for (region, i, j), members in groups.items():
        for x, (side, a) in enumerate(members):
            for other, b in members[:x]:
                if i == j or side != other:
                    met[frozenset((a, b))] = met.get(frozenset((a, b)), 0) + 1
    want = {frozenset((a[2], b[2])) for a in rows for b in rows if a[0] == b[0] and comp[a[2]] != comp[b[2]]}
    assert want <= set(met) and set(met.values()) == {1}
    assert made[1] <= 70 + 6 * 11 and made[3] == 7 and 4 not in made


def test_hashes_are_the_set():
    rng = random.Random(7)
    for _ in range(50):
        t = " ".join(rng.choice(["a", "bb", "ccc"]) for _ in range(rng.randint(0, 40)))
        assert len(neardup.shingle_hashes(t)) == len(shingles(t))
    assert (neardup.shingle_hashes("A b\nC  d E f") == neardup.shingle_hashes("a b c d e f")).all()


def test_one_of_each_group_stays(docs_of):
    rows = rows_of(4, 20, 4) + [r for r in EDGE if r[0] != 3]  # 3 would stand for two texts
    docs = docs_of(rows)
    kept = neardup.without_near_duplicates(docs)
    assert kept.columns == docs.columns
    want = {i for i, _, low, _ in brute(rows) if i is not None and i == low}
    ids = [r.doc_id for r in kept.collect()]
    assert sorted(i for i in ids if i is not None) == sorted(want) and ids.count(None) == 1


def test_rows_of_one_id_with_other_texts_stay(docs_of):
    """Only rows whose text really is a copy go, however many texts a doc_id stands for; results do not depend on the other rows."""
    rng = random.Random(9)
    words = [f"w{k}" for k in range(200)]
    text = [" ".join(rng.choice(words) for _ in range(60)) for _ in range(4)]
    rows = [(1, text[0]), (1, text[1]), (1, text[1]), (2, text[1]), (2, text[2] + " x"), (3, text[2]), (4, text[3]), (-5, text[0] + " y"), (6, None), (6, None), (6, ""), (None, text[0])]
    kept = neardup.without_near_duplicates(docs_of(rows)).collect()
    want = [(-5, text[0] + " y"), (1, text[1]), (2, text[2] + " x"), (4, text[3]), (6, None), (6, ""), (None, text[0])]
    assert sorted(((r.doc_id, r.text) for r in kept), key=str) == sorted(want, key=str)
    assert got(docs_of(rows)) == brute(rows)


def test_clashing_names(docs_of):
    docs = docs_of([(1, "a b c d e f"), (2, "a b c d e f"), (3, "x")])
    for name in ("_gone", "gone_id", "_0", "again_id", "body", "node", "rep"):
        renamed = docs.withColumnRenamed("lang", name)
        kept = neardup.without_near_duplicates(renamed)
        assert kept.columns == renamed.columns and sorted(r.doc_id for r in kept.collect()) == [1, 3]


def test_empty(docs_of):
    assert neardup.near_duplicates(docs_of([])).collect() == []
