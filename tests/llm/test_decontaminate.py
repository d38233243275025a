import hashlib
import re

from planeframe.llm.decontaminate import contamination, without_contaminated

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(t):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")


def brute(text, items):
    ws = WORD.findall(lower(text))
    hit, found = set(), set()
    for item, t in items:
        iw = WORD.findall(lower(t))
        n = min(10, len(iw))
        for i in range(len(iw) - n + 1 if n else 0):
            for k in range(len(ws) - n + 1):
                if ws[k : k + n] == iw[i : i + n]:
                    hit |= set(range(k, k + n))
                    found.add(str(item))
    return len(ws), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)


ITEMS = [(1, "The quick, brown fox; jumps over the lazy dog and runs away home"), (22, "short item"), (3, None), (4, "..."), (22, "short item"), (5, "é à ü"), (6, "a a a a a a a a a a a")]
TEXTS = [
    "QUICK brown-fox jumps over the lazy dog and runs!", "x the quick brown fox jumps over the lazy dog y", "short\n\nITEM short item shortitem", "é  à--ü", "a " * 15, "the quick brown fox", "Short. The quick, brown fox; jumps over the lazy dog and runs away home item",
]


def check(spark, docs, size):
    bench = spark.createDataFrame(ITEMS, "item_id long, text string").selectExpr("item_id", "text", "1 as n_words")
    got = sorted((tuple(r)[:6] for r in contamination(docs, bench, size).collect()), key=str)
    want = sorted(((r.doc_id, *brute(r.text, ITEMS)) for r in docs.select("doc_id", "text").collect()), key=str)
    assert got == want
    keep = sorted((r.doc_id for r in without_contaminated(docs, bench, size).collect()), key=str)
    assert keep == sorted((w[0] for w in want if not w[-1]), key=str)


def test_against_brute_force(spark, docs_of, edge):
    docs = edge.unionAll(docs_of([(100 + k, t) for k, t in enumerate(TEXTS)]))
    check(spark, docs, 64 << 20)
    check(spark, docs, 400)  # several slices


def test_spans_of_the_original(spark, docs_of):
    text = "¡Hey! -- SHORT--Item, é"
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    (row,) = contamination(docs_of([(1, text)]), bench).collect()
    assert [text[s.start : s.end] for s in row.spans] == ["SHORT--Item"]


def test_empty(spark, docs_of):
    none = spark.createDataFrame([], "item_id long, text string")
    assert contamination(docs_of([]), none).collect() == []
    assert contamination(docs_of([(1, "a b")]), none).first().contaminated is False
