"""Benchmark decontamination: one Aho-Corasick automaton over normalised test texts, each document scanned once.

Normalisation keeps byte places: A-Z is lower-cased and every separator byte becomes a space in one table
lookup, so word k of the normalised text is word k of the original and offsets map back exactly.
An item gives its windows of ten consecutive words, or one window of all its words when it has fewer.

The patterns are collected only after their size is known: items are dealt to as many slices as keep one
slice's patterns under ``max_pattern_bytes`` (64 MB by default), each slice is one automaton and one scan.
Usual benchmarks fit one slice.

Edge cases: null or wordless texts have no words and no hits; wordless items match nothing; an item without an id is listed
as ``null``; repeated items count once; repeated documents are judged row by row.
"""

from __future__ import annotations

import hashlib
import re

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import held, small_batches, table, utf8

WINDOW = 10
MAX_PATTERN_BYTES = 64 << 20
_TABLE = bytes((c + 32 if 65 <= c <= 90 else c) if 48 <= c <= 57 or 65 <= c <= 90 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def words_of(text: str | None) -> list[bytes]:
    return utf8(text).translate(_TABLE).split()


class Automaton:
    """Aho-Corasick automaton over the windows of benchmark items [(item_id, text)]."""

    def __init__(self, items: list[tuple], window: int = WINDOW):
        owners: dict[bytes, tuple[int, set[str]]] = {}
        for item_id, text in items:
            ws = words_of(text)
            n = min(window, len(ws))
            for i in range(len(ws) - n + 1 if n else 0):
                owners.setdefault(b" " + b" ".join(ws[i : i + n]) + b" ", (n, set()))[1].add("null" if item_id is None else str(item_id))
        self.machine = ahocorasick.Automaton()
        for pattern, owner in owners.items():
            self.machine.add_word(pattern.decode("latin-1"), owner)
        self.empty = not owners
        if owners:
            self.machine.make_automaton()

    def scan(self, text: str | None) -> tuple[int, np.ndarray | None, set[str]]:
        """Words of the text, a mask of the hit ones (None: no hit) and the items that occur."""
        ws = words_of(text)
        if not ws or self.empty:
            return len(ws), None, set()
        joined = (b" " + b" ".join(ws) + b" ").decode("latin-1")
        mask, items, gaps = None, set(), None
        for end, (n, owners) in self.machine.iter(joined):
            if mask is None:
                mask, gaps = np.zeros(len(ws), bool), np.flatnonzero(np.frombuffer(joined.encode("latin-1"), np.uint8) == 32)
            stop = int(np.searchsorted(gaps, end))
            mask[stop - n : stop] = True
            items |= owners
        return len(ws), mask, items


def spans_of(text: str, mask: np.ndarray) -> list[dict]:
    """Code-point ranges of the original text that runs of hit words cover."""
    spans, last = [], -2
    for k, m in enumerate(_WORD.finditer(text)):
        if mask[k]:
            if last == k - 1:
                spans[-1]["end"] = m.end()
            else:
                spans.append({"start": m.start(), "end": m.end()})
            last = k
    return spans


_HITS = "doc_id long, text string, n_words long, hit binary, items array<string>"


def _scanner(patterns, key: int):
    def run(it):
        machine = held(("automaton", key), lambda: Automaton(patterns.value))
        for batch in it:
            if not batch.num_rows:
                continue
            old = zip(*(batch.column(k).to_pylist() for k in (3, 4))) if batch.num_columns > 2 else ((None, []) for _ in range(batch.num_rows))
            n, hit, items = [], [], []
            for text, (was, had) in zip(batch.column(1).to_pylist(), old):
                count, mask, found = machine.scan(text)
                if was is not None:
                    was = np.frombuffer(was, bool)
                    mask = was if mask is None else mask | was
                n.append(count)
                hit.append(None if mask is None else mask.tobytes())
                items.append(sorted(found.union(had)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(hit, pa.binary()), pa.array(items, pa.list_(pa.string()))], ["doc_id", "text", "n_words", "hit", "items"])

    return run


def _slices(docs: DataFrame, benchmark: DataFrame, max_pattern_bytes: int):
    """(broadcast patterns, their name) of each slice of the benchmark."""
    small_batches(docs.sparkSession)
    items = benchmark.select("item_id", "text")
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    slices = max(1, -(-total * WINDOW // max_pattern_bytes))
    for k in range(slices):
        part = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(slices)) == k)
        rows = [tuple(r) for r in part.collect()]
        yield docs.sparkSession.sparkContext.broadcast(rows), hash((k, hashlib.sha256(repr(rows).encode("utf-8", "replace")).hexdigest()))


def scanned(docs: DataFrame, benchmark: DataFrame, max_pattern_bytes: int = MAX_PATTERN_BYTES) -> DataFrame:
    """(doc_id, text, n_words, hit: a byte for each word, items) of every document row."""
    out = docs.select("doc_id", "text")
    for patterns, key in _slices(docs, benchmark, max_pattern_bytes):
        out = out.mapInArrow(_scanner(patterns, key), _HITS)
    return out


def _cleaner(patterns, key: int):
    def run(it):
        machine = held(("automaton", key), lambda: Automaton(patterns.value))
        for batch in it:
            texts = batch.column(batch.schema.get_field_index("text")).to_pylist()
            yield batch.filter(pa.array([machine.scan(t)[1] is None for t in texts], pa.bool_()))

    return run


def without_contaminated(docs: DataFrame, benchmark: DataFrame, max_pattern_bytes: int = MAX_PATTERN_BYTES) -> DataFrame:
    """The documents without any hit word, all columns as they are."""
    out = docs.toDF(*["text" if c == "text" else f"_{i}" for i, c in enumerate(docs.columns)])
    for patterns, key in _slices(docs, benchmark, max_pattern_bytes):
        out = out.mapInArrow(_cleaner(patterns, key), out.schema)
    return out.toDF(*docs.columns)


def _report(it):
    for batch in it:
        if not batch.num_rows:
            continue
        hit = batch.column(3).to_pylist()
        items = batch.column(4).to_pylist()
        n_hit = [0 if h is None else h.count(1) for h in hit]
        cols = [batch.column(0), batch.column(2), pa.array(n_hit, pa.int64()), pa.array([len(x) for x in items], pa.int64()), pa.array([hashlib.sha256(",".join(sorted(x)).encode()).hexdigest() for x in items]), pa.array([x > 0 for x in n_hit])]
        spans = pa.array([[] if h is None else spans_of(t, np.frombuffer(h, bool)) for t, h in zip(batch.column(1).to_pylist(), hit)], pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))
        yield pa.RecordBatch.from_arrays([*cols, spans], ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "spans"])


def contamination(docs: DataFrame, benchmark: DataFrame, max_pattern_bytes: int = MAX_PATTERN_BYTES) -> DataFrame:
    """One row for each document: words, hit words, items found, and the hit spans of the original text."""
    found = scanned(docs, benchmark, max_pattern_bytes)
    return found.mapInArrow(_report, "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, spans array<struct<start:int,end:int>>")


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("spans")


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
OP3_SQL = rf"""
with d as (select doc_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as ws from documents),
b as (select item_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as ws from benchmark),
bl as (select item_id, ws, least(10, len(ws)) as n from b where len(ws) > 0),
bw as (select distinct item_id, n, array_to_string(ws[i:i + n - 1], ' ') as w from (select item_id, ws, n, unnest(range(1, len(ws) - n + 2)) as i from bl)),
ls as (select distinct n from bw),
dw as (select doc_id, n, i, array_to_string(ws[i:i + n - 1], ' ') as w from (select doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) as i from d, ls where len(ws) >= n)),
m as (select doc_id, item_id, i, dw.n from dw join bw on dw.n = bw.n and dw.w = bw.w),
h as (select doc_id, count(distinct k) as n_hit from (select doc_id, unnest(range(i, i + n)) as k from m) group by 1),
t as (select doc_id, count(distinct item_id) as n_items, array_to_string(list_sort(list(distinct item_id::varchar)), ',') as ids from m group by 1)
select d.doc_id, len(ws)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items,
  sha256(coalesce(ids, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join h using (doc_id) left join t using (doc_id)
"""
