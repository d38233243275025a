"""Token counts by a linear longest-match automaton.

A trie over the vocabulary gets, for every node, a failure link and the number of pieces that greedy longest-match
tokenisation pops before it may follow that link. Reading a word is then one step for each character with no backing up,
and its number of pieces is known without building one. The unit is the word as the tokenizer file normalises
and splits it, in its byte alphabet, with the end-of-word mark as a last letter; every piece, first or later, comes from
the same vocabulary. A word that cannot be covered counts as one unknown piece.

Edge cases: null and empty texts have no words and no tokens; words of any length are read once; repeated rows are
counted row by row; special-token strings are ordinary text.
"""

from __future__ import annotations

import json
from collections import deque

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import batches, held, one_thread, small_batches, table

END = "\0"


class LongestMatch:
    """The automaton over a set of pieces; ``end`` is the letter that closes a word."""

    def __init__(self, pieces: set[str], end: str = END):
        self.end = end
        children: list[dict[str, int]] = [{}]
        terminal = [False]
        for piece in pieces:
            v = 0
            for c in piece:
                if c not in children[v]:
                    children[v][c] = len(children)
                    children.append({})
                    terminal.append(False)
                v = children[v][c]
            if v:
                terminal[v] = True
        fail, pops = [-1] * len(children), [0] * len(children)
        todo = deque([0])
        while todo:
            u = todo.popleft()
            for c, v in children[u].items():
                todo.append(v)
                if terminal[v]:
                    fail[v], pops[v] = 0, 1
                    continue
                z, n = fail[u], pops[u]
                while z >= 0 and c not in children[z]:
                    n += pops[z]
                    z = fail[z]
                if z >= 0:
                    fail[v], pops[v] = children[z][c], n
        self.children, self.fail, self.pops = children, fail, pops

    def count(self, word: str) -> int:
        """Pieces of greedy longest-match over ``word`` and the end mark; 1 if they cannot cover it."""
        children, fail, pops = self.children, self.fail, self.pops
        v = n = 0
        for c in word + self.end:
            while c not in children[v]:
                if fail[v] < 0:
                    return 1
                n += pops[v]
                v = fail[v]
            v = children[v][c]
        while v:
            if fail[v] < 0:
                return 1
            n += pops[v]
            v = fail[v]
        return n


class Counter:
    """Words and pieces of whole texts, remembering space-parted pieces of text; the memory is emptied at ``keep`` entries."""

    def __init__(self, path: str, suffix: str = "</w>", keep: int = 300_000):
        one_thread()
        from tokenizers import Tokenizer

        vocabulary = json.load(open(path, encoding="utf-8"))["model"]["vocab"]
        self.machine = LongestMatch({p.removesuffix(suffix) + END if p.endswith(suffix) else p for p in vocabulary})
        tokenizer = Tokenizer.from_file(path)
        self.normalise, self.split = tokenizer.normalizer.normalize_str, tokenizer.pre_tokenizer.pre_tokenize_str
        self.keep, self.memo = keep, {"": (0, 0)}

    def piece(self, piece: str) -> tuple[int, int]:
        words = [w for w, _ in self.split(self.normalise(piece))]
        return len(words), sum(map(self.machine.count, words))

    def __call__(self, text: str | None) -> tuple[int, int]:
        words = tokens = 0
        memo = self.memo
        for p in (text or "").replace("\n", " ").split(" "):
            if p in memo:
                w, t = memo[p]
            else:
                if len(memo) >= self.keep:
                    memo = self.memo = {"": (0, 0)}
                w, t = memo[p] = self.piece(p)
            words += w
            tokens += t
        return words, tokens


def _counting(path: str):
    def count(batch: pa.RecordBatch) -> pa.RecordBatch:
        counter = held(("counter", path), lambda: Counter(path))
        found = [counter(t) for t in batch.column(1).to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array([w for w, _ in found], pa.int64()), pa.array([t for _, t in found], pa.int64())], ["doc_id", "n_words", "n_tokens"])

    return count


def token_counts(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """Documents (doc_id, text) -> (doc_id, n_words, n_tokens), one row for each input row."""
    if tokenizer is None:
        import public_tokenizers

        tokenizer = public_tokenizers.path("word_bpe_49k.json")
    small_batches(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(batches(_counting(tokenizer)), "doc_id long, n_words long, n_tokens long")


def op7_longest_match_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"))
