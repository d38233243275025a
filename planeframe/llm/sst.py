"""Token ids in sorted-string-table shards: documents keyed by id, prefix-compressed blocks, sparse index, Bloom filter, footer.

File layout, all numbers little endian:

* data blocks, each one zstd frame; entries in key order as ``u8 shared prefix, u8 suffix length, u32 value length, suffix,
  value``; the first entry of a block shares nothing, so a block is read on its own;
* index: for each block ``first key, last key (9 bytes each), u64 offset, u32 length, u32 entries``;
* Bloom filter: ten bits and seven probes a key, double hashing of one 128-bit hash;
* footer: JSON (width of an id, counts, offsets, CRC-32 of index and filter), its u32 length, and the magic word.

A key is one byte (0 for a null id, else 1) and the id as big-endian unsigned 64-bit with flipped sign, so byte order is number order
and null comes first. Values are token ids of two bytes where the vocabulary allows it, else four.

Rows are range-partitioned by (doc_id, hash of the text); a task writes its range as files of about ``file_bytes``,
under a temporary name that is then moved to its final one, so a task that runs again replaces the same file by the same bytes.

Edge cases: null and empty texts have only the end id; rows that repeat a doc_id are separate entries in the order of their
texts' hashes, and a lookup returns all; an empty table writes no file; texts of any length are encoded whole.
"""

from __future__ import annotations

import json
import re
import struct
import unicodedata
import uuid
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import held, new_path, one_thread, small_batches, table, written

MAGIC = b"PFSSTAB1"
BLOCK_BYTES = 64 << 10
FILE_BYTES = 256 << 20
INDEX = struct.Struct("<9s9sQII")
BITS, PROBES = 10, 7
END_ID = 2
#: Bytes of texts that are cut into units together.
CHUNK_BYTES = 4 << 20
#: Kinds of characters in the tokenizer's pattern: white space, letters, numbers and all others.
SPACE, LETTER, NUMBER, SIGN = range(4)
_PRINTABLE = {*range(33, 127), *range(161, 173), *range(174, 256)}
#: The byte alphabet: bytes that print stand for themselves, the others for the letters from 256 on.
_BYTE_LETTERS = {b: (b if b in _PRINTABLE else 256 + k) for k, b in enumerate(sorted(set(range(256)) - _PRINTABLE))} | {b: b for b in _PRINTABLE}


def key_of(doc_id: int | None) -> bytes:
    return bytes(9) if doc_id is None else b"\x01" + ((doc_id ^ -(1 << 63)) & (2**64 - 1)).to_bytes(8, "big")


def id_of(key: bytes) -> int | None:
    return None if key[0] == 0 else ((int.from_bytes(key[1:], "big") ^ (1 << 63)) ^ (1 << 63)) - (1 << 63)


def _probes(key: bytes, bits: int) -> list[int]:
    h = xxhash.xxh3_128_intdigest(key)
    a, b = h & (2**64 - 1), (h >> 64) | 1
    return [(a + i * b) % bits for i in range(PROBES)]


class TableWriter:
    """Writes one file from (key, ids as bytes) in key order to a stream; blocks leave as they fill, index and keys stay until the end."""

    def __init__(self, width: int, stream):
        self.width, self.stream, self.size, self.index, self.keys = width, stream, 0, [], []
        self.block, self.first, self.last, self.entries, self.n_tokens = bytearray(), None, None, 0, 0
        self.zip = zstandard.ZstdCompressor(level=1)

    def add(self, key: bytes, value: bytes) -> None:
        shared = 0
        if self.last is not None and self.entries:
            while shared < 9 and key[shared] == self.last[shared]:
                shared += 1
        self.block += struct.pack("<BBI", shared, 9 - shared, len(value)) + key[shared:] + value
        if not self.entries:
            self.first = key
        self.last, self.entries = key, self.entries + 1
        self.keys.append(key)
        self.n_tokens += len(value) // self.width
        if len(self.block) >= BLOCK_BYTES:
            self.end_block()

    def end_block(self) -> None:
        if self.entries:
            packed = self.zip.compress(bytes(self.block))
            self.index.append(INDEX.pack(self.first, self.last, self.size, len(packed), self.entries))
            self._put(packed)
            self.block, self.entries = bytearray(), 0

    def _put(self, raw: bytes) -> None:
        self.stream.write(raw)
        self.size += len(raw)

    def finish(self) -> None:
        self.end_block()
        index = b"".join(self.index)
        bits = max(64, BITS * len(self.keys))
        bloom = np.zeros(-(-bits // 8), np.uint8)
        for key in self.keys:
            for p in _probes(key, bits):
                bloom[p >> 3] |= 1 << (p & 7)
        bloom = bloom.tobytes()
        footer = {"width": self.width, "docs": len(self.keys), "tokens": self.n_tokens, "index": [self.size, len(index)], "bloom": [self.size + len(index), len(bloom)], "bits": bits, "crc32": [zlib.crc32(index), zlib.crc32(bloom)]}
        tail = json.dumps(footer).encode()
        self._put(index + bloom + tail + struct.pack("<I", len(tail)) + MAGIC)


class TableReader:
    """Reads a file of TableWriter: all entries in order, or those of one id by the filter and a binary search of the index."""

    def __init__(self, path: str):
        fs, name = pafs.FileSystem.from_uri(path)
        self.file = fs.open_input_file(name)
        size = self.file.size()
        tail = self._at(max(0, size - 12), 12)
        if tail[4:] != MAGIC:
            raise ValueError(f"not a sorted string table: {path}")
        (n,) = struct.unpack("<I", tail[:4])
        self.footer = json.loads(self._at(size - 12 - n, n))
        self.width = self.footer["width"]
        index, self.bloom = self._at(*self.footer["index"]), self._at(*self.footer["bloom"])
        if [zlib.crc32(index), zlib.crc32(self.bloom)] != self.footer["crc32"]:
            raise ValueError(f"damaged index or filter: {path}")
        self.index = [INDEX.unpack_from(index, i) for i in range(0, len(index), INDEX.size)]
        self.blocks_read = 0

    def _at(self, offset: int, n: int) -> bytes:
        self.file.seek(offset)
        return self.file.read(n)

    def _block(self, i: int) -> Iterator[tuple[bytes, bytes]]:
        self.blocks_read += 1
        _, _, offset, n, entries = self.index[i]
        raw, at, key = zstandard.ZstdDecompressor().decompress(self._at(offset, n)), 0, b""
        for _ in range(entries):
            shared, rest, size = struct.unpack_from("<BBI", raw, at)
            key = key[:shared] + raw[at + 6 : at + 6 + rest]
            at += 6 + rest
            yield key, raw[at : at + size]
            at += size

    def ids(self, value: bytes) -> np.ndarray:
        return np.frombuffer(value, f"<u{self.width}")

    def __iter__(self) -> Iterator[tuple[int | None, np.ndarray]]:
        for i in range(len(self.index)):
            for key, value in self._block(i):
                yield id_of(key), self.ids(value)

    def get(self, doc_id: int | None) -> list[np.ndarray]:
        key = key_of(doc_id)
        if any(not self.bloom[p >> 3] >> (p & 7) & 1 for p in _probes(key, self.footer["bits"])):
            return []
        lo, hi = 0, len(self.index)
        while lo < hi:  # the first block whose last key is not below the key
            mid = (lo + hi) // 2
            lo, hi = (mid + 1, hi) if self.index[mid][1] < key else (lo, mid)
        found = []
        while lo < len(self.index) and self.index[lo][0] <= key:
            found += [self.ids(v) for k, v in self._block(lo) if k == key]
            lo += 1
        return found

    def close(self) -> None:
        self.file.close()


def _binary(stops: np.ndarray, body: bytes) -> pa.Array:
    return pa.Array.from_buffers(pa.binary(), len(stops) - 1, [None, pa.py_buffer(stops.astype(np.int32)), pa.py_buffer(body)])


class Encoder:
    """Whole-text token ids with the tokenizers library, remembering the ids of space-parted pieces.

    The tokenizer drops white space and no token spans it, so a text's ids are those of its pieces between spaces and
    line ends, one after the other. New pieces of lower-case letters go to the tokenizer's model as the one word they are, a full stop or
    comma after a letter is a word of its own, and capitals below U+0250 are lower-cased as the tokenizer does; each of these short cuts is taken only where
    the tokenizer shows on probes that it agrees. All else goes to the tokenizer whole. The memory has two generations of ``keep`` pieces: the old one goes when the young one is full.

    ``many`` takes the texts of a batch at once. Those of characters below U+0100 are cut by arrays into the units that the tokenizer encodes apart: contractions, runs of letters,
    single numbers, runs of other signs. Only units that are new to a second such memory cost more than array steps. Where probes of every one of these characters show that the tokenizer cuts otherwise,
    where a text holds an added token or is very long, or where ``many`` is not sure, the text goes alone as above.
    """

    def __init__(self, path: str, end_id: int | None = END_ID, keep: int = 250_000):
        one_thread()
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.width = 2 if max(vocabulary.values()) < 1 << 16 else 4
        self.code, self.keep, self.memo, self.old = "H" if self.width == 2 else "I", keep, {}, {}
        self.end = b"" if end_id is None else array(self.code, [end_id]).tobytes()
        self.model = self.tokenizer.model
        self.letters_alone = all(self._word(w) == self._whole([w])[0] for w in ("a", "water", "stra\u00dfe", "\u00e9t\u00e9", "ma\u00f1ana"))
        self.lower = all(self._whole([w])[0] == self._whole([w.lower()])[0] for w in ("WATER", "Abc", "Q", "\u00c9T\u00c9", "\u00d1o"))
        self.stops_part = self._whole(["water.", "\u00e9,"]) == [self._whole([a])[0] + self._whole([b])[0] for a, b in (("water", "."), ("\u00e9", ","))]
        self.units, self.old_units = {}, {}
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        # added tokens of another kind than whole, literal ones may match what is not in the text as they are written
        self.by_units = self.letters_alone and not any(t.normalized or t.lstrip or t.rstrip for t in self.tokenizer.get_added_tokens_decoder().values())
        self._probe()

    def _probe(self) -> None:
        """The kind of each character below U+0100, and whether the tokenizer cuts texts of them as ``_by_units`` does."""
        kinds = {"L": LETTER, "N": NUMBER, "Z": SPACE}
        kinds = [SPACE if chr(c) in "\t\n\v\f\r\x85" else kinds.get(unicodedata.category(chr(c))[0], SIGN) for c in range(256)]
        self.kinds, self.lowered, self.odd = bytes(kinds), bytes(ord(chr(c).lower()) for c in range(256)), b""
        self.spaces = bytes(c for c in range(256) if kinds[c] == SPACE)
        if self.by_units:
            probes = [f"a{x}b {x}{x} .{x}1 1{x}. '{x}s {x}'s" for x in map(chr, range(256))]
            self.odd = bytes(c for c, (a, b) in enumerate(zip(self._by_units([p.encode("latin-1") for p in probes]), self._whole(probes))) if a != b + self.end)
            more = ["it's don't we're I've I'm he'll I'd", "'sea 'LLAMA 's's ''s !'s 1's 'r 'v 'l '\u00e9t 're've", "3.14 $12,000.00 (a)b-c_d \u00bd\u00b2 AKIA9", "Stra\u00dfe \u00c9T\u00c9 \u00aa\u00ba\u00b5"]
            self.by_units = self._by_units([p.encode("latin-1") for p in more]) == [x + self.end for x in self._whole(more)]

    def _word(self, word: str) -> bytes:
        """Ids of a word of lower-case letters by the tokenizer's model alone, in the byte alphabet."""
        mapped = word if word.isascii() else word.encode().decode("latin-1").translate(_BYTE_LETTERS)
        return array(self.code, [t.id for t in self.model.tokenize(mapped)]).tobytes()

    def _whole(self, pieces: list[str]) -> list[bytes]:
        return [array(self.code, self.tokenizer.encode(p, add_special_tokens=False).ids).tobytes() for p in pieces]

    def _encode(self, pieces: list[str]) -> dict[str, bytes]:
        """Ids of new pieces by the tokenizer."""
        plain = [p for p in pieces if p.isalpha() and p.islower() and max(p) < "\u0250"] if self.letters_alone else []
        found = {p: self._word(p) for p in plain}
        rest = [p for p in pieces if p not in found]
        found.update(zip(rest, self._whole(rest)))
        return found

    def _learn(self, pieces: set[str]) -> None:
        if len(self.memo) > self.keep:
            self.memo, self.old = {}, self.memo
        memo, old, plans, new = self.memo, self.old, [], set()
        for p in pieces:
            if p in old or not p:
                memo[p] = old.get(p, b"")
                continue
            base, tail = p, ""
            if max(p) < "\u0250" and "\u0130" not in p:
                if self.lower:
                    base = p.lower()
                if self.stops_part and base[-1] in ".," and base[-2:-1].isalpha():
                    base, tail = base[:-1], base[-1]
            plans.append((p, base, tail))
            new.update(x for x in (base, tail) if x not in memo)
        memo.update((x, old[x]) for x in new if x in old)
        memo.update(self._encode([x for x in new if x not in memo]))
        memo.update((p, memo[base] + memo[tail] if tail else memo[base]) for p, base, tail in plans)

    def __call__(self, text: str | None) -> bytes:
        pieces = (text or "").replace("\n", " ").split(" ")
        try:
            return b"".join(map(self.memo.__getitem__, pieces)) + self.end
        except KeyError:
            wanted = set(pieces)
            memo = self.memo
            self._learn(wanted.difference(memo))
            if self.memo is not memo:  # it was emptied: the rest of this text anew
                self._learn(wanted.difference(self.memo))
            return b"".join([self.memo[p] for p in pieces]) + self.end


    def _unit(self, unit: bytes) -> bytes:
        """Ids of a unit that ``_by_units`` cut: letters by the model alone, all else by the tokenizer."""
        text = unit.decode("latin-1")
        return self._word(text) if text.isalpha() else self._whole([text])[0]

    def _known(self, units: list[bytes]) -> list[bytes]:
        if len(self.units) > self.keep:
            self.units, self.old_units = {}, self.units
        known, old = self.units, self.old_units
        found = list(map(known.get, units))
        for k, ids in enumerate(found):
            if ids is None:
                unit = units[k]
                ids = old.get(unit)
                known[unit] = found[k] = self._unit(unit) if ids is None else ids
        return found

    def _by_units(self, raws: list[bytes]) -> list[bytes]:
        """Ids of texts in Latin-1 without odd characters and added tokens."""
        text = b" ".join([*raws, b"", b""])  # two spaces at the end
        kind = np.frombuffer(text.translate(self.kinds), np.uint8)
        begins = kind == NUMBER
        begins[0] = True
        begins[1:] |= kind[1:] != kind[:-1]
        begins &= kind != SPACE
        if b"'" in text:  # a contraction where a run of signs would begin: the letters after it are a unit of their own
            low = np.frombuffer(text.translate(self.lowered), np.uint8)
            quotes = np.flatnonzero(begins & (low == ord("'")))
            one, two = low[quotes + 1], low[np.minimum(quotes + 2, len(low) - 1)]
            size = np.isin(one, np.frombuffer(b"stmd", np.uint8)).astype(np.int64)
            size[((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l"))] = 2
            quotes, size = quotes[size > 0], size[size > 0]
            begins[quotes + 1] = False
            after = quotes + 1 + size
            begins[after] |= kind[after] == LETTER
        body, at = text.translate(self.lowered, self.spaces), np.flatnonzero(begins[kind != SPACE])
        units = _binary(np.append(at, len(body)), body).dictionary_encode()
        _, stops, new = units.dictionary.buffers()
        stops, new = np.frombuffer(stops, np.int32, len(units.dictionary) + 1).tolist(), new.to_pybytes() if new else b""
        found = pa.array(self._known([new[a:b] for a, b in zip(stops, stops[1:])]), pa.binary()).take(units.indices)
        stops, ids = np.frombuffer(found.buffers()[1], np.int32, len(found) + 1), found.buffers()[2].to_pybytes() if len(found) else b""
        firsts = np.cumsum([0, *(len(r) + 1 for r in raws)])
        cuts = stops[np.searchsorted(np.flatnonzero(begins), firsts)].tolist()
        return [ids[a:b] + self.end for a, b in zip(cuts, cuts[1:])]

    def many(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text."""
        out: list = [None] * len(texts)
        rows, raws, size = [], [], 0

        def flush():
            nonlocal rows, raws, size
            for k, ids in zip(rows, self._by_units(raws) if rows else ()):
                out[k] = ids
            rows, raws, size = [], [], 0

        for k, text in enumerate(texts):
            text = text or ""
            try:
                raw = text.encode("latin-1") if self.by_units and len(text) <= CHUNK_BYTES else None
            except UnicodeEncodeError:
                raw = None
            if raw is None or any(a in text for a in self.added) or self.odd and len(raw.translate(None, self.odd)) < len(raw):
                out[k] = self(text)
                continue
            rows.append(k)
            raws.append(raw)
            size += len(raw)
            if size >= CHUNK_BYTES:
                flush()
        flush()
        return out


def encoder(path: str, end_id: int | None) -> Encoder:
    return held(("encoder", path, end_id), lambda: Encoder(path, end_id))


def _writer(folder: str, tokenizer: str, end_id: int | None, file_bytes: int):
    def run(it):
        encode, part = encoder(tokenizer, end_id), TaskContext.get().partitionId()
        fs, root = pafs.FileSystem.from_uri(folder)
        made, out, temporary = 0, None, ""

        def put():
            nonlocal made
            out.finish()
            out.stream.close()
            name = f"part-{part:06d}-{made:04d}.sst"
            fs.move(temporary, f"{root}/{name}")
            made += 1
            return pa.RecordBatch.from_pydict({"file": [f"{folder}/{name}"], "part": [part], "seq": [made - 1], "docs": [len(out.keys)], "tokens": [out.n_tokens], "bytes": [out.size]}, schema=_MANIFEST_ARROW)

        for batch in it:
            for doc_id, ids in zip(batch.column(0).to_pylist(), encode.many(batch.column(1).to_pylist())):
                if out is None:
                    fs.create_dir(root, recursive=True)
                    temporary = f"{root}/.part-{part:06d}-{made:04d}.{uuid.uuid4().hex}"
                    out = TableWriter(encode.width, fs.open_output_stream(temporary))
                out.add(key_of(doc_id), ids)
                if out.size >= file_bytes:
                    yield put()
                    out = None
        if out:
            yield put()

    return run


_MANIFEST = "file string, part int, seq int, docs long, tokens long, bytes long"
_MANIFEST_ARROW = pa.schema([("file", pa.string()), ("part", pa.int32()), ("seq", pa.int32()), ("docs", pa.int64()), ("tokens", pa.int64()), ("bytes", pa.int64())])


def write_tables(docs: DataFrame, folder: str, tokenizer: str, end_id: int | None = END_ID, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Writes (doc_id, text) as table files under ``folder`` in ascending doc_id order; returns the written manifest with each file's first token number."""
    spark = docs.sparkSession
    small_batches(spark)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select("doc_id", "text").withColumn("_h", F.xxhash64("text")).repartitionByRange(n, F.col("doc_id").asc_nulls_first(), "_h")
    rows = rows.sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "_h").select("doc_id", "text")
    manifest = written(rows.mapInArrow(_writer(folder, tokenizer, end_id, file_bytes), _MANIFEST), "manifest")
    before = F.sum("tokens").over(Window.orderBy("part", "seq").rowsBetween(Window.unboundedPreceding, -1))
    return manifest.withColumn("start", F.coalesce(before, F.lit(0)))


def _reader(it):
    for batch in it:
        for file, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            reader, rows = TableReader(file), []
            for doc_id, ids in reader:
                rows.append((doc_id, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                start += len(ids)
            reader.close()
            cols = list(zip(*rows))
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["doc_id", "start", "n_tokens", "ids_crc32"])


def read_tables(manifest: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document in the files of a manifest."""
    n = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return manifest.select("file", "start").repartition(n, "file").mapInArrow(_reader, "doc_id long, start long, n_tokens long, ids_crc32 long")


def lookup(folder: str, doc_id: int | None) -> list[np.ndarray]:
    """The token ids of all documents with this id in the files of a folder; files are skipped by their index range and filter."""
    fs, root = pafs.FileSystem.from_uri(folder)
    found = []
    for info in sorted(fs.get_file_info(pafs.FileSelector(root)), key=lambda x: x.path):
        if re.fullmatch(r"part-\d+-\d+\.sst", info.base_name):
            reader = TableReader(f"{folder.rstrip('/')}/{info.base_name}")
            found += reader.get(doc_id)
            reader.close()
    return found


def token_tables(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """Encodes documents, writes them to a new folder of the shared one and reads the result back from the files."""
    if tokenizer is None:
        import public_tokenizers

        tokenizer = public_tokenizers.path("word_bpe_49k.json")
    return read_tables(write_tables(docs, new_path(docs.sparkSession, "tables"), tokenizer))


def op2_sorted_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_tables(table(spark, sf_dir, "documents"))
