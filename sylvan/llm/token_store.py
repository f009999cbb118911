"""Token ids as binary shards with a minimal perfect hash index (operator 4).

Documents are range-partitioned and sorted by doc_id (and by a text hash, so that a doc_id of very
many rows is spread too), encoded, and written as shard files.  A task closes a shard at
``SHARD_IDS`` ids or ``SHARD_DOCS`` documents and begins the next, so its memory is bounded.
Files appear under a name of their own per attempt and are renamed when complete; only files named
in the manifest count, so a lost executor leaves at most an orphan.

Shard file, little-endian:
  payload   ids, 2 or 4 bytes each (4 if the vocabulary needs it)
  offsets   u64 x (documents + 1), in ids
  keys      i64 x documents, in order; documents without a key stand first
  levels    u64 bit words of the minimal perfect hash, level after level
  slots     u32 fingerprint, u32 first document, u32 documents, for each distinct key
  footer    8 x u64: magic, id bytes, documents, documents without key, ids, distinct keys, levels, level words; before it u64 x levels: words of each level

The index: keys that fall alone on a bit of level 0 own that bit; the others go to the next level,
until all have one.  The number of set bits before a key's bit is its slot; a stored fingerprint
turns away foreign keys.  Lookup takes about 1.6 probes on average, whatever the shard's size.

Defined results: a null text is an empty one (it holds the end id only); rows of the same doc_id
stand next to each other in the order of their text hash; null doc_ids come first.
"""

from __future__ import annotations

import os
import re
import uuid
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame, Window as W
from pyspark.sql import functions as F

from .common import ensure_checkpoint_dir, only_tables_of, ship, written_table

SHARD_IDS, SHARD_DOCS = 64_000_000, 500_000
END_ID = 1
_MAGIC = int.from_bytes(b"SYLTOK01", "little")
#: Bits per key on a level: more bits, fewer levels.
_ROOM = 2.0


def _mix(x: np.ndarray, seed: int) -> np.ndarray:
    """A 64-bit mixer (multiply, shift, exclusive-or), one seed per level."""
    with np.errstate(over="ignore"):
        x = x.astype(np.uint64) + np.uint64((seed * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) & (1 << 64) - 1)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def fingerprints(keys: np.ndarray) -> np.ndarray:
    return (_mix(keys.view(np.uint64), 1 << 20) >> np.uint64(32)).astype(np.uint32)


class PerfectHash:
    """Distinct 64-bit keys to 0 .. n - 1."""

    def __init__(self, levels: list[np.ndarray]):
        self.levels = levels
        self.before, total = [], 0
        for words in levels:
            counts = np.bitwise_count(words).astype(np.int64)
            self.before.append(total + np.concatenate([[0], np.cumsum(counts)[:-1]]).astype(np.int64))
            total += int(counts.sum())

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        rest, levels = keys.view(np.uint64), []
        while len(rest):
            bits = 64 * max(1, int(np.ceil(_ROOM * len(rest) / 64)))
            at = (_mix(rest, len(levels)) % np.uint64(bits)).astype(np.int64)
            alone = np.bincount(at, minlength=bits) == 1
            levels.append(np.packbits(alone, bitorder="little").view(np.uint64).copy())
            rest = rest[~alone[at]]
        return cls(levels)

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """The slot of each key; -1 for keys that no level takes."""
        keys = keys.view(np.uint64)
        out = np.full(len(keys), -1, np.int64)
        left = np.arange(len(keys))
        for level, words in enumerate(self.levels):
            if not len(left):
                break
            at = _mix(keys[left], level) % np.uint64(64 * len(words))
            word, bit = (at >> np.uint64(6)).astype(np.int64), at & np.uint64(63)
            value = words[word]
            hit = (value >> bit) & np.uint64(1) == 1
            lower = np.bitwise_count(value & ((np.uint64(1) << bit) - np.uint64(1)))
            out[left[hit]] = (self.before[level][word] + lower)[hit]
            left = left[~hit]
        return out


def _store(folder: str):
    """The file system and path of a folder given as a path or URI."""
    from pyarrow import fs

    folder = re.sub(r"^file:/+", "file:///", folder)
    return fs.FileSystem.from_uri(folder) if "://" in folder else (fs.LocalFileSystem(), os.path.abspath(folder))


class ShardWriter:
    def __init__(self, folder: str, width: int):
        self.store, self.folder = _store(folder)
        self.kind = np.dtype("<u2" if width == 2 else "<u4")
        self.store.create_dir(self.folder, recursive=True)
        self.name = f"{uuid.uuid4().hex}.tok"
        self.out = self.store.open_output_stream(f"{self.folder}/_{self.name}")
        self.keys: list[int] = []
        self.offsets, self.empty_keys = [0], 0

    def add(self, key: int | None, ids: np.ndarray) -> None:
        self.out.write(ids.astype(self.kind).tobytes())
        self.offsets.append(self.offsets[-1] + len(ids))
        self.empty_keys += key is None
        self.keys.append(0 if key is None else key)

    def close(self) -> str:
        keys = np.array(self.keys, "<i8")
        own = keys[self.empty_keys:]
        first = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]])) if len(own) else np.zeros(0, np.int64)
        runs = np.diff(np.concatenate([first, [len(own)]])) if len(own) else first
        index = PerfectHash.build(own[first])
        at = index.slots(own[first])
        slots = np.zeros((len(first), 3), "<u4")
        slots[at, 0], slots[at, 1], slots[at, 2] = fingerprints(own[first]), first + self.empty_keys, runs
        sizes = np.array([len(w) for w in index.levels], "<u8")
        footer = np.array([_MAGIC, self.kind.itemsize, len(keys), self.empty_keys, self.offsets[-1], len(first), len(sizes), int(sizes.sum())], "<u8")
        for part in (np.array(self.offsets, "<u8"), keys, *index.levels, slots, sizes, footer):
            self.out.write(np.ascontiguousarray(part).tobytes())
        self.out.close()
        self.store.move(f"{self.folder}/_{self.name}", f"{self.folder}/{self.name}")
        return self.name


class Shard:
    """Keyed access to one shard file; only the index is held in memory."""

    def __init__(self, folder: str, name: str):
        store, path = _store(folder)
        self.file = store.open_input_file(f"{path}/{name}")
        end = self.file.size()
        magic, self.width, docs, self.empty_keys, self.n_ids, distinct, levels, words = (int(x) for x in self._read(end - 64, "<u8", 8))
        if magic != _MAGIC:
            raise ValueError(f"{name} is no token shard")
        at = self.n_ids * self.width
        self.offsets = self._read(at, "<u8", docs + 1).astype(np.int64)
        at += 8 * (docs + 1)
        self.keys = self._read(at, "<i8", docs)
        at += 8 * docs
        bits = self._read(at, "<u8", words)
        at += 8 * words
        self.slots = self._read(at, "<u4", 3 * distinct).reshape(-1, 3)
        at += 12 * distinct
        sizes = self._read(at, "<u8", levels).astype(np.int64)
        self.index = PerfectHash(np.split(bits, np.cumsum(sizes)[:-1]) if levels else [])

    def _read(self, at: int, kind: str, n: int) -> np.ndarray:
        return np.frombuffer(self.file.read_at(n * np.dtype(kind).itemsize, at), kind)

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First document and number of documents of each key; 0 documents for keys not in the shard."""
        keys = np.ascontiguousarray(keys, "<i8")
        if not len(self.slots):
            return np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64)
        slot = self.index.slots(keys)
        rows = self.slots[np.maximum(slot, 0)].astype(np.int64)
        own = (slot >= 0) & (rows[:, 0] == fingerprints(keys)) & (self.keys[rows[:, 1]] == keys)
        return rows[:, 1], np.where(own, rows[:, 2], 0)

    def ids(self, doc: int, until: int | None = None) -> np.ndarray:
        """Ids of one document, or of the documents from ``doc`` up to ``until``."""
        low, high = self.offsets[doc], self.offsets[doc + 1 if until is None else until]
        return self._read(int(low) * self.width, f"<u{self.width}", int(high - low))

    def close(self) -> None:
        self.file.close()


class WordEncoder:
    """A tokenizer of the library, called once per distinct word.

    For vocabularies that drop white space, lower-case, and part letters from marks: no token then
    reaches over a blank or line break, so the ids of a text are those of its pieces between them,
    one after another.  Known pieces are kept up to ``MOST_BYTES``, then forgotten all at once.
    """

    MOST_BYTES, PIECES, TOGETHER = 240_000_000, 20_000, 1000
    #: ASCII marks without the apostrophe, which contractions need.
    MARKS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the tasks share out the cores
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = True  # the names of special tokens inside a text are ordinary text
        self.known: dict[str, bytes] = {"": b""}
        self.held = 0
        if self.library.encode("a b\nc", add_special_tokens=False).ids != [i for w in "abc" for i in self.library.encode(w, add_special_tokens=False).ids]:
            raise ValueError("this vocabulary keeps white space")
        one = lambda w: self.library.encode(w, add_special_tokens=False).ids
        if one("Ab,.") != one("ab") + one(",.") or one("AB***") != one("ab") + one("***"):
            raise ValueError("this vocabulary keeps capitals, or joins letters and marks")

    def vocabulary(self) -> int:
        return self.library.get_vocab_size(with_added_tokens=True)

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        pieces, out = text.replace("\n", " ").split(" "), []
        for at in range(0, len(pieces), self.PIECES):
            part = pieces[at:at + self.PIECES]
            if self.held > self.MOST_BYTES:
                self.known, self.held = {"": b""}, 0
            known = self.known
            new = [w for w in set(part) if w not in known]
            for i in range(0, len(new), self.TOGETHER):
                self._learn(new[i:i + self.TOGETHER])
            out.extend(map(known.__getitem__, part))
        return b"".join(out)

    def _learn(self, new: list[str]) -> None:
        """Marks after a letter are a pre-token of their own and A-Z are lower-cased, so ``Word,`` is ``word`` and ``,``."""
        apart, need, known = [], set(), self.known
        for w in new:
            core, mark = w.rstrip(self.MARKS), ""
            if core and core[-1].isalpha() and len(core[-1].lower()) == 1:  # a capital dotted I ends in a mark when lower-cased
                mark = w[len(core):]
            else:
                core = w
            if core.isascii():
                core = core.lower()
            if core not in known:
                need.add(core)
            if mark and mark not in known:
                need.add(mark)
            apart.append((w, core, mark))
        self._ask(list(need))
        for w, core, mark in apart:
            if mark:
                known[w] = known[core] + known[mark]
            elif w is not core:
                known[w] = known[core]
            self.held += 4 * len(w) + 150

    def _ask(self, new: list[str]) -> None:
        """One call for many pieces; a token belongs to the piece its first character lies in."""
        made = self.library.encode(" ".join(new), add_special_tokens=False)
        starts = np.cumsum([0, *(len(w) + 1 for w in new)])
        ids = np.array(made.ids, "<u4")
        first = 4 * np.searchsorted(np.array([a for a, _ in made.offsets], np.int64), starts) if len(ids) else np.zeros(len(starts), np.int64)
        raw = ids.tobytes()
        for w, a, b in zip(new, first[:-1].tolist(), first[1:].tolist()):
            self.known[w] = raw[a:b]
            self.held += 4 * len(w) + b - a + 150


@lru_cache(maxsize=2)
def tokenizer(path: str) -> WordEncoder:
    return WordEncoder(path)


def written_shards(docs: DataFrame, folder: str, path: str, end_id: int = END_ID, shard_ids: int = SHARD_IDS, shard_docs: int = SHARD_DOCS) -> DataFrame:
    """Encode and write all documents; the manifest: one row per shard, in order, with ``start``, the ids before it."""
    ship(docs.sparkSession)
    text = F.coalesce(F.col("text"), F.lit(""))
    # equal doc_ids may fill several partitions; the order is total up to equal rows
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text")]
    rows = docs.select("doc_id", text.alias("text")).repartitionByRange(*order).sortWithinPartitions(*order)

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyspark import TaskContext

        part, done, shard, end = TaskContext.get().partitionId(), [], None, end_id.to_bytes(4, "little")
        only_tables_of("token_store", tokenizer.cache_clear)
        own = tokenizer(path)
        width = 2 if max(own.vocabulary() - 1, end_id) < 1 << 16 else 4

        def close() -> None:
            n, ids, key = len(shard.keys), shard.offsets[-1], [shard.keys[i] if i >= shard.empty_keys else None for i in (0, -1 % len(shard.keys))]
            done.append((part, len(done), shard.close(), key[0], key[1], n, ids))

        for batch in batches:
            for key, text in zip(batch.column(0), batch.column(1)):
                shard = shard or ShardWriter(folder, width)
                shard.add(key.as_py(), np.frombuffer(own.encode(text.as_py()) + end, "<u4"))
                if shard.offsets[-1] >= shard_ids or len(shard.keys) >= shard_docs:
                    close()
                    shard = None
        if shard:
            close()
        yield pa.RecordBatch.from_pylist([dict(zip(("part", "seq", "shard", "first_key", "last_key", "n_docs", "n_ids"), r)) for r in done], schema=pa.schema(
            [("part", pa.int32()), ("seq", pa.int32()), ("shard", pa.string()), ("first_key", pa.int64()), ("last_key", pa.int64()), ("n_docs", pa.int64()), ("n_ids", pa.int64())]))

    made = rows.mapInArrow(run, "part int, seq int, shard string, first_key long, last_key long, n_docs long, n_ids long")
    manifest = written_table(made)  # written once: the files exist when it is complete
    # one row per shard of tens of millions of ids, so this order fits one task at any input size
    before = W.orderBy("part", "seq").rowsBetween(W.unboundedPreceding, -1)
    return manifest.withColumn("start", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))


def read_documents(manifest: DataFrame, folder: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document, each key looked up in its shard's index."""
    ship(manifest.sparkSession)
    spread = manifest.select("shard", "start").repartition(max(1, manifest.sparkSession.sparkContext.defaultParallelism * 2))

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for name, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                shard = Shard(folder, name)
                keys = shard.keys[shard.empty_keys:]
                first, runs = shard.find(np.unique(keys))
                docs = np.concatenate([np.arange(shard.empty_keys), *([np.repeat(first, runs) + _steps(runs)] if len(runs) else [])]).astype(np.int64)
                docs.sort()
                for at in range(0, len(docs), 1000):
                    part = docs[at:at + 1000]
                    low, high = shard.offsets[part], shard.offsets[part + 1]
                    crc = [zlib.crc32(shard.ids(int(d)).astype("<u4").tobytes()) for d in part]
                    yield pa.RecordBatch.from_arrays([
                        pa.array([None if d < shard.empty_keys else int(shard.keys[d]) for d in part], pa.int64()), pa.array(low + start, pa.int64()),
                        pa.array(high - low, pa.int64()), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])
                shard.close()

    return spread.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def _steps(runs: np.ndarray) -> np.ndarray:
    """0, 1, .. within each run."""
    ends = np.cumsum(runs)
    return np.arange(int(ends[-1])) - np.repeat(ends - runs, runs)


def lookup(manifest: DataFrame, folder: str, keys: DataFrame) -> DataFrame:
    """doc_id and ids (array) of the given keys: routed to shards by key range, then found by hash."""
    ship(keys.sparkSession)
    k = keys.select(F.col("doc_id")).filter("doc_id is not null").distinct()
    # one row per shard; the ranges overlap only where one key fills several shards
    m = manifest.select("shard", "first_key", "last_key")
    routed = k.join(m, (F.col("doc_id") <= F.col("last_key")) & ((F.col("doc_id") >= F.col("first_key")) | F.col("first_key").isNull())).select("shard", "doc_id").repartition("shard").sortWithinPartitions("shard")

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        shard, name = None, None
        for batch in batches:
            for s, key in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if s != name:
                    if shard:
                        shard.close()
                    shard, name = Shard(folder, s), s
                first, n = shard.find(np.array([key], np.int64))
                for d in range(int(first[0]), int(first[0] + n[0])):
                    yield pa.RecordBatch.from_arrays([pa.array([key], pa.int64()), pa.array([shard.ids(d).astype(np.int64).tolist()], pa.list_(pa.int64()))], names=["doc_id", "ids"])
        if shard:
            shard.close()

    return routed.mapInArrow(run, "doc_id long, ids array<long>")


def new_folder(spark) -> str:
    """A folder of its own below the shared checkpoint folder."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/tokens/{uuid.uuid4().hex}"
