"""Token ids in binary files with a minimal perfect hash index from document keys to documents.

A store is a folder in a file system that all executors share:

- `*.ids`: the ids of documents one after another, each with the end id behind it, little-endian, 16 bits wide
  where all ids fit, else 32. Nothing else stands in it.
- `*.docs`: where the documents of the `.ids` file of the same name begin, and where the last ends: 64-bit numbers.
- `*.index`: segments of the index. A segment holds the keys of one bucket (those whose hash leaves the same rest):
  bit arrays of the levels of the hash with the ones before each word, then for each slot a 32-bit fingerprint of
  the key, the number of its first document and how many documents have it. About 22 bytes a key; keys are not stored.
- the tables `entries` (key, file, place), `segments` (bucket, file, position, size): Parquet.

Documents are numbered in ascending order of key (null first, equal keys by text). Spark deals them out in key
ranges; a task encodes its range and writes files of bounded size, so the order of files is that of keys and no task
sees more than its range. Equal rows are told apart by where they stood, so that copies of one row spread too.

The hash: level after level, a key is placed by a new hash into twice as many bits as there are keys left; keys
alone at their bit stay, the others go on. A slot is the number of ones before that bit. It needs a few reads for a
key, whatever the number of keys, and no two keys share a slot. A bucket is bounded, and built in one task.

File names carry a fresh mark of the attempt that wrote them, and only those of attempts that Spark committed are in the
tables. So lost executors and repeated attempts leave files that nobody reads.

Keys may be null, which is a key of its own. A repeated key stands for all its documents. Null text is empty: it has
the end id alone. A key that is not there is not found, up to fingerprints that agree by chance (2 ** -32). An empty table
makes an empty store.
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chartline.llm import flat
from chartline.llm.chunks import ChunkCache, byte_letters, cuts, unlike

END_ID = 2
FILE_IDS = 64 << 20
BUCKET_KEYS = 1 << 15
READ_BLOCK = 1024
SLICE_BYTES = 2 << 20
GAMMA = 2
MOST_LEVELS = 200

_ODD = np.uint64(0x9E3779B97F4A7C15)
# Plain words hold ASCII letters and those from U+00C0 to U+017F, but for the signs of multiplication and
# division and the dotted capital I, whose lower case is two characters. All of them are composed.
_LETTER = np.zeros(256, bool)
_LETTER[0x41:0x5B] = _LETTER[0x61:0x7B] = True
_NOT_LETTERS = ((0xC3, 0x97), (0xC3, 0xB7), (0xC4, 0xB0))


def _plain_bytes(data: np.ndarray) -> np.ndarray:
    """Which bytes belong to letters of plain words."""
    out = _LETTER[data]
    lead = (data >= 0xC3) & (data <= 0xC5)
    for one, other in _NOT_LETTERS:
        lead[:-1] &= (data[:-1] != one) | (data[1:] != other)
    out |= lead
    out[1:] |= lead[:-1]
    return out


class Encoder:
    """A tokenizer that drops white space, on chunks. Texts are encoded as by the library without special tokens added."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # tasks are the threads
        self.model = Tokenizer.from_file(path)
        self.most = max(self.model.get_vocab(with_added_tokens=True).values())
        if not self._parted():
            raise ValueError(f"{path}: the tokens of a text are not those of its words")
        self.words = self._ranked(path)
        self.cache = ChunkCache(lambda chunks: [np.array(x, "<u4").tobytes() for x in self.ids(chunks)])

    def _ranked(self, path: str):
        """The same tokens for plain words, all in one call, where the entries are in the order of the merges.

        A word is lower-cased Latin letters. Its last byte is an entry of its own, written here with a zero byte behind it.
        """
        import tiktoken

        with open(path, encoding="utf-8") as file:
            model = json.load(file)
        entries, end = model["model"]["vocab"], model["model"].get("end_of_word_suffix")
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["model"]["merges"]]
        if not end or any(entries.get("".join(m).replace(end, "") + (end if m[1].endswith(end) else "")) != 512 + k for k, m in enumerate(merges)):
            return None
        byte_of = byte_letters()
        ranks = {}
        for entry, k in entries.items():
            word = entry.removesuffix(end) if k < 512 + len(merges) else ""
            if word and all(c in byte_of for c in word):
                ranks[bytes(byte_of[c] for c in word) + (b"\0" if entry.endswith(end) else b"")] = k
        if len(ranks) != 512 + len(merges):
            return None
        self.ends = np.zeros(self.most + 1, bool)
        self.ends[[k for raw, k in ranks.items() if len(raw) > 1 and raw.endswith(b"\0")]] = True
        return tiktoken.Encoding("words", pat_str=r"[^\x00]+\x00", mergeable_ranks=ranks, special_tokens={})

    def _pooled(self, chunks: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids of chunks, where those of each chunk begin, how many): plain words by rank in one call, others by the library."""
        data, offsets = flat.column_bytes(chunks)
        n = len(chunks)
        plain = np.zeros(n, bool)
        if self.words is not None:
            odd = ~_plain_bytes(data)
            first = offsets[:-1]
            marked = (data[first] == 0x20) | (data[first] == 0x0A)
            odd[first[marked]] = False
            plain = (flat.per_row(odd, offsets) == 0) & (np.diff(offsets) > marked)
        begins, lengths = np.zeros(n, np.int64), np.zeros(n, np.int64)
        pools = [np.empty(0, np.uint32)]
        if plain.any():
            skip = marked[plain].astype(np.int64)
            size = np.diff(offsets)[plain] - skip
            ends = np.cumsum(size + 1)
            line = np.zeros(int(ends[-1]), np.uint8)
            line[flat.ranges(ends - size - 1, size)] = data[flat.ranges(first[plain] + skip, size)]
            ids = self.words.encode_to_numpy(line.tobytes().decode().lower(), disallowed_special=())
            borders = np.concatenate([[0], np.flatnonzero(self.ends[ids]) + 1])
            begins[plain], lengths[plain] = borders[:-1], np.diff(borders)
            pools.append(ids)
        others = np.flatnonzero(~plain)
        if len(others):
            entries = self.cache.of(chunks.take(pa.array(others)).to_pylist())
            lengths[others] = np.fromiter(map(len, entries), np.int64, len(entries)) // 4
            begins[others] = sum(map(len, pools)) + np.cumsum(lengths[others]) - lengths[others]
            pools.append(np.frombuffer(b"".join(entries), "<u4"))
        return np.concatenate(pools), begins, lengths

    def ids(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.model.encode_batch_fast(texts, add_special_tokens=False)]

    def _parted(self) -> bool:
        whole, *parts = self.ids(["One two\nthree, 4.", "One", " two", "\nthree", ",", " 4", "."])
        return whole == [k for part in parts for k in part]

    def encode(self, data: np.ndarray, offsets: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all rows with the end id behind each, number of ids of each row)."""
        n = len(offsets) - 1
        if not len(data):
            return np.full(n, end_id, np.uint32), np.ones(n, np.int64)
        starts = cuts(data, offsets, b" \n", b".,;:!?")
        chunks, which = unlike(data, starts)
        pool, begins, lengths = self._pooled(chunks)
        ids = pool[flat.ranges(begins[which], lengths[which])]
        row = np.searchsorted(starts, offsets)
        counts = flat.per_row(lengths[which], row) + 1
        out = np.empty(int(counts.sum()), np.uint32)
        ends = np.cumsum(counts)
        out[ends - 1] = end_id
        out[flat.ranges(ends - counts, counts - 1)] = ids
        return out, counts


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


@dataclass(frozen=True)
class Store:
    """A written store: its folder, the files in order with the documents and ids before each, and its two tables."""

    folder: str
    width: int
    files: tuple[str, ...]
    docs_before: np.ndarray
    ids_before: np.ndarray
    buckets: int
    entries: DataFrame
    segments: DataFrame


def _written(path: str, folder: str, width: int, end_id: int, file_ids: int):
    """(key, text) in order to (key, part, number, file, place, n): files of ids, and where each document went."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, part = encoder(path), TaskContext.get().partitionId()
        system, root = flat.opened(folder)
        number, name, stream, begins = 0, "", None, [0]

        def close() -> None:
            nonlocal stream
            stream.close()
            with system.open_output_stream(f"{root}/{name}.docs") as out:
                out.write(np.array(begins, "<u8").tobytes())
            stream = None

        for batch in batches:
            data, offsets = flat.column_bytes(batch.column(1))
            for a, b in flat.slices(offsets, min(SLICE_BYTES, file_ids)):
                ids, counts = model.encode(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], end_id)
                if stream is not None and begins[-1] >= file_ids:
                    close()
                    number += 1
                if stream is None:
                    name, begins = f"{part:06d}-{number:04d}-{uuid.uuid4().hex}", [0]
                    stream = system.open_output_stream(f"{root}/{name}.ids")
                stream.write(ids.astype(f"<u{width}").tobytes())
                first, at = len(begins) - 1, begins[-1]
                begins += (at + np.cumsum(counts)).tolist()
                rows, n = batch.slice(a, b - a), b - a
                yield pa.RecordBatch.from_arrays(
                    [rows.column(0), pa.array(np.full(n, part, np.int32)), pa.array(np.full(n, number, np.int32)), pa.array([name] * n, pa.string()),
                     pa.array(np.arange(first, first + n)), pa.array(counts)],
                    names=["key", "part", "number", "file", "place", "n"],
                )
        if stream is not None:
            close()

    return run


def _hashes(key: Column) -> tuple[Column, Column]:
    return F.xxhash64(F.lit(1), key), F.xxhash64(F.lit(2), key)


def _position(h1: np.ndarray, h2: np.ndarray, level: int, bits: int) -> np.ndarray:
    seed = flat.mix(np.array([level + 1], np.uint64) * _ODD)[0]
    return (flat.mix(h1 ^ flat.mix(h2 ^ seed)) % np.uint64(bits)).astype(np.int64)


def built(h1: np.ndarray, h2: np.ndarray, first: np.ndarray, copies: np.ndarray) -> bytes:
    """The segment of unlike keys, named by 128 bits: first document and number of documents of each."""
    n, words, sizes = len(h1), [], []
    rest = np.arange(n)
    while len(rest):
        if len(sizes) == MOST_LEVELS:
            raise ValueError("two keys agree in all 128 bits of their hash")
        size = -(-GAMMA * len(rest) // 64) * 64
        at = _position(h1[rest], h2[rest], len(sizes), size)
        alone = np.bincount(at, minlength=size) == 1
        words.append(np.packbits(alone, bitorder="little").view("<u8"))
        sizes.append(size // 64)
        rest = rest[~alone[at]]
    line = np.concatenate(words) if words else np.empty(0, "<u8")
    before = (np.cumsum(np.bitwise_count(line).astype(np.int64)) - np.bitwise_count(line)).astype("<u4")
    parts = [np.array([n, len(sizes)], "<u8"), np.array(sizes, "<u8"), line, before.astype("<u4")]
    slot = _slots(h1, h2, sizes, line, before)
    values = np.empty((3, n), "<u8")
    values[:, slot] = h2 & np.uint64(0xFFFFFFFF), first, copies
    return b"".join(p.tobytes() for p in [*parts, values[0].astype("<u4"), values[1], values[2]])


def _slots(h1: np.ndarray, h2: np.ndarray, sizes: list[int], line: np.ndarray, before: np.ndarray) -> np.ndarray:
    """The slot of each key; -1 where no level holds it."""
    slot = np.full(len(h1), -1, np.int64)
    rest, start = np.arange(len(h1)), 0
    for level, size in enumerate(sizes):
        at = _position(h1[rest], h2[rest], level, size * 64)
        word, bit = start + at // 64, (at % 64).astype(np.uint64)
        hit = (line[word] >> bit) & np.uint64(1) == 1
        under = line[word] & ((np.uint64(1) << bit) - np.uint64(1))
        slot[rest[hit]] = (before[word].astype(np.int64) + np.bitwise_count(under))[hit]
        rest, start = rest[~hit], start + size
    return slot


def found(segment: bytes, h1: np.ndarray, h2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first document, number of documents) of each key in its segment; 0 documents where it is not there."""
    n, levels = np.frombuffer(segment, "<u8", 2).astype(int).tolist()
    sizes = np.frombuffer(segment, "<u8", levels, 16).astype(int).tolist()
    words, at = sum(sizes), 16 + 8 * levels
    line = np.frombuffer(segment, "<u8", words, at)
    before = np.frombuffer(segment, "<u4", words, at + 8 * words)
    at += 12 * words
    prints = np.frombuffer(segment, "<u4", n, at)
    first, copies = (np.frombuffer(segment, "<u8", n, at + 4 * n + 8 * n * k) for k in range(2))
    slot = _slots(h1, h2, sizes, line, before)
    there = np.flatnonzero(slot >= 0)
    there = there[prints[slot[there]] == (h2[there] & np.uint64(0xFFFFFFFF))]
    out = np.zeros((2, len(h1)), np.int64)
    out[:, there] = first[slot[there]], copies[slot[there]]
    return out[0], out[1]


def _segments(folder: str):
    """(bucket, h1, h2, first, copies) by bucket to (bucket, file, position, size)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = flat.opened(folder)
        name, stream, at = f"{uuid.uuid4().hex}.index", None, 0
        for table in flat.whole_groups(batches, "bucket"):
            bucket, h1, h2, first, copies = (table.column(c).to_numpy() for c in ("bucket", "h1", "h2", "first", "copies"))
            borders = np.concatenate([[0], np.flatnonzero(np.diff(bucket)) + 1, [len(bucket)]])
            rows = []
            for a, b in zip(borders[:-1].tolist(), borders[1:].tolist(), strict=True):
                raw = built(h1[a:b].view(np.uint64), h2[a:b].view(np.uint64), first[a:b], copies[a:b])
                if stream is None:
                    stream = system.open_output_stream(f"{root}/{name}")
                stream.write(raw)
                rows.append((int(bucket[a]), name, at, len(raw)))
                at += len(raw)
            columns = list(zip(*rows, strict=True))
            yield pa.RecordBatch.from_arrays(
                [pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.string()), pa.array(columns[2], pa.int64()), pa.array(columns[3], pa.int64())],
                names=["bucket", "file", "position", "size"],
            )
        if stream is not None:
            stream.close()

    return run


def write(
    docs: DataFrame, path: str, *, key: str = "doc_id", text: str = "text", end_id: int = END_ID, folder: str | None = None,
    file_ids: int = FILE_IDS, bucket_keys: int = BUCKET_KEYS,
) -> Store:
    """Encode docs with the tokenizer at `path` and write a store, into a new folder below `folder` (default: the
    shared checkpoint folder). Other columns of docs are not kept."""
    spark = docs.sparkSession
    flat.durable(spark)
    folder = f"{folder or spark.sparkContext.getCheckpointDir()}/shards-{uuid.uuid4()}"
    system, root = flat.opened(folder)
    system.create_dir(root, recursive=True)
    width = 2 if max(encoder(path).most, end_id) < 1 << 16 else 4

    rows = docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text"))
    order = [F.asc_nulls_first("key"), "mark", "spread"]
    placed = (
        rows.withColumns({"mark": F.xxhash64("text"), "spread": F.monotonically_increasing_id()})
        .repartitionByRange(*order).sortWithinPartitions(*order).select("key", "text")
    )
    schema = T.StructType([placed.schema["key"], *T.StructType.fromDDL("part int, number int, file string, place bigint, n bigint").fields])
    entries = _table(flat.mapped(placed, _written(path, folder, width, end_id, file_ids), schema), f"{folder}/entries")

    # One row for each file, which are of bounded number: about file_ids ids each, and one a task.
    files = entries.groupBy("part", "number", "file").agg(F.count(F.lit(1)).alias("docs"), F.sum("n").alias("ids")).orderBy("part", "number").collect()
    docs_before = np.cumsum([0, *(f.docs for f in files)])
    ids_before = np.cumsum([0, *(f.ids for f in files)])
    names = tuple(f.file for f in files)
    buckets = max(1, -(-int(docs_before[-1]) // bucket_keys))

    firsts = spark.createDataFrame([(f.file, int(k)) for f, k in zip(files, docs_before, strict=False)], "file string, before bigint")
    h1, h2 = _hashes(F.col("key"))
    keys = (
        entries.join(F.broadcast(firsts), "file").groupBy("key")
        .agg(F.min(F.col("before") + F.col("place")).alias("first"), F.count(F.lit(1)).alias("copies"))
        .select(h1.alias("h1"), h2.alias("h2"), "first", "copies")
        .select(F.pmod("h1", F.lit(buckets)).alias("bucket"), "h1", "h2", "first", "copies")
        .repartition("bucket").sortWithinPartitions("bucket")
    )
    segments = _table(flat.mapped(keys, _segments(folder), "bucket bigint, file string, position bigint, size bigint"), f"{folder}/segments")
    return Store(folder, width, names, docs_before, ids_before, buckets, entries, segments)


def _table(df: DataFrame, folder: str) -> DataFrame:
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def lookup(store: Store, keys: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, first, copies of each distinct key that the index holds: its first document and how many it has."""
    h1, h2 = _hashes(F.col("key"))
    asked = keys.select(F.col(f"`{key}`").alias("key")).distinct().select("key", h1.alias("h1"), h2.alias("h2"))
    asked = asked.withColumn("bucket", F.pmod("h1", F.lit(store.buckets)))
    placed = asked.join(store.segments, "bucket").repartition("bucket").sortWithinPartitions("bucket")
    schema = T.StructType([placed.schema["key"], *T.StructType.fromDDL("first bigint, copies bigint").fields])
    folder = store.folder

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = flat.opened(folder)
        held, segment = -1, b""
        for batch in batches:
            bucket, h1, h2 = (batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("bucket", "h1", "h2"))
            borders = np.concatenate([[0], np.flatnonzero(np.diff(bucket)) + 1, [len(bucket)]])
            for a, b in zip(borders[:-1].tolist(), borders[1:].tolist(), strict=True):
                if a == b:
                    continue
                if int(bucket[a]) != held:
                    row = {c: batch.column(batch.schema.get_field_index(c))[a].as_py() for c in ("file", "position", "size")}
                    with system.open_input_file(f"{root}/{row['file']}") as file:
                        held, segment = int(bucket[a]), file.read_at(row["size"], row["position"])
                first, copies = found(segment, h1[a:b].view(np.uint64), h2[a:b].view(np.uint64))
                there = pa.array(copies > 0)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(batch.schema.get_field_index("key")).slice(a, b - a).filter(there), pa.array(first).filter(there), pa.array(copies).filter(there)],
                    names=["key", "first", "copies"],
                )

    return flat.mapped(placed, run, schema)


def read(store: Store, keys: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, start, n_tokens, ids of every document of these keys; ids are packed, little-endian, 32 bits each.

    start is the number of ids of all documents before it. The index names the documents; only these are read.
    """
    block = F.lit(READ_BLOCK).cast("bigint")
    # A key of many documents is dealt out in blocks of them.
    spans = lookup(store, keys, key).withColumn("last", F.col("first") + F.col("copies") - 1)
    blocks = spans.select("key", "first", "last", F.explode(F.sequence(F.floor(F.col("first") / block), F.floor(F.col("last") / block))).alias("block"))
    dealt = blocks.repartition("block").sortWithinPartitions("block")
    low, high = F.greatest("first", F.col("block") * block), F.least("last", F.col("block") * block + block - 1)
    wanted = dealt.select("key", F.explode(F.sequence(low, high)).alias("doc"))
    table = wanted.sparkSession.sparkContext.broadcast((store.files, store.docs_before, store.ids_before))
    folder, width = store.folder, store.width
    schema = T.StructType([wanted.schema["key"], *T.StructType.fromDDL("start bigint, n_tokens bigint, ids binary").fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, docs_before, ids_before = table.value
        system, root = flat.opened(folder)
        for batch in batches:
            doc = batch.column(1).to_numpy()
            order = np.argsort(doc, kind="stable")
            file_of = np.searchsorted(docs_before, doc[order], "right") - 1
            for k in np.unique(file_of).tolist():
                some = order[file_of == k]
                place = doc[some] - docs_before[k]
                low, high = int(place.min()), int(place.max()) + 1
                with system.open_input_file(f"{root}/{names[k]}.docs") as file:
                    begins = np.frombuffer(file.read_at(8 * (high - low + 1), 8 * low), "<u8").astype(np.int64)
                start, end = begins[place - low], begins[place - low + 1]
                with system.open_input_file(f"{root}/{names[k]}.ids") as file:
                    for a, b in _reads(start, end):
                        ids = np.frombuffer(file.read_at(width * int(end[b - 1] - start[a]), width * int(start[a])), f"<u{width}").astype("<u4")
                        raw = ids.tobytes()
                        packed = pa.array([raw[4 * (x - start[a]) : 4 * (y - start[a])] for x, y in zip(start[a:b].tolist(), end[a:b].tolist(), strict=True)], pa.binary())
                        yield pa.RecordBatch.from_arrays(
                            [batch.column(0).take(pa.array(some[a:b])), pa.array(ids_before[k] + start[a:b]), pa.array((end - start)[a:b]), packed],
                            names=["key", "start", "n_tokens", "ids"],
                        )

    return flat.mapped(wanted, run, schema).withColumnRenamed("key", key)


def _reads(start: np.ndarray, end: np.ndarray) -> Iterator[tuple[int, int]]:
    """Documents, in the order of the file, in reads of about a million ids; what lies between two of a read is little."""
    a = 0
    for b in range(1, len(start) + 1):
        if b == len(start) or end[b] - start[a] > 1 << 20 or start[b] - end[b - 1] > 1 << 12:
            yield a, b
            a = b


def query(spark: SparkSession, sf_dir: str, path: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    store = write(docs, path)
    return read(store, docs).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
