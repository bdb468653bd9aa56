"""Tokens of one tokenizer aligned with those of another, over exact-distinct texts.

A text (with one space before it) is encoded by A, a byte-level BPE, and by B, a SentencePiece model that adds
that space itself. Byte offsets at which a token of A and a token of B both end cut the text into groups; an A
and a B token are linked where their byte ranges overlap. The count of an id pair is the number of links in the
whole corpus.

1. Texts are shuffled by their full text and counted, so each distinct text is encoded and aligned once, however
   many copies there are. A hot text is one row per task before the shuffle.
2. Within a task texts are cut before spaces, where neither tokenizer has a token across, and equal chunks are
   encoded once. Tokens, groups and links of a text are those of its chunks. The aligned texts are written.
3. Pair counts are summed from the links, weighted by the number of copies; partly in the task, then by pair.
4. Each aligned text meets the counts again: as a sorted array sent to all tasks when there are at most
   `sent_pairs` of them (checked by counting), else by a shuffle on the pair. Both ways give the same.
5. The measures of a text join every document of that text by a 128-bit hash of it; Spark's skew join splits a hot one.

Null and empty texts have no tokens, and neither have texts whose joined token bytes are not the text (such as
texts that hold U+2581): zeros and empty lists. Ids may repeat or be null: each row gets the measures of its text.
An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chartline.llm import flat
from chartline.llm.chunks import ChunkCache, byte_letters, cuts, gathered

SENT_PAIRS = 4_000_000
SLICE_BYTES = 4 << 20
BLOCK_BYTES = 1 << 20
# Links and pairs held by a task before they are summed and passed on.
HELD_LINKS = 1 << 21
SPACE = "▁"
# Fixed value: how a byte-level BPE splits text before it merges.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

MEASURES = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")


class Spelling:
    """The bytes of the entries of a vocabulary, as one array."""

    def __init__(self, entries: list[bytes]):
        self.lengths = np.array([len(x) for x in entries], np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.bytes = np.frombuffer(b"".join(entries), np.uint8)

    def spell(self, ids: np.ndarray, n: np.ndarray, chunks: list[bytes], size: np.ndarray) -> np.ndarray:
        """Whether the ids of each chunk (n of them, all one after another) spell its bytes."""
        row = np.concatenate([[0], np.cumsum(n)])
        good = flat.per_row(self.lengths[ids], row) == size
        some = ids[np.repeat(good, n)]
        ours = self.bytes[flat.ranges(self.starts[some], self.lengths[some])]
        theirs = np.frombuffer(b"".join([c for c, ok in zip(chunks, good.tolist(), strict=True) if ok]), np.uint8)
        good[good] = flat.per_row(ours != theirs, np.concatenate([[0], np.cumsum(size[good])])) == 0
        return good


def _flat(lists: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    n = np.fromiter(map(len, lists), np.int64, len(lists))
    return np.fromiter(chain.from_iterable(lists), np.int64, int(n.sum())), n


class Aligner:
    """Both tokenizers and the bytes of their tokens. The models are read from files at the same path everywhere."""

    def __init__(self, a_path: str, b_path: str):
        import sentencepiece
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # tasks are the threads
        self.a = Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True
        self.a_ids = self._ranked(a_path) or (lambda texts: [e.ids for e in self.a.encode_batch_fast(texts, add_special_tokens=False)])
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        self.a_raw = Spelling(self._byte_level(self.a))
        b_bytes = []
        for k in range(self.b.get_piece_size()):
            piece = self.b.id_to_piece(k)
            b_bytes.append(bytes([int(piece[1:-1], 16)]) if self.b.is_byte(k) else piece.replace(SPACE, " ").encode())
        self.b_raw = Spelling(b_bytes)
        for k in range(self.b.get_piece_size()):
            if SPACE in self.b.id_to_piece(k).lstrip(SPACE):
                raise ValueError(f"{b_path}: a piece holds a space after another character")
        self.n_b = len(b_bytes)
        self.code = np.dtype("<u4") if len(self.a_raw.lengths) * self.n_b < 1 << 32 else np.dtype("<u8")
        self.digits = Spelling([str(k).encode() for k in range(max(len(self.a_raw.lengths), self.n_b))])
        self.cache = ChunkCache(self.encoded)

    def _ranked(self, path: str):
        """The same encoding by rank, which is much faster on short texts, where the entries are in the order of the merges."""
        import tiktoken

        with open(path, encoding="utf-8") as file:
            model = json.load(file)
        entries, merges, split = model["model"]["vocab"], model["model"]["merges"], model["pre_tokenizer"]
        joined = ["".join(m if isinstance(m, list) else m.split(" ")) for m in merges]
        first = len(entries) - len(merges) if len(set(entries.values())) == len(entries) else -1
        first -= sum(1 for token in model["added_tokens"] if token["content"] in entries)
        plain = split == {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True} and not model["normalizer"]
        if not plain or model["model"]["dropout"] or any(entries.get(entry) != first + k for k, entry in enumerate(joined)):
            return None
        raw = self._byte_level(self.a)
        ranks = {raw[k]: k for k in range(first + len(merges))}
        encode = tiktoken.Encoding("ranked", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        return lambda texts: [encode(t) for t in texts]

    @staticmethod
    def _byte_level(model) -> list[bytes]:
        byte_of = byte_letters()
        out = []
        for k in range(model.get_vocab_size()):
            entry = model.id_to_token(k)
            out.append(bytes(byte_of[c] for c in entry) if all(c in byte_of for c in entry) else entry.encode())
        return out

    def encoded(self, chunks: list[str]) -> list[tuple[bytes, bytes] | None]:
        """The ids of A and of B, packed, of chunks that begin with a space; None where their bytes are not the chunk."""
        a, a_n = _flat(self.a_ids(chunks))
        b, b_n = _flat(self.b.encode([c[1:] for c in chunks], num_threads=1))
        raw = [c.encode() for c in chunks]
        size = np.fromiter(map(len, raw), np.int64, len(raw))
        whole = self.a_raw.spell(a, a_n, raw, size) & self.b_raw.spell(b, b_n, raw, size)
        packed_a, packed_b = a.astype("<u4").tobytes(), b.astype("<u4").tobytes()
        a_at, b_at = ((4 * np.concatenate([[0], np.cumsum(n)])).tolist() for n in (a_n, b_n))
        return [
            (packed_a[a_at[k] : a_at[k + 1]], packed_b[b_at[k] : b_at[k + 1]]) if ok else None
            for k, ok in enumerate(whole.tolist())
        ]

    def texts(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, list[str], list[bytes]]:
        """(n_a, n_b, n_groups and n_links of each row, digest of its groups, its links) of rows that begin with a space."""
        n = len(offsets) - 1
        starts = cuts(data, offsets, b" ")
        entries, which = self.cache.entries(data, starts)
        bad = np.array([e is None for e in entries], bool)
        row = np.searchsorted(starts, offsets)
        good = flat.per_row(bad[which], row) == 0
        entries = [e or (b"", b"") for e in entries]
        a_parts, b_parts = [e[0] for e in entries], [e[1] for e in entries]
        owner = np.repeat(np.arange(n), np.diff(row))
        held = np.flatnonzero(good[owner])
        counts = np.zeros((n, 4), np.int64)
        digests = [hashlib.sha256() if ok else None for ok in good.tolist()]
        packed: list[list[bytes]] = [[] for _ in range(n)]
        # Chunks end groups, so a long text is done in blocks of chunks.
        for low, high in flat.slices(np.append(starts, len(data))[np.append(held, len(starts))], BLOCK_BYTES):
            some = held[low:high]
            a, a_n = gathered(a_parts, which[some], "<u4")
            b, b_n = gathered(b_parts, which[some], "<u4")
            rows, first = np.unique(owner[some], return_index=True)
            a_row = np.concatenate([[0], np.cumsum(a_n)])[np.append(first, len(some))]
            b_row = np.concatenate([[0], np.cumsum(b_n)])[np.append(first, len(some))]
            links, link_row, n_groups, text, text_row = self._linked(a, a_row, b, b_row)
            counts[rows] += np.stack([np.diff(a_row), np.diff(b_row), n_groups, np.diff(link_row)], 1)
            link_row, text_row = link_row.tolist(), text_row.tolist()
            for k, r in enumerate(rows.tolist()):
                if packed[r]:
                    digests[r].update(b";")
                digests[r].update(text[text_row[k] : text_row[k + 1] - 1])
                packed[r].append(links[link_row[k] : link_row[k + 1]].tobytes())
        return counts, [d.hexdigest() if d and p else "" for d, p in zip(digests, packed, strict=True)], [b"".join(p) for p in packed]

    def _linked(self, a: np.ndarray, a_row: np.ndarray, b: np.ndarray, b_row: np.ndarray):
        """(links, links before each row, groups of each row, groups as text, text before each row) of tokens that
        spell the same bytes, row by row. A group is its A ids, then its B ids, each number with a mark behind it."""
        a_size, b_size = self.a_raw.lengths[a], self.b_raw.lengths[b]
        a_end, b_end = np.cumsum(a_size), np.cumsum(b_size)
        n_bytes = int(a_end[-1])
        a_ends, b_ends = np.zeros(n_bytes + 1, bool), np.zeros(n_bytes + 1, bool)
        a_ends[a_end] = b_ends[b_end] = True
        b_before = np.cumsum(b_ends)  # tokens of B that end at or before a byte
        low = b_before[a_end - a_size]
        n = b_before[a_end - 1] + 1 - low
        links = (np.repeat(a.astype(np.int64), n) * self.n_b + b[flat.ranges(low, n)]).astype(self.code)
        link_row = np.concatenate([[0], np.cumsum(n)])[a_row]
        both = a_ends & b_ends
        a_cut, b_cut = both[a_end], both[b_end]  # the last tokens of groups
        a_group, b_group = np.cumsum(a_cut) - a_cut, np.cumsum(b_cut) - b_cut
        n_groups = flat.per_row(a_cut, a_row)
        a_upto, b_upto = np.flatnonzero(a_cut) + 1, np.flatnonzero(b_cut) + 1
        a_place = np.arange(len(a)) + np.concatenate([[0], b_upto])[a_group]
        b_place = np.arange(len(b)) + a_upto[b_group]
        word = np.empty(len(a) + len(b), np.int64)
        mark = np.empty(len(word), np.uint8)
        word[a_place], word[b_place] = a, b
        mark[a_place], mark[b_place] = np.where(a_cut, ord("|"), ord(",")), np.where(b_cut, ord(";"), ord(","))
        lengths = self.digits.lengths[word]
        borders = np.concatenate([[0], np.cumsum(lengths + 1)])
        out = np.empty(int(borders[-1]), np.uint8)
        out[borders[1:] - 1] = mark
        out[flat.ranges(borders[:-1], lengths)] = self.digits.bytes[flat.ranges(self.digits.starts[word], lengths)]
        return links, link_row, n_groups, out.tobytes(), borders[a_row + b_row]


@lru_cache(maxsize=2)
def aligner(a_path: str, b_path: str) -> Aligner:
    return Aligner(a_path, b_path)


def _aligned(a_path: str, b_path: str):
    """(h1, h2, copies, text) to (h1, h2, copies, measures, groups_sha256, links)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = aligner(a_path, b_path)
        for batch in batches:
            data, offsets = flat.column_bytes(batch.column(3))
            for a, b in flat.slices(offsets, SLICE_BYTES):
                counts, digests, links = model.texts(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                rows = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays(
                    [*rows.columns[:3], *(pa.array(counts[:, k]) for k in range(4)), pa.array(digests, pa.string()), pa.array(links, pa.binary())],
                    names=["h1", "h2", "copies", *MEASURES[:4], "groups_sha256", "links"],
                )

    return run


def _summed(codes: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Weights summed for each code, in whole numbers."""
    order = np.argsort(codes, kind="stable")
    codes, total = codes[order], np.concatenate([[0], np.cumsum(weights[order])])
    last = np.flatnonzero(np.concatenate([codes[1:] != codes[:-1], [True]])) if len(codes) else np.empty(0, np.int64)
    return codes[last], np.diff(total[np.concatenate([[0], last + 1])])


def _links_of(column: pa.Array, code: np.dtype) -> tuple[np.ndarray, np.ndarray]:
    """(all links, links of each row) of a column of packed links."""
    column = column.cast(pa.large_binary())
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return np.frombuffer(data[offsets[0] : offsets[-1]].tobytes(), code), np.diff(offsets) // code.itemsize


def _counted(code: np.dtype, n_b: int):
    """(copies, links) to (a, b, n), summed within the task as far as memory is set aside for it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows(pairs: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
            for k in range(0, len(pairs), 1 << 16):
                some = pairs[k : k + (1 << 16)].astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(some // n_b), pa.array(some % n_b), pa.array(n[k : k + (1 << 16)])], names=["a", "b", "n"])

        pairs, total = np.empty(0, code), np.empty(0, np.int64)
        for batch in batches:
            links, n = _links_of(batch.column(1), code)
            if not len(links):
                continue
            weights = np.repeat(batch.column(0).to_numpy(), n)
            pairs, total = _summed(np.concatenate([pairs, links]), np.concatenate([total, weights]))
            if len(pairs) > HELD_LINKS:
                yield from rows(pairs, total)
                pairs, total = pairs[:0], total[:0]
        yield from rows(pairs, total)

    return run


def _scored(table, code: np.dtype):
    """(h1, h2, links) to (h1, h2, n_best, count_sum) by the counts that were sent."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, counts, best = table.value
        for batch in batches:
            links, n = _links_of(batch.column(2), code)
            row = np.concatenate([[0], np.cumsum(n)])
            at = np.searchsorted(pairs, links)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(flat.per_row(best[at], row)), pa.array(flat.per_row(counts[at], row))],
                names=["h1", "h2", "n_best", "count_sum"],
            )

    return run


def _once(code: np.dtype, n_b: int):
    """(h1, h2, links) to (h1, h2, a, b, times): each pair of a text once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h1, h2 = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            links, n = _links_of(batch.column(2), code)
            row = np.concatenate([[0], np.cumsum(n)])
            for k in range(len(n)):
                pairs, times = np.unique(links[row[k] : row[k + 1]].astype(np.int64), return_counts=True)
                if len(pairs):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(pairs), h1[k])), pa.array(np.full(len(pairs), h2[k])), pa.array(pairs // n_b), pa.array(pairs % n_b), pa.array(times)],
                        names=["h1", "h2", "a", "b", "times"],
                    )

    return run


def text_key(text: Column) -> tuple[Column, Column]:
    """Two 64-bit hashes that name a text."""
    return F.xxhash64(text), F.xxhash64(F.lit(1), text)


def align_texts(docs: DataFrame, a_path: str, b_path: str, *, text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(aligned, pairs). aligned: h1, h2, copies, n_a, n_b, n_groups, n_links, groups_sha256, links (packed) of each
    distinct text that is not empty. pairs: a, b, n, best: the count of each id pair, and if it is its B id's highest."""
    texts = docs.where(F.col(text) != "").groupBy(F.col(text).alias("text")).agg(F.count(F.lit(1)).alias("copies"))
    h1, h2 = text_key(F.col("text"))
    named = texts.select(h1.alias("h1"), h2.alias("h2"), "copies", F.concat(F.lit(" "), F.col("text")).alias("text"))
    aligned = flat.written(flat.mapped(
        named, _aligned(a_path, b_path),
        "h1 bigint, h2 bigint, copies bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string, links binary",
    ))
    model = aligner(a_path, b_path)
    counted = flat.mapped(aligned.select("copies", "links"), _counted(model.code, model.n_b), "a bigint, b bigint, n bigint")
    sums = flat.written(counted.groupBy("a", "b").agg(F.sum("n").alias("n")))
    highest = sums.groupBy("b").agg(F.max("n").alias("highest"))
    pairs = sums.join(highest, "b").select("a", "b", "n", (F.col("n") == F.col("highest")).alias("best"))
    return aligned, pairs


def measures_of(aligned: DataFrame, pairs: DataFrame, a_path: str, b_path: str, sent_pairs: int = SENT_PAIRS) -> DataFrame:
    """h1, h2, n_best, count_sum of each aligned text: its links against the counts of the corpus."""
    model = aligner(a_path, b_path)
    links = aligned.select("h1", "h2", "links")
    if pairs.limit(sent_pairs + 1).count() <= sent_pairs:
        table = pairs.toArrow()
        a, b, n, best = (table.column(c).to_numpy() for c in ("a", "b", "n", "best"))
        code = (a * model.n_b + b).astype(model.code)
        order = np.argsort(code)
        sent = aligned.sparkSession.sparkContext.broadcast((code[order], n[order], best[order].astype(bool)))
        return flat.mapped(links, _scored(sent, model.code), "h1 bigint, h2 bigint, n_best bigint, count_sum bigint")
    once = flat.mapped(links, _once(model.code, model.n_b), "h1 bigint, h2 bigint, a bigint, b bigint, times bigint")
    return once.join(pairs, ["a", "b"]).groupBy("h1", "h2").agg(
        F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("times") * F.col("n")).alias("count_sum"),
    )


def align(docs: DataFrame, a_path: str, b_path: str, *, text: str = "text", out: str = "alignment", sent_pairs: int = SENT_PAIRS) -> DataFrame:
    """All rows and columns of docs, and a struct column: n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    A column of docs that is named like `out` is replaced; the text is another.
    """
    docs = docs.drop(out)
    aligned, pairs = align_texts(docs, a_path, b_path, text=text)
    scores = measures_of(aligned, pairs, a_path, b_path, sent_pairs)
    whole = aligned.select("h1", "h2", "n_a", "n_b", "n_groups", "n_links", "groups_sha256").join(scores, ["h1", "h2"], "left")
    found = F.struct(*(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in MEASURES), F.coalesce("groups_sha256", F.lit("")).alias("groups_sha256"))
    h1, h2 = text_key(F.col(f"`{text}`"))
    rows = docs.select(F.struct("*").alias("row"), h1.alias("h1"), h2.alias("h2"))
    return rows.join(whole, ["h1", "h2"], "left").select("row.*", found.alias(out))
