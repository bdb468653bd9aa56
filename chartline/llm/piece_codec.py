"""SentencePiece BPE encoding and decoding by vectorised merge rounds.

The model is read from its file with the sentencepiece library, which gives the pieces and their scores;
encoding and decoding are done here on flat numpy arrays. A slice of rows is cut into stretches that no
piece can span (before a space, and around characters that no piece holds). Equal stretches are encoded
once: they become one flat array of symbols, and each round finds the best pair rank of every stretch and
merges its leftmost pairs of that rank, all stretches at once, until no pair remains.

A round merges several places of one stretch only while that equals merging them one by one: it stops
after the first place whose merge makes a pair that is as good or better, which would come next.

Texts are never cut or shuffled; each row is encoded where it is read. Null encodes as the empty text,
which gives the begin and end ids alone. Equal texts give equal ids.

The model must be BPE with byte fallback, without normalisation, whose pieces hold the space sign only at
their front: others are refused.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from chartline.llm import flat

SPACE = "▁"
_SPACE_BYTES = SPACE.encode()
_NONE = np.int64(1 << 40)
SLICE_BYTES = 1 << 20
BLOCK_BYTES = 1 << 18
_BITS = 19


class Pieces:
    """Tables of a model: characters to symbols, symbol pairs to (rank, merged piece), pieces to bytes."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        self.begin, self.end, self.unknown, self.size = model.bos_id(), model.eos_id(), model.unk_id(), n
        text = [model.id_to_piece(k) for k in range(n)]
        plain = [k for k in range(n) if not (model.is_byte(k) or model.is_control(k) or model.is_unknown(k))]
        for sample in ("a  B\n", " Åﬁ "):
            if model.normalize(sample) != SPACE + sample.replace(" ", SPACE):
                raise ValueError(f"{path}: the model normalises its text")
        if any(SPACE in text[k].lstrip(SPACE) or (text[k][0] == SPACE) != (text[k].replace(SPACE, "") == "" or text[k].lstrip(SPACE) != text[k]) for k in plain):
            raise ValueError(f"{path}: a piece holds a space after another character")
        bytes_of = {int(text[k][1:-1], 16): k for k in range(n) if model.is_byte(k)}
        if len(bytes_of) != 256:
            raise ValueError(f"{path}: no byte fallback")
        self.byte_id = np.array([bytes_of[b] for b in range(256)], np.int64)
        symbol = {text[k]: k for k in plain}
        for k in plain:  # characters that stand in pieces only are symbols too, after the pieces
            for char in text[k]:
                symbol.setdefault(char, n + len(symbol))
        self.n_symbols = max(symbol.values()) + 1
        self.char = np.full(0x110000, -1, np.int64)
        for piece, k in symbol.items():
            if len(piece) == 1:
                self.char[ord(piece)] = k
        scores = sorted({model.get_score(k) for k in plain}, reverse=True)
        rank = {s: r for r, s in enumerate(scores)}
        pairs = {}
        for k in plain:
            for cut in range(1, len(text[k])):
                left, right = symbol.get(text[k][:cut]), symbol.get(text[k][cut:])
                if left is not None and right is not None:
                    pairs[left * self.n_symbols + right] = (rank[model.get_score(k)], k)
        self.tables = self._hashed(np.array(list(pairs), np.int64), np.array(list(pairs.values()), np.int64))
        held = set("".join(text[k] for k in plain)) - {SPACE}
        self.alone = np.array([b < 0x80 and b != 0x20 and chr(b) not in held for b in range(256)])
        raw = [b""] * n
        for k in plain:
            raw[k] = text[k].replace(SPACE, " ").encode()
        for b, k in bytes_of.items():
            raw[k] = bytes([b])
        raw[self.unknown] = " ⁇ ".encode()
        self.raw = np.frombuffer(b"".join(raw), np.uint8)
        self.raw_lengths = np.array([len(r) for r in raw], np.int64)
        self.raw_starts = np.cumsum(self.raw_lengths) - self.raw_lengths
        self.is_byte = np.zeros(n, bool)
        self.is_byte[self.byte_id] = True

    @staticmethod
    def _place(keys: np.ndarray, level: int) -> np.ndarray:
        return ((keys.astype(np.uint64) * flat.mix(np.array([level + 1], np.uint64))[0] | np.uint64(1)) >> np.uint64(64 - _BITS)).astype(np.int64)

    @classmethod
    def _hashed(cls, keys: np.ndarray, values: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """Tables of one key for each place; keys whose place is taken go to the next table."""
        tables = []
        while len(keys):
            place = cls._place(keys, len(tables))
            _, chosen = np.unique(place, return_index=True)
            held, kept = np.full(1 << _BITS, -1, np.int64), np.zeros((1 << _BITS, 2), np.int64)
            held[place[chosen]], kept[place[chosen]] = keys[chosen], values[chosen]
            tables.append((held, kept))
            rest = np.ones(len(keys), bool)
            rest[chosen] = False
            keys, values = keys[rest], values[rest]
        return tables

    def pair(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rank, merged piece) of symbol pairs; the rank of a pair that makes no piece is _NONE."""
        rank, made = np.full(len(left), _NONE), np.zeros(len(left), np.int64)
        open_ = np.flatnonzero((left >= 0) & (right >= 0))
        key = left[open_] * self.n_symbols + right[open_]
        for level, (held, kept) in enumerate(self.tables):
            place = self._place(key, level)
            hit = held[place] == key
            rank[open_[hit]], made[open_[hit]] = kept[place[hit]].T
            taken = ~hit & (held[place] >= 0)  # where the place is empty, no later table holds the key
            open_, key = open_[taken], key[taken]
            if not len(open_):
                break
        return rank, made


@lru_cache(maxsize=4)
def pieces(path: str) -> Pieces:
    return Pieces(path)


def _merge_round(p: Pieces, symbol: np.ndarray, group: np.ndarray, rank: np.ndarray, made: np.ndarray):
    """Merge the leftmost best pairs of every group; rank[i] is that of the pair (i, i + 1)."""
    firsts = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
    best = np.minimum.reduceat(rank, firsts)
    best_here = np.repeat(best, np.diff(np.append(firsts, len(symbol))))
    at = np.flatnonzero((rank == best_here) & (rank < _NONE))
    # Of pairs that share a symbol, take every second one from the left.
    chain = np.concatenate([[True], np.diff(at) != 1])
    start = at[np.flatnonzero(chain)][np.cumsum(chain) - 1]
    at = at[(at - start) % 2 == 0]
    several = np.concatenate([group[at[1:]] == group[at[:-1]], [False]])
    if several.any():
        after = np.minimum(at + 2, len(symbol) - 1)
        right, _ = p.pair(made[at], symbol[after])
        right = np.where((at + 2 < len(symbol)) & (group[after] == group[at]), right, _NONE)
        touch = np.concatenate([[False], at[1:] == at[:-1] + 2])
        before = np.maximum(at - 1, 0)
        previous = np.where(touch, np.concatenate([[0], made[at[:-1]]]), symbol[before])
        left, _ = p.pair(previous, made[at])
        left = np.where((at > 0) & (group[before] == group[at]), left, _NONE)
        stop = (left <= rank[at]) | (right <= rank[at])
        stopped = np.cumsum(stop) - stop  # stops before each place
        place_first = np.concatenate([[True], group[at[1:]] != group[at[:-1]]])
        base = stopped[np.flatnonzero(place_first)][np.cumsum(place_first) - 1]
        at = at[stopped == base]
    symbol[at] = made[at]
    keep = np.ones(len(symbol), bool)
    keep[at + 1] = False
    new_at = np.cumsum(keep)[at] - 1
    symbol, group, rank, made = symbol[keep], group[keep], rank[keep], made[keep]
    changed = np.zeros(len(symbol), bool)
    changed[new_at] = changed[np.maximum(new_at - 1, 0)] = True
    touched = np.flatnonzero(changed)
    after = np.minimum(touched + 1, len(symbol) - 1)
    r, m = p.pair(symbol[touched], symbol[after])
    rank[touched] = np.where((touched + 1 < len(symbol)) & (group[after] == group[touched]), r, _NONE)
    made[touched] = m
    return symbol, group, rank, made


def _encode_stretches(p: Pieces, text: str, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(ids, ids in each stretch) of stretches of the given numbers of characters."""
    points = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.int64)
    symbol = p.char[points]
    symbol[points == 0x20] = p.char[ord(SPACE)]
    other = symbol < 0
    group = np.repeat(np.arange(len(lengths)), lengths)
    position = np.arange(len(points))
    rank, made = np.full(len(points), _NONE), np.zeros(len(points), np.int64)
    if len(points) > 1:
        r, made[:-1] = p.pair(symbol[:-1], symbol[1:])
        rank[:-1] = np.where(group[1:] == group[:-1], r, _NONE)
    marked = np.where(other, -2 - position, symbol)  # characters without a piece keep their place
    done: list[tuple[np.ndarray, np.ndarray]] = []
    symbol = marked
    while len(symbol):
        # Compaction: groups without a pair are finished and leave.
        firsts = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
        counts = np.diff(np.append(firsts, len(symbol)))
        going = np.repeat(np.minimum.reduceat(rank, firsts) < _NONE, counts)
        if not going.all():
            done.append((symbol[~going], group[~going]))
            symbol, group, rank, made = symbol[going], group[going], rank[going], made[going]
            if not len(symbol):
                break
        symbol, group, rank, made = _merge_round(p, symbol, group, rank, made)
    if not done:
        return np.empty(0, np.int64), np.zeros(len(lengths), np.int64)
    symbol, group = (np.concatenate(x) for x in zip(*done, strict=True))
    order = np.argsort(group, kind="stable")
    symbol, group = symbol[order], group[order]
    # A symbol that is no piece becomes the bytes of its character.
    loose = np.flatnonzero((symbol < 0) | (symbol >= p.size))
    if len(loose):
        back = {int(p.char[c]): c for c in np.flatnonzero(p.char >= p.size).tolist()}
        chars = [chr(points[-2 - s]) if s < 0 else chr(back[s]) for s in symbol[loose].tolist()]
        raw = [c.encode() for c in chars]
        count = np.ones(len(symbol), np.int64)
        count[loose] = [len(r) for r in raw]
        group, out = np.repeat(group, count), np.repeat(symbol, count)
        starts = np.cumsum(count) - count
        out[flat.ranges(starts[loose], count[loose])] = p.byte_id[np.frombuffer(b"".join(raw), np.uint8)]
        symbol = out
    return symbol, np.bincount(group, minlength=len(lengths))


def encode_rows(p: Pieces, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all rows with begin and end ids, row offsets into them)."""
    n = len(offsets) - 1
    raw = data.tobytes()
    if _SPACE_BYTES in raw:  # the space sign itself encodes as a space
        rows = [raw[offsets[k] : offsets[k + 1]].replace(_SPACE_BYTES, b" ") for k in range(n)]
        data = np.frombuffer(b"".join(rows), np.uint8)
        offsets = np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int64)
    full = np.diff(offsets) > 0
    text = np.insert(data, offsets[:-1][full], 0x20)
    offsets = offsets + np.concatenate([[0], np.cumsum(full)])
    if not len(text):
        return np.tile(np.array([p.begin, p.end]), n), np.arange(n + 1) * 2
    space = text == 0x20
    alone = p.alone[text]
    cut = np.empty(len(text) + 1, bool)
    cut[0] = cut[-1] = True
    cut[1:-1] = (space[1:] & ~space[:-1]) | alone[1:] | alone[:-1]
    cut[offsets] = True
    edges = np.flatnonzero(cut)
    starts, ends = edges[:-1], edges[1:]
    hashes = flat.span_hash(text, starts, ends)
    _, first, which = np.unique(hashes, return_index=True, return_inverse=True)
    lengths = (ends - starts)
    own = flat.ranges(starts, lengths)
    theirs = flat.ranges(starts[first][which], lengths) if (lengths == lengths[first][which]).all() else None
    if theirs is None or not np.array_equal(text[own], text[theirs]):  # two texts of one hash: tell all apart
        first, which = np.arange(len(starts)), np.arange(len(starts))
    some = text[flat.ranges(starts[first], lengths[first])]
    chars = flat.per_row((some & 0xC0) != 0x80, np.concatenate([[0], np.cumsum(lengths[first])]))
    # In blocks that fit a processor's cache.
    blocks, raw, byte_at = [], some.tobytes(), np.concatenate([[0], np.cumsum(lengths[first])])
    for a, b in flat.slices(byte_at, BLOCK_BYTES):
        blocks.append(_encode_stretches(p, raw[byte_at[a] : byte_at[b]].decode(), chars[a:b]))
    ids, count = (np.concatenate(x) for x in zip(*blocks, strict=True))
    begin = np.cumsum(count) - count
    body = ids[flat.ranges(begin[which], count[which])]
    before = np.concatenate([[0], np.cumsum(count[which])])
    row_at = before[np.searchsorted(edges, offsets)]
    out = np.insert(body, np.stack([row_at[:-1], row_at[1:]], 1).ravel(), np.tile(np.array([p.begin, p.end]), n))
    return out, row_at + 2 * np.arange(n + 1)


def decode_rows(p: Pieces, ids: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(UTF-8 bytes of all rows, row offsets): pieces joined, space signs to spaces, the space put in front taken off.

    Bytes that are no valid UTF-8 become replacement characters, one for each.
    """
    lengths = p.raw_lengths[ids]
    text = p.raw[flat.ranges(p.raw_starts[ids], lengths)]
    before = np.concatenate([[0], np.cumsum(lengths)])
    edges = before[offsets]
    # The front space of each row: the first byte, where the first id that writes something is a piece with it.
    keep = np.ones(len(text), bool)
    some = np.flatnonzero(np.diff(edges) > 0)
    front = edges[:-1][some]
    first_id = ids[np.searchsorted(before, front, "right") - 1]
    keep[front[(text[front] == 0x20) & ~p.is_byte[first_id]]] = False
    edges = np.concatenate([[0], np.cumsum(keep)])[edges]
    text = text[keep]
    try:
        text.tobytes().decode()
        broken = np.concatenate([text, [0]])[edges[:-1]] & 0xC0 == 0x80
        if not (broken & (np.diff(edges) > 0)).any():
            return text, edges
    except UnicodeDecodeError:
        pass
    rows = [_repaired(text[a:b].tobytes()) for a, b in zip(edges[:-1], edges[1:], strict=True)]
    return np.frombuffer(b"".join(rows), np.uint8), np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int64)


def _repaired(raw: bytes) -> bytes:
    out, at = [], 0
    while at < len(raw):
        try:
            out.append(raw[at:].decode().encode())
            break
        except UnicodeDecodeError as error:
            out.append(raw[at : at + error.start] + b"\xef\xbf\xbd")
            at += error.start + 1
    return b"".join(out)


def encode(docs: DataFrame, model: str, *, text: str = "text", out: str = "ids") -> DataFrame:
    """All rows and columns of docs, and the ids of the text (array of int) with begin and end ids.

    model is a path that every executor can read. A column of docs named like `out` is replaced.
    """
    docs = docs.drop(out)
    schema = T.StructType([*docs.schema.fields, T.StructField(out, T.ArrayType(T.IntegerType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, offsets in _slices(batches, text):
            ids, bounds = encode_rows(pieces(model), data, offsets)
            lists = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(ids, pa.int32()))
            yield pa.RecordBatch.from_arrays([*part.columns, lists], names=[*part.schema.names, out])

    return flat.mapped(docs, run, schema)


def decode(rows: DataFrame, model: str, *, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """All rows and columns, and the text that an array of ids stands for; null ids give the empty text."""
    rows = rows.drop(out)
    schema = T.StructType([*rows.schema.fields, T.StructField(out, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index(ids)
            lists = batch.column(at)
            counts = np.array([0 if v is None else v for v in lists.value_lengths().to_pylist()], np.int64)
            values = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            offsets = np.concatenate([[0], np.cumsum(counts)])
            for a, b in flat.slices(offsets, SLICE_BYTES // 4):
                text, edges = decode_rows(pieces(model), values[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                part = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([*part.columns, _texts(text, edges)], names=[*part.schema.names, out])

    return flat.mapped(rows, run, schema)


def recode(docs: DataFrame, model: str, *, text: str = "text", ids: str = "ids", out: str = "decoded") -> DataFrame:
    """encode() and decode() in one pass, so that a task needs one Python worker: all rows and columns, ids, decoded."""
    docs = docs.drop(ids, out)
    schema = T.StructType([*docs.schema.fields, T.StructField(ids, T.ArrayType(T.IntegerType())), T.StructField(out, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, offsets in _slices(batches, text):
            p = pieces(model)
            found, bounds = encode_rows(p, data, offsets)
            back, edges = decode_rows(p, found, bounds)
            lists = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(found, pa.int32()))
            yield pa.RecordBatch.from_arrays([*part.columns, lists, _texts(back, edges)], names=schema.names)

    return flat.mapped(docs, run, schema)


def _texts(raw: np.ndarray, edges: np.ndarray) -> pa.Array:
    buffers = pa.py_buffer(edges.astype(np.int64).tobytes()), pa.py_buffer(raw.tobytes())
    return pa.LargeStringArray.from_buffers(len(edges) - 1, *buffers).cast(pa.string())


def digests(docs: DataFrame, model: str, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every row: encoded, then decoded from those ids."""
    from hashlib import sha256

    schema = T.StructType([
        T.StructField("doc_id", docs.schema[doc_id].dataType), T.StructField("n_tokens", T.LongType()),
        T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType()),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, offsets in _slices(batches, text):
            p = pieces(model)
            ids, bounds = encode_rows(p, data, offsets)
            written, edges = decode_rows(p, ids, bounds)
            raw, back = ids.astype("<u4").tobytes(), written.tobytes()
            spans, cuts = (bounds * 4).tolist(), edges.tolist()
            n = len(spans) - 1
            yield pa.RecordBatch.from_arrays([
                part.column(0), pa.array(np.diff(bounds), pa.int64()),
                pa.array([sha256(raw[spans[k] : spans[k + 1]]).hexdigest() for k in range(n)], pa.string()),
                pa.array([sha256(back[cuts[k] : cuts[k + 1]]).hexdigest() for k in range(n)], pa.string()),
            ], names=schema.names)

    return flat.mapped(docs.select(doc_id, text), run, schema)


def _slices(batches: Iterator[pa.RecordBatch], text: str):
    """(rows, their text bytes, offsets) in slices of bounded size."""
    for batch in batches:
        data, offsets = flat.column_bytes(batch.column(batch.schema.get_field_index(text)))
        for a, b in flat.slices(offsets, SLICE_BYTES):
            yield batch.slice(a, b - a), data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
