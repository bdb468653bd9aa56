"""Periodic runs of words: stretches that repeat one passage three times or more.

A run is a stretch of consecutive words with smallest period q (words q apart are identical) of at least
`max(least, 3 q)` words that no neighbouring word extends keeping period q.

1. Harmonic grid: for each period p the positions 0, g, 2 g, ... are looked at, where g is half of the equal
   words that a run of that period must show, so every run holds a grid position from which at least another g
   words (less one) agree with those p later. The first few of them are compared; nearly all positions end here.
2. How far the words agree from there, ahead and back, is asked of a structure for longest common extensions:
   only suffixes that begin at positions of a difference cover modulo 31 are sorted (by words up to 31, then by
   doubled ranks). Any two positions are at most 30 words before two that both lie in the cover, so a query
   compares these few words, and a range minimum (sparse table) over the common prefixes of neighbours in
   sorted order gives the rest. Texts without a position left from step 1 have no run and are not sorted.
3. Stretches found for several periods keep the smallest: a longer one that spans three times is its multiple.

The words of a slice of texts are one array of numbers, so all steps are numpy operations over many texts; a
text is never cut, and a longer one makes a slice alone. Time is n log n in the words of a text.

Rows are treated where they are read, without a shuffle. Null and empty texts have no words and no runs.
Repeated rows are treated alike, an empty table gives an empty result. Words are what stands between
blanks and \\t \\n \\v \\f \\r; other white space is part of words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chartline.llm import flat

LEAST = 24
TIMES = 3
SLICE_BYTES = 4 << 20
# Words compared at a grid position before its extension is asked for.
FEW = 8

# Every difference modulo MODULUS is one of two members of COVER.
MODULUS = 31
COVER = np.array([1, 5, 11, 24, 25, 27])
_IN_COVER = np.full(MODULUS, -1)
_IN_COVER[COVER] = np.arange(len(COVER))
# _AHEAD[i, j]: how far to go from residues i and j until both lie in the cover.
_STEPS = np.arange(MODULUS)
_BOTH = (_IN_COVER[(_STEPS[:, None, None] + _STEPS) % MODULUS] >= 0) & (_IN_COVER[(_STEPS[:, None] + _STEPS) % MODULUS] >= 0)
_AHEAD = _BOTH.argmax(2)

RUN = T.StructType([T.StructField("start", T.LongType()), T.StructField("length", T.LongType()), T.StructField("period", T.LongType())])
RESULT = T.StructType([
    T.StructField("n_words", T.LongType()), T.StructField("runs", T.ArrayType(RUN)), T.StructField("collapsed", T.StringType()),
])


class Extensions:
    """Longest common extensions between positions of one piece of a sequence of words.

    Words are numbers. Before the first piece, between pieces and after the last stands one number that occurs
    nowhere else, so that nothing common goes past it. `piece` numbers the piece of each position, ascending.
    """

    def __init__(self, words: np.ndarray, piece: np.ndarray):
        n = len(words)
        # a whole round of the cover, of unlike numbers, behind the end
        most = int(words.max(initial=0)) + 1
        self.words = np.concatenate([words, np.arange(most, most + 2 * MODULUS, dtype=words.dtype)])
        piece = np.concatenate([piece, np.full(2 * MODULUS, int(piece[-1]) + 1 if n else 0, piece.dtype)])
        length = len(self.words) - MODULUS
        at = (np.arange(0, length + MODULUS, MODULUS)[:, None] + COVER).ravel()
        self.at = at[at < length]
        self.piece = piece[self.at]
        self._sort()
        self._neighbours()

    def _refine(self, key: np.ndarray) -> None:
        """Divide the groups of suffixes that are still alike by a key of each of their members."""
        places, members = self.places, self.order[self.places]
        group = self.rank[members]
        by = np.lexsort((key, group))
        members, group, key = members[by], group[by], key[by]
        self.order[places] = members
        first = np.concatenate([[True], (group[1:] != group[:-1]) | (key[1:] != key[:-1])])
        self.rank[members] = places[np.maximum.accumulate(np.where(first, np.arange(len(first)), 0))]
        alone = first & np.concatenate([first[1:], [True]])
        self.places = places[~alone]

    def _sort(self) -> None:
        """order: the sampled suffixes in order; rank: the place of each; levels: the ranks by MODULUS << k words."""
        n = len(self.at)
        self.order = np.arange(n)
        first = np.concatenate([[True], self.piece[1:] != self.piece[:-1]])[:n]
        self.rank = np.maximum.accumulate(np.where(first, self.order, 0))
        self.places = self.order.copy()
        bits = max(1, int(self.words.max(initial=0)).bit_length())
        pack = max(1, 62 // bits)
        for at in range(0, MODULUS, pack):
            if not len(self.places):
                break
            where = self.at[self.order[self.places]] + at
            key = np.zeros(len(where), np.int64)
            for k in range(min(pack, MODULUS - at)):
                key = key << bits | self.words[where + k]
            self._refine(key)
        self.levels = [self.rank.copy()]
        step = len(COVER)  # the sample that begins MODULUS words later is so many numbers on
        while len(self.places):
            self._refine(self.rank[self.order[self.places] + step])
            self.levels.append(self.rank.copy())
            step *= 2

    def _neighbours(self) -> None:
        """Sparse table of the least common prefix over ranges of neighbours in sorted order."""
        a, b = self.order[:-1].copy(), self.order[1:].copy()
        same_piece = self.piece[a] == self.piece[b]
        common = np.zeros(len(a), np.int64)
        for k in range(len(self.levels) - 1, -1, -1):
            alike = np.flatnonzero(self.levels[k][a] == self.levels[k][b])
            a[alike] += len(COVER) << k
            b[alike] += len(COVER) << k
            common[alike] += MODULUS << k
        left = np.flatnonzero(same_piece)
        one, other = self.at[a], self.at[b]
        for k in range(MODULUS):
            left = left[self.words[one[left] + k] == self.words[other[left] + k]]
            if not len(left):
                break
            common[left] += 1
        del self.levels
        table = [np.where(same_piece, common, 0).astype(np.int32)]
        while (width := 1 << len(table)) <= len(common):
            table.append(np.minimum(table[-1][: -(width >> 1)], table[-1][width >> 1 :]))
        self.table = table

    def ahead(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """How many words agree from each pair of unlike positions on."""
        go = _AHEAD[left % MODULUS, right % MODULUS]
        out = go.astype(np.int64)
        live = np.arange(len(left))
        for k in range(MODULUS):
            near = live[go[live] > k]
            if not len(near):
                break
            unlike = near[self.words[left[near] + k] != self.words[right[near] + k]]
            out[unlike] = k
            go[unlike] = -1
        live = np.flatnonzero(go >= 0)
        a, b = (self.rank[self._sample(x[live] + go[live])] for x in (left, right))
        low, high = np.minimum(a, b), np.maximum(a, b)
        level = np.frexp((high - low).astype(np.float64))[1] - 1
        for k in np.unique(level).tolist():
            some = np.flatnonzero(level == k)
            out[live[some]] += np.minimum(self.table[k][low[some]], self.table[k][high[some] - (1 << k)])
        return out

    @staticmethod
    def _sample(at: np.ndarray) -> np.ndarray:
        return at // MODULUS * len(COVER) + _IN_COVER[at % MODULUS]


def _grid(words: np.ndarray, piece: np.ndarray, sizes: np.ndarray, ends: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """(position, period) at which a run may be; pieces are laid out from the longest to the shortest."""
    found = []
    padded = np.concatenate([words, np.full(FEW, -1, words.dtype)])
    longest = int(sizes[0]) if len(sizes) else 0
    held = len(sizes)
    for p in range(1, longest // TIMES + 1):
        while held and sizes[held - 1] < max(least, TIMES * p):
            held -= 1
        if not held:
            break
        equal = max(least, TIMES * p) - p
        gap = (equal + 1) // 2
        until = int(ends[held - 1]) - p
        at = np.flatnonzero(words[0:until:gap] == words[p : until + p : gap]) * gap
        for k in range(1, min(FEW, equal - gap + 1)):
            if not len(at):
                break
            at = at[padded[at + k] == padded[at + (p + k)]]
        if len(at):
            at = at[piece[at] == piece[at + p]]
            found.append((at, np.full(len(at), p)))
    if not found:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    at, period = (np.concatenate(x) for x in zip(*found, strict=True))
    return at, period


def runs_of(words: np.ndarray, sizes: np.ndarray, least: int = LEAST) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, start, length, period) of all runs, by text, start and period.

    words: the words of all texts one after another, as numbers from 0; sizes: the words of each text.
    """
    nothing = (np.empty(0, np.int64),) * 4
    starts = np.cumsum(sizes) - sizes
    chosen = np.flatnonzero(sizes >= least)
    chosen = chosen[np.argsort(-sizes[chosen], kind="stable")]
    if not len(chosen):
        return nothing

    def laid(texts: np.ndarray):
        """Texts in this order with a number of its own before, between and after them."""
        size = sizes[texts]
        first = 1 + np.cumsum(size + 1) - (size + 1)
        line = np.empty(int(size.sum()) + len(size) + 1, np.int64)
        owner = np.repeat(np.arange(len(size) + 1), np.concatenate([[1], size + 1])) - 1
        owner[0] = 0
        marks = np.concatenate([[0], first + size])
        line[marks] = words.max() + 1 + np.arange(len(marks))
        line[flat.ranges(first, size)] = words[flat.ranges(starts[texts], size)]
        return line, owner, first, first + size

    line, owner, first, end = laid(chosen)
    at, period = _grid(line, owner, sizes[chosen], end, least)
    if not len(at):
        return nothing
    # Only texts with a position left are sorted.
    texts = np.unique(owner[at])
    old = first[owner[at]]
    number = np.searchsorted(texts, owner[at])
    line, owner, first, end = laid(chosen[texts])
    at = at - old + first[number]
    ahead = Extensions(line, owner).ahead(at, at + period)
    good = ahead >= (np.maximum(least, TIMES * period) - period + 1) // 2 - 1
    at, period, number, ahead = at[good], period[good], number[good], ahead[good]
    if not len(at):
        return nothing
    last = len(line) - 1
    back = Extensions(line[::-1], owner[::-1].max() - owner[::-1]).ahead(last - (at + period - 1), last - (at - 1))
    start, length = at - back - first[number], back + ahead + period
    good = length >= np.maximum(least, TIMES * period)
    runs = np.unique(np.stack([chosen[texts][number[good]], start[good], length[good], period[good]], 1), axis=0)
    # The same stretch with a longer period is a multiple of the shortest.
    new = np.concatenate([[True], (runs[1:, :3] != runs[:-1, :3]).any(1)])[: len(runs)]
    runs = runs[new]
    runs = runs[np.lexsort((runs[:, 3], runs[:, 1], runs[:, 0]))]
    return tuple(runs.T)


_BLANK = np.zeros(256, bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True


def _numbered(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(number of each word, words of each row, word starts, word ends); equal words have equal numbers."""
    blank = _BLANK[data]
    inside = np.zeros(len(data) + 2, bool)
    inside[1:-1] = ~blank
    border = np.zeros(len(data) + 1, bool)
    border[offsets] = True
    starts = np.flatnonzero(inside[1:-1] & (~inside[:-2] | border[:-1]))
    ends = np.flatnonzero(inside[1:-1] & (~inside[2:] | border[1:])) + 1
    sizes = np.diff(np.searchsorted(starts, offsets))
    packed = data[~blank]
    cuts = np.concatenate([[0], np.cumsum(ends - starts)]).astype(np.int64)
    array = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(cuts), pa.py_buffer(np.ascontiguousarray(packed))])
    numbers = array.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
    return numbers, sizes, starts, ends


def _joined(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, word borders) of the words, each with one space behind it."""
    lengths = ends - starts + 1
    out = np.full(int(lengths.sum()), 0x20, np.uint8)
    borders = np.concatenate([[0], np.cumsum(lengths)])
    out[flat.ranges(borders[:-1], lengths - 1)] = data[flat.ranges(starts, lengths - 1)]
    return out, borders


def _found(least: int, text: str, name: str):
    """Batches with a struct column of that name behind the others."""
    kind = pa.struct([
        ("n_words", pa.int64()), ("runs", pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))),
        ("collapsed", pa.string()),
    ])

    def part(data: np.ndarray, offsets: np.ndarray) -> pa.Array:
        n = len(offsets) - 1
        words, sizes, starts, ends = _numbered(data, offsets)
        before = np.concatenate([[0], np.cumsum(sizes)])
        of, start, length, period = runs_of(words, sizes, least)
        # a word goes if any run holds it behind its first period
        change = np.zeros(len(words) + 1, np.int64)
        np.add.at(change, before[of] + start + period, 1)
        np.add.at(change, before[of] + start + length, -1)
        kept = np.cumsum(change[:-1]) == 0
        n_kept = flat.per_row(kept, before)
        joined, borders = _joined(data, starts[kept], ends[kept])
        cuts = borders[np.concatenate([[0], np.cumsum(n_kept)])]
        raw = joined.tobytes()
        collapsed = [raw[a : b - 1].decode() if b > a else "" for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]
        lists = pa.ListArray.from_arrays(
            pa.array(np.searchsorted(of, np.arange(n + 1)), pa.int32()),
            pa.StructArray.from_arrays([pa.array(x, pa.int64()) for x in (start, length, period)], ["start", "length", "period"]),
        )
        return pa.StructArray.from_arrays([pa.array(sizes, pa.int64()), lists, pa.array(collapsed, pa.string())], fields=list(kind))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = flat.column_bytes(batch.column(batch.schema.get_field_index(text)))
            for a, b in flat.slices(offsets, SLICE_BYTES):
                rows = batch.slice(a, b - a)
                column = part(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                yield pa.RecordBatch.from_arrays([*rows.columns, column], schema=rows.schema.append(pa.field(name, kind)))

    return run


def find_runs(docs: DataFrame, *, text: str = "text", least: int = LEAST, out: str = "repeats") -> DataFrame:
    """All rows and columns of docs, and a struct column: n_words, runs (by start, then period), collapsed.

    collapsed is the words that stay, joined by one space: of each run its first period. A column of docs that
    is named like `out` is replaced; the text is another.
    """
    docs = docs.drop(out)
    inner = docs.select(F.struct("*").alias("row"), F.col(f"`{text}`").alias("text"))
    schema = T.StructType([*inner.schema.fields, T.StructField("found", RESULT)])
    done = flat.mapped(inner, _found(least, "text", "found"), schema)
    return done.select("row.*", F.col("found").alias(out))


def made_periodic(text: Column, key: Column) -> Column:
    """The text with a periodic tail, for one in ten keys; other texts as they are.

    Let h be the crc32 of the key in decimal and g = floor(h / 10). Where h % 10 = 0 and the text has n words, each
    word i from a = g % n on becomes word a + (i - a) % p, p = 1 + floor((n - a) / (3 + g % 8)).
    """
    words = F.filter(F.split(text, "[\\x20\\x09-\\x0D]+"), lambda w: w != "")
    h = F.crc32(key.cast("string").cast("binary"))
    g = F.floor(h / 10).cast("long")

    def tail(w: Column) -> Column:
        n = F.size(w).cast("long")
        a = g % n
        p = 1 + F.floor((n - a) / (3 + g % 8)).cast("long")
        at = F.sequence(F.lit(0).cast("long"), n - 1)
        return F.array_join(F.transform(at, lambda i: F.get(w, F.when(i < a, i).otherwise(a + (i - a) % p).cast("int"))), " ")

    changed = F.when(F.size(words) > 0, F.element_at(F.transform(F.array(words), tail), 1)).otherwise(text)
    return F.when((h % 10 == 0) & text.isNotNull(), changed).otherwise(text)


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    docs = docs.select("doc_id", made_periodic(F.col("text"), F.col("doc_id")).alias("text"))
    found = find_runs(docs).select("doc_id", "repeats.*")
    # of equal exponents the run of the smallest start, then period, which comes first
    nothing = F.lit(None).cast(RUN)
    best = F.aggregate("runs", nothing, lambda best, run: F.when(
        best.isNull() | (run["length"] * best["period"] > best["length"] * run["period"]), run).otherwise(best))
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    text = F.concat(F.array_join(lines, "\n"), F.when(F.size("runs") > 0, "\n").otherwise(""))
    return found.withColumn("best", best).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
        F.call_function("div", F.col("best.length") * 1000, F.col("best.period")).alias("exponent_milli"),
        F.sha2(text, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
