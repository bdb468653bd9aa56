"""Benchmark decontamination with an FM-index per training shard.

A task takes its rows in shards of a few MB. Words that no test phrase holds cannot be part of a match,
so a shard keeps only the runs of phrase words that are long enough for the shortest phrase; each run ends
with a separator. Over these runs it builds an FM-index: suffix order, Burrows-Wheeler transform, a wavelet
tree for ranks, and suffix positions sampled at every eighth place and at each start of a run. All phrases
are searched backwards at once. Their occurrences are located by stepping to a sampled position, and the
words they cover are merged into spans to remove. Words are told apart by 64-bit hash; every word of the
runs is then compared byte by byte, so the result is exact.

Nothing is shuffled. The phrases are kept in blocks of at most BLOCK_WORDS words of test items, files that all
executors share. A batch of rows meets the blocks one after another, in one pass of one worker that holds a single
block at a time, so what a task holds is bounded for any benchmark, and so is what the driver holds while it makes them.

Null or empty text has no words and is clean. Equal rows get equal results. Items without words match
nothing; an item id that is null cannot be named, so its phrases count as hits only.
"""

from __future__ import annotations

import pickle
import uuid
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chartline.llm import flat

WINDOW = 10
BLOCK_WORDS = 1_000_000
SAMPLE = 8

RESULT = T.StructType([
    T.StructField("n_words", T.LongType()),
    T.StructField("n_hit", T.LongType()),
    T.StructField("items", T.ArrayType(T.StringType())),
    T.StructField("spans", T.ArrayType(T.StructType([
        T.StructField("start", T.LongType()), T.StructField("end", T.LongType()),
    ]))),
])
_SPAN = pa.struct([("start", pa.int64()), ("end", pa.int64())])
_RESULT = pa.struct([
    ("n_words", pa.int64()), ("n_hit", pa.int64()), ("items", pa.list_(pa.string())), ("spans", pa.list_(_SPAN)),
])


class Phrases:
    """The distinct windows of a block of test items, as numbers of distinct words."""

    def __init__(self, ids: list[str | None], texts: list[str], window: int):
        column = pa.array(texts, pa.string())
        low, starts, ends, before = flat.words(*flat.column_bytes(column))
        hashes = flat.span_hash(low, starts, ends)
        self.hashes, first, number = np.unique(hashes, return_index=True, return_inverse=True)
        lengths = (ends - starts)[first]
        self.bytes = low[flat.ranges(starts[first], lengths)]
        self.offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)
        self.seen = np.zeros(1 << 16, bool)
        self.seen[(self.hashes & np.uint64(0xFFFF)).astype(np.int64)] = True
        found: dict[tuple[int, ...], set[str]] = {}
        for k, name in enumerate(ids):
            item = number[before[k] : before[k + 1]]
            width = min(window, len(item))
            for at in range(len(item) - width + 1 if width else 0):
                found.setdefault(tuple(item[at : at + width]), set()).update([] if name is None else [name])
        keys = list(found)
        self.lengths = np.array([len(k) for k in keys], np.int64)
        self.words = np.full((len(keys), window), -1, np.int64)
        for k, key in enumerate(keys):
            self.words[k, : len(key)] = key
        self.items = [sorted(found[k]) for k in keys]
        self.shortest = int(self.lengths.min()) if keys else 0


class WaveletTree:
    """Ranks of symbols, kept as one bit row for each binary digit, most significant first."""

    def __init__(self, symbols: np.ndarray, n_symbols: int):
        self.digits = max(1, int(n_symbols - 1).bit_length())
        self.ones, self.zeros = [], []
        for digit in range(self.digits - 1, -1, -1):
            bit = (symbols >> digit) & 1
            ones = np.zeros(len(symbols) + 1, np.int64)
            np.cumsum(bit, out=ones[1:])
            self.ones.append(ones)
            self.zeros.append(len(symbols) - int(ones[-1]))
            symbols = np.concatenate([symbols[bit == 0], symbols[bit == 1]])
        every = np.arange(n_symbols)
        self.begin = self._walk(every, np.zeros(n_symbols, np.int64))

    def _walk(self, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
        for level in range(self.digits):
            ones = self.ones[level][at]
            bit = (symbols >> (self.digits - 1 - level)) & 1
            at = np.where(bit == 1, self.zeros[level] + ones, at - ones)
        return at

    def rank(self, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol stands before its place."""
        return self._walk(symbols, at) - self.begin[symbols]


class FMIndex:
    """Full-text index of symbols above 0; each run of them ends with 0, and so does the whole."""

    def __init__(self, text: np.ndarray, n_symbols: int):
        n = len(text)
        order = self._suffixes(text)
        self.bwt = text[order - 1]
        self.before = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=n_symbols))])
        self.tree = WaveletTree(self.bwt, n_symbols)
        kept = (order % SAMPLE == 0) | (self.bwt == 0)
        self.kept_before = np.concatenate([[0], np.cumsum(kept)])
        self.kept, self.sampled, self.size = kept, order[kept], n

    @staticmethod
    def _suffixes(text: np.ndarray) -> np.ndarray:
        """Suffix order by doubling; separators are told apart by place, so all suffixes differ."""
        n = len(text)
        breaks = text == 0
        rank = np.where(breaks, np.cumsum(breaks) - 1, text + int(breaks.sum())).astype(np.int64)
        step = 1
        while True:
            after = np.zeros(n, np.int64)
            after[: n - step] = rank[step:] + 1
            key = rank * (int(rank.max()) + 2) + after if step < n else rank
            order = np.argsort(key, kind="stable")
            fresh = np.concatenate([[0], np.cumsum(np.diff(key[order]) != 0)])
            rank = np.empty(n, np.int64)
            rank[order] = fresh
            if fresh[-1] == n - 1:
                return order
            step *= 2

    def search(self, words: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(phrase, first row, end row) of the phrases that occur; words are symbols, -1 never occurs."""
        live = np.flatnonzero((lengths > 0) & ~((words < 0) & (np.arange(words.shape[1]) < lengths[:, None])).any(1))
        low, high = np.zeros(len(live), np.int64), np.full(len(live), self.size, np.int64)
        for back in range(1, words.shape[1] + 1):
            going = lengths[live] >= back
            c = words[live[going], lengths[live[going]] - back]
            low[going] = self.before[c] + self.tree.rank(c, low[going])
            high[going] = self.before[c] + self.tree.rank(c, high[going])
            some = low < high
            live, low, high = live[some], low[some], high[some]
        return live, low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of index rows."""
        at, steps, out = rows.copy(), np.zeros(len(rows), np.int64), np.empty(len(rows), np.int64)
        open_ = np.arange(len(rows))
        while len(open_):
            here = at[open_]
            done = self.kept[here]
            out[open_[done]] = self.sampled[self.kept_before[here[done]]] + steps[open_[done]]
            open_ = open_[~done]
            c = self.bwt[at[open_]]
            at[open_] = self.before[c] + self.tree.rank(c, at[open_])
            steps[open_] += 1
        return out


def _numbers(phrases: Phrases, low: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The number of each word among the phrase words, -1 for others; by hash."""
    hashes = flat.span_hash(low, starts, ends)
    out = np.full(len(hashes), -1, np.int64)
    maybe = np.flatnonzero(phrases.seen[(hashes & np.uint64(0xFFFF)).astype(np.int64)])
    at = np.minimum(np.searchsorted(phrases.hashes, hashes[maybe]), len(phrases.hashes) - 1)
    same = phrases.hashes[at] == hashes[maybe]
    out[maybe[same]] = at[same]
    return out


def _long_runs(number: np.ndarray, row_of: np.ndarray, shortest: int) -> np.ndarray:
    """Places of words in runs of phrase words of one row that are at least as long as the shortest phrase."""
    known = np.flatnonzero(number >= 0)
    if not len(known):
        return known
    new = np.concatenate([[True], (np.diff(known) != 1) | (np.diff(row_of[known]) != 0)])
    run = np.cumsum(new) - 1
    return known[np.bincount(run)[run] >= shortest]


def _truly(phrases: Phrases, number: np.ndarray, places: np.ndarray, low: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Unset the numbers of words whose bytes differ from the phrase word of equal hash."""
    lengths = ends[places] - starts[places]
    theirs = np.diff(phrases.offsets)[number[places]]
    number[places[lengths != theirs]] = -1
    places = places[lengths == theirs]
    lengths = ends[places] - starts[places]
    same = low[flat.ranges(starts[places], lengths)] == phrases.bytes[flat.ranges(phrases.offsets[number[places]], lengths)]
    if not same.all():
        wrong = flat.per_row(~same, np.concatenate([[0], np.cumsum(lengths)])) > 0
        number[places[wrong]] = -1
    return number


def _shard(phrases: Phrases, data: np.ndarray, offsets: np.ndarray) -> list[tuple]:
    """(n_words, hit flags summed, items, spans) of each row of a shard."""
    n = len(offsets) - 1
    low, starts, ends, before = flat.words(data, offsets)
    n_words = np.diff(before)
    items: list[set] = [set() for _ in range(n)]
    spans: list[list] = [[] for _ in range(n)]
    hit = np.zeros(len(starts) + 1, np.int64)
    if len(starts) and len(phrases.lengths):
        row_of = np.repeat(np.arange(n), n_words)
        number = _numbers(phrases, low, starts, ends)
        number = _truly(phrases, number, _long_runs(number, row_of, phrases.shortest), low, starts, ends)
        places = _long_runs(number, row_of, phrases.shortest)
        if len(places):
            new = np.concatenate([(np.diff(places) != 1) | (np.diff(row_of[places]) != 0), [True]])
            known, symbols = np.unique(number[places], return_inverse=True)
            ends_at = np.flatnonzero(new) + 1
            text = np.insert(symbols + 1, ends_at, 0)
            place_of = np.insert(places, ends_at, -1)
            to_symbol = np.full(len(phrases.hashes) + 1, -1, np.int64)
            to_symbol[known] = np.arange(1, len(known) + 1)
            index = FMIndex(text.astype(np.int64), len(known) + 1)
            which, first, last = index.search(to_symbol[phrases.words], phrases.lengths)
            count = last - first
            phrase = np.repeat(which, count)
            word = place_of[index.locate(flat.ranges(first, count))]
            np.add.at(hit, word, 1)
            np.add.at(hit, word + phrases.lengths[phrase], -1)
            for row, p in np.unique(np.stack([row_of[word], phrase], 1), axis=0).tolist():
                items[row].update(phrases.items[p])
    covered = np.cumsum(hit[:-1]) > 0
    n_hit = flat.per_row(covered, before)
    for row in np.flatnonzero(n_hit).tolist():
        inside = np.flatnonzero(covered[before[row] : before[row + 1]]) + before[row]
        new = np.flatnonzero(np.diff(inside) != 1) + 1
        firsts, lasts = inside[np.concatenate([[0], new])], inside[np.concatenate([new - 1, [len(inside) - 1]])]
        text = data[offsets[row] : offsets[row + 1]]
        points = np.concatenate([[0], np.cumsum((text & 0xC0) != 0x80)])
        for a, b in zip(starts[firsts] - offsets[row], ends[lasts] - offsets[row], strict=True):
            spans[row].append((int(points[a]), int(points[b])))
    return [(int(n_words[k]), int(n_hit[k]), items[k], spans[k]) for k in range(n)]


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans in order, with those that touch or overlap joined."""
    out: list[tuple[int, int]] = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((start, end))
    return out


def _blocks(benchmark: DataFrame, item_id: str, text: str, window: int, block_words: int) -> Iterator[Phrases]:
    """The test items in blocks; the driver holds one block at a time."""
    ids, texts, size = [], [], 0
    chosen = benchmark.select(F.col(f"`{item_id}`").cast("string"), F.coalesce(F.col(f"`{text}`"), F.lit("")))
    for name, content in chosen.toLocalIterator():
        ids.append(name)
        texts.append(content)
        size += 1 + len(content) // 4
        if size >= block_words:
            yield Phrases(ids, texts, window)
            ids, texts, size = [], [], 0
    if ids:
        yield Phrases(ids, texts, window)


def find_leaks(
    docs: DataFrame, benchmark: DataFrame, *, text: str = "text", item_id: str = "item_id", item_text: str = "text",
    window: int = WINDOW, block_words: int = BLOCK_WORDS, out: str = "leak",
) -> DataFrame:
    """All rows and columns of docs, and a struct column: n_words, n_hit, items, spans (code points, to remove).

    A column of docs that is named like `out` is replaced.
    """
    spark = docs.sparkSession
    docs = docs.drop(out)
    empty = F.struct(
        F.lit(0).cast("long").alias("n_words"), F.lit(0).cast("long").alias("n_hit"),
        F.array().cast("array<string>").alias("items"), F.array().cast(RESULT["spans"].dataType).alias("spans"),
    )
    schema = T.StructType([*docs.schema.fields, T.StructField(out, RESULT)])
    folder, names = _kept(spark, _blocks(benchmark, item_id, item_text, window, block_words), window)
    return flat.mapped(docs.withColumn(out, empty.cast(RESULT)), _search(folder, names, text, out), schema)


def _kept(spark, blocks: Iterator[Phrases], window: int) -> tuple[str, list[str]]:
    """The blocks as files of a new folder that all executors share; there is always one."""
    flat.durable(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/phrases-{uuid.uuid4()}"
    system, root = flat.opened(folder)
    system.create_dir(root, recursive=True)
    names: list[str] = []
    for phrases in chain(blocks, [None]):
        if phrases is None and names:
            break
        names.append(f"{len(names):06d}")
        with system.open_output_stream(f"{root}/{names[-1]}") as file:
            file.write(pickle.dumps(phrases or Phrases([], [], window)))
    return folder, names


@lru_cache(maxsize=1)
def _block(folder: str, name: str) -> Phrases:
    system, root = flat.opened(folder)
    with system.open_input_file(f"{root}/{name}") as file:
        return pickle.loads(file.read())


def _search(folder: str, names: list[str], text: str, out: str):
    """Each batch meets the blocks one after another; a worker holds one of them at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = flat.column_bytes(batch.column(batch.schema.get_field_index(text)))
            at = batch.schema.get_field_index(out)
            found = batch.column(at).to_pylist()
            for name in names:
                found = _with_block(_block(folder, name), data, offsets, found)
            columns = [*batch.columns]
            columns[at] = pa.array(found, _RESULT)
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    return run


def _with_block(phrases: Phrases, data: np.ndarray, offsets: np.ndarray, old: list[dict]) -> list[dict]:
    """What was found in each row, and what this block finds."""
    new: list[dict] = []
    for a, b in flat.slices(offsets):
        part = _shard(phrases, data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
        for was, (n_words, n_hit, items, spans) in zip(old[a:b], part, strict=True):
            if was["n_hit"] and spans:
                spans = merged([(s["start"], s["end"]) for s in was["spans"]] + spans)
                n_hit = _words_in(data[offsets[len(new)] : offsets[len(new) + 1]], spans)
            elif was["n_hit"]:
                spans, n_hit = [(s["start"], s["end"]) for s in was["spans"]], was["n_hit"]
            new.append({
                "n_words": n_words, "n_hit": n_hit, "items": sorted(items.union(was["items"])),
                "spans": [{"start": s, "end": e} for s, e in spans],
            })
    return new


def _words_in(data: np.ndarray, spans: list[tuple[int, int]]) -> int:
    """How many words of a text stand inside spans of code points."""
    _, starts, _, _ = flat.words(data, np.array([0, len(data)]))
    point = np.cumsum((data & 0xC0) != 0x80) - 1
    at = point[starts]
    lows, highs = np.array([s for s, _ in spans]), np.array([e for _, e in spans])
    k = np.searchsorted(lows, at, "right") - 1
    return int(((k >= 0) & (at < highs[np.maximum(k, 0)])).sum())


def without_spans(text: str, spans: str):
    """Column: the text with spans of code points cut out."""
    column = F.col(text)
    cuts = F.concat(F.array(F.struct(F.lit(0).cast("long").alias("start"), F.lit(0).cast("long").alias("end"))), F.col(spans))
    pieces = F.transform(cuts, lambda cut, k: F.substring(
        column, (cut["end"] + 1).cast("int"),
        F.coalesce(F.get(cuts, k + 1)["start"], F.char_length(column).cast("long")).cast("int") - cut["end"].cast("int"),
    ))
    return F.when(F.size(F.col(spans)) == 0, column).otherwise(F.array_join(pieces, ""))
