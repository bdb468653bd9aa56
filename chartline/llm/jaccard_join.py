"""N-gram Jaccard self-join of documents with Bayesian pruning of candidate pairs.

Documents are sets of shingles of five words. Documents with equal sets form a class and are joined as one.

1. Every class has 96 MinHash values, in 24 bands of four. Classes that share a band are candidates; a pair
   of similarity 0.8 shares none with a probability of 3e-6.
2. Only bands that two classes share go on. The members of a band are cut into chunks of about a thousand,
   and each pair of chunks is a cell; a task compares the pairs of its cells in memory and no pair becomes a
   row. A pair is taken in the first band that it shares. Its values are compared sixteen at a time, and it is
   dropped as soon as the posterior probability (uniform prior) that its similarity reaches the threshold
   falls below `tolerance`.
3. Cells with surviving pairs get the full shingle sets of the documents in these pairs, and only those: a Bloom
   filter keeps other texts out of the shuffle, and a text is named by id and hash, so ids may be null or shared. Each
   surviving pair is verified by exact intersection of the sets (of 64-bit shingle hashes).
4. A cell returns, for each document, its number of links and the smallest document it is connected with.
   These few rows are summed, and connected over the cells by alternating star contraction.

So rows never grow with the square of a group: a group of n near copies makes about n * n / 1024 rows of
signatures, spread over cells, and n rows of links. A hot class is one member; a hot band is many cells.

Result, one row for each document: its id; copy_id, the smallest id of its class; class_id, the smallest id of
its group, which is connected by links; n_links, the number of other classes it is linked with (similarity of
at least the threshold); n_copies, the rows in its class.

Texts of one to four words are one shingle. Texts without words (also null, which counts as empty) are in
one class where they are equal, and have no links. Ids may repeat or be null; a null id is the smallest only
where a group has no other. So copy_id and class_id name a group but need not tell two apart: unlike texts that
repeat an id, or have none, share theirs. join() also gives `group`, a number of its own for each group of one
run, and one_of_each goes by that. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chartline.llm import flat

SHINGLE = 5
THRESHOLD = 0.8
BANDS, ROWS = 24, 4
VALUES = BANDS * ROWS
STEP = 16
TOLERANCE = 1e-6
CHUNK_MEMBERS = 1024
CHUNK_SHINGLES = 1 << 19
PAIRS_AT_ONCE = 1 << 18

_SEEDS = flat.mix(np.arange(1, VALUES + 1, dtype=np.uint64) * np.uint64(0xA24BAED4963EE407))
_FACTORS = flat.mix(_SEEDS) | np.uint64(1)
_WEIGHTS = flat.mix(np.arange(7, 7 + SHINGLE, dtype=np.uint64)) | np.uint64(1)


def shingle_sets(data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each row."""
    low, starts, ends, before = flat.words(data, offsets)
    hashes = np.concatenate([flat.span_hash(low, starts, ends), np.zeros(SHINGLE, np.uint64)])
    counts = np.diff(before)
    taken = np.where(counts > 0, np.maximum(counts - SHINGLE + 1, 1), 0)
    at = flat.ranges(before[:-1], taken)
    until = np.repeat(before[1:], taken)
    total = np.zeros(len(at), np.uint64)
    for k in range(SHINGLE):
        total += np.where(at + k < until, hashes[at + k] * _WEIGHTS[k], np.uint64(0))
    total = flat.mix(total)
    bounds = np.concatenate([[0], np.cumsum(taken)])
    sets = []
    for a, b in zip(bounds[:-1], bounds[1:], strict=True):
        ordered = np.sort(total[a:b])
        sets.append(ordered[np.concatenate([[True], ordered[1:] != ordered[:-1]])] if b > a else ordered)
    return sets


def signature(shingles: np.ndarray) -> np.ndarray:
    """MinHash values of a set."""
    least = np.full(VALUES, np.iinfo(np.uint64).max, np.uint64)
    for k in range(0, len(shingles), 2048):
        some = (shingles[k : k + 2048][None, :] ^ _SEEDS[:, None]) * _FACTORS[:, None]
        np.minimum(least, some.min(1), out=least)
    return (least >> np.uint64(32)).astype("<u4")


def set_key(shingles: np.ndarray, raw: bytes) -> bytes:
    """128 bits that name the set; texts without words are named by their bytes."""
    return xxhash.xxh3_128_digest(shingles.tobytes()) if len(shingles) else xxhash.xxh3_128_digest(b"no words" + raw)


def _signed(docs: DataFrame, text: str) -> DataFrame:
    """id, mark, key, n, signature of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = flat.column_bytes(batch.column(batch.schema.get_field_index("t")))
            for a, b in flat.slices(offsets):
                part = data[offsets[a] : offsets[b]]
                cuts = offsets[a : b + 1] - offsets[a]
                sets = shingle_sets(part, cuts)
                keys = [set_key(s, part[cuts[k] : cuts[k + 1]].tobytes()) for k, s in enumerate(sets)]
                signatures = [signature(s).tobytes() if len(s) else None for s in sets]
                rows = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([
                    rows.column(0), rows.column(1), pa.array(keys, pa.binary()),
                    pa.array([len(s) for s in sets], pa.int32()), pa.array(signatures, pa.binary()),
                ], names=["id", "mark", "key", "n", "signature"])

    schema = T.StructType([docs.schema["id"], docs.schema["mark"], *T.StructType.fromDDL("key binary, n int, signature binary").fields])
    return flat.mapped(docs.select("id", "mark", F.col(text).alias("t")), run, schema)


def least_matches(threshold: float, tolerance: float) -> list[int]:
    """After each step of values: the fewest matches whose posterior still reaches the tolerance.

    With a uniform prior, P(similarity >= s | m of k match) = P(Binomial(k + 1, s) <= m).
    """
    out = []
    for k in range(STEP, VALUES + 1, STEP):
        tail, m = 0.0, 0
        while True:
            tail += comb(k + 1, m) * threshold**m * (1 - threshold) ** (k + 1 - m)
            if tail >= tolerance:
                break
            m += 1
        out.append(m)
    return out


def _pairs(firsts: np.ndarray, sizes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs of rows within groups, in blocks of bounded size."""
    row = flat.ranges(firsts, sizes)
    after = np.repeat(firsts + sizes, sizes) - row - 1
    row, after = row[after > 0], after[after > 0]
    bounds = np.concatenate([[0], np.cumsum(after)])
    for a, b in flat.slices(bounds, PAIRS_AT_ONCE):
        yield np.repeat(row[a:b], after[a:b]), flat.ranges(row[a:b] + 1, after[a:b])


def _survivors(needed: list[int]):
    """Cells of (cell, band, chunk, cid, signature) rows to (cell, cids, left, right) with the pairs that remain."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in flat.whole_groups(batches, "cell"):
            cell, band, chunk, cid = (table.column(c).to_numpy() for c in ("cell", "band", "chunk", "cid"))
            crossing = table.column("crossing").to_numpy()
            values = np.frombuffer(b"".join(table.column("signature").to_pylist()), "<u4").reshape(-1, VALUES)
            firsts = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]]))
            found = []
            for left, right in _pairs(firsts, np.diff(np.append(firsts, len(cell)))):
                keep = ~crossing[left] | (chunk[left] != chunk[right])
                left, right = left[keep], right[keep]
                matches = np.zeros(len(left), np.int64)
                for step, least in enumerate(needed):
                    at = step * STEP
                    same = values[left, at : at + STEP] == values[right, at : at + STEP]
                    shared = same.reshape(len(left), STEP // ROWS, ROWS).all(2)
                    earlier = np.arange(at // ROWS, (at + STEP) // ROWS)[None, :] < band[left][:, None]
                    matches = matches + same.sum(1)
                    keep = (matches >= least) & ~(shared & earlier).any(1)
                    left, right, matches = left[keep], right[keep], matches[keep]
                found.append((left, right))
            left, right = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.empty(0, int),) * 2
            if not len(left):
                continue
            group = np.searchsorted(firsts, left, "right")
            cuts = np.flatnonzero(np.diff(group)) + 1
            out: dict[str, list] = {"cell": [], "cids": [], "left": [], "right": []}
            for lefts, rights in zip(np.split(left, cuts), np.split(right, cuts), strict=True):
                members, place = np.unique(np.concatenate([lefts, rights]), return_inverse=True)
                out["cell"].append(int(cell[lefts[0]]))
                out["cids"].append(cid[members])
                out["left"].append(place[: len(lefts)].astype(np.int32))
                out["right"].append(place[len(lefts) :].astype(np.int32))
            yield pa.RecordBatch.from_pydict(out, schema=pa.schema([
                ("cell", pa.int64()), ("cids", pa.list_(pa.int64())), ("left", pa.list_(pa.int32())), ("right", pa.list_(pa.int32())),
            ]))

    return run


def _cell_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(cid, key, cells, text) rows to (cell, cid, shingles); rows whose set is not the class's are left out."""
    for batch in batches:
        names = batch.schema.names
        data, offsets = flat.column_bytes(batch.column(names.index("t")))
        for a, b in flat.slices(offsets):
            part, cuts = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
            rows = batch.slice(a, b - a)
            keys, cells, cids = (rows.column(names.index(c)).to_pylist() for c in ("key", "cells", "cid"))
            out: list[tuple[int, int, bytes]] = []
            for k, shingles in enumerate(shingle_sets(part, cuts)):
                if set_key(shingles, b"") == keys[k]:
                    raw = shingles.tobytes()
                    out += [(cell, cids[k], raw) for cell in cells[k]]
            for k in range(0, len(out), 2000):
                cell, cid, raw = zip(*out[k : k + 2000], strict=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(cell, pa.int64()), pa.array(cid, pa.int64()), pa.array(raw, pa.binary())], names=["cell", "cid", "shingles"]
                )


def similar(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, threshold: float) -> np.ndarray:
    """Which pairs of sets have a Jaccard similarity of at least the threshold, exactly."""
    sizes = np.array([len(s) for s in sets], np.int64)
    starts = np.cumsum(sizes) - sizes
    words, codes = np.unique(np.concatenate(sets), return_inverse=True)
    common = np.empty(len(left), np.int64)
    order = np.argsort(left, kind="stable")
    marked = np.zeros(len(words), bool)
    for places in np.split(order, np.flatnonzero(np.diff(left[order])) + 1):
        one, others = left[places[0]], right[places]
        own = codes[starts[one] : starts[one] + sizes[one]]
        marked[own] = True
        hits = marked[codes[flat.ranges(starts[others], sizes[others])]]
        common[places] = flat.per_row(hits, np.concatenate([[0], np.cumsum(sizes[others])]))
        marked[own] = False
    # common / union >= threshold, in whole numbers so that the border is exact
    per_mille = round(threshold * 1_000_000)
    return common * 1_000_000 >= per_mille * (sizes[left] + sizes[right] - common)


def _verified(threshold: float):
    """Cells of one row with pairs and rows with sets to (cid, links, root) of each linked member."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in flat.whole_groups(batches, "cell"):
            cell = table.column("cell").to_numpy()
            firsts = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]]))
            out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
            for a, b in zip(firsts, np.append(firsts[1:], len(cell)), strict=True):
                part = table.slice(a, b - a)
                pairs = [k for k, c in enumerate(part.column("cids").to_pylist()) if c is not None]
                held = {c: s for c, s in zip(part.column("cid").to_pylist(), part.column("shingles").to_pylist(), strict=True) if c is not None}
                cids, left, right = (part.column(c)[pairs[0]].values.to_numpy() for c in ("cids", "left", "right"))
                sets = [np.frombuffer(held[c], np.uint64) for c in cids.tolist()]
                linked = similar(sets, left, right, threshold)
                left, right = left[linked], right[linked]
                if not len(left):
                    continue
                links = np.bincount(np.concatenate([left, right]), minlength=len(cids))
                root = np.arange(len(cids))
                while True:  # the smallest member reached, until nothing changes
                    least = np.minimum(root[left], root[right])
                    new = root.copy()
                    np.minimum.at(new, left, least)
                    np.minimum.at(new, right, least)
                    new = np.minimum(new, new[new])
                    if np.array_equal(new, root):
                        break
                    root = new
                some = np.flatnonzero(links)
                # cids are in ascending order of place, so the smallest place is the smallest cid of the cell
                out.append((cids[some], links[some], cids[root[some]]))
            if out:
                cid, links, root = (np.concatenate(x) for x in zip(*out, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(cid), pa.array(links, pa.int64()), pa.array(root)], names=["cid", "links", "root"])

    return run


def components(edges: DataFrame) -> DataFrame:
    """v, p: the smallest node that each node is connected with, from edges (v, p) with p < v; roots are left out.

    Each round takes a node to the smallest of its parents, joins its other parents to that one, and follows
    parents of parents. The driver only learns whether a round was the last.
    """
    edges = flat.saved(edges.where("p < v").distinct())
    while True:
        least = edges.groupBy("v").agg(F.min("p").alias("m"), F.count("*").alias("c"))
        open_ = least.where("c > 1").select("v").union(edges.select("p").join(least.select(F.col("v").alias("p")), "p", "left_semi"))
        if open_.isEmpty():
            return edges
        star = edges.join(least.select("v", "m"), "v")
        star = star.select("v", F.col("m").alias("p")).union(star.where("p > m").select(F.col("p").alias("v"), F.col("m").alias("p")))
        up = least.select(F.col("v").alias("p"), F.col("m").alias("q"))
        edges = flat.saved(star.distinct().join(up, "p", "left").select("v", F.coalesce("q", "p").alias("p")).distinct())


PLACE = ["_none_", "_id_", "_mark_"]


def _place(key: Column, mark: Column) -> tuple[Column, ...]:
    """What tells a text of an id from others, for joins by plain equality: null ids too."""
    return key.isNull().alias("_none_"), F.coalesce(key.cast("string"), F.lit("")).alias("_id_"), mark.alias("_mark_")


def join(
    docs: DataFrame, *, key: str = "doc_id", text: str = "text", threshold: float = THRESHOLD, tolerance: float = TOLERANCE,
    chunk_members: int = CHUNK_MEMBERS,
) -> DataFrame:
    """key, mark, group, copy_id, class_id, n_links, n_copies of every row; mark tells rows of equal key apart by their text."""
    docs = docs.select(F.col(key).alias("id"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("mark"), F.col(text).alias("text"))
    signed = flat.saved(_signed(docs, "text"))
    classes = flat.saved(
        signed.groupBy("key").agg(
            F.min("id").alias("copy_id"), F.min(F.struct("id", "mark")).alias("first"), F.count("*").alias("n_copies"),
            F.first("n").alias("n"), F.first("signature").alias("signature"),
        ).withColumn("cid", F.monotonically_increasing_id())
    )
    bands = classes.where("n > 0").select(
        "cid", "n", F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda k: F.xxhash64(
            F.substring("signature", k * (4 * ROWS) + 1, F.lit(4 * ROWS)), k,
        ))).alias("band", "bucket"),
    )
    shared = bands.groupBy("bucket").agg(F.count("*").alias("size"), F.sum("n").alias("total")).where("size > 1")
    chunks = F.greatest(F.ceil(F.col("size") / chunk_members), F.ceil(F.col("total") / CHUNK_SHINGLES)).cast("int")
    members = (
        bands.join(shared, "bucket").select("bucket", "band", "cid", chunks.alias("chunks"))
        .withColumn("chunk", F.pmod(F.xxhash64("cid", "bucket"), F.col("chunks")).cast("int"))
    )
    low, high = F.least("chunk", "other"), F.greatest("chunk", "other")
    cells = (
        members.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
        .select(F.xxhash64("bucket", low, high).alias("cell"), (low != high).alias("crossing"), "chunk", "band", "cid")
        .join(classes.select("cid", "signature"), "cid")
        .repartition("cell").sortWithinPartitions("cell", "cid")
    )
    survivors = flat.saved(flat.mapped(
        cells, _survivors(least_matches(threshold, tolerance)), "cell bigint, cids array<bigint>, left array<int>, right array<int>"
    ))
    wanted = flat.saved(
        survivors.select("cell", F.explode("cids").alias("cid")).groupBy("cid").agg(F.collect_list("cell").alias("cells"))
        .join(classes.select("cid", "key", "first"), "cid")
        .select("cid", "key", "cells", *_place(F.col("first.id"), F.col("first.mark")))
    )
    # Only texts that may be wanted are shuffled: one row of each id and text, and each meets the one row that wants it.
    held = flat.Bloom(wanted.select(F.xxhash64(*PLACE))).rows(
        docs.select(*_place(F.col("id"), F.col("mark")), F.col("text").alias("t")).withColumn("_hash_", F.xxhash64(*PLACE)), "_hash_"
    )
    texts = held.dropDuplicates(PLACE).join(wanted, PLACE).select("cid", "key", "cells", "t")
    sets = flat.mapped(texts, _cell_sets, "cell bigint, cid bigint, shingles binary")
    nothing = {name: F.lit(None).cast(kind) for name, kind in (("cids", "array<bigint>"), ("left", "array<int>"), ("right", "array<int>"))}
    gathered = sets.withColumns(nothing).unionByName(survivors, allowMissingColumns=True)
    linked = flat.saved(flat.mapped(
        gathered.repartition("cell").sortWithinPartitions("cell"), _verified(threshold), "cid bigint, links bigint, root bigint"
    ))
    links = linked.groupBy("cid").agg(F.sum("links").alias("n_links"))
    roots = components(linked.select(F.col("cid").alias("v"), F.col("root").alias("p")))
    named = (
        classes.select("key", "cid", "copy_id", "n_copies").join(links, "cid", "left")
        .join(roots.withColumnsRenamed({"v": "cid", "p": "root"}), "cid", "left")
        .withColumn("root", F.coalesce("root", "cid"))
    )
    ids = named.groupBy("root").agg(F.min("copy_id").alias("class_id"))
    named = named.join(ids, "root").select(
        "key", F.col("root").alias("group"), "copy_id", "class_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.col("n_copies").cast("long").alias("n_copies"),
    )
    return signed.select("id", "mark", "key").join(named, "key").drop("key").withColumnRenamed("id", key)


def one_of_each(docs: DataFrame, *, key: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs with one document of each group: that of the smallest id (then of the smallest text hash)."""
    found = join(docs, key=key, text=text, threshold=threshold)
    kept = found.groupBy("group").agg(F.min(F.struct(F.col(key).isNull().alias("none"), key, "mark")).alias("first"))
    # Plain equality on what stands for the id: join and dropDuplicates then share one exchange of the texts.
    kept = kept.select(*_place(F.col(f"first.{key}"), F.col("first.mark"))).distinct()
    rows = docs.select("*", *_place(F.col(key), F.xxhash64(F.coalesce(F.col(text), F.lit("")))))
    return rows.join(kept, PLACE, "left_semi").dropDuplicates(PLACE).drop(*PLACE)
