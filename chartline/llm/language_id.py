"""Language identification by compression: the language whose dictionary makes the text smallest.

For each language a raw-content zstandard dictionary is filled with text of a bounded sample of labelled
rows. A text is put in plain form (lower case, letters and single spaces), cut into windows that overlap by half,
and every window is compressed with each dictionary; the sums decide, so that a long text does not outgrow the
dictionaries, and texts of all lengths are treated alike. The score is the margin between the two smallest sums as a share of the second; a text is rejected when the
margin is below `min_margin`. Equal sums go to the language with more labelled rows, then by name.

Fitting reads ids and labels of all rows, but texts of at most `per_language` rows of each of the `most_languages`
labels with the most rows (then by name): those with the smallest hash of their id (and of their text, should ids
repeat). All of these rows fill the dictionary of their language alike, each with EXCERPTS stretches of equal length
spread from its beginning to its end, or whole if it is shorter. Prediction reads whole texts
where they lie; nothing is shuffled. Null text, and text without a letter, is `und` with score 0 and is
rejected. Rows with a null label or null text are not learned from. If nothing is labelled all is `und`.
Equal texts get equal results.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chartline.llm.flat import mapped

PER_LANGUAGE = 96
MOST_LANGUAGES = 256
DICTIONARY_BYTES = 1 << 16
EXCERPTS = 4
WINDOW = 512
LEVEL = 6
MIN_MARGIN = 0.002

_PLAIN = bytes(b if b >= 0x80 or chr(b).isalpha() else 0x20 for b in range(256))

RESULT = T.StructType([
    T.StructField("lang", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("rejected", T.BooleanType()),
])


def plain(text: str) -> bytes:
    """Lower case, with every run of other ASCII characters than letters as one space."""
    return b" ".join(text.lower().encode("utf-8", "replace").translate(_PLAIN).split())


def fit(
    labelled: DataFrame, *, text: str = "text", label: str = "lang", key: str = "doc_id", per_language: int = PER_LANGUAGE,
    most_languages: int = MOST_LANGUAGES,
) -> list[tuple[str, bytes]]:
    """(language, dictionary) pairs, by number of labelled rows.

    The driver receives about DICTIONARY_BYTES characters of each of at most most_languages labels.
    """
    rows = labelled.where(F.col(label).isNotNull() & F.col(text).isNotNull())
    place = F.xxhash64(F.col(key).cast("string")), F.xxhash64(F.col(text))
    counted = rows.groupBy(F.col(label).alias("l")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "l").limit(most_languages).collect()
    names = [r["l"] for r in counted]
    known = rows.where(F.col(label).isin(names))
    ids = known.select(F.col(label).alias("l"), place[0].alias("a"), place[1].alias("b"))
    first = Window.partitionBy("l").orderBy("a", "b")
    chosen = ids.withColumn("k", F.row_number().over(first)).where(F.col("k") <= per_language).drop("k").distinct()
    share = DICTIONARY_BYTES // per_language // EXCERPTS
    length = F.char_length(text)
    spread = F.concat_ws(" ", *(
        F.substr(text, F.floor((length - share) * k / (EXCERPTS - 1)).cast("int") + 1, F.lit(share)) for k in range(EXCERPTS)
    ))
    sample = (
        known.select(F.col(label).alias("l"), place[0].alias("a"), place[1].alias("b"), F.when(length <= share * EXCERPTS, F.col(text)).otherwise(spread).alias("t"))
        .join(F.broadcast(chosen), ["l", "a", "b"]).dropDuplicates(["l", "a", "b"]).select("l", "a", "b", "t").collect()
    )
    found: dict[str, list[bytes]] = {name: [] for name in names}
    for row in sorted(sample, key=lambda r: (r["a"], r["b"])):
        found[row["l"]].append(plain(row["t"]))
    return [(name, b" ".join(found[name])) for name in names if any(found[name])]


@lru_cache(maxsize=4)
def _compressors(dictionaries: tuple[tuple[str, bytes], ...]):
    import zstandard

    parameters = zstandard.ZstdCompressionParameters.from_level(LEVEL, write_content_size=0, write_checksum=0, write_dict_id=0)
    made = []
    for _, raw in dictionaries:
        filled = zstandard.ZstdCompressionDict(raw.ljust(8), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        filled.precompute_compress(compression_params=parameters)
        made.append(zstandard.ZstdCompressor(dict_data=filled, compression_params=parameters))
    return made


def classify(text: str | None, dictionaries: tuple[tuple[str, bytes], ...], min_margin: float) -> tuple[str, float, bool]:
    if text is None or not dictionaries or not any(map(str.isalpha, text)):
        return "und", 0.0, True
    raw = plain(text)
    parts = [raw[k : k + WINDOW] for k in range(0, max(1, len(raw) - WINDOW // 2), WINDOW // 2)]
    sums = np.array([sum(len(c.compress(part)) for part in parts) for c in _compressors(dictionaries)])
    order = np.argsort(sums, kind="stable")
    if len(order) == 1:
        return dictionaries[0][0], 1.0, False
    best, second = int(sums[order[0]]), int(sums[order[1]])
    score = (second - best) / second
    return dictionaries[int(order[0])][0], score, score < min_margin


def identify(docs: DataFrame, dictionaries: list[tuple[str, bytes]], *, text: str = "text", out: str = "language", min_margin: float = MIN_MARGIN) -> DataFrame:
    """All rows and columns, and a struct column: lang, score, rejected. A column of that name is replaced."""
    docs = docs.drop(out)
    schema = T.StructType([*docs.schema.fields, T.StructField(out, RESULT)])
    fitted = tuple(dictionaries)
    kind = pa.struct([("lang", pa.string()), ("score", pa.float64()), ("rejected", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index(text))
            found = [classify(t.as_py(), fitted, min_margin) for t in texts]
            column = pa.array([dict(zip(("lang", "score", "rejected"), f, strict=True)) for f in found], kind)
            yield pa.RecordBatch.from_arrays([*batch.columns, column], names=[*batch.schema.names, out])

    return mapped(docs, run, schema)


def held_out(key: str = "doc_id") -> Column:
    """Rows that are kept for testing: crc32 of the id as text leaves 2 when divided by 4."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 4 == 2, F.lit(False))
