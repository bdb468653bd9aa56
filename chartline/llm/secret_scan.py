r"""Secret scan with ownership counted over the whole corpus.

Candidates are spans that look like credentials: assignments to names like `password`, cloud access ids, long
hexadecimal strings, and forms with a fixed prefix (access tokens, signed web tokens, private key headers,
credentials inside urls). Each candidate value is hashed, and Spark counts in how many distinct repositories
and by how many distinct owners it stands in the corpus. A value of few owners looks live; one that many
owners hold is an example that was copied. Base kinds are always reported, with that verdict; the spans of
the other kinds are added where their value looks live.

Matches are leftmost and do not overlap within a kind. Positions count code points, the end is exclusive.
Null text is empty. A null owner is one owner, a null repository one repository. Rows may repeat: each gets
its own result. An empty table gives an empty result.

The texts are read once and never shuffled. Only hashes and positions move: they are counted by hash after
partial counts on each task, and joined back by hash, a join that is split where one value is everywhere.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chartline.llm.flat import saved

MAX_OWNERS = 2
# Fixed values, in the order in which kinds are listed: (kind, pattern, group of the value, least length of it).
BASE = (
    ("assign", r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 1, 6),
    ("access", r"AKIA[A-Z0-9]+", 0, 20),
    ("hex", r"[0-9a-f]{24,}", 0, 24),
)
ADDED = (
    ("forge", r"gh[pousr]_[A-Za-z0-9]{36,}", 0, 40),
    ("chat", r"xox[abprs]-[A-Za-z0-9-]{10,}", 0, 15),
    ("signed", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 0, 24),
    # a header, lines like `Proc-Type: ...`, and all up to the END line; without one, the whole lines of base64
    ("key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----\s++(?:[A-Za-z][A-Za-z0-9-]*+:[^\n]*+\n(?:[ \t]++[A-Za-z0-9][^\n]*+\n)*+\s*+)*+"
        r"(?:[A-Za-z0-9+/=\s]{16,}+-----END [A-Z ]*PRIVATE KEY-----"
        r"|[A-Za-z0-9+/=]{16,}+(?:[ \t\r]*+\n[ \t]*+[A-Za-z0-9+/=]{16,}+(?=[ \t\r]*+(?:\n|\z)))*+)", 0, 40),
    ("url", r"[a-z][a-z0-9+.-]{1,15}://[^\s:/@]++:([^\s:/@]{6,}+)@", 1, 6),
)
KINDS = BASE + ADDED
# Spans gathered before they become a block.
BLOCK = 128
_SPAN = "struct<start:bigint,kind:int,end:bigint,value:string>"


def _matches(text: Column, number: int) -> Column:
    """The spans of one kind. Between matches lie what split leaves, so lengths give the positions."""
    _, pattern, group, least = KINDS[number]
    zipped = F.arrays_zip(
        F.split(text, pattern, -1).alias("gap"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("hit"),
        F.regexp_extract_all(text, F.lit(pattern), F.lit(group)).alias("value"),
    )
    # Appending copies an array, so spans are gathered in blocks, and blocks in an array of blocks: nearly linear in the hits.
    none, no_block = F.array().cast(f"array<{_SPAN}>"), F.array().cast(f"array<array<{_SPAN}>>")
    start = F.struct(F.lit(0).cast("long").alias("at"), no_block.alias("full"), none.alias("found"))

    def step(done: Column, part: Column) -> Column:
        first = done["at"] + F.char_length(part["gap"])
        until = first + F.coalesce(F.char_length(part["hit"]), F.lit(0))
        span = F.struct(first.alias("start"), F.lit(number).alias("kind"), until.alias("end"), F.sha2(part["value"], 256).alias("value"))
        good = part["hit"].isNotNull() & (F.char_length(part["value"]) >= least)
        filled = F.size(done["found"]) >= BLOCK
        found = F.when(filled, none).otherwise(done["found"])
        return F.struct(
            until.alias("at"), F.when(filled, F.array_append(done["full"], done["found"])).otherwise(done["full"]).alias("full"),
            F.when(good, F.array_append(found, span)).otherwise(found).alias("found"),
        )

    spans = F.aggregate(zipped, start, step, lambda done: F.flatten(F.array_append(done["full"], done["found"])))
    return F.when(text.rlike(pattern), spans).otherwise(none)


def candidates(docs: DataFrame, *, key: str = "doc_id", text: str = "text", owner: str = "source", repository: str = "doc_id") -> DataFrame:
    """key, owner, repository, spans: all candidates of every row, by start and kind."""
    rows = docs.select(F.col(key).alias("key"), F.col(owner).alias("owner"), F.col(repository).alias("repository"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    return rows.select("key", "owner", "repository", F.array_sort(F.flatten(F.array(*(_matches(F.col("t"), k) for k in range(len(KINDS)))))).alias("spans"))


def ownership(found: DataFrame) -> DataFrame:
    """value, owners, repositories of every candidate value of the corpus."""
    each = found.select(F.explode("spans.value").alias("value"), "owner", "repository")
    return each.groupBy("value").agg(
        (F.count_distinct("owner") + F.max(F.col("owner").isNull().cast("int"))).alias("owners"),
        (F.count_distinct("repository") + F.max(F.col("repository").isNull().cast("int"))).alias("repositories"),
    )


def scan(docs: DataFrame, *, key: str = "doc_id", text: str = "text", owner: str = "source", repository: str = "doc_id", max_owners: int = MAX_OWNERS) -> DataFrame:
    """key and spans of every row: (start, kind, end, base, owners, repositories, live), by start, then kind."""
    found = saved(candidates(docs, key=key, text=text, owner=owner, repository=repository).withColumn("row", F.monotonically_increasing_id()))
    counts = ownership(found)
    judged = (
        found.select("row", F.explode("spans").alias("s")).select("row", "s.*").join(counts, "value")
        .withColumn("live", F.col("owners") <= max_owners).withColumn("base", F.col("kind") < len(BASE))
        .where(F.col("base") | F.col("live"))
    )
    per_row = judged.groupBy("row").agg(F.array_sort(F.collect_list(
        F.struct("start", "kind", "end", "base", "owners", "repositories", "live")
    )).alias("spans"))
    rows = found.select("row", "key").join(per_row, "row", "left")
    empty = F.array().cast(per_row.schema["spans"].dataType)
    return rows.select(F.col("key").alias(key), F.coalesce("spans", empty).alias("spans"))


def _listed(spans: Column) -> Column:
    names = F.array(*(F.lit(k[0]) for k in KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text")
    base = F.filter("spans", lambda s: s["base"])

    def count(number: int) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == number)).cast("long")

    return scan(docs).select(
        "doc_id", *(count(k).alias(f"n_{KINDS[k][0]}") for k in range(len(BASE))),
        F.sha2(_listed(base), 256).alias("base_sha256"), _listed(F.col("spans")).alias("spans"),
        F.size(F.filter("spans", lambda s: s["live"])).cast("long").alias("n_live"),
        F.size(F.filter("spans", lambda s: ~s["live"])).cast("long").alias("n_copied"),
    )
