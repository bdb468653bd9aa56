"""Document fingerprints from spot signatures.

A spot is a common word (an anchor) of the text; its signature is the chain of the next two content words,
skipping other common words. Lists and tables have no common words, so one content word in RARE, chosen by
hash, is an anchor as well. The fingerprint is the set of the signatures' 32-bit hashes, so edits elsewhere
leave it alone and pages that differ in what surrounds an article agree on the article. A text without
anchors takes a chain at every content word; one with too few words for a chain is one signature of its own,
and only the empty text has none.

Likeness is the Jaccard similarity of the sets, exact for the pairs given. Two empty sets are equal. The search of
the method, which lets sets meet by length and shared signatures, is not here: op7 finds near documents.

`edited` pairs each document with the next one by id: neighbours are found on ids alone (range partitions, a
window inside each, and one row of each partition for the borders), then texts are joined on ids. No window
holds all rows. Equal ids are ordered by a hash of the text, rows that repeat share their neighbour; null ids
come first; the last document is followed by the first. Null text is empty. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chartline.llm.flat import saved

# Common words of English, French, German and Spanish.
COMMON = (
    "a an and are as at be but by for from had has have he her his in is it its not of on or she that the their they this"
    " to was were which who will with you"
    " au aux avec ce ces dans de des du elle en est et il ils je la le les leur lui mais ne nous ou par pas plus pour qu"
    " que qui sa se ses son sur un une vous"
    " aber als am auch auf aus bei das dass dem den der des die du ein eine einem einen einer er es für hat ich ihr im"
    " ist mit nach nicht noch sich sie sind so über um und von vor war wie wird zu zum zur"
    " al como con del el ella ellos entre era es esta este ha hay las lo los más me mi muy no nos o para pero por"
    " se si sin sobre su sus también tiene todo una uno y ya"
).split()
CHAIN = 2
RARE = 8


def signatures(rows: DataFrame, text: str, out: str) -> DataFrame:
    """rows with the sorted array of signature hashes of a text column; null text is empty."""
    words = F.filter(F.split(F.lower(F.col(text)), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    at_words = rows.withColumn("_w", words)
    split = at_words.withColumns({
        "_c": F.filter("_w", lambda w: ~w.isin(*COMMON)),
        # content words before each anchor: its place less the anchors before it
        "_a": F.filter(F.transform("_w", lambda w, k: F.when(w.isin(*COMMON), k)), lambda k: k.isNotNull()),
    })
    chains = F.size("_c") - (CHAIN - 1)
    after_anchor = F.transform("_a", lambda k, before: k - before)
    after_rare = F.filter(F.transform("_c", lambda w, k: F.when(F.pmod(F.xxhash64(w), F.lit(RARE)) == 0, k + 1)), lambda k: k.isNotNull())
    at_spots = split.withColumn("_s", F.filter(F.array_union(after_anchor, after_rare), lambda k: k < chains))
    spots = F.when(F.size("_s") > 0, F.col("_s")).when(chains > 0, F.sequence(F.lit(0), chains - 1)).otherwise(F.array().cast("array<int>"))
    chosen = at_spots.withColumn("_s", spots)
    hashes = F.transform("_s", lambda k: F.shiftrightunsigned(F.xxhash64(*(F.get("_c", k + j) for j in range(CHAIN))), 32))
    whole = F.when(F.coalesce(F.col(text), F.lit("")) == "", F.array().cast("array<bigint>")).otherwise(
        F.array(F.shiftrightunsigned(F.xxhash64(F.lower(F.col(text))), 32))
    )
    done = chosen.withColumn(out, F.when(F.size("_s") > 0, F.array_sort(F.array_distinct(hashes))).otherwise(whole))
    return done.drop("_w", "_c", "_a", "_s")


def likeness(left: Column, right: Column) -> Column:
    """Jaccard similarity of two sets."""
    a, b = F.size(left), F.size(right)
    common = F.size(F.array_intersect(left, right))
    return F.when((a == 0) & (b == 0), 1.0).otherwise(common / (a + b - common))


def fingerprint(signatures_: Column) -> Column:
    """The set as text."""
    return F.array_join(F.transform(signatures_, lambda s: F.lower(F.hex(s))), " ")


def neighbours(docs: DataFrame, key: str, text: str) -> DataFrame:
    """key, mark, and the key, mark and n_chars of the document before; the first comes after the last."""
    rows = docs.select(F.col(key).alias("key"), F.xxhash64(text).alias("mark"), F.char_length(text).alias("n")).distinct()
    ids = saved(rows.repartitionByRange("key", "mark").withColumn("part", F.spark_partition_id()))
    me = F.struct("key", "mark", "n")
    inside = Window.partitionBy("part").orderBy("key", "mark")
    last = ids.groupBy("part").agg(F.max_by(me, F.struct("key", "mark")).alias("last"))
    by_part = Window.orderBy("part")
    ends = last.select(
        (F.col("part")).alias("part"),
        F.coalesce(F.lag("last").over(by_part), F.last("last").over(by_part.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("border"),
    )
    before = ids.withColumn("before", F.lag(me).over(inside)).join(ends, "part")
    return before.select("key", "mark", F.coalesce("before", "border").alias("before")).select(
        "key", "mark", F.col("before.key").alias("before_key"), F.col("before.mark").alias("before_mark"), F.col("before.n").alias("before_n"),
    )


def compare_edited(docs: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_chars, edited_sha256, both fingerprints, and their likeness, of every row.

    The edited text has its last quarter of characters replaced by as many from the front of the next text.
    """
    kind = docs.schema[key].dataType
    rows = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("t"))

    def place(column: str, prefix: str) -> list[Column]:
        """A key as two columns that join like any value, null too."""
        return [F.col(column).isNull().alias(f"{prefix}none"), F.coalesce(F.col(column).cast("string"), F.lit("")).alias(f"{prefix}id")]

    on = ["none", "id", "mark"]
    # The texts are dealt out once, by id; both sides of the second join read that same exchange. A running
    # count, not a rank, tells repeated rows apart: for a rank the two sides would be dealt out differently.
    once = Window.partitionBy(*on).orderBy("none").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    dealt = rows.select(*place("key", ""), F.xxhash64("t").alias("mark"), "t").withColumn("copy", F.count(F.lit(1)).over(once))
    prior = neighbours(rows, "key", "t").select(*place("key", ""), "mark", *place("before_key", "b_"), "before_mark", "before_n")
    given = signatures(dealt.where("copy = 1").join(prior, on), "t", "sig").select(
        F.col("b_none").alias("none"), F.col("b_id").alias("id"), F.col("before_mark").alias("mark"),
        F.substring("t", F.lit(1), F.floor(F.col("before_n") / 4).cast("int")).alias("patch"), F.col("sig").alias("next_sig"),
    )
    paired = signatures(dealt.join(given, on), "t", "sig").withColumn("n_chars", F.char_length("t"))
    kept = F.substring("t", F.lit(1), F.col("n_chars") - F.floor(F.col("n_chars") / 4).cast("int"))
    texts = paired.select(
        F.when(~F.col("none"), F.col("id")).cast(kind).alias("key"), "n_chars", "sig", "next_sig", F.concat(kept, "patch").alias("edited")
    )
    both = signatures(texts, "edited", "edited_sig")
    return both.select(
        F.col("key").alias(key), F.col("n_chars").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"),
        fingerprint(F.col("sig")).alias("fingerprint"), fingerprint(F.col("edited_sig")).alias("edited_fingerprint"),
        likeness(F.col("sig"), F.col("edited_sig")).alias("near_edited"), likeness(F.col("sig"), F.col("next_sig")).alias("near_next"),
    )


def query(spark, sf_dir: str) -> DataFrame:
    return compare_edited(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
