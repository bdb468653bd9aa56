import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

SF = "/root/testdata/sf0.001"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@pytest.fixture(scope="session")
def documents(spark):
    """The documents of the smallest scale, and awkward ones: null, empty, no words, a long one, repeated rows."""
    real = spark.read.parquet(f"{SF}/documents.parquet")
    long_text = " ".join(f"wort{k % 700} the of" for k in range(20_000))
    odd = [
        (900_001, None, "en", "src0", 0), (900_002, "", None, "src0", 0), (900_003, "... !!! 123", "en", None, 11),
        (900_004, "One", "en", "src1", 3), (900_005, long_text, "en", "src1", len(long_text)),
        (900_006, "same text here, twice over and again", "en", "src2", 36), (900_006, "same text here, twice over and again", "en", "src2", 36),
        (900_007, "same text here, twice over and again", "en", "src3", 36), (None, "a row without an id, of five words", "en", "src3", 34),
    ]
    return real.unionByName(spark.createDataFrame(odd, real.schema)).coalesce(3).cache()


@pytest.fixture(scope="session")
def rows(documents):
    return [r.asDict() for r in documents.collect()]


def plain_words(text):
    import re

    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(str.maketrans(UPPER, LOWER)))
