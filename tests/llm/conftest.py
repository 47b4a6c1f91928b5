import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

SF001 = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet(f"{SF001}/documents.parquet").cache()


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, empty and long texts, ties, repeated rows, and clashing column names."""
    names = ("size", "source_size", "target", "copies", "n_lines", "n_dropped", "kept_text", "lang_pred", "score",
             "rejected", "r_id", "id", "component", "bands", "drop", "r_found", "n")
    long = " ".join(f"word{k % 997} tail{k}" for k in range(30_000))
    line = "this very line is shared by many of the documents here"
    rows = [
        (1, f"{line}\nfirst text with a few words of its own", "en", "a", 10),
        (2, f"{line}\nsecond text, with other words", "en", "a", 10),
        (3, f"  {line.upper()}\t\nthird text", "en", None, 10),
        (4, line, None, "b", None),
        (5, None, "en", "b", None),
        (6, "", "en", "b", 0),
        (7, " \n\t\n", None, None, 3),
        (8, long, "en", "a", len(long)),
        (9, long, "en", "a", len(long)),
        (9, long, "en", "a", len(long)),
        (None, f"{line}\nno id", "en", "a", 5),
        (None, None, None, None, None),
        (10, "12 34 !!! ###", "en", "c", 13),
        (11, "a b c d e f g h i j", "en", "c", 19),
        (12, "A B C D E F G H I J", "fr", "c", 19),
    ]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    df = spark.createDataFrame(rows, schema)
    from pyspark.sql import functions as F

    return df.select("*", *[F.lit(k).alias(n) for k, n in enumerate(names)]).repartition(3)


@pytest.fixture(scope="session")
def empty(documents):
    return documents.limit(0)
