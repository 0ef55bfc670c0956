import pytest
from pyspark.sql import types as T

#: Columns with names the operators use inside, to show that they do not clash.
ODD_COLUMNS = ["_id", "_group", "shard", "kept", "ids", "node", "bag", "sketch", "start", "score"]
SCHEMA = T.StructType(
    [T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())]
    + [T.StructField(name, T.StringType()) for name in ODD_COLUMNS])
LONG = " ".join(f"wort{i % 977} x{i}" for i in range(60_000))
#: Nulls, empties, white space, ties, repeated rows, odd spaces, special tokens, a very long text, one without spaces.
TEXTS = {
    1: "one two  three\nfour five six", 2: "one two three four five six", 3: None, 4: "", 5: " \t ", 6: "a", 7: "a", 8: LONG, 9: LONG + " end",
    10: "x" * 70_000, 11: "İstanbul Σίσυφος ΟΔΟΣ don't I'LL 漢字 🙂 é 　z \x1c\x85", 12: "<|endoftext|> a<|startoftext|>b <|endoftext|>", 13: "%%% !!! ... \r\n\r\n  z",
    14: "one two three four five six",
}


@pytest.fixture(scope="session")
def odd_docs(spark):
    rows = [(i, text, None if i % 3 else "en", None if i % 2 else "s", None, *["?"] * len(ODD_COLUMNS)) for i, text in TEXTS.items()]
    rows.append((None, "one two three four five six", "en", "s", 1, *["?"] * len(ODD_COLUMNS)))
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="session")
def empty_docs(odd_docs):
    return odd_docs.limit(0)


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
