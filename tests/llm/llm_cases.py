"""Small tables with the cases every operator must give a defined result for."""

from pyspark.sql import types as T

# columns that share their names with what operators use inside
CLASHING = ["row", "uid", "digest", "fp", "id", "h", "q", "n", "bucket", "pos", "key", "found", "first", "size"]

LONG_LINE = "a line that several of the documents hold"
SENTENCE = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen"

TEXTS = [
    (1, "Hello world"), (2, "Hello  world\n"), (3, "helloworld"), (4, None), (5, ""), (6, " \t\n"), (None, "Hello world"), (None, None),
    (7, f"{SENTENCE}. And more of it."), (8, f"before {SENTENCE.upper()} after"), (9, f"{SENTENCE}. And more of it."),
    (9, f"{SENTENCE}. And more of it."), (10, f"first\n{LONG_LINE}\nlast"), (11, f"  {LONG_LINE.upper()} \n{LONG_LINE}\n"), (12, f"x\n{LONG_LINE}"),
    (13, "ab" * 3000), (14, "ab" * 700 + "c" + "ab" * 500), (15, "é" * 150 + "日本語 " * 90), (16, "é" * 150 + "日本語 " * 90 + "tail"),
    (17, "word " * 4000), (18, f"{LONG_LINE}\n" * 7), (19, "x" * 199), (20, "x" * 199), (21, "y" * 200), (22, "퟿▁ \x00\x0b end"),
]


def documents(spark, rows=TEXTS):
    kind = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
                         *[T.StructField(c, T.StringType()) for c in CLASHING]])
    return spark.createDataFrame([(i, t, *[None if k % 2 else c for k, c in enumerate(CLASHING)]) for i, t in rows], kind).repartition(3)


def none(spark):
    return documents(spark, [])


def key(row):
    """Sorts rows with nulls."""
    return repr(row)
