"""Keys and texts join only the rows of sketches whose texts are apart."""

from pyspark.sql import functions as F

from rosterlink.llm import order_minhash


def test_keys_come_with_the_texts(spark):
    """1 and 2 meet in sketch 2 for the first time; 3 and 4 have met in sketch 0."""
    text = " ".join(f"w{i}" for i in range(40))
    texts = spark.createDataFrame(
        [(0, "nothing like it " * 13, [8, 9, 7])]
        + [(n, text.replace("w7", f"x{n}", 1), keys) for n, keys in ((1, [1, 2, 7]), (2, [3, 4, 7]), (3, [5, 6, 7]), (4, [5, 0, 7]))],
        "doc_id long, text string, keys array<long>",
    )
    for held, wanted in (([1, 2], [(1, 2)]), ([3, 4], [])):
        buckets = texts.filter(F.col("doc_id").isin(0, *held)).select(
            F.lit(2).alias("s"), F.lit(7).cast("long").alias("key"), "doc_id", F.lit(40).cast("long").alias("n"),
            F.struct(F.lit(0).cast("long").alias("doc_id"), F.lit(40).cast("long").alias("n")).alias("top"),
        )
        grouped = spark.createDataFrame([], "node long, component long")
        found = order_minhash.links_apart(buckets, grouped, texts)
        assert [(r["a"], r["b"]) for r in found.collect()] == wanted
