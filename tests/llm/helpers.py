"""Small tables with the cases that every operator must take: nulls, empty and long texts, ties, repeats, clashing columns."""

import random

from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"
#: Names of columns that the operators use inside or make.
NAMES = ("key", "rep", "bucket", "SCORE", "n", "runs", "row", "seed", "found", "v", "u", "node", "bands", "class_id", "k1", "h", "f", "at", "item_id", "_key", "_also", "_runs", "_runs_key", "_guess", "IDS", "n_pieces", "Round_Trip", "Lang_Pred", "a.b", "tree", "place", "labels", "turns", "gone")
DOCS = "doc_id long, text string, lang string, source string, n_chars int"


def documents(spark, texts, ids=None, langs=None):
    rows = [(ids[i] if ids else i, t, langs[i] if langs else "en", "s", None if t is None else len(t)) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS).repartition(3)


def clashing(df):
    """The same rows with columns whose names the operators use inside."""
    return df.withColumns({c: F.lit("x") for c in NAMES if c.lower() not in {d.lower() for d in df.columns}})


def prose(rng: random.Random, n: int) -> str:
    return " ".join("".join(rng.choice("an er the ou st é in ing re".split()) for _ in range(rng.randrange(1, 5))) for _ in range(n))
