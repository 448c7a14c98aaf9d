"""Texts that are no valid UTF-8, and columns with clashing names in any case and with dots, through all operators on documents."""

import pytest
import public_tokenizers
from pyspark.sql import functions as F

from gridhead.llm import decontaminate, langid, licenses, merkle, near_dup, pieces, quality, suffix_dedup, token_counts
from tests.llm.helpers import SF, clashing

BPE, SP = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def odd(spark):
    """Documents, two of which hold bytes that are no UTF-8, with further columns; an invalid text is a near copy of another."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(60)
    base = F.concat(F.lit("good words in a row "), F.lit(" ".join(f"w{i}" for i in range(80))))
    wrong = F.expr("cast(x'ff2080c328' as string)")
    extra = spark.range(900, 904).select(F.col("id").alias("doc_id"), F.when(F.col("id") == 900, wrong).when(F.col("id") == 901, F.concat(base, F.lit(" "), wrong)).when(F.col("id") == 902, base).alias("text"), F.lit("en").alias("lang"), F.when(F.col("id") == 903, wrong).otherwise("s").alias("source"), F.lit(1).cast("bigint").alias("n_chars"))
    return clashing(docs.unionByName(extra)).cache()


def test_every_operator_takes_them(spark, odd):
    n = odd.count()
    labels, benchmark = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("labels", "benchmark"))
    assert langid.identify(odd).where("doc_id >= 900").count() == 4
    assert langid.predict(odd, None).select("score", "lang_pred", "`a.b`").count() == n
    assert quality.score_quality(odd, labels).count() == n and quality.keep_good(odd, labels).columns == odd.columns
    found = {r.doc_id: r.class_id for r in near_dup.classes(odd).where("doc_id >= 900").collect()}
    assert found == {900: 900, 901: 901, 902: 901, 903: 903}
    assert near_dup.keep_one(odd).columns == odd.columns
    assert suffix_dedup.removed(odd).where("doc_id >= 900").agg(F.sum("n_removed")).first()[0] > 0
    left = suffix_dedup.without_repeats(odd)
    assert left.columns == odd.columns and left.where("doc_id = 900 AND text = '\ufffd \ufffd\ufffd('").count() == 1
    assert decontaminate.contaminated(odd, benchmark).where("doc_id >= 900").isEmpty()
    assert decontaminate.contaminated(odd, odd.withColumn("item_id", F.col("doc_id")), broadcast_words=0).where("doc_id = 902").count() == 2
    assert decontaminate.keep_clean(odd, benchmark).columns == odd.columns
    encoded = pieces.encode_texts(odd, SP)
    assert encoded.select("ids", "n_pieces", "round_trip", "`a.b`").where("n_pieces > 0").count() == n - 1
    assert token_counts.token_counts(odd, BPE).where("n_tokens > 0").count() == n - 1
    assert licenses.scan(odd).count() == merkle.prove(odd).where("folded_root = root").count() == n


def test_empty_tables(spark, odd):
    none, labels, benchmark = odd.limit(0), *(spark.read.parquet(f"{SF}/{t}.parquet") for t in ("labels", "benchmark"))
    for found in (quality.keep_good(none, labels), near_dup.keep_one(none), suffix_dedup.without_repeats(none), decontaminate.keep_clean(none, benchmark), pieces.encode_texts(none, SP), licenses.scan(none), merkle.prove(none)):
        assert found.isEmpty()
    assert decontaminate.contaminated(odd, benchmark.limit(0)).isEmpty()
