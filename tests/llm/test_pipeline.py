import hashlib
import random

import public_tokenizers
import sentencepiece

import corpus_pipeline
from gridhead.llm import decontaminate, near_dup, quality, suffix_dedup
from gridhead.llm.common import table, written
from tests.llm.helpers import DOCS, SF, clashing, prose
from tests.llm.test_near_dup import brute as classes
from tests.llm.test_suffix_dedup import brute as repeats


def test_stages_one_by_one(spark):
    docs = table(spark, SF, "documents")
    columns = docs.columns
    stages = dict(corpus_pipeline.STAGES)

    def step(name, before):
        after = written(stages[name](spark, before, SF), "test-stage")
        return after, [{r.doc_id: r for r in d.collect()} for d in (before, after)]

    good, (before, after) = step("quality classifier", docs)
    judged = quality.score_quality(docs, table(spark, SF, "labels")).where("predicted = 1").collect()
    assert good.columns == columns and set(after) == {r.doc_id for r in judged}
    assert all(before[k] == r for k, r in after.items())

    single, (before, after) = step("MinHash near-dedup", good)
    ids = sorted(before)
    least = classes([before[i].text for i in ids])
    assert single.columns == columns and set(after) == {i for k, i in enumerate(ids) if least[k] == k}

    cut, (before, after) = step("suffix-array dedup", single)
    ids = sorted(before)
    for i, (n, gone, _, sha) in zip(ids, repeats([before[i].text for i in ids]), strict=True):
        assert (len(after[i].text.encode()) <= n - gone) and after[i].n_chars == len(after[i].text)
        if hashlib.sha256(after[i].text.encode()).hexdigest() != sha:
            assert "�" not in after[i].text  # only a character that a span cut may go besides
    assert cut.columns == columns

    clean, (before, after) = step("benchmark decontamination", cut)
    held = {r.doc_id for r in decontaminate.contaminated(cut, table(spark, SF, "benchmark")).collect()}
    assert clean.columns == columns and set(after) == set(before) - held

    _, (before, after) = step("SentencePiece encoding", clean)
    assert set(before) == set(after) and all(r.round_trip for r in after.values())


def odd_tables(spark, folder, rows):
    """A folder with small tables: the given documents with columns that the operators use inside, and labels that keep all but shouting."""
    rng = random.Random(7)
    taught = [(10_000 + i, prose(rng, 40) if i % 2 else prose(rng, 40).upper() + "!!!", "en", "s", 1) for i in range(200)]
    benchmark = [(1, "one two three four five six seven eight nine ten"), (2, None)]
    tables = {
        "documents": clashing(spark.createDataFrame(rows + (taught if rows else []), DOCS)),
        "labels": spark.createDataFrame([(r[0], int(r[0] % 2), 0) for r in taught], "doc_id long, quality int, toxic int"),
        "benchmark": spark.createDataFrame(benchmark, "item_id long, text string"),
    }
    for name, df in tables.items():
        df.write.parquet(f"{folder}/{name}.parquet")
    return str(folder), taught


def test_odd_documents_go_through_all_stages(spark, tmp_path):
    rng = random.Random(1)
    passage, long = prose(rng, 60), prose(rng, 12_000)
    texts = {0: None, 1: "", 2: prose(rng, 50), 3: long, 4: f"{prose(rng, 30)} {passage} {prose(rng, 30)}", 5: f"{prose(rng, 30)} {passage} {prose(rng, 30)}", 6: f"{prose(rng, 9)} ten nine one two three four five six seven eight nine ten {prose(rng, 9)}"}
    rows = [(k, t, None if k == 2 else "en", "s", None) for k, t in texts.items()]
    rows += [(2, texts[2], "en", "s", None), (None, texts[2], "en", "s", None), (None, None, None, None, None), (8, texts[3] + " x", "en", "s", 1)]
    sf, taught = odd_tables(spark, tmp_path / "odd", rows)
    got = corpus_pipeline.run(spark, sf).collect()
    ids = [r.doc_id for r in got if r.doc_id is None or r.doc_id < 10_000]
    # copies, near copies and benchmark documents are gone, rows without an id are not
    assert sorted(i for i in ids if i is not None) == sorted(i for i in ids if i in (0, 1, 2, 3, 4, 5)) and {2, 3, 4, 5} <= set(ids) and 6 not in ids and 8 not in ids
    assert len(ids) == len(set(ids) - {None}) + ids.count(None) and ids.count(None) <= 2
    assert {r.doc_id for r in got if r.doc_id and r.doc_id >= 10_000} <= {r[0] for r in taught if r[0] % 2}
    assert all(r.round_trip for r in got)
    cut = {r.doc_id: r.n_pieces for r in got}
    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    assert cut[3] == len(sp.encode(long)) and cut[4] < len(sp.encode(texts[4]))


def test_no_documents(spark, tmp_path):
    sf, _ = odd_tables(spark, tmp_path / "none", [])
    assert corpus_pipeline.run(spark, sf).isEmpty()


def test_operators_of_the_stages():
    assert [f.__name__ for _, f in corpus_pipeline.STAGES] == ["good_quality", "one_of_each_class", "without_repeated_passages", "without_benchmark", "encoded"]
    assert corpus_pipeline.ORACLE_SQL is None
    assert near_dup.SIMILARITY == 0.8 and near_dup.SHINGLE == 5 and suffix_dedup.LENGTH == 200
