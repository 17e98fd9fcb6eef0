"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing extra columns, for every operator."""

import random

import pytest
from fieldloom.llm import bpe, chat, common, media, mixing, quality_mil, quality_rules, simhash, substring_dedup, suffix_dedup, toxicity
from pyspark.sql import functions as F

random.seed(5)
WORDS = ["alpha", "beta", "gamma", "delta", "the", "of", "and", "zeta,", "eta.", "x"]
LONG = " ".join(random.choice(WORDS) for _ in range(30_000))
PASSAGE = " ".join(f"w{k}" for k in range(60))
ROWS = [
    (1, PASSAGE, "en", "a"),
    (2, None, "en", "a"),
    (None, "one " + PASSAGE + " two", None, None),
    (3, "", "fr", "b"),
    (4, PASSAGE + " tail", "en", "b"),
    (4, PASSAGE + " tail", "en", "b"),
    (5, LONG, "de", None),
    (6, "a" * 20_000, "de", "c"),
    (7, "!" * 500 + "\n\n" + " " * 3000, "de", "c"),
    (8, "\x00<|endoftext|>é  日本 <|im_end|>", "de", "c"),
]
EXTRA = ["_c0", "_c1", "_th", "_spans", "_id", "_size", "_key", "_copies", "_text", "p_toxic", "toxic", "key", "content", "doc", "n_words", "a", "n", "fp", "ids", "spans"]


@pytest.fixture(scope="module")
def docs(spark):
    own = spark.createDataFrame(ROWS, "doc_id long, text string, lang string, source string").withColumn("n_chars", F.length("text").cast("long"))
    return own.withColumns({c: F.lit(f"extra {c}") for c in EXTRA})


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (3, 0, None), (None, 1, 1), (5, 1, 1), (6, 0, 0), (7, 0, 0), (4, 1, 0), (8, 1, 1), (99, 1, 1)], "doc_id long, quality int, toxic int")


OPERATORS = {
    "quality": lambda d, lab: quality_mil.score(d, quality_mil.train(d, lab.select("doc_id", F.col("quality").alias("y"))), ["doc_id"]),
    "toxicity": lambda d, lab: toxicity.score(d, toxicity.train(d, toxicity.table_labels(lab), toxicity.CATEGORIES), ["doc_id"]),
    "substrings": lambda d, lab: substring_dedup.digest(d),
    "substrings_text": lambda d, lab: substring_dedup.remove_repeats(d),
    "rules": lambda d, lab: quality_rules.verdicts(d, d.columns),
    "mixing": lambda d, lab: mixing.mixed(d),
    "bpe": lambda d, lab: bpe.round_trip(d),
    "bpe_ids": lambda d, lab: bpe.encode(d),
    "simhash": lambda d, lab: simhash.near_classes(d),
    "similar": lambda d, lab: simhash.similar_classes(d),
    "media": lambda d, lab: (s := media.Store(d)).lists.join(s.values(), "key"),
    "suffixes": lambda d, lab: suffix_dedup.digest(d),
    "suffixes_text": lambda d, lab: suffix_dedup.remove_repeats(d),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_every_row_has_a_result(docs, labels, name):
    assert OPERATORS[name](docs, labels).count() == len(ROWS)


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_tables(docs, labels, name):
    assert OPERATORS[name](docs.limit(0), labels.limit(0)).count() == 0


def test_filters_return_the_callers_columns(docs, labels):
    for out in (toxicity.drop_toxic(docs, labels), simhash.drop_near_copies(docs), substring_dedup.remove_repeats(docs), mixing.mix(docs), suffix_dedup.remove_repeats(docs)):
        assert out.columns == docs.columns
        row = out.first()
        assert row is None or all(row[c] == f"extra {c}" for c in EXTRA)


def test_pipeline_stages_take_every_row(spark, docs, labels, tmp_path):
    """Nulls, empty and long texts, repeated rows, clashing columns and empty tables, stage after stage as the pipeline runs them."""
    import corpus_pipeline

    labels.write.parquet(f"{tmp_path}/labels.parquet")
    for table in (docs, docs.limit(0)):
        kept = table
        for name, stage in corpus_pipeline.STAGES:
            kept = common.written(stage(spark, kept, str(tmp_path)), name)
            if name != "bpe":
                assert kept.columns == docs.columns
        assert kept.columns[:2] == ["doc_id", "n_tokens"] and (kept.count() > 0) == (table.count() > 0)


def test_written_tables_can_be_dropped(spark, tmp_path):
    kept = common.written(spark.range(3), "trial")
    assert kept.count() == 3 and f"fieldloom/{spark.sparkContext.applicationId}/" in kept.inputFiles()[0]
    common.drop_written(kept)
    with pytest.raises(Exception):  # noqa: B017  the files are gone
        spark.read.parquet(kept.inputFiles()[0].rsplit("/", 1)[0]).count()


def test_chat_keeps_callers_columns_apart(spark):
    talk = spark.createDataFrame([(1, 0, "user", "hi"), (1, 1, "assistant", "yo")], "conv_id long, turn long, role string, text string")
    clash = talk.withColumns({c: F.lit(f"extra {c}") for c in ("conv", "id", "parent", "score", "depth", "up", "leaf", "rank", "c", "p")})
    one, other = (chat.formatted(chat.from_turns(x)).select("formatted", "mask").collect() for x in (talk, clash))
    assert one == other and len(one) == 1


def test_filters_of_nothing(docs, labels):
    none = docs.limit(0)
    for out in (toxicity.drop_toxic(none, labels.limit(0)), simhash.drop_near_copies(none), mixing.mix(none)):
        assert out.count() == 0


def test_substrings_of_null_and_repeated_rows(docs):
    got = {(r.doc_id, r.n_words): r.n_removed for r in substring_dedup.digest(docs).collect()}
    assert got[(1, 60)] == 60 and got[(None, 62)] == 60 and got[(4, 61)] == 61 and got[(2, 0)] == 0 and got[(3, 0)] == 0


def test_suffixes_keep_the_first(docs):
    got = {(r.doc_id, r.n_bytes): r.n_removed for r in suffix_dedup.digest(docs).collect()}
    n = len(PASSAGE)
    assert got[(1, n)] == 0  # the first copy
    assert got[(4, n + 5)] == n  # the tail alone is new; rows of one id and text are one document
    assert got[(None, n + 8)] == n + 2  # a missing id comes last, and " t" also follows the passage in 4
    assert got[(6, 20_000)] == 19_999  # every string but the first of a run starts earlier too


def test_simhash_of_nothing_links(docs):
    got = {r.doc_id: (r.fp, r.component_id) for r in simhash.near_classes(docs).collect()}
    assert got[2] == (0, 2) and got[3] == (0, 2)


def test_media_shares_values(docs):
    store = media.Store(docs)
    got = store.lists.join(store.values(), "key").collect()
    empty = [r for r in got if r.doc_id in (2, 3)]
    assert [r.payload_bytes for r in empty] == [192, 192] and empty[0].media_sha256 == empty[1].media_sha256


def test_chat_edges(spark):
    rows = [(1, 0, "user", None), (1, 1, None, "x"), (1, 1, "assistant", "<|im_start|>"), (None, 0, "assistant", "y<||"), (2, 5, "a\nb", "z")]
    talk = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("conv", F.lit(9)).withColumn("id", F.lit(1))
    out = chat.formatted(chat.from_turns(talk))
    got = {r.conv: r for r in out.select("conv", chat.parsed(F.col("formatted")).alias("t"), chat.learned(F.col("formatted"), F.col("mask")).alias("loss")).collect()}
    assert [(t.role, t.text) for t in got[1].t] == [("user", ""), ("", "x"), ("assistant", "<|im_start|>")]
    assert got[1].loss == "<|im_start|>" and got[None].loss == "y<||" and got[2].t[0].role == "a\nb" and got[2].loss == ""
    assert chat.formatted(chat.from_turns(talk.limit(0))).count() == 0
