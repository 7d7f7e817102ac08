"""Nulls, empty and long texts, repeated rows, empty tables and columns with clashing names."""

import pytest
import public_tokenizers

from paceline.llm import decontaminate, huffman, language, media, mixing, passages, quality, simhash, suffix_dedup, token_counts

LONG = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen " * 3000
WIDE = "copy int, shuffle_key string, fp long, anchor long, data string, spans int, d int, tie int, node long, rate double"
SCHEMA = f"doc_id long, text string, lang string, source string, n_chars long, {WIDE}"


def table(spark, rows):
    return spark.createDataFrame([(*r, *[None] * 10) for r in rows], SCHEMA)


@pytest.fixture(scope="module")
def edges(spark):
    return table(
        spark,
        [
            (1, None, None, None, None), (2, "", "en", "a", 0), (3, " \t\n", "en", "a", 3), (4, LONG, "en", "a", len(LONG)),
            (5, LONG, "fr", "a", len(LONG)), (5, LONG, "fr", "a", len(LONG)), (None, "a text of its own", "fr", None, 17),
            (6, "É" * 400, "fr", "b", 400), (7, "\x00odd\x0bwords 12", None, "b", 13),
        ],
    )


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(4, 1), (5, 0), (6, None), (None, 1)], "doc_id long, quality int")


@pytest.fixture(scope="module")
def benchmark(spark):
    rows = [("b1", LONG[:90]), ("b2", None), ("b3", ""), (None, "a text of its own"), ("b4", "É" * 400)]
    return spark.createDataFrame(rows, "item_id string, text string")


def operators(labels, benchmark):
    return {
        "decontaminate": lambda d: decontaminate.report(decontaminate.contamination(d, benchmark)),
        "media": media.media_columns,
        "token_counts": lambda d: token_counts.token_counts(d, public_tokenizers.path(token_counts.VOCABULARY)),
        "quality": lambda d: quality.score(d, quality.train(d, labels)),
        "token_output": lambda d: huffman.token_output(d, public_tokenizers.path(huffman.VOCABULARY)),
        "language": lambda d: language.identify(d, language.train(d)),
        "passages": passages.near_passages,
        "simhash": simhash.near_duplicates,
        "suffixes": suffix_dedup.remove_repeats,
    }


NAMES = ["decontaminate", "media", "token_counts", "quality", "token_output", "language", "passages", "simhash", "suffixes"]


@pytest.mark.parametrize("name", NAMES)
def test_every_row_has_a_result(edges, labels, benchmark, name):
    got = operators(labels, benchmark)[name](edges).select("doc_id").collect()
    assert sorted(str(r.doc_id) for r in got) == sorted(["1", "2", "3", "4", "5", "5", "6", "7", "None"])


@pytest.mark.parametrize("name", NAMES)
def test_empty_table(spark, labels, benchmark, name):
    assert operators(labels, benchmark)[name](table(spark, [])).collect() == []


def test_filters_keep_columns(edges, labels, benchmark, spark):
    for kept in (
        quality.keep_good(edges, quality.train(edges, labels), threshold=0.0),
        simhash.keep_one(edges),
        decontaminate.clean(edges, benchmark),
    ):
        assert kept.columns == edges.columns
        kept.collect()
    assert {r.doc_id for r in decontaminate.clean(edges, benchmark).collect()} == {1, 2, 3, None, 7}
    assert {r.doc_id for r in simhash.keep_one(edges).collect()} == {1, 4, None, 6, 7}
    assert simhash.keep_one(edges).count() == 5


def test_mixing(edges, spark):
    assert mixing.mix(table(spark, [])).collect() == []
    thick = mixing.mix(edges, {"a": 1.0}, total=4000.0).collect()
    assert {r.source for r in thick} == {"a"} and 3500 < len(thick) < 4500


def test_near_copies_in_one_component(edges):
    got = {r.doc_id: r for r in simhash.near_duplicates(edges).collect()}
    assert got[1].fingerprint == got[2].fingerprint == got[3].fingerprint == "0" * 16
    assert got[3].component_id == 1 and got[5].component_id == 4


def test_repeats_within_a_text(edges):
    got = {r.doc_id: r for r in suffix_dedup.remove_repeats(edges).collect()}
    period = len("one two three four five six seven eight nine ten eleven twelve thirteen fourteen ")
    assert len(got[4].kept) == period
    assert bytes(got[5].kept) == b"" and got[1].n_bytes == 0 and got[6].n_bytes == 800
