"""Columns of a caller's table that have a name which an operator uses inside, and undeclared fields of records."""

import json

import pytest

from vistaspark.llm import byte_bpe, chat, decontaminate, ngram_join, quality, toxicity

SF = "/root/testdata/sf0.001"
INNER = ["_rid", "__rid", "_d", "_node", "_words", "node", "label", "rid", "n", "n_words", "kept", "base_failed", "word_length", "hi_repeat_share", "_w", "_row",
         "decoded", "ids", "size", "shard"]


@pytest.fixture(scope="module")
def docs(spark):
    """Documents with a column of every inner name, whose values say which row they belong to."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    return docs.selectExpr("*", *[f"doc_id * 100 + {i} AS `{c}`" for i, c in enumerate(INNER)])


def whole(rows):
    rows = rows.collect()
    assert rows and all(r[c] == r.doc_id * 100 + i for r in rows for i, c in enumerate(INNER))
    return {r.doc_id for r in rows}


def plain(docs):
    return docs.drop(*INNER)


def test_stages_keep_the_callers_columns(spark, docs):
    labels, items = spark.read.parquet(f"{SF}/labels.parquet"), spark.read.parquet(f"{SF}/benchmark.parquet")
    for stage in (lambda d: decontaminate.without_contaminated(d, items), lambda d: toxicity.without_toxic(d, labels), ngram_join.one_of_each_group,
                  quality.keep_good):
        kept = stage(docs)
        assert kept.columns == docs.columns
        assert whole(kept) == {r.doc_id for r in stage(plain(docs)).collect()}


def test_judge_replaces_columns_of_its_own_names(docs):
    want = {tuple(r[c] for c in ["doc_id", *quality.BASE_COLUMNS]) for r in quality.judge(plain(docs)).collect()}
    assert {tuple(r[c] for c in ["doc_id", *quality.BASE_COLUMNS]) for r in quality.judge(docs).collect()} == want


def test_decode_replaces_decoded(spark):
    rows = spark.createDataFrame([(1, [104, 105], "old"), (2, None, "old")], "doc_id long, ids array<int>, decoded string")
    out = byte_bpe.decode(rows)
    assert sorted(out.columns) == ["decoded", "doc_id", "ids"]
    tokens = {i: b for b, i in byte_bpe.load_ranks(byte_bpe.ranks_path()).items()}
    assert {r.doc_id: r.decoded for r in out.collect()} == {1: bytearray(tokens[104] + tokens[105]), 2: None}


def test_turn_tables_with_other_columns(spark):
    rows = spark.createDataFrame([(1, 0, "user", "hi", "m1", 3, "z")], "conv_id long, turn long, role string, text string, model string, n int, content string")
    assert [tuple(r) for r in chat.turns_of_table(rows).collect()] == [(1, 0, "user", "hi")]  # the first layout of the two
    with pytest.raises(ValueError, match="no mapping"):
        chat.turns_of_table(rows.drop("text", "content"))


def test_records_with_undeclared_fields_and_empty_lists(spark):
    turns = [{"role": "user", "content": "a"}, {"role": "assistant", "content": None}]
    records = [{"messages": turns, "model": "m", "meta": {"x": [1]}}, {"messages": [turns[0] | {"name": "bob"}]}, {"messages": []}, {"messages": None},
               {"prompt": "p", "response": "r", "tags": []}, {"messages": [turns[0], "loose"]}, {"other": 1}, [1]]
    table = spark.createDataFrame([(i, json.dumps(r)) for i, r in enumerate(records)] + [(8, None), (9, "{")], "id long, json string")
    got = sorted((r.conv_id, r.turn or 0, r.role, r.text) for r in chat.turns_of_json(table, "id", "json").collect())
    assert got == [(0, 0, "user", "a"), (0, 1, "assistant", ""), (1, 0, "user", "a"), (4, 0, "user", "p"), (4, 1, "assistant", "r"),
                   *[(i, 0, None, None) for i in (5, 6, 7, 8, 9)]]
