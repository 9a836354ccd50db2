"""Every operator on missing values, empty and long texts, ties, repeated rows, empty tables and odd columns."""

import pytest
from pyspark.sql import functions as F

from acctrisk.llm import exact, jaccard, lines, mixing, neighbours, packing, quality, shards, warc
from acctrisk.llm.common import shared_folder

LONG = "a long text about nothing much at all " * 3000
DOCS = "doc_id long, text string, source string, kept string, n int, `mix_block` string, shard string"
ROWS = [
    (1, "one two three four five six", "a"), (1, "one two three four five six", "a"), (2, None, None), (3, "", "b"),
    (None, "one  two\tthree four five six", "b"), (4, LONG, "a"), (5, LONG, "a"), (6, "é ß 日本", None), (7, " \n ", "c"),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(*r, "x", 1, "y", "z") for r in ROWS], DOCS)


@pytest.fixture(scope="module")
def empty(docs):
    return docs.where("false")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1), (4, 1), (6, 0), (None, 1), (3, None), (99, 0)], "doc_id long, quality int")


def test_exact(docs, empty):
    rows = exact.mark_duplicates(docs).collect()
    assert len(rows) == len(ROWS)
    assert [r["keep_id"] for r in rows if r["group_size"] == 3] == [1, 1, 1]
    assert {(r["doc_id"], r["keep_id"]) for r in rows if r["doc_id"] in (2, 3)} == {(2, 2), (3, 2)}
    kept = exact.drop_duplicates(docs)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == [1, 2, 4, 6, 7]
    assert exact.mark_duplicates(empty).count() == exact.drop_duplicates(empty).count() == 0


def test_lines(docs, empty):
    out = {(r["doc_id"], r["n_lines"], r["n_dropped"], r["kept_text"]) for r in lines.dedup_lines(docs).collect()}
    assert (2, 1, 0, "") in out and (3, 1, 0, "") in out and (7, 2, 0, " \n ") in out
    assert lines.dedup_lines(empty).count() == 0


def test_shards(docs, empty):
    rows = shards.assign_shards(docs, 3).collect()
    assert len(rows) == len(ROWS)
    for s in {r["shard"] for r in rows}:
        assert sorted(r["slot"] for r in rows if r["shard"] == s) == list(range(sum(r["shard"] == s for r in rows)))
    assert shards.assign_shards(empty).count() == 0


def test_mixing(docs, empty):
    out = mixing.mix(docs, {"a": 3, None: 2}, block_rows=2)
    assert sorted(r["mix_position"] for r in out.collect()) == list(range(len(ROWS)))
    assert mixing.in_mixed_order(docs).columns == docs.columns
    assert mixing.mix(empty).count() == 0
    with pytest.raises(ValueError):
        mixing.mix(docs, {"a": 0})


def test_packing(docs, empty):
    rows = packing.pack_documents(docs).collect()
    assert sum(r["doc_id"] == 4 for r in rows) > 1 and max(r["length"] for r in rows) <= 2048
    assert [r["length"] for r in rows if r["doc_id"] in (2, 3)] == [1, 1]
    assert packing.pack_documents(empty).count() == 0


def test_jaccard(docs, empty):
    rows = jaccard.similar_texts(docs).collect()
    assert len(rows) == len(ROWS)
    by = {r["doc_id"]: r for r in rows}
    assert by[5]["component_id"] == 4 and by[4]["component_id"] == 4
    assert by[2]["n_shingles"] == by[3]["n_shingles"] == by[7]["n_shingles"] == 0 and by[3]["component_id"] == 3
    assert by[6]["n_shingles"] == 1 and by[1]["component_id"] is None  # the row without id comes first
    assert jaccard.drop_similar(docs).columns == docs.columns
    assert jaccard.similar_texts(empty).count() == 0


def test_quality(docs, empty, labels):
    rows = quality.resample(docs, labels, share=0.5).collect()
    assert len(rows) == len(ROWS) and all(r["log_weight"] == 0 and r["accepted"] for r in rows if r["doc_id"] in (2, 3))
    assert 4 <= sum(r["selected"] for r in rows) <= 6
    assert quality.accepted_documents(docs, labels).columns == docs.columns
    assert quality.resample(empty, labels).count() == 0
    assert quality.accepted_documents(docs, labels.where("false")).count() == len(ROWS)


def test_warc(spark):
    html = "<p>" + "x" * 200 + "\r\n\r\nWARC/1.1\r\n"
    pages = [(3, "http://a/ b\r\n", html), (1, None, html), (2, "u", html), (4, "u", "short"), (5, "u", "short"), (6, "u", None), (7, "u", ""),
             (None, "u", "none"), (8, "u", "é" * 40_000)]
    table = spark.createDataFrame([(*p, "x") for p in pages], "page_id long, url string, html string, digest string")
    out = {r["page_id"]: r for r in warc.archive_pages(table, shared_folder(spark, "t")).collect()}
    assert len(out) == len(pages) and out[1]["record_type"] == "response" and out[3]["refers_to"] == out[2]["refers_to"] == 1
    assert out[5]["record_type"] == "response" and out[8]["payload_bytes"] == 80_000 and out[6]["payload_bytes"] == 0
    assert warc.archive_pages(table.where("false"), shared_folder(spark, "t")).count() == 0


def test_warc_records_are_rebuilt_exactly(spark):
    pages = spark.createDataFrame([(1, "u", "y" * 150), (2, "v", "y" * 150), (3, "w", "z")], "page_id long, url string, html string")
    folder = shared_folder(spark, "t")
    warc.write_archive(warc.with_types(warc.as_records(pages)), f"{folder}/warc")
    payloads, heads = warc.store(spark, f"{folder}/warc", folder)
    whole = sorted((bytes(r["head"]) + bytes(r["payload"] or b"")) for r in warc.read_archive(spark, f"{folder}/warc").collect())
    assert sorted(bytes(r["record"]) for r in warc.reconstruct(heads, payloads).collect()) == whole
    assert payloads.count() == 2


def test_warc_long_payloads_are_stored_once(spark):
    pages = [(1, "u", "y" * 150), (1, "v", "y" * 150), (2, "w", "y" * 150), (None, "u", "z" * 200), (None, "v", "z" * 200), (3, "u", ""), (4, "u", None)]
    table = spark.createDataFrame(pages, "page_id long, url string, html string")
    out = warc.archive_pages(table, shared_folder(spark, "t")).collect()
    assert sorted((r["page_id"] or 0, r["payload_bytes"], r["record_type"], r["refers_to"]) for r in out) == [
        (0, 200, "response", None), (0, 200, "response", None), (1, 150, "response", None), (1, 150, "response", None),
        (2, 150, "revisit", 1), (3, 0, "response", None), (4, 0, "response", None)]
    folder = shared_folder(spark, "t")  # by a writer that repeats every payload
    plain = warc.as_records(table).withColumn("refers_to", F.lit(None).cast("long"))
    warc.write_archive(plain, f"{folder}/warc")
    payloads, heads = warc.store(spark, f"{folder}/warc", folder)
    assert payloads.count() == 3
    whole = sorted(bytes(r["head"]) + bytes(r["payload"]) for r in warc.read_archive(spark, f"{folder}/warc").collect())
    assert sorted(bytes(r["record"]) for r in warc.reconstruct(heads, payloads).collect()) == whole


def test_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [2.0, 0.1]), (4, [0.0, 1.0]), (5, None), (6, [0.0, 0.0]), (7, [nan, 1.0]), (8, [inf, 1.0]),
            (9, [None, 1.0]), (10, [1.0, 0.0, 0.0]), (11, []), (None, [1.0, 0.0]), (12, [1e300, 0.0])]
    table = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<double>, n_links string")
    out = {r["vec_id"]: r for r in neighbours.near_duplicates(table).collect()}
    assert len(out) == len(rows)
    assert {i for i, r in out.items() if r["component_id"] == 1} == {1, 2, 3, 12} and out[1]["n_links"] == 3
    assert all(out[i]["n_links"] == 0 and out[i]["kept"] for i in (4, 5, 6, 7, 8, 9, 10, 11))
    assert neighbours.near_duplicates(table.where("false")).count() == 0
