"""Words over a mebibyte, rows without id in the stages, and the order of very many files."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from acctrisk.llm import jaccard, lines, packing, quality, warc, words


@pytest.mark.parametrize("by_kind", [False, True])
def test_long_words_are_whole(monkeypatch, by_kind):
    random.seed(4)
    parts = ["a" * 70, "b1" * 40, " ", "c" * 33, "  ", "é" * 60, "12345" * 20, "..", "x"]
    texts = ["".join(random.choices(parts, k=30)) for _ in range(50)]
    tables, array = words.powers(), pa.array(texts)
    whole = list(words.words_of(array, tables, by_kind=by_kind))
    monkeypatch.setattr(words, "CHUNK", 64)
    for cut, full, text in zip(words.words_of(array, tables, by_kind=by_kind), whole, texts):
        assert cut.tolist() == full.tolist()
        if not by_kind:
            assert len(cut) == len(re.findall(r"[^\x20\x09-\x0D]+", text))


def test_a_word_of_eight_mebibytes_is_one_shingle(spark):
    long = "q" * (8 << 20)
    docs = spark.createDataFrame([(1, long), (2, long[:-1] + "r"), (3, long), (4, "a few words")], "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.similar_texts(docs).collect()}
    assert got == {1: (1, 1), 2: (1, 2), 3: (1, 1), 4: (1, 4)}


def test_rows_without_id_are_judged_by_their_text(spark):
    random.seed(9)
    good = lambda: " ".join(random.choices("the river runs to the sea and light falls on stone".split(), k=60))
    junk = lambda: " ".join(random.choices(["$$$", "###", "xx1", "buy!!!", "0x0"], k=60))
    rows = [(i, good() if i % 2 else junk()) for i in range(80)] + [(None, good()), (None, junk()), (1, junk()), (None, None)]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, text_hash string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(2, 60)], "doc_id long, quality int")
    kept = quality.accepted_documents(docs, labels)
    assert kept.columns == docs.columns
    found = [(r.doc_id, r.text) for r in kept.collect()]
    assert sorted(map(str, found)) == sorted(str(r) for r in rows if r[1] is None or "river" in r[1] or "the" in r[1].split())


def test_near_copies_without_id_go(spark):
    base = [f"word{i}" for i in range(300)]
    copy = lambda k: " ".join([*base[:k], "other", *base[k + 1:]])
    rows = [(None, copy(5)), (None, copy(290)), (None, "alone and quite different from all"), (3, "a third text that is near to nothing"), (7, None)]
    kept = [(r.doc_id, r.text) for r in jaccard.drop_similar(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert len(kept) == 4 and sum(t is not None and "word1" in t.split() for _, t in kept) == 1
    rows.append((9, copy(100)))  # an id of its own is above those of rows without
    kept = [(r.doc_id, r.text) for r in jaccard.drop_similar(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert len(kept) == 4 and 9 not in [i for i, _ in kept]


def test_files_follow_their_numbers(spark):
    names = ["part-99999-a.parquet", "part-100000-a.parquet", "part-00002-b.parquet"]
    rows = [(i, 0, n, r) for i, (n, r) in enumerate([(n, r) for n in names for r in range(2)])]
    pieces = spark.createDataFrame(rows, "doc_id long, piece int, __file string, __row long")
    got = {r.doc_id: r["__pos"] for r in packing._positions(pieces).collect()}
    assert got == {4: 0, 5: 1, 0: 2, 1: 3, 2: 4, 3: 5}


def test_hash_of_a_word_does_not_depend_on_its_place():
    tables = words.powers()
    a, = words.words_of(pa.array(["zebra " + "y" * 100]), tables)
    b, = words.words_of(pa.array(["y" * 100 + " zebra"]), tables)
    assert np.array_equal(a, b[::-1])


def test_small_pages_fill_many_files(spark):
    """Headers count, and pages without payload spread over all files."""
    pages = spark.range(6000).selectExpr("id AS page_id", "concat('http://x/', id) AS url", "CAST(NULL AS STRING) AS html")
    typed = warc.with_types(warc.as_records(pages), segment_bytes=400_000)
    sizes = [r["count"] for r in typed.groupBy(F.spark_partition_id()).count().collect()]
    assert len(sizes) == 9 and max(sizes) < 2 * 6000 / 9
    assert typed.where("refers_to IS NOT NULL").count() == 0


def test_heavy_payloads_spread_and_refer(spark):
    html = F.when(F.col("id") % 3 == 0, F.repeat(F.lit("same"), 50)).when(F.col("id") % 3 == 1, F.concat(F.repeat(F.lit("x"), 100), F.col("id") % 1000)).otherwise("short")
    pages = spark.range(6000).select(F.col("id").alias("page_id"), F.concat(F.lit("u"), "id").alias("url"), html.alias("html"))
    typed = warc.with_types(warc.as_records(pages), segment_bytes=400_000)
    got = {r["id"]: r["refers_to"] for r in typed.select("id", "refers_to").collect()}
    first = {}
    for i in range(6000):
        key = 0 if i % 3 == 0 else ("x", i % 1000) if i % 3 == 1 else ("short", i)
        first.setdefault(key, i)
        assert got[i] == (first[key] if first[key] != i else None)
    sizes = [r["count"] for r in typed.where(F.col("id") % 3 == 0).groupBy(F.spark_partition_id()).count().collect()]
    assert max(sizes) < 2 * 2000 / len(sizes) and len(sizes) > 5


def test_heavy_and_rare_lines_go_alike(spark):
    heavy, rare = "h" * 45, "r" * 45
    text = F.concat_ws("\n", F.lit(heavy), F.concat(F.lit("own line of this very document, which is long "), "id"), F.when(F.col("id") < 5, rare))
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), text.alias("text"))
    got = {r["doc_id"]: r["kept_text"].split("\n") for r in lines.dedup_lines(docs).collect()}
    assert [i for i in got if heavy in got[i]] == [2999] and [i for i in got if rare in got[i]] == [4]
    assert all(f"own line of this very document, which is long {i}" in got[i] for i in got)
