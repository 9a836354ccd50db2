"""Flat token files: odd rows, places against the written files, blocks with very many ends."""

import time

import numpy as np
import pytest
from tokenizers import Tokenizer

from acctrisk.llm import bpe, tokens


@pytest.fixture(scope="module")
def tokenizer():
    own = Tokenizer.from_file(bpe.default_path())
    own.encode_special_tokens = True
    return own


def test_odd_rows_and_places(spark, tokenizer, monkeypatch, tmp_path):
    monkeypatch.setattr(tokens, "FILE_DOCUMENTS", 3)
    folder = f"{tmp_path}/flat"
    monkeypatch.setattr(tokens, "shared_folder", lambda spark, kind: folder)
    long = "a long text about nothing much at all " * 20_000
    rows = [(1, "one two three"), (1, "one two three"), (2, None), (3, ""), (None, "no id <|endoftext|>"), (4, long), (5, "é ß 日本"), (6, " \n ")]
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, n_tokens int, file string").repartition(2)
    docs.write.parquet(f"{tmp_path}/docs")
    got = tokens.token_counts(spark, f"{tmp_path}/docs").collect()
    count = lambda t: len(tokenizer.encode(t or "", add_special_tokens=False).ids)
    assert sorted((r.doc_id is None, r.doc_id, r.n_tokens) for r in got) == sorted((i is None, i, count(t)) for i, t in rows)
    files = {p.name: np.fromfile(p, "<u2") for p in (tmp_path / "flat").rglob("part-*")}
    texts = {}
    for r in got:
        ids = files[r.flat_file][r.start:r.start + r.n_tokens + 1]
        assert ids[-1] == tokens.END_OF_DOCUMENT and (ids[:-1] != tokens.END_OF_DOCUMENT).all()
        assert (files[r.flat_file][:r.start] == tokens.END_OF_DOCUMENT).sum() == r.ordinal
        texts.setdefault(r.doc_id, []).append(tokenizer.decode(ids[:-1].tolist()))
    assert texts[4] == [long] and texts[1] == ["one two three"] * 2 and texts[5] == ["é ß 日本"]


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string").write.parquet(f"{tmp_path}/docs")
    assert tokens.token_counts(spark, f"{tmp_path}/docs").count() == 0


def test_many_ends_in_a_block(spark, tmp_path):
    lengths = np.random.default_rng(3).integers(0, 2, 200_000)
    flat = np.concatenate([np.append(np.ones(n, np.int64), 9) for n in lengths] + [np.ones(5, np.int64)]).astype("<u2")
    (tmp_path / "part-0").write_bytes(flat.tobytes())
    for block in (1 << 18, 1000):
        began = time.time()
        spans = tokens.document_spans(tokens.scan_blocks(spark, str(tmp_path), 9, block)).orderBy("ordinal").toPandas()
        assert time.time() - began < 60  # 16,000 ends took 132 s where an element rebuilt its array
        assert spans["n_tokens"].tolist() == [*lengths.tolist(), 5]
        assert spans["ended"].tolist() == [True] * 200_000 + [False]
        assert spans["start"].tolist() == np.concatenate([[0], np.cumsum(lengths + 1)]).tolist()


def test_ids_that_do_not_fit_raise():
    assert tokens._narrow(np.array([1, 65535], np.uint32), 9) == b"\x01\x00\xff\xff"
    for bad in ([65536], [9]):
        with pytest.raises(ValueError):
            tokens._narrow(np.array(bad, np.uint32), 9)
