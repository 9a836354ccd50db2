"""Encoding by the agenda against the sentencepiece library, on whole tables and odd texts."""

import hashlib
import random

import pytest
import sentencepiece

import __spark_entry__ as entry
from acctrisk.llm import pieces


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=pieces.default_path())


def digest(text):
    return hashlib.sha256(text.encode("utf-8")).hexdigest()


def test_query_equals_the_library(spark, library):
    sf_dir = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    got = entry.queries()["op13_pieces"](spark, sf_dir).collect()
    assert len(got) == len(texts)
    for r in got:
        ids = library.encode(texts[r.doc_id], add_eos=True)
        want = (len(ids), digest(" ".join(map(str, ids))), digest(library.decode(ids)), True)
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256, r.agrees) == want


def test_random_texts_with_spaces_bytes_and_markup(library):
    random.seed(7)
    signs = " ▁  ab\tthein\n\x00éñ世界\U0001f642 <s></s><0x41>er  "
    texts = ["".join(random.choices(signs, k=random.randint(0, 80))) for _ in range(4000)]
    texts += [" " * k for k in range(70)] + ["the" * 700, " " * 3000 + "the", "ab\n" * 2000, "世" * 500, "x" * 20000]
    ids, agrees = pieces.Encoder(pieces.default_path()).batch(texts)
    assert [x.tolist() for x in ids] == library.encode(texts)
    assert all(agrees)


def test_odd_rows(spark, library):
    long = "wordanother " * 200_000 + "q" * 100_000
    rows = [(1, None, "a"), (2, "", "b"), (2, "twice", "c"), (2, "twice", "c"), (None, "no id", "d"), (3, long, "e")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    got = sorted(((r.doc_id, list(r.ids), r.decoded) for r in pieces.encode_texts(docs).collect()), key=str)
    want = sorted(((i, library.encode(t or "", add_eos=True), t or "") for i, t, _ in rows), key=str)
    assert got == want
    assert pieces.encode_texts(docs.limit(0)).count() == 0


def test_a_differing_library_is_reported(monkeypatch):
    own = pieces.Encoder(pieces.default_path())
    monkeypatch.setattr(own, "merge", lambda word: [5])
    assert own.batch(["some words", ""])[1] == [False, True]


def test_other_vocabularies_are_refused(tmp_path):
    from sentencepiece import sentencepiece_model_pb2 as formats

    model = formats.ModelProto()
    with open(pieces.default_path(), "rb") as file:
        model.ParseFromString(file.read())
    model.trainer_spec.model_type = 1
    (tmp_path / "unigram.model").write_bytes(model.SerializeToString())
    with pytest.raises(ValueError):
        pieces.Encoder(str(tmp_path / "unigram.model"))


def test_words_together_and_one_by_one(library, monkeypatch):
    """Many short words are merged in tables without a call a word, with the ids of one word at a time."""
    random.seed(11)
    words = list({"▁" + "".join(random.choices("▁abeinrst'.\x00éñ世\U0001f642\U0010ffff", k=random.randint(0, 40))) for _ in range(3000)})
    own = pieces.Encoder(pieces.default_path())
    want = [own.merge(w) for w in words]
    assert own.merge_all(words) == want
    monkeypatch.setattr(pieces, "TABLE", 7)
    assert own.merge_all(words) == want
    alone = []
    monkeypatch.setattr(own, "merge", lambda w: alone.append(w) or [])
    own.merge_all(words)
    assert alone and all(len(w) > pieces.SHORT for w in alone)
    assert own.merge_all([]) == []
