"""A training corpus in five stages: quality, exact and near duplicates, mix, packed sequences."""

from __future__ import annotations

from acctrisk.llm import exact, jaccard, mixing, packing, quality
from acctrisk.llm.catalog import MIX_WEIGHTS
from acctrisk.llm.common import stored, table


def keep_quality(spark, docs, sf_dir):
    """Documents that the classifier rejects go."""
    return quality.accepted_documents(docs, table(spark, sf_dir, "labels"))


def drop_exact(spark, docs, sf_dir):
    """Of equal texts the smallest id stays."""
    return exact.drop_duplicates(docs)


def drop_near(spark, docs, sf_dir):
    """Of each group of similar texts the smallest id stays."""
    return jaccard.drop_similar(docs)


def mix_sources(spark, docs, sf_dir):
    """All documents, in the order of the mix: part files by number, rows as they stand."""
    return mixing.in_mixed_order(docs, weights=MIX_WEIGHTS)


def pack(spark, docs, sf_dir):
    """Every piece of every document, with its place in a sequence; sequences follow the order of the mix."""
    return packing.pack_documents(docs, ordered=True)


STAGES = [
    ("quality classifier", keep_quality),
    ("exact dedup", drop_exact),
    ("n-gram Jaccard join", drop_near),
    ("mixing sources to target weights", mix_sources),
    ("best-fit packing", pack),
]

#: Likelihood ratios, near duplicates and tokenisation can't be said in SQL; tests compare with plain Python.
ORACLE_SQL = None


def run(spark, sf_dir):
    """The stages over ``documents``; the result of each but the last is stored and read again."""
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = stored(docs, name.replace(" ", "-"))
    return docs
