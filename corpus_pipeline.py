"""The corpus pipeline: quality, language, near duplicates, benchmark questions, tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written and read again as the next one's ``docs``;
all but the last return the columns of documents. Null ids, null texts, repeats and empty tables are as each operator says:
a null text is no language and goes, repeated rows are copies of which one stays, an empty table stays empty.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ledgerline.llm import bpe_codec, decontaminate, langid, quality, simhash
from ledgerline.llm.common import keep_texts, staged, table
from ledgerline.llm.queries import VOCABULARY

#: Language scores from this on are accepted; four equally likely languages have 0.25 each.
LEAST_SCORE = 0.3


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier predicts as 1; it learns from the labelled documents that are not held out."""
    model = quality.fit_documents(docs, table(spark, sf_dir, "labels"))
    memo: list[quality.Words] = []

    def keep(texts: list[str | None]) -> list[bool]:
        if not memo:
            memo.append(quality.Words())
        return [s >= quality.CUT for s in model.score(texts, memo[0])]

    return keep_texts(docs, keep)


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one of the learned languages: not ``und``, and with a score from LEAST_SCORE on."""
    model = langid.fit_documents(docs)
    return keep_texts(docs, lambda texts: [lang != langid.UNKNOWN and score >= LEAST_SCORE for lang, score in model.predict(texts)])


def one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each SimHash component the document with the smallest id."""
    return simhash.one_of_each(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark question, as it stands or re-parameterised."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document's ids and decoded text as digests."""
    return bpe_codec.round_trip(docs, VOCABULARY)


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
STAGES: list[tuple[str, Stage]] = [
    ("quality classifier", good_quality),
    ("language ID", known_language),
    ("SimHash near-dedup", one_of_near_copies),
    ("benchmark decontamination", without_benchmark),
    ("BPE encoding and decoding", tokens),
]

#: SQL expresses neither the classifiers nor the fingerprints.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
