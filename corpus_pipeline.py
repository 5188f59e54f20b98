"""A training corpus from raw documents: quality, language, near copies, leaks, tokens.

Every stage takes (spark, docs, sf_dir) and works on all documents that the stage before has kept. Its
result is written to the shared folder and read again, so a lost executor repeats one stage at most.

Nulls in any column are values like others: a null id never meets another row, a null text is empty. Null, empty and blank texts
have no letter, so the language stage takes them. Repeated rows are judged alike and one of them stays after the near copies;
the smallest id of a group stays, of equal ids the smaller text hash. Texts are held whole, however long. Empty tables give an
empty result: where nothing can be learned, nothing is rejected. Further columns, clashing names included, are kept by all but the last stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from martloom.llm import fm_quality, lang_mixture, simhash_trie, sp_prefix, suffix_decontam
from martloom.llm.queries import known_languages, quality_machine, table, tokenizer_path
from martloom.session import drop_scratch, scratch_path, stage
from registry.scratch import ensure_scratch


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject; it learns from the labels of its own input."""
    return fm_quality.keep_good(docs, quality_machine(table(spark, sf_dir, "labels"), docs))


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that known languages, one or several, explain for the larger part; nothing is rejected where none is known."""
    known = known_languages(docs)
    return lang_mixture.keep_identified(docs, known) if known.names else docs


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    ensure_scratch(spark)
    return simhash_trie.drop_near_copies(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    return suffix_decontam.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every document, and what they decode to, as digests."""
    return sp_prefix.digests(docs, sp_prefix.read_model(tokenizer_path()))


STAGES = [
    ("quality classifier", quality_classifier),
    ("language id", language_id),
    ("near copies", near_copies),
    ("decontamination", decontamination),
    ("sentencepiece", tokens),
]

# The first two stages are learned, which SQL cannot express; tests compare the pipeline with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    ensure_scratch(spark)
    docs, read = table(spark, sf_dir, "documents"), None
    for name, step in STAGES:
        label = name.replace(" ", "_")
        path = scratch_path(spark, label)
        docs = stage(step(spark, docs, sf_dir), label, path)
        if read:  # the stage is written, so nobody reads its predecessor's documents again
            drop_scratch(spark, read)
        read = path
    return docs


QUERIES = {"pipeline": run}
ORACLES: dict[str, str] = {}
