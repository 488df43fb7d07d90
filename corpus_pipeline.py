"""The corpus pipeline: toxicity, line dedup, near-duplicate join, benchmark decontamination, packing.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept, and all but the last
return the columns of `documents`, with n_chars brought up to date where a text changed. The words
of a text differ after line dedup, so near copies are judged, and benchmark passages sought, in what
will be trained on.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.llm import decontaminate, line_dedup, ngram_join, packing, toxicity
from lattica.llm.common import forget, table, written

#: Near copies share four fifths of their shingles of five words at least.
SHINGLE_WORDS, PERCENT = 5, 80
#: Words of a benchmark passage, and the share of hit words beyond which a document goes as a whole.
WINDOW, COVERAGE = 10, 0.5
#: The vocabulary whose tokens are packed.
TOKENIZER = "byte_bpe_50k.tiktoken"


def _sized(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else docs


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity models reject go."""
    return toxicity.without_toxic(docs, table(spark, sf_dir, "labels"))


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of 20 or more code points that three or more documents hold stay in the last of them alone."""
    return _sized(line_dedup.deduplicated(docs, min_chars=20, min_docs=3, lines=False))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents the one of the smallest doc_id stays."""
    return ngram_join.one_of_each(docs, SHINGLE_WORDS, PERCENT)


def cut_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark passages are cut out of the texts; documents that are mostly such passages go."""
    return _sized(decontaminate.without_spans(docs, table(spark, sf_dir, "benchmark"), WINDOW, COVERAGE))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Training sequences of the documents' tokens."""
    import public_tokenizers

    return packing.sequences(docs, public_tokenizers.path(TOKENIZER))


STAGES = [("toxicity", drop_toxic), ("line_dedup", dedup_lines), ("ngram_jaccard", drop_near_copies), ("decontamination", cut_benchmark), ("packing", pack)]

#: Models, an automaton and best-fit packing can't be said in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    before = None
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs, f"stage-{name}")
            if before is not None:
                forget(before)
            before = docs
    return docs
