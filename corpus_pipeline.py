"""A corpus pipeline of five stages, each by an operator of tierstats.llm.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the
next stage's docs. All but the last return the columns of documents.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tierstats.llm import decontam, lines, mixing, simhash, toxicity
from tierstats.llm.common import lookup_join, staged
from tierstats.sources.shared import discard

#: Shingle length of the near-duplicate stage.
NEAR_WORDS = 5


def _keyed(docs: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
    """The rows (key, row) of ``docs``, written, and (key, doc_id, text) of them. The key tells rows apart, as ids may repeat
    or be null; the row is a struct, so that no column name clashes."""
    rows = staged(docs.select(F.monotonically_increasing_id().alias("key"), F.struct("*").alias("row")), name)
    return rows, rows.select("key", F.col("row")["doc_id"].alias("doc_id"), F.col("row")["text"].alias("text"))


def _without(rows: DataFrame, gone: DataFrame, columns: list[str], name: str) -> DataFrame:
    """The docs without those whose key is in ``gone``."""
    left = lookup_join(rows, staged(gone.distinct(), name), "key", "left_anti")
    return left.select(*(F.col("row")[c].alias(c) for c in columns))


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose severity is above grade 0 with a probability of one half or more go.

    Null and empty texts are judged like texts without marked words; repeated rows and rows of one id by their own
    text. Without labels of both kinds nothing goes. Empty table: empty result. Columns of any name are carried.
    """
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    left = toxicity.scored_rows(docs, model).where("p_toxic < 0.5")
    return left.select(*(F.col("row")[c].alias(c) for c in docs.columns))


def drop_common_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines found in ten or more documents (distinct ids; null ids are one document) leave all texts; every row stays.

    Null and empty texts are one empty line and stay as they are. Repeated rows lose the same lines. Empty table: empty
    result. Columns of any name are carried.
    """
    return lines.dedup_lines(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the row of smallest (doc_id, row) stays, null ids last.

    Near-duplicates have five-word shingles of a Jaccard similarity of 0.8 or more, checked on the texts for each link.
    Texts without a word, also null, are copies of each other only. Repeated rows are copies. Empty table: empty result.
    Columns of any name are carried.
    """
    rows, texts = _keyed(docs, "near-rows")
    found = simhash.near_copies(texts, "key", k=NEAR_WORDS)
    return _without(rows, found.where("key <> kept").select("key"), docs.columns, "near-copies")


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that hold a benchmark item go, whatever their id; other rows of that id stay.

    Null and empty texts stay. Repeated rows are judged alike. Empty tables: nothing goes. Columns of any name are carried.
    """
    rows, texts = _keyed(docs, "leak-rows")
    leaks = decontam.find_leaks(texts, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), id_col="key")
    return _without(rows, leaks.select("key"), docs.columns, "leaks")


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents of the mix, with ``n_copies``: how often each is taken. Of rows that
    have id and text in common as many are taken as come nearest the target, null sources are one source, texts without words weigh nothing. Empty table: empty result."""
    return mixing.mixed_documents(docs)


STAGES = [
    ("toxicity", reject_toxic),
    ("line_dedup", drop_common_lines),
    ("simhash_near_dedup", drop_near_copies),
    ("decontamination", drop_leaks),
    ("mixing", mix),
]

#: SQL cannot express the ordinal regression and the fingerprints.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order; a stage's input is deleted once its output is written."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), f"pipeline-{name}")
        if before is not None:
            discard(spark, before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)


#: What ``__spark_entry__.py`` registers.
QUERIES = {"pipeline": run}
ORACLES = {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
