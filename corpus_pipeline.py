"""A corpus for training, from documents to packed sequences, in five stages.

Each stage works on all that the stage before it kept, reread from Parquet, and its
decisions take effect: documents go, lines go, documents repeat.

Cases: a document with null, empty or letterless text goes in the first stage; a null id stays and
counts as the last; a null source is a source of its own, the last; a null lang doesn't train.
Repeated rows are near-duplicates of each other: one stays. An empty table gives no pieces. Columns
besides those of ``documents`` are dropped by the first stage, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import language_id, line_dedup, minhash, mixing, packing
from tessera.llm.common import cut

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: A document stays if the filter of its language holds at least this share of its n-grams, beyond what chance gives.
#: On sf0.1 real documents have 0.19 and more, half of them above 0.98; random letters or encoded data come near 0.
LEAST_COVERAGE = 0.1
#: Documents are near-duplicates from this share of common shingles on, in percent.
PERCENT = 80


def identify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language; those without letters, and those whose n-grams no learned language holds, go."""
    docs = docs.select(*COLUMNS)
    told = language_id.predict(docs, language_id.split_and_fit(docs), with_text=True)
    return told.where((F.col("lang_pred") != "und") & (F.col("coverage") >= LEAST_COVERAGE)).select(*COLUMNS)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that occur before; a document that loses all its lines goes."""
    done = line_dedup.dedup(docs.select(*COLUMNS))
    left = done.where((F.col("n_left") > 0) | (F.col("n_dropped") == 0))
    return left.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    return minhash.dedup(docs.select(*COLUMNS), PERCENT).select(*COLUMNS)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    docs = docs.select(*COLUMNS)
    bound = mixing.bounds(mixing.sizes(docs, numbered=False))
    taken = mixing.with_copies(docs, bound, mixing.first_hash()).where("copies > 0")
    return taken.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies"))).select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, by sequence."""
    import public_tokenizers

    return packing.pack(docs.select(*COLUMNS), public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("language_id", identify), ("line_dedup", drop_lines), ("minhash", drop_copies), ("mixing", mix), ("packing", pack)]

#: Language identification, SimHash and the packing's choice of cuts are not expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir), name)
    return docs
