"""From all documents to packed training sequences: five stages, each over everything its predecessor kept.

Null and empty texts are documents like others: they are scored by what there is (no words, metadata), link with nothing,
are 0 words of a mix and one token of a sequence. Null ids, sources and languages stay null. Rows of equal id and text are
copies, of which the third stage leaves one; before it, each row is judged for itself. An empty table goes through all
stages and gives no rows. Columns beside those of documents are kept up to the last stage, whatever their names.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from earshot.llm.common import checkpoint_folder, read_table
from earshot.llm.jaccard import one_of_each
from earshot.llm.mixing import mix
from earshot.llm.packing import pack
from earshot.llm.quality import quality
from earshot.llm.queries import PREFERENCE, vocabulary
from earshot.llm.toxicity import toxicity


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained classifier keeps: all of them where no label tells two classes apart."""
    return quality(docs, read_table(spark, sf_dir, "labels")).filter("keep").select(*docs.columns)


def not_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored below the threshold of toxicity; texts without words are, as are all where there are no labels."""
    return toxicity(docs, read_table(spark, sf_dir, "labels")).filter("predicted = 0").select(*docs.columns)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies (five-word shingles, similarity of 0.8 or more): that of the least id.

    Texts without words link with nothing, so all of them stay; a null id counts as a large one."""
    return one_of_each(docs).select(*docs.columns)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: each document as many times as it is taken, up to three. Those of size 0 take no words and go by the
    whole copies and the draw alike."""
    taken = mix(docs, preference=PREFERENCE)
    return taken.filter("copies > 0").withColumn("copies", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).select(*docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents and their places in sequences of at most 4096 tokens."""
    return pack(docs, vocabulary("word_bpe_49k.json"))


STAGES = [
    ("quality classifier", good_quality),
    ("toxicity", not_toxic),
    ("n-gram Jaccard join", without_near_copies),
    ("mixing sources", mixed),
    ("best-fit packing", packed),
]

#: Trained classifiers, random paths and the tokenizer are beyond SQL; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`. What a stage gives is written as Parquet to the shared folder and read again; once the
    next one has been written it is deleted, but for the last, which the result may read."""
    docs = read_table(spark, sf_dir, "documents")
    folder = f"{checkpoint_folder(spark)}/pipeline-{uuid.uuid4()}"
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs.write.parquet(f"{folder}/{k}")
            docs = spark.read.parquet(f"{folder}/{k}")
            if k:
                path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{k - 1}")
                path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    return docs
