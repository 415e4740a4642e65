"""From raw documents to a training mix, in five stages.

Every stage is written as Parquet below the shared folder that the session
names and read again by the next one. All but the last return the columns they
were given.

* quality: documents that score below 0.7 go.
* near_duplicates: of each group of documents linked by a similarity of 0.8 or
  more on five-word shingles the one with the least id stays; rows that repeat an
  id with another text are other documents, equal id and text one.
* decontamination: documents that hold a window of a benchmark item of five
  words or more go.
* pii: every span is replaced by its kind in brackets, and n_chars follows.
* mixing: documents that the mix takes stay, with mix_size, mix_copies (how
  often) and mix_taken.

Rows whose id is null stand for themselves in the second stage, told apart by
their text; of a linked group they stay only where no row has an id. Of a
group's texts under its least id one stays; of rows equal in id and text the one
whose columns, as JSON, have the least hash. Columns of any type pass, maps too.
A stage's folder is deleted once the next one is written.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioquery.llm._arrays import PIECE_BYTES
from folioquery.llm._spark import shared_folder
from folioquery.llm.decontamination import drop_contaminated
from folioquery.llm.ngram_join import ngram_jaccard_join
from folioquery.llm.pii import redact_pii
from folioquery.llm.quality_classifier import fit, keep_good
from folioquery.llm.source_mixing import take_mix

#: No stage but the mix can be said in SQL; tests hold each against brute force.
ORACLE_SQL = None


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_good(docs, fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")), least=0.7)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    node = F.xxhash64(docs["doc_id"], docs["text"])
    linked = ngram_jaccard_join(docs.select(node.alias("doc_id"), docs["text"].alias("text")), n=5, threshold=80, links=False, slice_bytes=PIECE_BYTES)
    group = linked.select(F.col("doc_id").alias("node"), F.col("component_id").alias("group")).distinct()
    ids = docs.select(node.alias("node"), docs["doc_id"].alias("id")).distinct()
    best = group.join(ids, "node").groupBy("group").agg(F.min(F.struct(F.col("id").isNull(), "id", "node")).alias("least"))
    whole = F.struct(*[docs[c] for c in docs.columns])
    # a second hash keeps rows apart whose nodes meet by chance
    rows = docs.select(node.alias("node"), F.xxhash64(docs["text"], docs["doc_id"], F.lit(7)).alias("other"), whole.alias("doc"), F.xxhash64(F.to_json(whole)).alias("order"))
    kept = rows.join(best.select("least.node"), "node", "left_semi").groupBy("node", "other").agg(F.min_by("doc", "order").alias("doc"))
    return kept.select(*[F.col("doc").getField(c).alias(c) for c in docs.columns])


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return redact_pii(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return take_mix(docs)


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("pii", pii), ("mixing", mixing)]


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    base = shared_folder(spark)
    folder, last = f"{base}/pipeline-{uuid.uuid4().hex}", None
    for k, (name, stage) in enumerate(STAGES):
        out = f"{folder}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(out)
        docs = spark.read.parquet(out)
        if last:
            _delete(spark, last)
        last = out
    return docs
