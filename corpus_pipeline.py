"""A corpus pipeline of llm operators over ``documents``: each stage takes what the one before kept.

Quality classifier, n-gram Jaccard join, benchmark decontamination, personal data, packing. All stages but the last return
the columns of ``documents``.
"""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pitlab.llm import decontaminate, jaccard, packing, pii, quality, queries
from pitlab.llm.common import checked
from pitlab.session import materialize

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

ACCEPTED_FROM = 0.7
#: Words of a shingle and the least Jaccard similarity, in percent, of the stage; op3_jaccard_join has its own (4 and 85).
SHINGLE_WORDS, SIMILAR_PERCENT = 5, 80


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier scores 0.7 or more. Texts are scored in place, without a join.

    A null text is scored as an empty one. Rows that repeat are scored alike. Without labels, or with labels of one class only,
    all texts have one score.
    """
    labels = quality.majority(_table(spark, sf_dir, "labels"), "quality")
    model = quality.learn(docs, labels)

    @F.arrow_udf("double")
    def score(text: pa.Array) -> pa.Array:
        return pa.array(quality.score_column(text, model))

    return docs.where(score(F.col("text").cast("string")) >= ACCEPTED_FROM)


def _column(name: str) -> Column:
    return F.col(f"`{name.replace('`', '``')}`")


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents joined by similarity, the one with the smallest id. Rows of a null id are no documents to compare and stay.

    An id with several texts is one document: if it stays, each of its different texts stays once, as the row whose other
    columns, whatever their names and types, come first as JSON.
    """
    found = jaccard.similar_documents(docs, size=SHINGLE_WORDS, percent=SIMILAR_PERCENT)
    # Only ids that occur in several rows need a choice among them; all other texts stay where they are.
    each = materialize(found.where("doc_id = component_id").groupBy("doc_id").count(), "kept-documents")
    once, often = (checked(each.where(x).select("doc_id")) for x in ("count = 1", "count > 1"))
    single = docs.where("doc_id IS NULL").unionByName(docs.join(once, "doc_id", "left_semi"))
    place = "place"
    while place in [c.lower() for c in docs.columns]:
        place += "_"
    others = [_column(c) for c in docs.columns if c not in ("doc_id", "text")]
    written = F.to_json(F.struct(*others)) if others else F.lit("")
    # Only the first of a window is kept, which Spark does in the map task as well.
    first = Window.partitionBy("doc_id", "text").orderBy(written)
    several = docs.join(often, "doc_id", "left_semi").withColumn(place, F.row_number().over(first)).where(_column(place) == 1)
    return single.select(*map(_column, docs.columns)).unionByName(several.select(*map(_column, docs.columns)))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which hit words are less than a twentieth.

    A null or empty text has no words and stays; rows that repeat are judged one by one. An empty benchmark drops nothing.
    """
    others = [c for c in docs.columns if c != "text"]
    carried = docs.select(F.struct(*map(_column, others)).alias("row"), "doc_id", "text")
    found = decontaminate.find_spans(carried, _table(spark, sf_dir, "benchmark"), carry=["row", "text"])
    return decontaminate.contamination(found, carry=["row", "text"]).where("NOT contaminated").select("row.*", "text").select(*map(_column, docs.columns))


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in texts replaced by the name of its kind; n_chars follows the new text."""
    redacted = pii.redact_documents(docs)
    return redacted.withColumn("n_chars", F.char_length("text").cast("long")) if "n_chars" in docs.columns else redacted


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of at most 2048 tokens. A null text is an empty one: its piece is the closing id alone."""
    return packing.pack(docs, queries.WORD_VOCABULARY)


STAGES: list[tuple[str, Stage]] = [
    ("quality classifier", keep_quality),
    ("n-gram Jaccard join", keep_one_of_each_group),
    ("benchmark decontamination", drop_contaminated),
    ("personal data", redact),
    ("packing", pack),
]

#: Learned scores, redaction by transducers and retrieval order are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, one after the other, over ``documents``; each one's result is written to the shared folder."""
    docs = _table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = materialize(docs, f"pipeline-{k}")
    return docs
