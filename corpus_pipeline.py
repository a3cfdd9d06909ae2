"""A corpus pipeline over ``documents``: each stage is one text operator whose decisions take effect.

Each function takes (spark, docs, sf_dir) and gives what its stage keeps, with the columns of
``documents``; the last one gives token ids. ``run`` writes every stage's result to the shared folder
as Parquet and rereads it as the next stage's input.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from canopyframe.llm import contamination, neardup, pieces, repeats, toxicity
from canopyframe.llm.common import NO_ID, table, written


def _keys(docs: DataFrame) -> DataFrame:
    """(i, th, row): what identifies a document to the operators, its id and a hash of its text, and
    its whole row in a structure, so that no column name can clash."""
    return docs.select(F.coalesce("doc_id", F.lit(NO_ID)).alias("i"),
                       F.xxhash64(F.coalesce("text", F.lit(""))).alias("th"),
                       F.struct("*").alias("row"))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the string-kernel machine, trained on ``labels``, doesn't reject."""
    others = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"]).alias("row")
    scored = toxicity.score_documents(docs.select("doc_id", "text", others),
                                      table(spark, sf_dir, "labels"), columns=["text", "row"])
    return scored.filter("predicted = 0").select(
        *["text" if c == "text" else F.col(f"row.`{c}`") for c in docs.columns])


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class: the one with the smallest id, once if its row repeats."""
    first = (neardup.classes(docs).filter("first")
             .select(F.coalesce("doc_id", F.lit(NO_ID)).alias("i"), F.col("text_hash").alias("th"))
             .distinct())
    # The window runs in the order of the join before it, without another shuffle.
    place = F.row_number().over(Window.partitionBy("i", "th").orderBy("i", "th"))
    return (_keys(docs).join(first, ["i", "th"]).withColumn("place", place).filter("place = 1")
            .select("row.*"))


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the bytes that also start earlier, ``n_chars`` counted anew where some went.

    A document of which nothing is left is dropped.
    """
    # Nothing is lost of a text that stays whole, so only the bytes that stay are carried along.
    others = [F.col(f"`{c}`") for c in docs.columns if c != "text"]
    rows = docs.select("doc_id", "text", F.struct(
        F.col("text").isNull().alias("absent"), F.struct(*others).alias("rest")).alias("row"))
    cut = repeats.remove_repeats(rows, columns=["row"]).filter("n_removed = 0 or n_removed < n_bytes")
    removed = F.col("n_removed") > 0
    row = "extra.row.rest"
    new = {"text": F.when(~F.col("extra.row.absent"), F.col("kept"))}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(removed, F.length("kept")).otherwise(F.col(f"{row}.n_chars")).cast(
            docs.schema["n_chars"].dataType)
    return cut.select(*[new.get(c, F.col(f"{row}.`{c}`")).alias(c) for c in docs.columns])


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which less than one word in twenty lies in a benchmark window."""
    judged = contamination.contamination(docs, table(spark, sf_dir, "benchmark"))
    bad = judged.filter("contaminated").select(
        F.coalesce("doc_id", F.lit(NO_ID)).alias("i"), F.col("text_hash").alias("th")).distinct()
    return _keys(docs).join(bad, ["i", "th"], "left_anti").select("row.*")


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document with their count and digests."""
    return pieces.encode_pieces(docs, with_ids=True)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("repeats", cut_repeats),
    ("contamination", drop_contaminated),
    ("sentencepiece", encode),
]

# The stages hold trained models and library tokenizers, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
