"""A bounded sample of labelled documents, for the classifiers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_mod, hash_sample


def held_out(id_col: str, folds: int, fold: int):
    """Whether a row belongs to the fold that no label is learned from; a null id belongs to none."""
    return F.coalesce(crc_mod(F.col(id_col), folds) == fold, F.lit(False))


def sample(labels: DataFrame, label_col: str, folds: int, fold: int, most: int, id_col: str = "doc_id") -> DataFrame:
    """(id, label) of at most `most` labelled ids outside the fold, those with the smallest hashes.

    Null ids and labels other than 0 and 1 are left out, and so are ids whose rows disagree.
    """
    known = labels.where(~held_out(id_col, folds, fold)).select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("int").alias("label")).where("id is not null and label in (0, 1)")
    agreed = known.groupBy("id").agg(F.min("label").alias("label"), F.max("label").alias("high")).where("label = high")
    return hash_sample(agreed.select("id", "label"), most, "id")
