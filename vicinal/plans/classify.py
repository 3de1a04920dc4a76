"""Classification by majority vote among the nearest neighbours (an extension)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def majority_vote(neighbors: DataFrame, labels: DataFrame, id_col: str = "id", label_col: str = "label") -> DataFrame:
    """(query_id, label, votes): the label most neighbours have; ties go to the smaller label."""
    own = labels.select(F.col(id_col).alias("neighbor_id"), F.col(label_col).alias("label")).where("label IS NOT NULL")
    votes = neighbors.join(own, "neighbor_id").groupBy("query_id", "label").agg(F.count("*").alias("votes"))
    order = Window.partitionBy("query_id").orderBy(F.desc("votes"), "label")
    return votes.withColumn("place", F.row_number().over(order)).where("place = 1").drop("place")
