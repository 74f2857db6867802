"""Leakage-free folds, splits, bag caps and class weights, by hash draws."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from marlstone.functions.draws import draw, hash_rank



def outer_folds(people: DataFrame, k: int = 5, seed: int = 17) -> DataFrame:
    """(person_key, diagnosis, diagnosis_id) -> with outer_fold 0 .. k-1: each class is dealt out evenly, in the order of a draw."""
    ranked = hash_rank(people.withColumn("__draw", draw(seed, F.lit("outer"), "person_key")), ["diagnosis"], "__draw", "__rank")
    return ranked.withColumn("outer_fold", ((F.col("__rank") - 1 + F.col("diagnosis_id")) % k).cast("int")).drop("__draw", "__rank")


def inner_splits(folds: DataFrame, k: int = 5, inner: int = 5, seed: int = 17) -> DataFrame:
    """For each outer fold: test is the fold, every inner-th of the others (by a draw in its class) validates, the rest trains."""
    each = folds.withColumnRenamed("outer_fold", "__own").withColumn("outer_fold", F.explode(F.sequence(F.lit(0), F.lit(k - 1))))
    test = each.where("__own = outer_fold").withColumn("split", F.lit("test"))
    rest = each.where("__own != outer_fold").withColumn("__draw", draw(seed, F.lit("inner"), "outer_fold", "person_key"))
    rest = hash_rank(rest, ["outer_fold", "diagnosis"], "__draw", "__rank").withColumn("split", F.when((F.col("__rank") - 1 + F.col("diagnosis_id")) % inner == 0, "validation").otherwise("train"))
    return test.select("outer_fold", "person_key", "diagnosis", "split").unionByName(rest.select("outer_fold", "person_key", "diagnosis", "split"))


def three_way_split(people: DataFrame, seed: int = 17, train: float = 0.7, validation: float = 0.15) -> DataFrame:
    """Train, validation and test inside each class; train and validation have at least one, and test if one is left."""
    ranked = hash_rank(people.withColumn("__draw", draw(seed, F.lit("split"), "person_key")), ["diagnosis"], "__draw", "__rank")
    counts = people.groupBy("diagnosis").agg(F.count("*").alias("__n")).withColumnRenamed("diagnosis", "__d")
    joined = ranked.join(counts, F.col("diagnosis").eqNullSafe(F.col("__d")))
    n = F.col("__n")
    n_train = F.greatest(F.lit(1), F.floor(n * train))
    n_validation = F.greatest(F.lit(1), F.floor(n * validation))
    n_train = F.when(n_train + n_validation >= n, F.greatest(F.lit(1), n - n_validation - 1)).otherwise(n_train)
    split = F.when(F.col("__rank") <= n_train, "train").when(F.col("__rank") <= n_train + n_validation, "val").otherwise("test")
    return joined.withColumn("split", split).drop("__draw", "__rank", "__d", "__n")


def fold_audit(folds: DataFrame, k: int = 5) -> DataFrame:
    """One row per class: people per fold and their spread."""
    wide = folds.groupBy("diagnosis").pivot("outer_fold", list(range(k))).count()
    cells = [F.coalesce(F.col(str(i)), F.lit(0)) for i in range(k)]
    return wide.select("diagnosis", *(c.alias(f"fold_{i}") for i, c in enumerate(cells)), (F.greatest(*cells) - F.least(*cells)).alias("spread"))


def capped_members(members: DataFrame, cap: int, seed: int, epoch: int) -> DataFrame:
    """At most ``cap`` members of each person, a new choice for each epoch."""
    order = draw(seed, F.lit(str(epoch)), "person_key", "image_key")
    return members.withColumn("__rank", F.row_number().over(W.partitionBy("person_key").orderBy(order))).where(F.col("__rank") <= cap).drop("__rank")


def class_weights(people: DataFrame) -> DataFrame:
    """Inverse, normalised (sum k) and balanced (n / (k * n_c)) weights of each class."""
    counts = people.groupBy("diagnosis").agg(F.count("*").alias("n"))
    # one row per class from here on
    every = W.partitionBy(F.lit(0))
    return counts.select("diagnosis", "n", (1 / F.col("n")).alias("inverse"), (1 / F.col("n") / F.sum(1 / F.col("n")).over(every) * F.count("*").over(every)).alias("normalised"), (F.sum("n").over(every) / (F.count("*").over(every) * F.col("n"))).alias("balanced"))


def padded_bags(members: DataFrame, width: int, fill: str = "") -> DataFrame:
    """A person's members in key order, filled up to ``width``, and which places are real."""
    own = members.groupBy("person_key").agg(F.array_sort(F.collect_list("image_key")).alias("own"))
    missing = F.greatest(F.lit(width) - F.size("own"), F.lit(0))
    return own.select("person_key", F.concat("own", F.array_repeat(F.lit(fill), missing)).alias("members"), F.concat(F.transform("own", lambda _: F.lit(True)), F.array_repeat(F.lit(False), missing)).alias("mask"))


def examples(rows: DataFrame) -> DataFrame:
    """The smallest key of each fold and class."""
    return rows.groupBy("outer_fold", "diagnosis").agg(F.min("person_key").alias("person_key"))
