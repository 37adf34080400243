"""Bulk maintenance of users, datasets and metadata: every change is a join over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hushframe.operators.ledger import BUDGET_STRUCT, KEYS, initial_budget


def _upsert(current: DataFrame, incoming: DataFrame, key: str, overwrite: bool) -> DataFrame:
    if overwrite:
        return incoming.unionByName(current.join(incoming.select(key), key, "left_anti"))
    return current.unionByName(incoming.join(current.select(key), key, "left_anti"))


def upsert_users(current: DataFrame, incoming: DataFrame, overwrite: bool = False) -> DataFrame:
    """New users are added; known ones are replaced only when asked."""
    return _upsert(current, incoming, "user_name", overwrite)


def upsert_datasets(datasets: DataFrame, metadata: DataFrame, new_datasets: DataFrame, new_metadata: DataFrame,
                    overwrite_datasets: bool = False, overwrite_metadata: bool = False) -> tuple[DataFrame, DataFrame]:
    return (_upsert(datasets, new_datasets, "dataset_name", overwrite_datasets),
            _upsert(metadata, new_metadata, "dataset_name", overwrite_metadata))


def grant(users: DataFrame, grants: DataFrame) -> DataFrame:
    """Give datasets to users; no effect where the user already holds one or does not exist."""
    entry = F.struct("dataset_name", "initial_epsilon", "initial_delta", F.lit(0.0).alias("total_spent_epsilon"),
                     F.lit(0.0).alias("total_spent_delta"))
    new = (
        grants.groupBy(*KEYS).agg(F.min(F.struct("initial_epsilon", "initial_delta")).alias("b")).select(*KEYS, "b.*")
        .join(initial_budget(users).select(*KEYS), KEYS, "left_anti")
        .groupBy("user_name").agg(F.sort_array(F.collect_list(entry)).alias("__new"))
    )
    merged = F.concat("datasets_list", F.coalesce("__new", F.array().cast(BUDGET_STRUCT)))
    return users.join(new, "user_name", "left").withColumn("datasets_list", merged).select(*users.columns)


def revoke(users: DataFrame, grants: DataFrame) -> DataFrame:
    """Take datasets from users; unknown pairs have no effect."""
    gone = grants.groupBy("user_name").agg(F.collect_set("dataset_name").alias("__gone"))
    kept = F.filter("datasets_list", lambda d: ~F.array_contains(F.coalesce("__gone", F.array().cast("array<string>")), d["dataset_name"]))
    return users.join(gone, "user_name", "left").withColumn("datasets_list", kept).select(*users.columns)


def set_budget(users: DataFrame, updates: DataFrame) -> DataFrame:
    """Set initial amounts per (user, dataset); a null amount keeps the old one."""
    amounts = F.struct(F.col("initial_epsilon").alias("e"), F.col("initial_delta").alias("d"))
    latest = updates.groupBy(*KEYS).agg(F.max(amounts).alias("b"))
    changes = latest.groupBy("user_name").agg(F.map_from_entries(F.collect_list(F.struct("dataset_name", "b"))).alias("__set"))

    def changed(d):
        new = F.col("__set")[d["dataset_name"]]
        return F.struct(
            d["dataset_name"].alias("dataset_name"),
            F.coalesce(new["e"], d["initial_epsilon"]).alias("initial_epsilon"),
            F.coalesce(new["d"], d["initial_delta"]).alias("initial_delta"),
            d["total_spent_epsilon"].alias("total_spent_epsilon"),
            d["total_spent_delta"].alias("total_spent_delta"),
        )

    return users.join(changes, "user_name", "left").withColumn("datasets_list", F.transform("datasets_list", changed)).select(*users.columns)


def set_may_query(users: DataFrame, updates: DataFrame) -> DataFrame:
    flags = updates.groupBy("user_name").agg(F.min("may_query").alias("__may"))
    return users.join(flags, "user_name", "left").withColumn("may_query", F.coalesce("__may", "may_query")).select(*users.columns)


def delete_users(users: DataFrame, names: DataFrame) -> DataFrame:
    return users.join(names.select("user_name"), "user_name", "left_anti")


def delete_datasets(datasets: DataFrame, metadata: DataFrame, names: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Datasets and their metadata go together."""
    gone = names.select("dataset_name")
    return datasets.join(gone, "dataset_name", "left_anti"), metadata.join(gone, "dataset_name", "left_anti")


def list_users(users: DataFrame) -> DataFrame:
    return users.select("user_name", "may_query", F.size("datasets_list").alias("n_datasets"))


def list_datasets(datasets: DataFrame) -> DataFrame:
    return datasets.select("dataset_name")


def list_user_datasets(users: DataFrame, user: str) -> DataFrame:
    return initial_budget(users.filter(F.col("user_name") == user))


def list_archives(archive: DataFrame, user: str) -> DataFrame:
    return archive.filter(F.col("user_name") == user)


def check_registry(users: DataFrame, datasets: DataFrame, metadata: DataFrame) -> DataFrame:
    """Defects: datasets without metadata, metadata without dataset, grants of unknown datasets."""
    def problem(df: DataFrame, text: str) -> DataFrame:
        return df.select(F.lit(text).alias("problem"), F.col("dataset_name").alias("name"))

    granted = initial_budget(users).select("dataset_name").distinct()
    return (
        problem(datasets.join(metadata, "dataset_name", "left_anti"), "dataset without metadata")
        .unionByName(problem(metadata.join(datasets, "dataset_name", "left_anti"), "metadata without dataset"))
        .unionByName(problem(granted.join(datasets, "dataset_name", "left_anti"), "grant of unknown dataset"))
    )
