"""Tenant scope: every table is read through it, and it fails closed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


class MissingScopeError(ValueError):
    """A read without a user id was asked for where one is required."""


class Scope:
    """Reads of one user. The filter stands directly on the scan, so it is pushed into it."""

    def __init__(self, user_id: str | None, *, maintenance: bool = False):
        if not maintenance and not (user_id or "").strip():
            raise MissingScopeError("a user id is required")
        self.user_id = user_id

    def read(self, spark: SparkSession, path: str, user_col: str = "user_id") -> DataFrame:
        return self.apply(spark.read.parquet(path), user_col)

    def apply(self, df: DataFrame, user_col: str = "user_id") -> DataFrame:
        return df if self.user_id is None else df.filter(F.col(user_col) == self.user_id)

    def owns(self, user_col: str = "user_id") -> Column:
        """Whether a row belongs to this scope, for rows that were read by id."""
        return F.lit(True) if self.user_id is None else F.coalesce(F.col(user_col) == self.user_id, F.lit(False))

    def scoped_id(self, key: Column) -> Column:
        """The id with the user's prefix, once."""
        prefix = f"u{self.user_id}|"
        return F.when(key.startswith(prefix), key).otherwise(F.concat(F.lit(prefix), key))

    def visible_runs(self, df: DataFrame, owner_col: str = "owner") -> DataFrame:
        """Own rows and those without an owner."""
        return df.filter(F.col(owner_col).isNull() | (F.col(owner_col) == self.user_id))
