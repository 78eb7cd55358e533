"""``LendingData``: the raw tables plus lazily built, memoized derived frames.

The chain ``load -> clean_* -> *_features -> risk_wide / risk_slim -> report`` is
a set of pure DataFrame functions; this object only remembers each frame so a
report asks for ``ctx.slim`` instead of rebuilding the chain.  Nothing here runs
a job.  ``persist_slim()`` optionally writes the slim table to the shared folder
(it survives executor loss and cuts the lineage) when many reports will read it,
and ``persist_scored()`` the scorecard's rows.
"""

from __future__ import annotations

from collections.abc import Mapping
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

from ..sources.csv import read_tables
from ..sources.fixtures import load_fixture_tables
from ..sources.sinks import scratch_path
from . import clean, features, risk


class LendingData:
    def __init__(self, spark: SparkSession, raw: Mapping[str, DataFrame]):
        self.spark = spark
        self.raw = raw  # a plain dict or a lazily building mapping

    # ---- construction -----------------------------------------------------
    @classmethod
    def from_fixtures(cls, spark: SparkSession, sf_dir: str) -> "LendingData":
        """Lending tables derived from the benchmark parquet folder ``sf_dir``."""
        return cls(spark, load_fixture_tables(spark, sf_dir))

    @classmethod
    def from_csv(cls, spark: SparkSession, directory: str, infer: bool = False, mode: str = "FAILFAST") -> "LendingData":
        """The eight headed CSV files of ``directory``."""
        return cls(spark, read_tables(spark, directory, infer=infer, mode=mode))

    # ---- silver -----------------------------------------------------------
    @cached_property
    def application(self) -> DataFrame:
        return clean.clean_application(self.raw["application_train"])

    @cached_property
    def bureau(self) -> DataFrame:
        return clean.clean_bureau(self.raw["bureau"])

    @cached_property
    def previous(self) -> DataFrame:
        return clean.clean_previous(self.raw["previous_application"])

    @cached_property
    def installments(self) -> DataFrame:
        return clean.clean_installments(self.raw["installments_payments"])

    @cached_property
    def bureau_balance(self) -> DataFrame:
        return clean.clean_bureau_balance(self.raw["bureau_balance"])

    # ---- features ---------------------------------------------------------
    @cached_property
    def bureau_features(self) -> DataFrame:
        return features.bureau_features(self.bureau)

    @cached_property
    def previous_features(self) -> DataFrame:
        return features.previous_features(self.previous)

    @cached_property
    def payment_features(self) -> DataFrame:
        return features.payment_features(self.installments)

    # ---- gold -------------------------------------------------------------
    @cached_property
    def wide(self) -> DataFrame:
        return risk.risk_wide(self.application, self.bureau_features, self.previous_features,
                              self.payment_features)

    @cached_property
    def slim(self) -> DataFrame:
        return risk.risk_slim(self.application, self.bureau_features, self.previous_features)

    @cached_property
    def scored(self) -> DataFrame:
        return risk.risk_scored(self.slim)

    def persist_slim(self) -> DataFrame:
        """Write the slim table once as parquet in the shared folder and read that
        copy from now on: reports prune its columns and see its size."""
        path = scratch_path(self.spark, "slim")
        schema = self.slim.schema
        self.slim.write.mode("overwrite").parquet(path)
        self.__dict__["slim"] = self.spark.read.schema(schema).parquet(path)
        self.__dict__.pop("scored", None)
        return self.slim

    def persist_scored(self) -> DataFrame:
        """Write the scored frame once, from the slim table as it is now, and read that copy from now on.
        ``persist_slim`` drops it again, as it belongs to the slim table that it was scored from."""
        path = scratch_path(self.spark, "scored")
        schema = self.scored.schema
        self.scored.write.mode("overwrite").parquet(path)
        self.__dict__["scored"] = self.spark.read.schema(schema).parquet(path)
        return self.scored

    def silver(self) -> dict[str, DataFrame]:
        return {
            "application_train": self.application,
            "bureau": self.bureau,
            "bureau_balance": self.bureau_balance,
            "previous_application": self.previous,
            "installments_payments": self.installments,
        }

    def register_views(self, prefix: str = "", master: str | None = None) -> None:
        """Temp views for SQL users: the five cleaned tables under their table
        names, ``risk_wide`` and ``risk_slim``; with ``master="wide"`` or
        ``"slim"`` also ``master_risk_data`` for SQL written against that name
        (the wide table for the first sample queries, the slim one afterwards)."""
        for name, df in self.silver().items():
            df.createOrReplaceTempView(f"{prefix}{name}")
        self.wide.createOrReplaceTempView(f"{prefix}risk_wide")
        self.slim.createOrReplaceTempView(f"{prefix}risk_slim")
        if master is not None:
            {"wide": self.wide, "slim": self.slim}[master].createOrReplaceTempView(f"{prefix}master_risk_data")
