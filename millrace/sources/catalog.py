"""A catalog of buckets and datasets on parquet: names, type identities, bounds, records."""

from __future__ import annotations

import json
import re
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FORMAT = 1
NAME = re.compile(r"[^/\\\x00]+")


class CatalogError(ValueError):
    """code: invalid_input, incompatible, corruption or limit."""

    def __init__(self, code: str, message: str):
        super().__init__(f"{code}: {message}")
        self.code = code


@dataclass(frozen=True)
class Dataset:
    bucket: str
    name: str
    dataset_id: int
    type_identity: str
    max_records: int = 100_000
    max_value_bytes: int = 1 << 20


def check_name(name: str) -> str:
    if not name or name != name.strip() or not NAME.fullmatch(name):
        raise CatalogError("invalid_input", f"name {name!r}")
    return name


class Catalog:
    """Datasets in a folder, each a parquet table (key string, json string). Creation is idempotent; a type identity cannot change."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        rows = [json.loads(r[0]) for r in self._read_entries()]
        if any(r.pop("format") != FORMAT for r in rows):
            raise CatalogError("corruption", "catalog format")
        self.datasets = {(r["bucket"], r["name"]): Dataset(**r) for r in rows}

    def _read_entries(self) -> list:
        hadoop = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/_catalog")
        if not hadoop.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(hadoop):
            return []
        return self.spark.read.text(f"{self.path}/_catalog").collect()  # a row for each dataset

    def dataset(self, bucket: str, name: str, type_identity: str, **bounds: int) -> Dataset:
        key = (check_name(bucket), check_name(name))
        found = self.datasets.get(key)
        if found:
            if found.type_identity != type_identity or any(getattr(found, k) != v for k, v in bounds.items()):
                raise CatalogError("incompatible", f"{bucket}/{name} is {found.type_identity}")
            return found
        new = Dataset(*key, len(self.datasets) + 1, type_identity, **bounds)
        self.spark.createDataFrame([(json.dumps(asdict(new) | {"format": FORMAT}),)], "value string").coalesce(1).write.mode("append").text(f"{self.path}/_catalog")
        self.datasets[key] = new
        return new

    def listing(self) -> DataFrame:
        """bucket, name, dataset_id, type_identity in name order."""
        rows = [(d.bucket, d.name, d.dataset_id, d.type_identity) for d in self.datasets.values()]
        return self.spark.createDataFrame(rows, "bucket string, name string, dataset_id int, type_identity string").orderBy("bucket", "name")

    def write(self, dataset: Dataset, records: DataFrame) -> None:
        """Replace the records (key, json), sorted by key within files so that scans by key prune row groups."""
        bad = violations(records, dataset)
        if not bad.isEmpty():
            raise CatalogError("limit", f"{dataset.bucket}/{dataset.name}")
        records.select("key", "json").repartitionByRange("key").sortWithinPartitions("key").write.mode("overwrite").parquet(self._at(dataset))

    def scan(self, dataset: Dataset) -> DataFrame:
        """key, json in key order."""
        return self.spark.read.schema("key string, json string").parquet(self._at(dataset)).orderBy("key")

    def get(self, dataset: Dataset, key: str) -> DataFrame:
        return self.spark.read.schema("key string, json string").parquet(self._at(dataset)).where(F.col("key") == key).limit(1)

    def _at(self, dataset: Dataset) -> str:
        return f"{self.path}/{dataset.dataset_id}"


def violations(records: DataFrame, dataset: Dataset) -> DataFrame:
    """rule, n: the bounds that records break. Sizes are in bytes."""
    counts = records.agg(
        F.greatest(F.count("*") - dataset.max_records, F.lit(0)).alias("records"),
        F.count_if(F.octet_length("json") > dataset.max_value_bytes).alias("value_bytes"),
        F.count_if((F.octet_length("key") > 4096) | (F.col("key") == "") | F.col("key").isNull()).alias("key_bytes"),
        (F.count("key") - F.count_distinct("key")).alias("unique_keys"),
    )
    return counts.unpivot([], ["records", "value_bytes", "key_bytes", "unique_keys"], "rule", "n").where("n > 0")
