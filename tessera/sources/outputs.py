"""Names of outputs that don't overwrite each other, with the configuration beside them."""

from __future__ import annotations

import json
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.sources.files import path_exists


def base_name(dataset: str, model: str, *marks: Any, cards: dict[str, Any] | None = None, most_dependencies: int | None = None) -> str:
    """Parts joined by underscores: data set, marks that are given, the model's last name, cards, the bound of dependencies."""
    parts = [dataset.lower(), *[str(m) for m in marks if m], model.rstrip("/").rsplit("/", 1)[-1] or "unknown_model"]
    parts += [f"{key}{value}" for key, value in (cards or {}).items()]
    return "_".join(parts + ([f"maxdep{most_dependencies}"] if most_dependencies else []))


def versioned(spark: SparkSession, folder: str, name: str, new: bool = True) -> tuple[str, str]:
    """Paths of the output and of its configuration: the first suffix under which neither exists; with ``new=False`` without one."""
    suffix = 0
    while True:
        own = f"{folder}/{name}" + (f"_{suffix}" if suffix else "")
        output, config = f"{own}.jsonl", f"{own}_config.json"
        if not new or not (path_exists(spark, output) or path_exists(spark, config)):
            return output, config
        suffix += 1


def write_versioned(rows: DataFrame, folder: str, name: str, config: dict[str, Any]) -> tuple[str, str]:
    """Writes rows as JSON lines and the configuration with sorted keys; returns both paths."""
    spark = rows.sparkSession
    output, beside = versioned(spark, folder, name)
    rows.write.json(output)
    spark.range(1).select(F.lit(json.dumps(config, sort_keys=True, default=str)).alias("value")).coalesce(1).write.text(beside)
    return output, beside
