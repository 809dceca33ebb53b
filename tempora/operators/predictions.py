"""Predictions that can't have seen their labels: inputs are checked by the names of their fields and by the files that their
plan reads, and labels are attached after scoring."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Fields that name a label, or give one away.
LABEL_FIELDS = r"(?i)(^|_)(human|reviewer|consensus|label|final_?score|adjudicat\w*)(_|$)"


class LeakError(ValueError):
    """An input that holds, or is made of, labels."""


def field_names(kind: T.DataType, path: str = "") -> list[str]:
    """All fields of a type, nested ones by their paths."""
    if isinstance(kind, T.StructType):
        return [name for f in kind.fields for name in (f"{path}{f.name}", *field_names(f.dataType, f"{path}{f.name}."))]
    if isinstance(kind, T.ArrayType):
        return field_names(kind.elementType, path)
    return field_names(kind.valueType, path) if isinstance(kind, T.MapType) else []


def refuse_leaks(inputs: DataFrame, labels: Sequence[DataFrame] = (), pattern: str = LABEL_FIELDS, allowed: Sequence[str] = ()) -> None:
    """Raises LeakError if a field of the inputs is named like a label, at any depth, or if their plan reads a file that a table
    of labels reads, whatever was renamed on the way. `allowed` names fields that may stay."""
    named = [n for n in field_names(inputs.schema) if re.search(pattern, n.rsplit(".", 1)[-1]) and n not in allowed]
    if named:
        raise LeakError(f"fields named like labels: {', '.join(sorted(named))}")
    read = set(inputs.inputFiles())
    for table in labels:
        if shared := read & set(table.inputFiles()):
            raise LeakError(f"inputs are made of labels: {sorted(shared)[0]}")


def prediction_package(inputs: Sequence[DataFrame], score: Callable[[DataFrame], DataFrame], labels: DataFrame, key: str, label: str) -> DataFrame:
    """What `score` makes of the inputs, put together by name, with the label of each row as the last step.

    Inputs and scores are checked for leaks before anything runs. A key that repeats among the inputs, or is missing, is an
    error raised by the task that meets it; rows without a label keep a null.
    """
    whole = inputs[0]
    for more in inputs[1:]:
        whole = whole.unionByName(more, allowMissingColumns=True)
    refuse_leaks(whole, [labels])
    scored = score(whole)
    refuse_leaks(scored, [labels])
    counts = scored.groupBy(key).agg(F.count("*").alias("_n"))
    bad = F.raise_error(F.concat(F.lit("a key is missing or repeats: "), F.coalesce(F.col(key).cast("string"), F.lit("null"))))
    once = counts.withColumn("_n", F.when((F.col("_n") == 1) & F.col(key).isNotNull(), F.col("_n")).otherwise(bad.cast("long"))).where("_n = 1").drop("_n")
    return once.join(scored, key).join(labels.select(key, F.col(label)).dropDuplicates([key]), key, "left")
