"""Summaries of run logs: lines "<description>: <seconds>"."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def timings(lines: DataFrame) -> DataFrame:
    """lines(file, line) -> file, key, value of the lines that end with a decimal number; runs of blanks in keys count as one."""
    ends = F.col("line").rlike(r"\d+\.\d+$")
    words = F.filter(F.split(F.trim("line"), r"\s+"), lambda w: w != "")
    return lines.where(ends).select("file", F.array_join(F.slice(words, 1, F.size(words) - 1), " ").alias("key"), F.element_at(words, -1).try_cast("double").alias("value")).where("value is not null")


def repeated_keys(found: DataFrame) -> DataFrame:
    """Keys that a file has more or less than once, against all files."""
    files = found.agg(F.count_distinct("file").alias("n")).scalar()
    return found.groupBy("key").agg(F.count("*").alias("times")).where(F.col("times") != files)


def summary(found: DataFrame) -> DataFrame:
    """(key, mean, var), with the population variance."""
    return found.groupBy("key").agg(F.avg("value").alias("mean"), F.var_pop("value").alias("var"))


def totals(found: DataFrame) -> DataFrame:
    """(key, mean) of the keys that have TOTAL, to three places."""
    return summary(found).where(F.col("key").contains("TOTAL")).select("key", F.round("mean", 3).alias("mean"))


def to_json(summed: DataFrame) -> DataFrame:
    """One row: the JSON object of a summary, {key: [mean, var]}, or of totals, {key: mean}."""
    value = F.array("mean", "var") if "var" in summed.columns else F.col("mean")
    return summed.agg(F.to_json(F.map_from_entries(F.sort_array(F.collect_list(F.struct(F.col("key"), value.alias("v")))))).alias("json"))


def write_reports(found: DataFrame, folder: str) -> None:
    """Both JSON files, summary and totals, under the folder; a key that isn't in each file once is refused."""
    odd = repeated_keys(found).orderBy("key").limit(3).collect()
    if odd:
        raise ValueError(f"not once in each file: {', '.join(r.key for r in odd)}")
    for name, summed in (("summary", summary(found)), ("totals", totals(found))):
        to_json(summed).select(F.col("json").alias("value")).write.text(f"{folder}/{name}")
