"""Rows that can't be used, kept with their reason and place instead of vanishing, and counted in the pass that reads them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..streaming import sse
from . import schemas

#: Columns of a dead-letter row: why, where, and the raw text.
DEAD = ("reason", "place", "raw")


def event_reason(line: Column) -> Column:
    """Why a line of a stream of events says nothing; null where it does. Comments, blanks and the end mark are no faults."""
    text = F.trim(line)
    body = F.when(F.startswith(text, F.lit("data: ")), F.substr(text, F.lit(7)))
    choices = F.from_json(body, schemas.struct("e " + schemas.EVENT)["e"].dataType)["choices"]
    fault = F.when(F.try_parse_json(body).isNull(), "not JSON").when(F.coalesce(F.size(choices), F.lit(0)) < 1, "no choice")
    plain = line.isNull() | (text == "") | F.startswith(text, F.lit(":")) | (text == sse.DONE)
    return F.when(plain, None).when(body.isNull(), "no data line").otherwise(fault)


def file_reason(content: Column, root: Column | None = None) -> Column:
    """Why a file of results adds no rows; null where it can. root: what must be an object inside it."""
    inside = content if root is None else root
    return F.when(F.trim(F.coalesce(content, F.lit(""))) == "", "empty").when(F.try_parse_json(content).isNull(), "not JSON").when(F.json_object_keys(inside).isNull(), "no object")


@dataclass
class Sorted:
    """What divide() wrote: good and dead rows, and the counts that were observed on the way: n_read, n_good, n_<reason>."""

    good: DataFrame
    dead: DataFrame
    counts: dict[str, int]


def divide(rows: DataFrame, reason: Column, place: Column, raw: Column, path: str, reasons: tuple[str, ...]) -> Sorted:
    """Writes rows to <path>/fault=<reason>, good ones to fault=none, in one pass that also counts them, and reads both back.

    The table is partitioned by the reason, so reading the good rows opens none of the others. A reason that isn't listed
    counts as n_other.
    """
    name = lambda r: "n_" + r.replace(" ", "_")
    told = rows.withColumns({"fault": F.coalesce(reason, F.lit("none")), "__place": place.cast("string"), "__raw": raw})
    seen = Observation()
    one = lambda c: F.count_if(c)
    observed = told.observe(
        seen, F.count(F.lit(1)).alias("n_read"), one(F.col("fault") == "none").alias("n_good"),
        *(one(F.col("fault") == r).alias(name(r)) for r in reasons), one(~F.col("fault").isin("none", *reasons)).alias("n_other"),
    )
    kept = F.col("fault") == "none"
    observed.withColumns({"__place": F.when(~kept, F.col("__place")), "__raw": F.when(~kept, F.col("__raw"))}).write.partitionBy("fault").parquet(path)
    spark = rows.sparkSession
    schema = observed.drop("fault").schema.add("fault", "string")
    back = spark.read.schema(schema).parquet(path)
    good = back.where(kept).select(*rows.columns)
    dead = back.where(~kept).select(F.col("fault").alias("reason"), F.col("__place").alias("place"), F.col("__raw").alias("raw"))
    return Sorted(good, dead, {k: int(v) for k, v in seen.get.items()})
