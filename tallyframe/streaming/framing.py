"""Lines out of the chunks in which a connection delivers them: cut where the network cut, not where lines end."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Chunks of a run whose newlines are summed up as one, so that a long run is many tasks' work.
RANGE = 1024


def lines(chunks: DataFrame, keys: tuple[str, ...] = ("run_id", "turn"), span: int = RANGE) -> DataFrame:
    """keys, line_no (from 0), line: the whole lines of each run's chunks (keys, seq, chunk), without their newlines.

    A segmented carry: a line's number is the count of newlines before it. Newlines are summed by ranges of chunks first,
    then over the few ranges of a run, then within a range, so no task has to hold a run. Lines that lie within a chunk
    are done there; only heads and tails of chunks move, to the line that they are part of. A last line that no newline
    ends was cut off and is left out; null chunks are empty; numbers may have gaps but not repeat.
    """
    text = F.coalesce("chunk", F.lit(""))
    rows = chunks.select(*keys, "seq", F.split(text, "\n").alias("ps")).withColumn("n", (F.size("ps") - 1).cast("long")).withColumn("range", F.floor(F.col("seq") / span))
    totals = rows.groupBy(*keys, "range").agg(F.sum("n").alias("in_range"))
    whole = Window.partitionBy(*keys)
    before = F.coalesce(F.sum("in_range").over(whole.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = totals.select(*keys, "range", before.alias("start"), F.sum("in_range").over(whole).alias("total"))
    within = Window.partitionBy(*keys, "range").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.withColumn("carry", F.coalesce(F.sum("n").over(within), F.lit(0))).join(starts, [*keys, "range"])
    placed = placed.withColumn("first", F.col("start") + F.col("carry"))
    inner = placed.where("n > 1").select(*keys, "first", F.posexplode(F.slice("ps", F.lit(2), F.col("n").cast("int") - 1)).alias("i", "line"))
    inner = inner.select(*keys, (F.col("first") + F.col("i") + 1).alias("line_no"), "line")
    head = F.struct(F.col("first").alias("line_no"), F.get("ps", F.lit(0)).alias("part"))
    tail = F.struct((F.col("first") + F.col("n")).alias("line_no"), F.get("ps", F.col("n").cast("int")).alias("part"))
    ends = F.when(F.col("n") > 0, F.array(head, tail)).otherwise(F.array(head))
    parts = placed.select(*keys, "seq", "total", F.inline(ends)).where("line_no < total")
    glued = parts.groupBy(*keys, "line_no").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("seq", "part"))), lambda p: p["part"]), "").alias("line"))
    return inner.unionByName(glued)
