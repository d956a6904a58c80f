"""Completions folded while their lines stream in, in whatever order and batches these arrive.

One state for each run and turn, on the RocksDB store: the list of what its lines say. Each has its number, so one that is
delivered twice counts once. A completion is given out when the end mark and every line before it are there, or when its
time-out passes: a timer on the watermark, set anew by each line. Its state is then only a mark that it is over, which
goes after the same time again; until then lines that still come are told apart as late, as are lines behind the end mark.

With availableNow the watermark stands still after the last line, so whoever knows that a stream is over adds one line of
FLUSH, which is far enough ahead in time to let every time-out pass.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions import text as t
from ..sources import schemas
from . import counts, sse

#: run_id of the line that lets all time-outs pass.
FLUSH = "~flush"
#: Milliseconds added to arrivals, which may count from 0: an event at the very time 0 would be behind the first watermark.
ORIGIN_MS = 86_400_000
#: Milliseconds that a completion may be silent, and by which lines may be late or out of order.
SILENT_MS, DISORDER = 60_000, "1 hour"
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
LINE = "seq long, done boolean, payload boolean, arrival double, content string, reasoning string, calls string, finish_reason string"
FOLDED = (
    "run_id string, turn int, ended string, n_lines long, n_late long, response_text string, reasoning_text string, first_at double, last_at double, "
    "n_payloads long, finish_reason string, calls string"
)
_FIELDS = [f.split()[0] for f in LINE.split(", ")]
_ROW = Row(*(f.split()[0] for f in FOLDED.split(", ")))


class Fold(StatefulProcessor):
    """A batch's lines of a key go to its list in one call; n counts them with what came twice, so the list is read only when it may be whole.

    Every call to the state is a round trip. A key's timer therefore stays where it was set first, and when it rings with
    the time-out (due) put off meanwhile, it is set anew, so that a batch takes no more than reading and writing the facts.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.lines = handle.getListState("lines", LINE)
        self.facts = handle.getValueState("facts", "n long, done long, timer long, over boolean, due long")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        n, done, timer, over, due = self.facts.get() or (0, None, None, False, 0)
        late, latest, new = 0, 0, []
        for r in rows:
            latest = max(latest, int(r.at.timestamp() * 1000))
            if over or (done is not None and r.seq > done):
                late += 1
                continue
            new.append(tuple(r[c] for c in _FIELDS))
            if r.done:
                done = r.seq
        if new:
            self.lines.appendList(new)
        n += len(new)
        due = max(latest + SILENT_MS, due)
        if timer is None:
            timer = due
            self.handle.registerTimer(timer)
        kept = self._kept() if not over and done is not None and n > done else {}
        ended = bool(kept) and sum(k <= done for k in kept) == done + 1
        if ended:
            yield self._out(key, "done", done, late, kept)
        elif late:
            yield _ROW(*key, "late", 0, late, *[None] * 7)
        self.facts.update((n, done, timer, over or ended, due))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        n, done, timer, over, due = self.facts.get()
        if due > timer and due > timerValues.getCurrentWatermarkInMs():  # lines came since the timer was set
            self.handle.registerTimer(due)
            self.facts.update((n, done, due, over, due))
            return
        if over:
            self.facts.clear()
            return
        due += SILENT_MS
        self.handle.registerTimer(due)
        self.facts.update((n, done, due, True, due))
        yield self._out(key, "time-out", done, 0, self._kept())

    def _kept(self) -> dict[int, Row]:
        """The lines by number; one that came twice is there once."""
        return {x[0]: x for x in self.lines.get()}

    def _out(self, key, ended: str, done: int | None, late: int, kept: dict) -> Row:
        """What the lines up to the end mark come to; those behind it are late."""
        self.lines.clear()
        mine = [kept[k] for k in sorted(kept) if done is None or k <= done]
        at = [x[3] for x in mine if x[2]]
        text = lambda i: "".join(x[i] for x in mine if x[i])
        calls = "[" + ",".join(f'{{"seq":{x[0]},"calls":{x[6]}}}' for x in mine if x[6]) + "]"
        reasons = [x[7] for x in mine if x[7]]
        return _ROW(*key, ended, len(mine), late + len(kept) - len(mine), text(4), text(5), min(at, default=None), max(at, default=None), len(at), reasons[-1] if reasons else None, calls)


def fold(lines: DataFrame) -> DataFrame:
    """Of a stream of lines (run_id, turn, seq from 0, arrival in seconds, line): a row for each completion that ends, and one for lines that came late."""
    said = sse.read(lines.select("run_id", "turn", "seq", "arrival", "line"))
    payload = F.col("event") & (F.col("content").isNotNull() | F.col("reasoning").isNotNull() | F.col("tool_calls").isNotNull())
    flat = said.select(
        "run_id", "turn", "seq", F.timestamp_millis((F.col("arrival") * 1000).cast("long") + ORIGIN_MS).alias("at"), "done", F.coalesce(payload, F.lit(False)).alias("payload"), "arrival",
        *(F.when(F.col("event"), F.col(c)).alias(c) for c in ("content", "reasoning")), F.when(F.col("event"), F.to_json("tool_calls")).alias("calls"), F.when(F.col("event"), F.col("finish_reason")).alias("finish_reason"),
    )
    keyed = flat.withWatermark("at", DISORDER).groupBy("run_id", "turn")
    return keyed.transformWithState(Fold(), FOLDED, "append", "EventTime").where(F.col("run_id") != FLUSH)


def completions(folded: DataFrame) -> DataFrame:
    """The rows of fold() that ended, as sse.fold has them, with ended and n_late; lines that came later still are counted in."""
    late = folded.groupBy("run_id", "turn").agg(F.sum("n_late").alias("n_late"))
    ended = folded.where("ended <> 'late'").drop("n_late").join(late, ["run_id", "turn"])
    ended = ended.withColumns({"response_text": t.strip(F.col("response_text")), "started": F.lit(0.0)})
    return sse.timed(ended, "ended", "n_lines", "n_late")


def call_deltas(folded: DataFrame) -> DataFrame:
    """The tool-call deltas of fold()'s rows, as sse.merge_calls takes them."""
    each = F.from_json("calls", f"array<struct<seq: long, calls: array<{schemas.DELTA_CALL}>>>")
    one = folded.where("ended <> 'late'").select("run_id", "turn", F.inline(each)).select("run_id", "turn", "seq", F.posexplode("calls").alias("at", "c"))
    return one.select("run_id", "turn", F.struct("seq", "at").alias("seq"), F.coalesce("c.index", F.lit(0)).alias("index"), F.col("c.id").alias("id"), F.col("c.function.name").alias("name"), F.col("c.function.arguments").alias("arguments"))


def flush_line(spark: SparkSession, latest: float) -> DataFrame:
    """The line that ends a stream whose last arrival is `latest`: beyond the disorder and twice the time-out."""
    return spark.createDataFrame([(FLUSH, 0, 0, float(latest + 3 * 3600), "")], schemas.CHUNK)


def run_files(spark: SparkSession, path: str, batch_files: int = 1) -> DataFrame:
    """fold() over a folder of chunk files until all are read, so many of them in a batch; the rows are kept under the own path of the run."""
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass", None)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    try:
        stream = spark.readStream.schema(schemas.struct(schemas.CHUNK)).option("maxFilesPerTrigger", batch_files).json(path)
        return counts.run_to_end(fold(stream), counts.own_path(spark, "completions"), mode="append")
    finally:
        if before:
            spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
        else:
            spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
