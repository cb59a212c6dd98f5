"""Reading cursors as a stream: arbitrary state per reader and book, and a table that takes the changes in.

A cursor is a place (chapter, sentence). Within a chapter it only goes forward; a move to another chapter takes it there.
So the order of moves counts, and input comes late, twice or in any order: moves wait in the state until the watermark
passes them and are then taken in the order of their times. Replays end in the same cursors: equal moves count once, and
the table keeps what is later.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from lectern.operators.views import sentence_key
from lectern.sources.scratch import delete

BUCKETS = 64
CURSOR = "reader string, book_id string, chapter int, sid string, at timestamp"


def _place(sid: str | None) -> tuple[int, int]:
    found = re.fullmatch(r"p(\d+)\.s(\d+)", sid or "")
    return (int(found[1]), int(found[2])) if found else (0, 0)


def advanced(cursor: tuple | None, move: tuple) -> tuple:
    """The cursor (chapter, sid, at) after a move (at, chapter, sid)."""
    at, chapter, sid = move
    if cursor and cursor[0] == chapter and _place(sid) <= _place(cursor[1]):
        return chapter, cursor[1], max(at, cursor[2])
    return chapter, sid, at


def _step(idle_ms: int | None):
    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        kept = json.loads(state.get[0]) if state.exists else {"cursor": None, "waiting": []}
        waiting = {tuple(m) for m in kept["waiting"]}
        if not state.hasTimedOut:
            for frame in frames:
                at = frame["ts"].astype("datetime64[us]").astype("int64").tolist()
                waiting |= {(a, int(c), s) for a, c, s in zip(at, frame["chapter"], frame["sid"], strict=True) if not pd.isna(c)}
        passed = state.getCurrentWatermarkMs()
        before = cursor = tuple(kept["cursor"]) if kept["cursor"] else None
        for move in sorted((m for m in waiting if m[0] // 1000 <= passed), key=lambda m: (m[0], m[1], _place(m[2]), m[2] or "")):
            cursor = advanced(cursor, move)
            waiting.discard(move)
        if waiting:
            state.update((json.dumps({"cursor": cursor, "waiting": sorted(waiting, key=str)}),))
            state.setTimeoutTimestamp(max(passed + 1, min(m[0] for m in waiting) // 1000 + 1))
        elif cursor and (idle_ms is None or cursor[2] // 1000 + idle_ms > passed):
            state.update((json.dumps({"cursor": cursor, "waiting": []}),))
            if idle_ms is not None:
                state.setTimeoutTimestamp(cursor[2] // 1000 + idle_ms)
        elif state.exists:
            state.remove()
        if cursor and cursor != before:
            at = pd.to_datetime([cursor[2]], unit="us")
            yield pd.DataFrame({"reader": [key[0]], "book_id": [key[1]], "chapter": [cursor[0]], "sid": [cursor[1]], "at": at})

    return step


def reading_cursors(moves: DataFrame, late: str = "1 hour", idle: str | None = None) -> DataFrame:
    """(reader, book_id, chapter, sid, at): each cursor as it changes, once the watermark has passed the moves.

    moves (a stream): reader, book_id, chapter, sid, ts; rows with a null reader, book, chapter or time don't count. Moves more than
    ``late`` behind the newest are dropped. With ``idle`` a reader's state goes after so long without a move, and their next
    move begins anew; else a reader keeps one place for good.
    """
    idle_ms = int(pd.Timedelta(idle).total_seconds() * 1000) if idle else None
    own = moves.select("reader", "book_id", F.col("chapter").cast("int").alias("chapter"), "sid", F.col("ts").cast("timestamp").alias("ts"))
    own = own.filter("reader is not null and book_id is not null and chapter is not null and ts is not null").withWatermark("ts", late)
    return own.groupBy("reader", "book_id").applyInPandasWithState(
        _step(idle_ms), CURSOR, "kept string", "update", GroupStateTimeout.EventTimeTimeout
    )


def _latest(rows: DataFrame) -> DataFrame:
    """The latest cursor of each reader and book."""
    place = sentence_key(F.col("sid"))
    order = Window.partitionBy("reader", "book_id").orderBy(F.col("at").desc(), F.col("chapter").desc(), place.desc(), "sid")
    return rows.withColumn("_n", F.row_number().over(order)).filter("_n = 1").drop("_n")


def _stored(spark: SparkSession, path: str) -> DataFrame | None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target):
        return None
    return spark.read.schema(f"{CURSOR}, bucket int, batch long").parquet(path)


def upserts(path: str, keep: int = 2) -> Callable[[DataFrame, int], None]:
    """For ``foreachBatch``: takes a batch's cursors into the table at ``path``.

    The table has ``BUCKETS`` buckets of readers; a batch writes new versions of those that it touches, and none else. A batch that
    runs again, after a crash or from its start, writes the same rows to the same place. ``keep`` versions of a bucket stay.
    """

    def run(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        bucket = F.pmod(F.xxhash64("reader", "book_id"), F.lit(BUCKETS)).cast("int")
        new = batch.withColumn("bucket", bucket).persist()
        try:
            touched = [r[0] for r in new.select("bucket").distinct().collect()]  # BUCKETS at most
            if not touched:
                return
            stored, old = _stored(spark, path), None
            if stored is not None:
                stored = stored.filter(F.col("bucket").isin(touched) & (F.col("batch") < number))
                old = {}
                for r in stored.select("bucket", "batch").distinct().collect():  # versions kept
                    old.setdefault(r["bucket"], []).append(r["batch"])
                last = F.lit(False)
                for b, versions in old.items():
                    last |= (F.col("bucket") == b) & (F.col("batch") == max(versions))
                new_rows = new.unionByName(stored.filter(last).drop("batch"))
            else:
                new_rows = new
            merged = _latest(new_rows).withColumn("batch", F.lit(number).cast("long")).repartition("bucket")
            merged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket", "batch").parquet(path)
            for b, versions in (old or {}).items():
                for version in sorted(versions)[: 1 - keep or None]:
                    delete(spark, f"{path}/bucket={b}/batch={version}")
        finally:
            new.unpersist()

    return run


def cursor_table(spark: SparkSession, path: str) -> DataFrame:
    """The cursors as last taken in."""
    rows = _stored(spark, path)
    if rows is None:
        return spark.createDataFrame([], CURSOR)
    last = rows.groupBy("bucket").agg(F.max("batch").alias("batch"))
    return rows.join(F.broadcast(last), ["bucket", "batch"]).select("reader", "book_id", "chapter", "sid", "at")
