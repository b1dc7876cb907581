"""Early stopping on a stream of epoch metrics."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

SCHEMA = "repeat string, fold int, epoch int, auc double"
NEVER = 2**31 - 1  # without a lateness a missing epoch is waited for until the run ends
OUT = "repeat string, fold int, best_epoch int, best_value double, stop_epoch int"
#: epochs of one batch that come together before they are merged
CHUNK = 1 << 18


class Early:
    """Epochs that came before their turn, as stretches (first, last, score of the first): all epochs of a
    stretch have come, and none of them scores more than its first.

    A stretch of more than `patience` epochs is a sure stop: whatever the best may be where it begins, the
    run stops in it, `patience` epochs after its first at the latest.  So nothing later is kept; `top` still
    is the latest epoch seen.
    """

    def __init__(self, patience: int, first=(), last=(), score=(), top: int = 0, cut: int = NEVER):
        self.patience, self.top, self.cut = patience, top, cut
        self.first, self.last, self.score = np.array(first, np.int64), np.array(last, np.int64), np.array(score, np.float64)

    def add(self, epoch: np.ndarray, score: np.ndarray, nxt: int) -> None:
        """Epochs from `nxt` on; of an epoch that comes twice the first one counts."""
        if not len(epoch):
            return
        epoch, at = np.unique(epoch, return_index=True)
        score = score[at]
        self.top = max(self.top, int(epoch[-1]))
        new = (epoch >= nxt) & (epoch <= self.cut)
        if len(self.first):
            own = np.searchsorted(self.first, epoch, "right") - 1
            new &= (own < 0) | (epoch > self.last[own])
        epoch, score = epoch[new], score[new]
        first, last = np.concatenate([self.first, epoch]), np.concatenate([self.last, epoch])
        score = np.concatenate([self.score, np.where(np.isnan(score), -np.inf, score)])
        order = np.argsort(first, kind="stable")
        first, last, score = first[order], last[order], score[order]
        if not len(first):
            return
        begins = np.append(True, first[1:] != last[:-1] + 1)
        highest = pd.Series(score).groupby(np.cumsum(begins)).cummax().to_numpy()
        kept = np.flatnonzero(begins | (score > np.append(-np.inf, highest[:-1])))
        first, last, score = first[kept], last[np.append(kept[1:], len(last)) - 1], score[kept]
        sure = np.flatnonzero(last - first >= self.patience)
        if len(sure):
            self.cut = min(self.cut, int(first[sure[0]]) + self.patience)
        n = np.searchsorted(first, self.cut, "right")
        self.first, self.last, self.score = first[:n], np.minimum(last[:n], self.cut), score[:n]


class StopWatcher(StatefulProcessor):
    """State per run, one record: best value, its epoch, next expected epoch, stop epoch, and the
    epochs that arrived early.  A run's row is emitted when it is first seen and whenever its answer
    changes; the last row of a run equals the batch result over the epochs seen.

    A missing epoch is waited for until one that lies more than `lateness` epochs later has come, until
    the run's end is announced (a row without an epoch), or, with `idle` milliseconds given, until a
    timer finds that nothing has come for so long.  Then it counts as lost, and counts for nothing
    should it come after all.  Nothing is kept after the stop; with `idle`, a record whose stop is
    settled goes with its timer, and state doesn't outlive its run.  Early epochs are kept as in `Early`.
    """

    def __init__(self, patience: int, min_epoch: int, lateness: int, idle: int | None = None):
        self.patience, self.min_epoch, self.lateness, self.idle = patience, min_epoch, lateness, idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        fields = "best double, best_epoch int, next int, stop int, epochs array<int>, lasts array<int>, scores array<double>, top int, cut int"
        self.state = handle.getValueState("run", fields)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        seen = self.state.exists()
        best, best_epoch, nxt, stop, *early = self.state.get() if seen else (-1.0, 0, self.min_epoch, 0, [], [], [], 0, NEVER)
        early, ended, some = self._early(early), False, False
        parts, n = [], 0
        for r in rows:
            ended = ended or bool(r["epoch"].isna().any())
            r = r[r["epoch"] >= self.min_epoch]
            some = some or len(r) > 0
            if not stop and len(r):
                parts.append((r["epoch"].to_numpy(np.int64), r["auc"].to_numpy(np.float64)))
                n += len(r)
            if n > max(CHUNK, len(early.first)):
                early.add(*map(np.concatenate, zip(*parts, strict=True)), nxt)
                parts, n = [], 0
        if parts:
            early.add(*map(np.concatenate, zip(*parts, strict=True)), nxt)
        if some or seen:
            yield from self._settle(key, seen, (best, best_epoch, nxt, stop), early, ended)
            if self.idle is not None:
                for t in list(self.handle.listTimers()):
                    self.handle.deleteTimer(t)
                self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.idle)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.state.exists():
            *run, epochs, lasts, scores, top, cut = self.state.get()
            yield from self._settle(key, True, run, self._early((epochs, lasts, scores, top, cut)), True)
            if self.state.get()[3]:
                self.state.clear()

    def _early(self, kept) -> Early:
        return Early(self.patience, *kept)

    def _settle(self, key, seen: bool, run, early: Early, ended: bool) -> Iterator[pd.DataFrame]:
        best, best_epoch, nxt, stop = run
        if stop:
            return
        start = (best_epoch, stop)
        done = 0
        for e, last, value in zip(early.first.tolist(), early.last.tolist(), early.score.tolist(), strict=True):
            if e > nxt and not ended and early.top - nxt <= self.lateness:
                break
            done, nxt = done + 1, last + 1
            if value > best:
                best, best_epoch, e = value, e, e + 1
            at = max(e, max(best_epoch, self.min_epoch - 1) + self.patience)
            if at <= last:
                stop, done = at, len(early.first)
                break
        kept = [x[done:].tolist() for x in (early.first, early.last, early.score)]
        self.state.update((best, best_epoch, nxt, stop, *kept, early.top, early.cut))
        if not seen or (best_epoch, stop) != start:
            yield pd.DataFrame({"repeat": [key[0]], "fold": [key[1]], "best_epoch": [best_epoch], "best_value": [best if best_epoch else None], "stop_epoch": [stop]}).astype({"best_value": "float64"})

    def close(self) -> None:
        pass


def early_stop_stream(stream: DataFrame, patience: int, min_epoch: int, lateness: int = NEVER, idle: int | None = None) -> DataFrame:
    """Streaming rows (repeat, fold, epoch, auc) to changes of each run's answer; a row without an epoch
    says that its run has ended.

    State per run is one record plus the stretches of epochs that overtook others (see `Early`); nothing is ever replayed.
    """
    return stream.groupBy("repeat", "fold").transformWithStateInPandas(
        statefulProcessor=StopWatcher(patience, min_epoch, lateness, idle), outputStructType=OUT, outputMode="Update",
        timeMode="None" if idle is None else "ProcessingTime",
    )


def run_available(spark: SparkSession, source: str, work: str, patience: int, min_epoch: int, per_batch: int = 2, lateness: int = NEVER) -> DataFrame:
    """Process all files in `source` and return the latest answer of every run.

    The stream also reads a folder of its own for the ends of runs.  It goes on twice from one
    checkpoint: over the input, and, when that has ended, over one end for each run seen, which settles
    what still waits for lost epochs.
    """
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    ends = f"{work}/ends"
    try:
        spark.createDataFrame([], SCHEMA).write.parquet(ends)
        both = [spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", per_batch).parquet(p) for p in (source, ends)]

        def save(df: DataFrame, batch: int) -> None:
            df.withColumn("batch", F.lit(batch)).write.mode("overwrite").parquet(f"{work}/out/part={batch}")

        def go() -> None:
            q = (
                early_stop_stream(both[0].unionByName(both[1]), patience, min_epoch, lateness).writeStream.outputMode("update")
                .option("checkpointLocation", f"{work}/checkpoint").trigger(availableNow=True).foreachBatch(save).start()
            )
            q.awaitTermination()

        go()
        out = spark.read.schema(f"{OUT}, batch int").parquet(f"{work}/out/*")
        runs = out.select("repeat", "fold").distinct()
        runs.select("repeat", "fold", F.lit(None).cast("int").alias("epoch"), F.lit(None).cast("double").alias("auc")).write.mode("append").parquet(ends)
        go()
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)
    out = spark.read.schema(f"{OUT}, batch int").parquet(f"{work}/out/*")
    last = out.groupBy("repeat", "fold").agg(F.max_by(F.struct("best_epoch", "best_value", "stop_epoch"), F.struct("batch", "best_epoch", "stop_epoch")).alias("r"))
    return last.select("repeat", "fold", "r.best_epoch", "r.best_value", F.when(F.col("r.stop_epoch") > 0, F.col("r.stop_epoch")).alias("stop_epoch"))
