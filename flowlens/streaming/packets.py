"""Flow records from a packet stream."""

from __future__ import annotations

import json
from bisect import bisect_left
from collections.abc import Iterator
from operator import add

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import LongType, StructField, StructType

from flowlens.operators.flows import flow_record, flow_sums, merge_sums
from flowlens.session import remove

PACKET_SCHEMA = "uid string, ts timestamp, is_orig boolean, flags string, len bigint"


def flow_sessions(packets: DataFrame, gap: str, delay: str, idle: bool = True) -> DataFrame:
    """Flows closed by an idle gap in their own time, kept in Spark's session state.

    The smallest packet gap is taken from the distinct instants of a session, which its
    state then holds; ``idle=False`` leaves them and the column out. A date far ahead moves
    Spark's watermark with it: where dates cannot be trusted use ``flow_states``.
    """
    size = F.col("len").cast("double")
    fwd, bwd = F.when(F.col("is_orig"), size), F.when(~F.col("is_orig"), size)
    sessions = packets.withWatermark("ts", delay).groupBy("uid", F.session_window("ts", gap).alias("session"))
    instants = [F.collect_set(F.unix_micros("ts")).alias("_instants")] if idle else []
    sums = sessions.agg(
        F.min("ts").alias("_first"), F.max("ts").alias("_last"),
        F.count(fwd).alias("_fn"), F.count(bwd).alias("_bn"),
        F.sum(fwd).alias("_fsum"), F.sum(bwd).alias("_bsum"), F.sum(bwd * bwd).alias("_bsq"),
        F.min(fwd).alias("_fmin"), F.min(bwd).alias("_bmin"), F.max(bwd).alias("_bmax"),
        F.count_if(fwd > 0).alias("_data"),
        F.count_if(F.contains(F.col("flags"), F.lit("P"))).alias("_psh"), *instants,
    )
    if not idle:
        return flow_record(sums.withColumn("_gap", F.lit(None).cast("double"))).drop("idle_min")
    return flow_record(sums.withColumn("_gap", _least_gap(F.array_sort("_instants"))))


def _least_gap(instants: Column) -> Column:
    """Smallest difference of neighbours in sorted microseconds, in seconds."""
    later = F.slice(instants, F.lit(2), F.size(instants))
    return F.array_min(F.zip_with(later, instants, lambda b, a: (b - a) / F.lit(1e6)))


# --- keyed state -------------------------------------------------------------------------

# Sums of packets of one flow: those of some packets, of a flow's state, and of the output.
_COUNTS, _TOTALS = ("fn", "bn", "data", "psh"), ("fsum", "bsum", "bsq")
_LEAST, _MOST = ("fmin", "bmin"), ("bmax",)
_SUMS = ", ".join([*[f"{c} bigint" for c in _COUNTS], *[f"{c} double" for c in (*_TOTALS, *_LEAST, *_MOST)]])
_PART = "uid string, part string"
_STATE = f"{_SUMS}, first bigint, last bigint, gap double, recent array<bigint>, opened bigint, heard bigint"
_OUT = f"uid string, {_SUMS}, first bigint, last bigint, gap double, opened bigint, closed boolean"
_NAMES = (*_COUNTS, *_TOTALS, *_LEAST, *_MOST)
_TAKEN = (*_NAMES, "instants")
_KEPT = [c.split()[0] for c in _STATE.split(", ")]
_OUT_ROW = Row(*[c.split()[0] for c in _OUT.split(", ")])


def _packet_sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """One row for each flow of a batch: its sums and the distinct instants of its packets, as a JSON array."""
    for b in batches:
        size, orig = b["len"].astype("float64"), b["is_orig"].astype("boolean")
        fwd, bwd = size.where(orig.fillna(False)), size.where(~orig.fillna(True))
        rows = pd.DataFrame({
            "uid": b["uid"], "fn": fwd.notna().astype("int64"), "bn": bwd.notna().astype("int64"),
            "data": (fwd > 0).astype("int64"), "psh": b["flags"].fillna("").str.contains("P", regex=False).astype("int64"),
            "fsum": fwd, "bsum": bwd, "bsq": bwd * bwd, "fmin": fwd, "bmin": bwd, "bmax": bwd})
        groups = rows.groupby("uid", sort=False)
        made = groups.agg({**{c: "sum" for c in (*_COUNTS, *_TOTALS)}, **{c: "min" for c in _LEAST}, **{c: "max" for c in _MOST}})
        codes, uids = pd.factorize(b["uid"])  # in order of first appearance, as the groups are
        seen = pd.DataFrame({"code": codes, "micros": b["micros"]}).dropna().drop_duplicates().sort_values(["code", "micros"])
        micros = seen["micros"].astype("int64").to_numpy()
        edges = np.searchsorted(seen["code"].to_numpy(), np.arange(len(uids) + 1))
        columns = [made[c].tolist() for c in _NAMES]
        instants = [micros[i:j].tolist() for i, j in zip(edges, edges[1:])]
        yield pd.DataFrame({"uid": made.index, "part": [json.dumps(values) for values in zip(*columns, instants)]})


def _merged(a: float | None, b: float | None, take) -> float | None:
    # Only NaN differs from itself.
    if a is None or a != a:
        return None if b is None or b != b else float(b)
    return float(a) if b is None or b != b else float(take(a, b))


class FlowProcessor(StatefulProcessor):
    """State of one flow: its sums, its smallest gap, and the instants that late packets may fall between.

    The flow is emitted whenever packets touch it, and once more, as closed, when none has
    arrived for ``idle_ms``. The clock is that of arrival, so no date, however wrong, closes
    a flow or keeps it open.

    A flow has one timer. When that runs out, it is set again for as long as the last arrival
    asks for, so that packets need not move it.
    """

    def __init__(self, idle_ms: int, late_micros: int | None) -> None:
        self.idle_ms, self.late = idle_ms, late_micros

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.flow = handle.getValueState("flow", _STATE)

    def close(self) -> None:
        pass

    def handleInputRows(self, key, rows, timerValues):
        now = timerValues.getCurrentProcessingTimeInMs()
        old = self.flow.get()
        state, instants = self._begun(old, now)
        for row in rows:
            self._add(state, instants, row.asDict())
        self._order(state, sorted(instants))
        self.flow.update(tuple(state[c] for c in _KEPT))
        if not old:
            self.handle.registerTimer(now + self.idle_ms)
        yield self._row(key[0], state, False)

    def _begun(self, old, now: int) -> tuple[dict, set]:
        """The state of a flow that is heard of now, and its instants, to which packets are added."""
        state = dict(zip(_KEPT, old)) if old else {**{c: 0 if c in _COUNTS else None for c in _KEPT}, "opened": now}
        state["heard"] = now
        return state, set(state["recent"] or ())

    def _add(self, state: dict, instants: set, part: dict) -> None:
        for c in _COUNTS:
            state[c] += part[c]
        for names, take in ((_TOTALS, add), (_LEAST, min), (_MOST, max)):
            for c in names:
                state[c] = _merged(state[c], part[c], take)
        instants.update(part["instants"])

    def _order(self, state: dict, instants: list[int]) -> None:
        """Take in sorted instants, among them those kept. A gap that a late packet divides only gets
        smaller, so the smallest one so far never has to be taken back."""
        if instants:
            state["first"] = instants[0] if state["first"] is None else min(state["first"], instants[0])
            state["last"] = instants[-1] if state["last"] is None else max(state["last"], instants[-1])
        if len(instants) > 1:
            state["gap"] = _merged(state["gap"], min(b - a for a, b in zip(instants, instants[1:])) / 1e6, min)
        keep = 0 if self.late is None or not instants else max(0, bisect_left(instants, instants[-1] - self.late) - 1)
        state["recent"] = instants[keep:]

    def _row(self, uid: str, state: dict, closed: bool) -> Row:
        return _OUT_ROW(uid, *[state[c] for c in (*_NAMES, "first", "last", "gap", "opened")], closed)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        old = self.flow.get()
        if old:
            state = dict(zip(_KEPT, old))
            until = state["heard"] + self.idle_ms
            if until > timerValues.getCurrentProcessingTimeInMs():
                self.handle.registerTimer(until)
            else:
                yield self._row(key[0], state, True)
                self.flow.clear()


class FlowGroupProcessor(FlowProcessor):
    """State of the flows of one group, read and written at once.

    Messages between a task and its state cost far more than the sums of a flow, so the flows
    of a group share them, and rows come and go as JSON texts (``uid, part`` in, ``records`` out).
    The state is a JSON object of the values of each flow by its uid. A group has one timer,
    never later than the first of its flows may have to be closed.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.group = handle.getValueState("flows", "flows string")

    def handleInputRows(self, key, rows, timerValues):
        now = timerValues.getCurrentProcessingTimeInMs()
        old = self.group.get()
        flows = json.loads(old[0]) if old else {}
        heard: dict[str, tuple[dict, set]] = {}
        for row in rows:
            uid = row["uid"]
            if uid not in heard:
                heard[uid] = self._begun(flows.get(uid), now)
            self._add(*heard[uid], dict(zip(_TAKEN, json.loads(row["part"]))))
        for uid, (state, instants) in heard.items():
            self._order(state, sorted(instants))
            flows[uid] = [state[c] for c in _KEPT]
        self.group.update((json.dumps(flows),))
        if not old:
            self.handle.registerTimer(now + self.idle_ms)
        yield from self._records([self._row(uid, state, False) for uid, (state, _) in heard.items()])

    def _records(self, rows: list[Row], at_once: int = 1000) -> Iterator[Row]:
        for i in range(0, len(rows), at_once):
            yield Row(records=json.dumps([r.asDict() for r in rows[i:i + at_once]]))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        now, old = timerValues.getCurrentProcessingTimeInMs(), self.group.get()
        if not old:
            return
        flows = {uid: dict(zip(_KEPT, values)) for uid, values in json.loads(old[0]).items()}
        opened = {uid: state for uid, state in flows.items() if state["heard"] + self.idle_ms > now}
        if opened:
            self.handle.registerTimer(min(state["heard"] for state in opened.values()) + self.idle_ms)
        if len(opened) < len(flows):
            if opened:
                self.group.update((json.dumps({uid: [state[c] for c in _KEPT] for uid, state in opened.items()}),))
            else:
                self.group.clear()
        yield from self._records([self._row(uid, state, True) for uid, state in flows.items() if uid not in opened])


def flow_states(packets: DataFrame, idle_seconds: float, late_seconds: float | None = None,
                groups: int = 32_768) -> DataFrame:
    """Flow records of a packet stream from keyed state; for a query in update mode.

    The state is keyed by ``groups`` hash groups of flows. A micro-batch reads and writes only the
    groups that it touches, and gives one record for each flow that it touches: all columns of a flow record, ``opened`` (arrival of its first
    packet, which tells the records of one uid apart) and ``closed``. The last record of
    (uid, opened) counts (``last_records``). A flow is closed when no packet arrived for
    ``idle_seconds``; later ones are a record of their own.

    Packets may come in any order and with any date. ``idle_min`` is exact for packets that
    are at most ``late_seconds`` older than the newest of their flow; without a bound the
    distinct instants of an open flow stay in its state. Packets are summed where they are
    read first, so a flow with very many of them reaches its task as a few rows. Packets
    without a uid are left out.

    With few open flows a group has one of them at most. With very many, more ``groups`` make
    batches cheaper that touch few flows, and fewer make those cheaper that touch most. Their
    number belongs to the checkpoint: a query goes on with the one that it began with.

    Sets the session's state store to RocksDB, which keyed state with timers needs.
    """
    spark = packets.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass",
                   "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    rows = packets.filter("uid is not null").select("uid", "is_orig", "flags", "len", F.unix_micros(F.col("ts").cast("timestamp")).alias("micros"))
    parts = rows.mapInPandas(_packet_sums, _PART).withColumn("group", F.pmod(F.xxhash64("uid"), F.lit(groups)))
    late = None if late_seconds is None else int(late_seconds * 1e6)
    flows = parts.groupBy("group").transformWithState(
        FlowGroupProcessor(int(idle_seconds * 1000), late), "records string", "update", "ProcessingTime")
    flows = flows.select(F.inline(F.from_json("records", f"array<struct<{_OUT.replace(' ', ':').replace(',:', ',')}>>")))
    flows = flows.withColumns({**{f"_{c}": F.col(c) for c in _NAMES}, "_first": F.timestamp_micros("first"), "_last": F.timestamp_micros("last"), "_gap": F.col("gap")})
    return flow_record(flows, keep=["opened", "closed"])


def last_records(spark: SparkSession, path: str) -> DataFrame:
    """The last record of every flow from what a query wrote by batch (``live.batch_writer``)."""
    rows = spark.read.parquet(path)
    row = F.struct(*[c for c in rows.columns if c != "batch"])
    return rows.groupBy("uid", "opened").agg(F.max_by(row, F.struct("batch", "closed")).alias("r")).select("r.*")


# --- whole state by batch ----------------------------------------------------------------


class FlowSink:
    """``foreachBatch`` sink: open flows are kept as one row of sums each.

    A micro-batch is reduced to one row per flow by the batch operator (hot flows are
    spread over many tasks), merged with the open flows, and flows without packets for
    ``idle_seconds`` before the clock are written out as closed.

    The clock is the newest packet time that is at most ``ahead_seconds`` beyond the clock of
    the batch before. Packets dated farther ahead stay with their flow but do not move it,
    so a wrong date closes nothing; when a whole batch lies beyond, the clock moves to its
    first packet. Such a packet counts as
    heard of at the clock of its batch, and holds its flow for ``hold_seconds`` (twice the idle
    time) from then on, because the date may still turn out right. Packets may come late: they join their flow while it is open. Those that
    come after it was closed are a record of their own.

    State, clock and output are folders numbered by batch: a repeated batch rewrites its own
    folders. State older than the batch before is deleted. All open flows are rewritten in
    each batch; ``flow_states`` writes only those it touches.
    """

    def __init__(self, path: str, idle_seconds: float, ahead_seconds: float | None = None, hold_seconds: float | None = None) -> None:
        self.path, self.idle = path, idle_seconds
        self.hold = 2 * idle_seconds if hold_seconds is None else hold_seconds
        self.ahead = idle_seconds if ahead_seconds is None else ahead_seconds

    def _clock(self, sums: DataFrame, number: int) -> int | None:
        """Clock after a batch, in microseconds."""
        last, first = F.unix_micros("_last"), F.unix_micros("_first")
        before = None
        if number > 0:
            before = sums.sparkSession.read.parquet(f"{self.path}/clock/batch={number - 1}").first()["micros"]
        if before is None:
            # Nothing is known yet: the earliest packet starts the clock.
            before = sums.agg(F.min(first)).first()[0]
        if before is None:
            return None
        limit = F.lit(before + int(self.ahead * 1e6))
        newest, start = sums.agg(F.max(F.when(last <= limit, last)), F.min(first)).first()
        return max(before, newest if newest is not None else start or before)

    def __call__(self, batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        sums = flow_sums(batch)
        fresh = f"{self.path}/fresh/batch={number}"
        sums.write.mode("overwrite").parquet(fresh)
        sums = spark.read.schema(sums.schema).parquet(fresh)
        clock = self._clock(sums, number)
        spark.createDataFrame([(clock,)], "micros bigint").write.mode("overwrite").parquet(f"{self.path}/clock/batch={number}")
        # When the flow was last heard of by the clock, whatever its packets are dated.
        heard = F.least(F.unix_micros("_last"), F.lit(clock).cast("bigint"))
        seen = sums.select("uid", heard.alias("_seen"))
        schema = StructType([*sums.schema.fields, StructField("_seen", LongType())])
        merged = sums
        if number > 0:
            opened = spark.read.schema(schema).parquet(f"{self.path}/open/batch={number - 1}")
            merged = merge_sums(sums.unionByName(opened.drop("_seen")))
            seen = seen.unionByName(opened.select("uid", "_seen")).groupBy("uid").agg(F.max("_seen").alias("_seen"))
        merged = merged.join(seen.withColumnRenamed("uid", "_uid"), F.col("uid").eqNullSafe(F.col("_uid"))).drop("_uid")
        work = f"{self.path}/merged/batch={number}"
        merged.write.mode("overwrite").parquet(work)
        merged = spark.read.schema(schema).parquet(work)
        ahead = F.unix_micros("_last") > F.lit(clock).cast("bigint")
        limit = F.lit(clock).cast("bigint") - F.when(ahead, F.lit(int(self.hold * 1e6))).otherwise(F.lit(int(self.idle * 1e6)))
        done = F.coalesce(F.col("_seen") < limit, F.lit(False))
        merged.filter(~done).write.mode("overwrite").parquet(f"{self.path}/open/batch={number}")
        flow_record(merged.filter(done)).write.mode("overwrite").parquet(f"{self.path}/closed/batch={number}")
        for kind in ("fresh", "merged", "open", "clock"):
            remove(spark, f"{self.path}/{kind}/batch={number - 2}")

    def flows(self, spark: SparkSession, last_batch: int) -> DataFrame:
        """All flows: the closed ones and what is still open after ``last_batch``."""
        closed = spark.read.parquet(f"{self.path}/closed").drop("batch")
        opened = spark.read.parquet(f"{self.path}/open/batch={last_batch}")
        return closed.unionByName(flow_record(opened))
