"""The life of a job as a state machine: one table of moves, folded over a table of commands or kept along a stream."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_LIVE = ("queued", "running", "pause_requested", "paused", "cancel_requested", "succeeded", "failed", "cancelled")
_AT_WORK = ("running", "pause_requested", "cancel_requested")
#: (command, status) -> status; other commands change nothing. A job that waits for deletion goes when its worker ends.
MOVES: dict[tuple[str, str], str] = {
    ("submit", "none"): "queued",
    ("claim", "queued"): "running",
    ("pause", "queued"): "paused",
    ("pause", "running"): "pause_requested",
    ("paused", "pause_requested"): "paused",
    ("resume", "paused"): "queued",
    ("resume", "failed"): "queued",
    ("cancel", "queued"): "cancelled",
    ("cancel", "running"): "cancel_requested",
    **{("delete", s): "delete_requested" for s in (*_AT_WORK, "delete_requested")},
    **{("delete", s): "none" for s in _LIVE if s not in _AT_WORK},
    **{(c, s): t for c, t in (("succeed", "succeeded"), ("fail", "failed"), ("stop", "cancelled")) for s in _LIVE},
    **{(c, "delete_requested"): "none" for c in ("succeed", "fail", "stop")},
    **{("progress", s): s for s in _AT_WORK},
}
STATUSES = ["none", "delete_requested", *_LIVE]
#: Progress after a command that moves: a value, else the larger of the old one and the command's.
RESETS = {"submit": 0, "succeed": 100, "stop": 0}


def move(status: str, progress: int, command: str, value: int | None) -> tuple[str, int]:
    to = MOVES.get((command, status))
    if to is None:
        return status, progress
    if command in RESETS:
        return to, RESETS[command]
    return to, max(progress, value or 0) if command == "progress" else progress


def job_states(commands: DataFrame, chunk: int = 10_000) -> DataFrame:
    """(job_id, status, progress) after all commands: job_id, seq, command, value. status is none for jobs unknown or deleted; nulls in command do nothing.

    Commands of a job are cut by seq into chunks; each is folded from every status it may start in, and the chunks are then chained,
    so no list grows beyond a chunk's commands, or a job's chunks. A null seq comes first; ties go by command, then value.
    """
    code = F.create_map(*[F.lit(x) for (c, s), to in MOVES.items() for x in (f"{c} {s}", to)])
    resets = F.create_map(*[F.lit(x) for c, v in RESETS.items() for x in (c, v)])
    unset = F.struct(F.lit("none").alias("status"), F.lit(0).cast("long").alias("progress"), F.lit(False).alias("reset"))

    def step(acc, e):
        to = F.try_element_at(code, F.concat_ws(" ", e["command"], acc["status"]))
        reset = to.isNotNull() & F.coalesce(F.array_contains(F.map_keys(resets), e["command"]), F.lit(False))
        more = F.when(to.isNotNull() & (e["command"] == "progress"), F.coalesce(e["value"], F.lit(0))).otherwise(F.lit(0))
        progress = F.when(reset, F.try_element_at(resets, e["command"])).otherwise(F.greatest(acc["progress"], more))
        return F.struct(F.coalesce(to, acc["status"]).alias("status"), progress.cast("long").alias("progress"), (acc["reset"] | reset).alias("reset"))

    def from_each(events):
        starts = [F.aggregate(events, F.struct(F.lit(s).alias("status"), F.lit(0).cast("long").alias("progress"), F.lit(False).alias("reset")), step) for s in STATUSES]
        return F.map_from_arrays(F.array(*[F.lit(s) for s in STATUSES]), F.array(*starts))

    def chain(acc, part):
        effect = F.element_at(part["effects"], acc["status"])
        progress = F.when(effect["reset"], effect["progress"]).otherwise(F.greatest(acc["progress"], effect["progress"]))
        return F.struct(effect["status"].alias("status"), progress.alias("progress"), effect["reset"].alias("reset"))

    rows = commands.select("job_id", F.floor(F.col("seq") / chunk).alias("part"), F.struct(F.col("seq").cast("long").alias("seq"), "command", F.col("value").cast("long").alias("value")).alias("e"))
    parts = rows.groupBy("job_id", "part").agg(F.sort_array(F.collect_list("e")).alias("events")).select("job_id", "part", from_each(F.col("events")).alias("effects"))
    # Maps have no order, so the chunks are sorted by their number alone.
    listed = parts.groupBy("job_id").agg(F.collect_list(F.struct("part", "effects")).alias("parts"))
    order = lambda x, y: F.when(x["part"].isNull() | (x["part"] < y["part"]), -1).when(y["part"].isNull() | (x["part"] > y["part"]), 1).otherwise(0)
    done = listed.select("job_id", F.aggregate(F.array_sort("parts", order), unset, chain).alias("s"))
    return done.select("job_id", F.col("s.status").alias("status"), F.col("s.progress").alias("progress"))


def stream_states(commands: DataFrame) -> DataFrame:
    """(job_id, status, progress) in update mode along a stream of commands; those not after a job's last seq, such as replays, do nothing."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        status, progress, last = state.get if state.exists else ("none", 0, -(2**63))
        rows = pd.concat(list(batches)).sort_values("seq", kind="stable")
        for seq, command, value in rows[["seq", "command", "value"]].itertuples(index=False):
            if seq > last:
                status, progress = move(status, progress, command, None if pd.isna(value) else int(value))
                last = int(seq)
        state.update((status, progress, last))
        yield pd.DataFrame({"job_id": [key[0]], "status": [status], "progress": [progress]})

    return commands.groupBy("job_id").applyInPandasWithState(run, "job_id long, status string, progress long", "status string, progress long, last long", "update", "NoTimeout")
