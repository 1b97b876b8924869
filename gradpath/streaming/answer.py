"""Whole answers to requests as they arrive, and conversation context as messages arrive."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from gradpath.operators.reports import HISTORY_RUNS
from gradpath.plans.answers import Engine, answer_all

HISTORY = "array<struct<turn:bigint,role:string,text:string>>"


def write_answers(engine: Engine, out: str, attribution=None) -> Callable[[DataFrame, int], None]:
    """What a micro-batch is written by: ``out/answers`` and ``out/rejected``, one folder a batch.

    All of a request (class, role, gap, factors, scenarios) is worked out once for both. A
    batch replaces the folders of its own number, so one that is replayed after a failure,
    even between the two, adds no rows.
    """

    def run(batch: DataFrame, number: int) -> None:
        done = answer_all(engine, batch, attribution).persist()
        try:
            good = F.size("violations") == 0
            done.filter(good).drop("violations").write.mode("overwrite").parquet(f"{out}/answers/batch={number}")
            done.filter(~good).select("id", "violations").write.mode("overwrite").parquet(f"{out}/rejected/batch={number}")
        finally:
            done.unpersist()

    return run


def start_answers(engine: Engine, requests: DataFrame, out: str, checkpoint: str, attribution=None, continuous: bool = False) -> StreamingQuery:
    """Answer a stream of requests (with skills and desired role inside) into two sinks, reading it
    once; takes what is there and stops, unless ``continuous``."""
    writer = requests.writeStream.foreachBatch(write_answers(engine, out, attribution)).option("checkpointLocation", checkpoint)
    return (writer if continuous else writer.trigger(availableNow=True)).start()


def conversation_context(messages: DataFrame, runs: int = HISTORY_RUNS, idle: str | None = None) -> DataFrame:
    """(conv_id, turn, run, history) of a stream of messages: ``reports.chat_history`` as they arrive.

    The state of a conversation is the messages of its current and last ``runs`` runs. With
    ``idle`` ("1 day") it is let go when nothing has come for that long; such a query goes on
    checking for idle conversations, so it is for continuous use and doesn't end by itself
    when all that is there has been taken. The turns of a conversation
    have to arrive in order, in any number of batches. A message without a conversation or a
    turn has no run and no history.
    """
    wait = None if idle is None else int(pd.Timedelta(idle).total_seconds() * 1000)
    timeout = GroupStateTimeout.NoTimeout if wait is None else GroupStateTimeout.ProcessingTimeTimeout

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        said = json.loads(state.get[0]) if state.exists else [[0, []]]  # [[run, messages], ...], the current run last
        rows = pd.concat(list(batches)).sort_values("turn", kind="stable")
        out = []
        for turn, role, text in zip(rows["turn"], rows["role"], rows["text"]):
            if role == "user":
                said = [*said, [said[-1][0] + 1, []]][-runs - 1 :]
            run = said[-1][0]
            history = [m for r, messages in said[:-1] for m in messages if r >= run - runs]
            out.append((key[0], int(turn), run, json.dumps(history)))
            said[-1][1].append({"turn": int(turn), "role": role, "text": text})
        state.update((json.dumps(said),))
        if wait is not None:
            state.setTimeoutDuration(wait)
        yield pd.DataFrame(out, columns=["conv_id", "turn", "run", "history"])

    placed = F.col("conv_id").isNotNull() & F.col("turn").isNotNull()
    typed = messages.select(F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"), "role", "text")
    kept = typed.filter(placed).groupBy("conv_id").applyInPandasWithState(
        step, "conv_id bigint, turn bigint, run bigint, history string", "said string", "append", timeout)
    met = kept.withColumn("history", F.from_json("history", HISTORY))
    loose = typed.filter(~placed).select("conv_id", "turn", F.lit(None).cast("bigint").alias("run"), F.array().cast(HISTORY).alias("history"))
    return met.unionByName(loose)
