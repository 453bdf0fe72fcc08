"""Structured Streaming over the batch operators: incremental upserts and chat history."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..session import ship
from ..sources.store import Collection, prepare


def stream_upsert(stream: DataFrame, collection: Collection, mode: str, checkpoint: str, embed: Callable[[DataFrame], DataFrame] = lambda d: d) -> StreamingQuery:
    """Each micro-batch becomes one version of any number of files, and writes no more than it changes. A batch that is replayed after a failure counts once: the
    collection keeps the number of the last one, under the checkpoint's path. Of a batch's repeated ids, the caller keeps one."""

    def write(batch: DataFrame, number: int) -> None:
        if not batch.isEmpty():
            collection.write_files(prepare(embed(batch)), mode, (checkpoint, number))

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def running_history(turns: DataFrame, n: int = 6) -> DataFrame:
    """turns(conv_id, turn, role, text) as a stream: after each batch a conversation's last n turns, oldest first. State: n turns a conversation."""
    ship(turns.sparkSession)
    out = "conv_id long, history array<struct<turn:long,role:string,text:string>>"
    state = "turns array<struct<turn:long,role:string,text:string>>"

    def step(key: tuple, batches: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        own = {t["turn"]: dict(t) if isinstance(t, dict) else t.asDict() for t in (held.get[0] if held.exists else [])}
        for b in batches:
            own |= {r.turn: {"turn": r.turn, "role": r.role, "text": r.text} for r in b.itertuples(index=False)}
        last = [own[k] for k in sorted(own)[-n:]] if n else []
        held.update(([(t["turn"], t["role"], t["text"]) for t in last],))
        yield pd.DataFrame({"conv_id": [key[0]], "history": [last]})

    return turns.groupBy("conv_id").applyInPandasWithState(step, out, state, "update", GroupStateTimeout.NoTimeout)
