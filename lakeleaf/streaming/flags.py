"""The live flags of feedback as the state of a stream: what events say of a document or an edge, while they stand.

The state is keyed by target and holds the last word of each event about it, so an event that is deleted is taken back
without the log being read again. Only targets that a batch names are worked on and written.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from lakeleaf.operators.feedback import KINDS

#: Columns of the stream: events as in ``feedback``, and whether the row deletes its event. Of an event's rows that with the
#: largest seq counts, in whatever order they come.
EVENTS = "id string, target_kind string, target_id string, feedback_kind string, seq long, deleted boolean"
FLAGS = "target_kind string, target_id string, canonical boolean, stale boolean, wrong boolean"
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Flags(StatefulProcessor):
    """Folds events into their target's state and gives its flags."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.events = handle.getMapState("events", "id string", "feedback_kind string, seq long, deleted boolean")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        for part in rows:
            for e in part.itertuples():
                had = self.events.getValue((e.id,))
                if had is None or e.seq >= had[1]:
                    self.events.updateValue((e.id,), (e.feedback_kind, int(e.seq), bool(e.deleted)))
        said = {value[0] for _, value in self.events.iterator() if not value[2]}
        kind, target = key
        has = lambda name: name in said and KINDS[name] == kind
        yield pd.DataFrame({"target_kind": [kind], "target_id": [target], "canonical": [has("document_canonical")], "stale": [has("document_stale")], "wrong": [has("relationship_wrong")]})

    def close(self) -> None:
        pass


def flags(events: DataFrame) -> DataFrame:
    """A stream of EVENTS as a stream of FLAGS: a row for each target that a batch names. Rows without an id, a target or a
    seq are left out."""
    events.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)  # state of many keys needs it
    whole = events.filter("id is not null and target_kind is not null and target_id is not null and seq is not null").withColumn("deleted", F.coalesce("deleted", F.lit(False)))
    return whole.groupBy("target_kind", "target_id").transformWithStateInPandas(Flags(), FLAGS, "update", "none")


def follow_flags(events: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """Write the flags of each batch to ``folder``, under the batch's number: a batch that is run again replaces its own."""

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/batch={number}")

    return flags(events).writeStream.foreachBatch(put).outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def live_flags(rows: DataFrame) -> DataFrame:
    """The last flags of each target; rows: of ``follow_flags``' folder, with batch."""
    names = ("canonical", "stale", "wrong")
    last = rows.groupBy("target_kind", "target_id").agg(F.max_by(F.struct(*names), "batch").alias("f"))
    return last.select("target_kind", "target_id", *[F.col(f"f.{n}").alias(n) for n in names])
