"""Running totals of a thread, kept by the stream: the count of messages per complaint is state, so
a message gets its total when it arrives and the log is not read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

_COUNT = T.StructType([T.StructField("n", T.LongType())])
_TOTAL = T.StructField("total_messages", T.LongType())


class RunningTotal(StatefulProcessor):
    """Rows of a key leave with the number of rows before them in `first` and themselves."""

    def __init__(self, seq: str, first: int):
        self.seq, self.first = seq, first

    def init(self, handle) -> None:
        self.count = handle.getValueState("count", _COUNT)

    def handleInitialState(self, key, initialState, timerValues) -> None:
        self.count.update((int(initialState.n),))

    def handleInputRows(self, key, rows, timerValues):
        n = int(self.count.get()[0]) if self.count.exists() else 0
        for row in sorted(rows, key=lambda r: getattr(r, self.seq)):
            n += 1
            yield Row(**row.asDict(), total_messages=n + self.first)
        self.count.update((n,))

    def close(self) -> None:
        pass


def numbered_live(messages: DataFrame, stored: DataFrame | None = None,
                  key: str = "complaint_id", seq: str = "seq") -> DataFrame:
    """Messages of a stream with `total_messages`: those stored before the stream began
    (`stored`, a batch table), those that came with earlier micro-batches, those before it in its
    own micro-batch by `seq`, itself, and one for the original complaint. Messages without a key
    or number are left out. The state is one number per key."""
    rows = messages.where(F.col(key).isNotNull() & F.col(seq).isNotNull())
    counts = None
    if stored is not None:
        counts = stored.where(F.col(key).isNotNull()).groupBy(key).agg(
            F.count(F.lit(1)).alias("n")).groupBy(key)
    return rows.groupBy(key).transformWithState(
        statefulProcessor=RunningTotal(seq, 1),
        outputStructType=T.StructType([*rows.schema.fields, _TOTAL]),
        outputMode="Append", timeMode="None", initialState=counts)
