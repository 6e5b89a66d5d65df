"""Labels as a stream of what a person does: append, undo, change one at a position, trim what has no label; and when to train again."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

#: What happens to a label set. seq orders its events; pos is for upsert alone.
EVENTS = "label_set string, seq long, action string, pos int, label int"
#: A set's state after an event: rows, labelled ones, whether a forest is due, and the row that the event changed (null label: it has none, or is gone).
OUTPUT = "label_set string, seq long, rows int, labelled int, retrain boolean, pos int, label int"
_STORE = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class LabelLog(StatefulProcessor):
    """Keeps a label set's rows, a value for each position, and tells what each event leaves.

    ``append`` adds a row (its label may be null: a segment not labelled yet); ``undo`` clears the last label that is there; ``upsert`` puts a label at a position, and rows without labels
    before it where there are none; ``trim`` takes off the rows without labels at the end. Other actions, and positions below zero, change nothing. A forest is due when as many labels as
    ``every`` have been added since the last time, ``every`` at least. Events of a set are taken in order of seq within a batch; one whose seq is not above the last is a repetition, and dropped.
    """

    def __init__(self, every: int = 10):
        self.every = every

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.labels = handle.getMapState("labels", "pos int", "label int")
        self.counts = handle.getValueState("counts", "rows int, labelled int, trained int, seq long")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        n, labelled, trained, last = self.counts.get() if self.counts.exists() else (0, 0, 0, -1)
        for event in sorted((r for r in rows if r.seq is not None), key=lambda r: r.seq):
            if event.seq <= last:
                continue
            last, pos, label = event.seq, None, None
            if event.action == "append":
                pos, label = n, event.label
                n += 1
                labelled += self._put(pos, label)
            elif event.action == "upsert" and event.pos is not None and event.pos >= 0:
                pos, label = event.pos, event.label
                for empty in range(n, pos):
                    self._put(empty, None)
                n = max(n, pos + 1)
                labelled += self._put(pos, label)
            elif event.action == "undo":
                pos = next((p for p in range(n - 1, -1, -1) if self._at(p) is not None), None)
                if pos is not None:
                    labelled += self._put(pos, None)
            elif event.action == "trim":
                while n and self._at(n - 1) is None:
                    n -= 1
                    self.labels.removeKey((n,))
            due = labelled - trained >= self.every
            if due:
                trained = labelled
            trained = min(trained, labelled)
            yield Row(label_set=key[0], seq=event.seq, rows=n, labelled=labelled, retrain=due, pos=pos, label=label)
        self.counts.update((n, labelled, trained, last))

    def _at(self, pos: int) -> int | None:
        return self.labels.getValue((pos,))[0] if self.labels.containsKey((pos,)) else None

    def _put(self, pos: int, label: int | None) -> int:
        """The change in the number of labels."""
        before = self._at(pos)
        self.labels.updateValue((pos,), (label,))
        return (label is not None) - (before is not None)

    def close(self) -> None:
        pass


def label_states(events: DataFrame, every: int = 10) -> DataFrame:
    """What each event (``EVENTS``, a stream) leaves of its label set (``OUTPUT``). State is kept by label set, a key for each position, so sets are spread over tasks and only what an event touches is read."""
    events.sparkSession.conf.set(_STORE, _ROCKS)  # this kind of state is kept nowhere else
    rows = events.where(F.col("label_set").isNotNull()).select("label_set", "seq", "action", "pos", "label")
    return rows.groupBy("label_set").transformWithState(LabelLog(every), OUTPUT, "Append", "None")


def labels_now(states: DataFrame) -> DataFrame:
    """(label_set, pos, label) from the states written so far: each position's last, without those that a later trim has taken off."""
    last = states.groupBy("label_set").agg(F.max_by("rows", "seq").alias("_rows"))
    placed = states.where(F.col("pos").isNotNull()).groupBy("label_set", "pos").agg(F.max_by("label", "seq").alias("label"))
    return placed.join(last, "label_set").where((F.col("pos") < F.col("_rows")) & F.col("label").isNotNull()).drop("_rows")
