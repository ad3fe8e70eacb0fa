"""What an adapter carries from line to line, as the state of a stream: for each file its registers, the events that wait for
a release, and the names of calls. A micro-batch brings new lines only; each is worked on once, in the order of its file.

The state of a file is a few texts, HELD events or little more at most, and a name for each call.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..sources.adapters import Adapter
from ..sources.records import CARRIED, HELD

RAW = "file string, seq long, pos int, ts string, session_id string, project string, event_type string, text string, tool_name string, model string, tokens_in long, tokens_out long, extra string"
NAMES = [field.split(" ")[0] for field in RAW.split(", ")]
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Carry(StatefulProcessor):
    """As records.carry, but that a file which never releases its events keeps them."""

    def __init__(self, timed: bool, held: bool):
        self.timed, self.held = timed, held

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.registers = handle.getValueState("registers", "ts string, session_id string, project string, model string, waiting long, open boolean")
        self.pending = handle.getListState("pending", "event string")
        self.calls = handle.getMapState("calls", "id string", "name string")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        ts, session, project, model, waiting, opened = self.registers.get() or (None, None, None, None, 0, not self.held)
        freed, kept = [], []
        for line in sorted(rows, key=lambda r: r.seq):
            ts = line["sets"]["ts"] if line["sets"]["ts"] is not None else ts
            if ts is not None or not self.timed:
                session = line["sets"]["session_id"] if line["sets"]["session_id"] is not None else session
                project = line["sets"]["project"] if line["sets"]["project"] is not None else project
                model = line["sets"]["model"] if line["sets"]["model"] is not None else model
            called = None
            if line["call"]["id"] is not None and ts is not None:
                if line["call"]["name"] is not None:
                    self.calls.updateValue((line["call"]["id"],), (line["call"]["name"],))
                if self.calls.containsKey((line["call"]["id"],)):
                    called = self.calls.getValue((line["call"]["id"],))[0]
            events = line["events"] or []
            own = [line["base"]["session_id"] if session is None else session, line["base"]["project"] if project is None else project]
            out = []
            for pos, e in enumerate(events):
                tool = called if e["tool_name"] == CARRIED else e["tool_name"]
                out.append([key[0], line["seq"], pos, ts, *own, e["event_type"], e["text"], tool, model if e["model"] == CARRIED else e["model"], e["tokens_in"], e["tokens_out"], e["extra"]])
            waiting += len(events) if not opened else 0
            if not opened and (line["release"] or waiting > HELD):
                opened = True
                for event in [json.loads(x[0]) for x in self.pending.get()] + kept + out:
                    event[3] = ts if event[3] is None else event[3]
                    event[4] = own[0]
                    event[5] = own[1] if event[5] is None else event[5]
                    freed.append(event)
                kept = []
                self.pending.clear()
            elif opened:
                freed += out
            else:
                kept += out
        if kept:
            self.pending.appendList([(json.dumps(e),) for e in kept])
        self.registers.update((ts, session, project, model, waiting, opened))
        for event in freed:
            if event[3] is not None:
                yield Row(**dict(zip(NAMES, event, strict=True)))

    def close(self) -> None:
        pass


def carried(lines: DataFrame, adapter: Adapter) -> DataFrame:
    """The raw events of a stream of lines (file, seq, line), released ones only; without state where lines are on their own."""
    if adapter.alone:
        return adapter(lines)
    return adapter.read(lines).groupBy("file").transformWithState(Carry(adapter.timed, adapter.held), RAW, "Append", "None")
