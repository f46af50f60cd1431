"""What a Python worker holds and asks for: parts of batches, and calls of the state's handle."""

import pyarrow as pa
from pyspark.sql import Row
from pyspark.util import PythonEvalType

from lexspark.operators import chunking
from lexspark.sources import pages
from lexspark.streaming import state


def test_texts_are_objects_a_part_at_a_time():
    assert pages.html_to_markdown.evalType == PythonEvalType.SQL_SCALAR_ARROW_UDF
    texts = [None, "", *map(str, range(3 * chunking.PART))]
    found = chunking.in_parts(pa.array(texts, pa.string()), lambda x: x and x + "!", pa.string())
    assert found.to_pylist() == [x and x + "!" for x in texts]
    assert chunking.in_parts(pa.array([], pa.string()), str, pa.string()).to_pylist() == []


class Handle:
    def __init__(self):
        self.calls, self.held, self.timers = [], None, []

    def getValueState(self, name, schema):
        return self

    def get(self):
        return self.held

    def exists(self):
        return self.held is not None

    def update(self, value):
        self.calls.append("update")
        self.held = value

    def listTimers(self):
        self.calls.append("list")
        return iter(list(self.timers))

    def deleteTimer(self, at):
        self.timers.remove(at)

    def registerTimer(self, at):
        self.timers.append(at)


def test_a_new_label_has_no_timers_to_look_for():
    life, handle = state._Life({"ephemeral": 1.0}), Handle()
    life.init(handle)
    put = lambda kind, at: list(life.handleInputRows(("a",), iter([Row(label="a", kind=kind, micros=at)]), None))
    put("ephemeral", 1_000)
    assert handle.calls == ["update"] and handle.timers == [3_600_002]
    put("ephemeral", 500)
    assert handle.calls == ["update"], "an earlier row changes nothing"
    put("ephemeral", 5_000)
    assert handle.timers == [3_600_006]
    put("durable", 6_000)
    assert handle.timers == []
