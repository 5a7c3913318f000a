"""A path's rows reach its state as rows, one call to read the state and one to write it."""

from types import SimpleNamespace

from pyspark.sql import Row

from lodestone.streaming.versions import Versions


def test_rows_of_a_path():
    calls, state = [], SimpleNamespace(value=None)
    state.get = lambda: calls.append("get") or state.value
    state.update = lambda v: calls.append("update") or setattr(state, "value", v)
    one = Versions()
    one.init(SimpleNamespace(getValueState=lambda *_: state))
    row = Row("source_id", "path", "text", "modified_us", "content_hash")
    said = lambda *rows: [tuple(r) for r in one.handleInputRows(("s", "a"), iter(rows), None)]
    assert said(row("s", "a", "x", 1, "h1"), row("s", "a", "y", 2, "h2")) == [("s", "a", "new", 1, "h2", "y")]
    assert calls == ["get", "update"]
    assert said(row("s", "a", "x", 1, "h1")) == [] and said(row("s", "a", "y", 3, "h2")) == []
    assert said(row("s", "a", "z", 3, "h3")) == [("s", "a", "changed", 2, "h3", "z")] and state.value == ("h3", 3, 2)
