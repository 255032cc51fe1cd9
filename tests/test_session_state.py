"""The session processor over a counted stand-in for the state store."""

import json
from collections import Counter

import pandas as pd

from provlake.streaming import session as S


class Store:
    """A value or a map of one session; every access is counted."""

    def __init__(self, calls):
        self.calls, self.rows, self.value = calls, {}, None

    def exists(self):
        self.calls["exists"] += 1
        return self.value is not None

    def get(self):
        self.calls["get"] += 1
        return self.value

    def update(self, value):
        self.calls["update"] += 1
        self.value = value

    def containsKey(self, key):  # noqa: N802 - the state store's names
        self.calls["containsKey"] += 1
        return key in self.rows

    def getValue(self, key):  # noqa: N802
        self.calls["getValue"] += 1
        return self.rows[key]

    def updateValue(self, key, value):  # noqa: N802
        self.calls["updateValue"] += 1
        self.rows[key] = value

    def keys(self):
        self.calls["keys"] += 1
        return iter(list(self.rows))

    def iterator(self):
        self.calls["iterator"] += 1
        return iter(list(self.rows.items()))


class Handle:
    def __init__(self):
        self.calls, self.states = Counter(), {}

    def getValueState(self, name, *_):  # noqa: N802
        return self.states.setdefault(name, Store(self.calls))

    getMapState = getValueState  # noqa: N815


def result(seq, write, artifact):
    return {"session_id": "s", "seq": seq, "kind": "result", "tool": "Write" if write else "Read", "is_write": write,
            "action_id": f"a{seq % 7}", "success": True, "result_bytes": 1, "refs": [{
                "artifact_id": artifact, "path": f"/{artifact}", "digest": None,
                "labels": ["public"] if write else ["confidential", "pii"]}]}


def rows(n):
    return [result(i, i % 3 == 2, "out" if i % 3 == 2 else f"in{i % 20}") for i in range(n)] + [
        {"session_id": "s", "seq": n, "kind": "checkpoint"}, {"session_id": "s", "seq": n + 1, "kind": "stop"}]


def run(handle, events):
    p = S.SessionProcessor()
    p.init(handle)
    frame = pd.DataFrame(events, columns=S.INPUT)
    out = pd.concat(list(p.handleInputRows(("s",), iter([frame]), None)))
    return json.loads(out.to_json(orient="records"))


def test_state_is_reached_once_an_entry_not_once_a_row():
    handle = Handle()
    out = run(handle, rows(600))
    assert sum(r["row_kind"] == "edge" for r in out) > 3000
    # 20 sources and the output, edges, seven actions, one head; nothing to fetch for a new session.
    assert sum(handle.calls.values()) < 100


def test_batches_leave_what_one_batch_leaves():
    whole, parts = Handle(), Handle()
    events = rows(90)
    one = run(whole, events)
    many = [r for i in range(0, len(events), 11) for r in run(parts, events[i:i + 11])]
    assert many == one

    def kept(handle):
        return {n: {k: sorted(json.loads(v[0])) if n == "edges" else v for k, v in s.rows.items()} or json.loads(s.value[0])
                for n, s in handle.states.items()}

    assert kept(parts) == kept(whole)


def test_long_sessions_leave_in_frames(monkeypatch):
    whole = run(Handle(), rows(90))
    monkeypatch.setattr(S, "FRAME", 7)
    assert run(Handle(), rows(90)) == whole
