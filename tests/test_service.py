import io
import json
import threading
import urllib.error
import urllib.request

import pytest

from mnemora.service import surfaces
from mnemora.service.store import Store, Unknown


@pytest.fixture
def store(spark, tmp_path):
    now = [1_700_000_000.0]

    def clock():
        now[0] += 1
        return now[0]

    return Store(spark, str(tmp_path / "store"), actor="tester", clock=clock)


def test_a_life(store, tmp_path):
    """Rows are stored, found, changed, linked, merged, trashed and logged."""
    a, b, c = store.remember([{"text": " use ruff ", "tags": ["lint"], "importance": 2}, {"text": "deploy on fridays"}, {"text": "never deploy on fridays", "type": "feedback"}])
    assert store.get(a)["text"] == "use ruff" and store.get(a)["importance"] == 1.0
    assert store.remember([{"text": "USE  ruff"}, {"text": "new"}, {"text": "New"}], idempotent=True)[0] == a
    (hit,) = store.recall(["use ruff"], k=1, mode="semantic")
    assert hit["id"] == a and hit["rank"] == 1 and store.get(a)["access_count"] == 2
    assert [h["query"] for h in store.recall(["deploy", "ruff"], k=1, touch=False)] == ["deploy", "ruff"]
    assert store.edit(a, text="use black", importance=0.3)["text"] == "use black"
    store.link(a, b, "refines")
    store.link(b, c)
    assert [(n["id"], n["rel"]) for n in store.neighbors(a)] == [(b, "refines")]
    assert store.path_between(a, c) == [(a, ""), (b, "refines"), (c, "related")]
    store.unlink(b, c)
    assert store.render("text") == f"{a} -refines-> {b}" and store.render().startswith("digraph")
    assert store.merge(b, c)["text"] == "deploy on fridays\n\nnever deploy on fridays"
    store.supersede(a, b)
    assert store.get(a)["superseded_by"] == b and a not in {r["id"] for r in store.recent()}
    store.restore(a)
    store.trash(a)
    with pytest.raises(Unknown):
        store.get(a)
    store.untrash(a)
    store.forget(a)
    assert store.stats()["total"] == 2
    ops = [e["op"] for e in store.journal(50)]
    assert ops[:3] == ["forget", "restore", "forget"] and "merged_from" in store.journal(50, op="edit")[0]["meta"]
    assert {e["op"] for e in store.history(b)} >= {"remember", "link", "supersede"}
    assert store.export(str(tmp_path / "x.gz")) == 2 and store.readiness()["ready"]
    store.backup(str(tmp_path / "copy"))
    assert Store(store.spark, str(tmp_path / "copy")).stats() == store.stats()
    assert store.tick()["ran"].keys() == {"decay", "purge", "trash"} and store.tick()["ran"] == {}


def test_nothing_is_lost_while_recalls_run(store, monkeypatch):
    """A row that is stored while a recall is under way stays, and so do both's touches;
    deltas are merged in time and old folders go."""
    from mnemora.operators import recall as R
    from mnemora.operators import touches

    (a,) = store.remember([{"text": "first"}])
    top, stored = R.top, []

    def late(rows, k):
        if not stored:
            stored.extend(store.remember([{"text": "second"}]))
            store.recall(["first"], k=1)
        return top(rows, k)

    monkeypatch.setattr(R, "top", late)
    assert [h["id"] for h in store.recall(["first"], k=1)] == [a]
    assert store.stats()["total"] == 2 and store.get(a)["access_count"] == 2
    monkeypatch.setattr(touches, "DELTAS", 2)
    for i in range(4):
        store.recall(["first"], k=1)
        assert store.get(a)["access_count"] == 3 + i
    from mnemora.service import store as S

    monkeypatch.setattr(S, "KEEP", 2)
    before = store._manifests()
    store.edit(a, pinned=True, tags=["x"], valid_until=5.0)
    assert len(store._manifests()) == 2 < len(before) and store.get(a)["pinned"] and store.get(a)["tags"] == ["x"] and store.get(a)["access_count"] == 6
    assert store.recall(["first"], k=2)[0]["id"] == stored[0]  # what has lapsed isn't returned
    assert a in [h["id"] for h in store.recall(["first"], k=2, valid_at=3.0)]
    with pytest.raises(ValueError, match="bad trust"):
        store.edit(a, trust="odd")
    with pytest.raises(ValueError, match="unknown fields"):
        store.edit(a, colour="red")


def test_what_is_refused(store):
    (a,) = store.remember([{"text": "x"}])
    for bad in ([{"text": " "}], [{"text": "y", "colour": 1}], [{"text": "y", "type": "odd"}], [{"text": "y", "tags": ["a,b"]}]):
        with pytest.raises(ValueError):
            store.remember(bad)
    with pytest.raises(ValueError, match="clash"):
        store.remember([{"text": "x"}], policy="raise")
    with pytest.raises(ValueError):
        store.link(a, a)
    with pytest.raises(Unknown):
        store.link(a, "nobody")
    with pytest.raises(ValueError):
        store.recall(["x"], mode="fts")
    assert store.recall(["x"], k=0) == [] and store.stats()["total"] == 1 and store.resolve(a[:6]) == a


def test_http(store):
    server = surfaces.http_server(store, token="secret")
    threading.Thread(target=server.serve_forever, daemon=True).start()

    def call(name, body, token="secret"):
        data = body if isinstance(body, bytes) else json.dumps(body).encode()
        request = urllib.request.Request(f"http://127.0.0.1:{server.server_port}/{name}", data, {"Authorization": f"Bearer {token}"})
        try:
            with urllib.request.urlopen(request) as reply:
                return reply.status, json.load(reply)["result"]
        except urllib.error.HTTPError as e:
            return e.code, json.load(e)["error"]

    status, (a,) = call("remember", {"items": [{"text": "hello"}]})
    assert status == 200 and call("get", {"id": a})[1]["text"] == "hello"
    assert call("recent", {"limit": "1"})[1][0]["id"] == a
    for name, body, code in (("get", {"id": "nobody"}, 404), ("nothing", {}, 404), ("get", {"id": a, "x": 1}, 400), ("recent", {"limit": "many"}, 400), ("get", {}, 400), ("get", b"{", 400), ("get", [1], 400), ("recent", {"limit": -1}, 400)):
        assert call(name, body)[0] == code, (name, body)
    assert call("stats", {}, "wrong")[0] == 401
    server.shutdown()


def test_mcp_and_shell(store, tmp_path, monkeypatch):
    ask = lambda id_, method, **params: json.dumps({"jsonrpc": "2.0", "id": id_, "method": method, "params": params})
    lines = [ask(1, "initialize"), json.dumps({"method": "notifications/initialized"}), ask(2, "tools/list"), ask(3, "tools/call", name="remember", arguments={"items": [{"text": "t"}]}), ask(4, "tools/call", name="get", arguments={"id": "no"}), ask(5, "other"), "{", "", "[1, 2]", ask(6, "tools/call", name=["odd"]), ask(7, "initialize")]
    out = io.StringIO()
    surfaces.mcp(store, lines, out)
    got = [json.loads(x) for x in out.getvalue().splitlines()]
    assert [g.get("id") for g in got] == [1, 2, 3, 4, 5, None, None, 6, 7]
    assert got[6]["error"]["code"] == -32600 and got[7]["error"]["code"] == -32603 and "result" in got[8]
    assert {t["name"] for t in got[1]["result"]["tools"]} == set(surfaces.COMMANDS)
    assert not got[2]["result"]["isError"] and got[3]["result"]["isError"] and got[4]["error"]["code"] == -32601 and got[5]["error"]["code"] == -32700
    monkeypatch.setenv("MNEMORA_PATH", store.path)
    out = io.StringIO()
    assert surfaces.main(["--config", str(tmp_path / "none"), "stats"], store.spark, out) == 0 and json.loads(out.getvalue())["total"] == 1
    assert surfaces.main(["--config", str(tmp_path / "none"), "get", "--id", "nobody"], store.spark, io.StringIO()) == 1
    (tmp_path / "c.json").write_text('{"port": 9, "token": "t"}')
    config = surfaces.Config.load(str(tmp_path / "c.json"), {"MNEMORA_PORT": "10"})
    assert (config.port, config.token) == (10, "t")
    (tmp_path / "c.json").write_text('{"colour": 9}')
    with pytest.raises(ValueError):
        surfaces.Config.load(str(tmp_path / "c.json"), {})


def test_clashes_are_settled_one_by_one(store):
    store.remember([{"text": "same", "tags": ["t"]}, {"text": "same", "tags": ["t"]}, {"text": "same", "tags": ["t"]}, {"text": "other"}])
    assert len(store.conflicts()) == 3
    assert surfaces.resolve_conflicts(store, lambda c: "a") == 2 and store.conflicts() == []
