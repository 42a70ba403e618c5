"""A store's commands over HTTP, over MCP on standard input and output, and in the shell.

All three go through COMMANDS: name, the method's parameters with their types.
"""

from __future__ import annotations

import argparse
import json
import os
import sys
import threading
from dataclasses import dataclass, fields
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from typing import IO

from pyspark.sql import SparkSession

from .store import Store, Unknown

COMMANDS: dict[str, dict[str, type]] = {
    "remember": {"items": list, "policy": str, "idempotent": bool},
    "recall": {"queries": list, "k": int, "mode": str, "min_trust": str, "tag": str, "valid_at": float, "touch": bool},
    "get": {"id_": str},
    "resolve": {"prefix": str},
    "recent": {"limit": int, "before": float},
    "edit": {"id_": str, "text": str, "type": str, "tags": list, "importance": float, "polarity": int, "expires_at": float, "source": str, "clear_source": bool,
             "pinned": bool, "trust": str, "valid_from": float, "valid_until": float},
    "forget": {"id_": str},
    "trash": {"id_": str},
    "untrash": {"id_": str},
    "supersede": {"old": str, "new": str},
    "restore": {"id_": str},
    "link": {"src": str, "dst": str, "rel": str},
    "unlink": {"src": str, "dst": str, "rel": str},
    "merge": {"target": str, "other": str},
    "neighbors": {"id_": str, "depth": int, "direction": str},
    "path_between": {"start": str, "end": str},
    "conflicts": {"threshold": float},
    "history": {"id_": str},
    "journal": {"limit": int, "op": str, "actor": str, "since": float, "until": float},
    "stats": {},
    "readiness": {},
    "tick": {},
    "export": {"path": str},
    "backup": {"path": str},
    "render": {"form": str},
}
#: Bytes of a request that are read at most.
MOST = 4 << 20


class BadRequest(ValueError):
    """A command or parameter that doesn't fit."""


@dataclass(frozen=True)
class Config:
    """Settings by name; the environment (MNEMORA_PATH, ...) goes before a JSON file."""

    path: str = "memories"
    collection: str = "main"
    actor: str = ""
    token: str = ""
    port: int = 8765
    every: float = 300.0

    @classmethod
    def load(cls, file: str | None = None, env=os.environ) -> Config:
        given = {}
        if file and os.path.exists(file):
            with open(file, encoding="utf-8") as f:
                given = json.load(f)
        kinds = {f.name: type(f.default) for f in fields(cls)}
        if unknown := set(given) - set(kinds):
            raise BadRequest(f"unknown settings: {', '.join(sorted(unknown))}")
        given |= {n: env[f"MNEMORA_{n.upper()}"] for n in kinds if f"MNEMORA_{n.upper()}" in env}
        return cls(**{n: coerced(n, v, kinds[n]) for n, v in given.items()})


def coerced(name: str, value, kind: type):
    """The value as its type; strings stand for numbers and booleans, nothing else does."""
    if value is None or type(value) is kind:
        return value
    if kind is float and type(value) is int:
        return float(value)
    try:
        if isinstance(value, str):
            if kind is bool:
                return {"true": True, "false": False}[value.lower()]
            if kind is list:
                found = json.loads(value) if value[:1] == "[" else [value]
                return found
            return kind(value)
    except (ValueError, KeyError):
        pass
    raise BadRequest(f"{name} must be of type {kind.__name__}")


def run(store: Store, name: str, given: dict):
    """Runs a command; id stands for id_."""
    if name not in COMMANDS:
        raise Unknown(name)
    kinds = COMMANDS[name]
    given = {("id_" if k == "id" else k): v for k, v in given.items()}
    if unknown := set(given) - set(kinds):
        raise BadRequest(f"unknown parameters: {', '.join(sorted(unknown))}")
    try:
        return getattr(store, name)(**{k: coerced(k, v, kinds[k]) for k, v in given.items() if v is not None})
    except TypeError as e:
        raise BadRequest(str(e)) from e


def http_server(store: Store, port: int = 0, token: str = "") -> ThreadingHTTPServer:
    """POST /<command> with a JSON object of parameters; 400, 401, 404 and 500 as usual."""

    class Handler(BaseHTTPRequestHandler):
        def reply(self, status: int, body) -> None:
            data = json.dumps(body).encode()
            self.send_response(status)
            self.send_header("Content-Type", "application/json")
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()
            self.wfile.write(data)

        def do_POST(self):
            if token and self.headers.get("Authorization") != f"Bearer {token}":
                return self.reply(401, {"error": "not authorised"})
            try:
                size = int(self.headers.get("Content-Length") or 0)
                if size > MOST:
                    raise BadRequest("the request is too long")
                given = json.loads(self.rfile.read(size) or b"{}")
                if not isinstance(given, dict):
                    raise BadRequest("parameters must be an object")
                self.reply(200, {"result": run(store, self.path.strip("/"), given)})
            except Unknown as e:
                self.reply(404, {"error": f"not found: {e.args[0]}"})
            except ValueError as e:  # bad JSON and bad requests among them
                self.reply(400, {"error": str(e)})
            except Exception as e:  # noqa: BLE001 - a failing command must not end the server
                self.reply(500, {"error": f"{type(e).__name__}: {e}"[:500]})

        def log_message(self, *args):
            pass

    return ThreadingHTTPServer(("127.0.0.1", port), Handler)


JSON_TYPES = {str: "string", int: "integer", float: "number", bool: "boolean", list: "array"}


def mcp(store: Store, lines: IO[str], out: IO[str]) -> None:
    """JSON-RPC by lines: initialize, tools/list, tools/call; notifications get no reply."""
    for line in lines:
        if not line.strip():
            continue
        id_ = None
        try:
            ask = json.loads(line)
            if not isinstance(ask, dict) or not isinstance(ask.get("params") or {}, dict):
                out.write(json.dumps({"jsonrpc": "2.0", "id": None, "error": {"code": -32600, "message": "a request is an object, and so are its params"}}) + "\n")
                out.flush()
                continue
            id_, method, params = ask.get("id"), ask.get("method"), ask.get("params") or {}
            if id_ is None:
                continue
            if method == "initialize":
                result = {"protocolVersion": params.get("protocolVersion", "2024-11-05"), "capabilities": {"tools": {}}, "serverInfo": {"name": "mnemora", "version": "1"}}
            elif method == "tools/list":
                shape = lambda kinds: {"type": "object", "properties": {k: {"type": JSON_TYPES[t]} for k, t in kinds.items()}}
                result = {"tools": [{"name": n, "description": (getattr(Store, n).__doc__ or n).strip(), "inputSchema": shape(kinds)} for n, kinds in COMMANDS.items()]}
            elif method == "tools/call":
                try:
                    text, failed = json.dumps(run(store, params.get("name", ""), params.get("arguments") or {})), False
                except (Unknown, ValueError) as e:
                    text, failed = str(e), True
                result = {"content": [{"type": "text", "text": text}], "isError": failed}
            else:
                reply = {"jsonrpc": "2.0", "id": id_, "error": {"code": -32601, "message": f"unknown method {method}"}}
                out.write(json.dumps(reply) + "\n")
                continue
            reply = {"jsonrpc": "2.0", "id": id_, "result": result}
        except json.JSONDecodeError as e:
            reply = {"jsonrpc": "2.0", "id": id_, "error": {"code": -32700, "message": str(e)}}
        except Exception as e:  # noqa: BLE001 - a failing command must not end the loop
            reply = {"jsonrpc": "2.0", "id": id_, "error": {"code": -32603, "message": f"{type(e).__name__}: {e}"[:500]}}
        out.write(json.dumps(reply) + "\n")
        out.flush()


def loop(store: Store, every: float, stop: threading.Event) -> None:
    """Upkeep again and again until told to stop; a failing round doesn't end it."""
    while not stop.is_set():
        try:
            store.tick()
        except Exception as e:  # noqa: BLE001
            print(f"upkeep failed: {e}", file=sys.stderr)
        stop.wait(every)


def resolve_conflicts(store: Store, ask, threshold: float = 0.8) -> int:
    """Asks of each clash which row stays (a, b or neither); rows that have gone already
    aren't asked about. The number of rows superseded."""
    gone: set[str] = set()
    for c in store.conflicts(threshold):
        if {c["a"], c["b"]} & gone:
            continue
        keep = ask(c)
        if keep in ("a", "b"):
            old, new = (c["b"], c["a"]) if keep == "a" else (c["a"], c["b"])
            store.supersede(old, new)
            gone.add(old)
    return len(gone)


def main(argv: list[str] | None = None, spark: SparkSession | None = None, out: IO[str] = sys.stdout) -> int:
    """mnemora <command> --parameter value ..., or serve, mcp, daemon."""
    top = argparse.ArgumentParser(prog="mnemora")
    top.add_argument("--config", default="mnemora.json")
    sub = top.add_subparsers(dest="command", required=True)
    for name, kinds in COMMANDS.items():
        one = sub.add_parser(name)
        for k in kinds:
            one.add_argument(f"--{k.rstrip('_')}")
    for name in ("serve", "mcp", "daemon"):
        sub.add_parser(name)
    args = vars(top.parse_args(argv))
    config = Config.load(args.pop("config"))
    spark = spark or SparkSession.builder.appName("mnemora").getOrCreate()
    store, name = Store(spark, config.path, config.collection, actor=config.actor), args.pop("command")
    if name == "serve":
        http_server(store, config.port, config.token).serve_forever()
    elif name == "mcp":
        mcp(store, sys.stdin, out)
    elif name == "daemon":
        loop(store, config.every, threading.Event())
    else:
        try:
            print(json.dumps(run(store, name, {k: v for k, v in args.items() if v is not None}), indent=2), file=out)
        except (Unknown, ValueError) as e:
            print(f"error: {e}", file=sys.stderr)
            return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
