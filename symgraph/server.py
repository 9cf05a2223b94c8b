"""The queries as a JSON-RPC 2.0 tool server over lines, holding one session."""

from __future__ import annotations

import json
import sys
from typing import IO

from symgraph.render import Reader, open_reader

#: Protocol versions that are spoken, the newest first, and error codes.
VERSIONS = ("2025-06-18", "2025-03-26", "2024-11-05")
NO_BATCHES = "2025-06-18"
PARSE, INVALID, UNKNOWN, PARAMS = -32700, -32600, -32601, -32602

_TEXT, _COUNT, _FLAG = {"type": "string"}, {"type": "integer", "minimum": 1}, {"type": "boolean"}
TOOLS = {
    "find_code": ("Best definitions for a question.", {"question": _TEXT, "limit": _COUNT, "source": _FLAG, "full": _FLAG, "in": _TEXT}, ["question"], lambda r, a: r.ask(a["question"], a.get("limit", 5), a.get("source", True), a.get("full", False), a.get("in"))),
    "find_all": ("All lines that match a pattern, by definition.", {"pattern": _TEXT, "literal": _FLAG, "ignore_case": _FLAG, "scope": _TEXT}, ["pattern"], lambda r, a: r.grep(a["pattern"], a.get("literal", False), a.get("ignore_case", False), a.get("scope"))),
    "trace_calls": ("What calls a symbol, or what it calls.", {"symbol": _TEXT, "direction": _TEXT, "depth": {}}, ["symbol"], lambda r, a: r.callers(a["symbol"], a.get("direction", "in"), a.get("depth", 1))),
    "file_outline": ("The definitions of a file.", {"path": _TEXT}, ["path"], lambda r, a: r.skeleton(a["path"])),
    "map": ("Totals, folders and the most referenced symbols.", {}, [], lambda r, a: r.map()),
    "freshness": ("Whether the graph is that of the tree.", {}, [], lambda r, a: r.check()),
}


class Fault(Exception):
    def __init__(self, code: int, message: str):
        super().__init__(message)
        self.code = code


def _answer(reader: Reader, method: str, params: dict):
    if method == "initialize":
        asked = params.get("protocolVersion")
        return {"protocolVersion": asked if asked in VERSIONS else VERSIONS[0], "capabilities": {"tools": {}}, "serverInfo": {"name": "symgraph", "version": "0.1.0"}}
    if method == "ping":
        return {}
    if method == "tools/list":
        return {"tools": [{"name": n, "description": d, "inputSchema": {"type": "object", "properties": p, "required": need}} for n, (d, p, need, _) in TOOLS.items()]}
    if method != "tools/call":
        raise Fault(UNKNOWN, f"no method {method}")
    tool = TOOLS.get(params.get("name", ""))
    given = params.get("arguments") or {}
    if tool is None or not isinstance(given, dict):
        raise Fault(PARAMS, "no such tool" if tool is None else "arguments are an object")
    missing = [n for n in tool[2] if n not in given]
    try:
        if missing:
            raise ValueError(f"missing: {', '.join(missing)}")
        return {"content": [{"type": "text", "text": tool[3](reader, {k: v for k, v in given.items() if k in tool[1]})}], "isError": False}
    except Exception as e:  # whatever a tool raises is its answer; the session goes on
        return {"content": [{"type": "text", "text": str(e) or type(e).__name__}], "isError": True}


def handle(reader: Reader, message: object, batches: bool = True) -> dict | list | None:
    """The reply to a message or a batch; None to notifications. Protocols from NO_BATCHES on have none."""
    if isinstance(message, list) and not batches:
        return {"jsonrpc": "2.0", "id": None, "error": {"code": INVALID, "message": "no batches in this protocol version"}}
    if isinstance(message, list):
        if not message:
            return {"jsonrpc": "2.0", "id": None, "error": {"code": INVALID, "message": "an empty batch"}}
        replies = [r for r in (handle(reader, m) for m in message) if r is not None]
        return replies or None
    if not isinstance(message, dict) or message.get("jsonrpc") != "2.0" or not isinstance(message.get("method"), str):
        return {"jsonrpc": "2.0", "id": None, "error": {"code": INVALID, "message": "not a request"}}
    if "id" not in message:
        return None
    try:
        return {"jsonrpc": "2.0", "id": message["id"], "result": _answer(reader, message["method"], message.get("params") or {})}
    except Fault as e:
        return {"jsonrpc": "2.0", "id": message["id"], "error": {"code": e.code, "message": str(e)}}


def serve(root: str, source: IO[str] = sys.stdin, sink: IO[str] = sys.stdout) -> None:
    reader, version = open_reader(root), VERSIONS[-1]
    for line in source:
        if not line.strip():
            continue
        try:
            message = json.loads(line)
            reply = handle(reader, message, version < NO_BATCHES)
            if isinstance(message, dict) and message.get("method") == "initialize" and reply and "result" in reply:
                version = reply["result"]["protocolVersion"]
        except ValueError:
            reply = {"jsonrpc": "2.0", "id": None, "error": {"code": PARSE, "message": "not JSON"}}
        if reply is not None:
            print(json.dumps(reply), file=sink, flush=True)
