"""The nine tools as JSON-RPC messages, and over HTTP POST; one message at a time, answered in full.

``handle`` takes a parsed message and needs no network. Arguments are held against each tool's schema before it runs.
"""

from __future__ import annotations

import json
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

from .model import OPS, QueryError
from .tools import Tools

PROTOCOL = "2025-06-18"
BODY_MAX = 1 << 20


def text(most: int = 200, **more) -> dict:
    return {"type": "string", "maxLength": most} | more


def whole(low: int, high: int | None = None) -> dict:
    return {"type": "integer", "minimum": low} | ({"maximum": high} if high is not None else {})


TABLE = {"table_id": text(), "sheet": text()}
FILTERS = {
    "type": "array",
    "maxItems": 10,
    "items": {"type": "object", "properties": {"column": text(), "op": {"type": "string", "enum": list(OPS)}, "value": text(), "values": {"type": "array", "maxItems": 20, "items": text()}}, "required": ["column", "op"]},
}
#: By tool: what it is for, its arguments, and which of them it needs.
SCHEMAS: dict[str, tuple[str, dict, tuple[str, ...]]] = {
    "table_list": ("The tables that can be asked about.", {"cursor": text(20)}, ()),
    "table_describe": ("A table's size, columns and kinds.", TABLE | {"detail": {"type": "string", "enum": ["brief", "full"]}, "cursor": text(20)}, ()),
    "table_structure": ("How the headings were read, or another reading.", TABLE | {"header_rows": whole(0, 5)}, ()),
    "table_query": (
        "Counts, sums, averages, least and greatest values, groups or rows.",
        TABLE
        | {"filters": FILTERS, "aggregate": {"type": "string", "enum": ["none", "count", "sum", "avg", "min", "max"]}, "aggregate_column": text(), "group_by": text(), "order": {"type": "string", "enum": ["desc", "asc"]}, "limit": whole(1, 20), "cursor": text(20)},
        (),
    ),
    "table_explain": ("The cells behind an answer.", {"answer_id": text(60), "limit": whole(1, 50)}, ("answer_id",)),
    "table_read_rows": ("Rows as they stand.", TABLE | {"columns": {"type": "array", "maxItems": 20, "items": text()}, "start_row": whole(1), "cursor": text(20), "limit": whole(1, 10)}, ()),
    "table_compare": (
        "Two columns set against each other.",
        TABLE | {"left_column": text(), "right_column": text(), "right_table_id": text(), "right_sheet": text(), "aggregate": {"type": "string", "enum": ["sum", "avg", "min", "max"]}, "filters": FILTERS},
        ("left_column", "right_column"),
    ),
    "table_bookmark": ("A row to come back to.", TABLE | {"name": text(60), "row": whole(1), "note": text(500)}, ("name",)),
    "table_resume": ("Back to a bookmark.", {"name": text(60)}, ()),
}


def schema(name: str) -> dict:
    _, properties, required = SCHEMAS[name]
    return {"type": "object", "properties": properties, "required": list(required), "additionalProperties": False}


def fault(value, want: dict, at: str = "arguments") -> str | None:
    """What is wrong with a value by its schema, or None."""
    kind = {"string": str, "integer": int, "array": list, "object": dict}[want["type"]]
    if not isinstance(value, kind) or isinstance(value, bool):
        return f"{at} must be of type {want['type']}"
    if "enum" in want and value not in want["enum"]:
        return f"{at} must be one of {', '.join(want['enum'])}"
    if isinstance(value, str) and len(value) > want.get("maxLength", len(value)):
        return f"{at} is longer than {want['maxLength']} characters"
    if isinstance(value, int) and not want.get("minimum", value) <= value <= want.get("maximum", value):
        return f"{at} must be from {want['minimum']} to {want.get('maximum', 'any number')}"
    if isinstance(value, list):
        if len(value) > want["maxItems"]:
            return f"{at} has more than {want['maxItems']} items"
        return next((f for k, v in enumerate(value) if (f := fault(v, want["items"], f"{at}[{k}]"))), None)
    if isinstance(value, dict):
        known = want["properties"]
        odd = [k for k in value if k not in known] + [k for k in want.get("required", ()) if k not in value]
        if odd:
            return f"{at}: {odd[0]} is {'not known' if odd[0] in value else 'missing'}"
        return next((f for k, v in value.items() if (f := fault(v, known[k], f"{at}.{k}"))), None)
    return None


def handle(tools: Tools, message) -> dict | None:
    """The answer to a message; None to a notification."""
    if not isinstance(message, dict) or message.get("jsonrpc") != "2.0" or not isinstance(message.get("method"), str):
        return {"jsonrpc": "2.0", "id": None, "error": {"code": -32600, "message": "not a JSON-RPC 2.0 message"}}
    method, params, key = message["method"], message.get("params") or {}, message.get("id")
    if "id" not in message:
        return None
    ok = lambda result: {"jsonrpc": "2.0", "id": key, "result": result}
    wrong = lambda code, said: {"jsonrpc": "2.0", "id": key, "error": {"code": code, "message": said}}
    if method == "initialize":
        return ok({"protocolVersion": PROTOCOL, "capabilities": {"tools": {}}, "serverInfo": {"name": "quillgrid", "version": "1"}})
    if method == "ping":
        return ok({})
    if method == "tools/list":
        return ok({"tools": [{"name": n, "description": SCHEMAS[n][0], "inputSchema": schema(n)} for n in SCHEMAS]})
    if method != "tools/call":
        return wrong(-32601, f"there is no method {method}")
    name, given = params.get("name"), params.get("arguments") or {}
    if name not in SCHEMAS:
        return wrong(-32602, f"there is no tool {name}")
    bad = fault(given, schema(name))
    if bad:
        return wrong(-32602, bad)
    try:
        out = getattr(tools, name)(**given)
    except QueryError as e:
        return ok({"content": [{"type": "text", "text": f"{e.message} {e.next_step}".strip()}], "isError": True})
    return ok({"content": [{"type": "text", "text": out["spoken"]}], "structuredContent": json.loads(json.dumps(out, default=str)), "isError": False})


def server(tools: Tools, host: str = "127.0.0.1", port: int = 8000) -> ThreadingHTTPServer:
    """An HTTP server of POST /mcp; ``serve_forever()`` runs it."""

    class Handler(BaseHTTPRequestHandler):
        def _send(self, status: int, body: dict | None) -> None:
            data = b"" if body is None else json.dumps(body, ensure_ascii=False).encode()
            self.send_response(status)
            self.send_header("Content-Type", "application/json")
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()
            self.wfile.write(data)

        def do_POST(self) -> None:
            size = int(self.headers.get("Content-Length") or 0)
            if self.path != "/mcp" or not 0 < size <= BODY_MAX:
                return self._send(404 if self.path != "/mcp" else 413, None)
            try:
                message = json.loads(self.rfile.read(size))
            except ValueError:
                return self._send(400, {"jsonrpc": "2.0", "id": None, "error": {"code": -32700, "message": "not JSON"}})
            answer = handle(tools, message)
            self._send(202 if answer is None else 200, answer)

        def log_message(self, *args) -> None:
            pass

    return ThreadingHTTPServer((host, port), Handler)
