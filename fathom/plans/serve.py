"""The three entry points served over standard input and output: one JSON-RPC 2.0 message a line, as tool protocols do."""

from __future__ import annotations

import json
from typing import TextIO

from fathom import schema
from fathom.plans.api import INTERNAL, INVALID_PARAMS, SEARCH_KINDS, ApiError, Engine

# Codes of JSON-RPC and the revision of the tool protocol.
PARSE_ERROR, INVALID_REQUEST, METHOD_NOT_FOUND = -32700, -32600, -32601
PROTOCOL = "2024-11-05"

_PATH = {"type": "string", "description": "Absolute path of the project's folder"}


def _list(values: tuple[str, ...]) -> dict:
    return {"type": "array", "items": {"type": "string", "enum": list(values)}}


TOOLS = [
    {
        "name": "index_codebase",
        "description": "Bring the index of a project up to date",
        "inputSchema": {"type": "object", "required": ["path"], "properties": {"path": _PATH} | {k: {"type": "boolean", "default": d} for k, d in (("force_reindex", False), ("include_tests", True), ("include_vendor", False), ("prune", False))}},
    },
    {
        "name": "search_code",
        "description": "Search an indexed project by meaning, by words, or by both",
        "inputSchema": {
            "type": "object",
            "required": ["path", "query"],
            "properties": {
                "path": _PATH,
                "query": {"type": "string"},
                "limit": {"type": "integer", "minimum": 1, "maximum": 100, "default": 10},
                "search_mode": {"type": "string", "enum": list(schema.MODES), "default": "hybrid"},
                "filters": {
                    "type": "object",
                    "properties": {
                        "symbol_types": _list(SEARCH_KINDS), "file_pattern": {"type": "string"}, "ddd_patterns": _list(schema.PATTERNS),
                        "packages": {"type": "array", "items": {"type": "string"}}, "min_relevance": {"type": "number", "minimum": 0, "maximum": 1},
                    },
                },
            },
        },
    },
    {"name": "get_status", "description": "What the index holds of a project", "inputSchema": {"type": "object", "required": ["path"], "properties": {"path": _PATH}}},
]


class _Problem(Exception):
    def __init__(self, code: int, message: str):
        super().__init__(message)
        self.code = code


def _call(engine: Engine, method: str, params: dict) -> dict:
    match method:
        case "initialize":
            return {"protocolVersion": PROTOCOL, "capabilities": {"tools": {}}, "serverInfo": {"name": "fathom", "version": schema.VERSION}}
        case "ping":
            return {}
        case "tools/list":
            return {"tools": TOOLS}
        case "tools/call":
            name, args = params.get("name"), params.get("arguments") or {}
            if name not in {t["name"] for t in TOOLS} or not isinstance(args, dict):
                raise _Problem(INVALID_PARAMS, f"unknown tool {name}")
            answer = getattr(engine, name)(args)
            return {"content": [{"type": "text", "text": json.dumps(answer, sort_keys=True, default=str)}]}
        case _:
            raise _Problem(METHOD_NOT_FOUND, f"unknown method {method}")


def answer(engine: Engine, line: str) -> str | None:
    """The answer to one message; None to a notification."""
    number = None
    try:
        try:
            message = json.loads(line)
        except ValueError as e:
            raise _Problem(PARSE_ERROR, "no JSON") from e
        if not isinstance(message, dict) or message.get("jsonrpc") != "2.0" or not isinstance(message.get("method"), str) or not isinstance(message.get("params", {}), dict):
            raise _Problem(INVALID_REQUEST, "no request")
        if "id" not in message:
            return None
        number = message["id"]
        return json.dumps({"jsonrpc": "2.0", "id": number, "result": _call(engine, message["method"], message.get("params", {}))})
    except (_Problem, ApiError) as e:
        code, text = e.code, str(e)
    except Exception as e:  # noqa: BLE001  a request that fails does not end the server
        code, text = INTERNAL, f"{type(e).__name__}: {e}"
    return json.dumps({"jsonrpc": "2.0", "id": number, "error": {"code": code, "message": text}})


def serve(engine: Engine, requests: TextIO, answers: TextIO) -> None:
    """Answer requests, one a line, until they end."""
    for line in requests:
        if line.strip() and (out := answer(engine, line)) is not None:
            answers.write(out + "\n")
            answers.flush()
