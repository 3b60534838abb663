"""The served protocol and the command line."""

import io
import json
import subprocess
import sys

import pytest

from fathom import schema
from fathom.__main__ import main
from fathom.plans import serve
from fathom.plans.api import NOT_INDEXED, ApiError


class Stub:
    def get_status(self, args):
        return {"indexed": True, "path": args["path"]}

    def search_code(self, args):
        raise ApiError(NOT_INDEXED, "the project is not indexed")

    def index_codebase(self, args):
        raise RuntimeError("lost")


def ask(*messages):
    out = io.StringIO()
    serve.serve(Stub(), io.StringIO("".join((m if isinstance(m, str) else json.dumps(m)) + "\n" for m in messages)), out)
    return [json.loads(line) for line in out.getvalue().splitlines()]


def call(name, number=1, **args):
    return {"jsonrpc": "2.0", "id": number, "method": "tools/call", "params": {"name": name, "arguments": args}}


def test_a_session():
    first, tools, status = ask({"jsonrpc": "2.0", "id": 0, "method": "initialize", "params": {}}, {"jsonrpc": "2.0", "method": "notifications/initialized"}, {"jsonrpc": "2.0", "id": 1, "method": "tools/list"}, "", call("get_status", "x", path="/p"))
    assert first["result"]["serverInfo"] == {"name": "fathom", "version": schema.VERSION}
    assert [t["name"] for t in tools["result"]["tools"]] == ["index_codebase", "search_code", "get_status"]
    assert all(set(t["inputSchema"]["required"]) <= set(t["inputSchema"]["properties"]) for t in tools["result"]["tools"])
    assert status["id"] == "x" and json.loads(status["result"]["content"][0]["text"]) == {"indexed": True, "path": "/p"}


@pytest.mark.parametrize(
    "message, code",
    [("{", serve.PARSE_ERROR), ("[]", serve.INVALID_REQUEST), ({"id": 1, "method": "ping"}, serve.INVALID_REQUEST), ({"jsonrpc": "2.0", "id": 1, "method": "x"}, serve.METHOD_NOT_FOUND), (call("drop"), -32602), (call("search_code", path="/p", query="a"), NOT_INDEXED), (call("index_codebase", path="/p"), -32603)],
)
def test_problems_have_their_codes(message, code):
    (found,) = ask(message)
    assert found["error"]["code"] == code and "result" not in found
    assert ask(message, {"jsonrpc": "2.0", "id": 9, "method": "ping"})[1] == {"jsonrpc": "2.0", "id": 9, "result": {}}


def test_the_command_line(capsys, monkeypatch):
    assert main(["--version"]) == 0 and schema.VERSION in capsys.readouterr().out
    monkeypatch.delenv("FATHOM_STORE", raising=False)
    for args in ([], ["serve"], ["search", "s", "p"], ["status", "s"], ["index", "s", "p", "q"]):
        assert main(args) == 2
    assert "python -m fathom" in capsys.readouterr().err
    assert schema.VERSION in subprocess.run([sys.executable, "-m", "fathom", "-v"], capture_output=True, text=True, timeout=60).stdout
