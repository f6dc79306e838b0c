import io
import json

import pytest

from sieveline.plans import serving, tools


def registry():
    r = tools.Registry(cache=False)
    r.add(tools.Tool("echo", "Gives back its text.", ("text",), lambda args: {"content": [{"type": "text", "text": args["text"]}]}))
    return r


def ask(line):
    return serving.answer(registry(), tools.Resources("doc", lambda: [{"uri": "doc://a/b"}], lambda uri: {"uri": uri, "text": "t"}), line if isinstance(line, str) else json.dumps(line))


def test_transport_is_chosen_in_order():
    assert serving.select_transport(env={}) == "stdio" and serving.select_transport(env={serving.TRANSPORT_VARIABLE: " http "}) == "http"
    assert serving.select_transport("stdio", {serving.TRANSPORT_VARIABLE: "http"}) == "stdio"
    for bad in (("tcp", {}), (None, {serving.TRANSPORT_VARIABLE: "x"}), ("", {})):
        with pytest.raises(ValueError):
            serving.select_transport(*bad)


def test_requests_are_answered():
    assert ask({"id": 1, "method": "tools/list"})["result"]["tools"] == [{"name": "echo", "description": "Gives back its text.", "inputSchema": {"type": "object", "properties": {"text": {}}}}]
    assert ask({"id": 2, "method": "tools/call", "params": {"name": "echo", "arguments": {"text": "hi"}}})["result"]["content"][0]["text"] == "hi"
    assert ask({"id": 3, "method": "tools/call", "params": {"name": "none"}})["result"]["isError"] is True
    assert ask({"id": 4, "method": "resources/read", "params": {"uri": "doc://a/b"}})["result"]["contents"][0]["text"] == "t"
    codes = {"{": -32700, "[]": -32600, "x" * (serving.MOST_BYTES + 1): -32600, json.dumps({"id": 5, "method": "no"}): -32601, json.dumps({"id": 6, "method": "tools/call"}): -32602, json.dumps({"id": 7, "method": "resources/read", "params": {"uri": "doc://../x"}}): -32602}
    for line, code in codes.items():
        assert ask(line)["error"]["code"] == code
    assert ask({"method": "ping"}) is None
    out = io.StringIO()
    assert serving.serve_lines(registry(), ['{"id": 1, "method": "ping"}\n', "\n", '{"method": "ping"}\n'], out) == 1 and json.loads(out.getvalue())["result"] == {}


def test_a_new_project(tmp_path):
    from sieveline.sources import evalset

    assert serving.replace_tokens("{{A}} and {{A}}{{B}}", {"A": "{{B}}", "B": "x"}) == "{{B}} and {{B}}x"
    with pytest.raises(ValueError, match="B"):
        serving.replace_tokens("{{A}}{{B}}", {"A": "x"})
    files = serving.new_project(str(tmp_path / "my-docs"))
    assert len(files) == 4 and not any("{{" in open(f).read() for f in files)
    assert len(evalset.parse((tmp_path / "my-docs" / "eval.yml").read_text())["queries"]) == 2
    compile((tmp_path / "my-docs" / "build.py").read_text(), "build.py", "exec")
    for folder, name in ((tmp_path / "my-docs", None), (tmp_path / "n", "Bad Name"), (tmp_path / "n", "../x")):
        with pytest.raises(ValueError):
            serving.new_project(str(folder), name)
