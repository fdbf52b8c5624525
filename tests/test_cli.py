"""The commands, end to end."""

from __future__ import annotations

import json

import pytest

from lanewise.cli import main


def test_commands(spark, tmp_path, capsys):
    def call(*argv, code=0):
        assert main([str(tmp_path), "--json", *argv], spark) == code
        return [json.loads(x) for x in capsys.readouterr().out.splitlines()]

    assert call("recall", "x", code=1) == [] and call("init") == []
    (found,) = call("remember", "the build is green", "--meta", "kind=a=b")
    assert call("recall", "green build", "--where", "kind=a=b")[0]["fid"] == found["fid"]
    assert call("recall", "green build", "--where", "kind=other") == []
    assert call("checkpoint", "c1") == [{"name": "c1", "cut": "agent:e0:0"}] and call("checkpoints") == [{"name": "c1"}]
    assert call("agents") == [{"agent": "agent"}] and call("owner") == [{"agent": "agent", "holder": None}]
    assert call("forget", found["fid"][:8]) == [{"fid": found["fid"]}]
    assert call("recall", "green build") == [] and len(call("recall", "green build", "--at", "c1")) == 1
    assert call("stats")[0]["fragments"] == 0 and len(call("log")) == 2
    assert call("compact") == [] and call("gc")[0]["deleted"] >= 1
    assert call("lease", "job")[0]["epoch"] == 0 and call("spaces") == [{"space": "shared"}]
    call("remember", "x", "--meta", "nothing", code=1)
    with pytest.raises(SystemExit):
        main([str(tmp_path), "unknown"], spark)


def test_stored_dimension_and_mistyped_roots(spark, tmp_path, capsys):
    root = f"file://{tmp_path}/store"
    call = lambda *argv: main([root, "--json", *argv], spark)
    assert call("stats") == 1 and call("agents") == 1 and not (tmp_path / "store").exists()
    assert call("init", "--dim", "64") == 0 and call("remember", "a text") == 0 and call("stats") == 0
    assert json.loads(capsys.readouterr().out.splitlines()[-1])["plain"] == 4 * 64
    assert call("init", "--dim", "32") == 1
