"""What the code leaves out is named in the README."""

from __future__ import annotations

from pathlib import Path

from tessera.functions import dims

TOP = Path(__file__).resolve().parents[1]


def test_contexts_that_nothing_makes_are_named():
    code, readme = (TOP / "tessera/operators/contexts.py").read_text(), (TOP / "README.md").read_text()
    assert [ctx for _, ctx, _ in dims.SUPPRESSIONS if ctx not in code and f"`{ctx}`" not in readme] == []
