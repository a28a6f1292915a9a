"""Modules of queries define every name once: a second text under an old name changes what the queries above read when they run."""

from __future__ import annotations

import ast
import pathlib
from collections import Counter

import pytest

from .conftest import ROOT


@pytest.mark.parametrize("path", sorted(pathlib.Path(ROOT, "lodestream/plans").glob("*.py")), ids=lambda p: p.stem)
def test_names_are_defined_once(path):
    names = Counter()
    for node in ast.parse(path.read_text()).body:
        if isinstance(node, (ast.FunctionDef, ast.ClassDef)):
            names[node.name] += 1
        for target in getattr(node, "targets", []) + ([node.target] if isinstance(node, ast.AnnAssign) else []):
            names.update(x.id for x in ast.walk(target) if isinstance(x, ast.Name))
    assert not [n for n, times in names.items() if times > 1]
