"""Test modules are imported by their base names, so these have to differ."""

from collections import Counter
from pathlib import Path


def test_base_names_differ():
    names = Counter(p.name for p in Path(__file__).resolve().parent.rglob("*.py"))
    assert [n for n, k in names.items() if k > 1] == []
