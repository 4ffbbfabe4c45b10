"""Which parts of the package may import which."""

import ast
from pathlib import Path

import pytest

PACKAGE = Path(__file__).resolve().parent.parent / "tallyspark"
MODULES = [p for p in sorted(PACKAGE.rglob("*.py")) if "llm" not in p.relative_to(PACKAGE).parts]
#: What a part may import of the package when it is loaded; imports inside functions come later and are free.
LAYERS = {"errors": set(), "types": {"errors"}, "functions": {"errors", "types"}, "operators": {"errors", "types", "functions", "sources"}, "session": set()}


def imported(path, top_only=False):
    """Full names of the package's modules that a file imports."""
    here = ("tallyspark", *path.relative_to(PACKAGE).parts[:-1])
    tree = ast.parse(path.read_text())
    for node in tree.body if top_only else ast.walk(tree):
        if isinstance(node, ast.Import):
            yield from (a.name for a in node.names)
        elif isinstance(node, ast.ImportFrom):
            base = ".".join([*here[: len(here) - node.level + 1], *(node.module or "").split(".")]).rstrip(".") if node.level else node.module
            yield from (f"{base}.{a.name}" for a in node.names)


@pytest.mark.parametrize("path", MODULES, ids=lambda p: str(p.relative_to(PACKAGE)))
def test_imports(path):
    assert not [n for n in imported(path) if n.startswith("tallyspark.llm")]
    part = path.relative_to(PACKAGE).parts[0].removesuffix(".py")
    if part in LAYERS:
        parts = {n.split(".")[1] for n in imported(path, top_only=True) if n.startswith("tallyspark.")} - {part}
        assert parts <= LAYERS[part]


def test_corpus_operators_travel_by_value_and_stand_alone():
    for path in (PACKAGE / "llm").glob("*.py"):
        assert not [n for n in imported(path) if n.startswith("tallyspark.") and not n.startswith("tallyspark.llm")], path.name
