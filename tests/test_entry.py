"""The driver's contract, with and without the optional subpackage."""

from __future__ import annotations

import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]


def test_registry_is_consistent():
    from quillspark.plans import registry

    assert set(registry.SQL) <= set(registry.QUERIES)
    assert len(registry.QUERIES) >= 40


def test_entry_imports_without_the_optional_parts(tmp_path):
    for name in ("__spark_entry__.py", "quillspark"):
        (tmp_path / name).symlink_to(ROOT / name) if name.endswith(".py") else _link_without_llm(ROOT / name, tmp_path / name)
    code = "import sys; sys.path.insert(0, '.'); import __spark_entry__ as e; print(len(e.queries()), all(not k.startswith('op') for k in e.queries()))"
    (tmp_path / "__spark_entry__.py").unlink()
    (tmp_path / "__spark_entry__.py").write_text((ROOT / "__spark_entry__.py").read_text())
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, check=True, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)})
    assert out.stdout.split()[1] == "True"


def _link_without_llm(source: Path, to: Path) -> None:
    to.mkdir()
    for p in source.iterdir():
        if p.name not in ("llm", "__pycache__"):
            (to / p.name).symlink_to(p)
