"""The entry point lives without the optional parts and without what they need."""

from __future__ import annotations

import subprocess
import sys
from pathlib import Path

import pytest

HOME = Path(__file__).resolve().parent.parent


@pytest.mark.parametrize("missing", ["xxhash", "ahocorasick", "public_tokenizers", "zstandard"])
def test_entry_survives_a_missing_dependency(missing: str) -> None:
    code = f"import sys; sys.modules['{missing}'] = None; import __spark_entry__ as e; assert len(e.queries()) > 80 and not any(n.startswith('op') or n == 'pipeline' for n in e.queries()); assert set(e.oracle_sql()) <= set(e.queries())"
    subprocess.run([sys.executable, "-c", code], cwd=HOME, check=True)
