"""``python -m featherloom.installed``: whether what the library needs is there and works."""

from __future__ import annotations

import importlib
import sys
from collections.abc import Callable

#: Modules, and whether the library works without them.
MODULES = {"pyspark": False, "pyarrow": False, "pandas": False, "numpy": False, "yaml": True, "ahocorasick": True, "regex": True, "duckdb": True}


def _module(name: str) -> str:
    return getattr(importlib.import_module(name), "__version__", "there")


def _query() -> str:
    from featherloom.session import get_session

    return f"{get_session(2).range(1000).selectExpr('sum(id) AS s').first().s} of 499500"


def checks() -> dict[str, tuple[Callable[[], str], bool]]:
    """Name -> (function that says what is there, whether its failure is no fault)."""
    return {**{m: ((lambda m=m: _module(m)), optional) for m, optional in MODULES.items()}, "a query": (_query, False)}


def main() -> int:
    failed = 0
    for name, (check, optional) in checks().items():
        try:
            print(f"ok       {name}: {check()}")
        except Exception as e:
            failed += not optional
            print(f"{'without ' if optional else 'FAILED  '} {name}: {e}")
    return 1 if failed else 0


if __name__ == "__main__":
    sys.exit(main())
