"""Column names that clash with none."""

from __future__ import annotations


def unused(columns: list[str], *names: str) -> list[str]:
    """The names with as many underscores behind them as it takes to be none of ``columns`` (whatever their case)."""
    have, out = {c.lower() for c in columns}, []
    for name in names:
        while name.lower() in have:
            name += "_"
        have.add(name.lower())
        out.append(name)
    return out
