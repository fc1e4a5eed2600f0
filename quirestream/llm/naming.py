"""Names of result columns that no column of the input has."""

from __future__ import annotations

from collections.abc import Iterable


def free(taken: Iterable[str], *names: str) -> list[str]:
    """``names``, each with as many ``_`` behind it as it takes to be unlike all of
    ``taken`` and of the names before it (upper and lower case are one, as in Spark)."""
    held = {x.lower() for x in taken}
    out = []
    for name in names:
        while name.lower() in held:
            name += "_"
        held.add(name.lower())
        out.append(name)
    return out
