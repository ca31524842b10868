"""Named operators for ``df.transform``: users add their own beside the library's."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

Operator = Callable[..., DataFrame]
_OPERATORS: dict[str, Operator] = {}


def register_operator(name: str) -> Callable[[Operator], Operator]:
    """Registers a function whose first argument is a DataFrame; a name can be taken once."""

    def register(f: Operator) -> Operator:
        if name in _OPERATORS:
            raise ValueError(f"operator {name} is registered already")
        _OPERATORS[name] = f
        return f

    return register


def operator(name: str) -> Operator:
    if name not in _OPERATORS:
        raise KeyError(f"no operator {name}; there are {', '.join(sorted(_OPERATORS)) or 'none'}")
    return _OPERATORS[name]
