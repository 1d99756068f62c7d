"""Column names."""

from __future__ import annotations

from itertools import count

from pyspark.sql import Column
from pyspark.sql import functions as F


def dedupe(names: list[str]) -> list[str]:
    """Make names unique in order: a name that was given before gets the first ``.N`` that was not."""
    out: dict[str, None] = {}
    for name in names:
        numbered = (f"{name}.{n}" for n in count(1))
        out[name if name not in out else next(x for x in numbered if x not in out)] = None
    return list(out)


def deduped(names: Column) -> Column:
    """The same over an array of names, in the plan."""

    def add(out: Column, name: Column) -> Column:
        numbered = F.transform(F.sequence(F.lit(1), F.size(out) + 1), lambda n: F.concat(name, F.lit("."), n.cast("string")))
        free = F.filter(numbered, lambda x: ~F.array_contains(out, x))
        return F.array_append(out, F.when(F.array_contains(out, name), F.element_at(free, 1)).otherwise(name))

    return F.aggregate(names, F.array().cast("array<string>"), add)


def column_names(labels: list[str | None], headerless: bool = False) -> list[str]:
    """Names of a loaded table: ``col_0`` on without a header; blanks get their position."""
    if headerless:
        return [f"col_{i}" for i in range(len(labels))]
    return dedupe([f"Unnamed: {i}" if x in (None, "") else x for i, x in enumerate(labels)])
