"""Function families: one query a family, each function as one column, next to the same expression for the oracle."""

from __future__ import annotations

from millrace.registry import REGISTRY

#: (column, Spark SQL, oracle SQL or None if it is the same)
Item = tuple[str, str, str | None]


def family(name: str, tables: str, keys: str, items: list[Item], source: str | None = None, oracle_source: str | None = None, tail: str = "", covers: str = "", oracle: bool = True) -> None:
    """Registers ``SELECT keys, items FROM source tail``."""
    source = source or tables.split()[0]
    keys = f"{keys}, " if keys else ""
    spark = f"SELECT {keys}" + ", ".join(f"{s} AS {c}" for c, s, _ in items) + f" FROM {source} {tail}"
    duck = f"SELECT {keys}" + ", ".join(f"{d or s} AS {c}" for c, s, d in items) + f" FROM {oracle_source or source} {tail}"
    REGISTRY.sql(name, tables, spark, covers or " ".join(c for c, _, _ in items), duck if oracle else None)


def joined(e: str) -> str:
    """An array of any type as text."""
    return f"array_join(transform({e}, x -> cast(x AS string)), ',')"


def joined_duck(e: str) -> str:
    return f"array_to_string(list_transform({e}, lambda x: x::VARCHAR), ',')"
