"""All registered queries, with the SQL that they are held against."""

from . import algorithms, language, series, sources, space

MODULES = (language, series, space, algorithms, sources)


def queries() -> dict:
    found: dict = {}
    for m in MODULES:
        for name, f in m.QUERIES.items():
            if name in found:
                raise ValueError(f"two queries are named {name}")
            found[name] = f
    return found


def oracle_sql() -> dict[str, str]:
    return {k: v for m in MODULES for k, v in m.ORACLE.items()}
