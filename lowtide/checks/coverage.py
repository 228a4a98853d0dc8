"""Print the operator inventory with the functions and queries that cover each entry."""

from __future__ import annotations

import importlib
import inspect
import re
import sys

from lowtide.checks import REGISTRY

AREAS = {
    "S": "Sources",
    "K": "Sinks and table state",
    "P": "Projections, filters, predicates",
    "J": "Joins",
    "A": "Aggregations",
    "W": "Windows and time series",
    "O": "Sort, limit, top-k",
    "U": "Set operations",
    "F": "Scalar functions",
    "D": "Document flattening",
    "C": "Screening",
    "Q": "Data quality",
    "T": "Streaming",
}

IGNORED = (
    "lowtide.checks.base",
    "lowtide.session",
    "lowtide.sources.benchmark_tables",
    "lowtide.sources.layout",
)


def _resolve(token: str, scope: dict):
    head, *rest = token.split(".")
    found = scope.get(head)
    for part in rest:
        found = getattr(found, part, None)
    return found


def _local_imports(source: str) -> dict:
    scope = {}
    for module, names in re.findall(r"from (lowtide[\w.]*) import ([\w, ]+)", source):
        for name in names.split(","):
            original, _, alias = name.strip().partition(" as ")
            loaded = importlib.import_module(module)
            value = getattr(loaded, original, None) or importlib.import_module(f"{module}.{original}")
            scope[alias or original] = value
    return scope


def functions_of(run, seen: set | None = None) -> list[str]:
    """Library functions a query calls, through its helpers."""
    seen = set() if seen is None else seen
    source = inspect.getsource(run)
    scope = {**run.__globals__, **_local_imports(source)}
    out: list[str] = []
    for token in dict.fromkeys(re.findall(r"\b((?:\w+\.)?\w+)\(", source)):
        target = _resolve(token, scope)
        if not inspect.isfunction(target) or target in seen:
            continue
        seen.add(target)
        module = target.__module__
        if module.startswith("lowtide.checks") and not module.endswith("base"):
            out += functions_of(target, seen)
        elif module.startswith("lowtide.") and module not in IGNORED:
            out.append(f"{module.removeprefix('lowtide.')}.{target.__name__}")
    return out


def main(survey: str) -> None:
    rows = re.findall(r"^\| ([A-Z]-(?:\d+|[A-H])) \| ((?:[^|\\]|\\.)+) \|", open(survey).read(), re.M)
    inventory = [(i, what.strip()) for i, what in rows if not re.fullmatch(r"Q-\d+", i)]
    print("# Operator coverage\n")
    print("Every query has an SQL twin, unless marked *.\n")
    for letter, title in AREAS.items():
        print(f"## {title}\n\n| ID | Operator | Functions | Queries |\n|---|---|---|---|")
        for operator, what in inventory:
            if not operator.startswith(f"{letter}-"):
                continue
            queries = [q for q in REGISTRY.values() if operator in q.covers]
            names = ", ".join(f"`{q.name}`" + ("" if q.sql else "*") for q in queries)
            used = list(dict.fromkeys(f for q in queries for f in functions_of(q.run)))
            print(f"| {operator} | {what} | {', '.join(f'`{f}`' for f in used)} | {names} |")
        print()


if __name__ == "__main__":
    main(sys.argv[1])
