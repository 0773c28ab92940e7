"""Scripts and an interactive shell. Exit codes: 0 done, 1 a diagnostic, 2 wrong usage."""

from __future__ import annotations

import json
import sys
from typing import Any

from ..errors import DiagnosticError
from ..functions.types import Reference
from ..operators.selection import Aggregation, GroupedSelection, Selection
from ..sources.catalog import Engine
from .lexer import split
from .session import Session


def shown(x: Any) -> Any:
    if isinstance(x, (Selection, GroupedSelection, Aggregation)):
        return shown(x.consume())
    if isinstance(x, dict):
        return {str(k): shown(v) for k, v in x.items()}
    if isinstance(x, (set, frozenset)):
        return sorted((shown(v) for v in x), key=repr)
    if isinstance(x, (list, tuple)):
        return [shown(v) for v in x]
    if isinstance(x, Reference):
        return x.to_dict()
    return x if isinstance(x, (str, int, float, bool, type(None))) else str(x)


def tell(e: DiagnosticError) -> None:
    print(f"Error [{e.code}]: {e.message}")
    print(json.dumps(shown(e.to_dict())))


def run_script(path: str, engine: Engine) -> int:
    try:
        with open(path, encoding="utf-8") as f:
            source = f.read()
    except OSError as e:
        print(f"{path}: {e}", file=sys.stderr)
        return 2
    session = Session(engine)
    try:
        for result in (session.execute(text) for text, _ in split(source)):
            if result is not None:
                print(json.dumps(shown(result), ensure_ascii=False))
    except DiagnosticError as e:
        tell(e)
        return 1
    return 0


def run_repl(engine: Engine, lines: Any = None) -> int:
    session, held = Session(engine), ""
    for line in lines if lines is not None else iter(lambda: input("... " if held else "> "), None):
        if not held and line.strip() in ("exit", "quit"):
            return 0
        held += line + "\n"
        if sum(held.count(c) for c in "([{") > sum(held.count(c) for c in ")]}"):
            continue
        text, held = held, ""
        try:
            for statement, _ in split(text):
                result = session.execute(statement)
                if result is not None:
                    print(json.dumps(shown(result), ensure_ascii=False))
        except DiagnosticError as e:
            tell(e)
    return 0


def main(args: list[str]) -> int:
    from pyspark.sql import SparkSession

    if len(args) > 1 or args[:1] and args[0].startswith("-"):
        print("usage: python -m orrery [script.ql]", file=sys.stderr)
        return 2
    engine = Engine(SparkSession.builder.appName("orrery").getOrCreate())
    return run_script(args[0], engine) if args else run_repl(engine)
