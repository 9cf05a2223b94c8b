"""python -m symgraph COMMAND: build, check, map, skeleton, callers, grep, ask, cards, export, serve."""

from __future__ import annotations

import argparse
import sys

from symgraph.plans import state
from symgraph.plans.cards import file_cards, write_cards
from symgraph.render import open_reader
from symgraph.server import serve


def main(args: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="symgraph")
    p.add_argument("--dir", default=".")
    sub = p.add_subparsers(dest="command", required=True)
    for name in ("build", "check", "map", "serve"):
        sub.add_parser(name)
    sub.add_parser("skeleton").add_argument("path")
    c = sub.add_parser("callers")
    c.add_argument("symbol")
    c.add_argument("--direction", default="in")
    c.add_argument("--depth", default="1")
    g = sub.add_parser("grep")
    g.add_argument("pattern")
    g.add_argument("--literal", action="store_true")
    g.add_argument("--ignore-case", action="store_true")
    g.add_argument("--scope")
    a = sub.add_parser("ask")
    a.add_argument("question")
    a.add_argument("--limit", type=int, default=8)
    a.add_argument("--source", action="store_true")
    a.add_argument("--full", action="store_true")
    a.add_argument("--scope")
    for name in ("cards", "export"):
        sub.add_parser(name).add_argument("out")
    o = p.parse_args(args)
    if o.command == "serve":
        serve(o.dir)
        return 0
    r = open_reader(o.dir if o.command == "build" else state.workspace_root(o.dir) or o.dir)
    try:
        if o.command == "build":
            print(", ".join(f"{k} {v}" for k, v in r.workspace.build().items()))
        elif o.command == "check":
            print(found := r.check())
            return int(not found.startswith("fresh"))
        elif o.command == "map":
            print(r.map())
        elif o.command == "skeleton":
            print(r.skeleton(o.path))
        elif o.command == "callers":
            print(r.callers(o.symbol, o.direction, o.depth))
        elif o.command == "grep":
            print(r.grep(o.pattern, o.literal, o.ignore_case, o.scope))
        elif o.command == "cards":
            print(", ".join(f"{k} {v}" for k, v in write_cards(file_cards(r.workspace.tables()[0]), o.out).items()))
        elif o.command == "export":
            state.write_json(*r.workspace.tables(), o.out)
        else:
            print(r.ask(o.question, o.limit, o.source, o.full, o.scope))
    except (ValueError, FileExistsError) as e:
        print(e, file=sys.stderr)
        return 2
    return 0


if __name__ == "__main__":
    sys.exit(main())
