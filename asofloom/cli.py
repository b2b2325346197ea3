"""python -m asofloom: lists primitives and checks configurations."""

import argparse
import sys

from .functions import aggregations, transformations  # noqa: F401 - registers the primitives
from .functions.registry import AGGREGATIONS, TRANSFORMATIONS
from .plans.validation import problems
from .sources.config import load


def listed(kind, search, as_config):
    """Lines for the primitives of a kind whose name or description has the searched text."""
    out = []
    for title, registry, key in (("agg", AGGREGATIONS, "aggregations"), ("transform", TRANSFORMATIONS, "transformations")):
        if kind not in (title, "all"):
            continue
        found = [n for n in registry.names() if not search or search.lower() in f"{n} {getattr(registry.items[n], 'doc', '')}".lower()]
        if as_config:
            out += [f"{key}:", *(f"  - {n}" for n in found)]
        else:
            out += [f"{n:28} {title:10} {', '.join(getattr(registry.items[n], 'inputs', ())):32} {getattr(registry.items[n], 'doc', '')}" for n in found]
    return out


def main(arguments=None):
    parser = argparse.ArgumentParser(prog="asofloom")
    commands = parser.add_subparsers(dest="command", required=True)
    p = commands.add_parser("list-primitives", help="names, inputs and descriptions")
    p.add_argument("-t", "--type", choices=["agg", "transform", "all"], default="all")
    p.add_argument("-s", "--search")
    p.add_argument("-c", "--config", action="store_true", help="as lists for a configuration")
    p = commands.add_parser("validate", help="check a configuration file")
    p.add_argument("config")
    args = parser.parse_args(arguments)
    if args.command == "list-primitives":
        print("\n".join(listed(args.type, args.search, args.config)))
        return 0
    try:
        found = problems(load(args.config, validate=False))
    except (OSError, ValueError) as e:
        print(f"error: {e}", file=sys.stderr)
        return 1
    for w in found.warnings:
        print(f"warning: {w}")
    for e in found.errors:
        print(f"error: {e}")
    if not found.errors:
        print("valid")
    return 1 if found.errors else 0
