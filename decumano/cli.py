"""Command line: create a project from files, check it, sum it up, export it."""

from __future__ import annotations

import argparse
import os

from .engine import Engine
from .session import local_session
from .sources import sinks, tables


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="decumano")
    sub = p.add_subparsers(dest="verb", required=True)
    for verb, helps in (("create", "a project from delimited files"), ("check", "the relations of a project"), ("info", "its tables"), ("export", "its tables as a workbook"), ("recipe", "print the proposed recipe")):
        s = sub.add_parser(verb, help=helps)
        s.add_argument("project")
        if verb in ("create", "recipe"):
            s.add_argument("files", nargs="+")
        if verb == "export":
            s.add_argument("-o", "--out", required=True)
    a = p.parse_args(argv)
    spark = local_session()
    e = Engine(spark, a.project)
    if a.verb in ("create", "recipe"):
        sheets = {os.path.splitext(os.path.basename(f))[0]: tables.read_table(spark, f) for f in a.files}
        if a.verb == "create":
            print(e.create(sheets).to_json())
        else:
            from .plans.recipe import propose

            print(propose(sheets).to_json())
    elif a.verb == "check":
        bad = e.check().orderBy("livello", "unita")
        for r in bad.toLocalIterator():
            print(r.livello, r.codice, r.unita)
        return int(bad.where("livello = 'errore'").count() > 0)
    elif a.verb == "info":
        e.summary().show(truncate=False)
    else:
        sinks.write_workbook(e.tables, a.out)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
