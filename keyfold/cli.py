"""The command line: python -m keyfold.cli <command> <dir> [args]."""

from __future__ import annotations

import sys
from typing import TextIO

#: Words that each command takes after its name, required and optional, and what it does.
COMMANDS = {
    "put": (["TABLE", "KEY", "VALUE"], [], "write one pair; answers ok"),
    "get": (["TABLE", "KEY"], [], "show the value of a key; exit status 1 if it has none"),
    "delete": (["TABLE", "KEY"], [], "remove a key; answers ok"),
    "scan": (["TABLE"], ["FROM", "TO"], "list pairs in key order, FROM included, TO not; an empty word is no bound"),
    "compact": (["TABLE"], [], "merge all runs that are due and level 0"),
    "info": (["TABLE"], [], "live keys, run files and deepest level"),
}
USAGE = "usage: python -m keyfold.cli COMMAND TABLE ...\n" + "".join(f"{name} {' '.join([*need, *(f'[{x}]' for x in more)])}: {what}\n" for name, (need, more, what) in COMMANDS.items())


def run(args: list[str], out: TextIO, err: TextIO, spark=None) -> int:
    """Runs one command; 0 done, 1 absent key, 2 wrong usage. An empty bound is open."""
    need, more, _ = COMMANDS.get(args[0], (None, None, None)) if args else (None, None, None)
    if need is None or not len(need) <= len(args) - 1 <= len(need) + len(more):
        err.write(USAGE)
        return 2
    from keyfold.operators.table import KVTable

    if spark is None:
        from pyspark.sql import SparkSession

        spark = SparkSession.builder.appName("keyfold").config("spark.ui.enabled", "false").getOrCreate()
    command, folder, *rest = args
    with KVTable.open(spark, folder) as table:
        if command == "put":
            table.put(*rest)
            out.write("ok\n")
        elif command == "get":
            value = table.get(rest[0])
            if value is None:
                return 1
            out.write(value.decode("utf-8", "replace") + "\n")
        elif command == "delete":
            table.delete(rest[0])
            out.write("ok\n")
        elif command == "scan":
            bounds = [x or None for x in [*rest, "", ""][:2]]
            for row in table.scan(*bounds).toLocalIterator():
                out.write(f"{bytes(row['key']).decode('utf-8', 'replace')}\t{bytes(row['value']).decode('utf-8', 'replace')}\n")
        elif command == "compact":
            table.compact()
        else:
            counts = table.run_counts()
            out.write(f"live_keys={table.size()} run_files={sum(counts.values())} deepest_level={max(counts, default=-1)}\n")
    return 0


if __name__ == "__main__":
    sys.exit(run(sys.argv[1:], sys.stdout, sys.stderr))
