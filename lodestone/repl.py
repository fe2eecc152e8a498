"""`python -m lodestone.repl [folder]`: statements at a prompt, ended by `;`, and commands that begin with a dot."""

from __future__ import annotations

import sys
from collections.abc import Iterable, Iterator

from pyspark.sql import SparkSession

from lodestone.session import Session

VERSION = "0.1"
HELP = """.tables .collections   collections
.schema [name]         observed types and how many documents have each field
.indexes .views        definitions
.cache                 what Spark holds in memory
.import name path      JSON files into a collection
.dump                  statements that make the database again
.vacuum                give back the room of deleted documents
.clear .version .help .quit .exit"""


class Repl:
    def __init__(self, session: Session):
        self.session, self.pending = session, ""

    def feed(self, line: str) -> Iterator[str]:
        """What a line of input brings; statements may run over lines. Raises EOFError at the end."""
        if not self.pending and line.strip().startswith("."):
            yield from self.command(*line.split())
            return
        self.pending += line + "\n"
        text = self.pending.strip()
        if not text:
            self.pending = ""
        elif text.endswith(";"):
            self.pending = ""
            yield from self.statement(text)

    def statement(self, text: str) -> Iterator[str]:
        try:
            result = self.session.execute(text)
            if result.df is None:
                last = f", last id {result.last_insert_id}" if result.last_insert_id else ""
                yield f"{result.rows_affected} documents{last}"
                return
            n = 0
            for row in result.df.toLocalIterator():  # a partition at a time
                n += 1
                yield str(row.asDict(True))
            yield f"{n} rows"
        except Exception as error:  # noqa: BLE001  the prompt goes on
            yield f"error: {str(error).splitlines()[0]}"

    def command(self, name: str, *args: str) -> Iterator[str]:
        s = self.session
        match name.lower():
            case ".quit" | ".exit":
                raise EOFError
            case ".help":
                yield HELP
            case ".tables" | ".collections":
                yield from s.collections()
            case ".schema":
                for table in args or s.collections():
                    yield table
                    for x in s.schema(table):
                        yield f"  {x['path']}: {', '.join(x['types'])} ({100 * x['count'] // max(1, x['total'])} %)"
            case ".indexes":
                yield from (f"{t} ({p})" for t, p in s.indexes())
            case ".views":
                yield from (f"{k}: {v}" for k, v in s.views().items())
            case ".cache":
                yield str(s.cache_stats())
            case ".import" if len(args) == 2:
                yield f"{s.import_json(*args).rows_affected} documents"
            case ".dump":
                yield from s.dump()
            case ".vacuum":
                yield f"{s.vacuum()} documents"
            case ".clear":
                yield "\033[2J\033[H"
            case ".version":
                yield VERSION
            case _:
                yield f"no command {name}; .help lists them"


def main(args: list[str], lines: Iterable[str] = sys.stdin) -> None:
    repl = Repl(Session(SparkSession.builder.getOrCreate(), args[0] if args else None))
    try:
        for line in lines:
            for said in repl.feed(line.rstrip("\n")):
                print(said, flush=True)
    except EOFError:
        pass


if __name__ == "__main__":
    main(sys.argv[1:])
