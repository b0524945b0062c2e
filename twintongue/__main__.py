"""A plain command line: python -m twintongue [script ...]; without a script, statements from the terminal.

Lines `.sql` and `.datalog` choose the language, `.load name path` registers a
Parquet file, `.quit` ends. A statement ends with a semicolon, a Datalog program
with an empty line.
"""

from __future__ import annotations

import sys

from .errors import EngineError
from .plans.engine import Done, Engine


def show(result) -> None:
    if isinstance(result, Done):
        print(result.command if result.rows is None else f"{result.command} {result.rows}")
    elif not result.columns:
        print("true" if result.count() else "false")
    else:
        result.show(50, truncate=False)


def main(args: list[str]) -> int:
    from pyspark.sql import SparkSession

    spark = SparkSession.builder.appName("twintongue").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    engine = Engine(spark)
    for path in args:
        with open(path) as f:
            for result in engine.run_script(f.read()):
                show(result)
    if args:
        return 0
    mode, text = "sql", ""
    while True:
        try:
            line = input(f"{mode}{'>' if not text else '.'} ")
        except EOFError:
            return 0
        word = line.strip().split()
        try:
            if not text and word[:1] == [".quit"]:
                return 0
            if not text and word[:1] in ([".sql"], [".datalog"]):
                mode = word[0][1:]
            elif not text and word[:1] == [".load"]:
                engine.register(word[1], spark.read.parquet(word[2]))
            else:
                text += line + "\n"
                if mode == "sql" and line.rstrip().endswith(";") or mode == "datalog" and not line.strip() and text.strip():
                    ready, text = text, ""
                    for r in [engine.datalog(ready)] if mode == "datalog" else engine.run_script(ready):
                        show(r)
        except (EngineError, Exception) as e:  # noqa: B014  the loop goes on after any error
            text = ""
            print(f"{type(e).__name__}: {str(e).splitlines()[0] if str(e) else ''}")


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
