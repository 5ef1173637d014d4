"""Interactive SQL shell: python -m gridloom.shell"""

from __future__ import annotations

import os
import re
import sys
import threading
import time
from contextlib import contextmanager

from pyspark.sql import SparkSession

from gridloom.engine import Engine

HISTORY = os.path.expanduser("~/.gridloom_history")
HELP = """Statements end with the line.
  CREATE EXTERNAL TABLE t STORED AS ZARR LOCATION 'path'   register a store (or PARQUET, CSV, JSON, ORC)
  DROP TABLE t                                             forget it
  SHOW TABLES, \\d                                         list tables
  DESCRIBE t                                               columns of a table
  SELECT ...                                               query
  EXPLAIN [ANALYZE | VERBOSE] SELECT ...                   plans
  help, quit, exit
Tab completes a line from the history."""
DDL = re.compile(r"^\s*(CREATE|DROP|ALTER)\b", re.I)
#: SQL words that are shown in colour.
KEYWORDS = "select from where group by order having limit offset join left right full inner outer on as and or not in between is null union all distinct case when then else end with recursive create external table stored location drop describe explain analyze verbose show over partition rows".split()


def coloured(text: str) -> str:
    """SQL with keywords, strings and numbers in colour."""
    def paint(m: re.Match) -> str:
        t = m[0]
        if t[0] == "'":
            return f"\x1b[32m{t}\x1b[0m"
        if t[0].isdigit():
            return f"\x1b[33m{t}\x1b[0m"
        return f"\x1b[34m{t}\x1b[0m" if t.lower() in KEYWORDS else t

    return re.sub(r"'[^']*'|\b\d+(?:\.\d+)?\b|\b[A-Za-z_]\w*\b", paint, text)


def hint(line: str, history: list[str]) -> str | None:
    """Rest of the newest history line that begins like this one (two characters at least, any case)."""
    if len(line) < 2:
        return None
    for old in reversed(history):
        if len(old) > len(line) and old.lower().startswith(line.lower()):
            return old[len(line) :]
    return None


@contextmanager
def ticker(out, text, every: float = 0.2):
    """Shows text() and the time behind a running statement, on terminals only."""
    if not out.isatty():
        yield
        return
    done, began = threading.Event(), time.perf_counter()

    def show() -> None:
        while not done.wait(every):
            out.write(f"\r\x1b[K{text()} · {time.perf_counter() - began:.1f} s")
            out.flush()

    thread = threading.Thread(target=show, daemon=True)
    thread.start()
    try:
        yield
    finally:
        done.set()
        thread.join()
        out.write("\r\x1b[K")


class Shell:
    def __init__(self, engine: Engine, out=sys.stdout):
        self.engine, self.out = engine, out

    def progress(self) -> str:
        """Tasks of the running stages."""
        tracker = self.engine.spark.sparkContext.statusTracker()
        stages = [s for s in map(tracker.getStageInfo, tracker.getActiveStageIds()) if s]
        return f"{sum(s.numCompletedTasks for s in stages)} of {sum(s.numTasks for s in stages)} tasks"

    def run(self, line: str) -> bool:
        """Runs a line; False ends the session."""
        line = line.strip()
        word = line.rstrip(";").lower()
        if not line:
            return True
        if word in ("quit", "exit"):
            return False
        if word == "help":
            print(HELP, file=self.out)
            return True
        if self.out.isatty():
            print(coloured(line), file=self.out)
        began = time.perf_counter()
        try:
            df = self.engine.sql(line)
            if DDL.match(line):
                print(f"OK ({time.perf_counter() - began:.3f} s)", file=self.out)
                return True
            with ticker(self.out, self.progress):
                rows = df.collect()
            io = self.engine.last_io
            io.seconds = time.perf_counter() - began
            print(table(df.columns, rows), file=self.out)
            print(io.line(len(rows)), file=self.out)
        except KeyboardInterrupt:
            print("cancelled", file=self.out)
        except Exception as e:  # a failed statement must not end the session
            print(f"Error: {str(e).splitlines()[0]}", file=self.out)
        return True


def table(columns: list[str], rows: list) -> str:
    cells = [[("NULL" if v is None else str(v)) for v in r] for r in rows]
    width = [max([len(c), *(len(r[k]) for r in cells)]) for k, c in enumerate(columns)]
    rule = "+" + "+".join("-" * (w + 2) for w in width) + "+"
    line = lambda r: "| " + " | ".join(v.ljust(w) for v, w in zip(r, width)) + " |"
    return "\n".join([rule, line(columns), rule, *map(line, cells), rule])


def main() -> None:
    spark = SparkSession.builder.appName("gridloom").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    shell = Shell(Engine(spark))
    try:
        import readline

        if os.path.exists(HISTORY):
            readline.read_history_file(HISTORY)
        past = lambda: [readline.get_history_item(k + 1) for k in range(readline.get_current_history_length())]
        readline.set_completer_delims("")
        readline.set_completer(lambda line, k: None if k or hint(line, past()) is None else line + hint(line, past()))
        readline.parse_and_bind("tab: complete")
    except ImportError:
        readline = None
    while True:
        try:
            if not shell.run(input("gridloom> ")):
                break
        except KeyboardInterrupt:
            print("^C")
        except EOFError:
            break
    if readline is not None:
        readline.write_history_file(HISTORY)


if __name__ == "__main__":
    main()
