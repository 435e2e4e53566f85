"""An interactive shell: statements end with ';', EXIT or QUIT leaves."""

from __future__ import annotations

import sys

from pyspark.errors import PySparkException
from pyspark.sql import SparkSession

from .catalogue import TABLES
from .errors import EngineError
from .session import Session
from .sources.printing import show


def repl(session: Session, read=input, write=print) -> None:
    text = ""
    while True:
        try:
            line = read("CMD> " if not text else "  -> ")
        except (EOFError, KeyboardInterrupt):
            return
        if not text and line.strip().rstrip(";").upper() in ("EXIT", "QUIT"):
            return
        text += line + "\n"
        if not text.strip():
            text = ""
        elif text.rstrip().endswith(";"):
            try:
                for result in session.script(text):
                    if result is not None:
                        write(show(result))
            except (EngineError, PySparkException) as error:
                write(f"{type(error).__name__}: {error}")
            text = ""


if __name__ == "__main__":
    spark = SparkSession.builder.appName("tidewater").getOrCreate()
    directory = sys.argv[1] if len(sys.argv) > 1 else None
    repl(Session(spark, directory=directory, names=TABLES if directory else ()))
