"""Outside tools as injected callables: a layout model, OCR, a cloud parser. None runs unless one is given."""

from __future__ import annotations

import subprocess
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame


def run_command(command: list[str], data: bytes) -> str:
    """A tool that reads a file's bytes on stdin and prints JSON; a failure carries its stderr."""
    done = subprocess.run(command, input=data, capture_output=True)
    if done.returncode:
        raise RuntimeError(f"{command[0]} failed: {done.stderr.decode(errors='replace')[-500:]}")
    return done.stdout.decode()


def apply_tool(files: DataFrame, tool: Callable[[bytes], str]) -> DataFrame:
    """doc and json for each file (doc, content). Filter pages or files before: the planner can't see into the tool."""

    def run(batches):
        for pdf in batches:
            yield pd.DataFrame({"doc": pdf.doc, "json": [tool(bytes(x)) for x in pdf.content]})

    return files.select("doc", "content").mapInPandas(run, "doc string, json string")
