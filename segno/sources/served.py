"""Rows answered by a program that reads a JSON line and writes one: one process a partition, started once."""

from __future__ import annotations

import json
import subprocess
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

from segno.shipping import ship_package

ANSWER = "task_id string, ok boolean, body string, error string"
DIED = "subprocess_died"


def served(tasks: DataFrame, command: list[str], config: dict | None = None) -> DataFrame:
    """(task_id, ok, body, error) for each task of (task_id, request), where a request is a JSON text.

    The program gets the configuration as its first line, then a request a line, and writes an answer a
    line. One that ends leaves its open task, and those behind it, with an error of their own; a lost
    partition is asked again from the start.
    """

    ship_package(tasks.sparkSession)

    def ask(process: subprocess.Popen, request: str) -> str:
        try:
            process.stdin.write(request + "\n")
            process.stdin.flush()
        except (BrokenPipeError, ValueError):
            return ""
        return process.stdout.readline()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        process = subprocess.Popen(command, stdin=subprocess.PIPE, stdout=subprocess.PIPE, stderr=subprocess.DEVNULL, text=True)
        try:
            if config is not None:
                process.stdin.write(json.dumps(config) + "\n")
            for batch in batches:
                rows = []
                for task, request in zip(batch["task_id"], batch["request"], strict=True):
                    line = ask(process, " ".join(str(request).splitlines()))
                    try:
                        answer = json.loads(line) if line else {"ok": False, "error": DIED}
                    except json.JSONDecodeError:
                        answer = {"ok": False, "error": f"not an answer: {line.strip()}"}
                    rows.append((task, bool(answer.get("ok")), json.dumps(answer, sort_keys=True), answer.get("error")))
                yield pd.DataFrame(rows, columns=["task_id", "ok", "body", "error"])
        finally:
            process.kill()
            process.wait()

    return tasks.select("task_id", "request").mapInPandas(run, ANSWER)
