"""Seams for recognizers and language models: partitions of pages or prompts go through a
backend that is made once a worker, and only where there is a row. The stand-ins here are
deterministic; real models are plugged in by the caller."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from typing import Any, Protocol

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type


class Reader(Protocol):
    """A recognizer: boxes of a page, and the text of a crop."""

    def detect(self, path: str) -> list[dict[str, Any]]: ...

    def recognize(self, path: str) -> dict[str, Any]: ...


class Selector(Protocol):
    """A language model: a prompt's raw reply and its state."""

    def __call__(self, prompt: str) -> dict[str, Any]: ...


def run_backend(rows: DataFrame, make: Callable[[], Any], call: Callable[[Any, dict], dict], schema: T.StructType) -> DataFrame:
    """Each row through `call(backend, row)`. A row that fails gets status `error` and its
    message, and the rest goes on; a backend that can't be made ends the job."""
    arrow = to_arrow_type(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        backend = None
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                backend = backend if backend is not None else make()
                try:
                    out.append({f.name: None for f in schema} | call(backend, row))
                except Exception as e:  # noqa: BLE001
                    out.append({f.name: row.get(f.name) for f in schema} | {"status": "error", "error": f"{type(e).__name__}: {e}"})
            yield pa.RecordBatch.from_struct_array(pa.array(out, arrow))

    return rows.mapInArrow(run, schema)


class FirstChoice:
    """A selector that takes the first candidate of every span, for tests and dry runs."""

    def __call__(self, prompt: str) -> dict[str, Any]:
        plan = json.loads(prompt[prompt.index("{") :])
        choices = [{"span_id": s["id"], "candidate_id": s["candidates"][0]["id"]} for s in plan["spans"]]
        return {"raw": json.dumps({"choices": choices, "proposals": []}), "status": "ok"}
