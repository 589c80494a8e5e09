"""Calls of an external service that are not sent twice.

A service costs money and time, and tasks are run again when executors are lost. Each answered batch is therefore
written, before the next one is sent, as a file of its requests' bucket in a shared folder. A task
that runs again, or a later run, reads the files of its own buckets for the requests at hand and sends only those without an answer.
Two attempts of one task at the same time would not see each other: leave speculation off.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from segqa.plans.scale import materialize, skew_join
from segqa.sources.files import open_folder

Batch = Callable[[pd.DataFrame], pd.DataFrame]

# Seconds that a call may take, and how often it is made again after an error or a timeout.
TIMEOUT = 60.0
RETRIES = 1

REQUEST, BUCKET = "__request", "__bucket"
_ANSWERS = pa.schema([("request", pa.string()), ("answer", pa.string())])


def patient(call: Batch, timeout: float = TIMEOUT, retries: int = RETRIES) -> Batch:
    """``call`` with a limit of time, made again after an error or a timeout; the last error is raised."""

    def run(batch: pd.DataFrame) -> pd.DataFrame:
        for left in range(retries, -1, -1):
            # A call that hangs keeps its thread, not the task.
            pool = ThreadPoolExecutor(1)
            try:
                return pool.submit(call, batch).result(timeout)
            except Exception:
                if not left:
                    raise
            finally:
                pool.shutdown(wait=False)
        raise AssertionError

    return run


def _plain(value: Any) -> Any:
    if isinstance(value, np.ndarray):
        return value.tolist()
    if isinstance(value, np.generic):
        return value.item()
    return value.asDict(recursive=True) if hasattr(value, "asDict") else str(value)


def _rows(batch: pd.DataFrame) -> list[str]:
    """Rows as JSON; a missing value of a column is null, whatever pandas makes of it."""
    names = list(batch.columns)
    return [
        json.dumps({n: None if v is None or v is pd.NA or (isinstance(v, float) and v != v) else v for n, v in zip(names, row, strict=True)},
                   default=_plain, sort_keys=True)
        for row in batch.itertuples(index=False, name=None)
    ]


@dataclass(frozen=True)
class AnswerLog:
    """Answers of one service under ``root``. ``scope`` names what else an answer depends on, as model and prompt.

    Rows that agree in all columns but ``ids`` are one request.
    """

    root: str
    scope: str = ""
    ids: Sequence[str] = ("job_id", "segment_id")
    buckets: int = 256

    def request(self, rows: DataFrame) -> Column:
        asked = F.struct(*sorted(c for c in rows.columns if c not in self.ids))
        return F.sha2(F.concat(F.lit(f"{self.scope}\x1f"), F.to_json(asked, {"ignoreNullFields": "false"})), 256)

    def send_once(self, rows: DataFrame, send: Callable[[DataFrame], DataFrame], calls: int | None) -> DataFrame:
        """``rows`` with the columns that ``send`` adds to distinct requests, which go to tasks by bucket.

        Requests are reduced before they are shuffled, and answers go back to hot ones by salted join.
        """
        keyed = materialize(rows.withColumn(REQUEST, self.request(rows)))
        ids = [c for c in self.ids if c in rows.columns]
        one = F.min_by(F.struct(*rows.columns), F.struct(*ids)) if ids else F.any_value(F.struct(*rows.columns))
        asked = keyed.groupBy(REQUEST).agg(one.alias("r")).select("r.*", REQUEST, F.pmod(F.xxhash64(REQUEST), F.lit(self.buckets)).cast("int").alias(BUCKET))
        answered = send(asked.repartition(calls or self.buckets, BUCKET).sortWithinPartitions(BUCKET))
        added = [c for c in answered.columns if c not in asked.columns]
        answered = materialize(answered.select(REQUEST, *added))
        rest = keyed.drop(*added)
        return skew_join(rest, answered, [REQUEST], "left", spread_by=ids or [c for c in rest.columns if c != REQUEST]).drop(REQUEST)

    def _known(self, folder: fs.FileSystem, path: str, batch: pd.DataFrame) -> dict[str, str]:
        """Answers to the requests of a batch; no more is held than these and a file of one batch."""
        found: dict[str, str] = {}
        asked = pa.array(batch[REQUEST], pa.string())
        for bucket in sorted(set(batch[BUCKET])):
            for file in folder.get_file_info(fs.FileSelector(f"{path}/bucket={bucket}", allow_not_found=True)):
                if file.path.endswith(".parquet"):
                    with folder.open_input_file(file.path) as stream:
                        rows = pq.ParquetFile(stream).read()
                    rows = rows.filter(pc.is_in(rows["request"], asked))
                    found.update(zip(rows["request"].to_pylist(), rows["answer"].to_pylist(), strict=True))
        return found

    def keep(self, call: Batch) -> Batch:
        """``call`` for the requests of a batch that have no answer yet; new answers are written before it returns."""

        def run(batch: pd.DataFrame) -> pd.DataFrame:
            folder, path = open_folder(self.root)
            answers = self._known(folder, path, batch)
            new = batch[~batch[REQUEST].isin(list(answers))].reset_index(drop=True)
            if len(new):
                result = call(new.drop(columns=[REQUEST, BUCKET]))
                if len(result) != len(new):
                    raise ValueError("a client must return one row per input row")
                made = pd.DataFrame({"request": new[REQUEST], "answer": _rows(result)})
                for bucket, rows in made.groupby(new[BUCKET]):
                    folder.create_dir(f"{path}/bucket={bucket}", recursive=True)
                    # Seen under its last name only when it is whole.
                    name = f"{path}/bucket={bucket}/{uuid.uuid4().hex}"
                    with folder.open_output_stream(f"{name}.part") as out:
                        pq.write_table(pa.Table.from_pandas(rows, _ANSWERS, preserve_index=False), out)
                    folder.move(f"{name}.part", f"{name}.parquet")
                answers.update(zip(made["request"], made["answer"], strict=True))
            return pd.DataFrame([json.loads(answers[r]) for r in batch[REQUEST]])

        return run
