"""A10: a store of finished stages, so that a run after a failed one goes on where that one stopped.

A stage's key is a digest of its name, its parameters and the keys of what it reads (for files: their names, sizes and times). Its
rows are written to a folder of their own; only when they are complete a manifest is put beside them by a rename. A stage
is restored if its manifest is there and the folder still holds the bytes and files it lists; anything else (a half-written folder, a
damaged one, other parameters or inputs) counts as not there and is built anew, in a new folder.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import ensure_checkpoint_dir


def listing(spark: SparkSession, path: str) -> dict:
    """Files below ``path``: how many, their bytes, and a digest of names, sizes and times. Lists, reads no content."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length", "modificationTime")
    mark = F.xxhash64("path", "length", F.col("modificationTime").cast("double"))
    row = files.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("length"), F.lit(0)).alias("bytes"),
                    F.coalesce(F.bit_xor(mark), F.lit(0)).alias("digest")).first()
    return {"files": row["n"], "bytes": row["bytes"], "digest": f"{row['digest'] & (2**64 - 1):016x}"}


def source_key(spark: SparkSession, path: str) -> str:
    """Key of an input that lies in files."""
    return json.dumps(listing(spark, path), sort_keys=True)


def stage_key(name: str, parents: Sequence[str], params: dict) -> str:
    text = json.dumps([name, list(parents), params], sort_keys=True, default=str)
    return hashlib.sha256(text.encode()).hexdigest()[:24]


@dataclass
class Stage:
    name: str
    key: str
    rows: DataFrame
    restored: bool


class StageStore:
    """Stages below ``root``; by default a folder in the shared checkpoint folder."""

    def __init__(self, spark: SparkSession, root: str | None = None):
        self.spark = spark
        self.root = (root or f"{ensure_checkpoint_dir(spark).rstrip('/')}/tabsmith/stages").rstrip("/")

    def _path(self, text: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(text)
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def manifest(self, name: str, key: str) -> dict | None:
        """The manifest of a finished, undamaged stage."""
        place = f"{self.root}/{name}/{key}/manifest.json"
        fs, path = self._path(place)
        if not fs.exists(path):
            return None
        found = json.loads("\n".join(r["value"] for r in self.spark.read.text(place).collect()))  # a file of our own, one line
        folder, data = self._path(found["data"])
        return found if folder.exists(data) and listing(self.spark, found["data"]) == found["listing"] else None

    def stage(self, name: str, build: Callable[[], DataFrame], parents: Sequence[str] = (), params: dict | None = None) -> Stage:
        """The stage's rows: restored if they are there, else built, written and read back."""
        key = stage_key(name, parents, params or {})
        known = self.manifest(name, key)
        if known is None:
            known = self._write(name, key, build(), list(parents), params or {})
            restored = False
        else:
            restored = True
        schema = T.StructType.fromJson(json.loads(known["schema"]))
        return Stage(name, key, self.spark.read.schema(schema).parquet(known["data"]), restored)

    def _write(self, name: str, key: str, df: DataFrame, parents: list[str], params: dict) -> dict:
        home = f"{self.root}/{name}/{key}"
        data = f"{home}/data-{uuid.uuid4().hex[:12]}"
        df.write.parquet(data)
        found = {"stage": name, "key": key, "parents": parents, "params": params, "data": data, "schema": df.schema.json(),
                 "listing": listing(self.spark, data)}
        draft = f"{home}/draft-{uuid.uuid4().hex[:12]}"
        fs, path = self._path(draft)
        out = fs.create(path)
        out.write(json.dumps(found, default=str).encode())
        out.close()
        _, final = self._path(f"{home}/manifest.json")
        if fs.exists(final):  # of a damaged stage, or of another run that was faster: either way this one is complete
            fs.delete(final, False)
        if not fs.rename(path, final):
            raise OSError(f"could not publish {final}")
        return found


def run_stages(store: StageStore, source: DataFrame, key: str, steps: Sequence[tuple[str, Callable[[DataFrame], DataFrame], dict]]) -> list[Stage]:
    """Run (name, step, parameters) one after another on ``source`` (whose key is ``key``); finished ones are restored. A step is
    known by its name and parameters, so a changed step needs another name or parameter."""
    done, rows = [], source
    for name, step, params in steps:
        before = rows
        stage = store.stage(name, lambda step=step, before=before: step(before), [key], params)
        done.append(stage)
        rows, key = stage.rows, stage.key
    return done
