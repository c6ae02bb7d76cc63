"""The chunk index: what changed, new rows, one atomic swap.

``kb`` has ``id, kb_path, chunk_index, source_kind, text, char_start, char_end, headings, image_path, token_estimate,
content_hash, metadata, vector, indexed_at``; ``manifest`` has ``kb_path, content_hash, bytes, mtime, chunk_count,
source_kind, indexed_at``.
"""

from __future__ import annotations

import hashlib
import os
import uuid
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loam.functions.text import chunk_id, heading_prefix, rough_tokens
from loam.operators.calls import read_text, tried
from loam.operators.chunking import chunked
from loam.session import staged

DIM = 64


def latest(manifest: DataFrame) -> DataFrame:
    """The last row of each path: by time, then hash."""
    newest = F.row_number().over(Window.partitionBy("kb_path").orderBy(F.desc_nulls_last("indexed_at"), F.desc_nulls_last("content_hash")))
    return manifest.withColumn("__n", newest).where(F.col("__n") == 1).drop("__n")


def manifest_diff(candidates: DataFrame, manifest: DataFrame, prune: bool = False) -> DataFrame:
    """``(kb_path, content_hash, state)``: new, changed or unchanged; with ``prune`` also removed paths."""
    old = latest(manifest).select("kb_path", F.col("content_hash").alias("__old"))
    new = candidates.select("kb_path", "content_hash").dropDuplicates(["kb_path"])
    both = new.join(old, "kb_path", "full_outer" if prune else "left")
    state = (
        F.when(F.col("content_hash").isNull() & F.col("__old").isNotNull(), "removed").when(F.col("__old").isNull(), "new")
        .when(F.col("__old") == F.col("content_hash"), "unchanged").otherwise("changed")
    )
    return both.select("kb_path", F.coalesce("content_hash", "__old").alias("content_hash"), state.alias("state"))


def stub_vector(text: str, dim: int = DIM) -> list[float]:
    """The offline stand-in for an embedding: a unit vector that depends on the text's words only."""
    out = np.zeros(dim)
    for word in text.lower().split():
        h = hashlib.blake2b(word.encode(), digest_size=8).digest()
        out[h[0] % dim] += 1 if h[1] % 2 else -1
    norm = np.linalg.norm(out)
    return (out / norm if norm else out).tolist()


def embedded(text: Column, embed: Callable[[list[str]], list[list[float]]] | None = None) -> Column:
    """Vectors of a text column; an Arrow batch is the embedding batch. A length that drifts is an error."""

    def run(texts: pd.Series) -> pd.Series:
        vectors = embed(list(texts)) if embed else [stub_vector(t or "") for t in texts]
        if len({len(v) for v in vectors}) > 1:
            raise ValueError("embedding length drifts within a batch")
        return pd.Series(vectors, dtype=object)

    return F.pandas_udf(run, "array<float>")(text)


def index_rows(files: DataFrame, model: str, target: int = 500, overlap: int = 60, embed=None, now: Column | None = None) -> DataFrame:
    """Index rows of ``files(kb_path, source_kind, text, content_hash)``; images carry their description as text."""
    texts = files.where(F.col("source_kind") != "image")
    pieces = chunked(texts, target=target, overlap=overlap, keep=("content_hash",))
    images = files.where(F.col("source_kind") == "image").select(
        "kb_path", "source_kind", F.lit(0).alias("chunk_index"), "text", F.lit(0).alias("char_start"), F.lit(0).alias("char_end"),
        F.array().cast("array<string>").alias("headings"), rough_tokens(F.coalesce("text", F.lit(""))).alias("token_estimate"), "content_hash",
    )
    rows = pieces.unionByName(images)
    prefixed = heading_prefix(F.col("text"), F.col("headings"))
    metadata = F.to_json(F.struct(F.lit(model).alias("embed_model"), F.col("headings").alias("headings")))
    return rows.withColumn("text", prefixed).select(
        chunk_id(F.col("kb_path"), F.col("chunk_index"), F.col("content_hash")).alias("id"), "kb_path", "chunk_index", "source_kind", "text",
        F.col("char_start").cast("long").alias("char_start"), F.col("char_end").cast("long").alias("char_end"), "headings",
        F.when(F.col("source_kind") == "image", F.col("kb_path")).alias("image_path"), rough_tokens(F.col("text")).alias("token_estimate"), "content_hash",
        metadata.alias("metadata"), embedded(F.col("text"), embed).alias("vector"), (now if now is not None else F.current_timestamp()).alias("indexed_at"),
    )


def upserted(existing: DataFrame, fresh: DataFrame, diff: DataFrame) -> DataFrame:
    """The table after a run: rows of changed and removed paths go, fresh rows come, all others stay as they are."""
    touched = diff.where(F.col("state").isin("changed", "removed", "new")).select("kb_path")
    return existing.join(touched, "kb_path", "left_anti").unionByName(fresh)


def manifest_rows(files: DataFrame, rows: DataFrame, now: Column | None = None) -> DataFrame:
    """Manifest rows of indexed files; one that gave no chunk counts 0."""
    counts = rows.groupBy("kb_path").agg(F.count(F.lit(1)).cast("int").alias("chunk_count"))
    stamped = (now if now is not None else F.current_timestamp()).alias("indexed_at")
    return files.join(counts, "kb_path", "left").select("kb_path", "content_hash", "bytes", "mtime", F.coalesce("chunk_count", F.lit(0)).alias("chunk_count"), "source_kind", stamped)


class IndexStore:
    """Two Parquet tables under one folder. Each version has a folder of its own and counts once its mark is there.

    A mark is one small file whose name says it all, ``DONE-<number>-<version>``; the greatest number is the current
    version. Nothing is renamed or deleted, so a crash at any time leaves the version before.
    """

    TABLES = ("kb", "manifest")

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")
        path = spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        self.fs = path.getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, *parts: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path("/".join([self.folder, *parts]))

    def _marks(self) -> list[str]:
        if not self.fs.exists(self._path()):
            return []
        return sorted(s.getPath().getName() for s in self.fs.listStatus(self._path()) if s.getPath().getName().startswith("DONE-"))

    def _mark(self, version: str) -> None:
        marks = self._marks()
        number = int(marks[-1].split("-")[1]) + 1 if marks else 1
        self.fs.create(self._path(f"DONE-{number:012d}-{version}"), False).close()

    def version(self) -> str | None:
        marks = self._marks()
        name = marks[-1].split("-", 2)[2] if marks else ""
        return name if name.startswith("v-") else None

    def read(self, table: str) -> DataFrame | None:
        version = self.version()
        return None if version is None else self.spark.read.parquet(f"{self.folder}/{version}/{table}")

    def write(self, kb: DataFrame, manifest: DataFrame) -> str:
        """Both tables or neither."""
        version = f"v-{uuid.uuid4().hex}"
        kb.write.parquet(f"{self.folder}/{version}/kb")
        manifest.write.parquet(f"{self.folder}/{version}/manifest")
        self._mark(version)
        return version

    def drop(self) -> None:
        self._mark("none")


def run_index(store: IndexStore, files: DataFrame, model: str, prune: bool = False, recreate: bool = False, **options) -> dict[str, int]:
    """One incremental run: unchanged files are neither chunked nor embedded; the swap is atomic."""
    if recreate:
        store.drop()
    old_kb, old_manifest = store.read("kb"), store.read("manifest")
    if old_kb is None:
        rows = staged(index_rows(files, model, **options), "rows")  # feeds both tables
        store.write(rows, manifest_rows(files, rows))
        return {"new": files.count(), "changed": 0, "unchanged": 0, "removed": 0}
    check_model(old_kb, model)
    diff = manifest_diff(files, old_manifest, prune)
    counts = {r["state"]: r["n"] for r in diff.groupBy("state").agg(F.count(F.lit(1)).alias("n")).collect()}
    if counts.get("new", 0) + counts.get("changed", 0) + counts.get("removed", 0):
        todo = files.join(diff.where(F.col("state").isin("new", "changed")).select("kb_path"), "kb_path", "left_semi")
        rows = staged(index_rows(todo, model, **options), "rows")
        store.write(upserted(old_kb, rows, diff), upserted(old_manifest, manifest_rows(todo, rows), diff))
    return {s: counts.get(s, 0) for s in ("new", "changed", "unchanged", "removed")}


def model_stamps(kb: DataFrame) -> DataFrame:
    """``(embed_model, vectors, lengths)`` of an index, from all its rows."""
    return kb.groupBy(F.get_json_object("metadata", "$.embed_model").alias("embed_model")).agg(F.count(F.lit(1)).alias("rows"), F.array_sort(F.collect_set(F.size("vector"))).alias("lengths"))


def check_model(kb: DataFrame, model: str, allow: bool = False) -> None:
    """An index built with another model cannot be searched with this one."""
    found = [r["embed_model"] for r in model_stamps(kb).limit(10).collect()]
    if any(m != model for m in found) and not allow:
        raise ValueError(f"the index was built with {found}, not with {model!r}")


def described(paths: Column, describe: Callable[[str], str] | None = None, retries: int = 2) -> Column:
    """``struct<text,error>`` of images; offline, the file name's words. A model's failures and empty replies are tried again."""

    def one(path: str) -> tuple[str | None, str | None]:
        if describe is None:
            return os.path.splitext(os.path.basename(path or ""))[0].replace("-", " "), None
        text, wrong = tried(lambda: describe(path), read_text, retries)
        return text, wrong or None

    def run(values: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([one(v) for v in values], columns=["text", "error"])

    return F.pandas_udf(run, "struct<text:string,error:string>")(paths)
