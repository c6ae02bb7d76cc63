"""Knowledge-base files: the walk, folder scans, sidecars, artefacts, evaluation CSVs, configuration."""

from __future__ import annotations

import csv
import io
import json
import os
import re
import tempfile
import tomllib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field, fields
from string import Template
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loam.functions.text import source_kind
from loam.session import staged

ASSETS, ARTEFACT, SIDECAR = "assets", "compiled.md", ".crawl.json"
MARKER = "<!-- LOAM:COMPILED -->"
CATALOG = ("<!-- LOAM:CATALOG BEGIN -->", "<!-- LOAM:CATALOG END -->")
CONTENT = ("<!-- LOAM:CONTENT BEGIN -->", "<!-- LOAM:CONTENT END -->")
EVAL_COLUMNS = ("question_id", "kind", "persona", "question", "expected_answer", "source", "actual_answer", "score", "remark", "turns", "transcript")
EVAL_OPTIONAL = ("source", "persona", "turns", "transcript")
SET_COLUMNS = EVAL_COLUMNS[:9]
PERSONA_COLUMNS = ("persona_id", "persona_name", "persona_description", "topics")


# --- files


LISTED = "folder string, name string, is_folder boolean"


def listed(folders: DataFrame, root: str) -> DataFrame:
    """``(folder, name, is_folder)`` of what is directly in ``folders(folder)`` under a root that all workers reach."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for folder in batch["folder"]:
                entries = list(os.scandir(os.path.join(root, folder)))
                artefact = any(e.name == ARTEFACT for e in entries)
                out += [(folder, e.name, e.is_dir()) for e in entries if not (artefact and e.is_dir() and e.name == ASSETS)]
            yield pd.DataFrame(out, columns=["folder", "name", "is_folder"]).astype({"is_folder": bool})

    return folders.select("folder").mapInPandas(run, LISTED)


def walk(spark: SparkSession, root: str, images: bool = True, content: bool = True) -> DataFrame:
    """``(kb_path, source_kind, bytes, mtime, content, walk_key)`` of the files to index.

    Folders are listed by the workers, level by level, each level a table in the shared folder. Hidden and underscored
    names, which Spark's own listing passes over, are listed too. ``assets`` beside an artefact and artefacts themselves
    are left out. ``walk_key`` orders files of a folder before its subfolders.
    """
    level = spark.createDataFrame([("",)], "folder string")
    found = None
    while True:
        here = staged(listed(level, root), "listed")
        found = here if found is None else found.unionByName(here)
        full = F.when(F.col("folder") == "", F.col("name")).otherwise(F.concat_ws("/", "folder", "name"))
        level = here.where("is_folder").select(full.alias("folder")).repartition(spark.sparkContext.defaultParallelism)
        if level.isEmpty():
            break
    rows = found.where(~F.col("is_folder") & ~F.col("name").isin(ARTEFACT, SIDECAR)).select(full.alias("kb_path"))
    rows = rows.withColumn("source_kind", source_kind(F.col("kb_path"))).where(F.col("source_kind").isNotNull())
    if not images:
        rows = rows.where(F.col("source_kind") != "image")
    rows = rows.withColumn("walk_key", walk_key(F.col("kb_path")))

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for whole in batches:
            for k in range(0, len(whole), 100):  # files in memory at a time
                batch = whole.iloc[k : k + 100]
                stats = [os.stat(os.path.join(root, p)) for p in batch["kb_path"]]
                data = [open(os.path.join(root, p), "rb").read() if content else None for p in batch["kb_path"]]
                yield batch.assign(bytes=[s.st_size for s in stats], mtime=[s.st_mtime for s in stats], content=pd.Series(data, dtype=object, index=batch.index))

    return rows.mapInPandas(read, "kb_path string, source_kind string, walk_key array<string>, bytes long, mtime double, content binary")


def files_of(spark: SparkSession, glob: str, root: str) -> DataFrame:
    """The same from any file system through Spark's binary source; names that start with ``_`` or ``.`` are not seen there."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(glob)
    path = F.regexp_replace("path", rf"^.*?\Q{root.strip('/')}\E/", "")
    rows = raw.select(path.alias("kb_path"), source_kind(path).alias("source_kind"), F.col("length").alias("bytes"), (F.unix_micros("modificationTime") / 1e6).alias("mtime"), "content")
    return rows.where(F.col("source_kind").isNotNull() & ~F.endswith("kb_path", F.lit(f"/{ARTEFACT}")) & (F.col("kb_path") != ARTEFACT))


def walk_key(path: Column) -> Column:
    """Sort key of a walk: at each level files come before folders, then by name."""
    parts = F.split(path, "/")
    return F.transform(parts, lambda p, i: F.concat(F.when(i == F.size(parts) - 1, "0").otherwise("1"), p))


def pruned_assets(files: DataFrame) -> DataFrame:
    """Files outside ``assets`` folders that stand beside an artefact; ``files(kb_path, name …)`` lists artefacts too."""
    artefacts = files.where(F.col("kb_path").rlike(rf"(?:^|/)\Q{ARTEFACT}\E$")).select(F.regexp_replace("kb_path", rf"\Q{ARTEFACT}\E$", ASSETS + "/").alias("dir"))
    inside = files.withColumn("dir", F.regexp_extract("kb_path", rf"^((?:.*/)?{ASSETS}/)", 1))
    return inside.join(artefacts.distinct(), "dir", "left_anti").drop("dir")


def text_of(files: DataFrame, html: Column | None = None, pdf: Callable[[bytes], str] | None = None) -> DataFrame:
    """Files with ``text``: UTF-8 with replacement for Markdown and text, converted HTML, PDF through an injected reader."""

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from loam.functions.html import convert

        for batch in batches:
            out = []
            for kind, content in zip(batch["source_kind"], batch["content"]):
                data = bytes(content) if content is not None else b""
                if kind == "pdf":
                    out.append(pdf(data) if pdf else None)
                elif kind == "image":
                    out.append(None)
                else:
                    text = data.decode("utf-8", "replace")
                    out.append(convert(text)["markdown"] if kind == "html" else text)
            yield batch[["kb_path"]].assign(text=pd.Series(out, dtype=object, index=batch.index))

    texts = files.select("kb_path", "source_kind", "content").mapInPandas(decode, "kb_path string, text string")
    return files.join(texts, "kb_path")


def pdf_sections(pages: DataFrame) -> DataFrame:
    """``(kb_path, text)`` of ``pages(kb_path, page, text)``: one section per page."""
    block = F.concat(F.lit("## Page "), F.col("page").cast("string"), F.lit("\n\n"), F.trim("text"))
    rows = F.array_sort(F.collect_list(F.struct("page", block.alias("b"))))
    return pages.groupBy("kb_path").agg(F.array_join(F.transform(rows, lambda x: x["b"]), "\n\n").alias("text"))


def first_images(images: DataFrame) -> DataFrame:
    """Each distinct image content of a document once, at its first page: ``images(kb_path, page, name, content)``."""
    from pyspark.sql import Window

    n = F.row_number().over(Window.partitionBy("kb_path", F.md5("content")).orderBy("page", "name"))
    return images.withColumn("__n", n).where(F.col("__n") == 1).drop("__n")


def fetched(urls: DataFrame, get: Callable[[str], tuple[str, int, str, bytes]], attempts: int = 3) -> DataFrame:
    """``(url, final_url, status, content_type, content, error)`` through an injected client; 429 and 503 and transport errors are tried again."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for url in batch["url"]:
                row: tuple = (url, None, None, None, None, "unreachable")
                for _ in range(attempts):
                    try:
                        final, status, kind, content = get(url)
                    except Exception as error:  # noqa: BLE001 - reported per page
                        row = (url, None, None, None, None, f"{type(error).__name__}: {error}")
                        continue
                    row = (url, final, status, kind, content, None if status < 400 else f"http_{status}")
                    if status not in (429, 503):
                        break
                out.append(row)
            frame = pd.DataFrame(out, columns=["url", "final_url", "status", "content_type", "content", "error"])
            yield frame.astype({"status": "Int64", "final_url": object, "content_type": object, "content": object, "error": object})

    return urls.select("url").mapInPandas(run, "url string, final_url string, status int, content_type string, content binary, error string")


# --- artefacts and sidecars


@dataclass
class FrontMatter:
    id: str = ""
    title: str = ""
    long_description: str = ""
    token_size_estimate: int = 0
    kind: str = "leaf"
    source_files: list[str] = field(default_factory=list)
    source_urls: list[str] = field(default_factory=list)
    image_urls: dict[str, str] = field(default_factory=dict)
    children: list[str] = field(default_factory=list)
    descendants: int = 0
    subtree_depth: int = 0
    content_token_estimate: int = 0
    catalog_token_estimate: int = 0


FRONT_MATTER = (
    "id string, title string, long_description string, token_size_estimate long, kind string, source_files array<string>, source_urls array<string>, image_urls map<string,string>, "
    "children array<string>, descendants long, subtree_depth long, content_token_estimate long, catalog_token_estimate long"
)


def compiled_text(matter: Column, catalog: Column, content: Column) -> Column:
    """An artefact: marker, front matter (JSON is YAML), the root's catalog, the content."""
    sections = F.concat_ws(
        "\n\n", F.when(F.coalesce(catalog, F.lit("")) != "", F.concat(F.lit(CATALOG[0] + "\n## Catalog\n\n"), catalog, F.lit(CATALOG[1]))), F.concat(F.lit(CONTENT[0] + "\n## Content\n\n"), content, F.lit("\n" + CONTENT[1]))
    )
    return F.concat(F.lit(MARKER + "\n---\n"), F.to_json(matter), F.lit("\n---\n\n"), sections, F.lit("\n"))


def front_matter(text: Column) -> Column:
    """The struct of an artefact's front matter, in JSON or YAML; null without one."""

    def run(texts: pd.Series) -> pd.DataFrame:
        import yaml

        names = [f.name for f in fields(FrontMatter)]
        out = []
        for text in texts:
            m = re.search(r"\A(?:<!--[^\n]*-->\s*\n)?---\s*\n(.*?)\n---\s*(?:\n|\Z)", text or "", re.S)
            try:
                raw = yaml.safe_load(m.group(1)) if m else None
            except yaml.YAMLError:
                raw = None
            if not isinstance(raw, dict):
                out.append({n: None for n in names})
                continue
            matter = FrontMatter(**{k: v for k, v in raw.items() if k in names and v is not None})
            matter.kind = matter.kind if matter.kind in ("leaf", "node", "mixed") else "leaf"
            if "content_token_estimate" not in raw:
                matter.content_token_estimate = matter.token_size_estimate
            out.append({n: getattr(matter, n) for n in names})
        return pd.DataFrame(out, columns=names).astype({n: "Int64" for n in ("token_size_estimate", "descendants", "subtree_depth", "content_token_estimate", "catalog_token_estimate")})

    return F.pandas_udf(run, FRONT_MATTER)(text)


def sidecar_of(text: Column) -> Column:
    """A sidecar's struct; anything malformed is null and stops nothing."""
    sound = F.from_json(text, "map<string,string>").isNotNull()
    return F.when(sound, F.from_json(text, "source_url string, link_order array<string>, documents map<string,string>, images map<string,string>"))


def packet_scan(artefacts: DataFrame, least: int = 120) -> DataFrame:
    """``(path, id, title, body, paragraphs)`` of artefacts with front matter, an id and a paragraph, in path order."""
    from loam.functions.markdown import paragraphs, section, without_front_matter

    rows = artefacts.withColumn("m", front_matter(F.col("text"))).where(F.coalesce(F.col("m.id"), F.lit("")) != "")
    body = section(without_front_matter(F.col("text"), MARKER), "Content", *CONTENT)
    rows = rows.select("path", F.col("m.id").alias("id"), F.col("m.title").alias("title"), body.alias("body"), F.col("m.source_urls").alias("source_urls"))
    return rows.withColumn("paragraphs", paragraphs(F.col("body"), least)).where(F.size("paragraphs") > 0)


def write_files(rows: DataFrame, root: str, path: str = "path", text: str = "text") -> int:
    """Text rows as files under a folder all workers reach; each is written beside its place and renamed."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for p, t in zip(batch["p"], batch["t"]):
                target = os.path.join(root, p)
                os.makedirs(os.path.dirname(target), exist_ok=True)
                with tempfile.NamedTemporaryFile("w", dir=os.path.dirname(target), delete=False, encoding="utf-8", newline="") as f:
                    f.write(t or "")
                os.replace(f.name, target)
            yield pd.DataFrame({"n": [len(batch)]})

    return rows.select(F.col(path).alias("p"), F.col(text).alias("t")).mapInPandas(run, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


# --- evaluation files: one file each, so one task each


def read_eval_csv(spark: SparkSession, path: str) -> DataFrame:
    """Rows with ``pos`` in file order, addressed by header; a byte-order mark, quotes and line breaks inside fields are fine.

    Rows without an id are dropped; a score or turn count that is no integer is null; missing required columns are an
    error. The file is read by one task, since a line break may stand in a field; nothing passes through the driver.
    """
    reader = spark.read.option("header", True).option("multiLine", True).option("escape", '"').option("maxCharsPerColumn", -1).option("nullValue", "\u0000").option("emptyValue", "")
    raw = reader.option("inferSchema", False).csv(path)
    raw = raw.toDF(*[c.lstrip("\ufeff") for c in raw.columns])
    missing = [c for c in EVAL_COLUMNS if c not in EVAL_OPTIONAL and c not in raw.columns]
    if missing:
        raise ValueError(f"{path}: no column {', '.join(missing)}")
    number = lambda c: F.when(F.col(c).rlike(r"^\s*[+-]?\d+\s*$"), F.trim(F.col(c)).try_cast("int"))
    text = lambda c: F.coalesce(F.col(c), F.lit("")) if c in raw.columns else F.lit("")
    columns = [(number(c) if c in raw.columns else F.lit(None).cast("int")).alias(c) if c in ("score", "turns") else text(c).alias(c) for c in EVAL_COLUMNS]
    rows = raw.withColumn("__at", F.monotonically_increasing_id()).where(F.trim(text("question_id")) != "").select("__at", *columns)
    return rows.withColumn("pos", (F.row_number().over(Window.orderBy("__at")) - 1).cast("long")).select("pos", *EVAL_COLUMNS)


def write_eval_csv(rows: DataFrame, path: str, columns: tuple[str, ...] = EVAL_COLUMNS) -> int:
    """One file in ``pos`` order with a byte-order mark and LF line ends, in place at once or not at all.

    One task streams the sorted rows into the file, in a folder that all workers reach.
    """
    folder = os.path.dirname(os.path.abspath(path))
    present = [c for c in columns if c in rows.columns]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        count = 0
        with tempfile.NamedTemporaryFile("w", dir=folder, delete=False, encoding="utf-8-sig", newline="") as f:
            out = csv.writer(f, lineterminator="\n")
            out.writerow(columns)
            for batch in batches:
                for record in batch.astype(object).to_dict("records"):
                    out.writerow([("" if c not in present or pd.isna(record[c]) else int(record[c]) if c in ("score", "turns") else record[c]) for c in columns])
                count += len(batch)
        os.replace(f.name, path)
        yield pd.DataFrame({"n": [count]})

    return rows.select("pos", *[c for c in present if c != "pos"]).repartition(1).sortWithinPartitions("pos").mapInPandas(run, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def read_personas(spark: SparkSession, path: str) -> DataFrame:
    """A roster with ``pos``; bad or repeated ids and blank fields stop the run, all named in one error."""
    with open(path, encoding="utf-8-sig", newline="") as f:
        reader = csv.DictReader(f)
        missing = [c for c in PERSONA_COLUMNS[:3] if c not in (reader.fieldnames or [])]
        if missing:
            raise ValueError(f"{path}: no column {', '.join(missing)}")
        rows, wrong, seen = [], [], set()
        for n, r in enumerate(reader, 2):
            id_ = (r["persona_id"] or "").strip()
            if not re.fullmatch(r"[a-z0-9][a-z0-9_-]*", id_) or id_ in seen:
                wrong.append(f"line {n}: id {id_!r}")
            wrong += [f"line {n}: blank {c}" for c in PERSONA_COLUMNS[1:3] if not (r[c] or "").strip()]
            seen.add(id_)
            topics = [t for t in re.split(r"[;,\s]+", r.get("topics") or "") if t]
            rows.append((len(rows), id_, (r["persona_name"] or "").strip(), (r["persona_description"] or "").strip(), topics))
    if wrong:
        raise ValueError(f"{path}: " + "; ".join(wrong))
    return spark.createDataFrame(rows, "pos long, persona_id string, persona_name string, persona_description string, topics array<string>")


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """JSON-lines logs: a fixed head, and all fields as text in ``data``; lines that are no JSON are left out."""
    lines = spark.read.text(path)
    data = F.from_json("value", "map<string,string>")
    return lines.select(data.alias("data")).where(F.col("data").isNotNull()).select(F.to_timestamp(F.col("data")["ts"]).alias("ts"), F.col("data")["level"].alias("level"), F.col("data")["event"].alias("event"), "data")


# --- configuration and prompts


@dataclass
class Options:
    """Defaults that bound work; a TOML file's table of the same name overrides them."""

    budget: int = 32_000
    chunk_target: int = 500
    chunk_overlap: int = 60
    top_k: int = 8
    context_budget: int = 6_000
    embed_batch: int = 32
    reranker: str = "rrf"
    crawl_delay_ms: int = 5_000
    crawl_depth: int = 2
    eval_concurrency: int = 4
    max_turns: int = 5
    aliases: dict[str, str] = field(default_factory=dict)


def load_options(path: str | None = None, text: str | None = None) -> Options:
    raw = tomllib.loads(text) if text is not None else tomllib.load(open(path, "rb")) if path else {}
    flat = {k: v for part in raw.values() if isinstance(part, dict) for k, v in part.items()} | {k: v for k, v in raw.items() if not isinstance(v, dict)} | ({"aliases": raw["aliases"]} if isinstance(raw.get("aliases"), dict) else {})
    known = {f.name: f.type for f in fields(Options)}
    out = Options(**{k: v for k, v in flat.items() if k in known})
    if out.reranker not in ("rrf", "linear", "none"):
        raise ValueError(f"no reranker named {out.reranker!r}")
    if min(out.budget, out.chunk_target, out.top_k, out.context_budget, out.embed_batch) <= 0 or out.chunk_overlap < 0:
        raise ValueError("sizes must be positive")
    return out


def prompt(name: str, packaged: dict[str, str], folder: str | None = None, /, **values: str) -> str:
    """A prompt with its values: a file of the operator's wins; empty or missing prompts and values are errors."""
    key = re.sub(r"[^a-z0-9_-]", "", name.lower().replace(".", "-"))
    path = os.path.join(folder, f"{key}.md") if folder else None
    text = io.open(path, encoding="utf-8").read() if path and os.path.exists(path) else packaged.get(name, "")
    if not text.strip():
        raise ValueError(f"no prompt {name!r}")
    return Template(text).substitute(values)


def dump_json(value: Any) -> str:
    return json.dumps(value, ensure_ascii=False, sort_keys=True)
