"""A folder of Markdown notes as typed cards: only the files that a scan may need are opened, frontmatter stays typed and nested."""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

try:
    import yaml
except ImportError:  # the rest of the library doesn't need it
    yaml = None

NOTE = "rel_path string, size long, mtime timestamp, json string, body string, provenance string, content_hash string, frontmatter_hash string, problem string"


def paths_of(root: str, folders: dict[str, str], types: tuple[str, ...] = (), prefix: str = "") -> list[str]:
    """What to read below ``root`` for ``types`` (each kept in its folder by ``folders``) and paths that start with ``prefix``.

    Globs for Spark's file listing, so that a scan of a type, or below a
    prefix, neither lists nor opens other folders, in any store Spark reads.
    A type that ``folders`` doesn't name may be anywhere.
    """
    known = [folders[t].strip("/") + "/" for t in types if t in folders]
    if not types or len(known) < len(types):
        known = [""]
    out = []
    for folder in dict.fromkeys(known):
        if folder.startswith(prefix):
            out.append(f"{root}/{folder}" if folder else f"{root}/{prefix}*" if prefix else root)
        elif prefix.startswith(folder):
            out.append(f"{root}/{prefix}*")
    return out


def scan(spark: SparkSession, root: str, folders: dict[str, str] | None = None, types: tuple[str, ...] = (), prefix: str = "") -> DataFrame:
    """rel_path, size, mtime, type, uid, fields (VARIANT), json, body, provenance (VARIANT), content_hash, frontmatter_hash and problem of the notes (``*.md``) below ``root``.

    ``types`` and ``prefix`` choose files before any is opened
    (:func:`paths_of`), then rows by their own type. ``json`` is the
    frontmatter with its types, keys sorted: content_hash is the SHA-256 of it,
    a line end and the body, frontmatter_hash that of it alone. A provenance
    block in the body's comments is taken out of the body. A note without
    frontmatter has no fields and is all body; one that can't be read as YAML
    keeps its body, and ``problem`` says why. A repeated key keeps its last
    value. Files of no bytes tell nothing and are left out, as Spark does; an
    empty choice gives no rows.
    """
    if yaml is None:
        raise ImportError("reading typed frontmatter needs PyYAML")
    root = root.rstrip("/")
    paths = [p for p in paths_of(root, folders or {}, types, prefix) if _there(spark, p)]
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.md").load(paths) if paths else spark.createDataFrame([], "path string, modificationTime timestamp, length long, content binary")
    below = root.split(":", 1)[-1].rstrip("/") + "/"  # as paths are told with their store's name
    rel = F.regexp_replace("path", "^.*?" + re.escape(below), "")
    notes = files.select(rel.alias("rel_path"), F.col("length").alias("size"), F.col("modificationTime").alias("mtime"), "content").mapInArrow(_parsed, NOTE)
    typed = notes.withColumns({"fields": F.try_parse_json("json"), "provenance": F.try_parse_json("provenance")})
    typed = typed.withColumns({"type": value(F.col("fields"), "type"), "uid": value(F.col("fields"), "uid")})
    typed = typed.filter(F.startswith("rel_path", F.lit(prefix))) if prefix else typed
    return typed.filter(F.col("type").isin(*types)) if types else typed


def value(fields: Column, path: str, kind: str = "string") -> Column:
    """A field, by a path into nested ones (``a.b[0]``), as ``kind``; null if it is missing or of another type."""
    return F.try_variant_get(fields, f"$.{path}", kind)


def _there(spark: SparkSession, glob: str) -> bool:
    path = spark._jvm.org.apache.hadoop.fs.Path(glob)
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path)
    return found is not None and len(found) > 0


def _plain(x):
    """A YAML value as JSON has it: dates as text, keys as text, no NUL characters."""
    if isinstance(x, dict):
        return {str(k).replace("\0", ""): _plain(v) for k, v in x.items()}
    if isinstance(x, (list, tuple, set)):
        return [_plain(v) for v in x]
    return x.replace("\0", "") if isinstance(x, str) else x if isinstance(x, (bool, int, float, type(None))) else str(x)


def read_note(text: str) -> tuple[dict, str, dict, str | None]:
    """Fields, body, provenance and problem of one note."""
    fields, body, problem = {}, text, None
    lines = text.split("\n")
    if lines[0].rstrip() == "---" and (end := next((i for i, line in enumerate(lines[1:], 1) if line.rstrip() == "---"), None)):
        body = "\n".join(lines[end + 1 :])
        try:
            told = yaml.safe_load("\n".join(lines[1:end])) or {}
            fields = _plain(told) if isinstance(told, dict) else {}
            problem = None if isinstance(told, dict) else "frontmatter is no mapping"
        except yaml.YAMLError as error:
            problem = str(error).split("\n")[0]
    provenance = {}
    before, mark, rest = body.partition("<!-- provenance\n")
    if mark and "\n-->" in rest:
        block, _, after = rest.partition("\n-->")
        body = before.removesuffix("\n") + after.lstrip()
        for name, _, payload in (line.partition(":") for line in block.split("\n")):
            try:
                entry = json.loads(payload)
            except ValueError:
                continue
            if name.strip() and isinstance(entry, dict):
                provenance[name.strip()] = entry
    return fields, body.strip(), provenance, problem


def _parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sha = lambda s: hashlib.sha256(s.encode("utf-8", "surrogatepass")).hexdigest()
    for batch in batches:
        rows = []
        for content in batch.column("content"):
            fields, body, provenance, problem = read_note((content.as_py() or b"").decode("utf-8", "replace"))
            body = body.replace("\0", "")
            told = json.dumps(fields, sort_keys=True)
            rows.append((told, body, json.dumps(provenance, sort_keys=True), sha(f"{told}\n{body}"), sha(told), problem))
        columns = [pa.array(list(c), pa.string()) for c in zip(*rows)] if rows else [pa.array([], pa.string())] * 6
        yield pa.RecordBatch.from_arrays([batch.column("rel_path"), batch.column("size"), batch.column("mtime"), *columns], [f.split()[0] for f in NOTE.split(", ")])
