"""Sources: dicts with a type and options, read by Spark's own readers."""

from __future__ import annotations

import json
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.operators.steps import unique_names

_DRIVERS = {"postgres": "postgresql", "postgresql": "postgresql", "mysql": "mysql", "sqlite": "sqlite", "sqlserver": "sqlserver"}


def from_grid(spark: SparkSession, grid: list[list], headers: bool = True) -> DataFrame:
    """A table out of rows of values. A column with values of one kind keeps it; other columns become text."""
    width = max((len(r) for r in grid), default=0)
    names = unique_names([None if v is None else str(v) for v in grid[0]] + [None] * (width - len(grid[0]))) if headers and grid else [f"Column{k}" for k in range(1, width + 1)]
    rows = [list(r) + [None] * (width - len(r)) for r in (grid[1:] if headers else grid)]
    kinds = {bool: "boolean", int: "double", float: "double", str: "string", bytes: "binary"}
    schema = []
    for k, n in enumerate(names):
        found = {kinds.get(type(r[k]), {"date": "date", "datetime": "timestamp"}.get(type(r[k]).__name__, "string")) for r in rows if r[k] is not None}
        kind = found.pop() if len(found) == 1 else "string"
        for r in rows:
            if r[k] is not None:
                r[k] = float(r[k]) if kind == "double" else str(r[k]) if kind == "string" else r[k]
        schema.append(f"`{n}` {kind}")
    return spark.createDataFrame([tuple(r) for r in rows], ", ".join(schema))


def _json(spark: SparkSession, path: str, at: str | None) -> DataFrame:
    df = spark.read.option("multiLine", True).json(path)
    for part in [p for p in re.split(r"[.$]+", at or "") if p]:
        df = df.select(F.col(f"`{part}`").alias("__v"))
        if df.schema["__v"].dataType.typeName() == "array":
            df = df.select(F.explode("__v").alias("__v"))
        df = df.select("__v.*") if df.schema["__v"].dataType.typeName() == "struct" else df.select(F.col("__v").alias(part))
    return df


def folder(spark: SparkSession, path: str, recursive: bool = False, content: bool = False) -> DataFrame:
    """The files of a folder: Name, Extension, Folder Path, Date modified, Size and, if wanted, Content."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", recursive).load(path)
    name = F.element_at(F.split("path", "/"), -1)
    cols = [name.alias("Name"), F.when(name.contains("."), F.concat(F.lit("."), F.substring_index(name, ".", -1))).otherwise("").alias("Extension"), F.expr("substring(path, 1, length(path) - length(element_at(split(path, '/'), -1)))").alias("Folder Path"), F.col("modificationTime").alias("Date modified"), F.col("length").alias("Size")]
    return files.select(*cols, *([F.col("content").alias("Content")] if content else []))


def _pages(fetch, url: str, rows_path: str, top: int | None):
    """Rows of an OData feed, following @odata.nextLink until `top` rows are there."""
    seen = 0
    while url:
        page = fetch(url)
        rows = page
        for part in rows_path.split("."):
            rows = rows.get(part, []) if isinstance(rows, dict) else rows
        for r in rows:
            if top is not None and seen >= top:
                return
            seen += 1
            yield r
        url = page.get("@odata.nextLink") if isinstance(page, dict) else None


def _rows(spark: SparkSession, rows: list[dict], columns: list[str] | None = None) -> DataFrame:
    names = columns or list(dict.fromkeys(k for r in rows for k in r if not k.startswith("@")))
    return from_grid(spark, [names, *[[v if not isinstance(v := r.get(n), (dict, list)) else json.dumps(v, sort_keys=True) for n in names] for r in rows]])


def http_fetch(url: str, headers: dict | None = None, method: str = "GET"):
    from urllib.request import Request, urlopen

    with urlopen(Request(url, headers=headers or {}, method=method), timeout=60) as answer:
        return json.loads(answer.read())


def load(spark: SparkSession, src: dict, fetch=None) -> DataFrame:
    """The DataFrame of a source. fetch(url) -> parsed JSON serves the web sources; by default it asks the network."""
    kind = src["type"]
    fetch = fetch or src.get("fetch") or (lambda url: http_fetch(url, src.get("headers"), src.get("method", "GET")))
    if kind == "range":
        values = src["range"]["values"] if isinstance(src["range"], dict) else src["range"]
        return from_grid(spark, values, (src["range"].get("hasHeaders", True) if isinstance(src["range"], dict) else src.get("hasHeaders", True)) is not False)
    if kind == "table":
        return spark.table(src["table"])
    if kind == "csv":
        o = src.get("options", {})
        head = o.get("hasHeaders", True)
        df = spark.read.csv(src["path"], sep=o.get("delimiter", ","), header=head, inferSchema=True, multiLine=o.get("multiLine", False), escape='"')
        return df if head else df.toDF(*[f"Column{k}" for k in range(1, len(df.columns) + 1)])
    if kind == "json":
        return _json(spark, src["path"], src.get("jsonPath"))
    if kind == "parquet":
        df = spark.read.parquet(src["path"])
        columns = (src.get("options") or {}).get("columns")
        return df.select(*[f"`{n}`" for n in columns]) if columns else df
    if kind == "arrow":
        import pyarrow as pa

        data = src["table"] if isinstance(src.get("table"), pa.Table) else pa.ipc.open_stream(src["bytes"]).read_all()
        return spark.createDataFrame(data)
    if kind == "folder":
        o = src.get("options", {})
        return folder(spark, src["path"], bool(o.get("recursive")), bool(o.get("includeContent")))
    if kind == "database":
        c = src["connection"] if isinstance(src["connection"], dict) else {"url": src["connection"]}
        url = c.get("url") or f"jdbc:{_DRIVERS[src['dialect']]}://{c['server']}/{c['database']}"
        df = spark.read.format("jdbc").option("url", url).option("query", src["query"]).options(**c.get("options", {})).load()
        return df.select(*[f"`{n}`" for n in src["columns"]]) if src.get("columns") else df
    if kind == "api":
        got = fetch(src["url"])
        return _rows(spark, got if isinstance(got, list) else got.get("value", got.get("items", [got])))
    if kind == "odata":
        return _rows(spark, list(_pages(fetch, src["url"], src.get("rowsPath") or "value", src.get("top"))), src.get("select"))
    if kind == "sharepoint":
        site = src["siteUrl"].rstrip("/")
        found, todo = [], [f"{site}/{src.get('mode', 'files')}"]
        while todo:
            for r in _pages(fetch, todo.pop(0), "value", None):
                if r.get("folder") is not None and "children" in r:
                    if (src.get("options") or {}).get("recursive", src.get("mode") == "files"):
                        todo.append(r["children"])
                    if src.get("mode") == "files":
                        continue
                name = r.get("name", "")
                found.append({"Name": name, "Extension": "." + name.rsplit(".", 1)[1] if "." in name else "", "Folder Path": r.get("path", site), "Size": r.get("size")})
        return _rows(spark, found, ["Name", "Extension", "Folder Path", "Size"])
    raise ValueError(f"unknown source {kind!r}")
