"""What several operators of this subpackage share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.runtime import materialize


def token_file(name: str, folder: str | None = None) -> str:
    """The place of a public vocabulary file; folder is a parameter, else the installed package tells."""
    if folder:
        return f"{folder.rstrip('/')}/{name}"
    import public_tokenizers

    return public_tokenizers.path(name)


def names_apart(df: DataFrame, made: list[str]) -> list[str]:
    """The columns of df but for those that new ones replace."""
    return [c for c in df.columns if c.lower() not in {m.lower() for m in made}]


def free_name(df: DataFrame, name: str) -> str:
    """name, with underscores before it until no column of df is called so."""
    while name.lower() in {c.lower() for c in df.columns}:
        name = f"_{name}"
    return name


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


class Forest:
    """Union-find over any ids, with the smallest id of each tree as its root."""

    def __init__(self):
        self.up: dict[int, int] = {}

    def top(self, i: int) -> int:
        up = self.up
        root = i
        while (j := up.setdefault(root, root)) != root:
            root = j
        while i != root:
            up[i], i = root, up[i]
        return root

    def join(self, a: int, b: int) -> None:
        a, b = self.top(a), self.top(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)


def _forest(batches):
    """Edges of a partition as (node, root) of its own trees; loops and null ends are left out."""
    import pyarrow as pa

    f = Forest()
    for b in batches:
        for u, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            if u is not None and v is not None and u != v:
                f.join(u, v)
    pairs = [(f.top(i), i) for i in list(f.up)]
    pairs = [p for p in pairs if p[0] != p[1]]
    for k in range(0, len(pairs), 100_000):
        part = pairs[k : k + 100_000]
        yield pa.RecordBatch.from_arrays([pa.array([p[0] for p in part], pa.int64()), pa.array([p[1] for p in part], pa.int64())], ["u", "v"])


def connected_components(edges: DataFrame, last: int = 200_000) -> DataFrame:
    """(node, component) for every node of edges (u long, v long); component is the smallest node reachable.

    Each task first joins the edges of its partition into trees, which leaves
    at most one edge for each node that it saw. Each round then maps every
    node to the smallest of itself and its neighbours and contracts the edges
    along that map; once `last` edges or fewer are left, one task joins them.
    The chain of maps is followed back at the end. Rounds grow with the
    logarithm of the longest shortest path. A node with very many neighbours
    meets partial aggregates, and adaptive execution splits it in joins. Null
    ends and loops are ignored. Nothing but a count reaches the driver.
    """
    current = materialize(edges.select(F.col("u").cast("long"), F.col("v").cast("long")).mapInArrow(_forest, "u long, v long").distinct(), "edges")
    maps = []
    while n := current.count():
        if n <= last:
            trees = current.coalesce(1).mapInArrow(_forest, "u long, v long")
            maps.append(materialize(trees.select(F.col("v").alias("node"), F.col("u").alias("low")), "low"))
            break
        ends = current.select(F.col("v").alias("node"), F.col("u").alias("near")).unionByName(current.select(F.col("u").alias("node"), F.col("u").alias("near")))
        low = materialize(ends.groupBy("node").agg(F.min("near").alias("low")), "low")
        maps.append(low)
        a = low.select(F.col("node").alias("u"), F.col("low").alias("lu"))
        b = low.select(F.col("node").alias("v"), F.col("low").alias("lv"))
        moved = current.join(a, "u").join(b, "v").where("lu <> lv").select(F.least("lu", "lv").alias("u"), F.greatest("lu", "lv").alias("v"))
        current = materialize(moved.mapInArrow(_forest, "u long, v long").distinct(), "edges")
    if not maps:
        return edges.select(F.col("u").cast("long").alias("node"), F.col("v").cast("long").alias("component")).limit(0)
    found = maps[-1].select("node", F.col("low").alias("component"))
    for low in reversed(maps[:-1]):
        up = found.select(F.col("node").alias("low"), F.col("component").alias("top"))
        found = materialize(low.join(up, "low", "left").select("node", F.coalesce("top", "low").alias("component")), "components")
    return found.unionByName(found.select(F.col("component").alias("node"), "component")).distinct()


def range_ranked(df: DataFrame, keys: list[str], label: str) -> DataFrame:
    """df, range-partitioned and sorted by keys, written, with __part (int) and __at (row in that partition, long).

    __part rises with the keys. Rows that are equal in all keys are in one
    partition, so give keys that few rows share.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    low = F.monotonically_increasing_id()
    dealt = df.repartitionByRange(n, *keys).sortWithinPartitions(*keys)
    return materialize(dealt.select("*", F.spark_partition_id().alias("__part"), low.bitwiseAND((1 << 33) - 1).alias("__at")), label)


def in_blocks(rows: DataFrame, group: str, key: str, weight: str, limit: int) -> DataFrame:
    """rows with __i and __j, dealt out and sorted by (group, __i, __j), for work on all pairs of a group.

    A group of a weight up to `limit` is one block (0, 0). A heavier one is
    cut by a hash of key into k blocks of about limit / 2, and each of its
    rows goes to the k block pairs that hold its block, so that every pair of
    rows meets in some task and no task holds more than about `limit`.
    """
    sizes = rows.groupBy(group).agg(F.sum(weight).alias("__w")).where(F.col("__w") > limit)
    heavy = materialize(sizes.select(F.col(group).alias("__g"), F.ceil(F.col("__w") * 2 / limit).cast("int").alias("__k")), "heavy")
    rows = rows.join(small_or_shuffled(heavy), F.col(group) == F.col("__g"), "left").withColumn("__b", F.pmod(F.xxhash64(key), F.coalesce("__k", F.lit(1))).cast("int"))
    rows = rows.withColumn("__x", F.explode(F.sequence(F.lit(0), F.coalesce("__k", F.lit(1)) - 1)))
    rows = rows.withColumn("__i", F.least("__b", "__x")).withColumn("__j", F.greatest("__b", "__x")).drop("__g", "__k", "__b", "__x")
    return rows.repartition(group, "__i", "__j").sortWithinPartitions(group, "__i", "__j")


def grouped(batches, names: list[str]):
    """Lists of rows (tuples) that follow each other with equal values in the first three columns."""
    now, held = None, []
    for b in batches:
        for row in zip(*(b.column(b.schema.get_field_index(c)).to_pylist() for c in names)):
            if row[:3] != now:
                if held:
                    yield held
                now, held = row[:3], []
            held.append(row)
    if held:
        yield held


def small_or_shuffled(df: DataFrame, most_rows: int = 500_000) -> DataFrame:
    """df with a broadcast hint if it has at most `most_rows` rows (counted), else as it is; give narrow written tables."""
    return F.broadcast(df) if df.count() <= most_rows else df


def edge_table(u, v):
    """Distinct pairs of two int64 arrays, as a record batch (u, v)."""
    import numpy as np
    import pyarrow as pa

    order = np.lexsort((v, u))
    u, v = u[order], v[order]
    new = np.ones(len(u), bool)
    new[1:] = (u[1:] != u[:-1]) | (v[1:] != v[:-1])
    return pa.RecordBatch.from_arrays([pa.array(u[new]), pa.array(v[new])], ["u", "v"])
