"""Star-schema models: tables, relationships, measures, filter context, pivots.

A measure is compiled for all groups of a pivot at once: each aggregation in
it becomes an aggregate of one grouped DataFrame, aggregations over the same
rows share one, and the frames meet in joins on the group keys. Filters reach
other tables as left semi joins along relationships. There is no job for each
cell. Inside the compiler, columns are named ``Table[Column]``.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gridloom.functions.expression import kind_of

_TOKEN = re.compile(r"""\s*(?:(?P<num>\d+(?:\.\d+)?)|"(?P<str>(?:[^"]|"")*")|'(?P<quoted>(?:[^']|'')*)'|\[(?P<col>(?:\]\]|[^\]])*)\]|(?P<name>[A-Za-z_][A-Za-z0-9_.]*)|(?P<op><>|<=|>=|&&|\|\||[-+*/&=<>(){},!]))""")
_LEVELS = [("||",), ("&&",), ("=", "<>", "<", "<=", ">", ">=", "in"), ("&",), ("+", "-"), ("*", "/")]


def parse(text: str):
    """A DAX expression as nested tuples."""
    ts, at = [], 0
    text = text.strip()
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m or m.end() == at:
            raise SyntaxError(f"unexpected {text[at : at + 10]!r}")
        at = m.end()
        kind = m.lastgroup
        value = m[kind]
        if kind == "str":
            value = value[:-1].replace('""', '"')
        if kind == "name" and value.lower() in ("in", "var", "return"):
            kind, value = "op", value.lower()
        ts.append((kind, value))
    ts.append(("end", None))
    at = 0

    def peek(*v):
        return ts[at][0] == "op" and ts[at][1] in v

    def take(*v):
        nonlocal at
        if v and not peek(*v):
            raise SyntaxError(f"expected {v}, found {ts[at][1]!r}")
        at += 1
        return ts[at - 1]

    def expr():
        if peek("var"):
            bound = []
            while peek("var"):
                take()
                name = take()[1]
                take("=")
                bound.append((name.lower(), expr()))
            take("return")
            return ("var", bound, expr())
        return level(0)

    def level(k):
        if k == len(_LEVELS):
            return unary()
        left = level(k + 1)
        while peek(*_LEVELS[k]):
            op = take()[1]
            left = ("bin", op, left, level(k + 1))
        return left

    def unary():
        if peek("-", "+", "!"):
            op = take()[1]
            return ("un", op, unary())
        if ts[at] == ("name", "NOT") and ts[at + 1] != ("op", "("):
            take()
            return ("un", "!", unary())
        return primary()

    def args(close):
        out = []
        while not peek(close):
            out.append(("default",) if peek(",") else expr())
            if peek(","):
                take()
        take(close)
        return out

    def primary():
        kind, value = take()
        if kind == "num":
            return ("value", float(value))
        if kind == "str":
            return ("value", value)
        if kind == "col":
            return ("ref", value.replace("]]", "]"))
        if kind in ("quoted", "name"):
            if ts[at][0] == "col":
                return ("col", value, take()[1])
            if kind == "name" and peek("("):
                take()
                return ("call", value.upper(), args(")"))
            return ("name", value)
        if kind == "op" and value == "(":
            items = args(")")
            return items[0] if len(items) == 1 else ("tuple", items)
        if kind == "op" and value == "{":
            return ("rows", [list(x[1]) if x[0] == "tuple" else [x] for x in args("}")])
        raise SyntaxError(f"unexpected {value!r}")

    tree = expr()
    if ts[at][0] != "end":
        raise SyntaxError(f"unexpected {ts[at][1]!r}")
    return tree


@dataclass(frozen=True)
class Relationship:
    """Many rows of from_table[from_column] to one of to_table[to_column]; many_to_many lifts that. cross: single, both."""

    from_table: str
    from_column: str
    to_table: str
    to_column: str
    cross: str = "single"
    active: bool = True
    many_to_many: bool = False
    referential: bool = False


@dataclass(frozen=True)
class Filter:
    columns: frozenset
    table: str
    keep: object  # a function of a DataFrame


@dataclass(frozen=True)
class Context:
    filters: tuple = ()
    keys: tuple = ()  # (table, column) pairs of the groups
    use: frozenset = frozenset()  # relationships made active
    cross: tuple = ()  # (relationship, direction)
    names: dict = field(default_factory=dict, hash=False)
    removed: frozenset = frozenset()


def q(table: str, column: str) -> str:
    return f"{table}[{column}]"


def col(name: str) -> Column:
    return F.col(f"`{name}`")


def _null_safe(df: DataFrame, other: DataFrame, keys: list[str], how: str) -> DataFrame:
    """Join on keys of equal names, nulls equal; the keys appear once."""
    if not keys:
        return df.crossJoin(other)  # one row against one value
    renamed = other.select(*[col(k).alias(f"__j{i}") for i, k in enumerate(keys)], *[col(c) for c in other.columns if c not in keys])
    on = reduce(lambda a, b: a & b, [col(k).eqNullSafe(F.col(f"__j{i}")) for i, k in enumerate(keys)])
    return df.join(renamed, on, how).drop(*[f"__j{i}" for i in range(len(keys))])


_AGGS = {"SUM", "AVERAGE", "MIN", "MAX", "COUNT", "COUNTA", "COUNTBLANK", "DISTINCTCOUNT", "DISTINCTCOUNTNOBLANK"}
_ITER = {"SUMX": "SUM", "AVERAGEX": "AVERAGE", "MINX": "MIN", "MAXX": "MAX", "COUNTX": "COUNTA", "COUNTAX": "COUNTA"}
_TABLE_FUNCTIONS = {"FILTER", "VALUES", "DISTINCT", "ALL", "ALLNOBLANKROW", "CALCULATETABLE", "SUMMARIZE", "SUMMARIZECOLUMNS", "RELATEDTABLE"}


class Model:
    def __init__(self):
        self.tables: dict[str, DataFrame] = {}
        self.relationships: list[Relationship] = []
        self.measures: dict[str, tuple] = {}
        self.calculated: dict[str, dict[str, tuple]] = {}

    def name(self, table: str) -> str:
        found = [t for t in self.tables if t.casefold() == table.casefold()]
        if not found:
            raise KeyError(f"unknown table {table!r}")
        return found[0]

    def column(self, table: str, column: str) -> tuple[str, str]:
        t = self.name(table)
        found = [c for c in self.tables[t].columns if c.casefold() == column.casefold()]
        if not found:
            raise KeyError(f"unknown column {table}[{column}]")
        return t, found[0]

    def add_table(self, name: str, df: DataFrame) -> Model:
        self.tables[name] = df
        return self

    def add_relationship(self, r: Relationship, check: bool = False) -> Model:
        """With check, probe the one side's keys for repeats and, where asked for, the many side for strays (both run jobs)."""
        if check:
            one, many = self.tables[r.to_table], self.tables[r.from_table]
            if not r.many_to_many and not one.groupBy(r.to_column).count().where("count > 1").isEmpty():
                raise ValueError(f"{r.to_table}[{r.to_column}] repeats values")
            if r.referential and not many.where(F.col(r.from_column).isNotNull()).join(one, many[r.from_column] == one[r.to_column], "left_anti").isEmpty():
                raise ValueError(f"{r.from_table}[{r.from_column}] has values that {r.to_table} lacks")
        self.relationships.append(r)
        return self

    def add_measure(self, name: str, text: str) -> Model:
        self.measures[name.strip("[]").casefold()] = parse(text)
        return self

    def add_calculated_column(self, table: str, name: str, text: str) -> Model:
        """A column computed in row context; it may read calculated columns that were added before."""
        t = self.name(table)
        before = dict(self.calculated.get(t, {}))
        self.define_calculated_column(t, name, text)
        try:
            self.tables[t] = self._computed(t, name, parse(text))
        except Exception:
            self.calculated[t] = before
            raise
        return self

    def define_calculated_column(self, table: str, name: str, text: str) -> Model:
        """Say how a column is calculated without computing it (its values are stored already); in any order."""
        t = self.name(table)
        made = self.calculated.get(t, {}) | {name: parse(text)}
        self._order(t, made)
        self.calculated[t] = made
        return self

    def _order(self, t: str, made: dict[str, tuple]) -> list[str]:
        """Calculated columns of a table so that each comes after those that it reads."""
        known, out, open_ = {n.casefold(): n for n in made}, [], []

        def visit(n: str) -> None:
            if n in out:
                return
            if n in open_:
                raise ValueError(f"dependency cycle among calculated columns of {t}: {' -> '.join([*open_[open_.index(n) :], n])}")
            open_.append(n)
            for x in _walk(made[n], self):
                read = x[2] if x[0] == "col" and x[1].casefold() == t.casefold() else x[1] if x[0] == "ref" else ""
                if read.casefold() in known:
                    visit(known[read.casefold()])
            open_.pop()
            out.append(n)

        for n in made:
            visit(n)
        return out

    def _computed(self, t: str, name: str, tree: tuple) -> DataFrame:
        """Table t with the column name computed, at its place or at the end."""
        ev = _Eval(self)
        df, made = ev.row(tree, ev.qualified(t), t, Context())
        columns = self.tables[t].columns if name in self.tables[t].columns else [*self.tables[t].columns, name]
        return df.withColumn("__made", made).select(*[F.col("__made").alias(c) if c == name else col(q(t, c)).alias(c) for c in columns])

    def insert_rows(self, table: str, rows: DataFrame) -> Model:
        """Append rows (their columns that are not calculated) and compute the calculated columns in the order in which they depend on each other.

        Values of another kind than their column's are refused. If anything fails, the table is as before.
        """
        t = self.name(table)
        before, made = self.tables[t], self.calculated.get(t, {})
        given = [c for c in before.columns if c not in made]
        for c in rows.columns:
            if c not in given:
                raise KeyError(f"{t} has no column {c!r} to insert into")
            if (old := kind_of(before.schema[c].dataType)) != (new := kind_of(rows.schema[c].dataType)) and "null" not in (old, new):
                raise TypeError(f"{t}[{c}] holds {old}, not {new}")
        try:
            self.tables[t] = before.select(*map(col, given)).unionByName(rows, allowMissingColumns=True)
            for n in self._order(t, made):
                self.tables[t] = self._computed(t, n, made[n])
            self.tables[t] = self.tables[t].select(*map(col, before.columns))
        except Exception:
            self.tables[t] = before
            raise
        return self

    def evaluate(self, text: str, filters: list[str] | None = None) -> DataFrame:
        """One value as a DataFrame of one row: value."""
        ev = _Eval(self)
        ctx = reduce(lambda c, f: ev.filtered(c, parse(f)), filters or [], Context())
        return ev.frame([("value", parse(text))], ctx, None).select("value")

    def table(self, text: str) -> DataFrame:
        """A table expression as a DataFrame with columns named Table[Column]."""
        return _Eval(self).table(parse(text), Context())

    def pivot(self, base: str, group_by: list[tuple[str, str]], measures: list[tuple[str, str]], filters: list[str] | None = None) -> DataFrame:
        """A row for each combination of the group columns on base's rows: columns Table[Column] and one for each (name, expression)."""
        ev = _Eval(self)
        keys = tuple(self.column(*k) for k in group_by)
        ctx = reduce(lambda c, f: ev.filtered(c, parse(f)), filters or [], Context())
        return ev.frame([(n, parse(e)) for n, e in measures], replace(ctx, keys=keys), self.name(base))

    def crosstab(self, base: str, rows: list[tuple[str, str]], columns: list[tuple[str, str]], measures: list[tuple[str, str]], values: list[str], filters: list[str] | None = None) -> DataFrame:
        """The pivot with column keys spread over `values` (several fields joined by " / "); several measures: "A - Total"."""
        flat = self.pivot(base, rows + columns, measures, filters)
        heads = F.concat_ws(" / ", *[F.coalesce(col(q(*self.column(*c))).cast("string"), F.lit("(blank)")) for c in columns])
        keys = [q(*self.column(*r)) for r in rows]
        made = [F.first(col(n), ignorenulls=True).alias(n if len(measures) == 1 else n) for n, _ in measures]
        out = flat.withColumn("__head", heads).groupBy(*map(col, keys)).pivot("__head", values).agg(*made)
        if len(measures) > 1:
            out = out.toDF(*[c if c in keys else " - ".join(next(((v, n) for v in values for n, _ in measures if c == f"{v}_{n}"), (c,))) for c in out.columns])
        return out


class _Leaves:
    """Aggregations to make, gathered by the rows they run over."""

    def __init__(self):
        self.frames: dict = {}
        self.count = 0

    def add(self, key, build, keys: tuple, agg: Column) -> Column:
        _, _, aggs = self.frames.setdefault((key, keys), (build, keys, []))
        self.count += 1
        name = f"__v{self.count}"
        aggs.append(agg.alias(name))
        return F.col(name)


class _Eval:
    def __init__(self, model: Model):
        self.m = model

    # --- rows under a filter context

    def qualified(self, t: str) -> DataFrame:
        return self.m.tables[t].select(*[F.col(f"`{c}`").alias(q(t, c)) for c in self.m.tables[t].columns])

    def edges(self, ctx: Context) -> list[tuple[Relationship, str]]:
        """Relationships in force with their direction: single, both, none or reverse."""
        pairs = {frozenset((r.from_table, r.to_table)) for r in ctx.use}
        out = []
        for r in self.m.relationships:
            on = r in ctx.use or (r.active and frozenset((r.from_table, r.to_table)) not in pairs)
            if on:
                out.append((r, dict(ctx.cross).get(r, r.cross)))
        return out

    def base(self, t: str, ctx: Context, seen: frozenset = frozenset()) -> DataFrame:
        """Visible rows of a table: its own filters and those that flow in from others."""
        df = self.qualified(t)
        for f in ctx.filters:
            if f.table == t:
                df = f.keep(df)
        for r, way in self.edges(ctx):
            for one, other, mine, theirs, flows in ((r.to_table, r.from_table, r.from_column, r.to_column, way in ("single", "both")), (r.from_table, r.to_table, r.to_column, r.from_column, way in ("both", "reverse"))):
                if other == t and one not in seen and flows and self.touched(one, ctx, seen | {t}):
                    side = self.base(one, ctx, seen | {t}).select(col(q(one, theirs)).alias("__k"))
                    df = df.join(side, col(q(t, mine)) == F.col("__k"), "left_semi")
        return df

    def touched(self, t: str, ctx: Context, seen: frozenset) -> bool:
        if any(f.table == t for f in ctx.filters):
            return True
        for r, way in self.edges(ctx):
            if r.from_table == t and r.to_table not in seen and way in ("single", "both") and self.touched(r.to_table, ctx, seen | {t}):
                return True
            if r.to_table == t and r.from_table not in seen and way in ("both", "reverse") and self.touched(r.from_table, ctx, seen | {t}):
                return True
        return False

    def path(self, start: str, goal: str, ctx: Context) -> list[tuple[Relationship, bool]]:
        """The single shortest way from a table to one whose filters reach it; two ways of that length are an error."""
        ways = [[(start, [])]]
        seen = {start}
        level = [(start, [])]
        while level:
            found = [p for t, p in level if t == goal]
            if found:
                if len(found) > 1:
                    raise ValueError(f"the way from {start} to {goal} is ambiguous")
                return found[0]
            after = []
            for t, p in level:
                for r, way in self.edges(ctx):
                    if r.from_table == t and r.to_table not in seen and way != "none":
                        after.append((r.to_table, [*p, (r, True)]))
                    elif r.to_table == t and r.from_table not in seen and way in ("both", "reverse"):
                        after.append((r.from_table, [*p, (r, False)]))
            seen |= {t for t, _ in after}
            level = after
            ways.append(level)
        raise LookupError(f"no relationship leads from {start} to {goal}")

    def attach(self, df: DataFrame, t: str, wanted, ctx: Context) -> DataFrame:
        """df (rows of t) with further columns (table, column) looked up along relationships."""
        for table, column in wanted:
            if q(table, column) in df.columns:
                continue
            at = t
            try:
                way = self.path(t, table, ctx)
            except LookupError:
                df = df.crossJoin(self.base(table, ctx).select(col(q(table, column))).distinct())
                continue
            for k, (r, forward) in enumerate(way):
                mine, nxt, theirs = (r.from_column, r.to_table, r.to_column) if forward else (r.to_column, r.from_table, r.from_column)
                last = k == len(way) - 1
                after = {q(nxt, theirs)} | ({q(nxt, column)} if last else set())
                if not last:
                    r2, f2 = way[k + 1]
                    after.add(q(nxt, r2.from_column if f2 else r2.to_column))
                missing = [c for c in sorted(after) if c not in df.columns]
                if missing:
                    fan = r.many_to_many or not forward
                    side = self.base(nxt, ctx) if fan else self.qualified(nxt)
                    side = side.select(col(q(nxt, theirs)).alias("__k"), *[col(c).alias(c) for c in missing])
                    side = side.distinct() if fan else side
                    df = df.join(side, col(q(at, mine)) == F.col("__k"), "left").drop("__k")
                at = nxt
        return df

    # --- filters

    def filtered(self, ctx: Context, f) -> Context:
        """The context after a filter argument of CALCULATE."""
        if f[0] == "call" and f[1] in ("ALL", "ALLNOBLANKROW"):
            cols, tables = set(), set()
            for a in f[2]:
                if a[0] == "col":
                    cols.add(self.m.column(a[1], a[2]))
                else:
                    tables.add(self.m.name(a[1]))
            if not f[2]:
                tables = set(self.m.tables)
            keep = tuple(x for x in ctx.filters if x.table not in tables and not (x.columns and x.columns <= cols))
            keys = tuple(k for k in ctx.keys if k not in cols and not any(self._inside(k[0], t, ctx) for t in tables))
            return replace(ctx, filters=keep, keys=keys, removed=ctx.removed | (set(ctx.keys) - set(keys)))
        if f[0] == "call" and f[1] == "USERELATIONSHIP":
            a, b = (self.m.column(x[1], x[2]) for x in f[2])
            return replace(ctx, use=ctx.use | {self._relation(a, b)})
        if f[0] == "call" and f[1] == "CROSSFILTER":
            a, b = (self.m.column(x[1], x[2]) for x in f[2][:2])
            r = self._relation(a, b)
            word = f[2][2][1].upper()
            left_is_one = a == (r.to_table, r.to_column)
            way = {"BOTH": "both", "NONE": "none", "ONEWAY": "single", "ONEWAY_LEFTFILTERSRIGHT": "single" if left_is_one else "reverse", "ONEWAY_RIGHTFILTERSLEFT": "reverse" if left_is_one else "single"}[word]
            return replace(ctx, cross=(*ctx.cross, (r, way)))
        if f[0] == "call" and f[1] in _TABLE_FUNCTIONS or f[0] in ("rows",) or f[0] == "name":
            rows = self.table(f, replace(ctx, keys=()))
            cols = [c for c in rows.columns]
            t = cols[0].split("[")[0]
            own = frozenset((t, c.split("[", 1)[1][:-1]) for c in cols)
            keep = lambda df, rows=rows, cols=cols: _null_safe(df, rows.select(*map(col, cols)).distinct(), cols, "left_semi")
            if f[0] == "call" and f[1] == "FILTER" and f[2][0][0] == "name":
                return replace(ctx, filters=(*ctx.filters, Filter(frozenset(), t, keep)))
            return self._override(ctx, own, t, keep)
        refs = {self.m.column(x[1], x[2]) for x in _walk(f) if x[0] == "col"}
        tables = {t for t, _ in refs}
        if len(tables) != 1:
            raise ValueError("a filter has to be about one table")
        t = tables.pop()

        def keep(df, f=f, t=t):
            df2, made = self.row(f, df, t, replace(ctx, keys=(), filters=()))
            return df2.where(made).select(*map(col, df.columns))

        return self._override(ctx, frozenset(refs), t, keep)

    def _inside(self, t: str, of: str, ctx: Context) -> bool:
        """Whether t is the table or one that it looks up: the columns of its expanded table."""
        if t == of:
            return True
        try:
            return all(forward for _, forward in self.path(of, t, ctx))
        except (LookupError, ValueError):
            return False

    def _override(self, ctx: Context, columns: frozenset, t: str, keep) -> Context:
        rest = tuple(x for x in ctx.filters if not (x.columns and x.columns <= columns and x.table == t))
        keys = tuple(k for k in ctx.keys if k not in columns)
        return replace(ctx, filters=(*rest, Filter(columns, t, keep)), keys=keys, removed=ctx.removed | (set(ctx.keys) - set(keys)))

    def _relation(self, a, b) -> Relationship:
        for r in self.m.relationships:
            ends = {(r.from_table, r.from_column), (r.to_table, r.to_column)}
            if ends == {a, b}:
                return r
        raise LookupError(f"no relationship between {a} and {b}")

    # --- table expressions: DataFrames with the context's keys attached

    def table(self, e, ctx: Context) -> DataFrame:
        kind = e[0]
        if kind == "name":
            if e[1].lower() in ctx.names:
                return self.table(ctx.names[e[1].lower()], ctx)
            t = self.m.name(e[1])
            return self.attach(self.base(t, ctx), t, ctx.keys, ctx)
        if kind == "rows":
            spark = next(iter(self.m.tables.values())).sparkSession
            width = len(e[1][0])
            names = ["[Value]"] if width == 1 else [f"[Value{k}]" for k in range(1, width + 1)]
            one = spark.range(1)
            rows = [F.struct(*[self.row(v, one, None, ctx)[1].alias(n) for v, n in zip(r, names)]) for r in e[1]]
            return one.select(F.explode(F.array(*rows)).alias("__r")).select(*[F.col("__r").getField(n).alias(n) for n in names])
        if kind != "call":
            raise ValueError("a table expression is needed")
        f, a = e[1], e[2]
        keys = [q(*k) for k in ctx.keys]
        if f == "FILTER":
            df = self.table(a[0], ctx)
            df2, made = self.row(a[1], df, self.home(a[0], ctx), ctx)
            return df2.where(made).select(*map(col, df.columns))
        if f in ("VALUES", "DISTINCT") and a[0][0] == "col":
            t, c = self.m.column(a[0][1], a[0][2])
            own = self.attach(self.base(t, ctx), t, ctx.keys, ctx).select(*{q(t, c): col(q(t, c))} | {k: col(k) for k in keys})
            if f == "VALUES":
                own = self.with_blank(own, t, [c], ctx)
            return own.distinct()
        if f in ("VALUES", "DISTINCT"):
            t = self.m.name(a[0][1]) if a[0][0] == "name" and a[0][1].lower() not in ctx.names else None
            df = self.table(a[0], ctx)
            if f == "VALUES" and t:
                return self.with_blank(df, t, self.m.tables[t].columns, ctx)
            return df.distinct()
        if f in ("ALL", "ALLNOBLANKROW"):
            free = self.filtered(ctx, e)
            if a[0][0] == "name":
                t = self.m.name(a[0][1])
                df = self.qualified(t)
                return df if f == "ALLNOBLANKROW" else self.with_blank(df, t, self.m.tables[t].columns, replace(free, filters=()))
            cols = [self.m.column(x[1], x[2]) for x in a]
            t = cols[0][0]
            df = self.qualified(t).select(*[col(q(*c)) for c in cols])
            return (df if f == "ALLNOBLANKROW" else self.with_blank(df, t, [c for _, c in cols], replace(free, filters=(), keys=()))).distinct()
        if f == "CALCULATETABLE":
            return self.table(a[0], reduce(self.filtered, a[1:], ctx))
        if f == "RELATEDTABLE":
            return self.table(a[0], ctx)
        if f == "SUMMARIZE":
            t = self.m.name(a[0][1]) if a[0][0] == "name" else self.home(a[0], ctx)
            cols = [self.m.column(x[1], x[2]) for x in a[1:] if x[0] == "col"]
            df = self.attach(self.table(a[0], ctx), t, cols, ctx).select(*{q(*c): col(q(*c)) for c in (*cols, *ctx.keys)}.values()).distinct()
            named = a[1 + len(cols) :]
            if named:
                got = self.frame([(named[i][1], named[i + 1]) for i in range(0, len(named), 2)], replace(ctx, keys=(*ctx.keys, *[c for c in cols if c not in ctx.keys])), t)
                return got
            return df
        if f == "SUMMARIZECOLUMNS":
            cols, filters, named = [], [], []
            it = iter(a)
            for x in it:
                if x[0] == "col":
                    cols.append(self.m.column(x[1], x[2]))
                elif x[0] == "value":
                    named.append((x[1], next(it)))
                else:
                    filters.append(x)
            inner = replace(reduce(self.filtered, filters, ctx), keys=tuple(cols))
            start = self._first_table(named, cols)
            return self.frame(named, inner, start) if named else self.attach(self.base(start, inner), start, cols, inner).select(*[col(q(*c)) for c in cols]).distinct()
        raise ValueError(f"{f} gives no table")

    def _first_table(self, named, cols) -> str:
        for _, e in named:
            for x in _walk(e, self.m):
                if x[0] == "col":
                    return self.m.name(x[1])
                if x[0] == "name" and x[1].casefold() in {t.casefold() for t in self.m.tables}:
                    return self.m.name(x[1])
        facts = {r.from_table for r in self.m.relationships} - {r.to_table for r in self.m.relationships}
        return cols[0][0] if len({t for t, _ in cols}) == 1 else sorted(facts)[0]

    def home(self, e, ctx: Context) -> str | None:
        """The table whose rows a table expression has, if one."""
        if e[0] == "name":
            return self.home(ctx.names[e[1].lower()], ctx) if e[1].lower() in ctx.names else self.m.name(e[1])
        if e[0] == "call" and e[2]:
            x = e[2][0]
            return self.m.name(x[1]) if x[0] in ("col", "name") and not (x[0] == "name" and x[1].lower() in ctx.names) else self.home(x, ctx)
        return None

    def with_blank(self, df: DataFrame, t: str, columns, ctx: Context) -> DataFrame:
        """df and, where rows of a many side find no partner in t, the blank member."""
        if any(f.table == t for f in ctx.filters):
            return df
        for r, _ in self.edges(ctx):
            if r.to_table == t and not r.referential:
                one = self.qualified(t).select(col(q(t, r.to_column)).alias("__k"))
                stray = self.attach(self.base(r.from_table, ctx), r.from_table, [k for k in ctx.keys if k[0] != t], ctx)
                stray = stray.join(one, col(q(r.from_table, r.from_column)) == F.col("__k"), "left_anti")
                made = [F.lit(None).cast(df.schema[c].dataType).alias(c) if c.split("[")[0] == t else col(c) for c in df.columns]
                df = df.unionByName(stray.select(*made).distinct().limit(1) if not ctx.keys else stray.select(*made).distinct())
                break
        return df

    # --- scalars for all groups

    def frame(self, named: list[tuple[str, tuple]], ctx: Context, base: str | None) -> DataFrame:
        """Group keys of ctx and one column for each named expression."""
        leaves = _Leaves()
        made = [(n, self.scalar(e, ctx, leaves)) for n, e in named]
        keys = [q(*k) for k in ctx.keys]
        spark = next(iter(self.m.tables.values())).sparkSession
        parts = []
        for build, ks, aggs in leaves.frames.values():
            df = build()
            names = [q(*k) for k in ks]
            parts.append((names, df.groupBy(*map(col, names)).agg(*aggs) if names else df.agg(*aggs)))
        same = [k for k in leaves.frames if k[0] == ("base", base, ctx_key(ctx)) and k[1] == ctx.keys]
        if not keys:
            out = spark.range(1).drop("id")
        elif same:
            at = list(leaves.frames).index(same[0])
            out = parts.pop(at)[1]
        else:
            out = self.attach(self.base(base, ctx), base, ctx.keys, ctx).select(*map(col, keys)).distinct()
        for names, df in parts:
            out = _null_safe(out, df, names, "left") if names else out.crossJoin(df)
        return out.select(*map(col, keys), *[c.alias(n) for n, c in made])

    def _leaf(self, e, ctx: Context, leaves: _Leaves, agg) -> Column:
        """An aggregation over a table expression; agg takes (df) and gives (df, Column)."""
        key = ("base", self.m.name(e[1]), ctx_key(ctx)) if e[0] == "name" and e[1].lower() not in ctx.names else (repr(e), ctx_key(ctx))
        return leaves.add(key, lambda: self.table(e, ctx), ctx.keys, agg)

    def _aggregate(self, f: str, x: Column, kind: T.DataType | None) -> Column:
        number = not isinstance(kind, (T.StringType,))
        if f == "SUM":
            return F.sum(x)
        if f == "AVERAGE":
            return F.avg(x)
        if f in ("MIN", "MAX"):
            return getattr(F, f.lower())(x)
        if f == "COUNT":
            return F.count(x) if number else F.lit(0).cast("long") * F.count(F.lit(1))
        if f == "COUNTA":
            return F.count(x)
        if f == "COUNTBLANK":
            return F.count_if(x.isNull())
        if f == "DISTINCTCOUNT":
            return F.count_distinct(x) + F.coalesce(F.max(x.isNull().cast("long")), F.lit(0))
        return F.count_distinct(x)

    def scalar(self, e, ctx: Context, leaves: _Leaves) -> Column:
        kind = e[0]
        if kind == "value":
            return F.lit(e[1])
        if kind == "default":
            return F.lit(None)
        if kind == "ref":
            if e[1].casefold() not in self.m.measures:
                raise KeyError(f"unknown measure [{e[1]}]")
            return self.scalar(self.m.measures[e[1].casefold()], ctx, leaves)
        if kind == "name" and e[1].lower() in ctx.names:
            return self.scalar(ctx.names[e[1].lower()], ctx, leaves)
        if kind == "var":
            return self.scalar(e[2], replace(ctx, names=_bind(ctx.names, e[1])), leaves)
        if kind == "bin" and e[1] != "in":
            return _operate(e[1], self.scalar(e[2], ctx, leaves), self.scalar(e[3], ctx, leaves))
        if kind == "bin":
            left = self.scalar(e[2], ctx, leaves)
            return F.coalesce(reduce(lambda a, b: a | b, [left.eqNullSafe(self.scalar(r[0], ctx, leaves)) for r in e[3][1]]), F.lit(False))
        if kind == "un":
            x = self.scalar(e[2], ctx, leaves)
            return ~truthy(x) if e[1] == "!" else -x if e[1] == "-" else x
        if kind != "call":
            raise ValueError("a value is needed")
        f, a = e[1], e[2]
        if f in _AGGS:
            t, c = self.m.column(a[0][1], a[0][2])
            source = ("name", t)
            if f in ("DISTINCTCOUNT", "COUNTBLANK") and any(r.to_table == t and not r.referential for r, _ in self.edges(ctx)):
                source = ("call", "VALUES", [a[0]] if f == "DISTINCTCOUNT" else [("name", t)])
            return self._leaf(source, ctx, leaves, self._aggregate(f, col(q(t, c)), self.m.tables[t].schema[c].dataType))
        if f == "COUNTROWS":
            return F.nullif(self._leaf(a[0], ctx, leaves, F.count(F.lit(1))), F.lit(0))
        if f in _ITER or f == "CONCATENATEX":
            return self._iterate(f, a, ctx, leaves)
        if f == "CALCULATE":
            return self.scalar(a[0], reduce(self.filtered, a[1:], ctx), leaves)
        if f in ("SELECTEDVALUE", "HASONEVALUE"):
            t, c = self.m.column(a[0][1], a[0][2])
            x = col(q(t, c))
            n = self._leaf(("name", t), ctx, leaves, self._aggregate("DISTINCTCOUNT", x, None))
            if f == "HASONEVALUE":
                return n == 1
            one = self._leaf(("name", t), ctx, leaves, F.max(x))
            return F.when(n == 1, one).otherwise(self.scalar(a[1], ctx, leaves) if len(a) > 1 else F.lit(None))
        if f == "ISINSCOPE":
            return F.lit(self.m.column(a[0][1], a[0][2]) in ctx.keys)
        return _plain(f, [self.scalar(x, ctx, leaves) for x in a])

    def _iterate(self, f: str, a, ctx: Context, leaves: _Leaves) -> Column:
        rows = self.table(a[0], ctx)
        home = self.home(a[0], ctx)
        df, x = self.row(a[1], rows, home, ctx)
        if f == "CONCATENATEX":
            delimiter = self.scalar(a[2], ctx, leaves) if len(a) > 2 else F.lit("")
            order, down = [], False
            if len(a) > 3:
                df, key = self.row(a[3], df, home, ctx)
                order = [F.lower(key.cast("string")), key.cast("string")] if isinstance(df.select(key).schema[0].dataType, T.StringType) else [key]
                down = len(a) > 4 and str(a[4][1]).upper() == "DESC"
            packed = F.sort_array(F.collect_list(F.struct(*[k.alias(f"k{i}") for i, k in enumerate(order)], _text(x).alias("v"))), not down)
            agg = F.call_function("array_join", F.transform(packed, lambda s: s["v"]) if order else F.collect_list(_text(x)), delimiter)
        else:
            kind = df.select(x).schema[0].dataType
            agg = self._aggregate(_ITER[f], x.cast("long") if isinstance(kind, T.BooleanType) else x, kind)
        return leaves.add((f, repr(a), ctx_key(ctx)), lambda: df, ctx.keys, agg)

    # --- row context

    def row(self, e, df: DataFrame, t: str | None, ctx: Context) -> tuple[DataFrame, Column]:
        """e for each row of df: (df with helper columns joined, Column)."""
        kind = e[0]
        if kind == "col":
            name = q(*self.m.column(e[1], e[2]))
            if name not in df.columns:
                raise KeyError(f"{name} is not in this row; use RELATED")
            return df, col(name)
        if kind == "ref":
            if e[1].casefold() in self.m.measures:
                return self._transition(self.m.measures[e[1].casefold()], df, t, ctx)
            found = [c for c in df.columns if c.casefold().endswith(f"[{e[1]}]".casefold())]
            return df, col(found[0])
        if kind == "value":
            return df, F.lit(e[1])
        if kind == "default":
            return df, F.lit(None)
        if kind == "name" and e[1].lower() in ctx.names:
            return self.row(ctx.names[e[1].lower()], df, t, ctx)
        if kind == "var":
            return self.row(e[2], df, t, replace(ctx, names=_bind(ctx.names, e[1])))
        if kind == "un":
            df, x = self.row(e[2], df, t, ctx)
            return df, ~truthy(x) if e[1] == "!" else -x if e[1] == "-" else x
        if kind == "bin" and e[1] == "in":
            left = e[2][1] if e[2][0] == "tuple" else [e[2]]
            return self._contains(e[3], left, df, t, ctx)
        if kind == "bin":
            df, x = self.row(e[2], df, t, ctx)
            df, y = self.row(e[3], df, t, ctx)
            return df, _operate(e[1], x, y)
        if kind != "call":
            raise ValueError("a value is needed")
        f, a = e[1], e[2]
        if f == "RELATED":
            want = self.m.column(a[0][1], a[0][2])
            return self.attach(df, t, [want], ctx), col(q(*want))
        if f == "CALCULATE" or f == "COUNTROWS" and a[0][0] == "call" and a[0][1] == "RELATEDTABLE":
            return self._transition(e, df, t, ctx)
        if f in _ITER and a[0][0] == "call" and a[0][1] == "RELATEDTABLE":
            return self._transition(e, df, t, ctx)
        if f == "COUNTROWS" and a[0][0] == "call" and a[0][1] == "FILTER" and any(x[0] == "call" and x[1] == "EARLIER" for x in _walk(a[0][2][1])):
            return df, self._earlier(a[0][2][1], df)
        if f in _AGGS or f in _ITER or f in ("COUNTROWS", "CONCATENATEX"):  # no transition: one value for all rows
            one = self.frame([("__c", e)], replace(ctx, keys=()), None).withColumnRenamed("__c", name := f"__c{len(df.columns)}")
            return df.crossJoin(one), F.col(name)
        if f == "LOOKUPVALUE":
            return self._lookup(a, df, t, ctx)
        if f == "CONTAINSROW":
            return self._contains(a[0], a[1:], df, t, ctx)
        if f == "EARLIER":
            raise ValueError("EARLIER needs an outer row")
        if f == "ISINSCOPE":
            return df, F.lit(False)
        out = []
        for x in a:
            df, y = self.row(x, df, t, ctx)
            out.append(y)
        return df, _plain(f, out)

    def _transition(self, e, df: DataFrame, t: str | None, ctx: Context) -> tuple[DataFrame, Column]:
        """A measure for each row: evaluated for all distinct rows of the iterated columns and joined back."""
        own = tuple((c.split("[")[0], c.split("[", 1)[1][:-1]) for c in df.columns if "[" in c and c.split("[")[0] in self.m.tables)
        keys = tuple(dict.fromkeys((*ctx.keys, *own)))
        name = f"__m{len(df.columns)}"
        if not own:  # rows of a literal table filter nothing
            one = self.frame([(name, e)], ctx, None)
            return _null_safe(df, one, [q(*k) for k in ctx.keys], "left") if ctx.keys else df.crossJoin(one), F.col(name)
        got = self.frame([(name, e)], replace(ctx, keys=keys), own[0][0] if t is None else t)
        return _null_safe(df, got, [q(*k) for k in keys], "left"), F.col(name)

    def _earlier(self, cond, df: DataFrame) -> Column:
        """COUNTROWS(FILTER(T, ...EARLIER...)) as a window: equalities partition, one comparison orders."""
        parts = []

        def split(x):
            if x[0] == "bin" and x[1] == "&&":
                split(x[2])
                split(x[3])
            else:
                parts.append(x)

        split(cond)
        by, order = [], None
        for op, a, b in [(p[1], p[2], p[3]) for p in parts]:
            if a[0] == "call":
                a, b, op = b, a, {"<": ">", ">": "<", "<=": ">=", ">=": "<="}.get(op, op)
            x = col(q(*self.m.column(a[1], a[2])))
            if op == "=":
                by.append(x)
            elif order is None:
                order = (op, x)
            else:
                raise ValueError("one comparison with EARLIER is supported")
        if order is None:
            return F.count(F.lit(1)).over(Window.partitionBy(*by))
        op, x = order
        w = Window.partitionBy(*by).orderBy(x.asc() if op[0] == "<" else x.desc())
        if op in ("<", ">"):
            return F.nullif((F.rank().over(w) - 1).cast("long"), F.lit(0))
        return F.count(F.lit(1)).over(w.rangeBetween(Window.unboundedPreceding, Window.currentRow))

    def _lookup(self, a, df: DataFrame, t, ctx: Context) -> tuple[DataFrame, Column]:
        rt, rc = self.m.column(a[0][1], a[0][2])
        pairs, other = a[1:], None
        if len(pairs) % 2:
            other, pairs = pairs[-1], pairs[:-1]
        cols = [self.m.column(x[1], x[2])[1] for x in pairs[::2]]
        k = len(df.columns)
        side = self.m.tables[rt].groupBy(*[F.col(f"`{c}`").alias(f"__l{k}_{i}") for i, c in enumerate(cols)]).agg(F.min(f"`{rc}`").alias(f"__lo{k}"), F.max(f"`{rc}`").alias(f"__hi{k}"))
        on = []
        for i, x in enumerate(pairs[1::2]):
            df, y = self.row(x, df, t, ctx)
            on.append(y.eqNullSafe(F.col(f"__l{k}_{i}")))
        df = df.join(side, reduce(lambda x, y: x & y, on), "left").drop(*[f"__l{k}_{i}" for i in range(len(cols))])
        alt = F.lit(None)
        if other is not None:
            df, alt = self.row(other, df, t, ctx)
        lo, hi = F.col(f"__lo{k}"), F.col(f"__hi{k}")
        return df, F.when(~lo.eqNullSafe(hi), F.raise_error(F.lit("LOOKUPVALUE found several values"))).when(lo.isNull(), alt).otherwise(lo)

    def _contains(self, table, values, df: DataFrame, t, ctx: Context) -> tuple[DataFrame, Column]:
        out = []
        for v in values:
            df, x = self.row(v, df, t, ctx)
            out.append(x)
        if table[0] == "rows":
            if any(len(r) != len(out) for r in table[1]):
                raise ValueError("the numbers of columns differ")
            hit = [reduce(lambda x, y: x & y, [a.eqNullSafe(self.row(b, df, t, ctx)[1]) for a, b in zip(out, r)]) for r in table[1]]
            return df, reduce(lambda x, y: x | y, hit, F.lit(False))
        rows = self.table(table, replace(ctx, keys=()))
        if len(rows.columns) != len(out):
            raise ValueError("the numbers of columns differ")
        k = len(df.columns)
        side = rows.distinct().toDF(*[f"__i{k}_{i}" for i in range(len(out))]).withColumn(f"__in{k}", F.lit(True))
        on = reduce(lambda x, y: x & y, [a.eqNullSafe(F.col(f"__i{k}_{i}")) for i, a in enumerate(out)])
        return df.join(side, on, "left").drop(*[f"__i{k}_{i}" for i in range(len(out))]), F.coalesce(F.col(f"__in{k}"), F.lit(False))


def ctx_key(ctx: Context):
    return (tuple((f.columns, f.table, id(f.keep)) for f in ctx.filters), ctx.use, ctx.cross)


def _bind(names: dict, bound) -> dict:
    return names | dict(bound)


def _walk(e, model: Model | None = None):
    """The parts of an expression, measures followed where a model is given."""
    if isinstance(e, tuple) and e:
        if isinstance(e[0], str):
            yield e
            if model and e[0] == "ref" and e[1].casefold() in model.measures:
                yield from _walk(model.measures[e[1].casefold()], model)
        for x in e[1:]:
            if isinstance(x, (tuple, list)):
                for y in [x] if isinstance(x, tuple) else x:
                    for z in [y] if isinstance(y, tuple) else y if isinstance(y, list) else []:
                        yield from _walk(z, model)


def truthy(x: Column) -> Column:
    return F.coalesce(x.cast("boolean"), F.lit(False))


def _text(x: Column) -> Column:
    """Text of a value; whole numbers without a fraction, blank as nothing."""
    s = x.cast("string")
    return F.coalesce(F.regexp_replace(s, r"^(-?\d+)\.0$", "$1"), F.lit(""))


def _operate(op: str, x: Column, y: Column) -> Column:
    zero = lambda v: F.coalesce(v, F.lit(0))  # noqa: E731  blank counts as 0 in arithmetic
    if op in ("&&", "||"):
        return truthy(x) & truthy(y) if op == "&&" else truthy(x) | truthy(y)
    if op == "&":
        return F.concat(_text(x), _text(y))
    if op in ("+", "-"):
        both = x.isNull() & y.isNull()
        a, b = zero(x.cast("double")), zero(y.cast("double"))
        return F.when(~both, a + b if op == "+" else a - b)
    if op == "*":
        return x.cast("double") * y.cast("double")
    if op == "/":
        return F.try_divide(x.cast("double"), y.cast("double"))
    blank = lambda a, b: F.when(a.isNull() & b.isNotNull(), b.cast("string").isin("0", "0.0", "false", "")).when(a.isNotNull() & b.isNull(), a.cast("string").isin("0", "0.0", "false", ""))
    if op in ("=", "<>"):
        same = F.coalesce(blank(x, y), x.eqNullSafe(y))
        return same if op == "=" else ~same
    found = {"<": x < y, "<=": x <= y, ">": x > y, ">=": x >= y}[op]
    near = {"<": zero(x.cast("string").try_cast("double")) < zero(y.cast("string").try_cast("double")), "<=": zero(x.cast("string").try_cast("double")) <= zero(y.cast("string").try_cast("double")), ">": zero(x.cast("string").try_cast("double")) > zero(y.cast("string").try_cast("double")), ">=": zero(x.cast("string").try_cast("double")) >= zero(y.cast("string").try_cast("double"))}[op]
    return F.coalesce(found, near)


def _plain(f: str, a: list[Column]) -> Column:
    """Functions of values only."""
    if f == "IF":
        return F.when(truthy(a[0]), a[1]).otherwise(a[2] if len(a) > 2 else F.lit(None))
    if f == "ISBLANK":
        return a[0].isNull()
    if f == "BLANK":
        return F.lit(None)
    if f in ("TRUE", "FALSE"):
        return F.lit(f == "TRUE")
    if f == "NOT":
        return ~truthy(a[0])
    if f in ("AND", "OR"):
        return truthy(a[0]) & truthy(a[1]) if f == "AND" else truthy(a[0]) | truthy(a[1])
    if f == "DIVIDE":
        return F.coalesce(F.try_divide(a[0].cast("double"), a[1].cast("double")), a[2] if len(a) > 2 else F.lit(None))
    if f == "COALESCE":
        return F.coalesce(*a)
    raise ValueError(f"{f} is not known")
