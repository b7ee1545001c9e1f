"""Tables that a session registers and queries with SQL."""

from __future__ import annotations

import os
import re
import time
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pantry.plans.errors import CatalogError

ROW_CAP = 10_000
_NAME = re.compile(r"[A-Za-z_][A-Za-z0-9_]{0,62}")
#: Nodes of a parsed query that only read; all others are refused.
_NODES = {
    "Project", "Filter", "Aggregate", "Sort", "GlobalLimit", "LocalLimit", "Offset", "Tail", "Join", "LateralJoin", "Union", "Intersect", "Except", "Distinct", "SubqueryAlias", "UnresolvedRelation",
    "UnresolvedWith", "UnresolvedHaving", "OneRowRelation", "Generate", "Window", "WithWindowDefinition", "UnresolvedInlineTable", "UnresolvedSubqueryColumnAliases", "Pivot", "Unpivot", "UnpivotTransformer",
    "Sample", "UnresolvedTableValuedFunction", "UnresolvedTVFAliases", "UnresolvedHint", "GroupingSets", "Values", "LocalRelation", "UnresolvedOrdinal",
}
_TABLE_FUNCTIONS = {"range", "explode", "explode_outer", "posexplode", "posexplode_outer", "inline", "inline_outer", "stack"}
#: Functions that reach beyond the rows they are given.
_REFUSED_FUNCTIONS = {"java_method", "reflect", "try_reflect", "read_files", "input_file_name", "input_file_block_start", "input_file_block_length", "getenv", "ai_query", "http_request"}


@dataclass
class QueryResult:
    columns: list[str]
    rows: list[dict]
    truncated: bool


class Workspace:
    """Named tables of one owner, with a life that use prolongs."""

    def __init__(self, spark: SparkSession, name: str = "main", ttl_s: float = 3600, clock=time.time):
        self.spark, self.prefix, self.ttl, self.clock = spark, f"ws_{name}_", ttl_s, clock
        self.tables: dict[str, float] = {}

    def _touch(self, name: str) -> str:
        self.expire()
        if name not in self.tables:
            raise CatalogError("not_found", f"no table {name}", table=name)
        self.tables[name] = self.clock() + self.ttl
        return self.prefix + name

    def expire(self) -> None:
        for name in [n for n, end in self.tables.items() if end < self.clock()]:
            self.drop(name)

    def register(self, name: str, rows: list[dict] | DataFrame, schema=None) -> DataFrame:
        """Rows become a table; without a schema columns and types come from all rows, and every column may be null."""
        if not _NAME.fullmatch(name):
            raise CatalogError("invalid_input", "a table name is letters, digits and underscores", table=name)
        if not isinstance(rows, DataFrame):
            if schema is None:
                names = list(dict.fromkeys(k for r in rows for k in r))
                sample = [tuple(r.get(n) for n in names) for r in rows]
                df = self.spark.createDataFrame(sample, names, samplingRatio=None) if sample else self.spark.createDataFrame([], "empty string")
            else:
                df = self.spark.createDataFrame(rows, schema)
        else:
            df = rows
        df.createOrReplaceTempView(self.prefix + name)
        self.tables[name] = self.clock() + self.ttl
        return df

    def check(self, sql: str) -> None:
        """Only one SELECT over registered tables passes; everything is judged by the parsed tree, not by the text."""
        try:
            plan = self.spark._jsparkSession.sessionState().sqlParser().parsePlan(sql)
        except Exception as e:
            raise CatalogError("invalid_input", f"the query cannot be parsed: {str(e).splitlines()[0][:200]}", sql=sql) from None

        def refuse(why: str) -> None:
            raise CatalogError("invalid_input", why, sql=sql)

        def each(seq):
            return [seq.apply(i) for i in range(seq.size())]

        def expression(e, known: frozenset[str]) -> None:
            kind = e.getClass().getSimpleName()
            if kind == "UnresolvedFunction":
                name = [str(x).lower() for x in each(e.nameParts())]
                if len(name) > 1 or name[0] in _REFUSED_FUNCTIONS:
                    refuse(f"the function {'.'.join(name)} is not allowed")
            if hasattr(e, "plan") and kind in ("ScalarSubquery", "Exists", "ListQuery", "LateralSubquery", "FunctionTableSubqueryArgumentExpression"):
                walk(e.plan(), known)
            for x in each(e.children()):
                expression(x, known)

        def walk(node, known: frozenset[str]) -> None:
            kind = node.getClass().getSimpleName()
            if kind not in _NODES:
                refuse(f"only SELECT is allowed ({kind})")
            if kind == "UnresolvedRelation":
                name = [str(x).lower() for x in each(node.multipartIdentifier())]
                if len(name) > 1 or name[0] not in known:
                    refuse(f"no registered table {'.'.join(name)}")
            if kind == "UnresolvedTableValuedFunction":
                name = [str(x).lower() for x in each(node.name())]
                if len(name) > 1 or name[0] not in _TABLE_FUNCTIONS:
                    refuse(f"the table function {'.'.join(name)} is not allowed")
            if kind == "UnresolvedWith":  # a name holds for the queries after it and for the body
                for relation in each(node.cteRelations()):
                    walk(relation._2(), known)
                    known = known | {str(relation._1()).lower()}
            for x in each(node.children()):
                walk(x, known)
            for e in each(node.expressions()):
                expression(e, known)

        walk(plan, frozenset(n.lower() for n in self.tables))

    def frame(self, sql: str) -> DataFrame:
        """The query over this workspace's tables. Views of the session with the same names are put back afterwards."""
        self.expire()
        self.check(sql)
        names = {n: self.spark.table(self._touch(n)) for n in list(self.tables) if re.search(rf"\b{re.escape(n)}\b", sql, re.I)}
        before = {t.name: self.spark.table(t.name) for t in self.spark.catalog.listTables() if t.isTemporary and t.name in names}
        for n, df in names.items():
            df.createOrReplaceTempView(n)
        try:
            return self.spark.sql(sql)
        finally:
            for n in names:
                if n in before:
                    before[n].createOrReplaceTempView(n)
                else:
                    self.spark.catalog.dropTempView(n)

    def query(self, sql: str, cap: int = ROW_CAP, register_as: str | None = None) -> QueryResult:
        """At most ``cap`` rows and whether there are more; register_as keeps the whole result as a table."""
        df = self.frame(sql)
        if register_as:
            self.register(register_as, df)
        rows = df.limit(cap + 1).collect()
        return QueryResult(df.columns, [r.asDict(recursive=True) for r in rows[:cap]], len(rows) > cap)

    def view(self, name: str, sql: str) -> DataFrame:
        return self.register(name, self.frame(sql))

    def describe(self) -> dict[str, list[tuple[str, str]]]:
        self.expire()
        return {n: self.spark.table(self.prefix + n).dtypes for n in self.tables}

    def drop(self, name: str) -> bool:
        return self.tables.pop(name, None) is not None and self.spark.catalog.dropTempView(self.prefix + name)

    def clear(self) -> None:
        for n in list(self.tables):
            self.drop(n)

    def take_from(self, other: "Workspace", name: str, as_name: str | None = None) -> DataFrame:
        return self.register(as_name or name, self.spark.table(other._touch(name)))

    def export(self, name: str, folder: str, kind: str, root: str) -> str:
        """Writes a table as csv, json or parquet below ``root``."""
        if kind not in ("csv", "json", "parquet"):
            raise CatalogError("invalid_input", "a table is exported as csv, json or parquet", kind=kind)
        path = os.path.normpath(os.path.join(root, folder))
        if not path.startswith(os.path.normpath(root) + os.sep):
            raise CatalogError("invalid_input", "the path leaves the export folder", path=folder)
        writer = self.spark.table(self._touch(name)).write.mode("overwrite")
        (writer.option("header", True).csv if kind == "csv" else getattr(writer, kind))(path)
        return path


    def spill(self, name: str, df: DataFrame, budget: int) -> tuple[list[dict], str | None]:
        """The first rows whose JSON fits in a budget of characters, and the name of the table that holds all when these are not all.

        Rows come one partition at a time and no more of them than the budget takes; the rest stays in the cluster.
        """
        used, out = 0, []
        for row in df.withColumn("_json", F.to_json(F.struct(*df.columns))).toLocalIterator():
            used += len(row["_json"])
            if used > budget:
                self.register(name, df)
                return out, name
            out.append({c: row[c] for c in df.columns})
        return out, None
