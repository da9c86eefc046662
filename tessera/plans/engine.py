"""The engine: a catalog of versioned Parquet tables and the statements that read and change them.

A table is a list of Parquet folders under the engine's root; an insert adds one, an update or delete writes a new
one in place of all. Folders are never changed, and the catalog's file is replaced as a whole after a statement's data are
written, so a statement takes effect at once or not at all. BEGIN and END TRANSACTION hold back that replacement; an
error within goes back to the state at BEGIN. Indexes are derived folders that are built anew when their table changes.
"""

from __future__ import annotations

import copy
import json
import time
import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.errors import QueryError
from tessera.functions import spatial as sx
from tessera.functions import vector as vx
from tessera.operators import relational
from tessera.operators.knn import IvfIndex
from tessera.operators.search import TextIndex
from tessera.operators.spatial import GridIndex
from tessera.plans import ast, parser
from tessera.plans.compiler import LITERAL_TYPES, Compiler, Table
from tessera.sources import csv, media, rows
from tessera.types import INTEGER_RANGES, NUMBERS, SPATIAL, STRINGS, Column, Schema

#: Column types that an index kind takes.
INDEX_TYPES = {"RTREE": SPATIAL, "GIN": STRINGS, "SPIMI": STRINGS, "IVF": STRINGS | {"BYTEA"}, "HNSW": STRINGS | {"BYTEA"}}


@dataclass
class Result:
    """What a statement gives: rows, or a number of rows changed and a message."""

    rows: DataFrame | None = None
    changed: int = 0
    message: str = ""


@dataclass
class _State:
    tables: dict[str, dict] = field(default_factory=dict)
    indexes: dict[str, dict] = field(default_factory=dict)


class Engine:
    """A database under a folder that Spark can write to."""

    def __init__(self, spark: SparkSession, root: str, stop: tuple[str, ...] = ()):
        self.spark, self.root, self.stop = spark, root.rstrip("/"), tuple(stop)
        self.state = self._load()
        self.saved: _State | None = None

    # ---- the catalog's file

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def _load(self) -> _State:
        fs, p = self._fs(f"{self.root}/_catalog.json")
        if not fs.exists(p):
            return _State()
        stream = fs.open(p)
        try:
            text = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return _State(**json.loads(text))

    def _save(self) -> None:
        if self.saved is not None:
            return
        fs, p = self._fs(f"{self.root}/_catalog.json")
        _, new = self._fs(f"{self.root}/_catalog.new")
        out = fs.create(new, True)
        out.write(json.dumps(self.state.__dict__).encode())
        out.close()
        if fs.exists(p):
            fs.delete(p, False)
        fs.rename(new, p)

    # ---- tables

    def schema(self, table: str) -> Schema:
        if table not in self.state.tables:
            raise QueryError(f"there is no table {table}")
        return Schema(table, tuple(Column(**c) for c in self.state.tables[table]["columns"]))

    def table(self, table: str) -> Table:
        schema = self.schema(table)
        paths = self.state.tables[table]["paths"]
        df = self.spark.read.schema(schema.struct).parquet(*paths) if paths else self.spark.createDataFrame([], schema.struct)
        kinds: dict[str, dict[str, str]] = {}
        for x in self.state.indexes.values():
            if x["table"] == table:
                kinds.setdefault(x["column"], {})[x["kind"]] = x["path"]
        return Table(schema, df, kinds)

    def read(self, table: str) -> DataFrame:
        return self.table(table).rows

    def _write(self, table: str, df: DataFrame, replace: bool) -> None:
        meta = self.state.tables[table]
        path = f"{self.root}/{table}/{uuid.uuid4().hex}"
        key = self.schema(table).key
        if meta["storage"] == "SEQUENTIAL" and key:
            df = df.repartitionByRange(F.col(f"`{key.name}`")).sortWithinPartitions(f"`{key.name}`")
        df.write.parquet(path)
        meta["paths"] = [path] if replace else [*meta["paths"], path]
        for name in [n for n, x in self.state.indexes.items() if x["table"] == table]:
            self._build(name)

    def compact(self, table: str) -> None:
        """All of a table's folders as one."""
        self._write(table, self.read(table), True)
        self._save()

    def system(self, name: str) -> DataFrame:
        """sys_tables, sys_columns or sys_indexes."""
        if name == "sys_tables":
            return self.spark.createDataFrame([(t, m["storage"]) for t, m in self.state.tables.items()], "table_name string, storage string")
        if name == "sys_columns":
            return self.spark.createDataFrame([(t, i, c["name"], c["type"], c["size"], c["primary_key"], c["nullable"], c["unique"]) for t, m in self.state.tables.items() for i, c in enumerate(m["columns"])], "table_name string, position int, column_name string, type string, size int, primary_key boolean, nullable boolean, is_unique boolean")
        return self.spark.createDataFrame([(n, x["table"], x["column"], x["kind"]) for n, x in self.state.indexes.items()], "index_name string, table_name string, column_name string, kind string")

    # ---- statements

    def execute(self, text: str) -> Result:
        return self._guarded(parser.parse, text, lambda s: self._run(s))

    def execute_many(self, text: str) -> list[Result]:
        return self._guarded(parser.parse_many, text, lambda many: [self._run(s) for s in many])

    def query(self, text: str) -> DataFrame:
        found = self.execute(text).rows
        if found is None:
            raise QueryError("the statement gives no rows")
        return found

    def _guarded(self, parse, text: str, run):
        try:
            return run(parse(text))
        except Exception:
            if self.saved is not None:
                self.state, self.saved = self.saved, None
            raise

    def _run(self, s) -> Result:
        if isinstance(s, ast.Select):
            return Result(Compiler(self.table, self.stop).select(s))
        if isinstance(s, ast.Explain):
            return Result(self.explain(s))
        if isinstance(s, ast.Transaction):
            return self._transaction(s.begin)
        before = copy.deepcopy(self.state)
        try:
            out = {ast.CreateTable: self._create_table, ast.DropTable: self._drop_table, ast.CreateIndex: self._create_index, ast.DropIndex: self._drop_index, ast.Insert: self._insert, ast.Update: self._update, ast.Delete: self._delete}[type(s)](s)
        except Exception:
            self.state = before
            raise
        self._save()
        return out

    def _transaction(self, begin: bool) -> Result:
        if begin:
            if self.saved is not None:
                raise QueryError("a transaction is open")
            self.saved = copy.deepcopy(self.state)
            return Result(message="BEGIN")
        if self.saved is None:
            raise QueryError("no transaction is open")
        self.saved = None
        self._save()
        return Result(message="END")

    def explain(self, s: ast.Explain) -> DataFrame:
        """The formatted plan; with ANALYZE, after a run, with its rows and seconds."""
        df = Compiler(self.table, self.stop).select(s.select)
        notes = []
        if s.analyze:
            began = time.perf_counter()
            notes = [f"rows: {df.count()}", f"seconds: {time.perf_counter() - began:.3f}"]
        plan = df._jdf.queryExecution().explainString(self.spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
        return self.spark.createDataFrame([(x,) for x in [*notes, *plan.split("\n")]], "plan string")

    def _create_table(self, s: ast.CreateTable) -> Result:
        if s.table in self.state.tables or s.table.startswith("sys_"):
            raise QueryError(f"there is a table {s.table}")
        schema = Schema(s.table, s.columns)
        if s.storage == "SEQUENTIAL" and schema.key is None:
            raise QueryError("SEQUENTIAL storage needs a primary key")
        self.state.tables[s.table] = {"columns": [c.__dict__ for c in s.columns], "storage": s.storage, "paths": []}
        return Result(message=f"CREATE TABLE {s.table}")

    def _drop_table(self, s: ast.DropTable) -> Result:
        self.schema(s.table)
        del self.state.tables[s.table]
        self.state.indexes = {n: x for n, x in self.state.indexes.items() if x["table"] != s.table}
        return Result(message=f"DROP TABLE {s.table}")

    def _create_index(self, s: ast.CreateIndex) -> Result:
        if s.name in self.state.indexes:
            raise QueryError(f"there is an index {s.name}")
        column = self.schema(s.table).column(s.column)
        if column.type not in INDEX_TYPES.get(s.kind, set(NUMBERS | STRINGS | {"DATE", "TIME", "TIMESTAMP", "BOOLEAN"})):
            raise QueryError(f"{s.kind} does not index {column.type}")
        if any(x["table"] == s.table and x["column"] == s.column and x["kind"] == s.kind for x in self.state.indexes.values()):
            raise QueryError(f"{s.table}.{s.column} has a {s.kind} index")
        self.state.indexes[s.name] = {"table": s.table, "column": s.column, "kind": s.kind, "path": ""}
        self._build(s.name)
        return Result(message=f"CREATE INDEX {s.name}")

    def _build(self, name: str) -> None:
        """Writes an index's derived table: a new folder, so that readers of the old one are not disturbed."""
        x = self.state.indexes[name]
        t = self.table(x["table"])
        x["path"] = path = f"{self.root}/_indexes/{name}/{uuid.uuid4().hex}"
        c, key = f"`{x['column']}`", t.schema.key
        if x["kind"] in ("GIN", "SPIMI"):
            if key is None:
                raise QueryError(f"{x['kind']} needs a primary key")
            TextIndex.build(t.rows, key.name, x["column"], path, self.stop)
        elif x["kind"] == "RTREE":
            kind = t.schema.column(x["column"]).type
            at = {"POINT": F.col(c), "GEOMETRY": F.col(f"{c}.centroid")}.get(kind)
            at = at if at is not None else sx.rectangle_centroid(F.col(c)) if kind == "RECTANGLE" else sx.ring_centroid(F.col(c))
            GridIndex.build(t.rows.where(F.col(c).isNotNull()).withColumn("_lon", at["lon"]).withColumn("_lat", at["lat"]), "_lon", "_lat", path)
        elif x["kind"] in ("IVF", "HNSW"):
            raw = F.col(c)
            v = vx.from_bytes(raw) if t.schema.column(x["column"]).type == "BYTEA" else vx.from_json(raw)
            held = t.rows.withColumn("_v", v).where(vx.usable(F.col("_v")))
            n = held.count()
            if x["kind"] == "IVF" and n > 1:
                IvfIndex.build(held, "_v", path, lists=min(16, n))
            elif x["kind"] == "HNSW" and n:
                # an exact scan serves HNSW: its table holds the decoded vectors
                held.write.parquet(path)
            else:
                x["path"] = ""  # too few vectors for cells
        else:
            t.rows.repartitionByRange(F.col(c)).sortWithinPartitions(c).write.parquet(path)

    def _drop_index(self, s: ast.DropIndex) -> Result:
        if self.state.indexes.pop(s.name, None) is None and not s.if_exists:
            raise QueryError(f"there is no index {s.name}")
        return Result(message=f"DROP INDEX {s.name}")

    # ---- rows

    def _cell(self, v: ast.Literal, c: Column) -> object:
        if v.kind == "null":
            return None
        if c.type not in LITERAL_TYPES[v.kind]:
            raise QueryError(f"{c.name} is {c.type}, which a {v.kind} does not fit")
        if c.type in INTEGER_RANGES and (not isinstance(v.value, int) or not -INTEGER_RANGES[c.type] <= v.value < INTEGER_RANGES[c.type]):
            raise QueryError(f"{v.value} is no {c.type}")
        if c.type in ("REAL", "DOUBLE PRECISION"):
            return float(v.value)
        if c.type == "NUMERIC":
            from decimal import Decimal

            return Decimal(str(v.value))
        if c.type in ("DATE", "TIMESTAMP") and v.kind == "text":
            from datetime import date, datetime

            try:
                return (date if c.type == "DATE" else datetime).fromisoformat(v.value)
            except ValueError:
                raise QueryError(f"{v.value!r} is no {c.type}") from None
        if c.type in ("CHAR", "VARCHAR") and len(v.value) > c.size:
            raise QueryError(f"{c.name} holds {c.size} characters")
        if c.type == "GEOMETRY":
            return self._geometry(v)
        return v.value

    def _geometry(self, v: ast.Literal) -> tuple:
        centre = parser._centroid(v)
        return (v.kind.upper(), v.value if v.kind == "point" else None, v.value if v.kind == "rectangle" else None, v.value if v.kind == "polygon" else None, centre)

    def _insert(self, s: ast.Insert) -> Result:
        schema = self.schema(s.table)
        names = s.columns or tuple(c.name for c in schema.columns)
        if len(set(names)) < len(names):
            raise QueryError("a column is named twice")
        columns = [schema.column(n) for n in names]
        out = []
        for r in s.rows:
            if len(r) != len(columns):
                raise QueryError(f"{len(columns)} values are needed, not {len(r)}")
            given = {c.name: self._cell(v, c) for c, v in zip(columns, r, strict=True)}
            out.append(tuple(given.get(c.name) for c in schema.columns))
        return self.insert(s.table, self.spark.createDataFrame(out, schema.struct))

    def insert(self, table: str, df: DataFrame) -> Result:
        """Appends rows that keep the table's constraints."""
        schema = self.schema(table)
        self._constrain(schema, df, self.read(table))
        n = df.count()
        self._write(table, df, False)
        self._save()
        return Result(changed=n)

    def insert_dicts(self, table: str, given: list[dict]) -> Result:
        return self.insert(table, rows.from_dicts(self.spark, self.schema(table), given))

    def _constrain(self, schema: Schema, new: DataFrame, old: DataFrame | None) -> None:
        """Not null, lengths, and unique columns; nulls are exempt from uniqueness."""
        checks = [F.count(F.when(F.col(f"`{c.name}`").isNull(), 1)).alias(f"n{i}") for i, c in enumerate(schema.columns) if not c.nullable]
        checks += [F.count(F.when(F.length(f"`{c.name}`") > c.size, 1)).alias(f"l{i}") for i, c in enumerate(schema.columns) if c.type in ("CHAR", "VARCHAR")]
        if checks:
            for k, v in new.agg(*checks).first().asDict().items():
                if v:
                    raise QueryError(f"{schema.columns[int(k[1:])].name} {'is null' if k[0] == 'n' else 'is too long'} in {v} rows")
        for c in schema.columns:
            if c.unique:
                own = new.select(F.col(f"`{c.name}`"))
                if relational.duplicates(own, [c.name]).take(1) or (old is not None and relational.semi_join(own.dropna(), old.select(F.col(f"`{c.name}`")), c.name).take(1)):
                    raise QueryError(f"{c.name} must be unique")

    def _update(self, s: ast.Update) -> Result:
        t = self.table(s.table)
        c = t.schema.column(s.column)
        compiler = Compiler(self.table, self.stop)
        tables = {s.table: t}
        if isinstance(s.where, (ast.Match, ast.Similar)):
            raise QueryError("a search selects only")
        hit = F.coalesce(compiler.predicate(t.rows, s.where, tables), F.lit(False))
        if isinstance(s.value, ast.Name):
            if compiler._type(s.value, tables) != c.type:
                raise QueryError(f"{s.value} is not {c.type}")
            value = compiler._col(s.value, tables, t.rows)
        else:
            one = self.spark.createDataFrame([(self._cell(s.value, c),)], Schema(s.table, (Column("_new", c.type, c.size),)).struct)
            value = F.col("_new")
        base = t.rows.crossJoin(F.broadcast(one)) if not isinstance(s.value, ast.Name) else t.rows
        new = base.withColumn("_hit", hit).select(*[(F.when(F.col("_hit"), value).otherwise(F.col(f"`{x.name}`")).alias(x.name) if x.name == c.name else F.col(f"`{x.name}`")) for x in t.schema.columns])
        n = t.rows.where(hit).count()
        if n:
            self._constrain(t.schema, new, None)
            self._write(s.table, new, True)
        return Result(changed=n)

    def _delete(self, s: ast.Delete) -> Result:
        t = self.table(s.table)
        if isinstance(s.where, (ast.Match, ast.Similar)):
            raise QueryError("a search selects only")
        hit = F.coalesce(Compiler(self.table, self.stop).predicate(t.rows, s.where, {s.table: t}), F.lit(False)) if s.where is not None else F.lit(True)
        n = t.rows.where(hit).count()
        if n:
            self._write(s.table, t.rows.where(~hit), True)
        return Result(changed=n)

    # ---- imports and searches

    def import_csv(self, table: str, path: str, types: dict[str, str] | None = None, on_error: str = "stop", primary_key: str | None = None) -> csv.Loaded:
        """A new table from a CSV file; nothing is left if it fails."""
        loaded = csv.load(self.spark, path, types, on_error)
        columns = []
        for n, spec in loaded.types.items():
            kind, _, size = spec.rstrip(")").partition("(")
            columns.append(Column(n, kind, int(size) if size else None, n == primary_key))
        before = copy.deepcopy(self.state)
        try:
            self._create_table(ast.CreateTable(table, tuple(columns)))
            self.insert(table, loaded.rows.select(*[F.col(f"`{c.name}`") for c in columns]))
        except Exception:
            self.state = before
            raise
        return loaded

    def import_folder(self, table: str, folder: str, kind: str) -> DataFrame:
        """A new table from a folder of media or text; gives the files left out."""
        found, skipped = media.load(self.spark, folder, kind)
        columns = (Column("id", "INTEGER", primary_key=True), *((Column("titulo", "VARCHAR", 300), Column("contenido", "TEXT")) if kind == "text" else (Column("nombre", "VARCHAR", 300), Column("ruta", "VARCHAR", 1000))))
        before = copy.deepcopy(self.state)
        try:
            self._create_table(ast.CreateTable(table, columns))
            self.insert(table, found.select(*[c.name for c in columns]))
        except Exception:
            self.state = before
            raise
        return skipped

    def vector_search(self, table: str, column: str, target: list[float], k: int, metric: str = "cosine", n_probe: int | None = None) -> DataFrame:
        """The k nearest rows with distance and score, through the column's IVF index if it has one."""
        from tessera.operators import knn

        t = self.table(table)
        key = t.schema.key.name if t.schema.key else None
        if path := t.indexes.get(column, {}).get("IVF"):
            return IvfIndex(self.spark, path, "_v").search(target, k, metric, n_probe, key).drop("_v")
        v = vx.from_bytes(F.col(f"`{column}`")) if t.schema.column(column).type == "BYTEA" else vx.from_json(F.col(f"`{column}`"))
        return knn.knn(t.rows.withColumn("_v", v), "_v", target, k, metric, key).drop("_v")

    def text_search(self, table: str, column: str, query: str, method: str = "bm25", k: int | None = None) -> DataFrame:
        """(key, score) through the column's stored text index."""
        t = self.table(table)
        path = t.indexes.get(column, {}).get("SPIMI") or t.indexes.get(column, {}).get("GIN")
        if not path or t.schema.key is None:
            raise QueryError(f"{table}.{column} has no text index")
        found = TextIndex(self.spark, path, self.stop).search(query, method).withColumnRenamed("doc", t.schema.key.name)
        return found.orderBy(F.col("score").desc(), t.schema.key.name).limit(k) if k else found

    def spatial_search(self, table: str, column: str, center: tuple[float, float], radius: float, metric: str = "HAVERSINE") -> DataFrame:
        """Rows within a radius through the column's RTREE index."""
        path = self.table(table).indexes.get(column, {}).get("RTREE")
        if not path:
            raise QueryError(f"{table}.{column} has no RTREE index")
        return GridIndex(self.spark, path, "_lon", "_lat", 10.0).radius(center, radius, metric).drop("_lon", "_lat")
