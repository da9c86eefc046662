"""Statements to DataFrames: checks against the tables' schemas, then declarative plans for the optimizer."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.errors import QueryError
from tessera.functions import spatial as sx
from tessera.functions import vector as vx
from tessera.operators import relational, search
from tessera.plans import ast
from tessera.types import NUMBERS, ORDERED, SPATIAL, STRINGS, Schema

LITERAL_TYPES = {"number": NUMBERS, "text": STRINGS | {"DATE", "TIME", "TIMESTAMP"}, "boolean": {"BOOLEAN"}, "date": {"DATE"}, "time": {"TIME"}, "timestamp": {"TIMESTAMP"}, "point": {"POINT", "GEOMETRY"}, "rectangle": {"RECTANGLE", "GEOMETRY"}, "polygon": {"POLYGON", "GEOMETRY"}}


@dataclass
class Table:
    """A table's rows, with its schema, the indexes' kinds by column, and paths of stored text indexes by column."""

    schema: Schema
    rows: DataFrame
    indexes: dict[str, dict[str, str]]


class Compiler:
    """Compiles one statement over tables found by name."""

    def __init__(self, find: Callable[[str], Table], stop: tuple[str, ...] = ()):
        self.find, self.stop = find, stop

    def select(self, q: ast.Select) -> DataFrame:
        tables = {q.table: self.find(q.table)}
        if q.join:
            other, _, _ = q.join
            if other == q.table:
                raise QueryError("a table can't join itself")
            tables[other] = self.find(other)
        self._check(q, tables)
        df = tables[q.table].rows
        if q.join:
            df = self._join(q, tables)
        scores = [i for i in q.items if isinstance(i, ast.Score)]
        text_score = next((s for s in scores if s.kind == "SCORE"), None)
        if text_score:
            df = self._scored(df, q, text_score, tables)
        if isinstance(q.where, ast.Similar):
            df = self._similar(df, q, next((s for s in scores if s.kind == "SIMILARITY_SCORE"), None), tables)
        elif q.where is not None:
            df = self.filter(df, q.where, tables)
        aggregates = [i for i in q.items if isinstance(i, ast.Aggregate)]
        if aggregates:
            df = self._grouped(df, q, tables)
        elif q.group:
            keys = [self._column(n, tables, df) for n in q.group]
            df = relational.first_row(df, keys, [F.col(f"`{c}`").asc_nulls_first() for c in df.columns if not isinstance(df.schema[c].dataType, sx_types())])
        if q.order:
            df = df.orderBy(*self._order(q, tables, df))
        if q.limit is not None:
            df = df.limit(q.limit)
        if aggregates:
            return df.select(*[F.col(f"`{i}`") if isinstance(i, ast.Aggregate) else F.col(f"`{self._column(i, tables, df)}`").alias(str(i)) for i in q.items])
        if q.star:
            own = [F.col(f"`{c}`") for t in tables for c in self._own(t, tables)]
            return df.select(*own, *[F.col(f"`{s.alias}`") for s in scores])
        return df.select(*[F.col(f"`{i.alias}`") if isinstance(i, ast.Score) else F.col(f"`{self._column(i, tables, df)}`").alias(str(i)) for i in q.items])

    # ---- names

    def _own(self, table: str, tables: dict[str, Table]) -> list[str]:
        names = [c.name for c in tables[table].schema.columns]
        return [f"{table}.{n}" for n in names] if len(tables) > 1 else names

    def _where_is(self, n: ast.Name, tables: dict[str, Table]) -> tuple[str, str]:
        """(table, column) that a name means."""
        if n.table is not None:
            if n.table not in tables:
                raise QueryError(f"table {n.table} is not in the statement")
            return n.table, tables[n.table].schema.column(n.column).name
        found = [t for t, x in tables.items() if any(c.name == n.column for c in x.schema.columns)]
        if len(found) != 1:
            raise QueryError(f"column {n.column} is {'ambiguous' if found else 'not there'}")
        return found[0], n.column

    def _type(self, n: ast.Name, tables: dict[str, Table]) -> str:
        t, c = self._where_is(n, tables)
        return tables[t].schema.column(c).type

    def _column(self, n: ast.Name, tables: dict[str, Table], df: DataFrame) -> str:
        if n.table is None and n.column in df.columns:
            return n.column
        t, c = self._where_is(n, tables)
        return f"{t}.{c}" if len(tables) > 1 else c

    def _col(self, n: ast.Name, tables: dict[str, Table], df: DataFrame) -> Column:
        return F.col(f"`{self._column(n, tables, df)}`")

    # ---- checks

    def _check(self, q: ast.Select, tables: dict[str, Table]) -> None:
        scores = [i for i in q.items if isinstance(i, ast.Score)]
        names = [s.alias for s in scores]
        aliases = set(names)
        aggregates = [i for i in q.items if isinstance(i, ast.Aggregate)]
        if sum(s.kind == "SCORE" for s in scores) > 1 or sum(s.kind == "SIMILARITY_SCORE" for s in scores) > 1:
            raise QueryError("a score can be asked for once")
        for a in names:
            if any(c.name == a for t in tables.values() for c in t.schema.columns):
                raise QueryError(f"the name {a} is a column's")
        for i in q.items:
            if isinstance(i, ast.Name):
                self._where_is(i, tables)
            elif isinstance(i, ast.Aggregate) and i.column:
                kind = self._type(i.column, tables)
                if i.function in ("SUM", "AVG") and kind not in NUMBERS:
                    raise QueryError(f"{i.function} takes numbers, and {i.column} is {kind}")
                if i.function in ("MIN", "MAX") and kind not in ORDERED:
                    raise QueryError(f"{i.function} takes an ordered type, and {i.column} is {kind}")
        for s in scores:
            if s.kind == "SIMILARITY_SCORE" and not isinstance(q.where, ast.Similar):
                raise QueryError("SIMILARITY_SCORE needs SIMILAR_TO")
            if s.kind == "SCORE" and s.column is None and not isinstance(q.where, ast.Match):
                raise QueryError("SCORE() needs MATCH, or a column and a text")
            if s.column is not None and self._type(s.column, tables) not in STRINGS:
                raise QueryError(f"SCORE takes a text column, and {s.column} is none")
        searching = isinstance(q.where, (ast.Match, ast.Similar)) or bool(scores)
        if searching and (aggregates or q.group):
            raise QueryError("a search can't be grouped")
        if searching and any(isinstance(o.by, ast.Distance) for o in q.order):
            raise QueryError("a search can't be ordered by distance")
        for o in q.order:
            if isinstance(o.by, ast.Distance):
                self._check_distance(o.by, tables)
            elif not (o.by.table is None and o.by.column in aliases):
                if self._type(o.by, tables) in SPATIAL:
                    raise QueryError(f"{o.by} has no order")
        for g in q.group:
            self._where_is(g, tables)

    def _check_distance(self, d: ast.Distance, tables: dict[str, Table]) -> None:
        for n in (d.column, d.target):
            if isinstance(n, ast.Name) and self._type(n, tables) not in SPATIAL:
                raise QueryError(f"DISTANCIA takes a spatial column, and {n} is none")

    # ---- clauses

    def _join(self, q: ast.Select, tables: dict[str, Table]) -> DataFrame:
        other, a, b = q.join
        (ta, ca), (tb, cb) = self._where_is(a, tables), self._where_is(b, tables)
        if ta == tb:
            raise QueryError("a join compares columns of both tables")
        if tables[ta].schema.column(ca).type != tables[tb].schema.column(cb).type:
            raise QueryError(f"{a} and {b} have different types")
        sides = {t: x.rows.select(*[F.col(f"`{c.name}`").alias(f"{t}.{c.name}") for c in x.schema.columns]) for t, x in tables.items()}
        return relational.equi_join(sides[q.table], sides[other], F.col(f"`{ta}.{ca}`") == F.col(f"`{tb}.{cb}`"))

    def _scored(self, df: DataFrame, q: ast.Select, s: ast.Score, tables: dict[str, Table]) -> DataFrame:
        """Scores over the whole column, whatever the filter: its statistics do not depend on other predicates."""
        column = s.column or q.where.column
        query = s.query if s.column is not None else q.where.query
        if self._type(column, tables) not in STRINGS:
            raise QueryError(f"MATCH takes a text column, and {column} is none")
        ranking = q.where.ranking if s.column is None else "bm25"
        name = self._column(column, tables, df)
        if ranking == "bm25":
            plain = df.withColumnRenamed(name, "_text") if "." in name else df
            out = search.bm25(plain, "_text" if "." in name else name, query, s.alias, self.stop)
            return out.withColumnRenamed("_text", name) if "." in name else out
        table, _ = self._where_is(column, tables)
        key = tables[table].schema.key
        if key is None:
            raise QueryError("TF_IDF needs a primary key")
        own = f"{table}.{key.name}" if len(tables) > 1 else key.name
        found = search.tfidf_cosine(df.select(F.col(f"`{own}`").alias("_key"), F.col(f"`{name}`").alias("_text")).distinct(), "_key", "_text", query, s.alias, self.stop)
        return df.join(found, F.col(f"`{own}`") == found["_key"], "left").drop("_key").withColumn(s.alias, F.coalesce(F.col(f"`{s.alias}`"), F.lit(0.0)))

    def _similar(self, df: DataFrame, q: ast.Select, s: ast.Score | None, tables: dict[str, Table]) -> DataFrame:
        w: ast.Similar = q.where
        first = tables[q.table]
        if w.column is None:
            ranked = [c.name for c in first.schema.columns if w.index in first.indexes.get(c.name, {})] or [c.name for c in first.schema.columns if c.type == "BYTEA"] or [c.name for c in first.schema.columns if c.type in STRINGS]
            column = ast.Name((ranked or [first.schema.columns[0].name])[0], q.table)
        else:
            column = w.column
        kind, name = self._type(column, tables), self._column(column, tables, df)
        try:
            target = [float(x) for x in json.loads(w.target)]
        except (ValueError, TypeError):
            raise QueryError("SIMILAR_TO takes a JSON list of numbers") from None
        # rows that hold no vector of the target's length are passed over
        raw = F.col(f"`{name}`")
        if kind == "BYTEA":
            vector = vx.from_bytes(raw)
        elif kind in STRINGS:
            vector = vx.from_json(raw)
        else:
            raise QueryError(f"SIMILAR_TO takes bytes or text, and {column} is {kind}")
        near = df.withColumn("_v", vector)
        key = first.schema.key
        own = [f"`{q.table}.{key.name}`" if len(tables) > 1 else f"`{key.name}`"] if key else []
        d = vx.distance(F.col("_v"), vx.literal(target), w.metric)
        out = near.where(vx.usable(F.col("_v"), len(target))).withColumn("_d", d).orderBy("_d", *[F.expr(o) for o in own]).limit(w.k)
        return out.withColumn(s.alias if s else "_score", vx.score(F.col("_d"), w.metric)).drop("_v", "_d")

    def filter(self, df: DataFrame, w, tables: dict[str, Table]) -> DataFrame:
        if isinstance(w, ast.Similar):
            raise QueryError("SIMILAR_TO selects only")
        if isinstance(w, ast.Match):
            if self._type(w.column, tables) not in STRINGS:
                raise QueryError(f"MATCH takes a text column, and {w.column} is none")
            name = self._column(w.column, tables, df)
            terms = sorted(set(search.query_terms(w.query, self.stop)))
            from tessera.functions import text as tx

            return df.where(F.arrays_overlap(tx.tokens(F.col(f"`{name}`"), self.stop), F.array(*map(F.lit, terms))))
        return df.where(self.predicate(df, w, tables))

    def predicate(self, df: DataFrame, w, tables: dict[str, Table]) -> Column:
        """Null never satisfies a predicate."""
        if isinstance(w, ast.Within):
            kind = self._type(w.column, tables)
            if kind not in SPATIAL:
                raise QueryError(f"DENTRO_DE takes a spatial column, and {w.column} is {kind}")
            lon, lat = self._position(w.column, tables, df)
            return sx.within_ring(lon, lat, w.ring.value)
        if isinstance(w.left, ast.Distance):
            return self._distance_predicate(df, w, tables)
        kind = self._type(w.left, tables)
        if isinstance(w.right, ast.Name):
            other = self._type(w.right, tables)
            if kind != other:
                raise QueryError(f"{w.left} is {kind} and {w.right} is {other}")
            right = self._col(w.right, tables, df)
        elif w.right.kind == "null":
            right = F.lit(None)
        else:
            if kind not in LITERAL_TYPES[w.right.kind]:
                raise QueryError(f"{w.left} is {kind}, which a {w.right.kind} can't be compared with")
            right = self._literal(w.right, kind)
        if w.op not in ("=", "!=") and kind not in ORDERED:
            raise QueryError(f"{w.left} is {kind}, which has no order")
        from tessera.operators.spatial import COMPARE

        return getattr(self._col(w.left, tables, df), COMPARE[w.op])(right)

    def _literal(self, v: ast.Literal, kind: str) -> Column:
        if v.kind == "point":
            return F.struct(F.lit(v.value[0]).alias("lon"), F.lit(v.value[1]).alias("lat"))
        if v.kind == "text" and kind in ("DATE", "TIMESTAMP"):
            return F.lit(v.value).cast("date" if kind == "DATE" else "timestamp_ntz")
        if v.kind == "timestamp":
            return F.lit(v.value.isoformat(" ")).cast("timestamp_ntz")
        return F.lit(v.value)

    def _position(self, n: ast.Name, tables: dict[str, Table], df: DataFrame) -> tuple[Column, Column]:
        """Longitude and latitude of a point, or of another shape's centroid."""
        kind, c = self._type(n, tables), self._col(n, tables, df)
        at = {"POINT": lambda: c, "RECTANGLE": lambda: sx.rectangle_centroid(c), "POLYGON": lambda: sx.ring_centroid(c), "GEOMETRY": lambda: c["centroid"]}[kind]()
        return (at["lon"], at["lat"]) if kind in ("POINT", "GEOMETRY") else (F.when(c.isNotNull(), at["lon"]), F.when(c.isNotNull(), at["lat"]))

    def _distance(self, d: ast.Distance, tables: dict[str, Table], df: DataFrame) -> Column:
        self._check_distance(d, tables)
        lon, lat = self._position(d.column, tables, df)
        to = self._position(d.target, tables, df) if isinstance(d.target, ast.Name) else tuple(map(F.lit, d.target.value))
        return sx.METRICS[d.metric](lon, lat, *to)

    def _distance_predicate(self, df: DataFrame, w: ast.Compare, tables: dict[str, Table]) -> Column:
        from tessera.operators.spatial import COMPARE

        if isinstance(w.right, ast.Name):
            if self._type(w.right, tables) not in NUMBERS:
                raise QueryError(f"a distance compares with numbers, and {w.right} is none")
            return getattr(self._distance(w.left, tables, df), COMPARE[w.op])(self._col(w.right, tables, df))
        if w.right.kind == "null":
            return F.lit(False)
        if w.right.kind != "number":
            raise QueryError("a distance compares with a number")
        r = float(w.right.value)
        exact = getattr(self._distance(w.left, tables, df), COMPARE[w.op])(F.lit(r))
        if w.op in ("<", "<=", "=") and isinstance(w.left.target, ast.Literal):
            lon, lat = self._position(w.left.column, tables, df)
            return sx.in_any_box(lon, lat, sx.radius_boxes(*w.left.target.value, r, w.left.metric)) & exact
        return exact

    def _grouped(self, df: DataFrame, q: ast.Select, tables: dict[str, Table]) -> DataFrame:
        keys = [self._column(n, tables, df) for n in q.group]
        plain = [c for i in q.items if isinstance(i, ast.Name) and (c := self._column(i, tables, df)) not in keys]
        # a plain column takes its value from the group's first row by primary key
        key = tables[q.table].schema.key
        by = (f"{q.table}.{key.name}" if len(tables) > 1 else key.name) if key else None
        aggs = [(F.min_by(F.col(f"`{c}`"), F.col(f"`{by}`")) if by else F.min(F.col(f"`{c}`"))).alias(c) for c in dict.fromkeys(plain)]
        for a in dict.fromkeys(i for i in q.items if isinstance(i, ast.Aggregate)):
            arg = F.lit(1) if a.column is None else self._col(a.column, tables, df)
            aggs.append(relational.AGGREGATES[a.function](arg).alias(str(a)))
        return df.groupBy(*[F.col(f"`{k}`") for k in keys]).agg(*aggs)

    def _order(self, q: ast.Select, tables: dict[str, Table], df: DataFrame) -> list[Column]:
        out = []
        for o in q.order:
            if isinstance(o.by, ast.Distance):
                d = self._distance(o.by, tables, df)
                out.append(d.asc_nulls_last() if o.ascending else d.desc_nulls_last())
            else:
                c = self._col(o.by, tables, df)
                out.append(c.asc_nulls_first() if o.ascending else c.desc_nulls_last())
        # equal rows keep the order of the primary key
        key = tables[q.table].schema.key
        own = f"{q.table}.{key.name}" if key and len(tables) > 1 else key.name if key else None
        return [*out, F.col(f"`{own}`")] if own in df.columns else out


def sx_types() -> tuple:
    """Types that rows are not ordered by."""
    from pyspark.sql import types as T

    return T.StructType, T.ArrayType, T.BinaryType
