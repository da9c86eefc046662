"""The dialect's parser: words by one pattern, statements by recursive descent."""

from __future__ import annotations

import re
from datetime import date, datetime

from tessera.errors import QueryError
from tessera.plans import ast
from tessera.types import Column, point, polygon, rectangle

WORD = re.compile(r"\s+|--[^\n]*|(?P<num>-?\d+(?:\.\d+)?)(?![A-Za-z_])|'(?P<str>(?:[^']|'')*)'|(?P<id>[A-Za-z_À-ɏ][\w]*)|(?P<op><=|>=|!=|<>|[=<>(),.;*])")
AGGREGATES = ("COUNT", "SUM", "AVG", "MIN", "MAX")
INDEX_KINDS = ("BTREE", "HASH", "RTREE", "GIN", "SPIMI", "IVF", "HNSW")
METRICS = {"COSINE": "cosine", "EUCLIDEAN": "euclidean", "DOT_PRODUCT": "dot_product"}
RESERVED = {"SELECT", "FROM", "WHERE", "JOIN", "ON", "GROUP", "ORDER", "LIMIT", "USING", "WITH", "AND", "OR", "SET", "VALUES", "BY"}


def split(text: str) -> list[tuple[str, str]]:
    """(kind, text) of each word."""
    out, at = [], 0
    while at < len(text):
        m = WORD.match(text, at)
        if not m:
            raise QueryError(f"unexpected character {text[at]!r} at {at}")
        if m.lastgroup:
            out.append((m.lastgroup, m.group(m.lastgroup).replace("''", "'") if m.lastgroup == "str" else m.group(m.lastgroup)))
        at = m.end()
    return out


class Parser:
    """One statement's words and how far they are read."""

    def __init__(self, words: list[tuple[str, str]]):
        self.words, self.at = words, 0

    # ---- reading words

    def peek(self, *texts: str, ahead: int = 0) -> bool:
        kind, text = self.words[self.at + ahead] if self.at + ahead < len(self.words) else ("end", "")
        return kind in ("id", "op") and text.upper() in texts

    def take(self, *texts: str) -> bool:
        if self.peek(*texts):
            self.at += 1
            return True
        return False

    def need(self, *texts: str) -> str:
        if not self.peek(*texts):
            raise QueryError(f"expected {' or '.join(texts)}, not {self.shown()}")
        self.at += 1
        return self.words[self.at - 1][1].upper()

    def shown(self) -> str:
        return repr(self.words[self.at][1]) if self.at < len(self.words) else "the end"

    def value_of(self, kind: str, what: str) -> str:
        if self.at >= len(self.words) or self.words[self.at][0] != kind or (kind == "id" and self.words[self.at][1].upper() in RESERVED):
            raise QueryError(f"expected {what}, not {self.shown()}")
        self.at += 1
        return self.words[self.at - 1][1]

    def identifier(self) -> str:
        return self.value_of("id", "a name")

    def name(self) -> ast.Name:
        first = self.identifier()
        return ast.Name(self.identifier(), first) if self.take(".") else ast.Name(first)

    def number(self) -> float:
        return float(self.value_of("num", "a number"))

    def commas(self, read) -> tuple:
        out = [read()]
        while self.take(","):
            out.append(read())
        return tuple(out)

    def parens(self, read):
        self.need("(")
        out = read()
        self.need(")")
        return out

    # ---- values

    def literal(self) -> ast.Literal | ast.Name:
        kind, text = self.words[self.at] if self.at < len(self.words) else ("end", "")
        if kind == "num":
            self.at += 1
            return ast.Literal("number", float(text) if "." in text else int(text))
        if kind == "str":
            self.at += 1
            return ast.Literal("text", text)
        if self.peek("NULL"):
            self.at += 1
            return ast.Literal("null", None)
        if self.peek("TRUE", "FALSE"):
            self.at += 1
            return ast.Literal("boolean", text.upper() == "TRUE")
        if self.peek("DATE", "TIMESTAMP", "TIME") and self.at + 1 < len(self.words) and self.words[self.at + 1][0] == "str":
            what, raw = self.need("DATE", "TIMESTAMP", "TIME"), self.value_of("str", "a text")
            try:
                return ast.Literal(what.lower(), date.fromisoformat(raw) if what == "DATE" else datetime.fromisoformat(raw) if what == "TIMESTAMP" else raw)
            except ValueError:
                raise QueryError(f"{raw!r} is no {what}") from None
        if self.peek("POINT", "RECTANGLE", "POLYGON", "CENTROIDE") and self.peek("(", ahead=1):
            return self.shape()
        return self.name()

    def shape(self) -> ast.Literal:
        what = self.need("POINT", "RECTANGLE", "POLYGON", "CENTROIDE")
        if what == "POLYGON":
            return ast.Literal("polygon", polygon(list(self.parens(lambda: self.commas(lambda: self.shape().value)))))
        if what == "CENTROIDE":
            inner = self.parens(self.shape)
            return ast.Literal("point", _centroid(inner))
        numbers = self.parens(lambda: self.commas(self.number))
        if len(numbers) != (2 if what == "POINT" else 4):
            raise QueryError(f"{what} takes {2 if what == 'POINT' else 4} numbers")
        return ast.Literal(what.lower(), point(*numbers) if what == "POINT" else rectangle(*numbers))

    # ---- select

    def select(self) -> ast.Select:
        self.need("SELECT")
        star = self.take("*")
        items: list = []
        if star:
            while self.take(","):
                items.append(self.score())
        else:
            items = list(self.commas(self.item))
        self.need("FROM")
        table, join, where, group, order, limit = self.identifier(), None, None, (), (), None
        if self.take("JOIN"):
            other = self.identifier()
            self.need("ON")
            left = self.name()
            self.need("=")
            join = (other, left, self.name())
        if self.take("WHERE"):
            where = self.condition()
        while self.peek("GROUP", "ORDER"):
            if self.need("GROUP", "ORDER") == "GROUP":
                if group:
                    raise QueryError("GROUP BY is there twice")
                self.need("BY")
                group = self.commas(self.name)
            else:
                if order:
                    raise QueryError("ORDER BY is there twice")
                self.need("BY")
                order = self.commas(self.order_item)
        if self.take("LIMIT"):
            raw = self.value_of("num", "a number")
            if not raw.isdigit() or int(raw) < 1:
                raise QueryError("LIMIT takes a positive whole number")
            limit = int(raw)
        return ast.Select(tuple(items), star, table, join, where, group, order, limit)

    def item(self):
        if self.peek("SCORE", "SIMILARITY_SCORE") and self.peek("(", ahead=1):
            return self.score()
        if self.peek(*AGGREGATES) and self.peek("(", ahead=1):
            f = self.need(*AGGREGATES)
            return ast.Aggregate(f, self.parens(lambda: None if f == "COUNT" and self.take("*") else self.name()))
        return self.name()

    def score(self) -> ast.Score:
        kind = self.need("SCORE", "SIMILARITY_SCORE")
        self.need("(")
        column = query = None
        if kind == "SCORE" and not self.peek(")"):
            column = self.name()
            self.need(",")
            query = self.value_of("str", "a text")
        self.need(")")
        named = self.take("AS") or (self.at < len(self.words) and self.words[self.at][0] == "id" and not self.peek("FROM"))
        return ast.Score(kind, self.identifier() if named else kind.lower(), column, query)

    def order_item(self) -> ast.OrderBy:
        by = self.distance() if self.peek("DISTANCIA") and self.peek("(", ahead=1) else self.name()
        if self.take("DESC"):
            return ast.OrderBy(by, False)
        self.take("ASC")
        return ast.OrderBy(by)

    def condition(self):
        if self.peek("DENTRO_DE") and self.peek("(", ahead=1):
            self.at += 1
            self.need("(")
            column = self.name()
            self.need(",")
            ring = self.shape()
            self.need(")")
            if ring.kind != "polygon":
                raise QueryError("DENTRO_DE takes a polygon")
            return ast.Within(column, ring)
        if self.peek("MATCH") and self.peek("(", ahead=1):
            self.at += 1
            self.need("(")
            column = self.name()
            self.need(",")
            query = self.value_of("str", "a text")
            self.need(")")
            return ast.Match(column, query, self.need("BM25", "TF_IDF").lower() if self.take("USING") else "bm25")
        if self.peek("SIMILAR_TO") and self.peek("(", ahead=1):
            return self.similar(None)
        left = self.distance() if self.peek("DISTANCIA") and self.peek("(", ahead=1) else self.name()
        if isinstance(left, ast.Name) and self.peek("MATCH"):
            self.at += 1
            return ast.Match(left, self.value_of("str", "a text"))
        if isinstance(left, ast.Name) and self.peek("SIMILAR_TO"):
            return self.similar(left)
        op = self.need("=", "!=", "<>", "<", "<=", ">", ">=")
        return ast.Compare(left, "!=" if op == "<>" else op, self.literal())

    def similar(self, column: ast.Name | None) -> ast.Similar:
        self.need("SIMILAR_TO")
        self.need("(")
        if column is None and self.at < len(self.words) and self.words[self.at][0] == "id":
            column = self.name()
            self.need(",")
        target = self.value_of("str", "a text")
        self.need(",")
        if self.identifier().lower() != "k":
            raise QueryError("SIMILAR_TO takes k = a number")
        self.need("=")
        raw = self.value_of("num", "a number")
        if not raw.isdigit() or int(raw) < 1:
            raise QueryError("k must be a positive whole number")
        self.need(")")
        index = self.need("IVF", "HNSW") if self.take("USING") else "HNSW"
        metric = "cosine"
        if self.take("WITH"):
            self.need("METRIC")
            self.need("=")
            metric = METRICS[self.need(*METRICS)]
        return ast.Similar(column, target, int(raw), index, metric)

    def distance(self) -> ast.Distance:
        self.need("DISTANCIA")
        self.need("(")
        column = self.name()
        self.need(",")
        target = self.shape() if self.peek("POINT", "CENTROIDE") and self.peek("(", ahead=1) else self.name()
        metric = self.need("EUCLIDEAN", "HAVERSINE") if self.take(",") else "HAVERSINE"
        self.need(")")
        return ast.Distance(column, target, metric)

    # ---- other statements

    def statement(self):
        if self.peek("SELECT"):
            return self.select()
        if self.take("EXPLAIN"):
            analyze = self.take("ANALYZE")
            return ast.Explain(self.select(), analyze)
        if self.take("INSERT"):
            self.need("INTO")
            table = self.identifier()
            columns = self.parens(lambda: self.commas(self.identifier)) if self.peek("(") else None
            self.need("VALUES")
            rows = self.commas(lambda: self.parens(lambda: self.commas(self.literal)))
            if any(isinstance(v, ast.Name) for r in rows for v in r):
                raise QueryError("VALUES takes literals")
            return ast.Insert(table, columns, rows)
        if self.take("DELETE"):
            self.need("FROM")
            return ast.Delete(self.identifier(), self.condition() if self.take("WHERE") else None)
        if self.take("UPDATE"):
            table = self.identifier()
            self.need("SET")
            column = self.identifier()
            self.need("=")
            value = self.literal()
            self.need("WHERE")
            return ast.Update(table, column, value, self.condition())
        if self.take("CREATE"):
            return self.create_table() if self.need("TABLE", "INDEX") == "TABLE" else self.create_index()
        if self.take("DROP"):
            if self.need("TABLE", "INDEX") == "TABLE":
                return ast.DropTable(self.identifier())
            maybe = self.take("IF")
            if maybe:
                self.need("EXISTS")
            return ast.DropIndex(self.identifier(), maybe)
        if self.peek("BEGIN", "END"):
            begin = self.need("BEGIN", "END") == "BEGIN"
            self.need("TRANSACTION")
            return ast.Transaction(begin)
        raise QueryError(f"no statement begins with {self.shown()}")

    def create_table(self) -> ast.CreateTable:
        table = self.identifier()
        columns = self.parens(lambda: self.commas(self.column))
        return ast.CreateTable(table, columns, self.need("HEAP", "SEQUENTIAL") if self.take("USING") else "HEAP")

    def column(self) -> Column:
        name, kind = self.identifier(), self.identifier().upper()
        if kind in ("DOUBLE", "DOUBLE_PRECISION"):
            if kind == "DOUBLE":
                self.need("PRECISION")
            kind = "DOUBLE PRECISION"
        size = int(self.parens(self.number)) if self.peek("(") else None
        key = unique = False
        nullable = True
        while self.peek("PRIMARY", "NOT", "UNIQUE"):
            word = self.need("PRIMARY", "NOT", "UNIQUE")
            if word == "PRIMARY":
                self.need("KEY")
                key = True
            elif word == "NOT":
                self.need("NULL")
                nullable = False
            else:
                unique = True
        return Column(name, kind, size, key, nullable, unique)

    def create_index(self) -> ast.CreateIndex:
        name = self.identifier()
        self.need("ON")
        table = self.identifier()
        if self.take("USING"):
            kind = self.need(*INDEX_KINDS)
            return ast.CreateIndex(name, table, self.parens(self.identifier), kind)
        column = self.parens(self.identifier)
        self.need("USING")
        return ast.CreateIndex(name, table, column, self.need(*INDEX_KINDS))


def _centroid(shape: ast.Literal) -> tuple[float, float]:
    if shape.kind == "point":
        return shape.value
    if shape.kind == "rectangle":
        w, s, e, n = shape.value
        lon = (w + e + (360 if w > e else 0)) / 2
        return (lon - 360 if lon > 180 else lon, (s + n) / 2)
    own = shape.value[:-1]
    return sum(p[0] for p in own) / len(own), sum(p[1] for p in own) / len(own)


def parse(text: str):
    """One statement, with or without its semicolon."""
    found = parse_many(text)
    if len(found) != 1:
        raise QueryError(f"expected one statement, not {len(found)}")
    return found[0]


def parse_many(text: str) -> list:
    """The statements of a batch, each ended by a semicolon but for the last."""
    words, out, start = split(text), [], 0
    for i, w in enumerate([*words, ("op", ";")]):
        if w == ("op", ";"):
            if i > start:
                p = Parser(words[start:i])
                out.append(p.statement())
                if p.at < len(p.words):
                    raise QueryError(f"unexpected {p.shown()}")
            start = i + 1
    if not out:
        raise QueryError("there is no statement")
    return out
