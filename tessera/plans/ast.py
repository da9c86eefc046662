"""Statements of the dialect, as the parser gives them."""

from __future__ import annotations

from dataclasses import dataclass

from tessera.types import Column


@dataclass(frozen=True)
class Name:
    column: str
    table: str | None = None

    def __str__(self) -> str:
        return f"{self.table}.{self.column}" if self.table else self.column


@dataclass(frozen=True)
class Literal:
    """A number, text, boolean, date, time or NULL; or a point, rectangle, polygon or the centroid of one."""

    kind: str
    value: object


@dataclass(frozen=True)
class Distance:
    column: Name
    target: Name | Literal
    metric: str


@dataclass(frozen=True)
class Compare:
    left: Name | Distance
    op: str
    right: Name | Literal


@dataclass(frozen=True)
class Within:
    column: Name
    ring: Literal


@dataclass(frozen=True)
class Match:
    column: Name
    query: str
    ranking: str = "bm25"


@dataclass(frozen=True)
class Similar:
    column: Name | None
    target: str
    k: int
    index: str = "HNSW"
    metric: str = "cosine"


@dataclass(frozen=True)
class Score:
    """SCORE(), SCORE(column, 'query') or SIMILARITY_SCORE()."""

    kind: str
    alias: str
    column: Name | None = None
    query: str | None = None


@dataclass(frozen=True)
class Aggregate:
    function: str
    column: Name | None

    def __str__(self) -> str:
        return f"{self.function}({self.column or '*'})"


@dataclass(frozen=True)
class OrderBy:
    by: Name | Distance
    ascending: bool = True


@dataclass(frozen=True)
class Select:
    items: tuple[Name | Aggregate | Score, ...]
    star: bool
    table: str
    join: tuple[str, Name, Name] | None = None
    where: Compare | Within | Match | Similar | None = None
    group: tuple[Name, ...] = ()
    order: tuple[OrderBy, ...] = ()
    limit: int | None = None


@dataclass(frozen=True)
class Insert:
    table: str
    columns: tuple[str, ...] | None
    rows: tuple[tuple[Literal, ...], ...]


@dataclass(frozen=True)
class Delete:
    table: str
    where: object = None


@dataclass(frozen=True)
class Update:
    table: str
    column: str
    value: Literal | Name
    where: object


@dataclass(frozen=True)
class CreateTable:
    table: str
    columns: tuple[Column, ...]
    storage: str = "HEAP"


@dataclass(frozen=True)
class DropTable:
    table: str


@dataclass(frozen=True)
class CreateIndex:
    name: str
    table: str
    column: str
    kind: str


@dataclass(frozen=True)
class DropIndex:
    name: str
    if_exists: bool = False


@dataclass(frozen=True)
class Transaction:
    begin: bool


@dataclass(frozen=True)
class Explain:
    select: Select
    analyze: bool = False
