"""The engine end to end: statements, rules, indexes, loaders."""

import pytest

from tessera.errors import LoadError, QueryError
from tessera.plans import ast, parser
from tessera.plans.engine import Engine
from tessera.sources import rows as row_source


@pytest.fixture
def db(spark, tmp_path):
    return Engine(spark, str(tmp_path / "db"))


def values(df):
    return [tuple(r) for r in df.collect()]


@pytest.fixture
def school(db):
    db.execute_many("""
        CREATE TABLE alumnos (id INTEGER PRIMARY KEY, nombre VARCHAR(20));
        CREATE TABLE matriculas (alumno_id INTEGER, curso VARCHAR(20), nota INTEGER);
        INSERT INTO alumnos VALUES (1, 'Ana'), (2, 'Luis'), (3, 'Eva');
        INSERT INTO matriculas VALUES (1, 'BD', 18), (1, 'SO', 14), (2, 'BD', 11), (3, 'SO', 16);
    """)
    return db


def test_join_where_order(school):
    got = school.query("SELECT alumnos.nombre, matriculas.nota FROM alumnos JOIN matriculas ON alumnos.id = matriculas.alumno_id WHERE matriculas.nota > 12 ORDER BY matriculas.nota DESC;")
    assert values(got) == [("Ana", 18), ("Eva", 16), ("Ana", 14)]
    assert got.columns == ["alumnos.nombre", "matriculas.nota"]
    reversed_on = school.query("SELECT * FROM alumnos JOIN matriculas ON matriculas.alumno_id = alumnos.id")
    assert reversed_on.count() == 4 and reversed_on.columns[0] == "alumnos.id"


def test_group(school):
    got = school.query("SELECT curso, COUNT(*), AVG(nota), SUM(nota) FROM matriculas GROUP BY curso ORDER BY curso")
    assert values(got) == [("BD", 2, 14.5, 29), ("SO", 2, 15.0, 30)]
    assert got.columns == ["curso", "COUNT(*)", "AVG(nota)", "SUM(nota)"]
    assert len(values(school.query("SELECT curso FROM matriculas GROUP BY curso"))) == 2
    assert values(school.query("SELECT COUNT(*), MAX(nota) FROM matriculas WHERE nota > 90")) == [(0, None)]


def test_changes(school):
    assert school.execute("UPDATE matriculas SET nota = 20 WHERE curso = 'BD'").changed == 2
    assert school.execute("DELETE FROM matriculas WHERE nota < 15").changed == 1
    assert sorted(values(school.read("matriculas"))) == [(1, "BD", 20), (2, "BD", 20), (3, "SO", 16)]
    assert school.execute("UPDATE matriculas SET nota = alumno_id WHERE curso = 'SO'").changed == 1
    assert school.execute("INSERT INTO alumnos (id) VALUES (9)").changed == 1
    assert (9, None) in values(school.read("alumnos"))
    assert school.execute("DELETE FROM alumnos").changed == 4


@pytest.mark.parametrize("text", ["INSERT INTO alumnos VALUES (1, 'x')", "INSERT INTO alumnos VALUES (7, 'a'), (7, 'b')", "INSERT INTO alumnos VALUES (NULL, 'x')", "UPDATE alumnos SET id = 1 WHERE id = 2", "INSERT INTO alumnos VALUES (8, 'a name that is much too long')", "INSERT INTO alumnos VALUES (8)", "INSERT INTO alumnos VALUES ('x', 'y')", "INSERT INTO alumnos VALUES (99999999999, 'y')"])
def test_constraints(school, text):
    with pytest.raises(QueryError):
        school.execute(text)
    assert sorted(values(school.read("alumnos"))) == [(1, "Ana"), (2, "Luis"), (3, "Eva")]


def test_unique_allows_nulls(db):
    db.execute("CREATE TABLE u (id INTEGER PRIMARY KEY, email VARCHAR(20) UNIQUE)")
    db.execute("INSERT INTO u VALUES (1, NULL), (2, NULL), (3, 'a')")
    with pytest.raises(QueryError):
        db.execute("INSERT INTO u VALUES (4, 'a')")


def test_transactions_and_reopening(school, spark):
    school.execute("BEGIN TRANSACTION")
    school.execute("INSERT INTO alumnos VALUES (4, 'Noa')")
    with pytest.raises(QueryError):
        school.execute("INSERT INTO alumnos VALUES (4, 'twice')")
    assert school.read("alumnos").count() == 3
    school.execute_many("BEGIN TRANSACTION; INSERT INTO alumnos VALUES (5, 'Sol'); END TRANSACTION;")
    assert Engine(spark, school.root).read("alumnos").count() == 4
    with pytest.raises(QueryError):
        school.execute("END TRANSACTION")


@pytest.fixture
def docs(db):
    db.execute("CREATE TABLE docs (id INTEGER PRIMARY KEY, titulo VARCHAR(40), contenido TEXT)")
    db.execute("INSERT INTO docs VALUES (1, 'a', 'el gato y el perro'), (2, 'b', 'gato gato'), (3, 'c', NULL), (4, 'd', 'pájaro azul'), (5, 'e', '')")
    return db


def test_search(docs):
    got = values(docs.query("SELECT id, SCORE() AS s FROM docs WHERE MATCH(contenido, 'GÁTO') ORDER BY s DESC"))
    assert [r[0] for r in got] == [2, 1]
    every = dict(values(docs.query("SELECT id, SCORE(contenido, 'gato') AS s FROM docs")))
    assert every[2] == got[0][1] and every[4] == every[3] == 0.0
    assert values(docs.query("SELECT id FROM docs WHERE contenido MATCH 'pajaro'")) == [(4,)]
    assert len(docs.query("SELECT *, SCORE() FROM docs WHERE MATCH(contenido, 'gato')").columns) == 4
    cos = dict(values(docs.query("SELECT id, SCORE() AS s FROM docs WHERE MATCH(contenido, 'gato') USING TF_IDF")))
    assert cos[2] == pytest.approx(1.0) and 0 < cos[1] < 1


def test_search_by_index_is_the_same(docs):
    docs.execute("CREATE INDEX i ON docs USING SPIMI (contenido)")
    for method, using in (("bm25", "BM25"), ("tf_idf", "TF_IDF")):
        plain = dict(values(docs.query(f"SELECT id, SCORE() AS s FROM docs WHERE MATCH(contenido, 'gato perro') USING {using}")))
        assert dict(values(docs.text_search("docs", "contenido", "gato perro", method))) == pytest.approx(plain)
    docs.execute("INSERT INTO docs VALUES (6, 'f', 'otro gato')")
    assert docs.text_search("docs", "contenido", "gato").count() == 3
    docs.execute("DROP INDEX i")
    docs.execute("DROP INDEX IF EXISTS i")
    with pytest.raises(QueryError):
        docs.execute("DROP INDEX i")


@pytest.fixture
def places(db):
    db.execute_many("""
        CREATE TABLE places (id INTEGER PRIMARY KEY, location POINT, r INTEGER);
        INSERT INTO places VALUES (1, POINT(-77.0428, -12.0464), 10), (2, POINT(-77.03, -12.05), 9000), (3, POINT(-76.5, -12.5), 0), (4, NULL, 5), (5, POINT(0, 0), 5), (6, POINT(-77.05, -12.04), 100);
    """)
    return db


def test_spatial(places):
    near = "SELECT id FROM places WHERE DISTANCIA(location, POINT(-77.0428, -12.0464)) <= 5000"
    assert {r[0] for r in values(places.query(near))} == {1, 2, 6}
    places.execute("CREATE INDEX r ON places USING RTREE (location)")
    assert {r.id for r in places.spatial_search("places", "location", (-77.0428, -12.0464), 5000.0).collect()} == {1, 2, 6}
    assert [r[0] for r in values(places.query("SELECT id FROM places ORDER BY DISTANCIA(location, POINT(-77.0428, -12.0464)) LIMIT 6"))] == [1, 6, 2, 3, 5, 4]
    assert {r[0] for r in values(places.query("SELECT id FROM places WHERE DENTRO_DE(location, POLYGON(POINT(-78, -13), POINT(-76, -13), POINT(-76, -12), POINT(-78, -12)))"))} == {1, 2, 3, 6}
    assert {r[0] for r in values(places.query("SELECT id FROM places WHERE DISTANCIA(location, POINT(-77.0428, -12.0464)) < r"))} == {1, 2}
    assert {r[0] for r in values(places.query("SELECT id FROM places WHERE DISTANCIA(location, POINT(0, 0), EUCLIDEAN) > 1"))} == {1, 2, 3, 6}
    assert places.execute("DELETE FROM places WHERE DISTANCIA(location, POINT(0, 0)) < 1").changed == 1


def test_geometry(db):
    db.execute("CREATE TABLE g (id INTEGER PRIMARY KEY, geom GEOMETRY)")
    db.execute("INSERT INTO g VALUES (1, POINT(1, 1)), (2, RECTANGLE(170, 0, -170, 10)), (3, POLYGON(POINT(0, 0), POINT(4, 0), POINT(0, 4)))")
    assert {r[0] for r in values(db.query("SELECT id FROM g WHERE DISTANCIA(geom, POINT(180, 5), EUCLIDEAN) < 0.001"))} == {2}
    assert {r[0] for r in values(db.query("SELECT id FROM g WHERE DENTRO_DE(geom, POLYGON(POINT(0, 0), POINT(3, 0), POINT(3, 3), POINT(0, 3)))"))} == {1, 3}
    assert values(db.query("SELECT id FROM g WHERE DISTANCIA(geom, CENTROIDE(POLYGON(POINT(0, 0), POINT(4, 0), POINT(0, 4)))) = 0")) == [(3,)]


def test_vectors(db):
    db.execute("CREATE TABLE v (id INTEGER PRIMARY KEY, vec BYTEA, note VARCHAR(40))")
    db.insert_dicts("v", [{"id": 1, "vec": [1.0, 0.0], "note": "[1, 0]"}, {"id": 2, "vec": [0.0, 1.0]}, {"id": 3, "vec": [1.0, 1.0], "note": "no vector"}, {"id": 4, "vec": None}])
    got = values(db.query("SELECT id, SIMILARITY_SCORE() AS s FROM v WHERE SIMILAR_TO(vec, '[1, 0]', k = 2)"))
    assert [r[0] for r in got] == [1, 3] and got[0][1] == pytest.approx(1.0)
    assert [r[0] for r in values(db.query("SELECT id FROM v WHERE vec SIMILAR_TO('[1, 0]', k = 9) WITH METRIC = EUCLIDEAN"))] == [1, 3, 2]
    assert [r.id for r in db.vector_search("v", "vec", [0.0, 2.0], 1, "dot_product").collect()] == [2]
    assert [r[0] for r in values(db.query("SELECT id FROM v WHERE SIMILAR_TO(note, '[1, 0]', k = 5)"))] == [1]
    db.execute("CREATE INDEX x ON v USING IVF (vec)")
    assert [r.id for r in db.vector_search("v", "vec", [1.0, 0.0], 1).collect()] == [1]
    db.execute("CREATE INDEX y ON v USING HNSW (vec)")
    db.execute("DELETE FROM v WHERE id > 1")
    assert [r.id for r in db.vector_search("v", "vec", [1.0, 0.0], 3).collect()] == [1]
    db.execute("INSERT INTO v (id) VALUES (7)")
    with pytest.raises(QueryError):
        db.insert_dicts("v", [{"id": 5, "nope": 1}])
    json = [r.json for r in row_source.to_json(db.read("v").where("id = 1")).collect()]
    assert json == ['{"id":1,"vec":"AACAPwAAAAA=","note":"[1, 0]"}']


@pytest.mark.parametrize(
    "text",
    [
        "", "SELECT", "SELECT id docs", "SELECT id FROM docs WHERE", "SELECT id FROM docs LIMIT 0", "SELECT id FROM docs LIMIT 1.5", "SELECT id FROM docs LIMIT -1", "SELECT nope FROM docs", "SELECT id FROM nope", "SELECT id FROM docs WHERE id = 'x'",
        "SELECT id FROM docs WHERE MATCH(id, 'x')", "SELECT id FROM docs WHERE MATCH(contenido, '!!')", "SELECT id, SCORE() FROM docs", "SELECT id, SIMILARITY_SCORE() FROM docs", "SELECT id, SCORE() AS titulo FROM docs WHERE MATCH(contenido, 'x')", "SELECT COUNT(*) FROM docs WHERE MATCH(contenido, 'x')",
        "SELECT id FROM docs WHERE MATCH(contenido, 'x') USING LUCENE", "SELECT SUM(titulo) FROM docs", "SELECT id FROM docs WHERE DISTANCIA(titulo, POINT(0, 0)) < 1", "SELECT id FROM docs WHERE DISTANCIA(titulo, POINT(0, 99)) < 1", "CREATE TABLE docs (id INTEGER)", "CREATE TABLE x (id INTEGER, id INTEGER)",
        "CREATE TABLE x (a VARCHAR)", "CREATE TABLE x (a WHAT)", "CREATE TABLE x (a INTEGER PRIMARY KEY, b INTEGER PRIMARY KEY)", "CREATE TABLE x (a INTEGER) USING SEQUENTIAL", "CREATE INDEX i ON docs USING RTREE (titulo)", "CREATE INDEX i ON docs USING SPIMI (id)", "DROP TABLE nope", "DELETE FROM docs WHERE MATCH(contenido, 'gato')",
        "UPDATE docs SET id = 1", "SELECT id FROM docs WHERE SIMILAR_TO(contenido, '[1]', k = 0)", "SELECT id FROM docs WHERE SIMILAR_TO(contenido, 'x', k = 1)", "SELECT id FROM docs; SELECT id FROM docs", "SELECT id FROM docs @", "SELECT id FROM docs GROUP BY id GROUP BY id", "EXPLAIN DELETE FROM docs", "INSERT INTO docs VALUES (id, 'x', 'y')",
    ],
)
def test_errors(spark, docs_shared, text):
    with pytest.raises(QueryError):
        docs_shared.execute(text)


@pytest.fixture(scope="module")
def docs_shared(spark, tmp_path_factory):
    db = Engine(spark, str(tmp_path_factory.mktemp("errors") / "db"))
    db.execute("CREATE TABLE docs (id INTEGER PRIMARY KEY, titulo VARCHAR(40), contenido TEXT)")
    return db


def test_explain(docs):
    plan = "\n".join(r[0] for r in values(docs.execute("EXPLAIN ANALYZE SELECT id FROM docs WHERE id = 2").rows))
    assert "rows: 1" in plan and "PushedFilters" in plan


def test_parser():
    s = parser.parse("select t.a, count(t.b) from t join u on t.a = u.a where t.c <> 'it''s' group by t.a order by t.a desc limit 3;")
    assert s.where == ast.Compare(ast.Name("c", "t"), "!=", ast.Literal("text", "it's"))
    assert s.limit == 3 and not s.order[0].ascending and str(s.items[1]) == "COUNT(t.b)"
    assert parser.parse("CREATE INDEX i ON t (c) USING HNSW") == ast.CreateIndex("i", "t", "c", "HNSW")
    assert parser.parse("SELECT a FROM t WHERE b = DATE '2024-01-31'").where.right.kind == "date"


def test_csv(db, tmp_path):
    path = tmp_path / "x.csv"
    path.write_text('﻿id,nombre,edad,promedio,activo,donde\n1,"Ana, M",20,15.5,true,POINT(-77 -12)\n2,"say ""hi""",,16,no,"POINT(-76, -11)"\n3,x,22,,t,\n', encoding="utf-8")
    got = db.import_csv("gente", str(path), primary_key="id")
    assert got.types == {"id": "INTEGER", "nombre": "VARCHAR(16)", "edad": "INTEGER", "promedio": "DOUBLE PRECISION", "activo": "BOOLEAN", "donde": "POINT"}
    rows = {r.id: r for r in db.read("gente").collect()}
    assert rows[1].nombre == "Ana, M" and rows[2].nombre == 'say "hi"' and rows[2].edad is None and rows[2].activo is False and rows[1].donde.lon == -77 and rows[3].donde is None
    assert db.query("SELECT nombre FROM gente WHERE edad > 20").count() == 1


def test_csv_bad_rows(spark, db, tmp_path):
    path = tmp_path / "y.csv"
    path.write_text("id,fecha\n1,2024-01-02\n2,nope\n3,2024-02-30\n4\n5,2024-05-05,extra\n6,2024-06-06\n", encoding="utf-8")
    with pytest.raises(LoadError):
        db.import_csv("f", str(path), {"fecha": "DATE"})
    assert "f" not in db.state.tables
    got = db.import_csv("f", str(path), {"fecha": "DATE"}, on_error="ignore")
    assert sorted(r.id for r in db.read("f").collect()) == [1, 6]
    assert got.skipped.count() == 4
    for bad in ("", "a,a\n1,2\n"):
        path.write_text(bad)
        with pytest.raises(LoadError):
            db.import_csv("z", str(path))
    path.write_text("a,b\n1,x\n")
    with pytest.raises(LoadError):
        db.import_csv("z", str(path), {"c": "TEXT"})


def test_folders(db, tmp_path):
    (tmp_path / "b.txt").write_bytes("ñandú".encode("latin-1"))
    (tmp_path / "a.txt").write_bytes(b"\xef\xbb\xbf" + "árbol".encode())
    (tmp_path / "c.txt").write_bytes(b"")
    (tmp_path / "p.png").write_bytes(b"x")
    skipped = db.import_folder("textos", str(tmp_path), "text")
    assert sorted(values(db.read("textos"))) == [(1, "a", "árbol"), (2, "b", "ñandú")]
    assert [r.name for r in skipped.collect()] == ["c.txt"]
    db.import_folder("fotos", str(tmp_path), "image")
    assert [r.nombre for r in db.read("fotos").collect()] == ["p.png"]


def test_system_tables_and_compaction(school):
    school.execute("INSERT INTO alumnos VALUES (4, 'Noa')")
    assert len(school.state.tables["alumnos"]["paths"]) == 2
    school.compact("alumnos")
    assert len(school.state.tables["alumnos"]["paths"]) == 1 and school.read("alumnos").count() == 4
    assert {r.table_name for r in school.system("sys_tables").collect()} == {"alumnos", "matriculas"}
    assert school.system("sys_columns").count() == 5 and school.system("sys_indexes").count() == 0
    school.execute("DROP TABLE alumnos")
    with pytest.raises(QueryError):
        school.query("SELECT id FROM alumnos")
