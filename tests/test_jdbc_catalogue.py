"""Introspection over JDBC, on the embedded Derby that comes with Spark; the PostgreSQL queries on DuckDB's copy of its catalogue."""

import duckdb
import pytest

from wardline.operators import catalogue
from wardline.sources import introspection, jdbc_catalogue as jc
from wardline.sources.tables import TableSource

DDL = """
CREATE SCHEMA plant;
CREATE SCHEMA depot;
CREATE SCHEMA bare;
CREATE TABLE plant.gauges (site VARCHAR(20) NOT NULL, taken TIMESTAMP NOT NULL, level DECIMAL(9, 3), state CHAR(1) DEFAULT 'O', n INT NOT NULL DEFAULT 7,
    PRIMARY KEY (taken, site));
CREATE TABLE plant.notes (note CLOB, flag BOOLEAN);
CREATE VIEW plant.recent AS SELECT site, level FROM plant.gauges;
CREATE TABLE depot.parts ("Mixed Name" DOUBLE, id BIGINT NOT NULL PRIMARY KEY);
INSERT INTO depot.parts VALUES (1.5, 1), (2.5, 2)
"""


@pytest.fixture(scope="module")
def options(spark):
    url = "jdbc:derby:memory:catalogue;create=true"
    spark._jvm.java.lang.Class.forName("org.apache.derby.jdbc.EmbeddedDriver")
    connection = spark._jvm.java.sql.DriverManager.getConnection(url)
    statement = connection.createStatement()
    for sql in DDL.split(";"):
        statement.executeUpdate(sql.strip())
    connection.close()
    return {"url": url, "driver": "org.apache.derby.jdbc.EmbeddedDriver"}


def test_tables_of_all_schemas_but_the_systems(spark, options):
    assert {"PLANT", "DEPOT", "BARE"} <= set(jc.list_schemas(spark, options)) and "SYS" not in jc.list_schemas(spark, options)
    listed = jc.list_tables(spark, options)
    assert listed.rdd.getNumPartitions() == len(jc.list_schemas(spark, options))  # one per schema
    everything = [("DEPOT", "PARTS", "table", None), ("PLANT", "GAUGES", "table", None), ("PLANT", "NOTES", "table", None), ("PLANT", "RECENT", "view", None)]
    assert sorted(map(tuple, listed.collect())) == everything
    assert sorted(map(tuple, jc.list_tables(spark, options, include_views=False).collect())) == everything[:3]
    assert sorted(map(tuple, jc.list_tables(spark, options, schemas=["DEPOT", "it's"]).collect())) == everything[:1]
    assert jc.list_tables(spark, options, schemas=[]).collect() == []
    both = introspection.list_tables(spark, jdbc=options)
    assert {tuple(r) for r in both.collect()} >= {r[:3] for r in everything}


def test_columns_with_keys_and_defaults(spark, options):
    rows = jc.describe_columns(spark, options).orderBy("schema_name", "table_name", "position").collect()
    got = [(r.table_name, r.column_name, r.position, r.data_type, r.nullable, r.default_value, r.is_primary_key) for r in rows]
    assert got == [
        ("PARTS", "Mixed Name", 0, "double", True, None, False),
        ("PARTS", "ID", 1, "bigint", False, None, True),
        ("GAUGES", "SITE", 0, "varchar(20)", False, None, True),
        ("GAUGES", "TAKEN", 1, "timestamp", False, None, True),
        ("GAUGES", "LEVEL", 2, "decimal(9,3)", True, None, False),
        ("GAUGES", "STATE", 3, "char(1)", True, "'O'", False),
        ("GAUGES", "N", 4, "integer", False, "7", False),
        ("NOTES", "NOTE", 0, "clob(2147483647)", True, None, False),
        ("NOTES", "FLAG", 1, "boolean", True, None, False),
        ("RECENT", "SITE", 0, "varchar(20)", False, None, False),
        ("RECENT", "LEVEL", 1, "decimal(9,3)", True, None, False),
    ]
    assert {r.table_type for r in rows if r.table_name == "RECENT"} == {"view"} and not any(r.is_geospatial for r in rows)


def test_entries_and_schemas_of_a_database(spark, options):
    columns = jc.describe_columns(spark, options)
    assert columns.schema.simpleString() == spark.createDataFrame([], introspection.COLUMNS_SCHEMA).schema.simpleString()
    entries = catalogue.entries_from_tables(columns, "works")
    assert {r.dataset_id for r in entries.collect()} >= {"works.depot.parts", "works.plant.gauges"}
    assert {r.table for r in entries.select("backend_config.table").collect()} >= {"DEPOT.PARTS", "PLANT.GAUGES"}
    kinds = {(r.table_name, r.column_name): (r.json_type, r.json_format) for r in introspection.json_schema_properties(columns).collect()}
    assert kinds["GAUGES", "N"] == ("integer", None) and kinds["GAUGES", "LEVEL"] == ("number", None)
    assert kinds["GAUGES", "TAKEN"] == ("string", "date-time") and kinds["NOTES", "FLAG"] == ("boolean", None)
    rows = TableSource(spark, jdbc=options).table("DEPOT.PARTS").collect()
    assert sorted(r.ID for r in rows) == [1, 2]


def test_unknown_database(spark):
    with pytest.raises(jc.UnknownDatabase, match="oracle"):
        jc.list_tables(spark, {"url": "jdbc:oracle:thin:@host"})


def test_postgresql_queries_run_on_a_catalogue_like_its_own():
    db = duckdb.connect()
    db.execute("CREATE SCHEMA plant; CREATE TABLE plant.gauges (site VARCHAR, n INTEGER NOT NULL DEFAULT 7, PRIMARY KEY (site)); CREATE VIEW plant.v AS SELECT site FROM plant.gauges")
    db.execute("COMMENT ON TABLE plant.gauges IS 'readings'")
    assert ("plant",) in db.execute(jc.POSTGRESQL.schemas).fetchall()
    assert {("plant", "gauges", "table"), ("plant", "v", "view")} <= {r[:3] for r in db.execute(jc.POSTGRESQL.tables).fetchall()}
    # DuckDB lacks pg_catalog's function for names of types, and counts a key's columns from 0.
    columns = jc.POSTGRESQL.columns.replace("pg_catalog.format_type(a.atttypid, a.atttypmod)", "CAST(a.atttypid AS VARCHAR)")
    rows = {(r[1], r[2]): r for r in db.execute(columns).fetchall() if r[0] == "plant"}
    assert rows["gauges", "n"][3] == 2 and rows["gauges", "n"][5] == 0 and "7" in rows["gauges", "n"][6]
    assert rows["gauges", "site"][7] == "(0)" and rows["v", "site"][7] is None


def test_geospatial_types_by_their_own_name(spark, options, monkeypatch):
    columns = jc.DERBY.columns.replace("CAST(c.COLUMNDATATYPE AS VARCHAR(200)) AS declared", "CASE c.COLUMNNAME WHEN 'SITE' THEN 'public.GEOMETRY(Point,4326)' ELSE 'pointer' END AS declared")
    monkeypatch.setitem(jc.DIALECTS, "derby", jc.CatalogueQueries(jc.DERBY.schemas, jc.DERBY.tables, columns, jc.DERBY.system_schemas))
    rows = jc.describe_columns(spark, options, schemas=["PLANT"]).filter("table_name = 'GAUGES'").collect()
    assert {r.column_name: r.is_geospatial for r in rows} == {"SITE": True, "TAKEN": False, "LEVEL": False, "STATE": False, "N": False}
