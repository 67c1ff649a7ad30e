from pyspark.sql import functions as F

from factloom.operators import reports, scan
from factloom.sources import text

CELL = "run_id int, cell_index int, source string"


def test_views_ctes_and_imports_are_no_tables(rows, got):
    cells = rows(CELL, [
        (1, 0, "from pyspark.sql import functions as F\nimport os\ndf = spark.table('raw.orders').filter('x > 0')"),
        (1, 1, "df.createOrReplaceTempView('staged')"),
        (1, 2, "%%sql\nWITH recent AS (SELECT * FROM STAGED), b AS (SELECT 1)\nINSERT INTO gold.t SELECT * FROM recent JOIN b JOIN `dim`"),
        (2, 0, "spark.sql('SELECT * FROM staged')"),
        (2, 1, "df.write.format('delta').mode('append').save('Files/out/*.csv')\nspark.read.option('a', 1).load(\"Files/in\")"),
    ])
    assert got(scan.cell_access(cells, "w", "l")) == sorted([
        (1, 0, "read", "w/raw/orders"), (1, 2, "write", "w/gold/t"), (1, 2, "read", "w/l/dim"),
        (2, 0, "read", "w/l/staged"), (2, 1, "write", "w/l/Files%2Fout%2F*.csv"), (2, 1, "read", "w/l/Files%2Fin"),
    ], key=repr)


def test_every_write_pattern(rows, got):
    sources = ["df.write.saveAsTable('a')", "df.insertInto('b')", "df.write.save('Files/c')", "df.write.parquet('Files/d')", "INSERT INTO e VALUES (1)",
               "CREATE OR REPLACE TABLE f AS SELECT 1", "MERGE INTO g USING x ON 1=1", "UPDATE h SET a = 1", "DELETE FROM i WHERE 1=1", "df.read.parquet('Files/no')"]
    cells = rows(CELL, [(1, i, s) for i, s in enumerate(sources)])
    leaves = {r[0].split("/")[-1] for r in got(scan.scan_writes(cells), "ref")}
    assert leaves == {"a", "b", "Files%2Fc", "Files%2Fd", "e", "f", "g", "h", "i"}


def test_a_ref_read_and_written_is_a_write(rows, got):
    access = rows("run_id int, ref string, mode string", [(1, "t", "read"), (1, "t", "write"), (1, "u", "read"), (2, "t", "read")])
    assert got(reports.run_access(access)) == [(1, "t", "write"), (1, "u", "read"), (2, "t", "read")]


def test_statements_and_flags(rows, got):
    cells = rows(CELL, [
        (1, 0, 'spark.sql("""\nSELECT 1\n""")\nspark.sql(f"SELECT {x}")\nspark.sql("a" "b")'),
        (1, 1, "%%sql\nSELECT 2"), (1, 2, "%%spark-sql x\nSELECT 3"), (1, 3, "%%html\n<b>"), (1, 4, "def broken(:"),
        (1, 5, "df.write.mode('x').parquet('p')"), (1, 6, "spark.read.parquet('p')"), (1, 7, "df.writeTo('t').append()"), (1, 8, None),
    ])
    assert got(scan.sql_statements(cells)) == [(1, 0, 0, "\nSELECT 1\n"), (1, 0, 1, "ab"), (1, 1, 0, "SELECT 2"), (1, 2, 0, "SELECT 3")]
    flags = {r["cell_index"]: r for r in scan.scan_cell_flags(cells).collect()}
    assert flags[0]["sql_statements"] == 2 and flags[0]["dynamic_sql"] and not flags[0]["df_write"]
    assert flags[1]["magic"] and flags[1]["sql_statements"] == 1 and not flags[1]["unparsable"]
    assert flags[3]["magic"] and flags[3]["sql_statements"] == 0
    assert flags[4]["unparsable"]
    assert [flags[i]["df_write"] for i in (5, 6, 7)] == [True, False, True]
    counts = scan.coverage_counts(scan.scan_cell_flags(cells)).first()
    assert (counts["cells"], counts["sql_cells"], counts["sql_statements"], counts["dataframe_write_cells"]) == (9, 3, 4, 2)


def test_notes_name_at_most_eight_tables(rows):
    counts = rows("run_id int, dataframe_write_cells long, dynamic_sql_cells long, unparsable_cells long", [(1, 1, 0, 2)])
    writes = rows("run_id int, writes long, writes_with_column_lineage long", [(1, 11, 1)])
    missing = rows("run_id int, ref string", [(1, f"t{i}") for i in range(10)])
    def notes(engine):
        found = scan.coverage_notes(counts, writes, missing, rows("run_id int, engine string", [(1, engine)]))
        return [r["note"] for r in found.orderBy("pos").collect()]

    assert len(notes("stub")) == 3 and notes("spark") == notes("stub")[1:] and "read those chains" not in notes("spark")[0]
    assert notes("stub")[0].startswith("[coverage] 1 cell(s) write through the DataFrame API. The stub engine reads those chains symbolically")
    assert notes("spark")[1] == "[coverage] 10 of 11 written table(s) got no column lineage: t0, t1, t2, t3, t4, t5, t6, t7"


def test_classify(rows):
    statements = {
        "insert overwrite table a.b select 1": ("insert", "a.b", None),
        "CREATE TABLE t USING delta AS SELECT 1": ("ctas", "t", None),
        "CREATE TABLE t (a INT)": ("other", None, None),
        " merge into t using s on 1=1": ("merge", "t", "s"),
        "MERGE INTO t USING (SELECT 1) s": ("merge", "t", None),
        "CREATE GLOBAL TEMPORARY VIEW IF NOT EXISTS v AS SELECT 1": ("temp_view", "v", None),
        "CREATE VIEW v AS SELECT 1": ("other", None, None),
        "SELECT 1": ("other", None, None),
    }
    df = rows("s string", [(s,) for s in statements])
    found = df.select("s", scan.classify_statement(F.col("s")).alias("c")).select("s", "c.*").collect()
    assert {r["s"]: (r["kind"], r["target"], r["using"]) for r in found} == statements


def test_cells_split_at_the_separator(rows, got):
    pasted = rows("id int, text string", [(1, "a\n# --- cell ---\n b \n#---CELL---\n\n"), (2, "  "), (3, "x # --- cell --- y")])
    assert got(text.split_cells(pasted, ["id"])) == [(1, 0, "a"), (1, 1, "b"), (3, 0, "x # --- cell --- y")]
