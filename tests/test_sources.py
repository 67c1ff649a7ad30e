import base64
import json

import pytest
from pyspark.sql import functions as F

from factloom.operators import activities, verbs
from factloom.sources import definitions, delta_log, file_table, notebooks, tables, text


def test_notebook_files(spark, tmp_path, got):
    code = lambda source, **more: {"cell_type": "code", "source": source, **more}
    (tmp_path / "good.ipynb").write_text(json.dumps({"cells": [
        code(["a = 1\n", "b = 2"]), {"cell_type": "markdown", "source": "# no"}, code("%%sql\nSELECT 1"), {"source": "untyped"},
        code("%%pyspark\nc = 3\n"), code("x", metadata={"language": "scala"}), code("SELECT 2", metadata={"language": "sql"}), code("  "), code("[1, 2]")]}, indent=1))
    (tmp_path / "broken.ipynb").write_text("{ not json")
    (tmp_path / "none.ipynb").write_text('{"metadata": {}}')
    (tmp_path / "prose.ipynb").write_text(json.dumps({"cells": [{"cell_type": "markdown", "source": "x"}]}))
    (tmp_path / "blank.ipynb").write_text(json.dumps({"cells": [code(["\n", " "])]}))
    (tmp_path / "other.txt").write_text("ignored")
    found = got(notebooks.read_notebooks(spark, str(tmp_path)), "cell_index", "source")
    assert found == sorted([(0, "a = 1\nb = 2"), (2, "%%sql\nSELECT 1"), (3, "untyped"), (4, "c = 3"), (6, "%%sql\nSELECT 2"), (8, "[1, 2]")], key=repr)
    errors = notebooks.notebook_errors(notebooks.notebook_files(spark, str(tmp_path))).collect()
    assert {r["file"].rsplit("/", 1)[1]: r["error"] for r in errors} == {
        "broken.ipynb": "not valid JSON", "none.ipynb": "no cells array, so not a notebook",
        "prose.ipynb": "no code cells to analyse", "blank.ipynb": "no code cells to analyse"}


def test_plain_files_are_one_cell(spark, tmp_path, got):
    (tmp_path / "a.py").write_text("\nx = 1\n")
    (tmp_path / "b.sql").write_text("  ")
    assert got(text.read_source_files(spark, str(tmp_path)), "cell_index", "source") == [(0, "x = 1")]


def part(document):
    return ("w", "p", "pipeline-content.json", base64.b64encode(document.encode()).decode())


PARTS = "workspace_id string, pipeline_id string, path string, payload string"


def test_definitions_and_copy_lineage(rows, got):
    guid = "AB"
    settings = lambda table: {"datasetSettings": {"typeProperties": {"table": table}, "linkedService": {"name": "svc", "properties": {"typeProperties": {"workspaceId": guid}}}}}
    document = {"properties": {"activities": [
        {"name": "c", "type": "copy", "typeProperties": {"source": settings("src"), "sink": settings("dst"), "translator": {"mappings": [
            {"source": {"path": "$['customer']['id']"}, "sink": {"name": "id"}}, {"source": {"ordinal": 1}, "sink": {"ordinal": 1}}]}}},
        {"name": "plain", "type": "Copy", "typeProperties": {"sink": settings("dst")}, "inputs": [{"referenceName": "ds"}, {"referenceName": " "}]},
        {"name": "unnamed side", "type": "Copy", "typeProperties": {"source": settings("src"), "translator": {"mappings": [{"source": {"name": "a"}, "sink": {"name": "b"}}]}}},
        {"type": "Wait"}, {"name": "nb", "dependsOn": [{"activity": "c"}, "plain", {}], "typeProperties": {"notebook": {"id": "n1"}}}]}}
    activity = definitions.read_definitions(rows(PARTS, [part(json.dumps(document))]))
    assert [r["name"] for r in activity.orderBy("seq").collect()] == ["c", "plain", "unnamed side", "nb"]
    nb = activity.filter("name = 'nb'").first()
    assert (nb["type"], nb["depends_on"], nb["notebook_id"]) == ("Unknown", ["c", "plain"], "n1")
    named = activities.dataset_refs(activity, rows("guid string, name string", [("ab", "Sales")]), "home")
    assert got(activities.copy_lineage(named), "from_table", "from_column", "to_table", "to_column") == [("Sales/svc/src", "id", "Sales/svc/dst", "id")]
    assert got(activities.copy_access(named, "home"), "name", "mode", "ref") == sorted([
        ("c", "read", "Sales/svc/src"), ("c", "write", "Sales/svc/dst"), ("plain", "read", "home//ds"), ("plain", "write", "Sales/svc/dst"),
        ("unnamed side", "read", "Sales/svc/src")])


@pytest.mark.parametrize("document", ["nope", "{}", '{"properties": {"activities": []}}', '{"properties": {"x": 1}, "activities": [{"name": "a"}]}'])
def test_unreadable_definitions_give_nothing(rows, document):
    assert definitions.read_definitions(rows(PARTS, [part(document), ("w", "p", "other.json", "xx")])).count() == 0


def test_activities_at_the_top_level(rows):
    assert definitions.read_definitions(rows(PARTS, [part('{"properties": {}, "activities": [{"name": "a"}]}')])).count() == 1


def test_delta_log_latest_and_first(spark, tmp_path, got):
    log = tmp_path / "Tables" / "t" / "_delta_log"
    log.mkdir(parents=True)
    meta = lambda *fields: json.dumps({"metaData": {"schemaString": json.dumps({"type": "struct", "fields": [dict(zip(("name", "type"), f)) for f in fields]})}})
    (log / f"{0:020d}.json").write_text('{"commitInfo": {}}\n' + meta(("id", "long"), ("a", {"type": "array", "elementType": "string"})))
    (log / f"{3:020d}.json").write_text(meta(("id", "string")))
    lines = delta_log.log_lines(spark, str(tmp_path / "Tables" / "*"))
    assert got(delta_log.table_schemas(lines), "pos", "name", "type") == [(1, "id", "string")]
    assert got(delta_log.table_schemas(lines, latest=False), "pos", "name", "type") == [(1, "id", "long"), (2, "a", "array")]


def test_delta_schema_from_a_checkpoint_whose_commits_are_gone(spark, tmp_path, got):
    import pyarrow as pa
    import pyarrow.parquet as pq

    schema = lambda *names: json.dumps({"type": "struct", "fields": [{"name": n, "type": "long"} for n in names]})

    def checkpoint(table, file, entries):
        log = tmp_path / "Tables" / table / "_delta_log"
        log.mkdir(parents=True, exist_ok=True)
        meta = pa.array([{"id": "x", "schemaString": e} if e else None for e in entries], pa.struct([("id", pa.string()), ("schemaString", pa.string())]))
        pq.write_table(pa.table({"add": pa.array([None] * len(entries), pa.struct([("path", pa.string())])), "metaData": meta}), log / file)
        return log

    one = checkpoint("one", f"{10:020d}.checkpoint.parquet", [None, schema("a", "b"), None])
    (one / f"{11:020d}.json").write_text('{"add": {"path": "x"}}')
    (one / "_last_checkpoint").write_text('{"version": 10, "size": 3}')
    parts = checkpoint("parts", f"{20:020d}.checkpoint.{1:010d}.{2:010d}.parquet", [None])
    checkpoint("parts", f"{20:020d}.checkpoint.{2:010d}.{2:010d}.parquet", [schema("p")])
    checkpoint("parts", f"{10:020d}.checkpoint.parquet", [schema("old")])
    (parts / f"{25:020d}.json").write_text(json.dumps({"metaData": {"schemaString": schema("p", "q")}}))
    checkpoint("named", f"{7:020d}.checkpoint.80a083e8-7026.parquet", [schema("n")])
    found = delta_log.table_schemas(delta_log.replayed(spark, str(tmp_path / "Tables" / "*")))
    assert got(found.select(F.element_at(F.split("table_path", "/"), -1).alias("t"), "pos", "name")) == [
        ("named", 1, "n"), ("one", 1, "a"), ("one", 2, "b"), ("parts", 1, "p"), ("parts", 2, "q")]
    assert delta_log.table_schemas(delta_log.replayed(spark, str(tmp_path / "Tables" / "*")), latest=False).count() == 0


def test_csv_survives_commas_quotes_and_newlines(spark, rows, tmp_path):
    data = [("s", None, "a", "t", "b", 'concat(a, ", ", b)'), ("s", "f", "a", "t", "b", "x\ny")]
    flow = rows("step string, from_table string, from_column string, to_table string, to_column string, transform string", data)
    tables.write_column_lineage_csv(flow.coalesce(1), str(tmp_path / "out"))
    written = next((tmp_path / "out").glob("*.csv")).read_text()
    assert 's,,a,t,b,"concat(a, "", "", b)"' in written and '"x\ny"' in written
    assert written.splitlines()[0] == "step,from_table,from_column,to_table,to_column,transform"


def test_merge(rows, got):
    target = rows("id int, v string", [(1, "a"), (2, "b"), (4, "d"), (None, "n")])
    source = rows("id int, v string", [(2, "B"), (3, "C"), (3, "D"), (4, "gone"), (None, "x"), (None, "y")])
    merged = verbs.merge_rows(target, source, ["id"], delete_when=F.col("s.v") == "gone")
    assert got(merged) == sorted([(1, "a"), (2, "B"), (3, "C"), (3, "D"), (None, "n"), (None, "x"), (None, "y")], key=repr)
    with pytest.raises(Exception, match="several source rows"):
        verbs.merge_rows(target, source.union(source), ["id"]).collect()


def test_range_join_matches_the_plain_condition(rows, got):
    points = rows("p double", [(x / 2,) for x in range(-10, 40)] + [(5e11,), (-1e300,), (1e300,), (None,)])
    ranges = rows("k int, lo double, hi double", [
        (1, -3.0, 4.5), (2, 4.5, 4.5), (3, 0.0, 20.0), (4, 0.0, 1e12), (5, -1e308, 1e308), (6, 7.0, 8.0), (7, None, 3.0), (8, 0.25, 0.75), (9, 5.0, 1.0), (10, -7.5, -0.5)])
    want = points.join(ranges, (F.col("p") >= F.col("lo")) & (F.col("p") < F.col("hi")))
    assert got(verbs.range_join(points, "p", ranges, "lo", "hi"), "k", "p") == got(want, "k", "p")
    assert got(verbs.range_join(points, "p", ranges, "lo", "hi", 0.125), "k", "p") == got(want, "k", "p")
    assert verbs.range_join(points, "p", ranges.limit(0), "lo", "hi").count() == 0


def test_a_bad_byte_in_a_definition(rows):
    import base64

    document = b'{"activities": [{"name": "caf\xe9", "type": "Copy"}]}'
    parts = rows("workspace_id string, pipeline_id string, path string, payload string", [("w", "p", "pipeline-content.json", base64.b64encode(document).decode())])
    assert [r.name for r in definitions.read_definitions(parts).collect()] == ["caf\ufffd"]


def test_a_batch_without_commit_is_not_read(spark, rows, tmp_path, got):
    frame = rows("run_id int, run_date string", [(1, "2024-01"), (2, "2024-02")])
    path = str(tmp_path)
    tables.save_run({"access": frame}, path, "one")
    frame.write.partitionBy("run_date").parquet(f"{path}/access/attempt=lost")  # as a failure before the commit leaves it
    tables.save_run({"access": frame.filter("run_id = 1")}, path, "three")
    assert got(tables.read_runs(spark, path, "access", frame.schema), "run_id", "run_date") == [(1, "2024-01"), (1, "2024-01"), (2, "2024-02")]


def test_one_scan_reads_all_batches_and_saving_again_replaces(spark, rows, tmp_path, got):
    path, schema = str(tmp_path), "run_id int, run_date string"
    assert tables.read_runs(spark, path, "access", schema).count() == 0
    for batch in range(6):
        tables.save_run({"access": rows(schema, [(batch, "2024-01"), (batch, "2024-02")])}, path, f"b/{batch}")
    before = tables.read_runs(spark, path, "access", schema)
    assert before._jdf.queryExecution().optimizedPlan().toString().count("Relation [run_id") == 1
    tables.save_run({"access": rows(schema, [(30, "2024-03")])}, path, "b/3")
    want = sorted([(b, f"2024-0{m}") for b in (0, 1, 2, 4, 5) for m in (1, 2)] + [(30, "2024-03")], key=repr)
    assert got(tables.read_runs(spark, path, "access", schema)) == want
    tables.compact_runs(spark, path, {"access": schema})
    after = tables.read_runs(spark, path, "access", schema)
    assert got(after) == want and got(after.filter("run_date = '2024-03'")) == [(30, "2024-03")]
    tables.save_run({"access": rows(schema, [(7, "2024-04")])}, path, "b/7")
    assert tables.read_runs(spark, path, "access", schema).count() == len(want) + 1


def test_changes_rewrite_only_the_files_they_touch(spark, rows, tmp_path, got):
    table = file_table.FileTable(spark, str(tmp_path), "id int, v string")
    assert table.read().count() == 0 and table.version() == 0
    table.append(rows("id int, v string", [(i, "a") for i in range(100)]).repartitionByRange(10, "id"))
    first = table.files()
    table.update(F.col("id").between(5, 7), {"v": F.lit("b")})
    second = table.files()
    table.delete(F.col("id") >= 95)
    third = table.files()
    table.merge(rows("id int, v string", [(50, "c"), (200, "new"), (None, "n")]), ["id"])
    fourth = table.files()
    for before, after in ((first, second), (second, third), (third, fourth)):
        assert len(set(before) - set(after)) == 1 and len(before) - 1 <= len(set(before) & set(after))
    want = [(i, "b" if 5 <= i <= 7 else "c" if i == 50 else "a") for i in range(95)] + [(200, "new"), (None, "n")]
    assert got(table.read()) == sorted(want, key=repr)
    assert table.read(1).count() == 100 and got(table.read(1).filter("id = 6")) == [(6, "a")]
    table.compact()
    assert len(table.files()) == 1 and got(table.read()) == sorted(want, key=repr)
    table.delete(F.lit(True))
    assert table.files() == [] and table.read().count() == 0
    with pytest.raises(Exception, match="already exists|PATH_ALREADY_EXISTS"):
        table._publish(table.version(), [])


def test_a_stored_variant_is_parsed_once_and_filtered_in_the_scan(spark, rows, tmp_path, got):
    data = [(1, '{"k": 5, "deep": {"x": "y"}}'), (2, '{"k": "text"}'), (3, "no json"), (4, None), (5, "{}"), (6, '{"k": 50, "list": [1, 2]}')]
    stored = verbs.load_variant(rows("id int, doc string", data), "doc", {"k": ("$.k", "bigint")}, str(tmp_path / "v"))
    assert got(stored, "id", "k") == [(1, 5), (2, None), (3, None), (4, None), (5, None), (6, 50)]
    few = stored.filter("k > 10").select("id")
    plan = few._jdf.queryExecution().executedPlan().toString()
    assert got(few) == [(6,)] and "GreaterThan(k,10)" in plan and "doc" not in plan.split("ReadSchema")[1]
    inner = stored.select("id", F.try_variant_get("doc", "$.deep.x", "string").alias("x"), F.try_variant_get("doc", "$.list[1]", "int").alias("n"))
    assert got(inner.filter("x IS NOT NULL OR n IS NOT NULL")) == [(1, "y", None), (6, None, 2)]


def test_unknown_format_is_refused(spark):
    with pytest.raises(ValueError, match="unknown format"):
        tables.read_table(spark, "x", "sas")


def test_a_model_is_written_in_small_files(spark, rows, tmp_path, got):
    """Lines repeat long names: what lies on disk is a small part of them."""
    frame = spark.range(20000).selectExpr("id DIV 10 AS run_id", "concat('col:ws0/lh_bronze/t', id % 12, ':c', id % 7) AS id")
    tables.write_model(frame, frame, frame, frame, str(tmp_path))
    for name in ("entity", "entity_child", "transition", "root"):
        found = spark.read.schema(frame.schema).json(f"{tmp_path}/{name}")
        assert got(found) == got(frame)
        size = sum(f.stat().st_size for f in (tmp_path / name).iterdir())
        assert size * 4 < frame.selectExpr("sum(length(to_json(struct(*))))").first()[0]
