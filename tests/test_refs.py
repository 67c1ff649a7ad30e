import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from factloom.functions import refs


def column(rows, data, build):
    df = rows("v string", [(x,) for x in data])
    return [r[0] for r in df.select(build(F.col("v")).alias("r")).collect()]


QUALIFIED = {
    "orders": "ws/lh/orders",
    "lh2.orders": "ws/lh2/orders",
    "w2.lh2.orders": "w2/lh2/orders",
    "a.b.c.d": "b/c/d",
    "`t`": "ws/lh/t",
    "'t'": "ws/lh/t",
    "`lh2`.`t`": "ws/lh2/t",
    "Bronze.Lakehouse.t": "Bronze/Lakehouse/t",
    "Files/landing/orders/*.csv": "ws/lh/Files%2Flanding%2Forders%2F*.csv",
    "files/x": "ws/lh/files%2Fx",
    "Tables/orders/_delta_log/00000000000000000000.json": "ws/lh/orders",
    "Tables/orders/part-0000.snappy.parquet": "ws/lh/orders",
    "Tables/": "ws/lh/Tables",
    "/Tables/": "ws/lh/",
    "orders.csv": "ws/orders/csv",
    "50%": "ws/lh/50%25",
    "abfss://W1@host/L1.Lakehouse/Tables/dbo/orders": "W1/L1/orders",
    "abfss://onelake@host/W1/L1/Files/a/b.csv": "W1/L1/Files%2Fa%2Fb.csv",
    "ABFSS://W1@host/L1.warehouse/Tables/orders/": "W1/L1/orders",
    "abfss://W1@host/": "ws/lh/W1@host",  # the trailing slash goes first, and what is left is a path
    "": "//",
    "  ": "//",
    None: "//",
}


def test_qualify(rows):
    assert dict(zip(QUALIFIED, column(rows, list(QUALIFIED), lambda v: refs.qualify(v, "ws", "lh")))) == QUALIFIED


def test_same_table_in_two_workspaces_stays_two(rows):
    got = column(rows, ["Finance.Gold.customers", "Marketing.Gold.customers"], refs.qualify)
    assert got == ["Finance/Gold/customers", "Marketing/Gold/customers"]


def test_parse_short_and_long_refs(rows):
    got = column(rows, ["t", "lh/t", "w/l/t", "w/l/a/b", "//t", "w%2f1/l%252F/t"], lambda v: F.to_json(refs.parse_ref(v)))
    assert got == [
        '{"workspace":"","lakehouse":"","table":"t"}',
        '{"workspace":"","lakehouse":"lh","table":"t"}',
        '{"workspace":"w","lakehouse":"l","table":"t"}',
        '{"workspace":"w","lakehouse":"l","table":"a/b"}',
        '{"workspace":"","lakehouse":"","table":"t"}',
        '{"workspace":"w/1","lakehouse":"l%2F","table":"t"}',
    ]


@settings(max_examples=20, deadline=None)
@given(st.lists(st.text(alphabet="ab/%2F5. é", max_size=8), min_size=3, max_size=3))
def test_parse_undoes_make(spark, parts):
    df = spark.createDataFrame([tuple(parts)], "w string, l string, t string")
    back = df.select(refs.parse_ref(refs.make_ref(F.col("t"), F.col("l"), F.col("w"))).alias("p")).select("p.*").first()
    assert tuple(back) == tuple(parts)


def test_view_names(rows):
    raw = ["staged", "global_temp.staged", "STAGED", "lh.staged", "`s`", "a/b", "1a", "", "été"]
    assert column(rows, raw, refs.normalise_view_name) == ["staged", "staged", "staged", None, "s", None, None, None, "été"]


@pytest.mark.parametrize("name, label", [
    ("invoke pl_20 / invoke pl_21 / run nb_orders", "nb_orders"), ("run", "run"), ("Run x", "x"), ("runner x", "runner x"), ("a / run ", "run ")])
def test_activity_label(rows, name, label):
    assert column(rows, [name], refs.activity_label) == [label]


def test_stage_needs_a_whole_token(rows):
    names = ["lh_bronze", "Bronze", "bronzed", "gold2", "raw_silver", "x", None]
    assert column(rows, names, refs.stage_rank) == [3, 3, -1, 5, 1, -1, -1]


def test_copy_column_name_takes_the_last_segment(rows):
    df = rows("n string, p string", [("id", None), (None, "$['customer']['id']"), ("", "$.a.b"), (None, None)])
    got = [r[0] for r in df.select(refs.copy_column_name(F.col("n"), F.col("p"))).collect()]
    assert got == ["id", "id", "b", ""]


def test_names_resolve_without_losing_unknown_guids(rows, got):
    df = rows("raw string", [("abfss://AA@h/BB/Tables/t",), ("AA.BB.t",)])
    names = rows("guid string, name string", [("aa", "Sales/EU")])
    assert got(refs.qualify_refs(df, "raw", names), "ref") == [("AA/BB/t",), ("Sales%2FEU/BB/t",)]


def test_label_is_all_after_the_second_slash(rows):
    named = {"w/l/t": "t", "w/l/a/b": "a/b", "w/l/": "w/l/", "l/t": "t", "t": "t", "l/": "l/", "//x": "x", "//": "//", "": "", "w/l/a%2Fb%25": "a/b%", None: None}
    made = rows("ref string", [(ref,) for ref in named]).withColumn("label", refs.ref_label(F.col("ref")))
    assert {r["ref"]: r["label"] for r in made.collect()} == named
    assert made._jdf.queryExecution().optimizedPlan().toString().count("substring_index(ref") <= 3
