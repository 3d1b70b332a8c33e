import duckdb
import pytest
from oracle import connect, difference

from earshot.plans import catalog


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_equals_sql(spark, sf_dir, con, name):
    assert difference(catalog.QUERIES[name](spark, sf_dir), con, catalog.ORACLES[name]) == ""


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES)))
def test_query_has_rows(spark, sf_dir, name):
    assert catalog.QUERIES[name](spark, sf_dir).count() > 0


def test_surrogate_words_give_every_label(spark, sf_dir):
    got = {r["label"] for r in catalog.QUERIES["label_counts"](spark, sf_dir).collect()}
    assert got == {"low", "neutral", "high", "mixed"}


def differs_on_turns(spark, path, name, calls) -> str:
    """What a query over these calls, lists of (role, text), has else than its SQL."""
    rows = [(c, t, role, text) for c, turns in enumerate(calls) for t, (role, text) in enumerate(turns)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").coalesce(1).write.parquet(f"{path}/conversations.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM read_parquet('{path}/conversations.parquet/*.parquet')")
    return difference(catalog.QUERIES[name](spark, str(path)), con, catalog.ORACLES[name])


#: Beside cue words, letters beyond ASCII, which end a word in SQL; and s as a long s, which is one in any case.
BESIDE = ("{}", "\u00f1{}", "{}\u00f1", "\u00e9{}\u00e9", "x{}", "{}_", "\u65e5{}", "\u0301{}", "\u00a0{}\u00a0", "({})")


def test_questions_start_at_words_as_in_sql(spark, tmp_path):
    words = ("que", "DER", "le\u017f", "le\u017fx", "The")
    calls = [[("assistant", "mm " * 25), ("user", "mm"), ("assistant", f"mm {b.format(w)} mm"), ("user", "mm"), ("user", "mm")] for w in words for b in BESIDE]
    assert differs_on_turns(spark, tmp_path, "qna_split", calls) == ""


def test_first_questions_are_words_as_in_sql(spark, tmp_path):
    words = ("die", "DES", "deſ", "deſx", "The")
    calls = [[("assistant", "mm"), ("assistant", f"mm {b.format(w)} mm"), ("user", "mm " * 9)] for w in words for b in BESIDE]
    assert differs_on_turns(spark, tmp_path, "unlisted_mgmt", calls) == ""


#: Columns of orders and of lineitem, some of whose values are taken away.
WITHOUT = {
    "confidence": (["o_totalprice"], []),
    "dates of bars": ([], ["l_shipdate"]),
    "order of prices": ([], ["l_orderkey"]),
    "tickers": (["o_custkey"], ["l_suppkey"]),
}


@pytest.mark.parametrize("orders, lineitem", WITHOUT.values(), ids=WITHOUT)
def test_quintile_means_of_tables_with_nulls_as_in_sql(spark, sf_dir, tmp_path, orders, lineitem):
    con = duckdb.connect()
    for table, key, columns in (("orders", "o_orderkey", orders), ("lineitem", "l_orderkey", lineitem)):
        few = "* REPLACE (o_custkey % 10 AS o_custkey)" if table == "orders" else "*"  # as many tickers as have prices
        nulls = "".join(f" REPLACE (CASE WHEN hash({key}, '{c}') % 4 > 0 THEN {c} END AS {c})" for c in columns)
        path = f"{tmp_path}/{table}.parquet"
        con.execute(f"COPY (SELECT *{nulls} FROM (SELECT {few} FROM read_parquet('{sf_dir}/{table}.parquet'))) TO '{path}'")
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{path}')")
    sql = catalog.ORACLES["quintile_means"]
    assert len(con.execute(sql).fetchall()) == 5 and difference(catalog.QUERIES["quintile_means"](spark, str(tmp_path)), con, sql) == ""
