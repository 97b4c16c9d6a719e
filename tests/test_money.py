"""Money is parsed from the tag of every order."""

from quotegrid.plans import QUERIES


def test_every_order_is_parsed(spark, sf_dir):
    orders = {r.o_orderkey: r.o_totalprice for r in spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_totalprice").collect()}
    got = {r.o_orderkey: r.amount for r in QUERIES["money_parse_all"](spark, sf_dir).collect()}
    assert got.keys() == orders.keys()
    plain = [k for k in orders if k % 4 == 0]
    assert plain and all(abs(got[k] - orders[k]) < 0.006 for k in plain)
