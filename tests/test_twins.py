"""Queries and their SQL on rows that the smallest tables do not have."""

import duckdb
import pytest

from foliotab import plans
from foliotab.plans import registry

plans.load()

PARTS = "(values (1, 1000005), (2, 5), (1, 7), (2, 1000010), (2, 20), (1, 1000020)) as x(l_suppkey, l_partkey)"
TABLES = {
    # a customer's equal orders are one row after the deduplication step
    "e24_run_plan": {"orders": "select i as o_orderkey, i // 6 as o_custkey, ['O', 'F'][1 + i % 2] as o_orderstatus, cast([10.5, 10.5, 20.25, 0.5, 20.25, 21][1 + i % 6] as double) as o_totalprice from range(60) t(i)"},
    # the first event of a log ends the experiment, whatever its type
    "g21_parse_summary": {"events": "select i as event_id, 7 * (i % 3) as user_id, ['purchase', 'view', 'click', 'view', 'view'][1 + i % 5] as event_type, cast(i as double) / 4 as value from range(40) t(i)"},
    # more rows a group than the sketch of quantiles keeps
    "g28_latency_tokens": {"events": "select i as event_id, i % 3 as user_id, ['view', null][1 + i % 2] as event_type, case when i % 11 > 0 then cast(hash(i) % 1000003 as double) / 8 end as value, '{\"k\": 3}' as props from range(300000) t(i)"},
    # part keys of seven digits
    "f34_air_topology": {"supplier": "select i as s_suppkey, 'Supplier ' || i as s_name from range(1, 3) t(i)", "lineitem": f"select cast(l_suppkey as bigint) as l_suppkey, cast(l_partkey as bigint) as l_partkey from {PARTS}"},
}


@pytest.mark.parametrize("name", sorted(TABLES))
def test_query_is_its_sql(spark, tmp_path, name):
    con = duckdb.connect()
    for table, sql in TABLES[name].items():
        con.execute(f"copy ({sql}) to '{tmp_path}/{table}.parquet' (format parquet)")
        con.execute(f"create view {table} as select * from '{tmp_path}/{table}.parquet'")
    got = registry.QUERIES[name](spark, str(tmp_path))
    want = con.execute(registry.SQL[name]).to_arrow_table().select(got.columns)
    rows = lambda t: sorted((tuple(r.values()) for r in t.to_pylist()), key=repr)
    assert rows(got.toArrow()) == rows(want)
