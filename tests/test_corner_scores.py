"""corner_scores on rows whose values are ties but for the last digit of a double."""

import duckdb

from graupel.plans import catalogue

COLUMNS = "l_orderkey, l_linenumber, l_partkey, l_suppkey, l_discount"
#: A turn of -0.0001 but for its last digit, on keys of sf0.1, and a score that ends in 5 at the seventh place.
ROWS = """
select * from (select {c} from '/root/testdata/sf0.1/lineitem.parquet' where (l_orderkey, l_linenumber) in ((54700, 1), (76890, 4), (81440, 2), (110560, 7)))
union all select 5859777, 6, 1 + i % 300, 1 + (i // 300) % 280, d / 100 from (select {i} as i, range::double as d from range(11))
"""


def test_ties_fall_as_in_sql(spark, tmp_path):
    i = next(i for i in range(5859777 % 70 * 84000, 5880000) if (i // 84000) % 70 + 70 * (i % 84000) == 5859777)
    duckdb.sql(ROWS.format(c=COLUMNS, i=i)).write_parquet(str(tmp_path / "lineitem.parquet"))
    duck = duckdb.connect()
    duck.execute(f"create view lineitem as select * from '{tmp_path}/lineitem.parquet'")
    want = duck.execute(catalogue.oracle_sql()["corner_scores"])
    names = [d[0] for d in want.description]
    got = catalogue.queries()["corner_scores"](spark, str(tmp_path)).select(*names).collect()
    assert sorted(map(tuple, got)) == sorted(want.fetchall())
