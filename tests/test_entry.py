import __spark_entry__ as entry


def test_every_query_runs_and_has_stable_columns(spark, sf_dir):
    queries, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(queries)
    for name in ("scan_code", "rule_flow_pack_code", "lines_explode"):
        assert queries[name](spark, sf_dir).columns
    assert entry.entry(spark).columns == ["rule", "severity", "file", "line", "code"]
