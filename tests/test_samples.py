import duckdb

from gleaner import samples
from gleaner.operators import catalogue


def test_every_rule_has_a_sample_that_must_be_found(spark):
    assert {rule for rule, *_ in samples.SAMPLES} == {r.id for r in catalogue.rules(spark).collect()} == {rule for _, rule, _ in samples.EXPECTED}
    assert all(samples.MARK not in code.replace(f" {samples.MARK}", "") for *_, text in samples.SAMPLES for code in text.split("\n"))


def test_each_sample_is_found_where_it_is_marked_and_nowhere_else(spark, sf_dir):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{sf_dir}/documents.parquet'")
    want = set(con.execute(samples.oracle()).fetchall())
    got = {(r.rule, r.file, r.line) for r in samples.found(spark, sf_dir).collect()}
    assert got == want and {rule for rule, *_ in want} == {rule for rule, *_ in samples.SAMPLES}
