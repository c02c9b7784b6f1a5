import duckdb
import pytest

from harrier import queries


def _tables(spark, folder, documents, pages):
    spark.createDataFrame(documents, "doc_id long, text string").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(f"{folder}/pages.parquet")


def _oracle(folder, name, tables=("documents", "pages")):
    con = duckdb.connect()
    for t in tables:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet/*.parquet')")
    con.execute(queries.oracle_sql()[name])
    return [c[0] for c in con.description], con.fetchall()


@pytest.mark.parametrize("name", ["match_text_documents", "match_text_pages"])
def test_addresses_mentioned_twice_as_in_sql(spark, tmp_path, name):
    lines = ['<a href="/45.67.89.10">45.67.89.10</a>', "at 45.67.89.12 and >= 1 or > 45.67.89.12", "x 45.67.89.14 45.67.89.16 y", "see 45.67.89.18 x/45.67.89.18", "plain 45.67.89.20", "a\r", "v45.67.89.22 or 45.67.89.22\r", "45.67.89.24 then 45.67.89.24", "<b>45.67.89.26</b>"]
    texts = [*lines, "\n".join(lines), "", None]
    _tables(spark, tmp_path, list(enumerate(texts)), [(k, "", x) for k, x in enumerate(texts)])
    columns, expected = _oracle(tmp_path, name)
    got = [tuple(r) for r in queries.queries()[name](spark, str(tmp_path)).select(*columns).collect()]
    # a line's carriage return is no part of it here
    assert sorted(got) == sorted(tuple(x.replace("\r", "") if isinstance(x, str) else x for x in r) for r in expected) and len(got) >= 4


def test_packages_of_one_file_are_judged_on_all_cores(spark, tmp_path):
    from harrier.plans import packages

    spark.range(1, 5001).selectExpr("id AS p_partkey").coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    own = packages.packages(spark, str(tmp_path))
    sizes = own.select("package").rdd.glom().map(len).collect()
    assert sum(sizes) == 5000 and own.select("package").distinct().count() == 5000
    assert len(sizes) >= 4 * spark.sparkContext.defaultParallelism and max(sizes) < 2 * 5000 / len(sizes)


@pytest.mark.parametrize("query", [queries.rule_scan_pages, queries.rule_lines_documents])
def test_rule_scans_bound_their_batches_by_bytes(spark, tmp_path, query):
    spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")
    _tables(spark, tmp_path, [(0, "doas ls\n" + "é" * 100_000)], [(0, "", "doas ls\n" + "é" * 100_000)])
    assert query(spark, str(tmp_path)).count() == 1
    assert int(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")) <= 8 << 20


def test_matcher_computes_its_set_once_and_looks_for_its_kinds_only(spark, tmp_path):
    _tables(spark, tmp_path, [(0, "at 45.67.89.10 http://45.67.89.10/x evil.io ::1:2")], [(0, "", "")])
    own = queries.match_text_documents(spark, str(tmp_path))
    plan = own._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet") <= 2 and "Union" not in plan
    assert [(r.value, r.line_number) for r in own.collect()] == [("45.67.89.10", 1)]
    # all kinds of a mixed set are still found
    columns, expected = _oracle(tmp_path, "match_lines")
    assert sorted(map(tuple, queries.match_lines(spark, "").select(*columns).collect())) == sorted(expected)
