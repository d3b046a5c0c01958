import duckdb

from loam.llm import line_dedup as m


def plain(rows):
    seen, out = set(), {}
    for d, t in sorted((r for r in rows if r[1] is not None), key=lambda r: r[0]):
        lines, gone = t.split("\n"), set()
        for i in range(len(lines) - 2):
            w = tuple(lines[i : i + 3])
            gone |= set(range(i, i + 3)) if w in seen else set()
            seen.add(w)
        out[d] = "\n".join(x for i, x in enumerate(lines) if i not in gone)
    return out


def test_query_equals_sql(spark, small):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{small}/documents.parquet'")
    assert sorted(map(tuple, m.query(spark, small).select("doc_id", "n_lines", "n_removed", "kept_sha256").collect())) == sorted(con.execute(m.SQL).fetchall())


def test_odd_rows(odd, none, pairs):
    got = {r.doc_id: r.text for r in m.deduplicated(odd).collect() if r.doc_id is not None}
    want = plain(pairs)
    assert {k: v for k, v in got.items() if v is not None} == want and got[3] is None
    assert m.deduplicated(odd).columns == odd.columns and m.deduplicated(odd).count() == odd.count()
    assert m.deduplicated(none).count() == 0


def test_overlapping_repeats_merge(spark):
    rows = [(1, "a\nb\nc\nd\ne"), (2, "x\na\nb\nc\nd\ny"), (3, "a\na\na\na\na")]
    got = {r.doc_id: r.text for r in m.deduplicated(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == plain(rows) == {1: "a\nb\nc\nd\ne", 2: "x\ny", 3: "a"}


def test_rows_that_share_a_doc_id_but_not_a_text(spark):
    lines = lambda t: "\n".join(t)
    rows = [(1, lines("abcd")), (2, lines("zabc")), (2, lines("qrst")), (2, lines("qrst")), (3, lines("yqrs"))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, m.deduplicated(df).collect())) == sorted([(1, lines("abcd")), (2, "z"), (2, lines("qrst")), (2, lines("qrst")), (3, "y")])


def test_plan_has_no_python(spark, small):
    plan = m.query(spark, small)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
