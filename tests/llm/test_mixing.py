import re

from tallybrook.llm.mixing import Mix

SCHEMA = "doc_id long, text string, source string, size string, draw int"


def filled(sizes, weights, total, epochs):
    """Clamp and reshare until none is above its cap."""
    caps = {s: epochs * n for s, n in sizes.items()}
    left, rest, out = total * sum(sizes.values()), set(sizes), {}
    while rest:
        level = left / sum(weights[s] for s in rest)
        full = {s for s in rest if level * weights[s] >= caps[s]}
        if not full:
            return out | {s: level * weights[s] for s in rest}
        for s in full:
            out[s] = caps[s]
            left -= caps[s]
        rest -= full
    return out


def check(spark, rows, **options):
    mix = Mix(**options)
    got = [r.asDict() for r in mix.apply(spark.createDataFrame(rows, SCHEMA)).collect()]
    count = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    assert sorted((str(r["doc_id"]), r["size"]) for r in got) == sorted((str(r[0]), count(r[1])) for r in rows)
    order = sorted({r[2] for r in rows}, key=lambda s: (s is None, s or ""))
    weights = {s: mix.weights[i % len(mix.weights)] for i, s in enumerate(order)}
    sizes = {s: sum(count(r[1]) for r in rows if r[2] == s) for s in order}
    want = filled(sizes, weights, mix.total, mix.epochs)
    for s in order:
        mine = [r for r in got if r["source"] == s]
        assert all(r["source_size"] == sizes[s] and abs(r["target"] - want[s]) < 1e-6 for r in mine)
        assert abs(sum(r["taken"] for r in mine) - want[s]) <= max([r["size"] for r in mine]) + 1e-6
        assert all(r["taken"] <= mix.epochs * r["size"] for r in mine)
    again = [r.asDict() for r in mix.apply(spark.createDataFrame(rows[::-1], SCHEMA)).collect()]
    assert sorted(map(str, again)) == sorted(map(str, got))


def test_hot_source(spark):
    check(spark, [(i, "w " * (i % 17), "a" if i % 3 else f"s{i % 5}", None, i) for i in range(400)], bins=16)


def test_odd_rows(spark):
    check(spark, [(1, None, None, "x", 1), (None, "a b", None, "x", 1), (1, "", "é", "x", 1), (5, "a\tb\x0bc", "Z", "x", 1), (5, "a\tb\x0bc", "Z", "x", 1), (6, "x" * 100_000 + " y" * 50_000, "z", "x", 1)])


def test_all_saturated(spark):
    check(spark, [(i, "a b c", f"s{i % 3}", None, 0) for i in range(9)], total=5.0)


def test_one_id_for_all(spark):
    """The cut falls among rows that share an id: copies of one document, and documents that differ."""
    check(spark, [(None, f"w{k} " * (k % 5), "a", "x", 1) for k in range(100)] + [(2, "v", "b", "x", 1)], bins=16)
    check(spark, [(7, "w " * 4, None, "x", 1)] * 3000 + [(2, "v " * 12_000, "b", "x", 1)], bins=16, weights=(5, 3))


def test_same_as_sql_where_ids_repeat(spark, tmp_path):
    import duckdb

    from tallybrook.llm.queries import OP10_SQL

    rows = [(k % 9 if k % 4 else None, "w " * (k % 6), "abc"[k % 3] if k % 7 else None) for k in range(300)] + [(5, "w w w", "a")] * 200
    spark.createDataFrame(rows, "doc_id long, text string, source string").write.parquet(f"{tmp_path}/d")
    duckdb.sql(f"CREATE OR REPLACE VIEW documents AS SELECT * FROM '{tmp_path}/d/*.parquet'")
    got = Mix().apply(spark.read.parquet(f"{tmp_path}/d")).select("doc_id", "size", "source", "source_size", "target", "repeats", "taken").collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, duckdb.sql(OP10_SQL).fetchall()))


def test_rows_pass_whole_and_as_often_as_counted(spark):
    rows = [(7, "w w w", "a", "x", 1)] * 50 + [(i, "v " * i, "b", None, i) for i in range(20)]
    d = spark.createDataFrame(rows, SCHEMA).withColumnsRenamed({"size": "row", "draw": "content"})
    out = Mix().repeated(d)
    assert out.columns == d.columns
    want = sum(r.repeats for r in Mix().apply(d).collect())
    assert abs(out.count() - want) == 0 and set(map(tuple, out.collect())) <= set(rows)


def test_empty(spark):
    assert Mix().apply(spark.createDataFrame([], SCHEMA)).count() == 0
