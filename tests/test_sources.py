import json
import random

import pytest
from pyspark.sql import functions as F

from cellwright.operators.fuzzy import _lcs, apply_canonical, canonical_keys, fuzzy_canonical, fuzzy_pairs, value_keys
from cellwright.operators.rows import with_file_row_index
from cellwright.sources import delimited
from cellwright.sources.benchmarks import run_benchmarks
from cellwright.sources.readers import from_records, load, load_file, nan_to_null
from cellwright.sources.writers import append_audit, save_csv, save_json, sidecar
from cellwright.streaming.batches import clean_batches, file_stream, merged_counts, merged_schema, normalize_stream, read_batches


def test_text_files(spark, tmp_path):
    p = tmp_path / "a.csv"
    p.write_text('a,b\n1,\n"x, ""y""",""\n')
    assert [tuple(r) for r in load_file(spark, str(p)).collect()] == [("1", ""), ('x, "y"', "")]
    t = tmp_path / "a.tsv"
    t.write_text("a\tb\n1\t2\n")
    assert load(spark, str(t)).first()["b"] == "2"
    old = tmp_path / "old.csv"
    old.write_bytes("n\nJosé\n".encode("latin-1"))
    assert load_file(spark, str(old)).first()["n"] == "José"
    quoted = tmp_path / "quoted.csv"
    quoted.write_text('a,b\n"two\nlines",1\n')
    assert load_file(spark, str(quoted), multi_line=True).first()["a"] == "two\nlines"
    with pytest.raises(ValueError):
        load_file(spark, "x.doc")
    with pytest.raises(FileNotFoundError):
        load_file(spark, str(tmp_path / "none.csv"))


def test_typed_sources_and_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, 2.0, None), (2, float("nan"), "x")], "i int, d double, s string")
    path = str(tmp_path / "t.parquet")
    df.write.parquet(path)
    assert sorted(map(tuple, load_file(spark, path).collect()), key=str) == [("1", "2.0", None), ("2", "nan", "x")]
    assert nan_to_null(df).where("d is null").count() == 1
    assert tuple(from_records(spark, [{"a": 1, "b": None}]).first()) == ("1", None)
    out = save_csv(df, str(tmp_path / "out.csv"))
    assert spark.read.option("header", True).csv(out).count() == 2
    save_json(df, str(tmp_path / "out.json"))
    assert sidecar("/x/out.csv", "audit") == "/x/out.audit.json"
    for _ in range(2):
        append_audit(df, str(tmp_path / "audit"))
    assert spark.read.json(str(tmp_path / "audit")).count() == 4


def test_file_rows_are_numbered_in_file_order(spark, tmp_path):
    for i in range(3):
        spark.range(i * 10, i * 10 + 10, numPartitions=1).write.mode("append").parquet(str(tmp_path / f"f{i}"))
    df = spark.read.parquet(*[str(tmp_path / f"f{i}") for i in (2, 0, 1)])
    rows = with_file_row_index(df).orderBy("_row").collect()
    assert [(r["_row"], r["id"]) for r in rows] == [(i, i) for i in range(30)]


def test_each_file_has_its_own_encoding_and_rows_their_file_order(spark, tmp_path):
    folder = tmp_path / "many.csv"
    folder.mkdir()
    texts = [["café", "\ufffd"], ["x"] * 50, ["José", "Łódź"], ["last"]]
    for i, rows in enumerate(texts):
        (folder / f"{'abcd'[i]}.csv").write_bytes(("größe\n" + "".join(f"{r}\n" for r in rows)).encode())
    want = [r for rows in texts for r in rows]
    df = load_file(spark, str(folder), row_index=True)
    assert df.columns == ["_row", "größe"]
    assert [r["größe"] for r in df.orderBy("_row").collect()] == want and df.agg({"_row": "max"}).first()[0] == len(want) - 1
    (folder / "e.csv").write_bytes("größe\nJosé\n".encode("latin-1"))
    assert sorted(r["größe"] for r in load_file(spark, str(folder)).collect()) == sorted([*want, "José"])


def test_benchmark_pairs(spark, tmp_path):
    (tmp_path / "one_dirty.csv").write_text("name,age\n" + "".join(f"n{i},{20 + i}\n" for i in range(9)) + "n9,\n")
    (tmp_path / "one_ground_truth.json").write_text(json.dumps([{"row": 9, "column": "age", "expected_value": "24.0"}]))
    (tmp_path / "lonely_dirty.csv").write_text("a\n1\n")
    out = tmp_path / "out"
    metrics, errors = run_benchmarks(spark, str(tmp_path), str(out))
    r = metrics.first()
    assert not errors and r["dataset"] == "one" and r["precision"] == 1.0 and r["recall"] == 1.0
    assert spark.read.json(str(out / "evaluation")).first()["dataset"] == "one"
    assert (out / "one_cleaned.report.json").exists()


def test_streams(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    df = spark.createDataFrame([(str(i), "Yes" if i % 2 else "") for i in range(20)], "n string, flag string")
    df.coalesce(1).write.parquet(source)
    stream = spark.readStream.schema(df.schema).parquet(source)
    clean_batches(stream, out, str(tmp_path / "cp"), order_by=["n"]).awaitTermination()
    got = read_batches(spark, out)
    assert got.count() == 20 and got.where("flag = ''").count() == 0
    # a replay under a fresh checkpoint writes the same batch again, not a second copy
    clean_batches(stream, out, str(tmp_path / "cp2"), order_by=["n"]).awaitTermination()
    assert read_batches(spark, out).count() == 20
    q = normalize_stream(stream, ["flag"]).writeStream.format("memory").queryName("flags").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("flags").where("flag = 'true'").count() == 10


def test_stream_keeps_file_order_and_adds_counts_up(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    schema = "n string, flag string"
    for part in range(2):
        rows = [(str(100 * part + i * 7 % 50), "Yes" if i % 2 else "") for i in range(50)]
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
    stream = file_stream(spark, source, schema, files_per_batch=1)
    clean_batches(stream, out, str(tmp_path / "cp")).awaitTermination()
    got = read_batches(spark, out)
    assert got.select("batch_id").distinct().count() == 2 and got.count() == 100
    for b in range(2):
        rows = [int(r["n"]) % 100 for r in got.where(F.col("batch_id") == b).orderBy("_row").collect()]
        assert rows == [i * 7 % 50 for i in range(50)]
    counts = {(r["column"], r["value"]): r["n"] for r in merged_counts(spark, out).collect()}
    assert counts["flag", "Yes"] == 50 and counts["flag", ""] == 50 and len(counts) == 102
    # a replay writes every batch again, and the state is the same
    clean_batches(stream, out, str(tmp_path / "cp2")).awaitTermination()
    assert {(r["column"], r["value"]): r["n"] for r in merged_counts(spark, out).collect()} == counts
    types = {r["column"]: r["dtype"] for r in merged_schema(spark, out).collect()}
    assert types == {"n": "integer", "flag": "boolean"}


def _levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


@pytest.mark.parametrize("metric,threshold", [("ratio", 0.9), ("ratio", 0.7), ("ratio", 0.5), ("levenshtein", 0.8), ("levenshtein", 0.6), ("levenshtein", 0.4)])
def test_fuzzy_finds_all_a_nested_loop_finds(spark, metric, threshold):
    rng = random.Random(4)
    canon = list(dict.fromkeys("".join(rng.choice("abc ") for _ in range(rng.randint(3, 14))).strip() or "z" for _ in range(50)))
    values = set()
    for _ in range(200):
        w = list(rng.choice(canon))
        for _ in range(rng.randint(0, 3)):
            if rng.random() < 0.5:
                w.insert(rng.randint(0, len(w)), rng.choice("abcX"))
            elif len(w) > 1:
                w.pop(rng.randrange(len(w)))
        values.add("".join(w))

    def score(a, b):
        if metric == "ratio":
            return round(200 * _lcs(a, b) / (len(a) + len(b))) / 100
        return 1 - _levenshtein(a, b) / max(len(a), len(b))

    want = {}
    for v in values:
        best = max(canon, key=lambda c: score(v.lower(), c.lower()))
        if score(v.lower(), best.lower()) >= threshold - 1e-12 and best != v:
            want[v] = best
    vd = spark.createDataFrame([(v,) for v in values], "t string")
    cd = spark.createDataFrame(list(zip(canon, range(len(canon)))), "canonical string, place int")
    mapping = fuzzy_canonical(vd, "t", cd, threshold, metric)
    assert {r["value"]: r["canonical"] for r in mapping.collect()} == want
    applied = {r["t"] for r in apply_canonical(vd, "t", mapping).collect()}
    assert applied == {want.get(v, v) for v in values}


def odd_table(seed, n):
    rng = random.Random(seed)
    cells = ["", "plain", "two\nlines", 'say ""x""', "a,b", "\n", "ends\n", '"', "é", " blank ", "x" * 50, 'odd " one', "\n\n,\n"]
    return [[str(i), *[rng.choice(cells) for _ in range(3)]] for i in range(n)]


@pytest.mark.parametrize("ending", ["\n", "\r\n"])
def test_quoted_line_feeds_in_many_tasks(spark, tmp_path, ending):
    """A file cut into ranges of 700 bytes, in the middle of cells, gives the rows that one task reads."""
    import csv

    rows, path = odd_table(len(ending), 400), str(tmp_path / "odd.csv")
    with open(path, "w", newline="") as f:
        csv.writer(f, lineterminator=ending).writerows([["id", "a", "b\nb", "a"], *rows])
    was = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        for k in was:
            spark.conf.set(k, "700")
        df = load_file(spark, path, row_index=True)
        got = sorted(map(tuple, df.collect()))
        assert spark.read.text(path).rdd.getNumPartitions() > 20
    finally:
        for k, v in was.items():
            spark.conf.set(k, v)
    assert df.columns == ["_row", "id", "a1", "b\nb", "a3"]
    assert got == [(i, *r) for i, r in enumerate(rows)]


def test_tasks_of_a_large_file_hold_a_slot_each(spark, tmp_path, monkeypatch):
    """A task gets a slot's bytes and one range at most, with 2 shuffle partitions too."""
    import csv

    rows, path = odd_table(5, 600), str(tmp_path / "large.csv")
    with open(path, "w", newline="") as f:
        csv.writer(f, lineterminator="\n").writerows([["id", "a", "b", "c"], *rows])
    monkeypatch.setattr(delimited, "SLOT_BYTES", 1500, raising=False)
    settings = {"spark.sql.files.maxPartitionBytes": "700", "spark.sql.files.openCostInBytes": "700", "spark.sql.shuffle.partitions": "2"}
    was = {k: spark.conf.get(k) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        marked = delimited.marked_lines(delimited.text_lines(spark, path), ",")
        found = delimited.records(marked, delimited.range_states(marked)).withColumn("task", F.spark_partition_id())
        tasks = found.groupBy("task").agg(F.sum(F.octet_length("record")).alias("n"), F.count("*").alias("records")).collect()
        got = sorted(map(tuple, load_file(spark, path, row_index=True).collect()))
    finally:
        for k, v in was.items():
            spark.conf.set(k, v)
    assert got == [(i, *r) for i, r in enumerate(rows)]
    assert sum(t["records"] for t in tasks) == 601
    # records that cross a range's end are a few more, in the 2 tasks of a second shuffle
    assert len(tasks) > 8 and sorted(t["n"] for t in tasks)[-3] <= 1500 + 700


def test_stray_quotes_open_no_cell(spark, tmp_path):
    p = tmp_path / "stray.csv"
    p.write_text('a,b\n5" pipe,1\nx"y"z,2\n"in\nside",3\n7" rod,4\n')
    assert sorted(map(tuple, load_file(spark, str(p)).collect())) == sorted([('5" pipe', "1"), ('x"y"z', "2"), ("in\nside", "3"), ('7" rod', "4")])
    assert load_file(spark, str(p), multi_line=False).count() == 5


def test_line_feeds_in_latin_files_beside_others(spark, tmp_path):
    folder = tmp_path / "both.csv"
    folder.mkdir()
    (folder / "1.csv").write_bytes('n,m\n"José\nA",1\n'.encode("latin-1"))
    (folder / "2.csv").write_bytes('n,m\nZoë,2\n"Zoë\n\nB",3\n'.encode())
    assert [tuple(r) for r in load_file(spark, str(folder), row_index=True).orderBy("_row").collect()] == [(0, "José\nA", "1"), (1, "Zoë", "2"), (2, "Zoë\n\nB", "3")]


def test_fuzzy_long_texts_and_keys(spark):
    """Edits anywhere in long texts are found; keys grow with the length of a text, and none is empty."""
    rng = random.Random(8)
    canon = ["".join(rng.choice("abcdefgh ") for _ in range(n)) for n in (40, 41, 90, 200, 200)]
    canon.append(canon[3][:100] + canon[4][100:])
    values = set()
    for c in canon * 12:
        w = list(c)
        for _ in range(rng.randint(1, len(w) // 12)):
            at = rng.choice([0, len(w) - 1, rng.randrange(len(w))])
            rng.choice([lambda: w.insert(at, "x"), lambda: w.pop(at), lambda: w.__setitem__(at, "y")])()
        values.add("".join(w))
    vd = spark.createDataFrame([(v,) for v in values], "v string")
    cd = spark.createDataFrame([(c,) for c in canon], "c string")
    for metric, score in (
        ("ratio", lambda a, b: round(200 * _lcs(a, b) / (len(a) + len(b))) / 100),
        ("levenshtein", lambda a, b: 1 - _levenshtein(a, b) / max(len(a), len(b))),
    ):
        want = {(v, c) for v in values for c in canon if score(v, c) >= 0.9 - 1e-12}
        assert len(want) > 20 and {(r["v"], r["c"]) for r in fuzzy_pairs(vd, cd, metric, 0.9).collect()} == want
        keys = value_keys(vd, metric, 0.9).groupBy("v").count().collect()
        assert max(r["count"] / len(r["v"]) for r in keys) < 10
        taken = canonical_keys(cd, metric, 0.9)
        assert taken.where("length(piece) < 3").count() == 0
        # 0.235 of a length is the most that partners can differ, and one piece more
        assert all(r["count"] <= 0.235 * len(r["c"]) + 1 for r in taken.groupBy("c").count().collect())
