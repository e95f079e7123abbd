import pytest
from pyspark.sql import functions as F

from leverscope.errors import AnalysisError
from leverscope.operators import profile
from leverscope.sources.synthetic import generate_process_quality
from leverscope.sources.tables import json_variant_rows, load_csv, load_json_table, read_csv_text, write_csv


def raises(code, call):
    with pytest.raises(AnalysisError) as caught:
        call()
    assert caught.value.code == code


def csv(tmp_path, text):
    path = tmp_path / "t.csv"
    path.write_text(text, encoding="utf-8")
    return str(path)


def test_a_written_folder_comes_back_typed_with_its_gaps(spark, tmp_path):
    path = str(tmp_path / "kiln")
    kiln = spark.range(137).select(
        F.when(F.col("id") % 10 > 0, F.col("id") * 1.5).alias("draft_pa"),
        F.concat(F.lit("shift "), (F.col("id") % 3).cast("string")).alias("crew"),
        F.when(F.col("id") % 50 > 0, F.col("id") % 2 == 0).alias("vented"),
        F.lit(None).cast("string").alias("never_filled"),
    )
    write_csv(kiln.repartition(4), path)
    df, columns = load_csv(spark, path)
    assert [(c.name, c.type, c.missing_count) for c in columns] == [("draft_pa", "numeric", 14), ("crew", "categorical", 0), ("vented", "numeric", 3), ("never_filled", "categorical", 137)]
    sums = df.agg(F.sum("draft_pa"), F.sum(F.col("vented").cast("double")), F.count("*")).first()
    assert tuple(sums) == (sum(1.5 * i for i in range(137) if i % 10), sum(i % 2 == 0 for i in range(137) if i % 50), 137)


ODD_CELLS = ["plain", "", 'say ""', '"', "a,b", "one\ntwo", "\n", "cr\r\nlf", '\n"\n', "C:\\dir\\", "x" * 700, "é\n日本", " lead", "NA"]


@pytest.mark.parametrize("ending", ["\n", "\r\n"])
@pytest.mark.parametrize("split_bytes", [600, None])
def test_split_files_give_what_one_task_reads(spark, tmp_path, ending, split_bytes):
    import csv as writer
    import random

    rng = random.Random(split_bytes or 1)
    for part in range(2):
        with open(tmp_path / f"p{part}.csv", "w", newline="", encoding="utf-8") as file:
            out = writer.writer(file, lineterminator=ending)
            # The one-task reader takes the first line break it sees for that of records.
            out.writerow(["number", 'a "wide"\nname' if ending == "\n" else 'a "wide", name', "note"])
            for i in range(90):
                out.writerow([i, rng.choice(ODD_CELLS), "".join(rng.choices(ODD_CELLS, k=rng.randint(0, 3)))])
                if i % 40 == 0:
                    file.write(ending)
    path = str(tmp_path)
    one = read_csv_text(spark, path)
    many = read_csv_text(spark, path, split=True, split_bytes=split_bytes)
    assert many.columns == one.columns
    rows = lambda df: sorted(map(tuple, df.collect()), key=str)
    assert rows(many) == rows(one) and len(rows(one)) == 180


def test_split_reading_refuses_quotes_that_do_not_pair(spark, tmp_path):
    path = csv(tmp_path, 'a,b\n1,5" pipe\n2,x\n')
    raises("invalidCsv", lambda: read_csv_text(spark, path, split=True))


def test_generated_rows_do_not_depend_on_partitions(spark):
    one = generate_process_quality(spark, 50, 3)
    from leverscope.sources.synthetic import process_quality

    other = process_quality(spark.range(50).toDF("row_key").repartition(7), "row_key", 3)
    assert one.exceptAll(other).isEmpty() and other.exceptAll(one).isEmpty()


def test_missing_words_booleans_and_numbers(spark, tmp_path):
    path = csv(tmp_path, 'a,b,c,d\n1,True,x,1d\nNA,False,"y, z",2f\n3.5,true,null,3d\n')
    df, columns = load_csv(spark, path)
    assert [(c.name, c.type, c.missing_count) for c in columns] == [
        ("a", "numeric", 1),
        ("b", "numeric", 0),
        ("c", "categorical", 1),
        ("d", "categorical", 0),  # Java number suffixes are text
    ]
    assert [tuple(r) for r in df.orderBy("d").collect()] == [
        (1.0, 1.0, "x", "1d"),
        (None, 0.0, "y, z", "2f"),
        (3.5, 1.0, None, "3d"),
    ]


def test_eighty_percent_rule(spark, tmp_path):
    path = csv(tmp_path, "a,b\n" + "1,1\n" * 4 + "x,x\n" + "2,y\n" * 0)
    _, columns = load_csv(spark, path)
    assert [c.type for c in columns] == ["numeric", "numeric"]  # exactly 4 of 5
    path = csv(tmp_path, "a\n" + "1\n" * 3 + "x\n")
    assert load_csv(spark, path)[1][0].type == "categorical"  # 3 of 4


def test_blank_headers(spark, tmp_path):
    _, columns = load_csv(spark, csv(tmp_path, "a,,c\n1,,2\n3,,4\n"))
    assert [c.name for c in columns] == ["a", "c"]
    _, columns = load_csv(spark, csv(tmp_path, "a,,c\n1,9,2\n3,,4\n"))
    assert [c.name for c in columns] == ["a", "Unnamed: 1", "c"]


def test_short_rows_are_padded_and_wide_rows_refused(spark, tmp_path):
    df, _ = load_csv(spark, csv(tmp_path, "a,b\n1,2\n3\n"))
    assert sorted(tuple(r) for r in df.fillna(-1.0).collect()) == [(1.0, 2.0), (3.0, -1.0)]
    raises("invalidCsv", lambda: load_csv(spark, csv(tmp_path, "a,b\n1,2\n1,2,3\n")))


def test_csv_errors(spark, tmp_path):
    raises("emptyDataset", lambda: load_csv(spark, csv(tmp_path, "")))
    raises("emptyDataset", lambda: load_csv(spark, csv(tmp_path, "a,b\n")))
    raises("sampleMissing", lambda: load_csv(spark, str(tmp_path / "nothing.csv")))
    raises("duplicateColumns", lambda: load_csv(spark, csv(tmp_path, "a, A\n1,2\n")))
    raises("invalidColumns", lambda: load_csv(spark, csv(tmp_path, 'a," "\n1,2\n')))


def test_json_rows_of_both_kinds(spark):
    df, columns = load_json_table(
        spark, ["Temperature", {"name": " Line "}], [{"Line": "L1", "Temperature": 1.5}, [2], [3, "L2", 9]]
    )
    assert [(c.name, c.type, c.missing_count) for c in columns] == [
        ("Temperature", "numeric", 0),
        ("Line", "categorical", 1),
    ]
    assert sorted(tuple(r) for r in df.fillna("-").collect()) == [(1.5, "L1"), (2.0, "-"), (3.0, "L2")]


def test_json_errors(spark):
    raises("invalidRows", lambda: load_json_table(spark, ["a"], ["text"]))
    raises("emptyDataset", lambda: load_json_table(spark, ["a"], []))
    raises("invalidColumns", lambda: load_json_table(spark, [], [[1]]))
    raises("invalidColumns", lambda: load_json_table(spark, ["a", ""], [[1]]))
    bad = spark.createDataFrame([("[1]",), ("5",)], "row string")
    raises("invalidRows", lambda: load_json_table(spark, ["a"], bad))


def test_unnamed_empty_columns_go_named_ones_stay(spark):
    df = spark.createDataFrame(
        [(None, 4.5, "u", None), (None, 6.5, "v", None)], "`Unnamed: 0` string, depth double, kind string, remark string"
    )
    out, columns = profile.load_table(df)
    assert out.columns == ["depth", "kind", "remark"]
    assert {c.name: c.type for c in columns}["remark"] == "categorical"


def test_nulls_and_nan_are_one_notion(spark):
    df = spark.createDataFrame([(float("nan"), None), (4.0, "p"), (None, "q"), (5.0, None)], "depth double, kind string")
    out, columns = profile.load_table(df)
    assert [c.missing_count for c in columns] == [2, 2]
    assert out.where("depth IS NULL AND kind IS NULL").count() == 1


def test_standard_csv(spark, tmp_path):
    path = csv(tmp_path, 'note,n\n"say ""hi"", ok",1\n"C:\\dir\\",2\n"two\nlines",3\nplain,4\n')
    df, _ = load_csv(spark, path)
    assert [tuple(r) for r in df.orderBy("n").collect()] == [('say "hi", ok', 1.0), ("C:\\dir\\", 2.0), ("two\nlines", 3.0), ("plain", 4.0)]


def test_written_csv_is_read_by_others(spark, tmp_path):
    import duckdb

    rows = [('a "b", c', 1.5), ("back\\slash", 2.5), ("line\nbreak", None), (None, 3.5), (",", 4.5)]
    write_csv(spark.createDataFrame(rows, "note string, n double").coalesce(1), str(tmp_path / "out"))
    found = duckdb.connect().execute(f"SELECT note, n FROM read_csv('{tmp_path}/out/*.csv', header = true, quote = '\"', escape = '\"')").fetchall()
    assert sorted(found, key=str) == sorted(rows, key=str)


@pytest.mark.parametrize("multi_line", [True, False])
def test_files_of_a_folder_may_begin_with_blank_lines(spark, tmp_path, multi_line):
    folder = tmp_path / "blank"
    folder.mkdir()
    (folder / "1.csv").write_text("a,b\n1,2\n")
    (folder / "2.csv").write_text("\n\na,b\n3,4\n5,6\n")
    (folder / "3.csv").write_text("\nb,a\n8,7\n")
    (folder / "4.csv").write_text("\n\n")
    df, _ = load_csv(spark, str(folder), multi_line)
    assert sorted(map(tuple, df.collect())) == [(1, 2), (3, 4), (5, 6), (7, 8)]
    (folder / "2.csv").write_text(" \t\na,b\n3,4\n5,6\n")  # other columns to the reader
    raises("invalidCsv", lambda: load_csv(spark, str(folder), multi_line))


def test_folders_are_read_by_column_name(spark, tmp_path):
    folder = tmp_path / "many"
    folder.mkdir()
    (folder / "1.csv").write_text("a,b\n1,2\n")
    (folder / "2.csv").write_text("b,a\n20,10\n")
    df, _ = load_csv(spark, str(folder))
    assert sorted(tuple(r) for r in df.select("a", "b").collect()) == [(1.0, 2.0), (10.0, 20.0)]
    (folder / "3.csv").write_text("a,c\n1,2\n")
    raises("invalidCsv", lambda: load_csv(spark, str(folder)))


def test_keys_keep_their_digits(spark, tmp_path):
    df, columns = load_csv(spark, csv(tmp_path, "k,v\n9007199254740992,1\n9007199254740993,2\n"), key="k")
    assert [r["k"] for r in df.orderBy("v").collect()] == ["9007199254740992", "9007199254740993"]
    assert [c.name for c in columns] == ["v"]
    raises("invalidColumns", lambda: profile.load_table(df, key="absent"))


def test_typed_columns(spark):
    df = spark.sql("SELECT true AS b, date'2024-01-01' AS d, 3 AS i, cast(2.5 AS decimal(5,2)) AS x")
    out, columns = profile.load_table(df)
    assert [c.type for c in columns] == ["numeric", "categorical", "numeric", "numeric"]
    assert tuple(out.first()) == (1.0, "2024-01-01", 3.0, 2.5)
    nested = spark.sql("SELECT array(1) AS a, 2 AS b")
    raises("invalidColumns", lambda: profile.load_table(nested))


def test_column_names_with_dots(spark):
    df = spark.createDataFrame([("1", 2.0)], ["a.b", "c`d"])
    out, _ = profile.load_table(df)
    assert out.columns == ["a.b", "c`d"] and tuple(out.first()) == (1.0, 2.0)


def test_target_checks(spark):
    df, _ = load_json_table(spark, ["depth", "out"], [[8, None], {"depth": 9}, []])
    raises("missingTarget", lambda: profile.validate_target(df, "absent"))
    raises("missingTarget", lambda: profile.validate_target(df, ""))
    raises("emptyTarget", lambda: profile.validate_target(df, "out"))


def test_overview_names_target_and_gaps(spark):
    df = generate_process_quality(spark, 40).drop("row_key")
    types = profile.infer_types(profile.column_counts(df))
    row = profile.dataset_overview(types, "TargetConductivity").first()
    assert (row["row_count"], row["column_count"], row["categorical_count"]) == (40, 9, 1)
    assert "TargetConductivity" in row["summary"] and row["code"] == "datasetOverviewWithTarget"
    assert row["missing_count"] == 4


@pytest.mark.parametrize(
    "names, expected",
    [
        (["a", "QualityResult", "TargetConductivity"], "QualityResult"),
        (["a", "TargetConductivity", "yield"], "TargetConductivity"),
        (["a", "良率", "b"], "良率"),
        (["a", "LPC count", "Quality"], "LPC count"),
        (["a", "b"], "b"),
    ],
)
def test_guess_target(spark, names, expected):
    df = spark.range(3).select(*[F.lit(1.0).alias(n) for n in names])
    types = profile.infer_types(profile.column_counts(df))
    assert profile.guess_target(types).first()["target"] == expected


def test_guess_target_without_numbers(spark):
    df = spark.createDataFrame([("x",)], "quality string")
    types = profile.infer_types(profile.column_counts(df))
    assert profile.guess_target(types).first()["target"] is None


def test_variant_rows_tell_nested_cells_from_texts(spark):
    bodies = ['{"a": {"x": 1}, "b?\'": "{}"}', '[12345678901234567890, [1]]', "[0.10]", '{"c": 1}', "[]"]
    rows = spark.createDataFrame([(i, b) for i, b in enumerate(bodies)], "id int, body string")
    names = ["a", "b?'"]
    found = json_variant_rows(rows, rows["body"], names, keep=("id",)).orderBy("id").collect()
    assert [tuple(r)[1:] for r in found] == [
        ('{"x":1}', "{}", ["a"]), ("12345678901234567890", "[1]", ["b?'"]), ("0.1", None, []), (None, None, []), (None, None, [])]
    for bad in ("7", '"text"', "{", None):
        broken = spark.createDataFrame([(bad,)], "body string")
        with pytest.raises(Exception, match="invalidRows"):
            json_variant_rows(broken, broken["body"], ["a"]).collect()
