import json

import pytest
from pyspark.errors import AnalysisException

from basketlore.plans import run_reports
from basketlore.plans.experiment import plain_experiment, quantity_experiment
from basketlore.sources.metrics import read_labeled_run_metrics, read_run_metrics
from basketlore.sources.retail import read_baskets, read_lines
from basketlore.sources.sinks import run_config, write_csv, write_document, write_json

CSV = '''InvoiceNo,StockCode,Description,Quantity,InvoiceDate,UnitPrice,CustomerID,Country
1,a,"apple, ""red""",2,2010-12-01,1.5,17850,UK
1,b,,3,2010-12-01,1.5,,UK
2,a,NA,x,2010-12-01,1.5,17850,UK
'''


def test_csv_columns_match_by_name_and_missing_marks_are_null(spark, tmp_path):
    path = tmp_path / "lines.csv"
    path.write_text(CSV)
    df = read_lines(spark, str(path))
    assert df.columns == ["InvoiceNo", "StockCode", "Description", "Quantity", "CustomerID"]
    assert sorted(map(tuple, df.collect())) == [
        ("1", "a", 'apple, "red"', 2.0, "17850"),
        ("1", "b", None, 3.0, None),
        ("2", "a", None, None, "17850"),
    ]


def test_csv_fields_with_line_breaks(spark, tmp_path):
    path = tmp_path / "lines.csv"
    path.write_text('InvoiceNo,StockCode,Description,Quantity\n1,a,"two\nlines, ""q""",3\n2,b,x,1\n')
    found = sorted(map(tuple, read_lines(spark, str(path), multi_line=True).collect()))
    assert found == [("1", "a", 'two\nlines, "q"', 3.0), ("2", "b", "x", 1.0)]


def test_line_breaks_in_quotes_are_an_error_unless_asked_for(spark, tmp_path):
    """In any column, the last one and one that is not returned among them; valid quotes are none."""
    header = "InvoiceNo,StockCode,Description,Quantity,Country\n"
    good = header + '1,a,"x, ""y""",3,UK\n2,b,5" nails,1,"U, K"\n3,c,"""q""",1,\n'
    path = tmp_path / "good.csv"
    path.write_text(good)
    assert [r["Description"] for r in read_lines(spark, str(path)).orderBy("InvoiceNo").collect()] == ['x, "y"', '5" nails', '"q"']
    for n, record in enumerate(('4,d,"two\nlines",1,UK', '4,d,x,1,"U\nK"', '"4\n",d,x,1,UK', "4,d,x", "4,d,x,1,UK,more")):
        path = tmp_path / f"bad{n}.csv"
        path.write_text(good + record + "\n5,e,y,1,UK\n")
        with pytest.raises(Exception, match="wrong number of fields"):
            read_lines(spark, str(path)).collect()
        with pytest.raises(Exception, match="wrong number of fields"):
            read_lines(spark, str(path)).select("InvoiceNo", "Quantity").collect()
        assert read_lines(spark, str(path), strict=False).where("InvoiceNo = '5'").count() == 1
        if record.count("\n"):
            found = {r["InvoiceNo"].strip(): r for r in read_lines(spark, str(path), multi_line=True).collect()}
            assert len(found) == 5 and found["4"]["Quantity"] == 1.0


def test_csv_sink_and_reader_round_trip(spark, tmp_path):
    rows = [("1", "a", 'quote " and "", comma', 2.0, "7"), ("2", "b,c", "two\nlines\r\nand ,\"", 1.0, None)]
    df = spark.createDataFrame(rows, "InvoiceNo string, StockCode string, Description string, Quantity double, CustomerID string")
    path = str(tmp_path / "lines.csv")
    assert write_csv(df, path)
    assert sorted(map(tuple, read_lines(spark, path, multi_line=True).collect())) == rows
    with pytest.raises(Exception, match="wrong number of fields"):
        read_lines(spark, path).collect()


def test_labels_follow_files_of_any_name(spark, tmp_path):
    """One scan for all folders; a folder of two labels counts for both."""
    put(tmp_path / "a b%20c", "x y.json", document(1))
    put(tmp_path / "a b%20c", "z.json", document(3))
    put(tmp_path / "ü+", "x.json", document(2))
    folders = {"20 Cores": str(tmp_path / "a b%20c"), "10 Cores": str(tmp_path / "ü+"), "4 Cores": str(tmp_path / "a b%20c")}
    labeled = read_labeled_run_metrics(spark, folders)
    times = labeled.selectExpr("Cores", "fpgrowth['0.1'].total_time AS t").collect()
    assert sorted(map(tuple, times)) == [("10 Cores", 4.0), ("20 Cores", 2.0), ("20 Cores", 6.0), ("4 Cores", 2.0), ("4 Cores", 6.0)]
    plan = labeled._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan json") == 1


def test_csv_files_with_other_headers_are_refused(spark, tmp_path):
    folder = tmp_path / "lines.csv"
    folder.mkdir()
    (folder / "1.csv").write_text("InvoiceNo,StockCode,Description,Quantity\n1,a,x,3\n")
    (folder / "2.csv").write_text("StockCode,InvoiceNo,Description,Quantity\nb,2,x,3\n")
    with pytest.raises(Exception, match="(?i)header"):
        read_lines(spark, str(folder)).collect()


def test_formats_agree(spark, tmp_path):
    path = tmp_path / "lines.csv"
    path.write_text(CSV)
    df = read_lines(spark, str(path))
    df.write.parquet(str(tmp_path / "lines.parquet"))
    write_json(df, str(tmp_path / "lines.json"))
    expected = sorted(map(str, df.collect()))
    for name in ("lines.parquet", "lines.json"):
        assert sorted(map(str, read_lines(spark, str(tmp_path / name)).select(df.columns).collect())) == expected


def test_reader_errors(spark, tmp_path):
    with pytest.raises(ValueError, match="Unsupported input format"):
        read_lines(spark, "lines.xlsx")
    with pytest.raises(AnalysisException, match="PATH_NOT_FOUND"):
        read_lines(spark, str(tmp_path / "none.csv"))
    (tmp_path / "short.csv").write_text("InvoiceNo,StockCode\n1,a\n")
    with pytest.raises(ValueError, match="Missing required columns"):
        read_lines(spark, str(tmp_path / "short.csv"))
    spark.range(1).write.parquet(str(tmp_path / "ids.parquet"))
    with pytest.raises(ValueError, match="items"):
        read_baskets(spark, str(tmp_path / "ids.parquet"))
    spark.sql("select 'a' as items").write.parquet(str(tmp_path / "text.parquet"))
    with pytest.raises(ValueError, match="array"):
        read_baskets(spark, str(tmp_path / "text.parquet"))


def test_csv_sink_skips_empty(spark, tmp_path):
    df = spark.range(3)
    assert not write_csv(df.where("id > 5"), str(tmp_path / "empty"))
    assert not (tmp_path / "empty").exists()
    assert write_csv(df, str(tmp_path / "full"))
    assert spark.read.option("header", True).csv(str(tmp_path / "full")).count() == 3


def document(factor, levels=("1", "2", "3"), son_total=True):
    run = {"phase1_time": 3.0 * factor, "phase2_time": 1.0, "candidates_generated": 9, "num_partitions": 4,
           "final_frequent_itemsets": 5, "total_time": 4.0 * factor}
    if not son_total:
        del run["total_time"]
    level = {k: {"candidates_count": 9, "frequent_count": 3, "execution_time": float(k) * factor} for k in levels}
    return {
        "apriori": {s: {"total_time": 6.0 * factor, "total_itemsets": 3, "levels": level} for s in ("0.02", "0.1")},
        "fpgrowth": {s: {"build_time": 0.5, "mine_time": 1.5, "total_time": 2.0 * factor, "count": 5, "max_length": 2}
                     for s in ("0.02", "0.1")},
        "son": {s: run for s in ("0.02", "0.1")},
        "metadata": {"total_baskets": 100, "thresholds": [0.1, 0.02], "num_partitions": 4},
    }


def put(folder, name, content):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text(json.dumps(content, indent=2))


def test_run_reports(spark, tmp_path):
    put(tmp_path / "run", "b.json", document(100))
    put(tmp_path / "run", "a.json", document(1, levels=("1", "2")))
    metrics = read_run_metrics(spark, str(tmp_path / "run"))
    assert [tuple(r) for r in run_reports.apriori_breakdown(metrics).collect()] == [
        ("0.1", 1.0, 2.0, 0.0),
        ("0.02", 1.0, 2.0, 0.0),
    ]
    assert [tuple(r) for r in run_reports.total_times(metrics).collect()] == [
        ("0.1", "Apriori", 6.0),
        ("0.02", "Apriori", 6.0),
        ("0.1", "FP-Growth", 2.0),
        ("0.02", "FP-Growth", 2.0),
        ("0.1", "SON", 4.0),
        ("0.02", "SON", 4.0),
    ]
    assert run_reports.fpgrowth_breakdown(metrics).columns == ["Support", "Build Time (s)", "Mine Time (s)"]
    assert tuple(run_reports.son_breakdown(metrics).first()) == ("0.1", 3.0, 1.0)


def test_scalability_over_folders(spark, tmp_path):
    put(tmp_path / "big", "x.json", document(1))
    put(tmp_path / "spare", "x.json", document(2, son_total=False))
    (tmp_path / "hollow").mkdir()
    folders = {
        "20 Cores": str(tmp_path / "big"),
        "10 Cores": [str(tmp_path / "gone"), str(tmp_path / "spare")],
        "4 Cores": str(tmp_path / "missing"),
        "1 Core": str(tmp_path / "hollow"),
    }
    with pytest.warns(UserWarning) as seen:
        labeled = read_labeled_run_metrics(spark, folders)
    assert len(seen) == 2
    summary = run_reports.scalability_summary(labeled)
    rows = [tuple(r) for r in summary.collect()]
    assert rows[0] == ("20 Cores", "Apriori", 0.1, 6.0)
    assert ("10 Cores", "SON", 0.02, 0.0) in rows and len(rows) == 12
    wide = {(r["Support"], r["Algorithm"]): r for r in run_reports.scalability_by_support(summary).collect()}
    assert wide[(0.1, "Apriori")]["10 Cores"] == 12.0 and wide[(0.1, "Apriori")]["4 Cores"] is None
    with pytest.raises(ValueError, match="No run metrics"), pytest.warns(UserWarning):
        read_labeled_run_metrics(spark, {"4 Cores": str(tmp_path / "missing")})
    with pytest.raises(FileNotFoundError):
        read_run_metrics(spark, str(tmp_path / "hollow"))


def items_of(spark, baskets):
    rows = [(b, i, 2.0) for b, items in enumerate(baskets) for i in items]
    return spark.createDataFrame(rows, "basket_id bigint, item string, qty double")


def test_run_config_round_trip(spark, tmp_path):
    items = items_of(spark, ["ab", "abc"])
    write_document(run_config(items, 4, 8, [0.5, 0.25]), str(tmp_path / "config"))
    row = spark.read.json(str(tmp_path / "config")).first()
    assert (row["cores"], row["partitions"], row["supports"], row["total_baskets"]) == (4, 8, [0.5, 0.25], 2)


def test_plain_experiment_document_feeds_the_reports(spark, tmp_path):
    items = items_of(spark, ["ab", "ab", "bc", "ac"])
    write_document(plain_experiment(items, (0.5,), 2), str(tmp_path / "run"))
    metrics = read_run_metrics(spark, str(tmp_path / "run"))
    row = metrics.select("apriori", "fpgrowth", "son", "metadata").first()
    assert row["apriori"]["0.5"]["total_itemsets"] == row["fpgrowth"]["0.5"]["count"] == 4
    assert row["son"]["0.5"]["final_frequent_itemsets"] == 4
    assert row["apriori"]["0.5"]["levels"]["2"]["frequent_count"] == 1
    assert row["metadata"]["total_baskets"] == 4
    assert run_reports.total_times(metrics).count() == 3


def test_quantity_experiment_writes_its_tables(spark, tmp_path):
    items = items_of(spark, ["ab", "ab", "bc", "ac"])
    names = spark.createDataFrame([("a", "apple"), ("b", "bread")], "item string, description string")
    quantity_experiment(items, names, str(tmp_path), (0.5,), 2)

    def read(name):
        return spark.read.option("header", True).csv(str(tmp_path / name)).collect()

    assert [r["total_itemsets"] for r in read("apriori_summary")] == ["4"]
    assert [(r["level"], r["candidates"], r["frequent"]) for r in read("apriori_levels")] == [
        ("1", "3", "3"),
        ("2", "3", "1"),
    ]
    assert read("son_summary")[0]["total_itemsets"] == "4"
    top = read("apriori_top_itemsets")[0]
    assert (top["Itemset"], top["Support"], top["Max_Qty"]) == ("apple + bread", "2", "2.0")
    assert read("son_top_itemsets")[0]["Itemset"] == "apple + bread"
