import pytest

from canopyframe import schemas
from canopyframe.sources import adjacency, catalog, inventory, sinks


def test_code_lists():
    assert len(catalog.STATE_CODES) == len(set(catalog.STATE_CODES)) == 59
    assert len(catalog.TABLE_NAMES) == len(set(catalog.TABLE_NAMES)) == 89
    assert len(catalog.CONTIGUOUS_STATES) == 48


def test_state_rules():
    assert catalog.check_states(["ma", "ME", "MA"]) == ["MA", "ME"]
    with pytest.raises(ValueError, match="Alabama"):
        catalog.check_states(["Alabama"])
    for bundle in ("REF", "entire"):
        assert catalog.check_states([bundle]) == [bundle.upper()]
        with pytest.raises(ValueError):
            catalog.check_states([bundle, "MA"])


def test_table_rules_and_stems():
    assert catalog.check_tables(None) == ["COND", "PLOT", "TREE"]
    assert catalog.check_tables(["tree"]) == ["TREE"]
    with pytest.raises(ValueError, match="MA_TREE"):
        catalog.check_tables(["MA_TREE"])
    assert catalog.file_stems(["MA", "ME"], ["PLOT"]) == {"PLOT": ["MA_PLOT", "ME_PLOT"]}
    assert catalog.file_stems(["ENTIRE"], ["PLOT"]) == {"PLOT": ["PLOT"]}


@pytest.fixture()
def folder(tmp_path):
    (tmp_path / "MA_PLOT.csv").write_text(
        "CN,INVYR,STATECD,UNITCD,COUNTYCD,PLOT,KINDCD,DESIGNCD,LON,LAT,EXTRA\n"
        "90071992547409931,2005,25,1,3,7,1,1,-71.5,42.1,x\n"
        "90071992547409932,2006,25,1,3,8,NA,1,NaN,,y\n")
    # Other column order, and no KINDCD.
    (tmp_path / "ME_PLOT.csv").write_text(
        "INVYR,CN,PLOT,COUNTYCD,UNITCD,STATECD,DESIGNCD,LAT,LON\n2001,17,9,5,2,23,1,45.0,-69.0\n")
    (tmp_path / "CA_OZONE_PLOT.csv").write_text("INVYR,CN\n1999,666\n")
    (tmp_path / "NE_OZONE_PLOT.csv").write_text("INVYR,CN\n1999,667\n")
    (tmp_path / "AK_PLOT.csv").write_text("INVYR,CN\n1999,668\n")
    (tmp_path / "MA_SURVEY.csv").write_text("CN,NAME\n1,first\n")
    (tmp_path / "ME_SURVEY.csv").write_text("NAME,CN\nsecond,2\n")
    return tmp_path


def test_scan_matches_whole_names_and_columns_by_header(spark, folder):
    plots = inventory.scan_table(spark, str(folder), "PLOT")
    assert plots.schema == schemas.PLOT
    rows = {r.CN: r for r in plots.collect()}
    assert set(rows) == {"90071992547409931", "90071992547409932", "17"}
    assert rows["17"].STATECD == 23 and rows["17"].LAT == 45.0 and rows["17"].KINDCD is None
    second = rows["90071992547409932"]
    assert second.KINDCD is None and second.LON is None and second.LAT is None


def test_scan_without_filling_rejects_missing_columns(spark, folder):
    with pytest.raises(ValueError, match="KINDCD"):
        inventory.scan_table(spark, str(folder), "PLOT", fill_missing=False)


def test_load_inventory_stacks_states(spark, folder):
    loaded = inventory.load_inventory(spark, str(folder), ["ma", "me"], ["plot", "survey"])
    assert set(loaded) == {"PLOT", "SURVEY"}
    assert loaded["PLOT"].count() == 3
    assert {(r.CN, r.NAME) for r in loaded["SURVEY"].collect()} == {("1", "first"), ("2", "second")}
    inventory.register_views({"SURVEY": loaded["SURVEY"]})
    assert spark.sql("SELECT count(*) FROM SURVEY").first()[0] == 2
    with pytest.raises(FileNotFoundError, match="ME_TREE"):
        inventory.load_inventory(spark, str(folder), ["ME"], ["TREE"])


def test_read_folder_and_macro(spark, tmp_path):
    (tmp_path / "a.csv").write_text("CN,FULL_TREE_ID\n1,t1\n2,NA\n")
    (tmp_path / "b.csv").write_text("FULL_TREE_ID,CN\nt3,3\n")
    rows = inventory.read_folder(spark, str(tmp_path), schemas.TREE_IDENTITY).collect()
    assert {(r.CN, r.FULL_TREE_ID) for r in rows} == {("1", "t1"), ("2", None), ("3", "t3")}
    (tmp_path / "macro").mkdir()
    (tmp_path / "macro" / "m.csv").write_text("cn\n9007199254740993\n")
    macro = inventory.read_macroplot_list(spark, str(tmp_path / "macro" / "m.csv"))
    assert [r.cn for r in macro.collect()] == ["9007199254740993"]


def test_intermediate_from_csv_and_parquet(spark, tmp_path):
    (tmp_path / "s.csv").write_text("sd,PLT_CN,corrected_slope,se_mean,unused\n0.2,12,-1.5,NaN,9\n")
    row = inventory.read_intermediate(spark, str(tmp_path / "s.csv"), schemas.SLOPES).first()
    assert (row.PLT_CN, row.corrected_slope, row.se_mean, row.sd) == ("12", -1.5, None, 0.2)
    df = spark.createDataFrame([(12, -1.5, 0.1, 0.2)], "PLT_CN long, corrected_slope double, "
                               "se_mean double, sd double")
    sinks.write_parquet(df, str(tmp_path / "s.parquet"))
    back = inventory.read_intermediate(spark, str(tmp_path / "s.parquet"), schemas.SLOPES)
    assert back.schema == schemas.SLOPES and back.first().PLT_CN == "12"


def test_adjacency_matrix_keeps_coded_names(spark, tmp_path):
    (tmp_path / "adj.csv").write_text(
        '"","A01. Coast","A02. Hills / Lakes","B01. Coast"\n'
        '"A01. Coast",0,1,0\n"A02. Hills / Lakes",1,0,1\n"B01. Coast",0,1,0\n')
    edges = {(r.region_a, r.region_b)
             for r in adjacency.read_adjacency(spark, str(tmp_path / "adj.csv")).collect()}
    assert edges == {("A01. Coast", "A02. Hills / Lakes"), ("A02. Hills / Lakes", "A01. Coast"),
                     ("A02. Hills / Lakes", "B01. Coast"), ("B01. Coast", "A02. Hills / Lakes")}


def test_writers(spark, tmp_path):
    df = spark.createDataFrame([(1, "p1", 0.5), (2, "p2", 1.5), (1, "p3", 2.5)],
                               "STATECD int, PLT_CN string, v double")
    sinks.write_by_state(df, str(tmp_path / "states"))
    assert {p.name for p in (tmp_path / "states").iterdir() if p.is_dir()} == {
        "STATECD=1", "STATECD=2"}
    assert spark.read.parquet(str(tmp_path / "states")).count() == 3
    sinks.write_by_state(df, str(tmp_path / "states_csv"), fmt="csv")
    assert spark.read.option("header", True).csv(str(tmp_path / "states_csv")).count() == 3
    sinks.write_by_plot(df, str(tmp_path / "plots"))
    assert spark.read.parquet(str(tmp_path / "plots")).filter("PLT_CN = 'p2'").first().v == 1.5
    sinks.write_by_plot(df, str(tmp_path / "folders"), one_folder_per_plot=True)
    assert (tmp_path / "folders" / "PLT_CN=p1").is_dir()
    sinks.write_csv(df, str(tmp_path / "csv"), sort_by=["PLT_CN"])
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).columns == df.columns
    sinks.save_bucketed(df, "bucketed_slopes", 4)
    plan = spark.table("bucketed_slopes").groupBy("PLT_CN").count()
    assert "Exchange" not in plan._jdf.queryExecution().executedPlan().toString()
    spark.sql("DROP TABLE bucketed_slopes")


def test_bundle_of_all_states_and_bad_fields(spark, tmp_path):
    (tmp_path / "PLOT.csv").write_text("CN,INVYR\n1,2001\n2,2002\n")
    (tmp_path / "CA_PLOT.csv").write_text("CN,INVYR\n3,2003\n")
    got = inventory.scan_table(spark, str(tmp_path), "PLOT", ["ENTIRE"])
    assert sorted(r["CN"] for r in got.select("CN").collect()) == ["1", "2"]
    (tmp_path / "CA_PLOT.csv").write_text("CN,INVYR\n3,not a year\n")
    with pytest.raises(Exception, match="MALFORMED|Malformed"):
        inventory.scan_table(spark, str(tmp_path), "PLOT", ["CA"]).select("CN", "INVYR").collect()


def test_headers_of_many_files_take_one_job(spark, tmp_path):
    """200 files with three layouts; a value holds a comma, a name is quoted."""
    layouts = ['CN,INVYR,"PLOT"', "PLOT,CN,INVYR", "\nINVYR,CN"]
    for k in range(200):
        row = {"CN": f'"a,{k}"', "INVYR": "2005", "PLOT": str(k)}
        names = layouts[k % 3].strip().replace('"', "").split(",")
        (tmp_path / f"f{k:03d}.csv").write_text(
            layouts[k % 3] + "\n" + ",".join(row[n] for n in names) + "\n")
    paths = inventory.list_files(spark, str(tmp_path), r".*\.csv")
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("headers", "headers")
    try:
        df = inventory.read_csv_files(spark, paths)
        jobs = len(tracker.getJobIdsForGroup("headers"))
    finally:
        spark.sparkContext.setJobGroup("rest", "rest")
    # Two for the headers (a map side and a result), and Spark's listing of many paths for the
    # headers and once per layout.
    assert len(paths) == 200 and jobs <= 2 + 1 + 3
    rows = {r.CN: (r.INVYR, r.PLOT) for r in df.select("CN", "INVYR", "PLOT").collect()}
    assert rows == {f"a,{k}": ("2005", str(k) if k % 3 < 2 else None) for k in range(200)}
