import pytest

from flowlens.sources import raw as R
from flowlens.sources import store

ROWS = [
    "2022/09/01 00:20,010,8000EBD30,010,8000EBD30,3697.34,US Dollar,3697.34,US Dollar,Reinvestment,0",
    "2022/09/01 00:05,001,A1,010,B2,100.00,US Dollar,100.00,US Dollar,Cheque,0",
    "2022/09/01 00:05,01,A1,010,B2,50.00,US Dollar,50.00,US Dollar,Cheque,0",
    "2022/09/01 01:00,020,C3,030,D4,80.00,Euro,100.00,US Dollar,ACH,0",
    "2022/09/01 02:00,030,D4,020,C3,125.00,US Dollar,100.00,Euro,ACH,0",
    "2022/09/01 03:00,040,012345678,050,E5,20.00,US Dollar,20.00,US Dollar,Wire,0",
    "2022/09/02 10:00,020,C3,050,E5,1000.00,Euro,1000.00,Euro,ACH,1",
    "2022/09/03 10:00,020,C3,050,E5,10.00,US Dollar,100.00,Euro,ACH,0",
    "2022/09/03 10:00,020,C3,050,E5,10.00,US Dollar,100.00,Euro,ACH,0",
    "2022/09/10 23:59,050,E5,001,A1,500.00,US Dollar,500.00,US Dollar,ACH,1",
    "2022/09/11 00:00,050,E5,001,A1,400.00,US Dollar,400.00,US Dollar,ACH,1",
    "2022/09/12 08:00,001,A1,050,E5,300.00,US Dollar,300.00,US Dollar,ACH,1",
]
PATTERNS = """BEGIN LAUNDERING ATTEMPT - FAN-OUT:  Max 1-degree Fan-Out
{6}
END LAUNDERING ATTEMPT - FAN-OUT

BEGIN LAUNDERING ATTEMPT - CYCLE:  Max 2 hops
{9}
{11}
END LAUNDERING ATTEMPT - CYCLE

BEGIN LAUNDERING ATTEMPT - BIPARTITE
{10}
END LAUNDERING ATTEMPT - BIPARTITE
"""
CUT = "2022-09-11"


@pytest.fixture
def raw(spark, tmp_path):
    path = tmp_path / "raw.csv"
    path.write_text(R.HEADER + "\n" + "\n".join(ROWS) + "\n")
    return R.read_raw(spark, str(path))


def standard(raw):
    return R.to_standard(raw, "HI", CUT, "2022-09-02")


def test_file_order_ids_and_leading_zeros(raw):
    rows = standard(raw).collect()
    assert [r["tx_id"] for r in rows[:3]] == ["HI:0000001", "HI:0000002", "HI:0000000"]
    assert {r["src"] for r in rows[:2]} == {"001_A1", "01_A1"}
    assert any(r["src"] == "040_012345678" for r in rows)


def test_rates_use_early_rows_only_and_report(raw):
    df = standard(raw)
    assert [r["amount"] for r in df.where("tx_id = 'HI:0000006'").collect()] == [pytest.approx(1250.0)]
    report = R.load_report(raw, df).first().asDict()
    assert (report["n_raw"], report["n_dropped_tail"], report["pos_dropped_tail"], report["n_rows"], report["n_pos"], report["n_duplicates"]) == (12, 2, 2, 10, 2, 1)
    assert R.problems(df, CUT) == []


def test_header_is_checked(spark, tmp_path):
    (tmp_path / "bad.csv").write_text("a,b\n1,2\n")
    with pytest.raises(R.DataValidationError):
        R.read_raw(spark, str(tmp_path / "bad.csv"))


def test_patterns_match(spark, raw, tmp_path):
    (tmp_path / "p.txt").write_text(PATTERNS.format(*ROWS))
    patterns = R.read_patterns(spark, str(tmp_path / "p.txt"))
    rows = sorted((r["pattern_id"], r["typology"]) for r in patterns.collect())
    assert rows == [(0, "FAN-OUT"), (1, "CYCLE"), (1, "CYCLE"), (2, "BIPARTITE")]
    matched = R.match_patterns(standard(raw), patterns, CUT)
    assert sorted(r["tx_id"] or "" for r in matched.collect()) == ["", "", "HI:0000006", "HI:0000009"]
    assert tuple(R.pattern_report(matched).first()) == (3, 1, 1)


@pytest.mark.parametrize("text", ["BEGIN LAUNDERING ATTEMPT - CYCLE\n{6}\n", "{6}\n", "BEGIN LAUNDERING ATTEMPT - CYCLE\na,b\nEND\n", "END\n"])
def test_malformed_patterns(spark, tmp_path, text):
    (tmp_path / "p.txt").write_text(text.format(*ROWS))
    with pytest.raises(R.DataValidationError):
        R.read_patterns(spark, str(tmp_path / "p.txt"))


def test_unmatched_and_negative_patterns_are_refused(spark, raw, tmp_path):
    for bad in (ROWS[1].replace(",0", ",1") if False else ROWS[1], ROWS[6].replace("1000.00,Euro,ACH", "999.00,Euro,ACH")):
        (tmp_path / "p.txt").write_text(f"BEGIN LAUNDERING ATTEMPT - CYCLE\n{bad}\nEND LAUNDERING ATTEMPT - CYCLE\n")
        with pytest.raises(R.DataValidationError):
            R.match_patterns(standard(raw), R.read_patterns(spark, str(tmp_path / "p.txt")), CUT)


def test_store_notices_changes(spark, raw, tmp_path):
    path = str(tmp_path / "t")
    store.save(standard(raw), path, variant="HI")
    assert store.load(spark, path).count() == 10 and store.manifest(spark, path)["variant"] == "HI"
    standard(raw).limit(9).write.mode("overwrite").parquet(path + "/data")
    with pytest.raises(ValueError):
        store.load(spark, path)


def test_step_dataset(spark):
    features = spark.createDataFrame([(1, 1, 0.5), (2, 1, 0.1), (3, 2, 0.2)], "txId long, `Time step` int, local double")
    classes = spark.createDataFrame([(1, "1"), (2, "unknown"), (3, "2")], "txId long, class string")
    edges = spark.createDataFrame([(1, 2)], "txId1 long, txId2 long")
    nodes, _ = R.load_steps(features, classes, edges)
    assert {r["tx_id"]: r["y"] for r in nodes.collect()} == {1: 1.0, 2: None, 3: 0.0}
    with pytest.raises(R.DataValidationError):
        R.load_steps(features, classes, edges.union(spark.createDataFrame([(1, 3)], edges.schema)))


def test_tabular(raw):
    f = {r["tx_id"]: r for r in R.tabular_features(standard(raw)).collect()}
    assert f["HI:0000001"]["is_round_amount"] == 1 and f["HI:0000000"]["is_round_amount"] == 0
    assert f["HI:0000006"]["hour"] == 10 and f["HI:0000003"]["is_cross_currency"] == 1
