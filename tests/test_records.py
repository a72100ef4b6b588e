"""Header matching, normalisation, time and labels."""

import datetime as dt
import hashlib

import pytest
from pyspark.sql import functions as F

from stagewise.functions import scalar, timecols
from stagewise.operators import labels
from stagewise.settings import Settings
from stagewise.sources import normalize as normalize_module
from stagewise.sources import paths, readers, sinks
from stagewise.sources.label_maps import FLOW_MAP, LABEL_MAPS, PACKET_MAP, LabelMap
from stagewise.sources.normalize import SchemaError, match_column, matched_columns, normalize, quality
from stagewise.sources.specs import FLOW, PACKET, SourceSpec


def flow_rows(spark, rows, columns="ts string, src_ip string, dst_ip string, label string, type string"):
    return spark.createDataFrame(rows, columns)


def test_bucket_ids_and_half_open_border(spark):
    seconds = ["0", "59", "60", "119", "120", "59.999", "60.0", "60.001", "-1.5"]
    df = spark.createDataFrame([(i, s) for i, s in enumerate(seconds)], "i int, s string")
    out = df.select("i", timecols.window_id(timecols.from_epoch_text(F.col("s")), 60).alias("w")).orderBy("i")
    assert [r.w for r in out.collect()] == [0, 0, 1, 1, 2, 0, 1, 1, -1]
    assert dict(out.dtypes)["w"] == "bigint"


def test_buckets_do_not_depend_on_the_session_zone(spark):
    df = spark.createDataFrame([("1554198358",)], "s string")
    def both():
        return df.select(timecols.window_id(timecols.from_epoch_text(F.col("s")), 60).alias("w"),
                         timecols.from_free_text(F.lit("Mar 14, 2021 02:30:00.5")).alias("t")).first()
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/New_York")
        row = both()
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert row == both()
    assert row.t == dt.datetime(2021, 3, 14, 2, 30, 0, 500000)


def test_fractional_width_and_wide_range(spark):
    df = spark.range(1000).select(timecols.from_epoch_text((F.lit(1554198358) + F.col("id") * 7.2).cast("string")).alias("t"))
    assert df.select(timecols.window_id(F.col("t"), 60)).distinct().count() >= 100
    assert df.select(timecols.window_id(F.col("t"), 0.5)).distinct().count() == 1000


@pytest.mark.parametrize("text, expected", [
    ("Apr 26, 2021 11:16:12.123456000", dt.datetime(2021, 4, 26, 11, 16, 12, 123456)),
    (" 2021 22:14:30.939803000", dt.datetime(2021, 1, 1, 22, 14, 30, 939803)),
    ("0.0", None), ("6.0", None), ("not a timestamp", None),
])
def test_free_text_times(spark, text, expected):
    row = spark.createDataFrame([(text,)], "s string").select(
        timecols.from_free_text(F.col("s")).alias("t"), timecols.has_calendar_date(F.col("s")).alias("d")).first()
    assert row.t == expected
    assert row.d == text.startswith("Apr")


def test_header_matching():
    assert match_column(["ip.src_host", "x"], ["ip_src_host"]) == "ip.src_host"
    assert match_column(["A b", "a.b"], ["ab"]) == "a.b"  # last equal header key wins
    assert match_column(["b", "a"], ["a", "b"]) == "a"  # first candidate wins
    assert match_column(["c"], ["a"]) is None


def test_normalized_flow_row(spark):
    raw = flow_rows(spark, [("1700000000", "10.0.0.1", "10.0.0.2", "0", " normal "), ("bad", "10.0.0.1", "x", "1", "ddos"),
                            ("1700000000", "None", "x", "1", "ddos"), ("1700000001", "a", None, None, None)])
    n = normalize(raw, FLOW)
    rows = {r.asset_id: r for r in n.records.collect()}
    assert set(rows) == {"10.0.0.1", "a"}
    assert rows["10.0.0.1"].raw_attack_type == "normal" and rows["10.0.0.1"].timestamp == dt.datetime(2023, 11, 14, 22, 13, 20)
    assert (rows["a"].peer_id, rows["a"].raw_attack_type, rows["a"].binary_label) == ("nan", "nan", 0)
    assert "duration" in n.missing and any("not in the header" in w for w in n.warnings)
    assert {r.role: r.column for r in matched_columns(n).collect()}["asset"] == "src_ip"
    q = quality(n).first()
    assert (q.n_rows_raw, q.n_rows_kept, q.n_distinct_assets) == (4, 2, 2) and not q.impact_forecasting_valid


def test_missing_requirements_are_errors(spark):
    with pytest.raises(SchemaError, match="timestamp"):
        normalize(spark.createDataFrame([("a", "b")], "src_ip string, type string"), FLOW)
    with pytest.raises(SchemaError, match="asset"):
        normalize(spark.createDataFrame([("1", "b")], "ts string, type string"), FLOW)
    with pytest.raises(SchemaError, match="label"):
        normalize(spark.createDataFrame([("1", "b")], "ts string, src_ip string"), FLOW)


def test_packet_rows_with_dotted_names_and_gate(spark):
    raw = spark.createDataFrame(
        [(" 2021 22:14:30.939803000", "h1", "h2", "DDoS_UDP", "1", "3.5"), ("0.0", "h1", "h2", "MITM", "1", "x"),
         ("Apr 26, 2021 11:16:12.1", "h2", "h1", "Normal", "0", "1")],
        "`frame.time` string, `ip.src_host` string, `ip.dst_host` string, Attack_type string, Attack_label string, `tcp.len` string")
    n = normalize(raw, PACKET)
    assert n.records.count() == 2 and n.numeric == ["tcp.len"]
    assert normalize(raw, PACKET, drop_bad_timestamps=False).records.count() == 3
    q = quality(n).first()
    assert not q.timestamp_reliable_for_windowing
    assert q.impact_forecasting_invalid_reasons == ["too few distinct assets: 2", "too few rows with a genuine calendar date"]


def test_extension_points(spark):
    spec = SourceSpec(name="toniot", timestamp=("t",), asset=("a",), attack_type=("k",),
                      parse_timestamp=lambda c: timecols.from_micros(c.cast("bigint")),
                      quality_checks={"many_rows": lambda n: F.col("n_rows_raw") > 1})
    n = normalize(spark.createDataFrame([("1000000", "x", "dos")], "t string, a string, k string"), spec)
    assert n.records.first().timestamp == dt.datetime(1970, 1, 1, 0, 0, 1)
    assert quality(n).first().many_rows is False


def test_label_mapping(spark):
    raw = flow_rows(spark, [("1", t, "x", "1", t) for t in ("DDoS_UDP", "ddos udp", "DDOS-UDP", "foo", "normal!")])
    records = normalize(raw, FLOW).records
    got = {r.asset_id: (r.stage_label, r.severity) for r in labels.map_labels(records, PACKET_MAP).collect()}
    assert [got[t] for t in ("DDoS_UDP", "ddos udp", "DDOS-UDP")] == [("IMP", 3)] * 3
    assert got["foo"] == ("IAD", 1) and got["normal!"] == ("Benign", 0)
    assert [r.raw_attack_type for r in labels.unmapped_labels(records, PACKET_MAP).collect()] == ["foo"]
    both = labels.map_labels_variants(records, LABEL_MAPS["edgeiiotset"])
    assert {r.variant: r.stage_label for r in both.filter("asset_id = 'ddos udp'").collect()} == {
        "primary": "IMP", "conservative": "LMEP", "expanded": "IMP"}


def test_mapping_tables_are_valid(spark):
    assert all(r.problems == [] for r in labels.mapping_problems(spark).collect())
    bad = {"x": {"primary": LabelMap(("n",), {"a": "WRONG"}, "IAD"), "other": LabelMap(("n",), {}, "NOPE")}}
    got = {r.variant: r.problems for r in labels.mapping_problems(spark, bad).collect()}
    assert got == {"primary": ["unknown stage"], "other": ["empty mapping", "unknown default"]}
    with pytest.raises(KeyError):
        FLOW_MAP.moved(nothing="IAD")


def test_files_shards_and_marker(spark, tmp_path):
    (tmp_path / "b.csv").write_text("ts,src_ip,type\n1,a,normal\n")
    (tmp_path / "a.csv").write_text(" type ,ts, src_ip,dst_ip\ndos,2,b,a\n")
    files = paths.resolve_files(spark, str(tmp_path), "absent.csv", "*.csv")
    assert [f.rsplit("/", 1)[1] for f in files] == ["a.csv", "b.csv"]
    assert paths.resolve_files(spark, str(tmp_path), "b.csv", "*.csv") == [f"{tmp_path}/b.csv"]
    with pytest.raises(FileNotFoundError):
        paths.resolve_files(spark, str(tmp_path), None, "*.orc")
    got = {r.src_ip: (r.ts, r.type, r.dst_ip) for r in readers.read_folder(spark, str(tmp_path)).collect()}
    assert got == {"a": ("1", "normal", None), "b": ("2", "dos", "a")}
    paths.require_real(spark, str(tmp_path))
    (tmp_path / paths.SYNTHETIC_MARKER).write_text("")
    with pytest.raises(paths.SyntheticDataError):
        paths.require_real(spark, str(tmp_path))
    paths.require_real(spark, str(tmp_path), allow_synthetic=True)


def test_provenance_and_sinks(spark, tmp_path):
    hashes = spark.range(1).select(*[sinks.settings_hash(c).alias(n) for n, c in (("x", {"a": 1, "b": 2}), ("y", {"b": 2, "a": 1}), ("z", {"a": 1}))]).first()
    assert hashes.x == hashes.y != hashes.z and hashes.z == hashlib.sha256(b'{"a": 1}').hexdigest()[:12]
    meta = sinks.stamps("toniot", Settings(), split="test")
    df = spark.createDataFrame([("train", 1)], "split string, n int")
    assert sinks.stamped(df, meta).first().split == "train" and sinks.stamped(df.drop("split"), meta).first().split == "test"
    assert '"_run_metadata":{"dataset":"toniot"' in sinks.json_lines(df, meta).first().value
    assert len(sinks.stamped(df, meta).first().timestamp_utc) == len("2024-01-01T00:00:00Z")
    for fmt, write in (("csv", sinks.write_csv), ("json", sinks.write_json), ("parquet", sinks.write_parquet)):
        write(sinks.stamped(df, meta), f"{tmp_path}/{fmt}")
        again = sinks.read_results(spark, f"{tmp_path}/{fmt}", fmt)
        assert set(sinks.REQUIRED_STAMPS) <= set(again.columns) and again.count() == 1
    skip = sinks.skip_report(spark, "d", "e", ["why"]).first()
    assert (skip.run, skip.reasons) == (False, ["why"])


def test_settings_guard():
    with pytest.raises(ValueError):
        Settings(train_frac=0.9)


def test_csv_quotes_line_breaks_and_missing_tokens(spark, tmp_path):
    (tmp_path / "a.csv").write_text('src,kind,label\nh1,"two\nlines, ""quoted""",1\nNA,x,3000000000\n"n/a",y,\nh2,NULL,0\n')
    rows = [tuple(r) for r in readers.read_csv_shards(spark, [str(tmp_path / "a.csv")]).collect()]
    assert rows == [("h1", 'two\nlines, "quoted"', "1"), (None, "x", "3000000000"), (None, "y", None), ("h2", None, "0")]


def test_numbers_that_java_reads_but_a_table_does_not_hold(spark):
    texts = ["1d", "12f", "0x1p3", "1e3", " -2.5 ", ".5", "7.", "NaN", "inf", "-Infinity", "1_000", ""]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r[0] for r in df.select(scalar.lenient_double(F.col("t"))).collect()]
    assert got == [None, None, None, 1000.0, -2.5, 0.5, 7.0, None, float("inf"), float("-inf"), None, None]


def test_labels_beyond_the_integers_count_as_attacks(spark):
    raw = spark.createDataFrame([("2021-01-01 00:00:00", "h1", "3000000000", "3000000000000000000000")], "timestamp string, asset_id string, label string, event_id string")
    binary, _ = normalize_module._labels({"binary_label": "label", "attack_type": None})
    assert raw.select(binary.alias("b")).first().b == 2**31 - 1
