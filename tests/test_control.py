import datetime
import os
import random

import pytest
from pyspark.sql import functions as F

import netlog as nl
from netlog.functions import (
    cidr_net, cidr_plen, ip_text, ip_value, le_words, monotonic_to_timestamp, split_pid_tid, u_be, u_le,
)
from netlog.schemas import TUNING
from netlog.sources import (
    accepted_loads, append_interest, decode_tuning, effective_interest, latest_tuning, normalize_interest,
    read_interest, tuning_record,
)
from netlog.sources.interest import file_entries

YAML = """# ports to watch
intercept:
  - port: 443
    protocol: tcp
  - port: 8080
    protocol: TCP   # upper case is the same
  - protocol: "udp"
    port: 53
  - port: 9
    protocol: sctp
"""


def entries(df):
    return sorted((r.port, r.proto) for r in df.collect())


def test_read_yaml_and_json(spark, tmp_path):
    (tmp_path / "a.yaml").write_text(YAML)
    loads = normalize_interest(read_interest(spark, str(tmp_path / "a.yaml")))
    assert sorted((r.port, r.protocol, r.reject_reason) for r in loads.collect()) == [
        (9, "sctp", "unsupported_protocol"), (53, "udp", None), (443, "tcp", None), (8080, "TCP", None)
    ]
    assert entries(effective_interest(accepted_loads(loads))) == [(53, 17), (443, 6), (8080, 6)]
    (tmp_path / "b.yaml").write_text('{"intercept": [{"port": 514, "protocol": "Udp"}]}')
    assert entries(normalize_interest(read_interest(spark, str(tmp_path / "b.yaml")))) == [(514, 17)]
    (tmp_path / "c.yaml").write_text("intercept:\n  - {port: 22, protocol: tcp}\n")
    assert entries(normalize_interest(read_interest(spark, str(tmp_path / "c.yaml")))) == [(22, 6)]


@pytest.mark.parametrize("text,reason", [
    ("intercept:\n  - port: 443\n", "bad_file"), ("ports: []\n", "bad_file"), ("intercept:\n  - port: x\n    protocol: tcp\n", "bad_file"),
    ("intercept: 2001-13-45\n", "bad_file"), ("intercept: " + "[" * 5_000, "bad_file"), ("intercept: !!timestamp '1'\n", "bad_file"),
    ("intercept: !!int ''\n", "bad_file"), ("seen: 2001-13-45\nintercept:\n  - port: 443\n    protocol: tcp\n", "bad_file"),
    ("intercept:\n  - port: 65536\n    protocol: tcp\n", "bad_port"), ("intercept:\n  - port: -1\n    protocol: tcp\n", "bad_port"),
])
def test_bad_files(spark, tmp_path, text, reason):
    (tmp_path / "a.yaml").write_text(text)
    loads = normalize_interest(read_interest(spark, str(tmp_path / "a.yaml")))
    assert [r.reject_reason for r in loads.collect()] == [reason]
    assert accepted_loads(loads).count() == 0


def test_reload_only_adds(spark, tmp_path):
    config, table = tmp_path / "intercept.yaml", str(tmp_path / "loads")

    def load(text, at):
        config.write_text(text)
        os.utime(config, (at, at))
        return entries(append_interest(spark, str(config), table))

    with pytest.raises(ValueError):
        load("nonsense", 1_000)
    assert load("intercept:\n  - port: 443\n    protocol: tcp\n  - port: 8080\n    protocol: tcp\n", 2_000) == [(443, 6), (8080, 6)]
    assert load("intercept:\n  - port: 443\n    protocol: tcp\n", 3_000) == [(443, 6), (8080, 6)]
    assert load("intercept:\n  - port: 70000\n    protocol: tcp\n  - port: 53\n    protocol: udp\n", 4_000) == [(443, 6), (8080, 6)]
    assert load("nonsense", 5_000) == [(443, 6), (8080, 6)]
    assert load("intercept:\n  - port: 53\n    protocol: udp\n", 6_000) == [(53, 17), (443, 6), (8080, 6)]
    before = spark.read.parquet(table).count()
    append_interest(spark, str(config), table)
    assert spark.read.parquet(table).count() == before


def test_tuning_in_force(spark):
    records = [(100, 2, 50, 1, 2), (100, 3, 60, 1, 3), (250, 4, 70, 2, 5)]
    df = spark.createDataFrame([(t,) for t in (-5, 0, 99, 100, 249, 250, 10**9)], "ts_ns BIGINT")
    want = {-5: 1000, 0: 1000, 99: 1000, 100: 60, 249: 60, 250: 70, 10**9: 70}
    for bucket_ns in (1, 7, 100, 10**15):
        for max_broadcast in (1_000_000, 0):
            tuned = nl.tuning_in_force(
                df, spark.createDataFrame(records, TUNING), bucket_ns=bucket_ns, max_broadcast=max_broadcast,
                max_records=0 if bucket_ns == 7 else 10, chunk_rows=2,
            )
            assert {r.ts_ns: r.max_rate_pps for r in tuned.collect()} == want
            plan = tuned._jdf.queryExecution().executedPlan().toString()
            assert "NestedLoop" not in plan and "Cartesian" not in plan
    empty = nl.tuning_in_force(df, spark.createDataFrame([], TUNING)).collect()
    assert {(r.version, r.max_rate_pps, r.sampling_num, r.sampling_den) for r in empty} == {(1, 1000, 1, 1)}


def test_sample(spark):
    df = spark.range(100).withColumnRenamed("id", "seq")
    assert nl.sample(df, num=1, den=4).count() == 25
    assert nl.sample(df, num=3, den=4).count() == 75
    assert nl.sample(df, num=1, den=1).count() == 100
    assert nl.sample(df, num=1, den=0).count() == 0


@pytest.mark.parametrize("seed, chunk_rows", [(1, 10_000), (2, 7), (3, 40), (4, 1)])
def test_as_of_matches_the_loop(spark, seed, chunk_rows):
    rng = random.Random(seed)
    # bursts of both, ties of both, rows before all records, and rows and records without a time
    rows = [(i, None if i % 50 == 0 else rng.choice([rng.randint(-5, 900), rng.randint(400, 420), 10**12])) for i in range(400)]
    records = [(None if i == 3 else rng.choice([rng.randint(0, 800), rng.randint(405, 410)]), i, f"r{i}") for i in range(120)]
    df = spark.createDataFrame(rows, "_row BIGINT, ts BIGINT").repartition(3)
    log = spark.createDataFrame(records, "at BIGINT, n BIGINT, text STRING").repartition(2)
    got = {r["_row"]: r.record and r.record.text for r in nl.as_of(df, log, "ts", "at", order=["n"], chunk_rows=chunk_rows).collect()}
    known = [r for r in records if r[0] is not None]
    want = {i: max((r for r in known if t is not None and r[0] <= t), default=(None,) * 3)[2] for i, t in rows}
    assert got == want
    assert {r.record for r in nl.as_of(df, log.limit(0), "ts", "at", order=["n"]).collect()} == {None}
    assert nl.as_of(df.limit(0), log, "ts", "at").count() == 0


def test_as_of_has_no_window_over_all_rows(spark):
    df, log = spark.range(10).withColumn("ts", F.col("id")), spark.range(5).withColumn("at", F.col("id"))
    plan = nl.as_of(df, log, "ts", "at")._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan


def test_tuning_sources(spark):
    raw = spark.createDataFrame(
        [(1, 1, bytearray.fromhex("02000000F401000000000000010000000A000000")), (2, 2, bytearray(b"short")),
         (1, 3, bytearray.fromhex("03000000FFFFFFFF00000000020000000B000000"))],
        "effective_ns BIGINT, seq BIGINT, record BINARY",
    )
    last = latest_tuning(decode_tuning(raw)).first()
    assert (last.version, last.max_rate_pps, last.sampling_num, last.sampling_den) == (3, 2**32 - 1, 2, 11)
    none = latest_tuning(decode_tuning(raw.limit(0))).first()
    assert (none.version, none.max_rate_pps, none.sampling_num, none.sampling_den) == (1, 1000, 1, 1)
    assert tuple(tuning_record(spark, 5, rate_limit=7).first()) == (5, 1, 7, 1, 1)


def test_integer_reads(spark):
    df = spark.createDataFrame([(bytearray(range(240, 256)),), (bytearray(b"\x01"),)], "b BINARY")
    rows = df.select(u_be("b", 0, 2), u_be("b", 1, 4), u_le("b", 0, 4), u_le("b", 8, 8), u_be("b", 2, 1)).collect()
    assert tuple(rows[0]) == (0xF0F1, 0xF1F2F3F4, 0xF3F2F1F0, None, 0xF2)
    assert rows[1][1] is None and rows[1][4] is None
    words = le_words(df, "b", {"w": 0}).first().w
    assert words.to_bytes(8, "little", signed=True) == bytes(range(240, 248))


def test_scalar_functions(spark):
    df = spark.createDataFrame([("10.0.0.1/8",), ("192.168.1.77/26",), ("1.2.3.4",), ("256.0.0.1/8",), ("1.2.3.4/33",), ("0.0.0.0/0",)], "c STRING")
    got = [tuple(r) for r in df.select(cidr_plen(F.col("c")), cidr_net(F.col("c"))).collect()]
    assert got == [(8, 0x0A000000), (26, 0xC0A80140), (32, 0x01020304), (8, None), (None, None), (0, 0)]
    one = spark.range(1).select(
        ip_text(F.lit(0xFFFFFF01)), ip_value(F.lit("255.255.255.1")), *split_pid_tid(F.lit((7 << 32) | 0xFFFFFFFF)),
        monotonic_to_timestamp(F.lit(1_500), 1_704_067_200_123_456_789),
    ).first()
    assert tuple(one)[:4] == ("255.255.255.1", 0xFFFFFF01, 7, 0xFFFFFFFF)
    assert one[4].replace(tzinfo=datetime.timezone.utc).microsecond == 123_458 or one[4].microsecond == 123_458


def test_interest_files_that_are_valid_yaml():
    assert file_entries("version: 1\nintercept:\n  - {port: 0x1BB, protocol: my proto, name: web}\n") == [(443, "my proto")]
    assert file_entries("intercept: [{port: 443, protocol: tcp}]") == [(443, "tcp")]
    assert file_entries("intercept: []") == []
    for text in ("", "[]", "intercept: 5", "intercept:\n  - port: tcp\n    protocol: 1", "a: [", "intercept: {port: 1}"):
        assert file_entries(text) == [(None, None)]


def test_a_short_tuning_record_changes_nothing(spark):
    raw = spark.createDataFrame(
        [(100, bytearray.fromhex("0200000005000000000000000100000001000000")), (200, bytearray(b"short"))],
        "effective_ns BIGINT, record BINARY")
    df = spark.createDataFrame([(50,), (150,), (250,)], "ts_ns BIGINT")
    got = nl.tuning_in_force(df, decode_tuning(raw)).orderBy("ts_ns").collect()
    assert [(r.version, r.max_rate_pps) for r in got] == [(1, 1000), (2, 5), (2, 5)]
