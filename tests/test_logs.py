import json

import pytest
from pyspark.sql import functions as F

import netlog as nl

BAD = "bad_json"
CASES = [
    (b'{"event": "login", "user_id": 123, "status": "success"}', None),
    (b'{"event": "login", ', BAD),
    (b'{"event": "test", "value": 42}', None),
    (b"{}", None),
    (b' {"a":1}\n', None),
    (b'\t\r\n{"a":{"b":[1,{"c":null}]}}', None),
    (b'{"a":1,"a":2}', None),
    (b"[1,2]", BAD), (b"5", BAD), (b"null", BAD), (b'"x"', BAD), (b" ", BAD),
    (b"", "empty"),
    (b"{'a':1}", BAD), (b'{"a":01}', BAD), (b'{"a":NaN}', BAD), (b'{"a":1} x', BAD), (b'{"a":1}] x', BAD),
    (b'{"a":1}} x', BAD), (b'{"a":1},{"b":2}', BAD), (b'{"a":1},', BAD), (b'{"a":1}\x00', BAD),
    (b'{"a":1}{"b":2}', BAD), (b'{"a":1},"x"] y', BAD), (b'{"a":"b', BAD), (b'{"a":1}/* c */', BAD),
    (b'{"a":1,}', BAD), (b'{a:1}', BAD), (b'{"a":.5}', BAD), (b'{"a":"\t"}', BAD),
    (bytes.fromhex("7B2261223A22FF227D"), BAD), (b'\xef\xbb\xbf{"a":1}', BAD),
    ('{"a":"é漢😀"}'.encode(), None),
    (rb'{"a":"\ud83d\ude00"}', None), (rb'{"a":"x\\\\ud83d"}', None), (rb'{"a":"\u00e9\uD83D\uDE00 \ud7ff\ue000"}', None),
    (rb'{"a":"\ud83d"}', BAD), (rb'{"a":"\uDE00"}', BAD), (rb'{"a":"\ude00\ud83d"}', BAD),
    (rb'{"a":"\ud800\\\udc00"}', BAD), (rb'{"a":"\\\\\ud83d"}', BAD), (rb'{"\ud83dx":1}', BAD), (rb'{"a":"\\\\ud83d\ude00"}', BAD),
]


def parsed(spark, values):
    df = spark.createDataFrame([(i, bytearray(v)) for i, v in enumerate(values)], "seq BIGINT, data BINARY")
    return nl.parse_logs(df)


def test_strict_parse(spark):
    logs = parsed(spark, [v for v, _ in CASES]).select("seq", F.to_json("doc").alias("line"), "reject_reason")
    got = {r.seq: r for r in logs.collect()}
    for i, (value, reason) in enumerate(CASES):
        assert got[i].reject_reason == reason, value
        if reason is None:
            assert json.loads(got[i].line) == json.loads(value)
        else:
            assert got[i].line is None


def test_size_limit(spark):
    def sized(n):
        return b'{"a":"' + b"x" * (n - 8) + b'"}'

    got = [r.reject_reason for r in parsed(spark, [sized(1_048_576), sized(1_048_577)]).orderBy("seq").collect()]
    assert got == [None, "too_large"]
    # bytes count, not characters
    wide = '{"a":"' + "é" * 524_285 + '"}'
    assert parsed(spark, [wide.encode()]).first().reject_reason == "too_large"


def test_earlier_reject_is_kept(spark):
    df = spark.createDataFrame(
        [(0, None, "bad_ref"), (1, "{}", None)], "seq BIGINT, data STRING, reject_reason STRING"
    )
    assert [r.reject_reason for r in nl.parse_logs(df).orderBy("seq").collect()] == ["bad_ref", None]


def test_fields_and_flatten(spark):
    logs = parsed(spark, [b'{"event":"login","user_id":123,"x.y\'z":true,"n":{"k":1}}', b"bad", b"{}"])
    row = nl.with_fields(logs, {"event": "string", "user_id": "bigint", "x.y'z": "boolean", "no": "string"}).orderBy("seq").first()
    assert (row["event"], row["user_id"], row["x.y'z"], row["no"]) == ("login", 123, True, None)
    pairs = {(r.seq, r.key): r.text for r in nl.flatten(logs).select("seq", "key", F.to_json("value").alias("text")).collect()}
    assert pairs == {(0, "event"): '"login"', (0, "user_id"): "123", (0, "x.y'z"): "true", (0, "n"): '{"k":1}'}


def test_parse_happens_once_under_a_filter(spark):
    logs = parsed(spark, [b"{}"]).where("reject_reason IS NULL").where(F.col("doc").isNotNull())
    plan = logs._jdf.queryExecution().executedPlan().toString()
    assert plan.count("parseJson") == 1


def test_session_setting_is_required(spark):
    spark.conf.set("spark.sql.variant.allowDuplicateKeys", "false")
    try:
        with pytest.raises(ValueError):
            nl.parse_logs(spark.createDataFrame([("{}",)], "data STRING"))
    finally:
        nl.configure(spark)


def test_candidates(spark):
    values = [b"{", b"[1]", b' {"a":1}', b"x", b""]
    for schema, rows in (("data BINARY", [(bytearray(v),) for v in values]), ("data STRING", [(v.decode(),) for v in values])):
        assert nl.candidates(spark.createDataFrame(rows, schema), "data").count() == 2


def test_counts(spark):
    logs = parsed(spark, [b"{}", b"x", b"", b"{}"])
    row = nl.stage_counts(logs).first()
    assert (row.events, row.accepted, row.structural_drops, row.parser_drops) == (4, 2, 0, 2)
    assert {r.reject_reason: r.rows for r in nl.reason_counts(logs, "reject_reason").collect()} == {
        None: 2, "bad_json": 1, "empty": 1
    }


def test_numbers_beyond_a_double_are_bad(spark):
    good = ['{"a":1e308}', '{"a":-1E+308}', '{"a":1e-400}', '{"a":"1e400"}', '{"1e400":"\\\\\\"1e400"}', '{"a":0e999}',
            '{"a":%s}' % ("9" * 308), '{"a":"%s"}' % ("9" * 400), '{"a":"x\\\\","b":"1e999"}', '{"a":"%s 1e999"}' % ('\\"' * 20_000)]
    bad = ['{"a":1e309}', '{"a":-1E+400}', '{"a":[{"b":2.5e308}]}', '{"a":%s}' % ("9" * 310), '{"s":"\\"","a":1e999}', '{"a":"\\\\","b":1e999}']
    rows = [(i, text) for i, text in enumerate(good + bad)]
    got = {r.i: r.reject_reason for r in nl.parse_logs(spark.createDataFrame(rows, "i INT, data STRING")).collect()}
    assert [got[i] for i in range(len(rows))] == [None] * len(good) + ["bad_json"] * len(bad)
