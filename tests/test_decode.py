from packets import frame, frames

import netlog as nl

INTEREST = [(443, 6, None), (8080, 6, None), (53, 17, None), (514, 17, None)]
SCHEMA = "port INT, proto INT, loaded_at TIMESTAMP"
BODY = b'{"a":1}'

CAPTURE_CASES = [
    (frame(cut=13), "short_eth"),
    (frame(payload=BODY), "captured"),
    (frame(tags=[0x8100], payload=BODY), "captured"),
    (frame(tags=[0x88A8, 0x8100], payload=BODY), "captured"),
    (frame(tags=[0x8100] * 3, payload=BODY), "not_ipv4"),
    (frame(tags=[0x8100], cut=16), "short_vlan"),
    (frame(tags=[0x8100, 0x8100], cut=20), "short_vlan"),
    (frame(tags=[0x8100, 0x8100], cut=21), "short_vlan"),
    (frame(ethertype=0x86DD, payload=BODY), "not_ipv4"),
    (frame(ethertype=0x86DD, cut=14), "not_ipv4"),
    (frame(cut=14), "short_ip"),
    (frame(cut=33), "short_ip"),
    (frame(tags=[0x8100], cut=37), "short_ip"),
    (frame(cut=14 + 20 + 19), "short_l4"),
    (frame(proto=17, dport=53, cut=14 + 20 + 7), "short_l4"),
    (frame(proto=1), "not_tcp_udp"),
    (frame(dport=8081, payload=BODY), "not_of_interest"),
    (frame(proto=17, dport=8080, payload=BODY), "not_of_interest"),
    (frame(), "empty_payload"),
    (frame(tot_len=30, payload=BODY), "empty_payload"),
    (frame(payload=b"x" * 1024), "captured"),
    (frame(payload=b"x" * 1025), "delegated_large"),
    (frame(proto=17, dport=514, payload=BODY), "captured"),
]


def test_capture_reasons(spark):
    interest = spark.createDataFrame(INTEREST, SCHEMA)
    flows = nl.decode_frames(frames(spark, [data for data, _ in CAPTURE_CASES]))
    got = {r.seq: r.capture_reason for r in nl.capture_verdict(flows, interest).collect()}
    assert [got[i] for i in range(len(CAPTURE_CASES))] == [reason for _, reason in CAPTURE_CASES]


def test_payload_bytes(spark):
    cases = [
        (frame(payload=BODY), BODY, None),
        (frame(tags=[0x88A8, 0x8100], payload=BODY), BODY, None),
        (frame(payload=BODY, pad=6), BODY, None),
        (frame(payload=BODY, doff=8), BODY, None),
        (frame(payload=BODY, tot_len=20 + 20 + 50), None, "short_payload"),
        (frame(proto=17, dport=53, payload=BODY), BODY, None),
    ]
    interest = spark.createDataFrame(INTEREST, SCHEMA)
    events = nl.capture_inline(nl.decode_frames(frames(spark, [c[0] for c in cases])), interest)
    got = {r.seq: r for r in events.collect()}
    assert len(got) == len(cases)
    for i, (_, data, reason) in enumerate(cases):
        assert got[i].reject_reason == reason
        assert (got[i].data if data is None else bytes(got[i].data)) == data
    assert got[4].data_len == 50


def test_ip_options(spark):
    df = frames(spark, [frame(ihl=6, dport=8080, payload=BODY)])
    as_is = nl.decode_frames(df).first()
    assert as_is.dst_port != 8080
    exact = nl.decode_frames(df, honor_ihl=True).first()
    assert (exact.dst_port, exact.payload_len, exact.payload_off) == (8080, 7, 14 + 24 + 20)


def test_columns(spark):
    row = nl.decode_frames(frames(spark, [
        frame(tags=[0x8100], src=0xC0A80001, dst=0xFFFFFFFF, sport=65535, dport=53, proto=17, payload=b"abc")
    ])).first()
    assert (row.src_ip, row.dst_ip) == (0xC0A80001, 0xFFFFFFFF)
    assert (row.src_port, row.dst_port, row.proto, row.n_vlan) == (65535, 53, 17, 1)
    assert (row.payload_off, row.payload_len, row.decode_status) == (14 + 4 + 20 + 8, 3, "ok")


def test_other_protocol_keeps_addresses(spark):
    row = nl.decode_frames(frames(spark, [frame(proto=1, src=0x7F000001)])).first()
    assert (row.src_ip, row.proto, row.dst_port, row.decode_status) == (0x7F000001, 1, None, "not_tcp_udp")


def test_plan_is_narrow_and_decoded_once(spark):
    flows = nl.decode_frames(frames(spark, [frame(payload=BODY)])).where("decode_status = 'ok' AND payload_len > 0")
    plan = flows._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan
    # one read each of the address word and the port word: the filter did not repeat the decode
    assert plan.count("(_ip") <= 8
