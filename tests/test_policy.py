import random

from packets import frame, frames

import netlog as nl

INTEREST = [(443, 6, None), (8080, 6, None), (514, 17, None)]


def interest(spark):
    return spark.createDataFrame(INTEREST, "port INT, proto INT, loaded_at TIMESTAMP")


def allow(spark, rows):
    return spark.createDataFrame(rows, "plen INT, net BIGINT")


ALLOWED = 0x0A000001
CASES = [
    (frame(cut=10), "short_eth"),
    (frame(src=0x7F000001), "bypass_loopback"),
    (frame(src=0x7F000002), "not_allowlisted"),
    (frame(dport=22), "bypass_ssh"),
    (frame(sport=22), "bypass_ssh"),
    (frame(src=0x0B000001, dport=22), "bypass_ssh"),
    (frame(src=0x0B000001), "not_allowlisted"),
    (frame(proto=1), "pass"),
    (frame(dport=0), "pass"),
    (frame(dport=8081), "not_of_interest"),
    (frame(cut=14 + 20 + 19), "short_l4"),
    (frame(src=0x0B000001, cut=14 + 20 + 19), "not_allowlisted"),
    (frame(proto=17, dport=22), "pass"),
    (frame(proto=17, dport=22), "rate_limited"),
    (frame(dport=8080), "pass"),
    (frame(dport=8080), "rate_limited"),
]


def test_edge_reasons(spark):
    flows = nl.decode_frames(frames(spark, [data for data, _ in CASES])).drop("frame")
    verdicts = nl.edge_verdict(flows, interest(spark), allow(spark, [(8, 0x0A000000)]), threshold=1).collect()
    got = {r.seq: r for r in verdicts}
    assert len(verdicts) == len(CASES)
    assert [got[i].edge_reason for i in range(len(CASES))] == [reason for _, reason in CASES]
    assert [got[i].rate_limited for i in range(len(CASES))] == [r == "rate_limited" for _, r in CASES]


def test_empty_and_absent_allowlist(spark):
    flows = nl.decode_frames(frames(spark, [frame(dport=8080), frame(dport=8081)])).drop("frame")
    empty = nl.edge_verdict(flows, interest(spark), allow(spark, []))
    assert {r.edge_reason for r in empty.collect()} == {"not_allowlisted"}
    skipped = nl.edge_verdict(flows, interest(spark), None)
    assert {r.seq: r.edge_reason for r in skipped.collect()} == {0: "pass", 1: "not_of_interest"}


def test_longest_prefix_against_brute_force(spark):
    rng = random.Random(7)
    prefixes = {(0, 0), (32, 0xFFFFFFFF), (8, 0x0A000000), (24, 0x0A000000)}
    for _ in range(60):
        plen = rng.randint(1, 32)
        base = rng.choice([0x0A000000, 0xC0A80000, 0x0A010000]) | rng.getrandbits(12)
        prefixes.add((plen, (base >> (32 - plen)) << (32 - plen)))
    ips = [rng.choice([0x0A000000, 0xC0A80000, 0x0A010000, 0xFFFFFFFF, 0]) ^ rng.getrandbits(rng.choice([4, 12, 31]))
           for _ in range(500)]
    for chosen in (prefixes, prefixes - {(0, 0)}):
        df = spark.createDataFrame(list(enumerate(ips)), "seq BIGINT, src_ip BIGINT")
        for options in ({}, {"max_keys": 0}):
            got = {r.seq: r.allow_plen for r in nl.flag_allowlist(df, allow(spark, sorted(chosen)), **options).collect()}
            for i, ip in enumerate(ips):
                hits = [p for p, n in chosen if ip >> (32 - p) == n >> (32 - p)]
                assert got[i] == (max(hits) if hits else None)
            assert len(got) == len(ips)


def test_intervals_of_nested_and_adjacent_prefixes(spark):
    base = 0x0A000000
    listed = allow(spark, [(8, base), (24, base), (24, base + 256), (26, base + 64), (26, base + 64), (32, base + 127), (32, 0xFFFFFFFF), (33, 0), (None, 0), (8, -1), (8, None), (8, 1 << 32)])
    got = sorted(tuple(r) for r in nl.prefix_intervals(listed).collect())
    assert got == [(base, 24), (base + 64, 26), (base + 127, 32), (base + 128, 24), (base + 256, 24), (base + 512, 8),
                   (base + (1 << 24), None), (0xFFFFFFFF, 32)]
    rejects = sorted((r.reject_reason, r.plen, r.net) for r in nl.allowlist_rejects(listed).na.fill(-7).collect())
    assert rejects == [("bad_net", 8, -7), ("bad_net", 8, -1), ("bad_net", 8, 1 << 32), ("bad_plen", -7, 0), ("bad_plen", 33, 0)]
    flows = spark.createDataFrame([(0, None), (1, base + 70)], "seq BIGINT, src_ip BIGINT")
    for options in ({}, {"max_keys": 0}):
        assert {r.seq: r.allow_plen for r in nl.flag_allowlist(flows, listed, **options).collect()} == {0: None, 1: 26}


def test_a_large_allowlist_is_joined_by_shuffle(spark):
    rows = [(32, ip) for ip in range(0x0A000000, 0x0A000200, 2)]
    df = spark.createDataFrame([(i, 0x0A000000 + i) for i in range(600)], "seq BIGINT, src_ip BIGINT")
    flagged = nl.flag_allowlist(df, allow(spark, rows), max_broadcast=10)
    assert "SortMergeJoin" in flagged._jdf.queryExecution().executedPlan().toString()
    assert {r.seq: r.allow_plen for r in flagged.collect()} == {
        i: 32 if i < 512 and i % 2 == 0 else None for i in range(600)
    }


def test_host_bits_in_a_prefix_are_ignored(spark):
    df = spark.createDataFrame([(0, 0x0A000010), (1, 0x0A000110)], "seq BIGINT, src_ip BIGINT")
    got = {r.seq: r.allow_plen for r in nl.flag_allowlist(df, allow(spark, [(23, 0x0A000105), (25, 0x0A0001FF)])).collect()}
    assert got == {0: 23, 1: 23}


def test_lookups_are_broadcast_joins(spark):
    df = spark.createDataFrame([(0, 1, 443, 6)], "seq BIGINT, src_ip BIGINT, dst_port INT, proto INT")
    for plan_of in (nl.interest_join(df, interest(spark)), nl.allowlist_join(df, allow(spark, [(8, 0x0A000000)]))):
        plan = plan_of._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" in plan
        assert "SortMergeJoin" not in plan and "NestedLoop" not in plan and "Cartesian" not in plan


def test_interest_join_does_not_repeat_rows(spark):
    doubled = spark.createDataFrame(INTEREST * 2 + [(70_000, 6, None), (443, 1, None)],
                                    "port INT, proto INT, loaded_at TIMESTAMP")
    df = spark.createDataFrame([(0, 443, 6), (1, 443, 17), (2, 443, 1)], "seq BIGINT, dst_port INT, proto INT")
    assert [r.seq for r in nl.interest_join(df, doubled).collect()] == [0]
    assert {r.seq: r.of_interest for r in nl.flag_interest(df, doubled).collect()} == {0: True, 1: False, 2: False}
