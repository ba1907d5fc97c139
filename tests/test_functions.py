import ipaddress
import random

from pyspark.sql import functions as F

from vigilog.functions import net, scalar
from vigilog.operators.flatten import flatten_text, parse_dict_text, path_value


def private(text):
    if not text:
        return None
    try:
        return ipaddress.ip_address(text.split("/")[0].strip()).is_private
    except ValueError:
        return None


def test_private_addresses_agree_with_the_standard_library(spark):
    rng = random.Random(5)
    ips = [
        "", "x", "1.2.3", "01.2.3.4", "256.1.1.1", "::", "::1", "1::2::3", "fe80::1%eth0", "::ffff:10.0.0.1",
        "::ffff:8.8.8.8", "2001:db8::1", "1:2:3:4:5:6:7:8", "1:2:3:4:5:6:7::", "1:2:3:4:5:6:7:8:9", ":1", "1:", "12345::",
        "10.0.0.1/8", " 8.8.8.8 ", "2001:1::1", "2002::1", "fc00::1", "1.2.3.4.5", "::1.2.3.4", "::1.2.3", "100.64.0.1",
        "192.0.0.9", "192.0.0.8", ":::", "a::b:1.2.3.4", "172.15.255.255", "172.16.0.0", "172.31.255.255", "172.32.0.0",
    ]
    ips += [str(ipaddress.IPv4Address(rng.getrandbits(32))) for _ in range(300)]
    ips += [str(ipaddress.IPv6Address(rng.getrandbits(128))) for _ in range(300)]
    rows = spark.createDataFrame([(i,) for i in ips], "ip string").select("ip", net.is_private_ip(F.col("ip")).alias("p"))
    assert [(r.ip, r.p) for r in rows.collect() if r.p != private(r.ip)] == []


def test_first_octet_and_class(spark):
    rows = spark.createDataFrame([("10.1.1.1",), ("150.0.0.1/8",), ("::1",), (None,), ("250.1",), ("x",)], "ip string")
    got = rows.select(net.first_octet(F.col("ip")), net.ip_class(F.col("ip"))).collect()
    assert [tuple(r) for r in got] == [(10, "A"), (150, "B"), (None, None), (None, None), (250, "E"), (None, None)]


def test_timestamp_shapes(spark):
    texts = {
        "2024-01-02T03:04:05Z": "2024-01-02 03:04:05", "2024-01-02T03:04:05.5Z": "2024-01-02 03:04:05.500000",
        "2024-01-02T03:04:05+02:00": "2024-01-02 01:04:05", "2024-01-02T03:04:05-0130": "2024-01-02 04:34:05",
        "2024-01-02T03:04:05": "2024-01-02 03:04:05", "2024-01-02 03:04:05": "2024-01-02 03:04:05",
        " 2024-01-02 ": "2024-01-02 00:00:00", "": None, "yesterday": None, "2024-13-01": None, "2024-01-02 03:04": None,
    }
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [str(r[0]) if r[0] else None for r in df.select(scalar.parse_timestamp(F.col("t"))).collect()]
    assert got == list(texts.values())


def test_dictionary_texts(spark):
    texts = ["{'a': {'b': 1}, 'c': [1, 2]}", '{"a": {"b": 2}}', "{'a': None, 'c': True}", "{'a': \"it's\"}", "oops", None, "[1]", "3"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select(parse_dict_text(F.col("t")).alias("v"))
    got = df.select(path_value(F.col("v"), "a.b", "int"), path_value(F.col("v"), "a"), F.col("v").isNotNull()).collect()
    assert [r[0] for r in got] == [1, 2, None, None, None, None, None, None]
    assert got[3][1] == "it's"
    assert [r[2] for r in got] == [True, True, True, True, False, False, False, False]


def test_flatten_limits_depth_and_long_lists(spark):
    text = "{'a': {'b': {'c': 1}}, 'l': [1, 2, 3, 4, 5, 6], 's': [1, 2], 'e': {}}"
    df = spark.createDataFrame([(1, text)], "id int, x string")
    row = flatten_text(df, ["x"], depth=2, long_lists=5).first().asDict()
    assert row == {"id": 1, "x_a_b": '{"c":1}', "x_e": "{}", "x_l": "[6 items]", "x_s": "1, 2"}
    deep = flatten_text(df, ["x"]).first().asDict()
    assert deep["x_a_b_c"] == 1 and deep["x_l"] == "1, 2, 3, 4, 5, 6"


def test_severity_and_levels(spark):
    df = spark.createDataFrame([("CRITICAL", 80.0), (None, 79.9), ("x", 20.0), ("debug", 19.9)], "s string, v double")
    got = df.select(scalar.severity_number(F.col("s")), scalar.score_level(F.col("v"))).collect()
    assert [tuple(r) for r in got] == [(4, "Critical"), (1, "High"), (1, "Low"), (-1, "Info")]


def test_observed_types_reach_every_level(spark):
    from vigilog.operators.flatten import observed_types

    text = "1"
    for name in reversed("abcdefghij"):
        text = '{"%s": %s}' % (name, text)
    df = spark.range(1).select(F.parse_json(F.lit(text)).alias("event"))
    found = {r.field: r.type for r in observed_types(df, "event").collect()}
    assert len(found) == 11 and found["event.a.b.c.d.e.f.g.h.i"] == "OBJECT" and "event.a.b.c.d.e.f.g.h.i.j" in found


def test_long_keys_are_not_broadcast():
    from vigilog.operators.lookup import KeyProfile

    assert KeyProfile(10, {"k": 1_000}, {"k": 10}, {"k": 50}).few("k", 2_000)
    assert not KeyProfile(10, {"k": 1_000}, {"k": 10}, {"k": 100_000}).few("k", 2_000)
