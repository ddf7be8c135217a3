"""Answers of uncertain shape, and addresses against the standard library."""

import ipaddress
import json
import random

from pyspark.sql import functions as F

from sitelumen.functions import address
from sitelumen.sources import answers


def test_answers_of_every_shape(spark):
    good = {"organic": [{"link": "a", "title": "A", "position": 4}, {"link": "b"}, "no object", {"title": 7, "position": "x"}, *({"link": str(k)} for k in range(12))], "relatedSearches": [{"query": "q"}, {"query": ""}, {}, 5], "peopleAlsoAsk": [{"question": "why?"}], "aiOverview": {"text": "said"}}
    rows = {1: json.dumps(good), 2: '{"organic": null}', 3: "{}", 4: '{"organic": {"link": "x"}}', 5: "[1]", 6: "{cut", 7: "", 8: None, 9: '{"organic": [], "aiOverview": "text", "relatedSearches": "none"}', 10: "null", 11: "[" * 2000}
    got = answers.parsed(spark.createDataFrame(list(rows.items()), "id int, body string"))
    outcome = {r.id: (r.outcome, r.ai_overview) for r in answers.overviews(got).collect()}
    assert outcome == {1: ("ok", True), 2: ("ok", False), 3: ("ok", False), 4: ("wrong shape", False), 5: ("wrong shape", False), 6: ("broken", False), 7: ("no answer", False), 8: ("no answer", False), 9: ("ok", False), 10: ("wrong shape", False), 11: ("broken", False)}
    found = [(r.position, r.link, r.title) for r in answers.organic(got).orderBy("id").collect()]
    assert found[:4] == [(4, "a", "A"), (2, "b", ""), (3, "", "7"), (4, "0", "")] and len(found) == 10
    assert sorted((r.id, r.kind, r.ord, r.text) for r in answers.asked(got).collect()) == [(1, "question", 0, "why?"), (1, "related", 0, "q")]


def reachable(text):
    try:
        a = ipaddress.ip_address(text.split("%")[0])
    except ValueError:
        return None
    a = getattr(a, "ipv4_mapped", None) or a
    return not (a.is_private or a.is_loopback or a.is_link_local or a.is_reserved or a.is_multicast or a.is_unspecified)


def test_addresses_equal_the_standard_library(spark):
    texts = set()
    for network in [*address.SPECIAL, *address.PUBLIC, "100.64.0.0/10", "8.8.8.8/32", "2606:4700::/32", "64:ff9b::/96", "64:ff9b:1::/48"]:
        net = ipaddress.ip_network(network)
        top = 2 ** (32 if net.version == 4 else 128)
        kind = ipaddress.IPv4Address if net.version == 4 else ipaddress.IPv6Address
        for n in (int(net[0]) - 1, int(net[0]), int(net[-1]), int(net[-1]) + 1, (int(net[0]) + int(net[-1])) // 2):
            if 0 <= n < top:
                texts |= {str(kind(n)), *([kind(n).exploded, kind(n).exploded.upper()] if net.version == 6 else [f"::ffff:{kind(n)}", f"::FFFF:{n >> 16:x}:{n & 0xFFFF:x}"])}
    rng = random.Random(1)
    texts |= {str(ipaddress.IPv6Address(rng.getrandbits(128) & rng.choice([2**128 - 1, 2**64 - 1, (2**128 - 1) ^ (2**80 - 1)]))) for _ in range(300)} | {str(ipaddress.IPv4Address(rng.getrandbits(32))) for _ in range(200)}
    texts |= {"", "x", "1.2.3", "1.2.3.4.5", "256.1.1.1", "01.2.3.4", "1.2.3.4.", ".1.2.3.4", ":", ":::", "::", "::1", "1::2::3", "1:2:3:4:5:6:7", "1:2:3:4:5:6:7:8", "1:2:3:4:5:6:7:8:9", "1:2:3:4:5:6:7::", "::2:3:4:5:6:7:8", "1::3:4:5:6:7:8:9", "12345::", "g::", "fe80::1%eth0", "::1.2.3.4", "::1.2.3.400", "1:2:3:4:5:6:7:1.2.3.4", "1:2:3:4:5:6:1.2.3.4", ":1:2:3:4:5:6:7", "1:2:3:4:5:6:7:", "1.2.3.4:80", "0.0.0.0"}
    got = {r.t: (r.digits, r.public) for r in spark.createDataFrame([(t,) for t in texts] + [(None,)], "t string").select("t", address.number(F.col("t")).alias("digits"), address.is_public(F.col("t")).alias("public")).collect()}
    assert got.pop(None) == (None, None)
    for t in texts:
        try:
            a = ipaddress.ip_address(t.split("%")[0])
            want = f"{int(a):032x}" if a.version == 6 else "0" * 20 + "ffff" + f"{int(a):08x}"
        except ValueError:
            want = None
        assert got[t] == (want, reachable(t)), t


def test_may_fetch(spark):
    rows = [("https://a.b/", ["8.8.8.8"], True), ("ftp://a.b/", ["8.8.8.8"], False), ("http://", ["8.8.8.8"], False), ("http://a.b", [], False), ("http://a.b", ["8.8.8.8", "10.0.0.1"], False), ("HTTP://a.b", ["2606:4700::1", None], False), (None, ["8.8.8.8"], False), ("http://a.b", None, False)]
    got = spark.createDataFrame(rows, "u string, a array<string>, want boolean").withColumn("got", address.may_fetch(F.col("u"), F.col("a"))).collect()
    assert all(r.got == r.want for r in got), got
