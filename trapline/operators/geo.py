"""Location: the range join of addresses to places, and the latest position per address."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trapline.functions.addresses import ip_hex, is_ipv4, prefix_key, with_ip_number
from trapline.functions.display import filled
from trapline.operators.arguments import check_limit

# Address prefixes that are never looked up.
SKIPPED_PREFIXES = ["10.", "172.16.", "192.168.", "127.", "0."]

_PLACE = ["country_code", "country_name", "city", "latitude", "longitude", "asn", "as_org"]

# Events without a usable address get one of this many keys that match nothing,
# so that they do not meet in one partition of a shuffled join.
_NO_MATCH_KEYS = 4096


def enrich_geo(events: DataFrame, geo_ranges: DataFrame, bucket_bits: int = 16, spread: int = 1) -> DataFrame:
    """Add place columns by a left join of ``src_ip`` to non-overlapping ranges.

    Each range is listed under every address prefix of ``bucket_bits`` bits it
    touches, which turns the range test into an equality join plus a check.  At
    16 bits a range table adds at most 65,536 rows to its own, and an address
    meets only the ranges of its prefix.

    The join carries no hint.  A range table below the broadcast threshold is
    broadcast and the events are not shuffled at all; a larger one is joined by
    a shuffle, where hot prefixes are split at run time.  ``spread`` above one
    splits every prefix that many ways up front, for sessions that run without
    adaptive execution.

    A miss gives empty text and 0.0, not null; only ``asn`` is null.
    """
    src_ip = F.col("src_ip")
    looked_up = F.lit(True)
    for prefix in SKIPPED_PREFIXES:
        looked_up = looked_up & ~F.startswith(src_ip, F.lit(prefix))
    row_hash = F.xxhash64(events.columns[0], "src_ip")
    shift = 32 - bucket_bits
    keyed = with_ip_number(events, src_ip, "_ip").withColumn(
        "_prefix",
        F.when(F.col("_ip").isNotNull() & looked_up, F.shiftright("_ip", shift)).otherwise(
            -1 - F.pmod(row_hash, F.lit(_NO_MATCH_KEYS))
        ),
    )
    prefixes = F.sequence(F.shiftright("start_ip", shift), F.shiftright("end_ip", shift))
    ranges = geo_ranges.select(
        F.explode(prefixes).alias("_prefix"),
        "start_ip",
        "end_ip",
        F.coalesce("country_code", F.lit("")).alias("_country_code"),
        F.coalesce("country_name", F.lit("")).alias("_country_name"),
        F.coalesce(filled(F.col("city")), F.col("subdivision"), F.lit("")).alias("_city"),
        F.coalesce("latitude", F.lit(0.0)).alias("_latitude"),
        F.coalesce("longitude", F.lit(0.0)).alias("_longitude"),
        F.col("asn").alias("_asn"),
        F.coalesce("as_org", F.lit("")).alias("_as_org"),
    )
    match = F.col("e._prefix") == F.col("r._prefix")
    if spread > 1:
        keyed = keyed.withColumn("_slice", F.pmod(row_hash, F.lit(spread)))
        ranges = ranges.withColumn("_slice", F.explode(F.array(*[F.lit(n).cast("bigint") for n in range(spread)])))
        match = match & (F.col("e._slice") == F.col("r._slice"))
    match = match & F.col("e._ip").between(F.col("r.start_ip"), F.col("r.end_ip"))

    def found(name: str, missing) -> Column:
        return F.coalesce(f"r._{name}", missing).alias(name)

    return (
        keyed.alias("e")
        .join(ranges.alias("r"), match, "left")
        .select(
            *[F.col(f"e.{name}") for name in events.columns],
            found("country_code", F.lit("")),
            found("country_name", F.lit("")),
            found("city", F.lit("")),
            found("latitude", F.lit(0.0)),
            found("longitude", F.lit(0.0)),
            F.col("r._asn").alias("asn"),
            found("as_org", F.lit("")),
        )
    )


def enrich_networks(events: DataFrame, networks: DataFrame) -> DataFrame:
    """Add place columns by the longest network that holds ``src_ip``, IPv4 or IPv6.

    ``networks``: network (address, slash, length) and the place columns of ``enrich_geo``'s ranges.  Networks may lie
    within others; IPv4 ones also hold the IPv6 addresses that wrap theirs.  Of equal networks one is taken, the smallest by its columns.

    Each distinct address is looked up once, under its prefix of every length that occurs, by one equality
    join without a hint.  A miss, which text that is no address is too, gives empty text and 0.0, not null; only ``asn`` is null.
    """
    address, length = F.substring_index("network", "/", 1), F.substring_index("network", "/", -1).try_cast("int")
    places = networks.select(
        ip_hex(address).alias("hex"),
        (length + F.when(is_ipv4(address), 96).otherwise(0)).alias("bits"),
        F.struct(
            F.coalesce("country_code", F.lit("")).alias("country_code"),
            F.coalesce("country_name", F.lit("")).alias("country_name"),
            F.coalesce(filled(F.col("city")), F.col("subdivision"), F.lit("")).alias("city"),
            F.coalesce("latitude", F.lit(0.0)).alias("latitude"),
            F.coalesce("longitude", F.lit(0.0)).alias("longitude"),
            F.col("asn").alias("asn"),
            F.coalesce("as_org", F.lit("")).alias("as_org"),
        ).alias("place"),
    ).filter(F.col("hex").isNotNull() & F.col("bits").between(0, 128))
    # At most 129 lengths.
    lengths = sorted(row.bits for row in places.select("bits").distinct().collect())
    if not lengths:
        lengths = [128]

    def keyed(rows: DataFrame) -> DataFrame:
        cases = [F.struct(F.lit(bits).alias("bits"), prefix_key(F.col("hex"), bits).alias("prefix")) for bits in lengths]
        return rows.withColumn("keys", F.array(*cases))

    network = keyed(places).select("bits", "place", F.filter("keys", lambda key: key["bits"] == F.col("bits"))[0]["prefix"].alias("prefix"))
    network = network.groupBy("bits", "prefix").agg(F.min("place").alias("place"))
    seen = events.select(F.col("src_ip").alias("seen_ip")).distinct().withColumn("hex", ip_hex(F.col("seen_ip")))
    looked_up = keyed(seen.filter("hex IS NOT NULL")).select("seen_ip", F.inline("keys"))
    found = looked_up.join(network, ["bits", "prefix"]).groupBy("seen_ip").agg(F.max_by("place", "bits").alias("found_place"))
    joined = events.join(found, F.col("src_ip") == F.col("seen_ip"), "left")
    missing = {"latitude": F.lit(0.0), "longitude": F.lit(0.0), "asn": F.lit(None)}
    return joined.select(
        *events.columns,
        *(F.coalesce(F.col(f"found_place.{name}"), missing.get(name, F.lit(""))).alias(name) for name in _PLACE),
    )


def geo_pins(attempts: DataFrame, limit: int = 500, dedupe: bool = False, drop_unresolved: bool = False) -> DataFrame:
    """The latest attempt of each address with its attempt count, the busiest addresses first.

    Several attempts of an address at its latest moment give several pins,
    unless ``dedupe`` keeps the one with the highest id.

    The counts are combined before the shuffle.  Because every address has at
    least one pin, the pins of the ``limit`` busiest addresses contain the
    answer; those few addresses are broadcast back to the attempts, so no
    address is ever gathered in one task.
    """
    check_limit(limit, 2000)
    located = attempts.filter(F.col("latitude").isNotNull())
    if drop_unresolved:
        attempts = attempts.filter(F.col("country_code") != "")
        located = located.filter(F.col("country_code") != "")
    busiest = (
        located.groupBy("src_ip")
        .agg(F.count("*").alias("count"), F.max("timestamp").alias("latest_timestamp"))
        .orderBy(F.desc("count"), "src_ip")
        .limit(limit)
    )
    latest = (
        attempts.alias("a")
        .join(
            F.broadcast(busiest).alias("b"),  # at most `limit` rows
            (F.col("a.src_ip") == F.col("b.src_ip")) & (F.col("a.timestamp") == F.col("b.latest_timestamp")),
        )
        .select(
            "a.latitude",
            "a.longitude",
            "b.count",
            "a.country_code",
            "a.country_name",
            "a.city",
            "b.latest_timestamp",
            F.col("a.event_id").alias("latest_event_id"),
            F.col("a.src_ip").alias("latest_src_ip"),
            "a.id",
        )
    )
    if dedupe:
        names = [name for name in latest.columns if name != "latest_src_ip"]
        newest = F.max(F.struct("id", *[name for name in names if name != "id"])).alias("newest")
        latest = latest.groupBy("latest_src_ip").agg(newest).select(*[f"newest.{n}" for n in names], "latest_src_ip")
    return latest.orderBy(F.desc("count"), "latest_src_ip", "id").limit(limit)
