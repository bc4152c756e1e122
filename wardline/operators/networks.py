"""Long lists of networks, kept as a table: the most specific network of an address.

A network is an equality on the first bits of an address. So the join has plain keys, the
number of bits and their value, and its cost grows with the number of different prefix
lengths (at most 33) and not with the number of networks, overlapping ones included.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardline.functions.ip import ipv4_to_long

_TEXT = r"^[0-9.]+(/([0-9]|[12][0-9]|3[0-2]))?$"


def network_keys(networks: DataFrame, column: str = "network") -> DataFrame:
    """(bits, prefix, network) of networks in text form, `10.0.0.0/8` or a bare address.

    NULL rows and repeated ones count once or not at all. Text that is no network is an error, and so are
    set bits behind the prefix, as in the expression form.
    """
    parts = networks.select(F.col(column).alias("network")).filter("network IS NOT NULL").distinct().withColumns({
        "address_text": F.expr("split_part(network, '/', 1)"),
        "bits": F.expr("coalesce(try_cast(nullif(split_part(network, '/', 2), '') AS INT), 32)")})
    rows = parts.withColumn("address", ipv4_to_long("address_text"))
    sound = F.expr(f"network RLIKE '{_TEXT}' AND address IS NOT NULL AND address % shiftleft(1L, 32 - bits) = 0")
    prefix = F.when(F.coalesce(sound, F.lit(False)), F.expr("shiftright(address, 32 - bits)")).otherwise(
        F.raise_error(F.concat(F.lit("no network: "), F.col("network"))).cast("long"))
    return (rows.select("bits", prefix.alias("prefix"), "network")
            .groupBy("bits", "prefix").agg(F.min("network").alias("network")))  # an address, bare and as /32


def network_of(addresses: DataFrame, address: str, networks: DataFrame) -> DataFrame:
    """(address, network): each different numeric address that lies in a network, with its most specific one.

    `networks` is what `network_keys` gives. Addresses are made distinct on the map side before they are
    looked up, so a host with most of the rows is looked up once.
    """
    lengths = [row["bits"] for row in networks.select("bits").distinct().orderBy("bits").collect()]  # at most 33
    own = addresses.select(F.col(address).cast("long").alias("address")).filter(
        F.col("address").between(0, 2 ** 32 - 1)).distinct()
    if not lengths:
        return own.filter("false").withColumn("network", F.lit(None).cast("string"))
    keys = F.array(*[
        F.struct(F.lit(n).alias("bits"), F.expr(f"shiftright(address, {32 - n})").alias("prefix")) for n in lengths])
    return (own.select("address", F.explode(keys).alias("key")).select("address", "key.bits", "key.prefix")
            .join(networks, ["bits", "prefix"])
            .groupBy("address").agg(F.max_by("network", "bits").alias("network")))


def with_network(rows: DataFrame, address: str, networks: DataFrame, name: str = "network") -> DataFrame:
    """All rows, with the most specific network of their address, or NULL.

    The addresses that lie in a network join the rows once. AQE broadcasts them where they are measured to be
    few, and splits the rows of a hot address otherwise.
    """
    if name in rows.columns:
        raise ValueError(f"the rows have a column {name} already")
    found = network_of(rows, address, networks).toDF("__network_address", name)
    return rows.join(found, F.col(address) == F.col("__network_address"), "left").drop("__network_address")


def in_network_table(rows: DataFrame, address: str, networks: DataFrame) -> DataFrame:
    """The rows whose address lies in any of the networks."""
    found = network_of(rows, address, networks).select(F.col("address").alias("__network_address"))
    return rows.join(found, F.col(address) == F.col("__network_address"), "left_semi")
