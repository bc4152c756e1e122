"""Fields of the alert payloads. Missing or malformed JSON gives an empty default."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def scan_codes(json: str) -> Column:
    return F.expr(f"coalesce(from_json({json}, 'alerts array<int>').alerts, CAST(array() AS array<int>))")


def contacted_port(json: str) -> Column:
    return F.expr(f"coalesce(try_cast(get_json_object({json}, '$.port') AS INT), 0)")


def detected_protocol(json: str) -> Column:
    # The key holds a dot, hence the bracket form of the path.
    return F.expr(f"""coalesce(get_json_object({json}, "$.alerts['30']['proto.ndpi']"), '')""")
