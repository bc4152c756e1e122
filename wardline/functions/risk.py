"""Tests on the risk bitmap of a flow."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from wardline.params import RiskParams

NO_ANSWER = "DST2SRC_PACKETS = 0"


def _any_bit(bitmap: str, *bits: int) -> str:
    return f"{bitmap} & {sum(1 << b for b in set(bits))}L != 0"


def has_any_bit(bitmap: str, *bits: int) -> Column:
    return F.expr(_any_bit(bitmap, *bits))


def is_failed(p: RiskParams) -> Column:
    """A flow fails when the server never answered or a failure risk is set."""
    return F.expr(f"{NO_ANSWER} OR {_any_bit('FLOW_RISK', *p.fail_bits)}")


def failure_causes(p: RiskParams) -> dict[str, Column]:
    """The six causes, which may overlap on one flow."""
    bits = {
        "error_code": p.bit_error_code,
        "unidirectional": p.bit_unidirectional,
        "tcp_issues": p.bit_tcp_issues,
        "unresolved": p.bit_unresolved,
        "probing": p.bit_probing,
    }
    risks = {name: has_any_bit("FLOW_RISK", bit) for name, bit in bits.items()}
    return {"dst2src_zero": F.expr(NO_ANSWER), **risks}
