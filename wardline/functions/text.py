"""Readable labels for codes, causes and byte counts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Labels of the scan codes.
SCAN_LABELS = {
    0: "Incomplete Flows",
    1: "RX-only (vittima)",
    2: "SYN Scan",
    3: "FIN Scan",
    4: "RST Scan",
}

# Labels of the failure causes, in the order that settles ties.
CAUSE_LABELS = {
    "dst2src_zero": "SERVER MAI HA RISPOSTO (timeout)",
    "error_code": "ERRORE PROTOCOLLO (NXDOMAIN/HTTP 4xx-5xx)",
    "unidirectional": "TRAFFICO UNIDIREZIONALE",
    "tcp_issues": "TCP ISSUES (connection refused / scan)",
    "unresolved": "HOSTNAME NON RISOLTO (sospetto DGA)",
    "probing": "PROBING ATTEMPT (sondaggio silenzioso)",
}


def _label(code: str) -> str:
    known = " ".join(f"WHEN {number} THEN '{label}'" for number, label in SCAN_LABELS.items())
    return f"CASE {code} {known} ELSE concat('Codice sconosciuto (', {code}, ')') END"


def scan_label(code: str) -> Column:
    return F.expr(_label(code))


def scan_labels(codes: str) -> Column:
    return F.expr(f"transform({codes}, code -> {_label('code')})")


def decimals(value: str, digits: int) -> str:
    # Round half to even first: the formatter alone would round ties up.
    return f"format_string('%.{digits}f', bround({value}, {digits}))"


def format_bytes(count: str) -> Column:
    units = (("GB", 1024 ** 3), ("MB", 1024 ** 2), ("KB", 1024))
    branches = " ".join(
        f"WHEN {count} >= {size} THEN concat({decimals(f'{count} / {size}', 2)}, ' {unit}')"
        for unit, size in units)
    return F.expr(f"CASE {branches} ELSE concat({count}, ' B') END")
