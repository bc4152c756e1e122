"""Host scores, risk bands, the network index and the suspect reports."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wardline.functions.text import decimals
from wardline.inputs import MetricInputs
from wardline.operators import flow_alerts, host_alerts, verdicts
from wardline.operators.verdicts import NOT_DETAILS
from wardline.params import RiskParams
from wardline.plans.profile import activity_of

# Names of the risk bands.
GREEN, YELLOW, RED = "VERDE", "GIALLO", "ROSSO"

# Names of the network states by number of critical hosts.
STATE_SAFE, STATE_LOCAL, STATE_SYSTEMIC = "rete sicura", "anomalia localizzata", "diffusione sistemica"


def risk_band(score: str, p: RiskParams) -> Column:
    return F.expr(f"CASE WHEN {score} >= {p.red_from} THEN '{RED}'"
                  f" WHEN {score} >= {p.yellow_from} THEN '{YELLOW}' ELSE '{GREEN}' END")


def _as_details(key: str, frame: DataFrame) -> DataFrame:
    """(host_ip, details struct named after the metric)."""
    columns = [c for c in frame.columns if c not in (*NOT_DETAILS, key, "penalita")]
    penalty = "penalita" if "penalita" in frame.columns else "NULL"
    return frame.selectExpr(
        "host_ip", f"struct({', '.join([*columns, f'CAST({penalty} AS INT) AS penalita'])}) AS {key}")


def host_scores(frames: Mapping[str, DataFrame], p: RiskParams) -> DataFrame:
    """One scored row per host flagged by at least one metric, from the metric frames.

    A metric with two rows for a host fails the query: neither of them may win by chance. Without
    any frame the network is empty; that takes a session, so there must be one.
    """
    if not frames:
        spark = SparkSession.getActiveSession()
        return _score([spark.createDataFrame([], "host_ip string")], [], p)
    return _score([_as_details(key, frame) for key, frame in frames.items()], list(frames), p)


def fused_host_scores(inputs: MetricInputs, p: RiskParams, activity: DataFrame | None = None) -> DataFrame:
    """The scores of all eight metrics from few scans.

    Reputation, volume and failure rate share one pass over the flows; certificates,
    missing SNI and protocols one over the alerted flows; ports and scans one over
    the host alerts. `activity` replaces the pass over the flows, e.g. by one that reads the hourly profile.
    """
    p = p.pinned()
    if activity is None:
        activity = activity_of(inputs, p, "v", "r", with_reputation=True)
    alerts = inputs.flow_alerts
    families = [
        (activity, [verdicts.reputation(p), verdicts.volume(p), verdicts.failure_rate(p)]),
        (flow_alerts.alert_activity(alerts, p),
         [verdicts.certificate(p), verdicts.missing_sni(p), verdicts.protocol_mismatch(p)]),
        (host_alerts.host_alert_activity(inputs.host_alerts, p),
         [verdicts.server_ports(p, "srv_hits"), verdicts.scan(p, "scan_hits")]),
    ]
    keys = ["M_rep", "M_cert", "M_sni", "M_srv", "M_proto", "M_scan", "M_vol", "M_fail"]
    wide = [
        hosts.selectExpr("host_ip", *[v.as_struct() for v in rules])
        .filter(" OR ".join(f"{v.key} IS NOT NULL" for v in rules))
        for hosts, rules in families
    ]
    return _score(wide, keys, p)


def _score(parts: Sequence[DataFrame], keys: Sequence[str], p: RiskParams) -> DataFrame:
    """Union of the parts, one row per host.

    The details of a metric are collected, at most one by contract, and a second one
    raises an error.
    """
    union = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    one = ("CASE WHEN size({0}) > 1 THEN raise_error(concat('{0} has more than one row for host ', host_ip))"
           " ELSE get({0}, 0) END AS {0}")
    hosts = union.groupBy("host_ip").agg(
        F.count(F.lit(1)).alias("n"), *[F.collect_list(k).alias(k) for k in keys]).selectExpr(
        "host_ip", *[one.format(k) for k in keys])
    total = " + ".join(["0", *[f"coalesce({k}.penalita, 0)" for k in keys]])
    active = ", ".join([*[f"CASE WHEN {k} IS NOT NULL THEN '{k}' END" for k in keys], "CAST(NULL AS STRING)"])
    return (
        hosts.withColumn("penalita_totale", F.expr(total))
        .withColumn("score", F.expr(f"least({p.score_max}, penalita_totale)"))
        .select(
            "host_ip",
            "score",
            risk_band("score", p).alias("fascia"),
            F.expr(f"array_compact(array({active})) AS metriche_attive"),
            "penalita_totale",
            F.struct(*keys).alias("dettagli"),
        )
    )


def host_items(inputs: MetricInputs, p: RiskParams,
               keys: Sequence[str] = ("M_srv", "M_proto", "M_scan")) -> DataFrame:
    """(host_ip, metric, item, hits): every port, protocol and scan code of every flagged host, without a limit.

    `keys` names the metrics to list; those without items are passed over.
    """
    p = p.pinned()
    families = {
        "M_srv": lambda: (host_alerts.port_hits(inputs.host_alerts, p), "CAST(port AS STRING)"),
        "M_proto": lambda: (flow_alerts.combination_hits(inputs.flow_alerts, p),
                            flow_alerts.COMBINATION.format("combination")),
        "M_scan": lambda: (host_alerts.code_hits(host_alerts.attacks(inputs.host_alerts, p)), "CAST(code AS STRING)"),
    }
    parts = [hits.selectExpr("host_ip", f"'{key}' AS metric", f"{item} AS item", "hits")
             for key, family in families.items() if key in keys for hits, item in [family()]]
    if not parts:
        return inputs.flows.sparkSession.createDataFrame([], "host_ip string, metric string, item string, hits long")
    return reduce(DataFrame.union, parts)


def flagged_hosts(scores: DataFrame) -> DataFrame:
    """Hosts flagged by each metric, metrics without any included."""
    keys = scores.schema["dettagli"].dataType.names
    counts = scores.agg(*[F.expr(f"count(dettagli.{k}) AS {k}") for k in keys])
    pairs = ", ".join(f"'{k}', {k}" for k in keys)
    return counts.selectExpr(f"stack({len(keys)}, {pairs}) AS (metric, n_hosts)")


def network_index(scores: DataFrame, p: RiskParams) -> DataFrame:
    """One row: worst score and its band, hosts per band, hosts seen."""
    worst = "coalesce(max(score), 0)"
    return scores.agg(
        F.expr(f"{worst} AS score_max"),
        risk_band(worst, p).alias("fascia_globale"),
        F.expr(f"count_if(fascia = '{GREEN}') AS host_verde"),
        F.expr(f"count_if(fascia = '{YELLOW}') AS host_giallo"),
        F.expr(f"count_if(fascia = '{RED}') AS host_rosso"),
        F.expr("count(*) AS host_totali_visti"),
    )


def network_state(index: DataFrame, p: RiskParams) -> DataFrame:
    """State of the network by the number of critical hosts."""
    return index.selectExpr(
        "score_max", "fascia_globale", "host_rosso AS host_critici",
        f"CASE WHEN host_rosso = 0 THEN '{STATE_SAFE}'"
        f" WHEN host_rosso >= {p.systemic_from} THEN '{STATE_SYSTEMIC}' ELSE '{STATE_LOCAL}' END AS stato")


def _suspects(scores: DataFrame) -> DataFrame:
    return scores.filter(F.col("fascia").isin(YELLOW, RED))


def suspect_ranking(scores: DataFrame, p: RiskParams = RiskParams()) -> DataFrame:
    """Hosts in the yellow and red bands, worst first, with the active metrics as a list and as short text."""
    cut = f"concat(left(metriche, {p.list_width - 3}), '...')"
    return (
        _suspects(scores)
        .selectExpr("host_ip", "score", "fascia", "concat_ws(', ', metriche_attive) AS metriche",
                    "metriche_attive")
        .withColumn("metriche", F.expr(
            f"CASE WHEN length(metriche) > {p.list_width} THEN {cut} ELSE metriche END"))
        .orderBy(F.desc("score"), "host_ip")
    )


def _shown(value: str, data_type: T.DataType) -> str:
    """A detail as report text: four decimals for floats, bracketed lists."""
    if isinstance(data_type, T.DoubleType):
        return decimals(value, 4)
    if isinstance(data_type, T.ArrayType):
        quote = "chr(39)" if isinstance(data_type.elementType, T.StringType) else "''"
        return f"concat('[', array_join(transform({value}, v -> concat({quote}, v, {quote})), ', '), ']')"
    return f"CAST({value} AS STRING)"


def _fields(value: str, struct: T.StructType, prefix: str = "") -> list[str]:
    """(campo, valore) of every detail field; nested fields get dotted names."""
    fields = []
    for field in struct.fields:
        name, inner = prefix + field.name, f"{value}.{field.name}"
        if isinstance(field.dataType, T.StructType):
            fields += _fields(inner, field.dataType, f"{name}.")
        elif name != "penalita":
            fields.append(f"named_struct('campo', '{name}', 'valore', {_shown(inner, field.dataType)})")
    return fields


def suspect_details(scores: DataFrame, p: RiskParams) -> DataFrame:
    """Why a host is suspect: one row per detail of every metric that fired on it.

    Rows come in report order: hosts by score, their metrics in scoring order, and
    `ordine_metrica` and `posizione` number metrics and details, so a written table can be put
    in order again. `penalita_grezza` is the sum before the cap, given only where the cap was exceeded.
    """
    metrics = [(f"dettagli.{f.name}", f.name, f.dataType) for f in scores.schema["dettagli"].dataType.fields]
    entries = ", ".join(
        f"CASE WHEN {value} IS NOT NULL THEN named_struct('metrica', '{name}', 'ordine_metrica', {order},"
        f" 'penalita', {value}.penalita, 'campi', array({', '.join(_fields(value, struct))})) END"
        for order, (value, name, struct) in enumerate(metrics))
    host = ["host_ip", "score", "fascia"]
    return (
        _suspects(scores)
        .selectExpr(*host, f"CASE WHEN penalita_totale > {p.score_max} THEN penalita_totale END AS penalita_grezza",
                    f"explode(array_compact(array({entries}))) AS m")
        .selectExpr(*host, "penalita_grezza", "m.metrica", "m.ordine_metrica", "m.penalita",
                    "posexplode(m.campi) AS (posizione, f)")
        .selectExpr(*host, "penalita_grezza", "metrica", "ordine_metrica", "penalita", "posizione",
                    "f.campo", "f.valore")
        .orderBy(F.desc("score"), "host_ip", "ordine_metrica", "posizione")
    )
