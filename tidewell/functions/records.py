"""Functions of flow and session records: numbers as written, services, handshakes, signals, class rules, signatures, scaling."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Texts that stand for no number.
NO_NUMBER = ("", "-", "(empty)")
#: Services by well-known port.
PORT_SERVICES = {
    20: "FTP", 21: "FTP", 22: "SSH", 23: "TELNET", 25: "SMTP", 53: "DNS", 67: "DHCP", 68: "DHCP", 80: "HTTP", 110: "POP3", 123: "NTP", 143: "IMAP",
    161: "SNMP", 443: "HTTPS", 445: "SMB", 502: "MODBUS", 1883: "MQTT", 1900: "SSDP", 5353: "MDNS", 8080: "HTTP_ALT", 8883: "MQTT_TLS",
}


def finite_number(text: Column, default: float = 0.0) -> Column:
    """A finite number, or ``default``."""
    v = F.when(~F.coalesce(text, F.lit("")).isin(*NO_NUMBER), text.try_cast("double"))
    return F.coalesce(F.when(~F.isnan(v) & (F.abs(v) < float("inf")), v), F.lit(default))


def whole_part(text: Column, default: int = 0) -> Column:
    """The whole part of a number that may be written as a decimal, or ``default``."""
    v = F.when(~F.coalesce(text, F.lit("")).isin(*NO_NUMBER), text.try_cast("double"))
    whole = F.when(v < 0, F.ceil(v)).otherwise(F.floor(v)).cast("long")
    return F.coalesce(F.when(F.abs(v) < 9.2e18, whole), F.lit(default).cast("long"))


def service(protocol: Column, sport: Column, dport: Column, supplied: Column) -> Column:
    """``category, source``: a supplied service, cleaned; else that of the lower known port; else a class of the lower port; else the protocol."""
    given = F.lower(F.trim(F.coalesce(supplied, F.lit(""))))
    cleaned = F.regexp_replace(F.upper(given), r"[^\p{L}\p{N}_-]", "")
    low, high = F.least(sport, dport), F.greatest(sport, dport)
    ports = F.create_map(*[F.lit(x) for pair in PORT_SERVICES.items() for x in pair])
    known = F.coalesce(F.try_element_at(ports, low.cast("int")), F.try_element_at(ports, high.cast("int")))
    port = F.when(low != 0, low).when(high != 0, high)
    ranged = F.when(port < 1024, "OTHER_SYSTEM").when(port < 49_152, "OTHER_REGISTERED").when(port.isNotNull(), "EPHEMERAL")
    pair = lambda c, s: F.struct(c.alias("category"), F.lit(s).alias("source"))
    own = F.when(cleaned == "", "UNKNOWN").otherwise(cleaned)
    return (
        F.when(~given.isin(*NO_NUMBER), pair(own, "supplied")).when(known.isNotNull(), pair(known, "known_port"))
        .when(ranged.isNotNull(), pair(ranged, "port_range")).otherwise(pair(protocol, "protocol"))
    )


def handshake(flags: Column, syn: Column, synack: Column) -> Column:
    """The state of a session's handshake from the union of its flags and whether either half was seen."""
    closed = flags.bitwiseAND(5) != 0
    return (
        F.when(syn & synack & closed, "ESTABLISHED_CLOSED").when(syn & synack, "ESTABLISHED_OPEN").when(syn, "INCOMPLETE_HANDSHAKE")
        .when(flags.bitwiseAND(4) != 0, "RESET").otherwise("NOT_APPLICABLE_OR_UNOBSERVED")
    )


def present(rules: Mapping[str, Column]) -> Column:
    """The names of the rules that hold, sorted; a rule of null does not hold."""
    return F.array_sort(F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in rules.items()])))


def session_signals(c: Mapping[str, Column]) -> Column:
    """Mechanism signals of a session from its counters (named as below); none of them looks at a label."""
    any_of = lambda a, b: (c[a] > 0) & (c[b] > 0)
    exchange = any_of("requests", "responses")
    return present(
        {
            "http_activity": c["requests"] > 0, "authentication_failure": c["denied"] > 0, "write_method": c["writes"] > 0, "encrypted_application": c["tls"] > 0,
            "request_response_exchange": exchange, "bidirectional_exchange": any_of("sent_packets", "got_packets"),
            "established_exchange": (c["synack"] > 0) | any_of("sent_payload", "got_payload") | exchange,
            "small_flow": (c["packets"] <= 12) & (c["bytes"] <= 4096), "large_client_body": c["sent_payload"] >= 65_536,
            "client_payload_asymmetry": c["sent_payload"] >= 4 * F.greatest(F.lit(1), c["got_payload"]),
            "incomplete_handshake": (c["syn"] > 0) & (c["synack"] == 0), "reset_observed": c["rst"] > 0,
            "high_syn_ratio": (c["packets"] > 0) & (c["syn"] >= 0.75 * c["packets"]), "repeated_request_in_session": c["requests"] >= 4, "short_session": (c["packets"] <= 4) & (c["duration"] <= 2.0),
        }
    )


def temporal_signals(c: Mapping[str, Column]) -> Column:
    """Signals of a session's past, from its counts."""
    share = c["same_target"] / F.greatest(F.lit(1), c["prior"])
    burst = c["prior"] >= 20
    return present(
        {
            "session_burst": burst, "target_concentration": burst & (share >= 0.75), "incomplete_handshake_burst": burst & (c["incomplete"] >= 0.75 * c["prior"]),
            "extreme_connection_rate_proxy": (c["prior"] >= 1000) & (share >= 0.75), "repeated_exact_relation": c["repeated"] > 0, "short_inter_session_gap": c["gap"] <= 1.0,
        }
    )


#: For each class the sets of signals of which one must be there in full; ``p:`` is of payload, ``a:`` of application,
#: ``t:`` of time, ``r:`` of relation, ``s:`` of session, ``*:`` of any.
CLASS_RULES = {
    "SQL_injection": ["p:sql_expression", "a:sql_expression"],
    "Password": ["p:credential_structure", "a:http a:authentication_response"],
    "Uploading": ["p:upload_method", "a:upload_method", "p:file_transfer_metadata", "a:file_transfer_metadata", "p:script_content", "a:script_content"],
    "Vulnerability_scanner": [f"{k}:{x}" for x in ("path_traversal", "script_content", "probe_method", "command_structure", "exploit_structure") for k in "pa"] + ["t:probe_burst"],
    "DDoS_HTTP": ["s:http_activity t:session_burst t:target_concentration"],
    "DDoS_TCP": ["t:incomplete_handshake_burst t:target_concentration t:extreme_connection_rate_proxy", "t:incomplete_handshake_burst t:target_concentration s:high_syn_ratio"],
    "Port_Scanning": ["t:incomplete_handshake_burst t:port_diversity", "t:incomplete_handshake_burst t:probe_burst"],
    "MITM": ["r:arp_mapping_conflict", "r:dns_mapping_conflict"],
    "Backdoor": ["p:command_structure", "*:periodic_service_pattern *:bidirectional_exchange"],
    "Ransomware": ["p:command_structure", "p:file_transfer_metadata", "p:script_content", "s:malware_network_exchange"],
    "Normal": ["p:telemetry_semantics", "s:mqtt_activity s:established_exchange"],
}


def class_relevant(label: Column, sets: Mapping[str, Column]) -> Column:
    """Whether the signals bear on a row's class; null for a class without rules."""
    every = F.array_union(F.coalesce(sets["t"], F.array().cast("array<string>")), F.coalesce(sets["s"], F.array().cast("array<string>")))

    def holds(rule: str) -> Column:
        out = F.lit(True)
        for kind, name in (x.split(":") for x in rule.split(" ")):
            out = out & F.coalesce(F.array_contains(every if kind == "*" else sets[kind], name), F.lit(False))
        return out

    cases = None
    for name, rules in CLASS_RULES.items():
        hit = F.lit(False)
        for r in rules:
            hit = hit | holds(r)
        cases = F.when(label == name, hit) if cases is None else cases.when(label == name, hit)
    return cases


def failure_mode(c: Mapping[str, Column]) -> Column:
    """Why a class lacks support: the first rule that holds."""
    hidden = (c["payload_available"] & ~c["payload_visible"]) | (c["application_available"] & ~c["application_visible"])
    return (
        F.when(c["supported"], "NONE").when(c["raw_signal"] & ~c["session_keeps"], "SESSIONIZATION_LOSS").when(~c["raw_signal"], "NETWORK_OBSERVABILITY_LIMITED")
        .when(hidden, "EVIDENCE_SELECTION_LOSS").when(c["temporal_gap"], "TEMPORAL_FEATURE_GAP").when(c["relation_gap"], "RELATION_FEATURE_GAP").otherwise("AMBIGUOUS")
    )


def tier(value: Column, bars: list, names: list[str]) -> Column:
    """The name of the highest bar that a value reaches; the first name below all bars."""
    out = F.lit(names[0])
    for bar, name in zip(bars, names[1:]):
        out = F.when(value >= bar, name).otherwise(out)
    return F.when(value.isNotNull(), out)


def fit_scale(rows: DataFrame, columns: list[str]) -> dict[str, tuple[float, float]]:
    """Mean and population deviation of the finite values of some columns, in one pass; a column without spread has scale 1."""
    finite = lambda c: F.when(~F.isnan(F.col(c).cast("double")) & (F.abs(F.col(c)) < float("inf")), F.col(c).cast("double"))
    r = rows.agg(*[f(finite(c)).alias(f"{c}_{n}") for c in columns for n, f in (("m", F.avg), ("s", F.stddev_pop))]).first()
    return {c: (r[f"{c}_m"] or 0.0, r[f"{c}_s"] or 1.0) for c in columns}


def scaled(column: str, fitted: Mapping[str, tuple[float, float]], clip: float = 10.0) -> Column:
    """A column less its mean over its deviation, clipped; 0 for what is not finite."""
    mean, spread = fitted[column]
    x = F.col(column).cast("double")
    z = F.least(F.lit(clip), F.greatest(F.lit(-clip), (x - mean) / spread))
    return F.when(~F.isnan(x) & (F.abs(x) < float("inf")), z).otherwise(0.0)


def clamped_log(column: Column) -> Column:
    """The signed logarithm of one plus the size; infinities count as 1e15, NaN and null as 0."""
    x = F.coalesce(F.nanvl(column.cast("double"), F.lit(0.0)), F.lit(0.0))
    x = F.least(F.lit(1e15), F.greatest(F.lit(-1e15), x))
    return F.signum(x) * F.log1p(F.abs(x))


def entropy(p: Column) -> Column:
    """The entropy of an array of probabilities over the logarithm of its length."""
    total = F.aggregate(p, F.lit(0.0), lambda a, x: a - F.when(x > 0, x * F.log(x)).otherwise(0.0))
    return F.when(F.size(p) > 1, total / F.log(F.size(p).cast("double"))).otherwise(0.0)


def first_best(p: Column) -> Column:
    """The index of the greatest element, the first of equals."""
    return F.array_position(p, F.array_max(p)).cast("int") - 1


def margin(p: Column) -> Column:
    top = F.sort_array(p, False)
    return F.get(top, F.lit(0)) - F.coalesce(F.get(top, F.lit(1)), F.lit(0.0))


def one_hot(value: Column, names: list[str]) -> Column:
    return F.array(*[(value == n).cast("double") for n in names])


def trajectory(before: Column, after: Column, action: Column, actions: list[str]) -> Column:
    """A vector of how probabilities moved: of the end (confidence, margin, entropy, action), of the start, and of the change."""
    i, j = first_best(before), first_best(after)
    at = F.get
    ends = [F.array_max(after), margin(after), entropy(after)]
    starts = [F.array_max(before), margin(before), entropy(before)]
    moves = [a - b for a, b in zip(ends, starts)]
    rest = [(i != j).cast("double"), at(before, j), at(after, i), at(after, j) - at(before, j), at(after, i) - at(before, i), at(after, j) - at(after, i)]
    return F.concat(F.array(*ends), one_hot(action, actions), F.array(*starts, *moves, *rest))


def direction(sent: Column, got: Column) -> list[Column]:
    """``asymmetry, sent_share``: of the bytes of both ways; 0 without bytes."""
    total = F.greatest(F.lit(0), sent) + F.greatest(F.lit(0), got)
    part = lambda x: F.when(total > 0, x / total).otherwise(0.0)
    return [part(F.abs(sent - got)).alias("asymmetry"), part(sent).alias("sent_share")]


def log2_bucket(value: Column, most: int) -> Column:
    return F.least(F.lit(most), F.floor(F.log2(F.greatest(F.lit(1), value)))).cast("int")


def near_signature(duration: Column, packets: Column, size: Column, *shapes: Column) -> Column:
    """A digest of a session's coarse behaviour: buckets of its figures and shapes that hold no identity."""
    return F.sha2(F.concat_ws("|", log2_bucket(duration + 1, 16), log2_bucket(packets, 24), log2_bucket(size, 32), *shapes), 256)


def observation(f: Mapping[str, Column]) -> Column:
    """``kind, detail, number`` of a decoded frame, of the first protocol that it shows: HTTP, DNS, TLS, Modbus; null for others."""
    said = F.lower(F.coalesce(f["protocols"], F.lit("")))
    has = lambda n: F.coalesce(f[n], F.lit("")) != ""
    digits = lambda n: F.when(f[n].rlike(r"^\d{1,9}$"), f[n].cast("int"))
    made = lambda kind, detail, number: F.struct(F.lit(kind).alias("kind"), detail.cast("string").alias("detail"), number.cast("int").alias("number"))
    none = F.lit(None)
    return (
        F.when(has("method") | has("status") | F.contains(said, F.lit("http")), made("http", F.when(has("method"), F.substring(F.upper(f["method"]), 1, 16)), F.substring(f["status"], 1, 3).try_cast("int")))
        .when(has("query_name") | F.contains(said, F.lit("dns")), made("dns", f["query_shape"], digits("query_type")))
        .when(F.contains(said, F.lit("tls")) | has("tls_type"), made("tls", F.when(has("tls_type"), F.substring(f["tls_type"], 1, 24)), none))
        .when(has("function") | F.contains(said, F.lit("modbus")), made("modbus", F.when(has("function"), F.substring(f["function"], 1, 24)), none))
    )
