"""Scalar column expressions. Everything here stays in the JVM and inside whole-stage codegen."""

from pyspark.sql import Column, functions as F

from tidegauge.schemas import FEATURES, LABEL_IDS

# Protocol numbers, the IPv4 ethertype and the TCP flag bits.
TCP, UDP, ICMP = 6, 17, 1
IPV4 = 0x0800
FLAG_BITS = {"fin": 0x01, "syn": 0x02, "rst": 0x04, "psh": 0x08, "ack": 0x10, "urg": 0x20}

_CLIP = 1e10


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


# -- packets ---------------------------------------------------------------------------------------

def admission(l3_ok="l3_ok", ethertype="ethertype") -> Column:
    """B1: 'drop' a truncated frame, 'pass' what is not IPv4 (neither is counted), 'count' the rest."""
    return (F.when(~F.coalesce(_c(l3_ok), F.lit(False)), "drop")
            .when(F.coalesce(_c(ethertype), F.lit(-1)) != IPV4, "pass")
            .otherwise("count"))


def protocol_class(c="protocol") -> Column:
    """B2"""
    p = _c(c)
    return F.when(p == TCP, "tcp").when(p == UDP, "udp").when(p == ICMP, "icmp").otherwise("other")


def is_syn(protocol="protocol", flags="tcp_flags") -> Column:
    """A TCP packet with the SYN bit, whatever other bits it has."""
    return F.coalesce((_c(protocol) == TCP) & (_c(flags).bitwiseAND(FLAG_BITS["syn"]) != 0), F.lit(False))


def has_flag(name, flags="tcp_flags") -> Column:
    return F.coalesce(_c(flags).bitwiseAND(FLAG_BITS[name]) != 0, F.lit(False))


def port_or_zero(port, protocol="protocol", l4_ok="l4_ok") -> Column:
    """Ports exist only for a complete TCP or UDP header."""
    known = F.coalesce(_c(l4_ok), F.lit(False)) & _c(protocol).isin(TCP, UDP)
    return F.when(known, F.coalesce(_c(port), F.lit(0))).otherwise(0)


def flags_or_zero(flags="tcp_flags", protocol="protocol", l4_ok="l4_ok") -> Column:
    known = F.coalesce(_c(l4_ok), F.lit(False)) & (_c(protocol) == TCP)
    return F.when(known, F.coalesce(_c(flags), F.lit(0))).otherwise(0)


def ip_to_string(c) -> Column:
    """B5"""
    ip = _c(c).cast("long")
    parts = [F.shiftright(ip, s).bitwiseAND(255).cast("string") for s in (24, 16, 8, 0)]
    return F.when(ip.isNotNull(), F.concat_ws(".", *parts))


def ip_to_long(c) -> Column:
    """Null for text that is not a dotted IPv4 address."""
    text = F.trim(_c(c))
    parts = F.split(text, r"\.")
    byte = [F.get(parts, F.lit(i)).try_cast("long") for i in range(4)]
    ok = F.size(parts) == 4
    for b in byte:
        ok = ok & F.coalesce(b.between(0, 255), F.lit(False))
    return F.when(ok, byte[0] * 16777216 + byte[1] * 65536 + byte[2] * 256 + byte[3])


# -- labels ----------------------------------------------------------------------------------------

def norm_label(c="label") -> Column:
    """B6"""
    return F.trim(_c(c))


def is_benign(c="label") -> Column:
    return F.upper(norm_label(c)) == "BENIGN"


def encode_binary(c="label") -> Column:
    """0 for benign, 1 for every other (also missing) label."""
    return F.when(is_benign(c), 0).otherwise(1)


def label_id(c="label") -> Column:
    """Fixed code of a known label, null for an unknown one."""
    pairs = [F.lit(v) for kv in LABEL_IDS.items() for v in kv]
    return F.try_element_at(F.create_map(*pairs), norm_label(c))


def decode_binary(c) -> Column:
    """B9"""
    return F.when(_c(c) == 0, "BENIGN").otherwise("ATTACK")


def decode_label_id(c) -> Column:
    """B9 for the fixed codes of B10."""
    pairs = [F.lit(v) for k, i in LABEL_IDS.items() for v in (i, k)]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), _c(c).cast("int")), F.lit("UNKNOWN"))


# -- numbers ---------------------------------------------------------------------------------------

def to_number(c) -> Column:
    """Text or number to double; what is not a number becomes 0."""
    return F.coalesce(_c(c).try_cast("double"), F.lit(0.0))


def _is_inf(x):
    return F.abs(x) == float("inf")


def clean_number(c) -> Column:
    """Missing, NaN and infinite become 0, the rest is clipped to +-1e10."""
    x = _c(c).cast("double")
    clipped = F.greatest(F.lit(-_CLIP), F.least(F.lit(_CLIP), x))
    return F.when(x.isNull() | F.isnan(x) | _is_inf(x), 0.0).otherwise(clipped)


def nan_to_num(c) -> Column:
    """Missing and NaN become 0, infinities +-1e10, the rest is left alone."""
    x = _c(c).cast("double")
    return (F.when(x.isNull() | F.isnan(x), 0.0)
            .when(x == float("inf"), _CLIP).when(x == float("-inf"), -_CLIP).otherwise(x))


def ratio(n, d) -> Column:
    """n/d, 0 unless d > 0."""
    n, d = _c(n), _c(d)
    return F.when(d > 0, n.cast("double") / d).otherwise(0.0)


def safe_log2(x) -> Column:
    x = _c(x)
    return F.when(x > 0, F.log2(x)).otherwise(0.0)


def feature(name) -> Column:
    """A feature column by name; names hold '/' and blanks, so they are quoted."""
    return F.col(f"`{name}`")


def infer_attack_type(trained=True, is_attack=None) -> Column:
    """B17 on unscaled feature columns."""
    syn, ack = feature("SYN Flag Count"), feature("ACK Flag Count")
    pps, bps = feature("Flow Packets/s"), feature("Flow Bytes/s")
    if not trained:
        return F.lit("UNKNOWN")
    kind = (F.when((syn > 100) & (ack < 10), "SYN_Flood")
            .when((pps > 10000) & (bps > 1000000), "UDP_Flood")
            .when(pps > 5000, "DrDoS_UDP")
            .otherwise("DDoS_Generic"))
    return kind if is_attack is None else F.when(is_attack, kind).otherwise("BENIGN")


def select_features(columns, names=FEATURES):
    """The known names that exist, in the given order; an error when there are none."""
    have = {c.strip(): c for c in columns}
    found = [n for n in names if n in have]
    if not found:
        raise ValueError(f"none of the known feature columns is present in {list(columns)[:20]}")
    return found


# -- bands and texts -------------------------------------------------------------------------------

def severity(score="score", high=75.0) -> Column:
    """B18"""
    return F.when(_c(score) >= high, "high").otherwise("medium")


def severity4(score="score") -> Column:
    """B23"""
    s = _c(score)
    return F.when(s >= 85, "critical").when(s >= 75, "high").when(s >= 60, "medium").otherwise("low")


def intensity_band(pps) -> Column:
    """B20"""
    p = _c(pps)
    return (F.when(p < 50_000, "small").when(p < 500_000, "medium")
            .when(p < 2_000_000, "large").otherwise("hyper"))


def gbps_band(gbps) -> Column:
    """Null outside 10-800 Gbit/s."""
    g = _c(gbps)
    return (F.when((g >= 10) & (g < 50), "small").when((g >= 50) & (g < 200), "medium")
            .when((g >= 200) & (g <= 800), "large"))


def baseline_status(samples="samples") -> Column:
    """B21"""
    return F.when(F.coalesce(_c(samples), F.lit(0)) > 10, "Learned").otherwise("Learning")


def fixed(c, digits) -> Column:
    """Fixed-point text; exact ties go to the even digit, as in C and Python formatting."""
    pattern = "0" if digits == 0 else "0." + "0" * digits
    return F.call_function("format_number", _c(c).cast("double"), F.lit(pattern))


def _two_digits(x):
    # Two-digit ties are the odd eighths; the display convention rounds them up.
    return fixed(F.when(F.abs(x * 8) % 2 == 1, x + 0.001).otherwise(x), 2)


def human_count(c) -> Column:
    """B19"""
    n = _c(c).cast("double")
    whole = fixed(F.when(F.abs(n * 2) % 2 == 1, n + 0.25).otherwise(n), 0)
    return (F.when(n >= 1_000_000, F.concat(_two_digits(n / 1_000_000), F.lit("M")))
            .when(n >= 1_000, F.concat(_two_digits(n / 1_000), F.lit("K"))).otherwise(whole))


def human_bytes(c) -> Column:
    """B19"""
    n = _c(c).cast("double")
    out = F.when(n >= 1 << 30, F.concat(_two_digits(n / (1 << 30)), F.lit(" GB")))
    out = out.when(n >= 1 << 20, F.concat(_two_digits(n / (1 << 20)), F.lit(" MB")))
    out = out.when(n >= 1 << 10, F.concat(_two_digits(n / (1 << 10)), F.lit(" KB")))
    return out.otherwise(F.concat(_c(c).cast("string"), F.lit(" B")))


def alert_message(score="score") -> Column:
    """B22"""
    return F.concat(F.lit("DDoS attack detected (score: "), fixed(score, 1), F.lit(")"))


# -- time ------------------------------------------------------------------------------------------

def tick_start(ts, seconds) -> Column:
    """Start of the epoch-aligned tick that holds ts."""
    step = int(round(seconds * 1_000_000))
    us = F.unix_micros(_c(ts))
    return F.timestamp_micros(us - F.pmod(us, F.lit(step)))


def seconds_between(start, end) -> Column:
    return (F.unix_micros(_c(end)) - F.unix_micros(_c(start))) / 1_000_000.0
