"""Settings passed to the operators. All defaults are fixed values of the detection method."""

from dataclasses import dataclass, field

CUMULATIVE = "cumulative"
TICK = "tick"


@dataclass(frozen=True)
class DetectionConfig:
    """Thresholds of the rule score, the alert step and the traffic profile."""

    tick_seconds: float = 1.0
    scope: str = CUMULATIVE          # where ratios, entropy, shares and SYN counts are taken from
    frame: str = "prior"             # baseline over earlier ticks, or "inclusive" of the scored one

    # rate thresholds, packets per second
    attack_pps: float = 2000.0
    alert_pps: float = 500.0

    # trailing baseline
    baseline_samples: int = 300
    min_samples: int = 10
    sigma: float = 2.0
    change_rate: float = 3.0

    # expected protocol mix
    normal_tcp: float = 0.85
    normal_udp: float = 0.10
    normal_icmp: float = 0.05
    protocol_deviation: float = 0.3

    # source concentration
    min_entropy: float = 3.0
    top_k: int = 10
    top_share: float = 0.8
    syn_heavy: int = 500

    # verdict and response
    anomaly_score: float = 50.0
    high_severity: float = 75.0
    cooldown_seconds: float = 60.0
    block_top: int = 5
    block_packets: int = 10_000

    # per-packet drop
    syn_limit: int = 1000

    # long-term profile
    learning_seconds: float = 3600.0
    ema_alpha: float = 0.05

    # merge with a classifier's verdict
    ml_sure: float = 85.0
    ml_likely: float = 70.0
    stat_sure: float = 70.0
    hybrid_score: float = 60.0
    ml_weight: float = 30.0

    def __post_init__(self):
        if self.scope not in (CUMULATIVE, TICK):
            raise ValueError(f"scope must be '{CUMULATIVE}' or '{TICK}', not {self.scope!r}")
        if self.frame not in ("prior", "inclusive"):
            raise ValueError(f"frame must be 'prior' or 'inclusive', not {self.frame!r}")


@dataclass(frozen=True)
class RulePoints:
    """Points each rule adds to the score."""

    attack_rate: int = 50
    alert_rate: int = 25
    deviation: int = 30
    change: int = 20
    tcp_mix: int = 15
    udp_mix: int = 15
    icmp_mix: int = 15
    entropy: int = 20
    top_share: int = 10
    syn: int = 25


@dataclass(frozen=True)
class FeatureConfig:
    """Window of the per-tick feature vector."""

    window_samples: int = 1000
    forward_tcp: float = 0.6         # forward share when more than half of the packets are TCP
    forward_other: float = 0.8
    header_bytes: int = 40


@dataclass(frozen=True)
class TrainingConfig:
    """Settings of the training job."""

    model_type: str = "random_forest"  # or "gradient_boosting", "tree"
    num_trees: int = 100
    max_depth: int = 15
    min_leaf: int = 2
    seed: int = 42
    samples_per_file: int | None = 50_000
    balance: bool = False
    benign_ratio: float = 0.3
    fractions: tuple = field(default=(0.7, 0.1, 0.2))
