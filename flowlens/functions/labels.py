"""Column functions on class labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from flowlens.contract import BENIGN

# Original label -> attack family.
ATTACK_GROUPS = {
    "BENIGN": "Normal Traffic",
    "DoS Hulk": "DoS",
    "DDoS": "DDoS",
    "PortScan": "Port Scanning",
    "DoS GoldenEye": "DoS",
    "FTP-Patator": "Brute Force",
    "DoS slowloris": "DoS",
    "DoS Slowhttptest": "DoS",
    "SSH-Patator": "Brute Force",
    "Bot": "Bots",
    "Web Attack � Brute Force": "Web Attacks",
    "Web Attack � XSS": "Web Attacks",
    "Infiltration": "Infiltration",
    "Web Attack � Sql Injection": "Web Attacks",
    "Heartbleed": "Miscellaneous",
}
RARE_GROUPS = ("Infiltration", "Miscellaneous")


def normalize_label(label: Column) -> Column:
    """Trim, turn U+FFFD into ``-`` and drop the dash after ``Web Attack``."""
    text = F.replace(F.trim(label.cast("string")), F.lit("�"), F.lit("-"))
    return F.replace(text, F.lit("Web Attack -"), F.lit("Web Attack"))


def binary_target(label: Column) -> Column:
    """1 for every label but BENIGN; a missing label counts as an attack."""
    return F.when(label.eqNullSafe(F.lit(BENIGN)), 0).otherwise(1)


def attack_group(label: Column) -> Column:
    """Attack family of a raw or normalised label, NULL if there is none."""
    pairs = dict(ATTACK_GROUPS)
    for raw, group in ATTACK_GROUPS.items():
        pairs[raw.replace("�", "-").replace("Web Attack -", "Web Attack")] = group
    lookup = F.create_map(*[F.lit(x) for pair in pairs.items() for x in pair])
    return F.try_element_at(lookup, label)
