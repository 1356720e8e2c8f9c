"""Disease classification and per-disease alert policies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Reference code groups and wording used by the classification.
RARE_CODES = ["1E70", "1C81", "1B93", "1D60.01"]
RARE_NAMES = ["smallpox", "poliomyelitis", "plague", "ebola"]
PRIORITY_CODES = [
    "1F03", "1E71", "1D65", "1D64", "1D60.01", "1C1C.0", "1C82",
    "1D2Z", "1F4Z", "1D47", "1D40", "1D48", "1B1Z", "1C12",
]
CLUSTER_CODES = ["1A00", "1A07", "1A09.0", "1A02", "1A06", "1A31", "1A36", "1C1A.Z", "1E50.0"]
SURGE_CODES = ["1E32", "1C12", "1B1Z", "CA40.Z", "CA41.Z", "CA01"]
QUIET_GASTRO_CODES = ["DA22.Z", "DD70", "DD71.Z"]
ENVIRONMENT_CODES = ["CA23", "CA22.Z", "CA20.1", "CA24", "CA21.Y", "CB03.4", "MD31"]
WATER_FOOD_MARKERS = ["waterborne", "foodborne", "fecal_oral"]
AIRWAY_MARKERS = ["airborne", "droplet", "respiratory", "close_contact"]
REFERENCE_SOURCE = "icd11_cdc_nci_seed"

# Codes that share one policy.
POLICY_ALIASES = {
    "MEA": "MEASLES", "MEASLES": "MEASLES", "1F03": "MEASLES",
    "COL": "CHOLERA", "CHOLERA": "CHOLERA", "1A00": "CHOLERA",
    "POL": "POLIO", "POLIO": "POLIO", "1C81": "POLIO",
    "SMPX": "SMALLPOX", "SMALLPOX": "SMALLPOX", "1E70": "SMALLPOX",
    "HEPA": "HEPA", "1E50.0": "HEPA",
    "PLG": "PLAGUE", "PLAGUE": "PLAGUE", "1B93": "PLAGUE",
    "EBOLA": "EBOLA", "1D60.01": "EBOLA",
    "SARS": "SARS", "1D65": "SARS",
    "MERS": "MERS", "1D64": "MERS",
    "MPOX": "MPOX", "1E71": "MPOX",
    "INFLUENZA": "INFLUENZA", "1E32": "INFLUENZA",
    "PERTUSSIS": "PERTUSSIS", "1C12": "PERTUSSIS",
    "TYPHOID": "TYPHOID", "1A07": "TYPHOID",
    "TUBERCULOSIS": "TUBERCULOSIS", "TB": "TUBERCULOSIS", "1B1Z": "TUBERCULOSIS",
    "RABIES": "RABIES", "1C82": "RABIES",
    "MENINGOCOCCAL": "MENINGOCOCCAL", "MENINGOCOCCAL_MENINGITIS": "MENINGOCOCCAL",
    "1C1C.0": "MENINGOCOCCAL",
    "DENGUE": "DENGUE", "1D2Z": "DENGUE",
    "MALARIA": "MALARIA", "1F4Z": "MALARIA",
    "YELLOW_FEVER": "YELLOW_FEVER", "1D47": "YELLOW_FEVER",
    "CHIKUNGUNYA": "CHIKUNGUNYA", "1D40": "CHIKUNGUNYA",
    "ZIKA": "ZIKA", "1D48": "ZIKA",
    "SALMONELLA_ENTERITIS": "SALMONELLA_ENTERITIS", "1A09.0": "SALMONELLA_ENTERITIS",
    "SHIGELLA": "SHIGELLA", "1A02": "SHIGELLA",
    "CAMPYLOBACTER": "CAMPYLOBACTER", "1A06": "CAMPYLOBACTER",
    "LISTERIOSIS": "LISTERIOSIS", "1C1A.Z": "LISTERIOSIS",
}
POLICY_PRIORITY_CODES = [
    "MEASLES", "COVID", "HFV", "EBOLA", "SARS", "MERS", "MPOX", "RABIES", "MENINGOCOCCAL",
    "DENGUE", "MALARIA", "YELLOW_FEVER", "CHIKUNGUNYA", "ZIKA", "TUBERCULOSIS", "PERTUSSIS",
]
POLICY_RARE_CODES = ["POLIO", "PLAGUE", "SMALLPOX", "EBOLA"]

# Overrides of the derived policy; None keeps the derived value.
SETTINGS = [
    ("high_priority", "boolean"), ("rare_disease", "boolean"), ("lookback_days", "int"),
    ("baseline_window_days", "int"), ("radius_km", "double"), ("severity_weight", "double"),
    ("density_weight", "double"), ("trend_weight", "double"), ("rarity_weight", "double"),
    ("cluster_case_threshold", "int"), ("critical_case_threshold", "int"),
]
_ = None
PROFILE_OVERRIDES = {
    "high_priority": (True, _, 10, 21, 3.0, 1.9, 1.35, 1.25, _, 2, 4),
    "rare": (True, True, 30, 30, 10.0, 2.3, 1.5, 1.2, 3.0, 1, 1),
    "cluster_sensitive": (_, _, 7, 14, 2.0, _, 1.7, 1.5, _, 2, 4),
    "surge_sensitive": (_, _, 7, 21, 3.0, _, 1.2, 1.7, _, 3, 5),
    "environmental_signal": (_, _, 30, 60, 5.0, 0.75, 0.9, 1.25, _, 5, 9),
}
CODE_OVERRIDES = {
    "MEASLES": (True, _, 14, 21, 3.0, 2.2, 1.4, 1.3, _, 1, 2),
    "CHOLERA": (_, _, 7, 14, 3.0, _, 1.8, 1.8, _, 2, 4),
    "POLIO": (True, True, 30, 30, 10.0, 2.5, 1.5, 1.2, 3.0, 1, 1),
    "SMALLPOX": (True, True, 30, 45, 10.0, 2.6, 1.5, 1.2, 3.2, 1, 1),
    "PLAGUE": (True, True, 21, 30, 6.0, 2.4, 1.5, 1.2, 3.0, 1, 1),
    "EBOLA": (True, True, 21, 30, 8.0, 2.6, 1.4, 1.2, 3.2, 1, 1),
    "HEPA": (_, _, 5, 14, 2.0, _, 1.6, 1.7, _, 3, 5),
    "TYPHOID": (_, _, 7, 14, 2.5, _, 1.7, 1.6, _, 2, 4),
    "SALMONELLA_ENTERITIS": (_, _, 3, 10, 1.5, _, 1.8, 1.6, _, 3, 6),
    "SHIGELLA": (_, _, 4, 10, 1.5, _, 1.8, 1.6, _, 3, 6),
    "CAMPYLOBACTER": (_, _, 4, 10, 1.5, _, 1.7, 1.5, _, 3, 6),
    "LISTERIOSIS": (_, _, 7, 21, 2.0, _, 1.6, 1.4, _, 2, 4),
    "INFLUENZA": (_, _, 7, 21, 3.0, _, 1.1, 1.9, _, 4, 7),
    "PERTUSSIS": (True, _, 14, 21, 3.0, _, 1.4, 1.6, _, 2, 4),
    "TUBERCULOSIS": (True, _, 30, 60, 2.0, _, 1.1, 1.4, _, 2, 4),
    "RABIES": (True, _, 60, 60, 10.0, 2.4, 1.0, 0.8, _, 1, 1),
    "MENINGOCOCCAL": (True, _, 10, 21, 2.0, 2.3, 1.4, 1.3, _, 1, 2),
    "MPOX": (True, _, 14, 21, 3.0, _, 1.4, 1.3, _, 2, 3),
    "SARS": (True, _, 14, 21, 4.0, _, 1.5, 1.5, _, 1, 2),
    "MERS": (True, _, 14, 21, 4.0, _, 1.5, 1.5, _, 1, 2),
    "DENGUE": (True, _, 14, 28, 5.0, _, 1.5, 1.4, _, 2, 4),
    "MALARIA": (True, _, 14, 28, 5.0, _, 1.4, 1.3, _, 2, 4),
    "YELLOW_FEVER": (True, _, 14, 28, 5.0, _, 1.5, 1.4, _, 1, 2),
    "CHIKUNGUNYA": (True, _, 14, 28, 5.0, _, 1.3, 1.3, _, 2, 4),
    "ZIKA": (True, _, 14, 28, 5.0, _, 1.3, 1.3, _, 2, 4),
    "FPO": (_, _, 2, 7, 1.0, _, 1.9, 1.7, _, 4, 8),
}


def _has_any(text: Column, words: list[str]) -> Column:
    found = F.lit(False)
    for word in words:
        found = found | text.contains(word)
    return found


def classify_diseases(diseases: DataFrame, source_name: str = REFERENCE_SOURCE) -> DataFrame:
    """Add policy profile, priority and rarity to reference disease rows."""
    code = F.upper(F.trim("disease_code"))
    name, kind, vector = (F.lower(F.trim(c)) for c in ("name", "type", "transmission_vector"))
    risk, score = F.col("risk_level"), F.col("infection_score")
    rare = code.isin(RARE_CODES) | _has_any(name, RARE_NAMES)
    epidemic, priority = kind == "epidemic_infectious", code.isin(PRIORITY_CODES)
    in_cluster = code.isin(CLUSTER_CODES) | (kind == "gastrointestinal") | _has_any(vector, WATER_FOOD_MARKERS)
    in_surge = code.isin(SURGE_CODES) | (kind == "respiratory") | _has_any(vector, AIRWAY_MARKERS)
    ladder = [
        (rare, "rare"),
        (code.isin(QUIET_GASTRO_CODES), "general"),
        (code.isin(ENVIRONMENT_CODES), "environmental_signal"),
        ((epidemic & priority) | (kind == "high_alert_notifiable"), "high_priority"),
        (kind == "cancer_environmental_signal", "environmental_signal"),
        (in_cluster, "cluster_sensitive"),
        (in_surge, "surge_sensitive"),
        (epidemic & ((score >= 0.75) | (risk >= 4)), "high_priority"),
        ((risk >= 5) & (score >= 0.8), "high_priority"),
    ]
    profile = F.lit("general")
    for test, value in reversed(ladder):
        profile = F.when(test, value).otherwise(profile)
    return diseases.withColumns(
        {
            "policy_profile": profile,
            "rare_disease": rare,
            "high_priority": rare | priority | profile.isin("high_priority", "rare"),
            "is_reference": F.lit(True),
            "source_name": F.lit(source_name),
        }
    )


def infection_signal(score: Column) -> Column:
    positive = F.greatest(score, F.lit(0.0))
    return (
        F.when(positive <= 1.0, positive)
        .when(positive <= 5.0, F.round(positive / 5.0, 3))
        .otherwise(1.0)
    )


def normal_code(code: Column) -> Column:
    text = F.upper(F.trim(code))
    return F.when(text == "", F.raise_error(F.lit("disease_code is blank"))).otherwise(text)


def canonical_code(normalised: Column) -> Column:
    aliases = F.create_map(*[F.lit(x) for pair in POLICY_ALIASES.items() for x in pair])
    return F.coalesce(aliases[normalised], normalised)


def _override(table: dict, key: Column, name: str) -> Column:
    """The overridden value of one setting for the row's key, null when inherited."""
    position = [n for n, _type in SETTINGS].index(name)
    values = {k: row[position] for k, row in table.items() if row[position] is not None}
    lookup = F.create_map(*[F.lit(x) for pair in values.items() for x in pair])
    return lookup[key]


def alert_policies(diseases: DataFrame) -> DataFrame:
    """One policy row per disease: derived base, then profile, then code overrides."""
    risk, score = F.col("risk_level"), F.col("infection_score")
    d = diseases.select(
        F.col("id").alias("disease_id"),
        normal_code(F.col("disease_code")).alias("disease_code"),
        risk, score,
        F.coalesce("high_priority", F.lit(False)).alias("flag_priority"),
        F.coalesce("rare_disease", F.lit(False)).alias("flag_rare"),
        F.lower(F.trim(F.coalesce("policy_profile", F.lit("")))).alias("profile"),
    ).withColumns(
        {"code": canonical_code(F.col("disease_code")), "signal": infection_signal(score)}
    )
    code, profile, signal = F.col("code"), F.col("profile"), F.col("signal")
    d = d.withColumns(
        {
            "hp": F.col("flag_priority")
            | code.isin(POLICY_PRIORITY_CODES)
            | profile.isin("high_priority", "rare")
            | ((risk >= 5) & (signal >= 0.85)),
            "rd": F.col("flag_rare") | code.isin(POLICY_RARE_CODES) | (profile == "rare"),
        }
    )
    hp, rd = F.col("hp"), F.col("rd")
    floor0 = F.greatest(risk, F.lit(0)).cast("double")
    base = {
        "high_priority": hp,
        "rare_disease": rd,
        "lookback_days": F.lit(7),
        "baseline_window_days": F.lit(7),
        "radius_km": F.lit(3.0),
        "severity_weight": F.round(F.lit(1.0) + floor0 * 0.15 + signal * 0.35, 2),
        "density_weight": F.round(F.lit(1.0) + F.greatest(signal - 0.4, F.lit(0.0)) * 0.9, 2),
        "trend_weight": F.round(
            F.lit(1.0)
            + F.greatest(risk - 2, F.lit(0)).cast("double") * 0.10
            + F.when(signal >= 0.75, 0.15).otherwise(0.0),
            2,
        ),
        "rarity_weight": F.when(rd, 3.0).otherwise(1.0),
        "cluster_case_threshold": F.when(rd, 1).when(hp, 2).otherwise(3),
        "critical_case_threshold": F.when(rd, 1).when(hp, 4).otherwise(6),
    }
    return d.select(
        "disease_id", "disease_code",
        *[
            F.coalesce(
                _override(CODE_OVERRIDES, code, name),
                _override(PROFILE_OVERRIDES, profile, name),
                base[name],
            ).cast(dtype).alias(name)
            for name, dtype in SETTINGS
        ],
    )
