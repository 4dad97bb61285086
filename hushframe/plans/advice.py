"""Advice before and after a run: targets by context, parameters by data, warnings, guarded merges of outside advice."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import detect, generalize
from ..operators.ec import ec_sizes
from ..operators.perturb import shares_of
from .features import Features

#: Targets by context.
CONTEXTS = {
    "public_release": dict(k_min=10, reid_95_max=0.01, reid_99_max=0.03, uniqueness_max=0.01, info_loss_max=0.15, suppression_max=0.10, l_min=3, t_max=0.15, priority="privacy"),
    "scientific_use": dict(k_min=5, reid_95_max=0.05, reid_99_max=0.10, uniqueness_max=0.05, info_loss_max=0.10, suppression_max=0.15, l_min=2, t_max=0.25, priority="utility"),
    "secure_environment": dict(k_min=3, reid_95_max=0.10, reid_99_max=0.20, uniqueness_max=0.10, info_loss_max=0.08, suppression_max=0.20, l_min=2, t_max=0.30, priority="utility"),
    "regulatory_compliance": dict(k_min=5, reid_95_max=0.03, reid_99_max=0.05, uniqueness_max=0.03, info_loss_max=0.12, suppression_max=0.12, l_min=3, t_max=0.20, priority="privacy"),
    "default": dict(k_min=5, reid_95_max=0.05, reid_99_max=0.10, uniqueness_max=0.05, info_loss_max=0.12, suppression_max=0.15, l_min=2, t_max=0.25, priority="balanced"),
}
TIER_OF = {"public_release": "PUBLIC", "regulatory_compliance": "PUBLIC", "secure_environment": "SECURE"}
#: Weight of a treatment on limits and parameters, and its order of generalization.
TREATMENT = {"Heavy": 1.5, "Standard": 1.0, "Light": 0.5}
#: Greek identifiers with the share of values that must match, and their names.
GREEK_PATTERNS = {"afm": (r"^\d{9}$", 0.80), "amka": (r"^\d{11}$", 0.80), "adt": (r"^[Α-ΩA-Z]{1,2}\s?\d{6}$", 0.70), "iban_gr": (r"^GR\d{25}$", 0.80), "vat_gr": (r"^EL\d{9}$", 0.80)}
GREEK_NAMES = {"afm": "αφμ afm tin tax_id taxid vat_number", "amka": "αμκα amka ssn social_security insurance_number", "adt": "αδτ adt id_card identity ταυτοτητα tautotita", "iban": "iban bank_account τραπεζικός"}


def context(name: str = "default") -> dict:
    if name not in CONTEXTS:
        raise ValueError(f"unknown context {name}")
    return {**CONTEXTS[name], "tier": TIER_OF.get(name, "SCIENTIFIC")}


def greek_identifiers(df: DataFrame) -> dict[str, str]:
    """Columns that a Greek identifier names, else that enough of their values look like; over all rows, in one aggregate."""
    out = {}
    for c in df.columns:
        flat = c.lower().replace(" ", "_").replace("-", "_")
        kind = next((k for k, names in GREEK_NAMES.items() if flat in names.split() or set(flat.split("_")) & set(names.split())), None)
        if kind:
            out[c] = kind
    rest = [c for c, t in df.dtypes if t == "string" and c not in out]
    if rest:
        need = {k: share for k, (_, share) in GREEK_PATTERNS.items()}
        for r in detect.pattern_rates(df, rest, {k: p for k, (p, _) in GREEK_PATTERNS.items()}).collect():
            if r["rate"] >= need[r["pattern"]]:
                out.setdefault(r["column"], r["pattern"])
    return out


@dataclass
class Advice:
    method: str
    parameters: dict
    figures: dict[str, float] = field(default_factory=dict)
    warnings: list[str] = field(default_factory=list)
    switch: str | None = None


def kanon_advice(df: DataFrame, qis: list[str], k: int, treatment: dict[str, str] | None = None) -> Advice:
    """First k, strategy and order of generalization from the classes that k would break."""
    r = ec_sizes(df, qis, "as_value").agg(
        F.count("*").alias("groups"), F.coalesce(F.avg((F.col("n") < k).cast("double")), F.lit(0.0)).alias("below"), F.coalesce(F.min("n"), F.lit(0)).alias("least"),
        F.coalesce(F.sum(F.when(F.col("n") < k, F.col("n"))) / F.sum("n"), F.lit(0.0)).alias("lost"),
    ).first()
    near = r["below"] < 0.05 or r["least"] >= k - 2
    first = k if near else max(3, r["least"]) if r["below"] > 0.50 else max(3, k - 2)
    strategy = "suppression" if r["below"] < 0.10 else "hybrid" if r["below"] < 0.40 else "generalization"
    order = sorted(qis, key=lambda q: (-TREATMENT[(treatment or {}).get(q, "Standard")], qis.index(q)))
    out = Advice("kANON", {"k": first, "strategy": strategy}, {"classes_below": r["below"], "suppression": r["lost"]})
    out.parameters["quasi_identifiers"] = order
    if r["lost"] > 0.15:
        out.warnings.append(f"about {r['lost']:.0%} of the records would be suppressed")
    out.switch = "PRAM" if r["lost"] > 0.25 else None
    return out


def pram_advice(df: DataFrame, columns: list[str], p_change: float = 0.2) -> Advice:
    """Lower change where one category dominates (over 80 %), no columns of a single category."""
    shares = {c: shares_of(df, c) for c in columns}
    used = [c for c in columns if len(shares[c]) > 1]
    top = max((max(shares[c].values()) for c in used), default=0.0)
    out = Advice("PRAM", {"variables": used, "p_change": p_change if top <= 0.8 else p_change / 2}, {"largest_share": top})
    out.warnings = [f"{c} has one category" for c in columns if c not in used] + ([f"a category holds {top:.0%} of the records"] if top > 0.8 else [])
    return out


def noise_advice(df: DataFrame, columns: list[str], magnitude: float = 0.1) -> Advice:
    """Laplace noise where a column is heavy-tailed (|skewness| over 2), and values held inside their range."""
    from ..functions.hierarchy import skewness

    skew = {c: skewness(df, c) for c in columns}
    r = df.agg(*[F.struct(F.min(c).cast("double").alias("lo"), F.max(c).cast("double").alias("hi")).alias(c) for c in columns]).first()
    bounds = {c: (r[c]["lo"], r[c]["hi"]) for c in columns if r[c]["lo"] is not None}
    kind = "laplace" if any(abs(v) > 2 for v in skew.values()) else "gaussian"
    return Advice("NOISE", {"variables": columns, "magnitude": magnitude, "kind": kind, "bounds": bounds}, {f"skewness_{c}": v for c, v in skew.items()})


def locsupr_advice(df: DataFrame, qis: list[str], k: int, importances: dict[str, float] | None = None) -> Advice:
    """Weights that let important QIs give way first; a smaller k where over 30 % of the records violate."""
    lost = kanon_advice(df, qis, k).figures["suppression"]
    p: dict = {"k": 3 if lost > 0.30 else k}
    if importances:
        p["importance_weights"] = importances
    return Advice("LOCSUPR", p, {"suppression": lost}, [f"{lost:.0%} of the records violate k={k}"] if lost > 0.30 else [])


def warnings(df: DataFrame, qis: list[str]) -> list[str]:
    """What in a table will make protection hard: nulls, constants, near-unique or skewed QIs, few rows, wide spaces."""
    from ..functions.hierarchy import skewness

    prof, n, out = detect.profile(df), df.count(), []
    for q in qis:
        p = prof[q]
        out += [f"{q} is null in {p.nulls:.0%} of the rows"] if p.nulls > 0.2 else []
        out += [f"{q} has one value"] if p.distinct <= 1 else []
        out += [f"{q} is nearly unique"] if p.ratio > 0.9 and n > 20 else []
        out += [f"{q} is skewed"] if p.kind == "continuous" and abs(skewness(df, q)) > 2 else []
    space = 1
    for q in qis:
        space *= max(1, prof[q].distinct)
    out += [f"{n} rows are few"] if n < 200 else []
    out += [f"{space} combinations for {n} rows"] if space > n else []
    return out


#: Parameters that outside advice may raise but never lower, with their bounds.
GUARDED = {"k": (2, 50), "p_change": (0.01, 0.5), "magnitude": (0.01, 1.0)}


def merge_advice(own: dict, other: dict) -> dict:
    """Own parameters with another's taken over; guarded ones are clamped to their bounds and never fall."""
    out = dict(own)
    for name, value in other.items():
        if name in GUARDED:
            low, high = GUARDED[name]
            value = min(max(value, low), high)
            out[name] = max(value, own[name]) if name in own else value
        elif name in own:
            out[name] = value
    return out


def step_down(df: DataFrame, qis: list[str], k: int, target: float) -> int:
    """The least k on the schedule 3, 5, 7, 10 up to k that still meets the target if classes under it were suppressed."""
    sizes = ec_sizes(df, qis, "as_value")
    for smaller in [s for s in (3, 5, 7, 10) if s < k]:
        r = sizes.where(F.col("n") >= smaller).agg(F.percentile(F.lit(1.0) / F.col("n"), F.lit(0.95), F.col("n"))).first()[0]
        if r is not None and r <= target:
            return smaller
    return k


def recommendations(f: Features) -> list[str]:
    """Plain advice from the features."""
    out = []
    if f.infeasible:
        worst = max(f.cardinality, key=lambda q: (f.cardinality[q], q))
        out.append(f"generalize or remove {worst} ({f.cardinality[worst]} values) before asking for k-anonymity")
    if f.dominant:
        out.append(f"{f.dominant} carries most of the risk")
    if f.n < 500:
        out.append("consider synthetic data for so few rows")
    if f.least_l is not None and f.least_l < 2:
        out.append("some classes show one sensitive value only")
    if f.skewed:
        out.append(f"code the tails of {', '.join(f.skewed)}")
    return out


def smart_limits(df: DataFrame, qis: list[str], treatment: dict[str, str], most: int = 10) -> dict[str, int]:
    """Category limits by treatment: heavy ones keep fewer values."""
    card = generalize.cardinalities(df, qis)
    return {q: max(3, round(most / TREATMENT[treatment.get(q, "Standard")])) for q in qis if card[q] > 3}


def semantic_label(c: detect.Column, kind: str) -> str:
    """A label like `Integer — Continuous (120 values)` of a profiled column and its Spark type."""
    store = "Date" if kind.startswith(("date", "timestamp")) else "Boolean" if kind == "boolean" else "Float" if kind in ("float", "double") or kind.startswith("decimal") else "Integer" if kind in ("tinyint", "smallint", "int", "bigint") else "Character"
    what = {"binary": "Binary", "identifier": "Identifier", "continuous": "Continuous", "date": "Temporal"}.get(c.kind, "Ordinal" if store == "Integer" else "Categorical")
    return f"{store} — {what} ({c.distinct} values)"
