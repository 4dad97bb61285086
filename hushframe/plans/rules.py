"""The rule table: the first rule whose condition holds, and whose method the risk metric allows, names method and parameters."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from .features import Features


@dataclass
class Choice:
    rule: str
    method: str
    parameters: dict
    fallbacks: list[tuple[str, dict]] = field(default_factory=list)
    pipeline: list[tuple[str, dict]] = field(default_factory=list)
    trace: list[str] = field(default_factory=list)


#: Methods that a metric allows.
ALLOWED = {
    "reid95": {"kANON", "LOCSUPR", "GENERALIZE", "PRAM", "NOISE", "GENERALIZE_FIRST"},
    "k_anonymity": {"kANON", "LOCSUPR", "GENERALIZE", "GENERALIZE_FIRST"},
    "uniqueness": {"kANON", "LOCSUPR", "GENERALIZE", "GENERALIZE_FIRST"},
    "l_diversity": {"PRAM", "kANON", "LOCSUPR", "GENERALIZE", "GENERALIZE_FIRST"},
}


def sized_k(n: int, k: int) -> int:
    """k for the number of rows: 3 under 500, two less under 2 000, one notch of 10-7-5 less under 5 000."""
    if n >= 5000:
        return k
    if n < 500:
        return min(k, 3)
    if n < 2000:
        return max(3, k - 2)
    return {True: 7, False: 5 if k >= 7 else k}[k >= 10]


def clamped_k(f: Features, k: int, most: float = 0.30) -> int:
    """The largest k of (sized k, 7, 5, 3) whose estimated suppression is bearable, at least 3."""
    top = sized_k(f.n, k)
    return next((x for x in sorted({top, 7, 5, 3}, reverse=True) if x <= top and f.suppression.get(x, 0.0) <= most), 3)


def kanon(f: Features, k: int, strategy: str = "hybrid") -> tuple[str, dict]:
    return "kANON", {"k": k, "strategy": strategy}


def locsupr(k: int, **more) -> tuple[str, dict]:
    return "LOCSUPR", {"k": k, **more}


def pram(f: Features, p: float) -> tuple[str, dict]:
    return "PRAM", {"variables": top_categories(f), "p_change": p}


def noise(f: Features, magnitude: float) -> tuple[str, dict]:
    return "NOISE", {"variables": list(f.continuous), "magnitude": magnitude}


def top_categories(f: Features, most: int = 5) -> list[str]:
    """Categorical QIs in falling order of importance."""
    return sorted(f.categorical, key=lambda q: (-f.importances.get(q, 0.0), f.qis.index(q)))[:most] or f.qis[:most]


def gated(name: str, k: int, strategy: str, worse: int, better: tuple[str, dict] | None = None, limit: float = 0.25) -> Callable[[Features], Choice]:
    """kANON at k; a lower k where its suppression is too high, and another method where even that would be."""

    def choose(f: Features) -> Choice:
        low = max(3, k - 2)
        at = f.suppression.get(k, f.suppression.get(5, 0.0))
        below = f.suppression.get(low, at)
        retreat = [kanon(f, low, strategy)]
        ahead = [kanon(f, worse, "generalization"), *([better] if better else [])]
        if at <= limit:
            return Choice(name, *kanon(f, clamped_k(f, k), strategy), ahead)
        if below <= limit or not (f.cat_ratio >= 0.6 or f.continuous):
            return Choice(f"{name}_Clamped", *kanon(f, clamped_k(f, k), strategy), ahead)
        if f.cat_ratio >= 0.6:
            return Choice(f"{name}_Supp_Switch_PRAM", *pram(f, min(0.35, 0.20 + f.r95)), retreat)
        return Choice(f"{name}_Supp_Switch_LOCSUPR", *locsupr(3), retreat)

    return choose


def plain(name: str, act: Callable[[Features], tuple[str, dict]], *fallbacks: Callable[[Features], tuple[str, dict]]) -> Callable[[Features], Choice]:
    return lambda f: Choice(name, *act(f), [g(f) for g in fallbacks])


@dataclass
class Rule:
    when: Callable[[Features], bool]
    then: Callable[[Features], Choice]


def k_of(k: int, strategy: str = "hybrid"):
    return lambda f: kanon(f, k, strategy)


#: Rule names, conditions and parameters, in the order in which they are tried.
TABLE: list[Rule] = [
    Rule(lambda f: f.tier == "PUBLIC" and f.target == 0.03 and f.r95 > 0.15, plain("REG1_Regulatory_High_Risk", k_of(7), k_of(10, "generalization"))),
    Rule(lambda f: f.tier == "PUBLIC" and f.target == 0.03 and f.r95 > 0.03, plain("REG1_Regulatory_Moderate_Risk", k_of(5), k_of(7))),
    Rule(lambda f: f.n < 200 and len(f.qis) >= 2, plain("HR6_Very_Small_Dataset", lambda f: locsupr(3, max_suppressions_per_record=1), lambda f: pram(f, 0.25))),
    Rule(lambda f: len(f.qis) <= 2 and f.max_unique > 0.70 and f.r95 > 0.20, plain("SR3_Near_Unique_Few_QIs", lambda f: locsupr(3), k_of(5))),
    Rule(lambda f: bool(f.dominant) and f.r95 > 0.15 and not f.infeasible, plain("RC1_Risk_Dominated", lambda f: locsupr(5, importance_weights=dict(f.importances)), k_of(7))),
    Rule(lambda f: f.tier == "PUBLIC" and f.target != 0.03 and f.r95 > 0.20, plain("PUB1_Public_Release_High_Risk", k_of(10, "generalization"), k_of(12, "generalization"))),
    Rule(lambda f: f.tier == "PUBLIC" and f.target != 0.03 and f.r95 > 0.05, plain("PUB1_Public_Release_Moderate_Risk", k_of(7), k_of(10, "generalization"))),
    Rule(lambda f: f.tier == "SECURE" and 0.05 <= f.r95 <= 0.25 and f.utility_floor >= 0.90 and f.cat_ratio >= 0.60, plain("SEC1_Secure_Categorical", lambda f: pram(f, 0.15), k_of(3))),
    Rule(lambda f: f.tier == "SECURE" and 0.05 <= f.r95 <= 0.25 and f.utility_floor >= 0.90 and bool(f.continuous), plain("SEC1_Secure_Continuous", lambda f: noise(f, 0.10), k_of(3))),
    Rule(lambda f: f.metric == "l_diversity" and 0.15 <= f.r95 <= 0.40 and f.cat_ratio >= 0.70 and f.max_category < 0.80, plain("CAT1_Categorical_Moderate", lambda f: pram(f, 0.25), k_of(5))),
    Rule(lambda f: f.sensitive_diversity is not None and f.sensitive_diversity <= 5 and (f.least_l or 0) < 2 and not f.infeasible and (f.metric != "reid95" or f.r95 <= 0.10), plain("LDIV1_Low_Sensitive_Diversity", lambda f: pram(f, 0.25), k_of(5))),
    Rule(lambda f: len(f.dates) >= 2 and len(f.dates) / len(f.qis) >= 0.5 and f.r95 <= 0.40, plain("DATE1_Temporal_Dominant", lambda f: ("PRAM", {"variables": f.dates, "p_change": 0.25}), k_of(5))),
    Rule(lambda f: f.feasibility == "infeasible", plain("QR0_K_Anonymity_Infeasible", lambda f: ("GENERALIZE_FIRST", {"remove": max(f.cardinality, key=lambda q: f.cardinality[q])}), lambda f: ("PRAM", {"variables": f.qis[:5], "p_change": 0.25}))),
    Rule(lambda f: f.pattern == "severe_tail", plain("QR1_Severe_Tail_Risk", lambda f: locsupr(5), k_of(7))),
    Rule(lambda f: (f.pattern == "tail" or (f.r95 > 0.30 and f.r50 < 0.15)) and f.r95 > 0.40 and f.suppression.get(7, 0.0) > 0.25, plain("QR2_Heavy_Tail_Low_Suppression", lambda f: locsupr(5), k_of(7))),
    Rule(lambda f: (f.pattern == "tail" or (f.r95 > 0.30 and f.r50 < 0.15)) and f.r95 > 0.40, plain("QR2_Heavy_Tail_Risk", lambda f: kanon(f, clamped_k(f, 7)), k_of(10, "generalization"), lambda f: locsupr(5))),
    Rule(lambda f: f.pattern == "tail" or (f.r95 > 0.30 and f.r50 < 0.15), plain("QR2_Moderate_Tail_Risk", lambda f: locsupr(3), k_of(7))),
    Rule(lambda f: f.pattern == "uniform_high", gated("QR3_Uniform_High_Risk", 10, "generalization", 12, ("kANON", {"k": 7, "strategy": "hybrid"}))),
    Rule(lambda f: f.pattern == "widespread" and f.r50 > 0.15 and f.r95 > 0.50, gated("QR4_Widespread_High", 10, "generalization", 12, ("kANON", {"k": 7, "strategy": "hybrid"}))),
    Rule(lambda f: f.pattern == "widespread" and f.r50 > 0.15, gated("QR4_Widespread_Moderate", 7, "hybrid", 10, ("kANON", {"k": 5, "strategy": "hybrid"}))),
    Rule(lambda f: (f.r95 > 0.20 and f.r50 < 0.10) or f.pattern == "bimodal" or f.high_rate > 0.10, gated("MED1_Moderate_Structural", 5, "hybrid", 7, ("LOCSUPR", {"k": 3}))),
    Rule(lambda f: f.r95 <= 0.10 and f.cat_ratio >= 0.60 and not f.high_card, plain("LOW1_Categorical", lambda f: pram(f, 0.15 if f.r95 <= 0.05 else 0.20), k_of(3))),
    Rule(lambda f: f.r95 <= 0.20 and f.cat_ratio <= 0.40 and bool(f.continuous) and (f.r95 <= 0.05 or (f.outliers and f.r95 <= 0.10)), plain("LOW2_Continuous_Noise", lambda f: noise(f, 0.20 if f.outliers else 0.15), k_of(3))),
    Rule(lambda f: f.r95 <= 0.20 and f.cat_ratio <= 0.40 and bool(f.continuous), plain("LOW2_Continuous_kANON", lambda f: kanon(f, 3 if f.r95 <= 0.05 else 5, "generalization"), k_of(7))),
    Rule(lambda f: f.r95 <= 0.20 and bool(f.continuous or f.categorical), plain("LOW3_Mixed", lambda f: kanon(f, 3 if f.r95 <= 0.05 else 5, "generalization"), k_of(7))),
    Rule(lambda f: f.cat_ratio >= 0.60, plain("DEFAULT_Categorical", lambda f: pram(f, 0.20), k_of(5))),
    Rule(lambda f: bool(f.continuous) and f.cat_ratio <= 0.40, plain("DEFAULT_Continuous", lambda f: noise(f, 0.15), k_of(5))),
    Rule(lambda f: True, plain("DEFAULT_Microdata", k_of(5), k_of(3))),
]

#: Rules for tables whose risk quantiles are not known.
WITHOUT_RISK: list[Rule] = [
    Rule(lambda f: f.uniqueness > 0.20, plain("HR1_Extreme_Uniqueness", lambda f: locsupr(5))),
    Rule(lambda f: f.uniqueness > 0.10, plain("HR2_Very_High_Uniqueness", lambda f: kanon(f, clamped_k(f, 7)))),
    Rule(lambda f: f.uniqueness > 0.05 and len(f.qis) >= 2, plain("HR3_High_Uniqueness_QIs", lambda f: kanon(f, clamped_k(f, 5), "generalization"))),
    Rule(lambda f: f.n < 100, plain("HR4_Very_Small_Dataset", lambda f: pram(f, 0.3))),
    Rule(lambda f: f.n < 500 and f.uniqueness > 0.03 and bool(f.continuous), plain("HR5_Small_Dataset", lambda f: noise(f, 0.15))),
    Rule(lambda f: f.n < 500 and f.uniqueness > 0.03, plain("HR5_Small_Dataset", lambda f: pram(f, 0.25))),
]


def pipelines(f: Features) -> Choice | None:
    """Several steps where one method will not do: places, mixed risks, sparse mixed tables."""
    geo = f.geo()
    if f.r95 > 0.15 and not f.infeasible and f.cat_ratio < 0.70 and geo["fine"] and geo["coarse"]:
        return Choice("GEO1_Multi_Level_Geographic", "PIPELINE", {}, [kanon(f, 7)], [("GENERALIZE", {"columns": geo["fine"], "most": 10}), kanon(f, 5)])
    steps: list[tuple[str, dict]] = []
    if f.r95 > 0.20:
        steps.append(kanon(f, 7 if f.r95 > 0.40 else 5))
    if f.outliers and not steps:
        steps.append(noise(f, 0.15))
    if f.high_rate > 0.30 and f.suppression.get(7, 0.0) < 0.40:
        steps.append(locsupr(7))
    elif f.high_rate > 0.15:
        steps.append(locsupr(3))
    if len(steps) >= 2 and f.outliers and not f.infeasible:
        return Choice("DYN_Pipeline", "PIPELINE", {}, [kanon(f, 5)], steps)
    if f.n >= 200 and f.expected_size < 5 and f.uniqueness > 0.15 and len(f.continuous) >= 2 and len(f.categorical) >= 2:
        return Choice("P5_Sparse_Mixed", "PIPELINE", {}, [kanon(f, 5)], [noise(f, 0.15), pram(f, 0.20)])
    return None


def balance(choice: Choice, heavy: float = 0.0, light: float = 0.0) -> Choice:
    """Stronger parameters where most QIs ask for heavy treatment (from 60 %), weaker where most ask for light."""
    sign = 1 if heavy >= 0.6 else -1 if light >= 0.6 else 0
    p = choice.parameters
    for key, step in (("k", 2 if sign > 0 else 1), ("p_change", 0.05), ("magnitude", 0.05 if sign > 0 else 0.03)):
        if sign and key in p:
            p[key] = max(2 if key == "k" else 0.01, p[key] + sign * step)
    return choice


def prefer(choice: Choice, method: str | None) -> Choice:
    """The choice with a preferred method first, where it is one of its fallbacks; what it replaces becomes a fallback."""
    at = next((i for i, (m, _) in enumerate(choice.fallbacks) if m == method), None)
    if at is None or choice.method == method or choice.pipeline:
        return choice
    name, parameters = choice.fallbacks[at]
    rest = [(choice.method, choice.parameters), *choice.fallbacks[:at], *choice.fallbacks[at + 1 :]]
    return Choice(choice.rule, name, parameters, rest, [], [*choice.trace, f"preferred:{method}"])


def select(f: Features, known_risk: bool = True, preferred: str | None = None) -> Choice:
    """The choice for a table: pipelines first, then the table in order; an emergency kANON if the metric allows none.

    The trace names every rule that held, in order, also those whose method the metric does not allow. `preferred` moves a
    method forward where the chosen rule lists it as a fallback.
    """
    allowed, trace = ALLOWED[f.metric], []
    found = pipelines(f)
    if found:
        trace.append(found.rule)
        if all(m in allowed for m, _ in found.pipeline):
            found.trace = trace
            return found
    for rule in TABLE if known_risk else [*WITHOUT_RISK, TABLE[-1]]:
        if rule.when(f):
            choice = rule.then(f)
            trace.append(choice.rule)
            if choice.method in allowed:
                choice.trace = trace
                return prefer(choice, preferred if preferred in allowed else None)
    return Choice("EMERGENCY_kANON", *kanon(f, 5), trace=trace)
