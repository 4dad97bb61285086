"""Protection runs: one method, a pipeline, or the rule table's choice retried along schedules until the target is met."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.hierarchy import NUMERIC
from ..operators import generalize, kanon, locsupr, perturb, privacy
from ..operators.ec import require, with_row_id
from ..operators.risk import reid
from ..operators.utility import composite, is_number, paired, suppression
from .features import Features, features
from .rules import Choice, select

#: Parameter schedules by method.
SCHEDULES = {"kANON": ("k", [3, 5, 7, 10, 15, 20]), "LOCSUPR": ("k", [3, 5, 7, 10]), "PRAM": ("p_change", [0.10, 0.20, 0.30, 0.40, 0.50]), "NOISE": ("magnitude", [0.05, 0.10, 0.20, 0.30, 0.50]), "GENERALIZE": ("most", [15, 10, 5, 3])}
METHODS = list(SCHEDULES)


@dataclass
class Protected:
    df: DataFrame
    method: str
    parameters: dict
    before: float
    after: float
    utility: dict[str, float]
    suppressed: float
    target: float
    privacy_met: bool = True
    rule: str = ""
    tried: list[tuple[str, dict, float, float]] = field(default_factory=list)

    @property
    def met(self) -> bool:
        return self.after <= self.target and self.privacy_met


def run_method(df: DataFrame, qis: list[str], method: str, parameters: dict, rid: str) -> DataFrame:
    """df after one method; parameters that a method does not know are an error."""
    p = dict(parameters)
    if method == "kANON":
        return kanon.k_anonymize(df, p.pop("quasi_identifiers", qis), p.pop("k", 5), **_known(p, "strategy", "ladders", "vector", "most_suppressed")).df
    if method == "LOCSUPR":
        weights = p.pop("importance_weights", None)
        more = {"strategy": "weighted", "weights": {q: -v for q, v in weights.items()}} if weights else {}
        return locsupr.suppress_locally(df, p.pop("quasi_identifiers", qis), p.pop("k", 3), most_per_record=p.pop("max_suppressions_per_record", None), **more, **_known(p, "strategy", "weights")).df
    if method == "PRAM":
        return perturb.pram(df, p.pop("variables", [q for q in qis if not is_number(df, q)]), rid, **_known(p, "p_change", "pd_min", "method", "alpha", "seed", "matrices"))
    if method == "NOISE":
        return perturb.noise(df, p.pop("variables", [q for q in qis if is_number(df, q)]), rid, **_known(p, "magnitude", "kind", "cap", "bounds", "seed"))
    if method == "GENERALIZE":
        return generalize.generalize(df, p.pop("columns", qis), p.pop("most", 10), **_known(p, "strategy", "target", "utility", "least_utility", "limits")).df
    raise ValueError(f"unknown method {method}")


def _known(p: dict, *names: str) -> dict:
    strange = set(p) - set(names)
    if strange:
        raise ValueError(f"unknown parameters: {', '.join(sorted(strange))}")
    return p


def measure(original: DataFrame, out: DataFrame, qis: list[str], rid: str, method: str, parameters: dict, before: float, target: float, sensitive: list[str], goals: dict) -> Protected:
    after = reid(out, qis, (0.95,)).first()["reid_95"]
    numeric = [c for c in [*qis, *sensitive] if is_number(original, c) and is_number(out, c)]
    other = [c for c in dict.fromkeys([*qis, *sensitive]) if c not in numeric]
    util = composite(original, out, rid, list(dict.fromkeys(numeric)), other)
    lost = suppression(paired(original, out, rid, qis), qis).first()["records_suppressed"] or 0.0
    ok = all(all(privacy.gates(out, qis, s, goals.get("l"), goals.get("t")).values()) for s in sensitive) if goals else True
    return Protected(out, method, parameters, before, after, util, lost, target, ok)


def apply_method(df: DataFrame, qis: list[str], method: str, parameters: dict | None = None, target: float = 0.05, key: str | None = None, sensitive: list[str] | None = None, goals: dict | None = None) -> Protected:
    """One method with all its figures. key: a unique column; else rows are told apart by content."""
    require(df, qis)
    d = with_row_id(df, key)
    before = reid(d, qis, (0.95,)).first()["reid_95"]
    out = run_method(d, qis, method, parameters or {}, "_rid")
    return measure(d, out, qis, "_rid", method, parameters or {}, before, target, sensitive or [], goals or {})


def compare(df: DataFrame, qis: list[str], methods: dict[str, dict], **how) -> DataFrame:
    """(method, reid_before, reid_after, utility, suppressed, met) of several methods, best utility of those that met first."""
    got = [apply_method(df, qis, m, p, **how) for m, p in methods.items()]
    rows = sorted(((x.method, float(x.before), float(x.after), float(x.utility["score"]), float(x.suppressed), x.met) for x in got), key=lambda r: (not r[5], -r[3], r[2]))
    return df.sparkSession.createDataFrame(rows, "method string, reid_before double, reid_after double, utility double, suppressed double, met boolean")


def later(method: str, parameters: dict, f: Features) -> list[dict]:
    """The parameters to try from a choice on: its own, then the rest of the schedule, k no higher than classes can be."""
    name, steps = SCHEDULES[method]
    at = parameters.get(name)
    if at is None:
        return [parameters, *[{**parameters, name: s} for s in steps]]
    rest = [s for s in steps if (s < at if method == "GENERALIZE" else s > at)]
    if name == "k":
        rest = [s for s in rest if s <= max(3, f.n // 2)]
    return [parameters, *[{**parameters, name: s} for s in rest]]


def better(a: Protected, b: Protected | None) -> bool:
    """Meeting the target beats all, then utility among those that do and risk among those that do not."""
    if b is None:
        return True
    return (a.met, a.utility["score"] if a.met else -a.after) > (b.met, b.utility["score"] if b.met else -b.after)


def protect(df: DataFrame, qis: list[str], target: float = 0.05, key: str | None = None, sensitive: list[str] | None = None, goals: dict | None = None, least_utility: float = 0.0, most_runs: int = 8, choice: Choice | None = None, **context) -> Protected:
    """The rule table's choice, escalated along its schedule, then its fallbacks, until risk, privacy and utility are met.

    Escalation ends early where a step gains nothing (a plateau of two) or costs more utility than allowed. The best run wins.
    """
    require(df, qis)
    d = with_row_id(df, key)
    f = features(d, qis, sensitive, target=target, utility_floor=least_utility, **context)
    c = choice or select(f)
    rid, before, best, tried = "_rid", f.r95, None, []

    def attempt(method: str, p: dict, frame: DataFrame | None = None) -> Protected:
        out = run_method(d, qis, method, p, rid) if frame is None else frame
        r = measure(d, out, qis, rid, method, p, before, target, sensitive or [], goals or {})
        tried.append((method, p, r.after, r.utility["score"]))
        return r

    if c.pipeline:
        out = d
        for i, (m, p) in enumerate(c.pipeline):
            out = run_method(out, qis, m, p, rid)
            slack = 1.10 if i == 0 else 1.20
            if reid(out, qis, (0.95,)).first()["reid_95"] <= target / slack:
                break
        best = attempt("PIPELINE", {"steps": c.pipeline}, out)
    lines = [(c.method, c.parameters)] if c.method in SCHEDULES else []
    if c.method == "GENERALIZE_FIRST":
        wide = generalize.generalize(d, qis, 5, target=target).df
        best = attempt("GENERALIZE", {"most": 5}, wide)
        lines = [("kANON", {"k": 5, "strategy": "hybrid"})]
    for method, p in [*lines, *c.fallbacks]:
        if best is not None and best.met and best.utility["score"] >= least_utility:
            break
        last, flat = None, 0
        for q in later(method, p, f):
            if len(tried) >= most_runs:
                break
            r = attempt(method, q)
            if better(r, best):
                best = r
            if r.met or (r.utility["score"] < least_utility and last is not None):
                break
            flat = flat + 1 if last is not None and r.after >= last - 1e-9 else 0
            last = r.after
            if flat >= 2:
                break
    p = challenge_parameters(f, best)
    if p is not None:
        challenger = attempt("PRAM", p)
        best = challenger if wins(challenger, best) else best
    best.rule, best.tried = c.rule, tried
    return best


#: When PRAM challenges a structural method that met its target, how strongly, and what it must gain.
CHALLENGE = {"least_categories": 0.50, "most_risk": 0.30, "least_suppressed": 0.03, "least_gain": 0.03, "base": 0.15, "scale": 0.30, "most": 0.35}


def challenge_parameters(f: Features, best: Protected) -> dict | None:
    """PRAM's parameters where it may beat a suppressing method: mostly categories, bearable risk, values lost."""
    fits = best.method in ("kANON", "LOCSUPR") and best.met and f.cat_ratio >= CHALLENGE["least_categories"] and f.r95 <= CHALLENGE["most_risk"] and best.suppressed >= CHALLENGE["least_suppressed"]
    if not fits or not f.categorical:
        return None
    return {"variables": list(f.categorical), "p_change": round(min(CHALLENGE["most"], CHALLENGE["base"] + CHALLENGE["scale"] * f.r95), 2)}


def wins(challenger: Protected, best: Protected) -> bool:
    """The challenger meets the same target and gains enough utility."""
    return challenger.met and challenger.utility["score"] - best.utility["score"] >= CHALLENGE["least_gain"]


def apply_and_validate(df: DataFrame, qis: list[str], method: str, parameters: dict | None = None, **how) -> tuple[Protected, list[str]]:
    """One method, checked, and run once more with stronger parameters where the check fails: (result, what is still wrong)."""
    given = dict(parameters or {})
    first = apply_method(df, qis, method, given, **how)
    wrong = validate(first, qis)
    if not first.met:
        wrong = [*wrong, "the risk target is missed"]
    if not wrong:
        return first, []
    start = {"kANON": ("k", 5, lambda x: x + 2), "LOCSUPR": ("k", 3, lambda x: x + 2), "NOISE": ("magnitude", 0.1, lambda x: 2 * x), "PRAM": ("p_change", 0.2, lambda x: min(0.5, 2 * x)), "GENERALIZE": ("most", 10, lambda x: max(3, x // 2))}
    name, usual, stronger = start[method]
    second = apply_method(df, qis, method, {**given, name: stronger(given.get(name, usual))}, **how)
    best = second if better(second, first) else first
    return best, [*validate(best, qis), *([] if best.met else ["the risk target is missed"])]


def sdc_types(df: DataFrame) -> dict[str, str]:
    return {c: "numeric" if k in NUMERIC else "date" if k.startswith(("date", "timestamp")) else "category" for c, k in df.dtypes}


#: Goals and the method each stands for.
GOALS = {
    "k_anonymity": ("kANON", {"k": 5}), "differential_privacy": ("NOISE", {"kind": "laplace"}), "pram": ("PRAM", {"p_change": 0.2}), "microaggregation": ("NOISE", {"magnitude": 0.1}),
    "record_swapping": ("PRAM", {"p_change": 0.2}), "rank_swapping": ("NOISE", {"magnitude": 0.1}), "local_suppression": ("LOCSUPR", {"k": 3}), "perturbation": ("NOISE", {"magnitude": 0.1}),
}


def recommend(df: DataFrame, qis: list[str], goal: str | None = None, **context) -> Choice:
    """The method a goal names, else the rule table's choice."""
    if goal:
        if goal not in GOALS:
            raise ValueError(f"unknown goal {goal}")
        return Choice(f"goal:{goal}", *GOALS[goal])
    return select(features(df, qis, **context))


def validate(p: Protected, qis: list[str], k: int | None = None) -> list[str]:
    """What is wrong with a result: a kANON that is not k-anonymous, heavy suppression, weak correlation, no change."""
    from ..operators.risk import k_check

    out = []
    if p.method == "kANON":
        r = k_check(p.df, qis, k or p.parameters.get("k", 5), "as_value").first()
        if not r["is_k_anonymous"]:
            out.append(f"{r['n_violations']} classes are under k")
    if p.suppressed > 0.5:
        out.append("over half of the records lost a value")
    elif p.suppressed > 0.3:
        out.append("over 30 % of the records lost a value")
    if p.method == "NOISE" and p.utility.get("correlation", 1.0) < 0.7:
        out.append("correlations fell under .7")
    if p.method == "PRAM" and p.after == p.before and p.utility.get("information_loss", 0.0) == 0:
        out.append("nothing changed")
    return out


def anonymize(df: DataFrame, qis: list[str], tier: str = "SCIENTIFIC", **how) -> Protected:
    """protect() with the targets of an access tier: PUBLIC .05/.70, SCIENTIFIC .10/.80, SECURE .20/.90."""
    target, least = {"PUBLIC": (0.05, 0.70), "SCIENTIFIC": (0.10, 0.80), "SECURE": (0.20, 0.90)}[tier]
    return protect(df, qis, target, least_utility=least, tier=tier, **how)


def changed_cells(p: Protected, original: DataFrame, qis: list[str]) -> DataFrame:
    """(qi, changed_rate) between a table with the same row identities and the result."""
    pr = paired(original, p.df, "_rid", qis)
    return pr.agg(F.array(*[F.struct(F.lit(q).alias("qi"), F.avg((~F.col(f"o_{q}").cast("string").eqNullSafe(F.col(f"p_{q}").cast("string"))).cast("double")).alias("changed_rate")) for q in qis]).alias("a")).select(F.explode("a").alias("x")).select("x.*")
