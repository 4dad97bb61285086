"""What columns are: identifiers, quasi-identifiers, sensitive; their types; how they hang together."""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.hierarchy import NUMERIC
from .ec import ec_sizes

#: Name tokens of direct identifiers.
IDENTIFIER_TOKENS = {
    "name": "name firstname first_name lastname last_name surname fullname full_name middlename middle_name",
    "email": "email mail e_mail email_address",
    "phone": "phone telephone mobile cell fax tel",
    "address": "address street addr residence home_address work_address postal_address",
    "national_id": "ssn social_security nin national_id national_insurance passport passport_no driver_license drivers_license license_no tax_id tin vat afm amka",
    "financial": "credit_card card_number account_number iban bank_account cvv pin",
    "securities": "lei isin cusip sedol cif bic swift",
    "temporal": "timestamp datetime",
    "medical_id": "medical_record health_id patient_id mrn medical_record_number health_record",
    "other_identifier": "id uuid guid record_id row_id key index_id unique_id identifier",
}
#: Patterns of identifying values.
IDENTIFIER_PATTERNS = {
    "email": r"^[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}$",
    "phone": r"^(?:\+[0-9]{1,4}[\s-]?|[(][0-9]{1,4}[)][\s-]?)[0-9][-\s\./0-9]{6,}$|^[0-9]{10,}$",
    "credit_card": r"^[0-9]{13,19}$",
    "ssn_us": r"^\d{3}-\d{2}-\d{4}$",
    "iban": r"^[A-Z]{2}[0-9]{2}[A-Z0-9]{4,}$",
}
#: Name scores of quasi-identifiers, definite, probable and possible.
QI_NAMES = {
    "age": 1.00, "gender": 1.00, "sex": 1.00, "zipcode": 1.00, "zip": 1.00, "postal": 1.00, "postcode": 1.00, "race": 1.00, "ethnicity": 1.00, "ethnic": 1.00, "occupation": 0.95, "job": 0.90,
    "profession": 0.95, "city": 0.95, "town": 0.90, "county": 0.95, "state": 0.90, "province": 0.90, "region": 0.90, "country": 0.85, "nationality": 0.90, "marital": 0.95, "education": 0.95,
    "birthdate": 1.00, "dob": 1.00, "birth_date": 1.00, "birth_year": 0.95, "birth_month": 0.90,
    "year": 0.70, "month": 0.65, "date": 0.60, "income": 0.75, "salary": 0.75, "wage": 0.70, "religion": 0.80, "language": 0.70, "height": 0.65, "weight": 0.65, "diagnosis": 0.80, "icd": 0.75,
    "department": 0.60, "unit": 0.55, "ward": 0.60, "specialty": 0.60, "employer": 0.70, "company": 0.65, "organization": 0.60,
    "type": 0.40, "category": 0.45, "group": 0.40, "class": 0.45, "level": 0.40, "status": 0.50, "code": 0.35, "flag": 0.30,
}
#: Name parts of sensitive attributes.
SENSITIVE_NAMES = "income salary wage disease diagnosis illness health religion political orientation criminal conviction debt balance score grade treatment medication hiv".split()


def tokens(name: str) -> list[str]:
    return [t for t in re.split(r"[^a-z0-9]+|(?<=[a-z])(?=[A-Z])", re.sub(r"(?<=[a-z])(?=[A-Z])", "_", name).lower()) if t]


def identifier_by_name(name: str) -> str | None:
    """The kind whose token the name holds as whole words."""
    parts = tokens(name)
    for kind, words in IDENTIFIER_TOKENS.items():
        for w in words.split():
            need = w.split("_")
            if any(parts[i : i + len(need)] == need for i in range(len(parts) - len(need) + 1)):
                return kind
    return None


def pattern_rates(df: DataFrame, columns: list[str], patterns: dict[str, str] = IDENTIFIER_PATTERNS) -> DataFrame:
    """(column, pattern, rate): share of non-null values that match, over all rows, in one aggregate."""
    parts = [F.struct(F.lit(c).alias("column"), F.lit(k).alias("pattern"), F.coalesce(F.avg(F.col(c).cast("string").rlike(p).cast("double")), F.lit(0.0)).alias("rate")) for c in columns for k, p in patterns.items()]
    return df.agg(F.array(*parts).alias("a")).select(F.explode("a").alias("x")).select("x.*")


def direct_identifiers(df: DataFrame, least_rate: float = 0.5) -> dict[str, str]:
    """Columns that identify by name, else by over half of their values."""
    named = {c: k for c in df.columns if (k := identifier_by_name(c))}
    rest = [c for c, t in df.dtypes if c not in named and t == "string"]
    if rest:
        for r in pattern_rates(df, rest).where(F.col("rate") > least_rate).orderBy(F.desc("rate"), "pattern").collect():
            named.setdefault(r["column"], r["pattern"])
    return named


@dataclass
class Column:
    name: str
    kind: str
    distinct: int
    nulls: float
    ratio: float
    low: float | None = None
    high: float | None = None


def profile(df: DataFrame) -> dict[str, Column]:
    """Counts of all columns in one aggregate, and their coarse type: binary, identifier, continuous, date, categorical."""
    plain = [(c, t) for c, t in df.dtypes if not t.startswith(("array", "map", "struct", "binary"))]
    number = lambda t: t in NUMERIC or t.startswith("decimal")
    aggs = [F.count("*").alias("n")]
    for i, (c, t) in enumerate(plain):
        aggs += [F.count_distinct(c).alias(f"d{i}"), F.count(c).alias(f"c{i}")]
        if number(t):
            aggs += [F.min(c).cast("double").alias(f"l{i}"), F.max(c).cast("double").alias(f"h{i}")]
    r = df.agg(*aggs).first()
    out = {}
    for i, (c, t) in enumerate(plain):
        d, n = r[f"d{i}"], r[f"c{i}"]
        ratio = d / n if n else 0.0
        if d == 2:
            kind = "binary"
        elif t.startswith(("date", "timestamp")):
            kind = "date"
        elif identifier_by_name(c) and ratio > 0.95 or (ratio > 0.95 and n > 20 and not t.startswith(("double", "float"))):
            kind = "identifier"
        elif number(t) and d > 20:
            kind = "continuous"
        else:
            kind = "categorical"
        out[c] = Column(c, kind, d, 1 - n / r["n"] if r["n"] else 0.0, ratio, r[f"l{i}"] if number(t) else None, r[f"h{i}"] if number(t) else None)
    return out


def is_sequential(df: DataFrame, column: str) -> bool:
    """Whole numbers without repeats that cover at least 80 % of their range."""
    if dict(df.dtypes)[column] not in ("tinyint", "smallint", "int", "bigint"):
        return False
    r = df.agg(F.count(column).alias("n"), F.count_distinct(column).alias("d"), F.min(column).alias("lo"), F.max(column).alias("hi")).first()
    return bool(r["n"] > 1 and r["d"] == r["n"] and r["d"] / (r["hi"] - r["lo"] + 1) >= 0.8)


def name_score(name: str) -> float:
    parts = tokens(name)
    return max((s for w, s in QI_NAMES.items() if w in parts or w == "_".join(parts)), default=0.0)


def type_score(c: Column) -> float:
    """How much a column's values look like a quasi-identifier's."""
    if c.kind == "identifier" or c.distinct <= 1:
        return 0.0
    if c.kind == "binary":
        return 0.70
    if c.kind == "date":
        return 0.70
    if c.low is not None and 0 <= c.low <= 18 and 50 <= (c.high or 0) <= 120:
        return 0.85
    if c.low is not None and 1900 <= c.low and (c.high or 0) <= 2100:
        return 0.70
    if c.distinct <= 10:
        return 0.90
    if c.distinct <= 50:
        return 0.75
    return 0.40 if c.kind == "continuous" else 0.50


#: Rise of the singleton rate and the score it gives.
CONTRIBUTION = [(0.25, 1.0), (0.15, 0.85), (0.08, 0.70), (0.03, 0.50), (0.01, 0.35)]


def contribution(df: DataFrame, column: str, others: list[str]) -> float:
    """Score of how much a column raises the share of unique records among up to four others."""
    base = others[:4]
    rate = lambda cols: (lambda r: r["u"] / r["n"] if r["n"] else 0.0)(ec_sizes(df, cols, "as_value").agg(F.count_if(F.col("n") == 1).alias("u"), F.sum("n").alias("n")).first()) if cols else 0.0
    gain = rate([*base, column]) - rate(base)
    return next((s for least, s in CONTRIBUTION if gain > least), 0.20)


def qi_scores(df: DataFrame, profiled: dict[str, Column] | None = None) -> dict[str, float]:
    """0.2 name + 0.4 type + 0.4 contribution, times 1.2 for definite names, at most 1; identifiers have none."""
    prof = profiled or profile(df)
    ids = direct_identifiers(df)
    rest = [c for c in prof if c not in ids and prof[c].kind != "identifier" and prof[c].distinct > 1]
    pool = sorted(rest, key=lambda c: (-name_score(c), prof[c].distinct, c))
    out = dict.fromkeys(prof, 0.0)
    for c in rest:
        n = name_score(c)
        s = 0.2 * n + 0.4 * type_score(prof[c]) + 0.4 * contribution(df, c, [x for x in pool if x != c])
        out[c] = min(1.0, s * (1.2 if n >= 0.85 else 1.0) * (0.9 if prof[c].kind == "continuous" else 1.0))
    return out


def simple_qis(df: DataFrame, most: int = 5) -> list[str]:
    """Up to `most` likely quasi-identifiers by name (3) and by few values (2 up to 20, 1 up to 50), best first, ties in table order.

    Names count where they are definite or probable ones; identifiers are never among them.
    """
    scores = {}
    for c, p in profile(df).items():
        if p.kind != "identifier":
            few = p.kind in ("categorical", "binary") and p.distinct >= 2
            scores[c] = (3 if name_score(c) >= 0.55 else 0) + (0 if not few else 2 if p.distinct <= 20 else 1 if p.distinct <= 50 else 0)
    return sorted([c for c, s in scores.items() if s], key=lambda c: -scores[c])[:most]


#: Most values of a quasi-identifier and most quasi-identifiers, by access tier.
TIER_LIMITS = {"PUBLIC": (50, 5), "SCIENTIFIC": (100, 6), "SECURE": (200, 8)}
#: Name parts whose values form a hierarchy.
HIERARCHIC = ["municipality", "postal", "occupation", "code"]


def handling(df: DataFrame, tier: str = "SCIENTIFIC") -> DataFrame:
    """(column, role, distinct, strategy): what each column is, and how a quasi-identifier of too many values for its tier is cut.

    Roles: direct_identifier (by name or over 90 % distinct values), sensitive (by name), quasi_identifier (by name, or 2 to 100
    values), safe (one value, or a number of more), else unassigned. Strategies: hierarchy, binning, top_k, else null.
    """
    limit, kinds = TIER_LIMITS[tier][0], dict(df.dtypes)
    rows = []
    for c, p in profile(df).items():
        number, strategy = kinds[c] in NUMERIC or kinds[c].startswith("decimal"), None
        if identifier_by_name(c) or p.ratio > 0.9:
            role = "direct_identifier"
        elif any(w in SENSITIVE_NAMES for w in tokens(c)):
            role = "sensitive"
        elif name_score(c) >= 0.55 or 2 <= p.distinct <= 100:
            role = "quasi_identifier"
            if p.distinct > limit:
                strategy = "hierarchy" if any(w in HIERARCHIC for w in tokens(c)) else "binning" if number else "top_k"
        else:
            role = "safe" if p.distinct < 2 or number else "unassigned"
        rows.append((c, role, p.distinct, strategy))
    return df.sparkSession.createDataFrame(rows, "column string, role string, distinct long, strategy string")


def sensitive_score(c: Column) -> float:
    named = any(w in SENSITIVE_NAMES for w in tokens(c.name))
    return (0.6 if named else 0.0) + (0.2 if c.kind in ("continuous", "categorical") and c.distinct > 2 else 0.0) + (0.1 if c.kind == "continuous" else 0.0)


def classify(df: DataFrame) -> DataFrame:
    """(column, type, role, qi_score, sensitive_score): roles identifier, quasi_identifier, sensitive, unassigned.

    Near-constant columns (95 % one value) and near-unique ones stay unassigned or identify; QIs need .35, sensitive .20.
    QIs are dropped, largest cardinality first, while the product of cardinalities exceeds 3/5 of the rows.
    """
    prof, ids = profile(df), direct_identifiers(df)
    scores = qi_scores(df, prof)
    role = {}
    for c, p in prof.items():
        if c in ids or p.kind == "identifier":
            role[c] = "identifier"
        elif p.distinct <= 1 or (p.ratio > 0.5 and p.kind not in ("continuous", "date")):
            role[c] = "unassigned"
        elif sensitive_score(p) >= 0.6:
            role[c] = "sensitive"
        elif scores[c] >= 0.35:
            role[c] = "quasi_identifier"
        else:
            role[c] = "sensitive" if sensitive_score(p) >= 0.20 else "unassigned"
    qis = [c for c, r in role.items() if r == "quasi_identifier"]
    n = df.count()
    while len(qis) > 2 and math.prod(prof[q].distinct for q in qis) * 5 > 3 * n:
        worst = max(qis, key=lambda q: (prof[q].distinct, q))
        qis.remove(worst)
        role[worst] = "sensitive" if sensitive_score(prof[worst]) >= 0.2 else "unassigned"
    rows = [(c, p.kind, role[c], round(scores[c], 6), round(sensitive_score(p), 6)) for c, p in prof.items()]
    return df.sparkSession.createDataFrame(rows, "column string, type string, role string, qi_score double, sensitive_score double")


def dependencies(df: DataFrame, columns: list[str], least: float = 0.95) -> DataFrame:
    """(determinant, dependent, share): share of the determinant's values with one dependent value, where it reaches `least`."""
    out = []
    for a in columns:
        pairs = df.where(F.col(a).isNotNull()).groupBy(a).agg(*[F.count_distinct(b).alias(b) for b in columns if b != a])
        r = pairs.agg(*[F.avg((F.col(b) <= 1).cast("double")).alias(b) for b in columns if b != a]).first()
        out += [(a, b, float(r[b])) for b in columns if b != a and r[b] is not None and r[b] >= least]
    return df.sparkSession.createDataFrame(out, "determinant string, dependent string, share double")


def correlated(df: DataFrame, columns: list[str], least: float = 0.95) -> DataFrame:
    """(a, b, r) of numeric columns whose correlation exceeds `least` in size."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    r = df.agg(*[F.corr(F.col(a).cast("double"), F.col(b).cast("double")).alias(f"r{i}") for i, (a, b) in enumerate(pairs)]).first() if pairs else []
    rows = [(a, b, float(x)) for (a, b), x in zip(pairs, r) if x is not None and not math.isnan(x) and abs(x) > least]
    return df.sparkSession.createDataFrame(rows, "a string, b string, r double")


def is_frequency_table(df: DataFrame) -> bool:
    """All numeric columns whole, not negative and under 10 000."""
    nums = [c for c, t in df.dtypes if t in NUMERIC]
    if not nums:
        return False
    r = df.agg(*[F.min((F.col(c).cast("double") == F.floor(c)) & (F.col(c) >= 0) & (F.col(c) < 10_000)).alias(c) for c in nums]).first()
    return all(bool(r[c]) for c in nums)
