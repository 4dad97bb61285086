"""Secret scans: fixed patterns, and two character Markov models compared by log-likelihood ratio."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import table, text_of

#: Kind, pattern, the group whose length counts, its least length. {16,} on hex runs and {14,} behind AKIA
#: find what the open pattern finds less the matches that are too short, as those runs are maximal.
PATTERNS = [
    ("assign", r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 1, 12),
    ("access", r"AKIA[A-Z0-9]{14,}", 0, 18),
    ("hex", r"[0-9a-f]{16,}", 0, 16),
]
KINDS = [p[0] for p in PATTERNS] + ["markov"]
#: The models' alphabet, and what a token is that they score.
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
TOKEN = r"[A-Za-z0-9+/_-]{16,}={0,2}"
#: Words that the ordinary samples are composed of.
PARTS = (
    "account address array buffer cache client column config connection content context counter current customer data default delete description document "
    "element entry error event example field file filter format function group handler header identifier image index input instance interface internal item "
    "length library license limit list manager message method model module number object option order output package parameter parser password path pattern "
    "position process property provider query reader record reference request resource response result return schema section select sequence server service "
    "session setting source start state status stream string system table target template thread token transaction update user value variable version window "
    "arbeit gesellschaft verwaltung einheit beschreibung entwicklung bezeichnung richtlinie schnittstelle verbindung leistung zeichen lichkeit rechnung "
    "gouvernement information environnement quelque entreprise connaissance developpement aujourd maintenant personne travail "
    "informacion aplicacion desarrollo nuestra empresa siempre trabajo gobierno direccion momento cuando mientras"
).split()


def labelled_samples(spark, n: int = 4000) -> DataFrame:
    """(random boolean, token): n random strings in five alphabets and n ordinary identifiers, the same at every call."""
    i = spark.range(n)
    digest = F.sha2(F.concat(F.lit("sample"), F.col("id").cast("string")), 512)
    b64 = F.base64(F.unhex(digest))
    forms = [F.substring(digest, 1, 40), F.substring(b64, 1, 44), F.translate(F.substring(b64, 3, 40), "+/", "-_"), F.upper(F.translate(F.substring(b64, 5, 32), "+/=", "")), F.translate(F.substring(b64, 7, 36), "+/=", "")]
    drawn = i.select(F.lit(True).alias("random"), F.element_at(F.array(*forms), (F.col("id") % len(forms) + 1).cast("int")).alias("token"))
    words = F.split(F.lit(" ".join(PARTS)), " ")
    part = lambda k: F.element_at(words, (F.pmod(F.xxhash64("id", F.lit(k)), F.lit(len(PARTS))) + 1).cast("int"))
    a, b, c, d = (part(k) for k in range(4))
    shapes = [F.concat_ws("_", a, b, c), F.concat(a, F.initcap(b), F.initcap(c)), F.concat(F.initcap(a), F.initcap(b), F.initcap(c)), F.concat_ws("-", a, b, c), F.concat_ws("/", a, b, c, d), F.upper(F.concat_ws("_", a, b, c)), F.concat(a, b, c)]
    usual = i.select(F.lit(False).alias("random"), F.element_at(F.array(*shapes), (F.col("id") % len(shapes) + 1).cast("int")).alias("token"))
    return drawn.unionByName(usual)


def train(samples: DataFrame) -> list[float]:
    """Log-likelihood ratios of all character pairs, random over ordinary, row by row of ALPHABET.

    First-order models with add-one smoothing. Only the pair counts, at most 2 x 67 x 67, reach the driver. Characters
    outside the alphabet break a pair; null tokens and labels are skipped; no samples give zeros.
    """
    s = samples.where("random IS NOT NULL AND token IS NOT NULL AND length(token) > 1")
    pairs = s.select("random", F.explode(F.transform(F.sequence(F.lit(1), F.length("token") - 1), lambda i: F.substring(F.col("token"), i, 2))).alias("pair"))
    n = len(ALPHABET)
    at = {c: k for k, c in enumerate(ALPHABET)}
    counts = {True: [[1] * n for _ in range(n)], False: [[1] * n for _ in range(n)]}
    for r in pairs.where(F.col("pair").rlike(r"\A[A-Za-z0-9+/_=-]{2}\z")).groupBy("random", "pair").count().collect():
        counts[r["random"]][at[r["pair"][0]]][at[r["pair"][1]]] += r["count"]
    yes, no = counts[True], counts[False]
    return [math.log(yes[a][b] / sum(yes[a])) - math.log(no[a][b] / sum(no[a])) for a in range(n) for b in range(n)]


def mean_ratio(token: Column, ratios: Column) -> Column:
    """Mean log-likelihood ratio of a token's character pairs, in one walk over its characters."""
    code = lambda c: F.call_function("instr", F.lit(ALPHABET), c) - 1
    start = F.struct(F.lit(-1).alias("before"), F.lit(0.0).alias("total"))

    def step(acc, c):
        pair = F.when(acc["before"] < 0, F.lit(0.0)).otherwise(F.get(ratios, acc["before"] * len(ALPHABET) + code(c)))
        return F.struct(code(c).alias("before"), (acc["total"] + pair).alias("total"))

    return F.aggregate(F.split(token, ""), start, step)["total"] / (F.length(token) - 1)


def _literal(values: list[float]) -> Column:
    return F.split(F.lit(",".join(f"{v:.6f}" for v in values)), ",").cast("array<double>")


def is_random(token: Column, ratios: Column, least_ratio: float, sure_length: int = 20, step: float = 0.1) -> Column:
    """Whether a token's mean ratio reaches `least_ratio`, or `step` more for each character that it lacks of `sure_length`.

    A short token's mean rests on few pairs, so it must speak the clearer.
    """
    return mean_ratio(token, ratios) >= least_ratio + step * F.greatest(F.lit(0), sure_length - F.length(token))


def secret_scan(docs: DataFrame, ratios: list[float], text: str = "text", least_ratio: float = 0.3, key: str = "doc_id", kinds=KINDS) -> DataFrame:
    """(key, spans): all secrets of each row as (start, order, kind, end), offsets in code points, end exclusive, in order.

    Kinds follow KINDS; `kinds` may leave some out. Pattern matches are leftmost and do not overlap within a kind. `markov`
    adds tokens that is_random() and that no pattern's span holds or meets. Null and empty texts have no spans; repeated rows
    repeat; extra columns are ignored. Offsets come from splitting at the matches, so the work is linear in the text for each
    pattern.
    """
    d = docs.select(key, text_of(text).alias("t"))
    scans = [(k, rx, group, least) for k, rx, group, least in [*PATTERNS, ("markov", TOKEN, 0, 0)] if k in kinds]
    names = [k for k, *_ in scans]
    d = d.select("*", *[F.split("t", rx, -1).alias(f"gaps_{k}") for k, rx, _, _ in scans])

    def hits(k, rx, group, least):
        """(token, ok) of each match; ok: the group that counts is long enough. Group 0 is so by its pattern."""
        whole = F.regexp_extract_all("t", F.lit(rx), F.lit(0))
        if group:
            found = F.zip_with(whole, F.regexp_extract_all("t", F.lit(rx), F.lit(group)), lambda h, v: F.struct(h.alias("token"), (F.length(v) >= least).alias("ok")))
        else:
            found = F.transform(whole, lambda h: F.struct(h.alias("token"), F.lit(True).alias("ok")))
        return F.when(F.size(f"gaps_{k}") > 1, found).alias(f"hit_{k}")

    d = d.select(key, *[F.transform(f"gaps_{k}", F.length).alias(f"gap_{k}") for k in names], *[hits(*s) for s in scans])
    none = F.array().cast("array<struct<start:int,kind:int,end:int,token:string>>")

    def located(k: str) -> Column:
        both = F.zip_with(F.slice(f"gap_{k}", F.lit(1), F.size(f"hit_{k}")), F.col(f"hit_{k}"), lambda g, h: F.struct(g.alias("g"), h.alias("h")))
        start = F.struct(F.lit(0).alias("at"), none.alias("out"))

        def step(acc, x):
            begin = acc["at"] + x["g"]
            end = begin + F.length(x["h"]["token"])
            span = F.struct(begin.alias("start"), F.lit(KINDS.index(k)).alias("kind"), end.alias("end"), x["h"]["token"].alias("token"))
            return F.struct(end.alias("at"), F.when(x["h"]["ok"], F.concat(acc["out"], F.array(span))).otherwise(acc["out"]).alias("out"))

        return F.coalesce(F.aggregate(both, start, step)["out"], none)

    d = d.select(key, *[located(k).alias(f"span_{k}") for k in names])
    by_model = F.col("span_markov") if "markov" in names else none
    d = d.select(key, F.concat(none, *[f"span_{k}" for k in names if k != "markov"]).alias("base"), by_model.alias("scored"))
    fresh = F.filter("scored", lambda m: ~F.exists("base", lambda b: (b["start"] < m["end"]) & (m["start"] < b["end"])))
    d = d.select(key, "base", fresh.alias("fresh"))
    added = F.filter("fresh", lambda m: is_random(m["token"], _literal(ratios), least_ratio))
    named = F.transform(F.sort_array(F.concat("base", added)), lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("order"), F.element_at(F.array(*map(F.lit, KINDS)), s["kind"] + 1).alias("kind"), s["end"].alias("end")))
    return d.select(key, named.alias("spans"))


def query(spark, sf_dir: str) -> DataFrame:
    found = secret_scan(table(spark, sf_dir, "documents").select("doc_id", "text"), train(labelled_samples(spark)))
    base = F.filter("spans", lambda s: s["kind"] != "markov")
    written = lambda xs: F.array_join(F.transform(xs, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *[count(k) for k in KINDS[:3]], F.sha2(written(base), 256).alias("base_sha256"), written(F.col("spans")).alias("spans"))
