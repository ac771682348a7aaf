"""Operator 1, secret scans: two character Markov models and their likelihood ratio, in DataFrame functions only.

The base kinds (assign, access, hex) have exact rules and are always kept. Every
other run of 20 or more token characters is a candidate (kind ``random``): two
first-order Markov models over its characters, one of random strings and one of
ordinary identifiers, give a mean log-likelihood ratio a character, and runs of
eight or more different characters above the threshold are added unless they
overlap a base span. The models are counts
of neighbouring characters in three quarters of the labelled samples; the
threshold is the score that all but a thousandth of the other ordinary samples
stay under. Identifiers of the form of a UUID name things and are no candidates.

Positions are code points. Spark has no function for the places of all matches,
so they are summed up from the lengths of matches and of the pieces between.

Defined results: a null text counts as empty; very long texts are read whole;
repeated rows give equal results; an empty table gives no row; other columns,
whatever their names, are not read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed formats of the base kinds.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = "AKIA[A-Z0-9]{14,}"
HEX = "[0-9a-f]{16,}"
UUID = "^[0-9A-Fa-f]{8}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{12}$"
RUN = "(?<![A-Za-z0-9_+/-])[A-Za-z0-9_+/-]{20,}"
KINDS = ("assign", "access", "hex", "random")

# Words of ordinary identifiers, the material of the labelled samples.
WORDS = (
    "account action active address admin agent alert amount answer array article asset author average backup balance base batch before begin block body border branch bucket buffer build button cache call cancel card category cell change channel char check child class clean client close code color column command comment "
    "common compare complete config confirm connect console content context control copy count country create current customer data date default delete depth detail device direct display document domain download draft driver edit email empty enable end entry error event example export failed field file filter final find first "
    "flag folder footer format forward frame from function general get global graph group handler header height hidden history home host hour image import index info initial input insert install instance internal invoice item join json keep label language last layer length level library limit line link list load local location lock "
    "login long main make manager map mark master match maximum member memory menu merge message method minimum minute mode model module month move name network next node note number object offset online open option order origin output owner package page panel parent part path pattern payment period person phone picture place plan "
    "point policy port position post preview previous price print private process product profile project property public query queue range rate ratio read ready record region release remote remove render repeat replace report request reset resource response result return role root route row rule save scale schedule schema scope "
    "score screen script search second section select sender sequence server service session setting share shift show side sign simple single size sort source space stage start state static status step stock stop store stream string style submit summary switch system table target task team template test text thread time title toggle "
    "total track transfer tree trigger type unique unit update upload user util valid value variable vector version view visible visit wait warning week weight width window word work worker write year zone and the for with that this from have not are was were which their there when what about would these other into than them some "
    "information international representation characteristic administration understanding communication transformation usr lib bin etc opt var src gnu linux std local include python java http https www org com net dev amd arm x86 64bit config yaml json html css js "
    "der die das und nicht ist von mit sich auf eine werden auch nach les des une dans est pour que qui sur avec plus los las por con para una como pero este entre"
).split()
LOW, WIDE = 45, 78  # of the character codes from - to z


def folded(s: Column) -> Column:
    """Digits and marks as one character each: the models tell letters apart, not figures."""
    return F.translate(s, "123456789+/_=.", "000000000-----")


def pairs(s: Column) -> Column:
    """Indexes of the neighbouring characters of a run."""
    chars = F.transform(F.regexp_extract_all(folded(s), F.lit("."), F.lit(0)), lambda c: F.ascii(c) - LOW)
    n = F.size(chars) - 1
    return F.when(n > 0, F.zip_with(F.slice(chars, F.lit(1), n), F.slice(chars, F.lit(2), n), lambda a, b: a * WIDE + b)).otherwise(F.array().cast("array<int>"))


def labelled_samples(spark: SparkSession, n: int = 6000, seed: int = 7) -> DataFrame:
    """n random strings (label 1) and n ordinary identifiers (label 0), made by hash of a counter."""
    h = lambda k: F.pmod(F.xxhash64("id", F.lit(seed), F.lit(k)), F.lit(1 << 20))
    digest = F.sha2(F.concat_ws(":", F.lit(seed), "id"), 256)
    secret = F.when(h(0) % 5 == 0, digest).otherwise(F.regexp_replace(F.base64(F.unhex(digest)), "=", ""))
    secret = F.substring(F.when(h(0) % 5 == 1, F.translate(secret, "+/", "-_")).when(h(0) % 5 == 2, F.regexp_replace(secret, "[+/]", "")).otherwise(secret), F.lit(1), (20 + h(1) % 44).cast("int"))
    words = F.array(*map(F.lit, WORDS))
    word = lambda k: F.element_at(words, (h(10 + k) % len(WORDS) + 1).cast("int"))
    some = F.slice(F.array(*(word(k) for k in range(9))), F.lit(1), (3 + h(2) % 7).cast("int"))
    joint = F.element_at(F.array(*map(F.lit, ("_", "-", "/", "", "."))), (h(3) % 5 + 1).cast("int"))
    cased = F.when(h(4) % 4 == 0, F.transform(some, F.initcap)).when(h(4) % 8 == 1, F.transform(some, F.upper)).otherwise(some)
    ordinary = F.concat(F.concat_ws("", F.transform(cased, lambda w: F.concat(w, joint))), F.when(h(5) % 3 == 0, (h(6) % 2000).cast("string")).otherwise(""))
    rows = spark.range(n)
    return rows.select(secret.alias("text"), F.lit(1).alias("label")).unionAll(rows.select(ordinary.alias("text"), F.lit(0).alias("label")))


class Markov:
    """Log-likelihood ratios by pair of characters, and the threshold of their mean."""

    def __init__(self, ratios: list[float], limit: float):
        self.ratios, self.limit = ratios, limit

    def score(self, s: Column) -> Column:
        table = F.split(F.lit(",".join(f"{x:.3f}" for x in self.ratios)), ",").cast("array<double>")
        p = pairs(s)
        return F.aggregate(p, F.lit(0.0), lambda total, i: total + F.element_at(table, i + 1)) / F.greatest(F.size(p), F.lit(1))


def fit(samples: DataFrame) -> Markov:
    """Count pairs in labelled samples (text, label); the counts are at most two for each pair of characters."""
    whole = samples.filter("text IS NOT NULL AND label IS NOT NULL").select("text", "label", (F.pmod(F.xxhash64("text"), F.lit(4)) == 0).alias("held"))
    rows = whole.filter("NOT held").select("label", F.explode(pairs(F.regexp_replace("text", "[^A-Za-z0-9_+/=.-]", ""))).alias("pair")).groupBy("label", "pair").count().collect()
    counts = [[0.0] * (WIDE * WIDE) for _ in range(2)]
    used = sorted({i for r in rows for i in divmod(r["pair"], WIDE)})
    for r in rows:
        counts[int(r["label"] > 0)][r["pair"]] += r["count"]
    logs = []
    for c in counts:
        out = [0.0] * (WIDE * WIDE)
        for a in used:
            total = sum(c[a * WIDE + b] for b in used) + 0.5 * len(used)
            for b in used:
                out[a * WIDE + b] = math.log((c[a * WIDE + b] + 0.5) / total)
        logs.append(out)
    model = Markov([r - o for o, r in zip(*logs, strict=True)], 0.0)
    limit = whole.filter("label = 0 AND held").agg(F.percentile(model.score(F.col("text")), F.lit(0.999))).first()[0]
    model.limit = max(0.3, limit or 0.0)
    return model


def places(text: Column, pattern: str, kind: int, keep=None) -> Column:
    """Array of (start, kind, end) of all matches of a pattern; ``keep`` tells which, of all matches, stay."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,kind:int,end:int>>").alias("out"))
    step = lambda acc, x: F.struct(
        (acc["at"] + F.length(x["g"]) + F.length(x["m"])).alias("at"),
        F.concat(acc["out"], F.array(F.struct((acc["at"] + F.length(x["g"])).alias("start"), F.lit(kind).alias("kind"), (acc["at"] + F.length(x["g"]) + F.length(x["m"])).alias("end")))).alias("out"),
    )
    zipped = F.zip_with(found, F.slice(gaps, F.lit(1), F.size(found)), lambda m, g: F.struct(m.alias("m"), g.alias("g")))
    all_ = F.aggregate(zipped, start, step, lambda acc: acc["out"])
    if keep is not None:
        both = F.filter(F.zip_with(all_, keep, lambda p, k: F.struct(p.alias("p"), k.alias("k"))), lambda x: x["k"])
        return F.transform(both, lambda x: x["p"])
    return all_


def written(spans: Column) -> Column:
    """kind:start:end of each span by start and kind, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(F.array_sort(spans), lambda x: F.concat_ws(":", F.element_at(names, x["kind"] + 1), x["start"], x["end"])), ",")


def scan(docs: DataFrame, model: Markov, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (key, n_assign, n_access, n_hex, n_random, base_sha256, spans) of every document."""
    none = F.array().cast("array<struct<start:int,kind:int,end:int>>")
    t = F.col("_t")
    assign = F.when(t.rlike("(?i)passw|secret|token|api_?key"), places(t, ASSIGN, 0, F.transform(F.regexp_extract_all(t, F.lit(ASSIGN), F.lit(2)), lambda v: F.length(v) >= 12))).otherwise(none)
    access = F.when(t.contains("AKIA"), places(t, ACCESS, 1)).otherwise(none)
    hexes = F.when(t.rlike(HEX), places(t, HEX, 2)).otherwise(none)
    likely = F.transform(F.regexp_extract_all(t, F.lit(RUN), F.lit(0)), lambda s: ~s.rlike(UUID) & (F.size(F.array_distinct(F.regexp_extract_all(s, F.lit("."), F.lit(0)))) >= 8) & (model.score(s) >= model.limit))
    runs = F.when(t.rlike(RUN), places(t, RUN, 3, likely)).otherwise(none)
    base = docs.select(F.col(key), F.coalesce(F.col(text), F.lit("")).alias("_t")).select(key, assign.alias("a"), access.alias("c"), hexes.alias("h"), runs.alias("r"))
    base = base.select(key, "a", "c", "h", "r", F.concat("a", "c", "h").alias("b"))
    # names of lambda variables are apart, so that the inner one sees the outer
    base = base.withColumn("r", F.expr("filter(r, x -> NOT exists(b, y -> y.start < x.end AND y.end > x.start))"))
    count = lambda c: F.size(c).cast("long")
    return base.select(key, count("a").alias("n_assign"), count("c").alias("n_access"), count("h").alias("n_hex"), count("r").alias("n_random"), F.sha2(written(F.col("b")), 256).alias("base_sha256"), written(F.concat("b", "r")).alias("spans"))
