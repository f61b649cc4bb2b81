"""Personal data by bootstrapped contextual extraction, in DataFrame functions only.

Base rules (email, ip, card, phone) give the seed entities. Every run of identifier-like tokens (tokens
with a digit or an at sign), cut at base spans, is an occurrence of an instance, its text, in patterns, its contexts: the two words before it, and
the word before it with the word after it. Patterns and instances form a graph, which is scored iteratively for each
kind: a pattern's score is the share of its instances' scores (smoothed), an instance's score that any of
its patterns holds (noisy or), and seeds score one. Patterns with enough distinct seeds, or instances that have the form of the kind and
came to a high score in an earlier round, and a high final score discover the remaining occurrences in their contexts, if those have the form of the kind.
Base spans always stay; discovered spans that overlap one are dropped.

The graph holds distinct pairs only, counted before they are shuffled, so a passage that very many documents share is one edge.

Defined results for odd input: a null or empty text has no spans. Null ids and repeated rows are returned row by row. An
occurrence at the start of a text has no words before it and so no patterns; one right behind a base span has its kind before it. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm import spans as S
from plumbline.llm.common import materialize
from plumbline.llm.spans import Rule

# The patterns of the base rules. A start inside a run is tried only right behind a match.
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
#: A run of tokens with a digit or an at sign.
OCCURRENCE = r"(?<![^\s])[^\s0-9@]*+[0-9@][^\s]*+(?:\x20[^\s0-9@]*+[0-9@][^\s]*+)*+"
ROUNDS = 3
#: A pattern extracts if it has this many distinct seeds or sure instances and this final score.
LEAST_SEEDS = 3
LEAST_SCORE = 0.6
#: Instances without a kind that every pattern is taken to have besides its own.
SMOOTHING = 1.0


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def _luhn(match: Column) -> Column:
    digits = F.reverse(_digits(match))
    size = F.length(digits)

    def add(total: Column, i: Column) -> Column:
        d = F.substring(digits, i, F.lit(1)).cast("int")
        twice = d * 2
        return total + F.when(i % 2 == 1, d).when(twice > 9, twice - 9).otherwise(twice)

    return F.when(size.between(12, 19), F.aggregate(F.sequence(F.lit(1), size), F.lit(0), add) % 10 == 0).otherwise(False)


def _octets(match: Column) -> Column:
    return F.forall(F.split(match, "[.]"), lambda p: F.coalesce(p.try_cast("bigint") <= 255, F.lit(False)))


BASE = [
    Rule("email", EMAIL, lambda m: F.lit(True), lambda t: t.contains("@")),
    Rule("ip", IP, _octets, lambda t: t.rlike(r"[0-9]\.[0-9]")),
    Rule("card", CARD, _luhn, lambda t: t.rlike(r"[0-9][\x20-]?[0-9]")),
    Rule("phone", PHONE, lambda m: F.length(_digits(m)).between(9, 15), lambda t: t.contains("+")),
]
KINDS = [r.kind for r in BASE]
_SEEN = "array<struct<start:int,end:int,instance:string,left:string,right:string>>"
_PIECES = "array<struct<start:int,end:int,instance:string,two:string,around:string,kinds:array<string>>>"


def base_spans(text: Column) -> Column:
    return F.concat(*[S.find(text, rule, k) for k, rule in enumerate(BASE)])


def _occurrences(text: Column) -> Column:
    """Runs of identifier-like tokens with the two words before and the word after."""
    found, between = S.pairs(text, OCCURRENCE)
    matches = F.zip_with(found, between, lambda m, b: F.struct(m.alias("m"), F.length(b).alias("skip"), F.lower(F.substring_index(F.trim(b), " ", -2)).alias("left")))
    after = F.transform(F.slice(between, 2, F.greatest(F.size(between) - 1, F.lit(0))), lambda b: F.lower(F.substring_index(F.trim(b), " ", 1)))
    matches = F.zip_with(F.filter(matches, lambda p: p["m"].isNotNull()), after, lambda p, a: F.struct(p["m"].alias("m"), p["skip"].alias("skip"), p["left"].alias("left"), a.alias("right")))
    nothing = F.array().cast(_SEEN)

    def one(start: Column, end: Column, p: Column) -> Column:
        seen = F.struct(start.alias("start"), end.alias("end"), p["m"].alias("instance"), F.coalesce(p["left"], F.lit("")).alias("left"), F.coalesce(p["right"], F.lit("")).alias("right"))
        return F.array(seen).cast(_SEEN)

    return F.when(text.rlike("[0-9@]"), S.placed(matches, _SEEN, one)).otherwise(nothing)


def _last(words: Column) -> Column:
    return F.substring_index(words, " ", -1)


def _piece(start: Column, instance: Column, left: Column, right: Column, kinds: Column) -> Column:
    """An array of one occurrence, or of none if no word is before it."""
    piece = F.struct(start.cast("int").alias("start"), (start + F.length(instance)).cast("int").alias("end"), instance.alias("instance"), left.alias("two"), F.concat(_last(left), F.lit(" _ "), right).alias("around"), kinds.cast("array<string>").alias("kinds"))
    return F.when((left != "") & (instance != ""), F.array(piece).cast(_PIECES)).otherwise(F.array().cast(_PIECES))


def _split(o: Column, spans: Column) -> Column:
    """A run cut at the base spans in it: these with their kinds, and the runs between them. In contexts spans stand as their kinds, runs as <*>."""

    def text(start: Column, end: Column) -> Column:
        return F.substring(o["instance"], start - o["start"] + 1, F.greatest(end - start, F.lit(0)))

    def rest(start: Column, end: Column, left: Column, right: Column) -> Column:
        def found(part: Column) -> Column:
            # what is cut off a token may have no digit; only the first and last token can be such
            return S.once(F.regexp_extract(part, OCCURRENCE, 0), lambda m: _piece(start + F.instr(part, m) - 1, m, left, right, F.array()))

        return S.once(text(start, end), found)

    def step(held: Column, s: Column) -> Column:
        start, end = F.greatest(s["start"], o["start"]), F.least(s["end"], o["end"])
        tag = F.concat(F.lit("<"), s["kind"], F.lit(">"))
        gap = text(held["at"], start).rlike("[0-9@]")
        left = F.when(start < held["at"], held["own"]).when(gap, F.ltrim(F.concat(_last(held["left"]), F.lit(" <*>")))).otherwise(held["left"])
        right = F.when(text(end, o["end"]).rlike("[0-9@]"), F.lit("<*>")).otherwise(o["right"])

        def after(own: Column) -> Column:
            parts = F.concat(held["parts"], rest(held["at"], start, held["left"], tag), _piece(start, text(start, end), own, right, F.array(s["kind"])))
            return F.struct(F.greatest(held["at"], end).cast("int").alias("at"), F.ltrim(F.concat(_last(own), F.lit(" "), tag)).alias("left"), own.alias("own"), parts.alias("parts"))

        return S.once(left, after)

    begin = F.struct(o["start"].alias("at"), o["left"].alias("left"), o["left"].alias("own"), F.array().cast(_PIECES).alias("parts"))
    cut = F.aggregate(F.array_sort(spans), begin, step, lambda held: F.concat(held["parts"], rest(held["at"], o["end"], held["left"], o["right"])))
    return F.when(F.size(spans) == 0, _piece(o["start"], o["instance"], o["left"], o["right"], F.array())).otherwise(cut)


def _with_kinds(base: Column, seen: Column) -> Column:
    """Occurrences, cut at the base spans that they overlap and with their kinds; these are looked for among those near their chunk."""

    def overlapping(spans: Column, start: Column, end: Column) -> Column:
        return F.filter(spans, lambda s: (s["start"] < end) & (start < s["end"]))

    def mark(chunk: Column, near: Column) -> Column:
        return F.flatten(F.transform(chunk, lambda o: S.once(overlapping(near, o["start"], o["end"]), lambda own: _split(o, own))))

    def each(chunk: Column, spans: Column) -> Column:
        near = overlapping(spans, F.get(chunk, F.lit(0))["start"], F.get(chunk, F.size(chunk) - 1)["end"])
        return S.once(near, lambda n: mark(chunk, n))

    return S.once(base, lambda spans: F.flatten(F.transform(S.chunks(seen), lambda chunk: each(chunk, spans))))


def _score(edges: DataFrame, rounds: int) -> DataFrame:
    """pattern, kind, score after ``rounds`` rounds over edges (pattern, instance, kind or null if it is no seed)."""
    seeds = edges.where(F.col("kind").isNotNull()).select("instance", "kind").distinct().withColumns({"belief": F.lit(1.0), "sure": F.lit(1)})
    plain = edges.select("pattern", "instance").distinct()
    size = plain.groupBy("pattern").agg(F.count(F.lit(1)).alias("size"))
    beliefs = seeds
    for n in range(rounds):
        mass = plain.join(beliefs, "instance").groupBy("pattern", "kind").agg(F.sum("belief").alias("mass"), F.sum("sure").alias("support")).where(F.col("support") >= LEAST_SEEDS)
        scored = mass.join(size, "pattern").select("pattern", "kind", (F.col("mass") / (F.col("size") + SMOOTHING)).alias("score"))
        scored = materialize(scored)
        if n + 1 < rounds:
            reached = plain.join(scored, "pattern").groupBy("instance", "kind").agg((1 - F.exp(F.sum(F.log(1 - F.least("score", F.lit(0.999)))))).alias("belief"))
            reached = reached.withColumn("sure", ((F.col("belief") >= LEAST_SCORE) & _has_form(F.col("kind"), F.col("instance"))).cast("int"))
            beliefs = materialize(reached.unionByName(seeds).groupBy("instance", "kind").agg(F.max("belief").alias("belief"), F.max("sure").alias("sure")))
    return scored


def _has_form(kind: Column, instance: Column) -> Column:
    """Whether an instance that no base rule found may be of a kind."""
    digits = F.length(_digits(instance))
    return F.when(kind == "email", instance.contains("@")).when(kind == "ip", instance.rlike(r"[0-9]+([.:][0-9]+){3}")).when(kind == "card", digits.between(12, 19)).otherwise(digits.between(7, 15))


def extract(docs: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """doc_id, __base and __found (arrays of spans) of every row."""
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", text.alias("text")).select("doc_id", base_spans(F.col("text")).alias("__base"), _occurrences(F.col("text")).alias("__seen"))
    rows = materialize(rows.withColumn("__row", F.monotonically_increasing_id()))
    # kinds are found before the explosion, which would copy the base spans once for every occurrence
    each = rows.where(F.size("__seen") > 0).select("__row", F.explode_outer(_with_kinds(F.col("__base"), F.col("__seen"))).alias("o")).select("__row", "o.*")
    each = each.withColumn("pattern", F.explode(F.array(F.concat(F.lit("two "), F.col("two")), F.concat(F.lit("around "), F.col("around")))))
    each = materialize(each.select("__row", "start", "end", "instance", "pattern", "kinds"))
    edges = materialize(each.select("pattern", "instance", F.explode_outer("kinds").alias("kind")).distinct())
    strong = _score(edges, rounds).where(F.col("score") >= LEAST_SCORE)
    # Null-free and hashed on the pattern, of which a very common one is split by the skew join
    new = each.where(F.size("kinds") == 0).join(strong, "pattern").where(_has_form(F.col("kind"), F.col("instance")))
    order = F.create_map(*[F.lit(x) for k, kind in enumerate(KINDS) for x in (kind, k)])
    best = new.groupBy("__row", "start", "end").agg(F.max(F.struct("score", "kind")).alias("b"))
    best = best.select("__row", F.struct(F.col("start"), order[F.col("b.kind")].alias("kind_order"), F.col("end"), F.col("b.kind").alias("kind")).alias("s"))
    best = best.groupBy("__row").agg(F.collect_list("s").cast(S.SPAN).alias("__found"))  # bounded by one text
    out = rows.drop("__seen").join(best, "__row", "left")
    return out.select("doc_id", "__base", F.coalesce("__found", F.array().cast(S.SPAN)).alias("__found"))
