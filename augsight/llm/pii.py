"""Operator 10, PII: candidate gradient boosting over the base patterns, with DataFrame functions only.

Base spans follow fixed patterns and checks and always stay.  Around them,
generators of high recall propose further spans that may overlap: Unicode
words around an ``@``, dotted numbers, runs of digits with separators.
Candidates that meet a base span of their kind are positive; candidates that
cannot be of their kind are negative (:func:`_wrong`: dates, decimals, plain
numbers without a word such as "call" before them, failed check digits, spans
of another kind, hosts without a dot); all others are unlabelled, and only
those can be added.  The trees see no feature that restates a base pattern
(plus sign, ASCII, number of parts): positives are also shown without their
country code and with other separators, and each brings near misses made from
its own digits or host, so that both classes are there wherever base spans are.

Boosted trees learn from format (length, digits, group sizes, separators,
check digit) and context (characters and words beside the span), classes of
a kind weighed equally, on at most ``TRAIN_CANDIDATES`` of them (smallest
hashes outside the calibration fold).  Thresholds are calibrated per kind on
the other fold: the lowest score from one half up where labelled candidates
with that score or more reach ``PRECISION``, classes weighed equally; a kind
without both classes in that fold uses all labelled ones.  Unlabelled candidates
above that meet no base span are added, leftmost first.

Texts without a digit or an ``@`` can hold none of this and are not searched
further.  Positions come from the gaps between matches, summed per text, so
a text with very many matches is sorted once and not rescanned.

Defined results: a null text is empty and has no spans; positions count code
points, the end is exclusive; repeated rows are rows; a kind without a base
span gets nothing added, and so does ``ip``, whose pattern leaves nothing
out; other columns are ignored.
"""

from __future__ import annotations

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from augsight.llm.common import staged

# Kinds in their order, with the base patterns.  Possessive forms match what the greedy ones
# match, in linear time: what follows a repeated class is never in it, and a match starts where a run does.
BASE = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
KINDS = list(BASE)
#: Generators of candidates.
WIDE = {
    "email": r"(?:(?<![\p{L}\p{M}\p{N}._%+-])|\G)[\p{L}\p{M}\p{N}._%+-]++@[\p{L}\p{M}\p{N}.-]*[\p{L}\p{M}\p{N}]",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++)++",
    "card": r"[0-9](?:[\x20./-]?[0-9])++",
    "phone": r"(?:\+|\()?[0-9][\x20()./0-9-]*[0-9]",
}
#: Fewest digits of a numeric candidate.
LEAST_DIGITS = {"ip": 4, "card": 12, "phone": 7}
BYTE = r"0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})"
#: Characters beside a candidate that are context.
CONTEXT = 24
HINTS = r"(?i)(mail|contact|phone|tel|call|fax|mobile|card|visa|credit|account|ip|host|server|address)"
#: Words before a phone number, and before numbers that are none.
PHONE_HINTS = r"(?i)(phone|tel|call|fax|mobil|cell|dial|ring|contact|sms|whatsapp)"
OTHER_HINTS = r"(?i)(isbn|issn|doi|order|invoice|version|date|page|since|until)"
DATE = r"^\(?(?:[0-9]{4}([./-])[0-9]{1,2}\1[0-9]{1,2}|[0-9]{1,2}([./-])[0-9]{1,2}\2[0-9]{2,4})(?:$|[\s)])"
#: Plain and decimal numbers, thousands.
NUMBER = r"^[0-9]+(?:\.[0-9]+)?$|^[0-9]{1,3}(?:\.[0-9]{3}){2,}$"
TRAIN_CANDIDATES = 50_000
TREES, DEPTH = 10, 4
CALIBRATION_FOLDS = 4
PRECISION = 0.99
BINS = 100


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Whether the check digit of a digit string fits."""
    def step(acc: Column, i: Column) -> Column:
        d = F.substring(digits, F.length(digits) - i, F.lit(1)).cast("int") * (1 + i % 2)
        return acc + F.when(d > 9, d - 9).otherwise(d)
    places = F.sequence(F.lit(0), F.length(digits) - 1)
    return F.aggregate(places, F.lit(0), step) % 10 == 0


def _valid(kind: str, match: Column) -> Column:
    digits = _digits(match)
    if kind == "ip":
        return F.rlike(match, F.lit(rf"^{BYTE}(?:\.{BYTE}){{3}}$"))
    if kind == "card":
        return F.when(F.length(digits).between(14, 19), _luhn(digits)).otherwise(F.lit(False))
    if kind == "phone":
        return F.length(digits).between(10, 15)
    return F.lit(True)


def _found(text: Column, pattern: str) -> Column:
    """Every match in order: (gap since the last one, match, characters before and after)."""
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    pieces = F.split(text, pattern, -1)
    both = F.struct(matches.alias("m"), pieces.alias("p"))
    listed = F.transform(F.array(both), lambda x: F.transform(x["m"], lambda m, i: F.struct(
        F.char_length(F.get(x["p"], i)).alias("gap"), m.alias("match"),
        F.right(F.get(x["p"], i), F.lit(CONTEXT)).alias("before"),
        F.left(F.get(x["p"], i + 1), F.lit(CONTEXT)).alias("after"))))
    return F.element_at(listed, 1)


def _spans(rows: DataFrame, column: str) -> DataFrame:
    """``(row, kind, start, end, match, before, after)`` of the matches in ``column`` (a struct of lists by kind)."""
    parts = None
    for kind in KINDS:
        part = (rows.select("row", F.posexplode(f"{column}.{kind}").alias("i", "m"))
                .select("row", F.lit(kind).alias("kind"), "i", "m.*"))
        parts = part if parts is None else parts.union(part)
    along = Window.partitionBy("row", "kind").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    size = F.char_length("match")
    end = F.sum(F.col("gap") + size).over(along)
    return parts.withColumn("end", end).withColumn("start", F.col("end") - size).drop("i", "gap")


def _features(c: DataFrame) -> tuple[DataFrame, list[str]]:
    digits, m = _digits(F.col("match")), F.col("match")
    groups = F.split(m, "[^0-9]+")
    sizes = F.transform(groups, lambda x: F.length(x))

    def side(text: Column, name: str) -> dict[str, Column]:
        return {f"{name}_{k}": F.rlike(text, F.lit(p)).cast("double") for k, p in
                (("letter", r"^[\p{L}_]"), ("digit", r"^[0-9]"), ("space", r"^\s"), ("none", r"^$"), ("quote", r"^[\"'=]"))}

    made = {f"is_{k}": (F.col("kind") == k).cast("double") for k in KINDS}
    made |= {"length": F.char_length(m).cast("double"), "digits": F.length(digits).cast("double"),
             "largest": F.array_max(sizes).cast("double"),
             "smallest": F.array_min(sizes).cast("double"),
             "check_digit": F.when(F.length(digits).between(1, 40), _luhn(digits)).otherwise(F.lit(False)).cast("double"),
             "hint": F.rlike("before", F.lit(HINTS)).cast("double"),
             "phone_hint": F.rlike("before", F.lit(PHONE_HINTS)).cast("double"),
             "other_hint": F.rlike("before", F.lit(OTHER_HINTS)).cast("double"),
             "dotted_host": F.rlike(m, F.lit(r"@.*[\p{L}\p{N}]\.\p{L}")).cast("double")}
    made |= {f"n_{n}": F.regexp_count(m, F.lit(p)).cast("double") for n, p in
             (("dot", r"\."), ("hyphen", "-"), ("space", " "), ("paren", r"[()]"), ("letter", r"\p{L}"))}
    made |= side(F.reverse("before"), "before") | side(F.col("after"), "after")
    return c.withColumns(made), list(made)


def _wrong() -> Column:
    """Whether a candidate that meets no base span of its kind cannot be of its kind."""
    m, n = F.col("match"), F.length(_digits(F.col("match")))
    inside = F.rlike("before", F.lit(r"[\p{L}\p{N}_]$")) | F.rlike("after", F.lit(r"^[\p{L}\p{N}_]"))
    phone = (F.rlike(m, F.lit(DATE)) | F.rlike(m, F.lit(r"^[12][0-9]{3} ?- ?[12][0-9]{3}$")) | (n > 15) | inside
             | (F.rlike(m, F.lit(NUMBER)) & ~F.rlike("before", F.lit(PHONE_HINTS)))
             | F.rlike("before", F.lit(r"(?i)is[bs]n[\s:-]*$")))
    card = ~n.between(13, 19) | ~_luhn(_digits(m)) | F.rlike(m, F.lit(r"^[0-9]+\.[0-9]+$|[./ -][0-9]{1,2}[./ -]")) | inside
    email = ~F.rlike(m, F.lit(r"[\p{L}\p{N}].*@[\p{L}\p{N}][^@]*\.[\p{L}\p{M}]{2,}$"))
    return (F.col("taken") | F.when(F.col("kind") == "phone", phone).when(F.col("kind") == "card", card)
            .when(F.col("kind") == "email", email).otherwise(F.lit(True)))


def _views() -> Column:
    """What a labelled candidate shows the trees: (label, match), without what only says that it meets a base pattern."""
    m, digits = F.col("match"), F.substring(_digits(F.col("match")), -10, 10)

    def view(label: int, match: Column) -> Column:
        return F.struct(F.lit(label).alias("label"), match.alias("match"))

    own = F.array(view(1, m))
    local, host = F.regexp_extract(m, "^(.*)@", 1), F.regexp_extract(m, "@(.*)$", 1)
    short = F.regexp_extract(host, r"([^.]*\.[^.]*)$", 1)
    email = F.array(view(1, m), view(1, F.concat_ws("@", F.regexp_replace(local, r"[^\p{L}]", ""), short)),
                    view(1, F.concat_ws("@", local, short)), view(0, F.concat_ws("@", local, F.translate(host, ".", "-"))),
                    view(0, F.concat_ws("@", local, F.regexp_extract(host, r"^([^.]*)", 1))))
    national = F.regexp_replace(m, r"^\+[0-9]{1,3}(?:[\x20.-]+|(?=\())", "")
    national = F.when(F.length(_digits(national)) >= LEAST_DIGITS["phone"], national).otherwise(m)
    national = F.regexp_replace(national, r"^\+", "")
    parts = F.trim(F.regexp_replace(national, "[^0-9]+", " "))
    plain = F.when(F.rlike("before", F.lit(PHONE_HINTS)), F.lit(1)).otherwise(F.lit(0))
    phone = F.array(
        view(1, F.regexp_replace(m, r"^\+", "")), view(1, national), view(1, F.translate(parts, " ", "-")),
        view(1, F.translate(parts, " ", ".")), view(1, parts), F.struct(plain.alias("label"), digits.alias("match")),
        view(0, F.concat(F.lit("20"), F.substring(digits, 1, 2), F.lit("-0"), F.substring(digits, 3, 1), F.lit("-1"), F.substring(digits, 4, 1))),
        view(0, F.concat(F.lit("1"), F.substring(digits, 1, 1), F.lit(".0"), F.substring(digits, 2, 1), F.lit(".20"), F.substring(digits, 3, 2))),
        view(0, F.concat(F.substring(digits, 1, 6), F.lit("."), F.substring(digits, 7, 4))))
    # One digit more: the check digit fails
    card = F.array(view(1, m), view(0, F.regexp_replace(m, "[0-9]$", ((F.right(m, F.lit(1)).cast("int") + 1) % 10).cast("string"))))
    made = (F.when(F.col("kind") == "phone", phone).when(F.col("kind") == "email", email)
            .when(F.col("kind") == "card", card).otherwise(own))
    return F.when(F.col("label") == 1, made).otherwise(F.array(view(0, m)))


def _thresholds(scored: DataFrame) -> dict[str, float]:
    """Per kind the lowest score from one half up that labelled candidates at or above reach ``PRECISION`` with.

    ``scored`` has kind, label, p, and whether a row is of the calibration fold (``apart``).  Classes weigh equally.
    """
    bins = (scored.groupBy("kind", "apart", F.floor(F.col("p") * BINS).cast("int").alias("bin"))
            .agg(F.sum("label").alias("hit"), F.count(F.lit(1)).alias("n")).collect())  # 8 * (BINS + 1) rows at most
    out = {}
    for kind in KINDS:
        every = [r for r in bins if r["kind"] == kind]
        for own in ([r for r in every if r["apart"]], every):
            ones = sum(r["hit"] for r in own)
            zeros = sum(r["n"] for r in own) - ones
            if ones and zeros:
                break
        else:
            continue
        hit = miss = 0.0
        for b in sorted({r["bin"] for r in own if r["bin"] >= BINS // 2}, reverse=True):
            hit += sum(r["hit"] for r in own if r["bin"] == b) / ones
            miss += sum(r["n"] - r["hit"] for r in own if r["bin"] == b) / zeros
            if hit and hit >= PRECISION * (hit + miss):
                out[kind] = b / BINS
    return out


def _added(candidates: DataFrame, base: DataFrame) -> DataFrame:
    """``(row, kind, start, end)`` of the candidates that the model selects and that meet no base span."""
    # Base spans and candidates of a text in one order: which base span reaches furthest before, and starts next.
    marks = base.select("row", "kind", "start", "end", F.lit("").alias("match"), F.lit("").alias("before"),
                        F.lit("").alias("after"), F.lit(True).alias("is_base"))
    both = candidates.withColumn("is_base", F.lit(False)).select(*marks.columns).union(marks)
    order = Window.partitionBy("row").orderBy("start", F.desc("is_base"), "end")
    past, ahead = order.rowsBetween(Window.unboundedPreceding, 0), order.rowsBetween(0, Window.unboundedFollowing)

    def meets(which: Column) -> Column:
        reach = F.max(F.when(which, F.col("end"))).over(past)
        following = F.min(F.when(which, F.col("start"))).over(ahead)
        return F.coalesce(reach > F.col("start"), F.lit(False)) | F.coalesce(following < F.col("end"), F.lit(False))

    own = F.lit(False)
    for kind in KINDS:
        own = own | ((F.col("kind") == kind) & meets(F.col("is_base") & (F.col("kind") == kind)))
    judged = both.withColumn("label", own.cast("int")).withColumn("taken", meets(F.col("is_base"))).filter("not is_base")
    judged = judged.withColumn("h", F.xxhash64("row", "kind", "start")).withColumn("wrong", (F.col("label") == 0) & _wrong())
    judged = staged(judged, "candidates")
    fold = F.pmod("h", F.lit(CALIBRATION_FOLDS))
    views = judged.filter("label = 1 or wrong").withColumn("view", F.explode(_views()))
    views, names = _features(views.select("kind", "before", "after", (fold == 0).alias("apart"), "h", "view.*"))
    views = staged(views.select("kind", "apart", "h", "label", *names), "views")
    assemble = VectorAssembler(inputCols=names, outputCol="features")
    train = staged(views.filter("not apart").orderBy("h").limit(TRAIN_CANDIDATES), "training")
    n = {(r["kind"], r["label"]): r["n"] for r in train.groupBy("kind", "label").agg(F.count(F.lit(1)).alias("n")).collect()}
    learned = [k for k in KINDS if (k, 0) in n and (k, 1) in n]
    if not learned:
        return judged.filter("false").select("row", "kind", "start", "end")
    weight = F.lit(0.0)
    for (kind, label), count in n.items():
        weight = F.when((F.col("kind") == kind) & (F.col("label") == label), F.lit(sum(n.values()) / count)).otherwise(weight)
    train = train.filter(F.col("kind").isin(learned)).withColumn("weight", weight)
    model = GBTClassifier(labelCol="label", weightCol="weight", maxIter=TREES, maxDepth=DEPTH, seed=10, subsamplingRate=1.0).fit(
        assemble.transform(train).select("label", "weight", "features"))

    def scores(rows: DataFrame, *columns: str) -> DataFrame:
        return model.transform(assemble.transform(rows)).select(*columns, vector_to_array("probability")[1].alias("p"))

    limits = _thresholds(scores(views.filter(F.col("kind").isin(learned)), "kind", "apart", "label"))
    chosen = F.lit(False)
    for kind, p in limits.items():
        chosen = chosen | ((F.col("kind") == kind) & (F.col("p") >= p))
    unlabelled, _ = _features(judged.filter("label = 0 and not wrong"))
    scored = staged(scores(unlabelled, "row", "kind", "start", "end").filter(chosen), "scored")
    along = Window.partitionBy("row").orderBy("start", F.desc("end"), "kind").rowsBetween(Window.unboundedPreceding, -1)
    return (scored.withColumn("reach", F.max("end").over(along))
            .filter("reach is null or reach <= start").select("row", "kind", "start", "end"))


def _listed(spans: DataFrame, name: str) -> DataFrame:
    place = F.array_position(F.array(*[F.lit(k) for k in KINDS]), F.col("kind"))
    sorted_ = F.array_sort(F.collect_list(F.struct("start", place.alias("place"), "end", "kind")))
    text = F.array_join(F.transform(sorted_, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    counts = [F.count_if(F.col("kind") == k).alias(f"n_{k}") for k in KINDS]
    return spans.groupBy("row").agg(text.alias(name), *counts)


def personal_data(docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``(rows, base, added)``: rows ``(row, doc_id)`` of all texts, and ``(row, kind, start, end)`` of the spans."""
    text = F.coalesce("text", F.lit(""))
    # base and candidates of a text that has a digit or an @; others cannot have any
    found = F.struct(*[_found(text, p).alias(k) for k, p in BASE.items()])
    wide = F.struct(*[_found(text, p).alias(k) for k, p in WIDE.items()])
    may = F.rlike(text, F.lit("[0-9@]"))
    # The number is stored with the row: made anew by each job it would follow that job's packing of the files.
    rows = staged(docs.select("doc_id", F.when(may, found).alias("found"), F.when(may, wide).alias("wide"),
                              F.monotonically_increasing_id().alias("row")), "found")
    base = _spans(rows.filter("found is not null"), "found")
    checks = F.lit(False)
    for kind in KINDS:
        checks = checks | ((F.col("kind") == kind) & _valid(kind, F.col("match")))
    base = staged(base.filter(checks).select("row", "kind", "start", "end"), "base")
    enough = F.col("kind") == "email"
    for kind, n in LEAST_DIGITS.items():
        enough = enough | ((F.col("kind") == kind) & (F.length(_digits(F.col("match"))) >= n))
    candidates = staged(_spans(rows.filter("wide is not null"), "wide").filter(enough), "wide")
    return rows.select("row", "doc_id"), base, _added(candidates, base)


def pii_digest(docs: DataFrame) -> DataFrame:
    """``(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans)`` of every row of ``docs``."""
    rows, base, added = personal_data(docs)
    own = _listed(base, "base")
    every = _listed(base.union(added), "spans").select("row", "spans")
    zero = [F.coalesce(f"n_{k}", F.lit(0)).cast("long").alias(f"n_{k}") for k in KINDS]
    return (rows.join(own, "row", "left").join(every, "row", "left")
            .select("doc_id", *zero, F.sha2(F.coalesce("base", F.lit("")).cast("binary"), 256).alias("base_sha256"),
                    F.coalesce("spans", F.lit("")).alias("spans")))


def redacted(docs: DataFrame, id_cols: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``(doc_id, spans)`` with spans as rows of kind, start and end, for redaction downstream."""
    rows, base, added = personal_data(docs)
    return rows.join(base.union(added), "row").select(*id_cols, "kind", "start", "end")
