"""Personal data by candidates and boosted trees, in DataFrame operations and Spark ML only.

Generators with high recall propose spans that may overlap; each gets features of its format and its surroundings; boosted trees
score it, and a threshold for each generator, calibrated on held-out examples for precision, selects. Matches of the base rules
(e-mail, IP address, payment card with check digit, international phone number) always stay; the trees add others: addresses that are
spelled out, national and spelled-out phone numbers, and secrets (keys, tokens, passwords).

All of it is array columns of the row itself: no shuffle, each text is read once, and the work grows with a text's length and little more than in
proportion to its matches. No table has labels for personal data, so the trees are trained on ``TRAINING_ROWS`` generated examples, with other
words around them than the corpus has. ``python -m sessionloom.llm.pii`` fits them and writes the model beside this module (``MODEL``: trees, thresholds,
seed, version); queries load it and run the trees as column expressions.
"""

from __future__ import annotations

import json
from functools import cache
from pathlib import Path

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone", "secret")
MODEL = Path(__file__).with_name("pii_model.json")
#: Of the examples and features; a model of another version is not loaded.
VERSION, SEED = 3, 7
#: Generated training examples; a quarter of them is held out for the thresholds. Trees and their depth.
TRAINING_ROWS, TREES, DEPTH = 10000, 6, 4
#: Precision on held-out examples that a generator's threshold must reach.
PRECISION = 0.98
#: And the least threshold.
LEAST_SCORE = 0.6
#: Code points before a span that are looked at, as far as the generator's match before it.
AROUND = 28
#: Matches whose places are added up at once.
RUN = 128

# Possessive runs, and starts only at the head of a run or where the last match ended: the same leftmost matches without backtracking.
_MAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
_QUAD = r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
_DIGITS = r"[0-9](?:[\x20-]?[0-9])++"
_PLUS = r"\+[0-9][\x20().0-9-]+[0-9]"
_AT, _DOT = r"(?:\x20?[\[({<]\x20?(?i:at)\x20?[\])}>]\x20?|\x20(?i:at)\x20|\x20@\x20)", r"(?:\x20?[\[({<]\x20?(?i:dot)\x20?[\])}>]\x20?|\x20(?i:dot)\x20|\.)"
_SPELLED = rf"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++{_AT}[A-Za-z0-9-]++(?:{_DOT}[A-Za-z0-9-]++)++"
_LOCAL = r"(?<![0-9A-Za-z+./-])\(?[0-9]{2,5}\)?(?:[\x20./-][0-9]{2,5}){1,4}(?![0-9A-Za-z])"
_NUMBER = "(?:[zZ]ero|[oO]ne|[oO]h|[tT]wo|[tT]hree|[fF]our|[fF]ive|[sS]ix|[sS]even|[eE]ight|[nN]ine)"
_SAID = rf"(?<![A-Za-z]){_NUMBER}(?:[\x20-]{_NUMBER}){{6,}}+(?![A-Za-z])"
_SECRET = r"(?<![A-Za-z0-9_-])(?=[A-Za-z_-]*+[0-9])(?=[0-9_-]*+[A-Za-z])[A-Za-z0-9_-]{16,}+"


#: (kind, pattern, what a text must have for the pattern to be tried)
GENERATORS = (
    ("email", _MAIL, lambda t: F.contains(t, F.lit("@"))),
    ("ip", _QUAD, lambda t: t.rlike(r"[0-9]\.[0-9]")),
    ("card", _DIGITS, lambda t: t.rlike(r"[0-9](?:[\x20-]?[0-9]){7}")),
    ("phone", _PLUS, lambda t: F.contains(t, F.lit("+"))),
    ("email", _SPELLED, lambda t: t.rlike(r"[\x20\[({<](?:\x20?(?i:at)\x20?[\])}>]|(?i:at)\x20[A-Za-z0-9-]+(?:\.[A-Za-z]|\x20(?i:dot)\x20)|@\x20)")),
    ("phone", _LOCAL, lambda t: t.rlike(r"[0-9]{2}\)?[\x20./-][0-9]{2}")),
    ("phone", _SAID, lambda t: t.rlike(rf"[\x20-]{_NUMBER}[\x20-]{_NUMBER}[\x20-]{_NUMBER}[\x20-]")),
    ("secret", _SECRET, lambda t: t.rlike("[0-9]")),
)
BASE = 4
#: Words before a span that speak for one kind or against all: a group each.
HINTS = (
    r"(?i)mail|contact|write|reach",
    r"(?i)\b(?:ip|host|server|address|login)\b",
    r"(?i)card|visa|pay|credit",
    r"(?i)phone|tel\b|call|mobile|fax|dial|ring|whatsapp",
    r"(?i)order|ref|version|serial|isbn|invoice|build|id\b|no\.|page|between|from|score",
    r"(?i)token|key|secret|passw|pwd|bearer|credential",
    r"(?i)commit|sha|md5|digest|checksum|revision|file|image|url|slug|/$",
    r"(?i)[=:]\x20?[\"']?$",
)
FEATURES = ("size", "digits", "distinct", "luhn", "largest", "before", "after", "letters", "kinds", "marks", "hex", *(f"hint{k}" for k in range(len(HINTS))))
_SPAN = "array<struct<start:int,end:int,value:string,left:string,after:string>>"
_PLACE = "array<struct<start:int,kind:int,end:int>>"


def matches(text: Column, pattern: str) -> Column:
    """Leftmost non-overlapping matches: code point range, value, what stands before it (back to the match before, AROUND at most) and the next code point.

    Places are running sums of the lengths of matches and of the pieces between them, RUN matches at a time.
    """
    cut = F.array(F.struct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("found"), F.split(text, pattern, -1).alias("gaps")))

    def one(z: Column, v: Column, i: Column) -> Column:
        gap = F.get(z["gaps"], i)
        return F.struct(F.length(gap).alias("gap"), v.alias("value"), F.substring(gap, F.greatest(F.length(gap) - AROUND, F.lit(0)) + 1, F.lit(AROUND)).alias("left"), F.substring(F.get(z["gaps"], i + 1), 1, 1).alias("after"))

    each = F.flatten(F.transform(cut, lambda z: F.transform(z["found"], lambda v, i: one(z, v, i))))

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + x["gap"]
        end = start + F.length(x["value"])
        span = F.struct(start.alias("start"), end.alias("end"), x["value"].alias("value"), x["left"].alias("left"), x["after"].alias("after"))
        return F.struct(end.alias("at"), F.concat(acc["out"], F.array(span)).alias("out"))

    def parts(x: Column) -> Column:
        begin = F.struct(F.lit(0).alias("at"), F.array().cast(_SPAN).alias("out"))
        return F.transform(F.sequence(F.lit(0), F.floor((F.size(x) - 1) / RUN).cast("int")), lambda p: F.aggregate(F.slice(x, p * RUN + 1, F.lit(RUN)), begin, step))

    def moved(part: Column, by: Column) -> Column:
        return F.transform(part["out"], lambda c: F.struct((c["start"] + by).alias("start"), (c["end"] + by).alias("end"), c["value"].alias("value"), c["left"].alias("left"), c["after"].alias("after")))

    def together(x: Column) -> Column:
        offsets = F.aggregate(x, F.array(F.lit(0)), lambda acc, part: F.concat(acc, F.array(F.element_at(acc, -1) + part["at"])))
        return F.flatten(F.zip_with(x, F.slice(offsets, 1, F.size(x)), moved))

    # each step is the argument of the next one's lambda, so that it is worked out once
    summed = F.flatten(F.transform(F.array(each), lambda x: F.when(F.size(x) > 0, parts(x))))
    return F.coalesce(F.flatten(F.transform(F.array(summed), lambda x: F.when(F.size(x) > 0, together(x)))), F.array().cast(_SPAN))


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """The check sum of a string of digits, modulo 10."""
    n = F.length(digits)

    def add(acc: Column, k: Column) -> Column:
        d = F.substring(digits, n - k, F.lit(1)).cast("int")
        twice = F.when(d > 4, 2 * d - 9).otherwise(2 * d)
        return acc + F.when(k % 2 == 1, twice).otherwise(d)

    return F.when(n == 0, F.lit(0)).otherwise(F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), add) % 10)


def _card_ok(c: Column) -> Column:
    d = _digits(c["value"])
    return F.when(F.length(d).between(12, 19), luhn(d) == 0).otherwise(F.lit(False))


def _quad_ok(value: Column) -> Column:
    return ~value.rlike(r"(?:^|\.)0*(?:[1-9][0-9]{3,}|[3-9][0-9]{2}|2[6-9][0-9]|25[6-9])(?:\.|$)")


def _phone_ok(c: Column) -> Column:
    return F.length(_digits(c["value"])).between(9, 15)


_BASE_OK = (lambda c: F.lit(True), lambda c: _quad_ok(c["value"]), _card_ok, _phone_ok)


def _features(c: Column, generator: int) -> Column:
    """Format and context features of one candidate, as doubles."""
    value, d, left = c["value"], _digits(c["value"]), c["left"]
    kind = lambda x: F.when(x.rlike(r"[0-9]"), 3).when(x.rlike(r"\p{L}"), 2).when(x.rlike(r"\S"), 1).otherwise(0)
    card = F.when(F.length(d).between(12, 19), F.when(luhn(d) == 0, 2).otherwise(1)).otherwise(0) if generator == 2 else F.lit(0)
    largest = F.when(_quad_ok(value), 1).otherwise(0) if generator == 1 else F.lit(0)
    values = [
        F.length(value), F.length(d), F.size(F.array_distinct(F.split(d, ""))), card, largest, kind(F.substring(left, -1, 1)), kind(c["after"]),
        F.length(F.regexp_replace(value, "[^A-Za-z]", "")), F.size(F.array_distinct(F.split(value, ""))), F.length(F.regexp_replace(value, r"[A-Za-z0-9]", "")),
        value.rlike("^[0-9a-fA-F]+$").cast("int"), *(left.rlike(h).cast("int") for h in HINTS),
    ]
    return F.struct(c["start"].alias("start"), c["end"].alias("end"), *(v.cast("double").alias(n) for v, n in zip(values, FEATURES, strict=True)))


def _featured(generator: int):
    return lambda c: _features(c, generator)


def _not_base(generator: int):
    return lambda c: ~_BASE_OK[generator](c)


def candidates(text: Column) -> list[Column]:
    """Per generator the array of its matches."""
    return [F.when(gate(text), matches(text, pattern)).otherwise(F.array().cast(_SPAN)) for _, pattern, gate in GENERATORS]


# ---- the model


def _examples(spark: SparkSession) -> DataFrame:
    """Generated examples (text, label, about): one candidate of the generator ``about`` is what the label is about."""
    n = F.col("id")
    pick = lambda salt, many: F.pmod(F.xxhash64(n, F.lit(salt)), F.lit(many))
    num = lambda salt, width: F.lpad(pick(salt, 10**width).cast("string"), width, "0")
    one_of = lambda salt, *x: F.element_at(F.array(*(F.lit(y) if isinstance(y, str) else y for y in x)), (pick(salt, len(x)) + 1).cast("int"))
    word = lambda salt: one_of(salt, "the", "river", "lantern", "of", "garden", "was", "seen", "and", "later", "stone")
    code = lambda salt, width: F.substring(F.concat(F.md5(F.concat_ws("-", n, F.lit(salt)).cast("binary")), F.md5(F.concat_ws("+", n, F.lit(salt)).cast("binary"))), 1, width)
    fifteen = F.concat(num(1, 8), num(2, 7))
    check = F.pmod(10 - luhn(F.concat(fifteen, F.lit("0"))), F.lit(10))
    good, bad = F.concat(fifteen, check.cast("string")), F.concat(fifteen, F.pmod(check + 1 + pick(3, 9), F.lit(10)).cast("string"))
    quad = F.concat_ws(".", *((pick(10 + k, 256)).cast("string") for k in range(4)))
    large = F.concat_ws(".", (256 + pick(14, 700)).cast("string"), *((pick(15 + k, 900)).cast("string") for k in range(3)))
    mark = one_of(20, "-", ".", " ", "/")
    national = one_of(24, F.concat(num(21, 3), mark, num(22, 3), mark, num(23, 4)), F.concat(F.lit("("), num(21, 3), F.lit(") "), num(22, 3), F.lit("-"), num(23, 4)), F.concat(F.lit("0"), num(21, 3), mark, num(22, 3), num(23, 2)), F.concat(F.lit("0"), num(21, 1), *(x for k in range(4) for x in (mark, num(25 + k, 2)))))
    date = one_of(29, F.concat(F.lit("20"), num(21, 2), mark, num(22, 2), mark, num(23, 2)), F.concat(num(22, 2), mark, num(23, 2), mark, F.lit("19"), num(21, 2)))
    years = F.concat(F.lit("19"), num(21, 2), mark, F.lit("20"), num(22, 2))
    counts = F.concat(num(21, 3), F.lit(" "), num(22, 2))
    mail = lambda at, dot: F.concat(word(30), one_of(36, ".", "_", ""), word(31), at, word(32), dot, one_of(33, "com", "org", "net", "de"))
    digit = lambda salt: one_of(salt, "zero", "one", "two", "three", "four", "five", "six", "seven", "eight", "nine")
    plus = F.concat(F.lit("+"), (1 + pick(40, 90)).cast("string"), F.lit(" ("), num(41, 3), F.lit(") "), num(42, 3), F.lit("-"), num(43, 4))
    short = F.concat(F.lit("+"), (1 + pick(44, 9)).cast("string"), F.lit(" "), num(45, 2), F.lit("."), num(46, 2))
    tell, other = one_of(50, "call", "phone", "tel", "mobile", "fax", "dial", "whatsapp me:"), one_of(51, "order", "ref", "serial", "invoice", "build", "id", "score")
    secret = one_of(90, code(91, 40), code(92, 32), F.concat(F.lit("sk_"), code(93, 24)), F.upper(code(94, 20)), F.base64(F.unhex(code(95, 48))))
    named = F.concat(one_of(96, "token", "api_key", "secret", "password", "access_key", "TOKEN", "Bearer", "credentials"), one_of(97, " = \"", "=", ": ", "=\"", ": '"))
    slug = F.concat_ws("-", word(98), word(99), num(100, 2), word(101), word(102), word(103), word(104))
    glued = F.concat(word(98), word(99), num(100, 2), word(101), word(102), word(103), word(104))
    templates = (
        (0, mail(F.lit("@"), F.lit(".")), one_of(60, "mail", "contact", "", ""), 1),
        (1, quad, one_of(61, "server", "from", "host", ""), 1),
        (1, large, one_of(62, "version", "build", "", ""), 0),
        (1, F.concat((256 + pick(14, 700)).cast("string"), F.lit("."), F.concat_ws(".", *((pick(15 + k, 256)).cast("string") for k in range(3)))), one_of(71, "server", "host", "", ""), 0),
        (2, good, one_of(63, "card", "visa", "", ""), 1),
        (2, bad, one_of(64, "order", "serial", "", "", "isbn", "card"), 0),
        (2, num(65, 8), one_of(66, "ref", "", "order"), 0),
        (2, F.concat(num(21, 3), one_of(72, "-", " "), num(22, 3), one_of(73, "-", " "), num(23, 4)), tell, 0),
        (3, plus, one_of(67, "call", "tel", "", ""), 1),
        (3, short, one_of(68, "", "version", "grew"), 0),
        (4, mail(one_of(34, " (at) ", "[at]", " [at] ", "(at)", "{at}", " <at> "), one_of(35, " (dot) ", "[dot]", " [dot] ", ".", " dot ")), one_of(69, "mail", "contact", "", "write"), 1),
        (4, mail(one_of(34, " at ", " AT "), one_of(35, " dot ", " DOT ")), one_of(69, "mail", "contact", "reach me:", "write"), 1),
        (4, mail(F.lit(" @ "), F.lit(".")), one_of(69, "mail", "contact", "", "write"), 1),
        (4, F.concat(word(30), F.lit(" at "), word(31), F.lit("."), word(32)), one_of(70, "", "", word(36)), 0),
        (5, national, tell, 1),
        (5, national, other, 0),
        (5, date, one_of(74, "on", "since", "", "until"), 0),
        (5, years, one_of(75, "between", "from", "", "in"), 0),
        (5, counts, one_of(76, "", "page", "score"), 0),
        (6, F.concat_ws(" ", *(digit(110 + k) for k in range(7)), one_of(117, digit(118), F.concat_ws(" ", digit(118), digit(119), digit(120)))), one_of(77, "call", "phone", "dial", ""), 1),
        (6, F.concat_ws(" ", *(F.lit(x) for x in ("one", "two", "three", "four", "five", "six", "seven", "eight"))), one_of(78, "count", "", "sing", "and"), 0),
        (7, secret, named, 1),
        (7, secret, one_of(79, "commit ", "sha1 ", "md5: ", "checksum ", "revision "), 0),
        (7, slug, one_of(80, "", "see /", "file ", "url: ", "id: "), 0),
        (7, glued, one_of(80, "", "see /", "file ", "url: ", "key "), 0),
    )
    case = F.pmod(n, F.lit(len(templates)))
    choose = lambda k: F.element_at(F.array(*(F.lit(t[k]) if isinstance(t[k], int) else t[k] for t in templates)), (case + 1).cast("int"))
    join = F.when(choose(0) == 7, F.lit("")).otherwise(F.lit(" "))
    text = F.concat_ws(" ", word(130), word(131), F.concat(choose(2), join, choose(1)), one_of(132, ".", ",", "and", "was", "\""), word(133))
    return spark.range(0, TRAINING_ROWS, 1, 1).select("id", F.floor(n / len(templates)).alias("round"), text.alias("text"), choose(0).alias("about"), choose(3).cast("double").alias("label"))


def _nodes(node) -> list | float:
    """A regression tree of Spark ML as [feature, threshold, left, right], or a leaf's value."""
    if node.numDescendants() == 0:
        return round(float(node.prediction()), 6)
    split = node.split()
    return [FEATURES[split.featureIndex()], float(split.threshold()), _nodes(node.leftChild()), _nodes(node.rightChild())]


def _tree(node: list | float, c: Column) -> Column:
    if not isinstance(node, list):
        return F.lit(float(node))
    feature, threshold, left, right = node
    return F.when(c[feature] <= float(threshold), _tree(left, c)).otherwise(_tree(right, c))


def score(own: dict, c: Column) -> Column:
    """The trees of a generator as a function of its candidate."""
    margin = F.lit(0.0)
    for weight, tree in zip(own["weights"], own["trees"], strict=True):
        margin = margin + float(weight) * _tree(tree, c)
    return 1 / (1 + F.exp(-2 * margin))


def fit_selector(spark: SparkSession) -> dict:
    """Trees and a threshold for each generator, from the generated examples: a function of SEED and VERSION alone."""
    rows = _examples(spark)
    out = []
    for g, found in enumerate(candidates(F.col("text"))):
        # an example may have more than one candidate, as the words around it may make one too: the longest
        mine = rows.filter(F.col("about") == g).select("round", "label", F.transform(found, _featured(g)).alias("c")).filter("size(c) > 0")
        longest = F.element_at(F.array_sort(F.transform("c", lambda c: F.struct(-c["size"], c.alias("c")))), 1)["c"]
        ready = mine.select("round", "label", longest.alias("c")).select("round", "label", "c.*").cache()
        data = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(ready)
        fitted = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, stepSize=0.3, seed=SEED).fit(data.filter("round % 4 != 0"))
        trees = fitted._java_obj.trees()
        own = {"weights": [float(w) for w in fitted.treeWeights], "trees": [_nodes(trees[k].rootNode()) for k in range(len(fitted.treeWeights))], "threshold": 2.0}
        # the threshold: half way below the least score above which held-out examples are right often enough
        held = ready.filter("round % 4 = 0").withColumn("score", score(own, F.struct(*FEATURES))).select("score", "label").orderBy(F.desc("score")).collect()
        ready.unpersist()
        right = 0.0
        for k, r in enumerate(held, 1):
            right += r["label"]
            if right / k >= PRECISION and (k == len(held) or held[k]["score"] < r["score"]):
                below = held[k]["score"] if k < len(held) else 0.0
                own["threshold"] = round(max((r["score"] + below) / 2, LEAST_SCORE), 6)
        out.append(own)
    return {"version": VERSION, "seed": SEED, "generators": out}


@cache
def selector() -> dict:
    """The stored model."""
    model = json.loads(MODEL.read_text())
    if (model["version"], model["seed"]) != (VERSION, SEED):
        raise ValueError(f"{MODEL} is of version {model['version']}, seed {model['seed']}: fit it anew")
    return model


def _tagged(spans: Column, order: int) -> Column:
    return F.transform(spans, lambda c: F.struct(c["start"].alias("start"), F.lit(order).alias("kind"), c["end"].alias("end")))


def _selected(own: dict, candidate: Column) -> Column:
    return F.filter(candidate, lambda c: score(own, c) >= own["threshold"])


def find_spans(docs: DataFrame) -> DataFrame:
    """The rows with ``base`` and ``spans``: arrays of (start, kind number, end), code points, end exclusive, by start and kind.

    ``base`` has the matches of the base rules; ``spans`` those, and the candidates that the trees select and that overlap none of
    them; they may overlap each other. A null text is empty and has none. Columns of the input with these names are replaced.
    """
    model = selector()
    keep = [c for c in docs.columns if c not in ("base", "spans")]
    rows = docs.select(F.struct(*keep).alias("row"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("t"))
    rows = rows.withColumns({f"c{k}": c for k, c in enumerate(candidates(F.col("t")))})
    some = sum((F.size(f"c{k}") for k in range(len(GENERATORS))), F.lit(0)) > 0
    nothing = F.array().cast(_PLACE)
    valid = F.concat(*(_tagged(F.filter(f"c{k}", _BASE_OK[k]), k) for k in range(BASE)))
    rows = rows.withColumn("base", F.when(some, F.array_sort(valid)).otherwise(nothing))
    # base matches stay without being asked
    other = [F.filter(f"c{k}", _not_base(k)) if k < BASE else F.col(f"c{k}") for k in range(len(GENERATORS))]
    more = F.concat(*(_tagged(_selected(model["generators"][k], F.transform(x, _featured(k))), KINDS.index(GENERATORS[k][0])) for k, x in enumerate(other)))
    rows = rows.withColumn("more", F.when(some, more).otherwise(nothing))
    apart = F.filter("more", lambda c: ~F.exists("base", lambda b: (b["start"] < c["end"]) & (c["start"] < b["end"])))
    rows = rows.withColumn("spans", F.when(F.size("more") > 0, F.array_sort(F.array_distinct(F.concat("base", apart)))).otherwise(F.col("base")))
    return rows.select("row.*", "base", "spans")


def span_text(spans: Column) -> Column:
    """``kind:start:end`` of each span, comma-joined."""
    kind = lambda s: F.element_at(F.array(*map(F.lit, KINDS)), s["kind"] + 1)
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", kind(s), s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(docs: DataFrame) -> DataFrame:
    """The rows with each span of the text replaced by its kind in brackets; spans that overlap become one, named by the first.

    A text without spans stays as it is, null included. Other columns stay.
    """
    found = find_spans(docs).select(F.struct(*docs.columns).alias("row"), "spans").withColumn("t", F.col("row.text").cast("string"))
    nothing = F.array().cast(_PLACE)

    def merge(acc: Column, s: Column) -> Column:
        last = F.element_at(acc, -1)
        joined = F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(last["start"].alias("start"), last["kind"].alias("kind"), F.greatest(last["end"], s["end"]).alias("end"))))
        return F.when(F.size(acc) == 0, F.array(s)).when(last["end"] > s["start"], joined).otherwise(F.concat(acc, F.array(s)))

    rows = found.withColumn("merged", F.when(F.size("spans") > 0, F.aggregate("spans", nothing, merge)).otherwise(nothing))

    def part(text: Column, spans: Column, begin: Column, end: Column) -> Column:
        """The text from ``begin`` to ``end``, the spans in it replaced."""
        own = F.substring(text, begin + 1, end - begin)
        begins = F.concat(F.array(begin), F.transform(spans, lambda s: s["end"]))
        ends = F.concat(F.transform(spans, lambda s: s["start"]), F.array(end))
        tags = F.concat(F.transform(spans, lambda s: F.concat(F.lit("["), F.upper(F.element_at(F.array(*map(F.lit, KINDS)), s["kind"] + 1)), F.lit("]"))), F.array(F.lit("")))
        pieces = lambda t: F.array_join(F.zip_with(F.zip_with(begins, ends, lambda a, b: F.substring(t, a - begin + 1, b - a)), tags, lambda p, g: F.concat(p, g)), "")
        return F.element_at(F.transform(F.array(own), pieces), 1)

    # a text is cut behind every RUN spans first, so that no span is sought from the text's head
    def cut(p: Column) -> Column:
        spans = F.slice("merged", p * RUN + 1, F.lit(RUN))
        begin = F.when(p == 0, F.lit(0)).otherwise(F.get("merged", p * RUN - 1)["end"])
        end = F.when((p + 1) * RUN >= F.size("merged"), F.length("t")).otherwise(F.get("merged", (p + 1) * RUN - 1)["end"])
        return part(F.col("t"), spans, begin, end)

    redacted = F.array_join(F.transform(F.sequence(F.lit(0), F.floor((F.size("merged") - 1) / RUN).cast("int")), cut), "")
    text = F.when(F.size("merged") > 0, redacted).otherwise(F.col("t"))
    return rows.withColumn("text", text).select(*(F.col("text") if c == "text" else F.col("row")[c].alias(c) for c in docs.columns))


def span_digest(docs: DataFrame) -> DataFrame:
    """doc_id, counts of base spans by kind, base_sha256 and all spans, one row an input row."""
    found = find_spans(docs.select("doc_id", "text"))
    of_kind = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    counts = [of_kind(k).alias(f"n_{KINDS[k]}") for k in range(BASE)]
    return found.select("doc_id", *counts, F.sha2(span_text(F.col("base")), 256).alias("base_sha256"), span_text(F.col("spans")).alias("spans"))


def main() -> None:
    spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
    MODEL.write_text(json.dumps(fit_selector(spark), indent=1) + "\n")
    spark.stop()


if __name__ == "__main__":
    main()
