"""Operator 5, personal data by candidate gradient boosting, DataFrame functions only.

Regular expressions propose spans. Those of the base rules (email, ip, card,
phone) always stay. Wider generators add overlapping candidates: addresses
written with (at), digit runs that miss the card rule, phone numbers without a
plus sign, long keys. Each gets format and context features; boosted trees,
fitted by Spark ML on a bounded labelled sample and written out as SQL
expressions, give it a probability, and it is taken if that exceeds a threshold
calibrated for its kind on held-out samples and it overlaps no base span. Spans
of different kinds may overlap; redaction covers all.

The sample is made from sentences in four languages: true candidates in contexts
that announce them, or in formats that tell enough, and as many look-alikes:
commit hashes, digests, order and part numbers, prices, dates, measures. A card
number must pass the Luhn test, so of digit runs those of 13 to 15 digits that do
can be added. ``tests/llm`` judges it on sentences of other templates.

Everything per document happens in one projection: no shuffle, no Python.
Offsets are code points, ends exclusive. All loops of the patterns are
possessive or over single characters, so they run in constant stack and linear
time in Java's engine; running offsets, and the nearest base spans around each
candidate, are accumulated in blocks.

Defined cases: null and empty texts have no spans; texts are searched whole,
however many candidates they hold; columns named like results, and
``__base``, ``__more``, ``__items``, are replaced; repeated rows are treated one
by one; an empty table gives an empty table.
"""

from __future__ import annotations

import random
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone", "secret")

#: The base rules. The lookbehind and \G only spare restarts
#: inside a run of the same characters, which all end alike.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
#: Generators of further candidates.
WRITTEN_EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++\x20?[(\[]at[)\]]\x20?[A-Za-z0-9-]++(?:\x20?(?:\.|[(\[]dot[)\]])\x20?[A-Za-z0-9-]++)++"
LOCAL_PHONE = r"(?<![0-9+.-])(?:\(?[0-9]{3}\)?[\x20.-]{1,2}[0-9]{3}[\x20.-][0-9]{4}|0[0-9]{1,4}[\x20/.-][0-9]{2,8}(?:[\x20.-][0-9]{2,4}){0,3})(?![0-9])"
SECRET = r"(?<![A-Za-z0-9_])[A-Za-z0-9_]{20,}+"

#: Words of context, part of the features.
CONTEXT = {
    "card": r"(?i)(card|visa|credit|master|karte|carte|tarjeta)",
    "phone": r"(?i)(phone|tel\b|tel[eé]|call|ring|fax|mobil|cell|text|reach|ruf|nummer|num[eé]ro|appel|llam)",
    "email": r"(?i)(mail|contact|kontakt|write|schreib|[eé]cri|escrib|reach|correo|adress|send)",
    "secret": r"(?i)(token|key|secret|passw|auth|access|credential|schl[uü]ssel|clave|cl[eé]|bearer|login|pwd)",
    "other": r"(?i)(order|invoice|commit|sha|md5|hash|digest|checksum|revision|part|serial|isbn|number|case|ticket|rechnung|bestell|commande|pedido|build|version|article|id\b|uuid|blob|tree|parent|ref)",
}
_BLOCK = 128


@dataclass(frozen=True)
class PiiParams:
    """``sample``: labelled texts for fitting and calibration together, the bound on training."""

    sample: int = 4800
    trees: int = 16
    depth: int = 4
    precision: float = 0.97
    seed: int = 42


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once a row, also inside other lambdas."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _running(values: Column, merge: Callable[[Column, Column], Column] = lambda a, x: a + x) -> Column:
    """Sum (or another merge, from 0) of what stands before each entry, block by block: near linear in the entries."""
    starts = F.sequence(F.lit(0), F.floor((F.greatest(F.size(values), F.lit(1)) - 1) / _BLOCK).cast("int"))
    part = lambda b, n: F.slice(values, b * _BLOCK + 1, n)
    total = lambda xs: F.aggregate(xs, F.lit(0), merge)
    totals = F.transform(starts, lambda b: total(part(b, F.lit(_BLOCK))))
    bases = let(totals, lambda t: F.transform(t, lambda _, b: total(F.slice(t, F.lit(1), b))))
    return F.flatten(F.transform(bases, lambda base, b: let(part(b, F.lit(_BLOCK)), lambda own: F.transform(own, lambda _, i: merge(base, total(F.slice(own, F.lit(1), i)))))))


def find_spans(text: Column, pattern: str) -> Column:
    """All leftmost non-overlapping matches as structs start, end, text, before, after."""
    raw = F.struct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("found"), F.split(text, pattern, -1).alias("between"))

    def spans(r: Column) -> Column:
        found, between = r["found"], r["between"]
        lengths = F.zip_with(F.slice(between, F.lit(1), F.size(found)), found, lambda p, m: F.char_length(p) + F.char_length(m))

        def span(x: Column, i: Column) -> Column:
            gap = F.get(between, i)
            start = x["at"] + F.char_length(gap)
            return F.struct(start.alias("start"), (start + F.char_length(x["m"])).alias("end"), x["m"].alias("text"), F.right(gap, F.lit(24)).alias("before"), F.left(F.get(between, i + 1), F.lit(4)).alias("after"))

        return F.transform(F.zip_with(found, let(lengths, lambda v: _running(v)), lambda m, at: F.struct(m.alias("m"), at.alias("at"))), span)

    return let(raw, spans)


#: Columns that hold proposals on their way.
_STEPS = ("__digit", "__at", "__runs", "__email", "__ip", "__phone", "__written", "__local", "__secret", "__flat", "__ends")
_SPAN = "array<struct<start:int,end:int,text:string,before:string,after:string>>"


def _when(cond: Column, text: Column, pattern: str) -> Column:
    """Spans where the cheap test holds, else none."""
    return F.when(cond, find_spans(text, pattern)).otherwise(F.array().cast(_SPAN))


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether up to 19 digits pass the Luhn test."""
    back = F.reverse(digits)
    sums = F.aggregate(
        F.sequence(F.lit(1), F.greatest(F.char_length(back), F.lit(1))),
        F.lit(0),
        lambda a, i: a + (lambda d, twice: F.when(twice & (d > 4), 2 * d - 9).when(twice, 2 * d).otherwise(d))(F.coalesce(F.substring(back, i, F.lit(1)).try_cast("int"), F.lit(0)), i % 2 == 0),
    )
    return (sums % 10) == 0


def _low_parts(ip: Column) -> Column:
    """Whether all parts are at most 255, leading zeros aside."""
    def low(part: Column) -> Column:
        bare = F.regexp_replace(part, "^0+", "")
        return F.coalesce((F.char_length(bare) <= 3) & (F.coalesce(bare.try_cast("int"), F.lit(0)) <= 255), F.lit(False))

    return F.forall(F.split(ip, r"\."), low)


def _card(x: Column) -> Column:
    d = _digits(x)
    return F.when(F.char_length(d).between(16, 19), luhn(d)).otherwise(False)


def propose(docs: DataFrame, text: str) -> DataFrame:
    """``docs`` with __base and __more: spans of the base rules, and further candidates, with kinds."""
    t = F.col(f"`{text}`")
    has_digit = t.rlike("[0-9]")
    d = docs.select("*", has_digit.alias("__digit"), F.contains(t, F.lit("@")).alias("__at"))
    runs, addresses = _when(F.col("__digit"), t, CARD), _when(F.col("__at"), t, EMAIL)
    d = d.select(
        "*", runs.alias("__runs"), addresses.alias("__email"),
        _when(F.col("__digit") & F.contains(t, F.lit(".")), t, IP).alias("__ip"),
        _when(F.col("__digit") & F.contains(t, F.lit("+")), t, PHONE).alias("__phone"),
        _when(F.contains(t, F.lit("(at)")) | F.contains(t, F.lit("[at]")), t, WRITTEN_EMAIL).alias("__written"),
        _when(F.col("__digit"), t, LOCAL_PHONE).alias("__local"),
        _when(F.col("__digit"), t, SECRET).alias("__secret"),
    )

    def kind(name: str, spans: Column) -> Column:
        return F.transform(spans, lambda x: F.struct(F.lit(name).alias("kind"), *(x[c].alias(c) for c in ("start", "end", "text", "before", "after"))))

    phone_digits = lambda x: F.char_length(_digits(x["text"])).between(8, 15)
    base = F.concat(
        kind("email", F.col("__email")),
        kind("ip", F.filter("__ip", lambda x: _low_parts(x["text"]))),
        kind("card", F.filter("__runs", lambda x: _card(x["text"]))),
        kind("phone", F.filter("__phone", phone_digits)),
    )
    more = F.concat(
        kind("email", F.col("__written")),
        kind("card", F.filter("__runs", lambda x: (lambda d: F.char_length(d).between(13, 15) & luhn(d))(_digits(x["text"])))),
        kind("phone", F.col("__local")),
        kind("secret", F.filter("__secret", lambda x: x["text"].rlike("[0-9]"))),
    )
    return d.select(*[F.col(f"`{c}`") for c in docs.columns], base.alias("__base"), more.alias("__more"))


def features(x: Column) -> list[Column]:
    """Format and context features of a candidate struct."""
    t, before, after = x["text"], x["before"], x["after"]
    count = lambda p: F.regexp_count(t, F.lit(p))
    flags = [x["kind"] == k for k in ("email", "card", "phone", "secret")] + [before.rlike(p) for p in CONTEXT.values()]
    near = F.right(before, F.lit(10))
    flags += [near.rlike(p) for p in CONTEXT.values()]
    flags += [before.rlike(r"[=:]\s*[\"']?$"), before.rlike(r"[\"']$"), before.rlike(r"[A-Za-z]$"), before.rlike(r"[#/$€£]\s?$"), after.rlike(r"^[A-Za-z0-9]"), after.rlike(r"^\s?[%€$£]"), after.rlike(r"^[./-][0-9A-Za-z]")]
    flags += [t.rlike("^[0-9a-f]+$"), t.rlike("^[0-9]+$"), t.rlike("^[A-Z0-9]+$"), t.rlike("[a-z]") & t.rlike("[A-Z]"), t.rlike("^[A-Za-z]{2,6}[_A-Z0-9]"), t.rlike(r"^\("), t.rlike(r"[(\[]dot[)\]]"), t.rlike(r"\.[A-Za-z]{2,}$"), t.rlike(r"^[A-Za-z0-9]+(_[a-z0-9]+)+$"), t.rlike(r"[(\[]at[)\]]\x20?[0-9]"), t.rlike("[a-z]{6}"), t.rlike("[a-z]{4,}+[A-Z_][a-z]{3,}+[A-Z_0-9]")]
    changes = F.regexp_count(t, F.lit(r"[A-Za-z](?=[0-9])")) + F.regexp_count(t, F.lit(r"[0-9](?=[A-Za-z])")) + F.regexp_count(t, F.lit(r"[a-z](?=[A-Z])"))
    amounts = [F.char_length(t), count("[0-9]"), count("[A-Za-z]"), count("[A-Z]"), count("_"), count(r"[\x20.()/-]"), changes]
    return [f.cast("double") for f in [*flags, *amounts]]


@dataclass(frozen=True)
class Booster:
    """Trees as nested tuples (feature, threshold, left, right) or leaf values, with weights."""

    trees: tuple
    weights: tuple[float, ...]
    thresholds: dict[str, float]

    def probability(self, f: Column) -> Column:
        def tree(node: tuple | float) -> Column:
            if isinstance(node, float):
                return F.lit(node)
            at, most, left, right = node
            return F.when(F.get(f, F.lit(at)) <= most, tree(left)).otherwise(tree(right))

        margin = F.lit(0.0)
        for t, w in zip(self.trees, self.weights, strict=True):
            margin = margin + F.lit(w) * tree(t)
        return 1 / (1 + F.exp(-2 * margin))

    def threshold(self, kind: Column) -> Column:
        out = F.lit(2.0)
        for k, v in self.thresholds.items():
            out = F.when(kind == k, v).otherwise(out)
        return out


#: Parts of the sample's sentences: what announces a kind, what announces something else, and plain words.
ANNOUNCED = {
    "email": ["my mail is", "contact", "write to", "write", "reach me at", "schreib an", "Kontakt:", "écrivez à", "mon adresse est", "escribe a", "correo:", "send it to", "questions go to", "e-mail", "ask", "from"],
    "card": ["card number", "my visa is", "credit card:", "paid by card", "Kreditkarte", "Karte Nr.", "carte bancaire", "numéro de carte", "tarjeta", "charge it to", "mastercard", "amex"],
    "phone": ["call me on", "ring", "phone:", "tel.", "Tel:", "fax", "mobile", "text me at", "reach us at", "ruf an:", "Telefon", "Nummer", "appelez le", "téléphone :", "llama al", "teléfono", "cell", "my number is", "dial"],
    "secret": ["token =", "api key:", "API_KEY=", "secret =", "password:", "ACCESS=", "access_key_id:", "auth token", "Authorization: Bearer", "Schlüssel:", "clave =", "clé :", "client_secret:", "export TOKEN=", "login with", "credentials", "pwd="],
}
PLAIN = ["order", "invoice", "commit", "sha1", "md5", "digest", "revision", "part number", "serial", "isbn", "case", "ticket", "Rechnung Nr.", "Bestellung", "commande", "pedido", "build", "version", "article", "page", "table", "section", "chapter", "sum of", "about", "between", "ref", "checksum", "blob", "tree", "uuid", "row", "file", "in line", "see", "total", "the function", "calls", "module", "class", "value of", "score", "from", "until", "at", "with", "and"]
_WORDS = "the of a report until which value line section under open near page and der die das und nicht mit von la les et dans pour el los y en con por was here today we they it not more other new last first between through".split()


def labelled_texts(params: PiiParams) -> list[tuple[int, str, int]]:
    """(number, text, label): one candidate each, true ones and look-alikes in context."""
    rng = random.Random(params.seed)
    pick = rng.choice
    digits = lambda n: "".join(pick("0123456789") for _ in range(n))
    name = lambda n: "".join(pick("abcdefghijklmnopqrstuvwxyz") for _ in range(n))
    mixed = lambda n, letters: "".join(pick(letters) for _ in range(n))
    letters = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"

    def with_check(n: int) -> str:
        d = digits(n - 1)
        total = sum((x - 9 if x > 9 else x) for x in (int(c) * (2 - i % 2) for i, c in enumerate(reversed(d))))
        return d + str(-total % 10)

    def email(true: bool) -> str:
        a, d = pick((("(at)", "(dot)"), ("[at]", "[dot]"), ("(at)", "."), ("[at]", ".")))
        gap = pick((" ", "", " "))
        if true:
            own = pick((name(rng.randint(2, 8)), f"{name(5)}.{name(4)}", f"{name(1)}.{name(6)}", f"{name(4)}{digits(2)}"))
            return f"{own}{gap}{a}{gap}{name(rng.randint(2, 9))}{gap if d != '.' else ''}{d}{gap if d != '.' else ''}{pick(('com', 'org', 'net', 'de', 'fr', 'es', 'io', 'info'))}"
        return f"{pick((name(4), name(7), digits(2)))} {a} {pick((digits(1), digits(2), '$' + digits(1)))[-2:]}.{digits(2)}"

    def phone(true: bool) -> str:
        three = (f"({digits(3)}) {digits(3)}-{digits(4)}", f"{digits(3)}-{digits(3)}-{digits(4)}", f"{digits(3)}.{digits(3)}.{digits(4)}", f"{digits(3)} {digits(3)} {digits(4)}")
        if true:
            return pick((*three, *three, f"0{digits(2)} {digits(7)}", f"0{digits(3)}/{digits(6)}", "0" + digits(1) + "".join(" " + digits(2) for _ in range(4))))
        return pick((*three[1:], f"0{digits(1)}.{digits(3)}", f"0{digits(1)}-{digits(2)}", f"0{digits(1)}.{digits(2)}.20{digits(2)}", f"0{digits(1)}/{digits(2)}", f"0.{digits(4)}"[:4] + f" {digits(3)}", f"0{digits(3)}-{digits(4)}"))

    def snake() -> str:
        """An identifier of 20 characters or more: words of any number, and a digit."""
        out = name(rng.randint(2, 8))
        while len(out) < 19:
            out += "_" + name(rng.randint(2, 9))
        return out + pick(("_", "")) + digits(rng.randint(1, 2))

    def camel() -> str:
        out = pick((name(rng.randint(2, 8)), name(rng.randint(3, 9)).title()))
        while len(out) < 19:
            out += name(rng.randint(3, 10)).title()
        return out + digits(rng.randint(1, 2))

    def secret(true: bool, told: bool) -> str:
        if true:
            plain = (mixed(pick((24, 32, 40, 48)), letters), mixed(pick((32, 40)), letters + "_"), *((mixed(pick((32, 40, 64)), "0123456789abcdef"),) if told else ()))
            return pick((*plain, "AKIA" + mixed(16, "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"), f"{pick(('sk', 'pk', 'ghp', 'xoxb', 'key', 'tok'))}_{mixed(pick((24, 36)), letters)}", f"sk_live_{mixed(24, letters)}"))
        return pick((mixed(pick((32, 40, 40, 64)), "0123456789abcdef"), mixed(40, "0123456789abcdef"), digits(rng.randint(20, 30)), snake(), snake(), camel(), camel(), f"{name(22)}{digits(1)}", "_" * 20 + digits(1), f"{mixed(10, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ')}_{mixed(9, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ')}_{digits(1)}"))

    out = []
    for k in range(params.sample):
        kind, true = ("email", "card", "phone", "secret")[k % 4], (k // 4) % 2 == 1
        told = rng.random() < 0.9
        quote = pick(('"', "'")) if kind == "secret" and rng.random() < 0.4 else ""
        if kind == "email":  # the format tells enough
            item, told = email(true), rng.random() < 0.5
        elif kind == "card":
            item, told = " ".join((c := with_check(pick((13, 14, 15, 15))))[i : i + 4] for i in range(0, 16, 4)).strip() if rng.random() < 0.3 else with_check(pick((13, 14, 15, 15))), true
        elif kind == "phone":
            item = phone(true)
            told = (true and told) or (true and item.startswith("("))
            if true and not told:
                item = f"({digits(3)}) {digits(3)}-{digits(4)}"
        else:
            item = secret(true, told)
            told = true and (told or set(item) <= set("0123456789abcdef"))
        hint = pick(ANNOUNCED[kind]) if told and (true or kind == "email") else pick(PLAIN)
        lead = " ".join(pick(_WORDS) for _ in range(rng.randint(0, 4)))
        between = pick((" ", " ", " ", " is ", ": ")) if not hint.endswith("=") else pick(("", "", " "))
        if kind == "secret" and not true and rng.random() < 0.3:
            between = pick((": ", " = ", " "))
        out.append((k, f"{lead} {hint}{between}{quote}{item}{quote}{pick((' ', '. ', ', ', ' '))}{' '.join(pick(_WORDS) for _ in range(rng.randint(0, 3)))}", int(true)))
    return out


_FITTED: dict[PiiParams, Booster] = {}


def fit_booster(spark: SparkSession, params: PiiParams = PiiParams()) -> Booster:
    """Fit on three quarters of the bounded sample, calibrate thresholds on the rest; once a session."""
    if params in _FITTED:
        return _FITTED[params]
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.functions import array_to_vector

    sample = spark.createDataFrame(labelled_texts(params), "n long, text string, label int").coalesce(1)
    rows = propose(sample, "text").select("n", "label", F.explode("__more").alias("c"))
    rows = rows.select("n", F.col("label").cast("double").alias("label"), F.col("c.kind").alias("kind"), F.array(*features(F.col("c"))).alias("f")).withColumn("features", array_to_vector("f")).cache()
    test = F.floor(F.col("n") / 8) % 4 == 0
    model = GBTClassifier(maxIter=params.trees, maxDepth=params.depth, seed=params.seed, stepSize=0.3, cacheNodeIds=False).fit(rows.where(~test))

    def nested(node) -> tuple | float:
        if node.subtreeDepth() == 0:
            return float(node.prediction())
        s = node.split()
        return int(s.featureIndex()), float(s.threshold()), nested(node.leftChild()), nested(node.rightChild())

    trees = tuple(nested(t._java_obj.rootNode()) for t in model.trees)
    booster = Booster(trees, tuple(float(w) for w in model.treeWeights), {})
    held = rows.where(test).select("kind", "label", booster.probability(F.col("f")).alias("p")).collect()
    thresholds = {}
    for kind in KINDS:
        own = sorted(((r.p, r.label) for r in held if r.kind == kind), reverse=True)
        true = total = 0
        for n, (p, label) in enumerate(own):
            true, total = true + label, total + 1
            last = n + 1 == len(own) or own[n + 1][0] < p  # of those with this probability
            if last and true >= params.precision * total:
                thresholds[kind] = p
    rows.unpersist()
    _FITTED[params] = Booster(trees, booster.weights, thresholds)
    return _FITTED[params]


def find_personal_data(docs: DataFrame, text: str = "text", params: PiiParams = PiiParams()) -> DataFrame:
    """``docs`` with ``base_spans`` and ``spans``: arrays of (kind, start, end, score), by kind as in KINDS, then start."""
    booster = fit_booster(docs.sparkSession, params)
    docs = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c not in ("base_spans", "spans", "__base", "__more", "__items") and c not in _STEPS])
    own = [F.col(f"`{c}`") for c in docs.columns]
    rank = lambda k: F.array_position(F.array(*map(F.lit, KINDS)), k)
    found = propose(docs, text)
    base = F.transform("__base", lambda x: F.struct(rank(x["kind"]).alias("rank"), x["start"].alias("start"), x["end"].alias("end"), F.lit(2.0).alias("score")))
    more = F.transform("__more", lambda x: F.struct(x["kind"].alias("kind"), x["start"].alias("start"), x["end"].alias("end"), F.array(*features(x)).alias("f")))
    found = found.select(*own, base.alias("__base"), more.alias("__more"))
    scored = F.transform("__more", lambda x: F.struct(rank(x["kind"]).alias("rank"), x["start"].alias("start"), x["end"].alias("end"), booster.probability(x["f"]).alias("score"), booster.threshold(x["kind"]).alias("least")))
    found = found.select(*own, "__base", F.filter(scored, lambda x: x["score"] >= x["least"]).alias("__more"))
    # candidates that no base span meets: of all in order of their starts, the greatest end before and the least start after
    item = lambda x, base: F.struct(x["start"].alias("start"), F.lit(1 - base).alias("more"), x["rank"].alias("rank"), x["end"].alias("end"), x["score"].alias("score"))
    items = F.array_sort(F.concat(F.transform("__base", lambda x: item(x, 1)), F.transform("__more", lambda x: item(x, 0))))
    found = found.select(*own, "__base", F.when(F.size("__more") > 0, items).otherwise(F.array().cast("array<struct<start:int,more:int,rank:bigint,end:int,score:double>>")).alias("__items"))
    greatest = lambda a, x: F.greatest(a, x)
    far = 2**31 - 1
    ends = let(F.transform("__items", lambda x: F.when(x["more"] == 0, x["end"]).otherwise(0)), lambda v: _running(v, greatest))
    starts = let(F.reverse(F.transform("__items", lambda x: F.when(x["more"] == 0, far - x["start"]).otherwise(0))), lambda v: F.reverse(_running(v, greatest)))
    around = F.zip_with(F.zip_with("__items", ends, lambda x, e: F.struct(x.alias("x"), e.alias("e"))), starts, lambda p, s: F.struct(p["x"].alias("x"), p["e"].alias("e"), (far - s).alias("s")))
    free = F.filter(around, lambda p: (p["x"]["more"] == 1) & (p["e"] <= p["x"]["start"]) & (p["s"] >= p["x"]["end"]))
    free = F.transform(free, lambda p: F.struct(p["x"]["rank"].alias("rank"), p["x"]["start"].alias("start"), p["x"]["end"].alias("end"), p["x"]["score"].alias("score")))
    named = lambda spans: F.transform(F.array_sort(spans), lambda x: F.struct(F.get(F.array(*map(F.lit, KINDS)), x["rank"].cast("int") - 1).alias("kind"), x["start"].alias("start"), x["end"].alias("end"), x["score"].alias("score")))
    return found.select(*own, named(F.col("__base")).alias("base_spans"), named(F.concat("__base", free)).alias("spans"))


def listed(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")


def redact(found: DataFrame, text: str = "text") -> DataFrame:
    """``found`` of find_personal_data with every span of the text replaced by <KIND>, without the span columns.

    Where spans of different kinds overlap, the first to start covers what it
    shares with the next. Texts with many spans are cut as arrays of characters,
    so that each piece costs its own length only.
    """
    t = F.col(f"`{text}`")
    flat = F.array_sort(F.transform("spans", lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["kind"].alias("kind"))))
    rest = [F.col(f"`{c}`") for c in found.columns if c not in ("spans", "base_spans", text)]
    rows = found.select(*rest, t.alias(text), flat.alias("__flat"))
    covered = let(F.transform("__flat", lambda x: x["end"]), lambda ends: _running(ends, lambda a, x: F.greatest(a, x)))  # before each span
    rows = rows.select(*rest, text, "__flat", covered.alias("__ends"))
    mark = lambda x, e: F.when(x["end"] > e, F.concat(F.lit("<"), F.upper(x["kind"]), F.lit(">"))).otherwise("")
    last = F.array_max(F.transform("__flat", lambda x: x["end"]))

    def joined(piece: Callable[[Column, Column], Column]) -> Column:
        """Pieces between the spans, by (first character from 0, length), and the marks."""
        parts = F.zip_with("__flat", "__ends", lambda x, e: F.concat(piece(e, F.greatest(x["start"] - e, F.lit(0))), mark(x, e)))
        return F.concat(F.array_join(parts, ""), piece(last, F.char_length(t)))

    few = joined(lambda at, n: F.substring(t, at + 1, n))
    many = let(F.split(t, ""), lambda c: joined(lambda at, n: F.array_join(F.slice(c, at + 1, n), "")))
    return rows.select(*rest, F.when(F.size("__flat") == 0, t).when(F.size("__flat") <= 32, few).otherwise(many).alias(text))
