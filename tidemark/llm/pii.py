"""Personal data by weak supervision, in DataFrame operations only.

Patterns propose spans; labelers vote on each span for (1), against (-1) or not at all (0):
the pattern with its checks, a gazetteer (top-level domains, country and trunk codes, card issuers,
special address ranges, prefixes of secrets), the words before it, its neighbours, and its form. Spans are
counted per pattern of votes and shape, expectation-maximisation estimates how reliable each
labeler is for each kind without any gold label, and a logistic span classifier is fitted to
the posterior labels, on the votes and on the shape of the span and its surroundings: number of digits, separators,
length, a label before it, whole line. Spans whose patterns pass their checks always stay; the
classifier decides on the others (obfuscated addresses, national telephone numbers, card
numbers with a wrong digit, secrets) where these do not overlap a kept one.

What is collected are counts per pattern of votes and shape, both of a few small numbers,
whatever the size of the corpus. Nothing is shuffled but those counts.

Null text counts as empty and has no span. A very long text is searched whole. Rows are independent: ties,
repeated rows and null ids change nothing, and an empty table gives no rows. Extra columns may be kept; columns
named base or spans give way to the results.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import packed, scratch_table, unpacked, whole_text

# Kinds in their listed order, then those that only the method finds; patterns; word lists of the labelers.
KINDS = ("email", "ip", "card", "phone", "secret")
BASE_KINDS = KINDS[:4]
LOCAL = "A-Za-z0-9._%+-"
#: The contract's patterns, written so that no start inside a run is tried again and nothing is given back:
#: the same leftmost matches in linear time and constant stack.
STRICT = {
    "email": rf"(?:(?<![{LOCAL}])|\G)[{LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)",
    "card": r"[0-9]{2,}+(?:[\x20-][0-9]++)*+|[0-9](?:[\x20-][0-9]++)++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_AT = r"\x20?(?:\(at\)|\[at\]|\{at\}|<at>)\x20?"
_DOT = r"(?:\.|\x20dot\x20|\x20?(?:\(dot\)|\[dot\]|\{dot\}|<dot>)\x20?)"
_SECRET = "(?:api[_-]?key|access[_-]?key|auth[_-]?token|token|secret|passwd|password|passwort|contraseña|mot\\x20de\\x20passe)"
LOOSE = {
    # a bare "at" is a common word, so its dots must be spelled as well
    "email": rf"(?<![{LOCAL}])[{LOCAL}]++(?:{_AT}[A-Za-z0-9-]++(?:{_DOT}[A-Za-z0-9-]++)++|\x20at\x20[A-Za-z0-9-]++(?:\x20dot\x20[A-Za-z0-9-]++)++)",
    "card": r"(?<![0-9.+-])[0-9]{4}(?:[0-9]{9,15}|([\x20-])[0-9]{4}\1[0-9]{4}\1[0-9]{1,7})(?![0-9.-])",
    # 00 and a country; North American; French; Spanish; German with a trunk zero and a gap
    "phone": r"(?<![0-9+.,-])(?:00[1-9][0-9]{0,2}[\x20./()-]{1,2}[0-9][0-9\x20./()-]{6,16}[0-9]"
    r"|\([0-9]{3}\)\x20?[0-9]{3}[\x20.-][0-9]{4}|[0-9]{3}[\x20.-][0-9]{3}[\x20.-][0-9]{4}"
    r"|0[1-9](?:[\x20.-][0-9]{2}){4}|[6789][0-9]{2}(?:[\x20.-][0-9]{3}){2}"
    r"|\(?0[1-9][0-9]{1,4}\)?[\x20/-]{1,3}[0-9]{2,8}(?:[\x20-][0-9]{2,8}){0,3})(?![0-9])",
    "secret": rf"(?i)(?<![A-Za-z]){_SECRET}\x20*[=:]\x20*[\"']?[A-Za-z0-9_./+~-]{{8,}}+",
}
#: A text without this cannot match; the last two are of the looser patterns.
GATE = {"email": r"@|(?i:[(\[{<]at[)\]}>]|\x20at\x20)", "ip": r"[0-9]\.[0-9]", "card": r"[0-9][\x20-]?[0-9]", "phone": r"[0-9]", "secret": rf"(?i){_SECRET}\x20*[=:]"}
GAZETTEER = {
    "email": r"(?i)(?:\.|\(dot\)\x20?|\[dot\]\x20?|\{dot\}\x20?)(?:com|org|net|edu|gov|mil|int|info|biz|io|co|eu|de|fr|es|it|nl|be|ch|at|pt|uk|ie|us|ca|mx|br|ar|au|nz|jp|cn|in|ru|pl|se|no|dk|fi)$",
    "ip": r"^(?!0+\.|255\.|127\.)[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}$",
    "card": r"^(?:4|5[1-5]|2[2-7]|3[4-7]|6(?:011|5|4[4-9]))",
    "phone": r"^(?:\+|00)(?:1|7|20|27|3[0-9]|4[0-9]|5[1-8]|6[0-6]|8[1246]|9[0-58])|^\(?[2-9][0-9]{2}\)?[\x20.-]|^\(?0[1-9]",
    "secret": r"(?:[0-9a-fA-F]{32}|[0-9a-fA-F]{40}|[0-9a-fA-F]{64}|AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{20,}|sk-[A-Za-z0-9]{16,}|xox[abp]-[A-Za-z0-9-]{10,})$",
}
CONTEXT = {
    "email": r"(?i)\b(?:e-?mail|mail|contact|kontakt|write|reach|correo|courriel|adresse?|from|to)\b",
    "ip": r"(?i)\b(?:ip|address|adresse|host|server|client|login|from|addr)\b",
    "card": r"(?i)\b(?:card|karte|carte|tarjeta|visa|mastercard|amex|credit|payment|pay)\b",
    "phone": r"(?i)\b(?:tel|telefon|phone|telephone|telefono|call|fax|mobile|cell|handy|contact|kontakt|móvil|numéro|rufnummer|appelez|llame)\b",
    "secret": r"(?i)\b(?:export|set|config|credentials?|login|env|key)\b",
}
AGAINST = r"(?i)\b(?:version|ver|v|release|section|chapter|isbn|issn|doi|order|invoice|build|page|id|no)\b\W*$"
#: The length of text in front of a span that the context labeler sees.
BEFORE = 40
LABELERS = ("checks", "gazetteer", "context", "neighbours", "form")
_CHUNK = 128


def _digits(v: Column) -> Column:
    return F.regexp_replace(v, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    back = F.reverse(digits)

    def worth(i: Column) -> Column:
        x = F.ascii(F.substring(back, i, F.lit(1))) - 48
        double = F.when(x > 4, x * 2 - 9).otherwise(x * 2)
        return F.when(i % 2 == 0, double).otherwise(x)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), lambda a, i: a + worth(i)) % 10 == 0


def passes(kind: str, v: Column) -> Column:
    """The checks of a kind on a matched string."""
    n = F.length(_digits(v))
    if kind == "email":
        return F.lit(True)
    if kind == "secret":
        # letters and digits mixed, as words are not
        return v.rlike(r"[=:].*[0-9]") & v.rlike(r"[=:].*[A-Za-z]")
    if kind == "ip":
        return v.rlike(r"^(?:0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?:\.(?=[0-9])|$)){4}$")
    if kind == "card":
        return F.when(n.between(12, 19), luhn(_digits(v))).otherwise(False)
    return n.between(9, 15)


def _votes(kind: str, strict: bool, v: Column, before: Column, after: Column) -> list[Column]:
    """One vote of each labeler, in the order of LABELERS."""

    def vote(yes: Column, no: Column) -> Column:
        return F.when(yes, 1).when(no, -1).otherwise(0)

    checked = passes(kind, v)
    digits = _digits(v)
    subject = digits if kind == "card" else v
    known = subject.rlike(GAZETTEER[kind])
    touching = (F.substring(before, -1, 1).rlike(r"[\p{L}0-9_]")) | after.rlike(r"[\p{L}0-9_]")
    form = {
        "email": vote(F.length(v).between(6, 80), F.length(v) > 120),
        "ip": vote(F.length(v).between(7, 15), F.length(v) > 15),
        "card": vote(F.length(digits) == 16, ~F.length(digits).between(12, 19)),
        "phone": vote(F.length(digits).between(9, 13), ~F.length(digits).between(9, 15)),
        "secret": vote(F.length(v) >= 24, F.length(v) < 16),
    }[kind]
    return [
        vote(checked if strict else F.lit(False), ~checked),
        vote(known, ~known),
        vote(before.rlike(CONTEXT[kind]), before.rlike(AGAINST)),
        vote(~touching, touching),
        form,
    ]


def _shape(kind: str, v: Column, before: Column, after: Column) -> list[Column]:
    """The span and its surroundings in small numbers: SHAPE says how many values each has."""
    n, separators = F.length(_digits(v)), F.array_size(F.array_distinct(F.regexp_extract_all(v, F.lit(r"[\x20./()@+-]"), F.lit(0))))
    return [
        F.when(n < 7, 0).when(n < 9, 1).when(n < 10, 2).when(n < 11, 3).when(n < 13, 4).when(n < 16, 5).otherwise(6),
        F.least(separators, F.lit(3)),
        F.when(F.length(v) < 10, 0).when(F.length(v) < 20, 1).when(F.length(v) < 40, 2).otherwise(3),
        F.when(before.rlike(r"[:=#]\s*$"), 2).when(before.rlike(r"(?:^|[\n\r])\s*$"), 1).otherwise(0),
        F.when(after == "", 2).when(after.rlike(r"\s"), 1).otherwise(0),
    ]


#: Values of each number of a shape.
SHAPE = (7, 4, 4, 3, 3)


def _spans(kind: str, pattern: str, strict: bool, text: Column) -> Column:
    """The matches of a pattern in order, as structs with code-point offsets and votes.

    `split` gives the stretches between matches and `regexp_extract_all` the matches; their
    lengths, summed in chunks, are the offsets.
    """
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)

    def build(x: Column) -> Column:
        hits, gaps = x["hits"], x["gaps"]
        sizes = F.transform(hits, lambda h, i: F.length(h) + F.length(F.get(gaps, i)))
        return F.transform(F.array(F.struct(hits.alias("hits"), gaps.alias("gaps"), sizes.alias("sizes"))), place)[0]

    def total(a: Column) -> Column:
        return F.aggregate(a, F.lit(0), lambda s, n: s + n)

    def place(x: Column) -> Column:
        hits, gaps, sizes = x["hits"], x["gaps"], x["sizes"]
        chunks = F.sequence(F.lit(0), F.floor((F.size(hits) - 1) / _CHUNK).cast("int"))
        starts = F.aggregate(
            chunks,
            F.array(F.lit(0)),
            lambda acc, c: F.concat(acc, F.array(F.element_at(acc, -1) + total(F.slice(sizes, c * _CHUNK + 1, F.lit(_CHUNK))))),
        )
        return F.transform(F.array(F.struct(hits.alias("hits"), gaps.alias("gaps"), sizes.alias("sizes"), starts.alias("starts"))), one)[0]

    def one(x: Column) -> Column:
        def span(h: Column, i: Column) -> Column:
            c = F.floor(i / _CHUNK).cast("int")
            start = F.get(x["starts"], c) + total(F.slice(x["sizes"], c * _CHUNK + 1, i % _CHUNK)) + F.length(F.get(x["gaps"], i))
            around = F.substring(F.get(x["gaps"], i), -BEFORE, BEFORE), F.substring(F.get(x["gaps"], i + 1), 1, 1)
            return F.struct(
                start.alias("start"),
                F.lit(KINDS.index(kind)).alias("kind"),
                (start + F.length(h)).alias("end"),
                F.lit(strict).alias("strict"),
                (passes(kind, h) & F.lit(strict)).alias("base"),
                F.array(*_votes(kind, strict, h, *around)).alias("votes"),
                F.array(*_shape(kind, h, *around)).alias("shape"),
            )

        return F.transform(x["hits"], span)

    found = F.transform(F.array(F.struct(hits.alias("hits"), gaps.alias("gaps"))), build)[0]
    return F.when(text.rlike(GATE[kind]) & (F.regexp_instr(text, F.lit(pattern)) > 0), found)


_SPAN = "array<struct<start:int,kind:int,end:int,strict:boolean,base:boolean,votes:array<int>,shape:array<int>>>"


def propose(docs: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """(__row, spans): the `keep` columns in a struct, and every proposed span with its votes."""
    rows = docs.select(packed(docs, keep, "base", "spans"), whole_text(text).alias("__whole"))
    sets = [(k, p, True) for k, p in STRICT.items()] + [(k, p, False) for k, p in LOOSE.items()]
    parts = [F.coalesce(_spans(k, p, s, F.col("__whole")).cast(_SPAN), F.array().cast(_SPAN)) for k, p, s in sets]
    return rows.select("__row", F.concat(*parts).alias("spans"))


# ---- reliabilities and classifier -----------------------------------------------------


#: (kind, strict, votes, shape, count)
Pattern = tuple[int, bool, tuple[int, ...], tuple[int, ...], int]


def estimate(patterns: list[Pattern], rounds: int = 40) -> dict:
    """EM over counted patterns.

    Per kind: the share of true spans and each labeler's reliability, the chance that a vote
    is right. Labelers start at 0.8 and stay within 0.55 and 0.99, so that a true span keeps its meaning.
    """
    model = {}
    for kind in range(len(KINDS)):
        rows = [(v, n) for k, _, v, _, n in patterns if k == kind]
        prior, right = 0.5, [0.8] * len(LABELERS)
        for _ in range(rounds if rows else 0):
            mass, good, cast = 0.0, [1.6] * len(LABELERS), [2.0] * len(LABELERS)
            for v, n in rows:
                p = posterior(v, prior, right)
                mass += n * p
                for j, x in enumerate(v):
                    if x:
                        good[j] += n * (p if x > 0 else 1 - p)
                        cast[j] += n
            prior = min(0.95, max(0.05, (mass + 1) / (sum(n for _, n in rows) + 2)))
            right = [min(0.99, max(0.55, g / c)) for g, c in zip(good, cast)]
        model[kind] = (prior, right)
    return model


def posterior(votes: tuple[int, ...], prior: float, right: list[float]) -> float:
    odds = math.log(prior / (1 - prior))
    for x, a in zip(votes, right):
        odds += x * math.log(a / (1 - a))
    return 1 / (1 + math.exp(-max(-500.0, min(500.0, odds))))


def features(kind: int, strict: bool, votes: tuple[int, ...], shape: tuple[int, ...]) -> list[float]:
    """Bias, kinds, form of pattern, votes, whether most labelers that speak agree, and the shape, a column for each of its values and kinds."""
    shaped = [0.0] * (sum(SHAPE) * len(KINDS))
    at = sum(SHAPE) * kind
    for n, x in zip(SHAPE, shape):
        shaped[at + x] = 1.0
        at += n
    return [1.0, *[float(kind == k) for k in range(len(KINDS))], float(strict), *map(float, votes), float(sum(votes) > 0), *shaped]


def fit(patterns: list[Pattern], model: dict, rounds: int = 300, rate: float = 0.5, ridge: float = 1e-3) -> list[float]:
    """Logistic regression on the posterior labels of the counted patterns, by gradient descent. Each kind has the same weight."""
    if not patterns:
        return [0.0] * len(features(0, True, (0,) * len(LABELERS), (0,) * len(SHAPE)))
    x = np.array([features(k, s, v, f) for k, s, v, f, _ in patterns])
    y = np.array([posterior(v, *model[k]) for k, _, v, _, _ in patterns])
    kind = np.array([p[0] for p in patterns])
    n = np.array([float(p[4]) for p in patterns])
    n /= np.bincount(kind, weights=n)[kind] * len(set(kind.tolist()))
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -500, 500)))
        w = w + rate * (x.T @ ((y - p) * n) - ridge * w)
    return w.tolist()


def accepted(w: list[float], patterns: list[Pattern]) -> list[Pattern]:
    """The patterns of looser spans that the classifier takes for true."""
    return [p for p in patterns if not p[1] and sum(a * b for a, b in zip(w, features(*p[:4]))) >= 0]


def _code(kind: int, votes: tuple[int, ...], shape: tuple[int, ...]) -> str:
    return f"{kind}:{','.join(map(str, votes))}:{','.join(map(str, shape))}"


def detect(docs: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The `keep` columns with `base` and `spans`: arrays of (start, kind, end), `kind` an index of KINDS, in order."""
    found = scratch_table(propose(docs, text, keep), "spans")
    counted = found.select(F.explode("spans").alias("s")).groupBy("s.kind", "s.strict", "s.votes", "s.shape").count().collect()
    patterns = sorted((r["kind"], r["strict"], tuple(r["votes"]), tuple(r["shape"]), r["count"]) for r in counted)
    weights = fit(patterns, estimate(patterns))
    good = sorted({_code(k, v, f) for k, _, v, f, _ in accepted(weights, patterns)})
    code = lambda s: F.concat_ws(":", s["kind"].cast("string"), F.concat_ws(",", s["votes"].cast("array<string>")), F.concat_ws(",", s["shape"].cast("array<string>")))
    short = lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"))
    base = F.array_sort(F.transform(F.filter("spans", lambda s: s["base"]), short))
    rows = found.select("__row", base.alias("base"), F.filter("spans", lambda s: ~s["strict"]).alias("__loose"))
    clear = lambda s: ~F.exists("base", lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"]))
    added = F.filter("__loose", lambda s: code(s).isin(good) & clear(s)) if good else F.filter("__loose", lambda s: F.lit(False))
    return unpacked(rows, "base", F.array_sort(F.concat("base", F.transform(added, short))).alias("spans"))


def spelled(spans: str) -> Column:
    """kind:start:end of each span, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))))
