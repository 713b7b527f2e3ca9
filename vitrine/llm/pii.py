"""Personal data by weak supervision: labelers vote, EM weighs them, a classifier decides.

Exact patterns give the base spans, which always stay. Looser patterns give further candidates:
phone and card numbers in other forms, spelled-out addresses, IBANs, social security numbers,
IPv6 addresses and secrets. On every candidate, base or not, five labelers vote yes, no or nothing,
each on evidence of its own:

* check: check digits and number rules (Luhn, IBAN modulo 97, areas of social security numbers);
* gazetteer: endings of domains, calling codes, card issuers, IBAN countries, key prefixes,
  reserved addresses;
* left and right: words before and after the span;
* variety: whether its characters vary too little for a real one (0000000, 12345678); it only
  votes no, since a checksum varies as much as a key.

None of them knows whether a span is a base span. Expectation-maximisation over the counts of vote
patterns (at most 3^5 per kind, whatever the size of the corpus) estimates each labeler's
reliability; its posteriors train a logistic span classifier. That one sees the votes and what no
labeler reads: length, shares of upper case and of distinct characters, separators, and the
characters beside the span. It is compiled into a column expression and adds spans. DataFrame
functions only; the corpus never leaves the executors.

Null and empty texts have no spans. Repeated rows stay, rows without a key too. Other columns are
carried in one struct, so none can clash with a working name.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.binding import let
from ..session import cut

KINDS = ("email", "ip", "card", "phone")
ALL_KINDS = (*KINDS, "iban", "ssn", "ipv6", "secret")
LABELERS = ("check", "gazetteer", "left", "right", "variety")
#: What the classifier sees besides the votes, and the numbers each feature can be.
FEATURES = {"size": 8, "upper": 2, "distinct": 4, "parts": 4, "before": 4, "after": 3}
#: A candidate that is no base span is added from this probability on.
ADD_FROM = 0.9
LEFT_CHARS, CLOSE_CHARS, RIGHT_CHARS = 32, 14, 16
#: Bounds of a labeler's reliability, and of the share of true candidates of a kind.
RELIABILITY, SHARE = (0.7, 0.99), (0.1, 0.9)
#: Distinct patterns of votes and features that the classifier is fitted on: the most frequent ones.
TRAIN_PATTERNS = 100_000

# The patterns of the base spans. \G lets a span start where the last one ended;
# else the look-behind makes it start where its run of characters starts, so that a long run
# without a match is looked at once. Possessive repeats never need to give back here.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
NEEDS = {"email": "@", "phone": "+"}
LOOSE = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+ ?[\[(](?:at|AT)[\])] ?[A-Za-z0-9-]{1,63}+(?: ?(?:[\[(](?:dot|DOT)[\])]|\.) ?[A-Za-z0-9-]{1,63}+){1,5}+",
    "card": r"(?<![0-9A-Za-z.+-])[0-9]{13,19}+(?![0-9A-Za-z]|[.-][0-9])",
    "phone": r"(?<![0-9A-Za-z+./-])(?:\([0-9]{3,5}\)|0[0-9]{2,4}|[0-9]{3})[ ./-][0-9]{3,8}(?:[ .-][0-9]{2,4}){0,2}(?![0-9A-Za-z]|[./-][0-9])",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "ssn": r"(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-])",
    "ipv6": r"(?<![0-9A-Za-z:.])[0-9A-Fa-f]{0,4}+:[0-9A-Fa-f:]{4,36}+(?![0-9A-Za-z:.])",
    "secret": r"(?<![A-Za-z0-9_+/-])(?:[0-9a-f]{32,128}|[0-9A-F]{32,128}|AKIA[A-Z0-9]{12,60}|(?:sk|pk|rk|ghp|gho|ghs|glpat|xox[abprs])[-_][A-Za-z0-9_-]{12,120})(?![A-Za-z0-9_+/-])"
    r"|(?i:password|passwd|passphrase|passwort|contrase\u00f1a)[\"']? ?[:=] ?[\"']?[^\s\"',;]{6,64}",
}
LOOSE_NEEDS = {
    "email": r"[\[(](?:at|AT)[\])]", "card": "[0-9]{13}", "phone": "[0-9]{3}[) ./-]", "iban": "[A-Z]{2}[0-9]{2}", "ssn": "[0-9]-[0-9]{2}-[0-9]", "ipv6": ":[0-9A-Fa-f:]*:",
    "secret": "[0-9a-f]{32}|[0-9A-F]{32}|AKIA|(?:sk|pk|rk|ghp|gho|ghs|glpat|xox[abprs])[-_][A-Za-z0-9_]|(?i:passw|passphrase|contrase)",
}

# What the labelers know.
TLDS = (
    "com", "org", "net", "edu", "gov", "mil", "int", "info", "biz", "name", "pro", "mobi", "app", "dev", "cloud", "online", "site", "store", "shop", "tech", "xyz", "club", "blog", "news", "email",
    "live", "agency", "studio", "design", "digital", "media", "network", "systems", "solutions", "services", "group", "company", "global", "world", "life", "today", "zone", "space", "website", "host",
    "page", "link", "top", "vip", "work", "team", "software", "engineering", "consulting", "finance", "bank", "legal", "health", "care", "academy", "school", "university", "education", "museum", "travel",
)
CALLING_CODE = (
    r"^(?:1|7|2(?:0|7|[1-6][0-9]|9[01789])|3(?:[0-469]|[578][0-9])|4(?:[013-9]|2[013])|5(?:[1-8]|0[0-9]|9[0-9])|6(?:[0-6]|[78][0-9]|9[0-2])"
    r"|8(?:[1246]|5[02356]|80)|9(?:[0-58]|6[0-8]|7[0-79]|9[2-68]))"
)
CARD_ISSUER = r"^(?:4|5[1-5]|222[1-9]|22[3-9]|2[3-6]|27[01]|2720|3[47]|35|30[0-5]|36|38|6011|65|64[4-9])"
RESERVED_IP = r"^(?:0|10|127|169\.254|192\.168|172\.(?:1[6-9]|2[0-9]|3[01])|2(?:2[4-9]|3[0-9]|4[0-9]|5[0-5]))\."
IBAN_CHARS = {
    "AD": 24, "AE": 23, "AT": 20, "BE": 16, "BG": 22, "CH": 21, "CY": 28, "CZ": 24, "DE": 22, "DK": 18, "EE": 20, "ES": 24, "FI": 18, "FR": 27, "GB": 22, "GR": 27, "HR": 21, "HU": 28, "IE": 22,
    "IL": 23, "IS": 26, "IT": 27, "LI": 21, "LT": 20, "LU": 20, "LV": 21, "MC": 27, "MT": 31, "NL": 18, "NO": 15, "PL": 28, "PT": 25, "RO": 24, "SA": 24, "SE": 24, "SI": 19, "SK": 24, "SM": 27, "TR": 26,
}
KEY_PREFIX = r"^(?:AKIA|sk[-_]|pk[-_]|rk[-_]|gh[pos][-_]|glpat[-_]|xox[abprs][-_])|^(?i:passw|passphrase|contrase)"
YES_LEFT = (
    r"\b(?:e-?)?mail|phone|\btel\b|tel[.:]|\bmobil|\bcell\b|\bcall|\bfax\b|\b(?:credit )?card\b|\bvisa\b|kreditkarte|\bcarte\b|tarjeta|\bhost\b|\bip\b|\baddress|\badresse|\btoken|secret|password|passwd"
    r"|passwort|api.?key|credential|\bcontact|\bkontakt|t.l.phone|tel.fono|telefon|\biban\b|\baccount\b|\bkonto|\bcompte\b|\bcuenta\b|\bssn\b|social security|\binsurance\b"
)
NO_LEFT = (
    r"\bversion|\bv\.|\bisbn\b|\bissn\b|\bdoi\b|\border\b|\binvoice|\bpages?\b|\bfigure\b|\bsection\b|\bsha-?[0-9]|\bsha\b|\bmd5\b|\bcommit\b|checksum|\bdigest\b|\bhash\b|\betag\b|\bbuild\b|\brevision\b"
    r"|\bserial\b|\blicen[sc]e|\blizenz|\bpart\b|\bsku\b|\bticket\b|\btracking\b|\brechnung|\bbestell|\bfacture\b|\bcommande\b|\bfactura\b|\bpedido\b|\bexample\b|\bbeispiel\b|\bdate\b|\bdatum\b"
)
YES_RIGHT = r"^[^A-Za-z0-9]{0,3}(?:is my|ist mein|\(?(?:mobile|home|office|work|cell|direct|privat|mobil)\b|ext\b|extension)"
NO_RIGHT = r"^[^A-Za-z0-9]{0,2}(?:%|km\b|kg\b|mm\b|cm\b|[kmgt]b\b|usd\b|eur\b|euros?\b|dollars?\b|years?\b|pages?\b|bytes?\b|items?\b|revision\b|checksum\b|sha(?:-?[0-9]|\b)|md5\b|commit\b|\.(?:tar|zip|gz|jpe?g|png|pdf)\b)"
RUN_OF_DIGITS = r"0123456|1234567|2345678|3456789|9876543|8765432|7654321"
SPAN = "array<struct<kind:string,s:int,e:int,m:string,l:string,r:string>>"


def _cuts(text: Column, kind: str, pattern: str) -> Column:
    """kind, start, end, match and what stands beside each match: text between matches gives the places."""
    gaps, hits = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    empty = F.struct(F.lit(0).alias("at"), F.array().cast(SPAN).alias("out"))

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["g"])
        end = start + F.length(x["m"])
        span = F.struct(F.lit(kind).alias("kind"), start.alias("s"), end.alias("e"), x["m"].alias("m"), F.right(x["g"], F.lit(LEFT_CHARS)).alias("l"), F.left(x["n"], F.lit(RIGHT_CHARS)).alias("r"))
        return F.struct(end.alias("at"), F.concat(acc["out"], F.array(span)).alias("out"))

    with_next = let(gaps, lambda g: F.zip_with(g, F.slice(g, 2, F.greatest(F.size(g) - 1, F.lit(0))), lambda a, b: F.struct(a.alias("g"), b.alias("n"))))
    pairs = F.filter(F.zip_with(with_next, hits, lambda g, m: F.struct(g["g"].alias("g"), g["n"].alias("n"), m.alias("m"))), lambda x: x["m"].isNotNull())
    return F.aggregate(pairs, empty, step, lambda acc: acc["out"])


def luhn(digits: Column) -> Column:
    """Whether a text of digits passes the Luhn check."""
    def digit(i: Column) -> Column:
        return let(F.substring(digits, -i, 1).cast("int"), lambda d: F.when(i % 2 == 1, d).otherwise(2 * d - F.when(d > 4, 9).otherwise(0)))

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), lambda acc, i: acc + digit(i)) % 10 == 0


def iban_check(text: Column) -> Column:
    """Whether an IBAN without spaces is 1 modulo 97, its first four characters read last and letters as 10 to 35."""
    def add(acc: Column, c: Column) -> Column:
        return F.when(c.between("0", "9"), (acc * 10 + c.cast("int")) % 97).otherwise((acc * 100 + F.ascii(c) - 55) % 97)

    turned = F.concat(F.substring(text, 5, 64), F.substring(text, 1, 4))
    return F.aggregate(F.filter(F.split(turned, ""), lambda c: c != ""), F.lit(0), add) == 1


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _valid(kind: str, m: Column) -> Column:
    """Whether a match of a base pattern is a base span."""
    if kind == "ip":
        part = lambda p: let(F.regexp_replace(p, "^0+(?=.)", ""), lambda z: F.when(F.length(z) <= 3, z.cast("int") <= 255).otherwise(F.lit(False)))
        return F.forall(F.split(m, r"\."), part)
    if kind == "card":
        return let(_digits(m), lambda d: F.when(F.length(d).between(13, 19), luhn(d)).otherwise(F.lit(False)))
    if kind == "phone":
        return F.length(_digits(m)).between(9, 15)
    return F.lit(True)


def _possible(kind: str, m: Column) -> Column:
    """Whether a match of a loose pattern is a candidate at all."""
    if kind == "phone":
        return F.length(_digits(m)).between(9, 15)
    if kind == "ipv6":
        return let(F.split(m, ":", -1), lambda p: F.forall(p, lambda x: F.length(x) <= 4) & ((F.size(p) == 8) | (m.contains("::") & (F.size(p) <= 8) & m.rlike("[0-9A-Fa-f]"))))
    return F.lit(True)


def _match_that(test, kind: str):
    return lambda x: test(kind, x["m"])


def _vote(yes: Column, no: Column) -> Column:
    return F.when(no, -1).when(yes, 1).otherwise(0)


def _votes(x: Column) -> dict[str, Column]:
    """One vote of 1, 0 or -1 of each labeler on a candidate."""
    kind, m, left, right, digits = x["kind"], x["m"], F.lower(x["l"]), F.lower(x["r"]), _digits(x["m"])
    bare = F.regexp_replace(m, " ", "")
    never = F.lit(False)

    def by_kind(**votes: Column) -> Column:
        out = None
        for name, vote in votes.items():
            out = F.when(kind == name, vote) if out is None else out.when(kind == name, vote)
        return out.otherwise(0)

    passes = luhn(digits)
    iban = iban_check(bare)
    area = digits.rlike(r"^(?!000|666|9)[0-9]{3}(?!00)[0-9]{2}(?!0000)[0-9]{4}$")
    check = by_kind(card=_vote(passes, ~passes), iban=_vote(iban, ~iban), ssn=_vote(area, ~area), ip=_vote(never, m.rlike(r"(?:^|\.)0[0-9]|\.0$|^0\.")))
    ending = F.lower(F.regexp_extract(m, r"([A-Za-z0-9-]+)[\])]?$", 1))
    known = ending.isin(*TLDS) | ending.rlike("^[a-z]{2}$")
    size = F.create_map(*[F.lit(v) for pair in IBAN_CHARS.items() for v in pair])
    country = F.coalesce(F.try_element_at(size, F.substring(m, 1, 2)) == F.length(bare), F.lit(False))
    issuer, plus = digits.rlike(CARD_ISSUER), m.startswith("+")
    gazetteer = by_kind(
        email=_vote(known, ~known), card=_vote(issuer, ~issuer), iban=_vote(country, ~country), phone=_vote((plus & digits.rlike(CALLING_CODE)) | m.rlike(r"^\(?0"), plus & ~digits.rlike(CALLING_CODE)),
        ip=_vote(never, m.rlike(RESERVED_IP)), ipv6=_vote(m.rlike("^[23][0-9A-Fa-f]{3}:"), m.rlike("^(?i:fe[89ab]|f[cd]|::1$|2001:db8)")), secret=_vote(m.rlike(KEY_PREFIX), never))
    # How many different characters a span has, and whether they run up or down.
    kinds_of = F.size(F.array_distinct(F.split(F.lower(F.regexp_replace(m, "[^A-Za-z0-9]", "")), "")))
    runs = digits.rlike(RUN_OF_DIGITS) | digits.rlike(r"([0-9])\1{6}")
    few = {"card": 4, "phone": 3, "ssn": 3, "iban": 4, "secret": 8}
    variety = by_kind(**{name: _vote(never, ((kinds_of <= most) | runs) & ~m.rlike(r"^(?i:passw|passphrase|contrase)")) for name, most in few.items()})
    # The nearest words count first.
    close = let(F.right(left, F.lit(CLOSE_CHARS)), lambda c: _vote(c.rlike(YES_LEFT), c.rlike(NO_LEFT)))
    return {"check": check, "gazetteer": gazetteer, "left": F.when(close != 0, close).otherwise(_vote(left.rlike(YES_LEFT), left.rlike(NO_LEFT))), "right": _vote(right.rlike(YES_RIGHT), right.rlike(NO_RIGHT)), "variety": variety}


def _features(x: Column) -> dict[str, Column]:
    """What no labeler reads, as small numbers."""
    m = x["m"]
    share = lambda pattern: F.length(F.regexp_replace(m, pattern, "")) / F.length(m)
    last, first = F.right(F.rtrim(x["l"]), F.lit(1)), F.left(x["r"], F.lit(1))
    distinct = F.size(F.array_distinct(F.split(m, ""))) / F.length(m)
    return {
        "size": F.least(F.floor(F.length(m) / 8), F.lit(7)).cast("int"), "upper": (share("[^A-Z]") > 0.3).cast("int"), "distinct": F.least(F.floor(distinct * 4), F.lit(3)).cast("int"),
        "parts": F.least(F.length(F.regexp_replace(m, "[A-Za-z0-9]", "")), F.lit(3)).cast("int"),
        "before": F.when(last.isin(":", "="), 1).when(last.rlike(r"[\"'(\[<#]"), 2).when(last.rlike("[0-9A-Za-z]") | (last == ""), 0).otherwise(3),
        "after": F.when(first.rlike(r"^[\s,;.!?)\]\"'>]") | (first == ""), 0).when(first.rlike("[0-9A-Za-z]"), 2).otherwise(1),
    }


def _candidate(base: bool):
    """kind, s, e, base, the votes and the features of a span."""
    return lambda x: F.struct(
        x["kind"].alias("kind"), x["s"].alias("s"), x["e"].alias("e"), F.lit(base).alias("base"),
        F.struct(*[v.cast("int").alias(n) for n, v in {**_votes(x), **_features(x)}.items()]).alias("v"))


def detect(docs: DataFrame, key: str = "doc_id", text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``doc`` (the row's columns in ``keep``, all by default, as a struct), ``id`` (its key) and ``found``: kind, s, e, base and votes of each candidate.

    A looser candidate that touches a base span is dropped. Offsets count code points.
    """
    none = F.array().cast(SPAN)
    rows = docs.select(F.struct(*(keep or docs.columns)).alias("doc"), F.col(key).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    t = F.col("t")
    spans = {}
    for kind in KINDS:
        needed = t.contains(NEEDS[kind]) if kind in NEEDS else t.rlike("[0-9]")
        spans[f"base_{kind}"] = F.when(needed, F.filter(_cuts(t, kind, BASE[kind]), _match_that(_valid, kind))).otherwise(none)
    for kind, pattern in LOOSE.items():
        spans[f"loose_{kind}"] = F.when(t.rlike(LOOSE_NEEDS[kind]), F.filter(_cuts(t, kind, pattern), _match_that(_possible, kind))).otherwise(none)
    rows = rows.withColumns(spans)
    rows = rows.withColumns({"base": F.concat(*(f"base_{k}" for k in KINDS)), "loose": F.concat(*(f"loose_{k}" for k in LOOSE))})
    free = F.filter("loose", lambda x: ~F.exists("base", lambda b: (b["s"] < x["e"]) & (x["s"] < b["e"])))
    return rows.select("doc", "id", F.concat(F.transform("base", _candidate(True)), F.transform(free, _candidate(False))).alias("found"))


def reliabilities(patterns: list[tuple[str, tuple[int, ...], int]], rounds: int = 50) -> tuple[dict, dict]:
    """EM over (kind, votes, count): the posterior of each pattern, and P(yes | true) and P(no | false) by kind and labeler.

    A labeler that does not vote says nothing either way. Most candidates have one or two votes, which
    alone cannot tell a reliable labeler from its opposite; so each is held to be right between 70 and
    99 times of a hundred on either side, and the share of true candidates of a kind between 10 and
    90 %. Before anything is seen a labeler is taken to be right four times of five; that belief
    weighs a fiftieth of the candidates.
    """
    posterior, tables = {}, {}
    for kind in {p[0] for p in patterns}:
        own = [p for p in patterns if p[0] == kind]
        votes, counts = np.array([p[1] for p in own]), np.array([p[2] for p in own], dtype=float)
        weight = counts.sum() / 50 + 1
        q = np.clip(0.5 + 0.2 * votes.sum(axis=1), 0.05, 0.95)  # start from the majority
        for _ in range(rounds):
            prior = np.clip(counts @ q / counts.sum(), *SHARE)
            log = np.log(prior / (1 - prior)) * np.ones(len(own))
            right = np.empty((votes.shape[1], 2))  # P(yes | true), P(no | false)
            for j in range(votes.shape[1]):
                yes, no = votes[:, j] == 1, votes[:, j] == -1
                for side, (hit, miss, p) in enumerate(((yes, no, q), (no, yes, 1 - q))):
                    good, bad = counts @ (hit * p) + 0.8 * weight, counts @ (miss * p) + 0.2 * weight
                    right[j, side] = np.clip(good / (good + bad), *RELIABILITY)
                log += yes * np.log(right[j, 0] / (1 - right[j, 1])) + no * np.log((1 - right[j, 0]) / right[j, 1])
            q = 1 / (1 + np.exp(-np.clip(log, -30, 30)))
        tables[kind] = right
        posterior |= {(kind, p[1]): float(x) for p, x in zip(own, q, strict=True)}
    return posterior, tables


def _cells() -> list[tuple[str, int]]:
    """(column, value) of each input of the classifier: kinds, votes against and for, and all but the first value of each feature."""
    return [*(("kind", k) for k in ALL_KINDS), *((n, v) for n in LABELERS for v in (-1, 1)), *((n, v) for n, values in FEATURES.items() for v in range(1, values))]


def fit(found: DataFrame, most: int = TRAIN_PATTERNS) -> np.ndarray:
    """Weights of the span classifier, trained on the posteriors of the candidates' vote patterns.

    The driver sees counts: of vote patterns, all of them, and of the ``most`` frequent patterns of
    votes and features together.
    """
    seen = found.select(F.explode("found").alias("x")).select("x.kind", "x.v.*").groupBy("kind", *LABELERS, *FEATURES).count()
    cells = _cells()
    # A candidate that no labeler votes on teaches nothing; the classifier still judges it.
    seen = seen.where(" OR ".join(f"{n} <> 0" for n in LABELERS))
    votes = seen.groupBy("kind", *LABELERS).agg(F.sum("count").alias("count")).collect()
    if not votes:
        return np.zeros(1 + len(cells))
    posterior, _ = reliabilities(sorted((r["kind"], tuple(r[n] for n in LABELERS), r["count"]) for r in votes))
    rows = seen.orderBy(F.desc("count"), "kind", *LABELERS, *FEATURES).limit(most).collect()
    x = np.array([[1.0, *(r[c] == v for c, v in cells)] for r in rows], dtype=float)
    y = np.array([posterior[r["kind"], tuple(r[n] for n in LABELERS)] for r in rows])
    n = np.array([r["count"] for r in rows], dtype=float)
    w, n = np.zeros(x.shape[1]), n / n.sum()
    ridge = 1e-4 * np.eye(x.shape[1])
    for _ in range(40):  # Newton steps
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (n * p * (1 - p))[:, None]).T @ x + ridge, x.T @ (n * (y - p)) - ridge @ w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return w


def probability(weights: np.ndarray, x: Column) -> Column:
    """The classifier as a column expression over a candidate."""
    total = F.lit(float(weights[0]))
    for (name, value), w in zip(_cells(), weights[1:], strict=True):
        total += F.when((x["kind"] if name == "kind" else x["v"][name]) == value, float(w)).otherwise(0.0)
    return 1 / (1 + F.exp(-total))


def _spans(docs: DataFrame, key: str, text: str, add_from: float, keep: list[str] | None = None) -> DataFrame:
    """``doc``, ``id`` and ``spans``: o (order of the kind), s, e, kind, base."""
    found = cut(detect(docs, key, text, keep))
    weights = fit(found)
    chosen = F.filter("found", lambda x: x["base"] | (probability(weights, x) >= add_from))
    slim = F.transform(chosen, lambda x: F.struct(
        F.array_position(F.array(*map(F.lit, ALL_KINDS)), x["kind"]).alias("o"), x["s"].alias("s"), x["e"].alias("e"), x["kind"].alias("kind"), x["base"].alias("base")))
    return found.select("doc", "id", F.array_sort(slim).alias("spans"))


def find(docs: DataFrame, key: str = "doc_id", text: str = "text", add_from: float = ADD_FROM) -> DataFrame:
    """The key and ``spans``: kind, s, e, base of all spans, by kind and start, a row per row."""
    return _spans(docs, key, text, add_from, [key]).select(F.col("id").alias(key), "spans")


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["s"].cast("string"), x["e"].cast("string"))), ",")


def digests(found: DataFrame, key: str = "doc_id") -> DataFrame:
    base = F.filter("spans", lambda x: x["base"])
    count = lambda kind: F.size(F.filter("spans", lambda x: x["base"] & (x["kind"] == kind))).cast("long").alias(f"n_{kind}")
    return found.select(key, *map(count, KINDS), F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


def redact(docs: DataFrame, key: str = "doc_id", text: str = "text", add_from: float = ADD_FROM) -> DataFrame:
    """``docs`` with every span replaced by its kind in brackets; spans that overlap become one.

    All other columns come back as they are, whatever their names; a column ``n_chars`` counts the
    new text.
    """
    rows = _spans(docs, key, text, add_from)
    t = F.col("doc")[text]
    named = F.array_sort(F.transform("spans", lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), x["kind"].alias("kind"))))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))
    step = lambda a, x: F.when(x["s"] >= a["at"], F.struct(x["e"].alias("at"), F.concat(a["out"], F.array(
        F.concat(F.substring(t, a["at"] + 1, x["s"] - a["at"]), F.lit("["), F.upper(x["kind"]), F.lit("]")))).alias("out"))
    ).otherwise(F.struct(F.greatest(a["at"], x["e"]).alias("at"), a["out"].alias("out")))
    done = F.aggregate(named, start, step, lambda a: F.concat(F.array_join(a["out"], ""), F.substring(t, a["at"] + 1, F.length(t))))
    cleaned = rows.select("doc", F.when(F.size("spans") > 0, done).otherwise(t).alias("cleaned"))
    columns = [F.col("doc")[c].alias(c) for c in docs.columns]
    for i, c in enumerate(docs.columns):
        if c == text:
            columns[i] = F.col("cleaned").alias(c)
        elif c == "n_chars":
            columns[i] = F.length("cleaned").cast(docs.schema[c].dataType).alias(c)
    return cleaned.select(*columns)
