"""Personal data by weak supervision, in DataFrame functions only.

Base patterns (email, ip, card, phone) are always spans. Further candidates are what the base patterns
find but their rules refuse, and what wider patterns propose: bracketed e-mail addresses, phone numbers
without a country code, social security numbers, IBANs, names by gazetteer and street addresses. Five
labelers vote on every candidate (1 personal data, -1 not, 0 abstains): its regex, a check of its form,
a gazetteer, the words around in four languages, and its borders. Votes are counted by kind and
pattern, a table bounded by the number of labelers and kinds, and expectation-maximisation over it
estimates each labeler's reliability for each kind. The posteriors then weight the counts that a naive Bayes span
classifier is trained from. A candidate beyond the base is a span if the classifier says so; its
coefficients are literals in the scan that emits the spans.

Lists of matches are walked in chunks (`scan`), and the words around a match are cut from the gap beside it, so
the time for a long text stays close to linear in its length and matches.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from helixlake.durable import durable

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "ssn", "iban", "name", "address")
#: Base patterns. Possessive and anchored at run starts where that can't change a match: no
#: quadratic time on long runs and no recursion on long repetitions.
_LOCAL = r"[A-Za-z0-9._%+-]"
BASE = {
    "email": rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: A text without these can't match.
NEEDS = {"email": "@", "ip": ".", "card": "", "phone": "+"}
#: Gazetteer: fixed values, as text.
TOP_DOMAINS = "com org net edu gov mil int info biz io co uk de fr es it nl be ch at pl se no fi dk pt ie us ca au nz jp cn in br mx ru eu"
IBAN_COUNTRIES = "AD AT BE BG CH CY CZ DE DK EE ES FI FR GB GR HR HU IE IS IT LI LT LU LV MC MT NL NO PL PT RO SE SI SK SM"
TITLES = "Mr Mrs Ms Dr Prof Herr Frau Monsieur Madame Mademoiselle Señor Señora Don Doña"
FIRST_NAMES = "James John Robert Michael William David Richard Thomas Mary Patricia Jennifer Linda Elizabeth Barbara Susan Sarah Peter Hans Klaus Wolfgang Jürgen Anna Ursula Petra Sabine Monika Jean Pierre Michel André Philippe Marie Nathalie Isabelle Sylvie Catherine José Antonio Manuel Francisco Juan María Carmen Josefa Isabel Dolores"
WIDER = {
    "email": rf"(?<!{_LOCAL}){_LOCAL}++\s?[\[({{]at[\])}}]\s?[A-Za-z0-9-]++(?:\s?(?:[\[({{]dot[\])}}]|\.)\s?[A-Za-z0-9-]++)++",
    "phone": r"(?<![0-9+(-])(?:\([0-9]{3}\)\x20?|[0-9]{3}[\x20.-])[0-9]{3}[\x20.-][0-9]{4}(?![0-9-])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){3,7}+(?:\x20?[A-Z0-9]{1,3})?+(?![A-Za-z0-9])",
    "name": rf"(?<!\p{{L}})(?=\p{{Lu}})(?:(?:{TITLES.replace(' ', '|')})\.?\x20\p{{Lu}}\p{{Ll}}++|(?:{FIRST_NAMES.replace(' ', '|')})\x20\p{{Lu}}\p{{Ll}}++)(?:[\x20-]\p{{Lu}}\p{{Ll}}++)?+(?!\p{{L}})",
    "address": r"(?<![\p{L}0-9])(?:[0-9]{1,5}\x20(?:\p{Lu}\p{Ll}++\x20){1,3}(?:Street|Avenue|Road|Lane|Drive|Boulevard|Square)|\p{Lu}\p{Ll}+(?:straße|strasse|gasse|allee|platz|weg)\x20[0-9]{1,5}|[0-9]{1,5},?\x20(?:rue|avenue|boulevard|place|quai)(?:\x20\p{L}++){1,4}|(?:Calle|Avenida|Plaza|Paseo)(?:\x20\p{L}++){1,4}\x20[0-9]{1,5})(?![\p{L}0-9])",
}
#: What a text must hold, at the least, for a wider pattern to be looked for.
WIDER_NEEDS = {
    "email": r"[\[({]at[\])}]",
    "phone": r"[0-9][\x20.-][0-9]{4}",
    "ssn": r"[0-9]-[0-9]{2}-[0-9]{4}",
    "iban": r"[A-Z]{2}[0-9]{2}",
    "name": rf"\b(?:{TITLES.replace(' ', '|')}|{FIRST_NAMES.replace(' ', '|')})\b",
    "address": r"[0-9]{1,5},?\x20[\p{Lu}rabpq]|\p{Ll}\x20[0-9]{1,5}",
}
#: Digits that a refused match of a base pattern must have to be a candidate.
REFUSED = {"ip": (4, 40), "card": (12, 19), "phone": (7, 9)}
NEAR_WORDS = r"(?i)(?<!\p{L})(e-?mail|mail|courriel|correo|contact|kontakt|contacto|write|reach|call|phone|tel|telefon|téléphone|teléfono|mobile|handy|portable|móvil|fax|cell|whatsapp|card|karte|carte|tarjeta|visa|ssn|social security|iban|account|konto|compte|cuenta|bank|banque|banco|name|nom|nombre|address|adresse|anschrift|dirección|lives|wohnt|habite|vive)(?!\p{L})"
FAR_WORDS = r"(?i)(?<!\p{L})(version|release|isbn|issn|order|bestellung|commande|pedido|invoice|rechnung|facture|factura|serial|seriennummer|série|serie|model|modell|modèle|modelo|part|teil|pièce|pieza|figure|abbildung|section|abschnitt|page|seite|página|build|rfc|license|lizenz|licence|licencia|chapter|kapitel|chapitre|capítulo)(?!\p{L})"
BEFORE, AFTER = 32, 12
LABELERS, ROUNDS, CHUNK = 5, 50, 256
_MATCH = "struct<start: int, end: int, value: string, before: string, after: string>"


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with the value computed once, however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def scan(xs: Column, state: Column, step: Callable[[Column, Column], Column], emit: Callable[[Column, Column], Column], kind: str) -> Column:
    """emit(state, x) for each x of an array, with the state that step(state, x) carries on; kind is emit's type.

    An array that grows by one is copied each time. Here only chunks of CHUNK grow so, and the list of chunks."""
    none, nothing = F.expr(f"cast(array() as array<{kind}>)"), F.expr(f"cast(array() as array<array<{kind}>>)")

    def one(acc: Column, x: Column) -> Column:
        return F.struct(step(acc["s"], x).alias("s"), F.concat(acc["out"], F.array(emit(acc["s"], x))).alias("out"))

    def chunk(acc: Column, part: Column) -> Column:
        done = F.aggregate(part, F.struct(acc["s"].alias("s"), none.alias("out")), one)
        return let(done, lambda d: F.struct(d["s"].alias("s"), F.concat(acc["out"], F.array(d["out"])).alias("out")))

    def walk(v: Column) -> Column:
        parts = F.transform(F.sequence(F.lit(0), F.floor((F.size(v) - 1) / CHUNK).cast("int")), lambda k: F.slice(v, k * CHUNK + 1, F.lit(CHUNK)))
        return F.when(F.size(v) == 0, none).otherwise(F.flatten(F.aggregate(parts, F.struct(state.alias("s"), nothing.alias("out")), chunk)["out"]))

    return let(xs, walk)


def finds(text: Column, pattern: str) -> Column:
    """Array of (start, end, value, before, after) of the leftmost non-overlapping matches, in code points; before and
    after reach to the neighbouring match's next character at most."""
    empty = F.expr(f"cast(array() as array<{_MATCH}>)")

    def placed(values: Column, gaps: Column) -> Column:
        around = lambda v, i: F.struct(
            F.get(gaps, i).alias("gap"), v.alias("value"),
            F.right(F.concat(F.coalesce(F.right(F.get(values, i - 1), F.lit(1)), F.lit("")), F.get(gaps, i)), F.lit(BEFORE)).alias("before"),
            F.left(F.concat(F.get(gaps, i + 1), F.coalesce(F.left(F.get(values, i + 1), F.lit(1)), F.lit(""))), F.lit(AFTER)).alias("after"),
        )
        start = lambda at, x: at + F.length(x["gap"])
        end = lambda at, x: start(at, x) + F.length(x["value"])
        found = lambda at, x: F.struct(start(at, x).alias("start"), end(at, x).alias("end"), x["value"].alias("value"), x["before"].alias("before"), x["after"].alias("after"))
        return scan(F.transform(values, around), F.lit(0), end, found, _MATCH)

    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    return let(values, lambda v: F.when(F.size(v) > 0, let(F.split(text, pattern, -1), lambda g: placed(v, g))).otherwise(empty))


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    def add(total: Column, k: Column) -> Column:
        digit = F.substr(digits, F.length(digits) - k + 1, F.lit(1)).cast("int") * F.when(k % 2 == 0, 2).otherwise(1)
        return total + F.when(digit > 9, digit - 9).otherwise(digit)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add) % 10 == 0


def digits_of(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def valid(kind: str, value: Column) -> Column:
    """The base rules beyond the pattern."""
    digits = digits_of(value)
    if kind == "ip":
        plain = lambda part: F.concat(F.lit("0"), F.ltrim(part, F.lit("0")))
        small = lambda part: (F.length(plain(part)) <= 4) & (F.substring(plain(part), 1, 4).cast("int") <= 255)
        return F.forall(F.split(value, r"\."), small)
    if kind == "card":
        return F.length(digits).between(14, 19) & F.when(F.length(digits).between(14, 19), luhn(digits)).otherwise(False)
    if kind == "phone":
        return F.length(digits).between(10, 15)
    return F.lit(True)


def iban_valid(value: Column) -> Column:
    """Whether a number with its country and check digits moved to the end is 1 modulo 97, letters counting from 10."""
    plain = F.replace(value, F.lit(" "), F.lit(""))
    turned = F.concat(F.substring(plain, 5, 40), F.substring(plain, 1, 4))
    digit = lambda c: F.instr(F.lit("0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"), c) - 1
    return F.aggregate(F.split(turned, ""), F.lit(0), lambda n, c: (n * F.when(digit(c) > 9, 100).otherwise(10) + F.when(c != "", digit(c)).otherwise(0)) % 97) == 1


def matches(text: Column, kind: str) -> Column:
    """All matches of a base pattern, those that its rules refuse too."""
    return F.when(F.contains(text, F.lit(NEEDS[kind])), finds(text, BASE[kind])).otherwise(F.expr(f"cast(array() as array<{_MATCH}>)"))


def _passes(kind: str) -> Callable[[Column], Column]:
    return lambda s: valid(kind, s["value"])


def _refused(kind: str, least: int, most: int) -> Callable[[Column], Column]:
    return lambda s: ~valid(kind, s["value"]) & F.length(digits_of(s["value"])).between(least, most)


def possible(kind: str) -> Callable[[Column], Column]:
    """Rules of the wider patterns: what fails them can't be what the pattern is for."""
    if kind == "iban":
        return lambda s: iban_valid(s["value"])
    if kind == "ssn":
        return lambda s: digits_of(s["value"]).rlike("^(?!000|666|9)[0-9]{3}(?!00)[0-9]{2}(?!0000)[0-9]{4}$")
    return lambda s: F.lit(True)


def _vote(yes: Column, no: Column) -> Column:
    return F.when(yes, 1).when(no, -1).otherwise(0).cast("tinyint")


def described(spans: Column, kind: str, base: bool, refused: bool = False) -> Column:
    """Candidates with their votes and features."""
    tops, countries = "|".join(TOP_DOMAINS.split()), "|".join(IBAN_COUNTRIES.split())

    def one(s: Column) -> Column:
        value, digits, before, after = s["value"], digits_of(s["value"]), s["before"], s["after"]
        never = F.lit(False)
        form = {
            "email": (F.length(value) <= 120, F.contains(value, F.lit(".."))),
            "ip": (F.lit(base), F.lit(not base)),
            "card": (F.lit(base) & digits.rlike("^[3-6]"), F.lit(not base) | digits.rlike("^0|^([0-9])\\1+$")),
            "phone": (digits.rlike("[2-9][0-9]{2}[2-9][0-9]{6}$"), digits.rlike("^0{3}|([0-9])\\1{6}") | (F.length(digits) < 8)),
            "ssn": (never, digits.rlike(r"^([0-9])\1+$")),
            "iban": (F.length(F.replace(value, F.lit(" "), F.lit(""))).between(15, 34), never),
            "name": (F.length(value) <= 40, F.length(value) < 6),
            "address": (digits.rlike("^[1-9]"), digits.rlike("^0")),
        }[kind]
        known = {
            "email": (value.rlike(rf"(?i)[.)\]}}]\s?({tops})$"), ~value.rlike(rf"(?i)[.)\]}}]\s?[a-z]{{2,}}$")),
            "ip": (never, value.rlike(r"^(127|10|0|255)\.|^192\.168\.")),
            "card": (digits.rlike("^(4|5[1-5]|2[2-7]|3[47]|6011|65)"), digits.rlike("^[0179]")),
            "phone": (value.rlike(r"^\+(1|7|2[07]|3[0-469]|4[0-9]|5[1-8]|6[0-6]|8[1246]|9[0-58])"), value.rlike(r"^\+0")),
            "ssn": (never, digits.rlike("^(123456789|078051120|219099999)$")),
            "iban": (value.rlike(rf"^({countries})"), ~value.rlike(rf"^({countries})")),
            "name": (value.rlike(rf"^({FIRST_NAMES.replace(' ', '|')})\x20"), value.rlike(r"(Street|Road|Avenue|University|Company|Inc|Church|Park)$")),
            "address": (value.rlike("(?i)street|avenue|road|straße|strasse|rue|calle|avenida"), never),
        }[kind]
        votes = F.array(
            _vote(F.lit(base), F.lit(refused)),
            _vote(*form),
            _vote(*known),
            _vote(before.rlike(NEAR_WORDS), before.rlike(FAR_WORDS)),
            _vote(before.rlike(r"(^|[\s,;:(\"'])$") & ~after.rlike(r"^[\p{L}0-9@]"), before.rlike(r"[\p{L}0-9/=_#.-]$") | after.rlike(r"^[\p{L}0-9@/=_]")),
        )
        seen = lambda name, x: F.concat(F.lit(f"{kind}:{name}"), x)
        feats = F.array(
            seen("n", F.least(F.length(digits), F.lit(20)).cast("string")),
            seen("s", F.least(F.length(F.regexp_replace(value, "[A-Za-z0-9]", "")), F.lit(8)).cast("string")),
            seen("f", F.when(form[0], "+").when(form[1], "-").otherwise("0")),
            seen("k", F.when(known[0], "+").when(known[1], "-").otherwise("0")),
            seen("b", F.when(before == "", "^").when(before.rlike(r"\s$"), " ").when(before.rlike(r"[\p{L}0-9]$"), "w").otherwise("p")),
            seen("a", F.when(after == "", "$").when(after.rlike(r"^\s"), " ").when(after.rlike(r"^[\p{L}0-9]"), "w").otherwise("p")),
            seen("c", F.when(before.rlike(NEAR_WORDS), "+").when(before.rlike(FAR_WORDS), "-").otherwise("0")),
        )
        return F.struct(F.lit(kind).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), F.lit(base).alias("base"), votes.alias("votes"), feats.alias("feats"))

    return F.transform(spans, one)


_FOUND = "struct<kind: string, start: int, end: int, base: boolean, votes: array<tinyint>, feats: array<string>>"


def apart_from(base: Column, wide: Column) -> Column:
    """Those of wide that overlap none of base: walk both by start, once from either side."""
    one = lambda flag: lambda c: F.struct(c["start"].alias("start"), F.lit(flag).alias("flag"), c["end"].alias("end"), c.alias("c"))
    kind = f"struct<start: int, flag: int, end: int, c: {_FOUND}, free: boolean>"
    walk = lambda xs, state, step, free: scan(xs, state, step, lambda s, x: F.struct(x["start"].alias("start"), x["flag"].alias("flag"), x["end"].alias("end"), x["c"].alias("c"), free(s, x).alias("free")), kind)
    both = F.array_sort(F.concat(F.transform(base, one(0)), F.transform(wide, one(1))))
    right = walk(both, F.lit(0), lambda s, x: F.when(x["flag"] == 0, F.greatest(s, x["end"])).otherwise(s), lambda s, x: s <= x["start"])
    left = walk(F.reverse(right), F.lit(2**31 - 1), lambda s, x: F.when(x["flag"] == 0, x["start"]).otherwise(s), lambda s, x: x["free"] & (x["end"] <= s))
    return F.transform(F.filter(left, lambda x: (x["flag"] == 1) & x["free"]), lambda x: x["c"])


def candidates(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, text and found (all candidates, base and further ones that overlap no base span) of each row."""
    value = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), value.alias("text"))
    rows = rows.select("doc_id", "text", *[matches(F.col("text"), k).alias(k) for k in BASE_KINDS])
    base = F.concat(*[described(F.filter(F.col(k), _passes(k)), k, True) for k in BASE_KINDS])
    wide = [described(F.filter(F.col(k), _refused(k, a, b)), k, False, True) for k, (a, b) in REFUSED.items()]
    none = F.expr(f"cast(array() as array<{_FOUND}>)")
    wide += [F.when(F.col("text").rlike(WIDER_NEEDS[k]), described(F.filter(finds(F.col("text"), p), possible(k)), k, False)).otherwise(none) for k, p in WIDER.items()]
    rows = rows.select("doc_id", "text", base.alias("base"), F.concat(*wide).alias("wide"))
    return rows.select("doc_id", "text", F.when(F.size("wide") > 0, F.concat("base", apart_from(F.col("base"), F.col("wide")))).otherwise(F.col("base")).alias("found"))


def expectation_maximisation(patterns: list[tuple[tuple[int, ...], int]], rounds: int = ROUNDS) -> tuple[list[list[tuple[float, float]]], dict[tuple[int, ...], float]]:
    """Reliabilities (P(vote 1 | class), P(vote -1 | class)) by labeler and class, and the posterior of
    each vote pattern. Counts are smoothed, so an unseen vote is unlikely rather than impossible."""
    width = len(patterns[0][0]) if patterns else 0
    post = {p: 1 / (1 + math.exp(-1.5 * sum(p))) for p, _ in patterns}
    skill: list[list[tuple[float, float]]] = []
    for _ in range(rounds):
        skill, total = [], [0.0, 0.0]
        for p, n in patterns:
            total[1] += n * post[p]
            total[0] += n * (1 - post[p])
        for k in range(width):
            row = []
            for c in (0, 1):
                w = lambda p, c=c: post[p] if c else 1 - post[p]
                up = sum(n * w(p) for p, n in patterns if p[k] > 0) + (1.5 if c else 0.5)
                down = sum(n * w(p) for p, n in patterns if p[k] < 0) + (0.5 if c else 1.5)
                row.append((up / (total[c] + 3), down / (total[c] + 3)))
            skill.append(row)
        odds = math.log((total[1] + 1) / (total[0] + 1))
        for p, _ in patterns:
            x = odds
            for k, v in enumerate(p):
                chance = [up if v > 0 else down if v < 0 else 1 - up - down for up, down in skill[k]]
                x += math.log(max(chance[1], 1e-9) / max(chance[0], 1e-9))
            post[p] = 1 / (1 + math.exp(-max(-500.0, min(500.0, x))))
    return skill, post


class Model:
    """Log odds of the span classifier: a weight per feature, and per kind (its bias), of bounded vocabularies; and the
    posterior of each pattern of votes ("kind|v,v,..."), at most 3 ** LABELERS a kind, that it learned from."""

    def __init__(self, weights: dict[str, float], posteriors: dict[str, float]):
        self.weights, self.posteriors = weights, posteriors

    def posterior(self, kind: Column, votes: Column) -> Column:
        if not self.posteriors:
            return F.lit(0.0)
        table = F.create_map(*[F.lit(x) for kv in sorted(self.posteriors.items()) for x in kv])
        return F.coalesce(F.try_element_at(table, F.concat(kind, F.lit("|"), F.concat_ws(",", F.transform(votes, lambda v: v.cast("string"))))), F.lit(0.0))

    def score(self, kind: Column, feats: Column) -> Column:
        if not self.weights:
            return F.lit(-1.0)
        table = F.create_map(*[F.lit(x) for kv in sorted(self.weights.items()) for x in kv])
        weight = lambda f, other: F.coalesce(F.try_element_at(table, f), F.lit(other))
        return F.aggregate(feats, weight(kind, -1.0), lambda s, f: s + weight(f, 0.0))


def train(found: DataFrame) -> Model:
    """The classifier from the candidates' votes; found as `candidates` returns it.

    At most 3 ** LABELERS vote patterns a kind and the features' bounded vocabularies reach the driver.
    """
    spread = found.select(F.explode("found").alias("c")).select("c.kind", F.concat_ws(",", F.transform("c.votes", lambda v: v.cast("string"))).alias("votes"), "c.feats")
    patterns: dict[str, list] = {}
    for r in spread.groupBy("kind", "votes").agg(F.count("*").alias("n")).collect():
        patterns.setdefault(r["kind"], []).append((tuple(int(v) for v in r["votes"].split(",")), r["n"]))
    if not patterns:
        return Model({}, {})
    post = {f"{kind}|{','.join(map(str, p))}": q for kind, rows in patterns.items() for p, q in expectation_maximisation(sorted(rows))[1].items()}
    table = F.create_map(*[F.lit(x) for pq in sorted(post.items()) for x in pq])
    weighted = spread.select("kind", F.element_at(table, F.concat_ws("|", "kind", "votes")).alias("p"), F.explode(F.concat(F.array("kind"), "feats")).alias("f"))
    sums = {(r["kind"], r["f"]): (r["yes"], r["no"]) for r in weighted.groupBy("kind", "f").agg(F.sum("p").alias("yes"), F.sum(1 - F.col("p")).alias("no")).collect()}
    out = {}
    for (kind, f), (a, b) in sums.items():
        yes, no = sums[(kind, kind)]
        out[f] = math.log((yes + 1) / (no + 1)) if f == kind else math.log((a + 1) / (yes + 2)) - math.log((b + 1) / (no + 2))
    return Model(out, post)


def _tidy(xs: Column, *more: str) -> Column:
    """(kind, start, end) and further fields by start, then kind as listed."""
    rank = F.create_map(*[F.lit(x) for kv in zip(KINDS, range(len(KINDS)), strict=True) for x in kv])
    keyed = F.transform(xs, lambda c: F.struct(c["start"].alias("start"), rank[c["kind"]].alias("rank"), c["end"].alias("end"), *[c[k].alias(k) for k in ("kind", *more)]))
    return F.transform(F.array_sort(keyed), lambda c: F.struct(*[c[k].alias(k) for k in ("kind", "start", "end", *more)]))


def _accepted(found: Column, model: Model) -> Column:
    return F.filter(found, lambda c: c["base"] | (model.score(c["kind"], c["feats"]) > 0))


def spans(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, base, judged and spans of each row: arrays of (kind, start, end) by start, then kind; judged are all
    candidates beyond base, with the posterior of their votes and the classifier's score (log odds; added above 0).

    Ends are exclusive, positions in code points. Null texts are empty; texts are searched whole. Repeated rows and
    ids are judged each; columns beyond id and text are ignored, whatever their names; an empty table gives an empty
    one. spans holds base and what the classifier adds; candidates of several kinds may overlap.
    """
    found = durable(candidates(docs, id_col, text).drop("text"), "pii")
    model = train(found)
    one = lambda c: F.struct(*[c[k].alias(k) for k in ("kind", "start", "end")], model.posterior(c["kind"], c["votes"]).alias("posterior"), model.score(c["kind"], c["feats"]).alias("score"))
    rows = found.select("doc_id", _tidy(F.filter("found", lambda c: c["base"])).alias("base"), _tidy(F.transform(F.filter("found", lambda c: ~c["base"]), one), "posterior", "score").alias("judged"))
    added = F.transform(F.filter("judged", lambda c: c["score"] > 0), lambda c: F.struct(c["kind"].alias("kind"), c["start"].alias("start"), c["end"].alias("end")))
    return rows.select("doc_id", "base", "judged", _tidy(F.concat("base", added)).alias("spans"))


def count_of(xs: Column, kind: str) -> Column:
    return F.size(F.filter(xs, lambda c: c["kind"] == kind)).cast("long")


def joined(xs: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.concat_ws(",", F.transform(xs, lambda c: F.concat_ws(":", c["kind"], c["start"].cast("string"), c["end"].cast("string"))))


def verdicts(xs: Column) -> Column:
    """kind:start:end:posterior:score of each judged candidate, both to three places, comma-joined."""
    return F.concat_ws(",", F.transform(xs, lambda c: F.concat_ws(":", c["kind"], c["start"].cast("string"), c["end"].cast("string"), *[(F.round(c[k], 3) + 0.0).cast("string") for k in ("posterior", "score")])))


def redacted(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and text with every span, added ones too, replaced by its kind in brackets; of spans that overlap the
    first by start and kind names them all. Null texts become empty."""
    rows = candidates(docs, id_col, text)
    model = train(durable(rows.drop("text"), "pii"))
    rows = rows.select("doc_id", "text", _tidy(_accepted(F.col("found"), model)).alias("spans"))
    # Gaps before the spans that begin after all earlier ones end: (from, to, kind), by start and apart.
    gap = lambda s, x: F.struct(s.alias("from"), x["start"].alias("to"), x["kind"].alias("kind"))
    gaps = F.filter(scan(F.col("spans"), F.lit(0), lambda s, x: F.greatest(s, x["end"]), gap, "struct<from: int, to: int, kind: string>"), lambda g: g["to"] >= g["from"])
    rows = rows.select("doc_id", "text", gaps.alias("gaps"), F.coalesce(F.array_max(F.transform("spans", lambda x: x["end"])), F.lit(0)).alias("last"))
    cut = lambda t, a, b: F.substr(t, a + 1, b - a)

    def part(gs: Column) -> Column:
        """The text before and the mark of each of a chunk's gaps, cut from the chunk's own stretch of text."""
        at, end = F.get(gs, F.lit(0))["from"], F.element_at(gs, -1)["to"]
        return let(cut(F.col("text"), at, end), lambda t: F.array_join(F.transform(gs, lambda g: F.concat(cut(t, g["from"] - at, g["to"] - at), F.lit("["), g["kind"], F.lit("]"))), ""))

    chunks = F.transform(F.sequence(F.lit(0), F.floor((F.size("gaps") - 1) / CHUNK).cast("int")), lambda k: let(F.slice("gaps", k * CHUNK + 1, F.lit(CHUNK)), part))
    done = F.when(F.size("gaps") == 0, "").otherwise(F.array_join(chunks, ""))
    return rows.select("doc_id", F.concat(done, cut(F.col("text"), F.col("last"), F.length("text"))).alias("text"))
