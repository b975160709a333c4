"""Personal data by weak supervision: labelers vote, their reliabilities are estimated, a classifier decides.

Detectors find spans: four exact kinds, which always count, and looser ones. For each span a
regex, a gazetteer and a context labeler vote for, against or not at all. The spans of all
documents are counted by their votes; expectation-maximisation over these counts (there are only
so many combinations) estimates how reliable each labeler is and how likely each combination is
personal data, and a logistic model trained on that decides about the looser spans. All work on
texts is done by SQL functions.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_BYTE = r"0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"
_CHUNK = 256
_CONTEXT = 40
#: Kinds in the order of results.
KINDS = ("email", "ip", "card", "phone", "iban", "secret", "ssn")
#: Word lists of the gazetteer and context labelers. Fixed values.
TOP_LEVELS = "com|org|net|edu|gov|info|io|de|fr|es|uk|eu|ch|at|it|nl|pl|us|ca|br|mx|ar|co"
IBAN_COUNTRIES = "AD|AT|BE|CH|CY|CZ|DE|DK|EE|ES|FI|FR|GB|GR|HR|HU|IE|IS|IT|LI|LT|LU|LV|MC|MT|NL|NO|PL|PT|RO|SE|SI|SK|SM"
CALLING_CODES = "1|7|20|27|30|31|32|33|34|36|39|40|41|43|44|45|46|47|48|49|51|52|54|55|56|57|60|61|62|63|64|65|66|81|82|84|86|90|91|92"
CONTEXT_WORDS = {
    "email": "mail|contact|kontakt|correo|courriel|write to",
    "ip": "ip|host|server|address|login|adresse",
    "card": "card|visa|credit|payment|karte|tarjeta|carte",
    "phone": "phone|tel|call|fax|mobil|cell|appel|llam",
    "iban": "iban|bank|account|konto|compte|cuenta",
    "secret": "token|secret|password|passwd|key",
    "ssn": "ssn|social|security",
}
OTHER_WORDS = "version|isbn|page|figure|table|chapter|invoice|order no"


@dataclass(frozen=True)
class Detector:
    """pattern: without groups, linear in the text. quick: what any text with a match has."""

    kind: str
    name: str
    pattern: str
    quick: str
    exact: bool
    valid: Callable[[Column], Column]


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def _luhn(x: Column) -> Column:
    d = F.reverse(_digits(x))

    def step(total: Column, i: Column) -> Column:
        digit = F.substring(d, i, F.lit(1)).cast("int")
        twice = digit * 2 - F.when(digit > 4, 9).otherwise(0)
        return total + F.when(i % 2 == 0, twice).otherwise(digit)

    return F.length(d).between(13, 19) & (F.aggregate(F.sequence(F.lit(1), F.length(d)), F.lit(0), step) % 10 == 0)


_LOCAL = "A-Za-z0-9._%+-"
DETECTORS = (
    # a run of local characters is tried at its start only, or where the last match ended
    Detector("email", "email", rf"(?:\G|(?<![{_LOCAL}]))[{_LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@", True, lambda x: F.lit(True)),
    Detector("ip", "ip", r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", r"[0-9]\.[0-9]", True, lambda x: x.rlike(rf"^{_BYTE}(?:\.{_BYTE}){{3}}$")),
    # runs of fewer digits can't hold a card, and end where a longer one would
    Detector("card", "card", r"[0-9](?:[ -]?[0-9]){12,}+", r"[0-9](?:[ -]?[0-9]){12}", True, _luhn),
    Detector("phone", "phone", r"\+[0-9][ ().0-9-]+[0-9]", r"\+[0-9]", True, lambda x: F.length(_digits(x)).between(9, 15)),
    Detector("email", "spelled_email", r"(?i)(?<![a-z0-9._%+-])[a-z0-9._%+-]{1,64}+ ?[\[(]at[\])] ?[a-z0-9-]++(?:(?: ?[\[(]dot[\])] ?|\.)[a-z0-9-]{2,63}+)++", r"(?i)[\[(]at[\])]", False, lambda x: F.lit(True)),
    Detector("phone", "plain_phone", r"(?<![0-9+(.-])\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9-])", r"[0-9]{3}[ .-][0-9]{4}", False, lambda x: F.lit(True)),
    Detector("iban", "iban", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}+(?: ?[A-Z0-9]{1,3}+)?(?![A-Za-z0-9])", r"[A-Z]{2}[0-9]{2} ?[A-Z0-9]{4}", False, lambda x: F.lit(True)),
    Detector("secret", "secret", r"(?i)(?<![a-z0-9_])(?:token|secret|password|passwd|api[_-]?key)[ \t]{0,4}+[=:][ \t]{0,4}+[\"']?[^\s\"']{8,}+[\"']?", r"(?i)(?:token|secret|password|passwd|key)[ \t]*[=:]", False, lambda x: F.lit(True)),
    Detector("ssn", "ssn", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])", r"[0-9]{3}-[0-9]{2}-", False, lambda x: F.lit(True)),
)


def _mod_97(x: Column) -> Column:
    """The check number of an account number: its remainder once letters are numbers and the head is at the end."""
    plain = F.regexp_replace(x, "[^A-Z0-9]", "")
    chars = F.split(F.concat(F.substring(plain, 5, 64), F.substring(plain, 1, 4)), "")

    def step(rest: Column, c: Column) -> Column:
        number = F.when(c.rlike("[0-9]"), c.cast("int")).otherwise(F.ascii(c) - 55)
        return (rest * F.when(number > 9, 100).otherwise(10) + number) % 97

    return F.aggregate(F.filter(chars, lambda c: c != ""), F.lit(0), step)


#: Values that stand for a secret without being one. Fixed values.
PLACEHOLDERS = "your|my|the|this|some|example|changeme|change|placeholder|required|optional|undefined|secret|password|token|none|null|true|false"


def _votes(kind: str, x: Column, context: Column) -> list[Column]:
    """Votes of the regex, gazetteer and context labelers: 1, 0 or -1."""
    yes, no, none = F.lit(1), F.lit(-1), F.lit(0)
    test = lambda p, other: F.when(x.rlike(p), yes).otherwise(other)
    value = r"^[^=:]*[=:][ \t]*[\"']?"
    shape = {
        # possessive, with alternatives that begin differently: labels are taken in a loop, not one stack frame each
        "email": test(r"^[A-Za-z0-9._%+-]++ ?(?:@|[\[(](?i:at)[\])]) ?(?:[A-Za-z0-9-]++ ?(?:\.|[\[(](?i:dot)[\])]) ?)++[A-Za-z]{2,}+$", no),
        "ip": test(r"^(?:0|[1-9][0-9]*)(?:\.(?:0|[1-9][0-9]*)){3}$", no),
        "card": test(r"^[3-6](?:[0-9 -]*)$", no),
        # without a plus sign: neither area nor exchange code begins with 0 or 1
        "phone": test(r"^(?:\+[ (]*[1-9]|\(?[2-9][0-9]{2}\)?[ .-][2-9])", no),
        "iban": F.when(_mod_97(x) == 1, yes).otherwise(no),
        "secret": test(value + r"(?=[^\s]*[0-9])[^\s]{8,}", test(value + r"[^\s]{20,}", no)),
        "ssn": test(r"^(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}$", no),
    }[kind]
    known = {
        "email": test(rf"(?i)(?:\.|dot[\])]? ?)(?:{TOP_LEVELS})$", none),
        "ip": F.when(x.rlike(r"^(?:0|10|127|192\.168|255)\."), no).otherwise(yes),
        "card": test(r"^(?:4|5[1-5]|2[2-7]|3[47]|35|36|6011|65)", none),
        "phone": F.when(x.rlike(r"^\(?(?:[2-9]11|000|[0-9]{3}\)?[ .-](?:[2-9]11|000))"), no).when(x.rlike(rf"^\+(?:{CALLING_CODES})"), yes).otherwise(none),
        "iban": test(rf"^(?:{IBAN_COUNTRIES})", no),
        "secret": F.when(x.rlike(rf"(?i){value}(?:(?:{PLACEHOLDERS})(?![a-z0-9])|[x*.<{{$])"), no).otherwise(test(r"[0-9a-fA-F]{16,}|[A-Za-z0-9+/_-]{20,}", none)),
        "ssn": test("^(?:123-45-6789|078-05-1120|219-09-9999)$", none) * -1,
    }[kind]
    near = F.when(context.rlike(rf"(?:{OTHER_WORDS})[^a-z]{{0,4}}$"), no).when(context.rlike(rf"(?:^|[^a-z])(?:{CONTEXT_WORDS[kind]})"), yes).otherwise(none)
    return [shape, known, near]


def _matches(text: Column, d: Detector) -> Column:
    """Structs (gap, match): what stands before each match since the last one, and the match."""
    pattern = d.pattern.removeprefix("(?i)")
    flags = "(?s)(?i)" if pattern != d.pattern else "(?s)"
    whole = F.lit(rf"{flags}\G(.*?)({pattern})")
    pairs = F.zip_with(F.regexp_extract_all(text, whole, F.lit(1)), F.regexp_extract_all(text, whole, F.lit(2)), lambda g, m: F.struct(g.alias("gap"), m.alias("match")))
    return F.when(text.rlike(d.quick), pairs)


def _key(d: Detector, match: Column, context: Column) -> Column:
    return F.concat_ws("|", F.lit(d.name), *[v.cast("string") for v in _votes(d.kind, match, F.lower(context))])


def _spans(d: Detector, pairs: Column) -> Column:
    """Structs (kind, start, end, exact, key) of valid matches. Positions are code points, added up chunk by chunk, so that arrays stay short while they grow."""

    def one(state: Column, x: Column) -> Column:
        start = state["at"] + F.length(x["gap"])
        end = start + F.length(x["match"])
        span = F.struct(F.lit(KINDS.index(d.kind)).alias("kind"), start.alias("start"), end.alias("end"), F.lit(d.exact).alias("exact"), _key(d, x["match"], F.substring(x["gap"], -_CONTEXT, _CONTEXT)).alias("key"))
        return F.struct(end.alias("at"), F.when(d.valid(x["match"]), F.concat(state["spans"], F.array(span))).otherwise(state["spans"]).alias("spans"))

    empty = F.array().cast("array<struct<kind:int,start:int,end:int,exact:boolean,key:string>>")
    chunks = F.transform(F.sequence(F.lit(0), F.floor((F.size(pairs) - 1) / _CHUNK).cast("int")), lambda i: F.slice(pairs, i * _CHUNK + 1, F.lit(_CHUNK)))

    def chunk(state: Column, part: Column) -> Column:
        done = F.transform(F.array(part), lambda p: F.aggregate(p, F.struct(state["at"].alias("at"), empty.alias("spans")), one))
        return F.get(F.transform(done, lambda r: F.struct(r["at"].alias("at"), F.concat(state["spans"], r["spans"]).alias("spans"))), F.lit(0))

    found = F.aggregate(chunks, F.struct(F.lit(0).alias("at"), empty.alias("spans")), chunk)["spans"]
    return F.when(F.size(pairs) > 0, found).otherwise(empty)


def find_spans(docs: DataFrame, text_col: str = "text", carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """row (struct of the carried columns), base and loose: arrays of structs (kind, start, end, exact, key).

    kind is the place in KINDS. Loose spans that overlap a base one are left out, but for
    secrets, which always reach beyond it.
    """
    out = docs.select(F.struct(*[F.col(f"`{c}`") for c in carry]).alias("row"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    for i, d in enumerate(DETECTORS):
        out = out.withColumn(f"pairs_{i}", _matches(F.col("text"), d))
    out = out.select("row", *[F.coalesce(_spans(d, F.col(f"pairs_{i}")), F.array().cast("array<struct<kind:int,start:int,end:int,exact:boolean,key:string>>")).alias(f"s_{i}") for i, d in enumerate(DETECTORS)])
    base = F.concat(*[F.col(f"s_{i}") for i, d in enumerate(DETECTORS) if d.exact])
    loose = F.concat(*[F.col(f"s_{i}") for i, d in enumerate(DETECTORS) if not d.exact])
    out = out.select("row", base.alias("base"), loose.alias("loose"))
    secret = F.lit(KINDS.index("secret"))
    apart = F.filter("loose", lambda x: (x["kind"] == secret) | ~F.exists("base", lambda b: (x["start"] < b["end"]) & (b["start"] < x["end"])))
    return out.select("row", "base", F.when(F.size("loose") > 0, apart).otherwise(F.col("loose")).alias("loose"))


#: What is assumed of the regex, gazetteer and context labelers before any span is seen, as weights of evidence and as so many spans.
_TRUST, _SEEN = (3.5, 1.0, 1.5), 20.0


def _logistic(x: float) -> float:
    return 1 / (1 + math.exp(-max(-500.0, min(500.0, x))))


def reliabilities(counts: dict[str, int], rounds: int = 30) -> tuple[dict[str, float], dict[str, list[dict[int, tuple[float, float]]]]]:
    """Expectation-maximisation over counts of vote combinations ("name|v|v|v"), for each detector on its own.

    Gives how likely each combination is personal data, and for each detector and labeler the
    chances of its votes given that a span is, and is not.
    """
    by_name: dict[str, dict[str, list[int]]] = {}
    for k in counts:
        name, *votes = k.split("|")
        by_name.setdefault(name, {})[k] = [int(v) for v in votes]
    belief, chances = {}, {}
    for name, votes in by_name.items():
        belief |= {k: _logistic(sum(w * x for w, x in zip(_TRUST, v, strict=True))) for k, v in votes.items()}
        for _ in range(rounds):
            mine = chances[name] = []
            yes = sum(counts[k] * belief[k] for k in votes)
            no = sum(counts[k] * (1 - belief[k]) for k in votes)
            prior = (yes + 1) / (yes + no + 2)
            for i, trust in enumerate(_TRUST):
                mass = {v: [_SEEN * _logistic(v * trust), _SEEN * _logistic(-v * trust)] for v in (-1, 0, 1)}
                for k, v in votes.items():
                    mass[v[i]][0] += counts[k] * belief[k]
                    mass[v[i]][1] += counts[k] * (1 - belief[k])
                totals = [sum(m[y] for m in mass.values()) for y in (0, 1)]
                mine.append({v: (m[0] / totals[0], m[1] / totals[1]) for v, m in mass.items()})
            for k, v in votes.items():
                for_it = math.log(prior) + sum(math.log(mine[i][x][0]) for i, x in enumerate(v))
                against = math.log(1 - prior) + sum(math.log(mine[i][x][1]) for i, x in enumerate(v))
                belief[k] = _logistic(for_it - against)
    return belief, chances


def train_classifier(counts: dict[str, int], belief: dict[str, float], rounds: int = 400) -> dict[str, float]:
    """A logistic model of detector and votes, trained on the beliefs; its probability for each combination."""
    features = {}
    for k in counts:
        name, *votes = k.split("|")
        features[k] = [name, *[f"{i}:{v}" for i, v in enumerate(votes)], *[f"{name}:{i}:{v}" for i, v in enumerate(votes)]]
    weights = dict.fromkeys(sorted({f for x in features.values() for f in x}), 0.0)
    # rare combinations count by the root of their number, so that common ones don't decide alone
    mass = {k: math.sqrt(n) for k, n in counts.items()}
    total = sum(mass.values()) or 1
    chance = {}
    for _ in range(rounds):
        slope = {f: 1e-4 * w for f, w in weights.items()}
        for k, n in mass.items():
            chance[k] = _logistic(sum(weights[f] for f in features[k]))
            for f in features[k]:
                slope[f] += n / total * (chance[k] - belief[k])
        weights = {f: w - 2.0 * slope[f] for f, w in weights.items()}
    return chance


def fit_spans(found: DataFrame) -> dict[str, float]:
    """Probability of each combination of detector and votes, learned from all of find_spans."""
    keys = found.select(F.explode(F.concat("base", "loose")).alias("s")).groupBy(F.col("s.key").alias("key")).count()
    # at most 27 combinations for each detector
    counts = {r["key"]: r["count"] for r in keys.collect()}
    return train_classifier(counts, reliabilities(counts)[0])


def fit(docs: DataFrame, text_col: str = "text") -> dict[str, float]:
    """The model of all documents."""
    return fit_spans(find_spans(docs.select(F.lit(0).alias("x"), F.col(text_col).alias("text")), carry=("x",)))


def _accepted(model: dict[str, float], threshold: float) -> list[str]:
    return sorted(k for k, p in model.items() if p >= threshold)


def _added(loose: Column, model: dict[str, float], threshold: float) -> Column:
    accepted = _accepted(model, threshold)
    return F.filter(loose, lambda x: x["key"].isin(accepted) if accepted else F.lit(False))


def decide(found: DataFrame, model: dict[str, float], threshold: float = 0.5) -> DataFrame:
    """Rows of find_spans to row, base and spans: arrays of structs (kind, start, end), by kind and start."""
    bare = lambda c: F.transform(c, lambda x: F.struct(F.element_at(F.array(*map(F.lit, KINDS)), x["kind"] + 1).alias("kind"), x["start"].alias("start"), x["end"].alias("end")))
    every = found.select("row", "base", F.array_sort(F.concat("base", _added(F.col("loose"), model, threshold))).alias("all"))
    return every.select("row", bare(F.col("base")).alias("base"), bare(F.col("all")).alias("spans"))


def detect(docs: DataFrame, model: dict[str, float], text_col: str = "text", carry: tuple[str, ...] = ("doc_id",), threshold: float = 0.5) -> DataFrame:
    """For each row of docs: row (struct of the carried columns), base and spans: arrays of structs (kind, start, end), by kind and start.

    spans has all of base and the loose spans that the model accepts. A null text counts as empty
    and has none. Very long texts are searched whole, spans of any length (domains of many
    thousand labels) included. Repeated rows have the same spans, null ids are carried, an empty table gives no rows.
    """
    return decide(find_spans(docs, text_col, carry), model, threshold)


def _merged(spans: Column) -> Column:
    """Spans by start, those that overlap as one, which has the kind of its longest."""

    def one(done: Column, x: Column) -> Column:
        last = F.element_at(done, -1)
        longer = x["end"] - x["start"] > last["most"]
        joined = F.struct(last["start"].alias("start"), F.greatest(last["end"], x["end"]).alias("end"), F.when(longer, x["kind"]).otherwise(last["kind"]).alias("kind"), F.greatest(last["most"], x["end"] - x["start"]).alias("most"))
        fresh = F.struct(x["start"].alias("start"), x["end"].alias("end"), x["kind"].alias("kind"), (x["end"] - x["start"]).alias("most"))
        overlaps = (F.size(done) > 0) & (x["start"] < F.get(done, F.size(done) - 1)["end"])
        return F.when(overlaps, F.concat(F.slice(done, F.lit(1), F.size(done) - 1), F.array(joined))).otherwise(F.concat(done, F.array(fresh)))

    empty = F.array().cast("array<struct<start:int,end:int,kind:int,most:int>>")
    in_order = F.array_sort(F.transform(spans, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["kind"].alias("kind"))))
    return F.aggregate(in_order, empty, one)


def redact(docs: DataFrame, model: dict[str, float], text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """docs with each span of detect in their texts replaced by its kind in brackets, spans that overlap by one kind.

    So no character of a span is left. A null text stays null, a text without spans as it is.
    """
    found = find_spans(docs, text_col, tuple(docs.columns))
    text = F.col(f"row.`{text_col}`")
    merged = F.when(F.size("base") + F.size("loose") > 0, _merged(F.concat("base", _added(F.col("loose"), model, threshold))))
    names = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])

    def rebuilt(m: Column) -> Column:
        part = lambda x, i: F.concat(F.substring(text, F.when(i > 0, F.get(m, i - 1)["end"]).otherwise(0) + 1, x["start"] - F.when(i > 0, F.get(m, i - 1)["end"]).otherwise(0)), F.element_at(names, x["kind"] + 1))
        return F.when(F.size(m) > 0, F.concat(F.array_join(F.transform(m, part), ""), F.substring(text, F.element_at(m, -1)["end"] + 1, F.length(text)))).otherwise(text)

    # the merged spans are bound once
    clean = F.coalesce(F.get(F.transform(F.array(merged), lambda m: F.when(m.isNotNull(), rebuilt(m))), F.lit(0)), text)
    return found.select(*[clean.alias(c) if c == text_col else F.col(f"row.`{c}`").alias(c) for c in docs.columns])
