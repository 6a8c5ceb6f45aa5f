"""Personal data: patterns propose spans, checksums confirm them, nearby words adjust the score.

DataFrame functions only.  ``split`` and ``regexp_extract_all`` walk the same
matches, so that the text between matches and the matches themselves give the
offsets of both.  Arrays grow within blocks of BLOCK matches only, so that the
work stays in proportion to a text and its matches.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Kind:
    """A pattern, the SQL condition on a match ``h``, its score, and the words that raise the score.

    The patterns of the base kinds match what the plain forms in the docstring
    of :func:`find_spans` match, but start only where a run of their characters
    starts (or the last match ended) and never give characters back, so that
    long runs cost no more than their length and no recursion.  That of iban
    takes as many characters as the country's numbers have, whatever follows.
    """

    name: str
    pattern: str
    condition: str
    score: float
    words: str
    needs: str = ""


_DIGITS = "regexp_replace(h, '[^0-9]', '')"
_LUHN = (
    f"aggregate(sequence(1, length({_DIGITS})), 0, (s, i) -> s + cast(substr("
    f"if(i % 2 = 0, '0246813579', '0123456789'), 1 + cast(substr({_DIGITS}, -i, 1) as int), 1) as int)) % 10 = 0"
)
_PART = "regexp_replace(p, '^0+', '')"
_IBAN = "replace(h, ' ', '')"
_MOD97 = (
    f"aggregate(split(concat(substr({_IBAN}, 5), substr({_IBAN}, 1, 4)), ''), 0, (m, c) -> "
    "if(c = '', m, if(c <= '9', (m * 10 + ascii(c) - 48) % 97, (m * 100 + ascii(c) - 55) % 97))) = 1"
)

#: characters of a country's numbers, by length (the SWIFT registry and the countries that use numbers of that form without it)
_IBAN_COUNTRIES = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV",
    22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "AO CV GW LY MZ PT ST",
    26: "DZ IR IS TR", 27: "BI CF CG CM DJ FR GA GQ GR IT KM MC MG MR SM TD", 28: "AL AZ BF BJ BY CI CY DO GT HN HU LB MA ML NE NI PL SN SV TG",
    29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
}


def _iban_pattern() -> str:
    """Numbers of the countries' lengths; other letters take all that can belong to them.  No number takes in the head of another that is whole."""
    known = "|".join(countries.replace(" ", "|") for countries in _IBAN_COUNTRIES.values())

    def ways(step: str) -> str:
        return "|".join(f"(?:{countries.replace(' ', '|')})[0-9]{{2}}(?:{step}){{{n - 4}}}+" for n, countries in _IBAN_COUNTRIES.items())

    whole = rf"(?:{ways(r'[\x20]?[A-Z0-9]')})(?![A-Za-z0-9])"
    step = rf"(?:[\x20](?!{whole}))?[A-Z0-9]"
    return rf"(?<![A-Za-z0-9])(?:{ways(step)}|(?!{known})[A-Z]{{2}}[0-9]{{2}}(?:{step}){{11,30}}+)(?![A-Za-z0-9])"


#: the base kinds, in their order
BASE = (
    Kind(
        "email",
        r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
        "true", 0.9, "e-?mail|contact|mailto|write to", "@",
    ),
    Kind(
        "ip",
        r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
        f"forall(split(h, '[.]'), p -> if(length({_PART}) <= 3, cast(concat('0', {_PART}) as int) <= 255, false))", 0.6, "ip|host|server|address", ".",
    ),
    Kind(
        "card",
        r"[0-9](?:[\x20-]?[0-9]){11,}+",
        f"length({_DIGITS}) <= 19 and {_LUHN}", 0.7, "card|visa|credit|karte|carte|tarjeta",
    ),
    Kind(
        "phone",
        r"\+[0-9][\x20().0-9-]+[0-9]",
        f"length({_DIGITS}) between 9 and 15", 0.5, "phone|tel|call|mobile|fax", "+",
    ),
)
#: kinds that the method adds
ADDED = (
    Kind(
        "iban",
        _iban_pattern(),
        f"length({_IBAN}) <= 34 and {_MOD97}", 0.8, "iban|bank|account|konto|compte|cuenta",
    ),
    Kind(
        "ssn",
        r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])",
        "true", 0.3, "ssn|social security|social sec", "-",
    ),
)
#: an added span counts from this score on; a nearby word adds so much; so many characters before and after are near
ENOUGH, NEARBY, BEFORE, AFTER = 0.6, 0.35, 48, 24

#: matches that are walked one by one; each such walk copies what it has found so far
BLOCK = 256
_SPAN = "array<struct<start:int,rank:int,end:int,kind:string,score:double>>"
_NO_SPANS = f"cast(array() as {_SPAN})"


def _by_block(n: str, value: str) -> str:
    """SQL of an array with ``value`` for each block ``b`` of ``n`` items, of which there is one at least; its places are ``places``."""
    places = f"sequence(b * {BLOCK}, least({n}, (b + 1) * {BLOCK}) - 1)"
    return f"transform(sequence(0, cast(({n} - 1) div {BLOCK} as int)), b -> {value.replace('places', places)})"


def _walk(n: str, before: str, step: str) -> str:
    """SQL of the arrays ``out`` of a walk over all items ``q``; ``at`` is what ``before`` says at the start of each block."""
    return f"flatten({_by_block(n, f'aggregate(places, named_struct({before}), (a, q) -> named_struct({step}), a -> a.out)')})"


def _spans(kind: Kind, rank: int, text: str) -> Column:
    """Confirmed spans of one kind in the text column named ``text``."""
    quoted = kind.pattern.replace("\\", "\\\\").replace("'", "\\'")
    least = 0.0 if rank < len(BASE) else ENOUGH
    condition = kind.condition.replace("h, ", "m.h[q], ").replace("(h)", "(m.h[q])")
    # what is near a match may lie beyond its neighbours; matches have four characters at least
    reach = range(1, -(-max(BEFORE, AFTER) // 4) + 1)
    before = ", ".join([f"if(q >= {d}, concat(right(m.g[q - {d}], {BEFORE}), m.h[q - {d}]), '')" for d in reversed(reach)] + [f"right(m.g[q], {BEFORE})"])
    after = ", ".join([f"left(m.g[q + 1], {AFTER})"] + [f"if(q + {d} < size(m.h), concat(m.h[q + {d}], left(m.g[q + {d} + 1], {AFTER})), '')" for d in reach])
    near = f"concat(right(concat({before}), {BEFORE}), ' ', left(concat({after}), {AFTER}))"
    score = f"least(1.0D, cast(round({kind.score} + if(lower({near}) rlike '\\\\b({kind.words})\\\\b', {NEARBY}, 0.0), 2) as double))"
    start, end = "a.at + length(m.g[q])", "a.at + length(m.g[q]) + length(m.h[q])"
    span = f"array(named_struct('start', {start}, 'rank', {rank}, 'end', {end}, 'kind', '{kind.name}', 'score', {score}))"
    sizes = _by_block("size(m.h)", "aggregate(places, 0, (n, q) -> n + length(m.g[q]) + length(m.h[q]))")
    found = _walk(
        "size(m.h)",
        f"'at', aggregate(slice(m.sizes, 1, b), 0, (n, x) -> n + x), 'out', {_NO_SPANS}",
        f"'at', {end}, 'out', concat(a.out, if({condition}, {span}, {_NO_SPANS}))",
    )
    matches = f"named_struct('h', regexp_extract_all({text}, '{quoted}', 0), 'g', split({text}, '{quoted}', -1))"
    sized = f"transform(array({matches}), m -> named_struct('h', m.h, 'g', m.g, 'sizes', if(size(m.h) = 0, array(0), {sizes})))"
    spans = f"transform({sized}, m -> if(size(m.h) = 0, {_NO_SPANS}, {found}))[0]"
    if least:
        spans = f"filter({spans}, s -> s.score >= {least}D)"
    asked = f"contains({text}, '{kind.needs}')" if kind.needs else f"{text} rlike '[0-9]{{2}}'"
    return F.expr(f"if({asked}, {spans}, {_NO_SPANS})")


def find_spans(docs: DataFrame, text_col: str = "text", added: tuple[Kind, ...] = ADDED) -> DataFrame:
    """``docs`` with a column ``pii_spans`` (start, rank, end, kind, score), sorted by start, then kind.

    Base kinds, leftmost without overlap within a kind, code points, end
    exclusive: email ``[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+``; ip
    ``[0-9]+(\\.[0-9]+)(\\.[0-9]+)(\\.[0-9]+)``, parts at most 255; card
    ``[0-9]([\\x20-]?[0-9])+``, 12 to 19 digits that pass Luhn; phone
    ``\\+[0-9][\\x20().0-9-]+[0-9]``, 9 to 15 digits.  Added kinds: iban (the
    country's length, mod-97) and ssn (only with a word such as "SSN" nearby).  Words are near
    within BEFORE characters before and AFTER after, whatever else stands
    there.  Null texts count as empty and have no spans; texts of any length
    are searched whole, in time proportional to the text and its matches.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    kinds = [*BASE, *added]
    out = docs.withColumn("pii_text", text)
    parts = [_spans(kind, rank, "pii_text") for rank, kind in enumerate(kinds)]
    return out.withColumn("pii_spans", F.array_sort(F.concat(*parts))).drop("pii_text")


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def pii_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, n_email, n_ip, n_card, n_phone, base_sha256, spans, scores.

    ``spans``: kind:start:end by start, then kind, comma-joined; ``scores`` in
    the same order; ``base_sha256`` digests the base kinds' part of it.  Null
    and empty texts have none.  Null and repeated ids are kept; other columns
    are ignored, whatever their names.  No shuffle.
    """
    found = find_spans(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")))
    of = lambda name: F.size(F.filter("pii_spans", lambda s: s["kind"] == name)).cast("long").alias(f"n_{name}")
    base = F.filter("pii_spans", lambda s: s["rank"] < len(BASE))
    return found.select(
        F.col("id").alias(id_col),
        *[of(kind.name) for kind in BASE],
        F.sha2(_joined(base).cast("binary"), 256).alias("base_sha256"),
        _joined(F.col("pii_spans")).alias("spans"),
        F.array_join(F.transform("pii_spans", lambda s: s["score"].cast("string")), ",").alias("scores"),
    )


def redact(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with every span of its text replaced by its kind in brackets.

    Overlapping spans become one, under the name of the first.  Texts without
    spans, empty and null ones stay as they are.
    """
    found = find_spans(docs, text_col)
    own = f"`{text_col}`"
    # spans that begin after the end of all before them lead; what overlaps them goes with them
    ends = _by_block("size(p)", "aggregate(places, 0, (n, q) -> greatest(n, p[q].end))")
    lead = "array(named_struct('from', a.at, 'to', p[q].start, 'kind', upper(p[q].kind)))"
    leads = _walk(
        "size(p)",
        "'at', aggregate(slice(e, 1, b), 0, (n, x) -> greatest(n, x)), 'out', cast(array() as array<struct<from:int,to:int,kind:string>>)",
        f"'at', greatest(a.at, p[q].end), 'out', if(p[q].start >= a.at, concat(a.out, {lead}), a.out)",
    )
    # a text is cut into the leads' blocks before it is cut at each lead
    piece = "concat(substr(t, l[q].from - l[places[0]].from + 1, l[q].to - l[q].from), '[', l[q].kind, ']')"
    block = f"substr({own}, l[places[0]].from + 1, l[array_max(places)].to - l[places[0]].from)"
    pieces = _by_block("size(l)", f"transform(array({block}), t -> array_join(transform(places, q -> {piece}), ''))[0]")
    bound = lambda name, value, body: f"transform(array({value}), {name} -> {body})[0]"
    rest = f"substr({own}, array_max(transform(p, s -> s.end)) + 1)"
    clean = bound("p", "pii_spans", bound("e", ends, f"concat({bound('l', leads, f'array_join({pieces}, {chr(39) * 2})')}, {rest})"))
    return found.withColumn(text_col, F.expr(f"if(size(pii_spans) > 0, {clean}, {own})")).drop("pii_spans")
