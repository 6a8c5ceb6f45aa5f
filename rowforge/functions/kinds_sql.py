"""The value kinds as SQL text for DuckDB, so that generated tables can be checked by another engine.

Each kind makes its draws in the order in which :mod:`kinds` makes them.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from typing import Any

from rowforge.functions.draw import P, below_sql, unit_sql
from rowforge.functions.kinds import LISTS, TIME_FROM, TIME_TO, WORDS, _ascii, words_of

LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def literal(value: Any) -> str:
    return "'" + value.replace("'", "''") + "'" if isinstance(value, str) else str(value)


def joined(*parts: str, by: str = "") -> str:
    return "(" + (f" || {literal(by)} || " if by else " || ").join(parts) + ")"


def text(value: str) -> str:
    return f"CAST({value} AS VARCHAR)"


@dataclass
class SqlDraws:
    """The draws of one cell; ``row`` is a non-negative BIGINT expression."""

    row: str
    salt: int
    locale: str = "en_US"
    used: int = 0

    def _next(self) -> int:
        self.used += 1
        return (self.salt + 104729 * self.used) % P

    def below(self, n: int) -> str:
        return below_sql(self.row, self._next(), n)

    def unit(self) -> str:
        return unit_sql(self.row, self._next())

    def pick(self, values: Sequence[Any]) -> str:
        return f"([{', '.join(map(literal, values))}])[CAST({self.below(len(values))} AS INTEGER) + 1]"

    def words(self, name: str, change: Callable[[str], str] = str) -> str:
        return self.pick([change(w) for w in words_of(self.locale, name)])

    def between(self, low: int, high: int) -> str:
        return f"({self.below(high - low + 1)} + {low})"

    def padded(self, low: int, high: int, width: int) -> str:
        return f"lpad({text(self.between(low, high))}, {width}, '0')"

    def digits(self, n: int) -> str:
        return joined(*[f"lpad({text(self.below(10 ** min(9, n - k)))}, {min(9, n - k)}, '0')" for k in range(0, n, 9)])

    def letters(self, n: int, alphabet: str = LETTERS) -> str:
        return joined(*[f"substr({literal(alphabet)}, CAST({self.below(len(alphabet))} AS INTEGER) + 1, 1)" for _ in range(n)])

    def hex(self, n: int) -> str:
        return joined(*[f"lpad(lower(to_hex({self.below(16 ** min(7, n - k))})), {min(7, n - k)}, '0')" for k in range(0, n, 7)])

    def number(self, low: float, high: float) -> str:
        return f"({low!r}::DOUBLE + {self.unit()} * {high - low!r}::DOUBLE)"

    def sentence(self, n: int) -> str:
        return let(joined(*[self.pick(WORDS) for _ in range(n)], by=" "), lambda t: f"upper(substr({t}, 1, 1)) || substr({t}, 2) || '.'")

    def handle(self) -> str:
        return joined(self.words("first", _ascii), "'.'", self.words("last", _ascii), text(self.below(10_000)))

    def domain(self) -> str:
        return joined(self.pick(WORDS), "'-'", self.pick(WORDS), self.pick([".com", ".org", ".net", ".io"]))


_NAMES = iter(range(10**9))


def let(value: str, body: Callable[[str], str]) -> str:
    """``body`` of a value that is named, so that it is not written out twice."""
    name = f"t{next(_NAMES)}"
    return f"list_transform([{value}], lambda {name}: {body(name)})[1]"


def _digit(body: str, k: int) -> str:
    return f"CAST(substr({body}, {k + 1}, 1) AS INTEGER)"


def _luhn(body: str, n: int) -> str:
    double = lambda d: f"(CASE WHEN {d} > 4 THEN 2 * {d} - 9 ELSE 2 * {d} END)"
    total = " + ".join(double(_digit(body, n - 1 - k)) if k % 2 == 0 else _digit(body, n - 1 - k) for k in range(n))
    return text(f"((10 - ({total}) % 10) % 10)")


def _ean(body: str) -> str:
    return text(f"((10 - ({' + '.join(f'{_digit(body, k)} * {1 + 2 * (k % 2)}' for k in range(12))}) % 10) % 10)")


def _vin(d: SqlDraws) -> str:
    alphabet, values = "ABCDEFGHJKLMNPRSTUVWXYZ0123456789", "12345678123457923456789" + "0123456789"
    weights = (8, 7, 6, 5, 4, 3, 2, 10, 9, 8, 7, 6, 5, 4, 3, 2)
    whole = joined(d.letters(8, alphabet), d.letters(2, alphabet), d.digits(6))
    total = lambda t: " + ".join(f"CAST(translate(substr({t}, {k + 1}, 1), '{alphabet}', '{values}') AS INTEGER) * {w}" for k, w in enumerate(weights))
    check = lambda t: let(f"({total(t)}) % 11", lambda c: f"CASE WHEN {c} = 10 THEN 'X' ELSE {text(c)} END")
    return let(whole, lambda t: f"substr({t}, 1, 8) || {check(t)} || substr({t}, 9)")


def _uuid(d: SqlDraws) -> str:
    h, variant = d.hex(30), d.pick(list("89ab"))
    cut = lambda t: joined(f"substr({t}, 1, 8)", f"substr({t}, 9, 4)", f"'4' || substr({t}, 13, 3)", f"{variant} || substr({t}, 16, 3)", f"substr({t}, 19, 12)", by="-")
    return let(h, cut)


def _iban(d: SqlDraws) -> str:
    return let(d.digits(18), lambda t: f"'DE' || lpad({text(f'(98 - CAST({t} || 131400 AS HUGEINT) % 97)')}, 2, '0') || {t}")


def _checked(body: str, digit: Callable[[str], str]) -> str:
    return let(body, lambda t: f"{t} || {digit(t)}")


KINDS_SQL: dict[str, Callable[[SqlDraws], str]] = {
    **{name: (lambda values: lambda d: d.pick(values))(values) for name, values in LISTS.items()},
    "name": lambda d: joined(d.words("first"), "' '", d.words("last")),
    "firstname": lambda d: d.words("first"),
    "lastname": lambda d: d.words("last"),
    "middlename": lambda d: d.words("first"),
    "username": lambda d: d.handle(),
    "email": lambda d: joined(d.handle(), "'@example.'", d.pick(["com", "org", "net"])),
    "phone": lambda d: joined(d.words("phone"), text(d.between(200, 999)), d.digits(7)),
    "password": lambda d: joined(d.letters(6), d.digits(3), d.letters(4, "abcdefghijkmnpqrstuvwxyz"), d.pick(list("!#%+*"))),
    "ssn": lambda d: joined(d.padded(1, 665, 3), d.padded(1, 99, 2), d.padded(1, 9999, 4), by="-"),
    "passport": lambda d: joined(d.letters(2), d.digits(7)),
    "street": lambda d: joined(text(d.between(1, 9999)), "' '", d.words("street")),
    "city": lambda d: d.words("city"),
    "region": lambda d: d.words("region"),
    "postcode": lambda d: d.digits(5),
    "country": lambda d: d.words("country"),
    "latitude": lambda d: f"({d.unit()} * 180 - 90)",
    "longitude": lambda d: f"({d.unit()} * 360 - 180)",
    "company": lambda d: joined(d.words("last"), d.pick([" & Sons", " Group", " Ltd", " Inc", " Partners"])),
    "catchphrase": lambda d: joined(
        d.pick(["Adaptive", "Balanced", "Focused", "Open", "Robust"]), d.pick(["local", "modular", "global", "regional"]), d.pick(["solution", "network", "approach", "platform"]), by=" "
    ),
    "amount": lambda d: f"(floor({d.number(0.01, 1000.0)} * 100) / 100)",
    "iban": _iban,
    "swift": lambda d: joined(d.letters(4), d.pick(["DE", "FR", "US", "GB"]), d.letters(2), "'XXX'"),
    "card": lambda d: _checked(joined("'4'", d.digits(14)), lambda b: _luhn(b, 15)),
    "cardexpiry": lambda d: joined(d.padded(1, 12, 2), text(d.between(27, 34)), by="/"),
    "stockticker": lambda d: d.letters(4),
    "product": lambda d: joined(d.pick(["Compact", "Classic", "Light", "Smart"]), d.pick(LISTS["productmaterial"]), d.pick(["chair", "lamp", "shirt", "bottle", "table"]), by=" "),
    "sku": lambda d: joined(d.letters(3), d.digits(4), d.letters(2), by="-"),
    "ean13": lambda d: _checked(d.digits(12), _ean),
    "isbn": lambda d: _checked(joined("'978'", d.digits(9)), _ean),
    "hexcolor": lambda d: joined("'#'", d.hex(6)),
    "url": lambda d: joined("'https://'", d.domain(), "'/'", d.pick(WORDS)),
    "domain": lambda d: d.domain(),
    "slug": lambda d: joined(d.pick(WORDS), d.pick(WORDS), text(d.below(10_000)), by="-"),
    "ipv4": lambda d: joined(*[text(d.between(1, 254)) for _ in range(4)], by="."),
    "ipv6": lambda d: joined(*[d.hex(4) for _ in range(8)], by=":"),
    "mac": lambda d: joined(*[d.hex(2) for _ in range(6)], by=":"),
    "httpstatus": lambda d: d.pick([200, 201, 204, 301, 302, 400, 401, 403, 404, 409, 500, 503]),
    "imageurl": lambda d: joined("'https://'", d.domain(), "'/images/'", d.digits(5), "'.jpg'"),
    "semver": lambda d: joined(*[text(d.below(20)) for _ in range(3)], by="."),
    "md5": lambda d: f"md5({d.hex(28)})",
    "sha256": lambda d: f"sha256({d.hex(28)})",
    "word": lambda d: d.pick(WORDS),
    "sentence": lambda d: d.sentence(8),
    "paragraph": lambda d: joined(*[d.sentence(8) for _ in range(4)], by=" "),
    "lorem": lambda d: joined("'Lorem ipsum '", d.sentence(16)),
    "title": lambda d: joined(*[let(d.pick(WORDS), lambda t: f"upper(substr({t}, 1, 1)) || substr({t}, 2)") for _ in range(3)], by=" "),
    "int": lambda d: d.between(1, 999),
    "float": lambda d: d.number(0.0, 1000.0),
    "bool": lambda d: f"({d.unit()} < 0.5::DOUBLE)",
    "uuid": _uuid,
    "enum": lambda d: d.pick(["a", "b"]),
    "time": lambda d: f"CAST(make_timestamp(({TIME_FROM} + CAST(floor({d.unit()} * {TIME_TO - TIME_FROM}) AS BIGINT)) * 1000000) AS VARCHAR)",
    "unixtime": lambda d: f"({TIME_FROM} + CAST(floor({d.unit()} * {TIME_TO - TIME_FROM}) AS BIGINT))",
    "year": lambda d: d.between(1990, 2025),
    "licenseplate": lambda d: joined(d.letters(3), "'-'", d.digits(4)),
    "vin": _vin,
}
