"""Value kinds: each returns a Column computed from the row id and a salt.

Word lists are this library's own.  ``register_generator`` adds a kind; it
gets a :class:`Draws` and the options and returns a Column.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from rowforge.functions.draw import P, below, unit

#: first and last names, cities, regions, streets, countries by locale; other locales use en_US
LOCALES: dict[str, dict[str, list[str]]] = {
    "en_US": {
        "first": "James Mary John Linda Robert Susan David Karen Paul Laura Mark Emily Kevin Alice Brian Grace Eric Helen Adam Ruth".split(),
        "last": "Smith Johnson Brown Miller Davis Wilson Moore Taylor Clark Lewis Walker Hall Young King Wright Hill Green Baker Adams Carter".split(),
        "city": "Springfield Riverton Fairview Georgetown Madison Clinton Salem Bristol Dover Ashland Oxford Milton Auburn Dayton Newport".split(),
        "region": "California Texas Ohio Florida Oregon Nevada Maine Utah Iowa Kansas Georgia Virginia".split(),
        "street": ["Oak Street", "Maple Avenue", "Main Street", "Park Road", "Cedar Lane", "Hill Drive", "Lake View", "Church Street"],
        "country": ["United States"],
        "phone": ["+1"],
    },
    "de_DE": {
        "first": "Lukas Anna Jonas Lena Felix Marie Paul Laura Max Julia Tim Sophie".split(),
        "last": "Müller Schmidt Schneider Fischer Weber Meyer Wagner Becker Schulz Hoffmann".split(),
        "city": "Berlin Hamburg München Köln Frankfurt Stuttgart Leipzig Dresden Bremen".split(),
        "region": "Bayern Hessen Sachsen Berlin Hamburg Bremen Saarland".split(),
        "street": ["Hauptstraße", "Bahnhofstraße", "Gartenweg", "Schulstraße", "Lindenallee"],
        "country": ["Deutschland"],
        "phone": ["+49"],
    },
    "fr_FR": {
        "first": "Louis Emma Hugo Jade Lucas Louise Jules Alice Adam Chloé".split(),
        "last": "Martin Bernard Thomas Petit Robert Richard Durand Dubois Moreau Laurent".split(),
        "city": "Paris Lyon Marseille Toulouse Nice Nantes Lille Bordeaux Rennes".split(),
        "region": "Bretagne Normandie Occitanie Corse Alsace Provence".split(),
        "street": ["Rue de la Paix", "Avenue Victor Hugo", "Rue du Moulin", "Place de la Gare"],
        "country": ["France"],
        "phone": ["+33"],
    },
    "es_ES": {
        "first": "Hugo Lucía Martín Sofía Pablo María Daniel Paula Álvaro Carla".split(),
        "last": "García Fernández González Rodríguez López Martínez Sánchez Pérez Gómez".split(),
        "city": "Madrid Barcelona Valencia Sevilla Zaragoza Málaga Murcia Bilbao".split(),
        "region": "Andalucía Cataluña Galicia Aragón Madrid Murcia".split(),
        "street": ["Calle Mayor", "Avenida del Sol", "Calle Real", "Plaza de España"],
        "country": ["España"],
        "phone": ["+34"],
    },
    "it_IT": {
        "first": "Luca Giulia Marco Sofia Andrea Chiara Matteo Aurora".split(),
        "last": "Rossi Russo Ferrari Esposito Bianchi Romano Colombo Ricci".split(),
        "city": "Roma Milano Napoli Torino Palermo Genova Bologna".split(),
        "region": "Lombardia Toscana Lazio Sicilia Veneto".split(),
        "street": ["Via Roma", "Corso Italia", "Viale dei Mille", "Piazza Dante"],
        "country": ["Italia"],
        "phone": ["+39"],
    },
    "pt_BR": {
        "first": "Miguel Helena Arthur Alice Davi Laura João Beatriz".split(),
        "last": "Silva Santos Oliveira Souza Lima Pereira Costa Araújo".split(),
        "city": ["São Paulo", "Salvador", "Fortaleza", "Curitiba", "Recife", "Belém"],
        "region": ["Bahia", "Ceará", "Paraná", "Goiás", "Pernambuco"],
        "street": ["Rua das Flores", "Avenida Brasil", "Rua Sete de Setembro", "Travessa da Paz"],
        "country": ["Brasil"],
        "phone": ["+55"],
    },
    "nl_NL": {
        "first": "Daan Emma Sem Julia Lucas Mila Finn Tess".split(),
        "last": ["de Jong", "Jansen", "de Vries", "Bakker", "Visser", "Smit", "Mulder"],
        "city": "Amsterdam Rotterdam Utrecht Eindhoven Groningen Breda".split(),
        "region": ["Utrecht", "Gelderland", "Drenthe", "Zeeland", "Limburg"],
        "street": ["Dorpsstraat", "Kerkstraat", "Molenweg", "Schoolstraat"],
        "country": ["Nederland"],
        "phone": ["+31"],
    },
    "pl_PL": {
        "first": "Jan Zofia Jakub Julia Antoni Maja Szymon Hanna".split(),
        "last": "Nowak Kowalski Wiśniewski Wójcik Kamiński Zieliński Szymański".split(),
        "city": "Warszawa Kraków Łódź Wrocław Poznań Gdańsk".split(),
        "region": "Mazowieckie Małopolskie Śląskie Podlaskie Lubelskie".split(),
        "street": ["ul. Polna", "ul. Leśna", "ul. Słoneczna", "ul. Krótka"],
        "country": ["Polska"],
        "phone": ["+48"],
    },
}

WORDS = (
    "lorem ipsum dolor sit amet tempor magna aliqua enim minim veniam quis nostrud exercitation labore dolore irure velit esse fugiat nulla "
    "pariatur sint occaecat cupidatat proident sunt culpa officia mollit anim laborum"
).split()

#: kinds that pick one of a list
LISTS: dict[str, list[str]] = {
    "namesuffix": ["Jr.", "Sr.", "II", "III", "PhD", "MD"],
    "gender": ["female", "male", "non-binary"],
    "maritalstatus": ["single", "married", "divorced", "widowed", "separated"],
    "education": ["High school", "Associate degree", "Bachelor's degree", "Master's degree", "Doctorate"],
    "bloodtype": ["A+", "A-", "B+", "B-", "AB+", "AB-", "O+", "O-"],
    "countrycode": ["US", "DE", "FR", "ES", "IT", "GB", "JP", "CA", "BR", "IN", "AU", "SE"],
    "continent": ["Africa", "Antarctica", "Asia", "Europe", "North America", "Oceania", "South America"],
    "timezone": ["UTC", "Europe/Berlin", "Europe/Paris", "America/New_York", "America/Chicago", "Asia/Tokyo", "Asia/Kolkata", "Australia/Sydney"],
    "job": ["Accountant", "Analyst", "Architect", "Chef", "Designer", "Engineer", "Manager", "Nurse", "Teacher", "Translator"],
    "department": ["Sales", "Marketing", "Finance", "Legal", "Support", "Research", "Operations", "Human Resources"],
    "jobarea": ["Accounts", "Brand", "Data", "Markets", "Mobility", "Quality", "Security"],
    "joblevel": ["Junior", "Associate", "Senior", "Lead", "Principal", "Chief"],
    "brand": ["Nordwind", "Clearpeak", "Bluefern", "Sunvale", "Ironleaf", "Quickstone"],
    "currency": ["USD", "EUR", "GBP", "JPY", "CHF", "CAD", "AUD", "SEK"],
    "currencyname": ["US Dollar", "Euro", "Pound Sterling", "Yen", "Swiss Franc", "Canadian Dollar"],
    "currencysymbol": ["$", "€", "£", "¥", "₹", "₩"],
    "bankname": ["First Harbor Bank", "Union Savings", "City Trust", "Valley Credit", "Northern Bank"],
    "accounttype": ["checking", "savings", "business", "credit", "investment"],
    "paymentmethod": ["card", "cash", "bank transfer", "invoice", "wallet"],
    "crypto": ["BTC", "ETH", "LTC", "XRP", "ADA", "DOT"],
    "productcategory": ["Books", "Clothing", "Electronics", "Garden", "Grocery", "Home", "Sports", "Toys"],
    "productmaterial": ["cotton", "steel", "wood", "granite", "rubber", "bronze", "plastic", "linen"],
    "color": ["red", "green", "blue", "black", "white", "orange", "violet", "teal", "silver", "maroon"],
    "useragent": [
        "Mozilla/5.0 (X11; Linux x86_64) Gecko/20100101 Firefox/128.0",
        "Mozilla/5.0 (Windows NT 10.0; Win64; x64) AppleWebKit/537.36 Chrome/126.0 Safari/537.36",
        "Mozilla/5.0 (Macintosh; Intel Mac OS X 14_5) AppleWebKit/605.1.15 Version/17.5 Safari/605.1.15",
    ],
    "httpmethod": ["GET", "POST", "PUT", "PATCH", "DELETE", "HEAD", "OPTIONS"],
    "mimetype": ["text/html", "text/plain", "application/json", "application/pdf", "image/png", "image/jpeg", "video/mp4"],
    "os": ["Linux", "Windows", "macOS", "Android", "iOS"],
    "browser": ["Firefox", "Chrome", "Safari", "Edge", "Opera"],
    "device": ["phone", "tablet", "laptop", "desktop", "watch"],
    "fileext": ["txt", "csv", "pdf", "png", "jpg", "docx", "json", "zip"],
    "month": "January February March April May June July August September October November December".split(),
    "weekday": "Monday Tuesday Wednesday Thursday Friday Saturday Sunday".split(),
    "vehiclemake": ["Toyota", "Ford", "Honda", "Volvo", "Fiat", "Mazda", "Skoda"],
    "vehiclemodel": ["Corolla", "Focus", "Civic", "V60", "Panda", "CX-5", "Octavia"],
    "airport": ["JFK", "LHR", "CDG", "FRA", "MAD", "HND", "SYD", "GRU", "DXB"],
    "airline": ["Northern Air", "Blue Sky", "Atlantic Wings", "Pacific Jet", "Alpine Air"],
    "university": ["Lakeside University", "Northgate College", "State Technical University", "University of Riverton"],
    "languagename": ["English", "German", "French", "Spanish", "Italian", "Japanese", "Hindi", "Swahili", "Uzbek"],
    "food": ["bread", "rice", "pasta", "soup", "salad", "curry", "pizza", "tacos", "dumplings"],
    "drink": ["water", "tea", "coffee", "juice", "lemonade", "milk", "cider"],
    "animal": ["cat", "dog", "horse", "fox", "otter", "heron", "lynx", "whale", "beetle"],
    "sport": ["football", "tennis", "chess", "rowing", "cycling", "judo", "swimming"],
    "musicgenre": ["jazz", "rock", "folk", "blues", "techno", "classical", "reggae"],
    "framework": ["Django", "Rails", "Spring", "React", "Vue", "Flask", "Laravel"],
    "emoji": ["😀", "🎉", "🚀", "🌱", "🔥", "⭐", "🐙", "🍀"],
}

STRUCTURE = ("foreign_key", "default", "sequence", "pattern", "const", "null")


def words_of(locale: str, name: str) -> list[str]:
    return LOCALES.get(locale, LOCALES["en_US"])[name]


def _ascii(word: str) -> str:
    """A word as addresses spell it."""
    plain = unicodedata.normalize("NFKD", word.lower().replace("ß", "s").replace("ł", "l"))
    return "".join(c for c in plain if c.isascii() and c.isalnum())


@dataclass
class Draws:
    """Independent draws for one cell; each call takes the next salt."""

    row: Column
    salt: int
    locale: str = "en_US"
    used: int = 0

    def _next(self) -> int:
        self.used += 1
        return (self.salt + 104729 * self.used) % P

    def below(self, n: int) -> Column:
        return below(self.row, self._next(), n)

    def unit(self) -> Column:
        return unit(self.row, self._next())

    def pick(self, values: Sequence[Any]) -> Column:
        return F.get(F.array(*[F.lit(v) for v in values]), self.below(len(values)).cast("int"))

    def words(self, name: str, change: Callable[[str], str] = str) -> Column:
        return self.pick([change(w) for w in words_of(self.locale, name)])

    def between(self, low: int, high: int) -> Column:
        return self.below(high - low + 1) + low

    def digits(self, n: int) -> Column:
        parts = [F.lpad(self.below(10 ** min(9, n - k)).cast("string"), min(9, n - k), "0") for k in range(0, n, 9)]
        return F.concat(*parts)

    def letters(self, n: int, alphabet: str = "ABCDEFGHIJKLMNOPQRSTUVWXYZ") -> Column:
        return F.concat(*[F.substring(F.lit(alphabet), (self.below(len(alphabet)) + 1).cast("int"), F.lit(1)) for _ in range(n)])

    def hex(self, n: int) -> Column:
        parts = [F.lpad(F.lower(F.hex(self.below(16 ** min(7, n - k)))), min(7, n - k), "0") for k in range(0, n, 7)]
        return F.concat(*parts)


def _digit(text: Column, k: int) -> Column:
    return F.substring(text, k + 1, 1).cast("int")


def luhn_digit(body: Column, n: int) -> Column:
    """Check digit for ``n`` digits by Luhn."""
    total = F.lit(0)
    for k in range(n):
        d = _digit(body, n - 1 - k)
        total = total + (F.when(d > 4, 2 * d - 9).otherwise(2 * d) if k % 2 == 0 else d)
    return F.pmod(10 - total % 10, F.lit(10)).cast("string")


def ean_digit(body: Column) -> Column:
    """Check digit for 12 digits with weights 1 and 3."""
    total = F.lit(0)
    for k in range(12):
        total = total + _digit(body, k) * (1 + 2 * (k % 2))
    return F.pmod(10 - total % 10, F.lit(10)).cast("string")


def iban_check(bban: Column, country: str) -> Column:
    """Two check digits of an IBAN whose account part is all digits (mod 97)."""
    tail = "".join(str(ord(c) - 55) for c in country) + "00"
    number = F.concat(bban, F.lit(tail)).cast("decimal(38,0)")
    return F.lpad((98 - (number % F.lit(97)).cast("int")).cast("string"), 2, "0")


def vin_check(front: Column, back: Column) -> Column:
    """Ninth character of a VIN from the eight before and the eight after it."""
    letters, values = "ABCDEFGHJKLMNPRSTUVWXYZ0123456789", "12345678123457923456789" + "0123456789"
    weights = (8, 7, 6, 5, 4, 3, 2, 10, 9, 8, 7, 6, 5, 4, 3, 2)
    total = F.lit(0)
    for k, w in enumerate(weights):
        c = F.substring(front, k + 1, 1) if k < 8 else F.substring(back, k - 7, 1)
        total = total + F.translate(c, letters, values).cast("int") * w
    return F.when(total % 11 == 10, "X").otherwise((total % 11).cast("string"))


def _sentence(d: Draws, n: int) -> Column:
    text = F.concat_ws(" ", *[d.pick(WORDS) for _ in range(n)])
    return F.concat(F.upper(F.substring(text, 1, 1)), F.substring(text, F.lit(2), F.length(text)), F.lit("."))


def _cut(value: Column, options: dict) -> Column:
    return F.substring(value, 1, int(options["max"])) if options.get("max") else value


def _number(d: Draws, options: dict, low: float, high: float) -> Column:
    a = float(options["min"]) if options.get("min") is not None else low
    b = float(options["max"]) if options.get("max") is not None else max(high, a)
    return F.lit(a) + d.unit() * (b - a)


def _whole(d: Draws, options: dict, low: int, high: int) -> Column:
    a = int(float(options["min"])) if options.get("min") is not None else low
    b = int(float(options["max"])) if options.get("max") is not None else max(high, a)
    return d.between(a, max(a, b)).cast("long")


#: seconds of the first moment of 2024 and of 2026: the range of times without bounds
TIME_FROM, TIME_TO = 1704067200, 1767225600


def _seconds(d: Draws, options: dict) -> Column:
    def bound(value, default):
        if value is None:
            return F.lit(default).cast("long")
        if isinstance(value, (int, float)):
            return F.lit(int(value)).cast("long")
        return F.unix_timestamp(F.lit(str(value)).cast("timestamp"))

    low, high = bound(options.get("min"), TIME_FROM), bound(options.get("max"), TIME_TO - 1)
    return low + F.floor(d.unit() * (high - low + 1)).cast("long")


def _handle(d: Draws) -> Column:
    return F.concat(d.words("first", _ascii), F.lit("."), d.words("last", _ascii), d.below(10_000).cast("string"))


def _email(d: Draws, options: dict) -> Column:
    """An address; with ``number`` its local part ends in + and that number."""
    local = [_handle(d)] + ([F.lit("+"), options["number"].cast("string")] if "number" in options else [])
    return F.concat(*local, F.lit("@example."), d.pick(["com", "org", "net"]))


def longest(kind: str, locale: str) -> int | None:
    """Characters of the longest value of a kind, where its lists say."""
    most = lambda name: max(map(len, words_of(locale, name)))
    if kind in LISTS:
        return max(map(len, LISTS[kind]))
    return {
        "firstname": lambda: most("first"),
        "middlename": lambda: most("first"),
        "lastname": lambda: most("last"),
        "name": lambda: most("first") + 1 + most("last"),
        "city": lambda: most("city"),
        "region": lambda: most("region"),
        "country": lambda: most("country"),
        "street": lambda: 5 + most("street"),
        "phone": lambda: most("phone") + 10,
        "company": lambda: most("last") + len(" Partners"),
        "email": lambda: most("first") + 1 + most("last") + 4 + len("@example.com"),
        "uuid": lambda: 36,
        "word": lambda: max(map(len, WORDS)),
        "postcode": lambda: 5,
    }.get(kind, lambda: None)()


def _domain(d: Draws) -> Column:
    return F.concat(d.pick(WORDS), F.lit("-"), d.pick(WORDS), d.pick([".com", ".org", ".net", ".io"]))


def _enum(d: Draws, options: dict) -> Column:
    values, weights = list(options.get("values") or []), options.get("weights")
    if not values:
        raise ValueError("enum needs values")
    if not weights:
        return d.pick(values)
    total, at, u = float(sum(weights)), 0.0, d.unit()
    out: Column | None = None
    for value, weight in zip(values, weights, strict=True):
        at += weight / total
        out = F.when(u < at, F.lit(value)) if out is None else out.when(u < at, F.lit(value))
    return out.otherwise(F.lit(values[-1]))


def _uuid(d: Draws, _: dict) -> Column:
    h = d.hex(30)
    return F.concat_ws(
        "-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("4"), F.substring(h, 13, 3)), F.concat(d.pick(list("89ab")), F.substring(h, 16, 3)), F.substring(h, 19, 12)
    )


def _iban(d: Draws, _: dict) -> Column:
    bban = d.digits(18)
    return F.concat(F.lit("DE"), iban_check(bban, "DE"), bban)


def _vin(d: Draws, _: dict) -> Column:
    alphabet = "ABCDEFGHJKLMNPRSTUVWXYZ0123456789"
    front, back = d.letters(8, alphabet), F.concat(d.letters(2, alphabet), d.digits(6))
    return F.concat(front, vin_check(front, back), back)


def _with_check(body: Column, digit: Callable[[Column], Column]) -> Column:
    return F.concat(body, digit(body))


Generator = Callable[[Draws, dict], Column]

KINDS: dict[str, Generator] = {
    **{name: (lambda values: lambda d, o: d.pick(values))(values) for name, values in LISTS.items()},
    "name": lambda d, o: F.concat(d.words("first"), F.lit(" "), d.words("last")),
    "firstname": lambda d, o: d.words("first"),
    "lastname": lambda d, o: d.words("last"),
    "middlename": lambda d, o: d.words("first"),
    "username": lambda d, o: _handle(d),
    "email": _email,
    "phone": lambda d, o: F.concat(d.words("phone"), d.between(200, 999).cast("string"), d.digits(7)),
    "password": lambda d, o: F.concat(d.letters(6), d.digits(3), d.letters(4, "abcdefghijkmnpqrstuvwxyz"), d.pick(list("!#%+*"))),
    "ssn": lambda d, o: F.concat_ws("-", F.lpad(d.between(1, 665).cast("string"), 3, "0"), F.lpad(d.between(1, 99).cast("string"), 2, "0"), F.lpad(d.between(1, 9999).cast("string"), 4, "0")),
    "passport": lambda d, o: F.concat(d.letters(2), d.digits(7)),
    "street": lambda d, o: F.concat(d.between(1, 9999).cast("string"), F.lit(" "), d.words("street")),
    "city": lambda d, o: d.words("city"),
    "region": lambda d, o: d.words("region"),
    "postcode": lambda d, o: d.digits(5),
    "country": lambda d, o: d.words("country"),
    "latitude": lambda d, o: d.unit() * 180 - 90,
    "longitude": lambda d, o: d.unit() * 360 - 180,
    "company": lambda d, o: F.concat(d.words("last"), d.pick([" & Sons", " Group", " Ltd", " Inc", " Partners"])),
    "catchphrase": lambda d, o: F.concat(d.pick(["Adaptive", "Balanced", "Focused", "Open", "Robust"]), F.lit(" "), d.pick(["local", "modular", "global", "regional"]), F.lit(" "), d.pick(["solution", "network", "approach", "platform"])),
    "amount": lambda d, o: F.floor(_number(d, o, 0.01, 1000.0) * 100) / 100,
    "iban": _iban,
    "swift": lambda d, o: F.concat(d.letters(4), d.pick(["DE", "FR", "US", "GB"]), d.letters(2), F.lit("XXX")),
    "card": lambda d, o: _with_check(F.concat(F.lit("4"), d.digits(14)), lambda b: luhn_digit(b, 15)),
    "cardexpiry": lambda d, o: F.concat_ws("/", F.lpad(d.between(1, 12).cast("string"), 2, "0"), d.between(27, 34).cast("string")),
    "stockticker": lambda d, o: d.letters(4),
    "product": lambda d, o: F.concat(d.pick(["Compact", "Classic", "Light", "Smart"]), F.lit(" "), d.pick(LISTS["productmaterial"]), F.lit(" "), d.pick(["chair", "lamp", "shirt", "bottle", "table"])),
    "sku": lambda d, o: F.concat_ws("-", d.letters(3), d.digits(4), d.letters(2)),
    "ean13": lambda d, o: _with_check(d.digits(12), ean_digit),
    "isbn": lambda d, o: _with_check(F.concat(F.lit("978"), d.digits(9)), ean_digit),
    "hexcolor": lambda d, o: F.concat(F.lit("#"), d.hex(6)),
    "url": lambda d, o: F.concat(F.lit("https://"), _domain(d), F.lit("/"), d.pick(WORDS)),
    "domain": lambda d, o: _domain(d),
    "slug": lambda d, o: F.concat_ws("-", d.pick(WORDS), d.pick(WORDS), d.below(10_000).cast("string")),
    "ipv4": lambda d, o: F.concat_ws(".", *[d.between(1, 254).cast("string") for _ in range(4)]),
    "ipv6": lambda d, o: F.concat_ws(":", *[d.hex(4) for _ in range(8)]),
    "mac": lambda d, o: F.concat_ws(":", *[d.hex(2) for _ in range(6)]),
    "httpstatus": lambda d, o: d.pick([200, 201, 204, 301, 302, 400, 401, 403, 404, 409, 500, 503]),
    "imageurl": lambda d, o: F.concat(F.lit("https://"), _domain(d), F.lit("/images/"), d.digits(5), F.lit(".jpg")),
    "semver": lambda d, o: F.concat_ws(".", *[d.below(20).cast("string") for _ in range(3)]),
    "md5": lambda d, o: F.md5(d.hex(28).cast("binary")),
    "sha256": lambda d, o: F.sha2(d.hex(28).cast("binary"), 256),
    "word": lambda d, o: _cut(d.pick(WORDS), o),
    "sentence": lambda d, o: _cut(_sentence(d, 8), o),
    "paragraph": lambda d, o: _cut(F.concat_ws(" ", *[_sentence(d, 8) for _ in range(4)]), o),
    "lorem": lambda d, o: _cut(F.concat(F.lit("Lorem ipsum "), _sentence(d, 16)), o),
    "title": lambda d, o: F.initcap(F.concat_ws(" ", *[d.pick(WORDS) for _ in range(3)])),
    "int": lambda d, o: _whole(d, o, 1, 999),
    "float": lambda d, o: _number(d, o, 0.0, 1000.0),
    "bool": lambda d, o: d.unit() < float(o.get("true_weight") if o.get("true_weight") is not None else 0.5),
    "uuid": _uuid,
    "enum": _enum,
    "time": lambda d, o: F.timestamp_seconds(_seconds(d, o)),
    "unixtime": lambda d, o: _seconds(d, o),
    "year": lambda d, o: _whole(d, o, 1990, 2025),
    "licenseplate": lambda d, o: F.concat(d.letters(3), F.lit("-"), d.digits(4)),
    "vin": _vin,
}


#: the kinds that come with the library, as they came
OWN = dict(KINDS)


def register_generator(kind: str, generator: Generator) -> None:
    """Add or replace a kind; the function returns a Column and so stays in the plan."""
    if kind in STRUCTURE:
        raise ValueError(f"{kind} is part of the structure and cannot be replaced")
    KINDS[kind] = generator


def generate(kind: str, draws: Draws, options: dict) -> Column:
    if kind not in KINDS:
        raise ValueError(f"unknown generator {kind!r}")
    return KINDS[kind](draws, options)
