"""Prices, masses, volumes, lengths and powers in common units.

Stated amounts (a unit stands in the key or value) are converted with exact fractions. Amounts
without a unit are given one by a log-scale mixture: per quantity a component for every unit (for
prices every currency of the rates), all of one shape and shifted against each other by the
logarithm of the known conversion factor; expectation-maximisation fits the centre, the spread and
the weights, first of all amounts, then of each seller, and every amount gets the unit of the
highest posterior, flagged uncertain below a threshold. The fit sees the exact amounts of all rows,
equal ones of a seller once with their count, and its rounds run on the executors until nothing moves.
"""

from __future__ import annotations

import math
import re
from collections.abc import Generator, Iterator
from dataclasses import dataclass, replace
from decimal import Decimal, InvalidOperation
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnlight.runtime import broadcast_if_small, durable, spread, unambiguous

# Exact conversion factors (international avoirdupois pound, inch, US gallon / 128).
LB = Fraction(45359237, 100000)
OZ = LB / 16
FL_OZ = Fraction(295735295625, 10**10)
INCH = Fraction(254, 10)
# Unit words by quantity; the common units are g, ml, mm and W.
UNITS: dict[str, dict[str, Fraction]] = {
    "mass": {
        "mg": Fraction(1, 1000), "g": Fraction(1), "gr": Fraction(1), "gram": Fraction(1), "grams": Fraction(1),
        "gramm": Fraction(1), "gramme": Fraction(1), "grammes": Fraction(1), "kg": Fraction(1000), "kgs": Fraction(1000),
        "kilo": Fraction(1000), "kilos": Fraction(1000), "kilogram": Fraction(1000), "kilograms": Fraction(1000),
        "kilogramm": Fraction(1000), "oz": OZ, "ounce": OZ, "ounces": OZ, "unze": OZ, "unzen": OZ, "lb": LB, "lbs": LB,
        "pound": LB, "pounds": LB, "pfund": Fraction(500),
    },
    "volume": {
        "ml": Fraction(1), "cc": Fraction(1), "millilitre": Fraction(1), "millilitres": Fraction(1), "milliliter": Fraction(1),
        "milliliters": Fraction(1), "cl": Fraction(10), "centilitre": Fraction(10), "centilitres": Fraction(10), "dl": Fraction(100),
        "l": Fraction(1000), "ltr": Fraction(1000), "liter": Fraction(1000), "liters": Fraction(1000), "litre": Fraction(1000),
        "litres": Fraction(1000), "fl oz": FL_OZ, "fluid ounce": FL_OZ, "fluid ounces": FL_OZ,
    },
    "length": {
        "mm": Fraction(1), "millimetre": Fraction(1), "millimetres": Fraction(1), "millimeter": Fraction(1), "millimeters": Fraction(1),
        "cm": Fraction(10), "centimetre": Fraction(10), "centimetres": Fraction(10), "centimeter": Fraction(10), "centimeters": Fraction(10),
        "m": Fraction(1000), "meter": Fraction(1000), "meters": Fraction(1000), "metre": Fraction(1000), "metres": Fraction(1000),
        "in": INCH, "inch": INCH, "inches": INCH, "zoll": INCH, '"': INCH, "ft": INCH * 12, "foot": INCH * 12, "feet": INCH * 12, "'": INCH * 12,
    },
    "power": {
        "w": Fraction(1), "watt": Fraction(1), "watts": Fraction(1), "kw": Fraction(1000), "kilowatt": Fraction(1000), "kilowatts": Fraction(1000),
    },
}
# Words of keys that name a quantity.
KEY_WORDS = {
    "mass": ("weight", "gewicht", "berat", "mass", "peso", "poids"),
    "volume": ("volume", "volumen", "capacity", "kapasitas", "holds", "fassungsvermögen", "capacidad", "contenance"),
    "length": ("length", "länge", "panjang", "size", "dimension", "largo", "longueur"),
    "power": ("wattage", "power", "leistung", "daya listrik", "rated input", "potencia", "puissance"),
}
# Keys whose values are identifiers or colours, never amounts.
OTHER_KEYS = ("model", "mpn", "artikel", "sku", "part n", "colo", "farbe", "warna", "warranty", "garanti", "voltage", "spannung")
# Currency names and signs beside the ISO codes and the signs of the rate table.
CURRENCY_NAMES = {
    "us dollar": "USD", "us$": "USD", "singapore dollar": "SGD", "rupiah": "IDR", "ringgit": "MYR", "peso (ph)": "PHP",
    "baht": "THB", "đồng": "VND", "dong": "VND", "euro": "EUR", "pound sterling": "GBP", "yen": "JPY",
}

_BY_UNIT = {unit: (quantity, factor) for quantity, units in UNITS.items() for unit, factor in units.items()}
_NUMBER = r"\d+(?:[.,'   ]\d{3})+(?:[.,]\d{1,2})?(?!\d)|\d+ \d+/\d+|\d+/\d+|\d+(?:[.,]\d+)?"
_WORDS = sorted((u for u in _BY_UNIT if u[0].isalpha() and " " not in u), key=len, reverse=True)
_UNIT = r"fl\.?\s*oz|fluid\s+ounces?|" + "|".join(_WORDS) + r"|''|[\"″”'′’]"
_AMOUNT = re.compile(
    rf"(?<![\w.,/])({_NUMBER})[\s -]*({_UNIT})(?![^\W\d])\.?(?:\s*(\d+(?:[.,]\d+)?)\s*(oz|ounces?|in|inch|inches|[\"″”]|'')(?![^\W\d])\.?)?",
    re.I,
)
_ABOUT = re.compile(r"^\s*(?:approx\.?|approximately|about|ca\.?|circa|etwa|~|≈|±)\s*", re.I)
_AFTER = re.compile(r"\s*\((?:net|netto|gross|brutto|approx\.?)\)\s*$", re.I)
_BARE = re.compile(rf"\s*({_NUMBER})\s*")
_KEY_UNIT = re.compile(r"(?:[\[(]\s*([^\])]+?)\s*[\])]|\s(?:in|en)\s+([^\s]+))\s*$", re.I)
_PROSE = re.compile(r"[^\W\d_]{3,}")


def number(text: str) -> Fraction | None:
    """The value of a number as typed: groups of three digits, decimal comma or point, mixed fractions.

    One separator before exactly three digits groups thousands, unless a single 0 stands before it.
    """
    text = text.strip().replace(" ", " ").replace(" ", " ")
    if "/" in text:
        whole, _, part = text.rpartition(" ")
        top, bottom = part.split("/")
        if int(bottom) == 0:
            return None
        return Fraction(int(whole or 0)) + Fraction(int(top), int(bottom))
    text = text.replace(" ", "").replace("'", "")
    marks = [c for c in text if c in ".,"]
    if marks:
        head, last, tail = text.rpartition(marks[-1])
        grouped = len(tail) == 3 and len(set(marks)) == 1 and head not in ("", "0")
        if len(marks) > 1 and len(set(marks)) == 1:
            grouped = True
        text = re.sub(r"[.,]", "", text) if grouped else re.sub(r"[.,]", "", head) + "." + tail
    try:
        return Fraction(Decimal(text))
    except (InvalidOperation, ValueError):
        return None


def nearest(value: Fraction) -> int:
    """Nearest integer, halves up."""
    return math.floor(value + Fraction(1, 2))


def unit_of(text: str, key_quantity: str | None = None) -> tuple[str, Fraction] | None:
    text = re.sub(r"[″”]", '"', re.sub(r"[′’]", "'", text.strip().lower())).replace("''", '"').replace(".", " ")
    text = " ".join(text.split())
    text = {"floz": "fl oz"}.get(text, text)
    if text in ("oz", "ounce", "ounces") and key_quantity == "volume":
        text = "fl oz"
    return _BY_UNIT.get(text)


def key_quantity(key: str) -> str | None:
    key = key.lower()
    return next((q for q, words in KEY_WORDS.items() if any(w in key for w in words)), None)


def half_step(text: str, factor: Fraction = Fraction(1)) -> Fraction:
    """Half of the last place of a number as typed: how far a rounded amount may be off.

    Whole numbers of a large unit count as given to one decimal place, as trailing zeros are left out.
    """
    if "/" in text:
        return Fraction(1, 16)
    value, tail = number(text), re.search(r"[.,](\d+)\s*$", text)
    if tail and value is not None and value.denominator == 1 and len(tail[1]) == 3:
        tail = None  # a group of thousands
    return Fraction(1, 2 * 10 ** (len(tail[1]) if tail else int(factor >= 25)))


def amount_of(match: re.Match, quantity: str | None) -> tuple[str, Fraction, Fraction] | None:
    """(quantity, amount, half of the last place) of a match of the amount pattern."""
    unit, value = unit_of(match[2], quantity), number(match[1])
    if unit is None or value is None:
        return None
    total, step = value * unit[1], half_step(match[1], unit[1]) * unit[1]
    if match[3]:
        second, more = unit_of(match[4]), number(match[3])
        if second and more is not None and second[0] == unit[0] and second[1] < unit[1]:
            total, step = total + more * second[1], half_step(match[3]) * second[1]
    return unit[0], total, step


def stated(key: str, value: str | None) -> list[tuple[str, Fraction, Fraction]]:
    """(quantity, amount in the common unit, half of its last place) of one specification entry; the unit stands in the value or the key."""
    if not value or not value.strip():
        return []
    lowered = key.lower()
    if any(w in lowered for w in OTHER_KEYS):
        return []
    quantity = key_quantity(key)
    text = _AFTER.sub("", _ABOUT.sub("", value))
    whole = _AMOUNT.fullmatch(text.strip())
    if whole:
        found = amount_of(whole, quantity)
        return [found] if found else []
    bare = _BARE.fullmatch(text)
    if bare:
        named = _KEY_UNIT.search(key)
        unit = unit_of(named[1] or named[2], quantity) if named else None
        value_ = number(bare[1])
        return [(unit[0], value_ * unit[1], half_step(bare[1], unit[1]) * unit[1])] if unit and value_ is not None else []
    if not _PROSE.search(text):
        return []
    found = (amount_of(m, quantity) for m in _AMOUNT.finditer(text))
    return [x for x in found if x]


def unstated(key: str, value: str | None) -> tuple[str, float] | None:
    """(quantity, number) of an entry whose key names a quantity while neither key nor value has a unit."""
    if not value or any(w in key.lower() for w in OTHER_KEYS) or _KEY_UNIT.search(key):
        return None
    quantity, bare = key_quantity(key), _BARE.fullmatch(_AFTER.sub("", _ABOUT.sub("", value)))
    amount = number(bare[1]) if quantity and bare else None
    return (quantity, float(amount)) if amount else None


def unstated_price(price: str | None, currency: str | None) -> float | None:
    """The number of a price that is a number alone, where no currency is named in its column either."""
    if not price or (currency and currency.strip()):
        return None
    bare = _BARE.fullmatch(_AFTER.sub("", _ABOUT.sub("", price)))
    amount = number(bare[1]) if bare else None
    try:
        return float(amount) if amount else None
    except OverflowError:
        return None


class Prices:
    """Reads prices against a table of rates: currency code to (US dollars per unit, sign)."""

    def __init__(self, rates: list[tuple[str, float, str | None]]):
        self.usd = {code: Fraction(Decimal(repr(rate))) for code, rate, _ in rates}
        self.names = {n: c for n, c in CURRENCY_NAMES.items() if c in self.usd}
        self.names |= {code.lower(): code for code in self.usd} | {sign.lower(): code for code, _, sign in rates if sign}
        marks = sorted(self.names, key=len, reverse=True)
        self.mark = re.compile("|".join(rf"(?<![^\W\d_]){re.escape(m)}(?![^\W\d_])" if m[0].isalpha() and m[-1].isalpha() else re.escape(m) for m in marks), re.I)
        self.amount = re.compile(rf"({_NUMBER})\s*(ribu|rb|k|jt|juta|cents?|c|minor units?)?(?![^\W\d_])", re.I)

    def currency(self, text: str | None) -> str | None:
        return self.names.get(" ".join(text.lower().split())) if text else None

    def cents(self, price: str | None, currency: str | None) -> Fraction | None:
        """The price in US cents; the currency column counts, or where it says nothing, the text of the price."""
        if not price:
            return None
        text = price.strip()
        mark = self.mark.search(text)
        code = self.currency(currency) or (self.names[mark[0].lower()] if mark else None)
        if code is None:
            return None
        found = self.amount.search(self.mark.sub(" ", text))
        value = number(found[1]) if found else None
        if value is None:
            return None
        scale = (found[2] or "").lower()
        if scale in ("ribu", "rb", "k"):
            value *= 1000
        elif scale in ("jt", "juta"):
            value *= 1000000
        elif scale:
            value /= 100
        return value * self.usd[code] * 100


def _rate_rows(rates: DataFrame) -> list[tuple[str, float, str | None]]:
    known = rates.select("currency", "usd_per_unit", "symbol").dropna(subset=["currency", "usd_per_unit"]).limit(1001).collect()
    if len(known) > 1000:
        raise ValueError("more than 1,000 currencies")
    return [tuple(r) for r in known]


def extract(products: DataFrame, rates: DataFrame) -> DataFrame:
    """Every amount of every listing: listing_id, seen_at, quantity, amount (common unit), is_stated, source, seller.

    products: listing_id, seen_at, price, currency, specifications, and seller_id where there is
    one. rates (currency, usd_per_unit, symbol) is the table of currencies of the world and is read
    to the driver: at most 1,000 rows, else an error. NULL and empty prices and specifications,
    unknown currencies and unreadable numbers give no row. Amounts without unit, and prices without
    any currency, keep their number, is_stated false. Where several entries state one quantity, the
    one whose key comes first by alphabet counts.
    """
    rate_rows = _rate_rows(rates)
    schema = pa.schema([("listing_id", pa.int64()), ("seen_at", pa.timestamp("us")), ("quantity", pa.string()), ("amount", pa.float64()), ("rounded", pa.int64()), ("is_stated", pa.bool_()), ("source", pa.string()), ("seller", pa.string())])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        prices = Prices(rate_rows)
        seen: dict[tuple[str, str | None], list] = {}
        for batch in batches:
            out: list[tuple] = []
            for lid, at, price, currency, keys, values, seller in zip(*(c.to_pylist() for c in batch.columns)):
                cents = prices.cents(price, currency)
                if cents is not None:
                    out.append((lid, at, "price", float(cents), nearest(cents), True, "price", seller))
                elif (bare_price := unstated_price(price, currency)) is not None:
                    out.append((lid, at, "price", bare_price, None, False, "price", seller))
                done = set()
                for key, value in sorted(zip(keys or (), values or ())):
                    entry = seen.get((key, value))
                    if entry is None:
                        entry = [(q, float(a), nearest(a), True) for q, a, _ in stated(key, value)]
                        bare = None if entry else unstated(key, value)
                        if bare:
                            entry = [(bare[0], bare[1], None, False)]
                        if len(seen) < 100_000:  # a memo of repeated entries, not of results
                            seen[key, value] = entry
                    for quantity, amount, whole, is_stated in entry:
                        if (quantity, is_stated) not in done:
                            done.add((quantity, is_stated))
                            out.append((lid, at, quantity, amount, whole, is_stated, key, seller))
            columns = list(zip(*out)) if out else [[] for _ in schema]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

    plain = unambiguous(products)
    rows = plain.select(
        F.col("listing_id").cast("long"), F.col("seen_at").cast("timestamp_ntz"), "price", "currency",
        F.map_keys("specifications").alias("k"), F.map_values("specifications").alias("v"),
        (F.col("seller_id") if "seller_id" in (c.lower() for c in plain.columns) else F.lit(None)).cast("string").alias("seller"),
    )
    return spread(rows).mapInArrow(read, "listing_id bigint, seen_at timestamp_ntz, quantity string, amount double, rounded bigint, is_stated boolean, source string, seller string")


def stated_amounts(products: DataFrame, rates: DataFrame) -> DataFrame:
    """One rounded amount per listing and quantity (listing_id, quantity, amount): that of the latest sighting which states it."""
    rows = extract(products, rates).filter("is_stated and listing_id is not null")
    latest = F.max(F.struct(F.col("seen_at"), F.col("rounded")))
    return rows.groupBy("listing_id", "quantity").agg(latest.alias("m")).select("listing_id", "quantity", F.col("m.rounded").alias("amount"))


# Fixed value: in the weights of a seller the weights of all count as much as this many amounts of its own.
SELLER_PRIOR = 10.0
# Fixed value: the rounds end when no centre, spread or weight moves by more than this.
TOLERANCE = 1e-6
_CELLS = 1 << 20  # posteriors held at once


@dataclass(frozen=True)
class Shape:
    """The fitted amounts of one quantity on the log scale; anchored: there are stated amounts, which fix the centre."""

    units: tuple[str, ...]
    factors: tuple[float, ...]
    centre: float
    spread: float
    weights: tuple[float, ...]
    anchored: bool


@dataclass(frozen=True)
class UnitMixture:
    """Shapes by quantity, and the weights of each seller (quantity, seller, weights in the order of the units)."""

    shapes: dict[str, Shape]
    habits: DataFrame


def every_unit() -> dict[str, tuple[str, ...]]:
    """The units of each quantity, one word for each conversion factor."""
    words: dict[str, dict[Fraction, str]] = {q: {} for q in UNITS}
    for quantity, units in UNITS.items():
        for word, factor in units.items():
            words[quantity].setdefault(factor, word)
    return {q: tuple(by_factor.values()) for q, by_factor in words.items()}


def fit_unit_mixture(amounts: DataFrame, units: dict[str, tuple[str, ...]] | None = None, rates: DataFrame | None = None) -> UnitMixture:
    """Fits the mixtures of the amounts without unit.

    Centre and spread start from the stated amounts of the quantity and keep them in every round; one
    pseudo-amount of spread 1 keeps the spread from 0. The weights are fitted on all amounts first;
    then each seller has its own, drawn to those of all, and centre and spread are fitted again with
    them. Amounts without seller have the weights of all. Without stated amounts nothing tells
    the units of a quantity from one another but their weights: the centre starts from the numbers as
    if in the common unit, and the shape is not anchored. rates adds the prices without currency. The
    driver receives sums per task, never amounts.
    """
    factors = {q: {u: float(_BY_UNIT[u][1]) for u in names} for q, names in (units or every_unit()).items()}
    if rates is not None:
        # The prices' common unit is the US cent.
        factors["price"] = {code: rate * 100 for code, rate, _ in sorted(_rate_rows(rates), key=lambda r: r[0]) if rate > 0}
    factors = {q: f for q, f in factors.items() if f}
    bare = ~F.col("is_stated")
    # Stated amounts come down to one row a quantity, others to one per seller and number. Those of no seller need no common row.
    counted = (
        amounts.filter("amount > 0").filter(F.col("quantity").isin(list(factors))).withColumn("log", F.log("amount"))
        .groupBy("quantity", "is_stated", F.when(bare, F.col("seller")).alias("seller"), F.when(bare, F.col("log")).alias("x"))
        .agg(F.count("*").cast("double").alias("n"), F.sum("log").alias("s"), F.sum(F.col("log") * F.col("log")).alias("ss"))
        .groupBy("quantity", "is_stated", "seller", F.when(F.col("seller").isNull(), F.pmod(F.hash("x"), F.lit(64))).alias("part"))
        .agg(F.sort_array(F.collect_list(F.struct("x", "n"))).alias("v"), F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("ss").alias("ss"))
    )
    counted = counted.select("quantity", "is_stated", "seller", F.col("v.x").alias("xs"), F.col("v.n").alias("ns"), "n", "s", "ss")
    # A small table of long work: dealt out over the cores once, not in every round.
    counted = durable(counted.repartition(amounts.sparkSession.sparkContext.defaultParallelism * 2))
    totals = {(r.quantity, r.is_stated): (r.n, r.s, r.ss) for r in counted.groupBy("quantity", "is_stated").agg(*(F.sum(c).alias(c) for c in ("n", "s", "ss"))).collect()}
    free = counted.filter(bare).select("quantity", "seller", "xs", "ns")
    shapes, known = {}, {}
    for quantity, by_unit in factors.items():
        known[quantity] = totals.get((quantity, True), (0.0, 0.0, 0.0))
        n, s, ss = known[quantity] if known[quantity][0] else totals.get((quantity, False), (0.0, 0.0, 0.0))
        if n:
            shapes[quantity] = Shape(
                tuple(by_unit), tuple(by_unit.values()), s / n, math.sqrt((max(0.0, ss - s * s / n) + 1) / (n + 1)),
                (1 / len(by_unit),) * len(by_unit), known[quantity][0] > 0,
            )
    waiting = {q for q, is_stated in totals if not is_stated}
    shapes = _rounds(free, shapes, known, waiting, False)
    shapes = _rounds(free, shapes, known, waiting, True)
    return UnitMixture(shapes, durable(_habits(free, shapes)))


def _rounds(free: DataFrame, shapes: dict[str, Shape], known: dict[str, tuple], waiting: set[str], by_seller: bool) -> dict[str, Shape]:
    """Expectation-maximisation until nothing moves; by_seller: with each seller's weights, those of all stay."""
    shapes = dict(shapes)
    climbs = {q: _climb(_vector(shapes[q], by_seller), 0 if by_seller else len(shapes[q].units), TOLERANCE) for q in sorted(waiting)}
    for quantity, climb in climbs.items():
        shapes[quantity] = _with_vector(shapes[quantity], next(climb))
    while climbs:
        sums: dict[str, list] = {}
        for r in _expected(free.filter(F.col("quantity").isin(list(climbs))), shapes, by_seller).collect():
            sums.setdefault(r.quantity, []).append((r.counts, r.first, r.second, r.fit))
        for quantity, climb in list(climbs.items()):
            old, (kn, ks, kss) = shapes[quantity], known[quantity]
            counts = [math.fsum(c) for c in zip(*(c for c, _, _, _ in sums[quantity]))]
            m = math.fsum(counts)
            # Moments about the old centre; the stated amounts keep their say.
            known_second = kss - 2 * old.centre * ks + kn * old.centre**2
            first = math.fsum(f for _, f, _, _ in sums[quantity]) + ks - kn * old.centre
            second = math.fsum(s for _, _, s, _ in sums[quantity]) + known_second
            moved = first / (m + kn)
            spread_ = math.sqrt((max(0.0, second - (m + kn) * moved**2) + 1) / (m + kn + 1))
            fit = math.fsum(f for _, _, _, f in sums[quantity]) - (kn + 1) * math.log(old.spread) - (known_second + 1) / (2 * old.spread**2)
            after = replace(old, centre=old.centre + moved, spread=spread_)
            if not by_seller:
                fit += math.fsum(math.log(w) for w in old.weights)
                after = replace(after, weights=tuple((c + 1) / (m + len(counts)) for c in counts))
            try:
                shapes[quantity] = _with_vector(old, climb.send((fit, _vector(after, by_seller))))
            except StopIteration as end:
                shapes[quantity] = _with_vector(old, end.value)
                del climbs[quantity]
    return shapes


def _vector(shape: Shape, by_seller: bool) -> np.ndarray:
    return np.array([shape.centre, math.log(shape.spread), *(() if by_seller else np.log(shape.weights))])


def _with_vector(shape: Shape, vector: np.ndarray) -> Shape:
    weights = tuple(np.exp(vector[2:]).tolist()) or shape.weights
    return replace(shape, centre=float(vector[0]), spread=math.exp(vector[1]), weights=weights)


def _climb(now: np.ndarray, weights: int, tolerance: float) -> Generator[np.ndarray, tuple[float, np.ndarray], np.ndarray]:
    """Rounds of expectation-maximisation of which every third starts from an extrapolation (SQUAREM), kept only if the fit is no worse.

    Yields points, is sent their fit and the point one round on, returns the end. The last entries
    of a point, as many as weights, are logarithms of weights.
    """
    cut = len(now) - weights

    def near(a: np.ndarray, b: np.ndarray) -> bool:
        return np.abs(np.r_[a[:cut] - b[:cut], np.exp(a[cut:]) - np.exp(b[cut:])]).max() < tolerance

    while True:
        _, one = yield now
        if near(now, one):
            return one
        fit, two = yield one
        if near(one, two):
            return two
        step = one - now
        bend = two - one - step
        length = min(64.0, max(1.0, float(np.linalg.norm(step) / max(np.linalg.norm(bend), 1e-300))))
        ahead = now + 2 * length * step + length**2 * bend
        if weights:
            share = np.maximum(np.exp(ahead[cut:] - ahead[cut:].max()), 1e-300)
            ahead[cut:] = np.log(share / share.sum())
        ahead_fit, after = yield ahead
        if ahead_fit >= fit:
            if near(ahead, after):
                return after
            now = after
        else:
            now = two


def _expect(x: np.ndarray, n: np.ndarray, shape: Shape, weights: np.ndarray) -> tuple[np.ndarray, float, float, float]:
    """Expected number of amounts in each unit, sums of their distances from the centre and of the squares, log-likelihood."""
    shift = np.log(shape.factors) - shape.centre
    counts, first, second, fit = np.zeros(len(shift)), 0.0, 0.0, -float(n.sum()) * math.log(shape.spread)
    step = max(1, _CELLS // len(shift))
    for i in range(0, len(x), step):
        off, times = x[i : i + step, None] + shift, n[i : i + step]
        logs = np.log(weights) - (off / shape.spread) ** 2 / 2
        top = logs.max(axis=1)
        post = np.exp(logs - top[:, None])
        total = post.sum(axis=1)
        fit += float((times * (np.log(total) + top)).sum())
        post *= (times / total)[:, None]
        counts += post.sum(axis=0)
        first += float((post * off).sum())
        second += float((post * off * off).sum())
    return counts, first, second, fit


def _own_weights(x: np.ndarray, n: np.ndarray, shape: Shape) -> np.ndarray:
    """The weights of one seller under a given shape: one optimum, as the problem is concave."""
    prior = SELLER_PRIOR * np.array(shape.weights)
    shift = np.log(shape.factors) - shape.centre
    step = max(1, _CELLS // len(shift))

    def likelihoods(i: int) -> np.ndarray:
        logs = -(((x[i : i + step, None] + shift) / shape.spread) ** 2) / 2
        return np.exp(logs - logs.max(axis=1, keepdims=True))

    held = likelihoods(0) if len(x) <= step else None  # larger ones are computed again in every round
    climb = _climb(np.log(shape.weights), len(prior), TOLERANCE / 100)
    point = next(climb)
    while True:
        weights, counts, fit = np.exp(point), np.zeros(len(prior)), float(prior @ point)
        for i in range(0, len(x), step):
            each, times = likelihoods(i) if held is None else held, n[i : i + step]
            total = np.maximum(each @ weights, 1e-300)
            counts += weights * ((times / total) @ each)
            fit += float(times @ np.log(total))
        try:
            point = climb.send((fit, np.log((counts + prior) / (counts.sum() + SELLER_PRIOR))))
        except StopIteration as end:
            return np.exp(end.value)


def _groups(batch: pa.RecordBatch, shapes: dict[str, Shape]) -> Iterator[tuple]:
    """(quantity, seller, logarithms, counts, shape) of the rows of a batch."""
    for i in range(batch.num_rows):
        quantity, seller, xs, ns = (c[i] for c in batch.columns)
        yield quantity.as_py(), seller.as_py(), xs.values.to_numpy(), ns.values.to_numpy(), shapes[quantity.as_py()]


def _expected(free: DataFrame, shapes: dict[str, Shape], by_seller: bool) -> DataFrame:
    """Sums of the expectations per task and quantity."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, list] = {}
        for batch in batches:
            for quantity, seller, x, n, shape in _groups(batch, shapes):
                common = np.array(shape.weights)
                weights = _own_weights(x, n, shape) if by_seller and seller is not None else common
                *moments, fit = _expect(x, n, shape, weights)
                if by_seller and seller is not None:
                    fit += SELLER_PRIOR * float(common @ np.log(weights))
                found = (*moments, fit)
                sums[quantity] = [a + b for a, b in zip(sums[quantity], found)] if quantity in sums else list(found)
        schema = pa.schema([("quantity", pa.string()), ("counts", pa.list_(pa.float64())), ("first", pa.float64()), ("second", pa.float64()), ("fit", pa.float64())])
        rows = [(q, counts.tolist(), *rest) for q, (counts, *rest) in sums.items()]
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows) if rows else [[]] * 5, schema)], schema=schema)

    return free.mapInArrow(add, "quantity string, counts array<double>, first double, second double, fit double")


def _habits(free: DataFrame, shapes: dict[str, Shape]) -> DataFrame:
    """Weights of each seller: quantity, seller, own."""

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("quantity", pa.string()), ("seller", pa.string()), ("own", pa.list_(pa.float64()))])
        for batch in batches:
            rows = [(q, seller, _own_weights(x, n, shape).tolist()) for q, seller, x, n, shape in _groups(batch, shapes)]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows) if rows else [[]] * 3, schema)], schema=schema)

    return free.filter("seller is not null").mapInArrow(weigh, "quantity string, seller string, own array<double>")


def infer_units(amounts: DataFrame, model: UnitMixture, sure: float = 0.9) -> DataFrame:
    """Gives the amounts without unit the unit of the highest posterior (native expressions, no Python).

    Result: listing_id, seen_at, quantity, source, number, unit, amount, posterior, is_uncertain. All
    amounts of a quantity of which none is stated are uncertain.
    """
    rows = amounts.filter("not is_stated and amount > 0").withColumnRenamed("amount", "number")
    unit = pa.struct([("unit", pa.string()), ("factor", pa.float64()), ("weight", pa.float64())])
    schema = pa.schema([("quantity", pa.string()), ("mu", pa.float64()), ("sigma", pa.float64()), ("anchored", pa.bool_()), ("choices", pa.list_(unit))])
    table = amounts.sparkSession.createDataFrame(pa.Table.from_pylist([
        {"quantity": q, "mu": s.centre, "sigma": s.spread, "anchored": s.anchored, "choices": [dict(zip(("unit", "factor", "weight"), c)) for c in zip(s.units, s.factors, s.weights)]}
        for q, s in sorted(model.shapes.items())
    ], schema=schema))
    own = F.coalesce(F.col("own"), F.col("choices.weight"))
    scored = rows.join(broadcast_if_small(table), "quantity").join(broadcast_if_small(model.habits), ["quantity", "seller"], "left").withColumn(
        "scores",
        F.zip_with("choices", own, lambda c, w: F.struct(
            (F.log(w) - F.pow((F.log(F.col("number")) + F.log(c["factor"]) - F.col("mu")) / F.col("sigma"), 2) / 2).alias("score"), c["unit"].alias("unit"), c["factor"].alias("factor"))),
    )
    best = F.array_max("scores")
    total = F.aggregate("scores", F.lit(0.0), lambda a, s: a + F.exp(s["score"] - F.col("best.score")))
    return scored.withColumn("best", best).withColumn("posterior", 1 / total).select(
        "listing_id", "seen_at", "quantity", "source", "number", F.col("best.unit").alias("unit"),
        (F.col("number") * F.col("best.factor")).alias("amount"), "posterior", ((F.col("posterior") < sure) | ~F.col("anchored")).alias("is_uncertain"),
    )
