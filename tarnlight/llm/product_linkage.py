"""Groups of listings that offer the same product.

Titles, descriptions and specifications are parsed into attributes: model code, series, brand,
colour and amounts in common units. Equal attribute profiles are one node. Nodes are compared within
blocks (code; series), always with the representative of a class and never with each other in pairs;
the agreement of every field has a weight log(m/u), fitted by expectation-maximisation on the counts
of the agreement patterns of all compared pairs. Links above a threshold, unambiguous by a margin,
make the clusters. A code is one more field: listings with one code may differ in too much to be one
product, and listings of one product may have a mistyped or misread code.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tarnlight.llm.canonical_values import Resolver, fold, variants
from tarnlight.operators import quantities
from tarnlight.runtime import durable, spread, unambiguous

QUANTITIES = ("mass", "volume", "length", "power")
FIELDS = ("brand", "colour", *QUANTITIES)
#: Further fields between listings with codes; near: whether different codes are one edit or swap apart.
CODED = ("code", "near", "series")
#: Agreement among matches and others before anything is learnt.
START = {"code": (0.95, 0.01), "near": (0.9, 0.05)}
#: Amounts agree within the sum of their roundings and this share of the larger.
TOLERANCE = 0.005
#: Names and aliases of the brand list, which is sent to the tasks.
MAX_NAMES = 500_000
#: Listings of a class that one task of pairs_of meets on either side.
MEMBERS = 2_000

# Colour words of the listings' languages.
COLOURS = {
    "black": ("jet black", "black", "schwarz", "hitam", "negro", "noir"),
    "white": ("pure white", "white", "weiss", "putih", "blanco", "blanc"),
    "pink": ("merah muda", "pink", "rosa", "rose"),
    "red": ("ruby red", "red", "rot", "merah", "rojo", "rouge"),
    "blue": ("navy blue", "navy", "blue", "blau", "biru", "azul", "bleu"),
    "green": ("forest green", "green", "grun", "hijau", "verde", "vert"),
    "grey": ("grey", "gray", "grau", "abu abu", "abu-abu", "gris"),
    "silver": ("silver", "silber", "perak", "plata", "argent"),
    "yellow": ("yellow", "gelb", "kuning", "amarillo", "jaune"),
    "brown": ("brown", "braun", "coklat", "marron"),
    "orange": ("orange", "oranye", "naranja"),
    "gold": ("gold", "emas", "dorado"),
    "purple": ("purple", "lila", "ungu", "violet", "morado"),
}
_COLOUR_OF = {w: c for c, ws in COLOURS.items() for w in ws}
_COLOUR = re.compile(r"(?<![^\W\d_])(" + "|".join(sorted(map(re.escape, _COLOUR_OF), key=len, reverse=True)) + r")(?![^\W\d_])")
_COLOUR_KEY = re.compile(r"colo|farbe|warna|couleur", re.I)
_CODE_KEY = re.compile(r"model|mpn|artikel|sku|part n|type n", re.I)
_CODE = re.compile(r"(?<![A-Za-z0-9])([A-Za-z]{1,4})[ /-]?(\d{3,6})[ /-]?([A-Za-z]{1,2})(?![A-Za-z0-9])")
_NAMED_CODE = re.compile(r"(?:model(?: no)?|ref|type no|art(?:\.|ikel)?(?:-?nr)?|mpn|sku)\s*[.:]?\s*", re.I)
_NOT_CODE = frozenset("at to of is ca in for and the from only now approx draws runs with by or up on as".split())
_AFTER_NUMBER = rf"(?![\d/]|[.,]\d|-\w)(?!\s*(?:%|x\s*\d|pcs?\b|pieces?|years?|months?|days\b|tage?\b|jahre?\b|hari\b|v\b|\d+/\d|(?:{quantities._UNIT})(?![^\W\d]|[ /-]?\d{{4}})))"
_SERIES = re.compile(rf"(?<![\w-])([^\W\d_]{{4,14}}) (\d{{1,3}}){_AFTER_NUMBER}", re.I)
_NAMED_SERIES = re.compile(r"(?:([^\W\d_]{4,14}) (\d{1,3}) (?:series|line|range|serie|linie|seri)\b)", re.I)
_NOT_SERIES = frozenset("ships rated pack size part model type version original offer deal idea quality warranty stock choice promo shipping with from about over under series number item finish days price".split())
_TAGS = re.compile(r"<[^<>]{1,80}>")


#: Entries repeat: a memo of parsed entries.
_stated = lru_cache(maxsize=100_000)(quantities.stated)


def _plain(text: str) -> str:
    return " ".join(fold(text)) if not text.isascii() else text.lower()


def colour_of(text: str) -> str | None:
    m = _COLOUR.search(_plain(text))
    return _COLOUR_OF[m[1]] if m else None


def code_of(specs: dict, title: str, description: str) -> str | None:
    """The model code in one spelling: an identifying entry counts before a named code, that before any other in the title."""
    for key, value in specs.items():
        if value and _CODE_KEY.search(key):
            m = _CODE.search(value)
            if m:
                return "".join(m.groups()).upper()
    for text in (description, title):
        for named in _NAMED_CODE.finditer(text):
            m = _CODE.match(text, named.end())
            if m:
                return "".join(m.groups()).upper()
    for text in (title, description):
        for m in _CODE.finditer(text):
            if m[1].lower() not in _NOT_CODE and len(m[1]) >= 2 and (len(m[1]) == 2 or (" " not in m[0] and quantities.unit_of(m[3]) is None)):
                return "".join(m.groups()).upper()
    return None


def series_of(title: str, description: str, brand_words: set[str]) -> str | None:
    for text in (description, title):
        m = _NAMED_SERIES.search(text)
        if m and m[1].lower() not in _NOT_SERIES:
            return f"{_plain(m[1])} {int(m[2])}"
    for text in (title, description):
        for m in _SERIES.finditer(text):
            word = _plain(m[1])
            if word not in _NOT_SERIES and word not in brand_words and word not in _COLOUR_OF:
                return f"{word} {int(m[2])}"
    return None


class Brands:
    """Resolves brands against a reference list; without one, a brand is its folded text."""

    def __init__(self, entries: list[tuple[int, str]]):
        self.resolver = Resolver(entries) if entries else None
        self.words = {w for _, n in entries for w in fold(n)}
        self.memo: dict[str, str | None] = {}

    def of(self, brand: str | None, title: str, description: str) -> str | None:
        known = self.memo.get(brand) if brand else None
        if brand and brand not in self.memo:
            if self.resolver is None:
                forms = variants(brand)
                known = forms[-1] if forms else None
            else:
                best = self.resolver.best(brand)
                known = str(best[1]) if best else None
            if len(self.memo) < 200_000:  # a memo of repeated values, not of results
                self.memo[brand] = known
        if known or self.resolver is None:
            return known
        for text in (title, description):
            ws = fold(text)
            for n in (3, 2, 1):
                for i in range(len(ws) - n + 1):
                    found = self.resolver.ids.get("".join(ws[i : i + n]))
                    if found is not None:
                        return str(found)
        return None


def amounts_of(specs: dict, title: str, description: str) -> dict[str, tuple[float, float]]:
    """Amounts in common units with half of their last place; the finest statement counts, that of the specifications first."""
    out: dict[str, tuple[float, float]] = {}

    def take(quantity: str, amount, step) -> None:
        if amount > 0 and (quantity not in out or float(step) < out[quantity][1]):
            out[quantity] = float(amount), float(step)

    for key, value in specs.items():
        for found in _stated(key, value):
            take(*found)
    for text in (title, description):
        if any(c.isdigit() for c in text):
            rest = _SERIES.sub(" ", _CODE.sub(lambda m: " " if m[1].lower() not in _NOT_CODE and len(m[1]) == 2 else m[0], text))
            for m in quantities._AMOUNT.finditer(rest):
                found = quantities.amount_of(m, None)
                if found:
                    take(*found)
    return out


def attributes(products: DataFrame, brands: DataFrame | None = None) -> DataFrame:
    """One row per listing, of its latest sighting: listing_id, code, series, brand, colour, mass, volume, length, power
    and half of the last place of each amount (mass_step, ...).

    brands (brand_id, canonical_brand, aliases) is a reference list of at most MAX_NAMES names, else an
    error; without it the folded brand stands for itself. NULL fields and texts without an attribute
    give NULL attributes.
    """
    entries: list[tuple[int, str]] = []
    if brands is not None:
        names = brands.select(
            F.col("brand_id").cast("long").alias("id"),
            F.explode(F.array_compact(F.concat(F.array("canonical_brand"), F.coalesce("aliases", F.array().cast("array<string>"))))).alias("name"),
        ).dropna()
        rows = names.limit(MAX_NAMES + 1).collect()
        if len(rows) > MAX_NAMES:
            raise ValueError("more brand names than MAX_NAMES")
        entries = [(r.id, r.name) for r in rows]
    shared = products.sparkSession.sparkContext.broadcast(entries)
    fields = [("listing_id", pa.int64()), ("seen_at", pa.timestamp("us")), ("code", pa.string()), ("series", pa.string()), ("brand", pa.string()), ("colour", pa.string()), *((c, pa.float64()) for q in QUANTITIES for c in (q, f"{q}_step"))]

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Brands(shared.value)
        for batch in batches:
            out = []
            for lid, at, title, description, brand, keys, values in zip(*(c.to_pylist() for c in batch.columns)):
                specs = dict(zip(keys or (), values or ()))
                title, description = title or "", _TAGS.sub(" ", description or "")
                colour = next((c for k, v in specs.items() if v and _COLOUR_KEY.search(k) and (c := colour_of(v))), None)
                amounts = amounts_of(specs, title, description)
                who = known.of(brand, title, description)
                out.append((lid, at, code_of(specs, title, description), series_of(title, description, known.words), who, colour or colour_of(title) or colour_of(description), *(x for q in QUANTITIES for x in amounts.get(q, (None, None)))))
            columns = list(zip(*out)) if out else [[] for _ in fields]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(columns, fields)], names=[n for n, _ in fields])

    raw = unambiguous(products).filter(F.col("listing_id").isNotNull()).select(
        F.col("listing_id").cast("long"), F.col("seen_at").cast("timestamp_ntz"), "title", "description", "brand",
        F.map_keys("specifications").alias("k"), F.map_values("specifications").alias("v"),
    )
    parsed = spread(raw).mapInArrow(parse, "listing_id bigint, seen_at timestamp_ntz, code string, series string, brand string, colour string, " + ", ".join(f"{q} double, {q}_step double" for q in QUANTITIES))
    names = [n for n, _ in fields[2:]]
    latest = parsed.groupBy("listing_id").agg(F.max(F.struct("seen_at", *names)).alias("m"))
    return latest.select("listing_id", *[F.col(f"m.{n}").alias(n) for n in names])


def _level(field: str, a: str, b: str) -> str:
    """SQL of a level: 1 agree, 0 differ, NULL where a side is missing."""
    x, y = f"{a}.{field}", f"{b}.{field}"
    same = f"abs({x} - {y}) <= {a}.{field}_step + {b}.{field}_step + {TOLERANCE!r}D * greatest({x}, {y})" if field in QUANTITIES else f"{x} = {y}"
    return f"case when {same} then 1 when {x} is not null and {y} is not null then 0 end"


def patterns(pairs: DataFrame, a: str = "n", b: str = "k") -> DataFrame:
    return pairs.withColumns({f"is_{f}": F.expr(_level(f, a, b)) for f in FIELDS})


def coded_patterns(pairs: DataFrame, a: str = "n", b: str = "k") -> DataFrame:
    x, y = f"{a}.code", f"{b}.code"
    swapped = f"(levenshtein({x}, {y}, 2) = 2 and sort_array(split({x}, '')) = sort_array(split({y}, '')))"
    near = f"case when {x} <> {y} then cast(levenshtein({x}, {y}, 1) = 1 or {swapped} as int) end"
    levels = {f: _level(f, a, b) for f in (*FIELDS, "code", "series")} | {"near": near}
    return pairs.withColumns({f"is_{f}": F.expr(x) for f, x in levels.items()})


def fit_weights(pairs: DataFrame, rounds: int = 100, fields: tuple = FIELDS, given: dict | None = None) -> dict:
    """Fellegi-Sunter weights by expectation-maximisation: {"prior": p, field: (m, u)}.

    given: weights of further fields, which stay as they are.

    pairs carry is_<field> levels, times (how many pairs a row stands for) and known: true or false where equal or different codes tell, else
    NULL. Known pairs keep their side; the others get posteriors in each round. The driver gets the
    counts of the patterns, at most 3 to the power of the number of fields, times 3. Missing levels
    say nothing. Without pairs the starting values stay.
    """
    held = {f: w for f, w in (given or {}).items() if f != "prior"}
    rows = pairs.groupBy("known", *[f"is_{f}" for f in (*held, *fields)]).agg(F.sum("times").alias("count")).collect()
    m = {f: START.get(f, (0.95, 0.2))[0] for f in fields}
    u = {f: START.get(f, (0.95, 0.2))[1] for f in fields}
    prior = 0.5
    for _ in range(rounds if rows else 0):
        on = {f: [1.0, 0.1] for f in fields}  # agreements, differences among matches (with a little prior)
        off = {f: [START.get(f, (0.95, 0.2))[1], 1 - START.get(f, (0.95, 0.2))[1]] for f in fields}
        matched = total = 0.0
        for r in rows:
            odds = math.log(prior / (1 - prior)) + sum(_weight(m[f], u[f], r[f"is_{f}"]) for f in fields) + sum(_weight(*w, r[f"is_{f}"]) for f, w in held.items())
            p = 1 / (1 + math.exp(-max(-50, min(50, odds)))) if r.known is None else float(r.known)
            n = r["count"]
            if r.known is None:
                matched += p * n
                total += n
            for f in fields:
                level = r[f"is_{f}"]
                if level is not None:
                    on[f][1 - level] += p * n
                    off[f][1 - level] += (1 - p) * n
        new = min(0.99, max(0.01, (matched + 1) / (total + 2)))
        m = {f: min(0.999, max(0.6, on[f][0] / sum(on[f]))) for f in fields}
        u = {f: min(0.9, max(0.001, off[f][0] / sum(off[f]))) for f in fields}
        if abs(new - prior) < 1e-9:
            break
        prior = new
    return {"prior": prior} | held | {f: (m[f], u[f]) for f in fields}


def _weight(m: float, u: float, level: int | None) -> float:
    if level is None:
        return 0.0
    return math.log(m / u) if level else math.log((1 - m) / (1 - u))


def score(pairs: DataFrame, weights: dict) -> DataFrame:
    """pairs with w, the log odds of a match."""
    terms = [f"{math.log(weights['prior'] / (1 - weights['prior']))!r}D"]
    for f, (m, u) in ((f, x) for f, x in weights.items() if f != "prior"):
        terms.append(f"case is_{f} when 1 then {math.log(m / u)!r}D when 0 then {math.log((1 - m) / (1 - u))!r}D else 0.0D end")
    return pairs.withColumn("w", F.expr(" + ".join(terms)))


def _class_profile(rows: DataFrame, by: str, *shared: str) -> DataFrame:
    """Representative of each class: the most frequent brand, colour and series, and the finest amounts (bounded buffers).

    shared: columns that have one value in a class.
    """
    texts = [f"mode({c}) as {c}" for c in ("series", "brand", "colour")] + [f"min({c}) as {c}" for c in shared]
    amounts = [f"min_by({q}, case when {q} is not null then struct({q}_step, {q}) end) as {q}" for q in QUANTITIES] + [f"min({q}_step) as {q}_step" for q in QUANTITIES]
    return rows.groupBy(by).agg(*map(F.expr, ("count(*) as n", "min(listing_id) as first_id", *texts, *amounts)))


def cluster(listings: DataFrame, threshold: float = 0.5, margin: float = 1.0) -> DataFrame:
    """(listing_id, class_id) of every listing; class_id names a product.

    Listings with neither code nor series are classes of their own: nothing tells their product.
    """
    # 1. Weights. Pairs of equal and different codes are known; nodes without code against the listings of a code in
    #    their series add what is not. Nodes are listings of equal profile.
    keyed = durable(listings.withColumn("node", F.when(F.col("code").isNotNull(), _profile_key("code")).when(F.col("series").isNotNull(), _profile_key())))
    nodes = durable(_class_profile(keyed.filter("node is not null"), "node", "code"))
    coded, loose = nodes.filter("code is not null"), nodes.filter("code is null")
    heads = durable(_class_profile(keyed.filter("code is not null"), "code").withColumn("class_id", F.col("code")))
    told = _candidates(coded.filter("series is not null"), heads).withColumn("known", F.col("n.code") == F.col("k.class_id")).withColumn("times", F.col("n.n"))
    untold = _candidates(loose, heads).withColumn("known", F.lit(None).cast("boolean")).withColumn("times", F.lit(1).cast("long"))
    levels = ["known", "times", *[f"is_{f}" for f in FIELDS]]
    weights = fit_weights(told.select(*levels).unionByName(untold.select(*levels)))

    # 2. Nodes with code against the classes of their code and of their series and brand, then those without.
    coded_members = durable(_coded(keyed, coded, heads, weights, threshold, margin))
    classes = durable(_class_profile(keyed.join(coded_members, "node"), "class_id"))
    placed = durable(_best(score(_candidates(loose, classes), weights), threshold, margin))

    # 3. What no coded class takes: leaders per (series, brand, colour) until no node is left, then incomplete nodes
    #    against those, then the incomplete ones that fit no class against leaders of their own.
    size = sum(F.col(q).isNotNull().cast("int") for q in QUANTITIES)
    rest = durable(loose.join(placed, "node", "left_anti"))
    full = rest.filter("brand is not null and colour is not null").withColumn("block", F.concat_ws("\x1f", "series", "brand", "colour"))
    near = _leaders(full, [-size, -F.col("n"), F.col("node")], threshold, weights, "s:").filter(F.col("w") >= threshold)
    own = durable(near.groupBy(F.col("n.node").alias("node")).agg(F.max_by("k.class_id", F.struct("w", "k.n", "k.class_id")).alias("class_id")))
    partial = rest.filter("brand is null or colour is null")
    lesser = _class_profile(keyed.join(own, "node"), "class_id")
    scored = durable(score(_candidates(partial, classes.unionByName(lesser)), weights).select(F.struct(F.col("n.node").alias("node")).alias("n"), "k", "w"))
    late = _best(scored, threshold, margin)
    # Nodes that fit several classes stay alone: which product they are is open, so they say nothing of each other.
    fits = scored.filter(F.col("w") >= threshold).select(F.col("n.node").alias("node")).distinct()
    unfit = partial.join(fits, "node", "left_anti").withColumn("block", F.col("series"))
    told_size = size + F.col("brand").isNotNull().cast("int") + F.col("colour").isNotNull().cast("int")
    among = _leaders(unfit, [-told_size, -F.col("n"), F.col("node")], threshold, weights, "s:")
    follow = durable(_best(among.filter("coalesce(is_brand, 1) = 1"), threshold, margin))
    alone = partial.join(late.unionByName(follow), "node", "left_anti").select("node", F.concat(F.lit("s:"), F.col("node")).alias("class_id"))
    membership = coded_members.unionByName(placed).unionByName(own).unionByName(late).unionByName(follow).unionByName(alone)
    single = keyed.filter("node is null").select("listing_id", F.concat(F.lit("l:"), F.col("listing_id")).alias("class_id"))
    return keyed.join(membership, "node").select("listing_id", "class_id").unionByName(single)


def _profile_key(*first: str) -> Column:
    """One text for each equal profile."""
    texts = [f"coalesce({c}, '?')" for c in (*first, "series", "brand", "colour")]
    amounts = [f"coalesce(concat(cast(round({q}, 1) as string), '~', cast(round({q}_step, 1) as string)), '?')" for q in QUANTITIES]
    return F.expr(f"concat_ws('|', {', '.join(texts + amounts)})")


def _leaders(nodes: DataFrame, order: list, threshold: float, weights: dict, prefix: str) -> DataFrame:
    """(n.node, k.class_id, k.n, is_brand, w) of the nodes with the leaders of their blocks; a leader has itself with infinite w.

    Leaders stand for a class each: walking a block in the given (ascending) order, they are the nodes
    that no earlier leader takes. class_id is the leader's node behind the prefix.

    Every task first walks its own rows, so that only its leaders are shuffled to the task of their
    block, which holds the leaders found so far and streams the rest. A node that its task's leader
    took but no leader of the block does goes through another round, until none is left.
    """
    names = ["node", "block", *FIELDS, *[f"{q}_step" for q in QUANTITIES], *[c for c in ("code", "series") if c not in FIELDS]]
    ranked = nodes.withColumns({f"_o{i}": c for i, c in enumerate(order)})
    columns = [*names, *[c for c in ranked.columns if c.startswith("_o")]]
    schema = ranked.select(*columns).schema
    at = {c: i for i, c in enumerate(columns)}

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, leaders = None, []
        for batch in batches:
            keep = []
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if row[at["block"]] != block:
                    block, leaders = row[at["block"]], []
                taken = any(log_odds(weights, row, other, at) >= threshold for other in leaders)
                keep.append(not taken)
                if not taken:
                    leaders.append(row)
            yield batch.filter(pa.array(keep, pa.bool_()))

    found, rest = None, ranked
    while True:
        local = rest.select(*columns).sortWithinPartitions("block", *[c for c in columns if c.startswith("_o")]).mapInArrow(walk, schema)
        lead = durable(local.repartition("block").sortWithinPartitions("block", *[c for c in columns if c.startswith("_o")]).mapInArrow(walk, schema).select("node"))
        known = ranked.join(lead, "node", "left_semi")
        compared = score(coded_patterns(ranked.alias("n").join(known.alias("k"), F.col("n.block") == F.col("k.block"))), weights)
        w = F.when(F.col("n.node") == F.col("k.node"), F.lit(math.inf)).otherwise(F.col("w"))
        head = F.struct(F.concat(F.lit(prefix), F.col("k.node")).alias("class_id"), F.col("k.n").alias("n")).alias("k")
        links = durable(compared.select(F.struct(F.col("n.node").alias("node")).alias("n"), head, "is_brand", w.alias("w")))
        found = links if found is None else found.unionByName(links)
        rest = rest.join(links.filter(F.col("w") >= threshold).select("n.node"), "node", "left_anti")
        if rest.isEmpty():
            return found
        rest = durable(rest)


def log_odds(weights: dict, a: tuple, b: tuple, at: dict[str, int]) -> float:
    """The log odds that two nodes of a block are one product, as score gives them; at tells the places of the fields."""
    w = math.log(weights["prior"] / (1 - weights["prior"]))
    for f, (m, u) in ((f, x) for f, x in weights.items() if f != "prior"):
        if f == "near":  # codes are equal within a block
            continue
        x, y = a[at[f]], b[at[f]]
        if x is None or y is None:
            level = None
        elif f in QUANTITIES:
            level = int(abs(x - y) <= a[at[f"{f}_step"]] + b[at[f"{f}_step"]] + TOLERANCE * max(x, y))
        else:
            level = int(x == y)
        w += _weight(m, u, level)
    return w


def _coded(keyed: DataFrame, nodes: DataFrame, heads: DataFrame, weights: dict, threshold: float, margin: float) -> DataFrame:
    """(node, class_id) of the nodes with a code.

    Nodes of a code are linked with the leaders of the code. A class then joins a larger one of another code
    in its series, brand and colour where an amount agrees, nothing differs and the weights, that of the code
    among them, say so: its code is mistyped or misread.
    """
    pair = ["struct(n.node) as n", "struct(k.class_id) as k", *[f"is_{f}" for f in (*FIELDS, *CODED)]]
    same_code = F.col("n.code") == F.col("k.code")
    same_line = (F.col("n.series") == F.col("k.series")) & (F.col("n.brand") == F.col("k.brand"))
    fitted = [coded_patterns(nodes.alias("n").join(heads.alias("k"), on)).selectExpr(*pair) for on in (same_code, same_line & (F.col("n.code") != F.col("k.code")))]
    weights = fit_weights(fitted[0].unionByName(fitted[1]).withColumn("known", F.lit(None).cast("boolean")).withColumn("times", F.lit(1)), fields=CODED, given=weights)

    size = sum(F.col(q).isNotNull().cast("int") for q in ("series", "brand", "colour", *QUANTITIES))
    order = [F.col("series").isNull(), -F.col("n"), -size, F.col("node")]
    near = _leaders(nodes.withColumn("block", F.col("code")), order, threshold, weights, "c:")
    reached = _best(near, threshold, margin)
    members = durable(nodes.select("node").join(reached, "node", "left").withColumn("class_id", F.coalesce("class_id", F.concat(F.lit("c:"), F.col("node")))))

    classes = durable(_class_profile(keyed.join(members, "node"), "class_id", "code"))
    larger = (F.col("k.n") > F.col("n.n")) | ((F.col("k.n") == F.col("n.n")) & (F.col("k.class_id") < F.col("n.class_id")))
    across = coded_patterns(classes.withColumn("node", F.col("class_id")).alias("n").join(classes.alias("k"), same_line & (F.col("n.colour") == F.col("k.colour")) & (F.col("n.code") != F.col("k.code")) & larger)).selectExpr(*pair)
    sized = sum(F.coalesce(F.col(f"is_{q}"), F.lit(0)) for q in QUANTITIES) >= 1
    clean = sum(F.coalesce(1 - F.col(f"is_{f}"), F.lit(0)) for f in FIELDS) == 0
    links = durable(_best(score(across.filter(sized & clean), weights), threshold, margin).select(F.col("node").alias("class_id"), F.col("class_id").alias("to")))
    # Links go to larger classes only; those to a class that moves itself go where it goes.
    while True:
        further = links.select(F.col("class_id").alias("to"), F.col("to").alias("_next"))
        if links.join(further, "to", "left_semi").isEmpty():
            break
        links = durable(links.join(further, "to", "left").select("class_id", F.coalesce("_next", "to").alias("to")))
    return members.join(links, "class_id", "left").select("node", F.coalesce("to", "class_id").alias("class_id"))


def _candidates(nodes: DataFrame, classes: DataFrame) -> DataFrame:
    """Nodes (n) with the classes (k) of their series and brand; a side without brand meets the whole series.

    Makers reuse series names, so the series alone would grow into hot blocks.
    """
    levels = [f"is_{f}" for f in FIELDS]
    known_n, known_k = nodes.filter("brand is not null"), classes.filter("brand is not null")
    names = [f"n.{c}" for c in ("node", "code", "n") if c in nodes.columns]
    parts = [
        known_n.alias("n").join(known_k.alias("k"), F.expr("n.series = k.series and n.brand = k.brand")),
        known_n.alias("n").join(classes.filter("brand is null").alias("k"), F.expr("n.series = k.series")),
        nodes.filter("brand is null").alias("n").join(classes.alias("k"), F.expr("n.series = k.series")),
    ]
    kept = [patterns(p).selectExpr(f"struct({', '.join(names)}) as n", "struct(k.class_id) as k", *levels) for p in parts]
    return kept[0].unionByName(kept[1]).unionByName(kept[2])


def _best(scored: DataFrame, threshold: float, margin: float) -> DataFrame:
    """(node, class_id) where the best class is above the threshold and ahead of the second by the margin.

    Only the best two classes of a node are kept, before and after the shuffle.
    """
    ranked = scored.select(F.col("n.node").alias("node"), F.col("k.class_id").alias("class_id"), "w")
    two = ranked.withColumn("_r", F.row_number().over(W.partitionBy("node").orderBy(F.desc("w"), "class_id"))).filter("_r <= 2")
    top = two.groupBy("node").agg(F.max(F.when(F.col("_r") == 1, F.col("class_id"))).alias("class_id"), F.max("w").alias("w"), F.min(F.when(F.col("_r") == 2, F.col("w"))).alias("second"))
    ahead = F.coalesce(F.col("second") <= F.col("w") - margin, F.lit(True))
    return top.filter((F.col("w") >= threshold) & ahead).select("node", "class_id")


def same_products(products: DataFrame, brands: DataFrame | None = None) -> DataFrame:
    """(listing_id, class_id) of every listing, see cluster."""
    return cluster(durable(attributes(products, brands)))


def pairs_of(classes: DataFrame) -> DataFrame:
    """All pairs of different listings of a class, smaller id first.

    A class of more than MEMBERS listings is cut into parts by a hash of the id: every part meets a copy
    of the class in a task of its own.
    """
    parts = classes.groupBy("class_id").agg(F.ceil(F.count("*") / MEMBERS).cast("int").alias("_parts")).filter("_parts > 1")
    sized = classes.join(parts, "class_id", "left").withColumn("_parts", F.coalesce("_parts", F.lit(1)))
    a = sized.withColumn("_part", F.pmod(F.xxhash64("listing_id"), F.col("_parts")).cast("int")).alias("a")
    b = sized.withColumn("_part", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1))).alias("b")
    same = (F.col("a.class_id") == F.col("b.class_id")) & (F.col("a._part") == F.col("b._part"))
    return a.join(b, same).filter(F.col("a.listing_id") < F.col("b.listing_id")).select(F.col("a.listing_id").alias("listing_id_a"), F.col("b.listing_id").alias("listing_id_b"))
