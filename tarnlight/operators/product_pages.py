"""Product fields of marketplace pages by tables of selectors: JSON-LD, Open Graph and page elements."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

from tarnlight.functions.dom import Element, parse

# Per marketplace where a field stands: (attribute, value, tag or None, attribute read or None).
SELECTORS: dict[str, dict[str, list[tuple[str, str, str | None, str | None]]]] = {
    "amazon": {
        "title": [("id", "productTitle", None, None)], "price": [("class", "a-price-whole", None, None)], "brand": [("id", "bylineInfo", None, None)],
        "rating": [("id", "acrPopover", None, "title")], "review_count": [("id", "acrCustomerReviewText", None, None)], "description": [("id", "productDescription", None, None)],
        "availability": [("id", "availability", None, None)], "bullets": [("id", "feature-bullets", None, None)], "specs": [("id", "productDetails_techSpec_section_1", None, None)], "images": [("id", "altImages", None, None)],
    },
    "shopee": {
        "title": [("class", "product-title", None, None)], "price": [("class", "product-price", None, None)], "brand": [("class", "product-brand", None, None)],
        "rating": [("class", "product-rating", None, None)], "review_count": [("class", "product-review-count", None, None)], "description": [("class", "product-description", None, None)], "specs": [("class", "product-detail", None, None)],
    },
    "lazada": {
        "title": [("class", "pdp-mod-product-badge-title", None, None)], "price": [("class", "pdp-price", None, None)], "brand": [("class", "pdp-product-brand__brand-link", None, None)],
        "rating": [("class", "score-average", None, None)], "review_count": [("class", "pdp-review-summary__link", None, None)], "description": [("class", "pdp-product-desc", None, None)], "specs": [("class", "pdp-mod-specification", None, None)],
    },
    "tokopedia": {
        "title": [("data-testid", "lblPDPDetailProductName", None, None)], "price": [("data-testid", "lblPDPDetailProductPrice", None, None)], "brand": [("data-testid", "llbPDPFooterShopName", None, None)],
        "rating": [("data-testid", "lblPDPDetailProductRatingNumber", None, None)], "review_count": [("data-testid", "lblPDPDetailProductRatingCounter", None, None)], "description": [("data-testid", "lblPDPDescriptionProduk", None, None)],
    },
    "generic": {},
}
# Open Graph and meta properties by field.
META = {"title": ("og:title",), "description": ("og:description", "description"), "price": ("product:price:amount", "og:price:amount"), "currency": ("product:price:currency", "og:price:currency"), "brand": ("product:brand", "og:brand"), "availability": ("product:availability", "og:availability")}
_CURRENCY_SIGNS = {"$": "USD", "€": "EUR", "£": "GBP", "¥": "JPY", "Rp": "IDR", "₹": "INR", "S$": "SGD", "RM": "MYR", "฿": "THB", "₫": "VND", "₱": "PHP"}
SCHEMA = (
    "url string, marketplace string, title string, description string, price string, currency string, availability string, brand string, rating double, review_count bigint, "
    "bullet_points array<string>, specifications map<string,string>, image_urls array<string>, alt_texts array<string>, schema_org string"
)


def json_ld(root: Element) -> dict:
    """The first object of type Product (graphs and arrays included), else the first object."""
    first: dict = {}
    for script in root.find_all(lambda e: e.tag == "script" and e.attrs.get("type", "").lower() == "application/ld+json"):
        try:
            data = json.loads(script.text())
        except (ValueError, RecursionError):
            continue
        queue = data if isinstance(data, list) else [data]
        for obj in list(queue):
            if isinstance(obj, dict) and isinstance(obj.get("@graph"), list):
                queue.extend(obj["@graph"])
        for obj in queue:
            if isinstance(obj, dict):
                kind = obj.get("@type")
                if kind == "Product" or (isinstance(kind, list) and "Product" in kind):
                    return obj
                first = first or obj
    return first


def _pick(root: Element, rules: list) -> Element | None:
    for attr, value, tag, _ in rules:
        e = root.find(lambda e, a=attr, v=value, t=tag: (t is None or e.tag == t) and (v in e.classes() if a == "class" else e.attrs.get(a) == v))
        if e is not None:
            return e
    return None


def _first_number(text: str | None) -> str | None:
    m = re.search(r"\d[\d.,]*", text or "")
    return m[0].rstrip(".,") if m else None


def _float(text) -> float | None:
    number = _first_number(str(text)) if text is not None else None
    try:
        return float(number.replace(",", ".")) if number else None
    except ValueError:
        return None


def _int(text) -> int | None:
    number = _first_number(str(text)) if text is not None else None
    return int(re.sub(r"\D", "", number)) if number else None


def fields(html: str | None, marketplace: str) -> dict:
    """All fields of a page; structured data counts before page elements, those before meta tags, except that marketplaces with elements of their own come first."""
    root = parse(html)
    data = json_ld(root)
    rules = SELECTORS.get(marketplace, {})
    meta: dict[str, str] = {}
    for e in root.find_all(lambda e: e.tag == "meta"):
        name = e.attrs.get("property") or e.attrs.get("name")
        if name and e.attrs.get("content"):
            meta.setdefault(name, e.attrs["content"])

    def own(field: str) -> str | None:
        e = _pick(root, rules.get(field, []))
        if e is None:
            return None
        read = rules[field][0][3]
        return e.attrs.get(read) if read else e.stripped()

    offers = data.get("offers")
    offer = offers[0] if isinstance(offers, list) and offers else offers if isinstance(offers, dict) else {}
    offer = offer if isinstance(offer, dict) else {}
    rating = data.get("aggregateRating") if isinstance(data.get("aggregateRating"), dict) else {}
    brand = data.get("brand")
    brand = brand.get("name") if isinstance(brand, dict) else brand
    structured = {
        "title": data.get("name"), "description": data.get("description"), "price": offer.get("price"), "currency": offer.get("priceCurrency"), "availability": offer.get("availability"),
        "brand": brand, "rating": rating.get("ratingValue"), "review_count": rating.get("reviewCount"),
    }

    def best(field: str) -> str | None:
        tags = next((meta[n] for n in META.get(field, ()) if n in meta), None)
        for value in (own(field), structured.get(field), tags):
            if value not in (None, ""):
                return str(value)
        return None

    price = best("price")
    sign = next((c for s, c in sorted(_CURRENCY_SIGNS.items(), key=lambda x: -len(x[0])) if price and s in price), None)
    bullets = _pick(root, rules.get("bullets", []))
    specs_at = _pick(root, rules.get("specs", []))
    specs: dict[str, str] = {}
    for row in specs_at.find_all(lambda e: e.tag == "tr") if specs_at else ():
        cells = [c for c in row.children if isinstance(c, Element) and c.tag in ("th", "td")]
        if len(cells) >= 2 and cells[0].stripped():
            specs[cells[0].stripped()] = cells[1].stripped() or ""
    images_at = _pick(root, rules.get("images", [])) or root
    images = [e for e in images_at.find_all(lambda e: e.tag == "img") if e.attrs.get("src")]
    return {
        "title": best("title"), "description": best("description"), "price": price, "currency": structured["currency"] or sign or next((meta[n] for n in META["currency"] if n in meta), None),
        "availability": best("availability"), "brand": best("brand"), "rating": _float(own("rating") or structured["rating"]), "review_count": _int(own("review_count") or structured["review_count"]),
        "bullet_points": [t for e in (bullets.find_all(lambda e: "a-list-item" in e.classes()) if bullets else ()) if (t := e.stripped())], "specifications": specs,
        "image_urls": [e.attrs["src"] for e in images], "alt_texts": [e.attrs["alt"] for e in images if e.attrs.get("alt")], "schema_org": json.dumps(data) if data else None,
    }


def parse_pages(pages: DataFrame, url: str, html: str, marketplace: str) -> DataFrame:
    """Product rows (SCHEMA) of marketplace pages; unknown marketplaces use structured data and meta tags."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [{"url": u, "marketplace": m} | fields(h, m) for u, h, m in zip(b.iloc[:, 0], b.iloc[:, 1], b.iloc[:, 2])]
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in SCHEMA.split(", ")])

    return pages.select(url, html, marketplace).mapInPandas(run, SCHEMA)
