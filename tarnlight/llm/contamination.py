"""Passages of evaluation items in a training corpus.

The n-grams of all items, normalised and without their middle word, form a hash set that is
broadcast; every document's windows are looked up in it, so that a changed word hides none. A hit is
verified by aligning the item with the document: matched runs are extended over single changed
words, chained in the order of the item, and the share of the item's words that the chain covers
decides. N-grams that several items have in common extend runs but never start one; which ones are
shared is counted over all items. A test set too large for one broadcast is cut into blocks, each
with a broadcast and a scan of its own, of which all give the rows that a single one would.
"""

from __future__ import annotations

import html as htmllib
import re
import unicodedata
from bisect import bisect_right
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnlight.runtime import spread, unambiguous

#: Words of an n-gram; the middle one may be any word.
N = 5
#: N-grams that one broadcast block of items holds, about; further items are scanned in further blocks.
MAX_NGRAMS = 2_000_000

_TAG = re.compile(r"<!--.*?-->|</?[a-zA-Z][^<>]{0,300}>", re.S)
_TARGET = re.compile(r"(?<=\])\([^()\s]*\)")
_WORD = re.compile(r"[^\W_]+")
_HIDDEN = re.compile("&(?:#\\d{1,7}|#[xX][0-9a-fA-F]{1,6}|[a-zA-Z][a-zA-Z0-9]{1,30});|[\u00ad\u200b-\u200f\u2060\ufeff]|(?<=[a-z])-\n(?=[a-z])")


def words(text: str | None) -> list[str]:
    """Words of a text without case, punctuation, markup, accents of compatibility forms and line breaks."""
    return [m[0] for m in spans(text)]


def _prepare(text: str) -> str:
    """The text with markup blanked, position by position, so that spans stay valid."""
    if "<" in text:
        text = _TAG.sub(lambda m: " " * len(m[0]), text)
    if "](" in text:
        text = _TARGET.sub(lambda m: " " * len(m[0]), text)
    return text


def _resolve(text: str) -> tuple[str, list[int], list[int]]:
    """The text with character references resolved and invisible characters and hyphens at line ends
    taken out; and breaks: from each position of the new text on, what to add for the old one."""
    out, at, places, shifts, size, shift = [], 0, [0], [0], 0, 0
    for m in _HIDDEN.finditer(text):
        new = htmllib.unescape(m[0]) if m[0][0] == "&" else ""
        if new == m[0]:
            continue
        out += [text[at : m.start()], new]
        size += m.start() - at + len(new)
        at = m.end()
        shift += len(m[0]) - len(new)
        places.append(size)
        shifts.append(shift)
    out.append(text[at:])
    return "".join(out), places, shifts


def spans(text: str | None) -> list[tuple[str, int, int]]:
    """(word, start, end) of the words of a text; start and end are positions in the text as given."""
    if not text:
        return []
    blanked = _prepare(text)
    places, shifts = None, None
    if _HIDDEN.search(blanked):
        blanked, places, shifts = _resolve(blanked)
    plain = blanked.isascii()
    out = []
    for m in _WORD.finditer(blanked):
        word = m[0].lower() if plain else unicodedata.normalize("NFKC", m[0]).casefold()
        start, end = m.span()
        if places:
            start += shifts[bisect_right(places, start) - 1]
            end = end - 1 + shifts[bisect_right(places, end - 1) - 1] + 1
        out.append((word, start, end))
    return out


def _gapped(ws: list[str], k: int) -> tuple[str, str, str, str]:
    """The n-gram at k without its middle word."""
    return ws[k], ws[k + 1], ws[k + 3], ws[k + 4]


def _gram_hash(gram: tuple) -> int:
    return xxhash.xxh64_intdigest("\x1f".join(gram)) - (1 << 63)


class Index:
    """Hash set of the items' n-grams with their places.

    shared: the n-grams that items outside this block have too; None where the block is all there is.
    """

    def __init__(self, items: list[tuple[int, str]], shared: frozenset[int] | None = None):
        self.items: dict[int, list[str]] = {i: words(t) for i, t in items}
        self.places: dict[tuple, list[tuple[int, int]]] = defaultdict(list)
        for item, ws in self.items.items():
            for k in range(len(ws) - N + 1):
                self.places[_gapped(ws, k)].append((item, k))
        self.places = dict(self.places)
        self.unique = {g for g, at in self.places.items() if len({i for i, _ in at}) == 1 and not (shared and _gram_hash(g) in shared)}
        self.vocabulary = {w for ws in self.items.values() for w in ws}

    def scan(self, ws: list[str]) -> dict[int, list[tuple[int, int]]]:
        """(item place, document place) of all hits by item, of items with at least one n-gram of their own."""
        hits: dict[int, list[tuple[int, int]]] = defaultdict(list)
        own: set[int] = set()
        known = [w in self.vocabulary for w in ws]
        for k in range(len(ws) - N + 1):
            if known[k] and known[k + 1] and known[k + 3] and known[k + 4]:
                gram = _gapped(ws, k)
                at = self.places.get(gram)
                if at:
                    for item, place in at:
                        hits[item].append((place, k))
                    if gram in self.unique:
                        own.add(at[0][0])
        return {i: h for i, h in hits.items() if i in own}


def runs(hits: list[tuple[int, int]], item: list[str], doc: list[str]) -> list[tuple[int, int, int]]:
    """Matched runs (item start, document start, length) on diagonals, extended over single changed words."""
    by_diagonal: dict[int, list[int]] = defaultdict(list)
    for a, b in hits:
        by_diagonal[b - a].append(a)
    out = []
    for shift, starts in by_diagonal.items():
        starts.sort()
        begin, end = starts[0], starts[0] + N
        for a in starts[1:]:
            # Up to 2 N words between two hits on a diagonal: changed words break at most N windows each.
            if a <= end + 2 * N and _same(item, doc, end, a, shift):
                end = max(end, a + N)
            else:
                out.append(_extend(begin, end, shift, item, doc))
                begin, end = a, a + N
        out.append(_extend(begin, end, shift, item, doc))
    return [(a, a + s, e - a) for a, e, s in out]


def _same(item: list[str], doc: list[str], end: int, start: int, shift: int) -> bool:
    """True where at least half of the words between two runs agree."""
    if start <= end:
        return True
    return sum(item[i] == doc[i + shift] for i in range(end, start)) * 2 >= start - end - 1


def _extend(a: int, e: int, shift: int, item: list[str], doc: list[str]) -> tuple[int, int, int]:
    """A run extended on both sides while, after one changed word, the next two words agree."""
    size, length = len(item), len(doc)
    while True:
        if e < size and e + shift < length and item[e] == doc[e + shift]:
            e += 1
        elif e + 2 < size and e + 2 + shift < length and item[e + 1 : e + 3] == doc[e + 1 + shift : e + 3 + shift]:
            e += 3
        else:
            break
    while True:
        if a > 0 and a + shift > 0 and item[a - 1] == doc[a - 1 + shift]:
            a -= 1
        elif a > 2 and a + shift > 2 and item[a - 3 : a - 1] == doc[a - 3 + shift : a - 1 + shift]:
            a -= 3
        else:
            break
    return a, e, shift


def chain(found: list[tuple[int, int, int]]) -> tuple[int, list[tuple[int, int, int]]]:
    """The chain of runs in item and document order that covers most words: (words, runs)."""
    found = sorted(found, key=lambda r: (r[0], r[1]))
    best = [r[2] for r in found]
    back = [-1] * len(found)
    for j, (a, b, n) in enumerate(found):
        for i in range(j):
            pa_, pb, pn = found[i]
            if pb < b and pa_ < a:
                overlap = max(0, pa_ + pn - a, pb + pn - b)
                if overlap < n and best[i] + n - overlap > best[j]:
                    best[j], back[j] = best[i] + n - overlap, i
    if not found:
        return 0, []
    j = max(range(len(found)), key=best.__getitem__)
    total, path = best[j], []
    while j >= 0:
        path.append(found[j])
        j = back[j]
    return total, path[::-1]


def document_hits(index: Index, text: str | None, share: float) -> list[tuple[int, float, list[tuple[int, int]]]]:
    """(item, share of its words, [(first character, end) of its passages]) of the items that a text takes over."""
    located = spans(text)
    if len(located) < N:
        return []
    ws = [w[0] for w in located]
    out = []
    for item, hits in index.scan(ws).items():
        size = len(index.items[item])
        found = runs(hits, index.items[item], ws)
        if sum(n for _, _, n in found) < size * share:  # no chain covers more than all runs
            continue
        total, path = chain(found)
        if total >= size * share:
            out.append((item, total / size, [(located[b][1], located[min(b + n, len(located)) - 1][2]) for _, b, n in path]))
    return out


def item_blocks(items: DataFrame) -> tuple[DataFrame, int]:
    """(item_id, item_text, block) and the number of blocks of about MAX_NGRAMS n-grams; an item has one block."""
    size = items.agg(F.sum(F.size(F.split("item_text", r"\s+")))).first()[0] or 0
    blocks = max(1, -(-size // MAX_NGRAMS))
    return items.withColumn("block", F.pmod(F.xxhash64("item_id"), F.lit(blocks)).cast("int")), int(blocks)


def shared_grams(items: DataFrame) -> DataFrame:
    """(block, gram): hashes of the n-grams that items of several blocks have."""

    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(b, _gram_hash(g)) for t, b in zip(*(c.to_pylist() for c in batch.columns)) if (ws := words(t)) for g in {_gapped(ws, k) for k in range(len(ws) - N + 1)}]
            columns = list(zip(*found)) if found else [[], []]
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int32()), pa.array(columns[1], pa.int64())], names=["block", "gram"])

    each = items.select("item_text", "block").mapInArrow(grams, "block int, gram bigint").distinct()
    several = each.groupBy("gram").agg(F.count("*").alias("n")).filter("n > 1").select("gram")
    return each.join(several, "gram", "left_semi")


def leaks(documents: DataFrame, items: DataFrame, share: float = 1 / 3) -> DataFrame:
    """Items taken over by documents: doc_id, item_id, share, passages (one row per document and item; a
    passage is first_char and end_char, from 0, in the text).

    documents: doc_id, text; items: item_id, item_text, a stated test set; the driver holds one block
    of it at a time. NULL and empty texts, texts and items under five words, and empty tables give no
    rows; repeated documents give equal rows. Of items with one id the longest text counts.
    """
    spark = documents.sparkSession
    tests = unambiguous(items).select(F.col("item_id").cast("long").alias("item_id"), "item_text").dropna()
    tests = tests.groupBy("item_id").agg(F.max_by("item_text", F.struct(F.length("item_text"), "item_text")).alias("item_text"))
    tests, n = item_blocks(tests)
    outside = shared_grams(tests) if n > 1 else None
    texts = spread(unambiguous(documents).select(F.col("doc_id").cast("long"), "text").filter(F.col("text").isNotNull()))
    found = None
    for block in range(n):
        rows = [(r.item_id, r.item_text) for r in tests.filter(F.col("block") == block).select("item_id", "item_text").collect()]
        shared = frozenset(r.gram for r in outside.filter(F.col("block") == block).select("gram").collect()) if outside is not None else None
        part = _scan(texts, spark.sparkContext.broadcast((rows, shared)), share)
        found = part if found is None else found.unionByName(part)
    return found.dropDuplicates(["doc_id", "item_id"])


def _scan(texts: DataFrame, shared, share: float) -> DataFrame:
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index(*shared.value)
        for batch in batches:
            out: list[tuple] = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                out.extend((doc, *hit) for hit in document_hits(index, text, share))
            passage = pa.list_(pa.struct([("first_char", pa.int32()), ("end_char", pa.int32())]))
            columns = list(zip(*out)) if out else [[]] * 4
            columns[3] = [[{"first_char": a, "end_char": e} for a, e in p] for p in columns[3]]
            types = (pa.int64(), pa.int64(), pa.float64(), passage)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=["doc_id", "item_id", "share", "passages"])

    return texts.mapInArrow(scan, "doc_id bigint, item_id bigint, share double, passages array<struct<first_char:int,end_char:int>>")


def remove_spans(documents: DataFrame, found: DataFrame, whole_share: float = 0.5) -> DataFrame:
    """Documents without the passages that leaked; documents of which more than whole_share would go
    are left out. A document has at most one row per test item in found, so its list is bounded."""
    cut = found.groupBy("doc_id").agg(F.sort_array(F.flatten(F.collect_list("passages"))).alias("_cuts"))
    joined = unambiguous(documents).drop("_cuts", "_kept").join(cut, "doc_id", "left")
    kept = F.aggregate(
        F.coalesce("_cuts", F.array().cast("array<struct<first_char:int,end_char:int>>")),
        F.struct(F.lit("").alias("text"), F.lit(0).alias("at")),
        lambda acc, c: F.struct(
            F.concat(acc["text"], F.when(c["first_char"] > acc["at"], F.substring(F.col("text"), acc["at"] + 1, c["first_char"] - acc["at"])).otherwise(F.lit(""))).alias("text"),
            F.greatest(acc["at"], c["end_char"]).alias("at"),
        ),
        lambda acc: F.concat(acc["text"], F.substring(F.col("text"), acc["at"] + 1, F.length("text"))),
    )
    out = joined.withColumn("_kept", kept)
    return out.filter(F.col("_cuts").isNull() | (F.length("_kept") >= F.length("text") * (1 - whole_share))).withColumn("text", F.coalesce("_kept", "text")).drop("_kept", "_cuts")
