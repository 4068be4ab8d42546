"""Mapping of free-entered values to a canonical list with a BK-tree.

The tree holds the folded reference names and aliases under the Levenshtein distance, a true
metric. A look-up visits, by the triangle inequality, only the children whose edge lies within
the radius of the distance at hand, and returns every entry within the threshold. The reference
list is sharded into trees of about SHARD entries, each broadcast for a scan of the distinct values of
its own; each shard returns the rank of its best entry, and the best rank of all shards wins. An exact
entry ranks before one within the threshold, then fewer edits, then fewer words taken away, then the
smaller id; the order is the same within a shard and between shards.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnlight.runtime import durable, unambiguous

#: Entries (names and aliases) of one tree.
SHARD = 20_000

# Letters of other scripts that look like Latin letters.
_LOOK_ALIKES = str.maketrans({
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ј": "j", "ѕ": "s", "һ": "h", "ԁ": "d",
    "к": "k", "м": "m", "т": "t", "в": "b", "н": "h", "ѵ": "v", "ԛ": "q", "ԝ": "w", "ո": "n", "ս": "u",
    "α": "a", "ο": "o", "ι": "i", "κ": "k", "ν": "v", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ı": "i", "ł": "l", "ø": "o", "đ": "d", "ß": "ss",
})
_MARKS = re.compile("[™®©℠​-‏⁠﻿­]")
_NOT_WORD = re.compile(r"[\W_]+")
_GLUED = re.compile(r"(?<=[^\W\d_])(?<![A-Z])(?=[A-Z][A-Za-z.])|(?<=[A-Z])(?=[A-Z][a-z])|(?<=[a-z])(?=TM\b)")

# Words that sellers and models put around a name.
LEADING = ("brand", "merek", "marke", "marca", "marque", "by", "von", "from", "visit the", "the")
TRAILING = (
    "official store", "flagship store", "flagship shop", "official shop", "store", "shop", "authentic", "official", "original",
    "inc", "incorporated", "llc", "ltd", "co ltd", "co", "corp", "gmbh", "ag", "kg", "s a", "sa", "s r l", "srl", "bv", "pte ltd", "pte", "pt", "plc",
    "global", "europe", "usa", "indonesia", "singapore", "deutschland", "germany", "japan", "france", "international", "trading", "supply", "partners", "tm",
)


def fold(text: str, apart: bool = False) -> list[str]:
    """Words of a value without case, marks, invisible characters, look-alike letters and punctuation;
    apart also splits words where a capital follows a small letter."""
    text = unicodedata.normalize("NFKC", _MARKS.sub("", text))
    text = (_GLUED.sub(" ", text) if apart else text).casefold()
    if not text.isascii():
        text = unicodedata.normalize("NFD", text.translate(_LOOK_ALIKES))
        text = "".join(c for c in text if unicodedata.category(c) not in ("Mn", "Cf")).translate(_LOOK_ALIKES)
    return [w for w in _NOT_WORD.sub(" ", text).split() if w != "and"]


def levenshtein(a: str, b: str, limit: int | None = None) -> int:
    """Edit distance by bit-parallel columns (one integer per column of the matrix)."""
    if a == b:
        return 0
    if not a or not b:
        return len(a) or len(b)
    peq: dict[str, int] = {}
    for i, ch in enumerate(a):
        peq[ch] = peq.get(ch, 0) | 1 << i
    return _column_distance(peq, len(a), b)


def _column_distance(peq: dict[str, int], m: int, b: str) -> int:
    full, top = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score = full, 0, m
    get = peq.get
    for ch in b:
        eq = get(ch, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | (full & ~(xh | pv))
        mh = pv & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
        ph = (ph << 1) | 1
        pv = ((mh << 1) | (full & ~(xv | ph))) & full
        mv = ph & xv & full
    return score


def transposed(a: str, b: str) -> bool:
    """True where b is a with two neighbouring letters swapped."""
    if len(a) != len(b):
        return False
    diff = [i for i in range(len(a)) if a[i] != b[i]]
    return len(diff) == 2 and diff[1] == diff[0] + 1 and a[diff[0]] == b[diff[1]] and a[diff[1]] == b[diff[0]]


class BKTree:
    """Entries by distance from their parent; search returns every entry within the radius."""

    def __init__(self, words=()):
        self.root: tuple[str, dict] | None = None
        self.size = 0
        for w in words:
            self.add(w)

    def add(self, word: str) -> None:
        if self.root is None:
            self.root, self.size = (word, {}), 1
            return
        node = self.root
        while True:
            d = levenshtein(word, node[0])
            if d == 0:
                return
            child = node[1].get(d)
            if child is None:
                node[1][d] = (word, {})
                self.size += 1
                return
            node = child

    def search(self, word: str, radius: int) -> list[tuple[int, str]]:
        if self.root is None or not word:
            return []
        peq: dict[str, int] = {}
        for i, ch in enumerate(word):
            peq[ch] = peq.get(ch, 0) | 1 << i
        m, found, stack = len(word), [], [self.root]
        while stack:
            entry, children = stack.pop()
            d = _column_distance(peq, m, entry)
            if d <= radius:
                found.append((d, entry))
            if children:
                low, high = d - radius, d + radius
                stack.extend(c for e, c in children.items() if low <= e <= high)
        return found


def _close(words: list[str], vocabulary: dict[str, int]) -> int | None:
    """Number of trailing words that form an entry of the vocabulary, one typing error allowed in longer ones."""
    tails = {n: "".join(words[-n:]) for n in (3, 2, 1) if len(words) > n}
    for n, tail in tails.items():
        if tail in vocabulary:
            return n
    for n, tail in sorted(tails.items()):
        if len(tail) >= 5 and any(abs(len(v) - len(tail)) <= 1 and _one_edit(tail, v) for v in vocabulary if len(v) >= 5):
            return n
    return None


def _one_edit(a: str, b: str) -> bool:
    d = levenshtein(a, b)
    return d <= 1 or (d == 2 and transposed(a, b))


_TRAILING = {t.replace(" ", ""): 1 for t in TRAILING}
_LEADING = {t.replace(" ", "") for t in LEADING}


def variants(text: str) -> list[str]:
    """The folded value and what remains of it as words around the name are taken away, shortest last."""
    return list(_forms(text))


def _forms(text: str) -> dict[str, int]:
    """The variants with the number of times that words were taken away."""
    whole, apart = fold(text), fold(text, True)
    found = [(f, n) for ws in ((apart, whole) if apart != whole else (whole,)) for n, f in enumerate(_peel(ws))]
    least: dict[str, int] = {}
    for f, n in found:
        least[f] = min(n, least.get(f, n))
    return least


def _peel(words: list[str]) -> list[str]:
    out = ["".join(words)]
    for _ in range(4):
        for n in (2, 1):
            head = "".join(words[:n])
            if len(words) > n and (head in _LEADING or (len(head) >= 5 and any(_one_edit(head, v) for v in _LEADING if len(v) >= 5))):
                words = words[n:]
                out.append("".join(words))
                break
        n = _close(words, _TRAILING)
        if n is None:
            break
        words = words[:-n]
        out.append("".join(words))
    return [v for v in dict.fromkeys(out) if v]


def cut_ends(text: str) -> list[str]:
    """Folded values without a first or last word that is one typing error away from a known short
    one; such a cut is trusted only where the rest is exactly an entry."""
    out = []
    for words in (fold(text), fold(text, True)):
        for n in (1, 2, 3):
            if len(words) > n:
                if any(_one_edit("".join(words[-n:]), t) for t in _TRAILING):
                    out += _peel(words[:-n])
                if any(_one_edit("".join(words[:n]), t) for t in _LEADING):
                    out += _peel(words[n:])
    return list(dict.fromkeys(out))


def allowed(length: int) -> int:
    """Edits allowed at a length of the folded name: 0 up to 3 letters, 1 up to 11, beyond that 2."""
    return 0 if length <= 3 else 1 if length <= 11 else 2


class Resolver:
    """Looks values up in one shard: (distance, entry id) of the best entries."""

    def __init__(self, entries: list[tuple[int, str]]):
        self.ids: dict[str, int] = {}
        for entry_id, name in entries:
            key = "".join(fold(name))
            if key and (key not in self.ids or entry_id < self.ids[key]):
                self.ids[key] = entry_id
        self.tree = BKTree(self.ids)

    def best(self, value: str) -> tuple[int, int] | None:
        """(edits, id) of the closest entry within the threshold."""
        rank = self.rank(value)
        return (rank[1], rank[3]) if rank else None

    def rank(self, value: str) -> tuple[int, int, int, int] | None:
        """The best (tier, edits, words taken away, id): tier 0 exact, 1 within the threshold, 2 exact without a misspelt word at an end."""
        forms = _forms(value)
        exact = [(0, 0, n, self.ids[form]) for form, n in forms.items() if form in self.ids]
        if exact:
            return min(exact)
        found: list[tuple[int, int, int, int]] = []
        for form, n in forms.items():
            limit = allowed(len(form))
            if not limit:
                continue
            for d, entry in self.tree.search(form, 2):
                if d == 2 and transposed(form, entry):
                    d = 1
                if d <= min(limit, allowed(len(entry))):
                    found.append((1, d, n, self.ids[entry]))
        found = found or [(2, 1, n, self.ids[form]) for n, form in enumerate(cut_ends(value)) if form in self.ids]
        return min(found) if found else None


def resolve(values: DataFrame, value: str, reference: DataFrame, entry_id: str, name: str, aliases: str) -> DataFrame:
    """Closest reference entry of every distinct value: (value, entry_id, edits); entry_id 0 if there is none.

    NULL and blank values are left out. NULL names and aliases are ignored. Entries are compared
    folded; an alias counts as its entry's name. A value that fits several entries equally well
    gets the smallest id. An empty reference matches nothing.
    """
    spark = values.sparkSession
    names = reference.select(
        F.col(entry_id).cast("long").alias("id"),
        F.explode(F.array_compact(F.concat(F.array(F.col(name)), F.coalesce(F.col(aliases), F.array().cast("array<string>"))))).alias("name"),
    ).dropna()
    shards = max(1, -(-names.count() // SHARD))
    distinct = values.select(F.col(value).cast("string").alias("value")).filter(F.col("value").rlike(r"[^\s\p{Z}]")).distinct()
    # Few bytes but much work: adaptive execution must not merge the values into few tasks.
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism)
    distinct = distinct.repartition(tasks)
    if shards > 1:
        distinct = durable(distinct)
    ranks = None
    for shard in range(shards):
        entries = names.filter(F.pmod(F.xxhash64("name"), F.lit(shards)) == shard).collect()
        part = _look_up(distinct, spark.sparkContext.broadcast([(r.id, r.name) for r in entries]))
        ranks = part if ranks is None else ranks.unionByName(part)
    if shards > 1:
        ranks = ranks.groupBy("value").agg(F.min("rank").alias("rank"))
    return ranks.select("value", F.coalesce("rank.id", F.lit(0).cast("long")).alias("entry_id"), F.col("rank.edits").alias("edits"))


def _look_up(distinct: DataFrame, entries) -> DataFrame:
    """(value, rank) of the best entry of one shard; the rank is NULL where there is none."""
    fields = ("tier", "edits", "taken", "id")
    kind = pa.struct([("tier", pa.int32()), ("edits", pa.int32()), ("taken", pa.int32()), ("id", pa.int64())])

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = Resolver(entries.value)
        for batch in batches:
            ranks = [shard.rank(t) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([r and dict(zip(fields, r)) for r in ranks], kind)], names=["value", "rank"])

    return distinct.mapInArrow(look_up, "value string, rank struct<tier:int,edits:int,taken:int,id:bigint>")


def map_values(rows: DataFrame, value: str, reference: DataFrame, entry_id: str, name: str, aliases: str) -> DataFrame:
    """rows with entry_id and edits for every row whose value is neither NULL nor blank.

    Values are resolved once each and joined back to the rows; Spark broadcasts the resolved values
    only below its own size limit, else adaptive execution splits the hot values of the shuffle join.
    Columns entry_id and edits that rows may have already are replaced.
    """
    found = resolve(unambiguous(rows), value, unambiguous(reference), entry_id, name, aliases).withColumnRenamed("value", "_value")
    plain = unambiguous(rows)
    left = plain.drop(*[c for c in ("entry_id", "edits", "_value") if c != value]).filter(F.col(value).rlike(r"[^\s\p{Z}]"))
    return left.join(found, F.col(value) == F.col("_value")).drop("_value")
