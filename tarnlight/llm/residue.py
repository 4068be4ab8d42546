"""Template residue and error-page text.

Every page is parsed once: the lines it says outside its furniture are written down. From pages that
say little, or have no heading of their own, message templates are mined with two prefix trees of
fixed depth (length, then the first words; and the same from the end, so that a name in front hides
nothing), digits and slots masked. Every task mines its own rows; the templates of the tasks are
merged by the same trees, group by group, so only templates ever move. The lines of all pages, long
ones and headed ones too, are then looked up, and every template is classified once by what is found:
on how many addresses it stands, on which share of its pages nothing else is said, how much those pages
say, and a few seed words. The verdicts are propagated: a page is a substitute if each of its lines
has a template with a verdict, is made of unfilled slots, or is in no language. Unfilled slots inside
ordinary records are found separately (slot_places).
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnlight.functions import urls
from tarnlight.llm import page_tree as tree
from tarnlight.runtime import durable, spread, unambiguous

#: Templates that may be sent to the tasks; templates are few, as numbers and names are masked.
MAX_TEMPLATES = 500_000
#: A page that says less than this share of the usual says little.
LITTLE = 0.25
#: Words that count as usual: the most frequent ones of the pages with a heading.
USUAL_WORDS = 400

# Notations of unfilled slots.
_SLOT = re.compile(
    r"\{\{\s*[\w.\s|$-]{1,60}\}\}|\$\{[\w.\s-]{1,60}\}|\{%-?\s*\w+[^%]{0,60}%\}|<%[=-]?\s*[\w.$\s]{1,60}%>|<\?(?:=|php)?\s*\$?[\w.>\s$-]{1,60}\?>|\[\[\s*[\w.\s-]{1,60}\]\]|@@[\w.-]{1,60}@@"
    r"|(?<![\w%])%[A-Za-z][\w.-]{1,60}%(?![\w%])|(?<!\w)__[A-Za-z][\w.-]{1,60}?__(?!\w)|#?\{[A-Za-z_][\w.]{0,60}\}"
)
# Seed words by kind. They name the kind of a template, and let one classify that stands on a single address.
SEEDS = {
    "prompt": r"\bgoes here\b|\bto be added\b|\bx{4,}|^todo\b|\binsert\b.*\bhere\b|^enter (?:the|your)\b|: (?:description|text|title) of\b",
    "filler": r"\blorem ipsum\b|\bplaceholder\b|\bplatzhalter|\bbeispieltext|\bprovisoire\b|\btexto de\b|\bsample text\b|\bcoming soon\b|\bunder construction\b|^(?:test ?){2,}|^(?:asdf ?)+",
    "script": r"\bjava ?script\b|\bscripts?\b|\bbrowser\b|^loading\b",
    "error": r"\b[45]\d\d\b|\berror\b|\bnot find\b|\bnot found\b|\bno encontrada\b|\bnicht gefunden\b|\bn.existe\b|\bdenied\b|\bforbidden\b|\bgateway\b|\bmaintenance\b|\bexpired\b|\bsuspended\b|\bfatal\b|\btoo many requests\b|\brobot\b",
}
#: Words that a line of a seed may have at most.
SEED_WORDS = 25
_WORD = re.compile(r"[^\W\d_]+")
_NUMBER = re.compile(r"\d")
_TOKEN = re.compile(r"\w+|[^\w\s]")
_HEADING = re.compile(r"(?m)^# ")
#: Codes of lines that are residue without a template.
SLOT, FILLER = -1, -2


def slots(text: str | None) -> list[str]:
    """Unfilled slots in any text, ordinary records included."""
    return _SLOT.findall(text) if text else []


def only_slots(line: str) -> bool:
    """True where slots make up a line, or at least three stand in one sentence or two in a short one."""
    found = _SLOT.findall(line)
    if not found:
        return False
    rest = _WORD.findall(_SLOT.sub(" ", line))
    return len(rest) <= 2 or len(found) >= 3 or (len(found) >= 2 and len(rest) <= 10)


class Language:
    """Tells text of no language: few of its words are among the usual ones of the corpus, and it has no comma and no digit."""

    def __init__(self, usual: frozenset[str]):
        self.usual = usual

    def share(self, words: list[str]) -> float:
        return sum(w in self.usual for w in words) / max(1, len(words))

    def doubtful(self, line: str) -> list[str]:
        """The words of a line of six or more words that may be in no language, else nothing."""
        if not self.usual or "," in line or _NUMBER.search(line):
            return []
        words = [w.casefold() for w in _WORD.findall(line)]
        return words if len(words) >= 6 and self.share(words) * 4 < 1 else []


def page_lines(html: str | None, markdown: str | None, root: tree.Node | None = None) -> tuple[list[str], bool]:
    """What a page says outside its furniture, and whether it has a heading of its own (an h1 in its body).

    root: the measured tree of the html where it is at hand.
    """
    if html and html.strip():
        if root is None:
            root = tree.parse(html)
            tree.measure(root)
        lines = tree.message_texts(root)
        headed = "<h1" in html
    elif markdown and markdown.strip():
        lines = tree.markdown_messages(markdown.split("\n"))
        headed = bool(_HEADING.search(markdown))
    else:
        return [], False
    return [x for x in lines if not tree.furniture_line(x)], headed


def tokens(line: str) -> tuple[str, ...]:
    """Words and signs of a message, closing points left out, with masked variables: anything with a digit, and slots."""
    found = _TOKEN.findall(_SLOT.sub(" 0 ", line).casefold())
    while len(found) > 1 and found[-1] in ".!?…":
        found.pop()
    return tuple("<*>" if _NUMBER.search(w) else w for w in found)


def kind_of(line: str, seeds: dict[str, str]) -> str | None:
    """The kind whose seed words a short line holds."""
    if len(line.split()) > SEED_WORDS:
        return None
    text = tree.plain(line) if not line.startswith(("<", "[")) else line.casefold()
    return next((k for k, p in seeds.items() if re.search(p, text)), None)


class TemplateMiner:
    """A prefix tree of fixed depth: length, then the first words; leaves hold templates: words, lines counted, kind."""

    def __init__(self, depth: int = 2, similarity: float = 0.6):
        self.depth, self.similarity = depth, similarity
        self.leaves: dict[tuple, list[list]] = {}

    def key(self, words: tuple[str, ...]) -> tuple:
        return (len(words), *words[: self.depth])

    def add(self, words: tuple[str, ...], n: int = 1, kind: str | None = None) -> None:
        group = self.leaves.setdefault(self.key(words), [])
        best, score = None, 0.0
        for entry in group:
            same = sum(a == b for a, b in zip(entry[0], words)) / max(1, len(words))
            if same > score:
                best, score = entry, same
                if same == 1:
                    break
        if best is None or score < self.similarity:
            group.append([words, n, kind])
            return
        if score < 1:
            best[0] = tuple(a if a == b else "<*>" for a, b in zip(best[0], words))
        best[1] += n
        best[2] = best[2] or kind

    def templates(self) -> Iterator[list]:
        for group in self.leaves.values():
            yield from group


def records(pages: DataFrame, bodies: bool = False) -> DataFrame:
    """What every page says, from one parse: page_id, url, headed, n_words, lines, and with bodies the
    numbers of the lines of markdown that tree scoring keeps (body).

    url is the address without case of the host, closing slash and fragment. NULL and empty html and
    markdown give no lines. Pages with a NULL page_id keep it.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flags, sizes, texts, kept = [], [], [], []
            for h, m in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                root, nodes, body = None, [], []
                if h and h.strip():
                    root = tree.parse(h)
                    if bodies and m:
                        nodes = tree.body_nodes(root)
                    else:
                        tree.measure(root)
                lines, headed = page_lines(h, m, root)
                if bodies and m and m.strip():
                    rows = m.split("\n")
                    body = [i + 1 for i in (tree.match_lines(tree.block_texts(nodes), rows) if root is not None else tree.markdown_body(rows))]
                flags.append(headed)
                sizes.append(sum(len(x.split()) for x in lines))
                texts.append(lines)
                kept.append(body)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(flags, pa.bool_()), pa.array(sizes, pa.int32()), pa.array(texts, pa.list_(pa.string())), pa.array(kept, pa.list_(pa.int64()))],
                names=["page_id", "url", "headed", "n_words", "lines", "body"],
            )

    plain = unambiguous(pages)
    rows = plain.select(F.col("page_id").cast("long"), F.coalesce(urls.entity_key(F.col("url")), F.lit("")).alias("url"), "html", "markdown")
    return spread(rows).mapInArrow(read, "page_id bigint, url string, headed boolean, n_words int, lines array<string>, body array<bigint>")


def usual_size(said: DataFrame) -> float:
    """Median of the words of the pages with a heading; infinite where there are none."""
    size = said.filter("headed").agg(F.percentile_approx("n_words", 0.5)).first()[0]
    return math.inf if size is None else float(size)


def mine(said: DataFrame, usual: float, seeds: dict[str, str] | None = None) -> DataFrame:
    """Message templates: back (counted from the end), template, n, kind.

    said are records, usual is their usual_size. Pages are mined that have no heading or say less than
    LITTLE of the usual; counting is done over all pages (matches). A template of one line without seed
    words can get no verdict and is not sent on.
    """
    seeds = SEEDS if seeds is None else seeds
    def drain(miners: tuple[TemplateMiner, TemplateMiner]) -> pa.RecordBatch:
        found = [(bool(b), "\u0001".join(map(str, (b, *miner.key(t[0])))), list(t[0]), t[1], t[2]) for b, miner in enumerate(miners) for t in miner.templates()]
        columns = list(zip(*found)) if found else [[]] * 5
        types = (pa.bool_(), pa.string(), pa.list_(pa.string()), pa.int64(), pa.string())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=["back", "key", "template", "n", "kind"])

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        miners = TemplateMiner(), TemplateMiner()
        for batch in batches:
            for lines in batch.column(0).to_pylist():
                for line in lines:
                    if not only_slots(line):
                        words, kind = tokens(line), kind_of(line, seeds)
                        miners[0].add(words, 1, kind)
                        miners[1].add(words[::-1], 1, kind)
        yield drain(miners)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        miners = TemplateMiner(), TemplateMiner()
        for batch in batches:
            for back, words, n, kind in zip(*(c.to_pylist() for c in batch.columns)):
                miners[back].add(tuple(words), n, kind)
        out = drain(miners)
        yield out.select(["back", "template", "n", "kind"])

    short = said.filter(~F.col("headed") | (F.col("n_words") < F.lit(LITTLE * usual))).filter(F.size("lines") > 0).select("lines")
    partial = short.mapInArrow(local, "back boolean, key string, template array<string>, n bigint, kind string")
    same = partial.groupBy("back", "key", "template").agg(F.sum("n").alias("n"), F.max("kind").alias("kind"))
    # All templates of one (direction, length, first words) meet in one task: distinct templates, not rows.
    together = same.repartition("key").sortWithinPartitions("key", F.desc("n"), "template").select("back", "template", "n", "kind")
    merged = together.mapInArrow(merge, "back boolean, template array<string>, n bigint, kind string")
    return merged.filter("n > 1 or kind is not null")


def collect_templates(templates: DataFrame) -> list[tuple[bool, list[str], str | None]]:
    """The templates for the tasks; an error where there are more than MAX_TEMPLATES."""
    rows = templates.limit(MAX_TEMPLATES + 1).collect()
    if len(rows) > MAX_TEMPLATES:
        raise ValueError("more message templates than MAX_TEMPLATES")
    return sorted(((r.back, list(r.template), r.kind) for r in rows), key=lambda r: (r[0], r[1]))


class Matcher:
    """Looks lines up among templates; a template's number is its place in the list."""

    def __init__(self, templates: list[tuple[bool, list[str], str | None]]):
        self.known: dict[tuple, list[tuple[tuple, int]]] = {}
        for i, (back, words, _) in enumerate(templates):
            self.known.setdefault((back, len(words), *words[:2]), []).append((tuple(words), i))

    def numbers(self, line: str) -> list[int]:
        words = tokens(line)
        out = []
        for back, ws in ((False, words), (True, words[::-1])):
            for template, i in self.known.get((back, len(ws), *ws[:2]), ()):
                if all(a in ("<*>", b) for a, b in zip(template, ws)):
                    out.append(i)
        return out


def read_lines(lines: list[str], matcher: Matcher, language: Language) -> tuple[list[list[int]], int]:
    """(codes of each residue-like line, number of lines of content) of a page."""
    codes: list[list[int]] = []
    content = 0
    doubtful: list[str] = []
    for line in lines:
        if only_slots(line):
            codes.append([SLOT])
            continue
        found = matcher.numbers(line)
        words = language.doubtful(line)
        if words:
            doubtful += words
            found = [*found, FILLER]
        if found:
            codes.append(found)
        else:
            content += 1
    # Lines of no language hold a usual word by chance; together they hardly do.
    if doubtful and language.share(doubtful) * 5 >= 1:
        codes = [[i for i in c if i != FILLER] for c in codes]
        content += sum(not c for c in codes)
        codes = [c for c in codes if c]
    return codes, content


def matches(said: DataFrame, templates: list, usual_words: list[str], keep_all: bool = False) -> DataFrame:
    """page_id, url, n_words, codes, content, body of the pages that hold a residue-like line, with keep_all of all pages."""
    shared = said.sparkSession.sparkContext.broadcast((templates, frozenset(usual_words)))

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher, language = Matcher(shared.value[0]), Language(shared.value[1])
        for batch in batches:
            found = [read_lines(lines, matcher, language) for lines in batch.column(3).to_pylist()]
            out = pa.RecordBatch.from_arrays(
                [*batch.columns[:3], pa.array([c for c, _ in found], pa.list_(pa.list_(pa.int32()))), pa.array([n for _, n in found], pa.int32()), batch.column(4)],
                names=["page_id", "url", "n_words", "codes", "content", "body"],
            )
            yield out if keep_all else out.filter(pa.array([bool(c) for c, _ in found], pa.bool_()))

    return said.select("page_id", "url", "n_words", "lines", "body").mapInArrow(look, "page_id bigint, url string, n_words int, codes array<array<int>>, content int, body array<bigint>")


def verdicts(found: DataFrame, templates: list, usual: float, bare_share: float = 0.5, addresses: int = 2) -> dict[int, str]:
    """Classifies the templates: {number: kind}.

    A template is residue if on at least bare_share of its pages nothing else is said, and it either
    stands so on two addresses or more, on pages that say less than LITTLE of the usual, or holds seed
    words. Its kind is that of its seed words, else "recurring".
    """
    each = found.select("url", "n_words", "content", F.explode(F.array_distinct(F.flatten("codes"))).alias("t")).filter("t >= 0")
    bare = F.col("content") == 0
    rows = each.groupBy("t").agg(F.avg(bare.cast("double")).alias("share"), F.count_distinct(F.when(bare, F.col("url"))).alias("n"), F.avg(F.when(bare, F.col("n_words"))).alias("words"))
    out: dict[int, str] = {}
    for r in rows.filter(F.col("share") >= bare_share).collect():
        kind = templates[r.t][2]
        if kind or (r.n >= addresses and r.words < LITTLE * usual):
            out[r.t] = kind or "recurring"
    return out


class Findings:
    """The records of a table with the verdicts on its templates."""

    def __init__(self, pages: DataFrame, bodies: bool = False, seeds: dict[str, str] | None = None, templates: list | None = None):
        said = durable(records(pages, bodies))
        words = said.filter("headed").select(F.explode("lines").alias("line")).select(F.explode(F.split(F.lower("line"), r"[^\p{L}]+")).alias("w")).filter("w <> ''")
        self.usual_words = sorted(r.w for r in words.groupBy("w").count().orderBy(F.desc("count"), "w").limit(USUAL_WORDS).collect())
        self.usual = usual_size(said)
        self.templates = collect_templates(mine(said, self.usual, seeds)) if templates is None else templates
        self.found = durable(matches(said, self.templates, self.usual_words, bodies))
        self.verdicts = verdicts(self.found, self.templates, self.usual)

    def judged(self) -> DataFrame:
        """page_id, kind, n_lines, body of the kept pages; the kind is NULL for pages with content of their own or without any line."""
        shared = self.found.sparkSession.sparkContext.broadcast({SLOT: "slot", FILLER: "filler"} | self.verdicts)

        def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            kind_of_code = shared.value
            for batch in batches:
                kinds, sizes = [], []
                for codes, content in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                    named = [next((kind_of_code[i] for i in c if i in kind_of_code), None) for c in codes]
                    full = bool(named) and not content and None not in named
                    kinds.append(Counter(named).most_common(1)[0][0] if full else None)
                    sizes.append(len(named))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(kinds, pa.string()), pa.array(sizes, pa.int32()), batch.column(3)], names=["page_id", "kind", "n_lines", "body"])

        return self.found.select("page_id", "codes", "content", "body").mapInArrow(judge, "page_id bigint, kind string, n_lines int, body array<bigint>")


def judge_pages(pages: DataFrame, seeds: dict[str, str] | None = None, templates: list | None = None) -> DataFrame:
    """page_id, kind and n_lines of every page whose text is a substitute for content.

    NULL and empty html and markdown store nothing and are no case; success and error are ignored.
    Pages with a NULL page_id keep it. seeds and templates replace the seed words and the mined templates.
    """
    return Findings(pages, False, seeds, templates).judged().filter("kind is not null").select("page_id", "kind", "n_lines")


def main_bodies(pages: DataFrame) -> DataFrame:
    """(page_id, line_no) of the lines of markdown that belong to the main body.

    Substitutes for content (judge_pages) and pages without markdown have no such lines.
    """
    return Findings(pages, True).judged().filter("kind is null").select("page_id", F.explode("body").alias("line_no"))


def slot_places(pages: DataFrame) -> DataFrame:
    """page_id, column, position and slot of every unfilled slot in the whole html and markdown of all pages.

    Positions are in characters from 0. NULL texts give no rows; pages with a NULL page_id keep it.
    """

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for pid, h, m in zip(*(c.to_pylist() for c in batch.columns)):
                for name, text in (("html", h), ("markdown", m)):
                    out.extend((pid, name, x.start(), x[0]) for x in _SLOT.finditer(text or ""))
            columns = list(zip(*out)) if out else [[]] * 4
            types = (pa.int64(), pa.string(), pa.int32(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=["page_id", "column", "position", "slot"])

    return unambiguous(pages).select(F.col("page_id").cast("long"), "html", "markdown").mapInArrow(find, "page_id bigint, column string, position int, slot string")
