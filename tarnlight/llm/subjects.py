"""Subject areas of documents.

Complement naive Bayes is trained on labelled documents; expectation-maximisation refines it over
all documents: every document is a mixture of areas and of text about no area, its sentences get
posteriors under that mixture, and the posteriors give new word counts. Words count within the
language of their sentence: labels are unevenly spread over languages, and without that every
function word of a language would lean to the areas that have its labels. A document's share of an
area is the share of its decided sentences; a logistic curve for each area, fitted on the labelled
documents, calibrates independent posteriors; documents held out measure the error.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnlight.runtime import durable, spread, unambiguous

#: Labelled documents that the first fit reads (a sample by hash of the id where there are more).
MAX_LABELLED = 50_000
#: One labelled document out of so many is held out by calibration_report.
HELD_OUT = 4
#: Areas of the list, which the model's weights are columns of.
MAX_AREAS = 1_000
#: Slots of a language: words share the slots by a hash, so that none is left out however many there are.
SLOTS = 1 << 18
#: Documents that a slot's words must occur in; names of one document never count.
MIN_DOCUMENTS = 2
ALPHA = 0.05
#: Weight of the common curve in the intercept of an area.
PRIOR = 20.0
ROUNDS = 2
#: Least posterior of a sentence by its own words, whatever its document is about.
OWN = 0.6
#: Least weight in some area for a word to count; weaker words only add up to noise.
TELLING = 0.5

_ADDRESS = re.compile(r"https?://\S+|\]\([^)]*\)|\[[^\]\s]{1,8}\]:?")
_SENTENCE = re.compile(r"(?<=[.!?…])\s+|\n+")
_WORD = re.compile(r"[^\W\d_]{2,}")


# Function words that belong to one of the corpus's languages only.
_FUNCTION_WORDS = {
    "en": "the of to and is was with by from it that this which are were be at as an has its most more they you how what when who why for or their there than soon after before between",
    "de": "der die das dem ein eine und oder nicht mit von zu im auf aus bei für ist auch es wer ohne seit oft sich den diese dieser sind zur zum als wie mehr manchmal über",
    "es": "el los las una unas del y con por para es desde hace sin quien más también esta este su sus debería al son muy unos",
    "fr": "le les des du et ou ne pas avec pour dans est sont qui cette au aux sans depuis une ces mais aussi plus sur ans par",
}
_LANGUAGE = {w: lang for lang, ws in _FUNCTION_WORDS.items() for w in ws.split()}
#: The languages that have slots of their own; "xx" is text without function words.
LANGUAGES = (*_FUNCTION_WORDS, "xx")


def _lead(words: list[str]) -> str | None:
    """The language with most function words among the words, None without any or in a tie."""
    count: dict[str, int] = {}
    for w in words:
        lang = _LANGUAGE.get(w)
        if lang is not None:
            count[lang] = count.get(lang, 0) + 1
    if not count:
        return None
    top = max(count.values())
    best = [x for x, n in count.items() if n == top]
    return best[0] if len(best) == 1 else None


def sentences(text: str | None) -> list[tuple[str, list[str]]]:
    """Sentences, headings and list items: (language, distinct words in lower case), without addresses and numbers.

    A sentence without function words has the language of its document ("xx" where that has none).
    """
    if not text:
        return []
    if "]" in text or "http" in text:
        text = _ADDRESS.sub(" ", text)
    found = [ws for ws in (_WORD.findall(s.casefold()) for s in _SENTENCE.split(text)) if ws]
    langs = [_lead(ws) for ws in found]
    known = [x for x in langs if x]
    main = max(sorted(set(known)), key=known.count) if known else "xx"
    return [(lang or main, list(dict.fromkeys(ws))) for lang, ws in zip(langs, found)]


class Encoder:
    """Turns texts into the slots of their words."""

    def __init__(self):
        self.first = {lang: i * SLOTS for i, lang in enumerate(LANGUAGES)}
        self.memo: dict[str, int] = {}

    def slot(self, word: str) -> int:
        found = self.memo.get(word)
        if found is None:
            if len(self.memo) > 500_000:  # a memo of repeated words, not of results
                self.memo.clear()
            found = self.memo[word] = xxhash.xxh64_intdigest(word) & (SLOTS - 1)
        return found

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Slots, sentence offsets and document offsets (in sentences)."""
        words: list[int] = []
        starts: list[int] = [0]
        docs: list[int] = [0]
        slot = self.slot
        for text in texts:
            for lang, s in sentences(text):
                first = self.first[lang]
                words.extend([first + slot(w) for w in s])
                starts.append(len(words))
            docs.append(len(starts) - 1)
        return np.array(words, np.int64), np.array(starts, np.int64), np.array(docs, np.int64)


class Model:
    """Weights of slots by area: the log of a slot's share of its language's text over its share of the area's complement.

    Only slots that weigh anything are held; place leads from a slot to its row, the last row weighs nothing.
    """

    def __init__(self, areas: list[str], at: np.ndarray, counts: np.ndarray, holders: np.ndarray):
        """at: slots; counts: (slots, areas); holders: documents with the slot. Slots of fewer than MIN_DOCUMENTS weigh nothing."""
        self.areas = areas
        k = len(areas)
        known = holders >= MIN_DOCUMENTS
        self.at, each = at[known], counts[known]
        of = self.at // SLOTS
        by_area = np.zeros((len(LANGUAGES), k))
        np.add.at(by_area, of, each)
        total = each.sum(1)
        n = np.maximum(by_area.sum(1), 1e-9)
        base = np.log((total + ALPHA * k) / n[of])
        rest = np.log((total[:, None] - each + ALPHA * max(k - 1, 1)) / np.maximum((n[:, None] - by_area)[of], 1e-9))
        self.rows = np.vstack([base[:, None] - rest, np.zeros((1, k))]).astype(np.float32)

    @cached_property
    def place(self) -> np.ndarray:
        found = np.full(len(LANGUAGES) * SLOTS, len(self.at), np.int32)
        found[self.at] = np.arange(len(self.at), dtype=np.int32)
        return found

    def only_telling(self) -> Model:
        """Leaves out words that tell no area: in the refined model they only add up to noise."""
        self.rows[self.rows.max(1, initial=0.0) < TELLING] = 0
        return self

    def likelihoods(self, words: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Likelihood of every sentence per area, relative to text about no area."""
        total = np.zeros((len(words) + 1, len(self.areas)), np.float64)
        np.cumsum(self.rows[self.place[words]], axis=0, out=total[1:], dtype=np.float64)
        return np.exp(np.clip(total[starts[1:]] - total[starts[:-1]], -20, 20))

    def posteriors(self, lik: np.ndarray, docs: np.ndarray, prior: np.ndarray | None = None, rounds: int = 5) -> tuple[np.ndarray, np.ndarray]:
        """Posteriors of sentences (areas, then no area) and mixtures of documents."""
        k, n = len(self.areas), len(docs) - 1
        of = np.repeat(np.arange(n), np.diff(docs))
        lik = np.hstack([lik, np.ones((len(lik), 1))])
        mix = np.full((n, k + 1), 1 / (k + 1)) if prior is None else prior
        smooth = np.full(k + 1, 0.1)
        smooth[k] = 0.5
        post = lik
        for _ in range(rounds):
            post = mix[of] * lik
            post /= post.sum(1, keepdims=True)
            sums = np.vstack([np.bincount(of, post[:, j], n) for j in range(k + 1)]).T + smooth
            mix = sums / sums.sum(1, keepdims=True)
        return post, mix

    def shares_encoded(self, words: np.ndarray, starts: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        lik = self.likelihoods(words, starts)
        post, mix = self.posteriors(lik, docs)
        k, n = len(self.areas), len(docs) - 1
        if not len(lik):
            return np.zeros((n, k)), mix[:, :k]
        best = post[:, :k].argmax(1)
        at = np.arange(len(lik))
        own = lik[at, best] / (1 + lik.sum(1))
        decided = (post[at, best] >= 0.5) & (own > OWN)
        of = np.repeat(np.arange(n), np.diff(docs))
        sums = np.zeros((n, k))
        np.add.at(sums, (of[decided], best[decided]), 1.0)
        return sums / np.maximum(sums.sum(1, keepdims=True), 1), mix[:, :k]


def _labelled(encoded: DataFrame, labels: DataFrame, names: list[str]) -> list:
    """doc_id, words, lens and subjects of the labelled documents, at most MAX_LABELLED of them."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.trim(F.lower("subject")).alias("subject")).dropna().filter(F.col("subject").isin(names)).distinct()
    sets = known.groupBy("doc_id").agg(F.sort_array(F.collect_set("subject")).alias("subjects"))
    sets = sets.orderBy(F.xxhash64("doc_id")).limit(MAX_LABELLED)
    rows = encoded.filter(F.size("lens") > 0).join(sets, "doc_id").dropDuplicates(["doc_id"]).toArrow()
    return sorted(zip(*(rows.column(c).to_pylist() for c in ("doc_id", "words", "lens", "subjects"))))


def encode_table(documents: DataFrame) -> DataFrame:
    """(doc_id, words, lens): the slots of each document's words, and the number of words per sentence.

    Texts are split once; all rounds and the classification then work on these arrays.
    """

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by = Encoder()
        for batch in batches:
            words_, starts, docs = by.encode(batch.column(1).to_pylist())
            lens = np.diff(starts)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.ListArray.from_arrays(pa.array(starts[docs], pa.int32()), pa.array(words_, pa.int32())), pa.ListArray.from_arrays(pa.array(docs, pa.int32()), pa.array(lens, pa.int32()))],
                names=["doc_id", "words", "lens"],
            )

    return spread(documents.select(F.col("doc_id").cast("long"), "text")).mapInArrow(encode, "doc_id bigint, words array<int>, lens array<int>")


def _arrays(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word ids, sentence offsets and document offsets of a batch of encode_table."""
    words, lens = batch.column(1), batch.column(2)
    flat = words.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    sizes = lens.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    offsets = lens.offsets.to_numpy().astype(np.int64)
    return flat, np.concatenate([[0], np.cumsum(sizes)]), offsets - offsets[0]


def area_names(areas: DataFrame) -> list[str]:
    """The areas in lower case; an error where there are more than MAX_AREAS."""
    rows = areas.select(F.trim(F.lower("subject")).alias("s")).dropna().filter("s <> ''").distinct().limit(MAX_AREAS + 1).collect()
    if len(rows) > MAX_AREAS:
        raise ValueError("more areas than MAX_AREAS")
    return sorted(r.s for r in rows)


def train(encoded: DataFrame, labels: DataFrame, areas: DataFrame, rounds: int = ROUNDS) -> tuple[Model, Calibration]:
    """The refined model and the calibration, from encode_table's documents."""
    names = area_names(areas)
    return _train(encoded, _labelled(encoded, labels, names), names, rounds)


def _train(encoded: DataFrame, labelled: list, names: list[str], rounds: int) -> tuple[Model, Calibration]:
    index = {a: j for j, a in enumerate(names)}
    at = np.unique(np.array([w for _, words, _, _ in labelled for w in words], np.int64))
    counts, holders = np.zeros((len(at), len(names))), np.zeros(len(at), np.int64)
    for _, words, _, subjects in labelled:
        rows = np.searchsorted(at, np.array(words, np.int64))
        for a in subjects:
            np.add.at(counts[:, index[a]], rows, 1 / len(subjects))
        holders[np.unique(rows)] += 1
    model = Model(names, at, counts, holders)
    by_doc = {d: [index[a] for a in ls] for d, _, _, ls in labelled}
    for _ in range(rounds):
        model = Model(names, *_expected_counts(encoded, model, by_doc))
    model = model.only_telling()
    return model, _calibrate(model, labelled)


def _expected_counts(encoded: DataFrame, model: Model, labelled: dict[int, list[int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One round over all documents: the slots, their soft counts by area, and the documents that hold them.

    Text about no area counts for all areas alike.
    """
    k, size = len(model.areas), len(LANGUAGES) * SLOTS
    shared = encoded.sparkSession.sparkContext.broadcast((model, labelled))

    def expect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by, known = shared.value
        sums, held = np.zeros((size, k)), np.zeros(size, np.int64)
        for batch in batches:
            ids = batch.column(0).to_pylist()
            words, starts, docs = _arrays(batch)
            if not len(words):
                continue
            prior = np.full((len(ids), k + 1), 1 / (k + 1))
            for i, d in enumerate(ids):
                if d in known:
                    prior[i] = 0.02
                    prior[i, known[d]] = 1 / len(known[d])
                    prior[i, k] = 0.3
            lik = by.likelihoods(words, starts)
            post, _ = by.posteriors(lik, docs, prior)
            each = post[:, :k] + post[:, k:] / k
            of = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
            there, place = np.unique(words, return_inverse=True)
            for j in range(k):
                sums[there, j] += np.bincount(place, each[of, j], len(there))
            of_doc = np.repeat(np.arange(len(ids)), np.diff(docs))[of]
            held[there] += np.bincount(np.unique(of_doc * len(there) + place) % len(there), minlength=len(there))
        at = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(held[at], pa.int64()), *(pa.array(sums[at, j], pa.float64()) for j in range(k))], names=["w", "n", *columns])

    columns = [f"c{j}" for j in range(k)]
    partial = encoded.mapInArrow(expect, ", ".join(["w int, n bigint", *(f"{c} double" for c in columns)]))
    rows = partial.groupBy("w").agg(*map(F.expr, ("sum(n) as n", *(f"sum({c}) as {c}" for c in columns)))).toArrow()
    shared.unpersist()
    order = np.argsort(rows.column("w").to_numpy())
    counts = np.array([rows.column(c).to_numpy()[order] for c in columns]).reshape(k, -1).T
    return rows.column("w").to_numpy()[order].astype(np.int64), counts, rows.column("n").to_numpy()[order]


@dataclass
class Calibration:
    """P(area | share) for each area by itself: a logistic curve with the area's own intercept."""

    intercepts: np.ndarray
    slope: float

    def posteriors(self, shares: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.intercepts + self.slope * np.minimum(shares, 0.5), -30, 30)))


def _held_out(doc_id: int) -> bool:
    return xxhash.xxh64_intdigest(str(doc_id)) % HELD_OUT == 0


def _known_shares(model: Model, labelled: list) -> tuple[np.ndarray, np.ndarray]:
    """Shares and labels of labelled documents."""
    lens = [n for _, _, ls, _ in labelled for n in ls]
    words = np.array([w for _, ws, _, _ in labelled for w in ws], np.int64)
    shares, _ = model.shares_encoded(words, np.cumsum([0, *lens]), np.cumsum([0, *(len(ls) for _, _, ls, _ in labelled)]))
    y = np.zeros_like(shares)
    for i, (_, _, _, ls) in enumerate(labelled):
        y[i, [model.areas.index(a) for a in ls]] = 1
    return shares, y


def _calibrate(model: Model, labelled: list) -> Calibration:
    """Curves fitted on labelled documents; calibration_report measures them on documents held out.

    Where the common curve crosses one half is the cut that agrees with most labels of the second areas,
    the middle of the best interval; wrong labels shift a plain logistic fit, but hardly this cut. The
    slope is fitted by Newton's method around it, then the intercept of each area, held near the common
    one by a prior of PRIOR documents.
    """
    k = len(model.areas)
    if not labelled:
        return Calibration(np.full(k, -5.0), 20.0)
    shares, y = _known_shares(model, labelled)
    cut = 1 / 3
    if shares.shape[1] > 1:
        order = np.argsort(-shares, axis=1, kind="stable")[:, 1]
        rows = np.arange(len(shares))
        cut = best_cut(shares[rows, order], y[rows, order])
    x = np.minimum(shares, 0.5) - cut
    slope = _newton(lambda v: v * x.ravel(), x.ravel(), y.ravel(), 16.0, 1e-3, 0.0)
    slope = float(min(max(slope, 5.0), 200.0))
    # The curves differ from the common one by an intercept each.
    own = np.array([_newton(lambda v, j=j: slope * x[:, j] + v, np.ones(len(x)), y[:, j], 0.0, PRIOR, 0.0) for j in range(k)])
    return Calibration(own - slope * cut, slope)


def _newton(logit, slope_of, t: np.ndarray, start: float, precision: float, centre: float) -> float:
    """The value of one parameter that fits labels t best under a normal prior; slope_of is the logit's derivative."""
    v = start
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(logit(v), -30, 30)))
        step = ((t - p) @ slope_of - precision * (v - centre)) / ((p * (1 - p)) @ (slope_of * slope_of) + precision)
        v += float(np.clip(step, -5, 5))
        if abs(step) < 1e-8:
            break
    return v


def best_cut(share: np.ndarray, label: np.ndarray, low: float = 0.1, high: float = 0.4) -> float:
    """The middle of the longest stretch of cuts in [low, high] at which nearly as many labels agree with share >= cut as at the best."""
    edges = np.unique(np.concatenate([[low], share[(share > low) & (share < high)], [high]]))
    if len(edges) < 2 or not label.any():
        return 1 / 3
    middles = (edges[1:] + edges[:-1]) / 2
    wrong = np.array([np.sum((share >= c) != (label > 0)) for c in middles])
    good = wrong <= wrong.min() + max(1, len(share) // 500)
    # The longest stretch of good cuts; one more wrong label than at the best cut is within the noise.
    longest, cut, start = 0.0, float(middles[wrong.argmin()]), None
    for i in range(len(good) + 1):
        if i < len(good) and good[i]:
            start = i if start is None else start
        elif start is not None:
            if edges[i] - edges[start] > longest:
                longest, cut = edges[i] - edges[start], float((edges[i] + edges[start]) / 2)
            start = None
    return cut


def classify(encoded: DataFrame, model: Model, calibration: Calibration, most: int = 2) -> DataFrame:
    """Areas of every document of encode_table: doc_id, subject, share, posterior, rank (1 is the main area).

    A document gets the areas of calibrated posterior 0.5 or more, at most `most` of them (the task has
    one or two to a document), and at least its main area. Texts without a known word, empty and NULL
    texts get the area with the largest share in the mixture, which for no evidence is the first by name.
    """
    shared = encoded.sparkSession.sparkContext.broadcast((model, calibration))

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by, curves = shared.value
        for batch in batches:
            ids = batch.column(0).to_pylist()
            shares, mix = by.shares_encoded(*_arrays(batch))
            order = np.argsort(-(shares + mix * 1e-6), axis=1, kind="stable")
            posteriors = curves.posteriors(shares)
            out: list[tuple] = []
            for i, d in enumerate(ids):
                for rank, j in enumerate(order[i, :most]):
                    if rank == 0 or (posteriors[i, j] >= 0.5 and shares[i, j] > 0):
                        out.append((d, by.areas[j], float(shares[i, j]), float(posteriors[i, j]), rank + 1))
            columns = list(zip(*out)) if out else [[]] * 5
            types = (pa.int64(), pa.string(), pa.float64(), pa.float64(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=["doc_id", "subject", "share", "posterior", "rank"])

    return encoded.mapInArrow(label, "doc_id bigint, subject string, share double, posterior double, rank int")


def subject_areas(documents: DataFrame, labels: DataFrame, areas: DataFrame) -> DataFrame:
    """Trains on all documents and labels and classifies all documents. An empty table of areas gives no rows."""
    documents, labels, areas = unambiguous(documents), unambiguous(labels), unambiguous(areas)
    if not area_names(areas):
        return documents.sparkSession.createDataFrame([], "doc_id bigint, subject string, share double, posterior double, rank int")
    encoded = durable(encode_table(documents))
    return classify(encoded, *train(encoded, labels, areas))


def calibration_report(documents: DataFrame, labels: DataFrame, areas: DataFrame) -> DataFrame:
    """Per area: subject, n_held_out, mean_posterior, label_share and gap, on one labelled document of HELD_OUT
    that neither the training nor the curves have seen."""
    documents, labels, areas = unambiguous(documents), unambiguous(labels), unambiguous(areas)
    names, rows = area_names(areas), []
    if names:
        encoded = durable(encode_table(documents))
        labelled = _labelled(encoded, labels, names)
        held = [x for x in labelled if _held_out(x[0])]
        if held:
            model, calibration = _train(encoded, [x for x in labelled if not _held_out(x[0])], names, ROUNDS)
            shares, y = _known_shares(model, held)
            p = calibration.posteriors(shares)
            rows = [(a, len(held), float(p[:, j].mean()), float(y[:, j].mean())) for j, a in enumerate(names)]
    return documents.sparkSession.createDataFrame([(*r, abs(r[2] - r[3])) for r in rows], "subject string, n_held_out long, mean_posterior double, label_share double, gap double")
