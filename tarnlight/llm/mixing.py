"""Mixing sources to target weights.

Documents are counted in tokens of a public tokenizer. Iterative proportional fitting rakes the
token weights of the cells (source, language, topic) to the target shares of the sources and to the
corpus's own shares of languages and topics. A cell's weight is the expected number of copies of
its documents; whole copies are certain, the rest is drawn by a hash of the id, calibrated per
source so that the drawn tokens meet the target. No document is used more often than its source
allows.
"""

from __future__ import annotations

import base64
import os
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from tarnlight.runtime import broadcast_if_small, durable, spread, unambiguous

#: File of merge ranks of the tokenizer.
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the pre-tokenisation pattern of that tokenizer.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
BINS = 4000
#: Rows of the targets.
MAX_TARGETS = 10_000


def count_tokens(documents: DataFrame, text: str = "text", ranks_file: str = TOKENIZER, name: str = "n_tokens") -> DataFrame:
    """documents with the number of tokens of text; NULL and empty texts have 0.

    The text itself is not sent back: only the columns other than text and the count are returned.
    """
    keep = [c for c in documents.columns if c != text]
    schema = documents.select(*keep).schema.add(name, LongType())

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import tiktoken

        with open(ranks_file, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        encode = tiktoken.Encoding(os.path.basename(ranks_file), pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        for batch in batches:
            counts = [len(encode(t)) if t else 0 for t in batch.column(0).to_pylist()]
            arrays = [batch.column(i) for i in range(1, batch.num_columns)]
            yield pa.RecordBatch.from_arrays([*arrays, pa.array(counts, pa.int64())], names=[*keep, name])

    return spread(documents.select(text, *keep)).mapInArrow(count, schema)


def canonical_source(source: Column) -> Column:
    """A source trimmed of its spelling differences: lower case, words joined by one underscore."""
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(source)), r"[\s\-_]+", "_"), "^_+|_+$", "")


def canonical_language(lang: Column) -> Column:
    """The first two letters of a language code, "und" where there is none."""
    code = F.regexp_extract(F.lower(F.trim(lang)), "^([a-z]{2})", 1)
    return F.when(F.coalesce(code, F.lit("")) == "", F.lit("und")).otherwise(code)


def feasible_total(tokens: dict[str, int], targets: dict[str, tuple[float, int]]) -> tuple[float, dict[str, float]]:
    """The largest total at which every source that has documents reaches its share, and the shares:
    those of the sources without documents go to the others in proportion."""
    there = {s: t for s, (t, _) in targets.items() if tokens.get(s, 0) > 0 and t > 0}
    if not there:
        return 0.0, {}
    whole = sum(there.values())
    shares = {s: t / whole for s, t in there.items()}
    return min(tokens[s] * targets[s][1] / share for s, share in shares.items()), shares


def rake(cells: dict[tuple[str, str, str], float], total: float, shares: dict[str, float], repeats: dict[str, int], rounds: int = 200) -> dict[tuple, float]:
    """Weights (copies) of the cells after iterative proportional fitting.

    Languages and topics are raked to their shares in the cells; sources come last in each round and
    bind exactly, and no weight exceeds the source's repeats: what a capped cell cannot take, the
    other cells of its source do.
    """
    use = {c: n for c, n in cells.items() if c[0] in shares and n > 0}
    weight = {c: 1.0 for c in use}
    everything = sum(use.values())
    goals = [defaultdict(float), defaultdict(float)]
    for c, n in use.items():
        for i in (0, 1):
            goals[i][c[i + 1]] += n / everything * total
    of_source: dict[str, list] = defaultdict(list)
    for c in use:
        of_source[c[0]].append(c)
    for _ in range(rounds):
        before = dict(weight)
        for i in (0, 1):
            now: dict[str, float] = defaultdict(float)
            for c, n in use.items():
                now[c[i + 1]] += n * weight[c]
            for c in use:
                if now[c[i + 1]] > 0:
                    weight[c] *= goals[i][c[i + 1]] / now[c[i + 1]]
        for source, share in shares.items():
            own = of_source[source]
            cap, want = float(repeats[source]), share * total
            free = set(own)
            for _ in range(len(own) + 1):
                held = sum(use[c] * cap for c in own if c not in free)
                now_ = sum(use[c] * weight[c] for c in free)
                if not free or now_ <= 0:
                    break
                factor = (want - held) / now_
                over = {c for c in free if weight[c] * factor > cap}
                if not over:
                    for c in free:
                        weight[c] *= factor
                    break
                for c in over:
                    weight[c] = cap
                free -= over
        if max((abs(weight[c] - before[c]) for c in use), default=0) < 1e-9:
            break
    return weight


def mix(documents: DataFrame, targets: DataFrame, topics: DataFrame | None = None, total_tokens: float | None = None, ranks_file: str = TOKENIZER, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """(sample, report): doc_id, source, n_tokens, copies of the used documents; and per source target and actual shares.

    documents: doc_id, text, lang, source; targets: source, target_share, max_repeats; topics
    (doc_id, subject) may be left out. Documents of a source without target, a NULL source, or
    without tokens are not used. Repeated document ids count as documents of their own. Targets are
    at most MAX_TARGETS rows, else an error; the cells (source, language, topic) are summed before they reach
    the driver.
    """
    wanted_rows = unambiguous(targets).select(canonical_source(F.col("source")).alias("s"), F.col("target_share").alias("t"), F.coalesce("max_repeats", F.lit(1)).alias("m")).dropna().limit(MAX_TARGETS + 1).collect()
    if len(wanted_rows) > MAX_TARGETS:
        raise ValueError("more targets than MAX_TARGETS")
    goals = {r.s: (float(r.t), int(r.m)) for r in wanted_rows}
    base = unambiguous(documents).select(F.col("doc_id").cast("long").alias("doc_id"), "text", canonical_source(F.col("source")).alias("source"), canonical_language(F.col("lang")).alias("lang"))
    counted = count_tokens(base, ranks_file=ranks_file)
    if topics is not None:
        main = topics.groupBy("doc_id").agg(F.min("subject").alias("topic"))
        counted = counted.join(main, "doc_id", "left")
    else:
        counted = counted.withColumn("topic", F.lit(None).cast("string"))
    counted = counted.withColumn("topic", F.coalesce("topic", F.lit("none"))).withColumn("source", F.coalesce("source", F.lit("")))
    counted = durable(counted)
    summed = counted.groupBy("source", "lang", "topic").agg(F.sum("n_tokens").alias("tokens")).collect()
    cells = {(r.source, r.lang, r.topic): float(r.tokens) for r in summed}
    by_source: dict[str, int] = defaultdict(int)
    for (s, _, _), n in cells.items():
        by_source[s] += int(n)
    largest, shares = feasible_total(by_source, goals)
    total = min(largest, total_tokens) if total_tokens else largest
    weights = rake(cells, total, shares, {s: m for s, (_, m) in goals.items()})
    spark = documents.sparkSession
    table = spark.createDataFrame([(*c, float(w)) for c, w in sorted(weights.items())] or [("", "", "", 0.0)], "source string, lang string, topic string, weight double")
    drawn = counted.filter("n_tokens > 0").join(broadcast_if_small(table), ["source", "lang", "topic"])
    unit = (F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1 << 40)) + 0.5) / float(1 << 40)
    sure = F.floor(F.col("weight") + 1e-9)
    drawn = drawn.withColumn("whole", sure).withColumn("part", F.greatest(F.col("weight") - sure, F.lit(0.0))).withColumn("draw", F.try_divide(unit, F.col("part")))
    # The cut of the draws is 1 in expectation; per source it is moved to where the tokens meet the target.
    bins = drawn.groupBy("source", F.least(F.floor(F.when(F.col("part") > 1e-12, F.col("draw") * (BINS / 4)).otherwise(F.lit(BINS))), F.lit(BINS)).alias("b")).agg(
        F.sum("n_tokens").alias("tokens"), F.sum(F.col("whole") * F.col("n_tokens")).alias("sure")
    ).collect()
    cuts = []
    for source, share in shares.items():
        own = sorted((r.b, r.tokens) for r in bins if r.source == source)
        have, want, cut = sum(r.sure for r in bins if r.source == source), share * total, 0.0
        for b, n in own:
            if b >= BINS or have + n / 2 > want:
                break
            have += n
            cut = (b + 1) / (BINS / 4)
        cuts.append((source, float(cut)))
    limits = spark.createDataFrame(cuts or [("", 0.0)], "source string, cut double")
    copies = F.col("whole") + F.when((F.col("part") > 1e-12) & (F.col("draw") < F.col("cut")), 1).otherwise(0)
    sample = drawn.join(broadcast_if_small(limits), "source").withColumn("copies", copies.cast("long")).filter("copies > 0").select("doc_id", "source", "lang", "topic", "n_tokens", "copies")
    used = sample.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("copies")).alias("mixed_tokens"), F.count("*").alias("n_used"), F.max("copies").alias("most_copies"))
    available = counted.groupBy("source").agg(F.count("*").alias("n_documents"), F.sum("n_tokens").alias("source_tokens"))
    wanted = spark.createDataFrame([(s, t, m, float(shares.get(s, 0.0))) for s, (t, m) in sorted(goals.items())] or [("", 0.0, 0, 0.0)], "source string, target_share double, max_repeats bigint, reachable_share double")
    all_ = wanted.join(available, "source", "left").join(used, "source", "left")
    # The report has one row per target.
    report = all_.withColumn("grand", F.sum("mixed_tokens").over(Window.partitionBy(F.lit(1)))).select(
        "source", "target_share", "reachable_share", "max_repeats", F.coalesce("n_documents", F.lit(0)).alias("n_documents"), F.coalesce("source_tokens", F.lit(0)).alias("source_tokens"),
        F.coalesce("n_used", F.lit(0)).alias("n_used"), F.coalesce("mixed_tokens", F.lit(0)).alias("mixed_tokens"), F.coalesce("most_copies", F.lit(0)).alias("most_copies"),
        F.coalesce(F.try_divide("mixed_tokens", "grand"), F.lit(0.0)).alias("actual_share"),
    ).withColumn("gap", F.abs(F.col("actual_share") - F.col("reachable_share")))
    return sample, report
