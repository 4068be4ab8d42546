"""History of changing entity attributes from presence bitmaps.

Every snapshot of an entity has a position 0, 1, 2, ... along time. For each entity and attribute
value one bit is set per snapshot in which the entity had the value; a version is a run of
consecutive bits. Bitmaps are cut into words of 32 positions, so that the unit of work is
(entity, word, value): one entity may hold any share of all rows and is still spread evenly.
Positions are found without sorting an entity in one task: rows are ranked within (entity, hour)
and shifted by the running count of the entity's earlier hours.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tarnlight.runtime import durable, unambiguous

WORD = 32
#: Versions of one entity are linked to their successors in groups of so many positions.
SPAN = 1 << 16


def snapshots(df: DataFrame, entity: Column, ts: str, values: dict[str, Column], row_id: str, received: str) -> DataFrame:
    """One row per entity and time with its position: columns _e, _t, _id, _pos and v_<name> per value.

    Rows with a NULL entity, time or value are left out. Of several rows with the same entity and
    time, the one received last counts (NULL first, ties: the larger id, then the larger values).
    """
    named = {f"v_{k}": c for k, c in values.items()}
    rows = unambiguous(df).select(
        entity.alias("_e"), F.col(ts).alias("_t"), F.col(row_id).alias("_id"), F.col(received).alias("_r"),
        *[c.alias(k) for k, c in named.items()],
    ).dropna(subset=["_e", "_t", *named])
    last = rows.groupBy("_e", "_t").agg(
        F.max(F.struct(F.col("_r"), F.col("_id"), *[F.col(k) for k in named])).alias("m")
    )
    # Written once: ranks and counts per hour both need the rows that count.
    rows = durable(last.select(
        "_e", "_t", F.col("m._id").alias("_id"), *[F.col(f"m.{k}").alias(k) for k in named],
        F.expr("timestampdiff(HOUR, TIMESTAMP_NTZ'1970-01-01 00:00:00', cast(_t as timestamp_ntz))").alias("_h"),
    ))
    before = W.partitionBy("_e").orderBy("_h").rowsBetween(W.unboundedPreceding, -1)
    hours = rows.groupBy("_e", "_h").agg(F.count("*").alias("n")).select(
        "_e", "_h", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_base")
    )
    rank = F.row_number().over(W.partitionBy("_e", "_h").orderBy("_t")) - 1
    return rows.withColumn("_rank", rank).join(hours, ["_e", "_h"]).select(
        "_e", "_t", "_id", (F.col("_base") + F.col("_rank")).alias("_pos"), *named
    )


def bitmaps(snaps: DataFrame, names: Sequence[str]) -> DataFrame:
    """One row per entity, word and value: the bitmap (_bits), its members (bit, time, id), and whether
    the last bit of the word before is set (_carry).

    The last position of a word also counts, as bit -1, in the next word: so runs go on from word to
    word without a join of the bitmaps with themselves.
    """
    keys = [f"v_{n}" for n in names]
    word, bit = F.floor(F.col("_pos") / WORD), (F.col("_pos") % WORD).cast("int")
    places = F.when(bit == WORD - 1, F.array(F.struct(word.alias("w"), bit.alias("b")), F.struct((word + 1).alias("w"), F.lit(-1).alias("b")))).otherwise(F.array(F.struct(word.alias("w"), bit.alias("b"))))
    each = snaps.withColumn("_p", F.explode(places)).select("_e", "_t", "_id", *keys, F.col("_p.w").alias("_w"), F.col("_p.b").alias("_b"))
    return each.groupBy("_e", "_w", *keys).agg(
        F.expr("bit_or(case when _b >= 0 then shiftleft(1L, _b) else 0L end)").alias("_bits"),
        F.collect_list(F.when(F.col("_b") >= 0, F.struct("_b", "_t", "_id"))).alias("_members"),
        F.max(F.when(F.col("_b") < 0, 1).otherwise(0)).cast("long").alias("_carry"),
    )


def version_starts(snaps: DataFrame, names: Sequence[str]) -> DataFrame:
    """The first snapshot of every run of bits: _e, _pos, _t, _id and the values."""
    keys = [f"v_{n}" for n in names]
    words = bitmaps(snaps, names)
    runs = words.withColumn("_starts", F.expr("_bits & ~(shiftleft(_bits, 1) | _carry)")).filter("_starts <> 0")
    first = F.expr("filter(_members, m -> (_starts & shiftleft(1L, m._b)) <> 0)")
    return runs.select("_e", "_w", *keys, F.explode(first).alias("m")).select(
        "_e", (F.col("_w") * WORD + F.col("m._b")).alias("_pos"), F.col("m._t").alias("_t"), F.col("m._id").alias("_id"), *keys
    )


def versions(df: DataFrame, entity: Column, ts: str, values: dict[str, Column], row_id: str, received: str) -> DataFrame:
    """Full history: entity, row id, values, valid_from, valid_to (exclusive, NULL for the current state), is_current.

    An empty table gives an empty history. Further columns of df, whatever their names, are ignored.
    """
    names = list(values)
    starts = version_starts(snapshots(df, entity, ts, values, row_id, received), names)
    starts = starts.withColumn("_c", F.floor(F.col("_pos") / SPAN))
    inner = F.lead("_t").over(W.partitionBy("_e", "_c").orderBy("_pos"))
    later = W.partitionBy("_e").orderBy("_c")
    spans = starts.groupBy("_e", "_c").agg(F.min("_t").alias("_first")).select(
        "_e", "_c", F.lead("_first").over(later).alias("_beyond")
    )
    ended = starts.withColumn("_inner", inner).join(spans, ["_e", "_c"])
    until = F.coalesce("_inner", "_beyond")
    return ended.select(
        F.col("_e").alias("entity"), F.col("_id").alias("id"),
        *[F.col(f"v_{n}").alias(n) for n in names],
        F.col("_t").alias("valid_from"), until.alias("valid_to"), until.isNull().alias("is_current"),
    )


def state_at(history: DataFrame, when: Column) -> DataFrame:
    """The state of every entity at a point in time."""
    return history.filter((F.col("valid_from") <= when) & (F.col("valid_to").isNull() | (F.col("valid_to") > when)))
