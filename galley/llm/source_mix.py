"""Mixing sources to target weights by Sainte-Lague apportionment of equal blocks of words.

Targets: sources in order take the weights in turn and share a multiple of all words. A source whose
share is above its limit stops there and the excess is shared again, until none is above.

Quotas: blocks of `BLOCK` words go to the sources below their limit one by one, each to the
source with the highest quotient weight / (2 k - 1) for its k-th block. A source is dealt by a seeded
hash of doc_id into shards of about `SHARD` words, and its blocks go to the shards by the same rule, in
proportion to their words. A limited source takes all its blocks twice. What then lies between the
blocks of a source and its target, as a rule less than a block, is added to or taken from its
first shards, so each source ends at its target rounded to whole words.

Selection: the documents of a shard, in seeded order, form one run of words cut into blocks. A quota takes
whole passes over the run first and the rest from blocks in seeded order, the last one in part; a
document gets the words of its blocks that were taken. So none exceeds the limit times its size.

Highest quotients are found without dealing seats one at a time: from the ideal share, all but about one
seat a party are certain, and only the uncertain ones are ranked. All groups are shards, so a hot source
is spread like the others; no source table goes to the driver, only its sums do.

Edge cases: a null text has size 0; documents of size 0 take 0; a null source is the last one. Repeated and null doc_ids are
documents of their own. Only doc_id, text and source are read. No words at all give targets of 0.
Empty tables give no rows. Equal quotients go to the earlier source, then to the lower shard. Sizes beyond 2^53 words in all are not exact.
"""

from __future__ import annotations

from collections.abc import Sequence
from fractions import Fraction

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from galley.llm.common import prepare, stored
from galley.operators.ordered import line_block, range_numbered, running_total

WEIGHTS, SHARE, LIMIT = (3, 1, 2), Fraction(3, 2), 2
BLOCK, SHARD, SEED = 256, 1 << 17, "12"

_WORDS = r"[\x20\x09-\x0D]*+[^\x20\x09-\x0D]++"


def word_count(text: Column) -> Column:
    """Runs of characters other than the space and 0x09-0x0D; null counts as empty."""
    marks = F.regexp_replace(F.coalesce(text, F.lit("")), _WORDS, "w")
    return F.length(F.translate(marks, " \t\n\x0b\f\r", "")).cast("long")


def _digest(*parts: Column) -> Column:
    return F.md5(F.concat_ws(":", F.lit(SEED), *[p.cast("string") for p in parts]))


def water_level(sources: DataFrame, share: Fraction, limit: int) -> Fraction | None:
    """Words per weight at which the shares, each stopped at its limit, use the whole budget; None if all stop."""
    total, weight = sources.agg(F.sum("source_size"), F.sum("weight")).first()
    budget, level = share * (total or 0), None
    fresh = budget / weight if weight else None
    while fresh is not None and fresh != level:
        level = fresh
        above = _above(level, limit)
        full, weight = sources.agg(
            F.coalesce(F.sum(F.when(above, F.col("source_size") * limit)), F.lit(0)),
            F.coalesce(F.sum(F.when(~above, F.col("weight"))), F.lit(0)),
        ).first()
        fresh = (budget - full) / weight if weight else None
    return fresh


def _above(level: Fraction, limit: int) -> Column:
    wide = "decimal(19,0)"
    share = F.col("weight").cast(wide) * F.lit(level.numerator).cast(wide)
    return share > F.col("source_size").cast(wide) * F.lit(limit * level.denominator).cast(wide)


def apportion(parties: DataFrame, group: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Adds `quota`: the seats of each party by highest quotients weight / (2 k - 1), at most `seat_limit`.

    The columns `seats`, `n_parties` and `all_weights` belong to the group. Seats that no limit leaves room for stay free.
    """
    level = F.col("seats") / F.col("all_weights")
    step = (F.col("n_parties") / 2 + 1) / F.col("all_weights")

    def reached(at: Column) -> Column:
        return F.least("seat_limit", F.greatest(F.lit(0), F.floor(F.col("weight") * at + 0.5))).cast("long")

    wide = 1
    while True:
        known = parties.withColumn("_sure", reached(level - step)).withColumn("_most", reached(level + step * wide))
        groups = known.groupBy(*group).agg(
            F.first("seats").alias("_seats"),
            F.sum("_sure").alias("_given"),
            F.sum("_most").alias("_reach"),
            F.sum("seat_limit").alias("_room"),
        )
        # Blocks that a limit refuses go on to higher quotients: look further until they are placed.
        if groups.where("_reach < least(_seats, _room)").isEmpty():
            break
        wide *= 2
    unsure = known.where("_most > _sure")
    open_seats = unsure.select(*group, *order, "weight", F.explode(F.expr("sequence(_sure + 1, _most)")).alias("_k"))
    open_seats = open_seats.withColumn("_turn", (2 * F.col("_k") - 1) / F.col("weight"))
    ranked = range_numbered(open_seats, group, ["_turn", *order, "_k"], "_nth")
    left = groups.select(*group, (F.col("_seats") - F.col("_given")).alias("_left"))
    won = ranked.join(left, list(group)).where("_nth <= _left").groupBy(*group, *order).agg(F.count(F.lit(1)).alias("_won"))
    return (
        known.join(won, [*group, *order], "left")
        .withColumn("quota", F.col("_sure") + F.coalesce("_won", F.lit(0)))
        .drop("_sure", "_most", "_won")
    )


def mixed(
    docs: DataFrame, weights: Sequence[int] = WEIGHTS, share: Fraction = SHARE, limit: int = LIMIT, block: int = BLOCK, shard: int = SHARD
) -> DataFrame:
    """(doc_id, size, source_size, target, taken) of every document."""
    spark = prepare(docs.sparkSession)
    sized = stored(docs.select("doc_id", F.col("source").cast("string").alias("source"), word_count(F.col("text")).alias("size")), "sizes")
    sources = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    sources = range_numbered(sources, [], [F.asc_nulls_last("source")], "place")
    turn = F.pmod(F.col("place") - 1, F.lit(len(weights))).cast("int") + 1
    sources = stored(sources.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), turn).cast("long")), "sources")

    level = water_level(sources, share, limit)
    stop = F.col("source_size") * limit
    full = F.lit(True) if level is None else _above(level, limit)
    part = F.lit(0.0) if level is None else F.col("weight") * F.lit(float(level.numerator)) / F.lit(float(level.denominator))
    sources = sources.withColumn("full", full).withColumn("target", F.when(F.col("full"), stop.cast("double")).otherwise(part))
    sources = sources.withColumn("words", F.least(stop, F.floor(F.col("target") + 0.5)))
    # Blocks of the sources: those below their limit contend, the others take all they have.
    sources = sources.withColumn("seat_limit", F.floor(stop / block)).withColumn("shards", F.ceil(F.col("source_size") / shard))
    sources = stored(sources.withColumn("full", F.col("full") | (F.col("source_size") == 0)), "targets")
    contend = sources.where("not full")
    words, n, total = contend.agg(F.coalesce(F.sum("words"), F.lit(0)), F.count(F.lit(1)), F.sum("weight")).first()
    contend = (
        contend.select(F.lit(0).alias("mix"), "place", "weight", "seat_limit")
        .withColumn("seats", F.lit((words + block // 2) // block).cast("long"))
        .withColumn("n_parties", F.lit(n).cast("long"))
        .withColumn("all_weights", F.lit(total).cast("long"))
    )
    blocks = apportion(contend, ["mix"], ["place"]).select("place", F.col("quota").alias("blocks"))
    sources = sources.join(blocks, "place", "left").withColumn("blocks", F.coalesce("blocks", F.when(F.col("full"), F.col("seat_limit"))))
    sources = stored(sources, "source-blocks")

    # Blocks of the shards of each source.
    named = sized.alias("d").join(sources.alias("s"), F.col("d.source").eqNullSafe(F.col("s.source")))
    named = named.select("doc_id", "size", "source_size", "target", "place", "shards")
    empty = named.where("size = 0").select("doc_id", "size", "source_size", "target", F.lit(0).cast("long").alias("taken"))
    named = named.where("size > 0").withColumn("turn", _digest(F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))))
    number = F.conv(F.substring("turn", 1, 8), 16, 10).cast("long")
    named = named.withColumn("shard", F.pmod(number, F.col("shards")))
    shards = stored(named.groupBy("place", "shard").agg(F.sum("size").alias("weight")), "shards")
    known = shards.groupBy("place").agg(F.count(F.lit(1)).alias("n_parties"))
    dealt = shards.join(known, "place").join(sources.select("place", "blocks", "words", "source_size"), "place")
    dealt = dealt.withColumn("seat_limit", F.floor(F.col("weight") * limit / block)).withColumnsRenamed({"blocks": "seats", "source_size": "all_weights"})
    dealt = stored(apportion(dealt, ["place"], ["shard"]).withColumn("held", F.col("quota") * block), "shard-blocks")

    # What is left between blocks and words, in shard order.
    rest = dealt.groupBy("place").agg((F.first("words") - F.sum("held")).alias("rest"))
    dealt = dealt.join(rest, "place").withColumn("room", F.when(F.col("rest") > 0, F.col("weight") * limit - F.col("held")).otherwise(F.col("held")))
    dealt = running_total(dealt, ["place"], ["shard"], F.col("room"), "upto", line_block("shard"))
    change = F.greatest(F.lit(0), F.least("room", F.abs("rest") - (F.col("upto") - F.col("room"))))
    dealt = dealt.withColumn("quota", F.col("held") + change * F.signum("rest").cast("long"))
    dealt = dealt.select("place", "shard", F.expr("quota div weight").alias("passes"), F.expr("quota % weight").alias("some"))

    # Words of the documents: positions in the shard, blocks, and the blocks taken in part.
    run = Window.partitionBy("place", "shard").orderBy("turn", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    placed = named.join(dealt, ["place", "shard"]).withColumn("end", F.sum("size").over(run)).withColumn("start", F.expr("end - size"))
    cut = placed.withColumn("block", F.explode(F.sequence(F.floor(F.col("start") / block), F.floor((F.col("end") - 1) / block))))
    cut = cut.withColumn("piece", F.least("end", (F.col("block") + 1) * block) - F.greatest("start", F.col("block") * block))
    chosen = Window.partitionBy("place", "shard").orderBy(_digest(F.col("place"), F.col("shard"), F.col("block")), "block", "start")
    cut = cut.withColumn("before", F.sum("piece").over(chosen.rowsBetween(Window.unboundedPreceding, 0)) - F.col("piece"))
    some = F.greatest(F.lit(0), F.least("piece", F.col("some") - F.col("before")))
    taken = cut.groupBy("place", "shard", "start", "doc_id", "size", "source_size", "target").agg(
        F.sum(F.col("piece") * F.col("passes") + some).alias("taken")
    )
    return taken.select("doc_id", "size", "source_size", "target", "taken").unionByName(empty)


def op12_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixed(prepare(spark).read.parquet(f"{sf_dir}/documents.parquet"))


OP12_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, len(list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')) AS size FROM documents
), src AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS place FROM sized GROUP BY source
), weighed AS (SELECT *, [3, 1, 2][(place - 1) % 3 + 1] AS weight FROM src),
sums AS (SELECT sum(source_size) AS t, sum(weight) AS w FROM weighed),
steps AS (
  SELECT 0 AS m, 3 * t AS num, 2 * w AS den, (SELECT min(2.0 * source_size / weight) FROM weighed) AS next FROM sums
  UNION ALL
  SELECT m, 3 * t - 2 * c, 2 * (w - v), next FROM (
    SELECT row_number() OVER o AS m, sum(2 * source_size) OVER o AS c, sum(weight) OVER o AS v, lead(2.0 * source_size / weight) OVER o AS next
    FROM weighed WINDOW o AS (ORDER BY 2.0 * source_size / weight, place ROWS UNBOUNDED PRECEDING)), sums
), level AS (SELECT num, den FROM steps WHERE den > 0 AND num <= next * den ORDER BY m LIMIT 1),
targets AS (
  SELECT *, weight * num > 2 * source_size * den OR source_size = 0 AS at_limit,
    CASE WHEN weight * num > 2 * source_size * den THEN CAST(2 * source_size AS DOUBLE) ELSE CAST(weight * num AS DOUBLE) / CAST(den AS DOUBLE) END AS target
  FROM weighed, level
), words AS (SELECT *, least(2 * source_size, CAST(floor(target + 0.5) AS BIGINT)) AS words FROM targets),
seats AS (SELECT place, weight, unnest(range(1, 2 * source_size // 256 + 1)) AS k FROM words WHERE NOT at_limit),
won AS (
  SELECT place, count(*) AS blocks FROM (
    SELECT place, row_number() OVER (ORDER BY (2.0 * k - 1) / weight, place, k) AS nth FROM seats
  ) WHERE nth <= (SELECT (sum(words) + 128) // 256 FROM words WHERE NOT at_limit) GROUP BY place
), src2 AS (
  SELECT w.*, CASE WHEN at_limit THEN 2 * source_size // 256 ELSE coalesce(blocks, 0) END AS blocks,
    CAST(ceil(source_size / 131072.0) AS BIGINT) AS shards
  FROM words w LEFT JOIN won USING (place)
), named AS (
  SELECT doc_id, size, source_size, target, place, md5('12:' || coalesce(CAST(doc_id AS VARCHAR), 'null')) AS turn, shards
  FROM sized d JOIN src2 s ON d.source IS NOT DISTINCT FROM s.source
), dealt AS (SELECT *, CAST('0x' || substr(turn, 1, 8) AS BIGINT) % shards AS shard FROM named WHERE size > 0),
shard AS (SELECT place, shard, CAST(sum(size) AS BIGINT) AS n FROM dealt GROUP BY ALL),
seats2 AS (SELECT place, shard, n, unnest(range(1, 2 * n // 256 + 1)) AS k FROM shard),
won2 AS (
  SELECT place, shard, count(*) AS q FROM (
    SELECT place, shard, row_number() OVER (PARTITION BY place ORDER BY (2.0 * k - 1) / n, shard, k) AS nth FROM seats2
  ) JOIN src2 USING (place) WHERE nth <= blocks GROUP BY ALL
), held AS (
  SELECT place, shard, n, coalesce(q, 0) * 256 AS held, words - sum(coalesce(q, 0) * 256) OVER (PARTITION BY place) AS rest
  FROM shard LEFT JOIN won2 USING (place, shard) JOIN src2 USING (place)
), room AS (SELECT *, CASE WHEN rest > 0 THEN 2 * n - held ELSE held END AS room FROM held),
quota AS (
  SELECT place, shard, n, held + sign(rest) * greatest(0, least(room, abs(rest) - (sum(room) OVER (PARTITION BY place ORDER BY shard) - room))) AS quota
  FROM room
), placed AS (
  SELECT d.*, CAST(quota AS BIGINT) // n AS passes, CAST(quota AS BIGINT) % n AS part,
    CAST(sum(size) OVER (PARTITION BY place, shard ORDER BY turn, doc_id, size ROWS UNBOUNDED PRECEDING) AS BIGINT) AS stop
  FROM dealt d JOIN quota USING (place, shard)
), cut AS (SELECT *, stop - size AS start, unnest(range((stop - size) // 256, (stop - 1) // 256 + 1)) AS block FROM placed),
pieces AS (SELECT *, least(stop, (block + 1) * 256) - greatest(start, block * 256) AS piece FROM cut),
chosen AS (
  SELECT *, sum(piece) OVER (PARTITION BY place, shard
    ORDER BY md5('12:' || place || ':' || shard || ':' || block), block, start ROWS UNBOUNDED PRECEDING) - piece AS before FROM pieces
)
SELECT doc_id, size, source_size, target, CAST(sum(piece * passes + greatest(0, least(piece, part - before))) AS BIGINT) AS taken
FROM chosen GROUP BY place, shard, start, doc_id, size, source_size, target
UNION ALL SELECT doc_id, size, source_size, target, 0 FROM named WHERE size = 0
"""
