"""Mixing sources to target weights by Pfair scheduling, in DataFrame operations only.

A source's documents are cut into blocks of about ``block_chars`` characters: equal slices of the ids' hash space,
so that a document finds its block without a shuffle. Weights are whole shares of a period. The k-th block
of a source with share a of the period D is released at slot floor(k D / a) and due at ceil((k + 1) D / a); in each
slot the released block with the earliest deadline goes next. Shares add up to D, so every deadline is met, and
after any number of slots every source is less than one block from its share.

The period is as long as the mix, so that shares are the targets to one block over the whole mix; a mix of more than
``most_slots`` slots repeats a period of about that length, and a share is then off its target by 1 / D at most (a
source below that gets one slot a period). One period is computed by a fold over D steps, and a block's slot follows from its number.

No document is left out: the mix ends when every source has been read once, and sources that run out before that start
over as often as their weight asks, unless ``max_epochs`` limits it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wardline.storage import materialise

BLOCK_CHARS, POWER, MAX_SOURCES = 16_384, 0.9, 5000
MOST_SLOTS, MOST_STEPS = 100_000, 20_000_000  # of a period; slots times sources
_HASHES = 1 << 32


def _size() -> Column:
    return F.length(F.coalesce("text", F.lit(""))).cast("long")


def source_shares(docs: DataFrame, weights: dict[str, float] | None = None, block_chars: int = BLOCK_CHARS, most_slots: int = MOST_SLOTS, power: float = POWER) -> DataFrame:
    """One row a source: (i, source, chars, blocks, target, share).

    Targets are ``weights`` where they name the source, else the source's characters to ``power`` (each part
    normalised on its own scale: given weights are fractions of the whole, the rest is shared by the others). At
    most MAX_SOURCES sources: more raise an error.
    """
    s = materialise(docs.groupBy("source").agg(F.sum(_size()).alias("chars")), "mix-sources")
    n = s.count()
    if n > MAX_SOURCES:
        raise ValueError(f"{n} sources, more than {MAX_SOURCES}")
    given = F.coalesce(*[F.when(F.col("source") == k, F.lit(float(v))) for k, v in (weights or {}).items()], F.lit(None).cast("double"))
    s = s.select("source", "chars", given.alias("given"), F.pow(F.greatest("chars", F.lit(1)).cast("double"), F.lit(power)).alias("natural"))
    row = s.agg(F.sort_array(F.collect_list(F.struct("source", "chars", "given", "natural"))).alias("s"))
    total = lambda f: F.aggregate("s", F.lit(0.0), lambda a, x: a + f(x))
    rest = F.greatest(F.lit(0.0), F.lit(1.0) - total(lambda x: F.coalesce(x["given"], F.lit(0.0))))
    row = row.withColumns({"rest": rest if weights else F.lit(1.0), "free": total(lambda x: F.when(x["given"].isNull(), x["natural"]).otherwise(F.lit(0.0)))})
    each = row.select("rest", "free", F.posexplode("s").alias("i", "x"))
    target = F.coalesce("x.given", F.col("rest") * F.col("x.natural") / F.col("free"))
    blocks = F.greatest(F.lit(1), F.ceil(F.col("x.chars") / block_chars)).cast("long")
    each = each.select("i", "x.source", "x.chars", blocks.alias("blocks"), target.alias("target"))
    most = max(2 * n, min(most_slots, MOST_STEPS // max(n, 1)))
    # a source is read once after (its size in blocks) / target slots; the longest of these is the mix's length
    length = F.max(F.when(F.col("target") > 0, F.greatest("chars", F.lit(1)) / block_chars / F.col("target")))
    slots = each.agg(F.least(F.greatest(F.ceil(length), F.lit(2 * n)), F.lit(most)).alias("slots"))
    # whole shares that add up to the slots: rounded down, and one more for the largest remainders; at least one each
    each = each.crossJoin(slots).withColumn("exact", F.col("target") * F.col("slots")).withColumn("low", F.floor("exact"))
    all_ = Window.partitionBy(F.lit(0))  # at most MAX_SOURCES rows
    more = F.row_number().over(all_.orderBy(F.desc(F.col("exact") - F.col("low")), "i")) <= F.col("slots") - F.sum("low").over(all_)
    share = F.greatest(F.lit(1), F.col("low") + F.when(more, 1).otherwise(0)).cast("long")
    return each.select("i", "source", "chars", "blocks", "target", share.alias("share"))


def period_schedule(shares: DataFrame) -> DataFrame:
    """(slot, i, k, period): which source's k-th block of the period each slot takes, by earliest deadline first."""
    row = shares.agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "share"))), lambda x: x["share"]).alias("a"), F.sum("share").alias("period"))
    # i rides in the low digits of the deadline, so that ties go to the first source
    due = """array_min(transform(a, (w, i) -> if((acc.done[i] * period) div w <= t,
             ((acc.done[i] + 1) * period + w - 1) div w * 100000 + i, 9223372036854775807))) % 100000"""
    # the fold goes in runs of 256 steps, since an array that grows by one is copied at each step
    run = f"""aggregate(sequence(r * 256, least(r * 256 + 256, period) - 1), named_struct('done', all.done, 'took', cast(array() as array<struct<i: long, k: long>>)),
        (acc, t) -> transform(array({due}), p -> named_struct('done', transform(acc.done, (x, i) -> if(i = p, x + 1, x)),
        'took', array_append(acc.took, named_struct('i', p, 'k', acc.done[int(p)]))))[0])"""
    fold = f"""aggregate(sequence(0L, (period - 1) div 256), named_struct('done', transform(a, w -> 0L), 'runs', cast(array() as array<array<struct<i: long, k: long>>>)),
        (all, r) -> transform(array({run}), x -> named_struct('done', x.done, 'runs', array_append(all.runs, x.took)))[0], all -> flatten(all.runs))"""
    return row.filter("period > 0").select("period", F.posexplode(F.expr(fold)).alias("slot", "x")).select(F.col("slot").cast("long"), F.col("x.i").cast("int").alias("i"), "x.k", "period")


def mix(docs: DataFrame, weights: dict[str, float] | None = None, block_chars: int = BLOCK_CHARS, most_slots: int = MOST_SLOTS, power: float = POWER, max_epochs: int | None = None) -> DataFrame:
    """``docs`` (doc_id, source, text and more) with ``mix_block``, ``mix_epoch`` and ``mix_slot``; read in the order of ``mix_slot``.

    Each row occurs once per epoch of its source, at least once. A null source is a source; null texts have no
    characters; a null doc_id is placed by its text; repeated rows stay together; columns named like the new ones are replaced; an empty table gives an empty
    table. Only the tables of sources (at most MAX_SOURCES rows) and of one period's slots (about ``most_slots`` rows) are broadcast.
    """
    shares = materialise(source_shares(docs, weights, block_chars, most_slots, power), "mix-shares")
    slots = materialise(period_schedule(shares), "mix-slots").select(F.col("i").alias("_i"), F.col("k").alias("_k"), "slot")
    ends = shares.agg(F.max(F.col("blocks") / F.col("share")).alias("periods"), F.sum("share").alias("period"))
    end = F.ceil(F.col("periods") * F.col("period"))
    # how often a source starts: its blocks in all periods, the last one begun
    epochs = F.ceil(F.ceil("periods") * F.col("share") / F.col("blocks")).cast("long")
    epochs = F.least(epochs, F.lit(max_epochs)) if max_epochs else epochs
    plan = shares.crossJoin(ends).select(F.col("i").alias("_i"), F.col("source").alias("_source"), "blocks", "share", "period", end.alias("end"), epochs.alias("epochs"))
    text_of = F.coalesce(F.col("doc_id").cast("string"), F.md5("text"), F.lit(""))
    h = F.conv(F.substring(F.md5(text_of), 1, 8), 16, 10).cast("long")
    own = [c for c in docs.columns if c not in ("mix_block", "mix_epoch", "mix_slot")]
    rows = docs.select(F.struct(*own).alias("row"), h.alias("h"))
    out = rows.join(F.broadcast(plan), F.col("row.source").eqNullSafe(F.col("_source"))).withColumn("mix_block", F.floor(F.col("h") * F.col("blocks") / F.lit(_HASHES)).cast("long"))
    out = out.withColumn("mix_epoch", F.explode(F.sequence(F.lit(0).cast("long"), F.col("epochs") - 1)))
    out = out.withColumn("_g", F.col("mix_epoch") * F.col("blocks") + F.col("mix_block")).withColumn("_k", F.expr("_g % share"))
    out = out.join(F.broadcast(slots), ["_i", "_k"]).withColumn("mix_slot", F.expr("_g div share * period + slot"))
    return out.filter("mix_slot < end").select("row.*", "mix_block", F.col("mix_epoch").cast("int").alias("mix_epoch"), "mix_slot")


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "source", "mix_block", "mix_epoch", "mix_slot")


def mix_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the documents in the mix's order, those of scarce sources repeated; columns of any name pass through."""
    whole = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("whole")
    mixed = mix(docs.select("doc_id", "source", "text", whole))
    return mixed.orderBy("mix_slot", F.xxhash64("doc_id"), "mix_epoch").select("whole.*")


ORACLE_OP2 = f"""
WITH RECURSIVE s AS (
  SELECT source, cast(sum(length(coalesce(text, ''))) AS BIGINT) AS chars FROM documents GROUP BY source
), g AS (
  SELECT row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS i, source,
         greatest(1, cast(ceil(chars / {BLOCK_CHARS}.0) AS BIGINT)) AS blocks,
         greatest(chars, 1) / {BLOCK_CHARS}.0 AS size, pow(greatest(chars, 1), {POWER}) / sum(pow(greatest(chars, 1), {POWER})) OVER () AS target, count(*) OVER () AS n
  FROM s
), h AS (
  SELECT *, least(greatest(max(ceil(size / target)) OVER (), 2 * n), greatest(2 * n, least({MOST_SLOTS}, {MOST_STEPS} // n))) AS slots FROM g
), w AS (
  SELECT i, source, blocks, greatest(1, cast(floor(target * slots) + CASE WHEN row_number() OVER (ORDER BY target * slots - floor(target * slots) DESC, i)
         <= slots - sum(floor(target * slots)) OVER () THEN 1 ELSE 0 END AS BIGINT)) AS share
  FROM h
), c AS (
  SELECT list(share ORDER BY i) AS a, cast(sum(share) AS BIGINT) AS period, max(blocks / share) AS periods FROM w
), f(t, done, p) AS (
  SELECT cast(-1 AS BIGINT), list_transform(a, lambda x: cast(0 AS BIGINT)), cast(-1 AS BIGINT) FROM c
  UNION ALL
  SELECT t, list_transform(done, lambda x, j: CASE WHEN j - 1 = p THEN x + 1 ELSE x END), p
  FROM (SELECT f.t + 1 AS t, f.done, c.period, list_min(list_transform(c.a, lambda x, j:
          CASE WHEN f.done[j] * c.period // x <= f.t + 1 THEN ((f.done[j] + 1) * c.period + x - 1) // x * 100000 + j - 1
               ELSE 9223372036854775807 END)) % 100000 AS p
        FROM f, c) WHERE t < period
), o AS (SELECT p AS i, done[p + 1] - 1 AS k, t AS slot FROM f WHERE t >= 0),
d AS (
  SELECT doc_id, documents.source, w.i, share, blocks, period, periods,
         cast(floor(('0x' || substr(md5(cast(doc_id AS VARCHAR)), 1, 8))::BIGINT * blocks / {_HASHES}.0) AS BIGINT) AS mix_block
  FROM documents JOIN w ON documents.source IS NOT DISTINCT FROM w.source, c
), e AS (SELECT *, unnest(range(cast(ceil(ceil(periods) * share / blocks) AS BIGINT))) AS mix_epoch FROM d)
SELECT doc_id, source, mix_block, cast(mix_epoch AS INTEGER) AS mix_epoch,
       (mix_epoch * blocks + mix_block) // share * period + o.slot AS mix_slot
FROM e JOIN o ON o.i = e.i AND o.k = (mix_epoch * blocks + mix_block) % share
WHERE (mix_epoch * blocks + mix_block) // share * period + o.slot < ceil(periods * period)
"""
