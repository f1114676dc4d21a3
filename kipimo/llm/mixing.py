"""Mixing sources to target weights by Pareto order sampling.

Sources share the words of all documents by weight, but none takes more than ``most``
times its own; what is over goes to the others, by weight, until none is above.  A
source's target then gives each of its documents an expected number of copies: the
whole ones are certain, and the rest is its inclusion probability p for one more.  A
random number U, a digest of seed, id and text, gives each document the rank
(U / (1 - U)) / (p / (1 - p)); each source takes its lowest ranks, as many as fill the
words that the certain copies leave of its target.  The cut is exact: a document
longer than what is left has no chance, and what the first that no longer fits leaves
open goes to shorter ones further down, ``FILLS`` times; one last document may come in
if that ends nearer to the target.  So all probabilities of one source are equal but
those of documents that do not fit.

The texts are read once; the narrow table of ids, sizes and numbers is staged.  Cuts are
found by radix histograms (``crossing_keys``), which neither sort nor gather a source,
so a source with a third of all rows is no more work for any task.  Sources are numbered
by range, so they may be many; the table of sources is broadcast behind a check.

Defined cases: null, empty and wordless texts have size 0 and take no words; a null
source is a source of its own, numbered last; null and repeated ids are documents of
their own; rows equal in id, text and source share their number and are taken or left
together; sources without words have target 0; an empty table gives an empty
result; other columns are not read.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.selection import crossing_keys, join_groups
from ..plans.stage import staged

WEIGHTS = (1, 2, 3)
MOST = 3
FILLS = 3
SEED = "mix"
_BITS = 52


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long"), F.lit(0).cast("long"))


def random_number(seed: str, *parts: Column) -> Column:
    """An integer of 52 bits from a digest of the parts."""
    plain = [F.coalesce(p.cast("string"), F.lit("")) for p in parts]
    digest = F.md5(F.concat_ws(":", F.lit(seed), *plain))
    return F.conv(F.substring(digest, 1, _BITS // 4), 16, 10).cast("long")


def pareto_rank(number: Column, p: Column) -> Column:
    """Order of random odds over inclusion odds, as a long; q / (1 + q) keeps the order of q."""
    u = (number + F.lit(0.5)) / F.lit(float(1 << _BITS))
    q = (u / (F.lit(1.0) - u)) / (p / (F.lit(1.0) - p))
    return F.floor(q / (F.lit(1.0) + q) * F.lit(float(1 << _BITS))).cast("long")


def numbered_sources(sources: DataFrame, weights=WEIGHTS) -> DataFrame:
    """Adds ``weight``: by code point, null last, the weights in turn."""
    spread = sources.repartitionByRange(F.col("source").isNull(), F.col("source"))
    placed = staged(spread.withColumn("_part", F.spark_partition_id()))
    before = Window.partitionBy("_one").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    counts = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_rows")).withColumn("_one", F.lit(1))
    starts = counts.select("_part", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_start"))
    inside = Window.partitionBy("_part").orderBy(F.col("source").isNull(), "source")
    place = F.col("_start") + F.row_number().over(inside) - 1
    turn = (place % len(weights)).cast("int") + 1
    weight = F.element_at(F.array(*[F.lit(w).cast("long") for w in weights]), turn)
    return placed.join(starts, "_part").select("source", "source_size", weight.alias("weight"))


def shared_targets(sources: DataFrame, most: int = MOST) -> DataFrame:
    """Adds ``target``: the words of all sources shared by weight, at most ``most`` times a source's own."""
    cap = F.col("source_size") * most
    capped = F.lit(False)
    while True:
        # words and weights that are left to those below their limit
        total, full, weights = sources.agg(
            F.sum("source_size"),
            F.coalesce(F.sum(F.when(capped, cap)), F.lit(0)),
            F.coalesce(F.sum(F.when(~capped, F.col("weight"))), F.lit(0)),
        ).first()
        left = (total or 0) - full
        exact = "decimal(38,0)"
        above = F.col("weight").cast(exact) * F.lit(left).cast(exact) > cap.cast(exact) * F.lit(weights).cast(exact)
        if not weights or not sources.filter(~capped & above).limit(1).count():
            break
        capped = above | capped
    share = F.col("weight").cast("double") * F.lit(float(left)) / F.lit(float(weights or 1))
    return sources.withColumn("target", F.when(capped, cap.cast("double")).otherwise(share))


def mix_sources(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights=WEIGHTS,
    most: int = MOST,
    seed: str = SEED,
) -> DataFrame:
    """doc_id, source, size, source_size, weight, target, copies, taken: one row per row of ``docs``."""
    sized = staged(
        docs.select(
            F.col(id_col).alias("doc_id"),
            F.col(source_col).alias("source"),
            n_words(F.col(text_col)).alias("size"),
            random_number(seed, F.col(id_col), F.col(text_col)).alias("_number"),
        )
    )
    sources = numbered_sources(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights)
    targets = shared_targets(staged(sources), most)
    certain = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    rest = F.col("target") - F.col("copies") * F.col("source_size")
    state = staged(
        targets.withColumn("copies", F.least(certain, F.lit(most)).cast("long"))
        .withColumn("_p", F.when(F.col("source_size") > 0, rest / F.col("source_size")).otherwise(0.0))
        .withColumn("_left", F.floor(F.greatest(rest, F.lit(0.0))).cast("long"))
        .withColumn("_cuts", F.array().cast("array<struct<most:bigint,below:bigint>>"))
    )
    n_sources = state.count()
    rank = pareto_rank(F.col("_number"), F.col("_p"))
    columns = ["_p", "_left", "_cuts", "target", "source_size", "weight", "copies"]

    def ranked():
        """Documents with their source's state; ``_in`` marks those that an earlier cut took."""
        joined = join_groups(sized, state.select("source", *columns), ["source"], n_sources)
        joined = joined.withColumn("_rank", F.when(F.col("_p") > 0, rank))
        taken = F.exists("_cuts", lambda c: (F.col("size") <= c["most"]) & (F.col("_rank") < c["below"]))
        return joined.withColumn("_in", F.coalesce(taken, F.lit(False)) & (F.col("size") > 0))

    for _ in range(FILLS):
        fitting = ranked().filter(~F.col("_in") & F.col("_rank").isNotNull() & F.col("size").between(1, F.col("_left")))
        keyed = fitting.select("source", F.shiftleft("_rank", 10).alias("key"), F.col("size").alias("weight"))
        # documents beyond the goal: their source is cut; else all that fit come in
        cuts = crossing_keys(keyed, ["source"], state.filter("_left > 0").select("source", F.col("_left").alias("goal")))
        sums = keyed.groupBy("source").agg(F.sum("weight").alias("_sum"))
        found = join_groups(sums, cuts.select("source", "key", "before"), ["source"], n_sources, "left")
        new = found.select(
            "source",
            F.coalesce(F.shiftright("key", 10), F.lit(1 << 60)).alias("_below"),
            F.coalesce("before", "_sum").alias("_got"),
        )
        cut = F.array(F.struct(F.col("_left").alias("most"), F.col("_below").alias("below")))
        state = staged(
            join_groups(state, new, ["source"], n_sources, "left")
            .withColumn("_cuts", F.when(F.col("_below").isNotNull(), F.concat("_cuts", cut)).otherwise(F.col("_cuts")))
            .withColumn("_left", F.col("_left") - F.coalesce("_got", F.lit(0)))
            .drop("_below", "_got")
        )
        if not state.filter("_left > 0").limit(1).count():
            break
    # one more document where that ends nearer to the target
    gap = F.col("_left")
    near = ranked().filter(~F.col("_in") & F.col("_rank").isNotNull() & F.col("size").between(1, 2 * gap - 1))
    equal = near.groupBy("source", "_rank", "size", "_left").agg(F.sum("size").alias("_sum"))
    off = F.abs(F.col("_sum") - gap)
    nearest = (
        equal.filter(off < gap)
        .groupBy("source")
        .agg(F.min(F.struct(off.alias("off"), "_rank", "size")).alias("_last"))
    )
    last = staged(nearest)
    final = join_groups(ranked(), last, ["source"], n_sources, "left")
    extra = F.col("_in") | F.coalesce(
        (F.col("_rank") == F.col("_last._rank")) & (F.col("size") == F.col("_last.size")), F.lit(False)
    )
    copies = F.col("copies") + extra.cast("long")
    return final.select(
        "doc_id", "source", "size", "source_size", "weight", "target",
        copies.alias("copies"), (copies * F.col("size")).alias("taken"),
    )


def _fill_sql(k: int) -> str:
    """One round: documents that fit what is left of their source, in rank order while they fill it."""
    return f"""
), fit{k} AS (
  SELECT source, rank, sum(size) AS s FROM docs{k} WHERE NOT taken AND p > 0 AND size BETWEEN 1 AND open GROUP BY source, rank
), cum{k} AS (
  SELECT source, rank, sum(s) OVER (PARTITION BY source ORDER BY rank) AS c FROM fit{k}
), got{k} AS (
  SELECT c.source, max(rank) AS last, max(c) AS c FROM cum{k} c JOIN (SELECT DISTINCT source, open FROM docs{k}) d
  ON c.source IS NOT DISTINCT FROM d.source WHERE c.c <= d.open GROUP BY c.source
), docs{k + 1} AS (
  SELECT d.* REPLACE (taken OR coalesce(p > 0 AND size BETWEEN 1 AND open AND rank <= g.last, false) AS taken,
                      open - coalesce(g.c, 0)::BIGINT AS open)
  FROM docs{k} d LEFT JOIN got{k} g ON d.source IS NOT DISTINCT FROM g.source"""


#: The same mix; {documents} is the table's name.
SQL = (
    """
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size,
         ('0x' || substr(md5('mix:' || coalesce(doc_id::VARCHAR, '') || ':' || coalesce(text, '')), 1, 13))::BIGINT AS number
  FROM {documents}
), sources AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source IS NULL, source) AS place
  FROM sized GROUP BY source
), weighed AS (
  SELECT source, source_size, (place - 1) % 3 + 1 AS weight FROM sources
), ordered AS (
  SELECT *, sum(source_size) OVER () - coalesce(sum(3 * source_size) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS left_words,
         sum(weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS left_weight
  FROM weighed WINDOW o AS (ORDER BY source_size / weight, source IS NULL, source)
), capped AS (
  SELECT *, weight * left_words > 3 * source_size::HUGEINT * left_weight AS full_up FROM ordered
), rest AS (
  SELECT sum(source_size) - coalesce(sum(3 * source_size) FILTER (full_up), 0) AS words,
         sum(weight) FILTER (NOT full_up) AS weights FROM capped
), targets AS (
  SELECT source, source_size, CASE WHEN full_up THEN (3 * source_size)::DOUBLE
         ELSE weight::DOUBLE * words::DOUBLE / weights::DOUBLE END AS target FROM capped, rest
), shares AS (
  SELECT *, CASE WHEN source_size > 0 THEN least(floor(target / source_size), 3)::BIGINT ELSE 0 END AS copies FROM targets
), left_over AS (
  SELECT *, target - copies * source_size AS remainder FROM shares
), docs0 AS (
  SELECT doc_id, sized.source, size, source_size, target, copies, false AS taken,
         floor(greatest(remainder, 0))::BIGINT AS open,
         CASE WHEN source_size > 0 THEN remainder / source_size ELSE 0 END AS p,
         (number + 0.5::DOUBLE) / 4503599627370496::DOUBLE AS u,
         CASE WHEN p > 0 THEN (u / (1 - u)) / (p / (1 - p)) END AS q,
         floor(q / (1 + q) * 4503599627370496::DOUBLE)::BIGINT AS rank
  FROM sized JOIN left_over l ON sized.source IS NOT DISTINCT FROM l.source"""
    + "".join(_fill_sql(k) for k in range(FILLS))
    + f"""
), equal AS (
  SELECT source, rank, size, open, sum(size) AS s FROM docs{FILLS}
  WHERE NOT taken AND p > 0 AND size BETWEEN 1 AND 2 * open - 1 GROUP BY source, rank, size, open
), nearest AS (
  SELECT source, min({{{{'off': abs(s - open), 'rank': rank, 'size': size}}}}) AS l FROM equal
  WHERE abs(s - open) < open GROUP BY source
)
SELECT doc_id, size, source_size, target,
       (copies + (taken OR coalesce(rank = l.rank AND size = l.size, false))::BIGINT) * size AS taken
FROM docs{FILLS} d LEFT JOIN nearest n ON d.source IS NOT DISTINCT FROM n.source
"""
)
