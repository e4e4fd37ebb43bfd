"""Mixing sources to target weights with a low-discrepancy source schedule.

Targets are filled like water: a source's target is weight times one level, but at most `cap` times
its size. A slot i of the schedule is the van der Corput point of i (base 2), placed in the cumulative
target shares; it takes the next equal-token block of the source whose share holds the point. Slots
are ranked per source in two steps (counts per run of slots, then ranks inside a run), so a source with a
third of all slots is no single task. Inside a source, documents lie in the order of md5(doc_id), and
their words, end to end, are cut into blocks; blocks go round again after the last one. Sources that
the slots leave short of their target get closing slots behind all others, the last block of a source is cut at its target. So targets are met to a word,
and the sequence of points decides the order of the mix: a document's first_slot is the earliest slot whose block holds words of it.
The sources themselves pass one task (a row each), so there should be no more than some millions.

Null text has size 0; a null source is a source, placed last; null doc_ids come first in the order and
repeated rows are ordered by text hash; fully equal rows share their places evenly only as the sort puts
them (same totals). Extra columns are ignored. An empty table, or one without words, takes nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, stored, text_of

WEIGHTS = (5, 2, 1)
SHARE = 1.5
CAP = 2
BLOCK = 1024
#: Slots or documents of one run in the two-step ranks.
RUN = 4096


def row_key(docs: DataFrame) -> Column:
    """A hash of a row's doc_id, source and text, nulls told apart."""
    doc_id, source = docs["doc_id"].cast("long"), docs["source"].cast("string")
    return F.xxhash64(doc_id, doc_id.isNull(), source, source.isNull(), text_of(docs))


def sizes(docs: DataFrame) -> DataFrame:
    """doc_id, source, size (words), spot: the shuffled place inside its source, tie: its row_key."""
    size = F.regexp_count(text_of(docs), F.lit(WORD)).cast("long")
    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["source"].cast("string").alias("source"), size.alias("size"), F.md5(F.coalesce(docs["doc_id"].cast("string"), F.lit(""))).alias("spot"), row_key(docs).alias("tie"))


def targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, cap: int = CAP) -> DataFrame:
    """One row per source: source, source_size, n_docs, target, lo and hi (its span of the words that the mix takes)."""
    per = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    nth = F.row_number().over(order) - 1
    weight = F.element_at(F.array(*map(F.lit, weights)), (nth % len(weights) + 1).cast("int"))
    per = per.select("*", weight.cast("long").alias("weight"))
    per = per.select("*", (F.lit(cap) * F.col("source_size")).alias("most"))
    # sources fill up in the order of most / weight; the level is the first at which the rest stays below its own
    fill = Window.orderBy(F.col("most") / F.col("weight"), F.col("source").asc_nulls_last())
    before = fill.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    per = per.select("*", F.coalesce(F.sum("most").over(before), F.lit(0)).alias("full"), F.sum("weight").over(whole).alias("w_all"), F.coalesce(F.sum("weight").over(before), F.lit(0)).alias("w_full"), F.sum("source_size").over(whole).alias("size_all"))
    level = (F.lit(share) * F.col("size_all") - F.col("full")) / (F.col("w_all") - F.col("w_full"))
    per = per.select("*", F.when(F.col("most") / F.col("weight") >= level, level).alias("at"))
    per = per.select("*", F.min(F.struct("full", "at")).over(whole).alias("unused"), F.min(F.when(F.col("at").isNotNull(), F.struct(F.col("full"), F.col("at")))).over(whole)["at"].alias("level"))
    target = F.least(F.col("most").cast("double"), F.coalesce(F.col("weight") * F.col("level"), F.col("most").cast("double")))
    per = per.select("source", "source_size", "n_docs", target.alias("target"), F.floor(target).cast("long").alias("words"))
    hi = F.sum("words").over(order)
    return per.select("*", (hi - F.col("words")).alias("lo"), hi.alias("hi"), F.sum("words").over(Window.partitionBy()).alias("all_words"))


def ranked(df: DataFrame, keys: list[str], run: str, order: list, size: str | None = None) -> DataFrame:
    """Adds `before`: rows (or the sum of size) of the same keys that lie before, runs first and then `order` inside a run."""
    one = F.col(size) if size else F.lit(1)
    runs = df.groupBy(*keys, run).agg(F.sum(one).alias("in_run"))
    earlier = Window.partitionBy(*keys).orderBy(run).rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.select(*[F.col(k).alias(f"_{k}") for k in keys], F.col(run).alias("_run"), F.coalesce(F.sum("in_run").over(earlier), F.lit(0)).alias("offset"))
    inside = Window.partitionBy(*keys, run).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    local = df.select("*", F.coalesce(F.sum(one).over(inside), F.lit(0)).alias("inside"))
    on = [local[k].eqNullSafe(runs[f"_{k}"]) for k in keys] + [local[run] == runs["_run"]]
    return local.join(runs, on).withColumn("before", F.col("offset") + F.col("inside")).drop("inside", "offset", "_run", *[f"_{k}" for k in keys])


def point(slot: Column, bits: int) -> Column:
    """The van der Corput point (base 2) of a slot below 2 ** bits: its bits mirrored behind the point."""
    return F.conv(F.reverse(F.lpad(F.bin(slot), bits, "0")), 2, 10).cast("double") / F.lit(float(1 << bits))


def schedule(per: DataFrame, block: int = BLOCK) -> DataFrame:
    """slot, source, block (its rank among the source's slots), words (of that block that the mix takes). Closing slots have the last numbers."""
    spark = per.sparkSession
    (total,) = per.agg(F.coalesce(F.sum("words"), F.lit(0))).first()
    n = -(-int(total) // block)
    bits = max(1, n.bit_length())
    cells = 1 << min(12, bits)
    slots = spark.range(n).select(F.col("id").alias("slot"), (point(F.col("id"), bits) * F.lit(float(total))).alias("at"))
    slots = slots.select("*", F.floor(F.col("at") * cells / F.lit(float(max(1, total)))).cast("int").alias("cell"))
    width = total / cells if total else 1.0
    spans = per.where("words > 0").select("source", "words", "lo", "hi", F.explode(F.sequence(F.floor(F.col("lo") / F.lit(width)).cast("int"), F.floor(F.col("hi") / F.lit(width)).cast("int"))).alias("cell"))
    placed = slots.join(spans, "cell").where("at >= lo and at < hi").select("slot", "source", "words", F.floor(F.col("slot") / RUN).alias("run"))
    placed = ranked(placed, ["source"], "run", ["slot"]).withColumnRenamed("before", "block").drop("run")
    used = placed.where(F.col("block") * block < F.col("words"))
    had = used.groupBy(F.col("source").alias("_s")).agg(F.count("*").alias("n"))
    short = per.join(had, per["source"].eqNullSafe(had["_s"]), "left").select("source", "words", F.coalesce("n", F.lit(0)).alias("n"), F.ceil(F.col("words") / block).alias("need")).where("need > n")
    closing = short.select("source", "words", F.explode(F.sequence(F.col("n"), F.col("need") - 1)).alias("block"))
    # a few for each source: the points' discrepancy grows with the logarithm of the slots
    closing = closing.select((F.lit(n) + F.row_number().over(Window.orderBy("block", F.col("source").asc_nulls_last())) - 1).cast("long").alias("slot"), "source", "words", "block")
    return used.unionByName(closing).select("slot", "source", "block", F.least(F.lit(block).cast("long"), F.col("words") - F.col("block") * block).alias("words"))


def placed_rounds(docs: DataFrame, block: int = BLOCK, **kw) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, tie (its row_key), and of the first and second round in which the mix
    takes it the words (words0, words1) and the earliest slot (slot0, slot1; null without words)."""
    base = stored(sizes(docs), "sizes")
    per = stored(targets(base, **kw), "targets")
    keyed = base.join(per, base["source"].eqNullSafe(per["source"])).select(base["doc_id"], base["source"], "size", "source_size", "target", "words", "spot", "tie", F.floor(F.conv(F.substring("spot", 1, 8), 16, 10).cast("double") * F.ceil(F.col("n_docs") / RUN) / F.lit(2.0**32)).alias("run"))
    placed = stored(ranked(keyed, ["source"], "run", ["spot", F.col("doc_id").asc_nulls_first(), "tie"], "size").withColumn("row", F.monotonically_increasing_id()), "places")
    # the source's words lie on a ring; a block is [block * b, block * b + words) on the line that winds around it
    slots = stored(schedule(per, block), "slots")
    rounds = F.array(*(F.struct(F.lit(k).alias("round"), (F.col("before") + k * F.col("source_size")).alias("a")) for k in (0, 1)))
    pieces = placed.where("size > 0 and words > 0").select("row", F.col("source").alias("_s"), "size", F.explode(rounds).alias("r"), F.col("words").alias("most")).select("row", "_s", "size", "r.round", "r.a", "most").where("a < most")
    pieces = pieces.select("*", F.explode(F.sequence(F.floor(F.col("a") / block), F.floor((F.least(F.col("a") + F.col("size"), F.col("most")) - 1) / block))).alias("_b"))
    hit = pieces.join(slots, [pieces["_s"].eqNullSafe(slots["source"]), pieces["_b"] == slots["block"]])
    part = F.least(F.col("a") + F.col("size"), F.col("block") * block + F.col("words")) - F.greatest(F.col("a"), F.col("block") * block)
    of = lambda k, x: F.when(F.col("round") == k, x)
    got = hit.groupBy("row").agg(*(F.sum(of(k, part)).alias(f"words{k}") for k in (0, 1)), *(F.min(of(k, F.col("slot"))).alias(f"slot{k}") for k in (0, 1)))
    words = [F.coalesce(f"words{k}", F.lit(0)).cast("long").alias(f"words{k}") for k in (0, 1)]
    return placed.drop("words").join(got, "row", "left").select("doc_id", "source", "size", "source_size", "target", "tie", *words, "slot0", "slot1")


def mix(docs: DataFrame, block: int = BLOCK, **kw) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, taken, first_slot (null if nothing is taken)."""
    rows = placed_rounds(docs, block, **kw)
    return rows.select("doc_id", "source", "size", "source_size", "target", (F.col("words0") + F.col("words1")).alias("taken"), F.least("slot0", "slot1").alias("first_slot"))


ORACLE = r"""
with recursive sized as (
  select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::bigint as size,
         md5(coalesce(doc_id::varchar, '')) as spot from documents),
src as (select source, sum(size)::bigint as source_size, count(*) as n_docs from sized group by source),
num as (select *, row_number() over (order by source asc nulls last) - 1 as nth, 2 * source_size as most from src),
wgt as (select *, case nth % 3 when 0 then 5 when 1 then 2 else 1 end as weight, sum(source_size) over () as size_all from num),
filled as (select *, coalesce(sum(most) over (order by most / weight, source asc nulls last rows between unbounded preceding and 1 preceding), 0) as full_before,
         coalesce(sum(weight) over (order by most / weight, source asc nulls last rows between unbounded preceding and 1 preceding), 0) as w_full,
         sum(weight) over () as w_all from wgt),
lev as (select *, (1.5 * size_all::double - full_before::double) / (w_all - w_full)::double as at_level from filled),
pick as (select min_by(at_level, full_before) filter (where most / weight >= at_level) as level from lev),
tgt as (select source, source_size, least(most::double, coalesce(weight * level, most::double)) as target, n_docs from lev cross join pick),
wrd as (select source, floor(target)::bigint as words from tgt),
span as (select source, words, sum(words) over (order by source asc nulls last) - words as lo, sum(words) over (order by source asc nulls last) as hi, sum(words) over () as all_words from wrd),
total as (select max(all_words)::bigint as w, ceil(max(all_words) / 1024.0)::bigint as n, length(bin(ceil(max(all_words) / 1024.0)::bigint)) as bits from span),
point as (select i as slot, list_sum(list_transform(range(bits), lambda k: ((i >> k) & 1) * pow(2, bits - 1 - k))) / pow(2, bits) * w::double as spot from total, range(0, (select n from total)) r(i)),
dealt as (select slot, source, words, row_number() over (partition by source order by slot) - 1 as block from point join span on spot >= lo and spot < hi),
used as (select * from dealt where block * 1024 < words),
missing as (select s.source, unnest(range(coalesce(u.n, 0), ceil(s.words / 1024.0)::bigint)) as block from span s left join (select source, count(*) as n from used group by source) u on s.source is not distinct from u.source),
slots as (select slot, source, block from used union all
          select (select n from total) + row_number() over (order by block, source asc nulls last) - 1, source, block from missing),
place as (select s.doc_id, s.source, s.size, t.source_size, t.target, floor(t.target)::bigint as words,
         coalesce(sum(s.size) over (partition by s.source order by spot, s.doc_id rows between unbounded preceding and 1 preceding), 0)::bigint as a
         from sized s join tgt t on s.source is not distinct from t.source)
select doc_id, size, source_size, target,
       (greatest(0, least(a + size, words) - a) + greatest(0, least(a + source_size + size, words) - (a + source_size)))::bigint as taken,
       case when size > 0 and a < words then slot end as first_slot
from place left join slots on place.source is not distinct from slots.source and slots.block = a // 1024
"""
