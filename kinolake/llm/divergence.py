"""Source divergence audit: how the vocabulary of each source differs from that of the other sources of its language.

Plain relational: documents' terms are exploded and counted per (lang, source, term) with the number of documents that hold each; terms in enough
documents of a language are kept; every group (lang, source) is joined with its language's kept terms, so that terms it never uses count
zero; each term then has a smoothed share in parts of a billion, 1 + floor(10 ** 9 (count + SMOOTH) / (N + SMOOTH V)), in the group and in the language.
Pairs of groups come from a self-join on (lang, term), each unordered pair once, added up while joining; the order of items is a window.

Skew: counting aggregates before it shuffles, so a source with a third of all rows adds one row a term and task. Groups meet the kept
terms of a language on (lang, salt): a group is repeated once a salt (groups are few: a row a lang and source), a term has one salt, so that a
language's terms are spread over all tasks. The term ranks keep at most `top` rows a group and task before they shuffle.
Everything after the counts grows with kept terms times sources of a language (times half of the sources again in the self-join, as pairs are the result).

Edges: null text, lang and source are ''; a group without terms has p of all its kept terms from N = 0; a language without kept terms gives its pairs the
value 0 and no terms; a language with one source has no pairs; equal values are ordered by item in UTF-8. Repeated rows
count each (a row is a document, whatever its doc_id). Long texts are exploded whole. Extra columns are ignored. An empty table gives no rows. Shares are exact for N below 9 * 10 ** 15.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import ascii_lower, partitions, stored, text_of

#: Runs of ASCII letters and of anything beyond ASCII.
TERM = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"
MIN_DOCS = 30
SMOOTH = 5
TOP = 50


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, count, docs): occurrences of each term in each group, and the group's documents that hold it."""
    blank = lambda c: F.coalesce(docs[c].cast("string"), F.lit("")).alias(c)
    terms = F.sort_array(F.regexp_extract_all(ascii_lower(text_of(docs)), F.lit(TERM), F.lit(0)))
    rows = docs.select(blank("lang"), blank("source"), terms.alias("_terms"))
    # sorted, a term's first place in a document is where it differs from its neighbour
    before = F.concat(F.array(F.lit(None).cast("string")), "_terms")
    marked = F.zip_with("_terms", F.slice(before, F.lit(1), F.size("_terms")), lambda x, last: F.struct(x.alias("term"), (~x.eqNullSafe(last)).cast("int").alias("new")))
    rows = rows.select("lang", "source", F.explode(marked).alias("_x"))
    return rows.groupBy("lang", "source", F.col("_x.term").alias("term")).agg(F.count("*").alias("count"), F.sum("_x.new").alias("docs"))


def share(count: Column, total: Column, kept: Column) -> Column:
    """1 + floor(10 ** 9 (count + SMOOTH) / (total + SMOOTH kept)) in 64-bit integers: three digits at a time, as in long division."""
    whole, rest = F.lit(0).cast("long"), count + SMOOTH
    below = total + SMOOTH * kept
    for _ in range(3):
        # count + SMOOTH is at most `below`, so all remainders times 1,000 fit while `below` is under 9 * 10 ** 15
        whole = whole * 1000 + quotient(rest * 1000, below)
        rest = (rest * 1000) % below
    return whole + 1


def quotient(a: Column, b: Column) -> Column:
    """a div b of 64-bit integers."""
    return F.call_function("div", a, b)


def shares(docs: DataFrame, min_docs: int = MIN_DOCS) -> tuple[DataFrame, DataFrame]:
    """(groups, table): groups is (lang, source), every one that occurs; table has (lang, source, term, count, p, q) for each group and each kept
    term of its language, p the group's share, q the language's."""
    counts = stored(term_counts(docs), "terms")
    kept = counts.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("count").alias("lang_count")).where(F.col("docs") >= min_docs).drop("docs")
    kept = stored(kept, "kept")
    own = counts.drop("docs").join(kept.select("lang", "term"), ["lang", "term"], "left_semi")
    langs = kept.groupBy("lang").agg(F.count("*").alias("v"), F.sum("lang_count").alias("n_lang"))
    blank = lambda c: F.coalesce(docs[c].cast("string"), F.lit("")).alias(c)
    groups = stored(docs.select(blank("lang"), blank("source")).distinct(), "groups")
    sizes = groups.join(own.groupBy("lang", "source").agg(F.sum("count").alias("n")), ["lang", "source"], "left").join(langs, "lang").withColumn("n", F.coalesce("n", F.lit(0)))
    salts = partitions(docs.sparkSession)
    salted = kept.withColumn("_salt", F.pmod(F.xxhash64("term"), F.lit(salts)).cast("int"))
    dense = salted.join(sizes.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))), ["lang", "_salt"]).drop("_salt")
    full = dense.join(own, ["lang", "source", "term"], "left").withColumn("count", F.coalesce("count", F.lit(0)))
    p, q = share(F.col("count"), F.col("n"), F.col("v")), share(F.col("lang_count"), F.col("n_lang"), F.col("v"))
    return groups, stored(full.select("lang", "source", "term", "count", p.alias("p"), q.alias("q")), "shares")


def pairs(groups: DataFrame, table: DataFrame) -> DataFrame:
    """(lang, source, item, value, rank): for each group each other source of its language by the summed difference of their shares."""
    one = table.select("lang", "term", F.col("source").alias("a"), F.col("p").alias("pa"))
    two = table.select("lang", "term", F.col("source").alias("b"), F.col("p").alias("pb"))
    apart = one.join(two, ["lang", "term"]).where("a < b").groupBy("lang", "a", "b").agg(F.sum(F.abs(F.col("pa") - F.col("pb"))).alias("value"))
    # from the groups' side, as languages without kept terms have pairs too
    every = groups.select("lang", F.col("source").alias("a")).join(groups.select("lang", F.col("source").alias("b")), "lang").where("a < b")
    both = every.join(apart, ["lang", "a", "b"], "left").select("lang", F.explode(F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")), F.struct(F.col("b").alias("source"), F.col("a").alias("item")))).alias("_s"), F.coalesce("value", F.lit(0)).cast("long").alias("value"))
    return both.select("lang", "_s.source", "_s.item", "value").withColumn("rank", F.row_number().over(_order()))


def terms(table: DataFrame, top: int = TOP) -> DataFrame:
    """(lang, source, item, value, rank): for each group the `top` terms whose share exceeds the language's by most."""
    over = table.where("count > 0 and p > q").select("lang", "source", F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
    return over.withColumn("rank", F.row_number().over(_order())).where(F.col("rank") <= top)


def _order():
    return Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")


def divergence(docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP) -> DataFrame:
    """Both parts: lang, source, part (pair or term), item, value, rank."""
    groups, table = shares(docs, min_docs)
    part = lambda df, name: df.select("lang", "source", F.lit(name).alias("part"), "item", "value", F.col("rank").cast("int").alias("rank"))
    return part(pairs(groups, table), "pair").unionByName(part(terms(table, top), "term"))


ORACLE = r"""
with d as (select row_number() over () as i, coalesce(lang, '') as lang, coalesce(source, '') as source, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') as t from documents),
x as (select i, lang, source, unnest(t) as term from d),
kept as (select lang, term, count(*)::hugeint as lang_count from x group by all having count(distinct i) >= 30),
grp as (select distinct lang, source from d),
c as (select lang, source, term, count(*)::hugeint as n from x semi join kept using (lang, term) group by all),
dense as (select g.lang, g.source, k.term, k.lang_count, coalesce(c.n, 0)::hugeint as n from grp g join kept k on g.lang = k.lang left join c on c.lang = g.lang and c.source = g.source and c.term = k.term),
tot as (select *, sum(n) over (partition by lang, source)::hugeint as big, (count(*) over (partition by lang, source))::hugeint as v, sum(lang_count) over (partition by lang, source)::hugeint as big_lang from dense),
s as (select lang, source, term, n, 1 + (1000000000::hugeint * (n + 5)) // (big + 5 * v) as p, 1 + (1000000000::hugeint * (lang_count + 5)) // (big_lang + 5 * v) as q from tot),
far as (select a.lang, a.source, b.source as item, sum(abs(a.p - b.p)) as value from s a join s b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by all),
pair as (select a.lang, a.source, 'pair' as part, b.source as item, coalesce(f.value, 0) as value from grp a join grp b on a.lang = b.lang and a.source <> b.source left join far f on f.lang = a.lang and f.source = a.source and f.item = b.source),
term as (select lang, source, 'term' as part, term as item, p - q as value from s where n > 0 and p > q),
r as (select *, row_number() over (partition by lang, source, part order by value desc, item) as rank from (select * from pair union all select * from term))
select lang, source, part, item, value::bigint as value, rank::int as rank from r where part = 'pair' or rank <= 50
"""
