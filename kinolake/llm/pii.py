"""PII: base patterns, then information-theoretic sanitisation, all in DataFrame functions.

Base: emails, IP addresses, cards and phone numbers by their patterns. A protected entity is one such
value (letters A-Z lower-cased). The terms around its occurrences (words within CONTEXT code points) are its context.
Over the corpus, a term t reveals an entity e as far as PMI(e; t) nears IC(e), the most it can be:
PMI(e; t) = log2(n(e,t) N / (n(e) n(t))), IC(e) = log2(N / n(e)), N, n(e), n(t), n(e,t) counting documents.
A term whose PMI reaches REMOVE of IC is removed, one that reaches GENERALISE gives way to its class,
wherever it stands in a context of e; both need SUPPORT different contexts of e, so that copies of one passage say nothing.
Documents without an entity are never touched. CONTEXT is a parameter (`around`): a term farther from an entity says nothing about it and stays.
A generalised term gives way to its class: number, code (letters and digits), name (capitalised) or word.

Texts of any length and any number of entities: places come from running sums over chunks, pieces from blocks of PIECE code points, so the work of one
text grows by about n ** 1.5 in its entities at most, and no row holds another's array. Null text is empty; repeated rows each get their row; null doc_ids are kept; extra columns are ignored; an empty table gives
an empty result. All spans are code points, end exclusive. Domain labels of a single email repeat without a cap.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, stored, table, text_of

KINDS = ("email", "ip", "card", "phone")
CONTEXT = 60
SUPPORT = 3
GENERALISE, REMOVE = 0.90, 0.98

# The start guards only save the search from trying again inside a run that has failed from its start.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
# For cards, single separators between digits stand; any other is changed to a letter first, so that a run needs one class only.
LOOSE = r"(?<![0-9])[\x20-]|[\x20-](?![0-9])"
CARD = r"[0-9][0-9\x20-]{15,}+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
TERM = r"[\p{L}\p{N}_]{2,}"


#: Texts are cut into blocks of so many code points, so that taking a short piece reads no more than two of them.
PIECE = 1024
_NEVER = 2**31 - 1


def _array(kind: str) -> Column:
    return F.array().cast(kind)


def let(value: Column, body) -> Column:
    """body(value), where value is computed once however often body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def running(items: Column, kind: str, value, join, zero: Column) -> Column:
    """Array of (item, before): `before` joins the values of all items before, in chunks of about the root of the array's size, so that long arrays
    aren't copied once for each item."""
    out = _array(f"array<struct<item:{kind},before:int>>")

    def step(acc: Column, x: Column) -> Column:
        row = F.struct(x.alias("item"), acc["at"].alias("before"))
        return F.struct(join(acc["at"], value(x)).alias("at"), F.concat(acc["out"], F.array(row)).alias("out"))

    def whole(acc: Column, c: Column) -> Column:
        moved = F.transform(c["out"], lambda y: F.struct(y["item"].alias("item"), join(acc["at"], y["before"]).alias("before")))
        return F.struct(join(acc["at"], c["at"]).alias("at"), F.concat(acc["outs"], F.array(moved)).alias("outs"))

    def chunked(it: Column) -> Column:
        width = F.ceil(F.sqrt(F.size(it))).cast("int")
        chunks = F.transform(F.sequence(F.lit(0), F.floor((F.size(it) - 1) / width).cast("int")), lambda k: F.slice(it, k * width + 1, width))
        local = F.transform(chunks, lambda c: F.aggregate(c, F.struct(zero.alias("at"), out.alias("out")), step))
        start = F.struct(zero.alias("at"), _array(f"array<array<struct<item:{kind},before:int>>>").alias("outs"))
        return F.when(F.size(it) > 0, F.flatten(F.aggregate(local, start, whole, lambda acc: acc["outs"]))).otherwise(out)

    return let(items, chunked)


def blocks(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0))


def cut(parts: Column, a: Column, z: Column) -> Column:
    """Code points a to z of the text in blocks `parts`."""
    first, last = F.floor(a / PIECE).cast("int"), F.floor(z / PIECE).cast("int")
    part = lambda k: F.coalesce(F.get(parts, k), F.lit(""))
    between = F.array_join(F.slice(parts, first + 2, F.greatest(F.lit(0), last - first - 1)), "")
    long = F.concat(F.substring(part(first), a - first * PIECE + 1, F.lit(PIECE)), between, F.substring(part(last), F.lit(1), z - last * PIECE))
    return F.when(first == last, F.substring(part(first), a - first * PIECE + 1, z - a)).otherwise(long)


def found(text: Column, pattern: str) -> Column:
    """Array of (start, end, value): the pattern's matches with their places, from the matches and the gaps between them."""

    def pairs(v: Column) -> Column:
        return F.zip_with(v["hits"], F.slice(v["gaps"], F.lit(1), F.size(v["hits"])), lambda h, g: F.struct(h.alias("h"), F.length(g).alias("skip")))

    def placed(y: Column) -> Column:
        start = y["before"] + y["item"]["skip"]
        return F.struct(start.alias("start"), (start + F.length(y["item"]["h"])).alias("end"), y["item"]["h"].alias("value"))

    both = let(text, lambda t: F.struct(F.regexp_extract_all(t, F.lit(pattern), F.lit(0)).alias("hits"), F.split(t, pattern, -1).alias("gaps")))
    return F.transform(running(let(both, pairs), "struct<h:string,skip:int>", lambda x: x["skip"] + F.length(x["h"]), lambda m, n: m + n, F.lit(0)), placed)


def luhn(value: Column) -> Column:
    digits = F.regexp_replace(value, "[^0-9]", "")

    def weigh(d: Column, i: Column) -> Column:
        x = d.cast("int") * F.when(i % 2 == 1, 2).otherwise(1)
        return F.when(x > 9, x - 9).otherwise(x)

    total = F.aggregate(F.transform(F.split(F.reverse(digits), "(?!^)(?!$)"), weigh), F.lit(0), lambda a, x: a + x)
    return F.length(digits).between(16, 19) & (total % 10 == 0)


def base_spans(text: Column) -> Column:
    """Array of (kind, start, end, value), ordered by kind as listed, then start."""
    octets = lambda v: F.forall(F.split(v, r"\."), lambda p: F.length(F.regexp_replace(p, "^0+", "")) <= 3) & F.forall(F.split(v, r"\."), lambda p: F.coalesce(p.try_cast("int"), F.lit(0)) <= 255)
    n_digits = lambda v: F.length(F.regexp_replace(v, "[^0-9]", ""))
    none = _array("array<struct<start:int,end:int,value:string>>")
    digits = text.rlike("[0-9]")
    per = (
        F.when(text.contains("@"), found(text, EMAIL)).otherwise(none),
        F.when(digits, F.filter(found(text, IP), lambda x: octets(x["value"]))).otherwise(none),
        F.when(digits, F.filter(found(F.regexp_replace(text, LOOSE, "x"), CARD), lambda x: luhn(x["value"]))).otherwise(none),
        F.when(text.contains("+"), F.filter(found(text, PHONE), lambda x: n_digits(x["value"]).between(8, 15))).otherwise(none),
    )

    def named(kind: str, spans: Column) -> Column:
        return F.transform(spans, lambda y: F.struct(F.lit(kind).alias("kind"), y["start"].alias("start"), y["end"].alias("end"), y["value"].alias("value")))

    return F.flatten(F.array(*map(named, KINDS, per)))


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def scan(docs: DataFrame, around: int = CONTEXT) -> DataFrame:
    """doc_id, a hash of the text, the base spans and each entity's context with the places of its terms; one pass over the texts."""
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), text_of(docs).alias("text"))
    rows = rows.select("doc_id", "text", base_spans(F.col("text")).alias("base"))
    lo = lambda x: F.greatest(x["start"] - around, F.lit(0))

    def moved(side: Column, at: Column) -> Column:
        return F.transform(found(side, TERM), lambda y: F.struct(ascii_lower(y["value"]).alias("term"), (y["start"] + at).alias("start"), (y["end"] + at).alias("end")))

    def context(x: Column, sides: Column) -> Column:
        terms = F.concat(moved(sides["before"], lo(x)), moved(sides["after"], x["end"]))
        # terms that the window may have cut are left out
        whole = F.filter(terms, lambda t: ((t["start"] > lo(x)) | (t["start"] == 0)) & (t["end"] < x["end"] + around))
        return F.struct(x["kind"].alias("kind"), ascii_lower(x["value"]).alias("entity"), F.xxhash64(sides["before"], sides["after"]).alias("ctx"), whole.alias("terms"))

    def contexts(parts: Column) -> Column:
        sides = lambda x: F.struct(cut(parts, lo(x), x["start"]).alias("before"), cut(parts, x["end"], x["end"] + around).alias("after"))
        return F.transform("base", lambda x: let(sides(x), lambda y: context(x, y)))

    none = _array("array<struct<kind:string,entity:string,ctx:bigint,terms:array<struct<term:string,start:int,end:int>>>>")
    return rows.select("doc_id", F.xxhash64("text").alias("h"), "base", F.when(F.size("base") > 0, let(blocks(F.col("text")), contexts)).otherwise(none).alias("contexts"))


def disclosures(docs: DataFrame, scanned: DataFrame) -> DataFrame:
    """entity, kind, term, action ('generalise' or 'remove'): the terms that reveal an entity beyond the thresholds."""
    near = scanned.select("doc_id", "h", F.explode("contexts").alias("c")).select("doc_id", "h", "c.kind", "c.entity", "c.ctx", F.col("c.terms.term").alias("terms"))
    key = F.struct("doc_id", "h")
    held = near.groupBy("kind", "entity").agg(F.countDistinct(key).alias("n_e"), F.countDistinct("ctx").alias("n_ctx")).where(F.col("n_ctx") >= SUPPORT)
    seen = near.join(held, ["kind", "entity"]).select("kind", "entity", "n_e", "doc_id", "h", "ctx", F.explode(F.array_distinct("terms")).alias("term"))
    both = seen.groupBy("kind", "entity", "n_e", "term").agg(F.countDistinct(key).alias("n_et"), F.countDistinct("ctx").alias("n_ctx")).where(F.col("n_ctx") >= SUPPORT)
    total = docs.agg(F.count("*").alias("n_all"))
    both = both.join(total)  # one row of totals
    ic = F.log2(F.col("n_all") / F.col("n_e"))
    # PMI >= GENERALISE * IC means n_t <= n_et * 2 ** ((1 - GENERALISE) * IC); a term that the contexts alone show in more documents can't reach it
    around = near.select("doc_id", "h", F.explode(F.array_distinct("terms")).alias("term")).groupBy("term").agg(F.countDistinct(key).alias("n_near"))
    both = both.join(around, "term").where((ic > 0) & (F.col("n_near") <= F.col("n_et") * F.pow(F.lit(2.0), (1 - GENERALISE) * ic) + 1e-6))
    both = stored(both.drop("n_near"), "pairs")
    # documents of each candidate term, over all whole texts
    words = docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.explode(F.array_distinct(F.regexp_extract_all(ascii_lower(text_of(docs)), F.lit(TERM), F.lit(0)))).alias("term"))
    n_t = words.join(both.select("term").distinct(), "term", "left_semi").groupBy("term").agg(F.count("*").alias("n_t"))
    rows = both.join(n_t, "term")
    pmi = F.log2(F.col("n_et") * F.col("n_all") / (F.col("n_e") * F.col("n_t")))
    part = pmi / ic
    return rows.where(part >= GENERALISE).select("kind", "entity", "term", F.when(part >= REMOVE, "remove").otherwise("generalise").alias("action"))


def marked_places(scanned: DataFrame, found_terms: DataFrame) -> DataFrame:
    """doc_id, h, added: sorted array of (start, end, kind, base), the places of disclosing terms without repeats; base is false."""
    places = scanned.select("doc_id", "h", F.explode("contexts").alias("c")).select("doc_id", "h", "c.kind", "c.entity", F.explode("c.terms").alias("t")).select("doc_id", "h", "kind", "entity", "t.*")
    each = places.join(found_terms, ["kind", "entity", "term"]).groupBy("doc_id", "h", "start", "end").agg(F.max("action").alias("kind"))
    return each.groupBy("doc_id", "h").agg(F.collect_list(F.struct("start", "end", "kind", F.lit(False).alias("base"))).alias("added"))


def apart(base: Column, added: Column) -> Column:
    """Array of (kind, start, end): the added spans that overlap no base span, in order. Passes over both in order of their starts, either way."""
    kind = "struct<start:int,end:int,kind:string,base:boolean>"
    events = F.array_sort(F.concat(added, F.transform(base, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["kind"].alias("kind"), F.lit(True).alias("base")))))

    def split(it: Column) -> Column:
        last_end = running(it, kind, lambda x: F.when(x["base"], x["end"]).otherwise(0), F.greatest, F.lit(0))
        next_start = F.reverse(running(F.reverse(it), kind, lambda x: F.when(x["base"], x["start"]).otherwise(_NEVER), F.least, F.lit(_NEVER)))
        both = F.zip_with(last_end, next_start, lambda a, b: F.struct(a["item"].alias("x"), a["before"].alias("past"), b["before"].alias("coming")))
        free = F.filter(both, lambda y: ~y["x"]["base"] & (y["past"] <= y["x"]["start"]) & (y["coming"] >= y["x"]["end"]))
        return F.transform(free, lambda y: F.struct(y["x"]["kind"].alias("kind"), y["x"]["start"].alias("start"), y["x"]["end"].alias("end")))

    return let(events, split)


def detect(docs: DataFrame, around: int = CONTEXT) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, and h, all_spans for sanitise."""
    scanned = stored(scan(docs, around), "pii")
    terms = disclosures(docs, scanned)
    rows = scanned.select("doc_id", "h", "base")
    a = marked_places(scanned, terms).select(F.col("doc_id").alias("_d"), F.col("h").alias("_h"), "added")
    out = rows.join(a, rows["doc_id"].eqNullSafe(a["_d"]) & (rows["h"] == a["_h"]), "left").drop("_d", "_h")
    more = F.when(F.col("added").isNotNull(), apart(F.col("base"), F.col("added"))).otherwise(_array("array<struct<kind:string,start:int,end:int>>"))
    plain = F.transform("base", lambda x: F.struct(x["kind"].alias("kind"), x["start"].alias("start"), x["end"].alias("end")))
    count = lambda kind: F.size(F.filter("base", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    every = F.concat(plain, F.array_sort(more))
    return out.select("doc_id", *map(count, KINDS), F.sha2(_joined(plain), 256).alias("base_sha256"), _joined(every).alias("spans"), "h", every.alias("all_spans"))


def class_of(term: Column) -> Column:
    """What a generalised term gives way to."""
    return F.when(term.rlike("^[0-9]+$"), "<NUMBER>").when(term.rlike("[0-9]"), "<CODE>").when(term.rlike(r"^\p{Lu}"), "<NAME>").otherwise("<WORD>")


def sanitise(docs: DataFrame, around: int = CONTEXT) -> DataFrame:
    """doc_id and the text with base values replaced by <KIND>, generalised terms by their class (class_of), removed terms cut out. Of overlapping
    spans the first one's mark stands for all."""
    kind = "struct<start:int,end:int,kind:string>"
    marked = detect(docs, around).select("doc_id", "h", F.array_sort(F.transform("all_spans", lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["kind"].alias("kind")))).alias("spans")).distinct()
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), text_of(docs).alias("text")).withColumn("h", F.xxhash64("text"))
    m = marked.select(F.col("doc_id").alias("_d"), F.col("h").alias("_h"), "spans")
    both = rows.join(m, rows["doc_id"].eqNullSafe(m["_d"]) & (rows["h"] == m["_h"]), "left")

    def cleaned(parts: Column) -> Column:
        place = lambda x: F.when(x["kind"] == "remove", "").when(x["kind"] == "generalise", class_of(cut(parts, x["start"], x["end"]))).otherwise(F.concat(F.lit("<"), F.upper(x["kind"]), F.lit(">")))
        spans = running(F.col("spans"), kind, lambda x: x["end"], F.greatest, F.lit(0))
        fresh = F.filter(spans, lambda y: y["item"]["start"] >= y["before"])
        pieces = F.transform(fresh, lambda y: F.concat(cut(parts, y["before"], y["item"]["start"]), place(y["item"])))
        tail = cut(parts, F.array_max(F.transform("spans", lambda x: x["end"])), F.length("text"))
        return F.concat(F.array_join(pieces, ""), tail)

    done = F.when(F.size("spans") > 0, let(blocks(F.col("text")), cleaned)).otherwise(F.col("text"))
    return both.select("doc_id", done.alias("text"))


def op1_pii(spark, sf_dir: str) -> DataFrame:
    return detect(table(spark, sf_dir, "documents")).drop("h", "all_spans")
