"""Video relations derived from the raw tables, in Spark and as SQL for the same relations elsewhere."""

from __future__ import annotations

import re
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import stored

LABELS = ("click", "error", "purchase", "signup", "view")

#: The line of an experiment's log that an event writes, by the last digit of its number. In brackets, parts made of the event (PARTS).
LOG_LINES = (
    "*** Step [step]",
    "INFO explore took [v] seconds",
    "multifeature explore: explore (feature ['[type]'])",
    "*** Evaluating labels",
    "y_train (len=[c]): [('bedded', [c13]), ('chewing', [c7]), ('snow', 0)]",
    "Training set size [c500]",
    "Results for split pred (len=[c90])",
    "Passed multilabel_threshold=0.[c2]; best on split=0.[c3]",
    "*** Performance {'pred_avgprecision_bedded': 0.[c2], 'pred_avgprecision_chewing': [nan], 'pred_mAP': 0.[c3], 'pred_ml_f1_score_macro': 0.[c2]5, 'pred_ml_f1_score_bedded': 0.[c3]5}",
)
#: The lines of events whose number ends in 9, by type.
OTHER_LINES = {
    "click": "nsteps=[c9]",
    "view": 'strategy="[type]"',
    "signup": "Args: ['--k', '[c20]', '--nsteps', '[c9]', '--fast']",
    "error": "Results: {dataset_name: deer | feature_name: f[c3of] | nworkers: 4 | npipe: 2 | vidtime: [v]}",
    "purchase": "Results: {dataset_name: bears | feature_name: f[c3of] | nworkers: [c9] | npipe: 2 | vidtime: [v]}",
}
#: The parts as SQL over event_id, event_type and c (the value in hundredths); // is a division of whole numbers.
PARTS = {
    "step": "event_id // 10", "type": "event_type", "c": "c", "c13": "c % 13", "c7": "c % 7", "c500": "c % 500", "c90": "c % 90", "c9": "c % 9", "c20": "c % 20", "c3of": "c % 3",
    "v": "concat(c // 100, '.', two(c % 100))", "c2": "two(c % 100)", "c3": "two(c // 7 % 100)", "nan": "case when c % 4 = 0 then 'nan' else concat('0.', two(c // 3 % 100)) end",
}


def _line_sql(spark: bool) -> str:
    """The line of an event as an SQL expression, in Spark's or DuckDB's form."""
    quoted = (lambda t: "'" + t.replace("'", "\\'") + "'") if spark else (lambda t: "'" + t.replace("'", "''") + "'")
    text = lambda line: f"concat({', '.join(PARTS[x] if i % 2 else quoted(x) for i, x in enumerate(re.split(r'\[(' + '|'.join(PARTS) + r')\]', line)))})"
    first = " ".join(f"when event_id % 10 = {i} then {text(x)}" for i, x in enumerate(LOG_LINES))
    other = " ".join(f"when event_type = '{t}' then {text(x)}" for t, x in OTHER_LINES.items())
    out = re.sub(r"two\(([^()]*)\)", r"lpad(cast(\1 as string), 2, '0')", f"case {first} {other} end")
    return out.replace(" // ", " div ") if spark else out


#: Each relation as SQL; a relation may use those before it.
CTES = {
    "vm": """select user_id as vid, concat('/videos/', user_id, '.mp4') as vpath, min(ts) as vstart,
        (epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6 as vduration, concat('/thumbs/', user_id, '.jpg') as thumbpath
        from events group by user_id""",
    "ann": """select e.event_id as aid, e.user_id as vid, (epoch_us(e.ts) - epoch_us(v.vstart)) / 1e6 as start_time,
        (epoch_us(e.ts) - epoch_us(v.vstart)) / 1e6 + 360 * e.value as end_time, e.event_type as label, e.ts as label_time
        from events e join vm v on e.user_id = v.vid""",
    "feat": """select e.vec_id * 3 + k as fid, (e.vec_id * 7 + k * 11) % (select max(user_id) + 1 from events) as vid,
        cast(((e.vec_id * 37 + k * 101) % 700) * 3600 as double) as start_time,
        cast(((e.vec_id * 37 + k * 101) % 700) * 3600 + 1800 as double) as end_time, e.embedding as feature
        from embeddings e cross join (select unnest(range(3)) as k) t""",
    "feat2": """select f.fid * 4 + k as fid, f.vid, f.start_time + 150 + 400 * k as start_time, f.start_time + 450 + 400 * k as end_time,
        list_reverse(f.feature) as feature from feat f cross join (select unnest(range(4)) as k) t""",
    "pred": """select 1 as mid, f.vid, f.start_time, f.end_time, l.label,
        abs(cast(list_extract(f.feature, l.i) as double)) / (abs(cast(list_extract(f.feature, 1) as double)) + abs(cast(list_extract(f.feature, 2) as double))
        + abs(cast(list_extract(f.feature, 3) as double)) + abs(cast(list_extract(f.feature, 4) as double)) + abs(cast(list_extract(f.feature, 5) as double))) as probability
        from feat f cross join (values (1,'click'),(2,'error'),(3,'purchase'),(4,'signup'),(5,'view')) as l(i, label)""",
    # a model for each of the digits 1 to 6 that the events' numbers end in: trained on them, for the types that are at least as frequent as a fair share
    "models": """select mid, case when mid % 3 = 0 then 'clip' when mid = 5 then 'r3d+clip' else 'r3d' end as feature_name, max(ts) as creation_time,
        list_sort(list(event_type) filter (where n * kinds >= total)) as labels, mid / 16.0::double as f1_threshold, sum(n)::int as ntrain
        from (select (event_id % 10)::int as mid, event_type, max(ts) as ts, count(*) as n, sum(count(*)) over (partition by event_id % 10) as total, count(*) over (partition by event_id % 10) as kinds
        from events where event_id % 10 between 1 and 6 group by event_id % 10, event_type) group by mid""",
    "loglines": f"select concat('u', user_id, '.txt') as file, event_id::bigint as line_no, {_line_sql(False)} as line from (select *, round(value * 100)::bigint as c from events)",
    # mean values of the five event types over twelve steps, as shares of 128
    "scores": "select concat('f', event_type) as feature_name, (event_id % 12 + 1)::bigint as t, sum(round(value * 100)::bigint) / (count(*) * 12800.0::double) as y from events group by all",
    # label join results used by several queries
    "labeled": """select f.fid, f.vid, f.start_time, f.end_time, coalesce(string_agg(distinct a.label, '_' order by a.label), 'none') as labels
        from feat f join vm v on f.vid = v.vid left join ann a on f.vid = a.vid and f.start_time >= a.start_time and f.end_time <= a.end_time
        group by all""",
    # five clusters of features by their first value
    "clustered": "select f.fid, f.vid, f.start_time, f.end_time, f.feature, cast(floor(cast(list_extract(f.feature, 1) as double) * 20) as bigint) % 5 as cluster from feat f",
}
_NEEDS = {"ann": ("vm",), "feat2": ("feat",), "pred": ("feat",), "labeled": ("vm", "ann", "feat"), "clustered": ("feat",)}


def with_relations(names: str, body: str) -> str:
    """The body with the named relations, and what they need, as common table expressions."""
    wanted: list[str] = []

    def add(name: str) -> None:
        for n in _NEEDS.get(name, ()):
            add(n)
        if name not in wanted:
            wanted.append(name)

    for name in names.split():
        add(name)
    # a recursive body brings its own tables
    if not wanted:
        return body
    ctes = ", ".join(f"{n} as ({CTES[n]})" for n in wanted)
    if body.lstrip().startswith("with recursive "):
        return f"with recursive {ctes}, {body.lstrip()[len('with recursive '):]}"
    if body.lstrip().startswith("with "):
        return f"with {ctes}, {body.lstrip()[len('with '):]}"
    return f"with {ctes} {body}"


class Relations:
    """The same relations as DataFrames."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    @cached_property
    def events(self) -> DataFrame:
        return self.raw("events").withColumn("ts", F.col("ts").cast("timestamp"))

    @cached_property
    def vm(self) -> DataFrame:
        span = (F.unix_micros(F.max("ts")) - F.unix_micros(F.min("ts"))) / F.lit(1e6)
        out = self.events.groupBy(F.col("user_id").alias("vid")).agg(F.min("ts").alias("vstart"), span.alias("vduration"))
        return out.select("vid", F.format_string("/videos/%d.mp4", "vid").alias("vpath"), "vstart", "vduration", F.format_string("/thumbs/%d.jpg", "vid").alias("thumbpath"))

    @cached_property
    def ann(self) -> DataFrame:
        e, v = self.events, self.vm.select("vid", "vstart")
        start = (F.unix_micros("ts") - F.unix_micros("vstart")) / F.lit(1e6)
        both = e.join(v, e["user_id"] == v["vid"])
        return both.select(F.col("event_id").alias("aid"), "vid", start.alias("start_time"), (start + 360 * F.col("value")).alias("end_time"), F.col("event_type").alias("label"), F.col("ts").alias("label_time"))

    @cached_property
    def feat(self) -> DataFrame:
        top = self.events.agg((F.max("user_id") + 1).alias("n"))  # one row
        e = self.raw("embeddings").select("vec_id", "embedding", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("k")).crossJoin(F.broadcast(top))
        hour = ((F.col("vec_id") * 37 + F.col("k") * 101) % 700) * 3600
        return e.select((F.col("vec_id") * 3 + F.col("k")).alias("fid"), ((F.col("vec_id") * 7 + F.col("k") * 11) % F.col("n")).alias("vid"), hour.cast("double").alias("start_time"), (hour + 1800).cast("double").alias("end_time"), F.col("embedding").alias("feature"))

    @cached_property
    def feat2(self) -> DataFrame:
        f = self.feat.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(3))))
        return f.select((F.col("fid") * 4 + F.col("k")).alias("fid"), "vid", (F.col("start_time") + 150 + 400 * F.col("k")).alias("start_time"), (F.col("start_time") + 450 + 400 * F.col("k")).alias("end_time"), F.reverse("feature").alias("feature"))

    @cached_property
    def pred(self) -> DataFrame:
        part = F.transform(F.slice("feature", 1, 5), lambda x: F.abs(x.cast("double")))
        p = lambda i: F.element_at("p", i)
        total = p(1) + p(2) + p(3) + p(4) + p(5)
        f = self.feat.select("vid", "start_time", "end_time", part.alias("p"))
        rows = F.array(*[F.struct(F.lit(x).alias("label"), (p(i) / total).alias("probability")) for i, x in enumerate(LABELS, 1)])
        return f.select(F.lit(1).alias("mid"), "vid", "start_time", "end_time", F.explode(rows).alias("x")).select("mid", "vid", "start_time", "end_time", "x.label", "x.probability")

    @cached_property
    def cents(self) -> DataFrame:
        """events with their value in hundredths as `c`."""
        return self.events.withColumn("c", F.round(F.col("value") * 100).cast("bigint"))

    @cached_property
    def models(self) -> DataFrame:
        mid = F.col("event_id") % 10
        own = self.events.where(mid.between(1, 6)).groupBy(mid.cast("int").alias("mid"), "event_type").agg(F.max("ts").alias("ts"), F.count("*").alias("n"))
        w = Window.partitionBy("mid")  # a row a type
        own = own.withColumn("often", F.col("n") * F.count("*").over(w) >= F.sum("n").over(w))
        out = own.groupBy("mid").agg(F.max("ts").alias("creation_time"), F.array_sort(F.collect_list(F.when(F.col("often"), F.col("event_type")))).alias("labels"), F.sum("n").cast("int").alias("ntrain"))
        name = F.when(F.col("mid") % 3 == 0, "clip").when(F.col("mid") == 5, "r3d+clip").otherwise("r3d")
        return out.select("mid", name.alias("feature_name"), "creation_time", "labels", (F.col("mid") / F.lit(16.0)).alias("f1_threshold"), "ntrain")

    @cached_property
    def loglines(self) -> DataFrame:
        # stored, as whoever reads the lines would repeat their making in each of its expressions
        rows = self.cents.select(F.concat(F.lit("u"), F.col("user_id").cast("string"), F.lit(".txt")).alias("file"), F.col("event_id").cast("bigint").alias("line_no"), F.expr(_line_sql(True)).alias("line"))
        return stored(rows, "loglines")

    @cached_property
    def scores(self) -> DataFrame:
        y = F.sum("c") / (F.count("*") * F.lit(12800.0))
        return self.cents.groupBy(F.concat(F.lit("f"), F.col("event_type")).alias("feature_name"), (F.col("event_id") % 12 + 1).cast("bigint").alias("t")).agg(y.alias("y"))

    @cached_property
    def clustered(self) -> DataFrame:
        return self.feat.withColumn("cluster", F.floor(F.element_at("feature", 1).cast("double") * 20) % 5)
