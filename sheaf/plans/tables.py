"""Queries over whole tables: manifests, filters, projections, look-ups, aggregates and order."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as N
from ..operators import aggregates as A
from ..operators import celled, ordering
from ..operators import filters as P
from ..operators import joins as J
from .book import neighbours_sql, query, table

DUR = "list_max(list_transform(ts_by_words, lambda x: x.\"end\")) - list_min(list_transform(ts_by_words, lambda x: x.\"begin\"))"


def segments(spark: SparkSession, d: str) -> DataFrame:
    """Segments of speech once each: rows delivered again have the same content, so the columns are compared as such."""
    s = table(spark, d, "audioseg")
    dur = F.array_max(F.col("ts_by_words")["end"]) - F.array_min(F.col("ts_by_words")["begin"])
    return s.select("seg_id", "source_id", "speaker_name", "file_path", F.round(dur, 3).alias("seconds")).distinct()


SEG = f"(select distinct seg_id, source_id, speaker_name, file_path, round({DUR}, 3) as seconds from audioseg)"


# manifests and splits
@query("""select seg_id, split_part(line, '|', 1) as path from (select distinct seg_id, file_path || '|' || '0' as line, file_path from audioseg)
  where (contains(file_path, '/EN/') or contains(file_path, '/RU/')) and not contains(file_path, 'Belo') and not contains(file_path, '/000/')""")
def manifest_include_exclude(spark, d):
    seg = table(spark, d, "audioseg").select("seg_id", "file_path").distinct()
    kept = seg.where(P.include(F.col("file_path"), ["/EN/", "/RU/"]) & P.exclude(F.col("file_path"), ["Belo", "/000/"]))
    return kept.select("seg_id", P.without_label(F.concat_ws("|", "file_path", F.lit("0"))).alias("path"))


def _split_sql(bounds: dict[str, tuple[float, float]]) -> str:
    parts = " union all ".join(f"select doc_id, '{s}' as subset_name from r where p >= least(floor(n * {a}::double), n - 1) and p < floor(n * {b}::double)" for s, (a, b) in bounds.items())
    return f"with r as (select doc_id, row_number() over (order by doc_id) - 1 as p, count(*) over () as n from documents) {parts}"


AUTO = {"train": (0.0, 0.8), "valid": (0.8, 0.9), "test": (0.9, 1.0)}
OVERLAP = {"train": (0.0, 0.9), "valid": (0.75, 1.0)}


@query(_split_sql(AUTO))
def manifest_split_auto(spark, d):
    return ordering.fraction_split(table(spark, d, "documents").select("doc_id"), "doc_id", AUTO).select("doc_id", F.col("subset").alias("subset_name"))


@query(_split_sql(OVERLAP))
def manifest_split_overlap(spark, d):
    return ordering.fraction_split(table(spark, d, "documents").select("doc_id"), "doc_id", OVERLAP).select("doc_id", F.col("subset").alias("subset_name"))


@query("""with l as (select line_id, case when line_id % 700 = 13 then '[TRAIN]' when line_id % 700 = 450 then '[TEST]' else raw_line end as line from metadata),
  h as (select *, nullif(regexp_extract(trim(line), '^\\[([^\\]|]+)\\]$', 1), '') as head from l)
  select line_id, f as subset from (select line_id, head, last_value(head ignore nulls) over (order by line_id rows unbounded preceding) as f from h) where head is null""")
def manifest_split_manual(spark, d):
    lines = table(spark, d, "metadata").select("line_id", F.when(F.col("line_id") % 700 == 13, "[TRAIN]").when(F.col("line_id") % 700 == 450, "[TEST]").otherwise(F.col("raw_line")).alias("line"))
    return ordering.header_split(lines, "line_id", "line").select("line_id", "subset")


@query("select doc_id from (select doc_id, row_number() over (order by doc_id) - 1 as p, count(*) over () as n from documents) where p < floor(n * 0.3::double)")
def manifest_split_prefix(spark, d):
    return ordering.fraction_split(table(spark, d, "documents").select("doc_id"), "doc_id", {"first": (0.0, 0.3)}).select("doc_id")


@query("select folder, count(*) as n, min(seg_id) as first_seg from (select distinct seg_id, regexp_replace(file_path, '/[^/]*$', '') as folder from audioseg) group by 1")
def files_by_folder(spark, d):
    seg = table(spark, d, "audioseg").select("seg_id", F.regexp_replace("file_path", "/[^/]*$", "").alias("folder")).distinct()
    return seg.groupBy("folder").agg(F.count(F.lit(1)).alias("n"), F.min("seg_id").alias("first_seg"))


@query(f"select seg_id, (row_number() over (order by seg_id) - 1) // 2000 as folder from {SEG}")
def segment_folders(spark, d):
    return ordering.positions(segments(spark, d).select("seg_id"), "seg_id").select("seg_id", F.floor((F.col("pos") - 1) / 2000).alias("folder"))


@query("select source_id, min(audio_path) as audio_path from (select source_id, audio_path from audiobook where audio_path is not null) group by 1")
def audio_locate(spark, d):
    books = table(spark, d, "audiobook").where("audio_path is not null")
    rank = F.array_position(F.array(*map(F.lit, ("wav", "flac", "opus", "ogg", "mp3"))), F.regexp_extract("audio_path", r"\.([a-z0-9]+)$", 1))
    return books.groupBy("source_id").agg(F.min_by("audio_path", F.struct(rank, "audio_path")).alias("audio_path"))


# filters and projections
@query("select doc_id from documents where n_chars between 200 and 5000")
def duration_band_filter(spark, d):
    return P.band(table(spark, d, "documents"), F.col("n_chars"), 200, 5000).select("doc_id")


@query("select l_orderkey, max(l_quantity) < 48 as kept, max(l_quantity) < 48 and min(l_quantity) > 2 as kept_strict from lineitem group by 1")
def unit_length_outliers(spark, d):
    units = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.min("l_quantity").alias("a"), F.max("l_quantity").alias("b"))
    both = F.array("a", "b")
    return units.select("l_orderkey", P.unit_outliers(both, 2.0, 48.0).alias("kept"), P.unit_outliers(both, 2.0, 48.0, strict=True).alias("kept_strict"))


@query("select doc_id, (count(*) over (partition by lang)) + (count(*) over (partition by source)) - 2 as neighbours from documents qualify neighbours >= 400")
def neighbor_filter(spark, d):
    return P.neighbour_counts(table(spark, d, "documents").select("doc_id", "lang", "source"), ["lang", "source"]).where("neighbours >= 400").select("doc_id", "neighbours")


@query(f"select seg_id from {SEG} where speaker_name in (select speaker_name from {SEG} group by 1 having count(*) >= 30)")
def min_samples_filter(spark, d):
    return P.frequent(segments(spark, d), "speaker_name", 30).select("seg_id")


@query(f"select seg_id from {SEG} where speaker_name in (select speaker_name from {SEG} group by 1 having sum(seconds::decimal(38,6)) / 3600 > 0.05)")
def min_hours_filter(spark, d):
    return P.long_enough(segments(spark, d), "speaker_name", F.col("seconds"), 0.05).select("seg_id")


@query("select name, hours from (select speaker_name as name, round(sum(seconds::decimal(38,6))::double / 3600, 8) as hours from " + SEG + " group by 1) where hours > 0.02 and hours < 5")
def speakers_by_hours(spark, d):
    return A.hours(segments(spark, d), ["speaker_name"], F.col("seconds")).where("hours > 0.02 and hours < 5").select(F.col("speaker_name").alias("name"), "hours")


@query("select doc_id from documents where lang in (select lower(lang) from languages where root in ('EN', 'KK', 'JA'))")
def allowlist_semi(spark, d):
    allowed = table(spark, d, "languages").where("root in ('EN', 'KK', 'JA')").select(F.lower("lang").alias("lang"))
    return P.members(table(spark, d, "documents"), "lang", allowed, "lang").select("doc_id")


@query("select doc_id from documents where source is null or source not in (select source from documents where source is not null group by 1 having count(*) > 100)")
def blacklist_anti(spark, d):
    docs = table(spark, d, "documents")
    return P.strangers(docs, "source", docs.groupBy("source").agg(F.count(F.lit(1)).alias("n")).where("n > 100"), "source").select("doc_id")


@query("select source_id from audiobook where source_id not in (select source_id from audioseg where source_id is not null)")
def dump_resume_anti(spark, d):
    return P.strangers(table(spark, d, "audiobook"), "source_id", table(spark, d, "audioseg"), "source_id").select("source_id")


@query("select source_id from audiobook where transcription is null")
def untranscribed(spark, d):
    return table(spark, d, "audiobook").where("transcription is null").select("source_id")


@query("""select distinct seg_id, coalesce(text = upper(text) and text <> lower(text), false) as shouting, seg_id in (select seg_id from (select seg_id, unnest(string_split_regex(text, '\\s+')) as w from (select distinct seg_id, text from audioseg))
  where length(w) > 1 group by seg_id, w having count(*) >= 3) as repeated from audioseg""")
def hallucinated(spark, d):
    text = F.col("text")
    return table(spark, d, "audioseg").select("seg_id", P.shouting(text).alias("shouting"), P.repeated_word(text, 3).alias("repeated")).distinct()


@query("""select doc_id, case when regexp_matches(file_path, 'questions?_[0-9]') then regexp_extract(file_path, 'questions?_(.)', 1)::int + 10
  when regexp_extract(rtrim(text, ' \t\n\r'), '([?!])["”»’)]*$', 1) = '?' then 2 when regexp_extract(rtrim(text, ' \t\n\r'), '([?!])["”»’)]*$', 1) = '!' then 1 else 0 end as kind,
  case when contains(text, '?!') then 0 when contains(text, '...') then 1 when contains(text, '?') then 2 when contains(text, '!') then 3 else -1 end as mark from documents""")
def intonation_class(spark, d):
    docs = table(spark, d, "documents")
    text = F.regexp_replace("text", r"[ \t\n\r]+$", "")
    return docs.select("doc_id", P.intonation(text, F.col("file_path")).alias("kind"), P.first_mark(F.col("text"), ["?!", "...", "?", "!"]).alias("mark"))


@query("select line_id, try_cast(split_part(raw_line, '|', 3) as bigint) as as_int, split_part(raw_line, '|', 1) as as_text from metadata")
def label_cast(spark, d):
    part = lambda i: F.split_part("raw_line", F.lit("|"), F.lit(i))
    return table(spark, d, "metadata").select("line_id", P.cast_label(F.when(part(3).rlike("^[0-9]+$"), part(3)), "int").alias("as_int"), P.cast_label(part(1), "str").alias("as_text"))


@query("select distinct seg_id, split_part(replace(file_path, 'SEGS/', ''), '/', 2) as speaker from audioseg")
def path_component(spark, d):
    return table(spark, d, "audioseg").select("seg_id", P.component(F.col("file_path"), "SEGS/", 1).alias("speaker")).distinct()


@query("select o_orderkey, coalesce(case when o_orderstatus = 'F' then null else round(o_totalprice * 2, 2) end, o_totalprice) as price, coalesce(case when o_orderkey % 3 = 0 then o_orderpriority end, 'none') as priority from orders")
def coalesce_update(spark, d):
    o = table(spark, d, "orders").withColumn("priority", F.lit("none"))
    new = {"o_totalprice": F.when(F.col("o_orderstatus") != "F", F.round(F.col("o_totalprice") * 2, 2)), "priority": F.when(F.col("o_orderkey") % 3 == 0, F.col("o_orderpriority"))}
    return P.update(o, new).select("o_orderkey", F.col("o_totalprice").alias("price"), "priority")


@query("select c_custkey, c_mktsegment, c_nationkey from customer")
def store_restore_field(spark, d):
    c = P.store_field(P.store_field(table(spark, d, "customer"), "c_mktsegment", "side"), "c_nationkey", "side")
    wiped = c.withColumns({"c_mktsegment": F.lit(None).cast("string"), "c_nationkey": F.lit(-1)})
    return P.restore_field(P.restore_field(wiped, "c_mktsegment", "side"), "c_nationkey", "side").select("c_custkey", "c_mktsegment", "c_nationkey")


# look-ups and pairings
@query("with n as (select name, row_number() over (order by name) - 1 as id from (select distinct source as name from documents where source is not null)) select name, id from n")
def speaker_ids(spark, d):
    return J.dense_ids(table(spark, d, "documents"), "source").select("name", F.col("id").cast("bigint").alias("id"))


@query("""with n as (select name, row_number() over (order by name) - 1 as id from (select lang as name from documents where lang is not null union select 'xx'))
  select doc_id, coalesce(id, 0) as lang_id, id is not null as is_known from documents left join n on lang = name""")
def lang_ids(spark, d):
    docs = table(spark, d, "documents")
    return J.with_ids(docs, "lang", J.dense_ids(docs, "lang", ["xx"]), "lang_id").select("doc_id", F.col("lang_id").cast("bigint").alias("lang_id"), "is_known")


@query(f"""with n as (select name, row_number() over (order by name) - 1 as id from (select distinct name from speakers))
  select seg_id, coalesce(id, 0) as speaker_id, id is not null as is_known from {SEG} left join n on speaker_name = name""")
def unknown_speaker_zero(spark, d):
    ids = J.dense_ids(table(spark, d, "speakers"), "name")
    return J.with_ids(segments(spark, d), "speaker_name", ids, "speaker_id").select("seg_id", F.col("speaker_id").cast("bigint").alias("speaker_id"), "is_known")


@query("select event_id, round(value - m, 8) as centred from events join (select event_type, user_id, avg(value::decimal(18,2)) as m from events group by 1, 2) using (event_type, user_id)")
def range_lookup_join(spark, d):
    e = table(spark, d, "events")
    dim = e.groupBy("event_type", "user_id").agg((F.sum(F.col("value").cast("decimal(18,2)")).cast("double") / F.count("value")).alias("m"))
    return J.look_up(e, dim, ["event_type", "user_id"], ["m"]).select("event_id", F.round(F.col("value") - F.col("m"), 8).alias("centred"))


MEANS = "(select label, p, avg(x::double) as m from (select label, generate_subscripts(embedding, 1) as p, unnest(embedding) as x from embeddings) group by 1, 2)"


@query(f"""with c as (select label, list(m order by p) as v from {MEANS} where label % 2 = 0 group by 1)
  select vec_id, arg_min(c.label, (round(list_distance(list_transform(embedding, lambda x: x::double), v), 9), c.label)) as known from embeddings, c group by vec_id""")
def nearest_known_speaker(spark, d):
    e = table(spark, d, "embeddings")
    centres = A.as_vectors(A.mean_vector(e, "label", "embedding"), "label").where("label % 2 = 0").select(F.col("label").cast("bigint").alias("name"), F.col("vector").alias("centre"))
    return J.nearest(e, "embedding", centres).select("vec_id", F.col("nearest").cast("int").alias("known"))


@query(f"""with c as (select label, list(m order by p) as v from {MEANS} group by 1)
  select vec_id, 1 + arg_min(c.label, (round(list_distance(list_transform(embedding, lambda x: x::double), v), 9), c.label)) as unit, round(min(list_distance(list_transform(embedding, lambda x: x::double), v)), 6) as distance from embeddings, c group by vec_id""")
def nearest_centroid(spark, d):
    e = table(spark, d, "embeddings")
    centres = A.as_vectors(A.mean_vector(e, "label", "embedding"), "label").select(F.col("label").cast("bigint").alias("name"), F.col("vector").alias("centre"))
    return J.nearest(e, "embedding", centres).select("vec_id", (F.col("nearest") + 1).cast("int").alias("unit"), F.round("nearest_distance", 6).alias("distance"))


@query("""select query_id, vec_id, row_number() over (partition by query_id order by s desc, vec_id) as rank, round(s, 6) as similarity from
  (select q.vec_id as query_id, e.vec_id, round(list_cosine_similarity(list_transform(q.embedding, lambda x: x::double), list_transform(e.embedding, lambda x: x::double)), 9) as s from embeddings q, embeddings e where q.vec_id % 50 = 0 and q.vec_id <> e.vec_id) qualify rank <= 5""")
def cosine_topk(spark, d):
    e = table(spark, d, "embeddings")
    top = J.top_similar(e, "vec_id", "embedding", e.where("vec_id % 50 = 0"), 5)
    return top.select("query_id", "vec_id", F.col("rank").cast("bigint").alias("rank"), F.round("similarity", 6).alias("similarity"))


@query("""with u as (select distinct seg_id, ts_by_words as w, flatten(ts_by_phonemes) as p from audioseg),
  w as (select seg_id, generate_subscripts(w, 1) - 1 as pos, unnest(w) as x from u), p as (select seg_id, generate_subscripts(p, 1) - 1 as pos, unnest(p) as x from u)
  select distinct p.seg_id, p.pos as inner_pos, w.pos as outer_pos from p join w on p.seg_id = w.seg_id and p.x."begin" >= w.x."begin" and p.x."end" <= w.x."end" """)
def interval_containment(spark, d):
    s = table(spark, d, "audioseg").select("seg_id", F.explode(J.inside(F.flatten("ts_by_phonemes"), F.col("ts_by_words"))).alias("p"))
    return s.select("seg_id", F.col("p.inner_pos").cast("bigint").alias("inner_pos"), F.col("p.outer_pos").cast("bigint").alias("outer_pos")).distinct()


@query(f"select * from {neighbours_sql()}")
def neighbor_pairs(spark, d):
    return J.neighbour_pairs(table(spark, d, "documents"), "doc_id", "source", "lang")


@query("""select o.l_orderkey, o.l_partkey, o.l_suppkey, o.l_linenumber, o.i as ordinal, s.l_tax as label from
  (select *, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey) as i from lineitem where l_returnflag <> 'R') o left join
  (select *, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey) as i from lineitem where l_returnflag = 'R') s using (l_orderkey, i)""")
def ordinal_labels(spark, d):
    li = table(spark, d, "lineitem")
    order = ["l_linenumber", "l_partkey", "l_suppkey"]
    marks = li.where("l_returnflag = 'R'").withColumn("label", F.col("l_tax"))
    z = J.zipped(li.where("l_returnflag <> 'R'").select("l_orderkey", *order), marks, "l_orderkey", order, order, "label", F.floor(F.col("l_linenumber") / 4))
    return z.select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", F.col("ordinal").cast("bigint").alias("ordinal"), "label")


@query("select o_orderkey, sum(coalesce(n, 0)) as units from orders left join (select l_orderkey, count(*) as n from lineitem group by 1) on o_orderkey = l_orderkey group by 1")
def stored_features(spark, d):
    n = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"))
    o = table(spark, d, "orders").join(n, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    return o.select("o_orderkey", F.coalesce("n", F.lit(0)).cast("decimal(38,0)").alias("units"))


# aggregates
@query("select lang, count(*) as n from documents group by 1")
def class_histogram(spark, d):
    return A.histogram(table(spark, d, "documents"), "lang")


@query("select event_type, count(*) as n, round(count(*) / (select count(*) from events), 8) as share from events group by 1")
def class_share(spark, d):
    return A.shares(table(spark, d, "events"), "event_type")


@query(f"""with low as (select speaker_name, split_part(file_path, '/', 2) as sub, count(*) as n, round(sum(seconds::decimal(38,6)) / 3600, 3) as hours from {SEG} group by 1, 2)
  select speaker_name, sub, n, hours::double as hours, false as is_total from low union all select speaker_name, null, sum(n)::bigint, sum(hours::decimal(38,3))::double, true from low group by 1""")
def hours_rollup(spark, d):
    return A.hours_by_level(segments(spark, d).withColumn("sub", F.split_part("file_path", F.lit("/"), F.lit(2))), "speaker_name", "sub", F.col("seconds"))


@query("select distinct c_mktsegment from customer")
def value_set(spark, d):
    return table(spark, d, "customer").select("c_mktsegment").distinct()


@query("select source, max(n_chars) as longest, list_aggregate(list(n_chars order by n_chars), 'sum')::bigint as total from documents group by 1")
def longest_sample(spark, d):
    return table(spark, d, "documents").groupBy("source").agg(F.max("n_chars").alias("longest"), F.sum("n_chars").alias("total"))


STATS = """(select user_id, event_type, min(v) as mn, max(v) as mx, avg(v) as mean, var_samp(v) as var, count(*) as n from
  (select user_id, event_type, least(greatest(value, quantile_cont(value, 0.05) over (partition by user_id, event_type)), quantile_cont(value, 0.95) over (partition by user_id, event_type)) as v from events where value > 0.01) group by 1, 2)"""


@query(f"select user_id, event_type, round(mn, 8) as min, round(mx, 8) as max, round(mean, 8) as mean, round(var, 8) as var, n from {STATS}")
def attr_stats(spark, d):
    s = A.sample_stats(table(spark, d, "events"), ["user_id", "event_type"], "value")
    return s.select("user_id", "event_type", *(F.round(c, 8).alias(c) for c in ("min", "max", "mean", "var")), "n")


@query(f"select user_id, round(min(mn), 8) as min, round(max(mx), 8) as max, round(median(mean), 8) as mean, round(median(var), 8) as var, sum(n)::bigint as n from {STATS} group by 1")
def attr_ranges(spark, d):
    return A.speaker_ranges(A.sample_stats(table(spark, d, "events"), ["user_id", "event_type"], "value"), ["user_id"], 8)


@query("select event_type, round(quantile_cont(value, 0.05), 8) as low, round(quantile_cont(value, 0.95), 8) as high from events group by 1")
def quantile_band(spark, d):
    return A.quantile_band(table(spark, d, "events"), ["event_type"], "value")


@query(f"select label, p - 1 as pos, round(m, 6) as mean from {MEANS}")
def mean_vector(spark, d):
    return A.mean_vector(table(spark, d, "embeddings"), "label", "embedding").select("label", F.col("pos").cast("bigint").alias("pos"), F.round("mean", 6).alias("mean"))


@query("select user_id, round(case when max(value) > 0 then avg(value::decimal(18,2)) else 0.5 end, 8) as average from events group by 1")
def speaker_average_default(spark, d):
    return A.average_or_default(table(spark, d, "events").withColumn("value", F.col("value").cast("decimal(18,2)").cast("double")), "user_id", "value", 0.5, 8)


@query("""with d as (select *, x - lag(x) over w as d1, (x - lag(x) over w) - (lag(x) over w - lag(x, 2) over w) as d2 from (select *, l_extendedprice as x from lineitem) window w as (partition by l_orderkey, l_returnflag order by l_linenumber, l_partkey, l_suppkey))
  select l_orderkey, l_returnflag, round(avg(x), 6) as mean, round(median(x), 6) as median, round(max(x), 6) as max, round(min(x), 6) as min, round(max(x) - min(x), 6) as span,
  round(case when count(*) > 2 then avg(d1) else 0 end, 6) as diff, round(case when count(*) > 3 then avg(d2) else 0 end, 6) as bend from d group by 1, 2""")
def segment_stats(spark, d):
    return A.segments(table(spark, d, "lineitem"), ["l_orderkey", "l_returnflag"], "l_extendedprice", ["l_linenumber", "l_partkey", "l_suppkey"], 6)


@query("""with s as (select user_id, avg(value) as m, stddev_pop(value) as s from events group by 1)
  select user_id, round(avg(value), 8) as mean, count(*) as n from events join s using (user_id) where abs(value - m) <= 2 * s + 1e-9 group by 1""")
def outlier_mean(spark, d):
    return A.robust_mean(table(spark, d, "events"), ["user_id"], "value", 8)


@query("select user_id, round(avg(least(greatest(value, a), b)), 10) as mean from events join (select user_id, quantile_cont(value, 0.1) as a, quantile_cont(value, 0.9) as b from events group by 1) using (user_id) group by 1")
def clipped_mean(spark, d):
    return A.clipped_mean(table(spark, d, "events"), ["user_id"], "value", 0.1, 10)


@query(f"select distinct seg_id, round(len(ts_by_words) / nullif({DUR}, 0), 6) as rate from audioseg where len(ts_by_words) > 0")
def speech_rate(spark, d):
    w = F.col("ts_by_words")
    dur = F.array_max(w["end"]) - F.array_min(w["begin"])
    return table(spark, d, "audioseg").where(F.size(w) > 0).select("seg_id", F.round(F.try_divide(F.size(w), dur), 6).alias("rate")).distinct()


@query("""with t as (select case when l_returnflag = 'N' then -100 when l_returnflag = 'A' then 0 else 1 end as t, case when l_quantity > 25 then 1 when l_tax > 0.04 then 0 else 2 end as g from lineitem),
  c as (select t, g, count(*) as n from t where t <> -100 group by 1, 2), k as (select t as c, sum(n) as r, sum(case when t = g then n else 0 end) as h from c group by 1), s as (select g as c, sum(n) as s from c group by 1),
  m as (select r, h, coalesce(h / nullif(s, 0), 0) as p, h / r as q from k left join s using (c))
  select round(sum(h) / sum(r), 8) as accuracy, round(avg(p), 8) as precision, round(avg(q), 8) as recall, round(avg(coalesce(2 * p * q / nullif(p + q, 0), 0)), 8) as f1 from m""")
def confusion_metrics(spark, d):
    li = table(spark, d, "lineitem")
    t = F.when(F.col("l_returnflag") == "N", -100).when(F.col("l_returnflag") == "A", 0).otherwise(1)
    g = F.when(F.col("l_quantity") > 25, 1).when(F.col("l_tax") > 0.04, 0).otherwise(2)
    return A.confusion_metrics(li.select(t.alias("t"), g.alias("g")), "t", "g")


@query("""with h as (select least(floor(l_quantity / 50 * 1000), 999)::bigint as bin, sum((l_tax > 0.04)::int) as p, sum((l_tax <= 0.04)::int) as n from lineitem group by 1),
  c as (select bin, coalesce(sum(p) over (order by bin rows between unbounded preceding and 1 preceding), 0) / sum(p) over () as fnr, sum(n) over (order by bin rows between current row and unbounded following) / sum(n) over () as fpr from h)
  select bin / 1000 as threshold, round((fnr + fpr) / 2, 8) as eer from c order by round(abs(fnr - fpr), 9), bin limit 1""")
def eer(spark, d):
    return A.equal_error_rate(table(spark, d, "lineitem").withColumn("score", F.col("l_quantity") / 50), "score", F.col("l_tax") > 0.04)


@query("""with s as (select l_returnflag as k, l_quantity / 50 as s, (l_tax > 0.04)::int as p from lineitem), c as (select k, s, sum(p) as pos, sum(1 - p) as neg from s group by 1, 2),
  r as (select *, coalesce(sum(pos) over (partition by k order by s rows between unbounded preceding and 1 preceding), 0) as bp, coalesce(sum(neg) over (partition by k order by s rows between unbounded preceding and 1 preceding), 0) as bn, sum(pos) over (partition by k) as np, sum(neg) over (partition by k) as nn from c),
  e as (select *, bp / np as fnr, (nn - bn) / nn as fpr from r) select k as l_returnflag, round(sum(pos * (bn + neg / 2)) / max(np * nn), 8) as auc, round(arg_min((fnr + fpr) / 2, (round(abs(fnr - fpr), 12), -s)), 8) as eer, arg_min(s, (round(abs(fnr - fpr), 12), -s)) as threshold from e group by 1""")
def ranked_rates(spark, d):
    r = A.ranked_rates(table(spark, d, "lineitem").withColumn("score", F.col("l_quantity") / 50), ["l_returnflag"], "score", F.col("l_tax") > 0.04)
    return r.select("l_returnflag", F.round("auc", 8).alias("auc"), F.round("eer", 8).alias("eer"), "threshold")


@query("select event_id from events qualify row_number() over (partition by user_id, event_type order by ts, event_id) <= 5")
def contour_cap(spark, d):
    return A.capped(table(spark, d, "events"), ["user_id", "event_type"], ["ts", "event_id"], 5).select("event_id")


@query("select event_type, user_id % 8 as pid, count(*) as calls, round(avg(value), 8) as mean_time, round(max(value), 8) as max_time from events group by 1, 2")
def profile_agg(spark, d):
    return A.profile(table(spark, d, "events").withColumn("pid", F.col("user_id") % 8), "event_type", "pid", "value", 8)


@query("""with a as (select name, row_number() over (order by name) - 1 as id from (select distinct lang as name from documents where lang is not null)), b as (select name, row_number() over (order by name) - 1 as id from (select distinct lang as name from speakers where lang is not null))
  select name, id from a union all select name, (select max(id) + 1 from a) + row_number() over (order by id) - 1 from b where name not in (select name from a)""")
def merged_ids(spark, d):
    a, b = J.dense_ids(table(spark, d, "documents"), "lang"), J.dense_ids(table(spark, d, "speakers"), "lang")
    return A.merged_ids(a, b).select("name", F.col("id").cast("bigint").alias("id"))


@query("select lang, median(n_chars) as median_len, count(*) filter (n_chars < 500) as short, count(*) filter (n_chars >= 500) as long from documents group by 1")
def length_stats(spark, d):
    docs = table(spark, d, "documents")
    middle = A.quantiles(docs, ["lang"], "n_chars", [0.5]).select(F.col("lang").alias("_l"), F.col("q")[0].alias("median_len"))
    n = docs.groupBy("lang").agg(F.count_if(F.col("n_chars") < 500).alias("short"), F.count_if(F.col("n_chars") >= 500).alias("long"))
    return n.join(middle, n["lang"].eqNullSafe(F.col("_l")), "left").select("lang", "median_len", "short", "long")


# order, sets and windows
@query("select doc_id, n_chars, row_number() over (order by n_chars desc, doc_id) as rank from documents qualify rank <= 100")
def length_sort_topk(spark, d):
    top = table(spark, d, "documents").select("doc_id", "n_chars").orderBy(F.desc("n_chars"), "doc_id").limit(100)
    return ordering.positions(top.withColumn("_d", -F.col("n_chars")), "doc_id", ["_d"], "rank").select("doc_id", "n_chars", "rank")


@query("select doc_id from documents order by doc_id limit 500")
def head_before_shuffle(spark, d):
    h = ordering.head(table(spark, d, "documents").select("doc_id"), "doc_id", 500)
    return h.orderBy(ordering.shuffle_key("doc_id", 3)).select("doc_id")


@query("select doc_id as id, source as name from documents union all select source_id, speaker_name from audiobook")
def union_all(spark, d):
    a = table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("source").alias("name"))
    return a.unionByName(table(spark, d, "audiobook").select(F.col("source_id").alias("id"), F.col("speaker_name").alias("name")))


@query("select distinct name from speakers where name not in (select speaker_name from audioseg where speaker_name is not null)")
def names_without_segments(spark, d):
    return table(spark, d, "speakers").select("name").subtract(table(spark, d, "audioseg").select(F.col("speaker_name").alias("name")))


@query("select name from speakers union select speaker_name from audiobook")
def name_union(spark, d):
    return table(spark, d, "speakers").select("name").union(table(spark, d, "audiobook").select("speaker_name")).distinct()


def day(c: str = "ts"):
    return F.to_date(c)


@query("select event_id, epoch_us(ts) - epoch_us(lag(ts) over (partition by user_id order by ts, event_id)) as gap from events")
def gap_to_prev(spark, d):
    e = celled.lag(table(spark, d, "events"), ["user_id"], ["ts", "event_id"], day(), {"prev": "ts"})
    sec = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    return e.select("event_id", (sec("ts") - sec("prev")).alias("gap"))


@query("select event_id, lag(event_type) over w as prev_type, lead(event_type) over w as next_type from events window w as (partition by user_id order by ts, event_id)")
def prev_next_context(spark, d):
    e = celled.lag(table(spark, d, "events"), ["user_id"], ["ts", "event_id"], day(), {"prev_type": "event_type"})
    return celled.lead(e, ["user_id"], ["ts", "event_id"], day(), {"next_type": "event_type"}).select("event_id", "prev_type", "next_type")


@query("select l_orderkey, l_partkey, l_suppkey, l_linenumber, s - l_quantity as begin, s as \"end\" from (select *, sum(l_quantity) over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_quantity rows unbounded preceding) as s from lineitem)")
def cum_bounds(spark, d):
    li = table(spark, d, "lineitem")
    s = celled.running_sum(li, ["l_orderkey"], ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity"], F.floor(F.col("l_linenumber") / 4), F.col("l_quantity"), "s", most=100_000)
    return s.select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", (F.col("s") - F.col("l_quantity")).alias("begin"), F.col("s").alias("end"))


@query("select event_id, first_value(case when value > 100 then value end ignore nulls) over (partition by user_id order by ts, event_id rows between current row and unbounded following) as next_high from events")
def backward_fill(spark, d):
    e = table(spark, d, "events").withColumn("high", F.when(F.col("value") > 100, F.col("value")))
    return celled.filled(e, ["user_id"], ["ts", "event_id"], day(), "high", "next_high", reverse=True).select("event_id", "next_high")


@query("select doc_id, md5(coalesce(text, '')) as digest, sha256(regexp_replace(file_path, '\\.[^./]*$', '')) as path_key from documents")
def path_keys(spark, d):
    return table(spark, d, "documents").select("doc_id", F.md5(F.coalesce("text", F.lit(""))).alias("digest"), N.path_key(F.col("file_path")).alias("path_key"))


@query("select source_id, printf('%d:%02d:%02d', s // 3600, (s // 60) % 60, s % 60) as clock from (select source_id, floor(transcription.timestamps[-1].\"end\")::bigint as s from audiobook where len(transcription.timestamps) > 0)")
def clock_text(spark, d):
    end = F.element_at("transcription.timestamps", -1)["end"]
    return table(spark, d, "audiobook").where(F.size("transcription.timestamps") > 0).select("source_id", N.clock(end).alias("clock"))
