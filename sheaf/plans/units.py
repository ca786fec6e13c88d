"""Queries over units: intervals, durations, tags, batches, signals, alignments."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as N
from ..operators import align, celled, collate, joins, ordering, samplers
from ..operators import signal as S
from ..operators import text as X
from ..operators import timeline as T
from .book import neighbours_sql, query, table

# rows delivered again have the same content
W = """(select seg_id, p - 1 as pos, x."begin" as b, x."end" as e, n from (select seg_id, generate_subscripts(w, 1) as p, unnest(w) as x, len(w) as n from (select distinct seg_id, ts_by_words as w from audioseg)))"""
WV = f"(select * from {W} where seg_id not in (select seg_id from {W} where b is null or e is null))"
D = "(select seg_id, generate_subscripts(d, 1) - 1 as word, unnest(d) as d from (select distinct seg_id, list_transform(ts_by_phonemes, lambda u: len(u)) as d from audioseg))"
V = "(select vec_id, generate_subscripts(embedding, 1) - 1 as i, unnest(embedding)::double as x from embeddings)"


def words(spark, d, valid: bool = False):
    s = table(spark, d, "audioseg").select("seg_id", F.col("ts_by_words").alias("w")).distinct()
    return s.where(F.forall("w", lambda x: x["begin"].isNotNull() & x["end"].isNotNull())) if valid else s


def tall(df, c: str, digits: int = 8):
    t = df.select("seg_id", F.posexplode(c).alias("pos", "x"))
    return t.select("seg_id", F.col("pos").cast("bigint").alias("pos"), F.round("x.begin", digits).alias("b"), F.round("x.end", digits).alias("e"))


def unit_counts(spark, d):
    s = table(spark, d, "audioseg").select("seg_id", F.transform("ts_by_phonemes", lambda u: F.coalesce(F.size(u), F.lit(0))).alias("d"))
    return s.distinct()


def vectors(spark, d):
    return table(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))


# intervals
@query(f"""select seg_id, bool_and(e >= b) and coalesce(bool_and(gap >= -1e-4), true) as ok from (select *, b - lag(e) over (partition by seg_id order by pos) as gap from {WV}) group by 1""")
def ts_valid(spark, d):
    return words(spark, d, True).where(F.size("w") > 0).select("seg_id", T.is_valid(F.col("w")).alias("ok"))


@query(f"select seg_id, pos, round(b + 1.5, 8) as b, round(e + 1.5, 8) as e from {W}")
def ts_shift(spark, d):
    return tall(words(spark, d).withColumn("t", T.shifted(F.col("w"), 1.5)), "t")


@query(f"select seg_id, pos, trunc(b * 22050)::bigint as b, trunc(e * 22050)::bigint as e from {W}")
def ts_to_samples(spark, d):
    t = words(spark, d).select("seg_id", F.posexplode(T.to_samples(F.col("w"), 22050)).alias("pos", "x"))
    return t.select("seg_id", F.col("pos").cast("bigint").alias("pos"), F.col("x.begin").alias("b"), F.col("x.end").alias("e"))


@query(f"select seg_id, pos, round(s - (e - b), 8) as b, round(s, 8) as e from (select *, sum(e - b) over (partition by seg_id order by pos) as s from {WV})")
def ts_from_durations(spark, d):
    return tall(words(spark, d, True).withColumn("t", T.from_durations(T.durations(F.col("w")))), "t")


@query(f"""with s as (select seg_id, max(case when pos = 0 then e - b end) as l, max(case when pos = n - 1 then e end) - max(case when pos = 1 then b end) as r, max(case when pos = 0 then b end) as b0 from {WV} where n > 1 group by 1),
  m as (select *, least(0.05, r * 0.99) as m from s), c as (select w.seg_id, w.pos, b0, (w.e - w.b) * case when w.pos < 1 then (l + m) / l else (r - m) / r end as dd from {WV} w join m using (seg_id) where l > 0.01 and r > 0.06)
  select seg_id, pos, round(b0 + s - dd, 6) as b, round(b0 + s, 6) as e from (select *, sum(dd) over (partition by seg_id order by pos) as s from c)""")
def ts_rescale(spark, d):
    w = F.col("w")
    some = words(spark, d, True).where((F.size(w) > 1) & (F.get(w, F.lit(0))["end"] - F.get(w, F.lit(0))["begin"] > 0.01) & (T.end(w) - F.get(w, F.lit(1))["begin"] > 0.06))
    return tall(some.withColumn("t", T.moved_boundary(w, 1, F.lit(0.05))), "t", 6)


@query("""select seg_id, w - 1 as pos, round(min(x."begin"), 8) as b, round(max(x."end"), 8) as e from (select seg_id, w, unnest(u) as x from (select seg_id, generate_subscripts(p, 1) as w, unnest(p) as u from (select distinct seg_id, ts_by_phonemes as p from audioseg))) group by 1, 2""")
def words_from_units(spark, d):
    s = table(spark, d, "audioseg").select("seg_id", T.word_spans(F.col("ts_by_phonemes")).alias("t")).distinct()
    return tall(s, "t").where("seg_id is not null").join(unit_counts(spark, d).select("seg_id", F.posexplode("d").alias("pos", "n")).where("n > 0").select("seg_id", "pos"), ["seg_id", "pos"], "left_semi")


@query(f"select seg_id, pos, k, round(b + k * (e - b) / 3, 8) as b, round(b + (k + 1) * (e - b) / 3, 8) as e from {W}, (select unnest([0, 1, 2]) as k)")
def units_from_words(spark, d):
    t = words(spark, d).select("seg_id", F.posexplode("w").alias("pos", "x"))
    u = t.select("seg_id", F.col("pos").cast("bigint").alias("pos"), F.posexplode(T.equal_units(F.col("x.begin"), F.col("x.end"), F.lit(3))).alias("k", "y"))
    return u.select("seg_id", "pos", "k", F.round("y.begin", 8).alias("b"), F.round("y.end", 8).alias("e"))


@query("""with s as (select distinct seg_id, ts_bos as a, ts_eos as z, string_split(text, ' ') as w from audioseg where text is not null and ts_bos is not null and ts_eos is not null), t as (select seg_id, a, z, generate_subscripts(w, 1) - 1 as pos, length(unnest(w)) as n from s),
  c as (select *, sum(n) over (partition by seg_id order by pos) as s, sum(n) over (partition by seg_id) as total from t) select seg_id, pos, round(a + (s - n) * (z - a) / total, 9) as b, round(a + s * (z - a) / total, 9) as e from c where total > 0""")
def words_by_length(spark, d):
    s = table(spark, d, "audioseg").where("text is not null and ts_bos is not null and ts_eos is not null").select("seg_id", "ts_bos", "ts_eos", F.split("text", " ").alias("w")).distinct()
    return tall(s.withColumn("t", T.by_length(F.col("ts_bos"), F.col("ts_eos"), X.lengths(F.col("w")))), "t", 9)


@query(f"""with s as (select seg_id, first(b order by pos) as b, last(e order by pos) as e from {WV} group by 1) select seg_id, round(b - least(case when seg_id % 2 = 0 then 0.05 else 0.1 end, b - (b - 0.07)), 8) as b, round(e + least(case when seg_id % 3 = 0 then 0.05 else 0.1 end, (e + 0.2) - e), 8) as e from s""")
def audio_strip_bounds(spark, d):
    w = F.col("w")
    s = words(spark, d, True).where(F.size(w) > 0)
    x = T.strip_bounds(w, T.begin(w) - 0.07, T.end(w) + 0.2, 0.1, F.col("seg_id") % 2 == 0, F.col("seg_id") % 3 == 0)
    return s.select("seg_id", F.round(x["begin"], 8).alias("b"), F.round(x["end"], 8).alias("e"))


CLOSED = f"""(select seg_id, pos, n, case when g > 1e-6 and g < 0.1 then b - g / 2 else b end as b, case when h > 1e-6 and h < 0.1 then e + h / 2 else e end as e from (select *, b - lag(e) over w as g, lead(b) over w - e as h from {WV} window w as (partition by seg_id order by pos)))"""


@query(f"select seg_id, pos, round(b, 8) as b, round(e, 8) as e from {CLOSED}")
def small_gaps(spark, d):
    return tall(words(spark, d, True).withColumn("t", T.small_gaps_closed(F.col("w"), 0.1)), "t")


@query(f"""with g as (select *, b - lag(e) over (partition by seg_id order by pos) as g, lag(e) over (partition by seg_id order by pos) as p from {CLOSED}), k as (select seg_id, p, b, greatest(floor(g / 0.05 ), 1)::bigint as m from g where g > 0.1)
  select seg_id, count(*) as units, sum(silent) as silent, round(max(longest), 6) as longest from (select seg_id, 0 as silent, e - b as longest from g union all select seg_id, 1, case when i = m - 1 then b - (p + i * 0.05) else 0.05 end from k, unnest(range(m)) as r(i)) group by 1""")
def silence_insert(spark, d):
    s = words(spark, d, True).where(F.size("w") > 0)
    u = s.select("seg_id", F.explode(T.silence_units(F.col("w"), 0.1, 0.05, T.begin(F.col("w")))).alias("x"))
    return u.groupBy("seg_id").agg(F.count(F.lit(1)).alias("units"), F.count_if(F.col("x.unit").isNull()).alias("silent"), F.round(F.max(F.col("x.end") - F.col("x.begin")), 6).alias("longest"))


@query("""with q as (select doc_id, case doc_id % 4 when 0 then (n_chars % 3000) || 'ms' when 1 then (n_chars % 9) || '.5s' when 2 then 'none' else null end as q, n_chars from documents)
  select doc_id, case when doc_id % 4 = 3 then null when doc_id % 4 = 2 then floor(0.05 / 0.0125 + 1e-9) when doc_id % 4 = 0 then floor(greatest(0.05, least(5, (n_chars % 3000) / 1000)) / 0.0125 + 1e-9) else floor(greatest(0.05, least(5, (n_chars % 9) + 0.5)) / 0.0125 + 1e-9) end::bigint as n from q""")
def ssml_units(spark, d):
    m = F.col("doc_id") % 4
    q = F.when(m == 0, F.concat((F.col("n_chars") % 3000).cast("string"), F.lit("ms"))).when(m == 1, F.concat((F.col("n_chars") % 9).cast("string"), F.lit(".5s"))).when(m == 2, "none")
    return table(spark, d, "documents").select("doc_id", T.ssml_units(q, 0.0125).cast("bigint").alias("n"))


@query(f"select seg_id, row_number() over (partition by seg_id order by word, k) - 1 as pos, round(1.0::double / d, 8) as x from (select seg_id, word, d, unnest(range(d)) as k from {D})")
def inverse_durations(spark, d):
    t = unit_counts(spark, d).select("seg_id", F.posexplode(T.inverse_durations(F.col("d"))).alias("pos", "x"))
    return t.select("seg_id", F.col("pos").cast("bigint").alias("pos"), F.round("x", 8).alias("x"))


@query(f"select seg_id, row_number() over (partition by seg_id order by word, k) - 1 as pos, word from (select seg_id, word, unnest(range(d)) as k from {D})")
def run_length_expand(spark, d):
    s = unit_counts(spark, d).select("seg_id", F.posexplode(T.expanded(N.indices(F.size("d")), F.col("d"))).alias("pos", "x"))
    return s.select("seg_id", F.col("pos").cast("bigint").alias("pos"), F.col("x").cast("bigint").alias("word"))


@query(f"select seg_id, row_number() over (partition by seg_id order by word, k) - 1 as pos, (k = d - 1)::int as last from (select seg_id, word, d, unnest(range(d)) as k from {D})")
def item_ends(spark, d):
    t = unit_counts(spark, d).select("seg_id", F.posexplode(X.item_ends(F.col("d"))).alias("pos", "x"))
    return t.select("seg_id", F.col("pos").cast("bigint").alias("pos"), F.col("x").alias("last"))


@query("select distinct seg_id, least(len(ts_by_words), 12) as n from audioseg where ts_by_words is not null")
def frames_to_mask(spark, d):
    return words(spark, d).where("w is not null").select("seg_id", T.mask_length(T.mask(F.size("w"), F.lit(12))).cast("bigint").alias("n"))


@query(f"""select vec_id, k, j, coalesce(x, 0) as x from (select vec_id, k, j, k * 16 + j - 4 as i from (select vec_id from embeddings), unnest(range(4)) as a(k), unnest(range(24)) as b(j)) left join {V} using (vec_id, i)""")
def window_unfold(spark, d):
    w = vectors(spark, d).select("vec_id", F.posexplode(T.windows(F.col("v"), 16, 4, 4)).alias("k", "y"))
    out = w.select("vec_id", F.col("k").cast("bigint").alias("k"), F.posexplode("y").alias("j", "x"))
    return out.select("vec_id", "k", F.col("j").cast("bigint").alias("j"), "x")


@query("""select vec_id, k, round(v[lo + 1] + (v[least(lo + 2, 64)] - v[lo + 1]) * (place - lo), 8) as x from (select vec_id, k, k * 63 / 19 as place, floor(k * 63 / 19)::bigint as lo, list_transform(embedding, lambda y: y::double) as v from embeddings, unnest(range(20)) as a(k))""")
def lerp_resample(spark, d):
    t = vectors(spark, d).select("vec_id", F.posexplode(N.resample(F.col("v"), F.lit(20))).alias("k", "x"))
    return t.select("vec_id", F.col("k").cast("bigint").alias("k"), F.round("x", 8).alias("x"))


@query()
def frame_bounds(spark, d):
    s = words(spark, d, True).where(F.size("w") > 0)
    w = T.shifted(F.col("w"), -T.begin(F.col("w")))
    hop = 256 / 22050
    return s.select("seg_id", w.alias("w")).select("seg_id", T.to_frames(F.col("w"), F.lit(hop), F.ceil(T.end(F.col("w")) / hop).cast("int")).alias("f")).select("seg_id", F.size("f.frames").alias("n"), "f.message")


# text
SYMBOLS = ["<UNK>", "the", "и", "in", "и", "de", "la", "der", "was", "a", "an"]


@query("""with t as (select seg_id, generate_subscripts(w, 1) - 1 as pos, unnest(w) as w from (select distinct seg_id, string_split(text, ' ') as w from audioseg where text is not null))
  select seg_id, pos, case w when 'the' then 1 when 'in' then 3 when 'и' then 4 when 'de' then 5 when 'la' then 6 when 'der' then 7 when 'was' then 8 when 'a' then 9 when 'an' then 10 else 0 end as id from t""")
def symbol_ids(spark, d):
    s = table(spark, d, "audioseg").where("text is not null").select("seg_id", F.split("text", " ").alias("w")).distinct()
    t = s.select("seg_id", F.posexplode(X.symbol_ids(F.col("w"), SYMBOLS)).alias("pos", "id"))
    return t.select("seg_id", F.col("pos").cast("bigint").alias("pos"), "id")


@query(f"select seg_id, pos, (case when 2 * pos < n and pos > 0 then 1 else 0 end) + (case when 2 * pos + 1 < n then 1 else 0 end) as dependants from {W}")
def head_counts(spark, d):
    t = words(spark, d).select("seg_id", F.posexplode("w").alias("pos", "x")).select("seg_id", F.col("pos").cast("bigint").alias("pos"), F.when(F.col("pos") > 0, F.floor(F.col("pos") / 2)).alias("head"))
    return X.head_counts(t, "seg_id", "pos", "head").select("seg_id", "pos", "dependants")


@query("select doc_id, coalesce(l.full_name, upper(d.lang)) || '/' || coalesce(source, '') as label from documents d left join languages l on upper(d.lang) = l.lang where d.lang is not null")
def ipa_map(spark, d):
    docs = table(spark, d, "documents").where("lang is not null").select("doc_id", F.array(F.upper("lang"), F.coalesce("source", F.lit(""))).alias("u"))
    return docs.select("doc_id", F.array_join(X.mapped(F.col("u"), table(spark, d, "languages"), "lang", "full_name"), "/").alias("label"))


@query("""with t as (select seg_id, generate_subscripts(u, 1) as p, unnest(u) as u from (select distinct seg_id, regexp_extract_all(orig, '[^\\s.,!?]+|[.,!?]') as u from audioseg where orig is not null)),
  m as (select *, first_value(case when u in ('.', ',', '!', '?') then u end ignore nulls) over (partition by seg_id order by p rows between current row and unbounded following) as mark from t)
  select seg_id, row_number() over (partition by seg_id order by p) - 1 as pos, coalesce(mark, '') as mark from m where u not in ('.', ',', '!', '?')""")
def punct_propagation(spark, d):
    s = table(spark, d, "audioseg").where("orig is not null").select("seg_id", F.regexp_extract_all("orig", F.lit(r"([^ \t\n\r\f\x0B.,!?]+|[.,!?])"), F.lit(1)).alias("u")).distinct()
    t = s.select("seg_id", F.posexplode(X.marks_ahead(F.col("u"), [".", ",", "!", "?"])).alias("pos", "mark"))
    return t.select("seg_id", F.col("pos").cast("bigint").alias("pos"), "mark")


@query(f"select seg_id, row_number() over (partition by seg_id order by word, k) - 1 as pos, round(greatest(0.1, least(2, case when word % 5 = 4 then 1 else greatest(50, least(200, word * 40)) / 100 end)), 8) as factor from (select seg_id, word, unnest(range(d)) as k from {D})")
def ssml_modifiers(spark, d):
    v = F.transform(N.indices(F.size("d")), lambda i: F.when(i % 5 == 4, "fast").otherwise((i * 40).cast("string")))
    t = unit_counts(spark, d).select("seg_id", F.posexplode(X.modifiers(v, F.col("d"))).alias("pos", "x"))
    return t.select("seg_id", F.col("pos").cast("bigint").alias("pos"), F.round("x", 8).alias("factor"))


@query("select source_id, seg_id // 50 as part, rtrim(string_agg(regexp_replace(orig, '[.!?…]+\\s*$', ''), ', ' order by seg_id)) as joined from (select distinct seg_id, source_id, orig from audioseg where source_id is not null and orig is not null) group by 1, 2")
def joined_sentences(spark, d):
    s = table(spark, d, "audioseg").where("source_id is not null and orig is not null").select("seg_id", "source_id", "orig", F.floor(F.col("seg_id") / 50).alias("part")).distinct()
    g = s.groupBy("source_id", "part").agg(F.transform(F.array_sort(F.collect_list(F.struct("seg_id", "orig"))), lambda x: x["orig"]).alias("p"))  # at most 50 sentences
    return g.select("source_id", "part", F.rtrim(X.joined_sentences(F.col("p"))).alias("joined"))


@query("""with t as (select user_id, ts, event_id, event_type in ('view', 'click') as p, row_number() over (partition by user_id order by ts, event_id) as r from events), g as (select *, r - row_number() over (partition by user_id order by ts, event_id) as g from t where p)
  select user_id, min(ts) as first, max(ts) as last, count(*) as n from g group by user_id, g""")
def pause_islands(spark, d):
    e = table(spark, d, "events").withColumn("o", F.struct("ts", "event_id"))
    i = X.pauses(e.select("user_id", "o", "event_type"), "user_id", "o", F.col("event_type").isin("view", "click"), F.to_date("o.ts"))
    return i.select("user_id", F.col("first.ts").alias("first"), F.col("last.ts").alias("last"), "n")


@query()
def replacement_spans(spark, d):
    s = table(spark, d, "audioseg").where("orig is not null and text is not null").select("seg_id", F.split("orig", " ").alias("a"), F.split("text", " ").alias("b")).distinct()
    return s.select("seg_id", F.explode(align.replacements("a", "b")).alias("s")).select("seg_id", "s.*")


@query()
def nw_align(spark, d):
    s = table(spark, d, "audioseg").where("orig is not null and text is not null").select("seg_id", F.split(F.lower("orig"), " ").alias("a"), F.split("text", " ").alias("b")).distinct()
    return s.select("seg_id", F.posexplode(align.aligned("a", "b")).alias("pos", "x")).select("seg_id", "pos", "x.a", "x.b")


@query()
def text_align(spark, d):
    s = table(spark, d, "audioseg").where("orig is not null and text is not null").select("seg_id", "orig", "text").distinct()
    return s.select("seg_id", align.matched("orig", "text").alias("m")).select("seg_id", F.size("m.target_places").alias("n"))


@query()
def sentence_assignment(spark, d):
    s = table(spark, d, "audioseg").where("source_id is not null").select("source_id", "seg_id", "orig", "text").distinct()
    return align.assign_sentences(s.select("source_id", "seg_id", F.col("orig").alias("t")), s.select("source_id", "seg_id", F.col("text").alias("t")), "source_id", "seg_id", "t")


@query()
def fuzzy_edges(spark, d):
    s = table(spark, d, "audioseg").where("orig is not null and text is not null").select("seg_id", "orig", "text").distinct()
    return s.select("seg_id", X.edges_alike(F.lower("orig"), F.col("text")).alias("alike"))


# batches and samplers
@query("select doc_id, (row_number() over (order by doc_id) - 1) // 32 as batch_id, (row_number() over (order by doc_id) - 1) % 32 as row_in_batch, (row_number() over (order by doc_id) - 1) // 32 = (count(*) over () - 1) // 32 as is_last from documents")
def batch_sequential(spark, d):
    return ordering.sequential_batches(table(spark, d, "documents").select("doc_id"), "doc_id", 32).select("doc_id", "batch_id", "row_in_batch", "is_last")


def _fold_sql(rows: str, limit: float, most: int) -> str:
    return f"""with recursive r as ({rows}), f(k, p, o, batch, s, n) as (select k, p, o, 0::bigint, c, 1 from r where p = 1
  union all select r.k, r.p, r.o, f.batch + (f.s > {limit} or f.n >= {most})::bigint, case when f.s > {limit} or f.n >= {most} then r.c else f.s + r.c end, case when f.s > {limit} or f.n >= {most} then 1 else f.n + 1 end from f join r on r.k is not distinct from f.k and r.p = f.p + 1)"""


@query(_fold_sql("select source as k, doc_id as o, row_number() over (partition by source order by doc_id) as p, n_chars::double as c from documents", 20000, 8) + " select k as source, o as doc_id, batch from f")
def batch_dynamic(spark, d):
    return samplers.dynamic_batches(table(spark, d, "documents"), ["source"], "doc_id", "n_chars", 20000, 8).select("source", "doc_id", "batch")


@query(_fold_sql("select source_id as k, seg_id as o, row_number() over (partition by source_id order by seg_id) as p, len(string_split(text, ' '))::double as c from (select distinct source_id, seg_id, text from audioseg where source_id is not null and text is not null)", 100, 1 << 40) + " select k as source_id, o as seg_id, batch as pack from f")
def pack_text_100(spark, d):
    s = table(spark, d, "audioseg").where("source_id is not null and text is not null").select("source_id", "seg_id", F.size(F.split("text", " ")).alias("n")).distinct()
    return samplers.packed(s, ["source_id"], "seg_id", "n", 100).select("source_id", "seg_id", "pack")


@query("""with recursive r as (select doc_id, b, row_number() over (partition by b order by doc_id desc) as p, n_chars from (select doc_id, n_chars, (row_number() over (order by doc_id) - 1) // 32 as b from documents)),
  f(b, p, doc_id, s, kept) as (select b, p, doc_id, case when n_chars < 30000 then n_chars else 0 end, n_chars < 30000 from r where p = 1 union all select r.b, r.p, r.doc_id, case when f.s + r.n_chars < 30000 then f.s + r.n_chars else f.s end, f.s + r.n_chars < 30000 from f join r on r.b = f.b and r.p = f.p + 1)
  select b as batch_id, doc_id, kept from f""")
def batch_recut(spark, d):
    b = ordering.sequential_batches(table(spark, d, "documents").select("doc_id", "n_chars"), "doc_id", 32)
    return samplers.recut(b, "batch_id", "doc_id", "n_chars", 30000)


@query("select doc_id, (row_number() over (order by n_chars desc, doc_id) - 1) // 16 as batch_id from documents")
def batch_bucketed(spark, d):
    return samplers.bucketed_batches(table(spark, d, "documents"), "doc_id", "n_chars", 16).select("doc_id", "batch_id")


@query(f"with n as (select * from {neighbours_sql()}) select doc_id, 0 as neighbor_idx, neighbour as member from n union all select doc_id, 1, doc_id from n")
def neighbour_doubling(spark, d):
    docs = table(spark, d, "documents")
    return samplers.doubled(docs, "doc_id", joins.neighbour_pairs(docs, "doc_id", "source", "lang"))


@query("select lang, count(*) as n, round(1 / (count(*) * (select count(distinct coalesce(lang, chr(1))) from documents)), 10) as weight from documents group by 1")
def idf_weights(spark, d):
    return samplers.idf_weights(table(spark, d, "documents"), "lang")


@query("select doc_id, 1.0::double / (select count(*) from documents) as weight from documents")
def uniform_weights(spark, d):
    docs = table(spark, d, "documents")
    return docs.select("doc_id", (1.0 / ordering.total(docs)).alias("weight"))


@query("""with t as (select l_orderkey as o, l_returnflag as g from lineitem), r as (select distinct o from t), k as (select * from t where g <> 'N'), tf as (select o, g, count(*) as c from k group by 1, 2), z as (select o, count(*) as t from k group by 1), df as (select g, count(*) as d from tf group by 1),
  s as (select o, sum(c / t * ln(((select count(*) from r) + 1) / (d + 1))) as s from tf join df using (g) join z using (o) group by 1), a as (select r.o, coalesce(s, 0) as s from r left join s using (o)), e as (select o, exp(s - (select max(s) from a)) as e from a)
  select o as l_orderkey, round(e / (select sum(e) from e) * 1000, 8) as weight from e""")
def tfidf_weights(spark, d):
    w = samplers.tfidf_weights(table(spark, d, "lineitem").select("l_orderkey", "l_returnflag"), "l_orderkey", "l_returnflag", ["N"])
    return w.select("l_orderkey", F.round(F.col("weight") * 1000, 8).alias("weight"))


@query("select l_orderkey, count(*) filter (l_returnflag = 'A') as n_A, count(*) filter (l_returnflag = 'N') as n_N, count(*) filter (l_returnflag = 'R') as n_R from lineitem group by 1")
def class_freq_matrix(spark, d):
    return samplers.tag_matrix(table(spark, d, "lineitem"), "l_orderkey", "l_returnflag", ["A", "N", "R"])


def _draws_sql(rows: str, size: int, seed: int) -> str:
    """Draws by weight: the row in whose stretch of the running sum the number of the draw falls."""
    return f"""select draw, doc_id from (select range as draw, ('0x' || left(md5('{seed}:' || range), 13))::bigint / 4503599627370496::double as u from range({size})) d asof join
  (select doc_id, (sum(w) over (order by doc_id) - w)::double / (sum(w) over ())::double as at from (select doc_id, (w)::decimal(38,18) as w from ({rows})) where w > 0) c on d.u >= c.at"""


@query(_draws_sql("select doc_id, coalesce(n_chars, 0) as w from documents", 5000, 11))
def weighted_epoch(spark, d):
    return samplers.weighted_epoch(table(spark, d, "documents"), "doc_id", F.coalesce(F.col("n_chars"), F.lit(0)), 5000, 11)


_LANG = "select doc_id, n.w from documents d join (select lang, round(1 / (count(*) * (select count(distinct coalesce(lang, chr(1))) from documents)), 10) as w from documents group by 1) n on d.lang is not distinct from n.lang"


@query(f"select 'lang' as criterion, * from ({_draws_sql(_LANG, 2400, 0)}) union all select 'uid', * from ({_draws_sql('select doc_id, 1.0 as w from documents', 1600, 1)})")
def multi_criteria_epoch(spark, d):
    docs = table(spark, d, "documents")
    w = samplers.idf_weights(docs, "lang").select("lang", "weight")
    rows = docs.join(joins.small(w), docs["lang"].eqNullSafe(w["lang"])).drop(w["lang"])
    return samplers.multi_criteria_epoch(rows, "doc_id", {"lang": F.col("weight"), "uid": F.lit(1.0)}, 4000, [0.6, 0.4])


@query()
def balanced_fill(spark, d):
    return samplers.balanced_fill(table(spark, d, "lineitem"), "l_orderkey", "l_returnflag", ["A", "N", "R"], 2000)


def _batches(spark, d):
    s = words(spark, d, True).select("seg_id", T.durations(F.col("w")).alias("x"))
    return ordering.sequential_batches(s, "seg_id", 16).select("batch_id", "seg_id", "x")


PAD = f"""with s as (select seg_id, w, (row_number() over (order by seg_id) - 1) // 16 as batch_id from (select distinct seg_id, ts_by_words as w from audioseg where seg_id not in (select seg_id from {W} where b is null or e is null) and ts_by_words is not null)),
  m as (select batch_id, max(len(w)) as m from s group by 1), t as (select batch_id, seg_id, w, len(w) as n, """


@query(PAD + "m as t from s join m using (batch_id)) select batch_id, seg_id, i as idx, round(coalesce(w[i + 1].\"end\" - w[i + 1].\"begin\", -1), 8) as value, i >= n as is_pad from t, unnest(range(t)) as r(i)")
def pad_1d(spark, d):
    p = collate.tall(collate.padded(_batches(spark, d), "batch_id", "x", -1.0), ["batch_id", "seg_id"], "x")
    return p.select("batch_id", "seg_id", F.col("idx").cast("bigint").alias("idx"), F.round("value", 8).alias("value"), "is_pad")


@query(PAD + "(ceil(m / 8) * 8)::bigint as t from s join m using (batch_id)) select batch_id, seg_id, n as length, t as padded, round(n / t, 8) as relative_length from t where t > 0")
def pad_multiple(spark, d):
    p = collate.padded(_batches(spark, d), "batch_id", "x", -1.0, 8).where(F.size("x") > 0)
    return p.select("batch_id", "seg_id", F.col("length").cast("bigint").alias("length"), F.size("x").cast("bigint").alias("padded"), F.round("relative_length", 8).alias("relative_length"))


@query(f"select n.doc_id, n.doc_id as member, d.n_chars, n.neighbour as prompt_member, p.n_chars as prompt_n_chars from {neighbours_sql()} n join documents d using (doc_id) join documents p on p.doc_id = n.neighbour")
def pair_collate(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "source", "lang", "n_chars")
    two = samplers.doubled(docs, "doc_id", joins.neighbour_pairs(docs, "doc_id", "source", "lang"))
    full = two.join(docs.select(F.col("doc_id").alias("member"), "n_chars"), "member")
    return collate.split_pairs(full, "doc_id", ["member", "n_chars"])


# values
@query("select event_id, round((value - mn) / (mx - mn), 11) as x from events join (select user_id, min(value) as mn, max(value) as mx from events group by 1 having max(value) - min(value) >= 1) using (user_id)")
def normalize_minmax(spark, d):
    e = table(spark, d, "events")
    r = e.groupBy("user_id").agg(F.min("value").alias("mn"), F.max("value").alias("mx")).where("mx - mn >= 1")
    return joins.look_up(e, r, ["user_id"], ["mn", "mx"]).select("event_id", F.round((F.col("value") - F.col("mn")) / (F.col("mx") - F.col("mn")), 11).alias("x"))


@query("select event_id, round((value - m) / (4 * s), 11) as x from events join (select user_id, avg(value) as m, stddev_samp(value) as s from events group by 1 having avg(value) >= 1 and var_samp(value) >= 1) using (user_id)")
def normalize_znorm(spark, d):
    e = table(spark, d, "events")
    r = e.groupBy("user_id").agg(F.avg("value").alias("m"), F.stddev_samp("value").alias("s")).where("m >= 1 and s * s >= 1")
    return joins.look_up(e, r, ["user_id"], ["m", "s"]).select("event_id", F.round((F.col("value") - F.col("m")) / (4 * F.col("s")), 11).alias("x"))


@query("select event_id, least(greatest(value, 5), 200) as x from events")
def clip_attr(spark, d):
    return table(spark, d, "events").select("event_id", N.clip(F.col("value"), 5.0, 200.0).alias("x"))


@query(f"select vec_id, i, round(sign(x) * ln(1 + 255 * abs(x)) / ln(256), 8) as x, floor((sign(x) * ln(1 + 255 * abs(x)) / ln(256) + 1) / 2 * 255 + 0.5)::bigint as code from {V}")
def mu_law(spark, d):
    v = vectors(spark, d)
    z = v.select("vec_id", F.posexplode(F.arrays_zip(S.mu_law(F.col("v"), 8).alias("x"), S.mu_law(F.col("v"), 8, True).alias("code"))).alias("i", "z"))
    return z.select("vec_id", F.col("i").cast("bigint").alias("i"), F.round("z.x", 8).alias("x"), "z.code")


@query(f"select vec_id, i, round(x - 0.97 * coalesce(lag(x) over (partition by vec_id order by i), 0), 8) as x from {V}")
def preemphasis(spark, d):
    z = vectors(spark, d).select("vec_id", F.posexplode(S.preemphasis(F.col("v"))).alias("i", "x"))
    return z.select("vec_id", F.col("i").cast("bigint").alias("i"), F.round("x", 8).alias("x"))


@query(f"select vec_id, round(sqrt(sum(x * x)), 8) as energy, round(sqrt(avg(x * x)), 8) as rms, round(regr_slope(x, i), 8) as tilt from {V} group by 1")
def frame_energy(spark, d):
    v = F.col("v")
    return vectors(spark, d).select("vec_id", F.round(N.norm(v), 8).alias("energy"), F.round(S.rms(v), 8).alias("rms"), F.round(S.tilt(v), 8).alias("tilt"))


@query("""select vec_id, i, round((v[i + 1] + v[(i + 1) % 64 + 1] + v[(i + 2) % 64 + 1] + v[(i + 63) % 64 + 1] + v[(i + 62) % 64 + 1]) / 5, 8) as x from (select vec_id, list_transform(embedding, lambda y: y::double) as v, unnest(range(64)) as i from embeddings)""")
def smooth5(spark, d):
    s = N.smoothed(F.col("v"))
    z = vectors(spark, d).select("vec_id", F.posexplode(s).alias("i", "x"))
    return z.select("vec_id", F.col("i").cast("bigint").alias("i"), F.round("x", 8).alias("x"))


@query("""select a.vec_id, round(1 - (1 + list_cosine_similarity(list_transform(a.embedding, lambda x: x::double), list_transform(b.embedding, lambda x: x::double))) / 2, 8) as loss from embeddings a join embeddings b on b.vec_id = a.vec_id + 1""")
def cosine_loss(spark, d):
    v = vectors(spark, d)
    b = v.select((F.col("vec_id") - 1).alias("vec_id"), F.col("v").alias("u"))
    return v.join(b, "vec_id").select("vec_id", F.round(N.cosine_loss(F.col("v"), F.col("u")), 8).alias("loss"))


@query(f"with v as (select *, last_value(case when x > 0.1 then x end ignore nulls) over w as p, last_value(case when x > 0.1 then i end ignore nulls) over w as pi, first_value(case when x > 0.1 then x end ignore nulls) over f as q, first_value(case when x > 0.1 then i end ignore nulls) over f as qi from {V} window w as (partition by vec_id order by i rows unbounded preceding), f as (partition by vec_id order by i rows between current row and unbounded following)) select vec_id, i, round(case when p is null then q when q is null then p when pi = qi then x else p + (q - p) * (i - pi) / (qi - pi) end, 8) as x from v")
def zero_interpolate(spark, d):
    t = vectors(spark, d).select("vec_id", F.posexplode("v").alias("i", "x"))
    t = t.withColumn("s", F.when(F.col("x") > 0.1, F.struct("i", "x")))
    cell = F.floor(F.col("i") / 32)
    t = celled.filled(celled.filled(t, ["vec_id"], ["i"], cell, "s", "p"), ["vec_id"], ["i"], cell, "s", "q", reverse=True)
    p, q = F.col("p.x"), F.col("q.x")
    line = p + (q - p) * F.try_divide(F.col("i") - F.col("p.i"), F.col("q.i") - F.col("p.i"))
    x = F.when(p.isNull(), q).when(q.isNull(), p).when(F.col("p.i") == F.col("q.i"), F.col("x")).otherwise(line)
    return t.select("vec_id", F.col("i").cast("bigint").alias("i"), F.round(x, 8).alias("x"))


@query()
def mel_frames(spark, d):
    m = vectors(spark, d).select("vec_id", F.posexplode(S.mel(S.magnitude("v", F.lit(32), F.lit(8)), F.lit(22050.0), F.lit(8))).alias("frame", "m"))
    return m.select("vec_id", "frame", F.posexplode("m").alias("band", "value"))


@query()
def pitch_track(spark, d):
    return vectors(spark, d).select("vec_id", F.posexplode(S.pitch("v", F.lit(1000.0), F.lit(32), F.lit(16))).alias("frame", "hertz"))


@query("""with f as (select vec_id, list_transform(embedding, lambda x: x::double) as v from embeddings), s as (select vec_id, v, list_sum(v) / len(v) as m from f), z as (select *, list_sum(list_transform(v, lambda x: (x - m) * (x - m))) / len(v) as var from s)
  select vec_id, round(list_max(v), 8) as peak, round(10 * log10(greatest(list_max(list_transform(v, lambda x: x * x)), 1e-10)) / 10, 6) as level, round(list_max(list_transform(v, lambda x: (20 * x + 50 - (20 * m + 50)) / (4 * sqrt(400 * var)))), 8) as top from z""")
def sample_levels(spark, d):
    v = vectors(spark, d).withColumn("w", F.transform("v", lambda x: 20 * x + 50))
    z = S.sample_normalized(F.col("w"), "z-norm")
    return v.select("vec_id", F.round(F.array_max("v"), 8).alias("peak"), F.round(S.noise_level("v", F.lit("log_peak")), 6).alias("level"), F.round(F.array_max(z), 8).alias("top"))


# extensions: not in the plan of operators, but useful over event tables
@query("select time_bucket(interval 1 hour, ts) as hour, event_type, count(*) as n, round(sum(value::decimal(18,2))::double, 6) as total from events group by 1, 2")
def ext_tumbling(spark, d):
    e = table(spark, d, "events").groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(F.col("value").cast("decimal(18,2)")).cast("double"), 6).alias("total"))
    return e.select(F.col("w.start").alias("hour"), "event_type", "n", "total")


@query("""with t as (select *, case when ts - lag(ts) over (partition by user_id order by ts) < interval 6 hours then 0 else 1 end as fresh from events), s as (select *, sum(fresh) over (partition by user_id order by ts) as s from t)
  select user_id, min(ts) as first, count(*) as n from s group by user_id, s""")
def ext_session(spark, d):
    e = table(spark, d, "events").groupBy("user_id", F.session_window("ts", "6 hours").alias("w")).agg(F.min("ts").alias("first"), F.count(F.lit(1)).alias("n"))
    return e.select("user_id", "first", "n")


@query("select a.event_id, (select last(b.value order by b.ts, b.event_id) from events b where b.user_id = a.user_id and b.event_type = 'purchase' and b.ts <= a.ts) as as_of_value from events a where a.event_type = 'view'")
def ext_asof(spark, d):
    e = table(spark, d, "events")
    left, right = e.where("event_type = 'view'").select("event_id", "user_id", "ts"), e.where("event_type = 'purchase'").select("user_id", "ts", "value")
    return joins.as_of(left, right, ["user_id"], "ts", "value", F.to_date("ts")).select("event_id", "as_of_value")


@query("select l_returnflag, l_linestatus, count(*) as n, round(sum(l_quantity::decimal(18,2))::double, 6) as quantity from lineitem group by rollup (l_returnflag, l_linestatus)")
def ext_rollup(spark, d):
    return table(spark, d, "lineitem").rollup("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(F.col("l_quantity").cast("decimal(18,2)")).cast("double"), 6).alias("quantity"))
