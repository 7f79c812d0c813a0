"""The registered queries of this subpackage; SQL twins where another engine can give the same."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from soundings.llm import (
    bpe, decontaminate, exact_dedup, line_dedup, lm, merkle, packing, product_codes, quality, simhash, substring_dedup, suffix_dedup, toxicity)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def register(name: str, sql: str | None = None):
    def add(build):
        QUERIES[name] = build
        if sql:
            ORACLES[name] = sql
        return build
    return add


@register("op1_substring_dedup", """
    with docs as (select doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') as words from documents),
    places as (select doc_id, unnest(range(1, len(words) - 33)) as i, words from docs where len(words) >= 35),
    windows as (select doc_id, i, sha256(array_to_string(words[i:i + 34], ' ')) as w from places),
    again as (select w from windows group by w having count(*) > 1),
    hit as (select distinct doc_id, i + d as j from (select doc_id, i from windows where w in (select w from again)) cross join (select unnest(range(0, 35)) as d)),
    gone as (select doc_id, list(j) as js from hit group by doc_id)
    select d.doc_id, len(d.words) as n_words, coalesce(len(g.js), 0) as n_removed,
      sha256(coalesce(array_to_string(case when g.js is null then d.words else list_filter(d.words, lambda w, k: not list_contains(g.js, k)) end, ' '), '')) as kept_sha256
    from docs d left join gone g on g.doc_id = d.doc_id""")
def op1(spark: SparkSession, folder: str) -> DataFrame:
    return substring_dedup.substring_dedup(table(spark, folder, "documents"), with_text=False).select(
        "doc_id", "n_words", "n_removed", "kept_sha256")


@register("op2_decontamination", """
    with dw as (select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda w: w <> '') as words from documents),
    iw as (select item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda w: w <> '') as words from benchmark),
    wins as (select distinct item_id, least(10, len(words)) as n, array_to_string(words[i:i + least(10, len(words)) - 1], ' ') as w
      from (select *, unnest(range(1, len(words) - least(10, len(words)) + 2)) as i from iw where len(words) > 0)),
    sizes as (select distinct n from wins),
    places as (select doc_id, n, unnest(range(1, len(words) - n + 2)) as i, words from dw join sizes on len(words) >= n),
    hits as (select p.doc_id, p.i, p.n, w.item_id from (select doc_id, n, i, array_to_string(words[i:i + n - 1], ' ') as w from places) p join wins w on w.n = p.n and w.w = p.w),
    words_hit as (select doc_id, count(distinct j) as n_hit from (select doc_id, unnest(range(i, i + n)) as j from hits) group by doc_id),
    items as (select doc_id, count(distinct item_id) as n_items, string_agg(distinct cast(item_id as varchar), ',' order by cast(item_id as varchar)) as ids from hits group by doc_id)
    select d.doc_id, len(d.words) as n_words, coalesce(h.n_hit, 0) as n_hit, coalesce(t.n_items, 0) as n_items, sha256(coalesce(t.ids, '')) as items_sha256,
      h.n_hit is not null as contaminated
    from dw d left join words_hit h on h.doc_id = d.doc_id left join items t on t.doc_id = d.doc_id""")
def op2(spark: SparkSession, folder: str) -> DataFrame:
    return decontaminate.contamination(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


@register("op3_packing")
def op3(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack(table(spark, folder, "documents"))


@register("op4_suffix_array_dedup", """
    with docs as (select doc_id, lower(hex(encode(coalesce(text, '')))) as h from documents),
    places as (select doc_id, unnest(range(0, len(h) // 2 - 49)) as i, h from docs where len(h) >= 100),
    windows as (select doc_id, i, md5(substr(h, 2 * i + 1, 100)) as w from places),
    firsts as (select w, min(doc_id) as first from windows group by w having count(*) > 1),
    starts as (select s.doc_id, s.i from windows s join firsts f on f.w = s.w where f.first < s.doc_id),
    runs as (select doc_id, min(i) as a, max(i) + 50 as b from
      (select doc_id, i, sum(new) over (partition by doc_id order by i) as g from
       (select doc_id, i, case when i - lag(i) over (partition by doc_id order by i) <= 50 then 0 else 1 end as new from starts)) group by doc_id, g),
    gone as (select doc_id, count(*) as n_spans, sum(b - a) as n_removed, list([a, b] order by a) as spans from runs group by doc_id),
    kept as (select doc_id, string_agg(substr(h, 2 * a + 1, 2 * (b - a)), '' order by a) as k from (
      select d.doc_id, d.h, unnest(list_concat([0], list_transform(g.spans, lambda s: s[2]))) as a, unnest(list_concat(list_transform(g.spans, lambda s: s[1]), [len(d.h) // 2])) as b
      from docs d join gone g on g.doc_id = d.doc_id) group by doc_id)
    select d.doc_id, len(d.h) // 2 as n_bytes, cast(coalesce(g.n_removed, 0) as bigint) as n_removed, coalesce(g.n_spans, 0) as n_spans, sha256(unhex(coalesce(k.k, d.h))) as kept_sha256
    from docs d left join gone g on g.doc_id = d.doc_id left join kept k on k.doc_id = d.doc_id""")
def op4(spark: SparkSession, folder: str) -> DataFrame:
    return suffix_dedup.suffix_dedup(table(spark, folder, "documents"), with_bytes=False).select(
        "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


@register("op5_quality")
def op5(spark: SparkSession, folder: str) -> DataFrame:
    labels = table(spark, folder, "labels").select("doc_id", F.col("quality").alias("label"))
    return quality.quality_scores(table(spark, folder, "documents").select("doc_id", "text"), labels)


@register("op6_toxicity")
def op6(spark: SparkSession, folder: str) -> DataFrame:
    labels = table(spark, folder, "labels").select("doc_id", F.col("toxic").alias("label"))
    return toxicity.toxicity_scores(table(spark, folder, "documents"), labels, quality.remainder("doc_id", 4) == 2)


@register("op7_lm_scoring")
def op7(spark: SparkSession, folder: str) -> DataFrame:
    return lm.lm_scores(table(spark, folder, "documents"), quality.remainder("doc_id", 7) == 2)


@register("op8_exact_dedup", """
    with texts as (select doc_id, regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]+', ' ', 'g') as norm from documents)
    select doc_id, min(doc_id) over (partition by norm) as keep_id, count(*) over (partition by norm) as group_size,
           doc_id = min(doc_id) over (partition by norm) as kept, sha256(norm) as text_sha256
    from texts""")
def op8(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return exact_dedup.exact_dedup(docs).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


@register("op9_simhash")
def op9(spark: SparkSession, folder: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, folder, "documents"))


@register("op10_line_dedup")
def op10(spark: SparkSession, folder: str) -> DataFrame:
    return line_dedup.line_dedup(table(spark, folder, "documents"), with_text=False).select(
        "doc_id", "class_id", "n_lines", "n_removed", "n_links", "kept_sha256")


def _leaf_sql(text: str) -> str:
    values = ("doc_id", "source", "lang", "n_chars", text)
    return "sha256(" + " || ".join(f"coalesce(cast(strlen(cast({v} as varchar)) as varchar) || ':' || cast({v} as varchar), '-')" for v in values) + ")"


@register("op11_merkle_manifest", f"""
    with recursive prints as (
      select *, xor(4294967295, list_reduce(list_concat([4294967295], flatten(list_transform(string_split(cast(doc_id as varchar), ''),
        lambda c: [cast(ascii(c) as bigint), -1, -1, -1, -1, -1, -1, -1, -1]))),
        lambda c, x: case when x >= 0 then xor(c, x) when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end)) as crc from documents),
    altered as (select *, case when crc % 3 = 0 then translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') else text end as low from prints),
    leaves as (select doc_id, lang, row_number() over (partition by lang order by doc_id) - 1 as i, {_leaf_sql('text')} as leaf, {_leaf_sql('low')} as other from altered),
    nodes as (
      select lang, 0 as lvl, i, leaf as h, count(*) over (partition by lang) as n from leaves
      union all
      select lang, any_value(lvl) + 1, i // 8, sha256(string_agg(h, '' order by i)), (any_value(n) + 7) // 8 from nodes where n > 1 group by lang, i // 8),
    subroots as (select lang, h as subroot, row_number() over (order by lang nulls first) - 1 as k from nodes where n = 1),
    tops as (
      select 0 as lvl, k as i, subroot as h, count(*) over () as n from subroots
      union all
      select any_value(lvl) + 1, i // 8, sha256(string_agg(h, '' order by i)), (any_value(n) + 7) // 8 from tops where n > 1 group by i // 8),
    beside as (
      select a.lang, a.lvl, a.i, coalesce(string_agg(b.h, '' order by b.i) filter (where b.i < a.i), '') as before, coalesce(string_agg(b.h, '' order by b.i) filter (where b.i > a.i), '') as after
      from nodes a join nodes b on a.lang is not distinct from b.lang and a.lvl = b.lvl and a.i // 8 = b.i // 8 where a.n > 1 group by a.lang, a.lvl, a.i),
    beside_top as (
      select a.lvl, a.i, coalesce(string_agg(b.h, '' order by b.i) filter (where b.i < a.i), '') as before, coalesce(string_agg(b.h, '' order by b.i) filter (where b.i > a.i), '') as after
      from tops a join tops b on a.lvl = b.lvl and a.i // 8 = b.i // 8 where a.n > 1 group by a.lvl, a.i),
    folds as (
      select doc_id, lang, leaf, 0 as lvl, i, other as cur, '' as proof from leaves
      union all
      select f.doc_id, f.lang, f.leaf, f.lvl + 1, f.i // 8, sha256(s.before || f.cur || s.after), f.proof || s.before || s.after
      from folds f join beside s on f.lang is not distinct from s.lang and f.lvl = s.lvl and f.i = s.i),
    ended as (select f.doc_id, f.leaf, s.subroot, s.k, f.cur, f.proof from (select * from folds qualify lvl = max(lvl) over (partition by lang)) f
      join subroots s on f.lang is not distinct from s.lang),
    top_folds as (
      select doc_id, leaf, subroot, 0 as lvl, k as i, cur, proof from ended
      union all
      select f.doc_id, f.leaf, f.subroot, f.lvl + 1, f.i // 8, sha256(s.before || f.cur || s.after), f.proof || s.before || s.after
      from top_folds f join beside_top s on f.lvl = s.lvl and f.i = s.i)
    select t.doc_id, t.leaf, t.subroot, r.h as root, sha256(t.proof) as proof_sha256, t.cur as folded_root, t.cur = r.h as verified
    from (select * from top_folds qualify lvl = max(lvl) over ()) t cross join (select h from tops where n = 1) r""")
def op11(spark: SparkSession, folder: str) -> DataFrame:
    return merkle.manifest(table(spark, folder, "documents"), altered={"text": merkle.tampered_text()})


@register("op12_byte_bpe")
def op12(spark: SparkSession, folder: str) -> DataFrame:
    return bpe.encode(table(spark, folder, "documents").select("doc_id", "text"), with_ids=False)


def _codes_sql() -> str:
    """Six rounds, then codes; each round's entries come from the distances to those before."""
    def near(r: int) -> str:
        return (f"near{r} as materialized (select vec_id, part, min(struct_pack(d := d, entry := entry)) as best from (select vec_id, part, entry, sum((x - c) * (x - c)) as d "
                f"from dims join book{r} using (part, place) group by vec_id, part, entry) group by vec_id, part)")

    def book(r: int) -> str:
        return (f"book{r} as materialized (select b.part, b.entry, b.place, coalesce(m.c, b.c) as c from book{r - 1} b left join (select part, entry, place, (s - ((s % n) + n) % n) // n as c from ("
                f"select d.part, a.best.entry as entry, d.place, sum(d.x) as s, count(*) as n from dims d join near{r - 1} a using (vec_id, part) group by all)) m using (part, entry, place))")

    rounds = ", ".join(f"{near(r - 1)}, {book(r)}" for r in range(1, 7))
    return f"""
    with kept as (select vec_id, label, list_transform(embedding, lambda x: cast(floor(4096 * cast(x as double)) as bigint)) as v from embeddings
      where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
    dims as materialized (select vec_id, i // w as part, i % w as place, v[i + 1] as x from (select vec_id, v, len(v) // 8 as w, unnest(range(len(v))) as i from kept)),
    seeds as (select vec_id, row_number() over (order by vec_id) - 1 as entry from kept qualify entry < 16),
    book0 as materialized (select part, entry, place, x as c from dims join seeds using (vec_id)), {rounds}, {near(6)},
    codes as (select vec_id, string_agg(printf('%02x', best.entry), '' order by part) as code, cast(sum(best.d) as bigint) as error from near6 group by vec_id),
    labelled as (select k.vec_id, k.label, c.code, c.error from kept k join codes c using (vec_id))
    select vec_id, code, error, cast(sum(error) over (partition by label) as bigint) as label_error,
      (select sha256(string_agg(cast(c as varchar), ',' order by part, entry, place)) from book6) as codebooks_sha256
    from labelled"""


@register("op13_vector_codes", _codes_sql())
def op13(spark: SparkSession, folder: str) -> DataFrame:
    return product_codes.compress(table(spark, folder, "embeddings")).select("vec_id", "code", "error", "label_error", "codebooks_sha256")
