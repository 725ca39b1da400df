"""The operators' queries with production parameters over whole tables, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm import bpe, decontaminate, jaccard, language, lm_score, media, periodic, pii, prefix_bpe, sharding, token_files, toxicity, vector_codes
from lectern.llm.batches import crc_mod, saved

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _query(f):
    QUERIES[f.__name__] = f
    return f


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@_query
def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score, predicted of every document; learned from rows that are not held out."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, _table(spark, sf_dir, "labels").where(crc_mod("doc_id", 5) != 0))
    scored = toxicity.score(docs, model)
    return scored.select("doc_id", (crc_mod("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


@_query
def op2_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, class_id, n_links, copies of every document."""
    return jaccard.join(_table(spark, sf_dir, "documents"))


@_query
def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, and digests of the ids and of the decoded text of every document."""
    path = public_tokenizers.path("word_bpe_49k.json")
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe.encode_and_decode(docs, path, digests=True)


@_query
def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, contaminated, n_items, item_ids, similarity (the best) of every document."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    out = decontaminate.find_leaks(docs, _table(spark, sf_dir, "benchmark"), exact=False)
    return out.select(
        "doc_id",
        (F.size("leaks") > 0).alias("contaminated"),
        F.size("leaks").cast("bigint").alias("n_items"),
        F.array_join(F.transform("leaks", lambda x: x["item_id"]), ",").alias("item_ids"),
        F.coalesce(F.array_max(F.transform("leaks", lambda x: x["similarity"])), F.lit(0.0)).alias("similarity"),
    )


@_query
def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of every document, in eight shards of equal bytes."""
    placed = sharding.shard(_table(spark, sf_dir, "documents"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


@_query
def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, as read back by keyed access from the files."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    path = token_files.write(docs, public_tokenizers.path("byte_bpe_50k.json"))
    found = token_files.lookup(spark, path, docs, digest=True).unionByName(token_files.read(spark, path, digest=True, only_nulls=True))
    found = found.join(token_files.starts(spark, path), ["part", "seq"])
    return found.select("doc_id", (F.col("base") + F.col("own")).alias("start"), "n_tokens", "ids_crc32")


@_query
def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, lang_pred, score, rejected of every document; learned from rows that are not held out."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = language.fit(docs.where(crc_mod("doc_id", 3) != 1))
    out = language.identify(docs.select("doc_id", "text"), model)
    return out.select("doc_id", (crc_mod("doc_id", 3) == 1).alias("held_out"), "lang_pred", "score", "rejected")


@_query
def op8_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, both cross entropies and their difference of every document; the target is labelled good quality."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    out = lm_score.compare(docs, _table(spark, sf_dir, "labels").where("quality = 1"))
    return out.select("doc_id", "n_tokens", *[F.round(c, 6).alias(c) for c in ("ce_target", "ce_background", "score")])


@_query
def op9_flac(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes and digests of every document's payload, as read back from the PCM blocks of its stored FLAC stream, of the stream, and features."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", F.octet_length(F.coalesce("text", F.lit(""))).cast("bigint").alias("n_bytes"))
    stored = saved(media.store_texts(docs).drop("text"), "streams", **{"parquet.compression.codec.zstd.level": "6"})
    out = media.with_pcm(stored).withColumn("pcm", media.whole(F.col("blocks")))
    return out.select(
        "doc_id",
        "n_bytes",
        F.octet_length("pcm").cast("bigint").alias("payload_bytes"),
        F.sha2("pcm", 256).alias("payload_sha256"),
        F.crc32(F.substring("pcm", -16, 16)).alias("tail_crc32"),
        F.octet_length("media").cast("bigint").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        "feature",
        F.size("blocks").alias("n_blocks"),
        "error",
    )


@_query
def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, counts by base kind, digest of the base spans, all spans, and the highest score of every document."""
    out = pii.with_spans(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = [k.name for k in pii.BASE]
    kinds = F.transform("spans", lambda s: s["kind"])
    counts = [(F.size(kinds) - F.size(F.array_remove(kinds, k))).cast("bigint").alias(f"n_{k}") for k in base]
    of_base = pii.listed(F.filter("spans", lambda s: s["kind"].isin(base)))
    return out.select(
        "doc_id",
        *counts,
        F.sha2(of_base.cast("binary"), 256).alias("base_sha256"),
        pii.listed(F.col("spans")).alias("spans"),
        F.coalesce(F.array_max(F.transform("spans", lambda s: s["score"])), F.lit(0.0)).alias("max_score"),
    )


@_query
def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, the number of runs, the greatest one, and digests of all runs and of the collapsed text of every document."""
    return periodic.summarise(_table(spark, sf_dir, "documents").select("doc_id", "text"), key="doc_id")


@_query
def op12_prefix_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, and digests of the ids and of the decoded bytes of every document."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return prefix_bpe.encode_and_decode(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


@_query
def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id, code, error, label_error, codebooks_sha256 of every sound vector of embeddings."""
    coded = vector_codes.encode(_table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label"))
    out = vector_codes.with_label_error(coded.rows, "label", "error")
    return out.select("vec_id", "code", "error", "label_error", F.lit(vector_codes.digest(coded.books)).alias("codebooks_sha256"))



ORACLES["op2_ngram_jaccard_join"] = r"""
with recursive words as (
  select doc_id, coalesce(text, '') as text, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+') as w from documents
),
shingle as (
  select distinct doc_id, s from (
    select doc_id, unnest(case when text = '' then [] when len(w) = 0 then ['= ' || text] when len(w) < 5 then [array_to_string(w, ' ')]
      else list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) end) as s
    from words) x
),
size as (select doc_id, count(*) as n from shingle group by 1),
common as (select a.doc_id as a, b.doc_id as b, count(*) as c from shingle a join shingle b on a.s = b.s and a.doc_id <> b.doc_id group by 1, 2),
link as (select a, b, c = x.n and c = y.n as same from common join size x on x.doc_id = a join size y on y.doc_id = b where c >= 0.8 * (x.n + y.n - c)),
reach(a, b) as (select doc_id, doc_id from documents union select r.a, l.b from reach r join link l on l.a = r.b),
class as (select a as doc_id, min(b) as class_id from reach group by 1),
counted as (select a as doc_id, count(*) as n_links, count(*) filter (where same) as same from link group by 1)
select doc_id, class_id, coalesce(n_links, 0) as n_links, coalesce(same, 0) + 1 as copies from class left join counted using (doc_id)
"""


#: Every window that shares a shingle with an item of five or more words, compared whole; shorter items are for the operator's tests.
ORACLES["op4_decontamination"] = r"""
with item as (
  select item_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') as w, len(w) as n from (select distinct item_id, text from benchmark where item_id is not null and text is not null)
),
item_shingle as (
  select item_id, n, s, count(*) as c, any_value(strlen(replace(s, ' ', ''))) as weight
  from (select item_id, n, array_to_string(w[p:p + 4], ' ') as s from (select *, unnest(range(1, n - 3)) as p from item where n >= 5) x) y group by all
),
item_weight as (select item_id, n, sum(c * weight) as whole from item_shingle group by all),
doc as (select row_number() over () as r, doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+') as w from documents),
doc_shingle as (
  select r, p, s, strlen(replace(s, ' ', '')) as weight from (select r, p, array_to_string(w[p:p + 4], ' ') as s from (select *, unnest(range(1, len(w) - 3)) as p from doc) x) y
),
hit as (select r, item_id, n, p, s, c, d.weight from doc_shingle d join item_shingle i using (s)),
start as (select distinct r, item_id, n, unnest(range(greatest(1, p - n + 5), p + 1)) as b from hit),
common as (
  select r, item_id, b, sum(least(k, c) * weight) as both_
  from (select t.r, t.item_id, t.b, h.s, h.c, h.weight, count(*) as k from start t join hit h on h.r = t.r and h.item_id = t.item_id and h.p between t.b and t.b + t.n - 5 group by all) x
  group by all
),
running as (select r, p, sum(weight) over (partition by r order by p) as upto, max(p) over (partition by r) as last from doc_shingle),
likeness as (
  select c.r, c.item_id, max(c.both_ / (i.whole + e.upto - coalesce(a.upto, 0) - c.both_)) as similarity
  from common c join item_weight i using (item_id)
  join (select r, any_value(last) as last from running group by r) l on l.r = c.r
  join running e on e.r = c.r and e.p = least(c.b + i.n - 5, l.last)
  left join running a on a.r = c.r and a.p = c.b - 1
  group by all
),
leak as (
  select r, count(*) as n_items, string_agg(cast(item_id as varchar), ',' order by item_id) as item_ids, max(similarity) as similarity
  from likeness where similarity >= 0.8 group by r
)
select doc_id, n_items is not null as contaminated, coalesce(n_items, 0) as n_items, coalesce(item_ids, '') as item_ids, cast(coalesce(similarity, 0) as double) as similarity
from doc left join leak using (r)
"""


ORACLES["op8_lm_score"] = r"""
with doc as (
  select row_number() over () as r, doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+') as words,
    coalesce(doc_id in (select doc_id from labels where quality = 1 and doc_id is not null), false) as target
  from documents
),
token as (select r, target, words[i] as w, case when i = 1 then '' else words[i - 1] end as v from (select *, unnest(range(1, len(words) + 1)) as i from doc) x),
word as (select w, count(*) filter (target) as t, count(*) filter (not target) as b from token group by w),
before as (select v, count(*) filter (target) as t, count(*) filter (not target) as b from (select target, w as v from token union all select target, '' from doc where len(words) > 0) x group by v),
pair as (select v, w, count(*) filter (target) as t, count(*) filter (not target) as b from token group by v, w),
total as (select sum(t) as t, sum(b) as b, count(*) as size from word),
weight as (select case when t * b = 0 then 1 else least(t, b) / t end as kt, case when t * b = 0 then 1 else least(t, b) / b end as kb, t, b, size from total),
own_word as (select r, w, count(*) as n from token group by r, w),
own_pair as (select r, target, v, w, count(*) as n from token group by r, target, v, w),
counted as (
  select o.r, o.n, k.kt * k.t as nt, k.kb * k.b as nb, k.size,
    k.kt * (p.t - case when target then o.n else 0 end) as pt, k.kb * (p.b - case when target then 0 else o.n end) as pb,
    k.kt * (c.t - case when target then coalesce(m.n, 1) else 0 end) as ct, k.kb * (c.b - case when target then 0 else coalesce(m.n, 1) end) as cb,
    k.kt * (u.t - case when target then s.n else 0 end) as ut, k.kb * (u.b - case when target then 0 else s.n end) as ub
  from own_pair o join pair p on p.v = o.v and p.w = o.w join before c on c.v = o.v join word u on u.w = o.w join own_word s on s.r = o.r and s.w = o.w
  left join own_word m on m.r = o.r and m.w = o.v cross join weight k
),
loss as (
  select r, sum(n) as n, -sum(n * log2((pt + 8 * ((ut + 0.5e0) / (nt + 0.5e0 * (size + 1)))) / (ct + 8))) as lt,
    -sum(n * log2((pb + 8 * ((ub + 0.5e0) / (nb + 0.5e0 * (size + 1)))) / (cb + 8))) as lb
  from counted group by r
)
select doc_id, cast(len(words) as bigint) as n_tokens, round(lt / n, 6) as ce_target, round(lb / n, 6) as ce_background, round((lt - lb) / n, 6) as score from doc left join loss using (r)
"""


#: Pieces between matches and the matches themselves give the spans' places, as in the operator; the checks are written anew.
ORACLES["op10_pii"] = r"""
with d as (select doc_id, coalesce(text, '') as t from documents),
octet as (select '0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])' as o),
kind(place, kind, pattern, base, context) as (values
  (1, 'email', '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+', 0.8, 'mail|contact|kontakt|contacto|write to|reach'),
  (2, 'ip', '[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+', 0.6, '\bip\b|address|adresse|host|server|client'),
  (3, 'card', '[0-9](?:[ -]?[0-9])+', 0.8, 'card|karte|carte|tarjeta|visa|credit|master|amex'),
  (4, 'phone', '\+[0-9][ ().0-9-]+[0-9]', 0.6, 'phone|call|tel\b|tel[.:ée]|mobile|mobil|fax'),
  (5, 'iban', '\b[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\b', 0.85, 'iban|account|konto|compte|cuenta|bank')
),
split as (
  select doc_id, place, kind, base, context, regexp_extract_all(t, pattern) as found, string_split_regex(t, pattern) as pieces from d cross join kind
),
match as (
  select doc_id, place, kind, base, context, unnest(range(1, len(found) + 1)) as i, found, pieces from split where len(found) > 0
),
span as (
  select doc_id, place, kind, base, found[i] as m, pieces[i] as p, context,
    cast(list_sum(list_transform(pieces[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(found[1:i - 1], lambda x: length(x))), 0) as bigint) as start
  from match
),
plain as (select *, regexp_replace(m, '[^0-9]', '', 'g') as n, replace(m, ' ', '') as c from span),
valid as (
  select *, round(base + case when regexp_matches(lower(right(p, 40)), context) then 0.15 else 0 end, 2) as score
  from plain
  where case kind
    when 'email' then true
    when 'ip' then regexp_full_match(m, (select o from octet) || '(?:\.' || (select o from octet) || '){3}')
    when 'card' then length(n) between 13 and 19 and list_sum(list_transform(range(1, length(n) + 1),
      lambda i: case when (length(n) - i) % 2 = 1 then [0, 2, 4, 6, 8, 1, 3, 5, 7, 9][cast(substr(n, i, 1) as int) + 1] else cast(substr(n, i, 1) as int) end)) % 10 = 0
    when 'phone' then length(n) between 9 and 15
    else length(c) between 15 and 34 and list_reduce(list_prepend(0, list_transform(range(1, length(c) + 1),
      lambda i: case when substr(substr(c, 5) || substr(c, 1, 4), i, 1) >= 'A' then ascii(substr(substr(c, 5) || substr(c, 1, 4), i, 1)) - 55 else cast(substr(substr(c, 5) || substr(c, 1, 4), i, 1) as int) end)),
      lambda a, b: case when b >= 10 then (a * 100 + b) % 97 else (a * 10 + b) % 97 end) = 1 end
),
listed as (
  select doc_id, count(*) filter (where kind = 'email') as n_email, count(*) filter (where kind = 'ip') as n_ip, count(*) filter (where kind = 'card') as n_card,
    count(*) filter (where kind = 'phone') as n_phone, max(score) as max_score,
    string_agg(kind || ':' || cast(start as varchar) || ':' || cast(start + length(m) as varchar), ',' order by place, start) as spans,
    string_agg(kind || ':' || cast(start as varchar) || ':' || cast(start + length(m) as varchar), ',' order by place, start) filter (where place < 5) as base_spans
  from valid group by doc_id
)
select d.doc_id, coalesce(n_email, 0) as n_email, coalesce(n_ip, 0) as n_ip, coalesce(n_card, 0) as n_card, coalesce(n_phone, 0) as n_phone,
  sha256(coalesce(base_spans, '')) as base_sha256, coalesce(spans, '') as spans, cast(coalesce(max_score, 0) as double) as max_score
from d left join listed using (doc_id)
"""
