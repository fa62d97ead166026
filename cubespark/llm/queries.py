"""The registered queries of the training-data operators and, where SQL can express them, their oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cubespark.llm.common import table
from cubespark.llm.filter_audit import audit
from cubespark.llm.harmonic_packing import pack_harmonic
from cubespark.llm.language_id import identify
from cubespark.llm.lexical_search import search
from cubespark.llm.media import media_features
from cubespark.llm.mixing import mix
from cubespark.llm.near_dedup import near_duplicates
from cubespark.llm.packing import pack
from cubespark.llm.quality_classifier import classify
from cubespark.llm.quality_rules import quality_flags
from cubespark.llm.secret_scan import secret_spans
from cubespark.llm.substring_dedup import repeated_passages
from cubespark.llm.warc import read_archives, write_archives


def op1_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_flags(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_spans(table(spark, sf_dir, "documents"))


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_passages(table(spark, sf_dir, "documents"))


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))


def op6_mpeg_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = media_features(table(spark, sf_dir, "documents"))
    return read.withColumn("frame_offsets", F.concat_ws(",", F.col("frame_offsets").cast("array<string>")))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = read_archives(write_archives(table(spark, sf_dir, "pages")))
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op8_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), shingle=2)


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "documents"))


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_harmonic_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_harmonic(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_source_mixing": op1_source_mixing,
    "op2_quality_rules": op2_quality_rules,
    "op3_secret_scan": op3_secret_scan,
    "op4_substring_dedup": op4_substring_dedup,
    "op5_best_fit_packing": op5_best_fit_packing,
    "op6_mpeg_audio": op6_mpeg_audio,
    "op7_warc": op7_warc,
    "op8_minhash_near_dedup": op8_minhash_near_dedup,
    "op9_language_id": op9_language_id,
    "op10_quality_classifier": op10_quality_classifier,
    "op11_filter_audit": op11_filter_audit,
    "op12_lexical_search": op12_lexical_search,
    "op13_harmonic_packing": op13_harmonic_packing,
}

ORACLES: dict[str, str] = {
    "op7_warc": """
with p as (select page_id, encode(coalesce(html, '')) b from pages),
g as (select b, max(page_id) top from p where octet_length(b) >= 1000 group by b having count(*) > 1)
select page_id, octet_length(b) payload_bytes, sha1(b) payload_digest,
  case when top is null or page_id is not distinct from top then 'response' else 'revisit' end record_type,
  case when page_id is distinct from top then top end refers_to
from p left join g using (b)
""",
    "op8_minhash_near_dedup": r"""
with recursive w as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x20\x09-\x0D]+') w from documents),
sh as materialized (
  select distinct doc_id, unnest(case when len(w) = 0 then [] when len(w) = 1 then [w[1]]
    else list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) end) s from w),
n as materialized (select doc_id, count(*) n from sh group by 1),
cand as (select a.doc_id a, b.doc_id b, count(*) c from sh a join sh b using (s) where a.doc_id < b.doc_id group by 1, 2),
link as materialized (select a, b from cand join n x on a = x.doc_id join n y on b = y.doc_id where 100 * c >= 80 * (x.n + y.n - c)),
two as materialized (select a, b from link union all select b, a from link),
reach(doc_id, r) as (select doc_id, doc_id from documents union select reach.doc_id, two.b from reach join two on two.a = reach.r),
comp as (select doc_id, min(r) c from reach group by 1)
select d.doc_id, cast(coalesce(n.n, 0) as bigint) n_shingles, c component_id, d.doc_id = c kept
from documents d left join n using (doc_id) join comp using (doc_id)
""",
    # Every order is walked by itself: what fails the step's filter and none before it.
    "op11_filter_audit": r"""
with w as (select doc_id, coalesce(source, '') part, coalesce(text, '') t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') w from documents),
l as (select doc_id, max((quality = 1)::int) good, max((toxic = 1)::int) toxic from labels group by 1),
f as materialized (select part, len(w) < 200 a, 100 * len(list_distinct(w)) < 50 * len(w) b, 100 * len(regexp_replace(t, '[^A-Z]', '', 'g')) > 2 * len(t) c,
  regexp_matches(t, '[#$%&*|]') d, coalesce(doc_id > min(doc_id) over (partition by t), false) e, coalesce(good, 0) good, coalesce(toxic, 0) toxic
  from w left join l using (doc_id)),
m as materialized (select part, a::int + 2 * b::int + 4 * c::int + 8 * d::int + 16 * e::int failed, count(*) n, sum(good) good, sum(toxic) toxic from f group by 1, 2),
x as (select unnest(['A', 'B', 'C', 'D', 'E']) c, unnest([1, 2, 4, 8, 16]) bit),
o as (select p.c || q.c || r.c || s.c || t.c filter_order, [p.bit, q.bit, r.bit, s.bit, t.bit] bits from x p, x q, x r, x s, x t
  where p.bit + q.bit + r.bit + s.bit + t.bit = 31 and p.bit | q.bit | r.bit | s.bit | t.bit = 31),
st as (select filter_order, step, bits[step] bit, coalesce(list_sum(bits[1:step - 1]), 0)::int before from o, (select unnest([1, 2, 3, 4, 5])::int step)),
g as materialized (select part, filter_order, step, bit,
  sum(case when failed & (before | bit) = 0 then n else 0 end) kept, sum(case when failed & before = 0 and failed & bit > 0 then n else 0 end) removed,
  sum(case when failed & before > 0 and failed & bit > 0 then n else 0 end) redundant, sum(case when failed = bit then n else 0 end) unique_fails,
  sum(case when failed & before = 0 and failed & bit > 0 then good else 0 end) good_lost,
  sum(case when failed & before = 0 and failed & bit > 0 then toxic else 0 end) toxic_lost from st, m group by 1, 2, 3, 4),
h as (select part, bit, sum(removed) shapley from g group by 1, 2)
select part, filter_order, step, kept::bigint kept, removed::bigint removed, redundant::bigint redundant, unique_fails::bigint unique_fails,
  good_lost::bigint good_lost, toxic_lost::bigint toxic_lost, shapley::bigint shapley from g join h using (part, bit)
""",
    # Every pair of an item and a document that shares a term is scored.
    "op12_lexical_search": r"""
with recursive d as (select doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) t from documents),
i as (select item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) t from benchmark),
tf as materialized (select doc_id, t, count(*) tf from d group by 1, 2),
n as materialized (select doc_id, sum(tf)::bigint n from tf group by 1),
s as (select count(*)::bigint big_n, sum(n)::bigint big_l from n),
w as (select t, floor(1000 * ln((2 * any_value(big_n) + 2)::double / (2 * count(*) + 1)::double))::bigint w from tf, s where t in (select t from i) group by 1),
q as (select item_id, t, count(*) c from i group by 1, 2),
sc as (select item_id, doc_id, sum(c * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * big_n) // big_l))))::bigint score
  from q join w using (t) join tf using (t) join n using (doc_id), s group by 1, 2),
r as (select item_id, row_number() over (partition by item_id order by score desc, doc_id) as rank, doc_id, score from sc where score > 0)
select item_id, rank::int as rank, doc_id, score from r where rank <= 20
""",
}
