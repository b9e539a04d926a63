"""The registered corpus queries: each applies its operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import blocks, dialogues, impact, minhash, personal, phrases, pieces, ppm, repeats, rule_ensemble, spaced_seeds, trie, url_rules
from .common import table


def tokenizer(name: str = "piece_bpe_32k.model") -> bytes:
    """A public tokenizer file's bytes, read where the driver runs."""
    import public_tokenizers

    with open(public_tokenizers.path(name), "rb") as f:
        return f.read()


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ppm.predicted(table(spark, sf_dir, "documents"))


def op2_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(url_rules.RULES, "host string, path string, action string")
    return url_rules.judged(table(spark, sf_dir, "pages").select("page_id", "url"), rules).select("page_id", "host", "path", "rule", "verdict")


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spaced_seeds.found(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.digests(table(spark, sf_dir, "documents"), tokenizer())


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.counted(table(spark, sf_dir, "documents"), trie.Unigram.ranked(tokenizer()))


def op6_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.linked(table(spark, sf_dir, "documents")).drop("mark")


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rule_ensemble.judged(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.digests(table(spark, sf_dir, "documents"))


def op9_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return impact.searched(table(spark, sf_dir, "embeddings"))


def op10_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blocks.extracted(table(spark, sf_dir, "pages"))


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.mined(table(spark, sf_dir, "documents"))


def op12_dialogue_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations")
    return dialogues.repaired(dialogues.damaged(rows), rows)


def op13_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal.digests(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_language_id, op2_url_filters, op3_decontamination, op4_pieces, op5_token_counts, op6_near_duplicates, op7_quality, op8_repeats, op9_top_k, op10_main_text, op11_collocations, op12_dialogue_repair, op13_personal_data)}


#: DuckDB twin of op9.
TOP_K = """
with fine as (
  select vec_id, list_transform(embedding, lambda x: cast(floor(256 * cast(x as double)) as bigint)) as v from embeddings
  where vec_id is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), pairs as (
  select q.vec_id as query_id, q.v as ask, c.vec_id,
         cast(list_sum(list_transform(list_zip(q.v, c.v), lambda p: coalesce(p[1], 0) * coalesce(p[2], 0))) as bigint) as score
  from (select distinct vec_id, v from fine where vec_id % 50 = 0) q, fine c where c.vec_id <> q.vec_id
)
select query_id, cast(rank as integer) as rank, vec_id, score
from (select *, row_number() over (partition by query_id, ask order by score desc, vec_id) as rank from pairs) where rank <= 5
"""


#: DuckDB twin of op3 for items of at least the window's length: seeds by concatenated tokens, the same verification.
LEAKS = """
with d as (select doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\\p{L}\\p{N}]+') as w from documents),
b as (select item_id, regexp_extract_all(lower(coalesce(text, '')), '[\\p{L}\\p{N}]+') as w from benchmark),
ds as (select doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 3] || ' ' || w[i + 6] || ' ' || w[i + 7] as seed from (select doc_id, w, unnest(range(1, len(w) - 6)) as i from d)),
bs as (select item_id, j, w[j] || ' ' || w[j + 1] || ' ' || w[j + 3] || ' ' || w[j + 6] || ' ' || w[j + 7] as seed from (select item_id, w, unnest(range(1, len(w) - 6)) as j from b where len(w) >= 13)),
hits as (select distinct doc_id, item_id, i - j as shift from ds join bs using (seed)),
same as (select doc_id, item_id, len(b.w) as n, list_transform(range(1, len(b.w) + 1), lambda k: case when k + shift >= 1 and d.w[k + shift] = b.w[k] then 1 else 0 end) as m from hits join d using (doc_id) join b using (item_id)),
best as (select doc_id, item_id, list_max(list_transform(range(1, n - 11), lambda k: cast(list_sum(m[k : k + 12]) as bigint))) as matched, list_sum(m) / n as share from same)
select doc_id, item_id, cast(max(matched) as integer) as matched, arg_max(share, matched + share / 2) as share from best where matched >= 11 group by 1, 2
"""

#: DuckDB twin of op6: all pairs that share a shingle, components by recursion.
NEAR = """
with recursive w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') as w from documents),
s as (select doc_id, unnest(case when len(w) >= 5 then list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i : i + 4], ' '))) when len(w) > 0 then [array_to_string(w, ' ')] else [] end) as s from w),
n as (select doc_id, count(*) as n from s group by 1),
both_ as (select a.doc_id as a, b.doc_id as b, count(*) as c from s a join s b using (s) where a.doc_id <> b.doc_id group by 1, 2),
links as (select a, b from both_ join n x on x.doc_id = a join n y on y.doc_id = b where 100 * c >= 85 * (x.n + y.n - c)),
walk as (select doc_id as node, doc_id as seen from documents union select node, b from walk join links on seen = a),
low as (select node, min(seen) as component_id from walk group by 1)
select d.doc_id, coalesce(n.n, 0) as n_shingles, component_id, d.doc_id = component_id as kept from documents d left join n on n.doc_id = d.doc_id join low on node = d.doc_id
"""

#: DuckDB twin of op8: every window by value, its first place, and the islands of the later ones.
REPEATED = """
with t as (select doc_id, hex(encode(coalesce(text, ''))) as h from documents),
w as (select doc_id, i, substr(h, 2 * i + 1, 200) as s from (select doc_id, h, unnest(range(0, greatest(0, length(h) // 2 - 99))) as i from t)),
late as (select doc_id, i from (select doc_id, i, row_number() over (partition by s order by doc_id, i) as turn from w) where turn > 1),
marked as (select doc_id, i, case when i > lag(i) over (partition by doc_id order by i) + 100 then 1 else 0 end as new from late),
islands as (select doc_id, min(i) as lo, max(i) + 100 as hi from (select doc_id, i, sum(new) over (partition by doc_id order by i) as island from marked) group by doc_id, island),
pieces as (select doc_id, lo, hi, coalesce(lag(hi) over (partition by doc_id order by lo), 0) as after from islands),
cuts as (select p.doc_id, count(*) as n_spans, sum(hi - lo) as n_removed, string_agg(substr(h, 2 * after + 1, 2 * (lo - after)), '' order by lo) || any_value(substr(h, 2 * last + 1)) as kept from (select *, max(hi) over (partition by doc_id) as last from pieces) p join t using (doc_id) group by 1)
select t.doc_id, length(h) // 2 as n_bytes, cast(coalesce(n_removed, 0) as bigint) as n_removed, coalesce(n_spans, 0) as n_spans, sha256(unhex(coalesce(kept, h))) as kept_sha256 from t left join cuts using (doc_id)
"""


def oracle_sql() -> dict[str, str]:
    return {"op2_url_filters": url_rules.ORACLE, "op3_decontamination": LEAKS, "op6_near_duplicates": NEAR, "op8_repeats": REPEATED, "op9_top_k": TOP_K, "op11_collocations": phrases.ORACLE}
