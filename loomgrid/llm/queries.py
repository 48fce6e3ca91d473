"""The queries of this subpackage by name, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from .common import table


def op2_sstable(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .op02_sstable import token_index

    return token_index(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=2)


def op1_kd_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .op01_kd_shards import sharded

    return sharded(table(spark, sf_dir, "documents"), shards=40)


def op4_prefix_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .op04_bpe import round_trip

    return round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op10_hilbert_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .op10_packing import packed

    return packed(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), end_id=1, length=2048)


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .op07_suffix_dedup import repeats

    return repeats(table(spark, sf_dir, "documents"), length=100)


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .op09_jaccard import linked

    return linked(table(spark, sf_dir, "documents"), k=3, num=90, den=100)


def op3_hamming_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .op03_hamming import hamming_neighbours, sign_codes

    vectors = table(spark, sf_dir, "embeddings")
    codes = sign_codes(vectors)
    return hamming_neighbours(codes, codes.where("id % 50 = 0"), k=10)


def op6_anisotropic_mips(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .op06_anisotropic import nearest_products, usable

    rows = usable(table(spark, sf_dir, "embeddings"))
    return nearest_products(rows, rows.where("id % 20 = 0"), k=20)


def op8_maxent_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .op08_maxent import scored

    return scored(table(spark, sf_dir, "documents"), by=7, held=2)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .op05_toxicity import toxicity

    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), by=5, held=0)


def op11_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .op11_license import licensed

    return licensed(table(spark, sf_dir, "documents"))


def op12_svd_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .op12_whitening import whitened

    return whitened(table(spark, sf_dir, "embeddings"))


def op13_integer_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .op13_codes import coded

    return coded(table(spark, sf_dir, "embeddings"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = {k: f for k, f in globals().items() if k.startswith("op") and k[2].isdigit()}
    return dict(sorted(found.items(), key=lambda x: int(x[0][2:].split("_")[0])))


#: Sign bits as a bit string, distances by its bits; a query's own row is among the rows.
HAMMING = """
with codes as (
    select vec_id, array_to_string(list_transform(embedding, lambda x: case when x > 0 and not isnan(x) then '1' else '0' end), '')::bit as code
    from embeddings where vec_id is not null and len(embedding) = 64),
near as (
    select q.vec_id as query_id, c.vec_id, bit_count(xor(q.code, c.code))::int as distance,
        row_number() over (partition by q.vec_id order by bit_count(xor(q.code, c.code)), c.vec_id)::int as rank
    from codes q cross join codes c where q.vec_id % 50 = 0)
select query_id, rank, vec_id, distance from near where rank <= 10
"""

#: Shingles, equal sets as classes, links of classes that share a shingle, reachable classes.
JACCARD = """
with recursive worded as (
    select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') as w from documents),
sets as (
    select doc_id, case when len(w) = 0 then [] else list_sort(list_distinct(list_transform(range(1, greatest(len(w) - 2, 1) + 1), lambda i: array_to_string(w[i:i + 2], ' ')))) end as s from worded),
classed as (select doc_id, s, len(s) as n, md5(array_to_string(s, chr(10))) as class from sets),
classes as (select class, any_value(n) as n, any_value(s) as s, min(doc_id) as least from classed where n > 0 group by class),
parts as (select class, n, unnest(s) as shingle from classes),
links as (
    select a.class as a, b.class as b from parts a join parts b on a.shingle = b.shingle and a.class <> b.class and 100 * a.n >= 90 * b.n and 100 * b.n >= 90 * a.n
    group by all having 100 * count(*) >= 90 * (any_value(a.n) + any_value(b.n) - count(*))),
reached as (select class as a, class as b from classes union select r.a, l.b from reached r join links l on r.b = l.a),
least as (select r.a as class, min(c.least) as component_id from reached r join classes c on r.b = c.class group by r.a)
select doc_id, n::bigint as n_shingles, coalesce(component_id, doc_id) as component_id from classed left join least using (class)
"""


def oracle_sql() -> dict[str, str]:
    """The others rest on a tokenizer, a learned model, a codebook, suffix sorting or the tree's own cuts."""
    return {"op3_hamming_topk": HAMMING, "op9_jaccard_join": JACCARD}
