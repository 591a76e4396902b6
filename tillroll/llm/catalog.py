"""The registered queries of the operators and their SQL where SQL can express them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillroll.llm import (
    bpe,
    contamination,
    hilbert,
    jaccard,
    lines,
    pages,
    phrases,
    repeats,
    secrets,
    sharding,
    toxicity,
    tree,
    trie,
)
from tillroll.llm.text import held_out

BPE_RANKS = "byte_bpe_multi_50k.tiktoken"
TREE_FILE = "byte_bpe_50k.json"


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{table}.parquet")


def page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.digest(_read(spark, sf_dir, "pages"))


def byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digest(_read(spark, sf_dir, "documents"), public_tokenizers.path(BPE_RANKS))


def nnpu_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    model = toxicity.fit(docs, _read(spark, sf_dir, "labels"))
    return toxicity.score(docs.select("doc_id", "text"), model).select(
        "doc_id",
        held_out().alias("held_out"),
        F.col("toxicity").alias("score"),
        (F.col("toxicity") >= 0.5).cast("int").alias("predicted"),
    )


def secret_network(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    return secrets.digest(docs, secrets.fit(docs))


def jaccard_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join(_read(spark, sf_dir, "documents"))


def hilbert_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hilbert.search(_read(spark, sf_dir, "embeddings"))


def vector_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign(_read(spark, sf_dir, "documents")).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def minhash_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.remove(_read(spark, sf_dir, "documents").select("doc_id", "text"), report=True)


def repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.digest(_read(spark, sf_dir, "documents"))


def latent_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination.leaks(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


def phrase_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.mine(_read(spark, sf_dir, "documents"))


def turn_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie.branched_trie(_read(spark, sf_dir, "conversations"))


def tree_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tree.digest(_read(spark, sf_dir, "documents"), public_tokenizers.path(TREE_FILE))


def registered() -> dict:
    return {
        "op1_nnpu_toxicity": nnpu_toxicity,
        "op2_secret_network": secret_network,
        "op3_page_differencing": page_text,
        "op4_byte_bpe": byte_bpe,
        "op5_jaccard_tiles": jaccard_tiles,
        "op6_hilbert_neighbours": hilbert_neighbours,
        "op7_vector_sharding": vector_sharding,
        "op8_minhash_lines": minhash_lines,
        "op9_repeated_passages": repeated_passages,
        "op10_latent_decontamination": latent_decontamination,
        "op11_phrase_fingerprints": phrase_fingerprints,
        "op12_turn_trie": turn_trie,
        "op13_tree_bpe": tree_bpe,
    }


_NEIGHBOURS = """
with held as (
    select distinct vec_id, embedding::double[] as e from embeddings
    where vec_id is not null and len(embedding) > 0
      and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
      and len(list_filter(embedding, lambda x: x <> 0)) > 0
), width as (
    select len(e) as n from held group by 1 order by count(*) desc, 1 limit 1
), v as (
    select vec_id, e from held where len(e) = (select n from width)
), d as (
    select q.vec_id as query_id, p.vec_id, sqrt(list_reduce(
        list_transform(list_zip(q.e, p.e), lambda z: (z[1] - z[2]) * (z[1] - z[2])), lambda a, b: a + b)) as score
    from v q join v p on p.vec_id <> q.vec_id where q.vec_id % 100 = 0
)
select query_id, cast(row_number() over (partition by query_id order by score, vec_id) as int) as rank, vec_id,
       score
from d qualify rank <= 10
"""


_JACCARD = """
with recursive lists as (
    select doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
        'abcdefghijklmnopqrstuvwxyz'), '[ \\t\\n\\x0B\\f\\r]+'), lambda x: x <> '') as w
    from documents
), words as (
    select doc_id, unnest(w) as word, generate_subscripts(w, 1) as place, len(w) as n from lists
), held as materialized (
    select distinct doc_id, x from (
        select doc_id, word || ' ' || lead(word, 1) over d || ' ' || lead(word, 2) over d || ' ' || lead(word, 3) over d
            || ' ' || lead(word, 4) over d as x
        from words where n >= 5 window d as (partition by doc_id order by place))
    where x is not null
    union all
    select doc_id, string_agg(word, ' ' order by place) from words where n < 5 group by doc_id
), sizes as (
    select doc_id, count(*) as n from held group by doc_id
), links as (
    select a, b from (
        select l.doc_id as a, r.doc_id as b, count(*) as c from held l join held r on l.x = r.x and l.doc_id <> r.doc_id
        group by all)
    join sizes p on p.doc_id = a join sizes q on q.doc_id = b
    where 100 * c >= 75 * (p.n + q.n - c)
), reached as (
    select doc_id, doc_id as from_id from documents
    union
    select b, from_id from reached join links on a = doc_id
)
select d.doc_id, coalesce(any_value(s.n), 0) as n_shingles, min(r.from_id) as component_id
from documents d left join sizes s using (doc_id) join reached r using (doc_id) group by d.doc_id
"""


_PHRASES = r"""
with pieces as (
    select coalesce(lang, 'und') as lang, unnest(string_split_regex(translate(coalesce(text, ''),
        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) as piece
    from documents
), lists as materialized (
    select lang, list_filter(string_split_regex(piece, '[ \x09]+'), lambda x: x <> '') as w from pieces
), totals as (
    select lang, sum(len(w)) as n from lists group by lang
), f as materialized (
    select lang, k, phrase, count(*) as a from (
        select lang, k, array_to_string(list_slice(w, i, i + k - 1), ' ') as phrase from (
            select lang, w, k, unnest(range(1, len(w) - k + 2)) as i
            from lists, (select unnest(range(1, 6)) as k) where len(w) >= k))
    group by all having count(*) >= 100
), cuts as (
    select lang, phrase, a, k, c, array_to_string(list_slice(w, 1, c), ' ') as first,
        array_to_string(list_slice(w, c + 1, k), ' ') as rest
    from (select *, string_split(phrase, ' ') as w, unnest(range(1, k)) as c from f where k > 1)
), scored as (
    select p.lang, p.phrase, p.a, p.k, l.a as l, r.a as r, t.n, c,
        1000::hugeint * p.a * t.n // (l.a::hugeint * r.a) as score
    from cuts p join f l on l.lang = p.lang and l.phrase = p.first join f r on r.lang = p.lang and r.phrase = p.rest
    join totals t on t.lang = p.lang
), weakest as (
    select * from scored qualify row_number() over (partition by lang, phrase order by score, c) = 1
), kept as (
    select * from weakest s where not exists (
        select 1 from f g where g.lang = s.lang and g.k > s.k and g.a >= s.a
            and contains(' ' || g.phrase || ' ', ' ' || s.phrase || ' '))
)
select lang, row_number() over (partition by lang order by score desc, a desc, phrase) as rank, phrase, a::bigint as a,
    l::bigint as l, r::bigint as r, n::bigint as n, score::bigint as score
from kept qualify rank <= 2000
"""


_TRIE = """
with t as (
    select c, id, bytes, row_number() over (partition by c order by turn nulls first, role, id) - 1 as p from (
        select conv_id as c, turn, coalesce(role, '') as role, strlen(coalesce(text, '')) as bytes,
            left(sha256(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')), 32) as id
        from conversations where conv_id is not null)
), convs as (
    select c, c - c % 5 as b, xor(list_reduce(
        list_concat([4294967295::ubigint], list_transform(string_split(c::varchar, ''), lambda x: ord(x)::ubigint)),
        lambda a, b: list_reduce([xor(a, b), 0::ubigint, 0, 0, 0, 0, 0, 0, 0],
            lambda d, e: xor(d >> 1, 3988292384::ubigint * (d & 1::ubigint)))), 4294967295::ubigint) % 9 as h
    from (select distinct c from t)
), turns as (
    select v.c, 0 as own, t.p, t.id, t.bytes from convs v join t on t.c = v.b where t.p < v.h
    union all
    select v.c, 1, t.p, t.id, t.bytes from convs v join t on t.c = v.c where t.p >= v.h
), deep as (
    select c, row_number() over w as d, bytes, sha256(string_agg(id, '') over w) as key
    from turns window w as (partition by c order by own, p)
), paths as materialized (
    select c, d, bytes, key, lag(key) over (partition by c order by d) as parent, max(d) over (partition by c) as n from (
        select c, 0 as d, 0 as bytes, '' as key from convs union all select * from deep)
), nodes as materialized (
    select key, any_value(d) as d, any_value(parent) as parent, min(c) as conv_id, count(*) as n_convs,
        any_value(bytes) as bytes, sha256(coalesce(string_agg(c::varchar, ',' order by c) filter (n = d), '')) as ends
    from paths group by key
), sized as materialized (
    select x.*, (select count(*) from nodes y where y.parent = x.key) as n_children from nodes x
), below as (
    select p.key, count(*) filter (x.n_children = 0) as n_leaves, sum((x.n_convs - 1) * x.bytes) as saved
    from sized x join paths p on p.c = x.conv_id and p.d <= x.d group by p.key
)
select x.conv_id::bigint as conv_id, x.d::bigint as depth, u.conv_id::bigint as parent_conv_id,
    x.n_convs::bigint as n_convs, x.n_children::bigint as n_children, b.n_leaves::bigint as n_leaves,
    b.saved::bigint as saved_tokens, x.ends as ends_sha256
from sized x left join nodes u on u.key = x.parent join below b on b.key = x.key
"""


def statements() -> dict[str, str]:
    """SQL of the queries that SQL can express and run over whole tables; tests hold the others against plain forms."""
    return {
        "op5_jaccard_tiles": _JACCARD,
        "op6_hilbert_neighbours": _NEIGHBOURS,
        "op11_phrase_fingerprints": _PHRASES,
        "op12_turn_trie": _TRIE,
    }
