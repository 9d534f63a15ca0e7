"""The registered queries of the operators, with SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import new_path
from .alignment import align
from .ann import nearest
from .common import UPPER, stored, table
from .exact_dedup import DigestIndex, dedup
from .html_text import extract
from .language import languages
from .license_texts import NOTICES
from .licenses import SHINGLE, find_licenses
from .mixing import mix
from .packing import pack
from .quality import quality
from .secret_scan import secrets
from .simhash import near_groups
from .spelling import variants, words_of
from .token_files import write_token_files

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

LOWER = f"translate(coalesce(text, ''), '{UPPER}', '{UPPER.lower()}')"


def registered(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(query: Query) -> Query:
        QUERIES[name] = query
        if sql is not None:
            ORACLES[name] = sql
        return query

    return add


@registered("op1_exact_dedup", f"""
    select doc_id, max(doc_id) over w as keep_id, count(*) over w as group_size,
           doc_id = max(doc_id) over w as kept, text_sha256
    from (select doc_id, sha256({LOWER}) as text_sha256 from documents)
    window w as (partition by text_sha256)
""")
def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(table(spark, sf_dir, "documents"))


@registered("op1_index_batches", f"""
    with rows as (
        select doc_id, doc_id % 2 = 0 as second, sha256({LOWER}) as text_sha256 from documents
    ), firsts as (
        select text_sha256, max(doc_id) as id from rows where not second group by 1
    ), seconds as (
        select text_sha256, max(doc_id) as id from rows where second group by 1
    )
    select r.doc_id, coalesce(f.id, s.id) as keep_id, r.doc_id = coalesce(f.id, s.id) as kept, r.text_sha256
    from rows r left join firsts f using (text_sha256) left join seconds s using (text_sha256)
""")
def op1_index_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with odd ids, then those with even ones against the index that holds the first."""
    docs, path = table(spark, sf_dir, "documents"), new_path(spark, "index")
    told = []
    for rest in (1, 0):
        index = DigestIndex(spark, path)
        told.append(stored(index.add(docs.where(F.col("doc_id") % 2 == rest)), "told"))
        index.close()
    return told[0].union(told[1]).select("doc_id", "keep_id", "kept", "text_sha256")


@registered("op2_nearest")
def op2_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"))


@registered("op3_html_text")
def op3_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))


@registered("op4_language")
def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    span = "transform(spans, s -> concat_ws(':', s.start, s.end, s.lang))"
    return languages(table(spark, sf_dir, "documents")).withColumn("spans", F.array_join(F.expr(span), ","))


@registered("op6_secrets")
def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets(table(spark, sf_dir, "documents"))


@registered("op5_simhash")
def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_groups(table(spark, sf_dir, "documents"))


@registered("op7_packing")
def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(
        table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), form="bytes"
    ).withColumn("ids", F.crc32("ids")).withColumnRenamed("ids", "ids_crc32")


@registered("op8_mixing", r"""
    with docs as (
        select doc_id, source,
               len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::bigint as size,
               ('0x' || substr(md5(coalesce(doc_id::varchar, '')), 1, 15))::bigint as h
        from documents
    ), sizes as (
        select source, sum(size)::bigint as s,
               [5.0, 2.0, 1.0][((row_number() over (order by source nulls last) - 1) % 3 + 1)::int]::double as w
        from docs group by source
    ), shares as (
        -- sources by the share at which they reach their limit; those before k are held at it
        select source, s, w, 3 * s / w as reach,
               ((sum(s) over ())::bigint
                - coalesce(sum(3 * s) over (order by 3 * s / w, source nulls last
                    rows between unbounded preceding and 1 preceding), 0)::bigint)
               / (sum(w) over (order by 3 * s / w, source nulls last
                    rows between current row and unbounded following)) as share
        from sizes
    ), final as (
        select source, s,
               w * share_all as uncapped, 3 * s as most,
               case when w * share_all > 3 * s then (3 * s)::double else w * share_all end as target
        from (
            select *, coalesce(
                (select min_by(share, reach) from shares where share * w <= 3 * s), 0) as share_all
            from shares
        )
    ), parts as (
        select source, s, target,
               case when s > 0 then floor(target / s)::bigint else 0 end as whole
        from final
    ), placed as (
        select d.doc_id, d.size, d.source, p.s, p.target, p.whole, d.h,
               sum(d.size) over (partition by d.source order by d.h range unbounded preceding)::bigint as upto,
               sum(d.size) over (partition by d.source, d.h)::bigint as at_h
        from docs d join parts p on d.source is not distinct from p.source
    )
    select doc_id, size, s as source_size, target,
           size * (whole + (2 * upto - at_h <= 2 * (target - whole * s))::int)::bigint as taken
    from placed
""")
def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select(
        "doc_id", "size", "source_size", "target", "taken"
    )


_TEMPLATES = ", ".join(f"('{name}', '{body}')" for name, body in NOTICES)


@registered("op9_licenses", rf"""
    with body as (
        select doc_id as k, trim(regexp_replace({LOWER}, '[^a-z0-9]+', ' ', 'g')) as t from documents
    ), words as (
        select k, string_split(t, ' ') as w from body
    ), shingles as (
        select k, i - 1 as p, array_to_string(w[i:i + {SHINGLE - 1}], ' ') as sh
        from (select k, w, unnest(range(1, len(w) - {SHINGLE - 2})) as i from words)
    ), template as (
        select name, string_split(trim(regexp_replace(lower(body), '[^a-z0-9]+', ' ', 'g')), ' ') as w
        from (values {_TEMPLATES}) t(name, body)
    ), pieces as (
        select distinct name, array_to_string(w[i:i + {SHINGLE - 1}], ' ') as sh
        from (select name, w, unnest(range(1, len(w) - {SHINGLE - 2})) as i from template)
    ), sized as (
        select name, count(*) as n, pow(2, ceil(log2(count(*))))::bigint as step
        from pieces group by name
    ), hits as (
        select k, name, n, p // step - back as win, s.sh
        from shingles s join pieces using (sh) join sized using (name), (values (0), (1)) b(back)
        where p // step - back >= 0
    ), found as (
        select k, name, win, count(distinct sh) / any_value(n) as share
        from hits group by k, name, win having count(distinct sh) / any_value(n) >= 0.8
    )
    select k as doc_id, name as license, max(share) as containment, count(*) as windows
    from found group by k, name
""")
def op9_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_licenses(table(spark, sf_dir, "documents"), NOTICES)


@registered("op10_quality")
def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@registered("op12_alignment")
def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align(
        table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"),
        public_tokenizers.path("piece_bpe_32k.model"), digest=True,
    ).withColumnRenamed("groups", "groups_sha256")


@registered("op13_token_files")
def op13_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = write_token_files(
        table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"),
        new_path(spark, "token_files"),
    )
    return files.read(form="bytes").select(
        "doc_id", "start", (F.octet_length("ids") / 4).cast("bigint").alias("n_tokens"),
        F.crc32("ids").alias("ids_crc32"),
    )


@registered("op11_spelling")
def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants(words_of(table(spark, sf_dir, "documents")))
