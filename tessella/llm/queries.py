"""The queries of this subpackage's operators, and their SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm import byte_bpe, common, exact_dedup, fill_middle, hard_negatives, licenses, line_dedup, media, minhash, mixing, token_counts, toxicity, url_filter, warc

RULES = [("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/")]
BPE_RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
PIECES = public_tokenizers.path("piece_bpe_32k.model")
TOKEN_LIMIT = 4096


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(common.table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge_urls(common.table(spark, sf_dir, "pages"), RULES).select("page_id", "host", "path", "rule", "verdict")


def op3_media_sniff(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = media.media_features(media.store_media(common.table(spark, sf_dir, "documents")))
    return found.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels"))


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(common.table(spark, sf_dir, "documents"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.line_dedup(common.table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = token_counts.count_tokens(common.table(spark, sf_dir, "documents"), PIECES)
    return out.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > TOKEN_LIMIT).alias("over_limit"))


def bpe_digests(docs: DataFrame) -> DataFrame:
    out = byte_bpe.round_trip(docs, BPE_RANKS, public_tokenizers.PATTERN)
    return out.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_digests(common.table(spark, sf_dir, "documents"))


def op9_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_classes(common.table(spark, sf_dir, "documents"))


def op10_warc_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every record is put together again; its type and reference, and of a response length and digest too, are read from its own bytes."""
    records = warc.archive_pages(common.table(spark, sf_dir, "pages"))
    read = records.select("id", "payload_bytes", "payload_digest", warc.parsed_record(warc.record_bytes()).alias("record"))
    read = read.select("id", "payload_bytes", "payload_digest", "record.*").withColumn("record_type", warc.header_field("WARC-Type"))
    own = F.col("record_type") == "response"
    return read.select(
        F.col("id").alias("page_id"), F.when(own, F.octet_length("body").cast("long")).otherwise(F.col("payload_bytes")).alias("payload_bytes"),
        F.when(own, F.sha2("body", 256)).otherwise(F.col("payload_digest")).alias("payload_digest"),
        "record_type", F.regexp_extract(warc.header_field("WARC-Refers-To"), "<urn:record:(.*)>", 1).cast("long").alias("refers_to"),
    )


def op11_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(common.table(spark, sf_dir, "documents"))


def op12_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The restored text is made from output and form alone."""
    out = fill_middle.fill_middle(common.table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(fill_middle.restored_text(), 256).alias("restored_sha256"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives.hard_negatives(common.table(spark, sf_dir, "embeddings"))


QUERIES = {
    f.__name__: f
    for f in (op1_mix_sources, op2_url_filter, op3_media_sniff, op4_toxicity, op5_exact_dedup, op6_line_dedup, op7_token_counts, op8_byte_bpe, op9_minhash_dedup, op10_warc_archive, op11_license_scan, op12_fill_middle, op13_hard_negatives)
}

def _url_sql(levels: int = 6) -> str:
    """The template tree of url_filter with its levels written out, for paths of up to so many segments."""
    def unlike(bad: str, n: str) -> str:
        """By how many standard errors the shares of gs[i] and gs[i + 1] differ; bad, n: of which fields, first and second."""
        (b1, b2), (n1, n2) = ((f"gs[i].{x.split()[0]}", f"gs[i + 1].{x.split()[1]}") for x in (bad, n))
        pooled = f"({b1} + {b2}) / ({n1} + {n2})"
        return f"case when {b1} / {n1} = {b2} / {n2} then 0.0::double else abs({b1} / {n1} - {b2} / {n2}) / sqrt({pooled} * (1 - {pooled}) * (1 / {n1} + 1 / {n2})) end"

    level = """
        n{0} as (select host, head, count(distinct segment) as children from (select *, rest[1] as segment from t{1} where len(rest) > 0) group by 1, 2),
        b{0} as (select host, head, rest[1] as segment, sum(bad)::bigint as bad, sum(labelled)::bigint as labelled from t{1} where len(rest) > 0 group by 1, 2, 3),
        s{0} as (select host, head from b{0} group by 1, 2 having count(*) <= 20 and sum((labelled >= 5)::int) >= 2),
        k{0}(host, head, gs) as (
            select host, head, list({{'bad': bad, 'n': labelled, 'lb': bad, 'ln': labelled, 'hb': bad, 'hn': labelled, 'members': [segment]}} order by bad / labelled, segment) from b{0} b join s{0} using (host, head) where labelled >= 5 group by 1, 2
            union all select host, head, gs[:best.i - 1] || [{{'bad': o.bad + t.bad, 'n': o.n + t.n, 'lb': o.lb, 'ln': o.ln, 'hb': t.hb, 'hn': t.hn, 'members': o.members || t.members}}] || gs[best.i + 2:]
            from (select *, gs[best.i] as o, gs[best.i + 1] as t from (select *, list_sort(list_filter(list_transform(generate_series(1, len(gs) - 1), lambda i: {{'apart': {means}, 'i': i, 'ends': {ends}}}), lambda p: p.apart <= 1.96::double and p.ends <= 1.96::double))[1] as best from k{0}))
            where best is not null),
        l{0} as (select host, head, unnest(arg_min(gs, len(gs))) as grp from k{0} group by 1, 2),
        m{0} as (select host, head, list_sort(grp.members) as members from l{0}),
        g{0} as (select *, unnest(members) as segment from m{0}),
        x{0} as (select g.host, g.head, g.segment, case when len(members) = 1 then members[1] else '{{' || array_to_string(members, '|') || '}}' end as general from g{0} g
                 union all select b.host, b.head, segment, '*' from b{0} b join s{0} using (host, head) where labelled < 5),
        t{0} as (select t.host, t.shape, t.bad, t.labelled,
                        case when len(rest) = 0 then t.head else t.head || '/' || case when n.children > 20 then '*' else coalesce(x.general, rest[1]) end end as head, rest[2:] as rest
                 from t{1} t left join n{0} n on t.host = n.host and t.head = n.head left join x{0} x on t.host = x.host and t.head = x.head and t.rest[1] = x.segment),"""
    return rf"""
        with recursive r0 as (select page_id, coalesce(url, '') as u, strpos(coalesce(url, ''), '://') as p from pages),
        r1 as (select page_id, case when p > 0 then substr(u, p + 3) else '' end as rest from r0),
        r2 as (select page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path from r1),
        r3 as (select *, list_transform(list_filter(string_split(path, '/'), lambda s: s <> ''), lambda s: case when regexp_matches(s, '[0-9]') or length(s) > 40 then '*' else s end) as parts,
                      case when (host = 'example.org' or ends_with(host, '.example.org')) and starts_with(path, '/en/1') then 'example.org/en/1'
                           when (host = 'example.org' or ends_with(host, '.example.org')) and starts_with(path, '/es/') then 'example.org/es/'
                           when (host = 'com' or ends_with(host, '.com')) and starts_with(path, '/fr/') then 'com/fr/'
                           when (host = 'com' or ends_with(host, '.com')) and starts_with(path, '/de/') then 'com/de/'
                           when (host = 'org' or ends_with(host, '.org')) and starts_with(path, '/') then 'org/' end as rule from r2),
        urls as (select page_id, host, path, rule, case when rule in ('org/', 'com/fr/') then 'allow' when rule is not null then 'block' end as own, array_to_string(parts, '/') as shape, parts from r3),
        t0 as (select host, shape, coalesce(sum((own = 'block')::int), 0)::bigint as bad, count(own) as labelled, '' as head, any_value(parts) as rest from urls group by 1, 2),
        {"".join(level.format(i, i - 1, means=unlike("bad bad", "n n"), ends=unlike("lb hb", "ln hn")) for i in range(1, levels + 1))}
        shapes as (select host, shape, bad, labelled, substr(head || case when len(rest) > 0 then '/' || array_to_string(rest, '/') else '' end, 2) as template from t{levels}),
        ways as (select *, list_transform(generate_series(1, len(string_split(host, '.'))), lambda n: array_to_string(string_split(host, '.')[len(string_split(host, '.')) - n + 1:], '.'))
                   || list_transform(generate_series(1, len(list_filter(string_split(template, '/'), lambda s: s <> ''))), lambda n: host || '/' || array_to_string(string_split(template, '/')[1:n], '/')) as way from shapes),
        evidence as (select node, sum(bad)::bigint as bad, sum(labelled)::bigint as labelled from (select unnest(way) as node, bad, labelled from ways) group by 1),
        fold as (select host, template, way, 0 as level, (select (sum(bad) + 2.5::double) / (sum(labelled) + 5.0::double) from t0) as purity from (select distinct host, template, way from ways)
                 union all select f.host, f.template, f.way, f.level + 1, (e.bad + 5.0::double * f.purity) / (e.labelled + 5.0::double) from fold f join evidence e on e.node = f.way[f.level + 1]),
        judged as (select host, template, purity from fold where level = len(way))
        select page_id, host, path, rule, coalesce(own, case when purity >= 0.75 then 'block' else 'allow' end) as verdict
        from urls join shapes using (host, shape) join judged using (host, template)"""


def _license_sql() -> str:
    """Grams compared as words; diagonals, groups and coverage as in licenses."""
    quoted = lambda words: "[" + ", ".join(f"'{w}'" for w in words) + "]"
    templates = [(label, text.split(), i < len(licenses.PHRASES)) for i, (label, text) in enumerate((*licenses.PHRASES, *licenses.NOTICES))]
    rows = ",\n".join(f"({i}, '{label}', {str(phrase).lower()}, {quoted(words)})" for i, (label, words, phrase) in enumerate(templates))
    return rf"""
        with t as (select *, case when phrase then 2 else 3 end as size, len(words) as length from (values {rows}) v(template, label, phrase, words)),
        g as (select *, list_slice(words, p + 1, p + size) as gram from (select *, unnest(range(length - size + 1)) as p from t)),
        w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{licenses.WORD}') as words from documents),
        s as (select doc_id, size, i, list_slice(words, i + 1, i + size) as gram from (select doc_id, words, size, unnest(range(greatest(len(words) - size + 1, 0))) as i from w, (values (2), (3)) z(size))),
        h as (select doc_id, template, label, phrase, g.size, length, p, i - p as diagonal from s join g on s.size = g.size and s.gram = g.gram),
        l as (select doc_id, template, label, phrase, size, length, diagonal, diagonal + min(p) as first, diagonal + max(p) + size as last,
                     list_distinct(flatten(list(range(p, p + size)))) as covered from h group by doc_id, template, label, phrase, size, length, diagonal),
        a as (select *, sum(apart) over (partition by doc_id, template order by diagonal) as grp
              from (select *, coalesce((phrase or diagonal - lag(diagonal) over (partition by doc_id, template order by diagonal) > 3)::int, 0) as apart from l)),
        m as (select doc_id, template, label, phrase, length, min(first) as first, max(last) - min(first) <= 2 * length as fits, len(list_distinct(flatten(list(covered)))) as all_words, max(len(covered)) as one_line from a group by doc_id, template, label, phrase, length, grp),
        c as (select *, case when fits then all_words else one_line end / length as coverage from m),
        v as (select *, coverage >= case when phrase then 1.0 else 0.8 end as verified from c),
        r as (select doc_id, count(*) filter (where verified and phrase) as n_base, min(first) filter (where verified and phrase) as first_word, max(first) filter (where verified and phrase) as last_word,
                     array_to_string(list_sort(list_distinct(list(label) filter (where verified and phrase))), ',') as base_labels,
                     array_to_string(list_sort(list_distinct(list(label) filter (where verified))), ',') as labels, max(coverage) as score from v group by doc_id)
        select w.doc_id, len(w.words)::bigint as n_words, coalesce(n_base, 0)::bigint as n_base, first_word::bigint as first_word, last_word::bigint as last_word,
               coalesce(base_labels, '') as base_labels, coalesce(labels, '') as labels, coalesce(score, 0)::double as score
        from w left join r using (doc_id)"""


_WORDS = r"[^\x20\x09-\x0D]+"

ORACLE_SQL = {
    "op1_mix_sources": rf"""
        with d as (select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{_WORDS}'))::bigint as size, md5(coalesce(doc_id::varchar, 'null')) as k from documents),
        s as (select source, sum(size)::bigint as source_size, row_number() over (order by source nulls last) as nth from d group by source),
        w as (select *, [3.0::double, 1.0::double, 2.0::double][((nth - 1) % 3 + 1)::int] as weight from s),
        l as (select *, sum(source_size) over () * 1.5::double as budget, row_number() over r as place,
                     coalesce(sum(source_size * 2) over (r rows between unbounded preceding and 1 preceding), 0)::double as fixed,
                     sum(weight) over (r rows between current row and unbounded following) as open_weight
              from w window r as (order by source_size / weight, nth)),
        f as (select min(place) as p from l where source_size * 2 * open_weight >= (budget - fixed) * weight),
        t as (select l.source, l.source_size, case when f.p is null or l.place < f.p then (l.source_size * 2)::double
                     else (g.budget - g.fixed) * l.weight / g.open_weight end as target
              from l cross join f left join l g on g.place = f.p),
        c as (select d.doc_id, d.size, t.source_size, t.target, floor(t.target)::bigint as words,
                     coalesce(sum(d.size) over (partition by d.source order by d.k, d.doc_id, d.size rows between unbounded preceding and 1 preceding), 0)::bigint as before
              from d join t on d.source is not distinct from t.source)
        select doc_id, size, source_size, target,
               case when source_size = 0 then 0 else (words // source_size) * size
                    + greatest(0, least(size, words - (words // source_size) * source_size - before)) end::bigint as taken
        from c""",
    "op2_url_filter": _url_sql(),
    "op5_exact_dedup": r"""
        with d as (select doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') as body from documents),
        g as (select body, min(doc_id) as keep_id, count(*) as group_size from d group by body)
        select d.doc_id, g.keep_id, g.group_size, d.doc_id is not distinct from g.keep_id as kept, sha256(d.body) as text_sha256
        from d join g on d.body = g.body""",
    "op6_line_dedup": r"""
        with l as (select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) as line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) as pos from documents),
        k as (select *, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as key from l),
        r as (select key, max(doc_id) as last_doc from k where length(key) >= 20 group by key having count(distinct doc_id) >= 3),
        m as (select k.doc_id, k.pos, k.line, r.key is not null and k.doc_id <> r.last_doc as gone from k left join r on k.key = r.key)
        select doc_id, count(*) as n_lines, sum(gone::int)::bigint as n_dropped,
               sha256(coalesce(string_agg(line, chr(10) order by pos) filter (where not gone), '')) as kept_sha256
        from m group by doc_id""",
    "op10_warc_archive": r"""
        with p as (select page_id, coalesce(html, '') as body from pages),
        q as (select page_id, octet_length(encode(body)) as payload_bytes, sha256(body) as payload_digest, min(page_id) over (partition by body) as first_id from p)
        select page_id, payload_bytes::bigint as payload_bytes, payload_digest,
               case when payload_bytes >= 100 and page_id <> first_id then 'revisit' else 'response' end as record_type,
               case when payload_bytes >= 100 and page_id <> first_id then first_id end as refers_to
        from q""",
    "op11_license_scan": _license_sql(),
    "op12_fill_middle": r"""
        with d as (select doc_id, coalesce(text, '') as body, sha256('7:' || doc_id) as k from documents),
        h as (select *, list_transform([1, 9, 17, 25], lambda i: ('0x' || substr(k, i, 8))::bigint) as h, string_split(body, chr(10)) as parts from d),
        u as (select doc_id, body, h, list_transform(parts[:-2], lambda s: s || chr(10)) || list_filter(parts[-1:], lambda s: s <> '') as units from h),
        c as (select *, len(units) as n, least(h[1] % (len(units) + 1), h[2] % (len(units) + 1)) as a, greatest(h[1] % (len(units) + 1), h[2] % (len(units) + 1)) as b,
                     case when body = '' or contains(body, '<P>') or contains(body, '<S>') or contains(body, '<M>') then 'plain' when h[4] % 100 < 50 then 'spm' else 'psm' end as form from u),
        p as (select *, array_to_string(units[1:a], '') as prefix, array_to_string(units[a + 1:b], '') as middle, array_to_string(units[b + 1:], '') as suffix from c)
        select doc_id, n::bigint as n, form, case when form <> 'plain' then length(prefix) end::bigint as prefix_chars, case when form <> 'plain' then length(middle) end::bigint as middle_chars,
               sha256(case form when 'plain' then body when 'psm' then '<P>' || prefix || '<S>' || suffix || '<M>' || middle else '<S>' || suffix || '<P>' || prefix || '<M>' || middle end) as output_sha256,
               sha256(body) as restored_sha256
        from p""",
    "op13_hard_negatives": r"""
        with e as (select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label, list_transform(embedding, lambda x: floor(256 * x::double)) as v
                   from embeddings where label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
        p as (select a.vec_id as anchor_id, a.label = b.label as same, b.vec_id, list_inner_product(a.v, b.v)::bigint as score from e a join e b on a.vec_id <> b.vec_id where a.vec_id % 100 = 0),
        good as (select anchor_id, vec_id as positive_id, score as positive_score from p where same qualify row_number() over (partition by anchor_id order by score desc, vec_id) <= 5),
        bad as (select g.*, p.vec_id as negative_id, p.score as negative_score, row_number() over (partition by g.anchor_id, positive_id order by p.score desc, p.vec_id) as rank
                from good g join p on g.anchor_id = p.anchor_id and not p.same and 80 * positive_score <= 100 * p.score and 100 * p.score <= 100 * positive_score)
        select anchor_id, positive_id, rank::int as rank, negative_id, positive_score, negative_score from bad where rank <= 5""",
}
