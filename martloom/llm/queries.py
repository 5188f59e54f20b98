"""Registered queries of the corpus operators, with SQL where it can say the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from martloom.llm import (
    blob_ledger,
    filter_audit,
    fm_quality,
    lang_mixture,
    license_templates,
    preference,
    quality_rules,
    simhash_trie,
    sp_prefix,
    suffix_decontam,
    url_vocab,
    vector_codes,
    warc_zst,
)
from martloom.llm.license_templates import BASE_SCORE, TEMPLATE_SCORE, TEMPLATES
from martloom.llm.rows import crc_remainder

TOKENIZER = "piece_bpe_32k.model"
QUALITY_FOLDS, HELD_QUALITY = 3, 1
LANGUAGE_FOLDS, HELD_LANGUAGE = 4, 2


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(folds: int, held: int):
    return F.coalesce(crc_remainder("doc_id", folds) == held, F.lit(False))


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER)


def quality_machine(labels: DataFrame, docs: DataFrame) -> fm_quality.Machine:
    return fm_quality.fit(docs, labels.where(~held_out(QUALITY_FOLDS, HELD_QUALITY)))


def known_languages(docs: DataFrame) -> lang_mixture.Languages:
    return lang_mixture.learn(docs.where(~held_out(LANGUAGE_FOLDS, HELD_LANGUAGE)))


def quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules.judge(table(spark, sf_dir, "documents"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash_trie.near_copies(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = fm_quality.score(docs, quality_machine(table(spark, sf_dir, "labels"), docs))
    return scored.select("doc_id", held_out(QUALITY_FOLDS, HELD_QUALITY).alias("held_out"), "score", "predicted")


def decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix_decontam.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
        "longest",
        "longest_place",
        "longest_item",
    )


def languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = lang_mixture.identify(docs, known_languages(docs))
    return found.select("doc_id", held_out(LANGUAGE_FOLDS, HELD_LANGUAGE).alias("held_out"), "lang_pred", "score")


def chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = preference.examples(preference.segments(preference.forked_pairs(table(spark, sf_dir, "conversations"))))
    ranges = (F.array_join(F.transform(m, lambda s: F.concat_ws(":", s[0], s[1])), ",").alias(m) for m in ("chosen_mask", "rejected_mask"))
    return made.select("pair_id", "piece", "prompt", "chosen", "rejected", *ranges)


def warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = warc_zst.round_trip(table(spark, sf_dir, "pages"), "page_id", "url", "html")
    return read.select(
        F.col("record_key").try_cast("long").alias("page_id"),
        "payload_bytes",
        "payload_digest",
        "record_type",
        F.col("refers_key").try_cast("long").alias("refers_to"),
    )


def licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = license_templates.scan(table(spark, sf_dir, "documents"))
    score = F.when(F.size("template_labels") > 0, TEMPLATE_SCORE).when(F.size("base_labels") > 0, BASE_SCORE).otherwise(0.0)
    return found.select(
        "doc_id",
        "n_words",
        F.size("starts").cast("long").alias("n_base"),
        F.array_min("starts").alias("first_word"),
        F.array_max("starts").alias("last_word"),
        F.array_join("base_labels", ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union("base_labels", "template_labels")), ",").alias("labels"),
        score.alias("score"),
    )


def sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sp_prefix.digests(table(spark, sf_dir, "documents"), sp_prefix.read_model(tokenizer_path()))


def urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_vocab.judge(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


def secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    versions = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = blob_ledger.scan(versions, blob_ledger.new_ledger(spark))
    kinds = [r.kind for r in blob_ledger.BASE]
    base = F.filter("spans", lambda s: s["kind"].isin(kinds))
    counts = [F.size(F.filter("spans.kind", lambda kind: kind == k)).cast("long").alias(f"n_{k}") for k in kinds]  # noqa: B023
    texts = (F.sha2(blob_ledger.text_of(base), 256).alias("base_sha256"), blob_ledger.text_of(F.col("spans")).alias("spans"))
    return found.select("doc_id", *counts, *texts)


def filter_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def vector_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded, coding = vector_codes.compress(table(spark, sf_dir, "embeddings"))
    return coded.select("vec_id", "code", "error", "label_error", vector_codes.digest_column(coding).alias("codebooks_sha256"))


QUERIES = {
    "op1_quality_rules": quality,
    "op2_simhash_trie": simhash,
    "op3_fm_quality": classifier,
    "op4_suffix_decontam": decontaminate,
    "op5_lang_mixture": languages,
    "op6_preference": chat,
    "op7_warc_zst": warc,
    "op8_license_templates": licenses,
    "op9_sp_prefix": sentencepiece,
    "op10_url_vocab": urls,
    "op11_blob_ledger": secrets,
    "op12_filter_audit": filter_orders,
    "op13_vector_codes": vector_code,
}

# ASCII letters, digits and all beyond ASCII, A-Z lower-cased: the words of the SQL below.
_WORDS = (
    "list_filter(string_split_regex(translate(coalesce({text}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
    r"'[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '')"
)


def _decontaminate_sql() -> str:
    return f"""
    with d as (select row_number() over () as r, doc_id, {_WORDS.format(text='text')} as w from documents),
    i as (select item_id, {_WORDS.format(text='text')} as w from benchmark),
    s as (select row_number() over () as b, item_id, w, least(10, len(w)) as n from i where len(w) > 0),
    parts as (select b, item_id, n, p, array_to_string(w[p:p + n - 1], ' ') as k
              from (select b, item_id, w, n, unnest(range(1, len(w) - n + 2)) as p from s)),
    items as (select distinct item_id, n, k from parts),
    sizes as (select distinct n from items),
    places as (select r, n, w, unnest(range(1, len(w) - n + 2)) as p from d, sizes where len(w) >= n),
    words as (select r, p, n, array_to_string(w[p:p + n - 1], ' ') as k from places),
    found as (select r, p, f.n, item_id from words f join items on items.n = f.n and items.k = f.k),
    runs as (select r, item_id, n, p, p - row_number() over (partition by r, b, p - q order by p) as island, b, p - q as shift
             from (select r, f.p, f.n, b, item_id, parts.p as q from words f join parts on parts.n = f.n and parts.k = f.k)),
    matches as (select r, item_id, min(p) - 1 as place, count(*) + max(n) - 1 as size from runs group by r, b, shift, island, item_id),
    best as (select r, size as longest, place as longest_place, item_id as longest_item from matches
             qualify row_number() over (partition by r order by size desc, place, item_id nulls last) = 1),
    hits as (select r, count(distinct i) as n_hit from (select r, unnest(range(p, p + n)) as i from found) group by r),
    its as (select r, count(*) as n_items, string_agg(id, ',' order by id) as ids
            from (select distinct r, cast(item_id as varchar) as id from found) group by r)
    select doc_id, len(w) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items,
           sha256(coalesce(ids, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated,
           coalesce(longest, 0) as longest, longest_place, longest_item
    from d left join hits using (r) left join its using (r) left join best using (r)"""


def _chat_sql() -> str:
    n = preference.FORKS
    texts = ", ".join(f"coalesce(string_agg(t, '' order by turn) filter (where part = '{p}'), '') as {p}" for p in ("prompt", "chosen", "rejected"))
    masks = ", ".join(
        f"coalesce(string_agg(span, ',' order by turn) filter (where part = '{p}' and role = 'assistant'), '') as {p}_mask" for p in ("chosen", "rejected")
    )
    return f"""
    with c as (select conv_id, turn, {{'role': role, 'text': text}} as s, (conv_id - (conv_id & 1)) // 2 % {n} as k
               from conversations where conv_id is not null and turn is not null),
    t as (select pair_id, side, turn, min(s) as s from (
            select conv_id as pair_id, 0 as side, turn, s from c union all
            select case when turn < (k + {n}) % {n} then conv_id else xor(conv_id, 1) end, 1, turn, s from c) group by all),
    met as (select pair_id, turn, any_value(s) filter (where side = 0) as c, any_value(s) filter (where side = 1) as r from t group by all),
    ends as (select pair_id, min(turn) as last from met where c is distinct from r group by pair_id),
    parts as (select pair_id, 'prompt' as part, turn, c as s from met left join ends using (pair_id) where last is null or turn < last
              union all select pair_id, 'chosen', turn, c from met join ends using (pair_id) where turn >= last and c is not null
              union all select pair_id, 'rejected', turn, r from met join ends using (pair_id) where turn >= last and r is not null),
    shown as (select pair_id, floor(turn / {preference.ROW_TURNS})::bigint as piece, part, turn, s.role as role,
                     '{preference.START}' || coalesce(s.role, '') || chr(10) as header,
                     coalesce(s.text, '') || '{preference.END[:-1]}' || chr(10) as body from parts),
    placed as (select *, header || body as t, sum(length(header) + length(body)) over (partition by pair_id, piece, part order by turn) as stop
               from shown),
    marked as (select *, (stop - length(body))::bigint || ':' || stop::bigint as span from placed)
    select pair_id, piece, {texts}, {masks} from marked group by pair_id, piece"""


_WARC_SQL = f"""
    with p as (select page_id, coalesce(html, '') as html from pages),
    s as (select page_id, octet_length(encode(html)) as payload_bytes, sha1(html) as payload_digest from p),
    m as (select *, max(page_id) over (partition by payload_digest) as first from s)
    select page_id, payload_bytes, payload_digest,
           case when payload_bytes >= {warc_zst.REVISIT_BYTES} and page_id is distinct from first then 'revisit' else 'response' end as record_type,
           case when payload_bytes >= {warc_zst.REVISIT_BYTES} and page_id is distinct from first then first end as refers_to
    from m"""


def _urls_sql() -> str:
    terms = {"strict": "|".join(url_vocab.STRICT), "soft": "|".join(url_vocab.SOFT)}
    rules = ", ".join(
        f"('{r}', '{verdict}', '{r.partition('/')[0]}', '/{r.partition('/')[2]}', {len(r)})" for verdict, r in url_vocab.RULES
    )
    fold = "translate(coalesce({0}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    soft = " + ".join(f"cast(regexp_matches(u, '(^|[^a-z0-9]){w}($|[^a-z0-9])') as int)" for w in url_vocab.SOFT)
    return f"""
    with p as (select row_number() over () as r, page_id, {fold.format('url')} as u,
                      {fold.format("regexp_extract(url, '^(?s:.*?)://([^/?#]*)', 1)")} as host,
                      coalesce(regexp_extract(url, '^(?s:.*?)://[^/?#]*([^?#]*)', 1), '') as path from pages),
    rules(name, verdict, owner, start, size) as (values {rules}),
    fit as (select r, arg_max(name, size) as rule, arg_max(verdict, size) as verdict from p
            join rules on (host = owner or ends_with(host, '.' || owner)) and starts_with(path, start) group by r),
    m as (select r, regexp_matches(u, '(^|[^a-z0-9])({terms['strict']})($|[^a-z0-9])') or {soft} >= {url_vocab.SOFT_LIMIT} as bad from p)
    select page_id, host, path, rule, coalesce(verdict, case when bad then 'block' else 'allow' end) as verdict
    from p left join fit using (r) join m using (r)"""


def _quality_sql() -> str:
    """The base columns and the divergence rule, with the references computed from the documents as well."""
    limits = quality_rules.Limits()
    words = r"list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '')"
    fold = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    classes = {
        "lower": "a-z", "upper": "A-Z", "digit": "0-9", "blank": r"\x20\x09", "line": r"\x0A-\x0D", "symbol": "#*$%&|<>",
        "mark": r"!\x22'()+,\-./:;=?@\[\\\]\^_`{}~", "control": r"\x00-\x08\x0E-\x1F\x7F", "beyond": r"\x{80}-\x{10FFFF}",
    }
    counted = ", ".join(f"length(regexp_replace(t, '[^{c.replace(chr(39), chr(39) * 2)}]+', '', 'g')) as {k}_" for k, c in classes.items())
    names = [f"{k}_" for k in classes]
    long = " union all ".join(f"select r, lang, '{n}' as c, {n} as n, {' + '.join(names)} as total from k" for n in names)
    part = "coalesce(case when {x} > 0 then {x} * log2({x} / ({x} + {y}) * 2) end, 0)"
    jsd = f"sqrt(greatest(0, sum({part.format(x='p', y='q')} + {part.format(x='q', y='p')}) / 2))"
    return f"""
    with d as (select row_number() over () as r, doc_id, lang, coalesce(text, '') as t, text is null as none, {words} as w from documents),
    x as (select r, unnest(w) as x, generate_subscripts(w, 1) as p from d),
    x3 as (select r, p, x, lead(x) over f as y, lead(x, 2) over f as z from x window f as (partition by r order by p)),
    reps as (select r, count(*) as n from (
               select distinct r, unnest([p, p + 1, p + 2]) as i from (
                 select r, p, count(*) over (partition by r, x, y, z) as times from x3 where z is not null) where times > 1) group by r),
    dups as (select r, sum(n - 1) as n from (
               select r, l, count(*) as n from (select r, unnest(string_split(t, chr(10))) as l from d)
               where regexp_matches(l, '[^\\x20\\x09-\\x0D]') group by r, l) group by r),
    base as (select d.r, doc_id, len(w) as n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) as word_chars,
                    length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) as n_symbols, coalesce(dups.n, 0) as n_dup_lines,
                    coalesce(reps.n, 0) as n_repeat_words
             from d left join reps using (r) left join dups using (r)),
    k as (select r, lang, none, {counted} from d),
    kl as ({long}),
    kr as (select lang, c, n * 1.0 / sum(n) over (partition by lang) as q
           from (select lang, c, sum(n) as n from kl join d using (r, lang) where lang is not null and not none group by lang, c)),
    kd as (select r, min(x) as x from (
             select r, kr.lang, {jsd} as x from (select r, c, n * 1.0 / greatest(total, 1) as p from kl) join kr using (c) group by r, kr.lang)
           group by r),
    wc as (select r, lang, none, {fold.format('x')} as x, count(*) as n from (select r, lang, none, unnest(w) as x from d) group by all),
    wl as (select lang, x, sum(n) as n from wc where lang is not null and not none group by lang, x),
    wt as (select *, sum(n) over (partition by lang) as total,
                  row_number() over (partition by lang order by n desc, encode(x)) as place from wl),
    wr as (select lang, x, n * 1.0 / total as q, place from wt where place <= {limits.common_words}),
    rest as (select lang, 1 - sum(q) as q from wr group by lang),
    pairs as (select d.r, lang.lang, len(w) as size from d, (select distinct lang from wr) lang),
    hit as (select pairs.r, pairs.lang, wr.x, q, coalesce(wc.n, 0) * 1.0 / greatest(size, 1) as p
            from pairs join wr using (lang) left join (select r, x, n from wc) wc on wc.r = pairs.r and wc.x = wr.x),
    all_ as (select r, lang, q, p from hit
             union all select r, lang, max(rest.q), case when max(size) > 0 then 1 - sum(p) else 0 end
                       from hit join rest using (lang) join pairs using (r, lang) group by r, lang),
    wd as (select r, min(x) as x from (select r, lang, {jsd.replace('sum(', 'sum(')} as x from (
             select r, lang, greatest(p, 0) as p, greatest(q, 0) as q from all_) group by r, lang) group by r),
    v as (select base.*, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed,
                 {' + '.join(names)} as size, kd.x as by_class, wd.x as by_word
          from base join k using (r) left join kd using (r) left join wd using (r))
    select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
           not base_failed and not (size >= {limits.min_chars} and coalesce(by_class, 0) > {limits.max_class_distance})
           and not (n_words >= {limits.min_words} and coalesce(by_word, 0) > {limits.max_word_distance}) as kept
    from v"""


def _licenses_sql() -> str:
    """Base phrases by place; templates as patterns over the words joined by single blanks."""
    phrases = ", ".join(f"('{p}', '{label}', {len(p.split())})" for p, label in license_templates.PHRASES.items())
    templates = ", ".join(f"('{k}', '{_pattern(t)}')" for k, t in TEMPLATES.items())
    return f"""
    with d as (select row_number() over () as r, doc_id, {_WORDS.format(text='text')} as w from documents),
    phrases(phrase, label, n) as (values {phrases}),
    templates(label, pattern) as (values {templates}),
    places as (select r, p - 1 as i, label from (select r, w, unnest(range(1, len(w) + 1)) as p from d), phrases
               where w[p] = split_part(phrase, ' ', 1) and array_to_string(w[p:p + n - 1], ' ') = phrase),
    base as (select r, count(*) as n_base, min(i) as first_word, max(i) as last_word, string_agg(distinct label, ',' order by label) as labels
             from places group by r),
    more as (select distinct r, label from (select r, ' ' || array_to_string(w, ' ') || ' ' as t from d), templates
             where regexp_matches(t, pattern)),
    every as (select r, string_agg(label, ',' order by label) as labels, bool_or(starts_with(label, 'template:')) as full_
              from (select distinct r, label from places union select r, label from more) group by r)
    select doc_id, len(w) as n_words, coalesce(n_base, 0) as n_base, first_word, last_word, coalesce(base.labels, '') as base_labels,
           coalesce(every.labels, '') as labels, case when full_ then {TEMPLATE_SCORE} when n_base > 0 then {BASE_SCORE} else 0.0 end as score
    from d left join base using (r) left join every using (r)"""


def _pattern(template: str) -> str:
    """A template as a pattern in which every word follows a blank."""
    out = []
    for token in template.replace("[[", " [[ ").replace("]]", " ]] ").split():
        if token == "[[":
            out.append("(?:")
        elif token == "]]":
            out.append(")?")
        else:
            out.append(f"(?: [^ ]+){{0,{token[1:-1]}}}" if token.startswith("{") else f" {token}")
    return "".join(out) + " "


def _secrets_sql() -> str:
    """Matches and the texts between them, numbered alike; starts and ends are running sums of their lengths."""
    found = " union all ".join(
        f"""select r, {i} as k, '{rule.kind}' as kind, {rule.least} as least, string_split_regex(t, '{rule.pattern}') as gaps,
                   regexp_extract_all(t, '{rule.pattern}') as m, regexp_extract_all(t, '{rule.pattern}', {rule.group}) as g
            from d where regexp_matches(t, '{rule.pattern}')"""
        for i, rule in enumerate(blob_ledger.RULES)
    )
    counts = ", ".join(f"coalesce(count(*) filter (where kind = '{r.kind}'), 0) as n_{r.kind}" for r in blob_ledger.BASE)
    base = ", ".join(f"'{r.kind}'" for r in blob_ledger.BASE)
    return f"""
    with d as (select row_number() over () as r, doc_id, coalesce(text, '') as t from documents),
    found as ({found}),
    each as (select r, k, kind, least, unnest(gaps[1:len(m)]) as gap, unnest(m) as m, unnest(g) as g, generate_subscripts(m, 1) as i from found),
    placed as (select *, sum(length(gap) + length(m)) over (partition by r, k order by i) as stop from each),
    spans as (select r, k, kind, stop - length(m) as start, kind || ':' || (stop - length(m))::bigint || ':' || stop::bigint as s
              from placed where length(g) >= least),
    per as (select r, {counts}, string_agg(s, ',' order by start, k) filter (where kind in ({base})) as base,
                   string_agg(s, ',' order by start, k) as all_ from spans group by r)
    select doc_id, {", ".join(f"coalesce(n_{r.kind}, 0) as n_{r.kind}" for r in blob_ledger.BASE)},
           sha256(coalesce(base, '')) as base_sha256, coalesce(all_, '') as spans
    from d left join per using (r)"""


_FILTERS_SQL = r"""
    with d as (select doc_id, coalesce(text, '') as t, coalesce(lang, '') as part,
                      list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') as w from documents),
    firsts as (select t, min(doc_id) as first from d group by t),
    known as (select doc_id, max(coalesce(quality, 0) = 1) as good, max(coalesce(toxic, 0) = 1) as bad from labels where doc_id is not null group by doc_id),
    f as (select part, len(w) < 100 as a, 100 * len(list_distinct(w)) < 80 * len(w) as b,
                 100 * length(regexp_replace(t, '[^A-Z]+', '', 'g')) > 10 * length(t) as c, regexp_matches(t, '[#$%&*|]') as d,
                 coalesce(d.doc_id > first, false) as e, coalesce(good, false) as good, coalesce(bad, false) as bad
          from d join firsts using (t) left join known on known.doc_id = d.doc_id),
    cells as (select part, [a, b, c, d, e] as fails, count(*) as n, count(*) filter (where good) as good, count(*) filter (where bad) as bad
              from f group by all),
    l(x) as (values (1), (2), (3), (4), (5)),
    orders as (select [a.x, b.x, c.x, d.x, e.x] as o from l a, l b, l c, l d, l e where len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
    steps as (select o, x as step, o[x] as own, o[:x - 1] as before from orders, l),
    judged as (select part, o, step, own, n, good, bad, fails[own] as failed, len(list_filter(before, lambda i: fails[i])) = 0 as reached,
                      len(list_filter(fails, lambda v: v)) = 1 as single from steps, cells),
    s as (select part, o, step, own, coalesce(sum(n) filter (where reached and not failed), 0)::bigint as kept,
                 coalesce(sum(n) filter (where reached and failed), 0)::bigint as removed,
                 coalesce(sum(n) filter (where not reached and failed), 0)::bigint as redundant,
                 coalesce(sum(n) filter (where failed and single), 0)::bigint as unique_fails,
                 coalesce(sum(good) filter (where reached and failed), 0)::bigint as good_lost,
                 coalesce(sum(bad) filter (where reached and failed), 0)::bigint as toxic_lost
          from judged group by all)
    select part, array_to_string(list_transform(o, lambda i: chr(64 + i)), '') as filter_order, step::int as step, kept, removed, redundant,
           unique_fails, good_lost, toxic_lost, (sum(removed) over (partition by part, own))::bigint as shapley
    from s"""


def _vectors_sql() -> str:
    """Two rounds written out; components are numbered 0, 1, ... and belong to equal consecutive parts."""
    s = vector_codes.Settings()

    def nearest(books: str) -> str:
        return f"""select r, part, arg_min(entry, far * {s.entries} + entry) as entry, min(far) as far
                   from (select r, c.part, entry, sum((c.x - b.x) * (c.x - b.x)) as far from c join {books} b using (part, pos) group by r, c.part, entry)
                   group by r, part"""

    def rounds() -> str:
        out = []
        for i in range(1, s.rounds + 1):
            out.append(
                f"""n{i} as ({nearest(f'b{i - 1}')}),
    b{i} as (select part, entry, pos, coalesce(y, x) as x from b{i - 1} left join
             (select part, entry, pos, floor(sum(x) / count(*))::bigint as y from c join n{i} using (r, part) group by all) using (part, entry, pos))"""
            )
        return ",\n    ".join(out)

    return f"""
    with k as (select row_number() over () as r, vec_id, label, embedding as v from embeddings
               where len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
    size as (select arg_min(len(v), vec_id) // {s.parts} as width from k),
    c as (select r, i // width as part, i % width as pos, x from size,
          (select r, floor({s.scale} * unnest(v)::double)::bigint as x, generate_subscripts(v, 1) - 1 as i from k)),
    b0 as (select part, entry, pos, x from c join (select r, row_number() over (order by vec_id) - 1 as entry from k order by vec_id limit {s.entries}) using (r)),
    {rounds()},
    last as ({nearest(f'b{s.rounds}')}),
    coded as (select r, string_agg(lower(printf('%02x', entry)), '' order by part) as code, sum(far)::bigint as error from last group by r)
    select vec_id, code, error, (sum(error) over (partition by label))::bigint as label_error,
           (select sha256(string_agg(x::varchar, ',' order by part, entry, pos)) from b{s.rounds}) as codebooks_sha256
    from k join coded using (r)"""


ORACLES = {
    "op1_quality_rules": _quality_sql(),
    "op4_suffix_decontam": _decontaminate_sql(),
    "op6_preference": _chat_sql(),
    "op7_warc_zst": _WARC_SQL,
    "op8_license_templates": _licenses_sql(),
    "op10_url_vocab": _urls_sql(),
    "op11_blob_ledger": _secrets_sql(),
    "op12_filter_audit": _FILTERS_SQL,
    "op13_vector_codes": _vectors_sql(),
}
