"""The registered queries of the operators, each over its whole table, and SQL that states the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from meterstone.llm import chat, exact, lexical, lm, mixing, nndescent, pieces, pq, quality, secret_scan, spelling, superminhash, warc
from meterstone.llm.tables import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def wrap(build: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = build
        if sql is not None:
            ORACLES[name] = sql
        return build

    return wrap


def piece_model(path: str | None = None) -> bytes:
    """The serialised model of the registered encoding, read on the driver; its bytes travel with the tasks."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("piece_bpe_32k.model")
    with open(path, "rb") as f:
        return f.read()


def _raked(sweeps: int = 40) -> str:
    """The fitting as a chain of table expressions, and the sampled rows."""
    out = [
        r"""labelled as (
  select doc_id, coalesce(source, '') as source, coalesce(lang, '') as lang, coalesce(text, '') as t,
    len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) as n_tokens from documents
)"""
    ]
    marks = []
    for name, words in mixing.TOPICS.items():
        terms = " + ".join(f"(strlen(t) - strlen(replace(t, '{w}', ''))) / {len(w)}::double" for w in words)
        marks.append(f"{terms} as n_{name}")
    best = "greatest(" + ", ".join(f"n_{name}" for name in mixing.TOPICS) + ")"
    cases = " ".join(f"when n_{name} = {best} then '{name}'" for name in mixing.TOPICS)
    out.append(f"marked as (select *, {', '.join(marks)} from labelled)")
    out.append(f"rows_ as (select doc_id, source, lang, n_tokens, case when {best} = 0 then '{mixing.NO_TOPIC}' {cases} end as topic from marked)")
    out.append("cells as (select source, lang, topic, sum(n_tokens)::double as tokens, sum(n_tokens)::double as w from rows_ group by 1, 2, 3)")
    for name, power in mixing.TARGETS.items():
        out.append(
            f"m_{name} as (select {name}, case when sum(tokens) > 0 then pow(sum(tokens), {power}) else 0 end as wanted from cells group by 1), "
            f"t_{name} as (select {name}, wanted / sum(wanted) over () as share from m_{name})"
        )
    before = "cells"
    for k in range(sweeps):
        for name in mixing.TARGETS:
            after = f"s{k}_{name}"
            out.append(
                f"{after} as materialized (select source, lang, topic, tokens, case when sum(w) over (partition by {name}) > 0 "
                f"then w * share / sum(w) over (partition by {name}) else 0 end as w from {before} join t_{name} using ({name}))"
            )
            before = after
    out.append(f"ratio as (select *, case when tokens > 0 then w / tokens else 0 end as f from {before})")
    out.append("factor as (select source, lang, topic, f / (select max(f) from ratio) as f from ratio)")
    draw = f"('0x' || substr(md5('{mixing.SEED}:' || doc_id::varchar), 1, 13))::bigint / {1 << 52}::double"
    return (
        "with " + ",\n".join(out) + f"\nselect doc_id, source, lang, topic, n_tokens, round(f, 6) as probability, {draw} < f as sampled "
        "from rows_ join factor using (source, lang, topic)"
    )


@query("op1_raking", _raked())
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.annotate(table(spark, sf_dir, "documents"))


@query("op2_co_training")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.annotate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query(
    "op3_product_quantisation",
    """
with recursive vectors as (
  select vec_id, embedding::double[] as e from embeddings
), links as (
  select a.vec_id as a, b.vec_id as b from vectors a join vectors b on a.vec_id <> b.vec_id
  where list_cosine_similarity(a.e, b.e) >= 0.9
), reach(vec_id, r) as (
  select vec_id, vec_id from vectors
  union
  select links.b, reach.r from reach join links on links.a = reach.vec_id
), named as (
  select vec_id, min(r) as component_id from reach group by vec_id
), counted as (
  select a as vec_id, count(*) as n from links group by a
)
select vec_id, coalesce(n, 0) as n_links, component_id, vec_id = component_id as kept
from named left join counted using (vec_id)
""",
)
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pq.near_duplicates(table(spark, sf_dir, "embeddings"))


@query("op4_sentencepiece")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.digests(pieces.encode(table(spark, sf_dir, "documents"), piece_model()))


@query("op5_secret_network")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.digests(secret_scan.scan(table(spark, sf_dir, "documents")))


@query(
    "op6_superminhash",
    r"""
with recursive words as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w
  from documents
), shingles as (
  select distinct doc_id, array_to_string(list_slice(w, i, i + 4), ' ') as s
  from (select doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) as i from words where len(w) > 0)
), sizes as (
  select doc_id, count(*) as n from shingles group by doc_id
), common as (
  select a.doc_id as a, b.doc_id as b, count(*) as c
  from shingles a join shingles b on a.s = b.s and a.doc_id < b.doc_id group by 1, 2
), links as (
  select a, b from common join sizes x on x.doc_id = a join sizes y on y.doc_id = b where 100 * c >= 75 * (x.n + y.n - c)
), either as (
  select a, b from links union all select b, a from links
), reach(doc_id, r) as (
  select doc_id, doc_id from documents
  union
  select either.b, reach.r from reach join either on either.a = reach.doc_id
), named as (
  select doc_id, min(r) as component_id from reach group by doc_id
)
select d.doc_id, coalesce(n, 0) as n_shingles, component_id, d.doc_id = component_id as kept
from documents d left join sizes using (doc_id) join named on named.doc_id = d.doc_id
""",
)
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return superminhash.near_duplicates(table(spark, sf_dir, "documents"))


@query(
    "op7_heavy_split",
    r"""
with digests as (
  select doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) as text_sha256 from documents
)
select doc_id, min(doc_id) over g as keep_id, count(*) over g as group_size, doc_id = min(doc_id) over g as kept, text_sha256
from digests window g as (partition by text_sha256)
""",
)
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.annotate(table(spark, sf_dir, "documents"))


@query(
    "op8_arc_to_warc",
    """
with payloads as (
  select page_id, strlen(coalesce(html, '')) as payload_bytes, sha256(coalesce(html, '')) as payload_digest from pages
), firsts as (
  select *, min(page_id) over (partition by payload_digest) as first from payloads
)
select page_id, payload_bytes, payload_digest,
  case when payload_bytes >= 100 and page_id <> first then 'revisit' else 'response' end as record_type,
  case when payload_bytes >= 100 and page_id <> first then first end as refers_to
from firsts
""",
)
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archived(table(spark, sf_dir, "pages"))


@query(
    "op9_chat_grammar",
    r"""
with turns as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -7, 0, 'user', '</s>[INST] ok [/INST]'
  union all select -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), written as (
  select *, length(regexp_replace(text, '([\[<])(\\*)(/?(?:(?:INST|ROLE|TEXT)\]|s>))', '\1\\\2\3', 'g')) as n_text,
    length(regexp_replace(role, '([\[<])(\\*)(/?(?:(?:INST|ROLE|TEXT)\]|s>))', '\1\\\2\3', 'g')) as n_role
  from turns
)
select conv_id, count(*) as n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn nulls first, role, text)) as turns_sha256,
  coalesce(sum(length(text)) filter (where role = 'assistant'), 0)::bigint as loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn nulls first, role, text) filter (where role = 'assistant'), '')) as loss_sha256,
  sum(n_text + case role when 'user' then 13 when 'assistant' then 7 else 26 + n_role end)::bigint as formatted_chars
from written group by conv_id
""",
)
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = chat.with_hostile(spark, table(spark, sf_dir, "conversations"))
    return chat.digests(chat.read_back(chat.format_conversations(rows)))


@query("op10_backoff_automaton")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.scores(table(spark, sf_dir, "documents"))


@query(
    "op11_reduced_alphabet",
    r"""
with recursive table_(b, v, k) as (
  select range, range, 0 from range(256)
  union all
  select b, case when v % 2 = 1 then xor(v // 2, 3988292384) else v // 2 end, k + 1 from table_ where k < 8
), crc as (
  select list(v order by b) as t from table_ where k = 8
), runs as (
  select doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-z\x{C0}-\x{FF}]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as run
  from documents
), counted as (
  select doc_id, run, count(*) as n from runs where length(run) >= 5 group by all
), bytes as (
  select *, coalesce(doc_id::varchar, '') || ':' || run as s, hex(encode(s)) as x from counted
), summed as (
  select run, n, xor(4294967295, list_reduce(
    list_prepend(4294967295::bigint, list_transform(range(len(x) // 2), lambda i: ('0x' || substr(x, 2 * i + 1, 2))::bigint)),
    lambda c, b: xor(c // 256, t[(xor(c, b) & 255) + 1]))) as h
  from bytes, crc
), damaged as (
  select case when h % 97 = 0 then substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) else run end as word, n from summed
), words as (
  select word, sum(n)::bigint as n from damaged where length(word) >= 5 group by word having sum(n) >= 3
), without as (
  select word, n, i, substr(word, 1, i) || substr(word, i + 2) as rest from (select word, n, unnest(range(length(word))) as i from words)
), pairs as (
  select a.word as a, b.word as b, b.n from without a join without b on a.rest = b.rest and a.i = b.i and a.word <> b.word
  union
  select a.word, b.word, b.n from without a join words b on a.rest = b.word
  union
  select b.word, a.word, a.n from without a join words b on a.rest = b.word
), best as (
  select a as word, count(*) as n_near, arg_min(b, (-n, b)) as b, max(n) as b_n from pairs group by a
), forms as (
  select word, n, coalesce(n_near, 0) as n_near, case when b_n >= 2 * n then b end as form, case when b_n >= 2 * n then b_n end as form_n
  from words left join best using (word)
), follow(word, root) as (
  select word, word from forms
  union all
  select follow.word, forms.form from follow join forms on forms.word = follow.root where forms.form is not null
)
select f.word, f.form, r.root, f.n, f.n_near, f.form_n
from forms f join (select follow.word, root from follow join forms on forms.word = root where form is null) r on r.word = f.word
""",
)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(table(spark, sf_dir, "documents"))


@query(
    "op12_nn_descent",
    """
with vectors as (
  select vec_id, embedding::double[] as e from embeddings where vec_id is not null and embedding is not null
), valid as (
  select * from vectors where len(list_filter(e, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(e, lambda x: x <> 0)) > 0
), measured as (
  select a.vec_id as query_id, b.vec_id, sqrt(list_reduce(list_transform(list_zip(a.e, b.e), lambda p: (p[1] - p[2]) * (p[1] - p[2])), lambda s, x: s + x)) as score
  from valid a join valid b on a.vec_id <> b.vec_id and len(a.e) = len(b.e) where a.vec_id % 100 = 0
), ranked as (
  select *, row_number() over (partition by query_id order by score, vec_id) as rank from measured
)
select query_id, rank::integer as rank, vec_id, score from ranked where rank <= 10
""",
)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nndescent.nearest(table(spark, sf_dir, "embeddings"))


_TERMS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+')"


@query(
    "op13_accumulator_limit",
    f"""
with terms as (
  select doc_id, {_TERMS} as t from documents
), held as (
  select row_number() over () as d, doc_id, t, len(t) as n from terms where len(t) > 0
), corpus as (
  select count(*) as docs, sum(n)::bigint as all_terms from held
), asked as (
  select distinct item_id, unnest({_TERMS}) as term from benchmark
), postings as (
  select d, doc_id, n, term, count(*) as tf from (select d, doc_id, n, unnest(t) as term from held)
  where term in (select term from asked) group by all
), weights as (
  select term, floor(1000 * ln((2 * any_value(docs) + 2) / (2 * count(*) + 1)))::bigint as w from postings, corpus group by term
), scored as (
  select item_id, d, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * docs) // all_terms))))::bigint as score
  from asked join postings using (term) join weights using (term), corpus group by all
), ranked as (
  select *, row_number() over (partition by item_id order by score desc, doc_id) as rank from scored where score > 0
)
select item_id, rank::integer as rank, doc_id, score from ranked where rank <= 10
""",
)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
