"""The queries of the operators, each over its whole table, and the SQL they must agree with where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import work_path
from . import language_id, quality
from .bpe import encode_texts
from .embedding_dedup import near_duplicate_vectors
from .filter_audit import audit_filters
from .html_text import extract_text
from .metric_search import SCALE, top_k
from .minhash import near_duplicates
from .mixing import mix_sources
from .packing import pack
from .phrases import collocations
from .secrets import RULES as RULES_OF_SECRETS
from .secrets import all_spans, joined_spans, scan_versions
from .url_filters import RULES, filter_urls, rule_table

TOKENIZER = "word_bpe_49k.json"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Components by reachability over ``link`` (a, b in both directions); nodes are in ``node``.
REACH = """
reach as (select id as a, id as b from node union select r.a, l.b from reach r join link l on r.b = l.a),
least as (select a as id, min(b) as component from reach group by a)"""

OP4_SQL = f"""
with recursive w as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\\x20\\x09-\\x0D]+') as words from documents),
s as (
  select doc_id, list_distinct(case when len(words) >= 3 then [array_to_string(words[i : i + 2], ' ') for i in range(1, len(words) - 1)]
    when len(words) > 0 then [array_to_string(words, ' ')] else [] end) as shingles from w),
node as (select doc_id as id, len(shingles)::bigint as n from s),
flat as (select doc_id as id, unnest(shingles) as g from s),
link as (
  select a, b from (select x.id as a, y.id as b, count(*) as n from flat x join flat y on x.g = y.g and x.id <> y.id group by all) p
  join node na on na.id = a join node nb on nb.id = b
  where 100 * p.n >= 85 * (na.n + nb.n - p.n)),
{REACH}
select id as doc_id, n as n_shingles, component as component_id, id = component as kept from node join least using (id)
"""


@query("op4_minhash_near_dedup", OP4_SQL)
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), size=3, percent=85)


OP9_SQL = (
    "with r(action, rh, rp) as (values "
    + ", ".join(f"('{a}', '{h}', '{p}')" for a, h, p in RULES)
    + r"""),
u as (
  select page_id,
    translate(coalesce(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
    coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') as path
  from pages),
d as (select distinct host, path from u),
m as (
  select host, path, first(rh || rp order by length(rh || rp) desc, length(rh) desc, action desc) as rule,
    first(action order by length(rh || rp) desc, length(rh) desc, action desc) as verdict
  from d join r on (host = rh or suffix(host, '.' || rh)) and prefix(path, rp)
  group by host, path)
select page_id, host, path, rule, coalesce(verdict, 'allow') as verdict from u left join m using (host, path)
"""
)


@query("op9_url_filters", OP9_SQL)
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = filter_urls(table(spark, sf_dir, "pages"), rule_table(spark, RULES))
    return judged.select("page_id", "host", "path", "rule", "verdict")


OP10_SQL = f"""
with recursive node as (select vec_id as id, label, embedding::double[] as v from embeddings),
link as (
  select x.id as a, y.id as b from node x join node y on x.label = y.label and x.id <> y.id
  where list_dot_product(x.v, y.v) / sqrt(list_dot_product(x.v, x.v) * list_dot_product(y.v, y.v)) >= 0.98),
{REACH}
select id as vec_id, (select count(*) from link where a = node.id) as n_links, component as component_id, id = component as kept
from node join least using (id)
"""


@query("op10_embedding_near_dedup", OP10_SQL)
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicate_vectors(table(spark, sf_dir, "embeddings"), least=0.98)


OP3_SQL = f"""
with x as (select vec_id, list_transform(embedding, lambda c: floor({SCALE} * c::double)) as v from embeddings),
r as (
  select q.vec_id as query_id, c.vec_id, list_dot_product(q.v, c.v)::bigint as score,
    row_number() over (partition by q.vec_id order by list_dot_product(q.v, c.v) desc, c.vec_id)::int as rank
  from x q join x c on q.vec_id <> c.vec_id where q.vec_id % 20 = 0)
select query_id, rank, vec_id, score from r where rank <= 20
"""


@query("op3_metric_top_k", OP3_SQL)
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").where(
        F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    )
    vectors = vectors.select("vec_id", F.transform("embedding", lambda x: F.floor(x.cast("double") * SCALE)).alias("x"))
    return top_k(vectors, vectors.where("vec_id % 20 = 0"), 20)


def _op1_kind(rule, place: int) -> str:
    """Matches of a rule with their places: a separator is put round each, and the parts' lengths are summed."""
    pattern = rule.pattern.replace("(?ia:", "(?i:").replace("'", "''")
    # In the parts, group 1 is the whole match's group 1: groups shift by one where the match is wrapped.
    found = f"regexp_extract(part, '{pattern}', {rule.group})"
    return f"""
  select doc_id, '{rule.kind}' as kind, {place} as place, before as s, before + length(part) as e from (
    select doc_id, i, part, coalesce(sum(length(part)) over (partition by doc_id order by i rows between unbounded preceding and 1 preceding), 0)::bigint as before
    from (select doc_id, unnest(parts) as part, generate_subscripts(parts, 1) as i from (
      select doc_id, string_split(regexp_replace(t, '({pattern})', chr(57345) || '\\1' || chr(57345), 'g'), chr(57345)) as parts from d)))
  where i % 2 = 0 and length({found}) >= {rule.least}"""


OP1_SQL = (
    "with d as (select doc_id, coalesce(text, '') as t from documents), f as ("
    + " union all ".join(_op1_kind(rule, i) for i, rule in enumerate(RULES_OF_SECRETS))
    + """),
g as (
  select doc_id, count(*) filter (kind = 'assign') as a, count(*) filter (kind = 'access') as b, count(*) filter (kind = 'hex') as c,
    string_agg(kind || ':' || s || ':' || e, ',' order by s, place) as spans from f group by doc_id)
select doc_id, coalesce(a, 0) as n_assign, coalesce(b, 0) as n_access, coalesce(c, 0) as n_hex,
  sha256(coalesce(spans, '')) as base_sha256, coalesce(spans, '') as spans
from d left join g using (doc_id)
"""
)


@query("op1_secret_scans", OP1_SQL)
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    versions = table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("content"))
    found = scan_versions(versions, work_path(spark, "ledger")).withColumn("all", all_spans())
    found = found.withColumn("spans", joined_spans())
    kinds = F.transform("all", lambda s: s["kind"])
    counts = [(F.size(kinds) - F.size(F.array_remove(kinds, k))).cast("long").alias(f"n_{k}") for k in ("assign", "access", "hex")]
    return found.select("doc_id", *counts, F.sha2(F.col("spans").cast("binary"), 256).alias("base_sha256"), "spans")


def remainder(column: str, by: int):
    """crc32 of the column as text, modulo ``by``."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % by


@query("op5_quality_classifier")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.coalesce(remainder("doc_id", 3) == 1, F.lit(False))
    documents = table(spark, sf_dir, "documents")
    labels = table(spark, sf_dir, "labels").where(~held_out).select("doc_id", F.col("quality").alias("label"))
    scored = quality.score_quality(documents, quality.train(documents, labels), ["doc_id"])
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


@query("op7_language_id")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.coalesce(remainder("doc_id", 5) == 0, F.lit(False))
    documents = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = language_id.train(documents.where(~held_out))
    found = language_id.identify(documents, model, ["doc_id"])
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


@query("op6_html_extraction")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(table(spark, sf_dir, "pages"), ["page_id", "url"])


@query("op8_bpe_encoding")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = encode_texts(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER), ["doc_id"])
    return coded.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


@query("op2_best_fit_packing")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER), ["doc_id"]).drop("ids")


OP11_SQL = """
with d as (
  select doc_id, coalesce(lang, '') as part, coalesce(text, '') as t, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') as w
  from documents),
l as (select doc_id, coalesce(bool_or(quality = 1), false) as good, coalesce(bool_or(toxic = 1), false) as toxic from labels group by doc_id),
f as (
  select part, coalesce(good, false) as good, coalesce(toxic, false) as toxic,
    (len(w) < 200)::int + 2 * (100 * len(list_distinct(w)) < 50 * len(w))::int
    + 4 * (100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 3 * length(t))::int + 8 * regexp_matches(t, '[#$%&*|]')::int
    + 16 * coalesce(d.doc_id > min(d.doc_id) over (partition by t), false)::int as mask
  from d left join l using (doc_id)),
c as (
  select part, mask, count(*) as n, count(*) filter (good) as good, count(*) filter (toxic) as toxic from f group by all),
b(x, bit) as (values ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)),
p as (
  select a.x || b.x || c.x || d.x || e.x as filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] as bits
  from b a join b on a.x <> b.x join b c on c.x not in (a.x, b.x) join b d on d.x not in (a.x, b.x, c.x)
    join b e on e.x not in (a.x, b.x, c.x, d.x)),
s as (
  select filter_order, i::int as step, bits[i] as bit, coalesce(list_sum(bits[1 : i - 1]), 0)::int as earlier
  from p, (select unnest([1, 2, 3, 4, 5]) as i)),
r as (
  select part, filter_order, step, bit,
    coalesce(sum(n) filter (mask & (bit | earlier) = 0), 0)::bigint as kept,
    coalesce(sum(n) filter (mask & bit <> 0 and mask & earlier = 0), 0)::bigint as removed,
    coalesce(sum(n) filter (mask & bit <> 0 and mask & earlier <> 0), 0)::bigint as redundant,
    coalesce(sum(n) filter (mask = bit), 0)::bigint as unique_fails,
    coalesce(sum(good) filter (mask & bit <> 0 and mask & earlier = 0), 0)::bigint as good_lost,
    coalesce(sum(toxic) filter (mask & bit <> 0 and mask & earlier = 0), 0)::bigint as toxic_lost
  from c, s group by all)
select * exclude (bit), sum(removed) over (partition by part, bit)::bigint as shapley from r
"""


@query("op11_filter_audit", OP11_SQL)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit_filters(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op12_source_mixing")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents"), ["doc_id"])


OP13_SQL = """
with d as (
  select row_number() over () as i, coalesce(lang, 'und') as lang,
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as t from documents),
p as (
  select lang, regexp_extract_all(piece, '[^\\x20\\x09]+') as w
  from (select lang, unnest(regexp_split_to_array(t, '[.,;:!?\\x0A-\\x0D]')) as piece from d)),
c as (select lang, sum(len(w))::bigint as n from p group by lang),
g as (
  select lang, k, array_to_string(w[j : j + k - 1], ' ') as phrase
  from (select lang, w, k, unnest(range(1, len(w) - k + 2)) as j from p, (select unnest([1, 2, 3, 4]) as k))),
f as (select lang, k, phrase, count(*)::bigint as a from g group by all having count(*) >= 30),
x as (select lang, k as words, phrase, string_split(phrase, ' ') as s, a from f where k > 1),
s as (
  select x.lang, x.phrase, x.words, x.a, cut, h.a as l, t.a as r, (2000000::hugeint * x.a // (h.a::hugeint + t.a))::bigint as score
  from (select *, unnest(range(1, words)) as cut from x) x
  join f h on h.lang = x.lang and h.phrase = array_to_string(s[1 : cut], ' ')
  join f t on t.lang = x.lang and t.phrase = array_to_string(s[cut + 1 :], ' ')),
b as (select *, row_number() over (partition by lang, phrase order by score, cut) as o from s),
i as (
  select lang, array_to_string(s[j : j + m - 1], ' ') as phrase, max(a) as around
  from (select *, unnest(range(1, words - m + 2)) as j from (select *, unnest(range(2, words)) as m from x)) group by all),
r as (
  select b.lang, b.phrase, b.a, l, r, score, row_number() over (partition by b.lang order by score desc, b.a desc, b.phrase)::bigint as rank
  from b left join i on i.lang = b.lang and i.phrase = b.phrase
  where o = 1 and (around is null or 100 * around < 80 * b.a))
select lang, rank, phrase, a, l, r, n, score from r join c using (lang) where rank <= 2000
"""


@query("op13_phrase_collocations", OP13_SQL)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))
