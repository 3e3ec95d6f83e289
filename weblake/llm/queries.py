"""The registered queries of the training-data operators and their oracle SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from weblake.llm import alignment, ann, html_blocks, manifest, mixing, packing, pii, secrets, simhash, tokens, topk, toxicity, url_filter
from weblake.llm.common import read_table

QUERIES = {}
ORACLES = {}


def query(name: str, oracle: str | None = None):
    """Register a function (spark, sf_dir) → DataFrame with its oracle SQL."""
    def register(run):
        QUERIES[name] = run
        if oracle is not None:
            ORACLES[name] = oracle.strip()
        return run
    return register


@query("op1_simhash_near_dedup")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate component of every document, at 4 or fewer differing fingerprint bits."""
    found = simhash.near_duplicates(read_table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


URL_RULES = (
    url_filter.Rule("org", "/", "allow"),
    url_filter.Rule("example.org", "/es/", "block"),
    url_filter.Rule("example.org", "/en/1", "block"),
    url_filter.Rule("com", "/fr/", "allow"),
    url_filter.Rule("com", "/de/", "block"),
)

URL_ORACLE = """
with cut as (
  select page_id, case when strpos(url, '://') > 0 then substr(url, strpos(url, '://') + 3) else '' end as rest from pages),
parts as (
  select page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path from cut),
rules(h, p, v) as (values ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'),
  ('com', '/fr/', 'allow'), ('com', '/de/', 'block'))
select page_id, host, path, arg_max(h || p, length(h || p)) as rule, coalesce(arg_max(v, length(h || p)), 'allow') as verdict
from parts left join rules on (host = h or ends_with(host, '.' || h)) and starts_with(path, p)
group by page_id, host, path
"""


@query("op2_url_filter", URL_ORACLE)
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict of every page's URL by the longest rule that fits; allow where none does."""
    pages = read_table(spark, sf_dir, "pages").select("page_id", "url")
    return url_filter.filter_urls(pages, URL_RULES).select("page_id", "host", "path", "rule", "verdict")


@query("op3_toxicity")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of every document."""
    docs, labels = read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels")
    return toxicity.toxicity(docs.select("doc_id", "text"), labels).select("doc_id", "held_out", "score", "predicted")


@query("op7_secret_scan")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every document."""
    return secrets.digest(secrets.scan(read_table(spark, sf_dir, "documents").select("doc_id", "text")))


@query("op4_pii")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every document."""
    return pii.digest(pii.find(read_table(spark, sf_dir, "documents").select("doc_id", "text")))


@query("op8_token_counts")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return tokens.count_tokens(docs).select("doc_id", "n_bytes", "n_tokens", "over_limit")


@query("op9_packing")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of at most 2048 tokens."""
    return packing.pack(read_table(spark, sf_dir, "documents"))


@query("op10_source_mixing")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mix takes of every document."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mixing.mix(docs).select("doc_id", "size", "source_size", "target", "taken")


TOP_K_ORACLE = """
with v as (select vec_id, list_transform(embedding, lambda x: floor(256 * x::double)::bigint) as e from embeddings),
scored as (
  select q.vec_id as query_id, c.vec_id, list_inner_product(q.e::double[], c.e::double[])::bigint as score
  from v q join v c on q.vec_id % 50 = 0 and q.vec_id <> c.vec_id)
select query_id, (row_number() over (partition by query_id order by score desc, vec_id))::int as rank, vec_id, score
from scored qualify rank <= 5
"""


@query("op5_exact_top_k", TOP_K_ORACLE)
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 largest integer inner products of every 50th vector."""
    return topk.exact_top_k(read_table(spark, sf_dir, "embeddings"))


@query("op6_one_bit_neighbours")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """About the 20 nearest of every 20th vector."""
    return ann.approximate_top_k(read_table(spark, sf_dir, "embeddings"))


@query("op13_cross_tokenizer_alignment")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alignment of two tokenizers on every document, scored by corpus-wide link counts."""
    return alignment.digest(read_table(spark, sf_dir, "documents"))


MANIFEST_ORACLE = """
with recursive fields as (
  select doc_id, coalesce('=' || lang, '') as tree, n_chars,
    coalesce(strlen(doc_id::varchar) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-')
      || coalesce(strlen(lang) || ':' || lang, '-') as head,
    coalesce(strlen(text) || ':' || text, '-') as tail,
    coalesce(xor(list_reduce(list_prepend(4294967295::bigint, list_transform(string_split(doc_id::varchar, ''), lambda c: ascii(c)::bigint)),
      lambda crc, b: list_reduce(list_prepend(xor(crc, b), range(8)), lambda x, i: xor(x >> 1, 3988292384 * (x & 1)))),
      4294967295) % 7 = 0, false) as tampered from documents),
leaves as (
  select *, row_number() over () as row, row_number() over (partition by tree order by doc_id nulls first, leaf) - 1 as pos,
    count(*) over (partition by tree) as n
  from (select doc_id, tree, sha256(head || coalesce(strlen(n_chars::varchar) || ':' || n_chars, '-') || tail) as leaf,
      case when tampered then sha256(head || coalesce(strlen((n_chars + 1)::varchar) || ':' || (n_chars + 1), '-') || tail) end as other
    from fields)),
low as (
  select 0 as level, tree, pos, n, leaf as h from leaves
  union all
  select level + 1, tree, pos // 2, (n + 1) // 2, sha256(string_agg(h, '' order by pos)) from low where n > 1 group by level, tree, pos // 2, n),
subroots as (
  select tree, h as subroot, row_number() over (order by tree) - 1 as pos, count(*) over () as n from low where n = 1),
high as (
  select 0 as level, pos, n, subroot as h from subroots
  union all
  select level + 1, pos // 2, (n + 1) // 2, sha256(string_agg(h, '' order by pos)) from high where n > 1 group by level, pos // 2, n),
steps as (
  select l.row, s.level, (l.pos >> s.level) & 1 as slot, b.h as sibling
  from leaves l join (select distinct tree, level from low where n > 1) s on s.tree = l.tree
  left join low b on b.tree = l.tree and b.level = s.level and b.pos = xor(l.pos >> s.level, 1::bigint)
  union all
  select l.row, 1000 + s.level, (r.pos >> s.level) & 1, b.h
  from leaves l join subroots r on r.tree = l.tree cross join (select distinct level from high where n > 1) s
  left join high b on b.level = s.level and b.pos = xor(r.pos >> s.level, 1::bigint)),
ranked as (select *, row_number() over (partition by row order by level) as step from steps),
folded as (
  select row, 0 as step, coalesce(other, leaf) as h from leaves
  union all
  select f.row, r.step, sha256(case when r.slot = 1 then r.sibling || f.h else f.h || coalesce(r.sibling, '') end)
  from folded f join ranked r on r.row = f.row and r.step = f.step + 1),
proofs as (
  select l.row, sha256(coalesce(string_agg(s.sibling, '' order by s.level), '')) as proof_sha256
  from leaves l left join steps s on s.row = l.row group by l.row)
select l.doc_id, l.leaf, s.subroot, r.h as root, p.proof_sha256, f.h as folded_root, f.h = r.h as verified
from leaves l join subroots s on s.tree = l.tree join proofs p on p.row = l.row
join (select row, arg_max(h, step) as h from folded group by row) f on f.row = l.row
cross join (select h from high where n = 1) r
"""


@query("op11_merkle_manifest", MANIFEST_ORACLE)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaf, proof and check of every document in the manifest of all of them."""
    return manifest.digest(read_table(spark, sf_dir, "documents"))


@query("op12_html_extraction")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    found = html_blocks.extract(read_table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return found.select("page_id", "url", "text", F.char_length("text").cast("bigint").alias("n_chars"))
