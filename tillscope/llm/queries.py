"""The corpus queries over the driver's tables, and their SQL where SQL can say it."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillscope.llm import (
    codes,
    ctw,
    hyperplanes,
    langid,
    lines,
    mixing,
    order_minhash,
    packing,
    periods,
    rollup,
    simhash,
    toxicity,
    urls,
)
from tillscope.llm.base import held_out, shared_folder, table, text_of, written

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def register(build):
        QUERIES[build.__name__] = build
        if sql:
            ORACLE[build.__name__] = sql
        return build
    return register


@query("""
with sized as (
  select doc_id, source,
         coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::bigint as size,
         ('0x' || substr(md5(coalesce(doc_id::varchar, '')), 1, 12))::bigint as hash
  from documents),
sources as (select source, sum(size)::bigint as source_size from sized group by source),
weighed as (
  select *, source_size * 3.0::double as cap,
         [5.0, 2.0, 1.0][1 + (row_number() over (order by source nulls last) - 1) % 3]::double
           as weight
  from sources),
levels as (
  select *, (sum(source_size) over ()::double - coalesce(sum(cap) over (
               order by cap / weight, source nulls last
               rows between unbounded preceding and 1 preceding), 0.0))
            / sum(weight) over (order by cap / weight, source nulls last
               rows between current row and unbounded following) as level
  from weighed),
leveled as (
  select *, max(case when level * weight <= cap then level end) over () as free from levels),
plan as (
  select source, source_size, case when free is null then cap
           else least(cap, free * weight) end as target from leveled),
rooms as (
  select *, case when source_size > 0 then floor(target / source_size) else 0 end::bigint
           as passes from plan),
cells as (
  select s.source, s.hash >> 24 as cell, sum(s.size) as words from sized s group by all),
running as (
  select c.*, sum(c.words) over (partition by c.source order by c.cell) as upto,
         r.target - r.passes * r.source_size as room
  from cells c join rooms r on c.source is not distinct from r.source),
cuts as (
  select source, arg_min(cell + case when upto - room < room - (upto - words)
                                     then 1 else 0 end, cell) as cut
  from running where upto > room group by source)
select d.doc_id, d.size, r.source_size, r.target,
       (d.size * (r.passes + case when (d.hash >> 24) < coalesce(c.cut,
          case when r.target - r.passes * r.source_size > 0 then 16777216 else 0 end)
          then 1 else 0 end))::bigint as taken
from sized d join rooms r on d.source is not distinct from r.source
left join cuts c on c.source is not distinct from r.source
""")
def op3_source_mix(spark, sf_dir):
    """Words taken of each document by the mix of sources."""
    return mixing.mixed(table(spark, sf_dir, "documents")).select(
        "doc_id", "size", "source_size", "target",
        (F.col("size") * F.col("times")).alias("taken"))


@query()
def op4_simhash_groups(spark, sf_dir):
    """Fingerprint and near-duplicate component of each document."""
    return simhash.near_duplicates(table(spark, sf_dir, "documents")).select(
        "doc_id", F.lower(F.hex("fp")).alias("fingerprint"), "component_id")


@query()
def op5_embedding_groups(spark, sf_dir):
    """Links and near-duplicate component of each embedding."""
    return hyperplanes.linked_vectors(table(spark, sf_dir, "embeddings"))


@query()
def op10_order_minhash(spark, sf_dir):
    """Order-sensitive fingerprints, and their reaction to an edit of half the text."""
    return order_minhash.compared_with_next(table(spark, sf_dir, "documents"))


RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"),
         ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")]
BLOCKED_GLOBS = ["**casino**", "**/ads/**", "*.xxx/**", "**/login*", "**poker**", "**.zip"]

URL_PARTS = r"""
  select *, coalesce(translate(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'),
           'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') as host,
         coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') as path
  from pages
"""


# decoded: pieces behind each %; resolved: segments, of which '.' and '..' go; all as in urls.canonical
CANONICAL = r"""
decoded as (
  select page_id, host, path, regexp_replace(regexp_replace(regexp_replace(host, '^.*@', '', 's'),
           '(:[0-9]*)?$', ''), '\.+$', '') as bare,
         regexp_replace(array_to_string(list_transform(string_split(path, '%'), lambda x, i:
           case when i = 1 then x
                when regexp_matches(x, '^([2-6][0-9A-Fa-f]|7[0-9A-Ea-e])')
                  then chr(('0x' || substr(x, 1, 2))::int) || substr(x, 3)
                else '%' || x end), ''), '/+', '/', 'g') as plain
  from parts),
canonical as (
  select page_id, host, path, bare || case when not contains(plain, '/.') then plain else
           array_to_string(list_reduce(list_transform(string_split(plain, '/'), lambda x: [x]),
             lambda a, x: case when x[1] = '..' then case when len(a) > 1 then a[:len(a) - 1] else a end
                               when x[1] = '.' then a else a || x end), '/')
           || case when regexp_matches(plain, '/\.\.?$') then '/' else '' end end as form
  from decoded)"""


@query(f"""
with parts as ({URL_PARTS}), {CANONICAL},
rules(verdict, rule_host, rule_path) as (values {", ".join(map(repr, RULES))}),
globs(pattern) as (values ('casino'), ('/ads/'), ('^[^/]*\\.xxx/'), ('/login[^/]*$'), ('poker'),
                          ('\\.zip$')),
fitting as (
  select p.page_id, p.host, p.path, form, r.rule_host || r.rule_path as rule, r.verdict
  from canonical p left join rules r
    on (p.host = r.rule_host or ends_with(p.host, '.' || r.rule_host))
   and starts_with(p.path, r.rule_path)
  qualify row_number() over (partition by p.page_id
                             order by length(rule) desc nulls last) = 1)
select page_id, host, path, rule, coalesce(verdict, case when exists (
         select 1 from globs g where regexp_matches(form, g.pattern))
       then 'block' else 'allow' end) as verdict
from fitting
""")
def op7_url_filter(spark, sf_dir):
    """Rule and verdict of each page's URL."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return urls.judged(pages, RULES, BLOCKED_GLOBS).select(
        "page_id", "host", "path", "rule", "verdict")


@query(f"""
with parts as ({URL_PARTS}),
split as (
  select page_id, host, list_filter(list_transform(regexp_split_to_array(regexp_replace(
           coalesce(html, ''), '<script[^>]*>.*?</script>|<style[^>]*>.*?</style>|<!--.*?-->',
           '<>', 'gs'), '<[^>]*>'), lambda x: trim(x)), lambda x: x != '') as lines
  from parts),
totals as (select host, count(*) as pages from split group by host),
counts as (
  select host, line, count(*) as holding
  from (select host, unnest(list_distinct(lines)) as line from split) group by all),
bad as (
  select host, list(line) as bad from counts join totals using (host)
  where holding >= {lines.LEAST_PAGES} and holding > {lines.RATIO}::double * pages
  group by host),
cleaned as (
  select s.*, list_filter(s.lines, lambda x: not list_contains(coalesce(b.bad, []), x)) as kept
  from split s left join bad b using (host))
select page_id, host, len(lines)::int as lines, (len(lines) - len(kept))::int as dropped,
       array_to_string(kept, chr(10)) as text
from cleaned
""")
def op1_line_dedup(spark, sf_dir):
    """Page texts without the lines that many pages of their host hold."""
    pages = table(spark, sf_dir, "pages").select(
        "page_id", urls.host_of(F.col("url")).alias("host"), "html")
    out = lines.dropped(pages, lines.lines_of_html(F.col("html")), "host")
    return out.select("page_id", "host", (F.size("kept") + F.col("dropped")).alias("lines"),
                      "dropped", F.array_join("kept", "\n").alias("text"))


@query()
def op2_retrieval_packing(spark, sf_dir):
    """Pieces of 1024-token windows that neighbours fill."""
    out = packing.packed(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"),
                      "doc_tokens", "sequence_id", "offset")


@query()
def op6_token_rollup(spark, sf_dir):
    """Documents and tokens by source, language and tokenizer version after four batches.

    All documents are inserted with an estimate of four bytes a token (version 0), revised to
    exact counts (version 1), and exact copies of an earlier document deleted and then inserted
    again, so that the totals are those of all documents. One batch is delivered twice.
    """
    docs = table(spark, sf_dir, "documents").select(
        "doc_id", "source", "lang", F.sha2(text_of(), 256).alias("content"),
        F.ceil(F.octet_length(text_of()) / 4).alias("guess"), "text")
    known = written(rollup.counted(docs))
    firsts = known.groupBy("content").agg(F.min("doc_id").alias("first"))

    def state(version, tokens):
        return F.struct("source", "lang", F.lit(f"byte_bpe_50k/{version}").alias("tokenizer"),
                        F.col(tokens).alias("tokens"))
    none = F.lit(None)
    loaded = known.select(none.alias("before"), state(0, "guess").alias("after"))
    exact = known.select(state(0, "guess").alias("before"), state(1, "tokens").alias("after"))
    copies = known.join(firsts, "content").filter("doc_id != first").select(
        state(1, "tokens").alias("before"), none.alias("after"))
    totals = rollup.Rollup(spark, f"{shared_folder(spark)}/rollup-{uuid.uuid4().hex}")
    totals.commit("load", rollup.signed(loaded))
    totals.commit("count", rollup.signed(exact))
    totals.commit("count", rollup.signed(exact))
    totals.commit("copies", rollup.signed(copies))
    totals.commit("copies again", rollup.signed(copies.select(
        F.col("after").cast(copies.schema["before"].dataType).alias("before"),
        F.col("before").alias("after"))))
    return totals.totals()


@query()
def op8_toxicity(spark, sf_dir):
    """Toxicity of each document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.scored(docs, model).select(
        "doc_id", held_out().alias("held_out"), "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"))


@query()
def op9_language(spark, sf_dir):
    """Language of each document."""
    docs = table(spark, sf_dir, "documents")
    network = langid.fit(docs)
    return langid.identified(docs.select("doc_id", "text"), network).select(
        "doc_id", held_out().alias("held_out"), "lang_pred", "score")


@query()
def op11_context_tree_scores(spark, sf_dir):
    """Log-probability of each text by context-tree weighting, beside that by add-one counts."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    rest = F.crc32(F.col("doc_id").cast("string")) % 7
    return ctw.scored(docs, rest != 2).select(
        "doc_id", F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 7 == 2, F.lit(True))
        .alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score",
        "bits_per_byte")


@query()
def op12_periodic_runs(spark, sf_dir):
    """Periodic runs of each document, one in ten of which gets a loop first."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return periods.digest(periods.found(docs, number=F.crc32(F.col("doc_id").cast("string"))))


def _lloyd_sql() -> str:
    """The quantizer with every distance computed."""
    kept = """
cells as (
  select vec_id, label, (nth - 1) // (len(embedding) // 4) as part,
         (nth - 1) % (len(embedding) // 4) as place, floor(1024 * x::double)::bigint as x
  from (select vec_id, label, embedding, unnest(embedding) as x,
               generate_subscripts(embedding, 1) as nth
        from embeddings where embedding is not null and len(list_filter(
             embedding, lambda x: x is null or not isfinite(x))) = 0)),
parts as (
  select vec_id, label, part, list(x order by place) as v from cells group by all),
book0 as (
  select part, row_number() over (partition by part order by vec_id) - 1 as entry, v as e
  from parts qualify entry < 256)"""

    def nearest(n):
        return f"""
near{n} as (
  select vec_id, label, part, v, arg_min(entry, d * 256 + entry) as entry, min(d) as d
  from (select p.*, b.entry, list_sum(list_transform(list_zip(p.v, b.e),
               lambda x: (x[1] - x[2]) * (x[1] - x[2])))::bigint as d
        from parts p join book{n} b using (part))
  group by vec_id, label, part, v)"""

    def moved(n):
        return f"""
book{n + 1} as (
  select b.part, b.entry, coalesce(m.e, b.e) as e
  from book{n} b left join (
    select part, entry, list(x order by place) as e
    from (select part, entry, place, floor(sum(x)::hugeint / count(*))::bigint as x
          from (select part, entry, unnest(v) as x, generate_subscripts(v, 1) as place
                from near{n})
          group by part, entry, place)
    group by part, entry) m using (part, entry))"""
    steps = [kept] + [f(n) for n in range(4) for f in (nearest, moved)] + [nearest(4)]
    return "with " + ",".join(f"{s}" for s in steps) + """,
codes as (
  select vec_id, label, string_agg(printf('%02x', entry), '' order by part) as code,
         sum(d)::bigint as error
  from near4 group by vec_id, label),
printed as (
  select sha256(string_agg(array_to_string(e, ','), ',' order by part, entry)) as sha from book4)
select vec_id, code, error, sum(error) over (partition by label)::bigint as label_error,
       sha as codebooks_sha256
from codes, printed
"""


@query(_lloyd_sql())
def op13_cover_tree_codes(spark, sf_dir):
    """Product codes of the embeddings, their errors, and a checksum of the codebooks."""
    return codes.coded(table(spark, sf_dir, "embeddings"))
