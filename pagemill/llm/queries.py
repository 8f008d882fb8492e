"""The operators applied to whole tables, each with its result in SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill.llm import (decontam, gramjoin, mixing, negatives, quality, quotes, secrets, simhash, suffixes, tokens, toxicity,
                          variants, warc)
from pagemill.llm.store import PLAIN_READ, shared_dir

Job = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Job] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Job], Job]:
    def register(job: Job) -> Job:
        QUERIES[name] = job
        if sql is not None:
            ORACLES[name] = sql
        return job

    return register


def tokenizer_path() -> str:
    import public_tokenizers
    return public_tokenizers.path("word_bpe_49k.json")


def table(spark: SparkSession, sf_dir: str, name: str, **options: str) -> DataFrame:
    return spark.read.options(**options).parquet(f"{sf_dir}/{name}.parquet")


_AZ = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
_WS_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

# -- 1 --------------------------------------------------------------------------------------------

_WORDS = rf"regexp_extract_all(translate(coalesce(text, ''), {_AZ}), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"


@query("op1_benchmark_decontamination", f"""
with d as (select doc_id, {_WORDS} as ws from documents),
i as (select coalesce(cast(item_id as varchar), 'null') as item, {_WORDS} as ws from benchmark),
sized as (select item, ws, least(10, len(ws)) as k from i where len(ws) > 0),
windows as (select distinct item, k, array_to_string(ws[p + 1:p + k], ' ') as g
            from (select item, ws, k, unnest(range(len(ws) - k + 1)) as p from sized)),
grams as (select doc_id, k, p, array_to_string(ws[p + 1:p + k], ' ') as g
          from (select doc_id, ws, k, unnest(range(len(ws) - k + 1)) as p
                from d, (select distinct k from windows) where len(ws) >= k)),
found as (select doc_id, p, k, item from grams join windows using (k, g)),
hits as (select doc_id, count(distinct w) as n from (select doc_id, p + unnest(range(k)) as w from found) group by doc_id),
items as (select doc_id, count(*) as n, string_agg(item, ',' order by item) as list
          from (select distinct doc_id, item from found) group by doc_id)
select d.doc_id, cast(len(d.ws) as bigint) as n_words, cast(coalesce(hits.n, 0) as bigint) as n_hit,
       cast(coalesce(items.n, 0) as bigint) as n_items, sha256(coalesce(items.list, '')) as items_sha256,
       coalesce(hits.n, 0) > 0 as contaminated
from d left join hits using (doc_id) left join items using (doc_id)""")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of benchmark windows in every document."""
    found = decontam.decontaminate(table(spark, sf_dir, "documents", **PLAIN_READ), table(spark, sf_dir, "benchmark"))
    return found.select(F.col("id").alias("doc_id"), "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


# -- 3 --------------------------------------------------------------------------------------------

@query("op3_quality_rules", rf"""
with d as (select doc_id, coalesce(text, '') as text, {_WS_WORDS} as ws from documents),
grams as (select doc_id, p, array_to_string(ws[p + 1:p + 8], ' ') as g
          from (select doc_id, ws, unnest(range(len(ws) - 7)) as p from d where len(ws) >= 8)),
again as (select doc_id, p from (select doc_id, p, count(*) over (partition by doc_id, g) as n from grams) where n > 1),
rep as (select doc_id, sum(least(8, coalesce(nxt - p, 8))) as n
        from (select doc_id, p, lead(p) over (partition by doc_id order by p) as nxt from again) group by doc_id),
lines as (select doc_id, count(*) - count(distinct line) as n
          from (select doc_id, unnest(string_split(text, chr(10))) as line from d)
          where regexp_matches(line, '[^\x20\x09-\x0D]') group by doc_id),
m as (select doc_id, cast(len(ws) as bigint) as n_words, cast(length(array_to_string(ws, '')) as bigint) as word_chars,
             cast(len(regexp_extract_all(text, '[#*$%&|<>]')) as bigint) as n_symbols,
             cast(coalesce(lines.n, 0) as bigint) as n_dup_lines, cast(coalesce(rep.n, 0) as bigint) as n_repeat_words,
             len(string_split(text, chr(10))) as n_lines,
             len(regexp_extract_all(text, '[^\x20\x09-\x0D]!![\x20\x09-\x0D]')) as n_shouts
      from d left join lines using (doc_id) left join rep using (doc_id)),
b as (select *, n_words < 20 or 100 * n_repeat_words > 30 * n_words as base_failed from m)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       not (base_failed or 5 * n_symbols > n_words or 2 * n_shouts > n_words or 2 * n_dup_lines > n_lines
            or word_chars > 60 * n_words) as kept
from b""")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signals of every document and the verdict of the cascade; what the result doesn't show is made by the rules that need it."""
    shown = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    docs = quality.with_signals(table(spark, sf_dir, "documents"), names=shown)
    s = F.col("signals")
    failed = (s["n_words"] < quality.MIN_WORDS) | (100 * s["n_repeat_words"] > quality.MAX_REPEAT_PERCENT * s["n_words"])
    return quality.cascade(docs, signals="signals").select(
        "doc_id", "signals.n_words", "signals.word_chars", "signals.n_symbols", "signals.n_dup_lines",
        "signals.n_repeat_words", failed.alias("base_failed"), F.col("rejected_by").isNull().alias("kept"))


# -- 5 --------------------------------------------------------------------------------------------

@query("op5_token_output")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as token ids in shards, read back by key."""
    found = tokens.round_trip(table(spark, sf_dir, "documents"), shared_dir(spark, "tokens"), tokenizer_path())
    return found.select(F.col("id").alias("doc_id"), "start", "n_tokens", F.col("crc32").alias("ids_crc32"))


# -- 7 --------------------------------------------------------------------------------------------

@query("op7_source_mixing", rf"""
with d as (select doc_id, text, source, cast(len({_WS_WORDS}) as bigint) as size from documents),
w as (select *, greatest(0.1::double, 1.0::double - 4.0::double * len(regexp_extract_all(text, '[#*$%&|<>]')) / greatest(size, 1)) as w0
      from d),
k as (select doc_id, source, size, -ln((cast('0x' || substr(md5('0:' || coalesce(cast(doc_id as varchar), 'null')), 1, 13)
             as bigint) + 0.5::double) / 4503599627370496::double) / coalesce(w0, 0.1::double) as key from w),
s as (select source, cast(sum(size) as bigint) as n from d group by source),
ranked as (select *, [5, 2, 1][((row_number() over (order by source nulls last) - 1) % 3) + 1] as weight from s),
before as (select *, coalesce(sum(4 * n) over (order by n / weight, source nulls last rows between unbounded preceding and 1 preceding), 0) as gone,
                  coalesce(sum(weight) over (order by n / weight, source nulls last rows between unbounded preceding and 1 preceding), 0) as wgone,
                  3 * sum(n) over () as alln, sum(weight) over () as allw,
                  row_number() over (order by n / weight, source nulls last) as rn from ranked),
stops as (select *, n * 4 * (allw - wgone) <= (alln - gone) * weight as stop from before),
level as (select alln - gone as num, allw - wgone as den from stops where not stop order by rn limit 1),
t as (select source, n, case when stop then cast(2 * n as double)
             else cast(weight * (select num from level) as double) / cast(2 * (select den from level) as double) end as target
      from stops),
j as (select k.*, t.n as source_size, t.target, case when t.n > 0 then cast(floor(t.target / t.n) as bigint) else 0 end as epochs
      from k join t on k.source is not distinct from t.source),
p as (select *, target - epochs * source_size as rest,
             sum(size) over (partition by source order by key, doc_id rows between unbounded preceding and current row) as upto from j)
select doc_id, size, source_size, target,
       cast(size * (epochs + case when rest > 0 and 2 * upto - size <= 2 * rest then 1 else 0 end) as bigint) as taken
from p""")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many words of each document the mix takes."""
    return mixing.mix(table(spark, sf_dir, "documents"))


# -- 10 -------------------------------------------------------------------------------------------

@query("op10_simhash")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    return simhash.component_ids(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


# -- 2 --------------------------------------------------------------------------------------------

def _either_case(word: str) -> str:
    return "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in word)


_NAMES = "|".join(_either_case(w) for w in ("password", "passwd", "secret", "token", "api_?key"))
_ASSIGN = rf"""({_NAMES})["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)"""


def _sql_spans(kind: str, rank: int, pattern: str, group: int, least: int) -> str:
    """Places of matches: lengths of what lies between matches and of the matches, summed up."""
    return f"""
select doc_id, {rank} as rank, '{kind}' as kind, cast(to_ - n as bigint) as start, cast(to_ as bigint) as to_ from (
  select doc_id, n, inner_, sum(gap + n) over (partition by doc_id order by i) as to_ from (
    select doc_id, i, length(gaps[i]) as gap, length(hits[i]) as n, length(inners[i]) as inner_ from (
      select doc_id, gaps, hits, inners, unnest(range(1, len(hits) + 1)) as i from (
        select doc_id, regexp_split_to_array(text, '{pattern}') as gaps, regexp_extract_all(text, '{pattern}') as hits,
               regexp_extract_all(text, '{pattern}', {group}) as inners
        from d where regexp_matches(text, '{pattern}')))))
where inner_ >= {least}"""


@query("op2_secret_scans", f"""
with d as (select doc_id, coalesce(text, '') as text from documents),
s as ({_sql_spans('assign', 1, _ASSIGN, 2, 8)} union all {_sql_spans('access', 2, 'AKIA[A-Z0-9]+', 0, 16)}
      union all {_sql_spans('hex', 3, '[0-9a-f]+', 0, 32)}),
g as (select doc_id, sum(cast(rank = 1 as int)) as a, sum(cast(rank = 2 as int)) as b, sum(cast(rank = 3 as int)) as c,
             string_agg(kind || ':' || start || ':' || to_, ',' order by start, rank) as list from s group by doc_id)
select doc_id, cast(coalesce(a, 0) as bigint) as n_assign, cast(coalesce(b, 0) as bigint) as n_access,
       cast(coalesce(c, 0) as bigint) as n_hex, sha256(coalesce(list, '')) as base_sha256, coalesce(list, '') as spans
from documents left join g using (doc_id)""")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every document, from a ledger that starts empty."""
    found = secrets.scan(table(spark, sf_dir, "documents"), shared_dir(spark, "ledger"))
    count = lambda kind: F.size(F.filter("findings", lambda f: f["kind"] == kind)).cast("long")
    spans = F.array_join(F.transform("findings", lambda f: F.concat_ws(":", f["kind"], f["start"], f["end"])), ",")
    return found.select(F.col("id").alias("doc_id"), count("assign").alias("n_assign"), count("access").alias("n_access"),
                        count("hex").alias("n_hex"), F.sha2(spans, 256).alias("base_sha256"), spans.alias("spans"))


# -- 4 --------------------------------------------------------------------------------------------

_NORM = r"lower(trim(regexp_replace(text, '[ \t\r\n\x0b\x0c]+', ' ', 'g')))"


def quoted_replies(conversations: DataFrame) -> DataFrame:
    """The conversations as mail: every turn quotes the turn before it, with that one's quote of the turn before, above its own text."""
    place = F.struct(F.col("conv_id").alias("conv_id"), F.col("turn").alias("turn"))
    texts = conversations.groupBy("conv_id", "turn").agg(F.min("text").alias("said"))
    said = lambda n: texts.select(F.col("conv_id").alias(f"c{n}"), (F.col("turn") + n).alias(f"t{n}"), F.col("said").alias(f"said{n}"))
    rows = conversations.select("conv_id", "turn", "role", F.coalesce("text", F.lit("")).alias("own"), place.alias("place"))
    for n in (1, 2):
        rows = rows.join(said(n), (F.col("conv_id") == F.col(f"c{n}")) & (F.col("turn") == F.col(f"t{n}")), "left")
    quote = lambda text, marks: F.concat(F.lit(marks), F.replace(text, F.lit("\n"), F.lit("\n" + marks)), F.lit("\n"))
    body = F.concat(F.coalesce(F.concat(F.lit("On turn "), (F.col("turn") - 1).cast("string"), F.lit(" they wrote:\n")), F.lit("")),
                    F.coalesce(quote(F.col("said2"), "> > "), F.lit("")), quote(F.col("said1"), "> "))
    return rows.select("conv_id", "turn", "role", F.concat(F.coalesce(body, F.lit("")), F.col("own")).alias("text"))


@query("op4_quotation_linking", f"""
with recursive m as (select conv_id, turn, role, coalesce(text, '') as text, {_NORM.replace('text', "coalesce(text, '')", 1)} as norm
                     from conversations),
firsts as (select conv_id, norm, min(turn) as first from m where norm <> '' group by conv_id, norm),
links as (select a.conv_id, a.turn, f.first as up from m a join m b on b.conv_id = a.conv_id and b.turn = a.turn - 1
          join firsts f on f.conv_id = b.conv_id and f.norm = b.norm),
tree as (select m.conv_id, m.turn, m.turn as root, 0 as depth from m left join links using (conv_id, turn) where links.up is null
         union all select l.conv_id, l.turn, t.root, t.depth + 1 from links l join tree t on t.conv_id = l.conv_id and t.turn = l.up)
select m.conv_id, m.turn, m.role, m.text, cast(l.up as bigint) as reply_to, cast(t.root as bigint) as root,
       cast(t.depth as bigint) as depth
from m left join links l using (conv_id, turn) left join tree t using (conv_id, turn)""")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations in reply order, without the quotes, from turns that quote the turns before."""
    mail = quoted_replies(table(spark, sf_dir, "conversations"))
    found = quotes.reply_order(mail, keep=("role",))
    return found.select(F.col("conv").alias("conv_id"), F.col("pos").alias("turn"), "role", F.col("own").alias("text"),
                        F.col("parent.pos").alias("reply_to"), F.col("root.pos").alias("root"), "depth")


# -- 6 --------------------------------------------------------------------------------------------

@query("op6_warc", """
with p as (select page_id, coalesce(html, '') as html from pages),
s as (select page_id, cast(strlen(html) as bigint) as payload_bytes, sha256(html) as payload_digest from p),
f as (select payload_digest, min(page_id) as first from s where payload_bytes >= 100 group by payload_digest)
select page_id, payload_bytes, payload_digest, case when first <> page_id then 'revisit' else 'response' end as record_type,
       case when first <> page_id then first end as refers_to
from s left join f using (payload_digest)""")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages written as WARC records and read back."""
    folder = shared_dir(spark, "warc")
    files = warc.write_archives(table(spark, sf_dir, "pages"), folder)
    return warc.read_archives(files, folder).select(
        warc.page_of(F.col("name")).alias("page_id"), "payload_bytes", "payload_digest", F.col("kind").alias("record_type"),
        warc.page_of(F.col("refers")).alias("refers_to"))


# -- 8 --------------------------------------------------------------------------------------------

HELD_OUT = 1


@query("op8_toxicity")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document, learned from the labels of documents that aren't held out."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(3)) == HELD_OUT
    model = toxicity.train(docs, labels.where(~held))
    found = toxicity.score(docs, model).withColumnRenamed("id", "doc_id")
    return found.select("doc_id", F.coalesce(held, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


# -- 9 --------------------------------------------------------------------------------------------

@query("op9_suffix_dedup", """
with d as (select doc_id, hex(encode(coalesce(text, ''))) as h from documents),
w as (select doc_id, p, md5(substr(h, cast(2 * p + 1 as bigint), 200)) as g
      from (select doc_id, h, unnest(range(cast(length(h) // 2 - 99 as bigint))) as p from d where length(h) >= 200)),
again as (select doc_id, p from (select doc_id, p, row_number() over (partition by g order by doc_id, p) as n from w) where n > 1),
marked as (select doc_id, p, case when p <= lag(p) over (partition by doc_id order by p) + 100 then 0 else 1 end as fresh from again),
runs as (select doc_id, p, sum(fresh) over (partition by doc_id order by p) as run from marked),
spans as (select doc_id, run, min(p) as a, max(p) + 100 as b from runs group by doc_id, run),
cuts as (select doc_id, a, b, coalesce(lag(b) over (partition by doc_id order by a), 0) as after from spans),
kept as (select doc_id, sum(b - a) as n_removed, count(*) as n_spans, max(b) as tail,
                string_agg(substr(h, cast(2 * after + 1 as bigint), cast(2 * (a - after) as bigint)), '' order by a) as parts
         from cuts join d using (doc_id) group by doc_id)
select d.doc_id, cast(length(h) // 2 as bigint) as n_bytes, cast(coalesce(n_removed, 0) as bigint) as n_removed,
       cast(coalesce(n_spans, 0) as bigint) as n_spans,
       sha256(unhex(coalesce(parts, '') || substr(h, cast(2 * coalesce(tail, 0) + 1 as bigint)))) as kept_sha256
from d left join kept using (doc_id)""")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document without long repeated strings."""
    found = suffixes.without_repeats(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), "kept_sha256")


# -- 11 -------------------------------------------------------------------------------------------

@query("op11_ngram_jaccard", f"""
with recursive d as (select doc_id, {_WS_WORDS.replace("coalesce(text, '')", f"translate(coalesce(text, ''), {_AZ})")} as ws from documents),
s as (select distinct doc_id, array_to_string(ws[p + 1:p + least(3, len(ws))], ' ') as g
      from (select doc_id, ws, unnest(range(greatest(len(ws) - 2, least(len(ws), 1)))) as p from d)),
n as (select doc_id, count(*) as n from s group by doc_id),
common as (select a.doc_id as a, b.doc_id as b, count(*) as c from s a join s b using (g) where a.doc_id < b.doc_id group by all),
links as (select a, b from common join n x on x.doc_id = a join n y on y.doc_id = b where 100 * c >= 90 * (x.n + y.n - c)),
reach as (select doc_id, doc_id as r from documents
          union select reach.doc_id, other from reach join (select a as this, b as other from links union all select b, a from links) on this = r),
least_ as (select doc_id, min(r) as component_id from reach group by doc_id)
select d.doc_id, cast(coalesce(n.n, 0) as bigint) as n_shingles, component_id
from d left join n using (doc_id) left join least_ using (doc_id)""")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Size of the shingle set and component of every document."""
    return gramjoin.similar_sets(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


# -- 12 -------------------------------------------------------------------------------------------

@query("op12_hard_negatives", """
with v as (select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
                  list_transform(embedding, lambda x: floor(256 * cast(x as double))) as v
           from embeddings where label is not null and embedding is not null
             and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
scored as (select a.vec_id as anchor_id, b.vec_id, a.label = b.label as same, cast(list_inner_product(a.v, b.v) as bigint) as score
           from v a join v b on a.vec_id % 100 = 0 and b.vec_id <> a.vec_id),
p as (select anchor_id, vec_id as positive_id, score as positive_score from scored where same
      qualify row_number() over (partition by anchor_id order by score desc, vec_id) <= 5)
select anchor_id, positive_id,
       cast(row_number() over (partition by anchor_id, positive_id order by score desc, vec_id) as integer) as rank,
       vec_id as negative_id, positive_score, score as negative_score
from p join scored using (anchor_id)
where not same and 80 * positive_score <= 100 * score and score <= positive_score
qualify row_number() over (partition by anchor_id, positive_id order by score desc, vec_id) <= 5""")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Negatives that score nearly as high as an anchor's positives."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.hard_negatives(table(spark, sf_dir, "embeddings"), F.col("id") % 100 == 0, label=label)


# -- 13 -------------------------------------------------------------------------------------------

# The checksum is computed byte by byte from its table of 256 remainders.
@query("op13_spelling_variants", f"""
with recursive rem as (select i as b, 0 as step, cast(i as ubigint) as v from range(256) t(i)
                       union all select b, step + 1, case when v & 1 = 1 then xor(v >> 1, 3988292384::ubigint) else v >> 1 end from rem where step < 8),
tab as (select list(v order by b) as tab from rem where step = 8),
r as (select doc_id, translate(run, {_AZ}) as run, count(*) as times
      from (select doc_id, unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-zÀ-ÿ]{{7,}}')) as run from documents) group by all),
x as (select run, times, hex(encode(coalesce(cast(doc_id as varchar), 'null') || ':' || run)) as h from r),
c as (select run, times, xor(list_reduce(list_prepend(4294967295::ubigint, list_transform(range(1, length(h), 2),
             lambda i: cast('0x' || substr(h, cast(i as bigint), 2) as ubigint))),
             lambda s, b: xor(s >> 8, tab[cast(xor(s, b) & 255 as bigint) + 1])), 4294967295::ubigint) as crc from x, tab),
w as (select case when crc % 31 = 0 then substr(run, 1, cast(crc % length(run) as bigint)) || substr(run, cast(crc % length(run) as bigint) + 2)
             else run end as word, times from c),
words as (select word, cast(sum(times) as bigint) as n from w where length(word) >= 7 group by word having sum(times) >= 2),
cuts as (select word, n, p, substr(word, 1, p - 1) || substr(word, p + 1) as cut
         from (select word, n, unnest(range(1, length(word) + 1)) as p from words)),
near as (select a.word, b.word as other, b.n as m from cuts a join cuts b on a.cut = b.cut and a.p = b.p and a.word <> b.word
         union select a.cut, a.word, a.n from cuts a join words b on b.word = a.cut
         union select a.word, b.word, b.n from cuts a join words b on b.word = a.cut),
best as (select word, count(*) as n_near, arg_min(other, (-m, encode(other))) as other, max(m) as m from near group by word),
forms as (select words.word, n, coalesce(n_near, 0) as n_near, case when m >= 10 * n then other end as form, case when m >= 10 * n then m end as form_n
          from words left join best using (word)),
ways as (select word, word as root from forms union all select ways.word, forms.form from ways join forms on forms.word = ways.root where form is not null),
ends as (select ways.word, ways.root from ways join forms on forms.word = ways.root where form is null)
select word, n, n_near, form, form_n, root from forms join ends using (word)""")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of the documents, with some letters left out, and the words that they are variants of."""
    return variants.variant_groups(table(spark, sf_dir, "documents"), every=31)
