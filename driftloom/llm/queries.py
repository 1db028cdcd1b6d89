"""The numbered queries: each applies its operator to its whole table. SQL where DuckDB can say the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat_format, collocations, embedding_dedup, exact_dedup, language_id, mixing, ngram_join, quality, substring_dedup, toxicity, vector_codes, warc
from .common import table

CHAT_TEST = "<|im_end|><|im_start|>assistant ok"


def tokenizer_spec(path: str | None = None) -> str:
    """The tokenizer file's JSON; its path is a parameter."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("byte_bpe_50k.json")
    with open(path, encoding="utf-8") as f:
        return f.read()


def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.sql("select cast(-1 as bigint) conv_id, cast(turn as bigint) turn, role, text from values (0, 'user', :t), (1, 'assistant', :t) as t(turn, role, text)", {"t": CHAT_TEST})
    done = chat_format.format_chats(rows.unionByName(extra))
    turns = chat_format.read_turns(F.col("formatted"))
    said = F.array_join(F.transform(turns, lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join(F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: chat_format.unescape_text(s["text"])), "")
    return done.select(
        "conv_id",
        F.size(turns).cast("long").alias("n_turns"),
        F.sha2(F.encode(said, "UTF-8"), 256).alias("turns_sha256"),
        F.char_length(loss).cast("long").alias("loss_chars"),
        F.sha2(F.encode(loss, "UTF-8"), 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
        "valid",
        "error_turn",
    )


OP1_SQL = f"""
with rows as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -1, 0, 'user', '{CHAT_TEST}'
  union all select -1, 1, 'assistant', '{CHAT_TEST}'),
parts as (
  select *, replace(replace(role, chr(92), chr(92) || 's'), '<|', '<' || chr(92) || 'p|') as r,
    replace(replace(text, chr(92), chr(92) || 's'), '<|', '<' || chr(92) || 'p|') as t,
    row_number() over in_order as i, lag(role, 1, 'start') over in_order as before, row_number() over (partition by conv_id order by turn desc nulls last, role desc, text desc) as from_end
  from rows window in_order as (partition by conv_id order by turn nulls first, role, text)),
moves(before, role) as (values ('start', 'system'), ('start', 'user'), ('system', 'user'), ('user', 'assistant'), ('assistant', 'user')),
marked as (select parts.*, moves.role is null as bad from parts left join moves on parts.before = moves.before and parts.role = moves.role),
chats as (
  select conv_id, count(*) as n_turns,
    string_agg(role || chr(10) || text || chr(10), '' order by i) as said,
    coalesce(string_agg(case when role = 'assistant' then text end, '' order by i), '') as loss,
    sum(length('<|im_start|>') + length(replace(r, chr(10), chr(92) || 'n')) + 1 + length(t) + length('<|im_end|>') + 1) as formatted_chars,
    min(case when bad then i - 1 end) as error_turn, bool_or(from_end = 1 and role = 'assistant') as ends_well
  from marked group by conv_id)
select conv_id, cast(n_turns as bigint) as n_turns, sha256(said) as turns_sha256, cast(length(loss) as bigint) as loss_chars,
  sha256(loss) as loss_sha256, cast(formatted_chars as bigint) as formatted_chars, error_turn is null and ends_well as valid, cast(error_turn as int) as error_turn from chats
"""


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents")).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


OP2_SQL = """
with d as (
  select doc_id, length(coalesce(text, '')) as n,
    sha256(regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]', '', 'g')) as text_sha256 from documents),
g as (
  select *, first_value(doc_id) over (partition by text_sha256 order by n desc, doc_id rows between unbounded preceding and unbounded following) as keep_id,
    count(*) over (partition by text_sha256) as group_size from d)
select doc_id, keep_id, cast(group_size as bigint) as group_size, doc_id = keep_id as kept, text_sha256 from g
"""


def op3_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_classes(table(spark, sf_dir, "documents"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_vectors(table(spark, sf_dir, "embeddings"))


# every pair of vectors: what projections leave out, SQL has to try
OP5_SQL = """
with recursive e as (
  select vec_id, cast(embedding as double[]) as v from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0),
l as (
  select a.vec_id as u, b.vec_id as v from e a join e b on a.vec_id <> b.vec_id and len(a.v) = len(b.v)
  where list_cosine_similarity(a.v, b.v) >= 0.95),
r(vec_id, reach) as (
  select vec_id, vec_id from embeddings
  union select r.vec_id, l.v from r join l on r.reach = l.u),
c as (select vec_id, min(reach) as component_id from r group by vec_id),
n as (select u as vec_id, count(*) as k from l group by u)
select c.vec_id, cast(coalesce(k, 0) as bigint) as n_links, component_id, c.vec_id = component_id as kept
from c left join n on c.vec_id = n.vec_id
"""


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


OP6_SQL = """
with p as (
  select page_id, cast(strlen(coalesce(html, '')) as bigint) as payload_bytes, sha256(coalesce(html, '')) as payload_digest from pages),
g as (select *, min(page_id) over (partition by payload_digest) as first_id from p)
select page_id, payload_bytes, payload_digest,
  case when payload_bytes >= 100 and page_id <> first_id then 'revisit' else 'response' end as record_type,
  case when payload_bytes >= 100 and page_id <> first_id then first_id end as refers_to from g
"""


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"), tokenizer_spec())


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", F.col("taken").cast("long").alias("taken"))


OP8_SQL = f"""
with d as (
  select doc_id, source, cast(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) as bigint) as size from documents),
s as (
  select source, cast(sum(size) as bigint) as source_size,
    case (row_number() over (order by source collate "C" nulls last) - 1) % 3 when 0 then 5.0::double when 1 then 2.0::double else 1.0::double end as weight
  from d group by source),
f as (select *, 2.0::double * source_size / weight as full_at, sum(source_size) over () as total from s),
l as (
  select *, (1.5::double * total - coalesce(sum(2.0::double * source_size) over before, 0)) /
    (sum(weight) over () - coalesce(sum(weight) over before, 0)) as level
  from f window before as (order by full_at, source nulls last rows between unbounded preceding and 1 preceding)),
t as (
  select source, source_size, least(2.0::double * source_size, weight * coalesce(max(case when level <= full_at then level end) over (), 0)) as target from l),
r as (
  select doc_id, d.source, size, source_size, target,
    case when source_size > 0 then target / source_size else 0 end as rate,
    row_number() over (partition by d.source order by size, doc_id) as rank
  from d join t on d.source is not distinct from t.source)
select doc_id, size, source_size, target,
  cast((floor({mixing.offset()}::double + rank * rate) - floor({mixing.offset()}::double + (rank - 1) * rate)) * size as bigint) as taken from r
"""


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(table(spark, sf_dir, "documents"))


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.remove_repeats(table(spark, sf_dir, "documents"))


# every window by its words: right, and slower than the graph
OP10_SQL = """
with w as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') as words from documents),
p as (select doc_id, p, sha256(array_to_string(words[p:p + 49], ' ')) as h from (select doc_id, words, unnest(range(1, len(words) - 48)) as p from w)),
g as (select doc_id, p, min(doc_id) over (partition by h) as least from p),
c as (select doc_id, list(distinct q) as gone from (select doc_id, unnest(range(p, p + 50)) as q from g where least < doc_id) group by doc_id),
k as (select w.doc_id, words, coalesce(gone, []) as gone from w left join c on w.doc_id = c.doc_id),
x as (select doc_id, unnest(words) as word, unnest(range(1, len(words) + 1)) as i from k),
y as (select x.doc_id, string_agg(word, ' ' order by i) as kept from x anti join (select doc_id, unnest(gone) as i from k) z on x.doc_id = z.doc_id and x.i = z.i group by x.doc_id)
select k.doc_id, cast(len(words) as bigint) as n_words, cast(len(gone) as bigint) as n_removed, sha256(coalesce(kept, '')) as kept_sha256
from k left join y on k.doc_id = y.doc_id
"""


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


# every n-gram counted by its words
OP11_SQL = """
with t as (select coalesce(lang, 'und') as lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as text from documents),
p as (select lang, unnest(regexp_split_to_array(text, '[.,;:!?\x0A-\x0D]')) as piece from t),
w as (select lang, regexp_extract_all(piece, '[^\x20\x09]+') as words from p),
g as (select lang, words, unnest(range(1, len(words) + 1)) as i from w),
f as (
  select lang, k, array_to_string(words[i:i + k - 1], ' ') as phrase, cast(count(*) as hugeint) as f
  from (select lang, words, i, unnest(range(1, 5)) as k from g) where i + k - 1 <= len(words) group by all),
n as (select lang, cast(sum(f) as hugeint) as n from f where k = 1 group by lang),
c as (select lang, k as size, phrase, f as a, string_split(phrase, ' ') as words from f where k >= 2 and f >= 30),
s as (
  select c.lang, c.phrase, size, a, cut, l.f as l, r.f as r, 2000000 * a // (l.f + r.f) as score
  from (select *, unnest(range(1, size)) as cut from c) c
  join f l on l.lang = c.lang and l.phrase = array_to_string(words[1:cut], ' ')
  join f r on r.lang = c.lang and r.phrase = array_to_string(words[cut + 1:], ' ')),
b as (select *, row_number() over (partition by lang, phrase order by score, cut) as weakest from s),
i as (
  select lang, array_to_string(words[j:j + k - 1], ' ') as phrase, max(a) as longer
  from (select *, unnest(range(2, size)) as k from c) x, unnest(range(1, 4)) as u(j) where j + k - 1 <= size group by all),
o as (
  select b.lang, b.phrase, a, l, r, score, row_number() over (partition by b.lang order by score desc, a desc, b.phrase collate "C") as rank
  from b left join i on b.lang = i.lang and b.phrase = i.phrase where weakest = 1 and (longer is null or 100 * longer < 80 * a))
select o.lang, rank, phrase, cast(a as bigint) as a, cast(l as bigint) as l, cast(r as bigint) as r, cast(n as bigint) as n, cast(score as bigint) as score
from o join n on o.lang = n.lang where rank <= 2000
"""


def op12_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.code_digests(table(spark, sf_dir, "embeddings"))


def _op13_sql(rounds: int = vector_codes.ROUNDS) -> str:
    """Rounds one after the other; all parts against all entries in each."""
    steps = [
        """e as materialized (
  select row_number() over (order by vec_id, ints) as row, vec_id, label, ints
  from (select vec_id, label, list_transform(cast(embedding as double[]), lambda x: cast(floor(4096 * x) as bigint)) as ints from embeddings
    where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0)),
x as materialized (
  select row, part, i, ints[part * (len(ints) // 8) + i + 1] as v
  from e, unnest(range(0, 8)) as p(part), unnest(range(0, len(ints) // 8)) as q(i)),
b0 as materialized (select part, row - 1 as entry, i, v from x where row <= 16)"""
    ]
    for k in range(rounds + 1):
        steps.append(f"""d{k} as materialized (
  select row, part, entry, distance from (
    select row, part, entry, distance, row_number() over (partition by row, part order by distance, entry) as nearest from (
      select x.row, x.part, b.entry, cast(sum((x.v - b.v) * (x.v - b.v)) as bigint) as distance
      from x join b{k} b on x.part = b.part and x.i = b.i group by all)) where nearest = 1)""")
        if k < rounds:
            steps.append(f"""b{k + 1} as materialized (
  select b.part, b.entry, b.i, cast(case when m.c is null then b.v else (m.s - ((m.s % m.c) + m.c) % m.c) // m.c end as bigint) as v
  from b{k} b left join (
    select x.part, d.entry, x.i, sum(x.v) as s, count(*) as c from x join d{k} d on x.row = d.row and x.part = d.part group by all) m
  on b.part = m.part and b.entry = m.entry and b.i = m.i)""")
    return f"""
with {", ".join(steps)},
h as (select sha256(coalesce(string_agg(cast(v as varchar), ',' order by part, entry, i), '')) as codebooks_sha256 from b{rounds}),
c as (select row, string_agg(lpad(to_hex(entry), 2, '0'), '' order by part) as code, sum(distance) as error from d{rounds} group by row),
l as (select label, sum(error) as label_error from c join e on c.row = e.row group by label)
select vec_id, lower(code) as code, cast(error as bigint) as error, cast(label_error as bigint) as label_error, codebooks_sha256
from c join e on c.row = e.row join l on e.label is not distinct from l.label, h
"""


QUERIES = {
    "op1_chat_format": op1_chat_format,
    "op2_exact_dedup": op2_exact_dedup,
    "op3_ngram_join": op3_ngram_join,
    "op4_toxicity": op4_toxicity,
    "op5_embedding_dedup": op5_embedding_dedup,
    "op6_warc": op6_warc,
    "op7_bpe": op7_bpe,
    "op8_mixing": op8_mixing,
    "op9_language_id": op9_language_id,
    "op10_substring_dedup": op10_substring_dedup,
    "op11_collocations": op11_collocations,
    "op12_quality": op12_quality,
    "op13_vector_codes": op13_vector_codes,
}
ORACLES = {"op1_chat_format": OP1_SQL, "op2_exact_dedup": OP2_SQL, "op5_embedding_dedup": OP5_SQL, "op6_warc": OP6_SQL, "op8_mixing": OP8_SQL, "op10_substring_dedup": OP10_SQL, "op11_collocations": OP11_SQL, "op13_vector_codes": _op13_sql()}
