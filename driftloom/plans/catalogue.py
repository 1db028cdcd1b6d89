"""Queries that apply the operators to whole tables, each with SQL that another engine can run."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import commands, fingerprints, paths
from ..operators import lineage, staleness, store, vectors
from ..sources import files, metadata, patterns, roots
from ..sources.contents import ContentStore
from ..sources.expectations import Expectations
from ..sources.tables import new_folder, stored, table
from ..streaming import status as arrivals
from . import snapshot
from .snapshot import INDEX, digest

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None, with_snapshot: bool = False):
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = f"with recursive {snapshot.SQL} {sql}" if with_snapshot else sql
        return f

    return register


# ---- fingerprints


@query("select doc_id, upper(sha256(text)) as version from documents")
def content_hash(spark, folder):
    return table(spark, folder, "documents").select("doc_id", digest(F.col("text")).alias("version"))


@query("select doc_id, left(sha256(text), 8) as short from documents")
def short_versions(spark, folder):
    return table(spark, folder, "documents").select("doc_id", fingerprints.short_version(digest(F.col("text"))).alias("short"))


@query("select upper(sha256(text)) as version, cast(min(doc_id) as varchar) as path, count(*) as copies from documents group by 1")
def content_dedupe(spark, folder):
    rows = table(spark, folder, "documents").select(digest(F.col("text")).alias("version"), "doc_id")
    return rows.groupBy("version").agg(F.min("doc_id").cast("string").alias("path"), F.count("*").alias("copies"))


MERKLE_SOURCE = """
  select lang, source, count(*) as n, upper(sha256(encode(string_agg(cast(doc_id as varchar), '' order by cast(doc_id as varchar))) ||
    unhex(string_agg(sha256(text), '' order by cast(doc_id as varchar))))) as version
  from documents group by lang, source"""


def _sources(spark, folder):
    rows = table(spark, folder, "documents").select("lang", "source", F.col("doc_id").cast("string").alias("name"), digest(F.col("text")).alias("v"))
    return fingerprints.merkle(rows, ["lang", "source"], "name", "v", 256)


@query(MERKLE_SOURCE)
def merkle_source(spark, folder):
    return _sources(spark, folder)


@query(f"""
with s as ({MERKLE_SOURCE})
select lang, count(*) as n, upper(sha256(encode(string_agg(source, '' order by source)) || unhex(string_agg(version, '' order by source)))) as version
from s group by lang""")
def merkle_lang(spark, folder):
    return fingerprints.merkle(_sources(spark, folder), ["lang"], "source", "version", 256)


@query("""
select l_orderkey as method, upper(sha1('concat $in1 $out1' || './' || string_agg('part/' || l_partkey, '' order by l_linenumber, l_partkey) || 'order/' || l_orderkey)) as signature
from lineitem group by l_orderkey""")
def method_signature(spark, folder):
    inputs = F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey")))
    rows = table(spark, folder, "lineitem").groupBy("l_orderkey").agg(F.transform(inputs, lambda x: F.concat(F.lit("part/"), x["l_partkey"])).alias("ins"))
    outs = F.array(F.concat(F.lit("order/"), F.col("l_orderkey")))
    return rows.select(F.col("l_orderkey").alias("method"), fingerprints.signature(F.lit("concat $in1 $out1"), F.lit("./"), F.col("ins"), outs).alias("signature"))


@query("""
with m as (
  select o_orderkey, upper(sha1('sum $in1 $out1' || './' || 'customer/' || o_custkey || 'order/' || o_orderkey)) as signature,
    case when o_orderstatus = 'O' then upper(sha1('sum $in2 $out1' || './' || 'customer/' || o_custkey || 'order/' || o_orderkey))
      else upper(sha1('sum $in1 $out1' || './' || 'customer/' || o_custkey || 'order/' || o_orderkey)) end as recorded from orders)
select o_orderkey as method, case when signature = recorded then upper(sha256(cast(o_orderkey as varchar))) end as expected from m""")
def signature_invalidation(spark, folder):
    sign = lambda command: fingerprints.signature(F.lit(command), F.lit("./"), F.array(F.concat(F.lit("customer/"), F.col("o_custkey"))), F.array(F.concat(F.lit("order/"), F.col("o_orderkey"))))
    recorded = F.when(F.col("o_orderstatus") == "O", sign("sum $in2 $out1")).otherwise(sign("sum $in1 $out1"))
    rows = table(spark, folder, "orders").select(F.col("o_orderkey").alias("method"), (sign("sum $in1 $out1") == recorded).alias("valid"), digest(F.col("o_orderkey").cast("string")).alias("expected"))
    return staleness.invalidated(rows, F.col("valid")).select("method", "expected")


# ---- paths and commands


@query("""
select page_id, split_part(split_part(url, '?', 1), '#', 1) as path,
  cast(len(split_part(split_part(url, '?', 1), '#', 1)) - len(replace(split_part(split_part(url, '?', 1), '#', 1), '/', '')) as integer) as depth,
  split_part(split_part(split_part(url, '?', 1), '#', 1), '/', -1) as name, ends_with(url, '/') as is_dir, lower(url) like '%.prov.json' as is_meta from pages""")
def path_parts(spark, folder):
    path = F.substring_index(F.substring_index("url", "?", 1), "#", 1)
    slashes = F.char_length("path") - F.char_length(F.replace(F.col("path"), F.lit("/"), F.lit("")))
    rows = table(spark, folder, "pages").withColumn("path", path)
    return rows.select(
        "page_id", paths.normalise_path(F.col("path")).alias("path"), slashes.cast("int").alias("depth"), F.substring_index("path", "/", -1).alias("name"),
        paths.is_directory(F.col("url")).alias("is_dir"), paths.is_metadata_file(F.col("url")).alias("is_meta"),
    )


@query("select doc_id, 'documents/' || lang || '/' || source || '/' || doc_id || '.txt' as path, lang || '/' || source || '/' || doc_id as joined_index, 3 as rank from documents")
def vector_index_scan(spark, folder):
    pattern = F.lit("documents/*/*/*.txt")
    index = F.array("lang", "source", F.col("doc_id").cast("string"))
    rows = table(spark, folder, "documents")
    return rows.select("doc_id", paths.apply_index(pattern, index).alias("path"), F.array_join(index, "/").alias("joined_index"), paths.rank(pattern).alias("rank"))


#: patterns of six shapes, one for each document
PATTERN_SQL = """
  select doc_id, case doc_id % 6 when 0 then lang || '/' || source || '.txt' when 1 then lang || '/*.txt' when 2 then source || '/*/' || lang || '/*/*.csv'
    when 3 then lang || '/*/' || source || '/' when 4 then lang || '/' || source || '/' else '*/*/' || doc_id || '.txt' end as pattern from documents"""


def _patterns(spark, folder):
    lang, source, k = F.col("lang"), F.col("source"), F.col("doc_id") % 6
    pattern = (
        F.when(k == 0, F.concat(lang, F.lit("/"), source, F.lit(".txt"))).when(k == 1, F.concat(lang, F.lit("/*.txt"))).when(k == 2, F.concat(source, F.lit("/*/"), lang, F.lit("/*/*.csv")))
        .when(k == 3, F.concat(lang, F.lit("/*/"), source, F.lit("/"))).when(k == 4, F.concat(lang, F.lit("/"), source, F.lit("/"))).otherwise(F.concat(F.lit("*/*/"), "doc_id", F.lit(".txt")))
    )
    return table(spark, folder, "documents").select("doc_id", pattern.alias("pattern"))


@query(f"select doc_id, pattern, cast(len(pattern) - len(replace(pattern, '*', '')) as integer) as rank from ({PATTERN_SQL})")
def vector_rank(spark, folder):
    return _patterns(spark, folder).select("doc_id", "pattern", paths.rank(F.col("pattern")).alias("rank"))


@query("""
select page_id, 'site/' || split_part(url, '/', 3) || '/' || page_id || '/*' as path from pages""")
def apply_index(spark, folder):
    index = F.array(F.split_part("url", F.lit("/"), F.lit(3)), F.col("page_id").cast("string"))
    return table(spark, folder, "pages").select("page_id", paths.apply_index(F.lit("site/*/*/*"), index).alias("path"))


@query(f"""
with b as (select doc_id, pattern, case when ends_with(pattern, '/') then left(pattern, len(pattern) - 1) else pattern end as bare from ({PATTERN_SQL})),
s as (select doc_id, pattern, case when instr(bare, '*') > 0 then left(bare, instr(bare, '*') - 1) || replace(replace(substr(bare, instr(bare, '*')), '/', '-'), '*', 'vector') else bare end as stem from b)
select doc_id, pattern, stem || '.prov.json' as metadata, stem || '.hash' as hashes from s""")
def sidecar_name(spark, folder):
    return _patterns(spark, folder).select("doc_id", "pattern", paths.metadata_file(F.col("pattern")).alias("metadata"), paths.hash_file(F.col("pattern")).alias("hashes"))


@query("""
select doc_id, '/data/x/' || lang || '/vector.csv.prov.json' as metadata, '/data/x/' || lang || '/' || source as place, cast(doc_id % 3 as integer) as format from documents""")
def metadata_places(spark, folder):
    """Where the metadata file of an id lies under a root, an id's place, and the format that a document says it has."""
    root = F.lit("/data/x/")
    document = F.to_json(F.struct((F.col("doc_id") % 3).cast("int").alias("format"), F.lit("source").alias("kind")))
    rows = table(spark, folder, "documents")
    return rows.select("doc_id", paths.metadata_full_path(root, F.concat("lang", F.lit("/*.csv"))).alias("metadata"), paths.below(root, F.concat_ws("/", "lang", "source")).alias("place"), paths.format_number(document).alias("format"))


@query("""
with p as (select page_id, 'site/' || split_part(url, '/', 3) || '/m.prov.json' as base, 'site/' || case when page_id % 2 = 0 then split_part(url, '/', 3) else 'other' end || '/' || page_id || '.html' as target from pages)
select page_id, case when page_id % 2 = 0 then page_id || '.html' else '../other/' || page_id || '.html' end as relative, target as resolved from p""")
def relative_paths(spark, folder):
    """Ids as they stand in a metadata file beside, and back."""
    host = F.split_part("url", F.lit("/"), F.lit(3))
    base = F.concat(F.lit("site/"), host, F.lit("/m.prov.json"))
    target = F.concat(F.lit("site/"), F.when(F.col("page_id") % 2 == 0, host).otherwise("other"), F.lit("/"), "page_id", F.lit(".html"))
    rows = table(spark, folder, "pages").select("page_id", base.alias("base"), paths.relative_path(base, target).alias("relative"))
    return rows.select("page_id", "relative", paths.resolved_id(F.col("base"), F.col("relative")).alias("resolved"))


@query("select part, split_part(part, '.', 1) as stem from (select p_name || '.' || p_brand || '.txt' as part from part)")
def first_dot_stem(spark, folder):
    name = F.concat("p_name", F.lit("."), "p_brand", F.lit(".txt"))
    return table(spark, folder, "part").select(name.alias("part"), paths.first_dot_stem(name).alias("stem"))


@query("""
with c as (select l_orderkey, l_linenumber, 'run $in' || l_linenumber || ' $in1 > $out1' as command from lineitem),
n as (select l_orderkey as o, max(l_linenumber) as inputs from lineitem where l_returnflag <> 'R' group by l_orderkey)
select l_orderkey, l_linenumber, cast(len(list_distinct(regexp_extract_all(command, '\\$in(\\d+)', 1))) as integer) as n_inputs, 1 as n_outputs,
  l_linenumber <= coalesce(inputs, 0) and coalesce(inputs, 0) >= 1 as valid from c left join n on l_orderkey = o""")
def command_references(spark, folder):
    rows = table(spark, folder, "lineitem")
    declared = rows.filter("l_returnflag <> 'R'").groupBy("l_orderkey").agg(F.max("l_linenumber").alias("inputs"))
    command = F.concat(F.lit("run $in"), F.col("l_linenumber"), F.lit(" $in1 > $out1"))
    named = rows.select("l_orderkey", "l_linenumber", command.alias("command")).join(declared, "l_orderkey", "left")
    c = F.col("command")
    return named.select(
        "l_orderkey", "l_linenumber", F.size(commands.references(c, "in")).alias("n_inputs"), F.size(commands.references(c, "out")).alias("n_outputs"),
        commands.valid(c, F.coalesce("inputs", F.lit(0)), F.lit(1)).alias("valid"),
    )


@query("""
with a as (select n_nationkey, 'nation/' || n_name || ' >> region/' || n_regionkey as arguments, case when n_nationkey % 3 = 0 then '"my cat"' else 'cat' end as program from nation)
select n_nationkey, program || ' ' || arguments as line, program, arguments from a""")
def command_lines(spark, folder):
    ins, outs = F.array(F.concat(F.lit("nation/"), "n_name")), F.array(F.concat(F.lit("region/"), "n_regionkey"))
    template = F.when(F.col("n_nationkey") % 3 == 0, '"my cat" $in1 >> $out1').otherwise("cat $in1 >> $out1")
    rows = table(spark, folder, "nation").withColumn("line", commands.substitute(commands.checked(template, F.size(ins), F.size(outs)), ins, outs))
    return rows.select("n_nationkey", "line", commands.program(F.col("line")).alias("program"), commands.arguments(F.col("line")).alias("arguments"))


# ---- dataflow over vectors


@query("select doc_id, cast(length(text) as integer) as length, lower(left(text, 20)) as head from documents")
def map_one_to_one(spark, folder):
    return vectors.map_elements(table(spark, folder, "documents"), ["doc_id"], length=F.char_length("text"), head=F.lower(F.left("text", F.lit(20))))


@query("select o_orderkey, cast(o_totalprice as decimal(18,2)) > (select sum(cast(o_totalprice as decimal(18,2))) / count(*) from orders) as above from orders")
def broadcast_scalar(spark, folder):
    orders = table(spark, folder, "orders").select("o_orderkey", F.col("o_totalprice").cast("decimal(18,2)").alias("price"))
    mean = orders.agg((F.sum("price") / F.count("*")).alias("mean"))
    return vectors.with_scalar(orders, mean, "mean").select("o_orderkey", (F.col("price") > F.col("mean")).alias("above"))


@query("select d.doc_id, d.lang, m.n, length(d.text) = m.longest as longest from documents d join (select lang, count(*) as n, max(length(text)) as longest from documents group by lang) m on d.lang = m.lang")
def broadcast_partial_rank(spark, folder):
    rows = table(spark, folder, "documents").select("lang", "doc_id", F.char_length("text").alias("length"))
    lower = rows.groupBy("lang").agg(F.count("*").alias("n"), F.max("length").alias("most"))
    return vectors.with_partial(rows, lower, ["lang"]).select("doc_id", "lang", "n", (F.col("length") == F.col("most")).alias("longest"))


@query("select d.doc_id, n_chars, quality, toxic from documents d join labels l on d.doc_id = l.doc_id")
def zip_vectors(spark, folder):
    return vectors.aligned(table(spark, folder, "documents").select("doc_id", "n_chars"), table(spark, folder, "labels"), ["doc_id"])


@query("select conv_id, turn, cast(pos - 1 as integer) as pos, words[pos] as word from (select conv_id, turn, string_split(text, ' ') as words, unnest(range(1, len(string_split(text, ' ')) + 1)) as pos from conversations)")
def scatter_words(spark, folder):
    return vectors.scatter(table(spark, folder, "conversations"), ["conv_id", "turn"], F.split("text", " "), "pos", "word")


@query("select o_orderkey, 'status' as port, o_orderstatus as value from orders union all select o_orderkey, 'priority', o_orderpriority from orders")
def scatter_two_outputs(spark, folder):
    return vectors.scatter_ports(table(spark, folder, "orders"), ["o_orderkey"], {"status": F.col("o_orderstatus"), "priority": F.col("o_orderpriority")})


@query("select conv_id, string_agg(text, '' order by turn) as text from conversations group by conv_id")
def reduce_turns(spark, folder):
    return vectors.reduce_to(table(spark, folder, "conversations"), ["conv_id"], "turn", "text", "text")


@query("""
with o as (select l_orderkey, sum(cast(l_extendedprice as decimal(18,2))) as total, count(*) as n from lineitem group by l_orderkey)
select o_custkey, cast(sum(total) as decimal(38,2)) as total, cast(sum(n) as bigint) as n, count(*) as orders from o join orders on l_orderkey = o_orderkey group by o_custkey""")
def reduce_rollup(spark, folder):
    prices = table(spark, folder, "lineitem").select("l_orderkey", F.col("l_extendedprice").cast("decimal(18,2)").alias("price"))
    by_order = vectors.fold_level(prices, ["l_orderkey"], total=F.sum("price"), n=F.count("*"))
    placed = by_order.join(table(spark, folder, "orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    return vectors.fold_level(placed, ["o_custkey"], total=F.sum("total").cast("decimal(38,2)"), n=F.sum("n"), orders=F.count("*"))


@query("""
with w as (select conv_id, unnest(string_split(text, ' ')) as word from conversations)
select conv_id, count(*) as words, count(distinct word) as different from w group by conv_id""")
def scatter_then_reduce(spark, folder):
    words = vectors.scatter(table(spark, folder, "conversations"), ["conv_id", "turn"], F.split("text", " "), "pos", "word")
    return words.groupBy("conv_id").agg(F.count("*").alias("words"), F.count_distinct("word").alias("different"))


@query("select lang, source, count(*) as n from documents group by lang, source")
def truncated_indices(spark, folder):
    """Indices of documents cut to two parts."""
    index = F.array("lang", "source", F.col("doc_id").cast("string"))
    cut = table(spark, folder, "documents").select(paths.truncate_index(index, 2).alias("index"))
    return cut.groupBy(F.col("index")[0].alias("lang"), F.col("index")[1].alias("source")).agg(F.count("*").alias("n"))


@query("select doc_id, n_chars from documents where doc_id not in (select doc_id from labels where quality = 0)")
def removed_keys(spark, folder):
    """Documents without those labelled as low, and without some that aren't there."""
    low = table(spark, folder, "labels").filter("quality = 0").select("doc_id")
    return vectors.without(table(spark, folder, "documents").select("doc_id", "n_chars"), low.union(low.select(-F.col("doc_id") - 1)), ["doc_id"])


@query("select lang, source, count(*) as n, min(doc_id) as first from documents group by lang, source")
def resolve_prefix(spark, folder):
    """Part of the collection under each (lang, source), by prefix of the index."""
    rows = table(spark, folder, "documents").select(F.array("lang", "source", F.col("doc_id").cast("string")).alias("index"), "doc_id")
    wanted = rows.select(F.slice("index", 1, 2).alias("index")).distinct()
    found = vectors.at_prefix(rows, wanted)
    return found.groupBy(F.col("wanted")[0].alias("lang"), F.col("wanted")[1].alias("source")).agg(F.count("*").alias("n"), F.min("doc_id").alias("first"))


DELTA = """
, d as (
  select *, bool_or(actual is not null) over (partition by lang, source) as any_actual from elements)
"""


@query(f"{DELTA} select lang, source, doc_id, expected, actual, case when actual is not null or not any_actual then 'Process' else 'Delete' end as update_type from d", True)
def source_delta(spark, folder):
    return vectors.source_delta(snapshot.expected(spark, folder), snapshot.item(spark, folder), INDEX, ["lang", "source"])


def _delta_by_lang(spark, folder):
    return vectors.source_delta(snapshot.expected(spark, folder), snapshot.item(spark, folder), INDEX, ["lang"])


BY_LANG = """
, d as (
  select *, case when actual is not null or not bool_or(actual is not null) over (partition by lang) then 'Process' else 'Delete' end as update_type from elements)
"""


@query(f"""{DELTA}
select lang, source, bool_and(actual is null) as absent, count(*) as n, count(*) filter (where actual is not null or not any_actual) as process from d group by lang, source""", True)
def delta_whole_vector_absent(spark, folder):
    """Of a vector of which nothing is there, all elements are processed, in the hope that they are stored."""
    delta = vectors.source_delta(snapshot.expected(spark, folder), snapshot.item(spark, folder), INDEX, ["lang", "source"])
    return delta.groupBy("lang", "source").agg(F.bool_and(F.col("actual").isNull()).alias("absent"), F.count("*").alias("n"), F.count_if(F.col("update_type") == "Process").alias("process"))


@query(f"{BY_LANG} select lang, source, case when bool_or(update_type = 'Delete') then 'Delete' else 'Process' end as update_type from d group by lang, source", True)
def delete_propagation(spark, folder):
    return vectors.propagate_deletes(_delta_by_lang(spark, folder), ["lang", "source"])


@query(f"{BY_LANG} select lang, cast(count(*) filter (where update_type = 'Process') as bigint) as remaining, 'Process' as update_type from d group by lang", True)
def reduce_after_delete(spark, folder):
    return vectors.reduce_update(_delta_by_lang(spark, folder), ["lang"])


# ---- staleness


def _elements(spark, folder):
    both = snapshot.expected(spark, folder).join(snapshot.item(spark, folder), INDEX, "full_outer")
    return staleness.presence(both, snapshot.stored(spark, folder), "expected")


@query("select e.lang, e.source, e.doc_id, expected, actual from expected e left join item i on e.lang = i.lang and e.source = i.source and e.doc_id = i.doc_id", True)
def expectation_lookup(spark, folder):
    return staleness.expectations(snapshot.expected(spark, folder), snapshot.item(spark, folder), INDEX).select(*INDEX, "expected", "actual")


@query("select lang, source, doc_id, status from status", True)
def link_status(spark, folder):
    rows = _elements(spark, folder)
    return rows.select(*INDEX, staleness.link_status(rows).alias("status"))


DECISION = """
  select lang, source, case when bool_or(status = 'LocalUnexpected') then 'SomeAreLocalUnexpected' when bool_or(status = 'NotFound') then 'SomeAreNotFound' else 'AllExist' end as decision,
    count(*) as n, case when bool_or(status in ('LocalUnexpected', 'NotFound')) then 0 else count(*) filter (where status = 'Remote') end as remote
  from status group by lang, source"""


@query(DECISION, True)
def group_decision(spark, folder):
    """Which (lang, source) parts of the documents changed against the snapshot, and what can be restored."""
    return staleness.group_decision(_elements(spark, folder), ["lang", "source"])


def _instances(spark, folder):
    """Instances (source): their inputs are the documents of the languages before the last, their outputs those of the last."""
    rows = _elements(spark, folder)
    inputs = staleness.group_decision(rows.filter("lang <> 'fr'"), ["source"]).select("source", F.col("decision").alias("ins"))
    outputs = staleness.group_decision(rows.filter("lang = 'fr'"), ["source"]).select("source", F.col("decision").alias("outs"))
    return inputs.join(outputs, "source", "full_outer")


INSTANCES = """
, g as (
  select source, lang = 'fr' as out_side, case when bool_or(status = 'LocalUnexpected') then 'SomeAreLocalUnexpected' when bool_or(status = 'NotFound') then 'SomeAreNotFound' else 'AllExist' end as decision
  from status group by 1, 2),
n as (select source, coalesce(max(case when not out_side then decision end), 'AllExist') as ins, coalesce(max(case when out_side then decision end), 'AllExist') as outs from g group by source),
own as (select source, case when ins <> 'AllExist' then 'InputsOutdated' when outs <> 'AllExist' then 'OutputsOutdated' else 'UpToDate' end as status from n)
"""


@query(f"{INSTANCES} select source, status from own", True)
def instance_status(spark, folder):
    return _instances(spark, folder).select("source", staleness.instance_status(F.col("ins"), F.col("outs")).alias("status"))


@query(f"""{INSTANCES},
edges as (
  select 'source/' || source as producer, 'lang/' || lang as consumer from elements group by 1, 2
  union select distinct 'lang/' || lang, 'all' from elements),
methods as (
  select 'source/' || source as method, status from own
  union all select distinct 'lang/' || lang, 'UpToDate' from elements union all select 'all', 'UpToDate'),
r(method) as (
  select method from methods where status <> 'UpToDate'
  union select consumer from edges join r on producer = r.method),
b as (select distinct consumer as method from edges join r on producer = r.method)
select m.method, case when b.method is not null then 'InputsOutdated' else status end as status from methods m left join b on m.method = b.method""", True)
def status_propagation(spark, folder):
    own = instance_status(spark, folder).select(F.concat(F.lit("source/"), "source").alias("method"), "status")
    places = _elements(spark, folder).select("lang", "source").distinct()
    by_lang = places.select(F.concat(F.lit("source/"), "source").alias("producer"), F.concat(F.lit("lang/"), "lang").alias("consumer")).distinct()
    to_all = places.select(F.concat(F.lit("lang/"), "lang").alias("producer"), F.lit("all").alias("consumer")).distinct()
    rest = to_all.select(F.col("producer").alias("method")).union(to_all.select(F.col("consumer").alias("method")).distinct()).withColumn("status", F.lit(staleness.UP_TO_DATE))
    own = own.union(rest)
    return staleness.propagate_status(own.select("method"), by_lang.union(to_all), own)


@query("select i.lang, i.source, i.doc_id, actual as expected, e.expected is null as is_new, e.expected <> actual as changed from item i left join expected e on e.lang = i.lang and e.source = i.source and e.doc_id = i.doc_id", True)
def record_expectation(spark, folder):
    old = snapshot.expected(spark, folder)
    new = staleness.record_expectations(old, snapshot.item(spark, folder), INDEX)
    both = new.join(old.withColumnRenamed("expected", "was"), INDEX, "left")
    return both.select(*INDEX, "expected", F.col("was").isNull().alias("is_new"), (F.col("was") != F.col("expected")).alias("changed"))


@query("""
with data as (select user_id as path, max(ts) as mtime from events where event_type <> 'signup' group by 1),
cache as (select user_id as path, max(ts) as cache_mtime from events where event_type = 'signup' group by 1)
select coalesce(d.path, c.path) as path, case when mtime is null then 'orphan' when cache_mtime is null then 'miss' when cache_mtime > mtime then 'hit' else 'stale' end as state
from data d full outer join cache c on d.path = c.path""")
def hash_cache_freshness(spark, folder):
    events = table(spark, folder, "events").withColumnRenamed("user_id", "path")
    data = events.filter("event_type <> 'signup'").groupBy("path").agg(F.max("ts").alias("mtime"))
    cache = events.filter("event_type = 'signup'").groupBy("path").agg(F.max("ts").alias("cache_mtime"))
    return staleness.fresh_hashes(data, cache, ["path"]).select("path", "state")


@query("""
with f as (select event_type || '/' || user_id || '/' as leaf, event_type || '/' as kind, ts from events)
select leaf as relative, max(ts) as mtime, count(*) as n from f group by 1
union all select kind, max(ts), count(*) from f group by 1
union all select '', max(ts), count(*) from f""")
def deep_mtime(spark, folder):
    """Events as files in folders by user in folders by type."""
    relative = F.concat_ws("/", "event_type", F.col("user_id").cast("string"), F.col("event_id").cast("string"))
    return patterns.deep_mtime(table(spark, folder, "events").select(relative.alias("relative"), F.lit(False).alias("directory"), F.col("ts").alias("mtime")))


@query("""
with data as (select user_id as path, max(ts) as mtime, md5(cast(sum(event_id) as varchar)) as computed from events where event_type <> 'signup' group by 1),
cache as (select user_id as path, max(ts) as cache_mtime, md5(cast(count(*) as varchar)) as cached from events where event_type = 'signup' group by 1)
select d.path, case when cache_mtime > mtime then cached else computed end as version from data d left join cache c on d.path = c.path""")
def cached_versions(spark, folder):
    """What the cache says of files that haven't changed since, computed versions of the others; nothing of absent ones."""
    events = table(spark, folder, "events").withColumnRenamed("user_id", "path")
    data = events.filter("event_type <> 'signup'").groupBy("path").agg(F.max("ts").alias("mtime"), F.md5(F.sum("event_id").cast("string").cast("binary")).alias("computed"))
    cache = events.filter("event_type = 'signup'").groupBy("path").agg(F.max("ts").alias("cache_mtime"), F.md5(F.count("*").cast("string").cast("binary")).alias("cached"))
    states = staleness.fresh_hashes(data, cache, ["path"])
    return states.filter("state <> 'orphan'").select("path", F.when(F.col("state") == "hit", F.col("cached")).otherwise(F.col("computed")).alias("version"))


@query("select lang, source, doc_id, case status when 'Local' then 'Up to date' when 'Remote' then 'Up to date (in storage)' else 'Need recomputation' end as text from status", True)
def status_texts(spark, folder):
    rows = _elements(spark, folder)
    status = staleness.link_status(rows)
    state = F.when(status.isin(staleness.LOCAL, staleness.REMOTE), staleness.UP_TO_DATE).otherwise(staleness.INPUTS)
    return rows.select(*INDEX, staleness.status_text(state, status).alias("text"))


@query("select lang, source, doc_id, case status when 'Remote' then 'Remote' else 'Local' end as location from status where status <> 'NotFound'", True)
def source_locations(spark, folder):
    """Where the documents are, as sources: a changed one is there too."""
    rows = _elements(spark, folder)
    status = staleness.link_status(rows)
    return rows.withColumn("status", status).filter("status <> 'NotFound'").select(*INDEX, staleness.source_status(F.col("status")).alias("location"))


@query("select o_orderkey, o_orderstatus in ('O', 'F') as ok from orders")
def exit_code_filter(spark, folder):
    return table(spark, folder, "orders").select("o_orderkey", staleness.succeeded(F.col("o_orderstatus"), F.array(F.lit("O"), F.lit("F"))).alias("ok"))


# ---- stores


@query("select actual as version, bool_or(actual in (select version from stored)) as in_store from item group by 1", True)
def storage_presence(spark, folder):
    versions = snapshot.item(spark, folder).select(F.col("actual").alias("version")).distinct()
    return staleness.presence(versions, snapshot.stored(spark, folder), "version")


@query("select version, count(*) as n_stores, string_agg(storage_name, ',' order by storage_name desc) as stores, max(storage_name) as storage_name from stored where version in (select expected from expected) group by 1", True)
def restore_choice(spark, folder):
    chosen = store.store_choice(snapshot.expected(spark, folder).select(F.col("expected").alias("version")), snapshot.stored(spark, folder))
    return chosen.withColumn("stores", F.array_join("stores", ","))


@query("""
, s as (select *, bool_or(actual is not null) over (partition by lang, source) as siblings from elements)
select lang || '/' || source || '/' || doc_id as path, expected as version from s where expected is not null and actual is null and not (lang = 'en' and siblings)""", True)
def paths_to_restore(spark, folder):
    both = snapshot.expected(spark, folder).join(snapshot.item(spark, folder), INDEX, "full_outer").withColumn("free", F.col("lang") == "en")
    rows = staleness.restorable(both, ["lang", "source"])
    return rows.select(F.concat_ws("/", "lang", "source", F.col("doc_id").cast("string")).alias("path"), F.col("wanted").alias("version"))


@query("""
, p as (select lang, source, doc_id, case when doc_id % 2 = 0 then expected end as expected, actual, case when doc_id % 3 > 0 then expected end as produced from elements),
s as (select *, bool_or(actual is not null) over (partition by lang, source) as siblings from p)
select lang || '/' || source || '/' || doc_id as path, coalesce(expected, produced) as version from s
where actual is null and case when expected is not null then not (lang = 'en' and siblings) else produced is not null end""", True)
def paths_never_seen(spark, folder):
    """Odd documents were never seen by the method: they take the version that their producer expects, if it has one."""
    both = snapshot.expected(spark, folder).join(snapshot.item(spark, folder), INDEX, "full_outer")
    some = lambda c: F.when(c, F.col("expected"))
    rows = both.select(*INDEX, some(F.col("doc_id") % 2 == 0).alias("expected"), "actual", some(F.col("doc_id") % 3 > 0).alias("produced"), (F.col("lang") == "en").alias("free"), F.lit(False).alias("from_source"))
    found = staleness.restorable(rows, ["lang", "source"])
    return found.select(F.concat_ws("/", "lang", "source", F.col("doc_id").cast("string")).alias("path"), F.col("wanted").alias("version"))


@query("select actual as version, min(lang || '/' || source || '/' || doc_id) as path from item where actual not in (select version from stored where storage_name = 'local') group by 1", True)
def save_plan(spark, folder):
    rows = snapshot.item(spark, folder).select(F.concat_ws("/", "lang", "source", F.col("doc_id").cast("string")).alias("path"), F.col("actual").alias("version"))
    return store.save_plan(rows, snapshot.stored(spark, folder), "local")


@query("select l_orderkey, l_linenumber, (row_number() over (partition by l_orderkey order by l_linenumber) - 1) % least(count(*) over (partition by l_orderkey), 4) as part from lineitem")
def archive_buckets(spark, folder):
    return store.archive_parts(table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber"), ["l_orderkey"], "l_linenumber", 4)


@query("select distinct entry from (select lang || '/' || source as entry from documents union all select 'page/' || split_part(url, '/', 3) from pages)")
def ignore_list_merge(spark, folder):
    old = table(spark, folder, "documents").select(F.concat_ws("/", "lang", "source").alias("entry"))
    new = table(spark, folder, "pages").select(F.concat(F.lit("page/"), F.split_part("url", F.lit("/"), F.lit(3))).alias("entry"))
    return store.merged_entries(old, new)


@query("""
with l as (
  select lang, source, min(doc_id) % 3 as kind from documents group by 1, 2),
old as (
  select lang as file, 'head ' || lang as line, 0.0 as part from l group by lang
  union all select lang, source, 1.0 from l where kind = 0 union all select lang, 'tail', 2.0 from l group by lang),
new as (select lang as file, source as line, 1.0 as part from l where kind < 2),
every as (
  select * from old union select * from new
  union select lang, '# --- managed entries: start ---', 0.5 from l union select lang, '# --- managed entries: end ---', 1.5 from l)
select file, cast(row_number() over (partition by file order by part, line) as integer) as pos, line from every""")
def ignore_list_section(spark, folder):
    """A list for each language: some sources are in its section, some are added."""
    rows = table(spark, folder, "documents").groupBy("lang", "source").agg((F.min("doc_id") % 3).alias("kind"))
    lines = lambda text, part, where="true": rows.filter(where).select(F.col("lang").alias("file"), text.alias("line"), F.lit(part).alias("part"))
    old = lines(F.concat(F.lit("head "), "lang"), 0).union(lines(F.lit("tail"), 4))
    old = old.union(lines(F.lit(store.SECTION_START), 1)).union(lines(F.lit(store.SECTION_END), 3)).union(lines(F.col("source"), 2, "kind = 0")).distinct()
    old = old.select("file", F.concat("part", F.lit(" "), "line").alias("pos"), "line")
    added = rows.filter("kind < 2").select(F.col("lang").alias("file"), F.col("source").alias("entry"))
    numbered = old.select("file", F.row_number().over(Window.partitionBy("file").orderBy("pos")).cast("long").alias("pos"), "line")
    return store.with_entries(numbered, added)


@query("select lang, source, cast(doc_id as varchar) as name, upper(sha256(text)) as version from documents")
def archive_round_trip(spark, folder):
    """Documents zipped by language and source, in parts of some size, and taken out again."""
    rows = table(spark, folder, "documents").select("lang", "source", F.col("doc_id").cast("string").alias("name"), F.encode("text", "UTF-8").alias("content"))
    keys = ["lang", "source"]
    runs = store.archive_runs(rows.withColumn("size", F.octet_length("content")), keys, "name", "size", 1 << 20)
    back = store.extract(store.archive(rows.join(runs, [*keys, "name"]), keys, "name"), keys, "name")
    return back.select("lang", "source", "name", fingerprints.version(F.col("content"), 256).alias("version"))


# ---- lineage


def _keys_by_kind(spark, folder):
    """Edges (src, dst) along the foreign keys: region, nation, customer, order, line; nation, supplier, line; part, line. Each table's own, with
    what dst begins with."""

    def edge(name, src_kind, src, dst_kind, *dst):
        return dst_kind, table(spark, folder, name).select(F.concat(F.lit(src_kind), F.col(src)).alias("src"), F.concat(F.lit(dst_kind), F.concat_ws("-", *dst)).alias("dst"))

    line = ("l_orderkey", "l_linenumber")
    return [
        edge("nation", "region/", "n_regionkey", "nation/", "n_nationkey"),
        edge("customer", "nation/", "c_nationkey", "customer/", "c_custkey"),
        edge("supplier", "nation/", "s_nationkey", "supplier/", "s_suppkey"),
        edge("orders", "customer/", "o_custkey", "order/", "o_orderkey"),
        edge("lineitem", "order/", "l_orderkey", "line/", *line),
        edge("lineitem", "supplier/", "l_suppkey", "line/", *line),
        edge("lineitem", "part/", "l_partkey", "line/", *line),
    ]


def _keys(spark, folder):
    return functools.reduce(DataFrame.union, [edges for _, edges in _keys_by_kind(spark, folder)])


KEYS_SQL = """
edges as (
  select 'region/' || n_regionkey as src, 'nation/' || n_nationkey as dst from nation
  union all select 'nation/' || c_nationkey, 'customer/' || c_custkey from customer
  union all select 'nation/' || s_nationkey, 'supplier/' || s_suppkey from supplier
  union all select 'customer/' || o_custkey, 'order/' || o_orderkey from orders
  union all select 'order/' || l_orderkey, 'line/' || l_orderkey || '-' || l_linenumber from lineitem
  union all select 'supplier/' || l_suppkey, 'line/' || l_orderkey || '-' || l_linenumber from lineitem
  union all select 'part/' || l_partkey, 'line/' || l_orderkey || '-' || l_linenumber from lineitem)
"""


@query(f"""
with recursive {KEYS_SQL},
r(node) as (
  select distinct dst from edges where dst like 'line/%'
  union select src from edges join r on dst = r.node)
select node from r""")
def provenance_closure(spark, folder):
    # all edges to lines are made of lineitem's rows, which name each line once for its three edges
    roots = table(spark, folder, "lineitem").select(F.concat(F.lit("line/"), F.concat_ws("-", "l_orderkey", "l_linenumber")).alias("node")).distinct()
    return lineage.closure(_keys_by_kind(spark, folder), roots).select("node")


@query(f"""
with recursive {KEYS_SQL},
r(node, level) as (
  select 'region/' || r_regionkey, 0 from region
  union all select dst, level + 1 from r join edges on src = r.node where dst not like 'line/%')
select node, cast(max(level) as integer) as level from r group by node""")
def topo_levels(spark, folder):
    """Regions, nations, suppliers, customers and orders by their place in the order of dependence."""
    edges = _keys(spark, folder).filter("dst not like 'line/%'")
    nodes = table(spark, folder, "region").select(F.concat(F.lit("region/"), "r_regionkey").alias("node")).union(edges.select("dst"))
    return lineage.levels(edges, nodes)


@query("""
select 'order/' || o_orderkey as node, cast(row_number() over (partition by o_custkey order by o_orderdate, o_orderkey) - 1 as integer) as level from orders""")
def order_chain_levels(spark, folder):
    """Each order of a customer builds on the one before: chains as long as a customer has orders."""
    orders = table(spark, folder, "orders").select("o_custkey", "o_orderdate", "o_orderkey", F.concat(F.lit("order/"), "o_orderkey").alias("node"))
    before = F.lag("node").over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey"))
    edges = orders.select(before.alias("src"), F.col("node").alias("dst")).filter("src is not null")
    return lineage.levels(edges, orders.select("node"))


@query("select l_orderkey as method, min('line/' || l_orderkey || '-' || l_linenumber) as method_id from lineitem group by 1")
def method_ids(spark, folder):
    outputs = table(spark, folder, "lineitem").select(F.col("l_orderkey").alias("method"), F.concat(F.lit("line/"), F.concat_ws("-", "l_orderkey", "l_linenumber")).alias("artefact"))
    return lineage.method_ids(outputs)


def _links(spark, folder):
    """Orders produce their lines' parts; suppliers consume the parts that they deliver."""
    rows = table(spark, folder, "lineitem")
    part = F.concat(F.lit("part/"), "l_partkey").alias("artefact")
    outs = rows.select(F.concat(F.lit("order/"), "l_orderkey").alias("method"), F.lit("out").alias("role"), F.col("l_linenumber").alias("port"), part)
    ins = rows.select(F.concat(F.lit("supplier/"), "l_suppkey").alias("method"), F.lit("in").alias("role"), F.col("l_linenumber").alias("port"), part).distinct()
    return outs.union(ins)


@query("""
with p as (select 'part/' || l_partkey as artefact, 'order/' || l_orderkey as producer, min(l_linenumber) as out_port from lineitem group by 1, 2),
c as (select distinct 'part/' || l_partkey as artefact, 'supplier/' || l_suppkey as consumer, l_linenumber as in_port from lineitem)
select p.artefact, producer, out_port, consumer, in_port from p join c on p.artefact = c.artefact""")
def port_resolution(spark, folder):
    return lineage.ports(_links(spark, folder))


@query("""
select l_orderkey, l_linenumber, o_custkey, c_nationkey, n_regionkey from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey""")
def row_lineage(spark, folder):
    lines = table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber")
    orders = table(spark, folder, "orders").select("o_orderkey", "o_custkey")
    customers = table(spark, folder, "customer").select("c_custkey", "c_nationkey")
    nations = table(spark, folder, "nation").select("n_nationkey", "n_regionkey")
    out = lineage.traced(lines, (orders, "l_orderkey", "o_orderkey"), (customers, "o_custkey", "c_custkey"), (nations, "c_nationkey", "n_nationkey"))
    return out.select("l_orderkey", "l_linenumber", "o_custkey", "c_nationkey", "n_regionkey")


@query(f"""
with recursive {KEYS_SQL},
r(node) as (
  select 'order/' || o_orderkey from orders where o_orderstatus = 'F'
  union select src from edges join r on dst = r.node)
select node from r where node like 'customer/%' or node like 'nation/%'""")
def tracked_closure(spark, folder):
    """Customers and nations (the tracked kinds) that finished orders depend on."""
    roots = table(spark, folder, "orders").filter("o_orderstatus = 'F'").select(F.concat(F.lit("order/"), "o_orderkey").alias("node"))
    found = lineage.closure(_keys_by_kind(spark, folder), roots)
    return found.filter("node like 'customer/%' or node like 'nation/%'").select("node")


@query("select 'part/' || (p_partkey + 1000000000) as artefact from part where p_size <= 10 union all select 'part/' || p_partkey from part where p_partkey not in (select l_partkey from lineitem)")
def unproduced(spark, folder):
    """Parts that no order has, as source artefacts: new ones among them."""
    part = table(spark, folder, "part")
    keys = part.select("p_partkey").union(part.filter("p_size <= 10").select(F.col("p_partkey") + 1000000000))
    stock = keys.select(F.lit("stock").alias("method"), F.lit("in").alias("role"), F.lit(1).alias("port"), F.concat(F.lit("part/"), "p_partkey").alias("artefact"))
    return lineage.sources(_links(spark, folder).union(stock)).filter("artefact like 'part/%'")


@query("""
with a as (select 'part/' || l_partkey as artefact from lineitem), m as (select 'order/' || l_orderkey from lineitem)
select count(distinct artefact) as artefacts, (select count(distinct m) from m m(m)) as methods from a""")
def graph_counts(spark, folder):
    return lineage.counts(_links(spark, folder))


@query("""
with l as (select distinct 'order/' || l_orderkey as method, 'out' as role, l_linenumber as port, 'part/' || l_partkey as artefact from lineitem
  union select distinct 'supplier/' || l_suppkey, 'in', l_linenumber, 'part/' || l_partkey from lineitem)
select * from l where method not in (select 'order/' || o_orderkey from orders where o_orderstatus = 'P')
union all select 'order/' || o_orderkey, 'out', 1, 'again/' || o_orderkey from orders where o_orderstatus = 'P'""")
def methods_replaced(spark, folder):
    """Orders in process are registered anew, with one output."""
    orders = table(spark, folder, "orders").filter("o_orderstatus = 'P'")
    new = orders.select(F.concat(F.lit("order/"), "o_orderkey").alias("method"), F.lit("out").alias("role"), F.lit(1).alias("port"), F.concat(F.lit("again/"), "o_orderkey").alias("artefact"))
    return lineage.add_methods(_links(spark, folder).distinct(), new)


@query("""
with l as (select distinct 'order/' || l_orderkey as method, 'out' as role, l_linenumber as port, 'part/' || l_partkey || '/' || l_orderkey as artefact from lineitem),
known as (select * from l where cast(split_part(method, '/', 2) as bigint) % 3 > 0)
select * from known union all select method, role, port + 100, artefact from l where cast(split_part(method, '/', 2) as bigint) % 3 = 0""")
def methods_added(spark, folder):
    """Orders make their parts. Two thirds are known; all are registered again with other ports, and only the others count."""
    rows = table(spark, folder, "lineitem")
    part = F.concat_ws("/", F.lit("part"), "l_partkey", "l_orderkey").alias("artefact")
    every = rows.select(F.concat(F.lit("order/"), "l_orderkey").alias("method"), F.lit("out").alias("role"), F.col("l_linenumber").alias("port"), part, "l_orderkey").distinct()
    known = every.filter("l_orderkey % 3 > 0").drop("l_orderkey")
    return lineage.add_absent(known, every.drop("l_orderkey").withColumn("port", F.col("port") + 100))


@query("""
select distinct o_custkey, c_nationkey from orders join customer on o_custkey = c_custkey where o_orderstatus = 'P'""")
def looked_up_customers(spark, folder):
    """The customers of orders in process, each once."""
    known = table(spark, folder, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey")
    return lineage.looked_up(known, table(spark, folder, "orders").filter("o_orderstatus = 'P'"), "o_custkey")


@query("""
with l as (select distinct l_suppkey, l_partkey from lineitem),
i as (select 'supplier/' || l_suppkey as method, 'in' as role, cast(row_number() over (partition by l_suppkey order by l_partkey) as integer) as port, 'part/' || l_partkey as artefact, '"' || upper(md5(cast(l_partkey as varchar))) || '"' as version from l)
select * from i union all select distinct method, 'out', 1, method, cast(null as varchar) from i""")
def metadata_round_trip(spark, folder):
    """A metadata document for each supplier, with the parts that it delivers, written as JSON and read as links."""
    parts = table(spark, folder, "lineitem").select("l_suppkey", "l_partkey").distinct()
    name = F.concat(F.lit("supplier/"), "l_suppkey")
    quoted = F.concat(F.lit('"'), F.upper(F.md5(F.col("l_partkey").cast("string").cast("binary"))), F.lit('"'))
    inputs = F.array_sort(F.collect_list(F.struct("l_partkey", quoted.alias("version"))))
    made = parts.groupBy("l_suppkey").agg(inputs.alias("ins")).select(
        F.lit(False).alias("tracked"), F.lit("command").alias("kind"), F.lit("deliver").alias("command"), F.lit("./").alias("working_dir"), F.lit(0).alias("output_index"), F.lit(None).cast("string").alias("signature"),
        F.lit(True).alias("clean_outputs"), F.array().cast("array<string>").alias("resource_groups"), F.array(F.lit(0)).alias("success_codes"),
        F.transform("ins", lambda x: F.struct(F.concat(F.lit("part/"), x["l_partkey"]).alias("path"), x["version"].alias("version"))).alias("inputs"),
        F.array(F.struct(name.alias("path"), F.lit(None).cast("string").alias("version"))).alias("outputs"),
    )
    at = new_folder(spark, "metadata")
    metadata.write(made, at)
    return metadata.links(metadata.read(spark, at))


# ---- files, stores and recorded versions on disk


def _on_disk(spark, folder):
    """The documents as files raw/<lang>/<source>/<doc_id>.txt under a root in the shared folder."""
    root = new_folder(spark, "files")
    rows = table(spark, folder, "documents").select(F.array("lang", "source", F.col("doc_id").cast("string")).alias("index"), F.col("text").alias("content"))
    files.write(rows, root, "raw/*/*/*.txt")
    return root


@query("select lang as index_1, source as index_2, cast(doc_id as varchar) as index_3, cast(strlen(text) as bigint) as length, upper(sha256(text)) as version from documents")
def files_by_pattern(spark, folder):
    """Documents written as files and read by a pattern."""
    rows = files.read(spark, _on_disk(spark, folder), "raw/*/*/*.txt")
    return rows.select("index_1", "index_2", "index_3", "length", fingerprints.version(F.col("content"), 256).alias("version"))


@query("select source as index_2, count(*) as n, sum(strlen(text))::bigint as bytes from documents where lang = 'de' and source in ('src1', 'src2', 'src3') group by source")
def files_of_some_folders(spark, folder):
    """Filters on index parts reach the listing: other folders aren't looked at."""
    rows = files.read(spark, _on_disk(spark, folder), "raw/*/*/*.txt", content=False)
    return rows.filter("index_1 = 'de' and index_2 in ('src1', 'src2', 'src3')").groupBy("index_2").agg(F.count("*").alias("n"), F.sum("length").alias("bytes"))


@query(None)
def directories_on_disk(spark, folder):
    """Digests of all directories of the documents' files, by a cache that a second run uses: nothing is computed again."""
    root = _on_disk(spark, folder)
    first = patterns.cached_digests(spark, root).filter("relative like '%/' or relative = ''").select("relative", "version")
    again = patterns.cached_digests(spark, root).select("relative", F.col("version").alias("again"), "recomputed")
    return first.join(again, "relative").select("relative", "version", (F.col("version") == F.col("again")).alias("same"), "recomputed")


PAGES_TREE = """
  select 'site/' || split_part(url, '/', 3) || '/' || page_id % 20 || '/' || page_id || '.html' as path, page_id,
    sha256(html) as now, sha256(case when page_id % 97 = 5 then html || '#' else html end) as was from pages"""


@query(f"""
with f as ({PAGES_TREE}),
l3 as (
  select regexp_extract(path, '^(.*/)[^/]+$', 1) as dir, unhex(sha256(encode(string_agg(regexp_extract(path, '[^/]+$'), '' order by regexp_extract(path, '[^/]+$'))) || unhex(string_agg(now, '' order by regexp_extract(path, '[^/]+$'))))) as v,
    bool_or(page_id % 97 = 5) as recomputed from f where page_id % 89 <> 7 group by 1),
g as (select regexp_extract(path, '^(.*/)[^/]+$', 1) as dir, bool_or(page_id % 89 = 7) as lost from f group by 1),
d3 as (select l3.dir, v, recomputed or lost as recomputed from l3 join g on l3.dir = g.dir),
u2 as (select regexp_extract(dir, '^(.*/)[^/]+/$', 1) as up, bool_or(lost) as lost from g group by 1),
d2 as (
  select up as dir, unhex(sha256(encode(string_agg(name, '' order by name)) || unhex(string_agg(hex(v), '' order by name)))) as v, bool_or(recomputed) as recomputed
  from (select regexp_extract(dir, '^(.*/)[^/]+/$', 1) as up, regexp_extract(dir, '([^/]+)/$', 1) as name, v, recomputed from d3) group by up),
e2 as (select d2.dir, v, recomputed or lost as recomputed from d2 join u2 on d2.dir = u2.up),
d1 as (
  select 'site/' as dir, unhex(sha256(encode(string_agg(name, '' order by name)) || unhex(string_agg(hex(v), '' order by name)))) as v, bool_or(recomputed) or (select bool_or(lost) from g) as recomputed
  from (select regexp_extract(dir, '([^/]+)/$', 1) as name, v, recomputed from e2))
select dir as path, hex(v) as version, recomputed from d3 union all select dir, hex(v), recomputed from e2 union all select dir, hex(v), recomputed from d1""")
def refreshed_directories(spark, folder):
    """Pages as files by site and shelf: some have changed, some are gone; only directories above these are made again."""
    pages = table(spark, folder, "pages")
    path = F.concat(F.lit("site/"), F.split_part("url", F.lit("/"), F.lit(3)), F.lit("/"), F.col("page_id") % 20, F.lit("/"), "page_id", F.lit(".html")).alias("path")
    changed = F.col("page_id") % 97 == 5
    old = pages.select(path, digest(F.when(changed, F.concat("html", F.lit("#"))).otherwise(F.col("html"))).alias("version"))
    now = pages.filter("page_id % 89 <> 7").select(path, digest(F.col("html")).alias("version"), changed.alias("changed"))
    return fingerprints.refreshed_tree(now, pages.filter("page_id % 89 = 7").select(path), fingerprints.merkle_tree(old, 256), bits=256)


@query("""
with v as (select upper(sha256(text)) as version, text from documents where doc_id % 3 <> 1)
select version, cast(max(strlen(text)) as bigint) as bytes from v where version in (select upper(sha256(text)) from documents d join labels l on d.doc_id = l.doc_id) group by version""")
def store_log(spark, folder):
    """Contents saved in three manifests, put into one, and those of labelled documents loaded."""
    documents = table(spark, folder, "documents")
    kept = ContentStore(spark, new_folder(spark, "store"))
    for part in ("doc_id % 3 = 0", "doc_id % 2 = 0 and doc_id % 3 <> 1", "doc_id % 3 <> 1"):
        kept.save(documents.filter(part).select(digest(F.col("text")).alias("version"), F.encode("text", "UTF-8").alias("content")))
    kept.compact()
    wanted = documents.join(table(spark, folder, "labels"), "doc_id").select(digest(F.col("text")).alias("version"))
    return kept.load(wanted).select("version", F.octet_length("content").cast("long").alias("bytes"))


@query("""
select lang || '/' || source || '/' || doc_id as element, case when source = 'src3' then actual else expected end as expected from elements
where case when source = 'src3' then actual else expected end is not null""", True)
def expectations_on_disk(spark, folder):
    """Recorded versions in buckets; a run saw the present documents of one source, so only its buckets are written again."""
    recorded = Expectations(spark, new_folder(spark, "expected"), buckets=64)
    index = F.array("source", "lang", F.col("doc_id").cast("string"))
    rows = lambda df, version: df.select(F.lit("documents").alias("method"), F.lit("out").alias("role"), F.lit(1).alias("port"), index.alias("instance"), index.alias("index"), F.col(version).alias("expected"))
    old, now = rows(snapshot.expected(spark, folder), "expected"), rows(snapshot.item(spark, folder), "actual").filter("instance[0] = 'src3'")
    recorded.replace(old, old)
    touched = old.filter("instance[0] = 'src3'").select("method", "instance").union(now.select("method", "instance"))
    recorded.replace(touched, now)
    i = F.col("index")
    return recorded.read().select(F.concat_ws("/", i[1], i[0], i[2]).alias("element"), "expected")


@query("""
, own as (select lang, source, doc_id, case when status in ('Local', 'Remote') then 'UpToDate' else 'OutputsOutdated' end as status from status),
s as (select lang, source, bool_or(status <> 'UpToDate') as bad from own group by 1, 2),
p as (select own.lang, own.source, doc_id, bad, doc_id % 7 = 0 as self from own join s on own.lang = s.lang and own.source = s.source),
l as (select lang, bool_or(bad or self) as bad from p group by lang)
select 'clean' as method, lang || '/' || source || '/' || doc_id as instance, status from own
union all select 'by source', lang || '/' || source, case when bad then 'InputsOutdated' else 'UpToDate' end from s
union all select 'spread', lang || '/' || source || '/' || doc_id, case when bad then 'InputsOutdated' when self then 'OutputsOutdated' else 'UpToDate' end from p
union all select 'by language', lang, case when bad then 'InputsOutdated' else 'UpToDate' end from l
union all select 'all', '', case when (select bool_or(bad) from l) then 'InputsOutdated' else 'UpToDate' end""", True)
def element_status(spark, folder):
    """Documents are cleaned, reduced by source, spread again, and reduced by language and to one: states of all instances."""
    rows = _elements(spark, folder)
    status = staleness.link_status(rows)
    index = F.array("lang", "source", F.col("doc_id").cast("string"))
    clean = rows.select(index.alias("index"), "doc_id", F.when(status.isin(staleness.LOCAL, staleness.REMOTE), staleness.UP_TO_DATE).otherwise(staleness.OUTPUTS).alias("status"))
    own = clean.select(F.lit("clean").alias("method"), F.col("index").alias("instance"), "status")
    own = own.union(clean.select(F.lit("spread"), "index", F.when(F.col("doc_id") % 7 == 0, staleness.OUTPUTS).otherwise(staleness.UP_TO_DATE)))
    for method, rank in (("by source", 2), ("by language", 1), ("all", 0)):
        own = own.union(clean.select(F.lit(method), F.slice("index", 1, rank), F.lit(staleness.UP_TO_DATE)).distinct())
    edges = spark.createDataFrame([("clean", "by source", 2), ("by source", "spread", 2), ("spread", "by language", 1), ("by language", "all", 0)], "producer string, consumer string, shared int")
    return staleness.propagate_elements(own, edges).select("method", F.array_join("instance", "/").alias("instance"), "status")


# ---- vectors in depth


@query("""
with p as (select conv_id, turn, unnest(string_split(text, ' ')) as piece, unnest(range(1, len(string_split(text, ' ')) + 1)) as i from conversations where text is not null)
select conv_id, cast(row_number() over (partition by conv_id order by turn, i) - 1 as bigint) as position, piece from p""")
def scatter_by_table_function(spark, folder):
    """Words of a conversation, counted on through its turns, by a table function over partitions."""
    return vectors.scatter_table(table(spark, folder, "conversations"), ["conv_id"], "turn", "text", lambda text: text.split(" "))


@query("""
with d as (select lang, source, cast(doc_id as varchar) as k, left(sha256(text), 8) as v from documents),
s as (select lang, source, count(*) as n, string_agg(k || ':' || v, ',' order by k collate "C") as one from d group by lang, source)
select lang, cast(sum(n) as bigint) as n, count(*) as sources, string_agg(source || '{' || one || '}', ';' order by source collate "C") as nested from s group by lang""")
def reduce_twice(spark, folder):
    """Documents' short versions, reduced by source and then by language, in order of the keys of each level."""
    index = F.array("lang", "source", F.col("doc_id").cast("string"))
    leaves = table(spark, folder, "documents").select(index.alias("index"), F.left(F.sha2(F.encode("text", "UTF-8"), 256), F.lit(8)).alias("v"))
    by_source = vectors.reduce_level(leaves, 3, "v")
    by_lang = vectors.reduce_level(by_source, 2, "values")
    inner = lambda pairs: F.array_join(F.transform(pairs, lambda x: F.concat(x["key"], F.lit(":"), x["value"])), ",")
    nested = F.array_join(F.transform("values", lambda x: F.concat(x["key"], F.lit("{"), inner(x["value"]), F.lit("}"))), ";")
    n = F.aggregate("values", F.lit(0).cast("long"), lambda a, x: a + F.size(x["value"]))
    return by_lang.select(F.col("index")[0].alias("lang"), n.alias("n"), F.size("values").cast("long").alias("sources"), nested.alias("nested"))


# ---- whole flows


TALK_SQL = """
with t as (select cast(conv_id as varchar) as c, cast(turn as varchar) as n, replace(coalesce(text, ''), 'e', 'E') as text from conversations)
select c as conv, count(*) as turns, string_agg(text, '' order by n collate "C") as text from t {where} group by c"""


@query(f"""
with before as ({TALK_SQL.format(where="")}), after as ({TALK_SQL.format(where="where cast(n as integer) <> 1 or cast(c as bigint) % 10 <> 3")})
select a.conv, a.text, (select cast(count(*) as bigint) from conversations) as mapped_first, (select count(*) from before) as reduced_first, cast(0 as bigint) as mapped_then,
  (select count(*) from after x join before y on x.conv = y.conv where x.turns <> y.turns) as reduced_then from after a""")
def flow_over_files(spark, folder):
    """Turns as files, with capital E's and joined by conversation; some turns go and what depends on them runs again; contents are saved,
    their files deleted, and restored. With the numbers of instances that ran."""
    from .flow import Flow

    root = new_folder(spark, "flow")
    roots.initialise(root)
    turns = table(spark, folder, "conversations").select(F.array(F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("index"), F.coalesce("text", F.lit("")).alias("content"))
    files.write(turns, root, "talk/*/*.txt")
    capitals = lambda rows: rows.select("index", F.replace("content", F.lit("e"), F.lit("E")).alias("content"))

    def joined(rows):
        return vectors.reduce_level(rows, 2, "content").select("index", F.array_join(F.transform("values", lambda x: x["value"]), "").alias("content"))

    flow = Flow.open(spark, root, buckets=32)
    flow.build(["talk/*/*.txt"], ["said/*/*.txt"], capitals, "capitals")
    flow.build(["said/*/*.txt"], ["conv/*.txt"], joined, "joined")
    flow.scan("talk/*/*.txt", text=True)
    ran = [flow.compute("conv/*.txt")]
    gone = turns.filter("index[1] = '1' and cast(index[0] as long) % 10 = 3").select("index", F.lit(None).cast("string").alias("content"))
    files.write(gone, root, "talk/*/*.txt")
    flow = Flow.open(spark, root, {"said/*/*.txt": capitals, "conv/*.txt": joined})  # knows methods, files and what was seen
    ran.append(flow.compute("conv/*.txt"))
    flow.save("conv/*.txt")
    flow.remove("conv/*.txt")
    flow.restore("conv/*.txt")
    numbers = [F.lit(ran[k][m]).cast("long").alias(f"{name}_{when}") for k, when in ((0, "first"), (1, "then")) for m, name in (("said/*/*.txt", "mapped"), ("conv/*.txt", "reduced"))]
    return files.read(spark, root, "conv/*.txt").select(F.col("index_1").alias("conv"), F.decode("content", "UTF-8").alias("text"), *numbers)


@query("""
with d as (select coalesce(lang, 'und') as l, coalesce(source, 'none') as s, doc_id, coalesce(text, '') as text from documents)
select l as lang, s as source, doc_id || '.size' as path, cast(strlen(text) as varchar) as content, (select count(*) from (select distinct l, s from d)) as ran_first,
  (select count(*) from (select distinct l, s from d where doc_id % 97 = 5)) as ran_then from d where doc_id % 97 <> 5""")
def flow_of_directories(spark, folder):
    """Documents as files in a directory for each language and source, of which a directory of sizes is made; some documents go, and only the
    directories that held them run again; directories are saved, deleted, and restored. With the numbers of instances that ran."""
    from .flow import Flow

    root = new_folder(spark, "flow")
    roots.initialise(root)
    index = F.array(F.coalesce("lang", F.lit("und")), F.coalesce("source", F.lit("none"))).alias("index")
    documents = table(spark, folder, "documents").select("doc_id", index, F.concat("doc_id", F.lit(".txt")).alias("path"), F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("content"))
    files.write(documents, root, "raw/*/*/")
    # of a directory that holds nothing any more nothing is made
    sizes = lambda rows: rows.filter("content is not null").select("index", F.concat(F.regexp_extract("path", "^[^.]*", 0), F.lit(".size")).alias("path"), F.encode(F.octet_length("content").cast("string"), "UTF-8").alias("content"))
    flow = Flow.open(spark, root, buckets=32)
    flow.build(["raw/*/*/"], ["size/*/*/"], sizes, "sizes")
    flow.scan("raw/*/*/")
    ran = [flow.compute("size/*/*/")]
    files.write(documents.filter("doc_id % 97 = 5").select("index", "path", F.lit(None).cast("binary").alias("content")), root, "raw/*/*/")
    flow = Flow.open(spark, root, {"size/*/*/": sizes})
    ran.append(flow.compute("size/*/*/"))
    flow.save("size/*/*/")
    flow.remove("size/*/*/")
    flow.restore("size/*/*/")
    flow.finish()
    numbers = [F.lit(n["size/*/*/"]).cast("long").alias(f"ran_{when}") for n, when in zip(ran, ("first", "then"), strict=True)]
    rows = flow.artefacts["size/*/*/"].filter("content is not null")
    return rows.select(F.col("index")[0].alias("lang"), F.col("index")[1].alias("source"), "path", F.decode("content", "UTF-8").alias("content"), *numbers)


@query("select lang || '/' || source || '/' || doc_id as element, expected, actual, status from status where expected is not null or actual is not null", True)
def arriving_status(spark, folder):
    """What is expected, stored and there is reported in three batches, which a stateful stream takes in one after the other."""
    name = F.concat_ws("/", "lang", "source", F.col("doc_id").cast("string")).alias("element")
    reports, marks, out = (new_folder(spark, x) for x in ("reports", "marks", "changes"))
    # texts are hashed once, not for each batch
    expected, there = (stored(rows, "versions")[0] for rows in (snapshot.expected(spark, folder).select(name, "expected"), snapshot.item(spark, folder).select(name, "actual")))
    report = lambda rows, kind, version, seq: rows.select("element", F.lit(kind).alias("kind"), F.col(version).alias("version"), F.lit(seq).cast("long").alias("seq"))
    held = expected.join(snapshot.stored(spark, folder).select(F.col("version").alias("expected")).distinct(), "expected", "left_semi")
    early = there.filter("substr(actual, 1, 1) < '8'")
    batches = (
        report(expected, "expected", "expected", 1).union(report(there.withColumn("old", F.lit("OLD")), "actual", "old", 1)),
        report(held, "stored", "expected", 2).union(report(early, "actual", "actual", 2)),
        report(there, "actual", "actual", 3),
    )
    for rows in batches:
        rows.write.mode("append").parquet(reports)
        arrivals.follow(spark.readStream.schema(arrivals.REPORT).parquet(reports), marks, out)
    return arrivals.latest(spark.read.parquet(out))
