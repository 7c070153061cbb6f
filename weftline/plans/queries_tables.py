"""Queries over rows and arrays: splits and batches, vectors, weights and losses, styles."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from weftline.functions import css, vectors
from weftline.functions.text import tokens
from weftline.operators import graph, nn, sampling, scoring

from .registry import query, table


def _docs(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars")


@query("""select doc_id, ((row_number() over (order by lang, md5('5:' || doc_id), doc_id) - 1 + 2) % 10)::int as fold from documents""")
def kfold_assign(spark, sf_dir):
    return sampling.kfold(_docs(spark, sf_dir), "doc_id", "lang", 10, seed=5, start=2).select("doc_id", "fold")


@query("""with r as (select doc_id, lang, row_number() over (partition by lang order by md5('1:' || doc_id), doc_id) - 1 as k, count(*) over (partition by lang) as n from documents)
select doc_id, lang, case when k < greatest(floor(n * 0.1), 1) then 'valid' else 'train' end as split from r""")  # fmt: skip
def stratified_split(spark, sf_dir):
    return sampling.stratified_split(_docs(spark, sf_dir), "doc_id", "lang", 0.1, seed=1).select("doc_id", "lang", "split")


@query("select doc_id, case when row_number() over (order by doc_id) <= floor(count(*) over () * 0.2) then 'valid' else 'train' end as split from documents")
def head_split(spark, sf_dir):
    return sampling.head_split(_docs(spark, sf_dir), "doc_id", 0.2).select("doc_id", "split")


@query("""with d as (select source, row_number() over (order by source) as k, count(*) over () as n from (select distinct source from documents))
select doc_id, source, case when k <= floor(n * 0.25) then 'valid' else 'train' end as split from documents join d using (source)""")  # fmt: skip
def directory_split(spark, sf_dir):
    return sampling.directory_split(_docs(spark, sf_dir), "source", 0.25).select("doc_id", "source", "split")


@query("""with r as (select doc_id, row_number() over (order by md5('0:' || doc_id), doc_id) - 1 as k, count(*) over () as n from documents)
select doc_id, k // 32 as batch, k % 32 as place from r where k // 32 < n // 32""")  # fmt: skip
def batch_drop_remainder(spark, sf_dir):
    order = [sampling.hash_order("doc_id", 0), F.col("doc_id")]
    return sampling.batches(_docs(spark, sf_dir), order, 32, drop_remainder=True).select("doc_id", "batch", "place")


@query("select doc_id, ((row_number() over (order by doc_id) - 1) % 8)::int as shard from documents")
def shard_round_robin(spark, sf_dir):
    return sampling.round_robin(_docs(spark, sf_dir), [F.col("doc_id")], 8).select("doc_id", "shard")


@query("select doc_id, row_number() over (order by md5('9:' || doc_id), doc_id) - 1 as place from documents")
def seeded_shuffle(spark, sf_dir):
    return sampling.shuffle(_docs(spark, sf_dir), "doc_id", 9).select("doc_id", "place")


@query("""select item_id as id, e::int as epoch, 'benchmark' as side from benchmark, (select unnest([0, 1, 2]) as e)
union all select conv_id, e::int, 'conversations' from (select distinct conv_id from conversations), (select unnest([0, 1, 2]) as e)""")  # fmt: skip
def concatenate_repeat(spark, sf_dir):
    a = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), F.lit("benchmark").alias("side"))
    b = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("id"), F.lit("conversations").alias("side")).distinct()
    return sampling.repeat(sampling.concatenate([a, None, b]), 3)


@query("""with r as (select item_id, row_number() over (order by item_id) - 1 as k, count(*) over () as n from benchmark),
d as (select range as draw, ('0x' || substr(md5('4:' || range), 1, 8))::bigint as h from range(500))
select draw, item_id from d, (select max(n) as n from r) m join r on r.k = h % m.n""")  # fmt: skip
def resample_with_replacement(spark, sf_dir):
    return sampling.resample(table(spark, sf_dir, "benchmark").select("item_id"), "item_id", 500, seed=4)


@query("""with c as (select conv_id, turn, (role = 'assistant')::int as l, lead((role = 'assistant')::int) over (partition by conv_id order by turn) as n from conversations)
select conv_id, turn, l * 10 + n as edge_label from c where n is not null""")  # fmt: skip
def bigram_labels(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", (F.col("role") == "assistant").cast("int").alias("l"))
    return sampling.bigrams(rows, "conv_id", "turn", "l").select("conv_id", "turn", "edge_label")


@query("""with c as (select conv_id, turn, role, coalesce((role <> lag(role) over (partition by conv_id order by turn))::int, 0) as d from conversations)
select conv_id, turn, sum(d) over (partition by conv_id order by turn)::bigint as run from c""")  # fmt: skip
def run_groups(spark, sf_dir):
    return sampling.runs(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role"), "conv_id", "turn", "role").select("conv_id", "turn", "run")


@query("select page_id, url from (select page_id, url, row_number() over (partition by regexp_extract(url, '://([^/]*)', 1) order by page_id) as k from pages) where k <= 6")
def cap_per_host(spark, sf_dir):
    rows = table(spark, sf_dir, "pages").select("page_id", "url", F.regexp_extract("url", "://([^/]*)", 1).alias("host"))
    return sampling.cap_per_group(rows, "host", ["page_id"], 6).select("page_id", "url")


@query("""with r as (select regexp_extract(url, '://([^/]*)', 1) as host, page_id, row_number() over (partition by regexp_extract(url, '://([^/]*)', 1) order by page_id) - 1 as r from pages),
a as (select host, page_id as left_id, r // 2 as p from r where r % 2 = 0), b as (select host, page_id as right_id, r // 2 as p from r where r % 2 = 1),
n as (select host, count(*) as n from b group by host)
select a.host, left_id, right_id from a join n using (host) join b on b.host = a.host and b.p = case when a.p < n then a.p else ('0x' || substr(md5('0:' || left_id), 1, 8))::bigint % n end""")  # fmt: skip
def pair_zip(spark, sf_dir):
    rows = table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("url", "://([^/]*)", 1).alias("host"))
    return sampling.zip_pairs(rows, "host", "page_id")


@query("""with r as (select item_id, row_number() over (order by item_id) - 1 as k, count(*) over () as n from benchmark)
select a.item_id as left_id, b.item_id as right_id from r a join r b on b.k = case when a.k < floor(a.n * 0.5) then floor(a.n * 0.5) - 1 - a.k else a.k end""")  # fmt: skip
def pair_permute(spark, sf_dir):
    from .lineage import rank_rows

    ranked = rank_rows(table(spark, sf_dir, "benchmark").select("item_id"), [F.col("item_id")], "k")
    size = ranked.agg(F.count("*").alias("n"))
    left = ranked.join(F.broadcast(size)).select(F.col("item_id").alias("left_id"), sampling.permute_side(F.col("k"), F.col("n"), 0.5).alias("k"))
    return left.join(ranked.select("k", F.col("item_id").alias("right_id")), "k").select("left_id", "right_id")


@query("""select vec_id, d::int as dim, round(case when d < 4 then sin(vec_id::double / pow(10000.0, d::double / 4)) else cos(vec_id::double / pow(10000.0, (d - 4)::double / 4)) end, 6) + 0.0::double as v from embeddings, range(8) r(d)""")
def sinusoid_positions(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode(sampling.positions(F.col("vec_id"), 8)).alias("dim", "v")).withColumn("v", F.round("v", 6))


@query("""select vec_id, unnest(range(9))::int as place, round(unnest(list_slice(embedding, s + 1, s + 9))::double, 6) + 0.0::double as v
from (select vec_id, embedding, ('0x' || substr(md5('2:' || vec_id), 1, 8))::bigint % greatest(len(embedding) - 8, 1) as s from embeddings)""")  # fmt: skip
def patch_windows(spark, sf_dir):
    patch = sampling.patches(F.col("embedding"), F.col("vec_id"), 9, seed=2)
    return table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode(patch).alias("place", "v")).withColumn("v", F.round(F.col("v").cast("double"), 6))


_D = "list_transform(embedding, lambda x: x::double)"


@query(f"""with e as (select vec_id, {_D} as v from embeddings), q as (select vec_id as query_id, v as qv from e where vec_id % 20 = 0),
s as (select query_id, vec_id, round(list_cosine_similarity(qv, v), 6) + 0.0::double as score from q, e where vec_id <> query_id)
select * from (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from s) where rank <= 10""")  # fmt: skip
def emb_cosine_topk(spark, sf_dir):
    """The ten nearest of every twentieth vector among all."""
    e = table(spark, sf_dir, "embeddings")
    return scoring.nearest(e.where("vec_id % 20 = 0"), e, "vec_id", "embedding", 10)


@query(f"select vec_id, unnest(range(len(v)))::int as dim, round(unnest(v) / n, 5) + 0.0::double as unit from (select vec_id, v, sqrt(list_dot_product(v, v)) as n from (select vec_id, {_D} as v from embeddings))")
def emb_l2norm(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode(vectors.l2_normalise(F.col("embedding"))).alias("dim", "unit")).withColumn("unit", F.round("unit", 5))


@query("""select vec_id, d::int as dim, round(case when ('0x' || substr(md5('6:' || vec_id), 1, 8))::bigint / 4294967296.0::double < 0.85 then 0 else x::double end, 6) + 0.0::double as v from (select vec_id, unnest(range(len(embedding))) as d, unnest(embedding) as x from embeddings)""")
def emb_mask(spark, sf_dir):
    masked = graph.mask_features(F.col("embedding"), F.col("vec_id"), 0.85, seed=6)
    return table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode(masked).alias("dim", "v")).withColumn("v", F.round(F.col("v").cast("double"), 6))


@query("select vec_id, round(case label when 0 then 1.0 when 1 then 2.0 when 2 then 3.0 else 6.0 end / 3.0, 6) as weight from embeddings")
def value_match_weights(spark, sf_dir):
    hot = F.array(*[F.when(F.col("label") == k, 1.0).otherwise(0.0) for k in range(3)])
    values = [([1.0, 0.0, 0.0], 1.0), ([0.0, 1.0, 0.0], 2.0), ([0.0, 0.0, 1.0], 3.0)]
    return table(spark, sf_dir, "embeddings").select("vec_id", F.round(vectors.match_weight(hot, values, 6.0), 6).alias("weight"))


@query("""select doc_id, round(case quality when 0 then 3.0 else 1.0 end / 2.0, 6) as class_weight, round(quality * 0.25 + (1 - quality) * 0.75, 6) as binary_weight,
  round(2 * case when quality = 1 then exp(1 - p) else exp(p) end, 6) as balanced_weight from (select *, (doc_id % 10) / 10.0::double as p from labels)""")  # fmt: skip
def class_weights(spark, sf_dir):
    y, p = F.col("quality"), F.col("doc_id") % 10 / 10.0
    weights = {"class_weight": vectors.class_weight(y, [3.0, 1.0]), "binary_weight": vectors.binary_weight(y, 0.25, 0.75), "balanced_weight": vectors.balanced_weight(y, p, 2.0)}
    return table(spark, sf_dir, "labels").select("doc_id", *[F.round(c, 6).alias(n) for n, c in weights.items()])


@query("""with s as (select doc_id, quality as y, (doc_id % 9 + 0.5) / 9.5::double as p from labels)
select doc_id, round(-((y * 0.9 + 0.05) * ln(p) + (1 - y * 0.9 - 0.05) * ln(1 - p)), 6) as bce, round(-ln(case when y = 1 then p else 1 - p end), 6) as cce,
  round(16 * ((pi() - 2 * acos(2 * p - 1)) / pi() - case when y = 1 then 1.0 / pi() else 0 end), 6) as arc, round(ln(p / (1 - p)), 6) as logit,
  round(case when y <> 1 then 30 * (2 * p - 1) when acos(2 * p - 1) + 0.5 < pi() then 30 * cos(acos(2 * p - 1) + 0.5) else 30 * (2 * p - 1 - 0.5 * sin(0.5)) end, 6) as angular,
  round(ln(exp(p) + exp(1 - p)) - case when y = 1 then p else 1 - p end, 6) as softmax from s""")  # fmt: skip
def loss_columns(spark, sf_dir):
    rows = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("y"), ((F.col("doc_id") % 9 + 0.5) / 9.5).cast("double").alias("p"))
    y, p = F.col("y"), F.col("p")
    columns = {
        "bce": vectors.binary_cross_entropy(y, p, smoothing=0.1),
        "cce": vectors.categorical_cross_entropy(F.array(1 - y, y).cast("array<double>"), F.array(1 - p, p)),
        "arc": vectors.linear_arc_margin(2 * p - 1, y == 1, scale=16.0),
        "angular": vectors.arc_margin(2 * p - 1, y == 1),
        "softmax": vectors.softmax_cross_entropy(F.array(1 - p, p), y),
        "logit": vectors.inverse_sigmoid(p),
    }
    return rows.select("doc_id", *[F.round(c, 6).alias(n) for n, c in columns.items()])


@query("""with x as (select label, unnest(range(1, len(embedding) + 1)) as dim, unnest(embedding)::double as v, vec_id from embeddings)
select label, dim - 1 as dim, round(sum(v), 5) + 0.0::double as sum, round(avg(v), 5) + 0.0::double as mean, round(greatest(max(v), 0), 5) as max from x group by label, dim""")  # fmt: skip
def readout_groups(spark, sf_dir):
    """Sum, mean and (padded) maximum of each place over a class's vectors."""
    rows = table(spark, sf_dir, "embeddings").select("label", F.posexplode("embedding").alias("dim", "v")).withColumn("v", F.col("v").cast("double"))
    out = rows.groupBy("label", F.col("dim").cast("long").alias("dim")).agg(F.sum("v").alias("sum"), F.avg("v").alias("mean"), F.greatest(F.max("v"), F.lit(0.0)).alias("max"))
    return out.withColumns({c: F.round(c, 5) for c in ("sum", "mean", "max")})


_CHAIN = """with v as (select label::bigint as page_id, vec_id::int as node_id, list_transform(embedding, lambda x: round(x::double, 3)) as x, row_number() over (partition by label order by vec_id) as k from embeddings),
e as (select a.page_id, a.node_id as src, b.node_id as dst, 0 as type_id from v a join v b on a.page_id = b.page_id and a.k = b.k + 1
  union all select a.page_id, a.node_id, b.node_id, 1 from v a join v b on a.page_id = b.page_id and a.k = b.k - 1)"""


def _chain(spark, sf_dir):
    """Vectors of a class as a chain: type 0 to the one before, type 1 to the one after."""
    from pyspark.sql import Window

    e = table(spark, sf_dir, "embeddings")
    w = Window.partitionBy("label").orderBy("vec_id")
    rows = e.select(F.col("label").cast("long").alias("page_id"), F.col("vec_id").cast("int").alias("node_id"), F.transform("embedding", lambda x: F.round(x.cast("double"), 3)).alias("x"), F.lag("vec_id").over(w).cast("int").alias("before"), F.lead("vec_id").over(w).cast("int").alias("after"))
    edges = rows.select("page_id", F.col("node_id").alias("src"), F.inline(F.array(F.struct(F.col("before").alias("dst"), F.lit(0).alias("type_id")), F.struct(F.col("after").alias("dst"), F.lit(1).alias("type_id"))))).where("dst is not null")
    return rows.select("page_id", "node_id", "x"), edges


@query(f"{_CHAIN} select page_id, src as node_id, type_id, greatest(count(*), 1) as degree from e group by all")
def vertex_degrees(spark, sf_dir):
    return _chain(spark, sf_dir)[1].groupBy("page_id", F.col("src").alias("node_id"), "type_id").agg(F.greatest(F.count("*"), F.lit(1)).alias("degree"))


@query(f"""{_CHAIN}, m as (select e.page_id, src, type_id, avg(list_sum(list_transform(x, lambda v, i: v * (((i - 1) * 7 + type_id * 5) % 11 - 5)::double))) as a,
    avg(list_sum(list_transform(x, lambda v, i: v * (((i - 1) * 7 + 3 + type_id * 5) % 11 - 5)::double))) as b
  from e join v on v.page_id = e.page_id and v.node_id = e.dst group by all),
s as (select page_id, src, greatest(sum(a), 0) as a, greatest(sum(b), 0) as b from m group by all)
select v.page_id, v.node_id, round(coalesce(a, 0), 5) + 0.0::double as y0, round(coalesce(b, 0), 5) + 0.0::double as y1 from v left join s on s.page_id = v.page_id and s.src = v.node_id""")  # fmt: skip
def gcn_mean_layer(spark, sf_dir):
    weights = [[[float((i * 7 + o * 3 + t * 5) % 11 - 5) for o in range(2)] for i in range(64)] for t in range(2)]
    out = nn.gcn_mean_sql(*_chain(spark, sf_dir), weights)
    return out.select("page_id", "node_id", F.round(F.element_at("y", 1), 5).alias("y0"), F.round(F.element_at("y", 2), 5).alias("y1"))


_DIM = 16
_WORDS = "list_filter(string_split_regex(coalesce(text, ''), '[\\x09-\\x0d\\x1c-\\x20\\x85\\xa0\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]+'), lambda w: w <> '')"


@query(f"""with w as (select item_id, ('0x' || substr(md5(unnest({_WORDS})), 1, 8))::bigint % {_DIM} as b from benchmark),
c as (select item_id, b, count(*)::double as n from w group by all), s as (select item_id, sqrt(sum(n * n)) as size from c group by item_id),
d as (select item_id, range as b from s, range({_DIM}))
select item_id, b::int as dim, round(coalesce(n / size, 0), 6) as v from d join s using (item_id) left join c using (item_id, b)""")
def hash_embeddings(spark, sf_dir):
    found = graph.hash_embeddings(table(spark, sf_dir, "benchmark"), ["item_id"], tokens(F.col("text")), _DIM)
    return found.select("item_id", F.posexplode("vec").alias("dim", "v")).withColumn("v", F.round("v", 6))


_UNITS = ["px", "em", "%", "pt", "pc", "in", "", "rem", "q", "abc"]
#: Sizes in every unit, some with a fraction, a sign or a name, made of the parts' sizes.
_SIZE_SQL = f"""
with s as (select p_partkey, case when p_partkey % 11 = 10 then 'medium' else case when p_partkey % 13 = 5 then '-' else '' end || p_size::varchar || case when p_partkey % 3 = 0 then '.5' else '' end || {_UNITS}[p_partkey % 10 + 1] end as s from part),
p as (select p_partkey, s, try_cast(nullif(regexp_extract(s, '^([+-]?(?:\\d+\\.?\\d*|\\.\\d+)(?:[eE][+-]?\\d+)?)', 1), '') as double) as v, regexp_replace(s, '^([+-]?(?:\\d+\\.?\\d*|\\.\\d+)(?:[eE][+-]?\\d+)?)', '') as u from s),
k as (select p_partkey, s, case when v is null then 3 when u = '%' then 0 when u in ('em', 'rem') then 2 when u in ('px', 'in', 'pt', 'pc', '') then 1 else 3 end as kind,
  case when v is null then 0 when u = '%' then v / 100 when u = 'in' then v * 96 when u = 'pt' then v * 96 / 72 when u = 'pc' then v * 12 * 96 / 72 when u in ('em', 'rem', 'px', '') then v else 0 end as val from p)"""


def _sizes(spark, sf_dir):
    key = F.col("p_partkey")
    made = F.concat(F.when(key % 13 == 5, "-").otherwise(""), F.col("p_size").cast("string"), F.when(key % 3 == 0, ".5").otherwise(""), F.element_at(F.array(*map(F.lit, _UNITS)), (key % 10 + 1).cast("int")))
    return table(spark, sf_dir, "part").select("p_partkey", F.when(key % 11 == 10, "medium").otherwise(made).alias("size"))


@query(f"{_SIZE_SQL} select p_partkey, s as size, kind, round(val, 6) + 0.0::double as val from k")
def css_sizes(spark, sf_dir):
    kind, value = css.size_kind(F.col("size"))
    return _sizes(spark, sf_dir).select("p_partkey", "size", kind.alias("kind"), F.round(value, 6).alias("val"))


@query(f"""{_SIZE_SQL}, f as (select *, case when s = 'medium' then s when kind = 3 then 'inherit'
    when kind = 1 then case when val <= 9 then 'xx-small' when val <= 11 then 'x-small' when val <= 14 then 'small' when val <= 17 then 'medium' when val <= 22 then 'large' when val <= 30 then 'x-large' else 'xx-large' end
    when val >= 1.01 then 'larger' when val <= 0.99 then 'smaller' else 'inherit' end as slot from k)
select p_partkey, s as size, slot, list_position(['medium', 'xx-small', 'x-small', 'small', 'large', 'x-large', 'xx-large', 'smaller', 'larger', 'inherit'], slot)::bigint as place from f""")  # fmt: skip
def css_font_sizes(spark, sf_dir):
    return _sizes(spark, sf_dir).select("p_partkey", "size", css.font_size_slot(F.col("size")).alias("slot"), F.array_position(css.font_size(F.col("size")), 1.0).alias("place"))


_NAMES = ", ".join(f"('{name}', {r}, {g}, {b})" for name, (r, g, b) in css.COLOURS.items())


@query(f"""with n(name, r, g, b) as (values {_NAMES}), l as (select list(name) as names from n),
p as (select p_partkey, p_partkey % 7 as kind, p_partkey * 7 % 256 as r, p_partkey * 13 % 256 as g, p_partkey * 29 % 256 as b, p_size, p_name, names[p_partkey % 16 + 1] as name from part, l),
c as (select p.p_partkey, kind, case kind when 0 then '#' || printf('%02x%02x%02x', p.r, p.g, p.b) when 1 then 'rgb(' || p.r || ', ' || p.g || ', ' || p.b || ')' when 2 then 'rgba(' || p.r || ', ' || p.g || ', ' || p.b || ', 0.25)'
    when 3 then p.name when 4 then 'rgb(' || p.r || ',' || p.g || ')' when 5 then p_name else 'hsl(0, 0%, ' || p_size || '%)' end as colour,
  case when kind < 3 then [p.r, p.g, p.b] when kind = 3 then [n.r, n.g, n.b] when kind < 6 then [0, 0, 0] else list_value(g1, g1, g1) end as v, case when kind = 2 then 0.25::double else 0.0::double end as alpha
  from (select *, round_even(p_size::double / 100 * 255, 0)::bigint as g1 from p) p left join n using (name))
select p_partkey, colour, v[1]::int as r, v[2]::int as g, v[3]::int as b, alpha from c""")  # fmt: skip
def css_colours(spark, sf_dir):
    """Colours of every notation, made of the parts' numbers; two notations are malformed."""
    key = F.col("p_partkey")
    r, g, b = (key * m % 256 for m in (7, 13, 29))
    texts = lambda *x: F.concat(*[v if isinstance(v, Column) else F.lit(v) for v in x])
    t = lambda v: v.cast("string")
    made = [
        texts("#", F.format_string("%02x%02x%02x", r, g, b)), texts("rgb(", t(r), ", ", t(g), ", ", t(b), ")"), texts("rgba(", t(r), ", ", t(g), ", ", t(b), ", 0.25)"),
        F.element_at(F.array(*map(F.lit, css.COLOURS)), (key % 16 + 1).cast("int")), texts("rgb(", t(r), ",", t(g), ")"), F.col("p_name"), texts("hsl(0, 0%, ", t(F.col("p_size")), "%)"),
    ]
    colour = F.element_at(F.array(*made), (key % 7 + 1).cast("int"))
    rows = table(spark, sf_dir, "part").select("p_partkey", colour.alias("colour")).withColumn("c", css.colour(F.col("colour")))
    channel = lambda k: F.round(F.element_at("c", k) * 255).cast("int")
    return rows.select("p_partkey", "colour", channel(1).alias("r"), channel(2).alias("g"), channel(3).alias("b"), F.element_at("c", 4).alias("alpha"))


@query("""select doc_id, lang, unnest(range(5))::int as slot, case when unnest(['de', 'en', 'es', 'fr', 'other']) = lang then 1.0::double else 0.0 end as hot from documents""")
def class_one_hot(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    index = F.coalesce(F.array_position(F.array(*map(F.lit, ["de", "en", "es", "fr", "other"])), F.col("lang")) - 1, F.lit(4))
    return docs.select("doc_id", "lang", F.posexplode(vectors.one_hot_index(index, 5)).alias("slot", "hot"))


@query("select doc_id, len(list_distinct([lang, source, 'en'])) as n_union, len(list_intersect([lang, source], ['en', 'src0', 'src1'])) as n_common, (list_has_all([lang, source, 'x'], ['en', 'src0'])) as has_all from documents")
def set_operations(spark, sf_dir):
    own = F.array("lang", "source")
    wanted = F.array(F.lit("en"), F.lit("src0"))
    return table(spark, sf_dir, "documents").select("doc_id", F.size(F.array_union(own, F.array(F.lit("en")))).cast("long").alias("n_union"), F.size(F.array_intersect(own, F.array(F.lit("en"), F.lit("src0"), F.lit("src1")))).cast("long").alias("n_common"), (F.size(F.array_except(wanted, own)) == 0).alias("has_all"))


@query("""select 'labels without a document' as rule, count(*) as n from labels where doc_id not in (select doc_id from documents)
union all select 'documents without a label', count(*) from documents where doc_id not in (select doc_id from labels)""")  # fmt: skip
def coverage_checks(spark, sf_dir):
    docs, labels = table(spark, sf_dir, "documents").select("doc_id"), table(spark, sf_dir, "labels").select("doc_id")
    a = labels.join(docs, "doc_id", "left_anti").agg(F.count("*").alias("n")).select(F.lit("labels without a document").alias("rule"), "n")
    return a.union(docs.join(labels, "doc_id", "left_anti").agg(F.count("*").alias("n")).select(F.lit("documents without a label"), "n"))


@query("select event_type, date_trunc('hour', ts) as hour, count(*) as n, round(sum(value), 4) as total from events group by all")
def event_windows(spark, sf_dir):
    """The batch form of the streaming ingest's windowed counts."""
    w = F.window("ts", "1 hour")
    rows = table(spark, sf_dir, "events").groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return rows.select("event_type", F.col("w.start").alias("hour"), "n", "total")
