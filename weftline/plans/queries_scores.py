"""Queries that score extracted text, label nodes and blocks, and sum up classifiers."""

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftline.functions import text
from weftline.operators import blocks, crawl, dom, extract, features, graph, models, nn, scoring

from . import page_sql
from .lineage import checkpoint
from .registry import query, table

_SP = text.SPACE_CLASS + "+"
_KEY = "try_cast(nullif(regexp_extract(url, '^https?://[^/]+/[a-z][a-z]/([0-9]+)', 1), '') as bigint)"
_STRIP = page_sql.STRIP
_BOTH = f"""
with g as (select page_id, {_KEY} as doc_id, {_STRIP} as pred from pages),
b as (select page_id, pred, text as gold from g join documents using (doc_id))"""
_TOK = lambda c: f"list_filter(string_split_regex(coalesce({c}, ''), '{_SP}'), lambda w: w <> '')"
_SETS = f"""{_BOTH}, s as (select page_id, list_distinct({_TOK('pred')}) as p, list_distinct({_TOK('gold')}) as g from b),
c as (select page_id, len(list_intersect(p, g)) as tp, len(p) - len(list_intersect(p, g)) as fp, len(g) - len(list_intersect(p, g)) as fn from s)"""
_BAGS = f"""{_BOTH}, w as (select page_id, unnest({_TOK('pred')}) as w, 1 as p, 0 as g from b union all select page_id, unnest({_TOK('gold')}), 0, 1 from b),
n as (select page_id, w, sum(p) as p, sum(g) as g from w group by all),
c as (select page_id, sum(least(p, g))::bigint as tp, sum(p - least(p, g))::bigint as fp, sum(g - least(p, g))::bigint as fn from n group by page_id)"""
_MICRO = """, t as (select sum(tp)::bigint as tp, sum(fp)::bigint as fp, sum(fn)::bigint as fn from c),
r as (select *, case when tp + fp > 0 then tp / (tp + fp) else 0 end as precision, case when tp + fn > 0 then tp / (tp + fn) else 0 end as recall from t)
select tp, fp, fn, round(precision, 6) as precision, round(recall, 6) as recall, round(case when precision + recall > 0 then 2 * precision * recall / (precision + recall) else 0 end, 6) as f1 from r"""


def _rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(n, 6) for n in names})


def _pages_and_gold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, html, pred (markup stripped by patterns) and gold (the document that the page's URL names)."""
    key = F.expr(_KEY)
    pages = table(spark, sf_dir, "pages").select("page_id", "html", key.alias("doc_id"), text.strip_markup(F.col("html")).alias("pred"))
    return pages.join(table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("gold")), "doc_id").select("page_id", "html", "pred", "gold")


@query(f"{_BOTH} select page_id, length(pred) as n_pred, length(gold) as n_gold from b")
def gold_join(spark, sf_dir):
    return _pages_and_gold(spark, sf_dir).select("page_id", F.length("pred").cast("long").alias("n_pred"), F.length("gold").cast("long").alias("n_gold"))


@query(f"""with p as (select distinct {_KEY} as doc_id from pages), d as (select distinct doc_id from documents where length(text) > 1000)
select coalesce(p.doc_id, d.doc_id) as doc_id, case when d.doc_id is null then 'left_only' when p.doc_id is null then 'right_only' else 'matched' end as status from p full join d on p.doc_id = d.doc_id""")  # fmt: skip
def gold_match_report(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select(F.expr(_KEY).alias("doc_id"))
    return scoring.match_report(pages, table(spark, sf_dir, "documents").where(F.length("text") > 1000), "doc_id")


@query(f"select source, max_by(doc_id, n_chars * 100000000 + doc_id) as doc_id from documents group by source")
def gold_last_by_key(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").withColumn("o", F.col("n_chars") * 100000000 + F.col("doc_id"))
    return scoring.last_by_key(docs.select("source", "doc_id", "o"), "source", "o").select("source", "doc_id")


@query("""select doc_id, md5(regexp_replace(regexp_replace('URL: http://x' || chr(10) || ' <h> ' || text, '(^|\\n)(URL:.*)', '', 'g'), '(^|\\n)[ \\t]*(<.*?>)', chr(10), 'g')) as digest from documents""")
def gold_clean(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(text.clean_gold(F.concat(F.lit("URL: http://x\n <h> "), F.col("text")))).alias("digest"))


@query("""select doc_id, len(list_filter(string_split(regexp_replace(text, '(\\s{2,}|\\t)', ' ', 'g'), chr(10)), lambda x: trim(x) <> '')) as n_lines from documents""")
def text_tidy(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.size(F.split(text.tidy_lines(F.col("text")), "\n")).cast("long").alias("n_lines"))


@query("""select doc_id, encoding, md5(body) as digest from (select doc_id, 'utf-8' as encoding, text as body from documents)""")
def page_header(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    page = F.concat(F.lit('<text id="u" title="t" encoding="UTF-8">\n'), F.col("text"), F.lit("\n</text>"))
    return docs.select("doc_id", text.page_encoding(page).alias("encoding"), F.md5(text.strip_page_header(page)).alias("digest"))


@query(f"select doc_id, len({_TOK('text')}) as n_tokens from documents")
def text_tokens(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.size(text.tokens(F.col("text"))).cast("long").alias("n_tokens"))


@query("select doc_id, len(list_filter(list_transform(regexp_extract_all(coalesce(text, ''), '[^.!?！？。]+[.!?！？。]*'), lambda x: trim(x)), lambda x: x <> ''))::int as n_sentences from documents")
def text_sentences(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.size(text.sentences(F.col("text"))).alias("n_sentences"))


@query(f"{_SETS} select * from c")
def bow_set_scores(spark, sf_dir):
    counts = scoring.set_confusion(F.col("pred"), F.col("gold"))
    return _pages_and_gold(spark, sf_dir).select("page_id", *[c.cast("long").alias(n) for n, c in counts.items()])


@query(f"{_BAGS} select * from c")
def bow_multiset_scores(spark, sf_dir):
    return scoring.multiset_confusion(_pages_and_gold(spark, sf_dir), "page_id", "pred", "gold")


@query(f"{_SETS}{_MICRO}")
def bow_micro_f1(spark, sf_dir):
    counts = scoring.set_confusion(F.col("pred"), F.col("gold"))
    return _rounded(scoring.micro(_pages_and_gold(spark, sf_dir).select(*[c.alias(n) for n, c in counts.items()])), "precision", "recall", "f1")


@query(f"{_BAGS}{_MICRO}")
def bow_micro_f1_multiset(spark, sf_dir):
    return _rounded(scoring.micro(scoring.multiset_confusion(_pages_and_gold(spark, sf_dir), "page_id", "pred", "gold")), "precision", "recall", "f1")


def _extracted(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    both = _pages_and_gold(spark, sf_dir).where("page_id is not null")
    return extract.extract(both, name, keep=("gold",)).select("page_id", "text", "gold")


@query()
def extractor_scoreboard(spark, sf_dir):
    """Precision, recall and F1 of each extractor over distinct words."""
    out = None
    for name in ("body", "cetd", "cetd_variant", "readability"):
        counts = scoring.set_confusion(F.col("text"), F.col("gold"))
        row = scoring.micro(_extracted(spark, sf_dir, name).select(*[c.alias(n) for n, c in counts.items()])).withColumn("extractor", F.lit(name))
        out = row if out is None else out.unionByName(row)
    return _rounded(out, "precision", "recall", "f1")


@query()
def lcs_scores(spark, sf_dir):
    return _rounded(scoring.alignment_scores(_extracted(spark, sf_dir, "cetd"), "page_id", "text", "gold"), "precision", "recall")


@query()
def lcs_macro_scores(spark, sf_dir):
    return _rounded(scoring.macro(scoring.alignment_scores(_extracted(spark, sf_dir, "body"), "page_id", "text", "gold")), "precision", "recall", "f1")


def _labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.label_pages(_pages_and_gold(spark, sf_dir).select("page_id", "html", "gold"))


@query()
def node_labels(spark, sf_dir):
    return _labelled(spark, sf_dir)


@query()
def node_label_subgraphs(spark, sf_dir):
    labels = _labelled(spark, sf_dir)
    some = labels.where("label <> 'other'").select("page_id", "node_id", "label")
    p = graph.GraphParams(max_depth=4, max_nodes=32, max_neighbours=8)
    return graph.node_subgraphs(table(spark, sf_dir, "pages"), some, p).select("page_id", "node_id", "label", F.size("nodes").alias("n_nodes"))


@query()
def graph_text(spark, sf_dir):
    """Page texts from nodes labelled content, the decision step of graph-model extraction."""
    labels = _labelled(spark, sf_dir)
    return extract.text_of_nodes(dom.dom_table(table(spark, sf_dir, "pages"), "texts"), labels.where("label = 'content'"))


def _blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blocks.blocks(*dom.dom_tables(table(spark, sf_dir, "pages"), "nodes", "texts"))


@query()
def block_features(spark, sf_dir):
    return blocks.block_features(_blocks(spark, sf_dir)).select("page_id", "j", F.transform("f", lambda x: F.round(x, 6)).alias("f"))


@query()
def block_edges(spark, sf_dir):
    return blocks.edge_features(_blocks(spark, sf_dir))


@query()
def viterbi_decode(spark, sf_dir):
    """Labels of blocks from scores that words and breaks suggest."""
    found = _blocks(spark, sf_dir)
    n = F.size("words").cast("double")
    unary = F.array(F.lit(1.0), F.ln(n + 1))
    following = F.lead("boundary").over(Window.partitionBy("page_id").orderBy("j"))
    edge = F.when(following.isNotNull(), F.array(F.lit(0.5), F.lit(-0.5), F.lit(-0.5), F.when(following, 0.1).otherwise(0.5)))
    return blocks.label_string(blocks.decode(found.select("page_id", "j", unary.alias("unary"), edge.alias("edge"))))


@query()
def block_classifier(spark, sf_dir):
    """Blocks scored by a forest that learned from node labels."""
    labels = checkpoint(_labelled(spark, sf_dir))
    features = checkpoint(blocks.block_features(_blocks(spark, sf_dir)))
    truth = labels.where("label <> 'other'").select("page_id", "node_id", (F.col("label") == "content").cast("int").alias("label"))
    model = blocks.train_block_classifier(features, truth, trees=8)
    scored = blocks.classify_blocks(model, features).join(truth, ["page_id", "node_id"])
    return _rounded(scoring.threshold_f1(scored, "score", "label", [0.3, 0.5, 0.7]), "precision", "recall", "f1")


@query()
def gcn_page_layer(spark, sf_dir):
    nodes = dom.dom_table(table(spark, sf_dir, "pages"), "nodes")
    x = nodes.select("page_id", "node_id", F.array(F.col("depth").cast("double"), F.col("sib_idx").cast("double"), F.lit(1.0)).alias("x"))
    r = np.random.default_rng(3)
    weights = [r.normal(size=(3, 4)), r.normal(size=(3, 4))]
    out = nn.run_per_page(x, dom.edges_of(nodes), lambda a, e: nn.gcn(a, e, weights))
    return out.select("page_id", "node_id", F.transform("y", lambda v: F.round(v, 6)).alias("y"))


@query()
def gat_page_layer(spark, sf_dir):
    nodes = dom.dom_table(table(spark, sf_dir, "pages"), "nodes")
    x = nodes.select("page_id", "node_id", F.array(F.col("depth").cast("double"), F.col("sib_idx").cast("double"), F.lit(1.0)).alias("x"))
    r = np.random.default_rng(5)
    weights, attend = [r.normal(size=(3, 4)) for _ in range(2)], [r.normal(size=8) for _ in range(2)]
    out = nn.run_per_page(x, dom.edges_of(nodes), lambda a, e: nn.gat(a, e, weights, attend))
    return out.select("page_id", "node_id", F.transform("y", lambda v: F.round(v, 6)).alias("y"))


@query()
def lexrank_summaries(spark, sf_dir):
    return graph.summarise(table(spark, sf_dir, "documents"))


@query(f"""with w as (select lower(unnest({_TOK('text')})) as word from documents), c as (select word, count(*) as n from w group by word)
select word, n, row_number() over (order by n desc, word) - 1 as index from c order by n desc, word limit 1000""")  # fmt: skip
def token_vocab_topk(spark, sf_dir):
    return blocks.vocabulary(table(spark, sf_dir, "documents"), text.tokens(F.col("text")), 1000)


@query("select lang, quality, count(*) as n from documents join labels using (doc_id) group by all")
def class_histogram(spark, sf_dir):
    return table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id").groupBy("lang", "quality").agg(F.count("*").alias("n"))


@query("""with v as (select source, n_chars % 3 as vote, count(*) as n from documents group by all)
select source, arg_max(vote, n * 10 - vote) as winner, max(n) as votes from v group by source""")  # fmt: skip
def majority_vote(spark, sf_dir):
    return scoring.majority_vote(table(spark, sf_dir, "documents").select("source", (F.col("n_chars") % 3).alias("vote")), "source", "vote")


@query("""with f as (select doc_id % 5 as fold, avg(quality) as m from labels group by all) select round(avg(m), 6) as mean, round(stddev_pop(m), 6) as std, count(*) as folds from f""")
def kfold_mean_std(spark, sf_dir):
    rows = table(spark, sf_dir, "labels").select((F.col("doc_id") % 5).alias("fold"), "quality")
    return _rounded(scoring.fold_summary(rows, "fold", "quality"), "mean", "std")


_SCORED = "with s as (select quality, (doc_id * 37 % 101) / 101.0::double as score from labels)"
_PRF = """, r as (select *, case when tp + fp > 0 then tp / (tp + fp) else 0 end as p, case when tp + fn > 0 then tp / (tp + fn) else 0 end as r from n)"""


@query(f"""{_SCORED}, n as (select t as threshold, count(*) filter (score > t and quality = 1) as tp, count(*) filter (score > t and quality <> 1) as fp, count(*) filter (not score > t and quality = 1) as fn
  from s, (select unnest([0.2, 0.5, 0.8])::double as t) group by t){_PRF}
select threshold, tp, fp, fn, round(p, 6) as precision, round(r, 6) as recall, round(case when p + r > 0 then 2 * p * r / (p + r) else 0 end, 6) as f1 from r""")  # fmt: skip
def f1_thresholds(spark, sf_dir):
    rows = table(spark, sf_dir, "labels").select("quality", (F.col("doc_id") * 37 % 101 / 101.0).alias("score"))
    return _rounded(scoring.threshold_f1(rows, "score", "quality", [0.2, 0.5, 0.8]), "precision", "recall", "f1")


@query(f"{_SCORED} select count(*) filter (score >= 0.5 and quality = 1) as tp, count(*) filter (score >= 0.5 and quality <> 1) as fp, count(*) filter (score < 0.5 and quality = 1) as fn from s")
def node_confusion(spark, sf_dir):
    rows = table(spark, sf_dir, "labels").select("quality", (F.col("doc_id") * 37 % 101 / 101.0).alias("score"))
    return scoring.node_confusion(rows, "score", "quality", 0.5)


@query(f"""with s as (select quality as t, (doc_id % 3 <> 0)::int as p from labels),
n as (select count(*) filter (p = t) / count(*) as accuracy, count(*) filter (p = 1 and t = 1) as tp, count(*) filter (p = 1 and t <> 1) as fp, count(*) filter (p <> 1 and t = 1) as fn from s){_PRF}
select round(accuracy, 6) as accuracy, round(p, 6) as precision, round(r, 6) as recall, round(case when p + r > 0 then 2 * p * r / (p + r) else 0 end, 6) as f1 from r""")  # fmt: skip
def block_accuracy(spark, sf_dir):
    rows = table(spark, sf_dir, "labels").select("quality", (F.col("doc_id") % 3 != 0).cast("int").alias("p"))
    return _rounded(scoring.accuracy(rows, "p", "quality"), "accuracy", "precision", "recall", "f1")


@query("with e as (select doc_id % 30 as epoch, round(avg(quality), 6) as m from labels group by all) select min(epoch) filter (m = (select max(m) from e)) as epoch, max(m) as metric from e")
def best_epoch(spark, sf_dir):
    rows = table(spark, sf_dir, "labels").groupBy((F.col("doc_id") % 30).alias("epoch")).agg(F.round(F.avg("quality"), 6).alias("m"))
    return scoring.best_epoch(rows, "epoch", "m")


@query()
def node_features(spark, sf_dir):
    """The whole feature vector of every node, by its length, sum and largest entry."""
    p = features.FeatureParams(text_dim=32, class_dim=16, positions=16)
    found = features.node_features(table(spark, sf_dir, "pages"), p)
    return found.select("page_id", "node_id", F.size("features").alias("n"), F.round(F.aggregate("features", F.lit(0.0), lambda s, x: s + x), 5).alias("total"), F.round(F.array_max("features"), 5).alias("largest"))


@query(f"""{page_sql.TREE}, s as (select page_id, regexp_extract(html, '<style>p\\{{(.*?)\\}}</style>', 1) as style from pages)
select page_id, node_id::int as node_id, style from nodes join s using (page_id) where tag = 'p' and style <> ''""")
def inlined_styles(spark, sf_dir):
    return features.inlined_styles(table(spark, sf_dir, "pages"))


@query()
def genre_folds(spark, sf_dir):
    """Pages classified by their declared language from hashed words, in three folds: mean and deviation."""
    pages = table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("html", 'lang="([a-z]+)"', 1).alias("lang"), text.strip_markup(F.col("html")).alias("body"))
    label = F.coalesce(F.array_position(F.array(F.lit("de"), F.lit("en"), F.lit("es"), F.lit("fr")), F.col("lang")), F.lit(0))
    rows = models.counts_of(pages.withColumn("label", label), ["page_id", "label"], text.tokens(F.lower("body")), 512)
    judged = models.cross_validate(rows, "page_id", "label")
    return _rounded(scoring.fold_summary(judged.withColumn("right", (F.col("label") == F.col("prediction")).cast("int")), "fold", "right"), "mean", "std")


@query()
def leaf_classifier(spark, sf_dir):
    """Leaf texts judged content or not from hashed words and tags, learned from node labels."""
    labels = checkpoint(_labelled(spark, sf_dir))
    truth = labels.where("label <> 'other'").select("page_id", "node_id", (F.col("label") == "content").cast("int").alias("label"))
    rows = checkpoint(models.leaf_features(_blocks(spark, sf_dir)).join(truth, ["page_id", "node_id"]))
    scored = models.train_logistic(rows.select("features", F.col("label").cast("double").alias("label"))).transform(rows.drop("label")).join(truth, ["page_id", "node_id"])
    return _rounded(scoring.accuracy(scored.withColumn("prediction", F.col("prediction").cast("int")), "prediction", "label"), "accuracy", "precision", "recall", "f1")


@query("""with s as (select vec_id, label, list_transform(embedding, lambda x: x::double) as v from embeddings),
c as (select vec_id, label, unnest(range(len(v))) as i, unnest(v) as x from s),
r as (select *, row_number() over (partition by vec_id order by x desc, i) <= 2 as yes, i = label % 64 as real from c),
n as (select count(*) filter (where yes and real) as tp, count(*) filter (where yes and not real) as fp, count(*) filter (where not yes and real) as fn from r)
select tp, fp, fn, round(coalesce(tp / nullif(tp + fp, 0), 0), 6) as precision, round(coalesce(tp / nullif(tp + fn, 0), 0), 6) as recall, round(coalesce(2.0::double * tp / nullif(2 * tp + fp + fn, 0), 0), 6) as f1 from n""")  # fmt: skip
def topk_class_f1(spark, sf_dir):
    """Of class scores (all places of a vector), the two best count as predicted."""
    rows = table(spark, sf_dir, "embeddings").select(F.transform("embedding", lambda x: x.cast("double")).alias("scores"), (F.col("label") % 64).alias("truth"))
    return _rounded(scoring.class_confusion(rows, "scores", "truth", top_k=2), "precision", "recall", "f1")


@query("""with c as (select label % 64 = i as real, embedding[i + 1]::double > 0.1 as yes, i from embeddings, range(64) t(i) where i = 1),
n as (select count(*) filter (where yes and real) as tp, count(*) filter (where yes and not real) as fp, count(*) filter (where not yes and real) as fn from c)
select tp, fp, fn, round(coalesce(tp / nullif(tp + fp, 0), 0), 6) as precision, round(coalesce(tp / nullif(tp + fn, 0), 0), 6) as recall, round(coalesce(2.0::double * tp / nullif(2 * tp + fp + fn, 0), 0), 6) as f1 from n""")  # fmt: skip
def one_class_f1(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").select(F.transform("embedding", lambda x: x.cast("double")).alias("scores"), (F.col("label") % 64).alias("truth"))
    return _rounded(scoring.class_confusion(rows, "scores", "truth", class_id=1, threshold=0.1), "precision", "recall", "f1")


@query("""with l as (select l_orderkey as k, l_linenumber as p, (l_returnflag = 'R')::int as y, (l_quantity > 25)::int as g from lineitem)
select round(avg((2 * a.y + b.y = 2 * a.g + b.g)::int), 6) as accuracy, count(*) as n from l a join l b on a.k = b.k and b.p = a.p + 1""")
def edge_accuracy(spark, sf_dir):
    """Neighbouring lines of an order as edges of four classes: guessed by quantity, true by return flag."""
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").cast("long").alias("p"), (F.col("l_returnflag") == "R").cast("int").alias("y"), (F.col("l_quantity") > 25).cast("int").alias("g"))
    return _rounded(scoring.class_accuracy(scoring.edge_classes(rows, "k", "p", ["y", "g"]), "g", "y"), "accuracy")


@query("select distinct l_linenumber::bigint as fold from lineitem where l_linenumber in (select o_orderkey % 9 from orders)")
def common_folds(spark, sf_dir):
    weights = table(spark, sf_dir, "orders").select((F.col("o_orderkey") % 9).cast("long").alias("fold"))
    return scoring.common_folds(table(spark, sf_dir, "lineitem").select(F.col("l_linenumber").cast("long").alias("fold")), weights, "fold")


@query("select l_orderkey, l_linenumber, count(*) over (partition by l_orderkey) as n_in_group from lineitem qualify n_in_group >= 2")
def least_blocks(spark, sf_dir):
    """Documents of at least two blocks: orders stand for documents, lines for blocks."""
    return crawl.group_gate(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber"), ["l_orderkey"], 2)
