"""Queries over the corpus tables: edge layers, their merge, nodes, feedback and text."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from energraph.config import LAYERS, EntityEdgeConfig, LayerWeights, LearnedLayerConfig, MassConfig, NLICandidateConfig, StructuralEdgeConfig
from energraph.functions.text import BREAK, DIGIT, collapse, first_sentence, normal_entities, parse_answer, parse_listing, parse_subqueries, passage_of, strip
from energraph.operators import edges as eb
from energraph.operators import graph as gr
from energraph.operators.corpus import composed_text, parse_hops, pool_paragraphs
from energraph.operators.evaluation import passages_at_k
from energraph.operators.feedback import reinforce_runs
from energraph.operators.search import atom_search as search_atoms
from energraph.sources.index import cached_completions
from energraph.sources.tables import table


def _r(c: str, digits: int = 6):
    return F.round(c, digits).alias(c)


def refs(spark: SparkSession, folder: str) -> DataFrame:
    """Passages as positions of their source; a redelivered passage counts once."""
    return table(spark, folder, "passages").select(F.col("chunk_id").alias("id"), "source_id", F.col("pos").alias("position"), "section_id").distinct()


def one_per_node(spark: SparkSession, folder: str) -> DataFrame:
    """(node_id, entities): one delivery of each node, names normalised."""
    e = table(spark, folder, "entities").where("node_id IS NOT NULL").groupBy("node_id").agg(F.max(F.struct("loaded_at", "entities")).alias("e"))
    return e.select("node_id", normal_entities("e.entities").alias("entities"))


def structural_edges(spark, folder):
    return eb.structural_edges(refs(spark, folder)).select("u", "v", _r("w"))


def structural_edges_clique(spark, folder):
    """Nations of one region as one document; every pair counts."""
    n, r = table(spark, folder, "nation"), table(spark, folder, "region")
    rows = n.join(r, n.n_regionkey == r.r_regionkey).select(F.col("n_name").alias("id"), F.col("r_name").alias("source_id"), F.col("n_nationkey").alias("position"), F.lit(None).cast("string").alias("section_id"))
    return eb.structural_edges(rows, StructuralEdgeConfig(1.0, 0.6, 0.2)).select("u", "v", _r("w"))


def entity_edges(spark, folder):
    return eb.entity_edges(one_per_node(spark, folder), EntityEdgeConfig(), 6)


def entity_members(spark, folder):
    return eb.entity_members(one_per_node(spark, folder))


def entity_edges_orders(spark, folder):
    """Orders that share a part."""
    o = table(spark, folder, "lineitem").groupBy(F.format_string("o%09d", "l_orderkey").alias("node_id")).agg(F.collect_set(F.format_string("p%07d", "l_partkey")).alias("entities"))
    return eb.entity_edges(o, EntityEdgeConfig(0.02), 6)


def edge_labels(spark, folder):
    return eb.entity_labels(one_per_node(spark, folder))


def derivation_edges(spark, folder):
    return eb.derivation_edges(table(spark, folder, "propositions")).distinct()


def negative_edges(spark, folder):
    return eb.negative_adjacency(table(spark, folder, "negative_edges")).select("a", "b", _r("strength"))


def _contradictions(spark, folder) -> DataFrame:
    """Negative edges as edges of a graph, in the order of their numbers."""
    e = table(spark, folder, "negative_edges").where("source <> '' AND target <> '' AND strength IS NOT NULL").distinct()
    return e.select(F.col("source").alias("u"), F.col("target").alias("v"), F.col("strength").alias("w"), F.col("edge_id").alias("ord"))


def graph_last_wins(spark, folder):
    return gr.from_edges(_contradictions(spark, folder)).select("src", "dst", _r("w"))


def graph_directed(spark, folder):
    return gr.from_edges(_contradictions(spark, folder), directed=True).select("src", "dst", _r("w"))


def _layers(spark, folder, on=LAYERS) -> DataFrame:
    """The corpus' edges of the layers in ``on``; no other layer is computed."""
    made = {
        "structural": lambda: eb.structural_edges(refs(spark, folder)),
        "entity": lambda: eb.entity_edges(one_per_node(spark, folder), EntityEdgeConfig()),
        "derivation": lambda: eb.derivation_edges(table(spark, folder, "propositions")).distinct(),
    }
    every = spark.createDataFrame([], "layer string, u string, v string, w double")
    for name, make in made.items():
        if name in on:
            every = every.unionByName(make().select(F.lit(name).alias("layer"), "u", "v", "w"))
    return every.withColumn("ord", F.lit(0).cast("long"))


def merge_layers(spark, folder):
    """The pairs of the entity layer are merged with the other layers where they are made."""
    return gr.from_layers_and_members(_layers(spark, folder, ("structural", "derivation")), eb.membership(one_per_node(spark, folder)), digits=6)


def merge_layers_disabled(spark, folder):
    weights = LayerWeights(entity=0.0)
    return gr.from_layers(_layers(spark, folder, weights.enabled()), weights).select("src", "dst", _r("w"))


def layer_of_edge(spark, folder):
    return gr.dominant_layer_with_members(_layers(spark, folder, ("structural", "derivation")), eb.membership(one_per_node(spark, folder)))


def layer_counts(spark, folder):
    """The pairs of the entity layer are counted where they are made, the other layers by their rows."""
    n = eb.count_entity_edges(one_per_node(spark, folder)).select(F.lit("entity").alias("layer"), "n")
    return gr.layer_counts(_layers(spark, folder, ("structural", "derivation")), n)


def node_masses(spark, folder):
    n = table(spark, folder, "nodes").groupBy("id").agg(F.max(F.struct("created_at", "layer", "length")).alias("n")).select("id", "n.layer", "n.length")
    return gr.node_masses(n, MassConfig(enabled=True)).select("node", _r("mass"))


def _texts(spark, folder):
    return table(spark, folder, "propositions").groupBy("id").agg(F.max("text").alias("text"))


def nli_subject_pairs(spark, folder):
    """Entity-sharing propositions that name a rare shared entity in their first characters."""
    return eb.subject_pairs(_texts(spark, folder), one_per_node(spark, folder), NLICandidateConfig())


def nli_candidates(spark, folder):
    """Near propositions that name a rare shared entity in their first characters."""
    p = _texts(spark, folder)
    v = table(spark, folder, "vectors").where(F.exists("embedding", lambda x: x != 0)).groupBy("id").agg(F.max("embedding").alias("embedding")).join(p.select("id"), "id", "left_semi")
    return eb.nli_candidates(v, p, one_per_node(spark, folder)).select("a", "b", _r("similarity"))


def passage_fold(spark, folder):
    """The first 5 passages behind each question's gold, bridge gold first."""
    q = table(spark, folder, "questions").where("gold_ids IS NOT NULL").select("id", "gold_ids", "bridge_gold_ids").distinct()
    ranking = F.concat(F.coalesce("bridge_gold_ids", F.array().cast("array<string>")), "gold_ids")
    return q.select("id", F.array_join(passages_at_k(F.filter(ranking, lambda x: x.isNotNull()), 5), ",").alias("passages")).distinct()


def question_hops(spark, folder):
    return table(spark, folder, "questions").select("id", parse_hops(F.col("id")).alias("hops")).distinct()


def pooled_passages(spark, folder):
    p = table(spark, folder, "passages").select(F.coalesce("title", F.lit("")).alias("title"), F.coalesce("text", F.lit("")).alias("text"))
    return pool_paragraphs(p).select("doc", "chunk_id", F.md5(composed_text(F.col("title"), F.col("text"))).alias("digest"))


def chunk_documents(spark, folder):
    """Every line of a document as a unit; a blank line begins a section."""
    lines = table(spark, folder, "documents").where("text IS NOT NULL").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line", "unit"))
    blank = strip(F.col("unit")) == ""
    section = F.sum(blank.cast("int")).over(Window.partitionBy("doc_id").orderBy("line"))
    units = lines.withColumn("section", section).where(~blank)
    docs = units.groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("line", "unit", "section"))), lambda u: F.struct(u["unit"].alias("text"), u["section"].cast("string").alias("section_id"))).alias("units"))
    from energraph.operators.corpus import chunk_documents as chunks

    out = chunks(docs.select(F.format_string("doc%07d", "doc_id").alias("source_id"), "units"))
    return out.select("id", "source_id", "position", "section_id", "length")


def parse_listings(spark, folder):
    d = table(spark, folder, "documents").where("kind = 'listing' AND text IS NOT NULL")
    return d.select("doc_id", F.posexplode(parse_listing(F.col("text"))).alias("n", "item"))


def subqueries(spark, folder):
    d = table(spark, folder, "documents").where("kind = 'trace' AND text IS NOT NULL")
    return d.select("doc_id", F.posexplode(parse_subqueries(F.col("text"), F.lit("?"), 4)).alias("n", "subquery"))


def parse_answers(spark, folder):
    """Every trace read as a reply that should be an answer of a few words."""
    d = table(spark, folder, "documents").where("kind = 'trace' AND text IS NOT NULL")
    return d.select("doc_id", parse_answer(F.col("text")).alias("answer"))


def first_sentences(spark, folder):
    d = table(spark, folder, "documents").where("text IS NOT NULL")
    return d.select("doc_id", first_sentence(F.col("text")).alias("sentence"))


def atom_search(spark, folder):
    p = table(spark, folder, "passages").select(F.col("chunk_id").alias("id"), "title", F.coalesce("text", F.lit("")).alias("text")).distinct()
    return search_atoms(p.withColumn("ord", F.col("id")), "lake", 20)


def prompt_cache(spark, folder):
    """Questions of even batches are cached; the others are answered once each by their length."""
    q = table(spark, folder, "questions").where("question IS NOT NULL")
    cache = q.where("batch % 2 = 0").select(F.sha2("question", 256).alias("key"), F.lit("cached").alias("response")).distinct()
    answers, _ = cached_completions(q.select(F.col("question").alias("prompt")).distinct(), cache, lambda m: m.withColumn("response", F.char_length("prompt").cast("string")))
    return answers.select("key", "response")


def normal_names(spark, folder):
    return one_per_node(spark, folder).select("node_id", F.size("entities").alias("n"), F.array_join(F.array_sort("entities"), "|").alias("names"))


def collapsed_titles(spark, folder):
    return table(spark, folder, "passages").select("chunk_id", collapse(F.col("title")).alias("title")).distinct()


#: What one use of a pair adds to its evidence; the most used pairs reach the maximum strength.
GAIN = 0.05


def _event_pairs(spark, folder) -> DataFrame:
    """Consecutive event types of a user as used pairs; the days are the runs."""
    by = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = table(spark, folder, "events").select("event_id", "user_id", "ts", "event_type").withColumn("before", F.lag("event_type").over(by)).where("before IS NOT NULL AND before <> event_type")
    first = e.agg(F.min(F.to_date("ts"))).first()[0]
    return e.select(F.datediff(F.to_date("ts"), F.lit(first)).cast("bigint").alias("run"), F.least("before", "event_type").alias("u"), F.greatest("before", "event_type").alias("v"), F.lit(GAIN).alias("gain"))


def learned_layer(spark, folder):
    return reinforce_runs(_event_pairs(spark, folder), LearnedLayerConfig()).select("u", "v", _r("strength"))


def prune_layers(spark, folder):
    """Structural edges that no negative edge ever touched go."""
    st = eb.structural_edges(refs(spark, folder)).select(F.lit("structural").alias("layer"), "u", "v", "w")
    touched = eb.negative_adjacency(table(spark, folder, "negative_edges")).select(F.explode(F.array("a", "b")).alias("id")).distinct()
    usage = st.join(touched, st.u == touched.id, "left_semi").select("u", "v", F.lit(1).alias("n"))
    keep, gone = eb.prune_layers(st, usage, 100)
    return keep.withColumn("kept", F.lit(True)).unionByName(gone.withColumn("kept", F.lit(False))).select("u", "v", "kept")


_WC = r"[\s\x0B\x1C-\x1F\x{85}\p{Z}]"
_W = _WC + "+"
_LINES = re.sub(r"\\(?:x|u)([0-9A-F]{2,4})", r"\\x{\1}", BREAK)


def sql_strip(c: str) -> str:
    return f"regexp_replace({c}, '^{_W}|{_W}$', '', 'g')"


def sql_fold(c: str) -> str:
    """Full case folding: lower case, then every character that it leaves and folding changes."""
    rest = {x: x.casefold() for x in map(chr, (*range(0xD800), *range(0xE000, 0x110000))) if x.lower() == x != x.casefold()}
    c = f"lower({c})"
    for x, y in rest.items():
        if len(y) > 1:
            c = f"replace({c}, '{x}', '{y}')"
    short = {x: y for x, y in rest.items() if len(y) == 1}
    return f"translate({c}, '{''.join(short)}', '{''.join(short.values())}')"


def sql_lines(text: str, where: str) -> str:
    """(doc_id, n, l): the stripped lines of the documents."""
    lines = f"regexp_split_to_array({text}, '{_LINES}')"
    return f"l AS (SELECT doc_id, n, {sql_strip('r')} AS l, r FROM (SELECT doc_id, unnest({lines}) AS r, generate_subscripts({lines}, 1) AS n FROM documents WHERE {where} text IS NOT NULL))"


_REFS = "refs AS (SELECT DISTINCT chunk_id AS id, source_id, pos, section_id FROM passages)"
_STRUCT = _REFS + """, rel AS (
  SELECT id AS a, lead(id) OVER (PARTITION BY source_id ORDER BY pos) AS b, 1e0 AS w FROM refs
  UNION ALL SELECT x.id, y.id, 0.6e0 FROM refs x JOIN refs y ON x.source_id = y.source_id AND x.section_id = y.section_id AND x.id < y.id),
st AS (SELECT least(a, b) AS u, greatest(a, b) AS v, max(w) AS w FROM rel WHERE b IS NOT NULL GROUP BY 1, 2)"""
_NAMES = f"""own AS (SELECT node_id, arg_max(coalesce(entities, []), loaded_at) AS entities FROM entities WHERE node_id IS NOT NULL GROUP BY 1),
said AS (SELECT DISTINCT node_id, {sql_fold(f"trim(regexp_replace(e, '{_W}', ' ', 'g'))")} AS entity FROM (SELECT node_id, unnest(entities) AS e FROM own) WHERE e IS NOT NULL),
ment AS (SELECT * FROM said WHERE entity <> '')"""
_ENT = _NAMES + """, freq AS (SELECT entity, count(*) AS df FROM ment GROUP BY 1 HAVING count(*) >= 2 AND count(*) <= 0.02e0 * (SELECT count(*) FROM own)),
en AS (SELECT a.node_id AS u, b.node_id AS v, sum(1e0 / f.df) AS w FROM ment a JOIN freq f USING (entity) JOIN ment b ON b.entity = a.entity AND a.node_id < b.node_id GROUP BY 1, 2)"""
_DER = "de AS (SELECT DISTINCT chunk_id AS u, id AS v, 1e0 AS w FROM propositions WHERE chunk_id IS NOT NULL)"
_ALL = f"WITH {_STRUCT}, {_ENT}, {_DER}, every AS (SELECT 'structural' AS layer, u, v, w, 2 AS place FROM st UNION ALL SELECT 'entity', u, v, w, 1 FROM en UNION ALL SELECT 'derivation', least(u, v), greatest(u, v), w, 3 FROM de)"


def _merged(weights: str) -> str:
    return _ALL + f", m AS (SELECT u, v, sum(w * f) AS w FROM every JOIN (VALUES {weights}) AS t(layer, f) USING (layer) GROUP BY 1, 2) SELECT u AS src, v AS dst, round(w, 6) AS w FROM m UNION ALL SELECT v, u, round(w, 6) FROM m WHERE u <> v"


_PAIRS = """WITH e AS (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS b FROM events),
pairs AS (SELECT CAST(date_diff('day', (SELECT min(CAST(ts AS DATE)) FROM e WHERE b IS NOT NULL AND b <> event_type), CAST(ts AS DATE)) AS BIGINT) AS run, least(b, event_type) AS u, greatest(b, event_type) AS v FROM e WHERE b IS NOT NULL AND b <> event_type)"""
_ITEM = sql_strip(f"CASE WHEN regexp_matches(l, '^[-*+] ') THEN substr(l, 3) ELSE regexp_replace(l, '^{DIGIT}+\\. ', '') END")
_DROPPED = f"regexp_replace(r, '^{_WC}*(?:[-*•]|\\p{{Nd}}+[.)]){_WC}*', '')"

_LISTING, _TRACE = "kind = 'listing' AND", "kind = 'trace' AND"

QUERIES = {
    f.__name__: f
    for f in (
        structural_edges, structural_edges_clique, entity_edges, entity_edges_orders, edge_labels, derivation_edges, negative_edges, merge_layers, merge_layers_disabled, layer_of_edge, layer_counts,
        entity_members, graph_last_wins, graph_directed, node_masses, nli_subject_pairs, nli_candidates, passage_fold, question_hops, pooled_passages, chunk_documents, parse_listings, subqueries, parse_answers,
        first_sentences, atom_search, prompt_cache, normal_names, collapsed_titles, learned_layer, prune_layers,
    )
}

SQL = {
    "structural_edges": f"WITH {_STRUCT} SELECT u, v, round(w, 6) AS w FROM st",
    "structural_edges_clique": "WITH r AS (SELECT n_name AS id, r_name AS d, n_nationkey AS pos FROM nation JOIN region ON n_regionkey = r_regionkey), rel AS (SELECT id AS a, lead(id) OVER (PARTITION BY d ORDER BY pos) AS b, 1e0 AS w FROM r UNION ALL SELECT x.id, y.id, 0.2e0 FROM r x JOIN r y ON x.d = y.d AND x.id < y.id) SELECT least(a, b) AS u, greatest(a, b) AS v, max(w) AS w FROM rel WHERE b IS NOT NULL GROUP BY 1, 2",
    "entity_edges": f"WITH {_ENT} SELECT u, v, round(w, 6) AS w FROM en",
    "entity_edges_orders": "WITH m AS (SELECT DISTINCT printf('o%09d', l_orderkey) AS n, l_partkey AS e FROM lineitem), f AS (SELECT e, count(*) AS df FROM m GROUP BY 1 HAVING count(*) >= 2 AND count(*) <= 0.02e0 * (SELECT count(DISTINCT n) FROM m)) SELECT a.n AS u, b.n AS v, round(sum(1e0 / f.df), 6) AS w FROM m a JOIN f USING (e) JOIN m b ON b.e = a.e AND a.n < b.n GROUP BY 1, 2",
    "edge_labels": f"WITH {_ENT}, c AS (SELECT entity, count(*) AS df FROM ment GROUP BY 1) SELECT en.u, en.v, arg_min(a.entity, (c.df, a.entity)) AS label FROM en JOIN ment a ON a.node_id = en.u JOIN ment b ON b.node_id = en.v AND b.entity = a.entity JOIN c ON c.entity = a.entity GROUP BY 1, 2",
    "entity_members": f"WITH {_ENT} SELECT entity, node_id, df FROM ment JOIN freq USING (entity)",
    "graph_last_wins": "WITH e AS (SELECT DISTINCT edge_id, least(source, target) AS u, greatest(source, target) AS v, strength FROM negative_edges WHERE source <> '' AND target <> '' AND strength IS NOT NULL), w AS (SELECT u, v, round(arg_max(strength, edge_id), 6) AS w FROM e GROUP BY 1, 2) SELECT u AS src, v AS dst, w FROM w UNION ALL SELECT v, u, w FROM w WHERE u <> v",
    "graph_directed": "SELECT source AS src, target AS dst, round(arg_max(strength, edge_id), 6) AS w FROM negative_edges WHERE source <> '' AND target <> '' AND strength IS NOT NULL GROUP BY 1, 2",
    "derivation_edges": f"WITH {_DER} SELECT * FROM de",
    "negative_edges": "SELECT least(source, target) AS a, greatest(source, target) AS b, round(max(strength), 6) AS strength FROM negative_edges WHERE source <> '' AND target <> '' AND source <> target AND strength > 0 GROUP BY 1, 2",
    "merge_layers": _merged("('entity', 1e0), ('structural', 0.3e0), ('derivation', 1e0)"),
    "merge_layers_disabled": _merged("('structural', 0.3e0), ('derivation', 1e0)"),
    "layer_of_edge": _ALL + ", c AS (SELECT u, v, layer, place, max(w) * CASE layer WHEN 'structural' THEN 0.3e0 ELSE 1e0 END AS x FROM every GROUP BY 1, 2, 3, 4) SELECT u, v, arg_max(layer, (x, -place)) AS layer FROM c GROUP BY 1, 2",
    "layer_counts": _ALL + " SELECT l.layer, count(e.u) AS n_edges FROM (VALUES ('semantic'), ('entity'), ('structural'), ('derivation'), ('learned')) AS l(layer) LEFT JOIN every e USING (layer) GROUP BY 1",
    "node_masses": "WITH n AS (SELECT id, max(struct_pack(c := created_at, layer := layer, length := length)) AS n FROM nodes GROUP BY 1), x AS (SELECT id, n.layer AS layer, n.length AS length FROM n) SELECT id AS node, round(least(2e0, greatest(0.5e0, length / avg(length) OVER (PARTITION BY layer))), 6) AS mass FROM x",
    "nli_subject_pairs": f"WITH {_ENT}, p AS (SELECT id, max(text) AS text FROM propositions GROUP BY 1), rare AS (SELECT entity FROM ment GROUP BY 1 HAVING count(*) <= 0.005e0 * (SELECT count(*) FROM own)), subj AS (SELECT m.node_id, m.entity FROM ment m JOIN rare USING (entity) JOIN p ON p.id = m.node_id WHERE contains({sql_fold('substr(p.text, 1, 40)')}, m.entity)) SELECT DISTINCT en.u AS a, en.v AS b FROM en JOIN subj a ON a.node_id = en.u JOIN subj b ON b.node_id = en.v AND b.entity = a.entity",
    "passage_fold": "WITH q AS (SELECT DISTINCT id, list_filter(list_concat(coalesce(bridge_gold_ids, []), gold_ids), lambda x: x IS NOT NULL) AS r FROM questions WHERE gold_ids IS NOT NULL), e AS (SELECT id, r, unnest(list_transform(r, lambda x: split_part(x, '#', 1))) AS p, generate_subscripts(r, 1) AS n FROM q), f AS (SELECT id, r, p, min(n) AS n FROM e GROUP BY 1, 2, 3), k AS (SELECT *, row_number() OVER (PARTITION BY id, r ORDER BY n) AS place FROM f) SELECT DISTINCT q.id, coalesce((SELECT string_agg(p, ',' ORDER BY n) FROM k WHERE k.id = q.id AND k.r = q.r AND place <= 5), '') AS passages FROM q",
    "question_hops": r"SELECT DISTINCT id, CAST(regexp_extract(id, '^(\d+)hop', 1) AS INTEGER) AS hops FROM questions",
    "pooled_passages": "WITH p AS (SELECT DISTINCT coalesce(title, '') AS title, coalesce(text, '') AS text FROM passages), n AS (SELECT *, row_number() OVER (ORDER BY title, text) - 1 AS n FROM p) SELECT printf('d%05d', n) AS doc, printf('d%05d', n) || ':0' AS chunk_id, md5(title || chr(10) || text) AS digest FROM n",
    "chunk_documents": f"WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS u, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM documents WHERE text IS NOT NULL), s AS (SELECT *, sum(CASE WHEN {sql_strip('u')} = '' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY n) AS s FROM l), k AS (SELECT *, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY n) - 1 AS INTEGER) AS position FROM s WHERE {sql_strip('u')} <> '') SELECT printf('doc%07d', doc_id) || ':' || position AS id, printf('doc%07d', doc_id) AS source_id, position, CAST(s AS VARCHAR) AS section_id, CAST(length(u) AS INTEGER) AS length FROM k",
    "parse_listings": f"WITH {sql_lines('text', _LISTING)}, i AS (SELECT doc_id, n, {_ITEM} AS item FROM l) SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY n) - 1 AS INTEGER) AS n, item FROM i WHERE item <> ''",
    "subqueries": f"WITH {sql_lines('text', _TRACE)}, t AS (SELECT doc_id, n, {sql_strip(_DROPPED)} AS x FROM l), k AS (SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY n) - 1 AS INTEGER) AS n, x FROM t WHERE x <> '' AND NOT regexp_matches(lower(x), '^(?:query|queries|here)')) SELECT doc_id, n, x AS subquery FROM k WHERE n < 4 UNION ALL SELECT doc_id, 0, '?' FROM documents WHERE kind = 'trace' AND text IS NOT NULL AND doc_id NOT IN (SELECT doc_id FROM k)",
    "parse_answers": f"WITH {sql_lines(sql_strip('text'), _TRACE)}, a AS (SELECT doc_id, arg_min(l, n) AS l FROM l GROUP BY 1) SELECT doc_id, CASE WHEN starts_with(upper(l), 'NONE') THEN '' ELSE array_to_string(list_filter(regexp_split_to_array(l, '{_W}'), lambda w: w <> '')[1:10], ' ') END AS answer FROM a",
    "first_sentences": f"WITH {sql_lines('text', '')}, f AS (SELECT d.doc_id, coalesce((SELECT arg_min(l, n) FROM l WHERE l.doc_id = d.doc_id AND l <> ''), '') AS l FROM documents d WHERE text IS NOT NULL) SELECT doc_id, CASE WHEN regexp_matches(l, '[.!?]{_WC}') THEN regexp_extract(l, '^(.*?[.!?]){_WC}', 1) ELSE l END AS sentence FROM f",
    "atom_search": f"WITH p AS (SELECT DISTINCT chunk_id AS id, title, trim(regexp_replace(coalesce(text, ''), '{_W}', ' ', 'g'), ' ') AS x FROM passages) SELECT id, title, CASE WHEN length(x) <= 160 THEN x ELSE rtrim(substr(x, 1, 159), ' ') || '…' END AS snippet FROM p WHERE contains(lower(id), 'lake') OR contains(lower(coalesce(title, '')), 'lake') ORDER BY id LIMIT 20",
    "prompt_cache": "WITH q AS (SELECT DISTINCT question FROM questions WHERE question IS NOT NULL), c AS (SELECT DISTINCT question FROM questions WHERE question IS NOT NULL AND batch % 2 = 0) SELECT sha256(q.question) AS key, CASE WHEN c.question IS NULL THEN CAST(length(q.question) AS VARCHAR) ELSE 'cached' END AS response FROM q LEFT JOIN c USING (question)",
    "normal_names": f"WITH {_NAMES} SELECT o.node_id, CAST(count(m.entity) AS INTEGER) AS n, coalesce(string_agg(m.entity, '|' ORDER BY m.entity), '') AS names FROM own o LEFT JOIN ment m USING (node_id) GROUP BY 1",
    "collapsed_titles": f"SELECT DISTINCT chunk_id, trim(regexp_replace(title, '{_W}', ' ', 'g'), ' ') AS title FROM passages",
    "learned_layer": _PAIRS + f", r AS (SELECT u, v, run, 0.1e0 * {GAIN}e0 * count(*) AS g FROM pairs GROUP BY 1, 2, 3), f AS (SELECT u, v, list_reduce(list_prepend(struct_pack(run := 0::BIGINT, g := 0e0), list(struct_pack(run := run, g := g) ORDER BY run)), lambda a, x: struct_pack(run := x.run, g := least(1e0, a.g * pow(0.99e0, x.run - a.run) + x.g))) AS f FROM r GROUP BY 1, 2) SELECT u, v, round(f.g * pow(0.99e0, (SELECT max(run) FROM pairs) - f.run), 6) AS strength FROM f",
    "prune_layers": f"WITH {_STRUCT}, t AS (SELECT unnest([source, target]) AS id FROM negative_edges WHERE source <> '' AND target <> '' AND source <> target AND strength > 0) SELECT u, v, u IN (SELECT id FROM t) AS kept FROM st",
    "nli_candidates": f"WITH {_NAMES}, p AS (SELECT id, max(text) AS text FROM propositions GROUP BY 1), rare AS (SELECT entity FROM ment GROUP BY 1 HAVING count(*) <= 0.005e0 * (SELECT count(*) FROM own)), subj AS (SELECT m.node_id, m.entity FROM ment m JOIN rare USING (entity) JOIN p ON p.id = m.node_id WHERE contains({sql_fold('substr(p.text, 1, 40)')}, m.entity)), x AS (SELECT id, max(CAST(embedding AS DOUBLE[])) AS e FROM vectors JOIN p USING (id) WHERE list_sum(list_transform(embedding, lambda y: abs(y))) > 0 GROUP BY 1), s AS (SELECT a.id AS a, b.id AS b, list_cosine_similarity(a.e, b.e) AS s FROM x a, x b WHERE a.id <> b.id), near AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY a ORDER BY s DESC, b) <= 5), c AS (SELECT least(a, b) AS a, greatest(a, b) AS b, max(s) AS s FROM near WHERE s > 0.8e0 GROUP BY 1, 2) SELECT a, b, round(s, 6) AS similarity FROM c WHERE EXISTS (SELECT 1 FROM subj x JOIN subj y USING (entity) WHERE x.node_id = c.a AND y.node_id = c.b) ORDER BY s DESC, a, b LIMIT 20000",
}
