"""All queries of the library's own operators: questions about the graph and texts here, drawings and scores beside."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from netloom.functions import geometry as G
from netloom.functions import text as T
from netloom.operators import checks, graph, tools
from netloom.plans import registry
from netloom.plans.registry import query, view, with_views
from netloom.sources import rendering as R

QUERIES, ORACLE_SQL = registry.QUERIES, registry.ORACLE_SQL


def _graph(spark, sf_dir, thin=False) -> tools.Graph:
    return tools.Graph(R.components(spark, sf_dir), R.nets(spark, sf_dir), R.edges(spark, sf_dir, thin))


# ---- questions about the graph

_RAIL = T.RAIL.replace("'", "''")


@query(with_views("edge net", f"""SELECT net, coalesce(name, net) AS net_name, regexp_matches(coalesce(name, net), '{_RAIL}') AS is_rail, count(*) AS num_components
FROM edge JOIN net USING (net) GROUP BY ALL HAVING count(*) >= 2"""))
def nets_summary(spark, sf_dir):
    """Nets that join two components or more, rails first."""
    found = _graph(spark, sf_dir).get_nets_summary(2)
    return found.select("net", "net_name", (F.col("type") == "power rail").alias("is_rail"), "num_components")


view("tool_letters", "comp", "SELECT *, regexp_extract(upper(ref), '^([A-Z]+)', 1) AS l FROM comp")


def _case(expr: str, classes: dict[str, str]) -> str:
    return f"CASE {expr} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in classes.items()) + " END"


_BY_REF = f"coalesce({_case('l', T.TOOL_CLASSES)}, {_case('substr(l, 1, greatest(length(l) - 1, 1))', T.TOOL_CLASSES)}, {_case('substr(l, 1, 1)', T.TOOL_CLASSES)}, 'unknown')"
view("described", "tool_letters", f"SELECT node, ref, class_name, value, ref || ' (' || CASE WHEN class_name IN ('', 'unknown') OR class_name IS NULL THEN {_BY_REF} ELSE class_name END || CASE WHEN coalesce(value, '') IN ('', 'None') THEN '' ELSE ', ' || value END || ')' AS description FROM tool_letters")


@query(with_views("edge", "SELECT a.node, count(DISTINCT b.node) AS n_neighbors, min(b.node) AS first_neighbor FROM edge a JOIN edge b USING (net) WHERE a.node <> b.node GROUP BY a.node"))
def neighbors(spark, sf_dir):
    """Of each component, how many share a net with it, and the first by name."""
    return graph.neighbors(R.edges(spark, sf_dir)).groupBy("node").agg(F.count("*").alias("n_neighbors"), F.min("other").alias("first_neighbor"))


@query(with_views("described edge net", """SELECT c.ref AS component, c.description, (SELECT string_agg(coalesce(name, net), ',' ORDER BY net) FROM net WHERE net IN (SELECT net FROM edge WHERE node = 'p7')) AS nets,
(SELECT string_agg(DISTINCT ref, ',' ORDER BY ref) FROM comp WHERE node <> 'p7' AND node IN (SELECT b.node FROM edge a JOIN edge b USING (net) WHERE a.node = 'p7')) AS components FROM described c WHERE node = 'p7'"""))
def ask_neighbors(spark, sf_dir):
    """What is connected to the component R7, as the tool answers."""
    found = _graph(spark, sf_dir).get_neighbors("r7")
    return found.select(F.upper("component").alias("component"), F.col("component_description").alias("description"), F.array_join("connected_nets", ",").alias("nets"), F.array_join("connected_components", ",").alias("components"))


@query(with_views("edge", """SELECT CASE WHEN EXISTS (SELECT 1 FROM edge a JOIN edge b USING (net) WHERE a.node = 'p7' AND b.node = 'p8') THEN 2
  WHEN EXISTS (SELECT 1 FROM edge a JOIN edge b USING (net) JOIN edge c ON c.node = b.node JOIN edge d ON d.net = c.net WHERE a.node = 'p7' AND d.node = 'p8') THEN 4
  WHEN EXISTS (SELECT 1 FROM (SELECT DISTINCT f.node FROM edge a JOIN edge b USING (net) JOIN edge c ON c.node = b.node JOIN edge f ON f.net = c.net WHERE a.node = 'p7') n JOIN edge g ON g.node = n.node JOIN edge h ON h.net = g.net WHERE h.node = 'p8') THEN 6 END AS length, true AS found"""))
def ask_path(spark, sf_dir):
    """How far apart two components are, by nets and components in turn."""
    e = R.edges(spark, sf_dir).select(F.concat(F.lit("c"), "node").alias("a"), F.concat(F.lit("n"), "net").alias("b"))
    at = lambda k: spark.range(1).select(F.lit(f"cp{k}").alias("node"))
    way = graph.shortest_paths(e, at(7), at(8))
    return way.select(F.col("length").cast("int").alias("length"), (F.size("path") == F.col("length") + 1).alias("found"))


@query(with_views("edge comp", "SELECT net, string_agg(ref || ':' || pin_id, ',' ORDER BY ref, pin_id) AS members, count(*) AS num_components FROM edge JOIN comp USING (node) GROUP BY net"))
def net_components(spark, sf_dir):
    """Each net's components with the pins that join them. A net is one order, so its list is short."""
    e = R.edges(spark, sf_dir).join(R.components(spark, sf_dir).select("node", "ref"), "node")
    m = F.transform(F.array_sort(F.collect_list(F.struct("ref", "pin_id"))), lambda x: F.concat(x["ref"], F.lit(":"), x["pin_id"]))
    return e.groupBy("net").agg(F.array_join(m, ",").alias("members"), F.count("*").alias("num_components"))


@query(with_views("described edge net", f"""SELECT 'o33' AS net, CASE WHEN regexp_matches('o33', '{_RAIL}') THEN 'power rail' ELSE 'signal net' END AS type, string_agg(ref || '/' || pin_id || '/' || description, ';' ORDER BY ref, node) AS components, count(*) AS num_components
FROM edge JOIN described USING (node) WHERE net = 'o33'"""))
def ask_net(spark, sf_dir):
    """The components on one net, as the tool answers."""
    g = _graph(spark, sf_dir)
    found = tools.Graph(g.components, g.nets.withColumn("name", F.lit(None).cast("string")), g.edges).get_net_components("o33")
    return found.select("net", "type", F.array_join(F.transform("components", lambda c: F.concat_ws("/", c["ref"], c["pin"], c["description"])), ";").alias("components"), "num_components")


@query(with_views("described thin_edge", "SELECT node, ref, description FROM described WHERE node NOT IN (SELECT node FROM thin_edge)"))
def isolated_components(spark, sf_dir):
    """Components without a wired pin, in the thin view."""
    return _graph(spark, sf_dir, thin=True).find_isolated()


@query(with_views("edge comp", "SELECT node, ref, value, class_name AS component_type, count(net) AS num_pins, min(net) AS first_net FROM comp LEFT JOIN edge USING (node) GROUP BY node, ref, value, class_name"))
def component_info(spark, sf_dir):
    """Each component with its number of nets."""
    joined = R.components(spark, sf_dir).join(R.edges(spark, sf_dir), "node", "left")
    return joined.groupBy("node", "ref", "value", F.col("class_name").alias("component_type")).agg(F.count("net").alias("num_pins"), F.min("net").alias("first_net"))


@query(with_views("described edge net", "SELECT ref, description, value, class_name AS component_type, (SELECT count(*) FROM edge WHERE node = 'p7') AS num_pins, (SELECT string_agg(coalesce(name, net), ',' ORDER BY net) FROM net WHERE net IN (SELECT net FROM edge WHERE node = 'p7')) AS nets FROM described WHERE node = 'p7'"))
def ask_component(spark, sf_dir):
    """One component, as the tool answers."""
    found = _graph(spark, sf_dir).get_component_info("R7")
    return found.select("ref", "description", "value", "component_type", "num_pins", F.array_join("connected_nets", ",").alias("nets"))


@query(with_views("described", "SELECT node, ref, value, description FROM described WHERE value <> '' AND regexp_matches(value, '(?i)RING$|w.dget')"))
def search_by_value(spark, sf_dir):
    """Components whose value meets a pattern, whatever its case."""
    return _graph(spark, sf_dir).search_by_value("RING$|w.dget")


def _violations(comp: str, pin: str, net: str, edge: str) -> str:
    return f"""SELECT 1 AS place, 'error' AS severity, 'ISOLATED_COMPONENT' AS rule, node AS item FROM {comp} WHERE node NOT IN (SELECT node FROM {edge})
UNION ALL SELECT 2, 'warning', 'FLOATING_PIN', pin_id FROM {pin} WHERE net IS NULL UNION ALL SELECT 3, 'error', 'UNCONNECTED_NET', net FROM {net} WHERE net NOT IN (SELECT net FROM {edge})
UNION ALL SELECT 3, 'warning', 'DANGLING_NET', net FROM {edge} GROUP BY net HAVING count(*) = 1 UNION ALL SELECT 4, 'warning', 'UNNAMED_NET', net FROM {net} WHERE name IS NULL OR name = ''"""


def _checked(spark, sf_dir, thin):
    return checks.violations(R.components(spark, sf_dir), R.pins(spark, sf_dir, thin), R.nets(spark, sf_dir), R.edges(spark, sf_dir, thin))


@query(with_views("comp pin net edge", _violations("comp", "pin", "net", "edge")))
def erc_report(spark, sf_dir):
    """All violations of the rule checks."""
    return _checked(spark, sf_dir, False)


@query(with_views("comp thin net thin_edge", _violations("comp", "thin", "net", "thin_edge")))
def erc_report_thin(spark, sf_dir):
    """The same in the thin view, where components are isolated and pins float."""
    return _checked(spark, sf_dir, True)


@query(with_views("comp thin net thin_edge", f"""SELECT count(*) FILTER (severity = 'error') AS errors, count(*) FILTER (severity = 'warning') AS warnings, count(*) FILTER (severity = 'error') > 0 AS has_errors,
count(*) FILTER (severity = 'error') || ' error(s), ' || count(*) FILTER (severity = 'warning') || ' warning(s)' AS summary FROM ({_violations("comp", "thin", "net", "thin_edge")})"""))
def erc_summary(spark, sf_dir):
    """Errors and warnings of the thin view."""
    return checks.summary(_checked(spark, sf_dir, True))


@query(with_views("thin", "SELECT node, count(*) AS n_floating FROM thin WHERE net IS NULL GROUP BY node"))
def floating_pins(spark, sf_dir):
    """Unwired pins of the thin view by component."""
    return R.pins(spark, sf_dir, thin=True).where("net is null").groupBy("node").agg(F.count("*").alias("n_floating"))


_SCOPE = "SELECT l_suppkey AS page, count(DISTINCT l_partkey) AS c, count(DISTINCT l_orderkey) AS n FROM lineitem GROUP BY 1 UNION ALL SELECT -1, 0, 0 UNION ALL SELECT -2, 8, 517 UNION ALL SELECT -3, 42, 261"


@query(f"""SELECT page, c AS n_components, n AS n_nets, CASE WHEN c = 0 THEN CAST('inf' AS DOUBLE) ELSE round(n / c, 2) END AS ratio, (c > 0 AND n / c <= 8.0) AND c <= 80 AS in_scope,
  CASE WHEN (c > 0 AND n / c <= 8.0) AND c <= 80 THEN 'high' ELSE 'low' END AS confidence,
  CASE WHEN (c > 0 AND n / c <= 8.0) AND c <= 80 THEN 'in supported density envelope' ELSE concat_ws('; ', CASE WHEN c = 0 THEN 'bus-dominated (nets/comp inf > 8.0)' WHEN n / c > 8.0 THEN 'bus-dominated (nets/comp ' || printf('%.1f', n / c) || ' > 8.0)' END,
    CASE WHEN c > 80 THEN 'too large (' || c || ' comps > 80)' END) END AS reason FROM (SELECT page, CAST(c AS DOUBLE) AS cd, c, CAST(n AS BIGINT) AS n FROM ({_SCOPE}))""")
def scope_gate(spark, sf_dir):
    """Whether each supplier's drawing is within scope, and why not; three fixed rows have no component, many nets, and a few too many."""
    n = R.table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("page")).agg(F.count_distinct("l_partkey").alias("n_components"), F.count_distinct("l_orderkey").alias("n_nets"))
    fixed = spark.createDataFrame([(-1, 0, 0), (-2, 8, 517), (-3, 42, 261)], "page long, n_components long, n_nets long")
    return checks.assessed(n.unionByName(fixed))


# ---- texts and classes

_TEXTS = """SELECT o_orderkey AS id, CASE o_orderkey % 9 WHEN 0 THEN 'R' || o_orderkey % 20000 WHEN 1 THEN o_orderkey % 100 || 'k' || o_orderkey % 10 WHEN 2 THEN '+' || o_orderkey % 30 || 'V' WHEN 3 THEN 'SIG_' || o_orderkey
  WHEN 4 THEN 'BC' || o_orderkey % 1000 WHEN 5 THEN ' U' || o_orderkey % 300 || 'A ' WHEN 6 THEN 'a b' WHEN 7 THEN '2N' || o_orderkey % 9000 ELSE o_orderkey % 50 || '.5uF' END AS text FROM orders"""


def _texts(spark, sf_dir):
    o = F.col("o_orderkey")
    kinds = [F.concat(F.lit("R"), o % 20000), F.concat(o % 100, F.lit("k"), o % 10), F.concat(F.lit("+"), o % 30, F.lit("V")), F.concat(F.lit("SIG_"), o), F.concat(F.lit("BC"), o % 1000), F.concat(F.lit(" U"), o % 300, F.lit("A ")), F.lit("a b"), F.concat(F.lit("2N"), o % 9000)]
    text = F.concat(o % 50, F.lit(".5uF"))
    for k, kind in enumerate(kinds):
        text = F.when(o % 9 == k, kind).otherwise(text)
    return R.table(spark, sf_dir, "orders").select(o.alias("id"), text.alias("text"))


_REF, _VALUE, _LABEL = (p.replace("'", "''") for p in (T.REF, T.VALUE, T.LABEL))


@query(f"""SELECT id, r AS is_ref, v AND NOT r AS is_value, NOT r AND NOT v AND length(t) BETWEEN 1 AND 50 AND regexp_matches(t, '{_LABEL}') AS is_label
FROM (SELECT id, trim(text) AS t, regexp_matches(trim(text), '{_REF}') AS r, regexp_matches(trim(text), '{_VALUE}') AS v FROM ({_TEXTS}))""")
def text_predicates(spark, sf_dir):
    """Which texts are designators, values and net labels."""
    t = F.col("text")
    return _texts(spark, sf_dir).select("id", T.is_ref(t).alias("is_ref"), T.is_value(t).alias("is_value"), T.is_net_label(t).alias("is_label"))


@query(with_views("net", f"""SELECT net, coalesce(name, net) AS net_name, regexp_matches(coalesce(name, net), '{_RAIL}') AS is_rail, {' OR '.join(f"contains(upper(coalesce(name, net)), '{p}')" for p in T.POWER)} AS is_power,
  coalesce(name, net) || CASE WHEN regexp_matches(coalesce(name, net), '{_RAIL}') THEN ' (power rail)' ELSE ' (signal net)' END AS description, regexp_matches(coalesce(name, net), '^[0-9]+$') AS is_number FROM net"""))
def net_kinds(spark, sf_dir):
    """Rails by their beginning, power nets by what is anywhere in their name, and how each net is described."""
    n = R.nets(spark, sf_dir).withColumn("net_name", T.net_name(F.col("name"), F.col("net")))
    name = F.col("net_name")
    return n.select("net", "net_name", T.is_rail(name).alias("is_rail"), T.is_power(name).alias("is_power"), T.describe_net(name).alias("description"), name.rlike("^[0-9]+$").alias("is_number"))


@query(with_views("described", "SELECT node, description FROM described"))
def descriptions(spark, sf_dir):
    """One line for each component."""
    return _graph(spark, sf_dir).described().select("node", "description")


@query(f"""SELECT id, ref,
  coalesce({_case('l', T.TOOL_CLASSES)}, {_case('substr(l, 1, greatest(length(l) - 1, 1))', T.TOOL_CLASSES)}, {_case('substr(l, 1, 1)', T.TOOL_CLASSES)}, 'component') AS tool_class,
  coalesce({_case('substr(l, 1, 2)', T.RULE_CLASSES_2)}, {_case('substr(l, 1, 1)', T.RULE_CLASSES_1)}, 'unknown') AS rule_class,
  coalesce({_case('substr(l, 1, 3)', T.DETECTOR_CLASSES)}, {_case('substr(l, 1, 2)', T.DETECTOR_CLASSES)}, {_case('substr(l, 1, 1)', T.DETECTOR_CLASSES)}, 'other') AS detector_class
FROM (SELECT p_partkey AS id, upper(substr(p_type, 1, CAST(1 + p_partkey % 3 AS INT))) || p_partkey % 100 AS ref, regexp_extract(upper(substr(p_type, 1, CAST(1 + p_partkey % 3 AS INT))), '^([A-Z]+)', 1) AS l FROM part)""")
def classify_by_ref(spark, sf_dir):
    """The classes that the three maps give a designator."""
    p = F.col("p_partkey")
    ref = F.concat(F.upper(F.substring(F.col("p_type"), F.lit(1), (1 + p % 3).cast("int"))), p % 100)
    d = R.table(spark, sf_dir, "part").select(p.alias("id"), ref.alias("ref"))
    r = F.col("ref")
    return d.select("id", "ref", T.tool_class(r).alias("tool_class"), T.rule_class(r).alias("rule_class"), T.detector_class(r).alias("detector_class"))


@query("SELECT lang, CAST(sum(length(regexp_replace(coalesce(text, ''), '[ \\t\\n\\r\\f\\v]', '', 'g'))) AS BIGINT) AS n_visible, count(*) AS n, count(*) FILTER (length(regexp_replace(coalesce(text, ''), '[ \\t\\n\\r\\f\\v]', '', 'g')) < 16) AS n_to_recognise FROM documents GROUP BY lang")
def visible_chars(spark, sf_dir):
    """Characters other than white space, which decide whether a page needs its text read from the picture."""
    d = R.table(spark, sf_dir, "documents").withColumn("v", T.visible_characters(F.col("text")))
    return d.groupBy("lang").agg(F.sum("v").alias("n_visible"), F.count("*").alias("n"), F.count_if(F.col("v") < 16).alias("n_to_recognise"))


@query("""SELECT page_id AS doc, CASE WHEN contains(m, 'kicad') THEN 'kicad' WHEN contains(m, 'altium') THEN 'altium' WHEN contains(m, 'eagle') THEN 'eagle' WHEN contains(t, 'Sheet') AND contains(t, 'Date:') AND regexp_matches(t, '[A-Z]\\d{1,4}') THEN 'altium'
  WHEN contains(upper(t), 'KICAD') OR contains(t, '.kicad_sch') THEN 'kicad' ELSE 'unknown' END AS format FROM (SELECT page_id, lower(CASE page_id % 7 WHEN 0 THEN 'KiCad 7' WHEN 1 THEN 'Altium Designer' WHEN 2 THEN 'x' ELSE '' END || CASE page_id % 5 WHEN 0 THEN 'EAGLE' ELSE '' END) AS m,
  CASE page_id % 3 WHEN 0 THEN 'Sheet 1 Date: R' || page_id WHEN 1 THEN 'main.kicad_sch' ELSE coalesce(html, '') END AS t FROM pages)""")
def source_formats(spark, sf_dir):
    """Which program drew a document."""
    from netloom.sources import drawings

    k = F.col("page_id")
    p = R.table(spark, sf_dir, "pages")
    docs = p.select(k.alias("doc"), F.when(k % 7 == 0, "KiCad 7").when(k % 7 == 1, "Altium Designer").when(k % 7 == 2, "x").alias("producer"), F.when(k % 5 == 0, "EAGLE").alias("creator"), F.when(k % 3 == 0, F.concat(F.lit("Sheet 1 Date: R"), k)).when(k % 3 == 1, "main.kicad_sch").otherwise(F.col("html")).alias("first_page"))
    return drawings.formats(docs)


@query("""SELECT id, round(s / 25.4 * 72, 6) AS mm_to_points, round(s / 72 * 25.4, 6) AS points_to_mm, round(s * CAST(0.0254 AS DOUBLE), 6) AS mils_to_mm, round(s / 0.0254, 6) AS mm_to_mils,
  round(s * CAST(0.0254 AS DOUBLE) / 25.4 * 72, 6) AS mils_to_points, round(s / 72 * 25.4 / 0.0254, 6) AS points_to_mils FROM (SELECT p_partkey AS id, CAST(p_size AS DOUBLE) AS s FROM part)""")
def unit_conversions(spark, sf_dir):
    """Millimetres, mils and points."""
    s = F.col("p_size").cast("double")
    return R.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), *(F.round(f(s), 6).alias(f.__name__) for f in (G.mm_to_points, G.points_to_mm, G.mils_to_mm, G.mm_to_mils, G.mils_to_points, G.points_to_mils)))


# ---- graph algorithms


@query(with_views("edge", "SELECT degree, count(*) AS n FROM (SELECT net, count(*) AS degree FROM edge GROUP BY net) GROUP BY degree"))
def degree_histogram(spark, sf_dir):
    """How many nets join how many components."""
    return R.edges(spark, sf_dir).groupBy("net").agg(F.count("*").alias("degree")).groupBy("degree").agg(F.count("*").alias("n"))


view("thin_link", "", "SELECT DISTINCT l_partkey AS a, l_orderkey + 1000000000 AS b FROM lineitem WHERE l_quantity <= 1")
view("thin_both", "thin_link", "SELECT a, b FROM thin_link UNION ALL SELECT b, a FROM thin_link")
view("thin_reach", "thin_both", "SELECT a AS id, a AS root FROM thin_both UNION SELECT l.b, g.root FROM thin_reach g JOIN thin_both l ON l.a = g.id WHERE l.b > g.root")


def _thin_links(spark, sf_dir):
    li = R.table(spark, sf_dir, "lineitem").where("l_quantity <= 1")
    return li.select(F.col("l_partkey").alias("a"), (F.col("l_orderkey") + 1_000_000_000).alias("b")).distinct()


@query(with_views("thin_reach", "SELECT id, min(root) AS component FROM thin_reach GROUP BY id"))
def components_of_graph(spark, sf_dir):
    """Connected components of parts and orders in the thin view, by the rounds that serve graphs of any size."""
    return graph.components(_thin_links(spark, sf_dir))


view("part_order", "", "SELECT DISTINCT l_partkey AS a, l_orderkey + 1000000000 AS b FROM lineitem")
view("part_order_both", "part_order", "SELECT a, b FROM part_order UNION ALL SELECT b, a FROM part_order")


@query(with_views("part_order_both", "SELECT node, min(length) AS length FROM (WITH RECURSIVE r AS (SELECT min(a) AS node, 0 AS length FROM part_order_both UNION SELECT l.b, r.length + 1 FROM r JOIN part_order_both l ON l.a = r.node WHERE r.length < 9) SELECT * FROM r) GROUP BY node"))
def shortest_path(spark, sf_dir):
    """Edges between the first part and every part and order that it reaches."""
    links = R.table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("a"), (F.col("l_orderkey") + 1_000_000_000).alias("b")).distinct()
    return graph.distances(links, links.agg(F.min("a").alias("node")))


# ---- logs


@query("SELECT conv_id, count(*) AS n_messages, count(*) FILTER (role = 'user') AS n_user, max(turn) AS last_turn, CAST(sum(length(coalesce(text, ''))) AS BIGINT) AS n_chars FROM conversations GROUP BY conv_id")
def message_log(spark, sf_dir):
    """Messages of each conversation."""
    c = R.table(spark, sf_dir, "conversations")
    return c.groupBy("conv_id").agg(F.count("*").alias("n_messages"), F.count_if(F.expr("role = 'user'")).alias("n_user"), F.max("turn").alias("last_turn"), F.sum(F.char_length(F.coalesce("text", F.lit("")))).alias("n_chars"))


view("run", "", """SELECT conv_id, list_extract(['get_path', 'find_isolated', 'get_nets_summary'], CAST(conv_id % 3 AS INT) + 1) AS tool, list(list_extract(['get_path', 'find_isolated', 'get_nets_summary', 'get_neighbors'], CAST((conv_id + turn) % 4 AS INT) + 1) ORDER BY turn) AS called,
  string_agg('{"start_ref": "R' || turn || '"}', ' ' ORDER BY turn) AS args, min(CASE WHEN turn = 0 THEN coalesce(text, '') END) AS answer, 'R' || conv_id % 3 AS key, conv_id % 11 = 0 AS maxed FROM conversations GROUP BY conv_id""")


@query(with_views("run", """SELECT conv_id, CAST(CASE WHEN list_contains(called, tool) THEN 2 + CASE WHEN contains(lower(args), lower(key)) THEN 1 ELSE 0 END + CASE WHEN contains(lower(coalesce(answer, '')), 'the') THEN 1 ELSE 0 END ELSE 0 END
  + CASE WHEN NOT maxed AND len(called) <= 9 AND trim(coalesce(answer, '')) <> '' AND NOT contains(lower(coalesce(answer, '')), 'could not answer') THEN 1 ELSE 0 END AS INT) AS score FROM run"""))
def tool_rubric(spark, sf_dir):
    """Scores of answered questions by the tools that were called for them."""
    c = R.table(spark, sf_dir, "conversations")
    names = F.array(*map(F.lit, ("get_path", "find_isolated", "get_nets_summary", "get_neighbors")))
    call = F.struct("turn", F.get(names, ((F.col("conv_id") + F.col("turn")) % 4).cast("int")).alias("t"), F.concat(F.lit('{"start_ref": "R'), "turn", F.lit('"}')).alias("a"))
    runs = c.groupBy("conv_id").agg(F.array_sort(F.collect_list(call)).alias("l"), F.coalesce(F.min(F.when(F.col("turn") == 0, F.coalesce("text", F.lit("")))), F.lit("")).alias("answer"))
    runs = runs.select("conv_id", F.get(names, (F.col("conv_id") % 3).cast("int")).alias("tool"), F.transform("l", lambda x: x["t"]).alias("called"), F.transform("l", lambda x: x["a"]).alias("arguments"), "answer", F.array(F.concat(F.lit("R"), F.col("conv_id") % 3)).alias("arg_keys"), F.array(F.lit("the")).alias("entities"), (F.col("conv_id") % 11 == 0).alias("maxed_out"))
    return tools.rubric(runs).select("conv_id", "score")


@query("""SELECT user_id, CAST(island AS BIGINT) AS island, count(*) AS n, string_agg(event_type, '' ORDER BY event_id) AS merged FROM (SELECT *, sum(brk) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS island FROM (
SELECT *, CASE WHEN event_id - lag(event_id) OVER (PARTITION BY user_id ORDER BY event_id) < 50 THEN 0 ELSE 1 END AS brk FROM events)) GROUP BY user_id, island""")
def span_merge(spark, sf_dir):
    """Spans of a line joined where the gap is small."""
    e = R.table(spark, sf_dir, "events").select("user_id", "event_id", "event_type")
    order = Window.partitionBy("user_id").orderBy("event_id")
    cut = e.withColumn("brk", F.when(F.col("event_id") - F.lag("event_id").over(order) < 50, 0).otherwise(1))
    cut = cut.withColumn("island", F.sum("brk").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("event_id", "event_type"))), lambda x: x["event_type"]), "")
    return cut.groupBy("user_id", "island").agg(F.count("*").alias("n"), text.alias("merged"))


from netloom.plans import drawing, scores  # noqa: E402, F401  (they register theirs)
