"""Questions about a graph, each a function with parameters that returns one row or more, and a dispatcher that answers in JSON.

A Graph has components (node, ref, class_name, value, and bx0..by1 if known), nets (net, name) and edges (node, net,
pin_id), one edge a component and net. Components are named by ref and nets by name, exactly or else whatever the case;
of several with one name the first by node or net is meant, shorter ones first, so that p7 comes before p14007.
"""

from __future__ import annotations

import json
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netloom.functions import text as T
from netloom.operators.graph import shortest_paths

NAMES = ("get_neighbors", "get_path", "get_net_components", "find_isolated", "get_component_info", "search_by_value", "get_nets_summary")
PARAMETERS = {
    "get_neighbors": ("component_ref",), "get_path": ("start_ref", "end_ref"), "get_net_components": ("net_name",), "find_isolated": (),
    "get_component_info": ("component_ref",), "search_by_value": ("pattern",), "get_nets_summary": ("min_components",),
}


class Unknown(ValueError):
    """What was asked about isn't there, or the question isn't well put."""


def _listed(value: Column | str, *order: Column | str) -> Column:
    """Values of a group as an array in the order of ``order``."""
    keys = [F.col(o).alias(f"o{i}") if isinstance(o, str) else o.alias(f"o{i}") for i, o in enumerate(order)]
    value = F.col(value) if isinstance(value, str) else value
    return F.transform(F.array_sort(F.collect_list(F.struct(*keys, value.alias("v")))), lambda s: s["v"])


@dataclass
class Graph:
    components: DataFrame
    nets: DataFrame
    edges: DataFrame

    def described(self) -> DataFrame:
        """Components with description."""
        return self.components.withColumn("description", T.describe_component(F.col("ref"), F.col("class_name"), F.col("value")))

    def named_nets(self) -> DataFrame:
        return self.nets.withColumn("net_name", T.net_name(F.col("name"), F.col("net")))

    def _find(self, table: DataFrame, key: str, name: str, wanted: str) -> DataFrame:
        """The row that a name means; no row if there is none."""
        exact = (F.col(name) != wanted).cast("int")
        return table.where(F.upper(name) == wanted.upper()).orderBy(exact, F.length(F.col(key).cast("string")), key).limit(1)

    def component(self, ref: str) -> DataFrame:
        return self._find(self.described(), "node", "ref", ref)

    def net(self, name: str) -> DataFrame:
        return self._find(self.named_nets(), "net", "net_name", name)

    def get_neighbors(self, component_ref: str) -> DataFrame:
        """One row: component, component_description, connected_nets and connected_components with their descriptions. No row without the component."""
        one = self.component(component_ref).select("node", F.lit(component_ref).alias("component"), F.col("description").alias("component_description"))
        mine = self.edges.join(one.select("node"), "node", "left_semi").select("net")
        nets = self.named_nets().join(mine, "net", "left_semi").withColumn("detail", T.describe_net(F.col("net_name")))
        near = self.edges.join(mine, "net", "left_semi").select("node").distinct().join(one.select("node"), "node", "left_anti")
        parts = self.described().join(near, "node", "left_semi").select("ref", "description").groupBy("ref").agg(F.min("description").alias("description"))
        nets = nets.agg(_listed("net_name", "net").alias("connected_nets"), _listed("detail", "net").alias("connected_nets_detail"))
        parts = parts.agg(_listed("ref", "ref").alias("connected_components"), _listed("description", "ref").alias("connected_components_detail"))
        return one.drop("node").crossJoin(F.broadcast(nets)).crossJoin(F.broadcast(parts))  # one row each

    def get_path(self, start_ref: str, end_ref: str) -> DataFrame:
        """One row: start, end, found, path (names of components and nets in turn), length in edges."""
        start, end = self.component(start_ref), self.component(end_ref)
        tag = lambda kind, c: F.concat(F.lit(kind), F.col(c).cast("string"))
        links = self.edges.select(tag("c", "node").alias("a"), tag("n", "net").alias("b"))
        way = shortest_paths(links, start.select(tag("c", "node").alias("node")), end.select(tag("c", "node").alias("node")))
        names = self.components.select(tag("c", "node").alias("at"), F.col("ref").alias("name")).unionByName(self.named_nets().select(tag("n", "net").alias("at"), F.col("net_name").alias("name")))
        steps = way.select("length", F.posexplode("path").alias("step", "at")).join(names, "at", "left").groupBy("length").agg(_listed(F.coalesce("name", "at"), "step").alias("path"))
        both = start.crossJoin(F.broadcast(end.select(F.col("ref").alias("_end")))).select(F.lit(start_ref).alias("start"), F.lit(end_ref).alias("end"))  # one row
        out = both.join(F.broadcast(steps), F.lit(True), "left")
        return out.select("start", "end", F.col("path").isNotNull().alias("found"), F.coalesce("path", F.array().cast("array<string>")).alias("path"), F.coalesce("length", F.lit(0)).alias("length"))

    def get_net_components(self, net_name: str) -> DataFrame:
        """One row: net, type, components (ref, pin, description), num_components."""
        one = self.net(net_name).select("net")
        joined = self.edges.join(one, "net", "left_semi").join(self.described(), "node")
        pin = F.coalesce(F.nullif(F.col("pin_id").cast("string"), F.lit("")), F.lit("unknown"))
        parts = joined.agg(_listed(F.struct("ref", pin.alias("pin"), "description"), "ref", "node").alias("components"), F.count("*").alias("num_components"))
        return one.select(F.lit(net_name).alias("net"), T.net_type(F.lit(net_name)).alias("type")).crossJoin(F.broadcast(parts))

    def find_isolated(self) -> DataFrame:
        """(node, ref, description) of components without a net."""
        return self.described().join(self.edges.select("node"), "node", "left_anti").select("node", "ref", "description")

    def get_component_info(self, component_ref: str) -> DataFrame:
        """One row: ref, description, value, component_type, bbox, num_pins (nets), connected_nets with their descriptions."""
        one = self.component(component_ref)
        nets = self.named_nets().join(self.edges.join(one.select("node"), "node", "left_semi").select("net"), "net", "left_semi").withColumn("detail", T.describe_net(F.col("net_name")))
        nets = nets.agg(F.count("*").alias("num_pins"), _listed("net_name", "net").alias("connected_nets"), _listed("detail", "net").alias("connected_nets_detail"))
        kind = F.coalesce(F.nullif(F.col("class_name"), F.lit("")), T.known_class(F.lit(None).cast("string"), F.lit(component_ref)))
        box = F.array("bx0", "by0", "bx1", "by1") if "bx0" in self.components.columns else F.lit(None).cast("array<double>")
        return one.select(F.lit(component_ref).alias("ref"), "description", "value", kind.alias("component_type"), box.alias("bbox")).crossJoin(F.broadcast(nets))

    def search_by_value(self, pattern: str) -> DataFrame:
        """(node, ref, value, description) of components whose value has the pattern somewhere, whatever the case."""
        try:
            re.compile(pattern)
        except re.error as e:
            raise Unknown(f"Invalid regex pattern '{pattern}': {e}") from e
        return self.described().where((F.col("value") != "") & F.col("value").rlike(f"(?i){pattern}")).select("node", "ref", "value", "description")

    def get_nets_summary(self, min_components: int | str = 1) -> DataFrame:
        """(net, net_name, type, num_components) of nets with so many components, rails first, then the largest, then by net. What is no number counts as 1."""
        try:
            least = int(min_components)
        except (TypeError, ValueError):
            least = 1
        n = self.edges.groupBy("net").agg(F.count("*").alias("num_components"))
        out = self.named_nets().join(n, "net", "left").withColumn("num_components", F.coalesce("num_components", F.lit(0))).where(F.col("num_components") >= least)
        return out.select("net", "net_name", T.net_type(F.col("net_name")).alias("type"), "num_components").orderBy(F.desc(F.col("type") == "power rail"), F.desc("num_components"), "net")

    def net_members(self, min_components: int = 1) -> DataFrame:
        """(net, ref, description), a row a member, of the nets of a summary."""
        nets = self.edges.groupBy("net").agg(F.count("*").alias("n")).where(F.col("n") >= min_components).select("net")
        return self.edges.join(nets, "net", "left_semi").join(self.described(), "node").select("net", "ref", "description")


def answer(graph: Graph, name: str, arguments: str, most: int = 1000) -> str:
    """A tool's answer in JSON. Only the seven tools can be called; what goes wrong is an answer with ``error``.

    Answers with many rows have the first ``most`` of them and the count of all.
    """
    fail = lambda text: json.dumps({"error": text})
    try:
        given = json.loads(arguments) if arguments.strip() else {}
    except json.JSONDecodeError:
        return fail("Malformed JSON arguments")
    if not isinstance(given, dict):
        return fail('Arguments must be a JSON object, e.g. {"arg": "value"}')
    if name not in NAMES:
        return fail(f"Tool {name} not found")
    if set(given) - set(PARAMETERS[name]) or (name != "get_nets_summary" and set(PARAMETERS[name]) - set(given)):
        return fail(f"{name} takes {', '.join(PARAMETERS[name]) or 'no arguments'}")
    try:
        out = getattr(graph, name)(**given)
    except Unknown as e:
        return fail(str(e))
    if name in ("get_neighbors", "get_path", "get_net_components", "get_component_info"):
        row = out.first()
        if row is not None:
            return json.dumps(row.asDict(recursive=True))
        if name == "get_net_components":
            return fail(f"Net {given['net_name']} not found.")
        if name == "get_path":
            first = graph.component(given["start_ref"]).first() is None
            return fail(f"Start component {given['start_ref']} not found." if first else f"End component {given['end_ref']} not found.")
        return fail(f"Component {given['component_ref']} not found.")
    count, rows = out.count(), [r.asDict() for r in out.limit(most).collect()]
    if name == "find_isolated":
        note = "Nothing joins these to any net: they weren't recognised, or are unconnected." if count else "No isolated components found."
        return json.dumps({"isolated_components": [r["ref"] for r in rows], "components_detail": [r["description"] for r in rows], "count": count, "note": note})
    if name == "search_by_value":
        return json.dumps({"matches": [{k: r[k] for k in ("ref", "value", "description")} for r in rows], "count": count})
    shown = graph.net_members(1).join(out.sparkSession.createDataFrame([(r["net"],) for r in rows], out.select("net").schema), "net", "left_semi").groupBy("net")
    members = {r["net"]: r for r in shown.agg(F.slice(_listed("ref", "ref"), 1, most).alias("refs"), F.slice(_listed("description", "ref"), 1, most).alias("details")).collect()} if rows else {}
    nets = [{"net": r["net_name"], "type": r["type"], "num_components": r["num_components"], "components": members[r["net"]]["refs"] if r["net"] in members else [], "components_detail": members[r["net"]]["details"] if r["net"] in members else []} for r in rows]
    return json.dumps({"nets": nets, "count": count})


def read_call(text: str) -> tuple[str, str] | None:
    """(tool, arguments in JSON) of a call that a model wrote as text; None in prose.

    It may be an object with a name and arguments, a tool's name before an object, or its name before values in brackets.
    """
    named = re.search(r'"name"\s*:\s*"(\w+)"', text)
    if named and named[1] in NAMES:
        given = re.search(r'"(?:arguments|parameters)"\s*:\s*(\{.*?\})', text, re.S)
        return named[1], given[1] if given else "{}"
    at, name = min(((text.find(n), n) for n in NAMES if n in text), default=(-1, ""))
    if at < 0:
        return None
    found = re.search(r"(\{.*?\})|\(\s*([^(){}]*?)\s*\)", text[at + len(name) :], re.S)
    if not found:
        return None
    if found[1]:
        return name, found[1]
    values = [v.strip().strip("'\"") for v in found[2].split(",") if v.strip()]
    return name, json.dumps(dict(zip(PARAMETERS[name], values, strict=False)))


def converse(graph: Graph, question: str, chat, most: int = 10) -> tuple[str, list[tuple[str, str]]]:
    """(answer, calls made): ``chat`` is given the messages so far and returns a reply's text, until one calls no tool or ``most`` were asked for."""
    messages, calls = [{"role": "user", "content": question}], []
    for _ in range(most):
        reply = chat(messages)
        call = read_call(reply)
        messages.append({"role": "assistant", "content": reply})
        if call is None:
            return reply, calls
        calls.append(call)
        messages.append({"role": "tool", "tool_name": call[0], "content": answer(graph, *call)})
    return "Could not answer within the allowed number of calls.", calls


def rubric(runs: DataFrame, longest: int = 9) -> DataFrame:
    """runs (tool, arg_keys, entities, called, arguments, answer, maxed_out) with score, 0 to 5.

    Two points for the right tool, and only with it one each for its arguments and for what the answer has to name; one
    for an answer that came without running on. called and arguments are arrays, one element a call.
    """
    low = lambda c: F.lower(c)
    all_in = lambda wanted, text: F.forall(wanted, lambda w: low(text).contains(low(w)))
    right = F.array_contains("called", F.col("tool"))
    clean = ~F.col("maxed_out") & (F.size("called") <= longest) & (F.trim("answer") != "") & ~low(F.col("answer")).contains("could not answer")
    points = F.when(right, 2).otherwise(0)
    for ok in (right & all_in("arg_keys", F.array_join("arguments", " ")), right & all_in("entities", F.col("answer")), clean):
        points = points + F.when(ok, 1).otherwise(0)
    return runs.withColumn("score", points)


def ranking(scores: DataFrame) -> DataFrame:
    """(model, passed, score, seconds), the best first: most questions passed, then the higher score, then the quicker."""
    n = scores.groupBy("model").agg(F.count_if(F.col("score") >= 3).alias("passed"), F.sum("score").alias("score"), F.avg("seconds").alias("seconds"))
    return n.orderBy(F.desc("passed"), F.desc("score"), "seconds", "model")
