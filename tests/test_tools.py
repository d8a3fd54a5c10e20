import json

import pytest

from netloom.operators import tools

PARTS = [("R1", "R1", "Resistor", "10k"), ("U1", "U1", "OpAmp", "LM358"), ("C1", "C1", "Capacitor", "100nF"), ("R2", "R2", "Resistor", "1k"), ("ISO1", "ISO1", "unknown", "None")]
EDGES = [("R1", "VCC", "1"), ("R1", "N1", "2"), ("U1", "VCC", "8"), ("U1", "GND", "4"), ("U1", "N1", "3"), ("C1", "N1", "1"), ("C1", "GND", "2")]


@pytest.fixture(scope="module")
def graph(spark):
    nets = spark.createDataFrame([(n, n) for n in ("VCC", "N1", "GND")] + [("N9", None)], "net string, name string")
    return tools.Graph(spark.createDataFrame(PARTS, "node string, ref string, class_name string, value string"), nets, spark.createDataFrame(EDGES, "node string, net string, pin_id string"))


def ask(graph, name, **arguments):
    return json.loads(tools.answer(graph, name, json.dumps(arguments)))


def test_neighbors_and_paths(graph):
    found = ask(graph, "get_neighbors", component_ref="r1")
    assert found["component"] == "r1" and found["connected_nets"] == ["N1", "VCC"] and found["connected_components"] == ["C1", "U1"]
    assert found["component_description"] == "R1 (Resistor, 10k)" and "VCC (power rail)" in found["connected_nets_detail"]
    assert ask(graph, "get_path", start_ref="R1", end_ref="C1") == {"start": "R1", "end": "C1", "found": True, "path": ["R1", "N1", "C1"], "length": 2}
    assert ask(graph, "get_path", start_ref="R1", end_ref="R2") == {"start": "R1", "end": "R2", "found": False, "path": [], "length": 0}
    assert ask(graph, "get_path", start_ref="R1", end_ref="R1")["length"] == 0 and ask(graph, "get_path", start_ref="R1", end_ref="R1")["found"]
    assert ask(graph, "get_path", start_ref="Q", end_ref="R1") == {"error": "Start component Q not found."} and ask(graph, "get_path", start_ref="R1", end_ref="Q") == {"error": "End component Q not found."}


def test_nets_and_components(graph):
    vcc = ask(graph, "get_net_components", net_name="vcc")
    assert vcc["num_components"] == 2 and vcc["type"] == "power rail" and [(c["ref"], c["pin"]) for c in vcc["components"]] == [("R1", "1"), ("U1", "8")]
    assert ask(graph, "get_net_components", net_name="X") == {"error": "Net X not found."}
    info = ask(graph, "get_component_info", component_ref="U1")
    assert (info["num_pins"], info["value"], info["component_type"], info["connected_nets"]) == (3, "LM358", "OpAmp", ["GND", "N1", "VCC"])
    assert ask(graph, "get_component_info", component_ref="ISO1")["component_type"] == "unknown"
    iso = ask(graph, "find_isolated")
    assert sorted(iso["isolated_components"]) == ["ISO1", "R2"] and iso["count"] == 2


def test_search_and_summary(graph):
    assert [m["ref"] for m in ask(graph, "search_by_value", pattern="10K")["matches"]] == ["R1"] and ask(graph, "search_by_value", pattern=".*F$")["matches"][0]["ref"] == "C1"
    assert "Invalid regex" in ask(graph, "search_by_value", pattern="(")["error"]
    assert [n["net"] for n in ask(graph, "get_nets_summary", min_components="2")["nets"]] == ["GND", "VCC", "N1"]
    assert ask(graph, "get_nets_summary", min_components=3)["nets"][0]["components"] == ["C1", "R1", "U1"]
    assert ask(graph, "get_nets_summary", min_components="x")["count"] == 3 and ask(graph, "get_nets_summary", min_components=0)["count"] == 4


def test_dispatcher(graph):
    assert json.loads(tools.answer(graph, "get_path", "{")) == {"error": "Malformed JSON arguments"}
    assert "JSON object" in json.loads(tools.answer(graph, "get_path", "[1]"))["error"] and "not found" in json.loads(tools.answer(graph, "__init__", ""))["error"]
    assert "takes" in ask(graph, "get_neighbors", ref="R1")["error"]


@pytest.mark.parametrize(("text", "call"), [
    ('{"name": "get_neighbors", "arguments": {"component_ref": "R1"}}', ("get_neighbors", {"component_ref": "R1"})), ('TOOL_CALL: get_path({"start_ref": "A", "end_ref": "B"})', ("get_path", {"start_ref": "A", "end_ref": "B"})),
    ('get_path("RF1", "R37")', ("get_path", {"start_ref": "RF1", "end_ref": "R37"})), ("find_isolated()", ("find_isolated", {})), ("R1 is next to C1.", None), ("I used get_path before.", None), ('{"name": "drop_table", "arguments": {}}', None),
])
def test_calls_in_text(text, call):
    found = tools.read_call(text)
    assert found is None if call is None else (found[0], json.loads(found[1])) == call


def test_conversation(graph):
    replies = iter(['get_neighbors("R1")', "R1 meets U1 and C1."])
    said, calls = tools.converse(graph, "What is next to R1?", lambda messages: next(replies))
    assert said == "R1 meets U1 and C1." and [c[0] for c in calls] == ["get_neighbors"]
    assert "Could not" in tools.converse(graph, "?", lambda messages: "find_isolated()", 2)[0]


def test_rubric_and_ranking(spark):
    rows = [("get_path", ["R1"], ["found"], ["get_path"], ['{"start_ref": "r1"}'], "Found it.", False), ("get_path", ["R1"], ["found"], ["find_isolated"], ["R1"], "found", False), ("get_path", [], [], ["get_path"], [], "", True)]
    runs = spark.createDataFrame(rows, "tool string, arg_keys array<string>, entities array<string>, called array<string>, arguments array<string>, answer string, maxed_out boolean")
    assert sorted(r["score"] for r in tools.rubric(runs).collect()) == [1, 4, 5]
    scores = spark.createDataFrame([("a", 5, 2.0), ("a", 2, 2.0), ("b", 3, 1.0), ("b", 4, 1.0)], "model string, score int, seconds double")
    assert [r["model"] for r in tools.ranking(scores).collect()] == ["b", "a"]


def _shared(spark):
    """Three components that are all R7."""
    parts = [(n, "R7", "Resistor", v) for n, v in (("p14007", "a"), ("p7", "b"), ("p7007", "c"))] + [("p8", "C8", "Capacitor", "d")]
    edges = [("p14007", "N1", "1"), ("p7", "N2", "1"), ("p7", "N3", "2"), ("p8", "N3", "1"), ("p7007", "N4", "1")]
    nets = spark.createDataFrame([(f"N{k}", None) for k in range(1, 5)], "net string, name string")
    return tools.Graph(spark.createDataFrame(parts, "node string, ref string, class_name string, value string"), nets, spark.createDataFrame(edges, "node string, net string, pin_id string"))


def test_info_is_that_of_the_first_by_number(spark):
    info = ask(_shared(spark), "get_component_info", component_ref="R7")
    assert (info["value"], info["num_pins"], info["connected_nets"]) == ("b", 2, ["N2", "N3"])


def test_neighbors_are_those_of_the_first_by_number(spark):
    found = ask(_shared(spark), "get_neighbors", component_ref="r7")
    assert found["connected_nets"] == ["N2", "N3"] and found["connected_components"] == ["C8"]
