"""Model calls that are resumed, and flowcharts with subgraphs."""

import os
import threading
import time

import pytest
from pyspark.sql import functions as F

from repolens.operators import completion as C
from repolens.operators import graphs

CHAIN = [C.Candidate("m")]


def calls(path):
    return sorted(open(path).read().split()) if os.path.exists(path) else []


def model(log, fails=None):
    def ask(prompt, name):
        if fails and os.path.exists(fails) and prompt == "p30":
            os.remove(fails)
            os._exit(1)  # the worker is lost
        with open(log, "a") as f:
            f.write(f"{prompt}\n")
        return C.Response(C.COMPLETED, f"<{prompt}>")

    return ask


def test_a_task_that_fails_half_way(spark, tmp_path):
    log, fails, kept = str(tmp_path / "log"), str(tmp_path / "fails"), str(tmp_path / "answers")
    open(fails, "w").close()
    prompts = spark.range(60).select(F.concat(F.lit("p"), (F.col("id") % 50).cast("string")).alias("prompt"), "id")
    run = lambda: C.map_prompts(prompts, model(log, fails), CHAIN, concurrency=1, answers=kept, at_once=1).orderBy("id").collect()
    with pytest.raises(Exception, match=r"(?s)crashed|EOF|exit"):
        run()
    before = calls(log)
    assert "p30" not in before
    got = run()
    assert [r["answer"] for r in got] == [f"<p{i % 50}>" for i in range(60)] and {tuple(r["events"]) for r in got} == {("SUCCESS",)}
    assert calls(log) == sorted(f"p{i}" for i in range(50))  # each prompt was asked once, in both runs together
    # Another job finds all answers; other models are asked anew.
    run()
    assert len(calls(log)) == 50
    C.map_prompts(prompts, model(log), [C.Candidate("other")], answers=kept).collect()
    assert len(calls(log)) == 100


def test_calls_in_flight(tmp_path):
    now, most, lock = [0], [0], threading.Lock()

    def ask(prompt):
        with lock:
            now[0] += 1
            most[0] = max(most[0], now[0])
        time.sleep(0.02)
        with lock:
            now[0] -= 1
        return C.Outcome(prompt.upper())

    rows = [("f", f"p{i % 30}", f"k{i % 30}") for i in range(90)]
    got = list(C.answered(rows, ask, lambda f: C.Answers(None, f), 5, 10))
    assert [o.text for o in got] == [r[1].upper() for r in rows] and 2 <= most[0] <= 5


def test_answers_that_break_off(tmp_path):
    a = C.Answers(str(tmp_path), "f")
    for i in range(5):
        a.add(f"k{i}", C.Outcome(f"line one\nline two {i}", "m", ["SUCCESS"]), at_once=2)
    a.keep()
    (tmp_path / "f" / "torn.jsonl").write_text('["k9", "whole", "m", []]\n["k10", "to')
    again = C.Answers(str(tmp_path), "f")
    assert set(again.known) == {*(f"k{i}" for i in range(5)), "k9"} and again.known["k3"].text == "line one\nline two 3"


def test_what_was_done_is_kept(tmp_path):
    def ask(prompt):
        if prompt == "bad":
            raise TypeError("a mistake")
        return C.Outcome(prompt)

    with pytest.raises(TypeError):
        list(C.answered([("f", p, p) for p in ("a", "b", "bad", "c")], ask, lambda f: C.Answers(str(tmp_path), f), 1, 100))
    assert set(C.Answers(str(tmp_path), "f").known) == {"a", "b"}


NODES = "graph string, pos int, id string, label string, shape string, subgraph string, style string"
EDGES = "graph string, pos int, source string, target string, kind string, subgraph string"
SUBGRAPHS = "graph string, pos int, id string, label string, parent string, direction string, style string"


def chart(spark, nodes, edges, subgraphs):
    return graphs.nested_mermaid(spark.createDataFrame(nodes, NODES), spark.createDataFrame(edges, EDGES), spark.createDataFrame(subgraphs, SUBGRAPHS))


def test_nested_charts(spark):
    nodes = [("g", 1, "top", "T", "circle", None, None), ("g", 0, "a", 'A "x"', "rectangle", "in", "fill:red"), ("g", 2, "b", "B", "rectangle", "out", None), ("h", 0, "a", "A", "rounded", None, None)]
    edges = [("g", 0, "top", "b", "solid", None), ("g", 1, "a", "in", "dotted", "in")]
    subgraphs = [("g", 5, "in", "Inner", "out", None, None), ("g", 0, "out", "Outer", None, "LR", "fill:none"), ("g", 1, "void", " ", None, None, None)]
    got = {r["graph"]: r["chart"] for r in chart(spark, nodes, edges, subgraphs).collect()}
    label = got["g"].split('a["')[1].split('"]')[0]
    assert got["h"] == 'flowchart TB\n    a("A")'
    assert got["g"] == "\n".join(["flowchart TB", '    top(("T"))', '    subgraph out["Outer"]', "        direction LR", '        b["B"]', '        subgraph in["Inner"]', f'            a["{label}"]', "            a -.-> in", "        end", "    end", '    subgraph void[" "]', "    end", "    top --> b", "    style a fill:red", "    style out fill:none"])


@pytest.mark.parametrize("nodes,edges,subgraphs,said", [
    ([("a", None), ("a", None)], [], [], "more than once: a"),
    ([("a", None)], [], [("a", None)], "more than once: a"),
    ([("a", None)], [("a", "z")], [], "edges without ends: a - z"),
    ([("a", "s")], [], [], "in unknown subgraphs: a"),
    ([], [], [("s", "t")], "unknown parents: s"),
    ([], [], [("s", "t"), ("t", "u"), ("u", "s"), ("v", None)], "within themselves"),
    ([], [], [("s", "s")], "within themselves: s"),
])
def test_what_is_no_graph(spark, nodes, edges, subgraphs, said):
    with pytest.raises(graphs.BadGraph, match=said):
        chart(spark, [("g", 0, i, i, "circle", s, None) for i, s in nodes], [("g", 0, a, b, "solid", None) for a, b in edges], [("g", 0, i, i, p, None, None) for i, p in subgraphs])
