"""Components and reach on deep and random graphs against a plain search."""

import random

from srcgraph.operators import graph


def components(edges):
    after, back = {}, {}
    for a, b in edges:
        after.setdefault(a, set()).add(b)
        back.setdefault(b, set()).add(a)

    def reach(a, of):
        seen, todo = {a}, [a]
        while todo:
            for b in of.get(todo.pop(), ()):
                if b not in seen:
                    seen.add(b)
                    todo.append(b)
        return seen

    out = {}
    for a in {x for e in edges for x in e}:
        knot = reach(a, after) & reach(a, back)
        if len(knot) > 1:
            out[a] = min(knot)
    return out


def found(spark, edges, rounds=None):
    df = spark.createDataFrame([(str(a), str(b)) for a, b in edges], "src string, dst string")
    return {r.node: r.component for r in graph.strongly_connected(df, rounds).collect()}


def test_components_of_random_graphs(spark):
    r = random.Random(4)
    edges = [(str(r.randrange(60)), str(r.randrange(60))) for _ in range(80)] + [(f"r{i}", f"r{(i + 1) % 30}") for i in range(30)] + [("r3", "7")]
    edges += edges[:3]
    assert found(spark, edges) == components([e for e in edges if e[0] != e[1]])
    assert found(spark, [("a", "a")]) == {} and found(spark, [("a", "b"), ("b", "c")]) == {}


def test_deep_graphs_take_few_rounds(spark, monkeypatch):
    """A ring, a long path into it and one out of it: the least of all may lie at the end of the last."""
    monkeypatch.setattr(graph, "BROADCAST_NODES", 5)
    monkeypatch.setattr(graph, "FOLLOWED", 20)
    n = 300
    edges = [(f"r{i}", f"r{(i + 1) % n}") for i in range(n)] + [(f"p{i}", f"p{i + 1}") for i in range(n)] + [(f"p{n}", "r5"), ("r9", "q0")] + [(f"q{i}", f"q{i + 1}") for i in range(n)]
    numbered = {name: k for k, name in enumerate(random.Random(3).sample(sorted({x for e in edges for x in e}), 3 * n + 2))}
    rounds = []
    got = graph.least_reached(spark.createDataFrame([(numbered[a], numbered[b]) for a, b in edges], "src long, dst long"), rounds)
    ahead = {**{f"q{i}": [f"q{k}" for k in range(i, n + 1)] for i in range(n + 1)}}
    ahead |= dict.fromkeys([f"r{i}" for i in range(n)], [f"r{i}" for i in range(n)] + ahead["q0"])
    ahead |= {f"p{i}": [f"p{k}" for k in range(i, n + 1)] + ahead["r0"] for i in range(n + 1)}
    assert {x.node: x.least for x in got.collect()} == {numbered[v]: min(numbered[w] for w in ws) for v, ws in ahead.items()}
    assert len(rounds) <= 60  # a step by step search takes as many as the paths are long, some 900


def test_least_reached(spark):
    r = random.Random(7)
    edges = list({(r.randrange(40), r.randrange(40)) for _ in range(60)})
    got = {x.node: x.least for x in graph.least_reached(spark.createDataFrame(edges, "src long, dst long")).collect()}
    after = {}
    for a, b in edges:
        after.setdefault(a, set()).add(b)
    for a in {x for e in edges for x in e}:
        seen, todo = {a}, [a]
        while todo:
            for b in after.get(todo.pop(), ()):
                if b not in seen:
                    seen.add(b)
                    todo.append(b)
        assert got[a] == min(seen)


def test_a_large_component_is_searched_once(spark, monkeypatch):
    """Rounds take what a search from the busiest node leaves; the knot it finds joins what else is of its component, however deep."""
    monkeypatch.setattr(graph, "KNOTTED", 1, raising=False)
    r = random.Random(5)
    large = [(f"g{r.randrange(200)}", f"g{r.randrange(200)}") for _ in range(800)] + [(f"i{k}", "g0") for k in range(30)] + [("g1", f"o{k}") for k in range(30)]
    # A long way out of the large component and back: the search ends before it has seen all of it.
    deep = [("g2", "w0"), ("w60", "g3")] + [(f"w{k}", f"w{k + 1}") for k in range(60)]
    small = [("x", "y"), ("y", "x"), ("y", "g4"), ("g5", "z0"), ("z0", "z1"), ("z1", "z2"), ("z2", "z0")]
    taken, least_reached = [], graph.least_reached
    monkeypatch.setattr(graph, "least_reached", lambda edges, rounds: taken.append(edges.count()) or least_reached(edges, rounds))
    monkeypatch.setattr(graph, "BROADCAST_NODES", 60)  # narrow levels are broadcast, wide ones are merged
    assert found(spark, large + deep + small) == components([e for e in large + deep + small if e[0] != e[1]])
    assert taken and max(taken) < 200
    path = [(f"p{k}", f"p{k + 1}") for k in range(3)]
    assert found(spark, path) == {}
