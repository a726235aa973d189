import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from kinfold import config as C
from kinfold.graph import CycleError, Graph, GraphError, build


def given_config(**more):
    base = {
        "source": {"path": "/s"}, "destination": {"path": "/d"},
        "jobs": {"j": {"root_table": "a", "primary_key": "id", "where": "id < 5", "relations": [{"table": "b", "primary_key": "id", "foreign_key": "a_id"}]}},
    }
    return C.parse(base | more)


def test_defaults_and_overrides():
    c = given_config(processing={"batch_size": 10, "sleep_seconds": 2})
    c.jobs["j"].processing = {"sleep_seconds": 0, "batch_size": None}
    p = c.job_processing("j")
    assert (p.batch_size, p.sleep_seconds, p.batch_delete_size) == (10, 0, 500)
    c.jobs["j"].verification = {"method": "sha256"}
    assert c.job_verification("j").method == "sha256" and not c.job_verification("j").skip_verification
    assert c.with_overrides(skip_verify=True).job_verification("j").skip_verification
    c.jobs["j"].logging = {"level": "debug"}
    assert c.with_overrides(log_level="error").job_logging("j").level == "error"
    with pytest.raises(KeyError):
        c.job("other")
    C.validate(c)


def test_all_errors_are_reported_at_once():
    c = C.parse({
        "replica": {"host": "x"}, "safety": {"lag_threshold": 3}, "processing": {"batch_size": 0, "sleep_seconds": -1}, "verification": {"method": "md5"}, "logging": {"level": "loud", "format": "xml", "file_only": True},
        "replication": {"enabled": True, "check_interval": 0, "servers": [{"host": "a\nb", "type": "sync", "channels": ["x", "x"]}, {"host": "a\nb", "user": "u", "tls": "none"}]},
        "jobs": {"j": {"root_table": "a-b", "where": " ", "relations": [{"table": "", "foreign_key": "x;y", "dependency_type": "2-2"}], "processing": {"batch_delete_size": -1}}},
    })
    found = {f for f, _ in C.errors_of(c)}
    assert found >= {
        "source.path", "destination.path", "replica", "safety.lag_threshold", "processing.batch_size", "processing.sleep_seconds", "verification.method", "logging.level", "logging.format", "logging.file_only",
        "replication.check_interval", "replication.servers[0].host", "replication.servers[0].user", "replication.servers[0].type", "replication.servers[0].channels", "replication.servers[1]", "replication.servers[1].tls",
        "jobs.j.root_table", "jobs.j.primary_key", "jobs.j.where", "jobs.j.relations[0].table", "jobs.j.relations[0].foreign_key", "jobs.j.relations[0].primary_key", "jobs.j.relations[0].dependency_type", "jobs.j.processing.batch_size", "jobs.j.processing.batch_delete_size",
    }
    with pytest.raises(C.ConfigError):
        C.validate(c)
    deep = {"table": "t", "primary_key": "id", "foreign_key": "x"}
    for _ in range(10):
        deep = {"table": "t", "primary_key": "id", "foreign_key": "x", "relations": [deep]}
    c = given_config()
    c.jobs["j"].relations = [C._relation(deep)]
    assert any("deeper" in m for _, m in C.errors_of(c))
    with pytest.raises(ValueError):
        C.parse({"processing": {"batchsize": 3}})


def make(edges, root="A"):
    g = Graph(root)
    for t in dict.fromkeys(x for e in edges for x in e):
        g.add_table(t, "id")
    for p, c in edges:
        g.add_edge(p, c, f"{p}_id")
    return g


def test_orders_and_levels():
    g = make([("A", "B"), ("A", "C"), ("B", "D"), ("C", "D")])
    assert g.copy_order() == ["A", "B", "C", "D"] and g.delete_order() == ["D", "C", "B", "A"]
    assert g.levels() == {"A": 0, "B": 1, "C": 1, "D": 2} and g.in_degrees()["D"] == 2
    assert make([("A", "B"), ("B", "C"), ("A", "C")]).levels()["C"] == 2


@pytest.mark.parametrize("n", [1, 2, 3, 5, 10])
def test_cycles(n):
    names = [f"T{i}" for i in range(n)]
    g = make([(names[i], names[(i + 1) % n]) for i in range(n)] + [("A", names[0]), (names[-1], "Z")])
    with pytest.raises(CycleError) as e:
        g.copy_order()
    assert set(e.value.participants) == set(names) and e.value.blocked == ["Z"] and g.has_cycle()
    path = e.value.path
    assert path[0] == path[-1] and all((a, b) in {(x.parent, x.child) for x in g.edges} for a, b in zip(path, path[1:]))


@settings(max_examples=60, deadline=None)
@given(st.sets(st.tuples(st.integers(0, 8), st.integers(0, 8)), max_size=20))
def test_orders_respect_edges(pairs):
    g = make([(f"n{min(p)}", f"n{max(p)}") for p in pairs if p[0] != p[1]])
    order = g.copy_order()
    assert sorted(order) == sorted(g.keys) and all(order.index(e.parent) < order.index(e.child) for e in g.edges)


def test_building():
    job = given_config().jobs["j"]
    assert build(job).copy_order() == ["a", "b"] and "b (a_id -> a, 1-N)" in build(job).tree()
    for change in ({"table": "a"}, {"table": ""}, {"foreign_key": ""}, {"dependency_type": "n-n"}, {"primary_key": ""}):
        rel = {"table": "b", "primary_key": "id", "foreign_key": "a_id"} | change
        job.relations = [C._relation(rel)]
        with pytest.raises(GraphError):
            build(job)
