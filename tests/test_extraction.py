import random

from graphs import node
from pyspark.sql import functions as F

from loomgraph.operators import extraction as x


def test_kinds_and_nodes(spark):
    schema = "symbol string, type_kind string, is_record boolean, container_kind string, name string, fqn string, assembly string, in_source boolean, unnamed boolean, file string, span_start int, span_end int"
    rows = [
        ("type", "class", True, None, "R", "N.R", "A", True, None, "b", 5, 6),
        ("type", "class", True, None, "R", "N.R", "A", True, None, "a", 9, 10),
        ("field", None, None, "enum", "Red", "N.E.Red", "A", True, None, "a", 1, 2),
        ("field", None, None, "class", "f", "N.R.f", "A", True, None, "a", 1, 2),
        ("namespace", None, None, None, "N", "N", "A", True, None, "a", 0, 1),
        ("method", None, None, "class", "", "<top-level-statements-entry-point>", "App", True, None, "p", 0, 1),
        ("type", "class", None, None, "Program", "Program", "App", True, None, "p", 0, 1),
        ("type", "class", None, None, "String", "System.String", "L", False, None, None, None, None),
        ("type", "class", None, None, "", "<anonymous>", "A", True, True, "a", 1, 2),
        ("local", None, None, None, "x", "x", "A", True, None, "a", 1, 2),
    ]
    got = {r.fqn: (r.kind, r.file, r.span_start) for r in x.nodes_of(spark.createDataFrame(rows, schema)).collect()}
    assert got == {"N.R": ("Record", "a", 9), "N.E.Red": ("EnumMember", "a", 1), "N.R.f": ("Field", "a", 1), "N": ("Namespace", None, None), "App.<top-level-statements-entry-point>": ("Method", "p", 0), "App.Program": ("Class", "p", 0)}


def named(df, *known):
    ids = {node(*k)[0]: k[1] for k in known}
    return sorted((ids[r.source_id], ids[r.target_id], r.kind) for r in df.collect())


def test_type_edges_and_containment(spark):
    bases = spark.createDataFrame([("Class", "A", "Class", "B", False), ("Class", "A", "Interface", "I", True), ("Class", "A", "Class", "System.Object", False)], "kind string, fqn string, base_kind string, base_fqn string, is_contract boolean")
    assert named(x.type_edges(bases), ("Class", "A"), ("Class", "B"), ("Interface", "I")) == [("A", "B", "Inherits"), ("A", "I", "Implements")]
    types = spark.createDataFrame([("Class", "X.Y.A", "X.Y", "P", None, None), ("Class", "X.Y.A.In", "X.Y", "P", "Class", "X.Y.A"), ("Class", "Bare", None, "P", None, None)], "kind string, fqn string, namespace string, project string, outer_kind string, outer_fqn string")
    known = [("Class", "X.Y.A"), ("Class", "X.Y.A.In"), ("Class", "Bare"), ("Namespace", "X"), ("Namespace", "X.Y"), ("Project", "P")]
    assert named(x.containment(types), *known) == sorted((a, b, "Contains") for a, b in (("P", "X"), ("X", "X.Y"), ("X.Y", "X.Y.A"), ("X.Y.A", "X.Y.A.In"), ("P", "Bare")))


def test_innermost_member(spark):
    r = random.Random(2)
    members, uses = [], []
    for f in "ab":
        spans = [(0, 200)]
        for k in range(40):
            a, b = r.choice(spans)
            c = r.randint(a + 1, b - 1) if b - a > 4 else None
            if c is None:
                continue
            d = r.randint(c, b - 1)
            if all(e <= c or s >= d or (s <= c and d <= e) or (c <= s and e <= d) for s, e in spans) and (c, d) not in spans and d > c:
                spans.append((c, d))
        members += [(f, s, e, f"{f}{s}-{e}") for s, e in spans]
        uses += [(f, at) for at in range(-3, 205)]
    uses.append(("c", 5))
    want = {(f, at): min(((e - s, i) for g, s, e, i in members if g == f and s <= at < e), default=(0, None))[1] for f, at in uses}
    got = {(r.file, r.at): r.member_id for r in x.enclosing_members(spark.createDataFrame(uses, "file string, at int"), spark.createDataFrame(members, "file string, span_start int, span_end int, id string")).collect()}
    assert got == want


def test_use_edges(spark):
    rows = [("a", "b", True, None, None), ("a", "a", True, None, None), ("a", "a", False, None, None), ("a", "c", False, None, True), ("a", "d", True, True, None), ("a", "e", False, None, None), ("a", None, False, None, None)]
    got = x.use_edges(spark.createDataFrame(rows, "source_id string, target_id string, is_call boolean, is_delegate_call boolean, in_declaration boolean"))
    assert sorted(map(tuple, got.collect())) == [("a", "a", "Calls"), ("a", "b", "Calls"), ("a", "e", "References")]


def test_controller_routes(spark):
    actions = spark.createDataFrame([(k, "HomeController", "GetAsync", None, k == 6) for k in range(1, 12)], "action_id int, controller string, action string, area string, is_abstract boolean")
    attributes = spark.createDataFrame(
        [(1, "HttpGet", "{id}"), (2, "HttpGet", None), (3, "Route", "x"), (3, "HttpPost", None), (3, "HttpPut", None), (4, "Route", "x"), (5, "HttpGet", "/abs"), (6, "HttpGet", "y"), (7, "HttpGet", None), (8, "HttpHead", None), (9, "HttpGet", "[page]"), (10, "HttpGet", "~/[controller]/[action]")],
        "action_id int, name string, template string",
    )
    above = spark.createDataFrame([(k, "api/[controller]") for k in (1, 2, 3, 5, 6, 9, 10, 11)], "action_id int, template string")
    got = {r.action_id: (r.routes, len(r.refusals), r.is_conventional) for r in x.controller_routes(actions, attributes, above).collect()}
    assert got == {
        1: (["GET /api/Home/{id}"], 0, False),
        2: (["GET /api/Home"], 0, False),
        3: (["POST /api/Home/x", "PUT /api/Home/x"], 0, False),
        4: ([], 1, False),
        5: (["GET /abs"], 0, False),
        6: ([], 1, False),
        7: ([], 0, True),
        8: ([], 1, False),
        9: ([], 1, False),
        10: (["GET /Home/Get"], 0, False),
        11: ([], 1, False),
    }


def test_group_prefixes_and_constants(spark):
    rows = [("g0", None, "api")] + [(f"g{k}", f"g{k - 1}", f"s{k}") for k in range(1, 20)] + [("lost", "nowhere", "x"), ("dynamic", "g0", None), ("empty", "g0", "")]
    got = {r.name: r.prefix for r in x.group_prefixes(spark.createDataFrame(rows, "name string, receiver string, segment string")).collect()}
    assert got["g0"] == "api"
    assert got["g3"] == "api/s1/s2/s3"
    assert got["g15"] == "/".join(["api", *(f"s{k}" for k in range(1, 16))])
    assert got["g16"] is None
    assert (got["lost"], got["dynamic"], got["empty"]) == (None, None, "api")
    chain = [("c0", "v", None)] + [(f"c{k}", None, f"c{k - 1}") for k in range(1, 12)] + [("loop", None, "loop"), ("open", None, "gone")]
    values = {r.name: r.value for r in x.constants(spark.createDataFrame(chain, "name string, value string, alias string")).collect()}
    assert [values[f"c{k}"] for k in range(12)] == ["v"] * 9 + [None] * 3
    assert (values["loop"], values["open"]) == (None, None)


def test_call_sites(spark):
    part = lambda text, hole=False, failure=None: (text, hole, failure)
    rows = [
        ("fetch", None, None, [part("/x/"), part(None, True)], "a", 2, 1, 0, 1),
        ("fetch", "post", True, [part("/x")], "a", 1, 1, 0, 1),
        ("fetch", "m", False, [part("/x")], "a", 3, 1, 0, 1),
        ("client", "del", None, [part("/y")], "b", 1, 1, 0, 1),
        ("client", "head", None, [part("/y")], "b", 2, 1, 0, 1),
        ("client", "get", None, [part("key")], "b", 3, 1, 0, 1),
        ("client", "get", None, [part("/"), part(None, False, "dynamic")], "b", 4, 1, 0, 1),
    ]
    df = spark.createDataFrame(rows, "callee string, method string, method_is_literal boolean, parts array<struct<text:string,is_hole:boolean,failure:string>>, file string, line int, column int, span_start int, span_end int")
    got = [(r.kind, r.verb, r.template, r.category) for r in x.classified_calls(df).collect()]
    site = "FrontendCallSite"
    assert got == [(site, "POST", "/x", None), (site, "GET", "/x/{*}", None), (site, "UNKNOWN", "/x", None), (site, "DELETE", "/y", None), ("UnresolvedCallSite", "GET", None, "dynamic")]
    assert df.select(F.size("parts")).first()[0] == 2


def band(v):
    return v[0], v[1], v[2] // 100


POLICIES = {
    "disable": lambda p, v: v == p,
    "patch": lambda p, v: band(v) == band(p) and v[2] >= p[2],
    "feature": lambda p, v: v[:2] == p[:2] and band(v) >= band(p),
    "latestMinor": lambda p, v: v[0] == p[0] and band(v) >= band(p),
    "major": lambda p, v: band(v) >= band(p),
    None: lambda p, v: band(v) == band(p),
    "else": lambda p, v: band(v) == band(p),
}


def test_versions_roll_forward(spark):
    """Every policy against all installed versions, with pins that aren't versions, previews and repeated rows."""
    r = random.Random(4)
    versions = [(r.randint(7, 9), r.randint(0, 1), r.choice([100, 103, 199, 200, 305])) for _ in range(9)]
    installed = spark.createDataFrame([(".".join(map(str, v)),) for v in versions] + [("9.x",), (None,), ("9.0.100.1",)], "version string")
    pins = [((r.randint(6, 10), r.randint(0, 1), r.choice([100, 101, 150, 200, 300])), policy) for policy in POLICIES for _ in range(25)]
    rows = [(k, ".".join(map(str, v)) + ("-rc.1" if k % 5 == 0 else ""), policy, "mine") for k, (v, policy) in enumerate(pins)]
    rows += [(-1, "none", "major", "mine"), (-2, None, "major", "mine")]
    got = {x.k: (x.found, x.level) for x in x.rolled_forward(spark.createDataFrame(rows, "k int, version string, policy string, level string"), installed).collect()}
    for k, (v, policy) in enumerate(pins):
        fits = [w for w in versions if POLICIES[policy](v, w)]
        assert got[k] == (".".join(map(str, max(fits))) if fits else None, "mine"), (v, policy)
    assert got[-1] == got[-2] == (None, "mine")
