"""ShEx: syntax, validation, recursion, shape maps, ShExR, the bag matcher and the minimal language."""

import itertools
import random
import time
import json

import pytest

from shapeloom.operators import lint, shapemap, shex, shexr
from shapeloom.plans import bags, shexc, slang
from shapeloom.plans import paths as P
from shapeloom.sources import rdf
from shapeloom.sources.terms import iri

PRE = "PREFIX : <http://e/> PREFIX xsd: <http://www.w3.org/2001/XMLSchema#>\n"
TTL = "@prefix : <http://e/> . @prefix xsd: <http://www.w3.org/2001/XMLSchema#> .\n"
GOOD = [
    ":S { :p . }", ":S { :p xsd:integer MININCLUSIVE 5 TOTALDIGITS 3 ? }", ":S CLOSED EXTRA :p a { :p [ 1 2.0 'a'@en :z~ - :zz - :zy~ @fr~ ] }", ":S { :v [ . - :a~ - :b ] ; :l [ . - 'x'~ ] ; :g [ @~ - @en ] }",
    "start = @:S :S { ^:p @:S* ; $:t ( :q . | :r . ; :s . ){2,3} // :note 'x' %:act{ a %} ; &:t }", ":S NOT { :a BNODE } AND (@:S OR LITERAL LENGTH 3)", ":S IRI /^http:\\/\\/x/i", ":S EXTERNAL :T @:S", "IMPORT <x> %:start{ %} :S { }", "ABSTRACT :S { :p . }",
]
BAD = [":S { :p", "S { }", ":S { x:p . }", ":S { :p . } :S { }", ":S { :p [ . ] }", ":S { :p .{3,2} }", ":S { :p IRI MININCLUSIVE 2 }", ":S { :p LITERAL LENGTH 1 LENGTH 2 }", ":S { A . }"]


@pytest.mark.parametrize("text", GOOD)
def test_syntax_roundtrip(text):
    a = shexc.parse(PRE + text)
    b = shexc.parse(shexc.show(a))
    a.pop("prefixes"), b.pop("prefixes", None)
    assert a == b
    if "ABSTRACT" not in text and "&" not in text:
        c = shexr.read("\n".join(f"{s.nt()} <{p}> {o.nt()} ." for s, p, o in shexr.write(a)))
        assert json.loads(json.dumps(c)) == json.loads(json.dumps(a))


@pytest.mark.parametrize("text", BAD)
def test_syntax_errors(text):
    with pytest.raises(SyntaxError):
        shexc.parse(PRE + text)


@pytest.mark.parametrize("text", [":S { :p @:T }", ":S { &:x }", ":S NOT @:S", ":S { :p @:T } :T { :q NOT @:S }", ":S EXTRA :p { :p @:S }", ":S { $:x :p . ; &:x ; $:x :q . }"])
def test_structure_errors(text):
    with pytest.raises(shex.SchemaError):
        shex.load(PRE + text)


def statuses(spark, data, schema, targets, **kw):
    g = rdf.from_string(spark, TTL + data)
    fixed = shapemap.fix(g, shapemap.parse(targets, {"": "http://e/"}))
    rows = shapemap.results(shex.Validator(g, shex.load(PRE + schema, **kw)).validate(fixed.select("node", "shape"))).collect()
    return {(r["node"].removeprefix("<http://e/").removesuffix(">"), r["shape"].removeprefix("http://e/")): r["status"] == "conformant" for r in rows}


CASES = {
    "recursion": (":a :n 'A' ; :k :b . :b :n 'B' ; :k :a . :c :n 5 ; :k :a . :d :n 'D' ; :k :c .", ":S { :n xsd:string ; :k @:S* }", {"a": True, "b": True, "c": False, "d": False}),
    "recursion through an anonymous shape": (":a :k _:x . _:x :l :b . :b :k _:y . _:y :l :c . :c :k _:z . _:z :l :d . :d :n 1 . :e :k _:w . _:w :l :f . :f :k _:v . _:v :l :e .", ":S { :k { :l @:S ; :n .{0} }? ; :n .{0} }", {x: x in "ef" for x in "abcdef"}),
    "extra": (":a :p 1, 2 . :b :p 2, 3 . :c :p 1, 1.0 .", ":S EXTRA :p { :p [1] }", {"a": True, "b": False, "c": True}),
    "closed": (":a :p 1 . :b :p 1 ; :q 2 .", ":S CLOSED { :p . }", {"a": True, "b": False}),
    "open ignores others": (":a :p 1 ; :q 2 . :b :q 2 .", ":S { :p . }", {"a": True, "b": False}),
    "choice": (":a :p 1 . :b :q 1 ; :r 2 . :c :p 1 ; :q 1 .", ":S { :p . | :q . ; :r . }", {"a": True, "b": True, "c": False}),
    "groups": (":a :p 1, 2 ; :q 1, 2 . :b :p 1, 2 ; :q 1 .", ":S { (:p . ; :q .){2} }", {"a": True, "b": False}),
    "assignment": (":a :p 1, 2 . :b :p 1, 3 . :c :p 2, 3 .", ":S { :p [1 2] ; :p [2 3] }", {"a": True, "b": True, "c": True}),
    "facets": (':a :p "abc" . :b :p "ab" . :c :p "abd" .', ":S { :p LITERAL LENGTH 3 /c$/ }", {"a": True, "b": False, "c": False}),
    "numbers": (":a :p 5 . :b :p 5.5 . :c :p 4 . :d :p 'x' .", ":S { :p MINEXCLUSIVE 4 }", {"a": True, "b": True, "c": False, "d": False}),
    "digits": (":a :p 1.20 . :b :p 1.234 . :c :p 12345 .", ":S { :p TOTALDIGITS 3 FRACTIONDIGITS 2 }", {"a": True, "b": False, "c": False}),
    "stems": (":a :p :xa . :b :p :xb . :c :p 'y'@en-GB . :d :p 'y'@fr .", ":S { :p [ :x~ - :xb @en~ ] }", {"a": True, "b": False, "c": True, "d": False}),
    "not and inverse": (":a :p :b . :c :p 1 .", ":S NOT { ^:p . } AND { :p . }", {"a": True, "c": True, "b": False}),
    "empty shape": (":a :p 1 .", ":S { :q .* }", {"a": True}),
}


@pytest.mark.parametrize("name", CASES)
def test_case(spark, name):
    data, schema, want = CASES[name]
    assert statuses(spark, data, schema, ", ".join(f":{x}@:S" for x in want)) == {(x, "S"): ok for x, ok in want.items()}


def test_start_actions_external_imports(spark):
    assert statuses(spark, ":a :p 1 .", "start = { :p . }", ":a@START") == {("a", "START"): True}
    acts = {"http://e/fail": lambda code: False, "http://e/ok": lambda code: True}
    assert statuses(spark, ":a :p 1 .", ":S { :p . %:fail{ x %} } :T { :p . %:ok% }", ":a@:S, :a@:T", actions=acts) == {("a", "S"): False, ("a", "T"): True}
    ext = {"http://e/S": {"type": "NodeConstraint", "nodeKind": "iri"}}
    assert statuses(spark, ":a :p 1 .", ":S EXTERNAL", ":a@:S", external=ext) == {("a", "S"): True}
    texts = {"http://e/x": PRE + "IMPORT :y :T { :q @:S* }", "http://e/y": PRE + "IMPORT :x :U { }"}
    assert {"http://e/S", "http://e/T", "http://e/U"} <= set(shex.load(PRE + "IMPORT :x :S { :p @:T* }", fetch=texts.__getitem__).shapes)


def test_shape_map_syntax():
    got = shapemap.parse("""{FOCUS a :C}@:S, {_ <http://e/p>/:q* FOCUS}@!START, "x"@en@?:S, :n@_:b""", {"": "http://e/"})
    assert [a.status for a in got] == ["conformant", "nonconformant", "unknown", "conformant"] and got[3].shape == "_:b"
    assert shapemap.parse(", ".join(map(shapemap.show, got[:1])), {"": "http://e/"}) == got[:1]
    assert shapemap.parse('[{"node": "<http://e/a>", "shape": "<http://e/S>"}]')[0].shape == "http://e/S"


def brute(form, bag):
    """Words of the expression up to the bag's size, as sorted tuples of constraint numbers."""
    n = len(bag)

    def words(e):
        kind, body, lo, hi = e
        once = {(body,)} if kind == "t" else set().union(*map(words, body)) if kind == "one" else {tuple(sorted(sum(c, ()))) for c in itertools.product(*map(words, body))}
        out, now = set(), {()}
        for i in range((hi if hi != -1 else n) + 1):
            if i >= lo:
                out |= now
            now = {tuple(sorted(a + b)) for a in now for b in once if len(a) + len(b) <= n}
        return {w for w in out if len(w) <= n}

    return any(tuple(sorted(pick)) in words(form) for pick in itertools.product(*[[i for i in range(3) if m >> i & 1] for m in bag]))


def test_bags_against_brute_force():
    t = [("t", i, 1, 1) for i in range(3)]
    rng = random.Random(5)

    def some(parts, depth):
        form = ("one" if rng.random() < 0.4 else "each", tuple(parts), *(rng.choice([(1, 1), (0, 1), (0, -1), (1, 2), (2, 3)])))
        return form if depth == 0 else some([form, ("t", 2, *rng.choice([(1, 1), (0, -1), (0, 2)]))], 0)

    forms = [some([("t", i, *rng.choice([(1, 1), (0, 1), (0, -1), (1, 2), (2, 2)])) for i in range(2)], rng.randrange(2)) for _ in range(12)]
    forms += [("each", (t[0], ("one", (t[1], t[2]), 0, 2)), 1, 1), ("one", (("each", (t[0], t[1]), 1, -1), ("t", 2, 2, 3)), 1, 2), ("each", (("t", 0, 0, 1), ("each", (t[1], t[2]), 0, -1)), 1, 1)]
    for form in forms:
        for size in range(5):
            for bag in itertools.combinations_with_replacement(range(1, 8), size):
                counted = tuple((m, False, bag.count(m)) for m in sorted(set(bag)))
                assert bags.matches(form, counted) == brute(form, bag), (form, bag)


def test_bags_of_any_size():
    """Nodes of very many arcs cost what others do."""
    a, b = ("t", 0, 0, -1), ("t", 1, 0, -1)
    both = ((1, False, 10**6), (2, False, 10**6), (3, False, 7))
    began = time.time()
    assert bags.matches(("each", (a, b), 1, 1), both)
    assert bags.matches(("each", (("t", 0, 2, 3), ("t", 1, 1, 4)), 1, -1), both) and not bags.matches(("each", (("t", 0, 2, 3), ("t", 1, 5, 9)), 1, -1), both)
    assert bags.matches(("each", (("t", 0, 2, 2), ("t", 1, 2, 2)), 0, -1), ((1, False, 10**6), (2, False, 10**6)))
    assert not bags.matches(("each", (("t", 0, 2, 2), ("t", 1, 2, 2)), 0, -1), ((1, False, 10**6 + 1), (2, False, 10**6 + 1)))
    assert not bags.matches(("one", (("each", (("t", 0, 1, 1), ("t", 1, 1, 1)), 1, 1), ("t", 2, 1, 1)), 0, -1), ((1, False, 10**6), (2, False, 10**6 - 1), (4, False, 5)))
    assert bags.matches(("each", (("t", 0, 1, 1),), 1, 1), ((1, True, 10**6),)) and time.time() - began < 1


def test_bags_with_many_constraints():
    parts = tuple(("t", i, 0, 2) for i in range(70))
    assert bags.matches(("each", parts, 1, 1), (((1 << 70) - 1, False, 140),)) and not bags.matches(("each", parts, 1, 1), (((1 << 70) - 1, False, 141),))


def test_shapes_of_many_constraints(spark):
    data = TTL + " ".join(f":a :p{i} {i} ; :q 1 . :b :p{i} {i} ." for i in range(70)) + " :b :q 'x' . :c :q 1, 2 ."
    g = rdf.from_string(spark, data)
    flat = PRE + ":S { " + " ; ".join(f":p{i} [{i}]" for i in range(70)) + " ; :q xsd:integer }"
    bags_ = PRE + ":S { " + " ; ".join(f":p{i} .?" for i in range(70)) + " ; :q [1] ; :q [1 2] }"
    for schema, want in ((flat, {"a": True, "b": False, "c": False}), (bags_, {"a": False, "b": False, "c": True})):
        fixed = shapemap.fix(g, shapemap.parse("{FOCUS :q _}@:S", {"": "http://e/"})).select("node", "shape")
        assert {r["node"]["lex"][-1]: r["conforms"] for r in shex.Validator(g, shex.load(schema)).validate(fixed).collect()} == want


def test_lint():
    s = shexc.parse(PRE + ":S { :p @_:a ; :q @_:b } _:a { :x . } _:b { :y @_:b* } _:c { }")
    assert lint.usages(s)["_:a"] == 1 and lint.usages(s)["_:b"] == 2 and lint.unused(s) == ["_:c"]
    out = lint.inline(s)
    assert "_:a" not in [x["id"] for x in out["shapes"]] and "_:b" in [x["id"] for x in out["shapes"]]


def test_minimal_language(spark):
    g = rdf.from_string(spark, TTL + ":a :n 'A' ; :k :b . :b :n 'B' ; :k :a . :c :n 5 ; :k :a . :d :n 'D' ; :k :c .")
    shapes = slang.lower(shex.load(PRE + ":S { :n xsd:string ; :k @:S* } :T NOT @:S"))
    targets = shapemap.fix(g, shapemap.parse("{FOCUS :n _}@:S, {FOCUS :n _}@:T", {"": "http://e/"})).select("node", "shape")
    got = {(r["node"][10:11], r["shape"][-1]): r["status"] for r in slang.show(slang.Validator(g, shapes).validate(targets)).collect()}
    assert got == {(x, "S"): s for x, s in zip("abcd", "++--", strict=True)} | {(x, "T"): s for x, s in zip("abcd", "--++", strict=True)}
    with pytest.raises(RecursionError):
        slang.Validator(g, {"x": slang.Not(slang.Ref("x"))})
    with pytest.raises(slang.NotSupported):
        slang.lower(shex.load(PRE + ":S { :p . | :q . }"))


def test_truth_values(spark):
    for a, b in itertools.product(range(4), repeat=2):
        assert slang.merge(a, b) == slang.merge(b, a)
    assert slang.both(slang.CONFORMS, slang.UNKNOWN) == slang.UNKNOWN and slang.both(slang.NOT_CONFORMS, slang.INCONSISTENT) == slang.NOT_CONFORMS
    t = spark.createDataFrame([("n", "s", 1), ("n", "s", 2), ("m", "s", 0), ("m", "s", 1)], "node string, shape string, status int")
    assert {r["node"]: r["status"] for r in slang.merge_typings(t.limit(4)).collect()} == {"n": slang.INCONSISTENT, "m": slang.CONFORMS}


def test_paths_text():
    assert P.text(P.Seq((P.Pred("a"), P.Star(P.Inv(P.Pred("b")))))) == "<a>/((^<b>)*)".replace("((", "((", 1) or P.text(P.Star(P.Pred("b"))) == "<b>*"
    assert iri("x").nt() == "<x>"
