import pytest

from fathom.plans.index import FIXTURES
from fathom.sources.go_files import PathProblem, check_path, list_files
from fathom.sources.go_parser import parse_go


def by_name(result):
    return {s["name"]: s for s in result.symbols}


def test_declarations_of_a_file():
    r = parse_go(open(f"{FIXTURES}/order.go").read())
    s = by_name(r)
    assert (r.package, r.errors) == ("shop", [])
    assert r.imports == [("context", ""), ("strings", "str"), ("embed", "_")]
    assert s["OrderAggregate"]["signature"] == "type OrderAggregate struct { ... } // 5 fields"
    assert s["OrderRepository"]["signature"] == "type OrderRepository interface { ... } // 2 methods"
    assert s["Total"]["signature"] == "func (*OrderAggregate) Total(rate float64, extra ...Money) (sum Money, err error)"
    assert (s["Total"]["kind"], s["Total"]["receiver"], s["Total"]["start_line"], s["Total"]["end_line"]) == ("method", "OrderAggregate", 34, 41)
    assert s["NewOrder"]["signature"] == "func NewOrder(id int64, opts map[string]chan T, cb func(...)) *OrderAggregate"
    assert s["meta"]["signature"] == "meta map[string]*Money" and s["meta"]["receiver"] == "OrderAggregate"
    assert "fmtState" in s and s["local"]["kind"] == "struct" and s["step"]["kind"] == "const"
    assert s["x"]["start_col"] == s["y"]["start_col"] and s["untyped"]["signature"] == "untyped"
    assert s["OrderItemVO"]["doc_comment"] == "OrderItemVO is one line."


@pytest.mark.parametrize(
    "source, package, names",
    [
        ("package depot\n\ntype Crate struct {\n\tWeight int\n\tLabel string\n\nvar limit = 4\n", "depot", {"Crate"}),
        ("package depot\n\ntype Shelf interface {\n\tPut(c Crate\n}\n\ntype Lamp struct {\n\tWatts uint8\n}\n", "depot", {"Lamp"}),
        ("package depot\n\nvar note = `never closed\n\nfunc Lost() {}\n", "depot", set()),
        ("package depot\n\nfunc (d *Dock Load() {\n}\n\nfunc Unload(n int) error { return nil }\n", "depot", {"Unload"}),
        ("package depot\n\nfunc Weigh() { x := [3}int{} }\n\nconst Tare = 7\n", "depot", {"Tare"}),
        ("", "", set()),
    ],
)
def test_what_is_sound_survives_an_error(source, package, names):
    r = parse_go(source)
    assert r.package == package and names <= by_name(r).keys()
    assert len(r.errors) == 1 and "syntax error" in r.errors[0]


def test_discovery():
    names = [p.removeprefix(FIXTURES + "/") for p in list_files(FIXTURES)]
    assert names == sorted(names) and "_blank.go" in names and "order_test.go" in names and "vendor/dep/dep.go" not in names
    assert "vendor/dep/dep.go" in list_files(FIXTURES, vendor=True)[-1]
    assert not any(p.endswith("_test.go") for p in list_files(FIXTURES, tests=False))


def test_paths(tmp_path):
    assert check_path(FIXTURES) == FIXTURES
    for bad in ("", "relative", str(tmp_path / "none"), str(tmp_path)):
        with pytest.raises(PathProblem):
            check_path(bad)
