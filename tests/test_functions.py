"""Functions and operators on hand-made rows: NULLs, NaN, empty values, ties, errors."""

import json as json_module
import math
from datetime import datetime
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from sparrel.functions import arrays, bits, datetime as dt, format, json, json_table, jsonpath, numeric, ranges, text, tsearch
from sparrel.operators import aggregate, catalog, dml, joins, rows, window
from sparrel.operators.dml import When
from sparrel.sources import files


@pytest.fixture(scope="module")
def one(spark):
    frame = spark.range(1)
    return lambda *cols: tuple(frame.select(*(c.alias(f"c{k}") for k, c in enumerate(cols))).first())


L = F.lit


def test_numeric(one):
    assert one(numeric.int_div(L(-7), L(2)), numeric.trunc(L(-1.29), 1), numeric.round_even(L(2.5)), numeric.to_int(L(3.5))) == (-3, -1.2, 2.0, 4)
    assert one(numeric.gcd(L(0), L(0)), numeric.gcd(L(-12), L(18)), numeric.lcm(L(4), L(6)), numeric.lcm(L(0), L(3))) == (0, 6, 12, 0)
    assert one(numeric.factorial(L(0)), numeric.factorial(L(30))) == (1, Decimal(math.factorial(30)))
    d = L(Decimal("1.500"))
    assert one(numeric.scale(d), numeric.min_scale(d), numeric.trim_scale(d)) == (3, 1, "1.5")
    e, c, g = one(numeric.erf(L(0.5)), numeric.erfc(L(0.5)), numeric.lgamma(L(5.0)))
    assert (round(e, 6), round(c, 6), round(g, 6)) == (0.5205, 0.4795, 3.178054)
    assert one(numeric.float8send(L(1.0)), numeric.bit_string(L(5), 4)) == ("3ff0000000000000", "0101")
    with pytest.raises(Exception, match="DIVIDE_BY_ZERO"):
        one(numeric.int_div(L(1), L(0)))


def test_text(one):
    n = L(None).cast("string")
    assert one(text.concat(L("a"), n, L("b")), text.initcap(L("ab-cd eF9x")), text.left(L("abc"), -1), text.right(L("abc"), -1), text.left(L("a"), -5)) == ("ab", "Ab-Cd Ef9x", "ab", "bc", "")
    assert one(text.substring(L("abc"), 0, 2), text.substring(L("abc"), -3, 2), text.substring(L("abc"), 2)) == ("a", "", "bc")
    assert one(text.chr_(L(300)), text.ascii_(L("é")), text.ascii_(L("")), text.to_hex(L(255)), text.to_oct(L(8)), text.to_bin(L(5))) == ("Ĭ", 233, 0, "ff", "10", "101")
    assert one(text.regexp_replace(L("aXbX"), "X", "-"), text.regexp_replace(L("aXbX"), "x(.)?", r"<\1>", "gi"), text.regexp_match(L("ab12"), r"([a-z]+)(\d+)"), text.regexp_match(L("x"), r"\d")) == ("a-bX", "a<b><>", ["ab", "12"], None)
    assert one(*(text.similar_to(L("abc"), p) for p in ("abc", "a", "%(b|d)%", "(b|c)%", "a[a-c]_"))) == (True, False, True, False, True)
    assert one(text.quote_literal(L("o'b")), text.quote_nullable(n), text.quote_ident(L("Ab")), text.quote_ident(L("ab"))) == ("'o''b'", "NULL", '"Ab"', "ab")
    assert one(text.format_("%s|%I|%L|%2$s|%-5s|%%", L("x"), L("Y y"), n, L("z"))) == ('x|"Y y"|NULL|Y y|     |%',)
    assert one(text.unistr(L(r"d\0061t\+000061")), text.normalize(L("é"), "NFC"), text.parse_ident(L('Ab."C d".e')), text.crc32c(L("123456789"))) == ("data", "é", ["ab", "C d", "e"], 0xE3069283)
    b = L(b"\x01\x02")
    assert one(text.get_byte(b, 1), text.set_byte(b, 0, 255), text.encode(b, "hex"), text.decode(L("ff"), "hex")) == (2, b"\xff\x02", "0102", b"\xff")


def test_bits(one):
    assert one(bits.bit_and(L("1100"), L("1010")), bits.bit_or(L("1100"), L("1010")), bits.bit_xor(L("1100"), L("1010")), bits.bit_not(L("10"))) == ("1000", "1110", "0110", "01")
    assert one(bits.shift_left(L("1011"), 1), bits.shift_right(L("1011"), 2), bits.bit_count(L("1011")), bits.get_bit(L("10"), 0), bits.set_bit(L("100"), 1, 1)) == ("0110", "0010", 3, 1, "110")
    with pytest.raises(Exception, match="different sizes"):
        one(bits.bit_and(L("1"), L("10")))


def test_arrays(one):
    a, e = F.array(L("x"), L(None), L("z")), F.array().cast("array<string>")
    assert one(arrays.subscript(a, 1), arrays.subscript(a, 9), arrays.subscript(a, 0), arrays.slice_(a, 2, 9), arrays.array_length(e), arrays.array_dims(a)) == ("x", None, None, [None, "z"], None, "[1:3]")
    assert one(arrays.array_to_string(a, ","), arrays.array_to_string(a, ",", "*"), arrays.string_to_array(L("a.b"), "."), arrays.string_to_array(L(""), ","), arrays.string_to_array(L("1,n"), ",", "n")) == ("x,z", "x,*,z", ["a", "b"], [], ["1", None])


def test_datetime(one):
    t = lambda s: L(s).cast("timestamp_ntz")
    got = one(dt.age(t("2001-04-10 00:00:00"), t("1957-06-13 00:00:00")), dt.age(t("2020-03-31 10:00:00"), t("2020-02-29 12:00:00")), dt.age(t("1957-06-13 00:00:00"), t("2001-04-10 00:00:00")))
    assert [tuple(g) for g in got] == [(43 * 12 + 9, 27, 0), (1, 1, 22 * 3_600_000_000), (-(43 * 12 + 9), -27, 0)]
    assert [tuple(x) for x in one(dt.justify_hours(dt.interval(0, 1, 27 * 3_600_000_000)), dt.justify_days(dt.interval(0, 35, 0)), dt.justify_interval(dt.interval(1, 0, -3_600_000_000)))] == [(0, 2, 3 * 3_600_000_000), (1, 5, 0), (0, 29, 23 * 3_600_000_000)]
    assert one(dt.to_char(t("2024-03-05 14:07:09"), "YYYY-MM-DD HH24:MI:SS"), dt.dow(t("2024-03-03 00:00:00")), dt.add(t("2024-01-31 12:00:00"), dt.interval(1, 1, 0))) == ("2024-03-05 14:07:09", 0, datetime(2024, 3, 1, 12))
    assert str(one(dt.to_date(L("05 Mar 2024"), "DD Mon YYYY"))[0]) == "2024-03-05"


@pytest.mark.parametrize(
    ("value", "template", "want"),
    [("1234.5", "9,999.99", " 1,234.50"), ("-1234.5", "9,999.99", "-1,234.50"), ("0.1", "0.9", " 0.1"), ("-0.1", "99.99", "  -.10"), ("0.1", "FM9.99", ".1"), ("485", "999", " 485"), ("-485", "999", "-485"), ("485", "9 9 9", " 4 8 5"), ("485", "RN", "        CDLXXXV"), ("5", "FMRN", "V"), ("482", "999th", " 482nd"), ("-485", "999S", "485-"), ("-485", "999MI", "485-"), ("485", "999MI", "485 "), ("485", "PL999", "+485"), ("-485", "999PR", "<485>"), ("485", "999PR", " 485 "), ("12.4", "99V999", " 12400"), ("12345", "999", " ###"), ("0.0004859", "9.99EEEE", " 4.86e-04"), ("12", "0000", " 0012")],
)
def test_to_char(value, template, want):
    assert format.number_text(Decimal(value), template) == want


def test_to_number(one):
    assert one(format.to_number(L("-12,454.8"), "S99G999D9", "double"), format.to_number(L("<12>"), "99PR", "double"), format.to_number(L("MCMXCIX"), "RN", "int")) == (-12454.8, -12.0, 1999)
    assert [format.roman(n) for n in (0, 4, 1999, 4000)] == ["#" * 15, "IV", "MCMXCIX", "#" * 15]


def test_ranges(one):
    r = lambda a, b, k="[)": ranges.discrete(L(a), L(b), k)
    assert one(ranges.to_text(r(1, 5, "(]")), ranges.to_text(r(3, 3)), ranges.to_text(r(None, 3)), ranges.contains(r(1, 3), L(3)), ranges.contains(r(1, None), L(99))) == ("[2,6)", "empty", "(,3)", False, True)
    assert one(ranges.overlaps(r(1, 3), r(3, 5)), ranges.adjacent(r(1, 3), r(3, 5)), ranges.before(r(1, 3), r(3, 5)), ranges.contains_range(r(1, 9), r(2, 3)), ranges.contains_range(r(2, 3), r(5, 5))) == (False, True, True, True, True)
    assert one(ranges.to_text(ranges.union(r(1, 3), r(3, 5))), ranges.to_text(ranges.intersect(r(1, 4), r(3, 9))), ranges.to_text(ranges.minus(r(1, 9), r(5, 20))), ranges.to_text(ranges.merge(r(1, 2), r(8, 9)))) == ("[1,5)", "[3,4)", "[1,5)", "[1,9)")
    for bad in (ranges.union(r(1, 2), r(5, 6)), ranges.minus(r(1, 9), r(3, 4)), r(5, 1)):
        with pytest.raises(Exception, match="range"):
            one(bad)
    m = F.array(r(5, 7), r(1, 3), r(2, 4), r(9, 9))
    assert one(ranges.multi_text(ranges.normalize(m)), ranges.multi_text(ranges.multi_intersect(m, F.array(r(3, 6)))), ranges.multi_contains(m, L(6))) == ("{[1,4),[5,7)}", "{[3,4),[5,6)}", True)


def test_json(one):
    j = L('{"a": [1, {"b": null}], "c": "x", "n": 2.0}')
    assert one(json.field_text(j, "c"), json.path_text(j, "a", 0), json.has_key(j, "a"), json.has_any(j, "q", "c"), json.has_all(j, "a", "q"), json.typeof(L("[1]"))) == ("x", "1", True, True, False, "array")
    holds = lambda b: json.contains(j, L(b))
    assert one(holds('{"n": 2}'), holds('{"a": [{}]}'), holds('{"a": 1}'), holds("{}"), json.contains(L("[1, 2]"), L("1")), json.contains(j, L(None).cast("string"))) == (True, True, False, True, True, None)
    assert one(json.canonical(L('{"bb": 1, "a": 2, "a": 3}')), json.build_object(x=L(1), y=L(None).cast("int")), json.is_json(L("{")), json.is_json(L("1"))) == ('{"a": 3, "bb": 1}', '{"x":1,"y":null}', False, True)


@pytest.mark.parametrize(
    ("value", "path", "want"),
    [
        ({"a": [1, 2, 3]}, "$.a[*] ? (@ > 1)", [2, 3]), ({"a": [1, 2, 3]}, "$.a[last]", [3]), ({"a": [1, 2, 3]}, "$.a[0 to 1, 2]", [1, 2, 3]), ([{"a": 1}, {"a": 2}], "$.a", [1, 2]), ({"a": {"b": {"b": 1}}}, "$.**.b", [{"b": 1}, 1]),
        ({"a": {"b": 1}}, "$.**{1}", [{"b": 1}]), ({"x": 3}, "$.x + 2 * 4", [11]), ({"x": -3}, "-$.x", [3]), ({"a": "abc"}, '$.a ? (@ starts with "ab")', ["abc"]), ({"a": "aBc"}, '$.a ? (@ like_regex "^ab" flag "i")', ["aBc"]),
        ([1, "x", None, True], '$[*] ? (@.type() == "string")', ["x"]), ({"a": []}, "$.a.size()", [0]), ({"k": 1, "m": 2}, "$.keyvalue().key", ["k", "m"]), ([1.7, -2.2], "$[*].floor()", [1, -3]), ({"a": 1}, "exists($.a) && !exists($.b)", [True]),
        ({"a": 1}, '($.a > "x") is unknown', [True]), ({"a": "12"}, "$.a.integer()", [12]), ({"a": "a,b"}, '$.a.split_part(",", 2)', ["b"]), ({"a": 1}, "$.b", []), ([1, 2], "$ ? (@ > 1)", [2]), ({"d": "2024-01-02T03:04:05"}, "$.d.date()", ["2024-01-02"]),
    ],
)
def test_jsonpath(value, path, want):
    assert jsonpath.query(value, path) == want


def test_jsonpath_modes(one):
    with pytest.raises(jsonpath.PathError):
        jsonpath.query({"a": 1}, "strict $.b")
    with pytest.raises(jsonpath.PathError):
        jsonpath.query({}, "$.a +")
    assert jsonpath.query([{"x": 5}], "$[*].x ? (@ > $low)", {"low": 4}) == [5]
    j = L('{"a": [1, 2], "s": "5"}')
    assert one(jsonpath.json_value(j, "$.s", "int"), jsonpath.json_value(j, "$.a", on_error="e"), jsonpath.json_value(j, "$.z", on_empty="none"), jsonpath.json_query(j, "$.a[*]", True), jsonpath.json_query(j, "$.s", quotes=False)) == (5, "e", "none", "[1, 2]", "5")


def test_json_table(spark):
    df = spark.createDataFrame([(1, '[{"a":1,"b":[{"c":1},{"c":2}],"d":["x"]},{"a":"q"}]'), (2, None), (3, "broken")], "id int, j string")
    cols = [json_table.Ordinality("o"), json_table.Value("a", "int", on_empty="0"), json_table.Nested("$.b[*]", [json_table.Value("c", "int")]), json_table.Nested("$.d[*]", [json_table.Value("d", path="$")])]
    assert sorted((tuple(r)[2:] for r in json_table.json_table(df, "j", "$[*]", cols).collect()), key=repr) == [(1, 1, 1, None), (1, 1, 2, None), (1, 1, None, "x"), (2, None, None, None)]


def test_text_search(one):
    stems = {"running": "run", "ponies": "poni", "relational": "relat", "conditional": "condit", "hopping": "hop", "falling": "fall", "agreed": "agre", "generously": "generous", "skies": "sky", "national": "nation", "happily": "happili", "cats": "cat", "abilities": "abil"}
    assert {w: tsearch.stem(w) for w in stems} == stems
    v = tsearch.to_tsvector(L("The fat cats sat on fat mats"))
    hit = lambda q: tsearch.matches(v, tsearch.parse_query(q))
    assert one(tsearch.to_text(v), hit("fat & cat"), hit("fat <-> cat"), hit("cat <-> fat"), hit("sat <2> fat"), hit("ma:*"), hit("!dog & (rat | mat)"), hit("the")) == ("'cat':3 'fat':2,6 'mat':7 'sat':4", True, True, False, True, True, True, False)
    assert tsearch.plain_query("The fat cats") == ("&", ("w", "fat", False, ""), ("w", "cat", False, ""))
    assert tsearch.phrase_query("cats of the world") == ("<->", ("w", "cat", False, ""), ("w", "world", False, ""), 3)
    assert tsearch.web_query('"fat cat" or dog -mouse')[0] == "&"
    assert abs(one(tsearch.ts_rank(v, tsearch.parse_query("fat")))[0] - 0.0759909) < 1e-6
    rime = tsearch.to_tsvector(L("""Day after day, day after day,
  We stuck, nor breath nor motion,
As idle as a painted Ship
  Upon a painted Ocean.
Water, water, every where
  And all the boards did shrink;
Water, water, every where,
  Nor any drop to drink."""))
    for query, value in (("paint & water", 0.05), ("breath & motion & water", 0.008333334), ("ocean", 0.1), ("painted <-> Ship", 0.1)):
        assert abs(one(tsearch.ts_rank_cd(rime, tsearch.parse_query(query)))[0] - value) < 1e-7
    assert one(tsearch.ts_rank_cd(tsearch.strip(v), tsearch.parse_query("fat & cat")))[0] == 0
    for query in ("fat & cats", "cats <-> sat", "sat <2> fat", "ma:*", "!dog & (rat | mats)", "(fat | the) <-> cats"):
        q = tsearch.parse_query(query, "simple")
        assert one(tsearch.text_matches(L("The fat cats sat on fat mats"), q)) == one(tsearch.matches(tsearch.to_tsvector(L("The fat cats sat on fat mats"), "simple"), q))
    a = tsearch.setweight(v, "A")
    assert one(tsearch.matches(a, tsearch.parse_query("cat:A")), tsearch.matches(v, tsearch.parse_query("cat:A")), F.size(tsearch.delete(v, "cat")), F.size(tsearch.strip(v)[0]["positions"])) == (True, False, 3, 0)


def test_joins(spark):
    a = spark.createDataFrame([(1, "a"), (None, "n"), (3, "c")], "k int, x string")
    b = spark.createDataFrame([(1, "A"), (None, "N"), (4, "D")], "k int, y string")
    assert sorted(map(tuple, joins.full_using(a, b, ["k"]).collect()), key=repr) == sorted([(1, "a", "A"), (None, "n", None), (3, "c", None), (None, None, "N"), (4, None, "D")], key=repr)
    assert joins.natural(a, b, "full").count() == 5 and joins.natural(a.select("x"), b.select("y")).count() == 9
    p = spark.createDataFrame([(0.0,), (5.0,), (None,)], "p double")
    r = spark.createDataFrame([(0.0, 5.0), (4.0, 4.0), (None, 9.0)], "lo double, hi double")
    assert sorted(map(tuple, joins.range_join(p, r, "p", "lo", "hi", 2.0).collect())) == [(0.0, 0.0, 5.0), (5.0, 0.0, 5.0)]
    n = spark.createDataFrame([(1,), (None,)], "v int")
    assert joins.all_of(a, "k", n, "v", ">").count() == 0 and joins.all_of(a, "k", n.limit(0), "v", ">").count() == 3 and joins.any_of(a, "k", n, "v", ">").count() == 1
    # NaN and -0 as keys
    f = spark.createDataFrame([(float("nan"),), (-0.0,)], "k double")
    assert f.join(spark.createDataFrame([(float("nan"),), (0.0,)], "k double"), "k").count() == 2


def test_aggregates(spark):
    df = spark.createDataFrame([(1, None, 2), (1, "b", 1), (2, None, None)], "g int, x string, o int")
    got = {r["g"]: tuple(r)[1:] for r in df.groupBy("g").agg(aggregate.array_agg(F.col("x"), F.col("o")), aggregate.string_agg(F.col("x"), ",", F.col("o")), aggregate.json_agg(F.col("x"), F.col("o"))).collect()}
    assert got == {1: (["b", None], "b", '["b",null]'), 2: ([None], None, "[null]")}
    v = spark.createDataFrame([(1,), (3,), (3,), (7,), (None,)], "x int")
    kinds = ("rank", "dense_rank", "percent_rank", "cume_dist")
    got = v.filter("x IS NOT NULL").agg(*(aggregate.hypothetical(k, 3, F.col("x")) for k in kinds)).first()
    assert tuple(got) == (2, 2, 0.25, 0.8)
    none = v.limit(0).agg(*(aggregate.hypothetical(k, 3, F.col("x")) for k in kinds)).first()
    assert tuple(none) == (1, 1, 0.0, 1.0)
    r = spark.createDataFrame([("k", 1, 3), ("k", 2, 5), ("k", 5, 6), ("k", 8, 9), ("k", 4, 4)], "k string, lo int, hi int")
    assert sorted(map(tuple, aggregate.range_agg(r, ["k"], "lo", "hi").collect())) == [("k", 1, 6), ("k", 8, 9)]
    assert v.agg(aggregate.mode(F.col("x")), aggregate.variance_exact(F.col("x"))).first()[0] == 3


def test_frames(spark):
    df = spark.createDataFrame([("p", k, v) for k, v in enumerate([10, 20, 20, 30, None])], "p string, k int, v int")
    got = {r["k"]: r["n"] for r in window.over_groups(df, ["p"], [F.col("v").asc_nulls_last()], -1, 0, n=F.count("*")).collect()}
    assert got == {0: 1, 1: 3, 2: 3, 3: 3, 4: 2}
    for exclude, want in (("group", {1: (10 + 30, 2), 4: (90 - 10 - 20, 2)}), ("ties", {1: (10 + 20 + 30, 3)})):
        out = {r["k"]: (r["sum"], r["count"]) for r in window.over_excluding(df, ["p"], [F.col("v").asc_nulls_last()], [F.col("k")], -2, 2, exclude, "v", "sum", "count").collect()}
        assert {k: out[k] for k in want} == (want if exclude == "ties" else {1: (40, 2), 4: (50, 2)})


def test_rows(spark):
    df = spark.createDataFrame([(1, 3), (1, 1), (None, 2), (None, 5)], "k int, v int")
    assert sorted(map(tuple, rows.distinct_on(df, ["k"], [F.asc("v")]).collect()), key=repr) == [(1, 1), (None, 2)]
    s = spark.range(1).select(rows.generate_series(1, 5, 2).alias("a"), rows.generate_series(5, 1).alias("b"), rows.generate_series(3, 1, -1).alias("c")).first()
    assert tuple(s) == ([1, 3, 5], [], [3, 2, 1])
    with pytest.raises(Exception, match="zero"):
        spark.range(1).select(rows.generate_series(1, 2, 0)).collect()
    e = spark.createDataFrame([(1, 2), (2, 3), (3, 1)], "a int, b int")
    closure = rows.recursive(e, lambda new: new.alias("t").join(e.alias("e"), F.col("t.b") == F.col("e.a")).select(F.col("t.a"), F.col("e.b")))
    assert closure.count() == 9
    with pytest.raises(RuntimeError):
        rows.recursive(e.limit(1), lambda new: new.select(F.col("a") + 1, "b"), most=3).count()


def test_merge(spark):
    t = spark.createDataFrame([(1, 10), (2, 20), (3, 30)], "k int, v int")
    s = spark.createDataFrame([(2, 5), (4, 40)], "k int, w int")
    whens = [When(True, "update", None, {"v": F.col("t.v") + F.col("s.w")}), When(False, "insert", None, {"k": F.col("s.k"), "v": F.col("s.w")}), When("source", "delete", F.col("t.k") == 1)]
    new, acts = dml.merge(t, s, ["k"], whens)
    assert sorted(map(tuple, new.collect())) == [(2, 25), (3, 30), (4, 40)]
    assert sorted(r["merge_action"] for r in acts.collect()) == ["DELETE", "INSERT", "UPDATE"]
    with pytest.raises(Exception, match="second time"):
        dml.merge(t, s.unionAll(s), ["k"], whens)[0].collect()
    new, _ = dml.merge(t, s.unionAll(s), ["k"], [When(True, "nothing")])
    assert sorted(map(tuple, new.collect())) == [(1, 10), (2, 20), (3, 30)]


def test_constraints(spark):
    t = spark.createDataFrame([(1, 1), (1, 2), (None, 3), (None, 4)], "k int, v int")
    assert [tuple(r) for r in dml.unique_violations(t, ["k"]).collect()] == [(1, 2)]
    assert dml.unique_violations(t, ["k"], nulls_distinct=False).count() == 2
    parent = spark.createDataFrame([(2,)], "id int")
    assert dml.fk_violations(t, parent, {"k": "id"}).count() == 2
    gone = spark.createDataFrame([(1,)], "id int")
    assert dml.fk_cascade(t, gone, {"k": "id"}).count() == 2
    assert dml.fk_cascade(t, gone, {"k": "id"}, "set null").filter("k IS NULL").count() == 4
    for bad in (dml.check(t, F.col("v") < 4), dml.not_null(t, "k"), dml.fk_cascade(t, gone, {"k": "id"}, "restrict")):
        with pytest.raises(Exception, match="violates"):
            bad.collect()
    assert [r["op"] for r in dml.diff(t.filter("k = 1 AND v = 1"), t.filter("v = 3").fillna(1).filter("k = 1"), ["k"]).collect()] == ["UPDATE"]
    stats = {r["column_name"]: r for r in dml.analyze(t, ["k", "v"]).collect()}
    assert stats["k"]["null_frac"] == 0.5 and stats["k"]["n_distinct"] == 1 and stats["v"]["n_distinct"] == 4
    assert stats["k"]["most_common_vals"] == ["1"] and stats["k"]["most_common_freqs"] == [0.5] and stats["v"]["histogram_bounds"][0] == "1" and stats["v"]["histogram_bounds"][-1] == "4"


def test_catalog(spark):
    df = spark.createDataFrame([(k, k % 3) for k in range(50)], "a int, b int")
    assert sorted(r["id"] for r in catalog.with_serial(df, "id", [F.col("a")]).collect()) == list(range(1, 51))
    pos = catalog.Domain("int", True, [lambda x: x > 0])
    assert df.filter("a > 0").select(pos(F.col("a"))).count() == 49
    with pytest.raises(Exception, match="domain"):
        df.select(pos(F.col("a"))).collect()
    own = [catalog.Policy({"ann"}, F.col("b") == 1), catalog.Policy({"public"}, F.col("a") > 10, permissive=False)]
    assert catalog.visible(df, "ann", own).count() == 13 and catalog.visible(df, "bob", own).count() == 0
    q = catalog.Sequence(most=2)
    assert (q.nextval(), q.nextval(), q.currval()) == (1, 2, 2)
    with pytest.raises(OverflowError):
        q.nextval()
    assert tuple(spark.range(1).select(catalog.type_name(L(1)), catalog.input_is_valid(L("x"), "int"), catalog.size_pretty(L(20000))).first()) == ("integer", False, "20 kB")


def test_copy(spark, tmp_path):
    df = spark.createDataFrame([(1, "a,b"), (2, None), (3, 'q"x'), (4, "")], "k int, s string")
    for fmt in ("csv", "text"):
        path = str(tmp_path / fmt)
        files.copy_to(df, path, fmt, header=fmt == "csv")
        back = files.copy_from(spark, path, "k int, s string", fmt, header=fmt == "csv")
        assert sorted(map(tuple, back.collect())) == [(1, "a,b"), (2, None), (3, 'q"x'), (4, "")]
    with pytest.raises(Exception):  # noqa: B017
        files.copy_from(spark, path, "k int, s int", "text").collect()
    assert files.values(spark, [(1, "x")]).columns == ["column1", "column2"]


def test_streams(spark, tmp_path):
    from sparrel.streaming.changes import apply_changes, current, sessions, tumbling

    src = str(tmp_path / "in")
    spark.createDataFrame([(1, datetime(2024, 1, 1, 0, 0), 5), (1, datetime(2024, 1, 1, 0, 50), 6), (2, datetime(2024, 1, 1, 3, 0), 7)], "k int, ts timestamp, v int").write.parquet(src)
    stream = spark.readStream.schema("k int, ts timestamp, v int").parquet(src)
    for name, out in (("t", tumbling(stream, "ts", "1 hour", "1 minute", ["k"], n=F.count("*"))), ("s", sessions(stream, "ts", "30 minutes", "1 minute", ["k"], n=F.count("*")))):
        q = out.writeStream.format("memory").queryName(f"q_{name}").outputMode("complete" if name == "t" else "append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / name)).start()
        q.awaitTermination(60)
    assert sorted(r["n"] for r in spark.table("q_t").collect()) == [1, 2]
    q = stream.writeStream.foreachBatch(apply_changes(str(tmp_path / "table"), ["k"], ["v"], ["ts"])).trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start()
    q.awaitTermination(60)
    assert sorted(tuple(r) for r in current(spark, str(tmp_path / "table"), ["k"], 0).collect()) == [(1, 6), (2, 7)]


def test_changes_by_batch(spark, tmp_path):
    """The last change of each key counts; whole versions are written now and then; a batch may run twice."""
    from sparrel.streaming.changes import apply_changes, current

    path, want = str(tmp_path / "t"), {}
    run = apply_changes(path, ["k"], ["v"], ["at"], compact_every=3)
    for number in range(8):
        batch = [(k % 4 if number < 4 else k % 6, number * 10 + k, k) for k in range(7)]
        want |= dict((k, v) for k, v, _ in batch)
        rows = spark.createDataFrame(batch, "k int, v int, at int").orderBy(F.desc("v"))
        run(rows, number)
        run(rows, number)
        assert dict(tuple(r) for r in current(spark, path, ["k"], number, 3).collect()) == want


def test_conflicts_and_updates_with_repeated_and_null_keys(spark):
    t = spark.createDataFrame([(1, "a"), (None, "n")], "k int, v string")
    rows = spark.createDataFrame([(1, "x"), (1, "y"), (2, "z"), (2, "w"), (None, "p"), (None, "q")], "k int, v string")
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    assert sorted(map(tuple, dml.upsert(t, rows, ["k"]).collect()), key=key) == [(1, "a"), (2, "w"), (None, "n"), (None, "p"), (None, "q")]
    for action in ("update", "select"):
        with pytest.raises(Exception, match="cannot affect row a second time"):
            dml.on_conflict(t, rows, ["k"], action, {"v": F.col("s.v")})[0].collect()
    one = rows.filter("v <> 'y' AND v <> 'z'")
    table, told = dml.on_conflict(t, one, ["k"], "update", {"v": F.concat("t.v", "s.v")})
    assert sorted(map(tuple, table.collect()), key=key) == [(1, "ax"), (2, "w"), (None, "n"), (None, "p"), (None, "q")]
    assert sorted(((r["old"] or (None, None))[1] or "", r["new"][1]) for r in told.collect()) == [("", "p"), ("", "q"), ("", "w"), ("a", "ax")]
    table, told = dml.on_conflict(t, one, ["k"], "select", where=F.col("t.v") == "b")
    assert table.count() == 5 and told.count() == 3
    assert sorted(map(tuple, dml.update_from(t, rows, ["k"], {"v": F.col("s.v")}).collect()), key=key) == [(1, "x"), (None, "n")]
    assert dml.delete_returning(t, rows, ["k"])[1].count() == 1
    with pytest.raises(ValueError, match="non-DEFAULT"):
        dml.insert(t, rows, always=("k",))
    assert dml.truncate(t).count() == 0 and dml.on_conflict(t.limit(0), rows.limit(0), ["k"], "update")[0].count() == 0


def test_plain_paths_as_columns_equal_the_evaluator(spark):
    from sparrel.functions import jsonpath_columns

    docs = ['{"a": {"b": [1, 2.5, "x", null]}, "k": 7}', '{"a": [{"b": 3}, {"b": "y"}, 4], "k": [5, 60]}', "[1, 2, 3]", "5", '"k"', "null", "{}", '{"k": null}', '{"k": "7"}', '{"k": {"k": 8}}', None, '{"a": [[{"b": 1}]], "k": true}', '{"k": 1e3}']
    rows = spark.createDataFrame([(d,) for d in docs], "j string")
    for path in ("$", "$.a", "$.a.b", "$.a[0].b", "$.a[*].b", "$.a.b[1]", '$."k"', "$.k[0]", "$[1]", "$.k[1]", "$ ? (@ > 2)", "$.k ? (@ > 6)", '$.a.b ? (@ == "x")', "$.a.b ? (@ != 1)", "$ ? (@.k >= 7)", "$.a[*] ? (@.b < 3.5)", "$.k.k", "lax $.z"):
        assert jsonpath_columns.columns(path) is not None
        got = [r[0] for r in rows.select(jsonpath.path_exists(F.col("j"), path)).collect()]
        assert got == [None if d is None else bool(jsonpath.query(json_module.loads(d), path)) for d in docs], path
    for path in ("$.k == 7", "$.k > 6", '$.k == "7"', "$.a.b != 3", "$.k <= 60.5", "$ == 5"):
        assert jsonpath_columns.comparison(path) is not None
        want = [None if d is None else (lambda x: x[0] if len(x) == 1 and isinstance(x[0], bool) else None)(jsonpath.query(json_module.loads(d), path)) for d in docs]
        assert [r[0] for r in rows.select(jsonpath.path_match(F.col("j"), path)).collect()] == want, path
    for path in ("strict $.a", "$.a.size()", "$.**", "$.a[last]", "$.k ? (@ > $v)", "$.k ? (@ > 1 && @ < 3)", "$.k ? (exists (@.a))"):
        assert jsonpath_columns.columns(path) is None
    for path in ("$.k ? (@ > 6)", "$.a[last].b", "$.k"):
        assert [r[0] for r in rows.select(jsonpath.path_values(F.col("j"), path, "int")).collect()][0] in ([7], [])


@pytest.mark.parametrize("few", [0, 6, 10**6])
def test_recursion_in_buckets_or_not(spark, monkeypatch, few):
    """The closure of a graph with a cycle and a NULL, however many rows are joined as they were written."""
    monkeypatch.setattr(rows, "FEW_SEEN", few)
    e = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 4), (7, None), (None, 1), (8, 8)], "a int, b int")
    got = rows.recursive(e, lambda new: new.alias("t").join(e.alias("e"), F.col("t.b").eqNullSafe(F.col("e.a"))).select(F.col("t.a"), F.col("e.b"))).collect()
    edges = {(r["a"], r["b"]) for r in e.collect()}
    want = set(edges)
    while more := {(a, d) for a, b in want for c, d in edges if b == c} - want:
        want |= more
    assert len(got) == len(want) and {(r["a"], r["b"]) for r in got} == want
    with pytest.raises(RuntimeError):
        rows.recursive(e.limit(1), lambda new: new.select(F.col("a") + 1, "b"), most=3)
