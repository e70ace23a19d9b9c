import sys

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from factlake.functions import flatten as flattening
from factlake.functions import values
from factlake.functions.classify import Policy
from factlake.functions.flatten import TreeError, flat_batch, flatten, read_tree
from factlake.functions.values import MAX_DEPTH, Number, _scan, decode, encode, equality_key, measured, members, type_of, value_hash, wire_size
from factlake.model import Settings

# Digests derived from the encoding: a tag, an 8-byte length, the bytes.
GOLDEN = {
    "1": "96b3ec75dfa477f1612ac7bb3762baecac6012783874aeab580aeddbf1816c46",
    '"1"': "393d93d857e3fe04dcf387f143da964eddb029ec0ced66e9cf1ea248327e7fb6",
    "1.0": "fda709c827443a2c61fbace939cc3e8a23336890f3fd2aec3ba4ab5543f734a0",
    "1.00": "0c18cd6d1ea73a502a281ab3a9fa5ecede16e86615e6efd80f02a1c958beb9ad",
    "true": "0ffaac099f9b22205f96928a311ab077b5b9a4fdecc11660663ddf04b19493d5",
    "null": "1b16b1df538ba12dc3f97edbb85caa7050d46c148134290feba80f8236c83db9",
    "[]": "63d63c64950f7d33cf10e33ecc46a9d76de68153d6c143b450c94aeb1c59479c",
    "{}": "5a3590fbe3ffbfe0a65167de3111dcd0cde5e8025d0fc5db3aec6ee0f4cedcfb",
    '"Debian"': "d3a7d29adf3d5b0c98c9bb8bbde6fc85cac2abbd7a31e3639b2265d33f9079fb",
    '{"b":2,"a":1}': "f05dc52b6b839125f8f7763c2b01d8caf3a96bdbdb6146732a35c5cfda68fd9a",
}


@pytest.mark.parametrize("text", GOLDEN)
def test_golden_digests(text):
    assert value_hash(decode(text)).hex() == GOLDEN[text]


literals = st.sampled_from(["7", "7.0", "70e-1", "-7", "0", "-0", "0.0", "7E0"]).map(Number)
typed = st.recursive(st.none() | st.booleans() | literals | st.sampled_from(["7", "7.0", "", "true", "null", "[]"]), lambda x: st.lists(x, max_size=2) | st.dictionaries(st.sampled_from(["", "a", "b"]), x, max_size=2), max_leaves=4)


def shape(value):
    """What durable equality goes by: types and literals, all the way down."""
    if isinstance(value, list):
        return ("array", *map(shape, value))
    if isinstance(value, dict):
        return ("object", *((k, shape(value[k])) for k in sorted(value)))
    return type_of(value), str(value)


@settings(max_examples=400, deadline=None)
@given(typed, typed)
def test_digests_are_equal_where_type_and_literal_are(a, b):
    assert (value_hash(a) == value_hash(b)) == (shape(a) == shape(b))


def test_lengths_part_neighbours():
    assert len({value_hash(decode(t)) for t in ('["12","3"]', '["1","23"]', '["123"]', '"123"', "[123]", "[12,3]")}) == 6


def test_equality_keys_go_by_number():
    assert len({equality_key(decode(t)) for t in ("1", "1.0", "1.00", "10e-1", "0.1e1")}) == 1
    assert len({equality_key(decode(t)) for t in ("1", '"1"', "10", "-1", "true", "null", "0")}) == 7
    assert equality_key(decode("0")) == equality_key(decode("-0.00"))
    assert equality_key(decode('{"a":1,"b":[2.0]}')) == equality_key(decode('{"b":[2],"a":1.0}'))
    with pytest.raises(ValueError):
        equality_key(Number("inf"))


def test_decoding_keeps_literals_and_takes_the_last_of_repeated_keys():
    assert encode(decode('{"b": 1.00, "a": 1e2, "b": 12345678901234567890}')) == '{"a":1e2,"b":12345678901234567890}'
    assert decode('{"a":1} trailing', first_only=True) == {"a": "1"}
    for bad in ("NaN", "Infinity", "[1", "{'a':1}", "1 2", ""):
        with pytest.raises(ValueError):
            decode(bad)
    assert decode('"\\ud800"') == "�"


def test_wire_size_counts_escapes():
    assert wire_size('"<>&"') == 20
    assert wire_size('"a "') == 9


json_values = st.recursive(st.none() | st.booleans() | st.integers() | st.text(max_size=5), lambda x: st.lists(x, max_size=3) | st.dictionaries(st.text(max_size=3), x, max_size=3), max_leaves=8)


@settings(max_examples=150, deadline=None)
@given(json_values)
def test_encoding_round_trips(value):
    import json

    read = decode(json.dumps(value))
    again = decode(encode(read))
    assert again == read and value_hash(again) == value_hash(read) and equality_key(again) == equality_key(read)


def paths(text, **limits):
    return [(p, n, encode(v)) for p, n, v in flatten(decode(text), limits.get("leaves", 1000), limits.get("path", 256))]


def test_flatten():
    text = '{"os":{"name":"Debian","release":{"major":12}},"dns":{"servers":["8.8.8.8","8.8.4.4"]},"uptime":12345,"empty":{},"none":null,"x.y":{"z":1}}'
    assert paths(text) == [
        ("os.name", "os", '"Debian"'), ("os.release.major", "os", "12"), ("dns.servers", "dns", '["8.8.8.8","8.8.4.4"]'),
        ("uptime", "uptime", "12345"), ("empty", "empty", "{}"), ("none", "none", "null"), ("x.y.z", "x.y", "1"),
    ]


@pytest.mark.parametrize(
    "text, limits, reason",
    [
        ('{"a":{"b":1},"a.b":2}', {}, "bad-request: colliding path a.b"),
        ('{"a":1,"b":2,"c":3}', {"leaves": 1}, "oversized: leaf-count"),
        ('{"verylongkey":1}', {"path": 8}, "oversized: path-length"),
        ('{"verylongkey":{"x":1}}', {"path": 11}, "oversized: path-length"),
        ('{"ééé":1}', {"path": 5}, "oversized: path-length"),
    ],
)
def test_flatten_refuses(text, limits, reason):
    with pytest.raises(TreeError) as e:
        paths(text, **limits)
    assert e.value.reason == reason


def test_trees():
    for text in (None, "", "{}", "null", "[1]", "{bad", "3"):
        assert read_tree(text, Settings())["reason"] == "bad-request"
    assert read_tree('{"k":"abcdefgh"}', Settings(max_value_bytes=4))["large"]
    assert [x["value_type"] for x in read_tree('{"a":1,"b":"x","c":true,"d":null,"e":[1],"f":{}}', Settings())["leaves"]] == ["number", "string", "bool", "null", "array", "object"]


@pytest.mark.parametrize("levels", [1500, 9000, MAX_DEPTH - 1])
def test_depth_stops_nothing(levels):
    assert levels < MAX_DEPTH and sys.getrecursionlimit() < 9000
    for opened, closed in (("[", "]"), ('[{"k":', "}]")):
        n = levels // len(closed)
        inner = opened * n + "1.0" + closed * n
        found = read_tree(f'{{"a":{inner}}}', Settings(max_value_bytes=1 << 20))
        assert found["reason"] is None and found["leaves"][0]["value"] == inner
    assert read_tree('{"a":' * levels + "1" + "}" * levels, Settings())["reason"] == "oversized: path-length"


def test_too_deep_is_a_bad_request():
    for n in (MAX_DEPTH, MAX_DEPTH * 5):
        assert read_tree('{"a":' + "[" * n + "]" * n + "}", Settings())["reason"] == "bad-request"
        assert read_tree('{"a":' + "[" * n, Settings())["reason"] == "bad-request"


@pytest.mark.parametrize("literal, key", [("1e99999999999999999999", "1e99999999999999999999"), ("10e99999999999999999999", "1e100000000000000000000"), ("-0.00e9999999999999999999", "0"), ("1.50E-99999999999999999999", "15e-100000000000000000000")])
def test_any_exponent_has_a_key(literal, key):
    found = read_tree(f'{{"a":{literal}}}', Settings())["leaves"][0]
    assert (found["value"], found["equality_key"]) == (literal, key)


def test_an_exponent_of_thousands_of_digits_is_kept_as_written():
    digits = "9" * 5000
    assert equality_key(Number(f"20e{digits}")) == f"2.1e{digits}"


@settings(max_examples=200, deadline=None)
@given(typed, st.sampled_from(["", " ", "\n\t"]))
def test_the_scanner_reads_as_the_library_does(value, space):
    text = encode(value).replace(",", f"{space},{space}").replace(":", f"{space}:{space}")
    assert _scan(text + "x", 0) == (decode(text), len(text)) and shape(_scan(text, 0)[0]) == shape(decode(text))


@pytest.mark.parametrize("bad", ["", "[", "[1", "[1,", "[1,]", "{", '{"a"', '{"a":', '{"a":1', '{"a":1,', '{"a":1,}', "{1:2}", "[1 2]", "01x", "nul", "NaN", "-", "]", '"a', "[}", '{"a":1]', '{"a" 1}', '"\n"'])
def test_the_scanner_refuses_what_isnt_json(bad):
    with pytest.raises(ValueError):
        _, end = _scan(bad, 0)
        if end != len(bad):
            raise ValueError(bad)


def test_members_are_found_in_place():
    text = ' {"a" : 1.00 , "b":{"c":[1,"}"]},"a":[2]} {"d":1}'
    assert {k: text[slice(*v)] for k, v in members(text).items()} == {"a": "[2]", "b": '{"c":[1,"}"]}'}
    assert members("{}") == {}
    for bad in ("[]", "{", '{"a":}', '{"a":1 "b":2}', ""):
        with pytest.raises(ValueError):
            members(bad)


def test_surrogates_alone_become_replacements():
    assert decode('["\\ud83d\\ude00", "\\ud83d", "\\ude00x", "\\\\ud83d", "\\uD83D\\u0041"]') == ["😀", "\ufffd", "\ufffdx", "\\ud83d", "\ufffdA"]


def test_a_batch_is_its_trees_one_by_one():
    texts = ['{"a":{"b":1},"c":"x"}', None, "[1]", '{"a":1,"b":2,"c":3}', '{"k":"<<<<"}', '{"a":{"b":1},"a.b":2}', '{"z":null}']
    limits = Settings(max_leaves=2, max_value_bytes=20)
    assert flat_batch(pa.array(texts), limits).to_pylist() == [read_tree(t, limits) for t in texts]
    assert [x["reason"] for x in flat_batch(pa.array(texts), limits).to_pylist()] == [None, "bad-request", "bad-request", "oversized: leaf-count", None, "bad-request: colliding path a.b", None]
    assert flat_batch(pa.array([], pa.string()), limits).to_pylist() == []


@settings(max_examples=150, deadline=None)
@given(typed)
def test_one_walk_gives_text_digest_and_key(value):
    found = measured(value)
    assert (encode(value), value_hash(value), equality_key(value)) == tuple(found) and shape(decode(found.text)) == shape(value)


def test_policy():
    policy = Policy(("uptime", "memory.*.available_bytes", "load*", "disk?"))
    assert all(map(policy.is_volatile, ["uptime", "memory.system.available_bytes", "load", "load.1m", "disk1", "load\n1", "memory.a.b.available_bytes"]))
    assert not any(map(policy.is_volatile, ["os.name", "uptimed", "uptime\n", "memory.total", "disk", "networking.interfaces.eth0.address", "Uptime"]))
    assert not Policy().is_volatile("uptime")
    assert not Policy(("a.b", "x[1]")).is_volatile("aXb") and Policy(("x[1]",)).is_volatile("x[1]")


def test_policy_column_agrees(spark):
    policy = Policy(("uptime", "memory.*.available_bytes", "load*", "disk?", "a+b(c)"))
    names = ["uptime", "memory.system.available_bytes", "load\n1", "disk1", "uptime\n", "disk", "a+b(c)", "aab(c)", "os"]
    from pyspark.sql import functions as F

    rows = spark.createDataFrame([(n,) for n in names], "path string").select("path", policy.column(F.col("path")).alias("v")).collect()
    assert {r.path: r.v for r in rows} == {n: policy.is_volatile(n) for n in names}


brackets = st.lists(st.sampled_from(["[", "[[[", "]", "]]", "{", "}", '{"a":', '"a":', ",", "1", '"x]"', " ", "[]", "{}", "null"]), max_size=14).map("".join)


def _end(read, text):
    try:
        return read(text)
    except ValueError:
        return None


@given(brackets)
@settings(max_examples=1500, deadline=None)
def test_a_value_is_skipped_as_it_is_read(text):
    assert _end(lambda t: values._skip(t, 0), text) == _end(lambda t: _scan(t, 0)[1], text)
    try:
        value, end = values._DECODER.raw_decode(text.lstrip(" "))
    except ValueError:
        value, end = None, None
    assert _end(lambda t: _scan(t.lstrip(" "), 0), text) == (None if end is None else (value, end))


def test_skipping_counts_levels():
    for n in (MAX_DEPTH, MAX_DEPTH + 1):
        for text in ("[" * n + "]" * n, "[" * n + "1" + "]" * n, "[ " * n + "] " * n, '{"a":' * n + "1" + "}" * n):
            found = _end(lambda t: values._skip(t, 0), text)
            assert found == _end(lambda t: _scan(t, 0)[1], text) and (found is None) == (n > MAX_DEPTH)


def test_a_deep_body_is_passed_over_without_its_values(monkeypatch):
    monkeypatch.setattr(values, "_scan", None)
    text = '{"tree":{"k":' + "[" * 9000 + "]" * 9000 + '},"more":1}'
    assert [text[slice(*at)] for at in members(text).values()] == [text[8:-10], "1"]


def test_equal_trees_of_a_batch_are_read_once(monkeypatch):
    texts = ['{"a":1}', None, "{bad", '{"a":1}', "{bad", '{"b":[1.0]}', None]
    one_by_one = [flat_batch(pa.array([t], pa.string()), Settings())[0].as_py() for t in texts]
    read, real = [], flattening.tree_leaves
    monkeypatch.setattr(flattening, "tree_leaves", lambda text, limits: read.append(text) or real(text, limits))
    assert flat_batch(pa.array(texts, pa.string()), Settings()).to_pylist() == one_by_one
    assert sorted(map(str, read)) == sorted(map(str, set(texts)))
