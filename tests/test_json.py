import json

from pyspark.sql import functions as F

from faultlens.functions import json_text as J

TEXTS = [
    '{"a": 1}', '{"a": 1} tail', "{'a': 1}", "[1, 2]", "[1] junk", '{"a": 1}] junk', "1", '"s"', "",
    '{"a": 1},{"b": 2}', "null", "true", "01", '{"a": "x\ny"}', '{"a": "\\u00e9"}', "{a: 1}", "// c\n1", "[1,]",
    '"\\d"', "  {\"a\": []}\n", "plain words", "nul", "-3.5e2", '{"a": 1, "a": 2}', "NaN", "{} {}", "+1",
]
KINDS = {dict: "object", list: "array", str: "string", bool: "boolean", type(None): "null", int: "number", float: "number"}


def kind(text):
    try:
        return KINDS[type(json.loads(text))]
    except ValueError:
        return None


def test_kinds_agree_with_the_json_module(values):
    assert values(J.strict_kind, TEXTS) == [kind(t) for t in TEXTS]


def test_a_text_that_guesses_the_digest_layout_is_refused(values):
    assert values(J.strict_kind, ['1,"x"] tail', '1,"d41d8cd98f00b204e9800998ecf8427e"]']) == [None, None]


def test_text_lines(values):
    got = values(J.text_lines, [None, "", "one", '["a", null, 2, {"b": true}]', '["a"', '"quoted"', " [1]", "['a']"])
    assert got == [[], [], ["one"], ["a", "None", "2", '{"b":true}'], ['["a"'], ['"quoted"'], ["1"], ["['a']"]]


def test_json_lines(values):
    got = values(J.json_lines, [None, "null", '["a","b"]', '"x"', '""', '"[1,2]"', "7", '{"a":1}'])
    assert got == [[], [], ["a", "b"], ["x"], [], ["1", "2"], ["7"], ['{"a":1}']]


def test_empty_values(values):
    empty = ["null", '""', "[]", "{}", "0", "0.0", "-0", "false", "0e3"]
    full = ['"0"', '"[]"', "[0]", "0.5", "-1", "true", '{"a":1}', "10"]
    assert values(J.is_empty, empty) == [True] * len(empty)
    assert values(J.is_empty, full) == [False] * len(full)


def test_last_of_equal_keys_wins(values):
    read = lambda x: J.parse(x, "struct<a: variant>")["a"].cast("string")
    assert values(read, ['{"a": 1, "a": 2}']) == ["2"]
    assert values(lambda x: F.to_json(J.parse(x, "struct<a: variant>")["a"]), ['{"b": 1}', '{"a": null}']) == [None, "null"]


def test_canonical_text(values):
    texts = ['{"b": [1, {"z": null, "a": "x"}], "a": 1.50}', ' {"a":1.5,"b":[1,{"a":"x","z":null}]} ', '{"a": 1, "a": 2}', "no json", None]
    one = '{"a":1.5,"b":[1,{"a":"x","z":null}]}'
    assert values(J.canonical, texts) == [one, one, texts[2], "no json", None]
