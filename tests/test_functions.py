import json
import math
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sieveline.functions import keys, text, vectors


def column(spark, values, expr, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}")
    return [r[0] for r in df.orderBy("i").select(expr(F.col("x"))).collect()]


def test_terms_fold_case_and_accents(spark):
    assert column(spark, ["Élan naïve ÑU", "ß œ ø", "a-b_c 12", "", None, "试用期 ok"], text.terms) == [["elan", "naive", "nu"], ["ß", "œ", "ø"], ["a", "b", "c", "12"], [], None, ["试用", "用期", "ok"]]


def test_fence_token_equals_its_python_counterpart(spark):
    values = ["", "a", "foobar", "试用期", "😀 astral", "x" * 500]
    assert column(spark, values, text.fence_token) == [text.fence_token_py(v) for v in values]
    # the published FNV-1a value of "foobar"
    assert int(text.fence_token_py("foobar"), 36) == 0xBF9CF968


def test_fence_tokens_of_whole_arrays(monkeypatch):
    """Units of 1 to 16 bits, astral and lone surrogates, texts of several pieces, empty ones and nulls among them."""
    rng = random.Random(3)
    ranges = [(0, 2), (0, 128), (0, 256), (0x2000, 0xE000), (0x10000, 0x110000)]
    texts = ["", None, "\0", "\ud800", *["".join(chr(rng.randrange(*rng.choice(ranges[: rng.randint(1, 5)]))) for _ in range(rng.randrange(90))) for _ in range(200)], None, ""]
    want = [None if t is None else text.fence_token_py(t) for t in texts]
    for units in (1 << 16, 100, 7, 1):
        monkeypatch.setattr(text, "FENCE_UNITS", units)
        assert text.fence_tokens_py(texts) == want
    assert text.fence_tokens_py([]) == [] and text.fence_tokens_py([None]) == [None]


def test_untrusted_block(spark):
    assert column(spark, ["hi"], lambda c: text.untrusted_block(F.lit("p"), c)) == [text.untrusted_block_py("p", "hi")]


def test_trim_and_canonical(spark):
    values = ["　 a　b ﻿", "\x00", " \t\n", "​x"]
    assert column(spark, values, text.canonical) == ["a b", "\x00", "", "​x"]
    assert column(spark, [None, " ", "　", "x"], text.is_blank) == [True, True, True, False]
    assert column(spark, ["a\x00b\tc\x1f"], text.strip_controls) == ["ab\tc"]


def test_cells_escape_backslash_first(spark):
    assert column(spark, ["a|b\\c`d\ne"], text.escape_cell) == [text.escape_cell_py("a|b\\c`d\ne")] == ["a\\|b\\\\c\\`d e"]


def test_origins_hosts_and_resources(spark):
    urls = ["https://a.org/x", "https://a.org:8443/x", "http://a.org", "https://", None]
    assert column(spark, urls, lambda c: text.origin_allowed(c, ["https://a.org"])) == [True, False, False, False, False]
    assert column(spark, urls, lambda c: text.origin_allowed(c, ["https://*"])) == [True, True, False, False, False]
    assert column(spark, urls, lambda c: text.host_allowed(c, ["A.ORG"])) == [True, True, True, False, False]
    assert column(spark, ["doc://kind/a.md", "doc://kind/../x", "doc://Kind/a", "doc://kind/a/b", None], text.resource_uri) == [True, False, False, False, False]


def test_cosine_and_validity(spark):
    df = spark.createDataFrame([([1.0, 0.0], [1.0, 1.0]), ([0.0, 0.0], [1.0, 1.0])], "a array<double>, b array<double>")
    assert [round(r[0], 12) for r in df.select(vectors.cosine(F.col("a"), F.col("b"))).collect()] == [round(1 / math.sqrt(2), 12), 0.0]
    odd = spark.createDataFrame([([1.0], [1.0, 2.0])], df.schema)
    with pytest.raises(Exception, match="EVAL_INVALID_METRIC_INPUT"):
        odd.select(vectors.cosine(F.col("a"), F.col("b"))).collect()
    v = spark.createDataFrame([(0, [1.0, 2.0]), (1, [1.0]), (2, [1.0, float("nan")]), (3, [1.0, float("inf")]), (4, None), (5, [1.0, None])], "i int, a array<double>").orderBy("i")
    assert [r[0] for r in v.select(vectors.valid(F.col("a"), 2)).collect()] == [True, False, False, False, False, False]


def test_canonical_json():
    assert keys.canonical_json({"b": 1.0, "a": " x　y ", "10": None, "9": [True, 0.1]}) == '{"9":[true,0.1],"10":null,"a":"x y","b":1}'
    assert keys.canonical_json(1e21) == "1e+21" and keys.canonical_json(1e-7) == "1e-7" and keys.canonical_json(-0.00001) == "-0.00001"
    with pytest.raises(TypeError):
        keys.canonical_json(object())


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.text(max_size=5), st.recursive(st.none() | st.booleans() | st.integers() | st.text(max_size=5), lambda c: st.lists(c, max_size=3), max_leaves=5), max_size=5))
def test_canonical_json_is_a_fixed_point(value):
    once = keys.canonical_json(value)
    assert keys.canonical_json(json.loads(once)) == once


def test_cache_keys(spark):
    assert keys.cache_key("t", "v1", {"q": " a ", "env": "dev"}) == keys.cache_key("t", "v1", {"q": "a"})
    assert keys.cache_key("t", "v1", {"q": "a"}) != keys.cache_key("t", "v2", {"q": "a"})
    assert column(spark, ['{"b":1.0,"a":2}', "no", None], keys.canonical_column) == ['{"a":2,"b":1}', None, None]


def test_what_is_not_cached(spark):
    cases = [({}, {"isError": True}), ({}, {"confidence": " Low "}), ({"env": "prod"}, {}), ({"env": "dev"}, {}), ({"env": ""}, {}), ({}, {"confidence": "high"})]
    assert [keys.skip_write(a, r) for a, r in cases] == [True, True, True, False, False, False]
    df = spark.createDataFrame([(0, True, None, None), (1, None, " low", None), (2, False, None, "prod"), (3, None, None, None)], "i int, e boolean, c string, v string").orderBy("i")
    assert [r[0] for r in df.select(keys.skip_write_column(F.col("e"), F.col("c"), F.col("v"))).collect()] == [True, True, True, False]


def test_cache_meta_leaves_its_argument_alone():
    r = {"_meta": {"a": 1}}
    assert keys.with_cache_meta(r, "hit") == {"_meta": {"a": 1, "cache": "hit"}} and r == {"_meta": {"a": 1}}
    assert keys.with_cache_meta([{"x": 1}, 2], "miss") == [{"x": 1, "_meta": {"cache": "miss"}}, 2] and keys.with_cache_meta("t", "hit") == "t"
