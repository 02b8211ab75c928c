import random

import pytest
from pyspark.sql import functions as F

from weftline.functions import scalar
from weftline.operators import items as op

SCHEMA = "envelope_id string, array_key string, pos long, id string, item_type string, content string, status string, priority long, relevance double, scope array<string>, tags array<string>, valid_from string, valid_until string, trust_level string, provides_data boolean, provides_instructions boolean, sensitivity string, handling array<struct<rule:string,applies_to:string>>"


def make(spark, *rows):
    """Items from dicts; what isn't given is null."""
    base = dict.fromkeys(x.split()[0] for x in SCHEMA.replace("struct<rule:string,applies_to:string>", "x").split(", "))
    full = [base | {"envelope_id": "e", "array_key": "facts", "pos": i, "id": f"i{i}", "item_type": "Fact"} | r for i, r in enumerate(rows)]
    return spark.createDataFrame([tuple(r.values()) for r in full], SCHEMA)


def ids(df):
    return sorted(r.id for r in df.select("id").collect())


@pytest.mark.parametrize(("text", "tokens"), [("abcd", 1), ("abcde", 2), ("", 0)])
def test_tokens(spark, text, tokens):
    assert spark.range(1).select(scalar.token_estimate(F.lit(text))).first()[0] == tokens


@pytest.mark.parametrize(("text", "hashed"), [("hello", "4f9f2cab"), ("a", "e40c292c"), ("", "811c9dc5")])
def test_short_hash(spark, text, hashed):
    assert spark.range(1).select(scalar.short_hash(F.lit(text))).first()[0] == hashed


def test_truncation_fits_exactly(spark):
    row = spark.range(1).select(scalar.truncate_to_tokens(F.lit("x" * 200), F.lit(20)).alias("a"), scalar.truncate_to_tokens(F.lit("xx"), F.lit(1)).alias("b"), scalar.truncate_to_tokens(F.lit("xxxxx"), F.lit(0)).alias("c")).first()
    assert (len(row.a), row.a[-1], row.b, row.c) == (80, "…", "xx", "")


def test_stable_json_keeps_null_and_sorts(spark):
    assert spark.range(1).select(scalar.stable_json(F.lit('{"b": null, "a": [1, {"d": 2, "c": 3}]}'))).first()[0] == '{"a":[1,{"c":3,"d":2}],"b":null}'


def test_trim_takes_all_white_space(spark):
    assert spark.range(1).select(scalar.trim_all(F.lit(" ﻿ x 　\n"))).first()[0] == "x"


def test_dedupe_keeps_first_identity_and_highest_priority(spark):
    found = op.dedupe(make(spark, {"content": "same", "priority": 10, "tags": ["b"]}, {"content": "different", "priority": 5, "tags": []}, {"content": "same", "priority": 90, "tags": ["a"]})).orderBy("pos").collect()
    assert [(r.id, r.priority, r.tags) for r in found] == [("i0", 90, ["a", "b"]), ("i1", 5, [])]


def test_dedupe_without_content_is_one(spark):
    assert op.dedupe(make(spark, {"item_type": "Entity"}, {"item_type": "Entity"})).count() == 1


def test_filters(spark):
    df = make(spark, {"valid_until": "2027-01-01T00:00:00.000Z", "relevance": 0.9, "sensitivity": "public"}, {"valid_until": "2020-01-01T00:00:00.000Z", "relevance": 0.1, "sensitivity": "secret"}, {})
    assert ids(op.keep(df, as_of="2026-08-15T00:00:00.000Z")) == ["i0", "i2"]
    assert ids(op.keep(df, relevance=0.5)) == ["i0", "i2"]
    assert ids(op.keep(df, most_sensitive="internal")) == ["i0", "i2"]
    assert ids(op.keep(df, most_sensitive="nonsense")) == ["i2"]
    assert ids(op.keep(df, scope=["x"], tags=["y"])) == ["i0", "i1", "i2"]
    assert ids(op.keep(df, relevance=0.5, arrays=["resources"])) == ["i0", "i1", "i2"]


def test_rank(spark):
    df = make(spark, {"id": "b", "priority": 50, "relevance": 0.5}, {"id": "a", "priority": 50, "relevance": 0.9}, {"id": "c", "priority": 90})
    assert [r.id for r in op.rank(df).orderBy("rank").collect()] == ["c", "a", "b"]


def test_redaction_rules(spark):
    df = make(spark, {"content": "abc", "sensitivity": "secret"}, {"content": "abc", "handling": [("redact", "x"), ("summarize", None)]}, {"content": "abc"})
    assert {r.id: (r.rule, r.content) for r in op.redact(df).collect()} == {"i1": ("summarize", "[SUMMARIZED: 3 chars omitted]"), "i2": ("allow", "abc")}
    assert {r.id: r.rule for r in op.redact(df, "x").collect()} == {"i1": "redact", "i2": "allow"}


def test_merge_conflict_keeps_both(spark):
    a, b = (make(spark, {"content": c, "status": "confirmed", "tags": [c], "priority": p}) for c, p in (("one", 1), ("two", 2)))
    assert [(r.content, r.outcome) for r in op.merge(a, b).orderBy("content").collect()] == [("one", "conflict"), ("two", "conflict")]
    same = op.merge(a, make(spark, {"content": "one", "status": "confirmed", "tags": ["z"], "priority": 7})).first()
    assert (same.outcome, same.priority, same.tags) == ("same", 7, ["one", "z"])
    assert [r.kind for r in op.diff(a, b).collect()] == ["changed"]


def greedy(rows, budget, caps):
    """The loop that the set-based selection must equal."""
    left, out = budget, {}
    for key in op.SECTIONS:
        own = sorted((r for r in rows if r["array_key"] == key), key=lambda r: (-r["priority"], r["id"]))
        room = caps.get(key, 10**9)
        for r in own:
            if r["required"]:
                t = -(-len(r["content"]) // 4)
                left, room, out[r["id"]] = left - t, room - t, t
        for r in own:
            if not r["required"]:
                t = -(-len(r["content"]) // 4)
                take = max(0, min(t, room, left))
                left, room, out[r["id"]] = left - take, room - take, take
    return out


@pytest.mark.parametrize("seed", range(4))
def test_selection_equals_the_loop(spark, seed):
    rng = random.Random(seed)
    rows = [{"array_key": rng.choice(["facts", "resources", "instructions"]), "content": "x" * rng.randrange(0, 120), "priority": rng.randrange(5), "relevance": 0.0} for _ in range(40)]
    df = op.rank(make(spark, *rows)).withColumn("required", F.col("pos") % 9 == 1)
    for i, r in enumerate(rows):
        r |= {"id": f"i{i}", "required": i % 9 == 1}
    caps = {"facts": 80}
    assert {r.id: r.kept_tokens for r in op.select_in_budget(df, 260, caps).collect()} == greedy(rows, 260, caps)


def test_whole_items_skip_and_go_on(spark):
    df = op.rank(make(spark, *[{"content": "x" * 4 * n, "priority": 9 - i} for i, n in enumerate((5, 9, 3, 1))]))
    assert sorted(r.tokens for r in op.select_whole(df, 10).collect()) == [1, 3, 5]
