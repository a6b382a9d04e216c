"""Change-feeds against plain loops over random changes, and constraint rules."""

from __future__ import annotations

import json
import random

import pytest
from pyspark.sql import functions as F

from cloakwork.operators import changes as C
from cloakwork.operators import constraints as K
from cloakwork.operators import directory as D
from cloakwork.sources.stored import StoredTable

from .conftest import policy_rows


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_upsert_equals_a_loop(spark):
    rnd = random.Random(9)
    cur = [(i, rnd.randint(0, 2), f"t{i}", 0) for i in range(0, 30, 2)]
    chg = [(rnd.randint(0, 40), rnd.randint(0, 2), f"c{n}", n + 1) for n in range(300)]
    schema = "id long, who long, title string, at long"
    got = C.upsert_latest(spark.createDataFrame(cur, schema), spark.createDataFrame(chg, schema), ["id"], ["at"], ["who"])
    state = {r[0]: r for r in cur}
    for c in chg:
        if c[0] not in state or state[c[0]][1] == c[1]:
            state[c[0]] = c
    assert rows(got) == sorted(state.values(), key=str)


def test_upsert_keeps_first_values(spark):
    schema = "id long, who long, created long, title string"
    cur = spark.createDataFrame([(1, 1, 5, "a")], schema)
    chg = spark.createDataFrame([(1, 1, 9, "b"), (2, 7, 10, "c"), (2, 7, 12, "d")], schema)
    got = C.upsert_latest(cur, chg, ["id"], ["created"], ["who"], keep=("created",))
    assert rows(got) == [(1, 1, 5, "b"), (2, 7, 10, "d")]


def test_insert_if_absent(spark):
    cur = spark.createDataFrame([(1, "old")], "id long, v string")
    chg = spark.createDataFrame([(1, "x", 1), (2, "late", 9), (2, "first", 3)], "id long, v string, n long")
    assert rows(C.insert_if_absent(cur, chg, ["id"], ["n"])) == [(1, "old"), (2, "first")]


def test_patch_equals_a_loop(spark):
    rnd = random.Random(6)
    cur = [(i, f"n{i}", i % 2 == 0, 0) for i in range(20)]
    pat = [(rnd.randint(0, 25), n + 1, rnd.choice([None, f"p{n}"]), rnd.choice([None, True, False])) for n in range(120)]
    got = C.patch_rows(
        spark.createDataFrame(cur, "id long, name string, on boolean, upd long"),
        spark.createDataFrame(pat, "id long, at long, name string, on boolean"),
        ["id"], ["at"], stamp_col="upd",
    )
    state = {r[0]: list(r) for r in cur}
    for i, at, name, on in pat:
        if i in state:
            state[i][1:] = [name if name is not None else state[i][1], on if on is not None else state[i][2], at]
    assert rows(got) == sorted(map(tuple, state.values()), key=str)


def test_config_keeps_other_values_and_types(spark):
    cur = spark.createDataFrame(
        [(1, "slack", False, '{"url":"old","n":1.5,"deep":{"a":[1,"x"]},"on":true}'), (2, "slack", False, None)],
        "org_id long, slug string, installed boolean, config string",
    )
    pat = spark.createDataFrame(
        [(1, "slack", " https://new\"q ", 1), (1, "slack", "ftp://bad", 2), (3, "teams", "http://t", 1), (3, "google-sheets", "http://t", 1)],
        "org_id long, slug string, url string, n long",
    )
    got = {r["org_id"]: r for r in C.merge_json_config(cur, pat, ["n"]).collect()}
    assert json.loads(got[1]["config"]) == {"url": 'https://new"q', "n": 1.5, "deep": {"a": [1, "x"]}, "on": True} and got[1]["installed"]
    assert got[2]["config"] is None and not got[2]["installed"]
    assert json.loads(got[3]["config"]) == {"url": "http://t"} and got[3]["installed"]


def test_install_and_uninstall(spark):
    cur = spark.createDataFrame([(1, "slack", True, '{"url":"u"}'), (2, "slack", True, "{}")], "org_id long, slug string, installed boolean, config string")
    chg = spark.createDataFrame(
        [(1, "slack", False, 1), (1, "teams", True, 1), (3, "teams", False, 1), (4, "teams", True, 1), (4, "teams", False, 2), (5, "nope", True, 1)],
        "org_id long, slug string, installed boolean, n long",
    )
    assert rows(C.set_installed(cur, chg, ["n"])) == [
        (1, "slack", False, '{"url":"u"}'),
        (1, "teams", True, "{}"),
        (2, "slack", True, "{}"),
        (4, "teams", False, "{}"),
    ]


def test_deletes(spark):
    parents = spark.createDataFrame([(1, 10), (2, 10), (3, 20)], "doc long, org long")
    children = spark.createDataFrame([(1, 100), (2, 200), (3, 300)], "doc long, id long")
    ids = spark.createDataFrame([(1, 10), (3, 99), (3, 99)], "doc long, org long")
    p, c = C.cascade_delete(parents, children, "doc", ids, also=["org"])
    assert rows(p) == [(2, 10), (3, 20)] and rows(c) == [(2, 200), (3, 300)]
    kept = C.detach_children(children, "doc", ids)
    assert rows(kept.select("id", "doc")) == [(100, None), (200, 2), (300, None)]


def test_accept_messages_rules(spark):
    orgs = spark.createDataFrame([(1, False), (2, True)], "org_id long, zero_retention boolean")
    convs = spark.createDataFrame([(1, 1, 5, "t", 0)], "conv_id long, org_id long, user_id long, title string, updated_at long")
    msgs = spark.createDataFrame([(1, 1, "user", "kept")], "message_id long, conv_id long, role string, content string")
    inc = spark.createDataFrame(
        [
            (1, 1, 1, 5, "user", "again", 1),  # known id
            (2, 1, 1, 5, "user", "a@b.co", 2),  # a flag rule still masks at rest
            (3, 1, 1, 6, "user", "stranger", 3),
            (4, 1, 1, 5, "tool", "bad role", 4),
            (5, 9, 1, 5, "user", "opens", 5),
            (6, 8, 2, 5, "user", "no retention", 6),
        ],
        "message_id long, conv_id long, org_id long, user_id long, role string, content string, at long",
    )
    m, c = C.accept_messages(inc, msgs, convs, orgs, policy_rows(spark, (1, ["email"], "flag")))
    assert rows(m) == [(1, 1, "user", "kept"), (2, 1, "user", "[REDACTED:EMAIL]"), (5, 9, "user", "opens")]
    assert rows(c) == [(1, 1, 5, "t", 2), (9, 1, 5, "New Chat", 5)]


def test_titles(spark):
    orgs = spark.createDataFrame([(1, False), (2, True)], "org_id long, zero_retention boolean")
    ch = spark.createDataFrame([(1, 1, "mail a@b.co"), (2, 1, "  "), (3, 2, "secret")], "id long, org_id long, title string")
    got = C.conversation_titles(ch, orgs, policy_rows(spark, (1, ["email"], "block")))
    assert {r["id"]: r["title"] for r in got.collect()} == {1: "mail [REDACTED:EMAIL]", 2: "New chat", 3: "Conversation"}


def test_rules(spark):
    df = spark.createDataFrame(
        [(1, "a", "x", 1), (2, "b", "x", 2), (3, None, None, 9), (4, "a", "y", None), (5, "a", "x", 1)],
        "id long, kind string, name string, ref long",
    )
    parent = spark.createDataFrame([(1,), (2,)], "k long")
    got = K.violations(
        df,
        "id",
        [
            K.one_of("kind", "kind", ("a",)),
            K.NotNull("named", ("name",)),
            K.Unique("uniq", ("kind", "name")),
            K.Unique("one_y", ("name",), F.col("kind") == "b"),
            K.Foreign("fk", "ref", parent, "k"),
        ],
    )
    assert rows(got) == sorted([("kind", "2"), ("named", "3"), ("uniq", "1"), ("uniq", "5"), ("fk", "3")], key=str)


def test_violations_of_a_change_set_are_the_difference_of_two_full_runs(spark):
    from collections import Counter

    kid, mum = "id long, kind string, name string, ref long", "k long, org long"
    rnd = random.Random(11)

    def child(i):
        return (i, rnd.choice(["a", "b", None]), rnd.choice(["x", "y", "z", None]), rnd.choice([*range(8), None]))

    def check(kids, mums, kid_changes, mum_changes):
        upserts, deletes = kid_changes
        more, gone = mum_changes
        parent = K.changed(spark.createDataFrame(mums, mum), "k", spark.createDataFrame(more, mum), spark.createDataFrame([(i,) for i in gone], "k long"))
        table = K.changed(spark.createDataFrame(kids, kid), "id", spark.createDataFrame(upserts, kid), spark.createDataFrame([(i,) for i in deletes], "id long"))

        def rules(of):
            return [
                K.one_of("kind", "kind", ("a",)), K.NotNull("named", ("name", "kind")), K.Unique("uniq", ("kind", "name")),
                K.Unique("one_y", ("name",), F.col("kind") == "b"), K.Unique("id_too", ("id", "name")), K.Foreign("fk", "ref", of, "k"),
            ]

        def full(df, of):
            return Counter(tuple(r) for r in K.violations(df, "id", rules(of)).collect())

        after = {r[0]: r for r in kids if r[0] not in deletes} | {r[0]: r for r in upserts}
        after_mums = {r[0]: r for r in mums if r[0] not in gone} | {r[0]: r for r in more}
        was = full(spark.createDataFrame(kids, kid), spark.createDataFrame(mums, mum))
        now = full(spark.createDataFrame(list(after.values()), kid), spark.createDataFrame(list(after_mums.values()), mum))
        want = {key: now[key] - was[key] for key in now | was if now[key] != was[key]}
        got = K.violation_changes(table, rules(parent.before), {"fk": parent})
        assert {(r["rule"], r["id"]): r["change"] for r in got.collect()} == want
        return want

    kids, mums = [child(i) for i in range(25)], [(k, k) for k in range(0, 8, 2)]
    some = check(kids, mums, ([child(i) for i in (1, 4, 9, 30, 31)], [9, 12, 13, 99]), ([(3, 3), (2, 9)], [0, 2, 77]))
    assert {v for v in some.values()} == {1, -1}
    assert check(kids, mums, ([], []), ([], [])) == {}
    assert check(kids, mums, ([], []), ([(1, 1)], [4]))  # only the parent changes
    check([], [], ([child(i) for i in range(6)], []), ([(1, 1)], []))
    check(kids, mums, ([], [i for i in range(25)]), ([], [k for k, _ in mums]))


def test_team_names_to_ids(spark):
    teams = spark.createDataFrame([(1, 10, "Core")], "org_id long, team_id long, name string")
    asked = spark.createDataFrame([(1, "Core"), (1, "New"), (1, " "), (2, "Core"), (1, "Core")], "org_id long, name string")
    made = {r["name"]: r["id"] for r in spark.sql("select 'New' as name, 1 as org_id union all select 'Core', 2").select("name", D.team_id_of(F.col("org_id"), F.col("name")).alias("id")).collect()}
    assert rows(D.teams_by_name(teams, asked)) == [(1, "Core", 10, False), (1, "New", made["New"], True), (2, "Core", made["Core"], True)]
    assert {r["team_id"] for r in D.with_asked_teams(teams, asked).collect()} >= {10, *made.values()}


# --- stored tables


def stored(spark, tmp_path, n=200, buckets=8):
    df = spark.range(n).select(F.col("id").alias("k"), F.lit(1).cast("long").alias("org"), F.concat(F.lit("v"), "id").alias("v"), F.lit(0).alias("at"))
    return StoredTable.create(df, str(tmp_path / "t"), ["k"], buckets)


def upsert(current, changes):
    return C.upsert_latest(current, changes, ["k"], ["at"], ["org"])


def test_a_merge_leaves_untouched_buckets_alone(spark, tmp_path):
    before = stored(spark, tmp_path)
    changes = spark.createDataFrame([(3, 1, "new", 5), (1000, 1, "added", 6), (4, 2, "a stranger's", 7)], "k int, org long, v string, at int")
    after = before.merge(changes, upsert)
    touched = set(before.touched(changes))
    assert 0 < len(touched) < 8 and after.version == 1
    files = lambda t, some: set(t.read([b for b in range(8) if (b in touched) == some]).inputFiles())
    assert files(after, False) == files(before, False) and not files(after, True) & files(before, True)
    want = {**{i: f"v{i}" for i in range(200)}, 3: "new", 1000: "added"}
    assert {r["k"]: r["v"] for r in after.read().collect()} == want
    assert after.read().schema == before.read().schema
    # the old version is still there, and the latest is found by path
    assert StoredTable(spark, before.path, 0).read().count() == 200
    assert StoredTable(spark, before.path).read().count() == 201
    assert [r["v"] for r in after.lookup(changes.filter("k = 3")).collect()] == ["new"]


def test_a_failed_merge_leaves_the_old_table(spark, tmp_path):
    before = stored(spark, tmp_path)
    changes = spark.createDataFrame([(3, 1, "new", 5)], "k int, org long, v string, at int")
    with pytest.raises(Exception, match="lost"):
        before.merge(changes, lambda cur, _: cur.withColumn("v", F.when(F.col("k") == 3, F.raise_error(F.lit("lost"))).otherwise(F.col("v"))))
    assert {r["v"] for r in StoredTable(spark, before.path).read().collect()} == {f"v{i}" for i in range(200)}
    assert before.merge(changes, upsert).read().filter("v = 'new'").count() == 1
    # a second merge of the same version is too late
    with pytest.raises(Exception, match="ALREADY_EXISTS|already exists"):
        before.merge(changes, upsert)


def test_stored_tables_that_run_empty(spark, tmp_path):
    table = stored(spark, tmp_path, n=3, buckets=2)
    gone = table.merge(table.read().select("k"), lambda cur, ids: cur.join(ids, "k", "left_anti"))
    assert gone.read().collect() == [] and gone.merge(gone.read(), upsert) is gone
    again = gone.merge(spark.createDataFrame([(9, 1, "x", 1)], "k int, org long, v string, at int"), upsert)
    assert [tuple(r) for r in again.read().collect()] == [(9, 1, "x", 1)]
    with pytest.raises(ValueError):
        StoredTable(spark, table.path, 7)


def test_stored_patches_and_deletes_equal_those_of_whole_tables(spark, tmp_path):
    table = stored(spark, tmp_path)
    patches = spark.createDataFrame([(i, "p" if i % 2 else None, i) for i in range(0, 50, 5)] + [(5, "later", 99)], "k long, v string, at int")
    ids = spark.createDataFrame([(i,) for i in range(0, 200, 9)], "k long")
    patched = table.merge(patches, lambda cur, p: C.patch_rows(cur, p, ["k"], ["at"], stamp_col="at"))
    left = patched.merge(ids, lambda cur, i: cur.join(i, "k", "left_anti"))
    whole = C.patch_rows(table.read(), patches, ["k"], ["at"], stamp_col="at").join(ids, "k", "left_anti")
    assert rows(left.read()) == rows(whole)
