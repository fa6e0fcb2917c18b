"""Scans of hot keys, chained merges, names of a domain, payloads and plans with fingerprints."""

import datetime as dt
import difflib
import json
import random

import pytest
from pyspark.sql import functions as F

from millrace.operators import apply, identity, scan, state, trust


def rows(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.fixture
def many_ranges(spark):
    kept = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", kept)
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


@pytest.mark.parametrize("share", [0.0, 0.5, 0.97, 1.0])
def test_scans_of_one_hot_key(spark, many_ranges, share):
    """One key holds nearly all rows and lies in many ranges; long runs of failures cross them."""
    rng = random.Random(share)
    base = dt.datetime(2024, 1, 1)
    data = [(i, "hot" if i % 20 else f"k{i % 3}", base + dt.timedelta(seconds=rng.randrange(3000)), rng.random() >= share, rng.randrange(9)) for i in range(800)]
    df = spark.createDataFrame(data, "event_id bigint, key string, ts timestamp, ok boolean, cost bigint")
    dealt = scan.dealt(df, ["key"], ["ts", "event_id"])
    assert dealt.where("key = 'hot'").select(scan.PART).distinct().count() > 8
    want = state.failure_streaks(df, ["key"], "ts", "event_id").select("event_id", "consecutive_failures")
    assert rows(scan.failure_streaks(df, ["key"], "ts", "event_id").select("event_id", "consecutive_failures")) == rows(want)
    for interval in (1, 4_000_000, 50_000_000):
        want = state.throttled(df, "key", "ts", "event_id", interval).select("event_id", "start_us", "wait_us")
        assert rows(scan.throttled(df, "key", "ts", "event_id", interval).select("event_id", "start_us", "wait_us")) == rows(want)
    total, by = {}, {}
    for i, k, at, _, c in sorted(data, key=lambda r: (r[2], r[0])):
        total[k] = total.get(k, 0) + c
        by[i] = total[k]
    assert rows(scan.running_total(df, ["key"], ["ts", "event_id"], "cost").select("event_id", "total")) == sorted(by.items())
    assert scan.failure_streaks(df.limit(0), ["key"], "ts", "event_id").count() == 0


def brute_ends(moves):
    to = {}
    for s, t in moves:
        if s is not None and t is not None and s != t:
            to[s] = min(t, to.get(s, t))
    out = {}
    for s in to:
        seen, at = [], s
        while at in to and at not in seen:
            seen.append(at)
            at = to[at]
        out[s] = min(seen[seen.index(at) :]) if at in seen else at
    return sorted((s, t) for s, t in out.items() if s != t)


def test_chains_of_merges(spark):
    rng = random.Random(2)
    chains = [(1000 * n + k, 1000 * n + k + 1) for n in (1, 2, 3, 10, 37, 100) for k in range(n)]
    circle = [(1, 2), (2, 3), (3, 1), (9, 1), (10, 9), (5, 5), (None, 4), (4, None), (7, 8), (7, 6)]
    some = [(rng.randrange(40), rng.randrange(40)) for _ in range(35)]
    for moves in (chains, circle, some, chains[:1], []):
        df = spark.createDataFrame(moves, "source bigint, target bigint").repartition(3)
        assert rows(apply.resolved_moves(df)) == brute_ends(moves)
    links = spark.createDataFrame([(1000 * 37 + k, k % 4, k % 2 == 0, k) for k in range(38)], "app_id bigint, item int, is_primary boolean, id int")
    ends = apply.resolved_moves(spark.createDataFrame(chains, "source bigint, target bigint"))
    done = apply.repointed_all({"links": (links, ["item"])}, ends)["links"]
    assert {r.app_id for r in done.collect()} == {1000 * 37 + 37} and done.count() == 4
    assert identity.one_primary(done, "app_id").where("is_primary").count() == 1


def plain_strong(drafts, apps, order):
    """Every draft against every app, as the keys and names say."""
    ratio = lambda a, b: difflib.SequenceMatcher(None, a.lower().strip(), b.lower().strip()).ratio() if a and b else 0.0
    host = lambda u: u.split("/")[2].removeprefix("www.") if u else ""
    out = []
    for d in drafts:
        found = []
        for a in apps:
            kinds = [3] if host(d[2]) and host(d[2]) == host(a[2]) and ratio(a[1], d[1]) >= identity.STRONG else []
            kinds += [4] if d[1].lower().replace(" ", "-") == a[1].lower().replace(" ", "-") else []
            if kinds:
                found.append((*order(a), min(kinds), a[0]))
        if found:
            out.append((d[0], min(found)[-1], min(found)[-2]))
    return sorted(out)


@pytest.mark.parametrize("seed", [1, 2])
def test_names_of_one_domain(spark, seed):
    """Most drafts and apps share a domain; names are few and alike, with other cases and blanks around them."""
    rng = random.Random(seed)
    stems = ["acme code helper", "acme code helpers", "acme mode helper", "beta notes", "beta noted", "calendar sync pro", "calendar sink pro", "x"]
    name = lambda: rng.choice([str, str.upper, str.title])(rng.choice(stems))
    url = lambda own: rng.choice([f"https://hot.example/{own}"] * 6 + [f"https://www.cold.example/{own}", ""])
    drafts = [(i, name(), url(f"d{i}")) for i in range(70)]
    apps = [(i, name(), url(f"a{i}"), rng.randrange(5)) for i in range(50)]
    none = [F.lit("").alias(c) for c in (*identity.URLS[1:], "slug_hint")]
    d = spark.createDataFrame(drafts, "draft_id bigint, name string, developer_url string").select("*", *none)
    a = spark.createDataFrame(apps, "app_id bigint, name string, developer_url string, q int").select("*", *none)
    got = rows(identity.strong_matches(d, a, [F.desc("q")]))
    assert got == plain_strong(drafts, apps, lambda x: (-x[3], x[0]))


def test_candidates_of_made_apps(spark):
    rng = random.Random(3)
    stems = ["great calendar application", "great calendar applications", "grand calendar application", "other"]
    apps = [(i, rng.choice(stems)) for i in range(60)] + [(60, None), (61, " ")]
    df = spark.createDataFrame(apps, "app_id bigint, name string")
    got = rows(identity.duplicate_candidates(df.where("app_id >= 20"), df))
    want = []
    for i, n in apps[20:60]:
        near = sorted((-round(difflib.SequenceMatcher(None, m, n).ratio(), 6), j) for j, m in apps[:60] if j < i and difflib.SequenceMatcher(None, m, n).ratio() >= identity.WEAK)
        want += [(i, j, -s) for s, j in near[:5]]
    assert got == sorted(want)


def test_name_ratio_by_hand(spark):
    """Twice the matching letters over all letters: "abcd" and "bcde" match in bcd."""
    cases = [("abcd", "bcde", 0.75), ("same", " SAME ", 1.0), ("ab", "cd", 0.0), ("", "a", 0.0), (None, "a", 0.0), ("red ring", "red rings", 16 / 17), ("abxcd", "abcd", 8 / 9)]
    got = spark.createDataFrame([c[:2] for c in cases], "a string, b string").select(identity.name_ratio(F.col("a"), F.col("b"))).collect()
    assert [r[0] for r in got] == pytest.approx([c[2] for c in cases])


def test_payloads_keep_their_types(spark):
    rich = '{"rank":3,"live":true,"nested":{"b":[1,2.5],"a":null},"none":null,"f":1.25,"big":12345678901234567890123,"s":"q\\"x\\u00e9","old":1}'
    cases = [rich, "[1,{\"a\":2}]", "no json {", "5", '"text"', None, "", "  ", "{}", "null"]
    df = spark.createDataFrame([(i, c) for i, c in enumerate(cases)], "i int, p string").orderBy("i")
    made = apply.augmented(F.col("p"), {"old": F.lit("new"), "list": F.parse_json(F.lit('[{"x":1}]')), "n": F.lit(7), "yes": F.lit(True)})
    got = [json.loads(r[0]) for r in df.select(made).collect()]
    extra = {"old": "new", "list": [{"x": 1}], "n": 7, "yes": True}
    assert got[0] == json.loads(rich) | extra
    assert got[1:5] == [{"_original": x} | extra for x in ([1, {"a": 2}], "no json {", 5, "text")]
    assert got[5:9] == [extra] * 4 and got[9] == {"_original": None} | extra
    problems = [r[0] for r in df.select(apply.payload_problem(F.col("p"))).collect()]
    assert problems == [None, "not_an_object", "not_json", "not_an_object", "not_an_object", None, None, None, None, "not_an_object"]
    again = df.select("i", made.alias("p")).select("i", made.alias("p"))
    assert [json.loads(r[1]) for r in again.orderBy("i").collect()] == got  # twice is once


def test_trust_plans_are_checked_again(spark):
    """All six plans: a row that changed between plan and run is skipped and listed, the others are written."""
    ids = range(1, 7)
    apps = spark.createDataFrame([(i, "unknown", "live", "short", "First part.\n\n" + "A sentence of the long text that says enough for a listing. " * 2 + "It is in beta.", 0) for i in ids], "app_id bigint, verification string, launch_status string, short_description string, long_description string, n int")
    found = apps.select("app_id")
    caps = spark.createDataFrame([(i, "read", "unknown") for i in ids if i != 6], "app_id bigint, capability string, value string")
    types = spark.createDataFrame([(i, t) for i in ids for t in ("app", "plugin")], "app_id bigint, listing_type string")
    cats = spark.createDataFrame([(i, "Work") for i in ids], "app_id bigint, label string")
    held = spark.createDataFrame([(i, "home") for i in ids], "app_id bigint, category string")
    lists = lambda df, c: df.groupBy("app_id").agg(F.array_sort(F.collect_set(c)).alias(c))
    sources = apps.select("app_id", F.lit(True).alias("is_primary"))
    plans = {
        "verification": (apps, trust.verification_backfill(found, apps), ["app_id"], {"verification": "planned"}),
        "capabilities": (caps, trust.capability_backfill(found, caps, {"read": "yes"}).where("action = 'plan'"), ["app_id", "capability"], {"value": "target"}),
        "categories": (lists(held, "category"), trust.category_backfill(found, cats, held, {"work": "work"}), ["app_id"], {"category": "planned"}),
        "descriptions": (apps, trust.description_backfill(found, apps), ["app_id"], {"short_description": "planned"}),
        "launch": (apps, trust.launch_backfill(found, apps), ["app_id"], {"launch_status": "planned"}),
        "taxonomy": (lists(types, "listing_type"), trust.taxonomy_repair(found, types, ("plugin",), ("app",)), ["app_id"], {"listing_type": "planned_remove"}),
    }
    assert sources.count() == 6
    for name, (current, plan, keys, planned) in plans.items():
        fields = [c for c in current.columns if c not in keys]
        marked = apply.made_from(plan, current, keys, fields)
        column, kind = next(iter(planned)), dict(current.dtypes)[next(iter(planned))]
        other = F.array(F.lit("edited")) if kind.startswith("array") else F.lit("edited")
        now = current.where("app_id <> 3").withColumn(column, F.when(F.col("app_id") == 2, other).otherwise(F.col(column)))
        done, skipped = apply.applied_if_same(now, marked, keys, fields, planned)
        assert {(r.app_id, r.reason) for r in skipped.collect()} == {(2, "changed"), (3, "gone")}, name
        by = {r.app_id: r for r in done.collect()}
        want = {r.app_id: r[next(iter(planned.values()))] for r in plan.collect()}
        assert by[1][column] == want[1] and by[4][column] == want[4] and by[2][column] in ("edited", ["edited"]) and 3 not in by, name
        if name == "capabilities":
            assert by[6]["value"] == "yes"  # a row that was not there is added
        again, _ = apply.applied_if_same(done, marked, keys, fields, planned)
        assert rows(again) == rows(done)


def test_a_run_of_drafts_again_changes_nothing(spark, tmp_path):
    """The second run over what the first has published makes no app and leaves all tables as they are."""
    from millrace.sinks.snapshots import Snapshots

    drafts = spark.createDataFrame([(i, "feed", "" if i % 7 == 6 else f"x{i % 9}", f"p{i % 9}", "official", f"name {i % 9}") for i in range(20) if i % 7 != 6], "draft_id bigint, source_type string, external_id string, payload string, verification string, name string")
    apps = spark.createDataFrame([(1, "unknown", "")], "app_id bigint, verification string, name string")
    sources = spark.createDataFrame([("feed", "x1", 1, "old")], "source_type string, external_id string, app_id bigint, payload string")
    none = spark.createDataFrame([], "draft_id bigint, app_id bigint")
    wanted = drafts.select("draft_id", F.lit("web").alias("slug"))
    dim = spark.createDataFrame([("web",)], "slug string")
    store = Snapshots(spark, str(tmp_path))
    bridge = spark.createDataFrame([], "app_id bigint, slug string")
    seen = []
    for _ in range(2):
        out = apply.upserted_tables(apps, sources, drafts, none, ["name"], {"platforms": (bridge, wanted, dim)}, ("platforms",), identity.duplicate_candidates)
        store.commit(out)
        apps, sources, bridge = (store.read(n) for n in ("apps", "sources", "platforms"))
        seen.append([rows(store.read(n)) for n in ("apps", "sources", "platforms")])
    assert seen[0] == seen[1] and len(seen[0][0]) == 9 and {r[0] for r in seen[0][2]} == {r[0] for r in seen[0][0]}
    assert {r.outcome for r in store.read("outcomes").collect()} == {"updated"} and store.read("candidates").count() == 0


def test_rounds_of_moves_are_not_broadcast(spark):
    ends = apply.resolved_moves(spark.createDataFrame([(2, 1), (3, 2), (5, 6), (6, 5)], "source bigint, target bigint"))
    assert sorted((r.source, r.target) for r in ends.collect()) == [(2, 1), (3, 1), (6, 5)]
    plan = ends._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
