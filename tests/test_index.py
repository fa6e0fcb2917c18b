"""A stored index gives what a rebuilt one gives, and reads the buckets of its terms only."""

import random

import pytest
from pyspark.sql import functions as F

from millrace.operators import index, search
from millrace.sinks.snapshots import Snapshots

WORDS = [f"w{i}" for i in range(40)] + ["red", "widget", "gear"]
FIELDS = {"A": ["title"], "C": ["body"]}


def texts(rng, keys):
    return [(k, " ".join(rng.choices(WORDS, k=3)), " ".join(rng.choices(WORDS, k=rng.randint(0, 12)))) for k in keys]


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_batches_equal_a_rebuild(spark, tmp_path):
    rng = random.Random(4)
    frame = lambda x: spark.createDataFrame(x, "id bigint, title string, body string")
    state = {r[0]: r for r in texts(rng, range(60))}
    stored = index.StoredIndex(Snapshots(spark, str(tmp_path)), "id", index.search_terms("id", FIELDS), buckets=8)
    stored.build(frame(list(state.values())))
    for batch in (1, 2, 3):
        changed = texts(rng, rng.sample(range(80), 12))
        gone = rng.sample(sorted(set(state) - {r[0] for r in changed}), 3)
        state = {k: v for k, v in (state | {r[0]: r for r in changed}).items() if k not in gone}
        for _ in range(2):  # a batch that runs again changes nothing
            stored.apply(frame(changed), batch, gone=spark.createDataFrame([(g,) for g in gone], "id bigint"))
        whole = search.postings(frame(list(state.values())), "id", FIELDS)
        assert rows(stored.postings()) == rows(whole), batch
        for q in ("red", "w1 w2", "gear widget red", "the", "unknown"):
            assert rows(index.match(stored, q)) == rows(search.match(whole, "id", q)), (batch, q)
    stored.compact()
    assert rows(stored.postings()) == rows(whole) and all(s.endswith(".0") for s in stored.store.slots("postings"))
    plan = stored.postings(["red"])
    assert 0 < len(plan.inputFiles()) < len(stored.store.read("postings").inputFiles())
    stored.build(frame(list(state.values())[:5]))
    assert rows(stored.postings()) == rows(search.postings(frame(list(state.values())[:5]), "id", FIELDS))


def test_a_stream_of_changes_is_followed(spark, tmp_path):
    frame = lambda x: spark.createDataFrame(x, "id bigint, title string, body string, at int")
    landing = str(tmp_path / "landing")
    stored = index.StoredIndex(Snapshots(spark, str(tmp_path / "store")), "id", index.search_terms("id", FIELDS), buckets=4)
    stored.build(frame([(1, "red", "", 0), (2, "gear", "", 0)]))
    batches = [[(1, "blue", "", 1), (1, "widget", "", 2)], [(3, "red", "", 3)], [(2, "red gear", "", 4)]]
    for b in batches:
        frame(b).coalesce(1).write.mode("append").parquet(landing)
        stream = spark.readStream.schema("id bigint, title string, body string, at int").parquet(landing)
        stored.follow(stream, str(tmp_path / "checkpoint"), order="at").trigger(availableNow=True).start().awaitTermination(120)
    assert rows(index.match(stored, "red").select("id")) == [(2,), (3,)] and rows(index.match(stored, "widget").select("id")) == [(1,)]
    assert index.match(stored, "blue").count() == 0


@pytest.mark.parametrize("asked", ["red widget", "w1", "wdgt red", "", "zzz"])
def test_similar_texts_from_postings(spark, tmp_path, asked):
    rng = random.Random(1)
    docs = spark.createDataFrame([(k, " ".join(rng.choices([*WORDS, "widgets", "wiget"], k=rng.randint(0, 4)))) for k in range(150)], "id bigint, title string")
    stored = index.StoredIndex(Snapshots(spark, str(tmp_path)), "id", index.gram_terms("id", "title"), buckets=8)
    stored.build(docs.where("id < 100"))
    stored.apply(docs.where("id >= 90"), 1)
    for above in (0.1, 0.25, 0.6):
        assert rows(index.similar(stored, asked, above)) == rows(search.similar(docs, "id", "title", asked, above))


def test_days_give_the_scores_of_all_clicks(spark, tmp_path):
    """Times within a day and at midnight; a further day is stored from its own clicks."""
    import datetime as dt

    from millrace.operators import rank
    from millrace.plans import derived

    rng = random.Random(8)
    start = dt.datetime(2024, 1, 1)
    clicks = [(rng.randrange(6), rng.choice(["home", "search", "x"]), start + dt.timedelta(microseconds=rng.randrange(40 * 86_400_000_000))) for _ in range(900)]
    clicks += [(7, "home", start + dt.timedelta(days=k)) for k in range(41)]  # at midnight
    df = spark.createDataFrame(clicks, "app_id bigint, source_page string, created_at timestamp_ntz")
    apps = spark.createDataFrame([(k, 10 * k) for k in range(10)], "app_id bigint, quality_score int")
    days = Snapshots(spark, str(tmp_path))
    derived.add_days(days, df.where("created_at < '2024-02-05'"))
    before = {f for f in days.read("sums").inputFiles()}
    for day in ("2024-02-05", "2024-02-06"):
        derived.add_days(days, df.where(F.col("created_at").cast("date") == F.lit(day)))
    assert before < {f for f in days.read("sums").inputFiles()}  # nothing that was stored is written again
    for as_of in (dt.datetime(2024, 2, 6), dt.datetime(2024, 2, 6, 17, 45, 1), dt.datetime(2024, 2, 5, 0, 0, 0, 1)):
        want = rank.trending(apps, df, F.lit(as_of))
        assert rows(derived.trending_of_days(days, apps, as_of)) == rows(want), as_of


def test_postings_are_dealt_once(spark):
    from millrace.operators import search

    docs = spark.createDataFrame([(1, "One one two", "two three"), (2, None, "the"), (1, "four", "")], "id bigint, a string, b string")
    found = search.postings(docs, "id", {"A": ["a"], "B": ["b"]})
    assert sorted((r.id, r.lexeme, r.weight) for r in found.collect()) == [(1, "four", 1.0), (1, "one", 1.0), (1, "three", 0.4), (1, "two", 1.0)]
    assert found.groupBy("id").count()._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
