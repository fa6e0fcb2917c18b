"""Which records are the same thing: identity keys, blocked name similarity, plans for merging pairs."""

from __future__ import annotations

import difflib
import math

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import domain, repo_identity, slugify, url_identity
from .relational import first_by, top_by

STRONG, WEAK, WEAK_WITH_DOMAIN = 0.85, 0.92, 0.65
WEAK_KEPT = 5
URLS = ("developer_url", "official_page_url", "install_url", "repo_url", "official_directory_url")


def name_ratio(a: Column, b: Column) -> Column:
    """The matching-block ratio of two names. No built-in has it; names are short and come in Arrow batches.

    Spark takes it for non-deterministic, so that a filter on the ratio does not have it worked out again."""

    @F.pandas_udf("double")
    def ratio(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([difflib.SequenceMatcher(None, (p or "").lower().strip(), (q or "").lower().strip()).ratio() if p and q else 0.0 for p, q in zip(x, y)])

    return ratio.asNondeterministic()(a, b)


def _pieces(name: str, least: float) -> tuple[list[str], list[str]]:
    """Keys of a name as the second and as the first of a pair with a ratio of `least` or more.

    Such a pair of n and m letters differs by d = (1 - least)(n + m) insertions and deletions at most. Of d + 1 pieces of
    the second name one is whole in the first, moved by d places at most."""
    part, whole, n = [], [], len(name)
    for other in range(math.ceil(n * least / (2 - least) - 1e-9), math.floor(n * (2 - least) / least + 1e-9) + 1) if n else ():
        d = math.floor((1 - least) * (n + other) + 1e-9)
        for i in range(d + 1):
            a, b = i * n // (d + 1), (i + 1) * n // (d + 1)
            part.append(f"{other},{n},{i},{name[a:b]}")
            a, b = i * other // (d + 1), (i + 1) * other // (d + 1)
            whole += {f"{n},{other},{i},{name[k : k + b - a]}" for k in range(max(0, a - d), min(n - (b - a), a + d) + 1)}
    return part, whole


def close_pairs(names: DataFrame, key: str, name: str, least: float = WEAK) -> DataFrame:
    """(key + 1, key + 2): pairs, either way round, of which each with a ratio of `least` or more is one. None is lost."""

    @F.pandas_udf("struct<part:array<string>,whole:array<string>>")
    def pieces(x: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([_pieces((p or "").lower().strip(), least - 1e-6) for p in x], columns=["part", "whole"])

    keyed = names.select(key, pieces(F.col(name)).alias("_keys"))
    first = keyed.select(F.col(key).alias(f"{key}1"), F.explode("_keys.whole").alias("_piece"))
    second = keyed.select(F.col(key).alias(f"{key}2"), F.explode("_keys.part").alias("_piece"))
    return first.join(second, "_piece").where(F.col(f"{key}1") != F.col(f"{key}2")).drop("_piece").distinct()


def identity_keys(records: DataFrame, key: str, urls: tuple[str, ...] = URLS) -> DataFrame:
    """(key, kind, value) of each record: repositories (1), urls (2), the developer's domain (3), the slug (4)."""
    kinds = [F.struct(F.lit(1).alias("kind"), repo_identity(F.col(u)).alias("value")) for u in urls]
    kinds += [F.struct(F.lit(2).alias("kind"), url_identity(F.col(u)).alias("value")) for u in urls]
    kinds += [F.struct(F.lit(3).alias("kind"), domain(F.col("developer_url")).alias("value"))]
    kinds += [F.struct(F.lit(4).alias("kind"), slugify(F.coalesce(F.nullif(F.col("slug_hint"), F.lit("")), F.col("name"))).alias("value"))]
    return records.select(key, F.inline(F.array(*kinds))).where("value is not null and value <> ''").distinct()


def strong_matches(drafts: DataFrame, apps: DataFrame, order: list[Column], draft: str = "draft_id", app: str = "app_id") -> DataFrame:
    """(draft, app, kind): the first app in order that shares a key with the draft, by its first kind of key.

    Of all apps of one value of a key only the first in order can win, so only it is joined. A shared developer's domain
    needs similar names too: there names are compared once for each domain, whatever the number of drafts and apps that
    have them, and only those that share a piece that similar names must share; then the first app of a name stands for
    all, and the first of the names that are close to a draft's name for the domain."""
    left = identity_keys(drafts, draft)
    right = identity_keys(apps, app)
    place = [*order, F.col(app).asc()]
    firsts = first_by(right.where("kind <> 3").join(apps, app), ["kind", "value"], *place).select("kind", "value", app)
    sure = left.where("kind <> 3").join(firsts, ["kind", "value"]).select(draft, app, "kind")

    node = lambda keys, rows, key: keys.where("kind = 3").select(key, F.col("value").alias("_domain")).join(rows.withColumn("_name", F.lower(F.trim("name"))), key).where("_name <> ''")
    ours = node(left, drafts.select(draft, "name"), draft)
    theirs = first_by(node(right, apps, app), ["_domain", "_name"], *place)
    near = close_in_block(ours.select("_domain", "_name").distinct(), theirs.select("_domain", "_name"), "_domain", "_name", STRONG)
    reached = near.join(theirs.withColumnRenamed("_name", "_other"), ["_domain", "_other"])
    best = first_by(reached, ["_domain", "_name"], *place).select("_domain", "_name", app)
    close = ours.join(best, ["_domain", "_name"]).select(draft, app, F.lit(3).alias("kind"))
    whole = sure.unionByName(close).join(apps, app)
    return first_by(whole, [draft], *place, F.col("kind").asc()).select(draft, app, "kind")


def close_in_block(left: DataFrame, right: DataFrame, block: str, name: str, least: float) -> DataFrame:
    """(block, name, _other): distinct names of left with those of right in the same block that have a ratio of `least` or
    more. Names meet by pieces that such names share; the block is part of the key, so a large block is spread by pieces."""

    @F.pandas_udf("struct<part:array<string>,whole:array<string>>")
    def pieces(x: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([_pieces(p or "", least - 1e-6) for p in x], columns=["part", "whole"])

    first = right.select(block, F.col(name).alias("_other"), F.explode(pieces(F.col(name))["whole"]).alias("_piece"))
    second = left.select(block, name, F.explode(pieces(F.col(name))["part"]).alias("_piece"))
    met = second.join(first, [block, "_piece"]).select(block, name, "_other").distinct()
    return met.where(name_ratio(F.col("_other"), F.col(name)) >= least)


def duplicate_candidates(made: DataFrame, apps: DataFrame, kept: int = WEAK_KEPT, least: float = WEAK) -> DataFrame:
    """(app_id, candidate_app_id, score): for each made app (app_id, name) the apps of lower ids with very similar names, the
    best `kept` (a top-k report).

    Names are compared once each; of the apps of a name only the first `kept` can be among the best of another app."""
    clean = lambda df: df.select("app_id", F.lower(F.trim("name")).alias("_name")).where("_name <> ''").withColumn("_all", F.lit(True))
    ours, theirs = clean(made), clean(apps)
    near = close_in_block(ours.select("_all", "_name").distinct(), theirs.select("_all", "_name").distinct(), "_all", "_name", least)
    near = near.withColumn("score", F.round(name_ratio(F.col("_other"), F.col("_name")), 6))
    first = top_by(theirs, ["_name"], kept, F.asc("app_id"), rank="_place").select(F.col("_name").alias("_other"), F.col("app_id").alias("candidate_app_id"))
    pairs = ours.join(near, ["_all", "_name"]).join(first, "_other").where("candidate_app_id < app_id")
    return top_by(pairs, ["app_id"], kept, F.desc("score"), F.asc("candidate_app_id")).select("app_id", "candidate_app_id", "score")


def weak_matches(pairs: DataFrame, left: str, right: str, a: Column, b: Column, shares_domain: Column, kept: int = WEAK_KEPT) -> DataFrame:
    """Of blocked pairs, those with very similar names, or similar ones and a common domain: the best of each left row
    (a top-k report)."""
    scored = pairs.withColumn("score", F.round(name_ratio(a, b), 6))
    fit = scored.where((F.col("score") >= WEAK) | (shares_domain & (F.col("score") >= WEAK_WITH_DOMAIN)))
    return top_by(fit, [left], kept, F.desc("score"), F.asc(right))


def merge_target(pairs: DataFrame, a: str, b: str, score_a: str, score_b: str) -> DataFrame:
    """pairs with target and source: the higher score stays, of equal ones the lower id."""
    keep_a = (F.col(score_a) > F.col(score_b)) | ((F.col(score_a) == F.col(score_b)) & (F.col(a) < F.col(b)))
    return pairs.withColumns({"target": F.when(keep_a, F.col(a)).otherwise(F.col(b)), "source": F.when(keep_a, F.col(b)).otherwise(F.col(a))})


def repointed(rows: DataFrame, owner: str, item: str, moves: DataFrame) -> DataFrame:
    """rows (owner, item, id) with owners moved by moves (source, target); of rows that then collide the first id stays."""
    moved = rows.join(moves.select(F.col("source").alias(owner), "target"), owner, "left")
    moved = moved.withColumn(owner, F.coalesce("target", owner)).drop("target")
    return first_by(moved, [owner, item], F.col("id").asc())


def one_primary(rows: DataFrame, owner: str) -> DataFrame:
    """rows (id, is_primary) so that each owner keeps one primary row at most: the first that was one."""
    firsts = rows.where("is_primary").groupBy(owner).agg(F.min("id").alias("_first"))
    return rows.join(firsts, owner, "left").withColumn("is_primary", F.coalesce(F.col("id") == F.col("_first"), F.lit(False))).drop("_first")


def unique_slugs(records: DataFrame, key: str, base: str, size: int = 200) -> DataFrame:
    """(key, slug): the first record of a base slug has it as it is, the others get -2, -3 and so on, without the numbers
    that make another base slug; the base is cut so that the number fits in `size`."""
    place = F.row_number().over(Window.partitionBy(base).orderBy(key))
    placed = records.select(key, F.coalesce(F.nullif(F.col(base), F.lit("")), F.lit("app")).alias(base)).withColumn("_i", place)
    end = F.regexp_extract(base, r"^(.+)-([1-9][0-9]{0,8})$", 2)
    taken = placed.where("_i = 1").select(F.regexp_extract(base, r"^(.+)-([1-9][0-9]{0,8})$", 1).alias(base), F.try_to_number(end, F.lit("999999999")).cast("int").alias("_n"))
    taken = taken.where("_n is not null").groupBy(base).agg(F.array_sort(F.collect_set("_n")).alias("_taken"))
    both = placed.join(taken, base, "left")
    number = F.aggregate(F.coalesce("_taken", F.array().cast("array<int>")), F.col("_i"), lambda i, n: F.when((n > 1) & (n <= i), i + 1).otherwise(i))
    numbered = F.concat_ws("-", F.substr(base, F.lit(1), size - 1 - F.length(number.cast("string"))), number)
    return both.select(key, F.when(F.col("_i") == 1, F.col(base)).otherwise(numbered).alias("slug"))


def shared_domains(left: DataFrame, right: DataFrame, a: str, b: str, urls: tuple[str, ...] = URLS, ignored: tuple[str, ...] = ()) -> DataFrame:
    """(a, b, domains) of records with a common domain in any address, but for ignored ones (hosts of many makers)."""
    each = lambda df, key: df.select(key, F.explode(F.array_distinct(F.array(*(domain(F.col(u)) for u in urls)))).alias("_d")).where(
        (F.col("_d") != "") & ~F.col("_d").isin(*ignored)
    )
    return each(left, a).join(each(right, b), "_d").groupBy(a, b).agg(F.array_sort(F.collect_set("_d")).alias("domains"))
