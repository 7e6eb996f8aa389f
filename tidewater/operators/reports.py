"""Reports on coverage, corpora and versions, in long form: section, key, value.

Exact forms count everything; sketch forms are small, can be stored per partition and merged later, and state their error.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SCHEMA = "section string, key string, measure string, value double"


def _key(*columns: str) -> Column:
    return F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("null")) for c in columns])


def long(df: DataFrame, section: str, keys: list[str], measures: dict[str, Column]) -> DataFrame:
    """One row per key and measure of an aggregate; no keys: the whole."""
    got = df.groupBy(*keys).agg(*[c.cast("double").alias(n) for n, c in measures.items()])
    cells = F.explode(F.array(*[F.struct(F.lit(n).alias("measure"), F.col(n).alias("value")) for n in measures]))
    key = _key(*keys) if keys else F.lit("all")
    return got.select(F.lit(section).alias("section"), key.alias("key"), cells.alias("_c")).select("section", "key", "_c.measure", "_c.value")


def united(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionAll(p)
    return out


def percent(c: Column) -> Column:
    return F.round(100 * F.avg(c.cast("double")), 6)


def historical_coverage(groups: DataFrame, quotes: DataFrame, sep: str = "|") -> DataFrame:
    """Every figure of a historical quote dataset.

    groups, one per game, horizon and market: season, horizon, market, event_id, usable, complete (supported books with both sides), mapping
    (reliable, ambiguous, missing), requested_at, snapshot_at (epoch seconds or null), why (reasons joined by sep). quotes: horizon, market, book_id.
    Sections: coverage by season, horizon and market and by horizon and market, from one grouping-sets aggregate; games and reliably mapped games by
    season; mappings of (game, horizon) pairs; median and p90 of the distances of distinct (requested_at, snapshot_at) pairs, nearest rank; rows by
    horizon, market and book; rows by book; reasons.
    """
    of = lambda m: F.count_if(F.col("mapping") == m)
    measures = {
        "games": F.count("*"), "usable": F.count_if("usable"), "coverage_pct": percent(F.col("usable")), "two_books_pct": percent(F.col("complete") >= 2), "three_books_pct": percent(F.col("complete") >= 3),
        "reliable_mappings": of("reliable"), "ambiguous_mappings": of("ambiguous"), "missing_mappings": of("missing"),
    }
    sets = [["season", "horizon", "market"], ["horizon", "market"]]
    names = sets[0]
    both = groups.groupingSets([[F.col(c) for c in s] for s in sets], *names).agg(F.grouping("season").alias("_g"), *[c.cast("double").alias(n) for n, c in measures.items()])
    cells = F.explode(F.array(*[F.struct(F.lit(n).alias("measure"), F.col(n).alias("value")) for n in measures])).alias("_c")
    section, key = F.when(F.col("_g") == 0, "coverage").otherwise("aggregate_coverage"), F.when(F.col("_g") == 0, _key(*names)).otherwise(_key(*sets[1]))
    covered = both.select(section.alias("section"), key.alias("key"), cells).select("section", "key", "_c.measure", "_c.value")
    pairs = groups.where("snapshot_at is not null").select("requested_at", "snapshot_at").distinct().withColumn("distance", (F.col("requested_at") - F.col("snapshot_at")).cast("long"))
    disc = lambda q: F.expr(f"percentile_disc({q}) within group (order by distance)")
    mapped = groups.groupBy("event_id", "horizon").agg(F.max("mapping").alias("mapping"))
    reason = groups.select(F.explode(F.split("why", sep if sep.isalnum() else f"\\{sep}")).alias("reason")).where("reason <> ''")
    return united([
        covered,
        long(groups, "games_by_season", ["season"], {"games": F.count_distinct("event_id"), "reliably_mapped": F.count_distinct(F.when(F.col("mapping") == "reliable", F.col("event_id")))}),
        long(mapped, "event_horizon_reconciliation", ["mapping"], {"n": F.count("*")}),
        long(pairs, "distance_seconds", [], {"median": disc(0.5), "p90": disc(0.9), "pairs": F.count("*")}),
        long(quotes, "rows_by_horizon_market_book", ["horizon", "market", "book_id"], {"n": F.count("*")}),
        long(quotes, "book_frequency", ["book_id"], {"n": F.count("*")}),
        long(reason, "unusable_reasons", ["reason"], {"n": F.count("*")}),
    ])


#: Sketch size: the rank error of a quantile is about 1.33 % at 200, with 99 % confidence. Items that the top-k sketch follows.
KLL, ITEMS = 200, 1024


def coverage_sketches(groups: DataFrame, quotes: DataFrame, by: list[str]) -> DataFrame:
    """(by.., distances, books): one quantile sketch of the snapshot distances and one frequency sketch of the books per key; small, and mergeable."""
    distance = F.expr(f"kll_sketch_agg_bigint(CAST(requested_at - snapshot_at AS BIGINT), {KLL})").alias("distances")
    d = groups.where("snapshot_at is not null").groupBy(*by).agg(distance)
    b = quotes.groupBy(*by).agg(F.expr(f"approx_top_k_accumulate(book_id, {ITEMS})").alias("books"))
    return d.join(b, by, "full")


def sketched_coverage(sketches: DataFrame, by: list[str] | None = None, k: int = 20) -> DataFrame:
    """(by.., median, p90, books): quantiles within the sketch's rank error and the k most frequent books, from stored sketches merged over other keys.

    A frequency is exact while a key has fewer distinct books than three quarters of ITEMS; beyond, it may be too high by a bounded share.
    """
    quantile = lambda q: F.expr(f"kll_sketch_get_quantile_bigint(d, {q}D)")
    merged = sketches.groupBy(*(by or [])).agg(F.expr("kll_merge_agg_bigint(distances)").alias("d"), F.expr(f"approx_top_k_combine(books, {ITEMS})").alias("b"))
    return merged.select(*(by or []), quantile(0.5).alias("median"), quantile(0.9).alias("p90"), F.expr(f"approx_top_k_estimate(b, {k})").alias("books"))


# ---- versions


def resolve_chains(links: DataFrame, folder: str, id_col: str = "id", old_col: str = "supersedes") -> DataFrame:
    """(id, root, depth, state) of every version: the version its chain began with, how many lie between, and ok, dangling or cyclic.

    links: id and the id that it supersedes, null for a first one. Pointers jump: in a round every unfinished version takes the pointer of the one
    it points at, so a chain of n versions takes about log2(n) rounds, each an equi-join whose result is written to folder, a place that all executors share.
    dangling: the chain ends at an id that no row has, which is its root. cyclic: it never ends; root is null. Several rows of one id count as
    one, with the smallest id that they supersede.
    """
    spark = links.sparkSession

    def written(df: DataFrame) -> DataFrame:
        path = f"{folder}/chains-{uuid.uuid4().hex}"
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path)

    rows = links.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.min(old_col).alias("to"))
    rows = written(rows)
    n = rows.count()
    missing = rows.where("to is not null").select(F.col("to").alias("id")).distinct().join(rows, "id", "left_anti")
    ends = rows.where("to is null").select("id", F.lit("ok").alias("state")).unionAll(missing.select("id", F.lit("dangling").alias("state")))
    done = written(ends.select("id", F.col("id").alias("root"), F.lit(0).cast("long").alias("depth"), "state"))
    open_ = written(rows.where("to is not null").select("id", "to", F.lit(1).cast("long").alias("steps")))
    finished = [done.join(missing, "id", "left_anti")]
    reached = done
    for _ in range(max(1, n).bit_length() + 1):
        # those that point at a finished version are finished; the others jump
        at = reached.select(F.col("id").alias("to"), "root", F.col("depth").alias("_d"), "state")
        over = open_.select(F.col("id").alias("to"), F.col("to").alias("_to"), F.col("steps").alias("_s"))
        step = written(open_.join(at, "to", "left").join(over, "to", "left"))
        new = step.where("state is not null").select("id", "root", (F.col("steps") + F.col("_d")).alias("depth"), "state")
        finished.append(new)
        reached = written(reached.unionAll(new))
        open_ = step.where("state is null").select("id", F.col("_to").alias("to"), (F.col("steps") + F.col("_s")).alias("steps"))
        if open_.isEmpty():
            break
    cyclic = open_.select("id", F.lit(None).cast(dict(rows.dtypes)["id"]).alias("root"), F.lit(None).cast("long").alias("depth"), F.lit("cyclic").alias("state"))
    return united([*finished, cyclic])


def corpus_report(games: DataFrame, manifests: DataFrame, artifacts: DataFrame, folder: str, top: str = "fbs") -> DataFrame:
    """Every figure of a source corpus.

    games: game_id, season, home_class, away_class, home_id, away_id, exclusion. manifests: manifest_id, request_hash, response_bytes,
    stored_bytes, supersedes. artifacts: kind, row_count, game_ids (array). Sections: games by season and by the classes of the sides; exclusions;
    partitions with rows, rows, and share of games with a side of class `top` covered, by kind; identity gaps by kind; calls; versions and their chains.
    """
    h, a = F.col("home_class") == top, F.col("away_class") == top
    both, one = F.coalesce(h & a, F.lit(False)), F.coalesce(h | a, F.lit(False))
    gap = F.col("home_id").isNull() | F.col("away_id").isNull()
    g = games.withColumn("_one", one)
    universe = g.where("_one").select("game_id").distinct()
    seen = artifacts.select("kind", F.explode("game_ids").alias("game_id")).distinct().join(universe, "game_id", "left_semi").groupBy("kind").agg(F.count("*").alias("covered"))
    kinds = artifacts.select("kind").distinct().join(seen, "kind", "left").join(universe.agg(F.count("*").alias("total")))
    covered = F.coalesce(F.max("covered"), F.lit(0))
    chains = resolve_chains(manifests, folder, "manifest_id")
    held = chains.groupBy("root").agg(F.max("depth").alias("depth"), F.max("state").alias("state"))
    return united([
        long(g, "games_by_season", ["season"], {"games": F.count("*"), "both_top": F.count_if(both), "top_and_other": F.count_if(one & ~both)}),
        long(g.withColumn("exclusion", F.coalesce("exclusion", F.lit("eligible"))), "exclusions", ["exclusion"], {"games": F.count("*")}),
        long(artifacts, "artifacts", ["kind"], {"partitions_with_rows": F.count_if(F.col("row_count") > 0), "rows": F.coalesce(F.sum("row_count"), F.lit(0))}),
        long(kinds, "coverage", ["kind"], {"games": covered, "total_games": F.max("total"), "percentage": F.coalesce(F.round(100 * F.try_divide(covered, F.max("total")), 2), F.lit(0.0))}),
        long(g, "identity_gaps", [], {
            "missing_home": F.count_if(F.col("home_id").isNull()), "missing_away": F.count_if(F.col("away_id").isNull()), "missing_identities": F.count_if(gap), "missing_participants": F.count_if(gap & one),
            "ambiguous": F.count_if(F.coalesce(F.col("exclusion") == "unresolved_program_identity", F.lit(False))),
        }),
        long(manifests, "calls", [], {
            "recorded": F.count("*"), "unique_requests": F.count_distinct("request_hash"), "reuses": F.greatest(F.lit(0), F.count("*") - F.count_distinct("request_hash")),
            "response_bytes": F.coalesce(F.sum("response_bytes"), F.lit(0)), "stored_bytes": F.coalesce(F.sum("stored_bytes"), F.lit(0)), "supersessions": F.count("supersedes"),
        }),
        long(held.where("state <> 'cyclic'"), "chains", [], {"chains": F.count("*"), "longest": F.coalesce(F.max("depth") + 1, F.lit(0)), "of_several_versions": F.count_if(F.col("depth") > 0), "dangling": F.count_if(F.col("state") == "dangling")}),
        long(chains, "versions", ["state"], {"n": F.count("*")}),
    ])


# ---- features


def feature_report(rows: DataFrame, games: DataFrame, families: dict[str, list[str]], quality: list[str], early: int = 3, full: int = 4) -> DataFrame:
    """Every figure of a feature dataset.

    rows, one per game and horizon: season, week, horizon, home_games and away_games (of the season so far), adjusted (opponent adjustment on both sides), regime, features and
    the quality ratios. games: exclusion. Sections: rows by season and by horizon; how many games the sides had behind them in the first
    `early` weeks (`full` and more together); exclusions; cells present by feature family; means of the quality ratios, null as 0; adjustment and regime.
    """
    n = {"n": F.count("*")}
    depth = rows.where(F.col("week") <= early).select(F.explode(F.array("home_games", "away_games")).alias("d")).select(F.when(F.col("d") < full, F.col("d").cast("string")).otherwise(f"{full}_plus").alias("depth"))
    held = lambda cs: F.sum(sum((F.col(c).isNotNull().cast("long") for c in cs), F.lit(0)))
    total = lambda cs: F.count("*") * len(cs)
    cover = [long(rows, "family_coverage", [], {"present_cells": held(cs), "total_cells": total(cs), "missing_cells": total(cs) - held(cs), "coverage": F.round(F.try_divide(held(cs), total(cs)), 6)}).withColumn("key", F.lit(f)) for f, cs in families.items()]
    means = {c: F.round(F.avg(F.coalesce(F.col(c).cast("double"), F.lit(0.0))), 6) for c in quality}
    return united([
        long(rows, "rows_by_season", ["season"], n), long(rows, "rows_by_horizon", ["horizon"], n), long(depth, "early_depth", ["depth"], n),
        long(games.withColumn("exclusion", F.coalesce("exclusion", F.lit("eligible"))), "exclusions", ["exclusion"], n), *cover, long(rows, "quality", [], means),
        long(rows, "adjustment", [], {"rows": F.count_if("adjusted"), "share": F.round(F.avg(F.coalesce(F.col("adjusted"), F.lit(False)).cast("double")), 6), "regime_rows": F.count_if("regime")}),
    ])


def preseason_coverage(facts: DataFrame, families: dict[str, str], sources: dict[str, DataFrame] | None = None) -> DataFrame:
    """Team seasons by season, those with each family (name -> column that is null without it), and the rows of every source."""
    parts = [long(facts, "by_season", ["season"], {"team_seasons": F.count("*")} | {f: F.count(c) for f, c in families.items()})]
    parts += [long(df, "source_rows", [], {"n": F.count("*")}).withColumn("key", F.lit(name)) for name, df in (sources or {}).items()]
    return united(parts)
