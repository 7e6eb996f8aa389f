"""Raw snapshots: nested JSON to rows, damaged input to warnings, fingerprints and manifests of datasets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

OUTCOME = "struct<side:bigint,odds:bigint,point:double>"
SCHEMA = f"struct<id:bigint,start:bigint,books:array<struct<key:bigint,updated:bigint,markets:array<struct<key:bigint,updated:bigint,outcomes:array<{OUTCOME}>>>>>>"
#: Key names that a stored document must not have, fixed values.
SECRETS = ["apikey", "api_key", "authorization", "password", "token"]


def scan_partitioned(spark: SparkSession, path: str, columns: list[str], key: str, low, high) -> DataFrame:
    """Projected scan of the partitions between two keys; other columns and partitions are not read."""
    return spark.read.parquet(path).where(F.col(key).between(low, high)).select(*columns)


def write_partitioned(df: DataFrame, path: str, keys: list[str], sort: list[str], mode: str = "error") -> None:
    """Sorted Zstandard Parquet by partition; rows of a partition are spread over files by size, so no key is one task's work."""
    df.hint("rebalance", *keys).sortWithinPartitions(*keys, *sort).write.mode(mode).option("compression", "zstd").partitionBy(*keys).parquet(path)


def parsed(raw: DataFrame, body: str = "body") -> DataFrame:
    return raw.withColumn("doc", F.from_json(body, SCHEMA))


def _any_case(name: str) -> str:
    """A pattern of what is this name in lower case with _ for -; k is also the lower case of the Kelvin sign, as no other letter is of two."""
    return "".join("[-_]" if c == "_" else r"[kK\x{212A}]" if c == "k" else f"[{c}{c.upper()}]" for c in name)


#: Cases are in the pattern, and a look at a key's first letter comes before the names: a copy of each text in lower case costs several times the search.
LEAK = '"(?=[' + "".join(sorted({c for name in SECRETS for c in (name[0], name[0].upper())})) + "])(?:" + "|".join(_any_case(name) for name in SECRETS) + ')"\\s*:'


def leaks(body: str = "body") -> Column:
    """Whether a JSON text has one of the forbidden keys at any depth, in any case, with - or _."""
    return F.col(body).rlike(LEAK)


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """Rows dealt by keys to as many tasks as the session's shuffles have. Adaptive execution merges tasks by their bytes, but the work on a byte of JSON is long: few uneven tasks would be left."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def scan_credential_keys(raw: DataFrame, body: str = "body") -> DataFrame:
    """Whole documents that must not be stored: those that parse and have a forbidden key."""
    return raw.where(leaks(body) & F.from_json(body, SCHEMA)["id"].isNotNull())


def broken() -> Column:
    """Why a whole document (body, doc) can't be read; null where it can."""
    return (
        F.when(leaks(), "credential_key").when(F.col("doc.id").isNull(), "malformed_event").when(F.col("doc.books").isNull(), "malformed_bookmakers")
        .when(F.col("doc.start").isNull(), "event_not_normalized")
    )


def readable(raw: DataFrame) -> DataFrame:
    """The documents (.., body, doc) that can be read, each parsed once."""
    x = parsed(raw).withColumn("_r", broken())
    # an unnested array instead of a filter: a filter would move below the parsed column and parse the body once per condition
    return x.select("*", F.explode_outer(F.when(F.col("_r").isNull(), F.array(F.lit(1)))).alias("_k")).where("_k is not null").drop("_r", "_k")


def quarantine_malformed(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(documents that can be read, warnings (snapshot_id, reason, place)); damage costs only the part that has it, and fails no batch.

    Whole documents: credential_key, malformed_event (no JSON or no id), malformed_bookmakers, event_not_normalized (no start). Within the
    documents that are kept: malformed_bookmaker (no key or no markets), observation_not_normalized (a market without a key or
    outcomes, or an outcome without side or odds), duplicate_observation_skipped (an outcome again in its snapshot, event, book
    and market). place: book/market/outcome, counted from 0.
    """
    return readable(raw), read_documents(raw).where("reason is not null").select("snapshot_id", "reason", "place")


def batch_status(raw: DataFrame, warnings: DataFrame) -> DataFrame:
    """(snapshot_id, warnings, status) of every batch: success, or partial where anything was left out."""
    n = warnings.groupBy("snapshot_id").agg(F.count("*").alias("warnings"))
    got = raw.select("snapshot_id").distinct().join(n, "snapshot_id", "left").withColumn("warnings", F.coalesce("warnings", F.lit(0)))
    return got.withColumn("status", F.when(F.col("warnings") == 0, "success").otherwise("partial"))


#: Columns of read_documents().
DOCUMENTS = (
    "snapshot_id long, reason string, place string, event_id long, start long, book_no int, book_id long, market_no int, market long, "
    "observed long, outcome_no int, side long, odds long, point double"
)


def read_documents(raw: DataFrame) -> DataFrame:
    """Outcomes and warnings of JSON snapshots (snapshot_id, body) in one pass: rows with a reason are warnings, the others outcomes.

    The body is parsed once and each level unnested once; what is damaged goes on as one row with its reason and place. Rows without a
    reason are those of flatten_quotes(), repeats and damaged ones left out; reasons and places are those of quarantine_malformed().
    Documents are dealt by snapshot before they are parsed, so that repeats are found without a shuffle of the outcomes.
    """
    lost = "observation_not_normalized"
    x = parsed(dealt(raw.select(F.col("snapshot_id").cast("long").alias("snapshot_id"), "body"), "snapshot_id")).select("snapshot_id", broken().alias("reason"), "doc")
    # an array that is not to be unnested is null, which gives one row without a place; an empty one is left out
    inner = lambda array: F.when(F.col("reason").isNull(), F.col(array))
    kept = lambda df, n, array: df.where(F.col("reason").isNotNull() | F.col(n).isNotNull()).drop(array)
    b = x.select("snapshot_id", "reason", F.col("doc.id").alias("event_id"), F.col("doc.start").alias("start"), F.posexplode_outer(inner("doc.books")).alias("book_no", "b"))
    b = kept(b, "book_no", "doc")
    bad = F.when(F.col("reason").isNull() & (F.col("b.key").isNull() | F.col("b.markets").isNull()), "malformed_bookmaker")
    b = b.withColumn("reason", F.coalesce("reason", bad))
    names = ["snapshot_id", "reason", "event_id", "start", "book_no", F.col("b.key").alias("book_id"), F.col("b.updated").alias("_u")]
    m = kept(b.select(*names, F.col("book_no").isNull().alias("_w"), F.posexplode_outer(inner("b.markets")).alias("market_no", "m")), "market_no", "b")
    m = m.withColumn("reason", F.coalesce("reason", F.when(F.col("m.key").isNull() | F.col("m.outcomes").isNull(), lost)))
    names = ["snapshot_id", "reason", "event_id", "start", "book_no", "book_id", "market_no", F.col("m.key").alias("market"), F.coalesce("m.updated", "_u").alias("observed")]
    o = kept(m.select(*names, F.posexplode_outer(inner("m.outcomes")).alias("outcome_no", "o")), "outcome_no", "m")
    o = o.withColumn("reason", F.coalesce("reason", F.when(F.col("o.side").isNull() | F.col("o.odds").isNull(), lost)))
    o = o.select("*", "o.side", "o.odds", "o.point").drop("o")
    same = Window.partitionBy("snapshot_id", "event_id", "book_id", "market", "side", "point", "odds").orderBy("book_no", "market_no", "outcome_no")
    again = F.when(F.col("reason").isNull() & (F.row_number().over(same) > 1), "duplicate_observation_skipped")
    place = F.when(F.col("reason").isNotNull(), F.concat_ws("/", "book_no", "market_no", "outcome_no"))
    o = o.withColumn("reason", F.coalesce("reason", again)).withColumn("place", place)
    return o.select(*[F.col(c.split()[0]).cast(c.split()[1]) for c in DOCUMENTS.split(", ")])


def flatten_quotes(good: DataFrame) -> DataFrame:
    """One row per outcome with its places in the nested arrays; a market without a time takes its book's."""
    # outer, as an inner one has its array tested below the parsed column, which parses the body again
    b = good.select("snapshot_id", F.col("doc.id").alias("event_id"), F.col("doc.start").alias("start"), F.posexplode_outer("doc.books").alias("book_no", "b")).where("book_no is not null")
    m = b.select("snapshot_id", "event_id", "start", "book_no", F.col("b.key").alias("book_id"), F.col("b.updated").alias("_u"), F.posexplode_outer("b.markets").alias("market_no", "m")).where("market_no is not null")
    o = m.select("snapshot_id", "event_id", "start", "book_no", "book_id", "market_no", F.col("m.key").alias("market"), F.coalesce("m.updated", "_u").alias("observed"), F.posexplode_outer("m.outcomes").alias("outcome_no", "o")).where("outcome_no is not null")
    return o.select("snapshot_id", "event_id", "start", "book_no", "book_id", "market_no", "market", "observed", "outcome_no", "o.side", "o.odds", "o.point")


def nest_quotes(quotes: DataFrame) -> DataFrame:
    """The inverse: one JSON document per snapshot and event. Arrays hold one snapshot of one event, which is small."""
    # dealt once by what a document is of: all three levels group within that, without a shuffle of their own
    o = dealt(quotes, "snapshot_id", "event_id").groupBy("snapshot_id", "event_id", "start", "book_id", "market").agg(F.min("observed").alias("updated"), F.sort_array(F.collect_list(F.struct("side", "odds", "point"))).alias("outcomes"))
    m = o.groupBy("snapshot_id", "event_id", "start", "book_id").agg(F.sort_array(F.collect_list(F.struct(F.col("market").alias("key"), "updated", "outcomes"))).alias("markets"))
    b = m.groupBy("snapshot_id", "event_id", "start").agg(F.sort_array(F.collect_list(F.struct(F.col("book_id").alias("key"), "markets"))).alias("books"))
    return b.select("snapshot_id", F.to_json(F.struct(F.col("event_id").alias("id"), "start", "books")).alias("body"))


def dataset_fingerprint(df: DataFrame) -> DataFrame:
    """Rows, schema hash and an order-insensitive content hash in one aggregate."""
    schema = F.sha2(F.lit(df.schema.json()), 256)
    row = lambda salt: F.sum(F.xxhash64(F.lit(salt), *df.columns).cast("decimal(38,0)")).cast("string")
    return df.agg(F.count("*").alias("rows"), row(1).alias("content_a"), row(2).alias("content_b")).withColumn("schema_hash", schema)


def validate_dataset(df: DataFrame, key: list[str], season: str, max_season: int, rows: int | None = None) -> DataFrame:
    """Violations (rule, n): rows against the manifest, repeated keys, seasons beyond the fence, null keys. Rules that hold are left out."""
    one = df.agg(F.count("*").alias("n"), F.count_if(F.col(season) > max_season).alias("season_fence"), F.count_if(F.greatest(*[F.col(k).isNull().cast("int") for k in key]) == 1 if len(key) > 1 else F.col(key[0]).isNull()).alias("null_key"))
    dup = df.groupBy(*key).agg(F.count("*").alias("c")).where("c > 1").agg(F.count("*").alias("duplicate_key"))
    off = F.lit(0).cast("long") if rows is None else F.abs(F.col("n") - rows)
    return one.join(dup).select(off.alias("row_count"), "season_fence", "null_key", "duplicate_key").unpivot([], ["row_count", "season_fence", "null_key", "duplicate_key"], "rule", "n").where("n > 0")


def profile_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows, nulls and distinct values per column, long form; one aggregate."""
    cells = [F.struct(F.lit(c).alias("column"), F.count_if(F.col(c).isNull()).alias("nulls"), F.count_distinct(c).alias("distinct_values")) for c in columns]
    return df.agg(F.count("*").alias("rows"), F.array(*cells).alias("x")).select("rows", F.explode("x").alias("x")).select("rows", "x.*")


def build_request_plan(games: DataFrame) -> DataFrame:
    """Requests to make: per day three hours before its first kickoff, per game an hour and five minutes before; equal times are merged."""
    day = games.groupBy("day").agg((F.min("kickoff") - 10800).alias("at"), F.collect_list("game_id").alias("games")).select("at", F.explode("games").alias("game_id"))
    own = games.select(F.explode(F.array(F.col("kickoff") - 3600, F.col("kickoff") - 300)).alias("at"), "game_id")
    return day.unionByName(own).distinct().groupBy("at").agg(F.count("*").alias("games"), F.min("game_id").alias("first_game"))


GAME = "struct<id:bigint,season:int,week:int,start:bigint,home:struct<id:bigint,points:int>,away:struct<id:bigint,points:int>,status:string>"
PLAY = "struct<id:bigint,game:bigint,offense:bigint,down:int,distance:int,yards:int,clock:struct<minutes:int,seconds:int>>"
STATS = "struct<game:bigint,teams:array<struct<team:bigint,stats:array<struct<category:string,value:string>>>>>"
VENUE = "struct<id:bigint,name:string,zone:string,elevation:double,dome:boolean>"


def flatten_games(raw: DataFrame, parties: DataFrame) -> DataFrame:
    """One row per game: canonical ids of both parties (id -> party), margin and total where both scores are known, availability."""
    g = raw.select(F.from_json("body", GAME).alias("g")).where("g.id is not null").select("g.*")
    side = lambda n: parties.select(F.col("id").alias(f"_{n}"), F.col("party").alias(f"{n}_party"))
    g = g.withColumn("_h", F.col("home.id")).withColumn("_a", F.col("away.id"))
    g = g.join(side("home"), F.col("_h") == F.col("_home"), "left").join(side("away"), F.col("_a") == F.col("_away"), "left")
    margin, total = F.col("home.points") - F.col("away.points"), F.col("home.points") + F.col("away.points")
    return g.select(F.col("id").alias("game_id"), "season", "week", F.col("start").alias("kickoff"), "home_party", "away_party", margin.alias("margin"), total.alias("total"), (F.col("start") + 86400).alias("available_at"))


def flatten_plays(raw: DataFrame, games: DataFrame) -> DataFrame:
    """Plays with their clock in seconds; those of unknown games are dropped."""
    p = raw.select(F.from_json("body", PLAY).alias("p")).where("p.id is not null").select("p.*")
    known = games.select("game_id", "season")
    return p.join(known, F.col("game") == F.col("game_id")).select("game_id", "season", F.col("id").alias("play_id"), "offense", "down", "distance", "yards", (F.col("clock.minutes") * 60 + F.col("clock.seconds")).alias("clock_s"))


def flatten_drives(drives: DataFrame) -> DataFrame:
    """Points of a drive are its end score minus its start score, null if either is."""
    return drives.withColumn("points", F.col("end_score") - F.col("start_score"))


#: Fields of a drive in its document, with their types; fixed values.
DRIVE = {
    "id": "string", "driveNumber": "int", "offense": "string", "defense": "string", "startPeriod": "int", "endPeriod": "int", "plays": "int", "yards": "int", "startOffenseScore": "int", "endOffenseScore": "int", "driveResult": "string",
    "scoring": "boolean",
}


def land_variants(raw: DataFrame, path: str, id_col: str = "document_id") -> None:
    """Writes documents (id, body) as (id, doc VARIANT): bodies are parsed once, and later scans read the fields that they ask for. What is no JSON has a null doc."""
    raw.select(F.col(id_col).alias("document_id"), F.try_parse_json("body").alias("doc")).write.mode("error").parquet(path)


def flatten_drive_documents(documents: DataFrame, games: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(drives, warnings (document_id, reason, place)) of documents (document_id, doc VARIANT), {"gameId": .., "drives": [..]}.

    games: game_id, home, away, home_name, away_name. A drive's sides are known where they are its game's by name. Points are end score minus
    start score, null if either is. Whole documents: malformed_document (no JSON or no game id), unknown_game, malformed_drives (no array). Within the others: malformed_drive (no
    object), and drive_without_id; a field of another type is null and harms no other. place: the drive's number in its document, from 0.
    """
    get = lambda path, kind: F.try_variant_get("doc", path, kind)
    x = documents.select("document_id", get("$.gameId", "bigint").alias("game_id"), get("$.drives", "array<variant>").alias("drives"))
    known = games.select("game_id", "home", "away", "home_name", "away_name", F.lit(True).alias("_known"))
    x = x.join(known, "game_id", "left")
    reason = F.when(F.col("game_id").isNull(), "malformed_document").when(F.col("_known").isNull(), "unknown_game").when(F.col("drives").isNull(), "malformed_drives")
    x = x.withColumn("reason", reason)
    whole = x.where("reason is not null").select("document_id", "reason", F.lit("").alias("place"))
    d = x.where("reason is null").select("document_id", "game_id", "home", "away", "home_name", "away_name", F.posexplode("drives").alias("place", "d"))
    fields = {n: F.try_variant_get("d", f"$.{n}", kind) for n, kind in DRIVE.items()}
    d = d.withColumn("_object", F.coalesce(F.schema_of_variant("d").startswith("OBJECT"), F.lit(False))).select("*", *[c.alias(n) for n, c in fields.items()]).drop("d")
    bad = F.when(~F.col("_object"), "malformed_drive").when(F.col("id").isNull(), "drive_without_id")
    d = d.withColumn("reason", bad)
    lost = d.where("reason is not null").select("document_id", "reason", F.col("place").cast("string").alias("place"))
    side = lambda c: F.when(F.col(c) == F.col("home_name"), F.col("home")).when(F.col(c) == F.col("away_name"), F.col("away"))
    good = d.where("reason is null").select(
        "game_id", F.col("id").alias("drive_id"), F.col("driveNumber").alias("drive_number"), side("offense").alias("offense"), side("defense").alias("defense"), F.col("startPeriod").alias("start_period"),
        F.col("endPeriod").alias("end_period"), "plays", "yards", (F.col("endOffenseScore") - F.col("startOffenseScore")).alias("points"), F.col("driveResult").alias("drive_result"), "scoring",
        (side("offense").isNotNull() & side("defense").isNotNull()).alias("identity_resolved"),
    )
    return good, whole.unionAll(lost)


def flatten_team_stats(raw: DataFrame) -> DataFrame:
    """teams > stats to long form."""
    t = raw.select(F.from_json("body", STATS).alias("s")).select("s.game", F.explode("s.teams").alias("t"))
    return t.select(F.col("game").alias("game_id"), "t.team", F.explode("t.stats").alias("x")).select("game_id", "team", "x.category", "x.value")


def flatten_venues(raw: DataFrame) -> DataFrame:
    return raw.select(F.from_json("body", VENUE).alias("v")).select("v.*").where("id is not null")


def value_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, value, n): how often each value of each column occurs, nulls among them, in one pass."""
    cells = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns]))
    return df.select(cells.alias("_c")).groupBy("_c.column", "_c.value").agg(F.count("*").alias("n"))


def nulls_by_group(df: DataFrame, by: list[str], column: str) -> DataFrame:
    """Rows and nulls of one column per group."""
    return df.groupBy(*by).agg(F.count("*").alias("rows"), F.count_if(F.col(column).isNull()).alias("nulls"))
