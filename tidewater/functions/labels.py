"""Column functions on names, times, bands and flags. Unknown input gives null unless a label is stated."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Names by their aliases.
BOOKS = {
    "draftkings": "draftkings", "draft kings": "draftkings", "fanduel": "fanduel", "fan duel": "fanduel", "betmgm": "betmgm", "bet mgm": "betmgm",
    "betrivers": "betrivers", "bet rivers": "betrivers", "williamhill_us": "williamhill_us", "caesars": "williamhill_us", "caesars sportsbook": "williamhill_us",
    "fanatics": "fanatics", "fanatics sportsbook": "fanatics",
}
LEAGUES = {
    "NCAAF": "NCAAF", "CFB": "NCAAF", "COLLEGE_FOOTBALL": "NCAAF", "COLLEGE FOOTBALL": "NCAAF", "NFL": "NFL", "NCAAB": "NCAAB", "NCAAM": "NCAAB", "NCAA": "NCAAB", "NCAA_M": "NCAAB",
    "NCCAMB": "NCAAB", "COLLEGE_BASKETBALL": "NCAAB", "COLLEGE_MENS_BASKETBALL": "NCAAB", "NBA": "NBA", "NHL": "NHL", "MLB": "MLB", "WNBA": "WNBA",
}
MARKETS = {
    "ML": "moneyline", "MONEYLINE": "moneyline", "H2H": "moneyline", "SPREAD": "spread", "SPREADS": "spread", "TOTAL": "total", "TOTALS": "total", "OU": "total", "OVER_UNDER": "total",
}
POSITIONS = {
    "QB": "qb", "RB": "offense_skill", "FB": "offense_skill", "WR": "offense_skill", "TE": "offense_skill", "OL": "offensive_line", "OT": "offensive_line", "OG": "offensive_line", "C": "offensive_line",
    "DL": "defense", "DE": "defense", "DT": "defense", "EDGE": "defense", "LB": "defense", "DB": "defense", "CB": "defense", "S": "defense",
}
#: Types of plays.
PASSES = ["Pass Reception", "Pass Incompletion", "Passing Touchdown", "Sack", "Pass Interception Return", "Interception", "Interception Return Touchdown", "Two Point Pass"]
RUSHES = ["Rush", "Rushing Touchdown", "Two Point Rush"]
HAVOC = ["Sack", "Pass Interception Return", "Interception", "Interception Return Touchdown", "Fumble Recovery (Opponent)", "Fumble Return Touchdown"]
#: Upper bounds (inclusive) of the odds bands.
ODDS_BANDS = [(-221, "lte_-221"), (-151, "-220_to_-151"), (-121, "-150_to_-121"), (120, "-120_to_+120"), (150, "+121_to_+150"), (220, "+151_to_+220"), (300, "+221_to_+300"), (500, "+301_to_+500")]


def _lookup(table: dict[str, str], c: Column) -> Column:
    return F.create_map(*map(F.lit, chain(*table.items())))[c]


def normalize_book(key: Column, title: Column) -> Column:
    """Canonical key of a book: known alias, else a slug of its key or title."""
    name = F.lower(F.trim(F.coalesce(F.nullif(key, F.lit("")), F.nullif(title, F.lit("")), F.lit("unknown"))))
    slug = F.trim(F.regexp_replace(name, "[^a-z0-9]+", "_"), F.lit("_"))
    return F.coalesce(_lookup(BOOKS, name), F.nullif(slug, F.lit("")), F.lit("unknown"))


def normalize_league(x: Column) -> Column:
    name = F.upper(F.trim(F.coalesce(x, F.lit(""))))
    return F.coalesce(_lookup(LEAGUES, name), name)


def normalize_market(x: Column) -> Column:
    """Canonical market type, null if unsupported."""
    return _lookup(MARKETS, F.upper(F.trim(x)))


def normalize_markets(xs: Column) -> Column:
    """Supported canonical markets of a list, each once, in order."""
    return F.array_distinct(F.array_compact(F.transform(xs, normalize_market)))


def selection_side(market: Column, selection: Column, home: Column, away: Column) -> Column:
    s = F.lower(F.trim(selection))
    party = F.when(s == F.lower(F.trim(home)), "home").when(s == F.lower(F.trim(away)), "away").when((market == "moneyline") & s.isin("draw", "tie"), "draw")
    return F.when(market == "total", F.when(s.isin("over", "under"), s)).otherwise(party)


def exact_point(x: Column) -> Column:
    return x.try_cast("decimal(10,3)")


def point_key(point: Column) -> Column:
    return F.coalesce(point.cast("decimal(10,3)").cast("string"), F.lit("none"))


def canonical_line_key(market: Column, side: Column, point: Column) -> Column:
    """One key for both sides of a line: away spreads change sign; a moneyline has none."""
    return F.when(market == "moneyline", "none").otherwise(point_key(F.when((market == "spread") & (side == "away"), -point).otherwise(point)))


def normalize_name(x: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(x), "[^a-z0-9]+", " "))


def names_compatible(a: Column, b: Column) -> Column:
    """Equal, or one begins with all the words of the other."""
    return (a == b) | F.startswith(a, F.concat(b, F.lit(" "))) | F.startswith(b, F.concat(a, F.lit(" ")))


def parse_utc(x: Column) -> Column:
    """Timestamp of ISO text that names its zone, else null."""
    return F.when(x.rlike(r"(?:Z|[+-]\d{2}:?\d{2})$"), F.try_to_timestamp(x))


def event_date_utc(ts: Column) -> Column:
    """UTC date of epoch seconds, by arithmetic, so that no session's zone matters."""
    return F.date_add(F.lit("1970-01-01").cast("date"), F.floor(ts / 86400).cast("int"))


def slate_day(ts: Column, zone: str = "America/New_York") -> Column:
    return F.to_date(F.from_utc_timestamp(ts, zone))


def prediction_as_of(kickoff: Column, horizon: Column, first_kickoff: Column, zone: str = "America/New_York") -> Column:
    """Epoch seconds a horizon looks from: a day before, an hour before, three hours before the slate's first kickoff, or nine in the local morning of the kickoff."""
    k, f = kickoff.cast("long"), first_kickoff.cast("long")
    day = F.date_trunc("day", F.from_utc_timestamp(F.timestamp_seconds(k), zone))
    morning = F.to_utc_timestamp(day + F.make_interval(hours=F.lit(9)), zone)
    return F.when(horizon == "24h", k - 86400).when(horizon == "60m", k - 3600).when(horizon == "slate", f - 10800).when(horizon == "morning", F.unix_seconds(morning))


def available_at(kickoff: Column) -> Column:
    return kickoff.cast("long") + 86400


def is_available(effective: Column, available: Column, as_of: Column) -> Column:
    return (effective <= as_of) & (available <= as_of)


def age_seconds(later: Column, earlier: Column) -> Column:
    """Whole seconds between two clocks (timestamps or epoch seconds), not below 0."""
    return F.greatest(F.lit(0), later.cast("long") - earlier.cast("long"))


def timing_class(as_of: Column, first_kickoff: Column, window: int = 900) -> Column:
    """Place of a decision against three hours before the first kickoff."""
    delta = as_of.cast("long") - (first_kickoff.cast("long") - 10800)
    return F.when(delta < 0, "EARLY_LOOKAHEAD").when(delta <= window, "OFFICIAL_PRIMARY_HORIZON").when(delta.isNotNull(), "POST_HORIZON")


def season_phase(season_type: Column, week: Column) -> Column:
    w = F.coalesce(week, F.lit(0))
    return F.when(F.lower(season_type) != "regular", "postseason").when(w <= 4, "early_regular").when(w <= 9, "middle_regular").otherwise("late_regular")


def kickoff_window(hour: Column) -> Column:
    return F.when(hour < 15, "early").when(hour < 19, "middle").otherwise("late")


def stratum(season: Column, season_type: Column, week: Column, hour: Column) -> Column:
    """season|phase|window; null if any is."""
    return F.concat(season.cast("string"), F.lit("|"), season_phase(season_type, week), F.lit("|"), F.when(hour.isNotNull(), kickoff_window(hour)))


def odds_band(odds: Column) -> Column:
    out = F.when(odds.isNull(), None)
    for top, name in ODDS_BANDS:
        out = out.when(odds <= top, name)
    return out.otherwise("gt_+500")


def edge_bucket(x: Column) -> Column:
    return F.when(x.isNull(), "unknown").when(x < 0.01, "lt_1pct").when(x < 0.025, "1_to_2_5pct").when(x < 0.05, "2_5_to_5pct").otherwise("gte_5pct")


def price_bucket(odds: Column) -> Column:
    return F.when(odds.isNull(), "unknown").when(odds <= -150, "heavy_favorite").when(odds < 100, "favorite").when(odds < 200, "plus_100_to_199").otherwise("plus_200_or_more")


def uncertainty_label(dispersion: Column, threshold: float) -> Column:
    return F.when(dispersion <= threshold / 2, "low").when(dispersion <= threshold, "moderate").when(dispersion.isNotNull(), "high")


def quality_group(week: Column, home: Column, away: Column) -> Column:
    zero = lambda c: F.coalesce(c, F.lit(0))
    return F.concat(F.when(zero(week) <= 3, "early").otherwise("later"), F.when((zero(home) >= 0.8) & (zero(away) >= 0.8), "|high").otherwise("|low"))


def fold_role(season: Column) -> Column:
    return F.when(season <= 2018, "warmup").when(season <= 2023, "development").when(season == 2024, "validation").when(season == 2025, "locked_test").otherwise("prospective_shadow")


def play_success(down: Column, distance: Column, yards: Column) -> Column:
    """Whether a play gained half, seven tenths or all of the distance on first, second or later down."""
    d, n = down.try_cast("int"), distance.try_cast("int")
    need = F.ceil(n * F.when(d == 1, 0.5).when(d == 2, 0.7).otherwise(1.0))
    return F.when(d.isNull() | n.isNull(), False).when(n <= 0, yards >= 0).otherwise(yards >= need)


def play_flags(kind: Column, yards: Column) -> dict[str, Column]:
    """pass, rush, explosive and havoc of a play by its type; all false for other and missing types."""
    is_pass, is_rush = (F.coalesce(kind.isin(names), F.lit(False)) for names in (PASSES, RUSHES))
    gain = F.coalesce(yards, F.lit(0))
    return {
        "pass": is_pass, "rush": is_rush, "explosive": (is_pass & (gain >= 20)) | (is_rush & (gain >= 10)), "havoc": F.coalesce(kind.isin(HAVOC), F.lit(False)),
    }


def game_eligibility(g: dict[str, Column]) -> Column:
    """First reason why a game is left out, null if none. g: id, home_class, away_class, home_id, away_id, status, completed, home_points, away_points, review."""
    status = F.lower(F.coalesce(g["status"], F.lit("")))
    done = F.coalesce(g["completed"], status.isin("completed", "final"))
    fbs = lambda c: F.lower(F.coalesce(c, F.lit(""))) == "fbs"
    return (
        F.when(g["id"].isNull(), "missing_provider_game_id")
        .when(~fbs(g["home_class"]) | ~fbs(g["away_class"]), "not_fbs_vs_fbs")
        .when(g["home_id"].isNull() | g["away_id"].isNull(), "unresolved_program_identity")
        .when(~done, F.when(status.contains("cancel"), "cancelled").when(status.contains("postpon"), "postponed").otherwise("not_final"))
        .when(g["home_points"].isNull() | g["away_points"].isNull(), "missing_final_score")
        .when(F.coalesce(g["review"], F.lit(False)), "manual_result_review")
    )


def finite(x: Column) -> Column:
    x = x.try_cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)


def ratio(n: Column, d: Column) -> Column:
    return F.try_divide(n, d)


def stable_key(*names: str) -> Column:
    """SHA-256 of the canonical JSON of the named columns."""
    return F.sha2(F.to_json(F.struct(*sorted(names))), 256)


def position_group(p: Column) -> Column:
    return F.coalesce(_lookup(POSITIONS, F.upper(F.trim(p))), F.lit("other"))
