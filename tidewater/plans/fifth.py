"""Queries of the seven preseason families and of schedule-adjusted form. Importing this module registers them."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewater.operators import preseason, schedule
from tidewater.plans.queries import METRICS, d6, doubles, metrics, query, requests, rounded

GROUPS = preseason.GROUPS
GROUP_SQL = "CASE position WHEN 'QB' THEN 'qb' WHEN 'WR' THEN 'offense_skill' WHEN 'OT' THEN 'offensive_line' WHEN 'LB' THEN 'defense' ELSE 'other' END"

SHARES = ["roster_continuity", *(f"{g}_continuity" for g in GROUPS)]
ROSTER = f"""sq AS (SELECT team, player, season, {GROUP_SQL} AS g FROM squad), ro AS (SELECT team, season, count(*) AS roster_count FROM sq GROUP BY ALL),
    pj AS (SELECT p.team, p.season + 1 AS season, p.g, c.g AS cg FROM sq p LEFT JOIN sq c ON c.team = p.team AND c.player = p.player AND c.season = p.season + 1),
    pp AS (SELECT team, season, count(*) AS pn, count(cg) AS rn, count(cg) / count(*) AS roster_continuity, """ + ", ".join(f"count(*) FILTER (g = '{g}' AND cg = '{g}') / nullif(count(*) FILTER (g = '{g}'), 0) AS {g}_continuity" for g in GROUPS) + """ FROM pj GROUP BY ALL),
    rf AS (SELECT ro.team, ro.season, roster_count, coalesce(pn, 0) AS prior_roster_count, coalesce(rn, 0) AS roster_returning_count, """ + ", ".join(SHARES) + " FROM ro LEFT JOIN pp ON pp.team = ro.team AND pp.season = ro.season)"  # fmt: skip

WAYS = [(w, s) for w, s in (("out", "origin"), ("in", "destination"))]
COUNTS = [f"transfer_{w}_{x}" for w, _ in WAYS for x in ("count", "rated_count", *(f"{g}_count" for g in GROUPS))]
PORTAL = f"""fk AS (SELECT season, min(kickoff) AS first_kickoff FROM games GROUP BY season), mv AS (SELECT p.*, {GROUP_SQL} AS g FROM portal p JOIN fk ON fk.season = p.season AND p.moved_at <= fk.first_kickoff),
    wy AS (SELECT origin AS team, season, 'out' AS way, rating, g FROM mv UNION ALL SELECT destination, season, 'in', rating, g FROM mv),
    po AS (SELECT team, season, """ + ", ".join(
    f"count(*) FILTER (way = '{w}') AS transfer_{w}_count, count(rating) FILTER (way = '{w}') AS transfer_{w}_rated_count, coalesce(sum(rating) FILTER (way = '{w}'), 0) AS transfer_{w}_rating_sum, "
    + ", ".join(f"count(*) FILTER (way = '{w}' AND g = '{g}') AS transfer_{w}_{g}_count" for g in GROUPS) for w, _ in WAYS
) + " FROM wy GROUP BY team, season)"

LEADER = """ps AS (SELECT team, season, player, coalesce(max(stat) FILTER (stat_type = 'ATT'), 0) AS att, coalesce(max(stat) FILTER (stat_type = 'YDS'), 0) AS yds FROM passing GROUP BY ALL),
    pk AS (SELECT *, row_number() OVER (PARTITION BY team, season ORDER BY att DESC, yds DESC, player) AS k, sum(att) OVER (PARTITION BY team, season) AS ta, sum(yds) OVER (PARTITION BY team, season) AS ty FROM ps),
    ld AS (SELECT team, season + 1 AS season, player AS leader, att AS leader_attempts, att / nullif(ta, 0) AS leader_attempt_share, yds / nullif(ty, 0) AS leader_yard_share FROM pk WHERE k = 1),
    lf AS (SELECT ld.*, EXISTS (SELECT 1 FROM squad s WHERE s.team = ld.team AND s.season = ld.season AND s.player = ld.leader) AS leader_returns FROM ld WHERE EXISTS (SELECT 1 FROM squad s WHERE s.team = ld.team AND s.season = ld.season))"""


def starts(v):
    return v("games").groupBy("season").agg(F.min("kickoff").alias("first_kickoff"))


@query("g2_roster_continuity", f", {ROSTER} SELECT team, season, roster_count, prior_roster_count, roster_returning_count, {', '.join(f'{d6(s)} AS {s}' for s in SHARES)} FROM rf", ("squad",))
def _(v):
    return rounded(preseason.roster_continuity(v("squad")), *SHARES)


@query("g3_portal_counts", f", {PORTAL} SELECT team, season, {', '.join(COUNTS)}, {d6('transfer_in_rating_sum')} AS transfer_in_rating_sum, {d6('transfer_out_rating_sum')} AS transfer_out_rating_sum FROM po", ("games", "portal"))
def _(v):
    return rounded(preseason.transfer_counts(v("portal"), starts(v)), "transfer_in_rating_sum", "transfer_out_rating_sum")


@query("g4_passing_leader", f", {LEADER} SELECT team, season, leader, leader_attempts, {d6('leader_attempt_share')} AS leader_attempt_share, {d6('leader_yard_share')} AS leader_yard_share, leader_returns FROM lf", ("squad", "passing"))
def _(v):
    return rounded(preseason.leader_share(v("passing"), v("squad")), "leader_attempt_share", "leader_yard_share")


SHOWN = ["percent_ppa", "rank", "talent", "roster_count", "qb_continuity", "leader_attempts", "transfer_in_count", "transfer_out_count", "coach_tenure"]


@query("g2_seven_families", f""", {ROSTER}, {PORTAL}, {LEADER}, i AS (SELECT *, season - row_number() OVER (PARTITION BY team, coach ORDER BY season) AS isl FROM coaches), ch AS (SELECT team, season, row_number() OVER (PARTITION BY team, coach, isl ORDER BY season) AS coach_tenure FROM i),
    re AS (SELECT team, season, percent_ppa FROM team_context WHERE team % 5 <> 0), rc AS (SELECT team, season, rank FROM team_context WHERE team % 7 <> 0), ta AS (SELECT team, season, talent FROM team_context WHERE season > 1996),
    al AS (SELECT team, season, percent_ppa, rank, talent, roster_count, qb_continuity, leader_attempts, transfer_in_count, transfer_out_count, coach_tenure, (percent_ppa IS NULL)::INT + (rank IS NULL)::INT + (talent IS NULL)::INT + (roster_count IS NULL)::INT + (leader_attempts IS NULL)::INT + (transfer_in_count IS NULL)::INT + (coach_tenure IS NULL)::INT AS missing_families
        FROM re FULL JOIN rc USING (team, season) FULL JOIN ta USING (team, season) FULL JOIN rf USING (team, season) FULL JOIN lf USING (team, season) FULL JOIN po USING (team, season) FULL JOIN ch USING (team, season))
    SELECT team, season, {', '.join(f'{d6(c)} AS {c}' for c in SHOWN)}, missing_families FROM al""", ("squad", "passing", "games", "portal", "coaches", "team_context"))  # fmt: skip
def _(v):
    c = v("team_context")
    got = preseason.preseason_families(
        c.where("team % 5 <> 0").select("team", "season", "percent_ppa", "usage"), c.where("team % 7 <> 0").select("team", "season", "rank", "points"), c.where("season > 1996").select("team", "season", "talent"),
        v("squad"), v("passing"), v("portal"), v("coaches"), starts(v),
    )
    return rounded(doubles(got.select("team", "season", *SHOWN, "missing_families"), *SHOWN), *SHOWN)


def adjusted_sql(value: str, against: str) -> str:
    return f"""{METRICS}, rq AS (SELECT game_id, team, season, available_at - 172800 AS as_of FROM sd),
    l5 AS (SELECT * FROM (SELECT rq.game_id, rq.team, rq.as_of, f.opponent, f.{value} AS v, row_number() OVER (PARTITION BY rq.game_id, rq.team ORDER BY f.available_at DESC, f.game_id DESC) AS newest FROM rq JOIN tm f ON f.team = rq.team AND f.season = rq.season AND f.available_at <= rq.as_of AND f.game_id <> rq.game_id AND f.{value} IS NOT NULL) AS h WHERE newest <= 5),
    os AS (SELECT l5.game_id, l5.team, l5.newest, avg(o.{against}) AS m FROM l5 JOIN tm o ON o.team = l5.opponent AND o.available_at <= l5.as_of GROUP BY ALL), ow AS (SELECT game_id, team, avg(v) AS own FROM l5 GROUP BY ALL), st AS (SELECT game_id, team, avg(m) AS strength FROM os GROUP BY ALL),
    pm AS (SELECT as_of, avg({against}) AS pop FROM (SELECT DISTINCT as_of FROM rq) AS c JOIN tm ON available_at <= as_of GROUP BY as_of)
    SELECT rq.game_id, rq.team, {d6('own - strength + pop')} AS adjusted FROM rq LEFT JOIN ow ON ow.game_id = rq.game_id AND ow.team = rq.team LEFT JOIN st ON st.game_id = rq.game_id AND st.team = rq.team LEFT JOIN pm ON pm.as_of = rq.as_of"""


def adjusted(v, value, against):
    return rounded(schedule.schedule_adjusted(requests(v), metrics(v), value, against).select("game_id", "team", "adjusted"), "adjusted")


@query("w5_adjusted_offense", f", {adjusted_sql('ppa', 'ppa_allowed')}", ("plays", "drives"))
def _(v):
    return adjusted(v, "ppa", "ppa_allowed")


@query("w5_adjusted_defense", f", {adjusted_sql('ppa_allowed', 'ppa')}", ("plays", "drives"))
def _(v):
    return adjusted(v, "ppa_allowed", "ppa")
