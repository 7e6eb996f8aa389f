"""Views on the star-schema tables in the shapes that the operators take.

Each view is one SQL text that Spark and DuckDB both run; only the seconds of a time column are written differently.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Cutoff of the as-of queries: 2000-01-01, in epoch seconds.
AS_OF = 946684800

VIEWS = {
    "quotes": """
        SELECT event_id, book_id, market, snapshot_id, requested, observed, ingested, side, start, league, status, book_active, matched, line_no, quantity,
               CASE WHEN market = 0 THEN NULL WHEN market = 1 THEN (CASE WHEN side = 1 THEN spread ELSE -spread END) ELSE total_line END + CASE WHEN side = 2 AND event_id % 23 = 5 THEN 0.5e0 ELSE 0e0 END AS point,
               CASE WHEN q >= 0.5e0 THEN -CAST(floor(100 * q / (1 - q) + 0.5e0) AS BIGINT) ELSE CAST(floor(100 * (1 - q) / q + 0.5e0) AS BIGINT) END AS odds
        FROM (SELECT *, (CASE WHEN side = 1 THEN p1 ELSE 1 - p1 END) * (1.02e0 + 0.3e0 * tax) AS q
        FROM (SELECT l_partkey AS event_id, CAST(l_suppkey % 6 AS BIGINT) AS book_id, CAST(l_linenumber % 3 AS BIGINT) AS market, l_orderkey AS snapshot_id,
               {l_shipdate_s} AS requested, {l_shipdate_s} - CAST(l_quantity AS BIGINT) * 60 AS observed, {l_shipdate_s} + 30 AS ingested, CAST(s AS BIGINT) AS side,
               CAST(1009843200 + (l_partkey % 30) * 86400 AS BIGINT) AS start, CAST(l_partkey % 3 AS BIGINT) AS league, l_tax AS tax, l_linenumber AS line_no, l_quantity AS quantity,
               CASE WHEN l_linestatus = 'F' AND l_returnflag = 'R' AND l_partkey % 11 = 0 THEN 'suspended' ELSE 'active' END AS status, l_suppkey % 13 <> 0 AS book_active, l_partkey % 17 <> 0 AS matched,
               CAST((l_partkey % 15) - 7 AS DOUBLE) + 0.5e0 * (l_suppkey % 2) AS spread, CAST(40 + (l_partkey % 25) AS DOUBLE) + 0.5e0 * (l_suppkey % 2) AS total_line,
               CASE WHEN l_linenumber % 3 = 0 THEN 0.3e0 + 0.4e0 * (l_partkey % 97) / 96e0 + (l_discount - 0.05e0) * 0.4e0 ELSE 0.5e0 + (l_discount - 0.05e0) * 0.5e0 END AS p1
        FROM {lineitem} CROSS JOIN (SELECT 1 AS s UNION ALL SELECT 2 AS s) AS sides) AS a) AS b""",
    "games": """
        SELECT game_id, season, week, kickoff, home, away, margin, total, neutral, kickoff + 86400 AS available_at, pool, price FROM (
        SELECT o_orderkey AS game_id, CAST(extract(YEAR FROM o_orderdate) AS BIGINT) AS season, CAST(floor((extract(DOY FROM o_orderdate) - 1) / 7e0) AS BIGINT) AS week, {o_orderdate_s} AS kickoff,
               CAST(o_custkey % 130 AS BIGINT) AS home, CAST((o_custkey * 7 + o_orderkey) % 130 AS BIGINT) AS away, CAST(floor(o_totalprice) AS BIGINT) % 57 - 28 AS margin,
               35 + CAST(floor(o_totalprice / 100) AS BIGINT) % 45 AS total, o_orderpriority LIKE '5%' AS neutral, CAST(o_custkey % 3 AS BIGINT) AS pool, o_totalprice AS price FROM {orders}) AS g
        WHERE home <> away""",
    "plays": """
        SELECT g.game_id, g.season, CASE WHEN l_linestatus = 'O' THEN g.home ELSE g.away END AS offense, CASE WHEN l_returnflag = 'A' THEN 'pass' WHEN l_returnflag = 'N' THEN 'rush' ELSE 'other' END AS kind,
               l_discount * 10 - 0.5e0 AS ppa, CAST(l_quantity AS BIGINT) - 10 AS yards, CAST(l_linenumber % 4 + 1 AS BIGINT) AS down, CAST(l_suppkey % 12 AS BIGINT) AS distance, l_tax AS tax,
               CASE WHEN l_returnflag = 'A' THEN (CASE l_suppkey % 4 WHEN 0 THEN 'Sack' WHEN 1 THEN 'Pass Reception' WHEN 2 THEN 'Pass Incompletion' ELSE 'Interception' END)
                    WHEN l_returnflag = 'N' THEN (CASE l_suppkey % 2 WHEN 0 THEN 'Rush' ELSE 'Rushing Touchdown' END)
                    ELSE (CASE l_suppkey % 2 WHEN 0 THEN 'Punt' ELSE 'Fumble Recovery (Opponent)' END) END AS type, l_tax > 0.03e0 AS wallclock
        FROM {lineitem} JOIN {games} AS g ON l_orderkey = g.game_id""",
    "drives": "SELECT game_id, offense, CAST(7 * sum(CASE WHEN tax > 0.06e0 THEN 1 ELSE 0 END) AS BIGINT) AS points, CAST(sum(yards) AS BIGINT) AS yards FROM {plays} AS p GROUP BY game_id, offense",
    "predictions": """
        SELECT game_id, season, week, CAST(margin AS DOUBLE) AS actual, 0.3e0 * margin AS a, 0.35e0 * margin + ((game_id % 7) - 3) AS b, CASE WHEN game_id % 2 = 0 THEN 'even' ELSE 'odd' END AS regime, neutral
        FROM {games} AS g""",
    "probabilities": "SELECT game_id, season, week, (CAST(floor(price) AS BIGINT) % 97) / 96e0 AS p, CAST(CASE WHEN margin > 0 THEN 1 ELSE 0 END AS BIGINT) AS outcome FROM {games} AS g",
    "bets": """
        SELECT *, CASE WHEN state = 'won' THEN CAST(floor(stake * (CASE WHEN odds > 0 THEN odds / 100e0 ELSE 100e0 / -odds END) + 0.5e0) AS BIGINT) WHEN state = 'lost' THEN -stake ELSE 0 END AS profit FROM (
        SELECT CAST(o_custkey % 50 AS BIGINT) AS portfolio, o_orderkey AS bet_id, o_orderkey AS event_id, CAST(o_orderkey % 3 AS BIGINT) AS market, CAST(o_orderkey % 2 + 1 AS BIGINT) AS side, CAST(o_custkey % 3 AS BIGINT) AS league,
               CAST(floor(o_totalprice / 10) AS BIGINT) AS stake, CASE WHEN o_orderstatus = 'F' THEN 'won' WHEN o_orderstatus = 'O' THEN 'lost' WHEN o_orderkey % 2 = 0 THEN 'open' ELSE 'push' END AS state,
               CASE WHEN o_orderkey % 4 < 2 THEN 100 + o_orderkey % 300 ELSE -100 - o_orderkey % 250 END AS odds, {o_orderdate_s} AS settled_at, (o_custkey % 60) / 1000e0 AS edge,
               CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE 0.35e0 + (o_custkey % 31) / 100e0 END AS closing_p,
               CAST(o_custkey % 6 AS BIGINT) AS book_id, CASE o_orderkey % 7 WHEN 0 THEN 'strong' WHEN 1 THEN 'lean' WHEN 2 THEN 'pass' END AS classification,
               CASE WHEN o_orderkey % 6 = 0 THEN 'parlay' ELSE 'straight' END AS kind, CASE o_custkey % 3 WHEN 0 THEN 'v1' WHEN 1 THEN 'v2' END AS model_version,
               CASE o_custkey % 4 WHEN 0 THEN 'low' WHEN 1 THEN 'medium' WHEN 2 THEN 'high' END AS confidence FROM {orders}) AS b""",
    "ledger": """
        SELECT portfolio, 'deposit' AS kind, CAST(1000000000 AS BIGINT) AS amount FROM {bets} AS b GROUP BY portfolio UNION ALL
        SELECT portfolio, 'stake' AS kind, -stake AS amount FROM {bets} AS b UNION ALL SELECT portfolio, 'settle' AS kind, stake + profit AS amount FROM {bets} AS b WHERE state <> 'open'""",
    "roster": """
        SELECT CAST(c_custkey % 130 AS BIGINT) AS team, c_custkey AS player, CAST(season AS BIGINT) AS season, substr(c_mktsegment, 1, 1) AS position
        FROM {customer} CROSS JOIN (SELECT 1995 AS season UNION ALL SELECT 1996 UNION ALL SELECT 1997 UNION ALL SELECT 1998 UNION ALL SELECT 1999) AS y WHERE (c_custkey + season) % 3 <> 0""",
    "coaches": """
        SELECT CAST(c_custkey AS BIGINT) AS team, CAST(season AS BIGINT) AS season, CAST((c_custkey + CAST(floor((season - 1995) / 3e0) AS BIGINT) * (c_custkey % 4)) % 9 AS BIGINT) AS coach
        FROM {customer} CROSS JOIN (SELECT 1995 AS season UNION ALL SELECT 1996 UNION ALL SELECT 1997 UNION ALL SELECT 1998 UNION ALL SELECT 1999 UNION ALL SELECT 2000) AS y WHERE (c_custkey + season) % 7 <> 0""",
    "squad": "SELECT team, player, season, CASE (player + CASE WHEN player % 7 = 0 THEN season ELSE 0 END) % 6 WHEN 0 THEN 'QB' WHEN 1 THEN 'WR' WHEN 2 THEN 'OT' WHEN 3 THEN 'LB' WHEN 4 THEN 'K' END AS position FROM {roster} AS r",
    "portal": """
        SELECT c_custkey AS player, CAST(1995 + c_custkey % 5 AS BIGINT) AS season, CAST(788918400 + (c_custkey % 5) * 31557600 + (c_nationkey - 12) * 86400 AS BIGINT) AS moved_at, CAST(c_custkey % 130 AS BIGINT) AS origin,
               CAST((c_custkey * 7 + 3) % 130 AS BIGINT) AS destination, CASE c_custkey % 6 WHEN 0 THEN 'QB' WHEN 1 THEN 'WR' WHEN 2 THEN 'OT' WHEN 3 THEN 'LB' WHEN 4 THEN 'K' END AS position, CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE CAST(c_acctbal AS DOUBLE) / 1000 END AS rating FROM {customer}""",
    "passing": """
        SELECT CAST(o_custkey % 130 AS BIGINT) AS team, CAST(extract(YEAR FROM o_orderdate) AS BIGINT) AS season, o_custkey AS player, stat_type, CAST(sum(CASE WHEN stat_type = 'ATT' THEN 1 ELSE floor(o_totalprice / 1000) END) AS DOUBLE) AS stat
        FROM {orders} CROSS JOIN (SELECT 'ATT' AS stat_type UNION ALL SELECT 'YDS') AS k GROUP BY o_custkey, extract(YEAR FROM o_orderdate), stat_type""",
    "team_context": """
        SELECT CAST(c_custkey % 130 AS BIGINT) AS team, CAST(1995 + c_nationkey % 5 AS BIGINT) AS season, max(CAST(c_acctbal AS DOUBLE)) / 10000 AS percent_ppa, min(CAST(c_acctbal AS DOUBLE)) / 10000 AS usage, count(*) AS rank, max(CAST(c_acctbal AS DOUBLE)) AS points,
               min(CAST(c_acctbal AS DOUBLE)) AS talent FROM {customer} GROUP BY c_custkey % 130, c_nationkey % 5""",
}
#: Views and tables that each view reads.
NEEDS = {"quotes": ["lineitem"], "games": ["orders"], "plays": ["lineitem", "games"], "drives": ["plays"], "predictions": ["games"], "probabilities": ["games"], "bets": ["orders"], "ledger": ["bets"], "roster": ["customer"], "coaches": ["customer"], "squad": ["roster"], "portal": ["customer"], "passing": ["orders"], "team_context": ["customer"]}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A view, or a table of its own name, over the Parquet tables of a folder."""
    if name not in VIEWS:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    seconds = {f"{c}_s": f"unix_seconds(CAST({c} AS TIMESTAMP))" for c in ("l_shipdate", "o_orderdate")}
    text = VIEWS[name]
    for k, v in seconds.items():
        text = text.replace("{" + k + "}", v)
    return spark.sql(text, **{n: view(spark, sf_dir, n) for n in NEEDS[name]})


def ctes(*names: str) -> str:
    """`WITH` clause of the views and of what they read, for DuckDB."""
    seen: dict[str, str] = {}

    def add(name: str) -> None:
        for n in NEEDS.get(name, []):
            if n in VIEWS and n not in seen:
                add(n)
        tables = {n: n for n in NEEDS[name]}
        seen[name] = VIEWS[name].format(l_shipdate_s="CAST(epoch(l_shipdate) AS BIGINT)", o_orderdate_s="CAST(epoch(o_orderdate) AS BIGINT)", **tables)

    for n in names:
        if n not in seen:
            add(n)
    return "WITH " + ", ".join(f"{k} AS ({v})" for k, v in seen.items())
