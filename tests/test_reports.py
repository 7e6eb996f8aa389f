"""Coverage and corpus reports against plain code; version chains; sketches within their error."""

import math
import random
from collections import Counter

import pytest

from tidewater.operators import reports


def rows_of(df):
    return {(r.section, r.key, r.measure): r.value for r in df.collect()}


def test_chains(spark, tmp_path):
    """A chain of ten, one alone, one that branches, one whose first version is missing, a cycle, a version of itself, repeated rows."""
    links = [(i, i - 1 if i > 1 else None) for i in range(1, 11)] + [(20, None), (21, 20), (22, 20), (23, 22), (31, 30), (32, 31), (40, 41), (41, 42), (42, 40), (43, 40), (50, 50), (10, 9), (60, None)]
    got = {r.id: (r.root, r.depth, r.state) for r in reports.resolve_chains(spark.createDataFrame(links, "id long, supersedes long"), str(tmp_path)).collect()}
    want = {i: (1, i - 1, "ok") for i in range(1, 11)} | {20: (20, 0, "ok"), 21: (20, 1, "ok"), 22: (20, 1, "ok"), 23: (20, 2, "ok"), 60: (60, 0, "ok"), 31: (30, 1, "dangling"), 32: (30, 2, "dangling")}
    assert got == want | {i: (None, None, "cyclic") for i in (40, 41, 42, 43, 50)}


@pytest.mark.parametrize("n", [1, 2, 33, 100])
def test_long_chains(spark, tmp_path, n):
    ids = list(range(n))
    random.Random(n).shuffle(ids)
    links = [(f"v{ids[i]}", f"v{ids[i - 1]}" if i else None) for i in range(n)]
    got = {r.id: (r.root, r.depth) for r in reports.resolve_chains(spark.createDataFrame(links, "id string, supersedes string"), str(tmp_path)).collect()}
    assert got == {f"v{ids[i]}": (f"v{ids[0]}", i) for i in range(n)}


def test_chains_of_nothing(spark, tmp_path):
    assert reports.resolve_chains(spark.createDataFrame([], "id long, supersedes long"), str(tmp_path)).count() == 0


def test_corpus(spark, tmp_path):
    games = [(1, 2020, "fbs", "fbs", 1, 2, None), (2, 2020, "fbs", "fcs", 1, None, "unresolved_program_identity"), (3, 2021, "fcs", "fcs", None, None, "no_top_side"), (4, 2021, None, "fbs", 3, 4, None)]
    manifests = [("a", "r1", 100, 10, None), ("b", "r1", 110, 11, "a"), ("c", "r2", 50, 5, None), ("d", "r1", 120, 12, "b"), ("e", "r3", None, 1, "gone")]
    artifacts = [("plays", 10, [1, 2]), ("plays", 0, []), ("plays", 5, [3]), ("drives", 3, [4]), ("notes", 0, [])]
    got = rows_of(
        reports.corpus_report(
            spark.createDataFrame(games, "game_id long, season int, home_class string, away_class string, home_id long, away_id long, exclusion string"),
            spark.createDataFrame(manifests, "manifest_id string, request_hash string, response_bytes long, stored_bytes long, supersedes string"),
            spark.createDataFrame(artifacts, "kind string, row_count long, game_ids array<long>"),
            str(tmp_path),
        )
    )
    one = lambda s, k, **m: {(s, k, n): float(v) for n, v in m.items()}
    want = one("games_by_season", "2020", games=2, both_top=1, top_and_other=1) | one("games_by_season", "2021", games=2, both_top=0, top_and_other=1)
    want |= one("exclusions", "eligible", games=2) | one("exclusions", "unresolved_program_identity", games=1) | one("exclusions", "no_top_side", games=1)
    want |= one("artifacts", "plays", partitions_with_rows=2, rows=15) | one("artifacts", "drives", partitions_with_rows=1, rows=3) | one("artifacts", "notes", partitions_with_rows=0, rows=0)
    want |= one("coverage", "plays", games=2, total_games=3, percentage=66.67) | one("coverage", "drives", games=1, total_games=3, percentage=33.33) | one("coverage", "notes", games=0, total_games=3, percentage=0)
    want |= one("identity_gaps", "all", missing_home=1, missing_away=2, missing_identities=2, missing_participants=1, ambiguous=1)
    want |= one("calls", "all", recorded=5, unique_requests=3, reuses=2, response_bytes=380, stored_bytes=39, supersessions=3)
    want |= one("chains", "all", chains=3, longest=3, of_several_versions=2, dangling=1) | one("versions", "ok", n=4) | one("versions", "dangling", n=1)
    assert got == want


def made():
    rnd, groups, quotes = random.Random(9), [], []
    for e in range(900):
        for h in (0, 1):
            mapping = rnd.choice(("reliable", "reliable", "ambiguous", "missing"))
            at = 1_000_000 + 60 * rnd.randrange(5000)
            for m in ("spread", "total"):
                complete = rnd.randrange(5)
                groups.append((2020 + e % 3, h, m, e, complete >= 2, complete, mapping, at, None if mapping == "missing" else at - int(rnd.expovariate(1 / 300)), "" if complete >= 2 else "too_few_books|incomplete" if complete else "no_book"))
                quotes += [(h, m, int(rnd.paretovariate(1.2))) for _ in range(complete)]
    return groups, quotes


GROUP, QUOTE = "season int, horizon int, market string, event_id long, usable boolean, complete int, mapping string, requested_at long, snapshot_at long, why string", "horizon int, market string, book_id long"


def test_coverage_and_its_sketches(spark):
    groups, quotes = made()
    g, q = spark.createDataFrame(groups, GROUP), spark.createDataFrame(quotes, QUOTE)
    got = rows_of(reports.historical_coverage(g, q))
    own = [x for x in groups if x[:3] == (2021, 1, "total")]
    assert got["coverage", "2021|1|total", "games"] == len(own) and got["coverage", "2021|1|total", "coverage_pct"] == pytest.approx(100 * sum(x[4] for x in own) / len(own), abs=1e-6)
    assert got["coverage", "2021|1|total", "three_books_pct"] == pytest.approx(100 * sum(x[5] >= 3 for x in own) / len(own), abs=1e-6)
    assert got["aggregate_coverage", "0|spread", "missing_mappings"] == sum(x[1] == 0 and x[2] == "spread" and x[6] == "missing" for x in groups)
    assert got["games_by_season", "2020", "games"] == len({x[3] for x in groups if x[0] == 2020}) and got["games_by_season", "2020", "reliably_mapped"] == len({x[3] for x in groups if x[0] == 2020 and x[6] == "reliable"})
    assert got["event_horizon_reconciliation", "ambiguous", "n"] == len({x[3:4] + x[1:2] for x in groups if x[6] == "ambiguous"})
    distances = sorted(a - b for a, b in {(x[7], x[8]) for x in groups if x[8] is not None})
    at = lambda p, xs: xs[max(0, math.ceil(p * len(xs)) - 1)]
    assert got["distance_seconds", "all", "median"] == at(0.5, distances) and got["distance_seconds", "all", "p90"] == at(0.9, distances)
    books, reasons = Counter(x[2] for x in quotes), Counter(r for x in groups for r in x[9].split("|") if r)
    assert {k[1]: v for k, v in got.items() if k[0] == "book_frequency"} == {str(b): n for b, n in books.items()}
    assert {k[1]: v for k, v in got.items() if k[0] == "unusable_reasons"} == dict(reasons)
    # sketches per horizon and market, merged over everything and over markets
    stored = reports.coverage_sketches(g, q, ["horizon", "market"])
    every = sorted(x[7] - x[8] for x in groups if x[8] is not None)
    for by, keep in (([], lambda x: True), (["horizon"], lambda x: x[1] == 1)):
        row = [r for r in reports.sketched_coverage(stored, by, 5).collect() if not by or r.horizon == 1][0]
        some = every if not by else sorted(x[7] - x[8] for x in groups if x[8] is not None and keep(x))
        for p, value in ((0.5, row.median), (0.9, row.p90)):
            low, high = sum(v < value for v in some) / len(some), sum(v <= value for v in some) / len(some)
            assert low - 0.02 <= p <= high + 0.02
        top = Counter(x[2] for x in quotes if not by or x[0] == 1).most_common(5)
        assert sorted((x["item"], x["count"]) for x in row.books)[:3] == sorted(top)[:3]
