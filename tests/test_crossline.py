"""Cross-line prices against a loop over outcomes."""

import math

import pytest

from tidewater.operators import crossline

HISTOGRAM = [(1, -7.0, 2), (1, -0.5, 5), (1, 0.25, 4), (1, 6.0, 3), (2, -3.0, 1), (2, 0.0, 2), (2, 3.5, 1)]


def settled(market, center, point, first):
    """Win, push, loss of a home or over bet at a book's own point, outcome by outcome."""
    win = push = loss = 0.0
    for m, residual, n in HISTOGRAM:
        if m != market:
            continue
        low = math.floor(center + residual)
        for outcome, share in ((low, 1 - (center + residual - low)), (low + 1, center + residual - low)):
            signed = outcome + point if market == 1 else outcome - point
            signed = signed if first else -signed
            win, push, loss = win + n * share * (signed > 0), push + n * share * (signed == 0), loss + n * share * (signed < 0)
    total = win + push + loss
    return win / total, push / total, loss / total


def test_best_offer_of_every_side(spark):
    points = [(1, 1, 1, -3.0, 0.52, -110, -105), (1, 2, 1, -2.5, 0.50, 100, -120), (1, 3, 1, -4.0, 0.47, 105, -125), (1, 1, 2, 41.0, 0.5, -110, -110), (1, 2, 2, 42.5, 0.45, 110, -130), (2, 1, 1, 7.0, 0.5, -110, -110)]
    pairs = spark.createDataFrame([(e, b, m, p if m == 2 else -p, q, o1, o2, 0.04) for e, b, m, p, q, o1, o2 in points], "event_id long, book_id long, market long, line double, p double, odds1 long, odds2 long, overround double")
    hist = spark.createDataFrame(HISTOGRAM, "market long, value double, n long")
    offers = crossline.centered(pairs, hist)
    center = {(r.event_id, r.market): r.center for r in offers.collect()}
    assert set(center) == {(1, 1), (1, 2)}  # one book makes no centre
    assert 0 < center[1, 1] < 8  # the home side gives points, so it is the stronger
    got = {(r.market, r.side): r for r in crossline.best_offers(offers, hist).collect()}
    assert set(got) == {(1, 1), (1, 2), (2, 1), (2, 2)}
    for (market, side), r in got.items():
        every = []
        for _, book, m, point, _, o1, o2 in points[:5]:
            if m == market:
                win, push, loss = settled(market, center[1, market], point, side == 1)
                odds = o1 if side == 1 else o2
                price = 1 + (odds / 100 if odds > 0 else 100 / -odds)
                every.append((win * (price - 1) - loss, win / (win + loss) - 1 / price, price, book, win))
        best = max(every)
        assert (r.book_id, r.offers) == (best[3], len(every))
        assert (r.ev, r.edge, r.win) == pytest.approx((best[0], best[1], best[4]))


def test_histograms_hold_earlier_seasons_only(spark):
    x = spark.createDataFrame([(2000, 1, 0.5)] * 3 + [(2001, 1, 1.5)] * 2 + [(2000, 2, 0.0)], "season long, market long, value double")
    got = {(r.season, r.market, r.value): r.n for r in crossline.expanding_histograms(x, 2002, 3).collect()}
    assert got == {(2001, 1, 0.5): 3, (2002, 1, 0.5): 3, (2002, 1, 1.5): 2}
