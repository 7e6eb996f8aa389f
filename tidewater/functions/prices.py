"""Column functions on prices, probabilities and money. Invalid input gives null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def american_to_decimal(odds: Column) -> Column:
    """Decimal price of American odds; null below 100 in size."""
    return F.when(odds >= 100, 1 + odds / F.lit(100.0)).when(odds <= -100, 1 + F.lit(100.0) / -odds)


def implied_probability(odds: Column) -> Column:
    return 1 / american_to_decimal(odds)


def implied_from_decimal(price: Column) -> Column:
    return F.when(price > 1, 1 / price)


def no_vig(p: Column, pair: list[str], last: Column) -> Column:
    """Share of p among the outcomes of a pair, to 12 places half-even; the outcome marked last takes the rest. Null below two outcomes or where one is not positive."""
    w = Window.partitionBy(*pair)
    others = F.bround((F.sum(p).over(w) - p) / F.sum(p).over(w), 12)
    share = F.when(last, 1 - others).otherwise(F.bround(p / F.sum(p).over(w), 12))
    return F.when((F.count(p).over(w) >= 2) & (F.min(p).over(w) > 0), share)


def overround(p: Column, pair: list[str]) -> Column:
    return F.sum(p).over(Window.partitionBy(*pair)) - 1


def edge(fair: Column, implied: Column) -> Column:
    return fair - implied


def edge_with_push(win: Column, push: Column, implied: Column) -> Column:
    """win given that the bet resolves, against the implied probability."""
    return F.coalesce(F.try_divide(win, 1 - push), F.lit(0.0)) - implied


def ev_binary(p: Column, price: Column) -> Column:
    return p * price - 1


def ev_with_push(win: Column, loss: Column, price: Column) -> Column:
    return win * (price - 1) - loss


def kelly_with_push(win: Column, push: Column, price: Column) -> Column:
    b, loss = price - 1, 1 - win - push
    return F.greatest(F.lit(0.0), F.coalesce(F.try_divide(b * win - loss, b * (win + loss)), F.lit(0.0)))


def expected_log_growth(win: Column, push: Column, price: Column, fraction: Column) -> Column:
    """Expected log of wealth at a staked fraction; nothing staked grows nothing, all staked can be lost."""
    loss = 1 - win - push
    return F.when(fraction == 0, 0.0).when((fraction > 0) & (fraction < 1), win * F.log1p(fraction * (price - 1)) + loss * F.log1p(-fraction))


def money_half_up(x: Column) -> Column:
    return F.round(x.cast("decimal(20,6)"), 2)


def money_down(x: Column) -> Column:
    return (F.floor(x.cast("decimal(20,6)") * 100) / 100).cast("decimal(18,2)")


def line_advantage(market: Column, side: Column, center: Column, point: Column) -> Column:
    """Points of value of an offered line against the fair centre."""
    spread = F.when(side == "home", center).otherwise(-center) + point
    return F.when(market == "spread", spread).otherwise(F.when(side == "over", center - point).otherwise(point - center))


def settle(market: Column, side: Column, point: Column, margin: Column, total: Column, tie: str = "push") -> Column:
    """win, loss or push of an offer; a level moneyline takes the label `tie`."""
    signed = (
        F.when(market == "total", F.when(side == "over", total - point).otherwise(point - total))
        .when(market == "spread", F.when(side == "home", margin).otherwise(-margin) + point)
        .otherwise(F.when(side == "home", margin).otherwise(-margin))
    )
    return F.when(signed > 0, "win").when(signed < 0, "loss").when(signed.isNotNull(), F.when(market == "moneyline", tie).otherwise("push"))


def unit_return(result: Column, price: Column) -> Column:
    return F.when(result == "win", price - 1).when(result == "loss", -1.0).when(result.isNotNull(), 0.0)
