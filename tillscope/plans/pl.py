"""Monthly profit and loss. Advertising is kept elsewhere and left out of costs."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tillscope import schemas as S
from tillscope.functions.columns import open_ratio, sum_of
from tillscope.operators.matrix import month_number, newest, with_header


def monthly_pl(expenses: DataFrame, cost_items=S.COST_ITEMS,
               revenue: str = S.REVENUE_ITEM) -> DataFrame:
    """Total cost, operating profit and margin (percent, NULL without revenue)."""
    return (expenses.withColumn("total_cost", sum_of(*cost_items))
            .withColumn("operating_profit", F.col(revenue) - F.col("total_cost"))
            .withColumn("margin_pct", F.bround(
                open_ratio("operating_profit", revenue) * 100, 1)))


def latest_month_pl(pl: DataFrame, revenue: str = S.REVENUE_ITEM,
                    cogs: str = S.COGS_ITEM) -> DataFrame:
    """The newest month by its label, with the cost-of-goods ratio in percent."""
    newest = pl.agg(F.max_by(F.struct(*pl.columns), "month").alias("r")).select("r.*")
    return newest.select(
        "month", F.col(revenue).alias("revenue"), "total_cost", "operating_profit",
        "margin_pct", (open_ratio(cogs, revenue) * 100).alias("cogs_pct"))


def cost_breakdown(expenses: DataFrame, cost_items=S.COST_ITEMS) -> DataFrame:
    """Costs in long form: month, item, amount."""
    return expenses.unpivot(["month"], list(cost_items), "item", "amount")


def latest_cost_shares(expenses: DataFrame, cost_items=S.COST_ITEMS) -> DataFrame:
    """Each item's part of the newest month's costs."""
    newest = expenses.agg(F.max_by(F.struct("month", *cost_items), "month").alias("r"))
    items = cost_breakdown(newest.select("r.*"), cost_items)
    total = Window.partitionBy("month")  # one row per item
    return items.withColumn("share", open_ratio("amount", F.sum("amount").over(total)))


def month_window(pl: DataFrame, window: int = 12, start: int | None = None) -> list[str]:
    """Labels of ``window`` months by position; the newest ones without ``start``.

    Reads the list of months, which is as long as the history in months.
    """
    months = sorted(r[0] for r in pl.select("month").distinct().collect())
    last = max(0, len(months) - window)
    first = last if start is None else min(start, last)
    return months[first:first + window]


def month_slice(pl: DataFrame, window: int = 12, start: int | None = None) -> DataFrame:
    """Rows of ``window`` months by position, the newest ones without ``start``; lazy.

    ``position`` numbers the months from 0. The window runs over the list of months.
    """
    spot = Window.orderBy("month")  # one row per month of history
    months = pl.select("month").distinct().select(
        "month", (F.row_number().over(spot) - 1).alias("position"),
        F.count("*").over(Window.partitionBy()).alias("months"))
    newest = F.greatest(F.lit(0), F.col("months") - window)
    first = newest if start is None else F.least(F.lit(start), newest)
    kept = months.where((F.col("position") >= first) & (F.col("position") < first + window))
    return pl.join(kept.select("month", "position"), "month")


def pl_items(pl: DataFrame, cost_items=S.COST_ITEMS, revenue: str = S.REVENUE_ITEM) -> DataFrame:
    """P&L in long form: month, position, item, value."""
    items = [revenue, *cost_items, "total_cost", "operating_profit", "margin_pct"]
    return (pl.select("month", "position", *[F.col(i).cast("double").alias(i) for i in items])
            .unpivot(["month", "position"], items, "item", "value"))


def pl_newest(pl: DataFrame, window: int = 12, start: int | None = None,
              cost_items=S.COST_ITEMS, revenue: str = S.REVENUE_ITEM) -> DataFrame:
    """P&L with items as rows and ``window`` months as columns ``p0``, ``p1``, ...

    The newest months, or those from position ``start`` on; the row ``month`` tells which, as
    numbers like 202603. A month's row occurs once in a P&L; of repeated ones values add up.
    """
    items = [revenue, *cost_items, "total_cost", "operating_profit", "margin_pct"]
    cells = (newest(pl, "month", window, start)
             .select("month", "place", *[F.col(i).cast("double").alias(i) for i in items])
             .unpivot(["month", "place"], items, "item", "value"))
    return with_header(cells, ["item"], F.sum("value"),
                       F.max(month_number(F.col("month")).cast("double")), window)


def pl_matrix(pl: DataFrame, months, cost_items=S.COST_ITEMS,
              revenue: str = S.REVENUE_ITEM) -> DataFrame:
    """P&L with items as rows and the given months as columns."""
    items = [revenue, *cost_items, "total_cost", "operating_profit", "margin_pct"]
    order = F.array_position(F.array(*map(F.lit, items)), F.col("item"))
    shown = pl.where(F.col("month").isin(*months)).select(
        "month", *[F.col(i).cast("double").alias(i) for i in items])
    return (shown.unpivot(["month"], items, "item", "value")
            .groupBy("item").pivot("month", list(months)).agg(F.first("value"))
            .orderBy(order))
