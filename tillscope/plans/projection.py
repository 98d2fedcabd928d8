"""Projection of monthly sales and demand, and the spending what-if.

``method="trees"`` is a gradient-boosted ensemble fitted by Spark ML. Demand uses one
model for all categories: the category is a feature and the target is divided by the
category's mean, since one fit per category would multiply the tree jobs.
``method="seasonal"`` is a least-squares trend plus a month-of-year offset per series,
in plain aggregates; it fits any number of series and leaves spending out.

Training rows are months by series, so the model input is small however long the
order table is.
"""

from typing import NamedTuple

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import OneHotEncoder, StringIndexer, VectorAssembler
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillscope import schemas as S
from tillscope.functions.columns import month_label, month_start, yen, zero_if_null
from tillscope.operators.domains import month_domain
from tillscope.operators.materialize import materialize
from tillscope.operators.matrix import month_number, newest, places_as_columns, with_header
from tillscope.operators.periods import last_months, latest_date
from tillscope.operators.salting import join_to_few
from tillscope.plans.ads import mean_monthly_ad_spend, monthly_ad_spend
from tillscope.plans.sales import monthly_sales

MONTH_FLAGS = [f"m_{m}" for m in range(1, 13)]


# ── history and features ────────────────────────────────────────────────────


def category_monthly_quantity(orders: DataFrame, products: DataFrame,
                              min_months: int = 1,
                              drop_partial: bool = False) -> DataFrame:
    """Pieces by category and month, categories with ``min_months`` months or more."""
    per_sku = (orders.where(F.col("sku_id").isNotNull())
               .groupBy("sku_id", month_start("order_date").alias("month"))
               .agg(F.sum("quantity").alias("quantity")))
    monthly = (per_sku.join(products.select("sku_id", "category"), "sku_id")
               .dropna(subset=["category", "month"]).groupBy("category", "month")
               .agg(zero_if_null(F.sum("quantity")).alias("qty")))
    if drop_partial:
        monthly = drop_partial_month(monthly, latest_date(orders, "order_date"))
    if min_months <= 1:
        return monthly
    months = F.count("*").over(Window.partitionBy("category"))  # one row per month
    return (monthly.withColumn("months", months).where(F.col("months") >= min_months)
            .drop("months"))


def drop_partial_month(history: DataFrame, latest: Column) -> DataFrame:
    """Leave out the newest month unless ``latest`` is its last day."""
    return history.where((F.col("month") < month_start(latest))
                         | (F.last_day(latest) == latest))


def month_index(history: DataFrame, key: str, calendar: bool = False) -> DataFrame:
    """``month_num`` from 0: position among the months present, or calendar months."""
    months = Window.partitionBy(key)
    if calendar:
        first = F.min("month").over(months)
        number = F.months_between("month", first).cast("long")
    else:
        number = (F.row_number().over(months.orderBy("month")) - 1).cast("long")
    return history.withColumn("month_num", number)


def month_flags(df: DataFrame) -> DataFrame:
    """Columns m_1 .. m_12, 1 for the month of the row."""
    return df.withColumns({f"m_{m}": (F.month("month") == m).cast("int")
                           for m in range(1, 13)})


def with_ad_spend(frame: DataFrame, spend: DataFrame, default: Column) -> DataFrame:
    """``ad_spend`` of the month, ``default`` where the month has none."""
    known = spend.select("month", F.col("ad_spend").cast("double").alias("ad_spend"))
    return (frame.join(known, "month", "left")
            .withColumn("ad_spend", F.coalesce("ad_spend", default)))


def future_months(indexed: DataFrame, key: str, horizon: int) -> DataFrame:
    """The ``horizon`` months after each series' own last month, numbered onwards."""
    last = indexed.groupBy(key).agg(F.max("month").alias("last_month"),
                                    F.max("month_num").alias("last_num"))
    steps = F.explode(F.sequence(F.lit(1), F.lit(horizon)))
    return (last.withColumn("step", steps)
            .select(key, F.add_months("last_month", F.col("step")).alias("month"),
                    (F.col("last_num") + F.col("step")).alias("month_num")))


# ── models ──────────────────────────────────────────────────────────────────


def fit_trees(indexed: DataFrame, key: str, value: str, add_features, features,
              trees: int, depth: int, seed: int) -> "FittedTrees":
    """Fit one ensemble over all series, each divided by its own mean.

    The training rows, months by series, are written once to the checkpoint folder, so
    the order table is not read again by each pass of the fit.
    """
    frame = materialize(add_features(indexed))
    scales = frame.groupBy(key).agg(F.avg(F.col(value).cast("double")).alias("scale"))
    train = (frame.join(scales, key)
             .withColumn("label", F.coalesce(F.try_divide(
                 F.col(value).cast("double"), F.col("scale")), F.lit(0.0))))
    pipeline = Pipeline(stages=[
        StringIndexer(inputCol=key, outputCol="__id", handleInvalid="keep"),
        OneHotEncoder(inputCol="__id", outputCol="__series", dropLast=False),
        VectorAssembler(inputCols=[*features, "__series"], outputCol="features"),
        GBTRegressor(maxIter=trees, maxDepth=depth, stepSize=0.1, seed=seed, maxBins=256)])
    model = pipeline.fit(train.select(key, "label", *features))
    frame.unpersist()
    return FittedTrees(model, frame, scales, key, value)


def seasonal(history: DataFrame, key: str, value: str, horizon: int) -> DataFrame:
    """Trend by least squares over the month number plus a mean month-of-year offset.

    A series is one row holding its months as an array, so fit and projection need no
    join. Sums stay whole numbers or decimals and do not depend on the order of rows.
    """
    kind = history.schema[value].dataType
    exact = T.DecimalType(38, kind.scale) if isinstance(kind, T.DecimalType) else kind
    rows = (history.groupBy(key)
            .agg(F.sort_array(F.collect_list(F.struct("month", value))).alias("rows"))
            .select(key, F.transform("rows", lambda r, i: F.struct(
                r["month"].alias("month"), i.cast("long").alias("x"),
                r[value].alias("y"))).alias("rows")))

    def add(rows, term, kind="long"):
        return F.aggregate(rows, F.lit(0).cast(kind),
                           lambda total, r: (total + term(r)).cast(kind)).cast("double")

    def sums(rows):
        return {"n": F.size(rows).cast("double"), "sx": add(rows, lambda r: r["x"]),
                "sy": add(rows, lambda r: r["y"], exact)}

    n, sx, sy = F.col("n"), F.col("sx"), F.col("sy")
    fit = rows.withColumns({
        **sums("rows"), "sxx": add("rows", lambda r: r["x"] * r["x"]),
        "sxy": add("rows", lambda r: r["x"] * r["y"], exact),
        "last_month": F.element_at("rows", -1)["month"]})
    fit = fit.withColumn("slope", F.coalesce(F.try_divide(
        n * F.col("sxy") - sx * sy, n * F.col("sxx") - sx * sx), F.lit(0.0)))
    fit = fit.withColumn("intercept", (sy - F.col("slope") * sx) / n)

    ahead = (fit.select(key, "rows", "slope", "intercept", "last_month",
                        F.explode(F.sequence(F.lit(1), F.lit(horizon))).alias("step"))
             .withColumn("month", F.add_months("last_month", F.col("step")))
             .withColumn("month_num",
                         (F.size("rows") - 1 + F.col("step")).cast("long")))
    alike = F.filter("rows", lambda r: F.month(r["month"]) == F.month(F.col("month")))
    ahead = ahead.withColumn("alike", alike).withColumns(sums("alike"))
    offset = F.when(n > 0, (sy - n * F.col("intercept") - F.col("slope") * sx) / n)
    return ahead.select(key, "month", "month_num",
                        (F.col("intercept") + F.col("slope") * F.col("month_num")
                         + F.coalesce(offset, F.lit(0.0))).alias(value))


class FittedTrees(NamedTuple):
    """A fitted ensemble with its training rows and the scales of its series."""
    model: PipelineModel
    frame: DataFrame
    scales: DataFrame
    key: str
    value: str

    def errors(self) -> DataFrame:
        """Squared errors over the training rows, of the trees and of each series' mean."""
        actual = F.col("__actual")
        own = self.project(self.frame.withColumn("__actual", F.col(self.value).cast("double"))
                           .drop(self.value))
        return own.agg(F.sum((F.col(self.value) - actual) ** 2).alias("trees"),
                       F.sum((F.col("scale") - actual) ** 2).alias("mean"))

    def project(self, future: DataFrame) -> DataFrame:
        return (self.model.transform(future).join(self.scales, self.key)
                .withColumn(self.value, F.col("prediction") * F.col("scale")))


def sales_projection(orders: DataFrame, horizon: int = 6, method: str = "trees",
                     trees: int = 100, depth: int = 3, seed: int = 42,
                     drop_partial: bool = False) -> DataFrame:
    """Monthly revenue ``horizon`` months ahead with a band of 30 % either way.

    A partial last month counts like a full one unless ``drop_partial``.
    """
    history = sales_history(orders, drop_partial)
    if method == "seasonal":
        return _with_band(seasonal(history, "series", "sales", horizon))
    return sales_band(fit_sales(month_index(history, "series"), trees, depth, seed), horizon)


def sales_history(orders: DataFrame, drop_partial: bool = False) -> DataFrame:
    """Monthly revenue as one series."""
    history = (monthly_sales(orders).withColumnRenamed("revenue", "sales")
               .withColumn("series", F.lit("all")))
    if drop_partial:
        history = drop_partial_month(history, latest_date(orders, "order_date"))
    return history


def fit_sales(indexed: DataFrame, trees: int = 100, depth: int = 3,
              seed: int = 42) -> FittedTrees:
    return fit_trees(indexed, "series", "sales", month_flags,
                     ["month_num", *MONTH_FLAGS], trees, depth, seed)


def sales_band(fitted: FittedTrees, horizon: int) -> DataFrame:
    return _with_band(fitted.project(
        month_flags(future_months(fitted.frame, "series", horizon))))


def _with_band(result: DataFrame) -> DataFrame:
    return (result.select("month", "month_num", "sales",
                          (F.col("sales") * 0.7).alias("lower"),
                          (F.col("sales") * 1.3).alias("upper")).orderBy("month"))


def _whole_pieces(result: DataFrame) -> DataFrame:
    return (result.select("category", "month", "month_num",
                          F.greatest(F.col("qty"), F.lit(0.0)).cast("long").alias("qty"))
            .orderBy("category", "month"))


class DemandModel(NamedTuple):
    """Demand trees and the past mean spending; one fit serves any number of plans."""
    fitted: FittedTrees
    mean_spend: DataFrame

    def project(self, horizon: int = 12, plan: DataFrame | None = None) -> DataFrame:
        """Pieces by category and month; months without planned spending get the mean."""
        mean = self.mean_spend.scalar()
        ahead = month_flags(future_months(self.fitted.frame, "category", horizon))
        ahead = (ahead.withColumn("ad_spend", mean) if plan is None
                 else with_ad_spend(ahead, plan, mean))
        return _whole_pieces(self.fitted.project(ahead))


    def scenarios(self, spend: DataFrame, horizon: int = 12) -> DataFrame:
        """Pieces by scenario, category and month, and ``delta``, how many more than with the
        past mean spending throughout; all from this fit, in one pass of the model.

        ``spend`` (scenario, month, ad_spend), see ``plans.ads.plan_scenarios``. A month that a
        scenario leaves out gets the mean, repeated months are added up, rows without scenario
        do not count. Months of a scenario travel as one map.
        """
        mean = self.mean_spend.scalar()
        ahead = month_flags(future_months(self.fitted.frame, "category", horizon))
        by_month = (spend.dropna(subset=["scenario", "month", "ad_spend"])
                    .groupBy("scenario", "month")
                    .agg(F.sum(F.col("ad_spend").cast("double")).alias("ad_spend")))
        months = ahead.agg(F.collect_set("month")).scalar()
        wanted = (by_month.groupBy("scenario")
                  .agg(F.map_from_entries(F.collect_list(F.struct("month", "ad_spend")))
                       .alias("spend"))
                  .select("scenario", "spend", F.explode(months).alias("month"))
                  .select("scenario", "month", F.coalesce(
                      F.try_element_at("spend", F.col("month")), mean).alias("ad_spend")))
        none = F.lit(None).cast(wanted.schema["scenario"].dataType)
        both = ahead.withColumn("ad_spend", mean).withColumn("scenario", none) \
            .unionByName(ahead.join(wanted, "month"))
        base = F.max(F.when(F.col("scenario").isNull(), F.col("qty"))).over(
            Window.partitionBy("category", "month"))
        return (self.fitted.project(both)
                .select("scenario", "category", "month", "month_num", "ad_spend",
                        F.greatest(F.col("qty"), F.lit(0.0)).cast("long").alias("qty"))
                .withColumn("delta", F.col("qty") - base)
                .where(F.col("scenario").isNotNull())
                .orderBy("scenario", "category", "month"))


def fit_demand(orders: DataFrame, products: DataFrame, ads: DataFrame, trees: int = 100,
               depth: int = 3, seed: int = 42, min_months: int = 6,
               drop_partial: bool = False) -> DemandModel:
    """Fit demand by category on month, month of year and that month's ad spending."""
    history = category_monthly_quantity(orders, products, min_months, drop_partial)
    mean, spend = mean_monthly_ad_spend(ads), monthly_ad_spend(ads)

    def features(frame):
        return with_ad_spend(month_flags(frame), spend, mean.scalar())
    fitted = fit_trees(month_index(history, "category"), "category", "qty", features,
                       ["month_num", "ad_spend", *MONTH_FLAGS], trees, depth, seed)
    return DemandModel(fitted, mean)


def demand_projection(orders: DataFrame, products: DataFrame, ads: DataFrame | None = None,
                      plan: DataFrame | None = None, horizon: int = 12,
                      method: str = "trees", trees: int = 100, depth: int = 3,
                      seed: int = 42, min_months: int = 6,
                      drop_partial: bool = False) -> DataFrame:
    """Pieces by category and future month, never negative, cut to whole pieces.

    ``plan`` (month, ad_spend) is the spending to assume; months outside it get the
    past mean, as do past months without spending. Only ``trees`` reacts to spending.
    """
    if method == "seasonal":
        history = category_monthly_quantity(orders, products, min_months, drop_partial)
        return _whole_pieces(seasonal(history, "category", "qty", horizon))
    return fit_demand(orders, products, ads, trees, depth, seed, min_months,
                      drop_partial).project(horizon, plan)


def plan_spend(monthly_plan: DataFrame) -> DataFrame:
    """Adjusted plan totals by month as the spending input of a demand projection."""
    return monthly_plan.select(F.col("month_start").alias("month"),
                               F.col("adjusted").cast("double").alias("ad_spend"))


# ── results built on a projection ───────────────────────────────────────────


def actual_projection_table(history: DataFrame, projection: DataFrame, first=None,
                            last=None, months: int = 7) -> DataFrame:
    """Actual months ``first`` to ``last`` and the projected ones, as text in long form.

    Without them the newest ``months`` months of the history. Actual months without sales
    show a dash.
    """
    dash = F.lit("—")
    if last is None:
        last = history.agg(F.max("month")).scalar()
        first = F.add_months(last, 1 - months)
    months = month_domain(history.sparkSession, first, last)
    actual = (months.join(history.select("month", "revenue"), "month", "left")
              .select("month", F.lit(S.ACTUAL).alias("kind"),
                      F.coalesce(yen("revenue"), dash).alias("sales"),
                      dash.alias("lower"), dash.alias("upper")))
    ahead = projection.select("month", F.lit(S.PROJECTED).alias("kind"),
                              yen("sales").alias("sales"), yen("lower").alias("lower"),
                              yen("upper").alias("upper"))
    return (actual.unionByName(ahead).orderBy("month")
            .withColumn("label", month_label("month", "yyyy/MM")))


def table_by_place(table: DataFrame, width: int) -> DataFrame:
    """The table above on its side, rows as columns ``p0``, ``p1``, ... in order of month and
    kind; a month that is both actual and projected has a column for each.

    The row ``label`` names the columns. ``width``: the months shown, of which more are cut.
    """
    items = ["label", "kind", "sales", "lower", "upper"]
    spot = Window.orderBy("month", "kind")  # one row per month shown
    return places_as_columns(
        table.withColumn("place", F.row_number().over(spot) - 1).where(F.col("place") < width)
        .unpivot(["place"], items, "item", "value"), ["item"], F.max("value"), width)


def months_as_columns(table: DataFrame, labels) -> DataFrame:
    """Turn the table above on its side: items as rows, ``labels`` as columns."""
    items = ["kind", "sales", "lower", "upper"]
    return (table.unpivot(["label"], items, "item", "value")
            .groupBy("item").pivot("label", list(labels)).agg(F.first("value")))


def sku_demand_split(projection: DataFrame, orders: DataFrame, products: DataFrame,
                     months: int = 6, latest: Column | None = None) -> DataFrame:
    """Projected pieces by SKU and month, at least 1, with the SKU's total.

    A category's pieces are split by the SKUs' share of recent sales; a SKU that sold
    nothing gets an equal share. A category's months travel as one array, so SKUs
    are not shuffled again to add up their months.
    """
    sold = (last_months(orders, "order_date", months, latest)
            .where(F.col("sku_id").isNotNull())
            .groupBy("sku_id").agg(zero_if_null(F.sum("quantity")).alias("recent")))
    skus = (products.where(F.col("category").isNotNull())
            .select("sku_id", "category", "product_name", "color", "size")
            .join(sold, "sku_id", "left"))
    totals = skus.groupBy("category").agg(
        F.count("*").alias("skus"), zero_if_null(F.sum("recent")).alias("sold"))
    ahead = projection.groupBy("category").agg(
        F.sort_array(F.collect_list(F.struct("month", "qty"))).alias("ahead"))
    share = (F.when(F.col("recent").isNull(), F.lit(1.0) / F.col("skus"))
             .when(F.col("sold") > 0, F.col("recent") / F.col("sold")).otherwise(0.0))
    split = (join_to_few(skus, totals.join(ahead, "category"), "category", "sku_id")
             .withColumn("share", share)
             .withColumn("ahead", F.transform("ahead", lambda m: F.struct(
                 m["month"].alias("month"),
                 F.greatest(F.lit(1), (m["qty"] * F.col("share")).cast("long")).alias("qty"))))
             .withColumn("total", F.aggregate("ahead", F.lit(0).cast("long"),
                                              lambda total, m: total + m["qty"])))
    return split.select("category", "sku_id", "product_name", "color", "size", "total",
                        F.inline("ahead")).orderBy("category", F.desc("total"), "sku_id",
                                                   "month")


def sku_demand_matrix(split: DataFrame, labels) -> DataFrame:
    """SKUs as rows and ``yyyy/MM`` months as columns, biggest totals first."""
    return (split.withColumn("label", month_label("month", "yyyy/MM"))
            .groupBy("category", "sku_id", "total").pivot("label", list(labels))
            .agg(F.first("qty")).orderBy("category", F.desc("total"), "sku_id"))


def sku_demand_by_place(split: DataFrame, window: int = 6) -> DataFrame:
    """SKUs as rows and the first ``window`` projected months as columns ``p0``, ``p1``, ...

    The row whose category is ``month`` tells which months, as numbers like 202603.
    """
    cells = newest(split.select("category", "sku_id", "total", "month", "qty"), "month", window, 0)
    return with_header(cells, ["category", "sku_id", "total"], F.sum("qty"),
                       F.max(month_number(F.col("month"))), window)


def category_demand_total(split: DataFrame) -> DataFrame:
    return split.groupBy("category").agg(F.sum("qty").alias("qty")).orderBy("category")
