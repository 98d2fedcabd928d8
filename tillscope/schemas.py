"""Table schemas and the fixed domain values of the retail data model.

An order line belongs to one order; an order has one customer and one date.
SKU and customer ids are unique in their dimension tables.
"""

from pyspark.sql import types as T


def _schema(**columns):
    return T.StructType([T.StructField(name, kind, True) for name, kind in columns.items()])


_STR, _INT, _LONG = T.StringType(), T.IntegerType(), T.LongType()
_DATE, _DOUBLE, _BOOL = T.DateType(), T.DoubleType(), T.BooleanType()

TABLES = {
    "product_master": _schema(
        product_id=_STR, product_name=_STR, category=_STR, brand=_STR, sku_id=_STR,
        color=_STR, size=_STR, cost_price=_LONG, selling_price=_LONG),
    "customers": _schema(customer_id=_STR, customer_type=_STR, prefecture=_STR),
    "ec_orders": _schema(
        order_id=_STR, customer_id=_STR, product_id=_STR, sku_id=_STR, order_date=_DATE,
        status=_STR, quantity=_INT, unit_price=_LONG, total_amount=_LONG),
    "wms_inventory": _schema(
        date=_DATE, sku_id=_STR, warehouse_type=_STR, warehouse_name=_STR,
        stock_quantity=_INT, inbound=_INT, outbound=_INT),
    "ga_behavior": _schema(
        date=_DATE, sessions=_LONG, product_page_views=_LONG, add_to_cart=_LONG,
        bounce_rate=_DOUBLE),
    "ga_sessions": _schema(
        date=T.TimestampNTZType(), customer_id=_STR, customer_type=_STR, channel=_STR,
        is_logged_in=_BOOL),
    "ad_performance": _schema(
        date=_DATE, channel=_STR, cv_type=_STR, cost=_LONG, clicks=_LONG,
        conversions=_LONG, revenue=_LONG),
    "campaigns": _schema(
        campaign_id=_STR, campaign_name=_STR, start_date=_DATE, end_date=_DATE,
        discount_rate=_INT, coupon_type=_STR, target_category=_STR, budget=_LONG,
        actual_spend=_LONG),
    "supply_chain_master": _schema(
        category=_STR, step_order=_INT, step_name=_STR, lead_time_days=_INT,
        description=_STR),
    "vendors": _schema(
        vendor_id=_STR, vendor_name=_STR, category=_STR, location=_STR, country=_STR,
        moq=_INT, payment_terms=_STR),
    "monthly_expenses": _schema(
        month=_STR, 売上=_LONG, 原価=_LONG, 広告費=_LONG, 倉庫代=_LONG, 外注費=_LONG,
        物流費=_LONG, 決済手数料=_LONG, システム費=_LONG),
    "ad_plan": _schema(month=_STR, channel=_STR, objective=_STR, planned_cost=_LONG),
}

# Tables an installation may lack; analyses on them return no rows then.
OPTIONAL_TABLES = ("ga_sessions", "ad_plan")

# They must equal the data's own vocabulary.
DONE = "完了"
SEGMENTS = ("個人", "個人事業主", "法人")
CORPORATE = "法人"
SHIPPING_WAREHOUSE = "発送倉庫"
EC_WAREHOUSE = "EC在庫倉庫"
WAREHOUSE_TYPE_NAMES = {"マザー倉庫": "EC在庫倉庫"}
WAREHOUSE_NAMES = {"関東マザー倉庫": "関東EC在庫倉庫"}
NEW, REPEAT = "新規", "リピート"
WEEKDAYS = ("月", "火", "水", "木", "金", "土", "日")
ESTIMATED_BUSINESS, ESTIMATED_INDIVIDUAL = "事業者(推定)", "個人(推定)"
BUSINESS_THRESHOLD = 5
LAUNCH_DATE = "2026-06-15"
CHANNEL_BUCKETS = {
    "自然検索": "自然検索",
    "検索広告": "デジタル広告",
    "ディスプレイ広告": "デジタル広告",
    "リターゲ": "デジタル広告",
    "DM": "メルマガ／DM",
    "ダイレクト": "ダイレクト",
}
DIRECT = "ダイレクト"
AD_CHANNELS = ("検索広告", "ディスプレイ広告", "リターゲ")
REVENUE_ITEM = "売上"
COST_ITEMS = ("原価", "倉庫代", "外注費", "物流費", "決済手数料", "システム費")
COGS_ITEM = "原価"
MOVE_FROM_CORE, MOVE_FROM_EC, ENOUGH = "基幹倉庫から移動", "EC在庫倉庫から移動", "在庫十分"
FUNNEL_STAGES = ("セッション数", "商品ページ閲覧", "カート投入", "購入")
ACTUAL, PROJECTED = "実績", "予測"
# Fixed output values: an id must get the same display name everywhere; the order counts.
CORPORATE_PREFIXES = ("株式会社", "有限会社", "合同会社")
CORPORATE_STEMS = (
    "山田建設", "田中工業", "佐藤製作所", "鈴木商事", "高橋電機", "渡辺ワークス",
    "伊藤産業", "中村製造", "小林組", "加藤工務店", "吉田技研", "山本テック",
    "松本建機", "井上機工", "木村興業", "林物産", "斎藤工芸", "清水設備",
    "森田ロジ", "池田テクノ", "橋本精工", "石川製鉄", "前田ハウス", "藤田運輸",
    "岡田工業", "長谷川商会", "後藤電設", "近藤建材", "坂本エンジ", "遠藤製作",
)
