import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from tillscope.session import make_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    return make_session("4")


@pytest.fixture(scope="session")
def tables(spark):
    """A small hand-made shop; the comments name the case a row stands for."""
    from datetime import date as D

    from tillscope import schemas as S

    def frame(name, rows):
        return spark.createDataFrame(rows, S.TABLES[name])

    orders = [
        # order, customer, product, sku, date, status, qty, unit, amount
        ("o1", "c1", "P1", "s1", D(2026, 6, 30), "完了", 2, 100, 200),
        ("o1", "c1", "P1", "s2", D(2026, 6, 30), "完了", 3, 50, 150),   # two lines
        ("o2", "c1", "P2", "s3", D(2026, 8, 31), "完了", 1, 300, 300),   # month end
        ("o3", "c2", "P2", "s3", D(2026, 8, 3), "完了", 1, 300, 300),
        ("o4", "c2", "P1", "s1", D(2026, 8, 20), "完了", 4, 100, 400),   # same month: new
        ("o5", "c3", "P2", "s3", D(2026, 8, 31), "キャンセル", 9, 300, 2700),
        ("o6", None, "P1", "s1", D(2026, 8, 31), "完了", 1, 100, 100),   # no customer
        ("o7", "c9", "P9", "s9", D(2026, 6, 1), "完了", 1, 70, 70),      # unknown ids
        ("o8", "c4", "P1", "s2", D(2025, 8, 10), "完了", 5, 50, 250),    # last year
        ("o9", "c4", "P1", "s2", D(2026, 6, 15), "完了", 1, 50, 50),
    ]
    return {
        "orders": frame("ec_orders", orders),
        "customers": frame("customers", [
            ("c1", "個人", "東京"), ("c2", "法人", "大阪"), ("c3", "法人", None),
            ("c4", "法人", None)]),
        "products": frame("product_master", [
            ("P1", "シャツ", "トップス", "B", "s1", "白", "M", 60, 100),
            ("P1", "シャツ", "トップス", "B", "s2", "白", "L", 30, 50),
            ("P2", "パンツ", "ボトムス", "B", "s3", "黒", "M", 200, 300),
            ("P3", "帽子", "小物", "B", "s4", "黒", "F", 10, 20)]),  # never sold
    }


def rows(df, *columns):
    return [tuple(r) for r in (df.select(*columns) if columns else df).collect()]
