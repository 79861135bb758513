from __future__ import annotations

import math

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from polka.functions import numeric, text
from polka.functions.measures import in_kopecks, with_contents, with_price_unit


def one(spark, expr, value, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(expr(F.col("x")).alias("y")).first()["y"]


@pytest.mark.parametrize("raw,value", [
    ("1 234,56", 1234.56), ("89,90", 89.9), ("1.234,5", 1234.5), ("1,234.5", 1234.5), ("1 234,5", 1234.5), ("", None), (None, None),
    ("1,2,3", None), ("inf", None), ("1d", None), ("-1", -1.0), ("12 руб.", None), ("0", 0.0), ("5о", None), ("1..2", None),
])
def test_localized_number(spark, raw, value):
    assert one(spark, numeric.localized_number, raw) == value


@settings(max_examples=1, deadline=None)
@given(st.lists(st.floats(-1e6, 1e6), min_size=300, max_size=300))
def test_exact_round_is_pythons(spark, xs):
    xs = [*xs, 0.125, 2.675, 1.005, -0.005, 101.25, math.nan, math.inf, None]
    rows = spark.createDataFrame([(x,) for x in xs], "x double").select("x", numeric.exact_round(F.col("x"), 2).alias("y")).collect()
    for r in rows:
        assert r["y"] == (None if r["x"] is None or not math.isfinite(r["x"]) else round(r["x"], 2))


@pytest.mark.parametrize("raw,fat,volume,weight,count", [
    ("Молоко 3,2% 0,93л", 3.2, 930, None, None), ("Крупа 5х80г (400г)", None, None, 400, 5), ("Вода 6 x 1 л", None, 6000, None, 6),
    ("Мука 1 000 г", None, None, 1000, None), ("Сок яблочный 100% 1л", None, 1000, None, None), ("Товар " + "9" * 400 + " кг", None, None, None, None),
    ("Салфетки 100 шт", None, None, None, 100), ("", None, None, None, None), (None, None, None, None, None),
])
def test_attributes(spark, raw, fat, volume, weight, count):
    assert tuple(one(spark, text.attributes, raw)) == (fat, volume, weight, count)


def test_normalize_product_text(spark):
    norm = one(spark, text.normalize_product_text, "Мол. у/паст. 3,2% 0,93л пл/бут")
    assert all(x in norm for x in ("3.2%", "930мл", "ультрапастеризованное", "пэт бутылка"))
    assert one(spark, text.normalize_product_text, "молоко") == "молоко"
    assert one(spark, text.normalize_product_text, "Nescafe Gold 1,5 кг и 95г") == "нескафе gold 1500г и 95г"
    assert one(spark, text.normalize_product_text, None) == ""


@pytest.mark.parametrize("raw,out", [("﻿ Код  товара.1", "код товара"), ("Цена, руб", "цена руб"), ("ЁЛКА_1", "елка 1"), ("", "")])
def test_normalize_header(spark, raw, out):
    assert one(spark, text.normalize_header, raw) == out


def test_small_texts(spark):
    assert one(spark, text.trigrams, "аб") == []
    assert one(spark, text.trigrams, "абаба") == ["аба", "баб"]
    assert one(spark, text.sanitize_cell, "  =1+1") == "'  =1+1"
    assert one(spark, text.sanitize_cell, None) == ""
    assert one(spark, text.has_source_value, " N/A ") is False and one(spark, text.has_source_value, None) is False
    assert one(spark, text.has_source_value, "0") is True
    assert one(spark, text.normalize_sku, " 007 ") == "007"
    assert one(spark, text.sku_of_number, 123.0, "double") == "123"


@pytest.mark.parametrize("raw,dim,total", [
    ("8 шт по 17 г", "g", 136.0), ("136 г (8*17г)", "g", 136.0), ("6×500 мл", "ml", 3000.0), ("1/2 л", "ml", 500.0), ("полкило", "g", 500.0),
    ("1 000 г", "g", 1000.0), ("100 cl", "ml", 1000.0), ("1 десяток", "pcs", 10.0), ("100шт/уп", "pcs", 100.0), ("Сок №1 500мл", "ml", 500.0),
    ("Яйцо С1 10шт", "pcs", 10.0), ("Творог 5% 0,3 КГ", "g", 300.0), ("-", None, None), (None, None, None), ("вода 1,5л", "ml", 1500.0),
])
def test_contents_in_spark_and_python(spark, raw, dim, total):
    row = with_contents(spark.createDataFrame([(raw,)], "x string"), "x", "dim", "total").first()
    assert (row["dim"], row["total"]) == (dim, total)


@pytest.mark.parametrize("raw,dim,amount", [
    ("руб/кг", "g", 1000.0), ("за 100 г", "g", 100.0), ("0,1л", "ml", 100.0), ("коп/10шт", "pcs", 10.0), ("десяток", "pcs", 10.0), ("шт.", "whole", 1.0),
    ("указана цена за килограмм", "g", 1000.0), ("стоимость 1 л", "ml", 1000.0), ("цена за упаковку; в коп.", "whole", 1.0), ("блик на ценнике", None, None), (None, None, None),
])
def test_price_unit(spark, raw, dim, amount):
    row = with_price_unit(spark.createDataFrame([(raw,)], "x string"), "x", "dim", "amount").first()
    assert (row["dim"], row["amount"]) == (dim, amount)
    assert one(spark, in_kopecks, raw) == (raw is not None and "коп" in raw)
