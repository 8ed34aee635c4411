"""Typed scans of confirmed and raw rows: header roles, layouts, row filters and error columns."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.functions.periods import fold
from ledgerline.functions.text import confirmed_ids, name_key
from ledgerline.functions.values import date_text, parse_money

# Header words of each role, the first of a role before the later ones.
HEADERS = {
    "customer_id": ("idkh", "ma khach hang", "ma kh"),
    "customer_name": ("tenkh", "ten khach hang", "ho ten"),
    "raw": ("noidung", "lenh goc ngan hang", "ebl", "mo ta", "dien giai"),
    "amount": ("sotien", "so tien", "ghi co", "credit"),
    "debit": ("ghi no", "debit"),
    "date": ("ngay", "ngay giao dich", "date"),
    "reference": ("so tham chieu", "reference", "so but toan"),
    "payer": ("nganhang", "ngan hang", "kenh"),
}


def header_roles(cells: dict[str, str]) -> tuple[dict[str, str], list[str]]:
    """Columns by role of a header row, and the roles that more than one column claims with the same word."""
    roles: dict[str, str] = {}
    doubtful: list[str] = []
    keys = {c: " ".join(re.findall("[a-z]+", fold(v))) for c, v in cells.items()}
    for role, words in HEADERS.items():
        for word in words:
            found = [c for c, k in keys.items() if k == word]
            if found:
                roles[role] = found[0]
                if len(found) > 1:
                    doubtful.append(role)
                break
    return roles, doubtful


# Columns of layouts whose headers are known to be left blank, abbreviated or missing.
BLANK_HEADERS = {"date": "A", "customer_name": "D", "amount": "E", "payer": "H"}  # with ids in C and narratives in G
ABBREVIATED = {"reference": "B", "date": "C", "debit": "D", "amount": "E", "raw": "I"}
ABBREVIATED_HEADS = {"B": "so tham chieu", "I": "mo ta"}
HEADERLESS_SHEET = "sacombank"
HEADERLESS = {"reference": "C", "date": "E", "raw": "M", "debit": "Q", "amount": "T"}


def layout(roles: dict[str, str]) -> str | None:
    """confirmed (ids and narratives), raw (narratives with a reference, date or amount) or none."""
    if {"customer_id", "raw"} <= roles.keys():
        return "confirmed"
    if "raw" in roles and {"reference", "date", "amount", "debit"} & roles.keys():
        return "raw"
    return None


def detect(cells: dict[str, str]) -> tuple[str, dict[str, str]] | None:
    """(layout, roles) of a header row, or None; a role that two columns claim is not guessed."""
    roles, doubtful = header_roles(cells)
    if doubtful:
        return None
    if roles.get("customer_id") == "C" and roles.get("raw") == "G":
        roles = {r: c for r, c in BLANK_HEADERS.items() if c not in roles.values()} | roles
    if kind := layout(roles):
        return kind, roles
    heads = {c: fold(cells.get(c, "")).strip() for c in ABBREVIATED_HEADS}
    return ("raw", dict(ABBREVIATED)) if heads == ABBREVIATED_HEADS else None


def headerless(sheet: str, cells: dict[str, str]) -> tuple[str, dict[str, str]] | None:
    """The layout of a bank's export without headers. Its direction is not verified, so its rows are never accepted unseen."""
    has = lambda c: bool(cells.get(c, "").strip())
    dated = re.fullmatch(r"\d{1,2}[/-]\d{1,2}[/-]\d{4}.*|\d{4}-\d{2}-\d{2}.*|\d{5}(?:\.\d+)?", cells.get("E", "").strip())
    if fold(sheet).strip() == HEADERLESS_SHEET and has("C") and has("M") and (has("Q") or has("T")) and dated:
        return "raw_unverified", dict(HEADERLESS)
    return None


def sheet_layout(sheet: str, first: list[tuple[int, dict[str, str]]]) -> tuple[int, str, dict[str, str]] | None:
    """(header row, layout, roles) from the first rows of a sheet. A header may run over two adjacent lines, whose words are
    read together; a headerless layout has row 0 as its header."""
    before: tuple[int, dict[str, str]] | None = None
    for number, cells in first:
        both = None
        if before and before[0] + 1 == number:
            both = {c: " ".join(x for x in (before[1].get(c, ""), cells.get(c, "")) if x) for c in before[1].keys() | cells.keys()}
        for candidate in (cells, both):
            if candidate and (found := detect(candidate)):
                return number, *found
        before = (number, cells)
    for _, cells in first:
        if found := headerless(sheet, cells):
            return 0, *found
    return None


def layouts(cells: DataFrame, most: int = 100) -> DataFrame:
    """(file, sheet, header_row, layout, roles) of each sheet that has a known layout, found in its first ``most`` rows."""
    first = F.array_sort(F.collect_list(F.struct("row", "cells_json")))
    rows = cells.where(F.col("row") <= most).withColumn("cells_json", F.to_json("cells")).groupBy("file", "sheet").agg(first.alias("first"))

    def found(sheets: pd.Series, firsts: pd.Series) -> pd.DataFrame:
        got = [sheet_layout(s, [(r["row"], json.loads(r["cells_json"])) for r in f]) for s, f in zip(sheets, firsts, strict=True)]
        return pd.DataFrame({"header_row": [g[0] if g else None for g in got], "layout": [g[1] if g else None for g in got], "roles": [json.dumps(g[2]) if g else None for g in got]})

    told = F.pandas_udf(found, "header_row int, layout string, roles string")("sheet", "first")
    return rows.select("file", "sheet", told.alias("t")).where("t.layout IS NOT NULL").select("file", "sheet", "t.header_row", "t.layout", F.from_json("t.roles", "map<string,string>").alias("roles"))


def probe(cells: DataFrame, most: int = 100) -> dict[str, tuple[int, str, dict[str, str]]]:
    """(header row, layout, roles) of each sheet of one workbook; a row for each sheet comes to the driver."""
    return {r["sheet"]: (r["header_row"], r["layout"], r["roles"]) for r in layouts(cells, most).collect()}


def transactions(rows: DataFrame) -> DataFrame:
    """Typed transactions of text columns (row, date, amount, debit, reference, customer_id, customer_name, raw, payer).

    Repeated headers, blank narratives, totals (no date and no reference) and page footers are no rows. What cannot be read
    is null, with the reason in validation_errors; a negative amount counts as a debit.
    """
    text = lambda c: F.trim(F.coalesce(F.col(c), F.lit("")))
    total = (text("date") == "") & (text("reference") == "") & name_key(text("raw")).rlike("^(tong|cong|total)")
    footer = name_key(text("raw")).rlike("^(trang|page)( |$)")
    header = name_key(text("raw")).isin([w for words in HEADERS.values() for w in words])
    kept = rows.where((text("raw") != "") & ~total & ~footer & ~header)
    amount, debit = parse_money(text("amount")), parse_money(text("debit"))
    signed = F.when(amount < 0, -amount).otherwise(0.0)
    ids = confirmed_ids(F.col("customer_id"))
    error = lambda bad, what: F.when(bad, F.lit(what))
    errors = F.array_compact(F.array(error(amount.isNull() | debit.isNull(), "amount"), error(ids.isNull() & (text("customer_id") != ""), "customer_id"), error((text("date") != "") & ~date_text(F.col("date")).rlike(r"^\d{4}-\d{2}-\d{2}T"), "date")))
    return kept.select(
        "row", date_text(F.col("date")).alias("date"), F.greatest(amount, F.lit(0.0)).alias("amount"), (F.coalesce(debit, F.lit(0.0)) + F.coalesce(signed, F.lit(0.0))).alias("debit"),
        text("reference").alias("reference"), ids.alias("customer_ids"), text("customer_name").alias("customer_name"), text("raw").alias("raw"), text("payer").alias("payer"), errors.alias("validation_errors"),
    )


def rename_headers(df: DataFrame) -> DataFrame:
    """A table with header words as column names, by role; roles it lacks are null."""
    roles, doubtful = header_roles({c: c.removeprefix("﻿") for c in df.columns})
    if doubtful:
        raise ValueError(f"more than one column for {', '.join(doubtful)}")
    lacks: Column = F.lit(None).cast("string")
    return df.select(*(F.col(f"`{roles[r]}`").cast("string").alias(r) if r in roles else lacks.alias(r) for r in HEADERS))


def overlay(rows: DataFrame, reviews: DataFrame, key: str) -> DataFrame:
    """Working rows with the latest review of each, pending where there is none."""
    last = reviews.groupBy(key).agg(F.max(F.struct("at", "status"))["status"].alias("status"))
    return rows.join(last, key, "left").withColumn("status", F.coalesce("status", F.lit("pending")))
