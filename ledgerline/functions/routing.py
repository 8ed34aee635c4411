"""Payment routes, layout keys and signatures on parsed narratives."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerline.functions.payee import DEFAULT, Payee
from ledgerline.functions.text import channel_key, fold, name_key

SEPARATOR = "\x1f"
#: Number roles that change between transfers, and those that name a customer.
VARIABLE_ROLES = ("BANK_PROTOCOL", "BANK_REFERENCE", "REFERENCE_ID", "INVOICE_ID", "INVOICE_CODE", "AMOUNT", "QUANTITY", "RECEIVER_ACCOUNT")
IDENTITY_ROLES = ("CUSTOMER_ID", "CONTRACT_ID", "MIXED_CODE", "LOCATION_NUMBER")
# Layouts of collection services; {city} is the payee's, {receiver} its name.
FIXED_LAYOUTS = [
    r"\bo@l_(?:\d+_){5}\d{6}_",
    r"ma_gd:\d+\|\d{6},\s*nuoc",
    r"atbp:[a-z\d]+\s+tthd\s+nuoc\s+{city}",
    r"tthd\s+tien\s+nuoc\s+ma\s+kh-",
    r"tthd\s+nuoc\s+{city}\s*,",
    r"\but\s+\d{6}\s+t\d{1,2}n20\d{2}\s+cap\s+nuoc\s+{city}",
    r"^mb\.\d+-\d+-\d{8}-\d{6}-\d+\.\d{8}\.[^.]*{receiver}[^.]*\.",
]
#: Messages by decision reason.
REASONS = {"unique": "Mã khách hàng trùng khớp.", "shared": "Mã thuộc nhiều khách hàng; cần kiểm tra thủ công.", "unknown": "Chưa có dữ liệu đã xác nhận; cần kiểm tra thủ công."}


def layout_key(shape: Column, structure: Column, channel: Column) -> Column:
    """Digest of a shared layout in a channel."""
    return F.sha2(F.concat_ws(SEPARATOR, channel_key(channel), shape, structure), 256)


def pattern_identity(numbers: Column) -> Column:
    """The stable identifiers of a narrative in order: slot, role, value and format of each."""
    kept = F.filter(numbers, lambda n: n["numeric_type"].isin(list(IDENTITY_ROLES)))
    return F.transform(kept, lambda n: F.concat_ws("|", n["slot"].cast("string"), n["numeric_type"], n["value"], n["format"]))


def receipt_key(raw: Column, customer: Column, date: Column, amount: Column, channel: Column, reference: Column) -> Column:
    """Digest under which a confirmed content is learned once."""
    parts = F.array(raw, customer, F.coalesce(date, F.lit("")), F.coalesce(amount, F.lit(0.0)).cast("string"), channel_key(channel), F.coalesce(reference, F.lit("")))
    return F.sha2(F.concat(F.lit("confirmed-content:"), F.to_json(parts)), 256)


def negative_key(digest: Column, version: str = "1") -> Column:
    return F.sha2(F.concat(F.lit(f"recurring:{version}:"), digest), 256)


def recurring_signature(norm: Column, channel: Column) -> Column:
    """Digest of a narrative's texts and stable numbers in order; changing numbers are left out."""
    texts = F.transform(F.filter(norm["segments"], lambda s: s["type"] == "text"), lambda s: s["value"])
    stable = F.transform(F.filter(norm["numbers"], lambda n: ~n["numeric_type"].isin(list(VARIABLE_ROLES))), lambda n: F.concat_ws(":", n["numeric_type"], n["value"], n["format"]))
    return F.sha2(F.concat_ws(SEPARATOR, channel_key(channel), F.array_join(texts, " "), F.array_join(stable, SEPARATOR)), 256)


def payment_hint(raw: Column, payee: Payee = DEFAULT) -> Column:
    """proxy for a collection service's fixed layout, else unknown."""
    either = "|".join(p.replace("{city}", payee.city).replace("{receiver}", payee.receiver) for p in FIXED_LAYOUTS)
    return F.when(fold(raw).rlike(either), "proxy").otherwise("unknown")


def payment_route(mode: Column, kind: Column, name: Column) -> Column:
    """struct(mode, kind, name) of spreadsheet labels: proxy, self or unknown; bank, wallet, other or unknown."""
    m, k = name_key(F.coalesce(mode, F.lit(""))), name_key(F.coalesce(kind, F.lit("")))
    proxy, own = m.rlike("thu ho|thuho|vi dien tu|tra qua vi"), m.rlike("tu tra|tu chuyen|tu thanh toan")
    route = F.when(proxy | (m == "proxy"), "proxy").when(own | (m == "self"), "self").otherwise("unknown")
    implied = F.when(proxy & m.contains("ngan hang"), "bank").when(proxy & m.contains("vi"), "wallet").otherwise("unknown")
    given = F.when(k.isin("ngan hang", "bank"), "bank").when(k.isin("vi dien tu", "wallet"), "wallet").when(k.isin("dich vu khac", "khac", "other"), "other").otherwise("unknown")
    chosen = F.when(k == "", implied).otherwise(given)
    selfish = route == "self"
    return F.struct(route.alias("mode"), F.when(selfish, "unknown").otherwise(chosen).alias("kind"), F.when(selfish, "").otherwise(F.trim(F.coalesce(name, F.lit("")))).alias("name"))


def unique_transfer_reference(numbers: Column) -> Column:
    """Whether a narrative carries a reference of one transfer, so equal texts are one transfer."""
    held = ("RECEIVER_ACCOUNT", "ACCOUNT_ID", "CARD_ID", "AMOUNT")
    digits = lambda n: F.length(F.regexp_replace(n["value"], r"\D", ""))
    return F.exists(numbers, lambda n: (n["numeric_type"] == "BANK_REFERENCE") | (~n["numeric_type"].isin(list(held)) & (digits(n) >= 8)))
