"""Notification outbox: what would be mailed to the contact of a new record."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from homeward.functions.contacts import email_in

# Subject lines and field labels of the messages.
SUBJECTS = {
    "missing": "Hồ Sơ Người Mất Tích Đã Được Tạo - %s",
    "found": "Hồ Sơ Người Được Tìm Thấy Đã Được Tạo - %s",
}
LABELS = {
    "missing": {
        "case_id": "Mã Hồ Sơ (Case ID)",
        "name": "Họ và Tên",
        "age_at_disappearance": "Tuổi Khi Mất Tích",
        "year_disappeared": "Năm Mất Tích",
        "gender": "Giới Tính",
        "location_last_seen": "Địa Điểm Cuối Cùng",
        "contact": "Thông Tin Liên Hệ",
        "height_cm": "Chiều Cao",
        "birthmarks": "Đặc Điểm Nhận Dạng",
        "additional_info": "Thông Tin Bổ Sung",
    },
    "found": {
        "found_id": "Mã Hồ Sơ (Found ID)",
        "name": "Tên",
        "current_age_estimate": "Tuổi Ước Tính Hiện Tại",
        "gender": "Giới Tính",
        "current_location": "Vị Trí Hiện Tại",
        "finder_contact": "Thông Tin Liên Hệ Người Tìm Thấy",
        "visible_marks": "Dấu Hiệu Nhận Dạng",
        "current_condition": "Tình Trạng Hiện Tại",
        "additional_info": "Thông Tin Bổ Sung",
    },
}
ABSENT = "N/A"
YEARS_SUFFIX = " tuổi"
HEIGHT_SUFFIX = " cm"

# Fields that are left out when empty; the others show ABSENT.
_OPTIONAL = {
    "missing": {"height_cm", "birthmarks", "additional_info"},
    "found": {"name", "visible_marks", "current_condition", "additional_info"},
}
_SUFFIX = {
    "age_at_disappearance": YEARS_SUFFIX,
    "current_age_estimate": YEARS_SUFFIX,
    "height_cm": HEIGHT_SUFFIX,
}


def _shown(name: str, optional: bool) -> Column:
    """Text of a field; NULL when an optional field has nothing to show."""
    if name in ("birthmarks", "visible_marks"):
        text = F.when(F.size(name) > 0, F.array_join(name, ", "))
    elif name == "height_cm":
        text = F.when(F.col(name) != 0, F.col(name).cast("string"))
    elif name == "gender":
        text = F.upper(name)
    else:
        text = F.col(name).cast("string")
    text = F.nullif(text, F.lit("")) if optional else F.coalesce(text, F.lit(ABSENT))
    return F.concat(text, F.lit(_SUFFIX.get(name, "")))


def outbox(records: DataFrame, side: str, *keep: str) -> DataFrame:
    """Recipient, subject and ordered (label, value) fields; records without e-mail drop out.

    Columns to ``keep`` of the records come last.
    """
    key = "case_id" if side == "missing" else "found_id"
    contact = "contact" if side == "missing" else "finder_contact"
    fields = []
    for name, label in LABELS[side].items():
        if name not in records.columns:
            continue
        value = _shown(name, name in _OPTIONAL[side])
        entry = F.struct(F.lit(label).alias("label"), value.alias("value"))
        fields.append(F.when(value.isNotNull(), entry))
    image = F.col("image_url") if "image_url" in records.columns else F.lit(None).cast("string")
    return (
        records.withColumn("_recipient", email_in(F.col(contact)))
        .filter(F.col("_recipient").isNotNull())
        .select(
            F.col("_recipient").alias("recipient"),
            F.format_string(SUBJECTS[side], F.col(key)).alias("subject"),
            F.array_compact(F.array(*fields)).alias("fields"),
            image.alias("image_url"),
            *keep,
        )
    )
