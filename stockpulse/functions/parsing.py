"""Value parsing and normalisation (J9, J10, J13-J16, J21, J26), as built-in
column expressions so they stay in whole-stage codegen.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values (must equal the reference's cleaning rules).
# Whole-value sentinels turned into missing, case-sensitive:
SENTINELS = ["nan", "NaN", "NULL", "None", "", "unknown", "Unknown"]
# Constant fills for SKU master columns:
SKU_FILLS = {
    "therapeutic_area": "Medical_supplies",
    "brand_generic_flag": "Not Applicable",
    "formulary_status": "Not Applicable",
    "base_drug_name": "Not a Drug",
}
# Identifying columns dropped from transactions:
DROP_COLS = ["physician_id", "prescription_id", "prescription_detail_id", "procedure_id", "bill_id"]
# Numeric columns of transactions, forced to double:
NUMERIC_COLS = ["quantity_consumed", "unit_cogs", "unit_price",
                "margin_amount", "margin_percentage", "total_revenue"]
# Text columns normalised:
TEXT_NORM_COLS = ["transaction_code", "transaction_type"]
# Timestamp columns parsed:
TIME_COLS = ["transaction_time", "last_updated"]

# Decimal-number grammar accepted when coercing text to a number: optional
# sign, digits with optional fraction, optional exponent; or inf/nan words.
# Type suffixes such as `1d`/`1f` (which Spark's cast accepts) are rejected.
NUMBER_PATTERN = r"^\s*([+-]?((\d+\.?\d*)|(\.\d+))([eE][+-]?\d+)?|(?i)[+-]?inf(inity)?)\s*$"
TIME_FORMATS = ["yyyy-MM-dd HH:mm:ss.SSSSSS", "yyyy-MM-dd HH:mm:ss.SSS", "yyyy-MM-dd HH:mm:ss",
                "yyyy-MM-dd'T'HH:mm:ss.SSSSSS", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd HH:mm",
                "yyyy-MM-dd", "yyyy/MM/dd HH:mm:ss", "yyyy/MM/dd", "MM/dd/yyyy HH:mm:ss", "MM/dd/yyyy"]


def to_number(c: Column) -> Column:
    """Text -> double, anything unparseable -> NULL; NaN -> NULL."""
    s = F.trim(c.cast("string"))
    v = F.when(s.rlike(NUMBER_PATTERN), s.try_cast("double"))
    return F.nanvl(v, F.lit(None).cast("double"))      # one reference: parsed once per value


def _separators(time_format: str) -> str:
    """What a text in this format holds besides digits and signs."""
    return "".join(x for x in time_format if x in " T:./")


def to_timestamp_lenient(c: Column) -> Column:
    """Text -> zone-free timestamp (the wall clock written in the text),
    unparseable -> NULL (never raises under ANSI). A format is tried only on texts with its
    separators, as every other text fails it and a failure costs an exception per row."""
    s = F.trim(c.cast("string"))
    has = F.translate(s, "t0123456789+-", "T")         # the formats' T may be lower case
    tried = [F.when((has == _separators(f)) & (F.contains(s, F.lit("-")) if "-" in f else F.lit(True)),
                    F.try_to_timestamp(s, F.lit(f))) for f in TIME_FORMATS]
    return F.coalesce(*tried).cast("timestamp_ntz")


def null_sentinels(c: Column) -> Column:
    """Whole-value sentinel text -> NULL; other values unchanged."""
    return F.when(~c.isin(*SENTINELS) | c.isNull(), c)


def normalise_text(c: Column) -> Column:
    """Strip, '_' and '-' -> space, lower case. NULL stays NULL."""
    blank = lambda x, dash: F.replace(x, F.lit(dash), F.lit(" "))  # noqa: E731 (translate looks every character up)
    return F.lower(blank(blank(F.trim(c), "_"), "-"))


def row_hash(cols: list[str]) -> Column:
    """MD5 of the values as text joined by '||'; a missing value hashes
    as the text 'nan' (concat_ws would skip NULLs, shifting the fields)."""
    return F.md5(F.concat_ws("||", *[F.coalesce(F.col(c).cast("string"), F.lit("nan")) for c in cols]))


def int_or_zero(c: Column) -> Column:
    """Number-like -> int, else 0."""
    return F.coalesce(to_number(c).cast("int"), F.lit(0))


def parse_key_list(s: Column, key_type: str = "bigint") -> Column:
    """J26: '12, 7,,3' -> [12, 7, 3]; blanks dropped."""
    parts = F.filter(F.transform(F.split(s, ","), lambda x: F.trim(x)), lambda x: x != "")
    return F.transform(parts, lambda x: x.cast(key_type))


def sanitize_landing_name(name: str) -> str:
    """Landing column names: lower case, runs of non-word chars -> '_'
    (blanks at the ends too)."""
    import re
    return re.sub(r"\W+", "_", name.lower())


def sanitize_validation_name(name: str, dash: bool) -> str:
    """Validation names: lower, ' ' -> '_', and '-' -> '_' for transactions."""
    n = name.lower().replace(" ", "_")
    return n.replace("-", "_") if dash else n


def sanitize_clean_name(name: str, dash: bool) -> str:
    """Cleaning names: strip, lower, ' ' -> '_', and '-' -> '_' for transactions."""
    n = name.strip().lower().replace(" ", "_")
    return n.replace("-", "_") if dash else n


def to_key(c: Column) -> Column:
    """A text key as an integer, NULL where it is none."""
    return c.try_cast("bigint")
