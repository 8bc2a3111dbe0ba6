"""Column names, domain constants and schemas of the journey model.

All time arithmetic is done in BIGINT microseconds since the epoch (UTC).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


@dataclass(frozen=True)
class JourneyCols:
    """Names of the three columns every journey operator reads."""

    id: str = "id"
    ts: str = "event_timestamp"
    event: str = "ed_id"


DEFAULT_COLS = JourneyCols()

# --- fixed values of the journey domain (must equal the reference's) -------
SUCCESS_ID = 28
INACTIVITY_DAYS = 60
EPSILON_US = 1
RATIO_EPS = 1e-5
PROB_EPS = 1e-6
US_PER_SEC = 1_000_000
US_PER_HOUR = 3_600 * US_PER_SEC
US_PER_DAY = 86_400 * US_PER_SEC
SECONDS_PER_DAY = 86_400

# Event groups used by the static feature vector.
APPLICATION_IDS = (3, 12, 13, 14, 15, 16, 17, 19)
APPROVAL_IDS = (12, 15)
FIRST_PURCHASE_IDS = (4, 5, 6, 7, 11, 18)
ORDER_INTENT_IDS = (5, 6, 7, 11, 18)
DOWNPAYMENT_IDS = (8, 25, 26, 27)
PROSPECTING_IDS = (2, 9, 10, 20, 21, 22, 23)

# Milestone of an event, feature version (26 and 27 both map to 5, 28 absent).
FEATURE_MILESTONES = {12: 1, 15: 1, 7: 2, 18: 2, 29: 3, 8: 4, 25: 4, 26: 5, 27: 5}

# Momentum windows (seconds) for early-journey counts.
MOMENTUM_WINDOWS = {"1h": 3_600, "5h": 18_000, "1d": 86_400, "3d": 259_200}
# Trailing windows (seconds) anchored at the last observed event.
TRAILING_WINDOWS = {"5h": 18_000, "1d": 86_400, "3d": 259_200}

# Sequence lengths.
SEQ_LEN_DENSE = 50
SEQ_LEN_TPP = 128
SEQ_LEN_STEPS = 256

# Tier tables: (upper thresholds, value per tier; None = keep the raw probability).
SEQUENCE_MODEL_TIERS = ((0.40, 0.60, 0.75), (0.0, 0.15, 0.5, None))
BOOSTED_TREE_TIERS = ((0.6, 0.7, 0.8), (0.0, 0.15, 0.5, 0.8))

# Event definitions: (event_name, journey_id, event_definition_id, milestone_number, stage).
EVENT_DEFINITIONS = (
    ("application_phone_approved", 1, 15, 1, "Apply for Credit"),
    ("application_phone_declined", 1, 16, None, "Apply for Credit"),
    ("application_phone_pending", 1, 17, None, "Apply for Credit"),
    ("application_web_approved", 1, 12, 1, "Apply for Credit"),
    ("application_web_declined", 1, 13, None, "Apply for Credit"),
    ("application_web_pending", 1, 14, None, "Apply for Credit"),
    ("application_web_submit", 1, 3, None, "Apply for Credit"),
    ("application_web_view", 1, 19, None, "Apply for Credit"),
    ("account_activitation", 1, 29, 3, "Credit Account"),
    ("account_fraud_review", 1, 37, None, "Credit Account"),
    ("campaign_click", 1, 2, None, "Discover"),
    ("customer_requested_catalog_digital", 1, 9, None, "Discover"),
    ("fingerhut_university", 1, 10, None, "Discover"),
    ("pre_application_3rd_party_affiliates", 1, 22, None, "Discover"),
    ("site_registration", 1, 23, None, "Discover"),
    ("account_downpaymentcleared", 1, 27, 5, "Downpayment"),
    ("account_downpaymentreceived", 1, 26, None, "Downpayment"),
    ("place_downpayment", 1, 8, 4, "Downpayment"),
    ("place_downpayment_phone", 1, 25, 4, "Downpayment"),
    ("add_to_cart", 1, 11, None, "First Purchase"),
    ("begin_checkout", 1, 6, None, "First Purchase"),
    ("browse_products", 1, 4, None, "First Purchase"),
    ("place_order_phone", 1, 18, 2, "First Purchase"),
    ("place_order_web", 1, 7, 2, "First Purchase"),
    ("view_cart", 1, 5, None, "First Purchase"),
    ("order_shipped", 1, 28, 6, "Order Shipped"),
    ("catalog_email_experian", 1, 20, None, "Prospecting"),
    ("catalog_mail", 1, 21, None, "Prospecting"),
)
# --- end of fixed values ---------------------------------------------------

EVENT_IDS = tuple(sorted(r[2] for r in EVENT_DEFINITIONS))

EVENT_DEF_SCHEMA = T.StructType(
    [
        T.StructField("event_name", T.StringType()),
        T.StructField("journey_id", T.IntegerType()),
        T.StructField("ed_id", T.IntegerType()),
        T.StructField("milestone_number", T.DoubleType()),
        T.StructField("stage", T.StringType()),
    ]
)

EVENT_SCHEMA = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("event_timestamp", T.TimestampType()),
        T.StructField("ed_id", T.IntegerType()),
    ]
)

JOURNEY_STEP = T.StructType(
    [T.StructField("event_timestamp", T.TimestampType()), T.StructField("ed_id", T.IntegerType())]
)


def event_definitions(spark: SparkSession) -> DataFrame:
    """The 28-row event dimension (fixed size: always safe to broadcast)."""
    rows = [(n, j, e, None if m is None else float(m), s) for n, j, e, m, s in EVENT_DEFINITIONS]
    df = spark.createDataFrame(rows, EVENT_DEF_SCHEMA)
    df._jf_rows = len(rows)  # size known: safe to broadcast without a count
    return df


def to_us(c: str | Column) -> Column:
    """Microseconds since the epoch of a TIMESTAMP or TIMESTAMP_NTZ column, read as UTC.

    Relies on the UTC session time zone set by ``tune_session`` (NTZ values are wall clock in UTC).
    """
    col = F.col(c) if isinstance(c, str) else c
    return F.unix_micros(col.cast("timestamp"))


def from_us(c: str | Column) -> Column:
    """TIMESTAMP_NTZ (UTC wall clock) from microseconds since the epoch."""
    col = F.col(c) if isinstance(c, str) else c
    return F.timestamp_micros(col).cast("timestamp_ntz")


def r6(c: str | Column, digits: int = 6) -> Column:
    """Round a double for exact comparison with another engine (last-ulp noise)."""
    col = F.col(c) if isinstance(c, str) else c
    return F.round(col.cast("double"), digits)
