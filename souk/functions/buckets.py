"""Bucket definitions and default thresholds of the marts.

Every value here is a default parameter; callers may pass their own.
"""

from __future__ import annotations

# Delivery delay buckets of the delay distribution mart,
# inclusive day ranges in display order, the last one being the ELSE arm.
DELAY_BUCKETS_7 = (
    (None, -15, "15+ days early"),
    (-14, -8, "8-14 days early"),
    (-7, -1, "1-7 days early"),
    (0, 0, "On time"),
    (1, 7, "1-7 days late"),
    (8, 14, "8-14 days late"),
    (None, None, "15+ days late"),
)

# The coarser delay buckets of the review-score-by-delay mart.
DELAY_BUCKETS_5 = (
    (None, -8, "Early (8+ days)"),
    (-7, -1, "Early (1-7 days)"),
    (0, 0, "On time"),
    (1, 7, "Late (1-7 days)"),
    (None, None, "Late (8+ days)"),
)

# Payment installment buckets (0 and NULL fall in the last).
INSTALLMENT_BUCKETS = (
    (1, 1, "1 (single payment)"),
    (2, 4, "2-4"),
    (5, 8, "5-8"),
    (None, None, "9+"),
)

# Order statuses without a completed transaction, excluded
# from the sales marts; the payment type dropped by the cleaning layer;
# and the minimum group sizes of the filtered marts.
EXCLUDED_STATUSES = ("unavailable", "canceled")
EXCLUDED_PAYMENT_TYPES = ("not_defined",)
MIN_ITEMS_FREIGHT = 30
MIN_ORDERS_ROUTE = 20
MIN_REVIEWS_CATEGORY = 30
MIN_REVIEWS_PAYMENT = 20

# Partial months dropped from the monthly trend chart.
PARTIAL_MONTHS = ("2016-09", "2018-09")
