"""Thresholds. Operators take them as keyword defaults."""

SAME_OPENING_DAYS = 45
FUZZY_TITLE = 0.93
CAMPAIGN_PLACES = 5
CAMPAIGN_SALARY_SHARE = 0.8
SALARY_TEMPLATE_RECORDS = 10
SALARY_TEMPLATE_SHARE = 0.5
DEADLINE_TEMPLATE_RECORDS = 20
DEADLINE_TEMPLATE_SHARE = 0.25
MIN_SALARY_SAMPLE = 5
SMALL_SALARY_SAMPLE = 20
DESCRIBED_CHARS = 100
GOLD_BIN_WIDTH = 1_000_000
GOLD_LAST_BIN = 30
APP_BIN_WIDTH = 2_000_000
APP_UPPER_EDGE = 30_000_000
PERCENTILES = (0.10, 0.25, 0.50, 0.75, 0.90)
PAY_FLOOR = 500_000
PAY_CEILING = 100_000_000
WIDE_RANGE = 4
EARLIEST_POSTING = "2010-01-01"
FUTURE_DAYS = 2
LIFECYCLE_DAYS = 30
REVIEW_VALID_DAYS = 365
MAX_QUERY_LENGTH = 100
MAX_FILTER_VALUES = 40
MAX_VALUE_LENGTH = 200
MAX_SALARY_BOUND = 10_000_000_000
DOMAIN_TRIALS = 15
REJECTION_SAMPLES = 20
MIN_CLUSTER = 10
